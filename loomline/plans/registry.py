"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from loomline.plans import crossservice, graphs, lookups, problems, retrieval, samples, upkeep

QUERIES = {**lookups.QUERIES, **upkeep.QUERIES, **graphs.QUERIES, **crossservice.QUERIES, **retrieval.QUERIES, **problems.QUERIES, **samples.QUERIES}
SQL = {**lookups.SQL, **upkeep.SQL, **graphs.SQL, **crossservice.SQL, **retrieval.SQL, **problems.SQL, **samples.SQL}
