"""Source files that are no sentence of the language they claim to be."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.syntax import EXTENSIONS, first_error
from loomline.operators.skew import spread


def syntax_errors(files: DataFrame) -> DataFrame:
    """One row for each distinct file of a known extension with a text:
    (relative_path, repo_name, language, broken, kind, line, found).

    The text's tokens are derived through the grammar of its extension (.py, .js, .mjs, .ts, .java, .go; the
    `language` column is not used). `kind` is `token` where a token cannot stand, `line` and `found` say which;
    it is `end` where the text stops before a sentence is complete. Null, empty and blank texts, and files of
    other extensions, are not broken and give no row; a byte-order mark, any line ends and repeated rows of a
    file do not matter; texts of any length are read to their first error. The grammars' derivatives are kept
    per worker, within a bound.
    """
    ext = F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z]+)$", 1))
    rows = (
        files.select("relative_path", "repo_name", "file_text", ext.alias("ext"))
        .where(F.col("ext").isin(*EXTENSIONS) & F.col("file_text").rlike(r"[^\s\x{FEFF}]"))
    )
    names = ["relative_path", "repo_name", "language", "broken", "kind", "line", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, repos, texts, exts = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for path, repo, text, e in zip(paths, repos, texts, exts, strict=True):
                language = EXTENSIONS[e]
                error = first_error(text, language)
                if error is None:
                    out.append((path, repo, language, False, None, None, None))
                else:
                    kind, offset, token = error
                    line = text.count("\n", 0, offset) + 1 if "\n" in text else text.count("\r", 0, offset) + 1
                    out.append((path, repo, language, True, kind, line, token))
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    schema = "relative_path string, repo_name string, language string, broken boolean, kind string, line int, found string"
    return spread(rows).mapInArrow(run, schema).dropDuplicates(["relative_path"])


def broken_files(files: DataFrame) -> DataFrame:
    """The files that do not parse, with the place and kind of the first error."""
    return syntax_errors(files).where("broken").drop("broken")


def broken_rates(files: DataFrame) -> DataFrame:
    """For each repository and language the parsed files, the broken ones (cut off, or at a token) and their share."""
    return (
        syntax_errors(files)
        .groupBy("repo_name", "language")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.count_if("broken").alias("n_broken"),
            F.count_if(F.col("kind") == "end").alias("n_cut_off"),
            F.round(F.avg(F.col("broken").cast("double")), 6).alias("broken_share"),
        )
    )
