"""Matching client and server routes across repositories.

Routes are rows (route_key, protocol, method, path, role, component_id, repo_name, ...); `path` is canonical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.scalar import col, segments
from loomline.operators.skew import salted_join
from loomline.session import ensure_checkpoint_dir

LINK = ["client_repo", "client_component", "server_repo", "server_component", "route_key", "protocol", "method", "confidence"]


def _side(routes: DataFrame, role: str, protocol: str, prefix: str) -> DataFrame:
    rows = routes.where((F.col("role") == role) & (F.col("protocol") == protocol))
    return rows.select(
        "route_key", F.col("repo_name").alias(f"{prefix}_repo"), F.col("component_id").alias(f"{prefix}_component"),
        F.col("method").alias(f"{prefix}_method"), F.col("path").alias(f"{prefix}_path"),
    )


def match_exact(routes: DataFrame) -> DataFrame:
    """HTTP clients and servers of one route key in different repositories, confidence 1.0.

    Null keys and repositories match nothing. Hot keys are salted.
    """
    clients, servers = _side(routes, "client", "http", "client"), _side(routes, "server", "http", "server")
    joined = salted_join(clients, servers.drop("server_path"), ["route_key"], "inner")
    return (
        joined.where(F.col("client_repo") != F.col("server_repo"))
        .select("client_repo", "client_component", "server_repo", "server_component", "route_key",
                F.lit("http").alias("protocol"), F.coalesce("client_method", "server_method").alias("method"), F.lit(1.0).alias("confidence"))
        .dropDuplicates(["client_repo", "client_component", "server_repo", "server_component", "route_key"])
    )


def _by_template(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Clients joined with the servers of other repositories whose template their path agrees with.

    Each way in which templates of a length leave segments open is tried on each client path of that length: the path
    with these segments as `{}` is the template itself, so the join is one of equal paths.
    """
    segs = segments("client_path")
    left = clients.select("*", F.upper(F.coalesce("client_method", F.lit("GET"))).alias("__m"), segs.alias("__s"), F.size(segs).alias("__len"))
    right = servers.withColumn("__m2", F.upper("server_method")).withColumn("__p", F.array_join(segments("server_path"), "/"))
    open_ = F.transform(segments("server_path"), lambda x: x == "{}")
    masks = servers.select(F.size(segments("server_path")).alias("__len"), open_.alias("__o")).distinct()
    tried = left.join(masks, "__len")  # a few rows a length: how templates of that length look
    filled = F.array_join(F.zip_with("__s", "__o", lambda x, o: F.when(o, "{}").otherwise(x)), "/")
    tried = tried.withColumn("__p", filled).drop("__s", "__len", "__o").distinct()
    found = salted_join(tried, right, ["__p"], "inner")
    return found.where((F.col("client_repo") != F.col("server_repo")) & (F.col("__m2").isNull() | (F.col("__m2") == F.col("__m")))).withColumn("client_method", F.col("__m"))


def match_templates(routes: DataFrame) -> DataFrame:
    """HTTP clients whose key no server has, matched with templates of other repositories, confidence 0.8.

    Paths agree in the number of segments and in each segment that is not `{}` in the template; methods agree
    (no server method: any; no client method: GET). A key that only the client's own repository serves still
    keeps the client from being tried. The link carries the server's key.
    """
    servers = _side(routes, "server", "http", "server")
    clients = _unserved(_side(routes, "client", "http", "client"), servers)
    found = _by_template(clients.drop("route_key"), servers)
    return found.select(
        "client_repo", "client_component", "server_repo", "server_component", "route_key",
        F.lit("http").alias("protocol"), F.col("client_method").alias("method"), F.lit(0.8).alias("confidence"), "client_path",
    ).dropDuplicates(["client_repo", "client_component", "server_repo", "server_component", "route_key"])


def _unserved(clients: DataFrame, servers: DataFrame) -> DataFrame:
    served = servers.select("route_key").where(F.col("route_key").isNotNull()).distinct()
    return clients.where("route_key is null").unionByName(salted_join(clients.where("route_key is not null"), served, ["route_key"], "left_anti").select(*clients.columns))


def match_queues(routes: DataFrame) -> DataFrame:
    """Message producers (clients) and consumers (servers) of one key in different repositories; repeats stay."""
    clients, servers = _side(routes, "client", "mq", "client"), _side(routes, "server", "mq", "server")
    joined = salted_join(clients, servers, ["route_key"], "inner")
    return joined.where(F.col("client_repo") != F.col("server_repo")).select(
        "client_repo", "client_component", "server_repo", "server_component", "route_key",
        F.lit("mq").alias("protocol"), F.lit(None).cast("string").alias("method"), F.lit(1.0).alias("confidence"),
    )


def match_routes(routes: DataFrame) -> DataFrame:
    """All links: exact and template matches over HTTP, and queues."""
    return match_exact(routes).unionByName(match_templates(routes).drop("client_path")).unionByName(match_queues(routes))


def link_counts(routes: DataFrame, protocol: str = "http") -> DataFrame:
    """How many links each key makes between two repositories: (client_repo, server_repo, route_key, protocol, n_links).

    The links of `match_exact` (http) or `match_queues` (mq), counted without being made: components are counted per
    repository and key first, so a key that everybody calls costs one row a repository and not one a pair.
    """
    n = F.count(F.lit(1)) if protocol == "mq" else F.count_distinct("component_id")
    rows = routes.where((F.col("protocol") == protocol) & F.col("route_key").isNotNull()).groupBy("route_key", "role", "repo_name").agg(n.alias("n"))
    side = lambda role, prefix: rows.where(F.col("role") == role).select("route_key", F.col("repo_name").alias(f"{prefix}_repo"), F.col("n").alias(f"{prefix}_n"))
    pairs = salted_join(side("client", "client"), side("server", "server"), ["route_key"], "inner").where(F.col("client_repo") != F.col("server_repo"))
    return pairs.select("client_repo", "server_repo", "route_key", F.lit(protocol).alias("protocol"), (F.col("client_n") * F.col("server_n")).alias("n_links"))


def unmatched_classes(routes: DataFrame) -> DataFrame:
    """Routes whose key is in no link, as classes: (protocol, role, route_key, method, path, repo_name, n); a client
    matched by a template counts as matched under its own key too.

    The routes are read once and counted by class; a key is in an exact link if its clients and servers are not all of
    one repository, which each key's least and greatest repository tell without a join.
    """
    ensure_checkpoint_dir(routes.sparkSession)
    classes = routes.groupBy("protocol", "role", "route_key", "method", "path", "repo_name").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    of = lambda f, role: f(F.when(F.col("role") == role, F.col("repo_name")))
    ends = classes.where("route_key is not null").groupBy("protocol", "route_key").agg(
        of(F.min, "client").alias("c1"), of(F.max, "client").alias("c2"), of(F.min, "server").alias("s1"), of(F.max, "server").alias("s2")
    )
    exact = ends.where("c1 is not null and s1 is not null and not (c1 = c2 and s1 = s2 and c1 = s1)").select("route_key")
    side = lambda role, prefix: classes.where((F.col("protocol") == "http") & (F.col("role") == role)).select(
        "route_key", F.col("repo_name").alias(f"{prefix}_repo"), F.col("method").alias(f"{prefix}_method"), F.col("path").alias(f"{prefix}_path")
    )
    servers = side("server", "server")
    # of a key there are at most as many classes as repositories, methods and spellings, so none is hot
    unserved = ends.where("c1 is not null and s1 is null").select("route_key")
    open_ = side("client", "client").join(unserved, "route_key", "left_semi").unionByName(side("client", "client").where("route_key is null"))
    fuzzy = _by_template(open_.withColumnRenamed("route_key", "own"), servers)
    keys = exact.unionByName(fuzzy.select(F.explode(F.array("own", "route_key")).alias("route_key"))).distinct()
    return classes.join(keys, "route_key", "left_anti").select("protocol", "role", "route_key", "method", "path", "repo_name", "n")


def unmatched_routes(routes: DataFrame) -> DataFrame:
    """The routes of `unmatched_classes`, as they came."""
    keys = unmatched_classes(routes).select("route_key").distinct()
    return routes.where("route_key is null").unionByName(salted_join(routes.where("route_key is not null"), keys, ["route_key"], "left_semi").select(*routes.columns))


def merge_links(local: DataFrame, traced: DataFrame) -> DataFrame:
    """Local links and those of an external trace that no local link has (client, server and key the same)."""
    key = ["client_repo", "server_repo", "route_key"]
    fresh = traced.dropDuplicates(key).join(local.select(*key).distinct(), key, "left_anti")
    return local.unionByName(fresh.select(*local.columns))


def links_of_service(links: DataFrame, name: str) -> DataFrame:
    """Links with a repository on either side whose name contains `name`, in any letter case."""
    low = name.lower()
    return links.where(F.lower("client_repo").contains(low) | F.lower("server_repo").contains(low))


def links_of_method(links: DataFrame, method: str) -> DataFrame:
    """Links of an HTTP method, in any letter case; links without a method (queues) never match."""
    return links.where(F.upper("method") == method.upper())


def links_of_path(links: DataFrame, prefix: str) -> DataFrame:
    """Links whose key's path begins with `prefix`."""
    return links.where(F.regexp_replace("route_key", r"^__(?:route|mq)__[^_]*__", "").startswith(prefix))


def trace_route(links: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """All that is known of one key: its links and routes, as (kind, repo_name, component_id, other_repo, other_component)."""
    a = links.where(F.col("route_key") == key).select(
        F.lit("link").alias("kind"), F.col("client_repo").alias("repo_name"), F.col("client_component").alias("component_id"),
        F.col("server_repo").alias("other_repo"), F.col("server_component").alias("other_component"),
    )
    none = F.lit(None).cast("string")
    b = routes.where(F.col("route_key") == key).select(
        F.col("role").alias("kind"), "repo_name", "component_id", none.alias("other_repo"), none.alias("other_component")
    )
    return a.unionByName(b)


def protocol_histogram(counts: DataFrame) -> DataFrame:
    """Links per protocol, from `link_counts`."""
    return counts.groupBy("protocol").agg(F.sum("n_links").alias("n_links"))


def service_pairs(counts: DataFrame, samples: int = 3) -> DataFrame:
    """For each pair of repositories the number of links and the first few distinct keys, in the keys' order, from `link_counts`.

    Sample keys are ranked per pair after the keys of a pair are made distinct; no list of all keys is built.
    """
    pair = ["client_repo", "server_repo"]
    counted = counts.groupBy(*pair, "route_key").agg(F.sum("n_links").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy("route_key"))
    # the filter on the rank lets each task drop all but the first keys of a pair before the exchange
    first = counted.withColumn("r", rank).where(F.col("r") <= samples).groupBy(*pair).agg(F.array_sort(F.collect_list("route_key")).alias("sample_keys"))
    totals = counted.groupBy(*pair).agg(F.sum("n").alias("n_calls"), F.count(F.lit(1)).alias("n_keys"))
    return totals.join(first, pair)


def edge_labels(counts: DataFrame, most: int = 3) -> DataFrame:
    """The label of each edge of the service chart: up to `most` keys and how many more there are."""
    pairs = service_pairs(counts, most)
    more = F.col("n_keys") - F.size("sample_keys")
    shown = F.array_join("sample_keys", ", ")
    return pairs.select("client_repo", "server_repo", F.when(more > 0, F.concat(shown, F.lit(" +"), more.cast("string"))).otherwise(shown).alias("label"))


def route_table(routes: DataFrame) -> DataFrame:
    """Routes in the order of their tables."""
    return routes.orderBy("repo_name", "path", "role", "component_id")


def http_route(method: Column | str, path: Column | str) -> Column:
    """The method of a route in upper case, GET where it is missing."""
    return F.upper(F.coalesce(col(method), F.lit("GET")))
