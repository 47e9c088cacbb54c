"""Dependency graphs: edges (src, dst) mean that src depends on dst.

A graph whose counted edges are at most SMALL is solved exactly by one task, as what it holds is bounded; larger
graphs are worked on in rounds, which hand over to one task once what is left is small. Rounds keep their state in
checkpoints (in the folder all executors share), so lineage does not grow and a lost executor costs no rounds. Only
counts and single rows reach the driver. Null ends are no edges, repeated edges count once, self-edges are kept
unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.skew import Probe, salted_join
from loomline.session import ensure_checkpoint_dir

#: Rounds after which what was reached is written in one piece.
COMPACT = 8
#: Edges that one task may hold (some 200 MB of ids).
SMALL = 500_000


def _in_one_task(edges: DataFrame, solve: Callable[[list, list, list], Iterator[list]], schema: str, marked: DataFrame | None = None) -> DataFrame:
    """The columns `solve(sources, targets, marked ids)` gives, computed by one task. The caller has checked the size."""
    rows = edges.select("src", "dst")
    if marked is not None:
        rows = rows.unionByName(marked.select(F.col("id").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, ids = [], [], []
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b is None:
                    ids.append(a)
                else:
                    src.append(a)
                    dst.append(b)
        columns = solve(src, dst, ids)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    fields = edges.sparkSession.createDataFrame([], schema).schema
    names, kinds = fields.names, [to_arrow_type(f.dataType) for f in fields]
    return rows.repartition(1).mapInArrow(run, schema)


def _breadth_first(max_depth: int, paths: bool) -> Callable[[list, list, list], list[list]]:
    def solve(src: list, dst: list, starts: list) -> list[list]:
        after: dict = {}
        for a, b in zip(src, dst, strict=True):
            after.setdefault(a, []).append(b)
        depth = dict.fromkeys(starts, 0)
        way = {x: [x] for x in depth}
        frontier = list(depth)
        for k in range(1, max_depth + 1):
            fresh: dict = {}
            for a in frontier:
                for b in after.get(a, ()):
                    if b not in depth:
                        step = way[a] + [b] if paths else None
                        if b not in fresh or (paths and step < fresh[b]):
                            fresh[b] = step
            if not fresh:
                break
            depth |= dict.fromkeys(fresh, k)
            way |= fresh if paths else {}
            frontier = list(fresh)
        out = [list(depth), list(depth.values())]
        return [*out, [way[x] for x in depth]] if paths else out

    return solve


def _strong_components(src: list, dst: list, _: list) -> list[list]:
    """The nodes of cycles and the least id of each cycle's component: depth-first search with an explicit stack."""
    after: dict = {}
    for a, b in zip(src, dst, strict=True):
        after.setdefault(a, []).append(b)
    number: dict = {}
    low: dict = {}
    on, stack = set(), []
    ids, least = [], []
    for root in after:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        work = [(root, iter(after[root]))]
        while work:
            a, rest = work[-1]
            deeper = False
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    stack.append(b)
                    on.add(b)
                    work.append((b, iter(after.get(b, ()))))
                    deeper = True
                    break
                if b in on:
                    low[a] = min(low[a], number[b])
            if deeper:
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[a])
            if low[a] == number[a]:
                group = []
                while not group or group[-1] != a:
                    group.append(stack.pop())
                    on.discard(group[-1])
                if len(group) > 1:
                    ids += group
                    least += [min(group)] * len(group)
    return [ids, least]


def _longest_ways(src: list, dst: list, _: list) -> list[list]:
    """The number of edges of the longest way from each node of an acyclic graph."""
    left: dict = {}
    before: dict = {}
    for a, b in zip(src, dst, strict=True):
        left[a] = left.get(a, 0) + 1
        left.setdefault(b, 0)
        before.setdefault(b, []).append(a)
    level = dict.fromkeys(left, 0)
    ready = [x for x, n in left.items() if n == 0]
    while ready:
        b = ready.pop()
        for a in before.get(b, ()):
            level[a] = max(level[a], level[b] + 1)
            left[a] -= 1
            if left[a] == 0:
                ready.append(a)
    return [list(level), list(level.values())]


def _power_iteration(damping: float, rounds: int, tolerance: float, compat: bool) -> Callable[[list, list, list], list[list]]:
    def solve(src: list, dst: list, nodes: list) -> list[list]:
        place = {x: k for k, x in enumerate(dict.fromkeys([*src, *dst, *nodes]))}
        n = len(place)
        a, b = (np.fromiter((place[x] for x in c), np.int64, len(c)) for c in (src, dst))
        share = np.bincount(b if compat else a, minlength=n)
        kept = share[a] > 0
        a, b = a[kept], b[kept]
        scores = np.full(n, 1.0 / max(n, 1))
        for _ in range(rounds):
            fresh = (1 - damping) / n + damping * np.bincount(b, weights=scores[a] / share[a], minlength=n) if n else scores
            change = np.abs(fresh - scores).sum()
            scores = fresh
            if change < tolerance:
                break
        return [list(place), scores.tolist()]

    return solve


def edges_of(components: DataFrame, id_col: str = "id", deps_col: str = "depends_on", known_only: bool = True) -> DataFrame:
    """Distinct edges of the components' dependency lists; edges to unknown ids are dropped unless `known_only` is false."""
    e = components.select(F.col(id_col).alias("src"), F.explode(deps_col).alias("dst")).where("src is not null and dst is not null").distinct()
    if not known_only:
        return e
    return salted_join(e, components.select(F.col(id_col).alias("dst")).where("dst is not null").distinct(), ["dst"], "left_semi").select("src", "dst")


def reverse(edges: DataFrame) -> DataFrame:
    """The edges turned round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_directions(edges: DataFrame) -> DataFrame:
    """All edges with their direction: (src, dst, direction)."""
    return edges.withColumn("direction", F.lit("depends_on")).unionByName(reverse(edges).withColumn("direction", F.lit("depended_by")))


def clean(edges: DataFrame, loops: bool = True) -> DataFrame:
    """Distinct edges without null ends, and without self-edges unless `loops`."""
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    return (e if loops else e.where("src <> dst")).distinct()


def in_degrees(edges: DataFrame) -> DataFrame:
    """How many components depend directly on each: (id, dependents)."""
    return clean(edges).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))


def high_impact(edges: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """The `most` components with at least `least` direct dependents; ties by id."""
    return in_degrees(edges).where(F.col("dependents") >= least).orderBy(F.col("dependents").desc(), "id").limit(most)


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge; a self-edge is an edge."""
    e = clean(edges)
    touched = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return nodes.select("id").where("id is not null").distinct().join(touched, "id", "left_anti")


def degree_centrality(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The `most` nodes with most distinct neighbours (either way, ties by id), and the edges between them."""
    e = clean(edges, loops=False)
    near = e.unionByName(reverse(e)).distinct()
    top = near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.col("degree").desc(), "id").limit(most)
    ids = top.select("id")
    kept = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return top, kept.select("src", "dst")


def impact(edges: DataFrame, starts: DataFrame, max_depth: int = 10, direction: str = "depended_by", paths: bool = False, small: int = SMALL) -> DataFrame:
    """Breadth-first reach from the start ids: (id, depth), and `path` (one shortest, least by its ids) if `paths`.

    `direction` is depends_on, depended_by or both; both keeps the smaller depth. Starts have depth 0, also those
    without edges. Each round joins only the frontier and removes what was reached before.
    """
    if direction == "both":
        one = impact(edges, starts, max_depth, "depends_on", paths, small)
        two = impact(edges, starts, max_depth, "depended_by", paths, small)
        best = F.min(F.struct("depth", "path") if paths else F.struct("depth")).alias("b")
        return one.unionByName(two).groupBy("id").agg(best).select("id", "b.*")
    ensure_checkpoint_dir(edges.sparkSession)
    e = clean(edges, loops=False)
    e = (e if direction == "depends_on" else reverse(e)).select("src", "dst").checkpoint()
    first = starts.select("id").where("id is not null").distinct()
    if e.count() <= small:
        kind = edges.schema["src"].dataType.simpleString()
        return _in_one_task(e, _breadth_first(max_depth, paths), f"id {kind}, depth int" + (f", path array<{kind}>" if paths else ""), first)
    e = Probe(e, "src")
    first = first.withColumn("depth", F.lit(0))
    if paths:
        first = first.withColumn("path", F.array("id"))
    reached = frontier = first.checkpoint()
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("id").alias("src"), *(["path"] if paths else []))
        near = e.join(step)
        if paths:
            near = near.groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
            near = near.select("id", F.lit(depth).alias("depth"), "path")
        else:
            near = near.select(F.col("dst").alias("id")).distinct().withColumn("depth", F.lit(depth))
        frontier = near.join(reached.select("id"), "id", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % COMPACT == 0:  # many small pieces make many small tasks
            reached = reached.repartition("id").checkpoint()
    return reached


def pagerank(
    edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, compat: bool = False, small: int = SMALL
) -> DataFrame:
    """PageRank over who depends on whom: (id, score). A node's score goes to what it depends on, in equal parts.

    Dangling mass is not redistributed. `compat` divides by a node's number of dependents instead of its number of
    dependencies, and nodes without dependents pass nothing on. Stops when the sum of changes is below `tolerance`.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = clean(edges, loops=True).checkpoint()
    more = None if nodes is None else nodes.select("id").where("id is not null").distinct()
    if e.count() <= small and (more is None or more.count() <= small):
        kind = edges.schema["src"].dataType.simpleString()
        return _in_one_task(e, _power_iteration(damping, rounds, tolerance, compat), f"id {kind}, score double", more)
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    ids = (ids if more is None else ids.unionByName(more)).distinct().checkpoint()
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    by = "dst" if compat else "src"
    share = e.groupBy(F.col(by).alias("src")).agg(F.count(F.lit(1)).alias("share"))
    e = Probe(salted_join(e, share, ["src"], "inner").checkpoint(), "src")
    scores = ids.withColumn("score", F.lit(1.0 / n)).checkpoint()
    for _ in range(rounds):
        sent = e.join(scores.withColumnRenamed("id", "src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("share")).alias("got"))
        fresh = scores.join(sent, "id", "left").select(
            "id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("next"), "score"
        ).checkpoint()
        change = fresh.agg(F.sum(F.abs(F.col("next") - F.col("score")))).first()[0]
        scores = fresh.select("id", F.col("next").alias("score"))
        if change < tolerance:
            break
    return scores


def _between(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """The edges both of whose ends are (left_semi) or are not (left_anti) among the ids of `nodes`; hot ends are salted."""
    kept = salted_join(edges, nodes.select(F.col("id").alias("src")), ["src"], how)
    return salted_join(kept, nodes.select(F.col("id").alias("dst")), ["dst"], how).select("src", "dst")


def components_scc(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Strongly connected components of more than one node: (id, scc), scc being the least id of the component.

    Above `small` edges nodes without an incoming or outgoing edge are trimmed; on the rest the greatest id that
    reaches a node is its colour, and the nodes of a colour that reach its root backwards are one component. They are
    removed and the next turn begins, until at most `small` edges are left. Each turn settles at least one component
    per colour, so there is no bound on turns.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    kind = edges.schema["src"].dataType.simpleString()
    left = clean(edges, loops=False).checkpoint()
    n_left = left.count()
    done = spark.createDataFrame([], f"id {kind}, scc {kind}")
    while n_left > small:
        while n_left:  # trimming
            ins, outs = left.select(F.col("dst").alias("id")).distinct(), left.select(F.col("src").alias("id")).distinct()
            left = _between(left, ins.join(outs, "id", "left_semi"), "left_semi").checkpoint()
            before, n_left = n_left, left.count()
            if before == n_left:
                break
        if n_left <= small:
            break
        ids = left.select(F.col("src").alias("id")).distinct()
        colour = _settle(left, ids.withColumn("c", F.col("id")).checkpoint())
        same = salted_join(left, colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), ["src"], "inner")
        same = salted_join(same, colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), ["dst"], "inner").where("cs = cd").select("src", "dst")
        # backwards from each root within its colour: reaching is "depended_by" along src -> dst
        found = impact(same, colour.where("id = c").select("id"), 2**31 - 2, "depended_by", small=small).select("id").join(colour, "id").checkpoint()
        named = found.groupBy("c").agg(F.min("id").alias("scc"), F.count(F.lit(1)).alias("n"))
        done = done.unionByName(salted_join(found, named, ["c"], "inner").where("n > 1").select("id", "scc").checkpoint())
        left = _between(left, found, "left_anti").checkpoint()
        n_left = left.count()
    return done.unionByName(_in_one_task(left, _strong_components, f"id {kind}, scc {kind}")) if n_left else done


def _settle(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """The greatest colour that reaches each node."""
    e = Probe(edges, "src")
    while True:
        sent = e.join(colour.select(F.col("id").alias("src"), "c")).groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("got"))
        fresh = colour.join(sent, "id", "left").select("id", F.greatest("c", F.coalesce("got", "c")).alias("c"), (F.col("got") > F.col("c")).alias("moved")).checkpoint()
        moved = not fresh.where("moved").isEmpty()
        colour = fresh.select("id", "c")
        if not moved:
            return colour


def condensation(edges: DataFrame, scc: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """The acyclic graph of the components: edges between different (component or single) nodes, named by their least id."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = clean(edges, loops=False)
    if scc is None:
        e = e.checkpoint()
        scc = components_scc(e, small).checkpoint()
    a = salted_join(e, scc.select(F.col("id").alias("src"), F.col("scc").alias("ca")), ["src"], "left")
    b = salted_join(a, scc.select(F.col("id").alias("dst"), F.col("scc").alias("cb")), ["dst"], "left")
    return b.select(F.coalesce("ca", "src").alias("src"), F.coalesce("cb", "dst").alias("dst")).where("src <> dst").distinct()


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """Dependencies first: (id, level) over the condensation; level 0 depends on nothing, others on lower levels only.

    The nodes of one cycle share the level of their component. Each round peels the nodes whose dependencies are all
    peeled, until at most `small` edges are left; a node's level is the number of rounds it stayed and of the edges
    of its longest way in what is left.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = clean(edges).checkpoint()
    scc = components_scc(e, small).checkpoint()
    left = condensation(e, scc).checkpoint()
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    ids = (ids if nodes is None else ids.unionByName(nodes.select("id").where("id is not null"))).distinct().join(scc, "id", "left").select("id", F.coalesce("scc", "id").alias("g")).checkpoint()
    every = ids.select("g").distinct().withColumn("level", F.lit(0))
    rounds = 0
    while (n := left.count()) > small:
        rounds += 1
        todo = left.select(F.col("src").alias("id")).distinct().checkpoint()
        every = every.unionByName(todo.select(F.col("id").alias("g"), F.lit(rounds).alias("level")))
        left = salted_join(left, todo.withColumnRenamed("id", "dst"), ["dst"], "left_semi").select("src", "dst").checkpoint()
    if n:
        kind = edges.schema["src"].dataType.simpleString()
        every = every.unionByName(_in_one_task(left, _longest_ways, f"g {kind}, level int").select("g", (F.col("level") + rounds).alias("level")))
    return salted_join(ids, every.groupBy("g").agg(F.max("level").alias("level")), ["g"], "inner").select("id", "level")


def doc_candidates(components: DataFrame, edges: DataFrame, floor: int = 400, share: float = 0.05) -> DataFrame:
    """The ids that are documented: classes, interfaces and structs (functions where there are none), without names of
    errors; if they are at least `floor` and `share` of all, those that others depend on are left out."""
    kind = F.lower(F.trim("component_type"))
    valid = ["class", "interface", "struct"]
    rows = components.where(F.col("id").isNotNull()).select("id", kind.alias("kind")).dropDuplicates(["id"])
    total, typed = rows.agg(F.count(F.lit(1)), F.count_if(F.col("kind").isin(valid))).first()
    kept = rows.where(F.col("kind").isin(valid if typed else [*valid, "function"]) & ~F.lower("id").rlike("error|exception|failed|invalid")).select("id")
    if kept.count() >= max(floor, int(total * share)):
        kept = kept.join(clean(edges, loops=False).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return kept


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that depend on nothing."""
    return nodes.select("id").distinct().join(clean(edges).select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes nothing depends on."""
    return nodes.select("id").distinct().join(clean(edges).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


# modules: rows (module, parent, depth, preorder, component_id)


def module_index(modules: DataFrame) -> DataFrame:
    """The module of each component, the first in pre-order: (component_id, module)."""
    return modules.where("component_id is not null").groupBy("component_id").agg(F.min_by("module", F.struct("preorder", "module")).alias("module"))


def module_graph(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct edges between different modules: (src, dst)."""
    e = clean(edges)
    a = salted_join(e, index.select(F.col("component_id").alias("src"), F.col("module").alias("ms")), ["src"], "inner")
    b = salted_join(a, index.select(F.col("component_id").alias("dst"), F.col("module").alias("md")), ["dst"], "inner")
    return b.where("ms <> md").select(F.col("ms").alias("src"), F.col("md").alias("dst")).distinct()


def module_neighbours(edges: DataFrame, index: DataFrame) -> DataFrame:
    """For each module what it depends on and what depends on it, sorted."""
    g = module_graph(edges, index)
    out = g.groupBy(F.col("src").alias("module")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    back = g.groupBy(F.col("dst").alias("module")).agg(F.array_sort(F.collect_set("src")).alias("depended_by"))
    none = F.array().cast("array<string>")
    return out.join(back, "module", "full").select("module", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_by", none).alias("depended_by"))


def impact_by_module(reached: DataFrame, index: DataFrame) -> DataFrame:
    """Per module the number of reached components and their greatest depth; components of no module are `unassigned`."""
    joined = reached.join(index.withColumnRenamed("component_id", "id"), "id", "left")
    return joined.groupBy(F.coalesce("module", F.lit("unassigned")).alias("module")).agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("max_depth"))


def processing_order(modules: DataFrame) -> DataFrame:
    """Modules with children before parents: deepest first, then in pre-order."""
    m = modules.groupBy("module", "parent").agg(F.min("depth").alias("depth"), F.min("preorder").alias("preorder"))
    return m.orderBy(F.col("depth").desc(), "preorder", "module")


def affected_modules(modules: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 10) -> DataFrame:
    """Modules with a component that a change reaches, and all their ancestors: (module, direct).

    `changed` holds component ids. Ancestors are found by walking up parent by parent, as many rounds as the tree is deep.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    reached = impact(edges, changed, max_depth)
    hit = reached.join(module_index(modules).withColumnRenamed("component_id", "id"), "id").select("module").distinct()
    tree = modules.select("module", "parent").distinct().checkpoint()
    level = every = hit.withColumn("direct", F.lit(True)).checkpoint()
    while True:
        up = tree.join(level.select("module"), "module").select(F.col("parent").alias("module")).where("module is not null").distinct()
        level = up.join(every.select("module"), "module", "left_anti").withColumn("direct", F.lit(False)).checkpoint()
        if level.isEmpty():
            return every
        every = every.unionByName(level)


def module_scores(scores: DataFrame, index: DataFrame, most: int = 10) -> DataFrame:
    """The modules with the greatest sum of their components' scores; ties by name."""
    s = scores.join(index.withColumnRenamed("component_id", "id"), "id").groupBy("module").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return s.orderBy(F.col("score").desc(), "module").limit(most)


def call_context(edges: DataFrame, core: DataFrame, components: DataFrame, most: int = 15) -> DataFrame:
    """Components one step from the core ids and not among them, at most `most` by id: (id, name, parameters)."""
    c = core.select("id").distinct()
    e = clean(edges)
    near = e.join(c.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).unionByName(
        e.join(c.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    )
    ids = near.distinct().join(c, "id", "left_anti")
    return ids.join(components.select("id", "name", "parameters").dropDuplicates(["id"]), "id").orderBy("id").limit(most)
