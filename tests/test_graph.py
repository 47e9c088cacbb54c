"""Graph operators on hand-worked graphs and against plain implementations."""

import random

import pytest

from loomline.operators import graph as g


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


M2 = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "D"), ("D", "C"), ("A", "B"), (None, "A")]


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.fixture(params=[g.SMALL, 0], ids=["one_task", "rounds"])
def small(request):
    return request.param


def test_impact(spark, rows, small):
    e = edges(spark, M2)
    assert rows(g.impact(e, ids(spark, "D"), small=small), "id", "depth") == [("A", 2), ("B", 2), ("C", 1), ("D", 0)]
    assert rows(g.impact(e, ids(spark, "A"), direction="depends_on", small=small), "id", "depth") == [("A", 0), ("B", 1), ("C", 1), ("D", 2)]
    assert rows(g.impact(e, ids(spark, "B"), direction="both", small=small), "id", "depth") == [("A", 1), ("B", 0), ("C", 1), ("D", 2)]
    paths = {r["id"]: r["path"] for r in g.impact(e, ids(spark, "A"), direction="depends_on", paths=True, small=small).collect()}
    assert paths == {"A": ["A"], "B": ["A", "B"], "C": ["A", "C"], "D": ["A", "C", "D"]}
    assert rows(g.impact(e, ids(spark, "A"), 1, "depends_on", small=small), "id") == [("A",), ("B",), ("C",)]
    assert rows(g.impact(edges(spark, []), ids(spark, "A"), small=small), "id", "depth") == [("A", 0)]


def test_scc_and_levels(spark, rows, small):
    e = edges(spark, M2)
    assert rows(g.components_scc(e, small)) == [("C", "C"), ("D", "C")]
    assert rows(g.components_scc(edges(spark, [("x", "x"), ("a", "b")]), small)) == []
    assert rows(g.components_scc(edges(spark, []), small)) == []
    assert rows(g.topological_levels(e, ids(spark, "E"), small), "id", "level") == [("A", 2), ("B", 1), ("C", 0), ("D", 0), ("E", 0)]
    assert rows(g.isolated_nodes(ids(spark, "A", "E", "E"), e)) == [("E",)]


def tarjan(pairs):
    import sys

    sys.setrecursionlimit(10000)
    out, index, low, stack, on, adj = [], {}, {}, [], set(), {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set())

    def visit(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        for w in adj[v]:
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            c = []
            while True:
                w = stack.pop()
                on.discard(w)
                c.append(w)
                if w == v:
                    break
            if len(c) > 1:
                out.append(c)

    for v in list(adj):
        if v not in index:
            visit(v)
    return sorted((x, min(c)) for c in out for x in c)


def test_scc_by_brute_force(spark, rows, small):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(42)]
    assert rows(g.components_scc(edges(spark, pairs), small)) == tarjan([(a, b) for a, b in pairs if a != b])


def test_scc_and_levels_of_a_long_chain_of_cycles(spark):
    """More turns than any fixed number of rounds: 400 cycles, each leading to the next, solved by one task; 4 in rounds."""
    for n, most in ((400, g.SMALL), (4, 0)):
        pairs = [p for k in range(n) for p in ((f"a{k:03}", f"b{k:03}"), (f"b{k:03}", f"a{k:03}"), (f"b{k:03}", f"a{k + 1:03}"))]
        e = edges(spark, pairs)
        assert {r["id"]: r["scc"] for r in g.components_scc(e, most).collect()} == {f"{c}{k:03}": f"a{k:03}" for k in range(n) for c in "ab"}
        assert {r["id"]: r["level"] for r in g.topological_levels(e, small=most).collect()} == {f"{c}{k:03}": n - k for k in range(n) for c in "ab"} | {f"a{n:03}": 0}


@pytest.mark.parametrize(("pairs", "nodes", "compat", "want"), [
    ([("A", "B")], [], False, {"A": 0.0750, "B": 0.1387}), ([("A", "B")], [], True, {"A": 0.0750, "B": 0.0750}),
    (M2, ["E"], False, {"A": 0.0300, "B": 0.0427, "C": 0.3769, "D": 0.3504, "E": 0.0300}), (M2, ["E"], True, {"A": 0.0300, "B": 0.0300, "C": 0.1067, "D": 0.0602, "E": 0.0300}),
])
def test_pagerank(spark, pairs, nodes, compat, want, small):
    got = {r["id"]: r["score"] for r in g.pagerank(edges(spark, pairs), ids(spark, *nodes) if nodes else None, compat=compat, small=small).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-3 for k, v in want.items())


def test_modules(spark, rows):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "c")])
    mods = spark.createDataFrame([("m", None, 0, 0, None), ("x", "m", 1, 1, "a"), ("x", "m", 1, 1, "b"), ("y", "m", 1, 2, "c"), ("y", "m", 1, 2, "a")], "module string, parent string, depth int, preorder int, component_id string")
    index = g.module_index(mods)
    assert rows(index) == [("a", "x"), ("b", "x"), ("c", "y")]
    assert rows(g.module_graph(e, index)) == [("x", "y")]
    assert rows(g.affected_modules(mods, e, ids(spark, "c"), 1)) == [("m", False), ("x", True), ("y", True)]
    assert [r["module"] for r in g.processing_order(mods).collect()] == ["x", "y", "m"]
    assert rows(g.impact_by_module(g.impact(e, ids(spark, "c")), index)) == [("x", 2, 2), ("y", 1, 0)]


def test_degrees(spark, rows):
    e = edges(spark, [(x, "hub") for x in "abcdef"] + [("a", "b")])
    assert rows(g.high_impact(e)) == [("hub", 6)]
    top, kept = g.degree_centrality(e, 2)
    assert [r["id"] for r in top.collect()] == ["hub", "a"] and rows(kept) == [("a", "hub")]


@pytest.fixture
def chain(spark, tmp_path):
    """Tables whose hub h has a chain of 14 dependents below it and one of 14 dependencies, with a cycle at the end."""
    ids = [f"r{k // 10}/f{k:02}.py::C" for k in range(29)]
    deps = {ids[k]: [ids[k + 1]] for k in range(28)} | {ids[28]: [ids[26]]}
    for k in range(4):
        ids.append(f"r9/x{k}.py::C")
        deps[ids[-1]] = [ids[14]]
    rows = [(i, i.split("::")[0], i.split("/")[0], deps[i]) for i in ids]
    c = spark.createDataFrame(rows, "id string, relative_path string, repo_name string, depends_on array<string>")
    c.write.parquet(str(tmp_path / "components.parquet"))
    return str(tmp_path), [(a, b) for a, bs in deps.items() for b in bs]


def reach(pairs, starts, most):
    depth = dict.fromkeys(starts, 0)
    level = set(starts)
    for k in range(1, most + 1):
        level = {b for a, b in pairs if a in level} - set(depth)
        depth |= dict.fromkeys(level, k)
    return depth


def test_registered_depths(spark, chain):
    from loomline.plans import graphs

    d, pairs = chain
    back = [(b, a) for a, b in pairs]
    starts = [r[0] for r in graphs._starts(spark, d).collect()]
    one, two = reach(back, starts, 10), reach(pairs, starts, 10)
    both = {k: min(x[k] for x in (one, two) if k in x) for k in one.keys() | two.keys()}
    assert len(one) > len(reach(back, starts, 6))
    for name, want in (("impact_reverse", one), ("impact_forward", two), ("impact_both", both), ("impact_paths", one)):
        got = graphs.QUERIES[name](spark, d).collect()
        assert {r["id"]: r["depth"] for r in got} == want and len(got) == len(want)
    counts = {}
    for k, v in one.items():
        m = k.split("/")[0]
        counts[m] = (counts.get(m, (0, 0))[0] + 1, max(counts.get(m, (0, 0))[1], v))
    assert {r["module"]: (r["n"], r["max_depth"]) for r in graphs.QUERIES["impact_by_module"](spark, d).collect()} == counts
    top = [r[0] for r in g.high_impact(graphs._edges(spark, d), 1, 1).select("id").collect()]
    want = {k.split("::")[0] for k in reach(back, top, 10)}
    assert {r["module"] for r in graphs.affected_modules(spark, d).where("direct").collect()} == want


@pytest.mark.parametrize("compat", [False, True])
def test_registered_pagerank_converges(spark, tmp_path, compat):
    from loomline.plans import graphs

    pairs = [(f"n{k:02}", f"n{k + 1:02}") for k in range(12)] + [("n00", "n05"), ("x", "n03"), ("y", "n03")]
    ids = sorted({x for p in pairs for x in p})
    spark.createDataFrame([(i, [b for a, b in pairs if a == i]) for i in ids], "id string, depends_on array<string>").write.parquet(str(tmp_path / "components.parquet"))
    shares = [p[1] if compat else p[0] for p in pairs]
    score = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(100):
        fresh = {i: 0.15 / len(ids) + 0.85 * sum(score[a] / shares.count(a) for a, b in pairs if b == i and shares.count(a)) for i in ids}
        change = sum(abs(fresh[i] - score[i]) for i in ids)
        score = fresh
        if change < 1e-6:
            break
    got = {r["id"]: r["score"] for r in graphs.QUERIES["pagerank_compat" if compat else "pagerank"](spark, str(tmp_path)).collect()}
    assert got.keys() == score.keys() and all(abs(got[i] - score[i]) < 1e-8 for i in ids)
