"""Orphan references and snapshot changes: small cases and brute force."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from loomline.operators.orphans import orphan_component_references, orphan_references
from loomline.operators.skew import Probe, hot_keys, salted_join
from loomline.operators.snapshots import snapshot_changes

T = [datetime(2025, m, 1) for m in range(1, 13)]
DEP = "source_id string, target_id string, recorded_at timestamp, loaded_at timestamp, id string"
COMP = "id string, depends_on array<string>, analyzed_at timestamp, first_seen_at timestamp, deleted_at timestamp, path string, name string"
CALL = "caller string, callee string, is_resolved boolean, recorded_at timestamp"


def tables(spark, dep=(), comp=(), call=()):
    return spark.createDataFrame(list(dep), DEP), spark.createDataFrame(list(comp), COMP), spark.createDataFrame(list(call), CALL)


def test_orphans(spark, rows):
    comp = [
        ("a.py::A", ["b.py::B", None, " ", "gone"], T[5], T[0], None, None, None),
        ("a.py::A", ["b.py::B", None, " ", "gone"], T[5], T[0], None, None, None),
        ("b.py::B", None, T[5], T[3], T[8], None, None),
    ]
    dep = [
        ("x", ".\\b.py::B", T[4], T[4], "clash"), ("x", "b.py::B", T[8], T[9], "clash"), ("x", "b.py::B", T[2], T[2], None), ("x", "B.py::B", T[4], T[4], None),
        ("x", None, T[4], T[4], None), ("x", " ", T[4], T[4], None), ("x", "zzz", None, None, None), ("x", "b.py::B", None, None, None),
    ]
    call = [("c", "re.sub", True, T[1]), ("c", "re.sub", False, T[1]), ("c", "re.sub", None, T[1]), ("c", "a.py::A", True, T[1])]
    assert rows(orphan_component_references(*tables(spark, dep, comp, call))) == sorted([
        ("calls", "2025-02", "c", "re.sub", "missing"), ("components", "2025-06", "a.py::A", "gone", "missing"), ("dependencies", None, "x", "zzz", "missing"),
        ("dependencies", "2025-03", "x", "b.py::B", "late"), ("dependencies", "2025-05", "x", "B.py::B", "missing"), ("dependencies", "2025-09", "x", "b.py::B", "deleted"),
    ], key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_orphans_of_empty_tables(spark, rows):
    assert rows(orphan_component_references(*tables(spark))) == []
    assert len(rows(orphan_component_references(*tables(spark, [("x", "y", T[0], T[0], None)])))) == 1


def test_match_semantics(spark, rows):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, None), (4, "q", None), (5, "a", "z"), (6, None, "x"), (6, None, "x")], "i int, k string, l string")
    recs = spark.createDataFrame([("a", "x"), ("b", None)], "p string, q string")
    keys = {"k": "p", "l": "q"}
    got = {m: [r[0] for r in rows(orphan_references(refs, recs, keys, m), "i")] for m in ("simple", "full", "partial")}
    assert got == {"simple": [5], "full": [2, 4, 5, 6, 6], "partial": [4, 5]}


def test_hot_keys_are_salted(spark, rows):
    probe = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), F.col("id").alias("v"))
    build = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert rows(salted_join(probe, build, ["k"], how, rows=100)) == rows(salted_join(probe, build, ["k"], how)) == rows(probe.join(build, ["k"], how))
    assert rows(hot_keys(probe, ["k"], rows=100)) == [("hot", 17)] and rows(hot_keys(probe, ["k"])) == []
    for n in (100, 5000):
        assert rows(Probe(probe, "k", n).join(build)) == rows(probe.join(build, ["k"]))


RUNS = "run_id int, repo_name string, snapshot_no int, taken_at timestamp, delivered_at timestamp, run_state string, agent string"
SNAP = "run_id int, repo_name string, id string, content_hash string, start_line int, end_line int, ord bigint"


def test_snapshots(spark, rows):
    h = "0123456789abcdef"
    runs = [(1, "r", 1, T[0], T[0], "complete", "a"), (2, "r", 2, T[1], T[1], "aborted", "a"), (3, "r", 3, T[2], T[2], "complete", "a"), (4, "r", 3, T[2], T[3], "complete", "a"), (5, "r", 4, T[4], T[4], "complete", "a"), (9, "s", 1, T[0], T[0], "complete", "a"), (10, "s", 2, T[1], T[1], "complete", "a")]
    snaps = [
        (1, "r", "p/a::A", h, 1, 2, 1), (1, "r", "p/b::B", h, 1, 2, 2), (1, "r", "p/c::C", None, 1, 2, 3), (2, "r", "p/z::Z", h, 1, 2, 4), (3, "r", "p/y::Y", h, 1, 2, 5),
        (4, "r", "p\\a::A", (h + "f" * 48).upper(), 5, 6, 6), (4, "r", "p/b::B", "x" * 16, 1, 2, 7), (4, "r", "p/b::B", h, 1, 2, 1), (4, "r", "p/c::C", h, 1, 2, 8), (4, "r", None, h, 1, 2, 9),
        (5, "r", "./p/b::B", "X" * 16, 1, 2, 10), (5, "r", "p/c::C", "", 1, 2, 11), (9, "s", "q::Q", h, 1, 2, 12),
    ]
    got = rows(snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(runs + runs[:1], RUNS)))
    assert got == [("r", 3, "p/b::B", "changed"), ("r", 4, "p/a::A", "removed"), ("s", 2, "q::Q", "removed")]
    assert rows(snapshot_changes(spark.createDataFrame([], SNAP), spark.createDataFrame(runs, RUNS))) == []
    # full hashes are compared whole, a short one with the beginning of a full one
    full = [(1, "r", "a::A", h + "0" * 48, 1, 2, 1), (4, "r", "a::A", h + "1" * 48, 1, 2, 2), (5, "r", "a::A", h, 1, 2, 3)]
    assert rows(snapshot_changes(spark.createDataFrame(full, SNAP), spark.createDataFrame(runs[:5], RUNS))) == [("r", 3, "a::A", "changed")]


def test_snapshots_by_brute_force(spark, rows):
    rng = random.Random(5)
    runs, snaps, valid = [], [], {}
    for n in range(1, 9):
        for k in range(rng.choice([1, 2])):
            run = n * 10 + k
            state = rng.choice(["complete", "complete", "aborted"])
            runs.append((run, "r", n, T[0], datetime(2025, 1, 1 + k, n), state, "a"))
            content = {}
            for _ in range(30):
                i, h = f"f::{rng.randrange(12)}", rng.choice(["a" * 16, "b" * 16, "A" * 64, None, ""])
                o = len(snaps)
                snaps.append((run, "r", i, h, 0, 0, o))
                content[i] = h
            if state == "complete":
                valid[n] = content
    want, order = [], sorted(valid)
    for a, b in zip(order, order[1:], strict=False):
        x, y = valid[a], valid[b]
        want += [("r", b, i, "added") for i in y.keys() - x.keys()] + [("r", b, i, "removed") for i in x.keys() - y.keys()]
        want += [("r", b, i, "changed") for i in x.keys() & y.keys() if x[i] and y[i] and x[i].lower()[:16] != y[i].lower()[:16]]
    assert rows(snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(runs, RUNS))) == sorted(want, key=lambda r: tuple((True, str(x)) for x in r))
