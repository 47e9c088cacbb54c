"""Changes, resolution, lifecycles, lint, sinks, sources and streams on small tables."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.operators import changes, lifecycle, lint, resolve, sinks, summaries
from loomline.sources import configs, files
from loomline.streaming import counters

T0 = datetime(2025, 1, 1)


def test_component_changes(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, content_hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "id string, content_hash string")
    assert rows(changes.component_changes(old, new)) == [("a", "deleted"), ("c", "modified"), ("d", "added")]
    assert rows(changes.upsert(old, new, ["id"])) == [("a", "1"), ("b", "2"), ("c", "9"), ("d", "4")]
    assert rows(changes.insert_missing(old, new, ["id"])) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]


def test_file_changes(spark, rows):
    s = "file_path string, mtime double, size bigint, content_hash string"
    old = spark.createDataFrame([("a", 1.0, 5, None), ("b", 1.0, 5, None), ("c", 1.0, 5, "x"), ("d", 1.0, 5, None)], s)
    new = spark.createDataFrame([("a", 1.5, 5, None), ("b", 9.0, 5, None), ("c", 9.0, 5, "x"), ("e", 1.0, 1, None)], s)
    assert rows(changes.file_changes(old, new)) == [("b", "changed"), ("d", "vanished"), ("e", "new")]


def test_removal_and_nesting(spark, rows):
    c = spark.createDataFrame([("1", "r\\a\\x.py"), ("2", "r/b/x.py"), ("3", "x.py")], "id string, relative_path string")
    e = spark.createDataFrame([("1", "2"), ("2", "3")], "src string, dst string")
    kept, edges = changes.remove_files(c, e, spark.createDataFrame([("a/x.py",), ("x.py",)], "file string"))
    assert rows(kept, "id") == [("2",)] and rows(edges) == []
    s = spark.createDataFrame([("a", "apps"), ("b", "apps/web"), ("c", "apps-x")], "name string, relative_path string")
    assert rows(changes.without_nested(s), "name") == [("a",), ("c",)]


def test_prefix_and_suffix_joins(spark, rows):
    s = spark.createDataFrame([("backend", "backend"), ("backend-admin", "backend-admin"), ("web", "apps/web")], "name string, relative_path string")
    f = spark.createDataFrame([("backend/x.py",), ("backend-admin/y.py",), ("apps/web/a/b.ts",), ("setup.py",)], "file string")
    assert rows(resolve.service_labels(f, s)) == sorted([("backend/x.py", "backend"), ("backend-admin/y.py", "backend-admin"), ("apps/web/a/b.ts", "web"), ("setup.py", "_root")])
    c = spark.createDataFrame([("L", "src/auth/login.py")], "id string, relative_path string")
    f = spark.createDataFrame([("src/auth/login.py",), ("auth/login.py",), ("repo/src/auth/login.py",), ("uth/login.py",)], "file string")
    assert rows(resolve.suffix_match(c, f), "file") == [("auth/login.py",), ("repo/src/auth/login.py",), ("src/auth/login.py",)]


def test_call_resolution(spark, rows):
    f = spark.createDataFrame([
        ("a.py::run", "run", "a.run", "function", "python", 1), ("b.py::go", "go", "b.go", "function", "python", 2), ("c.ts::go", "go", "c.go", "function", "typescript", 3),
        ("d.py::K.m", "K.m", "d.K.m", "method", "python", 4), ("e.py::dup", "dup", "e.dup", "function", "python", 5), ("f.py::dup", "dup", "f.dup", "function", "python", 6), ("g.ts::only", "only", "g.only", "function", "typescript", 7),
    ], "id string, name string, qualified_name string, component_type string, language string, ord bigint")
    calls = spark.createDataFrame([("a.py::run", x, i) for i, x in enumerate(["go", "K.m", "x.m", "dup", "only", "b.py::go", "nowhere"])], "caller string, callee string, ord bigint")
    got = {r["callee"]: r["target"] for r in resolve.resolve_calls(calls, f).collect()}
    assert got == {"go": "b.py::go", "K.m": "d.py::K.m", "x.m": "d.py::K.m", "dup": None, "only": None, "b.py::go": "b.py::go", "nowhere": None}
    edges = rows(resolve.call_edges(resolve.resolve_calls(calls, f), f))
    assert ("a.py::run", "e.py::dup") in edges and ("a.py::run", "g.ts::only") in edges


def test_routing_and_mentions(spark, rows):
    df = spark.createDataFrame([("UserDTO", "x/y.py", None), ("Foo", "a/utils/b.py", None), ("Foo", "a/b.py", "@Service class"), ("Foo", "a/b.py", None)], "n string, p string, s string")
    assert [r[0] for r in df.select(resolve.routing_class("n", "p", "s")).collect()] == ["boilerplate", "infra", "business", "business"]
    m = spark.createDataFrame([("order-core-api", 0), ("billing", 1), ("zzz", 2)], "module string, preorder int")
    n = spark.createDataFrame([("n1", "The core of billings"), ("n2", None)], "doc_key string, text string")
    assert rows(resolve.mentioned_modules(n, m), "module") == [("billing",), ("order-core-api",)]


def test_sessions_end_after_more_than_two_hours(spark, rows):
    ev = [(1, T0), (1, T0 + timedelta(hours=2)), (2, T0), (2, T0 + timedelta(hours=2, seconds=1)), (None, T0)]
    df = spark.createDataFrame(ev, "user_id bigint, ts timestamp")
    assert rows(lifecycle.sessions(df), "user_id", "n_events") == [(1, 2), (2, 1), (2, 1)]


def test_counters_and_issues(spark, rows):
    hits = spark.createDataFrame([("f", "q1", T0), ("f", "q2", T0 + timedelta(days=2)), ("g", "q1", T0)], "file_path string, query string, at timestamp")
    s = lifecycle.retrieval_stats(hits)
    assert rows(s, "file_path", "hit_count", "last_query") == [("f", 2, "q2"), ("g", 1, "q1")]
    assert rows(lifecycle.add_hits(s, hits), "file_path", "hit_count") == [("f", 4), ("g", 2)]
    files_ = spark.createDataFrame([("f",), ("h",)], "file_path string")
    assert rows(lifecycle.zero_hits(files_, s)) == [("h",)]
    with pytest.raises(ValueError):
        lifecycle.rank_stats(s, "rm -rf")
    flags = spark.createDataFrame([("broken_link", "wiki/a.md", "x", T0), ("broken_link", "wiki/a.md", "x", T0), ("broken_link", "wiki/a.md", "y", T0)], "issue_type string, page_path string, description string, at timestamp")
    r = lifecycle.flag_issues(flags).first()
    assert (r["issue_id"], r["occurrences"], r["descriptions"]) == ("970d5818", 3, ["x", "y"])


def test_notes_and_sources(spark, rows):
    ev = spark.createDataFrame([("n", T0, "candidate", None, None), ("n", T0 + timedelta(1), "confirmed", "human:a", None), ("m", T0, "rejected", None, "old")], "note string, at timestamp, status string, by string, reason string")
    assert rows(lifecycle.note_states(ev), "note", "status", "reason") == [("m", "deprecated", "old"), ("n", "stable", None)]
    a = spark.createDataFrame([("s1", "h", T0), ("s2", "h", T0 + timedelta(1)), ("s3", "k", T0)], "name string, content_hash string, at timestamp")
    gone = spark.createDataFrame([("s3",)], "name string")
    assert rows(lifecycle.ingest_sources(a, gone), "name", "status") == [("s1", "active"), ("s3", "retracted")]
    assert rows(lifecycle.ingest_sources(a, gone, True), "name") == [("s1",)]
    b = spark.createDataFrame([(1, "note", "t", "c"), (2, "note", None, "c"), (3, "x", "t", "c"), (4, "source", None, " "), (5, "note", "t", "c")], "item int, kind string, title string, content string")
    assert rows(lifecycle.batch_ingest(b), "item", "status") == [(1, "ingested"), (2, "failed"), (3, "failed"), (4, "failed"), (5, "repeat")]
    p = spark.createDataFrame([("notes/a.md", "body"), ("wiki/b.md", "---\ntitle: x\n---\nb"), ("c.md", "---\ntype: module\n---\n")], "doc_key string, text string")
    once = lifecycle.migrate(p, "2025-01-01")
    assert rows(once, "doc_key", "changed") == [("c.md", False), ("notes/a.md", True), ("wiki/b.md", True)]
    assert lifecycle.migrate(once, "2025-01-01").where("changed").count() == 0


CLAIMS = "a (confidence: x)\nsee [^src:d]\nb (confidence: x)\n.\n[l](u)\nc (confidence: x)\n.\n.\n[^src:z]\nd (confidence: y) [candidate] [l](u)"


def test_unsupported_claims(spark, rows):
    p = spark.createDataFrame([("p", CLAIMS), ("q", None), ("r", "x")], "doc_key string, text string")
    assert rows(summaries.unsupported_claims(p)) == [("p", 4, 2, 0.5)]


def test_lint(spark, rows):
    p = spark.createDataFrame([
        ("wiki/modules/a.md", "doc", "---\ntype: module\nstatus: odd\nstale_after: 2020-01-01\nverified:\n  by: x\n---\n# A\n[b](b.md) [c](gone.md)\n```\n[d](nope.md)\n```"),
        ("wiki/modules/b.md", "doc", "---\ntype: module\naliases: [bee]\nsuperseded_by: a\n---\n# B"), ("notes/n.md", "note", "---\nstatus: stable\ndate: 2020-01-01\ntype: pitfall\nrelated_modules: [m]\n---\n[^src:my-doc]"),
    ], "doc_key string, source string, text string").withColumn("title", F.lit(None).cast("string"))
    src = spark.createDataFrame([("my-doc", "retracted")], "name string, status string")
    w = lint.Wiki(p, sources=src, today="2025-01-01")
    got = rows(lint.lint(w), "check", "severity", "file")
    a, b = "wiki/modules/a.md", "wiki/modules/b.md"
    want = [("broken_links", "error", a), ("conformance", "warning", a), ("conformance", "warning", a), ("conformance", "warning", a), ("missing_aliases", "info", a), ("no_outlinks", "info", b), ("orphan_pages", "warning", a), ("stale_notes", "warning", "notes/n.md"), ("stale_sources", "warning", "notes/n.md"), ("superseded_pages", "info", b)]
    assert got == sorted(want)
    assert rows(lint.lint(w, floor="error"), "check") == [("broken_links",)]
    issues = spark.createDataFrame([("e",)] * 2 + [("w",)] * 3 + [("i",)] * 4, "s string").select(F.when(F.col("s") == "e", "error").when(F.col("s") == "w", "warning").otherwise("info").alias("severity"))
    assert lint.health(issues).first()["score"] == 67
    assert lint.health(spark.createDataFrame([("error",)] * 11, "severity string")).first()["score"] == 0


def test_sinks(spark, tmp_path, rows):
    c = spark.createDataFrame([("a", "A", "class", "p"), ("b", "B", "class", "p")], "id string, name string, component_type string, relative_path string")
    e = spark.createDataFrame([("a", "b"), ("a", "zzz")], "src string, dst string")
    node = json.loads(sinks.graph_json(c, e).where("id = 'a'").first()["node"])
    assert node["depends_on"] == ["b", "zzz"]
    assert rows(sinks.chart_elements(c, e).groupBy("kind").count()) == [("edge", 1), ("node", 2)]
    sinks.write_table(c, str(tmp_path / "t"), ("component_type",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert sinks.write_result(c, str(tmp_path / "r"))["rows"] == 2
    assert sinks.write_bounded_json(c, str(tmp_path / "x.json")) == 2
    with pytest.raises(ValueError):
        sinks.write_bounded_json(c, str(tmp_path / "y.json"), 1)


def test_files_and_pages(spark, tmp_path, rows):
    for name, text in {"wiki/modules/a.md": "---\ntitle: T\n---\n# A\nx<!-- crosslinks -->cut", "notes/n.md": "n", "raw/sources/s.txt": "s", "index.md": "i", "raw/other.md": "o"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    p = files.read_pages(spark, str(tmp_path))
    assert rows(p, "doc_key", "source") == [("notes/n.md", "note"), ("raw/sources/s.txt", "source"), ("wiki/modules/a.md", "doc")]
    a = p.where("source = 'doc'").first()
    assert a["text"].endswith("x") and a["fm"] == {"title": "T"} and a["title"] == "A"
    (tmp_path / "tree.json").write_text(json.dumps({"m": {"components": ["c1"], "children": {"k": {"components": [], "children": {}}}}}))
    assert rows(files.flatten_tree(spark, str(tmp_path / "tree.json")), "module", "parent", "depth", "component_id") == [("k", "m", 1, None), ("m", None, 0, "c1")]
    assert rows(files.ontology(spark, "synonyms:\n  cache: [buffer]\n")) == [("cache", "buffer"), ("cache", "cache")]


def test_selection(spark, rows):
    f = spark.createDataFrame([("a/b.py",), ("node_modules/x.js",), ("a/c.pyc",), ("src/t.ts",), ("docs/x.md",)], "relative_path string")
    assert rows(files.select_files(f, exclude=["docs/"])) == [("a/b.py",), ("src/t.ts",)]
    assert rows(files.select_files(f, include=["*.py"])) == [("a/b.py",)]
    ig = {r["relative_path"]: r["ignored"] for r in files.ignored(f, [("", "*.py"), ("", "docs/"), ("src", "*.ts"), ("src", "!t.ts")]).collect()}
    assert ig == {"a/b.py": True, "node_modules/x.js": False, "a/c.pyc": False, "src/t.ts": False, "docs/x.md": True}


def test_configs(spark, rows):
    compose = "services:\n  web:\n    build: ./web\n    ports: ['8080:80']\n    depends_on: [db]\n    environment:\n      API_URL: http://db:1\n  db:\n    image: pg\n"
    f = spark.createDataFrame([("docker-compose.yml", compose, "r"), ("bad/compose.yml", ": :\n  - [", "r"), ("api/Dockerfile", "FROM x", "r"), ("services/pay/main.py", "", "r"), (".env", "ORDER_SERVICE_URL='http://orders:1'\n# X=1\nexport A=b", "r"), ("tests/Dockerfile", "", "r")], "relative_path string, file_text string, repo_name string")
    s = configs.compose_services(f)
    assert rows(s, "name", "ports") == [("db", []), ("web", [8080])]
    assert rows(configs.compose_edges(s)) == [("web", "db")]
    assert rows(configs.detect_services(f), "name", "source") == [("api", "dockerfile"), ("pay", "convention"), ("web", "docker-compose")]
    assert rows(configs.service_urls(configs.env_entries(f)), "service", "host") == [("order", "orders")]


def test_streams(spark, tmp_path, rows):
    from pyspark.sql.types import StructType

    src = tmp_path / "in"
    src.mkdir()
    schema = "file_path string, query string, at timestamp, content_hash string, user_id bigint, ts timestamp"
    lines = [("f", "q1", T0, "h", 1, T0), ("f", "q2", T0 + timedelta(minutes=5), "h", 1, T0 + timedelta(hours=1)), ("g", "q", T0, "k", 2, T0)]
    df = spark.createDataFrame(lines, schema)
    df.write.mode("append").json(str(src))
    stream = spark.readStream.schema(df.schema if isinstance(df.schema, StructType) else schema).json(str(src))
    q = counters.hit_counters(stream).writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("hits"), "file_path", "hit_count") == [("f", 2), ("g", 1)]
    q = counters.session_stream(stream).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("sess"), "user_id", "n_events") == rows(lifecycle.sessions(df), "user_id", "n_events")
    counters.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ["file_path"], ["at"]).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "t" / "v=0"))
    assert rows(out, "file_path", "query") == [("f", "q2"), ("g", "q")]


def test_registered_lint_runs_all_checks(spark, monkeypatch):
    from loomline.plans import upkeep

    p = spark.createDataFrame([("a.md", "doc", "A", "[x](gone.md)", "2025-01-01")], "doc_key string, source string, title string, text string, updated_at string")
    e = spark.createDataFrame([("p", "q"), ("q", "p")], "src string, dst string")
    monkeypatch.setattr(upkeep, "_wiki", lambda s, d: lint.Wiki(p, edges=e))
    got = upkeep.QUERIES["lint_issues"](spark, "").collect()
    kinds = [r["check"] for r in got]
    assert kinds.count("cycles") == 1 and kinds.count("broken_links") == 1
    n = {x: sum(r["severity"] == x for r in got) for x in ("error", "warning", "info")}
    assert upkeep.QUERIES["health_score"](spark, "").first().asDict() == {
        "errors": n["error"], "warnings": n["warning"], "infos": n["info"], "score": max(0, 100 - 10 * n["error"] - 3 * n["warning"] - n["info"])
    }
    assert n["error"] > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_lookups_are_whole(spark, rows):
    from loomline.operators import retrieval
    from loomline.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    files = spark.read.parquet(f"{d}/source_files.parquet").select("relative_path", "file_path").collect()
    ids = {r[0] for r in spark.read.parquet(f"{d}/components.parquet").select("id").collect()}
    paths = {r["relative_path"] for r in files}
    assert {r[0] for r in QUERIES["components_of_files"](spark, d).collect()} == {i for i in ids if i and i.split("::")[0] in paths}
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("cast(doc_id as string) as doc_key", "case when doc_id % 10 = 0 then 'fresh words only' else text end as text", "doc_id").where("doc_id % 10 <> 1")
    terms = rows(QUERIES["index_update"](spark, d), "token", "df")
    assert terms == rows(retrieval.doc_frequencies(retrieval.postings(docs)), "token", "df") and min(n for _, n in terms) < 20
    asked = {r["file"] for r in QUERIES["suffix_matches"](spark, d).collect()}
    assert asked <= {p.split("/", 1)[-1] for p in paths} | {r["file_path"] for r in files} and any(a.startswith("/") for a in asked) and any(not a.startswith("/") for a in asked)


def test_links_out_of_the_folder_are_not_followed(spark, tmp_path, rows):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "secret.txt").write_text("s")
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a b.txt").write_text("a")
    (root / "link.txt").symlink_to(tmp_path / "out" / "secret.txt")
    (root / "own.txt").symlink_to(root / "sub" / "a b.txt")
    assert rows(files.scan_files(spark, str(root)), "relative_path", "size") == [("own.txt", 1), ("sub/a b.txt", 1)]


def test_pairs_of_characters(spark):
    from loomline.functions.text import tokens

    df = spark.createDataFrame([("函数 load_rows 先读取, 缓存 x あい",)], "t string")
    assert df.select(tokens("t", cjk=True)).first()[0] == ["函数", "load", "rows", "先读", "读取", "缓存", "あい"]
    assert df.select(tokens("t")).first()[0] == ["函数", "load", "rows", "先读取", "缓存", "あい"]


def test_mentions_look_at_whole_words(spark, rows):
    n = spark.createDataFrame([("a", "x" * 90 + "ledger"), ("b", "nothing"), ("c", None)], "doc_key string, text string")
    m = spark.createDataFrame([("Ledger", 1), ("pay-api core", 2)], "module string, preorder int")
    assert rows(resolve.mentioned_modules(n, m), "doc_key", "module") == [("a", "Ledger")]
