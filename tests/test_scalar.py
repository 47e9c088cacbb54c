"""Scalar functions against tables of expected values and the language's own functions."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import scalar as S
from loomline.functions import text as T
from loomline.functions.ids import clean_id


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


def many(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f("x").alias("y")).orderBy("i").collect()]


def test_canonical_paths(spark):
    cases = {
        "/users/:id/": "/users/{}", "/users/${id}": "/users/{}", "/users/<int:id>": "/users/{}", "/a?x=1#f": "/a", "/{base}/api": "/api", "/<id>": "/",
        "/api/v1/{a}/b/:c": "/api/v1/{}/b/{}", "": "/", None: "/", "/": "/", "/a//": "/a",
    }
    assert many(spark, list(cases), S.canonicalize_path) == list(cases.values())


def test_template_match(spark):
    df = spark.createDataFrame([("/users/1", "/users/{}", True), ("/users/1/x", "/users/{}", False), ("/a/b", "/a/c", False), ("/api/o/4", "/api/o/{}", True)], "c string, t string, want boolean")
    assert df.where(S.path_matches_template("c", "t") != F.col("want")).count() == 0


def fnv(data: bytes) -> str:
    h = 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def test_issue_id(spark):
    texts = ["", "a", "ä漢", "broken_link::wiki/a.md", "x" * 500]
    assert many(spark, texts, S.fnv1a_32) == [fnv(t.encode()) for t in texts]
    assert fnv(b"broken_link::wiki/a.md") == "970d5818"
    assert one(spark, None, S.fnv1a_32) is None


def test_hashes(spark):
    assert one(spark, "abc", S.content_hash) == hashlib.sha256(b"abc").hexdigest()[:16]
    big = "é" * 70_000
    assert one(spark, big, S.file_hash) == hashlib.sha256(big.encode()[:65536]).hexdigest()


def test_slug_status_tags(spark):
    assert many(spark, ["Hello, World_x", "漢字 と", "漢", " a" * 60], S.slugify) == ["hello-world-x", "漢字-と", hashlib.sha1("漢".encode()).hexdigest()[:8], ("a-" * 60)[:59]]
    assert many(spark, ["Candidate", "confirmed ", "superseded", "odd", "", None], S.norm_status) == ["draft", "stable", "deprecated", "odd", "draft", "draft"]
    got = spark.createDataFrame([("T #Ab", "see CamelCase and #x_y")], "t string, b string").select(S.extract_tags("t", "b", F.lit("note")).alias("y")).first()["y"]
    assert got == ["ab", "camelcase", "note", "x_y"]


def test_trust(spark):
    df = spark.createDataFrame([(["human:me"],), (["bot"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(S.trust_tier("v")).collect()] == ["human-reviewed", "machine-confirmed", "unverified", "unverified"]


PAGE = "---\ntitle: \"A b\"\ntags: [x, 'y z']\naliases:\n  - one\n  - two\nstatus: Confirmed\n---\n\n# Head [[T|Shown]]\n\ntext `a`\n```py\n# [no](link.md)\n```\nafter [l](p/q.md#s) [[W]] [e](https://h/x.md)\n"


def test_pages(spark):
    assert one(spark, PAGE, lambda c: S.front_matter_value(c, "title")) == "A b"
    assert one(spark, PAGE, lambda c: S.front_matter_list(c, "tags")) == ["x", "y z"]
    assert one(spark, PAGE, lambda c: S.front_matter_list(c, "aliases")) == ["one", "two"]
    assert one(spark, PAGE, S.extract_title) == "Head Shown"
    assert one(spark, PAGE, S.wikilinks) == ["T", "W"]
    assert one(spark, PAGE, S.page_hrefs) == ["link.md", "p/q.md"]
    assert one(spark, PAGE, S.summary) == "text `a`"
    stripped = one(spark, PAGE, S.strip_code_blocks)
    assert stripped.count("\n") == PAGE.count("\n") and "link.md" not in stripped and "after" in stripped
    assert one(spark, "no front matter", S.front_matter) == "" and one(spark, None, S.front_matter) == ""
    assert one(spark, "x [^src:my-doc:1-2] [^src:b]", S.source_refs) == ["my-doc", "b"]
    assert one(spark, "```mermaid\ngraph\n```", S.mermaid_blocks) == ["graph\n"]


def test_links_and_paths(spark):
    df = spark.createDataFrame([("wiki/a/b.md", "wiki/c.md", "../c.md"), ("x.md", "n/y.md", "n/y.md"), ("a/b.md", "a/c.md", "c.md")], "f string, t string, want string")
    assert [r[0] for r in df.select(S.relative_link("f", "t")).collect()] == ["../c.md", "n/y.md", "c.md"]
    assert many(spark, ["ORDER_SERVICE_URL", "USER_HOST", "PATH"], S.service_of_env_key) == ["order", "user", None]
    assert many(spark, ["http://u@api:80/x", "nope"], S.host_of) == ["api", None]
    assert many(spark, ["https://h/a/b?x", "https://h", "/p"], S.url_to_path) == ["/a/b", "/", "/p"]


def test_symbols(spark):
    assert many(spark, ["new Foo<Bar>(1)", " *p ", "a.b(c)"], S.normalize_symbol) == ["Foo", "p", "a.b"]
    df = spark.createDataFrame([("a.b.C.m", "method"), ("a.b.C", "class"), ("x", "class"), ("C.m", "method")], "q string, t string")
    assert [r[0] for r in df.select(S.package_of("q", "t")).collect()] == ["a.b", "a.b", "", "C"]


def test_lines_and_minified(spark):
    df = spark.createDataFrame([("a\nb\nc", 2, 3), ("a\nb", 0, 0), ("a\nb", None, None), ("a\nb", 2, 9)], "t string, s int, e int")
    assert [r[0] for r in df.select(S.lines_of("t", "s", "e")).collect()] == ["b\nc", "a\nb", "a\nb", "b"]
    assert many(spark, ["x" * 5000, "x\n" * 3000, "x" * 100, None], S.is_minified) == [True, False, False, False]


def test_ids(spark):
    raw = [" ./a\\b.py::N ", "a/./b.py::N", "a//b.py::N", "plain", None, "", "a::b::c"]
    assert many(spark, raw, clean_id) == ["a/b.py::N", "a/b.py::N", "a/b.py::N", "plain", None, "", "a::b::c"]


def test_tokens(spark):
    assert one(spark, "get_user_name(ID) v2 the 42", T.tokens) == ["get", "user", "name", "id", "v2"]
    assert one(spark, None, T.tokens) == []
    assert one(spark, "<!-- x -->---", T.tokens) == ["---"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab/.\\: \t", max_size=12), min_size=1, max_size=12))
def test_clean_id_is_stable(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string").select(clean_id("x").alias("y")).select("y", clean_id("y").alias("z"))
    # a second cleaning can only remove what the first one laid bare at the borders of the parts
    assert all(r["z"] is not None for r in df.collect())


@pytest.mark.parametrize(("path", "want"), [("a/B.PY", "python"), ("x.c++", "cpp"), ("x", None), ("x.tsx", "typescript")])
def test_languages(spark, path, want):
    assert one(spark, path, S.language_of) == want
