"""Search, links and snippets on small pages."""

from pyspark.sql import functions as F

from loomline.operators import links, retrieval


def pages(spark, items):
    return spark.createDataFrame(items, "doc_key string, text string").withColumn("source", F.lit("doc")).withColumn("title", F.lit(None).cast("string"))


M1 = [("d1", "alpha beta"), ("d2", "alpha alpha gamma"), ("d3", "delta epsilon")]


def scores(df):
    return {r["doc_key"]: round(r["score"], 4) for r in df.collect()}


def test_bm25(spark):
    p = pages(spark, M1)
    posts, lengths = retrieval.postings(p), retrieval.doc_lengths(p)
    want = {"alpha": {"d1": 0.5023, "d2": 0.6150}, "alpha alpha": {"d1": 1.0046, "d2": 1.2299}, "gamma": {"d2": 0.8691}, "alpha delta": {"d1": 0.5023, "d2": 0.6150, "d3": 1.0482}, "zzz": {}}
    for query, answer in want.items():
        terms = retrieval.query_terms(query, spark=spark)
        assert scores(retrieval.bm25(posts, lengths, terms)) == answer
        assert scores(retrieval.scan_search(p, terms)) == answer
    assert scores(retrieval.bm25(posts, lengths, retrieval.query_terms("alpha", spark=spark), keep=p.where("doc_key = 'd1'"))) == {"d1": 0.5023}
    none = pages(spark, [])
    assert scores(retrieval.scan_search(none, retrieval.query_terms("alpha", spark=spark))) == {}


def test_term_counts_sum_to_lengths(spark, rows):
    p = pages(spark, [*M1, ("d4", None), ("d5", "")])
    total = retrieval.postings(p).groupBy("doc_key").agg(F.sum("tf").alias("n"))
    joined = retrieval.doc_lengths(p).join(total, "doc_key", "left").where(F.col("doc_len") != F.coalesce("n", F.lit(0)))
    assert joined.count() == 0


def test_upsert_of_documents(spark, rows):
    p = pages(spark, M1)
    posts, lengths = retrieval.upsert_documents(retrieval.postings(p), retrieval.doc_lengths(p), pages(spark, [("d1", "zeta zeta")]), pages(spark, [("d3", "")]))
    assert rows(posts, "doc_key", "token", "tf") == [("d1", "zeta", 2), ("d2", "alpha", 2), ("d2", "gamma", 1)]
    assert rows(lengths) == [("d1", 2), ("d2", 3)]


def test_keyword_score(spark):
    df = spark.createDataFrame([("redis pool timeout\nredis again",), (None,)], "text string")
    got = [r[0] for r in df.select(retrieval.keyword_score("text", ["redis", "timeout", "kafka"])).collect()]
    assert abs(got[0] - 0.59) < 1e-9 and got[1] == 0.0


def test_expansion_of_queries(spark, rows):
    syn = spark.createDataFrame([("g", "Cache"), ("g", "stored value"), ("h", "queue")], "group_id string, member string")
    assert rows(retrieval.query_terms("cache cache", ["Extra"], syn, spark)) == [("cache", 2), ("extra", 1), ("stored", 1), ("value", 1)]


def test_sections_and_snippets(spark):
    text = "# A\nx\n## Design notes\nbody\n### sub\nmore\n## Next\nend"
    df = spark.createDataFrame([(text,), ("none",)], "text string")
    got = [r[0] for r in df.select(retrieval.section("text", "design")).collect()]
    assert got == ["## Design notes\nbody\n### sub\nmore", None]
    from loomline.functions.text import snippet

    assert df.select(snippet("text", F.array(F.lit("body")))).first()[0] == "## Design notes\nbody\n### sub\nmore"


def test_post_processing(spark, rows):
    scored = spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", 0.8)], "doc_key string, score double")
    p = spark.createDataFrame([("a", None, "b", None), ("b", "candidate", None, ["human:x"]), ("c", "rejected", None, ["bot"])], "doc_key string, status string, superseded_by string, verified_by array<string>")
    got = retrieval.post_process(scored, p, 5)
    assert [tuple(r) for r in got.collect()] == [("b", 0.9, "draft", "[unconfirmed]", "human-reviewed"), ("a", 0.5, "stable", "", "unverified")]


WIKI = [
    ("wiki/modules/alpha.md", "# Alpha\n[[Beta]] and [[Beta|again]] [g](./gamma.md) [x](../none.md) [[Alpha]]"), ("wiki/modules/beta.md", "# Beta\n[a](alpha.md#part)"),
    ("wiki/modules/gamma.md", "# Gamma"), ("top.md", "# Top\n[r](modules/beta.md) [[No Such]]"),
]


def test_link_graph(spark, rows):
    p = pages(spark, WIKI)
    a, b, c, t = (k for k, _ in WIKI)
    graph = links.link_graph(p)
    assert rows(graph) == sorted([(a, b, "wikilink"), (a, c, "markdown"), (b, a, "markdown"), (t, b, "markdown")])
    assert rows(links.broken_links(p)) == [("top.md", "No Such", "wikilink"), (a, "../none.md", "markdown")]
    assert (a, b, "both") in rows(links.related_pages(graph))
    seeds = spark.createDataFrame([(t, 1.0)], "doc_key string, score double")
    assert rows(links.expand(graph, seeds, 3)) == sorted([(b, 0.5, 1, t), (a, 0.25, 2, b), (c, 0.125, 3, a)])
