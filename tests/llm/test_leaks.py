"""Leaked passages against brute force."""

import random
from collections import Counter

import numpy as np

from loomline.llm import leaks
from loomline.llm.words import words


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return sorted({(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())})


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary[:120]) for _ in range(rng.randrange(10, 40)))) for i in range(25)]
    docs = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            src = words(rng.choice(items)[1])
            n = rng.choice([8, 11, 12, 13, 20])
            k = rng.randrange(0, max(1, len(src) - n))
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = [x.upper() for x in src[k : k + n]]
        docs.append((d, rng.choice([" ", " - ", "\n"]).join(w)))
    return docs, items


def test_leaks_by_brute_force(spark, rows):
    docs, items = corpus()
    docs += [(500, None), (501, ""), (0, docs[0][1]), (502, words(items[0][1])[0] * 3)]
    items += [(90, None), (91, "too short"), (92, items[3][1]), (3, items[3][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    got = sorted(tuple(r) for r in leaks.leaked_passages(d, i).collect())
    assert got == brute(docs, items) and len(got) > 10
    assert leaks.leaked_passages(d.where("false"), i).count() == 0
    assert leaks.leaked_passages(d, i.where("false")).count() == 0
    blocks = leaks.leaked_passages(d, i, item_chars=500)
    assert sorted(tuple(r) for r in blocks.collect()) == got and len(list(leaks.item_blocks(i, "item_id", "text", 500))) > 3
    for n in (5, 9):
        assert sorted(tuple(r) for r in leaks.leaked_passages(d, i, min_run=n).collect()) == brute(docs, items, n)


def test_unicode_forms():
    assert words("Ｆｕｌｌ e\u0301té\u00adx STRASSE_ß") == ["full", "étéx", "strasse", "ss"]
    assert words(None) == [] and words("-- _ --") == []


def test_stretches(spark):
    docs = [(1, "a b c x a b c d e"), (2, "x y"), (3, None), (4, ""), (5, "e d c b a"), (5, "a b")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    voc = {w: k for k, w in enumerate("abcde")}
    got = leaks.known_stretches(d, "doc_id", "text", voc, [(3, 3)], 2, 1)
    assert sorted((r["id"], list(r["ids"])) for r in got.where("ids is not null").collect()) == [(1, [0, 1, 2]), (1, [0, 1, 2, 3, 4]), (5, [4, 3, 2, 1, 0])]
    # windows of four words with three known ones also cover the word between
    got = leaks.known_stretches(d, "doc_id", "text", voc, [(4, 3)], 2, 1)
    assert (1, [0, 1, 2, 5, 0, 1, 2, 3, 4]) in [(r["id"], list(r["ids"])) for r in got.where("ids is not null").collect()]
    counts = Counter()
    for r in got.where("terms is not null").collect():
        counts.update(dict(zip(r["terms"], r["counts"], strict=True)))
    assert counts == {0: 5, 1: 7, 2: 6, 3: 4, 4: 2, 5: 14}


def test_space_spans_the_leading_directions(spark):
    docs, items = corpus(3)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    held = leaks.load_items(next(leaks.item_blocks(spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")), 12)
    v = len(held.vocabulary)
    stretches = leaks.known_stretches(d, "doc_id", "text", held.vocabulary, [(8, 5)], leaks.WIDTH, leaks.STRIDE)
    space = leaks.fit_space(stretches, v, rank=10)
    a = []
    unknown = np.log(sum(max(0, (len(words(t)) - leaks.WIDTH) // leaks.STRIDE + 1) for _, t in docs) + 1) + 1
    for r in stretches.where("ids is not null").collect():
        w = r["ids"]
        for k in range(0, len(w) - leaks.WIDTH + 1, leaks.STRIDE):
            row = np.zeros(v + 1)
            for x in w[k : k + leaks.WIDTH]:
                row[x] += 1
            n = np.sqrt(sum(space.idf[x] ** 2 if x < v else unknown**2 for x in w[k : k + leaks.WIDTH]))
            a.append(row[:v] * space.idf / n)
    exact = np.linalg.svd(np.array(a), compute_uv=False)[:10]
    assert np.all(np.abs(space.singular - exact) / exact < 0.25) and space.singular[0] > 0.9 * exact[0]


def test_sequences():
    assert leaks.longest_run("a b c d".split(), "x b c y d".split()) == 2
    assert leaks.common_subsequence("a b c d".split(), "x b c y d".split()) == 3


def test_paraphrases(spark, rows):
    item = "The night scheduler inflates the oldest parent checkpoint after 804 failed probes today."
    docs = [(1, "Intro words. The night scheduler then inflates the oldest parent checkpoint after some 804 failed probes today. End."), (2, "The night scheduler inflates the oldest parent checkpoint after 9 failed probes today."), (3, "Nothing of that kind stands here in this sentence at all."), (4, None)]
    d = spark.createDataFrame(docs * 2, "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item), (8, None)], "item_id bigint, text string")
    got = rows(leaks.paraphrased_items(d, i), "doc_id", "item_id", "answer_kept")
    assert got == [(1, 7, True), (2, 7, False)]


def test_paraphrases_across_lines_and_marks(spark):
    said = "The quota daemon forgets a half-written segment only during the 31 second grace period so that a reader cannot observe a torn write"
    w = said.split()
    rng = random.Random(5)
    around = [" ".join(f"f{rng.randrange(500)}" for _ in range(60)) for _ in range(8)]
    reworded = " ".join(x for k, x in enumerate(w) if k % 6 != 3)
    wrapped = [" ".join(w[k : k + 5]) for k in range(0, len(w), 5)]
    docs = [
        (1, "\n".join(wrapped) + "."),
        (2, "\n> ".join([around[0], *wrapped, around[1]])),
        (3, f"{around[2]} {said} {around[3]}"),
        (4, f"{around[4]} {reworded.replace('31', '32')} {around[5]}"),
        (5, f"{around[6]} {' '.join(w[:12])} {around[7]}"),
        (6, "We paid 3.5 percent. What\nhappens next? Nobody knows."),
        (7, "What really happens then? 3.5 or so."),
        (8, None),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(70, said + "."), (71, "What happens next?"), (72, "We paid 3.5\npercent.")], "item_id bigint, text string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in leaks.paraphrased_items(d, i).collect()}
    assert set(got) == {(1, 70), (2, 70), (3, 70), (4, 70), (6, 71), (6, 72)}
    assert got[2, 70] == got[3, 70] == (1.0, True) and not got[4, 70][1]


def test_subsequence_by_bits():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert leaks.subsequence_counter(a)(b) == leaks.common_subsequence(a, b)


def test_recall_of_rewordings(spark):
    """Planted rewordings of item sentences among other text, against a search without the latent candidates."""
    rng = random.Random(11)
    words_ = [f"w{k}" for k in range(400)]
    sentence = lambda n: [rng.choice(words_) for _ in range(n)]
    items = [(k, " ".join(sentence(rng.randrange(9, 26))) + ".") for k in range(40)]
    docs, planted = [], set()
    for d in range(120):
        k, said = rng.choice(items)
        w = said[:-1].split()
        for _ in range(max(1, len(w) // 7)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], ["some", w[at]]])
        docs.append((d, " ".join([*sentence(rng.randrange(40)), *w, *sentence(rng.randrange(40))])))
        planted.add((d, k))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r[0], r[1]) for r in leaks.paraphrased_items(d, i).collect()}
    every = {(r[0], r[1]) for r in leaks.paraphrased_items(d, i, cosine=-1.0).collect()}
    assert got <= every and planted <= every
    assert len(got & planted) >= 0.95 * len(planted) and len(got) >= 0.95 * len(every)
