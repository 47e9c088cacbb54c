"""Byte-pair encoding, pieces, endings and truncation."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import bpe, truncation
from loomline.llm.endings import CLOSED, OPEN, UNSURE, classify_ending, strip_marks
from loomline.llm.pieces import LIMIT, cohesion_depths, split_oversized, split_text

VOCABULARY = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.json")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="session")
def encoders():
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(VOCABULARY)
    theirs.encode_special_tokens = True
    with open(VOCABULARY, "rb") as f:
        return bpe.BytePairEncoder(f.read()), lambda t: theirs.encode(t, add_special_tokens=False).ids


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abcde \n", max_size=120), st.text(alphabet="=-_ \t\n'", max_size=200)))
def test_bpe_equals_the_tokenizer(encoders, text):
    ours, theirs = encoders
    assert ours.encode(text) == theirs(text)
    assert ours.decode(ours.encode(text)) == text


@needs_vocabulary
def test_bpe_of_long_and_odd_texts(encoders):
    ours, theirs = encoders
    for text in ["a" * 30_000, " " * 5000 + "x", "ab" * 9000, "<|endoftext|> x", "é̀漢字😀" * 50, "\ufeff\r\n\x00"]:
        assert ours.encode(text) == theirs(text)
    assert ours.encode(None) == ours.encode("") == []


@needs_vocabulary
def test_bpe_corpus(spark, rows, encoders):
    df = spark.createDataFrame([(1, "one", "x"), (1, "one", "x"), (2, None, "x"), (3, "", None), (None, "two words", None)], "doc_id bigint, text string, ids string")
    got = rows(bpe.encode_corpus(df))
    assert got == sorted([(1, encoders[0].encode("one"))] * 2 + [(2, []), (3, []), (None, encoders[0].encode("two words"))], key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert bpe.encode_corpus(df.where("false")).count() == 0


def check_pieces(text: str, limit: int, overlap: int) -> None:
    lines = text.split("\n")
    pieces = split_text(text, limit, overlap)
    fresh: list[int] = []
    for k, p in enumerate(pieces):
        body = "\n".join(lines[p.first : p.last + 1])
        if len(lines[p.first]) > limit:
            assert p.first == p.last
            fresh += [p.first] if not p.part else []
            continue
        assert len(body) <= limit
        before = pieces[k - 1].last if k else -1
        assert p.first <= before + 1 and before - p.first < overlap
        new = range(before + 1, p.last + 1)
        assert len(new) > 0
        fresh += new
        if p.last < len(lines) - 1:
            blank = [j for j in new if not lines[j].strip() and any(lines[i].strip() for i in range(before + 1, j))]
            room = len(body) + 1 + len(lines[p.last + 1]) <= limit
            assert (p.last in blank) or not room
    assert fresh == list(range(len(lines)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=14), min_size=1, max_size=40), st.integers(3, 30), st.integers(0, 3))
def test_pieces_cover_every_line_once(lines, limit, overlap):
    check_pieces("\n".join(lines), limit, overlap)


def test_pieces_by_hand():
    assert [tuple(p) for p in split_text("aaaa\n\nbbbb\ncccc\ndddd", 11)] == [(0, 1, 0), (0, 2, 0), (1, 3, 0), (3, 4, 0)]
    assert [tuple(p) for p in split_text("x" * 25, 10)] == [(0, 0, 0), (0, 0, 1), (0, 0, 2)]
    assert [tuple(p) for p in split_text("a\n" + "x" * 15 + "\nb", 10)] == [(0, 0, 0), (1, 1, 0), (1, 1, 1), (2, 2, 0)]


def test_pieces_of_components(spark, rows):
    long = "\n".join(f"line {i} " + "y" * 40 for i in range(60))
    df = spark.createDataFrame([("a", long, 10, "clash"), ("a", long, 10, "clash"), ("b", "short", 1, None), ("c", None, 1, None), ("d", "é" * (LIMIT + 1), None, None), ("e", "z" * LIMIT, 0, None)], "id string, source_code string, start_line int, piece_no string")
    got = rows(split_oversized(df))
    assert [r for r in got if r[0] == "d"] == [("d", 1, 1, 1), ("d", 2, 1, 1)]
    a = [r for r in got if r[0] == "a"]
    assert a[0][2] == 10 and max(r[3] for r in a) == 69 and {r[0] for r in got} == {"a", "d"}
    text = split_oversized(df, with_text=True).where("id = 'a'").collect()
    assert all(len(r["piece_text"]) <= LIMIT for r in text)


def test_cohesion_finds_the_change_of_topic():
    lines = ["cat dog bird fish"] * 10 + ["stone iron gold lead"] * 10
    depths = cohesion_depths(lines)
    assert depths.index(max(depths)) == 9
    rng = random.Random(1)
    text = "\n".join(" ".join(rng.choice("abcdefgh") * 3 for _ in range(6)) for _ in range(80))
    pieces = split_text(text, 400, 2, "cohesion")
    assert pieces[-1].last == 79 and all(p.first <= q.last + 1 for q, p in zip(pieces, pieces[1:], strict=False))


@pytest.mark.parametrize(("text", "want"), [
    (None, CLOSED), ("  \n", CLOSED), ("All done.", CLOSED), ("完成了。", CLOSED), ("It said \"no.\"", CLOSED), ("The first one. The secon", OPEN), ("First line.\nA second that st", OPEN),
    ("One. Two of the [...]", OPEN), ("One two. (cut)", CLOSED), ("Broken cha\ufffd", OPEN), ("Done.\n\n- one `a`\n- two `b`", UNSURE), ("Done.\n\n- one `a`\n- two `b", OPEN), ("Done.\n\n- one `a`\n- tw", OPEN),
    ("| a | b |\n| - | - |\n| 1 | 2 |", CLOSED), ("| a | b |\n| - | - |\n| 1 |", OPEN), ("x.\n\n```py\na = 1\n```", CLOSED), ("x.\n\n```py\na = 1", OPEN), ("Text.\n\n## Next", UNSURE), ("Text.\n\ntags: #a #b", UNSURE),
    ("Text.\n\n[A](b/c.md)", CLOSED), ("fix: the thing", UNSURE), ("Said it. We will see…", UNSURE), ("Said it.…", CLOSED), ("x\n| 2025-01-01T00:00:00 | a | b |", UNSURE),
])
def test_endings(text, want):
    assert classify_ending(text) == want


def test_marks():
    assert strip_marks("abc [truncated] ") == ("abc", True) and strip_marks("abc") == ("abc", False) and strip_marks("[...]") == ("", True)
    assert strip_marks("abc [...] [truncated]\u3000\n") == strip_marks("abc--- cut ---") == strip_marks("abc <!-- snip -->") == strip_marks("abc  (Text was cut off…)") == ("abc", True)
    assert strip_marks("a - b") == ("a - b", False) and strip_marks("list [x]") == ("list [x]", False) and strip_marks("x]\x85\x1f") == ("x]", False)
    assert strip_marks("a" + " " * 50_000 + "b" + "-" * 50_000 + " [cut]")[1]
    assert truncation.text_stem("abc…") == truncation.text_stem("abc ...") == "abc" and truncation.text_stem("a b.") == "a b."
    assert truncation.prefix_hashes("abcd" * 20) == [truncation._hash("abcd" * 4), truncation._hash("abcd" * 16)] and truncation.prefix_hashes("abcd") == []
    assert truncation.word_forms("ab, cd ab") == ({"ab", "cd"}, "ab") and truncation.word_forms("ab.") == ({"ab"}, None) and truncation.word_forms("") == (set(), None)


def test_truncated_texts(spark, rows):
    full = "A whole text. It has a second sentence.\n\n## Heading of it\n\nAnd more of it."
    docs = [
        (1, full, "s"), (2, full[:20], "s"), (3, full[: full.index("ing of")], "s"), (4, full[: full.index("\n\nAnd")], "s"), (5, full[:13], "t"), (6, None, "t"), (7, " ", "t"), (8, "", None), (9, full[:20] + " [...]", "t"),
        (10, "It rose by 3.", "u"), (11, "It rose by 3.5 percent.", "u"), (2, full[:20], "s"), (12, full[:33] + "…", "v"), (13, "We leave it there…", "v"), (14, "fix: join the sen", "w"), (15, "fix: join the text", "w"), (16, "所有检查都已完成。第二部分还没", "w"), (17, "[...]", "w"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 as body", "2 as h", "3 as stem", "4 as last")
    got = rows(truncation.truncated_texts(df), "doc_id", "within_word", "has_longer_copy")
    want = [(2, False, True), (2, False, True), (3, True, True), (9, False, True), (10, False, True), (12, True, True), (14, True, False), (16, False, False)]
    assert got == sorted(want, key=lambda r: tuple((True, str(x)) for x in r))
    rates = {r["source"]: (r["n_texts"], r["n_cut"], r["n_within_word"]) for r in truncation.truncation_rates(df).collect()}
    assert rates == {"s": (5, 3, 1), "t": (4, 1, 0), "u": (2, 1, 0), "v": (2, 1, 1), "w": (4, 2, 1), None: (1, 0, 0)}
    assert truncation.truncated_texts(df.where("false")).count() == 0


def test_longer_copies_by_brute_force(spark, rows):
    rng = random.Random(8)
    base = ["".join(rng.choice("ab c\n") for _ in range(rng.randrange(1, 300))).strip() or "x" for _ in range(40)]
    texts = list({t[: rng.randrange(1, len(t) + 1)].rstrip() for t in base for _ in range(6)} | set(base))
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    facts = truncation.text_facts(docs).checkpoint()
    got = {r["h"] for r in truncation.prefix_evidence(docs, facts)[0].collect()} & {truncation._hash(t) for t in texts}
    assert got == {truncation._hash(t) for t in texts if t and any(o != t and o.startswith(t) for o in texts)} and len(got) > 50


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab\n", min_size=1, max_size=6), min_size=1, max_size=30))
def test_strict_prefixes_by_brute_force(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("h", F.xxhash64("v"))
    got = {r["v"] for r in df.join(truncation.strict_prefixes(df), "h").collect()}
    assert got == {v for v in values if any(o != v and o.startswith(v) for o in values)}


def test_cohesion_finds_the_borders_of_topics():
    """Texts of several topics on one vocabulary each: how many borders the deepest valleys hit within two lines, against cuts where a piece is full."""
    rng = random.Random(2)

    def hits(boundary):
        found = n = 0
        r = random.Random(5)
        for _ in range(60):
            topics = [[f"t{t}w{k}" for k in range(12)] for t in range(4)]
            lines, borders = [], []
            for t in topics:
                lines += [" ".join(r.choice(t) for _ in range(6)) for _ in range(r.randrange(16, 26))]
                borders.append(len(lines) - 1)
            cuts = [p.last for p in split_text("\n".join(lines), 1000, 0, boundary)]
            n += len(borders) - 1
            found += sum(any(abs(c - b) <= 2 for c in cuts) for b in borders[:-1])
        return found / n

    assert rng and hits("cohesion") >= 0.9 and hits("full") <= 0.5
