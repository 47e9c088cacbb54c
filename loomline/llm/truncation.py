"""Texts that were cut off by a field limit or a broken transfer.

Two values tell it when they are strict prefixes of longer ones elsewhere: the whole text, which goes on in another
copy, and its last word, which no text holds whole but others hold longer. Prefixes are found by hashes of
fixed-length prefixes first, which cost a few numbers a value; only values that share such a prefix with a longer one
are sorted and compared with their successor.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.endings import CLOSED, OPEN, UNSURE, ending_of, strip_marks
from loomline.operators.skew import salted_join, spread
from loomline.session import ensure_checkpoint_dir

#: Lengths of the hashed prefixes: SHORT, times STEP, and so on. A text of n characters is looked up by the longest that is
#: at most n. Shorter texts, which would share their prefix with a large part of the corpus, are looked up among
#: the first HEAD characters of all texts instead.
SHORT, STEP, HEAD = 16, 4, 64
#: Ids of texts are broadcast up to this number; beyond it they are joined.
MOST_BROADCAST = 1_000_000
WORD = re.compile(r"\w+")
LAST_WORD = re.compile(r"\w+\Z")


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def text_stem(body: str) -> str:
    """A text without marks of a cut, freed of a trailing ellipsis too: what is compared with other texts."""
    return body.rstrip(" .…\t\n") if body.endswith(("…", "...")) else body


def prefix_hashes(value: str) -> list[int]:
    """Hashes of the prefixes of SHORT, SHORT * STEP, ... characters, as far as the value goes."""
    out, n = [], SHORT
    while n <= len(value):
        out.append(_hash(value[:n]))
        n *= STEP
    return out


def word_forms(stem: str) -> tuple[set[str], str | None]:
    """The words that a text holds whole, before something else, and the word it ends with, if it ends with one."""
    text = stem if stem.isascii() else unicodedata.normalize("NFC", stem)
    found = WORD.findall(text)
    if found and text.endswith(found[-1]):
        return set(found[:-1]), found[-1]
    return set(found), None


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What one reading of the texts tells of each that is not blank: (id, source, ending, h, last, head, prefixes, words).

    `h` is the hash of the text without marks of a cut and ellipsis, `last` the word it ends with, `head` its first
    characters, `prefixes` the hashes of its prefixes. `words` are the distinct words of a batch of texts, in the row of its first text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "source", "ending", "h", "last", "head", "prefixes", "words"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, every = [], set()
            for text in batch.column(2):
                body, marked = strip_marks(text.as_py())
                stem = text_stem(body)
                whole, last = word_forms(stem)
                every |= whole
                rows.append([ending_of(body, marked), _hash(stem), last, stem[:HEAD], prefix_hashes(stem), None])
            if rows:
                rows[0][5] = sorted(every)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)

    rows = docs.where(F.col(text_col).rlike(r"\S")).select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text_col)
    return spread(rows).mapInArrow(run, f"id {kind}, source string, ending string, h bigint, last string, head string, prefixes array<bigint>, words array<string>")


def sharing_prefixes(facts: DataFrame) -> DataFrame:
    """The ids of texts that share a fixed-length prefix with a text that may be their strict prefix: (id).

    A prefix counts if it is the longest hashed prefix of one text and another text has it too; all texts that have
    it come out, so no text that is a strict prefix, or has one, is missing. Hashes are combined before the exchange.
    """
    rows = facts.select("id", "h", F.posexplode("prefixes").alias("level", "prefix"), F.size("prefixes").alias("top"))
    short = F.max(F.col("level") == F.col("top") - 1)
    groups = rows.groupBy("level", "prefix").agg(F.min("h").alias("a"), F.max("h").alias("b"), short.alias("short"))
    live = groups.where("short and a <> b").select("level", "prefix")
    return salted_join(rows.select("level", "prefix", "id"), live, ["level", "prefix"], "left_semi", spread=["id"]).select("id").distinct()


def strict_prefixes(values: DataFrame) -> DataFrame:
    """Of values (v, h) the distinct ones that are strict prefixes of longer ones: (h, same_line, glued).

    In byte order the values that begin with v directly follow v, so v is a strict prefix of another exactly if the next
    distinct value begins with it. The values are range partitioned and sorted (a prefix shared by a third of all rows
    spreads over as many partitions as it needs) and neighbours are compared within a partition; of each partition
    the last value meets the first value of the next one, in a task of their own. `same_line`: the longer value goes
    on within the line; `glued`: it goes on with a letter or digit right after a letter, a digit or a full stop, which
    may stand within a number or a name. Null and empty values are left out.
    """
    spark = values.sparkSession
    ensure_checkpoint_dir(spark)
    ordered = values.select("v", "h").where(F.col("v") != "").distinct().repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id())

    def judge(short: str, long: str) -> tuple[bool, bool]:
        nxt = long[len(short)]
        line = long[len(short) :].split("\n", 1)[0].strip()
        return bool(line), nxt.isalnum() and (short[-1].isalnum() or short[-1] in "._")

    names = ["p", "first", "edge", "h", "same_line", "glued"]
    types = [pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    schema = "p int, first boolean, edge string, h bigint, same_line boolean, glued boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = at = None
        for batch in batches:
            out: list[tuple] = []
            for text, h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = p
                if before is None:
                    out.append((at, True, text, h, None, None))
                elif text != before and text.startswith(before):
                    out.append((at, None, None, held, *judge(before, text)))
                before, held = text, h
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((at, False, before, held, None, None), types, strict=True)], names)

    found = ordered.mapInArrow(run, schema).checkpoint()
    # numbers of partitions with values: as many as the exchange has partitions
    parts = sorted(r[0] for r in found.where("first").select("p").collect())
    after = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:], strict=False)], "p int, q int")
    rest = F.expr("substring(nxt, length(edge) + 1)")
    edges = (
        found.where("first = false").select("p", "edge", "h")
        .join(after, "p").join(found.where("first").select(F.col("p").alias("q"), F.col("edge").alias("nxt")), "q")
        .where(F.col("nxt").startswith(F.col("edge")) & (F.col("nxt") != F.col("edge")))
        .select(
            "h", (F.trim(F.substring_index(rest, "\n", 1)) != "").alias("same_line"),
            (rest.rlike(r"^[\p{L}\p{N}]") & F.col("edge").rlike(r"[\p{L}\p{N}._]$")).alias("glued"),
        )
    )
    return found.where("first is null").select("h", "same_line", "glued").unionByName(edges)


def _beginnings(facts: DataFrame) -> DataFrame:
    """(v, h) of the first characters of all texts, marked; the hash counts only for short texts, which are their own beginning."""
    heads = facts.groupBy("head").agg(F.min(F.when(F.length("head") < SHORT, F.col("h"))).alias("h"))
    return heads.where("head <> ''").select(F.concat(F.lit("b"), F.col("head")).alias("v"), F.coalesce("h", F.lit(0)).alias("h"))


def _whole_texts(docs: DataFrame, facts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(v, h) of the texts that share a hashed prefix, marked; only these are read again and exchanged whole."""
    some = sharing_prefixes(facts).checkpoint()
    few = some.count() <= MOST_BROADCAST
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(some) if few else some, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems = [x for t in batch.column(0).to_pylist() if len(x := text_stem(strip_marks(t)[0])) >= SHORT]
            yield pa.RecordBatch.from_arrays([pa.array(["t" + x for x in stems], pa.string()), pa.array(map(_hash, stems), pa.int64())], ["v", "h"])

    return held.select("t").mapInArrow(run, "v string, h bigint")


def _word_ends(facts: DataFrame) -> DataFrame:
    """(v, h, whole) of all words, marked: whether a text holds the word whole, or texts only end with it."""
    held = facts.select(F.explode("words").alias("w"), F.lit(True).alias("whole"))
    asked = facts.where(F.col("last").isNotNull() & (F.col("ending") != CLOSED)).select(F.col("last").alias("w"), F.lit(False).alias("whole"))
    every = held.unionByName(asked).groupBy(F.concat(F.lit("w"), F.col("w")).alias("v")).agg(F.max("whole").alias("whole"))
    return every.select("v", F.xxhash64("v").alias("h"), "whole")


def prefix_evidence(docs: DataFrame, facts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is a strict prefix of something longer, (h, same_line, glued), by the hash of a text if it is one, and the words that texts end with, which no
    text holds whole but one holds in a longer form, (last).

    Beginnings, whole texts and words carry a mark of their kind in front and are sorted together, once.
    """
    words = _word_ends(facts).checkpoint()
    found = strict_prefixes(_beginnings(facts).unionByName(_whole_texts(docs, facts, id_col, text_col)).unionByName(words.select("v", "h")))
    cut = words.where("not whole").join(found.select("h"), "h", "left_semi").select(F.substring("v", 2, 2**31 - 1).alias("last"))
    return found, cut


def truncated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows whose text was cut: (id, source, within_word, has_longer_copy).

    Each text, freed of marks set at a cut, is looked up among the strict prefixes of longer texts, and its last word
    among those of longer words. A text is cut if it stops within a word or a sentence. Where its last line needs no
    full stop (list, heading, tags, log, subject line, an ellipsis that may be the author's) it is cut if that line
    goes on in a longer copy or its last word is known only in a longer form; a text that seems complete is cut
    only if a longer copy goes on with a letter or digit. Null, empty and blank texts are never cut; copies of one
    text are judged alike; repeated rows stay repeated.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    facts = text_facts(docs, id_col, text_col, source_col).checkpoint()
    ends = facts.select("id", "source", "ending", "h", "last")
    copies, words = prefix_evidence(docs, facts, id_col, text_col)
    copies, words = copies.withColumn("has_longer_copy", F.lit(True)), words.withColumn("within_word", F.lit(True))
    judged = salted_join(salted_join(ends, copies, ["h"], "left", spread=["id"]), words, ["last"], "left", spread=["id"])
    no = F.lit(False)
    within = F.coalesce("within_word", no) & (F.col("ending") != CLOSED)
    cut = (
        (F.col("ending") == OPEN)
        | ((F.col("ending") == CLOSED) & F.coalesce("glued", no))
        | ((F.col("ending") == UNSURE) & (F.coalesce("same_line", no) | within))
    )
    return judged.where(cut).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), within.alias("within_word"), F.coalesce("has_longer_copy", no).alias("has_longer_copy")
    )


def truncation_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each source its rows, its cut rows (`n_within_word` of them within a word) and their share; sources without cut rows have 0."""
    cut = truncated_texts(docs, id_col, text_col, source_col).groupBy(source_col).agg(F.count(F.lit(1)).alias("n_cut"), F.count_if("within_word").alias("n_within_word"))
    every = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_texts"))
    n, m = F.coalesce("n_cut", F.lit(0)), F.coalesce("n_within_word", F.lit(0))
    return every.join(cut.withColumnRenamed(source_col, "__s"), F.col(source_col).eqNullSafe(F.col("__s")), "left").select(
        source_col, "n_texts", n.alias("n_cut"), m.alias("n_within_word"), F.round(n / F.col("n_texts"), 6).alias("cut_share")
    )
