"""Evaluation passages inside a corpus, by latent semantic retrieval.

The texts are read and cut into words once. What goes on are stretches: runs of at least MIN_RUN words that all occur in
the items, as numbers; no other place of a document can hold MIN_RUN consecutive words of an item. Passages are
short word windows; the latent space is a randomised singular value decomposition of the TF-IDF matrix of the
stretches' passages, the term statistics being those of all passages of all texts. Passages are looked up by bucket, the
signs of their latent vectors, and candidates have a high cosine with an item passage of their bucket; each
candidate pair is then compared word by word.

Windows of WIDTH words begin at every STRIDE-th word of a stretch and at every word of an item. With
WIDTH + STRIDE - 1 <= MIN_RUN each run of MIN_RUN common words holds a whole stretch window that is also an item
window. Equal windows have equal vectors, thus one bucket and cosine 1, so no run is lost, whatever the space.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomline.llm.words import words
from loomline.operators.skew import spread
from loomline.session import ensure_checkpoint_dir

MIN_RUN, WIDTH, STRIDE = 12, 7, 6
RANK, EXTRA = 48, 16
COSINE = 0.95
#: Bits of a bucket: the signs of so many latent directions.
BITS = 32
#: Items are taken in blocks of about so many characters, each a search of its own over all texts: what is held by the
#: driver and by every task does not grow with the evaluation set.
ITEM_CHARS = 4_000_000
#: The decomposition is fitted on at most about so many passages, picked by a hash of their text; every passage is searched.
FIT_PASSAGES, FIT_TASK = 1_000_000, 50_000
#: Documents looked at together; bounds what a task holds beside the batch itself.
TOGETHER = 512


@dataclass
class Items:
    """A block of the evaluation side, held by every task."""

    ids: list
    texts: list[list[str]]
    vocabulary: dict[str, int]
    min_run: int = MIN_RUN


@dataclass
class Space:
    """Latent space: row t of `terms` is the IDF-weighted latent vector of term t, the last row (unknown) is 0."""

    terms: np.ndarray
    idf: np.ndarray
    singular: np.ndarray


def item_blocks(items: DataFrame, id_col: str, text_col: str, chars: int = ITEM_CHARS) -> Iterator[list[tuple]]:
    """The distinct items with a text, in blocks of about `chars` characters, each sorted. The size is looked up before
    anything is collected."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // chars))
    block = F.pmod(F.xxhash64("t"), F.lit(n))
    for k in range(n):
        part = rows if n == 1 else rows.where(block == k)
        yield sorted((tuple(r) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))


def load_items(rows: list[tuple], min_run: int) -> Items:
    """The items of a block with at least `min_run` words."""
    held = [(i, w) for i, t in rows if len(w := words(t)) >= min_run]
    return Items([i for i, _ in held], [w for _, w in held], _vocabulary(w for _, w in held), min_run)


def _vocabulary(texts: Iterator[list[str]]) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in texts:
        for x in w:
            out.setdefault(x, len(out))
    return out


def known_stretches(docs: DataFrame, doc_id: str, text_col: str, vocabulary: dict[str, int], spans: list[tuple[int, int]], width: int, stride: int) -> DataFrame:
    """One reading of the texts: rows (id, ids) of stretches, and rows (terms, counts) that say in how many passages of
    all texts each term occurs (term v is the number of passages).

    A stretch is a longest run of words covered by windows of `span` words, at least `least` of them in the vocabulary, for
    one of the `spans` (span, least); other words have the number v. Windows end with their text.
    """
    v, sent = len(vocabulary), docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind, arrow = docs.schema[doc_id].dataType.simpleString(), to_arrow_type(docs.schema[doc_id].dataType)
    names = ["id", "ids", "terms", "counts"]
    types = [arrow, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    most = max((span for span, _ in spans), default=0)

    def covered(known: np.ndarray) -> np.ndarray:
        """Which words a window covers."""
        total = np.concatenate([[0], np.cumsum(known), np.full(most, known.sum())])
        edge = np.zeros(len(known) + most + 1, np.int64)
        for span, least in spans:
            at = np.flatnonzero(total[span : span + len(known)] - total[: len(known)] >= least)
            edge[at] += 1
            edge[at + span] -= 1
        return np.cumsum(edge)[: len(known)] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            df, keys, found = np.zeros(v + 1, np.int64), [], []
            for begin in range(0, batch.num_rows, TOGETHER):
                said = [words(t.as_py()) for t in batch.column(1).slice(begin, TOGETHER)]
                n = np.array([len(w) for w in said], dtype=np.int64)
                row = np.fromiter((get(x, v) for w in said for x in w), dtype=np.int64, count=int(n.sum()))
                end = np.cumsum(n)
                starts = np.concatenate([np.arange(0, m - width + 1, stride) + o for m, o in zip(n, end - n, strict=True)] or [[]]).astype(np.int64)
                if len(starts):
                    grid = np.sort(row[starts[:, None] + np.arange(width)], axis=1)
                    fresh = np.ones_like(grid, dtype=bool)
                    fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
                    df += np.bincount(grid[fresh & (grid < v)], minlength=v + 1)
                    df[v] += len(starts)
                # an unknown word after each text; what windows cover beyond it begins a stretch of the next text
                whose = np.repeat(np.arange(len(n)), n + 1)
                apart = np.full(len(whose), v, dtype=np.int64)
                last = end + np.arange(len(n))
                words_at = np.delete(np.arange(len(whose)), last)
                apart[words_at] = row
                keep = covered(apart < v)
                keep[last] = False
                turn = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
                for a, b in zip(turn[::2], turn[1::2], strict=True):
                    keys.append(begin + int(whose[a]))
                    found.append(apart[a:b].astype(np.int32))
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column(0).take(pa.array(keys, pa.int64())).cast(arrow), pa.nulls(1, arrow)]), pa.array([*found, None], types[1]),
                pa.array([*[None] * len(keys), held.astype(np.int32)], types[2]), pa.array([*[None] * len(keys), df[held]], types[3]),
            ], names)

    ensure_checkpoint_dir(docs.sparkSession)
    return spread(docs.select(doc_id, text_col)).mapInArrow(run, f"id {kind}, ids array<int>, terms array<int>, counts array<bigint>").checkpoint()


def _vectors(ids: np.ndarray, starts: np.ndarray, width: int, space_terms: np.ndarray) -> np.ndarray:
    out = space_terms[ids[starts]].copy()
    for j in range(1, width):
        out += space_terms[ids[starts + j]]
    return out


def _passages(column: pa.Array, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of a column of stretches in a row, and (stretch, begin in the row) of each passage."""
    row = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(column.offsets.to_numpy())
    offset = np.cumsum(n) - n
    many = np.maximum((n - width) // stride + 1, 0)
    whose = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)
    return row, whose, offset[whose] + nth * stride


def fit_space(stretches: DataFrame, v: int, width: int = WIDTH, stride: int = STRIDE, rank: int = RANK, seed: int = 11) -> Space:
    """The latent space of the passages of `stretches`, over `v` terms.

    Two passes multiply the passage matrix and its transpose with a thin block (random, then the orthonormal range
    found); each of their few tasks sends one block of v x (rank + extra) numbers. Above FIT_PASSAGES passages those of
    a hash of their numbers are picked.
    """
    counted = stretches.where("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    df = np.zeros(v + 1)
    # a row a term
    for r in counted.groupBy("x.terms").agg(F.sum("x.counts").alias("n")).collect():
        df[r[0]] = r[1]
    idf = np.log((df[v] + 1.0) / (df[:v] + 1.0)) + 1.0
    full = np.concatenate([idf, [math.log(df[v] + 1.0) + 1.0]])
    size = min(rank + EXTRA, max(v, 1))
    rows = stretches.where("ids is not null").select("ids")
    n = rows.agg(F.sum(F.greatest(F.lit(0), F.floor((F.size("ids") - width) / stride) + 1))).first()[0] or 0
    if n > FIT_PASSAGES:
        rows = rows.where(F.pmod(F.xxhash64("ids"), F.lit(1_000_000)) < int(1_000_000 * FIT_PASSAGES / n))
    rows = rows.repartition(max(1, -(-min(n, FIT_PASSAGES) // FIT_TASK)), F.xxhash64("ids"))

    def times(block: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((v + 1, size))
            wide = np.vstack([block * idf[:, None], np.zeros((1, size))])
            for batch in batches:
                ids, _, starts = _passages(batch.column(0), width, stride)
                for b in range(0, len(starts), 65536):
                    s = starts[b : b + 65536]
                    grid = ids[s[:, None] + np.arange(width)]
                    y = _vectors(ids, s, width, wide) / (full[grid] ** 2).sum(1)[:, None]
                    for j in range(width):
                        # rows of the transpose: each window adds its product to each of its terms
                        order = np.argsort(grid[:, j], kind="stable")
                        g = grid[order, j]
                        cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                        out[g[cuts]] += np.add.reduceat(y[order], cuts, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([(out[:v] * idf[:, None]).tobytes()], pa.binary())], ["x"])

        total = np.zeros((v, size))
        for r in rows.mapInArrow(run, "x binary").toLocalIterator():
            total += np.frombuffer(r[0], dtype=np.float64).reshape(v, size)
        return total

    if v == 0 or n == 0:
        return Space(np.zeros((v + 1, 1), np.float32), idf, np.zeros(1))
    q, _ = np.linalg.qr(times(np.random.default_rng(seed).standard_normal((v, size))))
    z = times(q)
    values, turn = np.linalg.eigh(q.T @ z)
    order = np.argsort(values)[::-1][:rank]
    terms = np.vstack([(q @ turn[:, order]) * idf[:, None], np.zeros((1, len(order)))]).astype(np.float32)
    return Space(terms, idf, np.sqrt(np.maximum(values[order], 0)))


def buckets(x: np.ndarray) -> np.ndarray:
    """The bucket of each latent vector: the signs of its first directions."""
    return (x[:, :BITS] > 0) @ (1 << np.arange(min(BITS, x.shape[1]), dtype=np.int64))


def _item_windows(items: Items, space: Space, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors of all item windows, the item each belongs to and its bucket, in the order of the buckets."""
    vectors, owner = [np.zeros((0, space.terms.shape[1]), np.float32)], [np.zeros(0, np.int64)]
    for k, w in enumerate(items.texts):
        ids = np.array([items.vocabulary[x] for x in w], dtype=np.int64)
        starts = np.arange(len(ids) - width + 1, dtype=np.int64)
        vectors.append(_vectors(ids, starts, width, space.terms))
        owner.append(np.full(len(starts), k))
    x, whose = np.vstack(vectors), np.concatenate(owner)
    b = buckets(x)
    order = np.argsort(b, kind="stable")
    return x[order], whose[order], b[order]


def longest_run(a: Sequence[str], b: Sequence[str]) -> int:
    """The length of the longest run of consecutive words that both sequences hold."""
    best, row = 0, [0] * (len(b) + 1)
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    for x in a:
        new = {}
        for j in where.get(x, ()):
            new[j + 1] = row[j] + 1
            best = max(best, new[j + 1])
        row = [0] * (len(b) + 1)
        for j, n in new.items():
            row[j] = n
    return best


def common_subsequence(a: Sequence[str], b: Sequence[str]) -> int:
    """The length of the longest common subsequence of two word sequences."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    min_run: int = MIN_RUN,
    cosine: float = COSINE,
    item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds at least `min_run` consecutive words of the item.

    Candidates come from the buckets of the latent space (see the module); the word-by-word comparison that follows
    only confirms them. Whole texts are searched, so a text may be of any length. Null and empty texts and items of
    fewer words give no rows, repeated rows of a document or an item give their pairs once, items with equal texts
    each come out. Items are collected and broadcast in blocks of `item_chars` characters; a larger evaluation set is
    searched for block by block.
    """
    # the widest windows that keep the promise width + stride - 1 <= min_run with stride = width - 1
    width = max(1, (min_run + 2) // 2)
    stride = max(1, min_run + 1 - width)
    out = None
    for rows in item_blocks(items, item_id, text_col, item_chars):
        part = _leaked(docs, load_items(rows, min_run), doc_id, item_id, text_col, width, stride, cosine, items.schema[item_id].dataType)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _leaked(docs: DataFrame, held: Items, doc_id: str, item_id: str, text_col: str, width: int, stride: int, cosine: float, item_type) -> DataFrame:
    v, min_run = len(held.vocabulary), held.min_run
    stretches = known_stretches(docs, doc_id, text_col, held.vocabulary, [(min_run, min_run)], width, stride)
    sent = docs.sparkSession.sparkContext.broadcast((held, fit_space(stretches, v, width, stride)))
    kind, out_item = docs.schema[doc_id].dataType.simpleString(), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, space = sent.value
        known, owner, own_bucket = _item_windows(held, space, width)
        norms = np.linalg.norm(known, axis=1)
        grams = []
        for w in held.texts:
            ids = tuple(held.vocabulary[x] for x in w)
            grams.append({ids[i : i + min_run] for i in range(len(ids) - min_run + 1)})
        for batch in batches:
            ids, whose, starts = _passages(batch.column(1), width, stride)
            x = _vectors(ids, starts, width, space.terms)
            b = buckets(x)
            low, high = np.searchsorted(own_bucket, b, side="left"), np.searchsorted(own_bucket, b, side="right")
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            r = np.repeat(hit, n)
            c = np.repeat(low[hit], n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            near = (x[r] * known[c]).sum(1) >= cosine * np.linalg.norm(x[r], axis=1) * norms[c] - 1e-6
            pairs = np.unique(np.stack([whose[r[near]], owner[c[near]]], axis=1), axis=0)
            stretch, found_doc, found_item, held_at = None, [], [], -1
            for k, i in pairs.tolist():
                if k != held_at:
                    row, held_at = tuple(batch.column(1)[k].as_py()), k
                    stretch = {row[a : a + min_run] for a in range(len(row) - min_run + 1)}
                if not stretch.isdisjoint(grams[i]):
                    found_doc.append(k)
                    found_item.append(held.ids[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found_doc, pa.int64())), pa.array(found_item, out_item)], [doc_id, item_id])

    return stretches.where("ids is not null").select("id", "ids").mapInArrow(run, f"`{doc_id}` {kind}, `{item_id}` {item_type.simpleString()}")


#: A sentence ends before white space, at an ideographic full stop or at an empty line; single newlines are white space.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n\s*\n")
#: Window starts looked at together.
PLACES = 8192


def item_sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of an item's text."""
    return [w for s in SENTENCE_END.split(text or "") if (w := words(s))]


def subsequence_counter(s: Sequence[str]):
    """A function that gives the length of the longest common subsequence of `s` and its argument, by bits."""
    full, masks = (1 << len(s)) - 1, {}
    for j, x in enumerate(s):
        masks[x] = masks.get(x, 0) | 1 << j

    def count(w: Sequence[str]) -> int:
        row = full
        for x in w:
            if m := masks.get(x):
                u = row & m
                row = ((row + u) | (row - u)) & full
        return len(s) - row.bit_count()

    return count


def paraphrased_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    cosine: float = 0.7,
    least_share: float = 0.75,
    least_words: int = 8,
    item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """Sentences of items that a document holds in reworded form: (doc_id, item_id, share, answer_kept).

    The whole text is searched by overlapping spans that begin at every word, whatever its lines and marks, of
    1 / `least_share` times the sentence's words; a span is a candidate if the latent cosine of it or of a window
    in it, as long as the sentence, is high. Only stretches of text with enough of the items' words are kept after the
    one reading of the texts. `share` is the longest common subsequence over the item sentence's words, at least
    `least_share`. Sentences of under `least_words` words, of which a part says nothing, must stand there word by
    word. `answer_kept` says whether the numbers of the item's sentence, which carry its answer, all stand in the
    span. The best sentence and span count for each pair of document and item.
    Nulls, repeats, lengths and blocks of items are handled as by `leaked_passages`.
    """
    out = None
    for rows in item_blocks(items, item_id, text_col, item_chars):
        said = [(i, w) for i, t in rows for w in item_sentences(t)]
        held = Items([i for i, _ in said], [w for _, w in said], _vocabulary(w for _, w in said), least_words)
        part = _paraphrased(docs, held, doc_id, item_id, text_col, cosine, least_share, items.schema[item_id].dataType)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("share", "answer_kept")).alias("b")
    return out.groupBy(doc_id, item_id).agg(best).select(doc_id, item_id, "b.share", "b.answer_kept")


def _paraphrased(docs: DataFrame, held: Items, doc_id: str, item_id: str, text_col: str, cosine: float, least_share: float, item_type) -> DataFrame:
    lengths = sorted({len(w) for w in held.texts})
    # words of a span, and how many of the sentence's it must hold
    reach = {n: (math.ceil(n / least_share - 1e-9), math.ceil(least_share * n - 1e-9)) if n >= held.min_run else (n, n) for n in lengths}
    stretches = known_stretches(docs, doc_id, text_col, held.vocabulary, sorted(set(reach.values())), WIDTH, STRIDE)
    sent = docs.sparkSession.sparkContext.broadcast((held, fit_space(stretches, len(held.vocabulary))))
    kind, doc_arrow, item_arrow = docs.schema[doc_id].dataType.simpleString(), to_arrow_type(docs.schema[doc_id].dataType), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, space = sent.value
        v = len(held.vocabulary)
        # row v is a word that no item has, row v + 1 the end of a stretch
        terms = np.vstack([space.terms, np.zeros((1, space.terms.shape[1]), np.float32)])
        told = [[held.vocabulary[x] for x in w] for w in held.texts]
        known = np.array([terms[t].sum(0) for t in told], np.float32).reshape(len(told), terms.shape[1])
        known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
        numbers = [{held.vocabulary[x] for x in w if x.isdigit()} for w in held.texts]
        count = [subsequence_counter(t) for t in told]
        light = float(space.idf.min()) ** 2 if v else 0.0
        classes = []
        for n in lengths:
            members = np.array([i for i, t in enumerate(told) if len(t) == n])
            classes.append((n, *reach[n], members, known[members]))
        beyond = max((span for _, span, *_ in classes), default=0)

        def places(row: np.ndarray) -> Iterator[tuple[int, int]]:
            """(sentence, begin of the span) where a window's cosine is high enough."""
            for b in range(0, len(row) - beyond, PLACES):
                ix = row[b : min(b + PLACES, len(row) - beyond) + beyond]
                size = len(ix) - beyond
                inside = np.concatenate([[0], np.cumsum(ix < v)])
                foreign = np.concatenate([[0], np.cumsum(ix == v)])
                total = np.vstack([np.zeros((1, terms.shape[1])), np.cumsum(terms[ix], axis=0, dtype=np.float64)])
                for n, span, least, members, vectors in classes:
                    s = np.flatnonzero(inside[span : span + size] - inside[:size] >= least)
                    for width in sorted({n, span}):
                        x = (total[s + width] - total[s]).astype(np.float32)
                        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1) + (foreign[s + width] - foreign[s]) * light)
                        r, c = np.nonzero((x @ vectors.T) >= cosine * np.maximum(norm, 1e-12)[:, None])
                        for at, i in zip((s[r] + b).tolist(), members[c].tolist(), strict=True):
                            for begin in range(max(0, at - span + width), at + 1):
                                yield i, begin

        for batch in batches:
            best: dict[tuple[int, object], tuple[float, bool]] = {}
            parts = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in batch.column(1)]
            gap = np.full(beyond, v + 1, np.int64)
            row = np.concatenate([y for x in parts for y in (x, gap)])
            end = np.cumsum([len(x) + beyond for x in parts])
            listed = row.tolist()
            for i, begin in set(places(np.concatenate([row, gap]))):
                n = len(told[i])
                part = listed[begin : begin + reach[n][0]]
                share = count[i](part) / n
                if share >= (least_share if n >= held.min_run else 1.0):
                    key = (int(np.searchsorted(end, begin, side="right")), held.ids[i])
                    best[key] = max(best.get(key, (0.0, False)), (share, numbers[i] <= set(part)))
            keys = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[k].as_py() for k, _ in best], doc_arrow),
                    pa.array([i for _, i in best], item_arrow),
                    pa.array([round(s, 4) for s, _ in best.values()], pa.float64()),
                    pa.array([a for _, a in best.values()], pa.bool_()),
                ],
                [doc_id, item_id, "share", "answer_kept"],
            )

    return stretches.where("ids is not null").select("id", "ids").mapInArrow(
        run, f"`{doc_id}` {kind}, `{item_id}` {item_type.simpleString()}, share double, answer_kept boolean"
    )
