"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 2
WORD = re.compile(r"[^\W\d_]+|\d+")


class Piece(NamedTuple):
    """Lines `first` to `last` (0-based, inclusive); `part` counts the cuts within one long line."""

    first: int
    last: int
    part: int


def last_blank_line(lines: list[str], begin: int, end: int) -> int | None:
    """The last blank line of `begin`..`end` with a non-blank line before it in that range."""
    for k in range(end, begin, -1):
        if not lines[k].strip():
            for j in range(begin, k):
                if lines[j].strip():
                    return k
    return None


def deepest_valley(depths: list[float]) -> Callable[[list[str], int, int], int | None]:
    """A boundary rule: the line of the window whose gap to the next has the deepest cohesion valley; of equal ones the last."""

    def choose(lines: list[str], begin: int, end: int) -> int | None:
        best = max(range(begin, end + 1), key=lambda k: (depths[k], k), default=None)
        return best if best is not None and depths[best] > 0 else None

    return choose


def cohesion_depths(lines: list[str], block: int = 8) -> list[float]:
    """For each line the depth of the valley in lexical cohesion between it and the next line.

    Cohesion at a gap is the cosine of the word counts of the `block` lines on either side; the depth is how
    far the nearest peaks to the left and right rise above it. The last line has no gap (0).
    """
    bags = [Counter(w.lower() for w in WORD.findall(x)) for x in lines]
    n, sims = len(lines), []
    left: Counter[str] = Counter()
    right: Counter[str] = Counter()
    for b in bags[:block]:
        right.update(b)
    for g in range(n - 1):  # the gap after line g; both windows move by one line
        left.update(bags[g])
        right.subtract(bags[g])
        if g >= block:
            left.subtract(bags[g - block])
        if g + block < n:
            right.update(bags[g + block])
        small, large = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(v * large.get(w, 0) for w, v in small.items() if v)
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        sims.append(dot / norm if norm else 0.0)
        if g % 64 == 0:
            left, right = +left, +right
    depths = [0.0] * n
    peak = 0.0
    rise = [0.0] * len(sims)
    for g, s in enumerate(sims):  # climb to the left as long as it does not fall
        peak = max(peak, s) if g and sims[g - 1] >= s else s
        rise[g] = peak - s
    peak = 0.0
    for g in range(len(sims) - 1, -1, -1):
        s = sims[g]
        peak = max(peak, s) if g + 1 < len(sims) and sims[g + 1] >= s else s
        depths[g] = rise[g] + peak - s
    return depths


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, boundary: str = "blank") -> list[Piece]:
    """The pieces of a text: runs of whole lines of at most `limit` characters, each next one repeating up to
    `overlap` lines of the one before; lines over the limit are cut by themselves.

    `boundary` says where a full piece ends: `blank` at its last blank line, `cohesion` at the deepest valley of
    lexical cohesion among its new lines, `full` where it is full (also the fallback of the others).
    """
    lines = text.split("\n")
    n = len(lines)
    if boundary == "blank":
        choose = last_blank_line
    elif boundary == "cohesion":
        choose = deepest_valley(cohesion_depths(lines))
    elif boundary == "full":
        choose = lambda *_: None
    else:
        raise ValueError(f"unknown boundary {boundary!r}")
    out: list[Piece] = []
    at, before = 0, 0  # the next new line; how many lines of the last piece may be repeated
    while at < n:
        if len(lines[at]) > limit:
            out.extend(Piece(at, at, k) for k in range(-(-len(lines[at]) // limit)))
            at, before = at + 1, 0
            continue
        first = at - min(overlap, before)
        size = sum(len(x) + 1 for x in lines[first:at])
        while first < at and size + len(lines[at]) > limit:
            size -= len(lines[first]) + 1
            first += 1
        size += len(lines[at])
        end = at
        while end + 1 < n and size + 1 + len(lines[end + 1]) <= limit:
            end += 1
            size += 1 + len(lines[end])
        if end < n - 1:
            cut = choose(lines, at, end)
            end = end if cut is None else cut
        out.append(Piece(first, end, 0))
        at, before = end + 1, end + 1 - first
    return out


def split_oversized(
    items: DataFrame,
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    boundary: str = "blank",
    id_col: str = "id",
    text_col: str = "source_code",
    start_col: str = "start_line",
    with_text: bool = False,
) -> DataFrame:
    """The pieces of each item whose text has more than `limit` characters (code points).

    Gives (id, piece_no from 1, start_line, end_line), and `piece_text` if `with_text`. Lines count from the
    item's `start_line`, or from 1 where that is null or less than 1. Items with a null or small enough text
    give no rows; repeated rows of an item give its pieces once. Only oversized texts reach Python; any number
    of lines and any line length is cut, in time proportional to the text.
    """
    large = items.where(F.length(text_col) > limit).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(start_col).cast("long").alias("base")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, text, base in zip(*(batch.column(i) for i in range(3)), strict=True):
                body = text.as_py()
                pieces = split_text(body, limit, overlap, boundary)
                base_no = base.as_py() or 1
                base_no = base_no if base_no > 0 else 1
                cols = [
                    pa.array([ident.as_py()] * len(pieces), pa.string()),
                    pa.array(range(1, len(pieces) + 1), pa.int32()),
                    pa.array([base_no + p.first for p in pieces], pa.int32()),
                    pa.array([base_no + p.last for p in pieces], pa.int32()),
                ]
                if with_text:
                    lines = body.split("\n")
                    cols.append(
                        pa.array(
                            [
                                lines[p.first][p.part * limit : (p.part + 1) * limit]
                                if len(lines[p.first]) > limit
                                else "\n".join(lines[p.first : p.last + 1])
                                for p in pieces
                            ],
                            pa.string(),
                        )
                    )
                names = ["id", "piece_no", "start_line", "end_line", "piece_text"][: len(cols)]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id string, piece_no int, start_line int, end_line int" + ", piece_text string" * with_text
    return large.mapInArrow(run, schema).dropDuplicates(["id", "piece_no", "start_line", "end_line"])
