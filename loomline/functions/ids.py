"""Component ids (`relative_path::Name`) in one notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_path(path: Column | str) -> Column:
    """A relative path with `/` as separator, without padding, `.` segments and doubled or leading `./`.

    Null stays null, blank becomes the empty string; letter case is kept.
    """
    p = F.regexp_replace(_col(path), r"^\s+|\s+$", "")
    p = F.regexp_replace(p, r"\\", "/")
    p = F.regexp_replace(p, r"/(?:\.?/)+", "/")
    return F.regexp_replace(p, r"^(?:\./)+", "")


def id_path(cid: Column | str) -> Column:
    """The cleaned path part of a component id; null where it has no `::`."""
    c = _col(cid)
    return F.when(c.contains("::"), clean_path(F.substring_index(c, "::", 1)))


def id_name(cid: Column | str) -> Column:
    """The name part of a component id, or all of it where it has no `::`."""
    return F.regexp_replace(F.regexp_replace(_col(cid), r"(?s)^.*?::", ""), r"^\s+|\s+$", "")


def clean_id(cid: Column | str) -> Column:
    """A component id in its clean notation: padding and the path's separators are unified, nothing else."""
    c = _col(cid)
    return F.when(c.isNull(), None).otherwise(F.concat_ws("::", id_path(c), id_name(c)))


def is_blank(c: Column | str) -> Column:
    """True for null and for strings of white space only."""
    c = _col(c)
    return c.isNull() | ~c.rlike(r"\S")
