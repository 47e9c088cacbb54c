"""Words of a text in one form."""

from __future__ import annotations

import re
import unicodedata

#: Invisible characters that stand within words: soft hyphen, joiners, byte-order mark.
INVISIBLE = re.compile("[­‌‍⁠﻿]")
RUN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of a text, in one letter case and Unicode form; null gives none."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold()
        return RUN.findall(unicodedata.normalize("NFKC", text))
    return RUN.findall(text.lower())
