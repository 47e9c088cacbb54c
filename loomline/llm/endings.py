"""How a text ends: complete, within a word or sentence, or in a way only other copies can tell."""

from __future__ import annotations

import re
import unicodedata

#: White space at the end of a text.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Marks that a transfer or a field limit leaves at a cut, at the end of a text without trailing white space. The
#: pattern begins only where a run of white space or hyphens begins.
MARKS = (
    r"(?:(?<!\s)\s*+(?:"
    r"[\[(<{]\s*+(?:\.{2,}|…|(?:(?:text|message|content|output)\s*+)?(?:was\s++)?(?:cut(?:\s++off)?|truncated|snip(?:ped)?|shortened|clipped|more|continued|cont\.?"
    r"|gekürzt|abgeschnitten|tronqué|coupé|truncado|cortado|截断|已截断|省略))\s*+(?:\.{2,}|…)?\s*+[\])>}]"
    r"|<!--\s*+(?:cut|truncated|snip)\s*+-->"
    r"|(?<!-)-++\s*+(?:truncated|cut|snip)\s*+-++"
    r"))++\s*+\Z"
)
#: What a mark ends with.
MARK_ENDS = ("]", ")", ">", "}", "-")
MARK = re.compile(MARKS, re.IGNORECASE)
ELLIPSIS = re.compile(r"\s*(?:…+|\.{3,})\s*$")
CLOSERS = "\"'”’»›)]}>*_`」』）】》"
ENDERS = ".!?。！？｡．؟।॥"
FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
HEADING = re.compile(r"^\s{0,3}#{1,6}\s+\S")
LOG = re.compile(
    r"^\s*(?:\[[^\]\s]{1,24}\]\s|\|?\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d(?::\d\d)?\s|\*\s+\*\*|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b)"
)
TAGS = re.compile(r"^\s*(?:(?:tags?|labels?|keywords|topics)\s*[:=]|(?:#[\w-]+[\s,]*)+$)", re.IGNORECASE)
LINK = re.compile(r"^\s*(?:[-*]\s+)?(?:!?\[[^\]]*\](?:\([^()\s]*\)|\[[^\]]*\])|\[\[[^\]]+\]\]|<?https?://\S+>?)\s*$")
PLACED = re.compile(r"\[[^\]]*\]\([^()]*\)")
KEYED = re.compile(r"^\s*[\w.-]{1,40}\s*[:=]\s*\S")
SIGNATURE = re.compile(r"[^\W_]+(?:[_.-][^\W_]+)*", re.UNICODE)

OPEN, CLOSED, UNSURE = "open", "closed", "unsure"


def strip_marks(text: str) -> tuple[str, bool]:
    """The text without trailing space and marks of a cut, and whether there was a mark."""
    body = text.rstrip(SPACES)
    if body.endswith(MARK_ENDS) and (m := MARK.search(body)):
        return body[: m.start()], True
    return body, False


def _balanced(line: str) -> bool:
    """Whether code spans, emphasis, links and brackets opened in a line are closed in it."""
    if line.count("`") % 2 or line.count("**") % 2:
        return False
    plain = re.sub(r"`[^`]*`", "", line)
    return all(plain.count(a) <= plain.count(b) for a, b in ("()", "[]", "{}")) and plain.count('"') % 2 == 0


def _signature(line: str) -> str:
    return SIGNATURE.sub("w", line).strip()


def _sentence_end(body: str) -> bool:
    tail = body[-12:].rstrip(CLOSERS + " ")
    return bool(tail) and tail[-1] in ENDERS


def classify_ending(text: str | None) -> str:
    """How a text ends, marks of a cut left out (see `ending_of`); null, empty and blank texts are closed."""
    return CLOSED if text is None else ending_of(*strip_marks(text))


def ending_of(body: str, marked: bool) -> str:
    """`open`: the text stops within a word or sentence; `closed`: it is complete; `unsure`: its last line is of a
    kind that needs no full stop, and nothing in the text tells whether that line is whole.

    `body` is the text without marks of a cut and trailing white space, `marked` says that there was a mark.
    """
    if not body:
        return CLOSED
    if body[-1] == "\ufffd" or unicodedata.category(body[-1]) == "Cs":
        return OPEN
    tail = body[body.rfind("\n") + 1 :]
    ellipsis = ELLIPSIS.search(tail)
    if ellipsis and not marked:
        # an ellipsis after a whole sentence is a mark; after an open one it may be the author's: the caller
        # compares other copies
        stem = tail[: ellipsis.start()]
        return CLOSED if _sentence_end(stem) else UNSURE
    lines = body.split("\n")
    last = lines[-1].rstrip("\r")
    # code fences
    fence, opened = None, -1
    for k, line in enumerate(lines):
        m = FENCE.match(line)
        if m and fence is None:
            fence, opened = m.group(1), k
        elif m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line.strip().strip(fence[0]):
            if k == len(lines) - 1:
                return CLOSED
            fence = None
    if fence is not None:
        return OPEN
    if lines[0].strip() == "---" and not any(x.strip() in ("---", "...") for x in lines[1:]):
        return OPEN if len(lines) > 1 and KEYED.match(lines[1]) else UNSURE
    if last.strip() in ("---", "***", "___", "==="):
        return CLOSED
    if LOG.match(last):
        return UNSURE if _balanced(last) and not (last.lstrip().startswith("|") and not last.endswith("|")) else OPEN
    if last.lstrip().startswith("|"):
        if not last.endswith("|"):
            return OPEN
        above = [x.rstrip() for x in lines[:-1] if x.lstrip().startswith("|")]
        return OPEN if above and above[-1].count("|") != last.count("|") else CLOSED
    if HEADING.match(last):
        return UNSURE
    if TAGS.match(last):
        return UNSURE
    if LINK.match(last):
        return CLOSED
    if ITEM.match(last):
        if not _balanced(last):
            return OPEN
        if _sentence_end(last):
            return CLOSED
        mates = []
        for line in reversed(lines[:-1]):
            if not ITEM.match(line):
                break
            mates.append(line.rstrip())
        if mates and not any(_signature(x) == _signature(last) for x in mates) and len({_signature(x) for x in mates}) == 1:
            return OPEN
        return UNSURE
    if _sentence_end(body):
        return CLOSED
    if len([x for x in lines if x.strip()]) == 1 and len(last) <= 80 and not re.search(r"[.!?]\s|[。！？]", last):
        return UNSURE  # a subject line or a title
    return OPEN
