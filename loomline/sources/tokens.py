"""Source text to tokens, with brackets paired: what the readers of declarations and of endpoints look at."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

WORD, STRING, NUMBER, MARK = "word", "string", "number", "mark"
_SLASH_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)"
_HASH_COMMENT = r"\#[^\n]*"
_TRIPLE = r'"""(?:\\.|[^\\"]|"(?!""))*+(?:"""|\Z)|' + r"'''(?:\\.|[^\\']|'(?!''))*+(?:'''|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*+"?|' + r"'(?:\\.|[^'\\\n])*+'?"
_BACKTICK = r"`(?:\\.|[^`\\])*+(?:`|\Z)"
#: In scripts a slash that follows one of these opens a regular expression.
_BEFORE_REGEX = frozenset(("(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "+", "-", "*", "%", "<", ">", "~", "^", "=>", "return", "typeof", "case", "in", "of"))
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*")


def _lexer(comment: str, string: str) -> re.Pattern:
    return re.compile(
        rf"(?P<comment>{comment})|(?P<string>{string})|(?P<word>[^\W\d][\w$]*+|\$[\w$]*+)|(?P<number>\d[\w.]*+)|(?P<mark>=>|->|::|\?\.|:=|\S)|(?P<space>\s++)",
        re.DOTALL,
    )


_PREFIXED = r"[A-Za-z]{0,2}(?:" + _TRIPLE + "|" + _QUOTED + ")"
_LEXERS = {
    "python": _lexer(_HASH_COMMENT, rf"(?:(?<!\w)[rRbBuUfF]{{1,2}})?(?:{_TRIPLE}|{_QUOTED})"),
    "php": _lexer(_SLASH_COMMENT + r"|\#(?!\[)[^\n]*", _QUOTED + "|" + _BACKTICK),
    "java": _lexer(_SLASH_COMMENT, _TRIPLE + "|" + _QUOTED),
    "kotlin": _lexer(_SLASH_COMMENT, _TRIPLE + "|" + _QUOTED),
    "csharp": _lexer(_SLASH_COMMENT + r"|(?m:^[ \t]*\#[^\n]*)", r'[$@]{0,2}"""(?:[^"]|"(?!""))*+(?:"""|\Z)|\$?@\$?"(?:""|[^"])*+"|\$?' + _QUOTED),
    "c": _lexer(_SLASH_COMMENT + r"|(?m:^[ \t]*\#(?:[^\n\\]|\\.)*+)", _QUOTED),
}
_LEXERS["cpp"] = _LEXERS["c"]
_SCRIPT = _lexer(_SLASH_COMMENT, _QUOTED + "|" + _BACKTICK)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass
class Tokens:
    """The tokens of a text in parallel lists, comments apart: (begin, end, text) and the token that follows each."""

    text: str
    kind: list[str] = field(default_factory=list)
    word: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)  # of brackets, both ways
    comments: list[tuple[int, int, int]] = field(default_factory=list)
    breaks: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.word)

    def line(self, token: int) -> int:
        """The line of a token, from 1."""
        return self.line_at(self.at[token])

    def line_at(self, offset: int) -> int:
        return bisect_right(self.breaks, offset) + 1

    def end(self, token: int) -> int:
        return self.at[token] + len(self.word[token])

    def get(self, token: int) -> str:
        """A token's text; empty beyond the ends."""
        return self.word[token] if 0 <= token < len(self.word) else ""

    def is_word(self, token: int) -> bool:
        return 0 <= token < len(self.word) and self.kind[token] == WORD

    def literal(self, token: int) -> str | None:
        """What stands between the quotes of a string token."""
        if not (0 <= token < len(self.word)) or self.kind[token] != STRING:
            return None
        s = self.word[token].lstrip("rRbBuUfF$@")
        quotes = 3 if s[:3] in ('"""', "'''") else 1
        return s[quotes : -quotes or None] if len(s) >= 2 * quotes else s[quotes:]


def tokenize(text: str, language: str) -> Tokens:
    """The tokens of a text. Brackets that find no partner are left without one."""
    out = Tokens(text)
    out.breaks = [m.start() + 1 for m in re.finditer("\n", text)]
    script = language in ("javascript", "typescript")
    lexer = _SCRIPT if script or language == "go" else _LEXERS[language]
    stack: list[int] = []
    at = 0
    while at < len(text):
        m = lexer.match(text, at)
        if script and m.lastgroup == "mark" and m[0] == "/" and (not out.word or out.word[-1] in _BEFORE_REGEX) and (r := _REGEX.match(text, at)):
            out.kind.append(NUMBER)
            out.word.append(r[0])
            out.at.append(at)
            at = r.end()
            continue
        at = m.end()
        kind = m.lastgroup
        if kind == "comment":
            out.comments.append((m.start(), m.end(), len(out.word)))
        elif kind != "space":
            if m[0] in _OPEN and kind == MARK:
                stack.append(len(out.word))
            elif m[0] in _CLOSE and kind == MARK:
                while stack and out.word[stack[-1]] != _CLOSE[m[0]] and m[0] == "}":
                    stack.pop()
                if stack and out.word[stack[-1]] == _CLOSE[m[0]]:
                    out.partner[len(out.word)] = stack[-1]
                    out.partner[stack.pop()] = len(out.word)
            out.kind.append(kind)
            out.word.append(m[0])
            out.at.append(m.start())
    return out


def angle(t: Tokens, at: int) -> int:
    """The token after a balanced `<...>` of types that begins at `at`; `at` itself where there is none."""
    if t.get(at) != "<":
        return at
    depth = 0
    for k in range(at, len(t)):
        w = t.word[k]
        depth += (w == "<") - (w == ">")
        if depth == 0:
            return k + 1
        if w in "{};" and t.kind[k] == MARK:
            return at
    return at


def arguments(t: Tokens, open_: int, types: bool = False) -> list[tuple[int, int]]:
    """The ranges of tokens between the commas of a bracketed list, nested brackets (and with `types` angles) passed over."""
    close = t.partner.get(open_)
    if close is None or close == open_ + 1:
        return []
    out, begin, i = [], open_ + 1, open_ + 1
    while i < close:
        if t.word[i] in _OPEN and t.kind[i] == MARK and i in t.partner:
            i = t.partner[i]
        elif types and t.word[i] == "<" and i < (after := angle(t, i)) <= close:
            i = after - 1
        elif t.word[i] == "," and t.kind[i] == MARK:
            out.append((begin, i))
            begin = i + 1
        i += 1
    return [*out, (begin, close)] if begin < close else out


def comment_text(raw: str) -> str:
    """A comment without its marks."""
    lines = [re.sub(r"^\s*(?:/\*+!?|//+!?|\*(?!/)|#+)?\s?", "", x) for x in re.sub(r"\**\*/\s*$", "", raw).split("\n")]
    return "\n".join(x.rstrip() for x in lines).strip()


def comment_above(t: Tokens, first: int) -> str | None:
    """The comment that ends on the line above a token or before it on its line; line comments in a row belong together."""
    found: list[str] = []
    line = t.line(first)
    for begin, end, follows in reversed(t.comments):
        if follows > first:
            continue
        if follows < first or t.line_at(end - 1) < line - 1:
            break
        raw = t.text[begin:end]
        if found and raw.startswith("/*"):
            break
        found.insert(0, comment_text(raw))
        line = t.line_at(begin)
        if raw.startswith("/*"):
            break
    return "\n".join(found).strip() or None
