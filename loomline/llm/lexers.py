"""Token streams of Python, JavaScript, TypeScript, Java and Go.

Each lexer gives lists of token kinds, of character offsets and of flags (a line break stands before the token).
Punctuation and reserved words are their own kind; other kinds are ID, NUM, STR and so on. What cannot be a
token gives the kind ERR, which no grammar accepts.
"""

from __future__ import annotations

import re

Tokens = tuple[list[str], list[int], list[bool]]

JS_RESERVED = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in "
    "instanceof let new return super switch this throw try typeof var void while with null true false enum yield await"
).split()
JS_CONTEXT = "async of get set as from static".split()
TS_CONTEXT = (
    "type declare namespace module abstract readonly public private protected keyof infer is asserts satisfies override "
    "implements interface unique global accessor out"
).split()
JAVA_RESERVED = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally "
    "float for goto if implements import instanceof int interface long native new package private protected public return short "
    "static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
).split()
JAVA_CONTEXT = "record sealed permits when yield".split()
GO_RESERVED = (
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range "
    "return select struct switch type var"
).split()
PY_RESERVED = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import "
    "in is lambda nonlocal not or pass raise return try while with yield"
).split()
PY_CONTEXT = "match case type".split()

_ID = r"(?:[^\W\d]|[$\\])(?:[\w$\u200c\u200d]|\\u\{?[0-9a-fA-F]+\}?)*"
_NUM_JS = r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?n?"
_STR_JS = r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"

_JS = re.compile(
    rf"""(?P<space>[^\S\n\r\u2028\u2029]+|\ufeff)|(?P<line>[\n\r\u2028\u2029])|(?P<lc>//[^\n\r]*)|(?P<bc>/\*[\s\S]*?\*/)|(?P<html><!--[^\n]*)
    |(?P<num>{_NUM_JS})|(?P<id>\#?{_ID})|(?P<str>{_STR_JS})
    |(?P<op>\.\.\.|=>|\?\?=|\*\*=|<<=|&&=|\|\|=|===|!==|\?\.(?!\d)|\?\?|\*\*|\+\+|--|<<|<=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=?:;,.(){{}}\[\]@])""",
    re.VERBOSE,
)
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
#: After these a slash divides; after all others it opens a regular expression.
_ENDS_VALUE = frozenset(["ID", "NUM", "STR", "REGEX", "TPL0", "TPLT", ")", "]", "}", "this", "super", "null", "true", "false", "PRIVATE", "++", "--", *JS_CONTEXT, *TS_CONTEXT])


def lex_script(text: str, typed: bool) -> Tokens:
    """JavaScript, or TypeScript if `typed`. In the latter each `>` is a token of its own."""
    kinds: list[str] = []
    at: list[int] = []
    fresh: list[bool] = []
    words = {*JS_RESERVED, *JS_CONTEXT, *(TS_CONTEXT if typed else ())}
    pos, n, line = 0, len(text), False
    braces: list[bool] = []  # of each open brace: does it belong to a template?
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n

    def put(kind: str, where: int) -> None:
        nonlocal line
        kinds.append(kind)
        at.append(where)
        fresh.append(line)
        line = False

    while pos < n:
        c = text[pos]
        if c == "`" or (c == "}" and braces and braces[-1]):
            start = pos
            m = _TPL.match(text, pos + 1)
            pos = m.end()
            first = c == "`"
            if not first:
                braces.pop()
            if pos < n and text[pos] == "`":
                pos += 1
                put("TPL0" if first else "TPLT", start)
            elif pos < n:
                pos += 2
                braces.append(True)
                put("TPLH" if first else "TPLM", start)
            else:
                put("ERR", start)
            continue
        if c == "/" and (not kinds or kinds[-1] not in _ENDS_VALUE) and text[pos : pos + 2] not in ("//", "/*"):
            m = _REGEX.match(text, pos)
            if not m:
                put("ERR", pos)
                break
            put("REGEX", pos)
            pos = m.end()
            continue
        m = _JS.match(text, pos)
        if not m:
            put("ERR", pos)
            pos += 1
            continue
        kind, start = m.lastgroup, pos
        pos = m.end()
        if kind == "line":
            line = True
        elif kind == "bc":
            line = line or "\n" in m.group() or "\r" in m.group()
        elif kind == "num":
            if pos < n and (text[pos].isalnum() or text[pos] in "_$"):
                put("ERR", start)
            elif re.match(r"0\d", m.group()):
                put("ERR", start)
            else:
                put("NUM", start)
        elif kind == "str":
            put("STR", start)
        elif kind == "html":
            put("ERR", start)
        elif kind == "id":
            w = m.group()
            # after a dot every word is a name
            if w[0] == "#":
                put("PRIVATE", start)
            elif w in words and not (kinds and kinds[-1] in (".", "?.")):
                put(w, start)
            else:
                put("ID", start)
        elif kind == "op":
            w = m.group()
            if w == "{":
                braces.append(False)
            elif w == "}" and braces:
                braces.pop()
            put(w, start)
    # a quote that never closes
    return kinds, at, fresh


_JAVA = re.compile(
    r"""(?P<space>\s+|\x1a)|(?P<lc>//[^\n\r]*)|(?P<bc>/\*[\s\S]*?\*/)
    |(?P<text>\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?\"\"\")
    |(?P<str>\"(?:[^\"\\\n\r]|\\(?:[btnfrs0-7'\"\\]|u+[0-9a-fA-F]{4}))*\")|(?P<chr>'(?:[^'\\\n\r]|[\ud800-\udbff][\udc00-\udfff]|\\(?:[btnfrs'\"\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4}))')
    |(?P<num>0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)
    |(?P<id>[^\W\d$][\w$]*|\$[\w$]*)
    |(?P<op>\.\.\.|->|::|<<=|\+\+|--|<<|<=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=?:;,.(){}\[\]@])""",
    re.VERBOSE,
)
_GO = re.compile(
    r"""(?P<line>\n)|(?P<space>[ \t\r]+)|(?P<lc>//[^\n]*)|(?P<bc>/\*[\s\S]*?\*/)|(?P<raw>`[^`]*`)
    |(?P<str>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\")
    |(?P<chr>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
    |(?P<num>0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)
    |(?P<id>[^\W\d]\w*)
    |(?P<op>\.\.\.|<<=|>>=|&\^=|&\^|<-|\+\+|--|:=|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!<>=:;,.(){}\[\]~])""",
    re.VERBOSE,
)
_GO_ENDS = frozenset(["ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def lex_java(text: str) -> Tokens:
    """Java; each `>` is a token of its own."""
    words = {*JAVA_RESERVED, *JAVA_CONTEXT}
    kinds: list[str] = []
    at: list[int] = []
    pos, n = 0, len(text)
    while pos < n:
        m = _JAVA.match(text, pos)
        if not m:
            kinds.append("ERR")
            at.append(pos)
            break
        kind = m.lastgroup
        if kind not in ("space", "lc", "bc"):
            w = m.group()
            at.append(pos)
            if kind == "op":
                kinds.append(w)
            elif kind == "id":
                kinds.append(w if w in words else "ID")
            elif kind == "num":
                nxt = text[m.end() : m.end() + 1]
                kinds.append("ERR" if nxt.isalnum() or nxt == "_" else "NUM")
            else:
                kinds.append("STR")
        pos = m.end()
    return kinds, at, [False] * len(kinds)


def lex_go(text: str) -> Tokens:
    """Go, with the semicolons that line ends stand for."""
    words = set(GO_RESERVED)
    kinds: list[str] = []
    at: list[int] = []
    pos, n = 0, len(text)
    while pos < n:
        m = _GO.match(text, pos)
        if not m:
            kinds.append("ERR")
            at.append(pos)
            break
        kind = m.lastgroup
        if kind == "line" or (kind == "bc" and "\n" in m.group()):
            if kinds and kinds[-1] in _GO_ENDS:
                kinds.append(";")
                at.append(pos)
        elif kind not in ("space", "lc", "bc"):
            w = m.group()
            at.append(pos)
            if kind == "op":
                kinds.append(w)
            elif kind == "id":
                kinds.append(w if w in words else "ID")
            elif kind == "num":
                nxt = text[m.end() : m.end() + 1]
                kinds.append("ERR" if nxt.isalnum() or nxt == "_" else "NUM")
            elif kind == "chr":
                kinds.append("NUM")
            else:
                kinds.append("STR")
        pos = m.end()
    if kinds and kinds[-1] in _GO_ENDS:
        kinds.append(";")
        at.append(n)
    return kinds, at, [False] * len(kinds)


_PY = re.compile(
    r"""(?P<space>[ \t\f]+)|(?P<join>\\\r?\n|\\\r)|(?P<line>\r\n|\n|\r)|(?P<lc>\#[^\n\r]*)
    |(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)
    |(?P<id>[^\W\d]\w*)
    |(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|:=|->|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%&|^~<>=:;,.(){}\[\]@])""",
    re.VERBOSE,
)
_PY_PREFIX = re.compile(r"(?i)(?:[rbfu]|br|rb|fr|rf)?(?=['\"])")
_PY_TAIL = {
    "'''": re.compile(r"(?:[^\\']|\\[\s\S]|'(?!''))*'''"),
    '"""': re.compile(r'(?:[^\\"]|\\[\s\S]|"(?!""))*"""'),
    "'": re.compile(r"(?:[^\\'\n\r]|\\(?:\r\n|[\s\S]))*'"),
    '"': re.compile(r'(?:[^\\"\n\r]|\\(?:\r\n|[\s\S]))*"'),
}


def _fstring(text: str, pos: int, quote: str) -> int:
    """The end of a formatted string whose body begins at pos, or -1; its replacement fields may hold any strings."""
    n, depth = len(text), 0
    while pos < n:
        c = text[pos]
        if depth == 0:
            if text.startswith(quote, pos):
                return pos + len(quote)
            if c == "\\":
                pos += 2
                continue
            if c in "\n\r" and len(quote) == 1:
                return -1
            if c == "{":
                if text[pos + 1 : pos + 2] == "{":
                    pos += 1
                else:
                    depth = 1
            elif c == "}":
                if text[pos + 1 : pos + 2] != "}":
                    return -1
                pos += 1
            pos += 1
        else:
            m = _PY_PREFIX.match(text, pos)
            if m and text[m.end() : m.end() + 1] in ("'", '"') and not (text.startswith(quote, m.end()) and len(quote) == 3):
                q = text[m.end() : m.end() + 3] if text[m.end() : m.end() + 3] in ("'''", '"""') else text[m.end()]
                begin = m.end() + len(q)
                if "f" in m.group().lower():
                    pos = _fstring(text, begin, q)
                else:
                    e = _PY_TAIL[q].match(text, begin)
                    pos = e.end() if e else -1
                if pos < 0:
                    return -1
                continue
            if c in "{[(":
                depth += 1
            elif c in "}])":
                depth -= 1
            elif c in "\n\r" and len(quote) == 1 and depth < 1:
                return -1
            elif c == ":" and depth == 1:  # a format: text again, up to the brace that closes the field
                pos += 1
                inner = 0
                while pos < n and (inner or text[pos] != "}"):
                    if text.startswith(quote, pos) and not inner:
                        return -1
                    inner += (text[pos] == "{") - (text[pos] == "}")
                    pos += 1
                continue
            pos += 1
    return -1


#: Words that may follow a number without a space.
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|or|not)\b")


def lex_python(text: str) -> Tokens:
    """Python 3 with NEWLINE, INDENT and DEDENT tokens."""
    words = {*PY_RESERVED, *PY_CONTEXT}
    kinds: list[str] = []
    at: list[int] = []
    levels = [(0, 0)]  # columns with tabs to 8 and to 1, as the language compares them
    depth, pos, n, begin = 0, 0, len(text), True

    def put(kind: str) -> None:
        kinds.append(kind)
        at.append(pos)

    while pos < n:
        if begin and depth == 0:
            k, wide, narrow = pos, 0, 0
            while k < n and text[k] in " \t\f":
                if text[k] == "\t":
                    wide, narrow = (wide // 8 + 1) * 8, narrow + 1
                elif text[k] == " ":
                    wide, narrow = wide + 1, narrow + 1
                else:
                    wide = narrow = 0
                k += 1
            if k < n and text[k] not in "\n\r#":
                pos = k
                if wide > levels[-1][0]:
                    if narrow <= levels[-1][1]:
                        put("ERR")
                        break
                    levels.append((wide, narrow))
                    put("INDENT")
                else:
                    while wide < levels[-1][0]:
                        levels.pop()
                        put("DEDENT")
                    if (wide, narrow) != levels[-1]:
                        put("ERR")
                        break
                begin = False
            elif k >= n:
                break
            else:
                pos = k
        m = _PY_PREFIX.match(text, pos)
        if m and text[m.end() : m.end() + 1] in ("'", '"'):
            q = text[m.end() : m.end() + 3]
            q = q if q in _PY_TAIL else q[0]
            if "f" in m.group().lower():
                end = _fstring(text, m.end() + len(q), q)
            else:
                e = _PY_TAIL[q].match(text, m.end() + len(q))
                end = e.end() if e else -1
            if end < 0:
                put("ERR")
                break
            put("BYTES" if "b" in m.group().lower() else "STR")
            pos = end
            continue
        m = _PY.match(text, pos)
        if not m:
            put("ERR")
            break
        kind, w = m.lastgroup, m.group()
        if kind == "line":
            if depth == 0:
                if not begin:
                    put("NEWLINE")
                begin = True
        elif kind == "id":
            put(w if w in words else "ID")
        elif kind == "num":
            nxt = text[m.end() : m.end() + 1]
            bad = re.fullmatch(r"0[\d_]*[1-9][\d_]*", w) or ((nxt.isalnum() or nxt == "_") and not _AFTER_NUMBER.match(text, m.end()))
            put("ERR" if bad else "NUM")
        elif kind == "op":
            if w in "([{":
                depth += 1
            elif w in ")]}":
                depth = max(0, depth - 1)
            put(w)
        pos = m.end()
    if kinds and kinds[-1] != "ERR":
        if depth == 0 and not begin:
            put("NEWLINE")
        if depth == 0:
            for _ in levels[1:]:
                put("DEDENT")
    return kinds, at, [False] * len(kinds)
