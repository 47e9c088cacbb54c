"""Components and calls of languages with braces, read from paired tokens by a walk over declarations.

One reader serves all languages; what differs (words that declare types and functions, where names and types of
parameters stand) is in `LANGUAGES`. A body is the bracket pair after a declaration's head, a documentation comment
the one right above it, a receiver's type what its declaration or creation says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from loomline.sources.tokens import MARK, Tokens, angle, arguments, comment_above, tokenize


@dataclass(frozen=True)
class Language:
    types: frozenset[str]
    function: str = ""  # the word that declares a function; without one, a name before a bracket and a body does
    name_first: bool = False  # parameters give the name before the type
    members: bool = False  # functions without the word stand in classes only
    package: str = ""
    own: frozenset[str] = frozenset()  # words before a bracket that call nothing


def _set(*words: str) -> frozenset[str]:
    return frozenset(words)


CONTROL = _set("if", "for", "while", "switch", "catch", "return", "else", "do", "try", "throw", "super", "this", "case", "in", "instanceof", "await", "yield", "delete", "typeof", "void", "new")
LANGUAGES = {
    "java": Language(_set("class", "interface", "enum", "record"), members=True, package="package", own=_set("synchronized", "assert")),
    "csharp": Language(_set("class", "interface", "enum", "struct", "record"), members=True, package="namespace", own=_set("using", "lock", "foreach", "fixed", "nameof", "typeof", "sizeof", "base", "checked", "unchecked", "when")),
    "javascript": Language(_set("class"), "function", name_first=True, members=True, own=_set("with", "constructor", "import", "require")),
    "typescript": Language(_set("class", "interface", "enum", "type", "namespace"), "function", name_first=True, members=True, own=_set("with", "constructor", "import", "require", "keyof")),
    "go": Language(_set("struct", "interface"), "func", name_first=True, own=_set("go", "defer", "select", "range", "make", "func")),
    "c": Language(_set("struct", "union", "enum"), own=_set("sizeof", "defined", "alignof")),
    "cpp": Language(_set("class", "struct", "union", "enum", "namespace"), own=_set("sizeof", "alignof", "decltype", "noexcept", "static_assert", "operator")),
    "kotlin": Language(_set("class", "interface", "object"), "fun", name_first=True, package="package", own=_set("when", "init", "constructor")),
    "php": Language(_set("class", "interface", "trait", "enum"), "function", package="namespace", own=_set("foreach", "elseif", "match", "isset", "empty", "array", "list", "echo", "unset", "fn", "declare")),
}
MODIFIERS = _set(
    "public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "open", "override", "virtual", "async", "export", "default", "declare", "readonly", "partial", "inline",
    "suspend", "data", "inner", "companion", "const", "unsafe", "synchronized", "native", "extern", "non", "annotation", "value", "typedef", "template", "constexpr", "explicit", "friend", "get", "set", "strictfp", "transient", "volatile", "required", "new", "operator", "infix", "tailrec", "lateinit",
)
BEFORE_NAMES = _set("private", "public", "protected", "readonly", "val", "var", "vararg", "noinline", "crossinline", "override", "this")
BEFORE_TYPES = _set("final", "const", "ref", "out", "in", "params", "this", "struct", "unsigned", "signed", "volatile", "register")
HERITAGE = _set("extends", "implements", "permits", "with")


@dataclass
class Declaration:
    first: int  # token of the first modifier or annotation
    head: int  # token of the name
    last: int  # token that ends it
    kind: str
    name: str
    parameters: list[str] | None = None
    bases: tuple[str, ...] = ()
    owner: str | None = None  # named by a receiver or qualifier
    body: int | None = None  # token of the opening bracket
    types: tuple[tuple[str, str], ...] = ()  # names and types of parameters


def _begin(t: Tokens, at: int) -> int:
    """The first token of the modifiers and annotations before a token."""
    while at > 0:
        if t.word[at - 1] in MODIFIERS:
            at -= 1
        elif t.word[at - 1] == ")" and (open_ := t.partner.get(at - 1)) and (k := _annotation(t, open_ - 1)) is not None:
            at = k
        elif t.word[at - 1] == "]" and (open_ := t.partner.get(at - 1)) is not None and (open_ == 0 or t.get(open_ - 1) in "{};#" or t.get(open_ - 1) == "]"):
            at = open_ - (t.get(open_ - 1) == "#")  # attributes in square brackets
        elif t.is_word(at - 1) and (k := _annotation(t, at - 1)) is not None:
            at = k
        elif t.word[at - 1] == ">" and (k := _angle_back(t, at - 1)) is not None and t.get(k - 1) == "template":
            at = k - 1
        else:
            break
    return at


def _annotation(t: Tokens, word: int) -> int | None:
    """The `@` of an annotation whose last word is given."""
    while t.is_word(word) and t.get(word - 1) == ".":
        word -= 2
    return word - 1 if t.is_word(word) and t.get(word - 1) == "@" else None


def _angle_back(t: Tokens, at: int) -> int | None:
    depth = 0
    for k in range(at, -1, -1):
        w = t.word[k]
        depth += (w == ">") - (w == "<")
        if depth == 0:
            return k
        if w in "{};":
            return None
    return None


def _names(t: Tokens, open_: int, language: Language) -> tuple[list[str], tuple[tuple[str, str], ...]]:
    """The parameters' names, and the types of those that give a plain one."""
    names, types = [], []
    for a, b in arguments(t, open_, True):
        words, k = [], a
        while k < b:
            w = t.word[k]
            if w in ("=", ":") and not (w == ":" and t.get(k + 1) == ":"):
                break
            if w == "@" or (w == "#" and t.get(k + 1) == "["):
                k = t.partner.get(k + 2, k + 1) if t.get(k + 2) == "(" else k + 1
            elif w == "<":
                k = max(k, angle(t, k) - 1)
            elif w in ("(", "[", "{") and k in t.partner:
                k = t.partner[k]
            elif t.is_word(k) and w not in (BEFORE_NAMES if language.name_first else BEFORE_TYPES):
                words.append(w)
            k += 1
        if not words or words == ["void"]:
            continue
        name = words[0] if language.name_first else words[-1]
        names.append(name.lstrip("$"))
        after = [t.word[j] for j in range(k + 1, b) if t.is_word(j)][:1] if language.name_first and k < b and t.word[k] == ":" else []
        kind = after or (words[1:2] if language.name_first else words[-2:-1])
        if kind:
            types.append((name.lstrip("$"), kind[0]))
    return names, tuple(types)


def _bases(t: Tokens, begin: int, end: int, colon: bool) -> tuple[str, ...]:
    """The types named after `extends`, `implements`, `permits` or a colon in the head of a type."""
    out, on, k = [], False, begin
    while k < end:
        w = t.word[k]
        if w in HERITAGE or (colon and w == ":"):
            on = True
        elif w == "<":
            k = max(k, angle(t, k) - 1)
        elif w == "(" and k in t.partner:
            k = t.partner[k]
        elif w == "where":
            break
        elif on and t.is_word(k) and w not in MODIFIERS and t.get(k + 1) not in (".", "::"):
            name = w
            j = k
            while t.get(j - 1) in (".", "\\") and t.is_word(j - 2):
                j -= 2
                name = f"{t.word[j]}.{name}"
            out.append(name)
        k += 1
    return tuple(out)


def _body_after(t: Tokens, k: int, stop: str = ";") -> int | None:
    """The opening brace of a body, or None where a mark of `stop`, a closing bracket or an assignment comes before."""
    while k < len(t):
        w = t.word[k]
        if t.kind[k] == MARK:
            if w == "{":
                return k if k in t.partner else None
            if w in stop or w in "})]=":
                return None
            if w in "([" and k in t.partner:
                k = t.partner[k]
        k += 1
    return None


def declarations(t: Tokens, language_name: str) -> list[Declaration]:
    """All declarations of types and functions in the order of the text, nested ones included."""
    language, out = LANGUAGES[language_name], []
    n = len(t)
    inside: list[tuple[int, str]] = []  # closing token, kind of what is open
    opened: dict[int, str] = {}
    for k in range(n):
        while inside and inside[-1][0] <= k:
            inside.pop()
        if k in opened:
            inside.append((t.partner[k], opened[k]))
        elif t.word[k] == "{" and t.kind[k] == MARK and k in t.partner:
            inside.append((t.partner[k], "block"))
        w = t.word[k]
        if not t.is_word(k) or t.get(k - 1) in (".", "->", "?.") or (t.get(k - 1) == "::" and language_name != "cpp"):
            continue
        found = None
        if language_name == "go":
            if w == "type" and t.is_word(k + 1):
                j = t.partner.get(k + 2, k + 1) + 1 if t.get(k + 2) == "[" else k + 2
                if t.get(j) in language.types:
                    body = _body_after(t, j + 1)
                    embedded = _embedded(t, body) if body is not None else ()
                    found = Declaration(k, k + 1, t.partner.get(body, j), t.word[j], t.word[k + 1], None, embedded, None, body)
        elif w in language.types and t.is_word(k + 1) and t.get(k + 1) not in ("extends", "implements", "is") and not (w in ("type", "record", "value") and t.get(k - 1) not in "{};" and t.get(k - 1) not in MODIFIERS):
            head = k + 1
            if w == "enum" and t.word[head] in ("class", "struct"):
                head += 1
            if t.is_word(head):
                found = _type(t, k, head, w, language_name)
        if found is None and language.function and w == language.function:
            found = _function(t, k, language_name, language)
        elif found is None and t.get(k + 1) == "(" or (found is None and t.get(k + 1) == "<" and t.get(angle(t, k + 1)) == "("):
            scope = inside[-1][1] if inside else "file"
            if w not in CONTROL and w not in language.own - {"constructor"} and w not in language.types and (scope == "type" if language.members else scope in ("file", "type")) and (language_name not in ("kotlin", "go", "php")):
                found = _member(t, k, language_name, language)
        elif found is None and w in ("const", "let", "var") and language_name in ("javascript", "typescript") and t.is_word(k + 1):
            found = _assigned(t, k, language)
        if found:
            out.append(found)
            if found.body is not None:
                opened[found.body] = "type" if found.kind not in ("function", "method") else "function"
    return out


def _embedded(t: Tokens, body: int) -> tuple[str, ...]:
    """The types that a Go struct or interface embeds: lines of one name."""
    out, k = [], body + 1
    while k < t.partner[body]:
        line, words = t.line(k), []
        while k < t.partner[body] and t.line(k) == line:
            words.append(k)
            k = t.partner[k] + 1 if t.word[k] in ("{", "(", "[") and k in t.partner else k + 1
        names = [t.word[j] for j in words if t.is_word(j)]
        marks = [t.word[j] for j in words if t.kind[j] == MARK]
        if names and set(marks) <= {"*", "."} and len(names) == 1 + marks.count("."):
            out.append(".".join(names))
    return tuple(out)


def _type(t: Tokens, k: int, head: int, word: str, language_name: str) -> Declaration | None:
    first = _begin(t, k)
    j = angle(t, head + 1)
    if word == "type":
        while j < len(t) and t.word[j] != ";" and not (t.line(j) > t.line(j - 1) and t.get(j) in ("export", "type", "interface", "class", "const", "function")):
            j = t.partner[j] if t.word[j] in "({[" and j in t.partner else j
            j += 1
        return Declaration(first, head, min(j, len(t) - 1), word, t.word[head])
    while t.get(j) in (".", "::") and t.is_word(j + 1) and word == "namespace":
        j += 2
    body = _body_after(t, j, ";=")
    if language_name in ("c", "cpp") and (body is None or any(t.word[i] in ("(", "*", "=") for i in range(j, body))):
        return None
    if language_name == "kotlin" and body is not None and t.line(body) > t.line(head) + 1 and not any(t.word[i] in (":", "(") for i in range(j, body)):
        body = None
    if body is None and language_name not in ("kotlin", "java", "csharp"):
        return None
    end = body if body is not None else j - 1
    if body is None and t.get(j) == "(" and j in t.partner:
        end = t.partner[j]
    kind = "abstract class" if word == "class" and language_name == "java" and "abstract" in t.word[first:k] else word
    bases = _bases(t, head + 1, end, language_name in ("csharp", "kotlin", "cpp", "php"))
    if body is None and language_name == "csharp" and word != "record":
        return None
    return Declaration(first, head, t.partner[body] if body is not None else end, kind, t.word[head], None, bases, None, body)


def _function(t: Tokens, k: int, language_name: str, language: Language) -> Declaration | None:
    first, j, owner = _begin(t, k), k + 1, None
    if language_name == "go" and t.get(j) == "(" and j in t.partner:
        words = [t.word[i] for i in range(j + 1, t.partner[j]) if t.is_word(i)]
        receiver = (words[0], words[1]) if len(words) > 1 else None
        owner, j = (words[1] if len(words) > 1 else words[0] if words else None), t.partner[j] + 1
    else:
        receiver = None
    j = angle(t, j)
    while t.get(j) in ("*", "&"):
        j += 1
    if language_name == "kotlin":
        while t.is_word(j) and (t.get(j + 1) == "." or t.get(angle(t, j + 1)) == "."):
            j = angle(t, j + 1) + 1
    if not t.is_word(j):
        return None
    head = j
    j = t.partner.get(j + 1, j) + 1 if language_name == "go" and t.get(j + 1) == "[" else angle(t, j + 1)
    if t.get(j) != "(" or j not in t.partner:
        return None
    names, types = _names(t, j, language)
    types = (*types, receiver) if receiver else types
    after = t.partner[j] + 1
    body = _go_body(t, after) if language_name == "go" else _body_after(t, after, ";")
    last = t.partner[body] if body is not None else t.partner[j]
    if language_name == "kotlin" and body is None:  # a body of one expression ends with its line
        last = t.partner[j]
        while last + 1 < len(t) and (t.line(last + 1) == t.line(head) or t.word[last + 1] in (".", "?.", ")", "=")):
            last = t.partner[last + 1] if t.word[last + 1] in "({[" and last + 1 in t.partner else last + 1
    return Declaration(first, head, last, "function", t.word[head], names, (), owner, body, types)


def _go_body(t: Tokens, k: int) -> int | None:
    """A Go body's brace, which is not that of an interface or struct type among the results."""
    line = t.line(k - 1)
    while k < len(t) and (t.line(k) == line or t.word[k - 1] in ("(", ",")):
        if t.word[k] in ("(", "[") and k in t.partner:
            k = t.partner[k]
            line = t.line(k)
        elif t.word[k] == "{" and k in t.partner:
            if t.word[k - 1] not in ("interface", "struct"):
                return k
            k = t.partner[k]
        k += 1
    return None


def _member(t: Tokens, k: int, language_name: str, language: Language) -> Declaration | None:
    """A function declared by its name, parameters and body, with what its language puts before and after them."""
    open_ = angle(t, k + 1)
    if open_ not in t.partner:
        return None
    after = t.partner[open_] + 1
    owner, head, name = None, k, t.word[k]
    before = t.get(k - 1)
    if language_name == "cpp":
        if before == "~":
            name, k = f"~{name}", k - 1
        while t.get(k - 1) == "::" and t.is_word(k - 2):
            owner, k = f"{t.word[k - 2]}.{owner}" if owner else t.word[k - 2], k - 2
        before = t.get(k - 1)
    if language_name in ("javascript", "typescript"):
        body = _body_after(t, after, ";" if t.get(after) in (":", "{") else ";,")
        if before == "#":
            name = f"#{name}"
        if body is None or t.get(after) not in ("{", ":") or before in ("=", "(", ",", "?", "=>", "return"):
            return None
        first = _begin(t, k - 1 if before in ("#", "*") else k)
    else:
        typed = t.is_word(k - 1) and (before == "void" or before not in CONTROL) and before != "new" or before in (">", "]", "*", "&", "?")
        made = language_name in ("java", "csharp", "cpp") and (before in "{};" or (before in MODIFIERS and before != "new") or before in (")", ":", "]", "~"))
        if not (typed or made):
            return None
        body = _body_after(t, after, ";")
        if body is None and (language_name not in ("java", "csharp") or t.get(after) not in (";", "=>", "throws")):
            return None
        if language_name in ("c", "cpp") and any(t.word[i] == "(" and t.get(i - 1) not in ("noexcept", ")") and not (t.is_word(i - 1)) for i in range(after, body)):
            return None
        i = k  # back over the return type
        while i > 0 and t.word[i - 1] not in "{};:" and t.word[i - 1] not in MODIFIERS and t.word[i - 1] not in (")", "@"):
            if t.word[i - 1] == ">" and (b := _angle_back(t, i - 1)) is not None:
                i = b
            elif t.word[i - 1] == "]" and i - 1 in t.partner:
                if t.get(t.partner[i - 1] - 1) in "{};]":
                    break
                i = t.partner[i - 1]
            elif t.is_word(i - 1) and _annotation(t, i - 1) is not None:
                break
            else:
                i -= 1
        first = _begin(t, i)
    names, types = _names(t, open_, language)
    last = t.partner[body] if body is not None else after
    while body is None and last < len(t) - 1 and t.word[last] != ";":
        last += 1
    return Declaration(first, head, last, "function", name, names, (), owner, body, types)


def _assigned(t: Tokens, k: int, language: Language) -> Declaration | None:
    """A function that a variable of a script holds."""
    j = k + 2
    if t.get(j) == ":":
        while j < len(t) and t.word[j] not in ("=", ";"):
            j = t.partner[j] if t.word[j] in "({[" and j in t.partner else j
            j += 1
    if t.get(j) != "=":
        return None
    j += 1 + (t.get(j + 1) == "async")
    arrow = t.get(j) != "function"
    if not arrow:
        j += 1 + (t.get(j + 1) == "*")
        j += t.is_word(j)
    j = angle(t, j)
    if t.is_word(j) and t.get(j + 1) == "=>":
        names, types, after = [t.word[j]], (), j + 1
    elif t.get(j) == "(" and j in t.partner:
        names, types = _names(t, j, language)
        after = t.partner[j] + 1
    else:
        return None
    while after < len(t) and t.word[after] not in ("=>", "{", ";", "=", ",", ")") and arrow:
        after = t.partner[after] + 1 if t.word[after] in "([<" and after in t.partner else after + 1
    if arrow and t.get(after) != "=>":
        return None
    body = after + 1 if arrow and t.get(after + 1) == "{" else after if not arrow and t.get(after) == "{" else None
    if body is not None and body not in t.partner:
        return None
    last = t.partner[body] if body is not None else after
    while body is None and last < len(t) - 1 and t.word[last] != ";" and t.line(last + 1) == t.line(after):
        last += 1
    return Declaration(_begin(t, k), k + 1, last, "function", t.word[k + 1], names, (), None, body, types)


def _calls(t: Tokens, begin: int, end: int, language: Language) -> Iterator[tuple[int, str, bool]]:
    """(token, dotted name, whether it creates) of each call between two tokens."""
    for k in range(begin, end):
        if t.word[k] != "(" or t.kind[k] != MARK:
            continue
        j = k - 1
        if t.get(j) == ">" and (b := _angle_back(t, j)) is not None:
            j = b - 1
        if not t.is_word(j):
            continue
        name, first = t.word[j], j
        while t.get(first - 1) in (".", "->", "::", "?.") and (t.is_word(first - 2)):
            first -= 2
            name = f"{t.word[first]}.{name}"
        head = name.split(".")[0]
        if t.get(first - 1) in (".", "->", "?.") or (head in CONTROL and head not in ("this", "super")) or name in language.own or t.get(first - 1) in (language.function or "\0", "@"):
            if t.get(first - 1) in (".", "->", "?."):  # called on a result: only its own name is known
                yield first, t.word[j], False
            continue
        if name in ("this", "super"):
            continue
        yield first, name.replace("$this.", "this."), t.get(first - 1) == "new"


def _receivers(t: Tokens, begin: int, end: int, language: Language) -> dict[str, str]:
    """Types of variables as their declarations or creations between two tokens tell."""
    out: dict[str, str] = {}
    for k in range(begin, end):
        if t.word[k] not in ("=", ":=") or not t.is_word(k - 1):
            continue
        j = k + 1 + (t.get(k + 1) in ("new", "&", "await"))
        made = t.get(k + 1) == "new" or t.get(j + 1) == "{" or (t.get(j + 1) == "(" and language.function in ("fun", "func"))
        if t.is_word(j) and t.word[j][:1].isupper() and made:
            out[t.word[k - 1].lstrip("$")] = t.word[j]
        elif t.get(k - 2) == ":" and t.is_word(k - 3):
            out[t.word[k - 3]] = t.word[k - 1]
        elif not language.name_first and t.is_word(k - 2) and t.word[k - 2][:1].isupper():
            out[t.word[k - 1].lstrip("$")] = t.word[k - 2]
    return out


def read(path: str, text: str, repo: str, language_name: str) -> tuple[list[tuple], list[tuple]]:
    """Components and calls of a text, as `loomline.sources.code` lists them."""
    language, t = LANGUAGES[language_name], tokenize(text, language_name)
    module = path.rsplit(".", 1)[0].replace("/", ".")
    prefix = module
    if language.package:
        for k in range(len(t)):
            if t.word[k] == language.package and t.is_word(k + 1) and t.get(k - 1) in ("", ";", "?>", "php", "}"):
                j = k + 1
                while t.get(j + 1) in (".", "\\") and t.is_word(j + 2):
                    j += 2
                prefix = "".join(t.word[k + 1 : j + 1]).replace("\\", ".")
                break
    components: list[tuple] = []
    calls: list[tuple] = []
    open_: list[tuple[int, str, str]] = []
    bodies: list[tuple[Declaration, str, str | None]] = []
    fields: dict[str | None, dict[str, str]] = {}
    for d in declarations(t, language_name):
        while open_ and open_[-1][0] < d.first:
            open_.pop()
        function = d.kind == "function"
        if function and any(k in ("function", "method") for _, _, k in open_):
            continue
        above = ".".join(n for _, n, k in open_ if k not in ("function", "method")) or d.owner
        spaced = bool(open_) and open_[-1][2] == "namespace" and not d.owner
        kind = "method" if function and above and not spaced else d.kind
        full = f"{above}.{d.name}" if above else d.name
        cid = f"{path}::{full}"
        components.append((
            cid, full, kind, path, t.line(d.first), t.line(d.last), language_name, above if kind == "method" else None, f"{prefix}.{full}", comment_above(t, d.first),
            d.parameters, list(d.bases) or None, repo, len(components),
        ))
        calls += [(cid, b, t.line(d.head), "inherits", 0) for b in d.bases]
        open_.append((d.last, d.name, kind))
        if function:
            bodies.append((d, cid, above))
            if d.name in ("constructor", "__construct") and above:
                fields.setdefault(above, {}).update(d.types)
        elif d.body is not None:
            fields.setdefault(full, {}).update(_receivers(t, d.body, d.last, language))
    for d, cid, above in bodies:
        known = {**fields.get(above, {}), **dict(d.types), **(_receivers(t, d.body, d.last, language) if d.body is not None else {})}
        own = {x for x, y in d.types if y == d.owner} if d.owner else set()
        start = d.body if d.body is not None else d.head + 1
        for at, name, creates in _calls(t, start + 1 if d.body is None else start, d.last, language):
            head, _, rest = name.partition(".")
            if head in ("this", "self") or head in own:
                name = f"{above}.{rest}" if above and rest else rest or head
                rest_head = rest.split(".")[0]
                if "." in rest and rest_head in known:
                    name = f"{known[rest_head]}.{rest.split('.', 1)[1]}"
            elif rest and head.lstrip("$") in known:
                name = f"{known[head.lstrip('$')]}.{rest}"
            calls.append((cid, name, t.line(at), "creates" if creates else "calls", 0))
    return components, [(*c[:4], k) for k, c in enumerate(calls)]
