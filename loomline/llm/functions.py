"""Functions and methods of source texts, paired with their documentation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.descriptions import description
from loomline.operators.skew import spread

#: How many lines may lie between a comment's last line and the signature (decorators aside).
LINE_DISTANCE = 0

_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|else|do|try|new|throw|function|await|typeof|with|super|synchronized|constructor\b(?!\())\b)"
SIGNATURES = {
    "py": re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*\("),
    "go": re.compile(r"^(?P<indent>[ \t]*)func[ \t]*(?:\([^)]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?\("),
    "java": re.compile(
        r"^(?P<indent>[ \t]*)(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*"
        r"(?:<[^>]+>[ \t]*)?(?:(?!(?:return|new|throw|else|case|package|import)\b)[\w.$]+(?:<[^;{}=()]*>)?(?:\[\])*[ \t]+)?" + _NOT_NAMES + r"(?P<name>[A-Za-z_$][\w$]*)[ \t]*\([^;{}=]*(?:\)[^;{}=]*\{|,?[ \t]*$)"
    ),
    "js": re.compile(
        r"^(?P<indent>[ \t]*)(?:(?:export|default|declare|public|private|protected|static|async|abstract|override|readonly|get|set)[ \t]+)*"
        r"(?:function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?:<[^>]*>)?[ \t]*\(|(?:const|let|var)[ \t]+(?P<name2>[\w$]+)[^=]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^)]*\)[^=]*=>|[\w$]+[ \t]*=>)"
        r"|\*?[ \t]*" + _NOT_NAMES + r"(?P<name3>#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^>]*>)?\([^;=]*\)[^;=]*\{[ \t]*$)"
    ),
    "rb": re.compile(r"^(?P<indent>[ \t]*)def[ \t]+(?P<name>[\w.?!=]+)"),
    "lua": re.compile(r"^(?P<indent>[ \t]*)(?:local[ \t]+)?function[ \t]+(?P<name>[\w.:]+)[ \t]*\("),
}
EXTENSIONS = {"py": "py", "pyi": "py", "go": "go", "java": "java", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "js", "tsx": "js", "rb": "rb", "lua": "lua"}
OPENS_END = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for|function|local function)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|\bfunction\s*\([^)]*\)\s*$|\bthen\s*$")
DECORATOR = re.compile(r"^\s*@[\w.]+")
DOCSTRING = re.compile(r'^\s*[rRuU]?("""|\'\'\')')
SHORT_DOCSTRING = re.compile(r"^\s*[rRuU]?(?:\"([^\"\\\n]*)\"|'([^'\\\n]*)')\s*$")


@dataclass
class Function:
    """A function with 1-based first and last line (signature to end), its code and its raw comments: the one above
    its signature and, in Python, the docstring below."""

    name: str
    start: int
    end: int
    code: str
    above: str
    below: str = ""

    @property
    def comment(self) -> str:
        return self.below or self.above


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())


STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#.*$|//.*$")


def _signature_end(lines: list[str], k: int, kind: str) -> int:
    """The line on which the parentheses of the signature that begins on line k close; k where they do not before the
    next signature."""
    depth, seen = 0, False
    for j in range(k, len(lines)):
        if j > k and SIGNATURES[kind].match(lines[j]):
            return k
        plain = STRINGS.sub("", lines[j])
        opens, closes = plain.count("("), plain.count(")")
        depth, seen = depth + opens - closes, seen or bool(opens)
        if seen and depth <= 0:
            return j
    return k


PY_STRING = re.compile(r"""#[^\n]*|\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\.|[^\\])*?(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", re.DOTALL)


def _quoted_lines(lines: list[str]) -> set[int]:
    """The lines that begin within a string of several lines (Python)."""
    text = "\n".join(lines)
    if '"""' not in text and "'''" not in text:
        return set()
    out: set[int] = set()
    at = line = 0
    for m in PY_STRING.finditer(text):
        if (n := m[0].count("\n")):
            line += text.count("\n", at, m.start())
            out.update(range(line + 1, line + n + 1))
            line, at = line + n, m.end()
    return out


def _body_end(lines: list[str], k: int, kind: str, quoted: set[int]) -> int:
    """The last line of the function whose signature begins on line k, by a stack of indentation or `end` words."""
    own, top = _indent(lines[k]), _signature_end(lines, k, kind)
    if kind in ("rb", "lua"):
        depth = 0
        for j in range(k, len(lines)):
            depth += bool(OPENS_END.search(lines[j]))
            depth -= bool(re.match(r"^\s*end\b", lines[j]) or re.search(r"\bend[)\s]*$", lines[j]) and not lines[j].strip().startswith("end"))
            if depth <= 0:
                return j
        return len(lines) - 1
    last = top
    for j in range(top + 1, len(lines)):
        line = lines[j]
        if kind == "py":
            if j in quoted:
                last = j
                continue
            if not line.strip():
                continue
            if _indent(line) <= own and not line.strip().startswith(("#", ")")):
                return last
            if _indent(line) > own:
                last = j
        else:
            if not line.strip():
                continue
            if _indent(line) <= own and line.strip()[0] in "})":
                return j
            last = j
    return last


def _comment_above(lines: list[str], k: int, distance: int) -> str:
    """The raw comment whose last line stands at most `distance` lines above line k, decorators not counted."""
    j = k - 1
    while j >= 0 and (top := _decorator_start(lines, j)) is not None:
        j = top - 1
    gap = 0
    while j >= 0 and not lines[j].strip() and gap < distance:
        j, gap = j - 1, gap + 1
    if j < 0:
        return ""
    x = lines[j].strip()
    if x.endswith("*/"):
        b = j
        while b >= 0 and "/*" not in lines[b]:
            b -= 1
        # a block that begins after code on its line belongs to that code
        return "\n".join(lines[b : j + 1]) if b >= 0 and lines[b].strip().startswith("/*") else ""
    mark = next((m for m in ("//", "#", "--") if x.startswith(m)), None)
    if mark is None or x.startswith("#!"):
        return ""
    b = j
    while b - 1 >= 0 and lines[b - 1].strip().startswith(mark):
        b -= 1
    return "\n".join(lines[b : j + 1])


def _decorator_start(lines: list[str], j: int) -> int | None:
    """The line on which the decorator begins that ends on line j, if one does."""
    if DECORATOR.match(lines[j]):
        return j
    if not lines[j].strip().endswith(")"):
        return None
    for b in range(j, -1, -1):
        if DECORATOR.match(lines[b]):
            return b
        if not lines[b].strip() or lines[b].strip().endswith((";", "{", "}", ":")):
            return None
    return None


def _docstring_below(lines: list[str], k: int) -> str:
    """The docstring that is the first statement of the Python function whose signature begins on line k."""
    j = _signature_end(lines, k, "py")
    tail = lines[j].rsplit(":", 1)[-1] if ":" in lines[j] else ""
    if DOCSTRING.match(tail) or SHORT_DOCSTRING.match(tail):
        return tail.strip()
    j += 1
    while j < len(lines) and (not lines[j].strip() or lines[j].strip().startswith("#")):
        j += 1
    if j >= len(lines):
        return ""
    m = DOCSTRING.match(lines[j])
    if not m:
        m = SHORT_DOCSTRING.match(lines[j])
        return (m[1] or m[2] or "") if m else ""
    quote = m.group(1)
    out = [lines[j]]
    if lines[j].count(quote) < 2:
        for line in lines[j + 1 :]:
            out.append(line)
            if quote in line:
                break
    return "\n".join(out)


def find_functions(text: str | None, extension: str, distance: int = LINE_DISTANCE) -> Iterator[Function]:
    """The functions of a source text, in order; none for a null text or an unknown extension."""
    kind = EXTENSIONS.get(extension.lower().lstrip("."))
    if not text or kind is None:
        return
    lines = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    quoted = _quoted_lines(lines) if kind == "py" else set()
    for k, line in enumerate(lines):
        if k in quoted:  # definitions quoted in strings are no definitions
            continue
        m = SIGNATURES[kind].match(line)
        if not m:
            continue
        groups = m.groupdict()
        name = groups.get("name") or groups.get("name2") or groups.get("name3") or ""
        end = _body_end(lines, k, kind, quoted)
        below = _docstring_below(lines, k) if kind == "py" else ""
        yield Function(name, k + 1, end + 1, "\n".join(lines[k : end + 1]), _comment_above(lines, k, distance), below)


def component_function(source: str | None, extension: str, name: str | None = None) -> Function | None:
    """The function that a component's source holds, which may begin with its comment: the first of the component's
    name, else the first of all, else the first line with a bracket, where no pattern knows the signature."""
    kind = EXTENSIONS.get(extension.lower().lstrip("."))
    if not source or kind is None:
        return None
    own, first = (name or "").rsplit(".", 1)[-1], None
    for f in find_functions(source, extension):
        if f.name == own:
            return f
        first = first or f
    if first is not None:
        return first
    lines = source.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for k, line in enumerate(lines):
        x = line.strip()
        if not x or x.startswith(("//", "#", "/*", "*", "@", "--")) or x.endswith("*/"):
            continue
        if "(" in x:
            return Function("", k + 1, len(lines), "\n".join(lines[k:]), _comment_above(lines, k, LINE_DISTANCE))
    return None


def documented_functions(components: DataFrame) -> DataFrame:
    """Functions and methods with documentation that says something: (id, code, description, found_in).

    The kind is `component_type`, or `node_type` where that is blank, in any letter case. Of each component's source
    the function is found by its signature, its body delimited (`code`) and its comments attached; documentation is
    the first that says something of the docstring column, the comment above the signature and the docstring below
    (`found_in` is docstring, above or below). See `description` for what says nothing. Null columns count as
    empty, `code` is the source as it is where it holds no function; repeated rows of an id give one row;
    `has_docstring` is not used.
    """
    kind = F.lower(F.trim(F.when(F.col("component_type").rlike(r"\S"), F.col("component_type")).otherwise(F.col("node_type"))))
    rows = components.where(kind.isin("function", "method")).select(
        "id", "name", "class_name", "parameters", "docstring", "source_code", F.coalesce("relative_path", "id").alias("path")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                known = [r["class_name"], *(r["parameters"] or [])]
                ext = (r["path"] or "").split("::")[0].strip().rsplit(".", 1)[-1]
                f = component_function(r["source_code"], ext, r["name"])
                comments = (("docstring", r["docstring"]), ("above", f.above if f else ""), ("below", f.below if f else ""))
                for where, raw in comments:
                    if said := description(raw, r["name"], known):
                        out.append((r["id"], f.code if f else r["source_code"], said, where))
                        break
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([x[i] for x in out], pa.string()) for i, n in enumerate(["id", "code", "description", "found_in"])}
            )

    return spread(rows).mapInArrow(run, "id string, code string, description string, found_in string").dropDuplicates(["id"])


def function_pairs(files: DataFrame) -> DataFrame:
    """Code and description of each documented function of whole files:
    (relative_path, name, start_line, end_line, code, description).

    Signatures are found by patterns, bodies delimited by indentation (or `end` words), comments attached by line
    distance. Files with a null path or text or an unknown extension give no rows; repeated rows of a file count once,
    of different texts of one path the greatest.
    """
    rows = files.where("file_text is not null and relative_path is not null").groupBy("relative_path").agg(F.max("file_text").alias("file_text"))
    names = ["relative_path", "name", "start_line", "end_line", "code", "description"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = [
                    (path, f.name, f.start, f.end, f.code, said)
                    for f in find_functions(text, path.rsplit(".", 1)[-1])
                    if (said := description(f.comment, f.name))
                ]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names
                )

    return rows.mapInArrow(
        run, "relative_path string, name string, start_line int, end_line int, code string, description string"
    )
