"""Source texts to rows: components and calls, routes, lines.

Python code is read by the standard library's parser, other languages by a walk over paired tokens (declarations),
endpoints by a table of frameworks over parsed annotations and calls (endpoints). All run in Arrow batches, one row
of files at a time; a file that cannot be read gives no rows.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.ids import clean_path
from loomline.functions.scalar import CODE_EXTENSIONS, canonicalize_path, language_of, lines_of, mq_route_key, route_key, url_to_path
from loomline.sources import declarations, endpoints

COMPONENT_SCHEMA = (
    "id string, name string, component_type string, relative_path string, start_line int, end_line int, language string, "
    "class_name string, qualified_name string, docstring string, parameters array<string>, base_classes array<string>, repo_name string, ord bigint"
)
CALL_SCHEMA = "caller string, callee string, call_line int, kind string, ord bigint"
ROUTE_SCHEMA = "protocol string, method string, raw_path string, role string, component_id string, repo_name string, file_path string, line_number int, framework string"


def _table(df: DataFrame, schema: str, scan: Callable[[str, str, str], Iterator[tuple]]) -> DataFrame:
    """Rows `scan(path, text, repo)` gives for each distinct file with a text."""
    names = [x.strip().split(" ")[0] for x in re.sub(r"<[^>]*>", "", schema).split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, repo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = list(scan(path, text, repo or path.split("/")[0]))
                except (SyntaxError, ValueError, RecursionError):
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    files = df.where("file_text is not null and relative_path is not null").select(clean_path("relative_path").alias("relative_path"), "file_text", "repo_name")
    return files.dropDuplicates(["relative_path"]).mapInArrow(run, schema)


# Python


class _PythonReader(ast.NodeVisitor):
    """Components, calls and base classes of one module; names are resolved to what was imported."""

    def __init__(self, path: str, repo: str):
        self.path, self.repo = path, repo
        self.module = re.sub(r"\.py$", "", path).replace("/", ".")
        self.stack: list[tuple[str, str]] = []
        self.components: list[tuple] = []
        self.calls: list[tuple] = []
        self.imports: dict[str, str] = {}
        self.receivers: list[dict[str, str]] = [{}]

    def _id(self) -> str:
        return f"{self.path}::{'.'.join(n for n, _ in self.stack)}"

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports[a.asname or a.name.split(".")[0]] = a.name

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.imports[a.asname or a.name] = f"{'.' * node.level}{node.module or ''}.{a.name}"

    def _enter(self, node, kind: str, parameters: list[str] | None, bases: list[str] | None) -> None:
        self.stack.append((node.name, kind))
        name = ".".join(n for n, _ in self.stack)
        owner = ".".join(n for n, k in self.stack[:-1] if k == "class") or None
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        self.components.append((
            self._id(), name, kind, self.path, first, node.end_lineno, "python", owner, f"{self.module}.{name}", ast.get_docstring(node),
            parameters, bases, self.repo, len(self.components),
        ))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in (_dotted(x) for x in node.bases) if b]
        self._enter(node, "class", None, bases)
        for b in bases:
            self.calls.append((self._id(), self.imports.get(b, b), node.lineno, "inherits", len(self.calls)))
        self.generic_visit(node)
        self.stack.pop()

    def _function(self, node) -> None:
        kind = "method" if self.stack and self.stack[-1][1] == "class" else "function"
        a = node.args
        names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]
        self._enter(node, kind, [n for n in names if n not in ("self", "cls")], None)
        self.receivers.append({})
        self.generic_visit(node)
        self.receivers.pop()
        self.stack.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call) and (made := _dotted(node.value.func)) and made.split(".")[-1][:1].isupper():
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.receivers[-1][t.id] = made
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if name and self.stack:
            head, _, rest = name.partition(".")
            if head in ("self", "cls") and rest:
                owner = next((n for n, k in reversed(self.stack) if k == "class"), None)
                name = f"{owner}.{rest}" if owner else rest
            elif rest and (made := next((r[head] for r in reversed(self.receivers) if head in r), None)):
                name = f"{made}.{rest}"
            elif head in self.imports:
                name = self.imports[head] + (f".{rest}" if rest else "")
            self.calls.append((self._id(), name.lstrip("."), node.lineno, "calls", len(self.calls)))
        self.generic_visit(node)


def _dotted(node: ast.expr) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return None


def _language(path: str) -> str | None:
    return CODE_EXTENSIONS.get("." + path.rsplit(".", 1)[-1].lower())


def _read(path: str, text: str, repo: str) -> tuple[list[tuple], list[tuple]]:
    language, body = _language(path), text.lstrip("\ufeff")
    if language == "python":
        reader = _PythonReader(path, repo)
        reader.visit(ast.parse(body))
        return reader.components, reader.calls
    return declarations.read(path, body, repo, language) if language in declarations.LANGUAGES else ([], [])


def components(files: DataFrame) -> DataFrame:
    """The components of source files: types, functions and methods with their lines, parameters and base classes.

    A name declared twice in a file gives the first one. Texts that do not parse (Python) give no rows.
    """
    return _table(files, COMPONENT_SCHEMA, lambda p, t, r: _first_of_id(_read(p, t, r)[0]))


def _first_of_id(rows: list[tuple]) -> Iterator[tuple]:
    seen: set[str] = set()
    for r in rows:
        if r[0] not in seen:
            seen.add(r[0])
            yield r


def calls(files: DataFrame) -> DataFrame:
    """The calls, creations and base classes that source files name: (caller, callee, call_line, kind, ord)."""
    return _table(files, CALL_SCHEMA, lambda p, t, r: iter(_read(p, t, r)[1]))


# routes

def _scan_routes(path: str, text: str, repo: str) -> Iterator[tuple]:
    language, body = _language(path), text.lstrip("\ufeff")
    if language != "python" and language not in declarations.LANGUAGES:
        return
    found = list(endpoints.endpoints(body, language))
    if not found:
        return
    try:
        spans = sorted((c[4], c[5], c[0], c[7] if c[2] == "method" else None, c[2]) for c in _read(path, text, repo)[0])
    except (SyntaxError, ValueError, RecursionError):
        spans = []
    functions = [c for c in spans if c[4] in ("function", "method")]
    breaks = [m.start() for m in re.finditer("\n", body)]
    prefixes: dict[str, str] = {}
    for protocol, method, raw, role, at, annotation, framework in found:
        line = bisect_right(breaks, at - 1) + 1
        # innermost: what begins last of all that hold the line
        holder = next((c for c in reversed(functions) if c[0] <= line <= c[1]), None)
        if role == "prefix":
            if owner := next((c for c in spans if c[4] not in ("function", "method") and c[0] <= line <= c[1]), None):
                prefixes[owner[2].rsplit("::", 1)[-1]] = raw
            continue
        cid = holder[2] if holder else f"{path}::unknown"
        if protocol == "http":
            if annotation and holder and holder[3] in prefixes:
                raw = prefixes[holder[3]].rstrip("/") + "/" + raw.lstrip("/") if raw else prefixes[holder[3]]
            raw = raw or "/"
            if not raw.startswith(("/", "http://", "https://", "$", "{") if role == "client" else "/"):
                raw = "/" + raw
        else:
            raw = raw or (cid.rsplit("::", 1)[-1].rsplit(".", 1)[-1] if holder else "")
            if not raw:
                continue
        yield (protocol, method, raw, role, cid, repo, path, line, framework)


def routes(files: DataFrame) -> DataFrame:
    """HTTP and message-queue routes of source files, keyed and with canonical paths."""
    raw = _table(files, ROUTE_SCHEMA, _scan_routes)
    http = F.col("protocol") == "http"
    path = F.regexp_replace(url_to_path("raw_path"), r"^\$?\{[^}]*\}(?=/)", "")
    return raw.select(
        F.when(http, route_key("method", path)).otherwise(mq_route_key("framework", "raw_path")).alias("route_key"), "protocol", "method",
        F.when(http, canonicalize_path(path)).otherwise(F.col("raw_path")).alias("path"), "role", "component_id", "repo_name", "file_path", "line_number", "framework",
        F.when(~http, F.create_map(F.lit("broker"), "framework", F.lit("topic"), "raw_path")).otherwise(F.create_map().cast("map<string,string>")).alias("extra"),
    )


# lines and files


def component_source(components: DataFrame, files: DataFrame) -> DataFrame:
    """The source of components by their lines in their files: (id, source)."""
    f = files.where("file_text is not null").select(clean_path("relative_path").alias("p"), "file_text").dropDuplicates(["p"])
    c = components.dropDuplicates(["id"]).select("id", "start_line", "end_line", clean_path("relative_path").alias("p"))
    return c.join(f, "p").select("id", lines_of("file_text", "start_line", "end_line").alias("source"))


def header_language(files: DataFrame) -> DataFrame:
    """Languages of header files: C++ where the text shows it or the repository has C++ files but no C ones, else C."""
    ext = F.lower(F.regexp_extract("relative_path", r"\.([^.]+)$", 1))
    has = files.groupBy("repo_name").agg(F.max(ext.isin("cpp", "cc", "cxx", "hpp").cast("int")).alias("cpp"), F.max((ext == "c").cast("int")).alias("c"))
    sign = F.coalesce(F.col("file_text").rlike(r"(?m)^\s*(?:class\s+\w+|namespace\s+\w+|template\s*<|using\s+namespace)|\bstd::|\b(?:public|private|protected):"), F.lit(False))
    h = files.where(ext == "h").join(has, "repo_name", "left")
    return h.select("repo_name", "relative_path", F.when(sign | ((F.col("cpp") == 1) & (F.col("c") == 0)), "cpp").otherwise("c").alias("language"))


#: Languages whose components can be read.
SUPPORTED = ("python", "javascript", "typescript", "java", "go", "c", "cpp", "csharp", "kotlin", "php")


def code_files(files: DataFrame) -> DataFrame:
    """Files with a code extension and their language: (repo_name, relative_path, language, supported)."""
    lang = language_of("relative_path")
    return files.select("repo_name", clean_path("relative_path").alias("relative_path"), lang.alias("language")).distinct().where("language is not null").withColumn("supported", F.col("language").isin(*SUPPORTED))
