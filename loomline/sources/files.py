"""Files and pages from folders, and what selects among them."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.ids import clean_path
from loomline.functions.scalar import extract_title, front_matter, front_matter_list

#: Texts over this many bytes are not read.
MAX_BYTES = 2 * 1024 * 1024
#: Names and patterns left out by default.
EXCLUDES = (
    ".git", ".github", ".vscode", ".idea", ".gitignore", ".gitmodules", "examples", "*.pyc", "*.pyo", "*.pyd", "__pycache__", ".pytest_cache",
    ".coverage", ".tox", ".nox", ".mypy_cache", ".ruff_cache", ".hypothesis", "poetry.lock", "Pipfile.lock", "node_modules", "package-lock.json",
    "yarn.lock", ".npm", ".yarn", ".pnpm-store", "bower_components", "*.class", "*.jar", "*.war", "*.o", "*.obj", "*.so", "*.dylib", "*.dll", "*.exe",
    "*.lib", "*.a", "target", "dist", "build", "out", "venv", ".venv", "env", ".env", "*.egg-info", "*.egg", "*.whl", "*.min.js", "*.min.css",
    "*.map", "*.log", "*.bak", "*.swp", "*.tmp", ".DS_Store", "*.svg", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.pdf", "*.mov", "*.mp4",
    "*.mp3", "*.wav", "vendor", "bin", "obj", "*.sqlite", "*.db", "coverage",
)


def _inside(files: DataFrame, root: str) -> DataFrame:
    """Local files whose real path lies in the folder; other file systems have no links."""
    if not os.path.isdir(root):
        return files
    real = os.path.realpath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote, urlparse

        for batch in batches:
            paths = [os.path.realpath(unquote(urlparse(p).path)) for p in batch.column(0).to_pylist()]
            yield batch.filter(pa.array([os.path.commonpath([real, p]) == real for p in paths], pa.bool_()))

    listed = files.select("path").mapInArrow(run, "path string")
    return files.join(listed, "path", "left_semi")


def scan_files(spark: SparkSession, root: str, glob: str = "*", most_bytes: int = MAX_BYTES) -> DataFrame:
    """The files below a folder: (relative_path, size, mtime, content), content null over `most_bytes`.

    The listing and the reading are Spark's (any Hadoop file system). On a local file system files that links lead to
    outside the folder are left out: every listed path is resolved in the task that reads it.
    """
    df = _inside(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root), root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(os.path.abspath(root)) + "/", "")
    return df.select(rel.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


def decode(files: DataFrame) -> DataFrame:
    """Files with their text, bytes that are no UTF-8 replaced; too large ones have none."""
    return files.withColumn("file_text", F.when(F.col("content").isNotNull(), F.expr("decode(content, 'UTF-8')"))).drop("content")


def glob_regex(pattern: str) -> str:
    """A file glob as a regular expression for the JVM."""
    return re.sub(r"\\[zZ]$", "$", fnmatch.translate(pattern))


def matches_any(path: Column | str, patterns: Sequence[str]) -> Column:
    """Whether a path, its name, a folder it lies under or any segment fits one of the patterns."""
    p = clean_path(path)
    plain, globs, folders = [], [], []
    for x in (y.rstrip("/") for y in patterns):
        if re.search(r"[*?\[]", x):
            globs.append(glob_regex(x))
        elif "/" in x:
            folders.append(re.escape(x))
        else:
            plain.append(re.escape(x))
    # one expression for all patterns: a segment, a folder above, or a glob over the path or its name
    tests = [f"(?:^|/)(?:{'|'.join(plain)})(?:/|$)"] if plain else []
    tests += [f"^(?:{'|'.join(folders)})(?:/|$)"] if folders else []
    tests += [f"(?:^|^.*/)(?:{'|'.join(g.removesuffix('$') for g in globs)})$"] if globs else []
    return p.rlike("|".join(f"(?:{t})" for t in tests)) if tests else F.lit(False)


def select_files(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "relative_path") -> DataFrame:
    """Files that no exclude pattern (the defaults and `exclude`) fits and, if there are any, one of `include` does."""
    out = files.where(~matches_any(column, [*EXCLUDES, *exclude]))
    return out.where(matches_any(column, include)) if include else out


def ignored(files: DataFrame, rules: Sequence[tuple[str, str]], column: str = "relative_path") -> DataFrame:
    """Files with `ignored`: whether the last fitting rule of ignore files says so. `rules` are (folder of the ignore
    file, line) in the order of their precedence; a line that begins with `!` takes a file back."""
    p, state = F.col("__p"), F.lit(False)
    for folder, line in rules:
        x = line.rstrip()
        if not x or x.startswith("#"):
            continue
        back, x = x.startswith("!"), x.lstrip("!")
        only_dir, x = x.endswith("/"), x.rstrip("/")
        anchored = "/" in x
        body = re.sub(r"\\\*\\\*/", "(?:.*/)?", re.escape(x.lstrip("/")))
        body = re.sub(r"/\\\*\\\*", "/.*", body).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        under = f"{folder.strip('/')}/" if folder.strip("/") else ""
        rule = f"^{re.escape(under)}{'' if anchored else '(?:.*/)?'}{body}{'/.+' if only_dir else '(?:/.+)?'}$"
        state = F.when(p.rlike(rule), F.lit(not back)).otherwise(state)
    return files.select(clean_path(column).alias("__p")).distinct().select(p.alias(column), F.coalesce(state, F.lit(False)).alias("ignored"))


def directory_listing(files: DataFrame, folder: str = "") -> DataFrame:
    """The entries directly in a folder: (entry, kind, n_files, size)."""
    base = folder.strip("/")
    p = clean_path("relative_path")
    below = files.select(p.alias("p"), "size").distinct()
    if base:
        below = below.where(F.col("p").startswith(base + "/")).withColumn("p", F.substring("p", len(base) + 2, 100_000))
    entry = F.substring_index("p", "/", 1)
    kind = F.when(F.col("p").contains("/"), "folder").otherwise("file")
    return below.groupBy(entry.alias("entry"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("size"))


def file_lines(files: DataFrame, path: str, start: int = 1, most: int = 200) -> DataFrame:
    """Some lines of a file: (line_no, line)."""
    rows = files.where(clean_path("relative_path") == path).select("file_text").limit(1)
    lines = F.slice(F.split("file_text", "\n", -1), start, most)
    return rows.select(F.posexplode(lines).alias("n", "line")).select((F.col("n") + start).alias("line_no"), "line")


def git_repositories(files: DataFrame) -> DataFrame:
    """Immediate subfolders that hold a `.git`: (name)."""
    p = F.split(clean_path("relative_path"), "/")
    return files.where((F.size(p) >= 2) & (F.get(p, 1) == ".git")).select(F.get(p, 0).alias("name")).distinct()


#: Pages that are no content of the wiki.
SYSTEM_FILES = ("index.md", "log.md", "overview.md", "schema.yaml")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages of a wiki folder: (doc_key, source, title, text, tags, aliases, related_modules, fm).

    Wiki pages and pages at the root are docs, notes/*.md notes, raw/sources/*.{md,txt,rst} sources; system files are
    left out and what follows `<!-- crosslinks` is cut.
    """
    files = decode(scan_files(spark, root))
    p, name = F.lower("relative_path"), F.lower(F.regexp_extract("relative_path", r"([^/]*)$", 1))
    source = (
        F.when(p.rlike(r"^raw/sources/[^/]*\.(?:md|txt|rst)$"), "source").when(p.rlike(r"^notes/.*\.md$"), "note")
        .when(p.rlike(r"^wiki/.*\.md$") | p.rlike(r"^[^/]*\.md$"), "doc")
    )
    text = F.regexp_replace("file_text", r"(?s)<!-- crosslinks.*$", "")
    rows = files.select(F.col("relative_path").alias("doc_key"), source.alias("source"), text.alias("text"), name.alias("name")).where(F.col("source").isNotNull() & ~F.col("name").isin(*SYSTEM_FILES))
    return page_fields(rows.drop("name"))


def page_fields(pages: DataFrame) -> DataFrame:
    """Pages with what their front matter and headings say."""
    pairs = F.filter(F.split(front_matter("text"), r"\r?\n"), lambda x: x.rlike(r"^[\w-]+:[ \t]*\S"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^[\w-]+:[ \t]*(.*?)[ \t]*$", 1), r"^([\"'])(.*)\1$", "$2").alias("v")))
    last = F.filter(entries, lambda e: F.lit(True))
    fm = F.map_from_entries(F.filter(F.transform(last, lambda e, i: F.when(F.size(F.filter(F.slice(last, i + 2, F.greatest(F.size(last), F.lit(1))), lambda o: o["k"] == e["k"])) == 0, e)), lambda e: e.isNotNull()))
    return pages.select("*", extract_title("text").alias("title"), front_matter_list("text", "tags").alias("tags"), front_matter_list("text", "aliases").alias("aliases"), front_matter_list("text", "related_modules").alias("related_modules"), fm.alias("fm"))


def pages_of_documents(documents: DataFrame) -> DataFrame:
    """The knowledge base's documents as pages: the latest of each key, (doc_key, source, title, text, updated_at).

    Notes and raw sources keep their kind; every other source holds wiki pages (doc). Documents without text are left out.
    """
    kind = F.when(F.col("source").startswith("notes-"), "note").when(F.col("source") == "raw-sources", "source").otherwise("doc")
    rows = documents.where("text is not null and doc_key is not null")
    best = F.max_by(F.struct(kind.alias("source"), "title", "text", "updated_at"), F.struct("updated_at", "doc_id"))
    return rows.groupBy("doc_key").agg(best.alias("p")).select("doc_key", "p.*")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON side file (one object or a list of them)."""
    r = spark.read.option("multiLine", "true")
    return (r.schema(schema) if schema else r).json(path)


def flatten_tree(spark: SparkSession, path: str) -> DataFrame:
    """A module tree file as rows (module, path, parent, depth, preorder, component_id), one per component, or one with a
    null component for modules without any. The tree is one small file, read by the driver."""
    import json

    with open(path, encoding="utf-8") as f:
        tree = json.load(f)
    rows: list[tuple] = []
    n = 0

    def walk(level: dict, above: list[str]) -> None:
        nonlocal n
        for name, entry in level.items():
            at, n = n, n + 1
            for c in (entry or {}).get("components") or [None]:
                rows.append((name, [*above, name], above[-1] if above else None, len(above), at, c))
            walk((entry or {}).get("children") or {}, [*above, name])

    walk(tree, [])
    return spark.createDataFrame(rows, "module string, path array<string>, parent string, depth int, preorder int, component_id string")


def ontology(spark: SparkSession, text: str) -> DataFrame:
    """The synonym groups of an ontology file (YAML with lists of members): (group_id, member)."""
    import yaml

    groups = yaml.safe_load(text) or {}
    listed = groups.get("synonyms", groups) if isinstance(groups, dict) else groups
    rows = []
    items = listed.items() if isinstance(listed, dict) else enumerate(listed or [])
    for k, v in items:
        members = ([k] if isinstance(listed, dict) else []) + (list(v) if isinstance(v, list | tuple) else [v])
        rows += [(str(k), str(m)) for m in members if m is not None]
    return spark.createDataFrame(rows, "group_id string, member string")
