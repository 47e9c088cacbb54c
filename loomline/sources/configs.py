"""Service boundaries and infrastructure from configuration files.

The input is a table of files (relative_path, file_text, repo_name); YAML is read in Arrow batches, the rest by
expressions on the file listing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.ids import clean_path
from loomline.functions.scalar import host_of, service_of_env_key
from loomline.operators.changes import without_nested

#: Folders that are no services, and folders whose children are.
NO_SERVICES = (
    "node_modules", ".venv", "venv", "__pycache__", ".git", ".idea", ".vscode", "dist", "build", "target", ".tox", ".mypy_cache", ".pytest_cache",
    "coverage", ".next", ".nuxt", "vendor", "test", "tests", "testing", "e2e", "docs", "doc", "scripts", "migrations", "fixtures", "mocks",
    "__mocks__",
)
CONVENTIONS = ("services", "apps", "microservices", "modules", "packages")
MANIFESTS = ("go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "package.json", "pyproject.toml", "setup.py", "Cargo.toml", "composer.json")
DEPTH = 3

INFRA_SCHEMA = "name string, source_file string, image string, build_path string, ports array<int>, depends_on array<string>, env_vars map<string,string>"


def _compose(path: str, text: str) -> Iterator[tuple]:
    import yaml

    data = yaml.safe_load(text)
    services = data.get("services") if isinstance(data, dict) else None
    for name, s in (services or {}).items():
        if not isinstance(s, dict):
            continue
        ports = []
        for p in s.get("ports") or []:
            p = p.get("published") or p.get("target") if isinstance(p, dict) else p
            m = re.match(r"^(?:\d+(?:\.\d+)+:)?(\d+)", str(p))
            if m:
                ports.append(int(m[1]))
        deps = s.get("depends_on") or []
        env = s.get("environment") or {}
        if isinstance(env, list):
            env = dict(str(x).split("=", 1) if "=" in str(x) else (str(x), "") for x in env)
        build = s.get("build")
        build = build.get("context") if isinstance(build, dict) else build
        yield (str(name), path, s.get("image"), build, ports, list(map(str, deps)), {str(k): "" if v is None else str(v) for k, v in env.items()})


def compose_services(files: DataFrame) -> DataFrame:
    """The services of docker-compose files: (name, source_file, image, build_path, ports, depends_on, env_vars).

    Files that are no YAML give no rows.
    """
    rows = files.where(F.lower(F.regexp_extract("relative_path", r"([^/]*)$", 1)).rlike(r"^(?:docker-)?compose[\w.-]*\.ya?ml$") & F.col("file_text").isNotNull())
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
    names = ["name", "source_file", "image", "build_path", "ports", "depends_on", "env_vars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += list(_compose(path, text))
                except (yaml.YAMLError, AttributeError, TypeError, ValueError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([list(r[i].items()) if i == 6 else r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return rows.select(clean_path("relative_path").alias("p"), "file_text").distinct().mapInArrow(run, INFRA_SCHEMA)


def env_entries(files: DataFrame) -> DataFrame:
    """Entries of .env and .properties files: (source_file, key, value), comments and exports aside, quotes removed."""
    name = F.lower(F.regexp_extract("relative_path", r"([^/]*)$", 1))
    rows = files.where(name.rlike(r"^\.env|\.env$|\.properties$") & F.col("file_text").isNotNull())
    line = F.explode(F.split("file_text", r"\r?\n"))
    kv = rows.select(clean_path("relative_path").alias("source_file"), line.alias("line")).where(~F.col("line").rlike(r"^\s*[#!]"))
    key = F.regexp_extract("line", r"^\s*(?:export\s+)?([\w.-]+)\s*[=:]\s*(.*?)\s*$", 1)
    value = F.regexp_replace(F.regexp_extract("line", r"^\s*(?:export\s+)?([\w.-]+)\s*[=:]\s*(.*?)\s*$", 2), r"^([\"'])(.*)\1$", "$2")
    return kv.select("source_file", key.alias("key"), value.alias("value")).where("key <> ''")


def service_urls(entries: DataFrame) -> DataFrame:
    """Services that configuration points to: (source_file, key, service, host)."""
    svc, host = service_of_env_key(F.regexp_replace("key", r"[.-]", "_")), host_of("value")
    return entries.select("source_file", "key", F.coalesce(svc, host).alias("service"), host.alias("host")).where(host.isNotNull() | svc.isNotNull())


def compose_edges(services: DataFrame) -> DataFrame:
    """Which service depends on which, declared or by a URL in its environment: (src, dst)."""
    declared = services.select(F.col("name").alias("src"), F.explode("depends_on").alias("dst"))
    by_url = services.select(F.col("name").alias("src"), F.explode("env_vars").alias("key", "value")).select("src", host_of("value").alias("dst"))
    names = services.select(F.col("name").alias("dst")).distinct()
    return declared.unionByName(by_url.where("dst is not null")).join(names, "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()


def detect_services(files: DataFrame) -> DataFrame:
    """Services of a repository by what their folders hold: (name, relative_path, source).

    In the order of trust: compose builds, Dockerfiles, build manifests, children of convention folders, Spring
    configuration; the first counts for a folder. Folders deeper than 3, excluded folders and services nested in
    others are left out.
    """
    listed = files.select(clean_path("relative_path").alias("p")).distinct()
    folder = F.regexp_extract("p", r"^(.*)/[^/]*$", 1)
    base = F.regexp_extract("p", r"([^/]*)$", 1)
    parts = F.split("p", "/")
    sign = lambda r, source, f: F.struct(F.lit(r).alias("r"), F.lit(source).alias("source"), f.alias("f"))
    signs = F.array(
        F.when(base.rlike(r"^Dockerfile"), sign(1, "dockerfile", folder)),
        F.when(base.isin(*MANIFESTS), sign(2, "manifest", folder)),
        F.when((F.size(parts) >= 3) & F.get(parts, 0).isin(*CONVENTIONS), sign(3, "convention", F.array_join(F.slice(parts, 1, 2), "/"))),
        F.when(F.col("p").rlike(r"src/main/resources/application\.(?:ya?ml|properties)$"), sign(4, "spring", F.regexp_replace("p", r"/?src/main/resources/[^/]*$", ""))),
    )
    held = listed.select(F.explode(F.filter(signs, lambda x: x.isNotNull())).alias("x")).select("x.*")
    where = F.concat(F.regexp_extract("source_file", r"^(.*/)?[^/]*$", 1), "build_path")
    composed = compose_services(files).where("build_path is not null").select(F.lit(0).alias("r"), F.lit("docker-compose").alias("source"), clean_path(where).alias("f"))
    best = held.unionByName(composed).groupBy(F.regexp_replace("f", r"/$", "").alias("f")).agg(F.min_by("source", F.struct("r", "source")).alias("source"))
    out = "|".join(re.escape(x) for x in NO_SERVICES)
    kept = best.where((F.col("f") != "") & ~F.col("f").rlike(rf"(?:^|/)(?:{out})(?:/|$)") & (F.size(F.split("f", "/")) <= DEPTH))
    return without_nested(kept.select(F.regexp_extract("f", r"([^/]*)$", 1).alias("name"), F.col("f").alias("relative_path"), "source"))
