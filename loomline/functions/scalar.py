"""Scalar functions of the knowledge base as column expressions; none leaves the JVM.

Null arguments give null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    """A column by name, or the column itself."""
    return F.col(c) if isinstance(c, str) else c


# routes


#: How frameworks write a parameter: in a template string, after a colon, in braces or in angle brackets.
PLACEHOLDER = r"\$?\{[^}]+\}|<[^>]+>|:[A-Za-z_]\w*"


def canonicalize_path(path: Column | str) -> Column:
    """A URL path with each parameter placeholder as `{}`, without query, fragment, leading placeholder segment and
    trailing slash. Null and empty give `/`."""
    bare = F.regexp_replace(F.split(col(path), "[?#]", 2)[0], PLACEHOLDER, "{}")
    # a first segment that is a placeholder stands for a host or a base path; each step is used once, so that the
    # expression stays small where it is nested
    rest = F.regexp_replace(bare, r"\A/\{\}/?", "/")
    return F.coalesce(F.nullif(F.regexp_replace(rest, r"/+\z", ""), F.lit("")), F.lit("/"))


def route_key(method: Column | str, path: Column | str) -> Column:
    """The key under which an HTTP route is matched."""
    return F.concat(F.lit("__route__"), F.upper(col(method)), F.lit("__"), canonicalize_path(path))


def mq_route_key(broker: Column | str, topic: Column | str) -> Column:
    """The key under which a message-queue route is matched."""
    return F.concat(F.lit("__mq__"), F.lower(col(broker)), F.lit("__"), col(topic))


def url_to_path(url: Column | str) -> Column:
    """The path of a URL, a path itself unchanged; a bare host gives `/`."""
    u = col(url)
    stripped = F.regexp_extract(u, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(u.rlike(r"^[a-zA-Z][\w+.-]*://"), F.when(stripped == "", "/").otherwise(stripped)).otherwise(u)


def segments(path: Column | str) -> Column:
    """The non-empty segments of a path."""
    return F.filter(F.split(col(path), "/"), lambda s: s != "")


def path_matches_template(concrete: Column | str, template: Column | str) -> Column:
    """Whether a path agrees with a template segment by segment, `{}` standing for any one."""
    c, t = segments(concrete), segments(template)
    same = F.forall(F.zip_with(c, t, lambda x, y: (y == "{}") | (x == y)), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(c) == F.size(t)) & same


# hashes and ids


def content_hash(source: Column | str, name=None, start=None, end=None, params=None, deps=None) -> Column:
    """The first 16 digits of SHA-256 of a component's source or, where that is null or empty, of its name, lines,
    parameters and dependencies."""
    s = col(source)
    if name is None:
        return F.substring(F.sha2(s, 256), 1, 16)
    listed = lambda c: F.concat_ws(",", F.array_sort(F.coalesce(col(c), F.array().cast("array<string>"))))
    other = F.concat_ws("|", col(name), *(F.coalesce(col(c).cast("string"), F.lit("")) for c in (start, end)), listed(params), listed(deps))
    return F.substring(F.sha2(F.when(F.length(s) > 0, s).otherwise(other), 256), 1, 16)


def file_hash(content: Column | str) -> Column:
    """SHA-256 of the first 64 KB of binary content."""
    return F.sha2(F.substring(col(content).cast("binary"), 1, 65536), 256)


def fnv1a_32(text: Column | str) -> Column:
    """FNV-1a (32 bit) of a text's UTF-8 bytes as eight hexadecimal digits."""
    digits = F.hex(col(text).cast("binary"))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    h = F.aggregate(
        codes,
        F.lit(0x811C9DC5).cast("long"),
        lambda acc, b: F.pmod(acc.bitwiseXOR(b) * F.lit(0x01000193).cast("long"), F.lit(1 << 32).cast("long")),
    )
    return F.when(digits.isNotNull(), F.lpad(F.lower(F.hex(h)), 8, "0"))


def issue_id(kind: Column | str, page: Column | str) -> Column:
    """The stable id of an issue of a kind on a page."""
    return fnv1a_32(F.concat(col(kind), F.lit("::"), col(page)))


def repo_hash(url: Column | str) -> Column:
    """The cache key of a repository URL: 16 digits of SHA-256."""
    return F.substring(F.sha2(col(url), 256), 1, 16)


def slugify(title: Column | str) -> Column:
    """A title as a URL part of at most 60 characters; titles that leave fewer than 3 give 8 digits of their SHA-1."""
    t = col(title)
    s = F.regexp_replace(F.lower(F.trim(t)), r"[^\p{L}\p{N}\p{M}_\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), r"^-+|-+$", "")
    return F.when(F.length(s) < 3, F.substring(F.sha1(t.cast("binary")), 1, 8)).otherwise(
        F.when(F.length(s) > 60, F.regexp_replace(F.substring(s, 1, 60), r"-+$", "")).otherwise(s)
    )


def extract_tags(title: Column | str, body: Column | str, kind: Column | str) -> Column:
    """Up to 15 sorted tags: the kind, hashtags of title and body, camel-case names of the body's first 500 characters."""
    both = F.concat_ws(" ", col(title), col(body))
    hashes = F.transform(F.regexp_extract_all(both, F.lit(r"#([\p{L}\p{N}_]+)"), 1), F.lower)
    named = F.regexp_extract_all(F.coalesce(F.substring(col(body), 1, 500), F.lit("")), F.lit(r"\b[A-Za-z]+\b"), 0)
    camel = F.transform(F.filter(named, lambda w: w.rlike(r"^(?:[A-Z][a-z]+){2,}$")), F.lower)
    every = F.array_union(F.array(col(kind)), F.array_union(hashes, camel))
    return F.slice(F.array_sort(F.filter(F.array_distinct(every), lambda x: x.isNotNull())), 1, 15)


#: Older status words and their present ones.
LEGACY_STATUS = {"candidate": "draft", "confirmed": "stable", "rejected": "deprecated", "superseded": "deprecated"}


def norm_status(status: Column | str) -> Column:
    """A status in the present vocabulary; null and empty are drafts, unknown words stay."""
    s = F.lower(F.trim(col(status)))
    out = s
    for old, new in LEGACY_STATUS.items():
        out = F.when(s == old, new).otherwise(out)
    return F.when(col(status).isNull() | (col(status) == ""), "draft").otherwise(out)


def trust_tier(verified_by: Column | str) -> Column:
    """The trust a list of verifiers gives: unverified, machine-confirmed or human-reviewed."""
    v = col(verified_by)
    human = F.exists(v, lambda x: F.coalesce(x.startswith("human:"), F.lit(False)))
    return F.when(v.isNull() | (F.size(v) == 0), "unverified").when(human, "human-reviewed").otherwise("machine-confirmed")


def normalize_symbol(symbol: Column | str) -> Column:
    """A called symbol without padding, generics, arguments and leading `*`, `&` or `new`."""
    s = F.regexp_replace(F.trim(col(symbol)), r"^(?:new\s+|[*&]+)", "")
    s = F.regexp_replace(s, r"<[^<>]*>", "")
    return F.trim(F.regexp_replace(s, r"\((?s).*$", ""))


def package_of(qualified: Column | str, component_type: Column | str) -> Column:
    """The package of a dotted name: without the type, of a method without type and method; empty where there is none."""
    parts = F.split(col(qualified), r"\.")
    n = F.size(parts)
    drop = F.when((F.lower(col(component_type)) == "method") & (n >= 3), 2).otherwise(1)
    return F.when(n >= 2, F.array_join(F.slice(parts, 1, F.greatest(n - drop, F.lit(0))), ".")).otherwise("")


# documents


def extract_title(text: Column | str) -> Column:
    """The first level-one heading of the first 30 lines, its links unwrapped; null where there is none."""
    head = F.filter(F.slice(F.split(col(text), r"\r?\n"), 1, 30), lambda x: x.startswith("# "))
    title = F.trim(F.substring(F.get(head, 0), 3, 100_000))
    title = F.regexp_replace(title, r"\[\[([^\]|]*\|)?(?<label>[^\]|]+)\]\]", "${label}")
    return F.regexp_replace(title, r"\[([^\]]*)\]\([^)]*\)", "$1")


def front_matter(text: Column | str) -> Column:
    """The front matter of a page as text; empty where there is none."""
    return F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?s)\A\x{FEFF}?---\r?\n(.*?)\r?\n---\r?(?:\n|\z)", 1)


def without_front_matter(text: Column | str) -> Column:
    """A page without its front matter."""
    return F.regexp_replace(col(text), r"(?s)\A\x{FEFF}?---\r?\n.*?\r?\n---\r?(?:\n|\z)", "")


def front_matter_value(text: Column | str, key: str) -> Column:
    """A scalar of the front matter, without quotes; null where the key is missing or empty."""
    v = F.trim(F.regexp_extract(front_matter(text), rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1))
    v = F.regexp_replace(v, r"^([\"'])(.*)\1$", "$2")
    return F.when(v != "", v)


def front_matter_list(text: Column | str, key: str) -> Column:
    """A list of the front matter, written inline or as dashed lines; empty where the key is missing."""
    fm = front_matter(text)
    inline = F.regexp_extract(fm, rf"(?m)^{key}:[ \t]*\[(.*?)\][ \t]*$", 1)
    block = F.regexp_extract(fm, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|\z))+)", 1)
    lines = F.transform(F.split(block, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-[ \t]+", ""))
    items = F.when(inline != "", F.split(inline, ",")).otherwise(lines)
    clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"^[\"'](.*)[\"']$", "$1"))
    return F.filter(clean, lambda x: x != "")


def strip_code_blocks(text: Column | str) -> Column:
    """A page whose fenced code blocks are emptied; the number of lines stays."""
    parts = F.split(col(text), r"(?m)^(?=[ \t]*```)", -1)
    blank = lambda x: F.regexp_replace(x, r"[^\n]", "")
    # pieces begin at fences: an opening one is blanked whole, of the next (closing) only the fence line
    out = F.transform(
        parts,
        lambda x, i: F.when(~x.rlike(r"^[ \t]*```"), x)
        .when(i % 2 == F.when(F.get(parts, 0).rlike(r"^[ \t]*```"), 0).otherwise(1), blank(x))
        .otherwise(F.concat(blank(F.regexp_extract(x, r"^([^\n]*\n?)", 1)), F.regexp_replace(x, r"^[^\n]*\n?", ""))),
    )
    return F.array_join(out, "")


def summary(text: Column | str, length: int = 120) -> Column:
    """The first line of prose of a page, at most `length` characters; empty where there is none."""
    lines = F.filter(
        F.split(without_front_matter(text), r"\r?\n"),
        lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(?:#|>|\||```|---|!\[|<!--|[-*] )"),
    )
    first = F.trim(F.coalesce(F.get(lines, 0), F.lit("")))
    return F.when(F.length(first) > length, F.concat(F.substring(first, 1, length - 3), F.lit("..."))).otherwise(first)


def source_refs(text: Column | str) -> Column:
    """The distinct source names of a page's references `[^src:name:from-to]`."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\[\^src:([^:\]]+)(?::[^\]]*)?\]"), 1))


def wikilinks(text: Column | str) -> Column:
    """The targets of `[[target]]` and `[[target|label]]` in a page, trimmed, in order."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)
    return F.filter(F.transform(found, F.trim), lambda x: x != "")


def page_hrefs(text: Column | str) -> Column:
    """The targets of links to `.md` pages in a page, in order; other schemes and anchors alone are left out."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\[[^\]]*\]\(([^)\s]+?\.md(?:#[^)\s]*)?)\)"), 1)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"#.*$", "")), lambda x: ~x.rlike(r"^[a-z]+://"))


def mermaid_blocks(text: Column | str) -> Column:
    """The bodies of the fenced Mermaid blocks of a page."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?ms)^[ \t]*```mermaid[ \t]*\r?\n(.*?)^[ \t]*```"), 1)


def module_doc_name(module: Column | str) -> Column:
    """The file name of a module's page."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(col(module)), r"[\s/\\]+", "_"), r"[^\p{L}\p{N}_.-]", ""), F.lit(".md"))


def stale_date(since: Column | str, days: int = 90) -> Column:
    """The day from which a page of a date is stale."""
    return F.date_add(F.to_date(col(since)), days)


def is_stale(stale_after: Column | str, today: Column | str) -> Column:
    """Whether a date given as text lies before a day; text that is no date is never stale."""
    return F.coalesce(F.try_to_date(F.substring(col(stale_after), 1, 10), "yyyy-MM-dd") < F.to_date(col(today)), F.lit(False))


#: Page types and their folders.
PAGE_TYPE_DIRS = {"module": "modules", "entity": "entities", "concept": "concepts", "source": "sources", "comparison": "comparisons", "query": "queries"}


def page_type_dir(page_type: Column | str) -> Column:
    """The folder of a page type under the wiki; unknown types belong to the modules."""
    out = F.lit("modules")
    for kind, folder in PAGE_TYPE_DIRS.items():
        out = F.when(F.lower(F.trim(col(page_type))) == kind, folder).otherwise(out)
    return out


def page_depth(path: Column | str) -> Column:
    """How many folders lie above a page."""
    return F.size(segments(path)) - 1


def relative_link(from_page: Column | str, to_page: Column | str) -> Column:
    """The link from one page to another, both given from the root."""
    a, b = segments(from_page), segments(to_page)
    up = F.greatest(F.size(a) - 1, F.lit(0))
    n = F.aggregate(
        F.zip_with(F.slice(a, 1, up), b, lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct((acc["n"] + F.when(acc["on"] & same, 1).otherwise(0)).alias("n"), (acc["on"] & same).alias("on")),
    )["n"]
    n = F.least(n, F.size(b) - 1)
    return F.concat(F.repeat(F.lit("../"), up - n), F.array_join(F.slice(b, n + 1, F.size(b)), "/"))


# services


def service_of_env_key(key: Column | str) -> Column:
    """The service that a configuration key such as ORDER_SERVICE_URL names; null where it names none."""
    name = F.regexp_extract(F.upper(col(key)), r"^([A-Z][A-Z0-9_]*?)(?:_SERVICE)?_(?:URL|URI|HOST|ENDPOINT|ADDR|ADDRESS|BASE_URL|API_URL)$", 1)
    return F.when(name != "", F.lower(F.regexp_replace(name, "_", "-")))


def host_of(url: Column | str) -> Column:
    """The host of a URL; null where there is none."""
    h = F.regexp_extract(col(url), r"^[a-zA-Z][\w+.-]*://(?:[^@/]*@)?([^:/?#]+)", 1)
    return F.when(h != "", h)


def service_name(path: Column | str) -> Column:
    """The last segment of a service's folder."""
    return F.try_element_at(segments(path), F.lit(-1))


def json_list(text: Column | str) -> Column:
    """A JSON list of strings; null, broken or other JSON gives the empty list."""
    return F.coalesce(F.from_json(col(text), "array<string>"), F.array().cast("array<string>"))


def to_json_list(items: Column | str) -> Column:
    """A list as JSON text; null gives `[]`."""
    return F.coalesce(F.to_json(col(items)), F.lit("[]"))


# source text


def lines_of(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """The lines `start` to `end` (from 1, inclusive) of a text; the whole text where start is null or below 1."""
    parts = F.split(col(text), "\n", -1)
    s, e = col(start), col(end)
    n = F.greatest(F.coalesce(e, s) - s + 1, F.lit(0))
    return F.when(s.isNull() | (s < 1), col(text)).otherwise(F.array_join(F.slice(parts, F.greatest(s, F.lit(1)), n), "\n"))


def is_minified(text: Column | str) -> Column:
    """The size and line test for minified code: at least 4,096 characters and lines of 300 on average, or over
    10,240 with fewer than one line per 500, or fewer than 20 lines with one over 5,000. Null is not minified."""
    t = col(text)
    size = F.length(t)
    lines = F.split(t, "\n", -1)
    n = F.size(lines)
    longest = F.array_max(F.transform(lines, F.length))
    hit = (size / n > 300) | ((size > 10240) & (n < size / 500)) | ((n < 20) & (longest > 5000))
    return F.coalesce((size >= 4096) & hit, F.lit(False))


#: Extensions of code files and their languages.
CODE_EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".rs": "rust", ".go": "go", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".cs": "csharp",
}


def language_of(path: Column | str) -> Column:
    """The language of a path's extension; null for files that are no code."""
    ext = F.lower(F.regexp_extract(col(path), r"(\.[A-Za-z+]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in CODE_EXTENSIONS.items() for x in kv))
    return F.try_element_at(table, ext)


def clean_language(language: Column | str) -> Column:
    """A language as counted: trimmed, in lower case; null, blank, none and null give `unknown`."""
    x = F.lower(F.trim(col(language)))
    return F.when(x.isNull() | x.isin("", "none", "null", "unknown"), "unknown").otherwise(x)
