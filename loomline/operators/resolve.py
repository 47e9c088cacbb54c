"""Resolving names, files and mentions to components and modules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.ids import clean_path
from loomline.functions.scalar import clean_language, col, package_of
from loomline.operators.skew import salted_join


def dedup_calls(calls: DataFrame) -> DataFrame:
    """The first call of each (caller, callee) by `ord`: (caller, callee, call_line, is_resolved, ord)."""
    first = F.min_by(F.struct("call_line", "is_resolved", "ord"), F.struct("ord", "call_line"))
    return calls.where("caller is not null and callee is not null").groupBy("caller", "callee").agg(first.alias("f")).select("caller", "callee", "f.*")


def _keys(functions: DataFrame) -> DataFrame:
    """(index, key, lang, id) of all names a function is found by: exact names, and simple ones with their tails."""
    tail = lambda c, sep: F.substring_index(c, sep, -1)
    parts = F.split("qualified_name", r"\.")
    names = F.array("name", tail(F.col("id"), "::"), tail(F.col("qualified_name"), "."), F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")))
    simple = F.array_union(names, F.transform(names, lambda x: F.substring_index(x, ".", -1)))
    exact = F.array("id", "qualified_name", "name")
    listed = F.concat(
        F.transform(exact, lambda k: F.struct(F.lit("exact").alias("ix"), k.alias("key"))),
        F.transform(simple, lambda k: F.struct(F.lit("simple").alias("ix"), k.alias("key"))),
    )
    rows = functions.select("id", clean_language("language").alias("lang"), F.explode(F.array_distinct(listed)).alias("k"))
    return rows.select("id", "lang", "k.ix", "k.key").where("key is not null and key <> ''")


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """The component each call leads to: (caller, callee, ord, target, step), target null where it is not resolved.

    Within the caller's language first, then globally (a match in another language is refused where the caller's is
    known), names are tried in the order: exact, exact and simple name after `::`, simple dotted name and its last
    part, a class of the caller's package (Java, C#), simple name. A name resolves only if one component has it.
    Each call's candidate names are exploded with their rank and joined once with the unique names; the least rank wins.
    """
    keys = _keys(functions.dropDuplicates(["id"]))
    unique = keys.groupBy("ix", "key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target"), F.min("lang").alias("target_lang")).where("n = 1")
    local = keys.groupBy("ix", "key", "lang").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).where("n = 1")
    index = local.select(F.concat("lang", F.lit(":"), "ix").alias("ix"), "key", "target", F.col("lang").alias("target_lang")).unionByName(
        unique.select(F.concat(F.lit("*:"), "ix").alias("ix"), "key", "target", "target_lang")
    )
    who = functions.dropDuplicates(["id"]).select(F.col("id").alias("caller"), clean_language("language").alias("lang"), package_of("qualified_name", "component_type").alias("package"))
    rows = salted_join(calls.select("caller", "callee", "ord"), who, ["caller"], "left")
    callee = F.col("callee")
    after = F.when(callee.contains("::"), F.substring_index(callee, "::", -1))
    dotted = F.when(callee.contains("."), callee)
    inside = F.when(F.col("lang").isin("java", "csharp") & ~callee.contains(".") & (F.col("package") != ""), F.concat("package", F.lit("."), callee))
    steps = [("exact", callee), ("exact", after), ("simple", after), ("simple", dotted), ("simple", F.substring_index(dotted, ".", -1)), ("exact", inside), ("simple", callee)]
    tried = []
    for base, scope in ((0, F.when(F.col("lang") != "unknown", F.col("lang"))), (len(steps), F.lit("*"))):
        for k, (ix, key) in enumerate(steps):
            tried.append(F.struct(F.lit(base + k).alias("rank"), F.concat(scope, F.lit(f":{ix}")).alias("ix"), key.alias("key")))
    asked = rows.select("caller", "callee", "ord", "lang", F.explode(F.filter(F.array(*tried), lambda t: t["ix"].isNotNull() & t["key"].isNotNull())).alias("t"))
    hits = salted_join(asked.select("caller", "callee", "ord", "lang", "t.rank", "t.ix", "t.key"), index, ["ix", "key"], "inner")
    best = hits.groupBy("caller", "callee", "ord").agg(F.min(F.struct("rank", "target", "target_lang", "lang")).alias("b"))
    known = F.coalesce(F.col("b.lang") != "unknown", F.lit(False)) & (F.col("b.target_lang") != "unknown")
    ok = ~(known & (F.col("b.target_lang") != F.col("b.lang")))
    found = best.select("caller", "callee", "ord", F.when(ok, F.col("b.target")).alias("target"), F.when(ok, F.col("b.rank")).alias("step"))
    return calls.select("caller", "callee", "ord").join(found, ["caller", "callee", "ord"], "left")


def call_edges(resolved: DataFrame, components: DataFrame) -> DataFrame:
    """Edges (src, dst) of calls: the resolved target or, without one, the first component (by `ord`) of that name;
    calls to names no component has are left out."""
    first = components.where("name is not null").groupBy("name").agg(F.min_by("id", F.struct("ord", "id")).alias("named"))
    rows = salted_join(resolved.select("caller", F.col("callee").alias("name"), "target"), first, ["name"], "left")
    return rows.select(F.col("caller").alias("src"), F.coalesce("target", "named").alias("dst")).where("src is not null and dst is not null").distinct()


def external_callee(callee: Column | str, language: Column | str, builtins: Sequence[str] = ()) -> Column:
    """Why a callee is outside the repository: macro, builtin, standard library or unknown; null for component ids.

    Macros are upper-case names of C and C++; `builtins` are names of the language's own.
    """
    name = col(callee)
    lang = clean_language(language)
    std = (
        (lang.isin("python") & name.rlike(r"^(?:os|sys|re|json|math|time|logging|pathlib|collections|itertools|functools|typing|datetime|subprocess|threading|asyncio|abc|io|copy|random|string|struct|hashlib|shutil)\."))
        | (lang.isin("java") & name.rlike(r"^(?:java|javax|jdk|sun|org\.w3c|org\.xml)\."))
        | (lang.isin("csharp") & name.rlike(r"^(?:System|Microsoft)\."))
        | (lang.isin("go") & name.rlike(r"^(?:fmt|errors|strings|strconv|os|io|time|sync|context|net|bytes|sort|log|math|bufio|json|http)\."))
        | (lang.isin("javascript", "typescript") & name.rlike(r"^(?:console|Math|JSON|Promise|Object|Array|String|Number|Date|Reflect|Symbol|process|Buffer|window|document)\."))
        | (lang.isin("cpp", "c") & name.rlike(r"^std::"))
    )
    macro = lang.isin("c", "cpp") & name.rlike(r"^[A-Z][A-Z0-9_]{2,}$")
    return F.when(name.contains("::") & ~name.startswith("std::"), None).when(macro, "macro").when(name.isin(*builtins) if builtins else F.lit(False), "builtin").when(std, "stdlib").otherwise("unknown")


def suffix_match(components: DataFrame, files: DataFrame) -> DataFrame:
    """Components of files given by any part of their path: (file, id).

    Paths agree if they are equal or one is a `/`-suffix of the other. Either side's suffixes are exploded and joined
    by equality, so no pair is compared in a loop.
    """
    def tails(c: str) -> Column:
        parts = F.filter(F.split(clean_path(c), "/"), lambda s: s != "")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    c = components.select("id", clean_path("relative_path").alias("p")).where("p <> ''").distinct()
    f = files.select("file", clean_path("file").alias("f")).where("f <> ''").distinct()
    down = c.select("id", F.explode(tails("p")).alias("f")).join(f, "f").select("file", "id")
    up = f.select("file", F.explode(tails("f")).alias("p")).join(c, "p").select("file", "id")
    return down.unionByName(up).distinct()


def service_labels(files: DataFrame, services: DataFrame, fallback: str = "_root") -> DataFrame:
    """The service whose folder is the longest prefix of each file: (file, service); ties by name."""
    parts = F.split(clean_path("file"), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tried = files.select("file").distinct().select("file", F.explode(folders).alias("folder"))
    s = services.select(clean_path("relative_path").alias("folder"), F.col("name").alias("service"))
    hit = tried.join(s, "folder").groupBy("file").agg(F.min_by("service", F.struct(-F.length("folder"), "service")).alias("service"))
    return files.select("file").distinct().join(hit, "file", "left").select("file", F.coalesce("service", F.lit(fallback)).alias("service"))


def symbol_files(components: DataFrame) -> DataFrame:
    """Class-like names, the first of their files and how many there are: (name, file, n_files); no list of files is held."""
    rows = components.where(F.lower(F.trim("component_type")).isin("class", "interface", "struct", "enum", "record") & F.col("name").isNotNull())
    rows = rows.select("name", clean_path("relative_path").alias("file")).distinct()
    return rows.groupBy("name").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n_files"))


def symbol_links(pages: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols in code spans of pages and the file of each, from `symbol_files`: (doc_key, symbol, file)."""
    spans = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), 1))
    rows = pages.select("doc_key", F.explode(spans).alias("name"))
    return salted_join(rows, symbols.select("name", "file"), ["name"], "inner").select("doc_key", F.col("name").alias("symbol"), "file")


def rewrite_symbol_links(pages: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """Pages whose code spans of known symbols are links to their files: (doc_key, text); linked spans stay.

    `symbols` is a bounded map held by every task (the class-like names of one repository)."""
    import re

    import pyarrow as pa

    span = re.compile(r"(?<!\[)`([A-Za-z_][\w.]*)`(?!\])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else span.sub(lambda m: f"[`{m[1]}`]({symbols[m[1]]})" if m[1] in symbols else m[0], t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_key", "text"])

    return pages.select("doc_key", "text").mapInArrow(run, "doc_key string, text string")


def mentioned_modules(notes: DataFrame, modules: DataFrame, most: int = 5) -> DataFrame:
    """Modules a note mentions: (doc_key, module, r), at most `most` in pre-order.

    A module is mentioned if its name stands in the note, or half of its words (rounded down) do where it has several.
    The names' words are joined with the words' occurrences: every word of a note is looked up, not every module tried.
    """
    from pyspark.sql.window import Window

    words = lambda c: F.filter(F.split(F.lower(c), r"[\s_-]+"), lambda w: w != "")
    m = modules.select("module", "preorder").groupBy("module").agg(F.min("preorder").alias("preorder"))
    m = m.select("module", "preorder", words(F.col("module")).alias("w")).withColumn("n", F.size("w"))
    # substrings of a word count too, as in plain text search: all pieces of a note that are some name's word
    rare = m.select("module", "preorder", "n", F.explode(F.array_distinct("w")).alias("word"))
    vocabulary = rare.select("word", F.length("word").alias("size")).distinct()
    sizes = vocabulary.select("size").distinct()
    text = notes.select("doc_key", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    tok = text.select("doc_key", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), 0))).alias("tok"))
    # all pieces of a word that are as long as some name's word: one piece a place and length
    seen = tok.select("tok").distinct().join(sizes, F.col("size") <= F.length("tok"))
    places = F.sequence(F.lit(1), F.length("tok") - F.col("size") + 1)
    pieces = seen.select("tok", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("tok"), i, F.col("size"))))).alias("word"))
    pieces = pieces.join(vocabulary.select("word"), "word", "left_semi")
    hits = tok.join(pieces, "tok").select("doc_key", "word").distinct().join(rare, "word")
    counted = hits.groupBy("doc_key", "module", "preorder", "n").agg(F.count(F.lit(1)).alias("found"))
    whole = counted.where("found = n and n = 1 or n > 1 and found >= floor(n / 2)")
    r = F.row_number().over(Window.partitionBy("doc_key").orderBy("preorder", "module"))
    return whole.select("doc_key", "module", r.alias("r")).where(F.col("r") <= most)


def module_components(modules: DataFrame, stems: DataFrame) -> DataFrame:
    """The components of the module each page stem names: (stem, module, component_id); the first module in pre-order."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"[\s/\\_-]+", "_")
    first = modules.groupBy(norm(F.col("module")).alias("key")).agg(F.min_by("module", F.struct("preorder", "module")).alias("module"))
    hit = stems.select("stem", norm(F.col("stem")).alias("key")).join(first, "key")
    return hit.join(modules.select("module", "component_id").where("component_id is not null").distinct(), "module").select("stem", "module", "component_id")


#: What routes a component to a class.
ROUTING = {
    "boilerplate": {
        "suffixes": ("DTO", "VO", "Request", "Response", "Entity", "PO", "DO", "Model", "Schema", "Form", "Serializer", "Mapper", "Repository", "Dao", "DAO", "DataClass"),
        "annotations": ("@Data", "@Getter", "@Setter", "@Entity", "@Table", "@Document"),
        "path_keywords": ("model", "models", "dto", "vo", "entity", "entities", "schema", "pojo"),
    },
    "business": {
        "suffixes": ("Service", "Controller", "Job", "Consumer", "Handler", "Manager", "Processor", "Executor", "UseCase", "Interactor", "Provider", "Resolver", "Facade", "Orchestrator"),
        "annotations": ("@Service", "@RestController", "@Controller", "@Component", "@Scheduled"),
        "path_keywords": ("service", "services", "controller", "handler", "job", "consumer"),
    },
    "infra": {
        "suffixes": ("Util", "Utils", "Helper", "Factory", "Builder", "Interceptor", "Filter", "Middleware", "Adapter", "Wrapper", "Proxy", "Client", "Config", "Configuration", "Properties"),
        "annotations": ("@Configuration", "@ConfigurationProperties", "@Bean"),
        "path_keywords": ("util", "utils", "config", "infrastructure", "common", "shared"),
    },
}
#: The order in which the classes are tried.
ROUTING_ORDER = ("boilerplate", "infra", "business")


def routing_class(name: Column | str, path: Column | str, source: Column | str, rules: dict | None = None) -> Column:
    """boilerplate, infra or business by name suffix, path folder or annotation (first 2,000 characters); else business."""
    low, p = F.lower(col(name)), F.concat(F.lit("/"), F.lower(clean_path(path)), F.lit("/"))
    head = F.coalesce(F.substring(col(source), 1, 2000), F.lit(""))
    out = F.lit("business")
    for kind in reversed(ROUTING_ORDER):
        r = (rules or ROUTING)[kind]
        ends = "|".join(sorted({x.lower() for x in r["suffixes"]}))
        where = "|".join(r["path_keywords"])
        marks = "|".join(r["annotations"])
        hit = low.rlike(rf"(?:{ends})$") | p.rlike(rf"/(?:{where})/") | head.rlike(marks)
        out = F.when(F.coalesce(hit, F.lit(False)), kind).otherwise(out)
    return out
