"""Which source files were not written by hand for their repository.

A random forest learns, from the shape of a text alone, what files look like that say of themselves that a
program wrote them, or that a tool compressed them (the source map it leaves). Notices alone give the three
labels and are hidden from the features; no rule on the features takes part in the fit or overrules the forest.
Notices and path names are also evidence of their own, as a third party's code looks like any other, and so is a
text that is nothing but literals, on which no notice ever stands from which a forest could learn it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.skew import spread
from loomline.session import ensure_checkpoint_dir

#: The forest is fitted on at most so many labelled files, taken in the order of a hash of their path.
TRAIN_ROWS = 20_000
#: Shallow trees with large leaves: files without a notice count as hand-written although some are not, and a leaf
#: that held a few of them only would learn them.
TREES, DEPTH, LEAF, SEED = 40, 5, 20, 7
THRESHOLD = 0.8
#: Share of a file's lines of code that are literals and nothing else from which on it is data.
LITERALS = 0.75

#: Directories that hold other people's or written code by convention, and names a generator gives.
VENDOR_DIRS = ("vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "jspm_packages", "site-packages", "upstream", "external", "externals", "extern", "Pods", "Carthage", "Godeps")
VENDOR_PAIRS = ("libs/contrib", "deps/upstream", "lib/contrib", "deps/external")
GENERATED_DIRS = ("__generated__", "generated", "gen", "autogen", "auto-generated", "generated-sources", "generated_src", "gen-src")
GENERATED_PAIRS = ("build/stubs", "build/generated", "target/generated", "out/generated")
GENERATED_NAME = re.compile(
    r"(?:_pb2?(?:_grpc)?\.(?:py|js|ts|d\.ts)|\.pb(?:\.gw)?\.\w+|[._-](?:generated|autogen|auto_generated|gen|g)\.\w+|_grpc\.py|\.designer\.cs|^zz_generated\.)",
    re.IGNORECASE,
)
MINIFIED_NAME = re.compile(r"[._-](?:min|bundle|packed|umd\.prod|chunk)\.(?:js|mjs|cjs|css)$", re.IGNORECASE)

NOT_A_NOTICE = re.compile(
    r"once (?:auto-?)?generated|(?:kept|maintained|edited|written) by hand|no longer|used to be|formerly|auto-?generated (?:\w+ )?stub|method stub|replace this|"
    r"[\"'`“][^\"'`”]*(?:do not edit|generated|do not modify)[^\"'`”]*[\"'`”]|not (?:auto-?)?generated|ehemals|nicht mehr|n'est plus",
    re.IGNORECASE,
)
GENERATED_NOTICE = re.compile(
    r"""(?:
      ^\W*(?:code|file|source|class|module|stubs?|bindings?|types?)?\s*(?:is\s|was\s|has\ been\s)?(?:auto(?:matically|matic)?[\s-]*|machine[\s-]*)generated\b(?!\s+(?:method|class|function)?\s*(?:stub|ids?|names?|keys?))
    | <auto-?generated | @generated\b | ^\W*(?:code\ )?generated\b.{0,80}\b(?:by|from|with|using)\b
    | \b(?:this|the)\ (?:file|code|class|source|module)\b.{0,40}\b(?:generated|produced|emitted|written\ by\ a)\b
    | \bdo\ not\ (?:edit|modify|change|touch)\b.{0,60}(?:output|generat|input|by\ hand|manually|$)
    | \b(?:edits|changes|modifications)\ (?:made\ here\ )?(?:will\ be\ (?:lost|overwritten)|are\ lost)
    | \b(?:maschinell|automatisch)\ (?:erzeugt|generiert|erstellt)\b | \bnicht\ (?:von\ Hand|manuell)\ (?:ändern|bearbeiten)
    | \b(?:généré|produit|créé)e?\ automatiquement\b | \bfichier\ généré\b | \bne\ pas\ (?:modifier|éditer)
    | \b(?:generado|creado)\ automáticamente\b | \b(?:archivo|fichero|código)\ generado\b | \bno\ (?:editar|modificar)\b
    | 自动生成 | 機械生成 | 自動生成 | 请勿(?:手动|手工)?(?:修改|编辑) | 不要(?:手动|手工)?(?:修改|编辑)
    )""",
    re.IGNORECASE | re.VERBOSE,
)
VENDOR_NOTICE = re.compile(
    r"""(?:
      \bvendored\b.{0,40}\b(?:copy|from|version|of)\b | \b(?:imported|copied|taken|forked|mirrored|synced)\ (?:verbatim\ )?from\ (?:the\ )?[\w.-]+(?:\ project|\ release|\ repository|\ v?\d)
    | \bupstream\ (?:source|copy|version|project)\b | \bsend\ (?:changes|patches)\ upstream\b | \b(?:do\ not|don't)\ patch\ here\b
    | \(c\)\s*\d{4}.{0,60}\bauthors\b | \bcopyright\b.{0,20}\d{4}.{0,60}\bauthors\b
    | ^\W*[\w.-]+\ v?\d+\.\d+(?:\.\d+)?\s*\|.*licen[cs]e | ^\W*[\w.-]+,?\ (?:is\ )?(?:distributed|released|licensed)\ under\ (?:a|the)\b
    | ^/\*!\s*[\w.-]+\ v?\d+\.\d+
    | \bübernommen\ aus\ dem\ Projekt\b | \bKopie\ (?:von|des\ Projekts)\b | \bcopie\ (?:de|du\ projet)\b | \bcopia\ (?:de|del\ proyecto)\b | 第三方 | 上游
    )""",
    re.IGNORECASE | re.VERBOSE,
)
SOURCE_MAP = re.compile(r"[ \t]*(?://|/\*)[#@]\s*sourceMappingURL=")
COMMENT = re.compile(r"^\s*(?://|/\*|\*|#(?!include|define|if|endif)|<!--|--)")
STRING = re.compile(r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*(?:`|\Z)")
TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
DATA_LINE = re.compile(
    r"^[\s\[\]{}(),;+:]*(?:(?:(?:[bBrRuU]?\"[^\"]*\"|[bBrRuU]?'[^']*'|-?\d[\w.+-]*|0x[0-9a-fA-F]+|true|false|null|None|True|False)[\s\[\]{}(),;+:]*)+|[\w+/=]{40,})?[\s\[\]{}(),;+:`]*$"
)

SOLID = re.compile(r"\w")

FEATURES = [
    "compression", "token_entropy", "ident_mean", "ident_short", "ident_distinct", "comment_share", "line_mean", "line_max",
    "blank_share", "digit_share", "space_share", "literal_share", "repeated_lines", "log_size",
]


def _lines(text: str) -> list[str]:
    return text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")


def notice_lines(lines: list[str]) -> set[int]:
    """The comment lines before the first and after the last line of code."""
    out: set[int] = set()

    def walk(order: Iterator[int], backwards: bool) -> None:
        block = False
        for k in order:
            x = lines[k].strip()
            if not x:
                continue
            if block:
                out.add(k)
                if ("/*" in x) if backwards else ("*/" in x):
                    block = False
            elif x.startswith("/*") or (backwards and x.endswith("*/") and COMMENT.match(x)):
                out.add(k)
                # minified code may follow the banner on its line
                block = ("/*" not in x) if backwards else ("*/" not in x)
            elif COMMENT.match(x) and (x[0] != "*"):
                out.add(k)
            else:
                return

    walk(iter(range(len(lines))), False)
    walk(iter(range(len(lines) - 1, -1, -1)), True)
    return out


def notices(text: str | None, repo: str = "") -> tuple[bool, bool, bool]:
    """Whether the file's own opening or closing comment says that a program wrote it, whose copy it is, or, by
    naming its source map, that a tool compressed it.

    A notice that names the repository itself does not make the file someone else's.
    """
    if not text:
        return False, False, False
    lines = _lines(text)
    generated = vendored = False
    for k in sorted(notice_lines(lines)):
        x = lines[k].strip()
        x = x[: x.index("*/")] if "*/" in x else x
        if NOT_A_NOTICE.search(x):
            continue
        bare = re.sub(r"^(?:/\*+!?|//+!?|\*+|#+!?|<!--|--+)\s*", "", x)
        generated |= bool(GENERATED_NOTICE.search(bare))
        own = bool(repo) and repo.lower() in x.lower()
        vendored |= not own and bool(VENDOR_NOTICE.search(bare) or VENDOR_NOTICE.search(x))
    return generated, vendored, any(SOURCE_MAP.match(x) for x in lines[-3:])


def path_evidence(path: str | None) -> tuple[bool, bool]:
    """Whether a path names a generated or minified file, or a place of third-party code. The repository is not looked at."""
    parts = (path or "").replace("\\", "/").strip().split("/")
    dirs, name = parts[1:-1], parts[-1]
    pairs = {f"{a}/{b}" for a, b in zip(dirs, dirs[1:], strict=False)}
    generated = bool(
        set(dirs) & set(GENERATED_DIRS) or pairs & set(GENERATED_PAIRS) or GENERATED_NAME.search(name) or MINIFIED_NAME.search(name)
    )
    return generated, bool(set(dirs) & set(VENDOR_DIRS) or pairs & set(VENDOR_PAIRS))


def shape(text: str | None) -> list[float]:
    """The features of a text without its opening and closing comments, in the order of FEATURES.

    Each pattern runs once over the joined lines, not line by line.
    """
    lines = _lines(text or "")
    hidden = notice_lines(lines)
    kept = [x for k, x in enumerate(lines) if k not in hidden]
    # a banner and the code behind it on the same line
    kept += [x.split("*/", 1)[1] for k, x in enumerate(lines) if k in hidden and "*/" in x and x.split("*/", 1)[1].strip()]
    full = [x for x in map(str.strip, kept) if x]
    if not full:
        return [0.0] * len(FEATURES)
    body = "\n".join(kept)
    raw = body.encode("utf-8", "replace")
    code = [x for x in full if not COMMENT.match(x)]
    joined = "\n".join(code)
    bare = STRING.sub('""', joined)
    tokens = Counter(TOKEN.findall(bare))
    n = sum(tokens.values())
    entropy = math.log2(n) - sum(v * math.log2(v) for v in tokens.values()) / n if n else 0.0
    idents = {x: v for x, v in tokens.items() if x[0] == "_" or x[0].isalpha()}
    used = max(1, sum(idents.values()))
    bare_lines = [len(x) for x in bare.split("\n") if x.strip()]
    # repetition of lines, and of line shapes: every number, or every word and number, replaced
    masked, shapes = set(re.sub(r"\d+", "0", joined).split("\n")), set(re.sub(r"\w+", "w", joined).split("\n"))
    solid = [x for x in code if SOLID.search(x)]
    return [
        len(raw) / len(zlib.compress(raw, 1)),
        entropy,
        sum(len(x) * v for x, v in idents.items()) / used,
        sum(v for x, v in idents.items() if len(x) <= 2) / used,
        len(idents) / used,
        (len(full) - len(code)) / len(full),
        sum(bare_lines) / len(bare_lines) if bare_lines else 0.0,
        float(max(bare_lines, default=0)),
        1 - len(full) / len(kept),
        len(re.findall(r"\d", body)) / len(body),
        1 - len("".join(body.split())) / len(body),
        sum(map(bool, map(DATA_LINE.match, solid))) / len(solid) if solid else 0.0,
        1 - (len(masked) + len(shapes)) / max(1, 2 * len(code)),
        math.log1p(len(raw)),
    ]


def file_features(files: DataFrame) -> DataFrame:
    """(relative_path, label, noted, named, vendored, FEATURES...) of each row: what notices say (`label` is 0 nothing,
    1 written by a program, 2 compressed, null a third party's), what names say, and the text's shape."""
    names = ["relative_path", "label", "noted", "named", "vendored", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (g, v, c), (pg, pv) = notices(text, path.split("/")[0]), path_evidence(path)
                rows.append((path, 2.0 if c else 1.0 if g else None if v else 0.0, g or c, pg, v or pv, *shape(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = [pa.string(), pa.float64(), *[pa.bool_()] * 3, *[pa.float64()] * len(FEATURES)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "relative_path string, label double, noted boolean, named boolean, vendored boolean, " + ", ".join(f"{x} double" for x in FEATURES)
    return spread(files.select("relative_path", "file_text")).mapInArrow(run, schema)


def _scored(train: DataFrame, rows: DataFrame, train_rows: int) -> DataFrame:
    """`rows` with `p`, the forest's probability that a file was not written by hand; 0 where `train` has one label only."""
    some = train.where(F.col("label").isNotNull() & (F.col("log_size") > 0)).orderBy(F.xxhash64("relative_path"), "relative_path").limit(train_rows)
    counts = {r["label"]: r["n"] for r in some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2 or 0.0 not in counts:
        return rows.withColumn("p", F.lit(0.0))
    # classes are numbered without gaps, each weighs as much as the files without a notice
    order = sorted(counts)
    klass = sum((F.when(F.col("label") == x, float(i)).otherwise(0.0) for i, x in enumerate(order)), F.lit(0.0))
    weight = sum((F.when(F.col("label") == x, counts[0.0] / counts[x]).otherwise(0.0) for x in order), F.lit(0.0))
    whole = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", minInstancesPerNode=LEAF, subsamplingRate=0.7, cacheNodeIds=False, labelCol="klass"
    ).fit(whole.transform(some.withColumn("weight", weight).withColumn("klass", klass)))
    by_hand = vector_to_array("probability")[0]
    return forest.transform(whole.transform(rows)).withColumn("p", F.when(F.col("log_size") > 0, 1 - by_hand).otherwise(0.0))


def not_handwritten(files: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Files that a program wrote or compressed, a third party wrote, or that are data laid out as code:
    (relative_path, reason, probability).

    The forest is fitted on at most `train_rows` files, labelled by their notices alone (those with a third party's
    notice are left out of the fit), and scores every file. Reasons, in this order: `forest` (probability at least
    `threshold`), `notice`, `path`, `vendored`, `literals` (the lines of code are literals and nothing else). Null and
    empty texts are judged by their path alone; repeated rows of a path give one row; a file without a path is left
    out; tables in which all files have one label are judged without a forest.
    """
    ensure_checkpoint_dir(files.sparkSession)
    rows = file_features(files.where(F.col("relative_path").isNotNull())).checkpoint()
    reason = (
        F.when(F.col("p") >= threshold, "forest")
        .when(F.col("noted"), "notice")
        .when(F.col("named"), "path")
        .when(F.col("vendored"), "vendored")
        .when((F.col("literal_share") >= LITERALS) & (F.col("log_size") > 5.2), "literals")
    )
    return (
        _scored(rows, rows, train_rows)
        .select("relative_path", reason.alias("reason"), F.col("p").alias("probability"), (F.col("noted") | F.col("named") | F.col("vendored")).alias("said"))
        .where(F.col("reason").isNotNull())
        .dropDuplicates(["relative_path"])
    )


def forest_quality(files: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """What a forest fitted on four fifths of the files makes of the last fifth: (notice, by_name, forest, n_files).

    `notice` is what the hidden notice says (none, written, compressed), `by_name` whether path names or a third
    party's notice say something, `forest` the verdict. Files with a notice that the forest leaves out are its misses.
    """
    ensure_checkpoint_dir(files.sparkSession)
    rows = file_features(files.where(F.col("relative_path").isNotNull())).checkpoint()
    held = F.pmod(F.xxhash64(F.lit("held"), "relative_path"), F.lit(5)) == 0
    scored = _scored(rows.where(~held), rows.where(held), train_rows).dropDuplicates(["relative_path"])
    notice = F.when(F.col("label") == 2, "compressed").when(F.col("label") == 1, "written").otherwise("none")
    return scored.groupBy(notice.alias("notice"), (F.col("named") | F.col("vendored")).alias("by_name"), (F.col("p") >= threshold).alias("forest")).agg(
        F.count(F.lit(1)).alias("n_files")
    )
