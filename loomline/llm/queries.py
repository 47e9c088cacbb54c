"""Queries of the training-text operators over the knowledge base's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import oracle
from loomline.llm.bpe import encode_corpus
from loomline.llm.functions import documented_functions, function_pairs
from loomline.llm.handwritten import forest_quality, not_handwritten
from loomline.llm.leaks import leaked_passages, paraphrased_items
from loomline.llm.parsing import broken_files, broken_rates
from loomline.llm.pieces import split_oversized
from loomline.llm.truncation import truncated_texts, truncation_rates
from loomline.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that were not written by hand for their repository."""
    return not_handwritten(table(spark, d, "source_files")).select("relative_path")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many files each kind of evidence sets apart, and whether notices or names say it too."""
    return not_handwritten(table(spark, d, "source_files")).groupBy("reason", "said").count().withColumnRenamed("count", "n_files")


def p1_quality(spark: SparkSession, d: str) -> DataFrame:
    """What the forest makes of files it was not fitted on, by what their hidden notices say."""
    return forest_quality(table(spark, d, "source_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text is not valid syntax of the language of their extension."""
    return broken_files(table(spark, d, "source_files")).select("relative_path")


def p4_failures(spark: SparkSession, d: str) -> DataFrame:
    """The same files with the line, the kind and the token of the first error."""
    return broken_files(table(spark, d, "source_files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Shares of broken files per repository and language."""
    return broken_rates(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each component whose source code has more than 1,500 characters, cut at blank lines."""
    return split_oversized(table(spark, d, "components"))


def p5_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """The same items, cut at the deepest valleys of lexical cohesion instead of blank lines."""
    return split_oversized(table(spark, d, "components"), boundary="cohesion")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose documentation says more than their name and signature."""
    return documented_functions(table(spark, d, "components")).select("id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of each documented function of the source files."""
    return function_pairs(table(spark, d, "source_files"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each document's token ids by byte_bpe_50k."""
    return encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of an evaluation item."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_paraphrased(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a reworded sentence of an evaluation item, and whether its answer is kept."""
    return paraphrased_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut within a word or a sentence."""
    return truncated_texts(table(spark, d, "documents")).select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation_rates(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p1_quality": p1_quality,
    "p4_found": p4_found,
    "p4_failures": p4_failures,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_cohesion": p5_cohesion,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_paraphrased": p8_paraphrased,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}
SQL = oracle.SQL
