"""A training corpus from the documents table: five stages, each written and read again as the next one's documents.

toxicity        documents scored 0.5 or more go
line_dedup      lines that repeat an earlier line go, and so do lines of 20 code points or more within one edit of an earlier one;
                documents that lose all their lines go; n_chars becomes the code points of what is left
simhash         of each group of near-duplicates (five-word shingles, similarity 0.8) the least doc_id stays
decontaminate   documents that hold a benchmark item go
bpe             adds ids, the token ids of the text, n_tokens, and decoded_sha256, the digest of the text that the ids decode to

All but the last return the columns of documents. Nulls: null and empty texts, and rows with a null doc_id, pass all stages, but
that the empty texts are one group of near-duplicates, of which the least doc_id stays. Ties and repeated rows: rows of one doc_id
stay together or go together, but for lines, where rows that share a doc_id keep what they repeat of each other on the same line.
An empty table gives an empty one. Texts of any length are taken whole. Extra columns pass through, whatever their names; in the
last stage those called like one of its three columns, in any case, are replaced.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from seriesforge.llm.common import free_name, read_table, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon, weights = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    # A column of the documents that has the name of a result, in any case, is put aside meanwhile.
    aside = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c.lower() in ("score", "predicted")}
    named = docs.withColumnsRenamed(aside)
    kept = toxicity.score_documents(named, lexicon, weights, named.columns).where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs, exact_chars=1))
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_similar(docs, size=5, least=0.8)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, decontaminate.benchmark_hits(docs, read_table(spark, sf_dir, "benchmark")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    decoded = free_name(docs, "_decoded")
    coded = bpe.decode_column(bpe.encode_column(docs, "text", path), "ids", path, decoded)
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded_sha256", F.sha2(decoded, 256)).drop(decoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: SQL has no byte-pair encoding and no learned scores; tests/llm/test_pipeline.py compares run() and each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
