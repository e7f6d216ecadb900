"""The ten queries, each over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontaminate, html, neardup, packing, quality, secrets, substrings, tokenfile, urls
from .common import fresh
from .oracles import ORACLES


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", *quality.STATS, "base_failed", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "tokens")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer(), end=0)
    read = tokenfile.read_tokens(spark, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.kept_words(substrings.repeated_spans(_table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # plain documents: every token bears loss, and a sequence may hold as many pieces as tokens, so that short ones fill it too
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer(), segments=2048, end=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: each assistant's turn with the turn before it, which bears no loss, under all three limits."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # of repeated turns, the smallest text is the prompt, so that none multiplies the answers
    prompts = turns.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("text").alias("prompt"))
    answers = turns.where(F.col("role") == "assistant")
    rows = answers.join(prompts, (F.col("conv_id") == F.col("c")) & (F.col("turn") - 1 == F.col("t")), "left")
    rows = rows.select(F.struct("conv_id", "turn").alias("example"), "prompt", "text")
    packed = packing.pack(rows, tokenizer(), segments=32, end=1, loss=1536, id_col="example", prompt_col="prompt")
    return packed.select("doc_id.*", "start", "length", "loss", F.crc32("ids").alias("ids_crc32"), F.col("doc_tokens").alias("example_tokens"), "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_benchmark_decontamination, op2_quality_rules, op3_quality_classifier, op4_minhash_near_dedup, op5_token_id_output, op6_url_filters, op7_substring_dedup, op8_secret_scans, op9_html_extraction, op10_packing, packed_conversations, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
