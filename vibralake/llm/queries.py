"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake.llm import bestfit_packing, code_compression, exact_dedup, mixing, ngram_join, packing, quality, recompression
from vibralake.llm import suffix_dedup, tokenizer_alignment, tool_calls, topk_search, toxicity
from vibralake.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.passages(docs, model)
    return scored.select(
        "doc_id", F.coalesce(quality.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, schemas = tool_calls.calls_in(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link(calls, results, schemas)
    return linked.select("conv_id", "turn", "call_id", "status", "depth", F.concat_ws("; ", "errors").alias("errors"), "json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.removed(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    found = topk_search.search(rows.filter("id % 20 = 0"), rows, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(quality.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = code_compression.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None).cast("string")
    for width in codes.books:
        digest = F.when(F.col("width") == width, codes.digest(width)).otherwise(digest)
    coded = code_compression.with_label_error(written(codes.rows, "codes"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tokenizer_alignment.blocks(table(spark, sf_dir, "documents"))
    aligned = tokenizer_alignment.align(held, tokenizer_alignment.pair_counts(held))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = bestfit_packing.pieces(table(spark, sf_dir, "documents"))
    packed = bestfit_packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_toxicity": op2_toxicity,
    "op3_tool_calls": op3_tool_calls,
    "op4_packing": op4_packing,
    "op5_recompression": op5_recompression,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_mixing": op8_mixing,
    "op9_topk": op9_topk,
    "op10_quality": op10_quality,
    "op11_code_compression": op11_code_compression,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_bestfit_packing": op13_bestfit_packing,
    "pipeline": pipeline,
}
