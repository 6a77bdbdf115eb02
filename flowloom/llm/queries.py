"""One query per operator, over whole tables, and its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import oracles
from flowloom.llm.common import fold, table
from flowloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    """Register ``fn`` under its name, with the SQL of that name in ``oracles`` if there is one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    if hasattr(oracles, fn.__name__.upper()):
        SQL[fn.__name__] = getattr(oracles, fn.__name__.upper())
    return fn


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.secrets import secret_scan

    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] != "format")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        of = F.size(F.filter("secrets", lambda s: s["kind"] == kind))
        return of.cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.toxicity import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 4) == 2
    return toxicity(docs, labels.where(~held)).select(
        "doc_id", held.alias("held_out"), "score", "predicted", "windows")


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", F.size("deleted").alias("n_deleted"),
        F.array_join("deleted", ",").alias("deleted"), "text")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "start", "hamming", F.round("similarity", 9).alias("similarity"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.language import language_id

    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    return language_id(docs, docs.where(~held)).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.warc import archive_folder, read_archives, write_archives

    folder = archive_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.ranking import quality_rank

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 5) == 0
    return quality_rank(docs, labels.where(~held)).select(
        "doc_id", held.alias("held_out"), "score", "predicted", "utility")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.mixing import pareto_mix

    return pareto_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.whiten import whiten

    out = whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "z")
    return out.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "z.whitened", "z.explained",
        "identity_error")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.merkle import merkle_manifest

    tampered = F.when(fold(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), claimed={"text": tampered}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.packing import best_fit

    placed, _ = best_fit(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
