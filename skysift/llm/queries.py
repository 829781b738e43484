"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import (
    decontaminate,
    encode,
    kernels,
    laesa,
    licenses,
    orchard,
    packing,
    passages,
    quality,
    secrets,
    simhash,
    suffix_dedup,
    warc,
    wavelet,
)
from skysift.llm.common import table, texts


def op1_passage_chains(spark: SparkSession, folder: str) -> DataFrame:
    return passages.passages(table(spark, folder, "documents"))


def op2_simhash_variants(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"), size=3, distance=2)


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), encode.public_path(encode.BYTE_LEVEL), end_id=2, size=1024)


def op5_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a path with one version; its findings from a new ledger."""
    versions = secrets.as_versions(texts(table(spark, folder, "documents")))
    ledger = secrets.new_ledger(spark)
    secrets.scan_unseen(versions, ledger)
    found = secrets.findings_by_path(versions, ledger)
    base = F.array(*(F.lit(r.kind) for r in secrets.BASE))
    as_text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(number(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE),
        F.sha2(as_text(F.filter("findings", lambda x: F.array_contains(base, x["kind"]))), 256).alias("base_sha256"),
        as_text(F.col("findings")).alias("spans"),
        "blob",
    )


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"), length=50)


def op7_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.fit_tables(spark, folder, docs))


def op8_wavelet_tokens(spark: SparkSession, folder: str) -> DataFrame:
    index = wavelet.write_tokens(table(spark, folder, "documents"), encode.public_path(encode.WORD_LEVEL), end_id=1)
    return wavelet.read_tokens(index)


def op9_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_records(warc.write_archives(table(spark, folder, "pages")))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op11_orchard_codes(spark: SparkSession, folder: str) -> DataFrame:
    return orchard.with_label_errors(*orchard.compress(table(spark, folder, "embeddings"), parts=16, entries=64, rounds=2))


def op12_language_kernels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return kernels.identify(docs, kernels.fit(docs))


def op13_laesa_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return laesa.cluster(table(spark, folder, "embeddings"), k=40, rounds=5, dim=64, seed=2)


QUERIES = {
    "op1_passage_chains": op1_passage_chains,
    "op2_simhash_variants": op2_simhash_variants,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_secret_ledger": op5_secret_ledger,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_trees": op7_quality_trees,
    "op8_wavelet_tokens": op8_wavelet_tokens,
    "op9_warc_index": op9_warc_index,
    "op10_license_scan": op10_license_scan,
    "op11_orchard_codes": op11_orchard_codes,
    "op12_language_kernels": op12_language_kernels,
    "op13_laesa_clusters": op13_laesa_clusters,
}
ORACLES: dict[str, str] = {}
