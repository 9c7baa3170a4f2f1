"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import bpe, licenses, neighbours, oracles, packing, periodic_runs, quality, secrets, simhash, substrings, suffix_dedup, token_counts, urls, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_ranks() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_license_scans", oracles.LICENSES)
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op2_quality_rules", oracles.QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), *byte_ranks())


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op6_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # passages of over 50 words are often shorter than 400 bytes: one more column does without both
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir), words=51)
    # a byte string may begin or end inside a character, whose rest shows as U+FFFD in the text
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), F.col("cut").alias("text_without_passages"),
    )


@query("op7_secret_scans", oracles.SECRETS)
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(documents(spark, sf_dir))
    counts = ("n_assign", "n_access", "n_hex")
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


URL_RULES = [
    urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow"),
]


@query("op8_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.classify(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op9_token_counts")
def token_counts_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(documents(spark, sf_dir), *byte_ranks())


@query("op10_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query("op11_substring_dedup", oracles.SUBSTRINGS)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").alias("text")
    )


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents, of which about one in ten gets a tail of a repeated passage.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10), a document of n > 0 words
    with h divisible by 10 repeats from word a = g % n on the p = 1 + floor((n - a) / (3 + g % 8))
    words that stand there.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("tail"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    cut = chosen.select("doc_id", "text", "g", F.when(F.col("tail"), words).alias("words"))
    cut = cut.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.col("n") - F.col("a")
    passage = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(passage, F.ceil(tail / F.col("p")).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), tail))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_runs_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(with_tails(documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_vector_codes", oracles.VECTOR_CODES)
def vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return vector_codes.with_label_errors(codes).select(
        "vec_id", code.alias("code"), "error", "label_error",
        F.lit(books.sha256 if books else None).cast("string").alias("codebooks_sha256"),
    )
