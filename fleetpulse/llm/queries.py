"""The queries of this subpackage, each a thin call of its operator over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import (
    decontamination,
    fill_in_middle,
    html_extraction,
    jaccard_join,
    language_id,
    merkle,
    mixing,
    substring_dedup,
    token_counts,
    token_output,
    topk,
    toxicity,
    url_filters,
)
from fleetpulse.session import scratch_path


#: Name, kind and share (one pattern in so many) of the lists for the URL filter.
LISTS = [("adult", "block", 5), ("malware", "block", 7), ("trusted", "allow", 6), ("spam", "block", 4)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in a mixture in which a source weighs the square root of its size."""
    return mixing.mix_sources(table(spark, folder, "documents").select("doc_id", "source"))


def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, 256)


def _number(text: Column, salt: str, least: int, count: int) -> Column:
    """A number in [least, least + count) that depends on the text only."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), text).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % count + least).cast("int")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of capture in 2024 that follows from id and URL, as the table has none."""
    day = _number(F.concat_ws("|", F.col("page_id").cast("string"), "url"), "fetched", 0, 366)
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of four lists about the patterns that the pages' own URLs have: host with segment, host, and its
    parents of two labels or more.

    For a list, a pattern is added on a day of the first half of 2024 if its number says so, and for half of
    them removed 30 to 179 days later.
    """
    host = url_filters.host_of(F.col("url"))
    parents = F.filter(url_filters.suffixes(host), lambda p: (p == host) | p.contains("."))
    every = F.concat(F.array(url_filters.with_segment(F.col("url"))), parents)
    known = pages.select(F.explode(every).alias("pattern")).where("pattern is not null").distinct()
    lists = F.array(*[F.struct(F.lit(n).alias("list"), F.lit(k).alias("kind"), F.lit(m).alias("one_in")) for n, k, m in LISTS])
    named = known.select("pattern", F.explode(lists).alias("x")).select("pattern", "x.*")
    salted = F.concat_ws("|", "list", "pattern")
    added = named.where(_number(salted, "in", 0, 1000) % F.col("one_in") == 0)
    start = F.date_add(F.lit("2024-01-01").cast("date"), _number(salted, "add", 0, 180))
    added = added.withColumn("listed", start).withColumn("action", F.lit("add"))
    removed = added.where(_number(salted, "half", 0, 2) == 0).withColumn("action", F.lit("remove"))
    removed = removed.withColumn("listed", F.date_add("listed", _number(salted, "remove", 30, 150)))
    return added.unionByName(removed).drop("one_in")


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = url_filters.judge(captures(pages), list_entries(pages))
    return judged.withColumn("fetched", F.col("fetched").cast("string"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.membership(jaccard_join.LinkedSets(table(spark, folder, "documents")))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), token_counts.load_vocabulary())


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.report(substring_dedup.Repeats(table(spark, folder, "documents")))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Forms and cuts of every document, with digests of its output and of the text restored from it."""
    made = fill_in_middle.rearrange(table(spark, folder, "documents"))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


def op12_token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the ids of every document to the shared folder and reads the files back."""
    path = scratch_path(spark, "token-ids")
    token_output.write(table(spark, folder, "documents"), path, token_output.tokenizer_path())
    return token_output.read_documents(spark, path)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = merkle.manifest(table(spark, folder, "documents"))
    proof = F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


QUERIES = {
    "op1_pfair_mixing": op1_pfair_mixing,
    "op2_exact_topk": op2_exact_topk,
    "op3_url_filters": op3_url_filters,
    "op4_language_id": op4_language_id,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_output": op12_token_output,
    "op13_merkle_manifest": op13_merkle_manifest,
}
