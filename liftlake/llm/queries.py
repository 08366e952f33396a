"""Registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.llm import (exact_dedup, line_dedup, mixing, oracles, packing, periodic, pii, prefix_trie, quality_rules, secrets, sharding, simhash,
                          url_rules, warc)
from liftlake.llm.common import stored, table


def vocabulary() -> str:
    """Path of the public byte-level BPE vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(mixing.measured(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_tokens", "mix_doc"), "measured")
    return mixing.mix(rows, max_repeats=2.0).drop("mix_doc")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(table(spark, sf_dir, "documents")).drop("row")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_dedup(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a parameter of the operator; this one only serves the query."""
    rows = pii.pseudonymise(table(spark, sf_dir, "documents"), key="key of the registered query")
    return rows.select("doc_id", "text", F.size("found").alias("n_found"), F.col("found.kind").alias("kinds"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = stored(secrets.format_labels(secrets.findings(docs, path=F.col("source"))), "findings")
    return secrets.scan(found, secrets.train(found))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed")


#: The fixed rules of the registered query.
URL_RULES = [url_rules.UrlRule("org", "/", "allow"), url_rules.UrlRule("example.org", "/es/", "block"),
             url_rules.UrlRule("example.org", "/en/1", "block"), url_rules.UrlRule("com", "/fr/", "allow"),
             url_rules.UrlRule("com", "/de/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_rules.mine(url_rules.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge_urls(pages, URL_RULES, rules).select("row.page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_shards, op2_packing, op3_mixing, op4_quality_rules, op5_line_dedup, op6_simhash, op7_exact_dedup, op8_warc, op9_pii, op10_secret_scan,
    op11_prefix_trie, op12_periodic_runs, op13_url_filter, pipeline)}

ORACLE = {"op7_exact_dedup": oracles.EXACT_DEDUP, "op8_warc": oracles.WARC, "op11_prefix_trie": oracles.PREFIX_TRIE,
          "op12_periodic_runs": oracles.PERIODIC_RUNS, "op13_url_filter": oracles.URL_FILTER}
