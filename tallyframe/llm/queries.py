"""The operators bound to the given tables, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, latent_leaks, lexical, license_scan, mixing, packing, page_text, repeats, risk_rules, rule_ensemble, sharding, simhash, token_files
from .common import scratch, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)


@query("op7_token_orc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(tables(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.digest(spark, path)


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


@query("op9_minimax_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.minimax_shards(sharding.sized(tables(spark, sf_dir, "documents")), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_rule_ensemble")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


@query("op4_risk_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


@query("op3_suffix_repeats")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(tables(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op10_latent_leaks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_leaks.flagged(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


@query("op5_dom_trees")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(tables(spark, sf_dir, "pages"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(tables(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "conversations")
    return conversations.audits(rows, conversations.damaged(rows))


@query("op12_lexical_search", """
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT row_number() OVER () AS r, doc_id, terms, len(terms)::BIGINT AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY term, docs),
scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term), totals GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"), 10)


@query("op13_subset_sum_mix")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
