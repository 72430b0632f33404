"""Registered queries of the training-data operators over the test tables.

``QUERIES`` maps a name to ``fn(spark, sf_dir) -> DataFrame`` and ``ORACLES``
the same name to DuckDB SQL over the pre-registered views, where SQL can
express the operator.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from flowmatch.llm import (bpe, cws, decontam, licenses, minmax, negatives, pii, quality, sharding, simhash, spelling, token_files,
                           unigram)
from flowmatch.llm.common import documents, surrogate_key
from flowmatch.session import checkpoint_dir
from flowmatch.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@_query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=4, max_bits=4)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@_query("op2_consistent_weighted_sampling")
def op2(spark, sf_dir):
    found = cws.edited_likeness(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_chars", F.col("edited_text_sha256").alias("edited_sha256"),
                        cws.as_hex("samples").alias("fingerprint"), cws.as_hex("edited_samples").alias("edited_fingerprint"),
                        cws.likeness("samples", "edited_samples").alias("near_edited"),
                        cws.likeness("samples", "next_samples").alias("near_next"))


@_query("op3_quality_classifier")
def op3(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@_query("op4_byte_bpe_round_trip")
def op4(spark, sf_dir):
    both = bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@_query("op5_unigram_token_counts")
def op5(spark, sf_dir):
    return unigram.token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@_query("op6_token_id_files")
def op6(spark, sf_dir):
    folder = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = token_files.write(documents(spark, sf_dir, "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op7_license_scan", licenses.scan_sql())
def op7(spark, sf_dir):
    found = licenses.scan(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_sentences", *[F.concat_ws(",", c).alias(c) for c in ("sentence_ids", "licences", "unmatched")])


@_query("op8_pii_surrogates")
def op8(spark, sf_dir):
    return pii.pseudonymise(documents(spark, sf_dir, "doc_id", "text"), key=surrogate_key(spark))


@_query("op9_histogram_sort_shards")
def op9(spark, sf_dir):
    dealt = sharding.shards(documents(spark, sf_dir, "doc_id", "text"), n_shards=16)
    return dealt.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op10_benchmark_decontamination", decontam.contamination_sql())
def op10(spark, sf_dir):
    found = decontam.contamination(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10, gram=5)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@_query("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling.variant_groups(documents(spark, sf_dir, "doc_id", "text"))


@_query("op12_hard_negatives", negatives.mine_sql())
def op12(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"))


@_query("op13_minmax_near_dedup")
def op13(spark, sf_dir):
    return minmax.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=2, percent=80)
