"""One thin query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from riskset.llm import (bit_slices, ctw, doubling, gram_automata, hash_forest, host_rules, huffman, odd_sketch, patience,
                         phrase_index, reply_trees, systematic, token_counts)
from riskset.llm.common import load
from riskset.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_files(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.assess(load(spark, sf_dir, "documents"))


@query
def op3_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.digest_rows(load(spark, sf_dir, "documents"))


@query
def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systematic.plan(load(spark, sf_dir, "documents"))


@query
def op6_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(load(spark, sf_dir, "documents"))


@query
def op7_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.assess(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("n_near")


@query
def op8_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = patience.dedup(load(spark, sf_dir, "documents"), every_holder=True)
    return kept.select("doc_id", "n_lines", "n_removed", "n_partners", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_doubling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = doubling.dedup(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_reply_tree_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    rows = load(spark, sf_dir, "conversations").select(*names).unionByName(reply_trees.probe(spark).select(*names))
    turns = reply_trees.paths(reply_trees.linear(rows))
    chats = reply_trees.render(turns.select(F.col("tree").alias("conv_id"), "pos", "role", "text"), ["conv_id"])
    back = chats.select("conv_id", "formatted", reply_trees.read_back(F.col("formatted")).alias("turns"),
                        reply_trees.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op11_hash_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return hash_forest.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op12_bit_sliced_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op13_gram_automata_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_automata.mine(load(spark, sf_dir, "documents"))
