"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    ann,
    exact_dedup,
    kmeans,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    runs,
    secrets,
    sharding,
    substring_dedup,
    token_files,
    toxicity,
)
from tidemark.llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(key: str, oracle: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return add


def byte_bpe() -> tuple[str, str]:
    """Path and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@_query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


@_query("op2_sharding")
def op2_sharding(spark, sf_dir):
    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return sharding.assignment(sharding.shard_documents(table(spark, sf_dir, "documents"), root))


@_query("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


@_query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op5_packing")
def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), *byte_bpe(), added_tokens=True)


@_query("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@_query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@_query("op8_ann")
def op8_ann(spark, sf_dir):
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@_query("op9_exact_dedup", exact_dedup.ORACLE)
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@_query("op10_mixing", mixing.ORACLE)
def op10_mixing(spark, sf_dir):
    return mixing.systematic_mix(table(spark, sf_dir, "documents"))


@_query("op11_runs")
def op11_runs(spark, sf_dir):
    return runs.digest(runs.collapse_runs(table(spark, sf_dir, "documents"), words=runs.planted_words))


@_query("op12_token_files")
def op12_token_files(spark, sf_dir):
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    vocabulary = byte_bpe()
    documents = table(spark, sf_dir, "documents")
    token_files.write_tokens(documents, folder, lambda: packing.encoder(*vocabulary, added_tokens=True), end_id=2, id_bytes=2)
    return token_files.digest(token_files.read_tokens(spark, folder))


@_query("op13_centroids")
def op13_centroids(spark, sf_dir):
    found, centroids, _ = kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return kmeans.digest(found, centroids)
