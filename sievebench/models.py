"""Registered datasets, embedders, chat models, judges and retrievers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.contracts import CHATS, DATASETS, EMBEDDERS, JUDGES, RETRIEVERS
from sievebench.functions.text import content_hash, transcript_digest
from sievebench.operators import generation as N
from sievebench.operators import lexical
from sievebench.operators.sampling import split_by_hash
from sievebench.operators.similarity import nearest_items
from sievebench.sources import jsonl
from sievebench.sources.worlds import toy_world

FRACTIONS = {"train": 0.6, "anchor": 0.25, "oracle": 0.15}


@DATASETS.register("toy_world")
def _toy(spark: SparkSession, params: dict, seed: int) -> dict[str, DataFrame]:
    """Texts are the names of chunks and queries; vectors come with them."""
    names = {"k_true": "components", "n_chunks": "chunks", "n_prod": "queries", "sub_offset": "offset", "demand_skew": "skew", "sub_probs": "sub_shares"}
    made = toy_world(spark, seed=seed, **{names.get(k, k): v for k, v in params.items()})
    chunks = made["chunks"].withColumn("text", F.col("item")).withColumn("content_hash", content_hash("item"))
    queries = made["queries"].withColumn("text", F.col("query_id")).withColumn("stratum_key", F.lit(None).cast("string"))
    return {"chunks": chunks, "queries": queries}


@DATASETS.register("jsonl")
def _jsonl(spark: SparkSession, params: dict, seed: int) -> dict[str, DataFrame]:
    """``chunks.jsonl``, ``queries.jsonl`` and, if it is there, ``anchor_qrels.jsonl`` of a folder; vectors are embedded.

    Queries are split 60/25/15 by hash, with ``split_stratify_by`` within each value of that metadata key.
    """
    folder, by = params["path"], params.get("split_stratify_by")
    chunks = jsonl.load_chunks(spark, f"{folder}/chunks.jsonl").withColumnRenamed("chunk_id", "item").dropDuplicates(["item"])
    queries = jsonl.load_queries(spark, f"{folder}/queries.jsonl")
    if by:
        queries = queries.withColumn("group", F.col("metadata")[by])
    split = split_by_hash(queries, "query_id", FRACTIONS, seed, by="group" if by else None).withColumnRenamed("part", "split")
    out = {"chunks": chunks, "queries": split.withColumn("stratum_key", F.concat(F.lit(f"{by}="), F.col("group")) if by else F.lit(None).cast("string"))}
    try:
        out["qrels"] = jsonl.load_qrels(spark, f"{folder}/anchor_qrels.jsonl")
    except FileNotFoundError:
        pass
    return out


class _Model:
    def __init__(self, **params: Any) -> None:
        self.params = params

    def to_config(self) -> dict[str, Any]:
        return dict(self.params)


@EMBEDDERS.register("passthrough")
class Passthrough(_Model):
    """Looks vectors up in the bank; a text that was never banked is an error."""

    def bind(self, bank: N.Bank | None, dim: int, seed: int) -> Passthrough:
        self.bank = bank
        return self

    def encode(self, rows: DataFrame) -> DataFrame:
        return self.bank.get(rows)


@EMBEDDERS.register("mock")
class MockEmbedder(_Model):
    def bind(self, bank, dim: int, seed: int) -> MockEmbedder:
        self.dim, self.seed = self.params.get("dim", dim or 32), self.params.get("seed", seed)
        return self

    def encode(self, rows: DataFrame) -> DataFrame:
        return N.mock_vectors(rows, dim=self.dim, seed=self.seed)


@EMBEDDERS.register("hashed_ngram")
class HashedNgrams(_Model):
    def bind(self, bank, dim: int, seed: int) -> HashedNgrams:
        self.dim = self.params.get("dim", 256)
        return self

    def encode(self, rows: DataFrame) -> DataFrame:
        keep = [c for c in rows.columns if c != "vector"]
        return lexical.hashed_embeddings(rows, keep=keep, dim=self.dim)


@CHATS.register("toy_chat")
class ToyChat(_Model):
    def bind(self, bank: N.Bank | None, embedder, dim: int, seed: int) -> ToyChat:
        if bank is None:
            raise ValueError("toy_chat needs a dataset with banked vectors")
        self.run = N.toy_chat(bank, **({"seed": seed, "dim": dim} | self.params))
        return self

    def complete(self, asked: DataFrame) -> DataFrame:
        return self.run(asked)


@CHATS.register("mock")
class MockChat(_Model):
    def bind(self, bank, embedder, dim: int, seed: int) -> MockChat:
        self.run = N.mock_chat(embedder.encode, seed=self.params.get("seed", seed))
        return self

    def complete(self, asked: DataFrame) -> DataFrame:
        return self.run(asked)


@CHATS.register("cached")
class CachedChat(_Model):
    """Replays a transcript (``key, response``, parquet); a prompt that wasn't recorded goes to the backend, if there is one, or raises."""

    def bind(self, bank, embedder, dim: int, seed: int) -> CachedChat:
        backend = self.params.get("backend")
        self.backend = CHATS.get(backend["type"])(**(backend.get("params") or {})).bind(bank, embedder, dim, seed) if backend else None
        self.embedder = embedder
        return self

    def complete(self, asked: DataFrame) -> DataFrame:
        spark = asked.sparkSession
        keyed = asked.withColumn("key", transcript_digest("prompt"))
        held = spark.read.schema("key string, response string").parquet(self.params["transcript"]).dropDuplicates(["key"])
        known = keyed.join(held, "key").select("qid", F.col("response").alias("text"))
        missing = keyed.join(held.select("key"), "key", "left_anti")
        if self.backend is None:
            if first := missing.select("qid").first():
                raise KeyError(f"not recorded: the prompt of {first['qid']}")
            return self.embedder.encode(known).select("qid", "text", "vector")
        return self.embedder.encode(known).select("qid", "text", "vector").unionByName(self.backend.complete(missing.drop("key")).select("qid", "text", "vector"))


@JUDGES.register("toy_judge")
class ToyJudge(_Model):
    def answerable(self, query: Column, similarity: Column, evidence: bool) -> Column:
        least, share = self.params.get("tau_ans", 0.4), int(self.params.get("no_evidence_pct", 5))
        return N.toy_judge(similarity, query, least=least, no_evidence_share=share, has_evidence=F.lit(evidence))


@JUDGES.register("mock")
class MockJudge(_Model):
    def answerable(self, query: Column, similarity: Column, evidence: bool) -> Column:
        return N.mock_judge(F.lit(evidence), self.params.get("with_evidence", True), self.params.get("without_evidence", False))


class _Searching(_Model):
    def bind(self, items: DataFrame, dim: int) -> _Searching:
        self.items, self.dim = items, dim
        return self


@RETRIEVERS.register("dense_inmemory")
@RETRIEVERS.register("dense")
class Dense(_Searching):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return nearest_items(queries.select("qid", "vector"), self.items.select("item", "vector"), k, dim=self.dim)


@RETRIEVERS.register("bm25")
class Bm25(_Searching):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical.bm25(queries.select("qid", "text"), self.items.select("item", "text"), k)
