"""The verification gate, relevance labels and curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebench.functions.text import hash_uniform, record_id
from sievebench.operators.dedup import first_by
from sievebench.operators.ranking import hash_sample
from sievebench.operators.sampling import apply_mix


def hash_judge(query: Column | str, share: float, seed: int = 0, stream: str = "judge") -> Column:
    """A judge without evidence: answerable for a share of queries, decided by hash."""
    return hash_uniform(seed, stream, query) < share


def evidence_judge(similarity: Column | str, least: float) -> Column:
    """A judge with evidence: answerable if the best evidence is similar enough; null similarity is not."""
    return F.coalesce(F.col(similarity) if isinstance(similarity, str) else similarity, F.lit(-1.0)) >= least


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check in order that isn't passed (null counts as failed), null if all are."""
    return F.coalesce(*[F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)) for name, passed in checks])


def run_gate(candidates: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``rejected_by``. Checks are columns, so the cheap ones cost no pass; order-dependent ones come as columns of
    an earlier step (``semantic_dedup``), whose comparison set are the candidates that pass all others."""
    return candidates.withColumn("rejected_by", first_failure(checks))


def tallies(gated: DataFrame) -> DataFrame:
    """``rejected_by, n, share`` with null for the accepted ones."""
    counts = gated.groupBy("rejected_by").agg(F.count(F.lit(1)).alias("n"))
    total = gated.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("rejected_by", "n", (F.col("n") / F.col("total")).alias("share"))


def round_trip(ranked: DataFrame, golds: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``qid, passed, score``: any gold among the k best; score is one over the best rank, 0 if none."""
    best = ranked.filter(F.col("rank") <= k).join(golds, ["qid", "item"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    return candidates.select("qid").join(best, "qid", "left").select("qid", F.col("rank").isNotNull().alias("passed"), F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("score"))


def uniqueness(ranked: DataFrame, golds: DataFrame, answerable: Column, top: int = 5) -> DataFrame:
    """``qid, promoted``: the first ``top`` items that aren't gold, by rank, of those that alone answer the query.

    ``ranked`` has to reach rank ``top`` plus the number of golds. A query is unique if it has no row; ``unique_check``
    says what follows from that.
    """
    from pyspark.sql import Window

    others = ranked.join(golds, ["qid", "item"], "left_anti")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    near = others.withColumn("place", place).filter(F.col("place") <= top).filter(answerable)
    return near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x.item).alias("promoted"))


def unique_check(candidates: DataFrame, promoted: DataFrame, mode: str = "promote") -> DataFrame:
    """``qid, passed, score, reason, promoted``: items that answer too are added to the gold, or the query is dropped (``reject``)."""
    if mode not in ("promote", "reject"):
        raise ValueError(f"uniqueness mode must be promote or reject, got {mode!r}")
    none = F.array().cast("array<string>")
    rows = candidates.select("qid").join(promoted, "qid", "left").withColumn("promoted", F.coalesce(F.col("promoted").cast("array<string>"), none))
    n = F.size("promoted")
    kept, leaky = F.lit(mode == "promote") | (n == 0), F.concat(n.cast("string"), F.lit(" other items also answer"))
    reason = F.when(n == 0, F.lit("gold is unique")).when(kept, F.lit("promoted")).otherwise(leaky)
    return rows.select("qid", kept.alias("passed"), n.cast("double").alias("score"), reason.alias("reason"), F.when(kept, F.col("promoted")).otherwise(none).alias("promoted"))


def binary_qrels(rows: DataFrame) -> DataFrame:
    """``query_id, chunk_id, grade``: the seed's chunks, then promotions, each once."""
    every = F.array_distinct(F.concat("chunk_ids", F.coalesce("promoted", F.array().cast("array<string>"))))
    return rows.select("query_id", F.explode(every).alias("chunk_id"), F.lit(1).alias("grade"))


def nearest_qrels(rows: DataFrame, nearest: DataFrame) -> DataFrame:
    """The nearest chunk as the only gold; the seed's chunks for queries without a vector."""
    near = nearest.select(F.col("qid").alias("query_id"), F.col("item").alias("near"))
    joined = rows.join(near, "query_id", "left")
    chosen = F.when(F.col("near").isNotNull(), F.array("near")).otherwise(F.array_distinct("chunk_ids"))
    return joined.select("query_id", F.explode(chosen).alias("chunk_id"), F.lit(1).alias("grade"))


def annotation_records(queries: DataFrame, qrels: DataFrame, hashes: DataFrame, version: str) -> DataFrame:
    """``record_id, query_id, qrels, crucial, content_hashes, benchmark_version`` of every query that has gold."""
    held = qrels.join(hashes.select("chunk_id", "content_hash"), "chunk_id", "left")
    maps = held.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "grade")))).alias("qrels"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("content_hash").isNotNull(), F.struct("chunk_id", "content_hash"))))).alias("content_hashes"),
        F.array_sort(F.collect_set("chunk_id")).alias("crucial"),
    )
    return queries.join(maps, "query_id").select(record_id("query_id", "text").alias("record_id"), "query_id", "text", "qrels", "crucial", "content_hashes", F.lit(version).alias("benchmark_version"))


def flag_memorized(records: DataFrame, nearest: DataFrame, least: float = 0.9) -> DataFrame:
    """Adds ``memorized, memorized_cos``: whether a production query is as near as that. ``nearest`` has ``record_id, score``; flagged records stay."""
    near = nearest.groupBy("record_id").agg(F.max("score").alias("__score"))
    hit = F.coalesce(F.col("__score") >= least, F.lit(False))
    return records.join(near, "record_id", "left").withColumn("memorized", hit).withColumn("memorized_cos", F.when(hit, F.col("__score"))).drop("__score")


def curate(records: DataFrame, *, mix: dict[str, float] | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """First of equal texts, then the mix of strata, then the cap; ``memorized`` stays a flag."""
    kept = first_by(records, "text")
    if mix:
        kept = apply_mix(kept, mix, seed=seed)
    return hash_sample(kept, "record_id", most, "cap", seed) if most is not None else kept
