"""Demand of clusters: histograms, decay, tilting, importance weights, coverage and quotas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _all():
    """A window over all rows, used only on one row for each cluster."""
    return Window.partitionBy()




def cluster_range(spark, clusters: int) -> DataFrame:
    return spark.range(clusters).select(F.col("id").cast("int").alias("cluster"))


def proportions(labels: DataFrame, clusters: int) -> DataFrame:
    """``cluster, n, p_hat`` of every cluster, empty ones too; raises at run time if there are no labels.

    Null labels and those outside the range count for nothing.
    """
    counts = labels.groupBy("cluster").count()
    every = cluster_range(labels.sparkSession, clusters).join(counts, "cluster", "left").select("cluster", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))
    total = F.sum("n").over(_all())
    checked = F.when(total > 0, F.col("n") / total).otherwise(F.raise_error(F.lit("no labels to take proportions of")))
    return every.select("cluster", "n", checked.alias("p_hat"))


def responsibility_demand(responsibilities: DataFrame, half_life: float | None = None) -> DataFrame:
    """``component, demand`` from ``component, gamma`` and, for decay, ``ts`` in the unit of ``half_life``.

    The age counts from the newest time; if any time is missing nothing decays.
    """
    if half_life is None:
        weighted = responsibilities.select("component", F.col("gamma").alias("w"))
    else:
        newest = responsibilities.agg(F.max("ts").alias("newest"), F.count_if(F.col("ts").isNull()).alias("missing"))
        age = (F.col("newest") - F.col("ts")) * F.lit(math.log(2) / half_life)
        weight = F.when(F.col("missing") > 0, F.lit(1.0)).otherwise(F.exp(-age))
        weighted = responsibilities.join(F.broadcast(newest)).select("component", (F.col("gamma") * weight).alias("w"))  # one row
    sums = weighted.groupBy("component").agg(F.sum("w").alias("w"))
    return sums.select("component", (F.col("w") / F.sum("w").over(_all())).alias("demand"))


def tilt(demand: DataFrame, lam: float, p: str = "p_hat") -> DataFrame:
    """Adds ``tilted``: lam of the demand, the rest spread evenly, made to sum to one."""
    mixed = lam * F.col(p) + (1 - lam) / F.count(F.lit(1)).over(_all())
    return demand.withColumn("tilted", mixed).withColumn("tilted", F.col("tilted") / F.sum("tilted").over(_all()))


def importance(labels: DataFrame, demand: DataFrame) -> DataFrame:
    """``cluster, n, p_hat, weight, gap`` of every cluster; weight is null where there are no labels.

    ``gap`` is the demand of clusters without labels; the weight is the demand among covered ones over the share found.
    """
    n = labels.groupBy("cluster").count()
    t = demand.select("cluster", "p_hat").join(n, "cluster", "left").select("cluster", "p_hat", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))
    covered = F.sum(F.when(F.col("n") > 0, F.col("p_hat"))).over(_all())
    share = F.col("n") / F.sum("n").over(_all())
    return t.select(
        "cluster",
        "n",
        "p_hat",
        F.when(F.col("n") > 0, F.col("p_hat") / covered / share).alias("weight"),
        F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("p_hat"))).over(_all()), F.lit(0.0)).alias("gap"),
    )


def effective_size(weights: DataFrame, weight: str = "weight", n: str | None = None) -> DataFrame:
    """``ess``: the square of the sum over the sum of squares; ``n`` is how often each weight occurs."""
    w, k = F.col(weight), F.col(n) if n else F.lit(1)
    return weights.agg((F.pow(F.sum(w * k), F.lit(2)) / F.greatest(F.sum(w * w * k), F.lit(1e-12))).alias("ess"))


def post_stratified(scores: DataFrame, demand: DataFrame) -> DataFrame:
    """``estimate``: means by cluster, weighted by the demand of the clusters that have scores."""
    means = scores.groupBy("cluster").agg(F.avg("score").alias("mean"))
    return demand.join(means, "cluster").agg((F.sum(F.col("p_hat") * F.col("mean")) / F.sum("p_hat")).alias("estimate"))


def coverage(labels: DataFrame, demand: DataFrame, floors: list[int]) -> DataFrame:
    """``floor, covered``: the demand of clusters with at least so many labels; floor 1 is demand-weighted coverage."""
    n = labels.groupBy("cluster").count()
    t = demand.select("cluster", "p_hat").join(n, "cluster", "left")
    each = t.select(F.explode(F.array(*[F.lit(f) for f in floors])).alias("floor"), "p_hat", F.coalesce("count", F.lit(0)).alias("n"))
    return each.groupBy("floor").agg(F.coalesce(F.sum(F.when(F.col("n") >= F.col("floor"), F.col("p_hat"))), F.lit(0.0)).alias("covered"))


def empty_clusters(labels: DataFrame, clusters: int) -> DataFrame:
    return cluster_range(labels.sparkSession, clusters).join(labels.select("cluster"), "cluster", "left_anti")


def cluster_table(scores: DataFrame, demand: DataFrame, worst: int = 3) -> DataFrame:
    """``cluster, p_hat, n, mean_score, worst_rank``: the mean is null for an empty cluster, the rank beyond ``worst``."""
    means = scores.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    t = demand.select("cluster", "p_hat").join(means, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("mean_score"), "cluster"))
    return t.withColumn("place", place).select("cluster", "p_hat", "n", "mean_score", F.when(F.col("mean_score").isNotNull() & (F.col("place") <= worst), F.col("place")).alias("worst_rank"))


def largest_remainder(demand: DataFrame, seeds: int, weight: str = "tilted") -> DataFrame:
    """``cluster, quota``: floors of the shares, the shortfall to the largest remainders, the lesser cluster at a tie."""
    share = F.col(weight) * seeds
    t = demand.select("cluster", F.floor(share).alias("base"), (share - F.floor(share)).alias("rest"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("rest", 12)), "cluster"))
    short = F.lit(seeds) - F.sum("base").over(_all())
    return t.select("cluster", (F.col("base") + (place <= short).cast("bigint")).alias("quota"))


def allocate(tilted: list[float], seeds: int, least: int) -> list[int]:
    """Quotas with a floor for each cluster, what the floor needs coming one by one from the largest (driver, C numbers)."""
    n = len(tilted)
    if seeds < n * least:
        raise ValueError(f"{seeds} seeds cannot give each of {n} clusters {least}")
    shares = [w * seeds for w in tilted]
    quota = [math.floor(s) for s in shares]
    short = seeds - sum(quota)
    for c in sorted(range(n), key=lambda c: (-round(shares[c] - quota[c], 12), c))[:short]:
        quota[c] += 1
    need = sum(max(0, least - q) for q in quota)
    quota = [max(q, least) for q in quota]
    for _ in range(need):
        donor = max((c for c in range(n) if quota[c] > least), key=lambda c: (quota[c], -c))
        quota[donor] -= 1
    return quota


def quotas(spark, tilted: DataFrame, seeds: int, least: int) -> DataFrame:
    """``cluster, quota`` of ``allocate``, from ``cluster, tilted``: one row for each cluster passes through the driver."""
    rows = tilted.orderBy("cluster").collect()
    made = allocate([r["tilted"] for r in rows], seeds, least)
    return spark.createDataFrame([(r["cluster"], q) for r, q in zip(rows, made, strict=True)], "cluster int, quota long")


def transport(found: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """``component, cluster, share``: the share of each component's mass that falls in each cluster.

    ``found`` has ``component, cluster, gamma``. A component without mass goes to its cluster in ``homes``
    (``component, cluster``), where its mean lies.
    """
    sums = found.groupBy("component", "cluster").agg(F.sum("gamma").alias("g"))
    total = F.sum("g").over(Window.partitionBy("component"))
    rows = sums.withColumn("total", total)
    out = rows.filter(F.col("total") >= 1e-12).select("component", "cluster", (F.col("g") / F.col("total")).alias("share"))
    if homes is None:
        return out
    starved = homes.join(out.select("component").distinct(), "component", "left_anti")
    return out.unionByName(starved.select("component", "cluster", F.lit(1.0).alias("share")))


def projected_demand(shares: DataFrame, demand: DataFrame, clusters: int) -> DataFrame:
    """``cluster, p_hat``: demand by component (``component, demand``) carried to clusters by ``transport``, made to sum to one."""
    mass = shares.join(demand, "component").groupBy("cluster").agg(F.sum(F.col("share") * F.col("demand")).alias("m"))
    every = cluster_range(shares.sparkSession, clusters).join(mass, "cluster", "left").select("cluster", F.coalesce("m", F.lit(0.0)).alias("m"))
    return every.select("cluster", (F.col("m") / F.sum("m").over(_all())).alias("p_hat"))


def ladder(candidates: list[int], counts: dict[int, list[int]], p_hats: dict[int, list[float]], *, seeds: int, least: int, lam: float = 0.7) -> tuple[int, list[dict]]:
    """The largest number of clusters whose every cluster has enough anchor queries and expects enough seeds, and each step's facts.

    ``counts`` and ``p_hats`` are anchor counts and demand for each candidate. If none will do, the smallest is taken.
    """
    log = []
    for c in sorted(candidates, reverse=True):
        expected = [seeds * (lam * p + (1 - lam) / c) for p in p_hats[c]]
        fits = min(counts[c]) >= least and min(expected) >= least - 1e-9
        log.append({"clusters": c, "least_anchor": min(counts[c]), "least_expected": min(expected), "fits": fits})
        if fits:
            return c, log
    return min(candidates), log
