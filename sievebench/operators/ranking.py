"""Rank metrics, agreement of rankings, and resampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievebench.functions.text import hash_hex, hash_uniform


def ndcg(queries: DataFrame, relevant: DataFrame, ranks: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """``qid, score``: binary nDCG@k with optimistic ties.

    ``relevant`` has the gold pairs ``qid, item`` (all count for the ideal, dropped ones too), ``ranks`` has
    ``qid, item, rank`` of those that are searched. A query without gold scores 0.
    """
    by = by or []
    gain = ranks.filter(F.col("rank") <= k).groupBy(*by, "qid").agg(F.sum(1 / F.log2(1 + F.col("rank"))).alias("dcg"))
    ideal = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("r"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("r", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(1 + i))
    base = queries.select("qid").join(ideal, "qid", "left")
    if by:
        base = base.join(F.broadcast(ranks.select(*by).distinct()))  # one row for each of a dozen systems
    return base.join(gain, [*by, "qid"], "left").select(*by, "qid", F.coalesce(F.col("dcg") / F.when(F.col("r") > 0, best), F.lit(0.0)).alias("score"))


def drop_mask(items: DataFrame, frac: float, seed: int = 0, name: str = "drop") -> DataFrame:
    """``item, dropped``: exactly ``floor(frac * n)`` items, chosen by hash.

    Ranks among all items come from counts of hash prefixes, so no task ever holds the whole order.
    """
    return _first_by_hash(items, "item", name, seed, frac).withColumnRenamed("chosen", "dropped")


#: Rows that one task orders when all rows are ordered by hash.
BUCKET_ROWS = 100_000


def hash_digits(n: int) -> int:
    """How many hexadecimal digits part ``n`` rows into buckets of at most about ``BUCKET_ROWS``, two at least."""
    return max(2, math.ceil(math.log(max(n, 1) / BUCKET_ROWS, 16))) if n else 2


def _first_by_hash(rows: DataFrame, key: str, name: str, seed: int, frac: float | None = None, n: int | None = None) -> DataFrame:
    hashed = rows.select("*", hash_hex(seed, name, key).alias("__h")).withColumn("__b", F.substring("__h", 1, hash_digits(rows.count())))
    sizes = hashed.groupBy("__b").count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("__total", F.sum("count").over(Window.partitionBy(F.lit("all"))))
    placed = hashed.join(before.drop("count"), "__b")  # one row for each BUCKET_ROWS rows
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    take = F.lit(n) if n is not None else F.floor(F.lit(frac) * F.col("__total"))
    return placed.withColumn("chosen", place <= take).drop("__h", "__b", "__before", "__total")


def numbered(rows: DataFrame, key: str, name: str = "i") -> DataFrame:
    """Adds the place of each row in the order of ``key``, from 0; ``key`` must be unique.

    Rows are dealt to ranges of the key, so no task orders more than its range.
    """
    from sievebench.session import materialise

    parts = max(1, -(-rows.count() // BUCKET_ROWS))
    held = materialise(rows.repartitionByRange(parts, key).withColumn("__p", F.spark_partition_id()), "numbered")
    sizes = held.groupBy("__p").count()
    before = sizes.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1 + F.col("__before")
    return held.join(before, "__p").withColumn(name, place.cast("bigint")).drop("__p", "__before")


def exact_percentile(rows: DataFrame, column: str, share: float, few: int = 100_000) -> float | None:
    """The percentile with linear interpolation, null values left out; None for no rows.

    Counts in equal ranges narrow the range that holds the wanted places until few rows are left, so no task holds them all.
    """
    values = rows.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    if not n:
        return None
    at = share * (n - 1)
    places, below, left = (math.floor(at), math.ceil(at)), 0, n
    while left > few and low < high:
        width = (high - low) / 1024
        bucket = F.least(F.floor((F.col("x") - low) / width), F.lit(1023))
        part = values.filter((F.col("x") >= low) & (F.col("x") <= high)).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        seen, used = below, []
        for r in sorted(part.collect(), key=lambda r: r["b"]):
            if seen + r["n"] > places[0] and seen <= places[1]:
                used.append((seen, r))
            seen += r["n"]
        if used[0][1]["low"] == low and used[-1][1]["high"] == high:
            break
        below, low, high, left = used[0][0], used[0][1]["low"], used[-1][1]["high"], sum(r["n"] for _, r in used)
    if low == high:
        return low
    held = sorted(r["x"] for r in values.filter((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").count().select(F.explode(F.array_repeat("x", F.col("count").cast("int"))).alias("x")).collect())
    one, two = held[places[0] - below], held[places[1] - below]
    return one + (at - places[0]) * (two - one)


def hash_sample(rows: DataFrame, key: str, n: int, name: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement (all if there are fewer), chosen by hash."""
    return _first_by_hash(rows, key, name, seed, n=n).filter("chosen").drop("chosen")


def system_ranking(scores: DataFrame) -> DataFrame:
    """``system, mean, position`` from ``system, ord, score``: by falling mean, the lesser ord at a tie."""
    means = scores.groupBy("system", "ord").agg(F.avg("score").alias("mean"))
    return means.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.round("mean", 12)), "ord")))


def kendall_tau_b(pairs: DataFrame) -> DataFrame:
    """``tau`` of ``id, x, y``, corrected for ties; null if either is constant. For a bounded set such as systems."""
    a, b = pairs.alias("a"), pairs.alias("b")
    sx, sy = F.signum(F.col("a.x") - F.col("b.x")), F.signum(F.col("a.y") - F.col("b.y"))
    both = a.join(b, F.col("a.id") < F.col("b.id")).select(sx.alias("sx"), sy.alias("sy"))
    s = both.agg(F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.abs("sx")).alias("nx"), F.sum(F.abs("sy")).alias("ny"))
    return s.select((F.col("s") / F.sqrt(F.nullif(F.col("nx") * F.col("ny"), F.lit(0.0)))).alias("tau"))


def tau_ap(ranks: DataFrame) -> DataFrame:
    """``tau_ap`` of ``id, ref, cand`` (positions from 1): agreement that counts more at the top."""
    a, b = ranks.alias("a"), ranks.alias("b")
    above = a.join(b, F.col("b.cand") < F.col("a.cand")).groupBy(F.col("a.id").alias("id"), F.col("a.cand").alias("cand"))
    each = above.agg((F.count_if(F.col("b.ref") < F.col("a.ref")) / (F.first("a.cand") - 1)).alias("c"))
    n = ranks.agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("c").alias("c")).join(F.broadcast(n)).select(F.when(F.col("n") < 2, F.lit(1.0)).otherwise(2 * F.col("c") / (F.col("n") - 1) - 1).alias("tau_ap"))


def rbo_ext(ranks: DataFrame, p: float = 0.9) -> DataFrame:
    """``rbo`` of ``id, ref, cand`` (a position is null where the list lacks the item), extrapolated."""
    depth = ranks.agg(F.least(F.max("ref"), F.max("cand")).alias("k"))
    met = ranks.filter("ref IS NOT NULL AND cand IS NOT NULL").select(F.greatest("ref", "cand").alias("at"))
    grid = depth.select("k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("d"))
    x = grid.join(met, F.col("at") <= F.col("d"), "left").groupBy("k", "d").agg(F.count("at").alias("x"))
    term = F.pow(F.lit(p), F.col("d")) * F.col("x") / F.col("d")
    last = F.max(F.when(F.col("d") == F.col("k"), F.col("x") / F.col("k") * F.pow(F.lit(p), F.col("k"))))
    return x.agg((F.sum(term) * ((1 - p) / p) + last).alias("rbo"))


def bootstrap_pvalue(deltas: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """``delta, p_value``: the mean difference, and the share of bootstrap means that aren't above 0.

    ``deltas`` has ``i`` (0..n-1, dense) and ``delta``. Draw ``j`` of resample ``b`` is a hash of both, so every engine
    draws the same. The join is on the drawn number; sums are taken before anything else is shuffled.
    """
    n = deltas.agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"))
    spark = deltas.sparkSession
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 65536)))  # no array holds all draws of a resample
    grid = spark.range(n_boot).select(F.col("id").alias("b")).join(F.broadcast(n.filter("n > 0"))).select("b", "n", blocks.alias("o"))
    grid = grid.select("b", "n", F.explode(F.sequence(F.col("o") * 65536, F.least(F.col("o") * 65536 + 65535, F.col("n") - 1))).alias("j"))
    draws = grid.select("b", F.floor(hash_uniform(seed, "boot", "b", "j") * F.col("n")).cast("bigint").alias("i"))
    means = draws.join(deltas, "i").groupBy("b").agg(F.avg("delta").alias("m"))
    p = means.agg((F.count_if(F.round("m", 12) <= 0) / F.count(F.lit(1))).alias("p_value"))
    return n.join(F.broadcast(p)).select(F.col("mean").alias("delta"), "p_value")


def make_zoo(d: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Twelve retrieval systems as matrices: the exact one, noisy ones and projections.

    The noise levels and rank shares are fixed values.
    """
    rng = np.random.default_rng(seed)
    zoo = {"exact": np.eye(d)}
    for sigma in (0.10, 0.28, 0.30, 0.32, 0.34, 0.50, 0.75):
        zoo[f"noise_{sigma:.2f}"] = noise_transform(d, sigma, rng)
    for share in (0.75, 0.5, 0.4375, 0.375):
        q, _ = np.linalg.qr(rng.standard_normal((d, max(2, round(d * share)))))
        zoo[f"rank_{share:g}"] = q @ q.T
    return zoo


def noise_transform(d: int, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return np.eye(d) + sigma * rng.standard_normal((d, d)) / math.sqrt(d)


def tau_b(x: np.ndarray, y: np.ndarray) -> float:
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    nx, ny = np.abs(dx).sum(), np.abs(dy).sum()
    return float((dx * dy).sum() / math.sqrt(nx * ny)) if nx and ny else float("nan")


def resampled_means(scores: DataFrame, systems: list[str], n_boot: int = 1000, seed: int = 0) -> np.ndarray:
    """Mean scores (resamples x systems) of bootstrap samples of the queries; ``scores`` has ``i`` (0..n-1) and a column for each system.

    Draw ``j`` of resample ``b`` is a hash of both, as in ``bootstrap_pvalue``. Only the means reach the driver.
    """
    n = scores.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    grid = scores.sparkSession.range(n_boot).select(F.col("id").alias("b")).join(F.broadcast(n))  # one row
    grid = grid.select("b", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 65536))).alias("o"))
    grid = grid.select("b", "n", F.explode(F.sequence(F.col("o") * 65536, F.least(F.col("o") * 65536 + 65535, F.col("n") - 1))).alias("j"))
    draws = grid.select("b", F.floor(hash_uniform(seed, "agreement", "b", "j") * F.col("n")).cast("bigint").alias("i"))
    counted = draws.groupBy("b", "i").agg(F.count(F.lit(1)).alias("k"))
    weighted = [(F.sum(F.col(f"`{s}`") * F.col("k")) / F.sum("k")).alias(f"m{i}") for i, s in enumerate(systems)]
    return np.array([list(r)[1:] for r in counted.join(scores, "i").groupBy("b").agg(*weighted).orderBy("b").collect()], float)


def agreement(anchor: np.ndarray, arm: np.ndarray, n_boot: int = 1000, seed: int = 0, p: float = 0.9, resampled: np.ndarray | None = None) -> dict[str, float]:
    """Agreement of mean scores (systems x queries) with a 95 % interval of tau over resampled arm queries (driver).

    With ``resampled`` (resamples x systems) the interval comes from these means, and ``arm`` may be means itself.
    """
    a, b = anchor.mean(1), arm.mean(1)
    n = len(a)
    ref, cand = (np.argsort(-np.round(m, 12), kind="stable") for m in (a, b))
    at = np.empty(n, int)
    at[ref] = np.arange(n)
    ap = 1.0 if n < 2 else 2 / (n - 1) * sum((at[cand[:i]] < at[cand[i]]).sum() / i for i in range(1, n)) - 1
    shared = [len(set(ref[:d]) & set(cand[:d])) for d in range(1, n + 1)]
    rbo = (1 - p) / p * sum(p**d * x / d for d, x in enumerate(shared, 1)) + shared[-1] / n * p**n
    rng = np.random.default_rng(seed)
    if resampled is None:
        resampled = np.array([arm[:, rng.integers(0, arm.shape[1], arm.shape[1])].mean(1) for _ in range(n_boot)])
    taus = [tau_b(a, m) for m in resampled]
    low, high = np.nanpercentile(taus, [2.5, 97.5]) if taus else (float("nan"),) * 2
    return {"tau": tau_b(a, b), "tau_low": float(low), "tau_high": float(high), "tau_ap": float(ap), "rbo": float(rbo)}


def gates(tau: float, ap: float) -> bool:
    return tau >= 0.9 and ap >= 0.8
