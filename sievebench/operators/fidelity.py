"""How alike two sets of vectors are: similarity histograms, classifier two-sample tests, kernel distance, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievebench.functions.text import hash_hex, word_ngrams


def histogram_kl(real: DataFrame, synthetic: DataFrame, bins: int = 50, eps: float = 1e-6) -> DataFrame:
    """``kl`` of the histograms of ``score`` over shared equal bins, ``eps`` added to each count before normalising."""
    both = real.select("score", F.lit(1).alias("r")).unionByName(synthetic.select("score", F.lit(0).alias("r")))
    edges = both.agg(F.min("score").alias("lo"), (F.max("score") + 1e-9).alias("hi"))
    placed = both.join(F.broadcast(edges)).select("r", F.least(F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).alias("bin"))
    counts = placed.groupBy("bin").agg(F.sum("r").alias("p"), F.sum(1 - F.col("r")).alias("q"))
    grid = real.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left")
    pq = grid.select((F.coalesce("p", F.lit(0)) + eps).alias("p"), (F.coalesce("q", F.lit(0)) + eps).alias("q"))
    total = pq.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    p, q = F.col("p") / F.col("tp"), F.col("q") / F.col("tq")
    return pq.join(F.broadcast(total)).agg(F.sum(p * F.log(p / q)).alias("kl"))


def distinct_n(texts: DataFrame, text: str, n: int) -> DataFrame:
    """``distinct_n``: different over all word n-grams of all texts; 0 if there are none."""
    grams = texts.select(F.explode(word_ngrams(text, n)).alias("gram"))
    counts = grams.groupBy("gram").count()
    return counts.agg(F.coalesce(F.count(F.lit(1)) / F.sum("count"), F.lit(0.0)).alias("distinct_n"))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 100) -> np.ndarray:
    """Coefficients, the intercept last, of an L2-penalised logistic regression by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], 1 / c), 0]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        gradient = a.T @ (p - y) + penalty * w
        h = (a * np.maximum(p * (1 - p), 1e-12)[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, gradient)
        w -= step * min(1.0, 10 / max(np.linalg.norm(step), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve by rank sums, ties at their mean rank."""
    ranks = pd.Series(score).rank().to_numpy()
    n1 = int(y.sum())
    n0 = len(y) - n1
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n0 and n1 else float("nan")


def fold_models(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int) -> list[np.ndarray | None]:
    """For each fold the coefficients fitted on the other folds' rows, in the scale of ``x``, the intercept last; None without two sides."""
    out: list[np.ndarray | None] = []
    for f in range(folds):
        train = fold != f
        if len(np.unique(y[train])) < 2:
            out.append(None)
            continue
        mean, std = x[train].mean(0), x[train].std(0)
        std[std == 0] = 1
        w = fit_logistic((x[train] - mean) / std, y[train])
        out.append(np.r_[w[:-1] / std, w[-1] - (mean / std) @ w[:-1]])
    return out


def _fit_group(folds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        models = fold_models(x, pdf["side"].to_numpy(), pdf["fold"].to_numpy(), folds)
        kept = [(pdf["cluster"].iloc[0], f, w.tolist()) for f, w in enumerate(models) if w is not None]
        return pd.DataFrame(kept, columns=["cluster", "fold", "w"])

    return run


def auc_by(scored: DataFrame, by: list[str]) -> DataFrame:
    """``by, auc`` of ``by, side, score``: rank sums with ties at their mean rank; null with one side only.

    Ranks are taken within ranges of the score and moved by the counts of the ranges before, so no task orders a whole group.
    """
    ranged = scored.withColumn("__r", F.floor(4096 / (1 + F.exp(-F.col("score")))))
    ties = ranged.groupBy(*by, "__r", "score").agg(F.sum("side").alias("ones"), F.count(F.lit(1)).alias("n"))
    sizes = ties.groupBy(*by, "__r").agg(F.sum("n").alias("k"))
    before = sizes.select(*by, "__r", F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    upto = F.sum("n").over(Window.partitionBy(*by, "__r").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ties.join(before, [*by, "__r"]).withColumn("rank", F.col("__before") + upto - (F.col("n") - 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("ones") * F.col("rank")).alias("s"), F.sum("ones").alias("n1"), F.sum(F.col("n") - F.col("ones")).alias("n0"))
    pairs = F.nullif(F.col("n1") * F.col("n0"), F.lit(0))
    return sums.select(*by, ((F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / pairs).alias("auc"))


def _two_sample(both: DataFrame, folds: int, least: int, most: int, name: str, seed: int) -> DataFrame:
    """``cluster, n, auc`` of ``cluster, side, id, vector``; see ``c2st``."""
    from sievebench.operators.sampling import dense_order
    from sievebench.session import materialise

    hashed = both.withColumn("h", hash_hex(seed, name, "side", "id"))
    ord_ = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    rows = dense_order(hashed.withColumn("__key", F.concat_ws("|", F.col("cluster").cast("string"), "side")).withColumn("__ord", ord_), "__ord", "__key", spread=1 << 20)
    sizes = both.groupBy("cluster").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")).select("cluster", F.least("n0", "n1").alias("size"))
    used = rows.drop("n").join(sizes, "cluster").filter((F.col("size") >= max(least, folds)) & (F.col("i") < F.col("size")))
    used = materialise(used.select("cluster", "side", "h", "vector", "size", "i", F.pmod("i", F.lit(folds)).cast("int").alias("fold")), "sides")
    kind = both.schema["cluster"].dataType.simpleString()
    models = used.filter(F.col("i") < most).groupBy("cluster").applyInPandas(_fit_group(folds), f"cluster {kind}, fold int, w array<double>")
    models = materialise(models, "models")  # folds of each cluster
    score = F.aggregate(F.zip_with("vector", F.slice("w", 1, F.size("w") - 1), lambda a, b: a * b), F.element_at("w", -1), lambda s, v: s + v)
    scored = used.join(models, ["cluster", "fold"]).select("cluster", "fold", "side", F.round(score, 12).alias("score"))
    found = auc_by(scored, ["cluster", "fold"]).groupBy("cluster").agg(F.avg("auc").alias("auc"))
    return sizes.join(found, "cluster", "left").select("cluster", F.col("size").alias("n"), "auc")


def c2st(real: DataFrame, synthetic: DataFrame, *, folds: int = 5, most: int = 20_000, seed: int = 0) -> DataFrame:
    """``n, auc`` of a classifier that tells real from synthetic vectors (``id, vector``), both sides equally many.

    Rows are dealt to folds in hash order. A fold's classifier is fitted on the other folds' rows, at most the first
    ``most`` of a side (a documented bound of the fit alone); every row is scored by the classifier of its fold. Null with
    fewer rows than folds.
    """
    both = real.select("id", "vector", F.lit(0).alias("side")).unionByName(synthetic.select("id", "vector", F.lit(1).alias("side")))
    return _two_sample(both.withColumn("cluster", F.lit("all")), folds, 2, most, "c2st", seed).select("n", "auc")


def within_cluster_c2st(real: DataFrame, synthetic: DataFrame, *, folds: int = 3, least: int = 30, most: int = 5_000, seed: int = 0) -> DataFrame:
    """``cluster, n, auc`` for each cluster; null where a side has fewer than ``least``. The fit is bounded as in ``c2st``."""
    both = real.select("id", "vector", "cluster", F.lit(0).alias("side")).unionByName(synthetic.select("id", "vector", "cluster", F.lit(1).alias("side")))
    return _two_sample(both, folds, least, most, "wc2st", seed)


def c2st_coefficients(real: DataFrame, synthetic: DataFrame, *, most: int = 20_000, seed: int = 0) -> DataFrame:
    """``pos, coefficient`` of the classifier of ``c2st`` refitted on both sides (at most ``most`` rows of each), in standardised units.

    Empty where a side has no row.
    """
    from sievebench.operators.ranking import hash_sample

    sides = []
    for side, rows in enumerate((real, synthetic)):
        held = hash_sample(rows.select(F.col("id").cast("string").alias("id"), "vector"), "id", most, f"coefficients{side}", seed)
        sides.append(np.array([r["vector"] for r in held.orderBy("id").select("vector").collect()], np.float64))
    n = min(len(x) for x in sides)
    found = []
    if n:
        x = np.concatenate([s[:n] for s in sides])
        std = x.std(0)
        std[std == 0] = 1
        found = [(i, float(c)) for i, c in enumerate(fit_logistic((x - x.mean(0)) / std, np.r_[np.zeros(n), np.ones(n)])[:-1])]
    return real.sparkSession.createDataFrame(found, "pos int, coefficient double")


def _sums(gamma: float):
    def run(held, stream):
        import pyarrow as pa

        _, y = held
        yn, total = (y * y).sum(1), 0.0
        for _, x in stream if len(y) else ():
            d2 = np.maximum((x * x).sum(1)[:, None] + yn[None, :] - 2 * x @ y.T, 0)
            total += float(np.exp(-gamma * d2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    return run


def median_gamma(real: DataFrame, synthetic: DataFrame, *, pool: int = 500, seed: int = 0) -> float:
    """One over the median positive squared distance among the first ``pool`` rows of both sides in hash order; 1 if there is none."""
    from sievebench.operators.ranking import hash_sample

    both = real.select(F.concat(F.lit("0|"), F.col("id").cast("string")).alias("id"), "vector").unionByName(synthetic.select(F.concat(F.lit("1|"), F.col("id").cast("string")).alias("id"), "vector"))
    x = np.array([r["vector"] for r in hash_sample(both, "id", pool, "median", seed).collect()], np.float64)
    if len(x) < 2:
        return 1.0
    n = (x * x).sum(1)
    d2 = (n[:, None] + n[None, :] - 2 * x @ x.T)[np.triu_indices(len(x), 1)]
    d2 = d2[d2 > 1e-12]
    return float(1 / np.median(d2)) if len(d2) else 1.0


def mmd_rbf(real: DataFrame, synthetic: DataFrame, gamma: float | None = None, *, dim: int = 64, block: int = 32_768, seed: int = 0) -> DataFrame:
    """``mmd``: the unbiased squared kernel distance of two sets of vectors (``id, vector``), not below 0; all rows count.

    Kernel sums are taken in pairs of blocks. Without ``gamma`` it is one over the median squared distance.
    """
    from sievebench.operators.similarity import in_blocks

    spark = real.sparkSession
    n, m = real.count(), synthetic.count()
    if n < 2 or m < 2:
        return spark.createDataFrame([(None,)], "mmd double")
    gamma = median_gamma(real, synthetic, seed=seed) if gamma is None else gamma

    def total(a: DataFrame, b: DataFrame) -> float:
        asked, rows = b.select(F.col("id").alias("qid"), "vector"), a.select(F.col("id").alias("item"), "vector")
        return in_blocks(asked, rows, _sums(gamma), "total double", dim=dim, block=block).agg(F.sum("total")).first()[0] or 0.0

    value = (total(real, real) - n) / (n * (n - 1)) + (total(synthetic, synthetic) - m) / (m * (m - 1)) - 2 * total(real, synthetic) / (n * m)
    return spark.createDataFrame([(max(value, 0.0),)], "mmd double")


def fidelity_objective(kl: float, c2st_auc: float, pass_rate: float, n: int, alpha: float = 1.0, floor: float = 0.0) -> float:
    """What a prompt optimiser maximises; -1e9 for too low a pass rate or fewer than two vectors."""
    if pass_rate < floor or n < 2:
        return -1e9
    return -(kl + alpha * max(0.0, c2st_auc - 0.5))
