"""Graded judgements: agreement of judges, pooled qrels, graded nDCG, and what unjudged items do to a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRADES = 4


def confusion(pairs: DataFrame, grades: int = GRADES) -> DataFrame:
    """``a, b, n`` for every two grades, ``a`` and ``b`` being the two judges' grades of an item; rows with a null grade don't count."""
    counts = pairs.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    steps = F.sequence(F.lit(0), F.lit(grades - 1))
    every = pairs.sparkSession.range(1).select(F.explode(steps).alias("a")).select("a", F.explode(steps).alias("b"))
    return every.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def weighted_kappa(matrix: DataFrame, grades: int = GRADES, quadratic: bool = True) -> DataFrame:
    """``kappa`` from ``a, b, n``: one minus weighted disagreement over that of independent judges; null if neither judge varies."""
    apart = F.abs(F.col("a") - F.col("b")) / (grades - 1)
    weight = apart * apart if quadratic else apart
    all_ = Window.partitionBy()
    rows = matrix.select("a", "b", "n", weight.alias("w"), F.sum("n").over(Window.partitionBy("a")).alias("na"), F.sum("n").over(Window.partitionBy("b")).alias("nb"), F.sum("n").over(all_).alias("all"))
    sums = rows.agg(F.sum(F.col("w") * F.col("n")).alias("seen"), F.sum(F.col("w") * F.col("na") * F.col("nb") / F.nullif(F.col("all"), F.lit(0))).alias("chance"))
    return sums.select((1 - F.col("seen") / F.nullif(F.col("chance"), F.lit(0.0))).alias("kappa"))


def ordinal_alpha(matrix: DataFrame, grades: int = GRADES) -> DataFrame:
    """``alpha`` of two judges with the ordinal distance, from ``a, b, n``; null if all grades are equal."""
    both = matrix.select("a", "b", "n").unionByName(matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("o"))
    held = both.groupBy("a").agg(F.sum("o").alias("n_a"))
    upto = held.withColumn("upto", F.sum("n_a").over(Window.orderBy("a")))  # one row for each grade
    x, y = upto.select(F.col("a"), F.col("n_a").alias("x"), F.col("upto").alias("ux")), upto.select(F.col("a").alias("b"), F.col("n_a").alias("y"), F.col("upto").alias("uy"))
    rows = both.join(x, "a").join(y, "b")
    # ordinal distance: how many values lie from one grade to the other, the two ends counted half
    between = F.abs(F.col("ux") - F.col("uy")) + F.when(F.col("a") < F.col("b"), F.col("x") / 2 - F.col("y") / 2).otherwise(F.col("y") / 2 - F.col("x") / 2)
    d2 = F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(between * between)
    sums = rows.agg(F.sum(F.col("o") * d2).alias("seen"), F.sum(F.col("x") * F.col("y") * d2).alias("chance"), F.sum("o").alias("n"))
    return sums.select((1 - (F.col("n") - 1) * F.col("seen") / F.nullif(F.col("chance"), F.lit(0.0))).alias("alpha"))


def bias_report(matrix: DataFrame, least: int = 2) -> DataFrame:
    """``mean_delta, over, under, accuracy, precision, recall``: ``b`` against ``a``, the last three for grades of at least ``least``."""
    n, a, b = F.col("n"), F.col("a") >= least, F.col("b") >= least
    both, none, said, true = (F.sum(F.when(c, n).otherwise(0)) for c in (a & b, ~a & ~b, b, a))
    total = F.nullif(F.sum("n"), F.lit(0))
    return matrix.agg(
        (F.sum((F.col("b") - F.col("a")) * n) / total).alias("mean_delta"),
        (F.sum(F.when(F.col("b") > F.col("a"), n).otherwise(0)) / total).alias("over"),
        (F.sum(F.when(F.col("b") < F.col("a"), n).otherwise(0)) / total).alias("under"),
        ((both + none) / total).alias("accuracy"),
        (both / F.nullif(said, F.lit(0))).alias("precision"),
        (both / F.nullif(true, F.lit(0))).alias("recall"),
    )


def calibration(kappa: float, accuracy: float, n: int) -> dict[str, object]:
    """``verdict`` and ``provisional``; fewer than 50 labelled pairs are an error, fewer than 200 provisional."""
    if n < 50:
        raise ValueError(f"{n} labelled pairs are too few to calibrate a judge; 50 at least")
    verdict = "PASS" if kappa >= 0.6 and accuracy >= 0.9 else "MARGINAL" if kappa >= 0.4 else "FAIL"
    return {"verdict": verdict, "provisional": n < 200}


def pooled(runs: DataFrame, golds: DataFrame, exact: DataFrame, depth: int = 10, most: int = 50) -> DataFrame:
    """``qid, item, capped``: the union of the systems' ``depth`` best and the golds, at most ``most`` items of a query.

    ``runs`` has ``system, qid, item, rank``, ``golds`` ``qid, item``, ``exact`` ``qid, item, score`` of the pooled pairs. What
    is above the budget is left out by falling score, ties by item; golds never are. ``capped`` says that it happened.
    """
    held = golds.select("qid", "item", F.lit(True).alias("gold"))
    found = runs.filter(F.col("rank") <= depth).select("qid", "item", F.lit(False).alias("gold"))
    every = held.unionByName(found).groupBy("qid", "item").agg(F.max("gold").alias("gold")).join(exact, ["qid", "item"], "left")
    by = Window.partitionBy("qid").orderBy(F.desc("gold"), F.desc_nulls_last("score"), "item")
    placed = every.select("qid", "item", "gold", F.row_number().over(by).alias("place"))
    capped = placed.groupBy("qid").agg((F.max("place") > most).alias("capped"))
    return placed.filter((F.col("place") <= most) | F.col("gold")).join(capped, "qid").select("qid", "item", "capped")


def graded_ndcg(queries: DataFrame, grades: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """``qid, score``: nDCG@k with the gain ``2**grade - 1``; with grades 0 and 1 it is the binary one.

    ``grades`` has ``qid, item, grade``; the ideal takes grades from the largest. A query without a grade above 0 scores 0.
    """
    relevant = grades.filter("grade > 0")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    got = ranks.filter(F.col("rank") <= k).join(relevant, ["qid", "item"]).groupBy("qid").agg(F.sum(gain / F.log2(1 + F.col("rank"))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "item"))
    ideal = relevant.withColumn("place", place).filter(F.col("place") <= k).groupBy("qid").agg(F.sum(gain / F.log2(1 + F.col("place"))).alias("ideal"))
    return queries.select("qid").join(ideal, "qid", "left").join(got, "qid", "left").select("qid", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("score"))


def hole_rate(runs: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """``system, hole_rate``: the share of the k best of all queries without any judgement; grade 0 is a judgement."""
    top = runs.filter(F.col("rank") <= k)
    known = judged.select("qid", "item").distinct().withColumn("known", F.lit(1))
    return top.join(known, ["qid", "item"], "left").groupBy("system").agg(F.avg(F.when(F.col("known").isNull(), 1.0).otherwise(0.0)).alias("hole_rate"))


def condensed(runs: DataFrame, judged: DataFrame) -> DataFrame:
    """``system, qid, item, rank`` of the judged items alone, ranked anew."""
    kept = runs.join(judged.select("qid", "item").distinct(), ["qid", "item"], "left_semi")
    return kept.select("system", "qid", "item", F.row_number().over(Window.partitionBy("system", "qid").orderBy("rank")).alias("rank"))


def needs_pooling(tau: float, ap: float, least_tau: float = 0.9, least_ap: float = 0.8) -> bool:
    """Rankings agree over all but not at the top: graded, pooled qrels are called for."""
    return tau >= least_tau and ap < least_ap
