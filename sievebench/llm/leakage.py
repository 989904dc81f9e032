"""Records of evaluation splits whose text is also, exactly or nearly, in the training split.

Normalised records are cut into content-defined chunks by the hash of their words (see ``overlap``), chunk digests are
joined across the splits, and the lengths of the chunks that a pair shares are summed. The sum is a lower bound of the
words shared; where it isn't the whole smaller record, the words of the pair are counted exactly. Equal records are one
bag, so a text that a third of all rows repeat is joined once. Null and empty texts, and rows of no split, match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebench.llm import overlap
from sievebench.session import materialise

EVALUATION = ("anchor", "oracle", "bench_dev", "bench_test")


def cross_split_overlaps(
    records: DataFrame,
    *,
    key: str,
    text: str = "text",
    split: str = "split",
    source: str = "source",
    train: str = "train",
    evaluation: tuple[str, ...] = EVALUATION,
    threshold: float = overlap.THRESHOLD,
) -> DataFrame:
    """One row for each evaluation record: ``key, split, source, best, shared, partners``.

    ``best`` is the largest overlap with a training text (null if none reaches the threshold), ``shared`` the words
    shared with that text, ``partners`` the number of different training texts that reach it.
    """
    used = records.filter(F.col(split).isin(train, *evaluation))
    hot = overlap.hot_words(used, text, overlap.FLOOR)
    plain = used.select((F.col(split) == train).alias("train"), F.col(key).alias("key"), F.col(split).alias("split"), F.col(source).alias("source"), F.col(text).alias("text"))
    signed = materialise(overlap.signatures(plain, keep=["train", "key", "split", "source"], text="text", hot=hot), "leakage")
    is_train = F.col("train")
    candidates = overlap.met(signed, hot, threshold=threshold, cross="train")
    mine = overlap.words_of(signed.filter(~is_train)).withColumnRenamed("words", "w")
    other = overlap.words_of(signed.filter(is_train)).select(F.col("bag").alias("other"), F.col("words").alias("v"))
    n1, n2 = F.size("w"), F.size("v")
    # the chunks posted by both are shared words for certain; where they don't cover the smaller record the rest is counted
    shared = F.when(F.col("met") == F.least(n1, n2), F.col("met")).otherwise(F.size(F.array_intersect("w", "v")))
    matched = (
        candidates.join(mine, "bag")
        .join(other, "other")
        .select("bag", "other", n1.alias("n1"), n2.alias("n2"), shared.cast("int").alias("shared"))
        .filter(overlap.enough(F.col("shared"), F.col("n1"), F.col("n2"), threshold))
        .withColumn("part", F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared")))
        .groupBy("bag")
        .agg(F.max(F.struct("part", "shared")).alias("top"), F.count_distinct("other").alias("partners"))
    )
    return (
        signed.filter(~is_train)
        .select("key", "split", "source", "bag")
        .join(matched, "bag", "left")
        .select(
            F.col("key").alias(key),
            "split",
            "source",
            F.col("top.part").alias("best"),
            F.col("top.shared").alias("shared"),
            F.coalesce("partners", F.lit(0)).alias("partners"),
        )
    )


def leak_report(overlaps: DataFrame) -> DataFrame:
    """Records and affected records of each split and source."""
    hit = F.col("partners") > 0
    return overlaps.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(hit).alias("affected"),
        F.count_if(hit & (F.col("best") == 1)).alias("same"),
        F.round(F.avg(hit.cast("double")), 6).alias("share"),
    )
