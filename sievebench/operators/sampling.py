"""Deterministic samplers: every draw is a hash of a seed, a stream name and an id, so no result depends on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievebench.functions.text import hash_hex, hash_uniform
from sievebench.operators.ranking import _first_by_hash, hash_digits

STRATA = ("factoid", "howto", "keyword")


def dense_order(rows: DataFrame, ord_: str, by: str | None = None, spread: int = 65536) -> DataFrame:
    """Adds ``i``, the place from 0 by ``ord`` (within ``by``) and ``n``, the number of rows.

    Places come from counts of ranges of ``spread`` values of ``ord`` first, so that no task sorts all rows.
    """
    keys = [by] if by else []
    bucket = F.floor(F.col(ord_) / spread)
    held = rows.withColumn("__b", bucket)
    sizes = held.groupBy(*keys, "__b").count()
    outer = Window.partitionBy(*keys) if by else Window.partitionBy(F.lit("all"))
    before = sizes.select(*keys, "__b", F.coalesce(F.sum("count").over(outer.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("count").over(outer).alias("n"))
    joined = held.join(before, [*keys, "__b"])
    place = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(ord_)) - 1 + F.col("__before")
    return joined.withColumn("i", place.cast("bigint")).drop("__b", "__before")


def round_robin(seeds: DataFrame, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """Adds ``query_type``, the strata in turn within each cluster by ``k``, the place of the seed in its cluster."""
    return seeds.withColumn("query_type", F.element_at(F.array(*[F.lit(s) for s in strata]), (F.pmod("k", F.lit(len(strata))) + 1).cast("int")))


def uniform_seeds(chunks: DataFrame, n_seeds: int, seed: int = 0) -> DataFrame:
    """``seed_no, seed_id, chunk_id``: draws with replacement; ``chunks`` has ``ord, chunk_id``."""
    numbered = dense_order(chunks.select("ord", "chunk_id"), "ord")
    n = numbered.agg(F.max("n").alias("n"))
    draws = chunks.sparkSession.range(n_seeds).join(F.broadcast(n)).select(F.col("id").alias("seed_no"), F.floor(hash_uniform(seed, "uniform", "id") * F.col("n")).cast("bigint").alias("i"))
    return draws.join(numbered.select("i", "chunk_id"), "i").select("seed_no", F.format_string("seed-uniform-%05d", "seed_no").alias("seed_id"), "chunk_id")


def quota_seeds(chunks: DataFrame, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """``seed_no, seed_id, cluster, chunk_id, query_type``: draws with replacement from each cluster's own chunks.

    ``chunks`` has ``ord, chunk_id, cluster``, ``quotas`` has ``cluster, quota``. A cluster without chunks draws from all
    and keeps its number.
    """
    own = dense_order(chunks.select("ord", "chunk_id", "cluster"), "ord", "cluster")
    every = dense_order(chunks.select("ord", "chunk_id"), "ord")
    sizes = own.groupBy("cluster").agg(F.max("n").alias("own_n"))
    total = every.agg(F.max("n").alias("all_n"))
    before = F.coalesce(F.sum("quota").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = quotas.withColumn("before", before).join(sizes, "cluster", "left").join(F.broadcast(total))
    draws = plan.filter("quota > 0").select("cluster", "before", "own_n", "all_n", F.explode(F.sequence(F.lit(0), (F.col("quota") - 1).cast("int"))).alias("k"))
    draws = draws.select("cluster", "k", (F.col("before") + F.col("k")).alias("seed_no"), F.col("own_n").isNull().alias("empty"), F.floor(hash_uniform(seed, "quota", "cluster", "k") * F.coalesce("own_n", "all_n")).cast("bigint").alias("i"))
    found = draws.filter(~F.col("empty")).join(own.select("cluster", "i", "chunk_id"), ["cluster", "i"]).unionByName(draws.filter("empty").join(every.select("i", "chunk_id"), "i"))
    return round_robin(found).select("seed_no", F.format_string("seed-quota-%05d", "seed_no").alias("seed_id"), "cluster", "chunk_id", "query_type")


def partners(seeds: DataFrame, chunks: DataFrame, p_group: float, seed: int = 0) -> DataFrame:
    """Adds ``partner``: with probability ``p_group`` another chunk of the same document, picked by hash, else null.

    The pick is the least hash of seed and chunk; pairs are reduced by aggregation and never kept.
    """
    chosen = seeds.filter(hash_uniform(seed, "group", "seed_id") < p_group).select("seed_id", "chunk_id")
    docs = chunks.select("chunk_id", "doc_id").distinct()
    own = chosen.join(docs, "chunk_id").select("seed_id", F.col("chunk_id").alias("own"), "doc_id")
    pairs = own.join(docs, "doc_id").filter(F.col("chunk_id") != F.col("own"))
    best = pairs.groupBy("seed_id").agg(F.min(F.struct(hash_hex(seed, "partner", "seed_id", "chunk_id").alias("h"), "chunk_id")).alias("best"))
    return seeds.join(best.select("seed_id", F.col("best.chunk_id").alias("partner")), "seed_id", "left")


def split_by_hash(rows: DataFrame, key: str, fractions: dict[str, float], seed: int = 0, by: str | None = None) -> DataFrame:
    """Adds ``part``: exact floors of the fractions in hash order, the rest to the last name; ``by`` splits each group apart.

    Fractions must sum to one. With ``by`` a null group raises.
    """
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError("fractions must sum to 1")
    names, shares = list(fractions), list(fractions.values())
    if by is None:
        hashed = rows.withColumn("__h", hash_hex(seed, "split", key)).withColumn("__g", F.lit(""))
    else:
        checked = F.when(F.col(by).isNull(), F.raise_error(F.lit(f"a row has no {by}"))).otherwise(F.col(by).cast("string"))
        hashed = rows.withColumn("__g", checked).withColumn("__h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.concat(F.lit("split-"), F.col("__g")), F.col(key).cast("string")), 256))
    hashed = hashed.withColumn("__b", F.substring("__h", 1, hash_digits(rows.count())))
    sizes = hashed.groupBy("__g", "__b").count()
    w = Window.partitionBy("__g")
    before = sizes.select("__g", "__b", F.coalesce(F.sum("count").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("count").over(w).alias("__n"))
    placed = hashed.join(before, ["__g", "__b"])
    place = F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__h", key)) + F.col("__before")
    part, edge = F.lit(names[-1]), F.lit(0)
    tests = []
    for name, share in zip(names[:-1], shares[:-1], strict=True):
        edge = edge + F.floor(F.lit(share) * F.col("__n"))
        tests.append((place <= edge, name))
    for test, name in reversed(tests):
        part = F.when(test, F.lit(name)).otherwise(part)
    return placed.withColumn("part", part).drop("__g", "__h", "__b", "__before", "__n")


def apply_mix(records: DataFrame, mix: dict[str, float], key: str = "record_id", stratum: str = "stratum_key", seed: int = 0) -> DataFrame:
    """The largest sample with the wanted shares of strata; strata outside the mix are dropped.

    The scarcest stratum binds the total, and shares are rounded half to even.
    """
    counts = {r[0]: r[1] for r in records.filter(F.col(stratum).isin(list(mix))).groupBy(stratum).count().collect()}  # one row for each stratum named
    total = min((counts.get(s, 0) / f for s, f in mix.items() if f > 0), default=0)
    out = None
    for s, f in mix.items():
        part = _first_by_hash(records.filter(F.col(stratum) == s), key, "mix", seed, n=round(total * f)).filter("chosen").drop("chosen")
        out = part if out is None else out.unionByName(part)
    return out


def nested_reference(rows: DataFrame, key: str, most: int, name: str = "reference", seed: int = 0) -> DataFrame:
    """``key, place``: one subsample in hash order; a comparison of ``n`` rows takes its first ``n``, so all are nested."""
    from sievebench.operators.ranking import hash_sample

    kept = hash_sample(rows.select(key), key, most, name, seed)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash_hex(seed, name, key), key))
    return kept.select(key, place.alias("place"))  # at most ``most`` rows


def stratified_sample(rows: DataFrame, key: str, by: str, n: int, name: str, seed: int = 0) -> DataFrame:
    """``n`` rows (all, if there are fewer), dealt to the values of ``by`` in proportion by largest remainders, each by hash."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    all_ = Window.partitionBy(F.lit(0))  # one row for each stratum
    total = F.sum("__n").over(all_)
    take = F.least(F.lit(n), total)
    shares = sizes.select(by, (take * F.col("__n") / total).alias("__share"), take.alias("__take"))
    rest = F.col("__share") - F.floor("__share")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(rest, 12)), by))
    quota = F.floor("__share") + (place <= F.col("__take") - F.sum(F.floor("__share")).over(all_)).cast("int")
    quotas = shares.select(by, quota.alias("__quota"))
    at = F.row_number().over(Window.partitionBy(by).orderBy(hash_hex(seed, name, key), key))
    return rows.join(quotas, by).withColumn("__at", at).filter(F.col("__at") <= F.col("__quota")).drop("__at", "__quota")
