"""Queries on demand, coverage and retrieval scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.operators import demand as D
from sievebench.operators import ranking as R
from sievebench.operators.mixture import assign
from sievebench.operators.similarity import gold_ranks
from sievebench.plans import views as V
from sievebench.session import materialise
from sievebench.sources.benchmarks import max_grades
from sievebench.session import table


def _train_demand(spark: SparkSession, folder: str) -> DataFrame:
    clusters = len(V.centres(spark, folder))
    return D.proportions(V.labels(spark, folder, "train"), clusters)


def _ranked(spark: SparkSession, folder: str, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchor queries, their gold pairs, and the ranks of these under the exact system; every table is read once."""
    asked = materialise(V.query_vectors(spark, folder, "anchor").select("query_id", "vector"), "asked") if asked is None else asked
    corpus = materialise(V.corpus(spark, folder).select("item", "vector"), "corpus")
    gold = materialise(V.golds(spark, folder, asked, corpus), "gold")
    ranks = materialise(gold_ranks(gold, corpus, {"exact": np.eye(V.DIM)}), "ranks")
    return asked.select(F.col("query_id").alias("qid")), gold.select("qid", "item"), ranks.select("qid", "item", "rank")


def _scores(spark: SparkSession, folder: str, k: int = 10, ranked: tuple | None = None) -> DataFrame:
    """``qid, score`` of the anchor queries under the exact system."""
    return R.ndcg(*(ranked or _ranked(spark, folder)), k)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    held = V.labels(spark, folder, "anchor").select("query_id", "cluster")
    return _scores(spark, folder).join(held, F.col("qid") == F.col("query_id")).select("cluster", "score")


def flagship_demand_weighted_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    """nDCG@10 of anchor queries by cluster with the train demand: the per-cluster table of the benchmark report.

    Vectors of queries are read once, labelled in one pass, and shared by demand and scores.
    """
    asked = materialise(V.query_vectors(spark, folder).filter("split IN ('train', 'anchor')").select("query_id", "split", "vector"), "asked")
    centres = V.centres(spark, folder)
    labels = materialise(assign(asked, centres, ["query_id", "split"]), "labels")
    demand = D.proportions(labels.filter("split = 'train'").select("cluster"), len(centres))
    scores = _scores(spark, folder, 10, _ranked(spark, folder, asked.filter("split = 'anchor'").select("query_id", "vector")))
    held = labels.filter("split = 'anchor'").select(F.col("query_id").alias("qid"), "cluster")
    t = D.cluster_table(materialise(scores.join(held, "qid").select("cluster", "score"), "scores"), demand)
    return t.select("cluster", F.round("p_hat", 9).alias("p_hat"), "n", F.round("mean_score", 6).alias("mean_score"))


def op_a9_worst_clusters(spark: SparkSession, folder: str) -> DataFrame:
    t = D.cluster_table(materialise(_scored(spark, folder), "scores"), _train_demand(spark, folder))
    return t.filter("worst_rank IS NOT NULL").select("cluster", "worst_rank")


def op_a1_proportions(spark: SparkSession, folder: str) -> DataFrame:
    return _train_demand(spark, folder).select("cluster", "n", F.round("p_hat", 9).alias("p_hat"))


def op_a2_decayed_demand(spark: SparkSession, folder: str) -> DataFrame:
    held = V.labels(spark, folder, "train").select(F.col("cluster").alias("component"), F.lit(1.0).alias("gamma"), F.unix_micros("received_at").cast("double").alias("ts"))
    return D.responsibility_demand(held, 30 * 86400e6).select("component", F.round("demand", 9).alias("demand"))


def op_a3_tilt(spark: SparkSession, folder: str) -> DataFrame:
    return D.tilt(_train_demand(spark, folder), 0.7).select("cluster", F.round("tilted", 9).alias("tilted"))


def _importance(spark: SparkSession, folder: str) -> DataFrame:
    return D.importance(V.labels(spark, folder, "anchor"), _train_demand(spark, folder))


def op_a4_importance(spark: SparkSession, folder: str) -> DataFrame:
    return _importance(spark, folder).select("cluster", "n", F.round("weight", 6).alias("weight"), F.round("gap", 9).alias("gap"))


def op_a5_effective_size(spark: SparkSession, folder: str) -> DataFrame:
    return D.effective_size(_importance(spark, folder).filter("n > 0"), n="n").select(F.round("ess", 4).alias("ess"))


def op_a6_post_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return D.post_stratified(_scored(spark, folder), _train_demand(spark, folder)).select(F.round("estimate", 6).alias("estimate"))


def op_a7_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return D.coverage(V.labels(spark, folder, "oracle"), _train_demand(spark, folder), [1, 5, 20, 50]).select("floor", F.round("covered", 9).alias("covered"))


def op_a8_empty_clusters(spark: SparkSession, folder: str) -> DataFrame:
    few = V.labels(spark, folder, "oracle").groupBy("cluster").count().filter("count >= 20")
    return D.empty_clusters(few, len(V.centres(spark, folder)))


def op_s2_quota(spark: SparkSession, folder: str) -> DataFrame:
    return D.largest_remainder(D.tilt(_train_demand(spark, folder), 0.7), 500)


def op_r1_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).select(F.col("qid").alias("query_id"), F.round("score", 6).alias("score"))


def op_r12_truncated_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder, 3).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def op_r9_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Exact scores at 10 against those at 3, as paired differences in order of the query id."""
    ranked = _ranked(spark, folder)
    a, b = _scores(spark, folder, 10, ranked), _scores(spark, folder, 3, ranked).withColumnRenamed("score", "low")
    rows = a.join(b, "qid").select("qid", (F.round("score", 9) - F.round("low", 9)).alias("delta"))
    deltas = materialise(R.numbered(rows, "qid").select("i", "delta"), "deltas")
    return R.bootstrap_pvalue(deltas).select(F.round("delta", 6).alias("delta"), "p_value")


def op_r10_drop_mask(spark: SparkSession, folder: str) -> DataFrame:
    items = V.passages(spark, folder).select(F.col("chunk_id").alias("item"))
    return R.drop_mask(items, 0.1)


def op_r3_zoo(spark: SparkSession, folder: str) -> DataFrame:
    """Mean nDCG@10 of the twelve systems on the anchor queries (their matrices are random, so there is no SQL)."""
    gold = V.golds(spark, folder)
    ranks = materialise(gold_ranks(gold, V.corpus(spark, folder), R.make_zoo(V.DIM)), "zoo")
    queries = V.query_vectors(spark, folder, "anchor").select(F.col("query_id").alias("qid"))
    scores = R.ndcg(queries, gold.select("qid", "item"), ranks, 10, by=["system"])
    order = {name: i for i, name in enumerate(R.make_zoo(V.DIM))}
    ord_ = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("system")]
    return R.system_ranking(scores.withColumn("ord", ord_)).select("system", F.round("mean", 6).alias("mean_score"), "position")


def _arms(spark: SparkSession, folder: str) -> DataFrame:
    """Systems to rank: the models and prompts of the synthetic queries by their mean target cosine and their number."""
    rows = table(spark, folder, "synthetic_queries").select(F.concat_ws("/", "gen_meta.model", "gen_meta.prompt_version").alias("id"), "gen_meta.cos_to_target")
    means = rows.groupBy("id").agg(F.round(F.avg("cos_to_target"), 9).alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return means.filter("id <> '' AND x IS NOT NULL")


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    t = _arms(spark, folder)
    return t.select("id", F.row_number().over(Window.orderBy(F.desc("x"), "id")).alias("ref"), F.row_number().over(Window.orderBy(F.desc("y"), "id")).alias("cand"))


def op_r4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The models and prompts of the synthetic queries as systems, ranked by their mean target cosine."""
    rows = table(spark, folder, "synthetic_queries").filter("gen_meta.cos_to_target IS NOT NULL")
    id_ = F.concat_ws("/", "gen_meta.model", "gen_meta.prompt_version")
    scores = rows.select(id_.alias("system"), id_.alias("ord"), F.col("gen_meta.cos_to_target").alias("score")).filter("system <> ''")
    return R.system_ranking(scores).select(F.col("system").alias("id"), F.round("mean", 9).alias("mean_score"), "position")


def op_r5_kendall(spark: SparkSession, folder: str) -> DataFrame:
    return R.kendall_tau_b(_arms(spark, folder)).select(F.round("tau", 9).alias("tau"))


def op_r6_tau_ap(spark: SparkSession, folder: str) -> DataFrame:
    return R.tau_ap(_positions(spark, folder)).select(F.round("tau_ap", 9).alias("tau_ap"))


def op_r7_rbo(spark: SparkSession, folder: str) -> DataFrame:
    return R.rbo_ext(_positions(spark, folder)).select(F.round("rbo", 9).alias("rbo"))


def op_io7_max_grades(spark: SparkSession, folder: str) -> DataFrame:
    return max_grades(table(spark, folder, "qrels"), ["query_id", "chunk_id"])


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith(("op_", "flagship"))}

_ARMS = """arms AS (
    SELECT concat_ws('/', gen_meta.model, gen_meta.prompt_version) AS id, round(avg(gen_meta.cos_to_target), 9) AS x, count(*)::DOUBLE AS y
    FROM synthetic_queries GROUP BY 1 HAVING id <> '' AND x IS NOT NULL)"""
_PLACES = "places AS (SELECT id, row_number() OVER (ORDER BY x DESC, id) AS ref, row_number() OVER (ORDER BY y DESC, id) AS cand FROM arms)"

SQL = {
    "flagship_demand_weighted_ndcg": V.sql(
        "demand scored",
        """SELECT d.cluster, round(d.p_hat, 9) AS p_hat, count(s.score) AS n, round(avg(s.score), 6) AS mean_score
        FROM demand d LEFT JOIN scored s USING (cluster) GROUP BY d.cluster, d.p_hat""",
    ),
    "op_a9_worst_clusters": V.sql("scored", "SELECT cluster, row_number() OVER (ORDER BY avg(score), cluster) AS worst_rank FROM scored GROUP BY cluster ORDER BY 2 LIMIT 3"),
    "op_a1_proportions": V.sql("demand", "SELECT cluster, n, round(p_hat, 9) AS p_hat FROM demand"),
    "op_a2_decayed_demand": V.sql(
        "labels",
        """SELECT cluster AS component, round(sum(w) / sum(sum(w)) OVER (), 9) AS demand FROM (
        SELECT cluster, exp(-(max(epoch_us(received_at)) OVER () - epoch_us(received_at))::DOUBLE * ln(2) / (30 * 86400e6)) AS w FROM labels WHERE split = 'train') GROUP BY cluster""",
    ),
    "op_a3_tilt": V.sql("tilted", "SELECT cluster, round(tilted, 9) AS tilted FROM tilted"),
    "op_a4_importance": V.sql(
        "demand",
        """SELECT d.cluster, coalesce(k, 0) AS n,
            round(CASE WHEN k > 0 THEN p_hat / sum(p_hat) FILTER (k > 0) OVER () / (k / sum(k) OVER ()) END, 6) AS weight,
            round(coalesce(sum(p_hat) FILTER (k IS NULL) OVER (), 0), 9) AS gap
        FROM demand d LEFT JOIN (SELECT cluster, count(*) AS k FROM labels WHERE split = 'anchor' GROUP BY 1) l USING (cluster)""",
    ),
    "op_a5_effective_size": V.sql(
        "demand",
        """SELECT round(pow(sum(w * k), 2) / greatest(sum(w * w * k), 1e-12), 4) AS ess FROM (
        SELECT k, p_hat / sum(p_hat) OVER () / (k / sum(k) OVER ()) AS w
        FROM demand JOIN (SELECT cluster, count(*) AS k FROM labels WHERE split = 'anchor' GROUP BY 1) USING (cluster))""",
    ),
    "op_a6_post_stratified": V.sql("demand scored", "SELECT round(sum(p_hat * m) / sum(p_hat), 6) AS estimate FROM demand JOIN (SELECT cluster, avg(score) AS m FROM scored GROUP BY 1) USING (cluster)"),
    "op_a7_coverage": V.sql(
        "demand",
        """SELECT floor, round(coalesce(sum(p_hat) FILTER (coalesce(k, 0) >= floor), 0), 9) AS covered
        FROM (SELECT unnest([1, 5, 20, 50]) AS floor), demand LEFT JOIN (SELECT cluster, count(*) AS k FROM labels WHERE split = 'oracle' GROUP BY 1) USING (cluster) GROUP BY floor""",
    ),
    "op_a8_empty_clusters": V.sql("grid labels", "SELECT cluster FROM grid WHERE cluster NOT IN (SELECT cluster FROM labels WHERE split = 'oracle' GROUP BY 1 HAVING count(*) >= 20)"),
    "op_s2_quota": V.sql(
        "tilted",
        """SELECT cluster, (b + (row_number() OVER (ORDER BY round(s - b, 12) DESC, cluster) <= 500 - sum(b) OVER ())::INT)::BIGINT AS quota
        FROM (SELECT cluster, tilted * 500 AS s, floor(tilted * 500)::BIGINT AS b FROM tilted)""",
    ),
    "op_r1_ndcg": V.sql("ndcg", "SELECT query_id, round(score, 6) AS score FROM ndcg"),
    "op_r12_truncated_ndcg": V.sql("ndcg", "SELECT count(*) AS n, round(avg(score), 6) AS mean_score FROM ndcg").replace("least(r.r, 10)", "least(r.r, 3)").replace("rank <= 10", "rank <= 3"),
    "op_r9_bootstrap": V.sql(
        "ndcg",
        """, low AS (SELECT q.query_id, coalesce(d.dcg / list_sum(list_transform(range(1, least(r.r, 3) + 1), lambda i: 1 / log2(1 + i))), 0) AS low
            FROM (SELECT query_id FROM qv WHERE split = 'anchor') q
            LEFT JOIN (SELECT query_id, sum(1 / log2(1 + rank)) AS dcg FROM ranks WHERE rank <= 3 GROUP BY query_id) d USING (query_id)
            LEFT JOIN (SELECT query_id, count(*) AS r FROM golds GROUP BY query_id) r USING (query_id)),
        deltas AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS i, round(score, 9) - round(low, 9) AS delta FROM ndcg JOIN low USING (query_id)),
        size AS (SELECT count(*) AS n, avg(delta) AS mean FROM deltas),
        draws AS (SELECT b, floor(('0x' || substr(sha256('0|boot|' || b || '|' || j), 1, 13))::BIGINT / pow(16, 13) * n)::BIGINT AS i
            FROM size, (SELECT unnest(range(2000)) AS b), LATERAL (SELECT unnest(range(n)) AS j)),
        means AS (SELECT b, avg(delta) AS m FROM draws JOIN deltas USING (i) GROUP BY b)
        SELECT round((SELECT mean FROM size), 6) AS delta, count(*) FILTER (round(m, 12) <= 0) / count(*) AS p_value FROM means""",
    ),
    "op_r10_drop_mask": V.sql("passages", "SELECT chunk_id AS item, row_number() OVER (ORDER BY sha256('0|drop|' || chunk_id), chunk_id) <= floor(0.1 * count(*) OVER ()) AS dropped FROM passages"),
    "op_r4_ranking": """SELECT id, round(m, 9) AS mean_score, row_number() OVER (ORDER BY round(m, 12) DESC, id) AS position FROM (
        SELECT concat_ws('/', gen_meta.model, gen_meta.prompt_version) AS id, avg(gen_meta.cos_to_target) AS m FROM synthetic_queries WHERE gen_meta.cos_to_target IS NOT NULL GROUP BY 1) WHERE id <> ''""",
    "op_r5_kendall": f"""WITH {_ARMS} SELECT round(sum(sx * sy) / sqrt(nullif(sum(abs(sx)) * sum(abs(sy)), 0)), 9) AS tau
        FROM (SELECT sign(a.x - b.x)::DOUBLE AS sx, sign(a.y - b.y)::DOUBLE AS sy FROM arms a JOIN arms b ON a.id < b.id)""",
    "op_r6_tau_ap": f"""WITH {_ARMS}, {_PLACES} SELECT round(2 * sum(c) / ((SELECT count(*) FROM places) - 1) - 1, 9) AS tau_ap
        FROM (SELECT count(*) FILTER (b.ref < a.ref) / (a.cand - 1) AS c FROM places a JOIN places b ON b.cand < a.cand GROUP BY a.id, a.cand)""",
    "op_r7_rbo": f"""WITH {_ARMS}, {_PLACES}, grid AS (SELECT count(*) AS k, unnest(range(1, count(*) + 1)) AS d FROM places),
        x AS (SELECT k, d, count(p.id) AS x FROM grid LEFT JOIN places p ON greatest(p.ref, p.cand) <= d GROUP BY k, d)
        SELECT round(0.1 / 0.9 * sum(pow(0.9, d) * x / d) + max(CASE WHEN d = k THEN x / k * pow(0.9, k) END), 9) AS rbo FROM x""",
    "op_io7_max_grades": "SELECT query_id, chunk_id, max(grade) AS grade FROM qrels GROUP BY ALL",
}
SQL["op_r9_bootstrap"] = SQL["op_r9_bootstrap"].replace("\n, low AS", ", low AS")
