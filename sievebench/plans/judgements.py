"""Queries on graded judgements, pooled labels, soft demand, diversity, simulated models and exports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.functions import text as T
from sievebench.functions.text import content_hash, hash_hex, stratum_key
from sievebench.functions.vectors import l2_normalize
from sievebench.operators import demand as D
from sievebench.operators import diversity as V2
from sievebench.operators import fidelity as A
from sievebench.operators import generation as N
from sievebench.operators import judgements as J
from sievebench.operators import mixture as M
from sievebench.operators.dedup import first_by
from sievebench.operators.ranking import hash_sample
from sievebench.operators.sampling import stratified_sample
from sievebench.operators.similarity import gold_ranks, nearest_items
from sievebench.plans import views as V
from sievebench.session import materialise, table
from sievebench.sources.benchmarks import max_grades
from sievebench.sources.stores import fetch_vectors


def _two_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs judged more than once: the least grade as one judge's, the greatest as the other's."""
    rows = table(spark, folder, "qrels").groupBy("query_id", "chunk_id").agg(F.min("grade").alias("a"), F.max("grade").alias("b"), F.count(F.lit(1)).alias("n"))
    return rows.filter("n > 1").select("a", "b")


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(J.confusion(_two_grades(spark, folder)), "confusion")


def op_x_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return J.confusion(_two_grades(spark, folder))


def op_x_kappa(spark: SparkSession, folder: str) -> DataFrame:
    return J.weighted_kappa(_matrix(spark, folder)).select(F.round("kappa", 9).alias("kappa"))


def op_x_alpha(spark: SparkSession, folder: str) -> DataFrame:
    return J.ordinal_alpha(_matrix(spark, folder)).select(F.round("alpha", 9).alias("alpha"))


def op_x_judge_bias(spark: SparkSession, folder: str) -> DataFrame:
    report = J.bias_report(_matrix(spark, folder))
    return report.select(*[F.round(c, 9).alias(c) for c in report.columns])


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """``system, qid, item, rank, score``: the ten best of each anchor query by all numbers and by the first 32."""
    queries = materialise(V.query_vectors(spark, folder, "anchor").select(F.col("query_id").alias("qid"), "vector"), "queries")
    corpus = materialise(V.corpus(spark, folder).select("item", "vector"), "corpus")
    half = [df.withColumn("vector", l2_normalize(F.slice("vector", 1, 32))) for df in (queries, corpus)]
    exact = nearest_items(queries, corpus, 10).withColumn("system", F.lit("exact"))
    return materialise(exact.unionByName(nearest_items(*half, 10, dim=32).withColumn("system", F.lit("half"))), "runs")


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    return max_grades(table(spark, folder, "qrels"), ["query_id", "chunk_id"]).select(F.col("query_id").alias("qid"), F.col("chunk_id").alias("item"), "grade")


def op_x_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Pools of two systems and the golds, at most 15 items of a query."""
    runs, golds = _runs(spark, folder), V.golds(spark, folder).select("qid", "item")
    pairs = runs.select("qid", "item").unionByName(golds).distinct()
    q = V.query_vectors(spark, folder, "anchor").select(F.col("query_id").alias("qid"), F.col("vector").alias("q"))
    c = V.corpus(spark, folder).select("item", F.col("vector").alias("c"))
    score = F.round(F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 10)
    exact = pairs.join(q, "qid").join(c, "item").select("qid", "item", score.alias("score"))
    return J.pooled(runs, golds, exact, most=15).select(F.col("qid").alias("query_id"), "item", "capped")


def op_x_graded_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    """nDCG@10 with exponential gains of the exact system on anchor queries, by the known chunks' grades."""
    golds = materialise(V.golds(spark, folder), "golds")
    grades = _graded(spark, folder).join(golds.select("qid", "item"), ["qid", "item"], "left_semi")
    ranks = gold_ranks(golds, V.corpus(spark, folder), {"exact": np.eye(V.DIM)})
    queries = V.query_vectors(spark, folder, "anchor").select(F.col("query_id").alias("qid"))
    return J.graded_ndcg(queries, grades, ranks).select(F.col("qid").alias("query_id"), F.round("score", 6).alias("score"))


def op_x_hole_rate(spark: SparkSession, folder: str) -> DataFrame:
    return J.hole_rate(_runs(spark, folder), _graded(spark, folder)).select("system", F.round("hole_rate", 9).alias("hole_rate"))


def op_x_condensed(spark: SparkSession, folder: str) -> DataFrame:
    return J.condensed(_runs(spark, folder), _graded(spark, folder)).select("system", F.col("qid").alias("query_id"), "item", "rank")


def op_x_transport(spark: SparkSession, folder: str) -> DataFrame:
    """Where the mass of mixture components with given means falls, among the clusters of the frozen partition."""
    centres = V.centres(spark, folder)
    mean = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    model = M.Mixture(np.full(len(mean), 1 / len(mean)), mean, np.full(len(mean), 40.0))
    rows = M.assign(V.query_vectors(spark, folder, "train"), centres, ["query_id", "vector"])
    shares = D.transport(M.responsibilities(rows, model, ["query_id", "cluster"]))
    return shares.select("component", "cluster", F.round("share", 6).alias("share"))


def op_x_soft_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Demand by component carried to clusters; without decay it is the histogram of hard labels."""
    centres = V.centres(spark, folder)
    mean = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    model = M.Mixture(np.full(len(mean), 1 / len(mean)), mean, np.full(len(mean), 40.0))
    rows = M.assign(V.query_vectors(spark, folder, "train"), centres, ["query_id", "vector"])
    found = materialise(M.responsibilities(rows, model, ["query_id", "cluster"]), "responsibilities")
    soft = D.projected_demand(D.transport(found), D.responsibility_demand(found), len(centres))
    return soft.select("cluster", F.round("p_hat", 8).alias("p_hat"))


def _side(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return V.query_vectors(spark, folder, split).select(F.col("query_id").alias("id"), "vector")


def op_x_vendi(spark: SparkSession, folder: str) -> DataFrame:
    """Effective number of different anchor queries (eigenvalues have no SQL)."""
    return V2.vendi(_side(spark, folder, "anchor"))


def op_x_mauve(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the divergence frontier of anchor and oracle queries (the partition's start is random, so no SQL)."""
    return V2.mauve(_side(spark, folder, "anchor"), _side(spark, folder, "oracle"))


def op_a15_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    return A.c2st_coefficients(_side(spark, folder, "anchor"), _side(spark, folder, "oracle"))


def op_a17_median_mmd(spark: SparkSession, folder: str) -> DataFrame:
    """Kernel distance of anchor and oracle queries at the median distance of 500 of them."""
    return A.mmd_rbf(_side(spark, folder, "anchor"), _side(spark, folder, "oracle")).select(F.round("mmd", 8).alias("mmd"))


def op_s11_reference(spark: SparkSession, folder: str) -> DataFrame:
    """The shared anchor subsample of 500 in hash order, whose prefix each arm compares with."""
    rows = V.query_vectors(spark, folder, "anchor").select("query_id")
    from sievebench.operators.sampling import nested_reference

    return nested_reference(rows, "query_id", 500)


def op_s2_floored_quota(spark: SparkSession, folder: str) -> DataFrame:
    """500 seeds with at least 15 for each cluster, the excess taken one by one from the largest."""
    from sievebench.plans.demand import _train_demand

    return D.quotas(spark, D.tilt(_train_demand(spark, folder), 0.7), 500, 15)


def op_g5_reject(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates that a chunk which isn't gold answers too are rejected."""
    from sievebench.operators import gate as G
    from sievebench.plans.sampling import _ranked

    held, golds, ranked = _ranked(spark, folder)
    found = G.uniqueness(ranked, golds, G.evidence_judge("score", 0.7))
    return G.unique_check(held, found, "reject").select(F.col("qid").alias("seed_id"), "passed", "score")


def op_t4_mock_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Random unit vectors that depend on the text alone (the generator has no SQL)."""
    rows = table(spark, folder, "synthetic_queries").filter("text IS NOT NULL").select("text").distinct()
    return N.mock_vectors(rows).select(F.posexplode("vector").alias("pos", "x"), content_hash("text").alias("hash")).groupBy("hash").agg(F.round(F.sum(F.col("x") * F.col("x")), 9).alias("length"))


def op_t13_capitalised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("title IS NOT NULL").select("doc_id", T.capitalise("title").alias("title"))


def op_io18_banked(spark: SparkSession, folder: str) -> DataFrame:
    """The reference of the vector banked for each synthetic text that a production query has too."""
    rows = V.asked(spark, folder).filter("text IS NOT NULL AND embedding_ref IS NOT NULL").select("text", "ord", "embedding_ref")
    bank = N.Bank(first_by(rows, "text").select("text", F.col("embedding_ref").alias("vector")))
    return bank.held(table(spark, folder, "synthetic_queries").select("ord", "text")).select("ord", F.col("vector").alias("embedding_ref"))


def op_io23_fetched(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors that the store holds of all references of chunks, each once."""
    wanted = table(spark, folder, "chunks").select(F.col("embedding_ref").alias("id"))
    store = table(spark, folder, "vector_store").select(F.col("embedding_ref").alias("id"), "embedding")
    return fetch_vectors(wanted, store).select("id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("numbers"))


def op_io4_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata of each query, an empty map where there is none."""
    from sievebench.sources.jsonl import with_metadata

    return with_metadata(table(spark, folder, "production_queries").select("ord", F.col("stratum").alias("metadata"))).select("ord", F.size("metadata").alias("entries"), F.coalesce(stratum_key("metadata"), F.lit("")).alias("metadata"))


def op_x_audit_sample(spark: SparkSession, folder: str) -> DataFrame:
    """160 synthetic queries to audit, their number being the feature, dealt to strata in proportion, in hash order."""
    rows = first_by(table(spark, folder, "synthetic_queries").filter("text IS NOT NULL").select("query_id", "ord", "seed_id", "text"), "query_id")
    strata = table(spark, folder, "seeds").select("seed_id", F.coalesce(stratum_key("stratum"), F.lit("")).alias("stratum"))
    return stratified_sample(rows.join(strata, "seed_id"), "query_id", "stratum", 160, "audit").select("query_id", "stratum")


def op_s9_reference_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every anchor query with its hash, the order that samples and prefixes follow."""
    return V.asked(spark, folder).filter("split = 'anchor'").select("query_id", F.substring(hash_hex(0, "order", "query_id"), 1, 12).alias("h"))


def op_d4_oracle_sample(spark: SparkSession, folder: str) -> DataFrame:
    """At most 300 oracle queries with a usable vector, by hash; those without gold are left out, so gold is the nearest chunk's."""
    rows = V.query_vectors(spark, folder, "oracle").select("query_id")
    return hash_sample(rows, "query_id", 300, "oracle")


def op_v4_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The unit vector that stands for each seed: its target, or else the mean of its chunks."""
    found = N.anchors(table(spark, folder, "seeds"), V.corpus(spark, folder))
    return found.select("seed_id", F.posexplode("vector").alias("pos", "x")).select("seed_id", "pos", F.round("x", 6).alias("x"))


def op_g8_records(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation records of the synthetic queries, with their seeds' known chunks as gold."""
    from sievebench.operators import gate as G

    queries = first_by(table(spark, folder, "synthetic_queries").filter("text IS NOT NULL").select("query_id", "ord", "text", "seed_id"), "query_id")
    texts = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.min(F.struct("ord", "text")).alias("r")).select("chunk_id", content_hash("r.text").alias("content_hash"))
    rows = queries.join(table(spark, folder, "seeds").select("seed_id", "chunk_ids", F.lit(None).cast("array<string>").alias("promoted")), "seed_id")
    qrels = G.binary_qrels(rows).join(texts.select("chunk_id"), "chunk_id", "left_semi")
    made = G.annotation_records(queries.select("query_id", "text"), qrels, texts, "v1")
    hashes = F.array_join(F.transform(F.array_sort(F.map_entries("content_hashes")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return made.select("record_id", "query_id", F.array_join("crucial", ",").alias("crucial"), hashes.alias("content_hashes"), F.size("qrels").alias("golds"), "benchmark_version")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("op_")}

_GRADES = """m AS (SELECT a, b, count(*) AS n FROM (SELECT min(grade) AS a, max(grade) AS b, count(*) AS k FROM qrels GROUP BY query_id, chunk_id) WHERE k > 1 GROUP BY ALL)"""
_RUNS = """halved AS (SELECT item, list_transform(h, lambda x: x / greatest(sqrt(list_dot_product(h, h)), 1e-12)) AS v FROM (SELECT item, v[1:32] AS h FROM corpus)),
    halfq AS (SELECT query_id, list_transform(h, lambda x: x / greatest(sqrt(list_dot_product(h, h)), 1e-12)) AS v FROM (SELECT query_id, v[1:32] AS h FROM qv WHERE split = 'anchor')),
    runs AS (SELECT * FROM (SELECT system, query_id, item, s, row_number() OVER (PARTITION BY system, query_id ORDER BY s DESC, item) AS rank FROM (
        SELECT 'exact' AS system, q.query_id, c.item, round(list_dot_product(q.v, c.v), 12) AS s FROM qv q, corpus c WHERE q.split = 'anchor'
        UNION ALL SELECT 'half', q.query_id, c.item, round(list_dot_product(q.v, c.v), 12) FROM halfq q, halved c)) WHERE rank <= 10)"""
_SOFT = """joint AS (SELECT query_id, cluster AS component, 40 * list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS j FROM qv, centres WHERE split = 'train'),
    g AS (SELECT query_id, component, exp(j - max(j) OVER (PARTITION BY query_id)) AS e FROM joint),
    r AS (SELECT query_id, component, e / sum(e) OVER (PARTITION BY query_id) AS gamma FROM g),
    shares AS (SELECT component, cluster, sum(gamma) / sum(sum(gamma)) OVER (PARTITION BY component) AS share FROM r JOIN labels USING (query_id) GROUP BY component, cluster)"""


def _with(names: str, ctes: str, body: str) -> str:
    return V.sql(names, f", {ctes}\n{body}").replace("\n, ", ",\n", 1)


SQL = {
    "op_x_confusion": f"""WITH {_GRADES} SELECT a, b, coalesce(n, 0) AS n
        FROM (SELECT x.a, y.b FROM (SELECT unnest(range(4))::INT AS a) x, (SELECT unnest(range(4))::INT AS b) y) LEFT JOIN m USING (a, b)""",
    "op_x_kappa": f"""WITH {_GRADES}, t AS (SELECT *, sum(n) OVER () AS total FROM m),
        ra AS (SELECT a, sum(n) AS na FROM m GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM m GROUP BY b)
        SELECT round((1 - (SELECT sum(n * pow((a - b) / 3, 2)) FROM m) / (SELECT sum(na * nb * pow((a - b) / 3, 2) / (SELECT max(total) FROM t)) FROM ra, rb))::DOUBLE, 9) AS kappa""",
    "op_x_alpha": f"""WITH {_GRADES}, o AS (SELECT a, b, sum(n) AS o FROM (SELECT a, b, n FROM m UNION ALL SELECT b, a, n FROM m) GROUP BY ALL),
        held AS (SELECT a AS g, sum(o) AS n FROM o GROUP BY a),
        d AS (SELECT x.g AS a, y.g AS b, x.n AS nx, y.n AS ny,
            pow((SELECT sum(z.n) FROM held z WHERE z.g BETWEEN least(x.g, y.g) AND greatest(x.g, y.g)) - (x.n + y.n) / 2, 2) AS d2 FROM held x, held y WHERE x.g <> y.g)
        SELECT round((1 - ((SELECT sum(n) FROM held) - 1) * (SELECT sum(o * d2) FROM o JOIN d USING (a, b)) / (SELECT sum(nx * ny * d2) FROM d))::DOUBLE, 9) AS alpha""",
    "op_x_judge_bias": f"""WITH {_GRADES} SELECT round(sum((b - a) * n) / sum(n), 9) AS mean_delta, round(coalesce(sum(n) FILTER (b > a), 0) / sum(n), 9) AS over,
        round(coalesce(sum(n) FILTER (b < a), 0) / sum(n), 9) AS under, round(coalesce(sum(n) FILTER ((a >= 2) = (b >= 2)), 0) / sum(n), 9) AS accuracy,
        round(coalesce(sum(n) FILTER (a >= 2 AND b >= 2), 0) / sum(n) FILTER (b >= 2), 9) AS precision,
        round(coalesce(sum(n) FILTER (a >= 2 AND b >= 2), 0) / sum(n) FILTER (a >= 2), 9) AS recall FROM m""",
    "op_x_pool": _with(
        "qv corpus golds",
        f"""{_RUNS}, gold AS (SELECT DISTINCT query_id, chunk_id AS item FROM golds),
        every AS (SELECT query_id, item, max(g) AS g FROM (SELECT query_id, item, true AS g FROM gold UNION ALL SELECT query_id, item, false FROM runs) GROUP BY ALL),
        placed AS (SELECT e.query_id, e.item, g, row_number() OVER (PARTITION BY e.query_id ORDER BY g DESC, round(list_dot_product(q.v, c.v), 10) DESC, e.item) AS place
            FROM every e JOIN qv q USING (query_id) JOIN corpus c ON c.item = e.item)""",
        "SELECT query_id, item, max(place) OVER (PARTITION BY query_id) > 15 AS capped FROM placed QUALIFY place <= 15 OR g",
    ),
    "op_x_graded_ndcg": _with(
        "qv corpus golds ranks graded",
        """held AS (SELECT r.query_id, r.rank, g.grade, row_number() OVER (PARTITION BY r.query_id ORDER BY g.grade DESC, r.chunk_id) AS place FROM ranks r JOIN graded g USING (query_id, chunk_id)),
        s AS (SELECT query_id, coalesce(sum((pow(2, grade) - 1) / log2(1 + rank)) FILTER (rank <= 10), 0) / sum((pow(2, grade) - 1) / log2(1 + place)) FILTER (place <= 10) AS score FROM held GROUP BY 1)""",
        "SELECT q.query_id, round(coalesce(score, 0), 6) AS score FROM qv q LEFT JOIN s USING (query_id) WHERE split = 'anchor'",
    ),
    "op_x_hole_rate": _with("qv corpus graded", _RUNS, "SELECT system, round(avg((g.grade IS NULL)::INT), 9) AS hole_rate FROM runs r LEFT JOIN graded g ON g.query_id = r.query_id AND g.chunk_id = r.item GROUP BY 1"),
    "op_x_condensed": _with("qv corpus graded", _RUNS, "SELECT system, r.query_id, item, row_number() OVER (PARTITION BY system, r.query_id ORDER BY rank) AS rank FROM runs r JOIN graded g ON g.query_id = r.query_id AND g.chunk_id = r.item"),
    "op_x_transport": _with("qv centres labels", _SOFT, "SELECT component, cluster, round(share, 6) AS share FROM shares"),
    "op_x_soft_demand": V.sql("demand", "SELECT cluster, round(p_hat, 8) AS p_hat FROM demand"),
    "op_a17_median_mmd": _with(
        "qv",
        """pool AS (SELECT v FROM (SELECT v, CASE split WHEN 'anchor' THEN '0|' ELSE '1|' END || query_id AS id FROM qv WHERE split IN ('anchor', 'oracle')) ORDER BY sha256('0|median|' || id), id LIMIT 500),
        few AS (SELECT v, row_number() OVER () AS i FROM pool),
        d AS (SELECT list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v) AS d2 FROM few a JOIN few b ON a.i < b.i),
        gamma AS (SELECT 1 / median(d2) AS gamma FROM d WHERE d2 > 1e-12),
        k AS (SELECT a.split AS x, b.split AS y, sum(exp(-gamma * greatest(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 0))) AS t
            FROM qv a, qv b, gamma WHERE a.split IN ('anchor', 'oracle') AND b.split IN ('anchor', 'oracle') GROUP BY ALL),
        n AS (SELECT count(*) FILTER (split = 'anchor') AS n, count(*) FILTER (split = 'oracle') AS m FROM qv)""",
        """SELECT round(greatest(((SELECT t FROM k WHERE x = 'anchor' AND y = 'anchor') - n) / (n * (n - 1)) + ((SELECT t FROM k WHERE x = 'oracle' AND y = 'oracle') - m) / (m * (m - 1))
            - 2 * (SELECT t FROM k WHERE x = 'anchor' AND y = 'oracle') / (n * m), 0), 8) AS mmd FROM n""",
    ),
    "op_v4_anchors": V.sql(
        "corpus",
        """, given AS (SELECT seed_id, z AS m FROM seeds WHERE z IS NOT NULL),
        parts AS (SELECT seed_id, p, avg(v[p]) AS x FROM (SELECT DISTINCT seed_id, unnest(chunk_ids) AS item FROM seeds WHERE z IS NULL) JOIN corpus USING (item), (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL),
        every AS (SELECT * FROM given UNION ALL SELECT seed_id, list(x ORDER BY p) AS m FROM parts GROUP BY 1)
        SELECT seed_id, (p - 1)::INT AS pos, round(m[p] / greatest(sqrt(list_sum(list_transform(m, lambda a: a * a))), 1e-12), 6) AS x FROM every, (SELECT unnest(range(1, 65)) AS p)""",
    ).replace("\n, given", ", given"),
    "op_g8_records": f"""WITH firsts AS (SELECT query_id, arg_min({{'text': text, 'seed_id': seed_id}}, ord) AS r FROM synthetic_queries WHERE text IS NOT NULL GROUP BY 1),
        texts AS (SELECT chunk_id, arg_min({{'t': text}}, ord).t AS text FROM chunks GROUP BY 1),
        hashed AS (SELECT chunk_id, substr(sha256({V.norm_sql('text')}), 1, 16) AS h FROM texts),
        gold AS (SELECT DISTINCT query_id, unnest(chunk_ids) AS chunk_id FROM firsts JOIN seeds ON seeds.seed_id = r.seed_id)
        SELECT 'rec-' || substr(sha256(query_id || '|' || any_value(r.text)), 1, 16) AS record_id, query_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS crucial,
            coalesce(string_agg(chunk_id || ':' || h, ',' ORDER BY chunk_id), '') AS content_hashes, count(*)::INT AS golds, 'v1' AS benchmark_version
        FROM gold JOIN hashed USING (chunk_id) JOIN firsts USING (query_id) GROUP BY query_id""",
    "op_s11_reference": V.sql("qv", "SELECT query_id, place FROM (SELECT query_id, row_number() OVER (ORDER BY sha256('0|reference|' || query_id), query_id) AS place FROM qv WHERE split = 'anchor') WHERE place <= 500"),
    "op_s2_floored_quota": V.sql(
        "tilted",
        """, base AS (SELECT cluster, (b + (row_number() OVER (ORDER BY round(s - b, 12) DESC, cluster) <= 500 - sum(b) OVER ())::INT)::BIGINT AS quota
            FROM (SELECT cluster, tilted * 500 AS s, floor(tilted * 500)::BIGINT AS b FROM tilted)),
        start AS (SELECT list(greatest(quota, 15) ORDER BY cluster) AS q, sum(greatest(15 - quota, 0))::BIGINT AS need FROM base),
        fill AS (SELECT q, need FROM start UNION ALL
            SELECT list_transform(q, lambda x, i: x - (i = list_position(q, list_max(q)))::BIGINT), need - 1 FROM fill WHERE need > 0),
        last AS (SELECT q FROM fill WHERE need = 0)
        SELECT c.cluster, q[c.i] AS quota FROM (SELECT cluster, row_number() OVER (ORDER BY cluster) AS i FROM base) c, last""",
    )
    .replace("\n, base", ", base")
    .replace("WITH ", "WITH RECURSIVE ", 1),
    "op_t13_capitalised": "SELECT doc_id, upper(title[1:1]) || title[2:] AS title FROM documents WHERE title IS NOT NULL",
    "op_io18_banked": V.sql(
        "asked",
        """, bank AS (SELECT text, arg_min(embedding_ref, ord) AS embedding_ref FROM asked WHERE text IS NOT NULL AND embedding_ref IS NOT NULL GROUP BY text)
        SELECT s.ord, b.embedding_ref FROM synthetic_queries s JOIN bank b USING (text)""",
    ).replace("\n, bank", ", bank"),
    "op_io23_fetched": """SELECT v.embedding_ref AS id, coalesce(len(embedding), -1)::INT AS numbers FROM vector_store v
        WHERE v.embedding_ref IN (SELECT embedding_ref FROM chunks WHERE embedding_ref IS NOT NULL)""",
    "op_io4_metadata": """SELECT ord, coalesce(len(map_keys(stratum)), 0)::INT AS entries,
        coalesce(array_to_string(list_transform(list_sort(map_keys(stratum)), lambda k: k || '=' || coalesce(stratum[k], '')), '|'), '') AS metadata FROM production_queries""",
    "op_x_audit_sample": """WITH firsts AS (SELECT query_id, arg_min(seed_id, ord) AS seed_id FROM synthetic_queries WHERE text IS NOT NULL GROUP BY 1),
        own AS (SELECT query_id, coalesce(array_to_string(list_transform(list_sort(map_keys(stratum)), lambda k: k || '=' || coalesce(stratum[k], '')), '|'), '') AS stratum FROM firsts JOIN seeds USING (seed_id)),
        sizes AS (SELECT stratum, count(*) AS n, least(160, sum(count(*)) OVER ()) * count(*) / sum(count(*)) OVER () AS share FROM own GROUP BY 1),
        quota AS (SELECT stratum, floor(share)::BIGINT + (row_number() OVER (ORDER BY round(share - floor(share), 12) DESC, stratum) <= (SELECT least(160, count(*)) FROM own) - sum(floor(share)) OVER ())::INT AS k FROM sizes)
        SELECT query_id, stratum FROM own JOIN quota USING (stratum) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('0|audit|' || query_id), query_id) <= k""",
    "op_s9_reference_order": V.sql("asked", "SELECT query_id, substr(sha256('0|order|' || query_id), 1, 12) AS h FROM asked WHERE split = 'anchor'"),
    "op_d4_oracle_sample": V.sql("qv", "SELECT query_id FROM qv WHERE split = 'oracle' ORDER BY sha256('0|oracle|' || query_id), query_id LIMIT 300"),
}


def _unique_reject() -> str:
    from sievebench.plans.sampling import SQL as OTHER

    promos = OTHER["op_g5_uniqueness"].rsplit("SELECT seed_id, string_agg", 1)[0]
    return promos + "SELECT seed_id, count(p.item) = 0 AS passed, count(p.item)::DOUBLE AS score FROM cands LEFT JOIN promos p USING (seed_id) GROUP BY 1"


SQL["op_g5_reject"] = _unique_reject()
