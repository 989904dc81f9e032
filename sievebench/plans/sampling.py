"""Queries on samplers, the gate, labels and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.functions.text import content_hash, record_id, stratum_key
from sievebench.operators import demand as D
from sievebench.operators import gate as G
from sievebench.operators import sampling as S
from sievebench.operators.dedup import dedup_rate, first_by, semantic_dedup
from sievebench.operators.ranking import hash_sample
from sievebench.operators.similarity import nearest_items
from sievebench.plans import views as V
from sievebench.plans.demand import _train_demand
from sievebench.session import materialise, table


def op_s1_uniform_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return S.uniform_seeds(V.passages(spark, folder), 500)


def _quota_seeds(spark: SparkSession, folder: str) -> DataFrame:
    quotas = D.largest_remainder(D.tilt(_train_demand(spark, folder), 0.7), 500)
    chunks = V.chunk_labels(spark, folder).withColumnRenamed("item", "chunk_id")
    return S.quota_seeds(materialise(chunks, "chunks"), materialise(quotas, "quotas"))


def op_s3_quota_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return _quota_seeds(spark, folder)


def op_s6_partners(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of one chunk, half of them with a partner of the same document."""
    seeds = table(spark, folder, "seeds").filter("z IS NULL").select("seed_id", F.col("chunk_ids")[0].alias("chunk_id"))
    return S.partners(seeds, V.passages(spark, folder), 0.5)


def op_s7_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.asked(spark, folder).select("query_id")
    return S.split_by_hash(rows, "query_id", {"train": 0.6, "anchor": 0.25, "oracle": 0.15})


def op_s8_stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "source")
    return S.split_by_hash(rows, "doc_id", {"train": 0.6, "anchor": 0.25, "oracle": 0.15}, by="source").select("doc_id", "source", "part")


def op_s9_cap(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of 300 synthetic queries, whose number is the feature."""
    return hash_sample(first_by(table(spark, folder, "synthetic_queries").select("query_id", "ord"), "query_id"), "query_id", 300, "cap")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "synthetic_queries").filter("text IS NOT NULL")
    strata = table(spark, folder, "seeds").select("seed_id", F.coalesce(stratum_key("stratum"), F.lit("")).alias("stratum_key"))
    joined = rows.join(strata, "seed_id").select("ord", "text", record_id("query_id", "text").alias("record_id"), "stratum_key")
    return first_by(joined, "record_id")


def op_s10_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = {"query_type=factoid": 0.5, "query_type=howto": 0.3, "query_type=keyword": 0.2}
    return S.apply_mix(_records(spark, folder), mix).select("record_id", "stratum_key")


def op_g11_curated(spark: SparkSession, folder: str) -> DataFrame:
    mix = {"query_type=factoid": 0.5, "query_type=howto": 0.3, "query_type=keyword": 0.2}
    return G.curate(_records(spark, folder), mix=mix, most=200).select("record_id", "stratum_key")


def op_d4_oracle_arm(spark: SparkSession, folder: str) -> DataFrame:
    """300 anchor queries that have gold, by hash, with their stratum or the default one."""
    rows = table(spark, folder, "production_queries").filter("split = 'anchor'")
    own = first_by(rows.select("query_id", "ord", stratum_key("stratum").alias("stratum_key")), "query_id")
    gold = table(spark, folder, "qrels").filter("grade > 0").select("query_id").distinct()
    kept = hash_sample(own.join(gold, "query_id", "left_semi"), "query_id", 300, "oracle")
    return kept.select("query_id", F.when(F.coalesce("stratum_key", F.lit("")) == "", F.lit("query_type=real")).otherwise(F.col("stratum_key")).alias("stratum_key"))


def op_d2_greedy_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a scan in order keeps each usable vector; acceptance depends on the earlier ones."""
    rows = V.stored(spark, folder).select(F.col("vec_id").alias("ord"), "vector")
    return semantic_dedup(rows, 0.95).select(F.col("ord").alias("vec_id"), "kept")


def op_a12_dedup_rate(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_rate(op_d2_greedy_dedup(spark, folder)).select(F.round("rate", 9).alias("rate"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """``qid, chunk_ids, vector``: seeds with a target stand in for generated queries, with their seed's chunks as gold."""
    from sievebench.functions.vectors import l2_normalize

    return table(spark, folder, "seeds").filter("z IS NOT NULL").select(F.col("seed_id").alias("qid"), "chunk_ids", l2_normalize("z").alias("vector"))


def _ranked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    held = materialise(_candidates(spark, folder), "candidates")
    golds = held.select("qid", F.explode(F.array_distinct("chunk_ids")).alias("item"))
    return held, golds, materialise(nearest_items(held.select("qid", "vector"), V.corpus(spark, folder), 10), "ranked")


def op_g4_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    held, golds, ranked = _ranked(spark, folder)
    return G.round_trip(ranked, golds, held).select(F.col("qid").alias("seed_id"), "passed", F.round("score", 9).alias("score"))


def op_g1_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Zero-context, answerability and round-trip checks in order, the first failure of each candidate."""
    held, golds, ranked = _ranked(spark, folder)
    trip = G.round_trip(ranked, golds, held)
    best = ranked.join(golds, ["qid", "item"], "left_semi").groupBy("qid").agg(F.max("score").alias("evidence"))
    rows = held.select("qid").join(trip, "qid").join(best, "qid", "left")
    checks = [("zero_context", ~G.hash_judge("qid", 0.1)), ("answerability", G.evidence_judge("evidence", 0.6)), ("round_trip", F.col("passed"))]
    return G.run_gate(rows, checks).select(F.col("qid").alias("seed_id"), F.coalesce("rejected_by", F.lit("accepted")).alias("outcome"))


def op_a10_tallies(spark: SparkSession, folder: str) -> DataFrame:
    gated = op_g1_gate(spark, folder).withColumnRenamed("outcome", "rejected_by")
    return G.tallies(gated).select(F.col("rejected_by").alias("outcome"), "n", F.round("share", 9).alias("share"))


def op_g5_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    """Promotions: of the five best chunks that aren't gold, those that a judge finds answering."""
    _, golds, ranked = _ranked(spark, folder)
    found = G.uniqueness(ranked, golds, G.evidence_judge("score", 0.7))
    return found.select(F.col("qid").alias("seed_id"), F.array_join("promoted", ",").alias("promoted"))


def op_g6_binary_qrels(spark: SparkSession, folder: str) -> DataFrame:
    held, golds, ranked = _ranked(spark, folder)
    promoted = G.uniqueness(ranked, golds, G.evidence_judge("score", 0.7))
    rows = held.join(promoted, "qid", "left").select(F.col("qid").alias("query_id"), "chunk_ids", "promoted")
    return G.binary_qrels(rows)


def op_g7_nearest_qrels(spark: SparkSession, folder: str) -> DataFrame:
    seeds = table(spark, folder, "seeds").select(F.col("seed_id").alias("query_id"), "chunk_ids")
    _, _, ranked = _ranked(spark, folder)
    return G.nearest_qrels(seeds, ranked.filter("rank = 1"))


def op_j7_hash_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The content hashes behind each relevant pair of the qrels, of the chunks that are known."""
    texts = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.min(F.struct("ord", "text")).alias("r")).select("chunk_id", content_hash("r.text").alias("content_hash"))
    pairs = table(spark, folder, "qrels").filter("grade > 0").select("query_id", "chunk_id").distinct()
    return pairs.join(texts, "chunk_id").select("query_id", "chunk_id", "content_hash")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("op_")}

_MIXED = """own AS (
    SELECT 'rec-' || substr(sha256(q.query_id || '|' || q.text), 1, 16) AS record_id, q.ord, q.text,
        coalesce(array_to_string(list_transform(list_sort(map_keys(stratum)), lambda k: k || '=' || coalesce(stratum[k], '')), '|'), '') AS stratum_key
    FROM synthetic_queries q JOIN seeds USING (seed_id) WHERE q.text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY q.ord) = 1)"""
_SHARES = "shares AS (SELECT * FROM (VALUES ('query_type=factoid', 0.5::DOUBLE), ('query_type=howto', 0.3::DOUBLE), ('query_type=keyword', 0.2::DOUBLE)) t(stratum_key, f))"
_TAKEN = """total AS (SELECT min(coalesce(n, 0) / f) AS t FROM shares LEFT JOIN (SELECT stratum_key, count(*) AS n FROM {0} GROUP BY 1) USING (stratum_key)),
    mixed AS (SELECT record_id, stratum_key, text, ord FROM {0} JOIN shares USING (stratum_key), total
        QUALIFY row_number() OVER (PARTITION BY stratum_key ORDER BY sha256('0|mix|' || record_id), record_id) <= round_even(t * f, 0))"""
_GREEDY = """, pairs AS (SELECT a.vec_id AS earlier, b.vec_id AS vec_id FROM store a JOIN store b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v), 12) >= 0.95),
    touched AS (SELECT vec_id FROM pairs UNION SELECT earlier FROM pairs),
    named AS (SELECT t.vec_id, row_number() OVER (ORDER BY t.vec_id) AS i, coalesce(e, []) AS earlier FROM touched t LEFT JOIN (SELECT vec_id, list(earlier) AS e FROM pairs GROUP BY 1) USING (vec_id)),
    scan AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
        SELECT n.i, CASE WHEN list_has_any(n.earlier, s.kept) THEN s.kept ELSE list_append(s.kept, n.vec_id) END FROM scan s JOIN (SELECT i, vec_id, earlier::BIGINT[] AS earlier FROM named) n ON n.i = s.i + 1),
    last AS (SELECT CASE WHEN i = 0 THEN NULL ELSE kept END AS kept FROM scan ORDER BY i DESC LIMIT 1)
"""
_CANDS = """cands AS (SELECT seed_id, chunk_ids, list_transform(z, lambda x: x / n) AS v
    FROM (SELECT seed_id, chunk_ids, z, sqrt(list_sum(list_transform(z, lambda x: x * x))) AS n FROM seeds WHERE z IS NOT NULL)),
    gold AS (SELECT DISTINCT seed_id, unnest(chunk_ids) AS item FROM cands),
    ranked AS (SELECT * FROM (SELECT seed_id, item, s, row_number() OVER (PARTITION BY seed_id ORDER BY s DESC, item) AS rank FROM (
        SELECT seed_id, item, round(list_dot_product(a.v, c.v), 12) AS s FROM cands a, corpus c)) WHERE rank <= 10),
    trip AS (SELECT seed_id, min(rank) AS r, max(s) AS best FROM ranked JOIN gold USING (seed_id, item) GROUP BY 1)"""
_GATED = _CANDS + """, gated AS (SELECT seed_id, CASE
        WHEN ('0x' || substr(sha256('0|judge|' || seed_id), 1, 13))::BIGINT / pow(16, 13) < 0.1 THEN 'zero_context'
        WHEN coalesce(best, -1) < 0.6 THEN 'answerability' WHEN r IS NULL THEN 'round_trip' ELSE 'accepted' END AS outcome
    FROM cands LEFT JOIN trip USING (seed_id))"""
_PROMOTED = _CANDS + """, promos AS (SELECT seed_id, item, rank FROM (
        SELECT seed_id, item, rank, s, row_number() OVER (PARTITION BY seed_id ORDER BY rank) AS place FROM ranked ANTI JOIN gold USING (seed_id, item)) WHERE place <= 5 AND s >= 0.7)"""


def _after(names: str, more: str, body: str) -> str:
    head = V.sql(names, "")
    return f"{head.rstrip()},\n{more}\n{body}" if head else f"WITH {more}\n{body}"


def _uniform(stream: str, *ids: str) -> str:
    return f"('0x' || substr(sha256('0|{stream}|' || {' || chr(124) || '.join(ids)}), 1, 13))::BIGINT / pow(16, 13)"


SQL = {
    "op_s1_uniform_seeds": _after(
        "passages",
        f"""numbered AS (SELECT chunk_id, row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () AS n FROM passages),
        draws AS (SELECT k AS seed_no, floor({_uniform('uniform', 'k::VARCHAR')} * (SELECT max(n) FROM numbered))::BIGINT AS i FROM (SELECT unnest(range(500)) AS k))""",
        "SELECT seed_no, printf('seed-uniform-%05d', seed_no) AS seed_id, chunk_id FROM draws JOIN numbered USING (i)",
    ),
    "op_s3_quota_seeds": _after(
        "tilted clabels",
        f"""quotas AS (SELECT cluster, (b + (row_number() OVER (ORDER BY round(s - b, 12) DESC, cluster) <= 500 - sum(b) OVER ())::INT)::BIGINT AS quota
            FROM (SELECT cluster, tilted * 500 AS s, floor(tilted * 500)::BIGINT AS b FROM tilted)),
        owned AS (SELECT cluster, item, row_number() OVER (PARTITION BY cluster ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS n FROM clabels),
        every AS (SELECT item, row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () AS n FROM clabels),
        plan AS (SELECT q.cluster, q.quota, sum(q.quota) OVER (ORDER BY q.cluster) - q.quota AS before, o.n AS own_n, (SELECT max(n) FROM every) AS all_n
            FROM quotas q LEFT JOIN (SELECT cluster, max(n) AS n FROM owned GROUP BY 1) o USING (cluster)),
        draws AS (SELECT cluster, k, (before + k)::BIGINT AS seed_no, own_n IS NULL AS empty, floor({_uniform('quota', 'cluster::VARCHAR', 'k::VARCHAR')} * coalesce(own_n, all_n))::BIGINT AS i
            FROM plan, LATERAL (SELECT unnest(range(quota)) AS k)),
        found AS (SELECT d.*, o.item AS chunk_id FROM draws d JOIN owned o ON o.cluster = d.cluster AND o.i = d.i WHERE NOT empty
            UNION ALL SELECT d.*, e.item FROM draws d JOIN every e ON e.i = d.i WHERE empty)""",
        "SELECT seed_no, printf('seed-quota-%05d', seed_no) AS seed_id, cluster, chunk_id, ['factoid', 'howto', 'keyword'][k % 3 + 1] AS query_type FROM found",
    ),
    "op_s6_partners": _after(
        "passages",
        f"""own AS (SELECT seed_id, chunk_ids[1] AS chunk_id FROM seeds WHERE z IS NULL),
        pairs AS (SELECT o.seed_id, arg_min(p.chunk_id, sha256('0|partner|' || o.seed_id || '|' || p.chunk_id)) AS partner
            FROM own o JOIN passages d USING (chunk_id) JOIN passages p ON p.doc_id = d.doc_id AND p.chunk_id <> o.chunk_id
            WHERE {_uniform('group', 'o.seed_id')} < 0.5 GROUP BY 1)""",
        "SELECT seed_id, chunk_id, partner FROM own LEFT JOIN pairs USING (seed_id)",
    ),
    "op_s7_split": V.sql(
        "asked",
        """SELECT query_id, CASE WHEN k <= floor(0.6::DOUBLE * n) THEN 'train' WHEN k <= floor(0.6::DOUBLE * n) + floor(0.25::DOUBLE * n) THEN 'anchor' ELSE 'oracle' END AS part
        FROM (SELECT query_id, row_number() OVER (ORDER BY sha256('0|split|' || query_id), query_id) AS k, count(*) OVER () AS n FROM asked)""",
    ),
    "op_s8_stratified_split": """SELECT doc_id, source, CASE WHEN k <= floor(0.6::DOUBLE * n) THEN 'train' WHEN k <= floor(0.6::DOUBLE * n) + floor(0.25::DOUBLE * n) THEN 'anchor' ELSE 'oracle' END AS part
        FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('0|split-' || source || '|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)""",
    "op_s9_cap": "SELECT query_id, min(ord) AS ord FROM synthetic_queries GROUP BY 1 ORDER BY sha256('0|cap|' || query_id) LIMIT 300",
    "op_s10_mix": f"WITH {_MIXED}, {_SHARES}, {_TAKEN.format('own')} SELECT record_id, stratum_key FROM mixed",
    "op_g11_curated": f"""WITH {_MIXED}, firsts AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY text ORDER BY ord) = 1), {_SHARES}, {_TAKEN.format('firsts')}
        SELECT record_id, stratum_key FROM mixed ORDER BY sha256('0|cap|' || record_id) LIMIT 200""",
    "op_d4_oracle_arm": """WITH own AS (SELECT query_id, arg_min({'s': array_to_string(list_transform(list_sort(map_keys(stratum)), lambda k: k || '=' || coalesce(stratum[k], '')), '|')}, ord).s AS s
            FROM production_queries WHERE split = 'anchor' GROUP BY 1)
        SELECT query_id, CASE WHEN coalesce(s, '') = '' THEN 'query_type=real' ELSE s END AS stratum_key FROM own
        WHERE query_id IN (SELECT query_id FROM qrels WHERE grade > 0) ORDER BY sha256('0|oracle|' || query_id) LIMIT 300""",
    "op_d2_greedy_dedup": V.sql("store", _GREEDY + "SELECT store.vec_id, (named.vec_id IS NULL OR list_contains(kept, store.vec_id)) AS kept FROM store LEFT JOIN named ON named.vec_id = store.vec_id, last").replace("\n, pairs", ", pairs").replace("WITH ", "WITH RECURSIVE ", 1),
    "op_a12_dedup_rate": V.sql("store", _GREEDY + "SELECT round(avg((named.vec_id IS NOT NULL AND NOT list_contains(kept, store.vec_id))::INT), 9) AS rate FROM store LEFT JOIN named ON named.vec_id = store.vec_id, last").replace("\n, pairs", ", pairs").replace("WITH ", "WITH RECURSIVE ", 1),
    "op_g4_round_trip": _after("corpus", _CANDS, "SELECT seed_id, r IS NOT NULL AS passed, round(coalesce(1 / r, 0), 9) AS score FROM cands LEFT JOIN trip USING (seed_id)"),
    "op_g1_gate": _after("corpus", _GATED, "SELECT seed_id, outcome FROM gated"),
    "op_a10_tallies": _after("corpus", _GATED, "SELECT outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM gated GROUP BY 1"),
    "op_g5_uniqueness": _after("corpus", _PROMOTED, "SELECT seed_id, string_agg(item, ',' ORDER BY rank) AS promoted FROM promos GROUP BY 1"),
    "op_g6_binary_qrels": _after("corpus", _PROMOTED, "SELECT seed_id AS query_id, item AS chunk_id, 1 AS grade FROM gold UNION SELECT seed_id, item, 1 FROM promos"),
    "op_g7_nearest_qrels": _after(
        "corpus",
        _CANDS,
        """SELECT seed_id AS query_id, item AS chunk_id, 1 AS grade FROM ranked WHERE rank = 1
        UNION ALL SELECT DISTINCT seed_id, unnest(chunk_ids), 1 FROM seeds WHERE seed_id NOT IN (SELECT seed_id FROM ranked)""",
    ),
    "op_j7_hash_snapshot": f"""SELECT DISTINCT query_id, chunk_id, substr(sha256({V.norm_sql('t')}), 1, 16) AS content_hash FROM qrels
        JOIN (SELECT chunk_id, (arg_min({{'t': text}}, ord)).t AS t FROM chunks GROUP BY 1) USING (chunk_id) WHERE grade > 0""",
}
