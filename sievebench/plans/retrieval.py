"""Queries on similarity, span and lexical joins, and on stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.functions.vectors import l2_normalize, length
from sievebench.operators import lexical
from sievebench.operators.mixture import assign
from sievebench.operators.ranking import exact_percentile
from sievebench.operators.similarity import nearest_items
from sievebench.operators.spans import gold_chunks
from sievebench.plans import views as V
from sievebench.session import materialise, table
from sievebench.sources.benchmarks import binarize, max_grades
from sievebench.sources.stores import missing_ids


def _asking(spark: SparkSession, folder: str, split: str | None) -> DataFrame:
    return V.query_vectors(spark, folder, split).select(F.col("query_id").alias("qid"), "vector")


def op_j1_top_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest_items(_asking(spark, folder, None), V.corpus(spark, folder), 10)
    return found.select(F.col("qid").alias("query_id"), "item", "rank", F.round("score", 6).alias("score"))


def op_j2_nearest_chunk(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest_items(_asking(spark, folder, None), V.corpus(spark, folder), 1)
    return found.select(F.col("qid").alias("query_id"), "item", F.round("score", 6).alias("score"))


def op_j3_assign(spark: SparkSession, folder: str) -> DataFrame:
    return V.labels(spark, folder).select("query_id", "cluster")


def op_j4_radius(spark: SparkSession, folder: str) -> DataFrame:
    """The tenth percentile of each train query's cosine to its nearest other one."""
    q = materialise(_asking(spark, folder, "train"), "train")
    near = materialise(nearest_items(q, q.withColumnRenamed("qid", "item"), 1, apart=True), "near")
    radius = exact_percentile(near, "score", 0.1)
    return spark.createDataFrame([(radius,)], "radius double").select(F.round("radius", 6).alias("radius"))


def op_j5_span_gold(spark: SparkSession, folder: str) -> DataFrame:
    """The second quarter of each document as a span, against windows of 1,000 characters that overlap by 200."""
    docs = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.length("text").alias("n")).filter("n > 0")
    spans = docs.select(F.col("doc_id").alias("query_id"), "doc_id", F.floor(F.col("n") / 4).alias("start"), F.floor(F.col("n") / 2).alias("end"))
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 800)))
    chunks = docs.select("doc_id", "n", starts.alias("w")).select("doc_id", F.concat_ws(":", "doc_id", "w").alias("chunk_id"), (F.col("w") * 800).alias("start"), F.least(F.col("w") * 800 + 1000, "n").alias("end"))
    return gold_chunks(spans, chunks)


def op_j6_qrels_known(spark: SparkSession, folder: str) -> DataFrame:
    """Judged pairs by split of the query and whether the chunk exists."""
    graded = max_grades(table(spark, folder, "qrels"), ["query_id", "chunk_id"])
    splits = V.asked(spark, folder).select("query_id", "split")
    known = V.passages(spark, folder).select("chunk_id", F.lit(True).alias("known"))
    joined = graded.join(splits, "query_id", "left").join(known, "chunk_id", "left")
    return joined.groupBy(F.coalesce("split", F.lit("none")).alias("split"), F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("pairs"))


def op_j8_anchor_qrels(spark: SparkSession, folder: str) -> DataFrame:
    graded = max_grades(table(spark, folder, "qrels"), ["query_id", "chunk_id"])
    anchor = V.asked(spark, folder).filter("split = 'anchor'")
    return graded.join(anchor, "query_id", "left_semi")


def op_io9_binary_qrels(spark: SparkSession, folder: str) -> DataFrame:
    graded = max_grades(table(spark, folder, "qrels"), ["query_id", "chunk_id"]).withColumnRenamed("chunk_id", "upstream_id")
    chunks = V.passages(spark, folder).select(F.col("chunk_id").alias("upstream_id"), "chunk_id")
    return binarize(graded, chunks, 1)


def op_j9_without_vector(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.asked(spark, folder)
    held = V.stored(spark, folder).select("embedding_ref")
    return rows.join(held, "embedding_ref", "left_anti").select("query_id")


def op_j10_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct references of queries and chunks that the store doesn't hold."""
    wanted = table(spark, folder, "production_queries").select("embedding_ref").union(table(spark, folder, "chunks").select("embedding_ref"))
    return missing_ids(wanted.filter("embedding_ref IS NOT NULL").distinct(), table(spark, folder, "vector_store"), "embedding_ref")


def op_j12_exemplars(spark: SparkSession, folder: str) -> DataFrame:
    """Three style examples for each seed with a target: train queries of its cluster first, then the nearest others.

    One blocked join: a cluster's axis added to both sides puts those of the same cluster above all others.
    """
    centres = V.centres(spark, folder)
    axes = F.array(*[F.lit(i) for i in range(len(centres))])
    seeds = table(spark, folder, "seeds").filter("z IS NOT NULL").select(F.col("seed_id").alias("qid"), l2_normalize("z").alias("vector"))
    mark = F.transform(axes, lambda i: F.when(i == F.col("cluster"), F.lit(2.0)).otherwise(F.lit(0.0)))
    q = assign(seeds, centres, ["qid", "vector"]).select("qid", F.concat("vector", mark).alias("vector"))
    train = assign(V.query_vectors(spark, folder, "train"), centres, ["query_id", "vector"])
    items = train.select(F.col("query_id").alias("item"), F.concat("vector", mark).alias("vector"))
    found = nearest_items(q, items, 3, dim=V.DIM + len(centres))
    return found.select(F.col("qid").alias("seed_id"), F.col("item").alias("query_id"), "rank")


def op_j13_memorized(spark: SparkSession, folder: str) -> DataFrame:
    """Synthetic queries by whether a production query is within 0.9 of their hashed n-gram vector; flagged, not dropped."""
    ours = table(spark, folder, "synthetic_queries").filter("text IS NOT NULL").select("text").distinct()
    theirs = table(spark, folder, "production_queries").filter("text IS NOT NULL").select("text").distinct()
    q = materialise(lexical.hashed_embeddings(ours.select(F.col("text").alias("qid"), "text"), keep=["qid"]), "ours")
    items = materialise(lexical.hashed_embeddings(theirs.select(F.col("text").alias("item"), "text"), keep=["item"]), "theirs")
    near = nearest_items(q, items, 1, dim=256).select(F.col("qid").alias("text"), (F.col("score") >= 0.9).alias("memorized"))
    rows = table(spark, folder, "synthetic_queries").join(near, "text", "left")
    return rows.select("ord", "query_id", F.coalesce("memorized", F.lit(False)).alias("memorized"))


def op_j14_bm25(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.min(F.struct("ord", "text")).alias("r")).select(F.col("chunk_id").alias("item"), "r.text")
    queries = V.asked(spark, folder).select(F.col("query_id").alias("qid"), "text")
    found = lexical.bm25(queries, texts, 5)
    return found.select(F.col("qid").alias("query_id"), "item", "rank", F.round("score", 5).alias("score"))


def op_t3_hashed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = lexical.hashed_embeddings(table(spark, folder, "synthetic_queries").select("ord", "text"), keep=["ord"])
    return rows.select("ord", F.posexplode("vector").alias("bucket", "value")).filter("value <> 0").select("ord", "bucket", F.round("value", 6).alias("value"))


def op_v1_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of the usable vectors before and after normalising."""
    from sievebench.functions.vectors import usable

    rows = table(spark, folder, "vector_store").filter(usable("embedding", V.DIM))
    return rows.select("vec_id", F.round(length("embedding"), 6).alias("before"), F.round(length(l2_normalize("embedding")), 6).alias("after"))


def op_v4_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The anchor of each seed without a target: the mean of its chunks' vectors, by position."""
    seeds = table(spark, folder, "seeds").filter("z IS NULL").select("seed_id", F.explode(F.array_distinct("chunk_ids")).alias("item"))
    parts = seeds.join(V.corpus(spark, folder), "item").select("seed_id", F.posexplode("vector").alias("pos", "x"))
    return parts.groupBy("seed_id", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("op_")}

SQL = {
    "op_j1_top_chunks": V.sql(
        "qv corpus",
        """SELECT query_id, item, rank, round(s, 6) AS score FROM (
        SELECT query_id, item, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS rank FROM (
          SELECT q.query_id, c.item, round(list_dot_product(q.v, c.v), 12) AS s FROM qv q, corpus c)) WHERE rank <= 10""",
    ),
    "op_j2_nearest_chunk": V.sql(
        "qv corpus",
        """SELECT query_id, item, round(s, 6) AS score FROM (
        SELECT query_id, item, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS rank FROM (
          SELECT q.query_id, c.item, round(list_dot_product(q.v, c.v), 12) AS s FROM qv q, corpus c)) WHERE rank = 1""",
    ),
    "op_j3_assign": V.sql("labels", "SELECT query_id, cluster FROM labels"),
    "op_j4_radius": V.sql(
        "qv",
        """SELECT round(quantile_cont(s, 0.1), 6) AS radius FROM (
        SELECT max(round(list_dot_product(a.v, b.v), 12)) AS s FROM qv a JOIN qv b ON a.query_id <> b.query_id
        WHERE a.split = 'train' AND b.split = 'train' GROUP BY a.query_id)""",
    ),
    "op_j5_span_gold": """
        WITH docs AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0),
        spans AS (SELECT doc_id, n // 4 AS s, n // 2 AS e FROM docs),
        pieces AS (SELECT doc_id, w, w * 800 AS s, least(w * 800 + 1000, n) AS e FROM docs, LATERAL (SELECT unnest(range((n - 1) // 800 + 1)) AS w))
        SELECT DISTINCT spans.doc_id AS query_id, pieces.doc_id || ':' || w AS chunk_id FROM spans JOIN pieces USING (doc_id)
        WHERE least(spans.e, pieces.e) - greatest(spans.s, pieces.s) > 0
          AND least(spans.e, pieces.e) - greatest(spans.s, pieces.s) >= least(0.5 * (spans.e - spans.s), 200)""",
    "op_j6_qrels_known": V.sql(
        "graded asked passages",
        """SELECT coalesce(a.split, 'none') AS split, p.chunk_id IS NOT NULL AS known, count(*) AS pairs
        FROM graded g LEFT JOIN asked a USING (query_id) LEFT JOIN passages p ON p.chunk_id = g.chunk_id GROUP BY ALL""",
    ),
    "op_j8_anchor_qrels": V.sql("graded asked", "SELECT g.* FROM graded g WHERE query_id IN (SELECT query_id FROM asked WHERE split = 'anchor')"),
    "op_io9_binary_qrels": V.sql("graded passages", "SELECT query_id, chunk_id, 1 AS grade FROM graded JOIN passages USING (chunk_id) WHERE grade >= 1"),
    "op_j9_without_vector": V.sql("asked store", "SELECT query_id FROM asked a WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.embedding_ref = a.embedding_ref)"),
    "op_j10_cache_misses": """SELECT DISTINCT embedding_ref FROM (SELECT embedding_ref FROM production_queries UNION ALL SELECT embedding_ref FROM chunks)
        WHERE embedding_ref IS NOT NULL AND embedding_ref NOT IN (SELECT embedding_ref FROM vector_store)""",
    "op_j12_exemplars": V.sql(
        "labels",
        """, targets AS (SELECT seed_id, list_transform(z, lambda x: x / n) AS v FROM (SELECT seed_id, z, sqrt(list_sum(list_transform(z, lambda x: x * x))) AS n FROM seeds WHERE z IS NOT NULL)),
        placed AS (SELECT seed_id, v, arg_min(cluster, {'d': round(list_dot_product(c, c) - 2 * list_dot_product(v, c), 12), 'k': cluster}) AS cluster FROM targets, centres GROUP BY ALL)
        SELECT seed_id, query_id, rank FROM (
          SELECT seed_id, q.query_id, row_number() OVER (PARTITION BY seed_id ORDER BY (p.cluster = l.cluster) DESC, round(list_dot_product(p.v, q.v), 11) DESC, q.query_id) AS rank
          FROM placed p, qv q JOIN labels l USING (query_id) WHERE q.split = 'train') WHERE rank <= 3""",
    ).replace("\n, targets", ", targets"),
    "op_j14_bm25": V.sql(
        "asked",
        r""", texts AS (SELECT chunk_id AS item, arg_min(coalesce(text, ''), ord) AS text FROM chunks GROUP BY 1),
        words AS (SELECT item, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM texts),
        sizes AS (SELECT t.item, count(w.term) AS n FROM texts t LEFT JOIN words w USING (item) GROUP BY 1),
        tf AS (SELECT item, term, count(*) AS tf FROM words GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM asked),
        s AS (SELECT query_id, item, round(sum(ln(1 + ((SELECT count(*) FROM texts) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (SELECT avg(n) FROM sizes)))), 9) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (item) GROUP BY ALL)
        SELECT query_id, item, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 5""",
    ).replace("\n, texts", ", texts"),
    "op_j13_memorized": """
        WITH texts AS (SELECT DISTINCT text, 's' AS side FROM synthetic_queries WHERE text IS NOT NULL UNION ALL SELECT DISTINCT text, 'p' FROM production_queries WHERE text IS NOT NULL),
        named AS (SELECT *, row_number() OVER (ORDER BY side, text) AS id FROM texts),
        grams AS (SELECT id, substr(lower(text), i, n) AS gram FROM named, (SELECT unnest([3, 4, 5]) AS n), LATERAL (SELECT unnest(range(1, length(lower(text)) - n + 2)) AS i)),
        hashed AS (SELECT id, gram, sha256('0|' || gram) AS h FROM grams),
        counts AS (SELECT id, ('0x' || substr(h, 15, 2))::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS c FROM hashed GROUP BY ALL),
        scaled AS (SELECT id, bucket, sign(c) * ln(1 + abs(c)) AS s FROM counts WHERE c <> 0),
        filled AS (SELECT id, bucket, s FROM scaled UNION ALL SELECT id, 0, 1.0 FROM named WHERE id NOT IN (SELECT id FROM scaled)),
        dense AS (SELECT n.id, b.bucket, coalesce(f.s, 0)::DOUBLE AS s FROM named n, (SELECT unnest(range(256))::INT AS bucket) b LEFT JOIN filled f ON f.id = n.id AND f.bucket = b.bucket),
        raw AS (SELECT id, list(s ORDER BY bucket) AS v FROM dense GROUP BY id),
        vectors AS (SELECT side, text, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM raw JOIN named USING (id)),
        hit AS (SELECT a.text FROM vectors a WHERE a.side = 's' AND EXISTS (SELECT 1 FROM vectors b WHERE b.side = 'p' AND round(list_dot_product(a.v, b.v), 12) >= 0.9))
        SELECT ord, query_id, coalesce(text IN (SELECT text FROM hit), false) AS memorized FROM synthetic_queries""",
    "op_t3_hashed_vectors": """
        WITH grams AS (SELECT ord, substr(lower(text), i, n) AS gram FROM synthetic_queries, (SELECT unnest([3, 4, 5]) AS n), LATERAL (SELECT unnest(range(1, length(lower(text)) - n + 2)) AS i)),
        hashed AS (SELECT ord, sha256('0|' || gram) AS h FROM grams),
        counts AS (SELECT ord, ('0x' || substr(h, 15, 2))::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS c FROM hashed GROUP BY ALL),
        scaled AS (SELECT ord, bucket, sign(c) * ln(1 + abs(c)) AS s FROM counts WHERE c <> 0),
        every AS (SELECT ord, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY ord)) AS value FROM scaled)
        SELECT ord, bucket, round(value, 6) AS value FROM every
        UNION ALL SELECT ord, 0, 1.0 FROM synthetic_queries WHERE text IS NOT NULL AND ord NOT IN (SELECT ord FROM scaled)""",
    "op_v1_lengths": """SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS before, 1.0::DOUBLE AS after FROM vector_store
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "op_v4_centroids": V.sql(
        "corpus",
        """SELECT seed_id, (p - 1)::INT AS pos, round(avg(v[p]), 6) AS mean
        FROM (SELECT DISTINCT seed_id, unnest(chunk_ids) AS item FROM seeds WHERE z IS NULL) JOIN corpus USING (item), (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL""",
    ),
}
