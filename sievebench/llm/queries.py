"""Queries of the training-data problems over the test tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.llm import clusters, leakage, near_duplicates, neighbours, packing, splitting, subjects, tokens
from sievebench.session import table


def _all_queries(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("query_id", "text", "split", "source")
    return table(spark, folder, "production_queries").select(*columns).unionByName(table(spark, folder, "synthetic_queries").select(*columns))


def p1_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation record with its largest overlap with a training text."""
    return leakage.cross_split_overlaps(_all_queries(spark, folder), key="query_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """``query_id`` of the affected evaluation records."""
    return p1_overlaps(spark, folder).filter("partners > 0").select("query_id").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Affected records of each split and source."""
    return leakage.leak_report(p1_overlaps(spark, folder))


def _named_clusters(spark: SparkSession, folder: str) -> DataFrame:
    ours = table(spark, folder, "vector_store").filter("owner_kind = 'production_query'").select("vec_id", "embedding")
    members, assign = clusters.vector_clusters(ours)
    seeds = assign(table(spark, folder, "seeds").filter("z IS NOT NULL"), "z", ["cluster_id"])
    return clusters.named_clusters(members, seeds.select("cluster", F.col("cluster_id").alias("name")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, cluster_id`` of every vector of production queries that lies in a cluster."""
    return _named_clusters(spark, folder).select(F.col("id").alias("vec_id"), F.col("name").alias("cluster_id"))


def p2_typical(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster's size and its five most typical queries."""
    best = clusters.typical_members(_named_clusters(spark, folder))
    refs = table(spark, folder, "vector_store").select(F.col("vec_id").alias("id"), "embedding_ref")
    texts = table(spark, folder, "production_queries").filter("embedding_ref IS NOT NULL").groupBy("embedding_ref").agg(F.min("text").alias("text"))
    named = best.join(refs, "id").join(texts, "embedding_ref", "left")
    return named.select(F.col("name").alias("cluster_id"), "size", "rank", F.col("id").alias("vec_id"), "text", F.round("cosine", 6).alias("cosine"), F.round("flow", 6).alias("flow"))


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), "ord", "text")
    return chunks.unionByName(table(spark, folder, "synthetic_queries").select(F.lit("synthetic").alias("kind"), "ord", "text"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each row with words, its group, the group's size, and whether it is the row to keep."""
    return near_duplicates.group_report(near_duplicates.similar_groups(_copies(spark, folder), key="ord", kind="kind"), "ord")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """``kind, ord_a, ord_b``: every pair of rows in one group."""
    return near_duplicates.group_pairs(near_duplicates.similar_groups(_copies(spark, folder), key="ord", kind="kind"), "ord")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk cut into pieces of at most 1,000 characters, with doc_id, order and place."""
    cut = splitting.split_texts(table(spark, folder, "chunks"), keep=["ord", "chunk_id", "doc_id"])
    return cut.select(
        "ord",
        "chunk_id",
        "doc_id",
        "n_pieces",
        F.col("p_piece").alias("piece"),
        F.col("p_start").alias("start_at"),
        F.col("p_end").alias("end_at"),
        F.col("p_source_start").alias("source_start"),
        F.col("p_source_end").alias("source_end"),
        F.col("p_overlap").alias("overlap"),
        F.col("p_text").alias("text"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """``ord`` of the chunks that had to be cut."""
    cut = splitting.split_texts(table(spark, folder, "chunks"), keep=["ord"])
    return cut.filter((F.col("n_pieces") > 1) & (F.col("p_piece") == 0)).select("ord")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, ids`` of every document."""
    return tokens.token_ids(table(spark, folder, "documents"), keep=["doc_id"])


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every piece of every document that has tokens."""
    return packing.pack(table(spark, folder, "documents"), key="doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, and the fewest that any packing needs."""
    return packing.fill_report(p8_containers(spark, folder))


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar others of every usable vector."""
    return neighbours.nearest(table(spark, folder, "vector_store"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id_a, vec_id_b``: neighbours with a cosine of at least 0.94."""
    return neighbours.close_pairs(p6_neighbours(spark, folder), table(spark, folder, "vector_store"), 0.94).select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How many sentences of each document concern each subject."""
    return subjects.document_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_examples"), key="doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, subject`` where at least a quarter of the sentences are about the subject."""
    return p9_shares(spark, folder).filter(F.col("about") >= subjects.SHARE * F.col("sentences")).select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and sentences of each subject in the corpus."""
    return subjects.composition(p9_shares(spark, folder))


QUERIES = {
    "p1_found": p1_found,
    "p1_overlaps": p1_overlaps,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_typical": p2_typical,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_composition": p9_composition,
}

_BAGS = r"""
    tokens AS (SELECT side, id, word, row_number() OVER (PARTITION BY side, id, word) AS again FROM (
        SELECT side, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM texts)),
    sizes AS (SELECT side, id, count(*) AS n FROM tokens GROUP BY ALL)"""
_UNIT = """unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS v FROM (
        SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM vector_store
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0))"""

_RECORDS = "records AS (SELECT query_id, text, split, source FROM production_queries UNION ALL SELECT query_id, text, split, source FROM synthetic_queries)"
#: Overlaps of different bags of words: ``mine`` are evaluation records by row, ``best`` the bags' nearest training bags.
_OVERLAPS = rf"""{_RECORDS},
    spelled AS (SELECT *, list_sort(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS bag FROM records WHERE split IS NOT NULL),
    bags AS (SELECT bag, row_number() OVER () AS id FROM (SELECT DISTINCT bag FROM spelled WHERE len(bag) > 0)),
    sides AS (SELECT DISTINCT id, split = 'train' AS train FROM spelled JOIN bags USING (bag)),
    tokens AS (SELECT id, word, row_number() OVER (PARTITION BY id, word) AS again FROM (SELECT id, unnest(bag) AS word FROM bags)),
    sizes AS (SELECT id, len(bag) AS n FROM bags),
    shared AS (SELECT a.id AS e, b.id AS t, count(*) AS c FROM tokens a JOIN tokens b USING (word, again)
        WHERE a.id IN (SELECT id FROM sides WHERE NOT train) AND b.id IN (SELECT id FROM sides WHERE train) GROUP BY ALL),
    hit AS (SELECT e, c, c / (x.n + y.n - c) AS part FROM shared JOIN sizes x ON x.id = e JOIN sizes y ON y.id = t WHERE c * 10 >= 7 * (x.n + y.n - c)),
    best AS (SELECT e AS id, max({{'p': part, 'c': c}}) AS top, count(*) AS partners FROM hit GROUP BY 1),
    mine AS (SELECT s.query_id, s.split, s.source, top, coalesce(partners, 0) AS partners FROM spelled s LEFT JOIN bags USING (bag) LEFT JOIN best USING (id) WHERE s.split <> 'train')"""

SQL = {
    # Every pair of texts that share a word is counted, so these take the plain definition at its word.
    "p1_found": f"""WITH records AS (SELECT query_id, text, split FROM production_queries UNION ALL SELECT query_id, text, split FROM synthetic_queries),
        texts AS (SELECT side, row_number() OVER () AS id, text FROM (SELECT DISTINCT CASE WHEN split = 'train' THEN 't' ELSE 'e' END AS side, text
            FROM records WHERE split IS NOT NULL AND text IS NOT NULL)), {_BAGS},
        shared AS (SELECT e.id AS e, t.id AS t, count(*) AS c FROM tokens e JOIN tokens t ON e.word = t.word AND e.again = t.again
            WHERE e.side = 'e' AND t.side = 't' GROUP BY ALL),
        hit AS (SELECT DISTINCT e FROM shared JOIN sizes a ON a.id = e JOIN sizes b ON b.id = t WHERE c * 10 >= 7 * (a.n + b.n - c))
        SELECT DISTINCT query_id FROM records JOIN texts ON texts.text = records.text AND texts.side = 'e' JOIN hit ON hit.e = texts.id
        WHERE split IS NOT NULL AND split <> 'train'""",
    "p1_overlaps": f"WITH {_OVERLAPS} SELECT query_id, split, source, top.p AS best, top.c::INT AS shared, partners FROM mine",
    "p1_report": f"""WITH {_OVERLAPS} SELECT split, source, count(*) AS records, count(*) FILTER (partners > 0) AS affected, count(*) FILTER (partners > 0 AND top.p = 1) AS same,
        round(avg((partners > 0)::INT), 6) AS share FROM mine GROUP BY ALL""",
    "p5_found": f"""WITH RECURSIVE texts AS (SELECT 'chunk' AS side, ord AS id, text FROM chunks UNION ALL SELECT 'synthetic', ord, text FROM synthetic_queries), {_BAGS},
        shared AS (SELECT a.side, a.id AS a, b.id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.side = b.side AND a.word = b.word AND a.again = b.again AND a.id < b.id GROUP BY ALL),
        links AS (SELECT s.side, a, b FROM shared s JOIN sizes x ON x.side = s.side AND x.id = a JOIN sizes y ON y.side = s.side AND y.id = b WHERE c * 10 >= 7 * (x.n + y.n - c)),
        both_ways AS (SELECT * FROM links UNION SELECT side, b, a FROM links),
        reach AS (SELECT DISTINCT side, a AS start, a AS node FROM both_ways UNION SELECT r.side, r.start, w.b FROM reach r JOIN both_ways w ON w.side = r.side AND w.a = r.node)
        SELECT side AS kind, start AS ord_a, node AS ord_b FROM reach WHERE start < node""",
    "p5_groups": f"""WITH RECURSIVE texts AS (SELECT 'chunk' AS side, ord AS id, text FROM chunks UNION ALL SELECT 'synthetic', ord, text FROM synthetic_queries), {_BAGS},
        shared AS (SELECT a.side, a.id AS a, b.id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.side = b.side AND a.word = b.word AND a.again = b.again AND a.id < b.id GROUP BY ALL),
        links AS (SELECT s.side, a, b FROM shared s JOIN sizes x ON x.side = s.side AND x.id = a JOIN sizes y ON y.side = s.side AND y.id = b WHERE c * 10 >= 7 * (x.n + y.n - c)),
        both_ways AS (SELECT * FROM links UNION SELECT side, b, a FROM links),
        reach AS (SELECT DISTINCT side, id AS start, id AS node FROM sizes UNION SELECT r.side, r.start, w.b FROM reach r JOIN both_ways w ON w.side = r.side AND w.a = r.node)
        SELECT side AS kind, start AS ord, min(node) AS group_of, count(*) AS size, min(node) = start AS kept FROM reach GROUP BY side, start""",
    "p6_found": f"""WITH {_UNIT},
        pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
        best AS (SELECT a, b, s FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM best WHERE s >= 0.94""",
    # White space of every kind that Python's str.isspace knows counts as one character in a run.
    "p3_found": r"""
        SELECT ord FROM chunks
        WHERE length(regexp_replace(regexp_replace(text,
              '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'),
              '^ | $', '', 'g')) > 1000
    """,
}
