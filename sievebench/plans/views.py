"""The roles that the test tables play, as DataFrames and as SQL common table expressions of the same content."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.functions.vectors import l2_normalize, usable
from sievebench.operators.mixture import assign
from sievebench.session import table

DIM = 64

_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm_sql(column: str) -> str:
    """The words of a text joined by single spaces, in SQL."""
    return f"trim(regexp_replace({column}, '{_WHITE}', ' ', 'g'), ' ')"



CTES = {
    "store": """store AS (
        SELECT vec_id, embedding_ref, owner_kind,
               list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v
        FROM vector_store
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0)""",
    "passages": """passages AS (
        SELECT chunk_id, arg_min(doc_id, ord) AS doc_id, arg_min(embedding_ref, ord) AS embedding_ref, min(ord) AS ord
        FROM (SELECT chunk_id, doc_id, coalesce(embedding_ref, '') AS embedding_ref, ord FROM chunks) GROUP BY chunk_id)""",
    "corpus": "corpus AS (SELECT p.chunk_id AS item, p.doc_id, p.ord, s.v FROM passages p JOIN store s ON s.embedding_ref = p.embedding_ref)",
    "asked": """asked AS (
        SELECT query_id, r.text AS text, r.split AS split, r.embedding_ref AS embedding_ref, r.received_at AS received_at, ord FROM (
          SELECT query_id, arg_min({'text': text, 'split': split, 'embedding_ref': embedding_ref, 'received_at': received_at}, ord) AS r, min(ord) AS ord
          FROM production_queries GROUP BY query_id))""",
    "qv": "qv AS (SELECT a.query_id, a.split, a.text, a.ord, a.received_at, s.v FROM asked a JOIN store s ON s.embedding_ref = a.embedding_ref)",
    "centres": """centres AS (
        SELECT cluster, list(m ORDER BY pos) AS c FROM (
          SELECT cluster_id AS cluster, pos, avg(z[pos]) AS m
          FROM seeds, (SELECT unnest(range(1, 65)) AS pos) WHERE z IS NOT NULL AND cluster_id >= 0 GROUP BY ALL) GROUP BY cluster)""",
    "labels": """labels AS (
        SELECT query_id, split, received_at, arg_min(cluster, {'d': round(list_dot_product(c, c) - 2 * list_dot_product(v, c), 12), 'k': cluster}) AS cluster
        FROM qv, centres GROUP BY ALL)""",
    "clabels": """clabels AS (
        SELECT item, ord, arg_min(cluster, {'d': round(list_dot_product(c, c) - 2 * list_dot_product(v, c), 12), 'k': cluster}) AS cluster
        FROM corpus, centres GROUP BY ALL)""",
    "grid": "grid AS (SELECT unnest(range(0, (SELECT max(cluster) + 1 FROM centres)::BIGINT))::INT AS cluster)",
    "demand": """demand AS (
        SELECT g.cluster, count(l.query_id) AS n, count(l.query_id) / sum(count(l.query_id)) OVER () AS p_hat
        FROM grid g LEFT JOIN (SELECT * FROM labels WHERE split = 'train') l ON l.cluster = g.cluster GROUP BY g.cluster)""",
    "tilted": """tilted AS (
        SELECT cluster, n, p_hat, t / sum(t) OVER () AS tilted
        FROM (SELECT *, 0.7 * p_hat + 0.3 / count(*) OVER () AS t FROM demand))""",
    "graded": "graded AS (SELECT query_id, chunk_id, max(grade) AS grade FROM qrels GROUP BY ALL)",
    "golds": """golds AS (
        SELECT q.query_id, g.chunk_id, c.v AS cv, q.v AS qv FROM qv q JOIN graded g ON g.query_id = q.query_id AND g.grade > 0
        JOIN corpus c ON c.item = g.chunk_id WHERE q.split = 'anchor')""",
    "ranks": """ranks AS (
        SELECT g.query_id, g.chunk_id, 1 + count(*) FILTER (round(list_dot_product(g.qv, c.v), 12) > round(list_dot_product(g.qv, g.cv), 12)) AS rank
        FROM golds g, corpus c GROUP BY ALL)""",
    "ndcg": """ndcg AS (
        SELECT q.query_id, coalesce(d.dcg / list_sum(list_transform(range(1, least(r.r, 10) + 1), lambda i: 1 / log2(1 + i))), 0) AS score
        FROM (SELECT query_id FROM qv WHERE split = 'anchor') q
        LEFT JOIN (SELECT query_id, sum(1 / log2(1 + rank)) AS dcg FROM ranks WHERE rank <= 10 GROUP BY query_id) d USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS r FROM golds GROUP BY query_id) r USING (query_id))""",
    "scored": "scored AS (SELECT n.query_id, l.cluster, n.score FROM ndcg n JOIN labels l USING (query_id))",
}
NEEDS = {
    "corpus": ["passages", "store"],
    "qv": ["asked", "store"],
    "labels": ["qv", "centres"],
    "clabels": ["corpus", "centres"],
    "grid": ["centres"],
    "demand": ["grid", "labels"],
    "tilted": ["demand"],
    "golds": ["qv", "graded", "corpus"],
    "ranks": ["golds", "corpus"],
    "ndcg": ["qv", "ranks", "golds"],
    "scored": ["ndcg", "labels"],
}


def sql(names: str, body: str) -> str:
    """``body`` after the expressions it names and all that those need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    return ("WITH " + ",\n".join(CTES[n] for n in order) + "\n" if order else "") + body


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, embedding_ref, owner_kind, vector`` of usable vectors, as unit vectors."""
    rows = table(spark, folder, "vector_store").filter(usable("embedding", DIM))
    return rows.select("vec_id", "embedding_ref", "owner_kind", l2_normalize("embedding").alias("vector"))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk once: ``chunk_id, doc_id, embedding_ref, ord``."""
    first = F.min(F.struct("ord", "doc_id", "embedding_ref")).alias("r")
    return table(spark, folder, "chunks").groupBy("chunk_id").agg(first).select("chunk_id", "r.doc_id", "r.embedding_ref", "r.ord")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``item, doc_id, ord, vector`` of the chunks that have a usable vector."""
    return passages(spark, folder).join(stored(spark, folder), "embedding_ref").select(F.col("chunk_id").alias("item"), "doc_id", "ord", "vector")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """Each production query once: ``query_id, text, split, embedding_ref, received_at, ord``."""
    first = F.min(F.struct("ord", "text", "split", "embedding_ref", "received_at")).alias("r")
    return table(spark, folder, "production_queries").groupBy("query_id").agg(first).select("query_id", "r.text", "r.split", "r.embedding_ref", "r.received_at", "r.ord")


def query_vectors(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """``query_id, split, text, ord, received_at, vector`` of the queries that have a usable vector."""
    rows = asked(spark, folder)
    rows = rows.filter(F.col("split") == split) if split else rows
    return rows.join(stored(spark, folder), "embedding_ref").select("query_id", "split", "text", "ord", "received_at", "vector")


def centre_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``cluster, pos, m``: the mean of the seeds' targets in each cluster, the frozen partition."""
    rows = table(spark, folder, "seeds").filter("z IS NOT NULL AND cluster_id >= 0")
    return rows.select(F.col("cluster_id").alias("cluster"), F.posexplode("z").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("m"))


def centres(spark: SparkSession, folder: str) -> np.ndarray:
    """Clusters by 64 numbers; a cluster number without seeds gets a centre that is never nearest."""
    rows = centre_rows(spark, folder).collect()
    out = np.full((max((r["cluster"] for r in rows), default=0) + 1, DIM), 1e6)
    for r in rows:
        out[r["cluster"], r["pos"]] = r["m"]
    return out


def labels(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """``query_id, split, received_at, cluster``."""
    return assign(query_vectors(spark, folder, split), centres(spark, folder), ["query_id", "split", "received_at"])


def chunk_labels(spark: SparkSession, folder: str) -> DataFrame:
    return assign(corpus(spark, folder), centres(spark, folder), ["item", "ord"])


def golds(spark: SparkSession, folder: str, asked_: DataFrame | None = None, corpus_: DataFrame | None = None) -> DataFrame:
    """``qid, item, qvector, ivector`` of the relevant pairs of anchor queries; vectors that are at hand can be given."""
    from sievebench.sources.benchmarks import max_grades

    graded = max_grades(table(spark, folder, "qrels"), ["query_id", "chunk_id"]).filter("grade > 0")
    q = (query_vectors(spark, folder, "anchor") if asked_ is None else asked_).select("query_id", F.col("vector").alias("qvector"))
    c = (corpus(spark, folder) if corpus_ is None else corpus_).select(F.col("item").alias("chunk_id"), F.col("vector").alias("ivector"))
    return graded.join(q, "query_id").join(c, "chunk_id").select(F.col("query_id").alias("qid"), F.col("chunk_id").alias("item"), "qvector", "ivector")
