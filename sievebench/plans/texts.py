"""Queries on text identity, prompts, and exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.functions import text as T
from sievebench.operators.dedup import first_by
from sievebench.operators.fidelity import distinct_n
from sievebench.operators.spans import split_windows
from sievebench.plans import views as V
from sievebench.session import table
from sievebench.sources.benchmarks import titled


def op_h1_content_address(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the chunks computed from text, document, page and box, and whether the stored hash is the text's."""
    rows = table(spark, folder, "chunks").filter("text IS NOT NULL")
    own = T.content_hash("text")
    return rows.select("ord", T.chunk_id("text", "doc_id", "page", "canonical_bbox").alias("made_id"), own.alias("made_hash"), (own == F.col("content_hash")).alias("same_hash"))


def op_h2_stable_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("source").distinct().select("source", T.stable_hash64("source").cast("string").alias("hash"))


def op_h3_stratum_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "production_queries").filter("stratum IS NOT NULL").select("ord", T.stratum_key("stratum").alias("stratum_key"))


def op_t1_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of all documents; each starts where the one before ends, less the overlap."""
    return split_windows(table(spark, folder, "documents"), keep=["doc_id"]).select("doc_id", "start", "end")


def op_t2_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.size(T.space_words("text")).cast("bigint").alias("words"))


def op_t7_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The request for the first candidate of every seed, from its chunks in order and its query type."""
    seeds = table(spark, folder, "seeds")
    texts = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.min(F.struct("ord", "text")).alias("r")).select("chunk_id", F.coalesce("r.text", F.lit("")).alias("text"))
    parts = seeds.select("seed_id", F.posexplode("chunk_ids").alias("pos", "chunk_id")).join(texts, "chunk_id")
    evidence = parts.groupBy("seed_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text).alias("texts"))
    kind = T.instruction(F.coalesce(F.col("stratum")["query_type"], F.lit("")))
    rows = seeds.select("seed_id", kind.alias("told")).join(evidence, "seed_id")
    return rows.select("seed_id", T.prompt(F.col("texts"), F.array().cast("array<string>"), F.col("told"), F.lit(0), 3).alias("prompt"))


def op_t7_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """The request to rewrite each synthetic query whose cosine to its target was below 0.6, with its own text as example."""
    rows = table(spark, folder, "synthetic_queries").filter("text IS NOT NULL AND gen_meta.cos_to_target < 0.6")
    own, none = F.array("text"), F.array().cast("array<string>")
    told = T.instruction(F.lit("keyword"))
    return rows.select("ord", T.revise_prompt(F.col("text"), F.col("gen_meta.cos_to_target"), 0.6, none, own, told).alias("prompt"))


def op_t8_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Deterministic replies to the prompts."""
    return op_t7_prompts(spark, folder).select("seed_id", T.mock_reply(0, "system", F.col("prompt")).alias("reply"))


def op_io8_titled_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", titled().alias("text"))
    return rows.select("doc_id", T.chunk_id("text", F.col("doc_id").cast("string"), F.lit(None)).alias("chunk_id"), F.length("text").cast("bigint").alias("n"))


def op_d1_first_texts(spark: SparkSession, folder: str) -> DataFrame:
    return first_by(table(spark, folder, "documents").select("text", F.col("doc_id").alias("ord")), "text").select(F.col("ord").alias("doc_id"))


def op_d3_first_queries(spark: SparkSession, folder: str) -> DataFrame:
    return first_by(table(spark, folder, "production_queries").select("query_id", "ord", "split"), "query_id").select("query_id", "ord", "split")


def op_a11_distinct_words(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_n(table(spark, folder, "synthetic_queries"), "text", 1).select(F.round("distinct_n", 9).alias("distinct_n"))


def op_a11_distinct_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_n(table(spark, folder, "synthetic_queries"), "text", 2).select(F.round("distinct_n", 9).alias("distinct_n"))


def op_g8_record_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "synthetic_queries").filter("text IS NOT NULL")
    return rows.select("ord", T.record_id("query_id", "text").alias("record_id"), T.oracle_record_id("query_id").alias("oracle_id"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("op_")}

_DOC_PAGE = "coalesce(page::VARCHAR, 'None')"
_BOX = "coalesce('(' || array_to_string(list_transform(canonical_bbox, lambda x: x::VARCHAR), ', ') || ')', 'None')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_INSTRUCTION = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in T.INSTRUCTIONS.items()) + f" ELSE {_q(T.DEFAULT_INSTRUCTION)} END"
_PROMPT = f"""prompts AS (
    SELECT s.seed_id, {_q(T.OPENING)} || 'Evidence:' || chr(10) || e.t || chr(10) || 'Instruction: ' || {_INSTRUCTION.format("s.stratum['query_type']")}
        || {_q(T.ANSWER_FIRST)} || {_q(T.VARIANT % (1, 3))} AS prompt
    FROM seeds s JOIN (
        SELECT seed_id, string_agg('[chunk] ' || t.text || chr(10), '' ORDER BY pos) AS t
        FROM (SELECT seed_id, unnest(chunk_ids) AS chunk_id, generate_subscripts(chunk_ids, 1) AS pos FROM seeds) p
        JOIN (SELECT chunk_id, arg_min(coalesce(text, ''), ord) AS text FROM chunks GROUP BY 1) t USING (chunk_id) GROUP BY 1) e USING (seed_id))"""
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
_SPLIT = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_SPACE = V._WHITE.removesuffix("+")


def _window(source: str) -> str:
    """A window of 1,000 characters from ``s``: it ends at its last white space if that lets the next one advance."""
    return f"""SELECT doc_id, text, n, s, CASE WHEN s + 1000 >= n THEN n WHEN sp - 200 > s THEN sp ELSE s + 1000 END AS e FROM (
        SELECT *, CASE WHEN regexp_matches(part, '{_SPACE}') THEN s + 1 + length(regexp_extract(part, '(?s)^(.*){_SPACE}', 1)) ELSE -1 END AS sp
        FROM (SELECT *, substring(text, (s + 2)::BIGINT, 999) AS part FROM ({source})))"""


SQL = {
    "op_h1_content_address": f"""SELECT ord, substr(sha256(n || '|' || doc_id || '|' || {_DOC_PAGE} || '|' || {_BOX}), 1, 16) AS made_id, substr(sha256(n), 1, 16) AS made_hash,
        substr(sha256(n), 1, 16) = content_hash AS same_hash FROM (SELECT *, {V.norm_sql('text')} AS n FROM chunks WHERE text IS NOT NULL)""",
    "op_h2_stable_hash": "SELECT DISTINCT source, ('0x' || substr(sha256(source), 1, 16))::UBIGINT::VARCHAR AS hash FROM documents",
    "op_h3_stratum_key": "SELECT ord, array_to_string(list_transform(list_sort(map_keys(stratum)), lambda k: k || '=' || coalesce(stratum[k], '')), '|') AS stratum_key FROM production_queries WHERE stratum IS NOT NULL",
    "op_t2_word_counts": f"SELECT doc_id, len(list_filter(string_split({V.norm_sql('text')}, ' '), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL",
    "op_t7_prompts": f"WITH {_PROMPT} SELECT * FROM prompts",
    "op_t7_revisions": f"""SELECT ord, replace({_q(T.REVISE_OPENING % ("@", "0.6"))}, '@', printf('%.3f', gen_meta.cos_to_target)) || text || chr(10) || chr(10) || 'Evidence:' || chr(10)
        || {_q(T.REVISE_STYLE)} || '- ' || text || chr(10) || chr(10) || 'Instruction: ' || {_q(T.INSTRUCTIONS["keyword"])} || {_q(T.REVISE_END)} AS prompt
        FROM synthetic_queries WHERE text IS NOT NULL AND gen_meta.cos_to_target < 0.6""",
    "op_t8_replies": f"""WITH {_PROMPT}, said AS (SELECT seed_id, prompt, {_SPLIT.format(V.norm_sql('prompt'))} AS every,
            flatten(list_transform(list_filter(regexp_split_to_array(prompt, '{_BREAKS}'), lambda x: starts_with(x, '[chunk]')), lambda x: ({_SPLIT.format(V.norm_sql('x'))})[2:])) AS words FROM prompts)
        SELECT seed_id, 'what about ' || array_to_string(CASE WHEN len(words) > 0 THEN words[1:12] ELSE every[greatest(len(every) - 5, 1):] END, ' ')
            || ' (' || substr(sha256('0|system|' || prompt), 1, 8) || ')?' AS reply FROM said""",
    "op_t1_windows": f"""WITH RECURSIVE cut AS ({_window("SELECT doc_id, text, length(text) AS n, 0 AS s FROM documents WHERE length(text) > 0")}
        UNION ALL {_window("SELECT doc_id, text, n, e - 200 AS s FROM cut WHERE e < n")})
        SELECT doc_id, s::INT AS start, e::INT AS end FROM cut""",
    "op_io8_titled_chunks": f"""SELECT doc_id, substr(sha256({V.norm_sql('t')} || '|' || doc_id || '|None|None'), 1, 16) AS chunk_id, length(t) AS n
        FROM (SELECT doc_id, CASE WHEN coalesce(title, '') <> '' THEN title || chr(10) || chr(10) || text ELSE text END AS t FROM documents WHERE text IS NOT NULL)""",
    "op_d1_first_texts": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "op_d3_first_queries": "SELECT query_id, ord, split FROM production_queries QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ord) = 1",
    "op_a11_distinct_words": f"""WITH g AS (SELECT unnest(list_filter(string_split({V.norm_sql('text')}, ' '), lambda x: x <> '')) AS w FROM synthetic_queries)
        SELECT round(count(DISTINCT w) / count(*), 9) AS distinct_n FROM g""",
    "op_a11_distinct_bigrams": f"""WITH t AS (SELECT list_filter(string_split({V.norm_sql('text')}, ' '), lambda x: x <> '') AS w FROM synthetic_queries),
        g AS (SELECT w[i] || ' ' || w[i + 1] AS g FROM t, LATERAL (SELECT unnest(range(1, len(w))) AS i))
        SELECT round(count(DISTINCT g) / count(*), 9) AS distinct_n FROM g""",
    "op_g8_record_ids": "SELECT ord, 'rec-' || substr(sha256(query_id || '|' || text), 1, 16) AS record_id, 'rec-oracle-' || substr(sha256(query_id), 1, 16) AS oracle_id FROM synthetic_queries WHERE text IS NOT NULL",
}
