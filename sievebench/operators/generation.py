"""Contexts, query generation with one revision, simulated chat and embedding models, and the bank of their vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievebench.functions import text as T
from sievebench.functions.vectors import dot, l2_normalize
from sievebench.operators.similarity import nearest_items

TARGET_COSINE = 0.6
#: A revised query keeps half of the style and a third of the noise; fixed values.
REVISED_STYLE, REVISED_NOISE = 0.5, 1 / 3


def mean_vectors(parts: DataFrame, key: str) -> DataFrame:
    """``key, vector``: the unit mean of each key's vectors; keys whose mean is zero keep it."""
    each = parts.select(key, F.posexplode("vector").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("m"))
    lists = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p.m).alias("m"))
    return lists.select(key, l2_normalize("m").alias("vector"))


def anchors(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """``seed_id, vector``: a seed's target, or else the unit mean of its chunks; seeds with neither have no row.

    ``seeds`` has ``seed_id, chunk_ids, z``, ``chunks`` ``item, vector``.
    """
    given = seeds.filter("z IS NOT NULL").select("seed_id", l2_normalize("z").alias("vector"))
    named = seeds.filter("z IS NULL").select("seed_id", F.explode(F.array_distinct("chunk_ids")).alias("item"))
    return given.unionByName(mean_vectors(named.join(chunks.select("item", "vector"), "item").select("seed_id", "vector"), "seed_id"))


def exemplars(seeds: DataFrame, anchored: DataFrame, train: DataFrame, k: int = 3, *, clusters: int, dim: int = 64) -> DataFrame:
    """``seed_id, query_id, rank``: train queries of the seed's cluster first, then the nearest others.

    ``seeds`` has ``seed_id, cluster``, ``train`` ``query_id, cluster, vector``. An axis for each cluster, added to both
    sides, puts those of the same cluster above all others in one join. Empty for ``k`` below 1.
    """
    mark = F.transform(F.array(*[F.lit(i) for i in range(clusters)]), lambda i: F.when(i == F.col("cluster"), F.lit(2.0)).otherwise(F.lit(0.0)))
    asked = seeds.select("seed_id", "cluster").join(anchored, "seed_id").select(F.col("seed_id").alias("qid"), F.concat("vector", mark).alias("vector"))
    items = train.select(F.col("query_id").alias("item"), F.concat("vector", mark).alias("vector"))
    if k < 1:
        return asked.select(F.col("qid").alias("seed_id"), F.lit("").alias("query_id"), F.lit(0).alias("rank")).limit(0)
    return nearest_items(asked, items, k, dim=dim + clusters).select(F.col("qid").alias("seed_id"), F.col("item").alias("query_id"), "rank")


def assemble(seeds: DataFrame, texts: DataFrame, shown: DataFrame | None = None, *, two_step: bool = False, blind_summary: bool = False) -> DataFrame:
    """Contexts ``seed_id, chunk_texts, style_exemplars, instruction``.

    ``seeds`` has ``seed_id, chunk_ids, query_type``, ``texts`` ``chunk_id, text``, ``shown`` ``seed_id, rank, text``. An
    unknown chunk raises when the rows are read; the two modes that are not built raise at once.
    """
    if two_step or blind_summary:
        raise NotImplementedError("two_step and blind_summary are not available")
    parts = seeds.select("seed_id", F.posexplode("chunk_ids").alias("pos", "chunk_id")).join(texts.select("chunk_id", "text", F.lit(True).alias("known")), "chunk_id", "left")
    known = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown chunk "), F.coalesce("chunk_id", F.lit("null"))))).otherwise(F.coalesce("text", F.lit("")))
    evidence = parts.groupBy("seed_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", known.alias("text")))), lambda x: x.text).alias("chunk_texts"))
    rows = seeds.select("seed_id", T.instruction(F.coalesce("query_type", F.lit(""))).alias("instruction")).join(evidence, "seed_id")
    none = F.array().cast("array<string>")
    if shown is None:
        return rows.select("seed_id", "chunk_texts", none.alias("style_exemplars"), "instruction")
    styles = shown.groupBy("seed_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x.text).alias("s"))
    return rows.join(styles, "seed_id", "left").select("seed_id", "chunk_texts", F.coalesce("s", none).alias("style_exemplars"), "instruction")


def requests(contexts: DataFrame, candidates: int = 3) -> DataFrame:
    """Contexts once for each candidate: adds ``qid, candidate, prompt``."""
    every = contexts.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    named = every.withColumn("qid", F.concat(F.lit("synq-"), "seed_id", F.lit("-"), "candidate"))
    return named.withColumn("prompt", T.prompt(F.col("chunk_texts"), F.col("style_exemplars"), F.col("instruction"), F.col("candidate"), candidates))


def generate(asked: DataFrame, complete: Callable[[DataFrame], DataFrame], targets: DataFrame, *, required: float = TARGET_COSINE, revisions: int = 1, namespace: str = "run") -> DataFrame:
    """``qid, seed_id, candidate, text, vector, embedding_ref, cos_to_target, revisions`` of every request.

    ``complete`` takes ``qid, prompt, chunk_texts, style_exemplars`` and gives ``qid, text, vector``. A candidate whose seed
    has a target (``seed_id, z``, unit) and whose cosine to it is below ``required`` is asked to be rewritten, at most
    ``revisions`` times; the last answer stands. References are namespaced by run and revision, so they are written once.
    """
    from sievebench.session import materialise

    carried = ["qid", "seed_id", "candidate", "chunk_texts", "style_exemplars", "instruction"]
    rows = asked.join(targets.select("seed_id", "z"), "seed_id", "left")
    made = complete(rows.select("qid", "prompt", "chunk_texts", "style_exemplars"))
    state = rows.select(*carried, "z").join(made, "qid").withColumn("cos_to_target", F.when(F.col("z").isNotNull(), dot("vector", "z"))).withColumn("revisions", F.lit(0))
    state = materialise(state, "generated")
    for step in range(1, revisions + 1):
        drifted = F.coalesce((F.col("cos_to_target") < required) & (F.col("revisions") == step - 1), F.lit(False))
        again = state.filter(drifted)
        told = T.revise_prompt(F.col("text"), F.col("cos_to_target"), required, F.col("chunk_texts"), F.col("style_exemplars"), F.col("instruction"))
        anew = complete(again.select("qid", told.alias("prompt"), "chunk_texts", "style_exemplars"))
        revised = again.drop("text", "vector", "cos_to_target", "revisions").join(anew, "qid").withColumn("cos_to_target", dot("vector", "z")).withColumn("revisions", F.lit(step))
        state = materialise(state.filter(~drifted).unionByName(revised), "generated", old=state)
    ref = F.concat(F.lit(f"{namespace}|"), "qid", F.lit("#a"), F.col("revisions").cast("string"))
    return state.select("qid", "seed_id", "candidate", "text", "vector", ref.alias("embedding_ref"), "cos_to_target", "revisions")


class Bank:
    """Text to vector: a table that simulated models write and the passthrough embedder reads."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows.select("text", "vector")

    def put(self, rows: DataFrame) -> None:
        """Adds vectors; a text that is known gets the new one."""
        new = rows.select("text", "vector")
        self.rows = self.rows.join(new.select("text").distinct(), "text", "left_anti").unionByName(new)

    def get(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` with ``vector``; a text that was never banked raises when the rows are read."""
        found = wanted.join(self.rows.withColumn("__known", F.lit(True)), "text", "left")
        checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("no vector banked for "), F.substring(F.coalesce("text", F.lit("null")), 1, 60)))).otherwise(F.col("vector"))
        return found.withColumn("vector", checked).drop("__known")

    def held(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` with ``vector``, of banked texts only."""
        return wanted.join(self.rows, "text")


def _seeded(name: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))


def mock_vectors(rows: DataFrame, *, dim: int = 32, seed: int = 0, text: str = "text") -> DataFrame:
    """Adds ``vector``: a random unit vector that depends on the text alone; null for a null text."""

    @F.pandas_udf("array<double>")
    def made(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = None if t is None else _seeded(f"{seed}|{t}").standard_normal(dim)
            out.append(None if v is None else (v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
        return pd.Series(out)

    return rows.withColumn("vector", made(F.col(text)))


CHUNK_TOKEN, QUERY_TOKEN = r"toychunk:\d{4}", r"toyquery:[a-z]+:\d{5}"


def toy_chat(bank: Bank, *, style: float = 0.15, noise: float = 0.3, base: str = "chunks", seed: int = 0, dim: int = 64, system: str = T.SYSTEM) -> Callable[[DataFrame], DataFrame]:
    """A simulated generator, ``qid, prompt`` to ``qid, text, vector``: the unit mean of the banked vectors of the tokens
    in the prompt, moved by a common style and noise of its own, less of both in a revision.

    ``base`` says whether chunk or query tokens come first; the others are used if none of these is banked. A prompt
    without any banked token raises when the rows are read.
    """
    if base not in ("chunks", "exemplars"):
        raise ValueError(f"unknown base {base!r}; known: chunks, exemplars")
    direction = np.random.default_rng([seed, int.from_bytes(hashlib.sha256(b"toy_style_dir").digest()[:8], "big")]).standard_normal(dim)
    direction /= np.linalg.norm(direction)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, vectors = [], []
            for prompt, start, revised in zip(pdf["prompt"], pdf["base"], pdf["revised"], strict=True):
                g = _seeded(f"{seed}\0{system}\0{prompt}").standard_normal(dim)
                v = np.asarray(start) + style * (REVISED_STYLE if revised else 1) * direction + noise * (REVISED_NOISE if revised else 1) * g / np.linalg.norm(g)
                texts.append("toysynth:" + hashlib.sha256(f"{system}\0{prompt}\0{seed}".encode()).hexdigest()[:16])
                vectors.append((v / np.linalg.norm(v)).tolist())
            yield pd.DataFrame({"qid": pdf["qid"], "text": texts, "vector": vectors})

    def complete(asked: DataFrame) -> DataFrame:
        def tokens(pattern: str, place: int) -> DataFrame:
            named = asked.select("qid", F.explode(F.regexp_extract_all("prompt", F.lit(pattern), F.lit(0))).alias("text"))
            return bank.held(named).select("qid", F.lit(place).alias("place"), "vector")

        chunks_first = base == "chunks"
        found = tokens(CHUNK_TOKEN, 0 if chunks_first else 1).unionByName(tokens(QUERY_TOKEN, 1 if chunks_first else 0))
        first = F.min("place").over(Window.partitionBy("qid"))
        used = mean_vectors(found.withColumn("first", first).filter(F.col("place") == F.col("first")).select("qid", "vector"), "qid").withColumnRenamed("vector", "base")
        rows = asked.select("qid", "prompt").join(used, "qid", "left")
        start = F.when(F.col("base").isNull(), F.raise_error(F.concat(F.lit("no banked token in the prompt of "), "qid"))).otherwise(F.col("base"))
        ready = rows.select("qid", "prompt", start.alias("base"), F.contains(F.col("prompt"), F.lit("REVISE_REQUEST")).alias("revised"))
        return ready.mapInPandas(emit, "qid string, text string, vector array<double>")

    return complete


def mock_chat(embed: Callable[[DataFrame], DataFrame], *, seed: int = 0, system: str = T.SYSTEM) -> Callable[[DataFrame], DataFrame]:
    """A generator that echoes the evidence; ``embed`` adds ``vector`` to ``text``."""

    def complete(asked: DataFrame) -> DataFrame:
        return embed(asked.select("qid", T.mock_reply(seed, system, F.col("prompt")).alias("text"))).select("qid", "text", "vector")

    return complete


def toy_judge(similarity: Column | str, query: Column | str, *, least: float = 0.4, no_evidence_share: int = 5, has_evidence: Column | None = None) -> Column:
    """With evidence, answerable if the greatest cosine suffices; without, for a share of queries in a hundred, by hash."""
    c = F.col(similarity) if isinstance(similarity, str) else similarity
    bare = F.pmod(T.stable_hash64(query), F.lit(100).cast("decimal(20,0)")) < no_evidence_share
    seen = F.coalesce(c, F.lit(-1.0)) >= least
    return F.when(c.isNull() if has_evidence is None else ~has_evidence, bare).otherwise(seen)


def mock_judge(has_evidence: Column, with_evidence: bool = True, without: bool = False) -> Column:
    return F.when(has_evidence, F.lit(with_evidence)).otherwise(F.lit(without))
