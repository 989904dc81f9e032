"""The steps of a run: seeds, contexts, generation, the gate, labels and curation; checks and label strategies by name."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.contracts import CHECKS, STEPS, STRATEGIES, GateCheck, PipelineStep
from sievebench.functions.text import content_hash
from sievebench.operators import demand as D
from sievebench.operators import gate as G
from sievebench.operators import generation as N
from sievebench.operators import mixture as M
from sievebench.operators import sampling as S
from sievebench.operators.dedup import first_by, semantic_dedup
from sievebench.operators.ranking import hash_sample, numbered
from sievebench.operators.similarity import nearest_items
from sievebench.session import materialise


@dataclass(frozen=True)
class Resources:
    """What all steps share and none changes: tables, models, and the fitted partition, mixture and demand."""

    spark: SparkSession
    chunks: DataFrame
    queries: DataFrame
    qrels: DataFrame | None
    centres: np.ndarray
    mixture: M.Mixture
    p_hat: list[float]
    lam: float
    radius: float
    d: int
    seed: int
    embedder: Any = None
    chat: Any = None
    judge: Any = None
    retriever: Any = None
    bank: N.Bank | None = None
    zoo: dict[str, np.ndarray] = field(default_factory=dict)

    def tilted(self, lam: float | None = None) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(map(float, self.p_hat))), "cluster int, p_hat double")
        return D.tilt(rows, self.lam if lam is None else lam)

    def train(self) -> DataFrame:
        return self.queries.filter("split = 'train'")


@dataclass
class State:
    """Tables that the steps so far have made, tallies, and where the run comes from."""

    seeds: DataFrame | None = None
    contexts: DataFrame | None = None
    candidates: DataFrame | None = None
    gated: DataFrame | None = None
    accepted: DataFrame | None = None
    metrics: dict[str, Any] = field(default_factory=dict)
    provenance: dict[str, Any] = field(default_factory=dict)


_SEED = ("seed_id", "chunk_ids", "cluster", "query_type", "z")


def _ordered_chunks(resources: Resources) -> DataFrame:
    rows = numbered(resources.chunks.select("item", "doc_id", "vector"), "item", "ord").withColumnRenamed("item", "chunk_id")
    return M.assign(rows, resources.centres, ["ord", "chunk_id", "doc_id", "vector"])


class _Sampler(PipelineStep):
    def finished(self, seeds: DataFrame, chunks: DataFrame, resources: Resources) -> DataFrame:
        """``seeds`` has ``seed_id, chunk_id, cluster, query_type``; some get a second chunk of the same document."""
        grouped = S.partners(seeds, chunks, self.params["p_group"], resources.seed)
        ids = F.when(F.col("partner").isNotNull(), F.array("chunk_id", "partner")).otherwise(F.array("chunk_id"))
        return grouped.withColumn("chunk_ids", ids).withColumn("z", F.lit(None).cast("array<double>")).select(*_SEED)

    def typed(self, seeds: DataFrame) -> DataFrame:
        return S.round_robin(seeds, tuple(self.params["strata"] or S.STRATA))


@STEPS.register("seed_sampler.uniform")
class UniformSeeds(_Sampler):
    name = "seed_sampler.uniform"

    def defaults(self) -> dict[str, Any]:
        return {"n_seeds": 200, "p_group": 0.0, "strata": None}

    def run(self, state: State, resources: Resources) -> State:
        chunks = materialise(_ordered_chunks(resources), "chunks")
        drawn = S.uniform_seeds(chunks, self.params["n_seeds"], resources.seed).join(chunks.select("chunk_id", "cluster"), "chunk_id")
        seeds = self.typed(drawn.withColumn("k", F.col("seed_no")))
        state.seeds = materialise(self.finished(seeds, chunks, resources), "seeds")
        return state


@STEPS.register("seed_sampler.quota")
class QuotaSeeds(_Sampler):
    name = "seed_sampler.quota"

    def defaults(self) -> dict[str, Any]:
        return {"n_seeds": 200, "lam": 0.7, "n_min": 3, "p_group": 0.2, "strata": None}

    def run(self, state: State, resources: Resources) -> State:
        chunks = materialise(_ordered_chunks(resources), "chunks")
        quotas = D.quotas(resources.spark, resources.tilted(self.params["lam"]).select("cluster", "tilted"), self.params["n_seeds"], self.params["n_min"])
        drawn = S.quota_seeds(chunks, quotas, resources.seed)
        if self.params["strata"]:
            place = F.regexp_extract("seed_id", r"(\d+)$", 1).cast("int")
            drawn = self.typed(drawn.drop("query_type").withColumn("k", place))
        state.seeds = materialise(self.finished(drawn, chunks, resources), "seeds")
        return state


@STEPS.register("seed_sampler.spec")
class SpecSeeds(_Sampler):
    name = "seed_sampler.spec"

    def defaults(self) -> dict[str, Any]:
        return {"n_seeds": 200, "n_chunks_per_seed": 5, "strata": None}

    def run(self, state: State, resources: Resources) -> State:
        train = resources.train().select(F.col("query_id").alias("item"), "vector")
        draws, _ = M.guarded_sample(resources.mixture, train, self.params["n_seeds"], resources.radius, seed=resources.seed)
        targets = resources.spark.createDataFrame([(i, f"seed-spec-{i:05d}", v.tolist()) for i, v in enumerate(draws)], "k long, seed_id string, vector array<double>")
        near = nearest_items(targets.select(F.col("seed_id").alias("qid"), "vector"), resources.chunks.select("item", "vector"), self.params["n_chunks_per_seed"], dim=resources.d)
        evidence = near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("chunk_ids"))
        placed = M.assign(targets, resources.centres, ["k", "seed_id", "vector"]).withColumnRenamed("vector", "z")
        seeds = self.typed(placed.join(evidence, F.col("seed_id") == F.col("qid")))
        state.seeds = materialise(seeds.select(*_SEED), "seeds")
        return state


@STEPS.register("context_assembler")
class ContextAssembler(PipelineStep):
    name = "context_assembler"

    def __init__(self, **params: Any) -> None:
        super().__init__(**params)
        if self.params["two_step"] or self.params["blind_summary"]:
            raise NotImplementedError("two_step and blind_summary are not available")

    def defaults(self) -> dict[str, Any]:
        return {"k_style": 3, "two_step": False, "blind_summary": False}

    def run(self, state: State, resources: Resources) -> State:
        shown = None
        if self.params["k_style"] > 0:
            train = M.assign(resources.train(), resources.centres, ["query_id", "text", "vector"])
            anchored = N.anchors(state.seeds, resources.chunks)
            found = N.exemplars(state.seeds, anchored, train, self.params["k_style"], clusters=len(resources.centres), dim=resources.d)
            shown = found.join(train.select("query_id", "text"), "query_id")
        texts = resources.chunks.select(F.col("item").alias("chunk_id"), "text")
        state.contexts = materialise(N.assemble(state.seeds, texts, shown), "contexts")
        return state


@STEPS.register("generator")
class Generator(PipelineStep):
    name = "generator"

    def defaults(self) -> dict[str, Any]:
        return {"n_candidates": 3, "prompt_version": "answer_first_v1", "tau_t": N.TARGET_COSINE, "max_revisions": 1}

    def run(self, state: State, resources: Resources) -> State:
        if self.params["prompt_version"] != "answer_first_v1":
            raise KeyError(f"unknown prompt version {self.params['prompt_version']!r}; known: ['answer_first_v1']")
        asked = N.requests(state.contexts, self.params["n_candidates"])
        made = N.generate(asked, resources.chat.complete, state.seeds.select("seed_id", "z"), required=self.params["tau_t"], revisions=self.params["max_revisions"], namespace=str(state.provenance.get("benchmark_version", "run")))
        state.candidates = materialise(made.join(state.seeds.select("seed_id", "chunk_ids", "cluster", "query_type"), "seed_id"), "candidates")
        return state


def _verdicts(rows: DataFrame, passed, score=None, reason=None, promoted=None) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.select("qid", F.coalesce(passed, F.lit(False)).alias("passed"), (F.lit(None) if score is None else score).cast("double").alias("score"), (F.lit("") if reason is None else reason).alias("reason"), (none if promoted is None else promoted).alias("promoted"))


@CHECKS.register("dedup")
class DedupCheck(GateCheck):
    name, ordered = "dedup", True

    def defaults(self) -> dict[str, Any]:
        return {"cos_threshold": 0.95}

    def check(self, candidates: DataFrame, resources: Resources) -> DataFrame:
        """``candidates`` has ``fit``: whether it passes all other checks, so can be accepted; the order is that of ``qid``."""
        rows = materialise(numbered(candidates.select("qid", "vector", "fit"), "qid", "ord"), "ordered")
        kept = semantic_dedup(rows.select("ord", "vector", "fit"), self.params["cos_threshold"], dim=resources.d, eligible="fit")
        near = F.lit(f"cosine of at least {self.params['cos_threshold']} with an accepted one")
        return _verdicts(rows.select("qid", "ord").join(kept, "ord"), F.col("kept"), reason=F.when(F.col("kept"), F.lit("novel")).otherwise(near))


@CHECKS.register("zero_context")
class ZeroContextCheck(GateCheck):
    name = "zero_context"

    def check(self, candidates: DataFrame, resources: Resources) -> DataFrame:
        known = resources.judge.answerable(F.col("text"), F.lit(None).cast("double"), False)
        return _verdicts(candidates, ~known, reason=F.when(known, F.lit("answerable without evidence")).otherwise(F.lit("")))


def _evidence(candidates: DataFrame, resources: Resources) -> DataFrame:
    """``qid, similarity``: the greatest cosine of a candidate and its chunks."""
    pairs = candidates.select("qid", "vector", F.explode(F.array_distinct("chunk_ids")).alias("item")).join(resources.chunks.select("item", F.col("vector").alias("c")), "item")
    cosine = F.aggregate(F.zip_with("vector", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.groupBy("qid").agg(F.max(cosine).alias("similarity"))


@CHECKS.register("answerability")
class AnswerabilityCheck(GateCheck):
    name = "answerability"

    def check(self, candidates: DataFrame, resources: Resources) -> DataFrame:
        rows = candidates.join(_evidence(candidates, resources), "qid", "left")
        passed = resources.judge.answerable(F.col("text"), F.col("similarity"), True)
        return _verdicts(rows, passed, F.col("similarity"), F.when(passed, F.lit("")).otherwise(F.lit("not answerable from its evidence")))


@CHECKS.register("round_trip")
class RoundTripCheck(GateCheck):
    name = "round_trip"

    def defaults(self) -> dict[str, Any]:
        return {"k": 10}

    def check(self, candidates: DataFrame, resources: Resources) -> DataFrame:
        k = self.params["k"]
        golds = candidates.select("qid", F.explode(F.array_distinct("chunk_ids")).alias("item"))
        trip = G.round_trip(resources.retriever.search(candidates.select("qid", "text", "vector"), k), golds, candidates, k)
        return _verdicts(trip, F.col("passed"), F.col("score"), F.when(F.col("passed"), F.lit("")).otherwise(F.lit(f"no gold among the {k} best")))


@CHECKS.register("uniqueness")
class UniquenessCheck(GateCheck):
    name = "uniqueness"

    def __init__(self, **params: Any) -> None:
        super().__init__(**params)
        if self.params["mode"] not in ("promote", "reject"):
            raise ValueError(f"uniqueness mode must be promote or reject, got {self.params['mode']!r}")

    def defaults(self) -> dict[str, Any]:
        return {"mode": "promote", "top_m": 5}

    def check(self, candidates: DataFrame, resources: Resources) -> DataFrame:
        golds = candidates.select("qid", F.explode(F.array_distinct("chunk_ids")).alias("item"))
        most = golds.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
        ranked = nearest_items(candidates.select("qid", "vector"), resources.chunks.select("item", "vector"), self.params["top_m"] + most, dim=resources.d)
        texts = ranked.join(candidates.select("qid", "text"), "qid")
        found = G.uniqueness(texts, golds, resources.judge.answerable(F.col("text"), F.col("score"), True), self.params["top_m"])
        return G.unique_check(candidates, found, self.params["mode"])


DEFAULT_CHECKS = ["dedup", "zero_context", "answerability", "round_trip", "uniqueness"]


@STEPS.register("gate")
class Gate(PipelineStep):
    """Two phases: checks that see candidates alone, each over all of them, then those that depend on what is accepted.

    The first check in the configured order that fails rejects, as if they had been run one after another.
    """

    name = "gate"

    def __init__(self, checks: list[str] | None = None, **params: Any) -> None:
        self.given = ({"checks": checks} if checks is not None else {}) | params
        self.names = list(DEFAULT_CHECKS if checks is None else checks)
        if extra := sorted(set(params) - set(self.names)):
            raise ValueError(f"parameters of checks that aren't run: {extra}")
        self.checks = [CHECKS.get(name)(**(params.get(name) or {})) for name in self.names]

    def run(self, state: State, resources: Resources) -> State:
        rows = state.candidates
        verdicts = {c.name: materialise(c.check(rows, resources), "verdicts") for c in self.checks if not c.ordered}

        def with_all(names: list[str]) -> DataFrame:
            out = rows
            for name in names:
                v = verdicts[name].select("qid", F.struct("passed", "score", "reason", "promoted").alias(f"v_{name}"))
                out = out.join(v, "qid")
            return out

        passes = F.lit(True)
        for name in verdicts:
            passes = passes & F.col(f"v_{name}.passed")
        for c in self.checks:
            if c.ordered:
                verdicts[c.name] = materialise(c.check(with_all([n for n in verdicts]).withColumn("fit", passes), resources), "verdicts")
        judged = with_all(self.names)
        failed = G.first_failure([(n, F.col(f"v_{n}.passed")) for n in self.names]) if self.names else F.lit(None).cast("string")
        reason = F.coalesce(*[F.when(failed == n, F.col(f"v_{n}.reason")) for n in self.names]) if self.names else F.lit(None).cast("string")
        promoted = F.array_distinct(F.flatten(F.array(*[F.col(f"v_{n}.promoted") for n in self.names]))) if self.names else F.array().cast("array<string>")
        meta = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.col(f"v_{n}.score")) for n in self.names])) if self.names else F.create_map().cast("map<string,double>")
        made = judged.select(*rows.columns, failed.alias("rejected_by"), reason.alias("reason"), promoted.alias("promoted"), meta.alias("gate_meta"))
        state.gated = materialise(made, "gated")
        tally = G.tallies(state.gated).filter("rejected_by IS NOT NULL").collect()  # one row for each check
        state.metrics["gate_reject_reasons"] = {r["rejected_by"]: r["n"] for r in tally}
        return state


@STRATEGIES.register("binary")
def _binary(rows: DataFrame, resources: Resources) -> DataFrame:
    return G.binary_qrels(rows)


@STRATEGIES.register("relabel_nearest")
def _nearest(rows: DataFrame, resources: Resources) -> DataFrame:
    near = nearest_items(rows.select(F.col("query_id").alias("qid"), "vector"), resources.chunks.select("item", "vector"), 1, dim=resources.d)
    return G.nearest_qrels(rows, near)


def _records(rows: DataFrame, qrels: DataFrame, resources: Resources, version: str) -> DataFrame:
    hashes = resources.chunks.select(F.col("item").alias("chunk_id"), "content_hash")
    made = G.annotation_records(rows.select("query_id", "text"), qrels, hashes, version)
    kept = rows.select("query_id", "vector", "embedding_ref", "seed_id", "cluster", "stratum_key", "gate_meta", "cos_to_target", "revisions")
    return made.join(kept, "query_id")


@STEPS.register("qrel_builder")
class QrelBuilder(PipelineStep):
    name = "qrel_builder"

    def defaults(self) -> dict[str, Any]:
        return {"strategy": "binary"}

    def run(self, state: State, resources: Resources) -> State:
        kept = state.gated.filter("rejected_by IS NULL").withColumnRenamed("qid", "query_id").withColumn("stratum_key", F.concat(F.lit("query_type="), "query_type"))
        qrels = materialise(STRATEGIES.get(self.params["strategy"])(kept, resources), "qrels")
        state.accepted = materialise(_records(kept, qrels, resources, str(state.provenance.get("benchmark_version", "v1"))), "records")
        return state


@STEPS.register("curator")
class Curator(PipelineStep):
    name = "curator"

    def defaults(self) -> dict[str, Any]:
        return {"memorization_cos": 0.9, "target_mix": None, "max_records": None}

    def run(self, state: State, resources: Resources) -> State:
        rows = first_by(state.accepted, "text", "record_id") if "ord" not in state.accepted.columns else first_by(state.accepted, "text")
        asked = rows.select(F.col("record_id").alias("qid"), "vector")
        near = nearest_items(asked, resources.queries.select(F.col("query_id").alias("item"), "vector"), 1, dim=resources.d)
        flagged = G.flag_memorized(rows, near.select(F.col("qid").alias("record_id"), "score"), self.params["memorization_cos"])
        if self.params["target_mix"]:
            flagged = S.apply_mix(flagged, self.params["target_mix"], seed=resources.seed)
        if self.params["max_records"] is not None:
            flagged = hash_sample(flagged, "record_id", self.params["max_records"], "cap", resources.seed)
        state.accepted = materialise(flagged, "curated")
        state.metrics["curator_memorization_flags"] = state.accepted.filter("memorized").count()
        return state


def oracle_records(resources: Resources, n: int) -> DataFrame:
    """Records of oracle queries as they are: a sample in hash order, those without gold left out."""
    picked = hash_sample(resources.queries.filter("split = 'oracle'").select("query_id", "text", "vector", "stratum_key"), "query_id", n, "arm.oracle", resources.seed)
    rows = M.assign(materialise(picked, "picked"), resources.centres, ["query_id", "text", "vector", "stratum_key"])
    key = F.when(F.coalesce("stratum_key", F.lit("")) == "", F.lit("query_type=real")).otherwise(F.col("stratum_key"))
    rows = rows.withColumn("stratum_key", key).withColumn("seed_id", F.concat(F.lit("oracle-"), "query_id")).withColumn("embedding_ref", F.col("query_id"))
    rows = rows.withColumn("gate_meta", F.create_map().cast("map<string,double>")).withColumn("cos_to_target", F.lit(None).cast("double")).withColumn("revisions", F.lit(0))
    made = _records(rows, split_qrels(resources, "oracle"), resources, "arm-oracle")
    return materialise(made.withColumn("record_id", F.concat(F.lit("rec-oracle-"), F.substring(F.sha2("query_id", 256), 1, 16))), "oracle")


def split_qrels(resources: Resources, split: str) -> DataFrame:
    """``query_id, chunk_id, grade`` of a split's queries; the nearest chunk for those of a dataset without qrels.

    A relevant chunk that the corpus lacks raises when the rows are read.
    """
    queries = resources.queries.filter(F.col("split") == split)
    if resources.qrels is None:
        near = nearest_items(queries.select(F.col("query_id").alias("qid"), "vector"), resources.chunks.select("item", "vector"), 1, dim=resources.d)
        return near.select(F.col("qid").alias("query_id"), F.col("item").alias("chunk_id"), F.lit(1).alias("grade"))
    held = resources.qrels.filter("grade > 0").join(queries.select("query_id"), "query_id", "left_semi")
    return checked_qrels(held, resources.chunks.select(F.col("item").alias("chunk_id")))


def checked_qrels(qrels: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qrels`` as they are; one of a chunk that isn't in ``chunks`` raises when the rows are read."""
    known = chunks.select("chunk_id").distinct().withColumn("__known", F.lit(True))
    joined = qrels.join(known, "chunk_id", "left")
    checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("qrels of an unknown chunk "), F.coalesce("chunk_id", F.lit("null"))))).otherwise(F.col("chunk_id"))
    return joined.withColumn("chunk_id", checked).drop("__known").select(*qrels.columns)


def run_steps(steps: list[PipelineStep], resources: Resources, state: State) -> State:
    for step in steps:
        state = step.fit(resources).run(state, resources)
    return state


__all__ = ["DEFAULT_CHECKS", "Resources", "State", "checked_qrels", "content_hash", "oracle_records", "run_steps", "split_qrels"]
