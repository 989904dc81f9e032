"""A frozen partition by k-means and mixtures of von Mises-Fisher components, fitted by passes over all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebench.functions.vectors import banerjee_kappa, sample_vmf, vmf_log_norm_const
from sievebench.operators.similarity import dense


def fit_partition(rows: DataFrame, clusters: int, *, tries: int = 10, seed: int = 0) -> np.ndarray:
    """Centres of the best of several k-means fits (Spark ML, k-means||)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("vector").alias("features"))
    fits = [KMeans(k=clusters, seed=seed + i, initMode="k-means||").fit(data) for i in range(tries)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return np.array(best.clusterCenters())


def _nearest(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        norms = (centres * centres).sum(1)
        for batch in batches:
            n = batch.num_columns - 1
            near = np.round(norms - 2 * dense(batch.column(n), dim) @ centres.T, 12).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(near, pa.int32())], [*batch.schema.names[:n], "cluster"])

    return run


def assign(rows: DataFrame, centres: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and ``cluster``, the nearest centre, the lesser one at a tie; narrow, the centres being C x d numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centres, float))
    data = rows.select(*keep, "vector")
    fields = "".join(f"`{c}` {data.schema[c].dataType.simpleString()}, " for c in keep)
    return data.mapInArrow(_nearest(shared, centres.shape[1]), f"{fields}cluster int")


@dataclass
class Mixture:
    weight: np.ndarray
    mean: np.ndarray
    kappa: np.ndarray
    log_likelihood: float = float("nan")

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log weight plus log density of each row and component."""
        d = self.mean.shape[1]
        constant = np.array([vmf_log_norm_const(d, k) for k in self.kappa])
        return np.log(np.maximum(self.weight, 1e-300)) + constant + self.kappa * (x @ self.mean.T)

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        joint = self.log_joint(x)
        joint -= joint.max(1, keepdims=True)
        p = np.exp(joint)
        return p / p.sum(1, keepdims=True)

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        joint = self.log_joint(x)
        top = joint.max(1)
        return top + np.log(np.exp(joint - top[:, None]).sum(1))

    def sample(self, n: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Draws and their components."""
        p = self.weight if weight is None else weight
        which = rng.choice(len(p), n, p=p / p.sum())
        out = np.empty((n, self.mean.shape[1]))
        for c in np.unique(which):
            at = which == c
            out[at] = sample_vmf(self.mean[c], float(self.kappa[c]), int(at.sum()), rng)
        return out, which


def _expect(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        mass, sums, ll, n = np.zeros(len(model.weight)), np.zeros_like(model.mean), 0.0, 0
        for batch in batches:
            x = dense(batch.column(0), dim)
            g = model.responsibilities(x)
            mass += g.sum(0)
            sums += g.T @ x
            ll += float(model.log_prob(x).sum())
            n += len(x)
        k = len(mass)
        flat = np.c_[mass, sums, np.r_[ll, np.zeros(k - 1)], np.r_[n, np.zeros(k - 1)]]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(flat.tolist(), pa.list_(pa.float64()))], ["component", "parts"])

    return run


def fit_mixture(rows: DataFrame, components: int, *, dim: int = 64, rounds: int = 200, tolerance: float = 1e-6, tries: int = 10, seed: int = 0) -> Mixture:
    """EM from a k-means start. A round is one pass; tasks return sums by component, which are added before the driver.

    Components start with the masses and resultant lengths of the k-means clusters.
    """
    centres = fit_partition(rows, components, tries=tries, seed=seed)
    mean = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    held = assign(rows, centres, []).groupBy("cluster").count().collect()
    mass = np.zeros(components)
    for r in held:
        mass[r["cluster"]] = r["count"]
    # a cluster's centre is the mean of its unit vectors, so its length is their mean resultant
    model = Mixture(mass / max(mass.sum(), 1), mean, banerjee_kappa(np.linalg.norm(centres, axis=1), dim))
    spark, before = rows.sparkSession, -np.inf
    width = dim + 3
    for _ in range(rounds):
        parts = rows.select("vector").mapInArrow(_expect(spark.sparkContext.broadcast(model), dim), "component int, parts array<double>")
        added = parts.select("component", *[F.col("parts")[i].alias(f"s{i}") for i in range(width)]).groupBy("component").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
        table = np.array([list(r)[1:] for r in added.orderBy("component").collect()])
        mass, sums, ll, n = table[:, 0], table[:, 1 : dim + 1], table[:, dim + 1].sum(), table[:, dim + 2].sum()
        length = np.linalg.norm(sums, axis=1)
        mean = np.where((length > 1e-12)[:, None], sums / np.maximum(length, 1e-12)[:, None], model.mean)
        kappa = banerjee_kappa(length / np.maximum(mass, 1e-12), dim)
        model = Mixture(np.maximum(mass, 1e-12) / max(n, 1), mean, kappa, ll / max(n, 1))
        if abs(ll / max(n, 1) - before) < tolerance:
            break
        before = ll / max(n, 1)
    return model


def _gamma(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.weight)
        for batch in batches:
            n = batch.num_columns - 1
            x = dense(batch.column(n), dim)
            take = pa.array(np.repeat(np.arange(len(x)), k))
            kept = [c.take(take) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.tile(np.arange(k, dtype=np.int32), len(x))), pa.array(model.responsibilities(x).ravel())], [*batch.schema.names[:n], "component", "gamma"]
            )

    return run


def responsibilities(rows: DataFrame, model: Mixture, keep: list[str]) -> DataFrame:
    """``keep, component, gamma`` of every row and component."""
    data = rows.select(*keep, "vector")
    fields = ", ".join(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in keep)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return data.mapInArrow(_gamma(shared, model.mean.shape[1]), f"{fields}, component int, gamma double")


def guarded_sample(model: Mixture, production: DataFrame, n: int, radius: float, *, weight: np.ndarray | None = None, exploring: set[int] = frozenset(), seed: int = 0, batches: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Draws whose nearest production vector is within ``radius`` in cosine, or whose component may explore.

    A batch of at least 8 draws is tested by the blocked join. Raises if no draw at all passes in ``batches`` batches.
    """
    from sievebench.operators.similarity import nearest_items

    spark, rng = production.sparkSession, np.random.default_rng(seed)
    found, which = np.zeros((0, model.mean.shape[1])), np.zeros(0, int)
    for _ in range(batches):
        if len(found) >= n:
            break
        draws, component = model.sample(max(4 * (n - len(found)), 8), rng, weight)
        asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draws)], "qid long, vector array<double>")
        near = {r["qid"]: r["score"] for r in nearest_items(asked, production, 1, dim=model.mean.shape[1]).collect()}
        good = np.array([near.get(i, -1) >= radius or int(component[i]) in exploring for i in range(len(draws))])
        found, which = np.r_[found, draws[good]], np.r_[which, component[good]]
    if not len(found) and n:
        raise RuntimeError("no draw is near production")
    return found[:n], which[:n]


def save_mixture(spark, model: Mixture, store, name: str) -> None:
    """A row for each component; ``store`` is an ``Artifacts`` folder."""
    rows = [(i, float(w), float(k), m.tolist(), model.log_likelihood) for i, (w, k, m) in enumerate(zip(model.weight, model.kappa, model.mean, strict=True))]
    store.save_table(name, spark.createDataFrame(rows, "component int, weight double, kappa double, mean array<double>, log_likelihood double").coalesce(1))


def load_mixture(spark, store, name: str) -> Mixture:
    rows = store.load_table(spark, name).orderBy("component").collect()
    return Mixture(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]), np.array([r["kappa"] for r in rows]), rows[0]["log_likelihood"])


def save_partition(spark, centres: np.ndarray, store, name: str) -> None:
    store.save_table(name, spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>").coalesce(1))


def load_partition(spark, store, name: str) -> np.ndarray:
    return np.array([r["centre"] for r in store.load_table(spark, name).orderBy("cluster").collect()])
