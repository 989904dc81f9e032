"""Embedding stores, artifacts with a checked manifest, and transcripts."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.functions.text import canonical_json
from sievebench.operators.dedup import first_by


class EmbeddingTable:
    """An append-only parquet table ``id, embedding``; duplicate ids, unknown ids and other sizes are errors."""

    def __init__(self, spark: SparkSession, path: str, dim: int) -> None:
        self.spark, self.path, self.dim = spark, path, dim

    def read(self) -> DataFrame:
        if "://" not in self.path and not Path(self.path).exists():
            return self.spark.createDataFrame([], "id string, embedding array<float>")
        return self.spark.read.schema("id string, embedding array<float>").parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        new = rows.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        bad = new.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim).limit(1).count()
        twice = new.groupBy("id").count().filter("count > 1").limit(1).count()
        known = new.join(self.read(), "id", "left_semi").limit(1).count()
        if bad or twice or known:
            raise ValueError("wrong size" if bad else "an id occurs twice" if twice else "an id is stored already")
        new.write.mode("append").parquet(self.path)

    def upsert(self, rows: DataFrame) -> None:
        """Adds the rows whose ids aren't stored, the first of each id by ``ord``."""
        missing = missing_ids(first_by(rows.select("ord", "id", "embedding"), "id"), self.read())
        missing.select("id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(self.path)

    def get(self, ids: DataFrame) -> DataFrame:
        """``ord, id, embedding`` of ``ord, id``; an unknown id raises when the rows are read."""
        joined = ids.select("ord", "id").join(self.read(), "id", "left")
        checked = F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no embedding of "), F.coalesce("id", F.lit("null"))))).otherwise(F.col("embedding"))
        return joined.select("ord", "id", checked.alias("embedding"))


def missing_ids(wanted: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    return wanted.join(stored.select(key), key, "left_anti")


def fetch_vectors(wanted: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The stored rows of the wanted ids, each once; unknown and null ids have none."""
    return stored.join(wanted.select(key).distinct(), key, "left_semi")


class VectorStore:
    """What a cache of embeddings needs of a store: the vectors of the ids it holds, and to add or replace some."""

    location: str

    def fetch_vectors(self, ids: DataFrame) -> DataFrame:
        """``id, embedding`` of those of ``id`` that are held."""
        raise NotImplementedError

    def store_vectors(self, rows: DataFrame, metadata: dict[str, str] | None = None) -> None:
        """``id, embedding, document``: new ids are added, known ones replaced."""
        raise NotImplementedError


class ParquetStore(VectorStore):
    """A store in a folder of numbered versions; a version is whole before it counts, so a lost job leaves the old one."""

    def __init__(self, spark: SparkSession, location: str, dim: int) -> None:
        self.spark, self.location, self.dim = spark, location, dim

    def _versions(self) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.location)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        names = [(x.getPath().getName(), x.getPath()) for x in fs.listStatus(place)]
        done = [n for n, p in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame:
        versions, schema = self._versions(), "id string, embedding array<float>, document string, metadata map<string,string>"
        return self.spark.read.schema(schema).parquet(f"{self.location}/v{versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def fetch_vectors(self, ids: DataFrame) -> DataFrame:
        return fetch_vectors(ids, self.read()).select("id", "embedding")

    def store_vectors(self, rows: DataFrame, metadata: dict[str, str] | None = None) -> None:
        pairs = [F.lit(x) for pair in sorted((metadata or {}).items()) for x in pair]
        extra = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
        size = F.when(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim, F.raise_error(F.concat(F.lit("wrong size: "), "id"))).otherwise(F.col("embedding"))
        new = rows.dropDuplicates(["id"]).select("id", size.cast("array<float>").alias("embedding"), "document", extra.alias("metadata"))
        kept = self.read().join(new.select("id"), "id", "left_anti")
        at = (self._versions() or [0])[-1] + 1
        kept.unionByName(new).write.parquet(f"{self.location}/v{at}")


def cached_vectors(rows: DataFrame, store: VectorStore, embed, *, id_: str = "id", text: str = "text", batch: int = 500) -> DataFrame:
    """``rows`` with ``embedding``: of each different id once, from the store where it is held, else embedded and stored.

    ``embed`` adds ``embedding`` to ``id, text``; ``batch`` is how many texts a call of a model behind it should take.
    """
    distinct = rows.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])
    known = store.fetch_vectors(distinct.select("id"))
    missing = distinct.join(known.select("id"), "id", "left_anti")
    if missing.limit(1).count():
        store.store_vectors(embed(missing).select("id", "embedding", F.col("text").alias("document")))
    return rows.join(store.fetch_vectors(distinct.select("id")).withColumnRenamed("id", id_), id_, "left")


class Artifacts:
    """JSON and parquet artifacts in a folder, with a manifest of digests that is checked before anything is read."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.manifest = self.folder / "manifest.json"

    def _digests(self) -> dict[str, str]:
        return json.loads(self.manifest.read_text()) if self.manifest.exists() else {}

    def _record(self, name: str) -> None:
        self.manifest.write_text(canonical_json(self._digests() | {name: self.digest(name)}))

    def digest(self, name: str) -> str:
        at = self.folder / name
        files = [at] if at.is_file() else sorted(p for p in at.rglob("*") if p.is_file() and not p.name.startswith(("_", ".")))
        total = hashlib.sha256()
        for p in files:
            total.update(hashlib.sha256(p.read_bytes()).digest())
        return total.hexdigest()

    def check(self, name: str) -> Path:
        known = self._digests().get(name)
        if known is None:
            raise KeyError(f"{name} is not in the manifest")
        if known != self.digest(name):
            raise ValueError(f"{name} was changed after it was written")
        return self.folder / name

    def save_json(self, name: str, data: object) -> None:
        (self.folder / name).write_text(canonical_json(data), encoding="utf-8")
        self._record(name)

    def load_json(self, name: str) -> object:
        return json.loads(self.check(name).read_text(encoding="utf-8"))

    def save_table(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(str(self.folder / name))
        self._record(name)

    def load_table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(str(self.check(name)))


def transcript_key(system: str, user, kwargs: str = "{}"):
    """Key of a recorded exchange."""
    return F.sha2(F.concat_ws("|", F.lit(system), user, F.lit(kwargs)), 256)


def replay(requests: DataFrame, transcript: DataFrame) -> DataFrame:
    """Requests (``key, ...``) with the recorded ``response``; a key that wasn't recorded raises when read."""
    joined = requests.join(transcript.select("key", "response"), "key", "left")
    return joined.withColumn("response", F.when(F.col("response").isNull(), F.raise_error(F.concat(F.lit("not recorded: "), F.col("key")))).otherwise(F.col("response")))


def unrecorded(requests: DataFrame, transcript: DataFrame) -> DataFrame:
    return requests.join(transcript.select("key"), "key", "left_anti").dropDuplicates(["key"])
