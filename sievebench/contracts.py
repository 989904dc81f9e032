"""What can be plugged in: protocols of the models, registries of their factories, and optional dependencies."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


class Registry:
    """Factories by name; an unknown name is an error that lists the known ones, and so is a name taken twice."""

    def __init__(self, kind: str) -> None:
        self.kind, self.entries = kind, {}

    def register(self, name: str) -> Callable:
        def add(factory):
            if name in self.entries:
                raise ValueError(f"{self.kind} {name} is registered already")
            self.entries[name] = factory
            return factory

        return add

    def get(self, name: str):
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self.entries)}")
        return self.entries[name]

    def keys(self) -> list[str]:
        return sorted(self.entries)


STEPS, CHECKS, ARMS, STRATEGIES, OPTIMIZERS, DATASETS, EMBEDDERS, CHATS, JUDGES, RETRIEVERS = (
    Registry(k) for k in ("step", "check", "arm", "qrel strategy", "optimizer", "dataset", "embedder", "chat model", "judge", "retriever")
)


@runtime_checkable
class Embedder(Protocol):
    def encode(self, rows: DataFrame) -> DataFrame:
        """Adds ``vector`` to rows with ``text``."""
        ...


@runtime_checkable
class ChatModel(Protocol):
    def complete(self, asked: DataFrame) -> DataFrame:
        """``qid, text, vector`` of ``qid, prompt``."""
        ...


@runtime_checkable
class RelevanceJudge(Protocol):
    def answerable(self, query: Column, similarity: Column, evidence: bool) -> Column:
        """Whether a query is answerable, given its greatest similarity to the evidence, or without evidence."""
        ...


@runtime_checkable
class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``qid, item, score, rank`` of the k best items of ``qid, text, vector``."""
        ...


@runtime_checkable
class RetrievalSystem(Protocol):
    """A system to rank: a matrix by which both sides are multiplied (``ranking.make_zoo``)."""

    def __matmul__(self, other: Any) -> Any: ...


class PipelineStep:
    """A step of a run: made from its parameters, fitted on the resources, then it takes and gives the state.

    ``params`` are the parameters as given, so ``to_config`` and ``from_config`` are each other's inverse. A step reads the
    resources and never changes them.
    """

    name = ""

    def __init__(self, **params: Any) -> None:
        known = self.defaults()
        if unknown := sorted(set(params) - set(known)):
            raise ValueError(f"{self.name} has no parameters {unknown}; known: {sorted(known)}")
        self.given, self.params = dict(params), known | params

    def defaults(self) -> dict[str, Any]:
        return {}

    def fit(self, resources: Any) -> PipelineStep:
        return self

    def run(self, state: Any, resources: Any) -> Any:
        raise NotImplementedError

    def to_config(self) -> dict[str, Any]:
        return {"type": self.name, "params": dict(self.given)}

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> PipelineStep:
        return cls(**(config.get("params") or {}))


class GateCheck:
    """A check of the gate: ``qid, passed, score, reason, promoted`` of every candidate.

    Checks see the candidates alone, so all run in one pass each and their verdicts are combined in the configured order.
    One that is ``ordered`` depends on the candidates accepted before; it is settled after the others, whose verdicts say
    who can be accepted.
    """

    name, ordered = "", False

    def __init__(self, **params: Any) -> None:
        known = self.defaults()
        if unknown := sorted(set(params) - set(known)):
            raise ValueError(f"{self.name} has no parameters {unknown}; known: {sorted(known)}")
        self.given, self.params = dict(params), known | params

    def defaults(self) -> dict[str, Any]:
        return {}

    def check(self, candidates: DataFrame, resources: Any) -> DataFrame:
        raise NotImplementedError

    def to_config(self) -> dict[str, Any]:
        return dict(self.given)


def require_optional(module: object | None, feature: str, package: str) -> None:
    """An error that says what to install, if a module that is optional isn't there."""
    if module is None:
        raise ImportError(f"{feature} needs the package {package!r}, which is not installed")
