"""A small made-up corpus of support pages and queries, for trying out a run on text."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from sievebench.sources.worlds import stream

PER_DOCUMENT, SKEW = 5, 1.1
#: Topic: things, what is done to them, with what, and where.
TOPICS = {
    "invoices": (("the invoice run", "a credit note", "the tax table"), ("recalculates", "rejects", "archives"), ("open balances", "currency rounding", "late fees"), ("at month end", "for resellers")),
    "sign-in": (("the login page", "a session token", "the password policy"), ("refreshes", "revokes", "checks"), ("expired cookies", "second factors", "device names"), ("on shared computers", "after a reset")),
    "callbacks": (("the event queue", "a retry rule", "the signature check"), ("delivers", "delays", "drops"), ("order events", "duplicate messages", "large payloads"), ("under load", "behind a proxy")),
    "quotas": (("the rate limiter", "a burst allowance", "the daily quota"), ("throttles", "resets", "counts"), ("bulk imports", "search calls", "idle clients"), ("per region", "during migrations")),
    "records": (("the audit log", "a retention rule", "the consent form"), ("keeps", "erases", "exports"), ("access entries", "personal fields", "signed copies"), ("for auditors", "after seven years")),
    "libraries": (("the client library", "a typed wrapper", "the build plugin"), ("generates", "validates", "caches"), ("request models", "error codes", "page cursors"), ("in older runtimes", "without a network")),
    "charts": (("the dashboard", "a saved filter", "the colour scale"), ("groups", "hides", "compares"), ("weekly totals", "empty series", "outliers"), ("on small screens", "for shared links")),
    "downloads": (("the export job", "a column map", "the archive format"), ("splits", "compresses", "schedules"), ("wide tables", "nested fields", "old versions"), ("overnight", "to cold storage")),
}
SENTENCES = ("{Thing} {does} {what} {where}.", "If {what} fail, {thing} {does} them again {where}.", "{Where}, {thing} also {does} {what}.", "Use {thing} when {what} matter {where}.")
QUERIES = {
    "factoid": (0.5, ("what {does} {what}", "does {thing} work with {what}", "which limit applies to {what} {where}")),
    "howto": (0.3, ("how do i set up {thing} for {what}", "how to stop {thing} {where}")),
    "keyword": (0.2, ("{topic} {what}", "{thing} {where}")),
}


def capitalised(text: str) -> str:
    return text[:1].upper() + text[1:]


def _fill(template: str, topic: str, rng: np.random.Generator) -> str:
    thing, does, what, where = (pool[int(rng.integers(len(pool)))] for pool in TOPICS[topic])
    return template.format(thing=thing, Thing=capitalised(thing), does=does, what=what, where=where, Where=capitalised(where), topic=topic)


def sample_rows(chunks: int = 200, queries: int = 120, seed: int = 0) -> tuple[list[dict], list[dict]]:
    """Chunks spread evenly over the topics, five to a document; queries follow ``1 / rank ** SKEW`` and come in three kinds."""
    rng, names = stream(seed, "sample"), list(TOPICS)
    made, held = [], dict.fromkeys(names, 0)
    for i in range(chunks):
        topic = names[i * len(names) // chunks]
        text = " ".join(_fill(SENTENCES[int(rng.integers(len(SENTENCES)))], topic, rng) for _ in range(int(rng.integers(2, 5))))
        made.append({"text": text, "doc_id": f"{topic}-doc-{held[topic] // PER_DOCUMENT:02d}", "metadata": {"topic": topic}})
        held[topic] += 1
    share = 1 / np.arange(1, len(names) + 1) ** SKEW
    kinds, odds = list(QUERIES), np.array([v[0] for v in QUERIES.values()])
    asked = []
    for i in range(queries):
        topic, kind = names[int(rng.choice(len(names), p=share / share.sum()))], kinds[int(rng.choice(len(kinds), p=odds))]
        templates = QUERIES[kind][1]
        asked.append({"query_id": f"q{i:05d}", "text": _fill(templates[int(rng.integers(len(templates)))], topic, rng), "metadata": {"topic": topic, "query_type": kind}})
    return made, asked


def write_sample(folder: str, chunks: int = 200, queries: int = 120, seed: int = 0) -> None:
    """``chunks.jsonl`` and ``queries.jsonl``, byte for byte the same for one seed."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    for name, rows in zip(("chunks.jsonl", "queries.jsonl"), sample_rows(chunks, queries, seed), strict=True):
        (target / name).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
