"""Chat and embedding models behind an HTTP endpoint that speaks the common chat-completions and embeddings JSON.

Requests are made from the executors, a batch of rows at a time and again after a failure; an answer that never comes
fails the task, so Spark repeats it. The key is read on the executors from the environment variable that is named.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebench.contracts import CHATS, EMBEDDERS
from sievebench.functions.text import SYSTEM


def post(url: str, body: dict, key_env: str | None, timeout: float, tries: int, wait: float = 1.0) -> dict:
    """The JSON answer to a JSON request; errors of the server and of the network are tried again, others raise."""
    headers = {"Content-Type": "application/json"}
    if key_env:
        headers["Authorization"] = f"Bearer {os.environ[key_env]}"
    for attempt in range(tries):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), headers)  # noqa: S310 - the configuration names the endpoint
            with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if error.code < 500 and error.code != 429 or attempt == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == tries - 1:
                raise
        time.sleep(wait * 2**attempt)
    raise RuntimeError("no tries")


class _Remote:
    def __init__(self, base_url: str, model: str, *, api_key_env: str | None = None, timeout: float = 60.0, tries: int = 3, **options: Any) -> None:
        self.params = {"base_url": base_url, "model": model, "api_key_env": api_key_env, "timeout": timeout, "tries": tries} | options
        self.url, self.model, self.options = base_url.rstrip("/"), model, options
        self.call = (api_key_env, timeout, tries)

    def to_config(self) -> dict[str, Any]:
        return dict(self.params)


@CHATS.register("openai_compatible")
class RemoteChat(_Remote):
    def bind(self, bank, embedder, dim: int, seed: int) -> RemoteChat:
        self.embedder = embedder
        return self

    def complete(self, asked: DataFrame) -> DataFrame:
        url, model, options, call = f"{self.url}/chat/completions", self.model, self.options, self.call

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                said = []
                for prompt in pdf["prompt"]:
                    messages = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]
                    said.append(post(url, {"model": model, "messages": messages} | options, *call)["choices"][0]["message"]["content"].strip())
                yield pd.DataFrame({"qid": pdf["qid"], "text": said})

        from sievebench.session import materialise

        # written once, so that no answer is asked for twice
        texts = materialise(asked.select("qid", "prompt").mapInPandas(run, "qid string, text string"), "answers")
        return self.embedder.encode(texts).select("qid", "text", "vector")


@EMBEDDERS.register("http")
class RemoteEmbedder(_Remote):
    def bind(self, bank, dim: int, seed: int) -> RemoteEmbedder:
        return self

    def encode(self, rows: DataFrame) -> DataFrame:
        url, model, options, call = f"{self.url}/embeddings", self.model, self.options, self.call

        @F.pandas_udf("array<double>")
        def made(texts: pd.Series) -> pd.Series:
            known = texts.dropna().unique().tolist()
            found: dict[str, list[float]] = {}
            for at in range(0, len(known), 64):
                part = known[at : at + 64]
                data = post(url, {"model": model, "input": part} | options, *call)["data"]
                for item in data:
                    found[part[item["index"]]] = item["embedding"]
            return texts.map(lambda t: found.get(t))

        return rows.withColumn("vector", made("text"))
