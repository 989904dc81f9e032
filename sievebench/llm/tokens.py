"""Encoding texts with a public byte-level BPE by tiktoken from a local rank file.

Long texts are cut first at positions where the pre-tokenising pattern always ends a piece (before white space that
follows something else, and between a letter and a digit), so the ids are those of the whole text while no call has to
scan more than a bounded stretch, as far as the text has such positions.

Null and empty texts have the empty list. Malformed UTF-8 is read with replacement characters.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern published with the vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STRETCH = 1 << 16

_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@functools.lru_cache(maxsize=4)
def encoding(path: str = RANK_FILE):
    """The tokenizer of a rank file, once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only where the pattern always ends a piece."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, path: str = RANK_FILE) -> list[int]:
    """The ids of one text, special-token strings being ordinary text."""
    if not text:
        return []
    bpe = encoding(path)
    if len(text) <= STRETCH:
        return bpe.encode_ordinary(text)
    return [i for part in stretches(text) for i in bpe.encode_ordinary(part)]


def decode(ids: list[int], path: str = RANK_FILE) -> str:
    """The text of ids by way of raw bytes, so a character whose bytes lie in several tokens comes out whole."""
    return encoding(path).decode_bytes(list(ids)).decode("utf-8", errors="replace")


def texts_of(column: pa.Array) -> list[str | None]:
    """Strings of a binary or string column, malformed bytes replaced."""
    return [x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in column.to_pylist()]


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            lists = [encode(x, path) for x in texts_of(batch.column(n))]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], ids], [*batch.schema.names[:n], "ids"])

    return run


def token_ids(df: DataFrame, *, keep: list[str], text: str = "text", path: str = RANK_FILE) -> DataFrame:
    """``keep`` columns and ``ids``, one row for each input row; a narrow operation without any shuffle."""
    rows = df.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encoder(path), schema)
