"""Splitting documents into overlapping windows, and gold chunks of annotated spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windows(text: str | None, window: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    """Half-open windows; each but the last ends at its last white space if that leaves room to advance, else hard."""
    spans, start, n = [], 0, len(text or "")
    while n and start + window < n:
        end = start + window
        space = next((i for i in range(end - 1, start, -1) if text[i].isspace()), -1)
        end = space if space - overlap > start else end
        spans.append((start, end))
        start = end - overlap
    return [*spans, (start, n)] if n else []


def _cut(window: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            texts = batch.column(n).to_pylist()
            found = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t, window, overlap)]
            kept = [c.take(pa.array([f[0] for f in found], pa.int64())) for c in batch.columns[:n]]
            made = [pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), pa.array([texts[i][a:b] for i, a, b in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:n], "start", "end", "text"])

    return run


def split_windows(df: DataFrame, *, keep: list[str], text: str = "text", window: int = 1000, overlap: int = 200) -> DataFrame:
    """``keep, start, end, text`` for every window; null and empty texts have none. Narrow."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and less than window")
    rows = df.select(*keep, F.col(text).alias("__text"))
    made = T.StructType.fromDDL("start int, end int, text string").fields
    return rows.mapInArrow(_cut(window, overlap), T.StructType([*[rows.schema[c] for c in keep], *made]))


def gold_chunks(spans: DataFrame, chunks: DataFrame, share: float = 0.5, chars: int = 200) -> DataFrame:
    """``query_id, chunk_id``: chunks of a span's document that cover half of it, or 200 characters if that is less."""
    s, c = spans.alias("s"), chunks.alias("c")
    covered = F.least("s.end", "c.end") - F.greatest("s.start", "c.start")
    enough = (covered > 0) & (covered >= F.least(share * (F.col("s.end") - F.col("s.start")), F.lit(chars)))
    return s.join(c, (F.col("s.doc_id") == F.col("c.doc_id")) & enough).select("s.query_id", "c.chunk_id").distinct()
