"""Splitting oversized texts at natural boundaries by balanced targets.

A text is measured and cut in its normalised form: every run of white space is one character (a line feed where the run
has one, else a space) and the ends are bare. For a text above the limit the fewest pieces that can hold it with the
wanted overlap are counted, equal-length targets are placed, and each target snaps to the strongest boundary near it
(blank line, line, sentence, clause, word), the nearer one among equals. If any piece breaks the limit, one piece is
added and the targets are placed again; a text without boundaries is cut at the targets, not before a combining mark.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievebench.llm.tokens import texts_of

LIMIT, OVERLAP = 1000, 200
#: A run of white space of any Unicode kind, as Python's str.split sees it.
_RUN = re.compile(r"[\s\x1c-\x1f]+")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_SENTENCE_ENDS, _CLAUSE_ENDS, _CLOSERS = ".!?…。！？؟।", ",;:，；：、", "\"'”’)]»"


def normalise(text: str) -> tuple[str, list[int], dict[int, int]]:
    """The normalised text, the source offset of each of its characters, and boundary strengths by position.

    A boundary at ``i`` means that a piece may begin at normalised position ``i``.
    """
    out: list[str] = []
    source: list[int] = []
    strong: dict[int, int] = {}
    length = last = 0
    end = len(text.rstrip())
    for run in _RUN.finditer(text, 0, end):
        if run.start() > last:
            out.append(text[last : run.start()])
            source.extend(range(last, run.start()))
            length += run.start() - last
        last = run.end()
        if not length:
            continue
        breaks = len(_LINE.findall(run[0]))
        before = out[-1].rstrip(_CLOSERS)[-1:] or out[-1][-1:]
        strong[length + 1] = (
            5 if breaks > 1 else 4 if breaks else 3 if before in _SENTENCE_ENDS else 2 if before in _CLAUSE_ENDS else 1
        )
        out.append("\n" if breaks else " ")
        source.append(run.start())
        length += 1
    out.append(text[last:end])
    source.extend(range(last, end))
    return "".join(out), source, strong


def _hard(text: str, at: int, low: int) -> int:
    """``at`` or the place shortly before it that doesn't part a mark from its letter."""
    for i in range(at, max(low, at - 16), -1):
        if not unicodedata.combining(text[i]) and text[i] not in "\u200d\ufe0f" and text[i - 1] != "\u200d":
            return i
    return at


def _snap(text: str, strong: dict[int, int], target: int, low: int, high: int) -> int:
    """The strongest boundary in ``low..high``, the one nearest the target among equals."""
    best = max(((strong[i], -abs(i - target), i) for i in range(low, high + 1) if i in strong), default=None)
    return best[2] if best else _hard(text, min(target, high), low)


def cuts(text: str, strong: dict[int, int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of each piece in the normalised text; consecutive pieces overlap by at most ``overlap``."""
    length = len(text)
    if length <= limit:
        return [(0, length)] if length else []
    pieces = math.ceil((length - overlap) / (limit - overlap))
    while True:
        step = (length - overlap) / pieces
        slack = max(1, int(min(step / 4, limit / 5)))
        spans, start, end = [], 0, 0
        for k in range(1, pieces + 1):
            if k == pieces:
                new = length
            else:
                target = int(overlap + k * step)
                new = _snap(text, strong, target, max(end + 1, target - slack), min(length - 1, start + limit, target + slack))
            spans.append((start, new))
            if new - start > limit or new <= end:
                break
            end = new
            start = _snap_start(text, strong, new, overlap)
        else:
            return spans
        pieces += 1
        if step <= 1 or pieces > length:  # as short as can be: plain windows
            stride = limit - overlap
            return [(i, min(i + limit, length)) for i in range(0, max(1, length - overlap), stride)]


def _snap_start(text: str, strong: dict[int, int], end: int, overlap: int) -> int:
    """Where the next piece begins: the first strongest boundary of the last quarter of the allowed overlap."""
    if not overlap:
        return end
    low = end - overlap
    found = max(((strong[i] > 2, -i, i) for i in range(low, low + max(1, overlap // 4)) if i in strong), default=None)
    if found is None:
        found = min(((i, 0, i) for i in range(low, end) if i in strong), default=None)
        return found[2] if found and found[2] < end else max(low, _hard(text, low, low - 1) if low > 0 else 0)
    return found[2]


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """The pieces of one text; none for null, empty and blank ones, one for a text within the limit."""
    if not text:
        return []
    words = text.split()
    if len(words) - 1 + sum(map(len, words)) <= limit:
        if not words:
            return []
        flat = normalise(text)[0] if _LINE.search(text) else " ".join(words)
        at = len(text) - len(text.lstrip())
        whole = (0, 0, len(flat), at, len(text.rstrip()), 0, flat)
        return [dict(zip(("piece", "start", "end", "source_start", "source_end", "overlap", "text"), whole, strict=True))]
    flat, source, strong = normalise(text)
    out, before = [], 0
    for k, (a, b) in enumerate(cuts(flat, strong, limit, overlap)):
        shared = max(0, before - a) if k else 0
        out.append(
            {
                "piece": k,
                "start": a,
                "end": b,
                "source_start": source[a],
                "source_end": source[b - 1] + 1,
                "overlap": shared,
                "text": flat[a:b],
            }
        )
        before = b
    return out


def _splitter(limit: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["piece", "start", "end", "source_start", "source_end", "overlap", "text"]
        types = [*[pa.int32()] * 6, pa.string()]
        for batch in batches:
            n = batch.num_columns - 1
            rows, many, found = [], [], []
            for i, text in enumerate(texts_of(batch.column(n))):
                pieces = split_text(text, limit, overlap)
                rows += [i] * len(pieces)
                many += [len(pieces)] * len(pieces)
                found += pieces
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:n]]
            made = [pa.array([p[c] for p in found], t) for c, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(many, pa.int32()), *made], [*batch.schema.names[:n], "n_pieces", *[f"p_{x}" for x in names]]
            )

    return run


def split_texts(df: DataFrame, *, keep: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns and one row for each piece: ``n_pieces, p_piece, p_start, p_end, ...``; narrow, no shuffle.

    ``keep`` may hold any columns; those made here begin with ``p_`` (and ``n_pieces``), so give names that don't clash.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    rows = df.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("__text"))
    made = "n_pieces int, p_piece int, p_start int, p_end int, p_source_start int, p_source_end int, p_overlap int, p_text string"
    schema = T.StructType([*[rows.schema[c] for c in keep], *T.StructType.fromDDL(made).fields])
    return rows.mapInArrow(_splitter(limit, overlap), schema)
