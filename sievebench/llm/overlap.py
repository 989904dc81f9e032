"""Chunks of texts and the join of their digests, exact for the overlap of words.

The *overlap* of two texts is shared / (words of one + words of the other - shared), a repeated word counting as often
as it occurs in both; a text without words overlaps with none.

A record is normalised to its words, a repeated word's occurrences being distinct, in one global order: words that
occur at most ``floor`` times in all texts (*cold*) by their hash, then the others (*hot*) by rising count. The list of
hot words is the only thing sent to all tasks; it holds at most ``HOT_BOUND`` words at any size, and counts cover all
texts. The normalised record is cut by content:

- a cold word is a chunk of its own;
- hot words are put in hash order and cut wherever the hash passes into another of ``m`` equal ranges, so the words in
  a range form a chunk. Whether there is a cut at a place depends on the words beside it alone, and a word that only one of
  two records has changes one chunk and leaves all others as they are.

Two records of overlap ``t`` and ``n`` words together have at most ``d = n - 2 ceil(n t / (1 + t))`` words that differ.
So of the cold chunks one of the first ``n - ceil(t n) + 1`` is shared, or else no cold word is, and then at most
``D = d - cold words of both`` hot words differ. Of ``C`` chunks of hot words at least ``C - D`` are then shared, and the
most telling of these (by the counts of its words) is among the first ``D + 1`` of both records in that order. A record
of ``h`` hot among ``n`` words knows that ``D`` is at most ``h / t - n``; it is cut at levels that serve ``D`` below 1, 2, 4
and so on with about a sixth more ranges, from the level that a partner can stop at to the one that serves its own
greatest ``D`` and has more chunks than that, and posts the first ones of each. Both records have the level at which the
first of them stops. Hence all pairs of enough overlap meet in a chunk, however long they are and whatever words are hot.

Posted chunks travel in blobs of plain arrays with one entry for each record and 10 bytes for each chunk. Where they
meet, pairs are tested by these bounds and by 320 bits, each the parity of the hot words whose hash falls on it: a
differing word changes one bit. A chunk that more than ``block`` records share is dealt to pairs of blocks.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievebench.llm.tokens import texts_of
from sievebench.session import materialise

HOT_BOUND = 1 << 16
FLOOR = 64
THRESHOLD = 0.7
BLOCK = 8192
#: Bytes of records and posted chunks that come to one task, about; of the members, pairs and words that it holds beside them at once.
PART_BYTES = 24 << 20
SLICE, PAIRS, WORDS = 1 << 17, 1 << 19, 1 << 19
#: Pairs of blocks that one task gets, about, so that a batch of them stays small.
BLOCK_PAIRS = 16
_WORD = re.compile(r"[^\W_]+")
_SPLIT = r"[^\p{L}\p{N}]+"
#: Occurrences of a hot word in a record that have numbers; further ones count as cold.
_AGAIN = 1 << 14
_RECORDS = 2048

_BITS = 320
_PARITIES = [f"s{i}" for i in range(_BITS // 64)]
RECORD = np.dtype([("bag", "<i8"), *((s, "<u8") for s in _PARITIES), ("n", "<i4"), ("c", "<i4")])
#: Places, bounds and lengths above 252 are stored as 252, which only lets more pairs through to the words.
POSTED = np.dtype([("chunk", "<u4"), ("rec", "<u2"), ("pos", "u1"), ("low", "u1"), ("len", "u1"), ("level", "u1")])
MEMBER = np.dtype([*RECORD.descr, ("side", "<i4"), ("pos", "<i4"), ("low", "<i4"), ("len", "<i4"), ("level", "<i4")])
_CLIP, _NONE, _COLD = 252, 254, 255


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


def hot_words(texts: DataFrame, column: str, floor: int = FLOOR, bound: int = HOT_BOUND) -> dict[str, int]:
    """Counts of the words that occur more than ``floor`` times in all texts, the ``bound`` most frequent at most.

    A word beyond the bound counts as cold, which costs time but loses nothing.
    """
    found = (
        texts.select(F.explode(F.split(F.lower(column), _SPLIT)).alias("word"))
        .groupBy("word")
        .count()
        .filter((F.col("count") > floor) & (F.col("word") != ""))
        .orderBy(F.desc("count"), "word")
        .limit(bound)
    )
    return {word: n for word, n in found.collect()}


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix of integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


class Words:
    """The words of records as numbers in the global order."""

    def __init__(self, hot: dict[str, int]) -> None:
        rising = sorted(hot, key=lambda w: (hot[w], w))
        self.rank = {w: i * _AGAIN for i, w in enumerate(rising)}
        counts = np.array([hot[w] for w in rising], np.float64)
        #: How telling a hot word is, in 64ths of a bit.
        self.weight = np.round(64 * np.log2(counts.sum() / np.maximum(counts, 1))).astype(np.int64) + 1 if len(counts) else np.ones(0, np.int64)

    def of(self, text: str | None) -> tuple[list[int], list[int]]:
        """Cold words as negative digests and hot ones as ``rank * 2**14 + occurrence``, both in order."""
        cold, hot, rank, digest = [], [], self.rank, xxhash.xxh3_64_intdigest
        for word, k in Counter(words(text)).items():
            first = rank.get(word)
            if first is None:
                cold.append(-(digest(word) >> 1) - 1)
                for again in range(1, k):
                    cold.append(-(digest(f"{word}\0{again}") >> 1) - 1)
            elif k == 1:
                hot.append(first)
            else:
                hot.extend(range(first, first + min(k, _AGAIN)))
                for again in range(_AGAIN, k):
                    cold.append(-(digest(f"{word}\0{again}") >> 1) - 1)
        cold.sort()
        hot.sort()
        return cold, hot


class _Ranks(dict):
    """Ranks of hot words; -1 for any other, which is noted in ``cold``."""

    def __init__(self, rank: dict[str, int]) -> None:
        super().__init__(rank)
        self.cold: list[str] = []

    def __missing__(self, word: str) -> int:
        self.cold.append(word)
        return -1


def _numbered(known: Words, ranks: _Ranks, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``known.of`` for many texts: cold and hot words, flat, and where those of each text end."""
    flat, ends, cold, cold_ends, digest = array("q"), [0], array("q"), [0], xxhash.xxh3_64_intdigest
    for text in texts:
        ranks.cold = []
        flat.extend(map(ranks.__getitem__, words(text)))
        ends.append(len(flat))
        if ranks.cold:
            own = []
            for word, k in Counter(ranks.cold).items():
                own.append(-(digest(word) >> 1) - 1)
                for again in range(1, k):
                    own.append(-(digest(f"{word}\0{again}") >> 1) - 1)
            own.sort()
            cold.extend(own)
        cold_ends.append(len(cold))
    rank = np.frombuffer(flat, np.int64)
    key = np.repeat(np.arange(len(texts)) << 32, np.diff(ends)) | rank // _AGAIN
    key = np.sort(key[rank >= 0])
    starts = _run_starts(key)
    again = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
    hot = (key & 0xFFFFFFFF) * _AGAIN + again
    hot_ends = np.searchsorted(key, np.arange(len(texts) + 1) << 32)
    cold, cold_ends = np.frombuffer(cold, np.int64), np.array(cold_ends)
    if len(again) and again.max() >= _AGAIN:  # a word has more occurrences than have numbers
        of = [known.of(text) for text in texts]
        cold, hot = (np.array([x for pair in of for x in pair[i]], np.int64) for i in (0, 1))
        cold_ends, hot_ends = (np.cumsum([0, *(len(pair[i]) for pair in of)]) for i in (0, 1))
    return cold, cold_ends, hot, hot_ends


def _sign_batches(hot, salted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kept columns, then text; the first kept column is the side, which has bags of its own if ``salted``."""

    def signed(known: Words, ranks: _Ranks, piece: pa.RecordBatch, texts: list[str | None], seen: set) -> pa.RecordBatch:
        n, digest, salts = piece.num_columns - 1, xxhash.xxh3_64_intdigest, {}
        cold, cold_ends, hots, hot_ends = _numbered(known, ranks, texts)
        bags, firsts, a, b = [], [], cold.tobytes(), hots.tobytes()
        at, to = (8 * cold_ends).tolist(), (8 * hot_ends).tolist()
        for i, side in enumerate(piece.column(0).to_pylist()):
            bag = None
            if at[i] < at[i + 1] or to[i] < to[i + 1]:
                if salted and side not in salts:
                    salts[side] = digest(repr(side))
                bag = digest(a[at[i] : at[i + 1]] + b[to[i] : to[i + 1]], salts[side] if salted else 0) >> 1
            bags.append(bag)
            firsts.append(bag is not None and (side, bag) not in seen)
            seen.add((side, bag))
        first, lists = np.array(firsts, bool), []
        for flat, ends, kind in ((cold, cold_ends, pa.int64()), (hots, hot_ends, pa.int32())):
            sizes = np.diff(ends)
            kept = pa.array(flat[np.repeat(first, sizes)], kind)
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(first, sizes, 0))], pa.int32()), kept))
        new = [pa.array(bags, pa.int64()), pa.array(firsts, pa.bool_()), *lists]
        return pa.RecordBatch.from_arrays([*piece.columns[:n], *new], [*piece.schema.names[:n], "bag", "first", "cold", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(hot.value)
        ranks = _Ranks(known.rank)
        for batch in batches:
            seen, texts, start, size = set(), [], 0, 0
            for text in texts_of(batch.column(batch.num_columns - 1)):
                texts.append(text)
                size += len(text) if text else 0
                if size >= 2 * WORDS:  # a word has a letter and what parts it from the next
                    yield signed(known, ranks, batch.slice(start, len(texts)), texts, seen)
                    start, texts, size = start + len(texts), [], 0
            yield signed(known, ranks, batch.slice(start), texts, seen)

    return run


def signatures(df: DataFrame, *, keep: list[str], text: str, hot: dict[str, int], salted: bool = False) -> DataFrame:
    """``keep`` columns, the side first, then ``bag, first, cold, hot``; ``bag`` is null for a text without words.

    Equal records have one bag, with ``salted`` for each side its own. Of rows of one side with one bag in a batch only the
    ``first`` carries words; where records meet, what is left of copies from other batches is dropped.
    """
    rows = df.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("__text"))
    made = T.StructType.fromDDL("bag long, first boolean, cold array<long>, hot array<int>")
    schema = T.StructType([*[rows.schema[c] for c in keep], *made.fields])
    return rows.mapInArrow(_sign_batches(df.sparkSession.sparkContext.broadcast(hot), salted), schema)


def differing(n: np.ndarray | int, t: Fraction):
    """The most words that differ between two records of ``n`` words together and overlap ``t``."""
    num, both = t.numerator, t.numerator + t.denominator
    return n - 2 * ((num * n + both - 1) // both)


def _run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def posted_chunks(cold: np.ndarray, n_cold: np.ndarray, hot: np.ndarray, n_hot: np.ndarray, weight: np.ndarray, t: Fraction) -> dict[str, np.ndarray]:
    """``rec, chunk, pos, low, len, level`` of the chunks that records post; words are flat, counts by record.

    ``pos`` is the place of a chunk of hot words among those of its level, from 1, and ``low`` the greatest ``D`` that the
    level before serves (``_NONE`` if the record has none); cold chunks have place 1, level 0 and ``low`` ``_COLD``.
    """
    n, num, den = n_cold + n_hot, t.numerator, t.denominator
    least = -(-num * n // den)
    of_cold = np.repeat(np.arange(len(n)), n_cold)
    place = np.arange(len(cold)) - np.repeat(np.cumsum(n_cold) - n_cold, n_cold)
    kept = place < (n - least + 1)[of_cold]
    out = {"rec": [of_cold[kept]], "chunk": [mixed(cold[kept], 1)]}
    ones = np.ones(int(kept.sum()), np.int64)
    out |= {"pos": [ones], "low": [ones * _COLD], "len": [ones], "level": [ones * 0]}

    most = n_hot * den // num - n  # the greatest D
    open_ = np.flatnonzero((n_hot > 0) & (most >= 0))
    begin = np.ceil(np.log2(np.minimum(n_cold, np.maximum(most, 0)) + 1)).astype(np.int64)  # a partner stops no earlier
    hashed = mixed(hot, 2)
    gain = weight[hot // _AGAIN] if len(hot) else np.zeros(0, np.int64)
    hot_start = np.cumsum(n_hot) - n_hot
    before = np.full(len(n), _NONE)
    level = 0
    while len(open_):
        now = open_[begin[open_] <= level]
        if len(now):
            serves = 1 << level
            m = serves + serves // 6
            size = n_hot[now]
            at = np.repeat(hot_start[now] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            who = np.repeat(np.arange(len(now)), size)
            h = hashed[at]
            range_ = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(who * m + range_)  # normalised record in hash order, cut at the ranges
            key = (who * m + range_)[order]
            starts = _run_starts(key)
            with np.errstate(over="ignore"):
                digest = mixed(np.add.reduceat(mixed(h[order], 3), starts), 16 + level)
            told = np.add.reduceat(gain[at][order], starts)
            length = np.diff(np.r_[starts, len(key)])
            owner = key[starts] // m
            rank = (1 << 24) - 1 - np.minimum(told, (1 << 24) - 1)  # by record, the most telling first, then by digest
            order = np.argsort(owner.astype(np.uint64) << np.uint64(52) | rank.astype(np.uint64) << np.uint64(28) | digest >> np.uint64(36))
            owner, digest, length = owner[order], digest[order], length[order]
            first = _run_starts(owner)
            chunks = np.diff(np.r_[first, len(owner)])
            pos = np.arange(len(owner)) - np.repeat(first, chunks) + 1
            rec = now[owner]
            good = pos <= np.minimum(serves, most[rec] + 1)
            out["rec"].append(rec[good])
            out["chunk"].append(digest[good])
            out["pos"].append(pos[good])
            out["low"].append(before[rec[good]])
            out["len"].append(length[good])
            out["level"].append(np.full(int(good.sum()), level + 1))
            served = np.minimum(chunks, serves) - 1
            before[now] = np.minimum(served, _CLIP)
            open_ = np.setdiff1d(open_, now[served >= most[now]], assume_unique=True)
        level += 1
    return {k: np.concatenate(v) for k, v in out.items()}


def parities(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """64-bit words for each record: the parities of its hot words by ``_BITS`` hash values."""
    bit = ((mixed(flat, 4) >> np.uint64(32)) * np.uint64(_BITS) >> np.uint64(32)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(counts)), counts) * _BITS + bit, minlength=_BITS * len(counts)).reshape(-1, _BITS) & 1
    packed = np.packbits(odd.astype(np.uint8), axis=1).view("<u8")
    return [packed[:, i] for i in range(len(_PARITIES))]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and sizes of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def _deal(hot, t: Fraction, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``side, bag, cold, hot, salt`` become blobs of records and posted chunks for each part of the chunk digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = Words(hot.value).weight
        for whole in batches:
            for start in range(0, whole.num_rows, _RECORDS):
                batch = whole.slice(start, _RECORDS)
                (cold, n_cold), (warm, n_hot) = _lists(batch.column(2)), _lists(batch.column(3))
                warm = warm.astype(np.int64)
                posted = posted_chunks(cold, n_cold, warm, n_hot, weight, t)
                posted["chunk"] ^= mixed(batch.column(4).to_numpy(), 7)[posted["rec"]]
                records = np.zeros(len(n_cold), RECORD)
                for name, bits in zip(_PARITIES, parities(warm, n_hot), strict=True):
                    records[name] = bits
                records["bag"] = batch.column(1).to_numpy()
                records["n"], records["c"] = n_cold + n_hot, n_cold * 2 + batch.column(0).to_numpy()
                part = ((posted["chunk"] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                own = part * len(n_cold) + posted["rec"]
                order = np.argsort(own, kind="stable")
                own, part = own[order], part[order]
                firsts = _run_starts(own)  # of a record in a part
                starts = _run_starts(part)
                heads = np.searchsorted(firsts, starts)
                travelling = records[posted["rec"][order[firsts]]]
                rows = np.zeros(len(own), POSTED)
                rows["chunk"] = posted["chunk"][order] & np.uint64(0xFFFFFFFF)
                place = np.searchsorted(firsts, np.arange(len(own)), side="right") - 1
                rows["rec"] = place - np.repeat(heads, np.diff(np.r_[starts, len(own)]))
                rows["pos"], rows["len"] = np.minimum(posted["pos"][order], _CLIP), np.minimum(posted["len"][order], _CLIP)
                rows["low"], rows["level"] = posted["low"][order], posted["level"][order]
                blobs = [
                    np.array([b - a], "<u4").tobytes() + travelling[a:b].tobytes() + rows[low:high].tobytes()
                    for a, b, low, high in zip(heads, np.r_[heads[1:], len(firsts)], starts, np.r_[starts[1:], len(own)], strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


def pair_ok(a: np.ndarray, b: np.ndarray, m: dict[str, np.ndarray], most: np.ndarray, cross: bool) -> np.ndarray:
    """Which members ``m[a]``, ``m[b]`` of one chunk can be a pair of enough overlap that isn't found at a level before.

    ``most`` has the most words that can differ between records of so many words together.
    """
    n, own, place, low = m["n"], m["own"], m["place"], m["low"]
    hot_d = most[n[a] + n[b]] - own[a] - own[b]
    at = np.flatnonzero((hot_d >= place[a]) & (hot_d >= place[b]))
    a_, b_, hot_d = a[at], b[at], hot_d[at]
    before = np.maximum(low[a_], low[b_])
    good = (before >= _NONE) | (hot_d > before)
    good &= (m["side"][a_] != m["side"][b_]) if cross else (m["bag"][a_] != m["bag"][b_])
    at, hot_d = at[good], hot_d[good]
    apart = np.zeros(len(at), np.int64)
    for s in _PARITIES:
        apart += np.bitwise_count(m[s][a[at]] ^ m[s][b[at]])
        near = apart <= hot_d
        at, apart, hot_d = at[near], apart[near], hot_d[near]
    return at


def _columns(members: np.ndarray, t: Fraction) -> dict[str, np.ndarray]:
    """Columns of members, and what each adds to ``D`` and needs ``D`` to be; members without a level before come first."""
    m = {k: np.ascontiguousarray(members[k]) for k in members.dtype.names}
    m["own"] = np.where(m["low"] == _COLD, 0, m["c"]).astype(np.int32)  # words that differ for certain
    m["place"] = (m["pos"] - 1).astype(np.int32)
    m["adds"] = m["n"] * float((1 - t) / (1 + t)) - m["c"]
    m["needs"] = np.where(m["low"] >= _NONE, -np.inf, np.maximum(m["pos"] - 1, m["low"] + 1) - 1e-6)
    return m


def _most_table(m: dict[str, np.ndarray], t: Fraction) -> np.ndarray:
    return differing(np.arange(2 * int(m["n"].max(initial=0)) + 1), t).astype(np.int32)


def _in_order(members: np.ndarray, group: np.ndarray, t: Fraction) -> np.ndarray:
    """The order by group, in it those without a level before first, then by falling share in ``D``."""
    return np.lexsort((members["c"] - members["n"] * float((1 - t) / (1 + t)), members["low"] < _NONE, group))


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def _pairs_within(group: np.ndarray, m: dict[str, np.ndarray], t: Fraction, cross: bool) -> Pairs:
    """Places of the pairs within groups, which are in order: a member is left when those that follow add too little to its ``D``."""
    most, adds = _most_table(m, t), m["adds"]
    starts = _run_starts(group)
    sizes = np.diff(np.r_[starts, len(group)])
    stop = np.repeat(starts + sizes, sizes)
    # members with a level before stand last in their group, by falling share: there the last one that adds enough is sought
    later = np.flatnonzero(np.isfinite(m["needs"]))
    if len(later):
        top, bound = adds[later].max(), adds[later].min() - 1
        base = np.repeat(np.arange(len(starts)) * (top - bound + 2), sizes)
        key = base.copy()
        key[later] += 1 + top - adds[later]
        wants = np.clip(m["needs"][later] - adds[later], bound, top + 0.5)
        reach = np.searchsorted(key, base[later] + 1 + top - wants + 1e-3, side="right")  # a few more do no harm
        stop[later] = np.minimum(stop[later], reach)
    n = np.maximum(stop - np.arange(1, len(group) + 1), 0)
    upto = np.cumsum(n)
    cuts = np.r_[0, np.flatnonzero(np.diff(upto >> 16) > 0) + 1, len(group)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        some = n[low:high]
        total = int(some.sum())
        if not total:
            continue
        a = np.repeat(np.arange(low, high), some)
        b = a + 1 + np.arange(total) - np.repeat(np.cumsum(some) - some, some)
        at = pair_ok(a, b, m, most, cross)
        if len(at):
            yield a[at], b[at]


def _pairs_between(split: int, m: dict[str, np.ndarray], t: Fraction, cross: bool) -> Pairs:
    """Places of the pairs of a member before ``split`` and one from there on."""
    most, second = _most_table(m, t), np.arange(split, len(m["n"]))
    first = np.flatnonzero(m["adds"][:split] + m["adds"][split:].max() >= m["needs"][:split])
    for some in np.array_split(first, -(-len(first) // 8)) if len(first) else []:
        one, two = np.repeat(some, len(second)), np.tile(second, len(some))
        at = pair_ok(one, two, m, most, cross)
        if len(at):
            yield one[at], two[at]


def _group_pairs(group: np.ndarray, m: dict[str, np.ndarray], t: Fraction, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within groups at once."""
    found = list(_pairs_within(group, m, t, cross))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` things' component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


_FOUND = ["kind", "grp", "bag", "other", "level", "met", "blob"]
FOUND = "kind int, grp long, bag long, other long, level long, met long, blob binary"


def _found(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"kind": pa.int32(), "blob": pa.binary()}
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in _FOUND], _FOUND)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that leave the same components, one for each member but the least of each."""
    used, place = np.unique(np.r_[a, b], return_inverse=True)
    label = least_labels(len(used), place[: len(a)], place[len(a) :])
    held = label != np.arange(len(used))
    return used[label[held]], used[held]


def _pairs_out(pairs: Pairs, group: np.ndarray, m: dict[str, np.ndarray], cross: bool) -> Iterator[pa.RecordBatch]:
    """Pairs as they are across sides (with the words of the shared chunks), else the components of each group.

    About ``PAIRS`` pairs are held at once: across sides they go out then, else what they link is kept.
    """
    held, n, bound = [], 0, PAIRS

    def taken() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return a, b

    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= bound and cross:
            yield from _rows_out(*taken(), group, m, cross)
            n = 0
        elif n >= bound:
            held.append(_star(*taken()))
            n = len(held[0][0])
            bound = n + PAIRS
    if held:
        yield from _rows_out(*taken(), group, m, cross)


def _rows_out(a: np.ndarray, b: np.ndarray, group: np.ndarray, m: dict[str, np.ndarray], cross: bool) -> Iterator[pa.RecordBatch]:
    if cross:
        swap = m["side"][a] > m["side"][b]
        one, two = np.where(swap, b, a), np.where(swap, a, b)
        bag, other, level, met = m["bag"][one], m["bag"][two], m["level"][one], m["len"][one]
        order = np.lexsort((level, other, bag))
        bag, other, level, met = bag[order], other[order], level[order], met[order]
        starts = np.flatnonzero(np.r_[True, (bag[1:] != bag[:-1]) | (other[1:] != other[:-1]) | (level[1:] != level[:-1])])
        yield _found(0, bag=bag[starts], other=other[starts], level=level[starts], met=np.add.reduceat(met, starts))
        return
    used, place = np.unique(np.r_[a, b], return_inverse=True)
    label = used[least_labels(len(used), place[: len(a)], place[len(a) :])]
    with np.errstate(over="ignore"):
        grp = mixed(group[used], 5) ^ mixed(m["bag"][label], 6)
    yield _found(0, grp=grp.view(np.int64), bag=m["bag"][used])


def _chunks_met(blobs: list[tuple[np.ndarray, np.ndarray]], cross: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records, and of the chunks that two or more post (of both sides with ``cross``): the records, what they post, the sizes."""
    ends = np.cumsum([0] + [len(r) for r, _ in blobs])
    records = np.concatenate([r for r, _ in blobs])
    posted = np.concatenate([p for _, p in blobs])
    rec = posted["rec"] + np.repeat(ends[:-1], [len(p) for _, p in blobs])
    blobs.clear()  # what travelled isn't held any longer
    _, firsts, same = np.unique((records["bag"] << 1) | (records["c"] & 1), return_index=True, return_inverse=True)
    rec, records = same[rec], records[firsts]
    key = posted["chunk"].astype(np.uint64) << np.uint64(32) | rec.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    order = order[np.r_[True, key[1:] != key[:-1]]]
    del key
    chunk, rec = posted["chunk"][order], rec[order].astype(np.int32)
    starts = _run_starts(chunk)
    sizes = np.diff(np.r_[starts, len(chunk)])
    useful = sizes > 1
    if cross and len(starts):
        side = records["c"][rec] & 1
        useful &= np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)
    keep = np.repeat(useful, sizes)
    return records, rec[keep], posted[order[keep]], sizes[useful]


def _members(records: np.ndarray, rec: np.ndarray, posted: np.ndarray) -> np.ndarray:
    members = np.zeros(len(rec), MEMBER)
    for name in RECORD.names:
        members[name] = records[name][rec]
    for name in ("pos", "low", "len", "level"):
        members[name] = posted[name]
    members["side"], members["c"] = members["c"] & 1, members["c"] >> 1
    return members


def _meet(t: Fraction, block: int, cross: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All blobs of a part: what its chunks let meet (kind 0), and chunks of more than ``block`` records (kind 1) as pairs of blocks.

    Chunks are joined a slice of about ``SLICE`` members after another; of larger ones two blocks are copied at a time.
    """

    def together(part: int, blobs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        records, rec, posted, sizes = _chunks_met(blobs, cross)
        large = sizes > block
        number = np.arange(len(sizes)) + (part << 40)
        places, own = np.flatnonzero(np.repeat(~large, sizes)), np.cumsum(sizes[~large])
        cuts = own[:-1][np.diff(own // SLICE) > 0]  # between chunks
        groups = np.repeat(number[~large], sizes[~large])
        for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(places)], strict=True):
            members, group = _members(records, rec[places[low:high]], posted[places[low:high]]), groups[low:high]
            order = _in_order(members, group, t)
            group, m = group[order], _columns(members[order], t)
            yield from _pairs_out(_pairs_within(group, m, t, cross), group, m, cross)
        starts = np.cumsum(sizes) - sizes
        for g in np.flatnonzero(large):
            at = np.arange(starts[g], starts[g] + sizes[g])
            some = np.zeros(len(at), [("n", "<i4"), ("c", "<i4"), ("low", "<i4")])
            some["n"], some["c"], some["low"] = records["n"][rec[at]], records["c"][rec[at]] >> 1, posted["low"][at]
            blocks = np.array_split(at[_in_order(some, np.zeros(len(at), np.int8), t)], -(-len(at) // block))
            pairs = 0
            for i, x in enumerate(blocks):
                first = _members(records, rec[x], posted[x])
                for y in blocks[i:]:
                    both = first if y is x else np.concatenate([first, _members(records, rec[y], posted[y])])
                    yield _found(1, grp=np.array([number[g]]), other=np.array([pairs]), met=np.array([len(x)]), blob=[both.tobytes()])
                    pairs += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = blob.as_buffer()
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                by_part.setdefault(part, []).append((np.frombuffer(raw, RECORD, n, 4), np.frombuffer(raw, POSTED, -1, 4 + n * RECORD.itemsize)))
            batch = blob = raw = None
        for part in list(by_part):
            yield from together(part, by_part.pop(part))

    return run


def _meet_blocks(t: Fraction, cross: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of blocks, one row each: pairs within the block, if it is one, or between the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, split, blob in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(6), strict=True):
                m = _columns(np.frombuffer(blob.as_buffer(), MEMBER), t)
                group = np.full(len(m["n"]), grp)
                pairs = _pairs_within(group, m, t, cross) if split == len(group) else _pairs_between(split, m, t, cross)
                yield from _pairs_out(pairs, group, m, cross)

    return run


def parts_of(records: int, words: int, few: int) -> int:
    """How many parts leave about ``PART_BYTES`` to each.

    A record travels once to each part that holds a chunk of it: with few parts a head serves many chunks, with many hardly
    more than one, so bytes grow with the parts. A record posts about 0.9 chunks a word at most.
    """
    posted, parts = 0.9 * words / max(1, records) + 1, max(1, few)
    while True:
        heads = parts * (1 - (1 - 1 / parts) ** posted)
        wanted = math.ceil(records * (heads * RECORD.itemsize + posted * POSTED.itemsize) / PART_BYTES)
        if wanted <= parts:
            return parts
        parts = wanted


def met(signed: DataFrame, hot: dict[str, int], *, threshold: float = THRESHOLD, cross: str | None = None, apart: str | None = None, block: int | None = None) -> DataFrame:
    """What posted chunks let meet and the bounds don't rule out.

    With ``cross``, a boolean column of ``signed``: ``bag, other, met``, once for each pair of a false and a true record,
    ``met`` being the words of the shared chunks, cold ones and those of one level. Else ``grp, bag``: records linked by
    such pairs in one chunk. Records that differ in the column ``apart`` don't meet.
    """
    spark, t = signed.sparkSession, Fraction(str(threshold))
    firsts = signed.filter("first").select((F.col(cross) if cross else F.lit(0)).cast("int").alias("side"), "bag", "cold", "hot", (F.xxhash64(apart) if apart else F.lit(0).cast("long")).alias("salt"))
    n_records, n_words = firsts.agg(F.count(F.lit(1)), F.sum(F.size("cold") + F.size("hot"))).first()
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    parts = parts_of(n_records, n_words or 0, few)
    dealt = firsts.mapInArrow(_deal(spark.sparkContext.broadcast(hot), t, parts), "part int, blob binary")
    block = block or BLOCK
    found = materialise(dealt.repartitionById(parts, F.col("part")).mapInArrow(_meet(t, block, bool(cross)), FOUND), "met")
    large = found.filter("kind = 1")
    tasks = max(few, -(-large.count() // BLOCK_PAIRS))
    dealt = large.repartitionById(tasks, F.pmod(F.xxhash64("grp", "other"), F.lit(tasks)).cast("int"))
    every = found.filter("kind = 0").unionByName(dealt.mapInArrow(_meet_blocks(t, bool(cross)), FOUND))
    if not cross:
        return every.select("grp", "bag")
    lengths = every.groupBy("bag", "other", "level").agg(F.sum("met").alias("met"))
    cold = F.coalesce(F.max(F.when(F.col("level") == 0, F.col("met"))), F.lit(0))
    return lengths.groupBy("bag", "other").agg((cold + F.coalesce(F.max(F.when(F.col("level") > 0, F.col("met"))), F.lit(0))).alias("met"))


def words_of(signed: DataFrame) -> DataFrame:
    """``bag, words`` in the global order, each bag once."""
    once = signed.filter("first").groupBy("bag").agg(F.first("cold").alias("cold"), F.first("hot").alias("hot"))
    return once.select("bag", F.concat("cold", F.col("hot").cast("array<long>")).alias("words"))


def enough(shared: Column, n1: Column, n2: Column, threshold: float = THRESHOLD) -> Column:
    t = Fraction(str(threshold))
    return shared * t.denominator >= t.numerator * (n1 + n2 - shared)
