"""Subjects of documents by latent semantic analysis and seed centroids refined iteratively.

1. Words (letters only, three or more, accents folded) that occur in enough documents can be terms; their counts cover
   every document. Words of the labelled passages always are; of the others each language gives its most frequent, in
   turn, until there are ``VOCABULARY``.
2. A term weighs its inverse sentence frequency times how much it tells about the subject: the divergence of its
   subjects from the prior. That comes from the labelled passages at first, then also from the corpus, where a term in a
   sentence counts for the subjects of the *other* sentences of its document; so words that any document may have lose
   their weight, and words no passage has gain one.
3. The weighted, length-normalised document-term matrix gets a truncated singular value decomposition by subspace
   iteration, which each round starts from the directions of the one before: a task only returns the product of its
   documents with ``terms x rank`` numbers, summed by row.
4. A sentence is the weighted sum of its terms' directions. It concerns the subject of the nearest centroid if their
   cosine and the sentence's own weight suffice. A centroid of each subject and language starts from the passages and
   moves to the mean of its sentences, over ``ROUNDS`` rounds of steps 2 to 4.

Documents are read once as text, kept as word hashes by sentence and then as term numbers in the shared folder. Only sums
of bounded size, terms by subjects or terms by rank, reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievebench.llm.sums import ROWS, rows_of, total_rows
from sievebench.llm.tokens import texts_of
from sievebench.session import materialise

#: Terms at most, and words of labelled passages at most that are terms without having to be frequent.
VOCABULARY, PASSAGE_WORDS = 16_384, 8_192
LEAST_DOCUMENTS = 5
RANK = 64
ROUNDS = 3
COSINE = 0.5
WEIGHT = 0.75
#: Least divergence, as a share of the greatest possible, for a term to count.
TELLING = 0.12
PRIOR = 2.0
SEED_WEIGHT = 5.0
SHARE = 0.25
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]+|(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？।؟])")
_FLUSH = 200_000


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def sentences(text: str | None) -> list[list[str]]:
    """The terms of each sentence that has a word of letters; the list of one without terms is empty."""
    out = []
    plain = bool(text) and text.isascii()
    for part in _BREAK.split((text.lower() if plain else text) or ""):
        found = [w for w in _WORD.findall(part if plain else fold(part)) if w.isalpha()] if part else []
        if found:
            out.append([w for w in found if len(w) > 2])
    return out


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, language and text become word hashes by sentence; rows without sizes count the batch's words."""
    known: dict[str, int] = {}
    for batch in batches:
        sizes, ends, words, word_ends = [], [0], [], [0]
        for text in texts_of(batch.column(2)):
            for found in sentences(text):
                sizes.append(len(found))
                for word in found:
                    h = known.get(word)
                    if h is None:
                        h = known[word] = word_hash(word)
                    words.append(h)
            ends.append(len(sizes))
            word_ends.append(len(words))
        if len(known) > _FLUSH:
            known.clear()
        lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, t)) for e, v, t in ((ends, sizes, pa.int32()), (word_ends, words, pa.int64()))]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, *[pa.nulls(n, pa.int64())] * 3], _SPELLED)
        counts = _counted(batch.column(1), np.array(ends), np.array(sizes, np.int64), np.array(words, np.int64))
        m = len(counts[0])
        yield pa.RecordBatch.from_arrays([pa.nulls(m, batch.schema.field(0).type), counts[0], pa.nulls(m, lists[0].type), pa.nulls(m, lists[1].type), *counts[1:]], _SPELLED)


_SPELLED = ["key", "lang", "sizes", "words", "word", "n_sentences", "n_documents"]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Different numbers, rising; sorting whole numbers is far faster than hashing them."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _counted(langs: pa.Array, offsets: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> list[pa.Array]:
    """Language, word, and its sentences and documents; word 0 counts all sentences."""
    langs = langs.dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of_sentence = np.repeat(np.arange(len(codes)), np.diff(offsets))
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    names, term = np.unique(words, return_inverse=True)
    width, kinds = max(len(names), 1), len(langs.dictionary)
    own = _distinct(sentence * width + term)  # a word counts once in a sentence, and once in a document
    document = of_sentence[own // width] if len(own) else own
    by = np.bincount(codes[document] * width + own % width, minlength=kinds * width)
    pairs = _distinct(document * width + own % width)
    per = np.bincount(codes[pairs // width] * width + pairs % width, minlength=kinds * width)
    used = np.flatnonzero(by)
    total = np.bincount(codes[of_sentence], minlength=kinds)
    lang = np.r_[used // width, np.arange(kinds)].astype(np.int64)
    word = np.r_[names[used % width], np.zeros(kinds, np.int64)] if len(names) else np.zeros(kinds, np.int64)
    return [langs.dictionary.take(pa.array(lang)), pa.array(word, pa.int64()), pa.array(np.r_[by[used], total], pa.int64()), pa.array(np.r_[per[used], np.zeros(kinds, np.int64)], pa.int64())]


def vocabulary(spelled: DataFrame, passages: set[int], most: int = VOCABULARY, least: int = LEAST_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms, rising, and their inverse sentence frequencies.

    ``passages`` are hashes of the labelled passages' words, which come first; then languages take turns.
    """
    by_lang = spelled.filter("word IS NOT NULL").select("lang", "word", "n_sentences", "n_documents").repartition("word").groupBy("word", "lang").agg(F.sum("n_sentences").alias("s"), F.sum("n_documents").alias("d"))
    every = by_lang.groupBy("word").agg(F.sum("s").alias("sentences"), F.sum("d").alias("documents"), F.collect_list(F.struct("lang", "s")).alias("by"))
    every = materialise(every.filter((F.col("documents") >= least) | (F.col("word") == 0)), "words")
    total = every.filter("word = 0").agg(F.sum("sentences")).first()[0] or 0
    words = every.filter("word <> 0")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("s"), "word"))
    places = words.select("word", F.explode("by").alias("x")).select("word", "x.lang", "x.s").withColumn("place", place).filter(F.col("place") <= most).groupBy("word").agg(F.min("place").alias("place"))
    told = every.sparkSession.createDataFrame([(w,) for w in sorted(passages)], "word long").withColumn("told", F.lit(True))
    ranked = words.join(places, "word", "left").join(told, "word", "left").filter("place IS NOT NULL OR told")
    rows = ranked.orderBy(F.col("told").isNull(), F.col("place").asc_nulls_last(), F.desc("sentences"), "word").limit(most).select("word", "sentences").collect()
    rows.sort()
    return np.array([r["word"] for r in rows], np.int64), np.array([np.log(max(total, 1) / r["sentences"]) for r in rows], np.float64)


def _number(terms) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word hashes become numbers of terms, other words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            sizes = batch.column(1).values.to_numpy()[offsets[0] : offsets[-1]]
            words = batch.column(2).flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
            held = known[at] == words if len(known) else np.zeros(len(words), bool)
            sentence = np.repeat(np.arange(len(sizes)), sizes)[held]
            kept = np.bincount(sentence, minlength=len(sizes)).astype(np.int32)
            ends = (offsets - offsets[0]).astype(np.int32)
            before = np.r_[0, np.cumsum(kept)].astype(np.int32)
            arrays = [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(kept)),
                pa.ListArray.from_arrays(pa.array(before[ends]), pa.array(at[held].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "sizes", "terms"])

    return run


@dataclass
class Numbered:
    """Flat arrays of a batch of documents."""

    terms: np.ndarray
    sentence: np.ndarray  # of each term
    document: np.ndarray  # of each sentence
    n_sentences: int
    n_documents: int


def _flat(batch: pa.RecordBatch) -> Numbered:
    def parts(column) -> tuple[np.ndarray, np.ndarray]:
        offsets = column.offsets.to_numpy()
        return np.diff(offsets), column.values.to_numpy()[offsets[0] : offsets[-1]]

    per_document, sizes = parts(batch.column("sizes"))
    _, terms = parts(batch.column("terms"))
    return Numbered(
        terms, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(per_document)), per_document), len(sizes), len(per_document)
    )


@dataclass
class Model:
    """What tasks need: bounded by the vocabulary times rank."""

    weight: np.ndarray  # of each term
    active: np.ndarray  # place among the active terms, -1 for the others
    basis: np.ndarray  # active terms x rank
    direction: np.ndarray  # all terms x rank: weight times unit direction
    centroid: np.ndarray
    subject_of: np.ndarray  # of each centroid
    n_subjects: int


def _pooled(model: Model, flat: Numbered) -> np.ndarray:
    """Sums of the active terms' directions by sentence, one place of all sentences at a time."""
    used = model.active[flat.terms] >= 0
    terms, of = flat.terms[used], flat.sentence[used]
    out = np.zeros((flat.n_sentences, model.direction.shape[1]), np.float32)
    if len(terms):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place))
        for low, high in zip(np.r_[0, ends[:31]], ends[:32], strict=False):
            out[of[order[low:high]]] += model.direction[terms[order[low:high]]]
        if len(ends) > 32:
            rest = order[ends[31] :]
            np.add.at(out, of[rest], model.direction[terms[rest]])
    return out


def _assign(model: Model, flat: Numbered, cosine: float, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of each sentence, -1 for none, and the sentences' unit vectors."""
    x = _pooled(model, flat)
    norm = np.linalg.norm(x, axis=1)
    x /= np.maximum(norm, 1e-9)[:, None]
    score = x @ model.centroid.T
    best = score.argmax(1) if len(score) else np.zeros(0, np.int64)
    best[(norm <= weight) | (score[np.arange(len(best)), best] <= cosine)] = -1
    return best, x


def _matrix(model: Model, flat: Numbered, first: int, last: int) -> np.ndarray:
    """Rows ``first..last`` of the weighted, normalised document-term matrix over the active terms."""
    of = flat.document[flat.sentence] if len(flat.sentence) else np.zeros(0, np.int64)
    low, high = np.searchsorted(of, [first, last])
    place = model.active[flat.terms[low:high]]
    used = place >= 0
    width = len(model.basis)
    cells = (of[low:high][used] - first) * width + place[used]
    x = np.bincount(cells, minlength=(last - first) * width).reshape(last - first, width)
    x = np.log1p(x) * model.weight[model.active >= 0]
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]


def _multiply(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        out = np.zeros_like(model.basis)
        for batch in batches:
            flat = _flat(batch)
            for first in range(0, flat.n_documents, 256):
                x = _matrix(model, flat, first, min(first + 256, flat.n_documents))
                out += x.T @ (x @ model.basis)
        yield rows_of(0, out)

    return run


def _evidence(shared, cosine: float, weight: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Terms by subjects of the other sentences of their document; sums of the sentences of each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counts = np.zeros((len(model.weight), model.n_subjects))
        sums = np.zeros_like(model.centroid, np.float64)
        for batch in batches:
            flat = _flat(batch)
            best, x = _assign(model, flat, cosine, weight)
            got = np.flatnonzero(best >= 0)
            for group in range(len(sums)):
                sums[group] += x[best == group].sum(0)
            subject = model.subject_of[best[got]]
            cells = flat.document[got] * model.n_subjects + subject
            by_document = np.bincount(cells, minlength=flat.n_documents * model.n_subjects).astype(np.float64).reshape(-1, model.n_subjects)
            others = by_document[flat.document]
            others[got, subject] -= 1
            total = others.sum(1)
            others /= np.maximum(total, 1)[:, None]
            for s in range(model.n_subjects):
                counts[:, s] += np.bincount(flat.terms, others[flat.sentence, s], len(counts))
        yield rows_of(0, counts)
        yield rows_of(1, sums)

    return run


def _shares(shared, subjects: list[str], cosine: float, weight: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            flat = _flat(batch)
            best, _ = _assign(model, flat, cosine, weight)
            got = best >= 0
            counts = np.zeros((flat.n_documents, model.n_subjects), np.int64)
            np.add.at(counts, (flat.document[got], model.subject_of[best[got]]), 1)
            total = np.bincount(flat.document, minlength=flat.n_documents)
            rows, columns = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows)),
                    pa.array([subjects[i] for i in columns], pa.string()),
                    pa.array(counts[rows, columns], pa.int64()),
                    pa.array(total[rows], pa.int64()),
                ],
                ["key", "subject", "about", "sentences"],
            )

    return run


def _telling(counts: np.ndarray) -> np.ndarray:
    """How far the subjects of each term are from the prior, between 0 and 1."""
    prior = np.maximum(counts.sum(0), 1e-9)
    prior = prior / prior.sum()
    p = (counts + PRIOR * prior) / (counts.sum(1, keepdims=True) + PRIOR)
    kl = (p * np.log(np.maximum(p, 1e-12) / prior)).sum(1)
    out = np.clip(kl / np.log(max(2, counts.shape[1])), 0, 1)
    out[out < TELLING] = 0
    return out


def _nothing(numbered: DataFrame, key: str) -> DataFrame:
    none = F.lit(0).cast("long")
    return numbered.select(F.col("key").alias(key), F.lit("").alias("subject"), none.alias("about"), none.alias("sentences")).limit(0)


def document_subjects(
    documents: DataFrame,
    examples: DataFrame,
    *,
    key: str,
    text: str = "text",
    subject: str = "subject",
    lang: str = "lang",
    rank: int = RANK,
    rounds: int = ROUNDS,
    cosine: float = COSINE,
    weight: float = WEIGHT,
) -> DataFrame:
    """``key, subject, about, sentences``: how many of a document's sentences concern each subject, where any do.

    ``examples`` is a bounded table of labelled passages, read by the driver up to 100,000 rows; more is an error. Null,
    empty and wordless documents have no row. Repeated documents count as often as they occur.
    """
    spark = documents.sparkSession
    labelled = examples.select(subject, lang, text).limit(100_001).collect()
    if len(labelled) > 100_000:
        raise ValueError("more than 100,000 labelled passages")
    kind = documents.schema[key].dataType.simpleString()
    own = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in documents.columns else F.lit("")
    texts = documents.select(F.col(key).alias("key"), own.alias("lang"), F.col(text).cast("binary").alias("t"))
    spelled = materialise(texts.mapInArrow(_spell, f"key {kind}, lang string, sizes array<int>, words array<long>, word long, n_sentences long, n_documents long"), "spelled")
    told = Counter(word_hash(w) for r in labelled if r[0] is not None for s in sentences(r[2]) for w in s)
    terms, idf = vocabulary(spelled, {h for h, _ in sorted(told.items(), key=lambda x: (-x[1], x[0]))[:PASSAGE_WORDS]})
    known = {int(h): i for i, h in enumerate(terms)}
    numbered = spelled.filter("word IS NULL").select("key", "sizes", "words").mapInArrow(_number(spark.sparkContext.broadcast(terms)), f"key {kind}, sizes array<int>, terms array<int>")
    numbered = materialise(numbered, "numbered", old=spelled)
    groups = sorted({(r[0], r[1] or "") for r in labelled if r[0] is not None})
    subjects = sorted({g[0] for g in groups})
    subject_of = np.array([subjects.index(g[0]) for g in groups], np.int64)
    seeds = [(groups.index((r[0], r[1] or "")), [known[h] for w in s if (h := word_hash(w)) in known]) for r in labelled if r[0] is not None for s in sentences(r[2])]
    seed_counts = np.zeros((len(known), max(1, len(subjects))))
    for group, terms in seeds:
        np.add.at(seed_counts, (terms, subject_of[group]), 1)
    if not known or not groups:
        return _nothing(numbered, key)
    counts, sums, old, model = seed_counts, None, None, None
    for step in range(rounds):
        telling = _telling(counts)
        if step == 0:
            telling[counts.sum(1) < 2] = 0
        term_weight = idf * telling
        used = np.flatnonzero(term_weight > 0)
        if not len(used):
            break
        active = np.full(len(known), -1)
        active[used] = np.arange(len(used))
        width = min(rank, max(1, len(used)))
        basis = np.random.default_rng(7).standard_normal((len(used), width))
        if old is not None:
            basis = basis * 0.01 + old[used][:, :width]
        basis = np.linalg.qr(basis)[0] if len(used) else basis
        model = Model(term_weight, active, basis, np.zeros((len(known), width), np.float32), np.zeros((len(groups), width), np.float32), subject_of, len(subjects))
        for _ in range(2 if old is None else 1):
            product = total_rows(numbered.mapInArrow(_multiply(spark.sparkContext.broadcast(model)), ROWS), {0: basis.shape})[0]
            u, s, _ = np.linalg.svd(product, full_matrices=False)
            model.basis = u
        place = u * np.sqrt(s)
        place /= np.maximum(np.linalg.norm(place, axis=1), 1e-9)[:, None]
        old = np.zeros((len(known), width))
        old[used] = u
        model.direction[used] = (place * term_weight[used][:, None]).astype(np.float32)
        centroid = np.zeros((len(groups), width))
        for group, terms in seeds:
            v = model.direction[terms].sum(0) if terms else np.zeros(width)
            if (norm := np.linalg.norm(v)) > weight:
                centroid[group] += v / norm
        centroid /= np.maximum(np.linalg.norm(centroid, axis=1), 1e-9)[:, None]
        model.centroid = centroid.astype(np.float32)
        for _ in range(2 if step == rounds - 1 else 1):
            found = total_rows(
                numbered.mapInArrow(_evidence(spark.sparkContext.broadcast(model), cosine, weight), ROWS),
                {0: seed_counts.shape, 1: centroid.shape},
            )
            counts, sums = seed_counts + found[0], found[1] + SEED_WEIGHT * centroid
            model.centroid = (sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]).astype(np.float32)
    if model is None:
        return _nothing(numbered, key)
    final = spark.sparkContext.broadcast(model)
    return numbered.mapInArrow(_shares(final, subjects, cosine, weight), f"key {kind}, subject string, about long, sentences long").withColumnRenamed("key", key)


def composition(found: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents and sentences of each subject."""
    return found.groupBy("subject").agg(
        F.count_if(F.col("about") >= share * F.col("sentences")).alias("documents"), F.sum("about").alias("sentences")
    )
