"""Text, hashing and identity expressions; all run inside the JVM unless said otherwise."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it; a fixed value.
WHITE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(text: Column | str) -> Column:
    """The words of a text joined by single spaces; null stays null."""
    return F.trim(F.regexp_replace(_col(text), WHITE, " "))


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def content_hash(text: Column | str) -> Column:
    """Identity of a text alone."""
    return sha16(norm(text))


def _printed(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def chunk_id(text: Column | str, doc_id: Column | str, page: Column | str, bbox: Column | str | None = None) -> Column:
    """Identity of a text at a place; an absent page or box prints as ``None``, a box as a tuple of numbers."""
    box = F.lit("None") if bbox is None else F.coalesce(F.concat(F.lit("("), F.array_join(F.transform(_col(bbox), lambda x: x.cast("string")), ", "), F.lit(")")), F.lit("None"))
    return sha16(F.concat_ws("|", norm(text), _col(doc_id), _printed(_col(page)), box))


def record_id(query_id: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("rec-"), sha16(F.concat_ws("|", _col(query_id), _col(text))))


def oracle_record_id(query_id: Column | str) -> Column:
    return F.concat(F.lit("rec-oracle-"), sha16(_col(query_id)))


def stable_hash64(name: Column | str) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(_col(name), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_hex(seed: int, stream: str, *ids: Column | str) -> Column:
    """A hash that orders rows at random yet independently of partitioning; each stream gives its own order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[_col(i).cast("string") for i in ids]), 256)


def hash_uniform(seed: int, stream: str, *ids: Column | str) -> Column:
    """A number in [0, 1) of 52 bits from the same hash."""
    return F.conv(F.substring(hash_hex(seed, stream, *ids), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def stratum_key(stratum: Column | str) -> Column:
    """Sorted ``k=v`` joined by ``|``; null for a null map, empty for an empty one."""
    s = _col(stratum)
    return F.array_join(F.transform(F.array_sort(F.map_keys(s)), lambda k: F.concat(k, F.lit("="), F.coalesce(s[k], F.lit("")))), "|")


def space_words(text: Column | str) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(norm(text), " "), lambda w: w != "")


def word_ngrams(text: Column | str, n: int) -> Column:
    """Word n-grams joined by a space."""
    if n < 1:
        raise ValueError("n must be at least 1")
    words = space_words(text)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


INSTRUCTIONS = {
    # fixed values: the instruction of each query type
    "factoid": "Write one specific factual question answerable from the evidence.",
    "howto": "Write one how-do-I procedural question answerable from the evidence.",
    "keyword": "Write one terse keyword-style search (not a full sentence) targeting the evidence.",
}
DEFAULT_INSTRUCTION = "Write one realistic search query answerable from the evidence."
# fixed values: what the generator is told, around the evidence, the examples and the instruction
SYSTEM = "You write realistic search queries for a retrieval evaluation benchmark. Output only the query text."
OPENING = "You are given evidence from a knowledge base. Generate ONE search query.\n\n"
STYLE = "\nReal user queries from this system (match their length, register, and tone):\n"
ANSWER_FIRST = """

Work answer-first: (1) silently extract one specific claim or fact from the
evidence; (2) write the question a real user with that information need would
type into a search box.

Rules:
- Never use phrases like "according to the document" or mention the evidence,
  chunks, passage, or context.
- The query must be answerable from the evidence above and nothing else.
- Output ONLY the query text, nothing else.

"""
VARIANT = "Variant %d of %d - vary the angle or facet from other variants."
REVISE_OPENING = "REVISE_REQUEST\nYour previous query drifted from its retrieval target\n(cosine to target %s < required %s).\n\nPrevious query: "
REVISE_STYLE = "\nReal user queries (keep this register):\n"
REVISE_END = """

Rewrite the query to target the evidence more specifically while keeping the
exemplar register. Output ONLY the revised query text."""


def instruction(query_type: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])
    return F.coalesce(pairs[_col(query_type)], F.lit(DEFAULT_INSTRUCTION))


def _lines(texts: Column, mark: str) -> Column:
    """Each text on a line of its own after a mark; nothing for none."""
    return F.array_join(F.transform(texts, lambda t: F.concat(F.lit(mark), F.coalesce(t, F.lit("")), F.lit("\n"))), "")


def _evidence(chunk_texts: Column, exemplars: Column, style: str, told: Column) -> Column:
    shown = F.when(F.size(exemplars) > 0, F.concat(F.lit(style), _lines(exemplars, "- "))).otherwise(F.lit(""))
    return F.concat(F.lit("Evidence:\n"), _lines(chunk_texts, "[chunk] "), shown, F.lit("\nInstruction: "), told)


def prompt(chunk_texts: Column, exemplars: Column, told: Column, candidate: Column, candidates: int) -> Column:
    """A generation request: evidence, style examples (if any), instruction, the steps and rules, and the variant."""
    variant = F.format_string(VARIANT, (candidate + 1).cast("int"), F.lit(candidates))
    return F.concat(F.lit(OPENING), _evidence(chunk_texts, exemplars, STYLE, told), F.lit(ANSWER_FIRST), variant)


def fixed(number: Column, digits: int = 3) -> Column:
    """A number with so many digits after the point, rounded by its exact value as C's ``printf`` does (the JVM rounds its shortest decimal)."""

    @F.pandas_udf("string")
    def printed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else f"{x:.{digits}f}")

    return printed(number)


def revise_prompt(previous: Column, cosine: Column, required: float, chunk_texts: Column, exemplars: Column, told: Column) -> Column:
    """A request to rewrite a query that drifted from its target."""
    opening = F.format_string(REVISE_OPENING, fixed(cosine), F.lit(str(required)))
    return F.concat(opening, previous, F.lit("\n\n"), _evidence(chunk_texts, exemplars, REVISE_STYLE, told), F.lit(REVISE_END))


def capitalise(text: Column | str) -> Column:
    """The first character in upper case, the rest as it is."""
    c = _col(text)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def mock_reply(seed: int, system: str, user: Column) -> Column:
    """A deterministic reply that echoes the first twelve words of the evidence lines, else the last six words."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}|{system}|"), user), 256), 1, 8)
    lines = F.filter(F.split(user, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: x.startswith("[chunk]"))
    words = F.flatten(F.transform(lines, lambda x: F.filter(space_words(x), lambda w, i: i > 0)))
    every = space_words(user)
    last = F.slice(every, F.greatest(F.size(every) - 5, F.lit(1)), 6)
    said = F.when(F.size(words) > 0, F.slice(words, 1, 12)).otherwise(last)
    return F.concat(F.lit("what about "), F.array_join(said, " "), F.lit(" ("), digest, F.lit(")?"))


def transcript_digest(user: Column | str, system: str = SYSTEM, kwargs: str = "{}") -> Column:
    """Key of a recorded exchange."""
    return F.sha2(F.concat_ws("|", F.lit(system), _col(user), F.lit(kwargs)), 256)


def parse_verdict(raw: str | None) -> tuple[bool, str, float]:
    """Answerable, answer and confidence of the first JSON object in a reply; ``(False, "", 0.0)`` if unusable."""
    decoder, at = json.JSONDecoder(), (raw or "").find("{")
    while at != -1:
        try:
            data, _ = decoder.raw_decode(raw, at)
        except ValueError:
            at = raw.find("{", at + 1)
            continue
        try:
            return bool(data["answerable"]), str(data.get("answer", "")), float(data.get("confidence", 0.0))
        except (KeyError, TypeError, ValueError):
            return False, "", 0.0
    return False, "", 0.0


def verdict(reply: Column | str) -> Column:
    """``struct<answerable, answer, confidence>`` of judges' replies, by an Arrow batch UDF."""

    @F.pandas_udf("answerable boolean, answer string, confidence double")
    def parsed(replies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_verdict(x) for x in replies], columns=["answerable", "answer", "confidence"])

    return parsed(_col(reply))


def canonical_json(data: object) -> str:
    """Sorted keys, no spaces, non-ASCII kept."""
    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(config: object) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()
