"""Language of page texts by n-gram filters that answer for all languages at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.texts import BY, annotate

UNDETERMINED = "und"
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("n_grams", T.LongType())])
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter 3- and 4-grams of each text, and where each text's hashes start.

    Grams lie within a word; the places before and after it count as a character of their own.
    """
    folded = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(folded) + "\n").encode("utf-32-le"), dtype=np.uint32)
    bounds = np.cumsum([0, *(len(t) + 1 for t in folded)])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    at = np.concatenate([[0], np.cumsum(keep)])[bounds]  # kept characters before each text
    inside = letter[keep]
    codes = np.where(inside, codes[keep], np.uint32(32)).astype(np.uint64)
    hashes, places = [], []
    for n in (3, 4):
        if len(codes) < n:
            continue
        whole = inside[1:len(codes) - n + 2].copy()
        for k in range(2, n - 1):
            whole &= inside[k:len(codes) - n + 1 + k]
        start = np.flatnonzero(whole)
        h = np.full(len(start), n, dtype=np.uint64)
        for k in range(n):
            h += codes[start + k] * _FACTORS[k]
            h ^= h >> np.uint64(23)
        hashes.append(_mix(h))
        places.append(start)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # a gram belongs to the text that its first letter lies in
    owners = [np.searchsorted(at, p + 1, side="right") - 1 for p in places]
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _count_grams(batches, slots):
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found: dict[str, list[np.ndarray]] = {}
        for at in range(0, len(texts), 256):
            h, starts = grams(texts[at:at + 256])
            for k in range(len(starts) - 1):
                found.setdefault(langs[at + k], []).append(np.unique(h[starts[k]:starts[k + 1]]))
        for lang, parts in found.items():
            value, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n, pa.int64())],
                                             names=["lang", "gram", "pages"])


class GramFilters:
    """One table of slots; each holds a bit for every language whose n-grams fall there."""

    def __init__(self, languages: list[str], table: np.ndarray, usual: str | None):
        self.languages, self.table, self.usual = languages, table, usual
        bits = [(table >> np.array(k, table.dtype)) & np.array(1, table.dtype) for k in range(len(languages))]
        # two slots a gram: the chance that a gram unknown to a language finds both taken
        self.wrong = np.array([float(b.mean()) ** 2 for b in bits])

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.table) - 1)
        return self.table[(h & size).astype(np.int64)] & self.table[((h >> np.uint64(32)) & size).astype(np.int64)]

    def decide(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        h, starts = grams(texts)
        n = np.diff(starts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), n
        found = self.languages_of(h)
        counts = np.empty((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            hit = np.concatenate([[0], np.cumsum((found >> np.array(k, found.dtype)) & np.array(1, found.dtype), dtype=np.int64)])
            counts[k] = hit[starts[1:]] - hit[starts[:-1]]
        # of n grams, n * wrong are found by chance
        known = np.clip((counts - n * self.wrong[:, None]) / (1 - np.minimum(self.wrong, 0.999))[:, None], 0, None)
        best = known.argmax(axis=0)
        top = known[best, np.arange(len(texts))]
        names = [UNDETERMINED if not g else self.languages[b] if t > 0 else self.usual for b, t, g in zip(best, top, n)]
        return names, np.clip(top / np.maximum(n, 1), 0, 1), n


def learn_filters(examples: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 2000, slot_bits: int = 21,
                  min_share: float = 0.002) -> GramFilters:
    """Filters of every language of the labelled pages.

    A sample of about ``per_language`` pages of each language is read whole (chosen by a hash of the text).
    A gram enters the filter of a language if at least two of its pages and ``min_share`` of them hold it.
    The table has 2 ** ``slot_bits`` slots, whatever the corpus holds; at most 64 languages fit.
    """
    labelled = examples.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("more than 64 languages: join rare labels first")
    if not sizes:
        return GramFilters([], np.zeros(1 << slot_bits, np.uint8), None)
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, per_language / sizes[l]))])[F.col("lang")]
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * float(1 << 30))
    pages = F.create_map(*[F.lit(x) for l in languages for x in (l, min(sizes[l], per_language))])[F.col("lang")]
    size = (1 << slot_bits) - 1
    kept = (sample.mapInArrow(partial(_count_grams, slots=size), "lang string, gram bigint, pages bigint")
            .groupBy("lang", "gram").agg(F.sum("pages").alias("pages"))
            .where((F.col("pages") >= F.least(F.lit(2), pages)) & (F.col("pages") >= F.lit(min_share) * pages)))
    bit = F.create_map(*[F.lit(x) for k, l in enumerate(languages) for x in (l, int(np.array(1 << k, np.uint64).view(np.int64)))])[F.col("lang")]
    slots = (kept.select(bit.alias("bit"), F.explode(F.array(F.col("gram").bitwiseAND(size), F.shiftrightunsigned("gram", 32).bitwiseAND(size))).alias("slot"))
             .groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas())  # a row for each slot at most
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros(1 << slot_bits, dtype=kind)
    table[slots["slot"].to_numpy(np.int64)] = slots["bits"].to_numpy(np.int64).view(np.uint64).astype(kind)
    return GramFilters(languages, table, max(languages, key=lambda l: sizes[l]))


def _label(texts, filters):
    names, score, n = filters.decide(texts)
    return [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(n.astype(np.int64))]


def page_language(pages: DataFrame, filters: GramFilters, text: str = "text", by: Sequence[str] = BY, carry: Sequence[str] = ()) -> DataFrame:
    """The language of every page text: which language's filter knows most of its n-grams.

    Each n-gram looks up which languages hold it; the counts of each language are corrected for hits by
    chance. Gives ``by``, ``carry``, ``lang_pred``, ``score`` (share of the page's grams that the language knows,
    0 to 1) and ``n_grams``. Null texts and texts without a letter give ``und`` and 0; a text none of whose
    grams is known gives the most frequent label and 0; equal counts give the first name. No labels at all
    give ``und`` everywhere. Repeated rows stay; other columns are left out unless carried.
    """
    return annotate(pages, [*by, *carry], text, FIELDS, partial(_label, filters=filters))


def accepted(labelled: DataFrame, languages: Sequence[str] | None = None, least: float = 0.2) -> DataFrame:
    """Pages whose language was recognised (and is wanted, if ``languages`` are named)."""
    wanted = F.lit(True) if languages is None else F.col("lang_pred").isin(*languages)
    return labelled.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least) & wanted)
