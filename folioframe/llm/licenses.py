"""Short license notices in page texts, exact and with a few wrong letters."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioframe.llm.texts import BY, annotate

# Phrases that are looked for word by word, with their labels.
EXACT = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices that may hold wrong letters, with their labels; all in the words of ``words_of``.
NOTICES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()),
                     T.StructField("edits", T.IntegerType()), T.StructField("found", T.StringType())])
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN)),
])


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs of digits, letters a-z and characters beyond ASCII."""
    return WORD.findall((text or "").encode().lower())


def edits_of(notice: str) -> int:
    """A wrong letter for every ten characters."""
    return len(notice) // 10


def seeds_of(notice: str) -> list[tuple[int, str]]:
    """Pieces of a notice, one more than edits: an approximate copy holds at least one of them unchanged."""
    n = edits_of(notice) + 1
    cuts = [round(k * len(notice) / n) for k in range(n + 1)]
    return [(cuts[k], notice[cuts[k]:cuts[k + 1]]) for k in range(n)]


@lru_cache(maxsize=8)
def _search(notices: tuple[tuple[str, str], ...]):
    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for k, (notice, _) in enumerate(notices):
        for at, seed in seeds_of(notice):
            seeds.setdefault(seed, []).append((k, at))
        bound = edits_of(notice)
        patterns.append(regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={bound}}}(?![^ ])"))
    found = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        found.add_word(seed, (len(seed), uses))
    found.make_automaton()
    return found, patterns


def near_notices(line: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int, str]]:
    """Places of ``line`` (words with single spaces) that read like a notice with its bounded number of edits."""
    found, patterns = _search(notices)
    windows: set[tuple[int, int, int]] = set()
    for end, (length, uses) in found.iter(line):
        for k, at in uses:
            notice = notices[k][0]
            slack = edits_of(notice)
            start = end + 1 - length - at  # where the notice would begin without insertions
            low, high = max(0, start - slack - 1), min(len(line), start + len(notice) + 2 * slack + 1)
            high = line.find(" ", high)  # a window holds whole words
            windows.add((k, line.rfind(" ", 0, low + 1) + 1, len(line) if high < 0 else high))
    spans = []
    while windows:
        k, low, high = windows.pop()
        # the best of the window comes first, worse ones stand before and after it
        m = patterns[k].search(line, low, high)
        if m and m.end() > m.start():
            if (m.start() == 0 or line[m.start() - 1] == " ") and (m.end() == len(line) or line[m.end()] == " "):
                spans.append((notices[k][1], m.start(), m.end(), sum(m.fuzzy_counts), m.group()))
            windows |= {(k, lo, hi) for lo, hi in ((low, m.start() - 1), (m.end(), high)) if hi - lo >= len(notices[k][0]) - edits_of(notices[k][0])}
    kept: list[tuple[str, int, int, int, str]] = []
    for s in sorted(set(spans), key=lambda s: (s[3], s[1] - s[2], s[1], s[0])):  # of two at one place, the better reading
        at = bisect_left(kept, s[1], key=lambda k: k[1])
        if (at == 0 or kept[at - 1][2] <= s[1]) and (at == len(kept) or s[2] <= kept[at][1]):
            kept.insert(at, s)
    return kept


def _scan(texts, exact, notices):
    rows = []
    for text in texts:
        words = words_of(text)
        line = b" ".join(words).decode()
        framed = f" {line} "
        places, base = [], set()
        for phrase, label in exact:
            at = framed.find(f" {phrase} ")
            while at >= 0:
                places.append(at)
                base.add(label)
                at = framed.find(f" {phrase} ", at + 1)
        starts, passed, n = [], 0, 0
        for at in sorted(places):
            n += framed.count(" ", passed, at)
            starts.append(n)
            passed = at
        spans = near_notices(line, notices)
        labels = base | {s[0] for s in spans}
        lengths = {}
        for notice, label in notices:
            lengths[label] = max(lengths.get(label, 0), len(notice))
        score = 1.0 if base else max((1.0 - s[3] / lengths[s[0]] for s in spans), default=0.0)
        rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score,
                     [dict(zip(SPAN.names, s)) for s in spans]))
    columns = list(zip(*rows))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("edits", pa.int32()), ("found", pa.string())]))]
    return [pa.array(c, kind) for c, kind in zip(columns, kinds)]


def license_notices(pages: DataFrame, text: str = "text", by: Sequence[str] = BY, carry: Sequence[str] = (),
                    exact: Mapping[str, str] = EXACT, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """License notices of every page text.

    ``exact`` phrases count wherever their words stand consecutively (``n_base``, ``first_word``, ``last_word``,
    ``base_labels``). ``notices`` may hold one edit for every ten characters: an unchanged piece locates a
    candidate, bounded-error matching verifies it and gives its span in the line of words (``spans``: label,
    characters, edits, the words found; of overlapping ones the one with fewest edits). ``labels`` joins both, sorted; ``score`` is 1 for an exact phrase,
    otherwise 1 less the share of wrong characters of the best span, 0 without one.
    A null text counts as empty: no words, no labels, null places. Repeated rows stay, other columns are left
    out unless carried. No shuffle; every text is read whole.
    """
    work = partial(_scan, exact=tuple(exact.items()), notices=tuple(notices.items()))
    return annotate(pages, [*by, *carry], text, FIELDS, work)
