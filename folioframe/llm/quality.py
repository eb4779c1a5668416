"""Quality of page texts: counts within a text, and lines that too many documents of a host repeat."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.texts import BY, annotate
from folioframe.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = re.compile(r"[ \t-\r]+")
_PARTS = T.ArrayType(T.StructType([T.StructField("line_hash", T.LongType()), T.StructField("words", T.LongType())]))
FIELDS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("lines", _PARTS)])


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of eight that the text holds twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    rolled = h[:n - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        rolled += h[k:n - WINDOW + 1 + k]
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(rolled), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    change[starts] += 1
    change[starts + WINDOW] -= 1
    return int((np.cumsum(change)[:n] > 0).sum())


def line_key(line: str) -> str:
    """A line as lines are compared: lower case, single spaces, none at the ends."""
    return " ".join(_SPACE.sub(" ", line.lower()).split(" ")).strip(" ")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _measure(texts):
    out = [[] for _ in FIELDS.names]
    for text in texts:
        text = text or ""
        words = text.encode().split()  # on space and \t to \r, as bytes do
        seen, repeats, lines = set(), 0, {}
        for line in text.split("\n"):
            n = len(line.encode().split())
            if not n:
                continue
            if line in seen:
                repeats += 1
            seen.add(line)
            key = _signed(xxhash.xxh64_intdigest(line_key(line)))
            lines[key] = lines.get(key, 0) + n
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        for column, value in zip(out, (len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(words),
                                       [{"line_hash": k, "words": n} for k, n in lines.items()])):
            column.append(value)
    part = pa.list_(pa.struct([("line_hash", pa.int64()), ("words", pa.int64())]))
    return [pa.array(c, part if name == "lines" else pa.int64()) for name, c in zip(FIELDS.names, out)]


def page_quality(pages: DataFrame, text: str = "text", host: str = "source", by: Sequence[str] = BY, least_words: int = 20, most_repeated: float = 30,
                 most_documents: int = 20, copied_share: float = 0.3, least_left: float = 0.3) -> DataFrame:
    """Counts and verdict of every page text.

    A line (lower case, single spaces) is often repeated if more than ``most_documents`` different texts of its host hold it, whatever the
    size of the host. Documents are counted by a sketch of their lines, so that near copies count once: a text of whose words
    ``copied_share`` or more stand in often repeated lines counts as the least hash of these lines, any other as itself. Lines in more than
    ``most_documents`` documents are above the limit: they
    count as removed (``removed``: hashes of the lines, as ``remove_lines`` takes them); a page that keeps less than
    ``least_left`` of its words is depleted. ``base_failed``: fewer than ``least_words`` words, or more than
    ``most_repeated`` per cent of them in repeated windows of eight. ``kept``: neither.

    Gives ``by``, the five counts, ``words_left``, ``removed``, ``base_failed``, ``kept`` and ``text_hash`` (``xxhash64``). A null text counts as empty
    (all counts 0, not kept), a null host as a host of its own; repeated rows stay; an empty table gives no rows; texts are read whole and only hashes of
    lines are shuffled.
    """
    slim = pages.select(*by, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
                        F.col(text).cast("string").alias("text"))
    measured = cut_lineage(annotate(slim, [*by, "host", "text_hash"], "text", FIELDS, _measure))
    count = F.count(F.lit(1)).alias("n")
    # the lines of each different text of a host
    held = measured.select("host", "text_hash", "n_words", "lines").dropDuplicates(["host", "text_hash"]).select("host", "text_hash", "n_words", F.inline("lines"))
    often = cut_lineage(held.groupBy("host", "line_hash").agg(count).where(F.col("n") > most_documents).select("host", "line_hash"))
    holders = cut_lineage(held.join(often, ["host", "line_hash"]))
    share = F.sum("words") / F.max("n_words")
    sketches = holders.groupBy("host", "text_hash").agg(share.alias("share"), F.min(F.xxhash64("line_hash")).alias("least")).select(
        "host", "text_hash", F.when(F.col("share") >= copied_share, F.col("least")).otherwise(F.col("text_hash")).alias("sketch"))
    above = cut_lineage(holders.join(sketches, ["host", "text_hash"]).select("host", "line_hash", "sketch").distinct()
                        .groupBy("host", "line_hash").agg(count).where(F.col("n") > most_documents).select("host", "line_hash"))
    lost = (holders.join(above, ["host", "line_hash"]).groupBy("host", "text_hash")
            .agg(F.sum("words").alias("lost"), F.collect_set("line_hash").alias("removed")))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return (measured.drop("lines").join(lost, ["host", "text_hash"], "left")
            .select(*by, *COUNTS, left.cast("long").alias("words_left"), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
                    failed.alias("base_failed"), (~failed & (left >= F.col("n_words") * least_left)).alias("kept"), "text_hash"))


def _without(texts, removed):
    out = []
    for text, gone in zip(texts, removed):
        if text is not None and gone:
            gone = set(gone)
            text = "\n".join(x for x in text.split("\n") if not x.strip() or _signed(xxhash.xxh64_intdigest(line_key(x))) not in gone)
        out.append(text)
    return out


def remove_lines(pages: DataFrame, removed: str = "removed", text: str = "text") -> DataFrame:
    """The pages with the lines of their ``removed`` hashes taken out of ``text``; all columns but ``removed`` stay."""
    schema = T.StructType([f for f in pages.schema.fields if f.name != removed])
    at, gone = pages.columns.index(text), pages.columns.index(removed)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array(_without(columns[at].to_pylist(), columns[gone].to_pylist()), pa.string())
            del columns[gone]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.mapInArrow(run, schema)
