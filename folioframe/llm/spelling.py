"""Spelling variants of words: one-edit neighbours found on a reduced alphabet, forms and roots."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.texts import slices
from folioframe.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 7
SYMBOLS = 4
# Words, and characters of words, that a task counts before it hands the counts on.
HELD_WORDS, HELD_CHARS = 400_000, 1 << 24
# Keys that a step makes at once.
HELD_KEYS = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def count_words(words: DataFrame, text: str = "text", key: str = "doc_id", letters: str = LETTERS, min_length: int = MIN_LENGTH,
                misread_every: int | None = None) -> DataFrame:
    """How often each word stands in the texts of scanned words, blocks or pages: ``word``, ``n``.

    A word is a maximal run of ``letters``, A-Z lower-cased, with at least ``min_length`` code points. With ``misread_every`` the runs of a text whose
    unsigned crc32 h of ``<key>:<run>`` it divides are read without code point h % length: a fixed share of misreadings to measure against.
    Tasks count before they shuffle. Null texts have no words; a null key is an empty one; repeated rows count each; texts are read whole.
    """
    slim = words.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.col(text).cast("string").alias("__text")).where("__text IS NOT NULL")
    # a run that loses a code point must have one more
    pattern = re.compile(f"[{letters}]{{{min_length},}}")

    def run(batches):
        held, chars = {}, 0
        for batch in batches:
            for part in slices(batch, pa.compute.binary_length(batch.column(1)).to_pylist()):
                for name, content in zip(*(c.to_pylist() for c in part.columns)):
                    before = zlib.crc32(f"{name}:".encode())
                    for word, n in Counter(pattern.findall(content.encode().translate(_LOWER).decode())).items():
                        if misread_every:
                            h = zlib.crc32(word.encode(), before)
                            if h % misread_every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                                if len(word) < min_length:
                                    continue
                        if word in held:
                            held[word] += n
                        else:
                            held[word] = n
                            chars += len(word)
                    if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                        yield _counted(held)
                        held, chars = {}, 0
        yield _counted(held)

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held):
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def reduce_letters(words: Sequence[str], symbols: int) -> list[np.ndarray]:
    """Each word as the symbols its letters hash to, from 1 to ``symbols``."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    small = ((codes * _BASE) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)
    return np.split(small, np.cumsum([len(w) for w in words])[:-1]) if len(words) else []


def neighbour_keys(reduced: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of reduced words of one length (rows), and keys of their neighbours: the word itself, one symbol replaced, one taken out.

    A key is the word as digits of a number, modulo 2**64. An insertion into one word is a deletion from the other, so it needs no keys of its own:
    every pair of words with at most one edit between them meets in a key of the longer one. Deletions from a run of equal symbols are one: the
    others are masked by the word's own row of ``wanted``. Gives own keys, neighbours and ``wanted``.
    """
    n, length = reduced.shape
    with np.errstate(over="ignore"):
        power = np.ones(length + 1, dtype=np.uint64)
        for i in range(length):
            power[i + 1] = power[i] * _BASE
        terms = reduced * power[:length]
        own = terms.sum(axis=1, dtype=np.uint64)
        heads = np.concatenate([np.zeros((n, 1), dtype=np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        # symbols after the one taken out move a place down
        tails = reduced[:, 1:] * power[:length - 1]
        tails = np.concatenate([np.cumsum(tails[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((n, 1), dtype=np.uint64)], axis=1)
        deleted = heads[:, :length] + tails
        replaced = [own[:, None] + (np.uint64(1) + (reduced - np.uint64(1) + np.uint64(s)) % np.uint64(symbols) - reduced) * power[:length] for s in range(1, symbols)]
    first = np.concatenate([np.ones((n, 1), dtype=bool), reduced[:, 1:] != reduced[:, :-1]], axis=1)
    keys = np.concatenate([own[:, None], deleted, *replaced], axis=1)
    wanted = np.concatenate([np.ones((n, 1), dtype=bool), first, np.ones((n, length * (symbols - 1)), dtype=bool)], axis=1)
    if length > 256:  # numbers modulo 2**64 may repeat among the many keys of a long word
        for row, taken in zip(keys, wanted):
            once = np.zeros(len(row), dtype=bool)
            once[np.flatnonzero(taken)[np.unique(row[taken], return_index=True)[1]]] = True
            taken &= once
    return own, keys, wanted


def _keyed(symbols: int, neighbours: bool):
    """Rows of (word, n) with the key of the reduced word, or with those of its neighbours."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            reduced = reduce_letters(words, symbols)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                step = max(1, HELD_KEYS // (length * symbols + 1))
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    own, keys, wanted = neighbour_keys(np.stack([reduced[r] for r in some]), symbols)
                    if neighbours:
                        places, own = np.repeat(some, wanted.sum(axis=1)), keys[wanted]
                    else:
                        places = some
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *(c.take(pa.array(places)) for c in batch.columns)], names=["key", "word", "n"])

    return run


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Pairs of words that differ by exactly one inserted, deleted or replaced code point: ``word``, ``near``, ``near_n``, in both directions.

    ``words`` has each ``word`` once with its ``n``. Letters hash to ``symbols`` symbols; one word's reduced neighbours meet the other's reduced word in an
    equi-join, and the edit is verified on the words. Fewer symbols make fewer keys and more candidates; no choice loses a pair.
    """
    schema = "key long, word string, n long"
    around = words.select("word", "n").mapInArrow(_keyed(symbols, True), schema)
    plain = words.select("word", "n").mapInArrow(_keyed(symbols, False), schema).toDF("key", "near", "near_n")
    longer = F.length("word") - F.length("near")
    met = around.join(plain, "key").where(longer.isin(0, 1) & (F.levenshtein("word", "near", 1) == 1))
    there = F.struct("word", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # words of one length meet from both sides
    return met.select(F.explode(F.when(longer == 0, F.array(there)).otherwise(F.array(there, back))).alias("p")).select("p.*")


def spelling_variants(words: DataFrame, word: str = "word", n: str = "n", min_length: int = MIN_LENGTH, least: int = 2, ratio: int = 10,
                      symbols: int | None = None) -> DataFrame:
    """Which words are rare spellings of a frequent near word, and the word at the end of such a chain.

    ``words`` has one row for each scanned word and its number ``n`` (as ``count_words`` gives); words of at least ``min_length`` code points
    and ``least`` occurrences take part. Near words differ by one inserted, deleted or replaced code point. A word's ``form`` is its near
    word of largest n (ties: smallest by code points) if that n is at least ``ratio`` times the word's; ``root`` follows forms to the last, and is the word itself if it has none.
    Gives ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word that takes part.

    Counts rise by ``ratio`` along a chain, so following it takes few steps and always ends. Rows of one word are added up; null words and words without a
    number are left out; an empty table gives no rows; other columns are not read. ``symbols`` grows with the vocabulary if not given, so that
    a reduced word stands for a few words at any size; the rows do not depend on it.
    """
    if ratio < 2:
        raise ValueError("forms of a ratio below 2 may lead in circles")
    taken = (words.where(F.col(word).isNotNull()).groupBy(F.col(word).cast("string").alias("word")).agg(F.sum(n).cast("long").alias("n"))
             .where((F.col("n") >= least) & (F.length("word") >= min_length)))
    vocabulary = cut_lineage(taken)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    if symbols is None:
        symbols = max(SYMBOLS, math.ceil((vocabulary.count() / 64) ** (1 / max(min_length, 1))))
    near = near_words(vocabulary, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    forms = cut_lineage(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n")))
    edges = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = edges.select(F.col("word").alias("root"), F.col("root").alias("next"))
    ended = []
    going = edges
    while True:
        # those whose root has a form itself go on
        moved = going.join(steps, "root", "left").select("word", "root", "next")
        moved = cut_lineage(moved)
        ended.append(moved.where("next IS NULL").select("word", "root"))
        going = moved.where("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if going.isEmpty():
            break
    roots = ended[0]
    for more in ended[1:]:
        roots = roots.unionByName(more)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
