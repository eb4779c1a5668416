"""Benchmark decontamination: one automaton over the words of test questions and answers, one scan of every page text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.texts import BY, annotate
from folioframe.session import cut_lineage

WINDOW = 10
# Words of test items that one automaton holds (about 100 MB in a worker); more items are dealt to several automata.
AUTOMATON_WORDS = 200_000
# A-Z become a-z, other ASCII signs but digits become spaces; bytes of letters beyond ASCII stay. Lengths stay, so places do.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "first_word", "last_word")]))
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "first_word", "last_word")]))
_BUILT: dict[str, tuple] = {}


def normal_words(text: str) -> list[bytes]:
    """Words of a text: runs of a-z (A-Z lower-cased), digits and everything beyond ASCII."""
    return text.encode().translate(_NORMAL).split()


class ItemScan:
    """Finds the word windows of some test items in texts.

    Each word of the items is one symbol, any other word is a symbol that no window holds, so the automaton works on
    words and never matches inside one. It is built once in each worker, where it is first used.
    """

    def __init__(self, texts: Sequence[tuple[str, str]], window: int = WINDOW):
        self.texts, self.window, self.name = list(texts), window, uuid.uuid4().hex

    def _build(self):
        symbols, windows = {}, {}
        for item, text in self.texts:
            words = []
            for word in normal_words(text):
                code = len(symbols) + 1
                # surrogates are no characters
                words.append(symbols.setdefault(word, chr(code if code < 0xD800 else code + 0x800)))
            for at in range(max(1, len(words) - self.window + 1) if words else 0):
                windows.setdefault("".join(words[at:at + self.window]), {})[item] = None
        automaton = ahocorasick.Automaton()
        for number, (key, items) in enumerate(windows.items()):
            automaton.add_word(key, (number, len(key), tuple(items)))
        if windows:
            automaton.make_automaton()
        return symbols, automaton if windows else None

    def scan(self, text: str | None):
        """Number of words, maximal stretches of hit words and items of one text."""
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = self._build()
        symbols, automaton = _BUILT[self.name]
        normal = (text or "").encode().translate(_NORMAL)
        words = normal.split()
        if not words or automaton is None:
            return len(words), [], []
        met, ends = {}, []
        for end, (number, length, items) in automaton.iter("".join([symbols.get(w, "\0") for w in words])):
            met[number] = items
            ends.append((end, length))
        if not ends:
            return len(words), [], []
        return len(words), _stretches(normal, len(words), ends), sorted(set().union(*met.values()))


def _stretches(normal: bytes, n_words: int, ends: list[tuple[int, int]]) -> list[dict]:
    change = np.zeros(n_words + 1, dtype=np.int64)
    last, length = np.array(ends, dtype=np.int64).T
    np.add.at(change, last - length + 1, 1)
    np.add.at(change, last + 1, -1)
    hit = np.concatenate([[False], np.cumsum(change)[:n_words] > 0, [False]])
    firsts, afters = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    held = np.frombuffer(normal, dtype=np.uint8)
    inside = np.concatenate([[False], held != 32, [False]])
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    # bytes before a place that do not begin a character
    more = np.concatenate([[0], np.cumsum((held & 0xC0) == 0x80)])
    begin, stop = starts[firsts], stops[afters - 1]
    return [{"start": int(a), "end": int(b), "first_word": int(f), "last_word": int(e)}
            for a, b, f, e in zip(begin - more[begin], stop - more[stop], firsts, afters - 1)]


def _columns(rows):
    n, spans, items = zip(*rows) if rows else ((), (), ())
    return [pa.array(n, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(items, pa.list_(pa.string()))]


def _portions(items: DataFrame, item: str, fields: Sequence[str], window: int, most_words: int) -> list[Callable[[], ItemScan]]:
    """Test items in portions of about ``most_words`` words, dealt by a hash of the text; each is brought to the driver when it is called for."""
    texts = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                         F.explode(F.array_distinct(F.array(*(F.col(f).cast("string") for f in fields)))).alias("text")).where("text IS NOT NULL").distinct()
    # a word and the sign after it take two characters or more
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * most_words)))

    def portion(number):
        dealt = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == number) if n > 1 else texts
        return ItemScan([(r.item, r.text) for r in dealt.collect()], window)

    return [partial(portion, k) for k in range(n)]


def page_contamination(pages: DataFrame, items: DataFrame, text: str = "text", by: Sequence[str] = BY, carry: Sequence[str] = (), item: str = "item_id",
                       fields: Sequence[str] = ("text",), window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Which words of every page text lie in passages of test items.

    ``items`` has an id and one or more text columns ``fields`` (questions, answers). Words: A-Z lower-cased, runs of letters,
    digits and all beyond ASCII. A window is ``window`` consecutive words of an item text; a text with fewer, but some, is one
    window. Gives ``by``, ``carry``, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items``, ``items``
    (ids of items with an occurring window, as sorted strings), ``contaminated`` (``n_hit`` > 0) and ``spans``: maximal
    stretches of hit words as character offsets [start, end) in the original text and as word numbers.

    Page texts are read whole and once, without a shuffle, if the items have up to ``most_words`` words. More items are dealt to several automata,
    each scans the texts once, and the stretches of equal texts are put together. Null texts have no words; a null item
    id counts as the empty string; items that share a window all count; repeated rows of either table change nothing for other rows; without items
    nothing is hit. Of columns named like a result, only the result stays.
    """
    carry = [c for c in dict.fromkeys([*by, *carry]) if c not in (*FIELDS.names, "n_hit", "n_items", "contaminated")]
    scans = _portions(items, item, fields, window, most_words)
    if len(scans) == 1:
        scanned = annotate(pages, carry, text, FIELDS, _work(scans[0]()))
    else:
        texts = pages.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL").withColumn("text_key", F.sha2("text", 256))
        # written one after the other, so the driver holds the items of one automaton
        found = [cut_lineage(annotate(texts, ["text_key"], "text", FIELDS, _work(scan())).where("size(items) > 0")) for scan in scans]
        keyed = pages.withColumn("__text_key", F.sha2(F.col(text).cast("string"), 256))
        counted = annotate(keyed, [*carry, "__text_key"], text, FIELDS, _work(ItemScan([], window))).drop("spans", "items")
        scanned = counted.join(_together(found), F.col("__text_key") == F.col("text_key"), "left").withColumns(
            {c: F.coalesce(c, F.array().cast(FIELDS[c].dataType)) for c in ("spans", "items")})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return scanned.select(*carry, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
                             (F.size("items") > 0).alias("contaminated"), "spans")


def _work(scan: ItemScan):
    return lambda texts: _columns([scan.scan(t) for t in texts])


def _together(found: Sequence[DataFrame]) -> DataFrame:
    """Stretches and items of each text from all automata; a text has at most one row of each."""
    rows = found[0].distinct()
    for more in found[1:]:
        rows = rows.unionByName(more.distinct())

    def widen(spans, s):
        # stretches come in order of their start; words side by side are one stretch
        last = F.element_at(spans, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["first_word"].alias("first_word"),
                         F.greatest(last["last_word"], s["last_word"]).alias("last_word"))
        return F.when(F.size(spans) == 0, F.array(s)).when(s["first_word"] > last["last_word"] + 1, F.concat(spans, F.array(s))).otherwise(
            F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(wider)))

    put = rows.groupBy("text_key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                       F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return put.withColumn("spans", F.aggregate("spans", F.array().cast(_SPANS), widen))
