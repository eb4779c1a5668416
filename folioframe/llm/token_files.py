"""Token ids of page texts in compressed files: one canonical code for the corpus, blocks that decode alone.

A folder holds ``codes`` (id, bits) and ``blocks``. A block row has the pages it holds in order, their numbers of
ids, the coded bits, and the bit offset of every 64th id, from which decoding can start.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.texts import annotate
from folioframe.llm.tokens import tokenizer_of
from folioframe.session import checkpoint_folder, cut_lineage

MOST_BITS = 20
MARK = 64
BLOCK_IDS = 1 << 16
PART_IDS = 1 << 22
MOST_PARTS = 20_000
_CODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("coded", T.BinaryType())])
_BLOCK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_tokens", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()), T.StructField("marks", T.BinaryType()),
])


def code_lengths(counts: Sequence[int], most: int = MOST_BITS) -> np.ndarray:
    """Bits for each symbol (all counts above 0), the shortest code with no more than ``most`` bits (package-merge)."""
    weights = np.asarray(counts, dtype=np.float64)
    n = len(weights)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} symbols need more than {most} bits")
    order = np.argsort(weights, kind="stable")
    leaves = weights[order]
    levels, level = [], leaves
    kind = np.ones(n, dtype=bool)
    for _ in range(most - 1):
        levels.append(kind)
        even = len(level) // 2 * 2
        pairs = level[0:even:2] + level[1:even:2]
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level, kind = both[rank], rank < n
    levels.append(kind)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for kind in reversed(levels):
        used = int(kind[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of some ids: shorter codes first, ids of one length in ascending order."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.most = int(self.lengths.max()) if len(ids) else 1
        step = np.int64(1) << (self.most - self.lengths)
        self.first = np.cumsum(step) - step  # the code, filled up with zeros to the longest
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.code_of, self.bits_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids] = (self.first >> (self.most - self.lengths)).astype(np.uint64)
        self.bits_of[self.ids] = self.lengths
        self._table = None

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The id that every ``most`` bits begin with, and its number of bits."""
        if self._table is None:
            step = (np.int64(1) << (self.most - self.lengths))
            ids, bits = np.repeat(self.ids, step), np.repeat(self.lengths, step)
            rest = (1 << self.most) - len(ids)
            self._table = np.concatenate([ids, np.zeros(rest, np.int64)]).astype(np.uint32), np.concatenate([bits, np.ones(rest, np.int64)]).astype(np.uint8)
        return self._table

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pages one after the other, where each page's bytes end, and the bit each id starts at."""
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        last = np.cumsum(counts)
        page_bits = np.diff(np.concatenate([[0], ends]).take(np.concatenate([[0], last])))
        page_bytes = (page_bits + 7) // 8
        byte_ends = np.cumsum(page_bytes)
        shift = (byte_ends - page_bytes) * 8 - (np.cumsum(page_bits) - page_bits)
        at = ends - bits + np.repeat(shift, counts)
        words = np.zeros(int(byte_ends[-1]) // 4 + 3 if len(byte_ends) else 3, dtype=np.uint32)
        if len(ids):
            wide = self.code_of[ids] << (64 - bits - (at & 31)).astype(np.uint64)
            word = at >> 5
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            place = word[starts]
            words[place] |= np.bitwise_or.reduceat((wide >> np.uint64(32)).astype(np.uint32), starts)
            words[place + 1] |= np.bitwise_or.reduceat((wide & np.uint64(0xFFFFFFFF)).astype(np.uint32), starts)
        return words.astype(">u4").view(np.uint8), byte_ends, at

    def decode(self, raw: bytes, marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of stretches that begin at the bits ``marks``; ``counts`` (at most 64) ids each, all stretches side by side."""
        words = np.frombuffer(raw + bytes(-len(raw) % 4 + 12), dtype=">u4").astype(np.uint64)
        ids, bits = self.table
        out = np.zeros((len(marks), int(counts.max()) if len(counts) else 0), dtype=np.uint32)
        order = np.argsort(-counts, kind="stable")
        at, left = marks[order].astype(np.int64), counts[order]
        size, mask = 64 - self.most, np.uint64((1 << self.most) - 1)
        for k in range(out.shape[1]):
            live = int(np.searchsorted(-left, -k, side="left"))  # stretches with more than k ids
            here = at[:live]
            word = here >> 5
            value = ((words[word] << np.uint64(32) | words[word + 1]) >> (size - (here & 31)).astype(np.uint64)) & mask
            value = value.astype(np.int64)
            out[order[:live], k] = ids[value]
            here += bits[value]
        return out[np.arange(out.shape[1]) < counts[:, None]]


def _tokens(texts, path, end_id):
    tokenizer = tokenizer_of(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    coded = [np.frombuffer(tokenizer.encode(t) + end, dtype="<u4") for t in texts]
    small = "<u2" if tokenizer.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    return [pa.array([len(c) for c in coded], pa.int64()), pa.array([c.astype(small).tobytes() for c in coded], pa.binary())]


def _ids_of(column, counts) -> np.ndarray:
    raw, total = b"".join(column.to_pylist()), int(counts.sum())
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * total else "<u4").astype(np.int64)


def _tally(batches):
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        got = np.bincount(_ids_of(batch.column("coded"), batch.column("n_tokens").to_numpy()))
        if len(got) > len(total):
            got[:len(total)] += total
            total = got
        else:
            total[:len(got)] += got
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])


def _shrink(batches, code, marks_at):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            counts = part.column("n_tokens").to_numpy()
            raw, ends, at = code.encode(_ids_of(part.column("coded"), counts), counts)
            raw, starts = raw.tobytes(), np.concatenate([[0], ends[:-1]])
            first = np.cumsum(counts) - counts
            place = np.searchsorted(marks_at, pa.compute.fill_null(part.column("doc_id"), -(1 << 63)).to_numpy(), side="left").astype(np.int32)
            marks = [(at[f:f + n:MARK] - 8 * s).astype("<u4").tobytes() for f, n, s in zip(first, counts, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(place), part.column("doc_id"), part.column("n_tokens"),
                                              pa.array([raw[s:e] for s, e in zip(starts, ends)], pa.binary()), pa.array(marks, pa.binary())],
                                             names=["part", "doc_id", "n_tokens", "bits", "marks"])


def _blocks(batches):
    part, block, first, size, held = None, 0, 0, 0, []

    def flush():
        nonlocal block, first, size, held
        if not held:
            return
        sizes = np.cumsum([0, *(len(b) for _, _, b, _ in held)])
        marks = np.concatenate([np.frombuffer(m, "<u4").astype("<i8") + 8 * s for (_, _, _, m), s in zip(held, sizes)])
        row = [part, block, first, [d for d, *_ in held], [n for _, n, *_ in held], b"".join(b for _, _, b, _ in held), marks.tobytes()]
        block, first, size, held = block + 1, first + size, 0, []
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=_BLOCK.names)

    for batch in batches:
        for at, *page in zip(*(c.to_pylist() for c in batch.columns)):
            if at != part:
                yield from flush()
                part, block, first = at, 0, 0
            held.append(page)
            size += page[1]
            if size >= BLOCK_IDS:
                yield from flush()
    yield from flush()


def write_token_files(pages: DataFrame, tokenizer_path: str, folder: str, text: str = "text", key: str = "doc_id", end_id: int = 2) -> str:
    """Writes the ids of all page texts, each followed by ``end_id``, in ascending order of ``key`` (a whole number).

    Ids are counted over the corpus first; the code depends on those counts alone. Rows with equal keys are
    ordered by their number of ids and their coded bytes, null keys come first; null texts count as empty.
    """
    spark = pages.sparkSession
    coded = cut_lineage(annotate(pages.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), ["doc_id"], "text", _CODED,
                                 partial(_tokens, path=tokenizer_path, end_id=end_id), owner="tokens"), compression="zstd")
    counts = coded.select("n_tokens", "coded").mapInArrow(_tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()  # a row for each id of the vocabulary
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    code = Code(ids, code_lengths(n))
    rows = [(int(i), int(b)) for i, b in zip(code.ids, code.lengths)]
    spark.createDataFrame(rows, "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    parts = int(min(MOST_PARTS, max(1, math.ceil(int(n.sum()) / PART_IDS))))
    marks = sorted(set(coded.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or [])) if parts > 1 else []
    (coded.mapInArrow(partial(_shrink, code=code, marks_at=np.array(marks, dtype=np.int64)), "part int, doc_id long, n_tokens long, bits binary, marks binary")
     .repartition(len(marks) + 1, "part").sortWithinPartitions("part", "doc_id", "n_tokens", "bits")
     .mapInArrow(_blocks, _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks"))
    return folder


def _expand(batches, code):
    for batch in batches:
        columns = batch.to_pydict()
        for k in range(batch.num_rows):
            counts = np.array(columns["doc_tokens"][k], dtype=np.int64)
            marks = np.frombuffer(columns["marks"][k], dtype="<i8")
            stretches = (counts + MARK - 1) // MARK
            sizes = np.full(int(stretches.sum()), MARK, dtype=np.int64)
            sizes[np.cumsum(stretches) - 1] = (counts - 1) % MARK + 1
            raw = code.decode(columns["bits"][k], marks, sizes).astype("<u4").tobytes()
            ends = np.cumsum(counts)
            starts = ends - counts
            yield pa.RecordBatch.from_arrays([pa.array([columns["part"][k]] * len(counts), pa.int32()), pa.array(columns["doc_ids"][k], pa.int64()), pa.array(starts + columns["first"][k]),
                                              pa.array(counts), pa.array([raw[4 * s:4 * e] for s, e in zip(starts, ends)], pa.binary())],
                                             names=["part", "doc_id", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all pages before it), ``n_tokens`` and ``ids`` (little-endian 32 bit) of every page in the files."""
    table = spark.read.parquet(f"{folder}/codes").toPandas()  # a row for each id of the vocabulary
    code = Code(table["id"].to_numpy(np.int64), table["bits"].to_numpy(np.int64))
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    size = F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    before = (blocks.groupBy("part").agg(F.sum(size).alias("n"))
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))  # a row for each part
    pages = blocks.mapInArrow(partial(_expand, code=code), "part int, doc_id long, start long, n_tokens long, ids binary")
    return pages.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def new_folder(spark: SparkSession, name: str = "tokens") -> str:
    """A folder of its own beside the other intermediate tables."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
