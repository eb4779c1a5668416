"""Token windows of equal capacity, packed from page texts by multiway differencing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.texts import BY, release, slices
from folioframe.llm.tokens import tokenizer_of
from folioframe.session import cut_lineage

CAPACITY = 1024
# Pieces of what a page leaves over after its full windows: small enough that sums come out nearly equal.
PIECE = 256
# Windows that one task balances at a time.
GROUP_WINDOWS = 64


def cuts_of(n: int, capacity: int, piece: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: full windows first, then pieces of at most ``piece``."""
    full = n - n % capacity
    return [*range(0, full, capacity), *range(full, n, piece)]


def _cut(batches, path, end_id, capacity, piece, width):
    end = np.array([end_id], dtype="<u4").tobytes()
    release("tokens")
    tokenizer = tokenizer_of(path)
    for batch in batches:
        texts = batch.column(width)
        for part in slices(batch, pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()):
            rows, starts, lengths, ids, totals = [], [], [], [], []
            for k, text in enumerate(part.column(width).to_pylist()):
                coded = tokenizer.encode(text) + end
                n = len(coded) // 4
                at = cuts_of(n, capacity, piece)
                for low, high in zip(at, [*at[1:], n]):
                    rows.append(k), starts.append(low), lengths.append(high - low), ids.append(coded[4 * low:4 * high]), totals.append(n)
            taken = part.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:width], pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()),
                                              pa.array(ids, pa.binary())], names=[*part.schema.names[:width], "start", "length", "doc_tokens", "ids"])


def cut_pages(pages: DataFrame, tokenizer_path: str, text: str = "text", by: Sequence[str] = BY, end_id: int = 0, capacity: int = CAPACITY,
              piece: int = PIECE) -> DataFrame:
    """Pieces of every page's ids and its end id: ``by``, ``start``, ``length``, ``doc_tokens``, ``ids`` (little-endian 32 bit).

    As many full windows as a page fills, then pieces of at most ``piece`` ids. Each id lies in one piece. A null
    text counts as empty and has the end id alone.
    """
    slim = pages.select(*by, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return slim.mapInArrow(partial(_cut, path=tokenizer_path, end_id=end_id, capacity=capacity, piece=piece, width=len(by)), schema)


def differencing(sizes: Sequence[int], bins: int) -> np.ndarray:
    """A bin for each size, so that the bins' sums come out nearly equal (multiway Karmarkar-Karp).

    Every size starts as a partition with one full bin. The two partitions with the largest difference between
    their bins are merged, the fullest bin of one with the emptiest of the other, until one is left.
    """
    n = len(sizes)
    heap = []
    for k, size in enumerate(sizes):
        sums = np.zeros(bins, dtype=np.int64)
        sums[0] = size
        heap.append((-int(size if bins > 1 else 0), k, sums))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), n + len(merges) - 1, sums))
    where = {n + len(merges) - 1 if merges else 0: np.arange(bins)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        held = where.pop(n + k)
        mine = np.empty(bins, dtype=np.int64)
        mine[order] = held
        where[a], where[b] = mine, mine[::-1]
    return np.array([where[k][0] for k in range(n)], dtype=np.int64)


def windows_of(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """A window for each size; no window exceeds the capacity. Starts with as few windows as could do; more, as long as one overflows."""
    sizes = np.asarray(sizes, dtype=np.int64)
    bins = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        chosen = differencing(sizes, bins)
        over = int(np.bincount(chosen, weights=sizes, minlength=bins).max()) - capacity
        if over <= 0:
            return chosen
        bins += max(1, bins * over // capacity // 2)


def _pack(table, capacity):
    order = np.argsort(table.column("__row").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    sizes = table.column("length").to_numpy()
    window = windows_of(sizes, capacity)
    order = np.lexsort((np.arange(len(sizes)), window))
    table, sizes, window = table.take(pa.array(order)), sizes[order], window[order]
    total = np.cumsum(sizes)
    first = np.concatenate([[True], window[1:] != window[:-1]])
    local = np.cumsum(first) - 1
    base = (total - sizes)[first]
    filled = np.add.reduceat(sizes, np.flatnonzero(first))
    sequence = 2 * ((table.column("__group").to_numpy().astype(np.int64) << 20) + local)
    return table.drop_columns(["__row", "__group"]).append_column("sequence_id", pa.array(sequence)).append_column(
        "offset", pa.array(total - sizes - base[local])).append_column("window_tokens", pa.array(filled[local]))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """The pieces with ``sequence_id``, ``offset`` (in the window, without gaps) and ``window_tokens``.

    A full piece is a window of its own. The others are dealt by a hash of their row into groups of about
    ``group_windows`` windows, and each group is split by differencing. All columns stay with their piece; it
    costs one shuffle of the short pieces, so leave long columns out or join them afterwards. Ties are broken by
    the row's place; an empty table gives none.
    """
    new = {"sequence_id", "offset", "window_tokens", "__row", "__group"} & set(pieces.columns)
    if new:
        raise ValueError(f"columns {sorted(new)} are made here")
    stored = cut_lineage(pieces)
    short = stored.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(short / (capacity * group_windows)))
    rows = stored.withColumn("__row", F.monotonically_increasing_id())  # of the stored files, so the same at every attempt
    full = rows.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("__row") * 2 + 1, "offset": F.lit(0).cast("long"), "window_tokens": F.col("length")}).drop("__row")
    schema = T.StructType([*stored.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "window_tokens"))])
    packed = (rows.where(F.col("length") < capacity).withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
              .groupBy("__group").applyInArrow(partial(_pack, capacity=capacity), schema))
    return packed.unionByName(full)


def pack_pages(pages: DataFrame, tokenizer_path: str, text: str = "text", by: Sequence[str] = BY, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Windows of at most ``capacity`` ids from all page texts: the pieces of ``cut_pages`` with their place, ids included.

    A window is filled up to the capacity by its reader unless its length is a power of two.
    """
    return pack_pieces(cut_pages(pages, tokenizer_path, text, by, end_id, capacity), capacity)
