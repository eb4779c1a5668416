"""Page texts that share most of their word 5-grams: Jaccard join with Bayesian pruning of candidates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import lru_cache, partial, reduce

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.texts import BY, Memo, annotate
from folioframe.plans.graphs import components
from folioframe.session import cut_lineage

WORDS = 5
HASHES = 128
BANDS, ROWS = 20, 4  # at 0.8, all 20 bands of 4 miss a pair with probability 0.00003
STEP = 32  # values compared between two looks at the posterior
BLOCK = 256  # texts that are compared with as many others in one task
BLOCK_GRAMS = 1 << 20
_WORD = re.compile(r"\w+")
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_HASH_OF = Memo(xxhash.xxh64_intdigest, 100_000)


def grams_of(text: str | None) -> np.ndarray:
    """Hashes of the different word 5-grams, ascending; of all words, if there are fewer than five; none without a word."""
    words = _WORD.findall((text or "").lower())
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASH_OF.__getitem__, words), dtype=np.uint64, count=n)
    width = min(WORDS, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[k:n - width + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signatures(sets: Sequence[np.ndarray]) -> np.ndarray:
    """MinHash values (16 bit of each) of sets that aren't empty, a row for each."""
    out = np.empty((len(sets), HASHES), dtype=np.uint16)
    held, at = [], 0
    for k, s in enumerate(sets):
        held.append(s)
        if k + 1 == len(sets) or sum(map(len, held[-1:])) + (k + 1 - at) * 512 > 1 << 17:
            joined = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            for j in range(HASHES):
                low = np.minimum.reduceat((joined * _FACTORS[j] + _OFFSETS[j]) >> np.uint64(24), starts)
                out[at:k + 1, j] = (low ^ (low >> np.uint64(16))).astype(np.uint16)
            held, at = [], k + 1
    return out


@lru_cache(maxsize=16)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After every ``STEP`` values: the fewest matches with which a pair may still reach the threshold.

    With every similarity equally likely beforehand, m matches in n values leave the threshold t reached with
    probability P(B <= m), B binomial with n + 1 draws of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return tuple(out)


def promising(values: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Places of the pairs (a, b) that may reach the threshold; the others are dropped as soon as they may not."""
    live, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        here = slice(k * STEP, (k + 1) * STEP)
        fresh = np.empty(len(live), dtype=np.int32)
        for low in range(0, len(live), 1 << 15):
            part = live[low:low + (1 << 15)]
            fresh[low:low + len(part)] = (values[a[part], here] == values[b[part], here]).sum(axis=1)
        matches = matches + fresh
        good = matches >= least
        live, matches = live[good], matches[good]
    return live


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is linked to."""
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


def whole_groups(batches, keys: int) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that rows with equal first ``keys`` columns stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [c[batch.num_rows - 1] for c in batch.columns[:keys]]
        same = None
        for column, value in zip(batch.columns, last):
            hit = pc.equal(column, value)
            same = hit if same is None else pc.and_(same, hit)
        cut = batch.num_rows - int(pc.sum(same).as_py())  # sorted, so the last group is at the end
        if cut or (held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in range(keys))):
            ready = [*held, batch.slice(0, cut)]
            held = [batch.slice(cut)]
            table = pa.Table.from_batches(ready)
            if table.num_rows:
                yield table
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in range(keys):
        column = table.column(k).combine_chunks()
        change[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _pairs(side: np.ndarray, start: int, end: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's rows: all within a block, or those of two different blocks."""
    n = end - start
    if i == j:
        a, b = np.triu_indices(n, 1) if n > 2 else (np.arange(n - 1), np.arange(1, n))
        return a + start, b + start
    first, second = np.flatnonzero(side[start:end] == i) + start, np.flatnonzero(side[start:end] == j) + start
    return np.repeat(first, len(second)), np.tile(second, len(first))


def _read(texts):
    nodes, sizes, values = [], [], []
    sets = list(map(grams_of, texts))
    full = [s for s in sets if len(s)]
    found = iter(signatures(full)) if full else iter(())
    for s in sets:
        nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        sizes.append(len(s))
        values.append(next(found).tobytes() if len(s) else None)
    return [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(values, pa.binary())]


READ = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n_grams", T.LongType()), T.StructField("minhash", T.BinaryType())])


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("minhash").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, HASHES)
        keys = np.ascontiguousarray(values[:, :BANDS * ROWS]).view(np.int64)  # four values of 16 bit are the key
        at = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), pa.array(keys.reshape(-1)),
                                          batch.column("node").take(pa.array(at))], names=["band", "bucket", "node"])


def _prune(batches, threshold, tolerance):
    """Groups of candidates (band, bucket, i, j): a link for each node to the first it may be similar to."""
    for table in whole_groups(batches, 4):
        starts = _starts(table, 4)
        ends = np.append(starts[1:], table.num_rows)
        i, j, side = (table.column(c).to_numpy() for c in ("i", "j", "side"))
        values = np.frombuffer(b"".join(table.column("minhash").to_pylist()), dtype=np.uint16).reshape(table.num_rows, HASHES)
        label = np.arange(table.num_rows)
        held, size = [], 0
        for k, (s, e) in enumerate(zip(starts, ends)):
            held.append(_pairs(side, s, e, i[s], j[s]))
            size += len(held[-1][0])
            if size > 1 << 18 or k + 1 == len(starts):
                a, b = (np.concatenate(x) for x in zip(*held))
                live = promising(values, a, b, threshold, tolerance)
                label = np.minimum(label, roots(len(label), a[live], b[live]))
                held, size = [], 0
        linked = np.flatnonzero(label != np.arange(len(label)))
        nodes = table.column("node").combine_chunks()
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(linked)), nodes.take(pa.array(label[linked]))], names=["a", "b"])


def overlaps(sets: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(a) <= 64:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
    used = np.unique(np.concatenate([a, b]))
    grams = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, gram, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    gram, owner = np.unique(gram[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    total = np.zeros((len(used), len(used)), dtype=np.float64)
    width = 1 << 12
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        here = slice(np.searchsorted(gram, low), np.searchsorted(gram, low + width))
        grid = np.zeros((len(used), width), dtype=np.float32)
        grid[owner[here], gram[here] - low] = 1
        total += grid @ grid.T  # whole numbers below 2 ** 24, so exact
    return total[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)


def _verify(batches, threshold, tolerance):
    """Groups of texts (component, i, j): exact links, and the first text that each is linked to."""
    share = Fraction(threshold).limit_denominator(10_000)
    for table in whole_groups(batches, 3):
        # a repeated row of the key brings its text twice
        table = table.take(pa.array(_starts(table.select(["component", "i", "j", "node"]), 4)))
        starts = _starts(table, 3)
        ends = np.append(starts[1:], table.num_rows)
        i, j, side = (table.column(c).to_numpy() for c in ("i", "j", "side"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]
        values = signatures(sets)
        sizes = np.array(list(map(len, sets)))
        links, label = np.zeros(table.num_rows, dtype=np.int64), np.arange(table.num_rows)
        for s, e in zip(starts, ends):
            a, b = _pairs(side, s, e, i[s], j[s])
            near = np.minimum(sizes[a], sizes[b]) * share.denominator >= np.maximum(sizes[a], sizes[b]) * share.numerator
            a, b = a[near], b[near]
            live = promising(values, a, b, threshold, tolerance)
            a, b = a[live], b[live]
            both = overlaps(sets, a, b)
            good = both * share.denominator >= (sizes[a] + sizes[b] - both) * share.numerator
            a, b = a[good], b[good]
            links += np.bincount(a, minlength=len(links)) + np.bincount(b, minlength=len(links))
            label[s:e] = roots(e - s, a - s, b - s) + s
        nodes = table.column("node").combine_chunks()
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label)), pa.array(links)], names=["node", "root", "n_links"])


def _grams(texts):
    sets = list(map(grams_of, texts))
    return [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]


def _in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows with ``side`` (their block), once for each pair of blocks ``i <= j`` they take part in."""
    side = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))).alias("__other")
    return (rows.withColumn("side", side).select("*", other)
            .withColumns({"i": F.least("side", "__other"), "j": F.greatest("side", "__other")}).drop("__other", blocks))


def similar_pages(pages: DataFrame, text: str = "text", by: Sequence[str] = BY, threshold: float = 0.8, tolerance: float = 1e-4) -> DataFrame:
    """Classes of page texts linked by a Jaccard similarity of word 5-grams of ``threshold`` or more.

    Gives for every row ``by``, ``class_id`` (the least first key of its class; null keys come last), ``n_links``
    (different gram sets that are similar enough to the row's, its own copies aside), ``n_copies`` (rows with
    the same gram set) and ``first`` (true for one row of each class, the least; null for none). Rows with the same
    gram set are one node, however many they are.

    Nodes that agree in a band of MinHash values are candidates; their values are compared step by step, and a
    pair is dropped once the posterior probability of reaching the threshold is below ``tolerance``. What is left
    joins nodes into components, within which every pair is pruned again by all its values and then verified on
    the sets themselves. Large buckets and components are cut into blocks, and pairs of blocks are dealt to
    tasks; a task gives a row for each of its nodes, never a row for each pair.

    Texts without a word (null and empty ones too) are similar to nothing, not even each other: class of their
    own, no links. Repeated rows are copies. Comparison ignores case and punctuation.
    """
    key = by[0]
    read = cut_lineage(annotate(pages.select(*by, F.col(text).cast("string").alias("__t")), by, "__t", READ, _read), compression="zstd")
    nodes = cut_lineage(read.where("node IS NOT NULL").select("node", "n_grams", "minhash").distinct(), compression="zstd")
    bands = nodes.select("node", "minhash").mapInArrow(_bands, "band int, bucket long, node binary")
    full = bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = bands.join(full, ["band", "bucket"]).select("band", "bucket", "node", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    tried = (_in_blocks(met, "blocks").join(nodes.select("node", "minhash"), "node").select("band", "bucket", "i", "j", "side", "node", "minhash")
             .repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "node")
             .mapInArrow(partial(_prune, threshold=threshold, tolerance=tolerance), "a binary, b binary").distinct())
    tried = cut_lineage(tried)
    ends = tried.select(F.col("a").alias("node")).union(tried.select(F.col("b").alias("node"))).distinct()
    part = cut_lineage(components(ends, tried, [], "node", "a", "b"))
    sizes = part.join(nodes.select("node", "n_grams"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
    blocks = sizes.select("component", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).alias("blocks"))
    holders = read.groupBy("node").agg(F.min(F.struct(*[F.col(c).isNull().alias(f"n_{c}") for c in by], *by)).alias("holder"), F.count(F.lit(1)).alias("n_copies"))
    holders = cut_lineage(holders)
    wanted = part.join(blocks, "component").join(holders, "node").select("node", "component", "blocks", *[F.col(f"holder.{c}").alias(c) for c in by])
    # one text of each node in question; several rows with its key are told apart by their grams
    texts = pages.select(*by, F.col(text).cast("string").alias("__t"))
    same = [texts[c].eqNullSafe(wanted[c]) for c in by]
    chosen = texts.join(wanted, on=same[0] if len(same) == 1 else reduce(lambda x, y: x & y, same)).select(F.col("node").alias("is"), "component", "blocks", "__t")
    grams = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("grams", T.BinaryType())])
    ready = annotate(chosen, ["is", "component", "blocks"], "__t", grams, _grams).where("node = is").drop("is")
    checked = (_in_blocks(ready, "blocks").select("component", "i", "j", "side", "node", "grams")
               .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
               .mapInArrow(partial(_verify, threshold=threshold, tolerance=tolerance), "node binary, root binary, n_links long"))
    checked = cut_lineage(checked)
    links = checked.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    edge = checked.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    linked = edge.select(F.col("a").alias("node")).union(edge.select(F.col("b").alias("node"))).distinct()
    classes = components(linked, edge, [], "node", "a", "b")
    state = (holders.where("node IS NOT NULL").join(classes, "node", "left").join(links, "node", "left")
             .select("node", "holder", "n_copies", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    state = cut_lineage(state)
    least = state.groupBy("component").agg(F.min("holder").alias("least"))
    state = state.join(least, "component").select("node", F.col("least").alias("least"), "n_copies", "n_links")
    own = F.struct(*[F.col(c).isNull().alias(f"n_{c}") for c in by], *by)
    return (read.select(*by, "node").join(state, "node", "left")
            .select(*by, F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col(f"least.{key}")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), (F.col("node").isNull() | (F.col("least") == own)).alias("first"), "node"))
