"""Nearest vectors by cosine: probed lists, scanned by blocks of rotated dimensions that drop candidates early."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

COLUMNS = 16  # dimensions between two tests
BLOCK = 4096  # vectors or queries of a list that one task holds
MOST_LISTS = 4096
SAMPLE = 256  # queries whose neighbours are looked for everywhere, to learn how many lists to scan


class Lists:
    """A rotation and the centres of the lists."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0].astype(np.float32)
        x = self.turned(sample)
        centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(8):
            near = np.concatenate([(x[k:k + 8192] @ centres.T).argmax(axis=1) for k in range(0, len(x), 8192)])
            order = np.argsort(near, kind="stable")
            starts = np.searchsorted(near[order], np.arange(len(centres)))
            full = np.flatnonzero(np.diff(np.append(starts, len(x))))
            sums = np.add.reduceat(x[order], starts[full], axis=0)
            centres[full] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        self.centres = centres

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return (unit.astype(np.float32) @ self.rotation)

    def nearest(self, turned: np.ndarray, n: int) -> np.ndarray:
        near = turned @ self.centres.T
        n = min(n, near.shape[1])
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)


def _raw(batches, key_at):
    for batch in batches:
        raw = [np.array(v, dtype="<f8").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])


def _listed(batches, lists, probes, dealt, other, names):
    """Rows with ``list``, the block of their own kind and each block of the other kind they meet."""
    for batch in batches:
        if not batch.num_rows:
            continue
        near = lists.nearest(lists.turned(_matrix(batch.column("raw"))), probes)
        at = np.repeat(np.arange(batch.num_rows), near.shape[1])
        chosen = near.reshape(-1)
        if dealt is None:  # which lists are chosen, only
            yield pa.RecordBatch.from_arrays([pa.array(chosen.astype(np.int32))], names=names)
            continue
        hashes = np.array([hash_of(x) for x in batch.column("raw").to_pylist()], dtype=np.uint64)
        own = (hashes[at] % dealt[chosen].astype(np.uint64)).astype(np.int32)
        times = other[chosen]
        again = np.repeat(np.arange(len(at)), times)
        meets = (np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
        taken = batch.take(pa.array(at[again]))
        yield pa.RecordBatch.from_arrays([pa.array(chosen[again].astype(np.int32)), pa.array(own[again]), pa.array(meets), *taken.columns], names=names)


def hash_of(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw)


def _true_ranks(batches, lists, sample, k):
    """The ``k`` best vectors of the batches for each sampled query, itself aside, and the place of their list in the query's order of lists."""
    own = {raw: q for q, raw in enumerate(sample)}
    asked = lists.turned(np.frombuffer(b"".join(sample), dtype="<f8").reshape(len(sample), -1))
    places = np.empty((len(sample), len(lists.centres)), dtype=np.int32)
    np.put_along_axis(places, lists.nearest(asked, len(lists.centres)), np.arange(len(lists.centres), dtype=np.int32)[None, :], axis=1)
    scores, ranks = np.full((len(sample), k), -np.inf, dtype=np.float32), np.zeros((len(sample), k), dtype=np.int32)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            raws = batch.column(0).slice(at, BLOCK)
            turned = lists.turned(_matrix(raws))
            near = asked @ turned.T
            for j, raw in enumerate(raws.to_pylist()):
                if raw in own:
                    near[own[raw], j] = -np.inf
            every = np.concatenate([scores, near], axis=1)
            best = np.argpartition(-every, k - 1, axis=1)[:, :k]
            ranks = np.take_along_axis(np.concatenate([ranks, places[:, lists.nearest(turned, 1)[:, 0]]], axis=1), best, axis=1)
            scores = np.take_along_axis(every, best, axis=1)
    q, c = np.nonzero(scores > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(scores[q, c]), pa.array(ranks[q, c])], names=["q", "score", "place"])


def probes_for(vectors: DataFrame, questions: DataFrame, lists: Lists, k: int, recall: float, least: int) -> int:
    """How many lists to scan for each query, at least ``least``, so that they hold ``recall`` of the ``k`` true neighbours of sampled queries."""
    if len(lists.centres) <= least:
        return least
    sample = [bytes(r["raw"]) for r in questions.orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).select("raw").collect()]
    if not sample:
        return least
    best = Window.partitionBy("q").orderBy(F.desc("score"), "place")
    places = (vectors.select("raw").mapInArrow(partial(_true_ranks, lists=lists, sample=sample, k=k), "q int, score float, place int")
              .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("place").count().orderBy("place").collect())
    held, total = 0, sum(r["count"] for r in places)
    for r in places:
        held += r["count"]
        if held >= recall * total:
            return max(least, r["place"] + 1)
    return least


def scan(query: np.ndarray, turned: np.ndarray, k: int, confidence: float = 2.1) -> np.ndarray:
    """Places of about the ``k`` rotated unit vectors next to a query, found block of columns by block of columns.

    After d of D dimensions a candidate's distance is estimated from the part seen. It is dropped if the estimate
    exceeds the k-th best full distance by more than the test at that ``confidence`` allows.
    """
    m, dims = turned.shape
    live = np.arange(m)
    partial_sums = np.zeros(m, dtype=np.float32)
    bound = np.inf
    for d in range(0, dims, COLUMNS):
        part = turned[live, d:d + COLUMNS] - query[d:d + COLUMNS]
        partial_sums = partial_sums + np.einsum("ij,ij->i", part, part)
        seen = min(d + COLUMNS, dims)
        if seen == dims or len(live) <= k:
            continue
        if bound == np.inf:  # the best so far, in full
            first = live[np.argpartition(partial_sums, k - 1)[:k]]
            bound = float(((turned[first] - query) ** 2).sum(axis=1).max())
        good = partial_sums * (dims / seen) <= bound * (1 + confidence / math.sqrt(seen)) ** 2
        live, partial_sums = live[good], partial_sums[good]
    if len(live) > k:
        live = live[np.argpartition(partial_sums, k - 1)[:k]]
    return live


def _search(key, ours: pa.Table, theirs: pa.Table, lists, k):
    out = [[], [], []]
    if ours.num_rows and theirs.num_rows:
        queries, vectors = _matrix(ours.column("raw")), _matrix(theirs.column("raw"))
        turned, asked = lists.turned(vectors), lists.turned(queries)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        raws, ids = ours.column("raw").to_pylist(), theirs.column("ids").to_pylist()
        for q in range(len(queries)):
            near = scan(asked[q], turned, 2 * k + 8)
            score = vectors[near] @ queries[q] / (norms[near] * math.sqrt(float(queries[q] @ queries[q])))
            least = np.array([ids[c][0] for c in near])
            for p in np.lexsort((least, -score))[:k]:
                out[0].append(raws[q]), out[1].append(ids[near[p]]), out[2].append(float(score[p]))
    return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.float64())], names=["raw", "ids", "score"])


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, probes: int = 48, sample_per_list: int = 64,
                    seed: int = 11, recall: float = 0.96) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest cosine to each row of ``queries`` (rows of the same table), the row itself aside.

    Gives ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the cosine in double precision on the vectors as they are;
    equal scores go by the smaller key. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those whose length is not the most frequent one. Rows with the same vector are searched once and
    keep their ``k + 1`` least keys, which is all that k neighbours can need. Fewer rows than k give all; an empty table gives none.

    There are about as many lists as the root of the number of vectors, up to 4096, with centres from a sample of
    ``sample_per_list`` vectors each. Every vector is in one list; at least ``probes`` lists are scanned for each query. Where there are more,
    the neighbours of 256 queries are first looked for among all vectors, and as many lists are scanned for every query as hold
    the share ``recall`` of these. A list or the queries for it beyond 4096 are dealt to several tasks. Approximate: neighbours
    in lists that are not probed, or that the test drops, are missed. The library's records have no vectors, so this works on any table with some.
    """
    values = lambda frame: frame.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0) & F.col("id").isNotNull())
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    dims = values(vectors).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], out)
    raw = lambda frame: values(frame).where(F.size("v") == dims["d"]).mapInArrow(partial(_raw, key_at=0), "id long, raw binary")
    least = Window.partitionBy("raw").orderBy("id")
    distinct = cut_lineage(raw(vectors).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
                           .groupBy("raw").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = cut_lineage(raw(queries))
    questions = asked.select("raw").distinct()
    n = distinct.count()
    count = int(min(MOST_LISTS, max(1, round(math.sqrt(n)))))
    share = min(1.0, count * sample_per_list / n)
    sample = distinct.where(F.pmod(F.xxhash64("raw"), F.lit(1 << 30)) <= share * float(1 << 30)).select("raw").toPandas()["raw"]  # bounded by the number of lists
    if not len(sample):
        sample = distinct.select("raw").limit(1).toPandas()["raw"]
    lists = Lists(np.frombuffer(b"".join(sample), dtype="<f8").reshape(len(sample), -1), count, seed)
    probes = probes_for(distinct, questions, lists, k, recall, probes)

    def blocks(frame, probes):
        rows = frame.select("raw").mapInArrow(partial(_listed, lists=lists, probes=probes, dealt=None, other=None, names=["list"]), "list int").groupBy("list").count().collect()
        sizes = np.zeros(len(lists.centres), dtype=np.int64)
        for r in rows:
            sizes[r["list"]] = r["count"]
        return np.maximum(1, -(-sizes // BLOCK))

    of_vectors, of_queries = blocks(distinct, 1), blocks(questions, probes)
    head = "list int, {} int, {} int, "
    theirs = distinct.mapInArrow(partial(_listed, lists=lists, probes=1, dealt=of_vectors, other=of_queries, names=["list", "block", "part", "raw", "ids"]), head.format("block", "part") + "raw binary, ids array<long>")
    ours = questions.mapInArrow(partial(_listed, lists=lists, probes=probes, dealt=of_queries, other=of_vectors, names=["list", "part", "block", "raw"]), head.format("part", "block") + "raw binary")
    found = (ours.groupBy("list", "block", "part").cogroup(theirs.groupBy("list", "block", "part"))
             .applyInArrow(partial(_search, lists=lists, k=k + 1), "raw binary, ids array<long>, score double"))
    best = Window.partitionBy("raw").orderBy(F.desc("score"), F.element_at("ids", 1))
    kept = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("raw").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    every = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("low"), i.alias("vec_id")))))
    ranked = F.slice(F.array_sort(F.filter(every, lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
    return (asked.withColumnRenamed("id", "query_id").join(kept, "raw").select("query_id", F.posexplode(ranked).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.low")).alias("score")))
