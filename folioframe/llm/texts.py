"""Steps that the text operators share."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BY = ("doc_id", "page_no")
# Characters that one step of a text operator holds at once; a longer text is a step of its own.
STEP_CHARS = 1 << 18
# Characters of a key worth remembering.
LONG_KEY = 256


def slices(batch: pa.RecordBatch, lengths: Sequence[int], most: int = STEP_CHARS):
    """Consecutive slices of a batch with about ``most`` characters each."""
    start = held = 0
    for at, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start, batch.num_rows - start)


def annotate(frame: DataFrame, carry: Sequence[str], text: str, fields: T.StructType,
             work: Callable[[list[str | None]], list[pa.Array]], most: int = STEP_CHARS, owner: str = "") -> DataFrame:
    """``carry`` columns of every row and the columns that ``work`` makes from its text, without a shuffle.

    ``work`` gets the texts of a few rows (None where null) and gives one array for each of ``fields``.
    New columns take the place of carried ones of the same name. Memories of other owners than ``owner`` are given up.
    """
    carry = [c for c in dict.fromkeys(carry) if c not in fields.names]
    slim = frame.select(*carry, F.col(text).cast("string").alias("__text"))
    if text in carry:
        slim = slim.drop("__text")
    at = carry.index(text) if text in carry else len(carry)
    schema = T.StructType([f for f in slim.schema.fields if f.name != "__text"] + fields.fields)
    names, width = schema.names, len(carry)

    def run(batches):
        release(owner)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
            for part in slices(batch, sizes, most):
                yield pa.RecordBatch.from_arrays(part.columns[:width] + work(part.column(at).to_pylist()), names=names)

    return slim.mapInArrow(run, schema)


_MEMOS: list[weakref.ref] = []


def release(owner: str) -> None:
    """Empty the memories of other owners: a worker that goes on with another operator needs the room."""
    for held in _MEMOS:
        memo = held()
        if memo is not None and memo.owner != owner:
            memo.clear()
            memo.older, memo.held = {}, 0


class Memo(dict):
    """Results of a pure function, kept in two generations so that memory stays bounded.

    Long keys weigh more: one for every 16 characters. When ``most`` is held, the results become the older generation and the one before it goes; what is
    still asked for moves back. One with an ``owner`` is emptied when another operator begins (:func:`release`). Results of very long keys are made anew each time. Workers live on from task to task, and so does the memo.
    """

    def __init__(self, make: Callable, most: int, owner: str = ""):
        super().__init__()
        self.make, self.most, self.owner, self.older, self.held = make, most, owner, {}, 0
        if owner:
            _MEMOS.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG_KEY:
                return value
        if self.held >= self.most:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += 1 + (len(key) >> 4)
        return value
