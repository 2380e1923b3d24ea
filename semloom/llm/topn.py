"""Top N items of every group: a mergeable aggregation with a bounded heap per group.

Before the shuffle each map task keeps a heap of N rows per group. A batch is
first held against the worst row of its group's heap, by array comparison; only
the few rows that beat it, or whose heap isn't full, are pushed. Heaps are given
to the shuffle, so a group of any size sends at most N rows per map task,
whether it is hot or not. When the heaps of a task hold more than ``HOLD`` rows
they are sent on and begun anew, which changes nothing as they are merged later.

After the shuffle the heaps of a group are merged in sorted order: partitions
are sorted by group, score, tie and id, which Spark does with spilling, and the
first N of each run of equal groups are streamed out, so a task holds no more
than a batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.session import col

#: Rows that the heaps of one map task hold at most.
HOLD = 500_000


class _Worst:
    """A tie in the order of a heap whose least element is the worst row: null first, then the greater text, then the greater id."""

    __slots__ = ("id", "tie")

    def __init__(self, tie: str | None, ident: int):
        self.tie, self.id = None if tie is None else tie.encode(), ident

    def __lt__(self, other: _Worst) -> bool:
        if self.tie != other.tie:
            return self.tie is None if (self.tie is None or other.tie is None) else self.tie > other.tie
        return self.id > other.id

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Worst) and (self.tie, self.id) == (other.tie, other.id)


class Heaps:
    """A heap of the N best rows for each group."""

    def __init__(self, n: int):
        self.n = n
        self.of: dict[str, list[tuple[float, _Worst, str | None]]] = {}
        self.rows = 0

    def push_batch(self, batch: pa.RecordBatch) -> None:
        group = batch.column("g").dictionary_encode()
        names, index = group.dictionary.to_pylist(), group.indices.to_numpy(zero_copy_only=False)
        score = batch.column("score").to_numpy(zero_copy_only=False)
        # The score that a row has to reach to change its group's heap; within the batch itself no more than N of a group can.
        least = np.full(len(names), -np.inf)
        for i, name in enumerate(names):
            heap = self.of.get(name)
            if heap is not None and len(heap) == self.n:
                least[i] = heap[0][0]
        able = np.flatnonzero(score >= least[index])
        order = able[np.lexsort((-score[able], index[able]))]
        own = index[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(own)])
        # Rows of a group below its N-th score in this batch are beaten by N others.
        nth = np.where(size >= self.n, score[order[np.minimum(starts + self.n - 1, max(len(own) - 1, 0))]] if len(own) else 0, -np.inf)
        order = order[score[order] >= np.repeat(nth, size)]
        picked = batch.take(pa.array(order))
        for name, value, tie, ident in zip((names[i] for i in index[order]), score[order].tolist(), picked.column("tie").to_pylist(), picked.column("id").to_pylist()):
            heap = self.of.setdefault(name, [])
            item = (value, _Worst(tie, ident), tie)
            if len(heap) < self.n:
                heapq.heappush(heap, item)
                self.rows += 1
            elif heap[0] < item:
                heapq.heapreplace(heap, item)

    def drain(self) -> Iterator[pa.RecordBatch]:
        flat = [(g, v, t, w.id) for g, heap in self.of.items() for v, w, t in heap]
        self.of, self.rows = {}, 0
        for i in range(0, len(flat), 10_000):
            g, v, t, d = zip(*flat[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(v, pa.float64()), pa.array(t, pa.string()), pa.array(d, pa.int64())], names=["g", "score", "tie", "id"])


def _before(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(n)
        for batch in batches:
            heaps.push_batch(batch)
            if heaps.rows > HOLD:
                yield from heaps.drain()
        yield from heaps.drain()

    return run


def _after(n: int):
    """The first ``n`` of each run of equal groups of sorted rows; the run that a batch ends with goes on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g")
            new = np.r_[True, pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)]
            starts = np.flatnonzero(new)
            place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.r_[starts, batch.num_rows])) + 1
            if g[0].as_py() == last:
                end = starts[1] if len(starts) > 1 else batch.num_rows
                place[:end] += held
            last, held = g[-1].as_py(), int(place[-1])
            kept = place <= n
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(kept)), pa.array(place[kept].astype(np.int32))], names=["id", "place"])

    return run


def top_n(df: DataFrame, group: str, score: str, tie: str, row_id: str, n: int, place: str = "place") -> DataFrame:
    """(row_id, place from 1) of the ``n`` rows of highest score of each group.

    Ties go to the smaller ``tie`` text in byte order, null last, then to the
    smaller ``row_id``, which has to be unique. Groups that are null or empty and
    rows whose score is null or NaN take no part; -0.0 equals 0.0. A group of
    fewer than ``n`` rows gives all of them. Groups are compared as they stand.
    Other columns are ignored, so their names can't clash.
    """
    rows = df.select(
        col(group).cast("string").alias("g"), (col(score).cast("double") + F.lit(0.0)).alias("score"), col(tie).cast("string").alias("tie"), col(row_id).cast("long").alias("id")
    ).where("g <> '' and score is not null and not isnan(score)")
    heaps = rows.mapInArrow(_before(n), "g string, score double, tie string, id long")
    order = [F.col("g"), F.col("score").desc(), F.col("tie").asc_nulls_last(), F.col("id")]
    merged = heaps.repartition("g").sortWithinPartitions(*order).mapInArrow(_after(n), "id long, place int")
    return merged.select(F.col("id").alias(row_id), F.col("place").alias(place))
