"""Filling containers of fixed capacity: best-fit decreasing per partition, certified by lower bounds, with exchange of what is left.

Pieces (whole texts; a text beyond the capacity is cut) are spread evenly over
partitions, each packed by best-fit decreasing. Dual feasible functions give a
lower bound of its number of containers: a partition that reaches it can't be
packed better, and gives up only its emptiest container; one that doesn't gives
up every container with a gap. What was given up is exchanged between
partitions (spread anew by another hash) and packed again, until it fits one
partition or the rounds end. Each partition holds a bounded number of sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.tokens import chunks, encoder
from semloom.session import col, shared_folder

#: Pieces of a partition at most (some hundred megabytes), and how few are still worth a partition of their own while tasks are free.
PIECES, FEW = 2_000_000, 50_000
ROUNDS = 4


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound that the dual feasible functions give for the number of containers."""
    return histogram_bound(np.bincount(sizes, minlength=capacity + 1), capacity)


def histogram_bound(count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of the number of pieces of each size from 0 to the capacity."""
    count = count.astype(np.int64)
    count[0] = 0
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    number, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * x)])
    upto = lambda cum, a, b: cum[np.maximum(b + 1, a)] - cum[a]  # noqa: E731  of sizes from a to b
    # Sizes over capacity - t count as a whole container, those under t as nothing.
    t = np.arange(1, capacity // 2 + 1)
    big = upto(number, capacity - t + 1, np.full_like(t, capacity))
    mid = upto(total, t, capacity - t)
    best = max(best, int((big + -(-mid // capacity)).max()))
    for k in range(1, 33):
        # x(k+1)/C where it is whole counts as it is, else it is rounded down to a k-th.
        whole = (x * (k + 1)) % capacity == 0
        value = np.where(whole, x * k, (x * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each piece, its offset there) by best-fit decreasing; equal sizes in their order."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r is set where a container has room r
    bins = np.empty(len(sizes), np.int64)
    offset = np.empty(len(sizes), np.int64)
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        m = open_ >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b, made = capacity, made, made + 1
        bins[i], offset[i] = b, capacity - r
        r -= n
        room[r].append(b)
        open_ |= 1 << r
    return bins, offset


def _pack(capacity: int, level: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [*batches]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["id", "piece"], kind="stable", ignore_index=True)
        sizes = rows["n"].to_numpy()
        bins, offset = best_fit(sizes, capacity)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        gap = capacity - used
        give = np.zeros(len(used), bool)
        if not last:
            if len(used) == lower_bound(sizes, capacity):
                give[np.argmax(gap)] = gap.max() > 0
            else:
                give = gap > 0
        rows["bin"] = np.where(give[bins], -1, bins)
        rows["offset"] = offset
        rows["level"] = level
        yield rows[["id", "piece", "start", "n", "bin", "offset", "level"]]

    return run


def token_sizes(df: DataFrame, row_id: str, text: str, vocabulary: str) -> DataFrame:
    """(id, n): the number of tokens of each row's text, 0 for a null or an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            sizes = [np.diff(enc.encode(texts[i:j])[1]) for i, j in chunks(texts)]
            yield pd.DataFrame({"id": b["id"], "n": np.concatenate(sizes) if sizes else []})

    return df.select(col(row_id).cast("long").alias("id"), col(text).cast("string").alias("text")).mapInPandas(run, "id long, n long")


def pack(sizes: DataFrame, capacity: int = 2048, pieces: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """(id, piece, start, n, container, place, offset) of every piece of (id, n).

    A row of size 0 needs no room: one piece with null container, place and
    offset. A row beyond the capacity is cut into full pieces and a rest; no
    other row is cut. ``start`` is where the piece begins in its row, ``place``
    (from 1) and ``offset`` where it stands in the container. ``id`` has to be
    unique; a null id or size is taken as a row of size 0.
    """
    shared_folder(sizes.sparkSession)
    number = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    cut = sizes.select("id", F.coalesce("n", F.lit(0)).alias("n")).select("id", "n", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    todo = cut.select("id", "piece", (F.col("piece") * capacity).cast("long").alias("start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n"))
    todo = todo.checkpoint()  # the sizes are costly, and the number of partitions depends on them
    none, filled = todo.where("n = 0 or id is null"), todo.where("n > 0 and id is not null")
    # A piece that fills a container alone needs no search.
    full = filled.where(F.col("n") == capacity)
    done = full.select("id", "piece", "start", "n", F.lit(0).cast("long").alias("offset"), F.concat_ws("-", F.lit("f"), "id", "piece").alias("container"))
    rest = filled.where(F.col("n") < capacity)
    kind = "id long, piece int, start long, n long, bin long, offset long, level int"
    free = sizes.sparkSession.sparkContext.defaultParallelism
    for level in range(rounds):
        count = rest.count()
        # As few partitions as memory allows, as each keeps gaps of its own, but one for each free task.
        parts = max(1, -(-count // pieces), min(free, count // min(FEW, pieces)))
        last = parts == 1 or level == rounds - 1
        spread = rest.repartition(parts, F.xxhash64("id", "piece", F.lit(level)))
        packed = spread.mapInPandas(_pack(capacity, level, last), kind).withColumn("part", F.spark_partition_id()).checkpoint()
        kept = packed.where("bin >= 0")
        done = done.unionByName(kept.select("id", "piece", "start", "n", "offset", F.concat_ws("-", "level", "part", "bin").alias("container")))
        if last:
            break
        rest = packed.where("bin < 0").select("id", "piece", "start", "n")
    place = F.filter(F.array_sort(F.collect_list(F.struct("offset", "id", "piece", "start", "n"))), lambda x: x.isNotNull())
    # A container holds at most ``capacity`` pieces, so this group is bounded.
    placed = done.groupBy("container").agg(place.alias("p")).select("container", F.posexplode("p").alias("place", "p"))
    out = placed.select("p.id", "p.piece", "p.start", "p.n", "container", (F.col("place") + 1).alias("place"), F.col("p.offset").cast("int").alias("offset"))
    empty = none.select("id", "piece", "start", "n", F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("offset"))
    return out.unionByName(empty)


def certificate(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row (containers, bound, pieces, tokens): containers used against the lower bound over all pieces, from a histogram of their sizes."""
    held = packed.where("container is not null")
    sizes = held.groupBy("n").agg(F.count(F.lit(1)).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"n": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64")})])
        count = np.zeros(capacity + 1, np.int64)
        count[rows["n"].to_numpy(np.int64)] = rows["c"].to_numpy(np.int64)
        yield pd.DataFrame({"bound": [histogram_bound(count, capacity)], "pieces": [int(rows["c"].sum())], "tokens": [int((rows["c"] * rows["n"]).sum())]})

    bound = sizes.coalesce(1).mapInPandas(run, "bound long, pieces long, tokens long")
    containers = held.agg(F.countDistinct("container").alias("containers")).scalar()
    return bound.select(containers.alias("containers"), "bound", "pieces", "tokens")

