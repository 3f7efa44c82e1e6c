"""Connected components of a graph of links, on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared

ROUNDS = 60
#: Links that a task holds at a time.
SLICE = 1 << 19


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component; a[i] and b[i] are linked."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def contracted(links: DataFrame, most: int) -> DataFrame:
    """Of each task's links (u, v), ``most`` at a time: every node that they link to a smaller one, with the smallest that it reaches."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in (*batches, None):
            if held and (batch is None or sum(b.num_rows for b in held) + batch.num_rows > most):
                table = pa.Table.from_batches(held)
                u, v = (table.column(c).to_numpy() for c in ("u", "v"))
                ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
                root = forest(len(ids), at[: len(u)], at[len(u) :])
                moved = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[moved], ids[root[moved]]), table.schema, strict=True)], schema=table.schema)
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)

    return links.mapInArrow(run, links.schema)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most: int = SLICE) -> DataFrame:
    """(id, component) of every id that has a link to another id; component: the smallest id that it can reach.

    Links are contracted within each task first, without a shuffle. If no more than ``most`` are left, by count, one task
    contracts them all, so that few links don't take many rounds over all partitions. Otherwise alternating large-star and
    small-star steps follow on a table of links, cut by checkpoint() after each pair of steps; the number of rounds grows with
    the logarithm of the largest component. Minima are pre-aggregated before the shuffle and joined back by a join whose hot
    keys can be split, so a hub costs a row for each of its links. Both ways give the same rows. Nulls and links of an id to
    itself are dropped, repeated links count once.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    now = shared.cut(contracted(pairs, most))
    seen = None
    for _ in range(ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= most:
            now = shared.cut(contracted(now.coalesce(1), most))
            break
        if state == seen:
            break
        seen = state
        # large star: each node's larger neighbours go to its smallest neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = shared.cut(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
