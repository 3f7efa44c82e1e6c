"""Groups of rows handled by one task each, streamed in the order of a key, and large groups cut into pairs of blocks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, size: str, id_hash, block: int) -> DataFrame:
    """Each row once for every pair of blocks of its group in which it stands: columns lo, hi and own (its block).

    A group of ``size`` rows has ceil(size / block) blocks, dealt by the hash, and every two of its rows stand together in
    the pair (lo, hi) of their blocks; a group of one block has the one pair (0, 0).
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(block))).cast("int")
    own = F.pmod(id_hash, n.cast("long")).cast("int")
    dealt = df.withColumn("__n", n).withColumn("own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return dealt.withColumn("lo", F.least("own", "__other")).withColumn("hi", F.greatest("own", "__other")).drop("__n", "__other")


def keyed_runs(batches, keys: list[str]):
    """Tables of whole groups, from batches in the order of the keys; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = [batch.column(k) for k in keys]
        last = batch.num_rows - 1
        mask = None
        for c in same:
            eq = pc.equal(c, c[last])
            mask = eq if mask is None else pc.and_(mask, eq)
        first = pc.index(mask, pa.scalar(True)).as_py()
        if held and all(held[-1].column(k)[-1] == c[0] for k, c in zip(keys, same, strict=True)) and first == 0:
            held.append(batch)
            continue
        if first or held:
            yield pa.Table.from_batches([*held, batch.slice(0, first)]) if first else pa.Table.from_batches(held)
        held = [batch.slice(first)]
    if held:
        yield pa.Table.from_batches(held)
