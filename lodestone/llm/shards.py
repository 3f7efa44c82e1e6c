"""Sharding by a minimax contiguous partition, with DataFrame operations only.

Atomic groups are rows of equal text (by a 64-bit hash; two texts of one hash merely stay together), ordered by that
hash. The capacity is the smallest for which the ordered groups fit into ``shards`` contiguous runs: it is searched
between the mean load and the mean plus the largest group by sections of ``PROBES`` capacities, each checked greedily
(fill a shard until the next group doesn't fit). All probes of a section take a step at a time, in one query on the
prefix sums. Within that capacity the cuts are then set as even as it allows, so that no shard stays empty while
another is full. As cuts are hashes, a row's shard is found by comparing its own hash with the cuts: no join, whatever
a group's size; a group of a third of all rows costs one row after the partial sums.

Prefix sums are kept in bins, the leading bits of the hash, each of about ``BIN`` groups; the driver holds one number a
bin, 2**16 at most. Slots are numbered within (shard, hash of the id) and offset by the counts of earlier parts, so that
no task numbers a whole shard.

Null text: size 8 (no bytes plus the row's 8), grouped with the empty texts, crc32 0. Repeated rows take a slot each.
Long texts are hashed whole. Rows of one id and text tie in any order. An empty table gives no rows. Fewer groups than shards
leave shards empty. An input column whose name (in any case) is that of an output is replaced by it.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm import shared

SHARDS = 24
ROW_BYTES = 8
PROBES = 512
BIN = 512
#: Rows that one task numbers, about.
NUMBERED = 20_000


class Prefixes:
    """Sums of group sizes before each place in the order of the hashes."""

    def __init__(self, groups: DataFrame, count: int):
        self.bits = min(16, max(1, (count // BIN).bit_length()))
        bin_of = (F.shiftright("key", 64 - self.bits) + F.lit(1 << (self.bits - 1))).cast("int")
        order = Window.partitionBy("bin").orderBy("key")
        rows = groups.withColumn("bin", bin_of).withColumn("upto", F.sum("weight").over(order))
        self.bins = shared.cut(rows.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("key", "upto"))).alias("g"), F.sum("weight").alias("total"), F.max("weight").alias("largest")))
        per_bin = {r["bin"]: r for r in self.bins.select("bin", "total", "largest").collect()}
        self.starts = [0]
        for b in range(1 << self.bits):
            self.starts.append(self.starts[-1] + (per_bin[b]["total"] if b in per_bin else 0))
        self.total = self.starts[-1]
        self.largest = max((r["largest"] for r in per_bin.values()), default=0)

    def look_up(self, targets: list[int], pick: str) -> list[tuple[int, int] | None]:
        """For each target (from 1 to the total) the (prefix sum, last hash) that ``pick`` finds among the groups of its bin."""
        asked = []
        for i, t in enumerate(targets):
            b = bisect_left(self.starts, t) - 1  # starts[b] < t <= starts[b + 1]
            asked.append(f"({i}, {b}, {t - self.starts[b]}L)")
        values = self.bins.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(asked)} AS v(i, bin, x)")
        out: list[tuple[int, int] | None] = [None] * len(targets)
        for r in values.join(self.bins, "bin").select("i", "bin", F.expr(pick).alias("s")).collect():
            if r["s"] is not None:
                out[r["i"]] = (self.starts[r["bin"]] + r["s"]["upto"], r["s"]["key"])
        return out

    def reach(self, targets: list[int]) -> list[tuple[int, int | None]]:
        """For each target the largest prefix sum that isn't beyond it, and the last group's hash (None: no group)."""
        out: list[tuple[int, int | None]] = [(0, None)] * len(targets)
        left = {i: min(t, self.total) for i, t in enumerate(targets) if t > 0}
        while left:  # once more for targets before the first group of their bin: the group before stands in an earlier one
            found = self.look_up(list(left.values()), "try_element_at(filter(g, s -> s.upto <= x), -1)")
            again = {}
            for (i, t), got in zip(left.items(), found, strict=True):
                start = self.starts[bisect_left(self.starts, t) - 1]
                if got is not None:
                    out[i] = got
                elif start > 0:
                    again[i] = start
            left = again
        return out

    def after(self, target: int) -> int:
        """The smallest prefix sum that isn't before the target."""
        return 0 if target <= 0 else self.look_up([target], "try_element_at(filter(g, s -> s.upto >= x), 1)")[0][0]


def capacity(p: Prefixes, shards: int) -> int:
    """The smallest capacity for which greedy filling needs no more than the shards."""
    low = max(-(-p.total // shards), p.largest)
    high = -(-p.total // shards) + p.largest
    while low < high:
        probes = sorted({low + (high - low) * k // PROBES for k in range(PROBES)})
        at = [0] * len(probes)
        for _ in range(shards):
            at = [a for a, _ in p.reach([a + c for a, c in zip(at, probes, strict=True)])]
        fit = [c for c, a in zip(probes, at, strict=True) if a >= p.total]
        tight = [c for c, a in zip(probes, at, strict=True) if a < p.total]
        low, high = (max(tight) + 1 if tight else low), (min(fit) if fit else high)
    return low


def cuts(p: Prefixes, shards: int) -> list[int | None]:
    """The hash after which each shard but the last ends; None: before all groups."""
    most = capacity(p, shards)
    least = [p.total]  # the earliest places from which 0, 1, ... shards hold the rest
    for _ in range(shards - 1):
        least.append(p.after(least[-1] - most))
    at, out = 0, []
    for left in range(shards, 1, -1):
        # as even as can be; what is left must fit into the other shards, and a shard takes a group if there is one
        even, need = p.reach([at + -(-(p.total - at) // left), least[left - 1]])
        take = max(even, need, key=lambda x: x[0])
        if take[0] <= at < p.total:
            take = p.reach([p.after(at + 1)])[0]
        at = take[0]
        out.append(take[1])
    return out


def assign_shards(docs: DataFrame, text: str = "text", order_by: str = "doc_id", shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of docs with size, text_crc32, shard and slot."""
    made = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], (F.octet_length(value).cast("long") + ROW_BYTES).alias("size"), F.crc32(value).alias("text_crc32"), F.xxhash64(value).alias("__key"), F.xxhash64(F.col(f"`{order_by}`")).alias("__id"))
    groups = rows.groupBy(F.col("__key").alias("key")).agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    groups = shared.cut(groups)
    count, total = groups.agg(F.count("*"), F.sum("n")).first()
    ends = cuts(Prefixes(groups, count), shards) if count else []
    shard = sum(((F.col("__key") > F.lit(e)).cast("int") if e is not None else F.lit(1) for e in ends), F.lit(0))
    parts = max(8, -(-(total or 0) // (NUMBERED * shards)))
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("__part", F.pmod("__id", F.lit(parts)).cast("int"))
    before = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n")).drop("__n")
    nth = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__id", "__key"))
    numbered = rows.withColumn("__nth", nth).join(before, ["shard", "__part"])
    return numbered.select(*[F.col(f"`{c}`") for c in kept], "size", "text_crc32", "shard", (F.col("__before") + F.col("__nth") - 1).cast(T.LongType()).alias("slot"))
