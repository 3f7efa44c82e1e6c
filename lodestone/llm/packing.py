"""Best-fit packing of token sequences, bulk-synchronous.

Documents become the ids of their text by the tokenizer's vocabulary and the end id. Longer ones than ``CAPACITY`` are
cut into pieces of that length, of which the first may be shorter. Pieces are dealt to lanes of about ``LANE`` pieces, evenly
and whatever they hold, and all lanes are packed at once, each by one task:

1. The lane's pieces and its gaps are kept sorted by length, as runs of equal lengths.
2. From the longest run of pieces down, a sweep finds the successor among the gaps, the smallest that holds the length;
   pieces of a run differ only in rank, so rank decides which of them gets which gap.
3. Gaps shrink by what they took, and the sweep goes on until the run is placed, opening new sequences where no gap is left.

The sequence that a lane opened last has had the fewest pieces to fill it: its pieces are released, and those of all lanes
are dealt out anew and packed in a next round, until a round has one lane. So lanes cost no sequences, the rounds shrink by a
factor of ``LANE / CAPACITY`` at least, and neither a task nor the driver holds more than a lane.

Null and empty texts: the end id alone. Long texts are tokenized whole. Repeated rows are packed each; ties are broken by
order of arrival. No documents: no rows. Only the id and the text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import groups, shared, textbuf

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs, about.
LANE = 1 << 15

_LOADED: dict = {}


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others in order from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def encoder(path: str, pattern: str):
    """A function from texts to lists of ids, for a byte-level vocabulary file of the tokenizers library.

    The file's own vocabulary is merged by tiktoken, which gives the same ids several times faster: ids are ranks of
    merges. Texts that it can't take go through the tokenizers library.
    """
    if path not in _LOADED:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        _LOADED[path] = fast, set(special)
    fast, special = _LOADED[path]

    def plain(text: str) -> list[int]:
        if ("plain", path) not in _LOADED:
            from tokenizers import Tokenizer

            _LOADED["plain", path] = Tokenizer.from_file(path)
        return _LOADED["plain", path].encode(text, add_special_tokens=False).ids

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            try:
                out.append(fast.encode(t, allowed_special=special, disallowed_special=()))
            except ValueError:  # its pattern matcher gave up
                out.append(plain(t))
        return out

    return encode


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids begin."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


def tokenize(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str, text: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row a piece; ids (little-endian 32-bit) only if asked for."""
    source = docs.select(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    fields = [f for f in PIECE.fields if with_ids or f.name != "ids"]
    schema = T.StructType([source.schema[0], *fields])

    def run(batches):
        encode = encoder(tokenizer, pattern)
        for batch in batches:
            for part in textbuf.slices(batch, 1):
                row, out = [], []
                for k, ids in enumerate(encode(part.column(1).to_pylist())):
                    a = np.array([*ids, end_id], dtype="<u4")
                    cuts = cut_points(len(a), capacity)
                    for p, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(a)], strict=True)):
                        body = a[s:e].tobytes()
                        row.append(k)
                        out.append((p, s, e - s, zlib.crc32(body), *([body] if with_ids else [])))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]], names=schema.names)

    return source.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): best fit, longest first, by runs of equal lengths."""
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    sizes: list[int] = []  # the gaps that there are, sorted
    opened = 0

    def give(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            runs = gaps[gap]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + number)
            else:
                runs.append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)
            if k == len(sizes):  # no gap holds it: as many new sequences as are filled with this length
                number = -(-left // (capacity // length))
                give(capacity, opened, number)
                opened += number
                continue
            gap = sizes[k]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(k)
            take = min(left, number)
            out.append((length, rank, take, first, capacity - gap))
            give(gap, first + take, number - take)
            give(gap - length, first, take)
            rank, left = rank + take, left - take
    return out


def pack_lane(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, sequences numbered as they are opened."""
    order = np.argsort(length, kind="stable")
    first = dict(zip(*np.unique(length[order], return_index=True), strict=True))
    sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
    for size, rank, number, to, at in plan(dict(zip(*(x.tolist() for x in np.unique(length, return_counts=True)), strict=True)), capacity):
        own = order[first[size] + rank : first[size] + rank + number]
        sequence[own] = to + np.arange(number)
        offset[own] = at
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, lane: int = LANE) -> DataFrame:
    """A row a piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    if lane < 2 * capacity:
        raise ValueError("a lane must be able to hold twice the pieces of a sequence")
    left = shared.cut(tokenize(docs, tokenizer, pattern, doc_id, text, capacity, end_id, with_ids))
    names = left.columns
    schema = T.StructType([*left.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("released", T.BooleanType())])
    done, turn = None, 0
    while True:
        lanes = max(1, -(-left.count() // lane))

        def run(batches, lanes=lanes, turn=turn):
            for table in groups.keyed_runs(batches, ["__lane"]):
                table = table.combine_chunks()
                keys = table.column("__lane").to_numpy()
                edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for s, e in zip(edge[:-1], edge[1:], strict=True):
                    part = table.slice(s, e - s)
                    sequence, offset = pack_lane(part.column("length").to_numpy(), capacity)
                    released = (sequence == sequence.max()) & (lanes > 1)
                    number = (turn << 58) + (int(keys[s]) << 22) + sequence
                    made = pa.Table.from_arrays([*[part.column(n) for n in names], pa.array(number), pa.array(offset), pa.array(released)], names=schema.names)
                    yield from made.to_batches(max_chunksize=4096)

        # numbers of rows of a written table: rows that are alike in all columns are dealt out too
        dealt = left.withColumn("__lane", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)))
        packed = shared.cut(dealt.repartition("__lane").sortWithinPartitions("__lane").mapInArrow(run, schema))
        settled = packed.where("not released").drop("released")
        done = settled if done is None else done.unionAll(settled)
        if lanes == 1:
            return done
        left, turn = packed.where("released").select(*names), turn + 1
