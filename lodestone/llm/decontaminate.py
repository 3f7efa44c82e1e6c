"""Benchmark decontamination by Wu-Manber search for word windows.

Words are the runs of 0-9, a-z and characters beyond ASCII after A-Z are lower-cased. Each benchmark item gives its
windows of ``window`` consecutive words; an item of fewer words, but not none, gives one window of all its words.

The alphabet of the search is the word. For each pattern length the table ``shift`` maps the hash of a block of two
words to the distance by which a cursor may move on when it reads that block at the end of its window; blocks that no
pattern holds move it by all but one word of the pattern. Where the shift is 0, the hash of the last block selects a
bucket of patterns, whose words are compared by hash and then directly, byte by byte. Documents are cut into runs of
window ends, whose cursors move in step, so that one numpy call serves thousands of cursors.

Patterns go to the executors in blocks of about ``MAX_PATTERN_BYTES`` of benchmark text; a larger benchmark takes several
narrow passes without a shuffle, each written to the shared folder before the next block's tables are built, so neither the
driver nor a task holds more than one block's. Hot passages cost what their words cost: a document's hits are
one bit a word, and nothing is gathered by pattern.

Nulls, empty texts: no words, no hits. Null items and items without words: no patterns. Repeated rows are each judged.
Equal windows of several items count for each of these items, which are listed as sorted strings; a repeated item id is one
item. An empty benchmark leaves all documents clean; no documents, no rows. Texts are searched whole, a long one as a slice
of its own. An input column whose name (in any case) is that of an output is replaced by it; ``remove_contaminated`` returns
the documents' own columns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import shared, textbuf

WINDOW = 10
MAX_PATTERN_BYTES = 16 << 20
#: Window ends for which one cursor is responsible.
RUN = 256
_PAIR = np.uint64(0xD6E8FEB86659FD93)

OUTPUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])


def item_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def word_hash(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return textbuf.span_hashes(textbuf.prefix_hashes(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return textbuf.mix(first * _PAIR + second)


def block_hash(words: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Of the block of words that ends at each position."""
    return words[at] if block == 1 else pair_hash(words[at - 1], words[at])


class Patterns:
    """The tables for all patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.texts = [b" ".join(p) for p in patterns]
        self.items = [sorted(v) for v in patterns.values()]
        self.words = word_hash([w for p in patterns for w in p]).reshape(-1, length)
        bits = min(24, max(12, int(8 * len(patterns) * length).bit_length()))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, dtype=np.int16)
        for j in range(self.block - 1, length):
            last = self.words[:, j] if self.block == 1 else pair_hash(self.words[:, j - 1], self.words[:, j])
            np.minimum.at(self.shift, (last >> self.down).astype(np.int64), np.int16(length - 1 - j))
        self.order = np.argsort(last, kind="stable")
        self.keys = last[self.order]

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Window ends at which the shift is 0."""
        counts = np.maximum(0, np.diff(bounds) - self.length + 1)
        runs = -(-counts // RUN)
        owner = np.repeat(np.arange(len(counts)), runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = bounds[owner] + self.length - 1 + nth * RUN
        stop = np.minimum(at + RUN, bounds[owner + 1])
        found = []
        while len(at):
            step = self.shift[(block_hash(words, at, self.block) >> self.down).astype(np.int64)]
            if (zero := step == 0).any():
                found.append(at[zero])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, patterns) of all occurrences."""
        at = self.candidates(words, bounds)
        last = block_hash(words, at, self.block)
        lo, hi = np.searchsorted(self.keys, last, "left"), np.searchsorted(self.keys, last, "right")
        n = hi - lo
        first = np.repeat(at - self.length + 1, n)
        which = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        for j in range(self.length):  # most fall at the first word
            same = words[first + j] == self.words[which, j]
            first, which = first[same], which[same]
        same = np.fromiter((b" ".join([data[start[k] : end[k]].tobytes() for k in range(f, f + self.length)]) == self.texts[p] for f, p in zip(first.tolist(), which.tolist(), strict=True)), dtype=bool, count=len(first))
        return first[same], which[same]


def build(rows: list[tuple[str, str]], window: int) -> list[Patterns]:
    by_length: dict[int, dict] = {}
    for item, text in rows:
        words = item_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add(item)
    return [Patterns(n, p) for n, p in sorted(by_length.items())]


def search(column: pa.Array, tables: list[Patterns]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Where each row's words begin, which words are hit, and the (row, item) pairs."""
    raw, offsets = textbuf.flat(column)
    data = textbuf.lower_table()[raw]
    start, end, bounds = textbuf.word_spans(data, offsets)
    words = textbuf.span_hashes(textbuf.prefix_hashes(data), start, end)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    pairs: set[tuple[int, str]] = set()
    for t in tables:
        first, which = t.search(data, start, end, words, bounds)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + t.length, -1)
        row = np.searchsorted(bounds, first, "right") - 1
        seen = np.unique(row * len(t.texts) + which)
        pairs.update((r, i) for r, p in zip((seen // len(t.texts)).tolist(), (seen % len(t.texts)).tolist(), strict=True) for i in t.items[p])
    return bounds, np.cumsum(edge)[:-1] > 0, sorted(pairs)


def spans_of(hit: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of hit words: (row, first word, word after), words counted within their row."""
    n = len(hit)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    inside = np.concatenate([[False], hit, [False]])
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    row = np.searchsorted(bounds, start, "right") - 1
    return row, start - bounds[row], end - bounds[row]


def _lists(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``keep`` columns (default: all) of docs with n_words, n_hit, hit_spans (word positions) and items (sorted as strings)."""
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // max_pattern_bytes))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in OUTPUT.fields}]
    state = T.StructType([T.StructField(f"__state{k}", f.dataType) for k, f in enumerate(OUTPUT.fields)])
    names = [f.name for f in state.fields]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__searched"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in state.fields])
    for k in range(blocks):
        tables = build([tuple(r) for r in items.where(F.expr(f"pmod(xxhash64(i), {blocks}) = {k}")).collect()], window)
        schema = out.schema

        def run(batches, tables=tables, schema=schema):
            for batch in batches:
                for part in textbuf.slices(batch, schema.names.index("__searched")):
                    bounds, hit, pairs = search(part.column("__searched"), tables)
                    if part.column(names[2]).null_count < part.num_rows:  # an earlier block's spans
                        for r, spans in enumerate(part.column(names[2]).to_pylist()):
                            for s in spans or ():
                                hit[bounds[r] + s["start"] : bounds[r] + s["end"]] = True
                        pairs = sorted({*pairs, *((r, i) for r, have in enumerate(part.column(names[3]).to_pylist()) for i in have or ())})
                    n = part.num_rows
                    row, start, end = spans_of(hit, bounds)
                    total = np.concatenate([[0], np.cumsum(hit)])[bounds]
                    made = [pa.array(np.diff(bounds)), pa.array(np.diff(total).astype(np.int64)), pa.ListArray.from_arrays(_lists(row, n), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])), pa.ListArray.from_arrays(_lists(np.array([r for r, _ in pairs], dtype=np.int64), n), pa.array([i for _, i in pairs], pa.string()))]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(schema) - 4], *made], names=schema.names)

        out = out.mapInArrow(run, schema)
        if k + 1 < blocks:
            out = shared.written(out, "searched")
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(s.name).alias(f.name) for s, f in zip(state.fields, OUTPUT.fields, strict=True)])


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a hit word, with their own columns only."""
    names = docs.columns
    aside = docs.toDF(*[f"__in{k}" for k in range(len(names))])
    at = {n.lower(): f"__in{k}" for k, n in enumerate(names)}
    found = find_contamination(aside, items, text=at[options.pop("text", "text").lower()], **options)
    return found.where("n_hit = 0").select(*[F.col(f"__in{k}").alias(n) for k, n in enumerate(names)])
