"""Suffix-array dedup of repeated strings, by a hash-compared suffix sort.

Every byte that a string of ``LENGTH`` bytes covers which also starts earlier (smaller document id, or same document and
further left) is removed; overlaps count, and strings are judged on the input. Texts are UTF-8 bytes, whole.

The suffixes that are sorted are a sample which no repeat can miss. Each string of ``LENGTH`` bytes has an anchor: of its
substrings of ``GRAM`` bytes the one with the smallest hash, the leftmost of equals. Equal strings have equal anchors at
equal offsets, and the strings that share an anchor start in one run of places, so a text has an anchor for every 35
bytes or so. An anchor's context is what its strings cover. Hashes choose anchors and bring them together; what is removed
has always been compared byte by byte (equal texts: by 128 bits of SHA-256).

1. In a slice of texts, anchors whose context equals that of an earlier one, byte by byte, are settled: all their strings
   go. The others meet by their gram, but for those of a gram that the slice has ``MANY`` times, which send one for all; those
   whose gram stands at another place or in another text too go on.
2. Their contexts' bytes are fetched. The anchors of a gram are suffixes, and reversed prefixes, that start at the same
   byte. Equal contexts are folded, the others sorted by mergesort: two are compared by their common extension, found by
   binary search on the differences of polynomial prefix hashes, so a comparison takes log2(LENGTH) steps. Neighbours in
   the order are then compared byte by byte; where a hash collided, the group is sorted again on its bytes. For every split
   of a string into what stands left and right of the anchor, the runs of neighbours with long enough extensions on both
   sides are the groups of equal strings, of which the earliest stays.
3. Grams with more than ``most`` contexts, or ``MANY`` in a slice, such as those of a very common line, are split by longer prefixes: the strings
   whose anchor stands within a quarter of the possible offsets share 83 bytes, and meet by these and are sorted as above;
   where even these are so common, strings meet by all their bytes, the earliest found by partial minima.

Equal texts are folded first: of those of at least ``LENGTH`` bytes all but those of the smallest id are removed whole. A
row is known by its id and its text: rows that repeat both are alike, and of rows of one id with different texts none is
earlier than another, so a string that only they share stays in each. Null ids come after all others, and none of them is
earlier than another. Null and empty texts: nothing to remove. An empty table gives no rows. Columns other than the id and
the text are not read, so their names can't clash; a long text is one slice of its own, whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import groups, shared, textbuf

LENGTH = 100
GRAM = 32
#: Contexts of a gram that one task sorts; more are split by longer prefixes.
MOST = 2048
#: The place of documents without an id: after all others.
LAST = (1 << 63) - 1
#: Modulus of the hashes of contexts: 168 products of it and a byte add up to less than 2**63.
PRIME = (1 << 47) - 115
BASE = 0x1F3D5B79A8C7
_STEP = np.uint64(0xD6E8FEB86659FD93)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of x[i:i + width] for each i."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes (8 or more) from each place on."""
    n = len(data) - gram + 1
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))).view("<u8").ravel()
    h = words[:n] * _STEP
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h ^= h >> np.uint64(29)
        h ^= words[at : at + n]
        h *= _STEP
    return textbuf.mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, place, first start, last start, gram hash, context hash) of all anchors; places within the flat buffer."""
    n = len(data)
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    h = gram_hashes(data, gram)
    at = np.arange(len(h), dtype=np.uint64)
    least = sliding_minimum((h & np.uint64(0xFFFFFFFF00000000)) | at, length - gram + 1)
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = np.flatnonzero(np.arange(len(place)) + length <= offsets[row + 1])
    place, row = place[inside], row[inside]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    p, s, e = place[first], inside[first], inside[last] if len(place) else inside[:0]
    context = (p - s).astype(np.uint64) * _STEP + (e - s).astype(np.uint64)
    for off in [*range(0, length - gram, gram), length - gram]:  # these grams cover the context
        context = textbuf.mix(context * _STEP + h[s + off]) + h[e + off]
    return row[first], p, s, e, h[p], context


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] and data[b:b + size] are equal, for each."""
    out = np.ones(len(a), dtype=bool)
    for at in range(0, len(a), 8192):
        k = slice(at, at + 8192)
        step = np.arange(size[k].max(initial=0))
        inside = step < size[k][:, None]
        last = len(data) - 1
        out[k] = ((data[np.minimum(a[k][:, None] + step, last)] == data[np.minimum(b[k][:, None] + step, last)]) | ~inside).all(axis=1)
    return out


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of these, row by row."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    base = row * (int(end.max()) + 1)  # rows one behind the other
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (base[1:] + start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], (reach - base)[np.append(at[1:], len(row)) - 1]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, doc (the id's place in the order), key (of the text), its first 60 bits, and text."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be of an integer type")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("doc"), value.alias("text"))
    return rows.select("id", "doc", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("key"), textbuf.text_bits(F.col("text")).alias("bits"), "text")


#: States: OPEN and LEAD anchors meet by their gram; a LEAD stands for the OWN ones of its slice and gram, which don't; SPAN: settled.
OPEN, LEAD, OWN, SETTLED = 0, 1, 2, 3
#: Anchors of a slice and gram from which on one is sent as the LEAD of the others.
MANY = 32
#: Text that is searched for anchors at once.
ANCHOR_BYTES = 1 << 21
#: deal: by what rows meet; bits: of the text. Anchors: gram, place and, in one number, the bytes that strings have left of it at most and at least, no key, which contexts get with their bytes. Settled spans: document, start, end and key.
ANCHOR = T.StructType([*[T.StructField(n, T.LongType()) for n in ("deal", "gram", "bits", "place", "more")], T.StructField("state", T.ByteType()), T.StructField("key", T.BinaryType())])


def find_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of all texts; of equal texts of a slice only those of the smallest id."""

    def run(batches):
        for batch in batches:
            for part in textbuf.slices(batch, 2, ANCHOR_BYTES):
                data, offsets = textbuf.flat(part.column(2))
                doc = part.column(0).to_numpy()
                key = np.unique(np.frombuffer(textbuf.flat(part.column(1))[0].tobytes(), dtype="V16"), return_inverse=True)[1].ravel()
                order = np.lexsort((doc, key))
                only = np.ones(len(doc), dtype=bool)
                only[order[1:]] = key[order[1:]] != key[order[:-1]]
                row, p, s, e, h, c = anchors(data, offsets, length, gram)
                on = only[row]
                row, p, s, e, h, c = row[on], p[on], s[on], e[on], h[on], c[on]
                n = len(row)
                if not n:
                    continue
                d, at = doc[row], np.arange(n)
                by = np.lexsort((p, row, d, c, h))
                new = np.ones(n, dtype=bool)
                new[1:] = (h[by][1:] != h[by][:-1]) | (c[by][1:] != c[by][:-1])
                lead = np.empty(n, dtype=np.int64)
                lead[by] = by[np.maximum.accumulate(np.where(new, at, 0))]
                late = np.flatnonzero((d > d[lead]) | ((row == row[lead]) & (p > p[lead])))
                to = lead[late]
                late = late[(p[late] - s[late] == p[to] - s[to]) & (e[late] - s[late] == e[to] - s[to])]
                late = late[same_bytes(data, s[late], s[lead[late]], e[late] - s[late] + length)]
                base = offsets[row]
                of, start, end = merged(row[late], (s - base)[late], (e - base)[late] + length)
                stay = np.ones(n, dtype=bool)
                stay[late] = False
                rest = by[stay[by]]
                new = np.ones(len(rest), dtype=bool)
                new[1:] = h[rest][1:] != h[rest][:-1]
                count = np.diff(np.append(np.flatnonzero(new), len(rest)))[np.cumsum(new) - 1]
                state = np.where(count < MANY, OPEN, np.where(new, LEAD, OWN))
                row, p, s, e, h, base = (x[rest] for x in (row, p, s, e, h, base))
                own = textbuf.mix(h + doc[row].astype(np.uint64) * _STEP + p.astype(np.uint64))
                deal = np.concatenate([np.where(state == OWN, own, h), textbuf.mix(start.astype(np.uint64) + doc[of].astype(np.uint64) * _STEP)])
                columns = [deal.view(np.int64), np.concatenate([h.view(np.int64), doc[of]]), np.concatenate([p - base, start]), np.concatenate([(p - s) << 16 | (p - e), end]), np.concatenate([state, np.full(len(of), SETTLED)]).astype(np.int8)]
                columns = [pa.array(c) for c in columns]
                columns.insert(2, part.column(3).take(pa.array(np.concatenate([row, of]))))
                columns.append(pa.concat_arrays([pa.nulls(len(row), pa.binary()), part.column(1).take(pa.array(of))]))
                yield pa.RecordBatch.from_arrays(columns, names=ANCHOR.names)

    return rows.select("doc", "key", "text", "bits").mapInArrow(run, ANCHOR)


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, centre: int, most: int, left: bool) -> np.ndarray:
    """How many bytes from the centre on, to the right or to the left, rows a and b have in common: binary search by hashes."""
    n = np.zeros(len(a), dtype=np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        to = np.minimum(n + step, most)
        at, end = (centre - to, centre - n) if left else (centre + n, centre + to)
        same = ((prefix[a, end] - prefix[a, at]) - (prefix[b, end] - prefix[b, at])) % PRIME == 0
        n = np.where(same, to, n)
        step >>= 1
    return n


def merge_sort(prefix: np.ndarray, context: np.ndarray, group: np.ndarray, centre: int, most: int, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, common extension with the row before) of the rows, group by group; group: sorted numbers from 0."""
    n = len(group)
    start = np.searchsorted(group, group)
    size = np.bincount(group)[group]
    order = np.arange(n)

    def before(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether row a sorts before row b, and whether they are equal."""
        k = extension(prefix, a, b, centre, most, left)
        at = np.minimum(k, most - 1)
        col = centre - 1 - at if left else centre + at
        return (k < most) & (context[a, col] < context[b, col]), k >= most

    width = 1
    while (active := np.flatnonzero(size > width)).size:
        own = active - start[active]
        run = own // width
        twin = (run ^ 1) * width
        lo = np.minimum(twin, size[active])
        base = lo.copy()
        hi = np.minimum(twin + width, size[active])
        right = (run & 1) == 1
        while (open_ := np.flatnonzero(lo < hi)).size:  # each row's rank in the other run
            mid = (lo[open_] + hi[open_]) // 2
            a, b = order[active[open_]], order[start[active[open_]] + mid]
            less, equal = before(b, a)
            up = less | (equal & right[open_])
            lo[open_] = np.where(up, mid + 1, lo[open_])
            hi[open_] = np.where(up, hi[open_], mid)
        new = order.copy()
        new[start[active] + (run & ~1) * width + own % width + lo - base] = order[active]
        order = new
        width *= 2
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        common[1:] = np.where(group[1:] == group[:-1], extension(prefix, order[1:], order[:-1], centre, most, left), 0)
    return order, common


def direct(context: np.ndarray, order: np.ndarray, group: np.ndarray, centre: int, most: int, left: bool) -> np.ndarray:
    """The common extensions of neighbours, byte by byte."""
    side = context[order][:, centre - most : centre][:, ::-1] if left else context[order][:, centre : centre + most]
    differ = np.concatenate([side[1:] != side[:-1], np.ones((max(0, len(order) - 1), 1), bool)], axis=1) if len(order) > 1 else np.zeros((0, most + 1), bool)
    out = np.zeros(len(order), dtype=np.int64)
    out[1:] = np.where(group[1:] == group[:-1], differ.argmax(axis=1), 0)
    return out


def sort_suffixes(prefix, context, group, centre, most, left):
    """merge_sort(), verified; sorted on the bytes where hashes collided."""
    order, common = merge_sort(prefix, context, group, centre, most, left)
    exact = direct(context, order, group, centre, most, left)
    if not np.array_equal(exact, common):
        side = np.ascontiguousarray(context[:, centre - most : centre][:, ::-1] if left else context[:, centre : centre + most])
        order = np.lexsort((np.unique(side, axis=0, return_inverse=True)[1].ravel(), group))
        exact = direct(context, order, group, centre, most, left)
    return order, exact


def context_hashes(context: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial of each context modulo PRIME."""
    powers = [1]
    for _ in range(context.shape[1] - 1):
        powers.append(powers[-1] * BASE % PRIME)
    out = np.zeros((len(context), context.shape[1] + 1), dtype=np.int64)
    np.cumsum((context.astype(np.int64) + 1) * np.array(powers, dtype=np.int64), axis=1, out=out[:, 1:])
    return out


def _nearest(common: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row the longest extension that it has in common with a neighbour."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def earlier_strings(context: np.ndarray, group: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row at hand, start, end) of what strings cover that stand earlier in their group.

    context: bytes from length - gram before the place; low to high: the bytes that its strings may have left of the place.
    """
    centre, reach = length - gram, length
    whole = np.unique(np.ascontiguousarray(context).view(f"V{context.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    by = np.lexsort((place, row, doc, high, low, whole, group))
    new = np.ones(len(by), dtype=bool)
    new[1:] = np.any([x[by][1:] != x[by][:-1] for x in (group, whole, low, high)], axis=0)
    lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    gone = by[(doc[by] > doc[lead]) | ((row[by] == row[lead]) & (place[by] > place[lead]))]
    found = [(gone, place[gone] - high[gone], place[gone] - low[gone] + length)]
    stay = np.ones(len(by), dtype=bool)
    stay[gone] = False
    # groups of one need no sort
    stay &= (np.bincount(group[stay], minlength=group.max(initial=0) + 1) > 1)[group]
    by = np.lexsort((place, row, doc, group))
    by = by[stay[by]]
    context, doc, row, place, low, high = context[by], doc[by], row[by], place[by], low[by], high[by]
    group = np.unique(group[by], return_inverse=True)[1].ravel()
    n = len(by)
    if n:
        prefix = context_hashes(context)
        right_order, right = sort_suffixes(prefix, context, group, centre, reach, False)
        left_order, left = sort_suffixes(prefix, context, group, centre, centre, True)
        far_right, far_left = _nearest(right, right_order), _nearest(left, left_order)
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
        for a in range(int(low.min()), int(high.max()) + 1):  # bytes left of the anchor
            valid = np.flatnonzero((low <= a) & (a <= high) & (far_left >= a) & (far_right >= length - a))
            if len(valid) < 2:
                continue
            class_r[right_order] = np.cumsum(fresh | (right < length - a))
            class_l[left_order] = np.cumsum(fresh | (left < a))
            key = class_l[valid] * (n + 1) + class_r[valid]
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            first = valid[at][back.ravel()]
            late = doc[valid] > doc[first]
            if (twin := np.flatnonzero(~late & (first != valid))).size:  # another row of the same id, or the same row
                _, at, back = np.unique(np.stack([key, row[valid]], axis=1), axis=0, return_index=True, return_inverse=True)
                late[twin] = (place[valid] > place[valid[at][back.ravel()]])[twin]
            late = valid[late]
            found.append((by[late], place[late] - a, place[late] - a + length))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


SPAN = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
CONTEXT = T.StructType([T.StructField("gram", T.LongType()), T.StructField("key", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("doc", "place", "first", "last")], T.StructField("bytes", T.BinaryType())])


def fetch_contexts(length: int, gram: int):
    """From doc, key, text and a list of anchors asked for to CONTEXT."""
    back, ahead = length - gram, length

    def run(batches):
        for batch in batches:
            for part in textbuf.slices(batch, 2):
                data, offsets = textbuf.flat(part.column(2))
                doc, lists = part.column(0).to_numpy(), part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                g, p, s, e = (lists.flatten().field(k).to_numpy() for k in range(4))
                ok = offsets[row] + e + length <= offsets[row + 1]  # else of another text of the same bits
                row, g, p, s, e = (x[ok] for x in (row, g, p, s, e))
                base = offsets[row]
                for at in range(0, len(g), 16384):
                    k = slice(at, at + 16384)
                    where = (base[k] + p[k])[:, None] + np.arange(-back, ahead)
                    inside = (where >= (base[k] + s[k])[:, None]) & (where < (base[k] + e[k] + length)[:, None])
                    c = np.where(inside, data[np.clip(where, 0, len(data) - 1)], 0).astype(np.uint8)
                    packed = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer((np.arange(len(c) + 1) * (back + ahead)).astype(np.int32)), pa.py_buffer(c.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(g[k]), part.column(1).take(pa.array(row[k])), pa.array(doc[row[k]]), pa.array(p[k]), pa.array(s[k]), pa.array(e[k]), packed], names=CONTEXT.names)

    return run


MEET = ["gram", "low", "part"]


def compare_contexts(length: int, gram: int):
    """From contexts in the order of MEET to the spans of earlier strings."""

    def run(batches):
        for table in groups.keyed_runs(batches, MEET):
            table = table.combine_chunks()
            keys = [table.column(k).to_numpy() for k in MEET]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            group, edges = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(new))
            d, p, s, e, high = (table.column(c).to_numpy() for c in ("doc", "place", "first", "last", "high"))
            low, high = np.maximum(keys[1], p - e), np.minimum(high, p - s)
            key = table.column("key").combine_chunks()
            row = np.unique(np.frombuffer(textbuf.flat(key)[0].tobytes(), dtype="V16"), return_inverse=True)[1].ravel()
            raw = textbuf.flat(table.column("bytes"))[0].reshape(len(new), -1)
            at = 0
            while at < len(edges) - 1:  # some thousands of rows at a time, whole groups
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + 8192, "right")) - 1)
                i, j = edges[at], edges[to]
                own, start, end = earlier_strings(raw[i:j], group[i:j] - group[i], d[i:j], row[i:j], p[i:j], low[i:j], high[i:j], length, gram)
                if len(own):
                    _, lead = np.unique(row[i:j], return_index=True)
                    of, start, end = merged(np.unique(row[i:j], return_inverse=True)[1].ravel()[own], start, end)
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(lead[of] + i)), pa.array(start), pa.array(end)], names=SPAN.names)
                at = to

    return run


def repeated_spans(rows: DataFrame, texts: DataFrame, reps: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(key, start, end) whose bytes are to go; texts: doc, key and text of one row a text at least."""
    found = find_anchors(rows, length, gram).repartition("deal")
    over = "OVER (PARTITION BY deal)"
    several = F.expr(f"min(place) {over} != max(place) {over} OR min(bits) {over} != max(bits) {over}")
    found = found.select("gram", "bits", "key", "place", "more", "state", several.alias("several"), F.expr(f"count(*) {over} > {most} OR max(state) {over} > {OPEN}").alias("common"))
    found = shared.written(found.where(F.col("several") | (F.col("state") != OPEN)).drop("several"), "anchors")
    settled = found.where(F.col("state") == SETTLED).join(reps, "key").where(F.col("gram") == F.col("low")).select("key", F.col("place").alias("start"), F.col("more").alias("end"))
    asked = found.where(F.col("state") != SETTLED).select("gram", "bits", "place", (F.col("place") - F.shiftright("more", 16)).alias("first"), (F.col("place") - F.col("more").bitwiseAND(65535)).alias("last"), "common")

    def contexts(some: DataFrame) -> DataFrame:
        asks = some.groupBy("bits").agg(F.collect_set(F.struct("gram", "place", "first", "last")).alias("asks"))
        return texts.join(asks.hint("shuffle_hash"), "bits").select("doc", "key", "text", "asks").mapInArrow(fetch_contexts(length, gram), CONTEXT)

    centre = length - gram
    columns = ["gram", "low", "part", "high", "key", "doc", "place", "first", "last", "bytes"]
    few = contexts(asked.where("not common")).select("gram", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("part"), F.lit(centre).cast("long").alias("high"), *columns[4:])
    # by longer prefixes: the bytes that all strings with low to high bytes left of the anchor share
    many = contexts(asked.where("common")).repartition("key", "place")
    step = -(-(centre + 1) // 4)
    quarters = F.explode(F.array(*[F.struct(F.lit(at).cast("long").alias("low"), F.lit(min(at + step - 1, centre)).cast("long").alias("high")) for at in range(0, centre + 1, step)]))
    dealt = many.select("*", quarters.alias("q")).select("*", "q.low", "q.high").where("place - last <= high and place - first >= low")
    dealt = dealt.withColumn("part", F.expr(f"xxhash64(substring(bytes, int({centre} - low + 1), int({length} - (high - low))))"))
    sizes = dealt.groupBy(*MEET).agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(sizes, MEET)
    tasks = few.unionAll(dealt.where(F.col("n") <= most).select(*columns))
    near = tasks.repartition(*MEET).sortWithinPartitions(*MEET).mapInArrow(compare_contexts(length, gram), SPAN)
    each = dealt.where(F.col("n") > most).select("key", "doc", "place", "bytes", F.explode(F.expr("sequence(greatest(low, place - last), least(high, place - first))")).alias("left"))
    each = each.select("key", "doc", (F.col("place") - F.col("left")).alias("start"), F.expr(f"substring(bytes, int({centre} - left + 1), {length})").alias("string"))
    least = each.groupBy("string").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    each = each.join(least, "string")
    again = each.where("doc = least").withColumn("first", F.expr("min(start) OVER (PARTITION BY string, key)")).where("start > first")
    each = each.where("doc > least").select("key", "start").unionAll(again.select("key", "start"))
    return settled.unionAll(near).unionAll(each.select("key", "start", (F.col("start") + length).alias("end")))


OUTPUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """One row a document: id, n_bytes, removed (maximal spans, by byte), kept (the remaining bytes)."""
    return remove_repeats_with(docs, doc_id, text, length, gram, most, lambda kept: (kept, pa.binary()), T.BinaryType())


def remove_repeats_with(docs: DataFrame, doc_id: str, text: str, length: int, gram: int, most: int, finish, kind: T.DataType, output: str = "kept") -> DataFrame:
    """As remove_repeats(), with finish(kept bytes)[0] in place of the bytes, so that they need not leave the task."""
    rows = _rows(docs, doc_id, text)
    reps = rows.where(F.octet_length("text") >= length).groupBy("bits", "key").agg(F.min("doc").alias("low"))
    of_bits = reps.groupBy("bits").agg(F.collect_list(F.struct("key", "low")).alias("lows"))  # one, unless 60 bits collide
    marked = rows.join(of_bits.hint("shuffle_hash"), "bits", "left").withColumn("low", F.expr("filter(lows, x -> x.key = key)[0].low")).drop("lows")
    spans = repeated_spans(rows, marked.where("doc = low"), reps.drop("bits"), length, gram, most)
    spans = spans.groupBy(F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long").alias("bits")).agg(F.collect_list(F.struct("start", "end", "key")).alias("found"))
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *OUTPUT.fields[1:3], T.StructField(output, kind)])
    arrow = finish(b"")[1]
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in textbuf.slices(batch, 1):
                data, offsets = textbuf.flat(part.column(1))
                copy = part.column(3).to_numpy(zero_copy_only=False)
                removed, kept = [], []
                for k, spans in enumerate(part.column(2).to_pylist()):
                    body = data[offsets[k] : offsets[k + 1]]
                    if copy[k]:
                        spans = [{"start": 0, "end": len(body)}]
                    if not spans:
                        removed.append([])
                        kept.append(finish(body.tobytes())[0])
                        continue
                    start, end = (np.array([x[n] for x in spans], dtype=np.int64) for n in ("start", "end"))
                    _, start, end = merged(np.zeros(len(start), np.int64), start, end)
                    edge = np.zeros(len(body) + 1, dtype=np.int8)
                    edge[start] += 1
                    edge[end] -= 1
                    removed.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)])
                    kept.append(finish(body[np.cumsum(edge[:-1]) == 0].tobytes())[0])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(removed, shape), pa.array(kept, arrow)], names=schema.names)

    copy = F.coalesce(F.col("doc") > F.col("low"), F.lit(False))
    out = marked.join(spans.hint("shuffle_hash"), "bits", "left").withColumn("spans", F.expr("filter(found, x -> x.key = key)")).select("id", "text", "spans", copy.alias("copy")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", doc_id)


def sha256_of(kept: bytes):
    return hashlib.sha256(kept).hexdigest(), pa.string()
