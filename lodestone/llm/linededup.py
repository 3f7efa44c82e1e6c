"""Line dedup by a deletion-neighbourhood join.

A line is what stands between line feeds, without white space (ASCII) at its ends; blank lines stay and match nothing.
A line is removed if an earlier line is equal, or, for lines of at least ``LEAST_LENGTH`` code points, within edit distance
1 (insert, delete or change one code point). "Earlier" is judged on the input, whether the earlier line stays or not, so of
every group of such lines the earliest stays.

1. Lines become 128-bit BLAKE2b digests in one narrow pass. Equal lines are folded to their first occurrence,
   pre-aggregated, and numbered.
2. Two lines within distance 1 agree on one half, up to the edit. Each line has keys of its halves, for its own length
   and for the next shorter one; only lines that share such a key with another go on.
3. Of these, all variants within the bound are emitted as hashed keys (the line itself, and the line without each of its
   code points, with that point's place) and joined by equality, of the hashes first and then of the variants' own texts:
   lines of one variant and place are within distance 1 of each other, and of the line that is the variant itself. The
   earliest of each such group is the witness against the others, so no pairs are emitted; a group has at most one line
   for each character of the alphabet and place.
4. Each witness is verified by the edit distance of the lines' texts.

The joins are on digests and numbers of folded lines; only the last join, by row, brings back the texts.

A row is known by its id and 60 bits of its text's SHA-256. Rows are ordered by id (nulls last), and rows of one id with
different texts by those bits, so of an equal line in two of them the one with the smaller bits keeps it. Rows that repeat
an id and a text are alike: none is earlier than another. Within a text, lines are ordered by place. Nulls stay null, empty
texts empty, an empty table gives no rows. Texts are read whole, a long one as a slice of its own. An input column whose name
(in any case) is that of an output is replaced by it. A document of which no line is left but that had lines which weren't
blank is dropped by ``drop_emptied``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm import shared, textbuf

LEAST_LENGTH = 20
#: The place of documents without an id: after all others.
LAST = (1 << 63) - 1

KEYS = ["k0", "k1", "k2", "k3"]
#: h1, h2: the digest; again: an equal line stands earlier in the same text, or in another one of the same slice.
PLACED = T.StructType([*[T.StructField(n, T.LongType()) for n in ("doc", "row", "line", "h1", "h2")], T.StructField("again", T.BooleanType())])
LINES = T.StructType([*PLACED.fields, *[T.StructField(k, T.LongType()) for k in KEYS]])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each data[start:end], as two numbers."""
    view = memoryview(np.ascontiguousarray(data))
    made = b"".join(hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(made, dtype=np.int64).reshape(-1, 2)


def rows_of(docs: DataFrame, doc_id: str, text: str, *others) -> DataFrame:
    """doc and row, by which rows are ordered and known, and the text; others: columns of docs."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be of an integer type")
    value = F.col(f"`{text}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("doc"), textbuf.text_bits(value).alias("row"), value.alias("__text"), *others)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in the row, start, end) of all lines that aren't blank, by byte and without white space at their ends."""
    feed = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], feed + 1]))
    row = np.searchsorted(offsets[1:], start, "right")
    # a feed at the end of a text opens an empty line in it, not one of the next text
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feed, "right") - 1])
    start = np.concatenate([offsets[:-1], feed + 1])
    order = np.lexsort((start, owner))
    row, start = owner[order], start[order]
    end = np.append(start[1:] - 1, len(data))
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.where(last, offsets[row + 1], end)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    solid = np.flatnonzero(~np.isin(data, [9, 10, 11, 12, 13, 32]))
    first = np.searchsorted(solid, start)
    after = np.searchsorted(solid, end)
    has = after > first
    return row[has], number[has], solid[first[has]], solid[after[has] - 1] + 1


def half_keys(prefix: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Four keys of each line: prefix and suffix for lines of its own length, and for lines one shorter."""
    c0, c1 = np.searchsorted(points, start), np.searchsorted(points, end)
    n = c1 - c0
    at = np.append(points, prefix.shape[1] - 1)
    keys = []
    for shorter, skip in ((0, 0), (1, 1)):
        family = (n - shorter).astype(np.uint64)
        half = (n - shorter) // 2
        head = textbuf.span_hashes(prefix, start, at[c0 + half])
        tail = textbuf.span_hashes(prefix, at[np.minimum(c0 + half + skip, c1)], end)
        keys += [textbuf.mix(head * np.uint64(0xD6E8FEB86659FD93) + family * np.uint64(2)), textbuf.mix(tail * np.uint64(0xD6E8FEB86659FD93) + family * np.uint64(2) + np.uint64(1))]
    return np.stack(keys, axis=1)


def lines_of(docs: DataFrame, doc_id: str, text: str, least_length: int, with_keys: bool = True) -> DataFrame:
    """A row a line: its row and place, digest, whether it is a repeat, keys of halves (none for short lines)."""
    schema = LINES if with_keys else PLACED

    def run(batches):
        for batch in batches:
            for part in textbuf.slices(batch, 2):
                data, offsets = textbuf.flat(part.column(2))
                owner, number, start, end = line_spans(data, offsets)
                h = digests(data, start, end)
                doc, row = (part.column(k).to_numpy()[owner] for k in (0, 1))
                order = np.lexsort((number, row, doc, h[:, 1], h[:, 0]))
                same = np.zeros(len(h), dtype=bool)
                same[1:] = (h[order[1:]] == h[order[:-1]]).all(axis=1)
                lead = np.empty(len(h), dtype=np.int64)
                lead[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))]
                again = (doc != doc[lead]) | (row != row[lead]) | (number != number[lead])
                columns = [pa.array(doc), pa.array(row), pa.array(number), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(again)]
                if with_keys:
                    points = np.flatnonzero((data & 0xC0) != 0x80)
                    long = np.searchsorted(points, end) - np.searchsorted(points, start) >= least_length
                    keys = np.zeros((len(start), 4), dtype=np.uint64)
                    keys[long] = half_keys(textbuf.prefix_hashes(data), points, start[long], end[long])
                    columns += [pa.array(keys[:, k].view(np.int64), mask=~long) for k in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows_of(docs, doc_id, text).mapInArrow(run, schema)


VARIANTS = T.StructType([T.StructField("variant", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("lid", T.LongType()), T.StructField("content", T.StringType())])


def variants(content: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line (place -1) and of the line without each code point, with that point's place."""
    data = np.frombuffer(content.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(data)
    up, down = textbuf._powers(max(2, n))
    out = np.zeros(n + 1, dtype=np.uint64)
    for power, inverse in zip(up, down, strict=True):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(textbuf.residues(data * power[:n]), out=total[1:])
        without = total[:-1] + textbuf.residues(total[-1] - total[1:]) * np.uint64(inverse[1])
        out = out << np.uint64(31) | textbuf.residues(np.append(total[-1:], without))
    return textbuf.mix(out), np.arange(-1, n, dtype=np.int32)


def removed_lines(docs: DataFrame, doc_id: str, text: str, source: DataFrame, least_length: int) -> DataFrame:
    """(doc, row, line numbers to remove); source: doc, row, __text and what else goes with them, of docs.

    The texts are taken from source with all its columns, so that the caller's own join can use the same shuffle.
    """
    lines = lines_of(docs, doc_id, text, least_length)
    folded = lines.where("not again").groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "line")).alias("first"), *[F.first(k).alias(k) for k in KEYS])
    # the numbers are those of the table once it is written
    folded = shared.written(folded.withColumn("lid", F.monotonically_increasing_id()), "lines")
    keyed = folded.where("k0 is not null").select("lid", F.explode(F.array(*KEYS)).alias("key")).repartition("key")
    common = keyed.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high")).where("low != high").select("key")
    some = keyed.join(common, "key", "left_semi").select("lid").distinct().join(folded.select("lid", "h1", "h2", "first"), "lid")
    asked = some.groupBy("first.doc", "first.row").agg(F.sort_array(F.collect_list(F.struct("first.line", "h1", "h2", "lid"))).alias("asked"))

    def emit(batches):
        for batch in batches:
            for part in textbuf.slices(batch, 0):
                data, offsets = textbuf.flat(part.column(0))
                owner, number, start, end = line_spans(data, offsets)
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                out = [[], [], [], []]
                size = 0
                for k, wanted in enumerate(part.column(1).to_pylist()):
                    at = {int(number[i]): i for i in range(cut[k], cut[k + 1])}
                    for w in wanted:
                        i = at.get(w["line"])
                        if i is None or digests(data, start[i : i + 1], end[i : i + 1]).tolist() != [[w["h1"], w["h2"]]]:
                            continue  # another text of the same id and bits
                        content = data[start[i] : end[i]].tobytes().decode()
                        v, place = variants(content)
                        out[0].append(v)
                        out[1].append(place)
                        out[2].append(np.full(len(v), w["lid"]))
                        out[3].append(pa.array([content] + [None] * (len(v) - 1), pa.string()))
                        size += len(v)
                        if size > 200_000:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]).view(np.int64)), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2])), pa.concat_arrays(out[3])], names=VARIANTS.names)
                            out, size = [[], [], [], []], 0
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]).view(np.int64)), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2])), pa.concat_arrays(out[3])], names=VARIANTS.names)

    joined = source.join(asked.hint("shuffle_hash"), ["doc", "row"])
    emitted = joined.select("__text", "asked", *[c for c in source.columns if c not in ("doc", "row", "__text")]).mapInArrow(emit, VARIANTS)
    content = emitted.where("place = -1").select("lid", "content").dropDuplicates(["lid"])
    by_variant = Window.partitionBy("variant")
    met = emitted.select("variant", "place", "lid").withColumn("low", F.min("lid").over(by_variant)).withColumn("high", F.max("lid").over(by_variant))
    met = met.where("low != high").select("variant", "place", "lid").join(some.select("lid", "first").join(content, "lid"), "lid")
    met = met.withColumn("itself", F.expr("CASE WHEN place < 0 THEN content ELSE concat(substring(content, 1, place), substring(content, place + 2)) END"))
    mine = F.struct("first", "lid", "content")
    exactly = Window.partitionBy("variant", "itself")
    whole = F.min(F.when(F.col("place") == -1, mine)).over(exactly)
    deleted = F.min(F.when(F.col("place") >= 0, mine)).over(exactly)
    same_place = F.min(F.when(F.col("place") >= 0, mine)).over(Window.partitionBy("variant", "itself", "place"))
    met = met.withColumn("witness", F.when(F.col("place") == -1, deleted).otherwise(F.least(whole, same_place)))
    near = met.where((F.col("witness.first") < F.col("first")) & (F.levenshtein("content", "witness.content", 1) >= 0)).select("lid").distinct().withColumn("near", F.lit(True))
    verdicts = folded.select("lid", "h1", "h2", "first").join(near, "lid", "left").drop("lid")
    # lines that a slice has settled are dealt by their places, so a very common line sends few rows to its digest
    placed = lines_of(docs, doc_id, text, least_length, with_keys=False)
    placed = placed.withColumn("h1", F.when(F.col("again"), F.xxhash64("row", "line")).otherwise(F.col("h1")))
    gone = placed.join(verdicts, ["h1", "h2"], "left").where(F.col("again") | F.col("near").isNotNull() | (F.struct("doc", "row", "line") != F.col("first")))
    return gone.groupBy("doc", "row").agg(F.collect_set("line").alias("__gone"))


STATE = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("emptied", T.BooleanType()), T.StructField("deduped", T.StringType())])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``keep`` columns (default: all) of docs with n_lines (not blank), n_removed, emptied, and the text that is left, deduped."""
    taken = {f.name for f in STATE.fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    source = rows_of(docs, doc_id, text, *[F.col(f"`{c}`").alias(f"__in{k}") for k, c in enumerate(kept)])
    gone = removed_lines(docs, doc_id, text, source, least_length)
    joined = source.join(gone.hint("shuffle_hash"), ["doc", "row"], "left").select("__text", "__gone", *[f"__in{k}" for k in range(len(kept))])
    schema = T.StructType([*joined.schema.fields[2:], *STATE.fields])

    def run(batches):
        for batch in batches:
            for part in textbuf.slices(batch, 0):
                column = part.column(0)
                data, offsets = textbuf.flat(column)
                row = line_spans(data, offsets)[0]
                n = np.bincount(row, minlength=part.num_rows)
                out, removed = [], []
                for t, g in zip(column.to_pylist(), part.column(1).to_pylist(), strict=True):
                    if g:
                        g = set(g)
                        t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
                    out.append(t)
                    removed.append(len(g or ()))
                removed = np.array(removed, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(n.astype(np.int64)), pa.array(removed), pa.array((removed >= n) & (n > 0)), pa.array(out, pa.string())], names=schema.names)

    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"__in{k}").alias(c) for k, c in enumerate(kept)], *[f.name for f in STATE.fields])


def drop_emptied(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with deduplicated texts (and their number of characters, if there is such a column), without emptied ones."""
    names = docs.columns
    aside = docs.toDF(*[f"__c{k}" for k in range(len(names))])
    at = {n.lower(): f"__c{k}" for k, n in enumerate(names)}
    out = dedup_lines(aside, at[doc_id.lower()], at[text.lower()]).where("not emptied")
    made = []
    for n in names:
        c = F.col("deduped") if n.lower() == text.lower() else F.length("deduped").cast(docs.schema[n].dataType) if n.lower() == length.lower() else F.col(at[n.lower()])
        made.append(c.alias(n))
    return out.select(*made)
