"""N-gram Jaccard join by an LSH forest of MinHash signatures.

A text's shingles are its runs of ``WORDS`` consecutive words (runs of 0-9, a-z and characters beyond ASCII after A-Z are
lower-cased; a text of fewer words, but not none, has one shingle of them all). Texts of equal words (by 128 bits of the
words' SHA-256) form a class, and classes are linked when the Jaccard similarity of their shingle sets is ``LEAST`` or more.

1. Signatures: ``TREES`` paths of ``DEPTH`` MinHash values of 8 bits each, a path one 64-bit number; a tree is the prefix
   trie of all paths of one place, and its nodes are the prefixes of the sorted numbers.
2. Matched prefixes start at the full depth. The classes below a node are compared, as long as nothing has joined them, by
   the share of equal values of the whole signatures (``TREES * DEPTH`` values; five standard deviations below LEAST still
   pass), which gives a spanning forest, not pairs. Each link that was found tells how likely nodes of
   this depth are to find one like it: links of similarity s share one with probability p = 1 - (1 - s**depth)**TREES, so
   that 1 / p of them exist for each that was found. As long as the links found are fewer than ``RECALL`` of the links so
   estimated, prefixes are shortened, for all trees, to the depth at which the links known by now would have been found,
   and the nodes of that depth, which hold those of the deeper ones, are compared.
   Similarities below LEAST count as LEAST, so the search ends at depth 6 at the latest (0.8, 32 trees, 0.9999), and
   earlier where a corpus's copies are closer.
3. Components of these forests hold all candidates. Their texts are fetched once, and within a component the exact
   similarities come from posting lists of the whole shingle sets (by 64-bit hashes of bases drawn for each run): each
   class gets its number of links, and each component a spanning forest of verified links, whose components are the result.

Nodes and components of more than ``BLOCK`` classes are cut into pairs of blocks, each a task of its own, so every two
classes of a group still meet and no task holds a group. Copies are never expanded: they count by the size of their class.

Nulls, empty texts and texts without words have no shingles: no links, a class of their own. Null ids: no links, null
class_id; they count as copies of others. Repeated rows are copies of each other; rows of one id with different texts are
judged each by its own text. Texts are compared whole, long ones too. An empty table gives no rows. Only the id and the text
are read, so other columns' names can't clash; keep_one_of_each() returns the documents' own columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import components, groups, shared, textbuf

WORDS = 5
LEAST = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999
BLOCK = 2048
_STEP = np.uint64(0xD6E8FEB86659FD93)


def found_share(similarity: float, depth: int) -> float:
    """How likely two classes are to share a prefix of this depth in a tree."""
    return 1 - (1 - similarity**depth) ** TREES


def estimated_recall(equal: dict[int, int], depth: int, least: float) -> float:
    """Links found, by their number of equal values, as a share of those that there must be for so many to be found."""
    there = sum(n / found_share(max(least, e / (TREES * DEPTH)), depth) for e, n in equal.items())
    return sum(equal.values()) / there if there else 1.0


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, 64-bit shingle hash) pairs, by row."""
    raw, offsets = textbuf.flat(column)
    data = textbuf.lower_table()[raw]
    start, end, bounds = textbuf.word_spans(data, offsets)
    h = textbuf.span_hashes(textbuf.prefix_hashes(data), start, end)
    n = np.diff(bounds)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = np.repeat(bounds[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n[row], words)
    out = np.zeros(len(row), dtype=np.uint64)
    for k in range(words):
        at = np.minimum(first + k, max(0, len(h) - 1))
        out = textbuf.mix(out * _STEP + np.where(k < size, h[at], np.uint64(0))) if len(h) else out
    key = (row.astype(np.uint64) << np.uint64(44)) | (out >> np.uint64(20))
    order = np.argsort(key)
    row, out = row[order], out[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    return row[new], out[new]


def seeds(n: int) -> np.ndarray:
    return (textbuf.mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and their MinHash values."""
    where = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(where), TREES * DEPTH), dtype=np.uint32)
    if len(where):
        for k, a in enumerate(seeds(TREES * DEPTH)):
            out[:, k] = np.minimum.reduceat(x * a, where)
    return row[where], out


SIGNED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("paths", T.ArrayType(T.LongType()))])


def words_keys(column: pa.Array) -> list[bytes | None]:
    """128 bits that tell each text's words; None without words."""
    raw, offsets = textbuf.flat(column)
    data = textbuf.lower_table()[raw]
    start, end, bounds = textbuf.word_spans(data, offsets)
    size = end - start
    inside = np.flatnonzero(textbuf.word_table()[data])
    plain = np.full(len(inside) + len(size), 32, dtype=np.uint8)  # a space after each word
    plain[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = data[inside]
    ends = np.concatenate([[0], np.cumsum(size + 1)])[bounds].tolist()
    view = memoryview(plain)
    return [hashlib.sha256(view[i:j]).digest()[:16] if i < j else None for i, j in zip(ends[:-1], ends[1:], strict=True)]


def sign(column: pa.Array, words: int) -> list[pa.Array]:
    """Of each text: the key of its words, and its path in each tree."""
    rows, values = signatures(*shingles(column, words))
    short = ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    path = np.ascontiguousarray(short).view(">i8").astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(column)) * TREES)]).astype(np.int32)
    return [pa.array(words_keys(column), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(path.ravel()))]


def join_node(sig: np.ndarray, least_equal: int) -> tuple[list[int], list[int], list[int]]:
    """(member, other, equal values) of a spanning forest of a node's candidates."""
    root = np.arange(len(sig))
    a, b, equal = [], [], []
    for i in range(len(sig)):  # each member meets those that its component doesn't hold yet
        apart = np.flatnonzero(root != root[i])
        if not len(apart):
            break
        same = (sig[apart] == sig[i]).sum(axis=1)
        near = same >= least_equal
        _, some = np.unique(root[apart[near]], return_index=True)
        for j, e in zip(apart[near][some].tolist(), same[near][some].tolist(), strict=True):
            a.append(i)
            b.append(j)
            equal.append(e)
            low, high = min(root[i], root[j]), max(root[i], root[j])
            root[root == high] = low
    return a, b, equal


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("equal", T.IntegerType())])
NODE = ["tree", "prefix", "lo", "hi"]


def node_links(reps: DataFrame, depth: int, least: float, block: int) -> DataFrame:
    """Links between classes below the nodes of this depth; reps: cid, paths."""
    paths = reps.select("cid", F.posexplode("paths").alias("tree", "path")).select("cid", "tree", F.shiftrightunsigned("path", 8 * (DEPTH - depth)).alias("prefix"))
    nodes = paths.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where("size > 1")
    members = paths.join(nodes, ["tree", "prefix"]).join(reps.select("cid", "paths"), "cid")
    tasks = groups.block_pairs(members, "size", F.xxhash64("cid"), block).select(*NODE, "cid", "paths")
    total = TREES * DEPTH
    least_equal = int(total * least - 5 * (total * least * (1 - least)) ** 0.5)

    def run(batches):
        for table in groups.keyed_runs(batches, NODE):
            table = table.combine_chunks()
            sig = table.column("paths").combine_chunks().flatten().to_numpy().astype(">i8").view(np.uint8).reshape(-1, total)
            keys = [table.column(k).to_numpy() for k in NODE]
            cid = table.column("cid").to_numpy()
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            start, end = np.concatenate([[0], edge]), np.concatenate([edge, [table.num_rows]])
            two = start[end - start == 2]
            same = (sig[two] == sig[two + 1]).sum(axis=1)
            near = same >= least_equal
            a, b, equal = [two[near] + 1], [two[near]], [same[near]]
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                if e - s > 2:
                    i, j, n = join_node(sig[s:e], least_equal)
                    a.append(np.array(i, dtype=np.int64) + s)
                    b.append(np.array(j, dtype=np.int64) + s)
                    equal.append(np.array(n, dtype=np.int64))
            a, b, equal = (np.concatenate(x) for x in (a, b, equal))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b]), pa.array(equal, pa.int32())], names=LINKS.names)

    return tasks.repartition(*NODE).sortWithinPartitions(*NODE).mapInArrow(run, LINKS)


def candidate_components(reps: DataFrame, least: float, recall: float, block: int) -> DataFrame:
    """(id, component) of all classes that may have links, from prefixes shortened until the target recall."""
    depth = DEPTH
    while True:
        links = shared.cut(node_links(reps, depth, least, block))
        equal = {r["equal"]: r["count"] for r in links.groupBy("equal").count().collect()}  # TREES * DEPTH rows at most
        # without links yet, what nodes would find of the least similar ones
        equal = equal or {round(least * TREES * DEPTH): 1}
        enough = next((d for d in range(DEPTH, 1, -1) if estimated_recall(equal, d, least) >= recall), 1)
        if enough >= depth:
            return components.connected_components(links)
        depth = enough


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row a document: id, class_id (the smallest id that it reaches by links), n_links, copy_of (its class's id)."""
    found = judged_rows(docs, doc_id, text, least, words, recall, block)
    return found.select(F.col("id").alias(doc_id), "class_id", "n_links", "copy_of")


def judged_rows(docs: DataFrame, doc_id: str, text: str, least: float, words: int, recall: float, block: int) -> DataFrame:
    """near_duplicates() with the id as "id", and bits of the text."""
    short = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = short.withColumn("bits", textbuf.text_bits(F.col("text")))
    signed = shared.cut(textbuf.annotate(signed, "text", SIGNED, lambda column: sign(column, words), ["id", "bits"]))
    classes = signed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("rep is not null")
    # the numbers are those of the table once it is written
    classes = shared.cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    reps = signed.join(classes.select("key", F.col("rep").alias("id"), "cid"), ["key", "id"]).select("cid", "paths").dropDuplicates(["cid"])

    # exact similarities within the candidates' components
    rough = candidate_components(reps, least, recall, block).withColumnRenamed("id", "cid").join(classes, "cid")
    sizes = rough.groupBy("component").agg(F.count("*").alias("size"))
    wanted = rough.join(sizes, "component").withColumnRenamed("rep", "id").hint("shuffle_hash")
    held = short.join(wanted, "id").select("cid", "key", "component", "n", "size", "text")
    sets = T.StructType([T.StructField("own", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def pack(column: pa.Array) -> list[pa.Array]:
        row, h = shingles(column, words)
        cut = np.searchsorted(row, np.arange(len(column) + 1))
        return [pa.array(words_keys(column), pa.binary()), pa.array([np.sort(h[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())]

    packed = textbuf.annotate(held, "text", sets, pack, ["cid", "key", "component", "n", "size"]).where("own = key").drop("own", "key").dropDuplicates(["cid"])
    order = ["component", "lo", "hi"]
    tasks = groups.block_pairs(packed, "size", F.xxhash64("cid"), block // 4).select(*order, "own", "cid", "n", "shingles")
    # similar by a/b: 1/least is exact enough for least given in hundredths
    hundredths = round(least * 100)

    def verify(table: pa.Table):
        data, offsets = textbuf.flat(table.column("shingles").combine_chunks())
        h = np.frombuffer(data.tobytes(), dtype=np.uint64)
        size = np.diff(offsets) // 8
        m = len(size)
        n, own, cid = (table.column(c).to_numpy() for c in ("n", "own", "cid"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        owner = np.repeat(np.arange(m), size)
        by = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
        group = np.empty(len(h), dtype=np.int64)
        group[by] = np.cumsum(new) - 1
        holders = owner[by]
        first = np.append(np.flatnonzero(new), len(h))
        bounds = offsets // 8
        links, a, b = np.zeros(m, dtype=np.int64), [], []
        for i in range(m):
            g = group[bounds[i] : bounds[i + 1]]
            count = first[g + 1] - first[g]
            at = np.repeat(first[g], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            both = np.bincount(holders[at], minlength=m)
            ok = both * 100 >= hundredths * (size[i] + size - both)
            ok[i] = False
            if lo != hi:
                ok &= own != own[i]
            links[i] = n[ok].sum()
            j = np.flatnonzero(ok[:i])
            a.append(np.full(len(j), i))
            b.append(j)
        root = components.forest(m, np.concatenate(a), np.concatenate(b))
        moved, some = np.flatnonzero(root != np.arange(m)), np.flatnonzero(links)
        to = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[root[moved]])])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([cid[some], cid[moved]])), to, pa.array(np.concatenate([links[some], np.zeros(len(moved), np.int64)]))], names=["a", "b", "n"])

    def exact(batches):
        for table in groups.keyed_runs(batches, order):
            keys = [table.column(k).to_numpy() for k in order]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), table.num_rows], strict=True):
                if e - s > 1 and (made := verify(table.slice(s, e - s))).num_rows:
                    yield made

    found = shared.cut(tasks.repartition(*order).sortWithinPartitions(*order).mapInArrow(exact, "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    reached = components.connected_components(found.where("b is not null")).withColumnRenamed("id", "cid")
    least_id = reached.join(classes, "cid").groupBy("component").agg(F.min("rep").alias("class_id"))
    per_class = classes.join(links, "cid", "left").join(reached.join(least_id, "component"), "cid", "left")
    per_class = per_class.select("key", "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("id", "bits", "key").join(per_class, "key", "left")
    named = F.col("id").isNotNull()
    return out.select("id", "bits", F.when(named, F.coalesce("class_id", "id")).alias("class_id"), F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(named, F.coalesce("rep", "id")).alias("copy_of"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows whose id is the smallest of their class, with their own columns only; rows of null ids all stay."""
    found = judged_rows(docs, doc_id, text, least, words, recall, block)
    gone = found.where("class_id < id").select(F.col("id").alias("__id"), F.col("bits").alias("__bits")).distinct()
    same = (F.col(f"`{doc_id}`") == F.col("__id")) & (textbuf.text_bits(F.col(f"`{text}`").cast("string")) == F.col("__bits"))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")
