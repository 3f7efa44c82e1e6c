"""Blocking rules: each gives the distinct (s1_id, noisy_id) pairs that share its key.

Keys are compared by equi-joins on normalised values; empty and null keys never join. Token rules explode the token sets
and join on the token; the rare variants drop tokens by document frequency before the join, which is what keeps a common
token from pairing all with all. s1 and noisy are frames of ``records.normalize_records``.

Pairs are not shuffled to tell repeated ones: a pair that shares several tokens is given for the first of them only, and in
a union a rule gives the pairs for which no rule before it holds, both by conditions on the columns of the two records. If
ids are repeated, so that several rows make one pair, a ``distinct`` follows. Where rule e is dense, alone or in a union,
blocks of records meet instead (``dense_pairs``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions import similarity
from lodestone.sources import shared

#: Rules by equal keys.
KEYS = {"a": ["nn"], "b": ["tok1"], "c": ["country", "tok1"], "d": ["na"], "f": ["tok2"], "g": ["country", "tok2"]}
#: Broad candidates of a noisy row, and the largest document frequency of a rare token.
TOP_K, MAX_DF = 15, 200
PAIR = ["s1_id", "noisy_id"]
#: Distinct S1 names in a block of approximate_names; blocks of noisy names have up to half as many.
NAMES_BLOCK = 1 << 16
#: Rows of a side of a block of a hot key.
HOT = 2048
#: Rule e is dense with more than DENSE shared tokens of pairs, if that is more than one for every SPARSE pairs of rows.
DENSE, SPARSE = 1 << 24, 256
#: Noisy rows of a block of dense rules (of S1 four times as many), ids returned at a time, and pairs of two lists, which Spark holds at once.
DENSE_BLOCK, DENSE_HELD, DENSE_LIST = 8192, 1 << 19, 8192


def _postings(a: DataFrame, b: DataFrame, on: list[tuple[str, str]]) -> tuple[int, list]:
    """The pairs of rows that agree on columns of a and b, and the keys of more than HOT * HOT pairs with the blocks of either side.

    A key is hot only if more than HOT rows of a side have it, so the driver gets a key for every HOT rows at most.
    """
    keys = [f"__k{k}" for k in range(len(on))]
    rows = lambda df, side, n: df.groupBy(*[F.col(c[side]).alias(k) for c, k in zip(on, keys, strict=True)]).agg(F.count("*").alias(n))
    both = rows(a, 0, "__m").join(rows(b, 1, "__n"), keys)
    blocks = [F.ceil(F.col(c) / HOT).cast("int").alias(p) for c, p in (("__m", "__p"), ("__n", "__q"))]
    hot = F.when(F.col("__m") * F.col("__n") > HOT * HOT, F.struct(*keys, *blocks))
    total, found = both.agg(F.coalesce(F.sum(F.col("__m") * F.col("__n")), F.lit(0)), F.collect_list(hot)).first()
    return total, [tuple(r) for r in found]


def _meet(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], known: tuple[int, list] | None = None) -> DataFrame:
    """All columns of the rows of a (s1_id) and b (noisy_id) that agree on columns; a hot key's rows meet in pairs of blocks.

    The rows are few and the pairs many, so the number of tasks follows from the pairs.
    """
    same = [F.col(x) == F.col(y) for x, y in on]
    if a.isStreaming or b.isStreaming:
        return a.join(b, same)
    total, hot = known or _postings(a, b, on)
    if total <= HOT * HOT:
        return a.join(b, same)
    block = [f"__{x}" for x in ("ai", "aj", "bi", "bj")]
    if hot:
        types = [f"__h{k} {a.schema[x].dataType.simpleString()}" for k, (x, _) in enumerate(on)]
        keys = F.broadcast(a.sparkSession.createDataFrame(hot, ", ".join([*types, "__p int", "__q int"])))
        of = lambda df, side: df.join(keys, [F.col(c[side]) == F.col(f"__h{k}") for k, c in enumerate(on)], "left")
        one = lambda c, n: F.when(F.col(n).isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.col(n)).cast("int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n) - 1, F.lit(0))))
        a = of(a, 0).select(*a.columns, one("s1_id", "__p").alias("__ai"), every("__q").alias("__aj"))
        b = of(b, 1).select(*b.columns, one("noisy_id", "__q").alias("__bj"), every("__p").alias("__bi"))
        on = [*on, ("__ai", "__bi"), ("__aj", "__bj")]
        same += [F.col("__ai") == F.col("__bi"), F.col("__aj") == F.col("__bj")]
    tasks = min(4096, max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * total / (HOT * HOT))))
    return a.repartition(tasks, *[x for x, _ in on]).join(b.repartition(tasks, *[y for _, y in on]), same).drop(*block)


def by_key(s1: DataFrame, noisy: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs that agree on all columns. One row a record, so the pairs are distinct."""
    keep = lambda df, name, side: df.where(reduce(lambda a, b: a & b, [F.col(c) != "" for c in columns])).select(F.col("entity_id").alias(name), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return _meet(keep(s1, "s1_id", "a"), keep(noisy, "noisy_id", "b"), [(f"a_{c}", f"b_{c}") for c in columns]).select(*PAIR)


def token_table(records: DataFrame, column: str, name: str, *extra: str) -> DataFrame:
    return records.select(F.col("entity_id").alias(name), *extra, F.explode(column).alias("token"))


def document_frequency(records: DataFrame, column: str) -> DataFrame:
    """(token, df): the records that hold each token."""
    return records.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def rare(df: DataFrame, most: int) -> DataFrame:
    return df.where(F.col("df") <= most)


#: Columns of records that conditions read, and of token rules the tokens of the S1 and the noisy side and what else must agree.
COLUMNS = ["country", "nn", "na", "tok1", "tok2", "nt", "at"]
TOKENS = {"e": ("at", "at", []), "h": ("h", "at", []), "e_rare": ("e_rare", "at", []), "n_rare": ("n_rare", "nt", ["country"])}
#: Rules of a key and a token rule.
BOTH = {"c_and_e": ("c", "e"), "g_and_e": ("g", "e"), "ce_rare": ("c", "e_rare")}
#: Rules that hold whenever a rule does.
IMPLIED = {
    "c": ["b"], "f": ["b"], "g": ["b", "c", "f"], "h": ["e"], "e_rare": ["e"], "c_and_e": ["b", "c", "e"],
    "g_and_e": ["b", "c", "e", "f", "g", "c_and_e"], "ce_rare": ["b", "c", "e", "e_rare", "c_and_e"],
}


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def _agree(columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [_filled(f"a_{c}") & F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False)) for c in columns], F.lit(True))


def holds(name: str) -> Column:
    """Whether a rule holds for a row of a_ and b_ columns of ``sides``; never null."""
    if name in KEYS:
        return _agree(KEYS[name])
    if name in BOTH:
        return holds(BOTH[name][0]) & holds(BOTH[name][1])
    if name in TOKENS:
        left, right, same = TOKENS[name]
        return _agree(same) & F.coalesce(F.arrays_overlap(f"a_{left}", f"b_{right}"), F.lit(False))
    raise ValueError(f"no rule {name}")


def _rare_tokens(s1: DataFrame, column: str, df: DataFrame, most: int, to: str) -> DataFrame:
    """s1 with those tokens of a column that are rare."""
    few = s1.select("entity_id", column, F.explode(column).alias("token")).join(rare(df, most).select("token"), "token").groupBy("entity_id", column).agg(F.collect_set("token").alias(to))
    return s1.join(few, ["entity_id", column], "left")


def sides(names: list[str], s1: DataFrame, noisy: DataFrame, most: int = MAX_DF, more: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides' ids and columns, prefixed a_ and b_, with the rare tokens that the rules need; more: further columns of the noisy side."""
    needed = {BOTH[n][1] if n in BOTH else n for n in names}
    for name, column, counted in (("h", "at", noisy), ("e_rare", "at", s1), ("n_rare", "nt", s1)):
        if name in needed:
            s1 = _rare_tokens(s1, column, document_frequency(counted, column), most, name)
    own = [c for c in s1.columns if c not in ("entity_id",)]
    a = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in own])
    b = noisy.select(F.col("entity_id").alias("noisy_id"), *[F.col(c).alias(f"b_{c}") for c in [*COLUMNS, *(more or [])]])
    return a, b


def hit_rows(name: str, a: DataFrame, b: DataFrame, but: list[str] | None = None) -> DataFrame:
    """All columns of both sides for each pair of rows for which a rule holds and none of ``but``, once.

    A rule of a key and a token joins on both, or on the key alone if fewer pairs come of it.
    """
    key, token = BOTH.get(name, (name, name))
    columns = [*KEYS.get(key, []), *(TOKENS[token][2] if token in TOKENS else [])]
    filled = lambda df, side: df.where(reduce(lambda x, y: x & y, [_filled(f"{side}_{c}") for c in columns], F.lit(True)))
    rest = lambda pairs: reduce(lambda df, r: df.where(~holds(r)), but or [], pairs)
    a, b = filled(a, "a"), filled(b, "b")
    same = [(f"a_{c}", f"b_{c}") for c in columns]
    if name in KEYS:
        return rest(_meet(a, b, same))
    left, right, _ = TOKENS[token]
    a_tokens = a.select("*", F.posexplode(f"a_{left}").alias("__nth", "__token"))
    b_tokens = b.select("*", F.explode(f"b_{right}").alias("__other"))
    by_token = [*same, ("__token", "__other")]
    postings = None if a.isStreaming or b.isStreaming else _postings(a_tokens, b_tokens, by_token)
    if name in BOTH and postings and postings[0] > HOT * HOT:
        keyed = _postings(a, b, same)
        if keyed[0] <= postings[0]:
            return rest(_meet(a, b, same, keyed)).where(F.coalesce(F.arrays_overlap(f"a_{left}", f"b_{right}"), F.lit(False)))
    met = _meet(a_tokens, b_tokens, by_token, postings)
    first = (F.col("__nth") == 0) | ~F.coalesce(F.arrays_overlap(F.slice(f"a_{left}", F.lit(1), F.col("__nth")), f"b_{right}"), F.lit(False))
    return rest(met).where(first).drop("__nth", "__token", "__other")


def _implied(name: str, by: list[str]) -> bool:
    """Whether a pair of a rule is always one of another of ``by``."""
    return any(r in IMPLIED.get(name, ()) for r in by)


def joined(names: list[str], a: DataFrame, b: DataFrame, but: list[str] | None = None) -> DataFrame:
    """All columns of both sides for each pair of rows for which some rule of names holds and none of but, once; not shuffled."""
    out = None
    names = [n for n in names if not _implied(n, names)]
    for k, name in enumerate(names):
        one = hit_rows(name, a, b, [*(but or []), *names[:k]])
        out = one if out is None else out.unionByName(one)
    return out


def repeated_ids(*records: DataFrame) -> bool:
    """Whether any of the tables has two rows of one id."""
    return any(bool(r.groupBy("entity_id").count().where("count > 1").limit(1).count()) for r in records)


def rule(name: str, s1: DataFrame, noisy: DataFrame, most: int = MAX_DF) -> DataFrame:
    """A rule by its name: a b c d f g (equal keys), e (any address token), h, e_rare, n_rare (rare tokens), and c_and_e,
    g_and_e, ce_rare (key hits that share an address token, or a rare one)."""
    if name in KEYS:
        return by_key(s1, noisy, KEYS[name])
    if name == "e" and not s1.isStreaming and not noisy.isStreaming:
        return any_of([name], s1, noisy, most)
    pairs = hit_rows(name, *sides([name], s1, noisy, most)).select(*PAIR)
    return pairs.distinct() if name in TOKENS and repeated_ids(s1, noisy) else pairs


def _shared_tokens(a: DataFrame, b: DataFrame) -> int:
    """The number of pairs of rows that share an address token, each as often as they do."""
    tokens = lambda df, c: df.select(F.explode(c).alias(c))
    return _postings(tokens(a, "a_at"), tokens(b, "b_at"), [("a_at", "b_at")])[0]


def _terms(names: list[str], side: str) -> Column:
    """Strings of a row of ``sides``; one of the rules (keys and token rules) holds for two rows if they have one in common."""
    out = []
    for name in names:
        token = {"a": 0, "b": 1}[side]
        columns = TOKENS[name][2] if name in TOKENS else KEYS[name]
        filled = reduce(lambda x, y: x & y, [_filled(f"{side}_{c}") for c in columns], F.lit(True))
        # lengths come before the values, so different values never give one string
        start = F.concat(F.lit(f"{name} "), *[x for c in columns for x in (F.length(f"{side}_{c}").cast("string"), F.lit(" "), F.col(f"{side}_{c}"))])
        every = F.transform(F.filter(f"{side}_{TOKENS[name][token]}", lambda t: t.isNotNull()), lambda t: F.concat(start, F.lit(" "), t)) if name in TOKENS else F.array(start)  # noqa: B023
        out.append(F.when(filled, F.coalesce(every, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return F.concat(*out)


def _term_index(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of terms: the distinct terms, the rows by term, where each term's start; the rank of the common terms (others -1), their
    marks (term, row), and these as bits (row, word)."""
    coded = lists.flatten().dictionary_encode()
    codes, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    rows, starts = owner[np.argsort(codes, kind="stable")], np.concatenate([[0], np.cumsum(counts)])
    common = np.flatnonzero(counts > len(lists) // 64)
    common = common[np.argsort(-counts[common], kind="stable")]
    rank = np.full(len(counts), -1, np.int32)
    rank[common] = np.arange(len(common))
    marks = np.zeros((len(common), len(lists)), dtype=bool)
    for k, c in enumerate(common.tolist()):
        marks[k, rows[starts[c] : starts[c + 1]]] = True
    return coded.dictionary, rows, starts, rank, marks, _bits(marks.T)


def _bits(marks: np.ndarray) -> np.ndarray:
    """Rows of marks as 64-bit words."""
    out = np.zeros((len(marks), 8 * max(1, math.ceil(marks.shape[1] / 64))), dtype=np.uint8)
    packed = np.packbits(marks, axis=1)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _sharing(lists: pa.Array, terms: pa.Array, rows: np.ndarray, starts: np.ndarray, rank: np.ndarray, marks: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair of a row of lists and a row of the index that share a term once, as places of rows that are paired all with all.

    Rows that begin with the same common terms, the most frequent first, are paired with the rows of the last of these that
    lack those before it. Pairs that share no common term follow, one row at a time.
    """
    codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[codes >= 0]
    codes = codes[codes >= 0]
    often = rank[codes] >= 0
    row, term = owner[often], rank[codes[often]]
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    lengths = np.bincount(row, minlength=len(lists))
    held = np.full((len(lists), int(lengths.max(initial=0)) + 1), -1, np.int32)
    held[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = term
    order = np.lexsort(held.T[::-1])
    held = held[order]
    waiting = [(0, len(order), 0, np.zeros(marks.shape[1], dtype=bool))]
    while waiting:
        start, end, level, before = waiting.pop()
        column = held[start:end, level]
        edges = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), len(column)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if column[s] >= 0:
                mark = marks[column[s]]
                others = np.flatnonzero(mark > before)
                if len(others):
                    yield order[start + s : start + e], others
                if (held[start + s : start + e, level + 1] >= 0).any():
                    waiting.append((start + s, start + e, level + 1, mark | before))
    mine = np.zeros((len(lists), len(marks)), dtype=bool)
    mine[row, term] = True
    mine = _bits(mine)
    row, code = owner[~often], codes[~often]
    sizes = starts[code + 1] - starts[code]
    ends = np.cumsum(sizes)
    # terms of a row stay together
    cuts = np.flatnonzero(np.diff(row, append=-1)) + 1
    at = 0
    while at < len(row):
        to = int(cuts[min(np.searchsorted(cuts, max(at + 1, np.searchsorted(ends, ends[at] + DENSE_HELD))), len(cuts) - 1)])
        n = sizes[at:to]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[code[at:to]], n)
        both = np.unique(np.repeat(row[at:to], n) * len(bits) + rows[place])
        x, y = both // len(bits), both % len(bits)
        other = ~(mine[x] & bits[y]).any(axis=1)
        x, y = x[other], y[other]
        edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else [0]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            yield x[s : s + 1], y[s:e]
        at = to


def dense_pairs(names: list[str], a: DataFrame, b: DataFrame, repeated: bool = False) -> DataFrame:
    """The distinct pairs of rows of ``sides`` for which some rule of names (keys and token rules) holds, if they are many.

    Rows are kept in blocks, a row each, and every two blocks meet in a cross join: neither copies of rows nor pairs are
    shuffled. A task returns lists of ids that are paired all with all, each pair in one of them, whatever it shares. Files of
    the pairs are small: a task's ids are few, and lists repeat at multiples of eight ids, so that columnar pages repeat too.
    """
    names = [n for n in names if not _implied(n, names)]
    ids = [a.schema["s1_id"].dataType, b.schema["noisy_id"].dataType]

    def blocks(df, side, key, most):
        rows = df.select(F.col(key).alias("id"), _terms(names, side).alias("terms")).where(F.size("terms") > 0)
        if repeated:
            rows = rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
        n = max(1, math.ceil(df.count() / most))
        held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("no")).agg(F.collect_list(F.struct("id", "terms")).alias("x"))
        kept = shared.written(held.select(F.col("no").alias(f"{side}_no"), F.col("x.id").alias(f"{side}_ids"), F.col("x.terms").alias(f"{side}_terms")), "blocks")
        return kept.repartitionByRange(n, f"{side}_no").drop(f"{side}_no")

    met = blocks(b, "b", "noisy_id", DENSE_BLOCK).crossJoin(blocks(a, "a", "s1_id", 4 * DENSE_BLOCK).hint("shuffle_replicate_nl"))

    def meet(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a_ids, a_lists, b_ids, b_lists = (batch.column(c)[r].values for c in ("a_ids", "a_terms", "b_ids", "b_terms"))
                lists = ([], []), (a_ids, b_ids)

                def rows():
                    out = []
                    for places, of in zip(*lists, strict=True):  # noqa: B023
                        ends = np.cumsum([0, *map(len, places)], dtype=np.int32)
                        out.append(pa.ListArray.from_arrays(pa.array(ends), of.take(pa.array(np.concatenate(places)))))
                        places.clear()
                    return pa.RecordBatch.from_arrays(out, names=["s1_ids", "noisy_ids"])

                count = 0
                for x, y in _sharing(a_lists, *_term_index(b_lists)):
                    whole = len(y) // 8 * 8 if len(x) > 1 else len(y)
                    for part in (y[:whole], y[whole:]):
                        step = max(1, DENSE_LIST // max(1, len(part)))
                        for at in range(0, len(x) if len(part) else 0, step):
                            lists[0][0].append(x[at : at + step])
                            lists[0][1].append(part)
                            count += len(lists[0][0][-1]) + len(part)
                            if count > DENSE_HELD:
                                yield rows()
                                count = 0
                if count:
                    yield rows()

    found = T.StructType([T.StructField("s1_ids", T.ArrayType(ids[0])), T.StructField("noisy_ids", T.ArrayType(ids[1]))])
    return met.mapInArrow(meet, found).select(F.explode("s1_ids").alias("s1_id"), "noisy_ids").select("s1_id", F.explode("noisy_ids").alias("noisy_id"))


def any_of(names: list[str], s1: DataFrame, noisy: DataFrame, most: int = MAX_DF) -> DataFrame:
    """The distinct pairs of several rules."""
    a, b = sides(names, s1, noisy, most)
    repeated = repeated_ids(s1, noisy)
    if "e" in names and not any(n in BOTH for n in names):
        tokens = _shared_tokens(a, b)
        if tokens > DENSE and tokens * SPARSE > a.count() * b.count():
            return dense_pairs(names, a, b, repeated)
    pairs = joined(names, a, b).select(*PAIR)
    return pairs.distinct() if repeated else pairs


def union(*pairs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, pairs).distinct()


#: Unions of rules by name.
UNIONS = {
    "a_union_g": ["a", "g"], "a_union_ce": ["a", "c_and_e"], "ag_union_ce": ["a", "g", "c_and_e"], "ag_union_ge": ["a", "g", "g_and_e"],
    "c_union_e": ["c", "e"], "g_union_e": ["g", "e"], "agce": ["a", "g", "c", "e"], "i_ae": ["a", "e"], "i_ce": ["c", "e"], "i_ch": ["c", "h"],
    "ag_ce_rare": ["a", "g", "ce_rare"], "ag_e_rare": ["a", "g", "e_rare"], "ag_n_rare": ["a", "g", "n_rare"], "ag_n_rare_e_rare": ["a", "g", "n_rare", "e_rare"],
}


def pairs_of(name: str, s1: DataFrame, noisy: DataFrame, most: int = MAX_DF) -> DataFrame:
    """Pairs of a rule or of a union of rules."""
    if name in UNIONS:
        return any_of(UNIONS[name], s1, noisy, most)
    return rule(name, s1, noisy, most)


def _counted(columns: list[str], a: DataFrame, b: DataFrame, to: str) -> DataFrame:
    """One row: the number of pairs of rows that agree on the columns, from the numbers of rows of each key."""
    rows = lambda df, side, n: df.where(reduce(lambda x, y: x & y, [_filled(f"{side}_{c}") for c in columns])).groupBy(*[F.col(f"{side}_{c}").alias(c) for c in columns]).agg(F.count("*").alias(n))
    return rows(a, "a", "__m").join(rows(b, "b", "__n"), columns).agg(F.coalesce(F.sum(F.col("__m") * F.col("__n")), F.lit(0)).alias(to))


def pair_counts(names: list[str], s1: DataFrame, noisy: DataFrame, truth: DataFrame, most: int = MAX_DF) -> DataFrame:
    """(rule, pairs, hits) of rules and unions: the distinct pairs and those of them in truth (distinct pairs).

    Pairs of key rules are counted from their keys, by inclusion and exclusion in unions, not made; those of other rules are
    made where no key rule of the union holds, and not shuffled. Hits are the true pairs for which a rule holds.
    """
    parts = {n: UNIONS.get(n, [n]) for n in names}
    if repeated_ids(s1, noisy):
        marked = truth.withColumn("__t", F.lit(1))
        each = [pairs_of(n, s1, noisy, most).join(marked, PAIR, "left").agg(F.count("*").alias("pairs"), F.count("__t").alias("hits")).select(F.lit(n).alias("rule"), "*") for n in names]
        return reduce(DataFrame.unionByName, each)
    a, b = sides(sorted({r for p in parts.values() for r in p}), s1, noisy, most)
    some = lambda rules: reduce(lambda x, y: x | y, [holds(r) for r in rules])
    hits = truth.select(*PAIR).join(a, "s1_id").join(b, "noisy_id").agg(*[F.count_if(some(p)).alias(n) for n, p in parts.items()])
    out = hits.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in names])).alias("x")).select("x.*")
    counts = None
    for n, rules in parts.items():
        keys = [r for r in rules if r in KEYS]
        others = [r for r in rules if r not in KEYS and not _implied(r, keys)]
        terms = [((-1) ** (k + 1), sorted({c for r in chosen for c in KEYS[r]})) for k in range(1, len(keys) + 1) for chosen in combinations(keys, k)]
        one = [_counted(c, a, b, "n").select((sign * F.col("n")).alias("n")) for sign, c in terms]
        if others:
            one.append(joined(others, a, b, keys).agg(F.count("*").alias("n")))
        total = reduce(DataFrame.unionByName, one).agg(F.sum("n").alias("pairs")).select(F.lit(n).alias("rule"), "pairs")
        counts = total if counts is None else counts.unionByName(total)
    return counts.join(out, "rule")


def first_pairs(name: str, s1: DataFrame, noisy: DataFrame, n: int, but: DataFrame) -> DataFrame:
    """The first n pairs by S1 and noisy id of a rule that counts no frequencies of S1, without those in ``but``.

    Of the S1 rows with the smallest ids as many are joined as give n pairs, tried in steps; pairs of later ones come later.
    """
    m = 64
    while True:
        rows, last = s1.select("entity_id").orderBy("entity_id").limit(m).agg(F.count("*"), F.max("entity_id")).first()
        some = s1 if rows < m or last is None else s1.where(F.col("entity_id").isNull() | (F.col("entity_id") <= last))
        pairs = rule(name, some, noisy).join(but, PAIR, "left_anti").orderBy(*PAIR).limit(n)
        if rows < m or pairs.count() >= n:
            return pairs
        m *= 8


def labelled_hits(name: str, s1: DataFrame, noisy: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, noisy_id, src, label) of a rule's pairs, labelled by the true ids of their S1 row, so pairs aren't shuffled."""
    if repeated_ids(s1, noisy):
        pairs = rule(name, s1, noisy).join(truth.select(*PAIR).withColumn("__t", F.lit(1)), PAIR, "left").withColumn("label", F.coalesce("__t", F.lit(0))).drop("__t")
        return pairs.join(noisy.select(F.col("entity_id").alias("noisy_id"), "src"), "noisy_id")
    true = truth.groupBy(F.col("s1_id").alias("entity_id")).agg(F.collect_set("noisy_id").alias("true_ids"))
    found = hit_rows(name, *sides([name], s1.join(true, "entity_id", "left"), noisy, more=["src"]))
    return found.select(*PAIR, F.col("b_src").alias("src"), F.coalesce(F.array_contains("a_true_ids", F.col("noisy_id")), F.lit(False)).cast("int").alias("label"))


def rule_bits(names: list[str], s1: DataFrame, noisy: DataFrame, most: int = MAX_DF) -> DataFrame:
    """(s1_id, noisy_id, rules): bit k is set if rule k hits; all rules and unions from one shuffle."""
    hits = [rule(n, s1, noisy, most).withColumn("bit", F.lit(1 << k)) for k, n in enumerate(names)]
    return reduce(DataFrame.unionByName, hits).groupBy(*PAIR).agg(F.bit_or("bit").alias("rules"))


def _gram_index(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of ^name$ of each name, as (place of the name, trigram as a number), by name."""
    points = np.frombuffer("\n".join(f"^{n}$" for n in names).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = (points[:-2] != 10) & (points[1:-1] != 10) & (points[2:] != 10)
    owner, gram = np.cumsum(points == 10)[:-2][whole], (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[whole]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[new], gram[new]


def _best_names(names: list[str], others: list[str], top_n: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of others its place, the places of the top_n names by trigram Jaccard of at least ``least``, the first at ties, and the Jaccards."""
    owner, gram = _gram_index(names)
    sizes = np.bincount(owner, minlength=len(names))
    by_gram = np.argsort(gram, kind="stable")
    kinds, starts = np.unique(gram[by_gram], return_index=True)
    postings = np.split(owner[by_gram], starts[1:])
    of, theirs = _gram_index(others)
    at = np.minimum(np.searchsorted(kinds, theirs), len(kinds) - 1)
    known = kinds[at] == theirs
    ends = np.searchsorted(of, np.arange(len(others) + 1))
    for k in range(len(others)):
        mine = slice(ends[k], ends[k + 1])
        lists = [postings[g] for g in at[mine][known[mine]].tolist()]
        if not lists:
            continue
        n = int(ends[k + 1] - ends[k])
        common = np.bincount(np.concatenate(lists), minlength=len(names))
        some = np.flatnonzero(common >= max(1, math.floor(least / (1 + least) * (n + int(sizes.min())))))
        jaccard = common[some] / (sizes[some] + n - common[some])
        if len(some) > top_n:
            last = max(least, np.partition(jaccard, -top_n)[-top_n])
            above = jaccard > last
            above[np.flatnonzero(jaccard == last)[: top_n - int(above.sum())]] = True
        else:
            above = jaccard >= least
        yield k, some[above], jaccard[above]


def approximate_names(s1: DataFrame, noisy: DataFrame, top_n: int = 25, least: float = 0.15) -> DataFrame:
    """For each noisy row the top_n S1 rows by character trigram Jaccard of names, of at least ``least``; ties by s1_id.

    Each distinct name is compared once: the top_n rows are among the rows of the top_n names, ties by their smallest ids,
    and of a name its top_n smallest ids suffice. Blocks of S1 names and of noisy names meet in pairs, a row each; a task
    counts the common trigrams of a pair of blocks by posting lists and returns the top_n names of each noisy name.
    """
    held = s1.where("nn <> ''").groupBy("nn").agg(F.min(F.coalesce("entity_id", F.lit(""))).alias("first"))
    a = shared.written(held.select(F.monotonically_increasing_id().alias("a"), "nn", "first"), "names")
    b = shared.written(noisy.where("nn <> ''").select("nn").distinct().select(F.monotonically_increasing_id().alias("b"), "nn"), "names")
    n_a, n_b = a.count(), b.count()
    blocks, others = max(1, math.ceil(n_a / NAMES_BLOCK)), max(1, math.ceil(n_b / max(1024, min(NAMES_BLOCK // 2, n_b // 18))))
    tasks = min(4096, 3 * blocks * others)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a_rows = a.groupBy(F.pmod(F.xxhash64("nn"), F.lit(blocks)).cast("int").alias("i")).agg(F.array_sort(F.collect_list(F.struct("first", "nn", "a"))).alias("x")).select("i", F.col("x.nn").alias("a_names"), F.col("x.a").alias("a_ids"))
    b_rows = b.groupBy(F.pmod(F.xxhash64("nn"), F.lit(others)).cast("int").alias("j")).agg(F.collect_list(F.struct("nn", "b")).alias("x")).select("j", F.col("x.nn").alias("b_names"), F.col("x.b").alias("b_ids"))
    met = a_rows.select("*", every(others).alias("j")).repartition(tasks, "i", "j").join(b_rows.select("*", every(blocks).alias("i")).repartition(tasks, "i", "j"), ["i", "j"])

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a_names, a_ids, b_names, b_ids = (batch.column(c)[r].values for c in ("a_names", "a_ids", "b_names", "b_ids"))
                best = list(_best_names(a_names.to_pylist(), b_names.to_pylist(), top_n, least))
                if best:
                    theirs = np.repeat([k for k, _, _ in best], [len(p) for _, p, _ in best])
                    yield pa.RecordBatch.from_arrays([b_ids.take(pa.array(theirs)), a_ids.take(pa.array(np.concatenate([p for _, p, _ in best]))), pa.array(np.concatenate([v for _, _, v in best]))], names=["b", "a", "jaccard"])

    found = shared.written(met.select("a_names", "a_ids", "b_names", "b_ids").mapInArrow(compare, "b long, a long, jaccard double"), "links")
    if blocks > 1:
        near = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("jaccard"), "first", "a"))
        found = found.join(a.select("a", "first"), "a").withColumn("nth", near).where(F.col("nth") <= top_n).select("b", "a", "jaccard")
    place = F.row_number().over(Window.partitionBy("nn").orderBy("entity_id"))
    rows = s1.where("nn <> ''").select("entity_id", "nn").distinct().withColumn("place", place).where(F.col("place") <= top_n)
    rows = rows.join(a.select("a", "nn"), "nn").select("a", F.col("entity_id").alias("s1_id"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("jaccard"), "s1_id"))
    ranked = found.join(rows, "a").withColumn("rank", nth).where(F.col("rank") <= top_n).join(b, "b").select("nn", "s1_id", "jaccard", "rank")
    return noisy.where("nn <> ''").select(F.col("entity_id").alias("noisy_id"), "nn").distinct().join(ranked, "nn").select(*PAIR, "jaccard", "rank")


def with_names(name: str, s1: DataFrame, noisy: DataFrame, most: int = MAX_DF) -> DataFrame:
    """The distinct pairs of a union of rules and of approximate_names; of the latter, those for which no rule holds are added."""
    near = approximate_names(s1, noisy).select(*PAIR)
    if repeated_ids(s1, noisy):
        return union(pairs_of(name, s1, noisy, most), near)
    a, b = sides(UNIONS[name], s1, noisy, most)
    other = near.join(a, "s1_id", "left").join(b, "noisy_id", "left").where(~reduce(lambda x, y: x | y, [holds(r) for r in UNIONS[name]]))
    return joined(UNIONS[name], a, b).select(*PAIR).unionByName(other.select(*PAIR))


def heuristic_score(exact: Column | bool = False) -> Column:
    """Score of a pair of a_ and b_ columns: 10 for an exact name hit, else country, first token and token overlaps."""
    d = lambda x: F.lit(float(x))
    country = F.when((F.col("a_country") != "") & (F.col("a_country") == F.col("b_country")), d(1)).when((F.col("a_country") != "") & (F.col("b_country") != ""), d(-2)).otherwise(d(0))
    first = F.when(similarity.equal_not_empty(F.col("a_tok1"), F.col("b_tok1")), d(1.5)).otherwise(d(0))
    score = country + first + 3 * similarity.set_jaccard(F.col("a_nt"), F.col("b_nt")) + 2 * similarity.set_jaccard(F.col("a_at"), F.col("b_at"))
    return F.when(F.lit(exact) if isinstance(exact, bool) else exact, d(10)).otherwise(score)


def _alike(df: DataFrame, side: str, key: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """One row of ``sides`` for all records that are equal once normalised, under their smallest id, and (that id, id, more) of the records."""
    same = [f"{side}_{c}" for c in ("country", "nn", "na")]
    first = F.coalesce(F.min(key), F.lit(""))
    one = df.groupBy(*same).agg(first.alias("__first"), *[F.first(c).alias(c) for c in df.columns if c not in (key, *same, *more)])
    members = df.select(key, *same, *more).join(one.select("__first", *same), same).select("__first", key, *more)
    return one.withColumnRenamed("__first", key), members


def equal_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """All columns of the rows of a (s1_id, a_nn) and b (noisy_id, b_nn) with equal names."""
    filled = lambda df, side: df.where(_filled(f"{side}_nn"))
    return _meet(filled(a, "a"), filled(b, "b"), [("a_nn", "b_nn")])


def bounded_others(s1: DataFrame, noisy: DataFrame, top_k: int = TOP_K, most: int = MAX_DF, more: list[str] | None = None) -> DataFrame:
    """(s1_id, noisy_id, score) of ``bounded_candidates`` that are no exact name hits, with more columns of the noisy side; no id is repeated.

    Records that are equal once normalised have the same scores, so one of each is compared: the top_k rows are among those
    of the top_k such groups, ties by their smallest ids, of which the top_k smallest ids suffice.
    """
    more = more or []
    a, b = sides(["g", "e_rare"], s1, noisy, most, more)
    a, a_members = _alike(a.select("s1_id", *[f"a_{c}" for c in (*COLUMNS, "e_rare")]), "a", "s1_id")
    b, b_members = _alike(b, "b", "noisy_id", *[f"b_{c}" for c in more])
    scored = joined(["g", "e_rare"], a, b, but=["a"]).select(*PAIR, heuristic_score().alias("score"))
    nth = F.row_number().over(Window.partitionBy("__first").orderBy("s1_id"))
    few = a_members.withColumn("nth", nth).where(F.col("nth") <= top_k).select("__first", "s1_id")
    kept = _best(scored, top_k).withColumnRenamed("s1_id", "__first").join(few, "__first").select(*PAIR, "score")
    return _best(kept, top_k).withColumnRenamed("noisy_id", "__first").join(b_members, "__first").select(*PAIR, *[F.col(f"b_{c}").alias(c) for c in more], "score")


def _best(scored: DataFrame, top_k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("noisy_id").orderBy(F.desc("score"), "s1_id"))).where(F.col("rank") <= top_k).drop("rank")


def bounded_candidates(s1: DataFrame, noisy: DataFrame, top_k: int = TOP_K, most: int = MAX_DF) -> DataFrame:
    """Exact name hits, and of the other hits of rules g and e_rare the top_k of each noisy row by heuristic score.

    Ties by s1_id. The rank is filtered directly, so Spark keeps only top_k rows of a group on each side of the shuffle.
    """
    exact = rule("a", s1, noisy)
    if repeated_ids(s1, noisy):
        broad = any_of(["g", "e_rare"], s1, noisy, most).join(exact, PAIR, "left_anti")
        columns = ["country", "tok1", "nt", "at"]
        a = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
        b = noisy.select(F.col("entity_id").alias("noisy_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
        kept = _best(broad.join(a, "s1_id").join(b, "noisy_id").select(*PAIR, heuristic_score().alias("score")), top_k)
    else:
        kept = bounded_others(s1, noisy, top_k, most)
    kept = kept.select(*PAIR, "score")
    return exact.withColumn("score", F.lit(10.0)).withColumn("is_exact", F.lit(True)).unionByName(kept.withColumn("is_exact", F.lit(False)))
