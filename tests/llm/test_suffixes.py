"""Suffix-array dedup against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import queries, suffixes, textbuf

SF = "/root/testdata/sf0.001"


def plain(rows, length=100):
    """(bytes, removed spans, kept bytes) of each row; rows of one id are never earlier than each other."""
    order = [float("inf") if i is None else i for i, _ in rows]
    least, out = {}, []
    for o, (_, t) in zip(order, rows, strict=True):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            least[w] = min(least.get(w, o), o)
    for o, (_, t) in zip(order, rows, strict=True):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), set()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if least[w] < o or w in own:
                gone[s : s + length] = b"\1" * length
            own.add(w)
        spans, s = [], 0
        while (s := gone.find(1, s)) >= 0:
            e = gone.find(0, s)
            e = len(b) if e < 0 else e
            spans.append((s, e))
            s = e
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "g", "d") for r in rows], "doc_id long, text string, gram string, doc string")
    out = suffixes.remove_repeats(df, **options)
    assert out.columns == ["doc_id", "n_bytes", "removed", "kept"]
    got = [(r["doc_id"], r["n_bytes"], tuple(tuple(s) for s in r["removed"]), bytes(r["kept"])) for r in out.collect()]
    want = [(i, n, tuple(spans), kept) for (i, _), (n, spans, kept) in zip(rows, plain(rows), strict=True)]
    assert Counter(got) == Counter(want)


def texts():
    rng = random.Random(6)
    part = ["".join(rng.choice("ab c") for _ in range(n)) for n in (60, 90, 99, 100, 101, 140, 250, 400)] + ["é" * 80, "x" * 300]
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 99), (5, "y" * 100), (6, "y" * 100), (7, "y" * 350), (8, "short")]
    for k in range(60):
        t = "".join(rng.choice(part)[rng.choice([0, 0, 3]) :] + "".join(rng.choice("de f") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(rng.randrange(1, 5)))
        rows.append((100 + k, t))
    return [*rows, (300, rows[20][1]), (301, rows[20][1]), (None, rows[21][1])]


@pytest.mark.parametrize("most,batch", [(2048, 10000), (2, 10000), (2048, 5), (8, 64)])
def test_repeats(spark, most, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(spark, texts(), most=most)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def noise(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


@pytest.mark.parametrize("most", [2048, 2])
def test_rows_of_one_id(spark, most):
    """Null ids, and ids with several texts: what stands in one row only stays in it."""
    x, y = noise(1, 150), noise(2, 130)
    for other in (None, 9):
        rows = [(1, x), (other, x + noise(3, 200)), (other, noise(4, 400)), (other, noise(5, 60) + y), (other, y + noise(6, 70) + y), (other, y + noise(6, 70) + y), (other, None), (other, "")]
        check(spark, rows, most=most)
    check(spark, [(1, "z" * 40 + "w" * 100), (1, "z" * 40 + "w" * 100), (2, "w" * 100), (None, "w" * 100), (None, "w" * 101)], most=most)


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_texts_whose_polynomials_agree_modulo_a_power_of_two(spark):
    one, two = thue_morse(1024, 0), thue_morse(1024, 1)
    check(spark, [(1, one), (2, two), (3, one[100:700] + two), (4, two)])
    data = np.frombuffer((one + two).encode(), dtype=np.uint8)
    assert len(np.unique(textbuf.span_hashes(textbuf.prefix_hashes(data), np.array([0, 1024]), np.array([1024, 2048])))) == 2


@pytest.mark.parametrize("most", [2048, 4])
def test_a_common_line(spark, most):
    line = noise(7, 260)
    check(spark, [(k, noise(100 + k, 30 + 7 * k) + line + noise(200 + k % 3, 150)) for k in range(40)], most=most)


def test_long_texts(spark):
    body = noise(8, 700_000)
    check(spark, [(1, body), (2, noise(9, 50) + body[350_000:] + noise(10, 300_000)), (3, body[1:200])])


def test_span_hashes():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data[3000:4000] = data[500:1500]
    prefix = textbuf.prefix_hashes(data)
    start = rng.integers(500, 1400, 300)
    end = start + rng.integers(0, 100, 300)
    assert np.array_equal(textbuf.span_hashes(prefix, start, end), textbuf.span_hashes(prefix, start + 2500, end + 2500))
    where = np.arange(4000)
    assert len(np.unique(textbuf.span_hashes(prefix, where, where + 900))) == len({data[k : k + 900].tobytes() for k in where.tolist()})


def test_collisions_are_found():
    rng = np.random.default_rng(1)
    context = rng.integers(1, 4, size=(50, 40)).astype(np.uint8)
    context[::7, 20:] = context[0, 20:]
    group = np.sort(rng.integers(0, 4, 50))
    zero = np.zeros((50, 41), dtype=np.int64)  # every hash collides
    order, common = suffixes.sort_suffixes(zero, context, group, 20, 20, False)
    want = sorted(range(50), key=lambda i: (group[i], context[i, 20:].tobytes()))
    assert [context[i, 20:].tobytes() for i in order] == [context[i, 20:].tobytes() for i in want]
    for k in range(1, 50):
        a, b = context[order[k], 20:], context[order[k - 1], 20:]
        n = next((j for j in range(20) if a[j] != b[j]), 20)
        assert common[k] == (n if group[k] == group[k - 1] else 0)


def test_repeats_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op2_suffix_array_dedup(spark, SF).collect()}
    for (i, _), (n, spans, kept) in zip(rows, plain(rows), strict=True):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()), i
