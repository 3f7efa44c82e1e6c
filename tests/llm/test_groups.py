"""Near duplicates, vectors, shards, packing and archives against plain versions."""

import bisect
import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, neardup, packing, queries, shards, shared, vectors, warc
from tests.llm.test_scans import words
from tests.llm.test_suffixes import thue_morse

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, class_id string, SLOT string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", "s") for i, t in rows], SCHEMA)


def plain_components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def plain_near(rows, least=0.8, n=5):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) * 100 >= least * 100 * len(sets[i] | sets[j])]
    count = Counter(k for p in links for k in p)
    return [count[k] for k in range(len(rows))], plain_components([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])


@pytest.mark.parametrize("most", [4, 150, 1 << 19])
def test_components(spark, most):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    some = [*links, links[0], (None, 3), (4, None)]
    out = dict(components.connected_components(spark.createDataFrame(some, "a long, b long").repartition(5), most=most).collect())
    ids = {x for p in links for x in p if p[0] != p[1]}
    want = plain_components(sorted(ids), links)
    assert out == {i: want[i] for i in ids}
    named = spark.createDataFrame([(f"é{a:04}", f"é{b:04}") for a, b in links], "a string, b string")
    assert dict(components.connected_components(named, most=most).collect()) == {f"é{i:04}": f"é{want[i]:04}" for i in ids}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), most=most).count() == 0


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates(spark, block):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(300)) for _ in range(120)] for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, TWO"), (6, "one two three")]
    for k in range(60):
        w = list(base[k % 8])
        for _ in range(rng.choice([0, 1, 2, 3, 4, 8, 30])):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(10**6))
        rows.append((100 + k, " ".join(w)))
    rows += [(200, rows[10][1].upper()), (201, rows[10][1])]
    links, comp = plain_near(rows)
    out = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, rows), block=block).collect()}
    assert len(out) == len(rows)
    for (i, _), n in zip(rows, links, strict=True):
        assert (out[i]["class_id"], out[i]["n_links"]) == (comp[i], n), i
    kept = neardup.keep_one_of_each(frame(spark, [*rows, (None, "one two")]))
    assert kept.columns == ["doc_id", "text", "class_id", "SLOT"]
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == sorted(set(comp.values()))
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_rows_of_one_id(spark):
    """Null ids, and ids with several texts, are judged by their own texts."""
    rng = random.Random(8)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(1, text[0]), (9, text[0] + " more"), (9, text[1]), (9, text[2]), (12, text[2] + " x"), (5, text[1] + " x"), (None, text[3]), (None, text[0]), (7, text[3]), (9, text[1])]
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    want = [(1, 1, 2), (9, 1, 2), (9, 5, 2), (9, 5, 2), (9, 9, 1), (12, 9, 1), (5, 5, 2), (None, None, 0), (None, None, 0), (7, 7, 1)]
    assert got == sorted((str(i), c, n) for i, c, n in want)
    kept = [(r["doc_id"], r["text"]) for r in neardup.keep_one_of_each(frame(spark, rows)).collect()]
    assert Counter(kept) == Counter([(1, text[0]), (9, text[2]), (5, text[1] + " x"), (None, text[3]), (None, text[0]), (7, text[3])])


def test_words_whose_polynomials_agree_modulo_a_power_of_two(spark):
    rows = [(1, thue_morse(1024, 0)), (2, thue_morse(1024, 1)), (3, thue_morse(1024, 1))]
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()) == [(1, 1, 0), (2, 2, 1), (3, 2, 1)]


def changed_pairs(rng, n, share):
    """n pairs of texts of 300 words, with single words changed until their similarity is near the share."""
    rows = []
    for k in range(n):
        w = [f"v{rng.randrange(10**7)}" for _ in range(300)]
        rows.append((2 * k, " ".join(w)))
        for at in range(2, 296, max(6, round(296 / (296 * (1 - share) / (1 + share) / 5)))):
            w[at] = f"z{rng.randrange(10**7)}"
        rows.append((2 * k + 1, " ".join(w)))
    return rows


def test_recall_of_the_forest(spark):
    """Links just above the least similarity; a forest of trees cut at depth 8 finds fewer of them than one cut at 6."""
    rows = changed_pairs(random.Random(11), 1500, 0.82)
    links, _ = plain_near_pairs(rows)
    out = {r["doc_id"]: r["n_links"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    recall = sum(out.values()) / links
    print("recall", recall, "of", links)
    assert links >= 2000 and recall >= 0.999


def plain_near_pairs(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(t) for _, t in rows)]
    found = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(rows), 2)]
    return 2 * sum(s >= 0.8 for s in found), found


def test_prefixes_are_shortened_until_the_recall():
    total = neardup.TREES * neardup.DEPTH
    close, far = {total: 50, total - 10: 50}, {round(0.8 * total): 100}
    assert neardup.estimated_recall(close, neardup.DEPTH, 0.8) >= neardup.RECALL  # nothing to gain from shorter prefixes
    depth = next(d for d in range(neardup.DEPTH, 0, -1) if neardup.estimated_recall(far, d, 0.8) >= neardup.RECALL)
    assert depth == 6 and neardup.estimated_recall(far, 7, 0.8) < neardup.RECALL


def test_long_texts_are_compared_whole(spark):
    rng = random.Random(12)
    w = [f"v{rng.randrange(10**7)}" for _ in range(90_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:85_000])), (3, " ".join(w[:60_000]))]
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_near_duplicate_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    links, comp = plain_near(rows)
    out = {r["doc_id"]: r for r in queries.op1_ngram_jaccard_join(spark, SF).collect()}
    for (i, _), n in zip(rows, links, strict=True):
        assert (out[i]["class_id"], out[i]["n_links"]) == (comp[i], n)


def plain_vectors(rows, least=0.93):
    ok = []
    for _, v, label in rows:
        v = None if v is None or label is None or any(x is None for x in v) else np.array(v, dtype=float)
        ok.append(None if v is None or not len(v) or not np.isfinite(v).all() or not v.any() else v)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= least]
    count = Counter(k for p in links for k in p)
    return [count[k] for k in range(len(rows))], plain_components([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])


@pytest.mark.parametrize("block,cell", [(4096, 512), (16, 512), (4096, 8), (8, 8)])
def test_vectors(spark, block, cell):
    rng = np.random.default_rng(4)
    rows = [(1, None, 1), (2, [0.0] * 4, 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [float("nan")] * 4, 1), (5, [1.0, 0.0, 0.0, 0.0], None), (6, [1.0, 0.1, 0.0, 0.0], 1), (7, [2.0, 0.2, 0.0, 0.0], 1), (8, [], 1), (9, [1.0, 0.1, 0.0], 1), (10, [1.0, 0.1, 0.0, 0.0], 1)]
    centre = rng.normal(size=(12, 16))
    for k in range(120):
        v = centre[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.3])
        rows.append((100 + k, [float(x) for x in v.astype(np.float32)], int(k % 3 == 0)))
    rows.append((300, rows[20][1], rows[20][2]))
    links, comp = plain_vectors(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    out = {r["vec_id"]: r for r in vectors.similar_vectors(df, block=block, cell=cell).collect()}
    assert len(out) == len(rows)
    for (i, *_), n in zip(rows, links, strict=True):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (n, comp[i], comp[i] == i), i
    assert vectors.similar_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim,inner", [(64, 64), (384, 3), (768, 8)])
def test_linked_vectors_meet_in_a_cell(dim, inner):
    """Of 23 cells; vectors whose intrinsic dimensions are few vary across the borders."""
    rng = np.random.default_rng(7)
    centre, base = rng.normal(size=(60, inner)), np.linalg.qr(rng.normal(size=(dim, inner)))[0]
    x = (centre[rng.integers(60, size=3000)] + 0.25 * rng.normal(size=(3000, inner))) @ base.T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = vectors.fit_cells(x, 23)
    home, guest = vectors.homes_and_guests(x, centres, vectors.margin(0.93))
    assert len(np.unique(home)) > 15
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert len(a) > 1000 and np.all((home[a] == home[b]) | guest[a, home[b]] | guest[b, home[a]])


@pytest.mark.parametrize("dim,inner", [(64, 64), (768, 2), (768, 8)])
def test_links_over_many_cells(spark, dim, inner):
    """All links, as by brute force, though the vectors lie in twelve cells and more; circles and clusters."""
    rng = np.random.default_rng(6)
    base = np.linalg.qr(rng.normal(size=(dim, inner)))[0]
    x = rng.normal(size=(1200, inner)) if inner < 8 else rng.normal(size=(80, inner))[rng.integers(80, size=1200)] + 0.2 * rng.normal(size=(1200, inner))
    x = (x @ base.T).round(6)
    label = rng.integers(2, size=1200)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.93) & (label[:, None] == label[None])).sum(axis=1) - 1
    rows = [(k, x[k].tolist(), int(label[k])) for k in range(1200)]
    out = {r["vec_id"]: r["n_links"] for r in vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=50).collect()}
    got = np.array([out[k] for k in range(1200)])
    print("recall", got.sum() / want.sum(), "of", want.sum())
    assert want.sum() > 1000 and np.array_equal(got, want)


def test_vectors_are_written_once(spark):
    """Many cells near each other don't multiply what is shuffled and kept; all links of a label in several blocks."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 64)).astype(np.float32)
    x[4000:] = x[:1000] + (0.03 * rng.normal(size=(1000, 64))).astype(np.float32)
    kept = lambda: set(glob.glob(shared.folder(spark) + "/blocks-*"))
    before = kept()
    df = spark.createDataFrame([(k, x[k].tolist(), 0) for k in range(5000)], "vec_id long, embedding array<float>, label int")
    out = vectors.similar_vectors(df, cell=50, block=700).agg(F.sum("n_links"), F.count_if("kept")).first()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert tuple(out) == (int((unit @ unit.T >= 0.93).sum()) - 5000, 4000)
    (written,) = kept() - before
    sizes = spark.read.parquet(written).select(F.size("reps"), F.length("vectors")).collect()
    assert len(sizes) > 7 and (sum(a for a, _ in sizes), sum(b for _, b in sizes)) == (5000, 5000 * 64 * 4)


def greedy(sizes, most):
    n, at = 1, 0
    for s in sizes:
        if at + s > most:
            n, at = n + 1, 0
        at += s
    return n


@pytest.mark.parametrize("n", [24, 3])
def test_shards(spark, n):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "é" * 10)] + [(10 + k, "t" * rng.choice([1, 5, 50, 400]) + str(k % 57)) for k in range(200)] + [(500 + k, "copy" * 20) for k in range(60)]
    out = shards.assign_shards(frame(spark, rows), shards=n).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "class_id", "size", "text_crc32", "shard", "slot"}
    by, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in out:
        t = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))
        by[r["text"] or ""].add(r["shard"])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the smallest capacity for the groups in the order of their hashes
    order = frame(spark, rows).selectExpr("xxhash64(coalesce(text, '')) k", "octet_length(coalesce(text, '')) + 8 s").groupBy("k").sum("s").orderBy("k").collect()
    sizes = [r[1] for r in order]
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= n)
    assert max(load.values()) == best or max(load.values()) <= best
    assert shards.assign_shards(frame(spark, []), shards=n).count() == 0


def test_shard_query(spark):
    out = queries.op3_sharding(spark, "/root/testdata/sf0.01").collect()
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert len(out) == 1000 and set(load) == set(range(24))
    assert max(load.values()) < 1.5 * sum(load.values()) / 24


def test_plan_is_best_fit():
    rng = random.Random(2)
    for capacity in (8, 64, 1024):
        lengths = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(3000)]
        counts = Counter(lengths)
        rows = packing.plan(dict(counts), capacity)
        used, ranks = defaultdict(list), defaultdict(list)
        for length, rank, number, first, offset in rows:
            ranks[length] += range(rank, rank + number)
            for k in range(number):
                used[first + k].append((offset, length))
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= n]
            if fit:
                bins[min(fit, key=lambda b: bins[b])] -= n
            else:
                bins.append(capacity - n)
        assert len(used) <= len(bins) * 1.002 + 1


def plain_best_fit(lengths, capacity):
    bins = []  # gaps, sorted
    n = 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(bins, x)
        if k == len(bins):
            n += 1
            gap = capacity
        else:
            gap = bins.pop(k)
        if gap > x:
            bisect.insort(bins, gap - x)
    return n


def test_packing_in_lanes(spark):
    """Ties, hot lengths and rows that are alike, over two rounds and more: as many sequences as plain best fit needs, or nearly."""
    path, pattern = queries.tokenizer()
    rng = random.Random(14)
    word = [f"word{k} " for k in range(40)]
    rows = [(1, "the same text")] * 3000 + [(None, None)] * 2000 + [(k, "".join(rng.choice(word) for _ in range(min(700, int(rng.expovariate(1 / 60)))))) for k in range(6000)]
    out = packing.pack(frame(spark, rows), path, pattern, lane=2048).collect()
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = [r["length"] for r in out]
    assert len(lengths) >= len(rows) and sum(lengths) == sum(len(x) + 1 for x in packing.encoder(path, pattern)([t or "" for _, t in rows]))
    assert len(sequences) <= plain_best_fit(lengths, 1024) + 1
    with pytest.raises(ValueError):
        packing.pack(frame(spark, rows), path, pattern, lane=100)


def test_packing(spark):
    from tokenizers import Tokenizer

    path, pattern = queries.tokenizer()
    plain = Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (2, ""), (3, "a <|endoftext|> b's  \n\n x  ٣ 12345"), (None, "null id")] + [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows] + [(900, "é" * 5000), (901, " " * 3000 + "x")]
    out = packing.pack(frame(spark, rows), path, pattern, with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = packing.cut_points(len(ids), 1024)
        assert all(b - a == 1024 for a, b in zip(cuts[1:], [*cuts[2:], len(ids)])) and all(a < 1025 for a in cuts[1:2])
        for p, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want[(i, p, s, e - s, np.array(ids[s:e], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r["length"] for r in out) // 1024)
    assert len(sequences) <= least * 1.02 + 1
    assert packing.pack(frame(spark, []), path, pattern).count() == 0


def test_archives(spark):
    rows = [(5, "http://a/\nb", "é" * 60), (3, None, "é" * 60), (9, "u", "é" * 60), (4, "u", "short"), (2, "u", "short"), (None, "u", None), (7, "u", ""), (None, "u", "n" * 200), (None, "u", "n" * 200), (3, None, "é" * 60), (8, "u", "WARC/1.1\r\n\r\n" * 30)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    for size in (1 << 24, 64):
        manifest = warc.write_warc(pages, shared.new_folder(spark, "warc"), archive_bytes=size)
        out = warc.read_warc(manifest, pages.schema["page_id"].dataType).collect()
        assert len(out) == len(rows)
        first = {"é" * 60: 3}
        want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), str(first.get(h) if first.get(h) not in (None, i) else None)) for i, _, h in rows)
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], str(r["refers_to"])) for r in out) == want
        assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in out)
    empty = warc.write_warc(pages.limit(0), shared.new_folder(spark, "warc"))
    assert warc.read_warc(empty).count() == 0


def test_archives_are_read_by_several_tasks(spark):
    rows = [(k, "u", f"{k} " + "x" * 2000) for k in range(300)] + [(1000, "u", "é" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(1)
    manifest = warc.write_warc(pages, shared.new_folder(spark, "warc"), archive_bytes=20_000)
    read = warc.read_warc(manifest, pages.schema["page_id"].dataType)
    assert manifest.count() >= 25 and read.rdd.getNumPartitions() >= 7
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read.collect()} == {i: h for i, _, h in rows}


def test_archive_query(spark):
    pages = queries.table(spark, SF, "pages").collect()
    out = {r["page_id"]: r for r in queries.op8_warc(spark, SF).collect()}
    assert {p["page_id"]: hashlib.sha256(p["html"].encode()).hexdigest() for p in pages} == {i: r["payload_digest"] for i, r in out.items()}
