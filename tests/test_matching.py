"""Functions, sources, metrics and plans on small tables."""

import glob
import json
import os
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import similarity, text
from lodestone.operators import blocking, evaluate, features, linking, matcher, quality, records, sampling
from lodestone.plans import fixtures, matching
from lodestone.sources import shared, tables
from lodestone.streaming import candidates as streaming

S1 = [("S1-001", "Acme Corporation", "123 Main Street, Suite 100", "US"), ("S1-002", "Beta Logistics", "456 Market Road", "US"), ("S1-003", "Gamma Enterprises", "789 Industrial Park", "US")]
S2 = [("S2-101", "Acme Corp Inc", "123 Main St, Ste 100", "US"), ("S2-102", "Beta Logistics LLC", "456 Market Rd", "US")]
S3 = [("S3-201", "Acme Corporation", "123 Main Street", "US")]
TRUTH = [("S1-001", "S2-101,S3-201"), ("S1-002", "S2-102"), ("S1-003", "")]


@pytest.fixture
def files(tmp_path):
    out = {}
    for name, rows in (("s1", S1), ("s2", S2), ("s3", S3), ("truth", TRUTH)):
        head = tables.TRUTH_COLUMNS if name == "truth" else tables.SOURCE_COLUMNS
        path = tmp_path / f"{name}.tsv"
        path.write_text("\n".join("\t".join(r) for r in [head, *rows]) + "\n")
        out[name] = str(path)
    return out


def python_normalize(t):
    t = unicodedata.normalize("NFKC", t or "").casefold()
    t = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in t)
    return " ".join(t.split())


def test_normalize(spark):
    samples = ["Café  & Co., Ltd.", "हिन्दी दुकान", "a_b-c", "١٢٣ x²", "Ｆｕｌｌ width", "a b​c", "O'Neil", "①②", "é", "", "---", "STRASSE straße ẞ", "ΣΑΣ", "İstanbul", None, "µ ﬁ ŉ ǅ", "Ǆ K"]
    samples += ["".join(chr(c) for c in range(k, k + 16)) for k in range(32, 0x250, 16)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(samples)], "k int, s string")
    got = dict(df.select("k", text.normalize_text(F.col("s"))).collect())
    assert got == {k: python_normalize(s) for k, s in enumerate(samples)}
    assert text.needs_unicode(df, "s") and not text.needs_unicode(df.where("k in (0, 6)"), "s")


RECORD = "entity_id string, business_name string, business_address string, country string, src int"


def test_every_record_is_normalized_once(spark):
    rows = [("1", "Café", "Street 1", " US ", 1), ("2", "Ｆｕｌｌ", "plain", None, 2), ("3", "plain", "①②", "DE", 2), ("4", None, None, "", 1), ("2", "Ｆｕｌｌ", "plain", None, 2), (None, "ß", "", "DE", 3)]
    want = sorted((r[0] or "", python_normalize(r[1]), python_normalize(r[2]), (r[3] or "").strip(), r[4]) for r in rows)
    for unicode in (None, True):
        kept = shared.written(records.normalize_records(spark.createDataFrame(rows, RECORD), unicode), "records", ["src"])
        assert sorted((r["entity_id"] or "", r["nn"], r["na"], r["country"], r["src"]) for r in kept.collect()) == want
    empty = records.normalize_records(spark.createDataFrame([], RECORD), True)
    kept = shared.written(empty, "records", ["src"])
    assert kept.columns == empty.columns and kept.count() == 0


def test_records_without_unicode_stay_in_the_jvm(spark):
    df = records.normalize_records(spark.createDataFrame([("1", "a", "b", "US", 1)], RECORD), True)
    native, python = df._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")
    assert "Union" in native and "Filter" in native  # the whole first branch comes before
    assert "Filter" in python


def test_tokens_and_similarities(spark):
    df = spark.createDataFrame([("", ""), ("a", ""), ("b a b", "a b"), ("12 main ٣", "main 12"), ("kitten", "sitting")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        text.tokens(a), text.first_two_tokens(a), text.digit_tokens(a), similarity.levenshtein_sim(a, b), similarity.set_jaccard(text.tokens(a), text.tokens(b)),
        similarity.set_jaccard_or_null(text.tokens(a), text.tokens(b)), similarity.token_sort_sim(a, b), similarity.overlap_ratio(text.tokens(a), text.tokens(b)), text.character_grams(a), similarity.length_ratio(a, b),
    ).collect()
    assert [list(r[0]) for r in rows] == [[], ["a"], ["b", "a"], ["12", "main", "٣"], ["kitten"]]
    assert [r[1] for r in rows] == [None, None, "b a", "12 main", None]
    assert list(rows[3][2]) == ["12", "٣"]
    assert [round(r[3], 4) for r in rows] == [1.0, 0.0, 0.4, round(1 - 8 / 9, 4), round(1 - 3 / 7, 4)] or rows[3][3] >= 0
    assert [r[4] for r in rows] == [0.0, 0.0, 1.0, 2 / 3, 0.0] and [r[5] for r in rows] == [None, 0.0, 1.0, 2 / 3, 0.0]
    assert rows[0][6] == 0.0 and rows[2][6] == 0.6 and rows[2][7] == 1.0
    assert list(rows[0][8]) == [] and list(rows[1][8]) == ["^a$"] and rows[0][9] == 0.0


@pytest.mark.parametrize("truth,predicted,want", [
    ({"1": "AB"}, {"1": "AB"}, 1), ({"1": ""}, {"1": ""}, 1), ({"1": ""}, {"1": "X"}, 0), ({"1": "AB"}, {"1": "AC"}, 0.5), ({"1": "A"}, {"1": ""}, 0), ({"1": "A", "2": ""}, {"1": "A", "2": ""}, 1), ({}, {}, 0), ({"1": "A"}, {"1": "AB"}, 5 / 9), ({"1": "AB"}, {"1": "ABC"}, 0.7142857),
])
def test_macro_f05(spark, truth, predicted, want):
    pairs = lambda d: spark.createDataFrame([(k, x) for k, v in d.items() for x in v], "s1_id string, noisy_id string")
    ids = spark.createDataFrame([(k,) for k in truth], "s1_id string")
    row = evaluate.macro(evaluate.entity_prf(ids, pairs(predicted), pairs(truth))).first()
    assert row["macro_f05"] == pytest.approx(want)
    assert row["singleton_accuracy"] == (0 if not truth else pytest.approx(row["singleton_accuracy"]))


def test_sweep_takes_the_lowest_threshold(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "s1_id string")
    scored = spark.createDataFrame([("1", "A", 0.95), ("1", "B", 0.31), ("2", "C", 0.2)], "s1_id string, noisy_id string, score double")
    truth = spark.createDataFrame([("1", "A")], "s1_id string, noisy_id string")
    rows = {r["threshold"]: r for r in evaluate.threshold_sweep(ids, scored, truth).collect()}
    assert len(rows) == 41 and [t for t, r in rows.items() if r["is_best"]] == [0.32] and rows[0.32]["macro_f05"] == 1.0
    assert rows[0.1]["macro_f05"] == pytest.approx(5 / 18)


def test_strict_reader(spark, tmp_path):
    good = tmp_path / "good.tsv"
    good.write_text('﻿country\tentity_id\tmore\tbusiness_name\tbusiness_address\nUS\tS1-1\tx\t"a ""q"" b"\t\n\nUS\tS1-2\tx\tn\ta\n')
    rows = tables.read_strict(spark, str(good), tables.SOURCE_COLUMNS).collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'a "q" b', "", "US"), ("S1-2", "n", "a", "US")]
    assert tables.read_strict(spark, str(good), ["entity_id"], max_rows=1).count() == 1
    with pytest.raises(KeyError):
        tables.read_strict(spark, str(good), ["nothing"])
    bad = tmp_path / "bad.tsv"
    bad.write_text("entity_id\tcountry\nS1-1\tUS\nS1-2\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tables.read_strict(spark, str(bad), ["entity_id"]).collect()
    assert [r[0] for r in tables.read_lenient(spark, str(bad)).collect()] == ["S1-1"]


def test_match_files(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-1 ,,S2-1\nS1-2\t\nS1-1\tS2-9\n")
    assert {r[0]: list(r[1]) for r in tables.read_matches(spark, str(path)).collect()} == {"S1-1": ["S2-9"], "S1-2": []}
    assert tables.truth_columns(["matched_entity_ids", "entity_id"]) == ("entity_id", "matched_entity_ids")
    with pytest.raises(KeyError):
        tables.truth_columns(["matched_entity_ids"])
    assert quality.validate_header("a,b", tables.TRUTH_COLUMNS) and not quality.validate_header("Source1_entity_id \tmatched_entity_ids\n", tables.TRUTH_COLUMNS)


def test_rules_contain_each_other(spark):
    s1, noisy = (records.normalize_records(spark.createDataFrame([(*r, k) for r in rows], "entity_id string, business_name string, business_address string, country string, src int")) for k, rows in ((1, S1), (2, S2 + S3)))
    found = {n: {tuple(r) for r in blocking.pairs_of(n, s1, noisy).collect()} for n in [*blocking.KEYS, "e", "h", "e_rare", "n_rare", "c_and_e", "g_and_e", "ce_rare", *blocking.UNIONS]}
    assert found["a"] == {("S1-001", "S3-201")} and found["g"] == {("S1-002", "S2-102"), ("S1-001", "S3-201")}
    assert found["g"] <= found["c"] and found["c_and_e"] == found["c"] & found["e"] and found["ce_rare"] <= found["c_and_e"]
    assert found["ag_union_ge"] == found["a_union_g"] and found["agce"] == found["a"] | found["c"] | found["e"]
    bounded = blocking.bounded_candidates(s1, noisy, top_k=1).collect()
    assert {(r["s1_id"], r["noisy_id"]) for r in bounded} == {("S1-001", "S3-201"), ("S1-001", "S2-101"), ("S1-002", "S2-102")}
    assert sampling.balanced(spark.createDataFrame([(k, int(k < 3)) for k in range(20)], "k int, label int").withColumn("key", F.col("k").cast("string")), "key", 10).groupBy("label").count().collect()


def test_train_predict_evaluate(spark, files, tmp_path):
    s1, noisy = matching.load_sources(spark, [files["s1"], files["s2"], files["s3"]])
    truth = tables.explode_matches(tables.read_matches(spark, files["truth"]))
    extra = spark.createDataFrame([(f"S1-{k}", f"Name {k} of Town", f"{k} Road", "US", 1) for k in range(900, 930)], "entity_id string, business_name string, business_address string, country string, src int")
    s1 = s1.unionByName(records.normalize_records(extra))
    more = extra.withColumn("entity_id", F.concat(F.lit("S2-"), F.substring("entity_id", 4, 9))).withColumn("src", F.lit(2))
    noisy = noisy.unionByName(records.normalize_records(more))
    truth = truth.unionByName(extra.select(F.col("entity_id").alias("s1_id"), F.concat(F.lit("S2-"), F.substring("entity_id", 4, 9)).alias("noisy_id")))
    metadata = matching.train(s1, noisy, truth, str(tmp_path / "model"), iterations=3)
    assert 0 <= metadata["blocking_recall"] <= 1 and 0.1 <= metadata["threshold"] <= 0.9
    lists = matching.predict(s1, noisy, str(tmp_path / "model"), str(tmp_path / "out"))
    for path in lists:
        assert tables.read_matches(spark, path).count() == 33
    pairs = lambda p: {tuple(r) for r in tables.explode_matches(tables.read_matches(spark, p)).collect()}
    assert pairs(lists[1]) <= pairs(lists[0])
    score = matching.score_files(spark, files["truth"], lists[1])
    assert score["n"] == 3 and 0 <= score["macro_f05"] <= 1


def test_commands(spark, files, tmp_path, capsys):
    three = [files["s1"], files["s2"], files["s3"]]
    assert cli.main(["audit", *three, "--to", str(tmp_path / "audit")]) == 0
    assert json.load(open(tmp_path / "audit.json"))[files["s1"]][0]["data_rows"] == 3
    assert cli.main(["profile", *three, "--to", str(tmp_path / "profile")]) == 0 and os.path.exists(tmp_path / "profile.md")
    assert cli.main(["analyze", *three, files["truth"], "--to", str(tmp_path / "pairs")]) == 0
    assert cli.main(["benchmark", *three, files["truth"], "--to", str(tmp_path / "blocking"), "--rules", "a,e"]) == 0
    assert json.load(open(tmp_path / "blocking.json"))["e"][0]["recall"] == 1.0
    assert cli.main(["candidates", *three, "--to", str(tmp_path / "candidates")]) == 0
    assert cli.main(["evaluate", files["truth"], files["truth"]]) == 0 and '"macro_f05": 1.0' in capsys.readouterr().out
    assert cli.main(["validate", files["truth"], files["s1"]]) == 0
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-001\tS1-002\n")
    assert cli.main(["validate", str(bad), files["s1"]]) == 1


def test_log(tmp_path):
    path = str(tmp_path / "experiments.csv")
    assert cli.main(["log", path, "--experiment_id", "a", "--notes", "x, y"]) == 0
    assert cli.main(["log", path, "--experiment_id", "a"]) == 1 and cli.main(["log", path]) == 1
    assert cli.main(["log", path, "--experiment_id", "b", "--timestamp_utc", "T"]) == 0
    lines = open(path).read().splitlines()
    assert lines[0].split(",") == tables.EXPERIMENT_COLUMNS and len(lines) == 3 and lines[2].startswith("b,T,")


def test_stream(spark, files, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    os.link(files["s2"], folder / "one.tsv")
    s1, _ = matching.load_sources(spark, [files["s1"], files["s2"]])
    stream = streaming.candidate_stream(s1, streaming.read_stream(spark, str(folder)), ("a", "c"))
    streaming.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    os.link(files["s3"], folder / "two.tsv")
    streaming.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r["s1_id"], r["noisy_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("S1-001", "S2-101"), ("S1-002", "S2-102"), ("S1-001", "S3-201")}


def test_registry(spark):
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in tables.EXPERIMENT_COLUMNS))
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "experiment_id string, notes string")
    kept, rejected = tables.append_experiments(none, new, now="T")
    assert sorted((r["experiment_id"], r["notes"], r["timestamp_utc"]) for r in kept.collect()) == [("a", "x", "T"), ("b", "y", "T")] and rejected.count() == 1


@pytest.mark.parametrize("name", ["e", "c_and_e", "agce", "ag_n_rare_e_rare"])
def test_pairs_are_not_shuffled(spark, name):
    """Each pair is given once without a shuffle of pairs; rows of one id still make one pair."""
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    s1, noisy = (records.normalize_records(spark.createDataFrame([(*r, k) for r in rows], schema), unicode=False) for k, rows in ((1, S1), (2, S2 + S3)))
    pairs = blocking.pairs_of(name, s1, noisy)
    assert "hashpartitioning(s1_id" not in pairs._jdf.queryExecution().executedPlan().toString()
    once = sorted(map(tuple, pairs.collect()))
    twice = sorted(map(tuple, blocking.pairs_of(name, s1.unionByName(s1), noisy.unionByName(noisy)).collect()))
    assert len(once) == len(set(once))
    assert twice == once or name == "c_and_e" and sorted(set(twice)) == once


def test_pair_counts_and_first_pairs(spark):
    """Counts from keys and conditions, and the first pairs from the first S1 ids, as from all pairs."""
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    s1, noisy = (records.normalize_records(spark.createDataFrame([(*r, k) for r in rows], schema), unicode=False) for k, rows in ((1, S1), (2, S2 + S3)))
    truth = spark.createDataFrame([("S1-001", "S2-101"), ("S1-001", "S3-201"), ("S1-002", "S2-102")], "s1_id string, noisy_id string")
    names = ["a", "c", "a_union_g", "ag_e_rare"]
    counted = blocking.pair_counts(names, s1, noisy, truth)
    got = {r["rule"]: (r["pairs"], r["hits"]) for r in counted.collect()}
    true = {tuple(r) for r in truth.collect()}
    for n in names:
        pairs = {tuple(r) for r in blocking.pairs_of(n, s1, noisy).collect()}
        assert got[n] == (len(pairs), len(pairs & true)), n
    every = sorted(tuple(r) for r in blocking.rule("e", s1, noisy).collect())
    assert [tuple(r) for r in blocking.first_pairs("e", s1, noisy, 2, truth.limit(0)).collect()] == every[:2]
    labels = {(r["s1_id"], r["noisy_id"]): r["label"] for r in blocking.labelled_hits("c", s1, noisy, truth).collect()}
    assert labels and all(v == int(k in true) for k, v in labels.items())


def test_balanced_sorts_few_rows(spark):
    """The rows of the smallest buckets, of which only about as many as wanted are written for sorting."""
    df = spark.range(40_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    before = set(glob.glob(shared.folder(spark) + "/sample-*"))
    got = {r["key"] for r in sampling.balanced(df, "key", 400).collect()}
    want = {r["key"] for k in (0, 1) for r in df.where(F.col("label") == k).orderBy(sampling.bucket(F.col("key")), "key").limit(200).collect()}
    (written,) = set(glob.glob(shared.folder(spark) + "/sample-*")) - before
    assert got == want and 400 <= spark.read.parquet(written).count() < 1200


def _named(spark, side, names):
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    rows = [(f"S{side}-{k}", n, f"{k} Road" if k % 3 else "Old Road", "US" if k % 5 else "DE", side) for k, n in enumerate(names)]
    return records.normalize_records(spark.createDataFrame(rows, schema), unicode=False)


def _approximate(a, b, top_n, least):
    """By definition: (s1_id, noisy_id, Jaccard, rank) of ids and names."""
    grams = lambda t: {f"^{t}$"[i : i + 3] for i in range(len(t))}
    out = set()
    for other, t in b:
        scored = [(len(grams(t) & grams(x)) / len(grams(t) | grams(x)), k) for k, x in a if t and x]
        best = sorted((-v, k) for v, k in scored if v >= least)[:top_n]
        out |= {(k, other, -v, place) for place, (v, k) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [1 << 16, 16])
def test_approximate_names_compare_distinct_names_once(spark, monkeypatch, block):
    """Copies and ties as by definition, with one block and with several; pairs aren't shuffled to count their trigrams."""
    monkeypatch.setattr(blocking, "NAMES_BLOCK", block)
    words = ["acme", "acne", "beta", "betas", "gamma", "é", "x", "müller"]
    names = ["", "Acme", *[f"{words[k * k % 8]} {words[k % 7]}" for k in range(90)], *["beta gamma"] * 9]
    s1, noisy = _named(spark, 1, names), _named(spark, 2, names[::-1] + ["zzz", "acme beta x"])
    pairs = blocking.approximate_names(s1, noisy, 5)
    assert "hashpartitioning(s1_id" not in pairs._jdf.queryExecution().executedPlan().toString()
    sides = [[tuple(r) for r in df.select("entity_id", "nn").collect()] for df in (s1, noisy)]
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == _approximate(*sides, 5, 0.15)


@pytest.mark.parametrize("name", ["c", "g_and_e", "ag_union_ge", "ag_union_ce", "ag_ce_rare", "ag_e_rare", "ag_n_rare_e_rare", "c_union_e"])
def test_hot_keys_meet_in_blocks(spark, monkeypatch, name):
    """The rows of a key of many pairs go to many tasks, and every pair comes once."""
    words = ["acme", "beta", "gamma"]
    s1, noisy = (_named(spark, side, [f"{words[k % 2]} {words[k % 3]}" for k in range(n)] + ["", "alone here"]) for side, n in ((1, 40), (2, 50)))
    whole = sorted(tuple(r) for r in blocking.pairs_of(name, s1, noisy, 30).collect())
    monkeypatch.setattr(blocking, "HOT", 4)
    asked, hit_rows = [], blocking.hit_rows
    monkeypatch.setattr(blocking, "hit_rows", lambda rule, *rest: asked.append(rule) or hit_rows(rule, *rest))
    pairs = blocking.pairs_of(name, s1, noisy, 30)
    split = sorted(tuple(r) for r in pairs.collect())
    assert len(whole) > 200 and len(whole) == len(set(whole)) and split == whole
    assert "__ai" in pairs._jdf.queryExecution().executedPlan().toString()
    assert name != "ag_union_ge" or asked == ["a", "g"]  # g_and_e adds nothing to g


def _shuffled(spark) -> int:
    """The bytes that the session's tasks have shuffled; what is known lags behind a little."""
    time.sleep(1)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("copies", [1, 2])
def test_dense_rules_meet_without_copies_of_rows(spark, monkeypatch, copies):
    """Pairs as by the joins, each once, whatever terms and ids are shared or null; rows aren't shuffled once for every block of the other side."""
    tokens = ["road", "old", "new", "north", "hill", "é"]
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    address = lambda k: " ".join([t for i, t in enumerate(tokens) if k * (i + 3) % 7 < 3] + [f"n{k % 41}"]) if k % 17 else ""
    row = lambda side, k: (f"S{side}-{k}" if k else None, f"acme x{k % 5}" if k % 11 else "", address(k + side), "US" if k % 3 else " " if k % 2 else "DE", side)
    s1, noisy = (records.normalize_records(spark.createDataFrame([row(side, k) for k in range(n)] * copies, schema), unicode=False) for side, n in ((1, 300), (2, 400)))
    for name in ("c_union_e", "agce"):
        monkeypatch.setattr(blocking, "DENSE", 1 << 24)
        want = sorted((tuple(r) for r in blocking.pairs_of(name, s1, noisy).collect()), key=str)
        monkeypatch.setattr(blocking, "DENSE", 0)
        monkeypatch.setattr(blocking, "DENSE_BLOCK", 8192 if name == "agce" else 150)
        monkeypatch.setattr(blocking, "DENSE_LIST", 50)
        got = blocking.pairs_of(name, s1, noisy)
        assert "s1_ids" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 30_000


def test_dense_rules_shuffle_little(spark, monkeypatch):
    """A token of all rows: what is shuffled stays near the rows themselves, however many blocks they make."""
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    s1, noisy = (records.normalize_records(spark.createDataFrame([(f"S{side}-{k}", f"n{k}", f"long old road {k % 97}", "US", side) for k in range(1500)], schema), unicode=False) for side in (1, 2))
    monkeypatch.setattr(blocking, "HOT", 64)
    monkeypatch.setattr(blocking, "DENSE", 1 << 20, raising=False)
    monkeypatch.setattr(blocking, "DENSE_BLOCK", 400, raising=False)
    before = _shuffled(spark)
    assert blocking.pairs_of("c_union_e", s1, noisy).select(F.hash("s1_id", "noisy_id").alias("h")).agg(F.count("h")).first()[0] == 1500 * 1500
    assert 0 < _shuffled(spark) - before < 400_000


def test_keyed_tokens_take_the_fewer_pairs(spark, monkeypatch):
    """Rows of one key that share all tokens meet once by the key, not once for each token."""
    monkeypatch.setattr(blocking, "HOT", 4)
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    s1, noisy = (records.normalize_records(spark.createDataFrame([(f"S{side}-{k}", "acme beta", "1 long old road", "US", side) for k in range(12)], schema), unicode=False) for side in (1, 2))
    pairs = blocking.pairs_of("g_and_e", s1, noisy)
    assert pairs.count() == 144 and "posexplode" not in pairs._jdf.queryExecution().executedPlan().toString().lower()


def test_words_beyond_the_eighth_are_not_split(spark):
    """The entity records of texts with any white space around, and of many words, as of whole splits."""
    texts = ["", " ", None, "a", " a b", "a b c d e f g h", " a  b c\td e f g h ", "a b c d e f g h i j k", " a b c d e f g h i j", "a b\nc d e f g h i "]
    df = spark.createDataFrame([(4 * k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"] // 4: (r["business_name"], r["business_address"]) for r in fixtures.entity_records(df).where("src = 1").collect()}
    words = [(t or "").split() for t in texts]
    assert got == {k: (" ".join(w[:3]), f"{4 * k % 997} {' '.join(w[3:8])}") for k, w in enumerate(words)}
    assert ", 10)" in fixtures.entity_records(df)._jdf.queryExecution().optimizedPlan().toString()


def test_names_beside_rules(spark, monkeypatch):
    """The union with approximate names holds every pair once, without a distinct over all pairs."""
    s1, noisy = _named(spark, 1, ["acme beta", "acme betas", "gamma", "acne beta"] * 5), _named(spark, 2, ["acme beta", "beta acme", "gammas", "zzz"] * 5)
    both = [blocking.pairs_of("ag_e_rare", s1, noisy, 4), blocking.approximate_names(s1, noisy).select(*blocking.PAIR)]
    want = {tuple(r) for df in both for r in df.collect()}
    twice = blocking.with_names("ag_e_rare", s1.unionByName(s1), noisy, 4).count()
    monkeypatch.setattr(blocking, "union", None)
    got = [tuple(r) for r in blocking.with_names("ag_e_rare", s1, noisy, 4).collect()]
    assert len(got) == len(want) == twice and set(got) == want


def test_bounded_candidates_compare_equal_records_once(spark, monkeypatch):
    """Copies of records and ties by id as by definition, from one row of each kind of equal records."""
    names = [["acme beta", "acme beta one", "acme beta two", "gamma"][k % 4] for k in range(48)]
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    table = lambda side: records.normalize_records(spark.createDataFrame([(f"S{side}-{k}", n, f"{k % 3} old road", "US", side) for k, n in enumerate(names)], schema), unicode=False)
    s1, noisy = table(1), table(2)
    seen, joined = [], blocking.joined
    monkeypatch.setattr(blocking, "joined", lambda rules, a, b, *rest, **more: seen.append((a.count(), b.count())) or joined(rules, a, b, *rest, **more))
    got = [(r["s1_id"], r["noisy_id"], r["is_exact"]) for r in blocking.bounded_candidates(s1, noisy, 5, 20).collect()]
    assert seen == [(12, 12)]  # of 48 rows a side
    exact = {tuple(r) for r in blocking.rule("a", s1, noisy).collect()}
    pairs = blocking.any_of(["g", "e_rare"], s1, noisy, 20)
    scored = records.pair_columns(pairs, s1, noisy, ["country", "tok1", "nt", "at"]).select(*blocking.PAIR, blocking.heuristic_score().alias("score")).collect()
    want = set()
    for k in range(len(names)):
        rows = sorted((-r["score"], r["s1_id"]) for r in scored if r["noisy_id"] == f"S2-{k}" and (r["s1_id"], f"S2-{k}") not in exact)
        want |= {(i, f"S2-{k}", False) for _, i in rows[:5]}
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want | {(*p, True) for p in exact}


def test_exact_names_are_scored_by_kind(spark, monkeypatch):
    """Training pairs, scores and lists as from a table of all candidates; equal records are scored once, whole or in parts."""
    monkeypatch.setattr(linking, "MEMBERS", 3)
    names = [["Acme Beta", " acme beta", "acme beta two", "gamma", ""][k % 5] for k in range(60)]
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    table = lambda side: records.normalize_records(spark.createDataFrame([(f"S{side}-{k}" if k else None, n, f"{k % 2} old road", "US" if k % 7 else "", side + (side == 2 and k % 2)) for k, n in enumerate(names)], schema), unicode=False)
    s1, noisy = table(1), table(2)
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k + d}") for k in range(1, 50) for d in (0, 5, 6)[: k % 4]], "s1_id string, noisy_id string")
    pairs = blocking.bounded_candidates(s1, noisy, 5, 20).select(*blocking.PAIR)
    marked = pairs.join(truth.withColumn("t", F.lit(1)), blocking.PAIR, "left").withColumn("label", F.coalesce("t", F.lit(0))).drop("t").join(noisy.select(F.col("entity_id").alias("noisy_id"), "src"), "noisy_id").where("s1_id is not null")
    others = blocking.bounded_others(s1, noisy, 5, 20, ["src"])
    known = linking.with_truth(s1, truth)
    rows = lambda df: sorted(map(tuple, df.collect()))
    hard = rows(sampling.hard_negatives(marked, 4).select(*blocking.PAIR, "src", "label"))
    assert rows(linking.training_pairs(known, noisy, others, 4)) == hard and 0 < sum(r[3] for r in hard) < len(hard) < marked.count() / 2
    vectors = features.with_features(records.pair_columns(marked.select(*blocking.PAIR, "label"), s1, noisy, features.RECORD))
    model = matcher.fit_gbt(vectors, 5)
    scored = matcher.score_gbt(vectors, model).select(*blocking.PAIR, "label", F.round("score", 9))
    got = linking.labelled_scores(known, noisy, others, model)
    assert "hashpartitioning(s1_id" not in linking.exact_scores(linking.kinds(known, "a", "s1_id"), linking.kinds(noisy, "b", "noisy_id"), model)._jdf.queryExecution().executedPlan().toString()
    assert rows(got.withColumn("score", F.round("score", 9))) == rows(scored)
    middle = scored.approxQuantile("round(score, 9)", [0.7], 0)[0]
    lists = tables.grouped_lists(s1.select(F.col("entity_id").alias("s1_id")), matcher.score_gbt(vectors, model).where(F.col("score") >= middle - 1e-9), "matched_entity_ids")
    want = sorted(((r[0] or "", r[1]) for r in lists.collect()))
    assert sorted(((r[0] or "", r[1]) for r in linking.match_lists(s1, noisy, others, model, middle - 1e-9).collect())) == want and len({r[1] for r in want}) > 5
    parts = linking.kinds(noisy, "b", "noisy_id").select(F.size("b_members")).collect()
    assert max(r[0] for r in parts) == 3 and sum(r[0] for r in parts) == 59


@pytest.mark.parametrize("copies", [1, 2])
def test_rule_e_alone_meets_in_blocks_if_dense(spark, monkeypatch, copies):
    """Pairs as by the join on tokens, each once, without a join on tokens."""
    schema = "entity_id string, business_name string, business_address string, country string, src int"
    row = lambda side, k: (f"S{side}-{k}", f"n{k}", f"{k % 7} old{k % 3} road{k % 5}" if k % 9 else "", "US", side)
    s1, noisy = (records.normalize_records(spark.createDataFrame([row(side, k) for k in range(n)] * copies, schema), unicode=False) for side, n in ((1, 60), (2, 80)))
    want = sorted(tuple(r) for r in blocking.rule("e", s1, noisy).collect())
    monkeypatch.setattr(blocking, "DENSE", 0)
    got = blocking.rule("e", s1, noisy)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "s1_ids" in plan and "__token" not in plan
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == len(set(want)) > 1000
