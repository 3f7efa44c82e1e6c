"""The pipeline against plain versions of its stages."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lodestone.llm import packing, queries, toxicity
from tests.llm.test_groups import plain_near
from tests.llm.test_lines import SPACE, plain
from tests.llm.test_scans import words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    state = {r["doc_id"]: r for r in docs.collect()}
    names = docs.columns

    toxic = corpus_pipeline.drop_toxic(spark, docs, SF)
    labels = queries.table(spark, SF, "labels").where(toxicity.may_learn())
    model = toxicity.fit(docs.where(toxicity.may_learn()), labels)
    scores = {}
    for i, r in state.items():
        _, b = toxicity.present(pa.array([r["text"]]))
        scores[i] = float(model.weights[b].astype(np.float64).sum()) + model.bias
    kept = {r["doc_id"]: r for r in toxic.collect()}
    assert toxic.columns == names and set(kept) == {i for i, z in scores.items() if z < 0}

    lines = corpus_pipeline.dedup_lines(spark, toxic, SF)
    rows = [(i, r["text"]) for i, r in kept.items()]
    want = dict(zip((i for i, _ in rows), plain(rows), strict=True))
    want = {i: t for i, t in want.items() if t is None or t.strip(SPACE) or not kept[i]["text"].strip(SPACE)}
    rows = lines.collect()
    assert lines.columns == names and {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    near = corpus_pipeline.drop_near_duplicates(spark, lines, SF)
    _, comp = plain_near(sorted(want.items()))
    want = {i: t for i, t in want.items() if comp[i] == i}
    assert near.columns == names and {r["doc_id"]: r["text"] for r in near.collect()} == want

    clean = corpus_pipeline.drop_contaminated(spark, near, SF)
    windows = set()
    for (t,) in queries.table(spark, SF, "benchmark").select("text").collect():
        w = words(t)
        windows.update(tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)))
    ok = {i for i, t in want.items() for w in [words(t)] if not any(tuple(w[k : k + 10]) in windows for k in range(max(1, len(w) - 9)))}
    assert clean.columns == names and {r["doc_id"] for r in clean.collect()} == ok

    encode = packing.encoder(*queries.tokenizer())
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == ok
    assert sum(r["length"] for r in pieces) == sum(len(x) + 1 for x in encode([want[i] for i in sorted(ok)]))


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, a column whose name clashes; then empty tables."""
    line = "a sentence that stands in several documents and is long enough to count"
    other = " ".join(f"word{k}" for k in range(400))
    rows = [(1, line), (None, f"{line}\nonly here, in a document without an id"), (None, "nowhere else, also without an id"), (9, other), (9, "another text of the same id"), (9, "another text of the same id"), (12, other + " more"), (3, None), (4, ""), (5, "long " * 200_000 + "end"), (6, "  \n ")]
    for name, some in (("odd", rows), ("none", [])):
        sf = str(tmp_path / name)
        docs = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t), "x") for i, t in some], "doc_id long, text string, lang string, source string, n_chars int, SCORE string")
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        state = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            state = function(spark, state, sf)
            assert state.columns == docs.columns, stage
        left = sorted((str(r["doc_id"]), r["text"] or "") for r in state.collect())
        if not some:
            assert left == []
            continue
        assert ("None", "only here, in a document without an id") in left and ("None", "nowhere else, also without an id") in left
        assert ("9", other) in left and left.count(("9", "another text of the same id")) == 2 and ("12", other + " more") not in left
        assert ("1", line) in left and ("3", "") in left and ("4", "") in left and ("6", "  \n ") in left
        pieces = corpus_pipeline.run(spark, sf).collect()
        assert {str(r["doc_id"]) for r in pieces} == {i for i, _ in left}
