"""The catalog's queries run with the reference's values of its parameters (SURVEY, Appendix A)."""

import pytest

from lodestone.operators import blocking
from lodestone.plans import catalog
from lodestone.plans.fixtures import Entities

SF = "/root/testdata/sf0.01"


def run(spark, name):
    return catalog.QUERIES[name](spark, SF)


def test_rare_token_queries_give_the_anchors(spark):
    """FIXTURES 3 at a cap of 200; independent probes."""
    assert run(spark, "block_v1_bounded").count() == 18724
    assert run(spark, "bounded_blocker_recall").first()["hits"] == 908
    for name, macro in (("macro_f05", (0.683412, 0.679582, 0.874)), ("rule_matches_f05", (0.672799, 0.661137, 0.945333))):
        row = run(spark, name).first()
        assert (row["macro_f05"], row["mean_precision"], row["mean_recall"]) == macro


def test_grids_are_whole(spark):
    e = Entities.load(spark, SF)
    noisy, s1 = ({r[0]: set(r[1]) for r in df.select("entity_id", "at").collect()} for df in (e.noisy, e.s1))

    def plain(counted, most):
        df = {}
        for tokens in counted.values():
            for t in tokens:
                df[t] = df.get(t, 0) + 1
        holders = {}
        for i, tokens in noisy.items():
            for t in tokens:
                holders.setdefault(t, []).append(i)
        return {(a, b) for a, tokens in s1.items() for t in tokens if df.get(t, most + 1) <= most for b in holders.get(t, ())}

    for k in (50, 100, 200):
        assert {tuple(r) for r in run(spark, f"block_e_rare_{k}").select(*blocking.PAIR).collect()} == plain(s1, k)
    for k in (50, 200, 1000):
        assert {tuple(r) for r in run(spark, f"block_h_{k}").select(*blocking.PAIR).collect()} == plain(noisy, k)


@pytest.mark.parametrize("name", ["negatives_rule_e_all", "sample_entities_20000", "balanced_sample_500000", "capped_examples_2000", "neg_same_country", "pos_vs_neg"])
def test_wider_queries_on_more_rows(spark, name):
    from tests import oracle

    assert oracle.compare(spark, catalog.QUERIES, catalog.ORACLE_SQL, name, SF) > 0


def test_limits_of_the_reference(spark, monkeypatch):
    assert run(spark, "sample_entities_20000").count() == 750 and run(spark, "balanced_sample_500000").count() == 12079
    assert run(spark, "capped_examples_2000").count() == 1464
    pool = {r[0] for r in run(spark, "neg_same_country").select("noisy_id").distinct().collect()}
    assert len(pool) > 4 * 50
    seen = []
    monkeypatch.setattr(catalog.matcher, "fit_gbt", lambda train, iterations: seen.append(iterations))
    monkeypatch.setattr(catalog.matcher, "score_gbt", lambda pairs, model: pairs.withColumn("score", pairs["label"]))
    catalog.train_matcher(Entities.load(spark, SF))
    assert seen == [100]
