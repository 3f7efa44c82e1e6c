"""The queries of the entity-resolution operators and their SQL counterparts, by name.

Each query is registered with its Spark form and, where SQL can express it, the same result in DuckDB's SQL, written on
its own from the definitions (common table expressions ``PRELUDE``), not derived from the Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import similarity as sim
from lodestone.functions import text
from lodestone.operators import analysis, blocking, evaluate, features, linking, matcher, quality, records, sampling
from lodestone.plans.fixtures import Entities, entity_records, table
from lodestone.sources import shared, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Frequency caps: of the rare-token queries, and the grids of e_rare and h. On small tables the larger ones leave few tokens out.
RARE, RARE_GRID, H_GRID = blocking.MAX_DF, (5, 10, 20, 50, 100, 200), (50, 200, 1000)

_NORM = r"trim(regexp_replace(replace(lower({0}),'ß','ss'),'[^\p{{L}}\p{{N}}_]+',' ','g'))"
_TOKENS = "list_filter(string_split({0},' '), lambda t: t <> '')"

PRELUDE = (
    r"""WITH docs AS (SELECT doc_id, upper(lang) AS country, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
base AS (SELECT doc_id, country, array_to_string(w[1:3],' ') AS nm, array_to_string(w[1:2],' ') AS nm2, concat_ws(' ', w[2], w[1]) AS sw, array_to_string(w[4:8],' ') AS ad, CAST(doc_id % 997 AS VARCHAR) AS num FROM docs),
er AS (
SELECT 1 AS src, 'S1-'||doc_id AS entity_id, nm AS business_name, num||' '||ad AS business_address, country, doc_id FROM base WHERE doc_id % 4 <> 3
UNION ALL SELECT 2, 'S2-'||doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(replace(nm,'ß','ss')) WHEN doc_id % 5 = 0 THEN nm2 ELSE nm||' Ltd.' END, CASE WHEN doc_id % 11 = 0 THEN '' ELSE ad||', '||num END, country, doc_id FROM base WHERE doc_id % 4 IN (0,1,3)
UNION ALL SELECT 3, 'S3-'||doc_id, CASE WHEN doc_id % 2 = 0 THEN sw ELSE nm END, CASE WHEN doc_id % 13 = 0 THEN '' ELSE ad END, country, doc_id FROM base WHERE doc_id % 4 IN (0,3) OR (doc_id % 4 = 2 AND doc_id % 7 <> 0)),
nn0 AS (SELECT *, """
    + _NORM.format("business_name") + " AS nn, " + _NORM.format("business_address")
    + " AS na FROM er),\nm AS (SELECT *, list_distinct(" + _TOKENS.format("nn") + ") AS nt, list_distinct(" + _TOKENS.format("na") + ") AS at1, split_part(nn,' ',1) AS tok1, CASE WHEN len(" + _TOKENS.format("nn") + ") >= 2 THEN array_to_string((" + _TOKENS.format("nn") + """)[1:2],' ') END AS tok2 FROM nn0),
s1 AS (SELECT * FROM m WHERE src = 1), nz AS (SELECT * FROM m WHERE src > 1),
truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS noisy_id FROM s1 a JOIN nz b USING (doc_id)),
at_s1 AS (SELECT entity_id, country, unnest(at1) AS token FROM s1), at_nz AS (SELECT entity_id, country, unnest(at1) AS token FROM nz),
nt_s1 AS (SELECT entity_id, country, unnest(nt) AS token FROM s1), nt_nz AS (SELECT entity_id, country, unnest(nt) AS token FROM nz),
df_a AS (SELECT token, count(*) AS df FROM at_s1 GROUP BY token), df_n AS (SELECT token, count(*) AS df FROM nt_s1 GROUP BY token), df_z AS (SELECT token, count(*) AS df FROM at_nz GROUP BY token)"""
)


def _rule_sql(name: str, most: int = RARE) -> str:
    pick = "SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS noisy_id FROM "
    keys = {"a": "a.nn = b.nn AND a.nn <> ''", "b": "a.tok1 = b.tok1 AND a.tok1 <> ''", "c": "a.country = b.country AND a.tok1 = b.tok1 AND a.country <> '' AND a.tok1 <> ''", "d": "a.na = b.na AND a.na <> ''", "f": "a.tok2 = b.tok2", "g": "a.country = b.country AND a.tok2 = b.tok2 AND a.country <> ''"}
    if name in keys:
        return pick + f"s1 a JOIN nz b ON {keys[name]}"
    if name == "e":
        return pick + "at_s1 a JOIN at_nz b USING (token)"
    if name in ("h", "e_rare"):
        return pick + f"at_s1 a JOIN at_nz b USING (token) JOIN {'df_z' if name == 'h' else 'df_a'} d USING (token) WHERE d.df <= {most}"
    if name == "n_rare":
        return pick + f"nt_s1 a JOIN nt_nz b ON a.token = b.token AND a.country = b.country AND a.country <> '' JOIN df_n d ON d.token = a.token WHERE d.df <= {most}"
    if name in ("c_and_e", "g_and_e"):
        return f"(SELECT * FROM ({_rule_sql(name[0])})) INTERSECT (SELECT * FROM ({_rule_sql('e')}))"
    return f"(SELECT * FROM ({_rule_sql('c')})) INTERSECT (SELECT * FROM ({_rule_sql('e_rare', most)}))"


def _pairs_sql(name: str, most: int = RARE) -> str:
    if name in blocking.UNIONS:
        return " UNION ".join(f"(SELECT * FROM ({_rule_sql(r, most)}))" for r in blocking.UNIONS[name])
    return _rule_sql(name, most)


def _lev(a: str, b: str) -> str:
    fold = lambda x: f"translate({x},'éóèñçüêäöíà','ABCDEFGHIJK')"
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - levenshtein({fold(a)},{fold(b)})::DOUBLE / greatest(length({a}),length({b}))) END)"


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a},{b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"


def _jac_null(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 OR len({b}) > 0 THEN {_jac(a, b)} END)"


def _sorted(a: str) -> str:
    return f"array_to_string(list_sort({_TOKENS.format(a)}),' ')"


def _digits(a: str) -> str:
    return rf"list_filter({a}, lambda t: regexp_full_match(t, '\p{{Nd}}+'))"


_FEATURE_SQL = {
    "name_exact_raw": "CASE WHEN trim(a.business_name) <> '' AND trim(a.business_name) = trim(b.business_name) THEN 1.0 ELSE 0.0 END",
    "name_exact_norm": "CASE WHEN a.nn <> '' AND a.nn = b.nn THEN 1.0 ELSE 0.0 END",
    "name_levenshtein_sim": _lev("a.nn", "b.nn"),
    "name_jaccard_sim": _jac("a.nt", "b.nt"),
    "name_token_sort_sim": f"CASE WHEN a.nn = '' OR b.nn = '' THEN 0.0 ELSE {_lev(_sorted('a.nn'), _sorted('b.nn'))} END",
    "name_first_token_match": "CASE WHEN a.tok1 <> '' AND a.tok1 = b.tok1 THEN 1.0 ELSE 0.0 END",
    "name_length_diff_abs": "abs(length(a.nn) - length(b.nn))",
    "name_length_ratio": "CASE WHEN greatest(length(a.nn),length(b.nn)) > 0 THEN least(length(a.nn),length(b.nn))::DOUBLE / greatest(length(a.nn),length(b.nn)) ELSE 0.0 END",
    "address_exact_norm": "CASE WHEN a.na <> '' AND a.na = b.na THEN 1.0 ELSE 0.0 END",
    "address_levenshtein_sim": _lev("a.na", "b.na"),
    "address_jaccard_sim": _jac("a.at1", "b.at1"),
    "address_overlap_ratio": "CASE WHEN least(len(a.at1),len(b.at1)) > 0 THEN len(list_intersect(a.at1,b.at1))::DOUBLE / least(len(a.at1),len(b.at1)) ELSE 0.0 END",
    "address_is_missing": "CASE WHEN a.na = '' OR b.na = '' THEN 1.0 ELSE 0.0 END",
    "address_digit_jaccard": _jac(_digits("a.at1"), _digits("b.at1")),
    "country_match": "CASE WHEN a.country <> '' AND a.country = b.country THEN 1.0 ELSE 0.0 END",
}
_METRIC_SQL = {
    "name_exact_raw": "a.business_name = b.business_name AND a.business_name <> ''", "name_exact_norm": "a.nn = b.nn AND a.nn <> ''",
    "addr_exact_raw": "a.business_address = b.business_address AND a.business_address <> ''", "addr_exact_norm": "a.na = b.na AND a.na <> ''",
    "name_levenshtein_sim": f"CASE WHEN a.nn <> '' OR b.nn <> '' THEN {_lev('a.nn', 'b.nn')} END", "addr_levenshtein_sim": f"CASE WHEN a.na <> '' OR b.na <> '' THEN {_lev('a.na', 'b.na')} END",
    "name_jaccard": _jac_null("a.nt", "b.nt"), "addr_jaccard": _jac_null("a.at1", "b.at1"),
    "either_addr_empty": "trim(a.business_address) = '' OR trim(b.business_address) = ''", "both_addr_present": "trim(a.business_address) <> '' AND trim(b.business_address) <> ''",
    "country_equal": "CASE WHEN a.country <> '' AND b.country <> '' THEN a.country = b.country END",
}
_TRUE_PAIRS = " FROM truth t JOIN s1 a ON a.entity_id = t.s1_id JOIN nz b ON b.entity_id = t.noisy_id"
_SCORE_SQL = f"((CASE WHEN a.country <> '' AND a.country = b.country THEN 1.0::DOUBLE WHEN a.country <> '' AND b.country <> '' THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN a.tok1 <> '' AND a.tok1 = b.tok1 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END) + 3 * {_jac('a.nt', 'b.nt')} + 2 * {_jac('a.at1', 'b.at1')})"
_RULE_SCORE_SQL = f"(3 * {_jac('a.nt', 'b.nt')} + 2 * {_jac('a.at1', 'b.at1')})"
_V1_SQL = f"""bounded AS (SELECT s1_id, noisy_id, 10.0::DOUBLE AS score, true AS is_exact FROM ({_rule_sql('a')}) UNION ALL
SELECT s1_id, noisy_id, score, false FROM (SELECT x.s1_id, x.noisy_id, {_SCORE_SQL} AS score, row_number() OVER (PARTITION BY x.noisy_id ORDER BY {_SCORE_SQL} DESC, x.s1_id) AS rn
FROM (({_rule_sql('g')} UNION {_rule_sql('e_rare')}) EXCEPT ({_rule_sql('a')})) x JOIN s1 a ON a.entity_id = x.s1_id JOIN nz b ON b.entity_id = x.noisy_id) WHERE rn <= 15),
scored AS (SELECT c.s1_id, c.noisy_id, {_RULE_SCORE_SQL} AS score FROM bounded c JOIN s1 a ON a.entity_id = c.s1_id JOIN nz b ON b.entity_id = c.noisy_id)"""


def _prf_sql(predicted: str) -> str:
    return f"""tru AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1), pre AS (SELECT s1_id, count(*) AS n_predicted FROM ({predicted}) GROUP BY 1),
tps AS (SELECT p.s1_id, count(*) AS tp FROM ({predicted}) p JOIN truth t ON t.s1_id = p.s1_id AND t.noisy_id = p.noisy_id GROUP BY 1),
cnt AS (SELECT s.entity_id AS s1_id, coalesce(tp,0) AS tp, coalesce(n_predicted,0) AS n_predicted, coalesce(n_true,0) AS n_true FROM s1 s LEFT JOIN tru ON tru.s1_id = s.entity_id LEFT JOIN pre ON pre.s1_id = s.entity_id LEFT JOIN tps ON tps.s1_id = s.entity_id),
pr AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp::DOUBLE / n_predicted ELSE 0.0 END AS p0, CASE WHEN n_true > 0 THEN tp::DOUBLE / n_true ELSE 0.0 END AS r0 FROM cnt),
prf AS (SELECT s1_id, tp, n_predicted, n_true, CASE WHEN n_true = 0 THEN (CASE WHEN n_predicted = 0 THEN 1.0 ELSE 0.0 END) ELSE p0 END AS precision, CASE WHEN n_true = 0 THEN 1.0 ELSE r0 END AS recall, CASE WHEN n_true = 0 THEN (CASE WHEN n_predicted = 0 THEN 1.0 ELSE 0.0 END) WHEN 0.25 * p0 + r0 > 0 THEN 1.25 * p0 * r0 / (0.25 * p0 + r0) ELSE 0.0 END AS f05 FROM pr)"""


_MACRO_SQL = "SELECT round(avg(f05),6) AS macro_f05, round(avg(precision),6) AS mean_precision, round(avg(recall),6) AS mean_recall, round(coalesce(avg(CASE WHEN n_true = 0 THEN (CASE WHEN n_predicted = 0 THEN 1.0 ELSE 0.0 END) END),1.0),6) AS singleton_accuracy, count(*) AS n FROM prf"


def query(name: str, sql: str | None, prelude: bool = True):
    """Registers a query on (spark, sf_dir) under a name, with its SQL: a SELECT after the prelude."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (PRELUDE + (", " if not sql.lstrip().startswith("SELECT") and not sql.lstrip().startswith("(") else "\n") + sql) if prelude else sql
        return f

    return add


def er(name: str, sql: str | None):
    """As query(), for functions of Entities."""
    return lambda f: query(name, sql)(lambda spark, sf_dir: f(Entities.load(spark, sf_dir))) and f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as long, so that results compare exactly."""
    return df.select(*[(F.round(c, digits) if t in ("double", "float") else F.col(c).cast("long") if t in ("int", "bigint", "smallint") else F.col(c)).alias(c) for c, t in df.dtypes])


def true_pairs(e: Entities, columns: list[str] = features.RECORD) -> DataFrame:
    return records.pair_columns(e.truth, e.s1, e.noisy, columns)


# ---- blocking rules, intersections and unions

for _name in ("a", "b", "c", "d", "e", "f", "g", "h", "n_rare", "c_and_e", "g_and_e", "ce_rare", *blocking.UNIONS):
    er(f"block_{_name}", f"SELECT * FROM ({_pairs_sql(_name)})")(lambda e, n=_name: blocking.pairs_of(n, e.s1, e.noisy, RARE))
for _k in RARE_GRID:
    er(f"block_e_rare_{_k}", f"SELECT * FROM ({_rule_sql('e_rare', _k)})")(lambda e, k=_k: blocking.rule("e_rare", e.s1, e.noisy, k))
for _k in H_GRID:
    er(f"block_h_{_k}", f"SELECT * FROM ({_rule_sql('h', _k)})")(lambda e, k=_k: blocking.rule("h", e.s1, e.noisy, k))

_APPROX_SQL = f"""gr AS (SELECT src, entity_id, CASE WHEN nn = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, length('^'||nn||'$') - 1)), lambda i: substr('^'||nn||'$', i, 3))) END AS g FROM m),
g1 AS (SELECT entity_id, len(g) AS n, unnest(g) AS gram FROM gr WHERE src = 1), g2 AS (SELECT entity_id, len(g) AS n, unnest(g) AS gram FROM gr WHERE src > 1),
cm AS (SELECT a.entity_id AS s1_id, b.entity_id AS noisy_id, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM g1 a JOIN g2 b USING (gram) GROUP BY 1, 2),
approx AS (SELECT s1_id, noisy_id, jaccard, row_number() OVER (PARTITION BY noisy_id ORDER BY jaccard DESC, s1_id) AS rank FROM cm WHERE jaccard >= 0.15 QUALIFY rank <= 25)"""
er("block_approx_name", _APPROX_SQL + " SELECT s1_id, noisy_id, round(jaccard, 6) AS jaccard, rank FROM approx")(lambda e: rounded(blocking.approximate_names(e.s1, e.noisy)))
er("block_v1_hybrid", _APPROX_SQL + f" SELECT s1_id, noisy_id FROM approx UNION (SELECT * FROM ({_pairs_sql('ag_e_rare')}))")(lambda e: blocking.with_names("ag_e_rare", e.s1, e.noisy, RARE))


def _bounded(e: Entities) -> DataFrame:
    return blocking.bounded_candidates(e.s1, e.noisy, most=RARE)


def _scored(e: Entities) -> DataFrame:
    return records.pair_columns(_bounded(e).select(*blocking.PAIR), e.s1, e.noisy, ["nt", "at"]).select(*blocking.PAIR, matcher.rule_score().alias("score"))


er("block_v1_bounded", _V1_SQL + " SELECT s1_id, noisy_id, round(score, 6) AS score, is_exact FROM bounded")(lambda e: rounded(_bounded(e)))


@er("rule_bits", "SELECT s1_id, noisy_id, bit_or(bit)::BIGINT AS rules FROM (" + " UNION ALL ".join(f"SELECT *, {1 << k} AS bit FROM ({_rule_sql(r)})" for k, r in enumerate(("a", "c", "d", "g", "e_rare"))) + ") GROUP BY 1, 2")
def _(e):
    return rounded(blocking.rule_bits(["a", "c", "d", "g", "e_rare"], e.s1, e.noisy, RARE))


# ---- scalar functions

er("normalize_text", "SELECT entity_id, nn, na FROM m")(lambda e: e.records.select("entity_id", "nn", "na"))
er("name_tokens", "SELECT entity_id, tok1, tok2, array_to_string(list_sort(nt), ' ') AS tokens FROM m")(lambda e: e.records.select("entity_id", "tok1", "tok2", F.array_join(F.array_sort("nt"), " ").alias("tokens")))
er("address_tokens", "SELECT entity_id, array_to_string(list_sort(at1), ' ') AS tokens, len(at1)::BIGINT AS n FROM m")(lambda e: e.records.select("entity_id", F.array_join(F.array_sort("at"), " ").alias("tokens"), F.size("at").cast("long").alias("n")))
er("digit_tokens", f"SELECT entity_id, array_to_string(list_sort({_digits('at1')}), ' ') AS digits FROM m")(lambda e: e.records.select("entity_id", F.array_join(F.array_sort(text.digit_tokens(F.col("na"))), " ").alias("digits")))
er("char_3grams", "SELECT entity_id, CASE WHEN nn = '' THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(2, length('^'||nn||'$') - 1)), lambda i: substr('^'||nn||'$', i, 3)))), '|') END AS grams FROM m")(lambda e: e.records.select("entity_id", F.array_join(F.array_sort(text.character_grams(F.col("nn"))), "|").alias("grams")))
er("entity_keys", "SELECT entity_id, nullif(nn,'') AS key_a, nullif(tok1,'') AS key_b, CASE WHEN country <> '' AND tok1 <> '' THEN country||'|'||tok1 END AS key_c, nullif(na,'') AS key_d, tok2 AS key_f, CASE WHEN country <> '' AND tok2 IS NOT NULL THEN country||'|'||tok2 END AS key_g, na = '' AS address_missing FROM m")(
    lambda e: e.records.select("entity_id", F.nullif("nn", F.lit("")).alias("key_a"), F.nullif("tok1", F.lit("")).alias("key_b"), F.when((F.col("country") != "") & (F.col("tok1") != ""), F.concat_ws("|", "country", "tok1")).alias("key_c"), F.nullif("na", F.lit("")).alias("key_d"), F.col("tok2").alias("key_f"), F.when((F.col("country") != "") & F.col("tok2").isNotNull(), F.concat_ws("|", "country", "tok2")).alias("key_g"), (F.col("na") == "").alias("address_missing"))
)


def _of_pairs(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """A query of columns on the true pairs; sql: by column, doubles rounded."""
    select = "SELECT t.s1_id, t.noisy_id, " + ", ".join(f"{s} AS {n}" for n, s in sql.items()) + _TRUE_PAIRS
    er(name, select)(lambda e: rounded(true_pairs(e).select(*blocking.PAIR, *[c.alias(n) for n, c in columns().items()])))


def _r6(s: str) -> str:
    return f"round(({s})::DOUBLE, 6)"


def _some(*names: str) -> Callable[[], dict[str, Column]]:
    return lambda: {n: c for n, c in features.feature_columns().items() if n in names}


def _some_sql(*names: str) -> dict[str, str]:
    return {n: _r6(_FEATURE_SQL[n]) for n in names}


for _query, _names in {
    "levenshtein_sim": ("name_levenshtein_sim", "address_levenshtein_sim"), "jaccard_sim": ("name_jaccard_sim", "address_jaccard_sim"), "token_sort_sim": ("name_token_sort_sim",), "digit_jaccard": ("address_digit_jaccard",),
    "overlap_ratio": ("address_overlap_ratio",), "length_features": ("name_length_diff_abs", "name_length_ratio"), "exact_features": ("name_exact_raw", "name_exact_norm", "address_exact_norm"), "pair_features": tuple(features.FEATURES),
}.items():
    _of_pairs(_query, _some(*_names), _some_sql(*_names))
_of_pairs("token_jaccard_null", lambda: {n: c for n, c in features.metric_columns().items() if n in ("name_jaccard", "addr_jaccard")}, {n: _r6(_METRIC_SQL[n]) for n in ("name_jaccard", "addr_jaccard")})
_of_pairs("pair_metrics", features.metric_columns, {n: _r6(s) if "sim" in n or "jaccard" in n else s for n, s in _METRIC_SQL.items()})
_of_pairs("heuristic_score", lambda: {"score": blocking.heuristic_score()}, {"score": _r6(_SCORE_SQL)})


def _metrics(e: Entities) -> DataFrame:
    return features.with_metrics(true_pairs(e))


_METRICS_CTE = "pm AS (SELECT t.s1_id, t.noisy_id, a.country AS ca, b.country AS cb, a.nn AS an, b.nn AS bn, a.na AS aa, b.na AS ba, a.tok1 AS at1_, b.tok1 AS bt1_, b.src AS src, " + ", ".join(f"{s} AS {n}" for n, s in _METRIC_SQL.items()) + _TRUE_PAIRS + ")"
_BUCKET_SQL = """'name='||CASE WHEN name_exact_norm THEN 'exact' WHEN coalesce(name_levenshtein_sim,0) >= 0.85 THEN 'strong' WHEN coalesce(name_levenshtein_sim,0) >= 0.5 THEN 'weak' ELSE 'dissimilar' END||'/address='||CASE WHEN either_addr_empty THEN 'empty' WHEN addr_exact_norm THEN 'exact' WHEN coalesce(addr_levenshtein_sim,0) >= 0.8 THEN 'strong' WHEN coalesce(addr_levenshtein_sim,0) >= 0.4 THEN 'weak' ELSE 'dissimilar' END"""
er("evidence_buckets", _METRICS_CTE + f" SELECT {_BUCKET_SQL} AS bucket, count(*) AS pairs FROM pm GROUP BY 1")(lambda e: _metrics(e).groupBy(features.evidence_bucket().alias("bucket")).agg(F.count("*").alias("pairs")))
er("country_equal_rate", _METRICS_CTE + " SELECT count(country_equal) AS n, round(avg(country_equal::INT),6) AS rate FROM pm")(lambda e: rounded(_metrics(e).agg(F.count("country_equal").alias("n"), F.avg(F.col("country_equal").cast("int")).alias("rate"))))
_RATES = ("name_exact_raw", "name_exact_norm", "addr_exact_raw", "addr_exact_norm", "either_addr_empty", "both_addr_present")
er("pair_rates", _METRICS_CTE + " SELECT " + ", ".join(f"round(avg(({c})::INT),6) AS {c}" for c in _RATES) + " FROM pm")(lambda e: rounded(_metrics(e).agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in _RATES])))
er("region_breakdown", _METRICS_CTE + " SELECT c AS country, count(*) AS pairs, round(avg(name_levenshtein_sim),6) AS name_mean, round(avg(addr_levenshtein_sim),6) AS address_mean, round(avg(name_exact_norm::INT),6) AS exact_rate FROM (SELECT *, unnest(list_distinct(list_filter([ca, cb], lambda x: x <> ''))) AS c FROM pm) GROUP BY 1")(
    lambda e: rounded(_metrics(e).withColumn("country", F.explode(F.array_distinct(F.filter(F.array("a_country", "b_country"), lambda c: c != "")))).groupBy("country").agg(F.count("*").alias("pairs"), F.avg("name_levenshtein_sim").alias("name_mean"), F.avg("addr_levenshtein_sim").alias("address_mean"), F.avg(F.col("name_exact_norm").cast("int")).alias("exact_rate")))
)
_SUMMARY_SQL = "count({0}) AS count, min({0})::DOUBLE AS min, quantile_cont({0}, 0.5)::DOUBLE AS median, avg({0})::DOUBLE AS mean, quantile_cont({0}, 0.9)::DOUBLE AS p90, quantile_cont({0}, 0.95)::DOUBLE AS p95, quantile_cont({0}, 0.99)::DOUBLE AS p99, max({0})::DOUBLE AS max"


def _summary_sql(column: str) -> str:
    return ", ".join((f"round({part.rsplit(' AS ', 1)[0]}, 6) AS {part.rsplit(' AS ', 1)[1]}" if "count(" not in part else part) for part in [p.strip() for p in _SUMMARY_SQL.format(column).replace(", 0.", ",0.").split(", ")])


er("distribution_summary", _METRICS_CTE + f" SELECT 'name' AS field, {_summary_sql('name_levenshtein_sim')} FROM pm UNION ALL SELECT 'address', {_summary_sql('addr_levenshtein_sim')} FROM pm")(
    lambda e: rounded(_metrics(e).agg(*evaluate.summary(F.col("name_levenshtein_sim"))).select(F.lit("name").alias("field"), "*").unionByName(_metrics(e).agg(*evaluate.summary(F.col("addr_levenshtein_sim"))).select(F.lit("address").alias("field"), "*")))
)
er("tfidf_cosine", """ranked AS (SELECT t.s1_id, t.noisy_id, a.nn AS x, b.nn AS y FROM truth t JOIN s1 a ON a.entity_id = t.s1_id JOIN nz b ON b.entity_id = t.noisy_id),
wd AS (SELECT s1_id, noisy_id, 0 AS side, unnest(string_split(x,' ')) AS word FROM ranked UNION ALL SELECT s1_id, noisy_id, 1, unnest(string_split(y,' ')) FROM ranked),
tf AS (SELECT s1_id, noisy_id, side, word, count(*) AS tf FROM wd WHERE length(word) >= 2 GROUP BY ALL),
idf AS (SELECT word, ln((1 + (SELECT 2 * count(*) FROM ranked))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
v AS (SELECT s1_id, noisy_id, word, sum(CASE WHEN side = 0 THEN tf * idf ELSE 0 END) AS wa, sum(CASE WHEN side = 1 THEN tf * idf ELSE 0 END) AS wb FROM tf JOIN idf USING (word) GROUP BY ALL),
cs AS (SELECT s1_id, noisy_id, sum(wa * wb) / nullif(sqrt(sum(wa * wa)) * sqrt(sum(wb * wb)), 0) AS cosine FROM v GROUP BY 1, 2)
SELECT s1_id, noisy_id, round(coalesce(cosine, 0), 6) AS cosine FROM ranked LEFT JOIN cs USING (s1_id, noisy_id)""")(
    lambda e: rounded(features.tfidf_cosine(true_pairs(e, ["nn"]), "a_nn", "b_nn", blocking.PAIR))
)

# ---- frequencies and corpus statistics

er("doc_freq_addr", "SELECT token, df FROM df_a")(lambda e: blocking.document_frequency(e.s1, "at"))
er("doc_freq_name", "SELECT token, df FROM df_n")(lambda e: blocking.document_frequency(e.s1, "nt"))
_KEY_SQL = " UNION ALL ".join(f"SELECT src, '{r}' AS rule, {k} AS key FROM m" for r, k in {"a": "nullif(nn,'')", "b": "nullif(tok1,'')", "c": "CASE WHEN country <> '' AND tok1 <> '' THEN country||'|'||tok1 END", "d": "nullif(na,'')", "f": "tok2", "g": "CASE WHEN country <> '' AND tok2 IS NOT NULL THEN country||'|'||tok2 END"}.items())
_KEYS_CTE = f"ks AS ({_KEY_SQL}), kf AS (SELECT rule, key, count(*) AS n FROM ks WHERE src > 1 AND key IS NOT NULL AND (rule, key) IN (SELECT (rule, key) FROM ks WHERE src = 1 AND key IS NOT NULL) GROUP BY 1, 2)"
er("key_frequencies", _KEYS_CTE + " SELECT * FROM kf")(lambda e: analysis.key_frequencies(e.s1, e.noisy))
er("key_ambiguity", _KEYS_CTE + " SELECT k.rule, count(DISTINCT CASE WHEN kf.n > 1 THEN e.entity_id END) AS ambiguous, count(DISTINCT e.entity_id) AS entities FROM (SELECT 'a' AS rule, entity_id, nn AS key FROM s1 WHERE nn <> '' UNION ALL SELECT 'd', entity_id, na FROM s1 WHERE na <> '') e JOIN (SELECT unnest(['a','d']) AS rule) k ON k.rule = e.rule LEFT JOIN kf ON kf.rule = e.rule AND kf.key = e.key GROUP BY 1")(
    lambda e: e.s1.select("entity_id", F.explode(F.array(F.struct(F.lit("a").alias("rule"), F.col("nn").alias("key")), F.struct(F.lit("d").alias("rule"), F.col("na").alias("key")))).alias("x")).select("entity_id", "x.*").where("key <> ''").join(analysis.key_frequencies(e.s1, e.noisy), ["rule", "key"], "left").groupBy("rule").agg(F.count_if(F.col("n") > 1).alias("ambiguous"), F.count("*").alias("entities"))
)
er("corpus_frequencies", "SELECT src::BIGINT AS src, kind, key, count(*) AS n FROM (SELECT src, 'name' AS kind, nn AS key FROM m UNION ALL SELECT src, 'address', na FROM m UNION ALL SELECT src, 'first_token', tok1 FROM m UNION ALL SELECT src, 'country_token', CASE WHEN tok1 <> '' THEN country||'|'||tok1 ELSE '' END FROM m) WHERE key <> '' GROUP BY ALL")(lambda e: rounded(analysis.corpus_frequencies(e.records)))
er("posting_stats", "SELECT 'c' AS rule, count(DISTINCT country||'|'||tok1) AS keys, count(*) AS postings FROM s1 WHERE country <> '' AND tok1 <> '' UNION ALL SELECT 'e', count(DISTINCT token), count(*) FROM at_s1")(lambda e: analysis.posting_stats(e.s1))
er("token_rarity", "SELECT 'address' AS field, k::BIGINT AS \"limit\", count(*) FILTER (df <= k) AS surviving, count(*) AS tokens FROM df_a, (SELECT unnest([5,10,20,50,100,200]) AS k) GROUP BY k UNION ALL SELECT 'name', k, count(*) FILTER (df <= k), count(*) FROM df_n, (SELECT unnest([5,10,20,50,100,200]) AS k) GROUP BY k")(lambda e: rounded(analysis.token_rarity(e.s1)))
er("country_top_n", "SELECT src::BIGINT AS src, country, n FROM (SELECT src, country, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, country) AS r FROM er WHERE country <> '' GROUP BY 1, 2) WHERE r <= 25")(
    lambda e: rounded(e.records.where("country <> ''").groupBy("src", "country").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "country"))).where("r <= 25").drop("r"))
)
_PROFILE = ", ".join(f"count(*) FILTER ({c} = '') AS {n}_empty, count(*) FILTER (regexp_full_match({c}, '\\s+')) AS {n}_blank" for n, c in (("id", "entity_id"), ("name", "business_name"), ("address", "business_address"), ("country", "country")))
_PROFILE += "".join(f", min(length({c})) AS {n}_min, max(length({c})) AS {n}_max, round(avg(length({c})),6) AS {n}_mean, count(*) FILTER (regexp_matches({c}, '[^\\x00-\\x7F]')) AS {n}_non_ascii, count(*) FILTER (regexp_matches({c}, '^\\s|\\s$')) AS {n}_outer_space" for n, c in (("name", "business_name"), ("address", "business_address")))


@query("profile_source", f"SELECT src::BIGINT AS src, count(*) AS rows, {_PROFILE} FROM er GROUP BY src")
def _(spark, sf_dir):
    return rounded(quality.profile(entity_records(table(spark, sf_dir, "documents"))))


@query("profile_ids", "SELECT src::BIGINT AS src, count(*) AS unique_ids, count(*) FILTER (c > 1) AS repeated_ids, sum(c - 1)::BIGINT AS extra_rows, sum(CASE WHEN NOT starts_with(entity_id, 'S'||src||'-') THEN c ELSE 0 END)::BIGINT AS prefix_violations FROM (SELECT src, entity_id, count(*) AS c FROM er GROUP BY 1, 2) GROUP BY src")
def _(spark, sf_dir):
    return rounded(quality.id_profile(entity_records(table(spark, sf_dir, "documents")), F.concat(F.lit("S"), "src", F.lit("-"))))


_DUPLICATES = " UNION ALL ".join(f"SELECT src::BIGINT AS src, '{k}' AS kind, count(*) AS repeated_values, sum(c - 1)::BIGINT AS extra_rows FROM (SELECT src, count(*) AS c FROM er WHERE {w} GROUP BY src, {g} HAVING count(*) > 1) GROUP BY src" for k, w, g in (("name", "business_name <> ''", "business_name"), ("address", "business_address <> ''", "business_address"), ("name_address", "business_name <> '' AND business_address <> ''", "business_name, business_address")))


@query("profile_duplicates", f"SELECT * FROM ({_DUPLICATES})")
def _(spark, sf_dir):
    return rounded(quality.duplicates(entity_records(table(spark, sf_dir, "documents"))))


@query("train_test_countries", "SELECT country, bool_or(src = 1) AS in_train, bool_or(src > 1) AS in_test FROM er GROUP BY country HAVING bool_or(src = 1) <> bool_or(src > 1) OR true")
def _(spark, sf_dir):
    return entity_records(table(spark, sf_dir, "documents")).groupBy("country").agg(F.bool_or(F.col("src") == 1).alias("in_train"), F.bool_or(F.col("src") > 1).alias("in_test"))


# ---- ground truth

er("gt_structure", "SELECT count(*) AS entities, count(*) FILTER (n IS NULL) AS singletons, coalesce(sum(n),0)::BIGINT AS pairs, count(*) FILTER (i2 AND NOT i3) AS s2_only, count(*) FILTER (i3 AND NOT i2) AS s3_only, count(*) FILTER (i2 AND i3) AS both FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n, bool_or(starts_with(noisy_id,'S2-')) AS i2, bool_or(starts_with(noisy_id,'S3-')) AS i3 FROM truth GROUP BY 1) t ON t.s1_id = s1.entity_id")(lambda e: rounded(analysis.truth_structure(e.ids, e.truth)))
er("gt_prefix_classes", "SELECT CASE WHEN starts_with(noisy_id,'S2-') THEN 'S2' WHEN starts_with(noisy_id,'S3-') THEN 'S3' ELSE 'other' END AS kind, count(*) AS n FROM truth GROUP BY 1")(lambda e: e.truth.groupBy(analysis.id_class("noisy_id").alias("kind")).agg(F.count("*").alias("n")))
er("gt_referential_integrity", "SELECT (SELECT count(*) FROM (SELECT DISTINCT s1_id FROM truth) WHERE s1_id NOT IN (SELECT entity_id FROM s1)) AS unknown_s1, (SELECT count(*) FROM (SELECT DISTINCT noisy_id FROM truth) WHERE noisy_id NOT IN (SELECT entity_id FROM nz)) AS unknown_matches, (SELECT count(*) FROM (SELECT DISTINCT noisy_id FROM truth) WHERE noisy_id IN (SELECT entity_id FROM s1)) AS self_matches")(lambda e: analysis.referential_integrity(e.truth, e.s1, e.noisy))
er("match_count_histogram", "SELECT coalesce(n,0) AS matches, count(*) AS entities FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1) t ON t.s1_id = s1.entity_id GROUP BY 1")(lambda e: rounded(analysis.match_count_histogram(e.ids, e.truth)))
er("referenced_records", "SELECT entity_id, business_name, country FROM nz WHERE entity_id IN (SELECT noisy_id FROM truth)")(lambda e: e.noisy.join(e.truth.select(F.col("noisy_id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "business_name", "country"))
er("resolve_pairs", "SELECT t.s1_id, t.noisy_id, a.business_name AS name_1, b.business_name AS name_2" + _TRUE_PAIRS)(lambda e: true_pairs(e, ["business_name"]).select(*blocking.PAIR, F.col("a_business_name").alias("name_1"), F.col("b_business_name").alias("name_2")))
er("labelled_pairs", f"SELECT p.s1_id, p.noisy_id, (t.s1_id IS NOT NULL)::INT::BIGINT AS label FROM ({_pairs_sql('a_union_g')}) p LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.noisy_id = p.noisy_id")(lambda e: rounded(labelled(blocking.pairs_of("a_union_g", e.s1, e.noisy), e.truth)))


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.withColumn("__t", F.lit(1)), blocking.PAIR, "left").withColumn("label", F.coalesce("__t", F.lit(0))).drop("__t")


er("singleton_diagnostics", "SELECT count(*) AS singletons, count(*) FILTER (nn <> '' AND nn IN (SELECT nn FROM nz)) AS name_elsewhere, count(*) FILTER (na <> '' AND na IN (SELECT na FROM nz)) AS address_elsewhere FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM truth)")(lambda e: analysis.singleton_diagnostics(e.s1, e.noisy, e.truth))
er("positive_ambiguity", "fn AS (SELECT src, nn, count(*) AS c FROM nz WHERE nn <> '' GROUP BY 1, 2), fa AS (SELECT src, na, count(*) AS c FROM nz WHERE na <> '' GROUP BY 1, 2), pt AS (SELECT b.src, b.nn, b.na FROM truth t JOIN nz b ON b.entity_id = t.noisy_id) SELECT (SELECT count(*) FROM pt) AS pairs, (SELECT count(*) FROM pt JOIN fn USING (src, nn) WHERE c > 1) AS ambiguous_names, (SELECT count(*) FROM pt JOIN fa USING (src, na) WHERE c > 1) AS ambiguous_addresses, (SELECT count(*) FROM (SELECT 1 FROM pt GROUP BY src, nn, na HAVING count(*) > 1)) AS ambiguous_both")(lambda e: analysis.positive_ambiguity(e.truth, e.noisy))
_LIST_SQL = "SELECT s.entity_id AS source1_entity_id, coalesce(l, '') AS {0} FROM s1 s LEFT JOIN (SELECT s1_id, string_agg(noisy_id, ',' ORDER BY noisy_id) AS l FROM ({1}) GROUP BY 1) x ON x.s1_id = s.entity_id"
er("match_lists", _LIST_SQL.format("matched_entity_ids", "SELECT * FROM truth"))(lambda e: tables.grouped_lists(e.ids, e.truth, "matched_entity_ids"))
er("candidate_lists", _LIST_SQL.format("candidate_entity_ids", _pairs_sql("a_union_g")))(lambda e: tables.grouped_lists(e.ids, blocking.pairs_of("a_union_g", e.s1, e.noisy), "candidate_entity_ids"))

# ---- evaluation of blocking

_REPORTED = ("a", "c", "d", "f", "g", "a_union_g", "ag_e_rare")


@er("blocking_recall", "nt_all AS (SELECT count(*) AS n FROM truth), ns AS (SELECT count(*) AS n FROM s1), nc AS (SELECT count(*) AS n FROM nz) " + " UNION ALL ".join(f"SELECT '{r}' AS rule, (SELECT count(*) FROM ({_pairs_sql(r)})) AS pairs, (SELECT count(*) FROM truth t JOIN ({_pairs_sql(r)}) p USING (s1_id, noisy_id)) AS hits, round((SELECT count(*) FROM truth t JOIN ({_pairs_sql(r)}) p USING (s1_id, noisy_id))::DOUBLE / (SELECT n FROM nt_all), 6) AS recall, round(1 - (SELECT count(*) FROM ({_pairs_sql(r)}))::DOUBLE / (SELECT n FROM ns) / (SELECT n FROM nc), 6) AS reduction_ratio" for r in _REPORTED))
def _(e):
    totals = e.truth.agg(F.count("*").alias("t")).crossJoin(e.s1.agg(F.count("*").alias("s"))).crossJoin(e.noisy.agg(F.count("*").alias("c")))  # one row each
    out = blocking.pair_counts(list(_REPORTED), e.s1, e.noisy, e.truth, RARE)
    return rounded(out.crossJoin(F.broadcast(totals)).select("rule", "pairs", "hits", (F.col("hits") / F.col("t")).alias("recall"), (1 - F.col("pairs") / F.col("s") / F.col("c")).alias("reduction_ratio")))


_HIT_SQL = "hit AS (SELECT t.s1_id, t.noisy_id, (p.s1_id IS NOT NULL)::INT AS h FROM truth t LEFT JOIN ({0}) p ON p.s1_id = t.s1_id AND p.noisy_id = t.noisy_id)"
er("entity_recall", _HIT_SQL.format(_pairs_sql("a_union_g")) + " SELECT count(*) AS entities, sum(h)::BIGINT AS all_retrieved, round(avg(h),6) AS rate FROM (SELECT s1_id, min(h) AS h FROM hit GROUP BY 1)")(lambda e: rounded(evaluate.entity_recall(e.ids, e.truth, blocking.pairs_of("a_union_g", e.s1, e.noisy))))
er("entity_full_retrieval", _HIT_SQL.format(_pairs_sql("a_union_g")) + " SELECT count(*) AS entities, sum(coalesce(h,1))::BIGINT AS all_retrieved, round(avg(coalesce(h,1)),6) AS rate FROM s1 LEFT JOIN (SELECT s1_id, min(h) AS h FROM hit GROUP BY 1) x ON x.s1_id = s1.entity_id")(lambda e: rounded(evaluate.entity_recall(e.ids, e.truth, blocking.pairs_of("a_union_g", e.s1, e.noisy), True)))
_COUNT_SQL = "SELECT s.entity_id AS s1_id, coalesce(n,0) AS n FROM s1 s LEFT JOIN (SELECT s1_id, count(*) AS n FROM ({0}) GROUP BY 1) x ON x.s1_id = s.entity_id"
er("candidate_counts", _COUNT_SQL.format(_pairs_sql("c")))(lambda e: evaluate.candidate_counts(e.ids, blocking.rule("c", e.s1, e.noisy)))
er("hit_sizes", f"SELECT b.entity_id AS noisy_id, coalesce(n,0) AS n FROM nz b LEFT JOIN (SELECT noisy_id, count(*) AS n FROM ({_pairs_sql('c')}) GROUP BY 1) x ON x.noisy_id = b.entity_id")(lambda e: evaluate.candidate_counts(e.noisy.select(F.col("entity_id").alias("noisy_id")), blocking.rule("c", e.s1, e.noisy), "noisy_id"))
er("hist_percentile", f"cc AS ({_COUNT_SQL.format(_pairs_sql('c'))}), hg AS (SELECT n AS v, sum(count(*)) OVER (ORDER BY n) AS upto, sum(count(*)) OVER () AS total FROM cc GROUP BY n) SELECT " + ", ".join(f"min(CASE WHEN upto - 1 >= (total - 1) * {p / 100}::DOUBLE THEN v END)::BIGINT AS p{p}" for p in (50, 95, 99)) + " FROM hg")(lambda e: rounded(evaluate.histogram_percentiles(evaluate.candidate_counts(e.ids, blocking.rule("c", e.s1, e.noisy)), "n")))
er("singleton_candidates", f"cc AS ({_COUNT_SQL.format(_pairs_sql('c'))}), sg AS (SELECT * FROM cc WHERE s1_id NOT IN (SELECT s1_id FROM truth)) SELECT count(*) FILTER (n = 0) AS without, count(*) FILTER (n > 0) AS \"with\", {_summary_sql('n')} FROM sg")(
    lambda e: rounded(evaluate.candidate_counts(e.ids.join(e.truth, "s1_id", "left_anti"), blocking.rule("c", e.s1, e.noisy)).agg(F.count_if(F.col("n") == 0).alias("without"), F.count_if(F.col("n") > 0).alias("with"), *evaluate.summary(F.col("n"))))
)
er("bounded_blocker_recall", _V1_SQL + " SELECT count(*) AS pairs, count(b.s1_id) AS hits, round(count(b.s1_id)::DOUBLE / count(*), 6) AS recall FROM truth t LEFT JOIN bounded b ON b.s1_id = t.s1_id AND b.noisy_id = t.noisy_id")(lambda e: rounded(evaluate.hits(e.truth, _bounded(e)).agg(F.count("*").alias("pairs"), F.sum("hit").alias("hits"), F.avg("hit").alias("recall"))))
er("pair_rule_recall", _METRICS_CTE + ", fq AS (SELECT src, nn, count(*) AS c FROM nz WHERE nn <> '' GROUP BY 1, 2) SELECT count(*) AS pairs, round(avg((an = bn)::INT),6) AS name_recall, (SELECT round(avg((at1_ = bt1_)::INT),6) FROM pm WHERE at1_ <> '') AS first_token_recall, (SELECT round(avg((ca = cb AND at1_ = bt1_)::INT),6) FROM pm) AS country_token_recall, (SELECT round(avg((addr_jaccard > 0)::INT),6) FROM pm WHERE addr_jaccard IS NOT NULL) AS address_token_recall, round(avg(coalesce(c,0)),6) AS mean_name_frequency FROM pm LEFT JOIN fq ON fq.src = pm.src AND fq.nn = pm.an WHERE an <> ''")(lambda e: rounded(_pair_rule_recall(e)))


def _pair_rule_recall(e: Entities) -> DataFrame:
    pairs = _metrics(e).join(e.noisy.select(F.col("entity_id").alias("noisy_id"), "src"), "noisy_id")
    freq = e.noisy.where("nn <> ''").groupBy("src", F.col("nn").alias("a_nn")).agg(F.count("*").alias("c"))
    rate = lambda applies, hit: F.avg(F.when(applies, hit.cast("int")))
    named = F.col("a_nn") != ""
    return pairs.join(freq, ["src", "a_nn"], "left").agg(
        F.count_if(named).alias("pairs"), rate(named, F.col("a_nn") == F.col("b_nn")).alias("name_recall"), rate(F.col("a_tok1") != "", F.col("a_tok1") == F.col("b_tok1")).alias("first_token_recall"),
        rate(F.lit(True), (F.col("a_country") == F.col("b_country")) & (F.col("a_tok1") == F.col("b_tok1"))).alias("country_token_recall"), rate(F.col("addr_jaccard").isNotNull(), F.col("addr_jaccard") > 0).alias("address_token_recall"),
        F.avg(F.when(named, F.coalesce("c", F.lit(0)))).alias("mean_name_frequency"),
    )


# ---- sampling

_BUCKET = "('0x'||substr(md5({0}||'|{1}'),1,8))::BIGINT"
er("sample_entities", f"SELECT entity_id, {_BUCKET.format('entity_id', 1337)} AS bucket FROM s1 ORDER BY 2, 1 LIMIT 100")(lambda e: sampling.sample_n(e.s1, "entity_id", 100).select("entity_id", sampling.bucket(F.col("entity_id")).alias("bucket")))
er("train_val_split", f"SELECT entity_id AS s1_id, {_BUCKET.format('entity_id', 1337)} >= {int(0.8 * (1 << 32))} AS is_validation FROM s1")(lambda e: sampling.split(e.ids, "s1_id"))
er("volume_estimate", f"smp AS (SELECT * FROM nz WHERE {_BUCKET.format('entity_id', 1338)} < {int(0.2 * (1 << 32))}) SELECT (SELECT count(*) FROM smp) AS sampled, (SELECT count(*) FROM nz) AS total, count(*) AS hits, round(count(*)::DOUBLE * (SELECT count(*) FROM nz) / (SELECT count(*) FROM smp), 6) AS estimated FROM ({_pairs_sql('c')}) p WHERE p.noisy_id IN (SELECT entity_id FROM smp)")(lambda e: rounded(_volume(e)))

er("sample_entities_20000", f"SELECT entity_id, {_BUCKET.format('entity_id', 1337)} AS bucket FROM s1 ORDER BY 2, 1 LIMIT 20000")(lambda e: sampling.sample_n(e.s1, "entity_id", 20_000).select("entity_id", sampling.bucket(F.col("entity_id")).alias("bucket")))


def _volume(e: Entities) -> DataFrame:
    some = sampling.bernoulli(e.noisy, "entity_id", 0.2, 1338)
    counts = some.agg(F.count("*").alias("sampled")).crossJoin(e.noisy.agg(F.count("*").alias("total"))).crossJoin(blocking.rule("c", e.s1, some).agg(F.count("*").alias("hits")))  # one row each
    return counts.withColumn("estimated", F.col("hits") * F.col("total") / F.col("sampled"))


_LABEL_SQL = f"lb AS (SELECT p.s1_id, p.noisy_id, b.src, (t.s1_id IS NOT NULL)::INT AS label FROM ({_pairs_sql('c')}) p JOIN nz b ON b.entity_id = p.noisy_id LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.noisy_id = p.noisy_id)"


def _labelled_c(e: Entities) -> DataFrame:
    return blocking.labelled_hits("c", e.s1, e.noisy, e.truth)


er("hard_negatives", _LABEL_SQL + " SELECT s1_id, noisy_id, label::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, label ORDER BY src, noisy_id) AS r FROM lb) WHERE label = 1 OR r <= 15")(lambda e: rounded(sampling.hard_negatives(_labelled_c(e)).select(*blocking.PAIR, "label")))
er("balanced_sample", _LABEL_SQL + f", ct AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM lb), tk AS (SELECT least(p, greatest(250, 500 - q)) AS ones, least(q, 500 - least(p, greatest(250, 500 - q))) AS zeros FROM ct), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_BUCKET.format('pair', 1337)}, pair) AS r FROM (SELECT *, s1_id||'|'||noisy_id AS pair FROM lb)) SELECT s1_id, noisy_id, label::BIGINT AS label FROM rk, tk WHERE r <= CASE WHEN label = 1 THEN ones ELSE zeros END")(lambda e: rounded(sampling.balanced(_labelled_c(e).withColumn("pair", F.concat_ws("|", *blocking.PAIR)), "pair", 500).select(*blocking.PAIR, "label")))
er("capped_examples", "SELECT country, entity_id, r AS rank FROM (SELECT country, entity_id, row_number() OVER (PARTITION BY country ORDER BY entity_id) AS r FROM nz) WHERE r <= 5")(lambda e: rounded(sampling.capped(e.noisy, ["country"], 5).select("country", "entity_id", "rank")))
# at the reference's limits; the SQL of the smaller ones above has theirs written out
er("balanced_sample_500000", _LABEL_SQL + f", ct AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM lb), tk AS (SELECT least(p, greatest(250000, 500000 - q)) AS ones, least(q, 500000 - least(p, greatest(250000, 500000 - q))) AS zeros FROM ct), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_BUCKET.format('pair', 1337)}, pair) AS r FROM (SELECT *, s1_id||'|'||noisy_id AS pair FROM lb)) SELECT s1_id, noisy_id, label::BIGINT AS label FROM rk, tk WHERE r <= CASE WHEN label = 1 THEN ones ELSE zeros END")(lambda e: rounded(sampling.balanced(_labelled_c(e).withColumn("pair", F.concat_ws("|", *blocking.PAIR)), "pair").select(*blocking.PAIR, "label")))
er("capped_examples_2000", "SELECT country, entity_id, r AS rank FROM (SELECT country, entity_id, row_number() OVER (PARTITION BY country ORDER BY entity_id) AS r FROM nz) WHERE r <= 2000")(lambda e: rounded(sampling.capped(e.noisy, ["country"], 2000).select("country", "entity_id", "rank")))
_NEGATIVES = {"same_name": ("nn", 5), "same_address": ("na", 5), "same_country": ("country", 2000)}


def _negatives_sql(column: str, cap: int) -> str:
    pool = f"SELECT entity_id, {column} AS k FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY entity_id) AS r FROM nz WHERE {column} <> '') WHERE r <= {cap}"
    options = f"SELECT DISTINCT a.entity_id AS s1_id, p.entity_id AS noisy_id FROM s1 a JOIN ({pool}) p ON p.k = a.{column} WHERE a.entity_id IN (SELECT s1_id FROM truth) AND (a.entity_id, p.entity_id) NOT IN (SELECT (s1_id, noisy_id) FROM truth)"
    bucket = _BUCKET.format("(s1_id||'|'||noisy_id)", 1337)
    return f"SELECT s1_id, noisy_id FROM ({options}) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY {bucket}, noisy_id) = 1"


for _label, (_column, _cap) in _NEGATIVES.items():
    er(f"neg_{_label.replace('address', 'addr')}", f"SELECT * FROM ({_negatives_sql(_column, _cap)})")(lambda e, c=_column, k=_cap: sampling.controlled_negatives(e.truth, e.s1, e.noisy, c, k))
er("negatives_rule_e", f"SELECT s1_id, noisy_id FROM (({_rule_sql('e_rare')}) EXCEPT (SELECT * FROM truth)) ORDER BY 1, 2 LIMIT 5000")(lambda e: blocking.rule("e_rare", e.s1, e.noisy, RARE).join(e.truth, blocking.PAIR, "left_anti").orderBy(*blocking.PAIR).limit(5000))
er("negatives_rule_e_all", f"SELECT s1_id, noisy_id FROM (({_rule_sql('e')}) EXCEPT (SELECT * FROM truth)) ORDER BY 1, 2 LIMIT 5000")(lambda e: blocking.first_pairs("e", e.s1, e.noisy, 5000, e.truth))


_KINDS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({q})" for k, q in {"positive": "SELECT * FROM truth", **{k: _negatives_sql(*v) for k, v in _NEGATIVES.items()}}.items())


@er("pos_vs_neg", f"kd AS ({_KINDS_SQL}), mk AS (SELECT kind, {_METRIC_SQL['name_levenshtein_sim']} AS v FROM kd t JOIN s1 a ON a.entity_id = t.s1_id JOIN nz b ON b.entity_id = t.noisy_id) SELECT kind, {_summary_sql('v')} FROM mk GROUP BY kind")
def _(e):
    kinds = {"positive": e.truth, **{k: sampling.controlled_negatives(e.truth, e.s1, e.noisy, c, n) for k, (c, n) in _NEGATIVES.items()}}
    out = None
    for kind, pairs in kinds.items():
        one = pairs.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(features.with_metrics(records.pair_columns(out, e.s1, e.noisy, features.RECORD)).groupBy("kind").agg(*evaluate.summary(F.col("name_levenshtein_sim"))))


# ---- matching and its evaluation

_PREDICTED = "SELECT s1_id, noisy_id FROM scored WHERE score >= 3.5"
_predicted = lambda e: _scored(e).where("score >= 3.5")
er("threshold_matches", _V1_SQL + " " + _PREDICTED)(lambda e: _predicted(e).select(*blocking.PAIR))
er("entity_prf", _V1_SQL + ", " + _prf_sql(_PREDICTED) + " SELECT s1_id, tp, n_predicted, n_true, round(precision,6) AS precision, round(recall,6) AS recall, round(f05,6) AS f05 FROM prf")(lambda e: rounded(evaluate.entity_prf(e.ids, _predicted(e), e.truth)))
er("macro_f05", _V1_SQL + ", " + _prf_sql(_PREDICTED) + " " + _MACRO_SQL)(lambda e: rounded(evaluate.macro(evaluate.entity_prf(e.ids, _predicted(e), e.truth))))
er("rule_matches_f05", _V1_SQL + ", " + _prf_sql("SELECT s1_id, noisy_id FROM scored WHERE score >= 2.0") + " " + _MACRO_SQL)(lambda e: rounded(evaluate.macro(evaluate.entity_prf(e.ids, _scored(e).where("score >= 2.0"), e.truth))))
_GRID = "[" + ",".join(str(t) for t in evaluate.GRID) + "]::DOUBLE[]"
er("threshold_sweep", _V1_SQL + f""", gd AS (SELECT unnest({_GRID}) AS threshold), sc AS (SELECT s.s1_id, s.noisy_id, round(s.score / 5, 9) AS score, t.s1_id IS NOT NULL AS hit FROM scored s LEFT JOIN truth t ON t.s1_id = s.s1_id AND t.noisy_id = s.noisy_id),
ag AS (SELECT threshold, s1_id, count(*) AS np, count(*) FILTER (hit) AS tp FROM sc JOIN gd ON sc.score >= gd.threshold GROUP BY 1, 2), nt_ AS (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1),
al AS (SELECT gd.threshold, s.entity_id, coalesce(n,0) AS nt, coalesce(np,0) AS np, coalesce(tp,0) AS tp FROM s1 s CROSS JOIN gd LEFT JOIN nt_ ON nt_.s1_id = s.entity_id LEFT JOIN ag ON ag.threshold = gd.threshold AND ag.s1_id = s.entity_id),
pr AS (SELECT *, CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0.0 END AS p0, CASE WHEN nt > 0 THEN tp::DOUBLE / nt ELSE 0.0 END AS r0 FROM al),
fs AS (SELECT threshold, avg(CASE WHEN nt = 0 THEN (CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END) WHEN 0.25 * p0 + r0 > 0 THEN 1.25 * p0 * r0 / (0.25 * p0 + r0) ELSE 0.0 END) AS f, avg(CASE WHEN nt = 0 THEN (CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END) ELSE p0 END) AS p, avg(CASE WHEN nt = 0 THEN 1.0 ELSE r0 END) AS r FROM pr GROUP BY 1)
SELECT threshold, round(f,6) AS macro_f05, round(p,6) AS mean_precision, round(r,6) AS mean_recall, row_number() OVER (ORDER BY round(f,12) DESC, threshold) = 1 AS is_best FROM fs""")(
    lambda e: rounded(evaluate.threshold_sweep(e.ids, _scored(e).withColumn("score", F.round(F.col("score") / 5, 9)), e.truth))
)


def _candidates(e: Entities) -> tuple[DataFrame, bool]:
    """The bounded candidates that are no exact name hits, or all if ids are repeated, written once for all that read them; and whether these are all."""
    if blocking.repeated_ids(e.s1, e.noisy):
        return shared.written(_bounded(e).select(*blocking.PAIR), "candidates"), True
    return shared.written(blocking.bounded_others(e.s1, e.noisy, most=RARE, more=["src"]).drop("score"), "candidates"), False


def _split_pairs(e: Entities, pairs: DataFrame) -> DataFrame:
    return sampling.split(labelled(pairs, e.truth).join(e.noisy.select(F.col("entity_id").alias("noisy_id"), "src"), "noisy_id"), "s1_id")


def _split_s1(e: Entities) -> DataFrame:
    return sampling.split(linking.with_truth(e.s1, e.truth), "entity_id")


def train_matcher(e: Entities, iterations: int = 100, candidates: tuple[DataFrame, bool] | None = None):
    """The model: bounded candidates, hard negatives, a split by S1 id.

    The training pairs and their features are written once, for the passes of the sample and the fit.
    """
    pairs, whole = candidates or _candidates(e)
    hard = sampling.hard_negatives(_split_pairs(e, pairs).where("not is_validation")) if whole else linking.training_pairs(_split_s1(e).where("not is_validation"), e.noisy, pairs)
    train = sampling.balanced(shared.written(hard, "hard").withColumn("pair", F.concat_ws("|", *blocking.PAIR)), "pair")
    rows = features.with_features(records.pair_columns(train.select(*blocking.PAIR, "label"), e.s1, e.noisy, features.RECORD))
    return matcher.fit_gbt(shared.written(rows.select("label", *features.FEATURES), "train"), iterations)


@er("gbt_scores", None)
def _(e):
    """The scored validation pairs."""
    pairs, whole = _candidates(e)
    model = train_matcher(e, candidates=(pairs, whole))
    if not whole:
        return rounded(linking.labelled_scores(_split_s1(e).where("is_validation"), e.noisy, pairs, model))
    validation = features.with_features(records.pair_columns(_split_pairs(e, pairs).where("is_validation").select(*blocking.PAIR, "label"), e.s1, e.noisy, features.RECORD))
    return rounded(matcher.score_gbt(validation, model).select(*blocking.PAIR, "label", "score"))


@er("predict_matches", None)
def _(e):
    pairs, whole = _candidates(e)
    model = train_matcher(e, candidates=(pairs, whole))
    if not whole:
        return linking.match_lists(e.s1, e.noisy, pairs, model)
    candidates = features.with_features(records.pair_columns(pairs, e.s1, e.noisy, features.RECORD))
    return tables.grouped_lists(e.ids, matcher.score_gbt(candidates, model).where("score >= 0.5"), "matched_entity_ids")


# ---- sources and validation, through files in the shared folder


def _submission(spark: SparkSession, sf_dir: str, damaged: bool) -> str:
    """A match file of the truth; damaged: with repeated rows and ids, foreign ids and lines without a tab, by doc_id."""
    e = Entities.load(spark, sf_dir)
    lists = tables.grouped_lists(e.ids, e.truth, "matched_entity_ids").withColumnRenamed("source1_entity_id", "s1")
    if not damaged:
        lines = lists.select(F.concat("s1", F.lit("\t"), "matched_entity_ids").alias("value"))
    else:
        k = F.substring("s1", 4, 20).cast("long")
        body = F.when(k % 10 == 1, F.concat("matched_entity_ids", F.lit(",S1-9"))).when(k % 10 == 2, F.concat("matched_entity_ids", F.lit(",X-1"))).when(k % 10 == 4, F.concat("matched_entity_ids", F.lit(",S2-x"))).when(k % 10 == 5, F.concat_ws(",", "matched_entity_ids", "matched_entity_ids")).otherwise(F.col("matched_entity_ids"))
        row = F.concat("s1", F.lit("\t"), body)
        shape = F.when(k % 10 == 6, F.array(row, row)).when(k % 10 == 8, F.array(F.concat(F.lit("no tab "), "s1"))).when(k % 10 == 9, F.array(row, F.concat(F.lit("S1-extra"), "s1", F.lit("\t")))).otherwise(F.array(row))
        lines = lists.select(F.explode(shape).alias("value"))
    to = tables.scratch(spark, "submission")
    lines.write.text(to)
    return to


_FILE_SQL = """ls AS (SELECT s.entity_id AS s1, CAST(substr(s.entity_id, 4) AS BIGINT) AS k, coalesce(l, '') AS l FROM s1 s LEFT JOIN (SELECT s1_id, string_agg(noisy_id, ',' ORDER BY noisy_id) AS l FROM truth GROUP BY 1) x ON x.s1_id = s.entity_id),
bd AS (SELECT s1, k, CASE k % 10 WHEN 1 THEN l||',S1-9' WHEN 2 THEN l||',X-1' WHEN 4 THEN l||',S2-x' WHEN 5 THEN l||','||l ELSE l END AS rest FROM ls),
fl AS (SELECT s1, rest, false AS bad FROM bd WHERE k % 10 <> 8 UNION ALL SELECT s1, rest, false FROM bd WHERE k % 10 = 6 UNION ALL SELECT 'S1-extra'||s1, '', false FROM bd WHERE k % 10 = 9 UNION ALL SELECT NULL, NULL, true FROM bd WHERE k % 10 = 8),
il AS (SELECT s1, CASE WHEN trim(rest) = '' THEN [] ELSE string_split(rest, ',') END AS ids FROM fl WHERE NOT bad)"""


def _file(name: str, sql: str):
    """A query of the lines of the damaged match file and the Entities."""

    def add(f):
        query(name, f"{_FILE_SQL} {sql}")(lambda spark, sf_dir: f(tables.read_raw(spark, _submission(spark, sf_dir, True)), Entities.load(spark, sf_dir)))
        return f

    return add


_file("validate_rows", "SELECT (SELECT count(*) FROM il) AS rows, (SELECT count(*) FROM il WHERE len(ids) = 0) AS empty, (SELECT count(*) FROM il WHERE len(ids) > 0) AS non_empty, (SELECT count(*) FROM fl WHERE bad) AS malformed")(lambda raw, e: rounded(quality.validate_rows(raw)))
_file("validate_dup_rows", "SELECT s1, count(*) AS n FROM fl WHERE NOT bad GROUP BY 1 HAVING count(*) > 1")(lambda raw, e: quality.validate_repeats(raw))
_file("validate_intra_dupes", "SELECT DISTINCT s1 FROM il WHERE len(ids) <> len(list_distinct(ids))")(lambda raw, e: quality.validate_inner_repeats(raw))
_file("validate_id_classes", "SELECT kind, id FROM (SELECT CASE WHEN starts_with(id,'S1-') THEN 'self' WHEN NOT starts_with(id,'S2-') AND NOT starts_with(id,'S3-') THEN 'prefix' WHEN id NOT IN (SELECT entity_id FROM nz) THEN 'unknown' END AS kind, id FROM (SELECT DISTINCT unnest(ids) AS id FROM il)) WHERE kind IS NOT NULL")(lambda raw, e: quality.validate_ids(raw, e.noisy.select(F.col("entity_id").alias("noisy_id"))))
_file("validate_coverage", "SELECT 'missing' AS kind, entity_id AS id FROM s1 WHERE entity_id NOT IN (SELECT s1 FROM fl WHERE NOT bad) UNION ALL SELECT DISTINCT 'extra', s1 FROM fl WHERE NOT bad AND s1 NOT IN (SELECT entity_id FROM s1)")(lambda raw, e: quality.validate_coverage(raw, e.ids))
_file("validate_subset", "SELECT DISTINCT s1, id FROM (SELECT s1, unnest(ids) AS id FROM il) WHERE (s1, id) NOT IN (SELECT (s1_id, noisy_id) FROM truth)")(lambda raw, e: quality.validate_subset(raw, e.truth.groupBy("s1_id").agg(F.array_join(F.collect_list("noisy_id"), ",").alias("l")).select(F.concat("s1_id", F.lit("\t"), "l").alias("value"))))


@query("gt_parse", "SELECT s.entity_id AS s1_id, coalesce(l, '') AS ids, coalesce(n, 0) AS n FROM s1 s LEFT JOIN (SELECT s1_id, string_agg(noisy_id, ',' ORDER BY noisy_id) AS l, count(*) AS n FROM truth GROUP BY 1) x ON x.s1_id = s.entity_id")
def _(spark, sf_dir):
    e = Entities.load(spark, sf_dir)
    path = tables.write_tsv(tables.grouped_lists(e.ids, e.truth, "matched_entity_ids"), tables.scratch(spark, "truth"))
    return tables.read_matches(spark, path).select("s1_id", F.array_join(F.array_sort("ids"), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


_SOURCE_SQL = "SELECT entity_id, business_name, business_address, country FROM er"


@query("scan_tsv_roundtrip", _SOURCE_SQL)
def _(spark, sf_dir):
    path = tables.write_tsv(entity_records(table(spark, sf_dir, "documents")).select("country", *tables.SOURCE_COLUMNS[:3], "src"), tables.scratch(spark, "source"), quoted=True)
    return tables.read_strict(spark, path, tables.SOURCE_COLUMNS)


def _raw_source(spark: SparkSession, sf_dir: str) -> str:
    """A raw source file with, by doc_id, blank lines, rows with a field more or less, and a repeated header."""
    rows = entity_records(table(spark, sf_dir, "documents"))
    line = F.concat_ws("\t", *tables.SOURCE_COLUMNS)
    k = F.col("doc_id") % 20
    shape = F.when(k == 1, F.array(line, F.lit(""))).when(k == 2, F.array(F.concat(line, F.lit("\tmore")))).when(k == 3, F.array(F.col("entity_id"))).when(k == 4, F.array(line, F.lit("\t".join(tables.SOURCE_COLUMNS)))).otherwise(F.array(line))
    lines = rows.select(F.explode(shape).alias("value")).unionByName(spark.range(1).select(F.lit("\t".join(tables.SOURCE_COLUMNS)).alias("value")))
    to = tables.scratch(spark, "raw")
    lines.write.text(to)
    return to


@query("audit_lines", "SELECT count(*) + count(*) FILTER (doc_id % 20 IN (1,4)) + 1 AS lines, count(*) FILTER (doc_id % 20 = 1) AS blank_rows, count(*) FILTER (doc_id % 20 = 4) AS duplicate_headers, count(*) AS data_rows, count(*) FILTER (doc_id % 20 IN (2,3)) AS malformed_rows FROM er")
def _(spark, sf_dir):
    return rounded(quality.audit_lines(tables.read_raw(spark, _raw_source(spark, sf_dir)), tables.SOURCE_COLUMNS))


@query("scan_lenient", _SOURCE_SQL + " WHERE doc_id % 20 NOT IN (2,3)")
def _(spark, sf_dir):
    rows = tables.read_raw(spark, _raw_source(spark, sf_dir))
    head = "\t".join(tables.SOURCE_COLUMNS)
    kept = rows.where((F.col("value") != "") & (F.col("value") != head) & (F.size("fields") == len(tables.SOURCE_COLUMNS)))
    return kept.select(*[F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(tables.SOURCE_COLUMNS)]).where("entity_id <> ''")


_EMPTY = ", ".join(f"'' AS {c}" for c in tables.EXPERIMENT_COLUMNS if c not in ("experiment_id", "timestamp_utc", "notes"))


@query("experiment_append", f"SELECT 'run-'||(n_nationkey % 7) AS experiment_id, CASE WHEN n_nationkey % 7 < 4 THEN '2000-01-01T00:00:00Z' ELSE '2000-01-02T00:00:00Z' END AS timestamp_utc, min(n_name) AS notes, {_EMPTY} FROM nation GROUP BY 1, 2", prelude=False)
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "nation").select(F.concat(F.lit("run-"), F.col("n_nationkey") % 7).alias("experiment_id"), F.col("n_name").alias("notes"))
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in tables.EXPERIMENT_COLUMNS))
    first, _ = tables.append_experiments(none, ids.where("experiment_id < 'run-4'"), now="2000-01-01T00:00:00Z")
    return tables.append_experiments(first, ids, now="2000-01-02T00:00:00Z")[0]
