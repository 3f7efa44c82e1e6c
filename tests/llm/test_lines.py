"""Line dedup against a plain version."""

import hashlib
import random
from collections import Counter

from lodestone.llm import linededup, queries
from tests.llm.test_suffixes import thue_morse

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def within_one(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < linededup.LEAST_LENGTH or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(rows):
    """The text that is left of each row; rows of one id are ordered by the SHA-256 of their texts."""
    place = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()[:15])
    seen, out = [], {}
    for r in sorted(set(rows), key=place):
        gone = []
        for n, line in enumerate((r[1] or "").split("\n")):
            line = line.strip(SPACE)
            if line:
                if any(within_one(line, s) for s in seen):
                    gone.append(n)
                seen.append(line)
        out[r] = None if r[1] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in gone)
    return [out[r] for r in rows]


def test_line_dedup(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)).strip() + "z" for n in (5, 19, 20, 21, 22, 40, 41, 80)]
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "short\nshort\nshorx"), (None, base[5]), (6, "A\n"), (7, "tail\n" + "y" * 30 + "\n\n" + "y" * 31 + "\n" + "y" * 29)]
    for k in range(80):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                p = rng.randrange(len(line))
                line[p : p + rng.choice([0, 1])] = rng.choice(["", "x", "ü"])
            lines.append(" " * rng.randrange(2) + "".join(line))
        rows.append((100 + k, "\n".join(lines)))
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, N_LINES string, first string")
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "first", "n_lines", "n_removed", "emptied", "deduped"]
    got = {r["doc_id"]: r for r in out.collect()}
    want = dict(zip((i for i, _ in rows), plain(rows), strict=True))
    assert {i: r["deduped"] for i, r in got.items()} == want
    for i, t in rows:
        n = sum(bool(x.strip(SPACE)) for x in (t or "").split("\n"))
        assert got[i]["n_lines"] == n and got[i]["emptied"] == (n > 0 and not (want[i] or "").strip(SPACE))
    kept = linededup.drop_emptied(df)
    assert kept.columns == df.columns and kept.count() == sum(not r["emptied"] for r in got.values())
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    out = linededup.dedup_lines(spark.createDataFrame([(1, "same line\nother"), (1, "same line\nother"), (2, "other")], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["deduped"]) for r in out.collect()) == [(1, "same line\nother"), (1, "same line\nother"), (2, "")]


def check(spark, rows):
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"], r["deduped"]) for r in out) == Counter((*r, t) for r, t in zip(rows, plain(rows), strict=True))


def test_rows_of_one_id(spark):
    """Null ids, and ids with several texts: lines of one row don't go for what another row of the id holds elsewhere."""
    for other in (None, 9):
        shared = "a line that many documents hold"
        check(spark, [(1, shared), (other, f"{shared}\nonly here, first\nonly here, second"), (other, "nowhere else, one\nnowhere else, two"), (other, "own\nown\nowm"), (other, "own\nown\nowm"), (other, f"x\n{shared[:-1]}"), (other, None), (other, "")])


def test_lines_whose_polynomials_agree_modulo_a_power_of_two(spark):
    one, two = (thue_morse(1024, k) for k in (0, 1))
    check(spark, [(1, one), (2, two), (3, f"{two}\n{one[:-1]}x")])


def test_long_texts_and_variants(spark):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefg é") for _ in range(3000))
    lines = [f"line {k} of a text that is much longer than a slice {rng.random()}" for k in range(12_000)]
    check(spark, [(1, line), (2, line[:1500] + line[1501:]), (3, line[:7] + "ü" + line[8:]), (4, line[:7] + "ü" + line[8:100] + line[101:])])
    out = linededup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["new", *lines[6_000:]]))], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["deduped"] == "new") for r in out) == [(1, 0, False), (2, 6_000, True)]


def test_line_dedup_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["deduped"] for r in linededup.dedup_lines(queries.table(spark, SF, "documents"), keep=["doc_id"]).collect()}
    assert got == dict(zip((i for i, _ in rows), plain(rows), strict=True))
