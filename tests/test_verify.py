import random
from itertools import combinations as pairs_of

import numpy as np
import pytest
from pyspark.sql import functions as F

import model
from softdeps import discover_rfds, rfd_check, rfd_holds, rfd_violations
from softdeps.functions.distances import measures_for
from softdeps.operators.edits import edit_candidates, edit_pairs
from softdeps.operators.meeting import meeting_for, meeting_tiles
from softdeps.operators.ordered import far_weight
from softdeps.operators.pairs import distance_matrix, distance_vectors, encode
from softdeps.operators.stats import median_values
from softdeps.operators.zones import zone_tiles
from softdeps.session import stage, stage_counted


def relation(seed, n=150):
    """A third of all rows share one key value; some values are missing and some rows repeat."""
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 1 / 3 else rnd.choice(["a", "ab", "b", None])
    return [(i, key(), rnd.choice([None, rnd.randint(0, 20)]), float(rnd.randint(0, 40))) for i in range(n)]


CASES = [({"k": 0}, "y", 30), ({"k": 0, "x": 2}, "y", 20), ({"x": 1}, "k", 2), ({"x": 3, "y": 5}, "k", 1), ({"k": 1, "y": 0}, "x", 4), ({"k": 0}, "x", 0), ({"k": 1}, "y", 9), ({"y": 0}, "x", 3)]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("zone_rows", [6, 4096])
def test_violations_match_brute_force(spark, case, zone_rows):
    lhs, rhs, limit = CASES[case]
    rows = relation(case)
    df = spark.createDataFrame(rows, "id int, k string, x int, y double")
    at = {"k": (1, model.text), "x": (2, model.number), "y": (3, model.number)}
    dist = lambda c, a, b: at[c][1](a[at[c][0]], b[at[c][0]])
    want = {(a[0], b[0]) for a, b in pairs_of(rows, 2) if all(dist(c, a, b) <= t for c, t in lhs.items()) and dist(rhs, a, b) > limit}
    got = [(r["id_a"], r["id_b"]) for r in rfd_violations(df, lhs, rhs, limit, "id", zone_rows=zone_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    check = rfd_check(df, lhs, rhs, limit, zone_rows=zone_rows).first()
    assert (check["violations"], check["holds"]) == (len(want), not want)


@pytest.mark.parametrize("zone_rows", [5, 4096])
@pytest.mark.parametrize("seed", [1])
def test_given_medians_agree_with_full_vectors(spark, seed, zone_rows, monkeypatch):
    from softdeps.operators import zones

    monkeypatch.setattr(zones, "LEAST_ZONE_ROWS", zone_rows)
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 30), rnd.choice(["a", "ab", "abc", "xyz"]), rnd.choice([None, rnd.randint(0, 15)])) for _ in range(45)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    known = median_values(stage(distance_vectors(df), "known"))
    plain = {tuple(r) for r in discover_rfds(df).collect()}
    assert {tuple(r) for r in discover_rfds(df, medians=known).collect()} == plain


def test_every_rule_holds(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 12), rnd.randint(0, 12), rnd.randint(0, 9)) for _ in range(14)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    rules = discover_rfds(df).collect()
    assert rules
    for r in rules[:4]:
        lhs = {c: r[c] for c in "abc" if r[c] is not None}
        assert rfd_holds(df, lhs, r["rhs"], r["rhs_threshold"])


def test_one_hot_key_with_a_settled_answer(spark):
    """40,000 rows of one key: tile bounds settle it, no pair of the group is joined."""
    df = spark.range(40_000).select(F.lit("hot").alias("k"), (F.col("id") % 1000).cast("double").alias("y"))
    assert rfd_holds(df, {"k": 0}, "y", 999)
    wide = df.union(spark.createDataFrame([("hot", 5000.0)], "k string, y double"))
    assert rfd_check(wide, {"k": 0}, "y", 999).first()["violations"] == 40_000


def test_repeated_and_null_keys_lose_no_pair(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 10), (2, 0, 20), (None, 0, 30), (None, 0, 40)], "id int, x int, y int")
    found = rfd_violations(df, {"x": 0}, "y", 5, "id").collect()
    want = [(1, 1), (1, 2), (1, 2), *[(1, None)] * 4, *[(2, None)] * 2, (None, None)]
    order = lambda pairs: sorted(pairs, key=repr)
    assert order((r["id_a"], r["id_b"]) for r in found) == order(want)
    assert rfd_check(df, {"x": 0}, "y", 5).first()["violations"] == len(want)
    matrix = distance_matrix(df, dedup=False, key="id").collect()
    assert order((r["id_a"], r["id_b"]) for r in matrix) == order(want)


def test_edit_pairs_match_brute_force(spark):
    """Short and empty texts, repeated grams, letters beyond the first plane, a prefix that all share."""
    rnd = random.Random(2)
    values = {"".join(rnd.choice("ab\u00e9") for _ in range(rnd.randrange(0, 9))) for _ in range(90)} | {f"Item#0000{rnd.randrange(3000):06d}" for _ in range(120)} | {"aaaaaaaaaa", "aaaaaaaaab", "\U0001f600x", "x"}
    df = spark.createDataFrame([(v,) for v in values] + [(None,), ("x",)], "v string")
    for k, q in ((1, None), (2, 2), (3, 3)):
        want = {(*sorted(p), int(model.text(*p))) for p in pairs_of(values, 2) if model.text(*p) <= k}
        got = [(*sorted((r["value_a"], r["value_b"])), r["distance"]) for r in edit_pairs(df, k, q).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert edit_pairs(df, 0).collect() == []


def test_edit_index_tests_few_pairs(spark):
    rnd = random.Random(4)
    n = 3000
    values = spark.createDataFrame([("".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(8, 24))),) for _ in range(n)], "v string")
    assert edit_candidates(values, 2, 3).count() < 0.05 * n * (n - 1) / 2


def test_texts_that_share_most_of_their_letters_meet_few_others(spark):
    """Numbered names: nearly all grams are shared, what is left of a name without its differing character is not."""
    values = spark.range(4000).select(F.format_string("Customer#%09d", "id").alias("v"))
    found = edit_pairs(values, 1).count()
    assert found == 60_000 and edit_candidates(values, 1, 3).count() <= 1.5 * found


def test_leavings_and_grams_lose_no_pair_between_them(spark, monkeypatch):
    """Lengths on both sides of the longest text that is cut, the blot inside a text, runs of one letter."""
    from softdeps.operators import edits

    monkeypatch.setattr(edits, "LEAVINGS", 40)
    rnd = random.Random(5)
    for k in (1, 2):
        cut = edits.longest_cut(k)
        assert cut > k
        values = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(max(0, cut - 3), cut + 4))) for _ in range(100)} | {"", "a", "\0", "a\0", "\0\0b", "aaa", "aaaa"}
        got = {(*sorted((r["value_a"], r["value_b"])), r["distance"]) for r in edit_pairs(spark.createDataFrame([(v,) for v in values], "v string"), k).collect()}
        assert got == {(*sorted(p), int(model.text(*p))) for p in pairs_of(values, 2) if model.text(*p) <= k}


@pytest.mark.parametrize("most", [0, 4096])
def test_similar_texts_are_joined_by_value_pairs(spark, monkeypatch, most):
    """Without tiles, and with them where a value has more rows than it may."""
    from softdeps.operators import meeting, verify

    monkeypatch.setattr(meeting, "TEXT_ROWS", most)
    if most:
        monkeypatch.setattr(verify, "zone_tiles", lambda *_: pytest.fail("rows were cut into tiles"))
    rnd = random.Random(12)
    rows = [(i, rnd.choice([None, "hot", "hots", "t1", "t2", "t33"]), rnd.randint(0, 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k string, y int")
    want = {(a[0], b[0]) for a, b in pairs_of(rows, 2) if model.text(a[1], b[1]) <= 1 and abs(a[2] - b[2]) > 4}
    got = [(r["id_a"], r["id_b"]) for r in rfd_violations(df, {"k": 1}, "y", 4, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert rfd_check(df, {"k": 1}, "y", 4).first()["violations"] == len(want)


def test_no_threshold_pairs_all_tiles(spark):
    """Exact, banded and text thresholds: tiles meet by homes; far fewer pairs of tiles than all."""
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.col("id").cast("double").alias("x"), F.concat(F.lit("t"), F.col("id")).alias("s"), (F.col("id") % 7).alias("y"))
    measures = measures_for(rows)
    numbered, n = stage_counted(encode(rows, measures).withColumn("#id", F.monotonically_increasing_id()), "rows")
    for lhs, order in (({"k": 0}, "k"), ({"x": 3}, "x"), ({"k": 2, "x": 9000}, "k")):
        tiled = zone_tiles(numbered, n, [F.col(order)], 200)
        meeting = meeting_for(tiled, measures, lhs)
        assert meeting is not None and meeting_tiles(tiled, meeting).count() <= 3 * tiled.select("#tile").distinct().count()
    few = numbered.where("x < 300")
    assert meeting_for(few, measures, {"s": 1}).text == "s"
    assert meeting_for(few, measures, {"s": float("inf")}) is None


def test_bands_of_dates_infinities_and_large_numbers(spark):
    from datetime import date, timedelta

    rnd = random.Random(3)
    odd = [float("inf"), float("-inf"), 1e300, -1e300, 2.0**60, 2.0**60 + 512, 0.1, 0.3, 0.30000000000000004, -0.0, 0.0, None]
    rows = [(i, rnd.choice(odd + [rnd.random() * 5]), rnd.choice([None, date(1970, 1, 1) + timedelta(days=rnd.randint(-40, 40))]), rnd.randint(0, 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x double, d date, y int")
    far = lambda a, b: 0.0 if a == b else (model.INF if a is None or b is None else abs(a - b))
    days = lambda a, b: 0.0 if a == b else (model.INF if a is None or b is None else abs((a - b).days))
    for lhs in ({"x": 0.2}, {"d": 3}, {"d": 0, "x": 512.0}):
        at = {"x": (1, far), "d": (2, days)}
        want = {(a[0], b[0]) for a, b in pairs_of(rows, 2) if all(at[c][1](a[at[c][0]], b[at[c][0]]) <= t for c, t in lhs.items()) and abs(a[3] - b[3]) > 4}
        got = [(r["id_a"], r["id_b"]) for r in rfd_violations(df, lhs, "y", 4, "id", zone_rows=20).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert rfd_check(df, lhs, "y", 4, zone_rows=20).first()["violations"] == len(want)


def test_far_pairs_follow_the_distance_not_the_sum():
    rng = np.random.default_rng(6)
    values = [0.1, 0.2, 0.3, 0.5, 0.30000000000000004, 1e16, 1e16 + 2, -1e16, float("inf"), float("-inf"), 0.0]
    for limit in (0.0, 0.1, 0.2, 1.0, 1e16):
        x, y = (np.sort(np.concatenate([values, rng.integers(0, 30, 40) / 10])) for _ in range(2))
        wx, wy = (rng.integers(1, 4, len(x)) for _ in range(2))
        with np.errstate(invalid="ignore"):
            want = sum(int(a) * int(b) for u, a in zip(x, wx) for v, b in zip(y, wy) if v - u > limit)
        assert far_weight(x, wx, y, wy, limit) == want


def test_counts_by_order_of_dates(spark):
    from datetime import date, timedelta

    rnd = random.Random(9)
    rows = [(i, rnd.choice(["hot", "hot", "a", None]), rnd.choice([None, *(date(2020, 1, 1) + timedelta(days=d) for d in (0, 1, 3, 4, 9))])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, d date")
    days = lambda a, b: 0.0 if a == b else (model.INF if a is None or b is None else abs((a - b).days))
    for limit in (0, 2.5, 3, float("inf")):
        want = sum(model.text(a[1], b[1]) == 0 and days(a[2], b[2]) > limit for a, b in pairs_of(rows, 2))
        assert rfd_check(df, {"k": 0}, "d", limit, zone_rows=3).first()["violations"] == want
