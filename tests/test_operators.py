import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import model
from softdeps.functions.distances import day_distance, edit_distance, measures_for
from softdeps.functions.formatting import format_rfd, to_long, to_wide
from softdeps.operators import cover, dominance
from softdeps.operators import levels as level_operators
from softdeps.operators.cover import minimal_rfds
from softdeps.operators.levels import dominates_subset, not_dominating, pool_intervals, pools, prior_min
from softdeps.operators.pairs import distance_matrix, distance_vectors, lookup_distance, row_pairs, value_distances, without_shared_start
from softdeps.operators.skyline import RunningFront, front_rows, skyline
from softdeps.operators.stats import approximate_medians, key_is_unique, median_values, medians
from softdeps.operators.taxonomy import taxonomy_distance
from softdeps.plans.discover import combinations, discover_rfds, relational_front
from softdeps.session import stage

INF = float("inf")


def test_null_rule_for_each_type(spark):
    rows = [(1, 1.0, "a", dt.datetime(2020, 1, 1, 23)), (2, None, None, None), (3, None, None, None), (4, 3.5, "ab", dt.datetime(2020, 1, 3, 1))]
    df = spark.createDataFrame(rows, "id int, n double, t string, d timestamp_ntz")
    got = {(r["id_a"], r["id_b"]): (r["n"], r["t"], r["d"]) for r in distance_matrix(df, dedup=False, key="id").collect()}
    assert got == {
        (1, 2): (INF, INF, INF), (1, 3): (INF, INF, INF), (2, 3): (0, 0, 0), (2, 4): (INF, INF, INF), (3, 4): (INF, INF, INF),
        (1, 4): (2.5, 1, 1),
    }


def test_whole_days_both_ways_and_bytes(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 3, 1), "café", "cafe")], "a timestamp_ntz, b timestamp_ntz, x string, y string")
    a, b, x, y = (F.col(c) for c in "abxy")
    row = df.select(day_distance(a, b), day_distance(b, a), edit_distance(x, y), edit_distance(x, y, bytes=True)).first()
    assert tuple(row) == (1.0, 1.0, 1.0, 2.0)


def test_boolean_columns_are_refused(spark):
    with pytest.raises(TypeError, match="Unrecognized dtype"):
        measures_for(spark.createDataFrame([(True,)], "flag boolean"))


def test_nan_counts_as_missing_and_float32_rounds(spark):
    df = spark.createDataFrame([(float("nan"),), (5.1,), (4.9,)], "x double")
    assert {r[0] for r in distance_vectors(df).collect()} == {INF, 5.1 - 4.9}
    small = {r[0] for r in distance_vectors(df, float32=True).collect()} - {INF}
    assert small == {float(np.float32(5.1) - np.float32(4.9))}
    assert {r[0] for r in distance_vectors(df, scale=3).collect()} == {INF, 0.2}


def test_custom_distance(spark):
    df = spark.createDataFrame([(1, "x"), (5, "y")], "n int, t string")
    got = distance_vectors(df, distances={"t": lambda a, b: F.lit(7)}).collect()
    assert [tuple(r) for r in got] == [(4.0, 7.0)]


@pytest.mark.parametrize("tiles", [1, 3, 8])
def test_each_pair_once(spark, tiles):
    pairs = row_pairs(spark.range(150).select(F.col("id").alias("k")), "k", tiles).select("a.k", "b.k").toDF("x", "y")
    assert pairs.count() == 11_175 and pairs.distinct().count() == 11_175 and pairs.where("x >= y").isEmpty()


def test_row_pairs_meet_by_blocks(spark, capsys):
    """The join meets blocks of rows, which generators unfold; rows that share a key or have none are paired once."""
    keys = [None, None] + [k // 2 for k in range(1200)]
    pairs = row_pairs(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int"), "k", 2)
    found = [tuple(r) for r in pairs.select("a.i", "b.i", "a.k", "b.k").toDF("i", "j", "k", "l").collect()]
    assert len(found) == len({frozenset(r[:2]) for r in found}) == len(keys) * (len(keys) - 1) // 2
    assert all(i != j and (l is None if k is None else l is None or k <= l) and (k, l) == (keys[i], keys[j]) for i, j, k, l in found)
    pairs.groupBy().count().explain()
    plan = capsys.readouterr().out
    assert 0 < plan.index("Generate") < plan.index("Join")
    assert row_pairs(spark.createDataFrame([], "k long"), "k").count() == row_pairs(spark.range(1).toDF("k"), "k").count() == 0


def test_text_memo_changes_nothing(spark, monkeypatch):
    from softdeps.operators import pairs

    rnd = random.Random(1)
    rows = [(rnd.choice(["red", "green", "blue", None]), rnd.randint(0, 50)) for _ in range(80)]
    df = spark.createDataFrame(rows, "t string, n int")
    plain = {tuple(r) for r in distance_vectors(df).collect()}
    monkeypatch.setattr(pairs, "MEMO_FROM", 1)
    assert {tuple(r) for r in distance_vectors(df).collect()} == plain == model.vectors(rows, [model.text, model.number])


def test_memo_lookup(spark):
    df = spark.createDataFrame([("ab", "b"), ("b", "ab"), ("b", "b"), (None, "b"), (None, None)], "x string, y string")
    memo = value_distances(spark.createDataFrame([("ab",), ("b",)], "v string"), "v")
    got = {(r["x"], r["y"]): r["d"] for r in lookup_distance(df, memo, "x", "y", "d").collect()}
    assert got == {("ab", "b"): 1.0, ("b", "ab"): 1.0, ("b", "b"): 0.0, (None, "b"): INF, (None, None): 0.0}


@pytest.mark.parametrize("seed", range(4))
def test_front_rows_brute_force(seed):
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 6, (300, 3)).astype(float)
    low[rng.random((300, 3)) < 0.1] = np.inf
    high = rng.integers(0, 6, 300).astype(float)
    points = {(*map(float, a), float(b)) for a, b in zip(low, high)}
    best = {p for p in points if not any(q != p and all(x <= y for x, y in zip(q[:3], p[:3])) and q[3] >= p[3] for q in points)}
    got = [(*map(float, low[i]), float(high[i])) for i in front_rows(low, high)]
    assert len(got) == len(set(got)) and set(got) == best


@pytest.mark.parametrize("tile_rows", [5, 40, 4096])
def test_skyline_does_not_depend_on_tiles(spark, tile_rows):
    rnd = random.Random(9)
    rows = [(float(rnd.randint(0, 30)), float(rnd.randint(0, 30)), float(rnd.randint(0, 30))) for _ in range(400)]
    got = {tuple(r) for r in skyline(spark.createDataFrame(rows, "a double, b double, c double").repartition(5), ["a", "b"], "c", tile_rows).collect()}
    pts = set(rows)
    assert got == {p for p in pts if not any(q != p and q[0] <= p[0] and q[1] <= p[1] and q[2] >= p[2] for q in pts)}


def test_pool_intervals_match_pools_level_by_level(spark):
    rnd = random.Random(4)
    raw = spark.createDataFrame([tuple(float(rnd.randint(0, 12)) for _ in range(3)) for _ in range(80)], "b double, x double, y double")
    front = stage(skyline(raw, ["x", "y"], "b").selectExpr("'b' rhs_name", "b rhs", "x l0", "y l1"), "front")
    points = [(r["rhs"], (r["l0"], r["l1"])) for r in front.collect()]
    lev = front.selectExpr("rhs_name", "rhs level").distinct()
    for tiles in (1, 3):
        got = {}
        for r in pools(front, 2, lev, tiles).collect():
            got.setdefault(r["level"], set()).add((r["l0"], r["l1"]))
        want = {b: model.minimal(v for x, v in points if x > b) for b, _ in points}
        assert got == {b: p for b, p in want.items() if p}


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_prior_min(spark, ranges):
    rnd = random.Random(5)
    data = [(g, float(b), rnd.choice([None, rnd.random(), INF])) for g in "pq" for b in rnd.sample(range(1000), 90)]
    out = prior_min(spark.createDataFrame(data, "g string, b double, m double"), ["m"], "g", "b", ranges).collect()
    assert len(out) == len(data)
    for r in out:
        above = [m for g, b, m in data if g == r["g"] and b > r["b"] and m is not None]
        assert r["prior_m"] == (min(above) if above else None)


@pytest.mark.parametrize("n", [7, 1000])
def test_median_narrowing(spark, n):
    rnd = random.Random(n)
    values = [(rnd.choice([rnd.random(), 0.25, 0.25, INF, float(rnd.randint(0, 3))]), rnd.random()) for _ in range(n)]
    df = stage(spark.createDataFrame(values, "x double, y double"), "medians")
    import statistics

    want = {"x": statistics.median(v[0] for v in values), "y": statistics.median(v[1] for v in values)}
    assert medians(df).first().asDict() == want
    assert median_values(df, size=10**9, limit=5) == want == median_values(df)


def test_combinations():
    cols = ["a", "b", "c"]
    assert combinations(cols) == [("a", ["b", "c"]), ("b", ["a", "c"]), ("c", ["a", "b"])]
    assert combinations(cols, rhs=1) == [("b", ["a", "c"])]
    assert combinations(cols, "c", ["a"]) == [("c", ["a"])]
    for bad in ({"lhs": ["a"]}, {"rhs": "z"}, {"rhs": 5}, {"rhs": "a", "lhs": ["a"]}):
        with pytest.raises(ValueError):
            combinations(cols, **bad)


def test_minimal_rules_and_shapes(spark):
    rules = spark.createDataFrame(
        [("h", 1.0, 2.0, 0.0, None), ("h", 1.0, 2.0, 0.0, 2.0), ("h", 0.0, None, 3.0, None), ("h", 2.0, 1.0, None, 1.0)],
        "rhs string, rhs_threshold double, w double, s double, a double",
    )
    kept = {(r["rhs_threshold"], r["w"], r["s"], r["a"]) for r in minimal_rfds(rules).collect()}
    assert kept == {(1.0, 2.0, 0.0, None), (0.0, None, 3.0, None), (2.0, 1.0, None, 1.0)} - {(1.0, 2.0, 0.0, None)}
    again = {tuple(r) for r in to_wide(to_long(rules), ["w", "s", "a"]).collect()}
    assert again == {tuple(r) for r in rules.collect()}
    assert "w(<= 2.0), s(<= 0.0) -> h(<= 1.0)" in [r["rule"] for r in format_rfd(rules).collect()]


def test_taxonomy_paths_and_fallback(spark):
    senses = spark.createDataFrame([("dog", "dog", 1), ("dog", "hotdog", 2), ("cat", "cat", 1), ("oak", "oak", 1), ("moon", "moon", 1)], "term string, node string, rank int")
    edges = spark.createDataFrame([("dog", "animal"), ("cat", "animal"), ("animal", "life"), ("oak", "plant"), ("plant", "life"), ("hotdog", "food")], "child string, parent string")
    got = {(r["term_a"], r["term_b"]): r["distance"] for r in taxonomy_distance(senses, senses, edges).collect()}
    assert got[("cat", "dog")] == 1 - 1 / 3 and got[("cat", "oak")] == 1 - 1 / 5 and got[("dog", "moon")] == 1.0
    df = spark.createDataFrame([("dog",), ("cat",), (None,), ("oak",)], "t string")
    known = distance_vectors(df, taxonomies={"t": (senses, edges)})
    assert {r[0] for r in known.collect()} == {1 - 1 / 3, 1 - 1 / 5, INF}
    odd = distance_vectors(df.union(spark.createDataFrame([("zzz",)], "t string")), taxonomies={"t": (senses, edges)})
    assert {r[0] for r in odd.collect()} == {2.0, 3.0, INF}


def test_key_uniqueness(spark):
    assert key_is_unique(spark.createDataFrame([(1,), (2,)], "k int"), "k")
    assert not key_is_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_cells_keep_to_a_bounded_number_of_partitions():
    from softdeps.operators.pairs import cell_partitions, tile_count

    tiles = tile_count(10**8, 4000)
    assert cell_partitions(tiles * (tiles + 1) // 2, 4000) <= 32 * 4000
    assert cell_partitions(10, 8) == 10


def test_plain_numbers_and_equal_infinities(spark):
    from softdeps.functions.distances import numeric_distance
    from softdeps.functions.formatting import number_text
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(12345678.0, "12345678.0"), (0.5, "0.5"), (1.5e9, "1500000000.0"), (2.0, "2.0")], "x double, want string")
    assert df.where(number_text(F.col("x")) != F.col("want")).count() == 0
    inf = spark.createDataFrame([(float("inf"), float("inf"))], "a double, b double")
    assert inf.select(numeric_distance(F.col("a"), F.col("b"))).first()[0] == 0.0


@pytest.mark.parametrize("box_rows", [3, 40, 4096])
def test_pool_operators_by_boxes(spark, box_rows, monkeypatch):
    monkeypatch.setattr(dominance.boxed, "__defaults__", (box_rows,))
    rng = random.Random(box_rows)
    value = lambda: rng.choice([None, 0.0, 1.0, 2.0, 3.0, 4.0, INF])
    rows = [(rng.choice([1, 1, 1, 2, None]), value(), value(), value()) for _ in range(300)]
    pool = [(rng.choice([1, 2, 2, None]), value(), value(), value()) for _ in range(40)]
    df, below = (spark.createDataFrame(r, "g int, x double, `y.z` double, w double").repartition(3) for r in (rows, pool))
    columns = ["x", "y.z", "w"]

    def some(row, test):
        return any(p[0] is not None and p[0] == row[0] and all(test(a, b) for a, b in zip(p[1:], row[1:])) for p in pool)

    known = lambda a, b: a is not None and b is not None and a <= b
    free = lambda a, b: b is None or a is not None and a <= b
    strict = lambda a, b: b is None or a is not None and a < b
    got = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    want = lambda keep: sorted((r for r in rows if keep(r)), key=repr)
    assert got(not_dominating(df, below, columns, ["g"])) == want(lambda r: not some(r, known))
    assert got(dominates_subset(df, below, columns, ["g"])) == want(lambda r: some(r, free))
    assert got(dominates_subset(df, below, columns, ["g"], strict=True)) == want(lambda r: some(r, strict))
    assert not_dominating(df, below.limit(0), columns, ["g"]).count() == len(rows)
    assert dominates_subset(df.limit(0), below, columns, ["g"]).count() == 0


def test_pool_boxes_that_cannot_meet_share_no_rows(spark, monkeypatch):
    """Of 100 x 100 pairs of boxes along a line only those about the diagonal are joined row by row; the rest is decided by bounds."""
    monkeypatch.setattr(dominance.boxed, "__defaults__", (200,))
    joined = []
    monkeypatch.setattr(dominance, "stage", lambda df, label: joined.append(stage(df, label)) or joined[-1])
    line = spark.range(20_000).selectExpr("1 g", "double(id) x", "double(-id) y")
    assert not_dominating(line, line, ["x", "y"], ["g"]).count() == 0
    pairs = next(d for d in joined if "whole" in d.columns)
    assert pairs.count() < 500


def test_large_front_in_bounded_memory(spark):
    """A front of 200,000 rows whose values oppose each other, among as many beaten rows, in runs of at most HELD_ROWS."""
    n = 200_000
    front = spark.range(n).selectExpr("double(id) x", "double(2 * id) b")
    beaten = front.selectExpr("x + 0.5 x", "b - 0.25 b")
    both = front.unionAll(beaten).repartition(8)
    got = skyline(both, ["x"], "b").agg(F.count("*"), F.sum("x"), F.sum(F.col("b") - 2 * F.col("x"))).first()
    assert tuple(got) == (n, n * (n - 1) / 2, 0.0)


def test_running_front_restarts():
    rng = np.random.default_rng(4)
    x = rng.permutation(5_000).astype(float)
    front, handed = RunningFront(1), []
    for at in range(0, len(x), 250):
        front.add(x[at : at + 250, None], x[at : at + 250])
        if len(front.high) >= 1_000:
            handed.append(front.restart())
            assert len(front.high) <= 500
    handed.append((front.low, front.high))
    assert len(handed) > 3 and {v for low, _ in handed for v in low[:, 0]} == set(x)


@pytest.mark.parametrize("box_rows", [20, 4096])
def test_minimal_rules_by_boxes(spark, box_rows, monkeypatch):
    monkeypatch.setattr(cover, "COVER_BOX_ROWS", box_rows)
    rng = random.Random(8)
    value = lambda: rng.choice([None, None, 0.0, 1.0, 2.0, 5.0, INF])
    rules = [(rng.choice("hhk"), float(rng.randrange(5)), value(), value(), value()) for _ in range(250)]
    implies = lambda s, r: s != r and s[0] == r[0] and s[1] <= r[1] and all(a is None or b is not None and a >= b for a, b in zip(s[2:], r[2:]))
    want = {r for r in rules if not any(implies(s, r) for s in rules)}
    df = spark.createDataFrame(rules, "rhs string, rhs_threshold double, w double, s double, a double")
    got = [tuple(r) for r in minimal_rfds(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert minimal_rfds(df.limit(0)).count() == 0


def test_median_edges_and_sketches(spark):
    inf = float("inf")
    odd = spark.createDataFrame([(1.0, None), (inf, None), (inf, 4.0), (2.0, 1.0)], "x double, y double")
    assert medians(odd).first().asDict() == {"x": inf, "y": 2.5}
    assert medians(odd.where("x < 0")).first().asDict() == {"x": None, "y": None}
    many = spark.range(200_000).selectExpr("cast(id * id as double) x", "cast(id % 7 as double) y")
    near = approximate_medians(many, 1_000).first()
    assert abs(near["x"] ** 0.5 - 100_000) <= 200_000 / 1_000 and near["y"] == 3.0


@pytest.mark.parametrize("seed", range(3))
def test_strategies(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(9), rng.randrange(5), rng.choice("abcd") * rng.randrange(1, 4), rng.randrange(4)) for _ in range(18)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d int")
    plain = discover_rfds(df)
    want = sorted(map(str, plain.collect()))
    assert want and sorted(map(str, discover_rfds(df, front=relational_front).collect())) == want
    least = sorted(map(str, minimal_rfds(plain).collect()))
    assert sorted(map(str, discover_rfds(df, front=relational_front, rules=minimal_rfds).collect())) == least and len(least) < len(want)
    with pytest.raises(ValueError):
        discover_rfds(df, front=relational_front, integral_levels=True)


def test_pools_in_derived_tiles(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("r", float(rng.randrange(9)), float(rng.randrange(6)), float(rng.randrange(6))) for _ in range(60)]
    front = stage(spark.createDataFrame(rows, "rhs_name string, rhs double, l0 double, l1 double").distinct(), "front")
    levels = front.select("rhs_name", F.col("rhs").alias("level")).distinct()
    one = sorted(map(tuple, pools(front, 2, levels).collect()))
    monkeypatch.setattr(level_operators, "FRONT_TILE_ROWS", 16)
    assert level_operators.tiles_for(front) > 2 and one and sorted(map(tuple, pools(front, 2, levels).collect())) == one


@pytest.mark.parametrize("most", [0, 256])
def test_few_nodes_are_measured_once_a_pair_of_nodes(spark, monkeypatch, most):
    from softdeps.operators import taxonomy

    monkeypatch.setattr(taxonomy, "MEMO_VALUES", most)
    edges = spark.createDataFrame([("a", "top"), ("b", "mid"), ("mid", "top")], "child string, parent string")
    terms = spark.createDataFrame([(f"t{i}", "abx"[i % 3]) for i in range(30)], "term string, node string")
    found = taxonomy_distance(terms, terms, edges)
    assert ("aggregate(" in found._jdf.queryExecution().optimizedPlan().toString()) == (not most)
    steps = {"aa": 0, "bb": 0, "xx": 0, "ab": 3}
    want = {(f"t{i}", f"t{j}"): steps.get("".join(sorted("abx"[i % 3] + "abx"[j % 3]))) for i in range(30) for j in range(30) if f"t{i}" < f"t{j}"}
    got = {(r["term_a"], r["term_b"]): r["distance"] for r in found.collect()}
    assert got == {pair: 1.0 if n is None else 1 - 1 / (n + 1) for pair, n in want.items()}


def test_a_start_that_all_texts_share_is_not_measured(spark):
    values = ["Item#\u00e91", "Item#\u00e822", "Item#\u00e8", "Item#\u00e82", None, "Item#\U0001f60022"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    cut = {r["id"]: r["v"] for r in without_shared_start(df, measures_for(df, ["v"])).collect()}
    assert cut == {i: v and v[5:] for i, v in enumerate(values)}
    got = {(r["id_a"], r["id_b"]): r["v"] for r in distance_matrix(df, dedup=False, key="id", columns=["v"]).collect()}
    assert got == {(i, j): model.text(values[i], values[j]) for i in range(6) for j in range(i + 1, 6)}
    plain = distance_vectors(df, columns=["v"])
    assert {r["v"] for r in plain.collect()} == set(got.values())
    same = spark.createDataFrame([(1, "x"), (2, "x"), (3, "xy"), (4, "")], "id int, v string")
    assert {r["v"] for r in distance_vectors(same, columns=["v"]).collect()} == {0.0, 1.0, 2.0}


def mixed_rows(spark, n=260):
    rng = random.Random(8)
    maybe = lambda v: None if rng.random() < 0.1 else v
    text = lambda: "Item" + "".join(rng.choice("abé\U0001f600\x00") for _ in range(rng.randrange(rng.choice([1, 9, 15]))))
    number = lambda: rng.choice([INF, -INF, float("nan"), -0.0, 1.5, rng.random()])
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randrange(-(10**7), 10**7))
    rows = [(maybe(rng.randrange(90)), maybe(number()), maybe(text()), maybe(day()), rng.choice([None, 1, 2, 3])) for _ in range(n)]
    return spark.createDataFrame(rows, "k long, n double, t string, d timestamp_ntz, i int").repartition(3)


@pytest.mark.parametrize("options", [{}, {"tiles": 4, "float32": True, "scale": 1}, {"tiles": 1, "bytes": True}])
@pytest.mark.parametrize("dedup", [False, True])
def test_blocks_in_numpy_give_the_distances_of_joins(spark, monkeypatch, dedup, options):
    from softdeps.operators import pairs

    df = mixed_rows(spark)
    monkeypatch.setattr(pairs, "PARTITION_PAIRS", 5_000)
    made = distance_matrix(df, dedup=dedup, key="k", **options)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, made.collect()))
    monkeypatch.setattr(pairs, "measurable", lambda *_: False)
    plain = distance_matrix(df, dedup=dedup, key="k", **options)
    assert "MapInArrow" not in plain._jdf.queryExecution().executedPlan().toString()
    assert got == sorted(map(str, plain.collect())) and (dedup or len(got) == 260 * 259 // 2)


def test_long_texts_and_string_keys_beside_blocks(spark):
    values = ["", "x" * 64, "y" * 64, "x" * 63 + "y", None]
    for more in ([], ["z" * 65]):
        rows = [(f"é{i % 4}", v) for i, v in enumerate(values + more)]
        df = spark.createDataFrame(rows, "id string, v string")
        found = distance_matrix(df, dedup=False, key="id")
        assert ("MapInArrow" in found._jdf.queryExecution().executedPlan().toString()) == (not more)
        want = [(*sorted((rows[i][0], rows[j][0])), model.text(rows[i][1], rows[j][1])) for i in range(len(rows)) for j in range(i)]
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_only_repeats_leave_before_vectors_are_dealt():
    from softdeps.operators.cells import fewer

    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 30, 50_000).astype(float), rng.choice([0.0, 0.5, np.inf], 50_000)]
    left = fewer(columns)
    assert len(left[0]) < 5_000 and set(zip(*map(list, left))) == set(zip(*map(list, columns)))


def test_numeric_distances_copy_no_row(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 4.0), (None, 6.0), (1, 6.5)], "k long, v double")
    found = distance_matrix(df, dedup=False, key="k", columns=["v"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "THEN named_struct" not in plan and "ELSE named_struct" not in plan
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 1, 2.5), (1, 3, 3.0), (1, 3, 5.5), (1, None, 2.0), (1, None, 0.5), (3, None, 5.0)], key=str)
