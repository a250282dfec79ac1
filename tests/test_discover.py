import random

import pytest
from pyspark.sql import functions as F

import model
from softdeps.operators.pairs import distance_vectors
from softdeps.plans.discover import combinations, discover_all, discover_rfds

BODY = [(175, 70, 40, 30), (175, 75, 39, 41), (175, 69, 40, 33), (176, 71, 40, 35), (178, 81, 41, 27), (169, 73, 38, 49), (170, 65, 39, 30)]


def frame(spark, rows, names, types=None):
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["int"] * len(names)))
    return spark.createDataFrame(rows, schema)


def found(df, names):
    out = {}
    for r in df.collect():
        lhs = [n for n in names if n != r["rhs"]]
        out.setdefault(r["rhs"], set()).add((r["rhs_threshold"], tuple(r[c] for c in lhs)))
    return out


def expected(rows, names, distances, integral=False):
    d = model.vectors(rows, distances)
    out = {}
    for i, n in enumerate(names):
        rules = model.dependencies(d, i, [j for j in range(len(names)) if j != i], integral)
        if rules:
            out[n] = rules
    return out


def test_body_measures(spark):
    names = ["height", "weight", "shoe_size", "age"]
    got = found(discover_all(frame(spark, BODY, names)), names)
    assert got == expected(BODY, names, [model.number] * 4)
    assert {c: len(r) for c, r in got.items()} == {"height": 5, "weight": 7, "shoe_size": 21, "age": 6}
    assert (1.0, (1.0, None, None)) in got["height"] and (5.0, (None, None, 0.0)) in got["weight"]


def test_wide_tables_use_joins_for_their_slices(spark, monkeypatch):
    from softdeps.plans import discover

    names = ["height", "weight", "shoe_size", "age"]
    monkeypatch.setattr(discover, "SMALL_WIDTH", 0)
    monkeypatch.setattr(discover, "FRONT_TILE_ROWS", 20)
    assert found(discover_rfds(frame(spark, BODY, names)), names) == expected(BODY, names, [model.number] * 4)


def test_degenerate_relations(spark):
    assert discover_rfds(frame(spark, [(1, 2)], ["a", "b"])).isEmpty()
    assert discover_rfds(frame(spark, [(1, 2), (1, 3), (1, 9)], ["a", "b"]), rhs="a").isEmpty()
    assert discover_rfds(frame(spark, [(1, 2)] * 5, ["a", "b"])).isEmpty()


def test_integral_levels_leave_fractional_distances_out(spark):
    rows = [(0.0, 0, 3), (0.2, 4, 1), (1.2, 9, 2), (3.0, 1, 9), (3.5, 2, 2), (7.5, 0, 4)]
    df = frame(spark, rows, ["b", "x", "y"], ["double", "int", "int"])
    got = found(discover_rfds(df, rhs="b", integral_levels=True), ["b", "x", "y"])
    want = model.dependencies(model.vectors(rows, [model.number] * 3), 0, [1, 2], integral=True)
    assert got.get("b", set()) == want


@pytest.mark.parametrize("seed", range(6))
def test_random_relations_match_the_model(spark, seed):
    rnd = random.Random(seed)
    k = 2 + seed % 3 + 1
    names = [f"c{i}" for i in range(k)]
    value = lambda: None if seed % 2 and rnd.random() < 0.1 else rnd.randint(0, 9)
    rows = [tuple(value() for _ in names) for _ in range(rnd.randint(6, 14))]
    got = found(discover_rfds(frame(spark, rows, names)), names)
    assert got == expected(rows, names, [model.number] * k)


@pytest.mark.parametrize("tiles", [1, 2, 5])
def test_vectors_do_not_depend_on_tiles(spark, tiles):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), rnd.choice(["ab", "abc", "b", ""]), rnd.random()) for _ in range(40)] * 2
    got = {tuple(r) for r in distance_vectors(frame(spark, rows, ["a", "b", "c"], ["int", "string", "double"]), tiles=tiles).collect()}
    assert got == model.vectors(rows, [model.number, model.text, model.number])
