"""Bit sets of one and of several words, and discovery over more attributes than one word holds."""

import random

import pytest
from pyspark.sql import functions as F

import model
from softdeps import discover_rfds
from softdeps.functions.bitsets import BitSets


@pytest.mark.parametrize("width,word", [(1, 62), (5, 62), (62, 62), (63, 62), (130, 62), (7, 3), (6, 3)])
def test_sets_match_python(spark, width, word):
    rnd, sets = random.Random(width), BitSets(width, word)
    rows = [tuple(rnd.choice([True, False, None]) for _ in range(2 * width)) for _ in range(8)] + [(True,) * (2 * width)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} boolean" for i in range(2 * width)))
    a, b = (sets.of([F.col(f"c{i + at}") for i in range(width)]) for at in (0, width))
    out = df.select(
        sets.size(a).alias("n"), sets.covers(a, b).alias("covers"), sets.size(sets.both(a, b)).alias("both"), (a == sets.full()).alias("full"),
        F.array(*[sets.has(a, j) for j in range(width)]).alias("has"), *[F.col(f"c{i}") for i in range(2 * width)],
    )
    for r in out.collect():
        x, y = ({i for i in range(width) if r[f"c{i + at}"]} for at in (0, width))
        assert (r["n"], r["covers"], r["both"], r["full"]) == (len(x), y <= x, len(x & y), len(x) == width)
        assert {j for j, h in enumerate(r["has"]) if h} == x


def test_seventy_attributes(spark):
    """71 columns: 70 on the left, which no single word holds."""
    rnd = random.Random(12)
    names = [f"a{i}" for i in range(70)] + ["y"]
    rows = [tuple(rnd.randint(0, 3 + i % 5) for i in range(70)) + (rnd.randint(0, 6),) for _ in range(7)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    want = model.dependencies(model.vectors(rows, [model.number] * 71), 70, list(range(70)))
    assert any(sum(t is not None for t in v) > 1 for _, v in want)
    got = {(r["rhs_threshold"], tuple(r[n] for n in names[:-1])) for r in discover_rfds(df, rhs="y").collect()}
    assert got == want
