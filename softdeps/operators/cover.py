"""Minimal cover: drop dependencies implied by another one.

A rule implies another of the same right side if it lies at or below it in the space of (right threshold, loosened left side), where an absent attribute is
looser than any threshold.  So the rules that stay are a front, and ``dominance`` finds it by boxes: rules whose boxes rule each other out never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.functions.formatting import _attributes
from softdeps.operators.dominance import boxed, covered
from softdeps.operators.pairs import q

COVER_BOX_ROWS = 4_096


def minimal_rfds(rfds: DataFrame) -> DataFrame:
    """Keep p unless some other q has no lhs attribute beyond p's, thresholds at least p's, and an rhs at most p's."""
    names = _attributes(rfds)
    every = ["rhs", "rhs_threshold"] + names
    looser = {f"#loose{i}": F.coalesce(-q(c).cast("double"), F.lit(float("-inf"))) for i, c in enumerate(names)}
    absent = {f"#absent{i}": F.when(q(c).isNull(), -1).otherwise(0) for i, c in enumerate(names)}  # an infinite threshold is still one
    rules = rfds.select(*[q(c) for c in every]).dropDuplicates().withColumns({**looser, **absent})
    measured = ["rhs_threshold", *looser, *absent]
    rows, _ = boxed(rules, ["rhs"], measured, COVER_BOX_ROWS)
    return rows.join(covered(rows, rows, measured, ["rhs"], apart=True), "#id", "left_anti").select(*[q(c) for c in every])
