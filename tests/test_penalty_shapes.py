"""Penalty components over shapes, against those of all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from isolume.operators import legacy
from isolume.operators.components import components
from shapes import frame, row


def mixed(seed=3, n=70):
    """Copies, drifted and truncated chains, single exons and neighbours that touch, on two strands."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        chain = [(200 + 300 * k + rnd.choice([0, 0, 0, 2, 4]), 400 + 300 * k) for k in range(rnd.choice([0, 2, 3]), rnd.choice([3, 4, 5]))]
        end = chain[-1][1] + 100 if chain else 300
        start = chain[0][0] - rnd.choice([50, 100]) if chain else 150
        rows.append(row(chain, rnd.choice("+-"), start=start, end=end, sample=f"S{i % 3}", tid=f"t{i % 60}", ord=i))
    return [*rows, row([], start=1900, end=2000, tid="u", ord=n), row([(2100, 2200)], start=2000, end=2300, tid="v", ord=n + 1), row([(2101, 2200)], start=2000, end=2300, tid="w", ord=n + 2)]


@pytest.mark.parametrize("penalties", [{}, {"min_shared": 3}, {"trunc5": 20.0, "per_bp": 4.0}])
def test_penalty_components_are_those_of_all_pairs(spark, penalties):
    t = frame(spark, mixed())
    edges = legacy.penalty_pairs(t, 3, None, **penalties).filter("mergeable AND score >= 90")
    roots = {r.node: r.root for r in components(edges.select(F.col("a_ord").alias("u"), F.col("b_ord").alias("v"))).collect()}
    got = {r.ord: r.root for r in legacy.penalty_components(t, 3, 90.0, None, **penalties).collect()}
    assert got == {r[7]: roots.get(r[7], r[7]) for r in mixed()}
    assert len(set(got.values())) < len(got)


def test_shapes_that_hang_together_are_not_scored_again():
    """500 shapes that all link: one score each with itself and one with the component, instead of one for each pair."""
    rows = [{"ord": i, "last": 1000, "start": 0, "end": 900, "j": [(100, 200, "+"), (300, 400 + i, "+")]} for i in range(500)]
    scored = []
    found = legacy._linked(rows, lambda a, b: scored.append(1) is None)
    assert set(found) == {(i, 0) for i in range(500)} and len(scored) < 1000
