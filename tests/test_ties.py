"""Values that lie on a limit, and equal values whose sums differ in the last place."""

import functools
import itertools
import math
import operator
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kinelake.operators import clip_features, pose, quality


def points(spark, rows):
    """Frames of shoulders, hips and ankles: (x, y) of each, the same on both sides."""
    cells = [{f"{s}_{j}_{k}": v for j, xy in zip(("shoulder", "hip", "ankle"), row, strict=True) for s in ("left", "right") for k, v in zip("xyc", (*xy, 1.0), strict=True)} for row in rows]
    return spark.createDataFrame([{"frame": i} | c for i, c in enumerate(cells)])


def test_hips_off_a_vertical_line_have_an_offset(spark):
    rows = points(spark, [((0.0, 0.0), (3.0, 10.0), (0.0, 20.0)), ((0.0, 0.0), (3.0, 10.0), (1e-9, 20.0)), ((0.0, 0.0), (3.0, 10.0), (-1e-9, 20.0))])
    got = [r.v for r in rows.orderBy("frame").select(pose.hip_line_offset(F.lit(10.0)).alias("v")).collect()]
    assert got == pytest.approx([-0.3, -0.3, 0.3])


def test_a_fall_on_the_limit_is_no_degradation(spark):
    # a and b fall by 5 exactly; the difference of their float means is a little more
    sets = {"a": [58, 19, 32, 81, 35, 67, 29, 30, 35], "b": [47, 70, 80, 97, 76, 38, 42, 43, 97]}
    sets |= {f"s{i}": list(p) for i, p in enumerate(itertools.permutations((20, 40, 60, 80, 100)))}
    rows = [(name, i, s) for name, scores in sets.items() for i, s in enumerate(scores, 1)]
    out = quality.degradation(spark.createDataFrame(rows, "set string, rep_index int, score int"), ["set"], 5.0).collect()
    assert len(out) == len(sets)
    for r in out:
        scores = sets[r["set"]]
        n = len(scores)
        doubled = [2 * sum(t < s for t in scores) + sum(t == s for t in scores) + 1 for s in scores]
        cov = sum((2 * i + 2) * y for i, y in enumerate(doubled)) * n - sum(2 * i + 2 for i in range(n)) * sum(doubled)
        third = [3 * i // n for i in range(n)]
        mean = lambda k: Fraction(sum(s for s, t in zip(scores, third, strict=True) if t == k), third.count(k))
        assert r["degrades"] == (cov < 0 and mean(0) - mean(2) > 5), scores


@pytest.mark.parametrize("swap", [False, True])
def test_the_left_side_stands_for_a_pair_of_equal_confidence(spark, swap):
    # both sides have the same confidences in another order; their float sums differ
    one, other = [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]
    assert functools.reduce(operator.add, one) != functools.reduce(operator.add, other)
    left, right = (other, one) if swap else (one, other)
    cells = [{"video": 1, "part": 0, "frame": i} | {f"{s}_{j}_{k}": v for j in clip_features.PAIRS for s, x, c in (("left", 1.0, a), ("right", 2.0, b)) for k, v in zip("xyc", (x, x, c), strict=True)} for i, (a, b) in enumerate(zip(left, right, strict=True))]
    rows = spark.createDataFrame(cells).coalesce(1)
    assert {r.wrist_px for r in pose.side_pair(rows, "wrist").collect()} == {1.0}
    assert {(r.wrist_x, r.ankle_y) for r in clip_features.with_pairs(rows, ["video", "part"]).collect()} == {(1.0, 1.0)}


def test_percentiles_of_windows_are_rounded_once():
    # the 5th percentile of 8 values lies between the first two: 0.65 * 0.1 + 0.35 * 0.7
    low = clip_features.RunningSpread([0.1, 0.7, *[1.0] * 6]).at(0.05)
    place = 0.05 * 7
    assert low == float(Fraction(0.1) * Fraction(1 - place) + Fraction(0.7 * place))


def test_lengths_are_those_of_sql(spark):
    rows = [(float(x) / 7, float(y) / 11) for x in range(40) for y in range(40)]
    got = spark.createDataFrame(rows, "x double, y double").select("x", "y", pose.length(F.col("x"), F.col("y")).alias("d")).collect()
    assert all(r.d == math.sqrt(r.x * r.x + r.y * r.y) for r in got)
