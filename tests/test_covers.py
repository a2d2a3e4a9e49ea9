"""Covers against dropping one area after another."""

import random

from pyspark.sql import functions as F

from ridgeline.operators import ways


def test_cover_rounds_equal_one_by_one(spark):
    rnd = random.Random(3)
    for n in range(4):
        held = {a: set(rnd.sample(range(12 + 8 * n), rnd.randrange(1, 8))) for a in range(25)}
        left = dict(held)
        while True:
            spare = [a for a, c in left.items() if all(sum(x in o for o in left.values()) > 1 for x in c)]
            if not spare:
                break
            del left[min(spare, key=lambda a: (-len(left[a]), a))]
        rows = spark.createDataFrame([(a, c) for a, cs in held.items() for c in cs], "area int, cell int")
        assert {r.area for r in ways.reduced_cover(rows).collect()} == set(left)
    assert ways.reduced_cover(rows.where(F.lit(False))).collect() == []
