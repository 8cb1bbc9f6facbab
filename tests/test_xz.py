import random

from pyspark.sql import functions as F

from terraflux.functions.xz import XZ


def test_ranges_hold_all_that_meets_the_query():
    rnd = random.Random(3)
    for xz in (XZ.two(), XZ.two(5), XZ.three(604_800.0, 7)):
        spans = xz.extents

        def box(scale: float, spans=spans):
            lo = [rnd.uniform(a, b) for a, b in spans]
            return tuple(lo), tuple(min(b, v + rnd.random() * scale * (b - a)) for v, (a, b) in zip(lo, spans))

        objects = [box(rnd.choice([0, 0.001, 0.02, 0.4, 1])) for _ in range(300)]
        codes = [xz.index(*o) for o in objects]
        assert 0 <= min(codes) and max(codes) < xz._below(0)
        kept = 0
        for _ in range(20):
            q = box(0.1)
            ranges = xz.ranges(*q)
            assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
            held = [any(a <= c <= b for a, b in ranges) for c in codes]
            meet = [all(l <= qh and ql <= h for l, h, ql, qh in zip(*o, *q)) for o in objects]
            assert all(h for h, m in zip(held, meet) if m)
            kept += sum(held)
        assert kept < 20 * 300  # it does prune


def test_index_is_depth_first():
    xz = XZ.two(2)
    assert xz.index((-180, -90), (180, 90)) == 1  # the first quadrant, doubled, holds the world
    assert xz.index((-180, -90), (-180, -90)) == 2 and xz.index((180, 90), (180, 90)) == 20


def test_column_and_prefilter(spark):
    xz = XZ.two()
    df = spark.createDataFrame([(1, 10.0, 10.0, 11.0, 11.0), (2, -100.0, 0.0, -99.0, 1.0), (3, None, 0.0, 1.0, 1.0)], "id int, a double, b double, c double, d double").withColumn("xz", xz.column("a", "b", "c", "d"))
    assert [r.id for r in df.where(xz.meets("xz", (5.0, 5.0), (20.0, 20.0))).collect()] == [1]
    assert df.where(F.col("xz").isNull()).count() == 1
