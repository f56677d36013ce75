"""Counts in boxes against plain loops."""

import random

from pyspark.sql import functions as F

from thermocline.operators import regions as rg


def test_counts_in_regions_equal_plain_loops(spark, monkeypatch):
    """Labels with many places, without a name, points at one place, boxes without area, beyond all points, repeated or faulty."""
    monkeypatch.setattr(rg, "MANY_PLACES", 8)
    draw = random.Random(3)
    points = [(i, draw.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]), draw.randrange(-9, 9) / 4, draw.randrange(-40, 40) / 4) for i in range(300)]
    points += [(1000 + i, 50 + i % 7, i / 8, i / 3) for i in range(60)] + [(2000, 1, None, 1.0), (2001, 1, float("nan"), 1.0)]
    boxes = [(i, s, s + draw.choice([0, 0.25, 1.0, 3.0, 90.0]), w, w + draw.choice([0.25, 2.0, 1e9]))
             for i, (s, w) in enumerate([(draw.randrange(-10, 9) / 4, draw.randrange(-44, 40) / 4) for _ in range(120)])]
    boxes += [boxes[7], (500, 3.0, 1.0, 0.0, 5.0), (501, None, 1.0, 0.0, 5.0), (502, -1e6, 1e6, -1e6, 1e6)]
    want = {}
    for region, s, n, w, e in boxes:
        inside = [] if s is None else [p for p in points if p[2] is not None and s <= p[2] <= n and w <= p[3] <= e]
        if inside:
            before = want.get(region, (0,))[0]
            want[region] = (before + len(inside), len({p[1] for p in inside} - {None}), min(p[0] for p in inside))
    got = rg.counts_in_regions(spark.createDataFrame(points, "id long, label int, lat double, lon double"),
                               spark.createDataFrame(boxes, "region int, south double, north double, west double, east double"), "id", "label")
    assert {r["region"]: (r["points"], r["labels"], r["first"]) for r in got.collect()} == want
    none = rg.counts_in_regions(spark.range(0).select(F.col("id"), F.col("id").alias("label"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")),
                                spark.createDataFrame(boxes, "region int, south double, north double, west double, east double"), "id", "label")
    assert none.count() == 0


def test_signed_boxes_count_a_label_once():
    draw = random.Random(1)
    for _ in range(300):
        places = {(draw.randrange(5), draw.randrange(5)) for _ in range(draw.randrange(1, 10))}
        signs = rg.signed_boxes(places)
        for _ in range(20):
            (s, n), (w, e) = sorted(draw.choices(range(-1, 6), k=2)), sorted(draw.choices(range(-1, 6), k=2))
            met = any(s <= y <= n and w <= x <= e for y, x in places)
            assert sum(v for b, v in signs.items() if s <= b[0] and b[1] <= n and w <= b[2] and b[3] <= e) == met
