import numpy as np
import pandas as pd
import pytest


from thermocline.operators import geography as g


def greedy(points, threshold):
    """The sequential loop the operator must equal: rows in id order."""
    pts = points.sort_values("float_id").reset_index(drop=True)
    taken, out = set(), []
    for i, row in pts.iterrows():
        if i in taken:
            continue
        near = pts.index[np.sqrt((pts.lat - row.lat) ** 2 + (pts.lon - row.lon) ** 2) <= threshold]
        if len(near) > 1:
            out.append((f"Cluster_{len(out)}", pts.lat[near].mean(), pts.lon[near].mean(), len(near)))
        else:
            out.append((str(int(row.float_id)), row.lat, row.lon, 1))
        taken.update(near)
    return out


def clustered(spark, points, threshold):
    rows = g.cluster_floats(spark.createDataFrame(points), threshold).collect()
    return sorted((r["leader"], r["float_id"], r["lat"], r["lon"], r["cluster_size"]) for r in rows)


def check(spark, points, threshold):
    got = [r[1:] for r in clustered(spark, points, threshold)]
    want = greedy(points, threshold)
    assert [(a, n) for a, _, _, n in got] == [(a, n) for a, _, _, n in want]
    assert np.allclose([r[1:3] for r in got], [r[1:3] for r in want])


def test_fixture(spark):
    pts = pd.DataFrame({"float_id": [1, 2, 3, 4], "lat": [10.0, 10.1, 10.05, 20.0], "lon": [75.0, 75.1, 75.05, 85.0]})
    assert [r[4] for r in clustered(spark, pts, 0.2)] == [3, 1]


@pytest.mark.parametrize("seed, n, spread, threshold", [(1, 120, 20, 2.0), (2, 80, 5, 2.0), (3, 60, 3, 0.7)])
def test_equals_the_loop(spark, seed, n, spread, threshold):
    r = np.random.default_rng(seed)
    check(spark, pd.DataFrame({"float_id": r.permutation(n), "lat": r.uniform(-spread, spread, n),
                               "lon": r.uniform(-spread, spread, n)}), threshold)


def test_hot_place_and_a_chain(spark):
    n = 60
    hot = pd.DataFrame({"lat": np.where(np.arange(n) % 3 == 0, 5.0, np.arange(n) * 0.9),
                        "lon": np.where(np.arange(n) % 3 == 0, 5.0, 0.0), "float_id": np.arange(n)})
    check(spark, hot, 2.0)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """A thousand floats, each within reach of the next: rounds do not follow the chain."""
    rounds, one = [], g._round
    monkeypatch.setattr(g, "_round", lambda *a: rounds.append(1) or one(*a))
    chain = pd.DataFrame({"float_id": np.arange(1000), "lat": np.arange(1000) * 0.17 - 85, "lon": np.arange(1000) * 0.3})
    check(spark, chain, 0.5)
    assert len(rounds) <= 6


@pytest.mark.parametrize("seed", [1, 2])
def test_many_blocks_and_crowded_cells(spark, monkeypatch, seed):
    """Small blocks and cells that send few of their points give the same centres, in more rounds."""
    monkeypatch.setattr(g, "BLOCK_POINTS", 1)
    monkeypatch.setattr(g, "LEAST_BITS", 2)
    monkeypatch.setattr(g, "CELL_POINTS", 2)
    r = np.random.default_rng(seed)
    n = 400
    check(spark, pd.DataFrame({"float_id": r.permutation(n), "lat": np.where(np.arange(n) % 3 == 0, r.normal(0, 0.3, n), r.uniform(-9, 9, n)),
                               "lon": np.where(np.arange(n) % 3 == 0, r.normal(0, 0.3, n), r.uniform(-9, 9, n))}), 1.0)


def test_grid_ties_at_exactly_the_threshold(spark):
    xs, ys = np.meshgrid(np.arange(8) * 1.0, np.arange(6) * 1.0)
    check(spark, pd.DataFrame({"float_id": np.arange(48), "lat": ys.ravel(), "lon": xs.ravel()}), 2.0)


def test_markers_and_single_row(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "float_id int, lat double, lon double")
    r = g.cluster_floats(pts).collect()
    assert [(x["float_id"], x["cluster_size"], x["marker_size"]) for x in r] == [("1", 1, 12)]
    many = spark.createDataFrame([(i, 0.0, 0.0) for i in range(4)], "float_id int, lat double, lon double")
    assert g.cluster_floats(many).first()["marker_size"] == 20


def test_profile_series(spark):
    rows = spark.createDataFrame(
        [("A", 0, 25.0, 35.0, 6.0), ("A", 10, None, 35.01, 5.95), ("B", None, 1.0, 1.0, 1.0)],
        "float_id string, depth int, temperature double, salinity double, oxygen double")
    got = {(r["series"], r["depth"], r["value"]) for r in g.profile_series(rows, "A").collect()}
    assert got == {("temperature", 0, 25.0), ("salinity", 0, 35.0), ("salinity", 10, 35.01), ("oxygen", 0, 6.0),
                   ("oxygen", 10, 5.95)}


def test_density_contours(spark):
    rows = spark.createDataFrame([(float(i), 30.0 + i) for i in range(11)], "temperature double, salinity double")
    grid = g.density_contours(rows)
    assert grid.count() == 2500
    corner = grid.filter("i = 49 AND j = 0").first()
    assert corner["density"] == pytest.approx(1000 + 0.8 * 5 - 0.2 * -15)
    assert g.density_contours(rows.limit(10)).count() == 0


def test_thresholds(spark):
    rows = spark.createDataFrame([(1.0, 8.0), (3.0, 8.2), (7.0, None), (None, 8.1)], "oxygen double, ph double")
    got = [(r["parameter"], r["threshold"], r["measurement_count"], r["below_count"]) for r in g.bgc_thresholds(rows).collect()]
    assert got == [("oxygen", 2.0, 3, 1), ("oxygen", 6.0, 3, 2), ("ph", 8.1, 3, 1)]


def test_comparison_labels(spark):
    m = spark.createDataFrame([(1, 0.0, 20.0, 35.0), (2, 0.0, None, 34.0), (3, 0.0, 1.0, 1.0)],
                              "profile_id int, depth double, temperature double, salinity double")
    numbered = spark.createDataFrame([(1, 1), (2, 2)], "profile_id int, position int")
    got = {(r["label"], r["parameter"], r["value"]) for r in g.profile_comparison(m, numbered).collect()}
    assert got == {("Profile 1", "temperature", 20.0), ("Profile 1", "salinity", 35.0), ("Profile 2", "salinity", 34.0)}
    named = spark.createDataFrame([(1, "North")], "profile_id int, label string")
    assert {r["label"] for r in g.profile_comparison(m, named).collect()} == {"North"}
