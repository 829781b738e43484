"""Medians and quantiles: sorted ranks and digits give the same, with few shuffles."""

import numpy as np
from pyspark.sql import functions as F

from skysift.operators.localize import lookup
from skysift.operators.ordering import crowded, digit_quantiles, group_medians, quantiles


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _values(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k in range(6) for v in np.round(rng.normal(size=int(rng.integers(1, 60))), 1)]
    return spark.createDataFrame([*rows, (0, None), (1, float("nan"))], "k long, v double"), rows


def test_both_paths_of_quantiles_agree(spark):
    df, rows = _values(spark)
    points = {"a": 0.02, "m": 0.5, "z": 0.98}
    large = crowded(df, ["k"], 20)
    assert 0 < large.count() < 6
    of = lambda q: {r.k: (r.a, r.m, r.z) for r in q.collect()}
    plain, mixed, digits = of(quantiles(df, ["k"], "v", points)), of(quantiles(df, ["k"], "v", points, large=large)), of(digit_quantiles(df, ["k"], "v", points))
    assert plain == mixed == digits
    for k, got in plain.items():
        assert np.allclose(got, np.quantile([v for i, v in rows if i == k], list(points.values())), rtol=0, atol=1e-12)


def test_quantiles_of_small_keys_shuffle_once(spark):
    assert _plan(quantiles(_values(spark)[0], ["k"], "v", {"m": 0.5})).count("Exchange") == 1


def test_group_medians(spark):
    rows = [(1, False, 9.0), (1, True, 1.0), (1, True, 4.0), (1, False, 2.0), (2, False, 5.0), (2, False, 7.0), (2, False, 6.0), (3, True, 8.0), (3, False, 1.0)]
    df = spark.createDataFrame(rows, "k long, f boolean, v double")
    assert {r.k: r.m for r in group_medians(df, ["k"], "v", "m").collect()} == {1: 3.0, 2: 6.0, 3: 4.5}
    assert {r.k: r.m for r in group_medians(df, ["k"], "v", "m", first=F.col("f")).collect()} == {1: 2.5, 2: 6.0, 3: 8.0}


def test_lookup_meets_each_pixel_once(spark):
    one = {"mission_id": 1, "frame_idx": 0}
    det = spark.createDataFrame([{**one, "det_id": 5, "u": 10.0, "v": 10.0}])
    camera = {f"r{i}{j}": float(i == j) for i in range(3) for j in range(3)} | dict(t0=0.0, t1=0.0, t2=0.0, fx=1.0, fy=1.0, cx=0.0, cy=0.0)
    cameras = spark.createDataFrame([{**one, **camera, "img_w": 100, "img_h": 100, "model_w": 100, "model_h": 100}])
    pixels = [(1, 0, 10, 12, 3.0, 1.0, 2.0, 3.0), (1, 0, 10, 8, 5.0, 3.0, 2.0, 5.0), (1, 0, 10, 11, 4.0, None, None, None), (1, 0, 17, 10, 9.0, 9.0, 9.0, 9.0)]
    samples = spark.createDataFrame(pixels, "mission_id long, frame_idx long, r long, c long, depth double, px double, py double, pz double")
    shared, apart = lookup(det, samples, samples, cameras), lookup(det, samples, samples.select("*"), cameras)
    assert "Union" not in _plan(shared) and "percentile" not in _plan(shared)
    for found in (shared, apart):
        row = found.first()
        assert (row.x_m, row.y_m, row.z_m, row.neighborhood_size, row.source) == (2.0, 2.0, 4.0, 5, "points")
