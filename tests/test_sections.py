"""Operators on sections against plain Python."""

import math

import numpy as np
import pytest

from seriata.operators import sections as R


def test_nonuniform_is_the_best_of_all_angles(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(6):
        a = rng.normal(size=(30, 2)) * [3, 1] + [10, -4]
        angle, k = rng.uniform(-3, 3), rng.uniform(0.4, 2, 2)
        turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        b = a * k @ turn.T + [1, 2] + rng.normal(size=a.shape) * 0.05 * g
        want[g] = (a, b, angle, k)
        rows += [(g, *map(float, p), *map(float, q)) for p, q in zip(a, b, strict=True)]
    rows += [(9, 1.0, float(i), float(i), 1.0) for i in range(4)]  # no extent along x
    out = {r.g: r for r in R.nonuniform(spark.createDataFrame(rows, "g int, sx double, sy double, tx double, ty double"), ["g"]).collect()}
    assert out[9].angle is None and out[9].vaf is None
    for g, (a, b, angle, k) in want.items():
        if g == 0:
            assert np.allclose([out[g].angle, out[g].scale_x, out[g].scale_y], [angle, *k], atol=1e-8)
        x, y = a - a.mean(0), b - b.mean(0)
        best = 0.0
        for t in np.linspace(-math.pi, math.pi, 20001):
            c, s = math.cos(t), math.sin(t)
            p, q = (x[:, 0] @ (c * y[:, 0] + s * y[:, 1])) / (x[:, 0] @ x[:, 0]), (x[:, 1] @ (c * y[:, 1] - s * y[:, 0])) / (x[:, 1] @ x[:, 1])
            if p >= 0 and q >= 0:
                left = y - np.stack([c * p * x[:, 0] - s * q * x[:, 1], s * p * x[:, 0] + c * q * x[:, 1]], 1)
                best = max(best, 1 - (left**2).sum() / (y**2).sum())
        assert best - 1e-9 <= out[g].vaf <= best + 1e-5


def test_folders_must_be_there_once(spark):
    folders = spark.createDataFrame([("a/S_1",), ("a/S_2",), ("b/S_2",), ("c/notes",)], "folder string")
    one = spark.createDataFrame([(1,)], "section long")
    assert [tuple(r) for r in R.find_folders(folders, one).collect()] == [(1, "a/S_1")]
    for missing in (2, 3):
        with pytest.raises(Exception, match=f"section {missing} has folders"):
            R.find_folders(folders, spark.createDataFrame([(missing,)], "section long")).collect()


def test_rings(spark):
    rows = [(1, i, *p) for i, p in enumerate([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0), (0.0, 0.0)])] + [(2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0)]
    out = R.open_rings(spark.createDataFrame(rows, "s int, k int, x double, y double"), ["s"], "k", 2.0).orderBy("s", "ord")
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (1, 2, 2.0, 2.0), (2, 0, 10.0, 10.0)]


def image(spark, n=7):
    return spark.createDataFrame([(0, y, x, (y * 37 + x * 91) % 256) for y in range(n) for x in range(n)], "image_id long, y long, x long, v int")


def test_remap_against_loops(spark):
    rng = np.random.default_rng(2)
    places = [(0, i // 9, i % 9, float(rng.uniform(-2, 8)), float(rng.uniform(-2, 8))) for i in range(81)]
    df = spark.createDataFrame(places, "image_id long, y long, x long, fx double, fy double")
    level = lambda y, x: (y * 37 + x * 91) % 256 if 0 <= y < 7 and 0 <= x < 7 else 0
    got = {(r.y, r.x): r.v for r in R.remap(image(spark), df).collect()}
    masks = {(r.y, r.x): r.v for r in R.remap(image(spark), df, nearest=True).collect()}
    for _, y, x, fx, fy in places:
        b, a = math.floor(fy), math.floor(fx)
        v = sum(level(b + j, a + i) * (fy - b if j else 1 - fy + b) * (fx - a if i else 1 - fx + a) for j in (0, 1) for i in (0, 1))
        assert got[y, x] == round(round(v, 9)) and masks[y, x] == level(round(fy), round(fx))


def test_paths_of_a_section(spark):
    p = image(spark)
    chain = spark.createDataFrame([(0, k, 1.0, 0.0, 1.0 if k == 1 else 0.0, 0.0, 1.0, 0.0) for k in (1, 2, 3)], "image_id long, step int, a double, b double, tx double, c double, d double, ty double")
    moved = {(r.y, r.x): r.v for r in R.load_section(p, chain, mask=p.where("x > 3")).collect()}
    assert moved == {(r.y, r.x): (r.y * 37 + (r.x + 1) * 91) % 256 if r.x < 6 else 0 for r in p.collect()}
    assert R.load_section(p, chain, path="none").count() == 49
    assert R.load_section(p, chain.where("step < 3"), path="image").count() == 49
    with pytest.raises(Exception, match="one rough and one fine"):
        R.load_section(p, chain, path="image").collect()
    with pytest.raises(ValueError):
        R.load_section(p, chain, path="other")


def test_second_peak(spark):
    counts = [0.0, 6.0, 8.0, 2.0, 1.0, 4.0, 20.0, 5.0]
    df = spark.createDataFrame([(counts, 6), (counts, -1), ([1.0, 2.0, 3.0, 9.0], 3)], "c array<double>, m int")
    from pyspark.sql import functions as F

    out = [r[0] for r in df.select(R.without_low_peak(F.col("c"), F.col("c"), F.col("m"), F.lit(0.0))).collect()]
    total = sum(counts)
    assert np.allclose(out[0], [i / 4 / total for i in range(5)] + [x / total for x in counts[5:]])
    assert np.allclose(out[1], np.array(counts) / total) and np.allclose(out[2], np.array([1, 2, 3, 9]) / 15)


def test_chunks_are_array_split(spark):
    rows = [(g, i) for g, n in ((0, 23), (1, 3), (2, 14)) for i in range(n)]
    out = R.permuted_chunks(spark.createDataFrame(rows, "g int, i int"), ["g"], "i", 7, 1).collect()
    for g, n in ((0, 23), (1, 3), (2, 14)):
        want = [k for k, part in enumerate(np.array_split(np.arange(n), 7)) for _ in part]
        assert [r.chunk for r in sorted((r for r in out if r.g == g), key=lambda r: r.place)] == want


def test_export_keeps_rows(spark, tmp_path):
    p = image(spark)
    R.export_sections(p, str(tmp_path / "a"), rows=2)
    R.add_masks(str(tmp_path / "a"), p.where("v > 100"), str(tmp_path / "b"), rows=2)
    out = {(r.y, r.x): (r.v, r.mask) for r in spark.read.parquet(str(tmp_path / "b")).collect()}
    assert out == {(r.y, r.x): (r.v, r.v > 100) for r in p.collect()}
