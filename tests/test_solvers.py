import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriata.functions import geometry as G
from seriata.functions import stats as S
from seriata.operators import fit, graph, image, interp, order, solve


def test_r2_examples(spark):
    rows = [("a", 3.0, 2.5), ("a", -0.5, 0.0), ("a", 2.0, 2.0), ("a", 7.0, 8.0), ("same", 1.0, 1.0), ("same", 2.0, 2.0), ("mean", 1.0, 2.0), ("mean", 2.0, 2.0), ("mean", 3.0, 2.0), ("back", 1.0, 3.0), ("back", 2.0, 2.0), ("back", 3.0, 1.0), ("one", 1.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, y double, f double")
    got = {r.k: r.r2 for r in S.r2(df, ["k"], "y", "f").collect()}
    assert got["a"] == pytest.approx(0.948, abs=1e-3) and got["same"] == 1 and got["mean"] == 0 and got["back"] == -3 and got["one"] is None and got["flat"] == 1


def test_graph_least_squares():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2))
    e = np.array([(a, b) for a in range(12) for b in range(12) if a != b and (a < 7) == (b < 7) and rng.random() < 0.5])
    noise, w = rng.normal(size=(len(e), 2)) * 0.1, rng.random(len(e)) + 0.1
    got, label = solve.solve_graph(e[:, 0], e[:, 1], x[e[:, 0]] - x[e[:, 1]] + noise, w, 12)
    A = np.zeros((len(e), 12))
    A[np.arange(len(e)), e[:, 0]], A[np.arange(len(e)), e[:, 1]] = 1, -1
    want = np.linalg.lstsq(A * w[:, None], (x[e[:, 0]] - x[e[:, 1]] + noise) * w[:, None], rcond=None)[0]
    for part in (range(7), range(7, 12)):
        part = list(part)
        assert len(set(label[part])) == 1 and np.allclose(got[part], want[part] - want[part].mean(0)) and np.allclose(got[part].mean(0), 0)
    twice, _ = solve.solve_graph(e[:, 0], e[:, 1], x[e[:, 0]] - x[e[:, 1]] + noise, 2 * w, 12)
    assert np.allclose(twice, got)


def test_gradients_give_what_least_squares_give():
    """Also on long chains, loops far apart and weights of several sizes."""
    rng = np.random.default_rng(8)
    for n, extra in ((721, 0), (300, 40), (2, 0)):
        i, j = np.arange(n - 1), np.arange(1, n)
        more = rng.integers(0, n, (extra, 2))
        more = more[more[:, 0] != more[:, 1]]
        i, j = np.concatenate([i, more[:, 0]]), np.concatenate([j, more[:, 1]])
        delta, w = rng.normal(size=(len(i), 2)), 10 ** rng.uniform(-1, 1, len(i))
        got, _ = solve.solve_graph(i, j, delta, w, n)
        A = np.zeros((len(i), n))
        A[np.arange(len(i)), i], A[np.arange(len(i)), j] = 1, -1
        want = np.linalg.lstsq(A * w[:, None], delta * w[:, None], rcond=None)[0]
        assert np.allclose(got, want - want.mean(0), atol=1e-8 * max(1, np.abs(want).max()))


def test_reconcile_at_seams(spark):
    """Every section comes back; within a chunk steps are the planted ones, and at a seam the jump is that of the two chunks' means."""
    at = lambda z: float(z * z % 11)
    rows = [(v, z, k, at(z + k) - at(z), 0.0, 1.0) for v in (0, 1) for z in range(50) for k in (-2, -1, 1, 2) if 0 <= z + k < 50]
    got = {(r.vertex, r.z): r.x for r in solve.reconcile(spark.createDataFrame(rows, "vertex long, z long, k long, dx double, dy double, w double"), 10, 4).collect()}
    assert sorted(got) == [(v, z) for v in (0, 1) for z in range(50)]
    mean = lambda c: np.mean([at(z) for z in range(max(0, 10 * c - 4), min(50, 10 * c + 14))])
    for v in (0, 1):
        for z in range(49):
            seam = mean(z // 10) - mean((z + 1) // 10)
            assert got[v, z + 1] - got[v, z] == pytest.approx(at(z + 1) - at(z) + seam, abs=1e-8)


def test_moving_average_is_mirrored(spark):
    from seriata.operators.windows import moving_average

    r = random.Random(3)
    series = {k: [float(r.randrange(100)) for _ in range(n)] for k, n in (("a", 300), ("b", 5), ("c", 1), ("d", 21))}
    rows = [(k, 7 * i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    out = moving_average(spark.createDataFrame(rows, "k string, z long, v double"), "k", "z", "v", 10, block=32)
    got = {(x.k, x.z): x["mean"] for x in out.collect()}
    assert len(got) == len(rows) and out.columns == ["k", "z", "v", "mean"]
    for k, vs in series.items():
        n = len(vs)
        for i in range(n):
            q = [p % (2 * n) for p in range(i - 10, i + 11)]
            assert got[k, 7 * i] == pytest.approx(np.mean([vs[x] if x < n else vs[2 * n - 1 - x] for x in q]))


def test_components_and_trees(spark):
    r = random.Random(2)
    nodes = list(range(30))
    edges = [(a, b, float(r.randrange(1000))) for a, b in itertools.combinations(nodes, 2) if a % 3 == b % 3 and r.random() < 0.3]
    n = spark.createDataFrame([(i,) for i in nodes], "node long")
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for a, b, w in sorted(edges, key=lambda t: (t[2], t[0], t[1])):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            total += w
    assert {r.node: r.component for r in graph.components(n, e).collect()} == {i: find(i) for i in nodes}
    tree = graph.spanning_tree(n, e).collect()
    assert sum(r.w for r in tree) == total and len(tree) == 30 - len({find(i) for i in nodes})


def test_path_is_no_longer_than_greedy():
    rng = np.random.default_rng(5)
    p = rng.random((11, 2))
    cost = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    path = order.shortest_path(cost)
    length = lambda q: sum(cost[a, b] for a, b in zip(q, q[1:]))
    assert sorted(path) == list(range(11))
    for s in range(11):
        left, q = set(range(11)) - {s}, [s]
        while left:
            q.append(min(left, key=lambda k: cost[q[-1], k]))
            left.discard(q[-1])
        assert length(path) <= length(q) + 1e-9


def test_fits_recover_planted_maps(spark):
    rng = np.random.default_rng(7)
    s = rng.random((40, 2)) * 100
    m = np.array([[0.9, -0.3, 12], [0.2, 1.1, -5]])
    t = s @ m[:, :2].T + m[:, 2]
    t[::5] += rng.random((8, 2)) * 80 + 20
    df = spark.createDataFrame([("k", *map(float, (*a, *b))) for a, b in zip(s, t)], "k string, sx double, sy double, tx double, ty double")
    r = fit.ransac_affine(df, ["k"], 0.5).first()
    assert r.inliers == 32 and np.allclose([r.a, r.b, r.tx, r.c, r.d, r.ty], m.ravel())
    assert fit.ransac_affine(df, ["k"], 0.5).first() == r
    a = fit.affine(df.where("tx = tx"), ["k"]).first()
    want = np.linalg.lstsq(np.column_stack([s, np.ones(40)]), t, rcond=None)[0].T
    assert np.allclose([a.a, a.b, a.tx, a.c, a.d, a.ty], want.ravel())
    few = df.limit(2)
    assert fit.ransac_affine(few, ["k"], 0.5).first().a is None and fit.affine(few, ["k"]).first().a is None


def test_moving_least_squares_is_rigid(spark):
    rng = np.random.default_rng(9)
    c, s = np.cos(0.3), np.sin(0.3)
    p = rng.random((20, 2)) * 10
    q = p @ np.array([[c, s], [-s, c]]) + [3, -1]
    rows = [(0, 4.2, 5.1, *map(float, (*a, *b))) for a, b in zip(p, q)] + [(1, float(p[0, 0]), float(p[0, 1]), *map(float, (*a, *b))) for a, b in zip(p, q)]
    got = {r.id: (r.u, r.v) for r in interp.moving_least_squares(spark.createDataFrame(rows, "id long, x double, y double, px double, py double, qx double, qy double"), []).collect()}
    assert got[0] == pytest.approx((c * 4.2 - s * 5.1 + 3, s * 4.2 + c * 5.1 - 1)) and got[1] == pytest.approx(tuple(q[0]))


def test_normxcorr_against_sums():
    rng = np.random.default_rng(11)
    t, x = rng.random((4, 5)), rng.random((9, 8))
    c = image.normxcorr(t, x)
    for dy in range(6):
        for dx in range(4):
            w = x[dy : dy + 4, dx : dx + 5]
            want = ((w - w.mean()) * (t - t.mean())).sum() / np.sqrt(((w - w.mean()) ** 2).sum() * ((t - t.mean()) ** 2).sum())
            assert c[dy + 3, dx + 4] == pytest.approx(want)
    assert np.allclose(image.normxcorr(np.ones((3, 3)), x), 0)


def test_block_ranges_cover():
    for n, k in ((10, 3), (7, 7), (3, 5), (100, 1)):
        r = G.block_ranges(n, k)
        assert r[0][1] == 0 and r[-1][2] == n and all(a[2] == b[1] for a, b in zip(r, r[1:]))
    r = G.block_ranges(10, 3, 2)
    assert [x[1:] for x in r] == [(0, 6), (2, 9), (5, 10)]


def test_hex_grid_is_three_colourable(spark):
    g = G.hex_grid(spark, 5, 6)
    assert sorted(r.grid_id for r in g.collect()) == list(range(30))
    near = g.where("grid_id = 0").first()
    assert g.agg(F.min(F.col("x") ** 2 + F.col("y") ** 2)).first()[0] == pytest.approx(near.x**2 + near.y**2)
