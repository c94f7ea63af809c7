import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seriata.llm import toxicity as T


def sample(n, seed):
    r = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "st", "ou", "in", "é", "ver"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randrange(5, 120))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words) + 1), r.choice(["blorg", "Zwackt" + word(), "frumpo"]))
        rows.append((" ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = sample(300, 1)
    return T.train([t for t, _ in rows], [y for _, y in rows])


def test_held_out_accuracy(model):
    rows = sample(300, 2)
    s = model.score(pa.array([t for t, _ in rows]))
    assert np.mean((s >= 0.5) == np.array([y for _, y in rows])) > 0.95


def test_scores_do_not_depend_on_the_batch(model):
    texts = [*(t for t, _ in sample(20, 3)), "", None, "blorg " * 5000]
    together = model.score(pa.array(texts, pa.string()))
    alone = np.concatenate([model.score(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and ((together >= 0) & (together <= 1)).all()
    assert T.train(["a b"] * 3, [0, 0, 0]).score(pa.array(["x"]))[0] < 0.5 and T.train([], []).score(pa.array(["x"]))[0] < 0.5


def test_gradients(model):
    w = T.read_words(pa.array(["one two blorg three", "four five"]))
    codes, _ = T.windows(w)
    y = np.array([1, 0], np.float32)
    _, g = model.gradients(model.inputs(w), w, codes, y)
    for name, d in g.items():
        if isinstance(d, tuple):  # rows of a table, some of them more than once
            full = np.zeros_like(model.p[name])
            np.add.at(full, d[0], d[1])
            d = full
        at = np.unravel_index(np.argmax(np.abs(d)), d.shape)
        was, move = model.p[name][at], 1e-2
        losses = []
        for by in (move, -move):
            model.p[name][at] = was + by
            losses.append(model.gradients(model.inputs(w), w, codes, y)[0])
        model.p[name][at] = was
        assert (losses[0] - losses[1]) / (2 * move) == pytest.approx(float(d[at]), rel=0.1, abs=1e-5), name
    assert {"word", "gram", "Wf", "Wb", "Uf", "Ub", "cf", "cb", "A", "a", "o", "bias"} == set(g)


def by_hand(p, x, codes):
    """The logit of one window, word by word."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    words = [x[c].astype(float) for c in codes if c > 0]
    ways = []
    for way in "fb":
        W, U, c = (p[f"{k}{way}"].astype(float) for k in "WUc")
        h, out = np.zeros(T.HIDDEN), []
        for v in words if way == "f" else words[::-1]:
            g, u = v @ W + c, h @ U
            n = T.HIDDEN
            z, r = sig(g[:n] + u[:n]), sig(g[n : 2 * n] + u[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :])
            out.append(h)
        ways.append(out if way == "f" else out[::-1])
    states = np.concatenate([np.array(o) for o in ways], 1)
    e = np.exp(np.tanh(states @ p["A"].astype(float)) @ p["a"].astype(float))
    return (e / e.sum()) @ states @ p["o"].astype(float) + p["bias"][0]


def test_scores_against_a_network_by_hand(model):
    texts = [t for t, _ in sample(30, 6)] + ["one", "blorg blorg"]
    w = T.read_words(pa.array(texts))
    x = model.inputs(w)
    codes, text = T.windows(w)
    best = {}
    for c, k in zip(codes, text):
        best[k] = max(best.get(k, -np.inf), by_hand(model.p, x, c))
    assert np.allclose(model.score(pa.array(texts)), [1 / (1 + np.exp(-best[k])) for k in range(len(texts))], atol=1e-4)


def test_long_words_are_hashed_whole():
    w = T.read_words(pa.array(["a" * 100 + "b", "a" * 100 + "c", "a" * 101, "a" * 300_000 + "b", "a" * 300_000 + "c"]))
    assert len(set(w.word_rows[1:].tolist())) == 5


def test_fit_is_bounded_and_skips_what_is_too_long(spark, docs_of):
    rows = sample(120, 7)
    docs = [(i, t) for i, (t, _) in enumerate(rows)] + [(5, "z " * 40), (5, "a text before the others of its id")] * 50 + [(1000 + k, "word " * 50_000) for k in range(40)]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(1000 + k, 0) for k in range(40)], "doc_id long, toxic int")
    net = T.fit(docs_of(docs), labels, chars=100_000)
    s = net.score(pa.array([t for t, _ in sample(200, 8)]))
    assert np.mean((s >= 0.5) == np.array([y for _, y in sample(200, 8)])) > 0.8
    with pytest.warns(UserWarning):
        none = T.fit(docs_of(docs[:3]), labels.limit(0))
    assert none.score(pa.array(["x"]))[0] < 0.5


def test_windows_cover_every_word():
    w = T.read_words(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 16, 17, 32, 33, 48, 49, 100)]))
    codes, text = T.windows(w)
    for k, n in enumerate((0, 1, 16, 17, 32, 33, 48, 49, 100)):
        assert len(np.unique(codes[(text == k)[:, None] & (codes > 0)])) == n


def test_rows(spark, docs_of):
    rows = [(i, t) for i, (t, _) in enumerate(sample(60, 4))] + [(None, "blorg"), (100, None), (100, None)]
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(sample(60, 4))] + [(3, None, 0), (None, 1, 1)], "doc_id long, toxic int, score int")
    net = T.fit(docs_of(rows), labels, rows=40)
    got = T.score_toxicity(docs_of(rows), net).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert T.score_toxicity(docs_of([]), net).count() == 0
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    assert [r[0] for r in ids.select(T.held_out("doc_id")).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)] + [True]
