import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seriata.llm import fingerprints as P


def edited(text, after):
    m = len(text) // 2
    return text[: len(text) - m] + after[:m]


WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew quaint potions beneath tall cedar trees and two old owls keep watch".split()
TEXTS = {
    0: " ".join(WORDS), 1: " ".join(WORDS[::-1]), 5: "", 6: None, 300: "é" * 101, 301: " ".join(WORDS), 70_000: "x y", 70_001: "one", 300_000: " ".join(WORDS * 3),
    -4: "negative ids come first in order", 10**15: "far away ends the table, 日本語 too",
}


def test_next_and_edited(docs_of):
    rows = P.fingerprints(docs_of(list(TEXTS.items()))).collect()
    ids = sorted(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert sorted(by) == ids and len(rows) == len(ids)
    for k, i in enumerate(ids):
        text, after = TEXTS[i] or "", TEXTS[ids[(k + 1) % len(ids)]] or ""
        r = by[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited(text, after).encode()).hexdigest(), i
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[0].fingerprint == by[301].fingerprint != by[1].fingerprint and by[5].fingerprint == by[6].fingerprint


def test_ties_nulls_and_no_rows(docs_of):
    rows = [(3, "b"), (3, "a"), (3, "a"), (None, "n"), (9, "z")]
    got = sorted((str(r.doc_id), r.edited_sha256) for r in P.fingerprints(docs_of(rows)).collect())
    order = [(None, "n"), (3, "a"), (3, "a"), (3, "b"), (9, "z")]
    want = sorted((str(i), hashlib.sha256(edited(t, order[(k + 1) % 5][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert got == want
    assert P.fingerprints(docs_of([])).count() == 0
    assert P.fingerprints(docs_of([(4, "alone here")])).first().edited_sha256 == hashlib.sha256(b"alonealone").hexdigest()


def test_ids_far_apart_and_many_ranges(docs_of):
    r = random.Random(9)
    rows = [(r.randrange(-(2**62), 2**62), f"text {i} " * r.randrange(0, 9)) for i in range(400)]
    order = sorted(rows)
    want = {i: hashlib.sha256(edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, (i, t) in enumerate(order)}
    assert {x.doc_id: x.edited_sha256 for x in P.fingerprints(docs_of(rows)).collect()} == want


def brute_syncmers(text, K=P.K, S=P.S):
    """(place, k-mer) of every closed syncmer, given the order that a hash of inner substrings makes."""
    hashes = {}

    def of(spark):
        inner = sorted({text[i : i + S] for i in range(len(text) - S + 1)})
        rows = spark.createDataFrame([(x,) for x in inner], "x string").select("x", F.xxhash64(F.encode("x", "UTF-32")).alias("h")).collect() if inner else []
        hashes.update({r.x: r.h for r in rows})
        out = []
        for i in range(len(text) - K + 1):
            v = [hashes[text[j : j + S]] for j in range(i, i + K - S + 1)]
            if min(v) in (v[0], v[-1]):
                out.append((i, text[i : i + K]))
        return out

    return of


def test_anchors_are_the_closed_syncmers(spark, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("abé日 ") for _ in range(n)) for n in (0, 1, P.S, P.K - 1, P.K, P.K + 1, 60, 300, 1000)] + ["a" * 200, "😀🙂" * 40]
    for block in (P.BLOCK, 37):  # blocks change nothing
        monkeypatch.setattr(P, "BLOCK", block)
        got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.syncmers(F.col("t")).alias("f")).orderBy("i").collect()
        for t, row in zip(texts, got):
            want = brute_syncmers(t)(spark)
            assert sorted(x & P._PLACE for x in row.f) == [i for i, _ in want]
            by_hash = {}
            for x in row.f:
                i = x & P._PLACE
                assert by_hash.setdefault(x >> P.PLACE_BITS, t[i : i + P.K]) == t[i : i + P.K]


def positional(a, b):
    """The likeness of two lists of anchors, pair by pair."""
    x, y = ({(v % 2**64) >> P.PLACE_BITS: v & P._PLACE for v in p} for p in (a, b))
    by = [y[h] - x[h] for h in sorted(x.keys() & y.keys(), key=lambda h: (x[h], y[h] - x[h]))]
    if not by:
        return 0.0
    n = Counter(by)
    usual = min(n, key=lambda d: (-n[d], d))
    fits = sum(d == usual or i > 0 and by[i - 1] == d or i + 1 < len(by) and by[i + 1] == d for i, d in enumerate(by))
    return fits / (len(x) + len(y) - fits)


def test_edited_and_next_against_whole_texts(spark, docs_of):
    """The anchors put together from two texts are those of the edited text, and the likeness is the brute-force one."""
    r = random.Random(6)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, base[r.randrange(0, 200) : r.randrange(0, 3000)] + "".join(r.choice("xyz ") for _ in range(r.randrange(0, 80)))) for i in range(40)]
    rows += [(50, ""), (51, None), (52, "ab"), (53, base), (54, base)]
    texts = [t or "" for _, t in rows]
    new = [edited(t, texts[(k + 1) % len(texts)]) for k, t in enumerate(texts)]
    of = lambda some: [x.a for x in spark.createDataFrame(list(enumerate(some)), "i int, t string").select("i", P.anchors_of(F.col("t")).alias("a")).orderBy("i").collect()]
    a, b = of(texts), of(new)
    got = {x.doc_id: x for x in P.fingerprints(docs_of(rows)).collect()}
    show = lambda p: "".join(f"{v % 2**64:016X}" for v in p[: P.SIZE])
    for k, (i, _) in enumerate(rows):
        assert got[i].fingerprint == show(a[k]) and got[i].edited_fingerprint == show(b[k])
        assert got[i].near_edited == pytest.approx(positional(a[k], b[k])) and got[i].near_next == pytest.approx(positional(a[k], a[(k + 1) % len(a)]))
    assert got[53].near_next == 1 and got[53].fingerprint == got[54].fingerprint




def test_anchors_do_not_depend_on_context(spark):
    many = " ".join(f"w{(i * 7919) % 1009}" for i in range(300))
    a, b = ([*x.a] for x in spark.createDataFrame([(0, many), (1, "new words here " + many)], "i int, t string").select("i", P.anchors_of(F.col("t")).alias("a")).orderBy("i").collect())
    places = lambda p: {v >> P.PLACE_BITS: v & P._PLACE for v in p}
    x, y = places(a), places(b)
    common = x.keys() & y.keys()
    assert len(common) >= 0.9 * len(x) and {y[h] - x[h] for h in common} == {15}


def compared(df):
    a, b, by = F.col("a"), F.col("b"), F.col("moves")
    return df.withColumn("moves", P.moves(a, b)).select("a", "b", P.likeness(by, a, b).alias("like"), P.shift(by).alias("by"))


def test_likeness_and_shift(spark):
    many = " ".join(f"w{(i * 7919) % 1009}" for i in range(120))
    rows = [(many, many), (many, "x y " + many), (many, "nothing of it is there, whatever is said")]
    df = spark.createDataFrame(rows, "a string, b string").select(P.anchors_of(F.col("a")).alias("a"), P.anchors_of(F.col("b")).alias("b"))
    got = [(x.like, x.by) for x in compared(df).collect()]
    assert got[0] == (1, 0) and 0.85 < got[1][0] <= 1 and got[1][1] == 4 and got[2] == (0, None)


def test_long_texts_are_compared_whole(spark, docs_of):
    """A passage that two long texts share is found, and the likeness counts all anchors."""
    passage = " ".join(f"p{i}" for i in range(100))
    a, b = (" ".join(f"{x}{i}" for i in range(k)) + f" {passage} " + " ".join(f"{x}{i}" for i in range(k, 30_000)) for x, k in (("a", 3000), ("b", 5000)))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(P.anchors_of(F.col("a")).alias("a"), P.anchors_of(F.col("b")).alias("b"))
    r = compared(df).first()
    like = positional(r.a, r.b)
    assert len(r.a) > 8000 and like > 0 and r.like == pytest.approx(like) and r.by == b.index(passage) - a.index(passage)
    got = {x.doc_id: x.near_next for x in P.fingerprints(docs_of([(1, a), (2, b)])).collect()}
    assert got[1] == pytest.approx(r.like)


def test_syncmers_need_no_passes_over_whole_arrays(spark):
    """Each number of places beside a step's, with many equal values; places are chosen step by step."""
    assert "zip_with" not in str(P.syncmers(F.col("t"))) and "slice" not in str(P.syncmers(F.col("t")))
    r = random.Random(11)
    texts = ["".join(r.choice("ab") for _ in range(n)) for n in range(P.K, P.K + 70)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.syncmers(F.col("t")).alias("f")).collect()
    for row in got:
        assert [x & P._PLACE for x in row.f] == [i for i, _ in brute_syncmers(texts[row.i])(spark)]
