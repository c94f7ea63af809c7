import random
import re
from collections import Counter

import pytest

from seriata.llm.decontaminate import contaminated


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(w, k=5):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def every_window(docs, items, least=0.8):
    """(doc_id, item_id): (-similarity, start) of the best of all item-sized windows, at every start."""
    best = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            b = words(x)
            k = min(5, len(b))
            if d is None or i is None or not b or len(w) < k or not set(shingles(w, k)) & set(shingles(b, k)):
                continue
            v = shingles(b, k)
            for s in range(max(0, len(w) - len(b)) + 1):
                u = shingles(w[s : s + len(b)], k)
                sim = sum((u & v).values()) / sum((u | v).values())
                if sim >= least:
                    best[d, i] = min(best.get((d, i), (0, 0)), (-sim, s))
    return best


def brute(docs, items):
    return sorted((d, i, s, pytest.approx(-m)) for (d, i), (m, s) in every_window(docs, items).items())


def test_against_brute_force(spark, docs_of):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.randrange(8, 60)))) for i in range(12)]
    items += [(20, "one two three four"), (21, None), (22, "a b a b a b a b a b a b"), (None, items[0][1]), (3, "second text of item three , with words enough")]
    docs = []
    for d in range(120):
        text = [word() for _ in range(r.randrange(0, 50))]
        for _ in range(r.randrange(0, 3)):
            b = words(r.choice(items)[1])
            for _ in range(r.randrange(0, 3)):
                if b:
                    k = r.randrange(len(b))
                    b[k : k + 1] = r.choice([[], [word()], [b[k], word()]])
            at = r.randrange(len(text) + 1)
            text[at:at] = b
        docs.append((d, r.choice([" ", ", ", "\n"]).join(text).upper()))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1]), (202, items[1][1]), (202, "x " + items[2][1]), (203, "a b " * 3000), (204, "say One, two three FOUR again"), (205, "one two three 4")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(tuple(x) for x in contaminated(docs_of(docs), bench).collect())
    assert got == brute(docs, items)
    assert contaminated(docs_of([]), bench).count() == 0 and contaminated(docs_of(docs), bench.limit(0)).count() == 0


def test_parts_in_another_order(spark, docs_of):
    """Every start counts, also where no shared shingle stands at the item's own place."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate((60, 75, 90, 120))]
    docs = []
    for k in range(60):
        b = list(r.choice(items)[1])
        cut = r.randrange(10, len(b) - 10)
        b = b[cut:] + b[:cut]
        for _ in range(r.randrange(0, 2)):
            b[r.randrange(len(b))] = word()
        docs.append((k, " ".join([*(word() for _ in range(r.randrange(0, 30))), *b, *(word() for _ in range(r.randrange(0, 30)))])))
    want = {}
    for d, t in docs:
        w = words(t)
        for i, b in items:
            v = shingles(b)
            sims = [sum((u & v).values()) / sum((u | v).values()) for s in range(max(1, len(w) - len(b) + 1)) for u in [shingles(w[s : s + len(b)])]]
            if max(sims) >= 0.8:
                want[d, i] = max(sims)
    bench = spark.createDataFrame([(i, " ".join(b)) for i, b in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in contaminated(docs_of(docs), bench).collect()}
    assert len(want) > 20 and got == {k: pytest.approx(v) for k, v in want.items()}


def test_fingerprints_within_the_radius_are_all_found():
    """Any two fingerprints at most RADIUS bits apart meet in the index."""
    from seriata.llm import decontaminate as D

    r = random.Random(11)
    edges = [64 * k // D.BLOCKS for k in range(D.BLOCKS + 1)]
    of = lambda x: [(k, x >> a & (1 << b - a) - 1) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    for _ in range(500):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), D.RADIUS):
            y ^= 1 << bit
        filed = {(k, v ^ f) for k, v in of(x) for f in range(1 << edges[k + 1] - edges[k]) if f.bit_count() <= D.FLIPS}
        assert filed & set(of(y))


def test_recall_of_all_item_sized_windows(spark, docs_of):
    """Against every window of every document, for items that were edited to just above and below the threshold."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, [word() for _ in range(r.randrange(15, 60))]) for i in range(40)]
    docs = []
    for k in range(400):
        b = list(r.choice(items)[1])
        for _ in range(r.randrange(0, 3)):
            b[r.randrange(len(b))] = word()
        docs.append((k, " ".join([*(word() for _ in range(r.randrange(0, 20))), *b, *(word() for _ in range(r.randrange(0, 20)))])))
    items = [(i, " ".join(b)) for i, b in items]
    want = every_window(docs, items)
    near = [d for d, (m, _) in want.items() if -m < 0.85]
    got = {(x.doc_id, x.item_id) for x in contaminated(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 150 and len(near) > 10
    assert got <= want.keys() and len(got & set(near)) >= 0.9 * len(near) and len(got) >= 0.99 * len(want)
