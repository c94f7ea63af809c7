import random
import re

import pytest

from seriata.llm.jaccard_join import jaccard_components


def shingles(text, k):
    words = [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, share):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= share * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    shared = [word() for _ in range(40)]
    bases = [[word() for _ in range(r.randrange(20, 200))] for _ in range(4)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.6:  # copies with some words changed, as many as the threshold allows or a few more
            words = list(r.choice(bases))
            for _ in range(r.randrange(0, max(2, len(words) // 40 + 2))):
                words[r.randrange(len(words))] = word()
            if r.random() < 0.3:
                words += [word() for _ in range(r.randrange(0, len(words) // 10 + 1))]
        elif kind < 0.8:
            words = [word() for _ in range(r.randrange(0, 60))] + shared + [word() for _ in range(5)]
        else:
            words = [word().upper() for _ in range(r.randrange(0, 6))]
        rows.append((i * 3, r.choice([" ", "\n", "\t "]).join(words)))
    return [*rows, (1, ""), (4, None), (7, " \n"), (10, "One two"), (13, "one TWO"), (16, "one two three"), (19, "a " * 30_000), (22, "A " * 5)]


@pytest.mark.parametrize("seed,k,share", [(1, 4, 85), (2, 5, 80)])
def test_components_are_exact(docs_of, monkeypatch, seed, k, share):
    import seriata.llm.jaccard_join as J

    monkeypatch.setattr(J, "FREQUENT", 6)
    monkeypatch.setattr(J, "SUBLIST", 8)
    rows = corpus(seed)
    got = sorted(map(tuple, jaccard_components(docs_of(rows), k, share).collect()))
    assert got == brute(rows, k, share)


def test_a_null_id_leads_no_list(docs_of):
    rows = []
    for null_at in range(7):  # each of a group's seven texts is once the one without an id
        words = [f"g{null_at}w{i}" for i in range(60)]
        rows += [(None if k == null_at else null_at * 10 + k, " ".join([*words, f"end{k}"])) for k in range(7)]
    got = sorted(map(tuple, jaccard_components(docs_of(rows)).collect()), key=str)
    want = brute([x for x in rows if x[0] is not None], 4, 85)
    assert len({c for _, _, c in want}) == 7
    assert got == sorted([*want, *[(None, 58, None)] * 7], key=str)


def test_nulls_repeats_and_no_rows(docs_of):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (9, "v w x y z"), (None, "a b c d e"), (3, None), (3, None)]
    got = sorted(map(tuple, jaccard_components(docs_of(rows)).collect()), key=str)
    assert got == sorted([(5, 2, 2), (2, 2, 2), (2, 2, 2), (9, 2, 2), (None, 2, None), (3, 0, 3), (3, 0, 3)], key=str)
    assert jaccard_components(docs_of([])).count() == 0


def test_sets_whose_first_names_clash_are_told_apart(docs_of):
    rows = corpus(3, 60)
    got = sorted(map(tuple, jaccard_components(docs_of(rows), name_bits=3).collect()))
    assert got == brute(rows, 4, 85)


def test_blocks_are_skipped_only_where_nothing_links():
    import numpy as np

    from seriata.llm.jaccard_join import BLOCKS, Lists, _may_link

    r = np.random.default_rng(5)
    size = r.integers(1, 300, 400)
    place = (r.random(400) * size * 0.3).astype(np.int64)
    order = np.lexsort((size, place * BLOCKS // size))
    size, place = size[order], place[order]
    lists = Lists.of(np.zeros(400, np.int64), size, place)
    every = np.arange(400)
    x, y = lists.pairs(every, np.zeros(400, np.int64), np.full(400, len(lists.blocks) - 1), size, place, 85)
    want = {(a, b) for a in range(400) for b in range(400) if _may_link(size[a], place[a], size[b], place[b], 85)}
    assert set(zip(x.tolist(), y.tolist())) == want
    assert len(want) < 400 * 400 / 4
