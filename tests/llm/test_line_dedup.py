import random

import numpy as np

from pyspark.sql import functions as F

from seriata.llm.line_dedup import CuckooFilter, LineStore, dedup_lines, rewrite_documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or i == min(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some(seed, n=40):
    r = random.Random(seed)
    lines = ["Shared line number one", " SHARED LINE NUMBER ONE\t", "short", "ÉÀ long enough line", "éà long enough line", "", "ten chars!", "nine char"] + [f"line of its own {k}" for k in range(30)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (None, "Shared line number one"), (2, "Shared line number one\nx"), rows[5], (n + 2, "y" * 200_000 + "\nShared line number one")]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def test_dedup(docs_of):
    for seed in range(2):
        assert rows_of(dedup_lines(docs_of(some(seed)))) == brute(some(seed))
    assert rows_of(dedup_lines(docs_of([]))) == []


def test_insert_and_delete_are_reversible(spark, docs_of):
    rows = [x for x in some(3) if x[0] is not None]
    a, b = [x for x in rows if x[0] % 2], [x for x in rows if x[0] % 2 == 0]
    both = LineStore.empty(spark).insert(docs_of(a)).insert(docs_of(b))
    assert rows_of(dedup_lines(docs_of(rows), both)) == brute(rows)
    back = both.delete(docs_of(b))
    assert rows_of(dedup_lines(docs_of(a), back)) == brute(a)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 50_000, dtype=np.uint64))
    f = CuckooFilter.load(CuckooFilter.of(keys).dump())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**64, 50_000, dtype=np.uint64)).mean() < 0.001
    f.delete(keys[:1000])
    assert f.contains(keys[1000:]).all() and f.contains(keys[:1000]).mean() < 0.01


def test_rewritten_documents_keep_columns_of_any_name(docs_of):
    rows = some(1)
    docs = docs_of(rows)
    for name in ("version", "keys", "was_null", "n_lines", "n_dropped", "kept_text", "row", "hi", "shard"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    out = rewrite_documents(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["version"], r["kept_text"], r["n_chars"]) for r in out.collect()), key=str)
    null = {i for i, t in rows if t is None}
    want = [(i, None if i in null else t, None if i is None else f"version{i}", None if i is None else f"kept_text{i}", len(t)) for i, _, _, t in brute(rows)]
    assert got == sorted(want, key=str)
    assert rewrite_documents(docs_of([])).count() == 0
