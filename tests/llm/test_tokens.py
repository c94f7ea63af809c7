import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seriata.llm.packing import best_fit_plan, pack
from seriata.llm.token_files import pack_ids, token_files, unpack_ids
from seriata.llm.tokens import Encoder, vocabulary

ODD = [
    "a\n  b", "  x", " a b ", "a   b\t c", "<|endoftext|> hi", "", None, "a \n b", "x  y", "it's  ok, isn't it?", "\n", "é è  z", " ",
    "word.\nWord, and | or.\n\nNext.\n", "日本語 テキスト", "x" * 5000, "12 345,6 7", "a  b", "a\u0085 \u0085b", "tab\t\tx", "Ärger, über: alles!",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary())
    return lambda x, end: [*t.encode(x or "", add_special_tokens=False).ids, end]


def test_encoder_is_the_tokenizer(plain):
    e = Encoder(vocabulary(), cache_bytes=2000)
    for texts in (ODD, ODD[::-1], [], [None]):
        ids, counts = e.encode(pa.array(texts, pa.string()))
        at = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(x, 0)[:-1] for x in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 8, 13, 100])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    ends, payload = pack_ids(ids, kind, block=10)
    assert unpack_ids(ends, payload, n, kind, block=10).tolist() == ids.tolist()


def test_token_files(docs_of, plain):
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD)] + [(5, ODD[0]), (5, ODD[0])]
    for how in ({}, {"kind": "bit", "block": 7, "chunk": 16}):
        got = token_files(docs_of(rows), **how).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
        start = 0
        texts = defaultdict(set)
        for i, t in rows:
            ids = plain(t, 0)
            texts[i].add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        for r in got:
            assert r.start == start and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
            start += r.n_tokens
    assert token_files(docs_of([])).count() == 0


def _one_by_one(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((r, i) for i, r in [*enumerate(room), (len(room), size)] if r >= n)[1] if any(r >= n for r in room) else len(room)
        room += [size] * (fit == len(room))
        room[fit] -= n
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(8, 60))
    counts = {int(k): int(rng.integers(0, 30)) for k in rng.integers(1, size + 1, 12)}
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in best_fit_plan(counts, size):
        for k in range(n):
            used[first + k].append((offset, length))
            ranks[length].append(rank + k)
    assert all(sorted(ranks[k]) == list(range(n)) for k, n in counts.items() if n)
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    room = []
    assert len(used) == _one_by_one([k for k, n in counts.items() for _ in range(n)], size) if sum(counts.values()) else not room


def test_pack(docs_of, plain):
    rows = [(i, t) for i, t in enumerate(ODD * 4)] + [(3, ODD[3])]
    got = pack(docs_of(rows), max_tokens=64, keep_ids=True).collect()
    whole, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
    for i, t in rows:
        if i != 3:
            ids = plain(t, 2)
            parts = sorted(whole[i], key=lambda r: r.piece)
            assert [x for r in parts for x in r.ids] == ids and all(r.length == 64 for r in parts[1:])
            assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
    for rs in seqs.values():
        end = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64
    assert pack(docs_of([])).count() == 0


def test_marks_and_digits_are_words():
    """Words with marks or digits behind them need no encoding beside the words'; ids are those of the whole texts."""
    rng = random.Random(11)
    draw = lambda some: "".join(rng.choice(some) for _ in range(rng.randrange(1, 4)))
    marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    plain = [" ".join(draw(("ab", "word", "Zé", "7", "2026", draw(marks), "b\nx")) for _ in range(40)) for _ in range(60)]
    odd = [" ".join(draw(("we", "'s", "'ll", "'", "%'", "٣", "²", "a", "1", "　", "#", "\n")) for _ in range(40)) for _ in range(60)]
    whole = Tokenizer.from_file(vocabulary())
    encoder = Encoder(vocabulary())
    for texts in (odd, plain):
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        if texts is plain:
            encoder.tokenizer = None  # only words are left to do
        ids, counts = encoder.encode(pa.array(texts))
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
