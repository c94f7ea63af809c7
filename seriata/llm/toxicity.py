"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed word embedding and the embeddings of its character
5-grams, each beside a smoothed log-odds of the training labels. The network
reads windows of words, pools its states by attention and scores the window; a
text is as toxic as its most toxic window. Windows of WINDOW words overlap: one
begins every STRIDE words of the whole text, and all of them are scored. Each
run of up to WINDOW - STRIDE + 1 words lies whole in one of them.

It is fitted on a bounded sample of labelled rows: at most FIT_ROWS rows and
about FIT_CHARS characters, the rows with the smallest hashes of their ids.
"""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lean, mix64, ragged, slices, trim

FIT_ROWS = 4000
FIT_CHARS = 16_000_000
WINDOW, STRIDE = 32, 16
GRAM = 5
WORD_BITS, CHAR_BITS = 17, 18
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 4, 4, 8, 4
#: Lower-case ASCII letters, digits and all bytes of other code points belong to words.
_SPLIT = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in LOWER)


# ---------------------------------------------------------------- words
@dataclass
class Words:
    """Texts as runs of codes of distinct words; code 0 is no word."""

    codes: np.ndarray
    bounds: np.ndarray
    word_rows: np.ndarray
    gram_rows: np.ndarray
    gram_starts: np.ndarray


def read_words(texts: pa.Array) -> Words:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4) if n else np.zeros(1, np.int32)
    raw = (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if n else b""
    offsets = offsets - offsets[0]
    clean = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(raw.translate(_SPLIT))])
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clean.view(pa.string())))
    coded = lists.values.dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy().astype(np.int32) + 1
    if "" in names:
        codes[codes == names.index("") + 1] = 0
    held = [b""] + [x.encode() for x in names]
    # all n-grams at once, of each word between spaces: as many as even a short word's n-gram can reach
    gap = b" " * GRAM
    data = np.frombuffer(b" " + gap.join(held) + gap, np.uint8).astype(np.uint64)
    size = np.array([len(x) for x in held], np.int64)
    start = np.cumsum(size + GRAM) - size - GRAM
    rolled = np.zeros(len(data) - GRAM, np.uint64)
    for k in range(GRAM):
        rolled = rolled * np.uint64(0x100000001B3) + data[k : len(data) - GRAM + k]
    grams = np.maximum(size + 2 - GRAM + 1, 1)
    gram_rows = (mix64(rolled[ragged(start, grams)]) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
    # A word's own hash: its bytes, each mixed with its place, all of them however long the word is.
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(place.astype(np.uint64) << np.uint64(8) | data[ragged(start + 1, size)]), dtype=np.uint64)])
    word = summed[ends] - summed[ends - size] + size.astype(np.uint64)
    return Words(codes, lists.offsets.to_numpy().astype(np.int64), (mix64(word) >> np.uint64(64 - WORD_BITS)).astype(np.int64), gram_rows, np.cumsum(grams) - grams)


def _only(w: Words, used: np.ndarray) -> Words:
    """The same for some of the distinct words; code 0 stays first."""
    used = used if used[0] == 0 else np.append(0, used)
    size = np.diff(np.append(w.gram_starts, len(w.gram_rows)))[used]
    return Words(w.codes, w.bounds, w.word_rows[used], w.gram_rows[ragged(w.gram_starts[used], size)], np.cumsum(size) - size)


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of every window (0 where it is longer than its text), and the text of each; a text without words has one empty window."""
    count = np.diff(words.bounds)
    each = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(count)), each)
    first = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    codes = np.zeros((len(text), WINDOW), np.int32)
    begin, end = words.bounds[:-1][text] + first, words.bounds[1:][text]
    for k in range(WINDOW):
        inside = begin + k < end
        codes[inside, k] = words.codes[begin[inside] + k]
    return codes, text


# ---------------------------------------------------------------- network
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Model:
    """Parameters p: tables of words and n-grams, two gated recurrent units, attention, output."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        d = 2 + WORD_DIM + CHAR_DIM
        flat = lambda *s, by=0.3: (r.standard_normal(s) * by).astype(np.float32)
        p = {"word": flat(1 << WORD_BITS, WORD_DIM, by=0.05), "gram": flat(1 << CHAR_BITS, CHAR_DIM, by=0.05), "word_odds": np.zeros(1 << WORD_BITS, np.float32), "gram_odds": np.zeros(1 << CHAR_BITS, np.float32)}
        for way in "fb":
            p |= {f"W{way}": flat(d, 3 * HIDDEN), f"U{way}": flat(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(p | {"A": flat(2 * HIDDEN, ATTEND), "a": flat(ATTEND), "o": flat(2 * HIDDEN), "bias": np.zeros(1, np.float32)})

    def inputs(self, w: Words) -> np.ndarray:
        """A row per distinct word; the mean of its n-grams' embeddings and the largest of their log-odds."""
        p = self.p
        size = np.diff(np.append(w.gram_starts, len(w.gram_rows)))[:, None]
        x = np.concatenate([p["word_odds"][w.word_rows][:, None], np.maximum.reduceat(p["gram_odds"][w.gram_rows], w.gram_starts)[:, None], p["word"][w.word_rows], np.add.reduceat(p["gram"][w.gram_rows], w.gram_starts, axis=0) / size], 1).astype(np.float32)
        x[0] = 0
        return x

    def logits(self, x: np.ndarray, codes: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """A logit per window. x: inputs of words by code."""
        p, n = self.p, len(codes)
        there = (codes > 0).astype(np.float32)
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        for k, way in enumerate("fb"):
            given = x @ p[f"W{way}"] + p[f"c{way}"]
            h, U = np.zeros((n, HIDDEN), np.float32), p[f"U{way}"]
            for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                g, u = given[codes[:, t]], h @ U
                zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                m = there[:, t : t + 1]
                if tape is not None:
                    tape[way, t] = (h, z, r, c, u[:, 2 * HIDDEN :], m)
                h = h + m * (1 - z) * (c - h)
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        q = np.tanh(states @ p["A"])
        e = q @ p["a"] + (there.T - 1) * 30
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        if tape is not None:
            tape["pool"] = (states, q, weight, pooled)
        return pooled @ p["o"] + p["bias"][0]

    def gradients(self, x: np.ndarray, w: Words, codes: np.ndarray, toxic: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the windows and its gradients."""
        p, n, tape = self.p, len(codes), {}
        s = _sigmoid(self.logits(x, codes, tape))
        loss = float(-np.mean(np.log(np.where(toxic > 0, s, 1 - s) + 1e-7)))
        d = ((s - toxic) / n).astype(np.float32)
        states, q, weight, pooled = tape["pool"]
        g = {"o": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["o"]
        dstates = weight[:, :, None] * dpool
        dw = (states * dpool).sum(2)
        de = weight * (dw - (weight * dw).sum(0))
        dq = de[:, :, None] * p["a"] * (1 - q * q)
        g["a"] = np.einsum("tn,tna->a", de, q)
        g["A"] = np.einsum("tnh,tna->ha", states, dq)
        dstates = dstates + dq @ p["A"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            U, W = p[f"U{way}"], p[f"W{way}"]
            gU, dgiven, dh = np.zeros_like(U), np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1) if way == "f" else range(WINDOW):
                h, z, r, c, un, m = tape[way, t]
                dh = dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dh * m * (1 - z) * (1 - c * c)
                dz = dh * m * (h - c) * z * (1 - z)
                dr = dc * un * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(dgiven, codes[:, t], np.concatenate([dz, dr, dc], 1))
                gU += h.T @ du
                dh = dh * (1 - m * (1 - z)) + du @ U.T
            g[f"U{way}"], g[f"W{way}"], g[f"c{way}"] = gU, x.T @ dgiven, dgiven.sum(0)
            dx += dgiven @ W.T
        dx[:, 2:] *= x[:, 2:].any(1, keepdims=True)
        dx[0] = 0
        size = np.diff(np.append(w.gram_starts, len(w.gram_rows)))
        used = np.unique(codes)
        g["word"] = (w.word_rows[used], dx[used, 2 : 2 + WORD_DIM])
        grams = ragged(w.gram_starts[used], size[used])
        g["gram"] = (w.gram_rows[grams], np.repeat(dx[used, 2 + WORD_DIM :] / size[used][:, None], size[used], axis=0))
        return loss, g

    def score(self, texts: pa.Array, most: int = 8192) -> np.ndarray:
        """The probability of each text's most toxic window."""
        if not len(texts):
            return np.zeros(0)
        w = read_words(texts)
        x = self.inputs(w)
        codes, text = windows(w)
        found = np.concatenate([self.logits(x, codes[a : a + most]) for a in range(0, len(codes), most)])
        best = np.maximum.reduceat(found, np.flatnonzero(np.diff(text, prepend=-1)))
        return _sigmoid(best.astype(np.float64))


def _count(n: np.ndarray, rows: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> None:
    """Adds to n[label, row] the number of texts that a hashed feature stands in."""
    pairs = np.unique(text.astype(np.uint64) << np.uint64(32) | rows.astype(np.uint64))
    label = toxic[(pairs >> np.uint64(32)).astype(np.int64)]
    for k in (0, 1):
        n[k] += np.bincount((pairs[label == k] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=n.shape[1])


def _odds(n: np.ndarray, share: float, weight: float = 5.0) -> np.ndarray:
    """Smoothed log-odds of features, against what the numbers of toxic and other texts would give."""
    odds = np.log((n[1] + weight * share) / (n[0] + weight * (1 - share))) - np.log(share / (1 - share))
    return (odds * np.abs(odds) / 4).astype(np.float32)  # squared, so that much weak evidence does not add up to strong evidence


def train(texts: list[str | None], toxic: list[int], rounds: int = 4, seed: int = 7) -> Model:
    """Fits the network: windows of texts that are not toxic, against the most toxic window of each toxic text as the model sees it so far."""
    model, y = Model.new(seed), np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        model.p["bias"][0] = 4.0 if len(y) and y.max() > 0 else -4.0
        model.p["o"][:] = 0
        return model
    texts, y = [*texts, ""], np.append(y, np.float32(0))  # nothing is not toxic
    w = read_words(pa.array(texts, pa.string()))
    codes, text = windows(w)
    of_word = np.repeat(np.arange(len(y)), np.diff(w.bounds))
    real = w.codes > 0
    pairs = np.unique(of_word[real] * np.int64(len(w.word_rows)) + w.codes[real])  # distinct words of each text
    doc, word = pairs // len(w.word_rows), pairs % len(w.word_rows)
    size = np.diff(np.append(w.gram_starts, len(w.gram_rows)))
    # Log-odds of a text's own label would tell it apart: each half of the texts is read with those of the other half.
    half = mix64(np.arange(len(y), dtype=np.uint64) + np.uint64(seed)).astype(np.int64) & 1

    label, cuts = y.astype(np.int64), np.searchsorted(doc, np.arange(0, len(y) + 100, 100))

    def odds(of: np.ndarray) -> dict[str, np.ndarray]:
        n_word, n_gram = np.zeros((2, 1 << WORD_BITS)), np.zeros((2, 1 << CHAR_BITS))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # a hundred texts at a time
            at = np.flatnonzero(of[doc[a:b]]) + a
            _count(n_word, w.word_rows[word[at]], doc[at], label)
            _count(n_gram, w.gram_rows[ragged(w.gram_starts[word[at]], size[word[at]])], np.repeat(doc[at], size[word[at]]), label)
        share = (label[of].sum() + 1) / (of.sum() + 2)
        return {"word_odds": _odds(n_word, share), "gram_odds": _odds(n_gram, share)}

    other = [odds(half == 1), odds(half == 0)]
    r = np.random.default_rng(seed)

    def per_half(score) -> np.ndarray:
        out = np.zeros(len(codes), np.float32)
        for k in (0, 1):
            model.p |= other[k]
            x, at = model.inputs(w), np.flatnonzero(half[text] == k)
            for a in range(0, len(at), 8192):
                out[at[a : a + 8192]] = score(x, codes[at[a : a + 8192]])
        return out

    rank = per_half(lambda x, c: x[:, :2].sum(1)[c].max(1))
    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}, 0
    clean = np.flatnonzero(y[text] == 0)
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    for turn in range(rounds):
        order = np.lexsort((-rank, text))
        top = order[starts]  # the best window of each text
        good = top[y[text[top]] == 1]
        hard = clean[np.argsort(-rank[clean], kind="stable")[: 2 * len(good) + 500]]
        bad = np.concatenate([hard, r.choice(clean, min(len(clean), 2 * len(good) + 1500), replace=False)])
        chosen = np.concatenate([good, bad])
        for _ in range(5):
            r.shuffle(chosen)
            for k, part in ((k, part) for k in (0, 1) for part in np.array_split(chosen[half[text[chosen]] == k], len(chosen) // 1024 + 1)):
                step += 1
                model.p |= other[k]
                # Clean windows also come as one word said over and over; and half of the words come without their embeddings.
                again = r.permutation(codes[part][y[text[part]] == 0].ravel())[: len(part) // 3, None].repeat(WINDOW, 1)
                seen = np.concatenate([codes[part], again])
                used, own = np.unique(seen, return_inverse=True)
                near = _only(w, used)
                x = model.inputs(near)
                x[:, 2:] *= (r.random(len(x)) < 0.5)[:, None]
                _, g = model.gradients(x, near, own.reshape(seen.shape) + (used[0] > 0), np.append(y[text[part]], np.zeros(len(again), np.float32)))
                _adam(model.p, g, moments, step)
        rank = per_half(model.logits)
    model.p |= odds(half >= 0)
    best = np.maximum.reduceat(rank, starts)
    cuts = np.sort(best)
    order = np.argsort(best, kind="stable")
    wrong = (y == 0).sum() + np.concatenate([[0], np.cumsum(np.where(y[order] > 0, 1, -1))])  # errors if the k lowest are called clean
    k = np.flatnonzero(wrong == wrong.min())
    k = int(k[len(k) // 2])
    model.p["bias"][0] -= (cuts[max(k - 1, 0)] + cuts[min(k, len(cuts) - 1)]) / 2
    return model


def _adam(p: dict, g: dict, moments: dict, step: int, rate: float = 0.01) -> None:
    for name, d in g.items():
        m, v = moments[name]
        if isinstance(d, tuple):  # rows of a table
            rows, back = np.unique(d[0], return_inverse=True)
            total = np.zeros((len(rows), d[1].shape[1]), np.float32)
            np.add.at(total, back, d[1])
        else:
            rows, total = slice(None), d
        m[rows] = 0.9 * m[rows] + 0.1 * total
        v[rows] = 0.99 * v[rows] + 0.01 * total * total
        p[name][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-8)


# ---------------------------------------------------------------- tables
def held_out(doc_id):
    """Column: whether a row's label may not be learnt from. A null doc_id is never learnt from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """The network fitted on at most rows labelled documents of at most chars characters, those with the smallest hashes of their ids.

    Of rows that share a doc_id the smallest text counts, of labels the larger. A
    text that would pass the limit of characters is left out and the next ones
    are still taken. With no labelled text left nothing is called toxic, and a
    warning says so.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # at most rows rows
    sizes = sorted((r.doc_id, r.size) for r in sample.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")).collect())
    order = np.argsort(mix64(np.array([d for d, _ in sizes], np.int64).view(np.uint64)), kind="stable") if sizes else []
    keep, total = [], 0
    for i in order:
        if total + sizes[i][1] <= chars:
            total += sizes[i][1]
            keep.append(sizes[i][0])
    if not keep:
        warnings.warn("no labelled text to fit on: nothing will be called toxic", stacklevel=2)
        return train([], [])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        got = sorted((int(d), t or "", int(y)) for d, t, y in zip(pdf.doc_id, pdf.text, pdf.toxic, strict=True))
        out = io.BytesIO()
        np.savez(out, **train([t for _, t, _ in got], [y for _, _, y in got]).p)
        trim()
        return pd.DataFrame({"model": [out.getvalue()]})

    # The sample is bounded, so one task fits the network, and the driver only gets its parameters.
    chosen = sample.where(F.col("doc_id").isin(keep)).select(F.lit(1).alias("one"), "doc_id", "text", "toxic")
    raw = chosen.groupBy("one").applyInPandas(learn, "model binary").first().model
    with np.load(io.BytesIO(bytes(raw))) as found:
        return Model(dict(found))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of docs.

    Null and empty texts have one empty window and so one score; repeated rows
    get equal scores; a null doc_id stays null; very long texts are read whole,
    one at a time; without rows there are none in the result; only text is read.
    """
    box = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.p.items()})  # a few MB, whatever the corpus

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Model(box.value)
        for batch in slices(batches):
            score = net.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(scan), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns, whose text the model does not call toxic."""
    box = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.p.items()})
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Model(box.value)
        for batch in slices(batches, at):
            yield batch.filter(pa.array(net.score(batch.column(at)) < 0.5))

    return docs.mapInArrow(lean(scan), docs.schema)
