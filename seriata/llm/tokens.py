"""Token ids of whole texts, each distinct piece of text encoded once per worker.

A byte-level vocabulary never merges across a single space, so a text may be
cut before each such space and the ids of the cuts joined. Texts where a space
stands between other white space, and texts that spell an added token, are
encoded as they are. Every id comes from the tokenizers library.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

#: Bytes of text that are encoded at a time: work space is some twenty times as much.
SLICE = 12 << 20
#: Bytes that an encoder keeps of distinct pieces and words.
CACHE = 96 << 20
VOCABULARY = "byte_bpe_50k.json"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def vocabulary(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
#: What the byte-level pre-tokenizer keeps whole in texts of Latin letters, digits and ASCII marks but the apostrophe, which may begin a contraction.
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on.
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_SPACE = _BYTES[ord(" ")]

#: Bytes that a kept piece takes besides its letters and ids.
ENTRY = 150


class Encoder:
    """Encodes Arrow arrays of texts; what it keeps of distinct pieces (a quarter) and words takes about cache_bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(added.items()), (None, -1))
        self.added = list(added)
        self.cache_bytes, self.held, self.held_words, self.full = cache_bytes, 0, 0, False
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}  # ids of 4 bytes each
        self.known: dict[str, int] = {}
        self.ids, self.used, self.rows = np.zeros(1 << 20, np.uint32), 0, 0
        self.starts, self.counts = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _room(self, ids: int, rows: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + rows > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))

    def _store(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Gives pieces the next rows; as many as there is room for stay known."""
        if not pieces:
            return
        n = self.rows
        self._room(len(ids), len(pieces))
        self.ids[self.used : self.used + len(ids)] = ids
        self.counts[n : n + len(pieces)] = counts
        self.starts[n : n + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.rows += len(pieces)
        if not self.full:
            size = sum(map(len, pieces)) + ENTRY * len(pieces) + 4 * len(ids)
            kept = min(len(pieces), max(0, self.cache_bytes // 4 - self.held) * len(pieces) // size)
            self.full = kept < len(pieces)
            self.known.update(zip(pieces[:kept], range(n, n + kept)))
            self.held += size * kept // len(pieces)

    def _word(self, word: str) -> bytes:
        """Ids of what the pre-tokenizer leaves whole, and is not among the words kept."""
        if word.isascii() and word[1:].isalpha():
            spelled = f"{_SPACE}{word[1:]}" if word[0] == " " else word.translate(_BYTES)
        else:
            spelled = word.encode().decode("latin-1").translate(_BYTES)
        ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if self.held_words < self.cache_bytes * 3 // 4:
            self.held_words += ENTRY + len(word) + len(ids)
            self.words[word] = ids
        return ids

    def _learn(self, pieces: list[str]) -> list[int]:
        """Encodes pieces that hold no added token; returns in which order they have taken rows."""
        plain, flat, other, words = [], [], [], self.words
        for at, piece in enumerate(pieces if self.byte_level else ()):
            found = words.get(piece) if piece != "\n" else None
            if found is None:
                parts = _PLAIN.findall(piece)
                if parts and parts[0] == piece != "\n":
                    found = self._word(piece)
                elif "".join(parts) != piece or piece.endswith("\n") or "\n\n" in piece:
                    other.append(at)
                    continue
                else:
                    found = b"".join([words.get(part) or self._word(part) for part in parts])
            plain.append(at)
            flat.append(found)
        self._store([pieces[i] for i in plain], np.frombuffer(b"".join(flat), np.uint32), np.fromiter(map(len, flat), np.int64, len(flat)) // 4)
        other = other if self.byte_level else list(range(len(pieces)))
        for a in range(0, len(other), 2048):  # the mark between them keeps them apart
            group = [pieces[i] for i in other[a : a + 2048]]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(group)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            self._store(group, ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1)
        return plain + other

    def _rows(self, pieces: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(rows < 0)
        if len(new):
            first = self.rows
            order = self._learn([pieces[i] for i in new.tolist()])
            rows[new[order]] = np.arange(first, first + len(new))
        return rows

    def _forget(self) -> None:
        """Gives up the rows of pieces that are not known."""
        self.rows = len(self.known)
        self.used = int(self.starts[self.rows - 1] + self.counts[self.rows - 1]) if self.rows else 0
        if self.used <= len(self.ids) // 4 and len(self.ids) > 1 << 20:  # room that one very long text took
            self.ids = self.ids[: max(1 << 20, 2 * self.used)].copy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and how many each text has; null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = pc.match_substring_regex(texts, f"{_WHITE} {_WHITE}")
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        alone = whole.to_numpy(zero_copy_only=False) | (self.mark is None)
        lists = pc.split_pattern(pc.if_else(pa.array(alone), "", texts), " ")
        offsets, values = lists.offsets.to_numpy(), lists.values
        first = np.zeros(len(values), bool)
        first[offsets[:-1]] = True
        rows = np.zeros(len(values), np.int64)
        self._forget()  # also what a call that did not end has left
        for where, space in [(first, ""), (~first, " ")] if self.mark is not None else []:
            d = values.filter(pa.array(where)).dictionary_encode()
            names = d.dictionary.to_pylist()
            if names:
                rows[where] = self._rows([space + x for x in names] if space else names)[d.indices.to_numpy()]
        counts = self.counts[rows]
        ids = self.ids[ragged(self.starts[rows], counts)]
        self._forget()
        summed = np.concatenate([[0], np.cumsum(counts)])
        per_text = summed[offsets[1:]] - summed[offsets[:-1]]
        if alone.any():
            at = np.flatnonzero(alone)
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([texts[int(i)].as_py() for i in at], add_special_tokens=False)]
            parts, before, bounds = [], 0, np.concatenate([[0], np.cumsum(per_text)])
            for i, x in zip(at, found, strict=True):
                parts += [ids[before : bounds[i]], x]
                before = bounds[i]
                per_text[i] = len(x)
            ids = np.concatenate([*parts, ids[before:]])
        return ids, per_text


_kept: dict[tuple[str, int], Encoder] = {}


def worker_encoder(path: str, cache_bytes: int = CACHE) -> Encoder:
    """The encoder of this worker process, kept from task to task with what it knows; one at a time."""
    if (path, cache_bytes) not in _kept:
        _kept.clear()
        _kept[path, cache_bytes] = Encoder(path, cache_bytes)
    return _kept[path, cache_bytes]


def encode_ended(encoder: Encoder, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As Encoder.encode, with end_id after each text: the ids and where each text's ids start (one bound more than texts)."""
    ids, counts = encoder.encode(texts)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(bounds[-1], "<u4")
    ends = np.zeros(bounds[-1], bool)
    ends[bounds[1:] - 1] = True
    out[ends] = end_id
    out[~ends] = ids
    return out, bounds
