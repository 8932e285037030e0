"""Token ids of whole texts, equal to what the tokenizers library gives for them.

Both word-splitting rules of the vocabularies used here never let a token cross a boundary between
white space and the word after it, nor one between a letter and an ASCII character that is none.
A run of texts is cut there as one byte array, and each different piece is encoded by the library
once per worker; pieces of up to 16 bytes are found by their bytes in a table of two integers,
longer ones in a dictionary. Pieces are taken in runs that leave the table room, so that a text may have
any number of different ones. A text with other than ASCII or Latin letters goes to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

MOST_PIECES = 500_000  # kept per worker; then the table starts anew
_SLOTS = 1 << 20
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Classes of bytes: 0 ends a text, 1 white space, 2 part of a letter, 3 other, 9 not handled here.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = 1
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 2
_CLASS[0x80:0xC0] = _CLASS[0xC3:0xC9] = 2


def vocabulary(name: str) -> str:
    """The path of an installed vocabulary file; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(raw: bytes) -> bool:
    """Only ASCII and two-byte Latin letters; the two signs among those letters are none."""
    return not (_CLASS[np.frombuffer(raw, np.uint8)] == 9).any() and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw


class Encoder:
    """``encode(texts)`` gives each text's ids as an array of little-endian unsigned 32-bit integers.

    Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        probe = self.tokenizer.encode_batch(["a  b", "a b"], add_special_tokens=False)
        self.spaces = probe[0].ids != probe[1].ids
        self._clear()

    def _clear(self):
        self.k1, self.k2 = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self.at = np.full(_SLOTS, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.flat, self.start, self.count, self.known = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuttable(self, raw: bytes) -> bool:
        return _plain(raw)

    def _add(self, pieces: list[bytes]) -> range:
        """Encode new pieces; their numbers."""
        ids = self._library([p.decode() for p in pieces])
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), "<u4", int(counts.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(ids) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : self.used + len(flat)] = flat
        new = slice(self.known, self.known + len(ids))
        self.start[new], self.count[new] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.known = self.used + len(flat), self.known + len(ids)
        return range(new.start, new.stop)

    @staticmethod
    def _slot(k1, k2):
        return ((k1 ^ (k2 * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - _SLOTS.bit_length())).astype(np.int64)

    def _look_up(self, k1, k2) -> np.ndarray:
        """Numbers of the pieces with these keys, -1 for new ones."""
        out, rest, slot = np.full(len(k1), -1, np.int32), np.arange(len(k1)), self._slot(k1, k2)
        while len(rest):
            here = self.at[slot]
            same = (self.k1[slot] == k1[rest]) & (self.k2[slot] == k2[rest]) & (here >= 0)
            out[rest[same]] = here[same]
            on = ~same & (here >= 0)
            rest, slot = rest[on], (slot[on] + 1) % _SLOTS
        return out

    def _numbers(self, buf: bytes, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        k1 = words[starts] & _KEEP[np.minimum(sizes, 8)]
        k2 = words[np.minimum(starts + 8, len(words) - 1)] & _KEEP[np.clip(sizes - 8, 0, 8)]
        out = self._look_up(k1, k2)
        far = sizes > 16
        out[far] = -1
        if far.any():
            which = np.flatnonzero(far)
            pieces = [buf[a : a + n] for a, n in zip(starts[which].tolist(), sizes[which].tolist(), strict=True)]
            unknown = [p for p in dict.fromkeys(pieces) if p not in self.long]
            if unknown:
                self.long.update(zip(unknown, self._add(unknown), strict=True))
            out[which] = [self.long[p] for p in pieces]
        new = np.flatnonzero(out < 0)
        if len(new):
            pieces = {buf[s : s + n]: i for i, s, n in zip(new.tolist(), starts[new].tolist(), sizes[new].tolist(), strict=True)}
            which = np.fromiter(pieces.values(), np.int64, len(pieces))
            number, slot = np.array(self._add(list(pieces)), np.int32), self._slot(k1[which], k2[which])
            while len(which):  # each free slot takes one of those that ask for it; the others move on
                free = np.flatnonzero(self.at[slot] < 0)
                took = free[np.unique(slot[free], return_index=True)[1]]
                self.k1[slot[took]], self.k2[slot[took]], self.at[slot[took]] = k1[which[took]], k2[which[took]], number[took]
                on = np.ones(len(which), bool)
                on[took] = False
                which, number, slot = which[on], number[on], (slot[on] + 1) % _SLOTS
            out[new] = self._look_up(k1[new], k2[new])
        return out

    def _cut(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the pieces, in order."""
        c = _CLASS[b]
        c[b == 0] = 0
        prev, cur = c[:-1], c[1:]
        word = cur >= 2
        first = word & ((prev < 2) | ((prev == 2) & (cur == 3)))
        starts = np.flatnonzero(first) + 1
        ends = np.flatnonzero((prev >= 2) & (~word | first)) + 1
        if not self.spaces:
            return starts, ends - starts
        starts -= b[starts - 1] == 0x20
        begin, end = np.flatnonzero((cur == 1) & (prev != 1)) + 1, np.flatnonzero((cur != 1) & (prev == 1)) + 1
        inner, last = c[end] >= 2, b[end - 1] != 0x20
        size = np.zeros(len(b), np.int64)
        size[starts] = ends - starts
        size[begin[~inner]] = (end - begin)[~inner]
        more = inner & (end - begin > 1)
        size[begin[more]] = (end - begin)[more] - 1
        size[end[inner & last] - 1] = 1
        starts = np.flatnonzero(size)
        return starts, size[starts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        plain = [self._cuttable(r) for r in raw]
        parts = [r if p else b"" for r, p in zip(raw, plain, strict=True)]
        buf = b"\0" + b"\0".join(parts) + b"\0" * 17
        b = np.frombuffer(buf, np.uint8)
        starts, sizes = self._cut(b)
        ids, counts, run = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], _SLOTS // 4
        for at in range(0, len(starts), run):
            if self.known > MOST_PIECES:
                self._clear()
            numbers = self._numbers(buf, b, starts[at : at + run], sizes[at : at + run])
            count = self.count[numbers]
            ends = np.cumsum(count)
            ids.append(self.flat[np.repeat(self.start[numbers] - (ends - count), count) + np.arange(ends[-1])])
            counts.append(count)
        ids, ends = np.concatenate(ids), np.cumsum(np.concatenate(counts))
        edges = np.cumsum([0, *(len(p) + 1 for p in parts)])
        cuts = np.concatenate([[0], ends])[np.searchsorted(starts, edges)]
        return [ids[cuts[i] : cuts[i + 1]] if p else np.array(self._library([texts[i]])[0], "<u4") for i, p in enumerate(plain)]


class PieceEncoder(Encoder):
    """The same for a SentencePiece model that leaves texts as they are and puts a space before them.

    Texts are given with that space. No piece of such a vocabulary holds a space behind another character,
    so a text is cut before each run of spaces; a model with such pieces gets whole texts.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id("\u2581")
        self.cuts = not any("\u2581" in self.model.id_to_piece(i).lstrip("\u2581") for i in range(self.model.get_piece_size()))
        self._clear()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [ids or [self.space] for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]

    def _cuttable(self, raw: bytes) -> bool:
        return self.cuts and b"\0" not in raw

    def _cut(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prev, cur = b[:-1], b[1:]
        first = (cur == 0x20) & (prev != 0x20)
        starts = np.flatnonzero(first) + 1
        return starts, np.flatnonzero((first | (cur == 0)) & (prev != 0)) + 1 - starts


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and model."""
    return PieceEncoder(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
