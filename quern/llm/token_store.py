r"""Token ids in compressed binary files: an adaptive context-mixing range coder.

Texts are encoded with the ``tokenizers`` library and a vocabulary file whose path is a
parameter. An end id closes each document. Ids are written in ascending order of
identifiers as records of whole documents, each a row of a Parquet table (the container
that every store Spark writes to can hold) with its own blocks.

A block is ``QCM2``, the numbers of ids, of distinct ids and of coded bytes of both its parts, the
CRC-32 of the ids as little-endian 32-bit integers, and these parts. Its models start anew, so
blocks are read independently, and a damaged one is found by its checksum. The first part
holds the block's distinct ids as gaps with adaptive frequencies; the second names ids by
their places among these. There each id is predicted at orders 2 and 1 by the id that
followed that context last. The chance that the order-2 guess holds is mixed, in the logistic
domain and by weights learned on the way, from what order 2 (how sure the guess is), order 1 and
order 0 (how the last id was coded) say; the order-1 guess has its chance behind it, and an id
that neither predicts is coded by adaptive order-0 frequencies. These shares nest, so each
id is one event of a 64-bit range coder. Guesses are learned at each id, chances, weights and
frequencies at fixed places of a block. Arithmetic is in integers, so files read alike anywhere.

Blocks are coded in step, one id of each at a time, in numpy; a task holds at most
``LANES`` blocks' models. One shuffle deals texts by range of identifier, and no row of
counts but one a partition reaches the driver.

Defined results: a null text counts as empty and has just its end id; a text of any length
is encoded whole and cut into blocks; rows without identifier come first; rows with equal
identifiers are ordered by text, so repeated rows stay side by side; an empty table writes no
record and gives no row; other columns, whatever their names, are ignored; ids of 2**21 or
more raise ValueError.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import batch, documents, mapped, small_batches, stash, worker_cache
from .bpe import MARKS, byte_letters, vocabulary_path

END = 0
#: Ids of a block at most, blocks coded in step, ids of a record of several documents.
BLOCK, LANES, RECORD = 4096, 2048, 1 << 16
#: Pieces of texts that a worker remembers the ids of.
CACHE = 800_000
#: Bytes of texts that are encoded together, at least.
TOGETHER = 18 << 20
MAGIC = b"QCM2"
_HEAD = "<4sIIIII"


class Encoder:
    """The library's ids of texts; ids of words between single spaces are remembered.

    The byte-level pre-tokeniser begins a new token before a space that other characters
    surround, around a line break that they surround, and between a letter and marks at a
    word's end, so ids of such pieces don't depend on their neighbours. A piece of letters
    is one such token, which the library's model encodes by itself. Texts with other white
    space, and all texts if the file's pre-tokeniser is another one, are given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before = file.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and file.get("normalizer") is None
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.letters = {b: c for c, b in byte_letters().items()} | {0: "\0"}
        self.model = self.tokenizer.model.tokenize
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.small: dict[str, list[int]] = {}
        #: Remembered pieces, where their ids begin among all ids, how many they are (-1: the text goes whole), and when each was met last.
        self.pieces, self.ids = pa.array([], pa.string()), np.zeros(0, self.dtype)
        self.begin, self.many, self.met, self.turn = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _letters(self, some: list[str]) -> tuple[list[int], list[int]]:
        """Ids of pre-tokens of letters, perhaps with a space before them, and how many each has."""
        if not some:
            return [], []
        spelled = "\0".join(some).encode().decode("latin-1").translate(self.letters).split("\0")
        ids: list[int] = []
        many: list[int] = []
        for k in range(0, len(spelled), 256):  # the library's objects go before the collector looks at them
            found = list(map(self.model, spelled[k : k + 256]))
            ids += [x.id for t in found for x in t]
            many += map(len, found)
        return ids, many

    def _few(self, text: str) -> list[int]:
        """Ids of marks or a line break, of which there are few."""
        ids = self.small.get(text)
        if ids is None:
            if len(self.small) > 10_000:
                self.small.clear()
            ids = self.small[text] = self.library(text) if text else []
        return ids

    def _piece(self, p: str) -> list[int] | None:
        """The library's ids of what stands between two spaces, the first of which counts to it, or a line
        break does; None if it has other white space at its ends."""
        if not p or (p[-1].isspace() and p != "\n") or (p[0].isspace() and (p[0] != "\n" or p[1:2].isspace())):
            return None
        return self.library(p if p[0] == "\n" else " " + p)

    def _add(self, words: pa.Array, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Remembers pieces with their ids, and gives their places."""
        size = np.maximum(many, 0)
        self.begin = np.concatenate([self.begin, len(self.ids) + size.cumsum() - size])
        self.many, self.met = np.concatenate([self.many, many]), np.concatenate([self.met, np.full(len(words), self.turn)])
        self.ids = np.concatenate([self.ids, ids])
        self.pieces = pa.concat_arrays([self.pieces, words])
        return np.arange(len(self.pieces) - len(words), len(self.pieces))

    def _find(self, pieces: pa.Array) -> np.ndarray:
        return pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy().astype(np.int64)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The places of pieces among the remembered ones, to which new ones are added."""
        place = self._find(pieces)
        new = np.flatnonzero(place < 0)
        if len(new):
            coded = pieces.take(pa.array(new)).dictionary_encode()
            place[new] = self._learn(coded.dictionary)[coded.indices.to_numpy()]
        return place

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Remembers new pieces, all different, and gives their places.

        A word of letters with marks behind it takes its ids from the word and the marks.
        """
        place = np.empty(len(fresh), np.int64)
        words = _listed(fresh)
        cores = [w.rstrip(MARKS) for w in words]
        plain = np.fromiter(map(str.isalpha, cores), bool, len(cores))
        parts = [(w, c) for w, c, p in zip(words, cores, plain.tolist(), strict=True) if not p]
        lines = list({c for _, c in parts if c[:1] == "\n" and c[1:].isalpha()})
        flat, length = self._letters([c[1:] for c in lines])
        of_line = {c: self._few("\n") + flat[e - n : e] for c, n, e in zip(lines, length, accumulate(length), strict=True)}
        lists = [of_line[c] + self._few(w[len(c) :]) if c in of_line else self._piece(w) for w, c in parts]
        many = np.array([-1 if x is None else len(x) for x in lists], np.int64)
        ids = np.fromiter(chain.from_iterable(x for x in lists if x), self.dtype, int(np.maximum(many, 0).sum()))
        place[~plain] = self._add(fresh.filter(pa.array(~plain)), ids, many)
        if plain.any():
            fresh = fresh.filter(pa.array(plain))
            tails: dict[str, int] = {"": 0}
            tail = np.array([tails.setdefault(w[len(c) :], len(tails)) for w, c, p in zip(words, cores, plain.tolist(), strict=True) if p])
            coded = pa.array([c for c, p in zip(cores, plain.tolist(), strict=True) if p], pa.string()).dictionary_encode()
            core = coded.indices.to_numpy()
            at = self._find(coded.dictionary)
            # cores met for the first time, also those that no piece is equal to, are remembered first
            first = coded.dictionary.filter(pa.array(at < 0))
            ids, many = self._letters([" " + c for c in _listed(first)])
            at[at < 0] = self._add(first, np.array(ids, self.dtype), np.array(many, np.int64))
            of, whole = at[core], tail == 0
            behind = [self._few(t) for t in tails]
            size, left = self.many[of[~whole]], np.array(list(map(len, behind)))[tail[~whole]]
            ends = (size + left).cumsum()
            out = np.empty(int(ends[-1]) if len(ends) else 0, self.dtype)
            out[_spread(ends - size - left, size)] = self.ids[_spread(self.begin[of[~whole]], size)]
            out[_spread(ends - left, left)] = np.array(list(chain.from_iterable(behind)), self.dtype)[_spread(np.r_[0, np.cumsum(list(map(len, behind)))][tail[~whole]], left)]
            of[~whole] = self._add(fresh.filter(pa.array(~whole)), out, size + left)
            place[plain] = of
        return place

    def _joined(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one behind the other, and where each piece's begin and end."""
        size = self.ids.itemsize
        known = pa.Array.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(np.append(self.begin, len(self.ids)) * size), pa.py_buffer(self.ids)])
        _, ends, ids = known.take(pa.array(place)).buffers()
        upto = np.frombuffer(ends, np.int64, len(place) + 1) // size
        return np.frombuffer(ids, self.dtype, int(upto[-1])) if upto[-1] else self.ids[:0], upto

    def _forget(self) -> None:
        """Beyond CACHE pieces, keeps those that were met last, half as many."""
        if len(self.pieces) <= CACHE:
            return
        keep = np.sort(np.argpartition(-self.met, CACHE // 2)[: CACHE // 2])
        size = np.maximum(self.many[keep], 0)
        self.ids = self.ids[_spread(self.begin[keep], size)]
        self.pieces, self.many, self.met = self.pieces.take(pa.array(keep)), self.many[keep], self.met[keep]
        self.begin = size.cumsum() - size

    def encode(self, some: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        self.turn += 1
        out: list = [None] * len(some)
        cut = [k for k, t in enumerate(some) if t and self.cuts and "\n\n" not in t and "  " not in t and not any(x in t for x in self.added)]
        heads = [some[k].replace("\n", " \n").split(" ", 1) for k in cut]
        both = [(k, h) for k, h in zip(cut, heads, strict=True) if len(h) == 2 and not h[0][-1:].isspace()]
        if both:
            lists = pc.split_pattern(pa.array([h[1] for _, h in both], pa.large_string()), " ")
            flat = lists.flatten()
            if flat.nbytes < 1 << 30:  # else texts are too long for it, and go whole
                place = self._places(flat.cast(pa.string()))
                self.met[place] = self.turn
                ids, upto = self._joined(place)
                ends = lists.offsets.to_numpy()
                bad, upto = np.searchsorted((self.many[place] < 0).nonzero()[0], ends), upto[ends].tolist()
                for i, (k, h) in enumerate(both):
                    if bad[i] == bad[i + 1]:
                        out[k] = np.concatenate([np.array(self._few(h[0]), self.dtype), ids[upto[i] : upto[i + 1]]])
                self._forget()
        for k, t in enumerate(some):
            if out[k] is None:
                out[k] = np.array(self.library(t) if t else [], self.dtype)
        return out


def _listed(words: pa.Array) -> list[str]:
    """Strings without spaces as a list; one long string is cut faster than many are made."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


def _spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places of runs: ``many`` from each ``begin`` on."""
    ends = many.cumsum()
    return np.repeat(begin - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)


_U = np.uint64
#: Shares of an event are of 2**32; of those, frequencies of ids and of gaps are of these powers of two.
_FULL, _SHARE, _ID_BITS, _GAP_BITS = _U(1 << 32), _U(32), 15, 10
_ID_SHARE, _CELL_BITS = _U(_ID_BITS), 4
_CELL = 1 << _CELL_BITS
_PART_BITS, _PART = _U(16), _U((1 << 16) - 1)
#: Buckets of gaps between a block's distinct ids: two for each power of two.
_BUCKETS, _MOST = 44, 1 << 21
#: Places of the tables of orders 1 and 2, in a lane, and contexts of the mixed chance: the two
#: guesses' sureness, whether they are the same, and how the last id was coded.
_ONE, _TWO, _CONTEXTS = 256, 256, 96


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Squash (logistic, 12 bits) by linear steps, and stretch, its inverse, in integers."""
    x = np.arange(-2048, 2048)
    curve = np.round(4096 / (1 + np.exp(-x / 256.0))).astype(np.int64)
    squash = np.clip(curve, 1, 4095)
    stretch = np.searchsorted(squash, np.arange(4096)).clip(0, 4095) - 2048
    return squash, stretch


_SQUASH, _STRETCH = _tables()
#: What becomes of a guess's sureness, which its difference from the place shows: order 1, then order 2; from 16 on it was wrong.
_SURER = np.array([min(k + 1, 3) for k in range(16)] + [0] + [min(k + 4, 12) for k in range(16)] + [0], np.uint16)


#: Steps that are handled together at most.
_STEPS = 32


def _due(t: int) -> bool:
    """Whether the models take in what they have seen before step ``t``."""
    return t % 1024 == 0 if t >= 1024 else t in (16, 32, 64, 128, 256, 512)


class _Writer:
    """A range coder of 64 bits for each lane, which gives out 32 bits at once.

    A share of an event is ``size`` of 2**32, from ``start``. Carries are added to the last
    word given out and run on when the lane is closed.
    """

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
        #: The lanes' words, lane by lane, and where each one's next word goes.
        self.out, self.n = np.zeros(lanes * (steps + 4), _U), np.arange(lanes) * (steps + 4)

    def put(self, on: int, start: np.ndarray, size: np.ndarray) -> None:
        """An event of each of the first ``on`` lanes."""
        low, rng = self.low[:on], self.range[:on]
        rng >>= _SHARE
        start = start * rng
        low += start
        rng *= size
        over = (low < start).nonzero()[0]
        if over.size:
            self.out[self.n[over] - 1] += _U(1)
        short = (rng < _FULL).nonzero()[0]
        if short.size:
            v, n = low[short], self.n[short]
            self.out[n] = v >> _SHARE
            low[short] = v << _SHARE
            rng[short] <<= _SHARE
            self.n[short] = n + 1

    def close(self) -> list[bytes]:
        for shift in (32, 0):
            self.out[self.n] = (self.low >> _U(shift)) & (_FULL - _U(1))
            self.n += 1
        out = self.out.reshape(len(self.n), -1)
        n = self.n - np.arange(len(out)) * out.shape[1]
        out = out[:, : n.max()]
        while (carry := out >> _SHARE).any():
            out &= _FULL - _U(1)
            out[:, :-1] += carry[:, 1:]
        words = out.astype(">u4")
        return [w[:n].tobytes() for w, n in zip(words, n.tolist(), strict=True)]


class _Reader:
    def __init__(self, coded: list[bytes]):
        words = np.zeros((len(coded), max(map(len, coded)) // 4 + 2), np.uint32)
        for w, c in zip(words, coded, strict=True):
            w[: len(c) // 4] = np.frombuffer(c, ">u4", len(c) // 4)
        self.code = (words[:, 0].astype(_U) << _SHARE) | words[:, 1]
        self.range, self.words = np.full(len(coded), ~_U(0)), words.ravel()
        #: Where each lane's next word lies, and its last one, which is 0.
        self.last = np.arange(1, len(coded) + 1) * words.shape[1] - 1
        self.n = np.minimum(self.last - words.shape[1] + 3, self.last)

    def peek(self, on: int) -> np.ndarray:
        """Where in 2**32 the next event of each of the first ``on`` lanes lies; beyond that in damaged bytes."""
        rng = self.range[:on]
        rng >>= _SHARE
        return self.code[:on] // rng

    def take(self, on: int, start: np.ndarray, size: np.ndarray) -> None:
        code, rng = self.code[:on], self.range[:on]
        code -= start * rng
        rng *= size
        short = (rng < _FULL).nonzero()[0]
        if short.size:
            n = self.n[short]
            code[short] = (code[short] << _SHARE) | self.words.take(n)
            rng[short] <<= _SHARE
            self.n[short] = np.minimum(n + 1, self.last[short])


def _on(length: np.ndarray) -> list[int]:
    """How many lanes, which are in order of length, are as long at each step."""
    return np.searchsorted(-length, -np.arange(int(length[0])), "left").tolist()


class _Gaps:
    """Adaptive frequencies of the buckets of gaps, in each lane."""

    def __init__(self, lanes: int):
        self.seen = np.ones((lanes, _BUCKETS), np.int64)
        self.lane = np.arange(lanes) * _BUCKETS
        self.cells = np.arange(lanes) << _GAP_BITS
        self.met: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        if self.met:
            self.seen += 4 * np.bincount(np.concatenate(self.met), minlength=self.seen.size).reshape(self.seen.shape)
            self.met = []
        up = self.seen.cumsum(1)
        high = up * ((1 << _GAP_BITS) - _BUCKETS) // up[:, -1:] + np.arange(1, _BUCKETS + 1)
        self.wide = np.diff(high, prepend=0)
        self.low = (high - self.wide).ravel()
        self.wide = self.wide.ravel()
        #: The bucket of each part of a lane's share.
        self.cell = np.repeat(np.tile(np.arange(_BUCKETS, dtype=np.uint8), len(up)), self.wide)

    def shares(self, bucket: np.ndarray, rest: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = bucket + self.lane[: bucket.shape[-1]]
        size = self.wide.take(at) << (32 - _GAP_BITS) >> bits
        return ((self.low.take(at) << (32 - _GAP_BITS)) + rest * size).astype(_U), size.astype(_U)

    def learn(self, bucket: np.ndarray) -> None:
        """Keeps some steps of the same lanes until frequencies are due."""
        self.met.append((bucket + self.lane[: bucket.shape[-1]]).ravel())


def _runs(live: list[int], due: Callable[[int], bool], most: int) -> Iterator[tuple[int, int, int]]:
    """Steps of the same lanes between which models are not due: begin, end, lanes."""
    t = 0
    while t < len(live):
        until = t + 1
        while until < len(live) and live[until] == live[t] and until - t < most and not due(until):
            until += 1
        yield t, until, live[t]
        t = until


def _due_gaps(t: int) -> bool:
    return t % 32 == 0 or t in (1, 2, 4, 8, 16)


def _rest_bits(bucket: np.ndarray) -> np.ndarray:
    return np.maximum((bucket >> 1) - 1, 0)


def _bucketed(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a gap of 1 or more, and what it is beyond the bucket's least."""
    power = np.frexp(gap.astype(np.float64))[1].astype(np.int64) - 1
    half = np.where(power > 0, gap >> np.maximum(power - 1, 0) & 1, 0)
    bucket = 2 * power + half
    return bucket, gap - _least(bucket)


def _least(bucket: np.ndarray) -> np.ndarray:
    power = bucket >> 1
    return (1 << power) + (bucket & 1) * (1 << np.maximum(power - 1, 0))


def _code_sets(sets: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of sorted distinct ids, in step, as gaps."""
    order = np.argsort([-len(s) for s in sets], kind="stable")
    length = np.array([len(sets[i]) for i in order])
    bucket, rest = np.zeros((2, int(length[0]), len(sets)), np.int64)
    for k, i in enumerate(order):
        bucket[: length[k], k], rest[: length[k], k] = _bucketed(np.diff(sets[i].astype(np.int64), prepend=-1))
    m, w, bits = _Gaps(len(sets)), _Writer(len(sets), len(bucket)), _rest_bits(bucket)
    for t, until, on in _runs(_on(length), _due_gaps, 32):
        if _due_gaps(t):
            m.refresh()
        start, size = m.shares(bucket[t:until, :on], rest[t:until, :on], bits[t:until, :on])
        for k in range(until - t):
            w.put(on, start[k], size[k])
        m.learn(bucket[t:until, :on])
    out = [b""] * len(sets)
    for i, c in zip(order, w.close(), strict=True):
        out[i] = c
    return out


def _decode_sets(coded: list[bytes], many: list[int]) -> list[np.ndarray]:
    order = np.argsort([-n for n in many], kind="stable")
    length = np.array([many[i] for i in order])
    gaps = np.zeros((int(length[0]), len(coded)), np.int64)
    m, r = _Gaps(len(coded)), _Reader([coded[i] for i in order])
    for t, until, on in _runs(_on(length), _due_gaps, 32):
        if _due_gaps(t):
            m.refresh()
        buckets = np.empty((until - t, on), np.int64)
        for k in range(until - t):
            v = np.minimum(r.peek(on), _FULL - _U(1)).astype(np.int64)
            buckets[k] = m.cell.take(m.cells[:on] + (v >> (32 - _GAP_BITS)))
            bits = _rest_bits(buckets[k])
            start, size = m.shares(buckets[k], 0, bits)
            rest = np.minimum((v - start.astype(np.int64)) // size.astype(np.int64), (1 << bits) - 1)
            r.take(on, start + rest.astype(_U) * size, size)
            gaps[t + k, :on] = rest
        gaps[t:until, :on] += _least(buckets)
        m.learn(buckets)
    out = [np.zeros(0, np.int64)] * len(coded)
    for k, i in enumerate(order):
        out[i] = gaps[: length[k], k].cumsum() - 1
    return out


class _Models:
    """The models of all lanes over places in their blocks' sets of ids.

    A guess of order 1 or 2 and how sure it is share an integer: the place, times 16, and
    0 to 3 in the lowest two bits or in the two above these. Tables are learned at each step,
    chances and frequencies when they are due, so all that a step needs of them are look-ups.
    """

    def __init__(self, sizes: np.ndarray):
        lanes = len(sizes)
        self.table = np.zeros(lanes * (_ONE + _TWO), np.uint16)
        lane = np.arange(lanes)
        self.lanes = lane * (_ONE + _TWO)
        #: A context's counts and shares of all lanes lie side by side, so sums over contexts run along lanes.
        self.base = lane
        self.before = np.zeros(lanes, np.int64)
        self.prev = np.zeros(lanes, np.int64)
        self.events = np.zeros((3, _CONTEXTS, lanes), np.int64)
        self.weight = np.full((3, lanes), 24000, np.int64)
        self.sizes, self.end = sizes, sizes.cumsum()
        self.first = self.end - sizes
        self.count = np.ones(int(self.end[-1]), np.int32)
        self.place = (np.arange(len(self.count)) - np.repeat(self.first, sizes)).astype(np.int32)
        self.cells = lane * ((1 << _ID_BITS) // _CELL)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.refresh()

    def look(self, on: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tables of orders 1 and 2, and what they hold."""
        prev, at = self.prev[:on], np.empty((2, on), np.int64)
        np.bitwise_and(prev, _ONE - 1, out=at[0])
        np.multiply(self.before[:on], 419, out=at[1])
        at[1] += prev
        at[1] &= _TWO - 1
        at[1] += _ONE
        at += self.lanes[:on]
        return at, self.table.take(at)

    def learn(self, x: np.ndarray, at: np.ndarray, held: np.ndarray) -> None:
        """Takes in the ids' places ``x``: a guess that was right is surer, a wrong one is replaced."""
        new = (x << 4).astype(np.uint16)
        sure = np.minimum(held ^ new, 16)
        sure[1] += 17
        self.table[at] = _SURER.take(sure) + new
        self.before, self.prev = self.prev, x

    def take_in(self, x: np.ndarray, context: np.ndarray, event: np.ndarray) -> None:
        """Keeps some steps of the same lanes, places, contexts and how they were coded, until the models are due."""
        self.seen.append((x.astype(np.int32), (event * self.events[0].size + context).astype(np.int32)))

    def refresh(self) -> None:
        if self.seen:
            for x, _ in self.seen:
                x += self.first[: x.shape[1]]
            places = np.concatenate([x.T.ravel() for x, _ in self.seen])
            self.count += np.bincount(places, minlength=len(self.count)).astype(np.int32) << 1
            self.events += np.bincount(np.concatenate([e.ravel() for _, e in self.seen]), minlength=self.events.size).reshape(self.events.shape)
            self.seen = []
        self._chances()
        self._frequencies()

    def _chances(self) -> None:
        """The shares of both guesses in each context, mixed from what each order knows alone."""
        hit, second, miss = self.events.reshape(3, 3, 2, 4, 4, -1)
        n = hit + second + miss
        by_sure, seen = hit.sum(0), n.sum(0)
        chance = lambda h, n: _STRETCH.take(np.minimum((2 * h + 1) * 4096 // (2 * n + 16), 4095))
        two = chance(by_sure.sum(2), seen.sum(2))[:, :, None]
        one = chance(by_sure.sum(1), seen.sum(1))[:, None]
        none = chance(hit.sum((1, 2, 3)), n.sum((1, 2, 3)))[:, None, None, None]

        def mixed() -> np.ndarray:
            x = none * self.weight[2] + (two * self.weight[0] + one * self.weight[1])
            x >>= 16
            np.clip(x, -2048, 2047, out=x)
            x += 2048
            return _SQUASH.take(x)

        wrong = hit * 4096 - n * mixed()
        total, by_sure = np.maximum(seen.sum((0, 1, 2)), 1), wrong.sum(0)
        for k, x in enumerate((by_sure.sum(2)[:, :, None] * two, by_sure.sum(1)[:, None] * one, wrong.sum((1, 2, 3))[:, None, None, None] * none)):
            self.weight[k] += x.sum((0, 1, 2) if k < 2 else (0, 1, 2, 3)) // total // 64
        first = np.clip(mixed(), 16, 4080) << 20
        left, right = (second + miss).sum((0, 1)), second.sum((0, 1))
        then = np.clip((2 * right + 1) * 4096 // (2 * left + 16), 16, 4080)
        both = first.copy()
        both[:, 0] += (((1 << 32) - first[:, 0]) >> 12) * then  # else both guesses are the same
        self.share_two = first.view(_U).ravel()
        self.share_both = both.view(_U).ravel()

    def _frequencies(self) -> None:
        """Order-0 frequencies of the places, lane by lane; each is 1 of 2**15 at least."""
        up = self.count.cumsum(dtype=np.int32)
        begin = np.r_[np.int32(0), up][self.first]
        scale = ((1 << _ID_BITS) - self.sizes) / (up[self.end - 1] - begin)
        up -= self.count
        up -= np.repeat(begin, self.sizes)
        low = (up * np.repeat(scale, self.sizes)).astype(np.int32)
        low += self.place
        high = np.append(low[1:], np.int32(0))
        high[self.end - 1] = 1 << _ID_BITS
        begin = low + (_CELL - 1) >> _CELL_BITS
        cover = np.append(begin[1:], np.int32(0))
        cover[self.end - 1] = 1 << _ID_BITS - _CELL_BITS
        cover -= begin
        #: The place, in its lane, in which each cell of a lane's frequencies begins.
        self.cell = np.repeat(self.place.astype(np.uint16), cover)
        #: Where a place's frequencies end, times 2**16, and how many they are.
        self.part = high.astype(np.uint32)
        self.part <<= 16
        high -= low
        self.part |= high.view(np.uint32)

    def find(self, on: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each lane whose frequencies hold ``want``, and its part of them."""
        place = self.cell.take((want >> _CELL_BITS) + self.cells[:on]) + self.first[:on]
        part, least = self.part.take(place), want + 1 << 16
        far = (part < least).nonzero()[0]
        while far.size:
            next_ = place[far] + 1
            place[far] = next_
            ends = part[far] = self.part.take(next_)
            far = far[ends < least[far]]
        return place, part

    @staticmethod
    def shares(part: np.ndarray, unit: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of parts of the frequencies, behind the shares of both guesses."""
        start = part.astype(_U)
        size = start & _PART
        start >>= _PART_BITS
        start -= size
        start *= unit
        start += both
        size *= unit
        return start, size

    def contexts(self, held: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The context of each look-up, in its lane; ``last`` is 32 times the last event, and the lane is added."""
        v, w = held
        c = ((v | w) & 15).astype(np.int64)
        c += ((v ^ w) < 16) << 4
        c *= len(self.base)
        c += last
        return c


def _code_places(places: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    """The coded bytes of some blocks of places in sets of ``sizes``, longest first, in step."""
    length = np.array([len(x) for x in places])
    ids = np.zeros((int(length[0]), len(places)), np.uint16)
    for k, x in enumerate(places):
        ids[: length[k], k] = x
    m, out = _Models(sizes), _Writer(len(places), len(ids))
    after = 32 * len(m.base)
    last = m.base + 2 * after
    for t, until, on in _runs(_on(length), _due, _STEPS):
        if _due(t):
            m.refresh()
        x = ids[t:until, :on].astype(np.int64)
        held = np.empty((2, *x.shape), np.uint16)
        for k in range(len(x)):
            at, held[:, k] = m.look(on)
            m.learn(x[k], at, held[:, k])
        second, first = held >> 4 == x
        event = np.where(first, 0, 2 - second)
        before = np.vstack([last[:on], m.base[:on] + after * event[:-1]])
        last = m.base[:on] + after * event[-1]
        context = m.contexts(held, before)
        both, at = m.share_both.take(context), x + m.first[:on]
        unit = _FULL - both
        unit >>= _ID_SHARE
        start, size = m.shares(m.part.take(at), unit, both)
        for guess, right in ((0, first), (1, second & ~first)):
            at = right.ravel().nonzero()[0]
            two = m.share_two.take(context.ravel()[at])
            start.ravel()[at] = two if guess else _U(0)
            size.ravel()[at] = both.ravel()[at] - two if guess else two
        for k in range(len(x)):
            out.put(on, start[k], size[k])
        m.take_in(x, context, event)
    return out.close()


def _decode_places(coded: list[bytes], length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of some blocks, longest first, a column for each."""
    ids = np.zeros((int(length[0]), len(coded)), np.uint16)
    m, r, top = _Models(sizes), _Reader(coded), _U((1 << _ID_BITS) - 1)
    after = 32 * len(m.base)
    last = m.base + 2 * after
    for t, until, on in _runs(_on(length), _due, _STEPS):
        if _due(t):
            m.refresh()
        context, event = np.empty((until - t, on), np.int64), np.full((until - t, on), 2, np.int64)
        found, plain = np.empty((until - t, on), np.int64), m.base[:on] + 2 * after
        last = last[:on]
        for k in range(until - t):
            at, held = m.look(on)
            c, x, f = m.contexts(held, last), found[k], r.peek(on)
            context[k] = c
            # as if neither guess held; where one does, what comes of it is written over
            both, last = m.share_both.take(c), plain.copy()
            unit = _FULL - both
            unit >>= _ID_SHARE
            want = f - both
            want //= unit
            place, part = m.find(on, np.minimum(want, top).view(np.int64))
            start, size = m.shares(part, unit, both)
            np.subtract(place, m.first[:on], out=x)
            if (g := (f < both).nonzero()[0]).size:
                two, most = m.share_two.take(c[g]), both[g]
                second = f[g] >= two
                start[g], size[g] = two * second, np.where(second, most - two, two)
                x[g] = held[1 - second, g] >> 4
                event[k, g] = second
                last[g] += after * (second - np.int64(2))
            r.take(on, start, size)
            m.learn(x, at, held)
        ids[t:until, :on] = found
        m.take_in(found, context, event)
    return ids


def _cut(ids: np.ndarray) -> list[np.ndarray]:
    """Blocks of equal length, as far as it goes, of up to BLOCK ids."""
    return np.array_split(ids, -(-len(ids) // BLOCK)) if len(ids) else []


def _in_sets(blocks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct ids of each block, and its ids as places among these."""
    most = 1 + max(int(b.max()) for b in blocks)
    if most > _MOST:
        raise ValueError(f"ids below {_MOST} only")
    there, place = np.zeros(most, bool), np.zeros(most, np.uint16)
    for b in blocks:
        there[b] = True
        s = there.nonzero()[0]
        place[s] = np.arange(len(s))
        yield s, place[b]
        there[s] = False


def code_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Some blocks of one id or more, coded in step."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sets, places = zip(*_in_sets([blocks[i] for i in order]), strict=True)
    out = [b""] * len(blocks)
    for i, s, a, b in zip(order, sets, _code_sets(sets), _code_places(places, np.array(list(map(len, sets)))), strict=True):
        out[i] = struct.pack(_HEAD, MAGIC, len(blocks[i]), len(s), len(a), len(b), zlib.crc32(blocks[i].astype("<u4").tobytes())) + a + b
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of some blocks; one that doesn't match its checksum raises ValueError."""
    heads = [struct.unpack_from(_HEAD, b) for b in blocks]
    if any(n < many or not many or n > BLOCK for _, n, many, *_ in heads):
        raise ValueError("a block's head is damaged")
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][1])
    length, sizes = (np.array([heads[i][k] for i in order]) for k in (1, 2))
    begin, middle = struct.calcsize(_HEAD), [struct.calcsize(_HEAD) + heads[i][3] for i in order]
    sets = _decode_sets([blocks[i][begin:m] for i, m in zip(order, middle, strict=True)], sizes.tolist())
    places = _decode_places([blocks[i][m:] for i, m in zip(order, middle, strict=True)], length, sizes)
    out = [np.zeros(0, np.int64)] * len(blocks)
    for k, i in enumerate(order):
        ids = sets[k][places[: length[k], k]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][5]:
            raise ValueError("a block does not match its checksum")
        out[i] = ids
    return out


def pack(ids: list[np.ndarray]) -> list[bytes]:
    """Each array of ids as checksummed blocks."""
    cut = list(map(_cut, ids))
    flat = [b for c in cut for b in c]
    coded: list[bytes] = []
    for k in range(0, len(flat), LANES):
        coded += code_blocks(flat[k : k + LANES])
    blocks = iter(coded)
    return [b"".join(next(blocks) for _ in c) for c in cut]


def unpack(packed: list[bytes]) -> list[np.ndarray]:
    """The ids of each packed value; a damaged block raises ValueError."""
    blocks, of = [], []
    for i, data in enumerate(packed):
        at = 0
        while at < len(data):
            if at + struct.calcsize(_HEAD) > len(data):
                raise ValueError("no block where one should begin")
            magic, _, _, a, b, _ = struct.unpack_from(_HEAD, data, at)
            end = at + struct.calcsize(_HEAD) + a + b
            if magic != MAGIC or end > len(data):
                raise ValueError("no block where one should begin")
            blocks.append(data[at:end]), of.append(i)
            at = end
    out: list[list[np.ndarray]] = [[] for _ in packed]
    for k in range(0, len(blocks), LANES):
        for j, ids in enumerate(decode_blocks(blocks[k : k + LANES]), k):
            out[of[j]].append(ids)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def encoder(path: str) -> Encoder:
    known = worker_cache("token_store")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


_RECORD = pa.schema([("part", pa.int32()), ("record", pa.int64()), ("begin", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("blocks", pa.binary())])
_RECORD_SQL = "part int, record long, begin long, doc_ids array<long>, counts array<int>, blocks binary"


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Identifiers and texts of some batches at a time, which the encoder's look-ups share."""
    names, some, size = [], [], 0
    for b in batches:
        names += b.column(0).to_pylist()
        some += [t or "" for t in b.column(1).to_pylist()]
        size += b.nbytes
        if size >= TOGETHER:
            yield names, some
            names, some, size = [], [], 0
    if names:
        yield names, some


def write_records(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The records of ``docs``, in order of identifiers within and across partitions."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        own, part = encoder(path), TaskContext.get().partitionId()
        record = begin = 0
        docs_of, counts, ids, groups, open_ids, held = [], [], [], [], 0, 0

        def close():
            nonlocal docs_of, counts, ids, open_ids, held
            groups.append((docs_of, counts, np.concatenate(ids)))
            held += open_ids
            docs_of, counts, ids, open_ids = [], [], [], 0

        def give():
            nonlocal record, begin, groups, held
            rows = {k: [] for k in _RECORD.names}
            for (d, c, x), b in zip(groups, pack([x for _, _, x in groups]), strict=True):
                for k, v in zip(_RECORD.names, (part, record, begin, d, c, b), strict=True):
                    rows[k].append(v)
                record, begin = record + 1, begin + len(x)
            groups, held = [], 0
            return batch(_RECORD, **rows)

        for names, some in _many(batches):
            for d, x in zip(names, own.encode(some), strict=True):
                docs_of.append(d)
                counts.append(len(x) + 1)
                ids += [x, np.array([END], own.dtype)]
                open_ids += len(x) + 1
                if open_ids >= RECORD:
                    close()
                    if held >= BLOCK * LANES:
                        yield give()
        if docs_of:
            close()
        if groups:
            yield give()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return mapped(dealt, run, _RECORD_SQL, "token_store")


def read_records(records: DataFrame) -> DataFrame:
    """From records: doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = records.sparkSession
    small_batches(spark)
    totals = sorted(records.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, offset = 0, {}
    for row in totals:
        offset[row["part"]] = before
        before += row["n"]

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        held, size = [], 0

        def give():
            rows = {k: [] for k in schema.names}
            for (part, begin, doc_ids, counts, _), ids in zip(held, unpack([h[4] for h in held]), strict=True):
                at, raw = 0, ids.astype("<u4")
                if sum(counts) != len(raw):
                    raise ValueError("a record has other ids than it counts")
                for d, n in zip(doc_ids, counts, strict=True):
                    rows["doc_id"].append(d)
                    rows["start"].append(offset[part] + begin + at)
                    rows["n_tokens"].append(n)
                    rows["ids_crc32"].append(zlib.crc32(raw[at : at + n].tobytes()))
                    at += n
            held.clear()
            return batch(schema, **rows)

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in ("part", "begin", "doc_ids", "counts", "blocks")), strict=True):
                held.append(row)
                size += sum(row[3])
                if size >= BLOCK * LANES:
                    yield give()
                    size = 0
        if held:
            yield give()

    return mapped(records.select("part", "begin", "doc_ids", "counts", "blocks"), run, "doc_id long, start long, n_tokens long, ids_crc32 long", "token_store")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(stash(write_records(documents(spark, sf_dir), vocabulary_path()), "tokens"))
