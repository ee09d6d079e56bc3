r"""Byte-level BPE encoding and decoding with forced-boundary splitting.

The vocabulary and merges come from a public tokenizer file whose path is a parameter. A
byte pair that occurs inside no vocabulary token can never be inside a merge's result, so
every place where such a pair stands is a certain cut. Encoding is: cut out special
tokens, pre-tokenise, cut at forced boundaries, merge each fragment by itself, and
concatenate. A fragment's ids depend on nothing else, so they are remembered.

Most texts are words with one space or line break between, and there the pre-tokeniser's
pattern always begins a new token before the space; such texts are cut at spaces first and
whole words are remembered. Texts with other white space go through the pattern whole.

Memory: words are remembered in two generations of ``CACHE`` entries, of which the older one
goes when the younger is full, and fragments up to ``FRAGMENTS``; a fragment of any length
merges in n log n time with a heap. Nothing is shuffled, and a worker that goes on to
another operator drops all of it.

Defined results: a null text counts as empty and has no ids; a text of any length is encoded
whole; repeated rows give equal rows, and ties don't arise; an empty table gives no row; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import string

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import batch, documents, mapped, small_batches, texts, worker_cache

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker remembers in each of two generations, and fragments.
CACHE, FRAGMENTS = 150_000, 60_000
#: Marks that may end a word: with others of their kind they are one token of the pre-tokeniser.
MARKS = string.punctuation
#: Fragments up to so many bytes merge by a plain scan, longer ones with a heap.
SCAN = 48

#: A merge is its rank times 2**24 plus the id it makes.
_ID, _NONE = (1 << 24) - 1, 1 << 62

#: The byte-level pre-tokeniser's pattern (fixed value of the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for
    itself, the other bytes in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary with its merges and forced boundaries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model = byte_letters(), file["model"]
        self.specials = {x["content"]: x["id"] for x in file["added_tokens"]}
        spelled = {k: bytes(letters[c] for c in k) for k in model["vocab"] if k not in self.specials}
        size = max([*model["vocab"].values(), *self.specials.values()]) + 1
        self.bytes = [b""] * size
        for k, i in model["vocab"].items():
            self.bytes[i] = spelled[k] if k in spelled else k.encode()
        for k, i in self.specials.items():
            self.bytes[i] = k.encode()
        self.of_byte = [0] * 256
        for k, b in spelled.items():
            if len(b) == 1:
                self.of_byte[b[0]] = model["vocab"][k]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((model["vocab"][left], model["vocab"][right]), rank << 24 | model["vocab"][left + right])
        inside = {b[i : i + 2] for b in spelled.values() for i in range(len(b) - 1)}
        #: Pairs that are no cut, as a table over both bytes.
        self.joins = np.zeros((256, 256), bool)
        for a, b in inside:
            self.joins[a, b] = True
        self.inside = inside
        self.decimal = [str(i) for i in range(size)]
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.split = regex.compile(PATTERN).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.fragments: dict[bytes, tuple[int, ...]] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def cut(self, piece: bytes) -> list[bytes]:
        """``piece`` in fragments, cut at each byte pair that no vocabulary token has inside."""
        if len(piece) < 64:
            inside = self.inside
            at = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in inside]
        else:
            x = np.frombuffer(piece, np.uint8)
            at = (np.flatnonzero(~self.joins[x[:-1], x[1:]]) + 1).tolist()
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)] if at else [piece]

    def merge(self, fragment: bytes) -> tuple[int, ...]:
        """The ids of one fragment: the lowest-ranked pair merges first, leftmost of equals."""
        ids = [self.of_byte[b] for b in fragment]
        if len(ids) > SCAN:
            return self._merge_heap(ids)
        get, none = self.merges.get, _NONE
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = best & _ID
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return tuple(ids)

    def _merge_heap(self, ids: list[int]) -> tuple[int, ...]:
        get, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j, new = after[i], m & _ID
            if ids[i] < 0 or j < 0 or get((ids[i], ids[j])) != m:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (m := get((new, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (m, i))
            if before[i] >= 0 and (m := get((ids[before[i]], new))) is not None:
                heapq.heappush(heap, (m, before[i]))
        return tuple(x for x in ids if x >= 0)

    def _ids(self, text: str) -> bytes:
        """Ids of a text without special tokens, through the pattern, as packed integers."""
        out: list[int] = []
        known = self.fragments
        for piece in [text] if text.isalpha() or (text[:1] == " " and text[1:].isalpha()) else self.split(text):
            for fragment in self.cut(piece.encode()):
                ids = known.get(fragment)
                if ids is None:
                    ids = self.merge(fragment)
                    if len(fragment) <= 64:
                        if len(known) >= FRAGMENTS:
                            known.clear()
                        known[fragment] = ids
                out += ids
        return np.array(out, self.dtype).tobytes()

    def _plain(self, text: str) -> bytes:
        if "\n\n" in text or "  " in text:
            return self._ids(text)
        pieces = text.replace("\n", " \n").split(" ")
        head = pieces[0]
        begin = self.first.get(head)
        if begin is None:
            if head[-1:].isspace():
                return self._ids(text)
            begin = self._ids(head)
            if len(head) <= 64:
                if len(self.first) >= FRAGMENTS // 4:
                    self.first.clear()
                self.first[head] = begin
        out = list(map(self.words.get, pieces[1:]))
        if None in out:
            at = -1
            for _ in range(out.count(None)):
                at = out.index(None, at + 1)
                out[at] = self._word(pieces[at + 1])
                if out[at] is None:
                    return self._ids(text)
        return begin + b"".join(out)

    def _word(self, p: str) -> bytes | None:
        """Ids of what stands between two spaces, the first of which counts to it, or a line break
        does; None if it begins or ends in other white space. Marks after letters are a
        token of their own, so a word and its marks are remembered apart."""
        ids = self.words.get(p)
        if ids is not None:
            return ids
        ids = self.old.get(p)
        if ids is None:
            core = p.rstrip(MARKS)
            if len(core) < len(p) and core.isalpha():
                return self._word(core) + self._ids(p[len(core) :])
            if not p or (p[-1].isspace() and p != "\n") or (p[0].isspace() and (p[0] != "\n" or p[1:2].isspace())):
                return None
            ids = self._ids(p if p[0] == "\n" else " " + p)
        if len(p) <= 64:
            if len(self.words) >= CACHE:
                self.old, self.words = self.words, {}
            self.words[p] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``; special tokens' strings give their ids."""
        if self.special and any(x in text for x in self.specials):
            parts = self.special.split(text)
            packed = b"".join(np.array([self.specials[x]], self.dtype).tobytes() if i % 2 else self._plain(x) if x else b"" for i, x in enumerate(parts))
        else:
            packed = self._plain(text) if text else b""
        return np.frombuffer(packed, self.dtype)

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def load(path: str) -> ByteBPE:
    """The vocabulary of ``path``, built once in a worker."""
    known = worker_cache("bpe")
    if path not in known:
        known[path] = ByteBPE(path)
    return known[path]


_OUT = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` on demand.

    Hashes are of the decimal ids joined by commas, and of the UTF-8 of the text decoded
    from the ids.
    """
    small_batches(docs.sparkSession)
    out = [("doc_id", pa.int64(), "long"), *([("ids", pa.list_(pa.int32()), "array<int>")] if with_ids else []), *_OUT]
    schema = pa.schema([(a, b) for a, b, _ in out])

    def run(batches):
        bpe = load(path)
        sha = hashlib.sha256
        for b in batches:
            rows: dict[str, list] = {x: [] for x in ("n_tokens", "ids_sha256", "decoded_sha256")}
            every = []
            for t in texts(b.column(1)):
                packed = bpe.encode(t)
                ids = packed.tolist()
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(sha(",".join([bpe.decimal[i] for i in ids]).encode()).hexdigest())
                rows["decoded_sha256"].append(sha(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    every.append(packed)
            if with_ids:
                ends = np.cumsum([0, *map(len, every)], dtype=np.int32)
                flat = np.concatenate(every).astype(np.int32) if every else np.zeros(0, np.int32)
                rows["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield batch(schema, doc_id=b.column(0), **rows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, run, ", ".join(f"{a} {c}" for a, _, c in out), "bpe")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), vocabulary_path())
