r"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after replacing each run of ``[\x20\x09-\x0D]`` by one
space. Normalised texts are dealt out by length and content hash. Each partition inserts
the full byte strings into compressed radix tries, one trie a length; a terminal node
holds the smallest identifier and the number of rows. The same happens in each input
partition before the shuffle, so a text with a billion copies crosses the network once a
task at most.

Memory is bounded by spilling subtrees. Before the shuffle a trie over its budget gives
its largest subtree's owners downstream, where they meet again. After the shuffle rows
come sorted by length and hash, so whatever lies before the current hash is complete: there
the subtree that a trie over its budget spills is the whole trie, in its final form. Rows of
one text are one for each input task after the first pass; the join that marks all rows by
their owner is split by Spark where a text has very many (tests hold a hot text).

Defined results: a null text counts as empty; empty texts equal each other; a null
identifier never owns a group unless all of the group are null; a text of any length is one
key; repeated rows count as rows of their group; an empty table gives no row; other columns,
whatever their names, are ignored or, by :func:`drop_duplicates`, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import batch, documents, fresh, mapped, small_batches

#: Bytes of labels that one task's tries hold before they spill.
TRIE_BYTES = 48 << 20

_ROW = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
_ROW_SQL = "length long, digest binary, body binary, owner long, copies long"


class Node:
    """An edge label, children by first byte, and, at a terminal, owner, count and digest."""

    __slots__ = ("label", "children", "owner", "copies", "digest")

    def __init__(self, label: bytes):
        self.label, self.children, self.copies, self.owner, self.digest = label, None, 0, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """The number of bytes that label ``a`` shares with ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    if a[:high] == b[at : at + high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class Patricia:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, digest: bytes, owner: int | None, copies: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            children = node.children
            child = children.get(key[at]) if children else None
            if child is None:
                child = Node(key[at:])
                if children is None:
                    node.children = {}
                node.children[key[at]] = child
                self.held += len(child.label) + 200
                node = child
                break
            same = _common(child.label, key, at)
            if same < len(child.label):
                fork = Node(child.label[:same])
                child.label = child.label[same:]
                fork.children = {child.label[0]: child}
                node.children[key[at]] = fork
                self.held += 200
                child = fork
            node, at = child, at + same
        if owner is not None and (node.owner is None or owner < node.owner):
            node.owner = owner
        node.copies, node.digest = node.copies + copies, digest

    def items(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """Strings and their terminal nodes below ``top``, whose parents spell ``before``."""
        todo = [(top or self.root, before)]
        while todo:
            node, before = todo.pop()
            key = before + node.label
            if node.copies:
                yield key, node
            todo.extend((x, key) for x in (node.children or {}).values())

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """Give up the largest subtree below the first fork: its strings leave the trie."""
        node, before = self.root, b""
        while node.children and len(node.children) == 1 and not node.copies:
            (node, before) = (next(iter(node.children.values())), before + node.label)
        before += node.label
        weights = {k: sum(len(x.label) + 200 for x in _below(v)) for k, v in (node.children or {}).items()}
        if not weights:
            yield from self.items()
            self.root, self.held = Node(b""), 0
            return
        largest = max(weights, key=weights.get)
        top = node.children.pop(largest)
        self.held -= weights[largest]
        yield from self.items(top, before)


def _below(top: Node) -> Iterator[Node]:
    todo = [top]
    while todo:
        node = todo.pop()
        yield node
        todo.extend((node.children or {}).values())


def _rows(found: list[tuple[bytes, Node]]) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for key, node in found:
        part.append((key, node))
        size += len(key)
        if size > (8 << 20) or len(part) >= 4096:
            yield _as_batch(part)
            part, size = [], 0
    if part:
        yield _as_batch(part)


def _as_batch(part: list[tuple[bytes, Node]]) -> pa.RecordBatch:
    return batch(_ROW, length=[len(k) for k, _ in part], digest=[n.digest for _, n in part], body=[k for k, _ in part], owner=[n.owner for _, n in part], copies=[n.copies for _, n in part])


def _combine(budget: int):
    """Before the shuffle: the owners of one input partition, spilled by subtree."""

    def run(batches):
        trie = Patricia()
        for b in batches:
            for key, digest, owner, copies in zip(*(b.column(x).to_pylist() for x in ("body", "digest", "owner", "copies")), strict=True):
                trie.insert(key, digest, owner, copies)
                while trie.held > budget:
                    yield from _rows(list(trie.spill()))
        yield from _rows(trie.items())

    return run


def _owners(budget: int):
    """After the shuffle, in order of length and digest: whole owners, one row a text."""

    def run(batches):
        trie, length, last, out = Patricia(), None, None, pa.schema([x for x in _ROW if x.name != "body"])

        def flush():
            nonlocal trie
            found = [n for _, n in trie.items()]
            done, trie = [(n.digest, n.owner, n.copies) for n in found], Patricia()
            if len({x[0] for x in done}) != len(done):
                raise ValueError("two different texts have the same SHA-256")
            return done

        for b in batches:
            rows = []
            for n, key, digest, owner, copies in zip(*(b.column(x).to_pylist() for x in ("length", "body", "digest", "owner", "copies")), strict=True):
                if n != length or (trie.held > budget and digest != last):
                    rows += [(length, *x) for x in flush()]
                length, last = n, digest
                trie.insert(key, digest, owner, copies)
            yield batch(out, **dict(zip(("length", "digest", "owner", "copies"), map(list, zip(*rows, strict=True)) if rows else ([], [], [], []), strict=True)))
        rows = [(length, *x) for x in flush()]
        yield batch(out, **dict(zip(("length", "digest", "owner", "copies"), map(list, zip(*rows, strict=True)) if rows else ([], [], [], []), strict=True)))

    return run


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each different text: length, digest, owner (smallest identifier), copies."""
    small_batches(docs.sparkSession)
    body = docs.select(F.encode(normalised(F.col(text)), "UTF-8").alias("body"), F.col(doc_id).cast("long").alias("owner"))
    rows = body.select(F.octet_length("body").cast("long").alias("length"), F.unhex(F.sha2("body", 256)).alias("digest"), "body", "owner", F.lit(1).cast("long").alias("copies"))
    local = mapped(rows, _combine(trie_bytes), _ROW_SQL, "exact_dedup")
    dealt = local.repartition("length", "digest").sortWithinPartitions("length", "digest")
    return mapped(dealt, _owners(trie_bytes), "length long, digest binary, owner long, copies long", "exact_dedup")


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Where rows of a group share the smallest identifier, all of them count as kept.
    """
    own = owners(docs, doc_id, text, trie_bytes).select(F.lower(F.hex("digest")).alias("_dedup_sha"), F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.encode(normalised(F.col(text)), "UTF-8"), 256).alias("text_sha256"))
    return rows.join(own, rows.text_sha256 == own._dedup_sha).select("doc_id", "keep_id", "group_size", rows.doc_id.eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that own their text, with all columns; any one of rows with the owner's identifier and text stays.

    Rows meet their owners by text and identifier, so copies of one text spread over
    tasks; repeated rows are dropped where they met, so texts move once.
    """
    sha, key = fresh(docs, "dedup_sha", "dedup_id")
    name = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    own = owners(docs, doc_id, text).select(F.lower(F.hex("digest")).alias(sha), name(F.col("owner")).alias(key))
    rows = docs.withColumns({sha: F.sha2(F.encode(normalised(F.col(text)), "UTF-8"), 256), key: name(F.col(doc_id))})
    return rows.join(own, [sha, key], "left_semi").dropDuplicates([sha, key]).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
