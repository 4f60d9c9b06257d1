"""Exact deduplication with Patricia-trie owners.

Equal texts (after lower-casing A-Z) get one owner.  Every task first inserts
the full byte strings of its documents, each behind its length and SHA-256,
into a compressed radix trie, so a text that a third of all rows share leaves
a task once.  (The trie branches inside that prefix: texts that differ share
no beginnings in it.)  The terminals are dealt out by (length, content hash);
there they are merged in a trie again, whose terminal nodes store the smallest
and largest identifier and the number of copies.  As each partition arrives in
(length, hash) order, all that the order has passed is complete: beyond
``bound`` bytes the whole trie is spilled to the output and a new one begun.
Finally each document looks up its owner by (length, SHA-256).

Defined results: a null text is the empty text; rows without an identifier
never own a group that has one with an identifier (``keep_id`` is null only
where no copy has one); repeated rows are copies like any other, and
``kept`` is true on each row that carries ``keep_id``; an empty table gives
an empty result.  Two different texts of the same length and SHA-256 would
stop the job (the trie compares whole strings).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import batches_of, text_bytes

TRIE_BYTES = 64 << 20
_HEAD = 8 + 32  # length and SHA-256 before the text itself

_OWNERS = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("text", pa.binary()),
                     ("smallest", pa.int64()), ("largest", pa.int64()), ("copies", pa.int64())])
_MERGED = pa.schema([f for f in _OWNERS if f.name != "text"])
_KEYED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary())])


class _Node:
    __slots__ = ("edges", "owner")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.owner: list | None = None


def _shared_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


class RadixTrie:
    """Byte strings to [smallest id, largest id, number of copies]."""

    def __init__(self):
        self.root = _Node()
        self.held = 0

    def insert(self, key: bytes, smallest: int | None, largest: int | None, copies: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                child = _Node()
                node.edges[key[at]] = (key[at:], child)
                self.held += len(key) - at + 200
                node, at = child, len(key)
                break
            label, child = edge
            if not key.startswith(label, at):
                same = _shared_prefix(label, key[at:at + len(label)])
                middle = _Node()
                middle.edges[label[same]] = (label[same:], child)
                node.edges[key[at]] = (label[:same], middle)
                self.held += 200
                label, child = label[:same], middle
            node, at = child, at + len(label)
        if node.owner is None:
            node.owner = [smallest, largest, copies]
        else:
            owner = node.owner
            node.owner = [_least(owner[0], smallest), _most(owner[1], largest), owner[2] + copies]

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Depth first: keys that share a prefix come one after the other."""
        stack = [(b"", self.root)]
        while stack:
            key, node = stack.pop()
            if node.owner is not None:
                yield key, node.owner
            stack.extend((key + label, child) for label, child in node.edges.values())


def _key(text: bytes) -> bytes:
    return len(text).to_bytes(8, "big") + hashlib.sha256(text).digest() + text


def _first_owners(bound: int):
    def run(batches):
        def rows():
            trie = RadixTrie()
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
                    trie.insert(_key(text.lower()), doc, doc, 1)  # bytes.lower(): A-Z only
                    if trie.held > bound:
                        yield from spilled(trie)
                        trie = RadixTrie()
            yield from spilled(trie)

        def spilled(trie):
            for key, (smallest, largest, copies) in trie.items():
                yield len(key) - _HEAD, key[8:_HEAD], key[_HEAD:], smallest, largest, copies

        yield from batches_of(rows(), _OWNERS)

    return run


def _merge_owners(bound: int):
    def run(batches):
        def rows():
            trie, last = RadixTrie(), None
            for batch in batches:
                for n, digest, text, smallest, largest, copies in zip(*(c.to_pylist() for c in batch.columns)):
                    if trie.held > bound and (n, digest) != last:
                        yield from spilled(trie)  # the order has passed all of it
                        trie = RadixTrie()
                    last = n, digest
                    trie.insert(n.to_bytes(8, "big") + digest + text, smallest, largest, copies)
            yield from spilled(trie)

        def spilled(trie):
            head = None
            for key, owner in trie.items():
                if key[:_HEAD] == head:
                    raise ValueError("two texts of one length and SHA-256")
                head = key[:_HEAD]
                yield len(key) - _HEAD, key[8:_HEAD], *owner

        yield from batches_of(rows(), _MERGED)

    return run


def _keyed(batches):
    for batch in batches:
        texts = [x.lower() for x in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in texts], pa.int64()),
             pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())], schema=_KEYED)


def owners(docs: DataFrame, bound: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: length, SHA-256, smallest and largest id, copies."""
    first = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _first_owners(bound), "n_bytes long, digest binary, text binary, smallest long, largest long, copies long")
    dealt = first.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest")
    return dealt.mapInArrow(_merge_owners(bound), "n_bytes long, digest binary, smallest long, largest long, copies long")


def exact_dedup(docs: DataFrame, keep: str = "smallest", bound: int = TRIE_BYTES) -> DataFrame:
    """Per document: its owner (``keep``: smallest or largest id), the size of
    its group, whether it stays, and the SHA-256 of its normalised text."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest: {keep}")
    keyed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _keyed, "doc_id long, n_bytes long, digest binary")
    return keyed.join(owners(docs, bound), ["n_bytes", "digest"]).select(
        "doc_id",
        F.col(keep).alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col(keep)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
