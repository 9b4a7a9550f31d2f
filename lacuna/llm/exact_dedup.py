"""Exact duplicates by Patricia tries that own texts.

Every task of the scan puts the whole bytes of its texts into a compressed radix trie; a terminal
node holds how many rows ended there and their keeper, the least or greatest identifier. What the
task sends on is one row per distinct text, so a text that a third of all rows share crosses the
shuffle once per task. Rows are dealt by byte length and content hash and sorted by length, hash and
bytes; the owning tasks merge them in a trie per length and hash. A trie that outgrows its budget
spills by subtree: on the scan side its subtrees leave as partial counts, on the owning side the
subtrees left of the last insertion, which sorted input can no longer reach, leave as final rows.
Neither side needs a disk of its own.

Texts are equal when their bytes are; the hash only deals them out, and two texts with one hash stay
two nodes. The owner of a text is found again by length and SHA-256; the job fails if two different
texts ever share both. NULL counts as the empty text, or is changed by ``normal`` first. Rows may
repeat. NULL identifiers never own a text that has another; a group of only NULLs has a NULL keeper,
and all its rows count as kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import documents, keep, small_batches, table

BUDGET = 48 << 20
NODE_BYTES = 200


class Node:
    __slots__ = ("edge", "below", "owner", "rows")

    def __init__(self, edge: bytes):
        self.edge = edge
        self.below: dict[int, Node] = {}
        self.owner: int | None = None
        self.rows = 0


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving the range that may differ."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Trie:
    """A compressed radix trie of byte strings; ``better`` picks the keeper of two identifiers."""

    def __init__(self, better: Callable = min, budget: int = BUDGET):
        self.better = better
        self.budget = budget
        self.root = Node(b"")
        self.held = 0

    def add(self, key: bytes, owner: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                child = Node(key[at:])
                self.held += len(child.edge) + NODE_BYTES
                node.below[key[at]] = child
                node, at = child, len(key)
                break
            edge = child.edge
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            n = shared_prefix(edge, key[at : at + len(edge)])
            middle = Node(edge[:n])
            child.edge = edge[n:]
            middle.below[child.edge[0]] = child
            node.below[key[at]] = middle
            self.held += NODE_BYTES
            node, at = middle, at + n
        node.rows += rows
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)

    def terminals(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """(key, owner, rows) of all texts at and below ``node``, whose key is ``prefix``."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.rows:
                yield prefix, node.owner, node.rows
            stack += [(c, prefix + c.edge) for c in node.below.values()]

    def all(self) -> Iterator[tuple[bytes, int | None, int]]:
        yield from self.terminals(self.root, b"")
        self.root, self.held = Node(b""), 0

    def cost(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + NODE_BYTES
            stack += node.below.values()
        return total

    def spill(self, path: bytes | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """Empty subtrees until half the budget is held: any of them, or those left of ``path``."""
        node, prefix, at = self.root, b"", 0
        while node is not None and self.held > self.budget // 2:
            onward = None if path is None or at >= len(path) else path[at]
            for first in sorted(node.below):
                if onward is not None and first >= onward:
                    break
                if path is not None and onward is None:
                    break
                child = node.below.pop(first)
                self.held -= self.cost(child)
                yield from self.terminals(child, prefix + child.edge)
                if self.held <= self.budget // 2:
                    return
            if path is None:
                return
            if node.rows and onward is not None:  # a shorter text on the path itself is past as well
                yield prefix, node.owner, node.rows
                node.rows, node.owner = 0, None
            node = node.below.get(onward) if onward is not None else None
            if node is not None:
                prefix, at = prefix + node.edge, at + len(node.edge)


def _rows(found, lengths: list, hashes: list, texts: list, owners: list, rows: list) -> None:
    for (length, value), (key, owner, n) in found:
        lengths.append(length)
        hashes.append(value)
        texts.append(key)
        owners.append(owner)
        rows.append(n)


def partial_owners(docs: DataFrame, content_hash: Column, keeper: str, budget: int = BUDGET) -> DataFrame:
    """Per task one row per distinct text: length, hash, bytes, keeper, rows."""

    def combine(batches):
        better = max if keeper == "max" else min
        trie = Trie(better, budget)

        def batch_of(found) -> Iterator[pa.RecordBatch]:
            rows: list = []
            size = 0
            for key, owner, n in found:
                rows.append((int.from_bytes(key[:8], "big"), int.from_bytes(key[8:16], "big", signed=True), key[16:], owner, n))
                size += len(key)
                if size > 4 << 20 or len(rows) >= 1000:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

        def made(rows: list) -> pa.RecordBatch:
            length, value, text, owner, n = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(length, pa.int64()), pa.array(value, pa.int64()), pa.array(text, pa.binary()), pa.array(owner, pa.int64()), pa.array(n, pa.int64())],
                names=["length", "hash", "bytes", "owner", "n"],
            )

        for batch in batches:
            ids, values, texts = (batch.column(c).to_pylist() for c in ("doc_id", "hash", "bytes"))
            for i, h, t in zip(ids, values, texts):
                trie.add(len(t).to_bytes(8, "big") + h.to_bytes(8, "big", signed=True) + t, i)
                if trie.held > budget:
                    yield from batch_of(trie.spill())
        yield from batch_of(trie.all())

    rows = docs.select("doc_id", content_hash.cast("long").alias("hash"), F.col("text").cast("binary").alias("bytes"))
    return rows.mapInArrow(combine, "length long, hash long, bytes binary, owner long, n long")


def owners(partial: DataFrame, keeper: str, budget: int = BUDGET) -> DataFrame:
    """One row per distinct text: length, text_sha256, keep_id, group_size."""

    def merge(batches):
        better = max if keeper == "max" else min
        trie, bucket, seen = Trie(better, budget), None, {}

        def final(found) -> Iterator[pa.RecordBatch]:
            rows = [(bucket[0], hashlib.sha256(key).hexdigest(), owner, n) for key, owner, n in found]
            for _, digest, _, _ in rows:
                if digest in seen:
                    raise RuntimeError("two texts share their length and digest")
                seen[digest] = True
            if rows:
                length, digest, owner, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(length, pa.int64()), pa.array(digest), pa.array(owner, pa.int64()), pa.array(n, pa.int64())],
                    names=["length", "text_sha256", "keep_id", "group_size"],
                )

        def gathered():
            nonlocal bucket, seen
            for batch in batches:
                for length, value, text, owner, n in zip(*(batch.column(c).to_pylist() for c in ("length", "hash", "bytes", "owner", "n"))):
                    if bucket != (length, value):
                        if bucket is not None:
                            yield from final(trie.all())
                        bucket, seen = (length, value), {}
                    trie.add(text, owner, n)
                    if trie.held > budget:
                        yield from final(trie.spill(text))
            if bucket is not None:
                yield from final(trie.all())

        out: list = []
        for piece in gathered():
            out.append(piece)
            if len(out) >= 1000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    dealt = partial.repartition("length", "hash").sortWithinPartitions("length", "hash", "bytes")
    return dealt.mapInArrow(merge, "length long, text_sha256 string, keep_id long, group_size long")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keeper: str = "min", normal: Callable[[Column], Column] | None = None, content_hash: Callable[[Column], Column] = F.xxhash64, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keeper``: "min" or "max", which identifier of a group stays. ``normal`` changes texts before
    they are compared. ``content_hash`` deals texts out; any function gives the same result.
    """
    small_batches(df.sparkSession)
    docs = documents(df, id_col, text_col)
    if normal is not None:
        docs = docs.withColumn("text", normal(F.col("text")))
    found = keep(owners(partial_owners(docs, content_hash(F.col("text")), keeper, budget), keeper, budget), "owners")
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("length"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return rows.join(found, ["length", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner of the text of every document; the greatest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keeper="max")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
