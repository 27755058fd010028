"""Exact dedup with Patricia-trie owners.

Texts are compared after every run of `[\\x20\\x09-\\x0D]` became one space. Each scan partition first folds its own
copies in a compressed radix trie and passes on one row for each different text, so a text that a third of all rows
hold costs one row for each partition. These rows are dealt by (byte length, SHA-256); every partition inserts the full byte strings
into tries whose terminal nodes hold the smallest identifier. A trie over its memory budget spills its largest
subtree to a task-local file, which is read back as a trie of its own. Documents learn their owner by an equi join
on (length, hash), which AQE splits where one text is hot.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import row_key, squeeze

#: Bytes of labels and nodes that a trie may hold before it spills a subtree.
MEMORY = 96 << 20
NODE_BYTES = 250


class Node:
    __slots__ = ("label", "children", "value", "file")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value, self.file = label, {}, value, None


def shared_length(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of `a` stand in `b` from `at` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def merged(a: tuple, b: tuple) -> tuple:
    """(smallest id or None, rows, mark) of two entries for one text."""
    ids = [x for x in (a[0], b[0]) if x is not None]
    return min(ids, default=None), a[1] + b[1], a[2]


class PatriciaTrie:
    """Compressed radix trie from byte strings to (smallest id, rows, mark); spills by subtree beyond `memory` bytes."""

    def __init__(self, memory: int = MEMORY):
        self.root, self.memory, self.held, self.spills = Node(b""), memory, 0, 0

    def insert(self, key: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((key[at:], value), node.file)
                return
            if at == len(key):
                node.value = value if node.value is None else merged(node.value, value)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], value)
                self.held += len(key) - at + NODE_BYTES
                break
            if not key.startswith(child.label, at):
                n = shared_length(child.label, key, at)
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = child = upper
                self.held += NODE_BYTES
            node, at = child, at + len(child.label)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """Moves the largest subtree below the first fork to a file of this task."""
        node = self.root
        while len(node.children) == 1 and (only := next(iter(node.children.values()))).file is None:
            node = only
        sizes = {k: self.weight(c) for k, c in node.children.items() if c.file is None}
        if not sizes:
            self.memory *= 2  # everything that can be spilled is; the markers alone fill the budget
            return
        chosen = node.children[max(sizes, key=sizes.get)]
        file = tempfile.TemporaryFile()
        self.write(chosen, b"", file)
        chosen.children, chosen.value, chosen.file = {}, None, file
        self.held -= max(sizes.values()) - len(chosen.label) - NODE_BYTES
        self.spills += 1

    @staticmethod
    def weight(top: Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            stack.extend(node.children.values())
        return total

    @staticmethod
    def write(top: Node, path: bytes, file) -> None:
        stack = [(top, path)]
        while stack:
            node, path = stack.pop()
            if node.file is not None:
                node.file.seek(0)
                for tail, value in records(node.file):
                    pickle.dump((path + tail, value), file)
                node.file.close()
            if node.value is not None:
                pickle.dump((path, node.value), file)
            stack.extend((c, path + c.label) for c in node.children.values())

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """All (text, value); the trie is used up."""
        stack = [(self.root, b"")]
        while stack:
            node, path = stack.pop()
            if node.value is not None:
                yield path, node.value
            if node.file is not None:
                below = PatriciaTrie(self.memory)
                node.file.seek(0)
                for tail, value in records(node.file):
                    below.insert(tail, value)
                node.file.close()
                for tail, value in below.items():
                    yield path + tail, value
            stack.extend((c, path + c.label) for c in node.children.values())


def records(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


_LOCAL = pa.schema([("id", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("hash", pa.string()), ("body", pa.binary())])
_OWNER = pa.schema([("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_bytes", pa.int64()), ("hash", pa.string())])


def _emit(trie: PatriciaTrie, with_body: bool) -> Iterator[pa.RecordBatch]:
    schema = _LOCAL if with_body else _OWNER
    rows: list[tuple] = []
    size = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for body, (low, n, mark) in trie.items():
        rows.append((low, n, len(body), mark, body) if with_body else (low, n, len(body), mark))
        size += len(body) * with_body + 64
        if size > 8 << 20:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _fold(batches: Iterator[pa.RecordBatch], memory: int, final: bool) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(memory)
    for b in batches:
        n = b.column("n_rows").to_pylist() if final else [1] * b.num_rows
        for i, k, h, body in zip(b.column("id").to_pylist(), n, b.column("hash").to_pylist(), b.column("body").to_pylist(), strict=True):
            trie.insert(body, (i, k, h))
        if not final and trie.held > memory // 2:  # a combiner may pass on what it has: owners are settled after the exchange
            yield from _emit(trie, True)
            trie = PatriciaTrie(memory)
    yield from _emit(trie, not final)


def owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row for each different text: n_bytes, hash (SHA-256 of the normal form), keep_id, group_size."""
    body = squeeze(F.col(text))
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.sha2(body, 256).alias("hash"), body.cast("binary").alias("body"))
    local = base.mapInArrow(partial(_fold, memory=memory, final=False), "id long, n_rows long, n_bytes long, hash string, body binary")
    dealt = local.repartition("n_bytes", "hash")
    return dealt.mapInArrow(partial(_fold, memory=memory, final=True), "keep_id long, group_size long, n_bytes long, hash string")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory: int = MEMORY, with_row_key: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, and row_key where asked for.

    A null text is empty, and all empty texts are equal. The owner is the smallest id that is not null. Rows that
    repeat the owner's id with the owner's text are one document told again: all are marked kept (`keep_rows` leaves
    one). If no row of a text has an id, keep_id is null and its rows are marked kept, as nothing can be preferred. An
    empty table gives no rows; other columns of the input are neither read nor returned.
    """
    body = squeeze(F.col(text))
    more = [row_key(F.col(doc_id), F.col(text)).alias("row_key")] if with_row_key else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("hash"), *more)
    joined = rows.join(owners(docs, doc_id, text, memory), ["n_bytes", "hash"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("hash").alias("text_sha256"), *(["row_key"] if with_row_key else []))
