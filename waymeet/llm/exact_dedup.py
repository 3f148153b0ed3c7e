"""Exact deduplication with compressed radix tries.

Every text is stripped of white space (the characters space and 0x09-0x0D). Tasks first fold the copies inside a
window of their own rows, so that a text that makes up a third of the corpus is shuffled once a window and not once a
row. The folded texts are dealt by (length, content hash); each partition inserts the full byte strings into a
Patricia trie, whose terminal nodes hold the smallest identifier, the one of the row that stays, and a count. Every
further row leaves at once as a link to the first of its string, so a trie takes no more memory for a string however
often it comes. A trie that outgrows its memory gives up its largest subtree: those strings go out unresolved and are
dealt again, finer, in another round.

Defined results: a null text is an empty one, and all empty texts are one group; a null doc_id sorts after every
number; of rows equal in text, length and doc_id exactly one is kept; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MANY_TASKS, corpus, discard, keep_rows, store, tasks_for, text_key, tune

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = (1 << 63) - 1

FOLDED = pa.schema(
    [
        ("rep", pa.int64()),
        ("norm_len", pa.int64()),
        ("content_hash", pa.int64()),
        ("body", pa.binary()),
        ("text_sha256", pa.string()),
        ("n_rows", pa.int64()),
        ("best_chars", pa.int64()),
        ("best_id", pa.int64()),
        ("best_at", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("keys", pa.list_(pa.int64())),
    ]
)
FOLDED_DDL = (
    "rep long, norm_len long, content_hash long, body binary, text_sha256 string, n_rows long, best_chars long, "
    "best_id long, best_at int, ids array<long>, keys array<long>"
)
LINKED_DDL = (
    "rep long, first long, group_size long, best_chars long, best_id long, best_rep long, best_at int, "
    "norm_len long, content_hash long, body binary, n_rows long"
)
#: Bytes that a node of the trie takes besides those on its edge, about.
NODE_BYTES = 400


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: What Python keeps for each different text of a window beside its bytes, and for each copy of one.
TEXT_BYTES, COPY_BYTES = 460, 80


def _fold(window_bytes: int):
    """Per task: one row for each distinct stripped text of a window of rows, with its rows' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        seen: dict[bytes, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at, seen, held
            rows: list[tuple] = []
            size = 0
            for body, (ids, keys, best) in seen.items():
                rows.append(
                    (
                        at,
                        len(body),
                        _signed(xxhash.xxh64_intdigest(body)),
                        body,
                        hashlib.sha256(body).hexdigest(),
                        len(ids),
                        -best[0],
                        None if best[1] == NO_ID else best[1],
                        best[2],
                        ids,
                        keys,
                    )
                )
                at += 1
                size += len(body)
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), FOLDED, strict=True)], schema=FOLDED)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), FOLDED, strict=True)], schema=FOLDED)
            seen, held = {}, 0

        for batch in batches:
            chars = pc.utf8_length(batch.column("text")).to_pylist()
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text, n, key in zip(
                batch.column("doc_id").to_pylist(), texts, chars, batch.column("text_key").to_pylist(), strict=True
            ):
                body = text.as_py().translate(None, WHITE)
                rank = (-n, NO_ID if doc_id is None else doc_id)
                old = seen.get(body)
                if old is None:
                    seen[body] = [[doc_id], [key], (*rank, 0)]
                    held += len(body) + TEXT_BYTES
                else:
                    old[2] = min(old[2], (*rank, len(old[0])))
                    old[0].append(doc_id)
                    old[1].append(key)
                    held += COPY_BYTES
            if held >= window_bytes:
                yield from flush()
        yield from flush()

    return run


class Owner:
    """What a terminal node holds of its string: the first row inserted, the best one so far, and how many rows there are."""

    __slots__ = ("first", "n_rows", "best")

    def __init__(self, first: int, n_rows: int, best: tuple) -> None:
        self.first, self.n_rows, self.best = first, n_rows, best

    def add(self, n_rows: int, best: tuple) -> None:
        self.n_rows += n_rows
        self.best = min(self.best, best)


class Node:
    """A node of the trie: the bytes on the edge above it, its children by first byte, and the owner of its string."""

    __slots__ = ("edge", "kids", "owner")

    def __init__(self, edge: bytes, owner: Owner | None = None) -> None:
        self.edge, self.kids, self.owner = edge, {}, owner


def _common(edge: bytes, body: bytes, at: int) -> int:
    """How many bytes of edge stand in body from position at."""
    low, high = 0, min(len(edge), len(body) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if body.startswith(edge[:mid], at) else (low, mid - 1)
    return low


class PatriciaOwners:
    """Compressed radix trie from byte strings to their owners."""

    def __init__(self) -> None:
        self.root = Node(b"", None)
        self.bytes_under: dict[int, int] = {}
        self.held = 0

    def _hold(self, first: int, size: int) -> None:
        self.bytes_under[first] = self.bytes_under.get(first, 0) + size
        self.held += size

    def insert(self, body: bytes, rep: int, n_rows: int, best: tuple) -> int:
        """Add n_rows rows of a string, the best of them with rank `best`; returns the row that came first."""
        node, at = self.root, 0
        while at < len(body):
            kid = node.kids.get(body[at])
            if kid is None:
                rest = body[at:]
                node.kids[body[at]] = Node(rest, Owner(rep, n_rows, best))
                self._hold(body[0], len(rest) + NODE_BYTES)
                return rep
            if body.startswith(kid.edge, at):
                node, at = kid, at + len(kid.edge)
                continue
            n = _common(kid.edge, body, at)
            fork = Node(kid.edge[:n])
            kid.edge = kid.edge[n:]
            fork.kids[kid.edge[0]] = kid
            node.kids[body[at]] = fork
            self._hold(body[0], NODE_BYTES)
            node, at = fork, at + n
        if node.owner is None:
            node.owner = Owner(rep, n_rows, best)
        else:
            node.owner.add(n_rows, best)
        return node.owner.first

    def walk(self, first: int | None = None) -> Iterator[tuple[bytes, Owner]]:
        """(string, owner) of every terminal, or of those under one child of the root."""
        todo = [(b"", self.root)] if first is None else [(b"", self.root.kids[first])]
        while todo:
            head, node = todo.pop()
            body = head + node.edge
            if node.owner:
                yield body, node.owner
            todo += ((body, kid) for kid in node.kids.values())

    def largest(self) -> int | None:
        """The root's child with most bytes, if it holds more than one string."""
        for first in sorted(self.bytes_under, key=self.bytes_under.get, reverse=True):
            if self.root.kids[first].kids:
                return first
        return None

    def drop(self, first: int) -> None:
        del self.root.kids[first]
        self.held -= self.bytes_under.pop(first)


def _own(trie_bytes: int):
    """Per partition: insert all strings. Rows out are links of folded texts to the first of their string, owners of
    strings (rep null), and strings to be dealt again (body not null)."""
    names = ["rep", "content_hash", "body", "n_rows", "best_chars", "best_id", "best_rep", "best_at"]
    kinds = {f.name: f.type for f in FOLDED} | {n: pa.int64() for n in ("first", "group_size", "best_rep")}
    out = pa.schema([(field.split()[0], kinds[field.split()[0]]) for field in LINKED_DDL.split(", ")])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def told(best: tuple) -> tuple:
        """best_chars, best_id, best_rep, best_at of a rank."""
        return -best[0], None if best[1] == NO_ID else best[1], best[2], best[3]

    def again(body: bytes, rep: int, n_rows: int, best: tuple) -> tuple:
        return (rep, None, None, *told(best), len(body), _signed(xxhash.xxh64_intdigest(body)), body, n_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, spilled = PatriciaOwners(), set()
        for batch in batches:
            ready, size = [], 0
            cols = [batch.column(n).to_pylist() for n in names]
            for rep, _, body, n, chars, best_id, best_rep, at in zip(*cols, strict=True):
                best = (-chars, NO_ID if best_id is None else best_id, best_rep, at)
                if body and body[0] in spilled:
                    ready.append(again(body, rep, n, best))
                    size += len(body)
                else:
                    first = trie.insert(body, rep, n, best)
                    if first != rep:
                        ready.append((rep, first, *[None] * 9))
                while trie.held > trie_bytes and (first := trie.largest()) is not None:
                    for text, owner in trie.walk(first):
                        ready.append(again(text, owner.first, owner.n_rows, owner.best))
                        size += len(text)
                        if size > 4 << 20:
                            yield table(ready)
                            ready, size = [], 0
                    trie.drop(first)
                    spilled.add(first)
            if ready:
                yield table(ready)
        ready = []
        for _, owner in trie.walk():
            ready.append((None, owner.first, owner.n_rows, *told(owner.best), None, None, None, None))
            if len(ready) >= 20_000:
                yield table(ready)
                ready = []
        if ready:
            yield table(ready)

    return run


def exact_groups(docs: DataFrame, *, window_bytes: int = 32 << 20, trie_bytes: int = 96 << 20, partition_bytes: int = 24 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    window_bytes: memory of what a task folds before it shuffles. partition_bytes: text dealt to one trie (tasks_for);
    trie_bytes: where a trie gives up a subtree.
    """
    spark = docs.sparkSession
    tune(spark)
    folded = store(corpus(docs).withColumn("text_key", text_key()).mapInArrow(_fold(window_bytes), FOLDED_DDL), "folded")
    members = store(folded.select("rep", "text_sha256", "ids", "keys"), "members")
    total = folded.agg(F.sum("norm_len")).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks_for(total, partition_bytes))
    todo = folded.withColumn("best_rep", F.col("rep")).select("rep", "norm_len", "content_hash", "body", "n_rows", "best_chars", "best_id", "best_rep", "best_at")
    owners, links, turn = None, [], 0
    while True:
        dealt = todo.repartition(n_parts, "norm_len", "content_hash", F.lit(turn))
        made = store(dealt.mapInArrow(_own(trie_bytes), LINKED_DDL), "owned")
        done = made.filter("rep is null").select("first", "group_size", "best_id", "best_rep", "best_at")
        owners = done if owners is None else owners.unionByName(done)
        links.append(made.filter("rep is not null and body is null").select("rep", "first"))
        todo = made.filter("body is not null").select(*todo.columns)
        if todo.isEmpty():
            break
        n_parts, turn = max(n_parts, min(n_parts * 8, MANY_TASKS)), turn + 1
    discard(folded)
    # a string dealt again goes on under the row that came first, so each turn's links lead to rows of the next
    named = members
    for k, link in enumerate(links):
        link = link.select(F.col("rep").alias("from"), F.col("first").alias("to"))
        at = "rep" if k == 0 else "first"
        named = named.join(link, named[at] == F.col("from"), "left").withColumn("first", F.coalesce("to", at)).drop("from", "to")
    return (
        named.join(owners, "first")
        .select("rep", "text_sha256", "best_rep", "best_at", "best_id", "group_size", F.posexplode(F.arrays_zip("ids", "keys")).alias("at", "m"))
        .select(
            F.col("m.ids").alias("doc_id"),
            F.col("best_id").alias("keep_id"),
            "group_size",
            ((F.col("rep") == F.col("best_rep")) & (F.col("at") == F.col("best_at"))).alias("kept"),
            "text_sha256",
            F.col("m.keys").alias("text_key"),
        )
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return keep_rows(docs, exact_groups(docs).filter("kept"), "left_semi", one_each=True)
