"""Packing of tokenised documents into sequences of bounded length.

A task reads its rows in order, tokenises them and packs one window of pieces after another: best fit by falling
length, then a local search over the underfull sequences that moves single pieces and exchanges one for one or two for
one until no trade raises the sum of squared fills, so that fills drift apart and sequences empty. Full sequences leave
at the end of a window; of the others the emptiest are taken apart again and their pieces, up to half a window, carried
into the next, so a task leaves about one partly filled sequence. Nothing is shuffled: the pieces of a sequence come
from one task and leave it together.

Only documents longer than a sequence are cut; the first piece takes the remainder, the others are full.

Defined results: a null text is an empty one and packs its end token alone; a null doc_id stays null; repeated rows
are packed as often as they occur; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import corpus, tune

#: The pre-tokenising pattern of byte-level BPE files that state no other (a fixed value of the format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
PIECES_DDL = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def byte_level_bytes() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The characters of Unicode's White_Space property (a fixed value), and how many in a row are encoded by themselves.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 500
_run = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")


def bpe_encoder(spec: str) -> Callable[[str], np.ndarray]:
    """text -> ids (unsigned 32-bit) by a byte-level BPE file of the tokenizers library (its JSON text), as that library gives them.

    Where ids follow merge order the merges are a rank table, and tiktoken gives the same ids several times faster; any
    other file is read by tokenizers itself. Strings of the file's special tokens become their ids, as is the default of
    tokenizers; no others are added.
    """
    given = json.loads(spec)
    pre, model, added = given.get("pre_tokenizer") or {}, given["model"], given.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in added}
    vocab = {k: v for k, v in model.get("vocab", {}).items() if k not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and given.get("normalizer") is None
        and not model.get("ignore_merges")
        and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        and len(pairs) + 256 == len(vocab)
        and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
    )
    if not plain:
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        return lambda text: np.array(made.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    of = byte_level_bytes()
    ranks = {bytes(of[c] for c in k): v for k, v in vocab.items()}
    bpe = tiktoken.Encoding("bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    names = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def ordinary(text: str) -> list[np.ndarray]:
        """Between special tokens. The pattern takes a run of white space but its last character (all of it at the end)
        for one word, and its matcher needs stack for each character, so long runs are encoded on their own."""
        out, at = [], 0
        for run in _run.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))
            out.append(bpe.encode_to_numpy(text[at : run.start()], disallowed_special=()))
            out.append(np.array(bpe._encode_single_piece(text[run.start() : end]), np.uint32))
            at = end
        return [*out, bpe.encode_to_numpy(text[at:], disallowed_special=())]

    def encode(text: str) -> np.ndarray:
        out, at = [], 0
        for mark in names.finditer(text) if names else ():
            out += [*ordinary(text[at : mark.start()]), np.array([special[mark[0]]], np.uint32)]
            at = mark.end()
        out += ordinary(text[at:])
        return out[0] if len(out) == 1 else np.concatenate(out)

    return encode


@dataclass
class Bins:
    """Sequences being filled: their pieces and the room left in each."""

    room: list[int]
    items: list[list[int]]


def best_fit(sizes: list[int], capacity: int) -> Bins:
    """Each size, largest first, into the fullest bin that has room for it."""
    bins, open_ = Bins([], []), []  # open_: (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(open_, (sizes[i], -1))
        if at < len(open_):
            room, b = open_.pop(at)
        else:
            room, b = capacity, len(bins.room)
            bins.room.append(capacity)
            bins.items.append([])
        bins.items[b].append(i)
        bins.room[b] = room - sizes[i]
        if bins.room[b]:
            bisect.insort(open_, (bins.room[b], b))
    return bins


class _Search:
    """The underfull bins of a packing, with arrays over their pieces and over the pairs of pieces of one bin."""

    def __init__(self, bins: Bins, sizes: list[int]) -> None:
        self.bins = bins
        self.size = np.array(sizes, np.int64)
        self.room = np.array(bins.room, np.int64)
        self.bin_of = np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins.items):
            self.bin_of[items] = b
        self.under = np.array([b for b, items in enumerate(bins.items) if items and bins.room[b]], np.int64)
        self.pieces = np.array([i for b in self.under for i in bins.items[b]], np.int64)
        self.pairs_of: dict[int, np.ndarray] = {}
        self._pairs: np.ndarray | None = None

    def bin_pairs(self, b: int) -> np.ndarray:
        """Rows (first, second, sum) of pairs of pieces of bin b, one for each sum."""
        if b not in self.pairs_of:
            items = np.array(self.bins.items[b], np.int64)
            p, q = np.triu_indices(len(items), 1)
            total = self.size[items[p]] + self.size[items[q]]
            _, one = np.unique(total, return_index=True)
            self.pairs_of[b] = np.stack([items[p[one]], items[q[one]], total[one]], axis=1)
        return self.pairs_of[b]

    def pairs(self) -> np.ndarray:
        if self._pairs is None:
            self._pairs = np.concatenate([self.bin_pairs(b) for b in self.under.tolist()])
        return self._pairs

    def best(self, donor: int, out: int, back: np.ndarray, to: np.ndarray) -> tuple[int, int] | None:
        """Of trades that give bin to[k] the size `out` from donor for back[k]: (room left there, k) of the fullest result.

        A gain g raises the sum of squared fills exactly if it is more than the fill that donor has above the other bin.
        """
        room = self.room[to]
        gain = out - back
        good = np.flatnonzero((gain > np.maximum(0, room - self.room[donor])) & (gain <= room) & (to != donor))
        if not len(good):
            return None
        k = int(good[np.argmin((room - gain)[good])])
        return int(room[k] - gain[k]), k

    def trade(self, donor: int) -> bool:
        """Make the best move or exchange of a piece of donor, or else of two, that raises the sum of squared fills."""
        items = self.bins.items[donor]
        where = self.bin_of[self.pieces]
        found = None
        for i in sorted(items, key=lambda i: (-self.size[i], i)):
            tries = [
                (self.best(donor, self.size[i], np.zeros(len(self.under), np.int64), self.under), lambda k: (self.under[k], [])),
                (self.best(donor, self.size[i], self.size[self.pieces], where), lambda k: (where[k], [self.pieces[k]])),
            ]
            if not any(t for t, _ in tries):
                pairs = self.pairs()
                tries.append((self.best(donor, self.size[i], pairs[:, 2], self.bin_of[pairs[:, 0]]), lambda k, pairs=pairs: (self.bin_of[pairs[k, 0]], pairs[k, :2].tolist())))
            for t, say in tries:
                if t and (found is None or t[0] < found[0]):
                    found = (t[0], [i], *say(t[1]))
            if found and found[0] == 0:
                break
        if found is None:
            for i, h, total in self.bin_pairs(donor).tolist():
                t = self.best(donor, total, self.size[self.pieces], where)
                if t and (found is None or t[0] < found[0]):
                    found = (t[0], [i, h], where[t[1]], [self.pieces[t[1]]])
        if found is None:
            return False
        _, out, to, back = found
        self.shift(donor, int(to), out, [int(j) for j in back])
        return True

    def shift(self, donor: int, to: int, out: list[int], back: list[int]) -> None:
        """Pieces out go from donor to another bin, pieces back return for them."""
        items = self.bins.items
        items[to] = [i for i in items[to] if i not in back] + out
        items[donor] = [i for i in items[donor] if i not in out] + back
        self.bin_of[out], self.bin_of[back] = to, donor
        gain = int(self.size[out].sum() - self.size[back].sum())
        for b, more in ((to, -gain), (donor, gain)):
            self.room[b] += more
            self.bins.room[b] = int(self.room[b])
            self.pairs_of.pop(b, None)
        self._pairs = None
        gone = [b for b in (to, donor) if not self.room[b] or not items[b]]
        if gone:  # full or empty
            self.under = self.under[~np.isin(self.under, gone)]
            self.pieces = self.pieces[~np.isin(self.bin_of[self.pieces], gone)]


def local_search(bins: Bins, sizes: list[int]) -> Bins:
    """Moves and exchanges, of one for one, one for two or two for one, between underfull bins until none raises the sum of squared fills.

    The emptiest bins give first. All pieces and pairs of all underfull bins are looked at, and every trade raises a
    bounded whole number, so the search ends, at a packing that no single trade betters.
    """
    search = _Search(bins, sizes)
    moved = True
    while moved:
        moved = False
        for donor in search.under[np.argsort(-search.room[search.under], kind="stable")].tolist():
            while bins.items[donor] and search.room[donor] and len(search.under) > 1 and search.trade(donor):
                moved = True
    return bins


def _pack(spec: str, capacity: int, end_id: int, window: int, search: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = bpe_encoder(spec)
        next_seq = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4")
        pieces: list[tuple] = []  # not longer than a sequence: doc_id, piece, start, ids
        full: list[tuple] = []
        held = 0

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

        def close(keep: int) -> Iterator[pa.RecordBatch]:
            """Pack what is held and let sequences go, the fullest first, until at most `keep` tokens are left and none is full."""
            nonlocal next_seq, pieces, held
            sizes = [len(p[3]) // 4 for p in pieces]
            bins = best_fit(sizes, capacity)
            if search:
                bins = local_search(bins, sizes)
            out, rest, size = [], [], 0
            for b in sorted((b for b, items in enumerate(bins.items) if items), key=lambda b: (bins.room[b], b)):
                if bins.room[b] and held <= keep:
                    rest += (pieces[i] for i in bins.items[b])
                    continue
                at = 0
                for i in bins.items[b]:
                    doc_id, piece, start, ids = pieces[i]
                    out.append((doc_id, piece, start, sizes[i], ids, next_seq, at))
                    at += sizes[i]
                    size += len(ids)
                held -= at
                next_seq += 1
                if size > 4 << 20:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)
            pieces = rest

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([encode(text.as_py()).astype("<u4", copy=False), end])
                head = len(ids) % capacity or capacity
                raw = ids.tobytes()
                if head < capacity:
                    pieces.append((doc_id, 0, 0, raw[: 4 * head]))
                    held += head
                for k, start in enumerate(range(0 if head == capacity else head, len(ids), capacity), int(head < capacity)):
                    full.append((doc_id, k, start, capacity, raw[4 * start : 4 * (start + capacity)], next_seq, 0))
                    next_seq += 1
                    if len(full) >= 1000:
                        yield rows(full)
                        full.clear()
                if held >= window:
                    yield from close(window // 2)
        if full:
            yield rows(full)
        if pieces:
            yield from close(-1)

    return run


def pack(docs: DataFrame, tokenizer: str | Path, *, capacity: int = 1024, end_id: int = 2, window: int = 1 << 20, search: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    tokenizer: a byte-level BPE file of the tokenizers library. window: tokens that a task packs at a time, apart from
    full sequences. search: whether best fit is followed by the local search.
    """
    tune(docs.sparkSession)
    return corpus(docs).mapInArrow(_pack(Path(tokenizer).read_text(), capacity, end_id, window, search), PIECES_DDL)
