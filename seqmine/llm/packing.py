"""Packing documents into training sequences with best-fit decreasing.

Documents are encoded, ended with an id, and cut into full windows; what remains of each is shorter than a
window.  The remains of a group of documents are placed from the longest to the shortest, each in the
fullest open sequence that still has room.  Room is a number up to the window, so a segment tree over it answers
"smallest room of at least n that some sequence has" in log2(window) steps.  Sequences of a group that cannot
be filled are closed without padding: a sequence whose length is a power of two needs none, so the last few
are cut along the binary digits of what they hold.

Each task packs the documents it reads, in groups of bounded size: nothing is shuffled, and a group's
unfilled rest is small against it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmine.llm.storage import give_back
from seqmine.llm.tokens import default_tokenizer, encoder, text_batches

WINDOW = 2048
#: Ids a task gathers before it packs them (16 MB); more means less padding and more memory.
GROUP_TOKENS = 1 << 22


class RoomTree:
    """Open sequences by the room they have left; finds the tightest fit."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, sequence: int, room: int) -> None:
        if room > 0:
            self.open[room].append(sequence)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (sequence, room) with the smallest room of at least ``need``."""
        at = need + self.size
        if not self.count[at]:
            while at & 1 or not self.count[at + 1]:  # up, until a right neighbour holds something
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.size:  # down, to its leftmost leaf
                at = 2 * at + (not self.count[2 * at])
        room = at - self.size
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """For each piece its sequence and offset, and the fill of each sequence."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    tree, fill = RoomTree(window), []
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for k in order:
        n = lengths[k]
        found = tree.take(n) if n < window else None
        if found is None:
            s, room = len(fill), window
            fill.append(0)
        else:
            s, room = found
        sequence[k], offset[k] = s, fill[s]
        fill[s] += n
        tree.put(s, room - n)
    return sequence, offset, fill


def _settle(pieces: list[tuple], fill: list[int], window: int) -> list[tuple]:
    """Cuts the content of unfilled sequences: it fills whole windows, the rest goes by its binary digits.

    ``pieces``: (row, start, length, sequence, offset).  Returns the same with final sequences and offsets.
    """
    loose = [s for s, n in enumerate(fill) if n & (n - 1)]
    # Nearly full ones stay as they are: cutting documents for a few ids costs more than the padding.
    loose = {s for s in loose if (window - fill[s]) * 64 > window}
    kept = [p for p in pieces if p[3] not in loose]
    total = sum(fill[s] for s in loose)
    sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if total % window >> b & 1]
    target, at, number = 0, 0, len(fill)
    for row, start, length, _, _ in sorted((p for p in pieces if p[3] in loose), key=lambda p: (p[3], p[4])):
        while length:
            n = min(length, sizes[target] - at)
            kept.append((row, start, n, number + target, at))
            start, length, at = start + n, length - n, at + n
            if at == sizes[target]:
                target, at = target + 1, 0
    return kept


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1,
         tokenizer: str | None = None, group_tokens: int = GROUP_TOKENS, keep_units: bool = True) -> DataFrame:
    """One row per piece: key, ``start`` (ids of its document before it), ``length``, ``ids`` (little-endian 32-bit),
    ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset`` in the sequence.

    ``window`` is a power of two.  A null text is empty and gives its end id alone; a null key stays null; repeated rows
    are packed each; an empty table gives no rows; other columns are not read.  Sequence ids are unique, not
    consecutive: the task's number, then the sequence's.  Without ``keep_units`` a task empties its worker's table of units at its end:
    slower, and leaves the memory to other stages.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    path = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    schema = (f"{key} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    end = np.array([end_id], dtype="<u4").tobytes()

    def flush(keys: list, kind_of_key: pa.DataType, ids: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        whole, rest = [], []
        for k, data in enumerate(ids):
            n = len(data) // 4
            cut = n - n % window
            whole += [(k, s) for s in range(0, cut, window)]
            if n > cut:
                rest.append((k, cut, n - cut))
        sequence, offset, fill = best_fit_decreasing([r[2] for r in rest], window)
        pieces = [(k, s, n, sequence[j], offset[j]) for j, (k, s, n) in enumerate(rest)]
        pieces = _settle(pieces, fill, window)
        used = max((p[3] for p in pieces), default=-1) + 1
        pieces += [(k, s, window, used + j, 0) for j, (k, s) in enumerate(whole)]
        columns = [pa.array([keys[p[0]] for p in pieces], kind_of_key), pa.array([p[1] for p in pieces], pa.int64()),
                   pa.array([p[2] for p in pieces], pa.int64()),
                   pa.array([ids[p[0]][4 * p[1]:4 * (p[1] + p[2])] for p in pieces], pa.binary()),
                   pa.array([len(ids[p[0]]) // 4 for p in pieces], pa.int64()),
                   pa.array([first + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64())]
        names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays(columns, names), first + used + len(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        first = TaskContext.get().partitionId() << 40
        keys, ids, size, kind_of_key = [], [], 0, None
        for batch in batches:
            kind_of_key = batch.column("k").type
            names, texts = batch.column("k").to_pylist(), batch.column("t").to_pylist()
            for part in text_batches(texts):
                found = [i + end for i in enc.encode(texts[part])]
                keys += names[part]
                ids += found
                size += sum(map(len, found)) // 4
                if size >= group_tokens:
                    out, first = flush(keys, kind_of_key, ids, first)
                    keys, ids, size = [], [], 0
                    yield out
        if keys:
            yield flush(keys, kind_of_key, ids, first)[0]
        if not keep_units:
            keys, ids = [], []
            enc.forget()
            give_back()

    return rows.mapInArrow(run, schema)
