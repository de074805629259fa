"""Packing of token ids into fixed-length training sequences, balanced by cost.

The cost of a piece of n tokens is estimated as linear * n + quadratic * n * n (the
feed-forward and the attention part). Each task gathers a bounded buffer of documents,
cuts off whole sequences from long ones and assigns what is left in order of descending
cost, always to the lowest-cost sequence that has room for all of it. Only where no
sequence has that room is a piece cut, at the lowest-cost sequence that has any; the rest
waits in its place by cost. Nothing is shuffled.

Of sequences of one cost the first opened is taken, of pieces of one length the last
come. Null texts count as empty; an empty document is its end id alone. Null or repeated
ids are carried as they are. An empty table gives an empty result. Extra columns are
ignored. A very long text is encoded whole and leaves the task piece by piece.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import crc_of, encoder, lots, trim

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class _Open:
    """Open sequences by the tokens they have left, to find the one of lowest cost with room."""

    NONE = (math.inf, 0, 0)

    def __init__(self, room: int, sequences: list[int]):
        self.size = 1 << room.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.size)]
        self.best = [self.NONE] * (2 * self.size)  # a binary tree over the rooms: the lowest (cost, sequence, room) below
        self.count = 0
        for s in sequences:
            self.put(0.0, s, room)

    def _renew(self, room: int) -> None:
        heap, at = self.heaps[room], room + self.size
        self.best[at] = heap[0] if heap else self.NONE
        while at > 1:
            at >>= 1
            self.best[at] = min(self.best[2 * at], self.best[2 * at + 1])

    def put(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence, room))
        self.count += 1
        if self.heaps[room][0][1] == sequence:
            self._renew(room)

    def take(self, tokens: int) -> tuple[float, int, int]:
        """The lowest-cost sequence with room for so many tokens, or else the lowest-cost one."""
        low, high, found = tokens + self.size, 2 * self.size, self.NONE
        while low < high:
            if low & 1:
                found = min(found, self.best[low])
                low += 1
            if high & 1:
                high -= 1
                found = min(found, self.best[high])
            low, high = low >> 1, high >> 1
        found = self.best[1] if found is self.NONE else found
        heapq.heappop(self.heaps[found[2]])
        self._renew(found[2])
        self.count -= 1
        return found


class Packer:
    """Packs (key, ids) into sequences of `room` tokens; memory holds one buffer of about `buffer` tokens."""

    def __init__(self, room: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, buffer: int = 2_000_000):
        self.room, self.linear, self.quadratic, self.buffer = room, linear, quadratic, buffer
        self.held: list[tuple] = []  # (key, whole length, start, ids)
        self.tokens = 0
        self.next_sequence = 0

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """Takes a document; yields (key, doc_tokens, start, ids, sequence, offset, cost)."""
        whole = len(ids) - len(ids) % self.room
        for start in range(0, whole, self.room):
            yield key, len(ids), start, ids[start : start + self.room], self._new(), 0, self.cost(self.room)
        if whole < len(ids):
            self.held.append((key, len(ids), whole, ids[whole:].copy()))
            self.tokens += len(ids) - whole
        if self.tokens >= self.buffer:
            yield from self._assign(self.tokens // self.room)

    def finish(self) -> Iterator[tuple]:
        """Packs the rest; its last tokens, too few for a sequence, go to sequences of powers of two, without padding."""
        yield from self._assign(self.tokens // self.room)
        size = self.room
        rest = sorted(self.held, key=lambda p: -len(p[3]))
        left = self.tokens
        while left:
            while size > left:
                size //= 2
            sequence, used = self._new(), 0
            while used < size:
                key, total, start, ids = rest.pop(0)
                part = ids[: size - used]
                yield key, total, start, part, sequence, used, self.cost(len(part))
                used += len(part)
                if len(part) < len(ids):
                    rest.insert(0, (key, total, start + len(part), ids[len(part) :]))
            left -= size
        self.held, self.tokens = [], 0

    def _new(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def _assign(self, count: int) -> Iterator[tuple]:
        """Fills `count` sequences wholly; pieces beyond them stay for the next buffer."""
        if not count:
            return
        open_ = _Open(self.room, [self._new() for _ in range(count)])
        size = lambda p: len(p[3])
        waiting = sorted(self.held, key=size)
        while waiting and open_.count:
            key, total, start, ids = waiting.pop()
            cost, sequence, left = open_.take(len(ids))
            part = ids[:left]
            yield key, total, start, part, sequence, self.room - left, self.cost(len(part))
            if len(part) < left:
                open_.put(cost + self.cost(len(part)), sequence, left - len(part))
            if len(part) < len(ids):
                insort(waiting, (key, total, start + len(part), ids[len(part) :]), key=size)
        kept = waiting
        self.held = kept
        self.tokens = sum(len(p[3]) for p in kept)


def pack(
    docs: DataFrame,
    tokenizer: str,
    room: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    ordinary: bool = False,
    cache: int = 160_000_000,
    **options,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    With `ordinary`, strings of special tokens in a text are text like any other. A worker
    process keeps the ids of up to twice `cache` bytes of pieces of text.

    sequence_id is unique over the whole result (task number in the high bits). Every
    sequence is full, but for at most log2(room) a task, whose lengths are powers of two.
    """

    def run(batches):
        packer = Packer(room, **options)
        base = TaskContext.get().partitionId() << 33
        enc = encoder(tokenizer, ordinary, cache)
        tail = np.array([end_id], dtype="<u4")
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64()] * 7 + [pa.float64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            out.clear()
            return batch

        def keep(pieces):
            for key, total, start, ids, sequence, offset, cost in pieces:
                out.append((key, start, len(ids), crc_of(ids), total, base + sequence, offset, cost))

        for batch in lots(batches, 1, 2_000_000):
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                keep(packer.add(key, np.concatenate([ids, tail])))
            if len(out) > 20_000:
                yield flush()
        keep(packer.finish())
        yield flush()
        trim()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
