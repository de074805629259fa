"""Token ids in word-aligned binary files: Simple-8b with escapes and block offsets.

Every 64-bit word has a selector in its top four bits and packs as many values as fit:

    selector      1   2  3  4  5  6  7  8  9 10 11 12 13 14 15
    values a word 240 120 60 30 20 15 12 10 8  7  6  5  4  3  2
    bits a value  0   0  1  2  3  4  5  6  7  8 10 12 15 20 30

Selector 0 is the escape: the next word is one value of up to 64 bits, as it is. Values
are cut into blocks, each of which starts a new word, and a table of the blocks' first
words precedes the words, so that blocks decode alone and all selectors of a run of
words decode together. Body: 4-byte magic, then as little-endian unsigned 32-bit
integers version, block size, number of values, number of blocks, number of words, the
first word of each block; padding to 8 bytes; the words.

A file is a Parquet container of such bodies, one for each run of whole documents, so
Spark's own committer makes it safe to lose and retry tasks on any file system.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of, encoder, forget, lots, shared_dir

MAGIC, VERSION, BLOCK = b"S8BW", 1, 8192
#: Fixed values of the coding: (selector, values a word, bits a value).
SELECTORS = (
    (1, 240, 0), (2, 120, 0), (3, 60, 1), (4, 30, 2), (5, 20, 3), (6, 15, 4), (7, 12, 5), (8, 10, 6),
    (9, 8, 7), (10, 7, 8), (11, 6, 10), (12, 5, 12), (13, 4, 15), (14, 3, 20), (15, 2, 30),
)
_COUNT = np.zeros(16, np.int64)
_BITS = np.zeros(16, np.int64)
for _s, _n, _b in SELECTORS:
    _COUNT[_s], _BITS[_s] = _n, _b
_COUNT[0] = 1


#: Values whose blocks are coded in one go: as arrays of some MB, whatever the length of a run.
TOGETHER = 262_144


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, up to the next number of bits that a selector has."""
    if len(values) and values.max() < len(_SHORT):
        return _SHORT[values]
    out = np.zeros(len(values), np.int8)
    for b in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30):
        out[values >= np.uint64(1 << b)] = b + 1
    return out


_SHORT = np.empty(0, np.int8)
_SHORT = _widths(np.arange(1 << 16, dtype=np.uint64))


def _walk(hops: np.ndarray) -> np.ndarray:
    """The places reached from 0 by hops[i] from i. Python takes every eighth hop, the others follow from it."""
    n = len(hops)
    one = np.append(np.arange(n, dtype=np.int32) + hops, np.int32(n))
    two = one[one]
    four = two[two]
    eight = memoryview(four[four])
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = eight[i]
    at = np.array(starts, np.int32)
    for step in (four, two, one):
        at = np.stack([at, step[at]], 1).ravel()
    return at[: np.searchsorted(at, n)]


def _block_words(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of some blocks of values, and the first word of each block."""
    n, n_blocks = len(values), -(-len(values) // block)
    width = np.full(n_blocks * block, 99, np.int8)
    width[:n] = _widths(values)
    most = width.reshape(n_blocks, block)  # the largest width among the next `span` values, 99 where the block ends before
    choice = np.zeros(most.shape, np.int8)  # selector 0, the escape, where nothing fits
    span = 1
    for s, count, bits in reversed(SELECTORS):
        if count > block:
            break
        while span < count:
            step = min(span, count - span)
            longer = np.full(most.shape, 99, np.int8)
            np.maximum(most[:, :-step], most[:, step:], out=longer[:, :-step])
            most, span = longer, span + step
        fits = most <= bits
        if not fits.any():  # more values of fewer bits can't fit either
            break
        np.copyto(choice, s, where=fits)
    choice = choice.ravel()[:n]
    ends = np.minimum(np.arange(1, n_blocks + 1) * block, n)
    # A single value of up to 30 bits at the end of a block shares its word with a zero.
    alone = ends[(width[ends - 1] <= 30) & (choice[ends - 1] == 0)] - 1
    hops = _COUNT[choice].astype(np.int32)
    choice[alone] = 15
    at = _walk(hops)
    sel = choice[at]
    escapes = sel == 0
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(escapes)[:-1]])
    words = np.zeros(len(at) + int(escapes.sum()), np.uint64)
    padded = np.append(values, np.uint64(0))
    for s, count, bits in SELECTORS:
        rows = np.flatnonzero(sel == s)
        if not len(rows):
            continue
        word, begin = np.full(len(rows), s << 60, np.uint64), at[rows]
        for k in range(count if bits else 0):
            value = padded[begin + k]
            if k == 1 and s == 15 and len(alone):
                value[np.isin(begin, alone)] = 0
            word |= value << np.uint64(bits * k)
        words[place[rows]] = word
    rows = np.flatnonzero(escapes)
    words[place[rows] + 1] = values[at[rows]]
    return words, place[np.searchsorted(at, np.arange(n_blocks) * block)]


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """The body for a run of unsigned integers of up to 64 bits."""
    values = np.asarray(values, dtype=np.uint64)
    parts, first, n_words = [], [], 0
    together = max(1, TOGETHER // block) * block
    for i in range(0, len(values), together):
        words, begin = _block_words(values[i : i + together], block)
        parts.append(words)
        first += (begin + n_words).tolist()
        n_words += len(words)
    head = np.array([VERSION, block, len(values), len(first), n_words, *first], dtype="<u4").tobytes()
    head = MAGIC + head
    return head + b"\0" * (-len(head) % 8) + b"".join(p.astype("<u8").tobytes() for p in parts)


def _decode_blocks(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of blocks whose words follow each other, by the first word and the number of values of each."""
    sel = (words >> np.uint64(60)).astype(np.int8)
    if not (sel == 0).any():
        at = np.arange(len(words))
    else:  # the word after an escape is a value: walk from escape to escape
        plain = np.ones(len(words), bool)
        i = 0
        for e in np.flatnonzero(sel == 0).tolist():
            if e >= i:
                plain[e + 1] = False
                i = e + 2
        at = np.flatnonzero(plain)
        sel = sel[at]
    begin = np.concatenate([[0], np.cumsum(_COUNT[sel])])
    out = np.zeros(int(begin[-1]), np.uint64)
    for s, count, bits in SELECTORS:
        rows = np.flatnonzero(sel == s)
        if len(rows) and bits:
            got, to, mask = words[at[rows]], begin[rows], np.uint64((1 << bits) - 1)
            for k in range(count):
                out[to + k] = (got >> np.uint64(bits * k)) & mask
    rows = np.flatnonzero(sel == 0)
    out[begin[rows]] = words[at[rows] + 1]
    start = begin[np.searchsorted(at, first)]  # a block's last word may hold more than its values
    if len(out) == sizes.sum():
        return out
    return np.concatenate([out[a : a + n] for a, n in zip(start.tolist(), sizes.tolist(), strict=True)])


def decode(body: bytes, blocks: slice = slice(None)) -> np.ndarray:
    """The values of a body, or of some of its blocks."""
    if body[:4] != MAGIC:
        raise ValueError("not a token file body")
    version, block, n, n_blocks, n_words = np.frombuffer(body, "<u4", 5, 4).tolist()
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    first = np.append(np.frombuffer(body, "<u4", n_blocks, 24), n_words).astype(np.int64)
    words = np.frombuffer(body, "<u8", n_words, 24 + 4 * n_blocks + (-(24 + 4 * n_blocks) % 8))
    sizes = np.minimum(block, n - np.arange(n_blocks) * block)
    a, b, step = blocks.indices(n_blocks)
    together = max(1, TOGETHER // block) if step == 1 else 1
    spans = [(i, min(i + together, b) if step == 1 else i + 1) for i in range(a, b, step * together)]
    parts = [_decode_blocks(words[first[i] : first[j]], first[i:j] - first[i], sizes[i:j]) for i, j in spans]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


_CONTAINER = "part int, run int, start_in_part long, n_ids long, doc_ids array<long>, lengths array<long>, body binary"


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_ids: int = 262_144,
    parts: int | None = None,
    ordinary: bool = False,
    cache: int = 100_000_000,
) -> None:
    """Writes the ids of all documents in ascending id order; part files follow that order.

    Strings of special tokens in a text are those tokens, as the library has it by
    default; with `ordinary` they are text like any other. Null texts count as empty, null ids come first, rows of one id are ordered by the
    hash of their text. A range of ids is split by that hash as well, so that one very
    common id does not fill one task. A worker process keeps the ids of up to twice
    `cache` bytes of pieces of text, beside a task's sorted rows.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        enc, part = encoder(tokenizer, ordinary, cache), TaskContext.get().partitionId()
        tail = np.array([end_id], dtype="<u4")
        number, before = 0, 0
        ids, keys, held = [], [], 0

        def body():
            nonlocal number, before, held
            flat = np.concatenate(ids)
            row = [[part], [number], [before], [len(flat)], [list(keys)], [[len(x) for x in ids]], [encode(flat)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "run", "start_in_part", "n_ids", "doc_ids", "lengths", "body"]
            number, before, held = number + 1, before + len(flat), 0
            ids.clear(), keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in lots(batches, 1, 2_000_000):
            for key, x in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                keys.append(key)
                ids.append(np.concatenate([x, tail]))
                held += len(x) + 1
                if held >= run_ids:
                    yield body()
        if keys:
            yield body()

    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, _CONTAINER).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at path: doc_id, start, n_tokens, ids_crc32 and the ids' number in its run.

    The number of ids before a part is a sum over one row per part, which is all that
    the driver sees.
    """

    def run(batches):
        forget()  # what a write in this process has kept
        for batch in batches:
            columns = [batch.column(n) for n in ("run_start", "doc_ids", "lengths", "body")]
            for i in range(batch.num_rows):  # one run at a time as Python values
                at, keys, lengths, body = (c[i].as_py() for c in columns)
                ids = decode(body).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [crc_of(ids[e - n : e]) for n, e in zip(lengths, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array((at + ends - lengths), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    runs = spark.read.parquet(path)
    totals = runs.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    offsets, before = {}, 0
    for r in totals:
        offsets[r["part"]] = before
        before += r["n"]
    table = spark.createDataFrame(list(offsets.items()), "part int, before long")
    placed = runs.join(F.broadcast(table), "part").select((F.col("before") + F.col("start_in_part")).alias("run_start"), "doc_ids", "lengths", "body")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes all documents to the shared folder and reads the files back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
