"""Benchmark decontamination: edit distance by CGK embedding and bit-sampling LSH.

Texts are sequences of words. For each benchmark item, windows of the item's size slide
over every document. The CGK random walk maps a window of n words to a string of 3n
words such that few word edits change few of its places; a table of the index samples
some of the first 2n places, and item and window meet where all of them agree. Several
tables share a walk. The number of walks is the least for which simulated items at the
allowed distance are found with the target probability, each with the collision rate of
its own pair: pairs that rarely meet decide. Edits are spread over the item, or all lie
at its start or in one run, and each of these kinds must reach the target.

Every candidate is verified exactly: the least word edit distance between the whole item
and any stretch of words, of whatever length, near the window. It may be `edits` times
the item's words at most. Of stretches at the same distance the one that ends first
counts, and of those with the same end the shortest. Items so short that no edit is
allowed are looked up as they are.

An edit touches two pairs of neighbouring words at most, so a window within k edits of an
item of n words holds n - 1 - 2k of its word pairs. Windows with fewer pairs from all
items are passed over before they are embedded; this loses nothing. Item
lengths are grouped in classes; windows have the least length of the class and are
compared with as many first words of its items.

Items are taken in blocks of at most `block` items and `words` words, so the index of a
block, all that is sent to the executors, is of bounded size. Up to `together` blocks
share a pass over the documents; what more blocks there are take further passes.

Null or empty texts hold nothing and items without words are held by nothing; null ids
are carried; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lots, mix, stored, tidy, word_hashes, word_hashes_of

EDITS, RECALL, SAMPLED, PER_WALK, BLOCK, WORDS, TOGETHER = 0.2, 0.99, 3, 6, 20_000, 2_000_000, 4
#: Where simulated edits lie.
KINDS = ("spread", "start", "run", "substitutions spread", "substitutions at the start", "substitutions in a run")
_PAD = np.uint64(0)


def embed(windows: np.ndarray, seed: int, places: np.ndarray) -> np.ndarray:
    """The CGK embedding of each row of windows (n words to 3n), at the sorted places asked for.

    Step j of the walk moves on when bit j of the word's random function is set.
    """
    count, n = windows.shape
    flat = np.concatenate([windows, np.full((count, 1), _PAD)], axis=1).ravel()
    low = np.arange(count) * (n + 1)
    at, end = low.copy(), low + n
    out = np.empty((count, len(places)), np.uint64)
    k = 0
    for j in range(int(places[-1]) + 1):
        if not j % 64:
            bits = mix(flat ^ np.uint64(((seed * 1_003 + j) * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        if j == places[k]:
            out[:, k] = flat[at]
            k += 1
        at += ((bits[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        np.minimum(at, end, out=at)
    return out


def _distances(item: list, text: list, anchored: bool) -> list[int]:
    """After each word of text, the least edit distance of item to a stretch that ends there.

    The stretch starts anywhere, or with the first word if anchored. Columns of the table
    of distances are bit vectors of their differences, one step a word of text.
    """
    m = len(item)
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, out = full, 0, m, []
    for w in text:
        same = masks.get(w, 0)
        level = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(across | plus)), plus & across
        now += bool(up & top) - bool(down & top)
        up, down = (up << 1 | anchored) & full, down << 1 & full
        plus, minus = down | (full & ~(level | up)), up & level
        out.append(now)
    return out


def closest(item: list, text: list) -> tuple[int, int, int]:
    """(edit distance, first word, end) of the stretch of text that is closest to the item."""
    after = _distances(item, text, False)
    best = min(after, default=len(item))
    if best >= len(item):
        return len(item), 0, 0
    end = after.index(best) + 1
    back = _distances(item[::-1], text[:end][::-1], True)
    return best, end - 1 - back.index(best), end


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:])


def _fold(samples: np.ndarray, salt: int) -> np.ndarray:
    key = np.full(len(samples), salt, np.uint64)
    for column in samples.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return key


class Table:
    """Keys of items, sorted; which rows of asked keys meet which items."""

    def __init__(self, keys: np.ndarray, items: list[int]):
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], np.array(items, np.int64)[order]

    def meet(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.searchsorted(self.keys, asked)
        rows = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == asked)
        low = low[rows]
        many = np.searchsorted(self.keys, asked[rows], "right") - low
        place = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return np.repeat(rows, many), self.items[place]


class Index:
    """The tables of a block of items (id, words)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], edits: float = EDITS, recall: float = RECALL, sampled: int = SAMPLED, per_walk: int = PER_WALK, seed: int = 11):
        self.items = [(i, w) for i, w in items if len(w)]
        self.edits = edits
        exact, by_size = defaultdict(list), defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            (by_size[self.size_class(len(w))] if self.allowed(len(w)) else exact[len(w)]).append(k)
        self.exact = {n: Table(_fold(np.stack([self.items[k][1] for k in members]), n), members) for n, members in sorted(exact.items())}
        paired = [_pairs(self.items[k][1]) for members in by_size.values() for k in members]
        self.pairs = np.unique(np.concatenate(paired)) if paired else np.empty(0, np.uint64)
        rng = np.random.default_rng(seed)
        self.walks: dict[int, list] = {}
        self.need: dict[int, int] = {}
        for n, members in sorted(by_size.items()):
            # Word pairs that a window must share with the items: the lowest bound in the class.
            self.need[n] = n - 1 - 2 * max(self.allowed(len(self.items[k][1])) for k in members)
            count = self._count(self._rates(n, [self.items[k][1] for k in members], sampled, per_walk, rng), recall)
            windows = np.stack([self._fit(self.items[k][1], n) for k in members])
            self.walks[n] = []
            for t in range(count):
                samples = np.stack([np.sort(rng.choice(2 * n, size=min(sampled, 2 * n), replace=False)) for _ in range(per_walk)])
                places, where = np.unique(samples, return_inverse=True)
                where, found = where.reshape(samples.shape), embed(windows, 1000 * n + t, places)
                self.walks[n].append((1000 * n + t, places, [(w, Table(_fold(found[:, w], n), members)) for w in where]))

    def allowed(self, words: int) -> int:
        return int(self.edits * words)

    @staticmethod
    def size_class(n: int) -> int:
        """Lengths up to 8 are classes of their own; above, classes grow by a fourth, and items are cut to the class."""
        size = 8
        if n <= size:
            return n
        while size + size // 4 <= n:
            size += size // 4
        return size

    @staticmethod
    def _fit(words: np.ndarray, n: int) -> np.ndarray:
        return words[:n] if len(words) >= n else np.concatenate([words, np.full(n - len(words), _PAD)])

    @staticmethod
    def _count(rates: np.ndarray, recall: float) -> int:
        """The least number of walks for which every row of rates (a kind of edits) has the mean recall."""
        reached = lambda count: (1 - (1 - rates) ** count).mean(axis=1).min() >= recall
        high = 1
        while not reached(high):
            high *= 2
        low = high // 2 + 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if reached(middle) else (middle + 1, high)
        return high

    def edited(self, words: np.ndarray, kind: str, rng) -> np.ndarray:
        """A copy with as many random edits as are allowed, of all three sorts or substitutions alone."""
        out, most = words.tolist(), self.allowed(len(words))
        first = int(rng.integers(max(len(words) - most, 0) + 1)) if kind.endswith("run") else 0
        if kind.startswith("substitutions"):
            for at in rng.permutation(len(words))[:most].tolist() if kind.endswith("spread") else range(first, first + most):
                out[at] = int(rng.integers(1, 2**63))
            return np.array(out, np.uint64)
        for k in range(most):
            at = int(rng.integers(len(out))) if kind == "spread" else min(first + k, len(out) - 1)
            what, new = int(rng.integers(3)), int(rng.integers(1, 2**63))
            if what == 0 or len(out) < 2:
                out[at] = new
            elif what == 1:
                out.insert(at, new)
            else:
                del out[at]
        return np.array(out, np.uint64)

    def _rates(self, n: int, items: list[np.ndarray], sampled: int, per_walk: int, rng, trials: int = 300, seeds: int = 48) -> np.ndarray:
        """How often the tables of a walk join an item and an edited copy: a row for each kind of edits, a column for each pair."""
        a, b = [], []
        for kind in KINDS:
            for _ in range(trials):
                words = items[int(rng.integers(len(items)))]
                a.append(self._fit(words, n))
                after = rng.integers(1, 2**63, n).astype(np.uint64)
                b.append(self._fit(np.concatenate([self.edited(words, kind, rng), after]), n))
        a, b, places, take = np.stack(a), np.stack(b), np.arange(2 * n), min(sampled, 2 * n)
        total = np.zeros(len(a))
        for seed in range(seeds):
            same = (embed(a, seed, places) == embed(b, seed, places)).sum(axis=1)
            # Over all choices of places: the share of them whose places all agree, and that one of several does.
            one = np.prod([np.maximum(same - i, 0) / (2 * n - i) for i in range(take)], axis=0)
            total += 1 - (1 - one) ** per_walk
        # A pair that never met counts as one that may have met once in twice as many choices of seeds.
        return np.maximum(total / seeds, 1 / (2 * seeds * math.comb(2 * n, take))).reshape(len(KINDS), trials)

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """For each word sequence, (item id, first word, distance) of the closest stretch for each item that occurs."""
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not self.items or not any(map(len, texts)):
            return [[] for _ in texts]
        # All texts lie in one row, so that windows are embedded many at a time; the gaps hold no word.
        gap = np.full(max([*self.walks, *self.exact]), _PAD)
        flat = np.concatenate([x for t in texts for x in (t, gap)])
        begin = np.cumsum([0, *[len(t) + len(gap) for t in texts]])
        sizes = [len(t) for t in texts]
        for n, table in self.exact.items():
            key = np.full(len(flat) - n + 1, n, np.uint64)
            for j in range(n):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ flat[j : len(flat) - n + 1 + j])
            for start, k in zip(*(x.tolist() for x in table.meet(key)), strict=True):
                doc = int(np.searchsorted(begin, start, "right")) - 1
                best[doc].setdefault(k, (0, start - int(begin[doc])))
        if self.walks:
            pairs = _pairs(flat)
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            known = np.concatenate([[0], np.cumsum(self.pairs[at] == pairs)])
        for n, walks in self.walks.items():
            starts = np.flatnonzero(known[n - 1 :] - known[: len(known) - n + 1] >= self.need[n])
            starts = starts[flat[starts] != _PAD]  # one in the gap before a text would count for the text before it
            for lot in range(0, len(starts), 20_000):
                self._lot(flat, n, starts[lot : lot + 20_000], walks, begin, sizes, best)
        return [[(self.items[k][0], start, d) for k, (d, start) in sorted(x.items())] for x in best]

    def _lot(self, flat, n, starts, walks, begin, sizes, best) -> None:
        windows, docs, met = flat[starts[:, None] + np.arange(n)], np.searchsorted(begin, starts, "right") - 1, []
        for seed, places, tables in walks:
            found = embed(windows, seed, places)
            for where, table in tables:
                rows, items = table.meet(_fold(found[:, where], n))
                met.append(items * len(starts) + rows)
        met = np.unique(np.concatenate(met))
        near: dict[tuple[int, int], list[int]] = defaultdict(list)  # item and document -> windows, in order
        for k, row in zip((met // len(starts)).tolist(), (met % len(starts)).tolist(), strict=True):
            near[k, int(docs[row])].append(int(starts[row] - begin[docs[row]]))
        for (k, doc), places in near.items():
            item = self.items[k][1].tolist()
            most, words = self.allowed(len(item)), flat[begin[doc] : begin[doc] + sizes[doc]]
            first = 0
            for i, start in enumerate(places):
                # Windows whose surroundings meet are looked through together.
                if i + 1 < len(places) and places[i + 1] - start <= len(item) + 2 * most:
                    continue
                low = max(places[first] - most, 0)
                d, at, _ = closest(item, words[low : start + len(item) + most].tolist())
                if d <= most and (d, low + at) < best[doc].get(k, (most + 1, 0)):
                    best[doc][k] = (d, low + at)
                first = i + 1


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block: int, words: int, **options) -> Iterator[Index]:
    """Indexes of the items, block by block: the driver holds one block's texts."""
    held, size = [], 0
    for item, text in benchmark.select(benchmark[item_col].cast("long"), benchmark[item_text]).toLocalIterator():
        found = word_hashes(text)
        if held and (len(held) >= block or size + len(found) > words):
            yield Index(held, **options)
            held, size = [], 0
        held.append((item, found.copy()))
        size += len(found)
    if held:
        yield Index(held, **options)


def _passes(docs: DataFrame, search, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, words: int = WORDS, together: int = TOGETHER, **options) -> DataFrame:
    """search(docs, broadcast indexes) for every `together` blocks in turn; what a pass gives is written before the next."""
    held = []
    context = docs.sparkSession.sparkContext
    for index in _blocks(benchmark, item_col, item_text, block, words, **options):
        if len(held) == together:
            docs, held = stored(search(docs, held), "searched"), []
        held.append(context.broadcast(index))
    return search(docs, held) if held else docs


def _hits(indexes, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    found = word_hashes_of(texts)
    each = [index.value.find(found) for index in indexes]
    return [[hit for x in hits for hit in x] for hits in zip(*each, strict=True)]


_HITS = "array<struct<item_id: bigint, first_word: bigint, edits: bigint>>"


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """doc_id, text and hits of every row."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int64())]))

    def search(rows: DataFrame, indexes: list) -> DataFrame:
        def run(batches):
            for batch in lots(batches, 1):
                more = _hits(indexes, batch.column(1).to_pylist())
                hits = [[*old, *({"item_id": i, "first_word": s, "edits": d} for i, s, d in new)] for old, new in zip(batch.column(2).to_pylist(), more, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, kind)], names=["doc_id", "text", "hits"])

        return rows.mapInArrow(tidy(run), f"doc_id long, text string, hits {_HITS}")

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.array().cast(_HITS).alias("hits"))
    return _passes(rows, search, benchmark, **options)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs and item that it holds: doc_id, item_id, first_word, edits."""
    return _found(docs, benchmark, id_col, text_col, **options).select("doc_id", F.inline("hits"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs that holds items: doc_id, items (sorted distinct ids), n_items, edits (of the closest)."""
    found = _found(docs, benchmark, id_col, text_col, **options).filter(F.size("hits") > 0)
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select("doc_id", items.alias("items"), F.size(items).cast("long").alias("n_items"), F.array_min(F.transform("hits", lambda h: h["edits"])).alias("edits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns; every row is judged by its own text."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def search(rows: DataFrame, indexes: list) -> DataFrame:
        def run(batches):
            for batch in lots(batches, at):
                yield batch.filter(pa.array([not hits for hits in _hits(indexes, batch.column(at).to_pylist())], pa.bool_()))

        return rows.mapInArrow(tidy(run), rows.schema)

    return _passes(docs, search, benchmark, **options)
