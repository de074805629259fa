"""Near-duplicates: consistent weighted sampling over TF-IDF word shingles, banded and verified.

A text is the multiset of its five-word shingles. A shingle weighs its count times the
mean idf of its words, idf = 1 + ln((N + 1) / (df + 1)) / ln(N + 1), between 1 and 2.
Document frequencies are over all documents, by word hash in `1 << DF_BITS` cells, a
table of fixed size. Texts with the same words are one node from the start, so copies
cost nothing later.

Improved consistent weighted sampling draws `bands * rows` samples of each node; two
nodes agree in a sample with the probability of their weighted Jaccard similarity. Nodes
that agree in all rows of a band share a bucket. With 12 bands of 4 rows a pair of
similarity 0.8 shares a bucket with probability 0.998, one of 0.9 with 0.99999. Links are
bucket mates whose exact weighted Jaccard similarity over whole texts reaches the
threshold, and classes are the connected components of the links.

Two rounds find the components of all links without comparing all pairs. First every
node is compared with the hub of each of its buckets, the member that shares most
buckets with others. Where a bucket then still holds several classes, the nodes outside
its largest class are compared with all of its nodes; what the largest class holds is
joined already. Nodes are compared in units of two bounded groups, by an index of the
shingles of the one, and of a unit only as many links are given as join its nodes. So a
bucket of n nodes, r of them outside its largest class, moves about 2 n r / `SPAN` rows
(with groups of at most the square root of n beyond that), at most, and the largest unit
grows with the square root of the bucket. No pair is capped or passed over.

Texts without words are classes of their own, each. Texts of fewer than five words have
one shingle, the whole text. Null texts count as empty, null ids are carried; rows that
repeat an id and text share a class, and one of them stays. An empty table gives an
empty result; extra columns are kept by `deduplicate` and ignored by `classes`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import BITS, bitmap, drop_rows, in_bitmap, keep_one, row_key
from .common import lots, mix, scratch, shingle_hashes, stored, tidy, word_hashes, word_hashes_of

DF_BITS, SLICES, BANDS, ROWS, SHINGLE, THRESHOLD, SPAN = 20, 32, 12, 4, 5, 0.8, 100
_TABLE = 1 << 16


class Sampler:
    """Weighted samples of multisets; draws come from tables indexed by parts of a mixed hash."""

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        r = rng.gamma(2.0, 1.0, _TABLE)
        beta = rng.random(_TABLE)
        # With t = floor(log w / r + beta), the sample is the least log c - r * (t - beta + 1).
        self.walk = np.stack([1 / r, beta, r, r * (beta - 1)], axis=1).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
        self.keys = rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)

    def sample(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row of 64-bit samples for each set (none empty): the chosen shingle and its quantised log weight, hashed."""
        out = np.empty((len(sets), len(self.keys)), np.uint64)
        first = 0
        while first < len(sets):  # about 16 000 shingles at a time stay in cache
            last, held = first, 0
            while last < len(sets) and (not held or held + len(sets[last][0]) <= 16_384):
                held += len(sets[last][0])
                last += 1
            out[first:last] = self._lot(sets[first:last])
            first = last
        return mix(out)

    def _lot(self, sets) -> np.ndarray:
        hashes = np.concatenate([s[0] for s in sets])
        log_w = np.log(np.concatenate([s[1] for s in sets])).astype(np.float32)
        begin = np.cumsum([0, *[len(s[0]) for s in sets[:-1]]])
        place = np.arange(len(hashes), dtype=np.int64)
        out = np.empty((len(sets), len(self.keys)), np.uint64)
        for k, key in enumerate(self.keys):
            m = hashes * key
            m ^= m >> np.uint64(32)
            parts = m.view(np.uint16)
            walk = self.walk.take(parts[0::4], axis=0)
            t = np.floor(log_w * walk[:, 0] + walk[:, 1])
            a = self.log_c.take(parts[1::4]) - walk[:, 2] * t + walk[:, 3]
            # Floats as integers of the same order, with the place below: one minimum gives both.
            bits = a.view(np.int32)
            bits = bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))
            least = np.minimum.reduceat((bits.astype(np.int64) << 32) | place, begin) & 0xFFFFFFFF
            out[:, k] = hashes[least] ^ (t[least].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def words32(text: str | None) -> np.ndarray:
    return word_hashes(text).astype(np.uint32)


def _words32_of(column: pa.Array) -> list[np.ndarray]:
    return [w.astype(np.uint32) for w in word_hashes_of(column.to_pylist())]


def weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of a word sequence, and their weights."""
    size = min(SHINGLE, len(words))
    if not size:
        return np.empty(0, np.uint64), np.empty(0, np.float64)
    shingles, first, count = np.unique(shingle_hashes(words.astype(np.uint64), SHINGLE), return_index=True, return_counts=True)
    each = idf[(words & np.uint32((1 << DF_BITS) - 1)).astype(np.int64)].astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(each)])
    # Rounded to 2**-20: the same shingle must weigh the same in every text.
    mean = np.round((total[first + size] - total[first]) / size * 1048576) / 1048576
    return shingles, count * mean


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The idf of each word cell, and N. What reaches the driver is the table, of fixed size."""

    def count(batches):
        cells, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in lots(batches, 0):
            for words in _words32_of(batch.column(0)):
                cells[np.unique(words & np.uint32((1 << DF_BITS) - 1)).astype(np.int64)] += 1
                n += 1
        parts = np.split(cells.astype("<i8"), SLICES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([n] * SLICES, pa.int64())],
            names=["slice", "cells", "n"],
        )

    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for s, cells, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got = held.setdefault(s, [np.zeros((1 << DF_BITS) // SLICES, np.int64), 0])
                got[0] += np.frombuffer(cells, "<i8")
                got[1] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v[0].tobytes() for v in held.values()], pa.binary()), pa.array([v[1] for v in held.values()], pa.int64())],
            names=["slice", "cells", "n"],
        )

    schema = "slice int, cells binary, n long"
    rows = texts.mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    df, total = np.zeros(1 << DF_BITS, np.int64), 0
    width = (1 << DF_BITS) // SLICES
    for s, cells, n in rows:
        df[s * width : (s + 1) * width] = np.frombuffer(cells, "<i8")
        total = max(total, n)
    return (1 + np.log((total + 1) / (df + 1)) / np.log(max(total + 1, 2))).astype(np.float32), total


def connected(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label): one label for all nodes of each component of the undirected edges.

    Level by level each node points to the smallest node at or next to it, edges are
    carried over to what their ends point to, and loops and repeats go, so every level
    has half the nodes or fewer. Pointers are aggregated before the shuffle: a node of
    any degree is one row a task.
    """
    levels = []
    x, y = F.col(src), F.col(dst)
    now = stored(edges.filter(x != y).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct(), "edges")
    while not levels or not now.isEmpty():
        ends = now.select(F.col("x").alias("node"), F.col("x").alias("near")).union(now.select(F.col("y"), F.col("x")))
        points = stored(ends.groupBy("node").agg(F.min("near").alias("label")), "labels")
        levels.append(points)
        left = points.select(F.col("node").alias("x"), F.col("label").alias("px"))
        right = points.select(F.col("node").alias("y"), F.col("label").alias("py"))
        carried = now.join(left, "x").join(right, "y").filter("px <> py")
        now = stored(carried.select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "edges")
    labels = levels[0]
    for level in levels[1:]:
        up = level.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return stored(labels, "labels")


def merged(labels: DataFrame, edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """labels after more edges, which are first carried over to the labels of their ends."""
    one, two = labels.select(F.col("node").alias(src), F.col("label").alias("one")), labels.select(F.col("node").alias(dst), F.col("label").alias("two"))
    carried = stored(edges.join(one, src, "left").join(two, dst, "left").select(F.coalesce("one", src).alias("a"), F.coalesce("two", dst).alias("b")).distinct(), "carried")
    joined = connected(carried)
    up = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = joined.join(labels, "node", "left_anti").join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_anti")
    return stored(old.union(fresh.select("node", "label")), "labels")


def _signatures(docs: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """doc_id, row (its key), node (hash of the words, null if none) and the buckets of its bands."""

    def run(batches):
        sampler, table = Sampler(bands * rows), idf.value
        for batch in lots(batches, 1):
            words = _words32_of(batch.column(1))
            sets = [weighted(w, table) for w in words if len(w)]
            got = iter(sampler.sample(sets).reshape(-1, bands, rows))
            nodes = [xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words]
            keys = [[xxhash.xxh3_64_intdigest(r.tobytes(), seed=b) - (1 << 63) for b, r in enumerate(next(got))] if len(w) else None for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "keys"])

    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row"))
    return keyed.mapInArrow(tidy(run), "doc_id long, row binary, node binary, keys array<long>")


class Group:
    """Weighted sets, indexed by shingle, to find those similar to another set."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        shingles = np.concatenate([s[0] for s in sets])
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.weights = shingles[order], np.concatenate([s[1] for s in sets])[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])[order]
        self.totals = np.array([s[1].sum() for s in sets])

    def similar(self, x: tuple[np.ndarray, np.ndarray], threshold: float) -> list[int]:
        """Places of the sets whose weighted Jaccard similarity with x reaches the threshold."""
        low = np.searchsorted(self.shingles, x[0])
        many = np.searchsorted(self.shingles, x[0], "right") - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        both = np.bincount(self.owner[at], np.minimum(self.weights[at], np.repeat(x[1], many)), minlength=len(self.totals))
        return np.flatnonzero(both >= threshold * (self.totals + x[1].sum() - both)).tolist()


def _joining(links: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """As few of the links as join what all of them join."""
    top: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            top[y] = x
            out.append((a, b))
    return out


def _compare(units: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) that join the similar nodes of each unit.

    units: unit (long), side, node. The nodes of side 0 are indexed, those of side 1 are
    compared with them in a sorted stream; a task holds one unit's side 0.
    """
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = units.join(sets, "node").select("unit", "side", "node", "words").repartition(n, "unit").sortWithinPartitions("unit", "side", "node")

    def run(batches):
        at, group, names, held, links = None, None, [], [], []
        for batch in batches:
            out = []
            for unit, side, node, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if unit != at:
                    out += _joining(links)
                    at, group, names, held, links = unit, None, [], [], []
                got = weighted(np.frombuffer(words, "<u4"), idf.value)
                if side == 0:
                    names.append(node), held.append(got)
                elif held:
                    group = group or Group(held)
                    links += [(names[k], node) for k in group.similar(got, threshold) if names[k] != node]
                    if len(links) > 4 * len(names) + 1000:
                        links = _joining(links)
            yield _edges(out)
        yield _edges(_joining(links))

    return stream.mapInArrow(tidy(run), "a binary, b binary")


def _edges(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and words of the nodes in `wanted` (node, doc_id of one copy); other texts are passed over unread by Python."""
    some = in_bitmap(docs, F.col("doc_id"), bitmap(wanted.select(F.col("doc_id").alias("k"))), BITS, "maybe").filter("maybe").select("doc_id", "text")

    def run(batches):
        for batch in lots(batches, 1):
            words = _words32_of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words], pa.binary()), pa.array([w.tobytes() for w in words], pa.binary())],
                names=["doc_id", "node", "words"],
            )

    found = some.mapInArrow(tidy(run), "doc_id long, node binary, words binary")
    same = found.join(wanted.select("node", F.col("doc_id").alias("one")), "node").filter(F.col("doc_id").eqNullSafe(F.col("one")))
    return stored(same.select("node", "words").dropDuplicates(["node"]), "sets")


#: Orders documents so that the one to stay is the least: by id, null ids last, then by key.
_OLDEST = "struct(doc_id is null as missing, doc_id, row)"


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the class's smallest doc_id), kept (for rows equal in id and text, together)."""
    return _classes(docs, id_col, text_col, threshold, bands, rows).drop("row")


def _units(left: DataFrame, span: int = SPAN) -> DataFrame:
    """left: band, key, node, label of the buckets that hold several labels. The units that compare all pairs of different labels."""
    sizes = left.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("size"))
    buckets = sizes.groupBy("band", "key").agg(F.sum("size").alias("n"), F.max(F.struct("size", "label")).alias("largest"))
    within = F.greatest(F.lit(span), F.sqrt("n").cast("int"))
    buckets = buckets.select(
        "band", "key", F.col("largest.label").alias("main"), F.ceil(F.col("n") / within).cast("int").alias("n_all"), F.ceil((F.col("n") - F.col("largest.size")) / within).cast("int").alias("n_rest")
    )
    rows = left.join(buckets, ["band", "key"])
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rows.filter(F.col("label") != F.col("main")).select("band", "key", part("rest", "n_rest").alias("i"), every("n_all").alias("j"), F.lit(0).alias("side"), "node")
    whole = rows.select("band", "key", every("n_rest").alias("i"), part("all", "n_all").alias("j"), F.lit(1).alias("side"), "node")
    # Units are named by a hash; two that share one are compared together, which loses nothing.
    return rest.union(whole).select(F.xxhash64("band", "key", "i", "j").alias("unit"), "side", "node")


def _classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As classes, with the key of each row. All tables on the way are deleted, but for the two that the result reads."""
    with scratch(docs.sparkSession) as kept:
        marked, node_class = _marked_classes(docs, id_col, text_col, threshold, bands, rows)
        kept += [marked, node_class]
    own = F.coalesce(F.col("node"), F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    found = marked.select("doc_id", "row", own.alias("node")).join(node_class, F.col("node") == F.col("of"), "left")
    class_id = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    stays = F.col("of").isNull() | (F.col("row") == F.col("stays"))
    return found.select("doc_id", class_id.alias("class_id"), stays.alias("kept"), "row")


def _marked_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their nodes and keys; nodes with the class's smallest doc_id and the row that stays."""
    spark: SparkSession = docs.sparkSession
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    table, _ = document_frequencies(base.select("text"))
    idf = spark.sparkContext.broadcast(table)
    marked = stored(_signatures(base, idf, bands, rows), "signatures")
    nodes = stored(
        marked.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.expr(_OLDEST)).alias("oldest"), F.first("keys").alias("keys")), "nodes"
    )
    placed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(placed.join(shared, ["band", "key"]), "members")
    # The hub of a bucket is the member that shares most buckets with others.
    central = members.groupBy("node").agg(F.sum("n").alias("near"))
    hubs = members.join(central, "node").groupBy("band", "key").agg(F.max(F.struct("near", "node"))["node"].alias("hub"))
    members = stored(members.join(hubs, ["band", "key"]).select("band", "key", "node", "hub"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id")
    sets = _sets(base, stored(wanted, "wanted"))

    # First each node of a bucket against the hub, in runs of about SPAN nodes.
    pairs = members.filter("node <> hub").select("hub", "node").distinct()
    runs = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SPAN).alias("runs"))
    apart = pairs.join(runs, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("runs")).alias("run"), F.lit(1).alias("side"), "node")
    ahead = runs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.lit(0).alias("side"), F.col("hub").alias("node"))
    units = apart.union(ahead).select(F.xxhash64("hub", "run").alias("unit"), "side", "node")
    labels = connected(stored(_compare(units, sets, idf, threshold), "links"))

    # Then, where nodes of different classes are left, those outside the largest class against all.
    now = members.join(labels.select("node", "label"), "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("label"))
    mixed = now.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band", "key")
    left = stored(now.join(mixed, ["band", "key"], "left_semi"), "left")
    labels = merged(labels, stored(_compare(_units(left), sets, idf, threshold), "links"))

    node_class = nodes.select("node", "doc_id", "oldest").join(labels, "node", "left").select("node", "doc_id", "oldest", F.coalesce("label", "node").alias("label"))
    node_class = stored(node_class, "classes")
    smallest = node_class.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min("oldest").alias("oldest"))
    return marked, stored(node_class.drop("oldest").join(smallest, "label").select(F.col("node").alias("of"), "class_id", F.col("oldest")["row"].alias("stays")), "classes")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class, all columns. Rows without words are classes of their own and stay."""
    found = stored(_classes(docs, id_col, text_col, **options), "found")
    again = found.filter("kept").groupBy(F.col("row").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    return keep_one(drop_rows(docs, found.filter("not kept").select(F.col("row").alias("k")), id_col, text_col), again, id_col, text_col)
