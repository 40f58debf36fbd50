"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

Fingerprint: A-Z is lower-cased, words are runs without ASCII white space, each
4-word shingle (repeats included) is hashed by XXH64 with seed 42, and a bit is
set if more than half of the hashes have it. A text of 1 to 3 words is one
shingle, a text without words has fingerprint 0.

Links: two fingerprints at `distance` or fewer differing bits are linked.
1. Equal fingerprints are merged by a partially aggregated groupBy, so copies,
   however many, are one row in all that follows.
2. Cut into distance+2 blocks of bits, two linked fingerprints agree in two
   blocks at least; each fingerprint is dealt to one bucket for each pair of
   blocks. This is exact: no link escapes all buckets.
3. In a bucket, distances to reference fingerprints (the pivots) are computed
   once. By the triangle inequality, a linked pair differs by at most `distance`
   in every coordinate. Pairs are drawn from the order of the first coordinate,
   cut by the others one after another, and the survivors are verified.
   Buckets report a spanning forest of their links only: at most one edge less
   than it has fingerprints. Fingerprints that are already connected are not
   compared again, and a fingerprint near a pivot of its own bucket is linked at
   once; so a dense bucket costs about its size.
4. Buckets over `bucket_rows` are dealt out again: the bits in which their
   fingerprints may still differ are cut into distance+1 blocks, of which a linked
   pair shares one at least. A row is copied distance+1 times for that, however
   large its bucket is, and a bucket shrinks by the values of a block; this is
   repeated for those that stay large. It ends, as the free bits run out.
5. Components: smallest label over links, with hooked roots and pointer jumping,
   until nothing changes; each round is cut off by a table in the shared folder.

Defined results: null and empty texts have fingerprint 0 and link like any other.
Rows with equal ids are separate rows and share a component through the id of
their fingerprint. Null ids count as no id: a component of such rows only has a
null component_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._common import F, T, fresh, map_batches, stored, strings

SHINGLE, SEED, BITS = 4, 42, 64
PIVOTS = 12
BUCKET_ROWS = 4_000


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 bytes."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    n = len(words) - shingle + 1
    total = np.zeros(BITS, np.int64)
    for block in range(0, n, 1 << 16):  # bounds the unpacked bits
        pairs = zip(starts[block : min(n, block + (1 << 16))].tolist(), ends[block + shingle - 1 : min(n, block + (1 << 16)) + shingle - 1].tolist())
        h = np.array([digest(view[a:b], SEED) for a, b in pairs], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batch):
        raw = strings(batch.column(1)).cast(pa.binary())
        fp = np.fromiter((text_fingerprint(x.as_buffer().to_pybytes()) for x in raw), np.uint64, len(raw))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=schema.names)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, run)


class Forest:
    """Union-find over 0..n-1 with path halving."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        return np.fromiter((self.root(i) for i in range(len(self.parent))), np.int64, len(self.parent))


def reference_pivots(count: int = PIVOTS) -> np.ndarray:
    """Fixed pseudo-random fingerprints."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), SEED) for k in range(count)], np.uint64)


def bucket_links(fps: np.ndarray, distance: int, side: np.ndarray | None = None, pivots: np.ndarray | None = None) -> tuple[list[tuple[int, int]], int]:
    """Edges of a spanning forest over distinct uint64 fingerprints linked at
    `distance` bits, and how many pairs were verified. side: if given, only pairs
    of different sides matter."""
    n = len(fps)
    forest, edges = Forest(n), []
    if n < 2:
        return edges, 0
    pivots = reference_pivots() if pivots is None else pivots
    # a pivot from the bucket itself: what is near it is linked at once
    label = np.arange(n)
    for p in (0, n // 2):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[p]) <= distance)
        edges += [(p, int(q)) for q in near if forest.join(p, int(q))]
    if edges:
        label = forest.labels()
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_fps = table[order], fps[order]
    first = table[:, 0]
    upto = np.searchsorted(first, first + distance, side="right")
    verified = 0
    begin = 0
    while begin < n:
        # pairs (i, j), j > i in the first coordinate's order, block by block
        end = begin + 1
        pairs = int(upto[begin] - begin)
        while end < n and pairs + (upto[end] - end) <= 400_000:
            pairs += int(upto[end] - end)
            end += 1
        rows = np.arange(begin, end)
        counts = upto[rows] - rows - 1
        i = np.repeat(rows, counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
        keep = label[order[i]] != label[order[j]]
        if side is not None:
            keep &= side[order[i]] != side[order[j]]
        i, j = i[keep], j[keep]
        for c in range(1, table.shape[1]):
            if not len(i):
                break
            keep = np.abs(table[i, c] - table[j, c]) <= distance
            i, j = i[keep], j[keep]
        verified += len(i)
        hit = np.bitwise_count(sorted_fps[i] ^ sorted_fps[j]) <= distance
        found = False
        for a, b in zip(order[i[hit]].tolist(), order[j[hit]].tolist()):
            if forest.join(a, b):
                edges.append((a, b))
                found = True
        if found:
            label = forest.labels()
        begin = end
    return edges, verified


def sorted_bucket_links(fps: np.ndarray, begins: np.ndarray, distance: int, small: int = 48) -> np.ndarray:
    """Row pairs (n, 2) of a spanning forest of each bucket; bucket k has the rows
    from begins[k] to begins[k+1]. Small buckets are solved together."""
    sizes = np.diff(np.append(begins, len(fps)))
    found = []
    for b, n in zip(begins[sizes > small].tolist(), sizes[sizes > small].tolist()):
        found += [(b + x, b + y) for x, y in bucket_links(fps[b : b + n], distance)[0]]
    pivots = reference_pivots()
    some = np.flatnonzero((sizes > 1) & (sizes <= small))
    for block in range(0, len(some), 4000):
        own = some[block : block + 4000]
        rows = np.repeat(begins[own], sizes[own]) + np.arange(int(sizes[own].sum())) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        after = np.repeat(begins[own] + sizes[own], sizes[own]) - rows - 1
        i = np.repeat(rows, after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        for p in pivots:
            if not len(i):
                break
            table = np.bitwise_count(fps[rows] ^ p).astype(np.int16)
            keep = np.abs(table[np.searchsorted(rows, i)] - table[np.searchsorted(rows, j)]) <= distance
            i, j = i[keep], j[keep]
        hit = np.bitwise_count(fps[i] ^ fps[j]) <= distance
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for a, b in zip(i[hit].tolist(), j[hit].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                found.append((a, b))
    return np.array(found, np.int64).reshape(-1, 2)


def block_masks(blocks: int) -> list[int]:
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sub_masks(mask: int, blocks: int) -> list[int]:
    """mask with one more block of its free bits, for each of `blocks` blocks."""
    free = [1 << k for k in range(BITS) if not mask >> k & 1]
    cuts = [round(k * len(free) / blocks) for k in range(blocks + 1)]
    return [mask | sum(free[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def deal_again(large: DataFrame, distance: int) -> DataFrame:
    """Rows (m, v, fp) of buckets v = fp & m dealt to buckets of more bits. Two
    fingerprints of a bucket at `distance` bits or fewer meet in one of them."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("m", "v", "fp")])
    known: dict[int, list[int]] = {}

    def run(batch):
        mask, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        masks, bits, fps = [], [], []
        for m in np.unique(mask).tolist():
            if m not in known:
                known[m] = [_signed(x) for x in sub_masks(m % (1 << BITS), distance + 1)]
            own = fp[mask == m]
            for x in known[m]:
                masks.append(np.full(len(own), x, np.int64))
                bits.append(own & np.int64(x))
                fps.append(own)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (masks, bits, fps)], names=schema.names)

    return map_batches(large.select("m", "fp"), schema, run).distinct()


def links(distinct: DataFrame, distance: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all
    that are connected; not all pairs."""
    masks = [_signed(x | y) for x, y in combinations(block_masks(distance + 2), 2)]
    dealt = distinct.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("m")).select("m", F.col("m").bitwiseAND(F.col("fp")).alias("v"), "fp")
    every = None
    while True:
        # buckets that hold one fingerprint have no pair
        sized = stored(dealt.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
        rows = dealt.join(sized, ["m", "v"])
        # with so few free bits a bucket is small, whatever bucket_rows says
        split = (F.col("n") > bucket_rows) & (F.bit_count("m") < BITS - distance - 1)
        small = rows.where(~split).select("m", "v", "fp")
        every = small if every is None else every.unionByName(small)
        if not sized.where(split).limit(1).count():
            break
        dealt = stored(deal_again(rows.where(split), distance), "simhash-large")
    edge = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        """Rows come sorted by bucket; a bucket may span batches."""
        held: list[pa.Table] = []

        def solve(tab):
            key = np.stack([tab.column(k).to_numpy() for k in range(2)], axis=1)
            fp = tab.column(2).to_numpy()
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            pairs = sorted_bucket_links(fp.view(np.uint64), new, distance)
            return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], names=edge.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            tab = pa.concat_tables(held)
            key = np.stack([tab.column(k).to_numpy() for k in range(2)], axis=1)
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield solve(tab.slice(0, cut))
            held = [tab.slice(cut)]
        if held:
            yield solve(pa.concat_tables(held))

    return every.repartition("m", "v").sortWithinPartitions("m", "v").mapInArrow(run, edge)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of the edges (a, b), the smallest node that it
    is connected to.

    In a round a node takes the least of its neighbours' labels and of that one's
    own label, and the node it was labelled with takes the least that its followers
    found (FastSV). So whole trees are hooked, and paths of 20000 nodes take 15 to 27
    rounds in any order tried. Labels only shrink: the rounds end by themselves.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(around, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("was")), "steps")
        # the label of my label
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        # what the nodes that I label found
        hooks = step.groupBy(F.col("was").alias("node")).agg(F.min("next").alias("hook"))
        moved = step.join(up, "next", "left").join(hooks, "node", "left")
        moved = moved.select("node", F.least("next", F.coalesce("above", "next"), F.coalesce("hook", "next")).alias("label"), "was")
        moved = stored(moved, "labels")
        changed = moved.where("label <> was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fp = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    return with_components(fp, distance, bucket_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_components(fp: DataFrame, distance: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """fp (doc_id, fp, ...) with component_id and label added; label is a fingerprint
    that stands for the component, also where no row of it has an id."""
    distinct = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(links(distinct.select("fp"), distance, bucket_rows)).select(F.col("node").alias("fp"), "label")
    placed = distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(least, "label").select("fp", "component_id", "label"), "components")
    return fp.join(named, "fp")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (of
    equal ids, the one with the smallest text hash; of equal rows, one).

    Rows without an id are never the smallest; of a component with only such
    rows, one with the smallest text hash stays.
    """
    (key,) = fresh(docs, "_row_key")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("h", T.LongType())])

    def run(batch):
        raw = strings(batch.column(1)).cast(pa.binary())
        blobs = [x.as_buffer().to_pybytes() for x in raw]
        fp = np.fromiter((text_fingerprint(x) for x in blobs), np.uint64, len(blobs))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], names=schema.names)

    fp = stored(map_batches(narrow.withColumn("h", F.xxhash64("text")), schema, run), "fingerprints")
    named = with_components(fp, distance)
    # the first row of each component, by partial aggregation
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("m"))
    chosen = stored(first.select(_row_key(F.col("m.doc_id"), F.col("m.h")).alias(key)).distinct(), "kept")
    # equal rows meet before the shuffle, so many copies of one row are few rows in it
    tagged = docs.withColumn(key, _row_key(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))))
    return tagged.dropDuplicates([key]).join(chosen, key).select(*docs.columns)


def _row_key(doc_id, text_hash):
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text_hash.cast("string"))
