"""Token-id shards with a minimal perfect hash index for keyed access.

write_shards() range-partitions the documents by key, tokenises each partition
and writes its shard files into the shared folder; a manifest of
one row per shard is the commit record. read_shards() reads the files back by
Spark's binaryFile source.

Shard format (little-endian), in this order:
    8 bytes   magic
    8 x i64   documents, distinct keys, ids, bytes per id, hash levels, rows with
              null key, bytes of the payload, bytes of the index
    payload   ids of all documents, in ascending key order (null keys first)
    index     one i64 of bits for each level; the levels' bit arrays, padded to
              blocks of 64 bytes; one i64 for each block, the bits set before it;
              for each slot: u32 fingerprint, u32 rows of the key, i64 offset of the
              first row's ids, i64 number of its first row
    rows      (documents + 1) x i64 offsets in ids; documents x i64 keys

The minimal perfect hash sends a key through levels of shrinking bit arrays: at
each level, keys that meet no other key set their bit, the others go on to the
next. The slot of a key is the number of bits set before its own. Slots store a
fingerprint, so that a key that was never written is refused with a chance of
1 - 2**-32. The manifest holds the first and last key of each shard; KeyedStore finds
the shard of a key there and reads a few small ranges of its file (header, one block
of bits for each level it passes, a rank, a slot, row offsets) and then the ids,
however large the shard is.

Defined results: null texts are empty (one id, the end id); equal keys are kept
as adjacent rows under one slot; null keys precede all others and are not in the
index; an empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import F, T, shared_dir, sliced, strings
from ._words import ByteLevelEncoder, held

MAGIC = b"CORVIA02"
#: Bytes of a block of bits, whose bits before are counted in the index.
BLOCK = 64
ENTRY = np.dtype([("fp", "<u4"), ("rows", "<u4"), ("offset", "<i8"), ("row", "<i8")])
HEAD = 72
#: Text bytes encoded at once: the more, the fewer calls of the library.
SLICE = 4 << 20
GAMMA = 2.0  # bits of a level's array for each of its keys
#: Multipliers of a 64-bit finalising mix (fixed values of the public splitmix64).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of int64 keys."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64(((seed + 1) * MIX[2]) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct int64 keys; levels of bit arrays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # uint8 0/1 arrays
        self.rank = np.concatenate(([0], np.cumsum(np.concatenate(levels) if levels else np.zeros(0, np.uint8), dtype=np.int64)))
        self.base = np.concatenate(([0], np.cumsum([len(x) for x in levels]))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            at = (mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append((hits == 1).astype(np.uint8))
            rest = rest[hits[at] != 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were never added."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = self.rank[self.base[k] + at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(keys: np.ndarray, nulls: int, counts: np.ndarray, ids: np.ndarray, id_bytes: int) -> bytes:
    """keys: ascending, without the null ones, which are the first `nulls` rows."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype("<i8")
    distinct, first, repeats = np.unique(keys, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slots = mph.slots(distinct)
    entries = np.zeros(len(distinct), ENTRY)
    entries["fp"][slots] = fingerprints(distinct)
    entries["rows"][slots] = repeats
    entries["row"][slots] = first + nulls
    entries["offset"][slots] = offsets[first + nulls]
    packed = [np.packbits(x).tobytes() for x in mph.levels]
    bits = b"".join(x + b"\0" * (-len(x) % BLOCK) for x in packed)
    inside = np.bitwise_count(np.frombuffer(bits, np.uint8)).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
    ranks = (np.cumsum(inside) - inside).astype("<i8").tobytes()
    index = np.array([len(x) for x in mph.levels], "<i8").tobytes() + bits + ranks + entries.tobytes()
    payload = ids.astype("<u2" if id_bytes == 2 else "<u4").tobytes()
    head = np.array([len(counts), len(distinct), len(ids), id_bytes, len(mph.levels), nulls, len(payload), len(index)], "<i8").tobytes()
    return MAGIC + head + payload + index + offsets.tobytes() + np.concatenate((np.zeros(nulls, "<i8"), keys.astype("<i8"))).tobytes()


class Shard:
    """A shard file in memory: get(key) by the index, rows() in file order."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.docs, distinct, self.n_ids, self.id_bytes, n_levels, self.nulls, payload, index = np.frombuffer(data, "<i8", 8, 8).tolist()
        at = HEAD
        self.ids = np.frombuffer(data, "<u2" if self.id_bytes == 2 else "<u4", self.n_ids, at)
        at += payload
        sizes = np.frombuffer(data, "<i8", n_levels, at).tolist()
        pos, levels = at + 8 * n_levels, []
        for n in sizes:
            width = -(-n // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, pos), count=n))
            pos += width + (-width % BLOCK)
        pos += 8 * sum(-(-n // (8 * BLOCK)) for n in sizes)  # the ranks, which unpacked bits don't need
        self.mph = PerfectHash(levels)
        self.entries = np.frombuffer(data, ENTRY, distinct, pos)
        self.offsets = np.frombuffer(data, "<i8", self.docs + 1, at + index)
        self.keys = np.frombuffer(data, "<i8", self.docs, at + index + 8 * (self.docs + 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the fingerprint says that it isn't there."""
        slots = self.mph.slots(keys)
        if not len(self.entries):
            return slots
        return np.where((slots >= 0) & (self.entries["fp"][slots] == fingerprints(keys)), slots, -1)

    def fetch(self) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of every row's ids: first the rows without a key, then each
        key's rows, from the row and offset in its slot on.

        What the slots say is compared with the order of the file afterwards.
        """
        keys = self.keys[self.nulls :]
        slots = self.find(keys)
        if (slots < 0).any():
            raise ValueError("a key is not in the index")
        entry, at = self.entries[slots], np.arange(len(keys))
        new = np.concatenate(([True], keys[1:] != keys[:-1], [True]))
        rank = at - np.maximum.accumulate(np.where(new[:-1], at, 0)) if len(keys) else at
        if (np.where(new[1:], rank + 1 != entry["rows"], False) if len(keys) else rank).any():
            raise ValueError("a key has other rows than its slot says")
        row = entry["row"] + rank
        if ((row < self.nulls) | (row >= self.docs)).any():
            raise ValueError("a slot names a row that isn't there")
        begin, end = np.where(rank == 0, entry["offset"], self.offsets[row]), self.offsets[row + 1]
        if (row != at + self.nulls).any() or (begin != self.offsets[row]).any():
            raise ValueError("a slot names another key's row")
        return np.concatenate((self.offsets[: self.nulls], begin)), np.concatenate((self.offsets[1 : self.nulls + 1], end))

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row with this key."""
        slot = int(self.find(np.array([key], np.int64))[0])
        if slot < 0:
            return []
        row, n = int(self.entries["row"][slot]), int(self.entries["rows"][slot])
        return [self.ids[self.offsets[r] : self.offsets[r + 1]] for r in range(row, row + n)]


def write_file(uri: str, data: bytes) -> None:
    """Under a name of its own first, then renamed: a task that is run twice, or
    lost halfway, leaves one whole file."""
    ctx = TaskContext.get()
    store, path = _file_system(uri)
    part = f"{path.rpartition('/')[0]}/_part-{ctx.taskAttemptId() if ctx else 0}-{path.rpartition('/')[2]}"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


class KeyedShard:
    """A shard file read by ranges: read(offset, length) gives bytes of it."""

    def __init__(self, read):
        self.read = read
        head = read(0, HEAD)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.docs, self.distinct, _, self.id_bytes, levels, _, payload, index = np.frombuffer(head, "<i8", 8, 8).tolist()
        self.sizes = np.frombuffer(read(HEAD + payload, 8 * levels), "<i8").tolist()
        blocks = [-(-n // (8 * BLOCK)) for n in self.sizes]
        self.first = np.concatenate(([0], np.cumsum(blocks))).astype(int).tolist()  # block numbers of the levels
        self.bits = HEAD + payload + 8 * levels
        self.ranks = self.bits + BLOCK * self.first[-1]
        self.slots = self.ranks + 8 * self.first[-1]
        self.rows = HEAD + payload + index

    def slot(self, key: np.ndarray) -> int:
        """-1 for some keys that were never added."""
        for k, size in enumerate(self.sizes):
            at = int(mix(key, k)[0] % np.uint64(size))
            block = self.first[k] + at // (8 * BLOCK)
            bits = int.from_bytes(self.read(self.bits + BLOCK * block, BLOCK), "big")
            after = 8 * BLOCK - 1 - at % (8 * BLOCK)
            if bits >> after & 1:
                return int(np.frombuffer(self.read(self.ranks + 8 * block, 8), "<i8")[0]) + (bits >> after + 1).bit_count()
        return -1

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row with this key."""
        own = np.array([key], np.int64)
        slot = self.slot(own)
        if slot < 0:
            return []
        entry = np.frombuffer(self.read(self.slots + ENTRY.itemsize * slot, ENTRY.itemsize), ENTRY)[0]
        if entry["fp"] != fingerprints(own)[0]:
            return []
        at = np.frombuffer(self.read(self.rows + 8 * int(entry["row"]), 8 * (int(entry["rows"]) + 1)), "<i8")
        data = self.read(HEAD + self.id_bytes * int(at[0]), self.id_bytes * int(at[-1] - at[0]))
        return np.split(np.frombuffer(data, "<u2" if self.id_bytes == 2 else "<u4"), (at[1:-1] - at[0]).tolist())


class KeyedStore:
    """Access by key over all shards of a manifest: the shards are in key order, so a
    key's are found by bisection; their index blocks are read where they are."""

    def __init__(self, manifest: DataFrame, open_shards: int = 64):
        rows = sorted(manifest.where("first_key is not null").select("first_key", "last_key", "path").collect())
        self.first, self.last, self.path = (list(x) for x in zip(*rows)) if rows else ([], [], [])
        self.opened: dict[str, tuple] = {}
        self.open_shards = open_shards

    def _shard(self, path: str) -> KeyedShard:
        if path not in self.opened:
            if len(self.opened) >= self.open_shards:
                self.opened.pop(next(iter(self.opened)))[0].close()
            store, name = _file_system(path)
            file = store.open_input_file(name)
            self.opened[path] = file, KeyedShard(lambda at, n: file.read_at(n, at))
        return self.opened[path][1]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row with this key, in the order of the shards."""
        out: list[np.ndarray] = []
        for k in range(bisect_left(self.last, key), bisect_right(self.first, key)):
            out += self._shard(self.path[k]).get(key)
        return out


#: first_key and last_key are null in a shard whose rows have no key.
MANIFEST = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("documents", "n_ids", "first_key", "last_key"))])
ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def write_shards(docs: DataFrame, vocab: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, id_bytes: int = 2, shard_ids: int = 1 << 24) -> DataFrame:
    """Write the shards; return the manifest, which is stored too.

    One shuffle deals the texts out by key range. A partition writes a shard
    whenever it holds shard_ids ids, so its memory is bounded; the rows of a key
    may continue in the next shard.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def write(batches):
        encoder = held(ByteLevelEncoder, vocab)
        if id_bytes == 2 and encoder.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need id_bytes=4")
        part = TaskContext.get().partitionId()
        held_rows: list = []
        files = 0

        def flush():
            nonlocal held_rows, files
            nulls, keys, counts, ids = (list(x) for x in zip(*held_rows))
            path = f"{folder}/ids/shard-{part:06d}-{files:04d}.bin"
            ids, counts = np.concatenate(ids), np.concatenate(counts)
            keys = np.concatenate(keys)
            write_file(path, shard_bytes(keys, sum(nulls), counts, ids, id_bytes))
            ends = [int(keys[0]), int(keys[-1])] if len(keys) else [None, None]
            row = pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([x], pa.int64()) for x in (len(counts), len(ids), *ends))], names=MANIFEST.names)
            held_rows, files = [], files + 1
            return row

        for batch in batches:
            for piece in sliced(batch, SLICE):
                ids, bounds = encoder.encode_texts(strings(piece.column(1)))
                own = piece.column(0)
                flat = np.insert(ids, bounds[1:], np.uint32(end_id)).astype(np.uint16 if id_bytes == 2 else np.uint32)
                held_rows.append((own.null_count, own.drop_null().to_numpy(zero_copy_only=False), np.diff(bounds) + 1, flat))
                if sum(len(x[3]) for x in held_rows) >= shard_ids:
                    yield flush()
        if held_rows:
            yield flush()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie")]  # rows of a hot key spread over partitions, too
    dealt = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def shard_starts(manifest: DataFrame) -> dict[str, int]:
    """Ids before each shard. The manifest has a row for each file, so it comes
    to the driver as any writer's commit messages do."""
    starts, before = {}, 0
    for r in sorted(manifest.collect(), key=lambda r: r["path"]):
        starts[r["path"].rpartition("/")[2]] = before
        before += r["n_ids"]
    return starts


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row of every document, each fetched by its key through the shard's index."""
    starts = shard_starts(manifest)
    if not starts:
        return spark.createDataFrame([], ROWS)

    def read(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard, base = Shard(memoryview(data.as_buffer())), starts[path.rpartition("/")[2]]
                try:
                    begin, end = shard.fetch()
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                sums = [zlib.crc32(shard.ids[b:e].astype("<u4").tobytes()) for b, e in zip(begin.tolist(), end.tolist())]
                ids = pa.array(shard.keys, pa.int64(), mask=np.arange(shard.docs) < shard.nulls)
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + begin), pa.array(end - begin), pa.array(sums, pa.int64())], names=ROWS.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(f"{folder}/ids")
    return files.select("path", "content").mapInArrow(read, ROWS)


def encode_and_read(docs: DataFrame, vocab: str, **options) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "shards")
    return read_shards(docs.sparkSession, folder, write_shards(docs, vocab, folder, **options))
