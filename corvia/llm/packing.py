"""Best-fit packing of tokenised documents into sequences of bounded length.

Hierarchical residual packing. Round 0 runs where the texts are read: each
partition tokenises its documents, cuts those longer than a sequence and packs
its pieces best-fit decreasing. Bins that are nearly full are emitted; underfull
bins travel on as single items (with the list of their pieces) to fewer
partitions, are packed again as items, and so on until one partition is left,
which emits all. Only underfull bins ever move, and no text does.

A partition holds at most one bin that is half full or less after a round (two
would share one), so only the emptiest bins can still gain: each partition passes
on its OPEN_BINS emptiest and emits the others as they are. So a task of a round gets at
most FAN_IN * OPEN_BINS bins, however little they combine. Round 0 packs whenever
it holds HELD_PIECES pieces and goes on with what is underfull, in the same way.

Defined results: a null text is empty; an empty document has one piece of one id
(the end id). Rows with equal or null ids are separate documents. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import F, T, map_batches, release, shared_dir, sliced, strings
from ._words import WordEndEncoder, held

#: Bins with at least this share of the capacity are emitted in any round.
NEARLY_FULL = 0.998
#: Partitions that send their underfull bins to one partition of the next round.
FAN_IN = 8
#: Underfull bins that a partition passes on to the next round.
OPEN_BINS = 1_024
#: Pieces that a partition of round 0 holds before it packs them.
HELD_PIECES = 250_000

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
BIN = T.StructType(
    [
        T.StructField("full", T.BooleanType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("pieces", T.ArrayType(PIECE)),
    ]
)
_PIECE_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin. Every item goes to the open bin that it fills
    best; bins with equal room are interchangeable, so open bins are kept as
    stacks by their room."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in order:
        need = sizes[i]
        at = bisect_left(rooms, need)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        bins[b].append(i)
        left = room - need
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def pack_items(items: list[tuple[int, list]], capacity: int, open_bins: int, last: bool = False) -> tuple[list[tuple[int, list]], list[tuple[int, list]]]:
    """(bins to emit, bins to pass on) of items (total, pieces); bins are items again."""
    done, rest = [], []
    for b in best_fit_decreasing([t for t, _ in items], capacity):
        own = (sum(items[i][0] for i in b), [p for i in b for p in items[i][1]])
        (done if last or own[0] >= NEARLY_FULL * capacity else rest).append(own)
    rest.sort(key=lambda own: own[0])
    return done + rest[open_bins:], rest[:open_bins]


class _Numbered:
    """Arrow batches of BIN rows; ids of round, partition and bin are unique over all
    emitted bins."""

    def __init__(self, round_no: int):
        self.part = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.next = (round_no << 56) | (self.part << 28)

    def rows(self, bins: list[tuple[int, list]], full: bool):
        for block in range(0, len(bins), 2000):
            own = bins[block : block + 2000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([full] * len(own), pa.bool_()),
                    pa.array(range(self.next, self.next + len(own)), pa.int64()),
                    pa.array([t for t, _ in own], pa.int64()),
                    pa.array([ps for _, ps in own], pa.list_(_PIECE_ARROW)),
                ],
                names=BIN.names,
            )
            self.next += len(own)


def document_pieces(doc_id, ids: np.ndarray, capacity: int) -> list[tuple]:
    return [
        (doc_id, k, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].astype("<u4").tobytes()))
        for k, at in enumerate(range(0, len(ids), capacity))
    ]


def pack(docs: DataFrame, vocab: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, open_bins: int = OPEN_BINS, held_pieces: int = HELD_PIECES) -> DataFrame:
    """Pieces with their sequence and place: PIECE's columns, sequence_id, offset.

    Every sequence holds at most `capacity` ids, without gaps from offset 0.
    """
    spark = docs.sparkSession
    base = shared_dir(spark, "packing")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def first(batches):
        release()
        items = []
        encoder = held(WordEndEncoder, vocab)
        out = _Numbered(0)
        for batch in batches:
            for part in sliced(batch):
                ids, bounds = encoder.encode_texts(strings(part.column(1)))
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                    items += [(p[3], [p]) for p in document_pieces(doc_id, own, capacity)]
                if len(items) >= held_pieces:
                    done, items = pack_items(items, capacity, open_bins)
                    yield from out.rows(done, True)
        done, rest = pack_items(items, capacity, open_bins)
        yield from out.rows(done, True)
        yield from out.rows(rest, False)

    def further(round_no, last):
        def run(batches):
            items = []
            for batch in batches:
                items += [(t, [tuple(p.values()) for p in ps]) for t, ps in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            done, rest = pack_items(items, capacity, open_bins, last)
            out = _Numbered(round_no)
            yield from out.rows(done, True)
            yield from out.rows(rest, False)

        return run

    def saved(df, name):
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(BIN).parquet(f"{base}/{name}")

    rounds = [saved(narrow.mapInArrow(first, BIN), "0")]
    while True:
        # bins that were passed on, not partitions, say how many tasks are of use
        n = rounds[-1].where(~F.col("full")).count()
        width = -(-n // (FAN_IN * open_bins)) or 1
        rest = rounds[-1].where(~F.col("full")).repartition(width)
        rounds.append(saved(rest.mapInArrow(further(len(rounds), width == 1), BIN), str(len(rounds))))
        if width == 1:
            break
    done = rounds[0].where("full")
    for r in rounds[1:]:
        done = done.unionByName(r.where("full"))

    def placed(batch):
        flat = batch.column(1).flatten()
        lists = batch.column(1)
        counts = np.diff(lists.offsets.to_numpy())
        length = flat.field("length").to_numpy(zero_copy_only=False)
        ends = np.cumsum(length)
        heads = np.cumsum(counts) - counts
        base_of = np.repeat((ends - length)[heads], counts) if len(counts) else np.zeros(0, np.int64)
        seq = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
        return pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(seq, pa.int64()), pa.array(ends - length - base_of, pa.int64())], names=[*PIECE.names, "sequence_id", "offset"])

    out = T.StructType([*PIECE.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_batches(done.select("sequence_id", "pieces"), out, placed)
