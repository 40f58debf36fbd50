"""SentencePiece encoding by a score-ordered agenda, for merge-type vocabularies.

A text begins with the space mark and has it for every space. Its characters are
symbols; all adjacent pairs that make a piece stand on an agenda ordered by score
(best first, leftmost of equals); the best is merged, pairs with dead symbols are
skipped, new neighbours are put on the agenda, until it is empty. Symbols that
are no piece become byte pieces.

No piece of such a vocabulary holds a space mark after another character (checked
when the model is read), so merges stay inside chunks "space marks + what follows
up to the next space", and each worker runs the agenda once for a chunk. Every
chunk's ids are compared with the sentencepiece library's in the same Arrow batch;
a difference raises an error.

Defined results: null texts are empty: begin and end ids only, decoded to "".
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import F, T, map_batches, strings
from ._words import ChunkCache, _document_offsets, _split, held

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.vocab_size()
        special = {i for i in range(n) if self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i)}
        self.piece = {self.lib.id_to_piece(i): i for i in range(n) if i not in special}
        self.score = {p: self.lib.get_score(i) for p, i in self.piece.items()}
        self.bytes = {int(self.lib.id_to_piece(i)[1:-1], 16): i for i in special if self.lib.is_byte(i)}
        bad = [p for p in self.piece if re.search(f"[^{MARK}]{MARK}", p)]
        if bad or len(self.bytes) != 256:
            raise ValueError("a vocabulary with byte pieces, whose pieces have space marks at the front only, is needed")
        self.begin, self.end = self.lib.bos_id(), self.lib.eos_id()
        self.cache = ChunkCache(lambda chunk: True, self.encode_checked, self.encode_checked)

    def merge(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        sym: list[str] = list(text)
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        score, agenda = self.score, []
        for i in range(n - 1):
            s = score.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, sym[i] + sym[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, whole = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or after[i] != j or sym[i] + sym[j] != whole:
                continue  # one of the pair has been merged since
            sym[i], sym[j] = whole, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                s = score.get(whole + sym[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, whole + sym[k]))
            h = before[i]
            if h >= 0:
                s = score.get(sym[h] + whole)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, sym[h] + whole))
        ids = []
        for s in sym:
            if s:
                own = self.piece.get(s)
                ids += [own] if own is not None else [self.bytes[b] for b in s.encode("utf-8")]
        return ids

    def encode_checked(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks begin with the mark, which the library puts before each text itself."""
        own = [self.merge(c) for c in chunks]
        lib = self.lib.encode([c[1:] for c in chunks], num_threads=1)
        for c, a, b in zip(chunks, own, lib):
            if a != b and c != MARK:  # the library has no ids for an empty text
                raise ValueError(f"the library encodes {c!r} as {b}, the agenda as {a}")
        return np.array([i for ids in own for i in ids], np.uint32), np.fromiter(map(len, own), np.int64, len(own))

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of non-empty texts, by text."""
        marked = pc.replace_substring(texts, " ", MARK)
        marked = pc.binary_join_element_wise("", marked, MARK)
        odd = pc.match_substring_regex(marked, f"{MARK}{MARK}|\\x00").to_numpy(zero_copy_only=False)
        if not odd.any():
            # no two marks meet: each begins a chunk
            parts, offsets = _split(pc.utf8_slice_codeunits(pc.replace_substring(marked, MARK, "\x00" + MARK), 1), "\x00")
            return parts, offsets
        lists = [CHUNK.findall(x) for x in marked.to_pylist()]
        return pa.array([c for own in lists for c in own], pa.string()), np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) with begin and end ids."""
        n = len(texts)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        some = texts.filter(pa.array(~empty))
        bounds = np.zeros(n + 1, np.int64)
        flat = np.zeros(0, np.uint32)
        if len(some):
            odd = pc.match_substring_regex(some, f"  | {MARK}|{MARK}|\\x00|^ ").to_numpy(zero_copy_only=False)
            counts_by_text = np.zeros(len(some), np.int64)
            parts: list = [None] * len(some)
            for kind in (False, True):  # texts with runs of spaces are cut by the general rule
                at = np.flatnonzero(odd == kind)
                if not len(at):
                    continue
                chunks, offsets = self.chunks(some.take(pa.array(at)))
                ids, counts = self.cache.lookup(chunks)
                own = _document_offsets(offsets, counts)
                counts_by_text[at] = np.diff(own)
                if len(at) == len(some):
                    flat = ids
                    break
                for k, i in enumerate(at):
                    parts[i] = ids[own[k] : own[k + 1]]
            else:
                flat = np.concatenate(parts)
            bounds[1:][~empty] = counts_by_text
        bounds = np.cumsum(bounds)
        return np.insert(flat, np.repeat(bounds, np.r_[1, np.full(n - 1, 2), 1] if n else [0]), np.r_[np.tile([self.begin, self.end], n)].astype(np.uint32)), bounds + 2 * np.arange(n + 1)


DIGESTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of every whole text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batch):
        flat, bounds = held(PieceEncoder, model).encode_texts(strings(batch.column(1)))
        ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=schema.names)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, run)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text: by the library's decode."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])

    def run(batch):
        lib = held(PieceEncoder, model).lib
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([lib.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=schema.names)

    return map_batches(encoded, schema, run)


def digests(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in the same batches, so that ids needn't pass
    through the JVM between."""

    def run(batch):
        enc = held(PieceEncoder, model)
        flat, bounds = enc.encode_texts(strings(batch.column(1)))
        ids = flat.astype("<u4")
        rows = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = ids[a:b]
            rows.append((b - a, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(enc.lib.decode(own.tolist()).encode("utf-8")).hexdigest()))
        n, i, d = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], names=DIGESTS.names)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), DIGESTS, run)
