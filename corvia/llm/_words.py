"""Whole-text tokenisation through a cache of text chunks.

A subword vocabulary never merges across certain places of a text (for example
an isolated space before a letter). Cutting texts there gives chunks whose ids
can be looked up, so that each worker encodes a chunk once however often the
corpus repeats it. Texts with unusual white space, where such places are not
obvious, are encoded whole.

Ids are those of the library as it is loaded: strings of a vocabulary's control
tokens inside a text become their ids. They hold no white space, so no place where
texts are cut is inside one.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks held per worker before the cache starts anew.
CACHE_CHUNKS = 400_000
#: RE2: adjacent white space, NUL, or white space other than space and newline.
ODD = r"[ \n][ \n]|[\x00\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


class ChunkCache:
    """chunk -> ids, kept as one flat array; lookup(chunks) gives their ids.

    joinable(chunk): encode_joined may encode it together with others.
    Both encoders return (flat ids, ids of each chunk).
    """

    def __init__(self, joinable, encode_joined, encode_single, limit: int = CACHE_CHUNKS):
        self.joinable, self.encode_joined, self.encode_single, self.limit = joinable, encode_joined, encode_single, limit
        self._empty()

    def _empty(self) -> None:
        self.code: dict[str, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.seen = np.zeros(1024, np.int32)  # batches that had the chunk
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _append(self, chunks: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        n0, n1 = len(self.code), len(self.code) + len(chunks)
        while n1 > len(self.start):
            self.start, self.count, self.seen = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.count, self.seen))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.count[n0:n1] = counts
        self.start[n0:n1] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.code.update(zip(chunks, range(n0, n1)))

    def _renew(self) -> None:
        """Keep the chunks that several batches had; drop all if those are too many."""
        keep = np.flatnonzero(self.seen[: len(self.code)] > 1)
        names, ids, start, count = list(self.code), self.ids, self.start, self.count
        self._empty()
        if 0 < len(keep) <= self.limit // 2:
            n = count[keep]
            ends = np.cumsum(n)
            take = np.repeat(start[keep] - (ends - n), n) + np.arange(int(ends[-1]))
            self._append([names[i] for i in keep], ids[take], n)
            self.seen[: len(keep)] = 1

    def lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, number of ids of each chunk)."""
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.code) > self.limit:
            self._renew()
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        get = self.code.get
        codes = np.fromiter((get(w, -1) for w in distinct), np.int64, len(distinct))
        missing = [distinct[i] for i in np.flatnonzero(codes < 0)]
        if missing:
            single = []
            joined = []
            for w in missing:
                (joined if self.joinable(w) else single).append(w)
            for block in range(0, len(joined), 4096):
                part = joined[block : block + 4096]
                self._append(part, *self.encode_joined(part))
            if single:
                self._append(single, *self.encode_single(single))
            codes[codes < 0] = np.fromiter((get(w) for w in missing), np.int64, len(missing))
        self.seen[codes] += 1
        at = codes[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[at]
        ends = np.cumsum(counts)
        take = np.repeat(self.start[at] - (ends - counts), counts) + np.arange(int(ends[-1]), dtype=np.int64)
        return self.ids[take], counts


def _document_offsets(chunk_offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(counts)))
    return run[chunk_offsets]


def _split(texts: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(texts, mark)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])), offsets - offsets[0]


class Encoder:
    """Ids of whole texts: encode_texts(array) -> (flat ids, document offsets)."""

    def __init__(self):
        self.cache = ChunkCache(self.joinable, self.encode_joined, self.encode_single)

    def joinable(self, chunk: str) -> bool:
        return False

    def encode_joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_single(chunks)

    def encode_single(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _gathered([self.encode_whole(c) for c in chunks])

    def encode_whole(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def odd(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        raise NotImplementedError

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        odd = self.odd(texts)
        plain = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        chunks, offsets = self.chunks(plain)
        flat, counts = self.cache.lookup(chunks)
        bounds = _document_offsets(offsets, counts)
        if not odd.any():
            return flat, bounds
        parts = [flat[bounds[i] : bounds[i + 1]] if not odd[i] else self.encode_whole(texts[i].as_py()) for i in range(n)]
        return np.concatenate(parts).astype(np.uint32), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _gathered(parts: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for p in parts for i in p], np.uint32), np.fromiter((len(p) for p in parts), np.int64, len(parts))


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ByteLevelEncoder(Encoder):
    """Byte-level BPE whose pre-tokens may begin with one space.

    Chunks keep their leading space or newline; a text is the concatenation of
    its chunks.
    """

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        vocab = self.tok.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id: one character of its string a byte
        for s, i in vocab.items():
            self.width[i] = len(s)
        super().__init__()

    def chunks(self, texts):
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
        return _split(marked, "\x00")

    def encode_whole(self, text):
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_single(self, chunks):
        return _gathered([e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)])

    def joinable(self, chunk):
        return len(chunk) > 1 and chunk[0] in " \n" and not chunk[1].isspace()

    def encode_joined(self, chunks):
        flat = np.array(self.tok.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.cumsum(np.fromiter((len(c.encode("utf-8")) for c in chunks), np.int64, len(chunks)))
        ends = np.cumsum(self.width[flat])
        cuts = np.searchsorted(ends, sizes)
        if not np.array_equal(ends[np.minimum(cuts, len(ends) - 1)], sizes):
            return self.encode_single(chunks)  # a token crosses chunks
        return flat, np.diff(cuts + 1, prepend=0)


class WordEndEncoder(Encoder):
    """BPE with word ends, which drops white space: chunks are the runs between
    spaces and newlines. SEPARATOR stands between chunks that are encoded at
    once; chunks that contain it are encoded by themselves.

    Where the vocabulary ends a word between a letter and a mark, a chunk ends there,
    too; where it ignores case, chunks are in lower case, so that there are fewer.
    Texts with combining marks, which lower-case letters may join otherwise, or with
    what begins a control string keep their case."""

    SEPARATOR = "|"
    MARK = r"([A-Za-z])([.,;:!?])([ \n]|$)"
    CASED = r"[\x{300}-\x{36f}]|<\|"

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        (self.sep,) = self.tok.encode(self.SEPARATOR, add_special_tokens=False).ids
        self.caseless = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("AZ") == "az"
        self.marks_apart = self.tok.pre_tokenizer is not None and all([s for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(w + m)] == [w, m] for w in ("ab", "z") for m in ".,;:!?")
        super().__init__()

    def odd(self, texts):
        return np.zeros(len(texts), bool)  # any white space inside a chunk is the library's affair

    def chunks(self, texts):
        if self.caseless:
            cased = pc.match_substring_regex(texts, self.CASED)
            lower = pc.ascii_lower(texts)
            texts = pc.if_else(cased, texts, lower) if pc.any(cased).as_py() else lower
        if self.marks_apart:
            texts = pc.replace_substring_regex(texts, self.MARK, r"\1 \2\3")
        return _split(pc.replace_substring(texts, "\n", " "), " ")

    def encode_whole(self, text):
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_single(self, chunks):
        return _gathered([e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)])

    def joinable(self, chunk):
        return self.SEPARATOR not in chunk and chunk.strip() != ""

    def encode_joined(self, chunks):
        flat = np.array(self.tok.encode_batch_fast([f" {self.SEPARATOR} ".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(flat == self.sep)
        if len(cuts) != len(chunks) - 1:
            return self.encode_single(chunks)
        bounds = np.concatenate((cuts - np.arange(len(cuts)), [len(flat) - len(cuts)]))
        return flat[flat != self.sep], np.diff(bounds, prepend=0)


_held: dict = {}


def held(kind, path: str):
    """One encoder per worker process and vocabulary: its cache outlives a task."""
    if (kind, path) not in _held:
        _held[kind, path] = kind(path)
    return _held[kind, path]
