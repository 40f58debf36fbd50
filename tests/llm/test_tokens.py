import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvia.llm import packing, sentence_pieces, token_shards
from corvia.llm._common import shared_dir
from corvia.llm._words import ByteLevelEncoder, ChunkCache, WordEndEncoder
from corvia.llm.queries import vocabulary

ENCODERS = {"byte": (ByteLevelEncoder, "byte_bpe_50k.json"), "word": (WordEndEncoder, "word_bpe_49k.json")}


@pytest.fixture(scope="module")
def encoders():
    return {k: c(vocabulary(n)) for k, (c, n) in ENCODERS.items()} | {"piece": sentence_pieces.PieceEncoder(vocabulary("piece_bpe_32k.model"))}


def plain(encoder, text):
    if isinstance(encoder, sentence_pieces.PieceEncoder):
        return encoder.lib.encode(text, add_bos=True, add_eos=True)
    return encoder.tok.encode(text, add_special_tokens=False).ids


def same(encoder, texts):
    ids, bounds = encoder.encode_texts(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == plain(encoder, t), repr(t)


@pytest.mark.parametrize("kind", ["byte", "word", "piece"])
def test_whole_documents_as_the_library(encoders, documents, kind):
    same(encoders[kind], [r["text"] or "" for r in documents.select("text").collect()])


@pytest.mark.parametrize("kind", ["byte", "word", "piece"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("aThe '.|s1é́▁ \n\t\r 　\x00😀<>")), max_size=40), min_size=1, max_size=5))
def test_any_text_as_the_library(encoders, kind, texts):
    same(encoders[kind], texts)


CONTROL = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>\n<|endoftext|> z", " <|endoftext|><|endoftext|> ", "<|ENDOFTEXT|> <|end oftext|>", "end  <|endoftext|>\t<|startoftext|> |<|endoftext|>|"]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_control_strings_as_the_library_by_itself(encoders, documents, kind):
    """Against a tokenizer that was only loaded."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary(ENCODERS[kind][1]))
    texts = CONTROL + [f"{r['text'][:300]} <|endoftext|> {r['text'][300:600]}" for r in documents.limit(50).collect()]
    ids, bounds = encoders[kind].encode_texts(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert 49407 in ids if kind == "word" else 50256 in ids


def test_queries_give_the_librarys_ids(spark, tmp_path):
    """op2 and op5 over documents with control strings."""
    from tokenizers import Tokenizer

    from corvia.llm import queries

    docs = [(k, t, "en", "src0", len(t)) for k, t in enumerate(CONTROL)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    lib = {n: Tokenizer.from_file(vocabulary(n)) for _, n in ENCODERS.values()}
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in queries.op2_best_fit_packing(spark, str(tmp_path)).collect())
    assert got == expected_pieces([d[:2] for d in docs], lib["word_bpe_49k.json"], 4096)
    for r in queries.op5_token_shards(spark, str(tmp_path)).collect():
        ids = lib["byte_bpe_50k.json"].encode(CONTROL[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_cache_is_renewed():
    calls = []

    def joined(chunks):
        calls.append(len(chunks))
        return np.array([len(c) for c in chunks], np.uint32), np.ones(len(chunks), np.int64)

    cache = ChunkCache(lambda c: True, joined, joined, limit=50)
    for turn in range(30):
        words = [f"w{turn}_{k}" * (k + 1) for k in range(20)] + ["common"]
        ids, counts = cache.lookup(pa.array(words))
        assert ids.tolist() == [len(w) for w in words] and counts.tolist() == [1] * 21
    assert len(cache.code) <= 90


def expected_pieces(rows, tok, capacity):
    out = Counter()
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out[i, k, at, len(own), zlib.crc32(own.astype("<u4").tobytes())] += 1
    return out


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, documents, odd_docs, encoders, capacity):
    for docs in (odd_docs, documents.repartition(5)):
        got = packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=capacity).collect()
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected_pieces(rows, encoders["word"].tok, capacity)
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= capacity
        total = sum(r["length"] for r in got)
        assert len(bins) <= -(-total // capacity) * 1.02 + 2


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, vocabulary("word_bpe_49k.json")).count() == 0


def test_bins_that_do_not_combine_stay_apart(spark, monkeypatch):
    """640 documents of which no two share a sequence: no task gets all of them."""
    rng = random.Random(2)
    sizes = [rng.randint(2100, 3599) for _ in range(640)]
    docs = spark.createDataFrame([(k, "a " * (n - 1)) for k, n in enumerate(sizes)], "doc_id long, text string").repartition(64)
    folders = []
    monkeypatch.setattr(packing, "shared_dir", lambda *a: folders.append(shared_dir(*a)) or folders[-1])
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), open_bins=4).collect()
    assert sorted(r["length"] for r in got) == sorted(sizes)
    assert len({r["sequence_id"] for r in got}) == 640 and all(r["offset"] == 0 for r in got)
    # bins that a task of a further round got: those that it gave
    largest = []
    for n in range(1, 9):
        try:
            rows = spark.read.parquet(f"{folders[0]}/{n}")
        except Exception:
            break
        largest.append(max(r["count"] for r in rows.groupBy(packing.F.input_file_name()).count().collect()))
    assert len(largest) >= 2 and max(largest) <= 3 * packing.FAN_IN * 4  # dealt in turns, so nearly even


def test_packing_in_parts(spark, documents, encoders):
    """A partition that holds few pieces at once packs nearly as well."""
    got = packing.pack(documents.coalesce(2), vocabulary("word_bpe_49k.json"), held_pieces=30).collect()
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected_pieces(rows, encoders["word"].tok, 4096)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 4096) * 1.05 + 2


def test_best_fit_is_best_fit():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randint(1, 100) for _ in range(60)]
        got = packing.best_fit_decreasing(sizes, 100)
        rooms = []
        for s in sorted(sizes, reverse=True):  # brute force: the fullest bin that has room
            fits = [k for k, r in enumerate(rooms) if r >= s]
            if fits:
                k = min(fits, key=lambda k: rooms[k])
                rooms[k] -= s
            else:
                rooms.append(100 - s)
        assert sorted(100 - sum(sizes[i] for i in b) for b in got) == sorted(rooms)
        assert sorted(i for b in got for i in b) == list(range(60))


def test_shards_hold_what_the_library_gives(spark, documents, odd_docs, encoders):
    tok = encoders["byte"].tok
    for docs, limit in ((documents, 1 << 24), (documents, 20_000), (odd_docs, 1 << 24)):
        got = token_shards.encode_and_read(docs, vocabulary("byte_bpe_50k.json"), shard_ids=limit).collect()
        rows = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.select("doc_id", "text").collect()]
        assert len(got) == len(rows)
        want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        got.sort(key=lambda r: r["start"])
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        keys = [r["doc_id"] for r in got]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_rows_come_from_the_slots():
    keys = np.array([3, 5, 5, 5, 9, 12], np.int64)
    counts = np.array([2, 1, 4, 2, 3, 1, 5, 2])  # two rows without a key
    data = token_shards.shard_bytes(keys, 2, counts, np.arange(counts.sum()), 2)
    ends = np.cumsum(counts)
    begin, end = token_shards.Shard(data).fetch()
    assert begin.tolist() == (ends - counts).tolist() and end.tolist() == ends.tolist()
    for field, by in (("row", 1), ("row", -1), ("row", 1000), ("offset", 1), ("rows", 1), ("rows", -1)):
        for key in (3, 5, 12):
            shard = token_shards.Shard(data)
            shard.entries = shard.entries.copy()
            shard.entries[field][shard.find(np.array([key]))] += np.array(by).astype(shard.entries[field].dtype)
            with pytest.raises(ValueError):
                shard.fetch()
    for n in (0, 2):
        empty = token_shards.Shard(token_shards.shard_bytes(keys[:0], n, counts[:n], np.arange(counts[:n].sum()), 2))
        assert empty.fetch()[0].tolist() == [0, 2][:n]


def test_shards_of_nothing(no_docs):
    assert token_shards.encode_and_read(no_docs, vocabulary("byte_bpe_50k.json")).count() == 0


def test_keyed_access(spark, documents, encoders):
    folder = shared_dir(spark, "keyed")
    manifest = token_shards.write_shards(documents, vocabulary("byte_bpe_50k.json"), folder)
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    seen = 0
    for r in spark.read.format("binaryFile").load(f"{folder}/ids").collect():
        shard = token_shards.Shard(bytes(r["content"]))
        for key in shard.keys.tolist():
            (ids,) = shard.get(key)
            assert ids.tolist() == plain(encoders["byte"], texts[key]) + [0]
            seen += 1
        refused = [k for k in range(10**6, 10**6 + 3000) if not shard.get(k)]
        assert len(refused) == 3000
    assert seen == len(texts) == sum(r["documents"] for r in manifest.collect())


def test_keyed_access_across_shards(spark, documents, odd_docs, encoders):
    """By the manifest's key ranges, with a few small reads in the shard's file."""
    docs = documents.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    folder = shared_dir(spark, "keyed")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    manifest = token_shards.write_shards(docs, vocabulary("byte_bpe_50k.json"), folder, shard_ids=5_000)
    assert manifest.count() > 4
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    store = token_shards.KeyedStore(manifest, open_shards=3)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for key, own in texts.items():
        if key is not None:
            want = Counter(tuple(encoders["byte"].tok.encode(t, add_special_tokens=False).ids + [0]) for t in own)
            assert Counter(tuple(x.tolist()) for x in store.get(key)) == want
    assert len(store.opened) <= 3
    assert not any(store.get(k) for k in [*range(10**6, 10**6 + 300), -(2**63), 2**63 - 1] if k not in texts)


def test_keyed_reads_are_few_and_small():
    for n in (100, 100_000):
        keys = np.arange(n, dtype=np.int64) * 7
        data = token_shards.shard_bytes(keys, 0, np.full(n, 3), np.arange(3 * n) % 50_000, 2)
        sizes = []
        shard = token_shards.KeyedShard(lambda at, m: sizes.append(m) or data[at : at + m])
        for k in range(0, n, max(1, n // 50)):
            sizes.clear()
            (ids,) = shard.get(int(keys[k]))
            assert ids.tolist() == [(3 * k + j) % 50_000 for j in range(3)]
            assert len(sizes) <= 4 + len(shard.sizes) and sum(sizes) <= 64 * len(shard.sizes) + 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=300))
def test_hash_is_perfect_and_minimal(keys):
    k = np.array(keys, np.int64)
    assert sorted(token_shards.PerfectHash.build(k).slots(k).tolist()) == list(range(len(keys)))


def test_piece_digests(spark, odd_docs, no_docs, encoders):
    lib, path = encoders["piece"].lib, vocabulary("piece_bpe_32k.model")
    got = Counter(tuple(r) for r in sentence_pieces.digests(odd_docs, path).collect())
    want = Counter()
    for r in odd_docs.collect():
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    assert sentence_pieces.digests(no_docs, path).count() == 0
    both = sentence_pieces.decode(sentence_pieces.encode(odd_docs, path), path).collect()
    assert {r["text"] for r in both} >= {"negative id", "same text here for all of them", ""}


def test_word_ends_at_marks_and_in_any_case_are_the_library_s():
    """Chunks that end before a mark or are in lower case have the ids of whole texts, and there are fewer."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    texts = ["The End.", "the end. The END, the end!\nThe end?", "A. b, C; d: E! f?", "it's, IT'S. it'S!", "x... y.. z.,", "W̊ ẘ. J̌, ǰ", "İ. İ. ΣΣ. aΣ. ",
             "<|ENDOFTEXT|>. <|endoftext|>. a<|endoftext|>, A.<|startoftext|> B.", "9. a9. 9a, é. É, é.", "a.\tb. c. D. e.　", ".", " . a .", "a. ́b", "Z.\n\n. ", "", "KK. ﬁ. ǅ, aͅ."]
    lib = Tokenizer.from_file(path)
    enc = WordEndEncoder(path)
    ids, bounds = enc.encode_texts(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == lib.encode(text, add_special_tokens=False).ids, text
    few = WordEndEncoder(path)
    few.encode_texts(pa.array(["The end. the END, the end! THE end"]))
    assert set(few.cache.code) == {"the", "end", ".", ",", "!"}
