import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corvia.llm import simhash


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4):
    """rows: (doc_id, fp) -> component of each row."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [min(least[root(k)], default=None) for k in range(len(rows))]


def expected(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    return Counter((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps)))


def test_documents_against_brute_force(spark, documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
        assert got == expected(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def planted(seed, n=1500):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        f = rng.getrandbits(64)
        out.add(f)
        for _ in range(rng.choice([0, 0, 3, 40])):
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [4, 50, 4000])
def test_planted_fingerprints(spark, bucket_rows):
    """Also with buckets so small that all are dealt out again."""
    fps = planted(bucket_rows)
    rows = [(k, f) for k, f in enumerate(fps)]
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in rows], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.with_components(df, 4, bucket_rows).collect()}
    want = brute_components(rows)
    assert [got[k] for k in range(len(rows))] == want


@pytest.mark.parametrize("small", [0, 48])
def test_buckets_report_a_spanning_forest(small):
    fps = np.array(planted(9, 600), np.uint64)
    got = simhash.sorted_bucket_links(fps, np.array([0]), 4, small)
    assert len(got) < len(fps)
    forest = simhash.Forest(len(fps))
    for a, b in got:
        assert int(fps[a] ^ fps[b]).bit_count() <= 4
        forest.join(int(a), int(b))
    want = brute_components(list(enumerate(map(int, fps))))
    assert [min(k for k in range(len(fps)) if forest.root(k) == forest.root(i)) for i in range(0, len(fps), 37)] == want[::37]


def test_dense_bucket_stays_linear():
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    edges, verified = simhash.bucket_links(fps, 4)
    assert len(edges) == len(fps) - 1 and verified < 20 * len(fps)


def test_chains_settle(spark):
    n = 300
    df = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(df).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_chains_settle_in_any_order(spark, monkeypatch):
    """Ascending ids with the smallest at the far end, random ids, reversed bits."""
    n = 256
    orders = [[*range(1, n), 0], random.Random(3).sample(range(n), n), [int(f"{k:08b}"[::-1], 2) for k in range(n)]]
    rows = [(n * c + p, n * c + q) for c, ids in enumerate(orders) for p, q in zip(ids, ids[1:])]
    written = []
    keep = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, label: written.append(label) or keep(df, label))
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {n * c + k: n * c for c in range(len(orders)) for k in range(n)}
    assert written.count("labels") <= 20


def test_one_document_of_each_group_stays(spark, documents, odd_docs):
    for docs in (documents, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        fps = [(i, brute_fingerprint(t)) for i, t in rows]
        want = {c for c in brute_components(fps) if c is not None}
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert Counter(i for i in ids if i is not None) == Counter(want)


def test_components_without_ids_keep_one_row(spark):
    """Texts at a small distance, none with an id: one stays, not one of each text."""
    rng = random.Random(6)
    while True:
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        near = [*words[:-1], f"w{rng.randrange(10**6)}"]
        apart = (brute_fingerprint(" ".join(words)) ^ brute_fingerprint(" ".join(near))).bit_count()
        if 0 < apart <= 4:
            break
    other = " ".join(f"x{k}" for k in range(200))
    docs = spark.createDataFrame([(None, " ".join(words)), (None, " ".join(near)), (None, " ".join(near)), (None, other)], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 2


def test_large_buckets_are_dealt_in_proportion(spark, monkeypatch):
    """Fingerprints that share two blocks: each row is dealt distance + 1 times again,
    not once for each part of its bucket, and no bucket stays large."""
    n, limit = 20_000, 500
    rng = np.random.default_rng(8)
    low = np.unique(rng.integers(0, 1 << 42, n, dtype=np.uint64))
    fps = (low | np.uint64(0x2AB5 << 50)).view(np.int64)
    seen = {}
    keep = simhash.stored

    def stored(df, label):
        out = keep(df, label)
        seen.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 4, limit).count()
    assert [x.count() for x in seen["simhash-large"]][0] <= 5 * len(fps) and len(seen["simhash-large"]) <= 2
    assert seen["simhash-buckets"][0].where(f"n > {limit}").count() == 1
    assert seen["simhash-buckets"][-1].where(f"n > {limit}").count() == 0


def test_blocks_of_free_bits_lose_no_pair():
    rng = random.Random(12)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        masks = [a | b for k, a in enumerate(simhash.block_masks(6)) for b in simhash.block_masks(6)[k + 1 :]]
        met = [m for m in masks if x & m == y & m]
        assert met
        for _ in range(4):
            met = [s for m in met for s in simhash.sub_masks(m, 5) if x & s == y & s][:1]
            assert met


def test_pivots_discard_most_pairs():
    """Of one bucket's random pairs, few are left to verify."""
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 43, 3000, dtype=np.uint64))
    _, verified = simhash.bucket_links(fps, 4)
    assert verified <= 0.03 * len(fps) * (len(fps) - 1) / 2
