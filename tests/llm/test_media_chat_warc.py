import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvia.llm import chat, ogg, warc
from corvia.llm._common import shared_dir

# ---- Ogg ---------------------------------------------------------------------------


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_checksum_bit_by_bit(data):
    assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 50_000, 300_001])
def test_payloads_come_back(size):
    payload = ogg.padded(bytes(k * 7 % 251 for k in range(size)))
    assert len(payload) % 576 == 0 and len(payload) >= 576 and len(payload) - size <= 576
    file = ogg.encode_payload(payload)
    back, facts = ogg.decode_payload(file)
    assert back == payload and facts["streams"] == 2 and facts["seconds"] == len(payload) / ogg.RATE
    assert file == ogg.encode_payload(payload)
    times = [t for s in ogg.read_streams(file).values() for t in ogg.packet_times(s, ogg.FRAME, ogg.RATE)]
    own = len(list(ogg.read_streams(file).values())[0].packets) - 1
    assert times[:own] == pytest.approx([k * ogg.FRAME / ogg.RATE for k in range(own)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=8), st.integers(1, 3))
def test_packets_of_any_length_in_many_streams(packets, n):
    writers = [ogg.StreamWriter(10 + k) for k in range(n)]
    for k, p in enumerate(packets):
        writers[k % n].packet(p * (1 + 100 * (k % 3 == 0)), k)
    for w in writers:
        w.flush(last=True)
    pages = [w.pages[i] for i in range(max(len(w.pages) for w in writers)) for w in writers if i < len(w.pages)]
    got = ogg.read_streams(b"".join(pages))
    for k, w in enumerate(writers):
        assert got[10 + k].packets == [p * (1 + 100 * (j % 3 == 0)) for j, p in enumerate(packets) if j % n == k]


def test_damage_is_found():
    file = ogg.encode_payload(ogg.padded(b"x" * 60_000))
    for at in (30, 5000, len(file) - 3):
        bad = bytearray(file)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.read_streams(bytes(bad))
    with pytest.raises(ValueError):
        ogg.read_streams(file[:-1])
    pages = [m.start() for m in re.finditer(b"OggS", file)]
    with pytest.raises(ValueError, match="missing page|first page|without"):
        ogg.read_streams(file[: pages[2]] + file[pages[3] :])


def test_media_digests(odd_docs, no_docs):
    got = Counter(tuple(r)[:5] for r in ogg.media_digests(ogg.text_media(odd_docs)).collect())
    want = Counter()
    for r in odd_docs.collect():
        raw = (r["text"] or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert got == want
    by_text = defaultdict(set)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in ogg.media_digests(ogg.text_media(odd_docs)).collect():
        by_text[texts.get(r["doc_id"])].add((r["media_sha256"], r["feature"]))
    assert len(by_text["same text here for all of them"]) == 1
    assert ogg.media_digests(ogg.text_media(no_docs)).count() == 0


# ---- chat --------------------------------------------------------------------------

HARD = st.lists(
    st.sampled_from(["<|im_start|>", "<|im_end|>", "<|", "im_end|>", "im_start|>", "\\", "\n", "a", "|>", "<|\\im_end|>", "assistant"]), max_size=8
).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_any_turns_come_back(turns):
    parts, got = chat.format_turns(turns)
    assert [(p.role, p.text) for p in got] == turns
    text = "".join(parts)
    for p, (_, t) in zip(got, turns):
        assert chat.unescape(text[p.begin : p.end]) == t


@settings(max_examples=200, deadline=None)
@given(HARD)
def test_escape_is_reversible_and_hides_controls(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.START not in chat.escape(text) and chat.END not in chat.escape(text)


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        turns = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[c] = (len(own), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_read_back(spark, sf_dir, monkeypatch):
    odd = [
        (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "tie"),
        (2, None, "assistant", "no number"), (2, 0, "assistant", "😀" * 1000), (None, 0, "user", "no id"), (3, 0, "user", "again"), (3, 0, "user", "again"), (4, 0, "", ""),
    ]
    kind = "conv_id long, turn long, role string, text string"
    tables = [spark.createDataFrame(odd, kind).withColumn("block", __import__("pyspark").sql.functions.lit(1)), spark.read.parquet(f"{sf_dir}/conversations.parquet")]
    for df in tables:
        rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
        want = brute_chat(rows)
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
        assert got.keys() == want.keys()
        for c, w in want.items():
            g = got[c]
            assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == w
            assert g["formatted_chars"] >= g["loss_chars"]
    assert chat.read_back(chat.format_conversations(tables[0].limit(0))).count() == 0


def test_long_conversations_are_rendered_in_blocks():
    import pandas as pd
    import pyarrow as pa

    rows = pd.DataFrame({"c": [1] * 50 + [2] * 2, "t": range(52), "r": ["user"] * 52, "x": ["y" * 100_000] * 52})
    got = list(chat._blocks(pa.Table.from_pandas(rows).to_batches(max_chunksize=7)))
    assert [sum(len(x) for _, x in t) <= chat.BLOCK_CHARS + 100_000 for _, _, t in got] == [True] * len(got)
    assert [n for c, n, _ in got if c == 1] == list(range(len(got) - 1)) and sum(len(t) for _, _, t in got) == 52


# ---- WARC ----------------------------------------------------------------------------


def brute_warc(rows):
    target = {}
    for i, _, h in rows:
        key = h or ""
        if key not in target or (i is not None and (target[key] is None or i > target[key])):
            target[key] = i
    out = Counter()
    for i, _, h in rows:
        raw, t = (h or "").encode(), target[h or ""]
        revisit = t is not None and i != t
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", t if revisit else None] += 1
    return out


def test_archives_read_back(spark, sf_dir):
    odd = [
        (1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/ü\r\nX: y", ""), (4, "http://c", None), (5, "u", "é" * 70_000), (6, "u", "a\r\n\r\nWARC/1.1\r\n"),
        (None, "n", "<p>one</p>"), (None, "n", "only null"), (7, "t", "tie"), (7, "t", "tie"), (8, "t", "tie "),
    ]
    df = spark.createDataFrame(odd, "page_id long, url string, html string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    copies = pages.unionByName(pages.selectExpr("page_id + 10000 AS page_id", "url", "html"))
    for p in (df, copies.repartition(3)):
        got = Counter(tuple(r) for r in warc.archive_and_read(p).collect())
        assert got == brute_warc([tuple(r) for r in p.collect()])
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_index_selects_records(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(3)
    folder = shared_dir(spark, "select")
    index = warc.write_archives(pages, folder)
    some = index.where("page_id % 5 = 0")
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_records(some, folder, with_payload=True).collect() if r["payload"] is not None}
    html = {r["page_id"]: r["html"].encode() for r in pages.collect()}
    assert got and all(k % 5 == 0 and html[k] == v for k, v in got.items())


def test_small_payloads_are_not_deduplicated(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "a longer one"), (4, "u", "a longer one")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive_and_read(df, min_revisit_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200_000), st.integers(1, 90_000)), max_size=12))
def test_ranges_are_coalesced(gaps):
    at, ranges = 0, []
    for g, n in gaps:
        ranges.append((at + g, n))
        at += g + n
    got = warc.coalesced(ranges)
    assert [k for _, _, inside in got for k in inside] == list(range(len(ranges)))
    for lo, hi, inside in got:
        assert lo == ranges[inside[0]][0] and hi == sum(ranges[inside[-1]])


def test_damaged_records_are_refused():
    rec = warc.record_bytes(1, "http://a", b"payload")
    assert warc.parse_record(rec)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(rec.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.parse_record(rec[:-5])
