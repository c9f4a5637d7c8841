import gzip
import hashlib
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrail.llm import media, queries, sharding, warc

from .conftest import AWKWARD

DIR = "/root/testdata/sf0.001"


def test_media_rows_against_plain_code(spark, docs_of):
    docs = docs_of(AWKWARD)
    stored = media.store_texts(docs)
    rows = media.fingerprint_media(stored).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in AWKWARD)
    wavs = Counter(bytes(r.media) for r in stored.collect())
    seen = Counter()
    for i, t in AWKWARD:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or 64 * (not data))
        wav = media.write_wav(payload)
        assert media.read_wav(wav) == payload and len(payload) % 64 == 0
        seen[wav] += 1
        own = [r for r in rows if r.doc_id == i and r.n_bytes == len(data)]
        assert own and own[0].payload_sha256 == hashlib.sha256(payload).hexdigest() and own[0].tail_crc32 == zlib.crc32(payload[-64:])
        assert own[0].media_sha256 == hashlib.sha256(wav).hexdigest() and own[0].media_bytes == len(wav)
        assert len({(tuple(r.fp_time), tuple(r.fp_code)) for r in own}) == 1
    assert wavs == seen
    assert media.fingerprint_media(media.store_texts(docs.limit(0))).count() == 0


def test_fingerprint_by_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    samples = bytes(rng.integers(0, 256, 3000, dtype=np.uint8))
    t, code = media.fingerprint(samples)
    x = np.frombuffer(samples, np.uint8).astype(float)
    peaks, strongest = [], {}
    for k in range(-(-(len(x) - media.FRAME) // media.HOP) + 1):
        frame = x[k * media.HOP : k * media.HOP + media.FRAME]
        frame = np.pad(frame, (0, media.FRAME - len(frame)), constant_values=128)
        p = np.abs(np.fft.rfft((frame - frame.mean()) * np.hanning(media.FRAME))) ** 2
        local = [f for f in range(1, len(p) - 1) if p[f] > p[f - 1] and p[f] >= p[f + 1] and p[f] > 1e-6]
        peaks += [(k, f) for f in sorted(sorted(local, key=lambda f: -p[f])[: media.PEAKS])]
        strongest[k] = max(local, key=lambda f: (p[f], -f), default=None)
    want = [(k, (f << 16) | (strongest[k + d] << 8) | d) for k, f in peaks for d in (1, 3, 9, 27) if strongest.get(k + d)]
    assert len({c & 255 for _, c in want}) > 1
    assert list(zip(t.tolist(), code.tolist())) == want
    whole = media.fingerprint(samples * 20)
    assert len(whole[0]) and {1, 3, 9, 27} == set((whole[1] & 255).tolist())
    monkeypatch.setattr(media, "BLOCK", 7)
    again = media.fingerprint(samples * 20)
    assert all((a == b).all() for a, b in zip(whole, again))


def test_padding_with_silence_makes_no_peak():
    """A last frame that is filled up has the spectrum of the samples and silence, without a step to another level."""
    flat = bytes([128]) * 300
    assert len(media.fingerprint(flat)[0]) == 0 and all((p < 1e-6).all() for p in media.spectra(flat))


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 400
    rows = [(1, "a" * 100), (2, "a" * 100), (3, "a" * 99), (4, "a" * 99), (5, None), (6, ""), (7, big), (8, big), (9, "\r\n" * 80), (10, "x" * 5000), (None, "z" * 200), (11, "z" * 200), (12, "tail\n"), (12, "tail\n")]
    pages = spark.createDataFrame([(i, None, h, "c") for i, h in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(pages, f"{tmp_path}/w", chunk_bytes=1000)
    got = {}
    for r in warc.read_pages(spark, f"{tmp_path}/w").collect():
        got.setdefault(r.page_id, []).append(r)
    assert Counter({k: len(v) for k, v in got.items()}) == Counter(i for i, _ in rows)
    for i, h in rows:
        data = (h or "").encode()
        for r in got[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i for i in got if got[i][0].record_type == "revisit"} == {2, 8, 11}
    assert (got[2][0].refers_to, got[8][0].refers_to, got[11][0].refers_to) == (1, 7, None)
    chunks = warc.read_chunks(spark, f"{tmp_path}/w").where("page_id = 7").orderBy("chunk_no").collect()
    data, sizes = big.encode(), [c.chunk_bytes for c in chunks]
    assert len(chunks) == -(-len(data) // 1000) and sum(sizes) == len(data) and max(sizes) <= 1000
    at = 0
    for c in chunks:
        at += c.chunk_bytes
        assert c.running_bytes == at and c.running_sha256 == hashlib.sha256(data[:at]).hexdigest() and c.last == (at == len(data))
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_pages(spark, f"{tmp_path}/none").count() == 0


def test_warc_parser_takes_any_cut():
    data = b"".join(line + warc.END for line in warc.record_rows(warc.record_names(uuid.UUID(int=0), 0), b"2024-01-01T00:00:00Z", 3, b"q" * 2500, hashlib.sha256(b"q" * 2500).hexdigest(), None, False, 1000))
    for size in (1, 7, 1000):
        parser, rows = warc.ChunkParser(), []
        for at in range(0, len(data), size):
            rows += list(parser.feed(data[at : at + size]))
        assert [r[5] for r in rows] == [1000, 1000, 500] and rows[-1][7] == hashlib.sha256(b"q" * 2500).hexdigest()
    with pytest.raises(ValueError):
        list(warc.ChunkParser().feed(b"HTTP/1.1 200\r\n\r\n"))


def test_records_have_dates_and_their_own_ids(spark, tmp_path):
    rows = [(1, "a" * 100), (1, "a" * 100), (1, "b"), (2, "a" * 100), (None, "c" * 2500), (None, "c" * 2500)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    warc.write_archives(pages.repartition(3), f"{tmp_path}/w", chunk_bytes=1000)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    names, heads = re.findall(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)\r\n", data), data.count(b"WARC/1.1\r\n")
    assert len(names) == len(set(names)) == heads == 10 and len(re.findall(rb"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", data)) == heads
    assert re.findall(rb"WARC-Refers-To-Target-URI: (\S+)", data) == [b"urn:page:1"]


def test_more_repeats_than_a_broadcast_takes(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "x" * (100 + i % 7)) for i in range(30)], "page_id long, html string")
    got = []
    for most in (100, 3):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        warc.write_archives(pages, f"{tmp_path}/{most}")
        got.append(sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_pages(spark, f"{tmp_path}/{most}").collect()))
    assert got[0] == got[1] == [(i, "revisit" if i > 6 else "response", i % 7 if i > 6 else None) for i in range(30)]


def test_reading_other_archives(spark, tmp_path):
    """Version 1.0, names in other cases, types and targets of any kind, no digest, blocks that aren't text."""
    block = bytes(range(256)) * 5 + b"\r\n\r\nWARC/1.0\r\n"
    info, http = b"software: x\r\n", b"HTTP/1.1 200 OK\r\n\r\n" + block
    data = b"WARC/1.0\r\nwarc-type:warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(info), info)
    data += b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: http://example.com/\r\nWARC-Payload-Digest: sha1:ABC\r\nCONTENT-LENGTH: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    rows = sorted(warc.read_chunks(spark, f"{tmp_path}/a.warc.gz").collect(), key=lambda r: r.record_id)
    assert [(r.record_type, r.target_uri, r.page_id, r.running_bytes, r.stated_digest, r.last) for r in rows] == [("warcinfo", None, None, len(info), None, True), ("response", "http://example.com/", None, len(http), None, True)]
    assert rows[1].running_sha256 == hashlib.sha256(http).hexdigest()


def plain_jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, -1, 2**62, *range(100, 3000)], np.int64)
    for n in (1, 2, 24, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(b[a != b].tolist()) == {24} and 0.02 < (a != b).mean() < 0.06
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_shards(spark, docs_of):
    rows = [*AWKWARD, *((7, "same"),) * 25, *((i, f"t{i}") for i in range(100, 400))]
    found = sharding.with_slots(sharding.shard_documents(docs_of(rows), 24).drop("slot"), "shard", ["doc_id", "size", "text_crc32"], group_rows=5, copies=10)
    got = found.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        assert r.shard == plain_jump(r.doc_id or 0, 24) and r.grown_shard == plain_jump(r.doc_id or 0, 25)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for s in by:
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert own == sorted(own, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    assert sharding.shard_documents(docs_of(rows).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_media_fingerprints", "op3_warc_chunks", "op5_jump_shards"])
def test_queries(spark, name):
    table = "pages" if name.startswith("op3") else "documents"
    assert queries.queries()[name](spark, DIR).count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()


def test_op5_contract(spark):
    df = queries.op5_jump_shards(spark, DIR)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert df.where((F.col("shard") != F.col("grown_shard")) & (F.col("grown_shard") != 24)).count() == 0


def test_pages_of_ordinary_archives(spark, tmp_path):
    """Without our length header and with digests of other kinds, what was read counts."""
    records = [(b"<urn:uuid:1>", b"response", b"http://a/", b"x" * 300, b"sha1:ABC"), (b"<urn:uuid:2>", b"revisit", b"http://a/", b"", b"sha1:ABC")]
    data = b"".join(b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\nWARC-Target-URI: %s\r\nWARC-Payload-Digest: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, name, uri, digest, len(block), block) for name, kind, uri, block, digest in records)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    got = sorted(tuple(r) for r in warc.read_pages(spark, f"{tmp_path}/b.warc.gz").select("record_type", "payload_bytes", "payload_digest").collect())
    assert got == [("response", 300, hashlib.sha256(b"x" * 300).hexdigest()), ("revisit", None, None)]
