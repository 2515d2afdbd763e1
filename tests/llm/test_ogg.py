import hashlib
import os
import zlib

import pytest

from tsloom.llm import ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
    return c


def test_checksum_is_the_bitwise_one():
    for n in (0, 1, 27, 300):
        data = os.urandom(n)
        assert ogg.ogg_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 64, 65, 999, 1000, 5000, 70_000, 300_000])
@pytest.mark.parametrize("packet", [255, 510, 1000, 70_000])
def test_round_trip(n, packet):
    data = ogg.pad64(os.urandom(n))
    d = ogg.demux(ogg.mux(data, 8000, packet))
    assert b"".join(p[4] for p in d["packets"]) == data and d["bad"] == 0 and d["streams"] == 2
    assert all(len(p[4]) == min(packet, len(data) - i * packet) for i, p in enumerate(d["packets"]))


def test_damage_is_seen_and_the_rest_still_read():
    data = ogg.pad64(os.urandom(40_000))
    media = bytearray(ogg.mux(data))
    media[len(media) // 2] ^= 1
    d = ogg.demux(bytes(media))
    assert d["bad"] >= 1 and 0 < len(d["packets"]) < 41
    assert all(p[4] in data for p in d["packets"])
    assert ogg.demux(None)["pages"] == ogg.demux(b"junk OggS junk" * 9)["streams"] == 0


def test_query_against_the_texts(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = ogg.op5_ogg(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        p = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        m = ogg.mux(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256, r.bad_pages) == (len(m), hashlib.sha256(m).hexdigest(), 0)


def test_packets_and_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "é" * 3000)], "doc_id long, text string").selectExpr("*", "1 AS Media", "2 AS payload")
    stored = ogg.store_texts(df)
    rows = ogg.read_ogg(stored).collect()
    assert sorted(len(r.payload) for r in rows) == [64, 64, 64, 6016]
    packets = ogg.ogg_packets(stored.where("doc_id IS NULL"), "doc_id").orderBy("packet").collect()
    assert [len(p.data) for p in packets] == [1000] * 6 + [16] and [p.serial for p in packets[:3]] == [1, 2, 1]
    assert packets[2].start_s == 0.125 and packets[2].end_s == 0.25
    assert ogg.read_ogg(ogg.store_texts(df.limit(0))).count() == 0
