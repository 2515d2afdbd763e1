"""Media columns in Ogg containers (RFC 3533): checksums, lacing, logical streams, granule timestamps.

store_texts() turns texts into Ogg files held in a binary column: the payload's bytes, taken as unsigned 8-bit samples, are cut
into packets that two logical streams carry in turn. read_ogg() verifies each page's CRC, reassembles packets from the
lacing values (also across pages), demultiplexes the streams by serial number, dates packets by granule position and
merges the streams in order of time. ogg_packets() lists the packets themselves, one row each.

Nulls and odd input: a null text counts as empty; an empty payload is padded to 64 zero bytes. A null or foreign media
value gives zero pages, zero packets and an empty payload. A page with a bad checksum or a gap in the page numbers is
counted in bad_pages, and packets it breaks are left out. Rows are independent, so repeated rows, ties and empty tables
need no rule; other input columns are kept, and result columns replace input columns of the same name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_RATE = 8000
PACKET_BYTES = 1000
#: A page ends once its body has so many bytes, or 255 lacing values.
PAGE_BYTES = 4096
#: Arrow batches are passed on once they hold about so many bytes.
BATCH_BYTES = 8_000_000

_HEADER, _IDENT = "<4sBBqIIIB", "<8sIBBI"
_MAGIC = b"pcm8\x00raw"
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 of Ogg: polynomial 0x04C11DB7, most significant bit first, no initial or final inversion.

    zlib has the mirrored form of the same polynomial, so the bits of every byte and of the result are mirrored."""
    x = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_MIRROR), "big")


def pad64(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 if data else 64)


def make_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(_HEADER, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", ogg_crc(head + body)) + head[26:] + body


class _Stream:
    """Lays the packets of one logical stream out in pages."""

    def __init__(self, serial: int):
        self.serial, self.number, self.samples = serial, 0, 0
        self.lacing, self.body, self.size, self.granule, self.open = bytearray(), [], 0, -1, False

    def flush(self, last: bool = False, first: bool = False) -> bytes:
        flags = (1 if self.open else 0) | (2 if first else 0) | (4 if last else 0)
        page = make_page(self.serial, self.number, flags, self.granule, bytes(self.lacing), b"".join(self.body))
        self.open = bool(self.lacing) and self.lacing[-1] == 255
        self.number += 1
        self.lacing, self.body, self.size, self.granule = bytearray(), [], 0, -1
        return page

    def add(self, packet: bytes) -> Iterator[bytes]:
        """Takes in a packet; gives the pages that it fills."""
        at = 0
        while True:
            part = packet[at : at + 255]
            self.lacing.append(len(part))
            self.body.append(part)
            self.size += len(part)
            at += len(part)
            if len(part) < 255:
                self.samples += len(packet)
                self.granule = self.samples
            if len(self.lacing) == 255 or self.size >= PAGE_BYTES:
                yield self.flush()
            if len(part) < 255:
                return


def mux(payload: bytes, rate: int = SAMPLE_RATE, packet_bytes: int = PACKET_BYTES) -> bytes:
    """An Ogg file: identification pages of two streams, then their data pages; packet i goes to stream i mod 2."""
    streams, out = [_Stream(1), _Stream(2)], []
    for i, s in enumerate(streams):
        ident = struct.pack(_IDENT, _MAGIC, rate, i, len(streams), packet_bytes)
        s.lacing.append(len(ident))
        s.body.append(ident)
        s.granule = 0
        out.append(s.flush(first=True))
    for i, at in enumerate(range(0, len(payload), packet_bytes)):
        out.extend(streams[i % 2].add(payload[at : at + packet_bytes]))
    out.extend(s.flush(last=True) for s in streams)
    return b"".join(out)


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes] | None]:
    """(serial, number, flags, granule, lacing, body) of each page; None for one whose checksum fails."""
    at = media.find(b"OggS")
    while at >= 0 and at + 27 <= len(media):
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from(_HEADER, media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version == 0 and end <= len(media) and ogg_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) == crc:
            yield serial, number, flags, granule, lacing, media[at + 27 + n : end]
            at = media.find(b"OggS", end)
        else:
            yield None
            at = media.find(b"OggS", at + 4)


def demux(media: bytes | None) -> dict:
    """Packets (start sample, stream, serial, index, bytes) in order of time, and counts."""
    state: dict[int, dict] = {}
    n_pages = bad = 0
    for p in pages(media or b""):
        n_pages += 1
        if p is None:
            bad += 1
            continue
        serial, number, flags, granule, lacing, body = p
        s = state.setdefault(serial, {"next": 0, "part": None, "ident": None, "packets": [], "whole": False})
        if number != s["next"]:
            bad += 1
            s["part"] = None
        s["next"] = number + 1
        if not flags & 1:
            s["part"] = b""
        at, done, size = 0, [], 0
        for x in lacing:
            size += x
            if x < 255:
                if s["part"] is not None:
                    done.append(s["part"] + body[at : at + size])
                at, size, s["part"] = at + size, 0, b""
        if size and s["part"] is not None:
            s["part"] += body[at : at + size]
        if s["ident"] is None and done and done[0][:8] == _MAGIC and len(done[0]) == struct.calcsize(_IDENT):
            s["ident"] = struct.unpack(_IDENT, done.pop(0))
        end = granule
        for d in reversed(done):  # the granule position dates the last packet that ends on the page
            end -= len(d)
            s["packets"].append((end, d))
        s["whole"] |= bool(flags & 4)
    found, ends = [], []
    for serial, s in state.items():
        if s["ident"]:
            found += [(start, s["ident"][2], serial, s["ident"][1], d) for start, d in s["packets"]]
            ends.append(max([a + len(d) for a, d in s["packets"]], default=0) / s["ident"][1])
    found.sort(key=lambda x: x[:3])
    return {"pages": n_pages, "bad": bad, "streams": len(ends), "seconds": max(ends, default=0.0), "packets": found}


def _sent(df: DataFrame, made: dict[str, T.DataType], row) -> DataFrame:
    """df with the columns of made, which row(dict of a row) returns; batches are split by size."""
    kept = [f for f in df.schema.fields if f.name.lower() not in {k.lower() for k in made}]
    schema = T.StructType(kept + [T.StructField(k, t) for k, t in made.items()])
    names = [f.name for f in kept]
    arrow = {k: {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[t.simpleString().replace("bigint", "long")] for k, t in made.items()}

    def run(batches):
        for b in batches:
            a = 0
            cols: dict[str, list] = {k: [] for k in made}
            held = 0
            for i, r in enumerate(row(b)):
                for k, v in zip(made, r, strict=True):
                    cols[k].append(v)
                    held += len(v) if isinstance(v, bytes) else 8
                if held >= BATCH_BYTES or i + 1 == b.num_rows:
                    part = b.slice(a, i + 1 - a)
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [pa.array(v, arrow[k]) for k, v in cols.items()], names=names + list(made))
                    a, held, cols = i + 1, 0, {k: [] for k in made}

    return df.mapInArrow(run, schema)


def store_texts(df: DataFrame, text_col: str = "text", rate: int = SAMPLE_RATE, packet_bytes: int = PACKET_BYTES) -> DataFrame:
    """df with n_bytes (of the UTF-8 text) and media, an Ogg file of the padded text."""

    def row(b):
        for x in b.column(b.schema.get_field_index(text_col)):
            data = (x.as_py() or "").encode()
            yield len(data), mux(pad64(data), rate, packet_bytes)

    return _sent(df, {"n_bytes": T.LongType(), "media": T.BinaryType()}, row)


def read_ogg(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with payload (all streams' samples in order of time), n_pages, bad_pages, n_streams, n_packets, seconds and crossings (changes of sign about the middle value)."""
    import numpy as np

    def row(b):
        for x in b.column(b.schema.get_field_index(media_col)):
            d = demux(x.as_py())
            data = b"".join(p[4] for p in d["packets"])
            high = np.frombuffer(data, np.uint8) >= 128
            yield data, d["pages"], d["bad"], d["streams"], len(d["packets"]), float(d["seconds"]), int(np.count_nonzero(high[1:] != high[:-1]))

    made = {"payload": T.BinaryType(), "n_pages": T.LongType(), "bad_pages": T.LongType(), "n_streams": T.LongType(), "n_packets": T.LongType(), "seconds": T.DoubleType(), "crossings": T.LongType()}
    return _sent(df, made, row)


def ogg_packets(df: DataFrame, key: str, media_col: str = "media") -> DataFrame:
    """A row for each packet: key, serial, packet (0, 1, ... in order of time), start_s, end_s, data."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("serial", T.LongType()), T.StructField("packet", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("data", T.BinaryType())])

    def run(batches):
        for b in batches:
            for k, m in zip(b.column(0), b.column(1), strict=True):
                rows = [(k.as_py(), serial, i, start / rate, (start + len(d)) / rate, d) for i, (start, _, serial, rate, d) in enumerate(demux(m.as_py())["packets"])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [b.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()], strict=True)], names=schema.names)

    return df.select(key, media_col).mapInArrow(run, schema)


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = read_ogg(store_texts(docs).drop("text"))
    return d.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.format_string("seconds=%.6f", "seconds"), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("n_streams", "n_pages", "bad_pages", "n_packets", "crossings")]).alias("feature"),
        "n_pages",
        "bad_pages",
        "n_packets",
        "seconds",
    )
