"""Ogg as a media column: a writer and a reader of pages, and features of what is read.

A payload of bytes is stored losslessly as 8-bit mono samples in one logical stream (uncompressed samples behind a header
packet), multiplexed with a second logical stream that carries a comment packet and an index packet. The reader takes
nothing on trust: it walks the capture patterns, verifies each page's checksum, page sequence, begin and end flags,
reassembles packets from lacing values (a value of 255 continues, over pages too), separates the logical streams by
serial number, and derives each packet's time from the granule positions at the sample rate. A stream may begin at any
granule position, as one that was cut out of a longer one does.

Nulls: a null payload is stored as the padded empty payload; a null media value reads as a row with error set and
nothing else. A damaged file yields its error, never an exception. Ids may be null, repeated or of any size; empty and very
long payloads are files like others, held in memory one at a time. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stored, table

RATE, PACKET, PAGE_PACKETS, UNIT = 8000, 4096, 8, 64
DATA_SERIAL, META_SERIAL = 1, 2
HEADER = struct.Struct("<4sBBqIIIB")
FEATURES = "n_samples begin end gap_samples pages packets streams mean variance zero_crossings entropy"
#: Bytes of media that a batch of results holds.
HELD = 8 << 20

#: A byte's bits in reverse order. Ogg's checksum is the usual CRC-32 polynomial with bits in the other order, without
#: inversions, so it is zlib's checksum of bit-reversed bytes, reversed.
FLIP = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def page_crc(page: bytes) -> int:
    x = zlib.crc32(page.translate(FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(struct.pack("<I", x).translate(FLIP), "big")


def _page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_crc(head + body)) + head[26:] + body


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


class _Stream:
    """Pages of one logical stream; packets are split over pages of at most 255 lacing values."""

    def __init__(self, serial: int) -> None:
        self.serial, self.sequence, self.pages = serial, 0, []

    def put(self, packets: list[tuple[bytes, int]], last: bool = False) -> None:
        """Packets with the granule position at each one's end."""
        lacing = b"".join(_lacing(len(p)) for p, _ in packets)
        body = b"".join(p for p, _ in packets)
        ends, n = [], 0
        for p, g in packets:
            n += len(p) // 255 + 1
            ends.append((n, g))
        done, at = 0, 0
        while done < len(lacing):
            part = lacing[done : done + 255]
            size = sum(part)
            closed = [g for e, g in ends if done < e <= done + len(part)]
            flags = (1 if done and lacing[done - 1] == 255 else 0) | (2 if self.sequence == 0 else 0) | (4 if last and done + len(part) == len(lacing) else 0)
            self.pages.append(_page(self.serial, self.sequence, closed[-1] if closed else -1, flags, part, body[at : at + size]))
            self.sequence, done, at = self.sequence + 1, done + 255, at + size


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """Zeros up to a positive multiple of the unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def write(payload: bytes, rate: int = RATE) -> bytes:
    data, meta = _Stream(DATA_SERIAL), _Stream(META_SERIAL)
    data.put([(b"PCM8" + struct.pack("<IIQ", rate, 1, len(payload)), 0)])
    meta.put([(b"META" + struct.pack("<I", rate), 0)])
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.cumsum([len(p) for p in packets]).tolist()
    for i in range(0, len(packets), PAGE_PACKETS):
        data.put(list(zip(packets[i : i + PAGE_PACKETS], ends[i : i + PAGE_PACKETS], strict=True)), last=i + PAGE_PACKETS >= len(packets))
    index = b"".join(struct.pack("<Q", e) for e in ends[PAGE_PACKETS - 1 :: PAGE_PACKETS])
    meta.put([(b"samples=8-bit;channels=1", 0), (index, ends[-1] if ends else 0)], last=True)
    # Both streams' first pages lead; then pages alternate until one stream is out.
    out, a, b = [data.pages[0], meta.pages[0]], data.pages[1:], meta.pages[1:]
    for k in range(max(len(a), len(b))):
        out += a[k : k + 1] + b[k : k + 1]
    return b"".join(out)


def read_packets(media: bytes) -> tuple[dict[int, list[tuple[bytes, float | None, float | None]]], int, list[str]]:
    """Packets of each logical stream with the granule positions at which each begins and ends, the number of good pages,
    and what is wrong with the file.

    A page's granule position is where the last packet that ends in it ends; the packets that end in it share the span from
    the granule position before (of the stream's first page with packets: from its own, less the bytes that end in it) in
    proportion to their bytes. Behind a damaged page the reader looks for the next capture pattern; packets that
    reach into what is lost are dropped, and their stream goes on with the granule position of the next page."""
    found: dict[int, list[tuple[bytes, float | None, float | None]]] = {}
    part: dict[int, list[bytes]] = {}
    sequence: dict[int, int] = {}
    granules: dict[int, int] = {}
    ended: set[int] = set()
    wrong: list[str] = []
    pages = at = 0
    while at < len(media):
        why, size = None, 0
        if len(media) - at < HEADER.size:
            why = "cut page header"
        else:
            magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
            lacing = media[at + 27 : at + 27 + n]
            size = 27 + n + sum(lacing)
            page = media[at : at + size]
            if magic != b"OggS" or version:
                why = "no capture pattern"
            elif len(lacing) < n or len(page) < size:
                why = "cut page"
            elif page_crc(page[:22] + bytes(4) + page[26:]) != crc:
                why = "page checksum"
        if why:
            wrong.append(f"{why} at {at}")
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        pieces, broken = part.setdefault(serial, []), False
        if (flags & 2 > 0) != (serial not in sequence) or number != sequence.get(serial, -1) + 1 or serial in ended:
            wrong.append(f"page sequence at {at}")
            broken = True
            pieces.clear()
        elif (flags & 1 > 0) != bool(pieces):
            wrong.append(f"continued packet at {at}")
            broken = True
            pieces.clear()
        sequence[serial] = number
        packets: list[bytes] = []
        skip = broken and flags & 1 > 0  # the rest of a packet whose beginning is lost
        from_ = to = at + 27 + n
        for x in lacing:
            to += x
            if x < 255:
                pieces.append(media[from_:to])
                if not skip:
                    packets.append(b"".join(pieces))
                pieces.clear()
                from_, skip = to, False
        if from_ < to and not skip:
            pieces.append(media[from_:to])
        sizes = np.cumsum([0, *map(len, packets)])
        if packets and granule >= 0:
            before = granules.get(serial)
            before = granule - int(sizes[-1]) if before is None or broken else before
            if before > granule:
                wrong.append(f"granule position at {at}")
            span = (granule - before) / max(1, int(sizes[-1]))
            ends = [before + span * float(z) for z in sizes]
            found.setdefault(serial, []).extend(zip(packets, ends[:-1], ends[1:], strict=True))
            if granule > 0:  # a header page has position zero, wherever its samples begin
                granules[serial] = granule
        else:
            found.setdefault(serial, []).extend((p, None, None) for p in packets)
        if flags & 4:
            ended.add(serial)
        pages += 1
        at += size
    if any(part.values()) or ended != set(sequence):
        wrong.append("stream without end")
    return found, pages, wrong


def read(media: bytes | None) -> dict:
    """The payload, its packets' start times (seconds, from the granule positions) and features; error says why there are
    none. A damaged file has an error and in payload what its whole packets hold."""
    recovered, why = None, "no media"
    if media is not None:
        streams, pages, wrong = read_packets(media)
        why = "; ".join(wrong[:3])
        data = streams.get(DATA_SERIAL, [])
        head = data[0][0] if data else b""
        if head[:4] == b"PCM8" and len(head) == 20:
            rate, _, n = struct.unpack("<IIQ", head[4:])
            recovered = payload = b"".join(p for p, *_ in data[1:])
            why = why or ("" if len(payload) == n else "payload length") or ("" if all(b is not None for _, b, _ in data) else "granule positions")
        else:
            why = why or "no sample stream"
    if why:
        return {"error": why, "payload": recovered}
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / max(1, len(x))
    values = np.arange(256.0)
    mean = float(count @ values) / max(1, len(x))
    high = x >= 128
    first, last = (data[1][1], data[-1][2]) if len(data) > 1 else (0, 0)
    # Samples that granule positions count between the first and the last packet, but no packet holds.
    gap = round(last - first) - len(x)
    return {
        "error": None, "payload": payload, "times": [b / rate for _, b, _ in data[1:]], "n_samples": len(x), "begin": first / rate, "end": last / rate, "gap_samples": gap, "pages": pages,
        "packets": sum(map(len, streams.values())), "streams": len(streams), "mean": mean, "variance": float(count @ (values - mean) ** 2) / max(1, len(x)),
        "zero_crossings": int(np.count_nonzero(high[1:] != high[:-1])), "entropy": float(-(p * np.log2(p)).sum()),
    }


def store_media(df: DataFrame, payload: str, media: str) -> DataFrame:
    """Adds a media column that holds the padded payload column (binary) as an Ogg file."""

    def work(data):
        # A few files at a time: a batch of long texts is not held twice as media.
        rows, out, size = [], [], 0
        for i, x in enumerate(data):
            m = write(padded(x.as_py() or b""))
            rows.append(i)
            out.append(m)
            size += len(m)
            if size > HELD:
                yield rows, [out]
                rows, out, size = [], [], 0
        if rows:
            yield rows, [out]

    return arrow_map(df, df.columns, [payload], work, f"`{media}` binary")


def read_media(df: DataFrame, media: str) -> DataFrame:
    """Replaces the media column by what a reader of the stored bytes finds; a column of these whose name another has
    gets underscores behind it."""

    def row(m: bytes | None) -> tuple:
        r = read(m)
        stored_ = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
        if r["error"]:
            return (None, None, None, *stored_, None, r["error"])
        feature = ";".join(f"{k}={r[k]:.6f}" if isinstance(r[k], float) else f"{k}={r[k]}" for k in FEATURES.split())
        return (len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest(), zlib.crc32(r["payload"][-UNIT:]), *stored_, feature, None)

    def work(files):
        got = [row(m.as_py()) for m in files]
        yield None, list(map(list, zip(*got, strict=True))) if got else [[]] * 7

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return arrow_map(df, [c for c in df.columns if c != media], [media], work, fields)


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts stored as Ogg files, in a table of the shared folder, and read back from there."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(data).cast("long").alias("n_bytes"), data.alias("payload"))
    media, _ = stored(store_media(docs, "payload", "media").drop("payload"), "media", "zstd")
    return read_media(media, "media")
