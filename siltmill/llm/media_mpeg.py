"""MPEG audio columns.

``probe`` reads any MPEG-1/2/2.5 audio file from a binary column: it parses ID3v2, ID3v1 and APE tags and the
variable-bitrate tables (Xing, Info, VBRI) and compares them with the frames that are there, resynchronises on frame
headers past whatever is damaged, verifies the CRC-16 of Layers I and III, and gives the exact duration (samples over
sample rate) and the frames' byte offsets. What it can't do it counts: protected Layer II frames, whose CRC covers a
part that depends on their allocation tables, are ``crc_unchecked``, and headers of free format, whose frames have no
stated length, are ``free_format``.

``carrier`` stores bytes losslessly as such a file: Layer III frames whose main data are the bytes, their number
in each frame given by the side information, CRC-protected, variable in bitrate, behind an ID3v2 tag and a Xing
frame with a seek table. ``payload`` reads them back from a probed file.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, map_batches, texts_of

UNIT = 192

# kbit/s by bitrate index, for (MPEG-1?, layer); Hz by version and rate index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


@lru_cache(4096)
def header(word: int) -> tuple[int, int, int, int, int, int, bool] | None:
    """(version bits, layer, kbit/s, Hz, length in bytes, samples, protected) of a valid frame header."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, index, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    first = version == 3
    kbps, hz, pad = BITRATES[first, layer][index], RATES[version][rate], word >> 9 & 1
    if layer == 1:
        return version, layer, kbps, hz, (12_000 * kbps // hz + pad) * 4, 384, not word >> 16 & 1
    samples = 1152 if layer == 2 or first else 576
    return version, layer, kbps, hz, samples // 8 * 1000 * kbps // hz + pad, samples, not word >> 16 & 1


def side_size(word: int) -> int:
    """Bytes of Layer III side information."""
    mono = word >> 6 & 3 == 3
    return (17 if mono else 32) if word >> 19 & 3 == 3 else (9 if mono else 17)


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(65_536)
def crc16(data: bytes) -> int:
    """CRC-16 of what a frame protects: its header's last two bytes and, in Layer III, the side information."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def protected(data: bytes, at: int, word: int, layer: int) -> bytes | None:
    """The bytes after a frame's header and CRC that its CRC covers too; None if that isn't known here."""
    if layer == 3:
        n = side_size(word)
    elif layer == 1:  # the allocation: four bits for each subband and channel, shared above the bound in joint stereo
        mode = word >> 6 & 3
        n = {0: 32, 2: 32, 3: 16}.get(mode) or (32 + 4 * (1 + (word >> 4 & 3))) // 2
    else:
        return None
    return data[at + 6 : at + 6 + n]


def is_free_format(word: int) -> bool:
    """A valid header but for its bitrate, which is not stated."""
    return word >> 12 & 15 == 0 and word >> 21 == 0x7FF and header(word | 1 << 12) is not None


def synchsafe(data: bytes) -> int:
    n = 0
    for b in data:
        n = n << 7 | b & 127
    return n


def _tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Where the audio begins and ends, and the tags' texts."""
    lo, hi, tags = 0, len(data), {}
    while data[lo : lo + 3] == b"ID3" and len(data) >= lo + 10:
        size, major = synchsafe(data[lo + 6 : lo + 10]), data[lo + 3]
        end, at = min(len(data), lo + 10 + size), lo + 10
        if major >= 3 and data[lo + 5] & 0x40 and end >= at + 4:
            # An extended header; its size counts itself only since version 4.
            at += synchsafe(data[at : at + 4]) if major >= 4 else struct.unpack(">I", data[at : at + 4])[0] + 4
        while major >= 3 and at + 10 <= end and data[at : at + 1].isalnum():
            name, raw = data[at : at + 4].decode("latin1"), data[at + 4 : at + 8]
            n = synchsafe(raw) if major >= 4 else struct.unpack(">I", raw)[0]
            body = data[at + 10 : min(end, at + 10 + n)]
            if name[0] == "T" and body:
                coding = ("latin1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3]
                tags[name] = body[1:].decode(coding, "replace").rstrip("\0").replace("\0", "=")
            at += 10 + n
        lo = end + 10 * bool(data[lo + 5] & 0x10)
    if hi - lo >= 128 and data[hi - 128 : hi - 125] == b"TAG":
        hi -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if text := data[hi + a : hi + b].rstrip(b"\0 ").decode("latin1"):
                tags.setdefault(name, text)
    if hi - lo >= 32 and data[hi - 32 : hi - 24] == b"APETAGEX":
        size, items, flags = struct.unpack("<III", data[hi - 20 : hi - 8])
        first = max(lo, hi - size)
        at = first
        for _ in range(items):
            if at + 8 > hi - 32:
                break
            n = struct.unpack("<I", data[at : at + 4])[0]
            end = data.find(b"\0", at + 8, hi)
            if end < 0:
                break
            tags.setdefault("APE:" + data[at + 8 : end].decode("latin1"), data[end + 1 : end + 1 + n].decode("utf-8", "replace"))
            at = end + 1 + n
        hi = max(lo, first - 32 * bool(flags >> 31))
    return lo, hi, tags


def _vbr_table(data: bytes, at: int, word: int, length: int) -> dict | None:
    """The Xing, Info or VBRI table of a frame."""
    frame = data[at : at + length]
    x = 4 + 2 * (not word >> 16 & 1) + side_size(word)
    # Writers differ in whether the table stands after a CRC's place.
    for x in (x, 4 + side_size(word)):
        if frame[x : x + 4] in (b"Xing", b"Info") and len(frame) >= x + 8:
            kind, flags, p = frame[x : x + 4].decode(), struct.unpack(">I", frame[x + 4 : x + 8])[0], x + 8
            out = {"kind": kind, "frames": None, "bytes": None, "toc": []}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(frame) >= p + 4:
                    out[key] = struct.unpack(">I", frame[p : p + 4])[0]
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        table = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)] if width in (1, 2, 3, 4) else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": table}
    return None


def _table_right(table: dict, offsets: list[int], first: int, end: int) -> bool:
    """Whether a table has as many frames as were found, and a Xing table's seek points lie near their frames."""
    if table["frames"] is not None and table["frames"] != len(offsets):
        return False
    if table["kind"] == "VBRI" or not table["toc"] or not offsets:
        return True
    size = table["bytes"] or end - first
    longest = max([b - a for a, b in zip(offsets, offsets[1:], strict=False)] + [end - offsets[-1]])
    # A point is a 256th of the size, rounded down; writers count its frame from either neighbour.
    return all(abs(offsets[min(len(offsets) - 1, len(offsets) * i // len(table["toc"]))] - first - t * size / 256) <= size / 256 + longest for i, t in enumerate(table["toc"]))


def probe(data: bytes | None) -> dict | None:
    """Everything about one file; None for null. Bytes without any frame have frames = 0 and duration 0/1.

    A frame counts if its header is valid and another one of the same version, layer and rate, or the end of
    the audio, follows where it ends; everything else is skipped a byte at a time and counted.
    """
    if data is None:
        return None
    lo, hi, tags = _tags(data)
    at, offsets, words, crcs, bad, skipped, table, samples = lo, [], [], 0, 0, 0, None, 0
    unchecked = free = table_at = 0
    bits, unpack = set(), struct.Struct(">I").unpack_from
    locked: tuple | None = None
    hz = first = None
    while at + 4 <= hi:
        word = unpack(data, at)[0]
        got = header(word)
        fits = False
        if got:
            end = at + got[4]
            if end == hi or (end + 4 > hi and end <= hi):
                fits = locked is None or locked == (got[0], got[1], got[3])
            elif end + 4 <= hi:
                then = header(unpack(data, end)[0])
                same = then and (then[0], then[1], then[3]) == (got[0], got[1], got[3])
                fits = bool(same) or (locked == (got[0], got[1], got[3]) and then is None)
        if not fits:
            free += got is None and is_free_format(word)
            nxt = data.find(b"\xff", at + 1, hi)
            nxt = hi if nxt < 0 else nxt
            skipped += nxt - at
            at = nxt
            continue
        if locked is None:
            locked, hz, first = (got[0], got[1], got[3]), got[3], word
            if got[1] == 3 and (table := _vbr_table(data, at, word, got[4])):
                table_at = at
                at += got[4]
                continue
        if got[6]:
            crcs += 1
            covered = protected(data, at, word, got[1])
            if covered is None:
                unchecked += 1
            elif crc16(data[at + 2 : at + 4] + covered) != data[at + 4] << 8 | data[at + 5]:
                bad += 1
        offsets.append(at)
        words.append(word)
        bits.add(got[2])
        samples += got[5]
        at += got[4]
    return {
        "version": VERSIONS[locked[0]] if locked else None, "layer": locked[1] if locked else None, "sample_rate": hz or 0,
        "channels": None if first is None else 1 if first >> 6 & 3 == 3 else 2,
        "frames": len(offsets), "samples": samples, "skipped": skipped, "crc_frames": crcs, "crc_bad": bad,
        "variable": len(bits) > 1, "table": table["kind"] if table else None, "table_frames": table["frames"] if table else None,
        "crc_unchecked": unchecked, "free_format": free, "table_right": None if table is None else _table_right(table, offsets, table_at, hi),
        "toc": table["toc"] if table else [], "audio_start": lo, "audio_end": hi, "tags": tags, "offsets": offsets, "words": words,
    }


#: The carrier: MPEG-1 Layer III, 48 kHz, mono, protected. Main data bytes by bitrate index.
_BASE = 0xFFFA04C0 & ~0xF000
_ROOM = {i: 144 * BITRATES[True, 3][i] // 48 - 23 for i in range(1, 15)}
#: part2_3_length has 12 bits.
_GRANULE = 511


@lru_cache(4096)
def _front(index: int, n: int) -> bytes:
    """Header, CRC and side information of a frame that carries n bytes: both granules' part2_3_length."""
    word = _BASE | index << 12
    bits = (min(n, _GRANULE) * 8, max(0, n - _GRANULE) * 8)
    # main_data_begin (9), private (5), scfsi (4), then 59 bits for each granule, the length first.
    side = (bits[0] << 59 | bits[1]) << 47
    raw = side.to_bytes(17, "big")
    head = struct.pack(">I", word)
    return head + struct.pack(">H", crc16(head[2:] + raw)) + raw


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\0" + text.encode("latin1")
    return name + struct.pack(">I", len(body)) + b"\0\0" + body


def carrier(payload: bytes) -> bytes:
    """A file whose frames hold the payload: the largest bitrate until the rest fits a smaller frame."""
    room, n = _ROOM[14], len(payload)
    front, blank = _front(14, room) if room <= 2 * _GRANULE else b"", b""
    frames = [front + payload[i : i + room] for i in range(0, n - room + 1, room)]
    rest = n % room
    if rest:
        index = next(i for i in range(1, 15) if _ROOM[i] >= rest)
        blank = bytes(_ROOM[index] - rest)
        frames.append(_front(index, rest) + payload[n - rest :] + blank)
    ends = np.cumsum([len(f) for f in frames])
    total = int(ends[-1]) if frames else 0
    xing_index = next(i for i in range(1, 15) if _ROOM[i] >= 120)
    size = 144 * BITRATES[True, 3][xing_index] // 48
    starts = np.concatenate([[0], ends[:-1]]) + size if frames else np.zeros(1)
    toc = [int(256 * starts[len(starts) * i // 100] / (total + size)) for i in range(100)]
    xing = _front(xing_index, 0) + b"Xing" + struct.pack(">III", 7, len(frames), total + size) + bytes(toc)
    tag = _text_frame(b"TSSE", "carrier") + _text_frame(b"TXXX", f"payload\0{n}")
    s = len(tag)
    head = b"ID3\3\0\0" + bytes([s >> 21 & 127, s >> 14 & 127, s >> 7 & 127, s & 127])
    return b"".join([head, tag, xing.ljust(size, b"\0"), *frames])


def payload(data: bytes, seen: dict) -> bytes:
    """What the frames of a probed carrier hold, by the lengths in their side information."""
    out = []
    for at, word in zip(seen["offsets"], seen["words"], strict=True):
        x = at + 6 if not word >> 16 & 1 else at + 4
        side = int.from_bytes(data[x : x + 17], "big")
        n = ((side >> 106 & 0xFFF) + (side >> 47 & 0xFFF)) // 8
        out.append(data[x + 17 : x + 17 + n])
    return b"".join(out)


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes with spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a carrier file. One row for each row."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            rows = [padded(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "n_bytes": [n for n, _ in rows], "media": [carrier(p) for _, p in rows]}

        return each

    return map_batches(texts_of(docs, id_col, text_col), make, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The kept columns, what ``probe`` finds in the media column, seek offsets, and the payload's digests.

    Null media give nulls throughout. duration is exact: samples / sample_rate.
    """
    fields = [f for f in media.schema.fields if f.name in keep]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    out = f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, samples long, sample_rate int, crc_bad int, skipped int, seek array<long>"

    def make():
        def one(data: bytes | None) -> dict:
            seen = probe(data)
            if seen is None:
                return {}
            held = payload(data, seen) if seen["layer"] == 3 and seen["version"] == "1" and seen["channels"] == 1 else b""
            seek = seen["offsets"]
            said = (
                f"mpeg={seen['version']};layer={seen['layer']};hz={seen['sample_rate']};channels={seen['channels']};frames={seen['frames']};"
                f"samples={seen['samples']};duration={seen['samples']}/{max(1, seen['sample_rate'])};vbr={seen['table']};variable={str(seen['variable']).lower()};"
                f"crc={seen['crc_frames'] - seen['crc_unchecked']}-{seen['crc_bad']};table={str(seen['table_right']).lower()};skipped={seen['skipped']};seek={crc32(np.array(seek, '<u8').tobytes()):08x}"
            )
            return {
                "payload_bytes": len(held), "payload_sha256": hashlib.sha256(held).hexdigest(), "tail_crc32": crc32(held[-16:]),
                "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": said,
                "frames": seen["frames"], "samples": seen["samples"], "sample_rate": seen["sample_rate"], "crc_bad": seen["crc_bad"], "skipped": seen["skipped"], "seek": seek,
            }

        names = [part.split()[0] for part in out.split(", ")][len(fields) :]

        def each(batch: pa.RecordBatch) -> dict:
            rows = [one(d) for d in batch.column(len(fields)).to_pylist()]
            return {f.name: batch.column(i) for i, f in enumerate(fields)} | {n: [r.get(n) for r in rows] for n in names}

        return each

    return map_batches(media.select(*[f.name for f in fields], F.col(column).alias("media")), make, out)
