"""Media columns: payloads in ISO media containers, described from their boxes and sample tables alone."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a frame, samples a second and frames from one keyframe to the next.
FRAME, RATE, KEY_EVERY = 576, 8000, 16
#: Boxes that hold boxes.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
#: Frames a chunk.
_CHUNK = 64


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pack_media(payload: bytes) -> bytes:
    """A container whose one track holds payload as unsigned 8-bit samples, in frames of FRAME bytes."""
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    chunks, rest = divmod(frames, _CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = ([(1, _CHUNK)] if chunks else []) + ([(chunks + 1, rest)] if rest else [])
    keys = range(1, frames + 1, KEY_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(base: int) -> bytes:
        offsets = [base + k * _CHUNK * FRAME for k in range(chunks + bool(rest))]
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64", struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets)),
        )
        length = frames * FRAME
        return _box(
            b"moov",
            _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, length, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2)),
            _box(
                b"trak",
                _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), matrix, bytes(8), flags=7),
                _box(
                    b"mdia",
                    _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length, 0x55C4, 0)),
                    _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
                    _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
                ),
            ),
        )

    head = ftyp + moov(len(ftyp) + len(moov(0)) + 16)
    return head + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def boxes(data, start: int, end: int):
    """(kind, body start, body end) of the boxes in a range, nested ones after their parent, however deep; bodies are not read."""
    open_ranges = [(start, end)]
    while open_ranges:
        at, end = open_ranges.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"a box at byte {at} does not end inside its parent")
        yield kind, at + head, at + size
        open_ranges.append((at + size, end))
        if kind in _NESTED:
            open_ranges.append((at + head, at + size))


def _track(data: bytes, found: dict[bytes, tuple[int, int]]) -> dict:
    """Codec, time scale, duration, sample count, chunk ranges and keyframe byte ranges of a track, from where its boxes are."""

    def table(kind: bytes, of: str, skip: int = 4, each: int = 1):
        a, _ = found[kind]
        n = struct.unpack_from(">I", data, a + skip)[0]
        return struct.unpack_from(f">{n * each}{of}", data, a + skip + 4)

    a, _ = found[b"mdhd"]
    scale, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = found[b"stsd"]
    codec = data[a + 12 : a + 16].decode("ascii", "replace").strip()
    if b"stsz" in found:
        same, count = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
        if same * count > len(data):
            raise ValueError(f"{count} samples of {same} bytes do not fit in {len(data)} bytes")
        sizes = [same] * count if same else list(struct.unpack_from(f">{count}I", data, found[b"stsz"][0] + 12))
    else:  # sizes of 4, 8 or 16 bits
        a, _ = found[b"stz2"]
        bits, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits == 4:
            sizes = [x for v in data[a + 12 : a + 12 + (count + 1) // 2] for x in (v >> 4, v & 15)][:count]
        else:
            sizes = list(struct.unpack_from(f">{count}{'B' if bits == 8 else 'H'}", data, a + 12))
    if len(sizes) != count:
        raise ValueError(f"the size table has {len(sizes)} of {count} samples")
    offsets = table(b"co64", "Q") if b"co64" in found else table(b"stco", "I")
    chunks = table(b"stsc", "I", each=3)
    keys = set(table(b"stss", "I")) if b"stss" in found else set(range(1, count + 1))
    runs = [*zip(chunks[::3], chunks[1::3], strict=True), (len(offsets) + 1, 0)]
    chunk_ranges, key_ranges, sample = [], [], 0
    for (first, per), (until, _) in zip(runs, runs[1:], strict=False):
        for chunk in range(first - 1, until - 1):
            at = offsets[chunk]
            for size in sizes[sample : sample + per]:
                sample += 1
                if sample in keys:
                    key_ranges.append((at, size))
                at += size
            chunk_ranges.append((offsets[chunk], at - offsets[chunk]))
    if sample != count:
        raise ValueError(f"the chunks hold {sample} samples, the size table {count}")
    return {"codec": codec, "timescale": scale, "duration": length / scale if scale else 0.0, "samples": count, "chunks": chunk_ranges, "keyframes": key_ranges}


def describe(data: bytes) -> list[dict]:
    """The tracks of a container, in their order (see _track). Edit lists are not applied; movie fragments are an error."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"moof":
            raise ValueError("movie fragments are not read")
        if kind == b"trak":
            tracks.append({})
        elif tracks:
            tracks[-1].setdefault(kind, (a, b))
    if not tracks:
        raise ValueError("no track")
    return [_track(data, t) for t in tracks]


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, filled with 255 to a positive multiple of FRAME, in a container.

    A null text is empty. Repeated rows come back as often as they came; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            ids, lengths, media, held = [], [], [], 0
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                ids.append(doc_id)
                lengths.append(len(raw))
                media.append(pack_media(raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))))
                held += len(media[-1])
                if held > 8_000_000:
                    yield pd.DataFrame({"doc_id": ids, "n_bytes": lengths, "media": media})
                    ids, lengths, media, held = [], [], [], 0
            yield pd.DataFrame({"doc_id": ids, "n_bytes": lengths, "media": media})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


_INDEX = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "tracks array<struct<codec: string, duration: double, samples: long, keyframes: array<struct<start: long, length: long>>>>, error string"
)


def _indexed(data: bytes | None) -> tuple:
    """Digests, feature, tracks and error of a stored value."""
    if not isinstance(data, bytes):
        return None, None, None, None, None, None, None, "no media"
    of_file = len(data), hashlib.sha256(data).hexdigest()
    try:
        tracks = describe(data)
        ranges = [r for t in tracks for r in t["chunks"]]
        if any(a < 0 or a + size > len(data) for a, size in ranges):
            raise ValueError("a chunk lies outside the file")
        if sum(size for _, size in ranges) > len(data):
            raise ValueError("chunks overlap")
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return None, None, None, *of_file, None, None, f"{type(e).__name__}: {e}"
    payload = b"".join(data[a : a + size] for a, size in ranges)
    features, rows = [], []
    for d in tracks:
        first, last = (d["keyframes"][0], d["keyframes"][-1]) if d["keyframes"] else ((0, 0), (0, 0))
        features.append(f"{d['codec']} {d['timescale']} Hz {d['duration']:.6f} s, {d['samples']} frames, {len(d['keyframes'])} keyframes from {first[0]}+{first[1]} to {last[0]}+{last[1]}")
        rows.append({"codec": d["codec"], "duration": d["duration"], "samples": d["samples"], "keyframes": [{"start": a, "length": s} for a, s in d["keyframes"]]})
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *of_file, "; ".join(features), rows, None


def media_index(media: DataFrame) -> DataFrame:
    """What the stored bytes of a media column (doc_id, n_bytes, media) hold: codec, duration, keyframe ranges of each track, digests.

    Codec, duration and ranges come from boxes and sample tables, whatever the payload is. The payload, the chunks of all
    tracks in order, is then read for its digests only. tail_crc32 covers its last 32 bytes. A null or damaged value gives a row
    whose error says why, with nulls for what could not be read.
    """

    def run(batches):
        for b in batches:
            out = [(doc_id, n, *_indexed(data)) for doc_id, n, data in b.itertuples(index=False)]
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tracks", "error"])
            yield frame.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, _INDEX)
