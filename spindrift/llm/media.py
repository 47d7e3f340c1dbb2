"""ISO media containers: walk nested boxes, decode sample tables, keep codec, duration and keyframe byte ranges.

The reader looks at box headers and sample tables only; coded payloads are never decoded. A small writer stores a byte
string losslessly as 8-bit PCM frames in one track, and `read_samples` gets it back through the sample tables.

Defined results: null content gives a null `media`; content that is no well-formed container gives `error` and no
tracks, and so does one whose tables name more bytes than it has or whose containers nest deeper than DEEPEST; a track
without `stss` has every sample as a keyframe; equal bytes give equal results.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes

FRAME = 576
"""Bytes of a stored sample (one access unit of 8-bit mono PCM)."""
SAMPLE_RATE = 8000
FRAMES_PER_CHUNK = 8
KEYFRAME_EVERY = 16
PAD = 255

MEDIA_TYPE = (
    "struct<error:string,brand:string,duration_s:double,tracks:array<struct<track_id:long,handler:string,codec:string,"
    "timescale:long,duration:long,n_samples:long,n_keyframes:long,keyframes:array<struct<offset:long,size:long>>>>>"
)

DEEPEST = 64
"""Containers within containers; a file that nests deeper is malformed."""
BATCH = 4 << 20
"""Bytes of content that a task reads or writes at once, or one row."""

_NUMBER = pa.int64()
_RANGES = pa.list_(pa.struct([("offset", _NUMBER), ("size", _NUMBER)]))
_TRACK = [("track_id", _NUMBER), ("handler", pa.string()), ("codec", pa.string()), ("timescale", _NUMBER), ("duration", _NUMBER), ("n_samples", _NUMBER), ("n_keyframes", _NUMBER), ("keyframes", _RANGES)]
_ARROW = pa.struct([("error", pa.string()), ("brand", pa.string()), ("duration_s", pa.float64()), ("tracks", pa.list_(pa.struct(_TRACK)))])

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"dinf"}


class Malformed(ValueError):
    """A box contradicts its own or its parent's length."""


# ---------------------------------------------------------------- writer


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_samples(payload: bytes, frame: int = FRAME) -> bytes:
    """A one-track container whose samples are the payload's frames; its length must be a positive multiple of frame."""
    n, rest = divmod(len(payload), frame)
    if rest or not n:
        raise ValueError(f"payload length {len(payload)} is no positive multiple of {frame}")
    full, last = divmod(n, FRAMES_PER_CHUNK)
    chunks = full + bool(last)
    runs = ([(1, FRAMES_PER_CHUNK)] if full else []) + ([(chunks, last)] if last else [])
    entry = _box(b"raw ", bytes(6), struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, SAMPLE_RATE << 16))
    length = n * frame

    def moov(start: int) -> bytes:
        offsets = start + np.arange(chunks, dtype=np.int64) * (FRAMES_PER_CHUNK * frame)
        wide = bool(offsets[-1] > 0xFFFFFFFF)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, n, frame)),
            _full(b"stss", struct.pack(">I", len(keys := range(1, n + 1, KEYFRAME_EVERY))), np.asarray(keys, ">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", first, count, 1) for first, count in runs)),
            _full(b"stsz", struct.pack(">2I", frame, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        url = _full(b"url ", flags=1)
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), url)), stbl)
        mdhd = _full(b"mdhd", struct.pack(">2QIQ2H", 0, 0, SAMPLE_RATE, length, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0")
        tkhd = _full(b"tkhd", struct.pack(">2Q2IQ8x4H", 0, 0, 1, 0, length, 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">2QIQIH10x", 0, 0, SAMPLE_RATE, length, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    head = 8 if len(payload) + 8 <= 0xFFFFFFFF else 16
    table = moov(len(ftyp) + len(moov(0)) + head)
    mdat = struct.pack(">I4s", len(payload) + 8, b"mdat") if head == 8 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    return b"".join((ftyp, table, mdat, payload))


# ---------------------------------------------------------------- reader


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of each box in data[start:end]."""
    while start < end:
        if end - start < 8:
            raise Malformed(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Malformed(f"short 64-bit size at {start}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size > end or body > start + size:
            raise Malformed(f"box {kind!r} at {start} of {size} bytes leaves its parent")
        yield kind, body, start + size
        start += size


def _table(data: bytes, body: int, end: int, columns: int, item: str = ">u4") -> np.ndarray:
    """Rows of a full box that has an entry count and fixed-size entries."""
    if end - body < 8:
        raise Malformed(f"short table at {body}")
    (n,) = struct.unpack_from(">I", data, body + 4)
    if n * columns * np.dtype(item).itemsize > end - body - 8:
        raise Malformed(f"table at {body} says {n} entries")
    return np.frombuffer(data, item, n * columns, body + 8).astype(np.int64).reshape(n, columns)


def _times(data: bytes, body: int) -> tuple[int, int]:
    """(timescale, duration) of an mvhd or mdhd."""
    return struct.unpack_from(">IQ", data, body + 20) if data[body] else struct.unpack_from(">2I", data, body + 12)


def _sizes(data: bytes, kind: bytes, body: int, end: int) -> np.ndarray:
    fixed, n = struct.unpack_from(">2I", data, body + 4)
    if kind == b"stsz":
        if fixed:
            if n * fixed > len(data):
                raise Malformed(f"stsz says {n} samples of {fixed} bytes")
            return np.full(n, fixed, np.int64)
        if n * 4 > end - body - 12:
            raise Malformed("stsz is cut")
        return np.frombuffer(data, ">u4", n, body + 12).astype(np.int64)
    width = fixed & 255
    if width not in (4, 8, 16) or (n * width + 7) // 8 > end - body - 12:
        raise Malformed("stz2 is cut")
    raw = np.frombuffer(data, np.uint8, (n * width + 7) // 8, body + 12)
    if width == 4:
        return np.column_stack((raw >> 4, raw & 15)).reshape(-1)[:n].astype(np.int64)
    return (raw if width == 8 else raw.view(">u2")).astype(np.int64)


def sample_ranges(data: bytes, stbl: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and size of each sample, from the chunk, size and offset tables."""
    kind = b"stsz" if b"stsz" in stbl else b"stz2"
    wide = b"co64" in stbl
    if kind not in stbl or b"stsc" not in stbl or not (wide or b"stco" in stbl):
        raise Malformed("a sample table is missing")
    sizes = _sizes(data, kind, *stbl[kind])
    chunks = _table(data, *stbl[b"co64" if wide else b"stco"], 1, ">u8" if wide else ">u4")[:, 0]
    runs = _table(data, *stbl[b"stsc"], 3)
    if not len(sizes):
        return sizes, sizes
    if not len(runs) or not len(chunks) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
        raise Malformed("stsc doesn't cover the chunks")
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if each.sum() != len(sizes):
        raise Malformed(f"chunks hold {each.sum()} samples of {len(sizes)}")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(each) - each
    used = each > 0
    offsets = np.repeat(chunks[used] - before[first[used]], each[used]) + before
    if offsets.min() < 0 or (offsets + sizes).max() > len(data):
        raise Malformed("a sample lies outside the file")
    return offsets, sizes


def _tracks(data: bytes) -> Iterator[tuple[dict, dict[bytes, tuple[int, int]]]]:
    """Header facts and the stbl boxes of each track; the first yield holds the movie's own facts."""
    movie: dict = {"brand": None, "timescale": 0, "duration": 0}
    found: list[tuple[dict, dict]] = []

    def walk(start: int, end: int, track: dict | None, stbl: dict | None, depth: int = 0) -> None:
        if depth > DEEPEST:
            raise Malformed(f"boxes nest deeper than {DEEPEST} at {start}")
        for kind, body, stop in boxes(data, start, end):
            if kind == b"ftyp":
                movie["brand"] = data[body : body + 4].decode("latin-1")
            elif kind == b"mvhd":
                movie["timescale"], movie["duration"] = _times(data, body)
            elif kind == b"trak":
                found.append(({"track_id": 0, "handler": None, "codec": None, "timescale": 0, "duration": 0}, {}))
                walk(body, stop, *found[-1], depth + 1)
            elif kind in CONTAINERS:
                walk(body, stop, track, stbl, depth + 1)
            elif track is None or stbl is None:
                continue
            elif kind == b"tkhd":
                (track["track_id"],) = struct.unpack_from(">I", data, body + (20 if data[body] else 12))
            elif kind == b"mdhd":
                track["timescale"], track["duration"] = _times(data, body)
            elif kind == b"hdlr":
                track["handler"] = data[body + 8 : body + 12].decode("latin-1")
            elif kind == b"stsd":
                track["codec"] = next((k.decode("latin-1") for k, _, _ in boxes(data, body + 8, stop)), None)
            elif kind in (b"stsz", b"stz2", b"stsc", b"stco", b"co64", b"stss", b"stts"):
                stbl[kind] = (body, stop)

    walk(0, len(data), None, None)
    yield movie, {}
    yield from found


def describe(data: bytes) -> dict:
    """Codec, duration and keyframe byte ranges of every track; see the module's text for malformed content."""
    try:
        (movie, _), *tracks = _tracks(data)
        if movie["brand"] is None and not tracks:
            raise Malformed("neither ftyp nor trak")
        out = []
        for track, stbl in tracks:
            offsets, sizes = sample_ranges(data, stbl)
            if b"stss" in stbl:
                keys = _table(data, *stbl[b"stss"], 1)[:, 0] - 1
                if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
                    raise Malformed("stss names a missing sample")
                offsets_k, sizes_k = offsets[keys], sizes[keys]
            else:
                offsets_k, sizes_k = offsets, sizes
            if not track["duration"] and b"stts" in stbl:
                runs = _table(data, *stbl[b"stts"], 2)
                track["duration"] = int((runs[:, 0] * runs[:, 1]).sum())
            ranges = [{"offset": o, "size": s} for o, s in zip(offsets_k.tolist(), sizes_k.tolist(), strict=True)]
            out.append(track | {"n_samples": len(sizes), "n_keyframes": len(ranges), "keyframes": ranges})
        seconds = movie["duration"] / movie["timescale"] if movie["timescale"] else None
        return {"error": None, "brand": movie["brand"], "duration_s": seconds, "tracks": out}
    except (Malformed, struct.error, IndexError) as e:
        return {"error": str(e) or "cut", "brand": None, "duration_s": None, "tracks": []}


def read_samples(data: bytes, track: int = 0) -> bytes | None:
    """The bytes of a track's samples in order, by its sample tables; null where they can't be read."""
    try:
        _, *tracks = _tracks(data)
        offsets, sizes = sample_ranges(data, tracks[track][1])
    except (Malformed, struct.error, IndexError):
        return None
    if not len(offsets):
        return b""
    ends = offsets + sizes
    cuts = np.flatnonzero(offsets[1:] != ends[:-1]) + 1  # samples that lie one after another are one read
    starts, stops = offsets[np.r_[0, cuts]], ends[np.r_[cuts - 1, len(ends) - 1]]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


# ---------------------------------------------------------------- columns


def padded(content: Column, frame: int = FRAME) -> Column:
    """Binary content with bytes of 255 appended up to a positive multiple of frame."""
    n = F.octet_length(content)
    missing = F.when(n == 0, F.lit(frame)).otherwise(F.pmod(-n, F.lit(frame)))
    return F.concat(content, F.unhex(F.repeat(F.lit(f"{PAD:02X}"), missing)))


def _mapped(df: DataFrame, content: str, new: list[tuple[str, str, pa.DataType]], apply: Callable[[bytes], tuple]) -> DataFrame:
    """df with new columns made of the bytes in column content, null where it is null; rows are taken by their bytes."""
    rest = [c for c in df.columns if c not in [n for n, _, _ in new]]
    own = "_".join(["__content", *rest])  # the name of no other column
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{content}`").alias(own))
    schema = source.drop(own).schema
    for name, kind, _ in new:
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, own, BATCH):
            found = [(None,) * len(new) if x is None else apply(x) for x in batch.column(own).to_pylist()]
            cells = [pa.array([r[i] for r in found], kind) for i, (_, _, kind) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cells], [*rest, *[n for n, _, _ in new]])

    return source.mapInArrow(run, schema)


def stored(df: DataFrame, payload: str = "payload", out: str = "content") -> DataFrame:
    """df with a container in column `out` that holds the payload as 8-bit samples. A column named `out` is replaced."""
    return _mapped(df, payload, [(out, "binary", pa.binary())], lambda x: (write_samples(x),))


def media_columns(df: DataFrame, content: str = "content", out: str = "media", samples: str | None = None) -> DataFrame:
    """df with a struct column `out` that describes the container in column `content`.

    samples names one more column, of the first track's bytes read through its sample tables; null where they can't be
    read. Row by row, without a shuffle. Columns that are already named so are replaced.
    """
    new = [(out, MEDIA_TYPE, _ARROW)] + ([(samples, "binary", pa.binary())] if samples else [])
    return _mapped(df, content, new, lambda x: (describe(x), read_samples(x)) if samples else (describe(x),))
