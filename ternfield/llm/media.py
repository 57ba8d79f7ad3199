"""Media columns: ISO media files are walked box by box; payloads are never decoded.

A file is a tree of boxes (size, four letters, body). The sample tables of a track say how its samples are
sized (stsz), timed (stts), grouped into chunks (stsc), where the chunks lie (stco, co64) and which samples
can be decoded alone (stss). Fragments (moof) add samples by their runs (trun), with defaults from tfhd and trex.
From these come codec, duration and the byte ranges of keyframes.
``wrap`` makes such a file from bytes, as an 8-bit PCM track, so that a round trip can be checked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ternfield.llm.common import small_batches

#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
UNIT, RATE, PER_CHUNK, KEY_EVERY = 64, 8000, 16, 32
MAX_DEPTH = 16


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def _full(kind: bytes, *body: bytes) -> bytes:
    return _box(kind, bytes(4), *body)


def _u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def wrap(payload: bytes) -> bytes:
    """payload, a multiple of 64 bytes, as samples of 64 8-bit values in an ISO media file."""
    n, odd = divmod(len(payload), UNIT)
    if odd or not n:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    ticks = len(payload)
    matrix = _u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = _box(b"ftyp", b"isom", _u32(0), b"isom", b"mp41")
    chunks, last = divmod(n, PER_CHUNK)
    runs = ([(1, PER_CHUNK)] if chunks else []) + ([(chunks + 1, last)] if last else [])
    keys = range(1, n + 1, KEY_EVERY)

    def moov(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", _u32(1), entry),
            _full(b"stts", _u32(1, n, UNIT)),
            _full(b"stss", _u32(len(keys), *keys)),
            _full(b"stsc", _u32(len(runs)), *(_u32(c, k, 1) for c, k in runs)),
            _full(b"stsz", _u32(UNIT, n)),
            _full(b"stco", _u32(chunks + bool(last)), *(_u32(first + c * PER_CHUNK * UNIT) for c in range(chunks + bool(last)))),
        )
        dinf = _box(b"dinf", _full(b"dref", _u32(1), _box(b"url ", _u32(1))))
        mdia = _box(
            b"mdia",
            _full(b"mdhd", _u32(0, 0, RATE, ticks), struct.pack(">HH", 0x55C4, 0)),
            _full(b"hdlr", _u32(0), b"soun", bytes(12), b"sound\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl),
        )
        tkhd = _box(b"tkhd", _u32(7, 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, _u32(0, 0))
        mvhd = _full(b"mvhd", _u32(0, 0, RATE, ticks, 0x10000), struct.pack(">H", 0x100), bytes(10), matrix, bytes(24), _u32(2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    first = len(head) + len(moov(0)) + 8
    return head + moov(first) + _box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, box start, body start, body end) of every box, parents before children. A box that overruns its parent is an error."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield (*path, kind), start, body, stop
        if kind in CONTAINERS:
            if len(path) >= MAX_DEPTH:
                raise ValueError("boxes are nested too deep")
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def _ints(data: bytes, at: int, n: int, end: int, kind: str = ">u4") -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise ValueError("a table overruns its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


@dataclass
class Track:
    handler: str
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # 0-based samples that can be decoded alone

    def ranges(self) -> list[tuple[int, int]]:
        return [(int(self.offsets[k]), int(self.offsets[k] + self.sizes[k])) for k in self.keys]


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file by their sample tables and fragments. Raises ValueError for a broken file."""
    found: list[dict[bytes, tuple[int, int]]] = []
    fragments: list[tuple[int, list[tuple[bytes, int, int]]]] = []
    defaults, moof = {}, 0
    try:
        for path, start, at, end in walk(data):
            kind = path[-1]
            if kind == b"moof":
                moof = start
            elif kind == b"traf":
                fragments.append((moof, []))
            elif b"traf" in path:
                fragments[-1][1].append((kind, at, end))
            elif kind == b"trex":
                track, _, *values = struct.unpack_from(">5I", data, at + 4)
                defaults[track] = values
            elif kind == b"trak":
                found.append({})
            elif b"trak" in path and kind not in CONTAINERS:
                found[-1][kind] = (at, end)
        out = {}
        for boxes in found:
            out[_track_id(data, boxes, len(out))] = _track(data, boxes)
        runs: dict[int, list[Run]] = {}
        room = len(data) - sum(len(t.sizes) for t in out.values())  # no more samples than bytes in all
        for moof, boxes in fragments:
            room = _add_fragment(data, moof, boxes, out, defaults, runs, room)
        for track, of in runs.items():
            _join(out[track], of)
        return list(out.values())
    except (struct.error, KeyError, IndexError, OverflowError) as e:
        raise ValueError(f"broken sample tables: {e!r}") from e


def _track_id(data: bytes, boxes: dict[bytes, tuple[int, int]], count: int) -> int:
    """The id in the track's header; a track without one, or with another's, gets a number that no header can hold."""
    at, end = boxes.get(b"tkhd", (0, 0))
    return struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0] if end else -1 - count


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    u32 = lambda at: struct.unpack_from(">I", data, at)[0]
    at, end = boxes[b"stsz"]
    same, n = u32(at + 4), u32(at + 8)
    wide = b"co64" in boxes
    first, stop = boxes[b"co64" if wide else b"stco"]
    chunks = _ints(data, first + 8, u32(first + 4), stop, ">u8" if wide else ">u4")
    first, stop = boxes[b"stsc"]
    runs = _ints(data, first + 8, 3 * u32(first + 4), stop).reshape(-1, 3)
    in_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if in_chunk.sum() != n:
        raise ValueError(f"chunks hold {in_chunk.sum()} samples, sizes are for {n}")
    if same * n > len(data):
        raise ValueError("the samples are larger than the file")
    sizes = np.full(n, same, np.int64) if same else _ints(data, at + 12, n, end)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(in_chunk) - in_chunk
    offsets = np.repeat(chunks - before[np.minimum(first, max(n - 1, 0))], in_chunk) + before if n else before
    _inside(data, offsets, sizes)
    at, end = boxes[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    if not scale or not duration:
        t, stop = boxes[b"stts"]
        duration = int(_ints(data, t + 8, 2 * u32(t + 4), stop).reshape(-1, 2).prod(1).sum())
    at, end = boxes.get(b"stss", (0, 0))
    keys = _ints(data, at + 8, u32(at + 4), end) - 1 if end else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a keyframe is no sample")
    name = lambda at: data[at : at + 4].decode("latin-1").strip()
    return Track(name(boxes[b"hdlr"][0] + 8), name(boxes[b"stsd"][0] + 12), scale, duration, offsets, sizes, keys)


def _inside(data: bytes, offsets: np.ndarray, sizes: np.ndarray) -> None:
    if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("a sample lies outside the file")


#: Offsets, sizes and marks of keyframes of one run of samples.
Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def _join(track: Track, runs: list[Run]) -> None:
    """Adds the runs of all fragments to a track."""
    keys = np.concatenate([r[2] for r in runs])
    track.keys = np.concatenate([track.keys, len(track.sizes) + np.flatnonzero(keys)])
    track.offsets = np.concatenate([track.offsets, *(r[0] for r in runs)])
    track.sizes = np.concatenate([track.sizes, *(r[1] for r in runs)])


def _add_fragment(data: bytes, moof: int, boxes: list[tuple[bytes, int, int]], out: dict[int, Track], defaults: dict[int, list[int]], runs: dict[int, list[Run]], room: int) -> int:
    """Puts the samples of a track fragment into ``runs``; how many more samples the file may have. Fixed values of the format: which flag says that which field is there."""
    at = next(a for kind, a, _ in boxes if kind == b"tfhd") if any(kind == b"tfhd" for kind, _, _ in boxes) else None
    if at is None:
        raise ValueError("a fragment has no header")
    flags, track = struct.unpack_from(">II", data, at)
    at, flags = at + 8, flags & 0xFFFFFF
    duration, size, sample_flags = defaults.get(track, [0, 0, 0])
    base = moof
    if flags & 0x1:
        (base,), at = struct.unpack_from(">Q", data, at), at + 8
    at += 4 * bool(flags & 0x2)
    if flags & 0x8:
        (duration,), at = struct.unpack_from(">I", data, at), at + 4
    if flags & 0x10:
        (size,), at = struct.unpack_from(">I", data, at), at + 4
    if flags & 0x20:
        (sample_flags,) = struct.unpack_from(">I", data, at)
    to, place = out[track], base
    for kind, at, end in boxes:
        if kind != b"trun":
            continue
        flags, n = struct.unpack_from(">II", data, at)
        at, flags, first = at + 8, flags & 0xFFFFFF, None
        if flags & 0x1:
            place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
        if flags & 0x4:
            (first,), at = struct.unpack_from(">I", data, at), at + 4
        there = [bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800)]
        room -= n
        if not any(there) and size * n > len(data) or room < 0:
            raise ValueError("the samples are larger than the file")
        cells = _ints(data, at, n * sum(there), end).reshape(n, sum(there)) if any(there) else np.zeros((n, 0), np.int64)
        field = lambda i, default: cells[:, sum(there[:i])] if there[i] else np.full(n, default, np.int64)  # noqa: B023, E731
        sizes, marks = field(1, size), field(2, sample_flags).copy()
        if first is not None and n:
            marks[0] = first
        offsets = place + np.cumsum(sizes) - sizes
        _inside(data, offsets, sizes)
        runs.setdefault(track, []).append((offsets, sizes, marks & 0x10000 == 0))
        to.duration += int(field(0, duration).sum())
        place += int(sizes.sum())
    return room


def samples(data: bytes, track: Track) -> bytes:
    """The stored bytes of all samples, in order."""
    return b"".join(data[o : o + s] for o, s in zip(track.offsets.tolist(), track.sizes.tolist(), strict=True))


TRACK = pa.struct([("handler", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
TRACK_SQL = "array<struct<handler:string,codec:string,seconds:double,n_samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>>>"


def _cells(data: bytes | None) -> tuple[list | None, str | None]:
    if data is None:
        return None, None
    try:
        return [{"handler": t.handler, "codec": t.codec, "seconds": t.duration / t.timescale if t.timescale else None, "n_samples": len(t.sizes), "keyframes": [{"start": a, "end": b} for a, b in t.ranges()]} for t in tracks(data)], None
    except ValueError as e:
        return None, str(e)


def media_columns(df: DataFrame, *, media_col: str = "media", tracks_col: str = "tracks", error_col: str = "media_error") -> DataFrame:
    """df with ``tracks`` (codec, seconds, samples, keyframe byte ranges of each) and ``media_error``.

    A null file gives nulls in both; a broken or empty-of-boxes file gives null or no tracks, and what is
    wrong. Existing columns of these two names are replaced; all others and all rows stay as they were.
    """
    small_batches(df.sparkSession)
    df = df.drop(tracks_col, error_col)

    def each(batches):
        for b in batches:
            got = [_cells(x) for x in b.column(media_col).to_pylist()]
            new = [pa.array([g[0] for g in got], pa.list_(TRACK)), pa.array([g[1] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, tracks_col, error_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{tracks_col}` {TRACK_SQL}", f"`{error_col}` string"])
    return df.mapInArrow(each, schema)


def store_text(df: DataFrame, *, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with each text as an ISO media file: UTF-8, zeros up to a positive multiple of 64, 8-bit samples. Null is empty."""
    small_batches(df.sparkSession)
    df = df.drop(media_col) if media_col != text_col else df

    def each(batches):
        for b in batches:
            raw = [(x or "").encode() for x in b.column(text_col).to_pylist()]
            new = pa.array([wrap(x + bytes(-len(x) % UNIT if x else UNIT)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, media_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{media_col}` binary"])
    return df.mapInArrow(each, schema)


def stored_bytes(df: DataFrame, *, media_col: str = "media", payload_col: str = "payload") -> DataFrame:
    """df with the bytes of the first track's samples, read from where its tables say they lie; null for no such file."""
    small_batches(df.sparkSession)
    df = df.drop(payload_col)

    def first(data: bytes | None) -> bytes | None:
        try:
            found = tracks(data) if data is not None else []
        except ValueError:
            return None
        return samples(data, found[0]) if found else None

    def each(batches):
        for b in batches:
            new = pa.array([first(x) for x in b.column(media_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, payload_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{payload_col}` binary"])
    return df.mapInArrow(each, schema)
