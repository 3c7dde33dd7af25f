"""Media columns: ISO base media files, read by their boxes and sample tables alone.

`probe` walks the nested boxes of a file and decodes the sample tables of its tracks: codec,
duration, and for each sample its size, place and whether it is a keyframe. Samples of movie
fragments follow those of the tables before them. No payload byte is decoded. `store` is the counterpart for texts: their bytes become the samples of an uncompressed
8-bit video track, with one keyframe in `GOP` samples, so that a payload can be read back exactly
through the sample table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table

#: A sample is one grey frame of 24 by 24 bytes.
WIDTH, HEIGHT = 24, 24
FRAME = WIDTH * HEIGHT
#: Frames a second, frames from one keyframe to the next, frames of a chunk.
RATE, GOP, CHUNK = 25, 12, 8

#: Boxes that hold nothing but boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}

#: Nested containers at most; the standard has no more than seven.
DEEPEST = 16
#: Flags of fragment boxes that say which fields there are, and the mark of a sample that is no keyframe.
TFHD = {"base": 0x1, "description": 0x2, "duration": 0x8, "size": 0x10, "flags": 0x20, "from_moof": 0x20000}
TRUN = {"offset": 0x1, "first_flags": 0x4, "duration": 0x100, "size": 0x200, "flags": 0x400, "composition": 0x800}
NO_KEYFRAME = 0x10000


class Malformed(ValueError):
    """The file breaks the box structure or its sample tables contradict each other."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a frame."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def store(payload: bytes) -> bytes:
    """An ISO file whose samples are the payload's frames; its length is a positive multiple of a frame."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", u32(512), b"isomiso2")

    def moov(first: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", WIDTH, HEIGHT), u32(0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1))
        runs = [(1, CHUNK)] * (chunks > 1 or n == CHUNK) + [(chunks, n - (chunks - 1) * CHUNK)] * bool(n % CHUNK)
        table = box(
            b"stbl",
            full(b"stsd", 0, u32(1), entry),
            full(b"stts", 0, u32(1, n, 1)),
            full(b"stss", 0, u32(len(range(0, n, GOP)), *range(1, n + 1, GOP))),
            full(b"stsc", 0, u32(len(runs)), *(u32(at, size, 1) for at, size in runs)),
            full(b"stsz", 0, u32(FRAME, n)),
            full(b"co64", 0, u32(chunks), struct.pack(f">{chunks}Q", *range(first, first + n * FRAME, CHUNK * FRAME))),
        )
        dinf = box(b"dinf", full(b"dref", 0, u32(1), full(b"url ", 1)))
        minf = box(b"minf", full(b"vmhd", 1, bytes(8)), dinf, table)
        mdia = box(b"mdia", full(b"mdhd", 0, u32(0, 0, RATE, n), struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", 0, u32(0), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", 3, u32(0, 0, 1, 0, n), bytes(16), matrix, u32(WIDTH << 16, HEIGHT << 16))
        mvhd = full(b"mvhd", 0, u32(0, 0, RATE, n, 0x10000), struct.pack(">H", 0x100), bytes(10), matrix, bytes(24), u32(2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + 16
    return ftyp + moov(head) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def boxes(data: memoryview, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box; 64-bit sizes and a last box without one are known."""
    while start < stop:
        if stop - start < 8:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise Malformed("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise Malformed(f"a box {kind!r} reaches beyond what holds it")
        yield kind, start + head, start + size
        start += size


def walk(data: memoryview, start: int, stop: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes with the kinds that lead to them."""
    for kind, a, b in boxes(data, start, stop):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            if len(path) > DEEPEST:
                raise Malformed("boxes are nested too deep")
            yield from walk(data, a, b, (*path, kind))


def numbers(data: memoryview, at: int, stop: int, count: int, kind: str) -> np.ndarray:
    """`count` big-endian integers."""
    dtype = np.dtype(kind)
    if count < 0 or at + count * dtype.itemsize > stop:
        raise Malformed("a table is cut off")
    return np.frombuffer(data, dtype, count, at)


def read_track(data: memoryview, found: dict[bytes, tuple[int, int]]) -> dict:
    """Codec, duration in seconds, and offset, size and keyframe mark of each sample."""

    def part(kind: bytes, least: int) -> tuple[int, int]:
        if kind not in found or found[kind][1] - found[kind][0] < least:
            raise Malformed(f"no {kind.decode('latin-1')}")
        return found[kind]

    at, _ = part(b"mdhd", 20)
    scale, length = struct.unpack_from(">IQ", data, part(b"mdhd", 32)[0] + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
    at, stop = part(b"stsd", 16)
    codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    kind = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in found else "?"
    at, stop = part(b"stsz", 12) if b"stsz" in found else part(b"stz2", 12)
    same, n = struct.unpack_from(">II", data, at + 4)
    if b"stsz" in found:
        if same and n > len(data) // same:
            raise Malformed("samples reach beyond the file")
        sizes = np.full(n, same, np.int64) if same else numbers(data, at + 12, stop, n, ">u4").astype(np.int64)
    elif same & 255 == 4:
        half = numbers(data, at + 12, stop, (n + 1) // 2, "u1")
        sizes = np.stack([half >> 4, half & 15], 1).ravel()[:n].astype(np.int64)
    else:
        sizes = numbers(data, at + 12, stop, n, {8: "u1", 16: ">u2"}.get(same & 255) or ">u2").astype(np.int64)
    at, stop = part(b"co64", 8) if b"co64" in found else part(b"stco", 8)
    chunks = numbers(data, at + 8, stop, struct.unpack_from(">I", data, at + 4)[0], ">u8" if b"co64" in found else ">u4").astype(np.int64)
    at, stop = part(b"stsc", 8)
    runs = numbers(data, at + 8, stop, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 3).astype(np.int64)
    if len(chunks) and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks)):
        raise Malformed("chunks without samples")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(chunks) else np.zeros(0, np.int64)
    if int(per_chunk.sum()) != n:
        raise Malformed("chunks and samples differ in number")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    offsets = chunks[chunk] + before - before[first[chunk]] if n else np.zeros(0, np.int64)
    if n and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
        raise Malformed("samples reach beyond the file")
    key = np.ones(n, bool)
    if b"stss" in found:
        at, stop = part(b"stss", 8)
        sync = numbers(data, at + 8, stop, struct.unpack_from(">I", data, at + 4)[0], ">u4").astype(np.int64)
        if len(sync) and (sync.min() < 1 or sync.max() > n):
            raise Malformed("a keyframe that is no sample")
        key[:] = False
        key[sync - 1] = True
    return {"kind": kind, "codec": codec, "duration": length / scale if scale else 0.0, "offsets": offsets, "sizes": sizes, "key": key}


def word(data: memoryview, at: int, stop: int, kind: str = ">I") -> int:
    """One number, which must lie within its box."""
    if at + struct.calcsize(kind) > stop:
        raise Malformed("a box is cut off")
    return struct.unpack_from(kind, data, at)[0]


def after_times(data: memoryview, at: int, stop: int) -> int:
    """The number after the two times of a header, which have eight bytes each if the version is not 0."""
    return word(data, at + (20 if word(data, at, stop, ">B") else 12), stop)


def fragment_runs(data: memoryview, start: int, a: int, b: int, defaults: dict[int, tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Track, offsets, sizes, keyframe marks and whole duration of each run of a movie fragment that begins at `start`."""
    end = start  # where the data of the run before ended
    for first, (path, at, stop) in enumerate(x for x in walk(data, a, b) if x[0] == (b"traf",)):
        parts = [(kind, x, y) for kind, x, y in boxes(data, at, stop)]
        heads = [(x, y) for kind, x, y in parts if kind == b"tfhd"]
        if len(heads) != 1:
            raise Malformed("a track fragment without its header")
        at, stop = heads[0]
        flags, track = word(data, at, stop), word(data, at + 4, stop)
        if track not in defaults:
            raise Malformed("a fragment of a track without defaults")
        at += 8
        base = start if flags & TFHD["from_moof"] or not first else end
        if flags & TFHD["base"]:
            base, at = word(data, at, stop, ">Q"), at + 8
        at += 4 * bool(flags & TFHD["description"])
        own = list(defaults[track])
        for i, name in enumerate(("duration", "size", "flags")):
            if flags & TFHD[name]:
                own[i], at = word(data, at, stop), at + 4
        end = base
        for kind, at, stop in parts:
            if kind != b"trun":
                continue
            flags, n = word(data, at, stop), word(data, at + 4, stop)
            at += 8
            if flags & TRUN["offset"]:
                end, at = base + word(data, at, stop, ">i"), at + 4
            first_flags = None
            if flags & TRUN["first_flags"]:
                first_flags, at = word(data, at, stop), at + 4
            fields = [name for name in ("duration", "size", "flags", "composition") if flags & TRUN[name]]
            if not fields and n > len(data):
                raise Malformed("samples reach beyond the file")
            rows = numbers(data, at, stop, n * len(fields), ">u4").reshape(n, len(fields)).astype(np.int64)
            duration, sizes, marks = (rows[:, fields.index(name)] if name in fields else np.full(n, own[i], np.int64) for i, name in enumerate(("duration", "size", "flags")))
            if n and first_flags is not None:
                marks = np.append(first_flags, marks[1:])
            offsets = end + np.cumsum(sizes) - sizes
            end += int(sizes.sum())
            if n and (int(offsets.min()) < 0 or end > len(data)):
                raise Malformed("samples reach beyond the file")
            yield track, offsets, sizes, marks & NO_KEYFRAME == 0, int(duration.sum())


def probe(data: bytes) -> list[dict]:
    """The tracks of a file, in order, with the samples of their tables and of all fragments."""
    view, tracks, defaults = memoryview(data), [], {}
    for path, a, b in walk(view, 0, len(view)):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and tracks:
            tracks[-1].setdefault(path[-1], (a, b))
        elif path == (b"moov", b"mvex", b"trex"):
            defaults[word(view, a + 4, b)] = tuple(word(view, a + k, b) for k in (12, 16, 20))
    read = [read_track(view, found) for found in tracks]
    start, runs = 0, []
    for kind, a, b in boxes(view, 0, len(view)):
        if kind == b"moof":
            runs += fragment_runs(view, start, a, b, defaults)
        start = b
    if runs:
        ids = [after_times(view, *found[b"tkhd"]) if b"tkhd" in found else None for found in tracks]
        scales = [after_times(view, *found[b"mdhd"]) for found in tracks]
        if {run[0] for run in runs} - set(ids):
            raise Malformed("a fragment of a track that is not there")
        for track, number, scale in zip(read, ids, scales, strict=True):
            mine = [run for run in runs if run[0] == number]
            for i, name in enumerate(("offsets", "sizes", "key"), 1):
                track[name] = np.concatenate([track[name], *[run[i] for run in mine]])
            length = sum(run[4] for run in mine) / scale if scale else 0.0
            track["duration"] = max(track["duration"], length)
    return read


def read_back(data: bytes, track: dict) -> bytes:
    """The samples of a track, one after the other, found by its sample table."""
    return b"".join(data[o : o + s] for o, s in zip(track["offsets"].tolist(), track["sizes"].tolist(), strict=True))


def feature(track: dict) -> str:
    """Codec, duration, number of samples, and the byte ranges of keyframes, as text."""
    ranges = " ".join(f"{o}+{s}" for o, s in zip(track["offsets"][track["key"]].tolist(), track["sizes"][track["key"]].tolist(), strict=True))
    return f"codec={track['codec'].strip()};seconds={track['duration']:.2f};samples={len(track['sizes'])};keyframes={ranges}"


MEDIA = "error string, tracks array<struct<kind: string, codec: string, seconds: double, samples: long, bytes: long, keyframes: array<struct<offset: long, size: long>>>>"


def media_columns(df: DataFrame, *, id_col: str, content_col: str) -> DataFrame:
    """For each row of a binary column: the tracks of its ISO file, or why it can't be read.

    A null or empty content has no tracks and no error; a malformed one has null tracks and the
    error. Repeated rows are kept; columns other than the two are not read.
    """
    names = ("kind", "codec", "seconds", "samples", "bytes", "keyframes")

    def one(data: bytes | None) -> tuple[str | None, list[dict] | None]:
        try:
            return None, [dict(zip(names, (t["kind"], t["codec"], t["duration"], len(t["sizes"]), int(t["sizes"].sum()), [{"offset": o, "size": s} for o, s in zip(t["offsets"][t["key"]].tolist(), t["sizes"][t["key"]].tolist(), strict=True)]), strict=True)) for t in probe(data or b"")]
        except (Malformed, struct.error) as e:
            return str(e), None

    track = pa.list_(pa.struct([("kind", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])))]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [one(x.as_py()) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], track)], ["id", "error", "tracks"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")), run, f"id {kind}, {MEDIA}").withColumnRenamed("id", id_col)


def text_media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each whole text (null: empty) as an ISO file, reads it back and describes both.

    Equal texts give equal values; ids may be null or repeat; no rows give no rows. `with_media`
    adds the file itself.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = store(pad(raw))
        (track,) = probe(media)
        payload = read_back(media, track)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(track), media

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(x.as_py()) for x in batch.column(1)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media]
        names = [x.split()[0] for x in schema.split(", ")] + ["media"] * with_media
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)

    columns = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(columns, run, schema + ", media binary" * with_media)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
