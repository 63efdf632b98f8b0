"""Operator 10, media columns in ISO media containers.

``mux`` stores a payload losslessly as 8-bit PCM samples of an ISO base media file, ``walk`` reads
nested boxes and decodes the sample tables of any such file, and ``features`` gives each track's
codec, duration and keyframe byte ranges. Payloads are never decoded: the ranges point at them. Movie fragments
(moof, traf, trun) are read like sample tables; their samples follow those of the tables.

Results for odd input: a null or empty text becomes one frame of 192 spaces; equal texts give equal
bytes and features; a damaged or cut container gives an error string beside what could be read; boxes
whose size runs past their parent end there. Extra columns are ignored, repeated rows repeat; a very long
text is one container.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lontar.llm import names, scratch, tokens

FRAME = 192
RATE = 8000
KEY_EVERY = 16
FRAMES_IN_CHUNK = 64
# Boxes of ISO/IEC 14496-12 that hold other boxes, and the bytes before their children.
PARENTS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4, b"dref": 8, b"stsd": 8}
# Fixed values of the same standard: flags of fragment headers and runs, and of a sample that is no keyframe.
TF_BASE, TF_DESCRIPTION, TF_DURATION, TF_SIZE, TF_FLAGS, TF_FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
TR_OFFSET, TR_FIRST, TR_DURATION, TR_SIZE, TR_FLAGS, TR_COMPOSITION = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEY = 0x10000


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of the frame."""
    return data + b" " * (-len(data) % FRAME or (0 if data else FRAME))


def mux(payload: bytes) -> bytes:
    """An ISO file with one track of unsigned 8-bit mono PCM; a sample of the tables is one frame of 192 bytes."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_IN_CHUNK)
    rest = frames - (chunks - 1) * FRAMES_IN_CHUNK
    runs = [(1, FRAMES_IN_CHUNK, 1), (chunks, rest, 1)] if chunks > 1 and rest != FRAMES_IN_CHUNK else [(1, rest if chunks == 1 else FRAMES_IN_CHUNK, 1)]
    keys = range(1, frames + 1, KEY_EVERY)
    kind = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp42")
    wide = len(payload) >= (1 << 32) - (1 << 20)

    def moov(at: int) -> bytes:
        offsets = [at + k * FRAMES_IN_CHUNK * FRAME for k in range(chunks)]
        entry = box(b"raw ", b"\0" * 6, struct.pack(">H2I2H2HI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">3I", 1, frames, FRAME)),
            full(b"stss", struct.pack(f">{len(keys) + 1}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full(b"stsz", struct.pack(">2I", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        mdia = box(
            b"mdia",
            full(b"mdhd", struct.pack(">4I2H", 0, 0, RATE, frames * FRAME, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s3I", 0, b"soun", 0, 0, 0), b"\0"),
            box(b"minf", full(b"smhd", struct.pack(">2H", 0, 0)), dinf, stbl),
        )
        tkhd = full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, frames * FRAME), b"\0" * 8, struct.pack(">4H", 0, 0, 0x100, 0), _MATRIX, b"\0" * 8, flags=7)
        mvhd = full(b"mvhd", struct.pack(">4I", 0, 0, RATE, frames * FRAME), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    at = len(kind) + len(moov(0)) + (16 if wide else 8)
    return b"".join((kind, moov(at), box(b"mdat", payload)))


@dataclass
class Track:
    """One track's tables: sizes and offsets of its samples, without their bytes."""

    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    times: list = field(default_factory=list)
    sync: list | None = None
    chunk_runs: list = field(default_factory=list)
    fixed_size: int = 0
    n_samples: int = 0
    sizes: list = field(default_factory=list)
    chunk_offsets: list = field(default_factory=list)
    composition: list = field(default_factory=list)
    fragments: list = field(default_factory=list)  # (offset, size, duration, keyframe) of the samples of movie fragments

    def samples(self) -> Iterator[tuple[int, int]]:
        """(offset, size) of every sample, in decoding order: those of the tables, then those of the fragments."""
        yield from self._table_samples()
        for at, n, _, _ in self.fragments:
            yield at, n

    def _table_samples(self) -> Iterator[tuple[int, int]]:
        done = 0
        for i, (first, count, _) in enumerate(self.chunk_runs):
            last = self.chunk_runs[i + 1][0] - 1 if i + 1 < len(self.chunk_runs) else len(self.chunk_offsets)
            for chunk in range(first - 1, min(last, len(self.chunk_offsets))):
                at = self.chunk_offsets[chunk]
                for _ in range(count):
                    if done == self.n_samples:
                        return
                    n = self.fixed_size or (self.sizes[done] if done < len(self.sizes) else 0)
                    yield at, n
                    at, done = at + n, done + 1

    def count(self) -> int:
        return self.n_samples + len(self.fragments)

    def media_duration(self) -> int:
        told = sum(n * delta for n, delta in self.times)
        return told + sum(x[2] for x in self.fragments) or self.duration

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte ranges of the sync samples; without a table of them each sample of the tables is one."""
        keys = None if self.sync is None else set(self.sync)
        return [x for i, x in enumerate(self._table_samples(), 1) if keys is None or i in keys] + [(at, n) for at, n, _, key in self.fragments if key]


@dataclass
class _Fragment:
    """What a track fragment's header says, and where its next run begins."""

    track: Track | None
    base: int
    duration: int
    size: int
    flags: int


def _fragment(view: memoryview, inner: int, stop: int, moof: int, tracks: list[Track], defaults: dict[int, tuple]) -> _Fragment:
    """Read a tfhd box: fields that it leaves out come from the track's defaults."""
    flags, track_id = struct.unpack_from(">I", view, inner)[0] & 0xFFFFFF, struct.unpack_from(">I", view, inner + 4)[0]
    at, (duration, size, sample_flags) = inner + 8, defaults.get(track_id, (0, 0, 0))
    base = moof
    if flags & TF_BASE:
        base, at = struct.unpack_from(">Q", view, at)[0], at + 8
    at += 4 * bool(flags & TF_DESCRIPTION)
    told = []
    for flag, default in ((TF_DURATION, duration), (TF_SIZE, size), (TF_FLAGS, sample_flags)):
        if flags & flag:
            if at + 4 > stop:
                raise struct.error("cut")
            told.append(struct.unpack_from(">I", view, at)[0])
            at += 4
        else:
            told.append(default)
    return _Fragment(next((t for t in tracks if t.track_id == track_id), None), base, *told)


def _run(view: memoryview, inner: int, stop: int, f: _Fragment, moof: int, next_at: int | None) -> int:
    """Add a trun box's samples to its track; gives the byte after the last one."""
    flags, count = struct.unpack_from(">I", view, inner)[0] & 0xFFFFFF, struct.unpack_from(">I", view, inner + 4)[0]
    at, first = inner + 8, None
    offset = f.base if next_at is None else next_at
    if flags & TR_OFFSET:
        offset, at = f.base + struct.unpack_from(">i", view, at)[0], at + 4
    if flags & TR_FIRST:
        first, at = struct.unpack_from(">I", view, at)[0], at + 4
    columns = [x for x in (TR_DURATION, TR_SIZE, TR_FLAGS, TR_COMPOSITION) if flags & x]
    rows = _array(view, at, stop, "I" * len(columns), count) if columns else [()] * min(count, len(view))  # a damaged count must not outgrow the file
    for i, row in enumerate(rows):
        told = dict(zip(columns, row, strict=True))
        size, sample_flags = told.get(TR_SIZE, f.size), told.get(TR_FLAGS, first if i == 0 and first is not None else f.flags)
        if f.track is not None:
            f.track.fragments.append((offset, size, told.get(TR_DURATION, f.duration), not sample_flags & NO_KEY))
        offset += size
    if len(rows) < count:
        raise struct.error("cut")
    return offset


def _packed_sizes(view: memoryview, at: int, stop: int, bits: int, n: int) -> list[int]:
    """Sample sizes of 4, 8 or 16 bits."""
    if bits == 4:
        raw = bytes(view[at : min(stop, at + -(-n // 2))])
        return [x for b in raw for x in (b >> 4, b & 15)][:n]
    return [x for (x,) in _array(view, at, stop, "B" if bits == 8 else "H", n)]


def _array(data: memoryview, at: int, end: int, form: str, n: int) -> list[tuple]:
    width = struct.calcsize(">" + form)
    n = min(n, max(0, (end - at) // width))
    return list(struct.iter_unpack(">" + form, data[at : at + n * width]))


def walk(data: bytes) -> tuple[list[Track], list[tuple[str, int, int]], str | None]:
    """Tracks, (path, offset, size) of every box, and the first error if there is one."""
    view, tracks, boxes, error = memoryview(data), [], [], None
    stack = [(0, len(data), "")]
    defaults: dict[int, tuple] = {}
    moof, fragment, after = 0, None, None
    while stack:
        at, end, path = stack.pop()
        if end - at < 8:
            error = error or (f"{end - at} stray bytes in {path or 'file'}" if end > at else None)
            continue
        size, kind = struct.unpack_from(">I4s", view, at)
        head = 8
        if size == 1:
            if end - at < 16:
                error = error or f"cut box in {path or 'file'}"
                continue
            size, head = struct.unpack_from(">Q", view, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            error = error or f"box {kind.decode('latin-1')} of {size} bytes at {at} runs past {end}"
            if size < head:
                continue
            size = end - at
        stop, inner, name = at + size, at + head, f"{path}/{kind.decode('latin-1')}"
        boxes.append((name, at, size))
        stack.append((stop, end, path))
        if kind == b"trak":
            tracks.append(Track())
        elif kind == b"moof":
            moof = at
        elif kind == b"traf":
            fragment = after = None
        if kind in PARENTS:
            if kind == b"stsd" and tracks and stop - inner >= 16 and not tracks[-1].codec:
                tracks[-1].codec = bytes(view[inner + 12 : inner + 16]).decode("latin-1")
            if kind not in (b"stsd", b"dref"):
                stack.append((min(stop, inner + PARENTS[kind]), stop, name))
        elif kind in (b"trex", b"tfhd", b"trun") and stop - inner >= 8:
            try:
                if kind == b"trex":
                    track_id, _, *told = struct.unpack_from(">5I", view, inner + 4)
                    defaults[track_id] = tuple(told)
                elif kind == b"tfhd":
                    fragment = _fragment(view, inner, stop, moof, tracks, defaults)
                elif fragment is not None:
                    after = _run(view, inner, stop, fragment, moof, after)
            except struct.error:
                error = error or f"cut table {name} at {at}"
        elif tracks and stop - inner >= 8:
            t, wide = tracks[-1], view[inner] == 1
            count = struct.unpack_from(">I", view, inner + 4)[0]
            try:
                if kind == b"tkhd":
                    t.track_id = struct.unpack_from(">I", view, inner + (20 if wide else 12))[0]
                elif kind == b"mdhd":
                    t.timescale, t.duration = struct.unpack_from(">IQ" if wide else ">II", view, inner + (20 if wide else 12))
                elif kind == b"hdlr":
                    t.handler = bytes(view[inner + 8 : inner + 12]).decode("latin-1")
                elif kind == b"stts":
                    t.times = _array(view, inner + 8, stop, "II", count)
                elif kind == b"stss":
                    t.sync = [x for (x,) in _array(view, inner + 8, stop, "I", count)]
                elif kind == b"stsc":
                    t.chunk_runs = _array(view, inner + 8, stop, "III", count)
                elif kind == b"stsz":
                    t.fixed_size, n = struct.unpack_from(">II", view, inner + 4)
                    t.n_samples = min(n, len(data))  # a damaged count must not outgrow the file
                    t.sizes = [] if t.fixed_size else [x for (x,) in _array(view, inner + 12, stop, "I", t.n_samples)]
                elif kind == b"stz2":
                    bits, n = view[inner + 7], struct.unpack_from(">I", view, inner + 8)[0]
                    t.n_samples = min(n, len(data))
                    t.sizes = _packed_sizes(view, inner + 12, stop, bits, t.n_samples)
                elif kind == b"ctts":
                    t.composition = _array(view, inner + 8, stop, "Ii" if wide else "II", count)
                elif kind in (b"stco", b"co64"):
                    t.chunk_offsets = [x for (x,) in _array(view, inner + 8, stop, "Q" if kind == b"co64" else "I", count)]
            except struct.error:
                error = error or f"cut table {name} at {at}"
    return tracks, boxes, error


def read_payload(data: bytes) -> bytes:
    """The bytes of the first track's samples, in order."""
    tracks, _, error = walk(data)
    if error or not tracks:
        raise ValueError(error or "no track")
    return b"".join(data[at : at + n] for at, n in tracks[0].samples())


def feature(tracks: list[Track], error: str | None) -> str:
    """codec, seconds and keyframe ranges (offset+size), track by track."""
    shown = [f"{t.handler}/{t.codec.strip()};duration={t.media_duration()}/{t.timescale};samples={t.count()};keys=" + ",".join(f"{a}+{n}" for a, n in t.key_ranges()) for t in tracks]
    return "|".join(shown) + (f"|error={error}" if error else "")


TRACK_SCHEMA = "codec string, handler string, timescale long, duration long, n_samples long, keys array<struct<offset:long,size:long>>"


def describe(df: DataFrame, media: str = "media", out: str = "tracks") -> DataFrame:
    """df plus an array of its container's tracks (null media: null), which replaces a column of that name; payload bytes aren't touched."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    staged = names.plain(df, media=F.col(names.quoted(media)).cast("binary"))
    kind = T.StructType.fromDDL(f"tracks array<struct<{TRACK_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    schema = T.StructType([*staged.schema.fields[:-1], kind.fields[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind.fields[0].dataType)
        for batch in batches:
            found = []
            for x in batch.column("media"):
                tracks = walk(x.as_py())[0] if x.is_valid else None
                found.append(None if tracks is None else [{"codec": t.codec.strip(), "handler": t.handler, "timescale": t.timescale, "duration": t.media_duration(), "n_samples": t.count(), "keys": [{"offset": a, "size": n} for a, n in t.key_ranges()]} for t in tracks])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, arrow)], names=schema.names)

    made = staged.mapInArrow(run, schema)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() != out.lower()]
    return made.select(*kept, F.col("tracks").alias(out))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every text, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch):
                raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return scratch.table(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media, all computed from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media"):
                data = media.as_py()
                tracks, _, error = walk(data)
                payload = b"".join(data[at : at + n] for t in tracks[:1] for at, n in t.samples())
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(tracks, error)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])

    return stored.mapInArrow(run, FEATURE_SCHEMA)
