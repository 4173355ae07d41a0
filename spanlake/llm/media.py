"""Media columns: payloads in ISO media containers, read through their boxes and sample tables.

`pack` writes a byte string as one raw 8-bit track: 576 bytes a sample (a grey
frame of 24 x 24), 16 samples a chunk, 25 samples a second, every twelfth
sample a sync sample. `tracks` walks the nested boxes of any such file and
decodes its sample tables and movie fragments: codec, duration, where every
sample lies and when it is shown, and the byte ranges of the keyframes. The
samples themselves are never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, pieces, record_batch

SIDE = 24
SAMPLE = SIDE * SIDE
PER_CHUNK, RATE, KEY_EVERY = 16, 25, 12
#: Boxes that hold boxes, with the bytes before the first inner box (fixed values).
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of SAMPLE."""
    return data + b"\xff" * (-len(data) % SAMPLE if data else SAMPLE)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 0xFFFFFFF0 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


UNIT_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pack(payload: bytes) -> bytes:
    """The file of a payload whose length is a positive multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK)] * (chunks > 1 or last == PER_CHUNK) + ([(chunks, last)] if last < PER_CHUNK else [])
    sync = range(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def movie(offset: int) -> bytes:
        at = np.arange(chunks, dtype=np.int64) * (PER_CHUNK * SAMPLE) + offset
        wide = chunks and int(at[-1]) > 0xFFFFFFFF
        table = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, struct.pack(">I", len(sync)), np.array(sync, ">u4").tobytes()),
            full(b"stsc", 0, struct.pack(">I", len(runs)), b"".join(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", 0, struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
            full(b"hdlr", 0, struct.pack(">I4s", 0, b"vide"), bytes(12), b"bytes\0"),
            box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), table),
        )
        track = box(b"trak", full(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), UNIT_MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16)), media)
        head = full(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), UNIT_MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, track)

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    data = box(b"mdat", payload)
    return kind + movie(len(kind) + len(movie(0)) + len(data) - len(payload)) + data


@dataclass
class Track:
    """What the boxes say of a track with samples."""

    codec: str
    seconds: float
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # numbers of the keyframes, from 0
    times: np.ndarray  # seconds at which each sample is shown

    def keyframes(self) -> list[tuple[int, int, float]]:
        """(offset, length, seconds) of each."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), self.times[self.keys].tolist(), strict=True))


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of the body of every box, outer ones first; a box that overruns its parent ends the walk there."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from boxes(data, start + head + CONTAINERS[kind], start + size, here)
        start += size


class Reader:
    """A box's body, read field by field; reading past its end is a ValueError, so no count is trusted."""

    def __init__(self, data: bytes, start: int, end: int):
        self.data, self.at, self.end = data, start, end

    def take(self, form: str) -> tuple:
        n = struct.calcsize(form)
        if self.at + n > self.end:
            raise ValueError("a field overruns its box")
        self.at += n
        return struct.unpack_from(form, self.data, self.at - n)

    def one(self, form: str) -> int:
        return self.take(form)[0]

    def flags(self) -> tuple[int, int]:
        """Version and flags."""
        x = self.one(">I")
        return x >> 24, x & 0xFFFFFF

    def many(self, kind: str, count: int) -> np.ndarray:
        n = count * np.dtype(kind).itemsize
        if self.at + n > self.end:
            raise ValueError("a table overruns its box")
        self.at += n
        return np.frombuffer(self.data, kind, count, self.at - n).astype(np.int64)


def spread(counts: np.ndarray, n: int) -> np.ndarray:
    """How often to repeat each run for n items in all: runs beyond the n-th item are cut, so a wrong count makes no large array."""
    ends = np.minimum(np.cumsum(np.minimum(counts, n)), n)
    return np.diff(np.r_[0, ends])


def sample_sizes(read, length: int) -> np.ndarray:
    if box_ := read(b"stsz"):
        box_.flags()
        each, n = box_.take(">II")
        if each and n * each > length:
            raise ValueError("samples beyond the file")
        return np.full(n, each, np.int64) if each else box_.many(">u4", n)
    box_ = read(b"stz2")
    box_.flags()
    bits, n = box_.one(">I") & 0xFF, box_.one(">I")
    if bits in (8, 16):
        return box_.many(">u1" if bits == 8 else ">u2", n)
    if bits != 4:
        raise ValueError("unknown field size")
    pairs = box_.many(">u1", -(-n // 2))
    return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n]


def track_of(data: bytes, found: dict[bytes, tuple[int, int]]) -> Track:
    """The track whose boxes are found, by its sample tables; a ValueError where these are broken or point outside the file."""

    def read(kind: bytes) -> Reader | None:
        return Reader(data, *found[kind]) if kind in found else None

    head = read(b"mdhd")
    wide = head.flags()[0] == 1
    head.take(">QQ" if wide else ">II")
    rate, length = head.one(">I"), head.one(">Q" if wide else ">I")
    about = read(b"stsd")
    about.take(">II")
    codec = about.take(">I4s")[1].decode("latin-1")
    sizes = sample_sizes(read, len(data)) if found.keys() & {b"stsz", b"stz2"} else np.zeros(0, np.int64)
    n = len(sizes)
    chunk = np.zeros(0, np.int64)
    for kind, form in ((b"stco", ">u4"), (b"co64", ">u8")):
        if box_ := read(kind):
            box_.flags()
            chunk = box_.many(form, box_.one(">I"))
    owner = np.zeros(0, np.int64)
    if n:
        box_ = read(b"stsc")
        if box_ is None:
            raise ValueError("no chunk table")
        box_.flags()
        runs = box_.many(">u4", 3 * box_.one(">I")).reshape(-1, 3)
        firsts = np.r_[runs[:, 0], len(chunk) + 1]
        if (np.diff(firsts) < 0).any() or firsts[0] != 1:
            raise ValueError("chunks out of order")
        per_chunk = np.repeat(runs[:, 1], np.diff(firsts))
        owner = np.repeat(np.arange(len(per_chunk)), spread(per_chunk, n))
        if len(owner) != n:
            raise ValueError("fewer places than samples")
    before = np.cumsum(sizes) - sizes
    first = np.r_[True, owner[1:] != owner[:-1]] if n else np.zeros(0, bool)
    offsets = chunk[owner] + before - (before[first][np.cumsum(first) - 1] if n else before)
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("samples beyond the file")
    lasts = np.zeros(n, np.int64)
    if box_ := read(b"stts"):
        box_.flags()
        runs = box_.many(">u4", 2 * box_.one(">I")).reshape(-1, 2)
        each = np.repeat(runs[:, 1], spread(runs[:, 0], n))
        lasts[: len(each)] = each
        length = int(lasts.sum()) if n else length
    shown = np.cumsum(lasts) - lasts
    if box_ := read(b"ctts"):
        version = box_.flags()[0]
        count = box_.one(">I")
        runs = np.stack([box_.many(">u4", 2 * count).reshape(-1, 2)[:, 0], Reader(data, box_.at - 8 * count, box_.at).many(">i4" if version else ">u4", 2 * count).reshape(-1, 2)[:, 1]], axis=1)
        each = np.repeat(runs[:, 1], spread(runs[:, 0], n))
        shown[: len(each)] += each
    keys = np.arange(n)  # without a table every sample is one
    if box_ := read(b"stss"):
        box_.flags()
        keys = box_.many(">u4", box_.one(">I")) - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise ValueError("keyframes beyond the samples")
    scale = rate or 1
    return Track(codec, length / scale if rate else 0.0, offsets, sizes, keys, shown / scale)


def base_time(data: bytes, found: tuple[int, int]) -> int:
    """When a fragment's first sample is decoded, by its tfdt box."""
    box_ = Reader(data, *found)
    return box_.one(">Q" if box_.flags()[0] == 1 else ">I")


def edit_shift(data: bytes, found: dict[bytes, tuple[int, int]], movie_rate: int) -> float:
    """Seconds that a track's times move by its edit list: later by the empty edits at its start, earlier by where its first other edit begins. Later edits are not followed."""
    if b"elst" not in found:
        return 0.0
    head, box_ = Reader(data, *found[b"mdhd"]), Reader(data, *found[b"elst"])
    head.take(">QQ" if head.flags()[0] == 1 else ">II")
    rate, wide, delay = head.one(">I") or 1, box_.flags()[0] == 1, 0
    for _ in range(box_.one(">I")):
        lasts, begins = box_.take(">Qq" if wide else ">Ii")
        box_.take(">I")
        if begins >= 0:
            return delay / (movie_rate or 1) - begins / rate
        delay += lasts
    return 0.0


def fragment_samples(data: bytes, start: int, moof: int, defaults: dict[int, tuple], clock: dict[int, int], runs: list[tuple[int, int]], timed: tuple[int, int] | None = None) -> tuple[int, list[tuple]]:
    """(track, [(offset, size, duration, shown, sync)]) of one track fragment: tfhd at `start`, its trun boxes in `runs`, its tfdt box `timed`; without that it follows the one before."""
    head = Reader(data, start, len(data))
    flags = head.flags()[1]
    track = head.one(">I")
    base = head.one(">Q") if flags & 1 else moof
    head.take(">I") if flags & 2 else None
    _, duration, size, bits = defaults.get(track, (1, 0, 0, 0))
    duration = head.one(">I") if flags & 8 else duration
    size = head.one(">I") if flags & 16 else size
    bits = head.one(">I") if flags & 32 else bits
    out, at, now = [], base, clock.get(track, 0) if timed is None else base_time(data, timed)
    for a, b in runs:
        run = Reader(data, a, b)
        version, flags = run.flags()
        n = run.one(">I")
        at = base + run.one(">i") if flags & 1 else at
        first_bits = run.one(">I") if flags & 4 else None
        width = sum(bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800))
        if n > (len(data) if not width else (b - run.at) // (4 * width)) or (not flags & 0x200 and n * size > len(data)):
            raise ValueError("a run overruns the file")
        for k in range(n):
            lasts = run.one(">I") if flags & 0x100 else duration
            length = run.one(">I") if flags & 0x200 else size
            own = run.one(">I") if flags & 0x400 else first_bits if k == 0 and first_bits is not None else bits
            delay = run.one(">i" if version else ">I") if flags & 0x800 else 0
            out.append((at, length, lasts, now + delay, not own & 0x10000))
            at, now = at + length, now + lasts
    clock[track] = now
    if any(a < 0 or a + n > len(data) for a, n, *_ in out):
        raise ValueError("samples beyond the file")
    return track, out


def tracks(data: bytes) -> list[Track | None]:
    """All tracks in order, with the samples of movie fragments after those of their tables; null for one that is broken."""
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple] = {}
    fragments: list[list] = []  # of each: where its tfhd is, where its moof begins, its runs, its tfdt
    moof = movie_rate = 0
    try:
        for path, start, end in boxes(data):
            if path == (b"moov", b"trak"):
                found.append({})
            elif path[:2] == (b"moov", b"trak") and found:
                found[-1].setdefault(path[-1], (start, end))
            elif path == (b"moov", b"mvex", b"trex"):
                box_ = Reader(data, start, end)
                box_.flags()
                number, *rest = box_.take(">IIIII")
                defaults[number] = tuple(rest)
            elif path == (b"moof",):
                moof = start - (8 if data[start - 4 : start] == b"moof" else 16)
            elif path == (b"moof", b"traf", b"tfhd"):
                fragments.append([start, moof, [], None])
            elif path == (b"moof", b"traf", b"tfdt") and fragments:
                fragments[-1][3] = start, end
            elif path == (b"moov", b"mvhd"):
                box_ = Reader(data, start, end)
                box_.take(">QQ" if box_.flags()[0] == 1 else ">II")
                movie_rate = box_.one(">I")
            elif path == (b"moof", b"traf", b"trun") and fragments:
                fragments[-1][2].append((start, end))
    except ValueError:
        defaults = {}
    out: list[Track | None] = []
    numbers: dict[int, int] = {}
    for boxes_ in found:
        try:
            if not {b"mdhd", b"stsd"} <= boxes_.keys():
                raise ValueError("no media header")
            if b"tkhd" in boxes_:
                box_ = Reader(data, *boxes_[b"tkhd"])
                box_.take(">QQ" if box_.flags()[0] == 1 else ">II")
                numbers[box_.one(">I")] = len(out)
            out.append(track_of(data, boxes_))
        except ValueError:
            out.append(None)
    rates, clock = {}, {}
    for number, k in numbers.items():
        if (t := out[k]) is not None:
            head = Reader(data, *found[k][b"mdhd"])
            head.take(">QQ" if head.flags()[0] == 1 else ">II")
            rates[number] = head.one(">I") or 1
            clock[number] = round(t.seconds * rates[number]) if len(t.sizes) else 0  # fragments follow what is in the tables
    for start, moof, runs, timed in fragments:
        try:
            track, samples = fragment_samples(data, start, moof, defaults, clock, runs, timed)
        except ValueError:
            continue
        t = out[numbers[track]] if track in rates else None
        if t is None or not samples:
            continue
        at, size, lasts, shown, sync = (np.array(x) for x in zip(*samples, strict=True))
        out[numbers[track]] = Track(
            t.codec, (t.seconds if len(t.sizes) else 0.0) + float(lasts.sum()) / rates[track], np.r_[t.offsets, at], np.r_[t.sizes, size],
            np.r_[t.keys, len(t.sizes) + np.flatnonzero(sync)].astype(np.int64), np.r_[t.times, shown / rates[track]],
        )
    for k, t in enumerate(out):
        try:
            shift = edit_shift(data, found[k], movie_rate) if t is not None else 0.0
        except ValueError:
            shift = 0.0
        if shift:
            out[k] = replace(t, times=t.times + shift)
    return out


def index(data: bytes) -> Track | None:
    """The first track that has samples; null where there is none or its tables are broken. Media data is never read."""
    return next((t for t in tracks(data) if t is not None and len(t.sizes)), None)


def payload_of(data: bytes, track: Track) -> bytes:
    """The bytes of all samples in order; neighbours in the file are taken in one slice."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    new = np.flatnonzero(np.r_[True, track.offsets[1:] != ends[:-1]])
    last = np.r_[new[1:], len(ends)] - 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[new].tolist(), ends[last].tolist(), strict=True))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of docs as a container, written to the shared folder.

    docs: (doc_id, text; other columns are ignored). Null texts count as empty,
    which still makes one sample; texts of any length are stored whole, rows
    repeat as given, and an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield record_batch(schema, part.column(0), [len(x) for x in data], [pack(padded(x)) for x in data])

    stored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return materialize(stored, "media")


def describe(media: DataFrame) -> DataFrame:
    """Of every row of media (doc_id, n_bytes, media; others are ignored): codec, seconds, keyframe ranges and times, and digests of what is stored.

    Rows whose container is null, empty, damaged or without samples have null
    there; tables are checked against the bounds of their boxes and of the file
    before anything is made of them. Rows repeat as given, and an empty table
    gives an empty result.
    """
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, seconds double, n_samples long, keyframes array<struct<offset:long,length:long,seconds:double>>"
    frames = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("seconds", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", frames)])

    def row(doc_id, n_bytes, data: bytes | None) -> tuple:
        if data is None:
            return (doc_id, n_bytes, *[None] * 9)
        track = index(data)
        tail = len(data), hashlib.sha256(data).hexdigest()
        if track is None:
            return (doc_id, n_bytes, None, None, None, *tail, None, None, None, None)
        payload = payload_of(data, track)
        keys = [{"offset": a, "length": b, "seconds": t} for a, b, t in track.keyframes()]
        return (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *tail, track.codec, track.seconds, len(track.sizes), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "media"):
                rows = [row(*x) for x in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
                yield record_batch(schema, *(list(c) for c in zip(*rows, strict=True)))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, out)
