"""ISO media containers: written, walked box by box, and described from their sample tables.

mux() stores a payload as uncompressed 8-bit RGB frames of 8 x 8 pixels (192 bytes a sample, codec "raw ")
in one video track. describe() knows nothing of mux(): it walks the nested boxes of any ISO container, decodes
the sample tables (stts, stsc, stsz or stz2, stco or co64, stss) and the runs of fragments (tfhd, tfdt, trun, with
trex defaults) and gives codec, duration and the byte ranges of keyframes; samples are read by those ranges and
never decoded.

Defined results: a null payload is empty; a container without a movie has no tracks; of a table that is cut short, or
counts more than its box or the file can hold, what is there is used; boxes that leave their parent, or lie deeper than
DEEPEST, aren't opened; samples before the file's start are left out; a duration of all ones is unknown, null; offsets and
times beyond FAR count as FAR; all tracks together hold at most as many samples, and give at most as many bytes, as the
container has bytes (samples may overlap; a file that names its body again and again ends there); any bytes give a
result. Repeated rows are handled one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8, written

#: One frame: 8 x 8 pixels of three 8-bit samples.
SIDE, CHANNELS = 8, 3
SAMPLE = SIDE * SIDE * CHANNELS
PAD = b"\x20"
SAMPLES_A_CHUNK = 16
KEYFRAME_EVERY = 8
TIMESCALE, FRAME_TICKS = 25_000, 1_000
#: Boxes that hold boxes; stsd and the like hold tables.
DEEPEST = 32
#: Largest offset and time that is told apart; sums with all sizes of a file stay in 64 bits.
FAR = 1 << 61
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def table(values) -> bytes:
    return np.asarray(values, ">u4").tobytes()


def padded(text: bytes) -> bytes:
    """The text with spaces after it up to a positive multiple of SAMPLE."""
    return text + PAD * (SAMPLE - len(text) if not text else -len(text) % SAMPLE)


def mux(payload: bytes, frame_ticks: int = FRAME_TICKS) -> bytes:
    """A container of one video track whose samples are the payload's frames, in order; headers are 64 bits wide where the duration asks."""
    frames = len(payload) // SAMPLE
    chunks, rest = divmod(frames, SAMPLES_A_CHUNK)
    runs = ([(1, SAMPLES_A_CHUNK, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    starts = np.arange(chunks + bool(rest), dtype=np.int64) * SAMPLES_A_CHUNK * SAMPLE
    ticks = frames * frame_ticks
    long = ticks >= 1 << 32
    head_of = lambda narrow, wide, *values: (b"\1\0\0\0" if long else bytes(4)) + struct.pack(wide if long else narrow, *values)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))

    def movie(base: int) -> bytes:
        wide = base + len(payload) >= 1 << 32
        offsets = full(b"co64", struct.pack(">I", len(starts)), (starts + base).astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", len(starts)), table(starts + base))
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, frame_ticks)),
            full(b"stss", struct.pack(">I", -(-frames // KEYFRAME_EVERY)), table(np.arange(1, frames + 1, KEYFRAME_EVERY))),
            full(b"stsc", struct.pack(">I", len(runs)), table(runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, frames)),
            offsets,
        )
        media = box(
            b"mdia",
            box(b"mdhd", head_of(">IIIIHH", ">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
        )
        track = head_of(">IIIII", ">QQIIQ", 0, 0, 1, 0, ticks)
        head = box(b"tkhd", track[:3], b"\3", track[4:], bytes(8), bytes(8), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
        top = box(b"mvhd", head_of(">IIII", ">QQIQ", 0, 0, TIMESCALE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", top, box(b"trak", head, media))

    first = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    draft = len(first) + len(movie(0)) + head
    return first + movie(len(first) + len(movie(draft)) + head) + box(b"mdat", payload)


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int | None = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    end: int = 0  # of its fragments so far

    def keyframes(self) -> np.ndarray:
        """Rows (time, offset, size) of the keyframes."""
        return np.stack([self.times[self.keys], self.offsets[self.keys], self.sizes[self.keys]], 1)


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start and end of the content) of each box, depth first; stops at a box that leaves its parent."""
    stack = [((), start, len(data) if end is None else end)]
    while stack:
        path, at, stop = stack.pop()
        if at + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= stop:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = stop - at
        if size < head or at + size > stop:
            continue
        stack.append((path, at + size, stop))
        yield (*path, kind), at + head, at + size
        if kind in NESTED and len(path) < DEEPEST:
            stack.append(((*path, kind), at + head, at + size))


def numbers(data: bytes, start: int, end: int, count: int, kind: str) -> np.ndarray:
    """count numbers of a table, or as many as the box holds."""
    held = max(0, min(count, (end - start) // np.dtype(kind).itemsize))
    return np.frombuffer(data, kind, held, start).astype(np.int64) if held else np.zeros(0, np.int64)


def rows_of(data: bytes, start: int, end: int, count: int, width: int) -> np.ndarray:
    """Whole rows of a table of 32-bit numbers."""
    found = numbers(data, start, end, count * width, ">u4")
    return found[: len(found) // width * width].reshape(-1, width)


def repeated(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Each value so many times, up to most in all."""
    ends = np.minimum(np.cumsum(np.clip(counts, 0, most)), most)
    return np.repeat(values, np.diff(ends, prepend=0))


def u4(data: bytes, at: int, end: int) -> int:
    """The 32-bit number at a place of a box, 0 beyond its end."""
    return struct.unpack_from(">I", data, at)[0] if at + 4 <= end else 0


def laid_out(track: Track, raw: dict[bytes, np.ndarray], most: int) -> int:
    """Sets a track's samples from its tables, so many at most; their number."""
    none = np.zeros(0, np.int64)
    sizes, chunks, runs, stts = raw.get(b"size", none), raw.get(b"chunk", none), raw.get(b"stsc", np.zeros((0, 3), np.int64)), raw.get(b"stts", np.zeros((0, 2), np.int64))
    last = np.append(runs[1:, 0], len(chunks) + 1) if len(runs) else none
    sizes, chunks = sizes[:most], np.minimum(chunks, FAR)
    each = repeated(runs[:, 1], last - runs[:, 0], len(chunks))
    of = repeated(np.arange(len(each)), each, len(sizes))
    times = np.concatenate([[0], np.cumsum(repeated(stts[:, 1], stts[:, 0], len(sizes)))])
    count = min(len(of), len(times))
    of, sizes, times = of[:count], sizes[:count], times[:count]
    before = np.cumsum(sizes) - sizes
    track.offsets, track.sizes, track.times = chunks[of] + before - before[np.searchsorted(of, of, "left")], sizes, times
    keys = raw[b"stss"] - 1 if b"stss" in raw else np.arange(count)
    track.keys = keys[(keys >= 0) & (keys < count)][:count]
    return count


def within(track: Track) -> Track:
    """The track without samples before the file's start."""
    there = track.offsets >= 0
    if not there.all():
        place = np.cumsum(there) - 1
        track.keys = place[track.keys[there[track.keys]]]
        track.offsets, track.sizes, track.times = track.offsets[there], track.sizes[there], track.times[there]
    return track


@dataclass
class Fragment:
    """What the boxes of a fragment say of one track."""

    track_id: int
    base: int
    duration: int
    size: int
    flags: int
    time: int | None = None
    next: int = 0


def add_run(data: bytes, at: int, end: int, fragment: Fragment, track: Track, most: int) -> int:
    """Appends the samples of a trun box to a track, so many at most; a keyframe is a sample that isn't marked as depending on others."""
    flags, count, at = u4(data, at, end) & 0xFFFFFF, min(most, u4(data, at + 4, end)), at + 8
    start = fragment.next or fragment.base
    if flags & 0x1:
        start, at = fragment.base + (u4(data, at, end) ^ 0x80000000) - 0x80000000, at + 4
    first = u4(data, at, end) if flags & 0x4 else None
    at += 4 if flags & 0x4 else 0
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    table = rows_of(data, at, end, count, len(fields)) if fields else np.zeros((count, 0), np.int64)
    column = lambda f, default: table[:, fields.index(f)] if f in fields else np.full(len(table), default, np.int64)
    steps, sizes, marks = column(0x100, fragment.duration), column(0x200, fragment.size), column(0x400, fragment.flags).copy()
    if first is not None and len(marks):
        marks[0] = first
    base = fragment.time if fragment.time is not None else int(track.end)
    keys = np.flatnonzero(~marks & 0x10000) + len(track.sizes)
    track.keys = np.concatenate([track.keys, keys])
    track.offsets = np.concatenate([track.offsets, start + np.cumsum(sizes) - sizes])
    track.times = np.concatenate([track.times, base + np.cumsum(steps) - steps])
    track.sizes = np.concatenate([track.sizes, sizes])
    fragment.next, track.end = min(FAR, start + int(sizes.sum())), min(FAR, base + int(steps.sum()))
    fragment.time = track.end
    return len(sizes)


def u8(data: bytes, at: int, end: int) -> int:
    return u4(data, at, end) << 32 | u4(data, at + 4, end)


def duration_of(value: int, bits: int) -> int | None:
    """A duration field; all ones mean that it is unknown."""
    return None if value == (1 << bits) - 1 else min(value, (1 << 63) - 1)


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container with all their samples, those of fragments after those of the movie."""
    found: list[Track] = []
    raw: dict[bytes, np.ndarray] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    fragment, moof, data_end, room = None, 0, 0, len(data)
    for path, at, end in walk(data):
        kind = path[-1]
        long = end > at and data[at] == 1
        if kind == b"trak":
            if found:
                room -= laid_out(found[-1], raw, room)
            found.append(Track())
            raw = {}
        elif kind == b"trex":
            defaults[u4(data, at + 4, end)] = (u4(data, at + 12, end), u4(data, at + 16, end), u4(data, at + 20, end))
        elif kind == b"moof":
            if found and raw:
                room -= laid_out(found[-1], raw, room)
                raw = {}
            moof = data_end = at - (16 if data[max(0, at - 16) : at - 8] == b"\0\0\0\1moof" else 8)
        elif kind == b"tfhd" and b"moof" in path:
            flags, name, place = u4(data, at, end) & 0xFFFFFF, u4(data, at + 4, end), at + 8
            values = dict(zip((0x8, 0x10, 0x20), defaults.get(name, (0, 0, 0)), strict=True))
            base = moof if flags & 0x20000 else data_end
            if flags & 0x1:
                base, place = min(FAR, u8(data, place, end)), place + 8
            place += 4 if flags & 0x2 else 0
            for bit in values:
                if flags & bit:
                    values[bit], place = u4(data, place, end), place + 4
            fragment = Fragment(name, base, *values.values())
        elif kind == b"tfdt" and fragment:
            fragment.time = min(FAR, u8(data, at + 4, end)) if long else u4(data, at + 4, end)
        elif kind == b"trun" and fragment:
            for track in (t for t in found if t.track_id == fragment.track_id):
                room -= add_run(data, at, end, fragment, track, room)
                data_end = fragment.next
        elif not found or b"trak" not in path:
            continue
        elif kind == b"tkhd":
            found[-1].track_id = u4(data, at + (20 if long else 12), end)
        elif kind == b"mdhd":
            found[-1].timescale = u4(data, at + (20 if long else 12), end)
            found[-1].duration = duration_of(u8(data, at + 24, end), 64) if long else duration_of(u4(data, at + 16, end), 32)
        elif kind == b"hdlr":
            found[-1].handler = data[at + 8 : min(end, at + 12)].decode("latin-1")
        elif kind == b"stsd":
            found[-1].codec = data[at + 12 : min(end, at + 16)].decode("latin-1")
        elif kind in (b"stts", b"stsc"):
            raw[kind] = rows_of(data, at + 8, end, u4(data, at + 4, end), 2 if kind == b"stts" else 3)
        elif kind == b"stss":
            raw[kind] = numbers(data, at + 8, end, u4(data, at + 4, end), ">u4")
        elif kind == b"stsz":
            size, count = u4(data, at + 4, end), u4(data, at + 8, end)
            raw[b"size"] = np.full(min(count, len(data)), size, np.int64) if size else numbers(data, at + 12, end, count, ">u4")
        elif kind == b"stz2":
            bits, count = u4(data, at + 4, end) & 0xFF, u4(data, at + 8, end)
            values = numbers(data, at + 12, end, -(-count // 2) if bits == 4 else count, ">u2" if bits == 16 else "u1")
            raw[b"size"] = np.stack([values >> 4, values & 15], 1).ravel()[:count] if bits == 4 else values
        elif kind in (b"stco", b"co64"):
            raw[b"chunk"] = numbers(data, at + 8, end, u4(data, at + 4, end), ">u4" if kind == b"stco" else ">i8")
    if found and raw:
        laid_out(found[-1], raw, room)
    for track in found:
        track.duration = track.duration or track.end or track.duration
    return [within(t) for t in found]


def samples(data: bytes, track: Track, most: int | None = None) -> bytes:
    """The stored bytes of a track's samples, in order, those of its first samples that are so many bytes at most (by default the container's).

    Neighbouring samples are read together.
    """
    from_ = np.minimum(track.offsets, len(data))
    sizes = np.minimum(track.sizes, len(data) - from_)
    count = int(np.searchsorted(np.cumsum(sizes), len(data) if most is None else most, "right"))
    if not count:
        return b""
    from_, sizes = from_[:count], sizes[:count]
    breaks = np.flatnonzero(from_[1:] != from_[:-1] + sizes[:-1]) + 1
    first = np.concatenate([[0], breaks])
    last = np.concatenate([breaks, [count]]) - 1
    return b"".join(data[from_[a] : from_[b] + sizes[b]] for a, b in zip(first, last, strict=True))


def payload_of(data: bytes, found: list[Track]) -> bytes:
    """The samples of all tracks, as many bytes together as the container has at most."""
    parts, left = [], len(data)
    for track in found:
        parts.append(samples(data, track, left))
        left -= len(parts[-1])
    return b"".join(parts)


def feature(found: list[Track]) -> str:
    """Codec, duration and keyframe byte ranges of all tracks, as JSON; a run of even steps is [first, step, count]."""

    def ranges(keys: np.ndarray) -> list:
        offsets, sizes = keys[:, 1], keys[:, 2]
        if len(keys) > 2 and len(set(np.diff(offsets).tolist())) == 1 and len(set(sizes.tolist())) == 1:
            return [{"from": int(offsets[0]), "step": int(offsets[1] - offsets[0]), "count": len(keys), "bytes": int(sizes[0])}]
        return [[int(a), int(b)] for a, b in zip(offsets, sizes, strict=True)]

    return json.dumps([{"track": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": ranges(t.keyframes())} for t in found], separators=(",", ":"))


TRACK_SCHEMA = "track_id long, handler string, codec string, timescale long, duration long, samples long, media_bytes long, keyframes array<struct<time:long,offset:long,size:long>>"


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes of the text, and its container in column media."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(store, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def track_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each track of each container: key and TRACK_SCHEMA."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("time", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            out = [(k, t) for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in tracks(data or b"")]
            columns = [pa.array([k for k, _ in out], batch.schema.types[0])]
            columns += [pa.array([getattr(t, n) for _, t in out], kind) for n, kind in (("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()))]
            columns += [pa.array([len(t.sizes) for _, t in out], pa.int64()), pa.array([int(t.sizes.sum()) for _, t in out], pa.int64())]
            columns.append(pa.array([[dict(zip(("time", "offset", "size"), map(int, r), strict=True)) for r in t.keyframes()] for _, t in out], pa.list_(kinds)))
            yield pa.RecordBatch.from_arrays(columns, names=[key, *(c.split()[0] for c in TRACK_SCHEMA.split(", "))])

    return media.select(key, column).mapInArrow(rows, f"{key} {media.schema[key].dataType.simpleString()}, {TRACK_SCHEMA}")


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What op1 returns, from the stored containers alone but for n_bytes."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names[1:]}
            for data in batch.column("media").to_pylist():
                found = tracks(data)
                payload = payload_of(data, found)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(found))
                for n, v in zip(names[1:], values, strict=True):
                    out[n].append(v)
            kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *(pa.array(out[n], k) for n, k in zip(names[1:], kinds[1:], strict=True))], names=[key, *names])

    return media.mapInArrow(rows, f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_documents(docs: DataFrame) -> DataFrame:
    """Stores each text as a container in a table of the shared folder and describes what lies there."""
    return digests(written(media_column(docs), "media"))
