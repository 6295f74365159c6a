"""Containers that others made, that are broken, or that are in fragments."""

import struct

import duckdb
import numpy as np
import pytest

from arborium.llm import media, queries

SF = "/root/testdata/sf0.001"


def described(data):
    found = media.tracks(data)
    for t in found:
        media.samples(data, t)
    return media.feature(found)


def test_any_bytes_give_a_result():
    rng = np.random.default_rng(4)
    whole = media.mux(media.padded(b"some text " * 60))
    places = [k for path, a, b in media.walk(whole) if path[-1] != b"mdat" for k in range(a - 8, min(b, a + 40))]
    for _ in range(1500):
        data = bytearray(whole)
        for at in rng.choice(places, rng.integers(1, 6)):
            data[at] = rng.choice([0, 1, 2, 4, 16, 127, 128, 255, int(rng.integers(0, 256))])
        described(bytes(data[: rng.integers(0, len(data) + 1)] if rng.random() < 0.3 else data))
    for n in range(0, 400, 7):
        described(rng.bytes(n))
        described(whole[:n])


def table(kind, body):
    return media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", *body, media.box(kind))))))


@pytest.mark.parametrize("kind", [b"stz2", b"co64", b"stco", b"stsc", b"stts", b"stss", b"stsz", b"tkhd", b"mdhd", b"hdlr", b"stsd"])
def test_empty_boxes(kind):
    assert len(media.tracks(table(kind, []))) == 1


def test_counts_beyond_the_file():
    most = 0xFFFFFFFF
    body = [media.full(b"stts", struct.pack(">III", 1, most, 1)), media.full(b"stsc", struct.pack(">IIII", 1, 1, most, 1)), media.full(b"stsz", struct.pack(">II", 1, most)), media.full(b"stco", struct.pack(">II", 1, 0))]
    (t,) = media.tracks(table(b"free", body))
    assert 0 < len(t.sizes) <= 1000


def test_deep_nesting():
    data = b""
    for _ in range(2000):
        data = media.box(b"moov", data)
    assert max(len(p) for p, _, _ in media.walk(data)) == media.DEEPEST + 1


def test_durations_of_64_bits():
    data = media.mux(media.padded(b"x" * 192 * 8), frame_ticks=1 << 31)
    (t,) = media.tracks(data)
    assert (t.track_id, t.timescale, t.duration, len(t.sizes), t.times[-1]) == (1, media.TIMESCALE, 8 << 31, 8, 7 << 31)
    assert media.samples(data, t) == b"x" * 192 * 8


def test_fragments():
    track = media.box(b"trak", media.full(b"tkhd", bytes(8), struct.pack(">I", 7), bytes(64)), media.box(b"mdia", media.full(b"mdhd", bytes(8), struct.pack(">II", 1000, 0), bytes(4))))
    moov = media.box(b"moov", track, media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 7, 1, 40, 5, 0x10000))))

    def moof(offset):
        run = media.full(b"trun", struct.pack(">Ii", 3, offset), struct.pack(">I", 0), struct.pack(">III", 5, 6, 7), flags=0x1 | 0x4 | 0x200)
        rest = media.full(b"trun", struct.pack(">I", 2))
        return media.box(b"moof", media.full(b"mfhd", bytes(4)), media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), media.full(b"tfdt", struct.pack(">I", 100)), run, rest))

    part = moof(len(moof(0)) + 8) + media.box(b"mdat", b"aaaaabbbbbbcccccccdddddeeeee")
    data = moov + part + part
    (t,) = media.tracks(data)
    assert t.sizes.tolist() == [5, 6, 7, 5, 5] * 2 and t.times.tolist() == [100, 140, 180, 220, 260] * 2 and t.keys.tolist() == [0, 5]
    assert media.samples(data, t) == b"aaaaabbbbbbcccccccdddddeeeee" * 2
    assert [data[o : o + s] for _, o, s in t.keyframes()] == [b"aaaaa"] * 2 and t.duration == 300


MOST = (1 << 64) - 1


def fragmented(base=0, time=0, duration=0, count=2, offset=None, flags=0x200, sizes=(5, 6)):
    """A movie without samples and one fragment, with 64-bit fields."""
    track = media.box(b"trak", media.full(b"tkhd", bytes(8), struct.pack(">I", 7), bytes(64)), media.box(b"mdia", media.box(b"mdhd", b"\1\0\0\0", bytes(16), struct.pack(">IQ", 1000, duration), bytes(4))))
    moov = media.box(b"moov", track, media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 7, 1, 40, 5, 0))))
    run = media.full(b"trun", struct.pack(">I", count), b"" if offset is None else struct.pack(">i", offset), struct.pack(f">{len(sizes)}I", *sizes), flags=flags | (0 if offset is None else 1))
    head = media.full(b"tfhd", struct.pack(">IQ", 7, base), flags=1)
    return moov + media.box(b"moof", media.box(b"traf", head, media.box(b"tfdt", b"\1\0\0\0", struct.pack(">Q", time)), run)) + media.box(b"mdat", b"x" * 20)


@pytest.mark.parametrize("base", [0, 1 << 40, (1 << 63) - 1, 1 << 63, MOST])
@pytest.mark.parametrize("time", [0, (1 << 63) - 1, MOST])
def test_fields_of_64_bits(spark, base, time):
    data = fragmented(base, time, duration=MOST)
    (t,) = media.tracks(data)
    assert len(t.sizes) == 2 and t.times[0] == min(time, media.FAR) and t.offsets[0] == min(base, media.FAR)
    assert media.payload_of(data, [t]) == (data[:11] if not base else b"")
    rows = media.track_table(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).collect()
    assert rows[0].samples == 2


@pytest.mark.parametrize(("wide", "value", "want"), [(True, MOST, None), (True, MOST - 1, (1 << 63) - 1), (True, 1 << 40, 1 << 40), (False, 0xFFFFFFFF, None), (False, 9, 9)])
def test_unknown_durations(spark, wide, value, want):
    head = media.box(b"mdhd", b"\1\0\0\0", bytes(16), struct.pack(">IQ", 1000, value), bytes(4)) if wide else media.full(b"mdhd", bytes(8), struct.pack(">II", 1000, value), bytes(4))
    data = media.box(b"moov", media.box(b"trak", media.box(b"mdia", head)))
    (t,) = media.tracks(data)
    assert t.duration == want and media.json.loads(media.feature([t]))[0]["duration"] == want
    assert [r.duration for r in media.track_table(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).collect()] == [want]


def test_a_body_that_is_named_again_and_again():
    """Samples that overlap: bytes and samples stay within the container's size, however many tracks say so."""
    body = [media.full(b"stts", struct.pack(">III", 1, 10**6, 1)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 10**6, 1)), media.full(b"stsz", struct.pack(">II", 0, 300), media.table([40_000] * 300)), media.full(b"stco", struct.pack(">I", 300), media.table([0] * 300))]
    body[1] = media.full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1))
    track = media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", *body))))
    data = media.box(b"moov", track * 20) + media.box(b"mdat", b"y" * 50_000)
    found = media.tracks(data)
    assert len(found) == 20 and len(media.payload_of(data, found)) <= len(data)
    assert media.samples(data, found[0], 100_000) == data[:40_000] * 2
    same = [media.full(b"stts", struct.pack(">III", 1, 10**6, 1)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 10**6, 1)), media.full(b"stsz", struct.pack(">II", 1, 10**6)), media.full(b"stco", struct.pack(">II", 1, 0))]
    many = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", *same)))) * 200)
    assert sum(len(t.sizes) for t in media.tracks(many)) <= len(many)


def test_any_fragments_give_a_result():
    rng = np.random.default_rng(8)
    numbers = [0, 1, 2, 127, 128, 255]
    for _ in range(1500):
        wide = [int(rng.choice([0, 5, 1 << 31, (1 << 32) - 1, 1 << 62])) * int(rng.integers(0, 4)) + int(rng.integers(0, 3)) for _ in range(3)]
        data = bytearray(fragmented(*(min(w, MOST) for w in wide), count=int(rng.choice([0, 1, 2, 3, 0xFFFFFFFF])), offset=rng.choice([None, -5, 0, 9, 2**31 - 1]), flags=int(rng.choice([0, 0x200, 0x300, 0xF00, 0x204]))))
        for at in rng.integers(0, len(data), rng.integers(0, 5)):
            data[at] = rng.choice(numbers)
        found = media.tracks(bytes(data))
        assert len(media.payload_of(bytes(data), found)) <= len(data)
        media.feature(found)
        assert all(np.abs(t.times).max(initial=0) < 1 << 63 and np.abs(t.offsets).max(initial=0) < 1 << 63 for t in found)


def test_stored_form_in_the_query(spark):
    """media_bytes, media_sha256 and feature against containers made here, text by text."""
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    for r in queries.op1_media(spark, SF).collect():
        data = media.mux(media.padded(texts[r.doc_id].encode()))
        frames = len(media.padded(texts[r.doc_id].encode())) // 192
        at = data.index(b"mdat") + 4
        keys = [[at + 192 * k, 192] for k in range(0, frames, 8)]
        shown = [{"from": at, "step": 1536, "count": len(keys), "bytes": 192}] if len(keys) > 2 else keys
        want = [{"track": 1, "handler": "vide", "codec": "raw ", "timescale": 25000, "duration": 1000 * frames, "samples": frames, "keyframes": shown}]
        assert (r.media_bytes, r.media_sha256, media.json.loads(r.feature)) == (len(data), media.hashlib.sha256(data).hexdigest(), want)
