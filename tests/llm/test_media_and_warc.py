"""Round trips of pictures and archives, and recovery after damage."""

import gzip
import hashlib
import math
import os
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from quoteloom.llm import media, warc

from .docs import ODD, frame


@pytest.mark.parametrize("blocks", [1, 2, 3, 5, 64, 1000])
def test_payload_round_trip(blocks):
    payload = os.urandom(blocks * 64)
    picture = media.Picture(media.encode(payload))
    coefficients = media.decode([picture])[0]
    assert media.payload_of(picture, coefficients) == payload
    assert media.thumbnail(picture, coefficients).shape == (picture.height // 8, picture.width // 8)


def foreign(blocks, quantiser=16):
    """A grey picture by another encoder: codes of several lengths, zero runs, ends of blocks, no restart markers."""
    symbols = [0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0xF0, 0x11, 0x12, 0x21, 0x31]  # AC
    ac_code = {s: f"{i:04b}" for i, s in enumerate(symbols)}
    dc_code = {s: f"{i:04b}" for i, s in enumerate(range(12))}

    def extra(v):
        size = abs(v).bit_length()
        return size, (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    bits, before = "", 0
    for block in blocks:
        size, more = extra(block[0] - before)
        before = block[0]
        bits += dc_code[size] + more
        run = 0
        last = max((i for i in range(1, 64) if block[i]), default=0)
        for i in range(1, last + 1):
            if block[i] == 0:
                run += 1
                if run == 16:
                    bits, run = bits + ac_code[0xF0], 0
            else:
                size, more = extra(block[i])
                bits, run = bits + ac_code[run << 4 | size] + more, 0
        if last < 63:
            bits += ac_code[0x00]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    table = lambda kind, s: bytes([kind, 0, 0, 0, len(s)] + [0] * 12 + list(s))
    seg = media._segment
    high = len(blocks)
    return b"\xff\xd8" + seg(0xFE, b"comment") + seg(0xDB, b"\0" + bytes([quantiser] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, high * 8, 8, 1) + b"\1\x11\0") + seg(0xC4, table(0, range(12))) + seg(0xC4, table(0x10, symbols)) + seg(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"


def test_foreign_baseline_picture():
    rnd = random.Random(1)
    blocks = []
    for _ in range(40):
        b = [0] * 64
        b[0] = rnd.randrange(-60, 60)
        for i in rnd.sample(range(1, 5), 2):
            b[i] = rnd.choice([-3, -1, 1, 2])
        b[1] = b[1] or 1
        b[2] = b[2] or -1
        b[3] = b[3] or 1
        if rnd.random() < 0.3:
            b[4 + 16 + 1] = 1
            b[4] = b[4] or 1
        blocks.append(b)
    picture = media.Picture(foreign(blocks))
    got = media.decode([picture])[0]
    assert got.reshape(-1, 64).tolist() == blocks
    shades = media.thumbnail(picture, got)
    assert shades.ravel().tolist() == [int(np.clip(round(b[0] * 2) + 128, 0, 255)) for b in blocks]


def coded(units, of, width, height, sampling, interval=0, quantisers=(16, 9)):
    """A picture by a plain encoder, bit by bit: ``units`` of blocks, ``of`` their components, restarts after ``interval`` units."""
    sizes = [run << 4 | size for run in range(4) for size in range(1, 8)] + [0x00, 0xF0]
    dc_code, ac_code = {s: f"{i:05b}" for i, s in enumerate(range(12))}, {s: f"{i:06b}" for i, s in enumerate(sizes)}
    seg, scan, bits, before = media._segment, b"", [], Counter()

    def extra(v):
        size = abs(v).bit_length()
        return size, (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    def flush(bits):
        bits = "".join(bits)
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""

    for u, unit in enumerate(units):
        if interval and u and u % interval == 0:
            scan += flush(bits) + bytes([0xFF, 0xD0 + (u // interval - 1) % 8])
            bits, before = [], Counter()
        for block, c in zip(unit, of, strict=True):
            size, more = extra(block[0] - before[c])
            before[c] = block[0]
            bits.append(dc_code[size] + more)
            run = 0
            last = max((i for i in range(1, 64) if block[i]), default=0)
            for i in range(1, last + 1):
                if block[i] == 0:
                    run += 1
                    continue
                while run > 3:  # runs that the table has no symbol for: 16 zeros, or a wide step of them
                    assert run >= 16
                    bits.append(ac_code[0xF0])
                    run -= 16
                size, more = extra(block[i])
                bits.append(ac_code[run << 4 | size] + more)
                run = 0
            bits.append(ac_code[0x00] if last < 63 else "")
    scan += flush(bits)
    table = lambda kind, n, s: bytes([kind] + [0] * (n - 1) + [len(s)] + [0] * (16 - n) + list(s))
    parts = len(sampling)
    frame_ = struct.pack(">BHHB", 8, height, width, parts) + b"".join(bytes([i + 1, hv, min(i, 1)]) for i, hv in enumerate(sampling))
    return b"".join(
        [b"\xff\xd8", *(seg(0xDB, bytes([i]) + bytes([q] * 64)) for i, q in enumerate(quantisers)), seg(0xC0, frame_), seg(0xC4, table(0, 5, range(12)) + table(0x10, 6, sizes))]
        + ([seg(0xDD, struct.pack(">H", interval))] if interval else [])
        + [seg(0xDA, bytes([parts]) + b"".join(bytes([i + 1, 0]) for i in range(parts)) + b"\0\x3f\0"), scan, b"\xff\xd9"]
    )


def random_block(rnd):
    block, at = [rnd.randrange(-60, 60)] + [0] * 63, 0
    for _ in range(rnd.randrange(0, 9)):
        at += rnd.choice([1, 1, 2, 3, 4, 17, 18])
        if at < 64:
            block[at] = rnd.choice([-100, -9, -1, 1, 2, 30, 127])
    return block


@pytest.mark.parametrize("interval", [0, 1, 3, 50])
@pytest.mark.parametrize("sampling", [[0x11], [0x11, 0x11, 0x11], [0x22, 0x11, 0x11], [0x21, 0x11, 0x11]])
def test_baseline_pictures_of_all_kinds(spark, monkeypatch, sampling, interval):
    """Grey and three components, 4:4:4, 4:2:0 and 4:2:2, restart intervals of several lengths, sizes that fill no unit."""
    rnd = random.Random(len(sampling) + interval)
    h, v = (sampling[0] >> 4, sampling[0] & 15) if len(sampling) > 1 else (1, 1)
    of = [0] * (h * v) + list(range(1, len(sampling)))
    width, height, (across, down) = 16 * 4 - 5, 16 * 3 - 9, (-(-(16 * 4 - 5) // (8 * h)), -(-(16 * 3 - 9) // (8 * v)))
    units = [[random_block(rnd) for _ in of] for _ in range(across * down)]
    raw = coded(units, of, width, height, sampling, interval)
    picture = media.Picture(raw)
    got = media.decode([picture])[0]
    assert got.tolist() == units
    monkeypatch.setattr(media, "LANES", 0)  # in step to the end
    assert media.decode([picture, picture])[1].tolist() == units
    monkeypatch.undo()
    grey = np.zeros((down * v, across * h), int)
    for u, unit in enumerate(units):
        for j in range(h * v):
            grey[u // across * v + j // h, u % across * h + j % h] = int(np.clip(np.round(unit[j][0] * 16 / 8) + 128, 0, 255))
    grey = grey[: -(-height // 8), : -(-width // 8)]
    assert media.thumbnail(picture, got).tolist() == grey.tolist()
    # a column of such pictures has dimensions and hashes, and no payload; one with the marker beside it keeps its own
    mine = media.encode(os.urandom(640))
    df = spark.createDataFrame([(1, 5, bytearray(raw)), (2, 640, bytearray(mine)), (3, 1, bytearray(raw[:-30]))], "doc_id long, n_bytes long, media binary").coalesce(1)
    rows = {r.doc_id: r for r in media.read_media(df).collect()}
    assert (rows[1].width, rows[1].height, rows[1].thumbnail_hash, rows[1].payload_sha256) == (width, height, plain_hash(grey), None)
    assert rows[2].payload_bytes == 640 and rows[3].width is None


@pytest.mark.parametrize("interval", [0, 3000])
def test_two_megapixels_without_many_restarts(interval):
    rnd = random.Random(9)
    some = [[random_block(rnd) for _ in range(6)] for _ in range(50)]
    units = [rnd.choice(some) for _ in range(100 * 79)]
    picture = media.Picture(coded(units, [0] * 4 + [1, 2], 1600, 1250, [0x22, 0x11, 0x11], interval))
    began = time.process_time()
    got = media.decode([picture])[0]
    assert time.process_time() - began < 6
    assert (got == np.array(units)).all() and media.thumbnail(picture, got).shape == (157, 200)


def plain_hash(pixels):
    """Cell by cell."""
    high, wide = pixels.shape
    mean = lambda r, c: pixels[r * high // 8 : max((r + 1) * high // 8, r * high // 8 + 1), c * wide // 9 : max((c + 1) * wide // 9, c * wide // 9 + 1)]
    bits = "".join("1" if mean(r, c).sum() * mean(r, c + 1).shape[1] < mean(r, c + 1).sum() * mean(r, c).shape[1] else "0" for r in range(8) for c in range(8))
    return f"{int(bits, 2):016x}"


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 9), (9, 10), (40, 33)])
def test_difference_hash(shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert media.difference_hash(pixels) == plain_hash(pixels.astype(int))


def test_broken_pictures():
    good = media.encode(os.urandom(640))
    for raw in (b"", b"\xff\xd8", good[:50], good[:-40] + b"\xff\xd9", good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError)):
            media.decode([media.Picture(raw)])


def test_media_columns(spark):
    got = media.read_media(media.write_media(frame(spark))).collect()
    texts = {r[0]: r[1] for r in ODD}
    assert len(got) == len(ODD)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.encode(payload)), hashlib.sha256(media.encode(payload)).hexdigest())
        blocks = len(payload) // 64
        wide = math.ceil(math.sqrt(blocks))
        shades = [(b if b >= 128 else b - 255) for b in payload[::64]] + [-255] * (-(-blocks // wide) * wide - blocks)  # the DC coefficient of each block
        grey = np.array([int(np.clip(np.round(d * 4 / 8) + 128, 0, 255)) for d in shades]).reshape(-1, wide)
        assert (r.width, r.height, r.thumbnail_hash) == (8 * wide, 8 * len(grey), plain_hash(grey))
    assert media.read_media(media.write_media(frame(spark, []))).count() == 0
    broken = spark.createDataFrame([(1, 2, bytearray(b"no picture")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r.payload_sha256 for r in media.read_media(broken).collect()] == [None, None]


PAGES = "page_id long, url string, html string, kind string, digest string"


def page_rows():
    long = "<p>" + "text " * 50
    return [(1, "http://a", "small", "k", "d"), (2, "http://b", "small", None, None), (5, None, long, "k", None), (3, "http://c\r\nX: y", long, "k", None), (4, "u", None, None, None), (6, "u", "", None, None), (7, "u", long, None, None), (7, "u", long, None, None), (None, "u", long, None, None), (8, "u", "WARC/1.1\r\n" * 30, None, None), (9, "u", "é" * 400000, None, None)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = []
    for page, _, html, *_ in page_rows():
        raw = (html or "").encode()
        first = min(p for p, _, h, *_ in page_rows() if p is not None and (h or "") == (html or ""))
        if page is not None:
            again = len(raw) >= 100 and page != first
            want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=lambda r: r[:1])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_round_trip_of_a_long_url(spark):
    long, html = "data:text/html," + "u" * 100_000, "<p>" + "text " * 50
    pages = spark.createDataFrame([(1, long, html, "k", "d"), (2, "u", html, "k", "d"), (3, long, html, "k", "d")], PAGES)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    raw = html.encode()
    assert got == [(i, len(raw), hashlib.sha256(raw).hexdigest(), *kind) for i, kind in ((1, ("response", None)), (2, ("revisit", 1)), (3, ("revisit", 1)))]


def test_damage_is_told(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}" * 50, "k", "d") for i in range(20)], PAGES)
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    assert warc.restored(spark, f"file://{tmp_path}/w").count() == 20
    (name,) = (f for f in (tmp_path / "w").rglob("*") if f.is_file() and not f.name.startswith((".", "_")) and f.stat().st_size)
    raw = bytearray(name.read_bytes())
    raw[len(raw) // 2] ^= 0xFF
    name.with_name("damaged.warc.gz").write_bytes(raw)
    name.unlink()
    with pytest.raises(ValueError, match="damaged"):
        warc.restored(spark, f"file://{tmp_path}/w").count()


def archive(packed, n=12):
    records = [warc.record(i, f"http://{i}", bytes([i]) * (200 + i), "x", None) for i in range(n)]
    return [warc.member(r) if packed else r for r in records]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    parts = archive(packed)
    whole = b"".join(parts)
    ids = lambda data: [h["warc-record-id"] for kind, _, _, h, _ in warc.salvage(data) if kind == "record"]
    covered = lambda data: sum(size for _, _, size, *_ in warc.salvage(data))
    assert len(ids(whole)) == 12 and covered(whole) == len(whole)
    for hurt in range(12):
        start = sum(map(len, parts[:hurt]))
        middle = start + len(parts[hurt]) - 50  # in the block or its packed form; headers carry no digest
        flipped = bytearray(whole)
        flipped[middle] ^= 0x55
        cut = whole[:middle] + whole[start + len(parts[hurt]) :]
        junk = whole[:start] + b"\x1f\x8b\x08WARC/1.1\r\njunk" + whole[start + len(parts[hurt]) :]
        for data in (bytes(flipped), cut, junk):
            assert ids(data) == [f"<urn:page:{i}>" for i in range(12) if i != hurt]
            gaps = [(s, n) for kind, s, n, *_ in warc.salvage(data) if kind == "gap"]
            assert gaps and gaps[0][0] == start and covered(data) == len(data)
    assert ids(whole[:-3]) == [f"<urn:page:{i}>" for i in range(11)]
    assert list(warc.salvage(b"")) == []


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_within_a_member(level):
    parts = archive(False)
    ids = lambda found: [int(h["warc-record-id"][10:-1]) for kind, _, _, h, _ in found if kind == "record"]
    outer = lambda found: sum({s: n for kind, s, n, *_ in found if kind != "inner gap"}.values())
    pack = lambda raw: (lambda c: c.compress(raw) + c.flush())(zlib.compressobj(level, wbits=31))
    start = sum(map(len, parts[:5]))
    hurt = bytearray(b"".join(parts))
    hurt[start + len(parts[5]) - 50] ^= 0x55
    before, after = archive(True, 1)[0], archive(True, 2)[1]
    for data, lead in ((pack(bytes(hurt)), 0), (before + pack(bytes(hurt)) + after, len(before))):  # a record is wrong, its member's check right
        found = list(warc.salvage(data))
        assert ids(found) == [0] * (lead > 0) + [i for i in range(12) if i != 5] + [1] * (lead > 0)
        assert [(s, n, m) for kind, s, n, _, m in found if kind == "inner gap"] == [(start, len(parts[5]), lead)]
        assert outer(found) == len(data)
    whole = pack(b"".join(parts))
    for stop in (len(whole) // 2, len(whole) - 3):  # cut
        found, out = list(warc.salvage(whole[:stop])), len(zlib.decompressobj(wbits=31).decompress(whole[:stop]))
        assert ids(found) == [i for i in range(12) if sum(map(len, parts[: i + 1])) <= out] and ids(found)
        assert outer(found) == stop
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0x55
    found = list(warc.salvage(bytes(flipped) + after))  # the member fails its check
    assert set(range(3)) <= set(ids(found)[:-1]) and ids(found)[-1] == 1 and outer(found) == len(flipped) + len(after)
    assert level or len(ids(found)) == 12  # stored bytes: all but the record that is hit


def test_members_are_read_in_pieces(monkeypatch):
    """Members that are not held, whole and damaged, give the same entries."""
    parts = archive(False, 40)
    hurt = b"".join([*parts[:7], parts[7][:-50] + b"?" + parts[7][-49:], *parts[8:], b"trailing junk"])
    whole = gzip.compress(hurt)
    flipped = bytearray(gzip.compress(b"".join(parts), 0))
    flipped[len(flipped) // 2] ^= 0x55
    files = [archive(True, 1)[0] + whole + archive(True, 2)[1], bytes(flipped) + archive(True, 2)[1], whole[: len(whole) // 2], gzip.compress(b"nothing right") + whole]
    held = [list(warc.salvage(f)) for f in files]
    assert [sum(e[0] == "record" for e in found) for found in held[:2]] == [41, 40]
    assert [(e[1], e[2]) for e in held[0] if e[0] == "inner gap"] == [(sum(map(len, parts[:7])), len(parts[7])), (len(hurt) - 13, 13)]
    assert [e[:3] for e in held[3] if e[0] == "gap"] == [("gap", 0, len(gzip.compress(b"nothing right")))]
    monkeypatch.setattr(warc, "HELD", 10)
    for first, most in ((1, 7), (16, 64), (1 << 12, 1 << 16)):
        monkeypatch.setattr(warc, "FIRST", first)
        monkeypatch.setattr(warc, "STEP", most)
        assert [list(warc.salvage(f)) for f in files] == held


def test_reading_grows_with_the_bytes(monkeypatch):
    """What is given to zlib, in bytes, is in proportion to the archive's, however many members follow."""
    given = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def decompress(self, data, *most):
            given.append(len(data))
            return self.inner.decompress(data, *most)

        def copy(self):
            return Counting(self.inner.copy())

        def __getattr__(self, name):
            return getattr(self.inner, name)

    per_byte = []
    for n in (500, 4000):
        data = b"".join(warc.member(warc.record(i, "u", os.urandom(4000), "x", None)) for i in range(n))
        with monkeypatch.context() as m:
            real = zlib.decompressobj
            m.setattr(warc.zlib, "decompressobj", lambda **k: Counting(real(**k)))
            given.clear()
            assert sum(e[0] == "record" for e in warc.salvage(data)) == n
        per_byte.append(sum(given) / len(data))
    assert per_byte[1] < 1.1 * per_byte[0] < 10


def test_one_page_with_several_texts(spark):
    a, b, c = ("<p>" + w * 60 for w in ("one ", "two ", "three "))
    rows = [(1, a), (2, b), (3, a), (3, b), (3, c), (4, c), (4, a)]
    pages = spark.createDataFrame([(i, "u", h, None, None) for i, h in rows], PAGES)
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    first = {a: 1, b: 2, c: 3}
    assert got == sorted((i, hashlib.sha256(h.encode()).hexdigest(), *(("revisit", first[h]) if i != first[h] else ("response", None))) for i, h in rows)


def test_archives_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART", 20_000)
    monkeypatch.setattr(warc, "PARTS", 2)
    pages = spark.createDataFrame([(i, "u", os.urandom(3000).hex(), None, None) for i in range(100)], PAGES).coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert max(sizes) < 2 * (20_000 + 4_000) and len(sizes) > 5
    read = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.record_id for r in read) == sorted(f"<urn:page:{i}>" for i in range(100)) and {r.kind for r in read} == {"record"}


def test_members_end_in_zero_and_are_gzip():
    for content in (b"", b"x", os.urandom(1000), b"y" * (2**24 + 5)):
        made = warc.member(content)
        assert made[-1] == 0 and gzip.decompress(made) == content


def test_read_archives_with_gaps(spark, tmp_path):
    parts = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:3]) + b"garbage" + b"".join(parts[3:6]))
    (tmp_path / "b.warc").write_bytes(b"".join(archive(False)[6:]))
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sum(r.kind == "record" for r in rows) == 12
    assert [(r.size, r.path[-9:]) for r in rows if r.kind == "gap"] == [(7, "a.warc.gz")]
    assert {r.payload[0] for r in rows if r.kind == "record"} == set(range(12))


def test_read_archives_with_inner_gaps(spark, tmp_path):
    parts = archive(False)
    hurt = parts[5][:-50] + b"?" + parts[5][-49:]
    (tmp_path / "a.warc.gz").write_bytes(archive(True, 1)[0] + gzip.compress(b"".join([*parts[1:5], hurt, *parts[6:]])))
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r.payload[0] for r in rows if r.kind == "record") == [i for i in range(12) if i != 5]
    assert [(r.kind, r.start, r.size, r.member) for r in rows if r.kind == "inner gap"] == [("inner gap", sum(map(len, parts[1:5])), len(parts[5]), len(archive(True, 1)[0]))]
