"""Kernels against known answers and round trips; headers, containers and whole images as tables."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rippleframe.kernels import bitio, boxes, codec, lanes, markers, mq, pnm, structure, tagtree, tier1, tier2, wavelet
from rippleframe.kernels.codec import Options
from rippleframe.operators import images
from rippleframe.plans import codec_queries

RNG = random.Random(3)


# --- bits -------------------------------------------------------------------------------------


@pytest.mark.parametrize("data, skip, n, want", [("80", 0, 1, 1), ("F0", 0, 4, 15), ("ABC0", 0, 12, 0xABC), ("12345678", 0, 32, 0x12345678), ("ABCDEF", 4, 8, 0xBC), ("123456", 4, 16, 0x2345), ("1234567890", 4, 32, 0x23456789)])
def test_bits_are_read(data, skip, n, want):
    r = bitio.BitReader(bytes.fromhex(data))
    r.bits(skip)
    assert r.bits(n) == want


def test_reading_stops():
    with pytest.raises(ValueError):
        bitio.BitReader(b"\0" * 9).bits(33)
    with pytest.raises(ValueError):
        bitio.BitReader(b"\0" * 9).bits(-1)
    with pytest.raises(bitio.OutOfBits):
        bitio.BitReader(b"\1").bits(9)
    r = bitio.BitReader(b"\xff\x90")
    assert r.bits(8) == 255
    with pytest.raises(bitio.OutOfBits):
        r.bit()
    assert r.marker and r.at == 0


def test_writing_stuffs():
    w = bitio.BitWriter()
    w.bits(0xFFF, 12)
    out = w.flush()
    assert out[0] == 255 and out[1] < 128
    w = bitio.BitWriter()
    w.bits(0b101, 3)
    assert w.flush() == b"\xa0" and bitio.stuffed_bits(b"\xff\xff\xff") == 2


def test_bits_round_trip():
    for _ in range(300):
        bits = [int(RNG.random() < 0.9) for _ in range(RNG.randint(0, 60))]
        w = bitio.BitWriter()
        for b in bits:
            w.bit(b)
        data = w.flush()
        r = bitio.BitReader(data + b"\x12\x34")
        assert [r.bit() for _ in bits] == bits and r.align() == len(data)


# --- coder ------------------------------------------------------------------------------------


def test_coder_gives_the_standards_sequence():
    """The test sequence of the standards that define the coder: one context in state 0."""
    source = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")
    coded = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADF")
    e = mq.Encoder([0] * mq.CONTEXTS)
    for b in source:
        for i in range(7, -1, -1):
            e.code(b >> i & 1, 0)
    assert e.finish() == coded
    d = mq.Decoder(coded, [0] * mq.CONTEXTS)
    assert bytes(sum(d.code(0, 0) << i for i in range(7, -1, -1)) for _ in source) == source


def test_coder_contexts():
    state = mq.contexts()
    assert [s >> 1 for s in (state[0], state[1], state[mq.RUN], state[mq.UNIFORM])] == [4, 0, 3, 46]
    assert mq.Decoder(b"\x12").code(0, 99) == 0 and mq.Decoder(b"").code(0, 0) in (0, 1)


def test_tag_trees():
    for _ in range(100):
        w, h = RNG.randint(1, 7), RNG.randint(1, 7)
        values = [RNG.randint(0, 9) for _ in range(w * h)]
        one, bits = tagtree.TagTree(w, h).fill(values), bitio.BitWriter()
        asked = [(RNG.randrange(w), RNG.randrange(h), RNG.randint(1, 11)) for _ in range(40)]
        told = [one.code(x, y, t, bits.bit) for x, y, t in asked]
        assert told == [values[y * w + x] < t for x, y, t in asked]
        r, two = bitio.BitReader(bits.flush()), tagtree.TagTree(w, h)
        assert [two.code(x, y, t, lambda _: r.bit()) for x, y, t in asked] == told  # noqa: B023
        assert one.value[-1] == [min(values)]


# --- blocks -----------------------------------------------------------------------------------


def test_contexts():
    zero = lambda band, h, v, d: tier1.zero_contexts(band)[15 * h + 5 * v + d]
    assert [zero(tier1.HL, *n) for n in ((0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 1, 0), (0, 2, 0))] == [0, 3, 4, 5, 8]
    assert zero(tier1.HL, 0, 1, 1) == 6 and zero(tier1.HL, 1, 1, 0) == 7 and zero(tier1.HH, 0, 0, 1) == 3
    assert [tier1.sign_context(h, v) for h, v in ((0, 0), (1, 0), (-1, 0), (2, -1), (-2, 1))] == [(9, 0), (12, 0), (12, 1), (11, 0), (11, 1)]


def test_new_coefficients_stand_in_the_middle():
    for plane, want in ((5, 96), (3, 24)):
        c = tier1.encode([1 << plane], 1, 1, tier1.LL)
        assert tier1.decode([(1, c.data)], c.planes, 1, 1, tier1.LL) == [want]


def test_planes_and_passes():
    empty = tier1.encode([0] * 16, 4, 4, tier1.LL)
    assert (empty.planes, empty.ends, empty.data) == (0, [], b"")
    one = tier1.encode([0, 0, 5, 0], 2, 2, tier1.LL)
    assert one.planes == 3 and len(one.ends) == 7 and [tier1.pass_kind(i) for i in range(4)] == [2, 0, 1, 2]
    assert tier1.segments(0, 17, tier1.BYPASS) == [10, 2, 1, 2, 1, 1] and tier1.segments(3, 2, tier1.TERMINATE) == [1, 1]


@pytest.mark.parametrize("style", range(64))
def test_blocks_round_trip(style):
    rng = random.Random(style)
    for _ in range(4):
        w, h, most = rng.randint(1, 12), rng.randint(1, 12), rng.choice([1, 5, 200, 40000])
        values = [rng.randint(-most, most) if rng.random() < 0.6 else 0 for _ in range(w * h)]
        band = rng.randrange(4)
        c = tier1.encode(values, w, h, band, style)
        words, at, start = [], 0, 0
        for n in tier1.segments(0, len(c.ends), style):
            at += n
            words.append((n, c.data[start : c.ends[at - 1]]))
            start = c.ends[at - 1]
        assert tier1.decode(words, c.planes, w, h, band, style) == [(2 * abs(v) + 1) * (1 if v > 0 else -1) if v else 0 for v in values]
        if not style & (tier1.BYPASS | tier1.TERMINATE):
            for n in range(1, len(c.ends) + 1):  # the bytes by a pass are enough for it
                assert tier1.decode([(n, c.data[: c.ends[n - 1]])], c.planes, w, h, band, style) == tier1.decode([(n, c.data)], c.planes, w, h, band, style)


def test_pass_counts():
    for n in range(1, 165):
        w = bitio.BitWriter()
        tier2.write_passes(w, n)
        assert tier2.read_passes(bitio.BitReader(w.flush() + b"\0")) == n


# --- wavelets and steps -----------------------------------------------------------------------


@pytest.mark.parametrize("kind", [0, 1])
def test_lifting_any_length_and_origin(kind):
    rng = np.random.default_rng(1)
    for n in range(1, 12):
        for origin in range(4):
            x = rng.integers(-99, 99, (3, n)) if kind else rng.normal(size=(3, n))
            assert np.allclose(wavelet.synthesise(wavelet.analyse(x, origin, kind), origin, kind), x, atol=1e-9)


@pytest.mark.parametrize("shape, levels", [((8, 8), 1), ((16, 16), 3), ((7, 9), 2), ((12, 8), 3), ((5, 7), 2)])
def test_lifting_in_two_dimensions(shape, levels):
    y, x = np.mgrid[: shape[0], : shape[1]]
    image = y * shape[1] + x
    bounds = [(0, 0, -(-shape[1] >> k), -(-shape[0] >> k)) for k in range(levels, -1, -1)]
    bounds = [(0, 0, -(-shape[1] // (1 << k)), -(-shape[0] // (1 << k))) for k in range(levels, -1, -1)]
    assert (wavelet.synthesise2d(wavelet.analyse2d(image, 0, 0, levels, 1), bounds, 1) == image).all()
    assert np.abs(wavelet.synthesise2d(wavelet.analyse2d(image, 0, 0, levels, 0), bounds, 0) - image).max() < 1e-3


def test_steps():
    for step in (0.5, 1.0, 1.5, 3.7, 16.0):
        assert abs(codec.step_size(*codec.exponent_mantissa(step, 8), 8) / step - 1) < 1e-3
    assert codec.step_size(10, 1024, 8) == 0.375
    assert (codec.quantise(np.array([-7.0, -1.9, 0, 3.9, 4.0]), 2.0) == [-3, 0, 0, 1, 2]).all()
    assert markers.Quant(1, 2, [(10, 5)]).step(0) == (10, 5) and markers.Quant(1, 2, [(10, 5)]).step(7) == (8, 5)


def test_bands_of_sixteen():
    h = codec._header([np.zeros((16, 16), int)], Options(levels=2))
    res = structure.component(h, 0, 0)
    bands = [b for r in res for b in r.bands]
    assert (bands[0].x1, bands[0].y1) == (4, 4) and sum((b.x1 - b.x0) * (b.y1 - b.y0) for b in bands) == 256


def test_allocation():
    three = [tier1.Coded(1, [10, 30, 60], [100.0, 150.0, 175.0], b"\0" * 60)]
    pairs = [(c, 1.0) for c in three]
    assert codec.allocate(pairs, [1000]) == [[3]] and codec.allocate(pairs, [0]) == [[0]] and codec.allocate(pairs, [30]) == [[2]]
    assert [n for _, n in codec.hull([10, 30, 60], [100.0, 110.0, 175.0])] == [1, 3]


# --- headers ----------------------------------------------------------------------------------


def siz(width, height, comps=1):
    return markers.segment(markers.SIZ, struct.pack(">H8IH", 0, width, height, 0, 0, width, height, 0, 0, comps) + bytes([7, 1, 1]) * comps)


def cod(order=0):
    return markers.segment(markers.COD, bytes([0, order, 0, 1, 0, 5, 2, 2, 0, 1]))


def header(qcd, order=0, comps=1, size=256):
    return b"\xff\x4f" + siz(size, size, comps) + cod(order) + markers.segment(markers.QCD, qcd)


MINIMAL = header(bytes([0]) + bytes([8 << 3]) * 16)


def test_minimal_header():
    h = markers.parse(MINIMAL + b"\xff\xd9")
    assert (h.width, h.height, len(h.comps), h.comps[0].depth) == (256, 256, 1, 8) and h.parts == []
    c = h.main.cod
    assert (c.levels, 1 << c.block_w, 1 << c.block_h, c.wavelet, h.main.order, h.main.layers) == (5, 16, 16, 1, 0, 1)
    assert (h.main.qcd.kind, h.main.qcd.guard, h.main.qcd.steps) == (0, 0, [(8, 0)] * 16)


def test_quantisation_headers():
    derived = markers.parse(header(bytes([1 | 2 << 5]) + struct.pack(">H", 10 << 11 | 1024)))
    assert derived.main.qcd.steps == [(10, 1024)] and derived.main.qcd.guard == 2
    told = markers.parse(header(bytes([2]) + struct.pack(">2H", 11 << 11 | 512, 10 << 11 | 256), comps=3, size=512))
    assert told.main.qcd.steps == [(11, 512), (10, 256)] and [k.depth for k in told.comps] == [8, 8, 8] and told.width == 512


@pytest.mark.parametrize("data", [header(b"\0\x40", order=99), b"\0\0" + MINIMAL[2:], MINIMAL[:30], b"", b"\xff\x4f"])
def test_broken_headers(data):
    with pytest.raises(markers.BadStream):
        markers.parse(data)


def test_tile_part_and_missing_end():
    part = struct.pack(">HHHIBB", markers.SOT, 10, 0, 100, 0, 1) + struct.pack(">H", markers.SOD) + bytes(86)
    h = markers.parse(MINIMAL + part)
    assert [(p.tile, p.length, p.part, len(p.data)) for p in h.parts] == [(0, 100, 0, 86)]
    whole = struct.pack(">HHHIBB", markers.SOT, 10, 0, 0, 0, 1) + struct.pack(">H", markers.SOD) + bytes(50)  # up to the end
    assert len(markers.parse(MINIMAL + whole + b"\xff\xd9").parts[0].data) == 50


@pytest.mark.parametrize("form, body, want", [
    (0x60, struct.pack(">HIHI", 0, 1000, 1, 2000), [(0, 1000), (1, 2000)]), (0x10, struct.pack(">BHBHBH", 0, 10, 1, 20, 2, 30), [(0, 10), (1, 20), (2, 30)]),
    (0x00, struct.pack(">2H", 7, 9), [(0, 7), (1, 9)]), (0x30, b"\0" * 8, []),
])
def test_tile_lengths(form, body, want):
    h = markers.parse(MINIMAL + markers.segment(markers.TLM, bytes([0, form]) + body))
    assert h.tlm == want


def test_overrides_and_packed_headers():
    extra = markers.segment(markers.COC, bytes([1, 0, 3, 2, 2, 0, 1])) + markers.segment(markers.QCC, bytes([1, 0x40]) + b"\x38" * 10)
    extra += markers.segment(markers.RGN, bytes([0, 0, 5])) + markers.segment(markers.POC, bytes([0, 0, 0, 1, 2, 1, 0]) * 2)
    extra += markers.segment(markers.PPM, b"\1" + b"c") + markers.segment(markers.PPM, b"\0" + struct.pack(">I", 2) + b"ab" + struct.pack(">I", 1))
    part = lambda t: struct.pack(">HHHIBB", markers.SOT, 10, t, 14, 0, 1) + struct.pack(">H", markers.SOD)
    own = struct.pack(">HHHIBB", markers.SOT, 10, 1, 14 + 12, 0, 1) + markers.segment(markers.QCD, b"\x20" + b"\x48" * 7) + struct.pack(">H", markers.SOD)
    data = b"\xff\x4f" + markers.segment(markers.SIZ, struct.pack(">H8IH", 0, 20, 10, 0, 0, 10, 10, 0, 0, 2) + bytes([7, 1, 1] * 2)) + cod() + markers.segment(markers.QCD, b"\0" + b"\x40" * 16) + extra + part(0) + own
    h = markers.parse(data)
    assert h.style_of(0, 1).levels == 3 and h.style_of(0, 0).levels == 5 and h.roi_of(1, 0) == 5 and len(h.main.poc) == 2
    assert [h.quant_of(0, c).steps[0] for c in (0, 1)] == [(8, 0), (7, 0)] and h.quant_of(1, 1).steps[0] == (9, 0)
    assert [p.packed for p in h.parts] == [b"ab", b"c"]
    assert markers.parse(markers.only_tile(data, h, 1)).parts[0].packed == b"c"


def test_boxes():
    h = markers.parse(MINIMAL)
    whole = boxes.wrap(MINIMAL, h)
    meta, stream = boxes.unwrap(whole)
    assert stream == MINIMAL and meta.image[:5] == (256, 256, 1, 8, False) and meta.is_gray()
    assert [k for _, k, _, _ in boxes.walk(whole)] == ["jP  ", "ftyp", "jp2h", "jp2c"] and boxes.sniff(whole) == "jp2" and boxes.sniff(MINIMAL) == "j2c"
    assert boxes.unwrap(b"\0" * 20) == (None, None) and boxes.unwrap(b"ab") == (None, None)
    long = struct.pack(">I4sQ", 1, b"xml ", 18) + b"hi" + struct.pack(">I4s", 0, b"jp2c") + b"tail"
    assert boxes.walk(long) == [(0, "xml ", 16, 18), (18, "jp2c", 8, 12)] and boxes.unwrap(boxes.MAGIC + long)[0].xml == [b"hi"]
    res = boxes.box("res ", boxes.box("resc", struct.pack(">4H2b", 300, 1, 150, 1, 2, 0)) + boxes.box("resd", struct.pack(">4H2b", 1, 0, 1, 1, 0, 0)))
    meta, _ = boxes.unwrap(boxes.wrap(MINIMAL, h, res))
    assert meta.capture == (30000.0, 150.0) and meta.display is None


# --- images -----------------------------------------------------------------------------------


def grid(n, f):
    y, x = np.mgrid[:n, :n]
    return f(x, y) % 256


PRIMES = [lambda x, y: 7 * x + 3 * y, lambda x, y: 11 * x + 5 * y, lambda x, y: 13 * x + 17 * y]


@pytest.mark.parametrize("planes", [[grid(32, lambda x, y: 17 * x + 31 * y)], [grid(32, f) for f in PRIMES], [grid(16, lambda x, y: x * y)]])
@pytest.mark.parametrize("container", [False, True])
def test_lossless(planes, container):
    image = codec.decode(codec.encode(planes, Options(levels=2, container=container)))
    assert not image.problems and all((a == b).all() for a, b in zip(planes, image.planes, strict=True))


@pytest.mark.parametrize("shape", [(1, 1), (2, 2), (3, 3), (4, 4), (8, 1), (1, 8)])
def test_tiny(shape):
    plane = np.full(shape, 128)
    assert (codec.decode(codec.encode([plane], Options(levels=1))).planes[0] == plane).all()


def test_many_ways():
    rng = np.random.default_rng(2)
    for trial in range(40):
        k = random.Random(trial)
        w, h, depth, n = k.randint(1, 40), k.randint(1, 40), k.choice([8, 12, 4]), k.choice([1, 3, 4])
        planes = [rng.integers(0, 1 << depth, (h, w)) // 3 for _ in range(n)]
        o = Options(layers=k.choice([1, 3]), levels=k.randint(0, 5), block=k.choice([(4, 4), (16, 8), (64, 64)]), order=k.choice(markers.ORDERS), tile=k.choice([None, (17, 13)]), flags=k.choice([0, 1, 2, 4, 8, 32, 63]),
                    sop=k.random() < 0.5, eph=k.random() < 0.5, depth=depth, origin=k.choice([(0, 0), (3, 5)]), precincts=k.choice([[], [(3, 3), (4, 4)]]), roi=k.choice([{}, {0: 3}]))
        image = codec.decode(codec.encode(planes, o))
        assert not image.problems and all(a.shape == b.shape and (a == b).all() for a, b in zip(planes, image.planes, strict=True)), o


def quality(a, b):
    return 10 * np.log10(65025 / max(1e-9, float(np.mean([(x - y) ** 2 for x, y in zip(a, b, strict=True)]))))


def test_lossy():
    planes = [grid(64, f) for f in PRIMES]
    assert quality(planes, codec.decode(codec.encode(planes, Options(lossless=False, quality=0.9, levels=2))).planes) >= 20
    ramp = [grid(64, f) for f in (lambda x, y: 4 * x, lambda x, y: 4 * y, lambda x, y: 2 * (x + y))]
    sizes, steps = [], []
    for target in (200, 500, None):
        data = codec.encode(ramp, Options(lossless=False, quality=0.9, levels=3, target_bytes=target))
        sizes.append(len(data))
        steps.append(quality(ramp, codec.decode(data).planes))
    assert sizes == sorted(sizes) and steps == sorted(steps) and steps[0] > 25


def test_layers_and_reduction():
    planes = [grid(64, lambda x, y: x * y // 7)]
    data = codec.encode(planes, Options(lossless=True, levels=3, layers=3, block=(16, 16)))
    got = [quality(planes, codec.decode(data, max_layers=n).planes) for n in (1, 2, 3)]
    assert got == sorted(got) and got[-1] > 100 and got[0] < 60
    assert [codec.decode(data, reduce=r).planes[0].shape for r in (0, 1, 3, 9)] == [(64, 64), (32, 32), (8, 8), (8, 8)]


def test_progression_changes():
    planes = [grid(32, f) for f in PRIMES]
    h = codec._header(planes, Options(levels=2, layers=2))
    h.main.poc = [markers.Progression(0, 0, 1, 2, 3, 0), markers.Progression(0, 0, 2, 3, 3, 2)]
    data = markers.write(h, [codec.encode_tile(h, 0, planes, Options(levels=2, layers=2), None)])
    image = codec.decode(data)
    assert not image.problems and all((a == b).all() for a, b in zip(planes, image.planes, strict=True))


def test_sampled_components_and_showing():
    planes = [grid(16, PRIMES[0]), grid(8, PRIMES[1]), grid(8, PRIMES[2])]
    image = codec.decode(codec.encode(planes, Options(levels=1, sampling=[(1, 1), (2, 2), (2, 2)])))
    assert all((a == b).all() for a, b in zip(planes, image.planes, strict=True))
    out = codec.shown(image)
    assert out.shape == (16, 16, 4) and (out[..., 1] == np.repeat(np.repeat(planes[1], 2, 0), 2, 1)).all() and (out[..., 3] == 255).all()
    deep = codec.shown(codec.decode(codec.encode([np.array([[0, 1023, 512]])], Options(levels=0, depth=10))))
    assert deep[0, :, 0].tolist() == [0, 255, 128]
    signed = codec.shown(codec.decode(codec.encode([np.array([[-128, 0, 127]])], Options(levels=0, signed=True))))
    assert signed[0, :, 0].tolist() == [0, 128, 255]


def test_palette_and_channels():
    index = grid(8, lambda x, y: (x + y) % 3)
    stream = codec.encode([index], Options(levels=1))
    palette = boxes.box("pclr", struct.pack(">HB", 3, 3) + bytes([7, 7, 7]) + bytes([10, 20, 30, 40, 50, 60, 70, 80, 90]))
    mapping = boxes.box("cmap", b"".join(struct.pack(">HBB", 0, 1, c) for c in range(3)))
    order = boxes.box("cdef", struct.pack(">H", 3) + struct.pack(">9H", 0, 0, 3, 1, 0, 2, 2, 0, 1))
    image = codec.decode(boxes.wrap(stream, markers.parse(stream), palette + mapping + order))
    assert image.meta.palette[1] == [40, 50, 60] and image.meta.needs_reorder()
    assert codec.shown(image)[0, 1].tolist() == [60, 50, 40, 255]
    cut = boxes.box("pclr", struct.pack(">HB", 3, 1) + bytes([7]) + bytes([10, 20]))
    assert codec.decode(boxes.wrap(stream, markers.parse(stream), cut)).meta.palette is None


def test_broken_data_keep_what_is_there():
    planes = [grid(64, lambda x, y: x * 3 + y)]
    data = codec.encode(planes, Options(levels=3, block=(8, 8), layers=2))
    image = codec.decode(data[: len(data) * 2 // 3])
    assert image.problems and image.planes[0].shape == (64, 64)
    rng = random.Random(4)
    for _ in range(20):
        broken = bytearray(data)
        for _ in range(5):
            broken[rng.randrange(100, len(data))] = rng.randrange(256)
        try:
            codec.decode(bytes(broken))
        except ValueError:
            pass


def test_configuration():
    data = codec.encode([np.zeros((48, 64), int)] * 3, Options(levels=1))
    assert {k: codec.config(data)[k] for k in ("width", "height", "comps", "model")} == {"width": 64, "height": 48, "comps": 3, "model": "rgba"}
    assert codec.config(codec.encode([np.zeros((48, 64), int)], Options(levels=1, container=True)))["model"] == "gray"


def test_maps():
    planes = [grid(5, f) for f in PRIMES]
    assert all((a == b).all() for a, b in zip(planes, pnm.read(pnm.write(planes))[0], strict=True))
    assert pnm.read(b"P2\n# note\n2 1\n300\n5 299")[0][0].tolist() == [[5, 299]] and pnm.read(pnm.write([planes[0] * 200], 65535))[1] == 65535
    with pytest.raises(ValueError):
        pnm.read(b"P5 4 4 255 ab")


# --- tables -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def files(spark):
    made = [("a", codec.encode([grid(20, f) for f in PRIMES], Options(levels=2, tile=(8, 8)))), ("b", codec.encode([grid(9, PRIMES[0])], Options(levels=1, container=True))), ("bad", b"not an image"), ("cut", MINIMAL[:40]), ("none", None)]
    return spark.createDataFrame(made, "image_id string, content binary")


def test_headers_as_rows(files):
    got = {r.image_id: r for r in images.headers(files).collect()}
    assert (got["a"].tiles_x, got["a"].tiles_y, len(got["a"].components), len(got["a"].tile_parts), got["a"].wavelet) == (3, 3, 3, 9, "5/3")
    assert got["b"].container == "jp2" and got["b"].problem is None and all(got[k].problem for k in ("bad", "cut", "none"))
    kinds = [r.name for r in images.segments(files).where("image_id = 'b'").orderBy("ord").collect()]
    assert kinds == ["SOC", "SIZ", "COD", "QCD", "SOT", "SOD", "EOC"]
    found = [(r.parent, r.kind) for r in images.box_rows(files).orderBy("ord").collect()]
    assert found == [(None, "jP  "), (None, "ftyp"), (None, "jp2h"), ("jp2h", "ihdr"), ("jp2h", "colr"), (None, "jp2c")]


def test_planes_as_rows(files):
    rows = images.planes(files)
    assert {r.image_id for r in rows.where("problem is not null").collect()} == {"bad", "cut", "none"}
    got = {(r.comp, r.y, r.x): r.v for r in images.samples(rows).where("image_id = 'a'").collect()}
    assert got == {(c, y, x): int(grid(20, f)[y, x]) for c, f in enumerate(PRIMES) for y in range(20) for x in range(20)}
    assert {r.image_id: (r.width, r.height) for r in images.shown(files).where("rgba is not null").collect()} == {"a": (20, 20), "b": (9, 9)}


def test_the_data_source(spark, files, tmp_path):
    from rippleframe.sources import wavelet as source

    source.register(spark)
    good = files.where("image_id in ('a', 'b')").withColumn("image_id", F.concat("image_id", F.lit(".j2k")))
    good.write.format("wavelet").mode("append").save(str(tmp_path / "out"))
    read = lambda **o: spark.read.format("wavelet").options(**o).load(str(tmp_path / "out"))
    assert {r.image_id: (r.width, r.comps, r.model) for r in read(kind="config").collect()} == {"a.j2k": (20, 3, "rgba"), "b.j2k": (9, 1, "gray")}
    rows = read()
    assert rows.count() == 3 * 400 + 81 and rows.where("image_id = 'a.j2k' and comp = 2 and x = 3 and y = 4").first().v == 13 * 3 + 17 * 4
    assert read(reduce="1").where("image_id = 'b.j2k'").count() == 25
    assert read(bytes="1").where("image_id = 'b.j2k' and comp = 0").count() == 81
    assert {r.image_id.rsplit("/", 1)[-1] for r in images.headers(images.read_files(spark, str(tmp_path / "out"))).collect()} == {"a.j2k", "b.j2k"}


def test_files_that_arrive(spark, files, tmp_path):
    from rippleframe import streaming

    (tmp_path / "in").mkdir()
    for r in files.where("content is not null").collect():
        (tmp_path / "in" / f"{r.image_id}.j2k").write_bytes(r.content)
    q = streaming.headers(spark, str(tmp_path / "in")).select("image_id", "width", "problem").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.width for r in spark.table("arrived").where("problem is null").collect()) == [9, 20]


def test_plans_scan_once(spark):
    """The multi-level transform, the tree and the contexts read their input once."""
    from rippleframe import plans

    for name in ("dwt53_multilevel", "tagtree_rollup", "zero_coding_context", "magnitude_context"):
        plan = plans.every()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == 1, name


def test_prefixes_with_empty_passes(spark):
    from rippleframe.operators import rate

    rows = [(1, 1, 5, 9.0), (1, 2, 0, 0.0), (1, 3, 5, 9.0), (2, 1, 0, 0.0), (3, 1, 9, 1.0), (3, 2, 0, 4.0)]
    t = rate.simple_slopes(spark.createDataFrame(rows, "block int, pass int, bytes int, distortion double"))
    assert {r.block: r.passes for r in rate.prefixes(t, F.lit(1.0)).collect()} == {1: 3, 2: 0, 3: 0}


def test_metrics_of_equal_and_no_samples(spark):
    from rippleframe.operators import metrics

    t = spark.createDataFrame([(1, 1), (5, 5)], "a int, b int")
    assert metrics.psnr(t, "a", "b").first().psnr == float("inf") and metrics.psnr(t.limit(0), "a", "b").first().psnr is None
    assert metrics.conformance(t.limit(0), "a", "b").first().n == 0


def test_many_bits_at_once():
    """write() and read() give what code() gives bit by bit, in parts, from any state, past carries and bytes of ones."""
    rng = random.Random(44)
    for share in (0.0, 0.02, 0.5, 0.97, 1.0):
        bits = bytes(int(rng.random() < share) for _ in range(4000))
        contexts = [rng.randrange(mq.CONTEXTS) if share != 1.0 else 0 for _ in bits]
        one, many, raw, raws = mq.Encoder(), mq.Encoder(), mq.RawEncoder(), mq.RawEncoder()
        for b, c in zip(bits, contexts, strict=True):
            one.code(b, c)
            raw.code(b, 0)
        for lo, hi in ((0, 0), (0, 1), (1, 1203), (1203, 4000)):
            many.write(bits[lo:hi], contexts[lo:hi])
            raws.write(bits[lo:hi])
        assert one.state == many.state
        coded, plain = one.finish(), raw.finish()
        assert (many.finish(), raws.finish()) == (coded, plain)
        back, kept = mq.Decoder(coded), mq.RawDecoder(plain)
        assert back.read(contexts[:77]) + back.read([]) + back.read(contexts[77:]) == bits
        assert kept.read(3) + kept.read(0) + kept.read(3997) == bits
        # Wrong bytes, and the end of the data, too.
        other = mq.Decoder(bytes(rng.choice((0, 255, 90)) for _ in range(60))), mq.Decoder(b"")
        for d in other:
            alike = mq.Decoder(d.data[:-2])
            assert d.read(contexts) == bytes(alike.code(0, c) for c in contexts)


def _odd_words(rng: random.Random) -> list[bytes]:
    words = [rng.randbytes(rng.randrange(700)) for _ in range(150)] + [bytes(rng.choice((0, 255)) for _ in range(rng.randrange(700))) for _ in range(150)]
    words += [bytes([b]) * rng.randrange(900) for b in (0, 255, 170) for _ in range(20)] + [b"", b"a", b"ab", b"abc", "Ünïcode €".encode() * 60, rng.randbytes(2500)]
    rng.shuffle(words)
    return words


@pytest.mark.parametrize("most, alone", [(1, 135e-9), (7, 0.0), (64, 1.0), (64, 135e-9), (4096, 135e-9), (4096, 1.0)])
def test_words_in_lanes(monkeypatch, most, alone):
    """The codewords and words that mq gives, whichever lanes they are in and wherever they leave them."""
    monkeypatch.setattr(lanes, "MOST", most)
    monkeypatch.setattr(lanes, "_ALONE", alone)
    words = _odd_words(random.Random(most))
    for contexts in ([i + k for k in range(3) for i in range(8)], [mq.UNIFORM, 0, 3, 3, 3, 17, 18, 0]):
        want = []
        for w in words:
            e, bits = mq.Encoder(), [b >> i & 1 for b in w for i in range(7, -1, -1)]
            e.write(bytes(bits), (contexts * (len(w) + 1))[: len(bits)])
            want.append(e.finish())
        assert lanes.encode(words, contexts) == want
        assert lanes.decode(want, [len(w) for w in words], contexts) == words
    assert lanes.encode([], contexts) == lanes.decode([], [], contexts) == []


def test_words_without_room(monkeypatch):
    """A word whose code outgrows its room is coded by itself, and no other word is touched."""
    rng = random.Random(12)
    words = [rng.randbytes(1500) if n % 3 == 0 else bytes(1500) for n in range(60)]
    contexts = [i + k for k in range(3) for i in range(8)]
    want = lanes.encode(words, contexts)
    monkeypatch.setattr(lanes, "_ALONE", 1.0)
    monkeypatch.setattr(lanes, "MOST", 16)
    whole, real = [], lanes._Encoders.alone
    monkeypatch.setattr(lanes._Encoders, "alone", lambda self, word, e=None, done=0: (whole.append(word) if e is None else None, real(self, word, e, done))[1])
    monkeypatch.setattr(lanes, "_ROOM", 0.8)
    assert lanes.encode(words, contexts) == want and {0, 3, 57} <= set(whole) and 1 not in whole
    assert lanes.decode(want, [len(w) for w in words], contexts) == words


def test_texts_are_coded_together(monkeypatch):
    """Few bits of many texts go one by one, and bits that come back otherwise are told by text."""
    rng, alone = random.Random(6), [0]
    texts = [bytes(rng.choice(b"etaoin shrdlu") for _ in range(rng.randrange(400, 900))) for _ in range(600)]
    for kind in ("Encoder", "Decoder"):
        name = {"Encoder": "write", "Decoder": "read"}[kind]

        def counted(self, *args, real=getattr(getattr(mq, kind), name)):
            alone[0] += len(args[0])
            return real(self, *args)

        monkeypatch.setattr(getattr(mq, kind), name, counted)
    assert codec_queries.coder_mismatches(texts) == [0] * len(texts)
    assert alone[0] < 0.2 * 16 * sum(map(len, texts))
    real = lanes.decode
    monkeypatch.setattr(lanes, "decode", lambda *a: [w[:-1] + bytes([w[-1] ^ 5]) if n == 3 else w for n, w in enumerate(real(*a))])
    assert codec_queries.coder_mismatches(texts[:5]) == [0, 0, 0, 2, 0]


def test_parts_of_rows(monkeypatch):
    """Rows in parts, across batches, each row once and in order."""
    monkeypatch.setattr(codec_queries, "TOGETHER", 100)
    words = [b"x" * n for n in (0, 30, 99, 1, 250, 0, 100, 20, 0, 79, 5)]
    table = pa.table({"doc_id": pa.array(range(len(words))), "raw": pa.array(words, pa.binary())})
    for size in (1, 3, 4, 20):
        got = list(codec_queries._coded(iter(table.to_batches(size))))
        assert [r for b in got for r in b.column(0).to_pylist()] == list(range(len(words)))
        assert all(b.num_rows == len(b.column(1)) and not any(b.column(1).to_pylist()) for b in got)
        assert len(got) == 4
    assert list(codec_queries._coded(iter([]))) == []


def test_raw_bits_in_long_parts():
    rng = random.Random(8)
    for share in (0.5, 0.9, 1.0):
        bits = bytes(int(rng.random() < share) for _ in range(20_000))
        one, many = mq.RawEncoder(), mq.RawEncoder()
        for b in bits:
            one.code(b, 0)
        for lo, hi in ((0, 3), (3, 9000), (9000, 20_000)):
            many.write(bits[lo:hi])
        plain = one.finish()
        assert many.finish() == plain
        kept, single = mq.RawDecoder(plain), mq.RawDecoder(plain)
        assert kept.read(11) + kept.read(19_989) == bits == bytes(single.code(0, 0) for _ in bits)
        assert kept.read(99) == bytes(single.code(0, 0) for _ in range(99))  # past the end
