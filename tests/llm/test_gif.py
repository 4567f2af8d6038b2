import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexigraph.llm import gif as G


def compressed(pixels, size, deferred=False):
    """A plain LZW encoder with a growing table; with ``deferred`` it never clears a full one."""
    clear, bits, n = 1 << size, 0, 0

    def put(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width

    def fresh():
        return {(i,): i for i in range(clear)}

    entries, width, following = fresh(), size + 1, clear + 2
    put(clear, width)
    word = ()
    for p in pixels:
        if (*word, p) in entries:
            word = (*word, p)
            continue
        put(entries[word], width)
        if following < 4096:
            entries[(*word, p)] = following
            # The decoder is one entry behind: its table grows a code later.
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        elif not deferred:
            put(clear, width)
            entries, width, following = fresh(), size + 1, clear + 2
        word = (p,)
    if word:
        put(entries[word], width)
        if following == 1 << width and width < 12:
            width += 1
    put(clear + 1, width)
    return bits.to_bytes(-(-n // 8), "little")


@pytest.mark.parametrize("size", [2, 4, 8])
@pytest.mark.parametrize("deferred", [False, True])
def test_lzw_against_plain_encoder(size, deferred):
    rng = random.Random(size)
    for n, alphabet in ((0, 1), (1, 1), (7, 2), (3000, 1), (30_000, 2), (20_000, 1 << size)):
        pixels = [rng.randrange(min(alphabet, 1 << size)) for _ in range(n)]
        assert G.lzw_decode(compressed(pixels, size, deferred), size).tolist() == pixels


def test_streams_equal_the_plain_encoder_and_round_trip():
    rng = np.random.default_rng(1)
    for n, values in ((0, 1), (1, 1), (2, 1), (253, 256), (3000, 256), (5000, 1), (30_000, 3), (30_000, 40), (60_000, 256)):
        pixels = rng.integers(0, values, n).astype(np.uint8)
        stream = G.lzw_encode(pixels.tobytes())
        assert np.array_equal(G.lzw_decode(stream, 8), pixels)
        if len(G.lzw_codes(pixels.tobytes())) < 3800:  # the plain encoder clears a full table one code later
            assert stream == compressed(pixels.tolist(), 8)
    assert max(G.lzw_codes(b"to be or not to be, " * 50)) > 257 << 8  # strings, not literals only


def two_frames(disposal, transparent=None):
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 0, 255)
    gif = G.Gif(2, 2, palette)
    gif.frames = [
        G.Frame(np.full((2, 2), 1, np.uint8), delay=5),
        G.Frame(np.array([[2, 0]], np.uint8), y=1, delay=7, disposal=disposal, transparent=transparent),
        G.Frame(np.array([[1]], np.uint8), delay=1),
    ]
    return [(s, d, c.copy(), m.copy()) for s, d, c, m in G.rendered(G.decode_gif(G.encode_gif(gif)))]


def test_times_transparency_and_disposal():
    shown = two_frames(1, transparent=0)
    assert [(s, d) for s, d, _, _ in shown] == [(0, 50), (50, 70), (120, 10)]
    assert shown[1][2][1].tolist() == [[0, 0, 255], [255, 0, 0]]  # the transparent pixel shows the frame below
    assert two_frames(1)[1][2][1].tolist() == [[0, 0, 255], [0, 0, 0]]
    assert not two_frames(2)[2][3][1].any()  # back to the background
    assert two_frames(3)[2][2][1].tolist() == [[255, 0, 0], [255, 0, 0]]  # back to what was before


def test_local_palette_and_interlace():
    own = np.tile(np.arange(256, dtype=np.uint8)[:, None], (1, 3))
    pixels = np.arange(40, dtype=np.uint8).reshape(10, 4)
    data = bytearray(G.encode_gif(G.Gif(4, 10, None, [G.Frame(pixels, palette=own)])))
    assert next(G.rendered(G.decode_gif(bytes(data))))[2][..., 0].tolist() == pixels.tolist()
    data[13 + 8 + 9] |= 0x40
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    assert [r[0] for r in G.decode_gif(bytes(data)).frames[0].pixels[order].tolist()] == [r[0] for r in pixels.tolist()]


def test_frames_table(spark):
    palette = np.zeros((256, 3), np.uint8)
    palette[1] = 255
    good = G.encode_gif(G.Gif(3, 2, palette, [G.Frame(np.eye(2, 3, dtype=np.uint8), delay=4)] * 2))
    media = spark.createDataFrame([(1, good), (2, None), (3, b"GIF89a"), (None, b"")], "doc_id long, media binary")
    rows = sorted(G.frames(media).collect())
    assert [(r.doc_id, r.frame, r.start_ms, r.delay_ms, r.width, r.height, r.drawn) for r in rows] == [(1, 0, 0, 40, 3, 2, 6), (1, 1, 40, 40, 3, 2, 6)]
    assert rows[0].histogram[0] == 4 and rows[0].histogram[63] == 2 and sum(rows[0].histogram) == 6
    assert G.frames(media.limit(0)).count() == 0


def test_payloads_round_trip(spark):
    rows = [(1, ""), (2, None), (3, "a" * 192), (4, "é" * 97), (None, "x"), (6, "z" * 60_000), (6, "z" * 60_000), (7, "日本 \x00\x7f🙂" * 50)]
    docs = spark.createDataFrame([(i, t, b"other") for i, t in rows], "doc_id long, text string, media binary").repartition(3)
    found = {(r.doc_id, r.n_bytes): r for r in G.features(G.stored(docs)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        r = found[(i, len(raw))]
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
    assert found[(1, 0)].feature == found[(2, 0)].feature
    assert found[(6, 60_000)].feature.startswith("frames=10;ms=1000;size=192x32;")
    assert G.features(G.stored(docs.limit(0))).count() == 0


def test_media_and_feature_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["", "a b " * 20, "".join(rng.choice("ab \n") for _ in range(40_000)), "".join(rng.choice("aé日🙂") for _ in range(9000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = G.stored(docs)
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    timed = {}
    for r in G.frames(media).collect():
        timed.setdefault(r.doc_id, []).append(r)
    for r in G.features(media).collect():
        payload = G.padded(texts[r.doc_id].encode())
        n = -(-len(payload) // (192 * 32))
        bins = Counter()
        for x in payload:  # the colour of a byte, two bits a channel
            red, green, blue = (x >> 5) * 255 // 7, (x >> 2 & 7) * 255 // 7, (x & 3) * 85
            bins[(red >> 6) << 4 | (green >> 6) << 2 | blue >> 6] += 1
        shown = ",".join(f"{k}:{v}" for k, v in sorted(bins.items()))
        assert r.feature == f"frames={n};ms={100 * n};size=192x{min(32, len(payload) // 192)};colours={shown}"
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
        found = sorted(timed[r.doc_id], key=lambda f: f.frame)
        assert [f.start_ms for f in found] == [100 * i for i in range(n)] and [f.disposal for f in found] == [(1, 3, 2, 0)[i % 4] for i in range(n)]
        assert [f.transparent is not None for f in found][:4] == [False, True, True, False][:n]
    assert len(files[1]) < 2000 and len(files[2]) < 20_000  # 781 bytes are the header and the palette


def test_payload_of_all_values_and_streams_cut_short():
    rng = np.random.default_rng(3)
    payload = np.concatenate([rng.permutation(256) for _ in range(192)]).astype(np.uint8).tobytes()
    assert G.read_payload(G.decode_gif(G.payload_gif(payload)))[0] == payload
    data = G.payload_gif(G.padded(b"word " * 500))
    for cut in (len(data) - 3, len(data) // 2, 800, 20):
        with pytest.raises(ValueError):
            G.decode_gif(data[:cut])
    short = G.Gif(4, 4, G.PAYLOAD_PALETTE, [G.Frame(np.zeros((4, 4), np.uint8))])
    data = bytearray(G.encode_gif(short))
    data[13 + 768 + 8 + 5] = 200  # a frame that says to be wider than its stream
    with pytest.raises(ValueError):
        G.decode_gif(bytes(data))
