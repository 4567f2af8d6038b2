"""Media columns: GIF files stored in and read from binary columns.

``encode_gif`` writes frames whose pixels are palette indices as LZW code streams with a growing table; bytes of any
kind are stored losslessly as such. ``decode_gif`` reads any GIF: LZW code streams, global and local palettes,
interlacing. ``rendered`` applies frame offsets, transparency and disposal and gives the timed canvases, and a media
column's frames are stored as a column of timed frames with colour histograms (``read``), or a row each (``frames``).

A payload is shown by frames of 192 x 32 pixels, one after the other on one canvas. They go through all kinds of
disposal, and a pixel that the canvas shows already is written as transparent, so the payload is read back from the
rendered canvas only.

The decoder cuts codes out together, as the width of the k-th code after a clear depends on k alone.

Null media and bytes that are no GIF, or whose streams are cut short, have no frames; null texts are empty. Rows that
repeat give equal values, an empty table gives an empty one. Of further columns none is read, whatever its name. Memory
is bounded by a block's texts and files, in bytes, and one canvas of each; a very long text is a block alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.blocks import sliced, texts
from lexigraph.llm.scratch import table

#: Palette of payloads: three bits of red, three of green, two of blue, so that colours give their indices back.
INDEX = np.arange(256)
PAYLOAD_PALETTE = np.stack([(INDEX >> 5) * 255 // 7, (INDEX >> 2 & 7) * 255 // 7, (INDEX & 3) * 85], axis=1).astype(np.uint8)
WIDTH, ROWS, DELAY = 192, 32, 10
#: Kinds of disposal that a payload's frames go through.
DISPOSALS = (1, 3, 2, 0)
BINS = 64


@dataclass
class Frame:
    pixels: np.ndarray  # palette indices, rows x columns
    palette: np.ndarray | None = None
    x: int = 0
    y: int = 0
    delay: int = 0  # hundredths of a second
    disposal: int = 0  # 2: back to the background, 3: back to what was before
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None
    frames: list[Frame] = field(default_factory=list)


# Writing


def lzw_codes(pixels: bytes) -> list[int]:
    """The codes of eight-bit pixels: a clear, the longest known strings, a clear whenever the table is full, the end.

    All codes are kept, and returned, eight bits to the left, so that a string and its next pixel are one number.
    """
    codes, known, following = [256 << 8], {}, 258 << 8
    put, find = codes.append, known.get
    if pixels:
        rest = iter(pixels)
        word = next(rest) << 8
        for p in rest:
            longer = find(word | p)
            if longer:
                word = longer
                continue
            put(word)
            known[word | p] = following
            following += 256
            word = p << 8
            if following == 4096 << 8:
                put(256 << 8)
                known.clear()
                following = 258 << 8
        put(word)
    put(257 << 8)
    return codes


@cache
def _widths(size: int, n: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the first ``n`` codes after a clear, and the bit after each.

    The reader's table has an entry for each code but the first.
    """
    following = (1 << size) + 2 + np.maximum(0, np.arange(n) - 1)
    widths = np.full(n, size + 1)
    for w in range(size + 1, 12):
        widths[following >= 1 << w] = w + 1
    return widths, np.cumsum(widths)


def lzw_encode(pixels: bytes) -> bytes:
    """The code stream of eight-bit pixels, lowest bit first."""
    codes = np.array(lzw_codes(pixels), np.uint32) >> np.uint32(8)
    cuts = [0, *(np.flatnonzero(codes == 256) + 1).tolist(), len(codes)]  # a clear has the width of what is before it
    widths = np.concatenate([_widths(8)[0][: b - a] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    ends = np.cumsum(widths)
    starts = ends - widths
    bits = codes << (starts & 7).astype(np.uint32)
    byte, n = starts >> 3, (int(ends[-1]) + 7) // 8 + 3
    # No two codes share a bit, so sums are unions.
    out = sum(np.bincount(byte + i, (bits >> np.uint32(8 * i)) & 255, n) for i in range(3))
    return out.astype(np.uint8).tobytes()[: (int(ends[-1]) + 7) // 8]


def _blocks(data: bytes) -> bytes:
    """Data blocks of up to 255 bytes, each after its length, and the empty one that ends them."""
    full, rest = divmod(len(data), 255)
    body = np.empty((full, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    tail = bytes([rest]) + data[full * 255 :] if rest else b""
    return body.tobytes() + tail + b"\0"


def encode_gif(gif: Gif) -> bytes:
    parts = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, 0xF7 if gif.palette is not None else 0x70, 0, 0)]
    if gif.palette is not None:
        parts.append(gif.palette.tobytes())
    for f in gif.frames:
        h, w = f.pixels.shape
        flags = f.disposal << 2 | (f.transparent is not None)
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, f.delay, f.transparent or 0, 0))
        parts.append(struct.pack("<BHHHHB", 0x2C, f.x, f.y, w, h, 0x87 if f.palette is not None else 0))
        if f.palette is not None:
            parts.append(f.palette.tobytes())
        parts += [b"\x08", _blocks(lzw_encode(f.pixels.tobytes()))]
    return b"".join([*parts, b";"])


# Reading


def _widening(data: np.ndarray, bit: int, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` codes from ``bit`` on, directly after a clear, and the bit after each; three bytes pad ``data``."""
    widths, ends = _widths(size, most)
    n = int(np.searchsorted(ends, (len(data) - 3) * 8 - bit, "right"))
    widths, ends = widths[:n], ends[:n] + bit
    starts = ends - widths
    byte = starts >> 3
    codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (starts & 7).astype(np.uint32)
    return codes & ((1 << widths) - 1).astype(np.uint32), ends


def _strings(codes: np.ndarray, size: int) -> bytes:
    """The pixels of the codes between two clears."""
    if not len(codes):
        return b""
    clear = 1 << size
    known = [bytes([i]) for i in range(clear)] + [b"", b""]
    grow, following = known.append, clear + 2
    codes = codes.tolist()
    if codes[0] >= clear:
        raise ValueError("a code before its entry")
    last = known[codes[0]]
    out = [last]
    put = out.append
    growing = 4096 - following + 1
    for code in codes[1:growing]:
        # The new entry is the last string and the first pixel of this one, which may be the entry itself.
        if code < following:
            word = known[code]
            grow(last + word[:1])
        elif code == following:
            word = last + last[:1]
            grow(word)
        else:
            raise ValueError("a code before its entry")
        following += 1
        put(word)
        last = word
    out += [known[code] for code in codes[growing:]]
    return b"".join(out)


def lzw_decode(data: bytes, size: int) -> np.ndarray:
    """The pixels of a code stream whose smallest code size is ``size``."""
    if not 2 <= size <= 8:
        raise ValueError("code size")
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    clear = 1 << size
    out, bit = [], 0
    while True:
        most = 4096
        while True:
            codes, ends = _widening(stream, bit, size, most)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops) or len(codes) < most:
                break
            most *= 4
        n = int(stops[0]) if len(stops) else len(codes)
        out.append(_strings(codes[:n], size))
        if not len(stops) or codes[n] == clear + 1:
            return np.frombuffer(b"".join(out), np.uint8)
        bit = int(ends[n])


def decode_gif(data: bytes) -> Gif:
    """All frames of a GIF; ValueError if the bytes are none."""
    try:
        return _decode_gif(data)
    except (IndexError, struct.error) as error:
        raise ValueError("cut short") from error


def _decode_gif(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        found = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
        return found

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    width, height, flags = struct.unpack_from("<HHB", data, 6)
    gif = Gif(width, height, palette(flags))
    control = (0, 0, None)
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            at += 2
            body = blocks()
            if label == 0xF9:
                bits, delay, transparent = struct.unpack_from("<BHB", body)
                control = (bits >> 2 & 7, delay, transparent if bits & 1 else None)
        elif kind == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = palette(flags)
            size = data[at]
            at += 1
            found = lzw_decode(blocks(), size)
            if len(found) < w * h:
                raise ValueError("cut short")
            pixels = found[: w * h].reshape(h, w)
            if flags & 0x40:
                rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                woven = np.empty_like(pixels)
                woven[rows] = pixels
                pixels = woven
            disposal, delay, transparent = control
            gif.frames.append(Frame(pixels, own, x, y, delay, disposal, transparent))
            control = (0, 0, None)
        else:
            raise ValueError("unknown block")
    return gif


def rendered(gif: Gif) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """start in ms, delay in ms, colours (height x width x 3) and what is drawn (height x width) of each frame.

    The arrays change with the next frame. What isn't drawn is transparent; a frame may reach over the canvas.
    """
    colours = np.zeros((gif.height, gif.width, 3), np.uint8)
    drawn = np.zeros((gif.height, gif.width), bool)
    start = 0
    for f in gif.frames:
        palette = f.palette if f.palette is not None else gif.palette
        if palette is None:
            raise ValueError("no palette")
        part = np.s_[f.y : f.y + f.pixels.shape[0], f.x : f.x + f.pixels.shape[1]]
        before = (colours[part].copy(), drawn[part].copy()) if f.disposal == 3 else None
        pixels = f.pixels[: colours[part].shape[0], : colours[part].shape[1]]
        new = palette[np.minimum(pixels, len(palette) - 1)]
        if f.transparent is None:
            colours[part], drawn[part] = new, True
        else:
            shown = pixels != f.transparent
            colours[part][shown] = new[shown]
            drawn[part] |= shown
        yield start, f.delay * 10, colours, drawn
        start += f.delay * 10
        if f.disposal == 2:
            colours[part], drawn[part] = 0, False
        elif before:
            colours[part], drawn[part] = before


def colour_histogram(colours: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Drawn pixels in each of 64 bins, two bits a channel."""
    c = (colours >> 6).astype(np.uint8)
    bins = c[..., 0] << 4 | c[..., 1] << 2 | c[..., 2]
    return np.bincount(bins[drawn], minlength=BINS)


# Payloads


def padded(payload: bytes) -> bytes:
    return payload + b" " * (WIDTH - len(payload) % WIDTH if len(payload) % WIDTH or not payload else 0)


def payload_gif(payload: bytes) -> bytes:
    """A GIF of the bytes of a padded payload: up to 32 rows of 192 pixels a frame."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    gif = Gif(WIDTH, min(ROWS, len(rows)), PAYLOAD_PALETTE)
    shown = np.full((gif.height, WIDTH), -1, np.int16)  # what the canvas shows; -1 is nothing
    for i in range(0, len(rows), ROWS):
        own = rows[i : i + ROWS]
        unused = np.flatnonzero(np.bincount(own.reshape(-1), minlength=256) == 0)
        same = shown[: len(own)] == own
        # 255 is in no UTF-8 text; in a payload that has all values, nothing is transparent.
        transparent = int(unused[-1]) if len(unused) and same.any() else None
        pixels = own if transparent is None else np.where(same, np.uint8(transparent), own)
        disposal = DISPOSALS[i // ROWS % len(DISPOSALS)]
        gif.frames.append(Frame(pixels, delay=DELAY, disposal=disposal, transparent=transparent))
        if disposal != 3:
            shown[: len(own)] = -1 if disposal == 2 else own
    return encode_gif(gif)


def read_payload(gif: Gif) -> tuple[bytes, list[dict]]:
    """The payload by the colours of the rendered frames, and the timed frames with their colour histograms."""
    parts, out = [], []
    for f, (start, delay, colours, drawn) in zip(gif.frames, rendered(gif), strict=True):
        own, ink = colours[: f.pixels.shape[0]], drawn[: f.pixels.shape[0]]
        if not ink.all():
            raise ValueError("a payload without all its pixels")
        parts.append(((own[..., 0] >> 5) << 5 | (own[..., 1] >> 5) << 2 | own[..., 2] >> 6).tobytes())
        out.append(_timed(gif, f, start, delay, own, ink))
    return b"".join(parts), out


def _timed(gif: Gif, f: Frame, start: int, delay: int, colours: np.ndarray, drawn: np.ndarray) -> dict:
    values = (start, delay, gif.width, gif.height, f.disposal, f.transparent, int(drawn.sum()), colour_histogram(colours, drawn))
    return dict(zip(TIMED.names, values, strict=True))


#: A timed frame; histogram has the drawn pixels in each of 64 colour bins.
TIMED = pa.struct(
    [(c, pa.int32()) for c in ("start_ms", "delay_ms", "width", "height", "disposal", "transparent")]
    + [("drawn", pa.int64()), ("histogram", pa.list_(pa.int64()))]
)
TIMED_TYPE = "array<struct<start_ms:int,delay_ms:int,width:int,height:int,disposal:int,transparent:int,drawn:bigint,histogram:array<bigint>>>"


def stored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, padded with spaces to rows of 192, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [x.encode() for x in texts(batch.column("__text"))]
            media = pa.array([payload_gif(padded(x)) for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in rows], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def frames(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """A row per frame: key, frame (from 0), and the fields of a timed frame, for each GIF of ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for data in batch.column("media").to_pylist():
                try:
                    gif = decode_gif(data or b"")
                    out.append([_timed(gif, f, *shown) for f, shown in zip(gif.frames, rendered(gif), strict=True)])
                except ValueError:
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(TIMED))], ["key", "frames"])

    kind = media.schema[key].dataType.simpleString()
    found = media.select(media[key].alias("key"), media[column].alias("media")).mapInArrow(run, f"key {kind}, frames {TIMED_TYPE}")
    return found.select("key", F.posexplode("frames").alias("frame", "f")).select("key", "frame", "f.*").withColumnRenamed("key", key)


def read(media: DataFrame) -> DataFrame:
    """The payloads of ``stored`` read back: digests of payload and file, and the column of timed frames."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for data in batch.column("media").to_pylist():
                payload, timed = read_payload(decode_gif(data))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), timed))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(TIMED)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    types = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames {TIMED_TYPE}"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, {types}")


def feature(frames_: str) -> Column:
    """Number, playing time and size of the timed frames, and the colour bins over all of them."""
    none = F.array_repeat(F.lit(0).cast("long"), BINS)
    total = F.aggregate(frames_, none, lambda n, f: F.zip_with(n, f["histogram"], lambda a, b: a + b))
    shown = F.filter(F.transform(total, lambda n, i: F.when(n > 0, F.concat_ws(":", i.cast("string"), n.cast("string")))), lambda x: x.isNotNull())
    ms = F.aggregate(frames_, F.lit(0), lambda n, f: n + f["delay_ms"])
    first = F.get(F.col(frames_), F.lit(0))
    return F.concat(
        F.lit("frames="), F.size(frames_), F.lit(";ms="), ms, F.lit(";size="), first["width"], F.lit("x"), first["height"], F.lit(";colours="), F.array_join(shown, ",")
    )


def features(media: DataFrame) -> DataFrame:
    """``read`` with the feature of the timed frames in their place."""
    return read(media).withColumn("feature", feature("frames")).drop("frames")


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(table(spark, sf_dir, "documents")))
