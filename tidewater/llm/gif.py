"""GIF as a column: byte payloads stored as images, and images read into rows of timed frames.

``encode`` stores a payload as 8-bit samples of width 64 over a grey palette, LZW-coded, in as many frames as its height needs.
``decode`` reads any GIF87a or GIF89a: local and global palettes, interlacing, transparency, the four disposal methods, delays.
LZW code widths follow from the number of codes since the last clear code alone, so all the codes up to the next one are
unpacked at once by numpy, and so are those written packed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

WIDTH, UNIT = 64, 64
MAX_ROWS = 65_535  # a GIF's height has 16 bits
#: Pixels that a canvas or a frame may have: a header can claim 65,535 x 65,535, which no reader should set aside room for.
MAX_PIXELS = 1 << 26
GREY = bytes(x for v in range(256) for x in (v, v, v))


_SCHEDULES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the first n codes after a clear code, and the bits before each.

    A reader makes an entry with every code but the first, so before code j > 0 its next free code is 2**size + 1 + j.
    """
    if size not in _SCHEDULES or len(_SCHEDULES[size][0]) < n:
        free = (1 << size) + 1 + np.arange(max(4200, 2 * n))
        w = np.minimum(12, np.log2(free).astype(np.int64) + 1)
        w[0] = size + 1
        _SCHEDULES[size] = w, np.cumsum(w) - w
    w, before = _SCHEDULES[size]
    return w[:n], before[:n]


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    clear, end = 1 << size, (1 << size) + 1
    runs: list[list[int]] = [[clear]]  # the first code of all has the least width
    codes: list[int] = []
    table: dict[int, int] = {}
    get, put, free = table.get, codes.append, end + 1
    it = iter(data)
    prefix = next(it, None)
    for b in it:
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = b
        table[key] = free
        free += 1
        if free == 4096:
            put(clear)
            runs.append(codes)
            codes, free = [], end + 1
            put = codes.append
            table.clear()
    if prefix is not None:
        put(prefix)
    put(end)
    runs.append(codes)
    bits = []
    for run in runs:
        c = np.array(run, np.uint16)
        w = _schedule(size, len(c))[0]
        every = np.unpackbits(c.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
        bits.append(every[np.arange(12) < w[:, None]])
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    at, total, out = 0, 8 * len(data), []
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    while True:
        n = 4200
        while True:
            w, before = _schedule(size, n)
            pos = before + at
            fits = int(np.searchsorted(pos + w, total, side="right"))
            codes = words[pos[:fits] >> 3] >> (pos[:fits] & 7) & ((1 << w[:fits]) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or fits < n:
                break
            n *= 2
        run = codes[: stop[0]].tolist() if len(stop) else codes.tolist()
        table, prev = base.copy(), b""
        free, add, put = clear + 2, table.append, out.append
        for code in run:
            if code < free:
                entry = table[code]
            elif code == free and prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("LZW code beyond the table")
            put(entry)
            if prev and free < 4096:
                add(prev + entry[:1])
                free += 1
            prev = entry
        if not len(stop) or codes[stop[0]] == end:
            return b"".join(out)
        at = int(pos[stop[0]] + w[stop[0]])


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, delay: int = 4) -> bytes:
    """A GIF whose frames hold the payload, a multiple of 64 bytes, as grey samples from top to bottom."""
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MAX_ROWS), 0xF7, 0, 0), GREY]
    for top in range(0, rows, MAX_ROWS):
        part = payload[top * WIDTH : (top + MAX_ROWS) * WIDTH]
        parts += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    #: palette indices as stored, by row
    samples: np.ndarray
    #: the whole canvas as shown, height x width x RGB
    canvas: np.ndarray


def decode(media: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order; raises ValueError on anything else, and on damaged ones."""
    try:
        yield from _decoded(media)
    except (IndexError, struct.error) as e:
        raise ValueError(f"damaged GIF: {e}") from e


def _decoded(media: bytes) -> Iterator[Frame]:
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    if width * height > MAX_PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    at, palette = 13, None
    if flags & 0x80:
        size = 3 * (2 << (flags & 7))
        palette, at = np.frombuffer(media, np.uint8, size, at).reshape(-1, 3), at + size
    canvas = np.zeros((height, width, 3), np.uint8)
    disposal, delay, clear = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while (kind := media[at]) != 0x3B:
        if kind == 0x21:
            body, after = blocks(at + 2)
            if media[at + 1] == 0xF9:
                f, d, index = struct.unpack_from("<BHB", body)
                disposal, delay, clear = f >> 2 & 7, 10 * d, index if f & 1 else None
            at = after
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, f = struct.unpack_from("<HHHHB", media, at + 1)
        if w * h > MAX_PIXELS:
            raise ValueError(f"a frame of {w} x {h}")
        at, colours = at + 10, palette
        if f & 0x80:
            size = 3 * (2 << (f & 7))
            colours, at = np.frombuffer(media, np.uint8, size, at).reshape(-1, 3), at + size
        if colours is None:
            raise ValueError("no palette")
        code_size = media[at]
        packed, at = blocks(at + 1)
        samples = np.frombuffer(lzw_decode(packed, code_size), np.uint8)
        if len(samples) < w * h:
            raise ValueError("a frame has too few samples")
        samples = samples[: w * h].reshape(h, w)
        if f & 0x40:
            order = np.concatenate([np.arange(s, h, step) for s, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        before = canvas.copy() if disposal == 3 else None
        ys, xs = slice(top, min(top + h, height)), slice(left, min(left + w, width))
        seen = samples[: ys.stop - top, : xs.stop - left]
        shown = colours[seen]
        canvas[ys, xs] = shown if clear is None else np.where((seen == clear)[..., None], canvas[ys, xs], shown)
        yield Frame(left, top, w, h, delay, disposal, samples, canvas.copy())
        if disposal == 2:
            canvas[ys, xs] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear = 0, 0, None


def histogram(canvas: np.ndarray, bins: int = 8) -> list[int]:
    """Counts of red, green and blue values, ``bins`` each, over a canvas."""
    return [int(n) for c in range(3) for n in np.bincount((canvas[..., c].reshape(-1).astype(np.int64) * bins) >> 8, minlength=bins)]


FRAMES = "array<struct<at_ms:long,delay_ms:int,left:int,top:int,width:int,height:int,disposal:int,histogram:array<int>%s>>"
PIXELS = ",canvas_width:int,canvas_height:int,pixels:binary"


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a GIF.

    Null texts count as empty, which gives 64 zero bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values in _few(batch):
                data = [t or b"" for t in values]
                media = [encode(t + bytes(-len(t) % UNIT or UNIT * (not t))) for t in data]
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _few(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """Slices of a batch, so that only few images are held at once."""
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield part.column(0), texts(part)


def frames(media: DataFrame) -> DataFrame:
    """``doc_id``, the nested ``frames`` of every image (``doc_id``, ``media``), and ``error``: what is wrong with a damaged one, or one whose canvas is over ``MAX_PIXELS``; its frames are those before the damage.

    Each frame has its time, its place, the histogram of the canvas shown, and that canvas: ``pixels``, red, green and blue by row, of
    ``canvas_width`` x ``canvas_height``. Null media have no frames (null) and no error. Repeated rows come back as often as they occur.
    """
    return media.select("doc_id", "media").mapInArrow(lambda it: _read(it, False), f"doc_id long, frames {FRAMES % PIXELS}, error string")


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    """What is in each image: for a payload its size and digests, else the pixels."""
    import itertools

    numbers = ("delay_ms", "left", "top", "width", "height", "disposal")
    pixels = [] if payload else [("canvas_width", pa.int32()), ("canvas_height", pa.int32()), ("pixels", pa.binary())]
    kind = pa.list_(pa.struct([("at_ms", pa.int64()), *((k, pa.int32()) for k in numbers), ("histogram", pa.list_(pa.int32())), *pixels]))
    step = 500 if payload else 8
    for whole in batches:
        for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
            rows, digests, errors = [], [], []
            for media in batch.column(batch.schema.get_field_index("media")).to_pylist():
                of, data, error = [], [], None
                try:
                    for f in decode(media) if media is not None else ():
                        of.append({"histogram": histogram(f.canvas)} | {k: getattr(f, k) for k in numbers})
                        if payload:
                            data.append(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
                        else:
                            of[-1] |= {"canvas_width": f.canvas.shape[1], "canvas_height": f.canvas.shape[0], "pixels": f.canvas.tobytes()}
                except ValueError as e:
                    if payload:  # an image that was stored here
                        raise
                    error = str(e)
                errors.append(error)
                for f, t in zip(of, itertools.accumulate((f["delay_ms"] for f in of), initial=0)):
                    f["at_ms"] = t
                rows.append(of if media is not None else None)
                got = b"".join(data)
                if payload:
                    digests.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *([batch.column(1), *map(pa.array, zip(*digests))] if payload else []), pa.array(rows, kind), *([] if payload else [pa.array(errors, pa.string())])],
                ["doc_id", *(["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"] if payload else []), "frames", *([] if payload else ["error"])],
            )


def digest(docs: DataFrame) -> DataFrame:
    """What is read back from the stored images, for each row of ``docs``; ``feature`` has the frames, the play time and the summed grey histogram.

    Null and empty texts are 64 zero bytes, texts are stored whole, repeated rows come back as often as they occur, and an empty table gives an
    empty result.
    """
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames {FRAMES % ''}"
    read = store(docs).mapInArrow(lambda it: _read(it, True), schema)
    grey = F.aggregate(
        "frames", F.array(*[F.lit(0)] * 8), lambda acc, f: F.zip_with(acc, F.slice(f["histogram"], 1, 8), lambda a, b: a + b)
    )
    time = F.aggregate("frames", F.lit(0), lambda acc, f: acc + f["delay_ms"])
    feature = F.concat(F.size("frames").cast("string"), F.lit(":"), time.cast("string"), F.lit(":"), F.array_join(grey.cast("array<string>"), ","))
    return read.withColumn("feature", feature).drop("frames")
