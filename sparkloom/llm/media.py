"""Media columns: Netpbm and BMP images to NPY tiles.

Bytes are decoded to arrays of 8-bit samples (Netpbm P1 to P7 with 1 to 4
channels, samples of up to 16 bits scaled; BMP uncompressed with 1, 4, 8, 16, 24
or 32 bits and bit fields), resized by area averages read off an integral image,
and cut into tiles, each an NPY file. Of the integral image only the rows that
are read off are kept; those between are summed up in bands. The difference hash
compares neighbours of a 9 by 8 grey resizing, so that equal and nearly equal
images have equal or near hashes.

Defined cases: null, empty, truncated, malformed and unknown data give one row
with ``error`` and no tile; negative samples are malformed, and those above the
greatest value count as it. Images of any size, and smaller than the target, are
resized from all their samples. Repeated rows give their tiles each. An empty
table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIDE = 64
TILE = 32


class BadImage(ValueError):
    pass


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, n = data[1] - 48, 2, len(data)
    values: list[int] = []

    def number() -> int:
        nonlocal at
        while at < n and (data[at] in b" \t\r\n\v\f" or data[at] == 35):
            if data[at] == 35:
                while at < n and data[at] not in b"\r\n":
                    at += 1
            else:
                at += 1
        start = at
        while at < n and 48 <= data[at] <= 57:
            at += 1
        if start == at or at - start > 9:
            raise BadImage("bad header")
        return int(data[start:at])

    if kind == 7:
        end = data.find(b"ENDHDR\n")
        if end < 0:
            raise BadImage("bad header")
        fields = dict(f for line in data[3:end].split(b"\n") if not line.startswith(b"#") and len(f := line.split(None, 1)) == 2)
        try:
            w, h, depth, most = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        except (KeyError, ValueError):
            raise BadImage("bad header") from None
        at = end + 7
    else:
        w, h = number(), number()
        most = 1 if kind in (1, 4) else number()
        depth = 3 if kind in (3, 6) else 1
        at += 1
    if not (w > 0 and h > 0 and 0 < most < 65536 and 1 <= depth <= 4):
        raise BadImage("bad header")
    count = w * h * depth
    if kind in (1, 2, 3):
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        if kind == 1:
            raw = np.frombuffer(body, np.uint8)
            raw = raw[(raw == 48) | (raw == 49)] - 48
        else:
            if body.translate(None, b"0123456789 \t\r\n\v\f"):
                raise BadImage("bad samples")
            raw = np.array([int(v) if len(v) < 10 else 1 << 30 for v in body.split()], np.int64)
    elif kind == 4:
        stride = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=min(at, n))
        if len(raw) < stride * h:
            raise BadImage("truncated")
        raw = np.unpackbits(raw[: stride * h].reshape(h, stride), axis=1)[:, :w].reshape(-1)
    else:
        item = 2 if most > 255 else 1
        raw = np.frombuffer(data, ">u2" if item == 2 else np.uint8, count, at) if n - at >= count * item else np.zeros(0, np.uint8)
    if len(raw) < count:
        raise BadImage("truncated")
    raw = raw[:count].reshape(h, w, depth)
    if kind in (1, 4):
        return ((1 - raw) * 255).astype(np.uint8)
    raw = np.minimum(raw, most)
    return raw.astype(np.uint8) if most == 255 else ((raw.astype(np.uint32) * 255 + most // 2) // most).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 26:
        raise BadImage("truncated")
    offset, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    packed, colours, masks = 0, 0, None
    if head == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        entry = 3
    elif head >= 40 and len(data) >= 54:
        w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        colours = struct.unpack_from("<I", data, 46)[0]
        entry = 4
    else:
        raise BadImage("bad header")
    down, h = h < 0, abs(h)
    if w <= 0 or h == 0 or bits not in (1, 4, 8, 16, 24, 32) or packed not in (0, 3):
        raise BadImage("unsupported")
    stride = (w * bits + 31) // 32 * 4
    if len(data) - offset < stride * h:
        raise BadImage("truncated")
    rows = np.frombuffer(data, np.uint8, stride * h, offset).reshape(h, stride)
    if bits <= 8:
        n = min(colours or 1 << bits, 256)
        start = 14 + head
        if len(data) < start + n * entry:
            raise BadImage("truncated")
        palette = np.zeros((256, 3), np.uint8)
        palette[:n] = np.frombuffer(data, np.uint8, n * entry, start).reshape(n, entry)[:, 2::-1]
        flat = rows if bits == 8 else (np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(h, -1))
        out = palette[flat[:, :w]]
    elif bits == 24 or bits == 32 and packed == 0:
        out = rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    else:
        wide = rows[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.uint64)
        masks = struct.unpack_from("<III", data, 54) if packed == 3 and len(data) >= 66 else (0x7C00, 0x3E0, 0x1F)
        out = np.zeros((h, w, 3), np.uint8)
        for c, m in enumerate(masks):
            low = (m & -m).bit_length() - 1
            top = m >> low if m else 0
            if top:
                out[:, :, c] = ((wide & np.uint64(m)) >> np.uint64(low)) * np.uint64(255) // np.uint64(top)
    return np.ascontiguousarray(out if down else out[::-1])


def decode(data: bytes | None) -> tuple[np.ndarray, str]:
    """(height × width × channels samples, format); BadImage if that can't be had."""
    if not data:
        raise BadImage("empty")
    if len(data) > 3 and data[0] == 80 and 49 <= data[1] <= 55 and data[2] in b" \t\r\n#":
        return _netpbm(data), f"P{data[1] - 48}"
    if data[:2] == b"BM":
        return _bmp(data), "BMP"
    raise BadImage("unknown format")


def _edges(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(to + 1) * size / to
    whole = np.minimum(x.astype(np.int64), size - 1)
    return whole, x - whole


class Integral:
    """The rows of an image's integral image that resizing to each of ``heights`` reads: sums of all samples above and left of each corner."""

    def __init__(self, image: np.ndarray, heights: tuple[int, ...]):
        self.shape = h, w, c = image.shape
        wanted = {int(y) for to in heights for i in _edges(h, to)[0] for y in (i, i + 1)}
        self.rows = np.array(sorted({0, *wanted}))
        self.sums = np.zeros((len(self.rows), w + 1, c))
        above = np.zeros((w, c))
        for n in range(1, len(self.rows)):
            for y in range(self.rows[n - 1], self.rows[n], 4096):  # bands, so that no more than one is widened at a time
                above += image[y : min(y + 4096, self.rows[n])].sum(0, dtype=np.uint64)
            np.cumsum(above, 0, out=self.sums[n, 1:])

    def averages(self, height: int, width: int) -> np.ndarray:
        """Area averages, samples counting in proportion where cells divide them."""
        h, w, _ = self.shape
        i, f = _edges(h, height)
        upper, lower = self.sums[np.searchsorted(self.rows, i)], self.sums[np.searchsorted(self.rows, i + 1)]
        rows = upper + f[:, None, None] * (lower - upper)
        j, g = _edges(w, width)
        corner = rows[:, j] + g[None, :, None] * (rows[:, j + 1] - rows[:, j])
        cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
        return cells * (height * width / (h * w))

    def resized(self, height: int, width: int) -> np.ndarray:
        return np.clip(np.rint(self.averages(height, width)), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return Integral(image, (height,)).resized(height, width)


def difference_hash(sums: Integral) -> int:
    """64 signed bits: whether each of 8 × 9 grey averages exceeds its left neighbour; ``sums`` has the rows for height 8."""
    small = sums.averages(8, 9)
    grey = np.round(small[:, :, :3] @ np.array([0.299, 0.587, 0.114]) if small.shape[2] > 2 else small[:, :, 0], 6)
    return int.from_bytes(np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes(), "big", signed=True)


_headers: dict[tuple, bytes] = {}


def npy(array: np.ndarray) -> bytes:
    """The array as an NPY file, version 1.0."""
    if array.shape not in _headers:
        text = f"{{'descr': '|u1', 'fortran_order': False, 'shape': {array.shape}, }}"
        text += " " * (-(len(text) + 11) % 64) + "\n"
        _headers[array.shape] = b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text.encode()
    return _headers[array.shape] + array.tobytes()


_SCHEMA = "media_id long, format string, height int, width int, channels int, dhash long, tile_y int, tile_x int, npy binary, error string"
_ARROW = pa.schema([("media_id", pa.int64()), ("format", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("dhash", pa.int64()), ("tile_y", pa.int32()), ("tile_x", pa.int32()), ("npy", pa.binary()), ("error", pa.string())])


def image_tiles(data: bytes | None, side: int = SIDE, tile: int = TILE) -> list[tuple]:
    try:
        image, kind = decode(data)
    except BadImage as bad:
        return [(None, None, None, None, None, None, None, None, str(bad))]
    sums = Integral(image, (side, 8))
    mark = difference_hash(sums)
    small = sums.resized(side, side)
    own = (kind, *image.shape, mark)
    return [(*own, y // tile, x // tile, npy(small[y : y + tile, x : x + tile]), None) for y in range(0, side, tile) for x in range(0, side, tile)]


def tiles(media: DataFrame, side: int = SIDE, tile: int = TILE) -> DataFrame:
    """Rows of (media_id, content) to tiles with their image's hash."""

    def run(batches):
        for batch in batches:
            ids = batch.column("media_id")
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [(m, *t) for m, c in zip(ids.slice(start, 256).to_pylist(), part.column("content")) for t in image_tiles(c.as_py(), side, tile)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, _SCHEMA)


def write_bmp(image: np.ndarray) -> bytes:
    """A 32-, 24- or 8-bit BMP for four, three or one channels, the last with a grey palette."""
    h, w, c = image.shape
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if c == 1 else b""
    rows = image[::-1] if c == 1 else image[::-1, :, [2, 1, 0, 3][:c]]
    rows = rows.reshape(h, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", at + rows.size, 0, 0, at, 40, w, h, 1, 8 * c, 0, rows.size, 2835, 2835, 0, 0) + palette + rows.tobytes()


def write_netpbm(image: np.ndarray, kind: int) -> bytes:
    """P1 to P7; the bilevel kinds blacken samples below 128."""
    h, w, c = image.shape
    black = image[:, :, 0] < 128
    body = {
        1: lambda: b"\n".join(b" ".join(b"1" if v else b"0" for v in row) for row in black), 4: lambda: np.packbits(black, axis=1).tobytes(),
        2: lambda: b"\n".join(b" ".join(b"%d" % v for v in row) for row in image.reshape(h, -1)),
    }
    body[3] = body[2]
    head = b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH %d\nMAXVAL 255\nENDHDR\n" % (w, h, c) if kind == 7 else b"P%d\n%d %d\n" % (kind, w, h) + (b"" if kind in (1, 4) else b"255\n")
    return head + body.get(kind, image.tobytes)()


#: (Netpbm kind or 0 for BMP, channels) of the drawn images, by number.
DRAWN = ((5, 1), (6, 3), (0, 3), (0, 1), (2, 1), (7, 4), (4, 1), (0, 4), (3, 3), (7, 2), (1, 1))


def drawn(number: int, data: bytes) -> bytes:
    """An image of the bytes, 64 or 96 samples a row, in one of the formats by number."""
    kind, depth = DRAWN[number % len(DRAWN)]
    width = 32 if depth == 3 else 64 // depth
    pixels = np.frombuffer(data, np.uint8)
    rows = max(1, -(-len(pixels) // (width * depth)))
    image = np.zeros(rows * width * depth, np.uint8)
    image[: len(pixels)] = pixels
    image = image.reshape(rows, width, depth)
    return write_netpbm(image, kind) if kind else write_bmp(image)


def media_of(docs: DataFrame) -> DataFrame:
    """(media_id, content): an image drawn from the bytes of each text, as the given tables hold none."""

    def draw(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else drawn(i or 0, t.encode("utf-8", "replace")) for i, t in zip(ids.to_pylist(), texts.to_pylist())], pa.binary())

    def content(doc_id: Column, text: Column) -> Column:
        return F.arrow_udf(draw, "binary")(doc_id.cast("long"), text.cast("string"))

    return docs.select(F.col("doc_id").alias("media_id"), content(F.col("doc_id"), F.col("text")).alias("content"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the images drawn from every document."""
    return tiles(media_of(table(spark, sf_dir, "documents")))


QUERIES = {"op4_media_tiles": op4}
SQL: dict[str, str] = {}
