"""Raster images to RGB and to the input of an image model, with NumPy and zlib only.

Read: PNG, BMP, PNM (P1 to P7), TGA, QOI and farbfeld. A model that makes vectors is not
part of this library: model_reader() makes an Engine reader from any that is given to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import TextFailure

#: Side of the model's input, and mean and deviation of its channels.
SIDE = 320
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
MAX_SIDE, MAX_BYTES = 32768, 128 << 20


def _fail(message: str, code: str = "decode_failed"):
    raise TextFailure(code, message)


def _bounded(width: int, height: int, channels: int = 4) -> None:
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        _fail(f"{width} x {height} pixels")
    if width * height * channels > MAX_BYTES:
        _fail("the image is too large", "resource_budget_too_small")


def _take(data: bytes, count: int) -> bytes:
    return data[:count] if len(data) >= count else _fail("the image is cut off")


def _inflate(data: bytes, size: int) -> bytes:
    """Exactly `size` bytes of a zlib stream, never more."""
    stream = zlib.decompressobj()
    try:
        return _take(stream.decompress(data, size), size)
    except zlib.error as e:
        _fail(str(e))


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG pass without their filters; `step` bytes a pixel."""
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line, above = int(rows[y, 0]), rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:  # each byte adds to the one a pixel before: a running sum per lane
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            out[y + 1] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            now, up, new = bytearray(stride), bytes(above), bytes(line)
            for i in range(stride):
                left = now[i - step] if i >= step else 0
                if kind == 3:
                    now[i] = (new[i] + (left + up[i]) // 2) & 255
                    continue
                corner = up[i - step] if i >= step else 0
                guess = left + up[i] - corner
                near = min((abs(guess - left), 0, left), (abs(guess - up[i]), 1, up[i]), (abs(guess - corner), 2, corner))
                now[i] = (new[i] + near[2]) & 255
            out[y + 1] = np.frombuffer(now, np.uint8)
        else:
            _fail(f"filter {kind}")
    return out[1:]


def _samples(rows: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    if bits == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    if bits == 8:
        return rows.reshape(len(rows), width, channels)
    flat = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
    return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, : width * channels].reshape(len(rows), width, channels)


#: Fixed values of interlaced images: first column and row of each pass, and its steps.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png(data: bytes) -> np.ndarray:
    parts: dict[bytes, list[bytes]] = {}
    at = 8
    while at + 12 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            _fail("a part of the file is damaged")
        parts.setdefault(name, []).append(body)
        at += 12 + size
        if name == b"IEND":
            break
    if b"IHDR" not in parts or b"IDAT" not in parts or b"IEND" not in parts:
        _fail("parts of the file are missing")
    width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", _take(parts[b"IHDR"][0], 13))
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind) or _fail("unknown colours")
    if bits not in (1, 2, 4, 8, 16) or bits < 8 and kind not in (0, 3) or kind == 3 and bits == 16:
        _fail("unknown depth")
    _bounded(width, height)
    step, passes = max(1, channels * bits // 8), PASSES if interlaced else ((0, 0, 1, 1),)
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    strides = [-(-w * channels * bits // 8) for w, _ in sizes]
    raw = _inflate(b"".join(parts[b"IDAT"]), sum((s + 1) * h for s, (w, h) in zip(strides, sizes) if w > 0 and h > 0))
    image, at = np.zeros((height, width, channels), np.uint8), 0
    for (x, y, dx, dy), (w, h), stride in zip(passes, sizes, strides):
        if w > 0 and h > 0:
            image[y::dy, x::dx] = _samples(_unfilter(raw[at : at + (stride + 1) * h], h, stride, step), w, channels, bits)
            at += (stride + 1) * h
    if kind == 3:
        colours = np.zeros((256, 4), np.uint8)
        table = np.frombuffer(parts.get(b"PLTE", [b""])[0], np.uint8)
        if not len(table) or len(table) % 3 or image.max() >= len(table) // 3:
            _fail("colours outside the palette")
        colours[: len(table) // 3, :3], colours[:, 3] = table.reshape(-1, 3), 255
        clear = np.frombuffer(parts.get(b"tRNS", [b""])[0], np.uint8)
        colours[: len(clear), 3] = clear
        return colours[image[:, :, 0]]
    if kind == 0 and bits < 8:
        image = image * np.uint8(255 // ((1 << bits) - 1))
    return image


def _bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, bits, packed = struct.unpack("<10xIIiiHHI", _take(data, 34))
    down, height = height < 0, abs(height)
    _bounded(width, height)
    if packed not in (0, 3) or bits not in (8, 24, 32) or packed == 3 and bits != 32:
        _fail("packed bitmaps", "unsupported_format")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(_take(data[start:], stride * height), np.uint8).reshape(height, stride)[:, : width * bits // 8].reshape(height, width, bits // 8)
    rows = rows if down else rows[::-1]
    if bits == 8:
        table = np.frombuffer(data[14 + size : start], np.uint8)
        table = table[: len(table) // 4 * 4].reshape(-1, 4)
        return table[rows[:, :, 0]][:, :, 2::-1] if rows.max() < len(table) else _fail("colours outside the palette")
    return rows[:, :, 2::-1]


def _pnm(data: bytes) -> np.ndarray:
    magic, at = data[:2], 2
    if magic == b"P7":
        head, _, body = data.partition(b"ENDHDR\n")
        fields = {k: v for k, _, v in (line.partition(b" ") for line in head.split(b"\n")[1:])}
        width, height, channels, most = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    else:
        numbers: list[int] = []
        while len(numbers) < (2 if magic in (b"P1", b"P4") else 3):
            while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
                at = data.find(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            numbers.append(int(data[at:end]))
            at = end
        width, height, most = (*numbers, 1)[:3]
        channels, body = 3 if magic in (b"P3", b"P6") else 1, data[at + 1 :]
    _bounded(width, height, channels)
    count = width * height * channels
    if not 0 < most < 65536 or not 1 <= channels <= 4:
        _fail("values out of range")
    if magic == b"P4":
        rows = np.frombuffer(_take(body, (width + 7) // 8 * height), np.uint8).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width, None]) * np.uint8(255)
    if magic == b"P1":
        bits = np.array([c == 49 for c in body if c in (48, 49)], np.uint8)
        return (1 - bits[:count].reshape(height, width, 1)) * np.uint8(255) if len(bits) >= count else _fail("the image is cut off")
    if magic in (b"P2", b"P3"):
        values = np.array(body.split()[:count], np.int64)
        if len(values) < count:
            _fail("the image is cut off")
    else:
        kind = np.dtype(">u2" if most > 255 else "u1")
        values = np.frombuffer(_take(body, count * kind.itemsize), kind).astype(np.int64)
    return (values.clip(0, most) * 255 // most).astype(np.uint8).reshape(height, width, channels)


def _tga(data: bytes) -> np.ndarray:
    skip, _, kind, width, height, bits, flags = struct.unpack("<BBB9xHHBB", _take(data, 18))
    if kind not in (2, 3, 10, 11) or bits not in (8, 24, 32):
        _fail("palettes and packed colours", "unsupported_format")
    _bounded(width, height)
    step, body = bits // 8, data[18 + skip :]
    if kind in (10, 11):
        out, at, size = bytearray(), 0, width * height * step
        while len(out) < size:
            if at >= len(body):
                _fail("the image is cut off")
            count, run = (body[at] & 127) + 1, body[at] & 128
            piece = body[at + 1 : at + 1 + step] * count if run else body[at + 1 : at + 1 + step * count]
            if len(piece) < step * count:
                _fail("the image is cut off")
            out += piece
            at += 1 + (step if run else step * count)
        body = bytes(out)
    rows = np.frombuffer(_take(body, width * height * step), np.uint8).reshape(height, width, step)
    rows = rows if flags & 32 else rows[::-1]
    rows = rows[:, ::-1] if flags & 16 else rows
    return rows if step == 1 else rows[:, :, [2, 1, 0, 3][:step]]


def _qoi(data: bytes) -> np.ndarray:
    width, height = struct.unpack(">4xII", _take(data, 12))
    _bounded(width, height)
    out, at, filled, total = np.empty((width * height, 4), np.uint8), 14, 0, width * height
    pixel, seen = (0, 0, 0, 255), [(0, 0, 0, 0)] * 64
    while filled < total:
        if at + 1 > len(data):
            _fail("the image is cut off")
        b, run = data[at], 1
        r, g, blue, a = pixel
        at += 1
        if b >= 254:
            given = _take(data[at:], b - 251)
            pixel = (*given, a) if b == 254 else tuple(given)
            at += b - 251
        elif b < 64:
            pixel = seen[b]
        elif b < 128:
            pixel = ((r + (b >> 4 & 3) - 2) & 255, (g + (b >> 2 & 3) - 2) & 255, (blue + (b & 3) - 2) & 255, a)
        elif b < 192:
            more = _take(data[at:], 1)[0]
            green = (b & 63) - 32
            pixel = ((r + green + (more >> 4) - 8) & 255, (g + green) & 255, (blue + green + (more & 15) - 8) & 255, a)
            at += 1
        else:
            run = (b & 63) + 1
        seen[(pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64] = pixel
        out[filled : filled + run] = pixel
        filled += run
    return out.reshape(height, width, 4)


def _farbfeld(data: bytes) -> np.ndarray:
    width, height = struct.unpack(">8xII", _take(data, 16))
    _bounded(width, height, 8)
    return np.frombuffer(_take(data[16:], width * height * 8), np.uint8).reshape(height, width, 4, 2)[..., 0]


def read_rgb(content: bytes, form: str = "raster") -> tuple[np.ndarray, str]:
    """(height x width x 3 bytes, name of the format) of an image; raises TextFailure.

    Colours are taken as they are, transparency lies on black.
    """
    if form == "tga":
        name, read = "tga", _tga
    else:
        known = ((b"\x89PNG\r\n\x1a\n", "png", _png), (b"BM", "bmp", _bmp), (b"qoif", "qoi", _qoi), (b"farbfeld", "farbfeld", _farbfeld), *[(b"P%d" % i, "pnm", _pnm) for i in range(1, 8)])
        found = [(n, r) for magic, n, r in known if content.startswith(magic)]
        if not found:
            raise TextFailure("runtime_unavailable", "no decoder for this image is installed")
        name, read = found[0]
    try:
        image = read(content)
    except (struct.error, ValueError, KeyError, OverflowError, IndexError) as e:
        raise TextFailure("decode_failed", f"not an image: {e}") from None
    if image.shape[2] < 3:
        image = np.concatenate([image[:, :, :1].repeat(3, 2), image[:, :, 1:]], 2)
    if image.shape[2] == 4:
        image = ((image[:, :, :3].astype(np.uint16) * image[:, :, 3:] + 127) // 255).astype(np.uint8)
    return np.ascontiguousarray(image), name


def triangle(size: int, side: int) -> np.ndarray:
    """(side, size): weights of a line's pixels for each pixel of the resized line; a triangle
    as wide as two pixels of the coarser of both."""
    scale = size / side
    reach = max(scale, 1.0)
    centre = (np.arange(side) + 0.5) * scale
    weight = (1 - np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) / reach).clip(0)
    return (weight / weight.sum(1, keepdims=True)).astype(np.float32)


def preprocess(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The model's input (3, side, side): resized by triangles, scaled, and normalised."""
    height, width = rgb.shape[:2]
    lines = np.tensordot(triangle(height, side), rgb.astype(np.float32), (1, 0))
    resized = np.einsum("xw,ywc->yxc", triangle(width, side), lines, optimize=True)
    whole = np.floor(resized.clip(0, 255) + 0.5).astype(np.float32)
    return ((whole / 255 - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)).transpose(2, 0, 1).astype(np.float32)


def model_reader(model: Callable[[np.ndarray], np.ndarray], form: str = "raster") -> Callable[[bytes], tuple]:
    """An Engine reader of images: `model` takes the input of preprocess() and gives the
    components, which are brought to unit length."""

    def read(content: bytes) -> tuple:
        rgb, name = read_rgb(content, form)
        out = np.asarray(model(preprocess(rgb)), np.float64).ravel()
        norm = float(np.sqrt((out * out).sum()))
        if not np.isfinite(norm) or norm == 0:
            raise TextFailure("decode_failed", "the model gave no direction")
        return (out / norm).astype(np.float32), {"coverage": "first_image", "format": name, "source_width": rgb.shape[1], "source_height": rgb.shape[0]}

    return read


_OUTCOME = T.StructType([T.StructField("format", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("width", "height", "red", "green", "blue")], T.StructField("error", T.StringType())])


@F.pandas_udf(_OUTCOME)
def raster_outcomes(contents: pd.Series) -> pd.DataFrame:
    """Format, size and sums of the channels of images, or the code of what is wrong."""
    out = []
    for content in contents:
        try:
            rgb, name = read_rgb(content)
            out.append((name, rgb.shape[1], rgb.shape[0], *rgb.sum((0, 1), dtype=np.int64).tolist(), None))
        except TextFailure as e:
            out.append((None, -1, -1, -1, -1, -1, e.code))
    return pd.DataFrame(out, columns=_OUTCOME.names)
