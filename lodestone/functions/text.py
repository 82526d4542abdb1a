"""Text vectors: signed hashed counts of character n-grams, in NumPy batches and in Catalyst."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.types import DIMENSIONS, VECTOR

#: The published 64-bit FNV-1a parameters, and the code points of White_Space.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
WHITE_SPACE = frozenset([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Matches texts that hold more than White_Space.
SOLID = "[^" + "".join(f"\\x{{{p:x}}}" for p in sorted(WHITE_SPACE)) + "]"
MAX_MARKS = 1024
GRAMS = 5
#: Code points hashed at once; a longer text is counted in overlapping pieces.
PIECE = 1 << 20


class TextFailure(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def decode(content: bytes) -> str:
    """Strict UTF-8 without NUL, one leading BOM dropped, CRLF and CR as LF, in NFC.

    More than MAX_MARKS non-starters in a row, counted before NFC, are invalid text.
    """
    try:
        text = content.decode("utf-8", "strict")
    except UnicodeDecodeError as e:
        raise TextFailure("invalid_text", f"not UTF-8 at byte {e.start}") from None
    return normalize(text)


def normalize(text: str) -> str:
    if "\0" in text:
        raise TextFailure("invalid_text", "NUL in text")
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    run = 0
    if len(text) > MAX_MARKS:
        for c in text:
            run = run + 1 if unicodedata.combining(c) else 0
            if run > MAX_MARKS:
                raise TextFailure("invalid_text", f"more than {MAX_MARKS} combining marks in a row")
    return unicodedata.normalize("NFC", text)


def _bytes_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of each code point (n x 4) and how many of them count."""
    p = points.astype(np.uint32)
    size = 1 + (p >= 0x80).astype(np.int8) + (p >= 0x800) + (p >= 0x10000)
    out = np.zeros((len(p), 4), np.uint64)
    out[:, 0] = np.select([size == 1, size == 2, size == 3], [p, 0xC0 | p >> 6, 0xE0 | p >> 12], 0xF0 | p >> 18)
    for k in range(1, 4):
        shift = np.maximum(size - 1 - k, 0).astype(np.uint32) * 6
        out[:, k] = 0x80 | (p >> shift) & 0x3F
    return out, size


def _absorb(state: np.ndarray, byte: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a over the bytes of one code point a row; uint64 arithmetic wraps."""
    prime = np.uint64(FNV_PRIME)
    widest = int(size.max()) if len(size) else 0
    for k in range(widest):
        stepped = (state ^ byte[:, k]) * prime
        state = stepped if k == 0 or (size > k).all() else np.where(size > k, stepped, state)
    return state


def gram_counts(text: str) -> np.ndarray:
    """Signed counts of the hashed 1- to 5-grams of normalized text, by bucket."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = np.zeros(DIMENSIONS)
    with np.errstate(over="ignore"):
        for at in range(0, len(points), PIECE):
            piece = points[at : at + PIECE + GRAMS - 1]
            byte, size = _bytes_of(piece)
            for n in range(1, GRAMS + 1):
                # Grams belong to the piece they start in.
                last = min(PIECE, len(piece) - n + 1)
                if last <= 0:
                    break
                state = np.full(last, (FNV_OFFSET ^ n) * FNV_PRIME % (1 << 64), np.uint64)
                for i in range(n):
                    state = _absorb(state, byte[i : i + last], size[i : i + last])
                sign = 1.0 - 2.0 * (state >> np.uint64(63)).astype(np.float64)
                counts += np.bincount((state & np.uint64(DIMENSIONS - 1)).astype(np.int64), weights=sign, minlength=DIMENSIONS)
    return counts


def unit(counts: np.ndarray) -> np.ndarray:
    norm = float(np.sqrt((counts * counts).sum()))
    if not np.isfinite(norm) or norm == 0:
        raise TextFailure("insufficient_content", "nothing to count")
    return (counts / norm).astype(np.float32)


def encode_text(content: bytes | str) -> tuple[np.ndarray, int]:
    """(unit vector, characters after NFC) of a text; raises TextFailure."""
    text = normalize(content) if isinstance(content, str) else decode(content)
    if all(ord(c) in WHITE_SPACE for c in text):
        raise TextFailure("insufficient_content", "no characters but white space")
    return unit(gram_counts(text)), len(text)


def text_outcome(content: bytes | str | None) -> dict:
    """state, vector, characters and error code of one text; failures are values."""
    if content is None:
        return {"state": "failed", "vector": None, "characters": None, "error": "io_error"}
    try:
        vector, characters = encode_text(content)
    except TextFailure as e:
        return {"state": "failed", "vector": None, "characters": None, "error": e.code}
    return {"state": "ready", "vector": vector, "characters": characters, "error": None}


_OUTCOME = T.StructType([T.StructField("state", T.StringType()), T.StructField("vector", VECTOR), T.StructField("characters", T.LongType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_OUTCOME)
def text_vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Vectors of text or bytes with their outcome, in Arrow batches."""
    for batch in batches:
        yield pd.DataFrame([text_outcome(t) for t in batch], columns=["state", "vector", "characters", "error"])


#: Rows of a batch of outcomes with their vectors, 16 KB each.
OUTCOMES = 256


def outcomes(rows: DataFrame, id_: str, text: str, with_vector: bool = True) -> DataFrame:
    """(id, state, vector, characters, error) of every row, in small batches; without the
    vectors, which stay where they were made, if they are not wanted."""
    schema = T.StructType([rows.select(id_).schema[0], *[f for f in _OUTCOME.fields if with_vector or f.name != "vector"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUTCOMES):
                batch = whole.slice(at, OUTCOMES)
                made = [text_outcome(t) for t in batch["text"].to_pylist()]
                columns = {"state": pa.array([o["state"] for o in made], pa.string())}
                if with_vector:
                    columns["vector"] = pa.array([o["vector"] for o in made], pa.list_(pa.float32()))
                columns |= {"characters": pa.array([o["characters"] for o in made], pa.int64()), "error": pa.array([o["error"] for o in made], pa.string())}
                yield pa.RecordBatch.from_arrays([batch["id"], *columns.values()], names=[id_, *columns])

    return rows.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def newlines(text: Column) -> Column:
    """One leading BOM dropped, CRLF and CR as LF."""
    return F.replace(F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def grams(text: Column) -> Column:
    """All 1- to 5-grams of a text in code points, as an array; empty for empty and null text."""
    n = F.char_length(text)

    def of_size(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.when(i + (k - 1) <= n, F.substring(text, i, F.lit(k))))

    return F.filter(F.concat(*[of_size(k) for k in range(1, GRAMS + 1)]), lambda g: g.isNotNull())


def grams_of(points: Column) -> Column:
    """The same from the array of a text's code points, which should be a column of its own:
    work in proportion to the text, where substrings of a long text are not."""
    n = F.size(points)

    def of_size(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.when(i + (k - 1) <= n, F.array_join(F.slice(points, i, F.lit(k)), "")))

    return F.filter(F.concat(*[of_size(k) for k in range(1, GRAMS + 1)]), lambda g: g.isNotNull())


def fnv1a(text: Column, seed: Column) -> Column:
    """struct(hi, lo): FNV-1a of the UTF-8 bytes of text, started from a seed byte.

    The state is two 32-bit halves in longs, so nothing overflows under ANSI: the prime is
    2**40 + 435, and multiplying by it is a product with 435 and a shift by 40.
    """
    low = (1 << 32) - 1

    def step(state: Column, byte: Column) -> Column:
        mixed = state["lo"].bitwiseXOR(byte)
        product = mixed * 435
        high = (state["hi"] * 435 + F.shiftrightunsigned(product, 32) + mixed * 256).bitwiseAND(F.lit(low))
        return F.struct(high.alias("hi"), product.bitwiseAND(F.lit(low)).alias("lo"))

    hex_ = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text)
    byte = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.when(i <= size, F.conv(F.substring(hex_, 2 * i - 1, F.lit(2)), 16, 10).cast("long")))
    bytes_ = F.concat(F.array(seed.cast("long")), F.filter(byte, lambda b: b.isNotNull()))
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & low).cast("long").alias("lo"))
    return F.aggregate(bytes_, start, step)


def gram_feature(gram: Column) -> Column:
    """struct(bucket, sign) of one n-gram."""
    h = fnv1a(gram, F.char_length(gram))
    sign = F.when(F.shiftrightunsigned(h["hi"], 31) == 0, 1).otherwise(-1)
    return F.struct(h["lo"].bitwiseAND(F.lit(DIMENSIONS - 1)).cast("int").alias("bucket"), sign.cast("long").alias("sign"))
