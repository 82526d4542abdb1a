"""Content identity and classification by leading bytes, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes, brands and extensions of known formats.
ARCHIVES = (b"\x1f\x8b", b"7z\xbc\xaf", b"Rar!")
RASTERS = (
    b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF8", b"II*\x00", b"MM\x00*", b"II+\x00", b"MM\x00+", b"BM", b"\x00\x00\x01\x00",
    b"qoif", b"DDS ", b"v/1\x01", b"#?RADIANCE", b"#?RGBE", b"farbfeld", b"P1", b"P2", b"P3", b"P4", b"P5", b"P6", b"P7",
)
AUDIO_MAGIC = (b"ID3", b"fLaC", b"caff", b"MAC ", b"wvpk", b"#!AMR", b".snd", b"MPCK", b"FORM", b"RF64")
VIDEO_MAGIC = (b"\x1aE\xdf\xa3", b"FLV", b".RMF", b"0&\xb2u\x8ef\xcf\x11", b"\x00\x00\x01\xba")
IMAGE_BRANDS = (b"avif", b"avis", b"heic", b"heix", b"hevc", b"hevx", b"mif1", b"msf1")
AUDIO_BRANDS = (b"M4A ", b"M4B ", b"M4P ")
HEIF_EXTENSIONS = ("heic", "heif", "hif", "avif", "avifs")
VIDEO_EXTENSIONS = (
    "mts", "m2ts", "mpeg", "mpg", "mkv", "webm", "mov", "mp4", "avi", "wmv", "asf", "flv", "m4v", "3gp", "3g2", "mxf",
    "vob", "ogv", "rm", "rmvb", "m2v",
)
AUDIO_EXTENSIONS = (
    "m4a", "mka", "mp3", "aac", "wav", "flac", "aiff", "opus", "ogg", "oga", "mp2", "wma", "ape", "wv", "caf", "au",
    "amr", "ac3", "eac3", "dts", "aif", "m4b", "ra",
)
PREFIX_BYTES = 512


def as_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def content_id(content: Column) -> Column:
    """sha256: and the digest of all bytes; null for null."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def _extension(name: Column) -> Column:
    """Lower-case extension of the last path component; none for dot files without another dot."""
    return F.lower(F.regexp_extract(name, r"(?:^|/)[^/]+\.([^./]*)$", 1))


def sniff(content: Column, name: Column) -> Column:
    """struct(family, format) from at most the first 512 bytes, then the extension.

    Content decides where it can: a PNG named .heic is a raster image, and text starting
    with BM or P1 is taken for one too. Null content is (unknown, unreadable), null or
    empty names have no extension, and what nothing else claims is UTF-8 text.
    """
    head = F.substring(content, 1, PREFIX_BYTES)
    at = lambda i, n: F.substring(head, i + 1, n)
    starts = lambda values: _any([F.startswith(head, F.lit(v)) for v in values])
    first, second, box, brand = at(0, 1), at(1, 1), at(4, 4), at(8, 4)
    box_end = F.least(F.conv(F.hex(at(0, 4)), 16, 10).cast("bigint"), F.octet_length(head).cast("bigint")).cast("int")
    count = F.greatest(F.floor((box_end - 16) / 4), F.lit(0)).cast("int")
    compatible = F.exists(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: (i < count) & F.substring(head, F.lit(17) + i * 4, F.lit(4)).isin(*IMAGE_BRANDS))
    riff, ogg, boxed = starts((b"RIFF",)), starts((b"OggS",)), box == F.lit(b"ftyp")
    mpeg = (first == F.lit(b"G")) & (at(188, 1) == F.lit(b"G")) & (at(376, 1) == F.lit(b"G"))
    ext = _extension(F.coalesce(name, F.lit("")))
    kind = lambda family, fmt: F.struct(F.lit(family).alias("family"), F.lit(fmt).alias("format"))
    return (
        F.when(content.isNull(), kind("unknown", "unreadable"))
        .when(starts((b"%PDF-",)), kind("text", "pdf"))
        .when(starts((b"PK\x03\x04",)), kind("text", "docx"))
        .when(starts(ARCHIVES), kind("unknown", "archive"))
        .when(starts(RASTERS), kind("image", "raster"))
        .when(riff & (brand == F.lit(b"WEBP")), kind("image", "raster"))
        .when(riff & (brand == F.lit(b"WAVE")), kind("audio", "media"))
        .when(riff & (brand == F.lit(b"AVI ")), kind("video", "media"))
        .when(riff, kind("unknown", "riff"))
        .when(starts(AUDIO_MAGIC) | ((first == F.lit(b"\xff")) & (second >= F.lit(b"\xe0"))), kind("audio", "media"))
        .when(ogg & F.contains(head, F.lit(b"theora")), kind("video", "media"))
        .when(ogg, kind("audio", "media"))
        .when(boxed & (brand.isin(*IMAGE_BRANDS) | compatible), kind("image", "heif_avif"))
        .when(boxed & brand.isin(*AUDIO_BRANDS), kind("audio", "media"))
        .when(boxed, kind("video", "media"))
        .when(starts(VIDEO_MAGIC) | (box == F.lit(b"moov")) | mpeg, kind("video", "media"))
        .when(ext == "tga", kind("image", "tga"))
        .when(ext.isin(*HEIF_EXTENSIONS), kind("image", "heif_avif"))
        .when(ext.isin(*VIDEO_EXTENSIONS), kind("video", "media"))
        .when(ext.isin(*AUDIO_EXTENSIONS), kind("audio", "media"))
        .otherwise(kind("text", "utf8"))
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def relative_path(path: Column, root: str) -> Column:
    """The path below `root`, which ends without a slash; null where it isn't below."""
    return F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30))


def path_order(path: Column) -> Column:
    """Component-wise order of paths: `a/b` comes before `a-b`."""
    return F.split(path, "/")


def path_json(path_bytes: Column) -> Column:
    """A path for JSON: the string where it is UTF-8, else base64 of its bytes, as JSON text."""
    plain = F.to_json(F.struct(F.decode(path_bytes, "UTF-8").alias("p")))
    wrapped = F.to_json(F.struct(F.lit("posix_bytes").alias("encoding"), F.base64(path_bytes).alias("base64")))
    return F.when(_utf8(path_bytes), F.regexp_extract(plain, r'(?s)^\{"p":(.*)\}$', 1)).otherwise(wrapped)


def _utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))
