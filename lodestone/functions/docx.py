"""Body text of word-processing packages, with the limits of an untrusted input."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import TextFailure

#: Both namespaces of body text.
NAMESPACES = ("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main")
PARTS = ("[Content_Types].xml", "word/document.xml")
MAX_ENTRIES, MAX_DIRECTORY, MAX_TEXT, MAX_DEPTH = 4096, 8 << 20, 32 << 20, 256
HIDDEN = ("del", "txbxContent")
END_MARK, END_SIZE = b"PK\x05\x06", 22


def directory_end(content: bytes) -> bytes:
    """The record that ends the package: the last one whose comment reaches the end."""
    at = len(content)
    while (at := content.rfind(END_MARK, max(0, len(content) - END_SIZE - 0xFFFF), at)) >= 0:
        record = content[at : at + END_SIZE]
        if len(record) == END_SIZE and at + END_SIZE + struct.unpack("<H", record[-2:])[0] == len(content):
            return record
    raise TextFailure("decode_failed", "the package doesn't end with its directory")


def check_package(content: bytes) -> zipfile.ZipFile:
    """An opened package: single volume, not ZIP64, bounded, without repeated names."""
    disk, start_disk, here, entries, size, offset, _ = struct.unpack("<4H2IH", directory_end(content)[4:])
    if disk or start_disk or entries == 0xFFFF:
        raise TextFailure("unsupported_format", "more than one volume, or ZIP64")
    if here != entries or 0xFFFFFFFF in (size, offset):
        raise TextFailure("decode_failed", "the directory contradicts itself")
    if entries > MAX_ENTRIES or size > MAX_DIRECTORY:
        raise TextFailure("resource_budget_too_small", "too large a directory")
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError) as e:
        raise TextFailure("decode_failed", str(e)) from None
    names = package.namelist()
    if len(names) != len(set(names)) or len(names) != entries:
        raise TextFailure("decode_failed", "repeated names")
    if not set(PARTS) <= set(names):
        raise TextFailure("unsupported_format", "no word-processing package")
    return package


def body_text(xml: bytes) -> str:
    """Text of the body in document order: tabs, breaks and ends of paragraphs kept.

    The root must be a document and hold a body; of several bodies the first counts. What
    lies outside it, deletions and text boxes give nothing.
    """
    out: list[str] = []
    path: list[str | None] = []
    hidden = in_text = size = bodies = 0
    inside = False

    def local(name: str) -> str | None:
        space, _, tag = name.rpartition("}")
        return tag if space in NAMESPACES else None

    def start(name: str, _attributes) -> None:
        nonlocal hidden, in_text, inside, bodies
        tag = local(name)
        path.append(tag)
        if len(path) > MAX_DEPTH:
            raise TextFailure("resource_budget_too_small", "nested too deeply")
        if len(path) == 1 and tag != "document":
            raise TextFailure("decode_failed", "the root is no document")
        if path == ["document", "body"]:
            bodies += 1
            inside = bodies == 1
        elif tag in HIDDEN:
            hidden += 1
        elif tag == "t":
            in_text += 1
        elif tag in ("tab", "br", "cr") and inside and not hidden:
            out.append("\t" if tag == "tab" else "\n")

    def end(name: str) -> None:
        nonlocal hidden, in_text, inside
        tag = local(name)
        if path == ["document", "body"]:
            inside = False
        path.pop()
        if tag in HIDDEN:
            hidden -= 1
        elif tag == "t":
            in_text -= 1
        elif tag == "p" and inside and not hidden:
            out.append("\n")

    def data(text: str) -> None:
        nonlocal size
        if in_text and inside and not hidden:
            size += len(text.encode())
            if size > MAX_TEXT:
                raise TextFailure("resource_budget_too_small", "too much text")
            out.append(text)

    def refuse(*_) -> None:
        raise TextFailure("decode_failed", "document types are refused")

    parser = expat.ParserCreate("UTF-8", namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise TextFailure("decode_failed", str(e)) from None
    if not bodies:
        raise TextFailure("decode_failed", "no body")
    return "".join(out)


def docx_text(content: bytes) -> str:
    package = check_package(content)
    try:
        with package.open(PARTS[1]) as f:
            xml = f.read(MAX_TEXT + 1)
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
        raise TextFailure("decode_failed", str(e)) from None
    if len(xml) > MAX_TEXT:
        raise TextFailure("resource_budget_too_small", "too large a document")
    return body_text(xml)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def package_texts(contents: pd.Series) -> pd.DataFrame:
    """Body text of packages, or the code of what is wrong with them; null for null."""
    out = []
    for content in contents:
        try:
            out.append((None if content is None else docx_text(content), None))
        except TextFailure as e:
            out.append((None, e.code))
    return pd.DataFrame(out, columns=["text", "error"])
