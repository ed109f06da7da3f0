"""Routing of raw bytes: what they look like, which operators own them, and the byte-exact text codec."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StringType

from .archives import document_format
from .web import KINDS

SNIFFED = 8192
#: First bytes in hex, and what they say; the first match decides.
MAGIC = [
    ("504B0304", "a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB, JAR)"),
    ("504B0506", "an empty ZIP container"),
    ("504B0708", "a spanned ZIP container"),
    ("255044462D", "a PDF"),
    ("89504E470D0A1A0A", "a PNG image"),
    ("FFD8FF", "a JPEG image"),
    ("474946383761", "a GIF image"),
    ("474946383961", "a GIF image"),
    ("49492A00", "a TIFF image"),
    ("4D4D002A", "a TIFF image"),
    ("52494646", "a RIFF container (WebP, WAV, AVI)"),
    ("4F676753", "an Ogg media file"),
    ("1F8B", "a gzip archive"),
    ("425A68", "a bzip2 archive"),
    ("FD377A585A00", "an xz archive"),
    ("377ABCAF271C", "a 7-Zip archive"),
    ("526172211A07", "a RAR archive"),
    ("7F454C46", "an ELF binary"),
    ("CAFEBABE", "a Java class or Mach-O fat binary"),
    ("D0CF11E0A1B11AE1", "a legacy Office document (.doc, .xls, .ppt)"),
    (b"SQLite format 3\0".hex().upper(), "a SQLite database"),
    ("38425053", "a Photoshop document"),
    ("774F4646", "a WOFF font"),
    ("774F4632", "a WOFF2 font"),
    ("4F54544F", "an OpenType font"),
]


def sniff_binary(content: Column) -> Column:
    """Why bytes are no plausible text; null: they are one. Empty and null content is text."""
    start = F.hex(F.substring(content, 1, 16))
    out = F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, F.lit(None).cast("string"))
    for magic, label in MAGIC:
        out = out.when(start.startswith(magic), label)
    head = F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")
    controls = F.regexp_count(head, F.lit(r"[\x01-\x08\x0E-\x1A\x1C-\x1F]"))
    out = out.when(head.contains("\0"), "binary data (contains NUL bytes)")
    return out.when(controls / F.char_length(head) > 0.05, "binary data (dense in control bytes)")


@pandas_udf(StringType())
def _office(content: pd.Series) -> pd.Series:
    return content.map(lambda x: document_format(x) if x is not None else "unknown")


def extension(name: Column) -> Column:
    """The last dot and what follows it, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)\.[^.]*$", 0))


def classify(content: Column, name: Column) -> Column:
    """image, container or text. A known extension decides, then the bytes."""
    ext = extension(name)
    out = F.when(ext.isin(KINDS["image"]), "image").when(ext.isin(KINDS["container"]), "container").when(ext.isin(KINDS["text"]), "text")
    start = F.hex(F.substring(content, 1, 12))
    image = start.startswith("89504E470D0A1A0A") | start.startswith("FFD8FF") | (start.startswith("52494646") & start.endswith("57454250"))
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), r"^(?:\xEF\xBB\xBF|\s)+", ""))
    markup = head.contains("<svg") | head.startswith("<!doctype html") | head.startswith("<html")
    # Only what begins as an archive is opened.
    office = F.when(start.startswith("504B"), _office(F.when(start.startswith("504B"), content)) != "unknown").otherwise(False)
    return out.when(image, "image").when(start.startswith("255044462D") | office | markup, "container").otherwise("text")


def guard_text(content: Column, label: Column, force: bool = False) -> Column:
    """Why content is refused as text, as a column rather than an exception; null: accepted."""
    if force:
        return F.lit(None).cast("string")
    return F.concat(F.lit("refusing to treat "), label, F.lit(" as text: it looks like "), sniff_binary(content))


def through_codec(fn: Callable[[str], str]):
    """A column function over bytes: fn works on text in which each undecodable byte is one of U+DC80..U+DCFF, which become that byte again.

    Such text is no valid Unicode, so it exists inside the function only; what goes in and comes out are bytes.
    A surrogate that fn itself makes outside that range becomes U+FFFD. Null stays null.
    """

    def run(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        out = fn(bytes(data).decode("utf-8", "surrogateescape"))
        return "".join("�" if "\ud800" <= c <= "\udc7f" or "\udd00" <= c <= "\udfff" else c for c in out).encode("utf-8", "surrogateescape")

    @pandas_udf(BinaryType())
    def mapped(content: pd.Series) -> pd.Series:
        return content.map(run)

    return mapped


@pandas_udf(LongType())
def escaped_bytes(content: pd.Series) -> pd.Series:
    """How many bytes of the content are no UTF-8."""
    return content.map(lambda x: None if x is None else sum("\udc80" <= c <= "\udcff" for c in bytes(x).decode("utf-8", "surrogateescape")))


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form. Null stays null."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc_change(before: Column, after: Column) -> Column:
    """What the normal form counts as a change: the difference in length, 1 at least, 0 where nothing changed."""
    return F.when(before == after, 0).otherwise(F.greatest(F.lit(1), F.abs(F.char_length(after) - F.char_length(before))))


def gunzipped(most: int = 64 << 20):
    """A column function: gzip content inflated, other content as it is, null where it is broken or exceeds the limit."""

    def run(data: bytes | None) -> bytes | None:
        if data is None or data[:2] != b"\x1f\x8b":
            return data
        try:
            d = zlib.decompressobj(31)
            out = d.decompress(bytes(data), most + 1)
            return out if d.eof and len(out) <= most else None
        except zlib.error:
            return None

    @pandas_udf(BinaryType())
    def mapped(content: pd.Series) -> pd.Series:
        return content.map(run)

    return mapped


def inflated(raw: bool = False, most: int = 256 << 20):
    """A column function: deflate streams inflated; those with a zlib header may lack it after all. Null where broken or too large."""

    def one(data: bytes, bits: int) -> bytes | None:
        try:
            d = zlib.decompressobj(bits)
            out = d.decompress(data, most + 1)
            return out if d.eof and len(out) <= most else None
        except zlib.error:
            return None

    def run(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        out = None if raw else one(bytes(data), 15)
        return one(bytes(data), -15) if out is None else out

    @pandas_udf(BinaryType())
    def mapped(content: pd.Series) -> pd.Series:
        return content.map(run)

    return mapped


def safe_filename(name: Column) -> Column:
    """The last part of a path with either slash, 255 characters at most; null for none, '.' and '..'."""
    base = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    return F.when(~base.isin("", ".", ".."), F.substring(base, 1, 255))


def cleaned_path(path: Column, suffix: str = ".cleaned") -> Column:
    """Puts the suffix before the extension. A leading dot of a file name begins no extension."""
    return F.regexp_replace(path, r"(?s)^(.*?)((?<=[^/])\.[^./]*)?$", F.concat(F.lit("$1"), F.lit(suffix), F.lit("$2")))
