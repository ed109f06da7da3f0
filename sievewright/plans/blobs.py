"""Binary inputs built in code, one per number: no binary file is checked in."""

from __future__ import annotations

import struct
import zlib

from ..operators.images import PNG_MAGIC


def chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def png(*extra: tuple[bytes, bytes]) -> bytes:
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0))
    return PNG_MAGIC + head + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", zlib.compress(b"\0" * 5)) + chunk(b"IEND", b"")


def tiff(*entries: tuple[int, int]) -> bytes:
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in entries) + struct.pack("<I", 0)


def jpeg(*segments: tuple[int, bytes]) -> bytes:
    part = lambda kind, body: bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body
    return b"\xff\xd8" + b"".join(part(*s) for s in segments) + part(0xC0, b"\x08\0\x01\0\x01\x01\x01\x11\0") + part(0xDA, b"\x01\x01\0\0\x3f\0") + b"\x12\x34\x56\x78\xff\xd9"


def webp(*extra: tuple[bytes, bytes]) -> bytes:
    flags = sum({b"ICCP": 0x20, b"EXIF": 0x08, b"XMP ": 0x04}.get(k, 0) for k, _ in extra)
    part = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    body = b"WEBP" + part(b"VP8X", bytes((flags,)) + b"\0" * 9) + part(b"VP8 ", b"\x01\x02\x03") + b"".join(part(*e) for e in extra)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


EXIF = tiff((0x10F, 1), (0x8825, 2), (0x13B, 3))


def image(n: int) -> bytes:
    """The n-th test image; its kind and metadata follow from n alone."""
    form, what = n % 3, n // 3 % 4
    if form == 0:
        return png(*[[], [(b"eXIf", EXIF)], [(b"tEXt", b"Author\0me"), (b"tIME", b"\x07\xe8\x01\x01\0\0\0")], [(b"caBX", b"x"), (b"iTXt", b"k\0\0\0\0\0digitalSourceType")]][what])
    if form == 1:
        return jpeg(*[[(0xE0, b"JFIF\0")], [(0xE1, b"Exif\0\0" + EXIF)], [(0xFE, b"by artist"), (0xED, b"8BIM")], [(0xEB, b"JP"), (0xE1, b"http://ns\0<x:xmpmeta midjourney>")]][what])
    return webp(*[[], [(b"EXIF", EXIF)], [(b"XMP ", b"<x tiff:make='a'/>")], [(b"C2PA", b"q"), (b"XMP ", b"synthid")]][what])


def archive(parts: dict[str, str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            info = zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6))
            info.compress_type = 0 if name == "mimetype" else 8
            z.writestr(info, body)
    return out.getvalue()


def office(n: int) -> bytes:
    """The n-th test document: DOCX and ODT by turns, metadata by n // 2 % 3."""
    what = n // 2 % 3
    if n % 2:
        meta = ["", "<dc:creator>me</dc:creator><dc:date>2020</dc:date>", '<meta:generator>ChatGPT</meta:generator><meta:user-defined meta:name="k">v</meta:user-defined>'][what]
        return archive({"mimetype": "application/vnd.oasis.opendocument.text", "meta.xml": f"<office:meta>{meta}</office:meta>", "content.xml": "<t>body</t>"})
    core = ["<dc:creator></dc:creator>", "<dc:creator>me</dc:creator><dcterms:created>2020</dcterms:created>", "<dc:creator>me</dc:creator>"][what]
    parts = {"[Content_Types].xml": '<Types><Override PartName="/customXml/item1.xml" ContentType="x"/><Override PartName="/word/document.xml" ContentType="y"/></Types>', "word/document.xml": "<w>body</w>", "docProps/core.xml": core}
    if what == 2:
        parts["customXml/item1.xml"] = "<a>synthid</a>"
    return archive(parts)
