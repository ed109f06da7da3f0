"""PNG, JPEG, WebP and EXIF metadata: walk, inspect and strip, over bytes.

The walkers are generators over byte slices; ``inspect`` and ``strip`` dispatch by magic. A bad
file never fails a job: its error is a column. ``inspect_images`` and ``strip_images`` run them
Arrow-batched; ``image_parts`` lists the parts of each file as rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markers as m
from .batches import few

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PNG_KEEP = frozenset("IDAT IEND IHDR PLTE acTL bKGD cHRM fcTL fdAT gAMA hIST iCCP pHYs sBIT sPLT sRGB tRNS".split())
PNG_TEXT = frozenset(("tEXt", "zTXt", "iTXt"))
PNG_META = PNG_TEXT | {"eXIf", "tIME"}
PNG_WORDS = ("author", "comment", "copyright", "creation time", "disclaimer", "software", "source", "warning")
WEBP_FLAGS = {"ICCP": 0x20, "EXIF": 0x08, "XMP ": 0x04}
EXIF_HEAD = b"Exif\0\0"
SCAN_WINDOW = 4 << 20

#: tag -> (name, what it gives away)
TAGS = {
    0x10F: ("Make", "device"), 0x110: ("Model", "device"), 0x131: ("Software", ""), 0x132: ("DateTime", "timestamps"), 0x13B: ("Artist", "author"), 0x13C: ("HostComputer", "device"),
    0x2BC: ("XMP", ""), 0x8298: ("Copyright", "author"), 0x83BB: ("IPTC", ""), 0x8769: ("ExifIFDPointer", ""), 0x8825: ("GPSInfoIFDPointer", "location"),
}
SUB_TAGS = {
    0x9003: ("DateTimeOriginal", "timestamps"), 0x9004: ("DateTimeDigitized", "timestamps"), 0x927C: ("MakerNote", "device"), 0x9286: ("UserComment", ""), 0xA005: ("InteroperabilityIFDPointer", ""),
    0xA430: ("CameraOwnerName", "author"), 0xA431: ("BodySerialNumber", "device"), 0xA433: ("LensMake", "device"), 0xA434: ("LensModel", "device"), 0xA435: ("LensSerialNumber", "device"), 0xC62F: ("CameraSerialNumber", "device"),
}
GIVEN_AWAY = {tag: what for table in (TAGS, SUB_TAGS) for tag, (_, what) in table.items() if what}


@dataclass
class Scan:
    c2pa: bool = False
    ai: bool = False
    findings: list[tuple[str, str, int]] = field(default_factory=list)  # code, confidence, offset
    privacy: set[str] = field(default_factory=set)

    def found(self, code: str, confidence: str, at: int) -> None:
        self.findings.append((code, confidence, at))


def view(data: bytes) -> str:
    return "".join(chr(b) if 32 <= b <= 126 else "." for b in data).lower()


def private(text: str) -> set[str]:
    return {label for label, needles in m.PRIVACY.items() if any(n in text for n in needles)}


def marked(text: str) -> tuple[bool, list[str]]:
    """(whether a content-credentials marker is there, all markers)"""
    own = [x for x in m.C2PA if x in text]
    return bool(own), own + [x for x in m.PROVENANCE if x in text and x not in own]


def weight(hits: list[str]) -> str:
    return "confirmed" if any(h in m.CLAIMS for h in hits) else "probable"


def exif(data: bytes) -> tuple[bool, list[str], set[str]]:
    """(parsed, sorted tag names, what they give away) of a TIFF block."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if len(data) < 8 or order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return False, [], set()
    names: set[str] = set()
    away: set[str] = set()
    seen: set[int] = set()
    todo = [(struct.unpack_from(order + "I", data, 4)[0], TAGS, 0)]
    while todo:
        at, table, depth = todo.pop()
        if depth > 8 or at < 8 or at + 2 > len(data) or at in seen:
            continue
        seen.add(at)
        count = min(512, struct.unpack_from(order + "H", data, at)[0])
        end = at + 2 + 12 * count
        if end > len(data):
            continue
        for k in range(count):
            tag, _, _, value = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
            if tag in table:
                names.add(table[tag][0])
            if tag in GIVEN_AWAY:
                away.add(GIVEN_AWAY[tag])
            if tag in (0x8769, 0xA005):
                todo.append((value, SUB_TAGS, depth + 1))
            elif tag == 0x8825:
                names.add("GPSInfo")
        if end + 4 <= len(data) and (following := struct.unpack_from(order + "I", data, end)[0]):
            todo.append((following, table, depth + 1))
    return True, sorted(names), away


def png_parts(data: bytes) -> Iterator[tuple[str, int, bytes, bool]]:
    """(type, offset, payload, whether the checksum holds); ends after IEND or where the file breaks off."""
    at = 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            return
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        yield kind.decode("latin-1"), at, body, zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        if kind == b"IEND":
            return
        at += 12 + size


def _png_c2pa(kind: str) -> bool:
    return kind in ("caBX", "juMB", "jumb") or kind.startswith("c2")


def inspect_png(data: bytes) -> Scan:
    s = Scan()
    for kind, at, body, _ in png_parts(data):
        if _png_c2pa(kind):
            s.c2pa = s.ai = True
            s.found("png.chunk.c2pa", "confirmed", at)
        elif kind == "eXIf":
            s.privacy |= exif(body)[2]
            s.found("png.chunk.exif", "confirmed", at)
        elif kind == "tIME":
            s.privacy.add("timestamps")
            s.found("png.chunk.time", "confirmed", at)
        elif kind in PNG_TEXT:
            text = view(body)
            credentials, hits = marked(text)
            s.c2pa |= credentials
            s.ai |= any(h in m.PROVENANCE for h in hits)
            if hits:
                s.found("png.chunk.text.ai", weight(hits), at)
            s.privacy |= private(text)
            key = body.partition(b"\0")[0] if b"\0" in body else body[:79]
            key = key.decode("latin-1").lower()
            if any(w in key for w in PNG_WORDS):
                if "author" in key or "copyright" in key:
                    s.privacy.add("author")
                if "creation time" in key:
                    s.privacy.add("timestamps")
                s.found("png.chunk.text.identity", "confirmed", at)
    return s


def strip_png(data: bytes, everything: bool = True) -> tuple[bytes, dict[str, int]]:
    out, gone, seen = [PNG_MAGIC], {}, False
    for kind, _, body, _ in png_parts(data):
        seen = True
        credentials, hits = marked(view(body)) if kind not in PNG_KEEP else (False, [])
        drop = _png_c2pa(kind) or (everything or bool(hits) if kind in PNG_META else kind not in PNG_KEEP and credentials)
        if drop:
            gone[kind] = gone.get(kind, 0) + 1
        else:
            tag = kind.encode("latin-1")
            out.append(len(body).to_bytes(4, "big") + tag + body + zlib.crc32(tag + body).to_bytes(4, "big"))
    if not seen:
        raise ValueError("no readable chunk")
    return b"".join(out), gone


def jpeg_parts(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, offset, payload) up to the start of scan, which comes last."""
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return
        start = at
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return
        kind = data[at]
        at += 1
        if kind == 0xDA:
            yield kind, start, b""
            return
        if kind in (0x01, 0xD8, 0xD9) or 0xD0 <= kind <= 0xD7:
            yield kind, start, b""
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            return
        yield kind, start, data[at + 2 : at + size]
        at += size


def inspect_jpeg(data: bytes) -> Scan:
    s = Scan()
    for kind, at, body in jpeg_parts(data):
        if kind == 0xEB:
            s.c2pa = s.ai = True
            s.found("jpeg.app11.jumbf", "confirmed", at)
        elif kind == 0xFE:
            s.privacy |= private(view(body))
            s.found("jpeg.com", "informational", at)
        elif kind == 0xE1 and body.startswith(EXIF_HEAD):
            s.privacy |= exif(body[6:])[2]
            s.found("jpeg.app1.exif", "confirmed", at)
        elif 0xE0 <= kind <= 0xEF:
            text = view(body)
            credentials, hits = marked(text)
            s.c2pa |= credentials
            s.ai |= any(h in m.PROVENANCE for h in hits)
            if hits:
                s.found("jpeg.app.markers", weight(hits), at)
            s.privacy |= private(text)
            if kind == 0xE1 and "xmpmeta" in text:
                s.found("jpeg.app1.xmp", "informational", at)
            if kind == 0xED:
                s.privacy.add("author")
                s.found("jpeg.app13.iptc", "confirmed", at)
    return s


def strip_jpeg(data: bytes, everything: bool = True) -> tuple[bytes, dict[str, int]]:
    out, gone, scan = [b"\xff\xd8"], {}, None
    for kind, at, body in jpeg_parts(data):
        app = 0xE0 <= kind <= 0xEF
        if kind == 0xDA:
            scan = at
        elif kind in (0xEB, 0xFE) or app and kind not in (0xE0, 0xEE) and (everything or marked(view(body))[1]):
            name = "COM" if kind == 0xFE else f"APP{kind - 0xE0}"
            gone[name] = gone.get(name, 0) + 1
        elif kind != 0xD8:
            out.append(bytes((0xFF, kind)) + ((len(body) + 2).to_bytes(2, "big") + body if body or app else b""))
    if scan is None:
        raise ValueError("no start of scan")
    return b"".join([*out, data[scan:]]), gone


def webp_parts(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(type, offset, payload); a file that breaks off or has a tail raises when read to its end."""
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            raise ValueError("a chunk breaks off")
        yield data[at : at + 4].decode("latin-1"), at, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if at < len(data):
        raise ValueError("bytes after the last chunk")


def _webp_readable(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    try:
        yield from webp_parts(data)
    except ValueError:
        return


def inspect_webp(data: bytes) -> Scan:
    s = Scan()
    for kind, at, body in _webp_readable(data):
        if kind.upper() == "C2PA":
            s.c2pa = s.ai = True
            s.found("webp.chunk.c2pa", "confirmed", at)
        elif kind == "EXIF":
            s.privacy |= exif(body)[2]
            s.found("webp.chunk.exif", "confirmed", at)
        elif kind == "XMP ":
            text = view(body)
            credentials, hits = marked(text)
            s.c2pa |= credentials
            s.ai |= bool(hits)
            s.privacy |= private(text)
            s.found("webp.chunk.xmp.markers" if hits else "webp.chunk.xmp", weight(hits) if hits else "informational", at)
    return s


def strip_webp(data: bytes, everything: bool = True, colour: bool = False) -> tuple[bytes, dict[str, int]]:
    kept, gone, cleared = [], {}, 0
    for kind, _, body in webp_parts(data):
        drop = kind.upper() == "C2PA" or kind in ("EXIF", "XMP ") and (everything or bool(marked(view(body))[1])) or kind == "ICCP" and colour
        if drop:
            gone[kind.strip()] = gone.get(kind.strip(), 0) + 1
            cleared |= WEBP_FLAGS.get(kind, 0)
        else:
            kept.append((kind, body))
    body = b"WEBP"
    for kind, x in kept:
        if kind == "VP8X" and x:
            x = bytes((x[0] & ~cleared,)) + x[1:]
        body += kind.encode("latin-1") + len(x).to_bytes(4, "little") + x + b"\0" * (len(x) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body, gone


def image_format(data: bytes) -> str:
    if data.startswith(PNG_MAGIC):
        return "png"
    if data.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else "unknown"


INSPECT = {"png": inspect_png, "jpeg": inspect_jpeg, "webp": inspect_webp}
STRIP = {"png": strip_png, "jpeg": strip_jpeg, "webp": strip_webp}


def inspect(data: bytes) -> tuple[str, Scan]:
    kind = image_format(data)
    s = INSPECT[kind](data) if kind in INSPECT else Scan()
    if not s.c2pa:
        hits = [x for x in m.C2PA if x in view(data[:SCAN_WINDOW])]
        if hits:  # raw bytes prove nothing, but they set the flag
            s.c2pa = True
            s.found("image.bytescan.c2pa", "likely-false-positive", 0)
    return kind, s


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def inspect_images(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, format, has_c2pa, has_ai_metadata, privacy, findings) per file."""
    found = pa.struct([("code", pa.string()), ("confidence", pa.string()), ("offset", pa.int64())])
    kind = pa.schema([("key", pa.string()), ("format", pa.string()), ("has_c2pa", pa.bool_()), ("has_ai_metadata", pa.bool_()), ("privacy", pa.list_(pa.string())), ("findings", pa.list_(found))])

    def run(batches):
        for b in few(batches):
            rows = []
            for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name, s = inspect(data or b"")
                rows.append((k, name, s.c2pa, s.ai, sorted(s.privacy), [dict(zip(("code", "confidence", "offset"), f, strict=True)) for f in s.findings]))
            yield _arrow(rows, kind)

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, f"`{key}` string, format string, has_c2pa boolean, has_ai_metadata boolean, privacy array<string>, findings array<struct<code:string,confidence:string,offset:bigint>>")


def strip_images(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, output, dropped, error) per file; an unreadable file keeps no output and says why."""
    kind = pa.schema([("key", pa.string()), ("output", pa.binary()), ("dropped", pa.map_(pa.string(), pa.int32())), ("error", pa.string())])

    def run(batches):
        for b in few(batches):
            rows = []
            for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = data or b""
                try:
                    out, gone = STRIP[image_format(data)](data)
                    rows.append((k, out, list(gone.items()), None))
                except (KeyError, ValueError) as e:
                    rows.append((k, None, [], str(e)))
            yield _arrow(rows, kind)

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, f"`{key}` string, output binary, dropped map<string,int>, error string")


def image_parts(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, ord, part, offset, length): the chunks or segments of every file."""
    kind = pa.schema([("key", pa.string()), ("ord", pa.int32()), ("part", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for b in few(batches):
            rows = []
            for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = data or b""
                form = image_format(data)
                parts = [(p[0], p[1], len(p[2])) for p in png_parts(data)] if form == "png" else [(f"{p[0]:02X}", p[1], len(p[2])) for p in jpeg_parts(data)] if form == "jpeg" else [(p[0], p[1], len(p[2])) for p in _webp_readable(data)] if form == "webp" else []
                rows += [(k, n, *p) for n, p in enumerate(parts)]
            yield _arrow(rows, kind)

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, f"`{key}` string, ord int, part string, offset long, length long")
