"""ZIP containers and the documents inside them: DOCX and ODT metadata, with resource guards."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markers as m
from .batches import few

MOST_ENTRIES = 20_000
MOST_BYTES = 256 << 20

PEOPLE = ("cp:lastModifiedBy", "dc:contributor", "dc:creator", "dc:publisher")
MOMENTS = ("cp:lastPrinted", "dcterms:created", "dcterms:modified")
TOOLS = ("AppVersion", "Application", "Company", "LastAuthor", "Manager", "Template", "TotalTime")
ODT_META = {
    "dc:creator": "author", "dc:date": "timestamps", "meta:creation-date": "timestamps", "meta:editing-cycles": "device", "meta:editing-duration": "device",
    "meta:generator": "device", "meta:initial-creator": "author", "meta:print-date": "timestamps", "meta:printed-by": "author",
}


def read_zip(data: bytes) -> list[tuple[zipfile.ZipInfo, bytes]]:
    """Entries in order; raises ValueError on anything unreadable, or beyond the limits before it is inflated."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
                raise ValueError("beyond the expansion limit")
            if any(i.compress_type not in (0, 8) for i in infos):
                raise ValueError("a compression method that is not read")
            out, left = [], MOST_BYTES
            for i in infos:
                with z.open(i) as f:
                    body = f.read(left + 1)
                left -= len(body)
                if left < 0:
                    raise ValueError("beyond the expansion limit")
                out.append((i, body))
            return out
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError) as e:
        raise ValueError(str(e)) from e


def write_zip(entries: list[tuple[zipfile.ZipInfo, bytes]]) -> bytes:
    """Keeps order, method and stamps."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for info, body in entries:
            fresh = zipfile.ZipInfo(info.filename, info.date_time)
            fresh.compress_type, fresh.external_attr = info.compress_type, info.external_attr
            z.writestr(fresh, body)
    return out.getvalue()


def element(xml: str, tag: str) -> str | None:
    found = re.search(rf"<{re.escape(tag)}\b[^>]*>(.*?)</{re.escape(tag)}\s*>", xml, re.S | re.I)
    return found[1] if found else None


def _text(body: bytes) -> str:
    return body.decode("utf-8", "surrogateescape")


def _claims(xml: str) -> bool:
    return re.search(m.AI_NAME, xml) is not None or re.search(m.AI_VENDOR, xml) is not None


def inspect_docx(data: bytes) -> dict:
    out = {"c2pa": False, "ai": False, "privacy": set(), "findings": []}
    try:
        entries = read_zip(data)
    except ValueError:
        out["findings"].append(("docx.invalid", "informational", None))
        return out
    if any(i.filename.startswith("customXml/") for i, _ in entries):
        out["findings"].append(("docx.customxml", "informational", None))
    for info, body in entries:
        name = info.filename
        if not name.startswith(("docProps/", "customXml/")):
            continue
        xml = _text(body)
        if re.search("c2pa|contentcredential|jumbf", xml, re.I):
            out["c2pa"] = out["ai"] = True
            out["findings"].append(("docx.part.c2pa", "confirmed", name))
        elif _claims(xml):
            out["ai"] = True
            out["findings"].append(("docx.part.ai", "probable", name))
        for code, tags, label in (("docx.identity", PEOPLE, "author"), ("docx.app-metadata", TOOLS, "device"), ("docx.timestamps", MOMENTS, "timestamps")):
            named = [t for t in tags if (element(xml, t) or "").strip()]
            if named:
                out["privacy"].add(label)
                out["findings"].append((code, "confirmed", name))
    return out


def clean_docx(data: bytes) -> bytes:
    """Drops custom parts with what refers to them, and blanks people, moments and tools."""
    entries = read_zip(data)
    gone = {i.filename for i, _ in entries if i.filename.startswith("customXml/") or i.filename == "docProps/custom.xml"}
    out = []
    for info, body in entries:
        name = info.filename
        if name in gone:
            continue
        if name in ("docProps/core.xml", "docProps/app.xml"):
            xml = _text(body)
            for tag in (*PEOPLE, *MOMENTS, *TOOLS, "cp:revision"):
                xml = re.sub(rf"(<{re.escape(tag)}\b[^>]*>).*?(</{re.escape(tag)}\s*>)", r"\1\2", xml, flags=re.S | re.I)
            body = xml.encode("utf-8", "surrogateescape")
        elif gone and (name == "[Content_Types].xml" or name.endswith(".rels")):
            # References to what was dropped go too: an anti-join on part names.
            refers = lambda ref: any(ref.lstrip("/").removeprefix("../") == g or g.endswith("/" + ref.lstrip("/")) for g in gone)
            drop = lambda x: "" if refers(x[1]) else x[0]
            xml = re.sub(r'<Override\b[^>]*PartName="([^"]*)"[^>]*/>', drop, _text(body))
            body = re.sub(r'<Relationship\b[^>]*Target="([^"]*)"[^>]*/>', drop, xml).encode("utf-8", "surrogateescape")
        out.append((info, body))
    return write_zip(out)


def inspect_odt(data: bytes) -> dict:
    out = {"c2pa": False, "ai": False, "privacy": set(), "findings": []}
    try:
        entries = dict((i.filename, b) for i, b in read_zip(data))
    except ValueError:
        out["findings"].append(("odt.invalid", "informational", None))
        return out
    xml = _text(entries.get("meta.xml", b""))
    for tag, label in ODT_META.items():
        value = (element(xml, tag) or "").strip()
        if value:
            out["privacy"].add(label)
            out["findings"].append((f"odt.meta.{tag.replace(':', '.')}", "confirmed", "meta.xml"))
            out["ai"] |= tag == "meta:generator" and re.search(m.AI_VENDOR, value) is not None
    for name in re.findall(r'<meta:user-defined\b[^>]*meta:name="([^"]*)"', xml, re.I):
        out["findings"].append(("odt.meta.user-defined", "informational", "meta.xml"))
        out["ai"] |= re.search(m.AI_NAME, name) is not None
    if re.search("c2pa|contentcredential|jumbf", xml, re.I):
        out["c2pa"] = out["ai"] = True
        out["findings"].append(("odt.meta.c2pa", "confirmed", "meta.xml"))
    return out


def clean_odt(data: bytes) -> bytes:
    return write_zip([(i, re.sub(r"(<office:meta\b[^>]*>).*?(</office:meta\s*>)", r"\1\2", _text(b), flags=re.S | re.I).encode("utf-8", "surrogateescape") if i.filename == "meta.xml" else b) for i, b in read_zip(data)])


def document_format(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
    except (zipfile.BadZipFile, OSError, ValueError):
        return "unknown"
    return "docx" if "word/document.xml" in names else "odt" if {"content.xml", "meta.xml"} <= names else "unknown"


def inspect_document(data: bytes | None) -> tuple[str, dict]:
    """The format of one file and what is found in it."""
    kind = document_format(data or b"")
    return kind, {"docx": inspect_docx, "odt": inspect_odt}[kind](data) if kind != "unknown" else {"c2pa": False, "ai": False, "privacy": set(), "findings": []}


def clean_document(data: bytes | None) -> tuple[bytes | None, str | None]:
    """The cleaned file, or why there is none."""
    try:
        return {"docx": clean_docx, "odt": clean_odt}[document_format(data or b"")](data), None
    except (KeyError, ValueError) as e:
        return None, str(e)


def listed(data: bytes | None) -> list[tuple[int, str, int, int]]:
    """(ord, entry, size, crc) of every entry, without inflating any; none of a file that can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            return [(n, i.filename, i.file_size, i.CRC) for n, i in enumerate(z.infolist()[:MOST_ENTRIES])]
    except (zipfile.BadZipFile, OSError, ValueError):
        return []


def inspect_documents(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, format, has_c2pa, has_ai_metadata, privacy, findings) per DOCX or ODT file."""

    def run(batches):
        for b in few(batches):
            rows = []
            for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind, s = inspect_document(data)
                rows.append((k, kind, s["c2pa"], s["ai"], sorted(s["privacy"]), [f"{code}:{confidence}" for code, confidence, _ in s["findings"]]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "format", "has_c2pa", "has_ai_metadata", "privacy", "findings"])

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, f"`{key}` string, format string, has_c2pa boolean, has_ai_metadata boolean, privacy array<string>, findings array<string>")


def clean_documents(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, output, error) per file."""

    def run(batches):
        for b in few(batches):
            rows = [(k, *clean_document(data)) for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.string()), strict=True)], names=[key, "output", "error"])

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, f"`{key}` string, output binary, error string")


def zip_entries(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, ord, entry, size, crc) of every readable entry, without inflating any."""

    def run(batches):
        for b in few(batches):
            rows = [(k, *e) for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True) for e in listed(data)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[key, "ord", "entry", "size", "crc"])

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, f"`{key}` string, ord int, entry string, size long, crc long")


def cleaned_documents(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, findings, entries) of what cleaning each file leaves, by one worker; files that can't be cleaned have none."""

    def run(batches):
        for b in few(batches):
            rows = []
            for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                output, _ = clean_document(data)
                _, s = inspect_document(output)
                rows.append((k, [f"{code}:{confidence}" for code, confidence, _ in s["findings"]], len(listed(output))))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.string()), pa.int64()), strict=True)], names=[key, "findings", "entries"])

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, f"`{key}` string, findings array<string>, entries long").filter("entries > 0")
