"""Routing against hand-written expectations."""

import gzip
import io
import zipfile
import zlib

from pyspark.sql import functions as F

from sievewright.operators import routing, web
from sievewright.sources import files


def office(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def test_sniff_and_classify(spark):
    rows = [
        (b"", None, None, "text"), (None, None, None, "text"), (b"plain", None, None, "text"), (b"a\0b", None, "binary data (contains NUL bytes)", "text"),
        (b"\x01" * 6 + b"a" * 94, None, "binary data (dense in control bytes)", "text"), (b"\x01" * 5 + b"a" * 95, None, None, "text"),
        (b"\t\n\x0b\x0c\r\x1b", None, None, "text"), (b"a" * 8192 + b"\0", None, None, "text"),
        (b"GIF89a", "x.md", "a GIF image", "container"), (b"<html>", "a.TXT", None, "text"), (b"\n <HTML>", "noext", None, "container"),
        (b"\xef\xbb\xbf<html>", None, None, "container"), (b"x <svg", "a.unknown", None, "container"), (b"RIFF1234WEBP", None, "a RIFF container (WebP, WAV, AVI)", "image"),
        (office("word/document.xml"), None, "a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB, JAR)", "container"), (office("content.xml"), None, "a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB, JAR)", "text"),
        (office("content.xml", "meta.xml"), "dir.png/x", "a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB, JAR)", "container"), (b"PK", None, None, "text"), (b"%PDF-1", None, "a PDF", "container"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, raw binary, name string, looks string, kind string")
    got = df.select("k", routing.sniff_binary(F.col("raw")).alias("looks"), routing.classify(F.col("raw"), F.col("name")).alias("kind"), routing.guard_text(F.col("raw"), F.lit("it")).alias("no"), routing.guard_text(F.col("raw"), F.lit("it"), True).alias("forced")).orderBy("k").collect()
    assert [(x.looks, x.kind) for x in got] == [r[2:] for r in rows]
    assert got[3].no == "refusing to treat it as text: it looks like binary data (contains NUL bytes)"
    assert got[2].no is None and all(x.forced is None for x in got)


def test_codec_keeps_every_byte(spark):
    raw = [bytes(range(256)), b"\xed\xa0\x80", b"\xc0\x80ok\xf5\xff", "né\U0001f525".encode(), b"", None]
    df = spark.createDataFrame(list(enumerate(raw)), "k int, raw binary")
    same, upper = routing.through_codec(lambda t: t), routing.through_codec(lambda t: t.replace("o", "O") + "\ud800")
    got = df.select("k", same("raw").alias("same"), upper("raw").alias("upper"), routing.escaped_bytes("raw").alias("n")).orderBy("k").collect()
    assert [None if x.same is None else bytes(x.same) for x in got] == raw
    assert [x.n for x in got] == [128, 3, 4, 0, 0, None]
    assert bytes(got[2].upper) == b"\xc0\x80Ok\xf5\xff" + "�".encode()


def test_streams_and_names(spark):
    raw = zlib.compressobj(wbits=-15)
    bare = raw.compress(b"abc" * 50) + raw.flush()
    rows = [gzip.compress(b"abc"), b"abc", gzip.compress(b"x" * 200), gzip.compress(b"abc")[:-9], None, bare, zlib.compress(b"abc")]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, raw binary")
    got = df.select(routing.gunzipped(100)("raw").alias("g"), routing.inflated()("raw").alias("i"), routing.inflated(True)("raw").alias("r")).orderBy("k").collect()
    b = lambda x: None if x is None else bytes(x)
    assert [b(x.g) for x in got] == [b"abc", b"abc", None, None, None, bare, zlib.compress(b"abc")]
    assert [b(x.i) for x in got][4:] == [None, b"abc" * 50, b"abc"] and [b(x.r) for x in got][5:] == [b"abc" * 50, None]
    names = ["a\\b/c.md", "", "..", "x" * 300, None, "dir/"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    assert [x[0] for x in df.orderBy("k").select(routing.safe_filename(F.col("name"))).collect()] == ["c.md", None, None, "x" * 255, None, None]
    paths = ["notes.md", "a.b/notes", "a/.env", "x.tar.gz", "a/b.c/d.e"]
    df = spark.createDataFrame(list(enumerate(paths)), "k int, p string")
    assert [x[0] for x in df.orderBy("k").select(routing.cleaned_path(F.col("p"))).collect()] == ["notes.cleaned.md", "a.b/notes.cleaned", "a/.env.cleaned", "x.tar.cleaned.gz", "a/b.c/d.cleaned.e"]
    df = spark.createDataFrame([("ﬁＡ",), ("plain",), (None,)], "t string").withColumn("n", routing.nfkc("t"))
    assert [(x.n, x.c) for x in df.select("n", routing.nfkc_change(F.col("t"), F.col("n")).alias("c")).collect()][:2] == [("fiA", 1), ("plain", 0)]


def test_scan(spark, tmp_path):
    for name, size in {"a.md": 3, "b.bin": 3, ".env.txt": 3, "big.txt": 50, "node_modules/x.md": 3, ".git/y.md": 3, "out/z.md": 3, "sub/c.HTML": 3, "sub/outer/d.md": 3, "e": 3}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    names = lambda df: sorted(x.path.rpartition(f"{tmp_path.name}/")[2] for x in df.select("path").collect())
    kept, left = files.scan(spark, str(tmp_path), most_bytes=20)
    assert names(kept) == ["a.md", "sub/c.HTML", "sub/outer/d.md"] and names(left) == ["big.txt"]
    kept, _ = files.scan(spark, str(tmp_path), every=True)
    assert names(kept) == ["a.md", "b.bin", "big.txt", "e", "sub/c.HTML", "sub/outer/d.md"]
    one = files.read_one(spark, str(tmp_path / "big.txt"), 20).first()
    assert one.content is None and one.error == "over 20 bytes"


def test_markdown_rows_with_one_id_stay_apart(spark):
    a = "---\nmodel: x\n  - y\ntitle: t\n---\nbody"
    df = spark.createDataFrame([(1, a), (1, "---\ngenerator: z\n---\n\nother"), (None, a), (2, None), (3, "plain")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.text or "") for x in web.clean_markdown(df).collect())
    assert got == [(0, "---\ntitle: t\n---\nbody"), (1, "---\ntitle: t\n---\nbody"), (1, "other"), (2, ""), (3, "plain")]
