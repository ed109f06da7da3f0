"""HTML, Markdown and SVG metadata; URLs, addresses and sitemaps. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markers as m

META = r"(?i)<meta\b[^>]*>"
JSON_LD = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>.*?</script\s*>"""
DATA_AI = r"""(?i)\sdata-ai[A-Za-z0-9_-]*\s*=\s*["'][^"']*["']"""
JSON_CLAIM = r"(?i)softwareagent|digitalsourcetype|c2pa|trainedalgorithmicmedia"
IDENTITY = r"(?i)^(?:icbm|geo\.|dc\.creator|copyright|creator|article:author|author)"


def attribute(tag: Column, name: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(tag, F.lit(rf"""(?i){name}\s*=\s*["']([^"']*)["']"""), F.lit(1)), F.lit(-1))


def _cms(tag: Column) -> Column:
    named = F.lower(F.coalesce(attribute(tag, "name"), attribute(tag, "property"), attribute(tag, "generator"), F.lit("")))
    return (named == "generator") & ~tag.rlike(m.AI_VENDOR)


def _ai(tag: Column) -> Column:
    return ~_cms(tag) & (tag.rlike(m.AI_NAME) | tag.rlike(m.AI_VENDOR))


def html_findings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, code, confidence), one row per finding."""
    all_of = lambda pattern: F.regexp_extract_all(html_col, F.lit(pattern), F.lit(0))
    own = lambda code, confidence: F.struct(F.lit(code).alias("code"), confidence.alias("confidence"))
    none = F.lit(None).cast("struct<code:string,confidence:string>")

    def of_meta(tag: Column) -> Column:
        name = F.coalesce(attribute(tag, "name"), attribute(tag, "property"), F.lit(""))
        return (
            F.when(_cms(tag), own("html.meta.cms-generator", F.lit("informational")))
            .when(_ai(tag), own("html.meta.ai", F.when(tag.rlike(m.AI_VENDOR), "confirmed").otherwise("probable")))
            .when(name.rlike(IDENTITY), own("html.meta.identity", F.lit("confirmed")))
            .otherwise(none)
        )

    blocks = F.transform(F.filter(all_of(JSON_LD), lambda b: b.rlike(m.AI_NAME) | b.rlike(JSON_CLAIM)), lambda b: own("html.jsonld.provenance", F.lit("confirmed")))
    attrs = F.transform(all_of(DATA_AI), lambda a: own("html.attr.data-ai", F.lit("probable")))
    found = F.filter(F.concat(F.transform(all_of(META), of_meta), blocks, attrs), lambda x: x.isNotNull())
    return pages.select(id_col, F.explode(found).alias("f")).select(id_col, "f.code", "f.confidence")


def _drop(text: Column, pattern: str, doomed) -> Column:
    """Removes those matches of a pattern that a predicate dooms: pieces between matches, woven with the kept matches."""
    pieces = F.split(text, pattern, -1)
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.when(doomed(x), "").otherwise(x))
    return F.array_join(F.flatten(F.zip_with(pieces, kept, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def clean_html(html: Column) -> Column:
    return F.regexp_replace(_drop(_drop(html, META, _ai), JSON_LD, lambda b: b.rlike(m.AI_NAME) | b.rlike(JSON_CLAIM)), DATA_AI, "")


FRONT = r"^---\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|$)"
KEY = r"^([A-Za-z0-9_.-]+)[ \t]*:"


def _front_line(line: Column) -> Column:
    """(top, key, value, code) of one line of a frontmatter block."""
    top = ~line.rlike(r"^[ \t-]") & (F.trim(line) != "") & ~F.ltrim(line).startswith("#")
    key = F.when(top & line.rlike(KEY), F.regexp_extract(line, KEY, 1))
    value = F.trim(F.substr(line, F.instr(line, ":") + 1))
    named = F.lower(key).isin(m.AI_KEYS) | key.rlike(m.AI_NAME)
    code = F.when(named, "markdown.frontmatter.generator").when(key.isNotNull() & value.rlike(m.AI_NAME), "markdown.frontmatter.value")
    return F.struct(top.alias("top"), key.alias("key"), value.alias("value"), code.alias("code"))


def front_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line, key, top, value, code, confidence, identity) of each line of a frontmatter block."""
    block = F.regexp_extract(text_col, FRONT, 1)
    lines = docs.filter(F.col(text_col).rlike(FRONT)).select(id_col, F.posexplode(F.split(block, r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("of", _front_line(F.col("line"))).select(id_col, "pos", "line", "of.key", "of.top", "of.value", "of.code")
    confidence = F.when(F.col("code") == "markdown.frontmatter.generator", "confirmed").when(F.col("code").isNotNull(), "probable")
    return lines.withColumn("confidence", confidence).withColumn("identity", F.coalesce(F.lower("key").isin(m.IDENTITY_KEYS), F.lit(False)))


def clean_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of each row: provenance keys and what is nested under them dropped; an emptied block goes whole."""

    def step(state: Column, line: Column) -> Column:
        # Blank, comment and nested lines share the fate of the key above.
        of = _front_line(line)
        drop = F.when(of["top"], of["code"].isNotNull()).otherwise(state["drop"])
        return F.struct(drop.alias("drop"), F.when(drop, state["kept"]).otherwise(F.concat(state["kept"], F.array(line))).alias("kept"))

    lines = F.split(F.regexp_extract(text_col, FRONT, 1), r"\r?\n")
    kept = F.aggregate(lines, F.struct(F.lit(False).alias("drop"), F.array().cast("array<string>").alias("kept")), step)["kept"]
    block = F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")
    body = F.regexp_replace(text_col, FRONT, "")
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.explode(F.array(F.when(F.col(text_col).rlike(FRONT), block))).alias("block"), body.alias("body"))
    text = F.when(F.col("block").isNull(), F.col("text")).when(F.col("block") == "", F.regexp_replace("body", r"^\n+", "")).otherwise(F.concat(F.lit("---\n"), "block", F.lit("\n---\n"), "body"))
    return out.select(F.col("id").alias(id_col), text.alias("text"))


SVG = {
    "metadata": r"(?is)<metadata\b[^>]*>.*?</metadata\s*>",
    "xmp": r"(?is)<x:xmpmeta\b[^>]*>.*?</x:xmpmeta\s*>",
    "xpacket": r"(?is)<\?xpacket\b.*?\?>",
    "comment": r"(?s)<!--.*?-->",
    "attrs": r"""(?i)\s(?:generator|illustrator:[A-Za-z0-9_]+|inkscape:export-filename|inkscape:version|sodipodi:docname)\s*=\s*"[^"]*\"""",
}


def svg_findings(text: Column) -> list[Column]:
    """(code, confidence) or null, per rule."""
    own = lambda code, confidence: F.struct(F.lit(code).alias("code"), F.lit(confidence).alias("confidence"))
    return [
        F.when(text.rlike(SVG["metadata"]), own("svg.metadata.block", "confirmed")),
        F.when(text.rlike(SVG["xmp"]) | text.rlike(r"(?i)<\?xpacket"), own("svg.xmp", "confirmed")),
        F.when(text.rlike("(?i)c2pa|jumbf"), own("svg.c2pa", "probable")),
        F.when(text.rlike(SVG["attrs"]), own("svg.editor.attrs", "confirmed")),
        F.when(text.rlike(m.AI_VENDOR), own("svg.vendor.name", "probable")),
    ]


def clean_svg(text: Column) -> Column:
    for k in ("metadata", "xmp", "xpacket"):
        text = F.regexp_replace(text, SVG[k], "")
    return F.regexp_replace(_drop(text, SVG["comment"], lambda c: c.rlike(m.AI_NAME) | c.rlike(m.AI_VENDOR)), SVG["attrs"], "")


IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def private_address(address: Column) -> Column:
    """Loopback, private, link-local, shared, reserved and multicast addresses; what is no address is false."""

    def v4(text: Column) -> Column:
        parts = F.split(text, r"\.")
        a, b = F.try_to_number(parts[0], F.lit("999")).cast("int"), F.try_to_number(parts[1], F.lit("999")).cast("int")
        return a.isin(0, 10, 127) | (a >= 224) | ((a == 192) & b.isin(0, 168)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 100) & b.between(64, 127))

    low = F.lower(address)
    mapped = F.regexp_extract(low, r"^::ffff:([0-9.]+)$", 1)
    six = low.contains(":") & low.rlike("^[0-9a-f:.]+$")
    return F.coalesce(F.when(low.rlike(IPV4), v4(low)).when(six & mapped.rlike(IPV4), v4(mapped)).when(six, low.isin("::", "::1") | low.rlike("^(?:fe80|fc|fd|ff)")).otherwise(False), F.lit(False))


def url_policy(url: Column) -> Column:
    """Null: the URL may be fetched; else why not."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    return (
        F.when(scheme == "", "invalid")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(url.rlike(r"^[A-Za-z]+://[^/?#]*@"), "credentials")
        .when(host == "", "host")
        .when(private_address(bare), "private")
    )


TYPES = {
    "application/pdf": "pdf", "application/vnd.oasis.opendocument.text": "odt", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/xhtml+xml": "html",
    "image/jpeg": "jpg", "image/png": "png", "image/svg+xml": "svg", "image/webp": "webp", "text/html": "html", "text/markdown": "md", "text/plain": "txt",
}


def filename_for_url(url: Column, content_type: Column) -> Column:
    kind = F.trim(F.split(F.lower(content_type), ";")[0])
    known = F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, f"page.{v}")])
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1))
    return F.coalesce(F.try_element_at(known, kind), F.when(last.contains("."), last), F.lit("page.html"))


def sitemap_urls(xml: Column) -> Column:
    out = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))

    def plain(x: Column) -> Column:
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&#x2F;", "/"), ("&#x2f;", "/"), ("&amp;", "&")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    return F.filter(F.transform(out, lambda x: plain(F.trim(x))), lambda x: x != "")


def sitemap_is_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


KINDS = {
    "image": ".jpeg .jpg .png .webp".split(),
    "container": ".docx .htm .html .markdown .md .mdx .odt .pdf .svg".split(),
    "text": ".css .csv .go .ini .java .js .json .jsonl .jsx .py .rb .rs .sh .srt .text .toml .ts .tsv .tsx .txt .vtt .yaml .yml".split(),
}


def kind_of_name(name: Column) -> Column:
    """By extension; null where the bytes must tell."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    out = F.lit(None).cast("string")
    for kind, exts in KINDS.items():
        out = F.when(ext.isin(exts), kind).otherwise(out)
    return out
