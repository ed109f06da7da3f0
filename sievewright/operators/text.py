"""The invisible-character pass: inspect and clean, row by row.

The pass remembers the last base while it walks a text, so one Arrow-batched walk per row does it:
only candidate characters are visited, a regular expression finds them, and nothing is shuffled.
A row is decided by its own text alone, so ids may repeat or be null.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import codepoints as cp
from .batches import few


@dataclass(frozen=True)
class TextOptions:
    aggressive: bool = False
    normalize_spaces: bool = True
    strip_emoji_glue: bool = False


class _member:
    """Whether a code point lies in one of the ranges."""

    def __init__(self, *spans: tuple[int, int]):
        self.starts = [a for a, _ in sorted(spans)]
        self.ends = [b for _, b in sorted(spans)]

    def __call__(self, c: int) -> bool:
        k = bisect.bisect_right(self.starts, c) - 1
        return k >= 0 and c <= self.ends[k]


_KHMER = [r for r in cp.ranges(lambda c: 0x1780 <= c <= 0x17FF and chr(c).isalpha())]
_listed, _format, _orthographic = _member(*cp.LISTED, cp.SUPPLEMENT, cp.TAGS, *cp.PRIVATE), _member(*cp.FORMAT), _member(*cp.ORTHOGRAPHIC)
_glue, _emoji, _letter, _jamo, _khmer, _flag = _member(*cp.GLUE), _member(*cp.EMOJI), _member(*cp.LETTER_OR_MARK), _member(*cp.JAMO), _member(*_KHMER), _member(cp.FLAG_TAGS)
_bidi, _zero, _private, _selector, _tags = _member(*cp.BIDI), _member(*cp.ZERO_WIDTH), _member(*cp.PRIVATE), _member((0xFE00, 0xFE0F), cp.SUPPLEMENT), _member(cp.TAGS)
#: Pairs of a character and the base before it whose decision is kept.
SEEN = 20_000
_spaces, _looks = frozenset(cp.SPACES), {ord(a): b for a, b in cp.LOOKALIKES.items()}


def _kept(c: int, prev: int | None) -> bool:
    """Whether the base before makes a listed character legitimate."""
    if _orthographic(c):
        return True
    if prev is None:
        return False
    return (
        c in (0x200D, 0xFE0E, 0xFE0F)
        and _emoji(prev)
        or c in (0x200C, 0x200D)
        and _letter(prev)
        or _flag(c)
        and _emoji(prev)
        or 0x180B <= c <= 0x180D
        and 0x1800 <= prev <= 0x18AF
        and _letter(prev)
        or 0x17B4 <= c <= 0x17B5
        and _khmer(prev)
        or 0x115F <= c <= 0x1160
        and _jamo(prev)
    )


def _strip_kind(c: int) -> str:
    for test, kind in ((_tags, "tag-chars"), (_selector, "variation-selector"), (_bidi, "bidi"), (_zero, "zero-width"), (_private, "private-use")):
        if test(c):
            return kind
    return "strip"


def walk(options: TextOptions) -> Callable[[str], Iterator[tuple[int, int, str, int, str | None]]]:
    """For a text: (position, UTF-16 offset, character, code point, kind or None where kept) of every candidate."""
    spans = {*cp.LISTED, *cp.FORMAT, *cp.PRIVATE, cp.SUPPLEMENT, *((s, s) for s in cp.SPACES)}
    if options.aggressive:
        spans |= {(c, c) for c in _looks}
    find = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in sorted(spans)) + "]").finditer

    # What becomes of a character follows from it and the base before it; texts repeat few such pairs.
    seen: dict[tuple[int, int | None], tuple[str | None, int | None]] = {}

    def decide(c: int, prev: int | None) -> tuple[str | None, int | None]:
        """The kind, and the base for what follows."""
        listed = _listed(c)
        stripped = listed or _format(c) and (options.strip_emoji_glue or not _orthographic(c))
        space, look = options.normalize_spaces and c in _spaces, options.aggressive and c in _looks
        if not options.strip_emoji_glue and _kept(c, prev):
            kind = None
        elif listed:
            kind = _strip_kind(c)
        else:
            kind = "space-homoglyph" if space else "latin-confusable" if look else "other-format-char" if _format(c) else None
        if len(seen) >= SEEN:
            seen.clear()
        out = seen[c, prev] = kind, prev if stripped or _glue(c) else 32 if space else 97 if look else c
        return out

    def run(text: str) -> Iterator[tuple[int, int, str, int, str | None]]:
        prev, end, offset = None, 0, 0
        wide = not text.isascii() and max(text) > "\uffff"
        for hit in find(text):
            at = hit.start()
            if at > end:
                prev = ord(text[at - 1])
            offset += len(text[end:at].encode("utf-16-le", "surrogatepass")) // 2 if wide else at - end
            ch = text[at]
            c = ord(ch)
            kind, prev = seen.get((c, prev)) or decide(c, prev)
            yield at, offset, ch, c, kind
            end = at + 1
            offset += 2 if c > 0xFFFF else 1

    return run


def _mapped(docs: DataFrame, id_col: str, text_col: str, fn: Callable, ddl: str, kinds: list[pa.DataType]) -> DataFrame:
    """fn(text) gives the rows that stand beside the id."""
    out = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL(ddl).fields])
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            rows, at = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                own = fn(text)
                rows += own
                at += [k] * len(own)
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def _candidates(docs: DataFrame, options: TextOptions, text_col: str) -> DataFrame:
    return docs.filter(F.col(text_col).rlike(cp.CANDIDATE_WIDE if options.aggressive else cp.CANDIDATE))


def decisions(docs: DataFrame, options: TextOptions = TextOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate character: id, pos, offset (UTF-16), ch, cp, kind (null: kept)."""
    look = walk(options)
    return _mapped(_candidates(docs, options, text_col), id_col, text_col, lambda t: list(look(t)), "pos long, offset long, ch string, cp int, kind string", [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()])


def hits(docs: DataFrame, options: TextOptions = TextOptions(), id_col: str = "doc_id", text_col: str = "text", samples: int = 10) -> DataFrame:
    """Per row, code point and kind: count and the first offsets. Null texts have none."""
    look = walk(options)

    def count(text: str) -> list[tuple]:
        found: dict[tuple[int, str], list] = {}
        for _, offset, _, c, kind in look(text):
            if kind is not None:
                own = found.setdefault((c, kind), [0, []])
                own[0] += 1
                if own[0] <= samples:
                    own[1].append(offset)
        return [(*key, *own) for key, own in found.items()]

    out = _mapped(_candidates(docs, options, text_col), id_col, text_col, count, "cp int, kind string, n long, sample_offsets array<long>", [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64())])
    out = out.withColumn("codepoint", F.col("cp")).withColumn("label", F.expr("concat('U+', lpad(hex(cp), greatest(4, length(hex(cp))), '0'))")).withColumn("category", F.expr(cp.category())).withColumn("name", F.expr(cp.name()))
    confidence = F.when(F.col("kind").isin("space-homoglyph", "latin-confusable"), "informational").otherwise("probable")
    return out.withColumn("confidence", confidence).drop("cp")


def clean(docs: DataFrame, options: TextOptions = TextOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, removed_count, replaced_count for every row; null texts stay null."""
    look = walk(options)

    def rewrite(text: str | None) -> list[tuple]:
        out, end, removed, replaced = [], 0, 0, 0
        for at, _, _, c, kind in look(text or ""):
            if kind is None:
                continue
            out.append(text[end:at])
            if kind in ("space-homoglyph", "latin-confusable"):
                out.append(" " if kind == "space-homoglyph" else _looks[c])
                replaced += 1
            else:
                removed += 1
            end = at + 1
        return [("".join([*out, text[end:]]) if end else text, removed, replaced)]

    return _mapped(docs, id_col, text_col, rewrite, "text string, removed_count long, replaced_count long", [pa.string(), pa.int64(), pa.int64()])
