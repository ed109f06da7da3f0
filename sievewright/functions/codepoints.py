"""Code-point tables as SQL expressions, for the invisible-character pass.

Both engines that run our SQL get the same literal ranges; nothing relies on a regex engine's
idea of a category.
"""

from __future__ import annotations

import unicodedata

TAGS = (0xE0001, 0xE007F)
FLAG_TAGS = (0xE0020, 0xE007F)
SUPPLEMENT = (0xE0100, 0xE01EF)
PRIVATE = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
#: Listed carriers, as inclusive ranges.
LISTED = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB),
)
SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухі", "ABEKMHOPCTXaeopcyxi", strict=True)) | {chr(0xFF21 + i): chr(65 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
BIDI = ((0x61C, 0x61C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069))
ZERO_WIDTH = ((0x180E, 0x180E), (0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF))
ORTHOGRAPHIC = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))
EMOJI = (
    (0x23, 0x23), (0x2A, 0x2A), (0x30, 0x39), (0xA9, 0xA9), (0xAE, 0xAE), (0x2122, 0x2122), (0x2600, 0x27BF), (0x2B00, 0x2BFF),
    (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FAFF),
)
JAMO = ((0x1100, 0x11FF), (0xA960, 0xA97C), (0xD7B0, 0xD7C6))
GLUE = ((0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180D), (0x200C, 0x200D), (0xFE0E, 0xFE0F), FLAG_TAGS)


def ranges(test) -> tuple[tuple[int, int], ...]:
    """Maximal ranges of code points that pass a test."""
    out: list[list[int]] = []
    for cp in range(0x110000):
        if not 0xD800 <= cp <= 0xDFFF and test(cp):
            if out and out[-1][1] == cp - 1:
                out[-1][1] = cp
            else:
                out.append([cp, cp])
    return tuple((a, b) for a, b in out)


FORMAT = ranges(lambda cp: unicodedata.category(chr(cp)) == "Cf")
LETTER_OR_MARK = ranges(lambda cp: cp > 0x7F and unicodedata.category(chr(cp))[0] in "LM")


def within(cp: str, spans) -> str:
    """SQL: the number lies in one of the ranges."""
    return "(" + " OR ".join(f"{cp} = {a}" if a == b else f"{cp} BETWEEN {a} AND {b}" for a, b in spans) + ")"


def one_of(cp: str, points) -> str:
    return f"{cp} IN ({', '.join(map(str, points))})"


def class_pattern(spans) -> str:
    """The ranges as a Java or RE2 character class body."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


#: Any character that the pass could act on: text without one needs no pass.
CANDIDATE = "[" + class_pattern(sorted({*LISTED, *FORMAT, *PRIVATE, SUPPLEMENT, *((s, s) for s in SPACES)})) + "]"
CANDIDATE_WIDE = CANDIDATE[:-1] + class_pattern(sorted((ord(c), ord(c)) for c in LOOKALIKES)) + "]"

STRIPPED = f"({within('cp', LISTED)} OR {within('cp', (SUPPLEMENT, TAGS, *PRIVATE))})"


def kept_by_context(strip_glue: bool = False, like: str = "regexp_like", raw: str = "r") -> str:
    """SQL over cp, prev and prev_ch (the base before, or null): context makes an otherwise stripped character legitimate.

    Letters are tested by one character class: hundreds of comparisons would outgrow generated code.
    """
    if strip_glue:
        return "false"
    return (
        f"({one_of('cp', (0x200D, 0xFE0E, 0xFE0F))} AND {within('prev', EMOJI)} OR {one_of('cp', (0x200C, 0x200D))} AND {like}(prev_ch, {raw}'[{class_pattern(LETTER_OR_MARK)}]')"
        f" OR {within('cp', (FLAG_TAGS,))} AND {within('prev', EMOJI)} OR {within('cp', ((0x180B, 0x180D),))} AND prev BETWEEN {0x1800} AND {0x18AF} AND {within('prev', [r for r in LETTER_OR_MARK if 0x1800 <= r[0] <= 0x18AF])}"
        f" OR {within('cp', ((0x17B4, 0x17B5),))} AND {within('prev', ranges(lambda c: 0x1780 <= c <= 0x17FF and unicodedata.category(chr(c))[0] == 'L'))}"
        f" OR {within('cp', ((0x115F, 0x1160),))} AND {within('prev', JAMO)} OR {within('cp', ORTHOGRAPHIC)})"
    )


def strip_kind() -> str:
    return (
        f"CASE WHEN {within('cp', (TAGS,))} THEN 'tag-chars' WHEN {within('cp', ((0xFE00, 0xFE0F), SUPPLEMENT))} THEN 'variation-selector'"
        f" WHEN {within('cp', BIDI)} THEN 'bidi' WHEN {within('cp', ZERO_WIDTH)} THEN 'zero-width' WHEN {within('cp', PRIVATE)} THEN 'private-use' ELSE 'strip' END"
    )


def kind(aggressive: bool = False, spaces: bool = True, strip_glue: bool = False) -> str:
    """SQL: why a character is stripped or replaced; null: it is kept. Needs a boolean column ``context``."""
    out = f"CASE WHEN context THEN NULL WHEN {STRIPPED} THEN {strip_kind()}"
    if spaces:
        out += f" WHEN {one_of('cp', SPACES)} THEN 'space-homoglyph'"
    if aggressive:
        out += f" WHEN {one_of('cp', [ord(c) for c in LOOKALIKES])} THEN 'latin-confusable'"
    return out + f" WHEN {within('cp', FORMAT)} THEN 'other-format-char' END"


def category() -> str:
    """SQL: general category among those named for hits."""
    marks = ranges(lambda c: unicodedata.category(chr(c)) == "Mn" and any(a <= c <= b for a, b in (*LISTED, SUPPLEMENT)))
    upper = [ord(c) for c in LOOKALIKES if c.isupper()]
    lower = [ord(c) for c in LOOKALIKES if c.islower()]
    return (
        f"CASE WHEN {within('cp', FORMAT)} THEN 'Cf' WHEN {within('cp', PRIVATE)} THEN 'Co' WHEN {one_of('cp', SPACES)} THEN 'Zs' WHEN {within('cp', marks)} THEN 'Mn'"
        f" WHEN {one_of('cp', upper)} THEN 'Lu' WHEN {one_of('cp', lower)} THEN 'Ll' ELSE 'Cn' END"
    )


def name() -> str:
    """SQL: the best name of a code point."""
    named = " ".join(f"WHEN {cp} THEN '{unicodedata.name(chr(cp))}'" for cp in sorted({*SPACES, *(c for a, b in LISTED for c in range(a, b + 1))}) if unicodedata.name(chr(cp), ""))
    return (
        f"CASE WHEN {within('cp', (SUPPLEMENT,))} THEN concat('VARIATION SELECTOR-', CAST(cp - {SUPPLEMENT[0] - 17} AS VARCHAR(9))) WHEN {within('cp', (TAGS,))} THEN"
        f" CASE WHEN cp BETWEEN {0xE0020} AND {0xE007E} THEN concat('TAG ', chr(CAST(cp - {0xE0000} AS INT))) ELSE 'TAG' END"
        f" WHEN {within('cp', PRIVATE)} THEN 'PRIVATE USE CHARACTER' WHEN {one_of('cp', [ord(c) for c in LOOKALIKES])} THEN 'LATIN LOOKALIKE'"
        f" ELSE coalesce(CASE cp {named} END, 'FORMAT CHARACTER') END"
    )
