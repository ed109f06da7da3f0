import random

import pytest

from sievewright.functions import codepoints as cp
from sievewright.operators import style, text, web
from sievewright.operators.text import TextOptions


def in_ranges(c, spans):
    return any(a <= c <= b for a, b in spans)


def sequential(s, spaces=True, aggressive=False, strip_glue=False):
    """The pass as one walk that remembers the last base."""
    out, prev = [], None
    for ch in s:
        c = ord(ch)
        keep = not strip_glue and (
            prev is not None
            and (
                c in (0x200D, 0xFE0E, 0xFE0F)
                and in_ranges(prev, cp.EMOJI)
                or c in (0x200C, 0x200D)
                and in_ranges(prev, cp.LETTER_OR_MARK)
                or in_ranges(c, [cp.FLAG_TAGS])
                and in_ranges(prev, cp.EMOJI)
                or 0x115F <= c <= 0x1160
                and in_ranges(prev, cp.JAMO)
            )
            or in_ranges(c, cp.ORTHOGRAPHIC)
        )
        if keep:
            out.append(ch)
            if not in_ranges(c, cp.GLUE):
                prev = c
        elif in_ranges(c, (*cp.LISTED, cp.SUPPLEMENT, cp.TAGS, *cp.PRIVATE)):
            continue
        elif spaces and c in cp.SPACES:
            out.append(" ")
            prev = 32
        elif aggressive and ch in cp.LOOKALIKES:
            out.append(cp.LOOKALIKES[ch])
            prev = 97
        elif in_ranges(c, cp.FORMAT):
            continue
        else:
            out.append(ch)
            if not in_ranges(c, cp.GLUE):
                prev = c
    return "".join(out)


@pytest.mark.parametrize("options", [{}, {"aggressive": True}, {"strip_emoji_glue": True}])
def test_clean_equals_the_sequential_pass(spark, options):
    r = random.Random(3)
    alphabet = "aéя9#❤\U0001f525ᄀ​‌‍️­‮  \U000e0041\U000e0020ᅟ؁а࢐ ."
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 20))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in text.clean(df, TextOptions(**options)).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else sequential(t, aggressive=options.get("aggressive", False), strip_glue=options.get("strip_emoji_glue", False))
        assert got[i].text == want, repr(t)


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a​b c❤️‍\U0001f525")], "doc_id long, text string")
    once = text.clean(df).select("doc_id", "text")
    assert text.clean(once).first().removed_count == 0


def test_hits_count_utf16_offsets(spark):
    df = spark.createDataFrame([(1, "\U0001f525x​y​")], "doc_id long, text string")
    hit = text.hits(df).first()
    assert (hit.codepoint, hit.kind, hit.n, hit.sample_offsets, hit.label, hit.category) == (0x200B, "zero-width", 2, [3, 5], "U+200B", "Cf")


def test_moving_ratio_equals_the_sliding_definition(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(n)) for n in (1, 10, 50, 51, 120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.mattr for x in style.moving_ratio(df).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        want = len(set(w)) / len(w) if len(w) <= 50 else sum(len(set(w[k : k + 50])) / 50 for k in range(len(w) - 49)) / (len(w) - 49)
        assert abs(got[i] - want) < 1e-12


def test_short_text_has_no_score(spark):
    df = spark.createDataFrame([(1, "Too short."), (2, "")], "doc_id long, text string")
    assert {(x.status, x.score) for x in style.score(df).collect()} == {("insufficient-length", 0.0)}


def test_private_addresses(spark):
    from pyspark.sql import functions as F

    cases = {"10.1.2.3": True, "8.8.8.8": False, "172.32.0.1": False, "100.64.0.1": True, "::1": True, "fe80::1": True, "::ffff:127.0.0.1": True, "::ffff:8.8.8.8": False, "2001:db8::1": False, "example.com": False, "300.1.1.1": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {x.a: x.p for x in df.select("a", web.private_address(F.col("a")).alias("p")).collect()} == cases


def test_markdown_clean_drops_nested_lines(spark):
    df = spark.createDataFrame([(1, "---\nmodel: a\n  b: 1\n\n# c\ntitle: t\n---\nbody"), (2, "---\nllm: x\n---\n\nbody"), (3, "plain"), (4, None)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in web.clean_markdown(df).collect()} == {1: "---\ntitle: t\n---\nbody", 2: "body", 3: "plain", 4: None}


def test_rows_with_one_id_stay_apart(spark):
    rows = [(1, "a\u200bb"), (1, "c\u200bd"), (None, "x\u200by"), (None, None), (2, "\U0001f525\u200b\u200b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.text or "", x.removed_count) for x in text.clean(df).collect())
    assert got == [(0, "", 0), (0, "xy", 1), (1, "ab", 1), (1, "cd", 1), (2, "\U0001f525", 2)]
    assert [x.sample_offsets for x in text.hits(df).filter("doc_id = 2").collect()] == [[2, 3]]
    assert text.clean(df.limit(0)).count() == 0


def test_style_rows_with_one_id_stay_apart(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), "delve into it. " * 20
    df = spark.createDataFrame([(1, a), (1, b), (None, a), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_words, x.lexical_diversity) for x in style.score(df).collect() if x.doc_id not in (2, 3))
    assert got == [(0, 60, 1.0), (1, 60, round(3 / 50, 4)), (1, 60, 1.0)]
    assert [(x.phrase, x.n) for x in style.phrases(df).collect()] == [("delve into", 20)]
    assert {style.fixed_word(body) for _, _, body, _ in style.PHRASES} >= {"navigat", "harness", "only", "multifaceted"}
