"""The training-data operators against brute force, exact round trips and edge cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import chat_format, decontaminate, html_extract, jaccard_join, langid, lm_score, packing, quality, suffix_dedup, topk
from sievewright.llm.common import remainder

DOCS = "doc_id long, text string"


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# 1 ---------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "\\\\", "\\h\\t\\c", "### x </turn>\n### User: y", "", None, "###", "</turn", " </turn>\n", "a\\"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "odd: role", None, "?x", "tool", "user"], said, strict=True))]
    rows += [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    for c in (1, None, 2):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got[2].valid
    assert chat_format.digest(chat_format.format_chats(empty(spark, "conv_id long, turn long, role string, text string"))).count() == 0


# 2 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_exact(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "CHUNK", 40)
    monkeypatch.setattr(topk, "BLOCK", 7)
    r = np.random.default_rng(int(spread * 10))
    v = [(r.normal(size=6) * math.exp(spread * r.normal())).tolist() for _ in range(200)]
    v[7], v[8] = list(v[6]), [x * 1.01 for x in v[6]]
    v[9], v[10], v[11], v[12] = None, [None] * 6, [float("nan")] + [0.0] * 5, [0.0] * 6
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for x in topk.top_k(df, F.pmod("vec_id", F.lit(5)) == 0, k=5, scale=256).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    q = {i: [math.floor(256 * y) for y in x] for i, x in enumerate(v) if x is not None and None not in x and all(map(math.isfinite, x))}
    for i in (i for i in q if i % 5 == 0):
        want = sorted(((-sum(a * b for a, b in zip(q[i], c, strict=True)), j) for j, c in q.items() if j != i))[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert topk.top_k(empty(spark, df.schema), F.lit(True)).count() == 0


# 3 ---------------------------------------------------------------------------------------------


def test_decontamination(spark, monkeypatch):
    r = random.Random(1)
    word = lambda: r.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 7, 8, 9, 20, 20, 40])] + [(50, None), (51, "...")]
    items.append((60, items[5][1]))
    docs = [" ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", " " + items[r.randrange(8)][1].upper() + "!"]) for _ in range(80)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], DOCS + ", items string")
    w = lambda t: [x.decode() for x in decontaminate.words(t.encode())] if t else []
    for limit in (200_000, 30):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", limit)
        got = {x.doc_id: x for x in decontaminate.find(df, bench).select("doc_id", "items", decontaminate.hit_words().alias("n")).collect()}
        for i, t in enumerate(docs):
            hit, ids = set(), set()
            for k, text in items:
                own = w(text)
                size = min(8, len(own))
                for a in range(len(own) - size + 1 if own else 0):
                    for b in range(len(w(t)) - size + 1):
                        if w(t)[b : b + size] == own[a : a + size]:
                            hit.update(range(b, b + size))
                            ids.add(str(k))
            assert (got[i].n, got[i]["items"]) == (len(hit), sorted(ids)), (i, t)
    assert decontaminate.find(df, empty(spark, bench.schema)).filter("size(items) > 0").count() == 0
    kept = decontaminate.clean(df, bench, max_coverage=1.0)
    assert kept.columns == df.columns and kept.count() == len(docs)


def test_decontamination_cuts_in_the_pass_that_finds(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(12))
    texts = [f"Before, {item.upper()}! After \u00e9 more words that stay and stay.", f"{item} x", "w0 w1 w2", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS + ", items string")
    bench = spark.createDataFrame([("a", item), ("b", "w0 w1"), ("c", " ".join(f"v{k}" for k in range(40)))], "item_id string, text string")
    for limit in (200_000, 30):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", limit)
        out = decontaminate.clean(df, bench, max_coverage=0.7)
        # A second Python function in a stage takes more workers, which stay in an executor's memory.
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
        assert {r.doc_id: r.text for r in out.collect()} == {0: "Before, ! After \u00e9 more words that stay and stay.", 2: "w0 w1 w2", 3: None, 4: ""}


def test_decontamination_of_long_items_by_wide_windows(spark):
    long = [f"w{k}" for k in range(20_100)]
    docs = spark.createDataFrame([(k, " ".join(["x", *long[k : k + 12], "y"])) for k in (0, 19_988, 19_990, 19_992, 19_993, 20_088)], DOCS)
    bench = spark.createDataFrame([("a", " ".join(long))], "item_id string, text string")
    assert {tuple(map(tuple, r.spans)) for r in decontaminate.find(docs, bench, window=12).collect()} == {((1, 13),)}
    docs = spark.createDataFrame([(0, " ".join(f"d{k}" for k in range(400)) + " " + " ".join(long[:300]))], DOCS)
    assert decontaminate.find(docs, bench, window=300).first().spans == [[400, 700]]


# 4 ---------------------------------------------------------------------------------------------


def test_packing_keeps_every_id_once(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(2)
    texts = [" ".join(r.choice(["The", "cat's", "don't", "x.", "Éa,", "..", "<|endoftext|>", "é", " ", "ÀB.c", "12", "a.b,c"]) for _ in range(r.choice([0, 3, 50, 500, 3000]))) for _ in range(120)] + [None, ""]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS + ", offset int").repartition(3)
    rows = packing.pack_documents(df, path, open_windows=4).collect()
    t = Tokenizer.from_file(path)
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        ids = np.array(t.encode(texts[x.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (x.doc_tokens, x.ids_crc32) == (len(ids), zlib.crc32(ids[x.start : x.start + x.length].tobytes()))
        by[x.doc_id].append((x.start, x.length))
        seq[x.sequence_id].append((x.offset, x.length))
    assert len(by) == len(texts)
    for spans in [*by.values(), *seq.values()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
    assert max(sum(n for _, n in s) for s in seq.values()) <= 2048
    assert packing.pack_documents(empty(spark, DOCS), path).count() == 0


def test_packing_begins_without_what_other_operators_left_in_a_worker(monkeypatch):
    import types

    import pyarrow as pa

    public_tokenizers = pytest.importorskip("public_tokenizers")
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (60, 0, 700, 2100)] + [None]
    passages = pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for t in texts]), *[pa.array(range(5), pa.int64())] * 2], names=["text", "t1", "t2"])
    found = sum(b.num_rows for b in suffix_dedup._word_runs(iter([passages])))
    assert found and suffix_dedup._hashes
    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([t and t.encode() for t in texts], pa.binary())], names=["doc_id", "text"])
    pack = lambda: pa.Table.from_batches(packing._pieces(path, 2048, 4, 32)(iter([docs])))
    whole = pack()
    assert not suffix_dedup._hashes and set(whole["doc_id"].to_pylist()) == set(range(5))
    known = packing._encoders[path]
    monkeypatch.setattr(packing, "SLICE", 2)
    assert pack().equals(whole) and packing._encoders[path] is known
    assert sum(b.num_rows for b in suffix_dedup._word_runs(iter([passages]))) == found and not packing._encoders


# 5 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("work", "seen"), [(4_000_000, 400), (9, 2)])
def test_jaccard_join(spark, monkeypatch, work, seen):
    monkeypatch.setattr(jaccard_join, "PART", 3)
    monkeypatch.setattr(jaccard_join, "WORK", work)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "SEEN", seen)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 256 if seen > 2 else 2)
    r = random.Random(4)
    base = [[r.choice("abcdefghijklmnop") + str(r.randrange(30)) for _ in range(r.choice([1, 2, 8, 30, 60]))] for _ in range(14)]
    texts = []
    for _ in range(90):
        w = list(r.choice(base))
        for _ in range(r.randrange(5)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [r.choice("xyz")]
        texts.append("\t".join(w).upper() if r.random() < 0.5 else " ".join(w))
    texts += ["", None, " \n", "", texts[0]]
    got = {x.doc_id: x for x in jaccard_join.similar(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", n int")).collect()}
    sets = [frozenset(zip(w, w[1:], strict=False)) or frozenset(w) for w in ((t or "").lower().split() for t in texts)]
    link = [[j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 60 * len(a | b)] for i, a in enumerate(sets)]
    least = list(range(len(sets)))
    for _ in sets:
        for i, own in enumerate(link):
            for j in own:
                least[i] = min(least[i], least[j])
    assert {i: (x.n_shingles, x.n_similar, x.component_id) for i, x in got.items()} == {i: (len(s), len(link[i]), least[i]) for i, s in enumerate(sets)}
    assert jaccard_join.similar(empty(spark, DOCS)).count() == 0


def test_jaccard_join_through_null_ids(spark):
    word = lambda g, k: f"g{g}w{k}"
    rows = []
    for g in range(3):  # three variants each, of which another one has no id
        base = " ".join(word(g, k) for k in range(40))
        rows += [(None if v == g else 10 * g + v, f"{base} end{v}") for v in range(3)]
    # Two that only one without an id connects, and two without ids that are alike.
    rows += [(i, " ".join(word(3, k) for k in range(a, a + 40))) for i, a in ((30, 0), (None, 5), (31, 10))]
    rows += [(None, " ".join(word(4, k) for k in range(40)) + f" end{v}") for v in range(2)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_similar, x.component_id) for x in jaccard_join.similar(docs).collect() if x.doc_id is not None)
    assert got == [(False, *x) for x in [(1, 2, 1), (2, 2, 1), (10, 2, 10), (12, 2, 10), (20, 2, 20), (21, 2, 20), (30, 1, 30), (31, 1, 30)]]
    kept = [x.doc_id for x in jaccard_join.keep_one(docs).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 10, 20, 30] and kept.count(None) == 6


def test_jaccard_join_shuffles_its_ring_pairs_in_slices(spark):
    n = 60
    docs = spark.createDataFrame([(i, " ".join(f"d{i // 2}w{k}" for k in range(n + 1)) + f" end{i % 2}") for i in range(80)], DOCS)
    store, j = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in j.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(j.double, 0), None))}
    before = stages()
    texts = jaccard_join._distinct(docs, "doc_id", "text")
    assert {r.shared for r in jaccard_join._shared(texts, None).collect()} <= set(range(n // 2, n + 2))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    wrote = [v for k, v in stages().items() if k not in before]
    assert 0 < max(wrote) < 0.4 * 80 * (n + 1)


# 6 ---------------------------------------------------------------------------------------------


def test_code_lengths_are_exact(monkeypatch):
    texts = {"a": [b"abracadabra", b"abc abc"], "b": [b"zebra zoo", "ña".encode()]}
    trees = langid.Trees(texts)
    order = langid.ORDER

    def brute(text, lang):
        counts, together = collections.defaultdict(collections.Counter), collections.Counter()
        for own, all_ in texts.items():
            for t in all_:
                s = [0] * order + [int(x) for x in trees.symbol[np.frombuffer(t, np.uint8)]]
                for i in range(order, len(s)):
                    for k in range(order + 1):
                        together[tuple(s[i - k : i])] += 1
                        if own == lang:
                            counts[tuple(s[i - k : i])][s[i]] += 1
        s, bits = [0] * order + [int(x) for x in trees.symbol[np.frombuffer(text, np.uint8)]], 0.0
        for i in range(order, len(s)):
            p = 1.0
            for k in range(order, -1, -1):
                ctx = tuple(s[i - k : i])
                seen = counts[ctx]
                if k and together[ctx] < langid.LEAST_SEEN or not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    p *= seen[s[i]] / total
                    break
                p *= len(seen) / total
            else:
                p /= 256
            bits -= math.log2(p)
        return bits

    for t in (b"abra", b"zoo abc", b"q", "ñañ".encode()):
        assert np.allclose(trees.bits([t])[0], [brute(t, lang) for lang in trees.langs], rtol=1e-5)
    monkeypatch.setattr(langid, "PIECE", 3)
    assert np.allclose(trees.bits([b"zoo abc zebra"])[0], [brute(b"zoo abc zebra", lang) for lang in trees.langs], rtol=1e-5)


def test_language_edges(spark):
    df = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(20)] + [(i, "der hund und die katze", "de") for i in range(20, 40)] + [(50, None, "en"), (51, "12 !", "en"), (52, "und der", None), (53, "", None)], DOCS + ", lang string")
    trees = langid.train(df, F.lit(True))
    got = {x.doc_id: x for x in langid.identify(df, trees).collect()}
    assert (got[0].lang_pred, got[25].lang_pred, got[52].lang_pred) == ("en", "de", "de")
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (50, 51, 53))
    none = langid.train(empty(spark, df.schema), F.lit(True))
    assert langid.identify(df, none).filter("lang_pred <> 'und'").count() == 0


def test_language_of_long_texts_alone(spark):
    long = "zwu kxo qwy " * 20_000
    docs = spark.createDataFrame([(1, "the cat and the dog " * 20, "en"), (2, long, "zz")], DOCS + ", lang string")
    trees = langid.train(docs, F.lit(True))
    assert trees.langs == ["en", "zz"]
    asked = spark.createDataFrame([(1, "qwy zwu kxo"), (2, "the dog and the cat")], DOCS)
    assert {x.doc_id: x.lang_pred for x in langid.identify(asked, trees).collect()} == {1: "zz", 2: "en"}
    some = langid.train(docs, F.lit(True), sample_bytes=200_000)
    assert some.langs == ["en", "zz"]


# 7 ---------------------------------------------------------------------------------------------


def test_positive_unlabelled_learning(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice("the a cat dog runs over hill and far away".split()) for _ in range(r.randint(20, 60))).capitalize() + "."
    junk = lambda: " ".join(r.choice(["buy", "now"]) + r.choice(["!!", "$$$", "###"]) for _ in range(r.randint(20, 60)))
    kind = [r.random() < 0.7 for _ in range(600)]
    df = spark.createDataFrame([(i, good() if k else junk()) for i, k in enumerate(kind)], DOCS)
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kind) if i % 2], "doc_id long, quality int")
    model = quality.train(df, labels, remainder(F.col("doc_id"), 3) != 1)
    right = sum((x.score >= 0.5) == kind[x.doc_id] for x in quality.score(df, model).collect())
    assert right / len(kind) > 0.97
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 1.0)], DOCS + ", score double")
    assert all(0 <= x.score <= 1 for x in quality.score(odd, model).collect())
    none = quality.train(empty(spark, DOCS), empty(spark, "doc_id long, quality int"), F.lit(True))
    assert quality.score(odd, none).first().score == 0.5


# 8 ---------------------------------------------------------------------------------------------


def test_extraction_on_fresh_layouts():
    e = html_extract.Extractor()
    right = 0
    for k in range(100):
        source, marks = html_extract.generate(random.Random(10**6 + k))
        page = html_extract.Page(source)
        right += e.extract([source])[0] == page.text([0, *map(int, marks)])
    assert right >= 90


def test_extraction_edges(spark):
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/x>x</a></li></ul></nav><article><h1>A &amp; B</h1><p>one\n two <b>three<br><p>f&uuml;r long enough text to be an article, of course.</p></article><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {x.page_id: x.text for x in html_extract.extract(df).collect()}
    assert got == {1: "A & B\none two three\nfür long enough text to be an article, of course.", 2: "", 3: ""}


@pytest.mark.parametrize("mark", ["<svg-icon name='x'></svg-icon>", "<title-bar></title-bar>", "<svg/>", "<svg class='i' viewBox=\"0 > 1\" />", "<SVG\nwidth=1 />", "<svg aria-label='a/>b'>gone</svg>", "<svg><path d=''/>gone</svg>", "<script src='x'/>gone</script>"])
def test_extraction_raw_names(mark):
    page = html_extract.Page(f"<article><p>before</p>{mark}<p>after &amp; on</p></article>")
    assert " ".join("".join(t or " " for _, t in page.events).split()) == "before after & on"


def test_extraction_keeps_text_after_icons():
    said = "Some text that is long enough to be an article, of course, and more of it."
    for mark in ("<svg-icon></svg-icon>", "<svg class=\"i\" />"):
        page = f"<body><nav><ul><li><a href=/x>x</a></li></ul></nav><article><h1>A head</h1><p>{said}</p>{mark}<p>{said}</p><p>The end of it, at last.</p></article></body>"
        assert html_extract.Extractor().extract([page]) == [f"A head\n{said}\n{said}\nThe end of it, at last."]


# 9 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2_000_000, 500])
def test_suffix_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r = random.Random(block)
    w = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    parts = [w(n) for n in (380, 399, 400, 401, 430, 600, 1500, 170)]
    docs = []
    for _ in range(40):
        own = []
        for _ in range(r.randint(1, 4)):
            x = r.random()
            p = r.choice(parts)
            i = r.randrange(len(p))
            own.append(p if x < 0.4 else p[:i] + "X" + p[i + 1 :] if x < 0.5 else "ab c" * r.randint(50, 200) if x < 0.6 else "a" * r.randint(300, 900) if x < 0.65 else w(r.randint(10, 700)))
        docs.append("".join(own))
    docs += [docs[3], docs[5], docs[5], "", None, "x" * 400, "x" * 401]
    raw = [(t or "").encode() for t in docs]
    count = collections.Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], DOCS + ", first int")
    got = {x.doc_id: x for x in suffix_dedup.report(df).collect()}
    for i, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        want = (len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    out = suffix_dedup.clean(df)
    assert out.columns == df.columns and out.filter("text IS NULL").count() == 1
    assert suffix_dedup.report(empty(spark, DOCS)).count() == 0


def test_suffix_dedup_of_passages_below_400_bytes(spark, tmp_path):
    from sievewright.llm.queries import op9_suffix_dedup

    r = random.Random(9)
    w = lambda n: [r.choice("abcdefgh") + str(r.randrange(99)) for _ in range(n)]
    parts = [w(n) for n in (50, 51, 52, 60, 75, 120)]
    docs = []
    for _ in range(60):
        own = []
        for _ in range(r.randint(1, 4)):
            x, p = r.random(), r.choice(parts)
            i = r.randrange(len(p))
            own += p if x < 0.4 else [*p[:i], "X", *p[i + 1 :]] if x < 0.6 else ["la"] * r.randint(40, 70) if x < 0.7 else w(r.randint(1, 80))
        docs.append("".join(x + r.choice([" ", " ", " ", "\n", " \t"]) for x in own))
    docs += [docs[3], docs[5], "", None, "é " * 51, "é " * 52]
    raw = [(t or "").encode() for t in docs]
    split = [t.split() for t in raw]
    seen = collections.Counter(tuple(t[i : i + 51]) for t in split for i in range(len(t) - 50))
    strings = collections.Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], DOCS + ", passages int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op9_suffix_dedup(spark, str(tmp_path)).collect()}
    short = 0
    for i, (t, own) in enumerate(zip(raw, split, strict=True)):
        gone, places, at = np.zeros(len(t) + 1, bool), [], 0
        for x in own:
            at = t.index(x, at)
            places.append((at, at + len(x)))
            at += len(x)
        for k in range(len(t) - 399):
            if strings[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        before = gone.sum()
        for k in range(len(own) - 50):
            if seen[tuple(own[k : k + 51])] > 1:
                gone[places[k][0] : places[k + 50][1]] = True
        short += gone.sum() > before
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        want = (len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    assert short > 20


# 10 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [8_000_000, 300])
def test_lm_scoring(spark, monkeypatch, shard):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", shard)
    r = random.Random(shard)
    docs = []
    for _ in range(60):
        if docs and r.random() < 0.3:
            d = r.choice(docs).split()
            docs.append(" ".join(d[: r.randrange(len(d) + 1)] + [f"w{r.randrange(12)}" for _ in range(r.randint(0, 6))]))
        else:
            docs.append(" ".join(f"w{r.randrange(12)}" for _ in range(r.randint(0, 40))))
    docs += ["", None, docs[3], docs[3], "new words here", "w1 w2 new W3"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], DOCS + ", score int")
    got = {x.doc_id: x for x in lm_score.scores(df, remainder(F.col("doc_id"), 7) != 2).collect()}
    seqs = [[*(t or "").lower().split(), "</end>"] for t in docs]
    train = [s for i, s in enumerate(seqs) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for s in train for w in s)
    n, v = sum(c.values()), len(c)
    ctx = collections.Counter(tuple(t[a:b]) for s in train for t in [["<s>", *s]] for b in range(1, len(t) + 1) for a in range(b))
    for i, s in enumerate(seqs):
        t, base_score, score = ["<s>", *s], 0.0, 0.0
        for k in range(1, len(t)):
            base = (c[t[k]] + 1) / (n + v + 1)
            base_score += math.log10(base)
            a = next((a for a in range(k) if ctx[tuple(t[a:k])]), None)
            score += math.log10(base if a is None else (ctx[tuple(t[a : k + 1])] + base) / (ctx[tuple(t[a:k])] + 1))
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(s), sum(c[w] > 0 for w in s), n)
        assert abs(x.base_score - base_score) < 1e-9 and abs(x.score - score) < 1e-6


def test_lm_scoring_shuffles_held_out_texts_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 40)
    monkeypatch.setattr(lm_score, "ROUND", 25, raising=False)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k * k) % 11}" for k in range(20)) + f" d{i}") for i in range(200)], DOCS)
    store, j = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in j.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(j.double, 0), None))}
    before = stages()
    out = lm_score.scores(docs, F.col("doc_id") % 7 != 2).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    shards = -(-out[0].train_tokens // 40)
    held = sum(not r.learns for r in out)
    assert len(out) == 200 and shards * held > 2500
    assert 0 < max(v for k, v in stages().items() if k not in before) < 0.8 * shards * held


@pytest.mark.parametrize("step", [1, 7, 1_000_000])
def test_lm_shard_is_right_in_steps(monkeypatch, step):
    monkeypatch.setattr(lm_score, "STEP", step)
    r = np.random.default_rng(step)
    for k in range(30):
        words = lm_score.fold(r.integers(-(2**40), 2**40, r.integers(1, 8)))
        texts = [words[r.integers(0, len(words), r.integers(0, 25))] for _ in range(r.integers(1, 30))]
        texts += texts[: 3 * (k % 2)]
        starts = [np.array([0, *t]) for t in texts]
        seen = collections.Counter(tuple(s[a:b].tolist()) for s in starts for b in range(1, len(s) + 1) for a in range(b))
        asked = [*starts[:4], np.array([0, *words[r.integers(0, len(words), 9)]]), np.array([0, 5, words[0]])]
        before = np.concatenate([np.arange(len(s)) for s in asked])
        length, count = lm_score.Shard(list(texts)).search(np.concatenate(asked), before)
        want = []
        for s in asked:
            for b in range(1, len(s) + 1):
                n = next((b - a for a in range(b) if tuple(s[a:b].tolist()) in seen), 0)
                want.append((n, seen[tuple(s[b - n : b].tolist())] if n else sum(map(len, starts))))
        assert list(zip(length.tolist(), count.tolist(), strict=True)) == want


def _peak(run):
    import gc
    import tracemalloc

    gc.collect()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_lm_shards_and_blocks_are_built_in_bounded_memory(monkeypatch):
    import types

    import pyarrow as pa

    monkeypatch.setattr(lm_score, "STEP", 20_000)
    monkeypatch.setattr(lm_score, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    r = np.random.default_rng(3)
    n = 400_000
    texts = [r.integers(1, 3000, 400) for _ in range(n // 400)]
    assert _peak(lambda: lm_score.Shard(texts)) < 32 * n  # ids, depths, ranks, order and open slots are 20 bytes a place
    words = [f"w{k}" for k in range(3000)]
    rows = [" ".join([words[k] for k in r.integers(0, 3000, 400)]).encode() for _ in range(n // 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([1, 0] * (len(rows) // 2), pa.int32()), pa.array(rows, pa.binary())], names=["t1", "t2", "l", "text"])
    out = []
    assert _peak(lambda: out.extend(lm_score._blocks(iter([batch])))) < 32 * n  # the hashes are 8 bytes a word
    made = [x for b in out for x in b.to_pylist()]
    known, counts = next(np.frombuffer(x["data"], np.int64).reshape(2, -1) for x in made if x["kind"] == 0)
    want = collections.Counter()
    for k, text in enumerate(rows):
        want.update(lm_score.tokens(text).tolist() if k % 2 == 0 else [])
    assert {w: c for w, c in zip(known.tolist(), counts.tolist(), strict=True) if c} == dict(want)
    for x in made:
        if x["kind"]:
            ids = np.frombuffer(zlib.decompress(x["data"]), np.int32)
            assert (known[ids] == lm_score.tokens(rows[x["t1"]])).all()


def test_jaccard_join_works_sets_out_once_for_all_slices(spark, monkeypatch):
    """Stored rings of 32-bit hashes stand in for the texts; what a ring loses to equal hashes, its set needs to share less."""
    docs = spark.createDataFrame([(i, f"a{i // 2} b c d e f g h i j k{i}") for i in range(8)] + [(8, None), (9, "one")], DOCS)
    texts = jaccard_join._distinct(docs, "doc_id", "text")
    assert "text" not in texts.columns
    monkeypatch.setattr(jaccard_join, "words", lambda c: pytest.fail("words are split again"))
    rings = {r.rep: list(r.found) for r in texts.collect()}
    assert all(r == sorted(set(r)) and len(r) == n and all(-(2**31) <= v < 2**31 for v in r) for i, r in rings.items() for n in [0 if i == 8 else 1 if i == 9 else 10])
    pairs = collections.Counter(p for r in rings.values() for p in zip(r, r[1:] + r[:1], strict=True))
    x = {r.x: r.rep for r in texts.collect()}
    got = {x[r.x]: r.shared for r in jaccard_join._shared(texts.filter("n > 0"), None).collect()}
    assert got == {i: n for i, r in rings.items() if (n := sum(pairs[p] > 1 for p in zip(r, r[1:] + r[:1], strict=True)))}
