"""Decontamination, line chunks, language ID, quality and main text on small fixtures."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stintline.llm import decontaminate, htmltext, language, linechunks, quality

SF = "/root/testdata/sf0.01"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - n + 1)) if v else ():
                g = v[k : k + n]
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit |= set(range(i, i + len(g)))
                        own.add(str(item))
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 3])
def test_decontamination_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "PASS_PHRASES", most)
    passage = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    items = [(1, passage), (2, passage.upper()), (10, "short one"), (3, None), (4, "..."), (5, "a a a a a a a a a a a a"), (6, "ünï cödé")]
    docs = [(1, "x " + passage + " y"), (2, "fox jumps over the lazy dog and runs away from, all"), (3, "a " * 30), (4, None), (5, ""), (6, "one short one Short-One"), (7, passage + passage), (8, "ünï CÖDé ünï cödé"), (1, "x"), (None, passage)]
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = sorted([tuple(r[c] for c in cols) for r in decontaminate.contamination(d.repartition(2), b).collect()], key=str)
    assert got == brute(docs, items)
    assert decontaminate.contamination(d.limit(0), b).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.contamination(d, b.limit(0)).collect())


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha zero beta gamma"), (2, "gamma beta alpha"), (3, "alpha one two three beta gamma"), (4, "alpha beta")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: list(r.starts) for r in decontaminate.matches(d, b, slop=1).collect()}
    assert got == {1: [0], 2: [0], 3: [], 4: []}
    assert {r.doc_id: list(r.starts) for r in decontaminate.matches(d, b).collect()} == {1: [], 2: [], 3: [], 4: []}


def is_long(line):
    return len(line) >= 300 or line.count(" ") >= 49


def cut(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, held = [], []
    for i, line in enumerate(lines):
        held.append(line)
        if (h[i] + (31 * h[i - 1] if i else 0)) % 3 == 0 or i == len(lines) - 1 or is_long(line) or is_long(lines[i + 1]):
            out.append(held)
            held = []
    return out


def test_line_chunks_match_brute_force(spark):
    block = [f"this is line number {i} of the shared part" for i in range(20)]
    docs = [(3, "\n".join(["intro", *block, "end"])), (1, "\n".join([*block[4:], "other end"])), (2, "\n".join(["p", "q", *block, *block])), (4, ""), (5, None), (6, "one line only"), (3, "\n".join(["intro", *block, "end"])), (None, "\n".join(block)), (7, "\n" * 50)]
    passage = " ".join(f"p{i}" for i in range(51))
    docs += [(20 + i, f"start {i} of its own\n{passage}\nend {i}") for i in range(30)] + [(60, "x" * 300), (61, "y\n" + "x" * 300), (62, "line\n" * 20_000 + passage)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, gone string, n_lines int")

    def key(i, t):
        return bytes.fromhex(hashlib.md5("|".join(["-" if i is None else str(i), t]).encode()).hexdigest())

    places = {}
    for i, t in set(docs):
        if t is not None:
            for pos, c in enumerate(cut(t)):
                if (len(c) >= 2 or is_long(c[0])) and len("\n".join(c)) >= 40:
                    places.setdefault("\n".join(c), []).append((i is None, i or 0, key(i, t), pos))
    want = []
    for i, t in docs:
        if t is None:
            want.append((i, None, None, 0))
            continue
        kept, gone = [], 0
        for pos, c in enumerate(cut(t)):
            body = "\n".join(c)
            if body in places and (i is None, i or 0, key(i, t), pos) != min(places[body]):
                gone += len(c)
            else:
                kept.append(body)
        want.append((i, "\n".join(kept), len(t.split("\n")), gone))
    out = linechunks.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "gone", "n_lines", "n_removed"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[3] for r in got) > 20
    assert sum(passage in (r[1] or "") for r in got) == 1 and got[[r[0] for r in got].index(61)][1] == "y"
    assert linechunks.dedup_lines(df.limit(0)).collect() == []


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("score"))
    model = language.train(docs)
    assert model.families == ["germanic", "romance"] and ("de", "en") in model.pairs and ("es", "fr") in model.pairs
    extra = spark.createDataFrame([(10**6, None, "en", "x"), (10**6 + 1, "12 + 3 — …", "en", "x"), (10**6 + 2, "", None, "x")], "doc_id long, text string, lang string, score string")
    found = language.identify(docs.unionByName(extra), model).withColumn("held", language.held_out()).collect()
    held = [r for r in found if r.held and r.doc_id < 10**6]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id >= 10**6)
    assert all(0 <= r.score <= 1 for r in found)
    assert language.identify(docs.limit(0), model).collect() == []
    none = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs.limit(3), none).collect()} == {"und"}


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 50_000)], "doc_id long, text string")
    found = quality.score(docs.select("doc_id", "text").unionByName(extra), model, keep=["doc_id"])
    rows = found.join(labels, "doc_id").where(language.held_out("doc_id", 4, 2)).collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.score <= 1 for r in found.collect()) and found.count() == 1003
    assert quality.score(docs.limit(0), model).collect() == []
    assert quality.train(docs, labels.limit(0)).forward is not None


def test_attention_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    x, ptr, y, weight = rng.standard_normal((9, quality.FEATURES)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    m = quality.Model()

    def loss():
        s = m.forward(x, ptr)["score"]
        return -((y * np.log(s) + (1 - y) * np.log(1 - s)) * weight).sum() / weight.sum()

    for k, d in m.gradient(x, ptr, y, weight).items():
        at = tuple(rng.integers(0, n) for n in m.p[k].shape)
        m.p[k][at] += 1e-6
        high = loss()
        m.p[k][at] -= 2e-6
        low = loss()
        m.p[k][at] += 1e-6
        assert abs((high - low) / 2e-6 - d[at]) < 1e-6


def test_main_text(spark):
    page = (
        '<html><head><title>T</title><script>if(a<b){x("</p>")}</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>'
        "<article><header><h1>Big &amp;\n bold</h1></header><p>First <b>par</b>agraph&nbsp;here.<br>Next<p>Unclosed one<div class='ad'>Buy this now</div><form>Mail <input></form><p>Last.</p></article>"
        "<section class='comments'><article><p>Nice words, thank you all so much for them.</p></article></section><footer>&copy; me</footer>"
    )
    df = spark.createDataFrame([(1, "u", page, "old"), (2, "u", None, None), (3, None, "", ""), (4, "u", "<p>" + "word " * 100_000 + "</p>", "")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got[1] == "Big & bold First paragraph here. Next Unclosed one Last."
    assert got[2] == got[3] == "" and len(got[4]) == 499_999
    assert htmltext.extract(df.limit(0)).collect() == []


def test_hostile_pages_take_linear_time_and_lose_nothing(spark):
    import time

    text = "the article text goes on and on for quite a while so that it counts as one"
    assert htmltext.blocks(f"<p>before<select><option>a<p>{text}")[-1]["text"] == text
    began = time.time()
    for page in ("<a " * 300_000, '<a "' * 200_000 + ">", "<svg>" * 200_000 + text, "<!-- " * 200_000, "<" * 1_000_000):
        htmltext.blocks(page)
    assert time.time() - began < 60
    assert htmltext.blocks('<p title="a>b">x y</p>')[0]["text"] == "x y"
    assert htmltext.blocks('<p>one <b class="open>two</b> three</p>')[0]["text"].startswith("one")


def test_attributes_are_read_by_their_whole_names(spark):
    pages = [
        '<div id="content" width="80"><h1>Title</h1><p>short text.',
        '<article><div data-hidden="false"><p>one two three four.</div></article>',
        '<article><div data-class="ad" class="lead" class="sidebar"><p>five six seven.</div></article>',
    ]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got == {0: "Title short text.", 1: "one two three four.", 2: "five six seven."}


def test_main_text_of_given_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == " ".join(x for x in parts if x)
