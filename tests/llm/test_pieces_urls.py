"""SentencePiece against brute force and the library; the URL tree and the pipeline against plain Python."""

import math
import os
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stintline.llm import decontaminate, language, linechunks, minhash, pieces, urltree
from stintline.llm.queries import MODEL

needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no public model here")


class Toy:
    """A model of a few pieces and all bytes, with the library's interface."""

    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "▁▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"]
    scores = [0.0] * 257 + [-3.0, -3.5, -2.0, -2.5, -3.0, -3.1, -4.0, -3.9, -5.5]

    def get_piece_size(self):
        return len(self.pieces)

    def id_to_piece(self, i):
        return self.pieces[i]

    def get_score(self, i):
        return self.scores[i]

    def is_control(self, i):
        return False

    def is_unused(self, i):
        return False

    def is_unknown(self, i):
        return i == 0

    def is_byte(self, i):
        return 1 <= i <= 256

    def piece_to_id(self, t):
        return self.pieces.index(t) if t in self.pieces else 0


def brute(text, model):
    """Best path over the whole text, not word by word."""
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    table = {t: i for i, t in enumerate(model.pieces) if i > 256}
    best = [(0.0, 0, None)] + [(-math.inf, 0, None)] * len(s)
    for t in range(1, len(s) + 1):
        for f in range(t):
            i = table.get(s[f:t], -1 if t == f + 1 else None)
            if i is not None:
                score = best[f][0] + (model.scores[i] if i >= 0 else min(model.scores[257:]) - 10)
                if score > best[t][0]:
                    best[t] = (score, f, i)
    out, t = [], len(s)
    while t:
        _, f, i = best[t]
        out = ([i] if i >= 0 else [b + 1 for b in s[f].encode()]) + out
        t = f
    return out


def test_encoding_matches_brute_force(spark):
    toy = pieces.Pieces.of(Toy())
    texts = ["", " ", "a", "abab ba  ab", "aba\nab\n\n b", "éa b", "漢 a", "ab " * 400, "a" * 300, "b a  ", "\n", "aab"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "x"), (3, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for frequent in (0, 3, 1000):
        out = pieces.encode(df.repartition(2), toy, frequent=frequent)
        assert out.columns == ["doc_id", "ids", "round_trip"]
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id == 99:
                assert r.ids is None and r.round_trip is None
            else:
                assert list(r.ids) == brute(texts[r.doc_id], Toy()) and r.round_trip
        back = {r.doc_id: r.text for r in pieces.decode(out, toy).collect()}
        assert back == {99: None} | dict(enumerate(texts))
    assert pieces.encode(df.limit(0), toy).collect() == []


def test_own_space_marks_and_long_words_come_back(spark):
    toy = pieces.Pieces.of(Toy())
    texts = ["a ▁ b", "▁▁", "x" * 5000, "é" * 700, "tab\tand\r\nreturn"]
    out = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), toy)
    assert all(r.round_trip for r in out.collect())
    assert {r.doc_id: r.text for r in pieces.decode(out, toy).collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("frequent", [0, 1000])
def test_words_of_over_512_bytes_match_brute_force(spark, frequent):
    toy = pieces.Pieces.of(Toy())
    texts = ["ab" * 400, "aba" * 171 + "ab" * 90, "漢" * 169 + "aaba" * 60 + "é", " " * 700 + "ba", "x ab " + "ba" * 300, "a" * 511 + "ba"]
    out = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), toy, frequent=frequent)
    for r in out.collect():
        assert r.round_trip and list(r.ids) == brute(texts[r.doc_id], Toy())


@needs_model
def test_no_path_of_the_library_scores_higher(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb
    except Exception:
        pytest.skip("no message classes")
    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split("text", "\n")).alias("text")).distinct().where("length(text) between 1 and 400").withColumn("doc_id", F.monotonically_increasing_id()).limit(300)
    rows = pieces.encode(spark.createDataFrame(docs.collect()), pieces.Pieces.load(MODEL), frequent=500)
    texts = {r.doc_id: r.text for r in pieces.decode(rows, pieces.Pieces.load(MODEL)).collect()}
    got = {r.doc_id: list(r.ids) for r in rows.collect()}
    total = lambda ids: sum(model.pieces[i].score for i in ids)
    whole = {k: v for k, v in got.items() if not any(3 <= i <= 258 for i in v)}
    assert len(whole) > 100 and all(total(v) >= total(library.encode(texts[k])) for k, v in whole.items())
    assert sum(v == library.encode(texts[k]) for k, v in whole.items()) > 0.2 * len(whole)


URLS = [
    ("http://A.example.ORG/es/5?x=1", "a.example.org", "/es/5", "example.org/es/"),
    ("https://example.org/en/12#top", "example.org", "/en/12", "example.org/en/1"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/"),
    ("https://notorg/en/2", "notorg", "/en/2", None),
    ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/"),
    ("http://com/de/1", "com", "/de/1", "com/de/"),
    ("http://x.com/de", "x.com", "/de", None),
    ("http://x.org", "x.org", "", None),
    ("no scheme", "", "", None),
    (None, "", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urltree.judge(df).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert got[i][:3] == (host, path, rule)
        if rule:
            assert got[i][3] == {r: v for v, r in urltree.RULES}[rule]
    assert urltree.judge(df.limit(0)).collect() == []


def grow(leaves, children=urltree.CHILDREN, strength=urltree.STRENGTH, sigma=urltree.SIGMA):
    """The tree by recursion: leaves {(host, segments): (pages, labelled, blocked)}."""
    n, b = sum(x[1] for x in leaves.values()), sum(x[2] for x in leaves.values())
    root, out = b / n if n else 0.5, {}

    def rec(own, level, rate):
        kids = {}
        for key, v in own.items():
            if len(key[1]) <= level:
                out[key] = rate
            else:
                kids.setdefault(key[1][level], {})[key] = v
        total = {k: [sum(v[i] for v in x.values()) for i in range(3)] for k, x in kids.items()}
        pages, n, b = (sum(t[i] for t in total.values()) for i in range(3))
        named = {}
        for k, t in total.items():
            if len(kids) > children and 2 * max(x[0] for x in total.values()) < pages:
                name = "*"
            else:
                share = b / n if n else 0
                odd = t[1] and abs(t[2] / t[1] - share) > sigma * math.sqrt(share * (1 - share) / t[1])
                name = k if odd else "~"
            named.setdefault(name, []).append(k)
        for ks in named.values():
            n1, b1 = sum(total[k][1] for k in ks), sum(total[k][2] for k in ks)
            rec({key: v for k in ks for key, v in kids[k].items()}, level + 1, (b1 + strength * rate) / (n1 + strength))

    for host in {k[0] for k in leaves}:
        own = {k: v for k, v in leaves.items() if k[0] == host}
        rec(own, 0, (sum(v[2] for v in own.values()) + strength * root) / (sum(v[1] for v in own.values()) + strength))
    return out


def test_url_tree_matches_recursion(spark):
    leaves = {}
    for i in range(400):
        key = (f"h{i % 3}", tuple(f"s{(i * 7) % (5 + 17 * (d == 1))}_{d}" for d in range(i % 4)))
        old = leaves.get(key, (0, 0, 0))
        leaves[key] = (old[0] + 1 + i % 5, old[1] + i % 3, old[2] + (i % 3 if (i // 3) % 4 == 0 else 0))
    df = spark.createDataFrame([(h, list(s), *v) for (h, s), v in leaves.items()], "host string, template array<string>, pages long, labelled long, blocked long")
    got = {(r.host, tuple(r.template)): r.rate for r in urltree.grow(df).collect()}
    want = grow(leaves)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_url_tree_of_deep_paths_matches_recursion(spark):
    leaves = {}
    for i in range(120):
        stem = tuple(f"d{j}" for j in range(3 + 20 * (i % 3)))
        key = ("h", (*stem, f"k{i % 5}", *(["x"] * (i % 4)), f"z{i % 2}"))
        leaves[key] = (1 + i % 5, i % 3, i % 3 if i % 5 == 0 else 0)
    leaves[("h", ("d0", "d1"))] = (3, 2, 2)
    leaves[("one", tuple("abcdefghij"))] = (4, 3, 3)
    leaves[("none", ())] = (1, 0, 0)
    df = spark.createDataFrame([(h, list(s), *v) for (h, s), v in leaves.items()], "host string, template array<string>, pages long, labelled long, blocked long")
    rows = urltree.grow(df).collect()
    got, want = {(r.host, tuple(r.template)): r.rate for r in rows}, grow(leaves)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {r.branch for r in rows if r.host == "one"} == {"/~" * 10}


def test_templates(spark):
    paths = ["/a/12/2024-05-06/x9", "/a/b.html/77.html", "/deadbeef01/p-12345-q", "", "/1/2/3/4/5/6/7/8/9/10"]
    got = [list(r.t) for r in spark.createDataFrame(list(enumerate(paths)), "i int, p string").select("i", urltree.template_of(F.col("p")).alias("t")).orderBy("i").collect()]
    assert got[0] == ["", "a", "{n}", "{date}", "x9"] and got[1] == ["", "a", "b.html", "{n}.html"]
    assert got[2] == ["", "{hex}", "p-{n}-q"] and got[3] == [""] and len(got[4]) == paths[4].count("/") + 1


@needs_model
def test_pipeline_matches_its_stages_by_hand(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = {"en": "the house of the old man and the river that was here before", "de": "der alte mann und das haus an der strasse ist nicht mehr da", "fr": "la maison de la rue est dans le vieux village avec une porte", "es": "la casa de los abuelos en el pueblo y una calle para todos los"}
    docs = []
    for i in range(48):
        lang = list(prose)[i % 4]
        words = prose[lang].split()
        docs.append((i, " ".join(words[(j * (i % 7 + 1) + j // 5 + i) % len(words)] for j in range(40)) + f" {i}", lang, "s", 1))
    block = "\n".join(f"shared license line number {k} of the very same text" for k in range(12))
    docs += [(100, docs[0][1], "en", "s", 1), (101, "12 34 --", "en", "s", 1), (102, docs[5][1] + " " + passage, "de", "s", 1), (103, docs[9][1] + " three\n" + block, "de", "s", 1), (104, docs[13][1] + " four\n" + block, "de", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    base = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: r.text for r in language.identify(base, language.train(base)).where("lang_pred <> 'und'").where(F.col("score") >= corpus_pipeline.LEAST_SCORE).collect()}
    assert 101 not in kept and len(kept) >= len(docs) - 6
    texts = {}
    seen = set()
    for i in sorted(kept):
        body = []
        lines = kept[i].split("\n")
        from tests.llm.test_text import cut, is_long

        for c in cut("\n".join(lines)):
            joined = "\n".join(c)
            if (len(c) >= 2 or is_long(joined)) and len(joined) >= linechunks.LEAST_CHARS:
                if joined in seen:
                    continue
                seen.add(joined)
            body.append(joined)
        texts[i] = "\n".join(body)
    from tests.llm.test_near import closure, shingles

    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= minhash.PERCENT * len(sets[a] | sets[b])]
    single = {i for i, r in closure(sets, links).items() if i == r}
    words = re.findall(r"\S+", passage)
    clean = {i for i in single if not any(" ".join(words[k : k + decontaminate.WINDOW]) in texts[i] for k in range(len(words) - 9))}
    assert set(got) == clean and 100 not in clean and 102 not in clean
    table = pieces.Pieces.load(MODEL)
    shown = SimpleNamespace(ids={i: list(r.ids) for i, r in got.items()})
    assert all(b"".join(table.bytes_of[x] for x in shown.ids[i])[1:].decode() == texts[i] for i in clean)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.values())


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"the house of the old man number {i} and the river " * 3, "en", "mine", 7, "k", "lang") for i in range(6)]
    rows += [(None, "the river and the house are here again", None, "mine", 7, "k", "x"), (8, None, "en", "mine", 7, "k", "x"), (9, "", "en", "mine", 7, "k", "x"), (10, passage, "en", "mine", 7, "k", "x"), (8, None, "en", "mine", 7, "k", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, n_removed long, __key string, own_3 string")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns
        assert all((r["lang_pred"], r["n_removed"], r["__key"]) == ("mine", 7, "k") and r["own_3"] in ("lang", "x") for r in got)
        counts.append(len(got))
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert counts == [8, 11, 11, 10]
