"""Columns of the input under the names that operators use inside come through as they were."""

import pytest

from stintline.llm import htmltext, language, linechunks, urltree

NAMES = ["__key", "__gone", "__may", "__slot", "__bit", "__bits", "__new", "__html", "__blocks", "__some", "__template", "own_0", "own_3", "template", "rid"]
TEXT = "\n".join(f"one two three four five six seven line {i} with words enough to be a chunk of text" for i in range(9))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, TEXT if i < 4 else f"other {i}", "en" if i % 2 else "fr", "<article><p>" + "word " * 60 + "</p></article>", f"https://a.org/x/{i}", *[f"{n}{i}" for n in NAMES]) for i in range(8)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, html string, url string, " + ", ".join(f"`{n}` string" for n in NAMES))


def check(out, rows):
    assert [c for c in out.columns if c in NAMES] == NAMES
    got = {r.doc_id: [r[n] for n in NAMES] for r in out.collect()}
    assert got == {r.doc_id: [r[n] for n in NAMES] for r in rows.collect()}


def test_line_dedup(rows):
    out = linechunks.dedup_lines(rows)
    check(out, rows)
    assert out.where("n_removed > 0").count() == 3


def test_language(rows):
    check(language.identify(rows, language.train(rows)), rows)


def test_html(rows):
    check(htmltext.extract(rows.drop("text")), rows)


def test_urls(rows):
    check(urltree.judge(rows), rows)
