"""Main text of web pages: flat text blocks, features of a block and its neighbours, a decision tree over them.

Pages are cut into blocks inside tasks. The tree is fitted by Spark's own learner on a small labelled table of
hand-made pages, and applied to arrays of blocks as one SQL expression.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import PART_ROWS, apart, lean
from stintline.llm.html_samples import SAMPLES

#: Tags whose content is no text.
_SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video title select textarea".split())
#: Tags that begin and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark the parts around an article, and the article itself.
_AROUND = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|byline|captcha|alert|comments?|cookies?|consent|copyright|disclaimer|disqus|foot(?:er)?|login|menu|meta|modal|nav\w*|newsletter|notice"
    r"|outbrain|paywall|pag(?:er|ination)|popup|privacy|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|tags?|taboola|toolbar|trending|warning|widget)(?:$|[-_\s\d])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[-_\s])(?:head(?:er)?|masthead)(?:$|[-_\s\d])", re.I)
_WITHIN = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|post|story|text)(?:$|[-_\s\d])", re.I)
_OUTSIDE = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"))
_COMMENT = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
_NAME = r"<(/?)([A-Za-z][^\s/>]*)"
_TOKEN = re.compile(_COMMENT + "|" + _NAME + r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.S)
#: The same for the rest of a page once a quote stays open to its end: any > ends a tag.
_LOOSE = re.compile(_COMMENT + "|" + _NAME + r"([^>]*)>|[^<]+|<", re.S)
_BEGINS = re.compile(r"</?[A-Za-z]")
_CLOSES = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SKIPPED}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACES = re.compile(r"\s+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "inside", "header", "heading", "listed", "ends")
BLOCK = "array<struct<text: string, words: double, links: double, outside: double, inside: double, header: double, heading: double, listed: double, ends: double>>"


class _Open:
    __slots__ = ("tag", "outside", "inside", "header", "label")

    def __init__(self, tag: str, outside: bool, inside: bool, header: bool, label: str | None):
        self.tag, self.outside, self.inside, self.header, self.label = tag, outside, inside, header, label


def blocks(page: str | None) -> list[dict]:
    """Text blocks of a page in order, with the features of each that do not need its neighbours."""
    out: list[dict] = []
    stack = [_Open("", False, False, False, None)]
    text: list[str] = []
    linked, link = 0, 0
    page, at = page or "", 0
    last_end, token_of, unclosed = page.rfind(">"), _TOKEN, set()

    def flush() -> None:
        nonlocal linked
        body = _SPACES.sub(" ", "".join(text)).strip()
        text.clear()
        if body:
            words = body.count(" ") + 1
            top = stack[-1]
            names = {x.tag for x in stack}
            out.append(
                {
                    "text": body,
                    "words": float(words),
                    "links": min(1.0, linked / words),
                    "outside": float(top.outside),
                    "inside": float(top.inside),
                    "header": float(top.header),
                    "heading": float(bool(names & {"h1", "h2", "h3", "h4", "h5", "h6"})),
                    "listed": float(bool(names & {"li", "dd", "dt", "td", "th"})),
                    "ends": float(body[-1] in ".!?…。\"”»:;"),
                    "label": top.label == "1",
                }
            )
        linked = 0

    while at < len(page):
        if at > last_end:  # no tag can end any more
            text.append(html.unescape(page[at:]))
            if link:
                linked += len(page[at:].split())
            break
        m = token_of.match(page, at)
        if token_of is _TOKEN and m.group(0) == "<" and _BEGINS.match(page, at):
            token_of = _LOOSE
            m = token_of.match(page, at)
        at = m.end()
        token, tag = m.group(0), (m.group(2) or "").lower()
        if not tag:
            if token.startswith("<![CDATA["):
                token = token[9:].removesuffix("]]>")
            elif token.startswith(("<!", "<?")) and len(token) > 1:
                continue
            body = html.unescape(token)
            text.append(body)
            if link:
                linked += len(body.split())
            continue
        if m.group(1):
            if tag in _BLOCK:
                flush()
                if any(x.tag == tag for x in stack[1:]):
                    while stack[-1].tag != tag:
                        stack.pop()
                    stack.pop()
                link = 0
            elif tag == "a":
                link = max(0, link - 1)
            continue
        if tag in _SKIPPED and not m.group(3).rstrip().endswith("/"):
            end = None if tag in unclosed else _CLOSES[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(page)
            else:  # nothing but the tag goes if it is never closed
                unclosed.add(tag)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            link = 1
            continue
        if tag not in _BLOCK:
            continue
        flush()
        if tag == "hr":
            continue
        if tag == "p" and any(x.tag == "p" for x in stack):
            while stack[-1].tag != "p" and stack[-1].tag not in ("article", "main", "section", "div", "td", "li", "blockquote", "body"):
                stack.pop()
            if stack[-1].tag == "p":
                stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            stack.pop()
        top = stack[-1]
        named = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(m.group(3)))} if m.group(3) else {}
        hint = "" if tag in ("html", "body") else " ".join(named.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in named or named.get("aria-hidden", "") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        main = tag in ("article", "main") and not (hint and _AROUND.search(hint))
        around = tag in _OUTSIDE or hidden or bool(hint and _AROUND.search(hint) and not main)
        header = top.header or tag == "header" or bool(hint and _HEADER.search(hint))
        inside = (top.inside or main or bool(hint and _WITHIN.search(hint) and not header)) and not around and not top.outside
        stack.append(_Open(tag, top.outside or around, inside, header, named.get("data-main", top.label)))
    flush()
    return out


def _names(b: Column, before: Column, after: Column) -> list[Column]:
    """The features of a block and its neighbours, in the order of FEATURES; a missing neighbour is empty."""
    side = [F.coalesce(x.getField(n), F.lit(0.0)) for x in (before, after) for n in ("words", "links")]
    return [b.words, b.links, *side, b.outside, b.inside, b.header, b.heading, b.listed, b.ends]


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: one row per block of the sample pages, with its neighbours' features."""
    rows = []
    for page in SAMPLES:
        found = blocks(page)
        for i, b in enumerate(found):
            near = [found[k] if 0 <= k < len(found) else {"words": 0.0, "links": 0.0} for k in (i - 1, i + 1)]
            side = [x[n] for x in near for n in ("words", "links")]
            rows.append(([b["words"], b["links"], *side, *[b[n] for n in FEATURES[6:]]], float(bool(b["label"]))))
    return spark.createDataFrame(rows, "features array<double>, label double")


def fit(table: DataFrame, depth: int = 6) -> str:
    """A decision tree over the labelled table, as Spark's text form of it."""
    ready = table.select(array_to_vector("features").alias("features"), "label").coalesce(1)
    return DecisionTreeClassifier(maxDepth=depth, seed=1, maxBins=64, minInstancesPerNode=2).fit(ready).toDebugString


def as_condition(tree: str, features: list[Column]) -> Column:
    """A tree's text form as a nested condition over the features: true for label 1."""
    lines = [x.strip() for x in tree.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]) >= 0.5)
        number, bound = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line).groups()
        low = node()
        at += 1
        high = node()
        return F.when(features[int(number)] <= float(bound), low).otherwise(high)

    return node()


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` with the main text of each: its article's blocks in page order, joined by one space, in whole.

    Scripts, styles, comments and other markup are no text; character references are decoded; white space inside a
    block is one space. A block stays if the tree says so, from its words, link density and place and the words and
    link density of the blocks beside it. Null, empty and block-free pages give an empty text. A text column of the
    input is replaced; other columns pass through. Repeated rows each give a row. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    tree = fit(labelled(spark))
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    names = apart(rest, ())
    plain = pages.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()], F.col(f"`{html_col}`").alias("__html"))

    def run(batches):
        fields = ("text", "words", "links", "outside", "inside", "header", "heading", "listed", "ends")
        kind = pa.list_(pa.struct([pa.field(n, pa.string() if n == "text" else pa.float64()) for n in fields]))
        for batch in batches:
            for low in range(0, batch.num_rows, PART_ROWS):
                own = batch.slice(low, PART_ROWS)
                found = [[{n: b[n] for n in fields} for b in blocks(x)] for x in own.column(own.num_columns - 1).to_pylist()]
                yield pa.record_batch([*own.columns[:-1], pa.array(found, kind)], names=[*own.schema.names[:-1], "__blocks"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    cut = plain.mapInArrow(lean(run), f"{kinds}__blocks {BLOCK}")
    nothing = F.lit(None).cast(BLOCK.removeprefix("array<").removesuffix(">"))

    def stays(b: Column, i: Column) -> Column:
        return as_condition(tree, _names(b, F.when(i > 0, F.get("__blocks", i - 1)).otherwise(nothing), F.get("__blocks", i + 1)))

    main = F.array_join(F.transform(F.filter("__blocks", stays), lambda b: b.text), " ")
    found = cut.select(*names.values(), main.alias("__text"))
    return found.select(*[F.col(new).alias(old) for old, new in names.items()], F.col("__text").alias(text_col))
