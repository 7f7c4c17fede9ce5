"""Language ID: a linear SVM picks the family, one-versus-one linear SVMs then pick the language within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import apart, lean, parts, renamed

#: Rows of each language that the training sample holds, about; whole texts of each.
SAMPLE = 600
#: Size of the table of hashed letter n-grams.
TABLE = 1 << 15
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Rows, and bytes of text, that are counted at once.
_ROWS, _BYTES = 64, 1 << 17
UNKNOWN = "und"

#: Language families of ISO 639-1 codes; a language outside them is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

#: Letters: ASCII letters (as lower case) and all non-ASCII bytes.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


def held_out(id_col: str = "doc_id", modulus: int = 5, remainder: int = 0) -> Column:
    """crc32(id as text) mod `modulus` = `remainder`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def grams(data: np.ndarray, offsets: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 4-byte runs of letters with word borders that begin at bytes low to high, and the row of each; only letters count."""
    high = len(data) if high is None else min(high, len(data))
    own = data[low : high + 3].copy()
    n, most = len(own), high - low
    if most <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upper = (own >= 65) & (own <= 90)
    own[upper] += 32
    letter = _LETTERS[own]
    code = np.where(letter, own, 32).astype(np.uint64)
    row = np.searchsorted(offsets, np.arange(low, low + n), "right") - 1
    out, rows, run = [], [], code.copy()
    for k in range(1, 5):
        size = n - k + 1
        if size <= 0:
            break
        if k > 1:
            run = run[:size] * np.uint64(256) + code[k - 1 :]
        good = letter[:size].copy() if k == 1 else (row[:size] == row[k - 1 :]) & (letter[:size] | letter[k - 1 :])
        if k > 2:
            good &= letter[1 : size + 1]
        if k > 3:
            good &= letter[2 : size + 2]
        good[most:] = False
        h = run[good]
        out.append((((h + np.uint64(k << 40)) * _SPREAD) >> np.uint64(49)).astype(np.int64))
        rows.append(row[:size][good])
    return np.concatenate(out), np.concatenate(rows)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each hashed n-gram stands in each row, whole rows, over slices of the bytes."""
    m = len(offsets) - 1
    out = np.zeros(m * TABLE, np.float32)
    for low in range(0, len(data), _BYTES):
        g, r = grams(data, offsets, low, low + _BYTES)
        a, b = (int(r.min()), int(r.max()) + 1) if len(r) else (0, 0)
        out[a * TABLE : b * TABLE] += np.bincount((r - a) * TABLE + g, minlength=(b - a) * TABLE)
    return out.reshape(m, TABLE)


def _features(batches):
    """(lang, hashed n-grams, square roots of their shares) of each text: sparse rows of unit length."""
    for batch in batches:
        for row, end, data, offsets in parts(batch.column(1)):
            for r in range(end - row):
                own = counts(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))[0]
                at = np.flatnonzero(own)
                value = np.sqrt(own[at] / max(own.sum(), 1))
                yield pa.record_batch([batch.column(0).slice(row + r, 1), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([value], pa.list_(pa.float32()))], names=["lang", "at", "value"])


def linear_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 60, cost: float = 4.0) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge SVM (y in -1, 1) by dual coordinate descent; a constant feature stands for the bias."""
    n = len(y)
    w, b, alpha = np.zeros(TABLE), 0.0, np.zeros(n)
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    square = np.array([(v**2).sum() for _, v in x]) + 1 + 1 / (2 * cost * weight)
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            at, value = x[i]
            g = y[i] * (w[at] @ value + b) - 1 + alpha[i] / (2 * cost * weight[i])
            if alpha[i] == 0 and g >= 0:
                continue
            step = max(alpha[i] - g / square[i], 0.0) - alpha[i]
            alpha[i] += step
            w[at] += step * y[i] * value
            b += step * y[i]
            most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, b


class Model:
    """Family SVMs (one versus one over families), and per family one-versus-one SVMs over its languages."""

    def __init__(self, x: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.pairs: list[tuple[str, str]] = []
        weights, biases = [], []
        lang = np.array(langs)
        fam = np.array([family(x) for x in langs])
        jobs = [(fam, pair) for pair in combinations(self.families, 2)]
        jobs += [(lang, pair) for f in self.families for pair in combinations([k for k in self.langs if family(k) == f], 2)]
        for label, (a, b) in jobs:
            own = np.flatnonzero((label == a) | (label == b))
            w, c = linear_svm([x[i] for i in own], np.where(label[own] == a, 1.0, -1.0))
            weights.append(w)
            biases.append(c)
            self.pairs.append((a, b))
        self.weights = np.array(weights, np.float32).reshape(len(self.pairs), TABLE)
        self.biases = np.array(biases)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin of each SVM, whether there are letters) of each row."""
        n = len(offsets) - 1
        out, total = np.zeros((n, len(self.pairs))), np.zeros(n)
        for low in range(0, n, _ROWS):
            own = offsets[low : low + _ROWS + 1]
            m = len(own) - 1
            x = counts(data[own[0] : own[-1]], own - own[0])
            total[low : low + m] = x.sum(axis=1, dtype=np.float64)
            x /= np.maximum(total[low : low + m], 1)[:, None].astype(np.float32)
            np.sqrt(x, out=x)
            out[low : low + m] = x @ self.weights.T + self.biases
        return out, total > 0

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin, some = self.margins(data, offsets)
        n = len(some)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        sure = 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))

        def vote(names: list[str]) -> np.ndarray:
            """Share of each name: mean pairwise probability, over all names."""
            if len(names) == 1:
                return np.ones((n, 1))
            score = np.zeros((n, len(names)))
            for k, (a, b) in enumerate(self.pairs):
                if a in names and b in names:
                    score[:, names.index(a)] += sure[:, k]
                    score[:, names.index(b)] += 1 - sure[:, k]
            return score / (len(names) - 1)

        top = vote(self.families)
        pick = top.argmax(axis=1)
        out, score = np.array([UNKNOWN] * n, dtype=object), np.zeros(n)
        for f, name in enumerate(self.families):
            names = [k for k in self.langs if family(k) == name]
            inner = vote(names)
            own = np.flatnonzero((pick == f) & some)
            out[own] = np.array(names, dtype=object)[inner[own].argmax(axis=1)]
            score[own] = top[own, f] * inner[own].max(axis=1)
        return out.tolist(), score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on about `sample` rows of each language, those with the smallest hash of the id, rows held out left aside.

    Languages are the distinct non-null labels; the sampled texts count in whole. A language of fewer rows gives them
    all. Repeated rows may be drawn more than once; rows of one id are drawn together.
    """
    known = docs.where(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(3)).alias("h"))
    known = known.where("lang is not null and text is not null and lang <> 'und'")
    shares = {r.lang: min(1.0, sample / r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model([], [])
    # one scan for all languages
    bound = F.create_map(*[x for lang, share in sorted(shares.items()) for x in (F.lit(lang), F.lit(float(2**63) * (2 * share - 1)))])
    picked = known.where(F.col("h").cast("double") <= F.element_at(bound, F.col("lang"))).select("lang", "text")
    rows = picked.mapInArrow(lean(_features), "lang string, at array<int>, value array<float>").toArrow().combine_chunks()
    langs = rows["lang"].to_pylist()
    pairs = [(at.values.to_numpy(), value.values.to_numpy()) for at, value in zip(rows["at"], rows["value"], strict=True)]
    order = sorted(range(len(langs)), key=lambda i: (langs[i], pairs[i][0].tobytes(), pairs[i][1].tobytes()))
    return Model([pairs[i] for i in order], [langs[i] for i in order])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred and score, of whole texts.

    Null texts and those without letters get `und` and score 0. The score is the
    share of the family times that of the language among its one-versus-one SVMs, 0 to 1. Input columns of the two new
    names are replaced. Repeated rows each give a row; an empty table gives an empty one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    text = [] if text_col in keep else [text_col]
    names = apart([*keep, *text], (text_col,))
    plain = renamed(docs, names).select("*", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__some"))
    place = plain.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in parts(batch.column(place), 1_000_000):
                own = batch.slice(row, end - row)
                some = own.column(own.num_columns - 1).to_numpy(zero_copy_only=False)
                langs, score = model.predict(data, offsets)
                langs = [x if y else UNKNOWN for x, y in zip(langs, some, strict=True)]
                yield pa.record_batch([*own.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score * some, pa.float64())], names=[*own.schema.names[: len(keep)], "lang_pred", "score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[: len(keep)])
    found = plain.mapInArrow(lean(run), f"{kinds}lang_pred string, score double")
    return found.select(*[F.col(f"`{names[c]}`").alias(c) for c in keep], "lang_pred", "score")
