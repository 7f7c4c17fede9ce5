"""Quality classifier: gated-attention multiple-instance learning over a document's passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import NOT_SPACE, Words, drop, lean, parts, save, sent_if_small
from stintline.llm.language import held_out

#: Words of a passage; the last one of a document may be shorter.
PASSAGE = 64
#: Rows of each label that the training sample holds at most.
SAMPLE = 1500
HIDDEN, GATE, ROUNDS, BATCH = 24, 12, 60, 32
THRESHOLD = 0.7

#: Classes of bytes whose shares describe a passage.
_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "space": (0x20, 0x09, 0x0B, 0x0C, 0x0D),
    "newline": (0x0A,),
    "stop": tuple(b".,;:"),
    "shout": tuple(b"!?"),
    "quote": tuple(b"\"'()[]"),
    "symbol": tuple(b"#$%&*+/<=>@\\^_`{|}~"),
    "dash": tuple(b"-"),
    "wide": range(0x80, 0x100),
}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _i
#: Shares of byte classes, then: words (log), mean and deviation of word lengths, share of distinct words, of words that
#: the document holds elsewhere, of the commonest word, capitalised words, words that end with a symbol.
FEATURES = len(_CLASSES) + 1 + 8


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, where each row's begin and end); a row without words has one empty passage."""
    n = len(offsets) - 1
    w = Words(data, offsets, NOT_SPACE)
    count = np.diff(w.ptr)
    size = np.maximum((count + PASSAGE - 1) // PASSAGE, 1)
    ptr = np.concatenate([[0], np.cumsum(size)])
    total = int(ptr[-1])
    out = np.zeros((total, FEATURES), np.float64)
    if not len(w.hash):
        return out, ptr
    place = np.arange(len(w.hash)) - w.ptr[w.row]
    passage = ptr[w.row] + place // PASSAGE
    # bytes belong to the passage of the last word that began
    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    owner = np.zeros(len(data), np.int64)
    begin = w.start[first].copy()
    first_of_row = place[first] == 0
    begin[first_of_row] = offsets[w.row[first[first_of_row]]]
    mark = np.zeros(len(data), np.int64)
    mark[begin] = 1
    number = np.cumsum(mark) - 1
    owner = passage[first][np.maximum(number, 0)]
    kinds = len(_CLASSES) + 1
    share = np.bincount(owner * kinds + _CLASS_OF[data], minlength=total * kinds).reshape(total, kinds).astype(np.float64)
    out[:, :kinds] = share / np.maximum(share.sum(axis=1), 1)[:, None]
    words = np.bincount(passage, minlength=total).astype(np.float64)
    length = w.length.astype(np.float64)
    k = kinds
    some = np.maximum(words, 1)
    out[:, k] = np.log1p(words) / np.log1p(PASSAGE)
    mean = np.bincount(passage, weights=length, minlength=total) / some
    out[:, k + 1] = mean / 10
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(passage, weights=length**2, minlength=total) / some - mean**2, 0)) / 10
    # repetition, within the passage and within the document
    order = np.lexsort((w.hash, passage))
    h, p = w.hash[order], passage[order]
    new = np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]))
    out[:, k + 3] = np.bincount(p[new], minlength=total) / some
    run = np.diff(np.append(np.flatnonzero(new), len(h)))
    np.maximum.at(out[:, k + 5], p[new], run)
    out[:, k + 5] /= some
    h, p = h[new], p[new]
    row = np.searchsorted(ptr, p, "right") - 1
    again = np.lexsort((h, row))
    h2, r2 = h[again], row[again]
    same = np.zeros(len(h2), bool)
    equal = (h2[1:] == h2[:-1]) & (r2[1:] == r2[:-1])
    same[1:] |= equal
    same[:-1] |= equal
    out[:, k + 4] = np.bincount(p[again][same], minlength=total) / some
    head, tail = data[w.start], data[w.start + w.length - 1]
    out[:, k + 6] = np.bincount(passage, weights=(head >= 65) & (head <= 90), minlength=total) / some
    out[:, k + 7] = np.bincount(passage, weights=_CLASS_OF[tail] == list(_CLASSES).index("symbol"), minlength=total) / some
    return out, ptr


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Passage encoder, gated attention over passages, and a logistic score of the weighted passage."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "w1": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)),
            "b1": np.zeros(HIDDEN),
            "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "a": rng.normal(0, GATE**-0.5, GATE),
            "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN),
            "b2": np.zeros(1),
        }

    def forward(self, x: np.ndarray, ptr: np.ndarray) -> dict[str, np.ndarray]:
        """All layers of a batch of documents; each has one passage at least."""
        p, begin = self.p, ptr[:-1]
        row = np.repeat(np.arange(len(begin)), np.diff(ptr))
        f = {"x": (x - self.mean) / self.scale, "row": row}
        f["h"] = np.tanh(f["x"] @ p["w1"] + p["b1"])
        f["t"], f["g"] = np.tanh(f["h"] @ p["v"]), _sigmoid(f["h"] @ p["u"])
        e = (f["t"] * f["g"]) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[row])
        f["attention"] = e / np.add.reduceat(e, begin)[row]
        f["z"] = np.add.reduceat(f["attention"][:, None] * f["h"], begin, axis=0)
        f["score"] = _sigmoid(f["z"] @ p["w2"] + p["b2"][0])
        return f

    def gradient(self, x: np.ndarray, ptr: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss."""
        p, f = self.p, self.forward(x, ptr)
        row, att, h, t, g = f["row"], f["attention"], f["h"], f["t"], f["g"]
        out = (f["score"] - y) * weight / weight.sum()
        dz = out[:, None] * p["w2"]
        dh = att[:, None] * dz[row]
        da = (dz[row] * h).sum(axis=1)
        de = att * (da - np.add.reduceat(att * da, ptr[:-1])[row])
        gate = de[:, None] * p["a"]
        dt, dg = gate * g * (1 - t**2), gate * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        d1 = dh * (1 - h**2)
        return {"w1": f["x"].T @ d1, "b1": d1.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "w2": f["z"].T @ out, "b2": np.array([out.sum()])}

    def fit(self, x: np.ndarray, ptr: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.01, decay: float = 1e-4) -> Model:
        """Adam on shuffled batches; both labels weigh alike, so that the score is comparable whatever their shares."""
        self.mean = x.mean(axis=0)
        self.scale = np.maximum(x.std(axis=0), 1e-3)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        rng, step = np.random.default_rng(3), 0
        size = np.diff(ptr)
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for low in range(0, len(y), BATCH):
                own = order[low : low + BATCH]
                cut = np.concatenate([[0], np.cumsum(size[own])])
                at = np.repeat(ptr[own] - cut[:-1], size[own]) + np.arange(cut[-1])
                step += 1
                for k, d in self.gradient(x[at], cut, y[own], weight[own]).items():
                    d = d + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _featured(batches):
    """(label, features of all passages as bytes) of each row; the sample's text stays in the tasks."""
    for batch in batches:
        rows = []
        for _, _, data, offsets in parts(batch.column(1)):
            x, ptr = passages(data, offsets)
            rows += [x[a:b].astype(np.float32).tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on about `sample` labelled rows of each label, those with the smallest hashes of the id, held-out rows left aside.

    Held out are rows whose crc32(id as text) mod 4 is 2. Rows with null labels or labels other than 0 and 1 teach
    nothing; an id labelled more than once counts with its highest label. Without rows of both labels the model
    stays as it was drawn.
    """
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, 4, 2)).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
    named = named.withColumn("h", F.xxhash64(F.col(id_col), F.lit(5)))
    counts = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model()
    bound = F.when(F.col("y") == 1, F.lit(min(1.0, sample / counts[1.0]))).otherwise(F.lit(min(1.0, sample / counts[0.0])))
    picked = named.where((F.col("h").cast("double") / float(2**63) + 1) / 2 <= bound).select(id_col, "y", "h")
    picked = save(picked, "picked")
    # about `sample` rows of each label, whatever the input
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(sent_if_small(picked, 40), id_col).select("y", "text")
    rows = texts.mapInArrow(lean(_featured), "y double, x binary").collect()
    drop(picked)
    rows.sort(key=lambda r: (r.y, bytes(r.x)))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    ptr = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Model().fit(np.concatenate(bags).astype(np.float64), ptr, np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` of `docs` with score (0 to 1, higher: label 1 likelier), predicted and the passage that weighs most.

    Whole texts are read, passage by passage. Null and empty texts are one empty passage and are scored as such.
    Input columns of the new names are replaced. Repeated rows each give a row. An empty table gives an empty one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted", "top_passage")]
    plain = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in parts(batch.column(batch.num_columns - 1), 1_000_000):
                x, ptr = passages(data, offsets)
                f = model.forward(x, ptr)
                tops = [int(np.argmax(f["attention"][a:b])) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                own = batch.slice(row, end - row)
                yield pa.record_batch(
                    [*own.columns[:-1], pa.array(f["score"], pa.float64()), pa.array((f["score"] >= threshold).astype(np.int32)), pa.array(tops, pa.int32())],
                    names=[*own.schema.names[:-1], "score", "predicted", "top_passage"],
                )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(lean(run), f"{kinds}score double, predicted int, top_passage int")
