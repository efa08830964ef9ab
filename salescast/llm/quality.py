"""Quality of documents by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from salescast.llm.labelled import labelled_texts

PASSAGE = 400
SYMBOLS = "#%&$*|!?.,;:=\"'()[]{}<>@/_-"
ENDS = ".!?"
FEATURES = 24
HIDDEN = 16
GATE = 8


def passages(text: str | None) -> list[str]:
    """The whole text in pieces of about 400 characters, cut at spaces; one if it is empty."""
    text = text or ""
    found, at = [], 0
    while at < len(text):
        end = text.find(" ", at + PASSAGE)
        end = len(text) if end < 0 else end + 1
        found.append(text[at:end])
        at = end
    return found or [""]


def encode(passage: str) -> list[float]:
    """What a passage looks like: shares of kinds of characters, of words, and of repeats."""
    words = passage.split()
    chars, n = max(1, len(passage)), max(1, len(words))
    marks = [passage.count(c) / chars for c in SYMBOLS[:12]]
    others = sum(passage.count(c) for c in SYMBOLS[12:]) / chars
    upper = sum(map(str.isupper, words)) / n
    title = sum(map(str.istitle, words)) / n
    letters = sum(map(str.isalpha, words)) / n
    distinct = len(set(words)) / n
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    size = sum(map(len, words)) / n
    short = sum(len(w) <= 3 for w in words) / n
    digits = sum(map(str.isdigit, words)) / n
    lines = passage.count("\n") / chars
    ends = sum(w[-1] in ENDS for w in words) / n
    return [
        *marks, others, upper, title, letters, distinct, again, size / 10, short, digits, lines, ends,
        math.log1p(len(words)) / 5,
    ]


class Attention:
    """Passages encoded, weighed by gated attention, and summed into one representation.

    With h = tanh(x E + e): the weight of a passage is the softmax, over its document, of
    (tanh(h V) * sigmoid(h U)) w, and the document's logit is the weighed sum of h times c.
    """

    SHAPES = {
        "E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,),
    }

    def __init__(self, mean: np.ndarray, scale: np.ndarray, params: dict[str, np.ndarray]):
        self.mean, self.scale, self.p = mean, scale, params

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        a = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        bag = np.add.reduceat(h * a[:, None], starts, axis=0)
        logit = bag @ p["c"] + p["b"]
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "bag": bag, "sizes": sizes, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    @classmethod
    def fit(cls, x: np.ndarray, starts: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 3):
        """Adam on the cross-entropy of all documents at once; the smaller label weighs as much."""
        draw = np.random.default_rng(seed)
        params = {k: draw.normal(0, 1 / math.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in cls.SHAPES.items()}
        model = cls(x.mean(axis=0), x.std(axis=0) + 1e-3, params)
        first = {k: np.zeros_like(v) for k, v in params.items()}
        second = {k: np.zeros_like(v) for k, v in params.items()}
        for step in range(1, steps + 1):
            f = model.forward(x, starts)
            d = (f["score"] - y) / len(y)
            g = {"c": f["bag"].T @ d, "b": np.array([d.sum()])}
            bag = d[:, None] * params["c"]
            wide = np.repeat(bag, f["sizes"], axis=0)
            pull = (wide * f["h"]).sum(axis=1)
            mean = np.repeat(np.add.reduceat(f["a"] * pull, starts), f["sizes"])
            da = f["a"] * (pull - mean)
            g["w"] = (f["t"] * f["s"]).T @ da
            gate = da[:, None] * params["w"]
            dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
            g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
            dh = wide * f["a"][:, None] + dt @ params["V"].T + ds @ params["U"].T
            dz = dh * (1 - f["h"] ** 2)
            g["E"], g["e"] = f["z"].T @ dz, dz.sum(axis=0)
            for k in params:
                slope = g[k] + decay * params[k] / len(y) * 100
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of the texts one after the other, and where each text begins."""
    rows, starts = [], []
    for text in texts:
        starts.append(len(rows))
        rows += [encode(p) for p in passages(text)]
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(starts, np.int64)


def score_quality(
    docs: DataFrame, labels: DataFrame, keep: list, key: str = "doc_id", text: str = "text", label: str = "quality",
    per_label: int = 3000,
) -> DataFrame:
    """Score every whole text from 0 to 1, beside the columns ``keep``.

    The model is fitted on at most ``per_label`` labelled texts of each kind that are not
    held out; their passages, encoded by the executors, are the only thing the driver sees.
    All passages of a text count. NULL and empty texts are one empty passage. With one kind
    of label only, or none, all scores are 0.5. Rows are independent, so repeated ones and
    NULL keys stay. An empty table gives no rows. Returns ``keep``, ``score``, and
    ``attention``, the largest weight that one passage has.
    """
    sample = labelled_texts(docs, labels, label, per_label, key, text)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, starts = bags(batch.column(1).to_pylist())
            ends = [*starts[1:], len(x)]
            rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "x"])

    got = sample.select("label", "text").mapInArrow(encoded, "label int, x binary").collect()
    got = sorted(((r["label"], bytes(r["x"])) for r in got), key=lambda r: r[1])
    model = None
    if len({y for y, _ in got}) == 2:
        each = [np.frombuffer(x, np.float32).reshape(-1, FEATURES).astype(np.float64) for _, x in got]
        starts = np.cumsum([0, *map(len, each[:-1])])
        model = Attention.fit(np.concatenate(each), starts, np.array([y for y, _ in got], np.float64))
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.mean, model.scale, model.p))
    kept = docs.select(*keep)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, attention double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Attention(*sent.value) if sent.value else None
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                x, starts = bags(part.column(part.num_columns - 1).to_pylist())
                if fitted:
                    f = fitted.forward(x, starts)
                    scores, most = f["score"], np.maximum.reduceat(f["a"], starts)
                else:
                    scores, most = np.full(len(starts), 0.5), np.ones(len(starts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(scores), pa.array(most)], names=[*part.schema.names[:-1], "score", "attention"]
                )

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(scored, out)
