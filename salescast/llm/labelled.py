"""Bounded samples of labelled texts, and a small logistic regression."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescast.sources.staging import stage


def held_out(key: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether the CRC of the key's text falls in the part kept from learning; NULL keys do not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, per_label: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """At most ``per_label`` texts of each of the labels 0 and 1: ``label``, ``text``.

    Those of the smallest hashes of their keys, so the choice is the same each time. A key
    that has both labels, or is NULL or held out, is left out; NULL texts are empty.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other")
    chosen = [
        known.filter(F.col("label") == value).select(F.col(key).alias("_key"), "label")
        .orderBy(F.xxhash64("_key"), "_key").limit(per_label)
        for value in (0, 1)
    ]
    # two times per_label rows at most
    chosen = F.broadcast(stage(reduce(DataFrame.unionAll, chosen)))
    # of the documents two columns only, so that others may have any name
    texts = docs.select(F.col(key).alias("_doc_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(chosen, F.col("_doc_key") == F.col("_key"))
    return stage(found.select("label", "text"))


class Logistic:
    """Logistic regression with a ridge, by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        penalty = np.diag([1e-6] + [ridge] * x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + penalty @ w
            w -= np.linalg.solve(z.T * (p * (1 - p)) @ z + penalty, gradient)
        self.w = w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.w[0] + (x - self.mean) / self.scale @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
