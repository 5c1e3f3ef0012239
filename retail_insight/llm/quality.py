"""A quality classifier by co-training a text view and a metadata view."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from retail_insight.llm.common import fresh
from retail_insight.sources.workspace import stage

ADDED = ("text_score", "meta_score", "score", "accepted")
SLOTS = 32  # hashed values of each metadata text column
_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_SYMBOL = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"])


def text_features(text: str | None) -> list[float]:
    """Shape of the whole text: shares of byte classes, repetition, lengths."""
    data = (text or "").encode()
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    size, count = max(len(data), 1), max(len(words), 1)
    inner = max(size - int(seen[_SPACE].sum()), 1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    half = len(words) // 2
    return [
        seen[_UPPER].sum() / inner,
        min(1.0, 5 * seen[_SYMBOL].sum() / inner),
        min(1.0, 5 * seen[_DIGIT].sum() / inner),
        len(set(words)) / count,
        repeats / count,
        min(inner / count, 40.0) / 10,
        float(np.log1p(len(words))) / 5,
        float(half > 0 and words[:half] == words[half : 2 * half]),
        seen[ord("|")] / count,
        seen[ord("!")] / count,
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _text_view(texts: pd.Series) -> pd.Series:
    return texts.map(text_features)


def _meta_view(docs: DataFrame, names: tuple[str, ...], length: str) -> Column:
    """Slots of the hashed metadata values, the length and its square last."""
    have = {c.lower() for c in docs.columns}
    slots = [
        F.pmod(F.xxhash64(F.lit(i), F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit(SLOTS)) + i * SLOTS
        for i, n in enumerate(names)
        if n.lower() in have
    ]
    size = F.log1p(F.greatest(F.coalesce(F.col(length).cast("double"), F.lit(0.0)), F.lit(0.0))) / 10 \
        if length.lower() in have else F.lit(0.0)
    return F.array(*[s.cast("double") for s in slots], size)


def _widen(meta: np.ndarray, names: int) -> np.ndarray:
    """One column a slot, then the length and its square."""
    wide = np.zeros((len(meta), names * SLOTS + 2))
    for i in range(meta.shape[1] - 1):
        wide[np.arange(len(meta)), meta[:, i].astype(int)] = 1
    wide[:, -2], wide[:, -1] = meta[:, -1], meta[:, -1] ** 2
    return wide


class Logit:
    """Logistic regression with a small ridge, fitted by Newton steps on bounded rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        x = np.column_stack([x, np.ones(len(x))])
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        self.w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + penalty * self.w
            curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, gradient)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.ones(len(x))]) @ self.w


def _linear(view: Column, weights: list[float]) -> Column:
    """The text view's margin as a Spark expression."""
    terms = [F.element_at(view, i + 1) * F.lit(float(w)) for i, w in enumerate(weights[:-1])]
    return reduce(lambda a, b: a + b, terms, F.lit(float(weights[-1])))


def _slotted(view: Column, weights: list[float], names: int) -> Column:
    """The metadata view's margin as a Spark expression."""
    table = F.array(*[F.lit(float(w)) for w in weights[: names * SLOTS]])
    size = F.element_at(view, -1)
    hits = [F.element_at(table, F.element_at(view, i + 1).cast("int") + 1) for i in range(names)]
    square, linear, base = float(weights[-2]), float(weights[-3]), float(weights[-1])
    return reduce(lambda a, b: a + b, hits, size * F.lit(linear) + size * size * F.lit(square) + F.lit(base))


def _sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(margin, F.lit(30.0)), F.lit(-30.0))))


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    metadata: tuple[str, ...] = ("source", "lang"),
    length: str = "n_chars",
    label: str = "quality",
    rounds: int = 3,
    max_labelled: int = 20_000,
    pseudo_rows: int = 1_000,
    confident: float = 0.98,
    pseudo_weight: float = 0.25,
    threshold: float = 0.5,
) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score``, their combined ``score`` and ``accepted``.

    Two classifiers see different things: the shape of the whole text, and the
    page's metadata. Both start from at most ``max_labelled`` labelled rows
    (the first by a hash of the id). In each round, either one scores all
    documents without a label, and up to ``pseudo_rows`` of each class of which
    it is ``confident`` go to the other as pseudo-labels of lower weight. Rows
    that either has chosen leave the pool, so each round adds new ones. A
    fifth of the labelled rows is held back to calibrate each view; the score
    adds both calibrated log-odds, less the prior they share. Every document
    is scored, over its whole text.

    Null texts and metadata count as empty; absent metadata columns are left
    out. A label that is null or given twice with different values is not used.
    Without labels of both classes every score is the share of good labels
    (1.0 without any) and every document is accepted. Columns named like an
    added one are replaced. No rows give no rows.
    """
    for name in ADDED:
        docs = docs.drop(*[c for c in docs.columns if c.lower() == name])
    names = tuple(n for n in metadata if n.lower() in {c.lower() for c in docs.columns})
    views = {"t": _text_view(F.col(text).cast("string")), "m": _meta_view(docs, names, length)}
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("y2"))
        .where("y = y2 AND y IN (0, 1)")
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
        .select("id", F.col("y").cast("double").alias("y"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0).alias("held"))
    )
    number = F.monotonically_increasing_id().alias("row")
    pool = stage(docs.select(F.col(doc_id).alias("id"), *[c.alias(n) for n, c in views.items()], number), "views")
    joined = stage(pool.join(F.broadcast(known), "id", "left"), "views")  # bounded by max_labelled
    rows = joined.where("y IS NOT NULL").dropDuplicates(["id"]).orderBy("id").toPandas()
    good = float(rows["y"].mean()) if len(rows) else 1.0
    fit, held = rows[~rows["held"].astype(bool)], rows[rows["held"].astype(bool)]
    if fit["y"].nunique() < 2 or held["y"].nunique() < 2:
        return docs.withColumns(
            {n: F.lit(good) for n in ADDED[:3]} | {"accepted": F.lit(True)}
        )

    def matrices(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = np.array(frame["t"].tolist()), np.array(frame["m"].tolist())
        return t, _widen(m, len(names)), frame["y"].to_numpy(float)

    t, m, y = matrices(fit)
    train = {"t": [(t, y, np.ones(len(y)))], "m": [(m, y, np.ones(len(y)))]}

    def fitted(view: str) -> Logit:
        return Logit(*[np.concatenate(part) for part in zip(*train[view], strict=True)])

    unlabelled = joined.where("y IS NULL")
    for _ in range(rounds):
        models = {v: fitted(v) for v in train}
        p = {
            "t": _sigmoid(_linear(F.col("t"), models["t"].w.tolist())),
            "m": _sigmoid(_slotted(F.col("m"), models["m"].w.tolist(), len(names))),
        }
        scored = unlabelled.select("id", "row", "t", "m", p["t"].alias("pt"), p["m"].alias("pm"))
        picked = []
        for view, other in (("t", "m"), ("m", "t")):
            sure = [
                scored.where(test)
                .orderBy(F.xxhash64("id"), "id", "row")
                .limit(pseudo_rows)
                .withColumn("y", F.lit(value))
                for value, test in ((1.0, f"p{view} >= {confident}"), (0.0, f"p{view} <= {1 - confident}"))
            ]
            picked.append(stage(sure[0].unionAll(sure[1]), "pseudo-labels"))
            chosen = picked[-1].toPandas()  # at most twice pseudo_rows
            if len(chosen):
                ct, cm, cy = matrices(chosen)
                train[other].append((ct if other == "t" else cm, cy, np.full(len(cy), pseudo_weight)))
        gone = picked[0].select("row").union(picked[1].select("row")).distinct()
        unlabelled = unlabelled.join(F.broadcast(gone), "row", "left_anti")  # four times pseudo_rows at most

    models = {v: fitted(v) for v in train}
    ht, hm, hy = matrices(held)
    ones = np.ones(len(hy))
    platt = {v: Logit(models[v].margin(x)[:, None], hy, ones, 0.1).w for v, x in (("t", ht), ("m", hm))}
    prior = float(np.log(hy.mean() / (1 - hy.mean())))
    view_t, view_m = fresh(docs, "view_t"), fresh(docs, "view_m")
    margins = {
        "t": _linear(F.col(view_t), models["t"].w.tolist()),
        "m": _slotted(F.col(view_m), models["m"].w.tolist(), len(names)),
    }
    odds = {v: margins[v] * F.lit(float(platt[v][0])) + F.lit(float(platt[v][1])) for v in margins}
    return (
        docs.withColumns({view_t: views["t"], view_m: views["m"]})
        .withColumns(
            {
                "text_score": F.round(_sigmoid(odds["t"]), 9),
                "meta_score": F.round(_sigmoid(odds["m"]), 9),
                "score": F.round(_sigmoid(odds["t"] + odds["m"] - F.lit(prior)), 9),
            }
        )
        .withColumn("accepted", F.col("score") >= threshold)
        .drop(view_t, view_m)
    )
