"""Quality classifier by positive-unlabelled learning.

A small network scores shape features of a text. It is trained on trusted positives and unlabelled web text only: the risk of
the negative class is that of the unlabelled texts less that of the positives times the class prior, and is kept from going below
zero (non-negative unbiased risk). The prior is estimated: a first scorer tells positives from unlabelled texts,
and over its thresholds the least upper bound of the unlabelled to the positive share above the threshold bounds
the share of positives among the unlabelled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample
from .tokens import shingles, token_hashes
from .toxicity import fit_logistic

N_FEATURES = 16
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_MARKS = [ord(c) for c in "#*$%&<>"]


def features(texts: list[str | None]) -> np.ndarray:
    """One row of shape features per text; counts come from the whole text."""
    out = np.zeros((len(texts), N_FEATURES))
    for i, h in token_hashes(texts):
        raw = (texts[i] or "").encode("utf-8", "surrogatepass")
        n = len(h)
        if not n:
            out[i, 0] = 1.0
            continue
        c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        letters = c[_UPPER].sum() + c[_LOWER].sum() + c[0xC0:].sum()
        tri = np.sort(shingles(h, 3))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        f = out[i]
        f[1] = math.log(n) / 5
        f[2] = min(3.0, c[_MARKS].sum() / n)
        f[3] = min(3.0, c[ord("|")] / n) * 2
        f[4] = min(3.0, c[ord("!")] / n)
        f[5] = c[_UPPER].sum() / max(1, letters)
        f[6] = len(np.unique(h)) / n
        f[7] = np.count_nonzero(tri[1:] == tri[:-1]) / max(1, len(tri))
        f[8] = np.count_nonzero(h[1:] == h[:-1]) / n
        f[9] = 1 - len(set(lines)) / max(1, len(lines))
        f[10] = min(3.0, (len(raw) / n - 5) / 5)
        f[11] = min(2.0, (c[ord(".")] + c[ord("?")]) / n * 5)
        f[12] = min(2.0, c[ord(",")] / n * 5)
        f[13] = min(2.0, c[48:58].sum() / max(1, letters) * 10)
        f[14] = min(2.0, (len(raw) - letters - c[32] - c[10]) / max(1, len(raw)) * 3)
        f[15] = min(2.0, len(lines) / n * 10)
    return out


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled scores: the least ratio of the two shares above a threshold, with a margin."""
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    slack = math.sqrt(math.log(4 / delta) / 2 / len(u)) + math.sqrt(math.log(4 / delta) / 2 / len(p))
    best, prior = math.inf, 1.0
    for t in np.quantile(p, np.linspace(0.01, 0.95, 95)):
        qp, qu = np.mean(p >= t), np.mean(u >= t)
        bound = (qu + slack) / qp
        if bound < best:
            best, prior = bound, qu / qp
    return float(min(max(prior, 0.01), 0.99))


class Network:
    """One hidden layer, trained with Adam on the non-negative risk; numpy only and seeded."""

    def __init__(self, width: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 1 / math.sqrt(width), (width, hidden)), np.zeros(hidden), r.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]

    def forward(self, x):
        h = np.tanh(x @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3]

    def gradient(self, x, h, dz):
        dh = np.outer(dz, self.w[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.02, decay: float = 1e-4) -> list[float]:
        m, v, risks = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], []
        for step in range(1, steps + 1):
            hp, zp = self.forward(positive)
            hu, zu = self.forward(unlabelled)
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            plus = prior * np.logaddexp(0, -zp).mean()
            minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            risks.append(float(plus + max(0.0, minus)))
            du, dn = su / len(zu), -prior * sp / len(zp)
            if minus >= 0:
                gp, gu = prior * (sp - 1) / len(zp) + dn, du
            else:  # step back until the negative risk is no longer below zero
                gp, gu = -dn, -du
            grads = [a + b + decay * w for a, b, w in zip(self.gradient(positive, hp, gp), self.gradient(unlabelled, hu, gu), self.w, strict=True)]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return risks

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[1], -30, 30)))


def _features_of(frames):
    for pdf in frames:
        yield pd.DataFrame({"f": list(features(pdf["text"].tolist()))})


def learn(docs: DataFrame, positives: DataFrame, most: int = 6_000) -> tuple[Network | None, float]:
    """Network and prior from at most ``most`` positives (a table of ids) and as many unlabelled rows of ``docs``.

    The unlabelled rows are drawn by the hash of their ids, without regard to labels.
    """
    rows = lambda df: np.array([r["f"] for r in df.select("text").mapInPandas(_features_of, "f array<double>").collect()]).reshape(-1, N_FEATURES)
    draw = lambda ids: docs.join(F.broadcast(bounded_sample(ids.where("doc_id is not null").select("doc_id").distinct(), "doc_id", most)), "doc_id")
    p, u = rows(draw(positives)), rows(draw(docs))
    if len(p) < 20 or len(u) < 20:
        return None, 1.0
    p, u = p[np.lexsort(p.T)], u[np.lexsort(u.T)]  # the order of the tasks must not matter
    first = fit_logistic(np.vstack([p[::2], u[::2]]), np.append(np.ones(len(p[::2])), np.zeros(len(u[::2]))))
    prior = estimate_prior(p[1::2] @ first[:-1], u[1::2] @ first[:-1])
    net = Network(N_FEATURES)
    net.fit(p, u, prior)
    return net, prior


def _scored(shared):
    def run(frames):
        net = shared.value
        for pdf in frames:
            x = features(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": net.score(x) if net is not None else np.full(len(pdf), 0.5)})

    return run


def quality(docs: DataFrame, positives: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``; ``positives`` has the ids of trusted good documents.

    Only the text enters a score. Null and empty texts are scored as texts without words. With fewer than 20 positives every
    score is 1/2. Repeated rows get equal scores. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    net, _ = learn(docs, positives)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    out = docs.mapInPandas(_scored(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
