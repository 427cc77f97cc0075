"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled web text train a small neural
network under the non-negative unbiased PU risk
``pi R+_p + max(0, R-_u - pi R-_p)``; the class prior ``pi`` is estimated from
the labelled training rows (share of good ones, Laplace-smoothed). Rows that
are labelled bad take no part in the risk; where there are any, they and the
positives map the network's output to probabilities (Platt's logistic
calibration). Inputs of a score come from the text alone.

The fit uses a bounded sample (``max_positive``, ``max_unlabelled`` and
``max_negative`` rows, the smallest by a hash of ``doc_id``); every row is scored. Null and empty texts
get the features of an empty text and are scored like any other. Without
positives the score is the prior of a coin, 0.5. Rows with a null ``doc_id``
are never training rows. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.arrow import append_columns

MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000
MAX_NEGATIVE = 4_000
HIDDEN = 24
EPOCHS = 40
SEED = 7
SMOOTH = 64             # bytes; short texts have noisy frequencies
N_FEATURES = 256 + 10
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_LETTERS[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of byte frequencies, then ten statistics
    of length, letters, repetition and lines. Whole texts are read."""
    out = np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    for i, text in enumerate(texts):
        n = len(text)
        if not n:
            continue
        counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        row = out[i]
        row[:256] = np.sqrt(counts / (n + SMOOTH))
        words = text.lower().split()
        n_words = max(1, len(words))
        letters = int(counts[_LETTERS].sum())
        lines = text.split(b"\n")
        same = sum(a == b for a, b in zip(words, words[1:]))
        row[256:] = (
            np.log1p(n) / 10, letters / n, int(counts[_UPPER].sum()) / max(1, letters),
            min(1.0, letters / n_words / 20), len(set(words)) / n_words, same / n_words,
            len(set(lines)) / len(lines), min(1.0, n / len(lines) / 500),
            min(1.0, (int(counts[33:48].sum()) + int(counts[124])) / n_words), 1.0,
        )
    return out


def _forward(x: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w["w1"] + w["b1"])
    return hidden, hidden @ w["w2"] + w["b2"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Adam on mini-batches of the non-negative PU risk with the logistic loss.
    Where the negative part of the risk falls below zero, its gradient is
    reversed, as the non-negative estimator asks for."""
    rng = np.random.default_rng(seed)
    mean, std = unl.mean(0), unl.std(0) + 1e-2
    pos, unl = (pos - mean) / std, (unl - mean) / std
    w = {"w1": rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)).astype(np.float32),
         "b1": np.zeros(HIDDEN, np.float32), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
         "b2": np.float32(0)}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    step, batch = 0, 256
    rounds = max(1, len(unl) // batch)
    for _ in range(max(epochs, 400 // rounds)):
        for _ in range(rounds):
            p = pos[rng.integers(0, len(pos), batch)]
            u = unl[rng.integers(0, len(unl), batch)]
            x = np.concatenate([p, u])
            hidden, z = _forward(x, w)
            s = _sigmoid(z)
            negative = -np.log1p(-np.clip(s, 0, 1 - 1e-7))       # loss of calling a row negative
            risk_neg = negative[batch:].mean() - prior * negative[:batch].mean()
            dz = np.empty_like(z)
            if risk_neg >= 0:
                dz[:batch] = (prior * (s[:batch] - 1) - prior * s[:batch]) / batch
                dz[batch:] = s[batch:] / batch
            else:
                dz[:batch] = prior * s[:batch] / batch
                dz[batch:] = -s[batch:] / batch
            back = np.outer(dz, w["w2"]) * (1 - hidden ** 2)
            grad = {"w2": hidden.T @ dz, "b2": dz.sum(), "w1": x.T @ back, "b1": back.sum(0)}
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = (w[k] - 3e-3 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return w | {"mean": mean, "std": std, "scale": 1.0, "shift": 0.0}


def logits(x: np.ndarray, model: dict) -> np.ndarray:
    return _forward((x - model["mean"]) / model["std"], model)[1].astype(np.float64)


def calibrate(model: dict, good: np.ndarray, bad: np.ndarray) -> dict:
    """Platt scaling with smoothed targets, by Newton steps."""
    z = np.concatenate([logits(good, model), logits(bad, model)])
    target = np.concatenate([np.full(len(good), (len(good) + 1) / (len(good) + 2)), np.full(len(bad), 1 / (len(bad) + 2))])
    design = np.stack([z, np.ones(len(z))], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(100):
        p = _sigmoid(design @ ab)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (p - target) + 1e-6 * ab)
        ab = ab - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    if ab[0] <= 0:      # labels that contradict the network: keep its own scores
        return model
    return model | {"scale": float(ab[0]), "shift": float(ab[1])}


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    return _sigmoid(model["scale"] * logits(x, model) + model["shift"])


def train(docs: DataFrame, labels: DataFrame, is_training: Column, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED, max_negative: int = MAX_NEGATIVE) -> dict | None:
    """Fit on the training rows (``is_training`` over ``doc_id``); None without positives."""
    by_hash = F.xxhash64("doc_id")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(is_training)
    share = marked.where("quality IS NOT NULL").agg(F.count("*"), F.sum(F.expr("cast(quality = 1 AS int)"))).first()
    if not share[1]:
        return None
    prior = (share[1] + 1) / (share[0] + 2)
    by_label = [(marked.where(f"quality = {q}").select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(n)
                 .select("doc_id", F.lit(good).alias("good"))) for q, n, good in ((1, max_positive, 1), (0, max_negative, -1))]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    free = (texts.select("doc_id").where(is_training & F.col("doc_id").isNotNull())
            .join(marked.select("doc_id"), "doc_id", "left_anti").distinct()
            .orderBy(by_hash, "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("good")))
    # At most max_positive + max_unlabelled + max_negative ids: bounded by the parameters.
    chosen = texts.join(F.broadcast(by_label[0].unionByName(by_label[1]).unionByName(free)), "doc_id")
    rows = append_columns(chosen, "text", lambda t: {"x": [r.tobytes() for r in features(t)]},
                          [T.StructField("x", T.BinaryType())]).select("doc_id", "good", "x").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), dtype=np.float32).reshape(-1, N_FEATURES)
    y = np.array([r["good"] for r in rows])
    pos, bad = x[y == 1], x[y == -1]
    if not len(pos):
        return None
    model = fit_nnpu(pos, x[y == 0] if (y == 0).any() else x, prior)
    return calibrate(model, pos, bad) if len(bad) else model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``score`` (probability of good quality)."""
    def run(texts: list[bytes]) -> dict:
        return {"score": [0.5] * len(texts) if model is None else predict(features(texts), model)}

    return append_columns(docs, "text", run, [T.StructField("score", T.DoubleType())])
