"""Mixing to target weights with soft membership of domains.

A softmax classifier, fit on a bounded sample of labelled rows, gives every document its posterior over the domains; it looks
at the shape of a text and at the words that tell the labelled rows' domains apart. The
documents' rates then solve a non-negative least squares problem: with t tokens and posterior p of a document, the
expected tokens of domain d are the sum of rate * t * p[d], and shall be the target weight of d times all tokens. Projected
gradient starts from rate one everywhere; each step is one distributed sum of a vector of the domains' size, and what the
driver keeps is the list of steps, from which every document's rate follows by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hashed_share, materialize, whole_text, written_tables
from factloom.llm.quality import text_shape

#: Hash values of words, and how many words at most a classifier looks at.
HASHES, WORDS = 1 << 20, 1024


def hashed_words(text: str) -> list[int]:
    """The hashes of a text's distinct words, in order."""
    return sorted({zlib.crc32(w.encode()) % HASHES for w in set(text.lower().split())})


def telling_words(words: list[np.ndarray], y: np.ndarray, classes: int, least: int = 4) -> np.ndarray:
    """Those WORDS words that are in most more texts of some class than its share of all texts lets expect, in standard
    deviations; of at least ``least`` texts."""
    if not sum(map(len, words)):
        return np.empty(0, np.int64)
    ids, at = np.unique(np.concatenate(words), return_inverse=True)
    label = np.repeat(y, [len(w) for w in words])
    texts, most = np.bincount(at, minlength=len(ids)), np.full(len(ids), -np.inf)
    for c in range(classes):
        share = (y == c).mean()
        expected = texts * share
        most = np.maximum(most, (np.bincount(at, label == c, len(ids)) - expected) / np.sqrt(expected * (1 - share) + 1))
    most[texts < least] = -np.inf
    best = np.argsort(-most, kind="stable")[:WORDS]
    return np.sort(ids[best[most[best] > 0]])


class Softmax:
    """Multinomial logistic regression on the shape of a text and the telling words that it holds; full-batch Adam."""

    def __init__(self, shape: np.ndarray, words: list[np.ndarray], y: np.ndarray, classes: int, steps: int = 150, ridge: float = 1e-3):
        self.mean, self.scale = shape.mean(axis=0), shape.std(axis=0) + 1e-6
        self.words = telling_words(words, y, classes)
        x = self._wide(shape, words)
        goal = np.eye(classes, dtype=np.float32)[y]
        self.w = np.zeros((x.shape[1], classes), np.float32)
        m = v = np.zeros_like(self.w)
        for i in range(1, steps + 1):
            g = x.T @ (self._softmax(x @ self.w) - goal) / len(y) + ridge * self.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w = self.w - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _wide(self, shape: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        k = shape.shape[1]
        x = np.zeros((len(shape), k + 1 + len(self.words)), np.float32)
        x[:, :k] = np.clip((shape - self.mean) / self.scale, -8, 8)
        x[:, k] = 1
        if len(self.words) and sum(map(len, words)):
            found = np.concatenate([np.asarray(w, np.int64) for w in words])
            at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
            there = self.words[at] == found
            x[np.repeat(np.arange(len(words)), [len(w) for w in words])[there], k + 1 + at[there]] = 1
        return x

    def posteriors(self, shape: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        return self._softmax(self._wide(shape, words) @ self.w).astype(np.float64)


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = 10_000) -> DataFrame:
    """``docs`` with ``tokens`` (words) and ``posterior`` (array, in the order of ``domains``).

    ``labelled``: doc_id, domain. Rows of unknown or null domains don't count; which ``max_labelled`` rows are used follows a
    hash of the id. Without any, posteriors are even.
    """
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = docs.select("doc_id", whole_text().alias("text")).join(hashed_share(known, "doc_id", int(1.25 * max_labelled)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "doc_id")

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            yield pd.DataFrame({"domain": b["domain"], "shape": [text_shape(t) for t in b["text"]], "words": [hashed_words(t) for t in b["text"]]})

    with written_tables(docs.sparkSession):
        rows = sample.mapInPandas(shaped, "domain string, shape array<float>, words array<int>").toPandas()
    model = Softmax(np.stack(rows["shape"]), list(rows["words"]), np.array([domains.index(d) for d in rows["domain"]]), len(domains)) if len(rows) else None

    def score(text: pd.Series) -> pd.DataFrame:
        tokens = [len(t.split()) for t in text]
        if model is None or not len(text):
            p = np.full((len(text), len(domains)), 1 / len(domains))
        else:
            p = np.concatenate([model.posteriors(np.array([text_shape(t) for t in part]), [hashed_words(t) for t in part]) for part in (text[i : i + 500] for i in range(0, len(text), 500))])
        return pd.DataFrame({"tokens": np.array(tokens, dtype=np.int64), "posterior": pd.Series(list(p), dtype=object)})

    names = [c for c in docs.columns if c not in ("tokens", "posterior", "_m")]
    scored = docs.select(*names, F.pandas_udf(score, "tokens long, posterior array<double>")(whole_text()).alias("_m"))
    return scored.select(*names, "_m.tokens", "_m.posterior")


def _clipped(steps: list[np.ndarray], domains: int) -> Column:
    """The rate after the steps, as an expression over ``posterior``: each adds posterior . step and is projected to zero or more."""
    rate = F.lit(1.0)
    for s in steps:
        move = sum((F.get("posterior", F.lit(i)) * F.lit(float(s[i])) for i in range(domains)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate + move)
    return rate


def solve_rates(scored: DataFrame, weights: list[float], rounds: int = 40, near: float = 1e-5) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of projected gradient, and the shares that they reach; ``scored``: tokens, posterior.

    Steps are scaled by the inverse of the Gram matrix of the domains, so the objective is least squares in its metric and a
    step of one never overshoots. They end when all shares are within ``near`` of the targets, when a step no longer brings
    them nearer (targets that no rates can meet: the least squares solution), or after ``rounds``.
    """
    k = len(weights)
    goal = np.array(weights, float) / sum(weights)
    steps: list[np.ndarray] = []
    shares, off = np.zeros(k), np.inf
    p = [F.get("posterior", F.lit(i)) for i in range(k)]
    inverse = None
    for _ in range(rounds + 1):
        sums = [F.sum(F.col("rate") * F.col("tokens") * x).alias(f"v{i}") for i, x in enumerate(p)]
        if inverse is None:
            sums += [F.sum(F.col("tokens") * x * y).alias(f"g{i}_{j}") for i, x in enumerate(p) for j, y in enumerate(p)] + [F.sum("tokens").alias("tokens")]
        row = scored.withColumn("rate", _clipped(steps, k)).agg(*sums).first()  # one row of the domains' size
        if inverse is None:
            tokens = float(row.tokens or 0)
            if not tokens:
                break
            gram = np.array([[row[f"g{i}_{j}"] for j in range(k)] for i in range(k)])
            inverse = np.linalg.inv(gram + 1e-6 * tokens * np.eye(k))
        total = np.array([row[f"v{i}"] for i in range(k)])
        lacking = goal * tokens - total
        now = float(lacking @ inverse @ lacking)
        if now > 0.9999 * off:  # the last step led nowhere
            steps.pop()
            break
        shares, off = total / tokens, now
        if np.abs(lacking).max() <= near * tokens or len(steps) == rounds:
            break
        steps.append(inverse @ lacking)
    return steps, shares


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """The columns ``keep`` of ``docs`` (None: all) with tokens, posterior (by sorted domain name) and rate; and the share of
    all tokens that each domain is expected to have at these rates.

    A document's rate is how often it should be read so that the expected tokens of each domain, of all tokens, have the
    target weights; zero leaves it out. The targets are fitted as they are given: where no rates meet them, the shares that
    are returned tell by how much. Null or empty text has no tokens and takes no part in the sums, but gets a rate. Equal
    texts get equal rates; an empty table gives an empty result; columns of these names are replaced.
    """
    domains = sorted(targets)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("tokens", "posterior", "rate")]
    scored = posteriors(docs, labelled, domains)
    scored = materialize(scored.select(*names, "tokens", "posterior"))
    steps, shares = solve_rates(scored, [targets[d] for d in domains])
    return scored.withColumn("rate", _clipped(steps, len(domains))), dict(zip(domains, shares.tolist()))


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the ``labels`` table: toxic, low (quality 0) or clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))
