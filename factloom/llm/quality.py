"""Quality classifier by co-training.

Two views of a document have classifiers of their own: its text (shape of words, lines and signs, hashed words and pairs of
words) and its metadata (language, source, stated length). Both begin with labelled rows. Each round both score every
document that has no label and hasn't been taught; those of which a view is surest become pseudo-labels in the other view's
training set and leave the pool. A view teaches only if it tells held-out labelled rows apart better than chance does. Last,
both are calibrated on these rows, which no fit has seen, and a small regression on the calibrated scores combines them for
every document.

Fits are logistic regressions by Newton's method on bounded samples: ``max_labelled`` rows and ``per_round`` pseudo-labels
for each view, class and round. Features, pseudo-label candidates and scores cover every document; features are computed once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import hashed_share, materialize, whole_text, written_tables

SOURCES, LANGS = 16, 8
SHAPE, GRAMS = 19, 64
VIEWS = "text array<float>, meta array<float>"
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
_SIGN = ~(_LETTER | _SPACE | _DIGIT | _POINT)


def text_shape(text: str) -> list[float]:
    """SHAPE numbers on the shape of a text. An empty text has zeros."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, size, letters = len(words), max(1, int(raw.sum())), max(1, int(raw[_LETTER].sum()))
    if not n:
        return [0.0] * SHAPE
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    signed = sum(not w[-1].isalnum() for w in words)
    heaps = distinct / n**0.9
    bare = sum(w.isalnum() for w in words) / n
    few = lambda share: float(np.log1p(100 * share))  # noqa: E731  small shares count as well
    return [
        float(np.log1p(n)), len(text) / n, distinct / n, heaps, repeats / n, signed / n,
        float(raw[_UPPER].sum()) / letters, float(raw[_DIGIT].sum()) / size, float(raw[_POINT].sum()) / size, float(raw[_SIGN].sum()) / size,
        float(raw[33]) / size, float(raw.max()) / size, len(lines) / n, 1 - len(set(lines)) / len(lines), sum(w.isupper() for w in words) / n,
        few(raw[_SIGN].sum() / size), few(repeats / n), few(raw[33] / size), bare,
    ]


def hashed_grams(text: str) -> np.ndarray:
    """Of GRAMS buckets of a text's words and of its pairs of neighbouring words the roots of their shares."""
    words = np.fromiter((zlib.crc32(w.encode()) for w in text.lower().split()), np.uint64)
    pairs = (words[:-1] * np.uint64(0x9E3779B1) ^ words[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(20)
    found = np.concatenate([words, pairs])
    return np.sqrt(np.bincount((found % np.uint64(GRAMS)).astype(np.int64), minlength=GRAMS) / max(1, len(found)))


def text_view(text: str) -> list[float]:
    return [*text_shape(text), *hashed_grams(text).tolist()]


def meta_view(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """Language and source as hashed indicators, and the stated length; nulls have classes of their own."""
    langs, sources = [0.0] * LANGS, [0.0] * SOURCES
    langs[zlib.crc32(repr(lang).encode()) % LANGS] = 1.0
    sources[zlib.crc32(repr(source).encode()) % SOURCES] = 1.0
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    return [float(np.log1p(n_chars)) if known else 0.0, float(known), *langs, *sources]


def views(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"text": [text_view(t) for t in text], "meta": [meta_view(*r) for r in zip(lang, source, n_chars)]}, dtype=object)


def features(docs: DataFrame) -> Column:
    """A struct of both views; metadata columns that are missing count as null."""
    meta = [F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "double"))]
    return F.pandas_udf(views, VIEWS)(whole_text(), *meta)


class Logistic:
    """Ridge logistic regression on standardized columns; one class alone gives its prior."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._wide(x)
        self.w = np.zeros(z.shape[1])
        prior = (y.sum() + 0.5) / (len(y) + 1)
        self.w[-1] = np.log(prior / (1 - prior))
        if 0 < y.sum() < len(y):
            keep = np.full(z.shape[1], ridge)
            keep[-1] = 1e-6
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                grad = z.T @ (p - y) + keep * self.w
                move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), grad)
                self.w -= move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
                if np.abs(move).max() < 1e-6:
                    break

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((np.asarray(x, float) - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._wide(x) @ self.w, -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def auc(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Area under the curve, ties counted half, and its standard error if there were no relation; 0.5 if a class is missing."""
    good, bad = float((y == 1).sum()), float((y == 0).sum())
    if not good or not bad:
        return 0.5, 1.0
    ranks = pd.Series(score).rank().to_numpy()
    return float((ranks[y == 1].sum() - good * (good + 1) / 2) / (good * bad)), ((good + bad + 1) / (12 * good * bad)) ** 0.5


class CoTrained:
    """Both views' classifiers, their calibrations and the combination. ``auc``: of each view, on the held-out rows;
    ``taught``: for each round how many pseudo-labels each view gave."""

    def __init__(self, seen: dict[str, tuple[np.ndarray, np.ndarray]], held: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.taught: list[dict[str, int]] = []
        self.auc: dict[str, float] = {}
        self.teaches: dict[str, bool] = {}
        self.view = {v: Logistic(x, y, ridge=0.3) for v, (x, y) in seen.items()}
        self.calibration = {v: Logistic(self.view[v].logit(x)[:, None], y, ridge=0.1) for v, (x, y) in held.items()}
        for v, (x, y) in held.items():
            self.auc[v], error = auc(self.view[v].logit(x), y)
            self.teaches[v] = self.auc[v] > 0.5 + 2 * error
        both = np.stack([self.calibrated(v, held[v][0]) for v in ("text", "meta")], axis=1)
        self.join = Logistic(both, held["text"][1], ridge=0.1)

    def calibrated(self, view: str, x: np.ndarray) -> np.ndarray:
        """Calibrated logits of one view."""
        return self.calibration[view].logit(self.view[view].logit(x)[:, None])

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.calibrated("text", text), self.calibrated("meta", meta)
        return 1 / (1 + np.exp(-a)), 1 / (1 + np.exp(-b)), self.join.probability(np.stack([a, b], axis=1))


def _surest(model: CoTrained, n: int, confident: float, gone: np.ndarray):
    """Of a partition: for each view that teaches and each class the documents of which the view is surest. ``gone``: those that
    have been taught, by ``pick``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[str, int], pd.DataFrame] = {}
        for b in batches:
            b = b[~b["pick"].isin(gone)]
            if not len(b):
                continue
            scores = dict(zip(("text", "meta"), model.scores(np.stack(b["text"]), np.stack(b["meta"]))))
            for view, p in scores.items():
                for label in (0, 1) if model.teaches[view] else ():
                    sure = p if label else 1 - p
                    part = b.assign(view=view, label=label, sure=sure)[sure >= confident]
                    if len(part):
                        old = best.get((view, label))
                        best[view, label] = (part if old is None else pd.concat([old, part])).sort_values(["sure", "pick"], ascending=[False, True]).head(n)
        yield from (x[["view", "label", "sure", "pick", "text", "meta"]] for x in best.values())

    return run


def co_train(seen: DataFrame, labels: DataFrame, rounds: int = 3, per_round: int = 200, confident: float = 0.95, max_labelled: int = 12_000) -> CoTrained:
    """The classifiers, from ``seen`` (doc_id, pick, text, meta: both views) and ``labels`` (doc_id, quality).

    Labels that are null or of documents that are missing don't count. Which labelled rows are used, if there are more than
    ``max_labelled``, and which quarter is held out, follows ``pick``, a hash of the id.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    sample = hashed_share(known, "doc_id", int(1.25 * max_labelled))
    # One shuffle of the features: who has a label, and whose label is in the sample.
    marks = known.select("doc_id", F.lit(True).alias("known")).join(sample, "doc_id", "left")
    marked = materialize(seen.select("doc_id", "pick", "text", "meta").join(marks, "doc_id", "left"), 500)
    rows = marked.where("label IS NOT NULL").orderBy("pick", "doc_id").limit(max_labelled).select("label", "pick", "text", "meta").toPandas()
    if not len(rows):
        width = (SHAPE + GRAMS, len(meta_view(None, None, None)))
        rows = pd.DataFrame({"label": [1], "pick": [0], "text": [np.zeros(width[0])], "meta": [np.zeros(width[1])]})
    out = rows["pick"].to_numpy() % 4 == 0
    held, used = (rows[out], rows[~out]) if out.any() and not out.all() else (rows, rows)
    pairs = lambda r: {v: (np.stack(r[v]), r["label"].to_numpy()) for v in ("text", "meta")}
    training, held = pairs(used), pairs(held)
    pool = marked.where("known IS NULL").select("pick", "text", "meta")
    model, gone, taught = CoTrained(training, held), np.empty(0, np.int64), []
    for _ in range(rounds):
        if not any(model.teaches.values()):
            break
        best = Window.partitionBy("view", "label").orderBy(F.desc("sure"), "pick")
        kinds = "view string, label int, sure double, pick long, text array<float>, meta array<float>"
        with written_tables(seen.sparkSession):
            new = pool.mapInPandas(_surest(model, per_round, confident, gone), kinds).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= per_round).toPandas()
        if not len(new):
            break
        for view, other in (("text", "meta"), ("meta", "text")):
            mine = new[new["view"] == view]  # this view's surest documents teach the other
            if len(mine):
                training[other] = (np.concatenate([training[other][0], np.stack(mine[other])]), np.concatenate([training[other][1], mine["label"].to_numpy()]))
        gone = np.union1d(gone, new["pick"].to_numpy())
        taught.append({v: int((new["view"] == v).sum()) for v in ("text", "meta")})
        model = CoTrained(training, held)
    model.taught = taught
    return model


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **settings) -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) with quality_text, quality_meta, quality_score (probabilities) and
    is_quality (score of a half or more).

    Null or empty text and null metadata are scored like any other values; repeated rows get equal scores; an empty table
    gives an empty result; columns of these names are replaced; without labels every document passes.
    """
    own = ("quality_text", "quality_meta", "quality_score", "is_quality")
    names = [c for c in (docs.columns if keep is None else keep) if c not in own]
    with_views = docs.select(F.col("doc_id").alias("_id"), F.struct(*names).alias("_row"), features(docs).alias("_f"))
    seen = materialize(with_views.select("_id", "_row", F.xxhash64("_id").alias("_pick"), "_f.text", "_f.meta"), 500)
    model = co_train(seen.select(F.col("_id").alias("doc_id"), F.col("_pick").alias("pick"), "text", "meta"), labels, **settings)

    def score(text: pd.Series, meta: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({n: [] for n in own[:3]}, dtype=float)
        return pd.DataFrame(dict(zip(own, model.scores(np.stack(text), np.stack(meta)))))

    scored = F.pandas_udf(score, "quality_text double, quality_meta double, quality_score double")("text", "meta")
    return seen.select("_row", scored.alias("_q")).select("_row.*", "_q.*").withColumn("is_quality", F.col("quality_score") >= 0.5)
