"""Document quality by regularised quadratic discriminant analysis over transformed document statistics.

A text becomes a short vector of statistics (STATISTICS): counts turned into shares and
variance-stabilised (arc sine of the square root), sizes into logarithms. Each class
is a Gaussian over these vectors. Its covariance is shrunk towards the pooled one
(``toward_pooled``) and towards a multiple of the identity (``toward_identity``); its
Cholesky factor is taken once, and the inverse factor is kept, so a document costs two
small matrix products. The score is the difference of the two log densities
(Mahalanobis distances and log determinants), calibrated by a logistic curve over its asinh.

Everything is learnt from all labelled rows, in Spark: the vectors of all documents are staged
once (a few per cent of the texts), labels are counted by document and joined to
them, every task sums first and second moments by fold and class, and the driver gets these sums
alone. The two shrinkages are chosen by cross-validation over the folds: one pass
scores every labelled row with the models of the other folds at all settings and
returns histograms, from which log loss and calibration follow. Fold 2 is never read.

Statistics of words are taken over blocks of BLOCK characters and summed, so memory is
bounded and a long text is judged like many short ones; every block counts.

Defined cases: null and empty texts have the vector of no characters, and a score like
any other; without labelled texts of both classes the score is the share of good labels
(0 without labels); null labels and labels without a document are left out; repeated labels and
repeated documents count as often as they occur; further columns and clashing names are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import salted, table
from docspark.plans.staging import stage, unstage

BLOCK = 1 << 16
HELD_OUT, FOLDS, THRESHOLD = 2, (0, 1, 3), 0.7
STATISTICS = ["log_words", "log_word_chars", "upper", "digits", "stops", "commas", "other_signs", "wordless", "repeats", "distinct", "windows", "log_line_words", "equal_lines", "open_ends", "shout", "odd_letters"]
WIDTH = len(STATISTICS)
#: Settings tried: shares of the pooled covariance and of the identity.
GRID = [(a, b) for a in (0.0, 0.1, 0.3, 0.6) for b in (0.003, 0.01, 0.03, 0.1)]
#: Cells of the histograms of asinh(log density difference): from -REACH to REACH.
REACH, CELLS = 16.0, 640
_BLANK, _UPPER, _LOWER, _DIGIT, _STOP, _COMMA, _SIGN = range(7)


def _classes() -> np.ndarray:
    """Class of each character of the first plane; what lies beyond counts as a sign."""
    out = np.full(0x10000, _SIGN, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        kind = unicodedata.category(c)
        out[i] = _BLANK if c.isspace() else _UPPER if kind == "Lu" else _LOWER if kind[0] in "LM" else _DIGIT if kind[0] == "N" else _STOP if c in ".?!…。؟" else _COMMA if c in ",;:'’\"-،" else _SIGN
    out[-1] = _SIGN
    return out


CLASSES = _classes()


def _counts(text: str) -> np.ndarray:
    """Counts over the blocks of a text, from which the statistics are taken."""
    out = np.zeros(17)
    for at in range(0, len(text), BLOCK):
        part = text[at : at + BLOCK]
        kinds = CLASSES[np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
        out[:7] += np.bincount(kinds, minlength=7)
        found = part.split()
        out[7] += len(found)
        out[8] += len(set(found))
        out[9] += sum(a == b for a, b in zip(found, found[1:]))
        windows = list(zip(found, found[1:], found[2:]))
        out[10] += len(windows)
        out[11] += len(windows) - len(set(windows))
        letters = (kinds == _UPPER) | (kinds == _LOWER)
        blank = kinds == _BLANK
        # Words without a letter or digit: runs between blanks that hold none.
        begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        if len(begins):
            out[12] += (np.add.reduceat(letters | (kinds == _DIGIT), begins, dtype=np.int64) == 0).sum()
        ends = np.flatnonzero(~blank & np.r_[blank[1:], True])
        out[13] += (kinds[ends] == _SIGN).sum()
        lines = [x for x in part.split("\n") if x.strip()]
        out[14] += len(lines)
        out[15] += len(lines) - len(set(lines))
        out[16] += ((kinds[1:] == _STOP) & (kinds[:-1] == _STOP)).sum()
    return out


def vectors(texts: list[str]) -> np.ndarray:
    """(texts, WIDTH) statistics."""
    c = np.array([_counts(t) for t in texts]).reshape(len(texts), 17)
    share = lambda part, whole: np.arcsin(np.sqrt(np.clip((part + 0.05) / (whole + 0.1), 0, 1)))
    letters, solid, words = c[:, _UPPER] + c[:, _LOWER], c[:, 1:7].sum(1), c[:, 7]
    columns = [
        np.log1p(words), np.log1p(solid / np.maximum(words, 1)), share(c[:, _UPPER], letters), share(c[:, _DIGIT], solid), share(c[:, _STOP], solid), share(c[:, _COMMA], solid), share(c[:, _SIGN], solid), share(c[:, 12], words),
        share(c[:, 9], words), share(c[:, 8], words), share(c[:, 11], c[:, 10]), np.log1p(words / np.maximum(c[:, 14], 1)), share(c[:, 15], c[:, 14]), share(c[:, 13], words), share(c[:, 16], solid), share(np.minimum(c[:, _UPPER], c[:, _LOWER]), letters),
    ]
    return np.stack(columns, 1)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(vectors(texts.tolist())))

    return docs.select("doc_id", vector(F.coalesce("text", F.lit(""))).alias("x"))


class Gaussians:
    """Two classes by mean and inverse Cholesky factor of the shrunk covariance; ``scale`` and ``shift`` calibrate."""

    def __init__(self, means: list[np.ndarray], factors: list[np.ndarray], halves: list[float], scale: float = 1.0, shift: float = 0.0):
        self.means, self.factors, self.halves, self.scale, self.shift = means, factors, halves, scale, shift

    def differences(self, x: np.ndarray) -> np.ndarray:
        """asinh of the log density of the good class less that of the bad one."""
        bad, good = (-0.5 * np.square((x - m) @ f.T).sum(1) - h for m, f, h in zip(self.means, self.factors, self.halves))
        return np.arcsinh(good - bad)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.shift if not self.means else self.scale * self.differences(x) + self.shift
        return np.broadcast_to(1 / (1 + np.exp(-np.clip(z, -30, 30))), (len(x),))


def gaussians(sums: np.ndarray, toward_pooled: float, toward_identity: float) -> Gaussians:
    """Classes (bad, good) from their summed moments: rows of 1 + WIDTH + WIDTH ** 2 numbers (count, sums, products)."""
    n = sums[:, 0]
    means = [s[1 : WIDTH + 1] / s[0] for s in sums]
    spread = [s[WIDTH + 1 :].reshape(WIDTH, WIDTH) / s[0] - np.outer(m, m) for s, m in zip(sums, means)]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / n.sum()
    level = max(np.trace(pooled) / WIDTH, 1e-9)
    factors, halves = [], []
    for s in spread:
        s = (1 - toward_pooled) * s + toward_pooled * pooled
        lower = np.linalg.cholesky((1 - toward_identity) * s + toward_identity * level * np.eye(WIDTH))
        factors.append(np.linalg.inv(lower))
        halves.append(float(np.log(np.diag(lower)).sum()))
    return Gaussians(means, factors, halves)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, bad, good, x) of the documents with labels outside the held-out fold; bad and good count labels."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("__q")).where((fold(F.col("doc_id")) != HELD_OUT) & F.col("__q").isin(0, 1) & F.col("doc_id").isNotNull())
    counted = usable.groupBy("doc_id").agg(F.sum(1 - F.col("__q")).alias("bad"), F.sum("__q").alias("good"))
    own = found.where(fold(F.col("doc_id")) != HELD_OUT).withColumn("__row", F.monotonically_increasing_id())
    return salted(own, counted, ["doc_id"], by=["__row"]).select(fold(F.col("doc_id")).cast("int").alias("fold"), "bad", "good", "x")


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_list()) if len(x) else np.zeros((0, WIDTH))


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Summed moments (bad, good) of each fold; every task sums before anything is exchanged."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {f: np.zeros((2, 1 + WIDTH + WIDTH**2)) for f in FOLDS}
        for batch in batches:
            x = _matrix(batch["x"])
            for f in FOLDS:
                for k, name in enumerate(("bad", "good")):
                    w = np.where(batch["fold"] == f, batch[name], 0).astype(float)
                    total[f][k] += np.r_[w.sum(), w @ x, ((x * w[:, None]).T @ x).ravel()]
        for f, t in total.items():
            if t[:, 0].any():
                yield pd.DataFrame({"fold": f, "cell": np.arange(t.size), "v": t.ravel()})

    out = {f: np.zeros((2, 1 + WIDTH + WIDTH**2)) for f in FOLDS}
    for r in rows.mapInPandas(summed, "fold long, cell long, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect():
        out[r["fold"]].ravel()[r["cell"]] = r["v"]
    return out


def histograms(rows: DataFrame, models: dict[tuple[int, int], Gaussians], settings: int) -> np.ndarray:
    """(settings, 2, CELLS) counts of labels by what the models of the other folds say; models by (setting, fold left out)."""
    size = settings * 2 * CELLS

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((settings, 2, CELLS))
        for batch in batches:
            x, folds = _matrix(batch["x"]), batch["fold"].to_numpy()
            for (k, f), model in models.items():
                own = folds == f
                cell = np.clip(((model.differences(x[own]) + REACH) * CELLS / (2 * REACH)).astype(int), 0, CELLS - 1)
                for j, name in enumerate(("bad", "good")):
                    total[k, j] += np.bincount(cell, batch[name].to_numpy(float)[own], CELLS)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "v": total.ravel()[cells]})

    out = np.zeros(size)
    for r in rows.mapInPandas(counted, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # at most ``size`` rows
        out[r["cell"]] = r["v"]
    return out.reshape(settings, 2, CELLS)


def calibrated(counts: np.ndarray) -> tuple[float, float, float]:
    """(scale, shift, mean log loss) of the logistic curve over a histogram (2, CELLS) of bad and good labels, by Newton steps with Platt's smoothed targets."""
    z = (np.arange(CELLS) + 0.5) * 2 * REACH / CELLS - REACH
    n, (bad, good) = counts.sum(0), counts.sum(1)
    goal = (counts[1] * (good + 1) / (good + 2) + counts[0] / (bad + 2)) / np.maximum(n, 1)
    design, a = np.stack([z, np.ones(CELLS)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (n * (p - goal)) + 1e-3 * (a - [1.0, 0.0]))
        a -= np.clip(step, -1, 1)
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ a, -30, 30))), 1e-12, 1 - 1e-12)
    return float(max(a[0], 1e-3)), float(a[1]), float(-(n * (goal * np.log(p) + (1 - goal) * np.log(1 - p))).sum() / max(n.sum(), 1))


def fit(found: DataFrame, labels: DataFrame, grid: list[tuple[float, float]] = GRID) -> Gaussians:
    """Model of the labelled rows outside the held-out fold; ``found``: (doc_id, x)."""
    rows = stage(labelled(found, labels), "labelled")
    by_fold = moments(rows)
    whole = reduce(np.add, by_fold.values())
    bad, good = whole[:, 0]
    if not (bad and good):
        unstage(rows)
        share = good / (bad + good) if bad + good else 0.0
        return Gaussians([], [], [], shift=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rest = {f: whole - own for f, own in by_fold.items() if (own[:, 0].any() and (whole - own)[:, 0].all())}
    models = {(k, f): gaussians(sums, *setting) for k, setting in enumerate(grid) for f, sums in rest.items()}
    if not models:  # one fold holds a whole class: its rows are judged by the model of all
        models = {(k, f): gaussians(whole, *setting) for k, setting in enumerate(grid) for f in FOLDS}
    curves = [calibrated(c) for c in histograms(rows, models, len(grid))]
    unstage(rows)
    best = min(range(len(grid)), key=lambda k: (round(curves[k][2], 6), -grid[k][1], -grid[k][0]))
    model = gaussians(whole, *grid[best])
    model.scale, model.shift = curves[best][:2]
    return model


def score(x: str | Column, model: Gaussians, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast(model)  # two matrices of WIDTH ** 2 numbers

    @F.pandas_udf("double")
    def scored(found: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(_matrix(found)))

    return scored(x)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every document."""
    found = stage(statistics(docs), "statistics")
    return found.select("doc_id", score("x", fit(found, labels), docs.sparkSession).alias("score"))


def op13_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
