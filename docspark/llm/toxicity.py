"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear support vector machine.

A text is read as letter classes, and every window of WINDOW characters is an
instance. Two windows are alike by the subsequences of ORDER characters they
share, each weighted by DECAY to the length it spans, so an insult with gaps or
inserted characters ("idxiot", "id iot") still shares most of them; signs inside
words and blanks between single letters ("i.d.i.o.t") are skipped beforehand. Windows
are mapped to their kernel values with landmark windows, whitened by the
landmarks' own kernel (Nyström), and separated by a squared-hinge SVM. A label
belongs to a whole document: a document is as toxic as its worst window, so
training alternates between choosing each toxic document's worst window and
adding the worst windows of clean ones (multiple-instance training).

The kernel's explicit features number 32 ** ORDER, so landmarks and SVM weights
collapse into one table of that length; scoring a text costs a fixed number of
table reads a character, whatever its length, and the same table gives the
same value as summing over the landmarks.

Training takes a bounded sample: of the labelled rows outside the held-out
fold, texts of at most ``max_chars`` characters in the order of md5(doc_id), at most
``toxic_rows`` and ``clean_rows`` of them. Query and pipeline train in a task. Scoring covers every whole text.

Defined cases: null and empty texts have no window and get the score of the
bias alone; without labelled texts of both classes the score is the share of
toxic labels (0 without labels); null labels are left out; repeated labels count
as often as they occur; further columns and clashing names are ignored.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table
from docspark.plans.staging import stage, unstage

ORDER, REACH, WINDOW, DECAY = 4, 6, 12, 0.7
PAD, OTHER, SIGN = 31, 30, 28
CHUNK = 1 << 15
#: Offsets of the second, third and fourth character of a subsequence.
STEPS = [(a, b, c) for c in range(3, REACH + 1) for b in range(2, c) for a in range(1, b)]
THRESHOLD = 0.3


def _letter_classes() -> np.ndarray:
    """Latin letters by their base letter; letters of other scripts by code point, dealt over the same classes; blanks, digits and signs as one class each."""
    out = np.full(0x10000, OTHER, np.int32)
    for i in range(0x10000):
        c = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        out[i] = ord(c) - 96 if "a" <= c <= "z" else 0 if c.isspace() else 27 if c.isdigit() else 1 + ord(c) % 26 if c.isalpha() else SIGN
    out[-1] = OTHER  # stands for every character beyond the first plane
    return out


CLASSES = _letter_classes()


def classes(text: str) -> np.ndarray:
    """Class of each character; signs go, and so do blanks between single letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = CLASSES[np.minimum(points, 0xFFFF)]
    codes = codes[codes != SIGN]
    if len(codes) > 4:
        blank = codes == 0
        spaced = blank[:-4] & ~blank[1:-3] & blank[2:-2] & ~blank[3:-1] & blank[4:]
        if spaced.any():
            codes = np.delete(codes, np.flatnonzero(spaced) + 2)
    return codes


def padded(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([codes, np.full(WINDOW + REACH, PAD, np.int32)])


def features(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights of the windows at ``starts``: both (windows, WINDOW * steps)."""
    codes = codes.astype(np.int32, copy=False)
    at = starts[:, None] + np.arange(WINDOW)[None, :]
    ids, weights = [], []
    for a, b, c in STEPS:
        parts = codes[at], codes[at + a], codes[at + b], codes[at + c]
        ids.append(parts[0] << 15 | parts[1] << 10 | parts[2] << 5 | parts[3])
        weights.append(np.where(np.maximum.reduce(parts) == PAD, 0, DECAY ** (c + 1)))
    return np.concatenate(ids, 1), np.concatenate(weights, 1).astype(np.float32)


def window_sums(codes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each start in padded ``codes``, the sum of ``values`` over its window's weighted features."""
    n = len(codes) - REACH
    one, two, three = codes << 15, codes << 10, codes << 5
    each = np.zeros(n, np.float32)
    for reach in range(3, REACH + 1):
        part = np.zeros(n, np.float32)
        for a, b, c in STEPS:
            if c == reach:
                part += values[one[:n] + two[a : n + a] + three[b : n + b] + codes[c : n + c]]
        each += np.float32(DECAY ** (reach + 1)) * part
    total = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
    return total[WINDOW:] - total[:-WINDOW]


def worst(texts: Iterable[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest window sum of each text and where it starts; -inf and 0 without a window. Texts are cut into overlapping chunks."""
    texts = list(texts)
    best, where = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    owners: list[tuple[int, int, int, int]] = []
    size = 0

    def flush() -> None:
        nonlocal parts, owners, size
        if not owners:
            return
        sums = window_sums(np.concatenate(parts), values)
        for doc, first, begin, n in owners:
            own = sums[begin : begin + n]
            k = int(own.argmax())
            if own[k] > best[doc]:
                best[doc], where[doc] = own[k], first + k
        parts, owners, size = [], [], 0

    for doc, text in enumerate(texts):
        if not text:
            continue
        codes = padded(classes(text))
        n = len(codes) - WINDOW - REACH
        for first in range(0, n, CHUNK):
            piece = codes[first : first + CHUNK + WINDOW + REACH]
            owners.append((doc, first, size, min(CHUNK, n - first)))
            parts.append(piece)
            size += len(piece)
            if size >= CHUNK:
                flush()
    flush()
    return best, where


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 2.0) -> np.ndarray:
    """Squared-hinge linear SVM in the primal by Newton steps; the last column of x is the bias. Penalty and sample sizes: by cross-validation over folds 0, 1 and 3."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-4
    for _ in range(25):
        active = y * (x @ w) < 1
        square, side = np.diag(ridge), np.zeros(x.shape[1])
        for rows in np.array_split(np.flatnonzero(active), 1 + active.sum() // 1024):  # no copy of all rows at once
            xa, ca = x[rows], cost[rows]
            square += (xa * ca[:, None]).T @ xa
            side += xa.T @ (ca * y[rows])
        new = np.linalg.solve(square, side)
        if np.allclose(new, w, rtol=1e-4, atol=1e-6):
            break
        w = new
    return w


class Model:
    """values: weight of each subsequence; bias: of the SVM; scale and shift: of the logistic calibration."""

    def __init__(self, values=None, bias=0.0, scale=0.0, shift=0.0):
        self.values, self.bias, self.scale, self.shift = values, bias, scale, shift

    def margins(self, texts: Iterable[str]) -> np.ndarray:
        best, _ = worst(texts, self.values)
        return np.where(np.isfinite(best), best, 0.0) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.shift if self.values is None else self.scale * self.margins(texts) + self.shift
        return np.broadcast_to(1 / (1 + np.exp(-np.clip(z, -30, 30))), (len(texts),))


def _runs(codes: np.ndarray) -> np.ndarray:
    """The number of the ORDER characters from each place on."""
    c = codes.astype(np.int32)
    return c[:-3] << 15 | c[1:-2] << 10 | c[2:-1] << 5 | c[3:]


def _enriched(codes: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Log ratio, for each contiguous run of ORDER characters, of the share of toxic and of clean texts that hold it."""
    held = np.zeros((2, 32**ORDER), np.float64)
    for c, y in zip(codes, toxic):
        held[int(y), np.unique(_runs(c))] += 1
    shares = [(held[k] + 0.5) / (max(1, (toxic == k).sum()) + 1) for k in (0, 1)]
    return (np.log(shares[1] / shares[0]) * np.minimum(1, held[1] / 3)).astype(np.float32)


def train(texts: list[str], toxic: np.ndarray, calibrate: np.ndarray, landmarks: int = 300, rounds: int = 3, seed: int = 7) -> Model:
    """Fit on the texts where ``calibrate`` is false, set the logistic scale on the others."""
    toxic = np.asarray(toxic).astype(bool)
    fit = ~np.asarray(calibrate, dtype=bool) & np.array([bool(t) for t in texts], dtype=bool)
    if not (toxic[fit].any() and (~toxic[fit]).any()):
        share = toxic.mean() if len(toxic) else 0.0
        return Model(shift=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rng = np.random.default_rng(seed)
    own = [t for t, f in zip(texts, fit) if f]
    y = toxic[fit]
    codes = [padded(classes(t)).astype(np.uint8) for t in own]  # a fourth of what the texts would hold as numbers
    ratio = _enriched(codes, y)
    where = [int(np.argmax(np.convolve(ratio[_runs(c)][: max(1, len(c) - WINDOW - REACH)], np.ones(4), "same"))) for c in codes]
    starts = [max(0, k - 3) if t else int(rng.integers(0, max(1, len(c) - WINDOW - REACH))) for k, t, c in zip(where, y, codes)]

    # Landmarks: windows around the most telling runs of toxic texts, each run once, and windows of clean texts.
    positive, negative = np.flatnonzero(y), np.flatnonzero(~y)
    told: dict[int, tuple[int, int]] = {}
    for i in positive:
        c = codes[i]
        runs = _runs(c)
        for k in np.argsort(-ratio[runs])[:6]:
            told.setdefault(int(runs[k]), (int(i), int(min(max(0, k - 3), max(0, len(c) - WINDOW - REACH - 1)))))
    chosen = [told[r] for r in sorted(told, key=lambda r: (-ratio[r], r))[: landmarks * 2 // 3]]
    chosen += [(int(i), starts[i]) for i in rng.permutation(negative)[: landmarks - len(chosen)]]

    def window_features(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.stack([np.resize(codes[i][s : s + WINDOW + REACH], WINDOW + REACH) if len(codes[i]) - s >= WINDOW + REACH else padded(codes[i][s:])[: WINDOW + REACH] for i, s in pairs])
        return features(at.ravel(), np.arange(len(pairs)) * (WINDOW + REACH))

    ids, weights = window_features(chosen)
    known, inverse = np.unique(ids, return_inverse=True)
    inverse = inverse.reshape(ids.shape)
    base = np.zeros((len(chosen), len(known) + 1), np.float32)
    for k in range(len(chosen)):
        np.add.at(base[k], inverse[k], weights[k])
    base /= np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-6)
    slot = np.full(32**ORDER, len(known), np.int32)
    slot[known] = np.arange(len(known))
    spectrum, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = spectrum > 1e-3
    whiten = vectors[:, keep] / np.sqrt(spectrum[keep])

    def mapped(pairs: list[tuple[int, int]]) -> np.ndarray:
        out = []
        for k in range(0, len(pairs), 100):
            i, w = window_features(pairs[k : k + 100])
            rows = np.zeros((len(i), base.shape[1]), np.float32)
            np.add.at(rows, (np.arange(len(i))[:, None], slot[i]), w)
            out.append(rows @ base.T @ whiten)
        return np.concatenate(out)

    seen_negative = [(int(i), starts[i]) for i in negative]
    witness = [(int(i), starts[i]) for i in positive]
    values, bias = None, 0.0
    for r in range(rounds):
        pairs = witness + seen_negative
        x = mapped(pairs)
        x = np.hstack([x, np.ones((len(x), 1))])
        target = np.r_[np.ones(len(witness)), -np.ones(len(seen_negative))]
        cost = np.where(target > 0, len(seen_negative) / max(1, len(witness)), 1.0) * 2.0
        w = _svm(x, target, cost)
        values = np.zeros(32**ORDER, np.float32)
        of_landmarks = whiten @ w[:-1]
        values[known] = np.concatenate([of_landmarks @ base[:, at : at + 2048] for at in range(0, base.shape[1], 2048)])[:-1]
        bias = float(w[-1])
        cube = values.reshape(32, 32, 32, 32)
        cube[PAD], cube[:, PAD], cube[:, :, PAD], cube[:, :, :, PAD] = 0, 0, 0, 0
        if r + 1 < rounds:
            _, at = worst(own, values)
            witness = [(int(i), int(at[i])) for i in positive]
            seen_negative = list(dict.fromkeys(seen_negative + [(int(i), int(at[i])) for i in negative]))

    model = Model(values, bias, 1.0, 0.0)
    use = ~fit if (toxic[~fit].any() and (~toxic[~fit]).any()) else fit
    z, t = model.margins([x for x, u in zip(texts, use) if u]), toxic[use].astype(float)
    a = np.array([1.0, 0.0])
    goal = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's smoothed targets
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a[0] * z + a[1], -30, 30)))
        design = np.stack([z, np.ones_like(z)], 1)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (p - goal) + 1e-3 * (a - [1.0, 0.0]))
        a -= np.clip(step, -2, 2)
    model.scale, model.shift = float(max(a[0], 1e-3)), float(a[1])
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def _sampled(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int, max_chars: int) -> tuple[DataFrame, list[DataFrame]]:
    """The staged candidates, and of these the sample of each class."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("__toxic")).where(fold(F.col("doc_id")) != 2)
    bounds = {1: toxic_rows, 0: clean_rows}
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # Twice as many ids as texts, as long texts drop out; that bounds the broadcast. The second limit bounds what repeated ids bring to the training.
    sample = reduce(DataFrame.unionByName, (usable.where(F.col("__toxic") == y).orderBy(order, "doc_id").limit(2 * n) for y, n in bounds.items()))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.length("text") <= max_chars)
    found = found.select("text", "__toxic", (fold(F.col("doc_id")) == 3).alias("__calibrate"), order.alias("__id"), F.md5(F.col("text")).alias("__order"))
    found = stage(found, "training")
    return found, [found.where(F.col("__toxic") == y).orderBy("__id", "__order").limit(n) for y, n in bounds.items()]


def _trained(rows: pd.DataFrame) -> Model:
    rows = rows.sort_values(["__order", "__toxic", "__id"])
    return train(rows["text"].tolist(), rows["__toxic"].to_numpy(), rows["__calibrate"].to_numpy(bool))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, clean_rows: int = 4500, max_chars: int = 12_000) -> Model:
    """Train, in the calling process, on a bounded sample of the labelled rows outside fold 2; fold 3 calibrates."""
    found, parts = _sampled(docs, labels, toxic_rows, clean_rows, max_chars)
    rows = pd.concat([part.toPandas() for part in parts])
    unstage(found)
    return _trained(rows)


def fit_in_task(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, clean_rows: int = 4500, max_chars: int = 12_000) -> Model:
    """The model of ``fit``, trained in a task: the driver gets the model (4 MB), not the texts and the matrices of the training."""
    found, parts = _sampled(docs, labels, toxic_rows, clean_rows, max_chars)

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if held := [b for b in batches if len(b)]:
            yield pd.DataFrame({"model": [pickle.dumps(_trained(pd.concat(held)))]})

    told = reduce(DataFrame.unionByName, parts).coalesce(1).mapInPandas(trained, "model binary").collect()
    unstage(found)
    return pickle.loads(told[0]["model"]) if told else train([], np.array([]), np.array([], bool))


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast(model)  # 32 ** ORDER floats: 4 MB, whatever the input

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array(shared.value.scores(texts.tolist())))

    return scored(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score; the model is fitted first, on labels outside the held-out fold."""
    return docs.withColumn("score", score(F.col("text"), fit_in_task(docs, labels), docs.sparkSession))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored THRESHOLD or more go."""
    return docs.where(score(F.col("text"), fit_in_task(docs, table(spark, sf_dir, "labels")), spark) < THRESHOLD)
