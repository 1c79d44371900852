"""Near-duplicate documents by BagMinHash over five-word shingles, banding and exact multiset overlap.

A text is the multiset of its runs of SHINGLE words (lower case, signs dropped);
two texts are near when the multisets' Jaccard similarity is NEAR or more.

Signatures. For each shingle, the weight axis is cut into [0,1), [1,2), [2,4),
[4,8), ..., and each part carries a Poisson process in time, at rate width a
signature component. A part's first point is drawn for the whole part; then the
part splits, the point goes to one half by a coin and the other half draws its
own, down to unit weights, which go on drawing. Points below the document's
weight of the shingle count; the earliest one of each component is the
signature. Everything is drawn from hashes of shingle and part, so two texts
agree in a component with probability equal to their weighted Jaccard
similarity. A part whose first point lies beyond the time when all components
are filled is never opened, so work is about one draw a shingle.

Candidates. Equal texts are one node. BANDS hashes of ROWS components make a
node's buckets. Members of a bucket are compared by their sketches, four bits for
each of the SIZE components, in blocks of bounded size; what the sketches leave is
verified on the texts. A link that is found early spares the pairs that it connects:

* first a block proposes a spanning forest of its likeliest pairs, and in a bucket of
  several blocks each member is also paired with the bucket's first node. Proposals
  are at most members; verified, they make groups of copies one component;
* then, in buckets that hold several components with likely pairs between them, the
  members of such pairs meet with their texts, again in blocks, and every such pair
  is verified in the first bucket that both share unless links of the block already
  connect it. Only links leave the block, fewer than its members.

So no pair is given up, but pairs inside a component are never expanded. A pair at
similarity 0.8 is lost with probability 3e-5 by the bands and 5e-5 by the sketch,
less above; ``sketch_near=0`` of ``classes`` verifies every pair of a bucket.

Spark groups, joins and shuffles nodes, buckets and links; Python only draws
signatures and compares two texts. Hot keys are aggregated before the shuffle
and met again dealt over salts.

Defined cases: null and empty texts are equal texts and so copies of each other;
texts without a word are near only to equal ones; a text of fewer than SHINGLE
words is one shingle; the class of a document is the smallest doc_id among its
near-duplicates, null only if all are null; repeated rows are copies, and rows that
share a doc_id but not the text are told apart; further columns are carried by the
stage and ignored by the query.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import salted, table, text_or_empty
from docspark.plans.staging import stage, unstage

SHINGLE, NEAR = 5, 0.8
BANDS, ROWS = 20, 4
SIZE = 240
#: Bits of a component that the sketch keeps, and the share of components that agree in a likely pair: 3.9 standard deviations below the
#: 0.8125 that is expected at NEAR.
BITS, SKETCH_NEAR = 4, 0.7125
#: Members of a block, characters of text in it, and rows of small buckets that share a task's group.
MEMBERS, CHARS, PACK = 4096, 1 << 24, 2048
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
#: Points of a unit part that are drawn at once where many are expected, and parts that do so at a time.
AHEAD, SLICE = 32, 1 << 14

_U = np.uint64
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=_U)
_PLACE = np.random.default_rng(12).integers(0, 2**63, SHINGLE, dtype=_U) * _U(2) + _U(1)
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    up, down = np.full(n, _ODD, _U), np.full(n, pow(_ODD, -1, 2**64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in UTF-8 bytes: a difference of one running polynomial, shifted back to the word's start."""
    inside = _WORD[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(12, int(len(data)).bit_length())
    up, down = _powers(size)
    run = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * up[: len(data)])])
    return _mix((run[ends] - run[starts]) * down[starts]), starts


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, shingle hash, times it occurs) over all texts, in no order."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    words, starts = word_hashes(data)
    owner = np.searchsorted(begins, starts, "right") - 1
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    total = np.zeros(max(0, len(words) - SHINGLE + 1), _U)
    for j in range(SHINGLE):
        total += words[j : len(words) - SHINGLE + 1 + j] * _PLACE[j] if len(total) else _U(0)
    full = owner[: len(total)] == owner[SHINGLE - 1 :] if len(total) else np.zeros(0, bool)
    ids, hashes = owner[: len(total)][full], _mix(total[full])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = [np.sum(words[first[i] : first[i] + n[i]] * _PLACE[: n[i]], dtype=_U) + _U(n[i]) for i in short]
        ids, hashes = np.concatenate([ids, short]), np.concatenate([hashes, _mix(np.array(own, _U))])
    keyed = _mix(hashes ^ _mix(ids.astype(_U) + _U(1)))  # differs between texts, equal within
    order = np.argsort(keyed)
    keyed = keyed[order]
    new = np.concatenate([[True], keyed[1:] != keyed[:-1]]) if len(keyed) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(keyed)]]))
    first = order[at]
    return ids[first], hashes[first], counts


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _none() -> tuple[np.ndarray, ...]:
    return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, np.float64))


def _joined(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*parts))


def signatures(ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_texts: int, m: int = SIZE) -> np.ndarray:
    """(n_texts, m) names of each component's earliest point; rows of texts without shingles are 0."""
    weight = np.bincount(ids, counts, n_texts)
    horizon = np.divide(np.log(m) + 4, weight, out=np.zeros(n_texts), where=weight > 0)
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, _U))]
    far: list[tuple] = []

    def drawn(seed: np.ndarray, start, width) -> tuple[np.ndarray, np.ndarray]:
        """Next seed and time of a process of m * width points a unit of time. Seeds are a counter, so many points can be drawn at once."""
        seed = seed + _U(_ODD)
        return seed, start - np.log(_uniform(_mix(seed))) / (m * width)

    def go_on(owner: np.ndarray, limit: np.ndarray, low: np.ndarray, seed: np.ndarray, time: np.ndarray) -> None:
        """Draw AHEAD points of each unit part; those within the horizon but the last are found, the next one waits."""
        for k in range(0, len(owner), SLICE):
            o, li, lo, s, t = (x[k : k + SLICE] for x in (owner, limit, low, seed, time))
            seeds = s[:, None] + _U(_ODD) * np.arange(1, AHEAD + 1, dtype=_U)
            times = t[:, None] + np.cumsum(-np.log(_uniform(_mix(seeds))) / m, axis=1)
            waits = np.minimum((times <= horizon[o][:, None]).sum(axis=1), AHEAD - 1)
            row, column = np.nonzero(np.arange(AHEAD) < waits[:, None])
            name = seeds[row, column]
            found.append((o[row] * m + component_of(name), times[row, column], name))
            every = np.arange(len(o))
            grown.append((o, li, lo, np.ones(len(o), np.int64), seeds[every, waits], times[every, waits]))

    def component_of(seed: np.ndarray) -> np.ndarray:
        return (_mix(seed ^ _U(0x5851F42D4C957F2D)) % _U(m)).astype(np.int64)

    def timed(root: tuple[np.ndarray, ...], pick: np.ndarray) -> tuple[np.ndarray, ...]:
        *process, u = (x[pick] for x in root)
        return *process, -np.log(u) / (m * process[3])

    # The roots: every part of the weight axis that begins below the weight. A process is
    # (text, its weight limit, low end, width, seed, time of its next point).
    top = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    now, later = _none(), [_none()]
    for k in range(int(top.max(initial=-1)) + 1):
        own = top >= k
        low, width = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        owner, seed = ids[own], _mix(_mix(hashes[own] + _U(k)) + _U(_ODD))
        u = _uniform(seed)
        soon = u >= np.exp(-horizon[owner] * (m * width))  # the others lie beyond the horizon and cost no logarithm
        root = owner, counts[own], np.full(len(owner), low), np.full(len(owner), width), seed, u
        now = _joined([now, timed(root, soon)])
        far.append((root, ~soon))
    filled = np.zeros((n_texts, m), bool)
    while True:
        while len(now[0]):
            owner, limit, low, width, seed, time = now
            reached = time <= horizon[owner]
            if not reached.all():
                later.append(tuple(x[~reached] for x in now))
                owner, limit, low, width, seed, time = (x[reached] for x in now)
            whole = low + width <= limit
            found.append((owner[whole] * m + component_of(seed[whole]), time[whole], seed[whole]))
            unit = width == 1
            many = unit & (m * (horizon[owner] - time) > AHEAD / 2)  # so many points are still expected within the horizon
            one = unit & ~many
            s, t = drawn(seed[one], time[one], 1)
            grown = [(owner[one], limit[one], low[one], width[one], s, t)]
            go_on(*(x[many] for x in (owner, limit, low, seed, time)))
            if not unit.all():
                o, li, lo, w, sd, tm = (x[~unit] for x in (owner, limit, low, width, seed, time))
                part = sd ^ _mix(lo.astype(_U) * _U(_ODD) + w.astype(_U))  # a point keeps its seed on the way down; each part draws anew
                half, coin = w // 2, (_mix(part ^ _U(0x2545F4914F6CDD1D)) & _U(1)).astype(bool)
                other, late = drawn(part ^ _U(0x632BE59BD9B4E019), tm, half)
                for side in (False, True):
                    mine = coin == side  # the half that keeps the point
                    at = lo + half * side
                    keep = at < li
                    grown.append((o[keep], li[keep], at[keep], half[keep], np.where(mine, sd, other)[keep], np.where(mine, tm, late)[keep]))
            now = _joined(grown)
        slots = np.concatenate([f[0] for f in found])
        filled.ravel()[slots] = True
        open_ = (weight > 0) & ~filled.all(axis=1)
        if not open_.any():
            break
        horizon[open_] *= 2
        later += [timed(root, pick) for root, pick in far]
        now, later, far = _joined(later), [_none()], []
    out = np.zeros(n_texts * m, _U)
    if len(slots):
        time, name = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        earliest = np.full(n_texts * m, np.inf)
        np.minimum.at(earliest, slots, time)
        first = time == earliest[slots]
        out[slots[first]] = name[first]
    return out.reshape(n_texts, m)


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the buckets (texts, BANDS), sketches (texts, BITS, 32 bytes), and which texts have words."""
    names, sketch, worded = np.zeros((len(texts), BANDS), np.int64), np.zeros((len(texts), BITS, 32), np.uint8), np.zeros(len(texts), bool)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK):
            held += len(texts[end])
            end += 1
        ids, hashes, counts = shingles(texts[at:end])
        sig = signatures(ids, hashes, counts, end - at)
        bands = sig[:, : BANDS * ROWS].reshape(end - at, BANDS, ROWS)
        name = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), bands.shape[:2])
        for r in range(ROWS):
            name = _mix(name * _U(_ODD) + bands[:, :, r])
        names[at:end] = name.view(np.int64)
        for k in range(BITS):
            sketch[at:end, k, : SIZE // 8] = np.packbits((sig >> _U(40 + k)).astype(np.uint8) & 1, axis=1)
        worded[at:end][ids] = True
        at = end
    return names, sketch, worded


def described(text: Column) -> Column:
    """struct(buckets, sketch); no buckets for a text without words."""

    @F.pandas_udf("buckets array<long>, sketch binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, sketch, worded = describe(texts.tolist())
        return pd.DataFrame({"buckets": [list(n) if w else [] for n, w in zip(names, worded)], "sketch": [k.tobytes() for k in sketch]})

    return of(text)


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many components agree, for sketches as (n, BITS * 4) words that broadcast against each other."""
    differ = left[..., :4] ^ right[..., :4]
    for k in range(4, 4 * BITS, 4):
        differ |= left[..., k : k + 4] ^ right[..., k : k + 4]
    return (SIZE - np.bitwise_count(differ).sum(axis=-1)).astype(np.uint8)


def likeness(left: np.ndarray, right: np.ndarray, of_left: np.ndarray, of_right: np.ndarray, least: int) -> np.ndarray:
    """(left, right) agreeing components plus one where ``least`` or more agree and the components ``of_*`` differ, else 0."""
    out = np.zeros((len(left), len(right)), np.uint8)
    step = max(1, (1 << 18) // max(1, len(right)))
    for k in range(0, len(left), step):
        n = agreeing(left[k : k + step, None], right[None])
        out[k : k + step] = np.where((n >= least) & (of_left[k : k + step, None] != of_right[None]), n + 1, 0)
    return out


def spanning(like: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest of the components ``of``: in each phase every component takes its likeliest pair (i, j)."""
    label = np.arange(int(of.max()) + 1)
    edges: list[tuple[int, int]] = []
    while True:
        own = label[of]
        free = np.where(own[:, None] != own[None], like, 0)
        i, j = np.arange(len(free)), free.argmax(axis=1)
        value = free[i, j].astype(int)
        order = np.argsort(-value, kind="stable")
        order = order[value[order] > 0]
        if not len(order):
            return edges
        _, first = np.unique(own[order], return_index=True)
        for i in order[np.sort(first)]:
            a, b = label[of[i]], label[of[j[i]]]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                edges.append((int(i), int(j[i])))


def _least(sketch_near: float) -> int:
    return int(np.ceil(sketch_near * SIZE))


def _sketches(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), 4 * BITS)


def _buckets_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    """Row numbers of each bucket in a group."""
    order = np.argsort(pdf["bucket"].to_numpy(), kind="stable")
    return np.split(order, np.flatnonzero(np.diff(pdf["bucket"].to_numpy()[order])) + 1) if len(pdf) else []


def dealt(members: DataFrame, rows: int, across: bool) -> DataFrame:
    """``members`` (``rows`` rows bucket, blocks, node, ...) with block, and alone, group, low, high to group by.

    A block of a bucket is one group, and if ``across``, each two blocks are one,
    so no group grows with the bucket. Buckets of one block share groups of about
    PACK rows, as a group costs more than a small bucket.
    """
    out = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    out = out.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if across else F.col("block"))
    out = out.withColumns({"low": F.least("block", "__other"), "high": F.greatest("block", "__other")}).drop("__other")
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket", F.lit(5)), F.lit(1 + rows // PACK))).otherwise(F.col("bucket"))
    return out.withColumns({"group": group, "alone": F.col("blocks") > 1}).drop("blocks")


GROUP = ["alone", "group", "low", "high"]


def proposed(members: DataFrame, rows: int, sketch_near: float) -> DataFrame:
    """(a, b, bucket) of each block's spanning forest, and rows without a and b for buckets with likely pairs left; members have bucket, blocks, node, sketch."""
    least = _least(sketch_near)

    def forests(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch, node, bucket = _sketches(pdf), pdf["node"].to_numpy(), pdf["bucket"].to_numpy()
        own = _buckets_of(pdf)
        two = [b for b in own if len(b) == 2]  # no forest needed
        i, j = np.array(two, np.int64).reshape(-1, 2).T
        near = agreeing(sketch[i], sketch[j]) >= least
        out = [(max(node[a], node[b]), min(node[a], node[b]), bucket[a]) for a, b in zip(i[near], j[near])]
        for b in (b for b in own if len(b) > 2):
            of = np.arange(len(b))
            like = likeness(sketch[b], sketch[b], of, of, least)
            edges = spanning(like, of)
            out += [(max(node[b[x]], node[b[y]]), min(node[b[x]], node[b[y]]), bucket[b[0]]) for x, y in edges]
            if np.count_nonzero(like) > 2 * len(edges):
                out.append((None, None, bucket[b[0]]))
        return pd.DataFrame(out, columns=["a", "b", "bucket"])

    return dealt(members, rows, False).groupBy(*GROUP).applyInPandas(forests, "a binary, b binary, bucket long")


def _likely(i: int, js: np.ndarray, band: int, names: np.ndarray, sketch: np.ndarray, component: np.ndarray, least: int) -> np.ndarray:
    """Of the members js those in another component than i whose sketch is near, if ``band`` is the first that both share."""
    js = js[component[js] != component[i]]
    js = js[agreeing(sketch[js], sketch[i]) >= least]
    return js[~(names[js, :band] == names[i, :band]).any(axis=1)] if band else js


def undecided(members: DataFrame, rows: int, sketch_near: float) -> DataFrame:
    """(bucket, node) of the members with a likely partner in another component; members have bucket, blocks, node, component, buckets, sketch."""
    least = _least(sketch_near)

    def partnered(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch, block, bucket = _sketches(pdf), pdf["block"].to_numpy(), pdf["bucket"].to_numpy()
        names, component = np.stack(pdf["buckets"].to_numpy()), pd.factorize(pdf["component"])[0]
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        some = np.zeros(len(pdf), bool)
        for b in _buckets_of(pdf):
            band = int(np.flatnonzero(names[b[0]] == bucket[b[0]])[0])
            left, right = b[block[b] == low], b[block[b] == high]
            for k, i in enumerate(left):
                js = _likely(i, right[k + 1 :] if low == high else right, band, names, sketch, component, least)
                some[js] = True
                some[i] |= len(js) > 0
        return pdf.loc[some, ["bucket", "node"]]

    return dealt(members, rows, True).groupBy(*GROUP).applyInPandas(partnered, "bucket long, node binary").distinct()


def settled(members: DataFrame, rows: int, sketch_near: float) -> DataFrame:
    """(a, b) of near pairs that connect the components of each block; members have bucket, blocks, node, component, buckets, sketch, text."""
    least = _least(sketch_near)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch, block, bucket, node = _sketches(pdf), pdf["block"].to_numpy(), pdf["bucket"].to_numpy(), pdf["node"].to_numpy()
        names, component = np.stack(pdf["buckets"].to_numpy()), pd.factorize(pdf["component"])[0]
        low, high, out = pdf["low"].iloc[0], pdf["high"].iloc[0], []
        for b in _buckets_of(pdf):
            band = int(np.flatnonzero(names[b[0]] == bucket[b[0]])[0])
            left, right = b[block[b] == low], b[block[b] == high]
            bags, place = Bags(pdf["text"].iloc[b].tolist()), {int(x): k for k, x in enumerate(b)}
            for k, i in enumerate(left):
                js = _likely(i, right[k + 1 :] if low == high else right, band, names, sketch, component, least)
                if len(js):
                    for j in js[bags.overlaps(place[int(i)], np.array([place[int(j)] for j in js])) >= NEAR]:
                        if component[i] != component[j]:
                            out.append((max(node[i], node[j]), min(node[i], node[j])))
                            component[component == component[j]] = component[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt(members, rows, True).groupBy(*GROUP).applyInPandas(links, "a binary, b binary").distinct()


class Bags:
    """The shingle multisets of a block's texts, numbered over all of them."""

    def __init__(self, texts: list[str]):
        ids, hashes, counts = shingles(texts)
        order = np.argsort(ids, kind="stable")
        ids, self.counts = ids[order], counts[order]
        self.shingle = np.unique(hashes[order], return_inverse=True)[1]
        self.begins = np.searchsorted(ids, np.arange(len(texts) + 1))
        self.total = np.bincount(ids, self.counts, len(texts))
        self.one = np.zeros(int(self.shingle.max(initial=-1)) + 1, np.int64)

    def overlaps(self, i: int, js: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of text i and each of js."""
        own = slice(self.begins[i], self.begins[i + 1])
        self.one[self.shingle[own]] = self.counts[own]
        sizes = self.begins[js + 1] - self.begins[js]
        at = np.repeat(self.begins[js] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        both = np.bincount(np.repeat(np.arange(len(js)), sizes), np.minimum(self.one[self.shingle[at]], self.counts[at]), len(js))
        self.one[self.shingle[own]] = 0
        either = self.total[i] + self.total[js] - both
        return np.divide(both, either, out=np.zeros(len(js)), where=either > 0)


@lru_cache(maxsize=8)
def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, hashes, counts = shingles([text])
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the shingle multisets; 1 for equal texts, else 0 if one has no word."""
    if a == b:
        return 1.0
    (ha, ca), (hb, cb) = _bag(a), _bag(b)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    either = int(ca.sum() + cb.sum()) - common
    return common / either if either else 0.0


def _near(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def near(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([overlap(x, y) >= NEAR for x, y in zip(left, right)], dtype=bool)

    return near(a, b)


def verified(pairs: DataFrame, texts: DataFrame, most: int = 1024) -> DataFrame:
    """The pairs (a, b) whose texts are near; ``texts`` has one row a node (node, text).

    b may be the hub of a large group: its text is repeated for every ``most`` of its pairs, which are dealt over the copies.
    """
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__copies"))
    left = texts.withColumnsRenamed({"node": "a", "text": "__ta"})
    right = texts.withColumnsRenamed({"node": "b", "text": "__tb"}).join(copies, "b").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    dealt = salted(pairs, copies, ["b"], by=["a"]).withColumn("__copy", F.pmod(F.xxhash64("a"), F.col("__copies")).cast("int")).drop("__copies")
    met = dealt.join(left, "a").join(right.drop("__copies"), ["b", "__copy"])
    return met.where(_near(F.col("__ta"), F.col("__tb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b): the smallest node it is connected to.

    Alternating large and small stars: each round points the neighbours of a
    node to the smallest of them; rounds grow with the logarithm of the longest
    path. Every round is a staged table of at most as many edges as before.
    """
    edges = stage(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = salted(both.where("v > u"), smallest, ["u"]).selectExpr("v as u", "m as v").distinct()
        large = stage(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, lowest, ["u"]).selectExpr("explode(array(struct(v as u, m as v), struct(u as u, m as v))) as e").select("e.*").where("u <> v").distinct()
        small = stage(small, "small-star")
        print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = tuple(print_of(edges)) == tuple(print_of(small))
        unstage(edges, large)
        edges = small
        if done:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return stage(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")


def connected(nodes: DataFrame, docs: DataFrame, sketch_near: float) -> DataFrame:
    """(node, component) of the nodes that have a link."""
    held = nodes.select("node", F.explode("buckets").alias("bucket"))
    size = F.count(F.lit(1))
    shared = held.groupBy("bucket").agg(F.min("node").alias("hub"), F.ceil(size / MEMBERS).cast("int").alias("blocks"), size.alias("__n"))
    shared = stage(shared.where("__n > 1").drop("__n"), "buckets")
    members = stage(salted(held, shared, ["bucket"]), "members")
    described_ = nodes.select("node", "buckets", "sketch")

    # First the forests, and the members of larger buckets with the hub that most of these share.
    forests = stage(proposed(members.drop("hub").join(nodes.select("node", "sketch"), "node"), members.count(), sketch_near), "forests")
    hubs = members.where("blocks > 1 and node <> hub").groupBy("node", "hub").count().groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    pairs = forests.where("a is not null").select("a", "b").unionByName(hubs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")))
    pairs = stage(pairs.distinct(), "pairs")

    # One text a node that takes part, found by the node's first document. Whoever has a likely pair is in a forest or has a hub.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first_id"), "node")
    texts = docs.select("doc_id", text_or_empty("text").alias("text"), F.unhex(F.md5(text_or_empty("text").cast("binary"))).alias("__node"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["first_id"]) & (texts["__node"] == wanted["node"])).select("node", "text")
    texts = stage(texts.dropDuplicates(["node"]), "texts")
    links = stage(verified(pairs, texts), "links")
    found = components(links)

    # Then what lies between components.
    open_ = forests.where("a is null").select("bucket").unionByName(members.where("blocks > 1").select("bucket")).distinct()
    placed = salted(members.drop("hub"), open_, ["bucket"]).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stage(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("__lo"), F.max("component").alias("__hi")).where("__lo <> __hi").select("bucket")
    apart = stage(salted(placed, mixed, ["bucket"]), "apart")
    rest = stage(undecided(apart.join(described_, "node"), apart.count(), sketch_near), "undecided")
    rest = rest.join(apart.select("bucket", "node", "component"), ["bucket", "node"]).join(texts, "node")
    rest = stage(rest.join(described_, "node").withColumn("__chars", F.length("text")), "rest")
    blocks = rest.groupBy("bucket").agg(F.ceil(F.greatest(size / MEMBERS, F.sum("__chars") / CHARS)).cast("int").alias("blocks"))
    across = stage(settled(salted(rest.drop("__chars"), blocks, ["bucket"], by=["node"]), rest.count(), sketch_near), "links")
    if not across.isEmpty():
        before, found = found, components(found.selectExpr("node as a", "component as b").unionByName(across))
        unstage(before)
    unstage(shared, members, forests, pairs, texts, links, placed, apart, rest, across)
    return found


def classes(docs: DataFrame, sketch_near: float = SKETCH_NEAR) -> DataFrame:
    """(doc_id, node, class_id, first) of every row of ``docs``; ``first``: rows that stand for their class, equal to each other in doc_id and text."""
    text = text_or_empty("text")
    own = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("node"), described(text).alias("d"))
    rows = stage(own.select("doc_id", "node", "d.*"), "signatures")
    nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.max("buckets").alias("buckets"), F.max("sketch").alias("sketch")), "nodes")
    found = connected(nodes, docs, sketch_near)

    linked = nodes.join(found, "node", "left").select("node", "n", "first_id", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("__linked"))
    linked = stage(linked.where("n > 1 or __linked"), "linked")
    least = F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("__least")
    firsts = linked.groupBy("component").agg(least).select("component", F.col("__least.first_id").alias("class_id"), F.col("__least.node").alias("first_node"))
    named = stage(salted(linked.select("node", "component"), firsts, ["component"]).select("node", "class_id", "first_node"), "classes")
    unstage(nodes, found, linked)
    met = salted(rows.select("doc_id", "node"), named.withColumn("__met", F.lit(True)), ["node"], how="left")
    alone = F.col("__met").isNull()
    first = alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first_node")))
    return met.select("doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), first.alias("first"))


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row stays: the smallest doc_id, of these the smallest MD5 of a text, of equal rows one."""
    others = stage(classes(docs).where("not first").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct(), "near-duplicates")
    node = F.unhex(F.md5(text_or_empty("text").cast("binary")))
    kept = docs.withColumn("__own", node).join(others, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__node")), "left_anti")
    return kept.dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
