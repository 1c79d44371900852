"""Ranked retrieval: BM25 postings, dense vectors, rank fusion, guaranteed places, glossary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import UNICODE, TextProfile
from docspark.plans.staging import stage

K1, B, RRF_K, DEPTH = 1.5, 0.75, 60, 100
#: Queries that one pass over the vectors compares at most; more queries are more passes.
QUERY_BLOCK = 4096
#: Vectors that a task compares with the queries at a time.
ROW_BLOCK = 512
#: Scores, tokens of documents, and pairs of a document's term and a query that a task holds at once, besides those of one document.
HELD_SCORES, HELD_TOKENS, HELD_PAIRS = 1 << 20, 1 << 18, 1 << 18


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text", profile: TextProfile = UNICODE) -> DataFrame:
    """(id, term, tf, n_tokens) of every document."""
    counted = docs.select(id_, T.tokens(text, profile).alias("__t")).select(id_, F.size("__t").alias("n_tokens"), F.explode("__t").alias("term"))
    return counted.groupBy(id_, "n_tokens", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(post: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) of rows with a term for each document that has it."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def limited_broadcast(rows: DataFrame, most: int = 200_000, most_bytes: int = 1 << 25) -> DataFrame:
    """rows with the hint to send them whole, if they are no more than ``most`` and, written out, no more than ``most_bytes``; else as they are."""
    n, size = rows.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(rows) if n <= most and size <= most_bytes else rows


def bm25(docs: DataFrame, queries: DataFrame, id_: str = "doc_id", query_id: str = "item_id", profile: TextProfile = UNICODE, weight: str | None = None) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with a query; repeated query terms count again.

    Only query terms leave the documents: they are picked before anything is
    counted or shuffled, and document frequencies are theirs alone. The document
    count and mean length come from one aggregate over the token counts.
    """
    lengths = docs.select(F.size(T.tokens("text", profile)).alias("n"))
    n_docs, mean = lengths.agg(F.count(F.lit(1)), F.avg("n")).first()
    asked = queries.select(query_id, F.explode(T.tokens("text", profile, query=True)).alias("term"))
    asked = stage(asked.groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf")), "query-terms")
    terms = limited_broadcast(asked.select("term").distinct())
    counted = docs.select(id_, T.tokens("text", profile).alias("__t")).select(id_, F.size("__t").alias("n_tokens"), F.explode("__t").alias("term"))
    post = counted.join(terms, "term", "left_semi").groupBy(id_, "n_tokens", "term").agg(F.count(F.lit(1)).alias("tf"))
    post = stage(post, "query-postings")
    idf = term_stats(post, n_docs or 0)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.lit(mean or 1.0)))
    scored = post.join(limited_broadcast(asked.join(idf, "term")), "term").groupBy(query_id, id_).agg(F.sum(part).alias("score"))
    if weight:
        scored = scored.join(docs.select(id_, weight), id_).withColumn("score", F.col("score") * F.col(weight)).drop(weight)
    return scored


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", query_id: str = "item_id", profile: TextProfile = UNICODE, weight: str | None = None, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best of each query by BM25, as ``ranked(bm25(...))`` gives them.

    Queries go out in blocks of at most QUERY_BLOCK with their terms. Documents are tokenised once for a block: what stays
    of one is its length and its counts of the block's terms. Tasks score documents in blocks of ROW_BLOCK and keep
    the k best they have seen of each query; a block whose best score does not reach the k-th so far is passed over. So
    at most k rows a query and task leave the tasks, never a row for each document and query that share a word.
    """
    spark, out = docs.sparkSession, None
    asked = queries.select(query_id, F.explode(T.tokens("text", profile, query=True)).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = stage(asked, "query-terms")
    kinds = f"{query_id} {dict(queries.dtypes)[query_id]}, {id_} {dict(docs.dtypes)[id_]}, score double"
    blocks = max(1, -(-asked.select(query_id).distinct().count() // QUERY_BLOCK))
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        rows = own.orderBy("term", query_id).collect()
        if not rows:
            continue
        terms, names = sorted({r["term"] for r in rows}), sorted({r[query_id] for r in rows})
        held = stage(docs.select(id_, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__weight"), T.tokens("text", profile).alias("__t")).mapInArrow(_term_counts(spark.sparkContext.broadcast(terms), id_), f"{id_} {dict(docs.dtypes)[id_]}, __weight double, n long, codes array<int>, tfs array<int>"), "query-postings")
        n_docs, mean = held.agg(F.count(F.lit(1)), F.avg("n")).first()
        df = np.zeros(len(terms))
        for r in held.select(F.explode("codes").alias("c")).groupBy("c").count().collect():  # one row a term of the block
            df[r["c"]] = r["count"]
        place, code = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(terms)}
        of_term = np.array([code[r["term"]] for r in rows])
        shared = spark.sparkContext.broadcast(
            {
                "names": names,
                "first": np.searchsorted(of_term, np.arange(len(terms) + 1)),
                "query": np.array([place[r[query_id]] for r in rows]),
                "qtf": np.array([r["qtf"] for r in rows], float),
                "idf": np.log(1 + ((n_docs or 0) - df + 0.5) / (df + 0.5)),
                "mean": mean or 1.0,
            }
        )
        part = held.mapInPandas(_best_by_terms(shared, k, id_, digits), kinds)
        out = part if out is None else out.unionAll(part)
    return ranked(out if out is not None else spark.createDataFrame([], kinds), query_id, id_, k, digits)


def _pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to ``most`` at most, but for one more."""
    piece = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _term_counts(terms, id_: str):
    """Length of each document and its counts of the given terms, by their numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms.value, pa.string())
        for whole in batches:
            sizes = pc.list_value_length(whole.column("__t")).fill_null(0).to_numpy()
            for a, b in _pieces(sizes, HELD_TOKENS):
                batch = whole.slice(a, b - a)
                tokens = batch.column("__t")
                length = pc.cast(pc.list_value_length(tokens), pa.int64())  # null for a null text, which counts as a document without a length
                found = pc.index_in(tokens.flatten().cast(pa.string()), known)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(b - a), sizes[a:b])[hit]
                key, tf = np.unique(doc * max(1, len(known)) + found.drop_null().to_numpy(), return_counts=True)
                doc, code = np.divmod(key, max(1, len(known)))
                at = pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (code, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(id_), batch.column("__weight"), length, *lists], [id_, "__weight", "n", "codes", "tfs"])

    return counted


def _best_by_terms(shared, k: int, id_: str, digits: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        n, first, idf = len(v["names"]), v["first"], v["idf"]
        ids, scores = np.zeros((n, k), np.int64), np.zeros((n, k))
        for batch in batches:
            batch = batch[batch["codes"].map(len) > 0]
            reach = first[1:] - first[:-1]
            pairs = np.array([reach[codes].sum() for codes in batch["codes"]], np.int64)
            # Neither the scores nor the pairs of a block outgrow their bounds.
            for a, b in _pieces(np.maximum(pairs, max(HELD_PAIRS // ROW_BLOCK, -(-n * HELD_PAIRS // HELD_SCORES))), HELD_PAIRS):
                block = batch.iloc[a:b]
                own = block[id_].to_numpy(np.int64)
                size = block["codes"].map(len).to_numpy()
                doc, code, tf = np.repeat(np.arange(len(block)), size), np.concatenate(block["codes"].tolist()), np.concatenate(block["tfs"].tolist())
                part = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * block["n"].to_numpy()[doc] / v["mean"]))
                times = reach[code]
                pair = np.repeat(first[code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                value = np.repeat(part, times) * v["qtf"][pair]
                found = np.bincount(v["query"][pair] * len(block) + np.repeat(doc, times), value, n * len(block)).reshape(n, len(block))
                found = np.round(found * block["__weight"].fillna(0.0).to_numpy(), digits)
                # A query whose k-th score so far this block does not reach keeps its list.
                some = np.flatnonzero((found.max(1) > 0) & (found.max(1) >= scores[:, -1]))
                both, names = np.concatenate([scores[some], found[some]], 1), np.concatenate([ids[some], np.broadcast_to(own, (len(some), len(own)))], 1)
                order = np.lexsort((names, -both), axis=1)[:, :k]
                ids[some], scores[some] = np.take_along_axis(names, order, 1), np.take_along_axis(both, order, 1)
        q, place = np.nonzero(scores > 0)
        yield pd.DataFrame({0: [v["names"][i] for i in q], 1: ids[q, place], 2: scores[q, place]})

    return best


def first_of_each(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, *held: np.ndarray) -> tuple[np.ndarray, ...]:
    """(of, *held) of the k first entries of each number in ``of``: by score rounded to six digits, falling, then id."""
    order = np.lexsort((ids, -np.round(scores, 6), of))
    own = of[order]
    order = order[np.arange(len(own)) - np.searchsorted(own, own) < k]
    return (of[order], *(x[order] for x in held))


def reaching(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of a block's scores that, rounded to six digits, are no less than the row's ``least``, nor, where that is not known yet, than its k-th score. What is no number comes last."""
    found = np.fmax(np.round(scores, 6), -np.inf)
    if found.shape[1] > k and np.isneginf(least).any():
        least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
    return np.nonzero(found >= least[:, None])


def ranked(scored: DataFrame, query_id: str, id_: str, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query with score > 0, by rounded score, then id."""
    s = scored.withColumn("score", F.round("score", digits)).where("score > 0")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(id_))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score): cosine top-k of each query over all vectors.

    Queries go out in blocks of bounded size; each task keeps the k best it has
    seen of each query, so what is shuffled is k rows a query and task.
    """
    spark, out = vectors.sparkSession, None
    wanted = stage(queries.select(query_id, vector).where(F.col(vector).isNotNull()), "dense-queries")
    n = wanted.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    for b in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        rows = own.orderBy(query_id).collect()
        if not rows:
            continue
        matrix = np.array([r[vector] for r in rows], np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((np.array([r[query_id] for r in rows]), matrix / np.where(norms == 0, 1, norms)))
        part = vectors.select(id_, vector).mapInPandas(_best(shared, k, id_, vector), f"{query_id} long, {id_} long, score double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], f"{query_id} long, {id_} long, score double")
    return ranked(out, query_id, id_, k)


def _best(shared, k: int, id_: str, vector: str):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        of, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(names), -np.inf)  # a query's k-th score so far, rounded
        step = max(1, min(ROW_BLOCK, HELD_SCORES // len(names)))
        for batch in batches:
            batch = batch.dropna()
            for at in range(0, len(batch), step):
                rows = batch.iloc[at : at + step]
                v, own = np.stack(rows[vector].to_numpy()).astype(np.float64), rows[id_].to_numpy(np.int64)
                norms = np.linalg.norm(v, axis=1, keepdims=True)
                s = matrix @ (v / np.where(norms == 0, 1, norms)).T
                q, place = reaching(s, k, least)
                of, ids, scores = np.concatenate([of, q]), np.concatenate([ids, own[place]]), np.concatenate([scores, s[q, place]])
                of, ids, scores = first_of_each(of, ids, scores, k, ids, scores)
                last = np.flatnonzero(np.bincount(of, minlength=len(names)) >= k)
                least[last] = np.fmax(np.round(scores[np.searchsorted(of, last, "right") - 1], 6), -np.inf)
        if len(of):
            yield pd.DataFrame({0: names[of], 1: ids, 2: scores})

    return best


def fuse(lists: list[DataFrame], query_id: str, id_: str, depth: int = DEPTH) -> DataFrame:
    """(query_id, id, rrf, rank): reciprocal ranks of each list's first ``depth`` summed; of equals those of the first list stand first, in its order, then the next list's."""
    each = [x.where(F.col("rank") <= depth).select(query_id, id_, F.lit(n).alias("__l"), F.col("rank").alias("__r")) for n, x in enumerate(lists)]
    both = reduce(DataFrame.unionAll, each)
    places = [F.min(F.when(F.col("__l") == n, F.col("__r"))).alias(f"__p{n}") for n in range(len(lists))]
    summed = both.groupBy(query_id, id_).agg(F.round(F.sum(1.0 / (RRF_K + F.col("__r"))), 9).alias("rrf"), *places)
    w = Window.partitionBy(query_id).orderBy(F.desc("rrf"), *[F.asc_nulls_last(f"__p{n}") for n in range(len(lists))], F.asc(id_))
    return summed.withColumn("rank", F.row_number().over(w)).drop(*[f"__p{n}" for n in range(len(lists))])


def filter_after_rank(fused: DataFrame, group: DataFrame, query_id: str, id_: str, open_first: int = 4) -> DataFrame:
    """Rows whose group is the query's or null, the first ``open_first`` of the query's own paragraph moved to the front.

    ``group``: (query_id, id, chapter, query_chapter, own). The filter follows
    the ranking, which is over everything.
    """
    met = fused.join(group, [query_id, id_]).where("query_chapter is null or chapter is null or chapter = query_chapter")
    own = Window.partitionBy(query_id, "own").orderBy("rank")
    met = met.withColumn("__front", F.coalesce(F.col("own") & (F.row_number().over(own) <= open_first), F.lit(False)))
    w = Window.partitionBy(query_id).orderBy(F.desc("__front"), "rank")
    return met.withColumn("rank", F.row_number().over(w)).drop("__front")


def guarantee(top: Column, sure: Column) -> Column:
    """Array top with every entry of sure in it: each missing one takes the place of the last entry that is not sure itself."""

    def put(t: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda j: ~F.array_contains(sure, F.get(t, j)))
        at = F.array_max(free)
        return F.when(F.array_contains(t, x) | (F.size(t) == 0) | at.isNull(), t).otherwise(F.transform(t, lambda y, j: F.when(j == at, x).otherwise(y)))

    return F.aggregate(sure, top, put)


def hybrid(keyword: DataFrame, dense: DataFrame, query_id: str, id_: str, k: int = 8, sure_keyword: int = 3, sure_dense: int = 2) -> DataFrame:
    """(query_id, id, rank) of the fused top k with the strongest hits of either list inside it."""
    listed = lambda df, cond, name: df.where(cond).groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", id_))), lambda x: x[id_]).alias(name))
    fused = fuse([keyword, dense], query_id, id_)
    top = listed(fused, F.col("rank") <= k, "top")
    kw, dn = listed(keyword, F.col("rank") <= sure_keyword, "kw"), listed(dense, F.col("rank") <= sure_dense, "dn")
    met = top.join(kw, query_id, "left").join(dn, query_id, "left")
    none = F.array().cast("array<long>")
    sure = F.array_distinct(F.concat(F.coalesce("kw", none), F.coalesce("dn", none)))
    return met.select(query_id, F.posexplode(guarantee(F.col("top"), sure)).alias("__p", id_)).select(query_id, id_, (F.col("__p") + 1).alias("rank"))
