"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. A class is split by what its members' next
turn says: members that agree stay together and are a node of the trie, named by depth and
smallest member. A class of one member retires: the rest of that conversation is a unary
chain, written out without looking at it again. The last pass folds counts
back from the nodes to those above them.

In Spark a round takes the next ``stride`` turns of the conversations that are still
in a class of two or more, writes each turn's class as a digest over (class at the start of the round,
turns since), and aggregates by it: count and smallest member come from partial aggregates, so a
class with a third of all conversations is no hot group. Strides grow to STRIDE, so depth costs few rounds.
Only classes of two or more are kept (``shared``). Folding doubles distances: in step k each node adds to
the node 2 ** k above it, so shared turns of any depth take a logarithm of steps.

Digests are SHA-256 of role and text with their lengths; equal digests count as equal turns.

Order of turns: turn number (null first), then role, the text's first 64 characters and digest, so ties and
repeated rows all stay, in a defined order. Numbering uses a range sort: a conversation of any length is dealt over many tasks.

Defined cases: null role or text is empty; rows without conv_id belong to no conversation and are left out; a conversation
that has no turns after rebuilding ends at the root; an empty table has no nodes; further columns and
clashing names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import salted, table, text_or_empty
from docspark.plans.staging import stage, unstage

STRIDE = 64
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODES = [x.split()[0] for x in SCHEMA.split(", ")]
_NONE = hashlib.sha256().hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (number of the turn from 0), key (digest of role and text), bytes (of the text), turns (of the conversation); staged."""
    role, text = F.coalesce("role", F.lit("")), text_or_empty("text")
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    clean = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), F.unhex(key).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", "turn", "role", "head", "key"]
    dealt = clean.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "bytes")
    held = stage(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__at", 33)), "trie-numbered")
    counts = held.groupBy("conv_id", "__p").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = "coalesce(sum(__n) over (partition by conv_id order by __p rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.selectExpr("conv_id as __conv", "__p as __own", f"{before} - __first as __shift", "sum(__n) over (partition by conv_id) as turns")
    met = held.join(offsets, (F.col("__p") == F.col("__own")) & (F.col("conv_id") == F.col("__conv")))
    out = stage(met.select("conv_id", (F.col("__at") + F.col("__shift")).alias("at"), "key", "bytes", "turns"), "trie-turns")
    unstage(held)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, bytes) and (conv_id, length): the first h turns of conversation c - c % 5, then the own ones after the first h; h = crc32(c) % 9.

    A conversation lends at most eight turns to at most nine others, so no key of the joins is hot.
    """
    most = 8
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("long")
    convs = turns.where("at = 0").select("conv_id", "turns")
    lenders = convs.select(F.col("conv_id").alias("lender"), F.col("turns").alias("has"))
    sized = convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", h).join(lenders, "lender", "left")
    sized = stage(sized.select("conv_id", "lender", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("lent"), "turns"), "trie-lent")
    # A shift differs from 0 only where the lender has fewer turns than h, so where turns go is known without a join of all turns for the others.
    shifts = sized.where("lent < h and turns > h").select("conv_id", (F.col("lent") - F.col("h")).alias("shift"))
    own = turns.where(F.col("at") >= h).select("conv_id", "at", "key", "bytes")
    own = salted(own, shifts, ["conv_id"], how="left", by=["at"]).select("conv_id", (F.col("at") + 1 + F.coalesce("shift", F.lit(0))).alias("depth"), "key", "bytes")
    heads = turns.where(F.col("at") < most).select(F.col("conv_id").alias("lender"), "at", "key", "bytes")
    lent = sized.where("lent > 0").join(heads, "lender").where("at < lent").select("conv_id", (F.col("at") + 1).alias("depth"), "key", "bytes")
    lengths = sized.select("conv_id", (F.col("lent") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("length"))
    return stage(own.unionByName(lent), "trie-rebuilt"), lengths


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form of ``rebuilt``."""
    return turns.select("conv_id", (F.col("at") + 1).alias("depth"), "key", "bytes"), turns.where("at = 0").select("conv_id", F.col("turns").alias("length"))


def shared_classes(turns: DataFrame, convs: DataFrame, stride: int = 8) -> tuple[DataFrame, DataFrame, int]:
    """Classes of two or more members below the root, and which conversation is in which; the greatest depth of one.

    (depth, rep, n, bytes) and (conv_id, depth, rep).
    """
    classes, members = [], []
    active = convs.select("conv_id", F.lit(0).cast("long").alias("__class"))
    done, deepest = 0, 0
    while True:
        part = turns.where(F.col("depth").between(done + 1, done + stride)).join(active, "conv_id")
        path = F.array_sort(F.collect_list(F.struct("depth", "key", "bytes")))
        start = F.struct(F.sha2(F.concat_ws(":", F.lit(done).cast("string"), F.col("__class").cast("string")).cast("binary"), 256).alias("code"), F.array().cast("array<struct<depth:bigint,code:string,bytes:bigint>>").alias("out"))

        def step(s: Column, t: Column) -> Column:
            code = F.sha2(F.concat(s["code"].cast("binary"), t["key"]), 256)
            return F.struct(code.alias("code"), F.concat(s["out"], F.array(F.struct(t["depth"].alias("depth"), code.alias("code"), t["bytes"].alias("bytes")))).alias("out"))

        # At most ``stride`` turns of a conversation meet in a row.
        coded = part.groupBy("conv_id", "__class").agg(path.alias("__path")).select("conv_id", F.explode(F.aggregate("__path", start, step, lambda s: s["out"])).alias("t"))
        coded = stage(coded.select("conv_id", "t.*"), "trie-codes")
        split = coded.groupBy("depth", "code").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")).where("n > 1")
        split = stage(split, "trie-classes")
        inside = stage(salted(coded.select("conv_id", "depth", "code"), split.select("depth", "code", "rep"), ["depth", "code"]).select("conv_id", "depth", "rep"), "trie-members")
        unstage(coded)
        classes.append(split.drop("code"))
        members.append(inside)
        reached = split.agg(F.max("depth")).first()[0]
        if reached is None:
            break
        deepest, done = reached, done + stride
        if reached < done:
            break
        active = inside.where(F.col("depth") == done).select("conv_id", F.col("rep").alias("__class"))
        stride = min(2 * stride, STRIDE)
    return reduce(DataFrame.unionByName, classes), reduce(DataFrame.unionByName, members), deepest


def ends_digests(ends: DataFrame, ids: int = 4096) -> DataFrame:
    """(rep, depth, ends_sha256) of the conversations (conv_id) that end at each node.

    A digest reads its ids in order. They are range-sorted and joined to pieces of ``ids`` first, where
    they lie; then a node's pieces stream through one hash, which is all that is held of them.
    """
    schema = "rep long, depth long, first long, ids string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for rep, depth, conv in zip(rows["rep"], rows["depth"], rows["conv_id"]):
                if not out or out[-1][:2] != (rep, depth) or len(out[-1][3]) >= ids:
                    out.append((rep, depth, conv, []))
                out[-1][3].append(str(conv))
            reps, depths, firsts, texts = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "depth": pa.array(depths, pa.int64()), "first": pa.array(firsts, pa.int64()), "ids": pa.array([",".join(x) for x in texts], pa.string())})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, said, out = None, None, []

        def frame() -> pa.RecordBatch:
            reps, depths, found = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "depth": pa.array(depths, pa.int64()), "ends_sha256": pa.array(found, pa.string())})

        for batch in batches:
            rows = batch.to_pydict()
            for rep, depth, text in zip(rows["rep"], rows["depth"], rows["ids"]):
                if node != (rep, depth):
                    if node:
                        out.append((*node, said.hexdigest()))
                    node, said = (rep, depth), hashlib.sha256()
                else:
                    said.update(b",")
                said.update(text.encode())
            if len(out) >= 10_000:
                yield frame()
                out = []
        if node:
            out.append((*node, said.hexdigest()))
        yield frame()

    order = ["rep", "depth", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, schema)
    return joined.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(digests, "rep long, depth long, ends_sha256 string")


def folded(nodes: DataFrame, deepest: int) -> DataFrame:
    """nodes (rep, depth, up_rep, up_depth, leaves, saved) with leaves and saved summed over each node's subtree.

    After step k a node holds the sums of what is less than 2 ** (k + 1) below it, and points 2 ** (k + 1) above.
    """
    at = ["rep", "depth"]
    for k in range(deepest.bit_length()):
        below = nodes.where("up_rep is not null").groupBy(F.col("up_rep").alias("rep"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("__l"), F.sum("saved").alias("__s"))
        jumps = nodes.select(F.col("rep").alias("up_rep"), F.col("depth").alias("up_depth"), F.col("up_rep").alias("__r"), F.col("up_depth").alias("__d")).where("__r is not null")
        jumped = salted(nodes, jumps, ["up_rep", "up_depth"], how="left", by=at).join(below, at, "left")
        more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        old, nodes = nodes, stage(jumped.select(*at, F.col("__r").alias("up_rep"), F.col("__d").alias("up_depth"), more("leaves", "__l"), more("saved", "__s")), "trie-folded")
        unstage(old)
    return nodes.select(*at, "leaves", "saved")


def trie(turns: DataFrame, convs: DataFrame, stride: int = 8, block: int = 4096) -> DataFrame:
    """NODES of the conversations (conv_id, depth, key, bytes) of ``convs`` (conv_id, length).

    A node's last turn is turn ``depth`` of conversation ``conv_id``.
    """
    spark = turns.sparkSession
    lowest, count = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    top = F.lit(lowest).cast("long")
    classes, members, deepest = shared_classes(turns, convs, stride)
    root = spark.createDataFrame([(0, lowest, count, 0)], "depth long, rep long, n long, bytes long")
    last = members.groupBy("conv_id").agg(F.max(F.struct("depth", "rep")).alias("m"))
    left = convs.join(last, "conv_id", "left")
    left = stage(left.select("conv_id", "length", F.coalesce("m.depth", F.lit(0)).alias("depth"), F.coalesce("m.rep", top).alias("rep")), "trie-left")

    # Shared nodes with their parents: the smallest member is in the class above as well.
    above = members.select(F.col("conv_id").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("up"))
    nodes = classes.unionByName(root).join(above, ["rep", "depth"], "left")
    up_rep = F.when(F.col("depth") == 1, top).when(F.col("depth") > 1, F.col("up"))
    nodes = stage(nodes.select("rep", "depth", "n", "bytes", up_rep.alias("up_rep"), F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth")), "trie-nodes")
    kids = nodes.where("up_rep is not null").groupBy(F.col("up_rep").alias("rep"), F.col("up_depth").alias("depth")).agg(F.count(F.lit(1)).alias("kids"))
    tails = left.where("length > depth").groupBy("rep", "depth").agg(F.count(F.lit(1)).alias("tails"))
    met = nodes.join(kids, ["rep", "depth"], "left").join(tails, ["rep", "depth"], "left")
    n_kids, n_tails = F.coalesce("kids", F.lit(0)), F.coalesce("tails", F.lit(0))
    met = stage(met.select("rep", "depth", "n", "up_rep", "up_depth", (n_kids + n_tails).alias("n_children"), (n_tails + F.when(n_kids + n_tails == 0, 1).otherwise(0)).alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved")), "trie-own")
    unstage(nodes)
    sums = folded(stage(met.select("rep", "depth", "up_rep", "up_depth", "leaves", "saved"), "trie-folded"), deepest)
    digests = ends_digests(left.where("length = depth"))
    whole = met.select("rep", "depth", "n", "up_rep", "n_children").join(sums, ["rep", "depth"]).join(digests, ["rep", "depth"], "left")
    inner = whole.select(F.col("rep").alias("conv_id"), "depth", F.col("up_rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))

    # Unary chains: blocks of depths first, dealt out before they are written out.
    chains = left.where("length > depth").select("conv_id", "length", F.col("depth").alias("from"), "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - depth - 1) div {block}"))).alias("__b"))
    chains = chains.repartition("conv_id", "__b").select("*", F.explode(F.sequence(F.col("from") + 1 + F.col("__b") * block, F.least("length", F.col("from") + (F.col("__b") + 1) * block))).alias("depth"))
    ended = F.col("depth") == F.col("length")
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    one = F.lit(1).cast("long")
    tail = chains.select("conv_id", "depth", F.when(F.col("depth") == F.col("from") + 1, F.col("rep")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(ended, own).otherwise(F.lit(_NONE)).alias("ends_sha256"))
    return inner.select(*NODES).unionByName(tail.select(*NODES))


def prefix_trie(conversations: DataFrame, stride: int = 8) -> DataFrame:
    """NODES of conversations (conv_id, turn, role, text) as they are."""
    return trie(*plain(numbered(conversations)), stride)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))


ORACLE = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS at FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS turns, CAST(conv_id AS VARCHAR) AS s FROM o GROUP BY conv_id),
-- crc32 by its definition: eight shifts a byte, from all ones, complemented
c AS (SELECT conv_id, turns, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
  lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)::BIGINT[]), lambda z, k: CASE WHEN z % 2 = 1 THEN xor(z >> 1, 3988292384::BIGINT) ELSE z >> 1 END)) AS r FROM ids),
h AS (SELECT conv_id, turns, xor(r, 4294967295::BIGINT) % 9 AS h, conv_id - conv_id % 5 AS lender FROM c),
n AS (SELECT h.*, least(h, coalesce(l.turns, 0)) AS lent FROM h LEFT JOIN (SELECT conv_id AS lender, turns FROM ids) l USING (lender)),
t AS (SELECT n.conv_id, o.at + 1 AS d, role, text FROM n JOIN o ON o.conv_id = n.lender AND o.at < n.h
  UNION ALL SELECT n.conv_id, lent + o.at - n.h + 1, role, text FROM n JOIN o ON o.conv_id = n.conv_id AND o.at >= n.h),
p AS (SELECT conv_id, d, strlen(text) AS bytes, string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM t
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
m AS (SELECT conv_id, d, bytes, min(conv_id) OVER (PARTITION BY d, path) AS rep, max(d) OVER (PARTITION BY conv_id) AS length FROM p),
g AS (SELECT rep, d, count(*) AS n, max(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends FROM m GROUP BY rep, d),
u AS (SELECT g.*, m.rep AS up FROM g LEFT JOIN m ON m.conv_id = g.rep AND m.d = g.d - 1),
k AS (SELECT up AS rep, d - 1 AS d, count(*) AS kids FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(kids, 0) AS kids FROM u LEFT JOIN k USING (rep, d)),
s AS (SELECT m.rep, m.d, sum((v.n - 1) * v.bytes) AS saved, count(*) FILTER (v.kids = 0) AS leaves FROM v JOIN m ON m.conv_id = v.rep AND m.d <= v.d GROUP BY ALL)
SELECT rep AS conv_id, CAST(d AS BIGINT) AS depth, up AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 FROM v JOIN s USING (rep, d)
"""
