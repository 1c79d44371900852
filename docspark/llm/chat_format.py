"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only that reply carries loss. A turn is written as

    ### role: text</turn>\\n

and a backslash goes before each backslash, hash and less-than sign of role and
text (in a role before colons too), so an unescaped mark is always the
template's and the text comes back exactly. Turns after the last reply form one
example without a target, so that no turn is lost.

Turns are numbered in Spark: a range sort deals any conversation over many tasks,
and what earlier partitions hold of it is added. A conversation is cut into blocks
of BLOCK_TURNS turns, dealt by (conv_id, block); a block first meets the texts of
the blocks before it, then its own turns stream through a generator, one row at a
time, which holds the current context. So no task writes more than BLOCK_TURNS
examples of a block, however long the conversation. Output text is quadratic in a
conversation's turns, as the method asks; an example is one string, so a formatted
conversation must stay below 2 GB and fit an executor's memory a few times.

Defined cases: null text and null role count as empty; a conversation without
an assistant turn is a single example without a target; an assistant turn that
comes first has an empty context; rows of one turn number (ties, repeats) are
all kept, ordered by role, then text; a null turn number sorts first; a null
conv_id is a conversation of its own; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table, text_or_empty
from docspark.plans.staging import stage

EXAMPLES = "conv_id long, example long, n_turns long, formatted string, loss_start long, loss_end long"
TRAINED_ROLE = "assistant"
BLOCK_TURNS = 256
_ROLE, _TEXT, _BACK = re.compile(r"[\\#<:]"), re.compile(r"[\\#<]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
#: The query's added conversation: both texts look like the template's own marks.
CONTROL = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text) if "\\" in text else text


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in columns))


def _id(c: str) -> Column:
    """Ids cross into pandas as text: a column with nulls would come as floats."""
    return F.col(c).cast("string").alias(c)


def _int(v):
    return None if v is None else int(v)


def _framed(rows: Iterator[tuple], schema: str, most_rows: int = 2000, most_chars: int = 1 << 23) -> Iterator[pd.DataFrame]:
    """Frames of bounded size; ids stay integers where some are null."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    part, held = [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame(part, columns=list(names), dtype=object).astype({n: "Int64" for n, k in zip(names, kinds) if k == "long"})

    for r in rows:
        part.append(r)
        held += sum(len(x) for x in r if isinstance(x, str))
        if len(part) >= most_rows or held >= most_chars:
            yield frame()
            part, held = [], 0
    if part:
        yield frame()


def _escaped(c: str, pattern: re.Pattern) -> Column:
    """``escape`` as a column."""
    return F.regexp_replace(c, f"({pattern.pattern})", "\\\\$1")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, at (number of the turn in its conversation, from 0) and turns (of the conversation).

    The range exchange looks at the first characters of a text only, which keeps its sample small and agrees with the
    sort. Offsets have a row for each conversation and partition that meet, so no key of their join is hot.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty("text").alias("text"))
    dealt = clean.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    held = stage(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__at", 33)), "chat-turns")
    counts = held.groupBy("conv_id", "__p").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = "coalesce(sum(__n) over (partition by conv_id order by __p rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.selectExpr("conv_id as __conv", "__p as __own", f"{before} - __first as __shift", "sum(__n) over (partition by conv_id) as turns")
    met = held.join(offsets, (F.col("__p") == F.col("__own")) & F.col("conv_id").eqNullSafe(F.col("__conv")))
    return met.select("conv_id", "role", "text", (F.col("__at") + F.col("__shift")).alias("at"), "turns")


def expand(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Examples (EXAMPLES) of conversations (conv_id, turn, role, text).

    loss_start and loss_end delimit, in code points of ``formatted``, the reply
    under loss; they are null in an example without a target. Examples of a
    block of turns follow each other in a partition, in their order.
    """

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> Iterator[tuple]:
            group, context, n, k = None, "", 0, 0
            for conv, block, head, body, held, replies, earlier, last in _rows(batches, ["conv_id", "block", "head", "body", "held", "replies", "earlier", "last"]):
                if group != (conv, block):
                    group, context, n, k = (conv, block), "", 0, 0
                n += held
                if earlier:
                    context, k = context + body, k + replies
                    continue
                start = len(context) + len(head)
                context = f"{context}{head}{body}</turn>\n"
                if replies:
                    yield _int(conv), k, n, context, start, start + len(body)
                    k += 1
                elif last:
                    yield _int(conv), k, n, context, None, None

        yield from _framed(out(), EXAMPLES)

    marks = {"head": F.concat(F.lit("### "), _escaped("role", _ROLE), F.lit(": ")), "body": _escaped("text", _TEXT), "replies": (F.col("role") == TRAINED_ROLE).cast("long")}
    rows = numbered(turns).withColumns(marks).withColumn("block", F.expr(f"at div {block_turns}"))
    own = rows.select("conv_id", "block", "at", "head", "body", F.lit(1).cast("long").alias("held"), "replies", F.lit(False).alias("earlier"), (F.col("at") + 1 == F.col("turns")).alias("last"))
    # Text of every block that another follows, once for each that does: a part of 1 / block_turns of what the examples hold.
    final = F.expr(f"(turns - 1) div {block_turns}")
    line = F.struct("at", F.concat("head", "body", F.lit("</turn>\n")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "")
    blocks = rows.where(F.col("block") < final).groupBy("conv_id", "block", final.alias("final")).agg(text.alias("body"), F.count(F.lit(1)).alias("held"), F.sum("replies").alias("replies"))
    spread = blocks.withColumns({"at": F.col("block") * block_turns, "head": F.lit(""), "earlier": F.lit(True), "last": F.lit(False)})
    spread = spread.withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("final")))).select(*own.columns)
    # The count is given because blocks of few bytes make many: adaptive execution would put them together again.
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = own.unionAll(spread).repartition(tasks, "conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    return together.withColumn("conv_id", _id("conv_id")).drop("at").mapInPandas(examples, EXAMPLES)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


PARTS = "conv_id long, example long, chars long, reply string, n_turns long, turns_sha256 string"


def read_back(examples: DataFrame) -> DataFrame:
    """DIGESTS of each conversation from its examples.

    The last example holds all turns; the reply under loss is cut out of each.
    formatted_chars sums the lengths of the conversation's examples. Examples are
    read where they lie; a digest of all turns is made of the last one of a
    conversation in each run of its examples. Only replies and lengths, together
    no longer than the conversation, stream through one generator in order, as
    a digest of their text needs.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def digest(formatted: str) -> tuple:
            turns, said = parse(formatted), hashlib.sha256()
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            return len(turns), said.hexdigest()

        def out() -> Iterator[tuple]:
            last, held = None, ""
            for conv_id, example, formatted, start, end in _rows(batches, ["conv_id", "example", "formatted", "loss_start", "loss_end"]):
                if last:
                    yield *last, *((None, None) if (last[0], last[1] + 1) == (_int(conv_id), example) else digest(held))
                reply = None if pd.isna(start) else unescape(formatted[int(start) : int(end)])
                last, held = (_int(conv_id), example, len(formatted), reply), formatted
            if last:
                yield *last, *digest(held)

        yield from _framed(out(), PARTS)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> Iterator[tuple]:
            conv, whole, chars, loss, loss_chars, n = None, None, 0, hashlib.sha256(), 0, 0
            for conv_id, length, reply, n_turns, said in _rows(batches, ["conv_id", "chars", "reply", "n_turns", "turns_sha256"]):
                if n and conv != conv_id:
                    yield _int(conv), *whole, loss_chars, loss.hexdigest(), chars, n
                    chars, loss, loss_chars, n = 0, hashlib.sha256(), 0, 0
                conv, whole, chars, n = conv_id, (n_turns, said), chars + length, n + 1
                if isinstance(reply, str):
                    loss.update(reply.encode("utf-8", "surrogatepass"))
                    loss_chars += len(reply)
            if n:
                yield _int(conv), *whole, loss_chars, loss.hexdigest(), chars, n

        yield from _framed(out(), DIGESTS)

    columns = examples.select(_id("conv_id"), "example", "formatted", "loss_start", "loss_end")
    ordered = columns.mapInPandas(parts, PARTS).repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.withColumn("conv_id", _id("conv_id")).mapInPandas(digests, DIGESTS)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string")
    return read_back(expand(turns.unionByName(control)))


ORACLE = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, 4 + length(role) + 2 + length(text) + 8 + length(regexp_replace(role, '[^\\\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\\\#<]', '', 'g')) AS n FROM c),
r AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR from_end = 1) AS n_examples
FROM r GROUP BY conv_id
"""
