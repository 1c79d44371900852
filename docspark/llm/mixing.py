"""Time-varying mixing of sources to target weights, with DataFrame functions only.

Weights. Sources in code point order, null last, weigh 3, 1, 2, repeating, and
share SHARE of all sizes; a target stops at MOST times its source's size and the
excess is dealt again by weight. That is water-filling: with sources in the order
of MOST * size / weight, the level is the first at which the rest fits.

Amount. A source's documents stand in the order of a hash and are read from the
start, round after round, until the target is reached; a document's taken words
are what of its passes lies before the target, rounded so that the source's sum
is its rounded target.

Time. A source's share of the demand changes over training: its weight goes
linearly from (1 + slope) to (1 - slope) of its mean. The integral of the
schedule is the source's cumulative demand, a quadratic that is inverted in
closed form to turn a document's place in its source's stream into a training
position between 0 and 1, one for each pass; the mix is range-sorted by position.

Prefix sums run over one order of all rows (source, hash of the id, hash of the text, row number of
the scan) in range-sorted blocks (``operators.scan``); a source's own sum is the whole less what the
sources before it hold. So a source, an id or a group of equal rows with a third of the
rows is spread over many tasks. Only keys and sizes are sorted; documents meet them
by row number. The table of sources, one short row each, is ranked in one task.

Defined cases: a null text has size 0; empty documents take nothing; a null source
is one of its own; without any word all targets are 0; rows equal in id and text
are dealt one after the other; further columns are carried by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import salted, table, text_or_empty
from docspark.operators.scan import BLOCK, PLACE, in_order, running
from docspark.plans.staging import stage

WEIGHTS = [3.0, 1.0, 2.0]
SLOPES = [0.5, -0.5, 0.0]
SHARE, MOST = 1.5, 2


def sized(docs: DataFrame) -> DataFrame:
    """docs (a scan) with __size (words), __h, __t and __row: the order inside a source."""
    text = text_or_empty("text")
    n_words = F.size(F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +", -1))
    return docs.withColumns(
        {
            "__size": F.when(text.rlike("[^\\x20\\x09-\\x0D]"), n_words).otherwise(0).cast("long"),
            "__h": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
            "__t": F.md5(text.cast("binary")),
            "__row": F.monotonically_increasing_id(),
        }
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, slope, target, __base) of each source in ``sizes`` (source, __size); __base: words of the sources before it, null first."""
    pick = lambda values, of: F.element_at(F.array(*map(F.lit, values)), ((of - 1) % len(values) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"))
    s = s.selectExpr("source", "source_size", "row_number() over (order by source asc nulls last) as __i")
    s = s.select("source", "source_size", pick(WEIGHTS, F.col("__i")).alias("weight"), pick(SLOPES, F.col("__i")).alias("slope"))
    by_ratio = "order by source_size / weight, source asc nulls last"
    s = s.selectExpr(
        "*",
        f"coalesce(sum(source_size) over ({by_ratio} rows between unbounded preceding and 1 preceding), 0) as __full",
        f"coalesce(sum(weight) over ({by_ratio} rows between current row and unbounded following), 0) as __open",
        "sum(source_size) over () as __all",
        "coalesce(sum(source_size) over (order by source asc nulls first rows between unbounded preceding and 1 preceding), 0) as __base",
    )
    # The level if this source and all after it are open; levels fall after the first source that its level does not fill, whose level holds.
    s = s.withColumn("__level", (SHARE * F.col("__all") - MOST * F.col("__full")) / F.col("__open"))
    s = s.withColumn("__fits", F.col("__level") * F.col("weight") <= MOST * F.col("source_size"))
    s = s.selectExpr("*", "max(CASE WHEN __fits THEN __level END) over () as __water")
    target = F.least(F.lit(float(MOST)) * F.col("source_size"), F.coalesce("__water", F.lit(1e300)) * F.col("weight"))
    return s.select("source", "source_size", "weight", "slope", F.round(target, 6).alias("target"), "__base")


def mix(keys: DataFrame) -> DataFrame:
    """Sized keys (source, __size, __h, __t, __row) with source_size, target, slope, taken, __start (words before the row in a pass) and position (of the first pass, null if none is taken)."""
    ordered = running(in_order(keys, ["source", "__h", "__t", "__row"], "mix-order"), sums={"__upto": F.col("__size")})
    met = salted(ordered, targets(ordered.select("source", "__size")), ["source"], by=["__row"])
    met = met.withColumn("__start", F.col("__upto") - F.col("__size") - F.col("__base"))
    # Words of pass p up to a point of the stream: the rounded target less what comes before, between 0 and the size.
    goal = F.floor(F.col("target") + 0.5).cast("long")
    taken = lambda p: F.greatest(F.lit(0), F.least(F.col("__size"), goal - p * F.col("source_size") - F.col("__start")))
    met = met.withColumn("taken", sum((taken(p) for p in range(1, MOST)), taken(0)).cast("long"))
    return met.withColumn("position", position(0)).drop("__upto", "__base", BLOCK, PLACE)


def position(pass_: int | Column):
    """Training position of a document's middle word in the given pass: the inverse of its source's integrated schedule.

    With weight(t) = mean * (1 + slope * (1 - 2 t)) the demand until t is mean * ((1 + slope) t - slope t^2).
    """
    middle = F.col("__start") + pass_ * F.col("source_size") + F.col("__size") / 2
    share = F.least(F.lit(1.0), middle / F.nullif(F.col("target"), F.lit(0.0)))
    up = 1 + F.col("slope")
    inverse = F.when(F.col("slope") == 0, share).otherwise((up - F.sqrt(F.greatest(F.lit(0.0), up * up - 4 * F.col("slope") * share))) / F.nullif(2 * F.col("slope"), F.lit(0.0)))
    return F.when(F.col("taken") > 0, inverse)


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(sized(docs).drop("text"))
    second = F.when(F.col("taken") > F.col("__size"), position(1))
    placed = mixed.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken", F.round("position", 6).alias("position"), F.round(second, 6).alias("second_position"))
    # Staged, so that the sample behind the range exchange does not mix twice.
    return stage(placed, "mixed").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def curriculum(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as it is taken (a part of a pass counts as a whole one), each pass at its own position."""
    # Keys are mixed alone and meet the documents by row number. A document travels as one column, so that its own names clash with none of the mix.
    keys = mix(sized(docs.select("doc_id", "text", "source")).drop("doc_id", "text")).where("taken > 0")
    passes = F.ceil(F.col("taken") / F.col("__size")).cast("int")
    keys = stage(keys.select("__row", "__start", "__size", "source_size", "target", "slope", "taken", passes.alias("__passes")), "mixed")
    met = docs.select(F.struct("*").alias("__doc"), F.monotonically_increasing_id().alias("__row")).join(keys, "__row")
    repeated = met.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.col("__passes") - 1))).withColumn("position", position(F.col("__pass")))
    return repeated.repartitionByRange("position", "__pass").sortWithinPartitions("position", "__pass").select("__doc.*")


_INVERSE = "CASE WHEN slope = 0 THEN {share} ELSE ((1 + slope) - sqrt(greatest(0.0, (1 + slope) * (1 + slope) - 4 * slope * {share}))) / (2 * slope) END"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, md5(coalesce(text, '')) AS t FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
i AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS i FROM g),
w AS (SELECT *, CASE i WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, CASE i WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5 ELSE 0.0 END AS slope FROM i),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT *, max(CASE WHEN level * weight <= 2 * source_size THEN level END) OVER () AS water FROM l),
r AS (SELECT source, source_size, slope, round(least(2.0 * source_size, coalesce(water, 1e300) * weight), 6) AS target FROM a),
s AS (SELECT d.*, source_size, slope, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)) AS taken,
  least(1.0, (start + size / 2) / nullif(target, 0)) AS share, least(1.0, (start + source_size + size / 2) / nullif(target, 0)) AS share2 FROM s)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  round(CASE WHEN taken > 0 THEN {_INVERSE.format(share="share")} END, 6) AS position, round(CASE WHEN taken > size THEN {_INVERSE.format(share="share2")} END, 6) AS second_position FROM k
"""
