"""Readers with explicit schemas, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOOK = "pages array<struct<text:string,vol:string,page:string>>"
BOOK_META = "indexes struct<headings:array<struct<title:string,level:int,page:int>>,page_map:array<string>>"
ITEMS = "id string, category string, question string, expected_scope string, expected_status string, gold array<array<int>>, gold_notes string, premise_false boolean, critical boolean, chapter string, source string, reviewed string"
TRANSCRIPT = "type string, timestamp string, message struct<role:string,content:string>"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, pg, vol, page, text): one row a page, pg its place in the file from 1; the book id is the file's number."""
    files = spark.read.schema(BOOK).option("multiLine", True).option("allowUnescapedControlChars", True).json(path)
    pages = files.select(F.regexp_extract(F.col("_metadata.file_name"), "(\\d+)", 1).cast("int").alias("book_id"), F.posexplode("pages").alias("i", "p"))
    return pages.select("book_id", (F.col("i") + 1).alias("pg"), "p.vol", F.col("p.page").try_cast("int").alias("page"), "p.text")


def read_headings(spark: SparkSession, path: str, level: int = 2, last_page: int = 80) -> DataFrame:
    """(book_id, seq, title, page) of the contents down to a level and page."""
    files = spark.read.schema(BOOK_META).option("multiLine", True).option("allowUnescapedControlChars", True).json(path)
    rows = files.select(F.regexp_extract(F.col("_metadata.file_name"), "(\\d+)", 1).cast("int").alias("book_id"), F.posexplode("indexes.headings").alias("seq", "h"))
    return rows.where((F.col("h.level") <= level) & (F.col("h.page") <= last_page)).select("book_id", "seq", "h.title", "h.page")


def contents_text(headings: DataFrame) -> DataFrame:
    """(book_id, toc): the contents as one text, in order."""
    line = F.format_string("%s (%d)", "title", "page")
    return headings.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("toc"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines give none."""
    return spark.read.schema(schema).json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    gold = F.transform("gold", lambda g: F.struct(g[0].alias("book_id"), g[1].alias("page")))
    return read_jsonl(spark, path, ITEMS).withColumn("gold", gold)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; columns by position, a byte order mark is no part of the first name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)


def read_runs(spark: SparkSession, pattern: str, schema: str, kind: str = "scored") -> DataFrame:
    """Rows of all run files with system and run read from the names <kind>_<system>_run<k>."""
    names = F.col("_metadata.file_name")
    reader = spark.read.schema(schema)
    rows = reader.json(pattern) if pattern.endswith("l") else reader.option("header", True).csv(pattern)
    return rows.select("*", F.regexp_extract(names, f"{kind}_(.+)_run(\\d+)", 1).alias("system"), F.regexp_extract(names, f"{kind}_(.+)_run(\\d+)", 2).cast("int").alias("run"))


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """(seq-ordered) messages of users and assistants; content that is an array of blocks is reduced to its texts."""
    raw = spark.read.schema(TRANSCRIPT).json(path).where("type in ('user', 'assistant')")
    content = F.col("message.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string,name:string>>")
    texts = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    tools = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: b["name"])
    return raw.select("timestamp", F.col("message.role").alias("role"), F.when(content.startswith("["), texts).otherwise(content).alias("text"), F.coalesce(tools, F.array().cast("array<string>")).alias("tools"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def parse_sse(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(…, seq, event, data) of server-sent events: blocks split at blank lines."""
    blocks = bodies.select(*[c for c in bodies.columns if c != body], F.posexplode(F.split(body, "\r?\n\r?\n")).alias("seq", "block"))
    event, data = F.regexp_extract("block", "(?m)^event: ?(.*)$", 1), F.array_join(F.regexp_extract_all("block", F.lit("(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    return blocks.select(*[c for c in blocks.columns if c != "block"], event.alias("event"), data.alias("data")).where("event <> '' or data <> ''")


def env_map(text: str) -> dict[str, str]:
    """'short:low,long:high' as a mapping."""
    return dict(p.split(":", 1) for p in text.split(",") if ":" in p)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines with the time of writing."""
    rows.withColumn("t", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").json(path)


def write_runs(scored: DataFrame, path: str) -> None:
    scored.write.mode("overwrite").partitionBy("system", "run").option("header", True).csv(path)


def markdown_rows(summary: DataFrame, first: str, columns: list[str], digits: int = 2) -> DataFrame:
    """(line) of a Markdown table body; a missing value is a dash."""
    cells = [F.coalesce(F.format_number(F.col(c), digits), F.lit("–")) for c in columns]
    return summary.select(first, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(first), *cells), F.lit(" |")).alias("line"))


def to_sse(events: DataFrame) -> DataFrame:
    """(…, frame): an event stream's frames, data as JSON."""
    return events.withColumn("frame", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.to_json("data"), F.lit("\n\n")))


def whitelist(rows: DataFrame, keys: list[str], most: int = 2000) -> DataFrame:
    """Only the named columns, as texts of bounded length."""
    return rows.select(*[F.substring(F.col(k).cast("string"), 1, most).alias(k) for k in keys])


# --------------------------------------------------------- tables of a library
def write_pages(pages: DataFrame, path: str) -> None:
    """Pages in one folder a book, so that a book's or a range's scan reads that book alone."""
    pages.write.mode("overwrite").partitionBy("book_id").parquet(path)


def pages_between(spark: SparkSession, path: str, book_id: int, low: int, high: int) -> DataFrame:
    """Pages low to high of a book: the book prunes folders, the range is pushed into the scan."""
    return spark.read.parquet(path).where((F.col("book_id") == book_id) & F.col("pg").between(low, high))


def page(spark: SparkSession, path: str, book_id: int, pg: int) -> DataFrame:
    return pages_between(spark, path, book_id, pg, pg)


def read_page_files(spark: SparkSession, pattern: str, meta: str = "vol string, page int, headings array<string>") -> DataFrame:
    """(pg, text, meta): one file a page, its number from the file's name; meta may be a JSON text inside the JSON."""
    raw = spark.read.schema("text string, meta string").option("multiLine", True).json(pattern)
    pg = F.regexp_extract(F.col("_metadata.file_name"), "(\\d+)", 1).cast("int")
    return raw.select(pg.alias("pg"), "text", F.from_json("meta", meta).alias("meta"))


def write_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def requests(bodies: DataFrame, body: str = "body", depths: tuple[str, ...] = ("short", "normal", "long"), default: str = "normal", most: int = 500) -> DataFrame:
    """Request bodies with question (trimmed, at most ``most`` characters) and depth (one of ``depths``, else the default); a body that is no JSON asks nothing."""
    parsed = F.from_json(body, "question string, depth string")
    asked = F.substring(F.trim(F.coalesce(parsed["question"], F.lit(""))), 1, most)
    return bodies.withColumns({"question": asked, "depth": F.when(parsed["depth"].isin(*depths), parsed["depth"]).otherwise(default)})


def read_key(store: DataFrame, keys: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """keys with their stored value, or the default."""
    return keys.join(store.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def assembled(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of several sources with the columns of any, told apart by ``source``."""
    named = [df.withColumn("source", F.lit(n)) for n, df in sources.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def good_answers(answers: DataFrame) -> DataFrame:
    """Answers worth keeping: not from the cache, not a mere search, with sentences or a refusal."""
    return answers.where("not coalesce(cached, false) and not coalesce(search_only, false) and (coalesce(n_sentences, 0) > 0 or coalesce(refused, false))")


def append_new(rows: DataFrame, path: str, on: list[str]) -> int:
    """Append the rows whose key the table lacks; a second call with the same rows adds none. The number of rows added."""
    from docspark.plans.staging import stage

    done = read_or_empty(rows.sparkSession, path, rows.schema)
    new = stage(rows.dropDuplicates(on).join(done.select(*on), on, "left_anti").select(*rows.columns), "append")
    new.write.mode("append").parquet(path)
    return new.count()


def write_json(rows: DataFrame, path: str) -> None:
    """A run's configuration or summary: few rows, JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def percent(c: str, digits: int = 0):
    return F.coalesce(F.concat(F.format_number(100 * F.col(c), digits), F.lit("%")), F.lit("–"))


def mean_and_range(mean: str, least: str, most: str, digits: int = 2):
    """'mean (least–most)'; the range is left out where all agree, a missing mean is a dash."""
    number = lambda c: F.format_number(F.col(c), digits)
    spread = F.when(F.col(least) == F.col(most), "").otherwise(F.concat(F.lit(" ("), number(least), F.lit("–"), number(most), F.lit(")")))
    return F.coalesce(F.concat(number(mean), spread), F.lit("–"))


def write_label_sheet(rows: DataFrame, path: str) -> None:
    """CSV for people: a byte order mark before the first name, so that spreadsheets read UTF-8."""
    first, *rest = rows.columns
    rows.select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def notebook_markdown(notes: DataFrame, by: str = "chapter") -> DataFrame:
    """(by, markdown) of a reader's notes (seq, word, note), one section a group."""
    line = F.concat(F.lit("- **"), "word", F.lit("**: "), F.coalesce("note", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    body = F.array_join(F.transform(listed, lambda x: x["line"]), "\n")
    return notes.groupBy(by).agg(F.concat(F.lit("## "), F.first(by), F.lit("\n"), body).alias("markdown"))


def transcript_blocks(lines: DataFrame, by: str, order: str) -> DataFrame:
    """(by, block, role, text, tools): messages with the tool calls since the message before folded into them.

    lines: kind (message or tool), role, text. Tool calls after the last message are a block of their own.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    message = F.col("kind") == "message"
    numbered = lines.withColumn("block", F.coalesce(F.count_if(message).over(w), F.lit(0)))
    tools = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~message, F.struct(order, "text")))), lambda x: x["text"]), "\n")
    return numbered.groupBy(by, "block").agg(F.max(F.when(message, F.col("role"))).alias("role"), F.max(F.when(message, F.col("text"))).alias("text"), tools.alias("tools"))
