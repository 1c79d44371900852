from __future__ import annotations

import re
from itertools import groupby

import pytest

from docspark.functions.profiles import UNICODE
from docspark.operators import scan, walk

EVENTS = "book_id int, chapter string, pg int, seq int, kind string, text string"


def norm(s: str) -> str:
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


class Reader:
    """Reads the events of one book one after the other, as a reader would."""

    def __init__(self, book):
        self.book, self.paras, self.units, self.marks = book, [], [], []
        self.open = self.title = self.heading = self.chapter = None
        self.words = ""

    def event(self, kind, text, pg, chapter):
        if chapter != self.chapter:
            self.open, self.words, self.chapter = None, "", chapter
        if kind == "title":
            self.title = self.heading = text.strip("[]() ")
            self.words = ""
        elif len(norm(text)) <= 15 and not re.search("[0-9٠-٩]", text):
            self.heading = f"{self.heading} {text.strip()}" if self.heading else text.strip()
        else:
            self.paragraph(text, pg)

    def start_unit(self, pg, core, text=""):
        self.units.append({"unit": len(self.units) + 1, "chapter": self.chapter, "para": len(self.paras), "pg": pg, "core": core, "text": text})
        self.open = self.units[-1]

    def plain(self, text, pg, end=""):
        if text.strip():
            if self.open is None:
                self.start_unit(pg, "")
            self.touch()
            self.title = None
        if self.open is not None:
            self.open["text"] += text + end
        self.words += text + end

    def touch(self):
        if self.open["unit"] not in self.paras[-1]["units"]:
            self.paras[-1]["units"].append(self.open["unit"])

    def paragraph(self, text, pg):
        self.paras.append({"para": len(self.paras) + 1, "chapter": self.chapter, "pg": pg, "text": text.strip(), "heading": self.heading, "units": []})
        self.heading = None
        parts = re.split(r"(\([^()]*\))", text)
        for i, part in enumerate(parts[:-1]):
            if i % 2 == 0:
                self.plain(part, pg)
            elif re.fullmatch("[0-9٠-٩]+", part[1:-1].strip()):
                self.mark(part, pg)
            else:
                self.start_unit(pg, part[1:-1].strip(), part)
                self.touch()
                self.words, self.title = part, None
        self.plain(parts[-1], pg, "\n")

    def mark(self, part, pg):
        lemma, how = norm(self.words).split()[-12:], "text"
        if not lemma and self.title:
            lemma, how = norm(self.title).split(), "title"
        elif not lemma and self.open:
            lemma = norm(self.open["core"]).split()[-12:]
        own = self.open or {"unit": None, "pg": pg}
        self.marks.append((self.book, self.chapter, len(self.paras), pg, int(part[1:-1]), " ".join(lemma), how, own["unit"], own["pg"]))
        self.words = ""
        if self.open is not None:
            self.open["text"] += part


def brute(events):
    readers = []
    for book, rows in groupby(sorted(events, key=lambda e: (e[0], e[2], e[3])), key=lambda e: e[0]):
        readers.append(Reader(book))
        for _, chapter, pg, _, kind, text in rows:
            readers[-1].event(kind, text, pg, chapter)
    return readers


@pytest.fixture(autouse=True)
def many_blocks(spark):
    """Small ranges stay apart, so that state crosses blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(spark, events, parts=4):
    w = walk.walk(spark.createDataFrame(events, EVENTS).repartition(parts), UNICODE)
    want = brute(events)
    units = sorted((r.book, u["unit"], u["chapter"], u["para"], u["pg"], u["core"], u["text"]) for r in want for u in r.units)
    paras = sorted((r.book, p["para"], p["chapter"], p["pg"], p["text"], p["heading"], p["units"]) for r in want for p in r.paras)
    assert sorted(map(tuple, w.units.collect())) == units
    assert sorted((*r[:5], r.heading, r.units) for r in w.paragraphs.collect()) == paras
    got = sorted(((*r[:5], *r[6:]) for r in w.markers.collect()), key=str)
    assert got == sorted((m for r in want for m in r.marks), key=str)
    return w


def test_units_cross_paragraphs_and_pages(spark):
    events = [
        (1, "a", 1, 0, "title", "[Water]"),
        (1, "a", 1, 1, "line", "(1) (the pure water) is that which stays (2) as made"),
        (1, "a", 2, 0, "line", "and what follows on another page (1) with (of it)"),
        (1, "a", 2, 1, "line", "more of it here (3) (4)"),
        (1, "b", 3, 0, "title", "Vessels"),
        (1, "b", 3, 1, "line", "short line"),
        (1, "b", 3, 2, "line", "text before any core of the chapter (1)"),
        (2, "a", 1, 0, "line", "(1) a second book begins with a mark"),
        (2, "a", 1, 1, "line", "(core ٢) (٢)"),
    ]
    w = same(spark, events)
    crossing = w.markers.where("pg <> unit_pg").collect()
    assert [(r.n, r.unit_pg, r.pg) for r in crossing] == [(1, 1, 2)]
    assert w.markers.where("how = 'title'").count() == 1


@pytest.mark.parametrize("seed", range(2))
def test_random_books_equal_a_sequential_reader(spark, seed):
    import random

    rng = random.Random(seed)
    bits = ["word", "other words", " ", "(1)", "(22)", "(core text)", "( of it )", "()", "short", "and a longer run of text than that", "٣ x", "(٤)", "\t"]
    events = []
    for book in (1, 2, 3):
        for i in range(60):
            title = rng.random() < 0.15
            text = rng.choice(["[T one]", "()", "Title two"]) if title else "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
            events.append((book, "abc"[min(2, i // 20)], i // 7, i, "title" if title else "line", text))
    same(spark, events, 3)


def test_running_columns_across_blocks(spark):
    from pyspark.sql import functions as F

    rows = [(i, (i * 7) % 5, None if i % 3 else i) for i in range(200)]
    df = scan.in_order(spark.createDataFrame(rows, "i int, a int, v int").repartition(4), ["i"])
    assert df.select(scan.BLOCK).distinct().count() > 1
    got = scan.running(df, sums={"s": F.col("a")}, last={"l": F.col("v")}, before={"b": F.col("v")}).orderBy("i").collect()
    total, last = 0, None
    for r, (i, a, v) in zip(got, rows):
        total, was, last = total + a, last, v if v is not None else last
        assert (r.i, r.s, r.l, r.b) == (i, total, last, was)
    assert scan.running(scan.in_order(df.select("i", "a", "v").limit(0), ["i"]), sums={"s": F.col("a")}).collect() == []


def test_running_columns_read_no_texts(spark, monkeypatch):
    """What a block adds is summed from columns that stand there before the order is laid."""
    held, real = [], walk.in_order
    monkeypatch.setattr(walk, "in_order", lambda rows, *a: (held.append(rows.columns), real(rows, *a))[1])
    events = spark.createDataFrame([(1, "c", 1, 0, "line", "some words of text that are (1) read here 5")], EVENTS)
    assert walk.walk(events).markers.count() == 1
    assert {"__said", "__size"} <= set(held[0])
