"""Column -> Column text functions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import entities
from docspark.functions.profiles import ARABIC, ARABIC_DIGITS, HONORIFICS, SIGLA, UNICODE, TextProfile

MARKER = "\\(([\u0660-\u06690-9]+)\\)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape(c: str | Column) -> Column:
    """Character references decoded, each once."""
    return entities.unescape(_col(c))


def normalise(c: str | Column, profile: TextProfile = ARABIC) -> Column:
    """Entities, tags, marks, folds, kept characters, single blanks, trimmed; the order matters."""
    out = _col(c)
    if profile.markup:
        out = F.regexp_replace(unescape(out), "<[^>]+>", " ")
    if profile.marks:
        out = F.regexp_replace(out, f"[{profile.marks}]", "")
    if profile.fold[0]:
        out = F.translate(out, *profile.fold)
    if profile.name == "unicode":
        out = F.lower(out)
    return F.trim(F.regexp_replace(out, f"[^{profile.keep}]+", " "))


def trimmed(c: str | Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(c), "^\\s+|\\s+$", "")


def strip_marks(c: str | Column, profile: TextProfile = ARABIC) -> Column:
    return F.regexp_replace(_col(c), f"[{profile.marks}]", "")


def stem(word: str | Column, profile: TextProfile = ARABIC) -> Column:
    """The first prefix that leaves two characters goes, then the article again if two characters stay."""
    out = _col(word)
    if profile.prefixes:
        out = F.regexp_replace(out, f"^(?:{'|'.join(profile.prefixes)})(.{{2,}})$", "$1")
    if profile.second_article:
        out = F.regexp_replace(out, f"^{profile.article}(.{{2,}})$", "$1")
    return out


def word_list(c: str | Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.filter(F.split(_col(c), " "), lambda w: w != "")


def _questions(profile: TextProfile) -> Column:
    return F.transform(word_list(normalise(F.lit(profile.question_words), profile)), lambda w: stem(w, profile))


def tokens(c: str | Column, profile: TextProfile = ARABIC, query: bool = False) -> Column:
    """Stems of two characters or more; a query loses its question words but keeps repeats."""
    out = F.transform(word_list(normalise(c, profile)), lambda w: stem(w, profile))
    if query:
        asked = _questions(profile)
        out = F.filter(out, lambda w: ~F.array_contains(asked, w))
    return F.filter(out, lambda w: F.length(w) > 1)


def key_terms(c: str | Column, profile: TextProfile = ARABIC) -> Column:
    """Normalised words whose stem asks nothing."""
    asked = _questions(profile)
    return F.filter(word_list(normalise(c, profile)), lambda w: ~F.array_contains(asked, stem(w, profile)))


def content_words(c: str | Column, profile: TextProfile = ARABIC, limit: int = 3) -> Column:
    """Words of three letters or more that ask nothing, or none at all if there are more than ``limit``."""
    found = F.filter(key_terms(c, profile), lambda w: F.length(w) >= 3)
    return F.when(F.size(found).between(1, limit), found).otherwise(F.array().cast("array<string>"))


def match_key(word: str | Column, profile: TextProfile = ARABIC) -> Column:
    return stem(normalise(word, profile), profile)


def split_page(c: str | Column) -> Column:
    """struct(body, notes): cut at the first line of five underscores or more."""
    parts = F.split(_col(c), "\n_{5,}\n", 2)
    return F.struct(unescape(F.get(parts, F.lit(0))).alias("body"), unescape(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("notes"))


def split_notes(c: str | Column, skip_blank: bool = True) -> Column:
    """map number -> note text of a notes block; lines without a number continue the note before (0: none yet); a repeated number starts anew."""
    sql_lines = F.split(_col(c), "\n", -1)
    lines = F.filter(sql_lines, lambda line: F.trim(line) != "") if skip_blank else sql_lines
    number = lambda line: F.regexp_extract(line, f"^\\s*{MARKER}", 1)
    start = F.struct(F.create_map().cast("map<int,string>").alias("notes"), F.lit(0).alias("at"))

    def step(state: Column, line: Column) -> Column:
        found = number(line)
        numbered = found != ""
        at = F.when(numbered, F.translate(F.when(numbered, found).otherwise("0"), *ARABIC_DIGITS).cast("int")).otherwise(state["at"])
        text = F.trim(F.regexp_replace(line, f"^\\s*{MARKER}\\s*", ""))
        before = F.when(numbered, F.lit(None).cast("string")).otherwise(F.element_at(state["notes"], at))
        rest = F.map_filter(state["notes"], lambda k, _: k != at)
        return F.struct(F.map_concat(rest, F.create_map(at, F.concat_ws("\n", before, text))).alias("notes"), at.alias("at"))

    return F.aggregate(lines, start, step, lambda s: s["notes"])


def strip_markup(c: str | Column) -> Column:
    """Title spans go with their content, other tags become blanks."""
    no_titles = F.regexp_replace(_col(c), '(?s)<span[^>]*data-type="?title"?[^>]*>.*?</span>', " ")
    return F.regexp_replace(no_titles, "<[^>]+>", " ")


def expand_honorifics(c: str | Column, ligatures: dict[str, str] | None = None) -> Column:
    out = _col(c)
    for sign, words in (ligatures or HONORIFICS).items():
        out = F.replace(out, F.lit(sign), F.lit(f" {words} "))
    return F.regexp_replace(out, "[ \t]+", " ")


def speakable(c: str | Column) -> Column:
    """Text to be read aloud: no markup, ligatures in words, no note marks, sigla, brackets or quotes."""
    out = expand_honorifics(strip_markup(c))
    out = F.regexp_replace(out, MARKER, " ")
    out = F.regexp_replace(out, f"\\[\\s*[{SIGLA}]\\s*\\]", " ")
    out = F.regexp_replace(out, "[«»\"\\[\\]{}﴿﴾()*_=]", " ")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def ascii_digits(c: str | Column) -> Column:
    return F.translate(_col(c), *ARABIC_DIGITS)


def local_digits(c: str | Column) -> Column:
    return F.translate(_col(c), ARABIC_DIGITS[1] + ".%", ARABIC_DIGITS[0] + "٫٪")


def guard_brackets(c: str | Column, opening: str = "﴿", closing: str = "﴾") -> Column:
    """Round brackets between the two marks become square ones."""
    parts = F.split(_col(c), opening, -1)
    inside = lambda p: F.concat(F.translate(F.substring_index(p, closing, 1), "()", "[]"), F.substr(p, F.length(F.substring_index(p, closing, 1)) + 1))
    return F.array_join(F.transform(parts, lambda p, i: F.when((i == 0) | ~F.contains(p, F.lit(closing)), p).otherwise(inside(p))), opening)


def bracketed(c: str | Column) -> Column:
    """Contents of round brackets that are no mere number."""
    return F.filter(F.regexp_extract_all(_col(c), F.lit("\\(([^()]*)\\)"), F.lit(1)), lambda s: ~s.rlike("^\\s*[\u0660-\u06690-9]*\\s*$"))


def first_match(c: str | Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first pattern found, in order: heading, note and book classifiers are lists of such rules."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(_col(c).rlike(pattern), label).otherwise(out)
    return out


def all_matches(c: str | Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


def glosses(c: str | Column, rules: list[tuple[str, str, str]]) -> Column:
    """array of struct(word, definition, kind): each rule is (pattern with two groups, label before the definition, kind)."""
    of = lambda r: F.transform(
        F.arrays_zip(all_matches(c, r[0], 1).alias("w"), all_matches(c, r[0], 2).alias("d")),
        lambda x: F.struct(x["w"].alias("word"), F.concat(F.lit(r[1]), F.trim(F.substring(x["d"], 1, 300))).alias("definition"), F.lit(r[2]).alias("kind")),
    )
    return F.concat(*map(of, rules))


def mentions(quote: str | Column, word: str | Column, prefixes: str = "", suffixes: str = "") -> Column:
    """Whether the quote holds the word without one prefix and suffix (three letters stay), or its first three letters if it has four."""
    bare = _col(word)
    if prefixes:
        bare = F.regexp_replace(bare, f"^(?:{prefixes})(.{{3,}})$", "$1")
    if suffixes:
        bare = F.regexp_replace(bare, f"^(.{{3,}}?)(?:{suffixes})$", "$1")
    return F.contains(_col(quote), bare) | ((F.length(bare) >= 4) & F.contains(_col(quote), F.substring(bare, 1, 3)))


def link(base: str, *parts: str | Column) -> Column:
    return F.concat(F.lit(base), F.concat_ws("/", *[_col(p).cast("string") for p in parts]))


def search_link(base: str, c: str | Column, words: int = 8) -> Column:
    """Link that searches for the last words of a text."""
    listed = word_list(F.regexp_replace(_col(c), "\\s+", " "))
    return F.concat(F.lit(base), F.url_encode(F.array_join(F.slice(listed, F.greatest(F.lit(1), F.size(listed) - words + 1), words), " ")))


def strip_labels(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "\\s*[\\[(]\\s*P\\d+\\s*[\\])]\\s*", " ")


def label_number(c: str | Column) -> Column:
    digits = F.regexp_extract(ascii_digits(c), "(\\d+)", 1)
    return F.when(digits != "", digits).cast("int")


def quote_context(text: str | Column, quote: str | Column, around: int = 220, probe: int = 30) -> Column:
    """The text around the first characters of the quote; its beginning if they do not occur."""
    at = F.instr(_col(text), F.substring(_col(quote), 1, probe))
    begin = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substr(_col(text), begin, at + around - begin)).otherwise(F.substring(_col(text), 1, 2 * around))


def similarity(a: str | Column, b: str | Column) -> Column:
    """1 - edit distance / longer length; 1 for equal texts, 0 if one is empty."""
    a, b = _col(a), _col(b)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def content_id(c: str | Column) -> Column:
    return F.substring(F.sha1(_col(c)), 1, 8)


def highlight_pattern(c: str | Column, profile: TextProfile = ARABIC) -> Column:
    """Pattern that finds a text without marks inside one with marks."""
    letters = F.split(normalise(c, profile), "")
    return F.array_join(F.transform(F.filter(letters, lambda x: x != ""), lambda x: F.concat(x, F.lit(f"[{profile.marks}]*"))), "")


def escape_html(c: str | Column) -> Column:
    out = _col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def clean_user(c: str | Column) -> Column:
    """A transcript's user text: system tags go with their content, pasted content is marked."""
    out = F.regexp_replace(_col(c), "(?s)<(system-[a-z-]+)>.*?</\\1>", "")
    return F.trim(F.regexp_replace(out, "(?s)<pasted[^>]*>.*?</pasted>", "[pasted content]"))


def tool_line(name: str | Column, detail: str | Column) -> Column:
    """One line for a tool call; without a detail its name alone."""
    return F.concat(F.lit("- "), F.concat_ws(": ", F.coalesce(_col(name), F.lit("tool")), F.nullif(F.trim(_col(detail)), F.lit(""))))


def question(c: str | Column, most: int = 500) -> Column:
    """A question as it is taken in: trimmed, of bounded length, empty for null."""
    return F.substring(F.trim(F.coalesce(_col(c), F.lit(""))), 1, most)


def display_words(c: str | Column) -> Column:
    """Words to show: parted at white space, those of signs alone dropped."""
    return F.filter(F.split(F.trim(_col(c)), "\\s+"), lambda w: w.rlike("[\\p{L}\\p{N}]"))


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(_col(url), "^[a-z]+://([^/:?#]+)", 1))


def number(c: str | Column) -> Column:
    """'' and None: null; True and False: 1 and 0; else the number, null if it is none."""
    c = _col(c)
    return F.when(c == "True", 1.0).when(c == "False", 0.0).otherwise(c.try_cast("double"))


def cost(tokens_in: str | Column, tokens_out: str | Column, price_in: str | Column, price_out: str | Column) -> Column:
    """Price of a call at prices a million tokens; null without prices."""
    return F.round((_col(tokens_in) * _col(price_in) + _col(tokens_out) * _col(price_out)) / 1e6, 6)
