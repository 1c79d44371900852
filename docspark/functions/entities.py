"""Character references of HTML, decoded in one native pass.

The text is split where a reference may stand, each reference is looked up on its own, and the parts are
joined again, so nothing is decoded twice. Names are those of the standard library's HTML 5 table: the
whole name, else its longest known beginning ("&notit;" is a sign for "not", then "it;"). Numbers follow the
same rules as browsers: the range 128 to 159 is read as Windows-1252, impossible ones
become the replacement character, forbidden ones nothing.
"""

from __future__ import annotations

import json
import zlib
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
#: A lookup compares a name with those of its bucket only.
BUCKETS = 128
#: Letters of the longest name that needs no semicolon.
BARE = max(len(n) for n in html5 if not n.endswith(";"))


@cache
def _names() -> str:
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, char in html5.items():
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = char
    return json.dumps(buckets)


@cache
def _windows() -> str:
    """What browsers read for 0, 13 and 128 to 159."""
    of = lambda n: bytes([n]).decode("cp1252", "ignore") or chr(n)
    return json.dumps({0: "�", 13: "\r"} | {n: of(n) for n in range(128, 160)})


def _named(name: Column) -> Column:
    table = F.from_json(F.lit(_names()), "array<map<string,string>>")
    return F.try_element_at(F.get(table, F.pmod(F.crc32(name.cast("binary")), F.lit(BUCKETS)).cast("int")), name)


def _character(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _number(body: Column) -> Column:
    """``body``: a reference's text from # on."""
    hexed = F.substring(body, 2, 1).isin("x", "X")
    digits = F.regexp_replace(F.rtrim(body, F.lit(";")), "^#[xX]?0*", "")
    # More than eight digits are beyond any character, whatever the base.
    n = F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).when(digits == "", F.lit(0).cast("long")).when(hexed, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    odd = F.try_element_at(F.from_json(F.lit(_windows()), "map<string,string>"), n.cast("string"))
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(odd.isNotNull(), odd).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(none, "").otherwise(_character(n))


def _decoded(reference: Column) -> Column:
    body = F.substring(reference, 2, 64)
    number = F.when(body.startswith("#"), F.regexp_extract(reference, "^&(.*)$", 1))
    beginnings = [F.when(F.length(body) > k, F.concat(_named(F.substring(body, 1, k)), F.substring(body, k + 1, 64))) for k in range(BARE, 1, -1)]
    return F.when(number.isNotNull(), _number(number)).otherwise(F.coalesce(_named(body), *beginnings, reference))


def unescape(c: Column) -> Column:
    """Text with every character reference decoded once. Null stays null."""
    between, found = F.split(c, REFERENCE, -1), F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    whole = F.array_join(F.zip_with(between, F.transform(found, _decoded), lambda text, char: F.concat(text, F.coalesce(char, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def oracle(c: str) -> str:
    """The same rule as an expression of DuckDB over its own functions."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in html5.items()) + "}"
    windows = "MAP {" + ", ".join(f"{n}: {quoted(v)}" for n, v in json.loads(_windows()).items() if n != "0") + "}"
    digits = "regexp_replace(rtrim(r, ';'), '^&#[xX]?0*', '')"
    n = f"CASE WHEN length({digits}) > 8 THEN 1114112 WHEN {digits} = '' THEN 0 WHEN lower(r[3]) = 'x' THEN CAST('0x' || {digits} AS BIGINT) ELSE CAST({digits} AS BIGINT) END"
    char = f"""list_transform([{n}], lambda n: CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN ({windows})[n] IS NOT NULL THEN ({windows})[n]
      WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534 THEN '' ELSE chr(CAST(n AS INT)) END)[1]"""
    begun = ", ".join(f"CASE WHEN length(r) > {k + 1} THEN names[r[2:{k + 1}]] || r[{k + 2}:] END" for k in range(BARE, 1, -1))
    one = f"CASE WHEN r[2] = '#' THEN {char} ELSE coalesce(names[r[2:]], {begun}, r) END"
    pattern = quoted(REFERENCE.replace("\\\\", "\\"))
    return f"""(SELECT array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(found[i], '')), '') FROM (SELECT string_split_regex(x, {pattern}) AS parts,
      list_transform(regexp_extract_all(x, {pattern}), lambda r: {one}) AS found FROM (SELECT {c} AS x, {names} AS names)))"""
