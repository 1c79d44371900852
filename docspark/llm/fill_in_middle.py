"""Fill-in-the-middle transformation: a text is cut in three and rewritten so that its middle comes last.

The kernel works on Arrow's UTF-8 buffers, all rows of a slice together and without
decoding: a table maps every byte to its class; a mask over neighbouring bytes marks
where units begin (a text's first byte, or one after a line feed); cumulative sums of the mask, reset
at each text by what they held before it, number the units; ``searchsorted`` finds the
bytes at which all rows' prefixes and middles end. Pieces are copied as bytes.

Where to cut and which form to take follow from the hex SHA-256 of ``seed:doc_id``:
its first four groups of eight digits are h1 to h4. The prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text stays plain if h3 % 100 is
``fim_rate`` or more, if it is empty or if it holds a sentinel; otherwise it is spm if
h4 % 100 is below ``spm_rate``, else psm:

    psm  <P>prefix<S>suffix<M>middle        spm  <S>suffix<P>prefix<M>middle

``restore`` gives the text back from output and form alone.

There is no shuffle. A slice holds ``slice_bytes`` of text, or one longer text, and takes some ten
times its size while it is worked on.

Defined cases: a null text counts as empty and stays plain with n = 0; a null doc_id hashes as
the empty string; repeated rows give repeated results; of further columns those named in ``keep`` come
along (a name that the result has itself is refused), the others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table, text_or_empty

SEED, FIM_RATE, SPM_RATE, SLICE_BYTES = 7, 100, 50, 1 << 22
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = np.array(["plain", "psm", "spm"])
OUTPUT = "n long, form string, prefix_chars long, middle_chars long, output string"
_FEED, _OPEN, _LETTER, _CLOSE, _INNER = 1, 2, 3, 4, 5


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[0x80:0xC0] = _INNER  # a byte inside a character
    out[ord("\n")], out[ord("<")], out[ord(">")] = _FEED, _OPEN, _CLOSE
    out[[ord(c) for c in "PSM"]] = _LETTER
    return out


CLASS_OF = _byte_classes()


def cut(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, fim_rate: int, spm_rate: int) -> tuple[np.ndarray, ...]:
    """n, form (number in FORMS), and the bytes at which prefix and middle end, of texts data[offsets[i]:offsets[i + 1]].

    ``h``: (4, rows). Of a plain text the two ends are its end.
    """
    begins, ends = offsets[:-1], offsets[1:]
    kinds = CLASS_OF[data]
    first = np.zeros(len(data) + 1, bool)
    first[1:] = np.r_[kinds == _FEED]
    first[begins] = True  # an empty text's mark is the next one's, or behind the data
    first = first[:-1]
    count = np.zeros(len(data) + 1, np.int64 if len(data) >= 1 << 31 else np.int32)
    np.cumsum(first, out=count[1:])
    before = count[begins].astype(np.int64)
    n = count[ends] - before
    sentinel = (kinds[:-2] == _OPEN) & (kinds[1:-1] == _LETTER) & (kinds[2:] == _CLOSE)
    at = np.flatnonzero(sentinel)
    held = np.searchsorted(at, np.maximum(ends - 2, begins)) > np.searchsorted(at, begins)
    plain = (n == 0) | held | (h[2] % 100 >= fim_rate)
    form = np.where(plain, 0, np.where(h[3] % 100 < spm_rate, 2, 1))
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    # Unit k of a text begins where the running count first reaches before + k + 1; unit n would begin at the text's end.
    where = lambda k: np.where(k < n, np.searchsorted(count[1:], before + k + 1), ends)
    return n, form, np.where(plain, ends, where(np.minimum(one, two))), np.where(plain, ends, where(np.maximum(one, two)))


def characters(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each data[begins[i]:ends[i]]."""
    if not len(begins):
        return np.zeros(0, np.int64)
    whole = np.r_[CLASS_OF[data] != _INNER, False]
    sums = np.add.reduceat(whole, np.stack([begins, ends], 1).ravel(), dtype=np.int64)[::2]
    return np.where(ends > begins, sums, 0)


def rewrite(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, cut1: np.ndarray, cut2: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of all outputs, and their offsets."""
    view, p, s, m = memoryview(data), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    parts: list = []
    for kind, a, b, c, d in zip(form.tolist(), offsets[:-1].tolist(), cut1.tolist(), cut2.tolist(), offsets[1:].tolist()):
        if kind == 0:
            parts.append(view[a:d])
        elif kind == 1:
            parts += [p, view[a:b], s, view[c:d], m, view[b:c]]
        else:
            parts += [s, view[c:d], p, view[a:b], m, view[b:c]]
    sizes = np.diff(offsets) + np.where(form > 0, len(p) + len(s) + len(m), 0)
    return b"".join(parts), np.r_[0, np.cumsum(sizes)]


def _buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, at, data = text.buffers()
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, keep: tuple[str, ...] = ("doc_id",), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The columns of ``keep`` with n, form, prefix_chars, middle_chars (null where plain) and output of every whole text."""
    own = {x.split()[0] for x in OUTPUT.split(", ")}
    if clash := own & set(keep):
        raise ValueError(f"the result has columns of its own named {sorted(clash)}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k}") for k in range(4)]
    rows = docs.select(*keep, *h, text_or_empty("text").alias("__text"))

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _buffers(batch.column("__text"))
            for first, last in _slices(offsets, slice_bytes):
                part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                mine = batch.slice(first, last - first)
                hs = np.stack([mine.column(f"__h{k}").to_numpy(zero_copy_only=False) for k in range(4)])
                n, form, one, two = cut(part, at, hs, fim_rate, spm_rate)
                text, out_at = rewrite(part, at, form, one, two)
                kind, width = (pa.large_string(), np.int64) if pa.types.is_large_string(batch.column("__text").type) else (pa.string(), np.int32)
                output = pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(out_at.astype(width)), pa.py_buffer(text)])
                counts = [pa.array(characters(part, a, b), pa.int64(), mask=form == 0) for a, b in ((at[:-1], one), (one, two))]
                columns = [*(mine.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(FORMS[form].tolist(), kind), *counts, output]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n", "form", "prefix_chars", "middle_chars", "output"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(transformed, f"{kept}, {OUTPUT}" if keep else OUTPUT)


def restore(output: str | Column, form: str | Column) -> Column:
    """The exact text, from output and form."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)  # "", then three pieces
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed(F.col("output")).alias("output_sha256"), hexed(restore("output", "form")).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS ls, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, len(ls) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b FROM l),
p AS (SELECT *, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a + 1:b], '') AS mid, array_to_string(ls[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
