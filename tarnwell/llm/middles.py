"""Fill-in-the-middle transformation of texts, cut by run-length encoded character classes.

A class is a width in UTF-8: characters of one to four bytes. Texts are stored as their maximal runs of one class,
each with the number of units (code points) and bytes before it. A cut at a unit is found by binary search for
the run that holds it; its byte follows by arithmetic, as all units of a run are equally wide. All texts of a
slice are encoded as one stream, so one search finds all their cuts.

Edge cases: null and empty texts are plain and empty; whole texts are cut, however long, and runs are made
a megabyte at a time; a null id draws like an empty one; repeated rows (ties) give equal rows; an empty table gives
an empty result; a text that holds a mark stays plain, so that outputs can always be restored; extra columns are
ignored and their names never clash, as only the id and the text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import raw_bytes, slices, table

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")

#: Bytes of a character, by its first byte; 0 for bytes that continue one.
_WIDTH = np.repeat(np.array([1, 0, 2, 3, 4], dtype=np.uint8), [0x80, 0x40, 0x20, 0x10, 0x10])


class ClassRuns:
    """Maximal runs of characters of one width, with the units and bytes before each run."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        buffer, found, self.units = np.frombuffer(data, dtype=np.uint8), [], 0
        last = 0
        for first in range(0, len(buffer), piece):
            width = _WIDTH[buffer[first : first + piece]]
            lead = np.flatnonzero(width)
            width = width[lead]
            new = np.flatnonzero(np.diff(width, prepend=np.uint8(last)) != 0)
            found.append((self.units + new, first + lead[new], width[new]))
            self.units += len(lead)
            last = width[-1] if len(width) else last
        self.unit, self.byte, self.width = (np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def byte_of(self, unit: np.ndarray) -> np.ndarray:
        """Where units begin, the end of the data for the number of all units."""
        if not len(self.unit):
            return np.zeros_like(unit)
        run = np.searchsorted(self.unit, unit, "right") - 1
        return self.byte[run] + (unit - self.unit[run]) * self.width[run]

    def unit_of(self, byte: np.ndarray) -> np.ndarray:
        """The unit that begins at each byte."""
        if not len(self.unit):
            return np.zeros_like(byte)
        run = np.searchsorted(self.byte, byte, "right") - 1
        return self.unit[run] + (byte - self.byte[run]) // self.width[run]


def draws(id_: Column) -> list[Column]:
    """Four numbers below 2^32 from the id: the first groups of eight digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _cut(texts: list[bytes], h: np.ndarray, marks: tuple[bytes, ...], share: int, spm: int) -> tuple:
    """n, form, prefix, middle and output of texts, by their four draws h."""
    starts = np.cumsum([0] + [len(t) for t in texts])
    data = b"".join(texts)
    runs = ClassRuns(data)
    unit = runs.unit_of(starts)
    n = np.diff(unit)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    low_at, high_at = runs.byte_of(unit[:-1] + low), runs.byte_of(unit[:-1] + high)
    held = np.array([any(m in t for m in marks) for t in texts], dtype=bool)
    plain = (n == 0) | held | (h[2] % 100 >= share)
    last = ~plain & (h[3] % 100 < spm)
    p, s, m = marks
    out = []
    for k, t in enumerate(texts):
        if plain[k]:
            out.append(t)
            continue
        a, b, c = data[starts[k] : low_at[k]], data[low_at[k] : high_at[k]], data[high_at[k] : starts[k + 1]]
        out.append(b"".join((s, c, p, a, m, b) if last[k] else (p, a, s, c, m, b)))
    return n, np.where(plain, "plain", np.where(last, "spm", "psm")), low, high - low, plain, out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, share: int = 90, spm: int = 20, slice_bytes: int = 2 << 20) -> DataFrame:
    """id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every document.

    `share` of 100 documents are cut at two random units, `spm` of 100 of these put the suffix first.
    """
    kind, coded = docs.schema[id_col].dataType.simpleString(), tuple(m.encode() for m in marks)

    def work(batches):
        for batch in batches:
            texts = [t or b"" for t in raw_bytes(batch.column(1))]
            h = np.stack([batch.column(2 + k).to_numpy() for k in range(4)])
            for first, last in slices([len(t) for t in texts], slice_bytes):
                n, form, prefix, middle, plain, out = _cut(texts[first:last], h[:, first:last], coded, share, spm)
                columns = [batch.column(0).slice(first, last - first), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.large_binary()).cast(pa.large_string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col), F.col(text_col), *[d.alias(f"_h{k}") for k, d in enumerate(draws(F.col(id_col)))])
    made = rows.mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output: its parts between the marks in their old order."""
    part = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    back = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(back)


OP13_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )
