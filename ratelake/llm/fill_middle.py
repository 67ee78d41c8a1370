"""Fill-in-middle examples by run-length class encoding.

A text is a sequence of units: a run of ASCII letters is one, any other character is one. Instead of the units
themselves, maximal runs of characters of one class are stored, the classes being letters and, for other characters,
their widths in bytes. A run keeps where it begins, in bytes and in characters, and how many units come before it. A cut
after c units is found by a binary search for the run that holds unit c; its place inside the run is arithmetic: a run of
letters can only be cut at its begin, and in any other run each unit is one character of known width. So a text is neither
split into units nor decoded, and a chunk's arrays are as long as the chunk.

The cuts and the form of a document come from a hash of the seed and its id alone, so they are the same at every run.

Defined cases: a null text is an empty one; empty texts, and texts that hold a sentinel, stay plain whatever their length;
a null ``doc_id`` is hashed like an empty string of digits; repeated rows give equal rows; an empty table gives an empty
result; other columns are carried along by ``fill_in_middle`` (and ignored by the query), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm import textkernel as tk
from ratelake.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 documents so many are cut, and of 100 cut ones so many have the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20

#: Width in bytes of a character by its first byte, 0 for a letter, -1 for bytes that only continue a character.
_CLASS = np.ones(256, np.int8)
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 0
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = -1, 2, 3, 4


class Runs:
    """The class runs of a chunk of texts."""

    def __init__(self, c: tk.Chunk) -> None:
        kinds = _CLASS[c.data]
        lead = np.flatnonzero(kinds >= 0)
        kind = kinds[lead]
        texts = len(c.offsets) - 1
        #: Characters before each text, and in all.
        self.text_char = np.searchsorted(lead, c.offsets)
        new = np.ones(len(lead), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[self.text_char[:-1][self.text_char[:-1] < len(lead)]] = True
        at = np.flatnonzero(new)
        #: Of each run: its class, first byte and first character, counted over the chunk.
        self.kind, self.byte, self.char = kind[at], lead[at], at
        length = np.diff(np.append(at, len(lead)))
        #: Units before each run, and in all.
        self.units = np.concatenate([[0], np.cumsum(np.where(self.kind == 0, 1, length))])
        self.first = np.searchsorted(at, self.text_char)
        #: Units of each text.
        self.n = self.units[self.first[1:]] - self.units[self.first[:-1]] if texts else np.zeros(0, np.int64)
        self.offsets = c.offsets

    def cut(self, text: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (from the chunk's begin) and characters (from the text's) before unit c of each text."""
        unit = self.units[self.first[text]] + c
        run = np.searchsorted(self.units, unit, "right") - 1
        run = np.minimum(run, len(self.kind) - 1)
        inside = np.where(self.kind[run] == 0, 0, unit - self.units[run])
        at_end = c >= self.n[text]
        byte = np.where(at_end, self.offsets[text + 1], self.byte[run] + inside * self.kind[run])
        char = np.where(at_end, self.text_char[text + 1], self.char[run] + inside)
        return byte, char - self.text_char[text]


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The document's four 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _examples(texts: pa.Array, ids: list[int | None], seed: int, cut_share: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for c in tk.chunks(texts):
        runs, data = Runs(c), c.data.tobytes()
        own = [draws(x, seed) for x in ids[c.lo : c.hi]]
        h = np.array(own, np.int64).reshape(-1, 4)
        ends = np.sort(h[:, :2] % (runs.n[:, None] + 1), axis=1)
        form, out, before, middle = [], [], np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        whole = np.flatnonzero(runs.n > 0)
        bounds = np.zeros((len(own), 2), np.int64)
        if len(whole):
            bounds[whole, 0], before[whole] = runs.cut(whole, ends[whole, 0])
            bounds[whole, 1], to = runs.cut(whole, ends[whole, 1])
            middle[whole] = to - before[whole]
        for i, (lo, hi) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())):
            text = data[lo:hi]
            if not text or h[i, 2] % 100 >= cut_share or p in text or s in text or m in text:
                form.append("plain")
                out.append(text)
                continue
            a, b = bounds[i].tolist()
            head, mid, tail = data[lo:a], data[a:b], data[b:hi]
            spm = h[i, 3] % 100 < suffix_first
            form.append("spm" if spm else "psm")
            out.append(s + tail + p + head + m + mid if spm else p + head + s + tail + m + mid)
        plain = np.array([f == "plain" for f in form], bool)
        columns = [pa.array(runs.n), pa.array(form, pa.string()), pa.array(before, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).view(pa.string())]
        yield pa.record_batch(columns, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_share: int = CUT_SHARE, suffix_first: int = SUFFIX_FIRST_SHARE) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): ``row`` holds the document's own columns.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle). ``n`` counts units; the lengths of
    prefix and middle are characters, null for a plain text.
    """
    kept = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for made in _examples(batch.column("text"), ids, seed, cut_share, suffix_first):
                rows = batch.column("row").slice(at, made.num_rows)
                at += made.num_rows
                yield pa.record_batch([rows, *made.columns], names=["row", *made.schema.names])

    schema = kept.schema
    made = f"row {schema['row'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return kept.mapInArrow(run, made)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an example was made from; sentinels stand nowhere else in one that is not plain."""
    part = lambda k: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(k))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(), 256)}
    return made.withColumns(digests).select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
u as (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as us, [('0x' || x[8 * k + 1 : 8 * k + 8])::bigint for k in range(4)] as h from d),
c as (select *, len(us) as n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) as lo, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) as hi,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(us[1 : lo], '') as a, array_to_string(us[lo + 1 : hi], '') as b, array_to_string(us[hi + 1 : n], '') as z from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a) end::bigint as prefix_chars, case when form <> 'plain' then length(b) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b else '<S>' || z || '<P>' || a || '<M>' || b end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
