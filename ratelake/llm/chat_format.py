"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is under the
loss mask. Turns after the last assistant turn (or all turns, if there is none) make one more example without a loss,
so the output holds the whole conversation.

A turn is written ``<s>[INST] role [/INST]text</s>``. Inside roles and texts a backslash becomes two, ``<`` becomes
``\\l`` and ``[`` becomes ``\\b``, so no control string can occur in them and the writing can be undone.

Examples of a conversation of n turns hold about n / 2 times its text; that is the method. Conversations are put
together by a grouped collection, one conversation a row, and written by a streaming map whose batches are bounded.

Defined cases: turns are ordered by (turn, role, text), nulls first; null roles and texts are empty; repeated rows are
turns of their own; rows with a null ``conv_id`` are one conversation of that id; an empty table gives no example; other
columns are ignored. A conversation is a row by definition: its last example holds all of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm.common import table

TARGET_ROLE = "assistant"
_BATCH_CHARS = 1 << 21
_TURN = re.compile(r"<s>\[INST\] ([^<\[]*) \[/INST\]([^<\[]*)</s>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BACK = {"\\": "\\", "l": "<", "b": "["}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its text starts and ends in it."""
    head, body = f"<s>[INST] {escape(role)} [/INST]", escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example; raises if anything else stands in it."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def examples_of(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """Formatted examples of a conversation with the character span under the loss mask."""
    context, last = "", True
    for role, text in turns:
        written, start, end = write_turn(role, text)
        if role == TARGET_ROLE:
            yield context + written, len(context) + start, len(context) + end
        context, last = context + written, role == TARGET_ROLE
    if not last:
        yield context, len(context), len(context)


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): all training examples."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "example", "text", "loss_start", "loss_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for conv, turns in zip(batch.column(0), batch.column(1)):
                pairs = [(t["role"], t["text"]) for t in turns.as_py()]
                for k, (text, start, end) in enumerate(examples_of(pairs)):
                    rows.append((conv.as_py(), k, text, start, end))
                    chars += len(text)
                    if chars > _BATCH_CHARS:
                        yield batch_of(rows)
                        rows, chars = [], 0
        if rows:
            yield batch_of(rows)

    return whole.mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, loss text and characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, loss, chars = [], [], [], []
            for text, start, end in zip(*(batch.column(k).to_pylist() for k in ("text", "loss_start", "loss_end"))):
                turns = read_turns(text)
                n.append(len(turns))
                sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                loss.append(unescape(text[start:end]))
                chars.append(len(text))
            yield pa.record_batch([batch.column("conv_id"), batch.column("example"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], names=["conv_id", "example", "n", "sha", "loss", "chars"])

    read = formatted.mapInArrow(run, "conv_id long, example long, n long, sha string, loss string, chars long")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"])
    by = read.groupBy("conv_id").agg(F.max_by("n", "example").alias("n_turns"), F.max_by("sha", "example").alias("turns_sha256"), F.array_join(ordered, "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return by.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digest(examples(rows.unionByName(extra)))


_PARTS = "select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')"
ORACLE_SQL = f"""
with t as ({_PARTS}),
o as (
  select *, row_number() over w as k,
    count(*) filter (role = 'assistant') over (partition by conv_id order by turn, role, text rows between current row and unbounded following) as later,
    length(role) + length(text) + 22
      + (length(role) - length(replace(role, '\\', ''))) + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, '[', '')))
      + (length(text) - length(replace(text, '\\', ''))) + (length(text) - length(replace(text, '<', ''))) + (length(text) - length(replace(text, '[', ''))) as chars
  from t window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), ''))::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars * (later + case when last_role = 'assistant' then 0 else 1 end))::bigint as formatted_chars
from (select *, last_value(role) over (partition by conv_id order by turn, role, text rows between unbounded preceding and unbounded following) as last_role from o)
group by conv_id
"""
