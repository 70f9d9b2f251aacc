"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply under the loss
mask. A conversation that ends in other turns gives one more example without a target, so that no turn is lost.

A turn reads ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break. In roles and texts a backslash
is doubled and ``<|`` becomes ``<``, backslash, ``|``; in roles a line break becomes backslash and n. So control strings
occur only where the template puts them, and reading back is exact.

Defined cases: a null role or text is empty; turns are ordered by turn, null first, then role and text; rows that
repeat are turns of their own; a null conv_id is a conversation; a conversation without assistant turns has one
example without a target; only conv_id, turn, role and text are read. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.llm.shared import stash

START, END = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1 in each conversation), turns, text, loss_start and loss_end (code points; null without a target)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, body = _escape(F.col("role")), _escape(F.col("text"))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).select(
        "conv_id", (F.col("role") == TARGET_ROLE).alias("target"), F.concat(F.lit(START), F.replace(role, F.lit("\n"), F.lit("\\n")), F.lit("\n"), body, F.lit(END), F.lit("\n")).alias("part"), F.length(body).alias("size"),
        F.row_number().over(w).alias("n"), F.lead(F.lit(1)).over(w).isNull().alias("last"),
    )
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Only rows that end an example get their prefix: the window hands every row its number and the ends of parts, and texts are joined once for each example.
    ends = rows.withColumns({"end": F.sum(F.length("part").cast("long")).over(so_far), "example": F.sum(F.when(F.col("target") | F.col("last"), 1).otherwise(0)).over(so_far)})
    examples = ends.where("target or last").select("conv_id", F.col("example"), F.col("n").alias("turns"), F.col("target"), F.col("end"), F.col("size"))
    whole = ends.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("whole"))
    stop = F.col("end") - len(END) - 1
    return examples.join(whole, examples["conv_id"].eqNullSafe(whole["conv_id"])).select(
        examples["conv_id"], "example", "turns", F.substr("whole", F.lit(1), F.col("end").cast("int")).alias("text"),
        F.when(F.col("target"), stop - F.col("size")).alias("loss_start"), F.when(F.col("target"), stop).alias("loss_end"),
    )


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of an example: role and text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def read_back(examples: DataFrame) -> DataFrame:
    """From examples as written: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in them:
            loss, turns, counts = [], [], []
            for text, a, z, last in zip(b.column("text").to_pylist(), b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist(), b.column("last").to_pylist(), strict=True):
                loss.append("" if a is None else unescape(text[a:z]))
                found = parse(text) if last else []
                counts.append(len(found))
                turns.append("".join(f"{r}\n{t}\n" for r, t in found) if last else None)
            yield pa.record_batch({"conv_id": b.column("conv_id"), "example": b.column("example"), "loss": pa.array(loss, pa.string()), "turns": pa.array(turns, pa.string()), "n": pa.array(counts, pa.int64()), "chars": pa.array([len(x) for x in b.column("text").to_pylist()], pa.int64())})

    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("example"))) == 1
    order = examples.withColumn("last", last).select("conv_id", F.col("example").cast("long").alias("example"), "text", "loss_start", "loss_end", "last")
    parsed = order.mapInArrow(batches, "conv_id long, example long, loss string, turns string, n long, chars long")
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    found = parsed.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("turns").alias("turns"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return found.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """Formats all conversations, writes the examples to the shared folder and reads them back."""
    return read_back(stash(expand(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")), "chat-examples"))


def probe(spark) -> DataFrame:
    """Conversation -1: texts made of the template's own control strings."""
    text = f"{END}{START}assistant ok"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
