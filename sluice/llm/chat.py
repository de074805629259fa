"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from turns to a string. To learn where a turn lies, the
prefixes of the conversation are rendered one after another: what the next output adds
to the last one is the span of the new turn. A template whose output for more turns does
not begin with its output for fewer rewrites history; this is reported with the first
place that changed. The new turn's span then starts there, and earlier turns whose spans
reach beyond it have no known span any more (null).

The stock template marks turns by control strings and escapes them inside texts: a
backslash is doubled and one is put after the first character of a control string, so
the original text can be read back from the output.

Rows are dealt by conversation and sorted by turn, and conversations are formatted from
the sorted stream, one at a time. Null texts and roles count as empty; null turns come
first; rows of one turn are ordered by role and text; repeated rows are repeated turns.
A row without a conversation id belongs to no other row: it is a conversation of its own,
with a null id, and such rows are dealt by their content. Extra columns are ignored; an
empty table gives an empty result. A task holds one conversation at a time; rendering its
prefixes takes time with the square of its turns, which is the price of knowing nothing
about the template.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lots

Turn = tuple[str, str]

#: The strings that mark turns, and others that chat models read as control.
START, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (START, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_BREAK = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + r")(.)")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _BREAK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@functools.lru_cache(maxsize=1024)
def _stock_turn(role: str, text: str) -> str:
    return f"{START}{escape(role)}{TEXT}{escape(text)}{END}\n"


def stock_template(turns: list[Turn]) -> str:
    return "".join(_stock_turn(role, text) for role, text in turns)


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int] | None]  # of each turn; None where a later turn rewrote it
    rewritten: list[tuple[int, int]]  # (turn, first place that changed) where history was rewritten


def render(turns: list[Turn], template: Callable[[list[Turn]], str]) -> Rendered:
    """Renders successive prefixes and compares consecutive outputs."""
    before, spans, rewritten = template([]), [], []
    for k in range(1, len(turns) + 1):
        after = template(turns[:k])
        start = len(before)
        if not after.startswith(before):
            low, high = 0, min(len(before), len(after))
            while low < high:  # the longest common prefix, by halves
                middle = (low + high + 1) // 2
                low, high = (middle, high) if before[:middle] == after[:middle] else (low, middle - 1)
            start = low
            rewritten.append((k - 1, start))
            spans = [s if s is not None and s[1] <= start else None for s in spans]
        spans.append((start, len(after)))
        before = after
    return Rendered(before, spans, rewritten)


#: Of an output: role, text and the place of the text of each turn.
ReadBack = Callable[[Rendered], list[tuple[str, str, tuple[int, int]]]]


def read_back(rendered: Rendered) -> list[tuple[str, str, tuple[int, int]]]:
    """Role, text and the place of the text of each span of a stock-template output."""
    out = []
    for span in rendered.spans:
        m = _TURN.match(rendered.text, *span) if span else None
        if not m:
            raise ValueError("a span that is no turn")
        out.append((unescape(m[1]), unescape(m[2]), m.span(2)))
    return out


_FIELDS = [
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("turn_spans", pa.list_(pa.list_(pa.int64()))), ("rewrites", pa.list_(pa.list_(pa.int64()))), ("formatted", pa.string()),
]
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_spans array<array<long>>, turn_spans array<array<long>>, rewrites array<array<long>>, formatted string"


def _formatted(conv_id, turns: list[Turn], template: Callable[[list[Turn]], str], read: ReadBack | None, loss_role: str) -> tuple:
    rendered = render(turns, template)
    digests, loss = (len(turns), None, None, None), None
    if read is None:  # the loss falls on the whole spans of the turns that are still there
        loss = [list(s) for (role, _), s in zip(turns, rendered.spans, strict=True) if role == loss_role and s]
    else:
        seen, chars, turns_hash, loss_hash = read(rendered), 0, hashlib.sha256(), hashlib.sha256()
        loss = [list(span) for role, _, span in seen if role == loss_role]
        for role, text, _ in seen:
            turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == loss_role:
                chars += len(text)
                loss_hash.update(text.encode("utf-8", "surrogatepass"))
        digests = (len(seen), turns_hash.hexdigest(), chars, loss_hash.hexdigest())
    return (conv_id, *digests, len(rendered.text), loss, [s and list(s) for s in rendered.spans], [list(r) for r in rendered.rewritten], rendered.text)


def format_conversations(rows: DataFrame, template: Callable[[list[Turn]], str] = stock_template, read: ReadBack | None = read_back, loss_role: str = "assistant", parts: int | None = None) -> DataFrame:
    """One row per conversation: formatted text, loss mask, span of each turn, where history was rewritten, and digests.

    Any template will do; the digests are of what `read` finds in the output, and null
    where it is None, as it must be for templates other than the stock one.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = None if template is not stock_template and read is read_back else read
    empty = F.lit("")
    flat = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    lone = flat.withColumn("deal", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0)))
    stream = lone.repartition(parts, "conv_id", "deal").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [n for n, _ in _FIELDS]

    def run(batches):
        at, turns, out, held = None, [], [], 0

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=names)

        for batch in lots(batches, 3):
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if turns and (conv != at or conv is None):
                    out.append(_formatted(at, turns, template, read, loss_role))
                    held += out[-1][5]
                    turns = []
                    if held > 4_000_000:
                        yield flush()
                        held = 0
                at = conv
                turns.append((role, text))
        if turns:
            out.append(_formatted(at, turns, template, read, loss_role))
        yield flush()

    return stream.mapInArrow(run, SCHEMA)
