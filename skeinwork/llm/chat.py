r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply trainable. A turn
reads ``### role:\ntext\n</turn>\n``; inside roles and texts ``\``, ``#``, ``<`` and (in roles) ``:`` get a backslash, so no
control string can occur there and the escape can be undone. Turns after the last reply, or of a conversation without
one, form a last example with nothing trainable, so that the output holds every turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
BATCH_CHARS = 1 << 20
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, more: str = "") -> str:
    for c in "\\#<" + more:
        if c in text:
            text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    turns, at = [], 0
    while at < len(text):
        head = _TURN.match(text, at)
        if head is None:
            raise ValueError(f"no turn begins at {at}")
        end = text.index(END, head.end())
        turns.append((unescape(head[1]), unescape(text[head.end() : end])))
        at = end + len(END)
    return turns


def expand(turns: Iterator[tuple[object, str, str]]) -> Iterator[tuple[object, int, str, int, int]]:
    """(conversation, example, text, loss start, loss end) from (conversation, role, text) in order."""
    now, parts, made, pending = object(), [], 0, False
    for conv, role, text in turns:
        if conv != now:
            if pending:
                whole = "".join(parts)
                yield now, made, whole, len(whole), len(whole)
            now, parts, made = conv, [], 0
        head, body = f"### {escape(role, ':')}:\n", escape(text)
        parts.append(head + body + END)
        pending = role != "assistant"
        if not pending:
            whole = "".join(parts)
            parts = [whole]
            yield conv, made, whole, len(whole) - len(END) - len(body), len(whole) - len(END)
            made += 1
    if pending:
        whole = "".join(parts)
        yield now, made, whole, len(whole), len(whole)


def prefix_target_examples(df: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start and loss_end (code points) from rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text, so ties and repeated rows have a fixed order and all count. Null text
    and null role are empty, null conv_id is a conversation of its own, null turn comes first; no rows give none. A
    conversation's rows meet in one task as a sorted stream: only its formatted text is held, which is what the examples
    repeat, and batches go out by size.
    """
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ((c, r, t) for b in batches for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True))
        held, chars = [], 0
        for x in expand(turns):
            held.append(x)
            chars += len(x[2])
            if chars >= BATCH_CHARS or len(held) >= 4096:
                yield out(held)
                held, chars = [], 0
        if held:
            yield out(held)

    def out(held: list) -> pa.RecordBatch:
        conv, example, text, start, end = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(example, pa.int64()), pa.array(text, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["conv_id", "example", "text", "loss_start", "loss_end"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


def example_digests(examples: DataFrame) -> DataFrame:
    """Reads examples back, as ``prefix_target_examples`` returns them (one conversation's adjoin in a partition).

    The last example of a conversation holds all its turns; the loss text is each example's own span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, last, loss, chars, formatted = object(), None, hashlib.sha256(), 0, 0

        def close() -> None:
            turns = parse_turns(last)
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            done.append((now, len(turns), digest.hexdigest(), chars, loss.hexdigest(), formatted))

        for b in batches:
            for conv, text, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
                if conv != now:
                    if last is not None:
                        close()
                    now, loss, chars, formatted = conv, hashlib.sha256(), 0, 0
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                chars, formatted, last = chars + len(reply), formatted + len(text), text
            if done:
                yield out(done)
                done = []
        if last is not None:
            close()
            yield out(done)

    def out(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
