"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are context, and only its own text is trainable (the loss span). Turns
after the last assistant turn, or a conversation without any, give one more example without a loss span, so that the output holds every turn.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, in roles a line feed
``\\n``; so no text can hold a control string, and unescaping gives back each text.

The rows are dealt by conversation and sorted, and a task streams through them: it holds one conversation's prefix at a time, which is the
length of that conversation's longest example. ``read_back`` deals and sorts examples in the same way, unless told that they still are.

Defined cases: null text and role count as empty; turns with the same number go by role, then text; a null conv_id is a conversation, null turns
come first; repeated rows are turns of their own; an empty table gives no examples; further columns are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; raises ValueError if the text is not a whole number of turns."""
    out, at = [], 0
    while at < len(formatted):
        if not (found := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example, text, loss_start, loss_end (code points; null: nothing is trainable), conversation by conversation in order."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, prefix, number, fresh = object(), [], 0, False
        size = 0

        def rest() -> Iterator[tuple]:
            if fresh:
                yield conv, number, "".join(prefix), None, None

        for conv_id, role, text in rows:
            if conv_id != conv:
                yield from rest()
                conv, prefix, number, fresh, size = conv_id, [], 0, False, 0
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            prefix.append(f"{head}{body}{END}\n")
            fresh = role != target
            if not fresh:
                whole = "".join(prefix)
                prefix = [whole]
                yield conv, number, whole, size + len(head), size + len(head) + len(body)
                number += 1
            size += len(head) + len(body) + len(END) + 1
        yield from rest()

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(dealt.select("conv_id", "role", "text"), "conv_id long, example int, text string, loss_start long, loss_end long", each)


def read_back(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """What the examples hold, for each conversation.

    ``ordered``: ``formatted`` comes straight from ``examples``, without a table or shuffle between, and is read in its order.
    All turns come from the longest example; each example's loss span gives a trainable text.
    """

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, last, chars, loss_chars, loss, count = object(), "", 0, 0, hashlib.sha256(), 0

        def result() -> Iterator[tuple]:
            if count:
                turns = parse(last)
                digest = hashlib.sha256()
                for role, text in turns:
                    digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                yield conv, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars, count

        for conv_id, text, start, end in rows:
            if conv_id != conv:
                yield from result()
                conv, chars, loss_chars, loss, count = conv_id, 0, 0, hashlib.sha256(), 0
            last, chars, count = text, chars + len(text), count + 1
            if start is not None:
                own = unescape(text[start:end])
                loss_chars += len(own)
                loss.update(own.encode("utf-8", "surrogatepass"))
        yield from result()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    dealt = formatted if ordered else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return map_rows(dealt.select("conv_id", "text", "loss_start", "loss_end"), schema, each)
