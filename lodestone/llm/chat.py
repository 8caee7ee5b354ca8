"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text, `<|turn|>role<|text|>text<|end|>` a turn, and encoded once with offsets. The
tokens that carry loss are found by intersecting the sorted spans of assistant texts with the sorted token spans by
binary search. The three markers are special tokens of the encoder, so no token crosses a span's border, and encoding
a conversation in blocks that are cut between turns gives the ids that encoding it whole gives.

Inside roles and texts a backslash is put after the `<` of every `<`, backslashes, `|`; taking one away restores them. So no
text can hold a marker.

Turns are range-partitioned by conversation and turn, so one huge conversation spreads over many tasks, each of which
renders and encodes blocks of bounded length.

Nulls: a null role or text is empty; a null conv_id is a conversation of its own; null turns come first. Rows that share
a turn are ordered by role, then text; repeated rows are repeated turns. Empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKERS = (TURN, TEXT, END)

#: A block of turns is closed when its text is this long: bounds a task's memory to a block and one turn.
BLOCK_CHARS = 400_000

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_PARTS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)

SCHEMA = "conv_id long, first_turn long, block long, formatted string, ids array<int>, loss_tokens array<int>, loss_spans array<int>"
ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("first_turn", pa.int64()),
        ("block", pa.int64()),
        ("formatted", pa.string()),
        ("ids", pa.list_(pa.int32())),
        ("loss_tokens", pa.list_(pa.int32())),
        ("loss_spans", pa.list_(pa.int32())),
    ]
)


def escape(text: str | None) -> str:
    return _ESCAPE.sub(r"<\\\1|", text or "")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns (role, text) and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _PARTS.findall(formatted)]


@lru_cache(maxsize=2)
def encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, normalized=False) for m in MARKERS])
    return tokenizer


def loss_tokens(spans: list[tuple[int, int]], offsets: np.ndarray) -> np.ndarray:
    """Indices of tokens that share a character with a span; both are sorted. offsets: (n, 2)."""
    if not len(offsets) or not spans:
        return np.zeros(0, dtype=np.int64)
    s = np.asarray(spans, dtype=np.int64)
    s = s[s[:, 1] > s[:, 0]]
    first = np.searchsorted(offsets[:, 1], s[:, 0], side="right")  # first token that ends after the span's start
    last = np.searchsorted(offsets[:, 0], s[:, 1], side="left")  # first token that starts at or after its end
    return np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)]) if len(s) else np.zeros(0, dtype=np.int64)


def covered(offsets: np.ndarray, tokens: np.ndarray) -> list[int]:
    """Characters under the tokens as a flat list of starts and ends; tokens that touch or overlap run together."""
    if not len(tokens):
        return []
    a, b = offsets[tokens, 0], np.maximum.accumulate(offsets[tokens, 1])
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(a)]))
    return np.stack([a[starts], b[ends - 1]], axis=1).ravel().tolist()


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Blocks of rendered turns, in order of (first_turn, block) within a conversation.

    formatted: the text; ids: its tokens; loss_tokens: indices of tokens with loss; loss_spans: the characters they cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        key, first, turns, held, number = None, None, [], 0, 0
        rows: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal turns, held, number, size
            text, spans = render(turns)
            got = enc.encode(text, add_special_tokens=False)
            offsets = np.asarray(got.offsets, dtype=np.int64).reshape(-1, 2)
            under = loss_tokens(spans, offsets)
            rows.append((key, first, number, text, got.ids, under.tolist(), covered(offsets, under)))
            number += 1
            size += len(text)
            turns, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
            rows.clear()
            size = 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for conv, turn, role, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if turns and (conv != key or held >= BLOCK_CHARS):
                        close()
                        if size >= BLOCK_CHARS:
                            yield flush()
                    if not turns:
                        key, first = conv, turn
                    turns.append((role, text))
                    held += len(text or "") + len(role or "") + 24
        if turns:
            close()
        if rows:
            yield flush()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ranged.mapInArrow(run, SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the blocks of a partition, sorted by conversation, into digests; holds one block at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    key, state = None, None
    rows: list[tuple] = []

    def close() -> None:
        n, turns, chars, loss, length = state
        rows.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), length))

    for batch in batches:
        for row in range(batch.num_rows):
            conv, formatted, spans = (batch.column(i)[row].as_py() for i in range(3))
            if state is None or conv != key:
                if state is not None:
                    close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                text = unescape(formatted[a:b])
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if state is not None:
        close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: The conversation that is formatted besides those of the table.
EXTRA_ID = -7
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op1_chat_format(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    both = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    blocks = format_conversations(both, tokenizer_path).select("conv_id", "formatted", "loss_spans", "first_turn", "block")
    # a conversation's digests are sequential: only finished blocks, a few a conversation, meet in one stream
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "block").select("conv_id", "formatted", "loss_spans")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(23 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
                   + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
