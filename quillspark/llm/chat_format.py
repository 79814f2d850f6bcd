r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, `<|turn|>role<|text|>text<|end|>` for each turn, and encoded once with offsets; the three
marks are added tokens, so no token reaches across a mark. Spans of the texts that are learned are sorted, as are token
spans; a binary search for each token finds the span it lies in, and that is the mask.

Control strings inside roles and texts are escaped: a `<` or `[` before `|`, `s>`, `/s>`, `INST]` or `/INST]`, with any
backslashes between, gets one backslash more. Unescaping takes one away, so any text comes back.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_AFTER = r"(?=\||/?s>|/?INST\])"
_PLAIN, _ESCAPED = re.compile(r"([<\[])(\\*)" + _AFTER), re.compile(r"([<\[])\\(\\*)" + _AFTER)
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], learned: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts whose role is learned, empty ones left out."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role in learned and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that render() was given."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


def loss_mask(tokens: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token's (start, end) whether it lies in one of the sorted spans."""
    if not spans or not len(tokens):
        return np.zeros(len(tokens), bool)
    first, last = np.array(spans).T
    at = np.searchsorted(last, tokens[:, 0], "right")
    return (at < len(last)) & (first[np.minimum(at, len(first) - 1)] < tokens[:, 1])


_LOADED: dict[str, object] = {}


def chat_tokenizer(path: str):
    """The file's tokenizer with the marks as added tokens and offsets that keep white space."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        _LOADED[path] = t
    return _LOADED[path]


def format_conversations(turns: DataFrame, tokenizer_path: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, formatted, ids, token_starts, token_ends, mask): one row per conversation.

    turns: conv_id, turn, role, text. Turns are ordered by turn (nulls first), then role and text, so ties and repeated
    rows have a fixed place and all are kept. Null roles and texts are empty. Rows without conv_id form one conversation
    of their own. Other columns are ignored; an empty table gives no rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    groups = turns.select("conv_id", fields.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    wanted = frozenset(learned)

    def run(batches):
        coder = chat_tokenizer(tokenizer_path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rendered = [render(list(zip(r, t, strict=True)), wanted) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                coded = coder.encode_batch([text for text, _ in rendered], add_special_tokens=False)
                offsets = [np.array(e.offsets, np.int64).reshape(-1, 2) for e in coded]
                masks = [loss_mask(o, spans) for o, (_, spans) in zip(offsets, rendered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in part.column(1)], pa.int64()), pa.array([t for t, _ in rendered], pa.string()), pa.array([e.ids for e in coded], pa.list_(pa.int32())),
                     *(pa.array([o[:, k].astype(np.int32) for o in offsets], pa.list_(pa.int32())) for k in (0, 1)), pa.array([m.tolist() for m in masks], pa.list_(pa.bool_()))],
                    names=["conv_id", "n_turns", "formatted", "ids", "token_starts", "token_ends", "mask"],
                )

    schema = f"conv_id {kind}, n_turns long, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, mask array<boolean>"
    return groups.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts")).mapInArrow(run, schema)


def learned_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped: runs of masked tokens that touch are one text."""
    out, first, last = [], None, None
    for s, e in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        if last is not None and s <= last:
            last = max(last, e)
            continue
        if last is not None:
            out.append(unescape(formatted[first:last]))
        first, last = s, e
    if last is not None:
        out.append(unescape(formatted[first:last]))
    return "".join(out)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from format_conversations' output."""
    from hashlib import sha256

    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            lists = [b.column(k).to_pylist() for k in (1, 2, 3, 4)]
            for text, starts, ends, mask in zip(*lists, strict=True):
                turns = parse(text)
                loss = learned_text(text, np.array(starts, np.int64), np.array(ends, np.int64), np.array(mask, bool))
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                rows.append((len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "mask").mapInArrow(run, schema)
