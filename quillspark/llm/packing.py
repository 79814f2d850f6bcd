"""Packing documents into training sequences by minimum bin slack.

Every document becomes ids plus an end id. Whole windows of `capacity` ids are cut off first; what remains of each
document goes to the pool of its task. Each window takes the longest remainder, then the multiset of remaining lengths
whose sum comes closest to capacity: a bitset of reachable sums, grown length by length within the counts left, with the
bitset before each length kept, so that the counts are read back from the target. A multiset is used as often as the
counts allow. Slack that no multiset fills is filled by cutting a longer remainder. The last, partial window of a pool is
cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokenizer import encoder, in_parts

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def fullest(counts: dict[int, int], longest: int, capacity: int) -> dict[int, int]:
    """How often each length is used by the multiset with `longest` whose sum is closest below or at capacity."""
    full, mask = 1 << capacity, (2 << capacity) - 1
    reach, steps = 1 << longest, []
    for length in sorted(counts, reverse=True):
        left = counts[length] - (length == longest)
        if left <= 0 or longest + length > capacity:
            continue
        steps.append((length, reach))
        shifted = reach
        for _ in range(min(left, (capacity - longest) // length)):
            shifted = shifted << length & mask
            if not shifted:
                break
            reach |= shifted
        if reach & full:
            break
    at, used = reach.bit_length() - 1, defaultdict(int, {longest: 1})
    for length, before in reversed(steps):
        while not before >> at & 1:
            used[length] += 1
            at -= length
    return dict(used)


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Pieces (key, start, length), 0 < length < capacity, as full windows and as sequences of powers of two."""
    pool: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for p in reversed(pieces):
        pool[p[2]].append(p)
    counts = {n: len(p) for n, p in pool.items()}
    windows = []

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return pool[length].pop()

    while counts:
        used = fullest(counts, max(counts), capacity)
        total = sum(n * k for n, k in used.items())
        if total < capacity and sum(counts.values()) == sum(used.values()):
            break  # all that is left doesn't fill a window
        for _ in range(min(counts[n] // k for n, k in used.items()) if total == capacity else 1):
            window = [take(n) for n, k in used.items() for _ in range(k)]
            if slack := capacity - total:  # every length left is longer than the slack
                key, start, length = take(max(counts))
                window.append((key, start, slack))
                pool[length - slack].append((key, start + slack, length - slack))
                counts[length - slack] = counts.get(length - slack, 0) + 1
            windows.append(window)
    rest = [take(n) for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    tails, left = [], sum(p[2] for p in rest)
    while left:
        room, tail = 1 << left.bit_length() - 1, []
        left -= room
        while room:
            key, start, length = rest.pop(0)
            tail.append((key, start, min(room, length)))
            if length > room:
                rest.insert(0, (key, start + room, length - room))
            room -= tail[-1][2]
        tails.append(tail)
    return windows, tails


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, group_docs: int = 8192, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length and,
    with keep_ids, ids.

    Null and empty texts are the end id alone; null ids and repeated rows are packed like any other. Pools hold the
    remainders of group_docs documents of one task, so memory is bounded and nothing is shuffled. sequence_id is unique:
    the task's number and a count. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder, task = encoder(tokenizer_path, False), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        schema = pa.schema([("id", id_type), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")), *[("ids", pa.list_(pa.int32()))] * keep_ids])
        held, out, number = [], [], 0

        def emit(sequence, at):
            offset, size = 0, sum(p[2] for p in sequence)
            for key, start, length in sequence:
                doc, ids, first = held[key]
                part = ids[4 * (start - first) : 4 * (start - first + length)]
                out.append((doc[0], start, length, zlib.crc32(part), doc[1], task + at, offset, size, *[np.frombuffer(part, "<i4")] * keep_ids))
                offset += length

        def drained():
            rows = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, schema=schema)

        def close():
            nonlocal number
            windows, tails = pack([(k, first, len(ids) // 4) for k, (_, ids, first) in enumerate(held) if ids], capacity)
            for sequence in windows + tails:
                emit(sequence, number)
                number += 1
            held.clear()

        for b in batches:
            names, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in in_parts(texts):
                for name, ids in zip(names[i:j], coder.ids(texts[i:j]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    whole = n // capacity * capacity
                    for start in range(0, whole, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        out.append((name, start, capacity, zlib.crc32(part), n, task + number, 0, capacity, *[np.frombuffer(part, "<i4")] * keep_ids))
                        number += 1
                    if n > whole:
                        held.append(((name, n), ids[4 * whole :], whole))
                    if len(out) >= 4096:
                        yield drained()
                if len(held) >= group_docs:
                    close()
                    yield drained()
        close()
        yield drained()

    id_type = pa.string() if kind == "string" else {"bigint": pa.int64(), "int": pa.int32()}[kind]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {SCHEMA}" + ", ids array<int>" * keep_ids).withColumnRenamed("id", id_col)
