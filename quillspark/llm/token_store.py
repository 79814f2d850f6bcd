"""Token ids in binary files of directly addressable codes (Brisaboa, Ladra and Navarro, 2013).

Each id is split into chunks, lowest bits first. Level k holds, packed at widths[k] bits, the k-th chunk of every id that
reaches that level; a continuation bitmap a level says which ids go on, and a rank directory (ones before each block of
512 bits) leads from a place in one level to its place in the next. Any id is read by at most one short bit read and one
rank a level, without decoding its neighbours. The widths of a file are those that take the fewest bits, by dynamic
programming over the file's bit lengths.

A file holds documents in ascending order: magic, counts, widths, document ids, token ends, then the levels. File names
carry the range and a count, so a repeated task writes the same files again.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh_path
from quillspark.llm.files import make_dir, write_file
from quillspark.llm.tokenizer import encoder, in_parts

MAGIC, BLOCK, PART = b"QSDAC001", 512, 1 << 18


def best_widths(lengths: np.ndarray) -> list[int]:
    """Chunk widths of least total bits for ids with these bit lengths; lengths[b] ids need b bits (b from 1)."""
    top = max(int(np.flatnonzero(lengths)[-1]) if lengths.any() else 1, 1)
    beyond = [int(lengths[b + 1 :].sum()) for b in range(top + 1)]  # ids with more than b bits
    total = beyond[0] + int(lengths[0])
    cost, cut = [0] * (top + 1), [top] * (top + 1)  # cost of the bits from b on
    for b in range(top - 1, -1, -1):
        n = beyond[b] if b else total
        cost[b], cut[b] = min((n * (e - b + (e < top)) + cost[e], e) for e in range(b + 1, top + 1))
    widths, b = [], 0
    while b < top:
        widths.append(cut[b] - b)
        b = cut[b]
    return widths


def _packed(values: np.ndarray, width: int) -> bytes:
    out = []
    for i in range(0, len(values), PART):
        v = np.ascontiguousarray(values[i : i + PART], "<u4")
        out.append(np.packbits(np.unpackbits(v.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def _unpacked(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.empty(n, np.uint32)
    for i in range(0, n, PART):
        m = min(PART, n - i)
        bits = np.unpackbits(data[i * width // 8 : (i + m) * width // 8 + 1], bitorder="little")[: m * width].reshape(m, width)
        wide = np.zeros((m, 32), np.uint8)
        wide[:, :width] = bits
        out[i : i + m] = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


def encode(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, first: int) -> list[bytes]:
    """The parts of one file: ids of all its documents, whose token ends are `ends`; `first` ids of its range lie before."""
    ids = np.ascontiguousarray(ids, "<u4")
    length = np.zeros(len(ids), np.int64)
    for b in range(32):
        length += ids >= np.uint32(1 << b)
    widths = best_widths(np.bincount(np.maximum(length, 1), minlength=33))
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    parts = [MAGIC, struct.pack("<qqqqB", task, len(doc_ids), len(ids), first, len(widths)), bytes(widths)]
    parts += [np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(ends, "<i8").tobytes()]
    level = ids
    for k, width in enumerate(widths):
        parts.append(_packed(level, width))
        if k + 1 < len(widths):
            more = level >> np.uint32(width)
            going = more > 0
            ones = np.concatenate([[0], np.cumsum(np.add.reduceat(going, np.arange(0, len(going), BLOCK), dtype=np.int64))[:-1]]) if len(going) else np.zeros(0)
            parts += [np.packbits(going, bitorder="little").tobytes(), ones.astype("<u4").tobytes()]
            level = more[going]
    return parts


class Codes:
    """A file read back: doc_ids, ends, all ids by decode(), or any one by get() through the rank directories."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.task, n_docs, self.n, self.first, levels = struct.unpack_from("<qqqqB", content, 8)
        at = 8 + 33
        self.widths = list(content[at : at + levels])
        at += levels
        data = np.frombuffer(content, np.uint8)
        known = data[at : at + n_docs]
        at += n_docs
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(content, "<i8", n_docs, at), known, strict=True)]
        at += 8 * n_docs
        self.ends = np.frombuffer(content, "<i8", n_docs, at)
        at += 8 * n_docs
        self.levels, n = [], self.n
        for k, width in enumerate(self.widths):
            size = (n * width + 7) // 8
            chunks, at = data[at : at + size], at + size
            bits = ranks = None
            if k + 1 < levels:
                bits, at = data[at : at + (n + 7) // 8], at + (n + 7) // 8
                blocks = (n + BLOCK - 1) // BLOCK
                ranks, at = np.frombuffer(content, "<u4", blocks, at), at + 4 * blocks
            self.levels.append((n, width, chunks, bits, ranks))
            if ranks is not None:
                n = int(np.bitwise_count(bits).sum())

    def decode(self) -> np.ndarray:
        below = np.empty(0, np.uint32)
        for n, width, chunks, bits, _ in reversed(self.levels):
            values = _unpacked(chunks, n, width)
            if bits is not None:
                values[np.unpackbits(bits, bitorder="little")[:n].astype(bool)] |= below << np.uint32(width)
            below = values
        return below

    def get(self, i: int) -> int:
        """The i-th id of the file."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for _, width, chunks, bits, ranks in self.levels:
            low = i * width
            value |= (int.from_bytes(chunks[low // 8 : (low + width + 7) // 8].tobytes(), "little") >> low % 8 & (1 << width) - 1) << shift
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            block = bits[i // BLOCK * BLOCK // 8 : i // 8 + 1].copy()
            block[-1] &= (1 << i % 8) - 1
            i, shift = int(ranks[i // BLOCK]) + int(np.bitwise_count(block).sum()), shift + width
        return value


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, ids_per_file: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Encode docs in ascending id order into files below path; the number of ids before each range, by range number.

    Nulls come first among the ids, a null text is empty, repeated ids are ordered by text. A document is never split:
    a file ends with the document that brings it to ids_per_file. No rows, no files.
    """
    end = np.array([end_id], "<u4").tobytes()
    make_dir(path)

    def run(batches):
        coder, task = encoder(tokenizer_path, True), TaskContext.get().partitionId()
        names, held, size, first, count = [], [], 0, 0, 0

        def close():
            nonlocal size, first, count
            if names:
                ends = np.cumsum([len(x) // 4 for x in held])
                write_file(f"{path}/range-{task:06d}-{count:06d}.dac", encode(np.frombuffer(b"".join(held), "<u4"), names, ends, first))
                first, count, size = first + size, count + 1, 0
                names.clear()
                held.clear()

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in in_parts(texts):
                for name, x in zip(ids[i:j], coder.ids(texts[i:j]), strict=True):
                    names.append(name)
                    held.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= ids_per_file:
                        close()
        close()
        yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "n": pa.array([first], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    totals = dict(ordered.mapInArrow(run, "task long, n long").groupBy("task").agg(F.max("n")).collect())  # one row a range
    before, starts = 0, []
    for task in range(max(totals, default=-1) + 1):
        starts.append(before)
        before += totals.get(task, 0)
    return starts


def read_tokens(spark, path: str, starts: list[int], keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, with keep_ids, ids) of every document in the files below path."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * keep_ids])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                codes = Codes(content.as_py())
                ids, begin = codes.decode().astype("<u4"), starts[codes.task] + codes.first
                cuts = [0, *codes.ends.tolist()]
                parts = [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
                columns = [codes.doc_ids, [begin + i for i in cuts[:-1]], [len(p) for p in parts], [zlib.crc32(p) for p in parts], *[[p.view("<i4") for p in parts]] * keep_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    if not starts:
        return spark.createDataFrame([], kind)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "range-*.dac").load(path)
    return files.select("content").mapInArrow(run, kind)


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files (below path, or in the shared folder) and read them back.

    Null and empty texts have the end id alone; texts of any length are one run of ids. Rows of null ids come first, rows
    that share an id next to each other in an order of their text, each with its own start. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    path = path or fresh_path(docs.sparkSession, "tokens")
    starts = write_tokens(docs, path, tokenizer_path, end_id, id_col=id_col, text_col=text_col)
    return read_tokens(docs.sparkSession, path, starts, keep_ids)
