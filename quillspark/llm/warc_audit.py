"""WARC archives with a Merkle fixity audit between replicas.

Pages become WARC 1.1 records, a gzip member each, in files of bounded size. The index of an archive has every record's
file, place, offset, length and SHA-256, as written. A replica's tree has the SHA-256 of each record's bytes as leaves, then
nodes over FANOUT ordered neighbours that hash their offset range and their children, up to a file's root (bytes behind the
last record are a leaf of their own); above, a node for the files of each writing task in order, then for FANOUT tasks, and
so on up to one root. Each level is a folder of its own. The audit compares the two roots and joins, one level at a time,
only the children of nodes that differ; the leaves it ends at locate the corruption. What both replicas lack, or have
damaged alike, no comparison of replicas shows: records are held against the index when they are read back.
"""

from __future__ import annotations

import gzip
import os
import re
from hashlib import sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh_path, written
from quillspark.llm.files import make_dir, read_file, write_file

FANOUT, LEVELS, DATE = 16, 4, "1970-01-01T00:00:00Z"  # LEVELS above the records: 65,536 records a file at most


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """One WARC resource record. Null url and html are empty; a URL with control characters is quoted, and says so."""
    payload, target = (html or "").encode(), url or ""
    quoted = re.search(r"[\x00-\x20\x7f-\x9f]", target)
    head = [
        "WARC/1.1", "WARC-Type: resource", f"WARC-Target-URI: {quote(target) if quoted else target}", f"WARC-Date: {date}",
        f"WARC-Record-ID: <urn:sha256:{sha256(f'{page_id} {target} '.encode() + payload).hexdigest()}>", f"WARC-Payload-Digest: sha256:{sha256(payload).hexdigest()}",
        f"X-Page-Id: {'' if page_id is None else page_id}", *["X-Target-Quoted: 1"] * bool(quoted), "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, str, bytes]:
    """(page id, url, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    url = unquote(fields["WARC-Target-URI"]) if "X-Target-Quoted" in fields else fields["WARC-Target-URI"]
    return int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, url, rest[: int(fields["Content-Length"])]


INDEX = "file string, task int, rec int, offset long, length long, hash binary, page_id long"


def write_archive(pages: DataFrame, paths: list[str], file_bytes: int = 8_000_000, file_records: int = FANOUT**LEVELS) -> DataFrame:
    """Write pages (page_id, url, html) to a replica below each of paths; the index (INDEX), written.

    Every row is a record, repeated ones too; other columns are ignored. No rows, no files and an empty index.
    """
    for p in paths:
        make_dir(p)

    def run(batches):
        task, held, rows, size, count = TaskContext.get().partitionId(), [], [], 0, 0

        def close():
            nonlocal held, rows, size, count
            name = f"pages-{task:06d}-{count:06d}.warc.gz"
            for p in paths:
                write_file(f"{p}/{name}", held)
            kinds = (("offset", pa.int64()), ("length", pa.int64()), ("hash", pa.binary()), ("page_id", pa.int64()))
            places = {"file": pa.array([name] * len(rows)), "task": pa.array([task] * len(rows), pa.int32()), "rec": pa.array(range(len(rows)), pa.int32())}
            out = pa.RecordBatch.from_pydict(places | {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)})
            held, rows, size, count = [], [], 0, count + 1
            return out

        for b in batches:
            for page, url, html in zip(*(b.column(i) for i in range(3)), strict=True):
                data = gzip.compress(record(page.as_py(), url.as_py(), html.as_py()), 6, mtime=0)
                held.append(data)
                rows.append((size, len(data), sha256(b"\0" + data).digest(), page.as_py()))
                size += len(data)
                if size >= file_bytes or len(rows) >= file_records:
                    yield close()
        if rows:
            yield close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(run, INDEX), "warc-index")


def _places(index: DataFrame) -> DataFrame:
    """(file, task, at): the records' places of each file in order, a task's share of files each; contents are not shuffled."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.groupBy("file", "task").agg(F.sort_array(F.collect_list(F.struct("rec", "offset", "length", "hash", "page_id"))).alias("at")).repartition(tasks)


def tree(content: bytes, at: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bytes]]:
    """(level, node, first, end, hash) of a file: level 0 has the records (and what is behind them), level LEVELS the root."""
    spans = [(offset, offset + length) for _, offset, length in at]
    if len(content) > (end := spans[-1][1] if spans else 0):
        spans.append((end, len(content)))
    nodes = [(first, last, sha256(b"\0" + content[first:last]).digest()) for first, last in spans]
    out = [(0, i, *n) for i, n in enumerate(nodes)]
    for level in range(1, LEVELS + 1):
        groups = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)] if level < LEVELS else [nodes]
        nodes = [(g[0][0], g[-1][1], sha256(b"\1%d-%d" % (g[0][0], g[-1][1]) + b"".join(n[2] for n in g)).digest()) for g in groups if g]
        out += [(level, i, *n) for i, n in enumerate(nodes)]
    return out


def trees(path: str, index: DataFrame) -> DataFrame:
    """(level, file, task, node, first, end, hash) of all files of a replica and of what is above them; a missing file has no nodes.

    Levels above the files have no file and number their nodes by task, then by FANOUT tasks each, to one node. Written, a
    folder a level.
    """
    spark, out = index.sparkSession, fresh_path(index.sparkSession, "merkle")
    schema = "file string, task int, node int, first long, end long, hash binary, level int"

    def run(batches):
        for b in batches:
            for name, task, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                content = read_file(f"{path}/{name}")
                if content is not None:
                    rows = tree(content, [(x["rec"], x["offset"], x["length"]) for x in at.as_py()])
                    kinds = (("level", pa.int32()), ("node", pa.int32()), ("first", pa.int64()), ("end", pa.int64()), ("hash", pa.binary()))
                    cells = {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)}
                    yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(rows)), "task": pa.array([task] * len(rows), pa.int32()), **{k: cells[k] for k in ("node", "first", "end", "hash", "level")}})

    _places(index).mapInArrow(run, schema).write.partitionBy("level").parquet(out)
    read = lambda: spark.read.schema(schema).parquet(out)
    level, tasks = LEVELS, index.agg(F.max("task").alias("n")).first()["n"]
    while tasks is not None:
        number = F.col("task") if level == LEVELS else F.floor(F.col("task") / FANOUT).cast("int")
        children = F.transform(F.sort_array(F.collect_list(F.struct("file", "task", "hash"))), lambda c: F.concat(F.hex(c["hash"]), F.lit(" "), F.coalesce(c["file"], F.lit(""))))
        above = read().where(F.col("level") == level).withColumn("up", number).groupBy("up").agg(F.unhex(F.sha2(F.array_join(children, "\n"), 256)).alias("hash"))
        level += 1
        above.select(F.lit(None).cast("string").alias("file"), F.col("up").alias("task"), F.lit(0).alias("node"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("end"), "hash", F.lit(level).alias("level")).write.mode("append").partitionBy("level").parquet(out)
        if level > LEVELS + 1:
            tasks //= FANOUT
        if not tasks:
            break
    return read()


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, rec, first, end): the leaves that differ between two trees of one index, or that one of them lacks."""
    tops = [x.agg(F.max("level").alias("n")).first()["n"] for x in (a, b)]
    top = max((n for n in tops if n is not None), default=LEVELS)

    def level(k: int, under: DataFrame | None) -> DataFrame:
        sides = []
        for x, name in ((a, "a"), (b, "b")):
            x = x.where(F.col("level") == k)
            if under is not None:
                if k >= LEVELS:
                    up = [F.lit(None).cast("string"), F.col("task") if k == LEVELS else F.floor(F.col("task") / FANOUT).cast("int"), F.lit(0)]
                else:
                    up = [F.col("file"), F.col("task"), F.floor(F.col("node") / FANOUT).cast("int") if k + 1 < LEVELS else F.lit(0)]
                x = x.select("*", *(c.alias(n) for c, n in zip(up, ("pf", "pt", "pn"), strict=True)))
                x = x.join(under, x["pf"].eqNullSafe(under["uf"]) & (x["pt"] == under["ut"]) & (x["pn"] == under["un"]), "left_semi")
            sides.append(x.select(F.col("file").alias(f"f{name}"), F.col("task").alias(f"t{name}"), F.col("node").alias(f"n{name}"), F.struct("first", "end", "hash").alias(name)))
        both = sides[0].join(sides[1], F.col("fa").eqNullSafe(F.col("fb")) & (F.col("ta") == F.col("tb")) & (F.col("na") == F.col("nb")), "full")
        both = both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash")) | ~F.col("a.end").eqNullSafe(F.col("b.end")))
        return both.select(F.coalesce("fa", "fb").alias("uf"), F.coalesce("ta", "tb").alias("ut"), F.coalesce("na", "nb").alias("un"), "a", "b")

    found = level(top, None)
    for k in range(top - 1, -1, -1):
        found = level(k, written(found.select("uf", "ut", "un"), "mismatches"))
    return found.select(F.col("uf").alias("file"), F.col("un").alias("rec"), F.coalesce("a.first", "b.first").alias("first"), F.coalesce("a.end", "b.end").alias("end"))


def records(paths: list[str], index: DataFrame) -> DataFrame:
    """(file, rec, page_id, url, payload_bytes, payload_sha256, replica) of every record of the index.

    Read from the first of paths whose bytes have the hash of the index; replica is its number from 1. Where none has, url and payload
    are null and replica is 0.
    """

    def run(batches):
        kinds = (("rec", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("replica", pa.int32()))
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                found: dict[int, tuple] = {}
                for i, path in enumerate(paths, 1):
                    if len(found) < len(at) and (data := read_file(f"{path}/{name}")) is not None:
                        for x in at:
                            part = data[x["offset"] : x["offset"] + x["length"]]
                            if x["rec"] not in found and sha256(b"\0" + part).digest() == x["hash"]:
                                page, url, payload = parse(gzip.decompress(part))
                                found[x["rec"]] = (x["rec"], page, url, len(payload), sha256(payload).hexdigest(), i)
                rows = [found.get(x["rec"], (x["rec"], x["page_id"], None, None, None, 0)) for x in at]
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(rows)), **{k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)}})

    return _places(index).mapInArrow(run, "file string, rec int, page_id long, url string, payload_bytes long, payload_sha256 string, replica int")


def spoil(path: str, chosen: DataFrame) -> None:
    """Flip a bit in the middle of each chosen record (rows of the index) of a replica: what an audit has to find."""

    def run(batches):
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = bytearray(read_file(f"{path}/{name}") or b"")
                for x in at:  # a repeated task leaves spoilt records as they are
                    first, end = x["offset"], x["offset"] + x["length"]
                    if sha256(b"\0" + data[first:end]).digest() == x["hash"]:
                        data[(first + end) // 2] ^= 1
                write_file(f"{path}/{name}", [bytes(data)])
                yield pa.RecordBatch.from_pydict({"file": pa.array([name])})

    _places(chosen).mapInArrow(run, "file string").count()


def audit(paths: list[str], index: DataFrame) -> DataFrame:
    """records() of two replicas with intact: whether both have the record as written, by the trees and by the index."""
    bad = differing(trees(paths[0], index), trees(paths[1], index)).select("file", "rec", F.lit(False).alias("same"))
    out = records(paths, index).join(bad, ["file", "rec"], "left")
    return out.withColumn("intact", F.coalesce("same", F.lit(True)) & (F.col("replica") > 0)).drop("same")


def audited_archive(pages: DataFrame, path: str | None = None, spoilt: Column | None = None) -> DataFrame:
    """(page_id, url, payload_bytes, payload_sha256, intact, replica, file, rec): pages archived twice, audited and read back.

    One row per page, repeated ones too; null url and html are empty, a null page_id stays null; an empty table gives no
    rows. Texts of any length are one record each. spoilt: a condition on the index; the second replica's records that
    it holds for are damaged before the audit, as a drill.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    paths = [os.path.join(path, "replica-1"), os.path.join(path, "replica-2")]
    index = write_archive(pages, paths)
    if spoilt is not None:
        spoil(paths[1], index.where(spoilt))
    return audit(paths, index).select("page_id", "url", "payload_bytes", "payload_sha256", "intact", "replica", "file", "rec")
