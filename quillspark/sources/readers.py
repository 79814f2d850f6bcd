"""Sources: tolerant JSON lines, TSV with several values, sectioned text pairs, packs in zip files, blobs, ranges."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the lines (with their file) that don't; blank lines are neither."""
    raw = spark.read.text(path).where(F.trim("value") != "").select("value", F.input_file_name().alias("file"))
    parsed = raw.withColumn("row", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed.where(~bad).select("row.*").drop("_bad"), parsed.where(bad).select("file", F.col("value").alias("line"))


def read_multi_tsv(spark: SparkSession, path: str, preferred: dict[str, str] | None = None) -> DataFrame:
    """(key, values) of `key TAB v1|v2`; lines with # are comments; a preferred value goes first."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split("value", "\t").alias("p")).where("size(p) >= 2")
    values = F.filter(F.transform(F.split(F.get("p", F.lit(1)), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(F.trim(F.get("p", F.lit(0))).alias("key"), values.alias("values"))
    if preferred:
        wanted = F.element_at(F.create_map(*[F.lit(x) for kv in preferred.items() for x in kv]), F.col("key"))
        rows = rows.withColumn("values", F.when(wanted.isNull(), F.col("values")).otherwise(F.concat(F.array(wanted), F.array_remove("values", wanted))))
    return rows


def read_text_pairs(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """(file, header map, source, target) of whole files with `--- NAME ---` sections under `key: value` lines."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    part = lambda name: F.trim(F.regexp_replace(F.regexp_extract("value", rf"(?s)---\s*{name}\s*---\n(.*?)(?=\n---|\z)", 1), r"^\s+|\s+$", ""))
    head = F.filter(F.split(F.substring_index("value", "---", 1), "\n"), lambda x: x.rlike(r"^\w+:"))
    header = F.map_from_entries(F.transform(head, lambda x: F.struct(F.substring_index(x, ":", 1), F.trim(F.regexp_replace(x, r"^\w+:", "")))))
    return raw.select("file", header.alias("header"), part(source).alias("source"), part(target).alias("target"))


def read_zip_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(file, member, nth, line) of every member with the suffix; each archive is read by one task, line by line."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in sorted(m for m in z.namelist() if m.endswith(suffix)):
                        with z.open(member) as f:
                            part: list[tuple[int, str]] = []
                            for i, line in enumerate(io.TextIOWrapper(f, "utf-8")):
                                if line.strip():
                                    part.append((i, line.rstrip("\n")))
                                if len(part) == 4096:
                                    yield _batch(name, member, part)
                                    part = []
                            if part:
                                yield _batch(name, member, part)

    def _batch(name, member, part):
        return pa.RecordBatch.from_pydict({"file": [name] * len(part), "member": [member] * len(part), "nth": pa.array([i for i, _ in part], pa.int32()), "line": [x for _, x in part]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, member string, nth int, line string")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of whole text files named by id."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("id"), F.col("value").alias("text"))


def ranges(spark: SparkSession, specs: str) -> DataFrame:
    """(novel_id, chapter_index) of `NOVEL:START:COUNT` specs, separated by spaces."""
    s = spark.range(1).select(F.explode(F.split(F.lit(specs), r"\s+")).alias("s")).where("s <> ''").select(F.split("s", ":").cast("array<long>").alias("p"))
    return s.select(F.get("p", F.lit(0)).alias("novel_id"), F.explode(F.expr("sequence(p[1], p[1] + p[2] - 1)")).alias("chapter_index"))


def from_specs(wanted: DataFrame, stores: list[DataFrame], keys: tuple[str, ...] = ("novel_id", "chapter_index"), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Wanted rows with the text of the first store that has it, and those that none has."""
    out = wanted
    for i, s in enumerate(stores):
        out = out.join(s.select(*keys, F.col(text).alias(f"_{i}")), list(keys), "left")
    out = out.withColumn(text, F.coalesce(*(F.nullif(F.trim(f"_{i}"), F.lit("")) for i in range(len(stores))))).drop(*(f"_{i}" for i in range(len(stores))))
    return out.where(F.col(text).isNotNull()), out.where(F.col(text).isNull()).drop(text)
