"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

A fingerprint has 64 bits: bit b is set where more than half of a text's shingle hashes (XXH64, seed 42) have it set.
Exact copies of a fingerprint collapse first, so a group of any size is one row. Each distinct fingerprint then gets a
pivot distance table: its Hamming distances to PIVOTS fixed reference fingerprints, packed in two longs. By the triangle
inequality two fingerprints within r bits differ by r at most in every coordinate, so a pair whose largest coordinate
difference exceeds r is discarded; survivors are verified bit by bit.

The table alone would have to be compared row against row. What proposes pairs is an equi-join on block keys: of five
blocks, r = 3 differing bits leave two untouched, so the ten two-block keys lose no pair. Spark can split their hot keys.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.components import connected_components

PIVOTS = 16
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def reference_fingerprints(n: int = PIVOTS) -> list[int]:
    """Fixed pivots: XXH64 of the texts pivot-0, pivot-1, ... as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot-{i}".encode(), 42)).astype(np.int64)) for i in range(n)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words, repeats included; a shorter text is one shingle, an empty one has none.

    Words are split at ASCII white space and only A-Z change case, so bytes do.
    """
    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits of the hashes as a signed long; zero for none. Works through 65,536 hashes at a time."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; null and blank texts have fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _bits(x: Column, start: int, n: int) -> Column:
    return F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << n) - 1))


def pivot_table(fp: Column) -> tuple[Column, Column]:
    """Hamming distances (0 to 64) of fp to the reference fingerprints, a byte each, eight to a long."""
    d = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in reference_fingerprints()]
    lo, hi = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(8):
        lo = lo.bitwiseOR(F.shiftleft(d[i], 8 * i))
        hi = hi.bitwiseOR(F.shiftleft(d[8 + i], 8 * i))
    return lo, hi


def coordinates_within(a: Column, b: Column, r: int) -> Column:
    """Whether no byte of the packed distances a and b differs by more than r."""
    ok = F.abs(_bits(a, 0, 8) - _bits(b, 0, 8)) <= r
    for i in range(1, 8):
        ok = ok & (F.abs(_bits(a, 8 * i, 8) - _bits(b, 8 * i, 8)) <= r)
    return ok


def close_pairs(distinct: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b) fingerprints, a < b, that differ in 1 to max_distance (3 at most) bits, each pair once.

    distinct: a column fp without repeats. Candidates share two of five blocks; the pivot tables discard, bits verify.
    """
    if not 0 < max_distance <= 3:
        raise ValueError("two of five blocks are untouched by 3 differing bits at most")
    fp = F.col("fp")
    combos = list(combinations(range(5), 2))
    keys = [_bits(fp, *BLOCKS[i]).bitwiseOR(F.shiftleft(_bits(fp, *BLOCKS[j]), 13)).bitwiseOR(F.lit(c << 26)) for c, (i, j) in enumerate(combos)]
    lo, hi = pivot_table(fp)
    rows = distinct.select("fp", lo.alias("lo"), hi.alias("hi"), F.explode(F.array(*keys)).alias("k"))
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp"))
    on = on & coordinates_within(F.col("a.lo"), F.col("b.lo"), max_distance) & coordinates_within(F.col("a.hi"), F.col("b.hi"), max_distance)
    pairs = a.join(b, on).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def simhash_components(docs: DataFrame, words: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; component_id is the least id linked through fingerprints.

    Null, blank and one-word texts are treated like any other; rows with a null id get a component among the others and
    never name it (a component of null ids only is null). Repeated rows share a component. Texts of any
    length are read whole, in parts. Other columns are ignored.
    """
    fps = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = connected_components(close_pairs(distinct.select("fp"), max_distance).select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
