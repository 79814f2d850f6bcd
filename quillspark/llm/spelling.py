"""Spelling variants of words, grouped under their most frequent neighbour by a symmetric-delete join.

Every word emits itself and its distinct single deletions; two words share a key if and only if one is the other less a
code point, or both are after one deletion each. The join on keys proposes, an exact distance of one confirms. Two words
at distance one share exactly one key, so no pair is counted twice, and a key's words are bounded by the alphabet and its
length whatever the number of documents: they all arise from it by one insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dented(word: Column, hashed: Column, every: int) -> Column:
    """word less its code point hashed % length where `every` divides hashed: typing errors that can be told again."""
    at = (hashed % F.length(word)).cast("int")
    return F.when(hashed % every == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, dent_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of at least least_length code points that occur least_count times or more.

    Only A-Z change case. With dent_every a run of a document loses a code point where that number divides the crc32 of
    `<id>:<run>`; runs of rows with a null id stay whole. Null and blank texts have no words; repeated rows count each.
    """
    runs = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(runs).alias("word"))
    rows = rows.select("id", F.translate("word", UPPER, LOWER).alias("word"))
    if dent_every:
        hashed = F.coalesce(F.crc32(F.encode(F.concat("id", F.lit(":"), "word"), "UTF-8")), F.lit(1))
        rows = rows.select(dented(F.col("word"), hashed, dent_every).alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words(word, n) that differ by one inserted, deleted or replaced code point, both ways."""
    deleted = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)))
    keyed = words.select("word", "n", F.explode(F.array_union(F.array("word"), deleted)).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") != F.col("b.word")))
    met = met.where(F.levenshtein("a.word", "b.word", 1) == 1)
    return met.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def roots_of(forms: DataFrame, max_rounds: int = 8) -> DataFrame:
    """(word, root) of forms(word, form): the end of each chain, by jumping twice as far in every round.

    A form must be more frequent than its word by a factor of 2 at least, so chains end: 63 steps, 6 rounds, are the most
    that counts of 63 bits allow. Raises if they don't.
    """
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        further = known.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if known.join(further, "root", "left_semi").isEmpty():
            return known
        known = written(known.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
    raise RuntimeError(f"chains of forms didn't end in {max_rounds} rounds")


def variant_groups(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n): form is the near word of largest n (ties: the smallest in
    code-point order) if that n is factor times the word's or more, else null; root is where forms lead, or the word.

    words has each word once. A word without near words has n_near 0; an empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("a factor below 2 doesn't keep chains of forms short")
    words = written(words.select("word", "n"), "words")
    near = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= factor * F.col("n")
    near = written(near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "near-words")
    roots = roots_of(near.where("form is not null"))
    rows = words.join(near, "word", "left").join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, factor: int = 10, dent_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variant_groups() of the words of whole texts, see word_counts()."""
    return variant_groups(word_counts(docs, least_length, least_count, dent_every, id_col, text_col), factor)
