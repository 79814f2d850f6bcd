"""Queries of leftover script and of source pieces. The tables have no mixed scripts, so three letters of all documents are
written as characters of another script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import segments
from quillspark.operators import leftovers as L
from quillspark.plans.registry import Tables, query

#: Characters that stand for q, w and h, and their readings.
READINGS = {"存": "tồn", "护": "hộ", "途": "đồ"}
TERM, RIGHT = "护途", "Wh"
_WORD = r"([\p{L}\p{N}])"


def mixed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.translate("text", "qwh", "".join(READINGS)).alias("text"))


@query(f"""with a as (select doc_id, translate(text, 'qwh', '{"".join(READINGS)}') as x from documents),
b as (select doc_id, x, (length(x) - length(replace(x, '{TERM}', ''))) // 2 as by_terms, replace(regexp_replace(regexp_replace(regexp_replace(x, '{_WORD}{TERM}', '\\1 {TERM}', 'g'), '{TERM}{_WORD}', '{TERM} \\1', 'g'), '{TERM}{_WORD}', '{TERM} \\1', 'g'), '{TERM}', '{RIGHT}') as y from a),
c as (select doc_id, by_terms, length(y) - length(translate(y, '{"".join(READINGS)}', '')) as by_reading, regexp_replace(regexp_replace(regexp_replace(y, '([^\\P{{L}}存护途]|\\p{{N}})([存护途])', '\\1 \\2', 'g'), '([存护途])([^\\P{{L}}存护途]|\\p{{N}})', '\\1 \\2', 'g'), '([存护途])', '\\1 ', 'g') as z from b)
select doc_id, by_terms::int as by_terms, by_reading::int as by_reading, md5(regexp_replace(regexp_replace(replace(replace(replace(z, '存', 'Tồn'), '护', 'Hộ'), '途', 'Đồ'), '(Tồn|Hộ|Đồ) ([^\\p{{L}}\\p{{N}}]|$)', '\\1\\2', 'g'), '[ \\t]{{2,}}', ' ', 'g')) as text_md5 from c""")
def leftovers_replaced(t: Tables) -> DataFrame:
    """Whole texts with what is left of a script replaced by a glossary form or by readings."""
    terms = t.region.select(F.lit(TERM).alias("term"), F.lit(RIGHT).alias("right"), F.lit(True).alias("approved")).distinct()
    readings = t.region.select(F.explode(F.array(*(F.struct(F.lit(c).alias("char"), F.array(F.lit(r)).alias("readings")) for c, r in READINGS.items()))).alias("x")).select("x.*").distinct()
    return L.without_leftovers(mixed(t), "text", terms, readings).select("doc_id", "by_terms", "by_reading", F.md5("text").alias("text_md5"))


@query()
def source_pieces(t: Tables) -> DataFrame:
    """All lines of all documents in pieces of at most 64 tokens, with their numbers of tokens."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "source"))
    rows = lines.withColumn("p", segments.source_pieces(F.col("source"), path, 64)).withColumn("n", segments.token_counts(F.col("p"), path))
    return rows.select("doc_id", "line", F.posexplode(F.arrays_zip("p", "n")).alias("nth", "x")).select("doc_id", "line", "nth", F.length("x.p").alias("n_chars"), F.col("x.n").alias("n_tokens"), F.md5("x.p").alias("piece_md5"))
