"""The queries opN_<name> of this package, each thin: read tables, call the operator, pick the columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat_format, language_id, line_dedup, mixing, packing, personal_data, quality, simhash, spelling, token_store, topk_search, warc_audit, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors for every hundredth vector."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that fuzzy dedup leaves it."""
    out, count = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", count)


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 ids."""
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as directly addressable codes and read back."""
    return token_store.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, masked and read back."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return chat_format.read_back(chat_format.format_conversations(turns.union(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived in two replicas, every 97th damaged in the second, audited and read back from the sound copy."""
    out = warc_audit.audited_archive(table(spark, sf_dir, "pages"), spoilt=F.pmod("page_id", F.lit(97)) == 0)
    return out.select("page_id", "url", "payload_bytes", "payload_sha256", "intact", "replica")


OP6_SQL = """
select page_id, coalesce(url, '') as url, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
  sha256(coalesce(html, '')) as payload_sha256, coalesce(page_id % 97 <> 0, true) as intact, 1::int as replica
from pages
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned on two of three folds."""
    docs = table(spark, sf_dir, "documents")
    fold = lambda c: F.crc32(F.col(c).cast("string")) % 3
    model = language_id.train(language_id.training_rows(docs, fold("doc_id") != 1))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the importance verdict of every document."""
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


#: Shares of the expected tokens by domain of the labels table.
MIX_WEIGHTS = {"clean": 0.96, "toxic": 0.02, "low": 0.02}


def op9_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")), MIX_WEIGHTS)[0]


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the plain layer, all spans."""
    out = personal_data.document_spans(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(personal_data.written_out(plain), 256).alias("base_sha256"), personal_data.written_out(F.col("spans")).alias("spans"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every usable vector."""
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), dent_every=31)


OP13_SQL = """
with recursive t as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, j: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as t
), r as (
  select doc_id, run, count(*) as c from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) as run from documents
  ) where length(run) >= 7 group by all
), h as (
  select run, c, xor(list_reduce(flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda s: case when unicode(s) < 128 then [unicode(s)::bigint] else [192 + (unicode(s) >> 6), 128 + (unicode(s) & 63)] end)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295) as h, doc_id is null as lone
  from r, t
), w as (
  select word, sum(c)::bigint as n from (
    select case when not lone and h % 31 = 0 then run[: (h % length(run))::int] || run[(h % length(run))::int + 2 :] else run end as word, c from h
  ) where length(word) >= 7 group by word having sum(c) >= 2
), k as (
  select word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: word[: i - 1] || word[i + 1 :])))) as key from w
), near as (
  select distinct a.word, a.n, b.word as near, b.n as near_n from k a join k b on a.key = b.key and a.word <> b.word
  where length(a.word) <> length(b.word) or list_sum(list_transform(list_zip(string_split(a.word, ''), string_split(b.word, '')), lambda p: (p[1] <> p[2])::int)) = 1
), f as (
  select word, n, count(*) as n_near, max(near_n) as form_n, min(near) filter (near_n = most) as form
  from (select *, max(near_n) over (partition by word) as most from near) group by word, n
), g as (select word, form, form_n from f where form_n >= 10 * n),
chain as (select word, form as last from g union all select c.word, g.form from chain c join g on c.last = g.word),
root as (select word, last from chain where last not in (select word from g))
select w.word, g.form, coalesce(root.last, w.word) as root, w.n, coalesce(f.n_near, 0)::bigint as n_near, g.form_n::bigint as form_n
from w left join f using (word) left join g using (word) left join root using (word)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_top_k, op2_line_dedup, op3_pack_documents, op4_token_store, op5_chat_format, op6_warc_fixity, op7_language_id, op8_quality_rules, op9_mix_to_targets, op10_simhash_near_dedup)
    return {f.__name__: f for f in (*found, op11_personal_data, op12_whitening, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op6_warc_fixity": OP6_SQL, "op13_spelling_variants": OP13_SQL}
