"""Quality rules and hashed n-gram importance, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 3-word windows of every whole text. The method's verdict is
a log-likelihood ratio: words and word pairs are hashed into BUCKETS buckets; a trusted target and the raw corpus each
give a multinomial over them (add-one smoothed, counted over all rows); a text's score is the mean over its n-grams of
log p(target) - log p(raw). A trusted row is scored without the counts of its own fold of the trusted rows, so a
verdict doesn't tell who was in the fit. Texts meet the trusted ids in one exchange, for the counts, at any size the same; scores under either
table are told of every row, so only they meet the ids again. The threshold is a quantile of those held-out scores and the same for every
row; a verdict never depends on draws or on row order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import freed_exchanges, written

BUCKETS, FOLDS = 1 << 14, 3
#: Share of the trusted rows past the base rules that may fall below the threshold.
QUANTILE = 0.01
SPACE = r"[\x20\x09-\x0D]+"


def _shl(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n)


def let(value: Column, body) -> Column:
    """Evaluate value once for each row and hand it to body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found twice or more.

    Window hashes are sorted with their place in the low bits; equal neighbours, compared word by word, mark the places;
    what the marked windows cover is summed over their sorted starts. Linear but for the sorts, whatever repeats.
    """

    def marked(w: Column, width: Column, mask: Column, codes: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            i, j = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
            equal = _shr(x.bitwiseXOR(y), width) == 0
            for k in range(n):
                equal = equal & (F.get(w, i + k) == F.get(w, j + k))
            return F.coalesce(equal, F.lit(False))

        hit = F.filter(codes, lambda c, k: same(c, F.get(codes, k + 1)) | same(c, F.get(codes, k - 1)))
        return F.sort_array(F.transform(hit, lambda c: c.bitwiseAND(mask)))

    def covered(p: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("end"))
        step = lambda a, x: F.struct((a["t"] + x + n - F.greatest(a["end"], x)).alias("t"), (x + n).alias("end"))
        return F.aggregate(p, first, step, lambda a: a["t"])

    def count(w: Column) -> Column:
        def within(width: Column, mask: Column) -> Column:
            code = lambda i: _shl(_shr(F.xxhash64(*(F.get(w, i + k) for k in range(n))), width), width).bitwiseOR(i.cast("long"))
            codes = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - n), code))
            return let(let(codes, lambda c: marked(w, width, mask, c)), covered)

        bits = F.ceil(F.log2(F.size(w).cast("double") + 1)).cast("int")
        masked = lambda width: let(_shl(F.lit(1).cast("long"), width) - 1, lambda mask: within(width, mask))
        return F.when(F.size(w) >= n, let(bits, masked)).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words array, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row.

    A null text has no words. A text fails with fewer than 50 words or with over half its words in repeated windows.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"), words_of(t).alias("words"))
    zero = F.lit(0).cast("long")
    out = out.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.aggregate("words", zero, lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"), n_repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets(words: Column, n_buckets: int = BUCKETS) -> Column:
    """Buckets of every word and of every pair of neighbours."""
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(n_buckets)).cast("int")

    def pairs(w: Column) -> Column:
        at = F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.transform(w, lambda x: place(x)), F.transform(at, lambda i: place(F.get(w, i), F.get(w, i + 1))))

    return let(words, pairs)


def _fold(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(FOLDS)).cast("int")


def trusted_ids(labels: DataFrame, max_trusted: int | None = None) -> DataFrame:
    """(id, fold): all ids with quality 1 and toxic 0, or with max_trusted the first by hash.

    The target is fitted on them; joins take their side as Spark finds it, so it need not fit a broadcast.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    if max_trusted is not None:
        good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    return good.select(F.col("doc_id").alias("id"), _fold(F.col("doc_id")).alias("fold"))


def log_ratios(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, max_trusted: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[list[float]]:
    """log p(target) - log p(raw) of each bucket: from all trusted rows, then FOLDS tables that each leave one fold of them out.

    Raw counts cover every row of docs, add-one smoothing covers the rest. Without a trusted row every ratio is 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(trusted_ids(labels, max_trusted).hint("merge"), "id", "left")
    grams = rows.select("fold", F.explode(buckets(words_of(F.col("text")), n_buckets)).alias("b"))
    in_fold = [F.count(F.when(F.col("fold") == k, 1)).alias(f"f{k}") for k in range(FOLDS)]
    with freed_exchanges(docs.sparkSession):
        counted = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), *in_fold).collect()  # n_buckets rows at most
    raw, folds = [1] * n_buckets, [[0] * n_buckets for _ in range(FOLDS)]
    for r in counted:
        raw[r["b"]] += r["raw"]
        for k in range(FOLDS):
            folds[k][r["b"]] = r[f"f{k}"]
    target = [1 + sum(x) for x in zip(*folds, strict=True)]
    if sum(target) == n_buckets:
        return [[0.0] * n_buckets] * (FOLDS + 1)

    def table(t: list[int]) -> list[float]:
        shift = math.log(sum(t)) - math.log(sum(raw))
        return [math.log(x) - math.log(r) - shift for x, r in zip(t, raw, strict=True)]

    return [table(target), *(table([x - y for x, y in zip(target, f, strict=True)]) for f in folds)]


def scores(words: Column, ratios: list[list[float]], fold: Column) -> Column:
    """(all, own): mean log ratio of a text's n-grams under the table of all trusted rows and under its fold's; null for a text without words.

    Both are told of every row, so that texts need not wait for a join that says which rows are trusted.
    """
    tables = [F.split(F.lit(",".join(f"{x:.7g}" for x in t)), ",").cast("array<double>") for t in ratios]  # each folded to one literal
    chosen = tables[0]
    for k, t in enumerate(tables[1:]):
        chosen = F.when(fold == k, t).otherwise(chosen)
    mean = lambda g, m: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(m, b)) / F.size(g)

    def both(g: Column) -> Column:
        own = let(chosen, lambda m: mean(g, m))
        return F.when(F.size(g) > 0, F.struct(mean(g, tables[0]).alias("all"), own.alias("own")))

    return let(buckets(words, len(ratios[0])), both)


def _sound(w: Column) -> Column:
    return (F.size(w) >= 50) & (100 * n_repeat_words(w) <= 50 * F.size(w))


def judged(rows: DataFrame, labels: DataFrame, quantile: float, max_trusted: int | None) -> DataFrame:
    """Rows (id, sound, s, ...) with llr, own of trusted rows and all of others, and kept: sound and llr at the threshold or above.

    The threshold is the quantile of the trusted sound rows' own scores, -infinity without such rows. rows is a written table.
    """
    named = rows.join(trusted_ids(labels, max_trusted), "id", "left").withColumn("llr", F.when(F.col("fold").isNull(), F.col("s.all")).otherwise(F.col("s.own")))
    found = named.where("fold is not null and sound").agg(F.percentile("llr", quantile).alias("t")).first()["t"]
    kept = F.col("sound") & F.coalesce(F.col("llr") >= (-math.inf if found is None else found), F.lit(False))
    return named.withColumn("kept", kept).drop("s", "fold")


def quality_verdicts(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, n_buckets: int = BUCKETS, max_trusted: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the base counts, base_failed, llr and kept.

    kept is false where a base rule fails, else llr >= threshold (see judged). Null and blank texts have no words, so they fail;
    repeated rows get the same verdict; an empty table gives no rows. Other columns are ignored, whatever their names.
    Texts of any length are counted whole. Rows with a null id are in no fold.
    """
    ratios = log_ratios(docs, labels, n_buckets, max_trusted, id_col, text_col)
    kind = labels.schema["doc_id"].dataType
    rows = base_rules(docs, id_col, text_col).withColumn("s", scores(F.col("words"), ratios, _fold(F.col("doc_id").try_cast(kind))))
    rows = written(rows.drop("words").withColumnRenamed("doc_id", "id").withColumn("sound", ~F.col("base_failed")), "scored")
    return judged(rows, labels, quantile, max_trusted).withColumnRenamed("id", "doc_id").drop("sound")


def keep_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, n_buckets: int = BUCKETS, max_trusted: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose verdict is kept. Cases as for quality_verdicts()."""
    ratios = log_ratios(docs, labels, n_buckets, max_trusted, id_col, text_col)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), words_of(text).alias("words"))
    told = lambda w: F.struct(_sound(w).alias("sound"), scores(w, ratios, _fold(F.col("id").try_cast(labels.schema["doc_id"].dataType))).alias("s"))
    scored = written(rows.select("id", "th", let(F.col("words"), told).alias("x")).select("id", "th", "x.*"), "scored")
    kept = judged(scored, labels, quantile, max_trusted).where("kept").select(F.col("id").alias("i"), F.col("th").alias("t"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    return rows.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_semi").select("row.*")
