"""The ten operators on small tables: brute force, round trips, and nulls, empties, ties, repeats and clashing columns."""

import glob
import os
import random
import warnings
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import chat_format, language_id, line_dedup, mixing, near_dedup, packing, quality, simhash, token_store, topk_search, warc_audit
from quillspark.llm.common import fresh_path
from quillspark.llm.components import connected_components
from quillspark.llm.tokenizer import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i} und so weiter," for i in range(3000))
TEXTS = ["", None, " \n\t", "one", "one two", "one two three", "One TWO three", "a\n\nb", "é ü 漢字 😀", LONG, LONG, "x " * 5000]
DOCS = "doc_id long, text string, lang string, id int, row int, words string, kept boolean, p double"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 1, 2, "w", True, 0.5) for i, t in zip(ids, texts, strict=True)], DOCS)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# 1
def brute_top_k(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), n) for n, w in rows if n != q and len(w) == len(v)))
        out += [(q, i + 1, n, -s) for i, (s, n) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4096, 2])
def test_top_k(spark, block_rows):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(400)]
    rows += [(500 + i, rows[i % 5][1]) for i in range(60)]
    bad = [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0]), (1200, [2.0, 1.0]), (1300, [])]
    df = spark.createDataFrame([(n, v, 1) for n, v in rows + bad], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0, 10, block_rows=block_rows).collect())
    clean = [(n, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for n, v in rows + [(1100, [1.0, 2.0]), (1200, [2.0, 1.0]), (1300, [])]]
    assert got == brute_top_k(clean, [r for r in clean if r[0] % 100 == 0], 10)
    assert topk_search.top_k(df.limit(0), F.lit(True)).collect() == []


def test_top_k_large_numbers(spark):
    df = spark.createDataFrame([(i, [float(i) * 1e6, -1e6]) for i in range(30)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") == 0, 3).collect())
    rows = [(i, [1024 * i * 10**6, -1024 * 10**6]) for i in range(30)]
    assert got == brute_top_k(rows, rows[:1], 3)


# 2
def test_line_dedup(spark):
    rng = random.Random(9)
    base = "The quarterly report describes seventeen harbours " + " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(60))
    texts = [f"{base}.\nOwn line number one\nx", f"{base}!\nOther words entirely here\nx", base.replace("seventeen", "eighteen") + "\n\nTail piece", None, "", "x\nx\nx", "Own LINE number one"]
    out, count = line_dedup.dedup_lines(docs_of(spark, texts).withColumn("n_removed", F.lit(7)))
    got = {r["doc_id"]: (r["text"], r[count]) for r in out.collect()}
    assert count == "_n_removed" and got[0] == (texts[0], 0) and got[1] == ("Other words entirely here\nx", 1) and got[2] == ("\nTail piece", 1)
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[5] == ("x\nx\nx", 0) and got[6] == ("", 1)
    assert out.columns[:8] == docs_of(spark, []).columns
    again = docs_of(spark, ["a b c\nd e f", "a b c\nd e f", "a b c"], [1, 1, None])
    assert sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.dedup_lines(again)[0].collect()) == [(-1, "a b c"), (1, "d e f"), (1, "d e f")]
    assert line_dedup.dedup_lines(docs_of(spark, []))[0].count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def lines_left(spark, lines):
    return {r["doc_id"] for r in line_dedup.dedup_lines(docs_of(spark, lines))[0].where("text <> ''").collect()}


def test_line_dedup_of_lines_with_one_long_word(spark):
    rng = random.Random(1)
    rows = [" ".join(["measurements", *(str(rng.randrange(100, 999)) for _ in range(8))]) for _ in range(30)]
    near = [r.rsplit(" ", 1)[0] + " 7" for r in rows]
    assert lines_left(spark, rows + near) == set(range(30))


def test_line_dedup_finds_all_pairs_similar_in_words(spark):
    rng = random.Random(5)
    word, lines = lambda: rng.choice(["the", "of", "and"] + [f"w{i}" for i in range(300)]), []
    for n in [*range(2, 26), 30, 41, 60] * 3:
        base = [word() for _ in range(n)]
        lines.append(" ".join(base))
        for most in (n // 5, max(1, n // 10)):
            other = list(base)
            for _ in range(most):
                k, i = rng.randrange(3), rng.randrange(len(other))
                other[i : i + (k > 0)] = [word()] if k < 2 else []
            lines.append(" ".join(other))
    parent, cut = list(range(len(lines))), [x.split() for x in lines]
    for j in range(len(lines)):
        for i in range(j):
            n = max(len(cut[i]), len(cut[j]))
            most = max(len(lines[i]), len(lines[j]))
            share = 5 if n < line_dedup.FEW else 10  # of lines of five words or more, characters may differ in half as many
            if abs(len(cut[i]) - len(cut[j])) * 5 <= n and edits(cut[i], cut[j]) * 5 <= n or most <= line_dedup.SHORT and edits(lines[i], lines[j]) * share <= most:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    first = {find(parent, i) for i in range(len(lines))}
    left = lines_left(spark, lines)
    assert left <= first and len(first - left) <= 1  # beyond SHORT, lines similar in characters alone may be linked too


def test_line_dedup_of_short_lines_and_characters(spark):
    typos = "quarterly reports describe seventeen northern harbours without mentioning lighthouse keepers"
    lines = ["Chapter twelve", "Chapter twelwe", "Chapter ninety", "end of part one now", "end of part onе now", "漢字文字列", "漢字文字列", "漢字文字列の長い行です", "漢字文字列の長い行でし", typos, typos.replace("qu", "ku").replace("seventeen", "sevemteen").replace("keepers", "keeperz")]
    assert lines_left(spark, lines) == {0, 2, 3, 5, 7, 9}


# 3
def test_encoder_is_exact():
    rng, parts = random.Random(1), ["a", "b", " ", "  ", "\n", "\n ", "\t", " ", "é", "́", "1", "'s", "!", "<|endoftext|>", "　", "漢", "\x1c", "\x85", "İ", "Σ", "\r\n", ".", "A"]
    for path, words_only in ((BYTE, False), (WORD, True)):
        e = Encoder(path, words_only, max_cached=50)
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [LONG, "z" * 3000]
        for i in range(0, len(texts), 100):
            assert e.ids(texts[i : i + 100]) == e.whole(texts[i : i + 100])


def test_fullest_and_pack():
    rng = random.Random(5)
    for _ in range(40):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        used = packing.fullest(dict(Counter(lengths)), max(lengths), 31)
        sums = {max(lengths)}
        rest = sorted(lengths)[:-1]
        for n in rest:
            sums |= {s + n for s in sums if s + n <= 31}
        assert sum(n * k for n, k in used.items()) == max(sums) and all(Counter(lengths)[n] >= k for n, k in used.items())
    pieces = [(i, 0, rng.randint(1, 31)) for i in range(300)]
    windows, tails = packing.pack(pieces, 32)
    assert all(sum(p[2] for p in w) == 32 for w in windows) and all((n := sum(p[2] for p in t)) & (n - 1) == 0 for t in tails)
    assert sorted((k, s + j) for w in windows + tails for k, s, n in w for j in range(n)) == sorted((k, j) for k, _, n in pieces for j in range(n))


def check_pieces(rows, texts, capacity=2048):
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at == rs[0]["sequence_length"]


def test_pack_documents(spark):
    rows = packing.pack_documents(docs_of(spark, TEXTS), BYTE).collect()
    check_pieces(rows, dict(enumerate(TEXTS)))
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack_documents(docs_of(spark, []), BYTE).count() == 0
    assert {r["doc_id"] for r in packing.pack_documents(docs_of(spark, ["a", "b"], [None, 1]), BYTE, keep_ids=False).collect()} == {None, 1}


# 4
def test_codes():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.zeros(5), rng.integers(0, 49408, 5000), rng.integers(0, 2**32, 700), rng.geometric(0.001, 3000)):
        ids = ids.astype("<u4")
        codes = token_store.Codes(b"".join(token_store.encode(ids, [3, None], np.array([2, len(ids)]), 9)))
        assert (codes.decode() == ids).all() and codes.doc_ids == [3, None] and codes.first == 9
        assert [codes.get(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    lengths = np.bincount([1] * 90 + [9] * 10, minlength=33)
    assert token_store.best_widths(lengths) == [1, 8]


def test_token_store(spark):
    ids = [5, 3, 9, None, 7, 1, 2, 4, 6, 8, 0, 0]
    rows = token_store.token_store(docs_of(spark, TEXTS, ids).repartition(3), WORD).collect()
    t = Tokenizer.from_file(WORD)
    start, want = 0, []
    for i, text in sorted(zip(ids, TEXTS, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted((tuple(r)[:4] for r in rows), key=lambda r: r[1]) == want
    assert token_store.token_store(docs_of(spark, []), WORD).collect() == []


# 5
def test_escape():
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice(["<", "[", "\\", "|", "/s>", "s>", "INST]", "/INST]", "<|turn|>", "a", "\n"]) for _ in range(rng.randint(0, 9)))
        assert chat_format.unescape(chat_format.escape(s)) == s
        assert not any(m in chat_format.escape(s) for m in (chat_format.TURN, chat_format.TEXT, chat_format.END, "</s>", "[INST]", "[/INST]"))


def test_chat_format(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(1, 1, "assistant", " \n lead and trail \n"), (1, 0, "user", None), (1, 2, "user", "q"), (1, 3, "assistant", ""), (1, 4, "assistant", "é😀<|end|>!!"), (2, 0, None, "x"), (-7, 0, "user", said), (-7, 1, "assistant", said), (3, None, "assistant", "t"), (3, None, "assistant", "t"), (None, 0, "user", "u")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df, BYTE)).collect()}
    for c in (1, 2, 3, -7, None):
        rows = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        loss = "".join(t[3] or "" for t in rows if t[2] == "assistant")
        want = sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in rows).encode()).hexdigest()
        assert (out[c]["n_turns"], out[c]["turns_sha256"], out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(rows), want, len(loss), sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(df.limit(0), BYTE).count() == 0


# 6
def test_warc(spark):
    pages = [(1, "http://a/", "<p>é</p>"), (2, None, None), (None, "u\r\nX: y%0D", ""), (1, "http://a/", "<p>é</p>"), (5, "z", "y" * 100_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int").repartition(2)
    rows = warc_audit.audited_archive(df).collect()
    want = [(p, u or "", len((h or "").encode()), sha256((h or "").encode()).hexdigest(), True) for p, u, h in pages]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    assert warc_audit.audited_archive(df.limit(0)).collect() == []


def test_warc_finds_corruption(spark):
    path = fresh_path(spark, "warc")
    df = spark.range(0, 700).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html")).coalesce(1)
    index = warc_audit.write_archive(df, [f"{path}/a", f"{path}/b"])
    at = {r["rec"]: r for r in index.collect()}
    file = glob.glob(f"{path[7:]}/b/*.gz")[0]
    data = bytearray(open(file, "rb").read())
    for i in (0, 17, 699):
        data[at[i]["offset"] + at[i]["length"] // 2] ^= 1
    with open(file, "wb") as f:
        f.write(bytes(data) + b"more")
    bad = warc_audit.differing(warc_audit.trees(f"{path}/a", index), warc_audit.trees(f"{path}/b", index)).collect()
    assert sorted(r["rec"] for r in bad) == [0, 17, 699, 700]
    got = warc_audit.audit([f"{path}/b", f"{path}/a"], index).collect()
    assert {r["rec"] for r in got if not r["intact"]} == {0, 17, 699} == {r["rec"] for r in got if r["replica"] == 2} and all(r["url"] == "u" for r in got)
    os.remove(file)
    lost = warc_audit.differing(warc_audit.trees(f"{path}/a", index), warc_audit.trees(f"{path}/b", index))
    assert lost.count() == 700


def test_warc_lost_and_damaged_in_both(spark):
    path = fresh_path(spark, "warc")
    df = spark.range(0, 40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html")).repartition(40, "page_id")
    index = warc_audit.write_archive(df, [f"{path}/a", f"{path}/b"])
    for side in "ab":
        warc_audit.spoil(f"{path}/{side}", index.where("page_id = 7"))
    warc_audit.spoil(f"{path}/b", index.where("page_id in (9, 11)"))
    gone = {r["page_id"]: r["file"] for r in index.collect()}
    lost = {p for p, f in gone.items() if f == gone[3]}
    for side in "ab":
        os.remove(f"{path[7:]}/{side}/{gone[3]}")
    got = {r["page_id"]: (r["intact"], r["replica"]) for r in warc_audit.audit([f"{path}/a", f"{path}/b"], index).collect()}
    assert {p for p, (ok, _) in got.items() if not ok} == lost | {7, 9, 11} and len(got) == 40
    assert {p for p, (_, n) in got.items() if n == 0} == lost | {7}
    tree = warc_audit.trees(f"{path}/a", index)
    assert tree.where(F.col("level") == tree.agg(F.max("level")).first()[0]).count() == 1


# 7
def test_posteriors_equal_one_pass():
    rng, n = np.random.default_rng(0), 4
    lengths = np.array([1, 3, 700, 1500, 512, 513, 2])
    scores, moves, at = rng.normal(size=(lengths.sum(), n)) * 2, rng.normal(size=(n, n)), 0
    got = language_id.posterior_sums(scores, lengths, moves)
    for i, size in enumerate(lengths):
        e, a = np.exp(scores[at : at + size]), np.exp(moves)
        f, b, v = np.zeros((size, n)), np.ones((size, n)), np.full(n, 1 / n)
        for t in range(size):
            v = (v @ a) * e[t]
            f[t] = v = v / v.sum()
        for t in range(size - 2, -1, -1):
            b[t] = a @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        g = f * b
        assert np.abs((g / g.sum(1, keepdims=True)).sum(0) - got[i]).max() < 1e-9
        at += size


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.train(language_id.training_rows(docs, fold != 1), max_words=60_000)
    out = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold == 1)
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    odd = language_id.predict(docs_of(spark, [None, "", "123 ²!", "the and of with", LONG]), model)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in odd.collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.train([]) is None and language_id.predict(docs_of(spark, ["a"]), None).first()["lang_pred"] == "und"
    assert language_id.predict(docs_of(spark, []), model).count() == 0 and language_id.training_rows(docs.limit(0), F.lit(True)) == []


def test_training_rows_hold_rare_languages(spark):
    sizes = {f"l{k}": 3000 for k in range(9)} | {"rare": 20}
    docs = spark.createDataFrame([(f"text {lang} {i}", lang) for lang, n in sizes.items() for i in range(n)], "text string, lang string")
    got = Counter(lang for _, lang in language_id.training_rows(docs, F.lit(True), max_docs=400))
    assert got["rare"] == 20 and sum(got.values()) == 400 and set(got.values()) == {20, 42, 43}
    assert {lang for _, lang in language_id.training_rows(docs, F.lit(True), max_docs=4)} == set(sizes)


# 8
def test_quality(spark):
    rng = random.Random(4)
    texts = [*TEXTS, " ".join(rng.choice("abc") for _ in range(400)), "same line here\n" * 40, "a b c a b c d e f", "#$% |&<>* x"]
    labels = spark.createDataFrame([(9, 1, 0), (9, 1, 0), (12, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.quality_verdicts(docs_of(spark, texts), labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        w = t.replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        c, seen = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                seen |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(seen))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(seen) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = sorted(r["doc_id"] for r in rows if r["kept"])
    assert sorted(r["doc_id"] for r in quality.keep_documents(docs_of(spark, texts), labels).collect()) == kept
    assert quality.quality_verdicts(docs_of(spark, []), labels.limit(0)).count() == 0


def test_quality_score_is_the_ratio_without_the_own_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    tables = quality.log_ratios(docs, labels, 256)
    grams = docs.select("doc_id", quality.buckets(quality.words_of(F.col("text")), 256).alias("g"))
    fold = {r["id"]: r["fold"] for r in quality.trusted_ids(labels).collect()}
    assert set(fold) == {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()} and set(fold.values()) == set(range(quality.FOLDS))
    raw, held = Counter(), {r["doc_id"]: r["g"] for r in grams.collect()}
    for g in held.values():
        raw.update(g)
    want = []
    for k in (None, *range(quality.FOLDS)):
        target = Counter(b for i, g in held.items() if i in fold and fold[i] != k for b in g)
        want.append([np.log((target[b] + 1) / (target.total() + 256)) - np.log((raw[b] + 1) / (raw.total() + 256)) for b in range(256)])
    assert np.allclose(tables, want)
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs, labels, n_buckets=256, quantile=0.2).collect()}
    scores = {i: np.mean([want[1 + fold[i] if i in fold else 0][b] for b in g]) for i, g in held.items() if g}
    assert all((r["llr"] is None and i not in scores) or np.isclose(r["llr"], scores[i]) for i, r in got.items())
    least = np.percentile([scores[i] for i, r in got.items() if i in fold and not r["base_failed"]], 20)
    assert all(r["kept"] == (not r["base_failed"] and scores[i] >= least - 1e-12) for i, r in got.items())


def test_quality_keeps_rows_of_the_fit_and_others_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean, half = labels.where("quality = 1 and toxic = 0"), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = quality.quality_verdicts(docs, labels.where(half)).join(clean.withColumn("fitted", half), "doc_id").where("not base_failed")
    kept = {r["fitted"]: r["k"] for r in rows.groupBy("fitted").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[True] >= 0.95 and kept[False] >= 0.95


# 9
def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    domains = mixing.label_domains(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    out, mixer = mixing.mix(docs, domains, {"clean": 0.9, "low": 0.05, "toxic": 0.05})
    rows = out.collect()
    assert len(rows) == 1000 and all(r["rate"] >= 0 for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    reached = [sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) / total for d in mixer.domains]
    assert np.allclose(reached, mixer.wanted, atol=2e-4) and all(abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in rows)
    shares = np.array(reached) / sum(reached)
    assert np.allclose(shares, [0.9, 0.05, 0.05], atol=1e-3)
    copied = mixing.mixed_documents(docs, domains, {"clean": 0.9, "low": 0.05, "toxic": 0.05})
    assert Counter(r["doc_id"] for r in copied.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]}) and copied.columns == docs.columns


def test_mixing_reaches_the_least_squares_optimum(spark):
    rng = np.random.default_rng(6)
    tokens, p = rng.integers(1, 400, 30), rng.dirichlet([0.6, 0.3, 0.2], 30)
    narrow = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "n_tokens long, p array<double>").coalesce(1)
    share = tokens[:, None] * p / tokens.sum()
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.0, "b": 0.05, "c": 0.95}):
        mixer = mixing.Mixer(["a", "b", "c"], [0.0] * 3, [])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            mixing.fit_rates(narrow, mixer, weights, budget=float(tokens.sum()))
        want, rates = np.array([weights[x] for x in "abc"]), np.ones(30)
        for _ in range(200_000):
            rates = np.maximum(0, rates - 4 * share @ (rates @ share - want))
        best = ((rates @ share - want) ** 2).sum()
        assert ((np.array(mixer.reached) - want) ** 2).sum() <= 1.1 * best + 1e-7, weights


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    out, _ = mixing.mix(docs_of(spark, TEXTS), none, {"a": 1.0})
    assert {(r["rate"], r["copies"]) for r in out.collect()} == {(1.0, 1)}
    two = spark.createDataFrame([(9, "a"), (11, "b")], "doc_id long, domain string")
    out, _ = mixing.mix(docs_of(spark, TEXTS), two, {"a": 0.5, "b": 0.5})
    assert {r["doc_id"]: r["copies"] for r in out.collect()}[0] == 1 and out.count() == len(TEXTS)
    assert mixing.mix(docs_of(spark, []), two, {"a": 1.0})[0].count() == 0
    with pytest.raises(ValueError, match="weight"):
        mixing.mix(docs_of(spark, TEXTS), two, {"c": 1.0})


# 10
def plain_fingerprint(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_simhash(spark):
    rows = simhash.simhash_components(docs_of(spark, TEXTS)).collect()
    prints = {r["doc_id"]: r["fp"] % 2**64 for r in rows}
    assert prints == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)} and len(rows) == len(TEXTS)
    parent = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: find(parent, i) for i in parent}
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0
    odd = simhash.simhash_components(docs_of(spark, ["a b c", "a b c", "z"], [None, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in odd) == [(-1, -1), (-1, 4), (4, 4)]


def test_close_pairs_are_complete(spark):
    rng = random.Random(6)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(5):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert {(r["a"], r["b"]) for r in simhash.close_pairs(df).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (100, 102), (100, 102)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_groups(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(6)]
    texts = [*base, base[0].upper().lower(), base[0].replace(base[0].split()[60], "changed"), " ".join(base[1].split()[:110]), " ".join(base[2].split()[:60]), None, "", base[3], "one two"]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    parent = {i: i for i in range(len(texts))}
    for i in parent:
        for j in range(i):
            if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    docs = docs_of(spark, texts)
    kept = near_dedup.keep_first_of_groups(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(parent, i) for i in parent}) and kept.columns == docs.columns
    assert near_dedup.keep_first_of_groups(docs.union(docs)).count() == kept.count() and near_dedup.keep_first_of_groups(docs.limit(0)).count() == 0


def test_near_groups_of_texts_with_repeats(spark):
    rng, texts = random.Random(4), []
    for i in range(12):
        plain = [f"t{i}w{rng.randrange(10**6)}" for _ in range(204)]
        texts += [" ".join(plain), " ".join(plain[:100] + plain[100:105] * 40 + plain[105:])]
    kept = near_dedup.keep_first_of_groups(docs_of(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == set(range(0, 24, 2))


def test_target_is_fitted_on_all_trusted_rows(spark):
    """F8: the first 20,000 ids by hash alone were trusted."""
    from quillspark.llm import quality

    labels = spark.range(25_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality.trusted_ids(labels).count() == 25_000 and quality.trusted_ids(labels, 10).count() == 10
