"""Personal data, whitening and spelling variants: brute force, and nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import line_dedup, near_dedup, personal_data, queries, spelling, whitening
from tests.llm.test_operators import DOCS, LONG, TEXTS, docs_of


# 11
def luhn_sum(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))


def contract_spans(text):
    """The plain layer by its patterns alone, as they are written down."""
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = ((m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text))
    out += [("card", m.start(), m.end()) for m, d in cards if 13 <= len(d) <= 19 and luhn_sum(d) % 10 == 0]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def with_luhn(head):
    return next(head + str(c) for c in range(10) if luhn_sum(head + str(c)) % 10 == 0)


def noisy_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a.b", "@", "x@y.z", "@q.r", "1.2.3.4", ".5", "255", "256.1.1.1", "007.1.2.3", "+1 (663) 555-6869", "+", "-", " ", "\n", "é", "(", ")", "12", "4465758382889437", "5105 1051 0510 5100", "378282246310005", "ü@b.c", "%", "_", "0", "a-b@c-d.e-f.g"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_personal_data_plain_layer_is_the_contract(spark):
    texts = [*noisy_texts(1500, 4), *TEXTS]
    for t in texts:
        assert [(s.kind, s.start, s.end) for s in personal_data.find(t) if s.plain] == contract_spans(t), t
    kept = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["plain"]] for r in personal_data.document_spans(docs_of(spark, texts)).collect()}
    assert kept == {i: contract_spans(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("+1 (663) 555-6869 4465758382889437", {("phone", "+1 (663) 555-6869"), ("card", "4465758382889437")}), ("4465758382889437 4465758382889437", {("card", "4465758382889437")}), ("4465758382889436 4465758382889438", set()),
        ("Konto DE89 3704 0044 0532 0130 00.", {("iban", "DE89 3704 0044 0532 0130 00")}), ("DE88 3704 0044 0532 0130 00", set()), ("GB82WEST12345698765432", {("iban", "GB82WEST12345698765432")}), ("GB82WEST123456987654321", set()),
        ("ssn 078-05-1120", {("ssn", "078-05-1120")}), ("part no order 078-05-1120", set()), ("000-05-1120", set()), ("at 12:30:45", set()), ("host 2001:db8:0:0:1::5", {("ip6", "2001:db8:0:0:1::5")}), ("std::cout", set()),
        ("bob.k [at] mail [dot] example [dot] com", {("email", "bob.k [at] mail [dot] example [dot] com")}), ("look [at] me", set()), ("Tel. 030 1234 5678", {("phone", "030 1234 5678")}), ("030 1234 5678", set()), ("see 2019 2020 2021 2022", set()),
        ("call (743) 555-3824 today", {("phone", "(743) 555-3824")}), ("BE68 5390 0754 7034", {("iban", "BE68 5390 0754 7034")}),
    ],
)
def test_personal_data_scored_layer(text, found):
    assert {(s.kind, text[s.start : s.end]) for s in personal_data.find(text)} == found


def test_personal_data_scores_and_checks():
    assert personal_data.luhn(with_luhn("446575838288943")) and not personal_data.luhn("4465758382889436")
    assert all(personal_data.luhn(str(n)) == (luhn_sum(str(n)) % 10 == 0) for n in range(10, 3000))
    assert personal_data.mod97("BE68539007547034") and not personal_data.mod97("BE68539007547043")
    alone, told, against = (personal_data.find(t)[0].score for t in ("4465758382889437", "visa card 4465758382889437", "tracking order 4465758382889437"))
    assert against < alone < told <= 1


def test_personal_data_of_long_runs_takes_linear_time():
    for unit in ("a", "1", "1 ", "+1", "@", "a@", ".", "1.", "+1 (", "a[at]", "a:", "DE89", "0-", "a@b."):
        began = time.time()
        personal_data.find(unit * (200_000 // len(unit)))
        assert time.time() - began < 20, unit


def test_personal_data_query_and_redaction(spark, tmp_path):
    texts = [*noisy_texts(60, 8), None, "", LONG + " me@x.org", "IBAN DE89 3704 0044 0532 0130 00, me@x.org"]
    ids = [None, 1, 1, *range(2, len(texts) - 1)]
    df = docs_of(spark, texts, ids).withColumn("spans", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op11_personal_data(spark, str(tmp_path))
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in contract_spans(t)).encode()).hexdigest()
    want = sorted((i if i is not None else -1, *(sum(s[0] == k for s in contract_spans(t)) for k in ("email", "ip", "card", "phone")), digest(t), ",".join(f"{s.kind}:{s.start}:{s.end}" for s in personal_data.find(t))) for i, t in zip(ids, texts, strict=True))
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in out.collect()) == want
    red = {r["doc_id"]: r["text"] for r in personal_data.redact(df).where("doc_id > 1").collect()}
    assert red[ids[-1]] == "IBAN <IBAN>, <EMAIL>" and red[ids[-2]] == LONG + " <EMAIL>" and red[ids[-4]] is None and red[ids[-3]] == ""
    assert personal_data.redact(df).columns == df.columns
    assert personal_data.document_spans(docs_of(spark, [])).collect() == []


# 12
def vectors_of(spark, rows):
    return spark.createDataFrame([(n, v, 1, 2.0) for n, v in rows], "vec_id long, embedding array<float>, component int, whitened double")


def brute_whitened(rows):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    around = np.array([[float(int(n * c - s)) / n for c, s in zip(r, sums, strict=True)] for r in x])
    e, q = np.linalg.eigh(around.T @ around / n)
    order = np.argsort(-e)
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x], around, e[order], q[:, order]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening(spark, parts):
    rng = np.random.default_rng(parts)
    base = rng.normal(size=(600, 10)) * np.linspace(0.02, 0.4, 10) + rng.normal(size=(600, 1)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(3, base[3].tolist()), (None, base[4].tolist())]
    bad = [(900, None), (901, [None] * 10), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9), (904, []), (905, [1.0, 2.0])]
    got = whitening.whitened_components(vectors_of(spark, rows + bad).repartition(parts, "vec_id")).collect()
    n, deviation, around, e, q = brute_whitened(rows)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    want = around @ q[:, :8] / np.sqrt(e[:8])
    sign = {}
    for r in got:
        i = 4 if r["vec_id"] is None else r["vec_id"]
        k, w = r["component"] - 1, want[i, r["component"] - 1]
        assert r["deviation"] == deviation[i] == r["deviation_exact"] and abs(r["explained"] - e[k] / e.sum()) < 1e-10
        if abs(w) > 0.01:
            assert abs(abs(w) - abs(r["whitened"])) < 1e-7 and sign.setdefault(k, np.sign(w * r["whitened"])) == np.sign(w * r["whitened"])


def test_whitening_merges_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(100_000, 100_900, size=(500, 12))
    found = whitening.summary(x[:1])
    for first, last in ((1, 2), (2, 9), (9, 260), (260, 500)):
        found = whitening.merged(found, whitening.summary(x[first:last]))
    whole = whitening.summary(x)
    assert found.n == 500 and found.sums == [int(s) for s in x.sum(0)] == whole.sums and len(found.sv) == 12
    assert np.allclose(found.sv, whole.sv, rtol=1e-12) and np.allclose(np.abs(np.diag(found.vt @ whole.vt.T)), 1, atol=1e-9)


def test_whitening_of_little(spark):
    few = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.5]), (3, [1.0, 2.5, 3.0])]
    got = whitening.whitened_components(vectors_of(spark, few)).collect()
    assert len(got) == 6 and got[0]["identity_error"] < 1e-9  # the first dimension has no variance
    assert whitening.whitened_components(vectors_of(spark, few[:1] * 3)).collect() == []
    assert whitening.whitened_components(vectors_of(spark, [(1, None)])).collect() == []
    assert whitening.whitened_components(vectors_of(spark, [])).columns == whitening.whitened_components(vectors_of(spark, few)).columns


def test_deviations_of_large_numbers_are_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**20), 2**20, size=(50, 6))
    for n in (50, 10**9, 10**13):
        sums = [int(s) * (n // 50) for s in x.sum(0)]
        assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    df = spark.createDataFrame([("1",), (str(2**63 - 1),), (str(2**63),)], "d string").select(whitening.long_or_null(F.col("d").cast("decimal(38,0)")).alias("d"))
    assert [r["d"] for r in df.collect()] == [1, 2**63 - 1, None]


# 13
def brute_words(docs):
    count = {}
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] = count.get(w, 0) + 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    forms, out = {}, []
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(out, key=str)


def test_spelling_variants(spark):
    rng = random.Random(6)
    base = ["harbours", "lighthouse", "éclairer", "straße", "mentions", "aaaaaaab", "abababab", "quarterly", "ÀÀÀÀÀÀÀx"]

    def word():
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i, k = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + rng.choice("abéÿ" if k else [""]) + w[i + (k < 2) :]
        return w.capitalize() if rng.random() < 0.2 else w

    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(150)] + ["Harbours " * 3000, "harbourz harbourz harborz " * 8, None, "", "x" * 100_000, "1,2;×÷×÷×÷×÷"]
    ids = [*range(len(texts) - 3), 7, 7, None]
    got = spelling.spelling_variants(docs_of(spark, texts, ids), dent_every=31)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == brute_variants(brute_words(list(zip(ids, texts, strict=True))))
    assert any(r[1] for r in rows)


def test_spelling_chains_ties_and_empty_tables(spark):
    words = spark.createDataFrame([("aaaaaaa", 1000), ("aaaaaab", 100), ("aaaaabb", 10), ("aaaabbb", 1), ("zzzzzzz", 1000), ("zzzzzzy", 3), ("zzzzzza", 1000), ("alonely", 5)], "word string, n long")
    got = {r[0]: tuple(r)[1:] for r in spelling.variant_groups(words).collect()}
    assert got["aaaabbb"] == ("aaaaabb", "aaaaaaa", 1, 1, 10) and got["aaaaaab"][:2] == ("aaaaaaa", "aaaaaaa") and got["aaaaaaa"][:2] == (None, "aaaaaaa")
    assert got["zzzzzzy"] == ("zzzzzza", "zzzzzza", 3, 2, 1000) and got["alonely"] == (None, "alonely", 5, 0, None)
    assert spelling.variant_groups(words.limit(0)).collect() == [] and spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []


# 2 and near duplicates: keys that very many lines or texts share
def with_edits(words, at, rng):
    return [f"z{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]


def test_line_dedup_links_all_pairs_around_a_common_passage(spark):
    lines = []
    for size, common, at in ((20, 8, (9, 12, 15, 18)), (20, 8, (0, 9, 13, 17)), (30, 12, (13, 16, 19, 22, 25, 28))):
        rng, passage = random.Random(len(lines)), [f"common{common}x{i}" for i in range(common)]
        for _ in range(200):
            base = passage + [f"w{rng.randrange(10**9)}" for _ in range(size - common)]
            lines += [" ".join(base), " ".join(with_edits(base, at, rng))]
    rng = random.Random(3)
    for _ in range(120):  # short lines share characters, no runs of words
        tail = "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=16))
        lines += [f"Chapter the {tail} end", f"Chapter the {tail[:7]}y{tail[8:]} end"]
    out, count = line_dedup.dedup_lines(docs_of(spark, lines))
    assert {r["doc_id"] for r in out.where(f"{count} > 0").collect()} == set(range(1, len(lines), 2))


def test_near_duplicates_around_a_common_passage(spark):
    rng, passage = random.Random(1), [f"common{i}" for i in range(850)]
    texts = []
    for _ in range(200):
        base = passage + [f"w{rng.randrange(10**9)}" for _ in range(150)]
        texts += [" ".join(base), " ".join(with_edits(base, range(860, 1000, 7), rng))]
    kept = {r["doc_id"] for r in near_dedup.keep_first_of_groups(docs_of(spark, texts)).select("doc_id").collect()}
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert alike(0, 1) >= 0.8 > max(alike(0, i) for i in range(2, 400, 17))
    assert {i for i in range(0, 400, 2)} <= kept and len(kept) <= 210


def test_scores_need_no_text_exchange(spark):
    """F1, op8: texts meet the trusted ids once; steps leave no exchange files, and the kept rows are those of the verdicts."""
    import os

    from quillspark.llm import common, quality

    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(60 + i % 5))) for i in range(300)] + [(None, "x " * 60), (7, "a b c"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    verdicts = quality.quality_verdicts(docs, labels, quantile=0.3)
    plan = verdicts._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan  # before, texts stood on a side of the join
    kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in verdicts.where("kept").collect())
    assert kept and kept == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in quality.keep_documents(docs, labels, quantile=0.3).collect())
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: sum(f.startswith("shuffle_") for top in local for d, _, names in os.walk(top) for f in names)
    before = files()
    common.written(docs.repartition(5, "doc_id"), "freed")
    assert files() <= before  # before, they stayed until a garbage collection


def test_frequent_runs_are_counted_over_all_lines(spark):
    """F7, op2: a run is frequent from 8 in every 5,000 documents on, exactly, wherever its documents stand."""
    import numpy as np
    import xxhash
    from pyspark.sql import functions as F

    from quillspark.llm import line_dedup as L

    words = [["one", "two", "three", "four"], ["five", "six", "seven", "eight"]]
    text = F.concat_ws(" ", *(F.concat(F.lit(c), F.col("id")) for c in "pqrst"))
    said = F.when(F.col("id") % 600 == 1, " ".join(words[0])).when((F.col("id") % 600 == 2) & (F.col("id") < 18_602), " ".join(words[1]))  # 34 and 31 of 20,000
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", text, said).alias("text"))
    codes = [np.array([xxhash.xxh64_intdigest(w.encode(), 7) for w in ws], np.uint64) for ws in words]
    held = []
    for n in (3, 7):
        signatures = L.line_signatures(docs.repartition(n, "doc_id"), 2, 0.8, "doc_id", "text")
        held.append(L.frequent_runs(signatures, 20_000))
    assert (held[0] == held[1]).all()
    q = [q for _, _, n, q in L._kinds(np.arange(1), np.arange(9, dtype=np.uint64), np.array([9]), 0.8) if len(n)]
    assert len(q) == 1
    runs = [[int(r % np.uint64(L.BUCKETS)) for r in L.runs_of(c ^ np.uint64(q[0]), np.array([4]), q[0])[0]] for c in codes]
    assert all(held[0][i] for i in runs[0]) and not any(held[0][i] for i in runs[1])


def test_rarest_tokens_in_parts(spark):
    """F1, op2: keys dealt to parts give the same second keys as all at once, and no part's exchanges outlive it."""
    from quillspark.llm import components

    rows = spark.createDataFrame([(k, n) for k in range(40) for n in range(k % 5, 12)], "k long, node long")
    tokens = spark.createDataFrame([(n, [n % 3, 10 + n % 4, 20 + n % 2, 30 + n], 2) for n in range(12)], "node long, tokens array<long>, most int")
    got = [sorted(map(tuple, components.rarest_tokens(rows, tokens, parts).collect())) for parts in (1, 8)]
    want = []
    for k in range(40):
        held = {n: [n % 3, 10 + n % 4, 20 + n % 2, 30 + n] for n in range(k % 5, 12)}
        times = lambda t, held=held: sum(t in x for x in held.values())
        want += [(k, n, t) for n, x in held.items() for t in sorted(x, key=lambda t: (times(t), t))[:2] if times(t) > 1]
    assert got[0] == got[1] == sorted(want)
    assert components.rarest_tokens(rows.limit(0), tokens.limit(0)).count() == 0


def test_second_keys_of_large_keys_are_the_same(spark, monkeypatch):
    """pipeline, op2: keys that no task may hold get the second keys of those that are sorted in one; tokens of any sign."""
    from quillspark.llm import components

    rows = spark.createDataFrame([(k, n) for k in (3, 8) for n in range(k, 40)], "k long, node long")
    tokens = spark.createDataFrame([(n, [n % 3 - 1, 10 + n % 4, 20 + n % 2, -30 - n], 1 + n % 3) for n in range(40)], "node long, tokens array<int>, most int")
    got = []
    for together in (1 << 23, 140, 0):
        monkeypatch.setattr(components, "TOGETHER", together)
        got.append(sorted(map(tuple, components.rarest_tokens(rows, tokens, 2).collect())))
    assert len(got[0]) > 50 and got[0] == got[1] == got[2]


def test_line_groups_leave_no_intermediate_tables(spark):
    """pipeline, op2: tables that no later step reads are gone; before, keys, lines and members of all steps stayed on disk."""
    import os

    from quillspark.llm import line_dedup as L

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    common = " ".join(f"common{i}" for i in range(20))
    own = F.concat_ws(" ", *(F.substring(F.md5(F.concat(F.lit(c), F.floor(F.col("id") / 2).cast("string"))), 1, 9) for c in "abcdefghijklmnopqrst"))
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(common), own, F.concat(F.lit("end"), F.col("id"))).alias("text"))
    out, count = L.dedup_lines(docs)
    assert out.where(f"{count} = 1").count() == 50
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert not left & {"line-keys", "lines", "lines-of-large-keys", "line-members", "unlinked", "tokens", "fine-keys", "fine-pairs"}, left


def test_keys_of_one_passage_meet_once(spark, monkeypatch):
    """pipeline, op2: the keys of one passage become one, a pair is verified once; before, each pair met once a key, word and part."""
    from quillspark.llm import components

    held = [(k, n) for k in range(60) for n in range(100) if (n * 7 + k) % 40] + [(k, n) for k in range(60, 64) for n in range(200 + k, 300)]
    rows = spark.createDataFrame([(k, n, k + n, n % 9 if n % 3 else 0, 0) for k, n in held], "k long, node long, place int, root long, main long")
    got = components.merged_keys(rows, F.col("k").bitwiseAND(1) == 1, {"place": F.lit(255)}).collect()
    nodes, olds = {}, {}
    for r in got:
        nodes.setdefault(r["k"], {})[r["node"]] = r
    for k, n in held:
        olds.setdefault(k, set()).add(n)
    assert all(any(old <= set(new) and k % 2 == new_k % 2 for new_k, new in nodes.items()) for k, old in olds.items())
    assert len(got) == sum(map(len, nodes.values())) < len(held) / 5
    assert all(r["place"] == 255 or (r["place"] - r["node"], r["node"]) in held for r in got)
    for new in nodes.values():
        roots = [r["root"] for r in new.values()]
        assert {roots.count(r["main"]) for r in new.values()} == {max(map(roots.count, roots))}

    rng, passage, counts, put = random.Random(5), [f"common{i}" for i in range(30)], {}, components.written

    def counted(df, name):
        out = put(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(components, "written", counted)
    own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
    lines = []
    for _ in range(100):
        base = passage + rng.sample(own, 20)
        lines += [" ".join(base), " ".join(with_edits(base, (31, 34, 37, 40, 43, 46, 49), rng))]
    out, count = line_dedup.dedup_lines(docs_of(spark, lines))
    assert {r["doc_id"] for r in out.where(f"{count} > 0").collect()} >= set(range(1, len(lines), 2))
    assert len(counts["fine-links"]) == 1 and 0 < sum(counts["fine-keys"]) <= 200 * 25 and len(counts["fine-pairs"]) <= 2, counts


@pytest.mark.parametrize("meeting", [1 << 20, 20])
def test_pairs_of_second_keys_equal_brute_force(spark, monkeypatch, meeting):
    """F1, pipeline: a pair that shares many second keys comes out once a key; before, once a second key, with the square of a group."""
    from quillspark.llm import components

    rng = random.Random(meeting)
    of = {n: (rng.randrange(8, 13), rng.choice([0, 0, 0, n, 50 + n % 3])) for n in range(60)}
    held = sorted({(k, n, rng.randrange(-4, 5)) for k in (1, 2) for n in range(60) for _ in range(5)})
    rows = spark.createDataFrame([(k, n, x, *of[n], 0) for k, n, x in held], "k long, node long, k2 long, n int, root long, main long")
    monkeypatch.setattr(components, "MEETING", meeting)
    got = sorted(map(tuple, components.pairs_of_second_keys(rows, 0.8).collect()))
    fit = lambda a, b: a > b and of[a][1] != of[b][1] and (of[a][1] or of[b][1]) and min(of[a][0], of[b][0]) >= 0.8 * max(of[a][0], of[b][0])
    assert got == sorted({(a, b) for k, a, x in held for j, b, y in held if k == j and x == y and fit(a, b)}) and got
    one = [c.to_numpy() if hasattr(c, "to_numpy") else c for c in ([x for _, _, x in held], [n for _, n, _ in held], [of[n][0] for _, n, _ in held], [of[n][1] for _, n, _ in held])]
    import numpy as np

    parts = list(components._met([np.array(c) for c in one] + [np.array([of[n][1] == 0 for _, n, _ in held])], 0.8, 7))
    assert {p for b in parts for p in zip(*(c.to_pylist() for c in b.columns), strict=True)} >= set(got)


def test_edits_within_equals_a_table():
    """F2, op2: Spark's levenshtein took a second and more a pair of long lines; vectors of bits give the same."""
    rng = random.Random(6)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    for _ in range(2000):
        a, b, most = *("".join(rng.choices("abđ\U00010001", k=rng.randrange(0, 30))) for _ in range(2)), rng.randrange(0, 25)
        assert line_dedup.edits_within(a, b, most) == min(table(a, b), most + 1)


def test_lines_that_signs_tell_apart_are_not_exchanged(spark, monkeypatch):
    """F1, pipeline: pairs around a passage took their texts through two exchanges each; now lengths and signs rule most out."""
    counts, put = {}, line_dedup.written

    def counted(df, name):
        out = put(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    rng, lines, passage = random.Random(7), [], [f"common{i}" for i in range(10)]
    for _ in range(20):
        base = passage + [f"w{rng.randrange(10**9)}" for _ in range(20)]
        lines += [" ".join(base), " ".join(with_edits(base, (12, 17, 22, 27), rng))]
    monkeypatch.setattr(line_dedup, "written", counted)
    out, count = line_dedup.dedup_lines(docs_of(spark, lines))
    assert {r["doc_id"] for r in out.where(f"{count} > 0").collect()} == set(range(1, 40, 2))
    assert 20 <= sum(counts["possible-pairs"]) <= 40, counts


def test_signs_rule_out_no_similar_pair(spark):
    """possible_pairs keeps every pair that similar admits, short lines and long ones."""
    rng = random.Random(8)
    alphabet = "abcdefgh"
    words = lambda n: ["".join(rng.choices(alphabet, k=rng.randrange(2, 7))) for _ in range(n)]
    docs = []
    for _ in range(150):
        base = words(rng.choice([2, 3, 5, 8, 12, 30, 80]))
        line = " ".join(base)
        at = [rng.randrange(len(line)) for _ in range(int(len(line) * rng.random() * 0.25))]
        edited = "".join(rng.choice(alphabet) if i in at and c != " " else c for i, c in enumerate(line))
        kept = [w for w in base if rng.random() > 0.12] or base
        docs += [line, edited, " ".join(kept)]
    docs = list(dict.fromkeys(docs))
    table = docs_of(spark, docs)
    wanted = spark.createDataFrame([(i, (i, 0)) for i in range(len(docs))], "h long, p struct<doc:long,pos:int>")
    th = table.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"))
    wanted = wanted.join(th, F.col("p.doc") == F.col("d")).select("h", F.struct(F.col("d").alias("doc"), "th", F.col("p.pos").alias("pos")).alias("place"))
    texts = line_dedup.written(line_dedup._fetched(table, wanted, "doc_id", "text"), "signed-lines")
    pairs = spark.createDataFrame([(a, b) for a in range(len(docs)) for b in range(max(0, a - 6), a)], "u long, v long")
    signs = {}
    sign = lambda x: "".join(chr(0x10000 + signs.setdefault(w, len(signs))) for w in x.split())
    want = {(a, b) for a, b in map(tuple, pairs.collect()) if line_dedup.similar(sign(docs[a]), sign(docs[b]), docs[a], docs[b], 0.8)}
    got = set(map(tuple, line_dedup.possible_pairs(pairs, texts, 0.8).collect()))
    assert len(want) > 100 and want <= got and len(got) < pairs.count() / 2
    assert set(map(tuple, line_dedup.similar_lines(pairs, texts, 0.8).collect())) == want


def test_near_duplicates_lose_no_pair(spark):
    """F5, pipeline: every pair at 0.801 around a passage that makes all others 0.77 alike; bands of minima lost some of them."""
    rng, passage, texts = random.Random(11), [f"common{i}" for i in range(870)], []
    for _ in range(100):
        base = passage + [f"w{rng.randrange(10**9)}" for _ in range(130)]
        texts += [" ".join(base), " ".join(with_edits(base, range(871, 1000, 6), rng))]
    kept = {r["doc_id"] for r in near_dedup.keep_first_of_groups(docs_of(spark, texts)).select("doc_id").collect()}
    assert kept == set(range(0, 200, 2))


def test_near_groups_equal_brute_force_at_any_similarity(spark):
    """F5, pipeline: texts of few and many shingles, pairs of unlike size among them."""
    rng, texts = random.Random(12), []
    for _ in range(60):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 6, 9, 14, 40]))]
        texts += [" ".join(base), " ".join(base[rng.randrange(3) :]), " ".join(with_edits(base, {rng.randrange(len(base))}, rng)), " ".join(base + base[: rng.randrange(4)])]
    sets = [{tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} for w in (t.split() for t in texts)]
    for similarity in (0.5, 0.8):
        root = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                    x, y = root[a], root[b]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        kept = {r["doc_id"] for r in near_dedup.keep_first_of_groups(docs_of(spark, texts), 2, similarity).select("doc_id").collect()}
        assert kept == set(root)
