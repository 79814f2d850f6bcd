"""Leftover script and source pieces: literals and brute force."""

import random
import re

import ahocorasick
import pytest
from pyspark.sql import functions as F

from quillspark.functions import segments
from quillspark.operators import leftovers as L

READINGS = {"囚": "Tù", "垂": "Thuỳ", "途": "Đồ", "存": "Tồn", "护": "Hộ", "丹": "Đan"}


def automaton(terms):
    a = ahocorasick.Automaton()
    for t, r in terms.items():
        a.add_word(t, (t, {None: (r, True)}))
    a.make_automaton()
    return a


def test_by_readings():
    cases = [("Trên áo còn chữ 囚.", "Trên áo còn chữ Tù.", 1), ("Cành liễu rủ 垂 xuống.", "Cành liễu rủ Thuỳ xuống.", 1), ("Vết thương phun 鲜血 tung tóe.", "Vết thương phun máu tươi tung tóe.", 2), ("Nhận được vật phẩm 鲜血 trong kho đồ.", "Nhận được vật phẩm Tiên Huyết trong kho đồ.", 2),
             ("Hắn đánh rơi vật phẩm. Vết thương phun 鲜血 tung tóe.", "Hắn đánh rơi vật phẩm. Vết thương phun máu tươi tung tóe.", 2), ("Bình linh dược vỡ, tay hắn chảy 鲜血.", "Bình linh dược vỡ, tay hắn chảy máu tươi.", 2), ("Nhận được 【鲜血】.", "Nhận được 【Tiên Huyết】.", 2), ("Hắn luyện thành 鲜血丹.", "Hắn luyện thành Tiên Huyết Đan.", 3),
             ("Kẻ mệnh途 hành giả.", "Kẻ mệnh Đồ hành giả.", 1), ("Bung sức mạnh存护 ra.", "Bung sức mạnh Tồn Hộ ra.", 2), ("a㜽b", "a 㜽 b", 0)]
    for text, want, n in cases:
        assert L.by_readings(text, READINGS) == (want, n)


def test_by_glossary():
    assert L.by_glossary("Toàn bộ sức mạnh存护 ngay. HP h", automaton({"存护": "Tồn Hộ", "存": "x", "h": "H"})) == ("Toàn bộ sức mạnh Tồn Hộ ngay. HP h", 1)
    assert L.by_glossary("存护存途", automaton({"存护": "A", "途": "B"})) == ("A 存 B", 2)


def in_turn(text, terms):
    """One term after the other, longest first, each occurrence padded where it stands."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out, last = [], 0
        for m in re.finditer(re.escape(term), text):
            new, a, b = terms[term], text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
            out += [text[last : m.start()], " " * (a.isalnum() and new[:1].isalnum()), new, " " * (b.isalnum() and new[-1:].isalnum())]
            last = m.end()
        text = "".join([*out, text[last:]])
    return re.sub(r"[ \t]{2,}", " ", text)


def test_by_glossary_equals_one_term_after_the_other():
    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choices("存护途囚 ab.", k=rng.randrange(0, 25)))
        terms = {"".join(rng.choices("存护途囚", k=rng.randrange(1, 4))): rng.choice(["X", "y z", "-q-"]) for _ in range(4)}
        assert L.by_glossary(text, automaton(terms))[0] == in_turn(text, terms), (text, terms)


def test_without_leftovers(spark):
    terms = spark.createDataFrame([("存护", "Tồn Hộ", True, None), ("囚", "tù", False, "nghi sai")], "term string, right string, approved boolean, note string")
    table = spark.createDataFrame([(c, [r.lower(), "zz"]) for c, r in READINGS.items()], "char string, readings array<string>")
    lines = spark.createDataFrame([(1, "mạnh存护 囚"), (2, "Hán 㜽"), (3, "không"), (4, None), (5, ""), (6, "【鲜血】")], "left_id long, t string")
    got = {r["left_id"]: (r["t"], r["by_terms"], r["by_reading"], r["left"]) for r in L.without_leftovers(lines, "t", terms, table).collect()}
    assert got == {1: ("mạnh Tồn Hộ Tù", 1, 1, False), 2: ("Hán 㜽", 0, 0, True), 3: ("không", 0, 0, False), 4: (None, 0, 0, False), 5: ("", 0, 0, False), 6: ("【Tiên Huyết】", 1, 0, False)}
    p = spark.createDataFrame([("a", "B", "c"), ("a ", "B", "."), ("1", "-B", "x"), ("", "B", "")], "a string, b string, c string")
    assert [r[0] for r in p.select(L.padded(F.col("a"), F.col("b"), F.col("c"))).collect()] == [" B ", "B", "-B ", "B"]


# pieces
def tokens(text):
    """Two letters a token within words, everything else one each: counts grow with the text."""
    return sum((len(m[0]) + 1) // 2 for m in re.finditer(r"[a-z]+|[^a-z]", text))


def longest_head(text, limit):
    best = max((i for i in range(1, len(text) + 1) if tokens(text[:i]) <= limit), default=1)
    at = best
    while at > 1 and at < len(text) and re.fullmatch("[A-Za-z0-9]{2}", text[at - 1 : at + 1]):
        at -= 1
    return best if at == 1 and best > 1 and at < len(text) and re.fullmatch("[A-Za-z0-9]{2}", text[:2]) else at


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_hard_split_is_longest_heads(limit):
    rng = random.Random(limit)
    for _ in range(400):
        text = "".join(rng.choices("abc漢字，。 ", k=rng.randrange(1, 60)))
        pieces = segments.hard_split(text, limit, tokens)
        assert "".join(pieces) == text and all(tokens(p) <= limit for p in pieces)
        rest = text
        for p in pieces:
            assert p == (rest if tokens(rest) <= limit else rest[: longest_head(rest, limit)])
            rest = rest[len(p) :]


def test_split_source():
    line = "他说：“走吧！快！”然后走了。真的？ok"
    assert segments.sentences(line) == ["他说：“走吧！快！”然后走了。", "真的？", "ok"] and segments.sentences("") == [""] and segments.sentences("「a。b") == ["「a。b"]
    assert segments.split_source(line, 100, tokens) == segments.sentences(line)
    pieces = segments.split_source("一二三四，五六七八，九十。ZX001Q BOSS", 6, tokens)
    assert pieces == ["一二三四，", "五六七八，", "九十。", "ZX001Q", " BOSS"]


def test_source_pieces_column(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "one two three. " * 40), (2, None), (3, ""), (4, "x" * 5000)], "id long, t string")
    rows = df.select("id", segments.source_pieces(F.col("t"), path, 16).alias("p")).withColumn("n", segments.token_counts(F.col("p"), path))
    got = {r["id"]: r for r in rows.collect()}
    assert "".join(got[1]["p"]) == "one two three. " * 40 and max(got[1]["n"]) <= 16 and got[2]["p"] is None and got[3]["p"] == [""]
    assert "".join(got[4]["p"]) == "x" * 5000 and max(got[4]["n"]) <= 16


def test_words_are_encoded_once(monkeypatch):
    """pieces were looked for by encoding their heads again and again."""
    import public_tokenizers
    import tokenizers

    made, path, real = [], public_tokenizers.path("word_bpe_49k.json"), tokenizers.Tokenizer.from_file

    class Counting:
        from_file = staticmethod(lambda p: Counting())
        inner = real(path)
        to_str = lambda self: self.inner.to_str()
        encode = lambda self, text, **k: made.append(text) or self.inner.encode(text, **k)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(segments, "_COUNTERS", {})
    line, count = "one two three four, five six seven " * 200, segments.token_counter(path)
    pieces = segments.split_source(line, 16, count)
    assert "".join(pieces) == line and len(made) <= 10 and [count(p) for p in pieces] == [len(Counting.inner.encode(p, add_special_tokens=False).ids) for p in pieces]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counter_counts_as_whole_texts_are_encoded(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(name), random.Random(4)
    whole, count = Tokenizer.from_file(path), segments.token_counter(path)
    for _ in range(2000):
        text = "".join(rng.choices(["a", "the", "'s", " ", "\t", "\n", "́", "é", "9", "漢", "<|endof", "text|>", " ", "　", "\x1c", "!"], k=rng.randrange(0, 16)))
        assert count(text) == len(whole.encode(text, add_special_tokens=False).ids)


def test_runs_are_read_once_and_as_places_are_put():
    """equal runs of a text are looked up once; a text read run by run equals one with its places put."""

    class Counted(dict):
        asked = 0

        def get(self, *x):
            self.asked += 1
            return super().get(*x)

    table = Counted(READINGS)
    assert L.by_readings("x存途, " * 1000, table) == ("x Tồn Đồ, " * 1000, 2000)
    assert table.asked <= 2  # 2,000 before
    draw = random.Random(17)
    for _ in range(2000):
        text = "".join(draw.choice("存途乙a1 \t,.é") for _ in range(draw.randrange(14)))
        places = [(m.start(), m.end(), " ".join(READINGS.get(c, c) for c in m[0])) for m in re.finditer(f"[{L.HAN}]+", text)]
        assert L.by_readings(text, READINGS) == (L.put(text, places), sum(c in READINGS for c in text))
