"""Language identification by a linear-chain conditional random field over words.

Every word of a text is a position; a word's features are its affixes, its character n-grams with boundaries, its length
and the languages whose lexicon (frequent words of the training sample) holds it, hashed into BUCKETS buckets. Weights
and transitions are learned together by gradient ascent on sequences made of stretches of several documents, so the chain
sees code-switching. Forward-backward gives each word's posteriors; a text's language is the one with the highest mean.

Long texts are scanned in chunks: transfer matrices of the chunks carry the messages between them, so the result is that
of one pass over the whole text, and a text of any length takes few vectorised steps.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, CHUNK, UNKNOWN = 1 << 17, 512, "und"
_WORD = re.compile(r"[^\W\d_]{1,40}")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, cut every 40 characters."""
    return _WORD.findall(text.lower())


class Model:
    """langs, hashed weights (buckets x langs), transition scores and the lexicon."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        self.langs, self.lexicon = langs, lexicon
        self.weights, self.moves = np.zeros((BUCKETS + 1, len(langs)), np.float32), np.zeros((len(langs), len(langs)), np.float32)

    def features(self, word: str) -> list[int]:
        w = f"<{word}>"
        keys = [w[:2], w[:3], w[:4], w[-2:], w[-3:], w[-4:], *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))]
        out = [zlib.crc32(k.encode(), i if i < 6 else 6) % BUCKETS for i, k in enumerate(keys)]
        seen = self.lexicon.get(word, 0)
        out += [zlib.crc32(b"lexicon", 7 + k) % BUCKETS for k in range(len(self.langs)) if seen >> k & 1]
        return out + [zlib.crc32(b"length", min(len(word), 12)) % BUCKETS]

    def padded(self, words: list[str]) -> np.ndarray:
        rows = [self.features(w) for w in words]
        out = np.full((len(rows), max(map(len, rows), default=1)), BUCKETS, np.int32)  # the last row of weights stays zero
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        parts = [self.weights[self.padded(words[i : i + 8192])].sum(1) for i in range(0, len(words), 8192)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)


def _likely(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(-1, keepdims=True))


def _normal(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def posterior_sums(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Sum of the posteriors of each text's words; texts of lengths[i] > 0 words stand one after the other in emissions."""
    n = emissions.shape[1]
    step = np.exp(moves - moves.max()).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = np.repeat(np.arange(len(lengths)), -(-lengths // CHUNK))
    nth = np.arange(len(text)) - np.concatenate([[0], np.cumsum(-(-lengths // CHUNK))[:-1]])[text]
    first, size = starts[text] + nth * CHUNK, np.minimum(lengths[text] - nth * CHUNK, CHUNK)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(1, CHUNK + 1), "right")  # chunks with more than t words
    steps = int(size.max())
    e = _likely(emissions.astype(np.float64))
    at = lambda t, m: e[first[order[:m]] + t]
    ahead, back = np.full((len(text), n), 1 / n), np.full((len(text), n), 1 / n)  # messages into each chunk, by order
    several = np.flatnonzero(lengths > CHUNK)
    if len(several):
        transfer = np.broadcast_to(np.eye(n), (len(text), n, n)).copy()
        for t in range(steps):
            m = active[t]
            transfer[:m] = _normal((transfer[:m] @ step) * at(t, m)[:, None, :], (1, 2))
        place = np.empty(len(text), np.int64)
        place[order] = np.arange(len(text))
        ends = np.searchsorted(text, several, "right")
        for begin, end in zip(np.searchsorted(text, several), ends, strict=True):
            for c in range(begin + 1, end):
                ahead[place[c]] = _normal(ahead[place[c - 1]] @ transfer[place[c - 1]], 0)
            for c in range(end - 2, begin - 1, -1):
                back[place[c]] = _normal(transfer[place[c + 1]] @ back[place[c + 1]], 0)
    kept = []
    for t in range(steps):
        m = active[t]
        ahead[:m] = _normal((ahead[:m] @ step) * at(t, m), 1)
        kept.append(ahead[:m].copy())
    sums = np.zeros((len(text), n))
    for t in range(steps - 1, -1, -1):
        m = active[t]
        if t + 1 < steps:
            k = active[t + 1]
            back[:k] = _normal((at(t + 1, k) * back[:k]) @ step.T, 1)
        sums[:m] += _normal(kept[t] * back[:m], 1)
    out = np.zeros((len(lengths), n))
    np.add.at(out, text[order], sums)
    return out


def train(rows: list[tuple[str, str]], seed: int = 7, max_words: int = 300_000, lexicon_size: int = 400, rate: float = 0.3) -> Model | None:
    """A model from (text, lang) rows; None without a word. Rows come in a fixed order and draws have a fixed seed."""
    langs = sorted({lang for _, lang in rows})
    held = [(words, langs.index(lang)) for text, lang in rows if (words := [w for w in words_of(text) if any(map(str.isalpha, w))])]
    if not held:
        return None
    rng, lexicon = np.random.default_rng(seed), {}
    for k in range(len(langs)):
        counts: dict[str, int] = {}
        for words, lang in held:
            if lang == k:
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
        for w in sorted(counts, key=lambda w: (-counts[w], w))[:lexicon_size]:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    model, n, length = Model(langs, lexicon), len(langs), 48
    by_lang = [[words for words, lang in held if lang == k] for k in range(n)]
    present = [k for k in range(n) if by_lang[k]]
    squares, move_squares = np.full(model.weights.shape, 1e-2, np.float32), np.full((n, n), 1.0)
    for _ in range(max(1, max_words // (32 * length))):
        sequences, labels = [], []
        for _ in range(32):
            seq, lab = [], []
            while len(seq) < length:
                k = present[rng.integers(len(present))]
                words = by_lang[k][rng.integers(len(by_lang[k]))]
                run = min(int(rng.geometric(1 / 16)), length - len(seq), len(words))
                begin = int(rng.integers(len(words) - run + 1))
                seq += words[begin : begin + run]
                lab += [k] * run
            sequences += seq
            labels.append(lab)
        ids, y = model.padded(sequences), np.array(labels)
        e = _likely(model.weights[ids].sum(1).reshape(32, length, n).astype(np.float64))
        step = np.exp(model.moves - model.moves.max()).astype(np.float64)
        ahead, back = np.empty_like(e), np.ones_like(e)
        a = np.full((32, n), 1 / n)
        for t in range(length):
            a = ahead[:, t] = _normal((a @ step) * e[:, t], 1)
        for t in range(length - 2, -1, -1):
            back[:, t] = _normal((e[:, t + 1] * back[:, t + 1]) @ step.T, 1)
        gain = np.eye(n)[y] - _normal(ahead * back, 2)
        pair = _normal(ahead[:, :-1, :, None] * step * (e[:, 1:] * back[:, 1:])[:, :, None, :], (2, 3))
        grad_moves = -pair.sum((0, 1))
        np.add.at(grad_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        flat, spread = ids.ravel(), np.repeat(gain.reshape(-1, n), ids.shape[1], axis=0)
        grad = np.stack([np.bincount(flat, spread[:, k], BUCKETS + 1) for k in range(n)], 1).astype(np.float32) / 32
        grad[BUCKETS] = 0
        squares += grad**2
        model.weights += (rate * 0.3) * grad / np.sqrt(squares)
        move_squares += (grad_moves / 32) ** 2
        model.moves += (rate * (grad_moves / 32) / np.sqrt(move_squares)).astype(np.float32)
    return model


def places_of(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rows to take of each language: equal shares of total, places that rare ones leave go to the others, one at least."""
    places, left = {}, total
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        places[lang] = max(1, min(n, left // (len(counts) - i)))
        left -= places[lang]
    return places


def training_rows(docs: DataFrame, may_learn: Column, max_docs: int = 1600) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows for the fit: max_docs documents over all languages, one of each at least.

    As many of each language as there are, up to an equal share, drawn by a hash of text and language so that nothing
    depends on row order; of each, the whole text. Prediction has no such bound.
    """
    known = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    drawn = known.withColumn("draw", F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 40))).select("draw", "text", "lang")
    places = docs.sparkSession.createDataFrame(list(places_of(counts, max_docs).items()), "lang string, places int")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    most = max(places_of(counts, max_docs).values())
    rows = drawn.withColumn("nth", nth).where(F.col("nth") <= most).join(F.broadcast(places), "lang").where("nth <= places").orderBy("draw", "lang", "text")
    return [(r["text"], r["lang"]) for r in rows.collect()]


def predict(docs: DataFrame, model: Model | None, max_cached: int = 300_000) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone.

    The text's words all take part. A null text, one without letters, or no model: `und` with score 0. Repeated rows get
    equal results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = shared.value
        cache: dict[str, int] = {}
        scores = np.zeros((0, len(model.langs) if model else 1), np.float32)

        def judged(texts):
            nonlocal scores
            if len(cache) > max_cached:
                cache.clear()
                scores = scores[:0]
            cut = [words_of(t) for t in texts]
            new = list({w for ws in cut for w in ws if w not in cache})
            letters = [w for w in new if any(map(str.isalpha, w))]
            cache.update((w, len(scores) + i) for i, w in enumerate(letters))
            cache.update((w, -1) for w in new if not any(map(str.isalpha, w)))
            scores = np.concatenate([scores, model.emissions(letters)])
            places = [np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws)) for ws in cut]
            places = [p[p >= 0] for p in places]
            lengths = np.array([len(p) for p in places])
            out = [(UNKNOWN, 0.0)] * len(texts)
            some = np.flatnonzero(lengths)
            if len(some):
                sums = posterior_sums(scores[np.concatenate([places[i] for i in some])], lengths[some], model.moves)
                for i, s in zip(some.tolist(), sums, strict=True):
                    k = int(s.argmax())
                    out[i] = (model.langs[k], float(min(1.0, max(0.0, s[k] / lengths[i]))))
            return out

        for b in batches:
            texts, out, part, size = b.column(1), [], [], 0
            for t in texts:
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size > 2_000_000:
                    out += judged(part) if model else [(UNKNOWN, 0.0)] * len(part)
                    part, size = [], 0
            out += judged(part) if model else [(UNKNOWN, 0.0)] * len(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
