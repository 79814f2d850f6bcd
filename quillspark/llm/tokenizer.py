"""Exact batch encoding by the tokenizers library, with repeated chunks of text encoded once per worker.

A text is cut only where no token can cross: before a single space between two characters that are not white space
(byte-level files), or at white space, which word-level files drop. The ids of a text are the ids of its chunks, joined;
tests hold them against encoding whole texts. Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np

SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """ids(texts) gives little-endian unsigned 32-bit ids as bytes. At most max_cached chunks of 64 characters are kept."""

    def __init__(self, path: str, words_only: bool, max_cached: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.words_only, self.max_cached, self.cache = words_only, max_cached, {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, chunks: list[str], at_once: int = 512) -> list[bytes]:
        """ids of chunks that each stand behind a space: joined, encoded as few texts, and told apart by offsets."""
        joined = [chunks[i : i + at_once] for i in range(0, len(chunks), at_once)]
        out = []
        for part, e in zip(joined, self.tokenizer.encode_batch(["".join(" " + c for c in part) for part in joined], add_special_tokens=False), strict=True):
            starts = np.cumsum([0] + [len(c) + 1 for c in part])
            first = np.fromiter((o[0] for o in e.offsets), np.int64)
            cuts, ids = np.searchsorted(first, starts).tolist(), np.asarray(e.ids, "<u4").tobytes()
            out += [ids[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def _safe(self, piece: str) -> bool:
        return self.words_only or bool(piece) and not piece[0].isspace() and not piece[-1].isspace()

    def _cut(self, texts: list[str]) -> list[tuple[str, list[str]]]:
        """Of each text a head, encoded as it is, and the chunks behind one space each, named without it."""
        if self.words_only:
            return [("", t.replace("\n", " ").split(" ")) for t in texts]
        known, pieces = self.cache, [t.split(" ") for t in texts]
        unsafe = {p for p in {p for ps in pieces for p in ps if p not in known} if not self._safe(p)}
        out = []
        for t, (head, *behind) in zip(texts, pieces, strict=True):
            if behind and (not self._safe(head) or unsafe and not unsafe.isdisjoint(behind)):
                head, *behind = SAFE_CUT.split(t)
                behind = [c[1:] for c in behind]
            out.append((head, behind))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.max_cached:
            self.cache.clear()
        cut, cache = self._cut(texts), self.cache
        new = list({c for _, behind in cut for c in behind if c not in cache})
        coded = dict(zip(new, self.apart(new), strict=True))
        rare = {c: x for c, x in coded.items() if len(c) > 64}
        cache.update(coded if not rare else ((c, x) for c, x in coded.items() if c not in rare))
        heads, out = self.whole([head for head, _ in cut]), []
        for head, (_, behind) in zip(heads, cut, strict=True):
            try:
                out.append(head + b"".join(map(cache.__getitem__, behind)))
            except KeyError:
                out.append(head + b"".join(cache[c] if c in cache else rare[c] for c in behind))
        return out


_LOADED: dict[tuple, Encoder] = {}


def encoder(path: str, words_only: bool) -> Encoder:
    """One encoder a file and worker process."""
    if (path, words_only) not in _LOADED:
        _LOADED[path, words_only] = Encoder(path, words_only)
    return _LOADED[path, words_only]


def in_parts(texts: list[str], max_chars: int = 4_000_000):
    """Slices (first, last) of texts with about max_chars characters each, so that a batch's chunks stay bounded."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= max_chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
