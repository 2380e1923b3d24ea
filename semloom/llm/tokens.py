"""Encoding of a corpus with a public byte-level BPE tokenizer: speculate and verify.

Texts are cut into words by vectorised rules over the classes of their code
points (the same cuts as the tokenizer's pattern). For each word that is new to
a worker a greedy longest match proposes tokens; every pair of adjacent proposed
tokens is then tested for compatibility with the merges, all new pairs at once
on arrays; words with a pair that fails are merged exactly. A sequence of tokens
is the tokenizer's own exactly where each adjacent pair of it is compatible, so
the result is exact. Each worker keeps the ids of the words it has seen, up to a
bound, so repeated words cost a dictionary lookup.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.session import col

#: Words and pairs a worker remembers; beyond that it starts anew, which changes nothing but time.
MEMORY = 1_500_000
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
NONE = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of byte-level BPE: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point: letter, digit (any number), white space or other."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        out[np.frombuffer("".join(regex.findall(pattern, points)).encode("utf-32-le"), np.uint32)] = kind
    return out


class Vocabulary:
    """Ids, merges and the tables for compatibility of one vocabulary file (``tokenizers`` format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_alphabet()
        spell = lambda t: bytes(back[c] for c in t)
        known = {t: i for t, i in model["vocab"].items() if all(c in back for c in t)}
        size = max(known.values()) + 1
        self.ids = {spell(t): i for t, i in known.items()}
        self.longest = max(map(len, self.ids))
        # Rank of the merge that makes a token, -1 for single bytes; and what it is made of.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs = []
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = known[a], known[b], known[a + b]
            self.merge[x, y] = (r, z)
            pairs.append((x * size + y, r))
            if self.rank[z] < 0 and len(spell(a + b)) > 1:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        pairs.sort()
        self.size = size
        self.keys, self.ranks = (np.array(v, np.int64) for v in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, or NONE."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the border between tokens ``a`` and ``b`` as it is, for arrays of pairs.

        The right edge of ``a`` and the left edge of ``b`` are taken apart step by
        step, the younger merge first, which shows every pair of tokens that touched
        at the border at some time. The border falls where such a pair merges
        sooner than the merge that made its left part (strictly, as the left of two
        equal merges comes first) or its right part part of more.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        until_a = np.full(len(a), NONE)
        until_b = np.full(len(a), NONE)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.pair_rank(x, y)
            broken = (r < NONE) & (r < until_a[live]) & (r <= until_b[live])
            ok[live[broken]] = False
            ra, rb = self.rank[x], self.rank[y]
            go = ~broken & ((ra >= 0) | (rb >= 0))
            live, x, y, ra, rb = live[go], x[go], y[go], ra[go], rb[go]
            first = ra > rb
            i = live[first]
            until_a[i], a[i] = ra[first], self.right[x[first]]
            i = live[~first]
            until_b[i], b[i] = rb[~first], self.left[y[~first]]
        return ok

    def greedy(self, word: bytes) -> list[int]:
        ids, longest = self.ids, self.longest
        out, i, n = [], 0, len(word)
        while i < n:
            j = min(n, i + longest)
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def exact(self, word: bytes) -> list[int]:
        """The merges one by one, by rank and then from the left, on a linked list with a heap: n log n for words of any length."""
        import heapq

        tok: list[int] = [self.ids[bytes([x])] for x in word]
        n = len(tok)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        merge = self.merge
        heap = [(m[0], i, tok[i], tok[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if tok[i] != x or j >= n or tok[j] != y:
                continue
            tok[i], tok[j] = z, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((z, tok[k])):
                    heapq.heappush(heap, (m[0], i, z, tok[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((tok[h], z))):
                heapq.heappush(heap, (m[0], h, tok[h], z, m[1]))
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = after[i]
        return out


class Encoder:
    """Encodes batches of texts; keeps what it has learnt about words and pairs."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.classes = char_classes()
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.used = 0
        self.pairs: dict[int, bool] = {}
        self.failed = 0

    def cuts(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts in one, where its words begin, and where each text begins."""
        joined = "".join(texts)
        n = len(joined)
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=begin[1:])
        if not n:
            return joined, np.zeros(0, np.int64), begin
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[points]
        start = np.empty(n + 1, bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        edge = np.zeros(n + 1, bool)
        edge[begin] = True
        start |= edge
        # Runs of white space: their last mark stands alone, or goes with the next word if it is a blank; at the end of a text the run is one word.
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # 's 't 'm 'd and 're 've 'll, where the mark begins a word and is all of its run.
        mark = np.flatnonzero(points == 39)
        mark = mark[start[mark] & start[mark + 1]]
        mark = mark[mark + 1 < n]
        mark = mark[~edge[mark + 1]]
        for ends in ("s", "t", "m", "d"):
            hit = mark[points[mark + 1] == ord(ends)]
            start[hit + 1], start[hit + 2] = False, True
        mark = mark[mark + 2 < n]
        mark = mark[~edge[mark + 2]]
        for a, b in ("re", "ve", "ll"):
            hit = mark[(points[mark + 1] == ord(a)) & (points[mark + 2] == ord(b))]
            start[hit + 1], start[hit + 2], start[hit + 3] = False, False, True
        return joined, np.flatnonzero(start), begin

    def learn(self, words: list[str]) -> None:
        v = self.vocabulary
        raw = [w.encode("utf-8", "replace") for w in words]
        proposed = [v.greedy(r) for r in raw]
        new = {x * v.size + y for p in proposed for x, y in zip(p, p[1:])}.difference(self.pairs)
        if new:
            keys = np.fromiter(new, np.int64, len(new))
            self.pairs.update(zip(keys.tolist(), v.compatible(keys // v.size, keys % v.size).tolist()))
        pairs = self.pairs
        for word, r, p in zip(words, raw, proposed):
            if not all(pairs[x * v.size + y] for x, y in zip(p, p[1:])):
                p = v.exact(r)
                self.failed += 1
            at = len(self.index)
            self.index[word] = at
            if at >= len(self.starts):
                self.starts, self.lengths = np.resize(self.starts, 2 * at), np.resize(self.lengths, 2 * at)
            while self.used + len(p) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(p)] = p
            self.starts[at], self.lengths[at] = self.used, len(p)
            self.used += len(p)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text in them, first id of each word, number of each word's characters)."""
        if len(self.index) > MEMORY or len(self.pairs) > MEMORY:
            self.forget()
        joined, at, begin = self.cuts(texts)
        bounds = at.tolist()
        words = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        number = [*map(self.index.get, words)]
        if None in number:
            self.learn([*dict.fromkeys(w for w, i in zip(words, number) if i is None)])
            number = [*map(self.index.__getitem__, words)]
        which = np.array(number, np.int64)
        count = self.lengths[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.starts[which] - ends[:-1], count) + np.arange(ends[-1])] if len(which) else np.zeros(0, np.int32)
        offsets = ends[np.searchsorted(at[:-1], begin)] if len(which) else np.zeros(len(begin), np.int64)
        return ids, offsets, ends, at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Characters that are encoded at once; bounds what a worker holds beside one text.
CHUNK = 2_000_000


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of texts of about ``CHUNK`` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                ids, offsets, _, _ = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "ids"])

    return run


def encode_corpus(df: DataFrame, row_id: str, text: str, vocabulary: str, ids: str = "ids") -> DataFrame:
    """(row_id, ids): the token ids of each row's text, without special tokens.

    A null or an empty text has an empty list; blank texts are encoded as they
    stand; strings of special tokens in a text are ordinary text. Very long texts
    are encoded whole. Equal rows give equal lists, ids may be null; other columns
    are ignored, so their names can't clash. ``vocabulary`` is the path of the
    file on every executor. No shuffle.
    """
    out = df.select(col(row_id).cast("long").alias("id"), col(text).cast("string").alias("text")).mapInArrow(_ids(vocabulary), "id long, ids array<int>")
    return out.select(F.col("id").alias(row_id), F.col("ids").alias(ids))
