"""Benchmark decontamination under word edit distance: CGK embedding, repeated bit-sampling LSH, exact verification.

Texts and items are read as words (lower-cased, ASCII punctuation dropped). An item of n words is found in a document if some
run of its words is within ``EDITS`` n word edits (rounded down) of the item.

1. Windows. Of 2k + 2 words of an item (those that few items have, the longest of these first), k edits leave k + 2, and these stay in step within k words:
   windows of the item's length are put where so many of its chosen words are, and no other place can hold the item.
2. Embedding. A random walk after Chakraborty, Goldenberg and Koucky: at step t the word at the pointer is written down, and
   bit t of a random function of the word says if the pointer moves. Small edit distances become small Hamming distances.
3. Repeated bit sampling: each repetition has a walk of its own and writes down the words of ``SAMPLED`` random steps; their hash is
   the bucket. ``_repeats`` adds repetitions (``MOST`` at most) until planted edits of the items are met with ``RECALL``. Of lengths
   where these repetitions meet fewer (long items), all windows are compared, without buckets.
4. Windows and items that meet in a bucket are compared exactly, by a bit-parallel edit distance over the window's surroundings.

Items without words are in no document; an item of fewer than ``SHORT`` words only counts where it is a document's whole text, longer
ones are searched everywhere. There is no bound on an item's or a text's length.
Items go to all tasks in blocks of ``BLOCK`` at most, so any number of them may be given. Null texts are empty; rows
that repeat are searched each; equal items are all reported; an empty table on either side gives an empty result.
"""
from __future__ import annotations

import math
import random
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, keep_rows, stored

EDITS, SHORT, SAMPLED, RECALL, BLOCK, MOST = 0.2, 4, 3, 0.99, 20_000, 48
FOUND = "doc_id long, item_id long, edits int, start_word long, end_word long, item_words int"
_DROP = string.punctuation.encode()


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(None, _DROP).split()


def edits_allowed(n: int, share: float = EDITS) -> int:
    return int(share * n + 1e-9)


def size_class(n: int) -> int:
    """Lengths that differ by a fifth at most are one class."""
    return int(4 * math.log2(n))


class Walks:
    """``count`` repetitions: their walk functions and sampled steps, the latter as shares of twice an item's length."""

    def __init__(self, count: int, sampled: int = SAMPLED, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.odd = draw.integers(0, 2**63, (count, 512), np.uint64) * np.uint64(2) + np.uint64(1)
        self.share = np.sort(draw.random((count, sampled)) * 0.95, 1)

    def keys(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, repeat: int) -> np.ndarray:
        """The bucket of each window words[start : start + size] in one repetition; a walk past the end writes zeros."""
        steps = (self.share[repeat][None] * 2 * size[:, None]).astype(np.int64)
        at, end, odd = start.copy(), start + size, self.odd[repeat]
        out = np.full(len(start), repeat + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        padded = np.append(words, np.uint64(0))
        for t in range(int(steps.max(initial=-1)) + 1):
            inside = at < end
            word = padded[np.where(inside, at, len(words))]
            for k in range(steps.shape[1]):
                hit = steps[:, k] == t
                if hit.any():
                    out[hit] = (out[hit] ^ word[hit]) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
            at += ((word * odd[t % 512]) >> np.uint64(63)).astype(np.int64) & inside
        return out ^ (out >> np.uint64(31))


def distance(masks: dict, n: int, text: list[bytes]) -> tuple[int, int]:
    """The least edits between the pattern of n words (bit masks of its words) and any run of ``text``, and where that run ends."""
    ones = (1 << n) - 1
    up, down, score, top = ones, 0, n, 1 << (n - 1)
    best, end = n, 0
    for i, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | (ones & ~(d0 | up)), up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & ones, hn << 1 & ones  # a match may begin anywhere
        up, down = hn | (ones & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, i + 1
    return best, end


def masks_of(words: list[bytes]) -> dict:
    out: dict = defaultdict(int)
    for i, w in enumerate(words):
        out[w] |= 1 << i
    return dict(out)


class Items:
    """A block of benchmark items (id, text) with all that a task needs to find them."""

    def __init__(self, rows: list[tuple[int, str]], share: float = EDITS, seed: int = 0):
        self.ids = [i for i, _ in rows]
        self.words = [words_of(t or "") for _, t in rows]
        self.allowed = [edits_allowed(len(w), share) for w in self.words]
        self.whole: dict[tuple, list[int]] = defaultdict(list)
        counts = Counter(w for ws in self.words for w in set(ws))
        self.masks, self.backward = [], []
        anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # word -> (item, place in the item)
        self.need = np.ones(len(rows), np.int64)
        for k, ws in enumerate(self.words):
            self.masks.append(masks_of(ws))
            self.backward.append(masks_of(ws[::-1]))
            if 0 < len(ws) < SHORT:
                self.whole[tuple(ws)].append(k)
            elif ws:
                chosen = sorted(range(len(ws)), key=lambda i: (max(counts[ws[i]], 4).bit_length(), -len(ws[i]), counts[ws[i]], i))[: 2 * self.allowed[k] + 2]
                self.need[k] = len(chosen) - self.allowed[k]
                for i in chosen:
                    anchors[ws[i]].append((k, i))
        self.anchors = {w: i for i, w in enumerate(anchors)}
        self.many = np.array([len(a) for a in anchors.values()], np.int64)
        self.first = np.cumsum(self.many) - self.many
        places = [x for a in anchors.values() for x in a]
        self.item_of, self.place_of = (np.array([x[i] for x in places], np.int64) for i in (0, 1))
        self.long = [k for k, ws in enumerate(self.words) if len(ws) >= SHORT]
        self.repeats = self._repeats(seed)
        self.walks = Walks(self.repeats, seed=seed)
        self.direct = self._missed(seed)
        self.buckets: dict[int, list[int]] = defaultdict(list)
        bucketed = [k for k in self.long if not self.direct[k]]
        hashed, starts, sizes = self._flat([self.words[k] for k in bucketed])
        for r in range(self.repeats if bucketed else 0):
            for k, key in zip(bucketed, self.walks.keys(hashed, starts, sizes, r).tolist()):
                self.buckets[key].append(k)
        self.keys = np.array(sorted(self.buckets), np.uint64)

    @staticmethod
    def _flat(many: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in many], np.int64)
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in many for w in ws), np.uint64)
        return hashed, np.cumsum(sizes) - sizes, sizes

    def _met(self, chosen: list[int], walks: Walks, draw: random.Random) -> Iterator[float]:
        """After each repetition, the share of the chosen items, with the edits allowed planted at random, that met the item."""
        edited = []
        for ws, allowed in ((self.words[k], self.allowed[k]) for k in chosen):
            own = list(ws)
            for _ in range(allowed):
                at, kind = draw.randrange(len(own)), draw.randrange(3)
                own[at : at + (kind != 1)] = [] if kind == 0 else [b"\x00%d" % draw.randrange(1 << 30)]
            edited.append((own + [b"\x00after"] * len(ws))[: len(ws)])
        a, b = self._flat([self.words[k] for k in chosen]), self._flat(edited)
        met = np.zeros(len(chosen), bool)
        for r in range(len(walks.share)):
            met |= walks.keys(*a, r) == walks.keys(*b, r)
            yield met.mean()

    def _repeats(self, seed: int) -> int:
        """Repetitions until ``RECALL`` of items of all lengths meet the item once at least; ``MOST`` at most."""
        if not self.long:
            return 0
        draw = random.Random(seed)
        shares = self._met(draw.sample(self.long, min(200, len(self.long))), Walks(MOST, seed=seed), draw)
        return next((r for r, share in enumerate(shares, 1) if share >= RECALL), MOST)

    def _missed(self, seed: int) -> np.ndarray:
        """Which items are of a class of lengths whose items these walks meet with less than ``RECALL``."""
        draw, classes, out = random.Random(seed), defaultdict(list), np.zeros(len(self.words), bool)
        for k in self.long:
            classes[size_class(len(self.words[k]))].append(k)
        for _, own in sorted(classes.items()):
            chosen = draw.sample(own, 200) if len(own) > 200 else draw.choices(own, k=200)
            out[own] = all(share < RECALL for share in self._met(chosen, self.walks, draw))
        return out

    def meet(self, split: list[list[bytes]], windows: dict[int, list[tuple[int, int]]]) -> dict[int, list[tuple[int, int]]]:
        """row -> (item, start) of the windows that share a bucket with an item."""
        rows = sorted(windows)
        hashes, base, sizes = self._flat([split[r] for r in rows])
        flat = [(i, max(s, 0), min(s + n, len(split[r]))) for i, r in enumerate(rows) for s, n in windows[r]]
        own, low, high = (np.array(x, np.int64) for x in zip(*flat))
        out: dict[int, set] = defaultdict(set)
        for repeat in range(self.repeats):
            keys = self.walks.keys(hashes, base[own] + low, high - low, repeat)
            at = np.searchsorted(self.keys, keys).clip(0, max(len(self.keys) - 1, 0))
            for i in np.flatnonzero(self.keys[at] == keys):
                out[rows[own[i]]].update((k, int(low[i])) for k in self.buckets[int(keys[i])])
        return {r: sorted(p) for r, p in out.items()}

    def compare(self, words: list[bytes], pairs: list[tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
        """item -> (edits, start, end) of its best place among those given, if it has few enough edits there."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, s in pairs:
            n, allowed = len(self.words[k]), self.allowed[k]
            if k in best and best[k][0] == 0:
                continue
            begin, stop = max(s - 2 * allowed, 0), s + n + 3 * allowed + 1
            edits, end = distance(self.masks[k], n, words[begin:stop])
            if edits <= allowed and edits < best.get(k, (allowed + 1,))[0]:
                _, back = distance(self.backward[k], n, words[max(begin + end - n - allowed, 0) : begin + end][::-1])
                best[k] = (edits, begin + end - back, begin + end)
        return best

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, edits, start, end) for every item that a text holds."""
        split = [words_of(t) for t in texts]
        if self.whole:
            for row, words in enumerate(split):
                for k in self.whole.get(tuple(words), ()) if 0 < len(words) < SHORT else ():
                    yield row, k, 0, 0, len(words)
        windows, pairs = self.windows(split)
        for row, met in self.meet(split, windows).items() if windows else ():
            pairs[row].update(met)
        for row in sorted(pairs):
            for k, found in self.compare(split[row], sorted(pairs[row])).items():
                yield row, k, *found

    def windows(self, split: list[list[bytes]]) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[tuple[int, int]]]]:
        """row -> (start, size) of the windows where enough of an item's chosen words stand in step; row -> (item, start) where the
        item is compared without buckets."""
        sizes = np.array([len(w) for w in split], np.int64)
        get = self.anchors.get
        word = np.fromiter((get(w, -1) for ws in split for w in ws), np.int64, int(sizes.sum()))
        hit = np.flatnonzero(word >= 0)
        word, many = word[hit], self.many[word[hit]]
        place = np.repeat(self.first[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at, item = np.repeat(hit, many), self.item_of[place]
        row = np.searchsorted(np.cumsum(sizes), at, side="right")
        start = at - (np.cumsum(sizes) - sizes)[row] - self.place_of[place]
        order = np.lexsort((start, row * len(self.ids) + item))
        start, item, row = start[order], item[order], row[order]
        allowed = np.array(self.allowed, np.int64)
        last = np.arange(len(start)) + self.need[item] - 1
        inside = last < len(start)
        last = last.clip(0, max(len(start) - 1, 0))
        ok = inside & (item[last] == item) & (row[last] == row) & (start[last] - start <= allowed[item])
        out: dict[int, set] = defaultdict(set)
        direct: dict[int, set] = defaultdict(set)
        for i in np.flatnonzero(ok).tolist():
            k, r = int(item[i]), int(row[i])
            if self.direct[k]:  # the words in step stand at most allowed[k] further on, which compare() looks over
                direct[r].add((k, max(int(start[i]), 0)))
            else:
                out[r].update((x, len(self.words[k])) for x in start[i : int(last[i]) + 1].tolist())
        return {r: sorted(w) for r, w in out.items()}, direct


def blocks_of(benchmark: DataFrame, share: float) -> Iterator[Broadcast]:
    """The items, sent to all tasks in blocks of ``BLOCK`` at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-2 * items.count() // BLOCK))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = sorted((r["item_id"] is None, r["item_id"], r["text"]) for r in dealt.where(F.col("_block") == b).collect())
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Items([r[1:] for r in rows], share))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, start_word, end_word and item_words of every item in every document, at its best place."""
    parts = [id_and_text(docs).mapInArrow(lambda batches, s=sent: _find(batches, s.value), FOUND) for sent in blocks_of(benchmark, share)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], FOUND)


def _find(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    names = [c.split()[0] for c in FOUND.split(", ")]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at in range(0, len(ids), 1024):
            found = [(ids[at + r], items.ids[k], e, s, t, len(items.words[k])) for r, k, e, s, t in items.find(batch.column(1).slice(at, 1024).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """``docs`` without the rows whose text holds an item; every row is judged by its own text, whatever its id."""
    blocks = list(blocks_of(benchmark, share))
    for n, sent in enumerate(blocks):
        docs = keep_rows(docs, lambda texts, s=sent: _holds(s.value, texts))
        if n < len(blocks) - 1:
            docs = stored(docs, "cleaned")  # so that a task never has a Python worker for each block
    return docs


def _holds(items: Items, texts: list[str]) -> list[bool]:
    held = {r for r, *_ in items.find(texts)}
    return [i not in held for i in range(len(texts))]
