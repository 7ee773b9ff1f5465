"""LM scoring by a probabilistic suffix tree.

Texts are read as words, a boundary after each, and one end; A-Z lower-cased. The tree's symbols are bytes in ``RADIX`` classes
at most (letters on their own; digits, other signs and continuation bytes in small classes whose members have learnt shares).
Contexts of up to ``DEPTH`` symbols, across words, and of up to ``DEEP`` inside one are kept if they are frequent and their
next-symbol distribution diverges from that of their longest kept suffix: n KL(context || suffix) >= ``DIVERGENCE`` nats. Kept distributions are smoothed with their
suffix's, the root's with a half for every symbol. A text's score is the sum over its symbols of the log probability at the
longest kept suffix of what precedes them.

Counts cover all training documents: tasks count words and (DEPTH + 1)-grams of their texts, a shuffle adds them up; deeper
grams are counted from the words. Every context seen ``SUPPORT`` times that diverges is kept, so the tree grows with the input:
it is a table, made in groups of contexts with the same last ``TRUNK`` symbols.

What is sent to workers is bounded: the ``HELD`` most frequent kept contexts, words with at least 1/``WORDS`` of all tokens.
Other words of a document meet their counts in a join, other contexts what they add to the score of their longest kept suffix
(of each DEPTH symbols a byte says exactly which of their suffixes are in the table, and whether deeper contexts may be; of those a filter
of 2^``FILTER`` bits tells nearly all that aren't). Both ways give the same scores.

Null texts are empty (one end token). Rows that repeat are scored each. Without training documents N = V = 0: every token then has
0.5 / 0.5 in the base score, and the tree has its root only. An empty table gives an empty result.
"""
from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fold_py, id_and_text, stored

#: Symbols; the longest context counted in running text; the longest inside a word (with its first boundary).
RADIX, DEPTH, DEEP = 64, 4, 7
DIVERGENCE = 12.0
SUPPORT, TRUNK = 20, 2
HELD, WORDS, FILTER = 1 << 17, 1 << 20, 27
BOUNDARY, END = 0, 1
PACK = 6 * (DEEP + 1)
#: Symbols by which a walk down the tree starts; a worker holds 4 * RADIX ** STATES bytes for it.
STATES = 4


def _classes() -> np.ndarray:
    """The symbol of each byte."""
    out = np.full(256, 33, np.uint8)  # other bytes of ASCII
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        out[c] = 2 + i
    out[[32, 9, 10, 11, 12, 13]] = BOUNDARY
    out[list(b"0123456789")] = 28
    for i, c in enumerate(b".,'-"):
        out[c] = 29 + i
    out[0xC0:] = 35
    out[0xC3] = 34
    out[0x80:0xC0] = 36 + np.arange(64) // 3
    return out


SYMBOL = _classes()


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Of lower-cased texts: all symbols, each text after DEPTH boundaries; its bytes; where each text begins; its words."""
    words = [t.split() for t in texts]
    pad = b" " * DEPTH
    parts = [pad + b" ".join(w) + b"  " if w else pad + b" " for w in words]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    found = SYMBOL[data]
    found[ends - 1] = END
    return found, data, ends - np.array([len(p) for p in parts]), words


def grams(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The code of each symbol and the DEPTH before it; -1 for the boundaries that stand before texts."""
    codes = np.full(len(found), -1, np.int64)
    wide = found.astype(np.int64)
    code = wide[: len(found) - DEPTH]
    for d in range(1, DEPTH + 1):
        code = code * RADIX + wide[d : len(found) - DEPTH + d]
    codes[DEPTH:] = code
    for d in range(DEPTH):
        codes[starts + d] = -1
    return codes


def count(docs: DataFrame) -> DataFrame:
    """word, code, n: of each word (code null) and each gram (word null; bytes themselves have codes below zero), over all rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not codes:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            keys, at = np.unique(np.concatenate([c for c, _ in codes]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in codes]), len(keys)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = merged()
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[at : at + 100_000])], ["word", "code", "n"])
            items = list(words.items())
            for at in range(0, len(items), 100_000):
                part = items[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in part], pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([c for _, c in part], pa.int64())], ["word", "code", "n"]
                )
            words.clear(), codes.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t.encode("utf-8", "replace").lower() for t in batch.column(1).slice(at, 256).to_pylist()]
                found, data, starts, split = symbols(texts)
                for w in split:
                    words.update(w)
                keys = grams(found, starts)
                own = keys >= 0
                codes.append(np.unique(keys[own], return_counts=True))
                used = np.bincount(data[own & (found != END)], minlength=256)
                codes.append((-1 - np.flatnonzero(used), used[used > 0]))
                codes.append((np.array([-1000]), np.array([len(texts)])))
                size += 1
                if size % 32 == 0:
                    codes[:] = [merged()]
                if len(words) > 300_000 or len(codes) == 1 and len(codes[0][0]) > 1_000_000:
                    yield from flush()
        yield from flush()

    return id_and_text(docs).mapInArrow(tally, "word binary, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def deep_grams(vocabulary: DataFrame) -> DataFrame:
    """code, n: grams of more than DEPTH + 1 symbols inside words, their first boundary included, from (word, c); the context's depth stands
    above the symbols, ``PACK`` bits up."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = batch.slice(at, 50_000)
                words, n = part.column(0).to_pylist(), part.column(1).to_numpy()
                found = SYMBOL[np.frombuffer(b"".join(b" " + w for w in words) + b" ", np.uint8)].astype(np.int64)
                sizes = np.array([len(w) + 1 for w in words])
                # of each symbol after a word's first boundary: how far back that boundary is, and the word's count
                back = np.arange(len(found) - 1) + 1 - np.repeat(np.cumsum(sizes) - sizes, sizes)
                weight, code = np.repeat(n, sizes), found[1:].copy()
                for depth in range(1, DEEP + 1):
                    code[depth - 1 :] += found[: len(found) - depth] * RADIX**depth
                    own = back >= depth
                    if depth > DEPTH and own.any():
                        keys, where = np.unique(code[own], return_inverse=True)
                        sums = np.bincount(where, weight[own], len(keys)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(keys + (depth << PACK)), pa.array(sums)], ["code", "n"])

    return vocabulary.select("word", "c").mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class SuffixTree:
    """nodes: for each depth the codes of the contexts held and their suffixes, numbered on from 1 (0 is the root); row_of: the row of logp that
    a node scores with, its own if it was kept, else that of its longest kept suffix; logp: (rows, RADIX) log10; emit: log10
    share in its class of each byte; least: kept contexts seen less often are in the table only, and have their bits in told: of each DEPTH
    symbols, which suffixes (bits 0 to DEPTH - 1) and whether deeper contexts (bit DEPTH) are there, and the filter of the deeper ones.
    """

    nodes: tuple
    row_of: np.ndarray
    logp: np.ndarray
    emit: np.ndarray
    least: int = 0
    told: tuple[np.ndarray, np.ndarray] | None = None

    def walk_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The deepest node of at most ``STATES`` symbols for all that many last symbols; of each node the row of its children (0: none), and
        a row's children by the symbol that stands before."""
        out, at, first = np.zeros(RADIX**STATES, np.int32), 1, []
        for depth, codes in enumerate(self.nodes, 1):
            first.append(at)
            if depth <= STATES:
                out.reshape(RADIX ** (STATES - depth), RADIX**depth)[:, codes] = np.arange(at, at + len(codes), dtype=np.int32)
            at += len(codes)
        row_of, rows, many = np.zeros(at, np.int32), [np.zeros((1, RADIX), np.int32)], 1
        for depth in range(STATES, len(self.nodes)):
            codes, below = self.nodes[depth], self.nodes[depth - 1]
            suffix = codes % RADIX**depth
            if len(below):
                where = np.searchsorted(below, suffix).clip(0, len(below) - 1)
                there = below[where] == suffix
                parents, place = np.unique(where[there], return_inverse=True)
                own = np.zeros((len(parents), RADIX), np.int32)
                own[place, codes[there] // RADIX**depth] = first[depth] + np.flatnonzero(there)
                row_of[first[depth - 1] + parents] = many + np.arange(len(parents))
                rows.append(own)
                many += len(parents)
        return out, row_of, np.concatenate(rows)

    def score(self, found: np.ndarray, data: np.ndarray, starts: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        states, row_of, child = tables
        codes = grams(found, starts)
        at = np.flatnonzero(codes >= 0)
        node = states[codes[at] >> 6 & RADIX**STATES - 1]
        going = np.arange(len(at))
        for depth in range(STATES + 1, len(self.nodes) + 1):
            row = row_of[node[going]]
            more = (row > 0) & (at[going] >= depth)
            going, row = going[more], row[more]
            deeper = child[row, found[at[going] - depth]]
            going, deeper = going[deeper > 0], deeper[deeper > 0]
            node[going] = deeper
        out = np.zeros(len(found))
        out[at] = self.logp[self.row_of[node], found[at]] + np.where(found[at] == END, 0.0, self.emit[data[at]])
        return np.add.reduceat(out, starts) if len(starts) else np.zeros(0)

    def others(self, found: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Of each text, what is to be looked up in the table: depth, context and next symbol, 3 + 42 + 6 bits."""
        codes = grams(found, starts)
        at = np.flatnonzero(codes >= 0)
        context, places, keys, (mask, deeper) = codes[at] >> 6, [], [], self.told
        there = mask[context]

        def ask(depth: int, own: np.ndarray) -> None:
            places.append(at[own])
            keys.append((context[own] & RADIX**depth - 1 | depth << 6 * DEEP) << 6 | found[at[own]])

        for depth in range(1, DEPTH + 1):
            ask(depth, np.flatnonzero(there >> np.uint8(depth - 1) & 1))
        own = np.flatnonzero(there >> np.uint8(DEPTH))
        at, context = at[own], context[own]
        for depth in range(DEPTH + 1, DEEP + 1):
            inside = (at >= depth) & (found[at - depth + 1] != BOUNDARY)  # contexts of this depth are inside words
            at, context = at[inside], context[inside] + found[at[inside] - depth].astype(np.int64) * RADIX ** (depth - 1)
            a, b = _slots(depth, context)
            ask(depth, np.flatnonzero(deeper[a >> 3] >> (a & 7) & deeper[b >> 3] >> (b & 7) & 1))
        place, key = np.concatenate(places), np.concatenate(keys)
        order = np.argsort(place, kind="stable")
        return np.split(key[order], np.searchsorted(place[order], starts[1:])) if len(starts) else []


def _tested(seen: np.ndarray, above: np.ndarray, divergence: float) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts with next-symbol counts ``seen`` and suffix distributions ``above``: which are kept, and their distributions. A
    thousand at once, so that what is held beside the result stays small."""
    kept, rows = np.zeros(len(seen), bool), np.array(above, np.float64)
    for at in range(0, len(seen), 1024):
        x, q = seen[at : at + 1024], above[at : at + 1024]
        s = x.sum(1, keepdims=True)
        own = (x * np.log(np.where(x > 0, x / s / q, 1.0))).sum(1) >= divergence
        mass = 2.0 * (x > 0).sum(1, keepdims=True)
        kept[at : at + 1024] = own
        rows[at : at + 1024][own] = ((x + mass * q) / (s + mass))[own]
    return kept, rows


def _contexts(g: np.ndarray, n: np.ndarray, support: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of grams that are seen ``support`` times, sorted, and the counts of their next symbols."""
    c, at = np.unique(g // RADIX, return_inverse=True)
    often = np.bincount(at, n, len(c)) >= support
    own, place = often[at], np.cumsum(often) - 1
    following = np.zeros((int(often.sum()), RADIX))
    np.add.at(following, (place[at[own]], g[own] % RADIX), n[own])
    return c[often], following


NODE = "depth int, c long, s long, logp array<float>, gap array<float>"


def _node_batch(depth: int, c: np.ndarray, seen: np.ndarray, rows: np.ndarray, above: np.ndarray) -> pa.RecordBatch:
    logp = np.log10(rows)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * RADIX), pa.array(x.ravel().astype(np.float32))) for x in (logp, logp - np.log10(above))]
    columns = [pa.array(np.full(len(c), depth, np.int32)), pa.array(c), pa.array(seen.sum(1).astype(np.int64)), *lists]
    return pa.RecordBatch.from_arrays(columns, ["depth", "c", "s", "logp", "gap"])


def root_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The root's distribution; the grams of ``TRUNK`` + 1 symbols (as many as the alphabet allows at most) and their counts."""
    codes = counts.where("code is not null and code >= 0")
    got = codes.groupBy(F.pmod("code", F.lit(RADIX ** (TRUNK + 1))).alias("g")).agg(F.sum("n").alias("n")).toArrow()
    g, n = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    root = np.bincount(g % RADIX, n, RADIX)
    return (root + 0.5) / (root.sum() + 0.5 * RADIX), g, n


def nodes_of(counts: DataFrame, deep: DataFrame, support: int = SUPPORT, divergence: float = DIVERGENCE) -> DataFrame:
    """All kept contexts but the root, as stored rows: depth, c, s (times seen), logp and its gap to that of the longest kept suffix."""
    spark = counts.sparkSession
    root, g, n = root_of(counts)
    above, trunk = root[None], []
    for depth in range(1, TRUNK + 1):
        c, seen = _contexts(g % RADIX ** (depth + 1), n, support)
        over = above[c % RADIX ** (depth - 1)]
        kept, rows = _tested(seen, over, divergence)
        trunk.append(_node_batch(depth, c[kept], seen[kept], rows[kept], over[kept]))
        above = np.tile(above, (RADIX, 1))  # a context of this depth has the row of its suffix if it is not one of these
        above[c] = rows
    sent = spark.sparkContext.broadcast(above)

    def branch(table: pa.Table) -> pa.Table:
        codes, n = (table.column(x).to_numpy().astype(np.int64) for x in ("code", "n"))
        depths, codes = codes >> PACK, codes & ((1 << PACK) - 1)
        first = int(codes[0] // RADIX % RADIX**TRUNK)
        known, rows, out = np.array([first]), sent.value[first][None], []
        for depth in range(TRUNK + 1, DEEP + 1):
            own = depths == max(depth, DEPTH)
            c, seen = _contexts(codes[own] % RADIX ** (depth + 1), n[own], support)
            if not len(c):
                break
            suffix = c % RADIX ** (depth - 1)
            over = rows[np.searchsorted(known, suffix)]  # seen at least as often as the context itself
            kept, rows = _tested(seen, over, divergence)
            known = c
            out.append(_node_batch(depth, c[kept], seen[kept], rows[kept], over[kept]))
        return pa.Table.from_batches(out or [trunk[0].slice(0, 0)])

    grams_ = counts.where("code is not null and code >= 0").select((F.col("code") + F.lit(DEPTH << PACK)).alias("code"), "n").unionByName(deep)
    last = F.shiftright("code", 6).bitwiseAND(F.lit(RADIX**TRUNK - 1))
    branches = grams_.withColumn("last", last).groupBy("last").applyInArrow(branch, NODE)
    return stored(branches.unionByName(spark.createDataFrame(pa.Table.from_batches(trunk), NODE)), "lm-tree")


def _slots(depth: np.ndarray | int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a context in the filter."""
    key = (c.astype(np.uint64) * np.uint64(8) + np.asarray(depth, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return (key >> np.uint64(64 - FILTER)).astype(np.int64), (key & np.uint64((1 << FILTER) - 1)).astype(np.int64)


def _told(rest: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the contexts of ``rest``: the byte of each DEPTH symbols, and the filter over deeper ones, eight bits a byte."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, c = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            low, bit = c % RADIX**DEPTH, np.int64(1) << np.minimum(depth - 1, DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(depth, DEPTH)), pa.array(low >> 3), pa.array(bit << 8 * (low & 7))], ["d", "w", "b"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_slots(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(both >> 3), pa.array(1 << (both & 7))], ["w", "b"])

    got = rest.select("depth", "c").mapInArrow(places, "d long, w long, b long").groupBy("d", "w").agg(F.bit_or("b").alias("b")).toArrow()
    depth, at, bits = (got.column(i).to_numpy().astype(np.int64) for i in range(3))
    mask = np.zeros(RADIX**DEPTH, np.uint8)
    for d in range(1, DEPTH + 1):
        own = np.zeros(max(RADIX**d // 8, 1), np.int64)
        own[at[depth == d]] = bits[depth == d]
        mask.reshape(-1, RADIX**d)[:] |= own.view(np.uint8)[: RADIX**d]  # every DEPTH symbols with this suffix
    got = rest.where(F.col("depth") > DEPTH).select("depth", "c").mapInArrow(slots, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    deeper = np.zeros(1 << (FILTER - 3), np.uint8)
    deeper[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return mask, deeper


def grow(counts: DataFrame, deep: DataFrame, nodes: DataFrame | None = None, held: int = HELD) -> SuffixTree:
    """What workers get of the tree: of ``nodes`` (made here if they aren't given) about ``held`` of the most frequent."""
    nodes = nodes_of(counts, deep) if nodes is None else nodes
    bytes_ = {-1 - r["code"]: r["n"] for r in counts.where("code between -256 and -1").collect()}
    used = np.array([bytes_.get(b, 0) for b in range(256)], float) + 0.5
    used[SYMBOL == BOUNDARY] = 1e-9
    used[32] = 1.0  # a boundary is written as one blank
    emit = np.log10(used / np.bincount(SYMBOL, used, RADIX)[SYMBOL])
    # a cut at a power of 2 ** (1/8): what is held holds its kept suffixes too, which are seen as often at least
    grade = F.floor(F.log2("s") * 8).cast("int")
    sizes = sorted(((r["k"], r["n"]) for r in nodes.groupBy(grade.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    sums = np.cumsum([n for _, n in sizes])
    least = min((k for (k, _), n in zip(sizes, sums) if n <= held), default=1 << 20)
    got = nodes.where(grade >= least).select("depth", "c", "logp").toArrow()
    depths, c = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    rows = np.concatenate([np.log10(root_of(counts)[0])[None], got.column(2).combine_chunks().flatten().to_numpy().reshape(-1, RADIX)]).astype(np.float32)
    own = [np.flatnonzero(depths == d) for d in range(1, DEEP + 1)]
    codes = [c[at] for at in own]
    for d in range(DEEP - 1, 0, -1):  # a walk needs the suffixes too
        codes[d - 1] = np.unique(np.concatenate([codes[d - 1], codes[d] % RADIX**d]))
    codes = [np.unique(x) for x in codes]
    row_of, above = [0], {0: 0}
    for d, (at, all_) in enumerate(zip(own, codes), 1):
        kept = dict(zip(c[at].tolist(), (at + 1).tolist()))
        above = {x: kept.get(x, above[x % RADIX ** (d - 1)]) for x in all_.tolist()}
        row_of += above.values()
    told = _told(nodes.where(grade < least)) if len(depths) < (sums[-1] if len(sums) else 0) else None
    return SuffixTree(tuple(codes), np.array(row_of, np.int32), rows, emit, least, told)


_states: dict[str, tuple] = {}


def score(docs: DataFrame, counts: DataFrame, tree: SuffixTree, nodes: DataFrame, folds: int = 5, held_out: int = 1, words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    ends = (counts.where("code = -1000").agg(F.sum("n")).first()[0]) or 0
    vocabulary = counts.where("word is not null").select("word", F.col("n").alias("c"))
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (1 if ends else 0)
    below = n + 0.5 * (v + 1)
    value = lambda c: log10((c + 0.5) / below)
    frequent = {bytes(r["word"]): value(r["c"]) for r in vocabulary.where(F.col("c") >= max(2, n // words)).toLocalIterator()}
    sent = spark.sparkContext.broadcast((frequent, tree, value(ends), int(ends > 0)))
    key = uuid.uuid4().hex  # a worker may outlive a tree

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own_tree, end, end_known = sent.value
        if key not in _states:
            _states.clear()
            _states[key] = own_tree.walk_tables()
        states, row = _states[key], TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256)
                found, data, starts, split = symbols([t.encode("utf-8", "replace").lower() for t in batch.column(1).slice(at, 256).to_pylist()])
                scores = own_tree.score(found, data, starts, states)
                unheld = [] if own_tree.told is None else own_tree.others(found, starts)
                sizes = np.cumsum([0, *map(len, unheld)] if unheld else np.zeros(len(ids) + 1)).astype(np.int32)
                base, seen, rare = [], [], []
                for own in split:
                    values = list(map(known.get, own))
                    other = [w for w, x in zip(own, values) if x is None] if None in values else []
                    rare.append(other)
                    seen.append(len(own) - len(other) + end_known)
                    base.append(sum(filter(None, values) if other else values) + end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + len(ids)), pa.int64()), ids, pa.array([fold_py(i, folds) == held_out for i in ids.to_pylist()], pa.bool_()),
                        pa.array([len(w) + 1 for w in split], pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()),
                        pa.array(rare, pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(unheld) if unheld else [], pa.int64())),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "seen", "base", "score", "rare", "unheld"],
                )
                row += len(ids)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, seen long, base double, score double, rare array<binary>, unheld array<long>"
    judged = stored(id_and_text(docs).mapInArrow(judge, schema), "lm-scores")
    rare = judged.select("row", F.explode("rare").alias("word")).join(vocabulary, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    parts = rare.select("row", F.log10((c + 0.5) / below).alias("more"), F.col("c").alias("known"), F.lit(0.0).alias("gap"))
    if tree.told is not None:
        table = nodes.where(F.floor(F.log2("s") * 8) < tree.least).select((F.col("c") + F.shiftleft(F.col("depth").cast("long"), 6 * DEEP)).alias("node"), "gap")
        asked = judged.select("row", F.explode("unheld").alias("k")).select("row", F.shiftright("k", 6).alias("node"), F.col("k").bitwiseAND(F.lit(RADIX - 1)).cast("int").alias("x"))
        gap = F.element_at("gap", F.col("x") + 1).cast("double").alias("gap")
        parts = parts.unionByName(asked.join(table, "node").select("row", F.lit(0.0).alias("more"), F.lit(None).cast("long").alias("known"), gap))
    more = parts.groupBy("row").agg(F.sum("more").alias("more"), F.count("known").alias("also"), F.sum("gap").alias("gap"))
    return judged.drop("rare", "unheld").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("seen") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gap", F.lit(0.0))).alias("score"),
    )


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1, held: int = HELD) -> DataFrame:
    counts = stored(count(docs.where(fold(F.col("doc_id").cast("long"), folds) != held_out)), "lm-counts")
    deep = stored(deep_grams(counts.where("word is not null").select("word", F.col("n").alias("c"))), "lm-deep")
    nodes = nodes_of(counts, deep)
    return score(docs, counts, grow(counts, deep, nodes, held), nodes, folds, held_out)
