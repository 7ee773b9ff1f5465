"""N-gram Jaccard join with a token-group matrix; components of documents whose shingle sets are similar.

A document's set: its distinct five-word shingles (A-Z lower-cased, words between white space), with fewer words the whole sequence
as one; without words, nothing. Two documents link when 100 |A & B| >= 75 |A | B|. The steps, all exact but for 64-bit
hashes standing for shingles and 128 bits for sets:

1. Equal sets become one class, represented by its smallest doc_id. A class keeps its set as a row of bits too (``sketch``).
2. Similar documents are grouped: each class is verified against the leader (smallest id) of each of its ``HASHES`` min-hash buckets;
   the components of the links found, cut into chunks of about ``CHUNK`` members, are the groups. The token-group matrix has a row of
   bits a group: the union of its members' tokens.
3. A class can only link with a group that has one of its first |A| - ceil(0.75 |A|) + 1 tokens among such tokens of a member, under
   any one global order; this one puts tokens that many documents share last. Runs of one token name the pairs of groups of
   different components whose sizes and token positions allow a link. Runs are read in order, in a stream; those of tokens of more than
   ``HOT`` classes are dealt in blocks over many tasks.
4. For each such pair, a query's overlap with the other group's union is bounded from the matrix: below 0.75 of the query's size,
   the group stays closed. Members of groups that open are bounded one by one in the same way, and what is left is compared exactly,
   the likeliest pair of two components first, the others only where that one fails.
5. Components of all links (alternating large and small stars, written out each round).

Rows that share a doc_id are each judged by their own text; a class is named by its smallest doc_id, so classes of one name share
a component. Null ids have no component; null texts are empty; an empty table gives an empty
result; only doc_id and text are read; no candidate is capped.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, id_filter, id_told, release, stored

WORDS, PERCENT = 5, 75
HASHES, CHUNK, CHUNK_TOKENS, HOT = 4, 64, 60_000, 4096
#: Tokens of two classes or more go last in the order, the more classes the later; of so many tokens at most the counts are
#: sent to the workers, those of the most classes. Any order gives the same links, this one few groups to compare.
COMMON_MOST = 1 << 22
MINS = [f"h{k}" for k in range(HASHES)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1))) * _ODD
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < size:
        whole = np.uint64(len(words))
        for h in hashed:
            whole = mix(np.array([whole], np.uint64) + h, 7)[0]
        return np.array([whole], np.uint64)
    out = hashed[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = out * np.uint64(0x100000001B3) + hashed[k : len(words) - size + 1 + k]
    return np.unique(mix(out, 1))


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap at which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _per_text(make: Callable, names: list[str], types: list) -> Callable:
    """A mapInArrow function: ``make(doc_id, text, *rest)`` gives a row's columns or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [r for r in map(make, *(batch.column(i).slice(at, 256).to_pylist() for i in range(batch.num_columns))) if r is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def sketch(found: np.ndarray) -> bytes:
    """A row of bits, three a token at least, a power of two in all: bit ``token % size`` of each token."""
    size = max(64, 1 << (3 * len(found) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(found & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: int, size: int, to: int) -> int:
    """The row of ``to`` bits of the same tokens."""
    while size > to:
        size >>= 1
        bits = bits >> size | bits & ((1 << size) - 1)
    return bits


def overlap_bound(a: bytes, n: int, b: bytes) -> int:
    """No less than the tokens that the set of ``a`` (n tokens) shares with what ``b`` is the row of: each common token has its bit in
    both rows, and of the n tokens n - |bits| at most hide behind others."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size = 8 * min(len(a), len(b))
    x, y = _folded(x, 8 * len(a), size), _folded(y, 8 * len(b), size)
    return (x & y).bit_count() + n - x.bit_count()


def union_row(rows: list[bytes]) -> bytes:
    """The row of the union of all that ``rows`` are of."""
    size, out = 8 * min(map(len, rows)), 0
    for r in rows:
        out |= _folded(int.from_bytes(r, "little"), 8 * len(r), size)
    return out.to_bytes(size // 8, "little")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, f1 and f2 (the set's fingerprint), h0 to h3 (its min-hashes), sketch."""

    def make(doc_id, text):
        found = shingles(text)
        n = len(found)
        if not n:
            return doc_id, 0, 0, 0, *[None] * HASHES, b""
        f1, f2 = mix(found, 2).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found, 3))
        mins = np.array([mix(found, 10 + k).min() for k in range(HASHES)]).view(np.int64).tolist()
        return doc_id, n, int(f1.astype(np.int64)), int(f2.astype(np.int64)), *mins, sketch(found)

    names = ["doc_id", "n", "f1", "f2", *MINS, "sketch"]
    types = [pa.int64()] * (4 + HASHES) + [pa.binary()]
    return id_and_text(docs).mapInArrow(_per_text(make, names, types), ", ".join(f"{c} long" for c in names[:-1]) + ", sketch binary")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, tokens (packed) of the documents in ``ids`` (doc_id): others are dropped by a bitmap before any text moves."""

    def make(doc_id, text):
        return doc_id, shingles(text).tobytes()

    near = id_filter(id_and_text(docs).where("doc_id is not null"), ids, "doc_id").select("doc_id", "text")
    return near.mapInArrow(_per_text(make, ["doc_id", "tokens"], [pa.int64(), pa.binary()]), "doc_id long, tokens binary")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = sets_of(docs, ids)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # merged, never broadcast: a task that makes sets and compares them too would have two Python workers
    side = lambda c, t: sets.select(F.col("doc_id").alias(c), F.col("tokens").alias(t)).hint("merge")
    joined = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose rows of bits allow a link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [min(overlap_bound(p, i, q), overlap_bound(q, j, p)) >= needed(i, j) for i, p, j, q in zip(n, x, m, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, n, x: classes.select(F.col("class_id").alias(c), F.col("n").alias(n), F.col("sketch").alias(x))
    both = pairs.join(side("b", "m", "y"), "b").join(side("a", "n", "x"), "a").select("a", "b", "n", "x", "m", "y")
    return both.mapInArrow(check, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge (a, b); ``release`` deletes what it is read from. Least neighbours
    are written out before they are joined, so that the join may split a node with very many edges."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # nodes smaller than all their neighbours keep no edge of their own: their neighbours point at them
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), "large")
        small_least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small_least.select("a", F.col("m").alias("b")))
        fresh = stored(small.distinct(), "edges")
        release(edges, least, large, small_least)
        edges = fresh
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._stored_at = edges._stored_at
    return out


def leaders(classes: DataFrame) -> DataFrame:
    """Pairs (a, b): each class and the smallest id of each of its min-hash buckets, where sizes allow a link."""
    buckets = classes.select(F.col("class_id").alias("doc_id"), "n", F.posexplode(F.array(*MINS)).alias("k", "h"))
    first = stored(buckets.groupBy("k", "h").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.count("*").alias("members")).where("members > 1"), "buckets")
    pairs = buckets.join(first.select("k", "h", F.col("first.doc_id").alias("b"), F.col("first.n").alias("m")), ["k", "h"]).where("doc_id <> b")
    out = pairs.where(f"100 * least(n, m) >= {PERCENT} * greatest(n, m)").select(F.col("doc_id").alias("a"), "b").distinct()
    out._stored_at = first._stored_at
    return out


def cells(docs: DataFrame, members: DataFrame, moved: DataFrame, common: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """token, component, chunk, packed (size, position) of each prefix token of each member (doc_id, component, chunk).

    ``moved`` (doc_id) has the documents that aren't members or whose component or chunk isn't simply (doc_id, 0): a bitmap
    tells them, and some others, apart, and only their texts are joined with ``members``. A cell of a token of more than ``HOT``
    classes goes to each pair of blocks that its own block is in.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts, own, chunks = (batch.column(i).slice(at, 256).to_pylist() for i in (0, 1, 2))
                tokens, comps, parts, packed = [], [], [], []
                known, counts, width = sent.value
                for text, component, chunk in zip(texts, own, chunks):
                    found = shingles(text)
                    n = len(found)
                    if not n:
                        continue
                    late = np.zeros(n, np.int64)
                    if len(known):
                        low = _low(found, width)
                        where = np.searchsorted(known, low).clip(0, len(known) - 1)
                        late = np.where(known[where] == low, counts[where], 0).astype(np.int64)
                    order = np.argsort(late, kind="stable")[: prefix_length(n)]
                    first, often, place = found[order], late[order], (n << 32) + np.arange(len(order), dtype=np.int64)
                    if len(often) and often[-1] > HOT:
                        blocks = -(-often // HOT)
                        block = component * 0x9E3779B97F4A7C15 % 2**64 >> 16
                        which = np.repeat(np.arange(len(order)), blocks)
                        other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        mine = block % blocks[which]
                        pair = np.where(blocks[which] > 1, np.minimum(mine, other) * blocks[which] + np.maximum(mine, other) + 1, 0).astype(np.uint64)
                        first, place = np.where(pair > 0, mix(first[which] + pair, 4), first[which]), place[which]
                    tokens.append(first)
                    comps.append(np.full(len(first), component, np.int64))
                    parts.append(np.full(len(first), chunk, np.int64))
                    packed.append(place)
                if tokens:
                    columns = [np.concatenate(x) for x in (tokens, comps, parts, packed)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], ["token", "component", "chunk", "packed"])

    told = id_told(id_and_text(docs).where("doc_id is not null"), moved, "doc_id")
    still = told.where("not _told").select("text", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("chunk"))
    texts = told.where("_told").join(members, "doc_id").select("text", "component", "chunk").unionByName(still)
    return texts.mapInArrow(run, "token long, component long, chunk long, packed long")


def group_pairs(matrix: DataFrame) -> DataFrame:
    """ca, ka, cb, kb: pairs of groups (component, chunk) of different components that some token's cells allow to link."""

    def pairs(t: np.ndarray, c: np.ndarray, k: np.ndarray, p: np.ndarray) -> Iterator[np.ndarray]:
        n, at = p >> 32, p & 0xFFFFFFFF
        # a run is in the order of sizes; the smaller set of a pair that links has the token early enough for one of its own size
        live = np.flatnonzero(n[:-1] - at[:-1] >= -(-2 * PERCENT * n[:-1] // (100 + PERCENT)))
        step = 1
        while True:  # each cell against the one `step` further, as long as the token lasts and the sizes allow
            live = live[live < len(t) - step]
            live = live[(t[live] == t[live + step]) & (100 * n[live] >= PERCENT * n[live + step])]
            if not len(live):
                return
            i, j = live, live + step
            least = -(-PERCENT * (n[i] + n[j]) // (100 + PERCENT))
            ok = (c[i] != c[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= least)
            i, j = i[ok], j[ok]
            if len(i):
                swap = c[i] > c[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                yield np.stack([c[i], k[i], c[j], k[j]])
            step += 1

    def once(found: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
        key = np.zeros(rows.shape[1], np.uint64)
        for row in rows.view(np.uint64):
            key = mix(key + row, 5)
        return rows[:, np.unique(key, return_index=True)[1]]

    def emit(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in rows], ["ca", "ka", "cb", "kb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        found: list[np.ndarray] = []
        size = 0
        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last token may go on
            held = [x[cut:] for x in cols]
            for part in pairs(*(x[:cut] for x in cols)):
                found.append(part)
                size += part.shape[1]
                if size > 500_000:
                    found = [once(found)]
                    if found[0].shape[1] > 250_000:
                        yield emit(found[0])
                        found = []
                    size = sum(x.shape[1] for x in found)
        for part in pairs(*held):
            found.append(part)
            if len(found) > 1000:
                found = [once(found)]
        yield emit(once(found))

    ordered = matrix.repartition("token").sortWithinPartitions("token", "packed")
    return ordered.mapInArrow(run, "ca long, ka long, cb long, kb long").distinct()


def open_groups(docs: DataFrame, members: DataFrame, classes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) between components, one for each pair of components of which two members link, and the tables they are read from."""
    wanted = pairs.select(F.col("ca").alias("component"), F.col("ka").alias("chunk")).unionByName(pairs.select(F.col("cb").alias("component"), F.col("kb").alias("chunk"))).distinct()
    rows = classes.select(F.col("class_id").alias("doc_id"), "n", "sketch")
    own = stored(members.join(wanted, ["component", "chunk"]).join(rows, "doc_id"), "opened")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unions = [x[0] if len(x) == 1 else union_row(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unions, pa.binary())], ["cb", "kb", "union"])

    matrix = stored(own.groupBy("component", "chunk").agg(F.collect_list("sketch").alias("rows")).mapInArrow(unite, "cb long, kb long, union binary"), "matrix")

    def qualify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, u = (batch.column(i).to_pylist() for i in (4, 5, 6))
            keep = [100 * overlap_bound(p, i, q) >= PERCENT * i for i, p, q in zip(n, x, u)]
            yield pa.RecordBatch.from_arrays(batch.columns[:6], ["ca", "cb", "kb", "a", "n", "x"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(i).to_pylist() for i in range(4, 8))
            bound = [min(overlap_bound(p, i, q), overlap_bound(q, j, p)) for i, p, j, q in zip(n, x, m, y)]
            keep = pa.array([b >= needed(i, j) for b, i, j in zip(bound, n, m)], pa.bool_())
            share = pa.array([b / (i + j) for b, i, j in zip(bound, n, m)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], share], ["ca", "cb", "a", "b", "share"]).filter(keep)

    queries = own.select(F.col("component").alias("ca"), F.col("chunk").alias("ka"), F.col("doc_id").alias("a"), "n", F.col("sketch").alias("x"))
    asked = pairs.join(queries, ["ca", "ka"]).join(matrix, ["cb", "kb"]).select("ca", "cb", "kb", "a", "n", "x", "union")
    # written out, so that a task never has two Python workers
    opened = stored(asked.mapInArrow(qualify, "ca long, cb long, kb long, a long, n long, x binary"), "qualified")
    inside = own.select(F.col("component").alias("cb"), F.col("chunk").alias("kb"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    left = opened.join(inside, ["cb", "kb"]).select("ca", "cb", "a", "b", "n", "x", "m", "y").mapInArrow(compare, "ca long, cb long, a long, b long, share double")
    left = stored(left.distinct(), "candidates")
    release(own, matrix, opened)
    best = stored(left.groupBy("ca", "cb").agg(F.max(F.struct("share", "a", "b")).alias("best")).select("ca", "cb", "best.a", "best.b"), "best")
    done = stored(best.join(verify(docs, best.select("a", "b")), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "done")
    rest = stored(left.join(done.select(F.col("a").alias("ca"), F.col("b").alias("cb")), ["ca", "cb"], "left_anti").join(best.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    release(left, best)
    linked_rest = verify(docs, rest.select("a", "b").distinct())
    return done.unionByName(rest.join(linked_rest, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))), [done, rest]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    signed = stored(signatures(docs), "signatures")
    full = signed.where("n > 0 and doc_id is not null")
    least = full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("class_id"), *[F.min(c).alias(c) for c in MINS], F.first("sketch").alias("sketch"))
    classes = stored(least, "classes")
    led = leaders(classes)
    near = stored(bounded(led, classes), "near")
    first = components(verify(docs, near))
    comps = classes.groupBy(F.col("class_id").alias("doc_id")).agg(F.sum("n").alias("n"))
    comps = stored(comps.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component")), "grouped")
    sizes = stored(comps.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_TOKENS)).alias("chunks")).where("chunks > 1"), "sizes")
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).cast("long")
    members = stored(comps.join(sizes, "component", "left").select("doc_id", "component", chunk.alias("chunk")), "members")
    release(led, near, first, comps, sizes)
    copies = stored(full.select("doc_id").join(members.select("doc_id"), "doc_id", "left_anti").distinct(), "copies")
    common = common_tokens(docs, copies, int(full.agg(F.sum("n")).first()[0] or 0))
    moved = copies.unionByName(members.where("component <> doc_id or chunk <> 0").select("doc_id")).distinct()
    pairs = stored(group_pairs(cells(docs, members, moved, common)), "pairs")
    more, read = open_groups(docs, members, classes, pairs)
    final = components(more)
    place = members.join(final.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    place = place.select(F.col("doc_id").alias("class_id"), F.coalesce("root", "component").alias("component_id"))
    placed = stored(classes.select("f1", "f2", "n", "class_id").join(place, "class_id").select("f1", "f2", "n", "component_id"), "placed")
    release(copies, pairs, *read, final, members, classes)
    with_place = full.select("doc_id", "n", "f1", "f2").join(placed, ["f1", "f2", "n"])
    none = signed.where("n = 0 or doc_id is null")
    return with_place.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def _low(found: np.ndarray, width: int) -> np.ndarray:
    """The leading ``width`` bits of tokens, in four bytes where these suffice."""
    return (found >> np.uint64(64 - width)).astype(np.uint32 if width <= 32 else np.uint64)


def common_tokens(docs: DataFrame, copies: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted tokens, how many classes hold them, their bits) of the tokens of several classes, counted over all tokens of all
    documents but the ``copies`` (doc_id).

    Tasks sort their tokens and send them in ranges, as gaps of two bytes where these suffice; a range is counted by one task.
    ``total`` (all tokens) sets how many ranges there are and how many bits of a token are counted, so that few are mistaken for one
    another.
    """
    bits = max(8, (total // 2_000_000).bit_length())
    width = min(64, max(32, total.bit_length() + 2))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            held.clear()
            part = every >> every.dtype.type(width - bits)
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            rows = [(int(x[0]) >> (width - bits), _packed(x, int(x[0]) >> (width - bits) << (width - bits))) for x in (np.split(every, cuts) if len(every) else [])]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "tokens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    held.append(_low(shingles(text), width))
                    size += len(held[-1])
                if size > 3_000_000:
                    yield flush()
                    size = 0
        yield flush()

    def tally(rows: pd.DataFrame) -> pd.DataFrame:
        low = int(rows["part"].iloc[0]) << (width - bits)
        tokens, n = np.unique(np.concatenate([_unpacked(x, low) for x in rows["tokens"]]), return_counts=True)
        kept = n > 1
        return pd.DataFrame({"token": tokens[kept].view(np.int64), "n": n[kept]})

    told = id_told(id_and_text(docs).where("doc_id is not null"), copies, "doc_id")
    texts = told.where("not _told").select("text").unionByName(told.where("_told").join(copies, "doc_id", "left_anti").select("text"))
    counts = stored(texts.mapInArrow(deal, "part long, tokens binary").groupBy("part").applyInPandas(tally, "token long, n long"), "common")
    level = F.least("n", F.lit(1 << 16))  # the most frequent first, until there are enough
    least, many = 2, 0
    for r in counts.groupBy(level.alias("n")).agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).collect():
        many += r["tokens"]
        if many > COMMON_MOST:
            least = r["n"] + 1
            break
    got = counts.where(level >= least).toArrow()
    tokens = got.column(0).to_numpy().astype(np.int64).view(np.uint64).astype(np.uint32 if width <= 32 else np.uint64)
    n = got.column(1).to_numpy().clip(0, 2**32 - 1).astype(np.uint32)
    order = np.argsort(tokens)
    release(counts)
    return tokens[order], n[order], width


#: A fixed value: the widths of packed gaps.
_WIDTHS = ("<u2", "<u4", "<u8")


def _packed(tokens: np.ndarray, low: int) -> bytes:
    gaps = np.diff(tokens.astype(np.uint64), prepend=np.uint64(low))
    kind = int(gaps.max() >= 1 << 16) + int(gaps.max() >= 1 << 32)
    return bytes([kind]) + gaps.astype(_WIDTHS[kind]).tobytes()


def _unpacked(data: bytes, low: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, _WIDTHS[data[0]], offset=1).astype(np.uint64)) + np.uint64(low)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id. Where ids repeat or are null, rows get numbers of their own
    first, so that every row is a document; rows without words stay.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        dropped = near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti")
    row = fresh(docs, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    dropped = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return numbered.join(dropped, row, "left_anti").drop(row)
