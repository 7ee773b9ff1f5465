"""Maximum inner product search: score-aware (anisotropic) product quantisation, four-bit table scans, exact reranking.

The loss of a code is |r|^2 + (eta - 1) (r . x/|x|)^2, r = x - code: error parallel to the vector costs ``eta`` times as much
as error across it, since it is what moves large inner products. Codebooks of 16 words a subspace are fitted on a bounded
sample (``SAMPLE`` rows, chosen by hash); codes are chosen by coordinate descent under the same loss. Every row is indexed.

A block of queries (``QUERY_BLOCK`` at most, give or take what a hash deals) is sent to all tasks; each streams its share of
the index, adds up table entries for its codes, takes the ``SHORTLIST`` best of every batch and all that tie with the last of them,
scores these exactly in double precision from the original vectors, and hands on its best k a query. Equal vectors of a batch are
one candidate: the k smallest ids of each stand for it. The results of all tasks meet in a
window by query. Recall is measured in the tests.

Vectors that are null, zero, hold a null or non-finite component, or are not of the table's usual length take no part. Ties go to
the smaller id; repeated vectors are candidates each, and rows that share a vec_id are queries and candidates each (only a query's own row is
left out of its candidates); with fewer candidates than k, all are returned; an empty table
gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 20_000
QUERY_BLOCK = 2048
SHORTLIST = 96
WORDS = 16
#: Inner products above this share of the norms' product are those that the loss is for.
THRESHOLD = 0.2


@dataclass(frozen=True)
class Quantiser:
    """books: (subspaces, 16, width); a vector is padded with zeros to subspaces * width."""

    books: np.ndarray
    eta: float
    dim: int

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.books.shape
        return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(len(x), m, w)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(3).argmin(2)
        return descend(parts, unit, codes, self.books, self.eta, sweeps)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, subspaces, 16): the products that a scan adds up."""
        return np.einsum("qmw,mkw->qmk", self.split(queries), self.books, optimize=True).astype(np.float32)


def descend(parts: np.ndarray, unit: np.ndarray, codes: np.ndarray, books: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    """Coordinate descent over subspaces on the anisotropic loss; the parallel error couples them."""
    codes, m = codes.copy(), books.shape[0]
    along = np.stack([((parts[:, j] - books[j][codes[:, j]]) * unit[:, j]).sum(1) for j in range(m)], 1)
    total = along.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            gap = parts[:, j, None, :] - books[j][None]
            step = (gap * unit[:, j, None, :]).sum(2)
            cost = (gap**2).sum(2) + (eta - 1) * (step + (total - along[:, j])[:, None]) ** 2
            codes[:, j] = cost.argmin(1)
            fresh = step[np.arange(len(step)), codes[:, j]]
            total += fresh - along[:, j]
            along[:, j] = fresh
    return codes


def fit(x: np.ndarray, width: int = 2, threshold: float = THRESHOLD, iterations: int = 8, seed: int = 0) -> Quantiser:
    """Codebooks from sample vectors: a few k-means steps in each subspace, then steps on the anisotropic loss."""
    dim = x.shape[1]
    m = -(-dim // width)
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    random = np.random.default_rng(seed)
    start = random.integers(0, len(x), (m, WORDS)) if len(x) < WORDS else np.stack([random.permutation(len(x))[:WORDS] for _ in range(m)])
    q = Quantiser(np.zeros((m, WORDS, width)), eta, dim)
    parts = q.split(x)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    books = np.stack([parts[start[j], j] for j in range(m)])
    for _ in range(iterations):
        for j in range(m):
            near = ((parts[:, j, None, :] - books[j][None]) ** 2).sum(2).argmin(1)
            for k in np.unique(near):
                books[j, k] = parts[near == k, j].mean(0)
    codes = ((parts[:, :, None, :] - books[None]) ** 2).sum(3).argmin(2)
    eye = np.eye(width)
    for _ in range(max(1, iterations // 3)):
        codes = descend(parts, unit, codes, books, eta, 1)
        along = np.stack([((parts[:, j] - books[j][codes[:, j]]) * unit[:, j]).sum(1) for j in range(m)], 1)
        for j in range(m):
            others = along.sum(1) - along[:, j]
            for k in np.unique(codes[:, j]):
                own = codes[:, j] == k
                u, v = unit[own, j], parts[own, j]
                left = own.sum() * eye + (eta - 1) * (u.T @ u)
                right = v.sum(0) + (eta - 1) * (u * ((u * v).sum(1) + others[own])[:, None]).sum(0)
                books[j, k] = np.linalg.solve(left, right)
            along[:, j] = ((parts[:, j] - books[j][codes[:, j]]) * unit[:, j]).sum(1)
    return Quantiser(books, eta, dim)


def usable(embeddings: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(row, vec_id, vector) of the vectors that take part, and their length."""
    v = F.col("vector")
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).where(
        "vec_id is not null and vector is not null and size(vector) > 0"
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("s")).first()
    dim = sizes["s"] if sizes else 0
    return rows.where(F.size("vector") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build(rows: DataFrame, dim: int, sample: int = SAMPLE, seed: int = 0) -> tuple[DataFrame, Quantiser]:
    """The index (row, vec_id, code of two subspaces a byte, vector) of every row (row, vec_id, vector), and the quantiser."""
    n = rows.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    draw = F.xxhash64("vec_id", F.lit(seed))
    chosen = rows.where(F.pmod(draw, F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(draw, "vec_id").limit(sample)
    x = np.asarray([r["vector"] for r in chosen.select("vector").toLocalIterator()] or np.ones((1, dim)), float)
    quantiser = fit(x, seed=seed)
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                codes = sent.value.encode(_matrix(part.column(2), dim)).astype(np.uint8)
                if codes.shape[1] % 2:
                    codes = np.pad(codes, ((0, 0), (0, 1)))
                packed = codes[:, ::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), part.column(2)], ["row", "vec_id", "code", "vector"])

    return stored(rows.mapInArrow(encode, "row long, vec_id long, code binary, vector array<double>"), "ann-index"), quantiser


def search(index: DataFrame, quantiser: Quantiser, queries: DataFrame, k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every query (row, vec_id, vector), all rows but its own."""
    spark = index.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    found: DataFrame | None = None
    for b in range(blocks):
        rows = dealt.where(F.col("_block") == b).select("row", "vec_id", "vector").orderBy("row").collect()
        if not rows:
            continue
        own, ids = (np.asarray([r[c] for r in rows], np.int64) for c in ("row", "vec_id"))
        sent = spark.sparkContext.broadcast((own, ids, np.asarray([r["vector"] for r in rows], float), quantiser))
        part = index.mapInArrow(lambda batches, s=sent: _scan(batches, *s.value, k, shortlist), "query long, query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(batches: Iterator[pa.RecordBatch], own_rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, quantiser: Quantiser, k: int, shortlist: int) -> Iterator[pa.RecordBatch]:
    tables = quantiser.tables(vectors)
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    low = np.arange(256)
    pairs = np.ascontiguousarray((tables[:, ::2][:, :, low & 15] + tables[:, 1::2][:, :, low >> 4]).transpose(1, 0, 2))  # a byte's two codes at once
    best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
    best = np.full((len(ids), k), -np.inf)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            rows, vec_ids = part.column(0).to_numpy(), part.column(1).to_numpy()
            codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(vec_ids), -1)
            data = _matrix(part.column(3), quantiser.dim) + 0.0  # -0.0 is 0.0
            # equal vectors: one class, its members in the order of their ids
            order = np.argsort(vec_ids, kind="stable")
            rows, vec_ids, codes, data = rows[order], vec_ids[order], codes[order], data[order]
            _, head, kind = np.unique(data.view(np.dtype((np.void, data.itemsize * data.shape[1]))).ravel(), return_index=True, return_inverse=True)
            members, size = np.argsort(kind, kind="stable"), np.bincount(kind)
            first, codes, data = np.cumsum(size) - size, codes[head], data[head]
            take = min(shortlist, len(head))
            for q in range(0, len(ids), 128):
                own = slice(q, q + 128)
                scores = np.zeros((len(ids[own]), len(head)), np.float32)
                for m in range(codes.shape[1]):
                    scores += pairs[m, own].take(codes[:, m], axis=1)
                last = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
                row, chosen = np.nonzero(scores >= last[:, None])
                exact = np.concatenate([(data[chosen[i : i + 16384]] * vectors[own][row[i : i + 16384]]).sum(1) for i in range(0, len(row), 16384)])
                # k + 1 members of a class are enough, since one may be the query itself
                many = np.minimum(size[chosen], k + 1)
                within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                member = members[np.repeat(first[chosen], many) + within]
                row, exact, found = np.repeat(row, many), np.repeat(exact, many), vec_ids[member]
                other = rows[member] != own_rows[own][row]
                row = np.concatenate([np.repeat(np.arange(len(scores)), k), row[other]])
                all_ids, all_scores = np.concatenate([best_ids[own].ravel(), found[other]]), np.concatenate([best[own].ravel(), exact[other]])
                order = np.lexsort((all_ids, -all_scores, row))
                begin = np.searchsorted(row[order], np.arange(len(scores)))
                top = order[begin[:, None] + np.arange(k)]  # at least the k that were there before
                best_ids[own], best[own] = all_ids[top], all_scores[top]
    real = best > -np.inf
    at, _ = np.nonzero(real)
    yield pa.RecordBatch.from_arrays([pa.array(own_rows[at]), pa.array(ids[at]), pa.array(best_ids[real]), pa.array(best[real])], ["query", "query_id", "vec_id", "score"])


def search_table(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of every row whose id ``every`` divides, against all other rows."""
    rows, dim = usable(embeddings, "vec_id", "embedding")
    if not dim:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, quantiser = build(rows, dim)
    return search(index, quantiser, index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "vector"), k)
