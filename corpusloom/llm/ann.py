"""Operator 3: nearest neighbours by additive quantisation.

A vector is coded as a sum of ``books`` full-dimensional codewords, one from each
residual codebook, found by beam search over the partial sums.  The codebooks are fitted
to a bounded sample (``SAMPLE`` vectors, those with the smallest hash of their ids), each
to the residuals that the ones before it leave.  The index holds every vector's codes and
its norm beside the vector, in id order.

A search deals index and queries to cells: the index to parts of about ``PART`` vectors,
the queries to blocks of ``QUERY_BLOCK``, and every cell gets one part and one block, so
that nothing passes through the driver and no task holds more than one of either.  A cell
adds up the products of its queries with all codewords by table lookup, divides by the
stored norms, keeps the ``RERANK`` best of its part for each query, and reranks them with
the original vectors in double precision; the best of all parts are then taken.  Which
part a vector is in depends on its id alone, so a rerun finds the same.

Cases: vectors that are null, zero, of another length than the sample's, or hold null or
non-finite components (or a null id) take no part, as query or candidate; equal scores go to the smaller
id, also where a tie is cut; of rows that repeat an id the
smallest vector stays; a query's own id is no candidate; fewer
candidates than asked give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BOOKS, WORDS, BEAM = 8, 256, 4
SAMPLE = 16_384
#: Queries and vectors of a cell, and how many of its vectors are reranked for a query.
QUERY_BLOCK, PART = 16_384, 8192
RERANK = 256
SEED = 7


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) whose sum of words comes nearest, by beam search over the partial sums."""
    n, d = x.shape
    m, k, _ = books.shape
    codes = np.zeros((n, 1, 0), dtype=np.uint8)
    left = x[:, None, :].astype(np.float32)
    for book in books:
        # squared distance of each residual to each word, less the residual's own square
        cost = (left**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * left @ book.T
        width = min(beam, cost.shape[1] * k)
        flat = cost.reshape(n, -1)
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        parent, word = best // k, best % k
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        left = np.take_along_axis(left, parent[:, :, None], 1) - book[word]
    return codes[np.arange(n), np.argmin((left**2).sum(2), axis=1)]


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, rounds: int = 12) -> np.ndarray:
    """(books, words, d): each book by k-means on what the ones before leave of the sample."""
    rng = np.random.default_rng(SEED)
    x = x.astype(np.float32)
    found = np.zeros((0, words, x.shape[1]), np.float32)
    left = x
    for _ in range(books):
        found = np.concatenate([found, kmeans(left, words, rounds, rng)[None]])
        codes = np.concatenate([beam_encode(x[at : at + 2048], found, beam) for at in range(0, len(x), 2048)])
        left = x - decoded(codes, found)
    return found


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    offsets = np.asarray(column.offsets, dtype=np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of extreme components overflow or vanish
    return x / np.sqrt((x**2).sum(1))[:, None]


def build_index(vectors: DataFrame, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray | None]:
    """The index table ``vec_id, codes, norm, v`` of all usable vectors, and the codebooks; None if there are no vectors."""
    rows = usable(vectors)
    drawn = rows.withColumn("_h", F.xxhash64("vec_id")).orderBy("_h", "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    if not len(drawn):
        return rows.select("vec_id", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm"), "v").limit(0), None
    sizes = np.diff(np.asarray(drawn.offsets))
    d = int(np.bincount(sizes).argmax())
    fitted = fit_codebooks(unit(_matrix(drawn.filter(pa.array(sizes == d)))), books, words, beam)

    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("v"))
                codes = beam_encode(unit(x), fitted, beam)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt((decoded(codes, fitted).astype(np.float64) ** 2).sum(1))), part.column("v")], names=["vec_id", "codes", "norm", "v"])

    coded = rows.filter(F.size("v") == d).mapInArrow(encode, "vec_id long, codes binary, norm double, v array<double>")
    return written(coded, "index"), fitted


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        tied = tied[np.argsort(ids[tied], kind="stable")[: k - len(above)]]
        at = np.concatenate([above, tied])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def _scan(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int, rerank: int):
    """(query, candidate, score) of the k nearest in one part of the index; ``q`` and ``x`` are unit vectors, ``ids`` ascend."""
    norms = np.where(norms > 0, norms, 1).astype(np.float32)
    for a in range(0, len(query_ids), 64):
        tables = np.einsum("qd,mkd->mqk", q[a : a + 64].astype(np.float32), books)
        looked = tables[0][:, codes[:, 0]].copy()
        for m in range(1, len(books)):
            looked += tables[m][:, codes[:, m]]
        looked /= norms
        looked[query_ids[a : a + 64, None] == ids] = -np.inf
        for j, row in enumerate(looked, a):
            near = _best(row, ids, rerank)
            near = near[row[near] > -np.inf]
            # an exact sum of its own for each pair: equal vectors get equal scores wherever they are
            exact = (x[near] * q[j]).sum(axis=1)
            for t in _best(exact, ids[near], k).tolist():
                yield int(query_ids[j]), int(ids[near[t]]), float(exact[t])


FOUND = "query_id long, vec_id long, score double"


def _cells(books: np.ndarray, k: int, rerank: int):
    """Rows in order of cell, queries first, and id: each cell's best."""

    def found(held: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(held).combine_chunks().to_batches()[0]
        asks = np.asarray(rows.column("asks").cast(pa.uint8())).astype(bool)
        ids, x = np.asarray(rows.column("vec_id")), unit(_matrix(rows.column("v")))
        own = rows.filter(pa.array(~asks))
        out = []
        if asks.any() and own.num_rows:
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(own.num_rows, -1)
            out = list(_scan(ids[asks], x[asks], ids[~asks], x[~asks], codes, np.asarray(own.column("norm")), books, k, rerank))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    def run(batches):
        cell, held = None, []
        for batch in batches:
            cells = np.asarray(batch.column("cell"))
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and cells[a] != cell:
                    yield found(held)
                    held = []
                cell = int(cells[a])
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield found(held)

    return run


def search(index: DataFrame, books: np.ndarray | None, queries: DataFrame, k: int = 5, rerank: int = RERANK, block: int = QUERY_BLOCK, part: int = PART) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest by cosine of each row of ``queries`` (of the index), itself left out."""
    if books is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks_, parts = (max(1, -(-df.count() // n)) for df, n in ((queries, block), (index, part)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asks = queries.select("vec_id", "v", dealt(blocks_).alias("b")).withColumn("p", every(parts)).select((F.col("p") * blocks_ + F.col("b")).alias("cell"), F.lit(True).alias("asks"), "vec_id", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm"), "v")
    own = index.select("vec_id", "codes", "norm", "v", dealt(parts).alias("p")).withColumn("b", every(blocks_)).select((F.col("p") * blocks_ + F.col("b")).alias("cell"), F.lit(False).alias("asks"), "vec_id", "codes", "norm", "v")
    cells = asks.unionAll(own).repartition(blocks_ * parts, "cell").sortWithinPartitions("cell", F.desc("asks"), "vec_id")
    found = cells.mapInArrow(_cells(books, k, rerank), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Of each vector whose id is divisible by ``every``, its k nearest among all."""
    index, books = build_index(vectors)
    return search(index, books, index.filter(F.pmod("vec_id", F.lit(every)) == 0), k)
