"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample. Every vector is then put in the cell of its
nearest centroid with one byte for each of SUBSPACES parts of its residual. A query visits its nearest cells: as many as
the sample needed to find RECALL of its true neighbours, and more where those hold too few vectors.

Cells are dealt to blocks of bounded size, and so are the queries that visit a block. A first round moves codes only: a
query's asymmetric distance table (its products with every code of every part) ranks the members of its cells, and each block
tells at which distances it has 1, 2, 4, ... RERANK of them. Added up over blocks this gives each query one distance within
which it has RERANK members in all, twice as many at most but for ties. A second round visits the blocks that have any of
those and measures them, and no others, exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semafold.llm.common import materialise, slices

#: About how many vectors the index is fitted on, picked by a hash; all of them are indexed. 32,768 x 64 doubles are 16 MB.
SAMPLE = 32_768
#: Vectors a cell aims at, and the most cells (their centroids are broadcast).
PER_CELL, MOST_CELLS = 256, 8192
SUBSPACES, CODES, ROUNDS = 16, 256, 8
#: Vectors that are measured exactly for a query, in all; a power of two.
RERANK = 256
#: Share of a sample's true neighbours that the number of visited cells is chosen to reach, on so many of its vectors.
RECALL, TRIED = 0.96, 256
#: Vectors that one task searches at a time (a table of fewer than SPLIT times as many is dealt to about SPLIT blocks), and queries
#: that visit them; rows of a matrix of distances that is held at a time.
BLOCK, SPLIT, VISITORS, STRIP = 8192, 32, 4096, 256


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def nearest_row(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row of x its nearest centre, in strips: the matrix of all distances is never held."""
    return np.concatenate([squared(x[at : at + STRIP], centres).argmin(1) for at in range(0, len(x), STRIP)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of the distinct rows of x, at most k; empty ones keep their place."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest_row(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, cells: int) -> Index:
        centres = kmeans(sample, cells, 1)
        rest = sample - centres[nearest_row(sample, centres)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        return Index(centres, [kmeans(rest[:, a:b], CODES, 2 + i) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))], cuts)

    def parts(self) -> list[tuple[int, int, np.ndarray]]:
        return list(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), self.books, strict=True))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and of each vector what its distance to any query has apart from the query: 2 c.r + r.r for its centre c and
        quantised residual r, as |q - c - r|^2 = |q - c|^2 + (2 c.r + r.r) - 2 q.r."""
        cells = nearest_row(x, self.centres)
        rest = x - self.centres[cells]
        codes = np.stack([nearest_row(rest[:, a:b], book) for a, b, book in self.parts()], axis=1)
        quantised = np.concatenate([book[codes[:, i]] for i, (_, _, book) in enumerate(self.parts())], axis=1)
        return cells, codes.astype(np.uint8), ((2 * self.centres[cells] + quantised) * quantised).sum(1)

    def probes(self, sample: np.ndarray, k: int) -> int:
        """Cells to visit: the rank, among a vector's nearest cells, within which RECALL of its k nearest in the sample lie. Copies are tried once."""
        tried = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
        tried = tried[:: max(1, len(tried) // TRIED)][:TRIED]
        far = squared(tried, sample)
        near = np.argpartition(far, min(k, len(sample) - 1), axis=1)[:, : k + 1]
        ranks = np.empty((len(tried), len(self.centres)), np.int64)
        np.put_along_axis(ranks, squared(tried, self.centres).argsort(1), np.arange(len(self.centres))[None], axis=1)
        cells = nearest_row(sample[near.ravel()], self.centres).reshape(near.shape)
        own = np.take_along_axis(far, near, 1).argmin(1)  # the vector itself
        reached = np.take_along_axis(ranks, cells, 1)
        reached[np.arange(len(tried)), own] = -1
        return int(np.quantile(reached[reached >= 0], RECALL, method="higher")) + 1 if (reached >= 0).any() else 1

    def table(self, query: np.ndarray) -> np.ndarray:
        """Twice the query's product with each code of each part."""
        out = np.zeros((len(self.books), CODES))
        for i, (a, b, book) in enumerate(self.parts()):
            out[i, : len(book)] = 2 * (book @ query[a:b])
        return out


class Members:
    """The codes of a block, and distances by table to those in a query's cells."""

    def __init__(self, index: Index, table: pa.Table):
        self.index, self.ids, self.cells = index, table.column("id").to_numpy(), table.column("cell").to_numpy()
        codes = table.column("codes").combine_chunks()
        codes = np.frombuffer(codes.buffers()[2], np.uint8)[: len(self.ids) * len(index.books)] if not codes.offset else np.frombuffer(b"".join(codes.to_pylist()), np.uint8)
        self.at = codes.reshape(len(self.ids), -1).astype(np.int32) + CODES * np.arange(len(index.books), dtype=np.int32)
        self.bias = table.column("bias").to_numpy()

    def about(self, query: int, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Squared distances by table; infinite for members of other cells and rows of the query's own id."""
        near = np.full(len(self.index.centres), np.inf)
        near[cells] = squared(q[None], self.index.centres[cells])[0]
        out = near[self.cells] + self.bias - self.index.table(q).ravel()[self.at].sum(1)
        out[self.ids == query] = np.inf
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, empty or zero and has finite components only."""
    v = F.col("v")
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return picked.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, rerank: int | None = RERANK) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found of each query, by Euclidean distance in double precision;
    measured: how many vectors were measured exactly for the query.

    Ties go to the smaller id. A query's own id is no candidate. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, as queries or candidates, nor do rows with a null id; all vectors must have one
    length. Repeated rows are candidates each. Other columns are not read; without vectors or queries the result is empty.
    A query gets fewer than k only if there are fewer candidates in all. probes: cells to visit (all of them if there are
    fewer); rerank: vectors to measure exactly, None for all that are visited. Many probes and no rerank give exact answers.
    """
    spark = vectors.sparkSession
    all_, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double, measured long"
    total = all_.count()
    chance = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample = all_.filter(chance).select("v").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:  # none by chance, or none at all
        sample = all_.select("v").limit(CODES).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    points = _matrix(sample.column("v"))
    index = Index.fit(points, int(min(MOST_CELLS, max(1, total // PER_CELL, 4))))
    probes = probes or index.probes(points, k)
    shared = spark.sparkContext.broadcast(index)  # at most MOST_CELLS centres and SUBSPACES x CODES codes
    steps = [1 << i for i in range((rerank or 1).bit_length() - 1)] + [rerank or 1]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            cells, codes, bias = shared.value.encode(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(bias)], names=["id", "v", "cell", "codes", "bias"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STRIP):
            points, need = _matrix(batch.column("v")), batch.column("own").to_numpy() + k
            near = np.argsort(squared(points, shared.value.centres), axis=1, kind="stable")
            short = (np.cumsum(sizes[near], axis=1) < need[:, None]).sum(1)
            rows, blocks, cells = [], [], []
            for i, order in enumerate(near):
                held = np.sort(order[: max(probes, short[i] + 1)])
                held = held[sizes[held] > 0]
                each = np.repeat(first[held], spread[held]) + np.arange(spread[held].sum()) - np.repeat(np.cumsum(spread[held]) - spread[held], spread[held])
                of = np.repeat(held, spread[held])
                begin = np.flatnonzero(np.diff(each, prepend=-1))  # blocks ascend with cells
                rows += [i] * len(begin)
                blocks += each[begin].tolist()
                cells += [x.tolist() for x in np.split(of, begin[1:])] if len(begin) else []
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column("id").take(at), batch.column("v").take(at), pa.array(cells, pa.list_(pa.int64()))], names=["block", "query", "q", "cells"])

    def visitors(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return zip(table.column("query").to_pylist(), _matrix(table.column("q")), (np.array(x) for x in table.column("cells").to_pylist()), strict=True)

    def ranked(members: pa.Table, asking: pa.Table) -> pa.Table:
        """Of each visit the distances at which the block has 1, 2, 4, ... members of the query's cells."""
        found: list[list[float]] = []
        if len(members) and len(asking):
            held = Members(shared.value, members)
            for query, q, cells in visitors(asking):
                about = held.about(query, q, cells)
                if len(about) > steps[-1]:
                    about = np.partition(about, steps[-1] - 1)[: steps[-1]]
                about = np.sort(about)
                found.append([float(about[n - 1]) for n in steps if n <= len(about) and about[n - 1] < np.inf])
        else:
            asking = asking.slice(0, 0)
        return asking.select(["block", "share", "query", "q", "cells"]).append_column("about", pa.array(found, pa.list_(pa.float64())))

    def measured(members: pa.Table, asking: pa.Table) -> pa.Table:
        """The k nearest of a block's members within each query's distance, and how many those are."""
        out: list[tuple] = []
        if len(members) and len(asking):
            held, vectors_ = Members(shared.value, members), _matrix(members.column("v"))
            for (query, q, cells), within in zip(visitors(asking), asking.column("within").to_pylist(), strict=True):
                about = held.about(query, q, cells)
                some = np.flatnonzero((about <= within) & (about < np.inf))
                exact = np.concatenate([np.sqrt(((vectors_[x] - q) ** 2).sum(1)) for x in np.split(some, range(1024, len(some), 1024))])
                best = np.lexsort((held.ids[some], exact))[:k]
                out.append((query, len(some), [{"score": d, "vec_id": i} for d, i in zip(exact[best].tolist(), held.ids[some][best].tolist(), strict=True)]))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))]
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["query_id", "measured", "best"])

    placed = materialise(all_.mapInArrow(encoded, "id long, v array<double>, cell long, codes binary, bias double"), "ivf")
    sizes = np.zeros(len(index.centres), np.int64)
    for cell, n in placed.groupBy("cell").agg(F.count("*")).collect():  # a row a cell: MOST_CELLS at most
        sizes[cell] = n
    size = min(BLOCK, max(512, total // SPLIT))
    spread = -(-sizes // size)  # blocks of a large cell; small ones share a block
    first, at, room = np.zeros(len(sizes), np.int64), -1, 0
    for cell, n in enumerate(sizes.tolist()):
        if n > room:
            at, room = at + 1, size
        first[cell] = at
        if n > size:
            at, room = at + int(spread[cell]) - 1, 0
        else:
            room -= n
    blocks = spark.createDataFrame([(c, int(first[c]), int(spread[c])) for c in np.flatnonzero(sizes).tolist()], "cell long, first long, spread long")
    block = (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("spread"))).alias("block")
    again = placed.groupBy("id").agg(F.count("*").alias("own")).filter("own > 1")  # rows of a query's own id are no candidates
    asked = asked.join(again, "id", "left").select("id", "v", F.coalesce("own", F.lit(1).cast("long")).alias("own"))
    visiting = materialise(asked.mapInArrow(visits, "block long, query long, q array<double>, cells array<long>"), "visits")
    shares = materialise(visiting.groupBy("block").agg(F.ceil(F.count("*") / VISITORS).alias("shares")), "shares")
    members = placed.join(F.broadcast(blocks), "cell").select(block, "id", "v", "cell", "codes", "bias").join(shares, "block")  # a block in as many tasks as its visitors need
    members = members.withColumn("share", F.explode(F.expr("sequence(0L, shares - 1)"))).drop("shares")
    visiting = visiting.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("query"), F.col("shares"))).drop("shares")
    codes = members.select("block", "share", "id", "cell", "codes", "bias")
    known = codes.groupBy("block", "share").cogroup(visiting.groupBy("block", "share")).applyInArrow(ranked, "block long, share long, query long, q array<double>, cells array<long>, about array<double>")
    known = materialise(known.filter("size(about) > 0"), "ranked")
    if rerank:
        each = known.select("query", F.posexplode("about").alias("i", "d")).withColumn("n", F.get(F.array(*[F.lit(b - a) for a, b in zip([0, *steps[:-1]], steps, strict=True)]), F.col("i")))
        by = Window.partitionBy("query").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a few rows a visited block
        within = each.withColumn("n", F.sum("n").over(by)).groupBy("query").agg(F.min(F.when(F.col("n") >= rerank, F.col("d"))).alias("within"))
        known = known.join(within, "query").withColumn("within", F.coalesce("within", F.lit(float("inf")))).filter("about[0] <= within")
    else:
        known = known.withColumn("within", F.lit(float("inf")))
    found = members.groupBy("block", "share").cogroup(known.drop("about").groupBy("block", "share")).applyInArrow(measured, "query_id long, measured long, best array<struct<score: double, vec_id: long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)  # of each block k at most
    found = found.groupBy("query_id").agg(best.alias("best"), F.sum("measured").alias("measured")).select("query_id", F.posexplode("best").alias("at", "b"), "measured")
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score", "measured")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
