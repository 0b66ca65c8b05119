"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives each vector a long string of hash bits (signs of random projections) and keeps the strings sorted, so the
vectors that share a prefix with a query are one stretch of the array. A query goes down all trees to its longest
prefix matches and then up again in all trees at once, a bit at a time, until the stretches hold enough candidates;
prefixes so have the length that the data's density asks for. Candidates are scored exactly.

All rows are indexed: the vectors are dealt into blocks by a hash of their id, each block has its own forest, and blocks of
queries meet every block of vectors; a query's best of all blocks are merged. Blocks grow with the table, so that few copies of a vector are
sent. Vectors of unequal norms are put on a sphere by one more coordinate, which turns the largest inner product into the smallest angle.
Everything but the scores is computed on vectors scaled by powers of two, so that no magnitude overflows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Trees, bits of a hash string, and the part of a block's vectors that a query's stretches hold at least when it
#: stops going up (each vector counted once).
TREES, BITS, PART = 128, 32, 0.35
#: So many candidates are taken at least, or all of a smaller block.
LEAST = 1024
#: Vectors of a block of the index: the least, and the most (of 64 dimensions a forest of these has some 200 MB); between them a table
#: has BLOCKS blocks. Vectors of a block of queries.
BLOCK, MOST_BLOCK, BLOCKS, QUERIES = 8192, 65536, 256, 16384
SEED = 20


def _scaled(x: np.ndarray) -> np.ndarray:
    """x times a power of two, so that its largest component is between 0.5 and 1."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) if x.size else x


class Forest:
    """A forest over distinct vectors (rows of x, float64, scaled)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> None:
        self.x, self.trees, self.bits = x, trees, bits
        self.x32 = x.astype(np.float32)
        norms = np.sqrt((x * x).sum(1))
        self.norm = norms.max()
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * bits)).astype(np.float32)
        more = np.sqrt(np.maximum(0, 1 - (norms / self.norm) ** 2))
        codes = self.codes(np.column_stack([x / self.norm, more]))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """trees x points: hash strings as integers, first bit highest."""
        on = (points.astype(np.float32) @ self.planes > 0).reshape(len(points), self.trees, self.bits)
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return np.ascontiguousarray((on * weights).sum(2, dtype=np.uint64).T)

    def candidates(self, queries: np.ndarray, least: int):
        """For each query the numbers of its candidates, `least` at least if there are so many."""
        norms = np.sqrt((queries * queries).sum(1, keepdims=True))
        codes = self.codes(np.column_stack([queries / norms, np.zeros(len(queries))]))
        n, todo = self.x.shape[0], np.arange(len(queries))
        lo = np.zeros((self.trees, len(queries)), np.int64)
        hi = np.full((self.trees, len(queries)), n, np.int64)
        # any longer prefix is within the stretch of this one, which few vectors share
        depth = min(self.bits, int(np.ceil(np.log2(n + 1))) + 2)
        out: list[np.ndarray | None] = [None] * len(queries)
        while len(todo):
            shift = np.uint64(self.bits - depth)
            for t in range(self.trees):
                first = (codes[t, todo] >> shift) << shift
                lo[t, todo] = np.searchsorted(self.sorted[t], first)
                hi[t, todo] = np.searchsorted(self.sorted[t], first + ((np.uint64(1) << shift) - np.uint64(1)), side="right")
            held = (hi[:, todo] - lo[:, todo]).sum(0)
            rest = []
            for q, k in zip(todo, held):
                if k >= least or depth == 0:
                    mark = np.zeros(n, bool)
                    for t in range(self.trees):
                        mark[self.order[t, lo[t, q] : hi[t, q]]] = True
                    found = np.flatnonzero(mark)
                    if len(found) >= least or depth == 0:
                        out[q] = found
                        continue
                rest.append(q)
            todo, depth = np.array(rest, int), depth - 1
        return out


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, part: float = PART, trees: int = TREES, bits: int = BITS):
    """(query ids, vector ids, scores): each query's k best of its candidates in one block, itself left out. Equal vectors are
    one entry of the forest, with as many of their smallest ids as a result can hold. Scores that overflow are infinite, those that aren't
    numbers (an infinite part less another) come last."""
    kinds, member = np.unique(x, axis=0, return_inverse=True)
    member = member.ravel()
    by = np.lexsort((ids, member))
    starts = np.searchsorted(member[by], np.arange(len(kinds) + 1))
    forest = Forest(_scaled(kinds), trees, bits)
    near = np.stack([_scaled(q) for q in queries]) if len(queries) else queries
    least = min(len(kinds), max(LEAST, 4 * k, int(np.ceil(part * len(kinds)))))
    out_q, out_v, out_s = [], [], []
    for q, (query, small, found) in enumerate(zip(queries, near, forest.candidates(near, least))):
        if len(found) > 4 * k:  # single precision leaves out what can't be among the k + 1 best
            rough = forest.x32[found] @ small.astype(np.float32)
            limit = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            found = found[rough >= limit - 1e-4 * (abs(limit) + forest.norm * np.sqrt((small * small).sum()))]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (kinds[found] * query).sum(1)
        v = [by[starts[f] : min(starts[f + 1], starts[f] + k + 1)] for f in found]
        s = np.repeat(score, [len(a) for a in v])
        v = ids[np.concatenate(v)]
        ok = v != query_ids[q]
        v, s = v[ok], s[ok]
        top = np.lexsort((v, -s))[:k]
        out_q.append(np.full(len(top), query_ids[q]))
        out_v.append(v[top])
        out_s.append(s[top])
    return (np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)) if out_q else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: an id, and a vector without null or non-finite components that isn't zero."""
    v = F.col(column).cast("array<double>")
    fine = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # noqa: E731  NaN is above all numbers
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", fine) & F.exists("v", lambda x: x != 0), F.lit(False)))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, part: float = PART, block: int | None = None, queries: int = QUERIES, column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row whose vec_id is divisible by `every` the k rows, others than
    itself, of the largest inner product that the forest finds; ties go to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part; vectors of different lengths
    don't meet. Of rows that repeat a vec_id those of the same vector count once; an id with several vectors is left out of its
    own results. An empty table gives none.
    """
    rows = staged(valid(vectors, column).distinct(), "vectors")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n = rows.count()
    n_blocks, n_queries = max(1, -(-n // (block or min(MOST_BLOCK, max(BLOCK, -(-n // BLOCKS)))))), max(1, -(-asked.count() // queries))
    h = F.xxhash64("vec_id")
    dim = F.size("v").alias("dim")
    cut = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = rows.select("vec_id", "v", dim, F.pmod(h, F.lit(n_blocks)).cast("int").alias("block"), F.explode(cut(n_queries)).alias("part"))
    right = asked.select("vec_id", "v", dim, F.explode(cut(n_blocks)).alias("block"), F.pmod(h, F.lit(n_queries)).cast("int").alias("part"))

    def meet(index: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(query):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        q, v, s = search_block(index["vec_id"].to_numpy(), np.stack(index["v"]), query["vec_id"].to_numpy(), np.stack(query["v"]), k, part)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    keys = ("dim", "block", "part")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
