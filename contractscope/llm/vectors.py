"""Vector search in blocks: anisotropic four-bit quantisation with exact reranking, and exact top-k without random access.

Both searches deal the vectors into blocks of bounded size and the queries too; each pair of a query block and a
vector block is one small task. A task returns the best few of its block for each query, so what is merged per
query grows with the number of blocks, not of vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contractscope.llm.frames import blocks


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding", zero_too: bool = True) -> DataFrame:
    """(key, vec) of the rows whose vector is not null or empty and has only finite components, as doubles."""
    kept = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite)
    return kept if zero_too else kept.filter(F.exists("vec", lambda x: x != 0))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search_blocks(queries: DataFrame, rows: DataFrame, task: Callable[[pa.Table, pa.Table], pa.Table], k: int, score: str, n_queries: int, n_rows: int, per_query_block: int, per_block: int) -> DataFrame:
    """The k best (score desc, vec_id) of every query over all rows but those of its own vec_id.

    Blocks are dealt by a hash of the id and each row is sent once to every query block; pairs of blocks meet by an
    equi-join of their numbers. Vectors of another length than the query's are in other blocks and take no part.
    """
    nq, nr = blocks(n_queries, per_query_block), blocks(n_rows, per_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("vec").alias("_d")
    left = queries.select("*", width, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(nq)).cast("int").alias("_q"), every(nr).alias("_r"))
    right = rows.select("*", width, F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(nr)).cast("int").alias("_r"), every(nq).alias("_q"))
    keys = ["_d", "_q", "_r"]

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64() if score == "double" else pa.int64())})
        return task(q, c.sort_by("vec_id"))

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _result(ids: list[np.ndarray], found: list[np.ndarray], scores: list[np.ndarray], kind: pa.DataType) -> pa.Table:
    cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
    return pa.table({"query_id": cat(ids, pa.int64()), "vec_id": cat(found, pa.int64()), "score": cat(scores, kind)})


# --- exact top-k without random access -------------------------------------------------------------------------


def to_levels(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """Turn each component x into floor(scale * x)."""
    return df.withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(scale) * x)))


class SortedLists:
    """One list of each component's values over some rows, in falling order, with the rows they are of."""

    def __init__(self, c: np.ndarray):
        self.c = c
        self.order = np.argsort(-c, axis=0, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(c, self.order, axis=0)
        self.exact = c.astype(float)

    def best(self, q: np.ndarray, k: int, own: slice = slice(0, 0), first: float = 1 / 64, worth: float = 0.8) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that can be among the k best of one query, their exact scores, and the number of cells read.

        A list is read from its top where the query's component is positive and from its bottom where it is negative, each
        to the same depth, and from there on to twice that depth. A cell that was read raises its row's lower bound; what
        a list still holds lies between its last value read and its end, so a row that no list has shown yet stays below
        the sum of the last values. Only when that sum is below the k-th lower bound can reading stop: then every other
        row's upper bound is made from the cells read, and if few rows can still qualify, these get their final scores.
        Cells that are not read take no part. Where a step brings the two less than by the share 1 - `worth` closer, as on
        evenly spread components, the rest of all lists is read at once, after which the lower bounds are the scores.
        `own` are rows that do not count.
        """
        n = len(self.c)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        w_up, w_down = q[up].astype(float), q[down].astype(float)
        worst_up, worst_down = self.value[-1, up] * w_up, self.value[0, down] * w_down
        lower = np.full(n, worst_up.sum() + worst_down.sum())
        apart = float(self.value[0, up] @ w_up + self.value[-1, down] @ w_down - lower[0])
        read, cells, depth = 0, 0, max(1, int(np.ceil(first * n)))

        def kth() -> float:
            mine = lower[own].copy()
            lower[own] = -np.inf
            found = float(np.partition(lower, n - k)[n - k]) if n > k else -np.inf
            lower[own] = mine
            return found

        while depth < n and len(up) + len(down):
            a, b = read, depth
            rows = np.concatenate([self.order[a:b, up].ravel(), self.order[n - b : n - a, down].ravel()])
            lower += np.bincount(rows, np.concatenate([(self.value[a:b, up] * w_up - worst_up).ravel(), (self.value[n - b : n - a, down] * w_down - worst_down).ravel()]), n)
            read, depth, cells = b, 2 * depth, cells + len(rows)
            gap_up, gap_down = self.value[b - 1, up] * w_up - worst_up, self.value[n - b, down] * w_down - worst_down
            edge, outside = kth(), gap_up.sum() + worst_up.sum() + gap_down.sum() + worst_down.sum()
            if outside < edge:
                rows = np.concatenate([self.order[:b, up].ravel(), self.order[n - b :, down].ravel()])
                seen = np.bincount(rows, np.concatenate([np.broadcast_to(gap_up, (b, len(up))).ravel(), np.broadcast_to(gap_down, (b, len(down))).ravel()]), n)
                can = np.flatnonzero(lower + gap_up.sum() + gap_down.sum() - seen >= edge - 1e-9 * abs(edge))
                if len(can) <= max(4 * k, n // 50):
                    break
            elif outside - edge > worth * apart:
                depth = n
            apart = outside - edge
        else:
            lower, cells = self.exact @ q.astype(float), n * (len(up) + len(down))  # all is read
            edge = kth()
            can = np.flatnonzero(lower >= edge - 1e-9 * abs(edge))
        can = can[(can < own.start) | (can >= own.stop)]
        return can, (self.c[can] * q).sum(axis=1), cells


def no_random_access(q: np.ndarray, c: np.ndarray, k: int, own: list[slice]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of c that can be among its k best, with their exact scores; own: rows that do not count."""
    lists = SortedLists(c)
    return [lists.best(x, k, o)[:2] for x, o in zip(q, own, strict=True)]


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, per_query_block: int = 512, per_block: int = 8192) -> DataFrame:
    """Exact k best by integer inner product: (query_id, rank, vec_id, score).

    df has vec_id and vec (whole numbers). Queries are the rows whose vec_id is divisible by `every`. Equal scores go
    to the smaller vec_id. A query without other rows has no result; repeated rows each count as candidates, but not for a query
    of their own vec_id.
    """
    queries = df.filter(F.col("vec_id") % every == 0)
    n_rows, n_queries = df.select(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()

    def task(q: pa.Table, c: pa.Table) -> pa.Table:
        qm, cm = _matrix(q, "vec").astype(np.int64), _matrix(c, "vec").astype(np.int64)
        qi, ci = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
        own = [slice(a, z) for a, z in zip(np.searchsorted(ci, qi), np.searchsorted(ci, qi, side="right"), strict=True)]
        ids, found, scores = [], [], []
        for i, (rows, s) in enumerate(no_random_access(qm, cm, k, own)):
            best = np.lexsort((ci[rows], -s))[:k]
            ids.append(np.full(len(best), qi[i])), found.append(ci[rows[best]]), scores.append(s[best])
        return _result(ids, found, scores, pa.int64())

    return search_blocks(queries, df, task, k, "long", n_queries, n_rows, per_query_block, per_block)


# --- approximate nearest neighbours -----------------------------------------------------------------------------


@dataclass
class Quantiser:
    """Coarse centres and, for each group of components of a residual, sixteen code words."""

    centres: np.ndarray
    words: np.ndarray  # groups x 16 x width
    penalty: float
    spread: np.ndarray  # of each cell: residuals are divided by it, so that tight and loose cells share code words

    def residual(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.argmin((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T, axis=1)
        return cell, self._padded((x - self.centres[cell]) / self.spread[cell, None])

    def _padded(self, x: np.ndarray) -> np.ndarray:
        groups, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, groups * width - x.shape[1]))).reshape(len(x), groups, width)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each row, by the score-aware loss: error along the row costs 1 + penalty times as much."""
        cell, r = self.residual(x)
        u = self._padded(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
        codes = np.stack([np.argmin((w**2).sum(axis=1) - 2 * r[:, g] @ w.T, axis=1) for g, w in enumerate(self.words)], axis=1)
        along = self._along(r, u, codes)
        for _ in range(sweeps):
            for g, w in enumerate(self.words):
                codes[:, g], along = self._best(r[:, g], u[:, g], w, codes[:, g], along)
        return cell, codes.astype(np.uint8)

    def _along(self, r: np.ndarray, u: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return sum(((r[:, g] - w[codes[:, g]]) * u[:, g]).sum(axis=1) for g, w in enumerate(self.words))

    def _best(self, r: np.ndarray, u: np.ndarray, w: np.ndarray, now: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = (r * u).sum(axis=1, keepdims=True) - u @ w.T
        rest = along - part[np.arange(len(r)), now]
        cost = (w**2).sum(axis=1) - 2 * r @ w.T + self.penalty * (rest[:, None] + part) ** 2
        best = np.argmin(cost, axis=1)
        return best, rest + part[np.arange(len(r)), best]

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the inner products with the centres, and with pairs of code words by byte."""
        padded = self._padded(q)
        single = np.einsum("qgw,gcw->qgc", padded, self.words)
        pair = single[:, 0::2, None, :] + single[:, 1::2, :, None]
        return (q @ self.centres.T).astype(np.float32), pair.reshape(len(q), -1, 256).astype(np.float32)


def fit_quantiser(x: np.ndarray, n_centres: int = 64, width: int = 2, threshold: float = 0.2, steps: int = 8, seed: int = 7) -> Quantiser:
    """Fit centres by k-means, and code words by alternating score-aware assignment and least squares."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    centres = x[rng.permutation(len(x))[:n_centres]].copy()
    for _ in range(steps):
        cell = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        size = np.bincount(cell, minlength=len(centres))
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    groups = 2 * -(-d // (2 * width))
    penalty = max(0.0, (d - 1) * threshold**2 / (1 - threshold**2) - 1)
    cell = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
    size = np.maximum(np.bincount(cell, minlength=len(centres)), 1)
    spread = np.sqrt(np.bincount(cell, ((x - centres[cell]) ** 2).sum(axis=1), minlength=len(centres)) / size)
    spread[spread < 1e-9 * max(1e-30, spread.max())] = spread.max() or 1.0
    fit = Quantiser(centres, np.zeros((groups, 16, width)), penalty, spread)
    _, r = fit.residual(x)
    for g in range(groups):
        fit.words[g] = r[rng.integers(0, len(r), 16), g]
    u = fit._padded(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
    for _ in range(steps):
        codes = fit.encode(x, 1)[1].astype(int)
        along = fit._along(r, u, codes)
        for g in range(groups):
            rg, ug, w = r[:, g], u[:, g], fit.words[g]
            rest = along - ((rg - w[codes[:, g]]) * ug).sum(axis=1)
            wanted = rg + penalty * ug * (rest + (rg * ug).sum(axis=1))[:, None]
            for j in range(16):
                m = codes[:, g] == j
                if m.any():
                    w[j] = np.linalg.solve(m.sum() * np.eye(width) + penalty * ug[m].T @ ug[m], wanted[m].sum(axis=0))
            along = rest + ((rg - w[codes[:, g]]) * ug).sum(axis=1)
    return fit


def sample_edge(wanted: float, rows: int) -> int:
    """Which of 2^62 hash values are in a sample of about `wanted` of so many rows; never none."""
    return min(1 << 62, max(1, round(wanted / rows * (1 << 62))))


def train(df: DataFrame, n_rows: int, sample_rows: int = 8192) -> Quantiser | None:
    """Fit on at most sample_rows rows, chosen by a hash of the id; None for an empty table."""
    chosen = df if n_rows <= sample_rows else df.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 62)) < sample_edge(1.1 * sample_rows, n_rows))
    rows = chosen.orderBy("vec_id").limit(sample_rows).collect()
    if not rows:
        return None
    d = max((len(r["vec"]) for r in rows), key=[len(r["vec"]) for r in rows].count)
    return fit_quantiser(np.array([r["vec"] for r in rows if len(r["vec"]) == d]))


def index(df: DataFrame, fit: Quantiser) -> DataFrame:
    """(vec_id, vec, cell, codes) of every row; vectors of another length than the model's have cell -1 and no codes."""
    d = fit.centres.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.diff(batch.column(1).offsets.to_numpy()) == d
            cell, codes = np.full(batch.num_rows, -1), [b""] * batch.num_rows
            if own.any():
                x = batch.column(1).filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                cell[own], made = fit.encode(x)
                packed = made[:, 0::2] | (made[:, 1::2] << 4)
                for i, row in zip(np.flatnonzero(own).tolist(), packed, strict=True):
                    codes[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(codes, pa.binary())], names=["vec_id", "vec", "cell", "codes"])

    return df.mapInArrow(run, "vec_id long, vec array<double>, cell int, codes binary")


def nearest(df: DataFrame, k: int = 20, every: int = 20, rerank: int = 200, per_query_block: int = 1024, per_block: int = 16_384, sample_rows: int = 8192) -> DataFrame:
    """About the k nearest by inner product: (query_id, rank, vec_id, score); scores are exact.

    Every row is indexed by four-bit codes. A task scans the codes of its block by table look-ups and computes exact
    inner products, in double precision, of the `rerank` best. Equal scores go to the smaller vec_id. Vectors meet those of
    their own length only; the quantiser is fitted for the sample's most frequent length, and the vectors of other lengths are
    compared exactly. Repeated vec_ids each count as candidates, but never for a query of that vec_id, and a repeated query has
    its rows' lists merged. An empty table gives an empty result.
    """
    n_rows, n_queries = df.select(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    fit = train(df, n_rows, sample_rows)
    if fit is None:
        return df.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))

    def exactly(qi: np.ndarray, qm: np.ndarray, ci: np.ndarray, cm: np.ndarray) -> pa.Table:
        ids, found, scores = [], [], []
        for i, x in zip(qi, qm, strict=True):
            exact = (cm * x).sum(axis=1)
            best = [r for r in np.lexsort((ci, -exact)) if ci[r] != i][:k]
            ids.append(np.full(len(best), i)), found.append(ci[best]), scores.append(exact[best])
        return _result(ids, found, scores, pa.float64())

    def task(q: pa.Table, c: pa.Table) -> pa.Table:
        qm, cm = _matrix(q, "vec"), _matrix(c, "vec")
        qi, ci, cell = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy(), c.column("cell").to_numpy()
        if cell[0] < 0:
            return exactly(qi, qm, ci, cm)
        codes = np.frombuffer(b"".join(c.column("codes").to_pylist()), np.uint8).reshape(len(ci), -1).T.astype(np.intp)
        spread = fit.spread[cell].astype(np.float32)
        ids, found, scores = [], [], []
        for a in range(0, len(qi), 64):
            coarse, pair = fit.tables(qm[a : a + 64])
            for i in range(len(coarse)):
                s = pair[i, 0].take(codes[0])
                for g in range(1, len(codes)):
                    s += pair[i, g].take(codes[g])
                s = s * spread + coarse[i].take(cell)
                rows = np.arange(len(ci))
                if len(ci) > rerank + 1:
                    edge = np.partition(s, len(s) - rerank - 1)[len(s) - rerank - 1]
                    over = np.flatnonzero(s > edge)
                    rows = np.concatenate([over, np.flatnonzero(s == edge)[: rerank + 1 - len(over)]])
                rows = rows[ci[rows] != qi[a + i]]
                exact = (cm[rows] * qm[a + i]).sum(axis=1)
                best = np.lexsort((ci[rows], -exact))[:k]
                ids.append(np.full(len(best), qi[a + i])), found.append(ci[rows[best]]), scores.append(exact[best])
        return _result(ids, found, scores, pa.float64())

    rows = index(df, fit)
    queries = df.filter(F.col("vec_id") % every == 0)
    return search_blocks(queries, rows, task, k, "double", n_queries, n_rows, per_query_block, per_block)
