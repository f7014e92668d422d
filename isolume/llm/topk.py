"""Exact top-k search by columnar branch-and-bound.

Queries and candidates meet in blocks. In a block candidates lie in vertical
layout, dimension by dimension in order of falling mass; inner products are
accumulated block of dimensions by block of dimensions. What the remaining
dimensions can add is bounded by the product of the two remaining norms: a
candidate whose upper bound is below the k-th best lower bound is left out, and
once few survive they are compacted into lists. Each query first meets one
block of candidates; the k-th best score found there bounds it in all others.
The best k of each block are merged by rank.

Defined results: vectors that are null, hold null or non-finite components, or
have a null id take no part; a vector's missing dimensions count as 0; rows
that repeat an id are candidates and queries of their own, and only the query's
own row is left out; an empty table gives an empty table. Scores are exact
integers, and so is their order, at any size; a score outside the range of a
long is given as the nearest long, and such scores rank as equals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isolume.llm.common import stored

#: Vector components that a block of candidates or of queries holds, and the fewest and most vectors of a block.
VALUES, LEAST, MOST = 1 << 20, 1024, 16384
#: Queries that advance together, dimensions of one step.
TOGETHER, DIMENSIONS = 64, 16
#: Survivors are compacted once they are less than this share.
FEW = 0.25


def _matrix(table: pa.Table) -> np.ndarray:
    """Rows of floor(scale * x), padded with zeros."""
    lists = table.column("v").combine_chunks()
    width = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(width), int(width.max(initial=0))))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(width)), width), np.arange(len(values)) - np.repeat(np.cumsum(width) - width, width)] = values
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows by rows, in Python's integers, kept in the range of a long."""
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), -(2**63)), 2**63 - 1) for x, y in zip(q, c, strict=True)], np.int64)


def search(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (its candidates' numbers, scores), k at most; own: its own candidate's number, or -1.

    least: scores below which a query's candidates needn't be found.
    """
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    order = np.argsort(-(c * c).sum(axis=0), kind="stable")
    q, down = q[:, order], np.ascontiguousarray(c[:, order].T)
    safe = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(width, 1) < 2**53
    steps = list(range(0, width, DIMENSIONS)) or [0]
    tail_q = [np.sqrt((q[:, s:] ** 2).sum(axis=1)) for s in [*steps[1:], width]]
    tail_c = [np.sqrt((down[s:] ** 2).sum(axis=0)) for s in [*steps[1:], width]]
    # Beyond 2**53 sums are rounded: by this share of the norms' product at most.
    norm_q, norm_c = np.sqrt((q**2).sum(axis=1)), np.sqrt((down**2).sum(axis=0))
    rounding = 0.0 if safe else 4.0 * max(width, 1) * np.finfo(float).eps
    n, out = c.shape[0], []
    for first in range(0, len(q), TOGETHER):
        some = slice(first, min(first + TOGETHER, len(q)))
        mine = q[some]
        score, row, col = np.zeros((len(mine), n)), None, None
        mask = np.ones((len(mine), n), bool)
        has_own = np.flatnonzero(own[some] >= 0)
        mask[has_own, own[some][has_own]] = False
        error = rounding * norm_q[some]
        floor = np.full(len(mine), -np.inf) if least is None else least[some] - error * norm_c.max(initial=0)
        for i, s in enumerate(steps):
            part = slice(s, s + DIMENSIONS)
            slack = 1e-9 * (1 + tail_q[i][some].max(initial=0) * tail_c[i].max(initial=0))
            if row is None:
                score += mine[:, part] @ down[part]
                reach = np.outer(tail_q[i][some], tail_c[i]) * (1 + 1e-9) + slack + (0.0 if safe else np.outer(error, norm_c))
                if n > k:
                    low = np.where(mask, score - reach, -np.inf)
                    floor = np.maximum(floor, np.partition(low, n - k, axis=1)[:, n - k])
                mask &= score + reach >= floor[:, None]
                if mask.mean() < FEW:
                    row, col = np.nonzero(mask)
                    score = score[row, col]
            else:
                score = score + np.einsum("ij,ij->i", mine[row, part], down[part].T[col])
                reach = tail_q[i][some][row] * tail_c[i][col] * (1 + 1e-9) + slack + (0.0 if safe else error[row] * norm_c[col])
                alive = score + reach >= floor[row]
                row, col, score = row[alive], col[alive], score[alive]
        if row is None:
            row, col = np.nonzero(mask)
            score = score[row, col]
        exact = score.astype(np.int64) if safe else _exact(mine[row], down.T[col])
        best = np.lexsort((ids[col], ~exact, row))  # ~x falls as x rises, over the whole range of a long
        begin = np.searchsorted(row[best], np.arange(len(mine) + 1))
        out += [(col[best[a : min(a + k, b)]], exact[best[a : min(a + k, b)]]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, column: str = "embedding") -> DataFrame:
    """Returns query_id, rank, vec_id, score: for every row whose vec_id is divisible by `every` its k best others."""
    spark = vectors.sparkSession
    whole = F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(whole).select(F.col("vec_id").cast("long"), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = F.col("vec_id") % every == 0
    n, n_asked, width = rows.agg(F.count(F.lit(1)), F.count(F.when(asked, 1)), F.max(F.size("v"))).first()
    most = min(MOST, max(LEAST, VALUES // max(width or 1, 1)))
    spread = spark.sparkContext.defaultParallelism
    # Few vectors are dealt to all cores in blocks of LEAST, many in as large blocks as a task may hold.
    blocks = max(1, -(-n // most), min(spread, -(-n // LEAST)))
    query_blocks = max(1, -(-n_asked // most))
    placed = lambda df, count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    candidates = rows.withColumn("cb", placed(rows, blocks))
    queries = rows.filter(asked).withColumn("qb", placed(rows, query_blocks))
    first = F.pmod(F.col("qb"), F.lit(blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, own_rows = right.column("vec_id").to_numpy(), right.column("row").to_numpy()
            where = {r: i for i, r in enumerate(own_rows.tolist())}
            query_rows = left.column("row").to_numpy()
            own = np.array([where.get(r, -1) for r in query_rows.tolist()])
            least = left.column("least").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
            least = np.where(least <= -(2.0**63), -np.inf, least)
            found = search(_matrix(left), _matrix(right), own, ids, k, least)
            each = [len(x) for x, _ in found]
            fields["query_row"], fields["query_id"] = np.repeat(query_rows, each), np.repeat(left.column("vec_id").to_numpy(), each)
            fields["vec_id"], fields["score"] = ids[np.concatenate([x for x, _ in found])], np.concatenate([s for _, s in found])
        return pa.table({name: pa.array(x, pa.int64()) for name, x in fields.items()})

    def near(asking: DataFrame, asked_of: DataFrame) -> DataFrame:
        return asking.groupBy("qb", "cb").cogroup(asked_of.groupBy("qb", "cb")).applyInArrow(meet, "query_row long, query_id long, vec_id long, score long")

    in_turn = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    found = near(queries.withColumn("cb", first).withColumn("least", F.lit(None).cast("long")), candidates.withColumn("qb", in_turn).filter(F.col("cb") == first))
    if blocks > 1:
        found = stored(found, "topk_first")
        kth = found.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        kth = kth.select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("worst")).alias("least"))
        bounded = queries.join(kth, "row", "left").select(*[F.col(c).alias(c) for c in ("vec_id", "v", "row", "qb", "least")])
        others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: x != first)
        rest = near(bounded.withColumn("cb", F.explode(others)), candidates.withColumn("qb", in_turn).filter(F.col("cb") != first))
        found = found.unionByName(rest)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
