"""Cosine similarity of stated query vectors with all vectors, by products of blocks.

Vectors and queries are dealt to blocks of a bounded number of bytes, and each pair of blocks meets in one task, where a matrix
product gives all cosines at once. No pair leaves the task: of each query only its k best vectors, or its least and greatest cosine, do, and
these merge associatively. What is shuffled is each vector once for every block of queries, and each query once for every block of vectors.

Vectors meet those of their own length only. Null vectors are left out; one without length has cosine 0 to all. A query does
not meet the vector of its own id. Cosines are rounded to six places before they are ranked; ties go to the least id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, top

#: Bytes of a block at most, on average; as doubles in a task they are twice as many.
BLOCK_BYTES = 32 << 20
#: Queries that a product is made for at once.
STRIPE = 512
#: Postings of a block of chunks, on average.
BLOCK_POSTINGS = 500_000


def _blocks(df: DataFrame, column: str) -> int:
    n, size = df.select(F.count("*"), F.coalesce(F.sum(F.size(column).cast("long") * 4), F.lit(0))).first()
    return max(1, min(n, -(-size // BLOCK_BYTES)))


def _paired(vectors: DataFrame, queries: DataFrame, summary: Callable, schema: str) -> DataFrame:
    """``summary(query ids, vector ids, cosines)``, as columns, of each pair of blocks; cosines of a query with its own id are NaN."""
    v = spread(vectors.where(F.col("embedding").isNotNull())).select("vec_id", "embedding", F.size("embedding").alias("n"))
    q = queries.where(F.col("embedding").isNotNull()).select("vec_id", "embedding", F.size("embedding").alias("n"))
    across, down = _blocks(q, "embedding"), max(_blocks(v, "embedding"), v.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda df, own, k, other, n: df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(k))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    v, q = dealt(v, "i", down, "j", across), dealt(q, "j", across, "i", down)

    def product(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64")
            m = np.nan_to_num(flat).reshape(t.num_rows, -1)
            length = np.sqrt((m * m).sum(1))
            return t.column("vec_id").to_numpy(), m / np.where(length > 0, length, 1)[:, None]

        out = []
        if left.num_rows and right.num_rows:
            ids, m = matrix(left)
            asked, a = matrix(right)
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            for lo in range(0, len(asked), STRIPE):
                cos = np.round(a[lo : lo + STRIPE] @ m.T, 6) + 0.0
                cos[asked[lo : lo + STRIPE, None] == ids[None]] = np.nan
                out.append(summary(np, asked[lo : lo + STRIPE], ids, cos))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0) for _ in schema.split(", ")]
        kinds = [pa.int64() if c.endswith(" long") else pa.float64() for c in schema.split(", ")]
        return pa.table([pa.array(x.astype("int64" if k == pa.int64() else "float64")) for x, k in zip(parts, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    keys = ("n", "i", "j")
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(product, schema)


def _k_best(k: int) -> Callable:
    """Row's id, column's id and value of the k largest of each row of ``values``; NaN is none. Made here so that it travels by value."""

    def best(np, asked, ids, values):
        # ids ascend, so a stable sort leaves ties in their order; NaN goes last and is dropped
        if values.shape[1] > 4 * k:
            bound = np.partition(np.nan_to_num(-values, nan=np.inf), k - 1, axis=1)[:, k - 1]
            rows, columns = np.nonzero(-values <= bound[:, None])
        else:
            rows, columns = np.nonzero(~np.isnan(values))
        values = values[rows, columns]
        order = np.lexsort((columns, -values, rows))
        rows, columns, values = rows[order], columns[order], values[order]
        first = np.searchsorted(rows, rows, side="left")
        kept = np.arange(len(rows)) - first < k
        return asked[rows[kept]], ids[columns[kept]], values[kept]

    return best


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, cosine, rank of the k nearest vectors of each query; both tables have vec_id, embedding."""
    found = _paired(vectors, queries, _k_best(k), "query_id long, vec_id long, cosine double")
    return top(found, k, ["query_id"], F.desc("cosine"), F.asc("vec_id"))


def bounds(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, least, most: the range of each query's cosines with all other vectors."""

    def ends(np, asked, ids, cos):
        some = ~np.isnan(cos).all(1)
        return asked[some], np.nanmin(cos[some], axis=1), np.nanmax(cos[some], axis=1)

    found = _paired(vectors, queries, ends, "query_id long, least double, most double")
    return found.groupBy("query_id").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def best_scores(posted: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """qid, chunk_id, score, rank: of many questions the k best chunks each, by the sum of tf * weight over common terms, ties by chunk_id.

    ``posted``: chunk_id, term, tf; ``weights``: qid, term, weight, above zero; both long or double, written, without nulls. Many questions ask for nearly every
    chunk, so their pairs are scored where a block of chunks meets a block of questions, by a product of its counts with their weights."""
    down = max(posted.sparkSession.sparkContext.defaultParallelism, -(-posted.count() // BLOCK_POSTINGS))
    across = max(1, -(-weights.select("qid").distinct().count() // STRIPE))
    dealt = lambda df, own, key, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    p = dealt(posted.select("chunk_id", "term", F.col("tf").cast("double").alias("tf")), "i", "chunk_id", down, "j", across)
    w = dealt(weights.select("qid", "term", F.col("weight").cast("double").alias("weight")), "j", "qid", across, "i", down)

    best = _k_best(k)

    def product(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = (("qid", np.int64), ("chunk_id", np.int64), ("score", np.float64))
        out = [tuple(np.empty(0, t) for _, t in kinds)]
        if left.num_rows and right.num_rows:
            terms = pc.unique(right.column("term"))
            place = lambda t: pc.index_in(t.column("term"), value_set=terms)
            qids, q = np.unique(right.column("qid").to_numpy(), return_inverse=True)
            w = np.zeros((len(terms), len(qids)))
            w[place(right).to_numpy(), q] = right.column("weight").to_numpy()
            at = place(left)
            left, at = left.filter(pc.is_valid(at)), at.drop_null().to_numpy()
            ids, chunk = np.unique(left.column("chunk_id").to_numpy(), return_inverse=True)
            order = np.argsort(chunk, kind="stable")
            cell, tf, chunk = at[order] + chunk[order] * len(terms), left.column("tf").to_numpy()[order], chunk[order]
            for lo in range(0, len(ids), STRIPE):
                n = min(STRIPE, len(ids) - lo)
                a, b = np.searchsorted(chunk, (lo, lo + n))
                m = np.bincount(cell[a:b] - lo * len(terms), tf[a:b], n * len(terms)).reshape(n, len(terms))
                score = np.round(m @ w, 6).T
                score[score <= 0] = np.nan
                out.append(best(np, qids, ids[lo : lo + n], score))
        return pa.table({name: np.concatenate(c).astype(t) for (name, t), c in zip(kinds, zip(*out, strict=True), strict=True)})

    p, w = (df.repartition(down * across, "i", "j") for df in (p, w))  # a stated number: what a task sorts is a few blocks, however many there are
    found = p.groupBy("i", "j").cogroup(w.groupBy("i", "j")).applyInArrow(product, "qid long, chunk_id long, score double")
    return top(found, k, ["qid"], F.desc("score"), F.asc("chunk_id"))
