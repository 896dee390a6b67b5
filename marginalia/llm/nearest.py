"""Approximate nearest neighbours: inverted lists scanned with an adaptive number of dimensions.

Largest inner product becomes smallest distance by one extra coordinate that gives all vectors the same
length. Vectors are rotated at random, so that any first ``d`` coordinates are a sample of all, and dealt
to lists by a k-means fitted on a bounded sample (``SAMPLE`` rows); every row is indexed. The number of
lists a query probes is calibrated on the same sample: the smallest that holds ``TARGET`` of the true
neighbours, found there by brute force.

A task gets one block of a list and the queries that probe it. It adds up squared differences over column
blocks; after each, a hypothesis test abandons the pairs whose partial distance already exceeds what the
query's twentieth best leaves room for (error factor ``EPSILON``), and only the rest is scored, exactly
and in double precision, on the original vectors. A query's nearest lists go first and give its bound for
all others. Long lists and the queries of a popular list are split into blocks of bounded size, so one
vector that fills a third of the table is many tasks' work, and no task holds more than two blocks.

Defined cases: vectors that are null, zero, of another length than most, or with null or non-finite
components take no part, nor do rows without id. Exact repeats of a row count once; of different vectors
under one id the better one counts. Ties go to the smaller id. Every query gets ``k`` rows, or all candidates if
there are fewer: where its lists hold too few, it probes all the others as well. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.storage import stored

SAMPLE, CALIBRATION = 20_000, 200
MOST_LISTS = 4096
TARGET = 0.96
EPSILON = 2.1
COLUMNS = 16
LIST_BLOCK, QUERY_BLOCK = 8192, 4096


def fit(sample: np.ndarray, total: int, longest: float, k: int, seed: int = 7) -> dict:
    """Rotation, list centres, and how many lists to probe, from a sample of vectors."""
    rng = np.random.default_rng(seed)
    wide = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((wide, wide)))[0].astype(np.float32)
    turned = lift(sample, longest) @ rotation
    lists = int(min(MOST_LISTS, max(1, round(total**0.5 / 2)), len(sample)))
    centres = turned[rng.permutation(len(turned))[:lists]].copy()
    for _ in range(6):
        near = nearest_list(turned, centres)
        for c in np.unique(near):
            centres[c] = turned[near == c].mean(0)
    model = {"rotation": rotation, "centres": centres, "longest": longest, "probes": lists}
    asked = sample[:: max(1, len(sample) // CALIBRATION)]
    if len(sample) > k + 1 and total > 4 * k:
        scores = asked @ sample.T
        true = np.argpartition(-scores, k, axis=1)[:, : k + 1]  # itself, most likely, and k more
        order = probe_order(asked, model)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(lists)[None, :], axis=1)
        needed = np.take_along_axis(rank, nearest_list(turned, centres)[true], axis=1)
        model["probes"] = int(np.quantile(needed, TARGET, method="higher")) + 1
    return model


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Add the coordinate that brings every vector to the length of the longest."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors.astype(np.float64) ** 2).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)


def nearest_list(turned: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres**2).sum(1) - 2 * turned[a : a + 2048] @ centres.T).argmin(1) for a in range(0, len(turned), 2048)] or [np.zeros(0, int)])


def turn_queries(vectors: np.ndarray, model: dict) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1).astype(np.float32) @ model["rotation"]


def probe_order(vectors: np.ndarray, model: dict) -> np.ndarray:
    """All lists for each query, the one with the nearest centre first."""
    turned, centres = turn_queries(vectors, model), model["centres"]
    return np.argsort((centres**2).sum(1) - 2 * turned @ centres.T, axis=1, kind="stable")


def scan(queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, vectors: np.ndarray, ids: np.ndarray, model: dict, k: int):
    """Up to ``k`` best ``(query, vector, score)`` per query in one block; ``bound``: the score to beat or equal."""
    asked, turned = turn_queries(queries, model), lift(vectors, model["longest"]) @ model["rotation"]
    wide = turned.shape[1]
    length = (queries**2).sum(1) + model["longest"] ** 2
    out = []
    for at in range(0, len(queries), 256):
        rows = slice(at, min(len(queries), at + 256))
        q, own, best = asked[rows], length[rows], bound[rows].copy()
        kept = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for low in range(0, len(turned), 1024):
            x = turned[low : low + 1024]
            room = own - 2 * best  # squared distance of the query's k-th best, infinite where none is known
            head = min(wide, 2 * COLUMNS)
            partial = (q[:, :head] ** 2).sum(1)[:, None] + (x[:, :head] ** 2).sum(1)[None, :] - 2 * q[:, :head] @ x[:, :head].T
            a, b = np.nonzero(partial <= _limit(room, head, wide)[:, None])
            part = partial[a, b]
            for first in range(head, wide, COLUMNS):
                done = min(wide, first + COLUMNS)
                part = part + ((q[a, first:done] - x[b, first:done]) ** 2).sum(1)
                left = part <= _limit(room, done, wide)[a]
                a, b, part = a[left], b[left], part[left]
            score = np.einsum("ij,ij->i", queries[rows][a], vectors[low + b])
            other = query_ids[rows][a] != ids[low + b]
            a, b, score = a[other], b[other], score[other]
            edges = np.searchsorted(a, np.arange(len(q) + 1))
            for row in np.flatnonzero(np.diff(edges)):
                own_rows = slice(edges[row], edges[row + 1])
                found = np.concatenate([kept[row][0], ids[low + b[own_rows]]])
                value = np.concatenate([kept[row][1], score[own_rows]])
                order = np.lexsort((found, -value))[:k]
                kept[row] = (found[order], value[order])
                if len(order) == k:
                    best[row] = max(best[row], value[order[-1]])
        out += [(query_ids[rows][row], i, s) for row, (found, value) in enumerate(kept) for i, s in zip(found, value, strict=True) if s >= bound[rows][row]]
    return out


def _limit(room: np.ndarray, done: int, wide: int) -> np.ndarray:
    """The partial squared distance after ``done`` coordinates beyond which a pair is abandoned."""
    slack = 1e-4 * (1 + np.where(np.isfinite(room), np.abs(room), 0))
    if done >= wide:
        return room + slack
    return np.maximum(room, 0) * (done / wide) * (1 + EPSILON / done**0.5) ** 2 + slack


def search(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", asks=None, k: int = 20) -> DataFrame:
    """``query_id, rank, key, score``: the ``k`` rows of largest inner product for each row where ``asks`` holds."""
    spark = vectors.sparkSession
    asks = asks if asks is not None else F.col(key) % 20 == 0
    value = F.transform(column, lambda x: x.cast("double"))
    usable = F.col(key).isNotNull() & F.col(column).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.where(usable).select(F.col(key).cast("long").alias("id"), value.alias("v"), asks.alias("asks"))
    shapes = rows.groupBy(F.size("v").alias("wide")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).collect()
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    if not shapes:
        return empty
    shape = max(shapes, key=lambda r: (r.n, r.wide))
    rows = rows.where(F.size("v") == shape.wide)
    drawn = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / shape.n) * (1 << 30))).select("v").collect()
    drawn = np.array([r.v for r in drawn]) if drawn else np.array([rows.select("v").first().v])
    model = spark.sparkContext.broadcast(fit(drawn, shape.n, shape.most**0.5, k))
    probes, lists = model.value["probes"], len(model.value["centres"])

    def assign(batches):
        m = model.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            near = nearest_list(lift(v, m["longest"]) @ m["rotation"], m["centres"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), batch.column(2)], ["id", "v", "list", "asks"])

    def probing(low: int, high: int):
        """The lists of each query from the ``low``-th to the one before the ``high``-th, likeliest first."""
        def probe(batches):
            m = model.value
            for batch in batches:
                for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                    v = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                    order = probe_order(v, m)[:, low:high]
                    at = pa.array(np.repeat(np.arange(part.num_rows), order.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(order.reshape(-1).astype(np.int32)),
                                                      pa.array(np.tile(np.arange(low, low + order.shape[1], dtype=np.int32), part.num_rows))], ["id", "v", "list", "place"])

        return probe

    indexed = stored(rows.mapInArrow(assign, "id long, v array<double>, list int, asks boolean").dropDuplicates(["id", "v"]), "vector-lists")
    probed = stored(indexed.where("asks").select("id", "v").mapInArrow(probing(0, probes), "id long, v array<double>, list int, place int"), "probes")
    sizes = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"))

    def dealt(probed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """How many blocks and parts each list named is dealt in, a row per list, and the lists' rows so dealt."""
        asked = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
        plan = spark.createDataFrame(sizes.join(asked, "list").collect(), "list int, blocks int, parts int")  # at most MOST_LISTS rows
        return plan, (indexed.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
                      .select("list", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v"))

    def best_of(queries: DataFrame, plan: DataFrame, stock: DataFrame) -> DataFrame:
        """The best of each query in the lists it names, ``query_id, id, score``."""
        asking = (queries.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
                  .select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "id", "v", "bound"))

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                q, x = (t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
                found = scan(q, left["id"].to_numpy(), left["bound"].to_numpy(), x, right["id"].to_numpy(), model.value, k)
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

        keys = ["list", "block", "part"]
        return asking.groupBy(*keys).cogroup(stock.groupBy(*keys)).applyInArrow(work, "query_id long, id long, score double")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = max(1, probes // 8)
    lots = dealt(probed)
    first = stored(best_of(probed.where(F.col("place") < near).withColumn("bound", F.lit(float("-inf"))), *lots), "nearest-first")
    bound = (first.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(ranked))
             .where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound")))
    others = probed.where(F.col("place") >= near).join(bound, "id", "left").select("id", "v", "list", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    every = stored(first.unionByName(best_of(others, *lots)), "nearest-all") if lists > near and probes > near else first

    # where the likeliest lists hold fewer than k rows, the other lists are probed too
    most = min(k, indexed.select("id").distinct().count() - 1)
    full = every.groupBy("query_id").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= most).select(F.col("query_id").alias("id"))
    short = indexed.where("asks").select("id", "v").join(full, "id", "left_anti")
    if lists > probes and not short.isEmpty():
        rest = stored(short.mapInArrow(probing(probes, lists), "id long, v array<double>, list int, place int"), "probes-on")
        every = every.unionByName(best_of(rest.withColumn("bound", F.lit(float("-inf"))), *dealt(rest)))
    best = every.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")
