"""Near duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

A text's set holds its distinct five-word shingles. Two collections of ``GROUPS`` half keys, each of
``WIDTH`` minhashes, are computed per distinct text; a table key is one half key of the first joined with
one of the second, so ``2 * GROUPS * WIDTH`` minhashes serve ``GROUPS ** 2`` tables of ``2 * WIDTH`` hashes
each. A pair of similarity s meets in no table with probability about ``2 * (1 - s ** WIDTH) ** GROUPS``:
3e-4 at 0.75, 2e-5 at 0.8.

1. Texts of equal word sequences are one node, named by their least id.
2. Half keys that only one node has are dropped before they are combined: unique texts, the bulk of a
   corpus, produce no table rows at all.
3. In each table bucket every node meets the bucket's hub, the node that meets most others over all its
   buckets: for a group of copies with changes, the text they were made from, if it is there. Pairs whose sketches (a byte of each
   minhash) rule out the threshold are dropped, the others are confirmed on both full texts.
4. Connected components over confirmed links. Within one component nothing is left to find, so only
   nodes go on that share a table key with another component. They get a sketch of ``BITS`` bits, meet by
   half keys of the first collection (which every table key contains), and are compared across components
   inside the tasks, in square blocks of at most ``BLOCK`` nodes a side. The few pairs that the sketch
   cannot tell from the threshold are confirmed on full texts. No bucket is expanded into rows of pairs,
   nor capped.

Defined cases: null, empty and blank texts have the empty set, link with nothing and are kept; texts of
one to four words are one shingle; rows of one id are one document with all its texts; a null id takes
no part in linking. Extra columns are ignored. The kept document of a group is the one of least id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.arrow_text import mix, shingles, slices, words
from marginalia.llm.components import components
from marginalia.llm.storage import stored

GROUPS, WIDTH = 16, 3
HASHES = 2 * GROUPS * WIDTH
#: A pair at the threshold agrees on fewer sketch bytes with probability below 1e-6 (binomial, p = 0.75).
SKETCH_AGREE = 50
#: One-bit minhashes of the long sketch. At the threshold a pair differs in an eighth of them; more than
#: BITS_DIFFER, four standard deviations above, happens with probability below 1e-4.
BITS, BITS_DIFFER = 2048, 316
BLOCK = 1024
SIMILAR = (75, 100)

_ODD = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def minhashes(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``HASHES`` minima for each row that has values; rows without any get zeros."""
    out = np.zeros((len(begins) - 1, HASHES), np.uint32)
    filled = np.flatnonzero(np.diff(begins))
    high, low = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    if len(filled):
        for k in range(HASHES):
            out[filled, k] = np.minimum.reduceat(high * _ODD[k] + low * _ODD[HASHES + k], begins[filled])
    return out


def signature(column: pa.Array, block: int = 1 << 16):
    """Set size, digest of the word sequence, both collections of half keys and the sketch of each row."""
    hashed, at = words(column)
    marks, begins = shingles(hashed, at)
    sizes, digests, mins = [], [], []
    for low, high in slices(begins, block):
        own = marks[begins[low] : begins[high]]
        mins.append(minhashes(own, begins[low : high + 1] - begins[low]))
        sizes += [len(np.unique(marks[begins[r] : begins[r + 1]])) for r in range(low, high)]
        digests += [hashlib.blake2b(hashed[at[r] : at[r + 1]].tobytes(), digest_size=16).digest() for r in range(low, high)]
    mins = np.concatenate(mins) if mins else np.zeros((0, HASHES), np.uint32)
    wide = mins.reshape(len(mins), 2 * GROUPS, WIDTH).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, 2 * GROUPS + 1, dtype=np.uint64), wide.shape[:2]).copy()
    for k in range(WIDTH):
        keys = mix(keys + wide[:, :, k])
    return np.array(sizes, np.int64), digests, keys.view(np.int64), mins.astype(np.uint8)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs`` (key of an integer type)."""
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def sign(batches):
        for batch in batches:
            sizes, digests, keys, sketch = signature(batch.column(1))
            half = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), 2 * GROUPS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(digests, pa.binary()), half, pa.array([s.tobytes() for s in sketch], pa.binary())],
                                             ["id", "n_shingles", "digest", "half", "sketch"])

    signed = stored(base.mapInArrow(sign, "id long, n_shingles long, digest binary, half array<long>, sketch binary"), "signatures")
    heads = signed.where(F.col("n_shingles") > 0).groupBy("digest").agg(F.min("id").alias("node"))
    nodes = stored(signed.join(heads, "digest").where(F.col("id") == F.col("node")).select("node", "half", "sketch").dropDuplicates(["node", "sketch"]), "nodes")
    sketches = nodes.select("node", "sketch")

    keys = stored(_table_keys(nodes), "table-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = stored(keys.join(sizes, "key"), "shared-keys")
    hubs = keys.groupBy("node").agg(F.sum("n").alias("met"))
    heads_of = keys.join(hubs, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("head"))
    stars = keys.join(heads_of, "key").where("node <> head").select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")).distinct()
    keys = keys.select("key", "node")
    # Only these can be candidates: all later steps read their texts from here.
    base = stored(base.join(hubs.select(F.col("node").alias("id")), "id", "left_semi"), "open-texts")
    links = stored(_confirm(_plausible(stars, sketches), base), "links")
    first = stored(components(links), "components")

    named = keys.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    rest = stored(named.join(mixed, "key", "left_semi").select("node", "component").distinct(), "open-nodes")
    more = _confirm(_plausible_across(rest, nodes, base), base)
    merged = components(links.select("u", "v").unionByName(more))

    class_of = heads.join(merged, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("id", "n_shingles", "digest").join(class_of, "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _table_keys(nodes: DataFrame) -> DataFrame:
    """``key, node`` of all tables, from half keys that at least two nodes share."""
    halves = nodes.select("node", F.posexplode("half").alias("place", "value"))
    shared = halves.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    kept = halves.join(shared, "value", "left_semi").groupBy("node").agg(
        F.collect_set(F.when(F.col("place") < GROUPS, F.col("value"))).alias("a"), F.collect_set(F.when(F.col("place") >= GROUPS, F.col("value"))).alias("b"))
    return kept.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "node")


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sketches agree on enough bytes."""
    met = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("s")), "u").join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("t")), "v").select("u", "v", "s", "t")

    def agree(batches):
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array((s == t).sum(1) >= SKETCH_AGREE))

    return met.mapInArrow(agree, "u long, v long").distinct()


def long_sketch(column: pa.Array) -> list[bytes]:
    """``BITS`` one-bit minhashes of each row."""
    hashed, at = words(column)
    marks, begins = shingles(hashed, at)
    first, second = _bit_constants()
    out = []
    for low, high in zip(begins[:-1], begins[1:], strict=True):
        least = np.full(BITS, np.uint32(0xFFFFFFFF))
        for k in range(low, high, 256):
            own = marks[k : min(k + 256, high)]
            least = np.minimum(least, ((own >> np.uint64(32)).astype(np.uint32)[:, None] * first + own.astype(np.uint32)[:, None] * second).min(0))
        out.append(np.packbits((least * second) >> np.uint32(31)).tobytes())
    return out


def _bit_constants() -> tuple[np.ndarray, np.ndarray]:
    odd = mix(np.arange(5001, 5001 + 2 * BITS, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    return odd[:BITS], odd[BITS:]


def _plausible_across(rest: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components that share a half key of the first collection and whose long sketches agree.

    ``rest`` has ``node, component`` of the nodes that are left; only their texts are read again.
    """
    def sketch(batches):
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(long_sketch(part.column(1)), pa.binary())], ["node", "sketch"])

    long = texts.join(rest.select(F.col("node").alias("id")), "id", "left_semi").select("id", "text").mapInArrow(sketch, "node long, sketch binary")
    rows = (rest.join(nodes.select("node", F.slice("half", 1, GROUPS).alias("halves")), "node")
            .select(F.explode("halves").alias("key"), "node", "component", "halves"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key", "n")
    held = stored(long, "long-sketches")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = (rows.join(several, "key").join(held, "node").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "component", "halves", "sketch"))
    grouped = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches):
        open_rows: list[pa.RecordBatch] = []

        def pairs(table: pa.Table):
            node, comp, bucket = table["node"].to_numpy(), table["component"].to_numpy(), table["key"].to_numpy()
            halves = table["halves"].combine_chunks().flatten().to_numpy().reshape(-1, GROUPS)
            lo, hi, mine = table["lo"].to_numpy(), table["hi"].to_numpy(), table["mine"].to_numpy()
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            u, v = [], []
            for a, b in zip(edge, [*edge[1:], len(node)], strict=True):
                left = a + np.flatnonzero(mine[a:b] == lo[a])
                right = left if lo[a] == hi[a] else a + np.flatnonzero(mine[a:b] == hi[a])
                for k in left:
                    to = right[(comp[right] != comp[k]) & (node[right] > node[k])] if lo[a] == hi[a] else right[comp[right] != comp[k]]
                    to = to[np.bitwise_count(sketch[to] ^ sketch[k]).sum(1, dtype=np.int64) <= BITS_DIFFER]
                    # a pair that shares several keys is written once, in the bucket of the first of them
                    to = to[halves[k][(halves[to] == halves[k]).argmax(1)] == bucket[k]]
                    u += [np.maximum(node[to], node[k])]
                    v += [np.minimum(node[to], node[k])]
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
            found = np.unique(np.stack([u, v], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(3)]
            same = np.ones(batch.num_rows, bool)
            for k in range(3):
                same &= batch.column(k).to_numpy() == last[k]
            cut = batch.num_rows - int(same.sum())
            ended = cut > 0 or (open_rows and [open_rows[0].column(k)[0].as_py() for k in range(3)] != last)
            if ended:
                yield pairs(pa.Table.from_batches([*open_rows, batch.slice(0, cut)]))
                open_rows = []
            open_rows.append(batch.slice(cut))
        if open_rows:
            yield pairs(pa.Table.from_batches(open_rows))

    return grouped.mapInArrow(compare, "u long, v long").distinct()


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) of similarity 0.75 or more on full shingle sets; only the texts of candidates are moved."""
    pairs = stored(pairs, "candidates")
    wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    held = stored(texts.join(wanted, "id", "left_semi"), "candidate-texts")
    met = (pairs.join(held.select(F.col("id").alias("u"), F.col("text").alias("s")), "u")
           .join(held.select(F.col("id").alias("v"), F.col("text").alias("t")), "v").select("u", "v", "s", "t"))

    def verify(batches):
        share, whole = SIMILAR
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                (s, at_s), (t, at_t) = (shingles(*words(part.column(k))) for k in (2, 3))
                good = []
                for row in range(part.num_rows):
                    a, b = np.unique(s[at_s[row] : at_s[row + 1]]), np.unique(t[at_t[row] : at_t[row + 1]])
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(both > 0 and whole * both >= share * (len(a) + len(b) - both))
                yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return met.mapInArrow(verify, T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])).distinct()
