"""Language identification by prediction by partial matching.

Every language has a variable-order context tree over UTF-8 bytes, counted on a bounded sample of
labelled texts and then frozen. A byte after a context that has ``n`` counts and ``d`` distinct
successors costs ``-log2(count / (n + d))`` bits; one that the context never saw pays the escape
``-log2(d / (n + d))`` and asks the next shorter context, at last the uniform distribution over 256
bytes. A text's code length in a language is the exact sum over all its bytes; the shortest wins.

Because the statistics are frozen, the cost of each byte depends on the longest known context alone.
All trees are merged into one table of contexts by symbols by languages, so a task scores a batch with
a few array look-ups per byte, whatever the number of rows.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; so is every text where
nothing could be learned (empty table, no labels). Equal code lengths go to the language that sorts
first. Rows with equal ids are scored each on their own text. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.arrow_text import slices, utf8
from marginalia.session import small_batches

UNKNOWN = "und"


def learn(texts: list[tuple[str, str]], order: int = 4, least: int = 4, most_contexts: int = 12_000) -> dict:
    """Count ``(lang, text)`` pairs into one table of bits per context, byte and language.

    A context longer than one byte is kept where it occurs ``least`` times in all languages together, the
    most frequent ``most_contexts`` of each order: the model's size is bounded whatever the sample.
    """
    langs = sorted({lang for lang, _ in texts})
    if not langs:
        return {"langs": []}
    data = [np.frombuffer("\n".join(t for g, t in texts if g == lang).encode(), np.uint8) for lang in langs]
    seen = np.unique(np.concatenate(data))
    symbol = np.full(256, len(seen), np.int64)  # the last symbol stands for all bytes that no sample holds
    symbol[seen] = np.arange(len(seen))
    size = len(seen) + 1
    coded = [symbol[d] for d in data]
    # Context 0 is the empty one. grow[k][parent, byte before it] is the context one byte longer, or 0.
    bits = [_bits(coded, [np.zeros(len(c), np.int64) for c in coded], 1, size, np.full((1, size, len(langs)), 8.0, np.float32))]
    nodes = [np.zeros(len(c), np.int64) for c in coded]  # each position's context of this order, -1: none
    grow, base = [], 1
    for k in range(1, order + 1):
        parents = len(bits[-1])
        wider = [np.where((n >= 0) & (np.arange(len(n)) >= k), n * size + np.concatenate([np.zeros(k, np.int64), c])[: len(c)], -1)
                 for n, c in zip(nodes, coded, strict=True)]
        keys, counts = np.unique(np.concatenate(wider), return_counts=True)
        keys, counts = keys[keys >= 0], counts[len(counts) - (keys >= 0).sum() :]
        if k > 1:
            keep = counts >= least
            keys, counts = keys[keep], counts[keep]
            keys = np.sort(keys[np.argsort(-counts, kind="stable")[:most_contexts]])
        table = np.full(parents * size, -1, np.int64)
        table[keys] = np.arange(len(keys))
        nodes = [np.where(w >= 0, table[np.maximum(w, 0)], -1) for w in wider]
        bits.append(_bits(coded, nodes, len(keys), size, bits[-1][keys // size]))
        table[keys] += base
        grow.append(np.where(table < 0, 0, table).astype(np.int32).reshape(parents, size))
        base += len(keys)
    starts = np.cumsum([0, *[len(b) for b in bits]])
    return {"langs": langs, "symbol": symbol.astype(np.int32), "size": size, "grow": grow, "first": starts.astype(np.int64),
            "bits": np.concatenate(bits).reshape(-1, len(langs))}


def _bits(coded, nodes, contexts, size, shorter):
    """Bits of every symbol in every context for each language, escapes to ``shorter`` included."""
    out = np.array(shorter, np.float32)
    for lang, (codes, node) in enumerate(zip(coded, nodes, strict=True)):
        ok = node >= 0
        counts = np.bincount(node[ok] * size + codes[ok], minlength=contexts * size).reshape(contexts, size)
        n, d = counts.sum(1), (counts > 0).sum(1)
        known = n > 0
        escape = np.where(known, np.log2(np.maximum(n + d, 1)) - np.log2(np.maximum(d, 1)), 0.0)
        out[:, :, lang] += escape[:, None]
        hit = counts > 0
        out[:, :, lang][hit] = (np.log2(np.maximum(n + d, 1))[:, None] - np.log2(np.maximum(counts, 1)))[hit]
    return out


def code_lengths(column: pa.Array, model: dict, block: int = 1 << 18) -> np.ndarray:
    """Exact code length in bits of each row's bytes in each language."""
    data, offsets = utf8(column)
    total = np.zeros((len(offsets) - 1, len(model["langs"])))
    symbol, size, grow, first = model["symbol"], model["size"], model["grow"], model["first"]
    for low, high in slices(offsets, block):
        for at in range(int(offsets[low]), int(offsets[high]), 4 * block):  # a very long row goes in pieces
            to = min(int(offsets[high]), at + 4 * block)
            back = min(len(grow), at - int(offsets[low]))
            codes = symbol[data[at - back : to]]
            here = np.arange(at, to)
            inside = here - np.repeat(offsets[low:high], np.diff(offsets[low : high + 1]))[at - offsets[low] : to - offsets[low]]
            node = np.zeros(to - at, np.int32)
            deepest = node
            alive = np.ones(to - at, bool)
            for k, table in enumerate(grow):
                before = np.zeros(to - at, np.int32)
                reach = max(0, k + 1 - back)
                before[reach:] = codes[back + reach - k - 1 : back + to - at - k - 1]
                local = deepest - np.int32(first[k]) if k else deepest
                nxt = np.where(alive & (inside > k), table.reshape(-1)[np.where(alive, local, 0) * size + before], 0)
                alive = nxt > 0
                deepest = np.where(alive, nxt, deepest)
            cost = model["bits"][deepest.astype(np.int64) * size + codes[back:]]
            edges = np.clip(offsets[low : high + 1], at, to) - at
            filled = np.flatnonzero(np.diff(edges))
            if len(filled):
                total[low + filled] += np.add.reduceat(cost, edges[filled], axis=0, dtype=np.float64)
    return total


def fit(docs: DataFrame, bytes_per_lang: int = 1 << 19, **shape) -> dict:
    """Learn from the labelled rows of ``docs`` (text, lang), by a hash sample of about ``bytes_per_lang`` each.

    The sample is whole texts, taken by a hash of the text, so it does not depend on the order of rows.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.octet_length("text").alias("n")).where(F.col("n") <= bytes_per_lang)
    sizes = rows.groupBy("lang").agg(F.sum("n").alias("total")).select("lang", F.least(F.lit(1.0), bytes_per_lang / F.greatest("total", F.lit(1))).alias("share"))
    shares = {r.lang: r.share for r in sizes.collect()}
    if not shares:
        return learn([])
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    return learn(sorted(tuple(r) for r in drawn.collect()), **shape)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the winner's share under equal priors."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def tag(batches):
        trees = shared.value
        langs = np.array([*trees["langs"], UNKNOWN], object)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lettered = batch.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
            if len(trees["langs"]):
                bits = code_lengths(batch.column("_text"), trees)
                best = bits.argmin(axis=1)
                with np.errstate(under="ignore"):
                    share = 1.0 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
            else:
                best, share, lettered = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            out = {n: batch.column(n) for n in batch.schema.names if n not in ("_text", "_lettered")}
            out["lang_pred"] = pa.array(np.where(lettered, langs[best], UNKNOWN).tolist(), pa.string())
            out["score"] = pa.array(np.where(lettered, share, 0.0))
            yield pa.RecordBatch.from_pydict(out)

    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "_text", "_lettered")]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    sent = docs.select(*keep, F.col("text").alias("_text"), lettered.alias("_lettered"))
    return sent.mapInArrow(tag, T.StructType([*sent.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
