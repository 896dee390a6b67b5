"""Repeated lines across documents, found with a once-seen and a twice-seen Bloom filter.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points that are found in at least ``min_docs`` documents are kept in the document of the
largest id that holds them (all its lines with that key) and dropped everywhere else.

One pass folds the keys' hashes into the filters; a second names the suspected repeats, and only these
shuffle, as 16-byte digests, for the exact count and the choice of the surviving document. Documents
without a suspected line are finished where they are read; the others meet their verdicts in one join.

Defined cases: a null text is one empty line and comes back as the empty text; rows of one id count as one
document and are each edited; a null id counts as one document that never survives another; repeated
lines within the surviving document stay; ties cannot arise beyond equal ids. Extra columns pass through, but
for those of the names it adds (and ``_mark``, ``_drop``), which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import twice_filter
from marginalia.llm.storage import stored

BLANKS = " \t\n\x0b\x0c\r"
#: Characters of text per line assumed when the filter is sized; only its fill depends on it.
CHARS_PER_LINE = 100


def keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    """A 16-byte digest per line, None where the key is too short to be judged."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANKS)
        out.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= min_chars else None)
    return out


def _hash(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2].copy() if digests else np.zeros(0, np.uint64)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, the remaining lines joined by line breaks."""
    spark = docs.sparkSession
    added = ("n_lines", "n_dropped", "kept_text")
    docs = docs.select([c for c in docs.columns if c not in (*added, "_mark", "_drop")])
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0

    def hashes(batch):
        return _hash([d for t in batch.column(0).to_pylist() for d in set(keys_of(t, min_chars)) if d])

    seen = spark.sparkContext.broadcast(twice_filter.build(docs.select(text), hashes, size // CHARS_PER_LINE))

    def suspected(texts):
        digests = [list({d for d in keys_of(t, min_chars) if d}) for t in texts]
        found = seen.value.test(_hash([d for own in digests for d in own]))
        ends = np.cumsum([len(own) for own in digests])
        return [[d for d, hit in zip(own, found[end - len(own) : end], strict=True) if hit] for own, end in zip(digests, ends, strict=True)]

    def list_suspects(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = suspected(texts)
            counts = [len(x) for x in own]
            at = np.repeat(np.arange(len(own)), counts)
            marks = pa.array([hashlib.blake2b((t or "").encode(), digest_size=16).digest() if n else b"" for t, n in zip(texts, counts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), marks.take(pa.array(at)), pa.array([d for x in own for d in x], pa.binary())],
                                             ["id", "mark", "line"])

    id_type = docs.schema[key].dataType
    lines = T.StructType([T.StructField("id", id_type), T.StructField("mark", T.BinaryType()), T.StructField("line", T.BinaryType())])
    suspects = stored(docs.select(key, text).mapInArrow(list_suspects, lines), "suspected-lines")
    holders = suspects.select("line", "id").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    drops = (suspects.join(holders.select("line", "keeper"), "line").where(~F.col("id").eqNullSafe(F.col("keeper")))
             .groupBy("id", "mark").agg(F.collect_set("line").alias("_drop")))

    names = docs.columns
    edited = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    place = names.index(text)

    def write(batch, texts, drop):
        total, dropped, kept = [], [], []
        for t, gone in zip(texts, drop, strict=True):
            parts = (t or "").split("\n")
            total.append(len(parts))
            if gone:
                gone = set(gone)
                parts = [p for p, d in zip(parts, keys_of(t, min_chars), strict=True) if d not in gone]
            dropped.append(total[-1] - len(parts))
            kept.append("\n".join(parts))
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                                          [*names, *added])

    def clean(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            own = suspected(texts)
            at = [k for k, x in enumerate(own) if not x]
            if at:
                yield write(batch.take(pa.array(at)), [texts[k] for k in at], [None] * len(at))

    def doubtful(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            own = suspected(texts)
            at = [k for k, x in enumerate(own) if x]
            if at:
                marks = [hashlib.blake2b((texts[k] or "").encode(), digest_size=16).digest() for k in at]
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.binary())], [*names, "_mark"])

    def edit(batches):
        for batch in batches:
            yield write(batch, batch.column(place).to_pylist(), batch.column(len(names)).to_pylist())

    open_rows = docs.mapInArrow(doubtful, T.StructType([*docs.schema.fields, T.StructField("_mark", T.BinaryType())]))
    met = open_rows.join(drops, open_rows[key].eqNullSafe(drops["id"]) & (open_rows["_mark"] == drops["mark"]), "left").select(*[open_rows[c] for c in names], "_drop")
    return docs.mapInArrow(clean, edited).unionByName(met.mapInArrow(edit, edited))
