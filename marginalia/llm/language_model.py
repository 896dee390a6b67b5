"""Scoring texts with a small causal self-attention model over subword ids, beside an exact word model.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and every text ends with one end token. The base score
is the add-one word unigram of the training texts, counted over all of them.

The attention model learns from all training texts with numpy. Each word, with a blank before it, becomes ids
of a public tokenizer, once; they are kept in a table. All ids are counted: the most frequent ones have an output of
their own, the others share one and are told apart below it by their add-one frequencies, so every text has
a proper probability. A bounded sample (``SAMPLE_BYTES`` of whole texts, by a hash of the text) only gives the
weights a start. Then every partition trains on all its texts of one share (``len(RATES)`` shares, by a hash of
the text), starting from the same weights; their average, weighted by windows, starts the next share. So
every window of every training text is one training case. The average is exact in any order, but
what a partition holds matters: another layout of the input gives slightly other weights. Tokens are scored in windows of ``WINDOW`` inputs, of which the last ``STRIDE`` are
queries: windows overlap, every token is scored once and sees at least ``WINDOW - STRIDE`` inputs before it.
A batch of windows is one masked matrix product per step, and the output is factored into classes and
members, so a token costs two short softmaxes.

Word counts are kept whole and never collected: the most frequent words, at most ``HOT_WORDS``, travel to
the tasks; what a text holds besides goes through a join on the word's hash, one row per text and word.

Defined cases: null is the empty text, one end token; without training texts N, V and every count are 0
and the attention model is untrained, so its outputs are uniform; equal rows get equal scores, each its own row;
words are told apart by 64-bit hashes of bytes mixed with their places; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.arrow_text import hash_runs, slices, utf8, word_starts
from marginalia.llm.storage import stored
from marginalia.llm.token_codec import codec, public_files
from marginalia.session import small_batches

HOT_WORDS = 1 << 19
SAMPLE_BYTES = 1 << 20
#: Learning rate of each pass over one share of the training texts.
RATES = (0.01, 0.006, 0.003, 0.001)
WIDTH, WINDOW, STRIDE = 24, 48, 32
CLASSES = MEMBERS = 32
#: Subword ids whose windows a task holds while it scores.
SCORED_AT_ONCE = 1 << 17
END, OTHER = 0, 1
_IDS = 50_257


def subwords(words: list[bytes], files) -> tuple[np.ndarray, np.ndarray]:
    """The tokenizer's ids of each word, flat, and how many each has."""
    machine = codec(files).fast
    found = [machine.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
    return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)


def batch_ids(data: np.ndarray, starts: np.ndarray, hashes: np.ndarray, files) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of a batch, each distinct word encoded once; flat, and how many each word has."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes().lower() if len(first) else b""
    ends = np.append(starts[1:], len(data))
    flat, counts = subwords([raw[a:b].split(None, 1)[0] for a, b in zip(starts[first], ends[first], strict=True)], files)
    begin = np.cumsum(counts) - counts
    own = counts[inverse]
    step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    return flat[np.repeat(begin[inverse], own) + step], own


def texts_as_ids(column: pa.Array, files):
    """Word hashes and where rows begin in them; subword ids with the end mark after each row, and where rows begin."""
    data, offsets = utf8(column)
    starts = word_starts(data, offsets)
    hashes = hash_runs(data, starts)
    at = np.searchsorted(starts, offsets)
    flat, own = batch_ids(data, starts, hashes, files)
    before = np.concatenate([[0], np.cumsum(own)])[at]
    begins = before + np.arange(len(before))
    ids = np.full(begins[-1], -1, np.int32)
    inside = np.ones(begins[-1], bool)
    inside[begins[1:] - 1] = False
    ids[inside] = flat
    return hashes, at, ids, begins


# --- the attention model ----------------------------------------------------------------------------

def untrained(vocabulary: np.ndarray, seed: int = 5) -> dict:
    """A model whose outputs are uniform; ``vocabulary``: tokenizer ids with an output of their own."""
    rng = np.random.default_rng(seed)
    size = CLASSES * MEMBERS
    lookup = np.full(_IDS + 1, OTHER, np.int32)
    lookup[vocabulary] = np.arange(len(vocabulary)) + 2
    lookup[-1] = END
    f = np.float32
    weights = {"embed": rng.normal(0, 0.3, (size, WIDTH)).astype(f), "place": rng.normal(0, 0.1, (WINDOW, WIDTH)).astype(f),
               **{n: (rng.normal(0, 1, (WIDTH, WIDTH)) / WIDTH**0.5).astype(f) for n in ("q", "k", "v", "o")},
               "klass": np.zeros((WIDTH, CLASSES), f), "klass_bias": np.zeros(CLASSES, f), "member": np.zeros((CLASSES, WIDTH, MEMBERS), f), "member_bias": np.zeros((CLASSES, MEMBERS), f)}
    for unused in range(len(vocabulary) + 2, size):  # outputs no id has get no probability
        weights["member_bias"][unused // MEMBERS, unused % MEMBERS] = -40
        if unused % MEMBERS == 0:
            weights["klass_bias"][unused // MEMBERS] = -40
    return {"weights": weights, "lookup": lookup, "rest": np.where(lookup == OTHER, -np.log(max(1, _IDS - len(vocabulary))), 0.0)}


def counted(counts: np.ndarray, ends: int, seed: int = 5) -> dict:
    """A model that knows how often each id, and the end mark, occurs: vocabulary, biases and rest distribution."""
    order = np.argsort(-counts, kind="stable")[: CLASSES * MEMBERS - 2]
    vocabulary = order[counts[order] > 0]  # by frequency: classes of like frequency
    model = untrained(vocabulary, seed)
    if not ends:
        return model
    w, rest = model["weights"], model["lookup"][:-1] == OTHER
    base = np.zeros(CLASSES * MEMBERS)
    base[END], base[OTHER] = ends, counts[rest].sum()
    base[2 : len(vocabulary) + 2] = counts[vocabulary]
    base = base.reshape(CLASSES, MEMBERS) + 0.5
    w["klass_bias"] = np.where(w["klass_bias"] < -30, w["klass_bias"], np.log(base.sum(1) / base.sum())).astype(np.float32)
    w["member_bias"] = np.where(w["member_bias"] < -30, w["member_bias"], np.log(base / base.sum(1, keepdims=True))).astype(np.float32)
    model["rest"][:-1][rest] = np.log((counts[rest] + 1) / (counts[rest].sum() + rest.sum()))
    return model


def windows(ids: np.ndarray, begins: np.ndarray):
    """Inputs ``[windows, WINDOW]``, targets ``[windows, STRIDE]`` (-1: none) and the row of each window."""
    lengths = np.diff(begins)
    per_row = -(-lengths // STRIDE)
    row = np.repeat(np.arange(len(lengths)), per_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    step = number * STRIDE
    begin, left = (begins[:-1][row] + step)[:, None], (lengths[row] - step)[:, None]
    targets = ids.take(begin + np.arange(STRIDE), mode="clip")
    targets[np.arange(STRIDE) >= left] = -1
    place = np.arange(WINDOW) - (WINDOW - STRIDE) - 1
    inputs = ids.take(begin + place, mode="clip")
    inputs[(place < -step[:, None]) | (place >= left)] = END
    return inputs, targets, row


def causal_mask() -> np.ndarray:
    return (np.arange(WINDOW)[None, :] <= np.arange(WINDOW - STRIDE, WINDOW)[:, None]).astype(np.float32)


def attend(w: dict, inputs: np.ndarray, mask: np.ndarray):
    """Hidden states of the queries, and what the gradient needs.

    Keys are only met by queries and values only by the output, so the two matrices of each pair are multiplied
    first: inputs are compared, and mixed, as they are.
    """
    x = w["embed"].take(inputs, 0)
    x += w["place"]
    tail = np.ascontiguousarray(x[:, WINDOW - STRIDE :])
    sought = (tail.reshape(-1, WIDTH) @ (w["q"] @ w["k"].T * x.dtype.type(WIDTH**-0.5))).reshape(tail.shape)
    share = np.matmul(sought, x.transpose(0, 2, 1))
    np.clip(share, -30, 30, out=share)
    np.exp(share, out=share)
    share *= mask
    flat = share.reshape(-1, WINDOW)
    flat *= (1 / (flat @ np.ones(WINDOW, x.dtype)))[:, None]
    mixed = np.matmul(share, x)
    hidden = (mixed.reshape(-1, WIDTH) @ (w["v"] @ w["o"])).reshape(tail.shape)
    hidden += tail
    return np.tanh(hidden, out=hidden), (x, tail, sought, share, mixed)


def by_class(hidden: np.ndarray, target: np.ndarray):
    """Places with a target, class by class: their numbers, states with a 1 behind for the bias, classes, members, and the slice of each class met."""
    target = target.astype(np.int16)  # short numbers sort faster
    order = np.argsort(target, kind="stable")
    order = order[int((target < 0).sum()) :]
    own = np.ones((len(order), WIDTH + 1), hidden.dtype)
    own[:, :WIDTH] = hidden.take(order, 0)
    klass, member = np.divmod(target[order], MEMBERS)
    edges = np.searchsorted(klass, np.arange(CLASSES + 1))
    return order, own, klass, member, [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]


def heads(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """The output weights of classes and of members, each with its bias as a last row."""
    return np.concatenate([w["klass"], w["klass_bias"][None]]), np.concatenate([w["member"], w["member_bias"][:, None]], 1)


def log_softmax_at(logits: np.ndarray, index: np.ndarray) -> np.ndarray:
    picked = logits[np.arange(len(logits)), index]
    np.exp(logits, out=logits)
    return picked - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def score_ids(model: dict, ids: np.ndarray, begins: np.ndarray, batch: int = 256) -> np.ndarray:
    """Log10 probability of each row of subword ids (the last of each row the end mark, -1)."""
    w, mask = model["weights"], causal_mask()
    outer, inner = heads(w)
    known = model["lookup"][ids]
    out = np.zeros(len(begins) - 1)
    others = np.add.reduceat(model["rest"][ids], begins[:-1]) if len(ids) else np.zeros(0)
    inputs, targets, row = windows(known, begins)
    logp = np.zeros(targets.shape, np.float32)
    for at in range(0, len(inputs), batch):
        hidden, _ = attend(w, inputs[at : at + batch], mask)
        order, own, klass, member, spans = by_class(hidden.reshape(-1, WIDTH), targets[at : at + batch].reshape(-1))
        logits = np.empty((len(own), MEMBERS), own.dtype)
        for c, some in spans:
            np.matmul(own[some], inner[c], out=logits[some])
        logp[at : at + batch].reshape(-1)[order] = log_softmax_at(own @ outer, klass) + log_softmax_at(logits, member)
    out += np.bincount(row, logp.sum(1, dtype=np.float64), len(out))
    return (out + others) / np.log(10)


def train(texts: list[str], files, steps: int = 1000, batch: int = 96, rate: float = 0.02, seed: int = 5) -> dict:
    """Fit a model of its own on a few texts."""
    _, _, ids, begins = texts_as_ids(pa.array(texts, pa.string()), files)
    model = counted(np.bincount(ids[ids >= 0], minlength=_IDS), len(texts), seed)
    warm_up(model, ids, begins, steps, batch, rate, seed)
    return model


def warm_up(model: dict, ids: np.ndarray, begins: np.ndarray, steps: int = 1000, batch: int = 96, rate: float = 0.02, seed: int = 5) -> None:
    """Adam on the cross entropy of random windows."""
    if not len(ids):
        return
    rng, descend = np.random.default_rng(seed), adam(model["weights"])
    inputs, targets, _ = windows(model["lookup"][ids], begins)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(inputs), batch)
        descend(inputs[pick], targets[pick], rate * min(1.0, 3 * (1 - step / (steps + 1))))


def adam(w: dict):
    """A function that changes ``w`` by one step on a batch of windows at a rate."""
    mask, steps = causal_mask(), 0
    ends = np.cumsum([0, *(x.size for x in w.values())])
    m, v, change = np.zeros((3, ends[-1]), np.float32)

    def descend(inputs: np.ndarray, targets: np.ndarray, rate: float) -> None:
        nonlocal steps
        steps += 1
        found = gradients(w, inputs, targets, mask)
        g = np.concatenate([found[n].reshape(-1) for n in w])
        np.subtract(g, m, out=change)
        np.add(m, np.multiply(change, 0.1, out=change), out=m)
        np.multiply(g, g, out=g)
        np.subtract(g, v, out=g)
        np.add(v, np.multiply(g, 0.01, out=g), out=v)
        np.multiply(v, 1 / (1 - 0.99**steps), out=g)
        np.add(np.sqrt(g, out=g), 1e-8, out=g)
        np.multiply(np.divide(m, g, out=change), rate / (1 - 0.9**steps), out=change)
        for x, low, high in zip(w.values(), ends[:-1], ends[1:], strict=True):
            x -= change[low:high].reshape(x.shape)
        for n in ("klass", "member"):
            np.clip(w[n], -3, 3, out=w[n])  # with hidden states within one this keeps every logit far from overflow

    return descend


def gradients(w: dict, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> dict:
    """Gradients of the mean negative log likelihood of one batch of windows."""
    hidden, (x, tail, sought, share, mixed) = attend(w, inputs, mask)
    flat = hidden.reshape(-1, WIDTH)
    order, own, klass, member, spans = by_class(flat, targets.reshape(-1))
    part, g = flat.dtype.type(1 / max(1, len(order))), {}

    def soft(logits, index):
        np.exp(logits, out=logits)
        logits *= (part / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
        logits[np.arange(len(logits)), index] -= part
        return logits

    outer, inner = heads(w)
    d_class = soft(own @ outer, klass)
    both = own.T @ d_class
    g["klass"], g["klass_bias"] = both[:-1], both[-1]
    d_own = d_class @ w["klass"].T
    logits, both, d_more = np.empty((len(own), MEMBERS), own.dtype), np.zeros_like(inner), np.empty_like(d_own)
    for c, at in spans:
        np.matmul(own[at], inner[c], out=logits[at])
    soft(logits, member)
    for c, at in spans:
        np.matmul(own[at].T, logits[at], out=both[c])
        np.matmul(logits[at], w["member"][c].T, out=d_more[at])
    g["member"], g["member_bias"] = both[:, :-1], both[:, -1]
    d_own += d_more
    d_sum = np.zeros_like(flat)
    d_sum[order] = d_own
    d_sum *= 1 - flat * flat
    key, scale = w["q"] @ w["k"].T, flat.dtype.type(WIDTH**-0.5)
    g_value = mixed.reshape(-1, WIDTH).T @ d_sum
    g["v"], g["o"] = g_value @ w["o"].T, w["v"].T @ g_value
    d_mixed = (d_sum @ (w["v"] @ w["o"]).T).reshape(mixed.shape)
    d_score = np.matmul(d_mixed, x.transpose(0, 2, 1))
    d_score -= np.einsum("wqd,wqd->wq", d_mixed, mixed)[:, :, None]  # what the shares of a query, which sum to one, cannot change
    d_score *= share
    d_sought = np.matmul(d_score, x).reshape(-1, WIDTH)
    d_x = np.matmul(share.transpose(0, 2, 1), d_mixed)
    d_x += np.matmul(d_score.transpose(0, 2, 1), sought)
    g_key = tail.reshape(-1, WIDTH).T @ d_sought * scale
    g["q"], g["k"] = g_key @ w["k"], g_key.T @ w["q"]
    d_sum += d_sought @ (key.T * scale)
    d_x[:, WINDOW - STRIDE :] += d_sum.reshape(hidden.shape)
    g["place"] = d_x.sum(0)
    g["embed"] = np.zeros_like(w["embed"])
    met = inputs.reshape(-1).astype(np.int16)
    order = np.argsort(met, kind="stable")
    met = met[order]
    first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
    g["embed"][met[first]] = np.add.reduceat(d_x.reshape(-1, WIDTH).take(order, 0), first)
    return g


# --- on tables --------------------------------------------------------------------------------------

def read(docs: DataFrame, learn, key: str, text: str, files) -> DataFrame:
    """Per row its number ``row``, ``key``, ``learn``, ``draw`` (a hash of the text), bytes, words, and what the text holds.

    That is the hashes of its distinct words with their counts, and its subword ids in order, as little-endian numbers.
    """
    held = F.coalesce(F.col(text), F.lit(""))

    def work(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = utf8(batch.column(3))
            for low, high in slices(offsets, 1 << 21):
                rows = high - low
                hashes, at, ids, begins = texts_as_ids(batch.column(3).slice(low, rows), files)
                marks, owner = hashes.view(np.int64), np.repeat(np.arange(rows), np.diff(at))
                order = np.lexsort((marks, owner))
                marks, owner = marks[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (owner[1:] != owner[:-1])])) if len(marks) else np.zeros(0, np.int64)
                cut = np.searchsorted(owner[first], np.arange(rows + 1))
                times = np.diff(np.append(first, len(marks)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.int64(part) << 40) + made + np.arange(rows)), *(batch.column(k).slice(low, rows) for k in range(3)), pa.array(np.diff(offsets[low : high + 1])), pa.array(np.diff(at)),
                     packed(marks[first], cut, "<i8"), packed(times, cut, "<u4"), packed(np.where(ids < 0, _END_CODE, ids), begins, "<u2")],
                    ["row", key, "learn", "draw", "bytes", "n", "words", "times", "ids"])
                made += rows

    shape = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, docs.schema[key].dataType), T.StructField("learn", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("draw", "bytes", "n")),
                          *(T.StructField(c, T.BinaryType()) for c in ("words", "times", "ids"))])
    return docs.select(key, F.coalesce(learn, F.lit(False)), F.xxhash64(held), held).mapInArrow(work, shape)


_END_CODE = 0xFFFF


def packed(values: np.ndarray, edges: np.ndarray, code: str) -> pa.Array:
    """Rows of numbers as binary strings."""
    raw = values.astype(code)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def unpacked(column: pa.Array, code: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of ``packed``, and where each row's begin."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(code), (edges - edges[0]) // np.dtype(code).itemsize


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids, begins = unpacked(column, "<u2")
    return np.where(ids == _END_CODE, -1, ids.astype(np.int32)), begins


def few(batches, rows: int = 1024):
    """Batches of at most so many rows, so that what a task unpacks at once is small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def counts_of(taught: DataFrame) -> DataFrame:
    """``kind, word, c``: how often each word (by hash, kind 0) and each subword id (kind 1) occurs; pre-summed in every batch."""

    def count(batches):
        for batch in few(batches, 4096):
            words, inverse = np.unique(unpacked(batch.column(0), "<i8")[0], return_inverse=True)
            n = np.bincount(inverse, unpacked(batch.column(1), "<u4")[0], len(words)).astype(np.int64)
            every = np.bincount(unpacked(batch.column(2), "<u2")[0], minlength=1)
            ids = np.flatnonzero(every)
            kind = np.repeat([0, 1], [len(words), len(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([words, ids])), pa.array(np.concatenate([n, every[ids]]))], ["kind", "word", "c"])

    return taught.select("words", "times", "ids").mapInArrow(count, "kind long, word long, c long").groupBy("kind", "word").agg(F.sum("c").alias("c"))


_UNIT = 1 << 24


def improved(taught: DataFrame, model: dict, rate: float, batch: int = 96) -> dict:
    """The average of what each partition makes of ``model`` in one pass over all its windows."""
    shared = taught.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        start, part = shared.value, TaskContext.get().partitionId()
        w, rng, seen = {n: x.copy() for n, x in start["weights"].items()}, np.random.default_rng(part), 0
        descend = adam(w)
        for rows in few(batches):
            ids, begins = ids_of(rows.column(0))
            for low, high in slices(begins, 1 << 19):
                inputs, targets, _ = windows(start["lookup"][ids[begins[low] : begins[high]]], begins[low : high + 1] - begins[low])
                order = rng.permutation(len(inputs))
                for at in range(0, len(order), batch):
                    pick = order[at : at + batch]
                    descend(inputs[pick], targets[pick], rate * min(1.0, len(pick) / batch))
                seen += len(order)
        if seen:
            sums = np.concatenate([np.rint(x.reshape(-1).astype(np.float64) * _UNIT).astype(np.int64) for x in w.values()])
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([sums.astype("<i8").tobytes()], pa.binary())], ["seen", "sums"])

    total, seen = None, 0
    for r in stored(taught.select("ids").mapInArrow(work, "seen long, sums binary"), "weights").toLocalIterator():
        own = np.frombuffer(r.sums, "<i8").astype(object) * r.seen  # exact, so the order of partitions does not matter
        total, seen = own if total is None else total + own, seen + r.seen
    shared.unpersist()
    if total is None:
        return model
    mean, at, weights = (total / (seen * _UNIT)).astype(np.float32), 0, {}
    for n, x in model["weights"].items():
        weights[n], at = mean[at : at + x.size].reshape(x.shape), at + x.size
    return {**model, "weights": weights}


def fit(taught: DataFrame, by_id: np.ndarray, ends: int, size: int) -> dict:
    """The attention model, learned from all rows of ``taught`` (see ``read``)."""
    model = counted(by_id, ends)
    share = min(1.0, SAMPLE_BYTES / max(1, size))
    sample = taught.where((F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))) & (F.col("bytes") <= SAMPLE_BYTES)).select("ids")
    first = sorted(bytes(r.ids) for r in sample.collect())
    warm_up(model, *ids_of(pa.array(first, pa.binary())))
    for turn, rate in enumerate(RATES):
        model = improved(taught.where(F.pmod(F.xxhash64("draw"), F.lit(len(RATES))) == turn), model, rate)
    return model


def score(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", files=None) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` per row; ``learn``: the rows to learn from."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = stored(read(docs, learn, key, text, files or public_files()), "texts")
    taught = texts.where("learn")
    every = stored(counts_of(taught), "counts")
    counts = every.where("kind = 0").select("word", "c")
    totals = taught.agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")).first()
    words = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = totals.rows
    n, v = (words.n or 0) + ends, words.v + (1 if ends else 0)
    by_count = {r.c: r.n for r in counts.groupBy(F.least("c", F.lit(4096)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = max([*by_count, 0]) + 1, HOT_WORDS
    for c in sorted(by_count, reverse=True):
        if by_count[c] > room:
            break
        least, room = c, room - by_count[c]
    hot = counts.where(F.col("c") >= least).toPandas().sort_values("word")
    by_id = np.zeros(_IDS, np.int64)
    for r in every.where((F.col("kind") == 1) & (F.col("word") < _IDS)).collect():
        by_id[r.word] = r.c
    shared = spark.sparkContext.broadcast((hot["word"].to_numpy(), np.log10(hot["c"].to_numpy() + 1.0), fit(taught, by_id, ends, totals.bytes or 0)))

    def work(batches):
        hot_word, hot_log, model = shared.value
        for batch in few(batches):
            marks, cut = unpacked(batch.column(3), "<i8")
            times, _ = unpacked(batch.column(4), "<u4")
            ids, begins = ids_of(batch.column(5))
            rows = batch.num_rows
            found = np.minimum(np.searchsorted(hot_word, marks), max(0, len(hot_word) - 1))
            hit = hot_word[found] == marks if len(hot_word) else np.zeros(len(marks), bool)
            owner = np.repeat(np.arange(rows), np.diff(cut))
            sums = np.bincount(owner[hit], hot_log[found[hit]] * times[hit], rows).astype(np.float64) if hit.any() else np.zeros(rows)
            near = np.bincount(owner[hit], times[hit], rows).astype(np.int64)
            scores = np.concatenate([np.zeros(0), *(score_ids(model, ids[begins[a] : begins[b]], begins[a : b + 1] - begins[a]) for a, b in slices(begins, 1 << 20))])
            rare = pa.StructArray.from_arrays([pa.array(marks[~hit]), pa.array(times[~hit].astype(np.int64))], ["word", "n"])
            edges = np.searchsorted(owner[~hit], np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.add(batch.column(2), 1), pa.array(near), pa.array(sums), pa.array(scores), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), rare)],
                                             ["row", key, "n_tokens", "near", "sums", "score", "rare"])

    shape = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("near", T.LongType()),
                          T.StructField("sums", T.DoubleType()), T.StructField("score", T.DoubleType()),
                          T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])))])
    scored = stored(texts.select("row", key, "n", "words", "times", "ids").mapInArrow(work, shape), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    added = (rare.join(counts.where(F.col("c") < least), "word")
             .groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("far")))
    known = F.col("near") + F.coalesce("far", F.lit(0)) + F.lit(1 if ends else 0)
    logs = F.col("sums") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + 1)))
    return scored.join(added, "row", "left").select(
        key, "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), "score")
