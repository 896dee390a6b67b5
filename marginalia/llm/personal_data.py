"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes for the rest.

The patterns find e-mail addresses, IP addresses, payment cards and international phone numbers as they
are usually written. The field adds what they miss (spelt-out addresses, national phone numbers, spaced or
dotted digits): it labels words and marks from their shapes, is trained on a small labelled table by
gradient ascent on the conditional likelihood, and is decoded by Viterbi over batches of sequences. A
decoded span counts only if it passes the same test as a pattern's match (digit counts, ranges, Luhn) and
touches no pattern's span, so the patterns' spans always stay.

Sequences are cut more than ``REACH`` words from any digit, ``@`` or word "at" or "dot": every kind's test asks for
one of these in the span itself, spelt in any way.

Defined cases: null is the empty text, without spans; spans are in code points, end exclusive, sorted by
start, then by kind; equal rows give equal spans; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
REACH = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: An address has ``@`` or "at" as a word of its own, within other words.
_SPELT = re.compile(r"[A-Za-z0-9].*(?:@|(?<![^\W\d_])at(?![^\W\d_])).*(?:\.|dot).*[A-Za-z0-9]", re.S | re.I)


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(values)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def passes(kind: str, text: str) -> bool:
    """Whether a string of one kind is plausible as such."""
    digits = digits_of(text)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return bool(_SPELT.search(text))


def emails(text: str):
    """Leftmost non-overlapping addresses; each holds one ``@``, so those lead."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (host := _HOST.match(text, at + 1)):
                end = host.end()
                yield start, end
        at = text.find("@", at + 1)


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches that pass their tests."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if passes(KINDS[kind], m[0])]
    return sorted(out)


# --- words, shapes and features ---------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+|[0-9]+|[^\s\w]|[\d_]")
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\s*(?:at|dot)\s*[\])}>]|(?<![^\W\d_])(?:at|dot)(?![^\W\d_])", re.I)

# Words that tell something by themselves.
CUES = ("at dot com org net edu gov mail email e contact write tel telephone phone call fax mobile cell ext ring card visa credit debit "
        "payment pay ip host server address version on from to order number id no code total year page isbn").split()
MARKS = "@.-+()[]{}<>:/,_#%$&*=\"'"
_CUE = {w: k for k, w in enumerate(CUES)}
_MARK = {m: k for k, m in enumerate(MARKS)}
# Shapes: lower, Capital, UPPER, other letters, digits by length 1..8 and longer, marks, other marks, edge.
N_SHAPES = 4 + 9 + len(MARKS) + 2
EDGE = N_SHAPES - 1
#: Feature groups: shape at -3..3, cue at -2..2, glued before and after with the own shape, shape pair.
_SHAPES_AT, _CUES_AT = range(-3, 4), range(-2, 3)
N_CUES = len(CUES) + 1
SIZES = [N_SHAPES] * len(_SHAPES_AT) + [N_CUES] * len(_CUES_AT) + [4 * N_SHAPES, N_SHAPES * N_SHAPES]
FEATURES = sum(SIZES)


def shape(word: str) -> int:
    first = word[0]
    if "0" <= first <= "9":
        return 3 + min(len(word), 9)
    if first.isalpha():
        return 0 if word.islower() else 2 if word.isupper() and len(word) > 1 else 1 if first.isupper() else 3
    return 13 + _MARK.get(first, len(MARKS))


def features(words: list[str], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature numbers of every word of one sequence, one column per group."""
    n = len(words)
    shapes = np.full(n + 6, EDGE)
    shapes[3 : n + 3] = [shape(w) for w in words]
    cues = np.full(n + 4, N_CUES - 1)
    cues[2 : n + 2] = [_CUE.get(w.lower(), N_CUES - 1) for w in words]
    glued = np.concatenate([[0], (starts[1:] == ends[:-1]).astype(int), [0]])
    cols = [shapes[3 + k : 3 + k + n] for k in _SHAPES_AT] + [cues[2 + k : 2 + k + n] for k in _CUES_AT]
    own = shapes[3 : n + 3]
    cols += [own * 4 + glued[:-1] * 2 + glued[1:], shapes[2 : n + 2] * N_SHAPES + own]
    return np.stack(cols, axis=1) + np.concatenate([[0], np.cumsum(SIZES)[:-1]])


def sequences(text: str):
    """``(words, starts, ends)`` around everything that could be personal data."""
    hits = [m.start() for m in _TRIGGER.finditer(text)]
    at = 0
    while at < len(hits):
        low = _back(text, hits[at])
        words = []
        position, since = low, 0
        limit = hits[at]
        for m in _WORD.finditer(text, low):
            since = since + 1 if m.start() > limit else 0
            while at < len(hits) and hits[at] < m.end():
                at += 1
                since = 0
            if at < len(hits) and since > REACH:
                ahead = hits[at]
                if _back(text, ahead) > m.start():
                    break
                limit = ahead
                since = 0
            elif since > REACH:
                break
            words.append((m[0], m.start(), m.end()))
            position = m.end()
        if not words:
            at += 1
            continue
        while at < len(hits) and hits[at] < position:
            at += 1
        yield [w for w, _, _ in words], np.array([s for _, s, _ in words]), np.array([e for _, _, e in words])


def _back(text: str, at: int, chars: int = 96) -> int:
    """Where the words shortly before a position begin."""
    low = max(0, at - chars)
    found = [m.start() for m in _WORD.finditer(text, low, at)]
    if len(found) > REACH:
        return found[-REACH]
    if found:
        return found[0] if low == 0 else found[min(1, len(found) - 1)]
    return at


# --- the conditional random field -------------------------------------------------------------------

def allowed() -> np.ndarray:
    """Transitions: an inside label follows only its own kind."""
    n = len(LABELS)
    ok = np.ones((n, n), bool)
    for b, label in enumerate(LABELS):
        if label[0] == "I":
            ok[:, b] = [LABELS[a][2:] == label[2:] for a in range(n)]
    return ok


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 60, rate: float = 0.08, decay: float = 1e-4) -> dict:
    """Weights from ``(text, [(start, end, kind)])`` rows: full-batch ascent (Adam) on the log likelihood."""
    data = []
    for text, spans in rows:
        found = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]
        if not found:
            continue
        starts, ends = np.array([f[1] for f in found]), np.array([f[2] for f in found])
        labels = np.zeros(len(found), int)
        for a, b, kind in spans:
            inside = np.flatnonzero((starts >= a) & (ends <= b))
            labels[inside] = 2 * KINDS.index(kind) + 2
            labels[inside[:1]] -= 1
        data.append((features([f[0] for f in found], starts, ends), labels))
    longest, n, groups = max(len(y) for _, y in data), len(LABELS), len(SIZES)
    x = np.zeros((len(data), longest, groups), int)
    y, mask = np.zeros((len(data), longest), int), np.zeros((len(data), longest), bool)
    for k, (f, labels) in enumerate(data):
        x[k, : len(labels)], y[k, : len(labels)], mask[k, : len(labels)] = f, labels, True
    emit, move = np.zeros((FEATURES, n)), np.where(allowed(), 0.0, -1e4)
    ok = allowed()
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    rows_at, places = np.nonzero(mask)
    flat = x[rows_at, places]
    for step in range(1, epochs + 1):
        score = emit[x].sum(2)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + np.where([label[0] == "I" for label in LABELS], -1e4, 0.0)
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], _lse(alpha[:, t - 1, :, None] + move, 1) + score[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _lse(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        total = _lse(alpha[:, -1], 1)
        marginal = np.exp(np.clip(alpha + beta - total[:, None, None], -60, 0))[rows_at, places]
        marginal[np.arange(len(flat)), y[rows_at, places]] -= 1
        grad = decay * emit
        for g in range(groups):
            np.add.at(grad, flat[:, g], marginal / len(data))
        pairs = mask[:, 1:]
        joint = np.exp(np.clip(alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None], -60, 0))
        grad_move = (joint * pairs[:, :, None, None]).sum((0, 1)) / len(data)
        np.add.at(grad_move, (y[:, :-1][pairs], y[:, 1:][pairs]), -1 / len(data))
        for k, (weights, g) in enumerate(((emit, grad), (move, np.where(ok, grad_move, 0)))):
            moments[2 * k] += 0.1 * (g - moments[2 * k])
            moments[2 * k + 1] += 0.02 * (g * g - moments[2 * k + 1])
            weights -= rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.98**step)) + 1e-8)
    return {"emit": emit.astype(np.float32), "move": move.astype(np.float32)}


def _lse(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(values - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(model: dict, found: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
    """The best label sequence of each feature matrix, decoded in batches of similar length."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(found)
    order = sorted(range(len(found)), key=lambda k: len(found[k]))
    move, start = model["move"], np.where([label[0] == "I" for label in LABELS], np.float32(-1e4), np.float32(0))
    at = 0
    while at < len(order):
        longest = len(found[order[min(at + batch, len(order)) - 1]])
        own = order[at : at + max(1, min(batch, (1 << 18) // max(1, longest)))]
        at += len(own)
        lengths = np.array([len(found[k]) for k in own])
        score = np.zeros((len(own), lengths.max(), len(LABELS)), np.float32)
        for row, k in enumerate(own):
            score[row, : lengths[row]] = model["emit"][found[k]].sum(1)
        best, back = score[:, 0] + start, np.zeros(score.shape, np.int8)
        for t in range(1, score.shape[1]):
            ways = best[:, :, None] + move
            back[:, t] = ways.argmax(1)
            best = np.where((t < lengths)[:, None], ways.max(1) + score[:, t], best)
        label = best.argmax(1)
        path = np.zeros(score.shape[:2], int)
        for t in range(score.shape[1] - 1, -1, -1):
            live = t < lengths
            path[:, t] = np.where(live, label, 0)
            label = np.where(live, back[np.arange(len(own)), t, label], label)
        for row, k in enumerate(own):
            out[k] = path[row, : lengths[row]]
    return out


def labelled_table(seed: int = 11, per_template: int = 14) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: sentences with marked personal data, and look-alikes without any."""
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    w = lambda: "".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(2, 9)))
    pick = lambda *options: options[rng.integers(len(options))]

    def card(join):
        raw = pick("4", "5") + d(14)
        raw += next(c for c in "0123456789" if luhn(raw + c))
        return join.join(raw[k : k + 4] for k in range(0, 16, 4))

    def email(at, dot):
        return f"{w()}{pick('', '.' + w(), '.' + d(2), '_' + w())}{at}{w()}{pick('', d(1))}{dot}{pick('', 'example' + dot)}{pick('com', 'org', 'net')}"

    fill = {
        "email": lambda: email(pick("@", " at ", " [at] ", "[at]", "(at)", " (at) ", " AT "), pick(".", " dot ", " [dot] ", "[dot]", "(dot)", " DOT ")),
        "phone": lambda: pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"({d(3)}){d(3)}-{d(4)}"),
        "ip": lambda: pick(" . ", ".", "[.]").join(str(rng.integers(256)) for _ in range(4)),
        "card": lambda: card(pick(" ", "-", "", ".", "  ", " - ")),
    }
    plain = [lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: d(3), lambda: d(5), lambda: d(10), lambda: d(12), lambda: d(16),
             lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(2)}%", lambda: f"no. {d(4)}", lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{d(3)} {d(2)} {d(3)}", lambda: f"{d(4)} {d(4)}", lambda: f"id = {d(9)}", lambda: f"{d(2)} x {d(2)} x {d(2)}",
             lambda: f"at {w()} {w()}", lambda: f"{w()} at the {w()} dot", lambda: f"a dot at {w()}.", lambda: f"{d(8)}{w()}{d(4)}", lambda: f"{w()}.{w()}", lambda: f"[{d(1)}] at {d(4)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"]
    rows = []

    def sentence(parts):
        text, spans = "", []
        for kind, part in parts:
            text += pick(" ", " ", "\n", ", ") if text and not text.endswith((" ", ": ")) else ""
            if kind:
                spans.append((len(text), len(text) + len(part), kind))
            text += part
        return text + pick("", ".", " " + w() + "."), spans

    for kind in KINDS:
        cues = {"email": ("mail", "contact", "write to"), "phone": ("call", "phone:", "tel"), "ip": ("host", "ip", "from server"), "card": ("card", "visa", "pay with")}[kind]
        for _ in range(6 * per_template):
            lead = [("", " ".join(w() for _ in range(rng.integers(0, 5))))] + ([("", pick(*cues))] if rng.random() < 0.4 else [])
            rows.append(sentence([*[p for p in lead if p[1]], (kind, fill[kind]()), ("", " ".join(w() for _ in range(rng.integers(1, 5))))]))
    for make in plain:
        for _ in range(per_template):
            rows.append(sentence([("", " ".join(w() for _ in range(rng.integers(1, 5)))), ("", make()), ("", " ".join(pick(w(), w().capitalize()) for _ in range(rng.integers(1, 5))))]))
    return rows


def model_spans(texts: list[str], model: dict) -> list[list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of the spans the field finds in each text and that pass their test."""
    owner, where, found = [], [], []
    for row, text in enumerate(texts):
        for words, starts, ends in sequences(text):
            owner.append(row)
            where.append((starts, ends))
            found.append(features(words, starts, ends))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for row, (starts, ends), path in zip(owner, where, viterbi(model, found), strict=True):
        opens = np.flatnonzero((path > 0) & (path % 2 == 1))
        for a in opens:
            b = a
            while b + 1 < len(path) and path[b + 1] == path[a] + 1:
                b += 1
            low, high, kind = int(starts[a]), int(ends[b]), int(path[a] - 1) // 2
            if passes(KINDS[kind], texts[row][low:high]):
                out[row].append((low, kind, high))
    return out


def find(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, spans`` per row: arrays of ``kind, start, end``, the patterns' and all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def work(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [pattern_spans(t) for t in texts]
                every = []
                for own, more in zip(base, model_spans(texts, shared.value), strict=True):
                    taken = sorted((a, b) for a, _, b in own)
                    extra = []
                    for a, k, b in more:
                        near = taken[max(0, bisect.bisect_left(taken, (a, a)) - 4) : bisect.bisect_left(taken, (b, b))]
                        if not any(x < b and a < y for x, y in near):
                            extra.append((a, k, b))
                    every.append(sorted({*own, *extra}))
                named = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own] for own in spans], kind) for spans in (base, every)]
                yield pa.RecordBatch.from_arrays([part.column(0), *named], [key, "base", "spans"])

    return docs.select(key, text).mapInArrow(work, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("base", span), T.StructField("spans", span)]))


def listing(spans):
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
