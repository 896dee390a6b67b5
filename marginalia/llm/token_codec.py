"""Byte-level BPE over whole texts by tree concatenation, exact to the token.

Short texts are encoded in one go. A long text is cut into pieces that tasks encode in parallel, and
neighbours are joined pairwise, level by level, until one sequence is left:

* A cut between a non-blank and a blank is a place where the splitting pattern always ends a unit, so
  both sides are already exact and join as they are.
* Text without such a place (one very long run) is split into its units first. A unit that is itself
  too long is cut in halves of plain bytes; at such a join the last tokens of the left and the first of
  the right are decoded and encoded again as one window. When the window begins with the left side's
  own token and ends with the right side's own, every adjacent pair of tokens is one that byte-pair
  encoding itself produced, which makes the joined sequence the encoding of the joined bytes; until
  then the window doubles.

The rank encoder and the reference tokenizer give the same ids where both classify every character
alike; texts with other characters (controls, unassigned or recently assigned ones) go to the reference
tokenizer itself. Its special token is matched in the text as that library does by default.

Defined cases: null is the empty text (no tokens); equal rows are encoded alike; ids of any type and
extra columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.arrow_text import held

PIECE = 1 << 14
WINDOW = 8

#: Ranges whose characters all engines put into the same classes.
ALIKE = "\t\n\r -~¡-ɏЀ-џ‐-‧‰-⁞ぁ-ゔ一-龥가-힣"


class Codec:
    """A byte-level BPE vocabulary: the reference tokenizer, a faster encoder of equal results, and a decoder."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.reference = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.reference.get_added_tokens_decoder().items()}
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.runs = tiktoken.Encoding("runs", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.units = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.bytes = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.odd = re.compile(f"[^{ALIKE}]")
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.digits = np.zeros((len(self.bytes), 8), np.uint8)
        for i in range(len(self.bytes)):
            text = f"{i},".encode()
            self.digits[i, : len(text)] = np.frombuffer(text, np.uint8)

    def plain(self, text: str) -> list[int]:
        """Ids of text that holds no special token."""
        if self.odd.search(text):
            return self.reference.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if self.cut is None or not (found := self.cut.search(text)):
            return self.plain(text)
        ids, at = [], 0
        while found:
            ids += self.plain(text[at : found.start()])
            ids.append(self.special[found[0]])
            at = found.end()
            found = self.cut.search(text, at)
        return ids + self.plain(text[at:])

    def pieces(self, text: str, size: int = PIECE) -> list[tuple[str, str]]:
        """Cut a text into ``(kind, piece)``: "text" joins exactly as it is, "run" is part of one unit."""
        out: list[tuple[str, str]] = []
        spans, at = [], 0
        for found in self.cut.finditer(text) if self.cut else ():
            spans += [(at, found.start(), False), (found.start(), found.end(), True)]
            at = found.end()
        for low, high, special in [*spans, (at, len(text), False)]:
            if special:
                out.append(("text", text[low:high]))
                continue
            while low < high:
                if high - low <= 2 * size:
                    out.append(("text", text[low:high]))
                    break
                blank = _SAFE.search(text, low + size, min(high, low + 2 * size))
                if blank:
                    out.append(("text", text[low : blank.start() + 1]))
                    low = blank.start() + 1
                    continue
                blank = _SAFE.search(text, low + size, high)
                end = blank.start() + 1 if blank else high
                self._unsplit(text[low:end], size, out)
                low = end
        return out

    def _unsplit(self, text: str, size: int, out: list) -> None:
        held_back: list[str] = []  # units not yet written

        def flush() -> None:
            # Blank units at a piece's end stand alone: at the end of a string the pattern would merge them.
            keep = len(held_back)
            while keep and held_back[keep - 1].isspace():
                keep -= 1
            out.extend(("text", x) for x in ["".join(held_back[:keep]), *held_back[keep:]] if x)
            held_back.clear()

        waiting = 0
        for _, (low, high) in self.units.pre_tokenize_str(text):
            if high - low > size:
                flush()
                raw, waiting = text[low:high], 0
                out += [("first" if k == 0 else "run", raw[k : k + size]) for k in range(0, len(raw), size)]
                continue
            held_back.append(text[low:high])
            waiting += high - low
            if waiting > size:
                flush()
                waiting = 0
        flush()

    def piece_ids(self, kind: str, piece: str) -> list[int]:
        return self.encode(piece) if kind == "text" else self._run(piece.encode())

    def _run(self, raw: bytes) -> list[int]:
        # Plain byte-pair merges without the splitting pattern; bytes need not be whole characters.
        return self.runs._encode_single_piece(raw) if raw else []

    def join(self, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """Ids of two neighbouring parts of one unit, re-encoding a growing window around the join."""
        if not left or not right:
            return left + right
        while True:
            low, high = max(0, len(left) - window), min(len(right), window)
            ids = self._run(b"".join(self.bytes[i] for i in left[low:] + right[:high]))
            left_agrees = low == 0 or ids[0] == left[low]
            right_agrees = high == len(right) or ids[-1] == right[high - 1]
            if left_agrees and right_agrees:
                return left[:low] + ids + right[high:]
            window *= 2

    def concatenate(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        """Ids of a text from ``(kind, ids)`` of its pieces: the runs of each long unit join as a balanced tree."""
        ids, at = [], 0
        while at < len(parts):
            to = at + 1
            while to < len(parts) and parts[to][0] == "run":
                to += 1
            level = [found for _, found in parts[at:to]]
            while len(level) > 1:
                level = [self.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            ids += level[0]
            at = to
        return ids

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def listing(self, ids: list[int]) -> bytes:
        """The ids in decimal, joined by commas."""
        if not ids:
            return b""
        flat = self.digits[np.asarray(ids)].reshape(-1)
        return flat[flat > 0].tobytes()[:-1]


#: A non-blank before a blank: the splitting pattern never runs across it.
_SAFE = re.compile(r"\S(?=[ \n\t])")


def codec(files: tuple[str, str, str]) -> Codec:
    """The codec of a tokenizer file, its rank file and splitting pattern; loaded once in each process."""
    return held(("codec", *files), lambda: Codec(*files))


def public_files() -> tuple[str, str, str]:
    """The 50k byte vocabulary of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, key: str = "doc_id", files: tuple | None = None, long_text: int = 4 * PIECE, keep_ids: bool = True) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs`` (key, text); also ``ids`` with ``keep_ids``.

    Texts over ``long_text`` characters are cut, encoded and joined by their content's digest, so copies of
    one long text are encoded once; all others never leave the task that reads them.
    """
    files = files or public_files()
    key_type = docs.schema[key].dataType
    shape = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                          *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])

    def row(machine: Codec, ids: list[int]) -> tuple:
        found = (len(ids), hashlib.sha256(machine.listing(ids)).hexdigest(), hashlib.sha256(machine.decode(ids).encode()).hexdigest())
        return (*found, ids) if keep_ids else found

    def batch_of(names, kept, rows):
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in shape.names]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([kept, *[pa.array(c, k) for c, k in zip(cols, kinds[: len(cols)], strict=True)]], [names, *shape.names])

    def whole(batches):
        machine = codec(files)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                texts = part.column(1).to_pylist()
                yield batch_of(key, part.column(0), [row(machine, machine.encode(t or "")) for t in texts])

    def cut(batches):
        machine = codec(files)
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = machine.pieces(text)
                yield pa.RecordBatch.from_pydict({"digest": pa.array([digest] * len(parts)), "seq": pa.array(range(len(parts)), pa.int64()),
                                                  "kind": [k for k, _ in parts], "piece": [p for _, p in parts]})

    def each(batches):
        machine = codec(files)
        for batch in batches:
            cols = batch.to_pydict()
            ids = [machine.piece_ids(k, p) for k, p in zip(cols["kind"], cols["piece"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], ["digest", "seq", "kind", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        machine = codec(files)
        table = table.sort_by("seq")
        parts = list(zip(table["kind"].to_pylist(), table["ids"].to_pylist(), strict=True))
        digest = pa.array([table["digest"][0].as_py()])
        return pa.Table.from_batches([batch_of("digest", digest, [row(machine, machine.concatenate(parts))])])

    base = docs.select(key, "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    keyed = [T.StructField(key, key_type), *shape.fields]
    short = base.where(size <= long_text).mapInArrow(whole, T.StructType(keyed))
    long = base.where(size > long_text).select(key, "text", F.sha2("text", 256).alias("digest"))
    texts = long.groupBy("digest").agg(F.first("text").alias("text"))
    piece_shape = "digest string, seq long, kind string, "
    pieces = texts.mapInArrow(cut, piece_shape + "piece string").repartition("digest", "seq")
    ids = pieces.mapInArrow(each, piece_shape + "ids array<int>")
    once = ids.groupBy("digest").applyInArrow(joined, T.StructType([T.StructField("digest", T.StringType()), *shape.fields]))
    return short.unionByName(long.select(key, "digest").join(once, "digest").drop("digest"))


def decode(tokens: DataFrame, ids: str = "ids", files: tuple | None = None) -> DataFrame:
    """``tokens`` with the column ``decoded``: the text of each row's ids (null ids: empty)."""
    files = files or public_files()

    @F.pandas_udf(T.StringType())
    def text(column):
        machine = codec(files)
        return column.map(lambda x: "" if x is None else machine.decode(x))

    return tokens.withColumn("decoded", text(F.col(ids)))
