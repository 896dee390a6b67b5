"""The pipeline's stages on awkward rows, and the whole against brute force."""

import re
from collections import Counter

import corpus_pipeline as cp
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_llm_operators import classes_of, shingle_sets

from marginalia.llm import token_codec


def stage(name):
    return dict(cp.STAGES)[name]


def texts_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_names_and_columns(spark, small):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "token_codec"]
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", "text as kept_text", "1 as score", "doc_id as items", "2 as _mark", "3 as id", "4 as n_dropped")
    for _, f in cp.STAGES[:-1]:
        out = f(spark, docs, small)
        assert tuple(out.columns) == cp.COLUMNS and out.count() > 0


def test_every_stage_on_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    assert all(f(spark, docs, empty).collect() == [] for _, f in cp.STAGES)


def test_nulls_everywhere(spark, small, tmp_path):
    rows = [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}] * 3 + [{"doc_id": 4, "text": "one two three", "lang": None, "source": None, "n_chars": None}] * 2
    pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(f"{small}/documents.parquet")), tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in cp.STAGES:
        n = f(spark, docs, small).count()
        assert n == (2 if name == "language_id" else 5), name


def test_run_equals_brute_force(spark, small, rows):
    lettered = [r for r in rows if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    kept = {r["doc_id"] for r in lettered}
    first = {r.doc_id: r for r in stage("language_id")(spark, spark.read.parquet(f"{small}/documents.parquet"), small).collect()}
    assert set(first) == kept and all(r.lang for r in first.values())
    own = {i: first[i].text.split("\n") for i in first}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = Counter(k for lines in own.values() for k in {key(x) for x in lines} if len(k) >= 40)
    last = {k: max(i for i in own if k in {key(x) for x in own[i]}) for k, n in holders.items() if n >= 5}
    texts = {i: "\n".join(x for x in own[i] if last.get(key(x), i) == i) for i in own}
    classes = classes_of(shingle_sets([{"doc_id": i, "text": t} for i, t in texts.items()]))
    left = {i: t for i, t in texts.items() if classes[i] == i}
    item = pq.read_table(f"{small}/benchmark.parquet").to_pylist()[0]["text"]
    norm = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff ]", "", re.sub(r"\s+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    windows = [" ".join(norm(item).split()[k : k + 13]) for k in range(len(norm(item).split()) - 12)]
    left = {i: t for i, t in left.items() if not any(w in " ".join(norm(t).split()) for w in windows)}
    machine = token_codec.codec(token_codec.public_files())
    got = {r.doc_id: r.n_tokens for r in cp.run(spark, small).collect()}
    assert got == {i: len(machine.reference.encode(t, add_special_tokens=False).ids) for i, t in left.items()}


@pytest.mark.parametrize("folder", ["llm"])
def test_entry_registers_all(folder):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", x)[0] for x in names if x.startswith("op")}
    assert set(entry.oracle_sql()) <= names
