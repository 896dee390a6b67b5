"""Operators against small tables and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import paths, scoring, text
from marginalia.operators import batching
from marginalia.operators.docblocks import split_docblock
from marginalia.operators.filtering import exempt_prefix
from marginalia.operators.lookup import spread_join
from marginalia.operators.policy import decision
from marginalia.operators.ranges import in_scope, parse_hunks
from marginalia.settings import Settings, load_rubric

col = F.col


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_prose_of_comments(spark):
    cases = {
        "// plain": "plain", "/** Block\n * of lines\n */": "Block of lines", "# hash": "hash", "/**/": "/",
        "\t// tabbed\t": "tabbed", "/* one */": "one", "//": "", "": "", "// a\n\n// b": "a  b", "#! /bin": "! /bin",
    }
    rows = spark.createDataFrame(list(cases.items()), "c string, want string")
    for row in rows.withColumn("got", text.comment_text(col("c"))).collect():
        assert row["got"] == row["want"], row["c"]


def test_exempt_prefixes(spark):
    prefixes = Settings().all_exempt_prefixes
    exempt = ["todo later", "FIXME: x", "marginalia:ignore", "nolint:all", "@ts-ignore", "istanbul ignore", "type: ignore", "",
              "!important", "copyright 2020", "SPDX-license-identifier: MIT", "go:generate", "vim: set", "NOQA"]
    prose = ["istanbulish", "explains the todo list"]
    rows = spark.createDataFrame([(t,) for t in exempt + prose], "t string")
    got = {r["t"]: r["x"] for r in rows.withColumn("x", exempt_prefix(col("t"), prefixes)).collect()}
    assert all(got[t] for t in exempt) and not any(got[t] for t in prose)


@pytest.mark.parametrize("pattern, path, want", [
    ("vendor/**", "vendor/a/b.go", True), ("vendor/**", "src/vendor/a.go", False), ("**/*_test.go", "a/b_test.go", True),
    ("**/*_test.go", "b_test.go", True), ("**/generated/**", "x/generated/y.ts", True), ("*.go", "a/b.go", False),
    ("a?c.py", "abc.py", True), ("a?c.py", "a/c.py", False), ("src/*.js", "./src/a.js", True), ("a.b", "axb", False),
])
def test_globs(spark, pattern, path, want):
    assert one(spark, x=paths.matches_any(F.lit(path), (pattern,)))["x"] is want


def test_languages(spark):
    got = one(spark, a=paths.language_of(F.lit("x/Y.TSX")), b=paths.language_of(F.lit("m.pyi")), c=paths.language_of(F.lit("x.go/y")),
              d=paths.language_of(F.lit("a.cjs")), e=paths.language_of(F.lit("q.php")))
    assert list(got.values()) == ["typescript", "python", "", "javascript", "php"]


def test_snippet_bar_and_estimate(spark):
    got = one(spark, s=text.snippet(F.lit(" a\r\n  b \nccc"), 5), whole=text.snippet(F.lit("ab"), 5), b=scoring.bar(F.lit(37)),
              t=scoring.estimate_tokens(F.lit(3600)), p=scoring.percent(F.lit(2.5)))
    assert got == {"s": "a b …", "whole": "ab", "b": "[###-------]", "t": 1250, "p": 83}


POLICY = [
    # name, kind, file, protected, required, acc, use, conf, over, disabled, profile, changes, action, severity, rule
    ("low confidence first", "inline", "a.go", 0, 0, 5, 5, 0.3, 0.99, 0.0, "default", {}, "flag", "info", "low-confidence"),
    ("overreach guard", "inline", "a.go", 0, 0, 10, 10, 0.95, 0.85, 0.0, "default", {}, "flag", "info", "wide-scope"),
    ("doc may be broad", "doc", "a.go", 0, 0, 10, 90, 0.95, 0.95, 0.0, "default", {}, "flag", "error", "wrong-comment"),
    ("wrong is never deleted", "inline", "a.go", 0, 0, 20, 5, 0.95, 0.1, 0.0, "default", {}, "flag", "error", "wrong-comment"),
    ("useless", "inline", "a.go", 0, 0, 90, 10, 0.95, 0.1, 0.0, "default", {}, "delete", "warning", "useless-comment"),
    ("weak", "inline", "a.go", 0, 0, 55, 80, 0.95, 0.1, 0.0, "default", {}, "flag", "warning", "weak-comment"),
    ("good", "inline", "a.go", 0, 0, 95, 90, 0.95, 0.05, 0.0, "default", {}, "keep", "", ""),
    ("protected", "doc", "a.go", 1, 0, 90, 5, 0.95, 0.1, 0.0, "default", {}, "flag", "warning", "weak-comment"),
    ("annotation", "annotation", "a.php", 0, 0, 90, 5, 0.95, 0.1, 0.0, "default", {}, "flag", "warning", "redundant-annotation"),
    ("annotation opt-in", "annotation", "a.php", 0, 0, 90, 5, 0.95, 0.1, 0.0, "default", {"delete_annotations": True},
     "delete", "warning", "redundant-annotation"),
    ("lenient", "inline", "a.go", 0, 0, 50, 30, 0.95, 0.1, 0.0, "lenient", {}, "keep", "", ""),
    ("strict", "inline", "a.go", 0, 0, 50, 30, 0.95, 0.1, 0.0, "strict", {}, "flag", "warning", "weak-comment"),
    ("borderline", "inline", "a.go", 0, 0, 90, 20, 0.95, 0.1, 0.0, "strict", {}, "delete", "warning", "useless-comment"),
    ("disabled ignored", "inline", "a.go", 0, 0, 5, 5, 0.3, 0.1, 0.9, "default", {}, "keep", "", ""),
    ("disabled deleted", "inline", "a.go", 0, 0, 5, 5, 0.3, 0.1, 0.9, "strict", {}, "delete", "warning", "commented-out-code"),
    ("disabled protected", "doc", "a.go", 1, 0, 5, 5, 0.3, 0.1, 0.9, "strict", {}, "flag", "warning", "commented-out-code"),
    ("below the guard", "inline", "a.go", 0, 0, 5, 5, 0.3, 0.1, 0.6, "strict", {}, "flag", "info", "low-confidence"),
    ("required", "doc", "a.py", 0, 1, 90, 5, 0.95, 0.1, 0.0, "default", {"keep_docstrings": False}, "flag", "warning", "weak-comment"),
    ("docstring unshielded", "doc", "a.py", 1, 0, 90, 5, 0.95, 0.1, 0.0, "default", {"keep_docstrings": False}, "delete",
     "warning", "useless-comment"),
    ("docstring shielded", "doc", "a.py", 1, 0, 90, 5, 0.95, 0.1, 0.0, "default", {"keep_exported_docs": False}, "flag",
     "warning", "weak-comment"),
]


def test_policy_table(spark):
    for name, kind, file, protected, required, acc, use, conf, over, off, profile, changes, action, severity, rule in POLICY:
        got = spark.range(1).select(decision(
            Settings(**changes).resolve(profile=profile), file=F.lit(file), kind=F.lit(kind), protected=F.lit(bool(protected)),
            required=F.lit(bool(required)), accuracy_pct=F.lit(acc), accuracy_confidence=F.lit(conf), usefulness_pct=F.lit(use),
            usefulness_confidence=F.lit(conf), overreach=F.lit(over), commented_out=F.lit(off)).alias("d")).first()["d"]
        assert tuple(got) == (action, severity, rule), name


def test_hunks(spark):
    diff = ["--- a/x", "+++ b/x.go", "@@ -1,2 +4,2 @@ func", "+a", "@@ -9 +22 @@", "@@ -30,2 +29,0 @@", "+++ b/y.go", "@@ broken"]
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(diff)], "diff int, line_no int, text string")
    assert sorted(tuple(r) for r in parse_hunks(lines).collect()) == [(0, "x.go", 4, 5), (0, "x.go", 22, 22)]


def test_scope_by_brute_force(spark):
    rng = random.Random(7)
    found = [(f"f{rng.randrange(6)}", i, (a := rng.randrange(1, 400)), a + rng.choice((0, 0, 1, 70, 200))) for i in range(400)]
    ranges = [(f"f{rng.randrange(4)}", (a := rng.randrange(1, 400)), a + rng.choice((0, 3, 90))) for _ in range(12)]
    want = sorted(i for f, i, a, b in found if not any(r[0] == f for r in ranges)
                  or any(r[0] == f and a <= r[2] and b >= r[1] for r in ranges))
    rows = spark.createDataFrame(found, "file string, ord long, line int, end_line int")
    got = in_scope(rows, spark.createDataFrame(ranges, "file string, start int, end int"))
    assert sorted(r["ord"] for r in got.collect()) == want


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join_under_skew(spark, how):
    left = spark.range(600).select(F.when(col("id") % 3 == 0, 0).otherwise(col("id") % 50).alias("k"), col("id").alias("n"))
    right = spark.range(40).select(col("id").alias("k"), (col("id") * 2).alias("v"))
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
    spread = spread_join(left, right, "k", ("n",), how, hot_rows=100, max_hot=2, fanout=5)
    assert sorted(map(tuple, spread.collect()), key=repr) == plain


def test_running_spend_is_a_prefix_sum(spark):
    rows = spark.range(500).select(F.concat(F.lit("r"), "id").alias("k"), (col("id") % 7).alias("v"))
    got = {r["k"]: r["spent_before"] for r in batching.running_spend(rows, "k", "v").collect()}
    import hashlib
    total = 0
    for key, value in sorted(((f"r{i}", i % 7) for i in range(500)), key=lambda p: hashlib.md5(p[0].encode()).hexdigest()):
        assert got[key] == total
        total += value


def _findings(spark, rows):
    base = {"file": "f", "ord": 0, "id": "x", "slot": "", "kind": "inline", "block": "", "block_text": "", "context": "",
            "code_text": "", "comment_text": ""}
    schema = "file string, ord long, id string, slot string, kind string, block string, block_text string, context string, code_text string, comment_text string"
    return spark.createDataFrame([tuple({**base, "ord": i, **r}.values()) for i, r in enumerate(rows)], schema)


# bytes of state, prose findings, tag findings, copies, and the tokens such a request was billed
BILLED = [(597, 1, 0, 1, 755), (403, 0, 1, 1, 719), (348, 1, 1, 1, 1074), (678, 0, 2, 1, 1144), (655, 0, 3, 1, 1494),
          (526, 0, 4, 1, 1792), (454, 1, 0, 2, 708)]


@pytest.mark.parametrize("size, prose, tags, copies, billed", BILLED)
def test_estimate_tracks_the_bill(spark, size, prose, tags, copies, billed):
    empty = len("--- CONTEXT ---\n>>> CODE\n\n<<< CODE\n--- COMMENT ---\n\n")
    said = "x" * (size - empty)
    rows = [{"id": "same", "comment_text": said}] * copies if not tags else (
        [{"id": "p", "block": "b", "block_text": said}] * prose
        + [{"id": f"a{k}", "slot": f"a{k}", "kind": "annotation", "block": "b", "block_text": said} for k in range(1, tags + 1)])
    planned = batching.requests(_findings(spark, rows), load_rubric()).collect()
    assert len(planned) == 1
    assert abs(planned[0]["est_tokens"] - billed) / billed <= 0.1


def test_a_large_block_is_split(spark):
    rows = [{"id": f"a{k}", "slot": f"a{k}", "kind": "annotation", "block": "b", "block_text": "/** @p */"} for k in range(1, 201)]
    planned = batching.requests(_findings(spark, rows), load_rubric()).collect()
    assert len(planned) >= 2 and sum(r["n_findings"] for r in planned) == 200
    assert all(r["est_tokens"] <= 32_000 for r in planned)
    assert sorted(i["ord"] for r in planned for i in r["items"]) == list(range(200))


def test_docblock_tags_keep_their_continuation_lines(spark):
    block = ("/**\n * Holds decoded rows.\n *\n * @var array[] rows by number; a reader takes\n *             several at once\n"
             " * @see Reader\n */")
    got = spark.range(1).select(split_docblock(F.lit(block)).alias("d")).first()["d"]
    texts = [p["text"] for p in got["parts"]]
    assert texts == ["/**\n * Holds decoded rows.\n *\n */",
                     "@var array[] rows by number; a reader takes\n *             several at once", "@see Reader"]
    for part in got["parts"][1:]:
        assert block.encode()[part["start"]:part["end"]].decode() == part["text"]
    assert f">>> A1\n * {texts[1]}\n<<< A1\n" in got["block_text"]
    assert [p["slot"] for p in got["parts"]] == ["", "a1", "a2"]


def test_items_are_packed_in_linear_time_and_slots_count_once():
    import time

    started = time.monotonic()
    placed = batching.place_items([f"a{k}" for k in range(100_000)], [500] * 100_000, 2000, 32_000)
    assert time.monotonic() - started < 5 and placed[-1][0] == 99_999 // 224 and max(n for _, n in placed) == 2000 + 224 * 500
    # three slots of ten bytes, asked again and again, never fill a request that holds them
    assert batching.place_items(["a", "b", "c"] * 50, [10] * 150, 100, 300)[-1] == (0, 130)
    assert batching.place_items(["a", "b", "a"], [9000, 10, 9000], 0, 300) == [(0, 9000), (1, 10), (2, 9000)]


@pytest.mark.parametrize("rows_in_window", [1, 3, 1 << 16])
def test_running_totals_need_no_fixed_number_of_buckets(spark, rows_in_window):
    import hashlib

    amounts = {f"k{k}": k % 7 for k in range(900)}
    rows = spark.createDataFrame(list(amounts.items()), "k string, v long")
    got = {r.k: r.spent_before for r in batching.running_spend(rows, "k", "v", rows_in_window=rows_in_window).collect()}
    spent, want = 0, {}
    for k in sorted(amounts, key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k)):
        want[k], spent = spent, spent + amounts[k]
    assert got == want


def test_recorded_answers_scale_and_keep_list_order(spark):
    import time

    from marginalia.scorers import recorded

    entries = tuple(recorded.Recorded(f"word{k}x", k / 1e5, 0.0, 0.0) for k in range(100_000))
    scorer = recorded.RecordedScorer((recorded.Recorded("", 9.0), *entries[::-1], entries[7]), recorded.Recorded("", 2.5))
    texts = ["word7x", "a word12x word99999x word3x", "none", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    started = time.monotonic()
    made = rows.select("t", scorer.match(F.col("t"))["accuracy"].alias("a"))
    made._jdf.queryExecution().executedPlan()
    assert time.monotonic() - started < 5
    got = {r.t: r.a for r in made.collect()}
    assert got == {"word7x": 7e-5, texts[1]: 0.99999, "none": 2.5, None: 2.5, "": 2.5}
    few = recorded.RecordedScorer((recorded.Recorded("b", 1.0), recorded.Recorded("a", 2.0), recorded.Recorded("ab", 3.0)))
    many = recorded.RecordedScorer(few.verdicts + tuple(recorded.Recorded(f"zz{k}", 0.1) for k in range(100)))
    for text in ("ab", "a", "xx b a", ""):
        one = rows.limit(1).select(few.match(F.lit(text)).alias("f"), many.match(F.lit(text)).alias("m")).first()
        assert one.f == one.m
