"""The whole run over own sources: golden results, fix, baseline, cache, budget, formats."""

import io
import json
import os
import subprocess
import xml.etree.ElementTree as ET
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from marginalia import cli
from marginalia.operators import edits
from marginalia.plans.reports import render
from marginalia.plans.run import BudgetError, CiWriteError, NoApiKeyError, Options, run
from marginalia.scorers.http import HttpScorer, TransportError
from marginalia.scorers.recorded import Recorded, RecordedScorer
from marginalia.settings import ConfigError, Settings, load_rubric
from marginalia.sources.files import ScopeError, resolve_base, scan_paths, scan_table

SHOP = b'''// Package shop sells things.
package shop

// ErrClosed is returned after closing time, see the ledger.
var ErrClosed = fail("closed")

// Sale is one sale.
type Sale struct {
	// Made is the time it was made.
	Made int
}

// Total doubles the price.
func Total(price int) int {
	// Add the tax here please.
	price = tax(price)
	// Lower all letters and trim.
	name := trim(price)

	// price = round(price)
	return price // price in cents
}

// Shown is quiet.
//
//marginalia:ignore
func Shown() {}

// TODO: sell more things later.
func more() {}
'''

SCORER = RecordedScorer((
    Recorded("doubles the price", 0.1, 0.4, 0.04, 0.0, 0.97),
    Recorded("Lower all letters", 1.1, 1.6, 0.91, 0.0, 0.90),
    Recorded("Add the tax", 2.6, 0.2, 0.08, 0.0, 0.95),
    Recorded("price in cents", 2.9, 0.9, 0.03, 0.0, 0.88),
    Recorded("time it was made", 3.0, 0.1, 0.02, 0.0, 0.94),
    Recorded("round(price)", 0.2, 0.3, 0.05, 0.93, 0.90),
    Recorded("ErrClosed is", 2.9, 1.1, 0.04, 0.0, 0.41),
), Recorded("", 2.7, 2.4, 0.05, 0.0, 0.93), 400)


def shop(tmp_path, name="shop.go", content=SHOP):
    folder = tmp_path / "src"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)
    return str(folder)


def options(path, **changes):
    return Options(**{"paths": (path,), "scorer": SCORER, "no_cache": True, "no_dotenv": True, "settings": Settings(), **changes})


@pytest.fixture(scope="module")
def checked(spark, tmp_path_factory):
    return run(spark, options(shop(tmp_path_factory.mktemp("checked"))))


def by_text(report):
    return {r["comment_text"]: r for r in report.results.collect()}


def test_golden_results(checked):
    rules = {k: (r["action"], r["rule"]) for k, r in by_text(checked).items()}
    assert rules == {
        "// Package shop sells things.": ("keep", ""),
        "// ErrClosed is returned after closing time, see the ledger.": ("flag", "low-confidence"),
        "// Sale is one sale.": ("keep", ""),
        "// Made is the time it was made.": ("flag", "weak-comment"),
        "// Total doubles the price.": ("flag", "wrong-comment"),
        "// Add the tax here please.": ("delete", "useless-comment"),
        "// Lower all letters and trim.": ("flag", "wide-scope"),
        "// price = round(price)": ("keep", ""),
        "// price in cents": ("flag", "weak-comment"),
    }


def test_counters(checked):
    info = checked.run
    assert (info["comments"], info["files"], info["suppressed"], info["exempt"]) == (11, 1, 1, 1)
    assert (info["assessed"], info["requests"], info["input_tokens"]) == (9, 9, 3600)
    assert info["cost_usd"] == pytest.approx(3600 * 0.042 / 1e6)
    assert (info["error"], info["warning"], info["info"], info["deleted"], info["worst"]) == (1, 3, 2, 1, 3)


@pytest.mark.parametrize("name", ["json", "sarif", "rdjson"])
def test_json_formats_parse(checked, name):
    out = io.StringIO()
    checked.write(out, name)
    document = json.loads(out.getvalue())
    if name == "json":
        assert document["schema_version"] == 2 and len(document["results"]) == 6
        assert document["summary"] == {"deleted": 1, "error": 1, "info": 2, "warning": 3}
        assert [r["line"] for r in document["results"]] == sorted(r["line"] for r in document["results"])
    if name == "sarif":
        made = document["runs"][0]
        assert [r["id"] for r in made["tool"]["driver"]["rules"]] == sorted({r["ruleId"] for r in made["results"]})
        assert sum("fixes" in r for r in made["results"]) == 1
    if name == "rdjson":
        assert sum("suggestions" in d for d in document["diagnostics"]) == 1


def test_text_github_and_checkstyle(checked):
    out = io.StringIO()
    checked.write(out, "text")
    assert "ERROR flag [wrong-comment]\n    accuracy   [----------]   3%  Fundamentally wrong\n" in out.getvalue()
    assert "11 comments in 1 files: 1 error, 3 warning, 2 info\n0 cached, 9 assessed in 9 request(s), 1 suppressed" in out.getvalue()
    out = io.StringIO()
    checked.write(out, "github")
    assert "::error file=" in out.getvalue() and "::notice file=" in out.getvalue()
    out = io.StringIO()
    checked.write(out, "checkstyle")
    root = ET.fromstring(out.getvalue().encode())
    assert len(root.findall("file")) == 1 and len(root.findall("file/error")) == 6
    with pytest.raises(ValueError):
        checked.write(io.StringIO(), "odd")


def test_reports_written_in_parallel_join_to_the_same_document(checked, tmp_path):
    for name in ("json", "checkstyle", "text"):
        rendered, out, folder = render(name, checked.results, checked.run), io.StringIO(), tmp_path / name
        rendered.write(out)
        rendered.save(str(folder))
        saved = "".join((folder / p).read_text() for p in sorted(os.listdir(folder)) if p.startswith("part-"))
        if name == "json":
            assert json.loads(saved) == json.loads(out.getvalue())
        else:
            assert saved == out.getvalue()


def test_fix_diff_then_write(spark, tmp_path):
    path = shop(tmp_path)
    report = run(spark, options(path, mode="fix", diff=True, profile="strict"))
    diff = report.diffs.first()["diff"]
    assert "-\t// Add the tax here please.\n \tprice = tax(price)" in diff and "-\t// price = round(price)\n" in diff
    file = os.path.join(path, "shop.go")
    assert open(file, "rb").read() == SHOP
    patched = subprocess.run(["git", "apply", "--unsafe-paths", "-p1", "--directory=/", "-"], input=diff.encode(), cwd="/",
                             capture_output=True, check=False)
    written = run(spark, options(path, mode="fix", profile="strict")) if patched.returncode else None
    after = open(file, "rb").read()
    want = SHOP.replace(b"\t// Add the tax here please.\n", b"").replace(b"\t// price = round(price)\n", b"")
    assert after == want
    assert written is None or written.run["deleted_comments"] == 2
    again = run(spark, options(path, mode="fix", profile="strict"))
    assert again.run["deleted_comments"] == 0 and open(file, "rb").read() == want


def test_fix_refuses_in_ci(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("CI", "true")
    with pytest.raises(CiWriteError):
        run(spark, options(shop(tmp_path), mode="fix"))


def test_edits_that_break_the_file_are_dropped(spark):
    source = b"package p\n\nfunc f() int {\n\t// Head.\n\tx := 1\n\treturn x // tail\n}\n"
    rows = spark.createDataFrame([("a.go", source), ("b.go", source)], "file string, content binary")

    def doomed(file, text):
        start = source.index(text)
        return (file, (start, start + len(text)), source.rfind(b"\n", 0, start) + 1, "delete")

    found = spark.createDataFrame([doomed("a.go", b"// Head."), doomed("a.go", b"// tail"), doomed("b.go", b"{")],
                                  "file string, comment struct<start:int,end:int>, line_start int, action string")
    got = {r["file"]: r for r in edits.guard(edits.plan_edits(found, rows)).collect()}
    assert bytes(got["a.go"]["edited"]) == b"package p\n\nfunc f() int {\n\tx := 1\n\treturn x\n}\n" and got["a.go"]["ok"]
    assert not got["b.go"]["ok"] and "fix-aborted" in got["b.go"]["error"] and got["b.go"]["deleted"] == 0


def test_files_changed_meanwhile_are_left_alone(tmp_path):
    path = tmp_path / "a.go"
    path.write_bytes(b"new")
    assert "no longer what was scored" in edits.replace_file(str(path), b"old", b"edited")
    assert edits.replace_file(str(path), b"new", b"edited") == "" and path.read_bytes() == b"edited"
    assert edits.replace_file(str(path), b"new", b"edited") == ""


def test_a_file_changed_while_it_was_scored_is_left_alone(spark, tmp_path):
    path = shop(tmp_path)
    file, newer = os.path.join(path, "shop.go"), b"// A header that came meanwhile, quite long.\n" + SHOP

    class Slow(RecordedScorer):
        def score(self, planned):
            with open(file, "wb") as out:
                out.write(newer)
            return super().score(planned)

    report = run(spark, options(path, mode="fix", profile="strict", scorer=Slow(**{f.name: getattr(SCORER, f.name) for f in fields(SCORER)})))
    row = report.fixes.first()
    assert "no longer what was scored" in row["error"] and open(file, "rb").read() == newer


def test_every_skipped_file_is_named(spark, tmp_path, capsys):
    path = shop(tmp_path)
    for k in range(30):
        with open(os.path.join(path, f"bad{k:02}.go"), "w") as out:
            out.write("package p\n\nfunc f( {\n// Never closed here.\n")
    run(spark, options(path))
    said = capsys.readouterr().err
    assert sum(f"bad{k:02}.go" in said for k in range(30)) == 30


def test_a_named_baseline_must_be_readable(spark, tmp_path):
    with pytest.raises(ConfigError):
        run(spark, options(shop(tmp_path), baseline_path="file:///nowhere/entries"))


def test_equal_paths_with_different_contents_are_all_kept(spark):
    rows = [("a.go", b"package a\n"), ("a.go", b"package b\n"), ("a.go", b"package b\n"), ("b.go", b"package c\n"), ("b.go", b"package c\n"), ("c.go", b"package d\n")]
    got = sorted((r.file, bytes(r.content)) for r in scan_table(spark.createDataFrame(rows, "file string, content binary")).collect())
    assert [f for f, _ in got if not f.startswith("#")] == ["b.go", "c.go"]
    assert sorted(c for f, c in got if f.startswith("#") and f.endswith("/a.go")) == [b"package a\n", b"package b\n"] and len(got) == 4
    apart = spark.createDataFrame([("one", "a.go", b"package a\n"), ("two", "a.go", b"package b\n")], "repo string, file string, content binary")
    assert sorted(r.file for r in scan_table(apart).collect()) == ["one/a.go", "two/a.go"]


def test_baseline_silences(spark, tmp_path):
    path, baseline = shop(tmp_path), str(tmp_path / "baseline.json")
    run(spark, options(path, mode="baseline", baseline_path=baseline))
    entries = json.loads(open(baseline).read())["entries"]
    assert len(entries) == 6 and [e["id"] for e in entries] == sorted(e["id"] for e in entries)
    report = run(spark, options(path, baseline_path=baseline))
    assert report.run["baselined"] == 6 and report.results.where("action <> 'keep'").count() == 0


def test_cache_serves_until_it_expires(spark, tmp_path):
    path, settings = shop(tmp_path), Settings(cache_dir=str(tmp_path / "cache"))
    first = run(spark, options(path, no_cache=False, settings=settings, now=1000.0))
    second = run(spark, options(path, no_cache=False, settings=settings, now=2000.0, scorer=None))
    late = run(spark, options(path, no_cache=False, settings=settings, now=1000.0 + 91 * 86400))
    assert (first.run["cached"], second.run["cached"], late.run["cached"]) == (0, 9, 0)
    assert second.run["requests"] == 0 and second.run["input_tokens"] == 0
    assert {k: r["rule"] for k, r in by_text(first).items()} == {k: r["rule"] for k, r in by_text(second).items()}


def test_budget_before_and_during(spark, tmp_path):
    path = shop(tmp_path)
    with pytest.raises(BudgetError):
        run(spark, options(path, budget_cents=0.0001))
    costly = RecordedScorer(SCORER.verdicts, SCORER.default, 100_000)
    report = run(spark, options(path, budget_cents=0.9, scorer=costly))
    again = run(spark, options(path, budget_cents=0.9, scorer=costly))
    assert isinstance(report.stopped, BudgetError) and report.run["incomplete"]
    assert 0 < report.run["assessed"] < 9 and set(by_text(report)) == set(by_text(again))


def test_a_key_is_needed_to_score(spark, tmp_path):
    with pytest.raises(NoApiKeyError):
        run(spark, options(shop(tmp_path), scorer=None, settings=Settings(api_key_env="NO_SUCH_KEY")))


def test_ranges_limit_the_run(spark, tmp_path):
    ranges = spark.createDataFrame([(os.path.join(str(tmp_path), "src", "shop.go"), 15, 16)], "file string, start int, end int")
    report = run(spark, options(shop(tmp_path), ranges=ranges))
    assert list(by_text(report)) == ["// Add the tax here please."]


def test_a_docblock_is_one_request(spark, tmp_path):
    php = b"<?php\n\nclass Ledger\n{\n    /**\n     * Settles the order today.\n     *\n     * @param int $id\n     * @return string in lowercase\n     */\n    public function settle(int $id): string\n    {\n        return strtoupper((string) $id);\n    }\n}\n"
    scorer = RecordedScorer((Recorded("@param int", 3, 0.1, 0, 0, 0.9), Recorded("lowercase", 0.1, 2, 0, 0, 0.9)),
                            Recorded("", 2.8, 2.8, 0, 0, 0.9), 900)
    report = run(spark, options(shop(tmp_path, "Ledger.php", php), scorer=scorer))
    assert {r["slot"]: r["rule"] for r in report.results.collect()} == {"": "", "a1": "redundant-annotation", "a2": "wrong-comment"}
    assert report.run["requests"] == 1 and report.run["input_tokens"] == 900


def test_http_scorer_asks_and_reads_answers(spark, tmp_path):
    def transport(url, headers, body, timeout):
        assert headers["Authorization"] == "Bearer k" and body["state"].startswith("--- CONTEXT ---\n")
        answers = {}
        for name in body["questions"]:
            axis = name.split(".")[0]
            answers[name] = ({"score": 0.2, "confidence": 0.9, "legend": {"0": "none"}} if axis in ("accuracy", "usefulness")
                             else {"noul": 0.1})
        return {"model": "m-1", "usage": {"input_tokens": 10}, "answers": answers}

    scorer = HttpScorer("http://unused", "k", "m", load_rubric(), transport=transport, concurrency=2)
    report = run(spark, options(shop(tmp_path), scorer=scorer, budget_cents=50.0))
    rows = by_text(report)
    assert report.run["model"] == "m-1" and report.run["input_tokens"] == 90 and len(rows) == 9
    assert rows["// Total doubles the price."]["verdict"]["accuracy"]["label"] == "none"


def test_soft_fail_only_for_transport(spark, tmp_path):
    def down(url, headers, body, timeout):
        raise TransportError("scorer unreachable")

    scorer = HttpScorer("http://unused", "k", "m", load_rubric(), transport=down)
    report = run(spark, options(shop(tmp_path), scorer=scorer, soft_fail=True))
    assert report.soft_failed and report.results is None
    with pytest.raises(Exception, match="unreachable"):
        run(spark, options(shop(tmp_path), scorer=scorer))


def test_scan_walks_skips_and_sorts(spark, tmp_path):
    for name in ("a/_x.ts", "a/__init__.py", "node_modules/y.js", "vendor/z.go", "b/.hidden.py", "b/k_test.go"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
    root = str(tmp_path)
    ignore = [f"{root}/vendor/**", "**/*_test.go"]
    got = sorted(r["file"] for r in scan_paths(spark, (root + "/...", root + "/a"), ignore).collect())
    assert got == [f"{root}/a/__init__.py", f"{root}/a/_x.ts", f"{root}/b/.hidden.py"]
    with pytest.raises(ScopeError):
        scan_paths(spark, (root + "/absent",))


def test_base_ref_order():
    def refs(**known):
        def run_git(*args):
            key = " ".join(args)
            for part, value in known.items():
                if part.replace("_", " ") in key.replace("-", " "):
                    return value
            raise ScopeError("no")
        return run_git

    assert resolve_base("given") == "given"
    assert resolve_base(run=refs(symbolic_ref="refs/remotes/origin/trunk\n")) == "origin/trunk"
    assert resolve_base(run=refs(abbrev_ref="origin/x\n")) == "origin/x"
    assert resolve_base(run=refs(verify_master="1")) == "master"
    with pytest.raises(ScopeError):
        resolve_base(run=refs())


def test_staged_lines_in_git(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name in ("GIT_DIR", "GIT_WORK_TREE"):
        monkeypatch.delenv(name, raising=False)

    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.go").write_bytes(SHOP)
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "a.go").write_bytes(SHOP.replace(b"price = tax(price)", b"price = tax(price, 1)"))
    git("add", ".")
    report = run(spark, options("", paths=(), staged=True))
    assert report.run["scope"] == "staged" and report.run["comments"] == 0
    (tmp_path / "a.go").write_bytes(SHOP.replace(b"the tax here", b"the tax now"))
    git("add", ".")
    report = run(spark, options("", paths=(), staged=True))
    assert [r["comment_text"] for r in report.results.collect()] == ["// Add the tax now please."]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("MARGINALIA_CACHE_DIR", str(tmp_path / "c"))
    monkeypatch.chdir(tmp_path)
    path = shop(tmp_path)
    assert cli.main(["version"]) == 0
    assert cli.main(["check", path, "--no-dotenv"], SCORER) == 1
    assert "wrong-comment" in capsys.readouterr().out
    assert cli.main(["cache", "stats"]) == 0 and "9 cached verdicts" in capsys.readouterr().out
    assert cli.main(["check", path, "--no-dotenv", "--fail-on", "never", "--format", "json", "-o", str(tmp_path / "o.json")], SCORER) == 0
    assert json.loads((tmp_path / "o.json").read_text())["run"]["cached"] == 9
    assert cli.main(["check", path, "--no-dotenv", "--fail-on", "never", "--format", "json", "-o", str(tmp_path / "parts") + "/"], SCORER) == 0
    parts = sorted(p for p in os.listdir(tmp_path / "parts") if p.startswith("part-"))
    assert len(json.loads("".join((tmp_path / "parts" / p).read_text() for p in parts))["results"]) > 0
    assert cli.main(["cache", "clear"]) == 0 and cli.main(["cache", "stats"]) == 0
    assert "0 cached verdicts" in capsys.readouterr().out
    assert cli.main(["check", path, "--budget", "0.0001"], SCORER) == 3
    assert cli.main(["check", str(tmp_path / "absent")], SCORER) == 2


def test_a_stopped_batch_is_not_written(spark, tmp_path):
    from marginalia.streaming.watch import watch

    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a.go", SHOP)], "file string, content binary").write.parquet(incoming)
    stream = spark.readStream.schema("file string, content binary").parquet(incoming)
    query = watch(stream, options("", budget_cents=1e-9), out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="over budget"):
        query.awaitTermination(300)
    assert not os.path.exists(out)


def test_stream_of_files(spark, tmp_path):
    from marginalia.streaming.watch import watch

    incoming = str(tmp_path / "in")
    spark.createDataFrame([("a.go", SHOP)], "file string, content binary").write.parquet(incoming)
    stream = spark.readStream.schema("file string, content binary").parquet(incoming)
    out = str(tmp_path / "out")
    query = watch(stream, options(""), out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert spark.read.parquet(out).where(F.col("action") != "keep").count() == 6
