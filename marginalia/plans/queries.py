"""The engine's operators over the driver tables, one DataFrame each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import identity, paths, scoring, text
from marginalia.operators import batching, edits, extraction
from marginalia.operators.docblocks import split_docblock
from marginalia.operators.filtering import filter_counts, with_disposition
from marginalia.operators.policy import classify
from marginalia.operators.ranges import in_scope, parse_hunks
from marginalia.operators.summary import reportable, summary
from marginalia.operators.lookup import spread_join
from marginalia.plans import adapters as A
from marginalia.plans import reports
from marginalia.scorers.recorded import Recorded, RecordedScorer
from marginalia.settings import Settings, load_rubric
from marginalia.sources.baseline import baseline_entries
from marginalia.sources.files import scan_table
from marginalia.sources.verdict_cache import latest, look_up

col = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _settings(profile: str = "default", **changes) -> Settings:
    return Settings(**changes).resolve(profile=profile)


def _results(spark, sf_dir, profile="default", **changes) -> DataFrame:
    rows = A.findings(spark, sf_dir).withColumn("verdict", A.verdict(col("doc_id"), col("i")))
    return classify(rows, _settings(profile, **changes))


# --- expressions ------------------------------------------------------------------------


@query
def comment_prose(spark, sf_dir):
    rows = A.findings(spark, sf_dir).withColumn("prose", text.comment_text(col("comment_text")))
    return rows.select("doc_id", "i", "prose", text.char_count(col("prose")).alias("chars"))


@query
def finding_identity(spark, sf_dir):
    return A.findings(spark, sf_dir).select("doc_id", "i", identity.finding_id(
        col("comment_text"), col("code_text"), F.lit(3), F.lit("latest")).alias("finding_id"))


@query
def path_language(spark, sf_dir):
    words = ("go", "TSX", "mjs", "php", "pyi", "md")
    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("."), A.pick(col("page_id"), words))
    return A.table(spark, sf_dir, "pages").select("page_id", paths.language_of(path).alias("language"))


@query
def path_globs(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return A.table(spark, sf_dir, "pages").select(
        "page_id", paths.matches_any(path, ("*/en/**",)).alias("english"),
        paths.matches_any(path, ("**/???", "*.example.com/**")).alias("short_or_com"),
        paths.matches_any(path, ("**/*.html", "m.*/**")).alias("html_or_mobile"))


@query
def binary_files(spark, sf_dir):
    content = F.concat(col("text").cast("binary"), F.when(col("doc_id") % 7 == 0, F.lit(b"\0")).otherwise(F.lit(b"")))
    return A.table(spark, sf_dir, "documents").select("doc_id", paths.is_binary(content).alias("binary"))


@query
def text_end_line(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", text.end_line(F.lit(1), col("text")).alias("end_line"))


@query
def axis_percent(spark, sf_dir):
    v = A.verdict(col("doc_id"), col("i"))
    return A.lines(spark, sf_dir).select(
        "doc_id", "i", v["accuracy"]["pct"].alias("accuracy_pct"), v["accuracy"]["label"].alias("accuracy_label"),
        v["usefulness"]["pct"].alias("usefulness_pct"), v["usefulness"]["label"].alias("usefulness_label"))


@query
def request_cost(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").withColumn("tokens", scoring.estimate_tokens(F.octet_length("text")))
    share = scoring.shared_tokens(col("tokens"), col("doc_id") % 7 + 1)
    return rows.select("doc_id", "tokens", share.alias("share"), scoring.cost_usd(share).alias("cost_usd"))


@query
def question_texts(spark, sf_dir):
    suffix = scoring.question_suffix(col("slot"), col("block_text"))
    size = scoring.question_bytes(load_rubric(), col("kind"), col("slot"), col("block_text"))
    return A.findings(spark, sf_dir).select("doc_id", "i", suffix.alias("suffix"), size.alias("question_bytes"))


@query
def request_states(spark, sf_dir):
    state = scoring.state(F.when(col("i") % 3 == 0, col("code_text")).otherwise(""), col("code_text"), col("block_text"),
                          col("comment_text"))
    rows = A.findings(spark, sf_dir).withColumn("state", state)
    return rows.select("doc_id", "i", F.md5(col("state").cast("binary")).alias("state_md5"),
                       F.octet_length("state").alias("state_bytes"))


@query
def snippets(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", text.snippet(col("text"), 80).alias("snippet"))


@query
def code_caps(spark, sf_dir):
    capped, kept = text.cap_lines(col("text"), 3, F.lit("\n// ... cut"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(capped.cast("binary")).alias("capped_md5"),
                                                      kept.alias("kept_bytes"))


@query
def cache_salts(spark, sf_dir):
    key = F.when(col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("key-"), col("user_id").cast("string")))
    return A.table(spark, sf_dir, "events").select("user_id", identity.cache_salt(key).alias("salt")).distinct()


# --- filters and lookups -------------------------------------------------------------------


def _baseline(spark, sf_dir):
    return A.findings(spark, sf_dir).where(col("i") % 7 == 3).select("id")


@query
def dispositions(spark, sf_dir):
    rows = with_disposition(A.findings(spark, sf_dir), _settings(), _baseline(spark, sf_dir))
    return rows.groupBy("kind", "disposition").agg(F.count("*").alias("n"))


@query
def disposition_counts(spark, sf_dir):
    return filter_counts(with_disposition(A.findings(spark, sf_dir), _settings(kinds=("doc", "inline", "trailing"))))


@query
def baseline_survivors(spark, sf_dir):
    rows = with_disposition(A.findings(spark, sf_dir), _settings(), _baseline(spark, sf_dir))
    return rows.where("disposition = 'kept'").select("doc_id", "i", "id")


@query
def cached_verdicts(spark, sf_dir):
    found = look_up(A.findings(spark, sf_dir), A.cache_entries(spark, sf_dir), F.lit("mine"), 20 * 86400.0,
                    F.lit("2024-01-21 00:00:00").cast("timestamp"), spread_by=("doc_id", "i"))
    return found.select("doc_id", "i", col("verdict").isNotNull().alias("hit"),
                        col("verdict.accuracy.pct").alias("accuracy_pct"))


@query
def cache_generations(spark, sf_dir):
    rows = latest(A.cache_entries(spark, sf_dir))
    return rows.select("salt", "id", "stored", col("verdict.usefulness.pct").alias("usefulness_pct"))


@query
def changed_line_findings(spark, sf_dir):
    return in_scope(A.findings(spark, sf_dir), A.ranges(spark, sf_dir)).select("doc_id", "i")


@query
def diff_hunks(spark, sf_dir):
    return parse_hunks(A.diff_text(spark, sf_dir), group=("doc_id",), order="i")


@query
def attached_verdicts(spark, sf_dir):
    rows = A.findings(spark, sf_dir)
    # several lines answer for one id; the last in file order wins
    answers = rows.where(col("i") % 3 != 1).groupBy("id").agg(F.max_by(
        (col("doc_id") * 31 + col("i")), F.struct("file", "ord")).alias("verdict"))
    return spread_join(rows, answers, "id", ("file", "ord"), "inner").select("doc_id", "i", "verdict")


@query
def recorded_answers(spark, sf_dir):
    scorer = RecordedScorer((Recorded("the", 0.5, 1.0, 0.1, 0.0, 0.9), Recorded("de ", 2.5, 0.2, 0.3, 0.1),
                             Recorded("", 1, 1, 1, 1), Recorded("and", 3.0, 3.0, 0.9, 0.8, 0.4)),
                            Recorded("", 2.7, 2.4, 0.05, 0.0, 0.93))
    entry = scorer.match(col("comment_text"))
    return A.findings(spark, sf_dir).select("doc_id", "i", entry["accuracy"].alias("accuracy"), entry["usefulness"].alias(
        "usefulness"), entry["overreach"].alias("overreach"), entry["confidence"].alias("confidence"))


@query
def many_recorded_answers(spark, sf_dir):
    """Recorded answers for every pair of letters, in an order in which most comments hold several."""
    pairs = [(chr(97 + k * 7 % 26), chr(97 + (k * 11 + k // 26) % 26)) for k in range(676)]
    scorer = RecordedScorer(tuple(Recorded(a + b, k % 301 / 100, 1.0, 0.5, 0.0, 0.9) for k, (a, b) in enumerate(pairs)), Recorded("", 3.0))
    entry = scorer.match(col("comment_text"))
    return A.findings(spark, sf_dir).select("doc_id", "i", entry["accuracy"].alias("accuracy"))


# --- policy, summaries, reports --------------------------------------------------------------


def _policy(profile, **changes):
    def run(spark, sf_dir):
        return _results(spark, sf_dir, profile, **changes).select("doc_id", "i", "action", "severity", "rule")
    return run


QUERIES["policy_default"] = _policy("default")
QUERIES["policy_strict"] = _policy("strict", keep_exported_docs=False, delete_annotations=True)
QUERIES["policy_lenient"] = _policy("lenient", keep_docstrings=False)


@query
def result_summary(spark, sf_dir):
    return summary(_results(spark, sf_dir, "strict"))


@query
def rule_counts(spark, sf_dir):
    """Flagship: findings scored, classified and counted by rule."""
    rows = reportable(_results(spark, sf_dir))
    return rows.groupBy("rule", "severity", "action").agg(
        F.count("*").alias("findings"), F.count_distinct("file").alias("files"),
        F.sum("verdict.usage.input_tokens").alias("input_tokens"))


@query
def baseline_document(spark, sf_dir):
    return baseline_entries(_results(spark, sf_dir))


@query
def deletions_per_file(spark, sf_dir):
    rows = _results(spark, sf_dir, "strict").where("action = 'delete'")
    return rows.groupBy("file").agg(F.count("*").alias("deletions"), F.min("line").alias("first_line"))


@query
def severity_bars(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return rows.select("doc_id", "i", scoring.severity_rank(col("severity")).alias("rank"),
                       scoring.bar(col("verdict.accuracy.pct")).alias("bar"))


def _report(name):
    def run(spark, sf_dir):
        return reports.render(name, _results(spark, sf_dir, "strict"), RUN_LABELS).body.select("file", "line", "ord", "text")
    return run


RUN_LABELS = {
    "tool": "marginalia", "version": "0", "rubric_version": 3, "backend": "scorer", "model": "latest", "mode": "check",
    "scope": "table", "base": "", "files": 0, "comments": 0, "cached": 0, "assessed": 0, "requests": 0, "suppressed": 0,
    "baselined": 0, "input_tokens": 0, "cost_usd": 0.0, "usage_unknown": False, "incomplete": False, "duration_ms": 0,
    "deleted_comments": 0, "error": 0, "warning": 0, "info": 0, "deleted": 0,
}
for _name in ("text", "json", "sarif", "github", "rdjson", "checkstyle"):
    QUERIES[f"report_{_name}"] = _report(_name)


@query
def sarif_rules(spark, sf_dir):
    return reports.sarif_rules(_results(spark, sf_dir, "strict"))


# --- requests --------------------------------------------------------------------------------

SMALL_CAP = 2000
SPLIT_CAP = 900


@query
def request_packing(spark, sf_dir):
    rows = batching.requests(A.findings(spark, sf_dir), load_rubric(), SMALL_CAP)
    return rows.select("req_id", "n_findings", "size_bytes", "est_tokens")


@query
def split_requests(spark, sf_dir):
    """Requests under a cap so low that blocks of documentation are split."""
    rows = batching.requests(A.findings(spark, sf_dir), load_rubric(), SPLIT_CAP)
    return rows.select("req_id", "n_findings", "size_bytes", "est_tokens")


@query
def token_total(spark, sf_dir):
    return batching.estimated_tokens(batching.requests(A.findings(spark, sf_dir), load_rubric()))


@query
def budget_cut(spark, sf_dir):
    rows = batching.requests(A.findings(spark, sf_dir), load_rubric()).select("req_id", "est_tokens")
    spent = batching.running_spend(rows, "req_id", "est_tokens")
    return spent.select("req_id", "spent_before", (col("spent_before") <= 1_000_000).alias("within"))


@query
def scored_verdicts(spark, sf_dir):
    scorer = RecordedScorer((Recorded("the", 0.5, 1.0, 0.1, 0.2, 0.9),), Recorded("", 2.5, 2.0, 0.05, 0.4, 0.5), 999)
    made = batching.verdicts(scorer.score(batching.requests(A.findings(spark, sf_dir), load_rubric())))
    return made.select("id", col("verdict.accuracy.pct").alias("accuracy_pct"), col("verdict.commented_out.prob").alias(
        "commented_out"), col("verdict.usage.input_tokens").alias("input_tokens"))


# --- source text -----------------------------------------------------------------------------


@query
def docblock_parts(spark, sf_dir):
    rows = A.docblocks(spark, sf_dir).withColumn("split", split_docblock(col("block")))
    return rows.select("doc_id", F.md5(col("split.block_text").cast("binary")).alias("marked_md5"), F.explode(
        "split.parts").alias("p")).select("doc_id", "marked_md5", "p.slot", F.md5(col("p.text").cast("binary")).alias(
            "text_md5"), "p.start", "p.end", "p.line")


def _extract(sources, **changes):
    settings = _settings(**changes)
    texts = extraction.code_sources(sources, settings.languages)
    return extraction.findings(extraction.parse(texts), settings, 3), texts


@query
def paired_comments(spark, sf_dir):
    rows, _ = _extract(A.sources(spark, sf_dir))
    return rows.select("file", "line", "column", "kind", "comment_text", "code_text", "id",
                       (col("comment.end") - col("comment.start")).alias("comment_bytes"))


@query
def merged_comments(spark, sf_dir):
    rows, _ = _extract(A.commented(spark, sf_dir))
    return rows.select("file", "line", "end_line", "code_text", F.md5(col("comment_text").cast("binary")).alias("comment_md5"))


@query
def comment_contexts(spark, sf_dir):
    rows, _ = _extract(A.sources(spark, sf_dir), context_lines=6)
    return rows.select("file", "line", "context")


@query
def file_status(spark, sf_dir):
    cut = A.sources(spark, sf_dir).withColumn("content", F.when(
        (col("doc_id") % 3 == 0) & ~col("file").endswith(".py"), F.substring(
            col("content"), F.lit(1), F.octet_length("content") - 3)).otherwise(col("content")))
    parsed = extraction.parse(extraction.code_sources(cut, _settings().languages))
    return parsed.select("file", "ok", F.when(col("ok"), F.size("found")).otherwise(0).alias("comments"))


@query
def markup_comments(spark, sf_dir):
    """Comments of script files whose markup holds whole documents, some lines of which look like comments."""
    def line(text, i):
        for sign, name in (("&", "&amp;"), ("{", "&#123;"), ("}", "&#125;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return F.concat(F.when(i % 5 == 2, "// ").when(i % 7 == 3, "/* ").otherwise(""), text, F.when(i % 3 == 0, " see http://x.example/").otherwise(""))

    number = col("doc_id").cast("string")
    lines = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    content = F.concat(F.lit("export const A = () => (\n  <p>"), lines, F.lit("</p>\n)\n// Keep "), number, F.lit(" in mind here\nconst b = 1\n"))
    rows = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), number, F.lit(".tsx")).alias("file"), F.encode(content, "UTF-8").alias("content"))
    return _extract(rows)[0].select("file", "line", "comment_text")


@query
def template_comments(spark, sf_dir):
    """Comments inside template substitutions, one deeper in each line of a document."""
    def line(text, i):
        return F.concat(F.lit("`"), F.regexp_replace(text, r"[`\\\\$]", "."), F.lit(" ${ // Line "), i.cast("string"), F.lit("\n"))

    lines = F.split("text", "\n", -1)
    content = F.concat(F.lit("const t = "), F.array_join(F.transform(lines, line), ""), F.lit("x"), F.repeat(F.lit("}`"), F.size(lines)), F.lit(";\n"))
    rows = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("t"), col("doc_id").cast("string"), F.lit(".ts")).alias("file"), F.encode(content, "UTF-8").alias("content"))
    return _extract(rows)[0].select("file", "line", "comment_text", "kind", F.md5(F.col("code_text").cast("binary")).alias("code_md5"))


@query
def nested_comments(spark, sf_dir):
    """Comments in blocks up to five deep."""
    return _extract(A.nested(spark, sf_dir))[0].select("file", "line", "column", "kind", "comment_text", "code_text")


@query
def duplicate_paths(spark, sf_dir):
    """A corpus in which paths repeat, with equal and with different contents."""
    rows = A.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("p"), (col("doc_id") % 300).cast("string"), F.lit(".go")).alias("file"), F.encode("text", "UTF-8").alias("content"))
    return scan_table(rows).select("file", F.sha2("content", 256).alias("digest"))


def _planned(spark, sf_dir):
    rows, texts = _extract(A.sources(spark, sf_dir))
    doomed = rows.withColumn("action", F.when(col("kind") == "trailing", "delete").otherwise("keep"))
    return edits.plan_edits(doomed, texts)


@query
def edited_files(spark, sf_dir):
    rows = edits.guard(_planned(spark, sf_dir))
    return rows.select("file", "ok", "deleted", F.md5("edited").alias("edited_md5"))


@query
def file_diffs(spark, sf_dir):
    rows = edits.unified_diff(_planned(spark, sf_dir))
    return rows.select("file", F.md5(col("diff").cast("binary")).alias("diff_md5"))


@query
def sparse_diffs(spark, sf_dir):
    """Diffs of several hunks a file: some comments go from the end of their line, others with their whole line."""
    rows, texts = _extract(A.sources(spark, sf_dir))
    first = F.when(col("file").endswith(".go"), 4).when(col("file").endswith(".php"), 3).otherwise(2)
    place = (col("line") - first) % 16
    doomed = rows.withColumn("action", F.when(((col("kind") == "trailing") & (place == 2)) | ((col("kind") == "inline") & (place == 8)), "delete").otherwise("keep"))
    return edits.diff_lines(edits.plan_edits(doomed, texts))
