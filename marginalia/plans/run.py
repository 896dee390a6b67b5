"""The pipeline: scope, extract, filter, assess, classify, then report, fix or baseline."""

from __future__ import annotations

import os
import sys
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import __version__
from marginalia import constants as C
from marginalia import settings as S
from marginalia.functions.identity import cache_salt
from marginalia.operators import batching, edits
from marginalia.operators.extraction import code_sources, extract, parse
from marginalia.operators.filtering import filter_counts, with_disposition
from marginalia.operators.lookup import spread_join
from marginalia.operators.policy import classify
from marginalia.operators.ranges import in_scope
from marginalia.operators.summary import summary
from marginalia.plans.durable import durable
from marginalia.plans.reports import render
from marginalia.schemas import VERDICT
from marginalia.scorers import Scorer
from marginalia.scorers.http import HttpScorer, TransportError
from marginalia.sources import files as source_files
from marginalia.sources.baseline import FILE_NAME, read_baseline, write_baseline
from marginalia.sources.verdict_cache import VerdictCache, look_up

PAID_WAVES = 16  # a paid run checks what it spent this often


class BudgetError(RuntimeError):
    """The run would cost, or has cost, more than its budget."""


class NoApiKeyError(RuntimeError):
    """Something has to be scored and there is no key to do it with."""


class CiWriteError(RuntimeError):
    """Files would be edited in a CI job."""


@dataclass(frozen=True)
class Options:
    """One run. ``sources`` replaces paths by a table of ``(file, content)``."""

    mode: str = "check"
    paths: tuple[str, ...] = ()
    staged: bool = False
    changed: bool = False
    base: str = ""
    sources: DataFrame | None = None
    ranges: DataFrame | None = None
    settings: S.Settings | None = None
    config_path: str = ""
    profile: str | None = None
    baseline_path: str = ""
    min_confidence: float | None = None
    delete_threshold: int | None = None
    budget_cents: float = 0.0
    concurrency: int = C.CONCURRENCY
    no_cache: bool = False
    no_dotenv: bool = False
    soft_fail: bool = False
    diff: bool = False
    dry_run: bool = False
    allow_ci_write: bool = False
    scorer: Scorer | None = None
    now: float | None = None


@dataclass
class Report:
    """What a run found. ``results`` and ``fixes`` are frames; ``run`` holds counters and labels."""

    results: DataFrame | None
    run: dict
    fixes: DataFrame | None = None
    status: DataFrame | None = None
    stopped: Exception | None = None
    soft_failed: str = ""
    diffs: DataFrame | None = field(default=None, repr=False)

    def save(self, path: str, format_: str = "text") -> None:
        """The report as ordered text parts in a folder, written by the tasks."""
        if self.results is not None:
            render(format_, self.results, self.run).save(path)

    def write(self, out, format_: str = "text", color: bool = False) -> None:
        if self.results is not None:
            render(format_, self.results, self.run, color).write(out)


def load_settings(options: Options) -> S.Settings:
    if options.settings is not None:
        return options.settings
    path = options.config_path or S.find(os.getcwd())
    return S.load(path) if path else S.Settings()


def scope(spark: SparkSession, options: Options, settings: S.Settings):
    """``(sources, ranges, mode, base)`` of what is in play."""
    if options.sources is not None:
        return source_files.scan_table(options.sources, settings.ignore), options.ranges, "table", ""
    if options.staged:
        found, ranges = source_files.scan_git(spark, staged=True, ignore=settings.ignore)
        return source_files.read_sources(found), ranges, "staged", ""
    if options.changed:
        base = source_files.resolve_base(options.base)
        found, ranges = source_files.scan_git(spark, base=base, ignore=settings.ignore)
        return source_files.read_sources(found), ranges, "changed", base
    found = source_files.scan_paths(spark, options.paths, settings.ignore)
    return source_files.read_sources(found), options.ranges, "paths", ""


def baseline_path(options: Options) -> str:
    """The baseline to read or write; an explicit one is never skipped, wherever it lies."""
    if options.baseline_path or options.mode == "baseline":
        return options.baseline_path or FILE_NAME
    return FILE_NAME if os.path.exists(FILE_NAME) else ""


def _scorer(options: Options, settings: S.Settings, rubric: S.Rubric, api_key: str) -> Scorer:
    if options.scorer is not None:
        return options.scorer
    if not api_key:
        raise NoApiKeyError(f"no API key: set {settings.api_key_env}")
    if not settings.endpoint:
        raise S.ConfigError("scorer.endpoint is not set")
    return HttpScorer(settings.endpoint, api_key, settings.model, rubric, settings.timeout_seconds, options.concurrency)


def assess(planned: DataFrame, scorer: Scorer, budget_usd: float, on_scored) -> tuple[DataFrame | None, bool]:
    """Scored requests, and whether the budget stopped the run short.

    A paid scorer is asked in waves dealt by the request's digest; every wave is written before
    the next, and none starts once the budget is spent. Other scorers answer at once and the
    running total decides which requests count: the order is the digest's, so the cut repeats.
    """
    tokens = F.floor(F.col("input_tokens") / F.col("n_findings"))
    charge = (tokens * F.col("n_findings")).cast("double") * F.lit(C.USD_PER_INPUT_TOKEN)
    waves = PAID_WAVES if scorer.paid and budget_usd > 0 else 1
    digit = F.conv(F.substring(F.md5(F.col("req_id").cast("binary")), 1, 4), 16, 10).cast("int")
    done, spent = None, 0.0
    for wave in range(waves):
        batch = planned if waves == 1 else planned.where(F.pmod(digit, F.lit(waves)) == wave)
        scored = durable(scorer.score(batch).withColumn("charge", charge))
        spent += scored.agg(F.coalesce(F.sum("charge"), F.lit(0.0))).first()[0]
        over = budget_usd > 0 and spent > budget_usd
        if over and not scorer.paid:
            scored = batching.running_spend(scored, "req_id", "charge").where(F.col("spent_before") <= budget_usd).drop(
                "spent_before")
        on_scored(scored)
        done = scored if done is None else done.unionByName(scored)
        if over:
            return done, True
    return done, False


def run(spark: SparkSession, options: Options) -> Report:
    """Execute the pipeline once. Findings are in the report; an exception is a tool error."""
    started = time.monotonic()
    if not options.no_dotenv:
        S.load_dotenv()
    writes = options.mode == "fix" and not (options.diff or options.dry_run)
    if writes and S.in_ci() and not options.allow_ci_write:
        raise CiWriteError("a CI job may not edit files: report with check --format sarif, or allow it with --allow-ci-write")
    settings = load_settings(options).resolve(
        profile=options.profile, min_confidence=options.min_confidence, delete_threshold=options.delete_threshold)
    rubric = S.load_rubric(settings.rubric)
    now = F.lit(options.now if options.now is not None else time.time())

    sources, ranges, scope_mode, base = scope(spark, options, settings)
    texts = code_sources(sources, settings.languages)
    if options.mode == "fix":
        texts = durable(texts)  # edits are planned on, and compared with, the very bytes that were scored
    everything = durable(extract(parse(texts), settings, rubric.version))
    status = everything.select("file", "ok", "error").distinct()
    for row in status.where("not ok").orderBy("file").toLocalIterator():
        print(f"{settings.tool}: not parsed: {row['file']}: {row['error']}", file=sys.stderr)
    found = everything.where("kind is not null").drop("ok", "error")
    files = found.agg(F.count_distinct("file")).first()[0]
    if ranges is not None:
        found = in_scope(found, ranges)

    known = None
    path = baseline_path(options)
    if path and options.mode != "baseline":
        try:
            known = read_baseline(spark, path)
        except AnalysisException as error:
            raise S.ConfigError(f"baseline {path} cannot be read") from error
    judged = durable(with_disposition(found, settings, known))
    counts = filter_counts(judged).first()
    kept = judged.where("disposition = 'kept'").drop("disposition", "ignore_next")

    api_key = os.environ.get(settings.api_key_env, "")
    salt = cache_salt(api_key)
    local = spark.sparkContext.master.startswith("local[")
    if not (options.no_cache or local) and settings.cache_dir == S.default_cache_dir() and not os.environ.get("MARGINALIA_CACHE_DIR"):
        raise S.ConfigError("set the cache folder to one that all executors share, or run without a cache")
    cache = None if options.no_cache else VerdictCache(spark, settings.cache_dir)
    if cache is None:
        kept = kept.withColumn("cached", F.lit(None).cast(VERDICT))
    else:
        kept = durable(look_up(kept, cache.read(), salt, settings.cache_ttl_seconds, now).withColumnRenamed(
            "verdict", "cached"))
    pending = kept.where("cached is null")

    info = {
        "mode": options.mode, "scope": scope_mode, "base": base, "files": files,
        "comments": sum(counts[name] for name in ("exempt", "suppressed", "baselined", "kept")),
        "suppressed": counts["suppressed"], "baselined": counts["baselined"], "exempt": counts["exempt"],
        "cached": kept.where("cached is not null").count(), "assessed": 0, "requests": 0, "input_tokens": 0,
        "cost_usd": 0.0, "usage_unknown": False, "incomplete": False, "deleted_comments": 0, "tool": settings.tool,
        "version": __version__, "rubric_version": rubric.version, "model": settings.model, "backend": "scorer",
        "error": 0, "warning": 0, "info": 0, "deleted": 0, "worst": 0, "duration_ms": 0,
    }

    fresh, stopped = None, None
    planned = batching.requests(pending, rubric)
    if counts["kept"] > info["cached"]:
        scorer = _scorer(options, settings, rubric, api_key)
        planned = durable(planned)
        cents = batching.estimated_tokens(planned).first()[0] * C.USD_PER_INPUT_TOKEN * 100
        if options.budget_cents > 0 and cents > options.budget_cents:
            raise BudgetError(f"over budget: this run would cost some {cents:.2f}¢ of {options.budget_cents:.2f}¢")

        def store(scored: DataFrame) -> None:
            if cache is not None:
                cache.put(batching.verdicts(scored), salt, now)

        try:
            scored, over = assess(planned, scorer, options.budget_cents / 100, store)
        except Exception as error:
            if options.soft_fail and (isinstance(error, TransportError) or TransportError.__name__ in str(error)):
                said = [line.strip() for line in str(error).splitlines() if TransportError.__name__ in line]
                return Report(None, {**info, "incomplete": True}, soft_failed=said[-1] if said else str(error))
            raise
        if over:
            stopped = BudgetError(f"over budget: stopped once {options.budget_cents:.2f}¢ were spent")
        totals = scored.agg(F.coalesce(F.sum("n_findings"), F.lit(0)), F.count("*")).first()
        info |= {"assessed": totals[0], "requests": totals[1], "incomplete": over}
        fresh = durable(batching.verdicts(scored))

    if fresh is None:
        joined = kept.withColumn("fresh", F.lit(None).cast(VERDICT))
    else:
        joined = spread_join(kept, fresh.withColumnRenamed("verdict", "fresh"), "id", ("file", "ord"))
    scored_rows = joined.withColumn("verdict", F.coalesce("cached", "fresh")).where("verdict is not null")
    results = durable(classify(scored_rows, settings).withColumn(
        "is_fresh", F.col("cached").isNull()).drop("cached", "fresh"))

    totals = summary(results).first().asDict()
    bill = results.agg(
        F.coalesce(F.sum(F.when(F.col("is_fresh"), F.col("verdict.usage.input_tokens"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("is_fresh"), F.col("verdict.usage.cost_usd"))), F.lit(0.0)),
        F.max_by(F.when(F.col("verdict.model") != "", F.col("verdict.model")), F.struct("file", "ord")),
    ).first()
    info |= {**totals, "input_tokens": bill[0], "cost_usd": bill[1], "model": bill[2] or settings.model}
    info["usage_unknown"] = info["assessed"] > 0 and info["input_tokens"] == 0

    report = Report(results, info, status=status, stopped=stopped)
    # what was paid for is reported, but nothing is edited or baselined from part of a run
    if stopped is None and options.mode == "fix":
        guarded = durable(edits.guard(edits.plan_edits(results, texts)))
        report.diffs = edits.unified_diff(guarded.where("ok")) if options.diff else None
        report.fixes = guarded.select("file", "deleted", "error")
        if writes:
            written = durable(edits.write_edits(guarded)).withColumnRenamed("error", "failure")
            report.fixes = report.fixes.join(written, "file", "left").select(
                "file", "deleted", F.coalesce("error", F.when(F.col("failure") != "", F.col("failure"))).alias("error"))
        info["deleted_comments"] = guarded.agg(F.coalesce(F.sum("deleted"), F.lit(0))).first()[0]
    if stopped is None and options.mode == "baseline":
        write_baseline(results, path)
    info["duration_ms"] = int((time.monotonic() - started) * 1000)
    return report
