"""Command line: check, fix, baseline, cache stats|clear, version."""

from __future__ import annotations

import argparse
import os
import sys

from marginalia import __version__
from marginalia import constants as C
from marginalia import settings as S
from marginalia.functions.scoring import fail_on_rank
from marginalia.plans.reports import REPORTERS
from marginalia.plans.run import BudgetError, Options, run
from marginalia.session import session
from marginalia.sources.verdict_cache import VerdictCache


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marginalia", description="Find inaccurate and useless source comments")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("check", "fix", "baseline"):
        p = verbs.add_parser(verb)
        p.add_argument("paths", nargs="*")
        p.add_argument("--config", default="")
        p.add_argument("--staged", action="store_true")
        p.add_argument("--changed", action="store_true")
        p.add_argument("--base", default="")
        p.add_argument("--baseline", default="")
        p.add_argument("--format", default="text", choices=tuple(REPORTERS))
        p.add_argument("--fail-on", default="error")
        p.add_argument("--profile")
        p.add_argument("--min-confidence", type=float)
        p.add_argument("--budget", type=float, default=C.BUDGET_CENTS)
        p.add_argument("--concurrency", type=int, default=C.CONCURRENCY)
        p.add_argument("--no-cache", action="store_true")
        p.add_argument("--no-dotenv", action="store_true")
        p.add_argument("--soft-fail", action="store_true")
        p.add_argument("-o", "--output", default="")
        if verb == "fix":
            p.add_argument("--diff", action="store_true")
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--delete-threshold", type=int)
            p.add_argument("--allow-ci-write", action="store_true")
    p = verbs.add_parser("cache")
    p.add_argument("action", choices=("stats", "clear"))
    p.add_argument("--config", default="")
    verbs.add_parser("version")
    return top


def main(argv: list[str] | None = None, scorer=None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.verb == "version":
            print(f"marginalia {__version__}\nrubric {S.load_rubric().version}\nlanguages {', '.join(sorted(C.LANGUAGES))}")
            return C.EXIT_OK
        spark = session()
        if args.verb == "cache":
            path = args.config or S.find(os.getcwd())
            cache = VerdictCache(spark, (S.load(path) if path else S.Settings()).cache_dir)
            if args.action == "stats":
                print(f"{cache.stats()} cached verdicts")
            else:
                cache.clear()
            return C.EXIT_OK
        return _run(spark, args, scorer)
    except BudgetError as error:
        print(f"marginalia: {error}", file=sys.stderr)
        return C.EXIT_BUDGET
    except Exception as error:  # noqa: BLE001 - every other failure is a tool error
        print(f"marginalia: {error}", file=sys.stderr)
        return C.EXIT_TOOL_ERROR


def _run(spark, args, scorer) -> int:
    report = run(spark, Options(
        mode=args.verb, paths=tuple(args.paths), staged=args.staged, changed=args.changed, base=args.base,
        config_path=args.config, profile=args.profile, baseline_path=args.baseline, min_confidence=args.min_confidence,
        delete_threshold=getattr(args, "delete_threshold", None), budget_cents=args.budget, concurrency=args.concurrency,
        no_cache=args.no_cache, no_dotenv=args.no_dotenv, soft_fail=args.soft_fail, diff=getattr(args, "diff", False),
        dry_run=getattr(args, "dry_run", False), allow_ci_write=getattr(args, "allow_ci_write", False), scorer=scorer))
    if report.soft_failed:
        print(f"marginalia: soft-failed: {report.soft_failed}", file=sys.stderr)
        return C.EXIT_OK
    if args.output and args.output.endswith("/") and args.verb == "check":
        report.save(args.output, args.format)  # a folder: written in parallel, as ordered text parts
        if report.stopped is not None:
            raise report.stopped
        threshold = fail_on_rank(args.fail_on)
        return C.EXIT_FINDINGS if threshold and report.run["worst"] >= threshold else C.EXIT_OK
    out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout
    try:
        if args.verb == "fix" and (args.diff or args.dry_run):
            for row in report.fixes.where("error is not null").orderBy("file").toLocalIterator():
                out.write(f"{row['error']}\n")
            if args.diff:
                for row in report.diffs.orderBy("file").toLocalIterator():
                    out.write(row["diff"])
            else:
                for row in report.fixes.where("error is null").orderBy("file").toLocalIterator():
                    out.write(f"{row['file']}: {row['deleted']} deletions planned\n")
        if args.verb != "baseline" or report.stopped is not None:
            report.write(out, args.format, color=not args.output and sys.stdout.isatty() and not os.environ.get("NO_COLOR"))
    finally:
        if args.output:
            out.close()
    if report.stopped is not None:
        raise report.stopped
    if args.verb == "fix" and report.run["deleted_comments"]:
        return C.EXIT_FINDINGS
    threshold = fail_on_rank(args.fail_on)
    return C.EXIT_FINDINGS if threshold and report.run["worst"] >= threshold else C.EXIT_OK


if __name__ == "__main__":
    sys.exit(main())
