"""Source files: which are in play, and their bytes."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.constants import SKIP_DIRS
from marginalia.functions.paths import glob_to_regex, matches_any
from marginalia.operators.ranges import parse_hunks
from marginalia.plans.durable import durable
from marginalia.schemas import RANGES, SOURCES

PATHS_PER_TASK = 256


class ScopeError(RuntimeError):
    """The files to look at cannot be determined."""


def walk(paths) -> Iterator[str]:
    """Files under the given paths, names only (S1); a corpus too large for one walk comes as a table."""
    for given in paths or (".",):
        root = given.removesuffix("/...") or "."
        if not os.path.exists(root):
            raise ScopeError(f"no such file or directory: {root}")
        if not os.path.isdir(root):
            yield os.path.normpath(root)
            continue
        for folder, folders, names in os.walk(root):
            folders[:] = [name for name in folders if name not in SKIP_DIRS]
            yield from (os.path.normpath(os.path.join(folder, name)) for name in names)


def scan_paths(spark: SparkSession, paths=(), ignore=()) -> DataFrame:
    """``(file)`` under the paths, without ignored ones and each once (S1, F0, U1); results are ordered where they are reported."""
    skip = re.compile("|".join(f"(?:{glob_to_regex(p)})" for p in ignore)) if ignore else None
    names = [(path,) for path in walk(paths) if not (skip and skip.search(path.replace("\\", "/").removeprefix("./")))]
    parts = max(1, -(-len(names) // PATHS_PER_TASK))
    found = spark.createDataFrame(names, "file string").repartition(parts)
    return found.dropDuplicates(["file"])


def scan_table(table: DataFrame, ignore=()) -> DataFrame:
    """A table of ``(file, content)`` as the corpus: the form a large cluster reads.

    A column ``repo`` keeps equal paths of different repositories apart: it leads the path. Rows that are
    equal in path and content count once. Different contents under one path are all kept, each under a folder
    named by its digest. Only paths that occur twice are looked at again; without any, the table is
    read as it is and no content is shuffled.
    """
    if "repo" in table.columns:
        table = table.withColumn("file", F.concat_ws("/", "repo", "file"))
    rows = table.where(~matches_any(F.col("file"), ignore)).select("file", "content").withColumn("digest", F.sha2("content", 256))
    per_file = rows.groupBy("file", "digest").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("contents"))
    again = durable(per_file.where("rows > 1"))
    if again.isEmpty():
        return rows.select("file", "content")
    marked = rows.join(again, "file", "left")
    twice = marked.where("rows > 1").dropDuplicates(["file", "digest"])
    named = F.when(F.col("contents") > 1, F.concat(F.lit("#"), F.substring("digest", 1, 12), F.lit("/"), "file")).otherwise(F.col("file"))
    return marked.where("rows is null").select("file", "content").unionByName(twice.select(named.alias("file"), "content"))


def read_sources(files: DataFrame) -> DataFrame:
    """Whole-file bytes, read where the tasks run; an unreadable file fails the run."""
    root = os.getcwd()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                with open(os.path.join(root, name), "rb") as source:
                    yield pd.DataFrame({"file": [name], "content": [source.read()]})

    return files.select("file").mapInPandas(read, SOURCES)


def git(*args: str) -> str:
    done = subprocess.run(("git", *args), capture_output=True, check=False)
    if done.returncode:
        raise ScopeError(f"git {' '.join(args)} ended with {done.returncode}")
    return done.stdout.decode("utf-8", errors="surrogateescape")


def resolve_base(explicit: str = "", run=git) -> str:
    """The ref changes are compared with: given, remote default, upstream, configured, main, master."""
    def attempt(*args):
        try:
            return run(*args).strip()
        except ScopeError:
            return ""

    configured = attempt("config", "--get", "init.defaultBranch")
    candidates = (
        lambda: explicit,
        lambda: attempt("symbolic-ref", "refs/remotes/origin/HEAD").removeprefix("refs/remotes/"),
        lambda: attempt("rev-parse", "--abbrev-ref", "--symbolic-full-name", "@{upstream}"),
        lambda: configured if configured and attempt("rev-parse", "--verify", configured) else "",
        *(lambda name=name: name if attempt("rev-parse", "--verify", name) else "" for name in ("main", "master")),
    )
    for candidate in candidates:
        if found := candidate():
            return found
    raise ScopeError("cannot tell which ref to compare with: name one with --base")


def scan_git(spark: SparkSession, *, staged: bool = False, base: str = "", ignore=()) -> tuple[DataFrame, DataFrame]:
    """Changed ``(file)`` and ``(file, start, end)`` of git's staged or branch changes.

    The files are read from the working tree; one whose hunks only delete lines has no ranges
    and counts as a whole.
    """
    target = ("--cached",) if staged else (f"{base}...HEAD",)
    names = git("diff", "--name-only", "--diff-filter=ACMR", *target).splitlines()
    diff = git("diff", "-U0", "--diff-filter=ACMR", *target)
    kept = [(name.strip(),) for name in names if name.strip() and os.path.isfile(name.strip())]
    files = spark.createDataFrame(kept, "file string").where(~matches_any(F.col("file"), ignore)).dropDuplicates(["file"])
    heads = [(0, i, line) for i, line in enumerate(diff.split("\n")) if line.startswith(("+++ b/", "@@"))]
    if not heads:
        return files, spark.createDataFrame([], RANGES)
    lines = spark.createDataFrame(heads, "diff int, line_no int, text string")
    return files, parse_hunks(lines).select("file", "start", "end")
