"""Report sinks: every format is a column over results, framed by a few fixed lines."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.paths import slashed
from marginalia.functions.scoring import bar, message, rule_description
from marginalia.functions.text import snippet
from marginalia.operators.summary import report_order, reportable

col = F.col
ORDER = ("file", "line", "ord")


@dataclass(frozen=True)
class Rendered:
    """A report: ``head``, the ordered ``text`` rows of ``body`` joined by ``separator``, ``tail``."""

    head: str
    body: DataFrame | None
    separator: str
    tail: str

    def write(self, out: TextIO) -> None:
        """Stream to a local file; rows arrive partition by partition, never all at once."""
        out.write(self.head)
        if self.body is not None:
            first = True
            for row in report_order(self.body).select("text").toLocalIterator():
                out.write(("" if first else self.separator) + row["text"])
                first = False
        out.write(self.tail)

    def save(self, path: str) -> None:
        """Write in parallel as ordered text parts, which joined end to end are the report."""
        spark = self.body.sparkSession
        keyed = self.body.select(F.lit(1).alias("part"), *ORDER, F.regexp_replace("text", r"\n\z", "").alias("text"))
        first = keyed.agg(F.min(F.struct(*ORDER))).scalar()
        glue = F.when(F.struct(*ORDER) == first, F.lit("")).otherwise(F.lit(self.separator.strip()))
        rows = keyed.withColumn("text", F.concat(glue, "text"))
        frame = [(k, "", 0, 0, text.strip("\n")) for k, text in ((0, self.head), (2, self.tail)) if text]
        framed = spark.createDataFrame(frame, "part int, file string, line int, ord bigint, text string")
        rows.unionByName(framed).orderBy("part", *ORDER).select("text").write.mode("overwrite").text(path)


def _axis(name: str) -> dict[str, Column]:
    axis = col("verdict")[name]
    return {key: axis[key] for key in ("pct", "label", "confidence")}


def _message() -> Column:
    v = col("verdict")
    return message(col("rule"), v["accuracy"]["pct"], v["usefulness"]["pct"], v["commented_out"]["prob"],
                   col("comment_text"))


def _struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _body(results: DataFrame, text: Column) -> DataFrame:
    return reportable(results).select(*ORDER, text.alias("text"))


def _document(frame: dict, slot: str, *, indent: int) -> tuple[str, str]:
    """A JSON document cut where its list of rows belongs."""
    text = json.dumps(frame, indent=2, ensure_ascii=False)
    head, tail = text.split(f'"{slot}"')
    return head + "[\n", "\n" + " " * indent + "]" + tail + "\n"


def render_text(results: DataFrame, run: dict, color: bool = False) -> Rendered:
    v = col("verdict")
    severity = F.upper("severity")
    if color:
        paint = F.when(col("severity") == "error", "\x1b[31m").when(col("severity") == "warning", "\x1b[33m").otherwise("\x1b[36m")
        severity = F.concat(paint, severity, F.lit("\x1b[0m"))
    disabled = F.round(F.lit(100.0) * v["commented_out"]["prob"]).cast("int")
    graded = F.concat(*[
        F.format_string(f"    {name:<10} %s %3d%%  %s\n", bar(v[name]["pct"]), v[name]["pct"], v[name]["label"])
        for name in ("accuracy", "usefulness")])
    numbers = F.when(col("rule") == "commented-out-code", F.format_string(
        "    disabled   %s %3d%%  probability the comment is commented-out code\n", bar(disabled), disabled)).otherwise(graded)
    text = F.concat(
        F.format_string("%s:%d:%d: ", "file", "line", "column"), severity, F.lit(" "),
        F.when(col("action") == "delete", "delete").otherwise("flag"), F.lit(" ["), col("rule"), F.lit("]\n"), numbers,
        F.lit("    comment    "), snippet(col("comment_text"), 100), F.lit("\n    code       "),
        snippet(col("code_text"), 100), F.lit("\n\n"))
    lines = [f"{run['comments']} comments in {run['files']} files: {run['error']} error, {run['warning']} warning, "
             f"{run['info']} info" + (f", {run['deleted_comments']} deleted" if run["deleted_comments"] else ""),
             f"{run['cached']} cached, {run['assessed']} assessed in {run['requests']} request(s), "
             f"{run['suppressed']} suppressed, {run['baselined']} baselined",
             "cost unknown: the API reported no token usage" if run["usage_unknown"] else
             f"cost ${run['cost_usd']:.5f} ({run['input_tokens']} input tokens), {run['duration_ms']}ms"]
    if run["incomplete"]:
        lines.append("results are incomplete: the run stopped early")
    return Rendered("", _body(results, text), "", "\n".join(lines) + "\n")


def render_json(results: DataFrame, run: dict) -> Rendered:
    v = col("verdict")
    row = F.to_json(_struct(
        id=col("id"), file=col("file"), line=col("line"), column=col("column"), span=col("comment"), kind=col("kind"),
        rule=col("rule"), severity=col("severity"), action=col("action"), accuracy=_struct(**_axis("accuracy")),
        usefulness=_struct(**_axis("usefulness")), overreach=v["overreach"], commented_out=v["commented_out"],
        comment=snippet(col("comment_text"), 200), code=snippet(col("code_text"), 200)))
    names = ("mode", "scope", "base", "files", "comments", "cached", "assessed", "requests", "suppressed", "baselined",
             "input_tokens", "cost_usd")
    shown = {name: run[name] for name in names if name != "base" or run["base"]}
    shown |= {"cost_known": not run["usage_unknown"], "duration_ms": run["duration_ms"]}
    shown |= {"incomplete": True} if run["incomplete"] else {}
    head, tail = _document({
        "schema_version": C.JSON_SCHEMA_VERSION,
        "tool": {"name": run["tool"], "version": run["version"], "rubric_version": run["rubric_version"]},
        "backend": {"name": run["backend"], "model": run["model"]}, "run": shown, "results": "@rows@",
        "summary": {name: run[name] for name in ("deleted", "error", "info", "warning")},
    }, "@rows@", indent=2)
    return Rendered(head, _body(results, F.concat(F.lit("    "), row)), ",\n", tail)


def sarif_rules(results: DataFrame) -> DataFrame:
    """``(rule, level, description)`` of every rule that is reported; the last row's severity counts."""
    found = reportable(results).groupBy("rule").agg(F.max_by("severity", F.struct(*ORDER)).alias("severity"))
    level = F.when(col("severity") == "info", "note").otherwise(col("severity"))
    return found.select("rule", level.alias("level"), rule_description(col("rule")).alias("description"))


def render_sarif(results: DataFrame, run: dict) -> Rendered:
    level = F.when(col("severity") == "info", "note").otherwise(col("severity"))
    region = _struct(startLine=col("line"), startColumn=col("column"), byteOffset=col("comment.start"),
                     byteLength=col("comment.end") - col("comment.start"))
    artifact = _struct(uri=slashed(col("file")))
    fix = F.array(_struct(
        description=_struct(text=F.lit("Delete the comment")),
        artifactChanges=F.array(_struct(artifactLocation=artifact, replacements=F.array(_struct(deletedRegion=region))))))
    row = F.to_json(_struct(
        ruleId=col("rule"), level=level, message=_struct(text=_message()),
        locations=F.array(_struct(physicalLocation=_struct(artifactLocation=artifact, region=region))),
        fixes=F.when(col("action") == "delete", fix)))
    # one row per rule id, of which there are eight
    rules = [{"id": r["rule"], "shortDescription": {"text": r["description"]}, "defaultConfiguration": {"level": r["level"]}}
             for r in sarif_rules(results).orderBy("rule").collect()]
    head, tail = _document({
        "$schema": C.SARIF_SCHEMA, "version": C.SARIF_VERSION,
        "runs": [{"tool": {"driver": {"name": run["tool"], "version": run["version"], "rules": rules}}, "results": "@rows@"}],
    }, "@rows@", indent=6)
    return Rendered(head, _body(results, F.concat(F.lit("        "), row)), ",\n", tail)


def render_github(results: DataFrame, run: dict) -> Rendered:
    level = F.when(col("severity").isin("error", "warning"), col("severity")).otherwise("notice")
    text = F.concat(F.format_string("::%s file=%s,line=%d,col=%d,title=%s::", level, slashed(col("file")), "line", "column",
                                    "rule"), _message(), F.lit("\n"))
    return Rendered("", _body(results, text), "", "")


def render_rdjson(results: DataFrame, run: dict) -> Rendered:
    place = _struct(line=col("line"), column=col("column"))
    span = _struct(start=place, end=place)
    row = F.to_json(_struct(
        message=_message(), location=_struct(path=slashed(col("file")), range=span), severity=F.upper("severity"),
        code=_struct(value=col("rule")),
        suggestions=F.when(col("action") == "delete", F.array(_struct(range=span, text=F.lit(""))))))
    head, tail = _document({"source": {"name": run["tool"]}, "severity": "WARNING", "diagnostics": "@rows@"},
                           "@rows@", indent=2)
    return Rendered(head, _body(results, F.concat(F.lit("    "), row)), ",\n", tail)


def _xml(text: Column) -> Column:
    # fixed values: what an attribute may not hold, and how it is written
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"),
                         ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def render_checkstyle(results: DataFrame, run: dict) -> Rendered:
    path = slashed(col("file"))
    error = F.format_string('    <error line="%d" column="%d" severity="%s" message="%s" source="%s"></error>\n', "line",
                            "column", "severity", _xml(_message()), F.concat(F.lit(run["tool"] + "."), "rule"))
    # a file's element opens before its first row and closes after its last
    in_file = Window.partitionBy("file").orderBy("line", "ord")
    opens, closes = F.lag("ord").over(in_file).isNull(), F.lead("ord").over(in_file).isNull()
    text = F.concat(F.when(opens, F.concat(F.lit('  <file name="'), _xml(path), F.lit('">\n'))).otherwise(""), error,
                    F.when(closes, F.lit("  </file>\n")).otherwise(""))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<checkstyle version="{C.CHECKSTYLE_VERSION}">\n'
    return Rendered(head, _body(results, text), "", "</checkstyle>\n")


REPORTERS: dict[str, Callable[..., Rendered]] = {
    "text": render_text, "json": render_json, "sarif": render_sarif, "github": render_github, "rdjson": render_rdjson,
    "checkstyle": render_checkstyle,
}


def render(format_: str, results: DataFrame, run: dict, color: bool = False) -> Rendered:
    """The report in a named format; an unknown name is an error."""
    if format_ not in REPORTERS:
        raise ValueError(f"unknown format {format_!r}, want {', '.join(REPORTERS)}")
    return render_text(results, run, color) if format_ == "text" else REPORTERS[format_](results, run)
