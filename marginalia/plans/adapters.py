"""The driver tables as pipeline relations.

The tables hold prose, not code, so these views declare how a document reads as comments,
verdicts, ranges or source text. They only use whole tables and built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.scoring import legend_label, to_axis

col = F.col
EXTENSIONS = ("go", "ts", "jsx", "php", "py", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, words) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def file_of(doc_id: Column) -> Column:
    return F.concat(F.lit("src/d"), (doc_id % 97).cast("string"), F.lit("/f"), doc_id.cast("string"), F.lit("."),
                    pick(doc_id, EXTENSIONS))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, i, text)``: every line of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).withColumn("i", col("i").cast("bigint"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding per document line; markers, kind, block and flags follow from its numbers.

    The code of a line is the line below it. Eight lines share a block where their kind is doc or
    annotation; a block's annotations are its slots.
    """
    rows = lines(spark, sf_dir)
    in_doc = Window.partitionBy("doc_id").orderBy("i")
    below = F.lead("text", 1, "").over(in_doc)
    kind = pick(col("doc_id") + col("i"), C.KINDS)
    text = col("text")
    n = col("doc_id") + col("i")
    # some lines are marked for later, some are ignored, some ignore what is below them
    text = F.concat(F.when(n % 19 == 0, "TODO ").otherwise(""), text, F.when(
        n % 23 == 0, " marginalia:ignore").when(n % 29 == 0, " marginalia:ignore-next").otherwise(""))
    comment = (
        F.when(kind == "doc", F.concat(F.lit("/** "), text, F.lit("\n */")))
        .when(kind == "inline", F.concat(F.lit("// "), text)).when(kind == "trailing", F.concat(F.lit("# "), text))
        .otherwise(F.concat(F.lit("@param "), text)))
    blocked = kind.isin("doc", "annotation")
    rows = rows.withColumns({"kind": kind, "comment_text": comment, "code_text": below, "file": file_of(col("doc_id"))})
    return rows.select(
        "doc_id", "i", "file", "kind", "comment_text", "code_text", F.lit("").alias("context"),
        F.struct(F.lit(0).alias("start"), F.octet_length("comment_text").alias("end")).alias("comment"),
        (col("i") + 1).cast("int").alias("line"), F.lit(1).alias("column"), col("i").alias("ord"),
        F.when(blocked, F.concat_ws(":", "file", F.floor(col("i") / 8).cast("string"))).otherwise("").alias("block"),
        F.when(kind == "annotation", F.concat(F.lit("a"), (col("i") % 8).cast("string"))).otherwise("").alias("slot"),
        F.when(blocked, F.concat(F.lit("/** block "), F.floor(col("i") / 8).cast("string"), F.lit(" */"))).otherwise(
            "").alias("block_text"),
        (col("doc_id") % 3 == 0).alias("protected"), (col("doc_id") % 11 == 0).alias("required"),
        (col("i") + 1 + F.when(kind == "doc", 1).otherwise(0)).cast("int").alias("end_line"),
        F.sha2(F.concat_ws("|", "comment_text", "code_text"), 256).alias("id"),
        # the marker on one of the two lines above
        (((col("i") >= 1) & ((n - 1) % 29 == 0) & ((n - 1) % 23 != 0))
         | ((col("i") >= 2) & ((n - 2) % 29 == 0) & ((n - 2) % 23 != 0))).alias("ignore_next"))


def scores(doc_id: Column, i: Column) -> dict[str, Column]:
    """Verdict numbers by integer arithmetic, so every engine agrees on them."""
    n = doc_id * 31 + i * 7
    return {
        "accuracy": (n * 37 % 301).cast("double") / 100.0, "usefulness": (n * 53 % 301).cast("double") / 100.0,
        "accuracy_confidence": (n * 11 % 101).cast("double") / 100.0,
        "usefulness_confidence": (n * 13 % 101).cast("double") / 100.0,
        "overreach": (n * 17 % 101).cast("double") / 100.0, "commented_out": (n * 19 % 101).cast("double") / 100.0,
    }


def verdict(doc_id: Column, i: Column) -> Column:
    s = scores(doc_id, i)
    tokens = (doc_id % 500 + 100).cast("int")
    return F.struct(
        to_axis(s["accuracy"], s["accuracy_confidence"], legend_label(s["accuracy"], C.ACCURACY_LEGEND)).alias("accuracy"),
        to_axis(s["usefulness"], s["usefulness_confidence"], legend_label(s["usefulness"], C.USEFULNESS_LEGEND)).alias(
            "usefulness"),
        F.struct(s["overreach"].alias("prob")).alias("overreach"),
        F.struct(s["commented_out"].alias("prob")).alias("commented_out"),
        F.struct(tokens.alias("input_tokens"), (tokens * C.USD_PER_INPUT_TOKEN).alias("cost_usd")).alias("usage"),
        F.lit("recorded").alias("model"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines: three ranges in most documents, none in every fifth."""
    docs = table(spark, sf_dir, "documents").where(col("doc_id") % 5 != 0)
    start = (col("k") * 5 + col("doc_id") % 3 + 1).cast("int")
    return docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select(
        file_of(col("doc_id")).alias("file"), start.alias("start"), (start + col("k")).cast("int").alias("end"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(salt, id, verdict, stored)``: two generations of verdicts for labelled documents' even lines."""
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    stored = table(spark, sf_dir, "events").select(col("event_id").alias("doc_id"), "ts")
    rows = findings(spark, sf_dir).where(col("i") % 2 == 0).join(labelled, "doc_id").join(stored, "doc_id")
    # copies of a line are stored once, from the document that comes first
    rows = rows.groupBy("id").agg(F.min_by(F.struct("doc_id", "i", "ts"), F.struct("doc_id", "i")).alias("r")).select("id", "r.*")
    rows = rows.withColumn("age", F.explode(F.array(F.lit(0), F.lit(9))))
    return rows.select(
        F.when(col("doc_id") % 4 == 0, "other").otherwise("mine").alias("salt"), "id",
        verdict(col("doc_id") + col("age"), col("i")).alias("verdict"),
        (col("ts") - F.make_dt_interval(col("age"))).alias("stored"))


def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, i, text)``: every document as a diff of three-line steps: path, hunk, changed line."""
    a, b = col("i") * 3 + col("doc_id") % 7 + 1, (col("i") + col("doc_id")) % 4
    count = F.when(b == 1, "").otherwise(F.concat(F.lit(","), b.cast("string")))
    text = (
        F.when(col("i") % 9 == 0, F.concat(F.lit("+++ b/"), file_of(col("doc_id") + col("i"))))
        .when(col("i") % 3 == 1, F.concat(F.lit("@@ -1 +"), a.cast("string"), count, F.lit(" @@ ctx")))
        .otherwise(F.concat(F.lit("+"), col("text"))))
    return lines(spark, sf_dir).select("doc_id", "i", text.alias("text"))


def docblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, block)``: every document as a documentation block with tags and blank lines in it."""
    def line(text, i):
        return (F.when((i + col("doc_id")) % 5 == 3, F.concat(F.lit(" * @param p"), i.cast("string"), F.lit(" "), text))
                .when((i + col("doc_id")) % 7 == 6, F.lit(" *")).otherwise(F.concat(F.lit(" * "), text)))

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("/**\n"), F.array_join(F.transform(
        F.split("text", "\n", -1), line), "\n"), F.lit("\n */")).alias("block"))


def commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, content)``: every document as comment lines with a call after every four."""
    docs = table(spark, sf_dir, "documents")
    lang = pick(col("doc_id"), ("go", "js", "php", "py"))
    mark = F.when(lang == "py", "# ").otherwise("// ")
    call = F.concat(F.lit("call()"), F.when(lang.isin("js", "php"), ";").otherwise(""))

    def line(text, i):
        return F.when(i % 5 == 4, F.concat(F.lit("\t"), call)).otherwise(F.concat(F.lit("\t"), mark, text))

    head = (F.when(lang == "go", "package p\n\nfunc f() {\n").when(lang == "js", "function f() {\n")
            .when(lang == "php", "<?php\nfunction f() {\n").otherwise("def f():\n"))
    tail = F.concat(F.lit("\n\t"), call, F.when(lang == "py", "\n").otherwise("\n}\n"))
    text = F.concat(head, F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"), tail)
    return docs.select(F.concat(F.lit("c"), col("doc_id").cast("string"), F.lit("."), lang).alias("file"),
                       text.cast("binary").alias("content"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, content)``: every document as a source file in one of four languages.

    Line 4k of the document is a comment, the lines between are calls, every second of them
    with a note behind it; a last call stands apart.
    """
    docs = table(spark, sf_dir, "documents")
    lang = pick(col("doc_id"), ("go", "ts", "php", "py"))
    mark = F.when(lang == "py", "# ").otherwise("// ")
    stop = F.when(lang.isin("ts", "php"), ";").otherwise("")

    def body(text, i):
        call = F.concat(F.lit("\tcall("), i.cast("string"), F.lit(")"), stop)
        note = F.concat(F.lit(" "), mark, F.lit("note "), col("doc_id").cast("string"), F.lit(" "), i.cast("string"))
        return F.when(i % 4 == 0, F.concat(F.lit("\t"), mark, text)).when(i % 4 == 2, F.concat(call, note)).otherwise(call)

    head = (F.when(lang == "go", "package p\n\nfunc f() {\n").when(lang == "ts", "function f() {\n")
            .when(lang == "php", "<?php\nfunction f() {\n").otherwise("def f():\n"))
    tail = F.concat(F.lit("\n\n\tdone()"), stop, F.when(lang == "py", "\n").otherwise("\n}\n"))
    text = F.concat(head, F.array_join(F.transform(F.split("text", "\n", -1), body), "\n"), tail)
    return docs.select("doc_id", F.concat(F.lit("d"), col("doc_id").cast("string"), F.lit("."), lang).alias("file"),
                       text.cast("binary").alias("content"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, content)``: every document as a function whose blocks stand in each other, up to five deep.

    Line i of the document is a comment above a call, inside i % 5 + 1 conditions.
    """
    docs = table(spark, sf_dir, "documents")
    lang = pick(col("doc_id"), ("go", "ts", "php", "py"))
    mark = F.when(lang == "py", "# ").otherwise("// ")
    stop = F.when(lang.isin("ts", "php"), ";").otherwise("")
    opens = F.when(lang == "go", "if x {").when(lang == "py", "if x:").otherwise("if (x) {")

    def body(text, i):
        depth = i % 5 + 1
        tabs = lambda k: F.repeat(F.lit("\t"), k)
        down = F.array_join(F.transform(F.sequence(F.lit(1), depth), lambda k: F.concat(tabs(k), opens)), "\n")
        up = F.array_join(F.transform(F.sequence(depth, F.lit(1)), lambda k: F.concat(F.lit("\n"), tabs(k), F.lit("}"))), "")
        return F.concat(down, F.lit("\n"), tabs(depth + 1), mark, text, F.lit("\n"), tabs(depth + 1), F.lit("call("), i.cast("string"), F.lit(")"),
                        stop, F.when(lang == "py", "").otherwise(up))

    head = (F.when(lang == "go", "package p\n\nfunc f() {\n").when(lang == "ts", "function f() {\n")
            .when(lang == "php", "<?php\nfunction f() {\n").otherwise("def f():\n"))
    text = F.concat(head, F.array_join(F.transform(F.split("text", "\n", -1), body), "\n"), F.when(lang == "py", "\n").otherwise("\n}\n"))
    return docs.select("doc_id", F.concat(F.lit("n"), col("doc_id").cast("string"), F.lit("."), lang).alias("file"),
                       text.cast("binary").alias("content"))
