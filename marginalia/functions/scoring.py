"""Scoring expressions: axes, token estimate, cost, question and state texts, message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.text import snippet


def percent(score: Column) -> Column:
    """Percentage of a 0..3 score, halves rounded away from zero."""
    return F.round(F.lit(100.0) * score / F.lit(float(C.LEVELS - 1))).cast("int")


def legend_label(score: Column, legend) -> Column:
    """Label of the nearest level, '' outside the legend."""
    labels = F.create_map(*[x for i, label in enumerate(legend) for x in (F.lit(i), F.lit(label))])
    return F.coalesce(F.try_element_at(labels, F.round(score).cast("int")), F.lit(""))


def to_axis(score: Column, confidence: Column, label: Column) -> Column:
    """Score, percentage, label and confidence of one graded axis."""
    return F.struct(score.cast("double").alias("score"), percent(score).alias("pct"), label.alias("label"),
                    confidence.cast("double").alias("confidence"))


def estimate_tokens(size_bytes: Column) -> Column:
    """Billed tokens of a request of that many bytes."""
    return F.floor(size_bytes.cast("double") / F.lit(C.BYTES_PER_TOKEN)).cast("int") + F.lit(C.TOKENS_PER_REQUEST)


def shared_tokens(request_tokens: Column, findings: Column) -> Column:
    """A finding's integer share of its request; the remainder is lost."""
    return F.floor(request_tokens / findings).cast("int")


def cost_usd(tokens: Column) -> Column:
    """Price of input tokens (P10)."""
    return tokens.cast("double") * F.lit(C.USD_PER_INPUT_TOKEN)


def slot_markers(slot: Column) -> tuple[Column, Column]:
    """Lines around a slot inside a block text."""
    return F.concat(F.lit(">>> "), F.upper(slot)), F.concat(F.lit("<<< "), F.upper(slot))


def question_suffix(slot: Column, block_text: Column) -> Column:
    """What narrows a question to one slot, or to the prose around the slots."""
    opening, closing = slot_markers(slot)
    return (
        F.when(slot != "", F.concat(F.lit("\nAnswer only about the lines between "), opening, F.lit(" and "),
                                    closing, F.lit(" in the COMMENT block.")))
        .when(block_text != "", F.lit("\nAnswer only about the COMMENT text outside the marked lines."))
        .otherwise(F.lit(""))
    )


def asks_commented_out(kind: Column) -> Column:
    """Annotations are syntax for tools and never asked whether they are code."""
    return kind != "annotation"


def question_bytes(rubric, kind: Column, slot: Column, block_text: Column) -> Column:
    """Bytes of all questions one finding asks."""
    def size(text):
        return len(text.encode("utf-8"))

    base = (
        size(rubric.accuracy[0]) + size("".join(rubric.accuracy[1]))
        + size(rubric.usefulness[0]) + size("".join(rubric.usefulness[1])) + size(rubric.overreach)
    )
    asks = asks_commented_out(kind)
    suffix = F.octet_length(question_suffix(slot, block_text))
    return (F.lit(base) + suffix * F.when(asks, 4).otherwise(3)
            + F.when(asks, size(rubric.commented_out)).otherwise(0)).cast("int")


def state(context: Column, code_text: Column, block_text: Column, comment_text: Column) -> Column:
    """What the scorer sees: marked code in context, then the comment."""
    def rstrip(text):
        return F.regexp_replace(text, r"\n+\z", "")

    shown = F.when(context != "", rstrip(context)).otherwise(
        F.concat(F.lit(">>> CODE\n"), rstrip(code_text), F.lit("\n<<< CODE")))
    comment = F.when(block_text != "", block_text).otherwise(comment_text)
    return F.concat(F.lit("--- CONTEXT ---\n"), shown, F.lit("\n--- COMMENT ---\n"), rstrip(comment), F.lit("\n"))


def state_bytes(context: Column, code_text: Column, block_text: Column, comment_text: Column) -> Column:
    return F.octet_length(state(context, code_text, block_text, comment_text))


def severity_rank(severity: Column) -> Column:
    """error 3, warning 2, info 1, else 0."""
    chain = F
    for name, rank in C.SEVERITY_RANK.items():
        chain = chain.when(severity == name, F.lit(rank))
    return chain.otherwise(F.lit(0))


def fail_on_rank(fail_on: str) -> int:
    """Rank a run fails at; an unknown word counts as error, ``never`` as 0."""
    return {"never": 0, "info": 1, "warning": 2}.get(fail_on, 3)


def bar(pct: Column) -> Column:
    """Ten-cell bar."""
    filled = F.floor(pct * C.BAR_WIDTH / 100).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), C.BAR_WIDTH - filled), F.lit("]"))


def rule_description(rule: Column) -> Column:
    """Fixed text per rule id; an unknown id stands for itself."""
    chain = F
    for name, text in C.RULE_DESCRIPTIONS.items():
        chain = chain.when(rule == name, F.lit(text))
    return chain.otherwise(rule)


def message(rule: Column, accuracy_pct: Column, usefulness_pct: Column, commented_out: Column,
            comment_text: Column) -> Column:
    """Rule text, the numbers behind it and a snippet."""
    text = snippet(comment_text, 80)
    disabled = F.format_string("%s (probability %d%%): %s", rule_description(rule),
                               F.bround(F.lit(100.0) * commented_out).cast("int"), text)
    graded = F.format_string("%s (accuracy %d%%, usefulness %d%%): %s", rule_description(rule),
                             accuracy_pct, usefulness_pct, text)
    return F.when(rule == "commented-out-code", disabled).otherwise(graded)
