"""A scorer that answers from recorded entries, as plain expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.scoring import legend_label
from marginalia.scorers import ANSWERS


#: Entries that are compared one by one; a longer list becomes an automaton.
MOST_BRANCHES = 64
NUMBERS = ("accuracy", "usefulness", "overreach", "commented_out", "confidence")


@dataclass(frozen=True)
class Recorded:
    """Answers for comments containing ``match``."""

    match: str = ""
    accuracy: float = 0.0
    usefulness: float = 0.0
    overreach: float = 0.0
    commented_out: float = 0.0
    confidence: float = 0.0


@dataclass(frozen=True)
class RecordedScorer:
    """First entry in list order whose ``match`` the judged text contains, else the default."""

    verdicts: tuple[Recorded, ...] = ()
    default: Recorded = field(default_factory=Recorded)
    input_tokens: int = 0
    model: str = "recorded"
    paid: bool = False

    @staticmethod
    def load(path: str) -> RecordedScorer:
        """Read ``{model, input_tokens, default, verdicts[]}``."""
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        entries = tuple(Recorded(**entry) for entry in raw.get("verdicts", ()))
        return RecordedScorer(entries, Recorded(**raw.get("default", {})), raw.get("input_tokens", 0),
                              raw.get("model") or "recorded")

    def match(self, text: Column) -> Column:
        """The entry for a text, as one struct."""
        return F.element_at(self.match_each(F.array(text)), 1)

    def match_each(self, texts: Column) -> Column:
        """The entry for every text of an array, as ``array<struct>``.

        A few entries are branches of one expression. Many go into an Aho-Corasick automaton, built once a
        task: it meets all entries a text contains in one pass, and the first in list order counts.
        """
        wanted = [r for r in self.verdicts if r.match]
        if len(wanted) <= MOST_BRANCHES:
            return F.transform(texts, lambda text: self._branches(wanted, text))
        entries = [self._numbers(r) for r in (*wanted, self.default)]

        def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = first_of([r.match for r in wanted])
            for batch in batches:
                yield pd.Series([[entries[min((k for _, k in automaton.iter(text or "")), default=-1)] for text in texts] for texts in batch], dtype=object)

        return F.pandas_udf(matched, f"array<struct<{', '.join(f'{name}:double' for name in NUMBERS)}>>")(texts)

    def _numbers(self, recorded: Recorded) -> dict[str, float]:
        held = {name: float(getattr(recorded, name)) for name in NUMBERS}
        return held | {"confidence": held["confidence"] or C.RECORDED_CONFIDENCE}

    def _branches(self, wanted: list[Recorded], text: Column) -> Column:
        def entry(recorded: Recorded) -> Column:
            return F.struct(*[F.lit(value).alias(name) for name, value in self._numbers(recorded).items()])

        chain = F
        for recorded in wanted:
            chain = chain.when(F.contains(text, F.lit(recorded.match)), entry(recorded))
        return entry(self.default) if chain is F else chain.otherwise(entry(self.default))

    def score(self, requests: DataFrame) -> DataFrame:
        comment = F.element_at(F.split("state", "--- COMMENT ---", 2), -1)
        said = self.match_each(F.transform("items", lambda item: section(comment, item["slot"])))

        def answer(item):
            recorded = item["said"]
            return F.struct(
                item["items"]["slot"].alias("slot"), recorded["accuracy"].alias("accuracy"),
                recorded["confidence"].alias("accuracy_confidence"),
                legend_label(recorded["accuracy"], C.ACCURACY_LEGEND).alias("accuracy_label"),
                recorded["usefulness"].alias("usefulness"), recorded["confidence"].alias("usefulness_confidence"),
                legend_label(recorded["usefulness"], C.USEFULNESS_LEGEND).alias("usefulness_label"),
                recorded["overreach"].alias("overreach"), recorded["commented_out"].alias("commented_out"))

        requests = requests.withColumn("said", said)
        return requests.withColumns({
            "answers": F.transform(F.arrays_zip("items", "said"), answer).cast(ANSWERS), "input_tokens": F.lit(self.input_tokens),
            "model": F.lit(self.model)}).drop("said")


def first_of(patterns: list[str]) -> ahocorasick.Automaton:
    """An automaton of texts to look for that yields their number in the list, the first one of equal texts."""
    automaton = ahocorasick.Automaton()
    for k, pattern in enumerate(patterns):
        if pattern not in automaton:
            automaton.add_word(pattern, k)
    automaton.make_automaton()
    return automaton


def section(comment: Column, slot: Column) -> Column:
    """Lines between a slot's markers, or for '' all lines outside any markers."""
    marked = r"(?ms)^>>> [^\n]*\n(?:.*?\n)?<<< [^\n]*(?:\n|\z)"
    outside = F.regexp_replace(comment, marked, "")
    blocks = F.regexp_extract_all(comment, F.lit(r"(?ms)^(>>> [^\n]*\n(?:.*?\n)?)<<< [^\n]*"), F.lit(1))
    opening = F.concat(F.lit(">>> "), F.upper(slot), F.lit("\n"))
    own = F.array_join(F.transform(
        F.filter(blocks, lambda b: F.startswith(b, opening)), lambda b: F.replace(b, opening, F.lit(""))), "\n")
    return F.when(slot != "", own).otherwise(outside)
