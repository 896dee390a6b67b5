"""Scorers answer requests. A scorer is any object with ``paid`` and ``score(requests) -> DataFrame``.

``score`` adds ``input_tokens int``, ``model string`` and ``answers`` to requests, the latter one
struct per slot: slot, accuracy, accuracy_confidence, accuracy_label, usefulness,
usefulness_confidence, usefulness_label, overreach, commented_out.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

ANSWERS = (
    "array<struct<slot:string,accuracy:double,accuracy_confidence:double,accuracy_label:string,usefulness:double,"
    "usefulness_confidence:double,usefulness_label:string,overreach:double,commented_out:double>>"
)


class Scorer(Protocol):
    paid: bool

    def score(self, requests: DataFrame) -> DataFrame: ...
