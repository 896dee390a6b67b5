"""A scorer behind HTTP: one call per request, made from the tasks of one stage.

The calls are paid, so the caller writes the scored rows before any second action, and a
request's key goes along for the server to recognise a repeated call.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from marginalia import constants as C
from marginalia.scorers import ANSWERS

# fixed values: retries of one call
RETRIES, FIRST_WAIT, LONGEST_WAIT, JITTER = 2, 0.5, 5.0, 0.25

Transport = Callable[[str, dict, dict, float], dict]

# fixed value: what the scoring service calls a question that asks for a probability
PROBABILITY = "noul"


class TransportError(RuntimeError):
    """The scorer could not be reached in time."""


def post_json(url: str, headers: dict, body: dict, timeout: float) -> dict:
    """POST with bounded retries on connection failures, timeouts and busy answers."""
    data = json.dumps(body).encode("utf-8")
    for attempt in range(RETRIES + 1):
        try:
            call = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
            with urllib.request.urlopen(call, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code != 429 and error.code < 500:
                raise
            failure = error
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            failure = error
        if attempt < RETRIES:
            wait = min(FIRST_WAIT * 2**attempt, LONGEST_WAIT)
            time.sleep(wait * random.uniform(1 - JITTER, 1 + JITTER))
    raise TransportError(f"scorer unreachable: {failure}")


@dataclass(frozen=True)
class HttpScorer:
    """Scores over HTTP with at most ``concurrency`` calls at a time."""

    url: str
    api_key: str
    model: str
    rubric: object
    timeout: float = C.REQUEST_TIMEOUT_SECONDS
    concurrency: int = C.CONCURRENCY
    transport: Transport = post_json
    paid: bool = True

    def questions(self, items) -> dict:
        """Questions by name; items sharing a slot share them."""
        asked = {}
        for item in items:
            suffix = f".{item['slot']}" if item["slot"] else ""
            narrowed = ""
            if item["slot"]:
                mark = item["slot"].upper()
                narrowed = f"\nAnswer only about the lines between >>> {mark} and <<< {mark} in the COMMENT block."
            elif item["block_text"]:
                narrowed = "\nAnswer only about the COMMENT text outside the marked lines."
            for name in ("accuracy", "usefulness"):
                instructions, criteria = getattr(self.rubric, name)
                asked[name + suffix] = {"type": "score", "instructions": instructions + narrowed, "criteria": list(criteria)}
            asked["overreach" + suffix] = {"type": PROBABILITY, "instructions": self.rubric.overreach + narrowed}
            if item["kind"] != "annotation":
                asked["commented_out" + suffix] = {"type": PROBABILITY, "instructions": self.rubric.commented_out + narrowed}
        return asked

    def answers(self, items, reply: dict) -> list[dict]:
        """Answers by slot; one the reply lacks is an error that names the question."""
        given = reply.get("answers", {})

        def pick(item, name):
            key = f"{name}.{item['slot']}" if item["slot"] else name
            if given.get(key) is None:
                raise KeyError(f"{item['file']}: the scorer answered no {key!r} question")
            return given[key]

        out = []
        for item in items:
            row = {"slot": item["slot"], "commented_out": 0.0, "overreach": float(pick(item, "overreach")[PROBABILITY])}
            for name in ("accuracy", "usefulness"):
                answer = pick(item, name)
                level = str(int(answer["score"] + 0.5))
                row |= {name: float(answer["score"]), f"{name}_confidence": float(answer.get("confidence", 0.0)),
                        f"{name}_label": (answer.get("legend") or {}).get(level, "")}
            if item["kind"] != "annotation":
                row["commented_out"] = float(pick(item, "commented_out")[PROBABILITY])
            out.append(row)
        return out

    def score(self, requests: DataFrame) -> DataFrame:
        headers = {"Authorization": f"Bearer {self.api_key}"}

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                replies = [
                    (self.transport(self.url, {**headers, "Idempotency-Key": key},
                                    {"model": self.model, "state": text, "questions": self.questions(items)}, self.timeout), items)
                    for key, text, items in zip(batch["req_id"], batch["state"], batch["items"])]
                yield batch.assign(
                    answers=[self.answers(items, reply) for reply, items in replies],
                    input_tokens=[int(reply.get("usage", {}).get("input_tokens", 0)) for reply, _ in replies],
                    model=[reply.get("model") or self.model for reply, _ in replies])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
        return requests.repartition(self.concurrency, "req_id").mapInPandas(
            call, f"{schema}, answers {ANSWERS}, input_tokens int, model string")
