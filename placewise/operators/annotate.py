"""Annotators: what a language model would say of each batch, as a relation.

An annotator is a function from a batch's prompt to an answer in JSON. `annotate` runs one over Arrow batches;
`lexicon_annotations` is a deterministic one in built-in functions, for use without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.text import json_object, words
from placewise.operators.quota import Quota, laned, pace, tokens_of

POSITIVE = ("good", "great", "excellent", "friendly", "love", "clean", "fast", "best", "nice", "perfect")
NEGATIVE = ("bad", "slow", "dirty", "rude", "worst", "awful", "cold", "late", "poor", "broken")
#: What the message of a failure says where a model is gone.
GONE = ("decommissioned", "not found")
#: Seconds before a further attempt.
WAIT_UNREAD, WAIT_FAILED = 1.0, 2.0


def annotate(prompts: DataFrame, annotator: Callable[[str], str], schema: str, reserve: Callable[[str], str] | None = None, attempts: int = 2, quota: Quota | None = None) -> DataFrame:
    """prompts (place_id, batch, prompt) with a column `answer` of the schema; null where no JSON comes back.

    A call that fails, or whose answer has no object, is made again up to so many times, then counts as no answer. Where a
    failure says that the model is gone, the reserve is asked in its place. With a quota every call, further ones included, waits until it
    fits, and before a further one there is a pause: WAIT_UNREAD after an answer without an object, WAIT_FAILED after a failure.
    """
    asked, part = laned(prompts.select("place_id", "batch", "prompt"), quota) if quota else (prompts.select("place_id", "batch", "prompt"), 0)

    def answered(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pace(quota, part) if quota else None

        def call(model: Callable[[str], str], prompt: str) -> str:
            if own:
                own.wait(tokens_of(prompt, quota.answer))
            return model(prompt)

        def once(prompt: str) -> tuple[str | None, float]:
            """The answer, if there is one, and what to wait for before another attempt."""
            try:
                raw = call(annotator, prompt)
            except Exception as failure:  # noqa: BLE001 - any failure of a service is no answer
                if reserve is None or not any(x in str(failure).lower() for x in GONE):
                    return None, WAIT_FAILED
                try:
                    raw = call(reserve, prompt)
                except Exception:  # noqa: BLE001
                    return None, WAIT_FAILED
            return (raw, 0.0) if raw and "{" in raw else (None, WAIT_UNREAD)

        def ask(prompt: str) -> str | None:
            for attempt in range(attempts):
                raw, wait = once(prompt)
                if raw is not None:
                    return raw
                if own and attempt + 1 < attempts:
                    own.clock.sleep(wait)
            return None

        for rows in parts:
            yield rows.assign(raw=rows["prompt"].map(ask))

    raw = asked.mapInPandas(answered, asked.withColumn("raw", F.lit(None).cast("string")).schema)
    return raw.select("place_id", "batch", F.from_json(json_object(F.col("raw")), schema).alias("answer"))


def _hits(text: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(words(text), lambda w: w.isin(*lexicon)))


def lexicon_annotations(reviews: DataFrame) -> DataFrame:
    """(place_id, batch, id, score, sentiment): the share of positive over negative words, else the rating's side."""
    from placewise.operators.reviews import batch_of, review_id

    p, n = _hits(F.col("text"), POSITIVE), _hits(F.col("text"), NEGATIVE)
    score = F.when(p + n > 0, (p - n) / (p + n)).otherwise((F.col("rating") - 3) / 2)
    rows = reviews.select("place_id", batch_of(F.col("pos")).alias("batch"), review_id(F.col("pos")).alias("id"), score.alias("score"))
    return rows.withColumn("sentiment", F.when(F.col("score") > 0.2, "positive").when(F.col("score") < -0.2, "negative").otherwise("neutral"))
