"""How far a run is: rows and seconds of each step, counted by the jobs that make the step and by no others."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from placewise.functions.session import cut

#: The titles of the steps.
TITLES = {1: "Scraping Reviews", 2: "Model A — Sentiment", 3: "Model A — Guardrail", 4: "Model B — Verification", 5: "Python Scoring", 6: "Generating Explanation"}


@dataclass
class Progress:
    """tell: called with the number of a step, its title and a message, when it begins and when something of it is done."""

    tell: Callable[[int, str, str], None] | None = None
    log: list[dict[str, object]] = field(default_factory=list)  # step, what, rows, seconds

    def begin(self, step: int, message: str) -> None:
        if self.tell:
            self.tell(step, TITLES[step], message)

    def kept(self, df: DataFrame, step: int, what: str) -> DataFrame:
        """df computed and kept, as session.cut does; its rows are counted on the way."""
        if not self.tell:
            return cut(df)
        seen, began = Observation(), time.monotonic()
        out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        row = {"step": step, "what": what, "rows": seen.get["rows"], "seconds": round(time.monotonic() - began, 3)}
        self.log.append(row)
        self.tell(step, TITLES[step], f"{row['rows']} {what} in {row['seconds']:.1f} s")
        return out
