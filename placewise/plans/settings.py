"""What a run can be told by the environment: one variable for each field, PLACEWISE_ and its name in capitals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from placewise.operators.quota import Quota
from placewise.sources.readers import CACHE_DAYS
from placewise.sources.service import MAX_REVIEWS


@dataclass(frozen=True)
class Settings:
    """The services' allowances (tokens a minute) and the lengths of answers."""

    models: str = ""  # module:name of a plans.models.Models
    strong_model: str = "llama-3.3-70b-versatile"
    fast_model: str = "llama-3.1-8b-instant"
    verifier_model: str = "llama-3.1-8b-instant"
    verdict_model: str = "llama-3.3-70b-versatile"
    require_verification: bool = False
    max_reviews: int = MAX_REVIEWS
    cache_days: int = CACHE_DAYS
    strong_tokens: int = 14_400
    fast_tokens: int = 6_000
    answer_tokens: int = 4_096
    lanes: int = 1
    gap: float = 1.2  # seconds between calls

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        """Defaults where a variable isn't set or is empty; a value that isn't of its field's kind raises an error."""
        found = {}
        for f in fields(cls):
            value = environment.get(f"PLACEWISE_{f.name.upper()}", "").strip()
            if value:
                kind = type(getattr(cls, f.name))
                if kind is bool and value.lower() not in ("true", "false"):
                    raise ValueError(f"PLACEWISE_{f.name.upper()} is neither true nor false: {value}")
                found[f.name] = value.lower() == "true" if kind is bool else kind(value)
        return cls(**found)

    def strong_quota(self) -> Quota:
        return Quota(self.strong_tokens, lanes=self.lanes, answer=self.answer_tokens, gap=self.gap)

    def fast_quota(self) -> Quota:
        return Quota(self.fast_tokens, lanes=self.lanes, answer=min(self.answer_tokens, self.fast_tokens // 2), gap=self.gap)

    def model_names(self) -> dict[str, str]:
        """As reports name them."""
        return {"model_a": self.strong_model, "guardrail_model": self.fast_model, "model_b": self.verifier_model, "verdict_model": self.verdict_model}
