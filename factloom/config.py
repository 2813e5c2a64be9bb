"""Settings of the engine: limits, thresholds, prices, and the rule behind each stage."""

from __future__ import annotations

from dataclasses import dataclass, field

# USD per one million tokens, as (input, output).
PRICE_LIST: dict[str, tuple[float, float]] = {
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gemini-1.5-flash": (0.075, 0.30),
    "gemini-1.5-pro": (1.25, 5.00),
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-2.5-pro": (1.25, 5.00),
    "gemini-2.0-flash": (0.075, 0.30),
    "gemini-flash-latest": (0.075, 0.30),
}

# Task names used in the ledger.
TASK_PROFILE = "Hypothesis"
TASK_EXTRACT = "Extraction"
TASK_RENDER = "Formatting"
TASK_VALIDATE = "Validation & Insights"

# Item fields whose dominant value may name a report, in order of preference.
ATTRIBUTE_FIELDS = ("capacity", "size", "color", "condition", "type")

# Spellings that count as a missing field value (besides null).
MISSING_TEXTS = ("", "N/A")

# The model recorded for a stage that runs on the built-in rules. It is not on the price list,
# so such a stage costs nothing.
BUILT_IN = "built-in rules"


@dataclass(frozen=True)
class EngineConfig:
    """Everything a run may vary. Instances are immutable and travel with the plan, not the data."""

    min_file_bytes: int = 1000
    min_raw_chars: int = 100
    min_clean_chars: int = 50
    preview_chars: int = 3_000
    chars_per_token: int = 4
    max_name_chars: int = 100

    model_share: float = 0.5
    brand_share: float = 0.5
    attribute_share: float = 0.3
    attribute_fields: tuple[str, ...] = ATTRIBUTE_FIELDS

    excellent_max_missing: float = 0.15
    good_min_ratio: float = 0.9
    fair_min_ratio: float = 0.5
    required_fields: tuple[str, ...] = ("price", "condition", "shipping")

    prices: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(PRICE_LIST))
    stage_models: dict[str, str] = field(
        default_factory=lambda: {
            TASK_PROFILE: BUILT_IN,
            TASK_EXTRACT: BUILT_IN,
            TASK_RENDER: BUILT_IN,
            TASK_VALIDATE: BUILT_IN,
        }
    )
