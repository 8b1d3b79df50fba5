"""Cost planning before external jobs run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tripmine import rules
from tripmine.operators.cost import estimate_by_task


def cost_plan(
    mail: DataFrame,
    *,
    input_rate: float | None,
    output_rate: float | None,
    max_body_chars: int | None = None,
    classify_max_body_chars: int | None = None,
    overhead_tokens: int = rules.PROMPT_OVERHEAD_TOKENS,
) -> DataFrame:
    """Estimates of classification and extraction over the same mail, whole bodies unless a cap is given."""
    shared = {
        "input_rate": input_rate,
        "output_rate": output_rate,
        "overhead_tokens": overhead_tokens,
    }
    return estimate_by_task(
        mail,
        {
            "Classification": shared
            | {
                "output_tokens": rules.OUTPUT_TOKENS_CLASSIFICATION,
                "max_body_chars": classify_max_body_chars or max_body_chars,
            },
            "Extraction": shared
            | {
                "output_tokens": rules.OUTPUT_TOKENS_EXTRACTION,
                "max_body_chars": max_body_chars,
            },
        },
    )
