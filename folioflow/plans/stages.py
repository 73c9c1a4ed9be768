"""Named cleaning stages applied to chapter tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cleaner

Step = Callable[[DataFrame, dict], DataFrame]


def _clean(chapters: DataFrame, options: dict) -> DataFrame:
    return chapters.withColumn("content", cleaner("content", bool(options.get("remove_invisible"))))


STEPS: dict[str, Step] = {"": lambda df, _: df, "raw": lambda df, _: df, "cleaner": _clean}


def register_step(name: str, step: Step) -> None:
    """Add a caller's step; names are compared trimmed and in lower case."""
    STEPS[name.strip().lower()] = step


def run_steps(chapters: DataFrame, steps: Sequence[tuple[str, dict]]) -> tuple[DataFrame, str]:
    """Apply steps in order.  Unknown names change nothing; the stage is named after the last step,
    or `raw` without any."""
    stage = "raw"
    for name, options in steps:
        step = STEPS.get(name.strip().lower())
        if step is not None:
            chapters = chapters.transform(lambda df, step=step, options=options: step(df, options))
        stage = name
    return chapters, stage


def staged(chapters: DataFrame, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """`run_steps` with the stage as a column."""
    out, stage = run_steps(chapters, steps)
    return out.withColumn("stage", F.lit(stage or "raw"))
