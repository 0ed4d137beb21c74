"""Named steps that check their input before they run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    """A DataFrame function and the columns it needs."""

    name: str
    needs: tuple[str, ...]
    apply: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"step {self.name} needs columns {missing}")
        return self.apply(df)


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
