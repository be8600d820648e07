"""Global decorators of plans, by name: applied to the DataFrame that each operator gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

EACH_OPERATOR: dict[str, Callable[[DataFrame], DataFrame]] = {}


def on_each_operator(name: str, decorate: Callable[[DataFrame], DataFrame]) -> None:
    EACH_OPERATOR[name] = decorate


def reset_on_each_operator(name: str | None = None) -> None:
    if name is None:
        EACH_OPERATOR.clear()
    else:
        EACH_OPERATOR.pop(name, None)


def decorated(df: DataFrame) -> DataFrame:
    for decorate in EACH_OPERATOR.values():
        df = decorate(df)
    return df
