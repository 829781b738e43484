"""Registry of the queries and of their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysift.plans.views import Views, duck_with

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` is its twin over the named views."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = twin(views, sql)
        return fn

    return wrap


def twin(views: str, sql: str) -> str:
    names = views.split()
    text = " ".join(sql.split())
    recursive = text.upper().startswith("RECURSIVE ")
    text = text[len("RECURSIVE ") :] if recursive else text
    if not names:
        return text
    joint = " " if text.upper().startswith("SELECT") else ", "
    return f"WITH {'RECURSIVE ' if recursive else ''}{duck_with(names)}{joint}{text}"


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: QUERIES[name](Views(spark, folder))


def R(expr: str, places: int = 0) -> str:
    """SQL of half-even rounding, the twin of ``half_even``."""
    unit = f"1e{places}"
    return f"(round_even(({expr}) * {unit}, 0) / {unit} + 0e0)"


def RS(expr: str, places: int = 0) -> str:
    """SQL twin of ``settled``."""
    return R(R(expr, 9), places)


def FX(expr: str, places: int) -> str:
    """SQL of text with fixed decimals, the twin of ``fixed``."""
    return f"printf('%.{places}f', {R(expr, places)})"
