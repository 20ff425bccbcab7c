"""Plan registry: a Spark builder, its output columns and the equivalent SQL.

Output columns are declared once as text, e.g. ``"symbol date:d ret:f n:i"``; the same declaration shapes the Spark result
and the SQL result: `f` floating (as computed, NaN as NULL), `i` integer, `d` date as text, `s` text. How far the two may differ
is up to what compares them (`tools/check.py`).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.duck import CTES
from barloom.sources.tables import Tables

KINDS = {"symbol": "s", "date": "d"}


def parse_columns(text: str) -> list[tuple[str, str]]:
    out = []
    for token in text.split():
        name, _, kind = token.partition(":")
        out.append((name, kind or KINDS.get(name, "f")))
    return out


def _duck_float(name: str) -> str:
    x = f'"{name}"::DOUBLE'
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


def shape(df: DataFrame, columns: str) -> DataFrame:
    make = {
        "f": F.col,
        "i": lambda c: F.col(c).cast("bigint"),
        "d": lambda c: F.date_format(F.col(c), "yyyy-MM-dd"),
        "s": lambda c: F.col(c).cast("string"),
    }
    parsed = parse_columns(columns)
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) if k == "f" else F.col(c) for c, k in parsed])
    return df.select(*[make[k](c).alias(c) for c, k in parsed])


def shape_sql(sql: str, columns: str) -> str:
    make = {
        "f": _duck_float,
        "i": lambda c: f'CAST("{c}" AS BIGINT)',
        "d": lambda c: f"strftime(\"{c}\", '%Y-%m-%d')",
        "s": lambda c: f'CAST("{c}" AS VARCHAR)',
    }
    select = ", ".join(f'{make[k](c)} AS "{c}"' for c, k in parse_columns(columns))
    return f"{with_ctes(sql)} SELECT {select} FROM result"


def with_ctes(sql: str) -> str:
    """Prefix the shared fixture definitions a query refers to, dependencies first."""
    needed: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and name not in open_ and re.search(rf"\b{name}\b", text):
                open_.add(name)
                visit(body)
                needed.append(name)

    visit(sql)
    once = {name: "" if re.search(rf"\b{name}\b", CTES[name]) else "MATERIALIZED " for name in needed}  # recursive ones stay plain
    parts = [f"{name} AS {once[name]}({CTES[name]})" for name in needed]
    return "WITH RECURSIVE " + ",\n".join([*parts, f"result AS ({sql})"])


@dataclass(frozen=True)
class Plan:
    name: str
    rows: tuple[int, ...]
    columns: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    why_no_sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(self.build(Tables(spark, sf_dir)), self.columns)

    def oracle(self) -> str | None:
        return None if self.sql is None else shape_sql(self.sql, self.columns)


PLANS: dict[str, Plan] = {}


def plan(name: str, rows, columns: str, sql: str | None = None, why_no_sql: str | None = None):
    """Register the decorated builder. `rows` are the survey rows it covers."""
    rows = (rows,) if isinstance(rows, int) else tuple(rows)

    def register(build):
        if name in PLANS:
            raise ValueError(f"plan {name} registered twice")
        PLANS[name] = Plan(name, rows, columns, build, sql, why_no_sql)
        return build

    return register
