"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import boxes
from ..sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The views and tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._get = lambda name: view(spark, sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        return self._get(name)

    @property
    def placed(self) -> DataFrame:
        return boxes.on_pages(self.v_blocks, self.v_pages)


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return keep


def split_list(columns: str) -> list[str]:
    """The select list's items: commas outside brackets part them."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
