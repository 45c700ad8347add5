"""A registered query: a function of (spark, sf_dir), and the SQL it is checked against where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pitchlake.fixtures import with_views


@dataclass
class Registry:
    functions: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str | None = None) -> Callable:
        def add(function: Callable) -> Callable:
            self.functions[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = with_views(sql)
            return function

        return add
