"""Named queries over a table folder, each with an optional oracle in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their oracle SQL under one name each."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return add

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query given as Spark SQL over the tables; oracle: the same in DuckDB, by default the very text."""
        self.query(name, oracle or text)(lambda spark, sf_dir: rows_of(spark, sf_dir, text))


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def rows_of(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the input tables."""
    # Text in quotes is no table's name.
    words = re.compile(r"'[^']*'|\b(" + "|".join(TABLES) + r")\b(?!\.)")
    used = {m[1] for m in words.finditer(text) if m[1]}
    named = words.sub(lambda m: "{" + m[1] + "}" if m[1] else m[0].replace("{", "{{").replace("}", "}}"), text)
    return spark.sql(named, **{t: table(spark, sf_dir, t) for t in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: All queries outside the llm subpackage.
REGISTRY = Registry()
