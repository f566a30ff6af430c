"""Where the registered queries are kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import new_folder
from ..sources.roles import role, role_sql, table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The role views and tables under one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return role(self._spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        """A plain table."""
        return table(self._spark, self.sf_dir, name)

    def folder(self, name: str) -> str:
        """A new folder for files that a query writes and reads back."""
        return new_folder(self._spark, name)


class Registry:
    """Named queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, roles: str = "") -> None:
        """Register a query. The SQL sees the listed roles as common table expressions of the same names."""
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            views = ", ".join(f"{view} AS ({role_sql(view)})" for view in roles.split())
            self.sql[name] = _with(views, sql)


def _with(views: str, sql: str) -> str:
    body = sql.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def shown(expression: str, digits: int) -> str:
    """SQL for a rounded figure, half up whatever the order of summation, and never a negative zero."""
    return f"(round(({expression}) + 1e-9, {digits}) + 0.0)"
