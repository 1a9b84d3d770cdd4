"""SQL over a dataset's signal tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidInput
from ..sources.catalog import Catalog

MAX_ROWS = 1_000_000


def query(spark: SparkSession, catalog: Catalog, text: str, tenant: str = "acme", dataset: str = "prod", most: int | None = MAX_ROWS) -> DataFrame:
    """The rows of a query, ``most`` at most (none: all). Tables are those of the tenant's dataset, by name, and only there.

    Only queries are taken: statements that change or define anything are refused.
    """
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";")
    if not re.match(r"(?i)(select|with|values|from)\b|\(", plain) or ";" in re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "", plain):
        raise InvalidInput("only one query")
    session = _session(spark, tenant, dataset)
    catalog.find(tenant, dataset, "")  # an unknown tenant is an error, whatever the query names
    for name in catalog.tables(tenant, dataset):
        if re.search(rf"(?i)(?<!\w){re.escape(name)}(?!\w)", plain) and (frame := catalog.find(tenant, dataset, name)) is not None:
            _register(session, frame, name)
    try:
        out = session.sql(plain)
    except AnalysisException as wrong:
        raise InvalidInput(str(wrong).splitlines()[0]) from None
    return out if most is None else out.limit(most)


_sessions: dict[tuple[str, str, str], SparkSession] = {}


def _session(spark: SparkSession, tenant: str, dataset: str) -> SparkSession:
    """A session of the dataset's own, whose views no other dataset sees, with the caller's settings."""
    key = (spark.sparkContext.applicationId, tenant, dataset)
    if key not in _sessions:
        _sessions[key] = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        _sessions[key].conf.set(name, spark.conf.get(name))
    return _sessions[key]


def _register(session: SparkSession, frame: DataFrame, name: str) -> None:
    """A view in one session of a frame that another one has made: they share the plan."""
    java = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, frame._jdf.queryExecution().logical())
    DataFrame(java, session).createOrReplaceTempView(name)
