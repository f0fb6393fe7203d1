"""Saved models (M16): tables, parameters and losses under one number, which becomes visible in one step.

A save writes its tables to a folder of their own and then appends one row to the list of versions. That row is one
Parquet file, moved into place when its job commits: readers see a version whole or not at all, and what a crashed save
has left is listed nowhere. A version is never changed afterwards."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.models.factors import FactorModel

VERSIONS = ("name string, number int, folder string, tables array<string>, params map<string,string>, "
            "losses array<double>, singular array<double>, saved_at timestamp")
_ENCODER = "encoder-"


@dataclass
class Saved:
    number: int
    tables: dict[str, DataFrame]
    params: dict[str, str]
    losses: list[float]
    singular: list[float]

    def factors(self) -> FactorModel:
        return FactorModel(self.tables["users"], self.tables["items"], self.losses, self.singular)

    def encoders(self) -> dict[str, DataFrame]:
        return {t.removeprefix(_ENCODER): df for t, df in self.tables.items() if t.startswith(_ENCODER)}


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All listed versions; none where nothing has been saved."""
    try:
        return spark.read.schema(VERSIONS).parquet(f"{root}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def _newest(spark: SparkSession, root: str, name: str, number: int | None = None):
    """Two saves at the same time may take the same number: then the later one counts."""
    own = versions(spark, root).where(F.col("name") == name)
    if number is not None:
        own = own.where(F.col("number") == number)
    return own.orderBy(F.desc("number"), F.desc("saved_at"), F.desc("folder")).first()


def save(root: str, name: str, tables: dict[str, DataFrame], params: dict | None = None,
         losses: Sequence[float] = (), singular: Sequence[float] = ()) -> int:
    """Write ``tables`` and list them as the next number of ``name``."""
    spark = next(iter(tables.values())).sparkSession
    folder = uuid.uuid4().hex
    for t, df in tables.items():
        df.write.parquet(f"{root}/tables/{folder}/{t}")
    before = _newest(spark, root, name)
    number = before.number + 1 if before else 1
    row = (name, number, folder, list(tables), {k: str(v) for k, v in (params or {}).items()},
           [float(x) for x in losses], [float(x) for x in singular])
    listed = spark.createDataFrame([row], VERSIONS.rpartition(",")[0]).withColumn("saved_at", F.current_timestamp())
    listed.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return number


def load(spark: SparkSession, root: str, name: str, number: int | None = None) -> Saved:
    """The given version, or the newest; ``KeyError`` where there is none."""
    row = _newest(spark, root, name, number)
    if row is None:
        raise KeyError(f"no version {number or ''} of {name!r} under {root}")
    tables = {t: spark.read.parquet(f"{root}/tables/{row.folder}/{t}") for t in row.tables}
    return Saved(row.number, tables, row.params, row.losses, row.singular)


def save_factors(root: str, name: str, model: FactorModel, params: dict | None = None,
                 encoders: dict[str, DataFrame] | None = None) -> int:
    """Factor tables with the encoders that their codes come from, under one number."""
    tables = {"users": model.users, "items": model.items} | {_ENCODER + c: m for c, m in (encoders or {}).items()}
    return save(root, name, tables, params, model.losses, model.values)
