"""State of a streaming job in tables: what each step reads, replaces and records.

A step is one batch that was worked off. Its rows go to ``target/<name>/step=k``, its state to one of two slots in turn, and last of
all its record to ``target/steps``. A step that ends early leaves no record, so the next attempt writes over what it left; the
state it started from is in the other slot. Nothing hangs on the epoch numbers of a query, so a query with a new
checkpoint goes on where the last one stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

RECORD = "step long, epoch long, n_rows long, n_state long, horizon timestamp"


def held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with ``schema``, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Step:
    """One step of a job: number, tables of those before it, and what it leaves."""

    def __init__(self, spark: SparkSession, target: str, epoch: int):
        self.spark, self.target, self.epoch = spark, target, epoch
        last = held(spark, f"{target}/steps", RECORD).orderBy(F.desc("step")).first()
        self.number: int = last.step + 1 if last else 0
        self.before: Row | None = last
        self.horizon = last.horizon if last else None

    def rows(self, name: str, schema: str) -> DataFrame:
        """What earlier steps wrote under a name, with their ``step``."""
        return held(self.spark, f"{self.target}/{name}", f"{schema}, step long").where(F.col("step") < self.number)

    def state(self, schema: str) -> DataFrame:
        if self.before is None:
            return self.spark.createDataFrame([], schema)
        return held(self.spark, f"{self.target}/state/slot={(self.number + 1) % 2}", schema)

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.target}/{name}/step={self.number}")

    def end(self, state: DataFrame, n_rows: int, horizon: object) -> None:
        """Replace the state, then record the step."""
        path = f"{self.target}/state/slot={self.number % 2}"
        state.write.mode("overwrite").parquet(path)
        n_state = self.spark.read.schema(state.schema).parquet(path).count()
        record = self.spark.createDataFrame([(self.number, self.epoch, n_rows, n_state, horizon)], RECORD)
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.target}/steps/step={self.number}")


def steps(spark: SparkSession, target: str) -> DataFrame:
    """The records of all steps that ended."""
    return held(spark, f"{target}/steps", RECORD)
