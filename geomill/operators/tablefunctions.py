"""Table functions for SQL: Python UDTFs over partitioned tables, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class NumberRuns:
    """Runs of house numbers in which no step is more than ``step``: (street, first, last, doors).

    ``SELECT * FROM number_runs(TABLE(doors), 4)``: the table has street and number; the function asks for it street by
    street, by number, and holds one run at a time.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in table.dataType.fields] if table.isTable else []
        if not {"street", "number"} <= set(names):
            raise ValueError("number_runs needs a table with the columns street and number")
        if step.value is None or step.value < 0:
            raise ValueError("the step is a constant, 0 or more")
        schema = StructType().add("street", StringType()).add("first", LongType()).add("last", LongType()).add("doors", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("street")], orderBy=[OrderingColumn("number")])

    def __init__(self) -> None:
        self.run: list | None = None

    def eval(self, row, step: int) -> Iterator[tuple]:
        number = row["number"]
        if number is None:
            return
        if self.run is not None and number - self.run[2] <= step:
            self.run[2], self.run[3] = number, self.run[3] + 1
            return
        if self.run is not None:
            yield tuple(self.run)
        self.run = [row["street"], number, number, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("number_runs", udtf(NumberRuns))
