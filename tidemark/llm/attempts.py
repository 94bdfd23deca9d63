"""Which writes of a state folder count.

Every change of a state is an attempt with a number of its own, written into each row. A mark is
made when it begins and another when it is done; rows of attempts that never came to the second
mark are not read. So a state can be opened again after a crash, and the change is made again.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.session import folder_names, make_folder


class Attempts:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        begun, done = (folder_names(spark, f"{path}/{x}") for x in ("begun", "done"))
        self.number = len(begun)
        self.broken = [int(x) for x in begun if x not in set(done)]

    def begin(self) -> int:
        make_folder(self.spark, f"{self.path}/begun/{self.number:08d}")
        return self.number

    def finish(self) -> None:
        make_folder(self.spark, f"{self.path}/done/{self.number:08d}")
        self.number += 1

    def done(self, also_now: bool = False) -> Column:
        """Rows of finished attempts, and of the one that runs if ``also_now``."""
        c = F.col("attempt") <= self.number if also_now else F.col("attempt") < self.number
        return c & ~F.col("attempt").isin(self.broken) if self.broken else c
