"""Capping records per contributor, load by load, with incremental state.

The state is a folder: per (load, contributor) the kept records and the cutoff, which is the worst
kept record of a full list, and the log of displaced ones. A delivery is first filtered against the
cutoffs of its own groups, the rest is merged with their kept records and ranked, and what falls
out is logged. Only the groups a delivery brings are read and written: rows lie in parts by hash of
the load, and a group's latest rows are the ones that count. Since the cap of a load is known
beforehand, a record once out can't come back, so any split into deliveries ends the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.attempts import Attempts
from tidemark.operators.ranks import running
from tidemark.session import durable, folder_names, new_path, release

GROUP = ["load", "contributor"]
#: Parts of the state by hash of the load.
PARTS = 16


def load_caps(items: DataFrame, load: str, share: int) -> DataFrame:
    """(load, cap): floor(rows of the load / share), at least 1; all rows count."""
    return items.groupBy(F.col(load).alias("load")).agg(F.greatest(F.floor(F.count(F.lit(1)) / share), F.lit(1)).cast("long").alias("cap"))


def _worse() -> Column:
    """A record ranks after its group's cutoff: null quality last, then lower quality, then the greater id."""
    null, cut_null = F.col("quality").isNull().cast("int"), F.col("cut_q").isNull().cast("int")
    q, cut_q = F.coalesce("quality", F.lit(0.0)), F.coalesce("cut_q", F.lit(0.0))
    return (null > cut_null) | ((null == cut_null) & ((q < cut_q) | ((q == cut_q) & (F.col("record_id") > F.col("cut_id")))))


@dataclass
class CapState:
    """A state folder, new or opened again. A delivery that was broken off leaves nothing that is read, and is simply given again."""

    spark: SparkSession
    path: str = ""
    parts: int = PARTS
    _attempts: Attempts = field(init=False)

    #: Tables of the state.
    COLUMNS = {"kept": "record_id bigint, quality double", "cutoffs": "kept_n bigint, cut_q double, cut_id bigint", "log": "record_id bigint"}

    def __post_init__(self) -> None:
        self.path = self.path or new_path(self.spark, "caps")
        self._attempts = Attempts(self.spark, self.path)

    def _write(self, df: DataFrame, name: str) -> None:
        df.withColumn("part", F.pmod(F.xxhash64("load"), F.lit(self.parts)).cast("int")).write.partitionBy("part").parquet(f"{self.path}/{name}/attempt={self._attempts.number}")

    def _read(self, name: str) -> DataFrame:
        """What finished deliveries wrote, with part and attempt."""
        at = f"{self.path}/{name}"
        schema = f"load bigint, contributor bigint, {self.COLUMNS[name]}, part int, attempt int"
        if not folder_names(self.spark, at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", at).parquet(at).where(self._attempts.done())

    def kept(self) -> DataFrame:
        """(load, contributor, record_id, quality) of all records kept."""
        last = self._read("cutoffs").groupBy(*GROUP).agg(F.max("attempt").alias("attempt"))
        return self._read("kept").join(last, [*GROUP, "attempt"], "left_semi").select(*GROUP, "record_id", "quality")

    def cutoffs(self) -> DataFrame:
        """(load, contributor, kept_n, cut_q, cut_id): of each group the number kept and the worst of them."""
        c = F.max_by(F.struct("kept_n", "cut_q", "cut_id"), "attempt").alias("c")
        return self._read("cutoffs").groupBy(*GROUP).agg(c).select(*GROUP, "c.*")

    def log(self) -> DataFrame:
        """(load, contributor, record_id): records rejected or displaced."""
        return self._read("log").select(*GROUP, "record_id")

    def merge(self, delivery: DataFrame, caps: DataFrame) -> None:
        """Takes in a delivery of (load, contributor, record_id, quality); ``caps`` has (load, cap).

        Rows without contributor or load are never capped and don't enter the state. NaN quality counts as null; null ranks
        last; ties keep the smaller record_id. A contributor of any size is ranked over many tasks. An empty delivery
        changes nothing. Other columns are ignored.
        """
        number = self._attempts.begin()
        new = delivery.where("contributor is not null and load is not null").select(*[F.col(c).cast("long") for c in (*GROUP, "record_id")], F.when(~F.isnan("quality"), F.col("quality")).alias("quality")).join(caps, "load")
        if number:
            new = durable(new, "delivery")
            met = durable(new.groupBy("load", "contributor").agg(F.max("cap").alias("cap")), "met")
            parts = [r.part for r in met.select(F.pmod(F.xxhash64("load"), F.lit(self.parts)).cast("int").alias("part")).distinct().collect()]
            # of the state only the parts the delivery's loads lie in, and of these only its groups
            here = F.col("part").isin(parts)
            cut = self._read("cutoffs").where(here).join(met, GROUP)
            cut = durable(cut.groupBy(*GROUP).agg(F.max("cap").alias("cap"), F.max("attempt").alias("attempt"), F.max_by(F.struct("kept_n", "cut_q", "cut_id"), "attempt").alias("c")).select(*GROUP, "cap", "attempt", "c.*"), "cut")
            full = cut.where("kept_n >= cap").select(*GROUP, "cut_q", "cut_id")
            probe = durable(new.join(full, GROUP, "left").withColumn("out", F.col("cut_id").isNotNull() & _worse()).drop("cut_q", "cut_id"), "probe")
            out = probe.where("out").select(*GROUP, "record_id")
            alive = probe.where("not out").drop("out")
            old = self._read("kept").where(here).join(cut.select(*GROUP, "attempt", "cap"), [*GROUP, "attempt"]).join(alive.select(*GROUP).distinct(), GROUP, "left_semi")
            new = alive.unionByName(old.select(alive.columns))
        new = durable(new, "merge")
        over = new.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"), F.max("cap").alias("_cap")).where("_n > _cap").select(*GROUP)
        fits = new.join(over, GROUP, "left_anti").drop("cap")
        ranked = durable(running(new.join(over, GROUP, "left_semi"), GROUP, [F.col("quality").isNull(), F.col("quality").desc(), F.col("record_id")]), "ranked")
        kept = durable(fits.unionByName(ranked.where("_rank <= cap").select(fits.columns)), "kept")
        self._write(kept, "kept")
        # greatest in this order is worst: null quality, then the lower, then the greater id
        worst = F.max_by(F.struct("quality", "record_id"), F.struct(F.col("quality").isNull().alias("a"), (-F.coalesce("quality", F.lit(0.0))).alias("b"), F.col("record_id").alias("c")))
        cut_now = kept.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("kept_n"), worst.alias("w"))
        self._write(cut_now.select(*GROUP, "kept_n", F.col("w.quality").alias("cut_q"), F.col("w.record_id").alias("cut_id")), "cutoffs")
        gone = ranked.where("_rank > cap").select(*GROUP, "record_id")
        self._write(gone.unionByName(out) if number else gone, "log")
        self._attempts.finish()
        release(*([met, cut, probe] if number else []), new, ranked, kept)


def latest_quality(report: DataFrame) -> DataFrame:
    """(record_id, quality): avg_confidence of the latest row (generated_at, then report_row_id) with a value from 0 to 1."""
    ok = report.where("avg_confidence between 0 and 1 and not isnan(avg_confidence) and top_news_id is not null")
    return ok.groupBy(F.col("top_news_id").alias("record_id")).agg(F.max_by("avg_confidence", F.struct("generated_at", "report_row_id")).alias("quality"))
