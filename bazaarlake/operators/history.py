"""History of changing attributes, stored as checkpoints and patches.

A log of snapshots and partial updates becomes *patches*: what an update says about a moment, null where it says
nothing. Time is cut in eras; at the start of each era after an entity is known, its full version is stored as a
*checkpoint* beside the era's patches. Batches are appended; a state at a moment is read from one era, and rows of
validity are rebuilt by folding each era's patches forward from its checkpoints.

Within an era time is cut further, in spans of days, so an entity with a third of all updates is folded in many
tasks: only one row per entity and span, never the updates themselves, meets in a window over the whole entity.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, remove_at_exit

#: Days between two full versions of an entity.
ERA_DAYS = 365
#: Days that one task folds of one entity.
SPAN_DAYS = 7

_DAY = 86_400_000_000


def _bucket(at: str, days: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(days * _DAY)).cast("bigint")


def _same(names: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}{n}").eqNullSafe(F.col(f"{right}{n}")) for n in names])


def _told(names: list[str], prefix: str = "") -> list[Column]:
    """The last value of each attribute that is told, by time."""
    return [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("at"))).alias(f"{prefix}{n}") for n in names]


class Store:
    """Checkpoints and patches under ``path``, a folder that all executors share.

    patches/batch=B/era=E has (key, at, received, tie, attributes), checkpoints/batch=B/era=E has (key, attributes):
    every entity's full version at the start of era E as batch B knew it. A batch that is appended again replaces its own
    files and nothing else, so a lost job is run again as it was. Eras in which nothing was said have no files; schema is
    an empty table that tells the columns.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, attributes: list[str], era_days: int = ERA_DAYS, span_days: int = SPAN_DAYS):
        self.spark, self.path, self.key, self.attributes, self.era_days, self.span_days = spark, path, key, list(attributes), era_days, span_days

    def append(self, log: DataFrame, batch: int = 0, at: str = "updated_at", received: str = "received_at", tie: str = "update_id") -> None:
        """Adds the rows of a log: their patches, and the checkpoints that they change or are the first to need.

        Rows may be late: checkpoints of later eras are written anew for the entities of the batch, and those of an era that
        nobody spoke of before for all entities. Batches are numbered in the order in which they are appended.
        """
        before = [e for b, e in self._parts("patches") if b != batch]
        said = patches(log, self.key, self.attributes, at, received, tie)
        if not self._exists(f"{self.path}/schema"):
            # An empty table that tells the columns, also where no patch was ever stored.
            self.spark.createDataFrame([], said.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema")
        said.withColumn("era", _bucket("at", self.era_days)).write.mode("overwrite").option("compression", "zstd").partitionBy("era").parquet(f"{self.path}/patches/batch={batch}")
        mine = [e for b, e in self._parts("patches") if b == batch]
        self._remove(f"{self.path}/checkpoints/batch={batch}")
        if not mine:
            return
        touched = self._read("patches", [(batch, e) for e in mine]).select(self.key).distinct()
        eras = sorted({*before, *mine})
        for era, following in zip(eras, eras[1:], strict=False):
            if following in before and following <= min(mine):
                continue  # nothing was said before its start
            state = self.state(era)
            if following in before:
                state = state.join(touched, self.key, "left_semi")
            state.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/checkpoints/batch={batch}/era={following}")

    def patches(self, era: int | None = None) -> DataFrame:
        """(key, era, at, attributes): the patches of an era or of all, one for each moment whatever the batches that told of it."""
        parts = [(b, e) for b, e in self._parts("patches") if era is None or e == era]
        rows = self._read("patches", parts)
        if len({b for b, _ in parts}) > 1:
            rows = _one_per_moment(rows.withColumn("span", _bucket("at", self.span_days)), self.key, self.attributes)
        return rows.select(self.key, "era", "at", *self.attributes)

    def checkpoints(self, era: int | None = None) -> DataFrame:
        """(key, era, attributes): the full versions at the start of an era or of all, as the last batch left them."""
        parts = [(b, e) for b, e in self._parts("checkpoints") if era is None or e == era]
        rows = self._read("checkpoints", parts)
        if len({b for b, _ in parts}) > 1:
            rows = rows.groupBy(self.key, "era").agg(F.max_by(F.struct(*self.attributes), "batch").alias("v")).select(self.key, "era", "v.*")
        return rows.select(self.key, "era", *self.attributes)

    def state(self, era: int, moment: Column | None = None) -> DataFrame:
        """(key, attributes): the full version of each entity known by the end of an era, or by a moment within it.

        Only this era's checkpoints and patches are read.
        """
        said = self.patches(era)
        said = (said if moment is None else said.where(F.col("at") <= moment)).groupBy(self.key).agg(*_told(self.attributes, "_said_"))
        return self.checkpoints(era).drop("era").join(said, self.key, "full").select(self.key, *(F.coalesce(f"_said_{n}", n).alias(n) for n in self.attributes))

    def as_of(self, moment: dt.datetime) -> DataFrame:
        """(key, attributes): the state at a moment, from the nearest era's checkpoints and its patches up to then.

        Entities of which nothing was said by then have no row. A moment without zone is meant in UTC.
        """
        since = moment.replace(tzinfo=moment.tzinfo or dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
        bucket = since // dt.timedelta(days=self.era_days)
        eras = [e for _, e in self._parts("patches") if e <= bucket]
        at = F.timestamp_micros(F.lit(since // dt.timedelta(microseconds=1)))
        return self.state(max(eras), at) if eras else self._read("checkpoints", []).select(self.key, *self.attributes)

    def versions(self) -> DataFrame:
        """(key, valid_from, valid_to, attributes): maximal periods in which no attribute changes, of the whole history."""
        return reconstruct(self.patches(), self.checkpoints(), self.key, self.attributes, self.span_days)

    def _folder(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _children(self, path: str, name: str) -> list[int]:
        files, target = self._folder(path)
        found = [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
        return sorted(int(n.partition("=")[2]) for n in found if n.startswith(f"{name}=") and n.partition("=")[2].lstrip("-").isdigit())

    def _exists(self, path: str) -> bool:
        files, target = self._folder(path)
        return files.exists(target)

    def _remove(self, path: str) -> None:
        files, target = self._folder(path)
        files.delete(target, True)

    def _parts(self, kind: str) -> list[tuple[int, int]]:
        """The (batch, era) folders there are."""
        return [(b, e) for b in self._children(f"{self.path}/{kind}", "batch") for e in self._children(f"{self.path}/{kind}/batch={b}", "era")]

    def _read(self, kind: str, parts: list[tuple[int, int]]) -> DataFrame:
        """The rows of some folders, with batch and era."""
        whole = self.spark.read.parquet(f"{self.path}/schema").schema
        names = [self.key, *(["at", "_received", "_tie"] if kind == "patches" else []), *self.attributes]
        schema = whole.__class__([whole[n] for n in names])
        if not parts:
            return self.spark.createDataFrame([], schema).select("*", F.lit(0).cast("int").alias("batch"), F.lit(0).cast("bigint").alias("era"))
        paths = [f"{self.path}/{kind}/batch={b}/era={e}" for b, e in parts]
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").schema(schema).parquet(*paths)
        return rows.select(*names, F.col("batch").cast("int").alias("batch"), F.col("era").cast("bigint").alias("era"))


def _one_per_moment(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Of several rows (key, span, at, _received, _tie, attributes) about one moment of an entity the one received last."""
    order = Window.partitionBy(key, "span").orderBy("at", "_received", "_tie", *attributes)
    return rows.withColumn("_next", F.lead("at").over(order)).where("_next is null or _next <> at").drop("_next", "span")


def patches(
    log: DataFrame, key: str, attributes: list[str], at: str = "updated_at", received: str = "received_at", tie: str = "update_id", days: int = SPAN_DAYS
) -> DataFrame:
    """(key, at, _received, _tie, attributes): one patch for each moment of an entity.

    Of several rows about one moment the one received last holds (of equal ones that with the highest
    ``tie``, then the highest attributes, so that repeated deliveries give one result); a null ``received``
    or ``tie`` comes first. Rows without key or moment are left out, other columns are dropped.
    """
    rows = log.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key), F.col(at).alias("at"), F.col(received).alias("_received"), F.col(tie).alias("_tie"), *attributes, _bucket(at, days).alias("span")
    )
    return _one_per_moment(rows, key, attributes)


def reconstruct(patches: DataFrame, checkpoints: DataFrame, key: str, attributes: list[str], days: int = SPAN_DAYS) -> DataFrame:
    """(key, valid_from, valid_to, attributes): maximal periods in which no attribute changes.

    ``patches`` (key, era, at, attributes) of each era are folded forward from its ``checkpoints`` (key, era, attributes).
    valid_to is the start of the next version and null for the last one. An attribute of which nothing has
    been said yet is null; a version of nulls begins with an entity's first row.
    """
    spanned = patches.withColumn("span", _bucket("at", days))
    closing = spanned.groupBy(key, "era", "span").agg(*_told(attributes, "_c_"))
    before = Window.partitionBy(key, "era").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    full = checkpoints.select(key, "era", F.lit(True).alias("_full"), *(F.col(n).alias(f"_full_{n}") for n in attributes))
    opening = closing.join(full, [key, "era"], "left").select(
        key, "era", "span", ((F.count(F.lit(1)).over(before) > 0) | F.coalesce("_full", F.lit(False))).alias("known"),
        *(F.coalesce(F.last(f"_c_{n}", ignorenulls=True).over(before), F.col(f"_full_{n}")).alias(f"_open_{n}") for n in attributes),
    )
    order = Window.partitionBy(key, "era", "span").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = (
        spanned.join(opening, [key, "era", "span"])
        .select(key, "era", "span", "at", "known", *(F.coalesce(F.last(n, ignorenulls=True).over(upto), F.col(f"_open_{n}")).alias(n) for n in attributes), *(f"_open_{n}" for n in attributes))
        .withColumn("_first", F.row_number().over(order) == 1)
        .withColumns({f"_was_{n}": F.when(F.col("_first"), F.col(f"_open_{n}")).otherwise(F.lag(n).over(order)) for n in attributes})
    )
    starts = state.where((F.col("_first") & ~F.col("known")) | ~_same(attributes, "", "_was_")).select(key, "era", "span", "at", *attributes)
    firsts = starts.groupBy(key, "era", "span").agg(F.min("at").alias("_start"))
    following = firsts.select(key, "era", "span", F.lead("_start").over(Window.partitionBy(key).orderBy("era", "span")).alias("_following"))
    return starts.join(following, [key, "era", "span"]).select(
        key, F.col("at").alias("valid_from"), F.coalesce(F.lead("at").over(order), F.col("_following")).alias("valid_to"), *attributes
    )


def store_of(log: DataFrame, key: str, attributes: list[str], era_days: int = ERA_DAYS, span_days: int = SPAN_DAYS, **columns: str) -> Store:
    """A store of a whole log in the shared folder; it is removed when the driver's process ends."""
    spark = log.sparkSession
    path = f"{checkpoint_dir(spark)}/bazaarlake-history-{uuid.uuid4().hex}"
    store = Store(spark, path, key, attributes, era_days, span_days)
    store.append(log, **columns)
    remove_at_exit(spark, path)
    return store


def versions(log: DataFrame, key: str, attributes: list[str], era_days: int = ERA_DAYS, span_days: int = SPAN_DAYS, **columns: str) -> DataFrame:
    """The whole history of a log: it is stored as patches and checkpoints, and versions are rebuilt from the store."""
    return store_of(log, key, attributes, era_days, span_days, **columns).versions()
