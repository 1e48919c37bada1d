"""Pages and updates as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import folds


def fresh(pages: DataFrame, at: str = "fetched_at", url: str = "url", body: str = "html", keep: str = "7 days") -> DataFrame:
    """Pages of a stream whose address, and then whose content, did not come within ``keep``.

    State is held by watermark, so it is bounded by what arrives in that time.
    """
    keyed = pages.withColumn("canonical_url", U.canonical(F.col(url))).withColumn("digest", T.content_hash(F.col(body)))
    return keyed.withWatermark(at, keep).dropDuplicatesWithinWatermark(["canonical_url"]).dropDuplicatesWithinWatermark(["digest"])


#: Parts of a kept state; a batch rewrites only those that hold its keys.
BUCKETS = 256


class Upserts:
    """The state of a log under ``path``, kept by ``write`` as a foreachBatch function and read by ``state``.

    Keys lie in buckets by hash; bucket=K/batch=B holds a bucket as batch B left it. A batch is folded with the last state
    of the buckets that hold its keys, and only these are written. Of each bucket the last two states are kept, so a batch
    that is run again begins from what was there before it and gives the same.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], last_wins: list[str], known_wins: list[str] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.last_wins, self.known_wins, self.buckets = spark, path, key, order, last_wins, list(known_wins), buckets

    def _kept(self, before: int | None = None) -> dict[int, list[int]]:
        """The batches of each bucket, in order."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found: dict[int, list[int]] = {}
        for status in jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/bucket=*")) or []:
            batch, bucket = (int(x.partition("=")[2]) for x in str(status.getPath().toString()).rstrip("/").rsplit("/", 2)[1:])
            if before is None or batch < before:
                found.setdefault(bucket, []).append(batch)
        return {k: sorted(v) for k, v in found.items()}

    def _read(self, last: dict[int, int]) -> DataFrame | None:
        if not last:
            return None
        paths = [f"{self.path}/batch={b}/bucket={k}" for k, b in sorted(last.items())]
        return self.spark.read.parquet(*paths).select(*self.key, *self.order, *self.last_wins, *self.known_wins)

    def state(self) -> DataFrame | None:
        """The whole state; None before the first batch."""
        return self._read({k: v[-1] for k, v in self._kept().items()})

    def write(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*self.key, *self.order, *self.last_wins, *self.known_wins)
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in rows.select(bucket.alias("b")).distinct().collect()}  # at most BUCKETS numbers
        earlier = self._kept(batch_id)
        old = self._read({k: v[-1] for k, v in earlier.items() if k in touched})
        both = rows if old is None else rows.unionByName(old)
        state = folds.upserted(both, self.key, self.order, last_wins=[*self.order, *self.last_wins], known_wins=self.known_wins)
        state.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch_id}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for k in touched:
            for stale in earlier.get(k, [])[:-1]:
                target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={stale}/bucket={k}")
                target.getFileSystem(conf).delete(target, True)


def history_sink(path: str, at: str = "updated_at") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends price points to monthly partitions; a batch run again replaces its files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        month = batch.withColumn("month", F.date_format(at, "yyyy_MM"))
        month.write.mode("overwrite").partitionBy("month").parquet(f"{path}/batch={batch_id}")

    return write
