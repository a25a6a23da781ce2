"""Retention of the event log: settled days move to a gzip archive, old archive days go.

Both steps change files through the cluster's own file system, so they work on any storage that Spark reads.  A day's archive is written beside
the archive and gets its name by one rename, together with the list of the files it was made from (below ``_sources``).  What a lost run leaves is told from
these lists: files already in the archive are removed and not archived again, files of an unfinished archive are still in the log.  A
repeated run changes nothing.  One process at a time may rotate a log.

Defined cases: a missing folder or an empty log rotates and prunes nothing; folders without a date are left alone.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.events import EVENT_SCHEMA

FILES = "path string, day date, bytes long"


@dataclass(frozen=True)
class Rotated:
    files: int
    days: int
    #: files that an earlier, lost run had archived and not yet removed
    left_over: int


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, day, bytes) of the files below folders ``date=…``; names and sizes only, no content is read."""
    fs, p = _path(spark, folder)
    if not fs.exists(p):
        return spark.createDataFrame([], FILES)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    day = F.try_to_timestamp(F.regexp_extract("path", "/date=([0-9-]+)/", 1), F.lit("yyyy-MM-dd")).cast("date")
    return d.select("path", day.alias("day"), F.col("length").alias("bytes")).where(F.col("day").isNotNull())


def archived_sources(spark: SparkSession, archive_dir: str) -> DataFrame:
    """Paths of the log files that the archive already holds."""
    try:
        return spark.read.text(f"{archive_dir}/date=*/batch=*/_sources").select(F.col("value").alias("path")).where("path <> ''")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")


def _remove(spark: SparkSession, files: DataFrame) -> int:
    """Delete by name, one listed row after the other; the driver holds one batch of names."""
    n = 0
    for r in files.select("path").toLocalIterator():
        fs, p = _path(spark, r.path)
        n += bool(fs.delete(p, False))
    return n


def rotate_events(spark: SparkSession, log_dir: str, archive_dir: str, today: dt.date, max_bytes: int = 1 << 30, max_records: int = 1_000_000) -> Rotated:
    """Archive the days before ``today`` and later days of ``max_bytes`` or more, and remove their files from the log."""
    # the list is fixed first: files that arrive meanwhile belong to the next run
    listing = f"{archive_dir}/_listing-{uuid.uuid4().hex}"
    list_files(spark, log_dir, "*.json").write.parquet(listing)
    listed = spark.read.schema(FILES).parquet(listing)
    done = archived_sources(spark, archive_dir)
    left_over = _remove(spark, listed.join(done, "path", "left_semi"))
    new = listed.join(done, "path", "left_anti")
    full = new.groupBy("day").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).where((F.col("day") < F.lit(today)) | (F.col("b") >= max_bytes))
    files = 0
    days = [r.day for r in full.orderBy("day").collect()]  # one row a day
    for day in days:
        mine = new.where(F.col("day") == F.lit(day)).select("path")
        names = [r.path for r in mine.collect()]  # the files of one day
        batch = uuid.uuid4().hex
        stage = f"{archive_dir}/_staging-{batch}"
        rows = spark.read.schema(EVENT_SCHEMA).json(names)
        rows.write.option("compression", "gzip").option("maxRecordsPerFile", max_records).json(stage)
        fs, p = _path(spark, f"{stage}/_sources/list.txt")
        out = fs.create(p)
        out.write(("\n".join(names) + "\n").encode("utf-8"))
        out.close()
        home = f"{archive_dir}/date={day}"
        fs.mkdirs(_path(spark, home)[1])
        if not fs.rename(_path(spark, stage)[1], _path(spark, f"{home}/batch={batch}")[1]):
            raise OSError(f"the archive of {day} could not be put in place")
        for name in names:
            files += bool(fs.delete(_path(spark, name)[1], False))
    fs, p = _path(spark, listing)
    fs.delete(p, True)
    return Rotated(files, len(days), left_over)


def prune_events(spark: SparkSession, archive_dir: str, today: dt.date, keep_days: int) -> int:
    """Remove the archive's days that are more than ``keep_days`` before ``today``; gives back the number of removed files.

    A day goes by one call on its folder; a day of which a lost run removed a part goes with the next run.
    """
    old = list_files(spark, archive_dir, "*.gz").where(F.datediff(F.lit(today), "day") > keep_days)
    removed = 0
    for r in old.groupBy("day").agg(F.count("*").alias("n")).orderBy("day").collect():  # one row a day
        fs, p = _path(spark, f"{archive_dir}/date={r.day}")
        removed += r.n if fs.delete(p, True) else 0
    return removed
