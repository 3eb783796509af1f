"""The durable run ledger: a Parquet store with upsert, ordered scans and JSON lines exchange."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quire import schemas


class FormatMismatch(Exception):
    """The store was written by a newer layout (exit code 7)."""


class MalformedLine(ValueError):
    """A JSON line that isn't a run record; carries its 1-based physical line number."""


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the last in ``order``, replaced as a whole, nulls included."""
    line = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() if hasattr(o, "desc_nulls_last") else F.col(o).desc_nulls_last() for o in order])
    return rows.withColumn("_nth", F.row_number().over(line)).where("_nth = 1").drop("_nth")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``base`` with rows of ``changes`` put in place of those with the same keys. Among changes with equal keys
    the last by ``order`` wins (without an order they must be unique)."""
    new = latest(changes, keys, [order]) if order else changes
    kept = base.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(*base.columns))


def top_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The latest runs first, equal times by descending id; a negative limit is 0. Plans as a bounded top-k, not a sort."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(max(0, limit))


def canonical(runs: DataFrame) -> DataFrame:
    return runs.orderBy("run_id")


def document(runs: DataFrame, command: str, store: str) -> DataFrame:
    """One JSON document with count and runs, in canonical order; an empty history has count 0."""
    names = sorted(f.name for f in schemas.RUNS)
    record = F.struct(F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), *names)
    # one document is one row by contract; used for listings that were cut by a limit
    packed = runs.agg(F.sort_array(F.collect_list(F.struct("run_id", record.alias("r")))).alias("rows"))
    body = F.struct(F.lit(command).alias("command"), F.size("rows").alias("count"), F.transform("rows", lambda x: x["r"]).alias("runs"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.lit(store).alias("store"))
    return packed.select(F.to_json(body).alias("document"))


def decode(rows: DataFrame, values: str) -> DataFrame:
    """Run records from rows of texts by place: a row of fewer than nine is dropped, a whole number that can't be read is 0
    (a null finished_at stays null), any other null an empty text."""
    names = [f.name for f in schemas.RUNS]
    at = lambda i: F.get(F.col(values), i)
    whole = lambda i: F.coalesce(at(i).try_cast("long"), F.lit(0).cast("long"))
    read = {f.name: whole(i) if isinstance(f.dataType, T.LongType) else F.coalesce(at(i), F.lit("")) for i, f in enumerate(schemas.RUNS)}
    read["finished_at"] = F.when(at(names.index("finished_at")).isNotNull(), read["finished_at"])
    return rows.where(F.size(values) >= len(names)).select(*[read[n].alias(n) for n in names])


def plain_lines(runs: DataFrame) -> DataFrame:
    """run_id, line: a run as a line of text for people."""
    return runs.select("run_id", F.concat_ws("  ", "run_id", "status", "mode", F.concat(F.lit("exit "), F.col("exit_code").cast("string")), "quant", "input_path").alias("line"))


def json_lines(runs: DataFrame) -> DataFrame:
    """run_id, line: a run as a JSON object, keys in alphabetical order, nulls written."""
    names = sorted([f.name for f in schemas.RUNS] + ["schema_version"])
    held = runs.withColumn("schema_version", F.lit(schemas.SCHEMA_VERSION))
    return held.select("run_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))


class RunStore:
    """A folder with a meta record and versions of the runs table; the newest complete version is current.

    A write makes a new version beside the old one and then names it in a new meta file, so readers and failed
    writes never see half a table.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = (path or os.environ.get("QUIRE_RUN_STORE") or os.path.expanduser("~/.cache/quire/runs")).rstrip("/")

    def _metas(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("schema_version int, version long, folder string").json(f"{self.path}/_meta")
        except AnalysisException:
            return None

    def exists(self) -> bool:
        return self._metas() is not None

    def _current(self) -> tuple[int, str] | None:
        metas = self._metas()
        row = metas.orderBy(F.col("version").desc()).first() if metas is not None else None
        if row is None:
            return None
        if row.schema_version > schemas.STORE_VERSION:
            raise FormatMismatch(f"store schema {row.schema_version} is newer than {schemas.STORE_VERSION}")
        if row.schema_version < schemas.STORE_VERSION:
            raise FormatMismatch(f"no migration from store schema {row.schema_version}")
        return row.version, row.folder

    def runs(self) -> DataFrame:
        now = self._current()
        if now is None:
            return self.spark.createDataFrame([], schemas.RUNS)
        return self.spark.read.schema(schemas.RUNS).parquet(f"{self.path}/{now[1]}")

    def write(self, changes: DataFrame, order: str | None = None) -> None:
        now = self._current()
        merged = upsert(self.runs(), changes, ["run_id"], order)
        version, folder = (now[0] + 1 if now else 1), f"runs-{uuid.uuid4().hex}"
        merged.write.parquet(f"{self.path}/{folder}")
        meta = self.spark.range(1).select(F.lit(schemas.STORE_VERSION).alias("schema_version"), F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"))
        meta.coalesce(1).write.mode("append").json(f"{self.path}/_meta")

    def run(self, run_id: str) -> DataFrame:
        return self.spark.sql("SELECT * FROM {runs} WHERE run_id = :id", args={"id": run_id}, runs=self.runs())

    def list(self, limit: int = 20) -> DataFrame:
        return top_runs(self.runs(), limit)


def export_jsonl(runs: DataFrame, path: str) -> int:
    """Canonical order, keys in alphabetical order, nulls written; returns the number of rows.

    The folder appears by the writer's commit. Range partitioning keeps the order across its files.
    """
    names = sorted([f.name for f in schemas.RUNS] + ["schema_version"])
    rows = runs.withColumn("schema_version", F.lit(schemas.SCHEMA_VERSION)).orderBy("run_id").select(*names)
    rows.write.option("ignoreNullFields", "false").json(path)
    return runs.sparkSession.read.text(path).count()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, line_no (1-based, physical). Files are still read in blocks: a line's number is its place in its
    block plus the lines of the file's earlier blocks."""
    text = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    placed = text.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    counts = text.groupBy("file", "block").count()
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, ["file", "block"]).select("file", "line", (F.col("start") + F.col("place")).cast("long").alias("line_no"))


def import_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Run records with the physical line they stand on. Blank lines are skipped; any malformed line fails with the
    number of the first; a missing or null finished_at is null. schema_version isn't checked."""
    names = [f.name for f in schemas.RUNS]
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schemas.RUNS] + [T.StructField("_bad", T.StringType())])
    lines = numbered_lines(spark, path)
    parsed = lines.where(F.regexp_replace("line", "\\s", "") != "").withColumn("r", F.from_json("line", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    required = [f.name for f in schemas.RUNS if not f.nullable]
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    for n in required:
        bad = bad | F.col(f"r.{n}").isNull()
    first = parsed.where(bad).select("file", F.col("line_no").alias("n")).orderBy("file", "n").first()
    if first is not None:
        raise MalformedLine(f"line {first.n} of {first.file} isn't a run record")
    return parsed.select(*[F.col(f"r.{n}").alias(n) for n in names], "line_no")
