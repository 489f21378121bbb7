"""Archives as a data source, and the import of price exports from them.

Each member of each archive is a partition, so members are read in parallel and
none is extracted to a disk.  Archives lie in a folder that all executors see.
"""

from __future__ import annotations

import glob
import json
import math
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators import geometry as Geo
from ..operators import kit as K
from . import files

_SCHEMA = "archive string, member string, line long, value string"
#: Lines of a batch.
_LINES = 10_000

#: Members of an export, the field that is taken, the utility of
#: each view where another is best, and that of the best one.
MANIFEST, AUDIT, LONG_TABLE, FIELD = "adapter_manifest.json", "adapter_audit.json", "bdh_daily_long.csv", "PX_LAST"
UTILITIES, BEST_UTILITY = (("moments", 0.45), ("occupancy", 0.56), ("raster", 0.63), ("point", 0.70), ("abstain", 0.0)), 0.84
#: Fall from a peak, and two volatilities, from which on a view is best.
FALL, VOLATILE, LIVELY = 0.18, 0.018, 0.010


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: archives are read from a folder that all executors see")
    return path


def _refused(name: str) -> bool:
    at = PurePosixPath(name.replace("\\", "/"))
    return at.is_absolute() or ".." in at.parts or (len(name) > 1 and name[1] == ":")


@dataclass
class _Member(InputPartition):
    archive: str
    member: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only = _local(options["path"]), options.get("member")

    def partitions(self) -> list[_Member]:
        archives = sorted(glob.glob(os.path.join(self.path, "*.zip"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not archives:
            raise FileNotFoundError(self.path)
        out = []
        for archive in archives:
            with zipfile.ZipFile(archive) as z:
                names = [i.filename for i in z.infolist() if not i.is_dir()]
            bad = sorted(n for n in names if _refused(n))
            if bad:
                raise ValueError(f"{archive} has members outside of its folder: {', '.join(bad)}")
            out += [_Member(archive, n) for n in names if self.only is None or PurePosixPath(n).name == self.only]
        return out

    def read(self, partition: _Member | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Member):  # where no member fits, Spark asks once for none
            return
        with zipfile.ZipFile(partition.archive) as z, z.open(partition.member) as f:
            lines: list[str] = []
            at = 0

            def batch() -> pa.RecordBatch:
                n = len(lines)
                arrays = [pa.array([x] * n, pa.string()) for x in (partition.archive, partition.member)]
                return pa.RecordBatch.from_arrays([*arrays, pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.string())], ["archive", "member", "line", "value"])

            for raw in f:
                lines.append(raw.rstrip(b"\r\n").decode("utf-8-sig" if at == 0 and not lines else "utf-8", "replace"))
                if len(lines) == _LINES:
                    yield batch()
                    at += len(lines)
                    lines = []
            if lines:
                yield batch()


@dataclass
class _Written(WriterCommitMessage):
    made: str | None


class _Writer(DataSourceWriter):
    """One archive a task, under a name that readers pass over until the job commits."""

    def __init__(self, options: dict):
        self.path = _local(options["path"])

    def write(self, iterator) -> _Written:
        lines: dict[str, list[tuple[int, str]]] = {}
        for row in iterator:
            if _refused(row["member"]):
                raise ValueError(f"a member outside of its folder: {row['member']}")
            lines.setdefault(row["member"], []).append((row["line"], row["value"] or ""))
        if not lines:
            return _Written(None)
        os.makedirs(self.path, exist_ok=True)
        at = os.path.join(self.path, f"{uuid.uuid4().hex}.zip.tmp")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for member in sorted(lines):
                z.writestr(member, "".join(f"{v}\n" for _, v in sorted(lines[member])))
        return _Written(at)

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.made:
                os.replace(m.made, m.made.removesuffix(".tmp"))

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.made and os.path.exists(m.made):
                os.remove(m.made)


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(path)``: (archive, member, line,
    value) of the text members of zip archives, a file or all in a folder.

    The option ``member`` picks members of one file name.  An archive with a
    member that would lie outside of its folder is refused, with the member's
    name.  Writing (member, line, value) makes an archive of each task's rows,
    which are held in memory: deal them out by member.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def members(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(archive, member, line, value) of archives, or of one member's name in them."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("archive")
    return (reader.option("member", member) if member else reader).load(path)


def _document(spark: SparkSession, path: str, member: str) -> dict:
    """The JSON of a small member that there must be one of."""
    rows = members(spark, path, member).select("archive", "member", "line", "value").limit(100_000).collect()
    if len({(r["archive"], r["member"]) for r in rows}) != 1:
        raise ValueError(f"one {member} is asked for")
    return json.loads("\n".join(r["value"] for r in sorted(rows, key=lambda r: r["line"])))


def price_panel(spark: SparkSession, path: str, field: str = FIELD) -> DataFrame:
    """(security, date, price) of the long tables in the archives; columns are
    found by the names in each table's first line."""
    lines = members(spark, path, LONG_TABLE)
    names = F.transform(F.split("value", ","), lambda c: F.lower(F.trim(F.replace(c, F.lit('"'), F.lit("")))))
    heads = lines.where("line = 0").select("archive", "member", names.alias("names"))  # a row a table
    cells = F.transform(F.regexp_extract_all("value", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"')))
    of = lambda name: F.get("cells", (F.array_position("names", name) - 1).cast("int")).alias(name)
    rows = lines.where("line > 0").join(F.broadcast(heads), ["archive", "member"]).withColumn("cells", cells)
    return files.prices(rows.select(of("security"), F.expr("try_cast(get(cells, cast(array_position(names, 'date') - 1 as int)) as date)").alias("date"), of("field"), of("value"), F.struct("archive", "member", "line").alias("line")).where("security <> '' and date is not null"), field)


def window_views(points: DataFrame) -> DataFrame:
    """(cell, start, view): the best view of each window of prices (cell, start,
    idx, price), by its largest fall and its volatility."""
    along = Window.partitionBy("cell", "start").orderBy("idx")
    peak = F.max("price").over(along.rowsBetween(Window.unboundedPreceding, 0))
    path = points.withColumn("_f", (peak - F.col("price")) / peak).withColumn("_r", F.log("price") - F.log(F.lag("price").over(along)))
    per = path.groupBy("cell", "start").agg(F.max("_f").alias("_f"), F.coalesce(F.sqrt(F.avg(F.col("_r") * F.col("_r"))), F.lit(0.0)).alias("_v"))
    return per.select("cell", "start", F.when(F.col("_f") >= FALL, "point").when(F.col("_v") >= VOLATILE, "raster").when(F.col("_v") >= LIVELY, "occupancy").otherwise("moments").alias("view"))


@dataclass(frozen=True)
class Imported:
    """What an import makes: the export's own manifest and audit, prices, cells
    as methods see them, what the evaluator keeps, and what may be seen."""

    manifest: dict
    audit: dict
    panel: DataFrame
    public: DataFrame
    hidden: DataFrame
    visibility: dict


def import_export(spark: SparkSession, path: str, most_cells: int = 96, size: int = 64) -> Imported:
    """Archive to manifest and audit, to panel, to cells.

    Each series with ``size`` prices or more gives evenly spaced windows, three
    at least and as many as share ``most_cells`` out; cells are numbered by
    series and start up to ``most_cells``.  An export without its manifest, its
    audit or any window is refused.
    """
    manifest, audit = _document(spark, path, MANIFEST), _document(spark, path, AUDIT)
    panel = price_panel(spark, path)
    series = panel.select(F.col("security").alias("cell"), F.row_number().over(Window.partitionBy("security").orderBy("date")).cast("long").alias("idx"), "date", "price")
    enough = series.groupBy("cell").agg(F.max("idx").alias("n")).where(F.col("n") >= size).select("cell")
    n = enough.count()
    if not n:
        raise ValueError(f"no series of {size} prices in {LONG_TABLE}")
    series = series.join(enough, "cell", "left_semi")
    points = Geo.price_windows(series.select("cell", "idx", "price"), size, max(3, math.ceil(most_cells / n)))
    numbered = points.select("cell", "start").distinct().orderBy("cell", "start").limit(most_cells)
    numbered = numbered.withColumn("k", F.row_number().over(Window.orderBy("cell", "start")) - 1)  # most_cells rows at most
    points = points.join(F.broadcast(numbered), ["cell", "start"])
    views = window_views(points)
    made = Geo.moments(points.select(F.col("k").cast("long").alias("cell"), "idx", "x", "y")).withColumnRenamed("cell", "k")
    ends = numbered.join(series.select("cell", "idx", "date"), "cell").where((F.col("idx") > F.col("start")) & (F.col("idx") <= F.col("start") + size)).groupBy("k").agg(F.min("date").alias("source_start"), F.max("date").alias("source_end"))
    r = lambda c: F.round(c, 6)
    summary = F.struct(F.array(r("mx"), r("my")).alias("mean"), F.array(F.array(r("vxx"), r("vxy")), F.array(r("vxy"), r("vyy"))).alias("covariance"), F.col("n").alias("n_points"))
    utilities = F.create_map(*[x for v, u in UTILITIES for x in (F.lit(v), F.when(F.col("view") == v, BEST_UTILITY).otherwise(u))])
    cells = numbered.join(views, ["cell", "start"]).join(made, "k").join(ends, "k").select(
        F.format_string("bbg_%03d", F.col("k").cast("int")).alias("cell_id"), F.lit("optional import").alias("protocol"), F.col("n").alias("n_points"), summary.alias("summary"),
        F.col("cell").alias("source_security"), "source_start", "source_end", F.col("view").alias("oracle_view"), utilities.alias("view_utilities"),
    )
    public, hidden = K.split_hidden(cells)
    visibility = {"n_cells": numbered.count(), "public_fields": public.columns, "evaluator_only_fields": [c for c in hidden.columns if c != "cell_id"], "status": manifest.get("status"), "audit_status": audit.get("status")}
    return Imported(manifest, audit, panel, public, hidden, visibility)
