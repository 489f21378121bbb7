"""JSON lines, CSV, Markdown, price panels, archives and synthetic packs."""

from __future__ import annotations

import hashlib
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file, its ``raw`` lines and ``bad`` flags beside them.

    Blank lines are skipped.  Strict: a line that isn't a JSON object raises
    when it is read; else its columns are null and ``bad`` is true.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "raw")
    parsed = lines.withColumn("_v", F.try_parse_json("raw")).withColumn("bad", F.coalesce(~F.schema_of_variant("_v").startswith("OBJECT"), F.lit(True)))
    typed = parsed.withColumn("_r", F.from_json("raw", schema)).drop("_v")
    out = typed.select("raw", "bad", *[F.col("_r")[f.name].alias(f.name) for f in schema.fields])
    if strict:
        fault = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("raw", 1, 80)))).otherwise(F.lit(False))
        out = out.withColumn("bad", fault.cast("boolean"))
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """All rows as one JSON array, keys in order; for documents of a bounded
    size, such as menus and summaries, as it is written by one task."""
    rows = F.array_sort(F.collect_list(F.struct(*sorted(df.columns))))
    df.agg(F.to_json(rows).alias("value")).coalesce(1).write.text(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def write_csv(parts: list[DataFrame], path: str) -> None:
    """Rows of all parts under the sorted union of their columns."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    whole.select(*sorted(whole.columns)).write.option("header", True).csv(path)


def prices(rows: DataFrame, field: str = "PX_LAST") -> DataFrame:
    """(security, date, price) of a long table (security, date, field, value,
    line): positive finite numbers, the last line of a day wins."""
    value = F.expr("try_cast(regexp_replace(value, ',', '') as double)")
    fine = rows.where(F.col("field") == field).withColumn("_p", value).where(F.col("_p") > 0).where(F.col("_p") < float("inf"))
    return fine.groupBy("security", "date").agg(F.max_by("_p", "line").alias("price"))


def wide_panel(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(date, security|field ...) of a long table; columns are named ahead."""
    key = F.concat_ws("|", "security", "field")
    return rows.groupBy("date").pivot("_key", columns).agg(F.first("value")) if "_key" in rows.columns else wide_panel(rows.withColumn("_key", key), columns)


def markdown(df: DataFrame, order: list[Column]) -> DataFrame:
    """(line, text) of a Markdown table: four digits, trailing zeros cut."""
    def cell(f: T.StructField) -> Column:
        c = F.col(f.name)
        shown = F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.replace(c.cast("string"), F.lit("|"), F.lit(r"\|"))
        return F.coalesce(shown, F.lit(""))

    body = df.withColumn("line", F.row_number().over(Window.orderBy(*order)) + 1).select("line", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in df.schema.fields]), F.lit(" |")).alias("text"))
    head = [(0, "| " + " | ".join(df.columns) + " |"), (1, "| " + " | ".join(["---"] * len(df.columns)) + " |")]
    return df.sparkSession.createDataFrame(head, "line int, text string").unionByName(body)


def unzip_safely(archive: str, into: str) -> list[str]:
    """Extracts an archive; a member that would leave the folder is refused."""
    root = Path(into).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} lies outside of the folder")
        z.extractall(root)
        return z.namelist()


def inventory(spark: SparkSession, path: str, roles: list[tuple[str, str]] | None = None, exclude: list[str] | None = None, other: str = "file") -> DataFrame:
    """(path, role, bytes, sha256) of the files under a folder, paths relative
    to it.

    ``roles`` are (prefix, role), the first that fits counts, a prefix of ``/``
    standing for files at the top; ``exclude`` are patterns of relative paths
    that are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = f"{path.rstrip('/')}/"
    named = files.withColumn("path", F.element_at(F.split("path", root, 2), -1))
    for pattern in exclude or []:
        named = named.where(~F.col("path").rlike(pattern))
    role = F.lit(other)
    for prefix, name in reversed(roles or []):
        fits = ~F.contains("path", F.lit("/")) if prefix == "/" else F.startswith(F.col("path"), F.lit(prefix))
        role = F.when(fits, name).otherwise(role)
    return named.select("path", role.alias("role"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lookup(catalog: DataFrame, key: str, value: str) -> dict:
    """The catalog's row of a name; a ``KeyError`` if there's none."""
    row = catalog.where(F.col(key) == value).first()
    if row is None:
        raise KeyError(value)
    return row.asDict(recursive=True)


def synthetic_pack(spark: SparkSession, rows: int, seed: int, views: list[tuple[str, float]]) -> DataFrame:
    """(query_id, cell_id, view, cost, score): a deterministic evaluation pack;
    dearer views score higher on the whole."""
    table = spark.createDataFrame([(v, c) for v, c in views], "view string, cost double")
    key = F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), "view")
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    every = spark.range(rows).crossJoin(F.broadcast(table))
    return every.select(
        F.concat(F.lit("q"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("query_id"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("cell_id"),
        "view", "cost", F.round(F.least(F.lit(1.0), 0.25 + 0.4 * F.col("cost") + 0.5 * u), 6).alias("score"),
    )


def sha256_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def select_collection(docs: DataFrame, queries: DataFrame, qrels: DataFrame, max_docs: int, max_queries: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judged queries up to a number, all their relevant documents and others in
    hash order up to a number; judgements among those only."""
    order = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))
    judged = queries.join(qrels.where("rel > 0").select("qid").distinct(), "qid", "left_semi").orderBy(order("qid"), "qid").limit(max_queries)
    wanted = qrels.where("rel > 0").join(judged.select("qid"), "qid", "left_semi")
    relevant = docs.join(wanted.select("did").distinct(), "did", "left_semi")
    rest = docs.join(wanted.select("did").distinct(), "did", "left_anti").orderBy(order("did"), "did").limit(max(0, max_docs - relevant.count()))
    kept = relevant.unionByName(rest)
    return kept, judged, wanted.join(kept.select("did"), "did", "left_semi")
