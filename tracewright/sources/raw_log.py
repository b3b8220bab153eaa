"""Ordered scan of line-delimited log files, and readers of the text tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.ordering import with_position
from tracewright.operators.storage import FOLDER_SNAPSHOTS


@dataclass(frozen=True)
class LogSource:
    """Where a log's files lie, in their order, and whether missing ones are skipped."""

    root: str
    files: tuple[str, ...] = field(default=())
    skip_missing: bool = False


def existing(spark: SparkSession, source: LogSource) -> list[str]:
    """Full paths of a source's files; a missing file is an error unless it may be skipped."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in source.files:
        path = f"{source.root.rstrip('/')}/{name}"
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            out.append(path)
        elif not source.skip_missing:
            raise FileNotFoundError(path)
    return out


_LOCAL = "^file:/+"  # written with one or three slashes


def _full_path(spark: SparkSession, path: str) -> str:
    """A path as the scan's file metadata names it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(_LOCAL, "file:/", p.getFileSystem(conf).getFileStatus(p).getPath().toUri().toString())


def read_log(spark: SparkSession, source: LogSource) -> DataFrame:
    """(file_ord, line_off, value): the lines of all files; line_off counts lines over the whole log, in log order.

    The text scan is splittable; within a split rows are numbered as they are read, and
    (file, split start, that number) orders the log. Files are told apart by their full paths, so
    two folders may hold files of one name; a file listed twice is read at its first place.
    """
    paths = existing(spark, source)
    if not paths:
        return spark.createDataFrame([], "file_ord int, line_off long, value string")
    places: dict[str, tuple[int, str]] = {}
    for i, p in enumerate(paths):
        places.setdefault(_full_path(spark, p), (i, p))
    order = spark.createDataFrame([(name, i) for name, (i, _) in places.items()], "_name string, file_ord int")
    lines = spark.read.text([p for _, p in places.values()]).select(
        "value",
        F.regexp_replace("_metadata.file_path", _LOCAL, "file:/").alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    named = lines.join(F.broadcast(order), "_name")  # a row per file name
    return with_position(named, "file_ord", "_block", "_line", name="line_off").select("file_ord", "line_off", "value")


def read_event_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, etype, dst, ts_ns) of an event text file, fields separated by a space; blank lines are skipped."""
    return spark.read.csv(path, sep=" ", schema="src long, etype string, dst long, ts_ns long").where("src is not null")


def read_entity_text(spark: SparkSession, path: str, cls: str) -> DataFrame:
    """(entity_id, cls, attr) of lines '<id>: <attribute>'; the attribute may hold colons."""
    rows = spark.read.text(path).where(F.col("value").contains(":"))
    parts = F.split("value", ":", 2)
    return rows.select(F.trim(parts[0]).cast("long").alias("entity_id"), F.lit(cls).alias("cls"), F.ltrim(parts[1]).alias("attr"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id): the distinct first fields of the non-empty lines of a file."""
    first = F.split(F.trim("value"), r"\s+")[0]
    return spark.read.text(path).where(F.trim("value") != "").select(first.cast("long").alias("entity_id")).distinct()


def read_edge_list(spark: SparkSession, path: str, sep: str = " ", src: int = 0, dst: int = 2) -> DataFrame:
    """(src, dst): two fields of a delimited text file, by position from 0; lines without them are skipped."""
    parts = F.split("value", rf"\Q{sep}\E", -1)
    rows = spark.read.text(path).select(F.get(parts, src).try_cast("long").alias("src"), F.get(parts, dst).try_cast("long").alias("dst"))
    return rows.where("src is not null and dst is not null")


def read_dictionary(spark: SparkSession, path: str, strict: bool = False) -> list[tuple[str, str]]:
    """The 'source:token' lines of a dictionary file in order. Lines without a colon are an error if strict, else skipped.

    A dictionary is a small fixed file; it is read as one.
    """
    text = spark.read.text(path, wholetext=True).first()
    out = []
    for line in (text[0] if text else "").splitlines():
        fields = line.rstrip().split(":") if strict else line.rstrip().split(":", 1)
        if len(fields) == 2:
            out.append((fields[0], fields[1]))
        elif strict and line.strip():
            raise ValueError(line)
    return out


def read_block_text(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of lines '<label> <blocks>'."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path).where(F.col("value").contains(" ")).select(parts[0].alias("label"), parts[1].alias("text"))


def read_order_text(spark: SparkSession, path: str) -> DataFrame:
    """(label, node, new_idx): the node mapping of lines '<label> <node> <new_idx>'."""
    return spark.read.csv(path, sep=" ", schema="label string, node long, new_idx int")


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """(node, label): JSON lines {"node": ..., "labels": [...]}, a row per label; broken lines are skipped."""
    lines = spark.read.schema("node long, labels array<string>").option("mode", "DROPMALFORMED").json(path)
    return lines.where("node is not null").select("node", F.explode("labels").alias("label"))


def read_snapshots(spark: SparkSession, path: str, *snapshots: int) -> DataFrame:
    """(snapshot_id, u, v, weight): a table of snapshots, in folders of one or of many, or only the snapshots named, from their folders.

    An empty table has no file and gives no row.
    """
    kept = spark.read.schema("snapshot_id int, u long, v long, weight long").parquet(path)
    if snapshots:
        if "first_snapshot" in kept.columns:
            kept = kept.where(F.col("first_snapshot").isin(*{s - s % FOLDER_SNAPSHOTS for s in snapshots}))
        kept = kept.where(F.col("snapshot_id").isin(*snapshots))
    return kept.select("snapshot_id", "u", "v", "weight")


def blocks_of(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """(label, br, bc, mask) of the wanted labels; one that has no blocks is a row of nulls."""
    return labels.select("label").distinct().join(blocks, "label", "left")


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right inside a folder, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in p.getFileSystem(conf).listStatus(p) if s.isFile())


def read_weighted_edges(
    edges: DataFrame, normalize: bool = False, transpose: bool = False, damping: float = 1.0, add_identity: bool = False
) -> DataFrame:
    """(i, j, v): an edge list (src, dst) as a sparse matrix of ones; rows may be normalised to sum ``damping``."""
    at = edges.where("src is not null and dst is not null").select(F.col("src").alias("i"), F.col("dst").alias("j"))
    cells = at.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))
    if normalize:
        rows = cells.groupBy("i").agg(F.sum("v").alias("row"))
        cells = cells.join(rows, "i").select("i", "j", (F.col("v") / F.col("row")).alias("v"))
    cells = cells.withColumn("v", F.col("v") * F.lit(damping))
    if add_identity:
        nodes = cells.select(F.explode(F.array("i", "j")).alias("i")).distinct()
        cells = (
            cells.unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
        )
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if transpose else cells
