"""Sinks: typed Parquet tables, and the text forms of the tables for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Snapshots in a folder of a snapshot table. Readers rely on it.
FOLDER_SNAPSHOTS = 1000


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """A Parquet table, partitioned by a column such as snapshot_id so that scans prune."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_snapshots(edges: DataFrame, path: str) -> None:
    """Snapshot edges (snapshot_id, u, v, weight) as a Parquet table, a folder for each FOLDER_SNAPSHOTS snapshots, named by the first of them.

    A folder per snapshot would be as many files as snapshots, and more, as each task writes its own. Here a folder is
    written by one task, or by a few where it is large, and its rows are sorted by snapshot, so that scans skip the
    other folders, and within one what Parquet's statistics rule out.
    """
    first = (F.col("snapshot_id") - F.col("snapshot_id") % FOLDER_SNAPSHOTS).alias("first_snapshot")
    placed = edges.select("*", first).hint("rebalance", "first_snapshot").sortWithinPartitions("first_snapshot", "snapshot_id")
    placed.write.mode("overwrite").partitionBy("first_snapshot").parquet(path)


def write_events_text(events: DataFrame, path: str) -> None:
    """'<src> <etype> <dst> <ts>' per line; a missing time is 0."""
    line = F.concat_ws(" ", F.col("src").cast("string"), "etype", F.col("dst").cast("string"), F.coalesce("ts_ns", F.lit(0)).cast("string"))
    events.select(line.alias("value")).write.mode("overwrite").text(path)


def write_entities_text(entities: DataFrame, path: str) -> None:
    """'<id>: <attribute>' per line, a folder per class."""
    line = F.concat(F.col("entity_id").cast("string"), F.lit(": "), F.coalesce("attr", F.lit("null")))
    entities.select("cls", line.alias("value")).write.mode("overwrite").partitionBy("cls").text(path)


def write_blocks_text(texts: DataFrame, path: str) -> None:
    """'<label> <blocks>' per line, of (label, text)."""
    texts.select(F.concat_ws(" ", "label", "text").alias("value")).write.mode("overwrite").text(path)


def write_order_text(order: DataFrame, path: str) -> None:
    """'<label> <node> <new_idx>' per line."""
    order.select(F.concat_ws(" ", "label", F.col("node").cast("string"), F.col("new_idx").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_intra_text(intra: DataFrame, path: str) -> None:
    """'<snapshot> <u> <v>' per line, of intra-community edges (label, u, v)."""
    snapshot = F.split("label", r"\.")[0]
    intra.select(F.concat_ws(" ", snapshot, F.col("u").cast("string"), F.col("v").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_memberships(members: DataFrame, path: str) -> None:
    """A JSON line per node, {"node": ..., "labels": [...]}, labels in snapshot order."""
    pairs = F.array_sort(F.collect_list(F.struct("snapshot_id", "label")))
    members.groupBy("node").agg(F.transform(pairs, lambda p: p["label"]).alias("labels")).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """A table into a database; the driver's jar is the cluster's to provide."""
    df.write.mode("overwrite").jdbc(url, table, properties=properties)


def text_footprint(texts: DataFrame, order: DataFrame, entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(component, n_rows, n_bytes) of the block, order, attribute and dictionary (source, token) tables in text form, a line end after each line."""
    parts = (
        ("blocks", texts, F.concat_ws(" ", "label", "text")),
        ("order", order, F.concat_ws(" ", "label", F.col("node").cast("string"), F.col("new_idx").cast("string"))),
        ("attributes", entities, F.concat(F.col("entity_id").cast("string"), F.lit(": "), F.coalesce("attr", F.lit("null")))),
        ("dictionary", dictionary, F.concat_ws(":", "source", "token")),
    )
    out = None
    for name, table, line in parts:
        one = table.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("n_bytes"))
        one = one.select(F.lit(name).alias("component"), "n_rows", "n_bytes")
        out = one if out is None else out.unionByName(one)
    return out


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_bytes): rows, and bytes of the files that each table is read from."""
    out = None
    for name, df in tables.items():
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        size = 0
        for f in df.inputFiles():
            p = jvm.org.apache.hadoop.fs.Path(f)
            size += p.getFileSystem(conf).getFileStatus(p).getLen()
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(size).cast("long").alias("n_bytes"))
        out = one if out is None else out.unionByName(one)
    return out
