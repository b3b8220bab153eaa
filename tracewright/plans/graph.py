"""The registered queries of the provenance-graph operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import scalar
from tracewright.operators import codec, communities, entities, extract, metrics, snapshots, storage, traverse
from tracewright.operators.ordering import first_seen_index
from tracewright.session import cut, load, shared_dir
from tracewright.sources import raw_log
from tracewright.sources.profiles import CONSIDERED, PROFILES
from tracewright.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

#: Snapshot size and community size of the registered queries: small enough that the test tables give many of both.
NODES, CHUNK, HUB = 200, 20, 5
#: The snapshot and community size that the operators default to; the queries named ..._5k use it.
FULL = snapshots.SNAPSHOT_NODES
SEEDS = (42, 1, 2, 3, 4)
BUDGETS, THRESHOLDS = (0.5, 1, 2, 5, 10, 20, 50), (50, 90, 100)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, src, dst, etype): considered events with both ends, as the snapshot operators take them."""
    ev = load(spark, sf_dir, "prov_events")
    kept = ev.where(F.col("etype").isin(*CONSIDERED) & F.col("srcid").isNotNull() & F.col("dstid").isNotNull())
    return kept.select("seq", F.col("srcid").alias("src"), F.col("dstid").alias("dst"), "etype")


def snapped(spark: SparkSession, sf_dir: str, nodes: int = NODES) -> DataFrame:
    return cut(snapshots.cut_snapshots(log(spark, sf_dir), ["seq"], nodes), "snapped")


def members_of(snaps: DataFrame) -> DataFrame:
    return cut(communities.chunk_partition(snapshots.snapshot_nodes(snaps), CHUNK), "members")


def attack_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): listed attack entities that have an id."""
    return load(spark, sf_dir, "attack_entities").where("entity_id is not null").select(F.col("entity_id").alias("node")).distinct()


def subject_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "entities").where("cls = 'subject'").select(F.col("entity_id").alias("node")).distinct()


def _snap(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(snapped(spark, sf_dir))


def _members(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(members_of(snapped(spark, sf_dir)))


def _graph(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """make(edges, members)"""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        snaps = snapped(spark, sf_dir)
        return make(snapshots.snapshot_edges(snaps), members_of(snaps))

    return query


def _coded(make: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
    """make(members, intra edges, degree order)"""

    def of(edges: DataFrame, members: DataFrame) -> DataFrame:
        intra = cut(communities.intra_edges(edges, members), "intra")
        return make(members, intra, cut(codec.degree_order(members, intra), "order"))

    return _graph(of)


def _blocks(make: Callable[[DataFrame], DataFrame]) -> Query:
    return _coded(lambda members, intra, order: make(codec.encode_blocks(codec.cells(intra, order))))


def _attack(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """make(last labels, attack nodes)"""
    return lambda spark, sf_dir: make(communities.membership_last(members_of(snapped(spark, sf_dir))), attack_nodes(spark, sf_dir))


def louvain_of(snaps: DataFrame, seed: int = SEEDS[0], weighted: bool = True) -> DataFrame:
    """(snapshot_id, node, label, pos): Louvain communities, nodes in order of arrival."""
    found = communities.louvain_partition(snapshots.snapshot_edges(snaps), seed, weighted)
    return cut(found.join(snapshots.snapshot_nodes(snaps), ["snapshot_id", "node"]), "louvain")


def _louvain(make: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], nodes: int = FULL) -> Query:
    """make(edges, Louvain members, attack nodes)"""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        snaps = snapped(spark, sf_dir, nodes)
        return make(snapshots.snapshot_edges(snaps), louvain_of(snaps), attack_nodes(spark, sf_dir))

    return query


def louvain_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate metrics with and without edge weights."""
    snaps, out = snapped(spark, sf_dir, FULL), None
    for name, weighted in (("weighted", True), ("unweighted", False)):
        last = communities.membership_last(louvain_of(snaps, weighted=weighted))
        one = metrics.candidate_metrics(last, attack_nodes(spark, sf_dir)).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def seed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate metrics of each seed."""
    snaps, out = snapped(spark, sf_dir, FULL), None
    for seed in SEEDS:
        last = communities.membership_last(louvain_of(snaps, seed))
        one = metrics.candidate_metrics(last, attack_nodes(spark, sf_dir)).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, n, lowest, highest, mean, deviation) of the seeds' metrics."""
    names = ("total_communities", "attack_communities", "involved_nodes", "candidate_share", "precision", "mean_density")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names))
    return scalar.spread(seed_metrics(spark, sf_dir).select(F.inline(each)), ["metric"], "v")


def louvain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot: nodes, memberships, and whether Louvain's modularity is at least that of no communities and of chunks."""
    snaps = snapped(spark, sf_dir)
    edges, found = cut(snapshots.snapshot_edges(snaps), "edges"), louvain_of(snaps, weighted=False)
    chunks = members_of(snaps)
    q = communities.modularity(edges, found).withColumnRenamed("q", "q_louvain").join(communities.modularity(edges, chunks), "snapshot_id")
    alone = chunks.withColumn("label", F.concat_ws(".", F.col("snapshot_id").cast("string"), F.col("node").cast("string")))
    q = q.join(communities.modularity(edges, alone).withColumnRenamed("q", "q_alone"), "snapshot_id")
    sizes = chunks.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    held = found.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_memberships"), F.countDistinct("node").alias("n_labelled"))
    better = [(F.col("q_louvain") >= F.col(c) - 1e-9).alias(n) for c, n in (("q_alone", "beats_single_nodes"), ("q", "beats_chunks"))]
    return sizes.join(held, "snapshot_id").join(q, "snapshot_id").select("snapshot_id", "n_nodes", "n_memberships", "n_labelled", *better)


def slashburn_reduction(members: DataFrame, intra: DataFrame, order: DataFrame) -> DataFrame:
    """Blocks and their characters under the degree, arrival and SlashBurn orders, and the share of the arrival order's blocks that each saves."""
    burnt = codec.block_counts(codec.encode_blocks(codec.cells(intra, cut(codec.slashburn_order(members, intra), "burnt"))))
    rows = cut(block_reduction(members, intra, order).unionByName(burnt.select(F.lit("slashburn").alias("node_order"), "n_blocks", "n_chars")), "reduction")
    base = F.max(F.when(F.col("node_order") == "arrival", F.col("n_blocks"))).over(Window.partitionBy())  # of three rows
    return rows.select("node_order", "n_blocks", "n_chars", scalar.ratio(base - F.col("n_blocks"), base).alias("saved"))


def slashburn_blocks(members: DataFrame, intra: DataFrame, order: DataFrame) -> DataFrame:
    return codec.encode_blocks(codec.cells(intra, codec.slashburn_order(members, intra)))


def order_audit(members: DataFrame, intra: DataFrame, order: DataFrame) -> DataFrame:
    """Per community: nodes, and the span of the places that SlashBurn gives them."""
    burnt = codec.slashburn_order(members, intra)
    at = [F.countDistinct("new_idx").alias("n_places"), F.min("new_idx").alias("first"), F.max("new_idx").alias("last")]
    return burnt.groupBy("label").agg(F.countDistinct("node").alias("n_nodes"), *at)


def block_reduction(members: DataFrame, intra: DataFrame, order: DataFrame) -> DataFrame:
    out = None
    for name, o in (("degree", order), ("arrival", codec.arrival_order(members))):
        one = codec.block_counts(codec.encode_blocks(codec.cells(intra, o))).withColumn("node_order", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("node_order", "n_blocks", "n_chars")


def roundtrip_diff(members: DataFrame, intra: DataFrame, order: DataFrame) -> DataFrame:
    """Edges that encoding, writing as text, reading and decoding lose or make up: none."""
    texts = codec.block_text(codec.encode_blocks(codec.cells(intra, order)))
    back = cut(codec.decode_edges(codec.parse_block_text(texts), order), "decoded")
    edges = intra.select("label", "u", "v")
    return edges.exceptAll(back).unionByName(back.exceptAll(edges))


def _louvain_coded(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    intra = cut(communities.intra_edges(edges, members), "intra")
    return intra, cut(codec.degree_order(members, intra), "order")


def louvain_blocks(edges: DataFrame, members: DataFrame, attack: DataFrame) -> DataFrame:
    return codec.encode_blocks(codec.cells(*_louvain_coded(edges, members)))


def louvain_roundtrip(edges: DataFrame, members: DataFrame, attack: DataFrame) -> DataFrame:
    return roundtrip_diff(members, *_louvain_coded(edges, members))


def _pois(spark: SparkSession, sf_dir: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points of interest, attack nodes in the graph)"""
    attack = cut(attack_nodes(spark, sf_dir).join(members.select("node").distinct(), "node", "left_semi"), "attack")
    return cut(traverse.poi_sample(attack, subject_nodes(spark, sf_dir)), "pois"), attack


def poi_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pois(spark, sf_dir, members_of(snapped(spark, sf_dir)))[0]


def _expand(hub: int | None, pick: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        members = members_of(snapped(spark, sf_dir))
        pois, attack = _pois(spark, sf_dir, members)
        curve, visits = traverse.expand(pois, members, attack, hub)
        return pick(curve, visits, members, attack)

    return query


def hub_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hub bound: points, those of full recall, and upper medians of final coverage and candidates."""
    members = members_of(snapped(spark, sf_dir))
    pois, attack = _pois(spark, sf_dir, members)
    goal, out = attack.count(), None
    for k in (3, 5, 10):
        s = cut(traverse.curve_summary(traverse.expand(pois, members, attack, k)[0], goal).withColumn("hub", F.lit(k)), "summary")
        one = (
            s.groupBy("hub").agg(F.count(F.lit(1)).alias("points"), F.count("full_recall_hop").alias("full"), F.min("final_covered").alias("least_covered"))
            .join(scalar.upper_median(s, ["hub"], "final_covered").select("hub", F.col("upper_median").alias("median_covered")), "hub")
            .join(scalar.upper_median(s, ["hub"], "final_nodes").select("hub", F.col("upper_median").alias("median_nodes")), "hub")
        )
        out = one if out is None else out.unionByName(one)
    return out


def bfs_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapped(spark, sf_dir)
    pois, attack = _pois(spark, sf_dir, members_of(snaps))
    return traverse.bfs(pois, snapshots.snapshot_edges(snaps), attack)


def recall_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = members_of(snapped(spark, sf_dir))
    pois, attack = _pois(spark, sf_dir, members)
    _, visits = traverse.expand(pois, members, attack)
    total = members.select("node").distinct().count()
    return metrics.recall_budget(metrics.hit_positions(visits, members, attack), pois, total, attack.count(), BUDGETS, THRESHOLDS)


def _records(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(load(spark, sf_dir, "raw_records"))


def _flat_at(df: DataFrame) -> DataFrame:
    return df.select("uuid", "attr", F.col("first_at.file_ord").alias("file_ord"), F.col("first_at.line_off").alias("line_off"))


def _profile(name: str, of: Callable[[DataFrame, object], DataFrame]) -> Query:
    return _records(lambda r: _flat_at(of(r, PROFILES[name])))


def event_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve_events(load(spark, sf_dir, "raw_records"), PROFILES["cadets_fast"])


def ground_truth(which: int) -> Query:
    return lambda spark, sf_dir: entities.ground_truth(load(spark, sf_dir, "attack_entities"), load(spark, sf_dir, "entities"))[which]


def used_entities(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    ev = log(spark, sf_dir)
    used = ev.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    return load(spark, sf_dir, "entities").select("entity_id", "cls").join(used, "entity_id", how)


def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "entities").select("entity_id", codec.compress(F.col("attr")).alias("coded"))


def dictionary_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that don't come back from the exact coding: none."""
    e = load(spark, sf_dir, "entities").select("entity_id", "attr")
    return e.where(~codec.restore_exact(codec.compress_exact(F.col("attr"))).eqNullSafe(F.col("attr")))


def socket_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four fields of well-formed socket attributes."""
    e = load(spark, sf_dir, "entities").where("cls = 'socket'")
    parts = F.split(scalar.real_value("attr"), ",", -1)
    named = [parts[i].alias(n) for i, n in enumerate(("local_addr", "local_port", "remote_addr", "remote_port"))]
    return e.where(F.size(parts) == 4).select("entity_id", *named)


def row_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_log.read_weighted_edges(log(spark, sf_dir), normalize=True, damping=0.85)


def matrix_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = codec.partition_matrix(raw_log.read_weighted_edges(log(spark, sf_dir)), 1000)
    return cells.groupBy("quadrant").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total"))


def community_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("snapshot_id", "label").agg(F.count(F.lit(1)).alias("size"))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "prov_events").schema
    events = ingest.event_stream(spark, f"{sf_dir}/prov_events.parquet", schema)
    return ingest.run_available(ingest.windowed_counts(events), "hourly_counts")


def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapped(spark, sf_dir)
    members = members_of(snaps)
    intra = cut(communities.intra_edges(snapshots.snapshot_edges(snaps), members), "intra")
    order = cut(codec.degree_order(members, intra), "order")
    attributes = load(spark, sf_dir, "entities").select("entity_id", codec.compress(F.col("attr")).alias("attr"))
    dictionary = spark.createDataFrame([(w, f"${i}$") for i, w in enumerate(codec.DICTIONARY)], "source string, token string")
    return storage.text_footprint(codec.block_text(codec.encode_blocks(codec.cells(intra, order))), order, attributes, dictionary)


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, etype, dst, ts_ns): the log with its times."""
    ev = load(spark, sf_dir, "prov_events").where(F.col("etype").isin(*CONSIDERED) & F.col("srcid").isNotNull() & F.col("dstid").isNotNull())
    return ev.select(F.col("srcid").alias("src"), "etype", F.col("dstid").alias("dst"), F.col("ts").alias("ts_ns"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tw-{name}-{uuid.uuid4().hex}"


def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as text and read again."""
    at = _folder(spark, "events")
    storage.write_events_text(_timed(spark, sf_dir), at)
    return raw_log.read_event_text(spark, at)


def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of the log's lines."""
    at = _folder(spark, "edges")
    storage.write_events_text(_timed(spark, sf_dir), at)
    return raw_log.read_edge_list(spark, at)


def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct first fields of the log's lines."""
    at = _folder(spark, "ids")
    storage.write_events_text(_timed(spark, sf_dir), at)
    return raw_log.read_ids(spark, at)


def entity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and their attributes written as text and read again; what a line can't hold (line ends, outer blanks) is left out."""
    at = _folder(spark, "entities")
    held = load(spark, sf_dir, "entities").where("cls = 'file' and attr is not null and attr = trim(attr) and not contains(attr, '\n') and not contains(attr, '\r')")
    storage.write_entities_text(held, at)
    return raw_log.read_entity_text(spark, f"{at}/cls=file", "file")


def snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot edges written in folders of snapshots and counted from the table."""
    at = _folder(spark, "snapshots")
    storage.write_snapshots(snapshots.snapshot_edges(snapped(spark, sf_dir)), at)
    return raw_log.read_snapshots(spark, at).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("events"))


def one_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of snapshots 0 and 1, read from the folders of a table."""
    at = _folder(spark, "snapshots")
    storage.write_snapshots(snapshots.snapshot_edges(snapped(spark, sf_dir)), at)
    return raw_log.read_snapshots(spark, at, 0, 1)


def membership_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships written as JSON and read again."""
    at = _folder(spark, "memberships")
    storage.write_memberships(members_of(snapped(spark, sf_dir)), at)
    return raw_log.read_memberships(spark, at)


def block_table_text(members: DataFrame, intra: DataFrame, order: DataFrame) -> DataFrame:
    """Block texts written and read again, parsed."""
    at = _folder(members.sparkSession, "blocks")
    storage.write_blocks_text(codec.block_text(codec.encode_blocks(codec.cells(intra, order))), at)
    return codec.parse_block_text(raw_log.read_block_text(members.sparkSession, at))


def order_table_text(members: DataFrame, intra: DataFrame, order: DataFrame) -> DataFrame:
    """The node order written and read again."""
    at = _folder(members.sparkSession, "order")
    storage.write_order_text(order, at)
    return raw_log.read_order_text(members.sparkSession, at)


def intra_text(members: DataFrame, intra: DataFrame, order: DataFrame) -> DataFrame:
    """Intra-community edges written as text and read again."""
    at = _folder(members.sparkSession, "intra")
    storage.write_intra_text(intra, at)
    return raw_log.read_edge_list(members.sparkSession, at, src=1, dst=2)


def poi_report(pick: Callable[[DataFrame], DataFrame]) -> Query:
    return _expand(None, lambda curve, visits, members, attack: pick(traverse.curve_summary(curve, attack.count())))


def poi_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points of interest, evenly spaced over the attack subjects."""
    members = members_of(snapped(spark, sf_dir))
    attack = attack_nodes(spark, sf_dir).join(members.select("node").distinct(), "node", "left_semi")
    return traverse.poi_sample(cut(attack, "attack"), subject_nodes(spark, sf_dir), 3)


def strict_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve_events(load(spark, sf_dir, "raw_records"), PROFILES["cadets_fast"], strict=True)


def queries() -> dict[str, Query]:
    fast = PROFILES["cadets_fast"]
    return {
        "event_type_counts": lambda s, d: metrics.event_type_counts(load(s, d, "prov_events"), CONSIDERED),
        "event_tuples": _records(lambda r: extract.event_tuples(r, fast).select("file_ord", "line_off", "src_uuid", "etype", "dst_uuid", "ts_ns")),
        "record_kinds": _records(lambda r: extract.classified(r, fast).groupBy("rec_kind").agg(F.count(F.lit(1)).alias("n"))),
        "cdm18_subjects": _profile("cadets_fast", extract.subjects),
        "cdm18_files_by_event": _profile("cadets_fast", extract.files),
        "cdm18_files_by_name": _profile("theia_fast", extract.files),
        "cdm18_sockets": _profile("cadets_fast", extract.sockets),
        "cdm20_subjects": _profile("cadets_e5", extract.subjects),
        "cdm20_files": _profile("theia_e5", extract.files),
        "cdm20_files_by_event": _profile("cadets_e5", extract.files),
        "cdm18_subjects_by_event": _profile("cadets_e3", extract.subjects),
        "cdm18_files_by_any_event": _profile("cadets_e3", extract.files),
        "cdm18_subjects_strict": _profile("theia_e3", extract.subjects),
        "cdm18_files_by_path": _profile("trace_e3", extract.files),
        "cdm20_sockets": _profile("cadets_e5", extract.sockets),
        "parsed_entities": _records(lambda r: entities.entity_table(r, fast)),
        "entity_ids": lambda s, d: entities.dense_ids(load(s, d, "entities")),
        "used_entities_semi": lambda s, d: used_entities(s, d, "left_semi"),
        "unseen_entities_anti": lambda s, d: used_entities(s, d, "left_anti"),
        "event_id_resolution": event_id_resolution,
        "ground_truth_matched": ground_truth(0),
        "ground_truth_missed": ground_truth(1),
        "socket_fields": socket_fields,
        "snapshot_assign": _snap(lambda x: x.select("seq", "snapshot_id")),
        "snapshot_edges": _snap(snapshots.snapshot_edges),
        "snapshot_node_pos": _snap(snapshots.snapshot_nodes),
        "chunk_partition": _members(lambda m: m.select("snapshot_id", "node", "label")),
        "membership_last": _members(communities.membership_last),
        "membership_multi": _members(communities.membership_multi),
        "membership_slots": _members(metrics.membership_slots),
        "candidate_metrics": _attack(metrics.candidate_metrics),
        "attack_community_top": _attack(metrics.top_attack_communities),
        "intra_edges": _graph(communities.intra_edges),
        "boundary_edges": _graph(communities.boundary),
        "modularity_chunk": _graph(communities.modularity),
        "degree_perm": _coded(lambda members, intra, order: order),
        "block_encode": _blocks(lambda b: b),
        "block_text": _blocks(codec.block_text),
        "block_counts": _coded(block_reduction),
        "block_roundtrip_diff": _coded(roundtrip_diff),
        "storage_footprint": footprint,
        "dictionary_encode": dictionary_encode,
        "dictionary_loss": dictionary_loss,
        "poi_sample": poi_sample,
        "poi_expand_curve": _expand(None, lambda curve, visits, members, attack: curve),
        "poi_expand_hub": _expand(HUB, lambda curve, visits, members, attack: curve),
        "poi_summary": _expand(None, lambda curve, visits, members, attack: traverse.curve_summary(curve, attack.count())),
        "hub_sweep": hub_sweep,
        "bfs_curve": bfs_curve,
        "recall_budget": recall_budget,
        "label_components": _members(traverse.components),
        "spread_stats": _members(lambda m: scalar.spread(community_sizes(m), ["snapshot_id"], "size")),
        "upper_median": _members(lambda m: scalar.upper_median(community_sizes(m), ["snapshot_id"], "size")),
        "row_normalized_matrix": row_shares,
        "matrix_quadrants": matrix_quadrants,
        "louvain_partition": _snap(lambda x: communities.louvain_partition(snapshots.snapshot_edges(x))),
        "louvain_unweighted": _snap(lambda x: communities.louvain_partition(snapshots.snapshot_edges(x), weighted=False)),
        "louvain_seed_sweep": _snap(lambda x: communities.seed_sweep(cut(snapshots.snapshot_edges(x), "edges"))),
        "louvain_audit": louvain_audit,
        "louvain_candidate_metrics": _louvain(lambda edges, members, attack: metrics.candidate_metrics(communities.membership_last(members), attack)),
        "louvain_slots": _louvain(lambda edges, members, attack: metrics.membership_slots(members)),
        "louvain_blocks": _louvain(louvain_blocks),
        "louvain_roundtrip_diff": _louvain(louvain_roundtrip),
        "louvain_ablation": louvain_ablation,
        "louvain_seed_metrics": seed_metrics,
        "louvain_seed_spread": seed_spread,
        "snapshot_assign_5k": lambda s, d: snapped(s, d, FULL).select("seq", "snapshot_id"),
        "snapshot_edges_5k": lambda s, d: snapshots.snapshot_edges(snapped(s, d, FULL)),
        "slashburn_blocks": _coded(slashburn_blocks),
        "slashburn_reduction": _coded(slashburn_reduction),
        "slashburn_roundtrip_diff": _coded(lambda members, intra, order: roundtrip_diff(members, intra, cut(codec.slashburn_order(members, intra), "burnt"))),
        "slashburn_audit": _coded(order_audit),
        "slashburn_perm": _coded(lambda members, intra, order: codec.slashburn_order(members, intra)),
        "stream_hourly_counts": stream_hourly,
        "cdm20_subjects_by_path": _profile("theia_e5", extract.subjects),
        "cdm18_subjects_wide": _profile("trace_e3", extract.subjects),
        "cdm18_subjects_trace_e5": _profile("trace_e5", extract.subjects),
        "cdm18_files_strict": _profile("theia_e3", extract.files),
        "event_id_resolution_strict": strict_events,
        "parsed_entities_socket_first": _records(lambda r: entities.entity_table(r, fast, ("socket", "file", "subject"))),
        "first_seen_index": lambda s, d: first_seen_index(log(s, d), "seq"),
        "self_loops": lambda s, d: snapshots.snapshot_edges(snapped(s, d)).where("u = v").groupBy("snapshot_id").agg(F.sum("weight").alias("n")),
        "matrix_at_least": lambda s, d: codec.at_least(raw_log.read_weighted_edges(log(s, d)), 3),
        "matrix_degree_rank": lambda s, d: codec.degree_rank(raw_log.read_weighted_edges(log(s, d))),
        "dictionary_restore": lambda s, d: load(s, d, "entities").select("entity_id", codec.restore(codec.compress(F.col("attr"))).alias("text")),
        "byte_size_stats": lambda s, d: metrics.timing_stats(load(s, d, "prov_events"), "byte_size"),
        "poi_metric_summary": poi_report(lambda x: scalar.metric_summary(x, ["last_hop", "full_recall_hop", "final_nodes", "final_covered"])),
        "poi_median": poi_report(traverse.median_poi),
        "poi_spaced": poi_spaced,
        "event_text": event_text,
        "edge_list": edge_list,
        "source_ids": source_ids,
        "entity_text": entity_text,
        "snapshot_table": snapshot_table,
        "one_snapshot": one_snapshot,
        "membership_json": membership_json,
        "block_table_text": _coded(block_table_text),
        "order_table_text": _coded(order_table_text),
        "intra_text": _coded(intra_text),
    }
