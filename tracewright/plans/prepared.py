"""The registered queries of problems 1, 2, 4, 5 and 6, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import drift, features, hierarchy, shred, skew
from tracewright.session import cut, load

Query = Callable[[SparkSession, str], DataFrame]

_PROV = r"parameters\[[0-9]+\]\.provenance\[[0-9]+\]"
_BELOW = r"(?:\.children\[[0-9]+\])*"

#: Name, class, place and fields (output column to label) of the flat tables.
FLAT_TABLES: dict[str, tuple[str, str, dict[str, str]]] = {
    "p4_events": ("Event", "", {"uuid": "uuid", "etype": "type", "subject": "subject", "predicate_object": "predicateObject", "ts_nanos": "timestampNanos", "thread_id": "threadId", "object_path": "predicateObjectPath", "predicate_object2": "predicateObject2", "sequence": "sequence", "seq_no": "seqNo", "name": "name", "syscall": "syscall", "size": "size", "exec": "exec", "exec_name": "execName", "exec_path": "execPath", "exe": "exe", "image": "image", "program_point": "programPoint", "location": "location", "errno": "errno", "cpu": "cpu", "is_async": "async", "new_object_path": "objectPath"}),
    "p4_event_properties": ("Event", "properties", {"arg": "arg", "host": "host", "ret": "ret"}),
    "p4_parameters": ("Event", r"parameters\[[0-9]+\]", {"param_type": "type", "size": "size", "name": "name", "value_bytes": "valueBytes"}),
    "p4_provenance": ("Event", _PROV, {"asset": "asset", "hop": "hop"}),
    "p4_tags": ("Event", _PROV + r"\.tags\[[0-9]+\]" + _BELOW, {"tag_id": "tagId", "flow": "flow", "confidence": "confidence"}),
    "p4_details": ("Event", _PROV + r"\.detail", {}),
    "p4_steps": ("Event", _PROV + r"\.detail\.steps\[[0-9]+\]" + _BELOW, {"tag_id": "tagId", "flow": "flow", "confidence": "confidence"}),
    "p4_subjects": ("Subject", "", {"uuid": "uuid", "subject_type": "type", "cid": "cid", "pid": "pid", "ppid": "ppid", "process_id": "processId", "tgid": "tgid", "unit_id": "unitId", "parent_subject": "parentSubject", "local_principal": "localPrincipal", "principal": "principal", "start_timestamp_nanos": "startTimestampNanos", "start_nanos": "startNanos", "started_by": "startedBy", "privilege_level": "privilegeLevel", "cmd_line": "cmdLine", "command_line": "commandLine", "cmd": "cmd", "cwd": "cwd", "trace_flag": "traceFlag", "cmdline": "cmdline"}),
    "p4_subject_properties": ("Subject", "properties", {"host": "host", "login": "login"}),
    "p4_netflows": ("NetFlowObject", "", {"uuid": "uuid", "local_address": "localAddress", "local_port": "localPort", "remote_address": "remoteAddress", "remote_port": "remotePort", "ip_protocol": "ipProtocol", "src_address": "srcAddress", "src_port": "srcPort", "dst_address": "dstAddress", "dst_port": "dstPort", "init_tcp_seq_num": "initTcpSeqNum", "tcp_seq": "tcpSeq", "bytes_seen": "bytesSeen", "direction": "direction", "pinned": "pinned", "route_id": "routeId", "zone": "zone", "new_local_address": "local_address", "new_remote_address": "remote_address"}),
    "p4_netflow_bases": ("NetFlowObject", "baseObject", {"epoch": "epoch", "permission": "permission"}),
    "p4_interfaces": ("NetFlowObject", r"baseObject\.ifaces\[[0-9]+\]", {"ifname": "ifname", "mtu": "mtu"}),
    "p4_files": ("FileObject", "", {"uuid": "uuid", "file_type": "type", "filename": "filename", "size": "size", "path": "path", "path_hint": "pathHint", "object_path": "objectPath", "file_descriptor": "fileDescriptor", "fd": "fd", "inode": "inode", "inode_no": "inodeNo", "owner": "owner", "epoch": "epoch", "sealed": "sealed", "file_name": "fileName"}),
    "p4_file_bases": ("FileObject", "baseObject", {"epoch": "epoch", "permission": "permission"}),
    "p4_file_base_properties": ("FileObject", r"baseObject\.properties", {"dev": "dev", "mnt": "mnt"}),
    "p4_hashes": ("FileObject", r"(?:hashes|digests)\[[0-9]+\]", {"hash_type": "type", "hash": "hash"}),
}
#: Name, class and place of the tables of scalar array elements.
ELEMENT_TABLES: dict[str, tuple[str, str]] = {
    "p4_libraries": ("Subject", r"importedLibraries\[[0-9]+\]"),
    "p4_codes": ("Event", _PROV + r"\.detail\.codes\[[0-9]+\]"),
}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_entities(load(spark, sf_dir, "prov_events"))


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.entity_profile(load(spark, sf_dir, "prov_events"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(load(spark, sf_dir, "prov_events"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.hierarchy(load(spark, sf_dir, "prov_events"), with_path=True)
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = cut(hierarchy.parent_table(load(spark, sf_dir, "prov_events")), "parents")
    return hierarchy.descendants(hierarchy.resolve_forest(parents, with_path=True), parents)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.array_objects(load(spark, sf_dir, "raw_records"))


def _flat(rec_class: str, at: str, fields: dict[str, str]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shred.flat_table(shred.shred(load(spark, sf_dir, "raw_records"), (rec_class,), paths=False), rec_class, at, fields)

    return query


def _elements(rec_class: str, at: str) -> Query:
    return lambda spark, sf_dir: shred.element_table(shred.shred(load(spark, sf_dir, "raw_records"), (rec_class,), paths=False), rec_class, at)


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.entity_rows(shred.shred(load(spark, sf_dir, "raw_records"), paths=False))


def p4_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.scalar_table(shred.shred(load(spark, sf_dir, "raw_records")))


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the flat tables leave out, by class and place."""
    nodes = shred.shred(load(spark, sf_dir, "raw_records"))
    return shred.coverage(nodes, list(FLAT_TABLES.values()), list(ELEMENT_TABLES.values()))


def p5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_table(load(spark, sf_dir, "prov_events"), load(spark, sf_dir, "etype_catalog"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(load(spark, sf_dir, "raw_records"), load(spark, sf_dir, "raw_files"))


def _table(rec_class: str) -> Query:
    return lambda spark, sf_dir: drift.consistent_table(load(spark, sf_dir, "raw_records"), rec_class, load(spark, sf_dir, "raw_files"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_profile": p1_profile,
        "p2_found": p2_found,
        "p2_paths": p2_paths,
        "p2_descendants": p2_descendants,
        "p4_found": p4_found,
        **{name: _flat(*parts) for name, parts in FLAT_TABLES.items()},
        **{name: _elements(*parts) for name, parts in ELEMENT_TABLES.items()},
        "p4_objects": p4_objects,
        "p4_scalars": p4_scalars,
        "p4_coverage": p4_coverage,
        "p5_features": p5_features,
        "p6_found": p6_found,
        "p6_subjects": _table("Subject"),
        "p6_files": _table("FileObject"),
        "p6_netflows": _table("NetFlowObject"),
        "p6_events": _table("Event"),
    }
