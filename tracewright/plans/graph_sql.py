"""SQL counterparts of the provenance-graph queries."""

from __future__ import annotations

from tracewright.operators.codec import DICTIONARY
from tracewright.operators.traverse import MAX_HOP, MAX_POI
from tracewright.plans.graph import BUDGETS, CHUNK, FULL, HUB, NODES, THRESHOLDS
from tracewright.sources import profiles as fields
from tracewright.sources.profiles import CONSIDERED, CONSIDERED_WIDE

_TYPES = ", ".join(f"'{t}'" for t in CONSIDERED)
_WIDE = ", ".join(f"'{t}'" for t in CONSIDERED_WIDE)

_LOG = f"""
log AS (
  SELECT row_number() OVER (ORDER BY seq) - 1 AS pos, seq, srcid AS src, dstid AS dst, etype FROM prov_events
  WHERE etype IN ({_TYPES}) AND srcid IS NOT NULL AND dstid IS NOT NULL)"""

_SNAP = f"""WITH RECURSIVE {_LOG},
occ AS (
  SELECT pos, slot, node, lag(slot) OVER (PARTITION BY node ORDER BY slot) AS prev
  FROM (SELECT pos, 2 * pos AS slot, src AS node FROM log UNION ALL SELECT pos, 2 * pos + 1, dst FROM log)),
cuts(snapshot_id, s) AS (
  SELECT 0, CAST(0 AS BIGINT)
  UNION ALL
  SELECT c.snapshot_id + 1, n.e + 1
  FROM cuts c, LATERAL (
    SELECT min(pos) AS e FROM (
      SELECT o.pos, sum(CASE WHEN o.prev IS NULL OR o.prev < 2 * c.s THEN 1 ELSE 0 END) OVER (ORDER BY o.slot) AS seen
      FROM occ o WHERE o.pos >= c.s) x WHERE seen >= {NODES}) n
  WHERE n.e + 1 < (SELECT count(*) FROM log)),
snap AS (SELECT l.*, c.snapshot_id FROM log l ASOF JOIN cuts c ON l.pos >= c.s),
edges AS (SELECT snapshot_id, least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS weight FROM snap GROUP BY ALL),
nodes AS (
  SELECT snapshot_id, node, row_number() OVER (PARTITION BY snapshot_id ORDER BY min(slot)) - 1 AS pos
  FROM (SELECT snapshot_id, src AS node, 2 * pos AS slot FROM snap UNION ALL SELECT snapshot_id, dst, 2 * pos + 1 FROM snap)
  GROUP BY snapshot_id, node),
members AS (SELECT snapshot_id, node, pos, snapshot_id || '.' || (pos // {CHUNK}) AS label FROM nodes),
last AS (SELECT node, arg_max(label, snapshot_id) AS label FROM members GROUP BY node),
attack AS (SELECT DISTINCT entity_id AS node FROM attack_entities WHERE entity_id IN (SELECT node FROM nodes)),
labelled AS (
  SELECT e.*, a.label AS lu, b.label AS lv FROM edges e
  JOIN members a ON a.snapshot_id = e.snapshot_id AND a.node = e.u JOIN members b ON b.snapshot_id = e.snapshot_id AND b.node = e.v),
intra AS (SELECT lu AS label, u, v FROM labelled WHERE lu = lv),
"""

#: The same with the snapshot size that the operators default to.
_SNAP_FULL = _SNAP.replace(f"seen >= {NODES})", f"seen >= {FULL})")

_DENSITY = """
density AS (
  SELECT label, count(*) AS size, count(a.node) AS attack, count(a.node) / count(*) AS density, 1 - count(a.node) / count(*) AS purity
  FROM last l LEFT JOIN attack a USING (node) GROUP BY label)
"""

_CODE = """
degrees AS (SELECT label, node, count(*) AS deg FROM (SELECT label, u AS node FROM intra UNION ALL SELECT label, v FROM intra) GROUP BY ALL),
perm AS (
  SELECT m.label, m.node, CAST(row_number() OVER (PARTITION BY m.label ORDER BY coalesce(deg, 0) DESC, m.node) - 1 AS INTEGER) AS new_idx
  FROM members m LEFT JOIN degrees d ON d.label = m.label AND d.node = m.node),
cells AS (
  SELECT i.label, p.new_idx AS r, q.new_idx AS c FROM intra i
  JOIN perm p ON p.label = i.label AND p.node = i.u JOIN perm q ON q.label = i.label AND q.node = i.v),
blocks AS (
  SELECT label, r // 4 AS br, c // 4 AS bc, CAST(bit_or(1 << (15 - (4 * (r % 4) + c % 4))) AS INTEGER) AS mask
  FROM (SELECT label, r, c FROM cells UNION ALL SELECT label, c, r FROM cells) GROUP BY ALL),
texts AS (
  SELECT label, string_agg(lpad(bin(mask), 16, '0') || '*' || br || '*' || bc, '#' ORDER BY br, bc) AS text FROM blocks GROUP BY label)
"""

_POIS = f"""
pool AS (SELECT node FROM attack WHERE node IN (SELECT entity_id FROM entities WHERE cls = 'subject')),
pool2 AS (SELECT node FROM pool UNION ALL SELECT node FROM attack WHERE NOT EXISTS (SELECT 1 FROM pool)),
ranked AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM pool2),
pois AS (
  SELECT node AS poi FROM ranked WHERE n <= {MAX_POI}
    OR i IN (SELECT CAST(floor(k * (n / {float(MAX_POI)})) AS BIGINT) FROM range({MAX_POI}) t(k)))
"""


def _expand(hub: int | None) -> str:
    few = f" AND count(*) <= {hub}" if hub is not None else ""
    return (
        _SNAP
        + _POIS
        + f""",
doors AS (SELECT node FROM members GROUP BY node HAVING count(*) > 1{few}),
ways AS (
  SELECT DISTINCT a.label AS l1, b.label AS l2 FROM members a JOIN members b ON a.node = b.node
  WHERE a.node IN (SELECT node FROM doors) AND a.label <> b.label),
opened(poi, label, hop) AS (
  SELECT poi, label, 0 FROM pois JOIN members ON node = poi
  UNION
  SELECT o.poi, w.l2, o.hop + 1 FROM opened o JOIN ways w ON w.l1 = o.label WHERE o.hop < {MAX_HOP}),
visits AS (SELECT poi, label, min(hop) AS hop FROM opened GROUP BY poi, label),
found AS (SELECT v.poi, m.node, min(v.hop) AS hop FROM visits v JOIN members m ON m.label = v.label GROUP BY ALL),
hops AS (SELECT DISTINCT poi, hop FROM visits),
whole AS (
  SELECT h.poi, h.hop,
    (SELECT count(*) FROM visits v WHERE v.poi = h.poi AND v.hop <= h.hop) AS communities_open,
    (SELECT count(*) FROM found f WHERE f.poi = h.poi AND f.hop <= h.hop) AS candidate_nodes,
    (SELECT count(*) FROM found f WHERE f.poi = h.poi AND f.hop <= h.hop AND f.node IN (SELECT node FROM attack)) AS gt_covered
  FROM hops h),
goal AS (SELECT count(*) AS g FROM attack),
stops AS (SELECT poi, min(hop) AS stop FROM whole, goal WHERE gt_covered = g GROUP BY poi),
curve AS (SELECT w.* FROM whole w LEFT JOIN stops s ON s.poi = w.poi WHERE s.stop IS NULL OR w.hop <= s.stop)
"""
    )


_SUMMARY = """,
final AS (SELECT *, max(gt_covered) OVER (PARTITION BY poi) AS f FROM curve)
SELECT poi, max(hop) AS last_hop, min(hop) FILTER (WHERE gt_covered = f) AS recall_plateau_hop, max(f) AS final_covered,
  max(candidate_nodes) AS final_nodes, min(hop) FILTER (WHERE gt_covered = (SELECT g FROM goal)) AS full_recall_hop
FROM final GROUP BY poi
"""

_HUB_SWEEP = " UNION ALL ".join(
    f"SELECT * FROM ({_expand(k)}{_SUMMARY.replace('SELECT poi, max(hop)', ', s AS (SELECT poi, max(hop)')})"
    f" SELECT {k} AS hub, count(*) AS points, count(full_recall_hop) AS full, min(final_covered) AS least_covered,"
    " list_sort(list(final_covered))[count(*) // 2 + 1] AS median_covered, list_sort(list(final_nodes))[count(*) // 2 + 1] AS median_nodes FROM s)"
    for k in (3, 5, 10)
)

_BFS = (
    _SNAP
    + _POIS
    + f""",
near AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reached(poi, node, hop) AS (
  SELECT poi, poi, 0 FROM pois
  UNION
  SELECT r.poi, n.v, r.hop + 1 FROM reached r JOIN near n ON n.u = r.node WHERE r.hop < {MAX_HOP}),
dist AS (SELECT poi, node, min(hop) AS hop FROM reached GROUP BY poi, node),
whole AS (
  SELECT p.poi, CAST(h.hop AS INTEGER) AS hop,
    (SELECT count(*) FROM dist d WHERE d.poi = p.poi AND d.hop <= h.hop) AS visited,
    (SELECT count(*) FROM dist d WHERE d.poi = p.poi AND d.hop <= h.hop AND d.node IN (SELECT node FROM attack)) AS gt_covered
  FROM pois p, range({MAX_HOP} + 1) h(hop)),
stops AS (
  SELECT poi, least(
    (SELECT min(w.hop) FROM whole w WHERE w.poi = p.poi AND w.gt_covered = (SELECT count(*) FROM attack)),
    (SELECT max(d.hop) + 1 FROM dist d WHERE d.poi = p.poi)) AS stop FROM pois p)
SELECT w.* FROM whole w JOIN stops s ON s.poi = w.poi WHERE w.hop <= s.stop
"""
)

_BUDGET = (
    _expand(None)
    + """,
kept AS (SELECT v.* FROM visits v LEFT JOIN stops s ON s.poi = v.poi WHERE s.stop IS NULL OR v.hop <= s.stop),
firsts AS (
  SELECT k.poi, m.node, min((k.hop, k.label, m.pos)) AS o FROM kept k JOIN members m ON m.label = k.label GROUP BY ALL),
idx AS (SELECT poi, node, row_number() OVER (PARTITION BY poi ORDER BY o) AS i FROM firsts),
hits AS (SELECT poi, i, row_number() OVER (PARTITION BY poi ORDER BY i) AS k FROM idx WHERE node IN (SELECT node FROM attack)),
n AS (SELECT count(DISTINCT node) AS n FROM members)
SELECT p.poi, """
    + ", ".join(f"count(i) FILTER (WHERE i <= {b} * (SELECT n FROM n) / 100.0) AS within_{f'{b:g}'.replace('.', '_')}" for b in BUDGETS)
    + ", "
    + ", ".join(f"min(i) FILTER (WHERE k = ({r} * (SELECT g FROM goal) + 99) // 100) AS place_{r}" for r in THRESHOLDS)
    + " FROM pois p LEFT JOIN hits h ON h.poi = p.poi GROUP BY p.poi"
)

_COMPONENTS = (
    _SNAP.rstrip().rstrip(",")
    + """,
ways AS (SELECT DISTINCT a.label AS l1, b.label AS l2 FROM members a JOIN members b ON a.node = b.node WHERE a.label <> b.label),
cc(label, component) USING KEY (label) AS (
  SELECT DISTINCT label, label FROM members
  UNION
  SELECT w.l2, min(c.component) FROM cc c JOIN ways w ON w.l1 = c.label JOIN recurring.cc r ON r.label = w.l2
  WHERE c.component < r.component GROUP BY w.l2)
SELECT label, component FROM cc
"""
)


def _tail(sql: str) -> str:
    """The snapshot tables without the comma that a further table would need."""
    return _SNAP.rstrip().rstrip(",") + "\n" + sql


def _kinds(version: str) -> str:
    return f"""
kinds AS (
  SELECT file_ord, line_off, value, CASE
    WHEN contains(value, '{version}.Event"') THEN 'Event' WHEN contains(value, '{version}.Subject"') THEN 'Subject'
    WHEN contains(value, '{version}.FileObject"') THEN 'FileObject' WHEN contains(value, '{version}.NetFlowObject"') THEN 'NetFlowObject' END AS k
  FROM raw_records)"""


def _m(pattern: str, group: int = 1) -> str:
    return f"CASE WHEN regexp_matches(value, '{pattern}') THEN regexp_extract(value, '{pattern}', {group}) END"


def _own(version: str, cls: str) -> str:
    return fields.OWN_UUID.format(v=version, c=cls)


def _events(version: str, types: str, flows: bool) -> str:
    subject, target = (fields.REFERENCE.format(v=version, f=f) for f in ("subject", "predicateObject"))
    flat = "" if flows else " AND NOT contains(value, 'EVENT_FLOWS_TO')"
    return f"""
tuples AS (
  SELECT * FROM (
    SELECT file_ord, line_off, {_m(subject)} AS src_uuid, {_m(fields.EVENT_TYPE)} AS etype, {_m(target)} AS dst_uuid,
      coalesce(try_cast({_m(fields.EVENT_TIME)} AS BIGINT), 0) AS ts_ns, {_m(fields.EVENT_PATH)} AS path,
      {_m(subject + fields.EVENT_EXEC, 2)} AS exec
    FROM kinds WHERE k = 'Event'{flat})
  WHERE etype IN ({types}) AND src_uuid IS NOT NULL AND dst_uuid IS NOT NULL)"""


def _members(version: str, cls: str, name: str) -> str:
    return f"(SELECT {_m(_own(version, cls))} AS uuid, file_ord, line_off, {name} AS name FROM kinds WHERE k = '{cls}')"


_AT = "min(file_ord) AS file_ord, arg_min(line_off, (file_ord, line_off)) AS line_off"
def _socket_name(version: str) -> str:
    whole = fields.SOCKET + fields.ADDRESSES[version]
    parts = " || ',' || ".join(f"regexp_extract(value, '{whole}', {i})" for i in range(1, 5))
    return f"CASE WHEN regexp_matches(value, '{whole}') THEN {parts} END"


def _last_named(version: str, cls: str, name: str, missing: str, keep: str = "true") -> str:
    latest = "arg_max(name, (file_ord, line_off)) FILTER (WHERE name IS NOT NULL)"
    return f"SELECT uuid, coalesce({latest}, '{missing}') AS attr, {_AT} FROM {_members(version, cls, name)} WHERE uuid IS NOT NULL AND {keep} GROUP BY uuid"


_CMD, _PATH = fields.COMMAND_LINE, fields.EVENT_PATH
_OBJECT18 = fields.REFERENCE.format(v="cdm18", f="predicateObject")
_EXEC18 = fields.REFERENCE.format(v="cdm18", f="subject") + fields.EVENT_EXEC
_SUBJECTS18 = (
    "SELECT uuid, arg_max(coalesce(name, 'null'), (file_ord, line_off)) AS attr, "
    + _AT
    + " FROM "
    + _members("cdm18", "Subject", _m(_CMD))
    + " WHERE uuid IS NOT NULL GROUP BY uuid"
)
_FILES18 = f"""SELECT uuid, arg_min(name, (file_ord, line_off)) AS attr, {_AT} FROM (
  SELECT * FROM {_members("cdm18", "FileObject", "''")} WHERE uuid IS NOT NULL
  UNION ALL SELECT dst_uuid, file_ord, line_off, path FROM tuples WHERE path IS NOT NULL) GROUP BY uuid"""
_SOCKETS18 = _last_named("cdm18", "NetFlowObject", _socket_name("cdm18"), "null")

_FAST = "WITH " + _kinds("cdm18") + "," + _events("cdm18", _TYPES, False)

_PARSED = (
    _FAST
    + f""",
used AS (SELECT src_uuid AS uuid FROM tuples UNION SELECT dst_uuid FROM tuples),
every AS (
  SELECT *, 0 AS r FROM ({_SUBJECTS18}) UNION ALL SELECT *, 1 FROM ({_FILES18}) UNION ALL SELECT *, 2 FROM ({_SOCKETS18})),
known AS (SELECT DISTINCT ON (uuid) * FROM every WHERE uuid IN (SELECT uuid FROM used) ORDER BY uuid, r),
alls AS (
  SELECT uuid, attr, file_ord, line_off, r FROM known
  UNION ALL SELECT uuid, 'other', NULL, NULL, 3 FROM used WHERE uuid NOT IN (SELECT uuid FROM known)),
ids AS (
  SELECT row_number() OVER (ORDER BY r, file_ord, line_off, uuid) - 1 AS entity_id, uuid,
    ['subject', 'file', 'socket', 'other'][r + 1] AS cls, attr FROM alls)
"""
)


def _nested_replace(column: str) -> str:
    for i, source in enumerate(DICTIONARY):
        column = f"replace({column}, '{source}', '${i}$')"
    return column


def _restored(column: str) -> str:
    for i, source in enumerate(DICTIONARY):
        column = f"replace({column}, '${i}$', '{source}')"
    return column


_SOCKET_FIRST = _PARSED.replace("SELECT *, 0 AS r FROM", "SELECT *, 2 AS r FROM").replace("SELECT *, 2 FROM (" + _SOCKETS18, "SELECT *, 0 FROM (" + _SOCKETS18)
_SOCKET_FIRST = _SOCKET_FIRST.replace("['subject', 'file', 'socket', 'other']", "['socket', 'file', 'subject', 'other']")

_SPACED = _SNAP + _POIS.replace(f"n <= {MAX_POI}", "n <= 3").replace(f"n / {float(MAX_POI)}", "n / 3.0").replace(f"range({MAX_POI})", "range(3)")

_POI_METRICS = _expand(None) + _SUMMARY.replace("SELECT poi, max(hop)", ", s AS (SELECT poi, max(hop)") + """),
v AS (
  SELECT 'last_hop' AS metric, CAST(last_hop AS DOUBLE) AS v FROM s UNION ALL SELECT 'full_recall_hop', full_recall_hop FROM s
  UNION ALL SELECT 'final_nodes', final_nodes FROM s UNION ALL SELECT 'final_covered', final_covered FROM s)
SELECT metric, min(v) AS lowest, list_sort(list(v) FILTER (WHERE v IS NOT NULL))[count(v) // 2 + 1] AS median, max(v) AS highest,
  count(*) FILTER (WHERE v IS NULL) AS n_none FROM v GROUP BY metric
"""

_POI_MEDIAN = _expand(None) + _SUMMARY.replace("SELECT poi, max(hop)", ", s AS (SELECT poi, max(hop)") + """),
pool3 AS (SELECT * FROM s WHERE full_recall_hop IS NOT NULL OR (SELECT count(full_recall_hop) FROM s) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY coalesce(full_recall_hop, last_hop), final_nodes, poi) - 1 AS i, count(*) OVER () AS n FROM pool3)
SELECT poi, last_hop, full_recall_hop, final_nodes, final_covered FROM r WHERE i = n // 2
"""

_TIMED = f"FROM prov_events WHERE etype IN ({_TYPES}) AND srcid IS NOT NULL AND dstid IS NOT NULL"

_SIZES = "sizes AS (SELECT snapshot_id, label, count(*) AS size FROM members GROUP BY ALL)"


def _counts(order: str, name: str) -> str:
    return f"""
SELECT '{name}' AS node_order, count(*) AS n_blocks, coalesce(sum(16 + len(CAST(br AS VARCHAR)) + len(CAST(bc AS VARCHAR))), 0)::BIGINT AS n_chars FROM (
  SELECT DISTINCT i.label, p.new_idx // 4 AS br, q.new_idx // 4 AS bc FROM both_ways i
  JOIN {order} p ON p.label = i.label AND p.node = i.u JOIN {order} q ON q.label = i.label AND q.node = i.v)"""


_REDUCTION = (
    _SNAP
    + _CODE
    + """,
both_ways AS (SELECT label, u, v FROM intra UNION ALL SELECT label, v, u FROM intra),
arrival AS (SELECT label, node, row_number() OVER (PARTITION BY label ORDER BY pos, node) - 1 AS new_idx FROM members)
"""
    + _counts("perm", "degree")
    + " UNION ALL "
    + _counts("arrival", "arrival")
)

_MODULARITY = """
e AS (SELECT snapshot_id, lu AS label, sum(CASE WHEN u = v THEN 1 ELSE 2 END) AS e FROM labelled WHERE lu = lv GROUP BY ALL),
a AS (
  SELECT snapshot_id, label, count(*) AS a FROM (
    SELECT snapshot_id, lu AS label FROM labelled UNION ALL SELECT snapshot_id, lv FROM labelled WHERE u <> v) GROUP BY ALL),
m AS (SELECT snapshot_id, count(*) AS m FROM edges GROUP BY ALL)
SELECT a.snapshot_id, sum(coalesce(e.e, 0) / (2 * m.m) - (a.a / (2 * m.m)) ^ 2) AS q
FROM a JOIN m USING (snapshot_id) LEFT JOIN e ON e.snapshot_id = a.snapshot_id AND e.label = a.label GROUP BY a.snapshot_id
"""

_METRICS = """
SELECT coalesce(sum(size), 0)::BIGINT AS total_nodes, count(*) AS total_communities, coalesce(sum(attack), 0)::BIGINT AS attack_nodes,
  count(*) FILTER (WHERE attack > 0) AS attack_communities, coalesce(sum(size) FILTER (WHERE attack > 0), 0)::BIGINT AS involved_nodes,
  coalesce(avg(density) FILTER (WHERE attack > 0), 0) AS mean_density, max(size) AS max_size, avg(size) AS mean_size,
  count(*) FILTER (WHERE attack > 0) / count(*) AS relevant_share,
  coalesce(sum(size) FILTER (WHERE attack > 0), 0) / sum(size) AS candidate_share,
  coalesce(sum(attack) / nullif(sum(size) FILTER (WHERE attack > 0), 0), 0) AS precision,
  CASE WHEN sum(attack) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall
FROM density
"""

_SLOTS = """
SELECT sum(n)::BIGINT AS slots, count(*) AS nodes, count(*) FILTER (WHERE n > 1) AS recurring, max(n) AS most,
  (sum(n) - count(*))::BIGINT AS extra_rows, 100.0::DOUBLE * (sum(n) - count(*)) / count(*) AS extra_pct
FROM (SELECT node, count(*) AS n FROM members GROUP BY node)
"""

_FOOTPRINT = f"""
SELECT 'blocks' AS component, count(*) AS n_rows, coalesce(sum(strlen(label || ' ' || text) + 1), 0)::BIGINT AS n_bytes FROM texts
UNION ALL SELECT 'order', count(*), coalesce(sum(strlen(label || ' ' || node || ' ' || new_idx) + 1), 0)::BIGINT FROM perm
UNION ALL SELECT 'attributes', count(*), coalesce(sum(strlen(entity_id || ': ' || coalesce({_nested_replace('attr')}, 'null')) + 1), 0)::BIGINT FROM entities
UNION ALL SELECT 'dictionary', count(*), sum(strlen(source || ':$' || i || '$') + 1)::BIGINT FROM (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(DICTIONARY))}) t(i, source)
"""

_REAL_ATTR = "attr NOT IN ('', 'null', 'none', '<unknown>')"


def oracle_sql() -> dict[str, str]:
    curve = "SELECT poi, hop, communities_open, candidate_nodes, gt_covered FROM curve"
    return {
        "event_type_counts": f"SELECT etype, count(*) AS n FROM prov_events WHERE etype IN ({_TYPES}) GROUP BY etype",
        "event_tuples": _FAST + " SELECT file_ord, line_off, src_uuid, etype, dst_uuid, ts_ns FROM tuples",
        "record_kinds": "WITH" + _kinds("cdm18") + " SELECT k AS rec_kind, count(*) AS n FROM kinds WHERE k IS NOT NULL GROUP BY k",
        "cdm18_subjects": _FAST + _SUBJECTS18,
        "cdm18_files_by_event": _FAST + _FILES18,
        "cdm18_files_by_name": "WITH" + _kinds("cdm18") + _last_named("cdm18", "FileObject", _m('"filename":"(.*?)"'), ""),
        "cdm18_sockets": _FAST + _SOCKETS18,
        "cdm20_subjects": "WITH"
        + _kinds("cdm20")
        + ","
        + _events("cdm20", _WIDE, True)
        + f""", named AS (SELECT src_uuid AS uuid, arg_max(exec, (file_ord, line_off)) AS name FROM tuples WHERE exec IS NOT NULL GROUP BY src_uuid)
SELECT s.uuid, coalesce(any_value(n.name), 'none') AS attr, {_AT} FROM {_members("cdm20", "Subject", "NULL")} s LEFT JOIN named n ON n.uuid = s.uuid
WHERE s.uuid IS NOT NULL AND len(s.uuid) <> 64 GROUP BY s.uuid""",
        "cdm20_files": "WITH" + _kinds("cdm20") + _last_named("cdm20", "FileObject", _m('"filename":"(.*?)"'), "", "name IS NOT NULL"),
        "cdm20_files_by_event": "WITH" + _kinds("cdm20") + "," + _events("cdm20", _WIDE, True) + f""",
named AS (SELECT dst_uuid AS uuid, arg_max(path, (file_ord, line_off)) AS name FROM tuples WHERE path IS NOT NULL GROUP BY dst_uuid)
SELECT f.uuid, coalesce(any_value(n.name), 'null') AS attr, {_AT} FROM {_members("cdm20", "FileObject", "NULL")} f LEFT JOIN named n ON n.uuid = f.uuid
WHERE f.uuid IS NOT NULL GROUP BY f.uuid""",
        "cdm18_subjects_by_event": "WITH own AS (SELECT file_ord, line_off, "
        + _m(_EXEC18)
        + " AS uuid, "
        + _m(_EXEC18, 2)
        + f""" AS name FROM raw_records WHERE contains(value, 'Event'))
SELECT uuid, arg_max(name, (file_ord, line_off)) AS attr, {_AT} FROM own WHERE uuid IS NOT NULL AND name <> '' AND len(uuid) <> 64 GROUP BY uuid""",
        "cdm18_files_by_any_event": "WITH" + _kinds("cdm18") + f""", seen AS (
  SELECT {_m(_OBJECT18)} AS uuid, file_ord, line_off, coalesce({_m(_PATH)}, '') AS name FROM kinds
  WHERE k = 'Event' AND NOT contains(value, '"predicateObjectPath":null,') AND NOT contains(value, '<unknown>'))
SELECT * FROM (SELECT uuid, arg_max(name, (file_ord, line_off)) AS attr, {_AT} FROM seen
  WHERE uuid IN (SELECT uuid FROM {_members("cdm18", "FileObject", "NULL")}) GROUP BY uuid) WHERE attr <> 'none'""",
        "cdm18_subjects_strict": "WITH"
        + _kinds("cdm18")
        + _last_named("cdm18", "Subject", _m(_CMD), "null", "name <> '' AND len(uuid) <> 64"),
        "cdm18_files_by_path": "WITH" + _kinds("cdm18") + _last_named("cdm18", "FileObject", _m('"path":"(.*?)"'), "", "name IS NOT NULL"),
        "cdm20_sockets": "WITH" + _kinds("cdm20") + _last_named("cdm20", "NetFlowObject", _socket_name("cdm20"), "null"),
        "parsed_entities": _PARSED + "SELECT * FROM ids",
        "entity_ids": """
WITH one AS (
  SELECT uuid, min((coalesce(list_position(['subject', 'file', 'socket', 'other'], coalesce(cls, 'other')), 5), entity_id)) AS k,
    arg_min(cls, (coalesce(list_position(['subject', 'file', 'socket', 'other'], coalesce(cls, 'other')), 5), entity_id)) AS cls
  FROM entities WHERE uuid IS NOT NULL GROUP BY uuid)
SELECT uuid, cls, row_number() OVER (ORDER BY k, uuid) - 1 AS new_id FROM one""",
        "used_entities_semi": f"WITH {_LOG} SELECT entity_id, cls FROM entities WHERE entity_id IN (SELECT src FROM log UNION SELECT dst FROM log)",
        "unseen_entities_anti": f"WITH {_LOG} SELECT entity_id, cls FROM entities WHERE entity_id NOT IN (SELECT src FROM log UNION SELECT dst FROM log)",
        "event_id_resolution": _PARSED
        + "SELECT t.file_ord, t.line_off, a.entity_id AS src, t.etype, b.entity_id AS dst, t.ts_ns FROM tuples t JOIN ids a ON a.uuid = t.src_uuid JOIN ids b ON b.uuid = t.dst_uuid",
        "ground_truth_matched": "SELECT min(entity_id) AS entity_id, uuid FROM entities WHERE uuid IN (SELECT uuid FROM attack_entities) GROUP BY uuid",
        "ground_truth_missed": "SELECT DISTINCT uuid FROM attack_entities WHERE uuid IS NOT NULL AND uuid NOT IN (SELECT uuid FROM entities WHERE uuid IS NOT NULL)",
        "socket_fields": f"""SELECT entity_id, split_part(attr, ',', 1) AS local_addr, split_part(attr, ',', 2) AS local_port,
  split_part(attr, ',', 3) AS remote_addr, split_part(attr, ',', 4) AS remote_port
FROM entities WHERE cls = 'socket' AND {_REAL_ATTR} AND len(string_split(attr, ',')) = 4""",
        "snapshot_assign": _tail("SELECT seq, snapshot_id FROM snap"),
        "snapshot_edges": _tail("SELECT * FROM edges"),
        "snapshot_node_pos": _tail("SELECT snapshot_id, node, CAST(pos AS INTEGER) AS pos FROM nodes"),
        "chunk_partition": _tail("SELECT snapshot_id, node, label FROM members"),
        "membership_last": _tail("SELECT * FROM last"),
        "membership_multi": _tail("SELECT node, count(*) AS n_labels, string_agg(label, ' ' ORDER BY snapshot_id) AS labels FROM members GROUP BY node"),
        "membership_slots": _tail(_SLOTS),
        "candidate_metrics": _SNAP + _DENSITY + _METRICS,
        "attack_community_top": _SNAP + _DENSITY + "SELECT * FROM density WHERE attack > 0 ORDER BY density DESC, label LIMIT 20",
        "intra_edges": _tail("SELECT * FROM intra"),
        "boundary_edges": _tail("""SELECT snapshot_id, lu AS c1, lv AS c2, u AS node, v AS neighbour FROM labelled WHERE lu <> lv
UNION ALL SELECT snapshot_id, lv, lu, v, u FROM labelled WHERE lu <> lv"""),
        "modularity_chunk": _SNAP + _MODULARITY,
        "degree_perm": _SNAP + _CODE + "SELECT * FROM perm",
        "block_encode": _SNAP + _CODE + "SELECT * FROM blocks",
        "block_text": _SNAP + _CODE + "SELECT * FROM texts",
        "block_counts": _REDUCTION,
        "block_roundtrip_diff": "SELECT '' AS label, 0::BIGINT AS u, 0::BIGINT AS v WHERE false",
        "storage_footprint": _SNAP + _CODE + _FOOTPRINT,
        "slashburn_roundtrip_diff": "SELECT '' AS label, 0::BIGINT AS u, 0::BIGINT AS v WHERE false",
        "slashburn_audit": _tail(
            "SELECT label, count(*) AS n_nodes, count(*) AS n_places, 0::INTEGER AS first, CAST(count(*) - 1 AS INTEGER) AS last FROM members GROUP BY label"
        ),
        "louvain_roundtrip_diff": "SELECT '' AS label, 0::BIGINT AS u, 0::BIGINT AS v WHERE false",
        "louvain_audit": _tail(
            "SELECT snapshot_id, count(*) AS n_nodes, count(*) AS n_memberships, count(*) AS n_labelled, true AS beats_single_nodes, true AS beats_chunks "
            "FROM nodes GROUP BY snapshot_id"
        ),
        "louvain_slots": _SNAP_FULL.rstrip().rstrip(",") + _SLOTS,
        "snapshot_assign_5k": _SNAP_FULL.rstrip().rstrip(",") + " SELECT seq, snapshot_id FROM snap",
        "snapshot_edges_5k": _SNAP_FULL.rstrip().rstrip(",") + " SELECT * FROM edges",
        "dictionary_encode": f"SELECT entity_id, {_nested_replace('attr')} AS coded FROM entities",
        "dictionary_loss": "SELECT entity_id, attr FROM entities WHERE false",
        "poi_sample": _SNAP + _POIS + "SELECT poi FROM pois",
        "poi_expand_curve": _expand(None) + curve,
        "poi_expand_hub": _expand(HUB) + curve,
        "poi_summary": _expand(None) + _SUMMARY,
        "hub_sweep": _HUB_SWEEP,
        "bfs_curve": _BFS,
        "recall_budget": _BUDGET,
        "label_components": _COMPONENTS,
        "spread_stats": _SNAP
        + _SIZES
        + " SELECT snapshot_id, count(*) AS n, min(size) AS lowest, max(size) AS highest, avg(size) AS mean, stddev_pop(size) AS deviation FROM sizes GROUP BY snapshot_id",
        "upper_median": _SNAP
        + _SIZES
        + " SELECT snapshot_id, count(*) AS n, list_sort(list(size))[count(*) // 2 + 1] AS upper_median FROM sizes GROUP BY snapshot_id",
        "row_normalized_matrix": f"WITH {_LOG} SELECT src AS i, dst AS j, 0.85::DOUBLE * (count(*) / sum(count(*)) OVER (PARTITION BY src)) AS v FROM log GROUP BY src, dst",
        "matrix_quadrants": f"""WITH {_LOG}
SELECT (CASE WHEN src >= 1000 THEN 2 ELSE 0 END + CASE WHEN dst >= 1000 THEN 1 ELSE 0 END)::INTEGER AS quadrant,
  count(*) AS cells, sum(n)::DOUBLE AS total FROM (SELECT src, dst, count(*) AS n FROM log GROUP BY src, dst) GROUP BY ALL""",
        "cdm20_subjects_by_path": "WITH"
        + _kinds("cdm20")
        + _last_named("cdm20", "Subject", _m('"path":"(.*?)"'), "null", "name IS NOT NULL AND len(uuid) <> 64"),
        **{
            name: "WITH" + _kinds("cdm18") + _last_named("cdm18", "Subject", _m(_CMD), "null", "name IS NOT NULL AND len(uuid) <> 64")
            for name in ("cdm18_subjects_wide", "cdm18_subjects_trace_e5")
        },
        "cdm18_files_strict": "WITH"
        + _kinds("cdm18")
        + "SELECT * FROM ("
        + _last_named("cdm18", "FileObject", _m('"filename":"(.*?)"'), "", "name IS NOT NULL")
        + ") WHERE attr <> 'none'",
        "event_id_resolution_strict": _PARSED
        + "SELECT t.file_ord, t.line_off, a.entity_id AS src, t.etype, b.entity_id AS dst, t.ts_ns FROM tuples t JOIN ids a ON a.uuid = t.src_uuid "
        + "JOIN ids b ON b.uuid = t.dst_uuid WHERE a.cls = 'subject' AND b.cls <> 'other'",
        "parsed_entities_socket_first": _SOCKET_FIRST + "SELECT * FROM ids",
        "first_seen_index": f"""WITH {_LOG}
SELECT node, row_number() OVER (ORDER BY min(slot)) - 1 AS idx FROM (SELECT src AS node, 2 * pos AS slot FROM log UNION ALL SELECT dst, 2 * pos + 1 FROM log)
GROUP BY node""",
        "self_loops": _tail("SELECT snapshot_id, sum(weight)::BIGINT AS n FROM edges WHERE u = v GROUP BY snapshot_id"),
        "matrix_at_least": f"WITH {_LOG} SELECT src AS i, dst AS j, count(*)::DOUBLE AS v FROM log GROUP BY src, dst HAVING count(*) >= 3",
        "matrix_degree_rank": f"WITH {_LOG} SELECT dst AS old, row_number() OVER (ORDER BY count(DISTINCT src), dst) - 1 AS new FROM log GROUP BY dst",
        "dictionary_restore": f"SELECT entity_id, {_restored(_nested_replace('attr'))} AS text FROM entities",
        "byte_size_stats": """
SELECT count(x) AS n, avg(x) AS mean, stddev_pop(x) AS deviation, median(x) AS median, list_sort(list(x))[least(count(x) - 1, CAST(floor(0.95 * count(x)) AS BIGINT)) + 1] AS p95,
  max(x) AS highest FROM (SELECT byte_size AS x FROM prov_events WHERE byte_size IS NOT NULL)""",
        "poi_metric_summary": _POI_METRICS,
        "poi_median": _POI_MEDIAN,
        "poi_spaced": _SPACED + "SELECT poi FROM pois",
        "event_text": f"SELECT srcid AS src, etype, dstid AS dst, coalesce(ts, 0) AS ts_ns {_TIMED}",
        "edge_list": f"SELECT srcid AS src, dstid AS dst {_TIMED}",
        "source_ids": f"SELECT DISTINCT srcid AS entity_id {_TIMED}",
        "entity_text": "SELECT entity_id, cls, attr FROM entities WHERE cls = 'file' AND attr = trim(attr) AND NOT contains(attr, chr(10)) AND NOT contains(attr, chr(13))",
        "one_snapshot": _tail("SELECT * FROM edges WHERE snapshot_id < 2"),
        "membership_json": _tail("SELECT node, label FROM members"),
        "block_table_text": _SNAP + _CODE + "SELECT * FROM blocks",
        "order_table_text": _SNAP + _CODE + "SELECT label, node, new_idx FROM perm",
        "intra_text": _tail("SELECT u AS src, v AS dst FROM intra"),
        "snapshot_table": _tail("SELECT snapshot_id, count(*) AS edges, sum(weight)::BIGINT AS events FROM edges GROUP BY snapshot_id"),
        "stream_hourly_counts": "SELECT date_trunc('hour', ingested_at) AS window_start, etype, count(*) AS n FROM prov_events WHERE ingested_at IS NOT NULL GROUP BY ALL",
    }
