"""SQL counterparts of the queries of problems 1, 2, 4, 5 and 6, as far as SQL can state them."""

from __future__ import annotations

import os

P1_PROFILE = """
WITH sides AS (
  SELECT 'src' AS side, srcid AS entity_id, dstid AS partner, ts FROM prov_events
  UNION ALL
  SELECT 'dst', dstid, srcid, ts FROM prov_events)
SELECT side, entity_id, count(*) AS n_events, count(DISTINCT partner) AS n_partners,
  min(ts) FILTER (WHERE ts > 0) AS first_ts, max(ts) FILTER (WHERE ts > 0) AS last_ts,
  max(ts) FILTER (WHERE ts > 0) - min(ts) FILTER (WHERE ts > 0) AS span_ns
FROM sides WHERE entity_id IS NOT NULL GROUP BY side, entity_id
"""

P1_FOUND = """
WITH n AS (SELECT 0.02 * count(*) AS bound FROM prov_events)
SELECT 'src' AS side, srcid AS entity_id FROM prov_events WHERE srcid IS NOT NULL
GROUP BY srcid HAVING count(*) > (SELECT bound FROM n)
UNION ALL
SELECT 'dst', dstid FROM prov_events WHERE dstid IS NOT NULL
GROUP BY dstid HAVING count(*) > (SELECT bound FROM n)
"""

_WALK = """
WITH RECURSIVE links AS (
  SELECT seq, srcid AS parent, dstid AS child FROM prov_events
  WHERE etype IN ('EVENT_FORK', 'EVENT_CLONE') AND srcid IS NOT NULL AND dstid IS NOT NULL),
up AS (SELECT child, arg_min(parent, seq) AS parent FROM links GROUP BY child),
nodes AS (SELECT parent AS id FROM links UNION SELECT child FROM links),
walk(id, way, here) AS (
  SELECT id, [id], id FROM nodes
  UNION ALL
  SELECT w.id, list_append(w.way, u.parent), u.parent
  FROM walk w JOIN up u ON u.child = w.here WHERE NOT list_contains(w.way, u.parent)),
ends AS (
  SELECT w.id, w.way, u.parent AS again FROM walk w LEFT JOIN up u ON u.child = w.here
  WHERE u.parent IS NULL OR list_contains(w.way, u.parent)),
found AS (
  SELECT id, way, again, CASE WHEN again IS NULL THEN len(way) ELSE list_position(way, again) END AS p FROM ends)
"""

P2_FOUND = (
    _WALK
    + """
SELECT id AS entity_id,
  CASE WHEN again IS NULL THEN way[len(way)] ELSE list_min(way[p:]) END AS root_id,
  CAST(p - 1 AS BIGINT) AS depth,
  CASE WHEN again IS NULL THEN 'tree' WHEN p = 1 THEN 'cycle' ELSE 'under_cycle' END AS link_state
FROM found
"""
)

P2_PATHS = P2_FOUND.replace("AS link_state", "AS link_state, list_aggregate(list_reverse(way[1:p]), 'string_agg', '/') AS path")

#: All of a node's way upwards, which ends at a root or once round a loop; a node on a loop is its own ancestor too.
P2_DESCENDANTS = (
    _WALK
    + """
SELECT unnest(way[2:]) AS ancestor_id, id AS descendant_id, CAST(unnest(range(1, len(way))) AS BIGINT) AS distance FROM found
UNION ALL
SELECT id, id, CAST(len(way) AS BIGINT) FROM found WHERE again IS NOT NULL AND p = 1
"""
)

_WRAPPED = "(array|map|string|int|long|bytes|boolean|com\\.bbn\\.tc\\.schema\\.avro.*)"

#: Objects are walked down one level a step: (path, value inside its wrappers, whether an array's element that is an object).
P4_FOUND = rf"""
WITH RECURSIVE body AS (
  SELECT file_ord, line_off, unnest(json_keys(value, '$.datum')) AS cls, value FROM raw_records
  WHERE json_valid(value) AND json_type(value, '$.datum') = 'OBJECT'),
down(file_ord, line_off, path, v, hit, wrapped) AS (
  SELECT file_ord, line_off, '', json_extract(value, '$.datum."' || cls || '"'), false, false FROM body
  UNION ALL
  SELECT file_ord, line_off,
    CASE WHEN wrapper THEN path WHEN json_type(v) = 'ARRAY' THEN path || '[' || k || ']' WHEN path = '' THEN k ELSE path || '.' || k END,
    CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[' || k || ']') ELSE json_extract(v, '$."' || k || '"') END,
    json_type(v) = 'ARRAY', wrapper
  FROM (
    SELECT *, json_type(v) = 'OBJECT' AND len(keys) = 1 AND regexp_full_match(keys[1], '{_WRAPPED}') AS wrapper, unnest(keys) AS k
    FROM (
      SELECT *, CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v)
        WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) END AS keys
      FROM down WHERE json_type(v) IN ('OBJECT', 'ARRAY'))))
SELECT file_ord, line_off, path AS node_path FROM down WHERE hit AND json_type(v) = 'OBJECT'
"""


#: All nodes of all records, numbered depth first, wrappers taken off (w: there was one).
_NODES = rf"""
WITH RECURSIVE body AS (
  SELECT file_ord, line_off, unnest(json_keys(value, '$.datum')) AS cls, value FROM raw_records
  WHERE json_valid(value) AND json_type(value, '$.datum') = 'OBJECT'),
down(file_ord, line_off, cls, place, owner, label, ordinal, path, v, element, w) AS (
  SELECT file_ord, line_off, cls, [CAST(0 AS BIGINT)], CAST(NULL AS BIGINT[]), '', -1, '', json_extract(value, '$.datum."' || cls || '"'), false, false
  FROM body
  UNION ALL
  SELECT file_ord, line_off, cls,
    CASE WHEN wrapper THEN place ELSE list_append(place, i) END,
    CASE WHEN wrapper OR json_type(v) = 'ARRAY' THEN owner ELSE place END,
    CASE WHEN wrapper OR json_type(v) = 'ARRAY' THEN label ELSE k END,
    CASE WHEN wrapper THEN ordinal WHEN json_type(v) = 'ARRAY' THEN CAST(k AS INTEGER) ELSE -1 END,
    CASE WHEN wrapper THEN path WHEN json_type(v) = 'ARRAY' THEN path || '[' || k || ']' WHEN path = '' THEN k ELSE path || '.' || k END,
    CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[' || k || ']') ELSE json_extract(v, '$."' || k || '"') END,
    CASE WHEN wrapper THEN element ELSE json_type(v) = 'ARRAY' END, wrapper
  FROM (
    SELECT *, json_type(v) = 'OBJECT' AND len(keys) = 1 AND regexp_full_match(keys[1], '{_WRAPPED}') AS wrapper, unnest(keys) AS k,
      unnest(range(CAST(len(keys) AS BIGINT))) AS i
    FROM (
      SELECT *, CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v)
        WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) END AS keys
      FROM down WHERE json_type(v) IN ('OBJECT', 'ARRAY')))),
nodes AS (
  SELECT *, regexp_extract(cls, '([^.]*)$', 1) AS rec_class, CAST(row_number() OVER (PARTITION BY file_ord, line_off, cls ORDER BY place) - 1 AS INTEGER) AS node_id,
    CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
      ELSE 'number' END AS kind,
    CASE json_type(v) WHEN 'VARCHAR' THEN json_extract_string(v, '$') WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL
      ELSE CAST(v AS VARCHAR) END AS scalar
  FROM down
  WHERE NOT coalesce(json_type(v) = 'OBJECT' AND len(json_keys(v)) = 1 AND regexp_full_match(json_keys(v)[1], '{_WRAPPED}'), false)),
leaves AS (SELECT * FROM nodes WHERE kind NOT IN ('object', 'array')),
owned AS (
  SELECT o.*, coalesce(p.node_id, CAST(-1 AS INTEGER)) AS parent_id
  FROM nodes o LEFT JOIN nodes p ON p.file_ord = o.file_ord AND p.line_off = o.line_off AND p.cls = o.cls AND p.place = o.owner)
"""


def _flat(cls: str, at: str, fields: dict[str, str]) -> str:
    """The objects of a class at a path with their scalar children as columns."""
    cols = "".join(f", max(c.scalar) FILTER (WHERE c.label = '{label}') AS {name}" for name, label in fields.items())
    return (
        _NODES
        + f"""
SELECT o.file_ord, o.line_off, o.node_id, o.parent_id{cols}
FROM owned o LEFT JOIN leaves c ON c.file_ord = o.file_ord AND c.line_off = o.line_off AND c.cls = o.cls AND c.owner = o.place AND NOT c.element
WHERE o.rec_class = '{cls}' AND o.kind = 'object' AND regexp_full_match(o.path, '{at}')
GROUP BY o.file_ord, o.line_off, o.node_id, o.parent_id
"""
    )


def _elements(cls: str, at: str) -> str:
    """The scalar elements of the arrays of a class at a path."""
    return (
        _NODES
        + f"""
SELECT file_ord, line_off, node_id, parent_id, ordinal AS position, scalar AS value FROM owned
WHERE rec_class = '{cls}' AND element AND kind NOT IN ('object', 'array') AND regexp_full_match(path, '{at}')
"""
    )


P4_OBJECTS = (
    _NODES
    + r"""
SELECT o.file_ord, o.line_off, o.node_id, o.parent_id, o.rec_class, regexp_replace(o.path, '\[[0-9]+\]', '[]', 'g') AS place, o.path AS node_path,
  o.element AS is_element, count(c.scalar) + CAST(o.scalar IS NOT NULL AS BIGINT) AS n_fields,
  coalesce('=' || o.scalar, string_agg(c.label || '=' || c.scalar, chr(10) ORDER BY c.label), '') AS fields
FROM owned o LEFT JOIN leaves c ON c.file_ord = o.file_ord AND c.line_off = o.line_off AND c.cls = o.cls AND c.owner = o.place AND NOT c.element AND o.kind = 'object'
WHERE o.kind = 'object' OR (o.element AND o.w)
GROUP BY o.file_ord, o.line_off, o.node_id, o.parent_id, o.rec_class, o.path, o.element, o.scalar
"""
)

P4_SCALARS = (
    _NODES
    + """
SELECT file_ord, line_off, node_id, parent_id, rec_class, label, ordinal AS position, kind, scalar AS value, path AS node_path
FROM owned WHERE kind NOT IN ('object', 'array')
"""
)

#: Every object and value of the records has its place in a flat table: none is missing.
P4_COVERAGE = (
    _NODES
    + r"""
SELECT rec_class, regexp_replace(CASE WHEN kind IN ('object', 'array') OR element THEN path ELSE left(path, greatest(0, len(path) - len(label) - 1)) END,
    '\[[0-9]+\]', '[]', 'g') AS place,
  count(*) FILTER (WHERE kind IN ('object', 'array')) AS n_objects, CAST(0 AS BIGINT) AS n_objects_missing,
  count(scalar) AS n_values, CAST(0 AS BIGINT) AS n_values_missing
FROM nodes WHERE kind = 'object' OR (kind = 'array' AND element AND w) OR scalar IS NOT NULL GROUP BY ALL
"""
)


P6_FOUND = r"""
WITH body AS (
  SELECT file_ord, unnest(json_keys(value, '$.datum')) AS name, value FROM raw_records
  WHERE json_valid(value) AND json_type(value, '$.datum') = 'OBJECT'),
own AS (
  SELECT file_ord, regexp_extract(name, '([^.]*)$', 1) AS rec_class, json_extract(value, '$.datum."' || name || '"') AS b FROM body),
cells AS (
  SELECT file_ord, rec_class, json_extract_string(b, '$.uuid') AS uuid, k AS field, json_extract(b, '$."' || k || '"') AS v
  FROM (SELECT *, unnest(json_keys(b)) AS k FROM own WHERE json_type(b) = 'OBJECT' AND rec_class IN ('Subject', 'FileObject', 'NetFlowObject', 'Event'))
  WHERE k <> 'uuid'),
kinded AS (
  SELECT *, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array'
    WHEN 'OBJECT' THEN CASE WHEN len(json_keys(v)) = 1 THEN 'object:' || regexp_extract(json_keys(v)[1], '([^.]*)$', 1) ELSE 'object' END
    ELSE 'number' END AS kind,
    regexp_replace(CAST(v AS VARCHAR), 'cdm[0-9]+', 'cdm', 'g') AS text
  FROM cells),
fields AS (SELECT file_ord, rec_class, field, list_sort(coalesce(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL), [])) AS kinds FROM kinded GROUP BY ALL),
pairs AS (SELECT * FROM (SELECT file_ord, lag(file_ord) OVER (PARTITION BY stream_name ORDER BY file_no) AS prev FROM raw_files) WHERE prev IS NOT NULL),
old AS (SELECT p.file_ord, p.prev, f.rec_class, f.field, f.kinds FROM pairs p JOIN fields f ON f.file_ord = p.prev),
new AS (SELECT p.file_ord, p.prev, f.rec_class, f.field, f.kinds FROM pairs p JOIN fields f ON f.file_ord = p.file_ord),
gone AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.file_ord = o.file_ord AND n.rec_class = o.rec_class AND n.field = o.field)),
come AS (SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.file_ord = o.file_ord AND n.rec_class = o.rec_class AND n.field = o.field)),
held AS (
  SELECT file_ord, rec_class, field, uuid, list_sort(list(DISTINCT text)) AS texts FROM kinded
  WHERE kind IS NOT NULL AND uuid IS NOT NULL GROUP BY ALL),
renamed AS (
  SELECT g.file_ord, g.rec_class, g.field AS was, c.field AS now
  FROM gone g JOIN come c ON c.file_ord = g.file_ord AND c.rec_class = g.rec_class
  JOIN held a ON a.file_ord = g.prev AND a.rec_class = g.rec_class AND a.field = g.field
  JOIN held b ON b.file_ord = g.file_ord AND b.rec_class = g.rec_class AND b.field = c.field AND b.uuid = a.uuid
  GROUP BY ALL HAVING bool_and(a.texts = b.texts))
SELECT o.file_ord, o.rec_class, o.field AS field_name, 'retyped' AS change_kind FROM old o JOIN new n USING (file_ord, rec_class, field)
WHERE len(o.kinds) > 0 AND len(n.kinds) > 0 AND o.kinds <> n.kinds
UNION ALL SELECT file_ord, rec_class, was || '>' || now, 'renamed' FROM renamed
UNION ALL SELECT file_ord, rec_class, field, 'removed' FROM gone g
  WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_ord = g.file_ord AND r.rec_class = g.rec_class AND r.was = g.field)
UNION ALL SELECT file_ord, rec_class, field, 'added' FROM come c
  WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_ord = c.file_ord AND r.rec_class = c.rec_class AND r.now = c.field)
"""

#: What the consistent tables must hold: a column, its type, and the names it has had in the files.
_TABLES = {
    "Subject": """
        type string type; cid long cid processId pid; parentSubject string parentSubject; localPrincipal string localPrincipal principal
        startTimestampNanos long startTimestampNanos startNanos; cmdLine string cmdLine cmdline commandLine cmd""",
    "FileObject": """
        type string type; filename string filename fileName path objectPath; fileDescriptor long fileDescriptor fd; size long size
        inode long inode inodeNo; hashes json hashes digests""",
    "NetFlowObject": """
        localAddress string localAddress srcAddress local_address; localPort long localPort srcPort; remoteAddress string remoteAddress dstAddress remote_address
        remotePort long remotePort dstPort; ipProtocol long ipProtocol; initTcpSeqNum long initTcpSeqNum tcpSeq""",
    "Event": """
        type string type; sequence long sequence seqNo; threadId long threadId; subject string subject; predicateObject string predicateObject
        timestampNanos long timestampNanos; size long size; exec string exec execName exe image; name string name syscall
        predicateObjectPath string predicateObjectPath objectPath""",
}


def _field(name: str, kind: str) -> str:
    """A field of body b as a column's type, its wrapper off; null where it isn't of the type."""
    j = f"json_extract(b, '$.{name}')"
    wrapped = f"json_type({j}) = 'OBJECT' AND len(json_keys({j})) = 1 AND regexp_full_match(json_keys({j})[1], '{_WRAPPED}')"
    x = f"(CASE WHEN {wrapped} THEN json_extract({j}, '$.*')[1] ELSE {j} END)"
    if kind == "json":
        return f"CASE WHEN json_type({x}) <> 'NULL' THEN CAST({x} AS VARCHAR) END"
    text = f"CASE WHEN json_type({x}) = 'VARCHAR' THEN json_extract_string({x}, '$') END"
    if kind == "string":
        return text
    digits = f"CASE WHEN json_type({x}) IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN CAST({x} AS VARCHAR) ELSE {text} END"
    return f"CASE WHEN regexp_full_match({digits}, '[+-]?[0-9]+') THEN TRY_CAST({digits} AS BIGINT) END"


def _consistent(cls: str) -> str:
    """All records of a class: each column from its own name or, where that gives nothing, the first other name that does; the rest as JSON."""
    columns = [c.split() for line in _TABLES[cls].split("\n") for c in line.split(";") if c.strip()]
    # numbered, as names that differ in case only are one to SQL
    cells = [f"{_field(n, kind)} AS \"{column}:{i}\"" for column, kind, *names in columns for i, n in enumerate(names)]
    picks, taken = [], []
    for column, _, *names in columns:
        picks.append(f"coalesce({', '.join(f'"{column}:{i}"' for i in range(len(names)))}) AS \"{column}\"")
        for i, n in enumerate(names):
            before = "".join(f" AND \"{column}:{j}\" IS NULL" for j in range(i))
            taken.append(f"(k = '{n}' AND \"{column}:{i}\" IS NOT NULL{before})")
    own = ", ".join(f"'{column}'" for column, *_ in columns)
    return f"""
WITH body AS (
  SELECT file_ord, line_off, unnest(json_keys(value, '$.datum')) AS name, value FROM raw_records
  WHERE json_valid(value) AND json_type(value, '$.datum') = 'OBJECT'),
own AS (
  SELECT row_number() OVER () AS id, file_ord, line_off, regexp_extract(name, '(cdm[0-9]*)[.][^.]*$', 1) AS cdm_version,
    json_extract(value, '$.datum."' || name || '"') AS b
  FROM body WHERE regexp_extract(name, '([^.]*)$', 1) = '{cls}'),
typed AS (SELECT *, {_field("uuid", "string")} AS uuid, {", ".join(cells)} FROM own WHERE json_type(b) = 'OBJECT'),
keys AS (SELECT *, unnest(json_keys(b)) AS k, unnest(range(CAST(len(json_keys(b)) AS BIGINT))) AS i FROM typed),
cells AS (
  SELECT *, json_extract(b, '$."' || k || '"') AS v, coalesce(json_type(json_extract(b, '$."' || k || '"')) = 'NULL'
    OR (len(json_keys(json_extract(b, '$."' || k || '"'))) = 1 AND json_type(json_extract(json_extract(b, '$."' || k || '"'), '$.*')[1]) = 'NULL'), false) AS nothing
  FROM keys),
rest AS (
  SELECT id, '{{' || string_agg('"' || k || '":' || CAST(v AS VARCHAR), ',' ORDER BY i) || '}}' AS _rescued FROM cells
  WHERE k <> 'uuid' AND NOT (k IN ({own}) AND nothing) AND NOT ({" OR ".join(taken)}) GROUP BY id)
SELECT t.file_ord, t.line_off, t.cdm_version, t.uuid, {", ".join(picks)}, r._rescued
FROM typed t LEFT JOIN rest r ON r.id = t.id
"""


#: The catalogue of event types is a fixed table; a column's name is a value of it.
CATALOGUE = "/root/testdata/sf0.001/etype_catalog.parquet"


def _features(types: list[str]) -> str:
    cols = ""
    for t in types:
        is_it, name = "etype = '" + t.replace("'", "''") + "'", t.replace('"', '""')
        cols += f""",
  count(*) FILTER (WHERE {is_it}) AS "{name}_n", any_value(t) - max(ts) FILTER (WHERE {is_it} AND ts > 0) AS "{name}_age_ns",
  CAST(coalesce(sum(byte_size) FILTER (WHERE {is_it}), 0) AS BIGINT) AS "{name}_bytes\""""
    return f"""
SELECT srcid AS entity_id, count(*) AS n_events, any_value(t) - max(ts) FILTER (WHERE ts > 0) AS age_ns,
  CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS total_bytes{cols}
FROM (SELECT *, (SELECT max(ts) FROM prov_events) AS t FROM prov_events WHERE srcid IS NOT NULL) GROUP BY srcid
"""


def _catalogue() -> list[str]:
    import pyarrow.parquet as pq

    return sorted({t for t in pq.read_table(CATALOGUE, columns=["etype"])["etype"].to_pylist() if t is not None})


def oracle_sql() -> dict[str, str]:
    from tracewright.plans.prepared import ELEMENT_TABLES, FLAT_TABLES

    return {
        "p1_found": P1_FOUND,
        "p1_profile": P1_PROFILE,
        "p2_found": P2_FOUND,
        "p2_paths": P2_PATHS,
        "p2_descendants": P2_DESCENDANTS,
        "p4_found": P4_FOUND,
        **{name: _flat(*parts) for name, parts in FLAT_TABLES.items()},
        **{name: _elements(*parts) for name, parts in ELEMENT_TABLES.items()},
        "p4_objects": P4_OBJECTS,
        "p4_scalars": P4_SCALARS,
        "p4_coverage": P4_COVERAGE,
        **({"p5_features": _features(_catalogue())} if os.path.exists(CATALOGUE) else {}),
        "p6_found": P6_FOUND,
        "p6_subjects": _consistent("Subject"),
        "p6_files": _consistent("FileObject"),
        "p6_netflows": _consistent("NetFlowObject"),
        "p6_events": _consistent("Event"),
    }
