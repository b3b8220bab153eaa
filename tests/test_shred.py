import json

from tests.helpers import order, rows
from tracewright.operators.shred import array_objects, coverage, element_table, entity_rows, flat_table, scalar_table, shred, whole_json
from tracewright.plans.prepared import ELEMENT_TABLES, FLAT_TABLES
from tracewright.session import load

P = "com.bbn.tc.schema.avro.cdm18."
SCHEMA = "file_ord int, line_off long, value string, node_id long, label string"
WRAP = {"array", "map", "string", "int", "long", "bytes", "boolean"}


def wrapper(v):
    return isinstance(v, dict) and len(v) == 1 and (next(iter(v)) in WRAP or next(iter(v)).startswith("com.bbn.tc.schema.avro"))


def brute(v, path=""):
    """Paths of the objects that are array elements, by recursion."""
    if wrapper(v):
        yield from brute(next(iter(v.values())), path)
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from brute(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            if isinstance(x, dict):
                yield f"{path}[{i}]"
            yield from brute(x, f"{path}[{i}]")


BODIES = [
    {"uuid": "E1", "parameters": {"array": [{"size": 1, "name": {"string": "fd"}, "p": {"array": [{"a": {P + "UUID": "X"}, "hop": 2}]}}, {"size": 2}]}},
    {"uuid": "E2", "parameters": [], "x": None, "y": {"array": None}},
    {"uuid": "E3", "l": [1, "a", None, {"string": "w"}, {"array": [{"k": [[{"z": 1}], {}]}]}, {P + "Tag": {"t": [{}]}}]},
    {"uuid": "E4", "two": {"string": "a", "int": 1}, "m": {"map": {"array": [{"b": 1}], "c": [{"d": 2}]}}},
    {},
]


def line(body, cls="Event"):
    return json.dumps({"datum": {P + cls: body}})


def made():
    good = [(1, i * 10, line(b), 0, "") for i, b in enumerate(BODIES)] + [(2, 5, line(BODIES[0]), 0, "")]
    cut = line(BODIES[0])[:-3]
    bad = [(3, i, t, 0, "") for i, t in enumerate((None, "", " ", cut, "[1]", "3", '{"datum": null}', '{"datum": {"a.Event": NaN}}', '{"x": [{}]}', "null"))]
    return good, bad


def test_array_objects(spark):
    good, bad = made()
    got = array_objects(spark.createDataFrame(good + bad, SCHEMA))
    want = [(f, o, p) for f, o, t, *_ in good for p in brute(json.loads(t)["datum"][P + "Event"])]
    assert rows(got) == order(want)
    assert len(want) > 10


def test_nodes_keep_parents(spark):
    good, _ = made()
    nodes = [r.asDict() for r in shred(spark.createDataFrame(good, SCHEMA)).collect()]
    for n in nodes:
        own = {x["node_id"]: x for x in nodes if (x["file_ord"], x["line_off"]) == (n["file_ord"], n["line_off"])}
        if n["node_id"]:
            up = own[n["parent_id"]]
            assert up["kind"].replace("wrapped_", "") in ("object", "array")
            assert own[n["object_id"]]["kind"] == "object"
            assert n["node_path"].startswith(up["node_path"])
    assert {n["scalar"] for n in nodes if n["label"] == "hop"} == {"2"}


def test_flat_table(spark):
    good, bad = made()
    nodes = shred(spark.createDataFrame(good + bad, SCHEMA))
    got = flat_table(nodes, "Event", r"parameters\[[0-9]+\]", {"size": "size", "name": "name"})
    assert sorted((r[0], r[1], r[3], r[4], r[5]) for r in rows(got)) == [(1, 0, 0, "1", "fd"), (1, 0, 0, "2", None), (2, 5, 0, "1", "fd"), (2, 5, 0, "2", None)]
    deep = flat_table(nodes, "Event", r"parameters\[[0-9]+\]\.p\[[0-9]+\]", {"asset": "a", "hop": "hop"})
    inner = {r["parent_id"] for r in deep.collect()}
    assert rows(deep, "asset", "hop") == [("X", "2"), ("X", "2")]
    assert inner <= {r["node_id"] for r in got.collect()}
    assert flat_table(nodes, "NoSuch", "", {"a": "b"}).count() == 0


def test_long_and_deep_lines(spark):
    deep = {"a": 1}
    for _ in range(300):
        deep = {"k": [deep]}
    text = line({"uuid": "L", "s": "x" * 2_000_000, "d": deep})
    got = array_objects(spark.createDataFrame([(1, 1, text, 0, "")], SCHEMA))
    assert got.count() == 300


def test_empty_and_not_json(spark):
    assert array_objects(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whole_json("[" * 200_000) is None and whole_json('{"a": Infinity}') is None


def test_every_object_and_scalar_has_a_row(spark):
    good, bad = made()
    nodes = shred(spark.createDataFrame(good + bad, SCHEMA))
    objects, scalars = entity_rows(nodes).collect(), scalar_table(nodes).collect()
    in_arrays = order((r["file_ord"], r["line_off"], r["node_path"]) for r in objects if r["node_path"].endswith("]"))
    assert in_arrays == rows(array_objects(spark.createDataFrame(good + bad, SCHEMA)))
    assert len([r for r in objects if r["node_path"] == ""]) == len(good)
    by_id = {(r["file_ord"], r["line_off"], r["node_id"]) for r in objects}
    assert all(r["parent_id"] == -1 or (r["file_ord"], r["line_off"], r["parent_id"]) in by_id for r in objects)
    assert all((r["file_ord"], r["line_off"], r["parent_id"]) in by_id for r in scalars)
    listed = [(r["position"], r["kind"], r["value"]) for r in scalars if r["label"] == "l" and r["file_ord"] == 1]
    assert sorted(listed) == [(0, "number", "1"), (1, "string", "a"), (2, "null", None), (3, "string", "w")]
    assert sorted(tuple(r)[4:] for r in element_table(nodes, "Event", r"l\[[0-9]+\]").collect()) == [(0, "1"), (1, "a"), (2, None), (3, "w")]
    assert flat_table(nodes, "Event", "two|m", {}).columns == ["file_ord", "line_off", "node_id", "parent_id"]


def test_entities_of_any_depth_and_size(spark):
    deep, n = '{"z":1}', 3_000
    for _ in range(n):
        deep = '{"k":[' + deep + "]}"
    wide = json.dumps({f"f{i}": i for i in range(60_000)})
    text = '{"datum": {"%sEvent": {"d": %s, "w": %s}}}' % (P, deep, wide)
    got = entity_rows(shred(spark.createDataFrame([(1, 1, text, 0, ""), (1, 1, text, 0, "")], SCHEMA), paths=False)).select("place", "n_fields", "is_element")
    found = got.collect()
    assert sum(r["is_element"] for r in found) == n and len(found) == n + 3
    assert {r["n_fields"] for r in found} == {0, 1, 60_000}


def test_entity_rows(spark):
    good, bad = made()
    got = {(r["file_ord"], r["line_off"], r["node_path"]): r for r in entity_rows(shred(spark.createDataFrame(good + bad, SCHEMA))).collect()}
    assert got[1, 0, "parameters[0]"]["fields"] == "name=fd\nsize=1" and got[1, 0, "parameters[0]"]["place"] == "parameters[]"
    assert got[1, 20, "l[3]"]["fields"] == "=w" and got[1, 20, "l[4]"]["fields"] == "" and got[1, 20, ""]["n_fields"] == 1
    assert got[1, 30, "two"]["fields"] == "int=1\nstring=a" and got[1, 30, "m.array[0]"]["fields"] == "b=1"
    assert got[1, 40, ""]["n_fields"] == 0 and got[1, 40, ""]["parent_id"] == -1


def test_coverage_names_what_is_missing(spark):
    r = [(1, 0, line({"uuid": "e", "new": {"x": 1, "y": [1, None, {"z": 2}]}, "type": "t"}), 0, "")]
    got = coverage(shred(spark.createDataFrame(r, SCHEMA)), [("Event", "", {"u": "uuid"})], [])
    assert rows(got) == order([("Event", "", 1, 0, 2, 1), ("Event", "new", 1, 1, 1, 1), ("Event", "new.y[]", 1, 1, 2, 2)])


def test_registered_tables_leave_out_no_place(spark):
    tag = {"tagId": 1, "flow": "f", "children": [{"tagId": 2, "children": {"array": [{"tagId": 3, "children": [{"tagId": 4}]}]}}]}
    prov = {"asset": "a", "tags": [tag], "detail": {"codes": [7, 8], "steps": {"array": [tag]}}}
    r = [
        line({"uuid": "e", "properties": {"map": {"arg": "x", "host": "h"}}, "parameters": {"array": [{"size": 1, "provenance": [prov]}]}}),
        line({"uuid": "s", "properties": {"map": {"host": "h", "login": "l"}}, "importedLibraries": {"array": ["a", "b"]}}, "Subject"),
        line({"uuid": "f", "baseObject": {"epoch": 1, "properties": {"map": {"dev": "d", "mnt": "m"}}}, "digests": [{"type": "t", "hash": "h"}]}, "FileObject"),
        line({"uuid": "n", "baseObject": {"epoch": 1, "permission": None, "ifaces": [{"ifname": "i", "mtu": 1}]}}, "NetFlowObject"),
    ]
    nodes = shred(spark.createDataFrame([(1, i, t, 0, "") for i, t in enumerate(r)], SCHEMA)).cache()
    found = [tuple(x)[:4] for parts in FLAT_TABLES.values() for x in flat_table(nodes, *parts[:2], {}).collect()]
    assert order(found) == order(tuple(x)[:4] for x in entity_rows(nodes).collect()) and len(found) == 22
    elements = [tuple(x)[5] for parts in ELEMENT_TABLES.values() for x in element_table(nodes, *parts).collect()]
    assert sorted(elements) == ["7", "8", "a", "b"]
    depth = {x["tag_id"]: x["parent_id"] for x in flat_table(nodes, *FLAT_TABLES["p4_tags"]).collect()}
    ids = {x["tag_id"]: x["node_id"] for x in flat_table(nodes, *FLAT_TABLES["p4_tags"]).collect()}
    assert depth["2"] == ids["1"] and depth["3"] == ids["2"] and depth["4"] == ids["3"]
    nodes.unpersist()


def test_registered_tables_cover_the_test_records(spark, data):
    nodes = shred(load(spark, data, "raw_records")).cache()
    covered = sum(flat_table(nodes, cls, at, {}).count() for cls, at, _ in FLAT_TABLES.values())
    assert covered == entity_rows(nodes).count() > 0
    assert coverage(nodes, list(FLAT_TABLES.values()), list(ELEMENT_TABLES.values())).where("n_objects_missing + n_values_missing > 0").count() == 0
    for cls, at, fields in FLAT_TABLES.values():
        of = flat_table(nodes, cls, at, {}).withColumnRenamed("node_id", "owner").drop("parent_id")
        own = scalar_table(nodes).where("kind <> 'null' and position < 0").withColumnRenamed("parent_id", "owner").join(of, ["file_ord", "line_off", "owner"])
        assert {x["label"] for x in own.select("label").distinct().collect()} <= set(fields.values())
    elements = sum(element_table(nodes, *parts).count() for parts in ELEMENT_TABLES.values())
    assert elements == scalar_table(nodes).where("position >= 0").count() > 0
    nodes.unpersist()
