import json
import re
from collections import defaultdict

from tests.helpers import order, rows
from tracewright.operators.drift import (
    CLASSES,
    NESTED,
    PROMOTED,
    TARGETS,
    canonical,
    consistent_table,
    ingest,
    kind_of,
    promote,
    schema_changes,
    with_found,
)
from tracewright.session import load

P = "com.bbn.tc.schema.avro.cdm18."
SCHEMA = "file_ord int, line_off long, value string, fields long"


def line(cls, body, v="cdm18"):
    return json.dumps({"datum": {f"com.bbn.tc.schema.avro.{v}.{cls}": body}})


def plain(v):
    return json.dumps(json.loads(re.sub(r"cdm\d+", "cdm", json.dumps(v))), sort_keys=True)


def kind(v):
    if isinstance(v, dict):
        return "o" + next(iter(v)).split(".")[-1] if len(v) == 1 else "o"
    return "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "s" if isinstance(v, str) else "a"


def brute(records, files):
    has, kinds, values = defaultdict(set), defaultdict(set), defaultdict(set)
    for f, _, text, *_ in records:
        try:
            body = json.loads(text)["datum"]
        except (ValueError, TypeError, KeyError):
            continue
        for name, b in body.items():
            cls = name.split(".")[-1]
            for k, v in b.items():
                if k != "uuid":
                    has[f, cls].add(k)
                    if v is not None:
                        kinds[f, cls, k].add(kind(v))
                        values[f, cls, k, b.get("uuid")].add(plain(v))
    out = []
    streams = defaultdict(list)
    for f, s, no, *_ in files:
        streams[s].append((no, f))
    for seq in streams.values():
        seq = [f for _, f in sorted(seq)]
        for a, b in zip(seq, seq[1:]):
            for cls in CLASSES:
                old, new = has[a, cls] - has[b, cls], has[b, cls] - has[a, cls]
                for k in has[a, cls] & has[b, cls]:
                    x, y = kinds[a, cls, k], kinds[b, cls, k]
                    if x and y and x != y:
                        out.append((b, cls, k, "retyped"))
                done = set()
                for o in old:
                    for n in new:
                        both = [u for (f, c, k, u) in values if (f, c, k) == (a, cls, o) and (b, cls, n, u) in values]
                        if both and all(values[a, cls, o, u] == values[b, cls, n, u] for u in both):
                            out.append((b, cls, f"{o}>{n}", "renamed"))
                            done |= {(o, 0), (n, 1)}
                out += [(b, cls, o, "removed") for o in old if (o, 0) not in done] + [(b, cls, n, "added") for n in new if (n, 1) not in done]
    return order(out)


def test_changes_of_a_small_stream(spark):
    r = [
        (0, 0, line("Subject", {"uuid": "a", "cmdLine": {"string": "x"}, "gone": 1, "k": 1, "u": {P + "UUID": "Q"}})),
        (0, 1, line("Subject", {"uuid": "b", "cmdLine": None, "k": None})),
        (0, 2, line("Event", {"uuid": "e", "exec": "v", "w": {"string": "s"}})),
        (4, 0, line("Subject", {"uuid": "a", "commandLine": {"string": "x"}, "k": "1", "new": True, "u2": {"com.bbn.tc.schema.avro.cdm20.UUID": "Q"}}, "cdm20")),
        (4, 1, line("Subject", {"uuid": "b", "commandLine": {"string": "y"}})),
        (4, 2, line("Subject", {"uuid": "a", "commandLine": {"string": "x"}})),
        (4, 3, line("Event", {"uuid": "other", "execName": "v", "w": "s"})),
        (4, 4, '{"datum": {"cut'), (4, 5, None), (4, 6, ""),
        (7, 0, line("Subject", {"uuid": "a", "cmdLine": {"string": "other"}, "k": None})),
        (9, 0, line("FileObject", {"uuid": "f", "filename": "n"})),
    ]
    files = [(0, "s", 0), (4, "s", 1), (7, "s", 2), (9, "t", 0)]
    records = spark.createDataFrame([(*x, 1) for x in r], SCHEMA)
    got = rows(schema_changes(records, spark.createDataFrame(files, "file_ord int, stream_name string, file_no int")))
    assert got == brute(r, files)
    assert (4, "Subject", "cmdLine>commandLine", "renamed") in got and (4, "Subject", "u>u2", "renamed") in got
    assert (4, "Event", "exec", "removed") in got and (4, "Event", "w", "retyped") in got
    assert (7, "Subject", "cmdLine", "added") in got


def test_changes_of_the_test_files(spark, data):
    records, files = load(spark, data, "raw_records"), load(spark, data, "raw_files")
    want = brute([tuple(x) for x in records.collect()], [(x["file_ord"], x["stream_name"], x["file_no"]) for x in files.collect()])
    got = rows(schema_changes(records, files), "file_ord", "rec_class", "field_name", "change_kind")
    assert got == want and len(want) > 3


def test_nothing_is_lost_in_ingestion(spark, data):
    records = load(spark, data, "raw_records")
    for cls in CLASSES:
        table = promote(ingest(records, cls), PROMOTED[cls])
        by_line = {(r["file_ord"], r["line_off"]): r.asDict() for r in table.collect()}
        n = 0
        for f, o, text in (tuple(x) for x in records.select("file_ord", "line_off", "value").collect()):
            try:
                datum = json.loads(text)["datum"]
            except (ValueError, TypeError, KeyError):
                continue
            for name, body in datum.items():
                if name.endswith("." + cls):
                    n += 1
                    row = by_line[f, o]
                    rest = json.loads(row["_rescued"] or "{}")
                    for k, v in body.items():
                        if k in rest:
                            assert rest[k] == v
                        elif v is not None and k != "uuid":
                            home = k if k in TARGETS[cls] else next(c for c, names in PROMOTED[cls].items() if k in names)
                            inner = next(iter(v.values())) if isinstance(v, dict) else v
                            assert str(row[home]) == str(inner)
        assert n == len(by_line)


def test_uncastable_is_rescued_and_promoted(spark):
    r = [
        (1, 0, line("FileObject", {"uuid": "a", "filename": 5, "size": "12", "path": {"string": "/p"}}), 1),
        (1, 1, line("FileObject", {"uuid": {P + "UUID": "b"}, "filename": {"string": "/f"}, "size": "1x", "path": "/p", "fd": True}), 1),
        (1, 2, line("FileObject", {"uuid": "c"}), 1), (1, 3, None, 1), (1, 4, line("Subject", {"uuid": "s"}), 1),
    ]
    got = {x["uuid"]: x for x in consistent_table(spark.createDataFrame(r, SCHEMA), "FileObject").collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["filename"], got["a"]["size"], json.loads(got["a"]["_rescued"])) == ("/p", 12, {"filename": 5})
    assert got["b"]["filename"] == "/f" and json.loads(got["b"]["_rescued"]) == {"size": "1x", "path": "/p", "fd": True}
    assert got["c"]["_rescued"] is None


def test_kinds():
    assert [kind_of(v) for v in (None, True, 1, 1.5, "a", [], {}, {"a": 1, "b": 2}, {P + "UUID": 1}, {"string": "x"})] == [
        None, "boolean", "number", "number", "string", "array", "object", "object", "object:UUID", "object:string",
    ]
    assert canonical({"b": [{P + "X": 1}], "a": None}) == canonical({"a": None, "b": [{"com.bbn.tc.schema.avro.cdm20.X": 1}]})


def test_empty(spark):
    records = spark.createDataFrame([], SCHEMA)
    files = spark.createDataFrame([], "file_ord int, stream_name string, file_no int")
    assert schema_changes(records, files).count() == 0 and ingest(records, "Event").count() == 0


def test_digit_strings_are_cast_over_all_of_int64(spark):
    good = {"1772457465789334187": 1772457465789334187, "9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63), "+5": 5, "0" * 5000 + "7": 7, "000": 0}
    bad = ["9223372036854775808", "-9223372036854775809", "9" * 5000, "1" * 20, "", "-", "1.0", "1e3", " 1", "١"]
    r = [(1, i, line("Event", {"uuid": str(i), "timestampNanos": x}), 1) for i, x in enumerate([*good, *bad])]
    got = consistent_table(spark.createDataFrame(r, SCHEMA), "Event").orderBy("line_off").collect()
    assert [x["timestampNanos"] for x in got] == [*good.values()] + [None] * len(bad)
    assert [json.loads(x["_rescued"])["timestampNanos"] if x["_rescued"] else None for x in got] == [None] * len(good) + bad


def test_every_rename_between_wanted_fields_ends_in_one_column(spark, data):
    records, files = load(spark, data, "raw_records"), load(spark, data, "raw_files")
    home = {cls: {a: c for c, names in (PROMOTED[cls] | NESTED.get(cls, {})).items() for a in (c, *names)} for cls in CLASSES}
    found = schema_changes(records, files).where("change_kind = 'renamed'").collect()
    assert found
    for r in found:
        old, _, new = r["field_name"].partition(">")
        at = home[r["rec_class"]]
        assert at[old] == at[new]


def test_renames_of_the_approved_lists(spark):
    bodies = {
        "Subject": [{"startTimestampNanos": 5, "cid": 1, "cmdLine": "a"}, {"startNanos": 5, "pid": 1, "cmd": {"string": "a"}}],
        "FileObject": [{"hashes": {"array": [{"type": "t", "hash": "h"}]}, "inode": 3}, {"digests": [{"type": "t", "hash": "h"}], "inodeNo": 3}],
        "NetFlowObject": [{"initTcpSeqNum": 4, "localAddress": "l"}, {"tcpSeq": 4, "local_address": "l"}],
        "Event": [{"predicateObjectPath": "p", "name": "n", "exec": "e"}, {"objectPath": {"string": "p"}, "syscall": "n", "image": "e"}],
    }
    for cls, (old, new) in bodies.items():
        df = spark.createDataFrame([(i, 0, line(cls, b), 1) for i, b in enumerate((old, new))], SCHEMA)
        a, b = (x.asDict() for x in consistent_table(df, cls).drop("line_off", "cdm_version").orderBy("file_ord").collect())
        assert a.pop("file_ord") == 0 and b.pop("file_ord") == 1
        assert a == b and a["_rescued"] is None and all(a[k] is not None for k in old)
        assert cls != "FileObject" or json.loads(a["hashes"]) == [{"type": "t", "hash": "h"}]


def test_renames_found_in_the_files_are_replayed(spark):
    r = [
        (0, 0, line("Event", {"uuid": "a", "exec": "x", "sequence": 1, "k": 7}), 1),
        (1, 0, line("Event", {"uuid": "a", "program": "x", "sequence": "1", "kk": 7}), 1),
        (2, 0, line("Event", {"uuid": "a", "binary": "x", "no": "1"}), 1),
        (2, 1, line("Event", {"uuid": "b", "binary": "z", "no": None}), 1),
    ]
    files = spark.createDataFrame([(0, "s", 0), (1, "s", 1), (2, "s", 2)], "file_ord int, stream_name string, file_no int")
    got = consistent_table(spark.createDataFrame(r, SCHEMA), "Event", files).orderBy("file_ord", "line_off").collect()
    assert [(x["exec"], x["sequence"]) for x in got] == [("x", 1), ("x", 1), ("x", 1), ("z", None)]
    assert [json.loads(x["_rescued"] or "null") for x in got] == [{"k": 7}, {"kk": 7}, None, {"no": None}]


def test_report_and_tables_take_lines_of_any_depth(spark):
    deep = "7"
    for _ in range(30_000):
        deep = '{"k":[' + deep + "]}"
    r = [(i, 0, '{"datum": {"%sEvent": {"uuid": "a", "%s": %s, "exec": "x"}}}' % (P, n, deep), 1) for i, n in enumerate(("old", "new"))]
    records, files = spark.createDataFrame(r, SCHEMA), spark.createDataFrame([(0, "s", 0), (1, "s", 1)], "file_ord int, stream_name string, file_no int")
    assert rows(schema_changes(records, files)) == [(1, "Event", "old>new", "renamed")]
    assert [(x["exec"], x["_rescued"]) for x in consistent_table(records, "Event", files).orderBy("file_ord").collect()] == [
        ("x", '{"%s":%s}' % (n, deep)) for n in ("old", "new")
    ]


def test_typed_and_rescued_values_are_equal_as_they_came(spark):
    """A value of a typed column meets one of the rescue column under the other name."""
    same = [{"string": "a"}, "a", {P + "Name": "a"}, None]
    r, want = [], []
    for i, old in enumerate(same):
        for j, new in enumerate(same):
            f = 2 * (4 * i + j)
            r += [(f, 0, line("Event", {"uuid": "u", "exec": old, "k": 1}), 1), (f + 1, 0, line("Event", {"uuid": "u", "other": new, "k": 1}), 1)]
            want += [(f + 1, "exec>other", "renamed")] if i == j < 3 else [(f + 1, "exec", "removed"), (f + 1, "other", "added")]
    files = [(f, f"s{f // 2}", f % 2) for f in range(32)]
    got = schema_changes(spark.createDataFrame(r, SCHEMA), spark.createDataFrame(files, "file_ord int, stream_name string, file_no int"))
    assert rows(got, "file_ord", "field_name", "change_kind") == order(want)


def test_a_name_beside_another_is_no_rename(spark):
    r = [(1, 0, line("FileObject", {"uuid": "f", "pathHint": "hint:/x"}), 1), (1, 1, line("Subject", {"uuid": "s", "tgid": 9}), 1)]
    df = spark.createDataFrame(r, SCHEMA)
    for cls, column, kept in (("FileObject", "filename", {"pathHint": "hint:/x"}), ("Subject", "cid", {"tgid": 9})):
        (x,) = consistent_table(df, cls).collect()
        assert x[column] is None and json.loads(x["_rescued"]) == kept


def test_found_names():
    found = [("a", "b"), ("b", "c"), ("x", "y"), ("a", "q"), ("e", "q"), ("a", "e"), ("p", "r")]
    assert with_found({"a": ("p",)}, ["a", "e"], found) == {"a": ("p", "b", "r", "c")}
