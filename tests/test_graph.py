"""The graph operators against brute force and by invariants."""

from collections import defaultdict
from random import Random

import pytest

from tests.helpers import order, rows
from tracewright.functions import scalar
from tracewright.operators import codec, communities, entities, extract, metrics, traverse
from tracewright.operators.ordering import with_position
from tracewright.operators.snapshots import cut_snapshots
from tracewright.sources import raw_log
from tracewright.sources.profiles import PROFILES


def greedy(events, n):
    out, now, seen = [], 0, set()
    for seq, a, b in events:
        out.append((seq, now))
        seen |= {a, b}
        if len(seen) >= n:
            now, seen = now + 1, set()
    return out


@pytest.mark.parametrize("n,chunk", [(2, 50), (7, 5), (7, 1000), (30, 3), (30, 200), (10**6, 10)])
def test_snapshot_cut_is_greedy(spark, n, chunk):
    r = Random(n * chunk)
    events = [(i * 3, r.randrange(40), r.choice([0, 0, r.randrange(40)])) for i in range(400)]
    df = spark.createDataFrame(events, "seq long, src long, dst long").repartition(5)
    assert rows(cut_snapshots(df, ["seq"], n, chunk, fan=3), "seq", "snapshot_id") == order(greedy(events, n))


def test_snapshot_cut_ends_on_a_bound_and_empty(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (2, 4, 5), (3, 4, 6)], "seq long, src long, dst long")
    assert rows(cut_snapshots(df, ["seq"], 3, 2), "seq", "snapshot_id") == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert cut_snapshots(df.where("false"), ["seq"], 3).count() == 0


def test_positions(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "'x' AS pos").repartition(6)
    assert [tuple(r) for r in with_position(df, "k").orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_running_sums(spark):
    from tracewright.operators.ordering import with_running_sum

    df = spark.range(500).selectExpr("(id * 37) % 500 AS k", "id % 7 AS v").repartition(6)
    values = {r["k"]: r["v"] for r in df.collect()}
    got = {r["k"]: r["s"] for r in with_running_sum(df, "v", "k", name="s").collect()}
    assert got == {k: sum(values[i] for i in range(k)) for k in range(500)}
    assert with_running_sum(df.where("false"), "v", "k", name="s").count() == 0


def test_louvain_finds_the_cliques():
    edges = [(a, b, 1.0) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)]
    edges += [(4, 10, 1.0), (14, 20, 1.0), (2, 2, 1.0)]
    assert communities.louvain(edges) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14], [20, 21, 22, 23, 24]]
    assert communities.louvain([]) == [] and communities.louvain([(1, 1, 2.0)]) == [[1]]


def quality(edges, parts):
    home = {u: i for i, p in enumerate(parts) for u in p}
    deg, total, inside = defaultdict(float), 0.0, 0.0
    for u, v, w in edges:
        deg[u] += w
        deg[v] += w
        total += w
        inside += w * (home[u] == home[v])
    return inside / total - sum(sum(deg[u] for u in p) ** 2 for p in parts) / (2 * total) ** 2


@pytest.mark.parametrize("seed", range(4))
def test_louvain_partitions_and_gains(seed):
    r = Random(seed)
    edges = [(r.randrange(30), r.randrange(30), float(r.randrange(1, 5))) for _ in range(90)]
    parts = communities.louvain(edges, seed)
    nodes = {x for e in edges for x in e[:2]}
    assert sorted(x for p in parts for x in p) == sorted(nodes)
    assert quality(edges, parts) > quality(edges, [[x] for x in nodes])
    assert communities.louvain(edges, seed) == parts


@pytest.mark.parametrize("greedy_hubs", [True, False])
def test_slashburn_is_a_permutation(greedy_hubs):
    r = Random(3)
    edges = [(r.randrange(60), int(r.random() ** 3 * 60)) for _ in range(120)]
    for k in (1, 3, None):
        found = codec.slashburn(60, edges, k, greedy_hubs)
        assert sorted(found.order) == list(range(60)) and found.order == plain_slashburn(60, edges, k or 1, greedy_hubs)
    star = [(0, i) for i in range(1, 8)]
    assert codec.slashburn(8, star) == ([1, 2, 3, 4, 5, 6, 7, 0], 1, 1)
    assert codec.slashburn(0, []).order == [] and codec.slashburn(3, [(1, 1)], 5).order == [2, 1, 0]


def plain_slashburn(n, edges, k, greedy_hubs):
    """By sets, looking at everything in every round."""
    links = {frozenset(e) for e in edges if e[0] != e[1]}
    left, low, high = set(range(n)), [], []

    def degree(v, among):
        return sum(v in e and e <= among for e in links)

    while left:
        among = frozenset(left)
        for _ in range(min(k, len(left))):
            v = max(left, key=lambda x: (degree(x, left if greedy_hubs else among), -x))
            left.discard(v)
            high.insert(0, v)
        parts = []
        while rest := left - {x for p in parts for x in p}:
            part = {min(rest)}
            while more := {x for e in links if e <= left and e & part for x in e} - part:
                part |= more
            parts.append(sorted(part))
        for p in sorted(parts, key=lambda p: (len(p), p)):
            if len(p) < max(2, k):
                low += p
                left -= set(p)
    return low + high


@pytest.mark.parametrize("seed", range(6))
def test_slashburn_is_the_plain_one(seed):
    r = Random(seed)
    n = 40
    edges = [(r.randrange(n), int(r.random() ** (1 + seed % 3) * n)) for _ in range(20 + 15 * seed)]
    for k in (1, 2, 3, 5, 8):
        for greedy_hubs in (True, False):
            assert codec.slashburn(n, edges, k, greedy_hubs).order == plain_slashburn(n, edges, k, greedy_hubs)


def test_groups_over_batch_bounds(spark):
    import pyarrow as pa

    from tracewright.operators.grouped import over_groups

    df = spark.range(500).selectExpr("CAST(id % 37 AS STRING) AS k", "id AS v").repartition(5)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = over_groups(df, "k", lambda k, g: [(k, sum(g["v"]), len(g["v"]))], "k string, s long, n long", pa.schema([("k", pa.string()), ("s", pa.int64()), ("n", pa.int64())]))
        want = [(str(k), sum(range(k, 500, 37)), len(range(k, 500, 37))) for k in range(37)]
        assert rows(got) == order(want)
        assert rows(over_groups(df.where("false"), "k", lambda k, g: [(k, 0, 0)], "k string, s long, n long", pa.schema([("k", pa.string()), ("s", pa.int64()), ("n", pa.int64())]))) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_louvain_partition_covers_each_snapshot(spark):
    edges = spark.createDataFrame([(s, u, (u * 7 + s) % 25, 1 + u % 3) for s in range(12) for u in range(25)], "snapshot_id int, u long, v long, weight long")
    got = communities.louvain_partition(edges)
    assert got.count() == 12 * 25 == got.select("snapshot_id", "node").distinct().count()
    one = sorted((r["node"], r["label"]) for r in got.where("snapshot_id = 3").collect())
    want = communities.louvain([(u, (u * 7 + 3) % 25, float(1 + u % 3)) for u in range(25)], 42 * 1_000_003 + 3)
    assert one == sorted((n, f"3.{i}") for i, c in enumerate(want) for n in c)


def test_codec_round_trip_with_loops(spark):
    intra = spark.createDataFrame([("0.0", 1, 1), ("0.0", 1, 9), ("0.0", 5, 9), ("0.1", 3, 4)], "label string, u long, v long")
    members = spark.createDataFrame([("0.0", n, i) for i, n in enumerate((1, 5, 9, 11, 12, 13))] + [("0.1", 3, 0), ("0.1", 4, 1)], "label string, node long, pos int")
    orders = codec.degree_order(members, intra)
    assert rows(orders.where("label = '0.0'"), "node", "new_idx")[:1] == [(1, 0)]
    blocks = codec.encode_blocks(codec.cells(intra, orders))
    back = codec.decode_edges(codec.parse_block_text(codec.block_text(blocks)), orders)
    assert rows(back) == rows(intra)
    burnt = codec.slashburn_order(members, intra)
    assert sorted(r["new_idx"] for r in burnt.where("label = '0.0'").collect()) == list(range(6))
    assert rows(codec.decode_edges(codec.encode_blocks(codec.cells(intra, burnt)), burnt)) == rows(intra)


def test_dictionary(spark):
    texts = ["/usr/lib/x", "/etc1/lib", "$4$bash$", "", None, "$$", "/bash_completion.d", "a:b", "/Downloads/cache/42$"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codec.compress(F.col("t")).alias("c"), codec.restore_exact(codec.compress_exact(F.col("t"))).alias("back"))
    got = {r["t"]: (r["c"], r["back"]) for r in df.collect()}
    assert all(back == t for t, (_, back) in got.items())
    assert got["/etc1/lib"][0] == "$2$1$1$" and got["/bash_completion.d"][0] == "/$4$_$40$.d".replace("$40$.d", "completion.d").replace("completion.d", "$40$")


def test_expand_stops_at_full_recall(spark):
    members = spark.createDataFrame([(n, lab) for lab, ns in {"a": (1, 2), "b": (2, 3), "c": (3, 4), "d": (4, 5)}.items() for n in ns], "node long, label string")
    pois = spark.createDataFrame([(1,), (77,)], "poi long")
    attack = spark.createDataFrame([(1,), (3,), (88,)], "node long")
    curve, visits = traverse.expand(pois, members, attack)
    assert rows(curve) == [(1, 0, 1, 2, 1), (1, 1, 2, 3, 2)]
    assert rows(visits) == [(1, "a", 0), (1, "b", 1)]
    far, _ = traverse.expand(pois, members, attack.where("node = 1").unionByName(spark.createDataFrame([(5,)], "node long")), max_hop=2)
    assert rows(far) == [(1, 0, 1, 2, 1), (1, 1, 2, 3, 1), (1, 2, 3, 4, 1)]
    none, _ = traverse.expand(pois.where("poi = 77"), members, attack)
    assert none.count() == 0


def test_components_chain(spark):
    members = spark.createDataFrame([(n, f"{i:03d}") for i in range(60) for n in (i, i + 1)] + [(1000, "x"), (1000, "y")], "node long, label string")
    got = traverse.components(members)
    assert {(r["component"]) for r in got.collect()} == {"000", "x"} and got.count() == 62


def test_budget_places(spark):
    members = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (2, "b", 0), (3, "b", 1), (4, "b", 2)], "node long, label string, pos int")
    visits = spark.createDataFrame([(9, "a", 0), (9, "b", 1)], "poi long, label string, hop int")
    attack = spark.createDataFrame([(1,), (4,)], "node long")
    hits = metrics.hit_positions(visits, members, attack)
    assert rows(hits) == [(9, 1, 1), (9, 4, 4)]
    pois = spark.createDataFrame([(9,), (8,)], "poi long")
    got = rows(metrics.recall_budget(hits, pois, 4, 2, (25, 100), (50, 100)))
    assert got == [(8, 0, 0, None, None), (9, 1, 2, 1, 4)]


def test_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, None)] + [("b", 3)], "k string, v long")
    assert rows(scalar.upper_median(df, ["k"], "v")) == [("a", 4, 5), ("b", 1, 3)]
    assert rows(metrics.timing_stats(df.where("k = 'a'"), "v"), "n", "median", "p95", "highest") == [(4, 3.0, 9, 9)]


CDM = "com.bbn.tc.schema.avro.cdm18."


def event(s, o, kind="EVENT_READ", path=None, ts="5,", more=""):
    where = f'"predicateObjectPath":{{"string":"{path}"}},' if path is not None else ""
    subject = f'"subject":{{"{CDM}UUID":"{s}"}},' if s else ""
    target = f'"predicateObject":{{"{CDM}UUID":"{o}"}},' if o else ""
    return f'{{"datum":{{"{CDM}Event":{{"uuid":"E","type":"{kind}",{subject}{target}{where}"timestampNanos":{ts}"z":0{more}}}}}}}'


LINES = [
    event("S1", "F1", path="/first"), f'{{"datum":{{"{CDM}Subject":{{"uuid":"S1","cmdLine":{{"string":"old"}}}}}}}}',
    f'{{"datum":{{"{CDM}Subject":{{"uuid":"S1","x":null}}}}}}', f'{{"datum":{{"{CDM}FileObject":{{"uuid":"F1","filename":"/own"}}}}}}',
    f'{{"datum":{{"{CDM}FileObject":{{"uuid":"F2"}}}}}}', event("S1", "F2", path="/late"), event("S1", "S1", "EVENT_FLOWS_TO"), event("S1", None),
    event("S1", "N1", "EVENT_CONNECT", ts="x"), f'{{"datum":{{"{CDM}NetFlowObject":{{"uuid":"N1","b":null,"localAddress":"a","localPort":1,"remoteAddress":"b","remotePort":2,"z":0}}}}}}',
    f'{{"datum":{{"{CDM}NetFlowObject":{{"uuid":"N1"}}}}}}', event("S1", "U1", "EVENT_OPEN"), event("S1", "U1", "EVENT_TEA"),
    f'{{"datum":{{"{CDM}Subject":{{"uuid":"{"L" * 64}"}}}}}}', None, "", "noise",
]


def test_extraction_quirks(spark):
    records = spark.createDataFrame([(0, i, t) for i, t in enumerate(LINES)], "file_ord int, line_off long, value string")
    fast, strict, by_name = PROFILES["cadets_fast"], PROFILES["theia_e3"], PROFILES["theia_fast"]
    assert rows(extract.subjects(records, fast), "uuid", "attr") == [("L" * 64, "null"), ("S1", "null")]
    assert rows(extract.subjects(records, strict), "uuid", "attr") == [("S1", "old")]
    assert rows(extract.files(records, fast), "uuid", "attr") == [("F1", "/first"), ("F2", "")]
    assert rows(extract.files(records, by_name), "uuid", "attr") == [("F1", "/own"), ("F2", "")]
    assert rows(extract.sockets(records, fast), "uuid", "attr") == [("N1", "a,1,b,2")]
    tuples = extract.event_tuples(records, fast)
    assert rows(tuples, "dst_uuid", "etype", "ts_ns") == [("F1", "EVENT_READ", 5), ("F2", "EVENT_READ", 5), ("N1", "EVENT_CONNECT", 0), ("U1", "EVENT_OPEN", 5)]
    assert rows(entities.entity_table(records, fast)) == [(0, "S1", "subject", "null"), (1, "F1", "file", "/first"), (2, "F2", "file", ""), (3, "N1", "socket", "a,1,b,2"), (4, "U1", "other", "other")]
    assert entities.resolve_events(records, fast, strict=True).count() == 3
    assert entities.entity_table(records.where("false"), fast).count() == 0


def test_ordered_scan(spark, tmp_path):
    (tmp_path / "b.json").write_text("1\n2\n3\n")
    (tmp_path / "a.json").write_text("4\n\n5")
    source = raw_log.LogSource(str(tmp_path), ("b.json", "a.json", "none.json"), skip_missing=True)
    got = [tuple(r) for r in raw_log.read_log(spark, source).orderBy("line_off").collect()]
    assert got == [(0, 0, "1"), (0, 1, "2"), (0, 2, "3"), (1, 3, "4"), (1, 4, ""), (1, 5, "5")]
    with pytest.raises(FileNotFoundError):
        raw_log.read_log(spark, raw_log.LogSource(str(tmp_path), ("none.json",)))


def test_ordered_scan_of_two_folders(spark, tmp_path):
    for folder, line in (("x y", "1"), ("z", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.json").write_text(line + "\n")
    got = raw_log.read_log(spark, raw_log.LogSource(str(tmp_path), ("z/a.json", "x y/a.json")))
    assert rows(got) == [(0, 0, "2"), (1, 1, "1")]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as Some

    from tracewright.session import shared_dir

    of = Some(sc=lambda: Some(getCheckpointDir=lambda: Some(isDefined=lambda: False)))
    session = Some(conf=Some(get=lambda *_: None), sparkContext=Some(master="spark://one:7077", _jsc=of))
    with pytest.raises(ValueError):
        shared_dir(session)


def test_text_tables(spark, tmp_path):
    from tracewright.operators.storage import write_entities_text, write_events_text, write_report, write_table

    ev = spark.createDataFrame([(1, "EVENT_READ", 2, 7), (3, "EVENT_OPEN", 4, None)], "src long, etype string, dst long, ts_ns long")
    write_events_text(ev, str(tmp_path / "ev"))
    assert rows(raw_log.read_event_text(spark, str(tmp_path / "ev"))) == [(1, "EVENT_READ", 2, 7), (3, "EVENT_OPEN", 4, 0)]
    en = spark.createDataFrame([(1, "file", "/a:b"), (2, "subject", None)], "entity_id long, cls string, attr string")
    write_entities_text(en, str(tmp_path / "en"))
    assert rows(raw_log.read_entity_text(spark, str(tmp_path / "en/cls=file"), "file")) == [(1, "file", "/a:b")]
    write_table(ev, str(tmp_path / "t"), "etype")
    write_report(ev, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "t")).where("etype = 'EVENT_READ'").count() == 1
    (tmp_path / "gt").write_text("7 uuid\n\n7 again\n9 x\n")
    assert rows(raw_log.read_ids(spark, str(tmp_path / "gt"))) == [(7,), (9,)]


def test_matrices(spark):
    e = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (3, 0), (None, 1)], "src long, dst long")
    assert rows(raw_log.read_weighted_edges(e, normalize=True, damping=0.5)) == order([(0, 1, 2 / 3 * 0.5), (0, 2, 1 / 3 * 0.5), (3, 0, 0.5)])
    m = raw_log.read_weighted_edges(e, transpose=True, add_identity=True)
    assert (1, 0, 2.0) in rows(m) and (3, 3, 1.0) in rows(m)
    perm = spark.createDataFrame([(0, 3), (1, 2), (2, 1), (3, 0)], "old long, new long")
    cells = raw_log.read_weighted_edges(e)
    assert rows(codec.reorder_matrix(cells, perm)) == [(0, 3, 1.0), (3, 1, 1.0), (3, 2, 2.0)]
    v = spark.createDataFrame([(0, 5.0), (1, 6.0)], "i long, v double")
    assert rows(codec.reorder_vector(codec.reorder_vector(v, perm), perm, reverse=True)) == rows(v)
    assert rows(codec.partition_matrix(cells, 1)) == [(1, 0, 0, 2.0), (1, 0, 1, 1.0), (2, 2, 0, 1.0)]
    assert rows(codec.at_least(cells, 2)) == [(0, 1, 2.0)]


def test_small_readers(spark, tmp_path):
    from tracewright.operators.storage import table_sizes, write_table

    (tmp_path / "e.txt").write_text("1 X 2 9\nbad\n3 Y 4 9\n")
    assert rows(raw_log.read_edge_list(spark, str(tmp_path / "e.txt"))) == [(1, 2), (3, 4)]
    (tmp_path / "map.txt").write_text("/usr:$0$\nnone\n/lib:$1$\n")
    assert raw_log.read_dictionary(spark, str(tmp_path / "map.txt")) == [("/usr", "$0$"), ("/lib", "$1$")]
    with pytest.raises(ValueError):
        raw_log.read_dictionary(spark, str(tmp_path / "map.txt"), strict=True)
    (tmp_path / "b.txt").write_text("0.1 1000000000000000*0*2#0000000000000001*1*0\n")
    blocks = codec.parse_block_text(raw_log.read_block_text(spark, str(tmp_path / "b.txt")))
    assert rows(blocks) == [("0.1", 0, 2, 32768), ("0.1", 1, 0, 1)]
    wanted = spark.createDataFrame([("0.1",), ("9.9",)], "label string")
    assert ("9.9", None, None, None) in rows(raw_log.blocks_of(wanted, blocks))
    assert raw_log.list_files(spark, str(tmp_path)) == ["b.txt", "e.txt", "map.txt"]
    write_table(wanted, str(tmp_path / "w"))
    sizes = table_sizes({"w": spark.read.parquet(str(tmp_path / "w"))}).collect()
    assert sizes[0]["n_rows"] == 2 and sizes[0]["n_bytes"] > 0


def test_summaries(spark):
    df = spark.createDataFrame([(1, 3, None), (2, 4, 5)], "poi int, a int, b int")
    assert rows(scalar.metric_summary(df, ["a", "b"])) == [("a", 3.0, 4.0, 4.0, 0), ("b", 5.0, 5.0, 5.0, 1)]
    s = spark.createDataFrame([(1, 3, 2, 10, 5), (2, 4, None, 9, 4), (3, 1, 1, 8, 5)], "poi long, last_hop int, full_recall_hop int, final_nodes long, final_covered long")
    assert rows(traverse.median_poi(s), "poi") == [(1,)]
    assert rows(traverse.median_poi(s.where("poi = 2")), "poi") == [(2,)]
    m = spark.createDataFrame([(0, 1, 1.0), (2, 1, 1.0), (0, 0, 1.0), (1, 5, 1.0)], "i long, j long, v double")
    assert rows(codec.degree_rank(m)) == [(0, 0), (1, 2), (5, 1)]


def test_plain_restore_loses_what_coding_confused(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("/etc1/lib",), ("/usr/x",)], "t string").select("t", codec.restore(codec.compress(F.col("t"))).alias("back"))
    assert rows(df) == [("/etc1/lib", "$2/lib1$"), ("/usr/x", "/usr/x")]


def _many_snapshots(spark, monkeypatch, tmp_path, n):
    """Queries get n snapshots of two edges, one of them of two events, and write under tmp_path."""
    from tracewright.plans import graph

    snaps = spark.range(n * 3).selectExpr("id AS pos", "id AS seq", "CAST(id DIV 3 AS INT) AS snapshot_id", "id DIV 3 AS src", "id DIV 3 + least(id % 3, 1) AS dst")
    monkeypatch.setattr(graph, "snapped", lambda spark, sf_dir: snaps.repartition(4))
    monkeypatch.setattr(graph, "_folder", lambda spark, name: str(tmp_path / name))
    return graph, tmp_path / "snapshots"


def test_snapshot_table_has_few_files(spark, monkeypatch, tmp_path):
    graph, at = _many_snapshots(spark, monkeypatch, tmp_path, 2100)
    assert rows(graph.snapshot_table(spark, ""), "snapshot_id", "edges", "events") == order((i, 2, 3) for i in range(2100))
    assert len(list(at.glob("*=*"))) == 3 and 3 <= len(list(at.rglob("*.parquet"))) <= 12
    graph, at = _many_snapshots(spark, monkeypatch, tmp_path, 0)
    assert graph.snapshot_table(spark, "").count() == 0


def test_one_snapshot_is_read_from_its_folder(spark, monkeypatch, tmp_path):
    import shutil

    from tracewright.operators.storage import write_table

    graph, at = _many_snapshots(spark, monkeypatch, tmp_path, 2100)
    assert rows(graph.one_snapshot(spark, "")) == [(0, 0, 0, 1), (0, 0, 1, 2), (1, 1, 1, 1), (1, 1, 2, 2)]
    assert len(list(at.glob("*=*"))) == 3 and 3 <= len(list(at.rglob("*.parquet"))) <= 12
    assert rows(raw_log.read_snapshots(spark, str(at), 999, 1000, 2099, 2100), "snapshot_id", "u", "v") == order((s, s, s + d) for s in (999, 1000, 2099) for d in (0, 1))
    every = raw_log.read_snapshots(spark, str(at))
    assert every.count() == every.distinct().count() == 4200
    write_table(every.where("snapshot_id < 4"), str(tmp_path / "each"), by="snapshot_id")
    assert rows(raw_log.read_snapshots(spark, str(tmp_path / "each"), 3)) == [(3, 3, 3, 1), (3, 3, 4, 2)]
    named = raw_log.read_snapshots(spark, str(at), 0, 1)
    for folder in ("first_snapshot=1000", "first_snapshot=2000"):
        shutil.rmtree(at / folder)
    assert named.count() == 4
    graph, at = _many_snapshots(spark, monkeypatch, tmp_path, 0)
    assert graph.one_snapshot(spark, "").count() == 0
