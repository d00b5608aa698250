import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratamap.geometry import GridSpec, Uncertain, affine, rotation
from stratamap.plans.catalog import ROOT, Catalog, Item, file_name, id_parts
from stratamap.sources import files, scene
from stratamap.streaming import changes


def frames():
    c = Catalog()
    a = c.attach(Item("frame", pose=Uncertain(affine((1, 0, 0)))))
    b = c.attach(Item("frame", pose=Uncertain(affine((0, 2, 0), rotation(yaw=0.3)))))
    c.set_parent(b, a)
    return c, a, b


def test_ids_and_frames():
    c, a, b = frames()
    assert (a, b) == ("/1", "/2") and c.attach(Item("layer"), "x/") == "/x/1" and c.attach(Item("layer"), "named") == "/named"
    with pytest.raises(ValueError):
        c.attach(Item("layer"), "named")
    with pytest.raises(ValueError):
        c.set_parent(a, b)
    assert c.chain(b) == [b, a, ROOT]
    assert np.allclose(c.between(b, a).m, affine((0, 2, 0), rotation(yaw=0.3)), atol=1e-10)
    assert np.allclose(c.between(a, b).m @ c.between(b, a).m, np.eye(4), atol=1e-10)
    m = c.attach(Item("map"))
    c.bind(m, b)
    other = Catalog()
    c.clone_map(m, other)
    assert np.allclose(other.to_root(b).m, c.to_root(b).m) and other.at[m] == b
    c.detach(a, deep=True)
    assert b not in c.items and m not in c.items and ROOT in c.items
    assert id_parts("/a/b/12") == ("/a/b/", "12", 12) and file_name("/a/b") == "_a_b"


def test_operators_run_in_order_and_replicas_follow(spark):
    c = Catalog()
    told = []
    layers = [c.attach(Item("layer", frame=spark.range(3) if k == 0 else None)) for k in range(3)]
    ops = [c.attach(Item("operator", run=lambda d, k=k: d.withColumn(f"c{k}", F.lit(k))), f"op{9 - k}") for k in range(2)]
    c.subscribe(lambda *e: told.append(e))
    c.connect(ops[1], [layers[1]], [layers[2]])
    c.connect(ops[0], [layers[0]], [layers[1]])
    with pytest.raises(ValueError):
        c.connect(ops[0], [], [])
    c.run()
    assert c.items[layers[2]].frame.columns == ["id", "c0", "c1"] and c.generated_from(layers[0]) == [layers[1]] and c.generator(layers[2]) == ops[1]
    assert ("item", "ADD", ROOT, "") in told and ("op_output", "ADD", ops[0], layers[1]) in told and told[-1] == ("item", "UPDATE", layers[2], "")
    assert c.graphviz().count("->") == 4 and c.tables(spark)["op_input"].count() == 2


@pytest.mark.parametrize(("said", "left"), [("AU", "AU"), ("AUU", "AU"), ("AR", ""), ("AUR", ""), ("RA", ""), ("UR", "R"), ("URA", ""), ("RU", "RU"), ("AURU", "U")])
def test_queue_rules(said, left):
    names = {"A": "ADD", "U": "UPDATE", "R": "REMOVE"}
    queue = []
    for i, o in enumerate(said):
        queue = changes.enqueue(queue, i, names[o])
    assert "".join(o[0] for _, o in queue) == left


def event_rows():
    return [(i, "item", f"/{k}", "", op) for i, (k, op) in enumerate(itertools.chain.from_iterable([(k, o) for k in range(6)] for o in ("ADD", "UPDATE", "REMOVE", "UPDATE")))]


EVENT = "seq long, type string, id_a string, id_b string, op string"


def test_compaction_batch_and_stream_agree(spark, tmp_path):
    rows = event_rows()[:-3]
    log = spark.createDataFrame(rows, EVENT)
    want = {}
    for seq, _, a, _, op in rows:
        want[a] = changes.enqueue(want.get(a, []), seq, op)
    got = {}
    for r in sorted(changes.compact(log).collect(), key=lambda r: r.seq):
        got.setdefault(r.id_a, []).append((r.seq, r.op))
    assert got == {k: v for k, v in want.items() if v}
    for i, part in enumerate((rows[:9], rows[9:])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    q = changes.compact_stream(spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("queues").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("queues").collect():
        if r.id_a not in last or max(r.seqs, default=99) >= max(last[r.id_a].seqs, default=-1):
            last[r.id_a] = r
    assert {k: list(zip(v.seqs, v.ops, strict=True)) for k, v in last.items() if v.seqs} == {k: v for k, v in want.items() if v}


def test_net_state_and_replica(spark):
    log = spark.createDataFrame(event_rows()[:15], EVENT)
    assert {r.id_a for r in changes.net_state(log).collect()} == {"/3", "/4", "/5"}
    state = changes.apply_events(changes.apply_events(log.limit(0).select(*changes.KEY, "seq"), log.filter("seq < 7")), log.filter("seq >= 7"))
    assert {r.id_a for r in state.collect()} == {"/3", "/4", "/5"}


def test_files_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0.5, 1.25, -2.0), (3.0, 4.0, 5.5)], "x double, y double, z double")
    files.write_text_cloud(p, f"{tmp_path}/cloud")
    assert sorted(map(tuple, files.read_text_cloud(spark, f"{tmp_path}/cloud").collect())) == sorted(map(tuple, p.collect()))
    head = {"delta_psi": [0.1], "center_offset": [0.0, 0.1, 0.2]}
    lines = spark.createDataFrame([(0, 0.5, [1000, 2000], [7, 8]), (1, 0.75, [3], [])], "line int, phi double, ranges array<int>, remissions array<int>")
    files.write_scan(head, lines, f"{tmp_path}/scan")
    got_head, got = files.read_scan(spark, f"{tmp_path}/scan/part-*")
    assert got_head == head and sorted(map(tuple, got.collect())) == sorted(map(tuple, lines.collect()))
    v = pd.DataFrame(np.arange(18.0).reshape(2, 9) / 18, columns=["x", "y", "z", "nx", "ny", "nz", "r", "g", "b"])
    (tmp_path / "a.ply").write_bytes(files.format_ply(v, pd.DataFrame([(0, 1, 0)], columns=["a", "b", "c"])))
    (tmp_path / "b.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int v\nend_header\n1 2 3\n3 0 0 0\n4 0 0 0 0\n")
    ply = files.read_ply(spark, f"{tmp_path}/*.ply").orderBy("file", "vid").toPandas()
    assert len(ply) == 3 and np.allclose(ply.iloc[:2][list(v.columns[:6])], v[v.columns[:6]]) and np.allclose(ply.iloc[:2][["r", "g", "b"]], v[["r", "g", "b"]], atol=1 / 255) and pd.isna(ply.iloc[2].nx)
    assert len(files.parse_ply((tmp_path / "b.ply").read_bytes())["face"]) == 1
    m = pd.DataFrame({"xi": [0, 0, 3], "yi": [1, 1, 2], "ord": [0, 1, 0], "mean": [1.5, 2.5, 3.0], "stdev": [0.5] * 3, "height": [0.0] * 3, "n": [1.0] * 3, "low": [1.0] * 3, "high": [2.0] * 3, "idx": [0, 1, 2], "type": [1, 0, 2]})
    (tmp_path / "m.bin").write_bytes(files.format_patches(m))
    back = files.read_patches(spark, f"{tmp_path}/m.bin").orderBy("xi", "ord").toPandas()
    assert np.allclose(back[list(m.columns)].to_numpy(float), m.to_numpy(float))
    with pytest.raises(ValueError):
        files.parse_patches(b"other")
    g = GridSpec(4, 3, 1.0, 1.0)
    (tmp_path / "band").write_bytes(np.arange(12, dtype="<f4").tobytes())
    band = files.read_band(spark, f"{tmp_path}/band", g, "<f4", nodata=5.0)
    assert band.filter("value is null").select("xi", "yi").first() == (1, 1) and files.band_bytes(band, g, "value", "<f4", 5.0) == (tmp_path / "band").read_bytes()
    files.write_tiles(band, g, f"{tmp_path}/tiles", 2)
    area = files.read_tiles(spark, f"{tmp_path}/tiles", (1, 2), (0, 1), 2)
    assert area.count() == 4 and "PartitionFilters: [isnotnull(tile_x" in area._jdf.queryExecution().toString()


def test_admission(spark):
    d = spark.createDataFrame([("s", i, float(i // 2), 0.0) for i in range(8)], "sensor string, seq long, x double, y double")
    assert [r.seq for r in files.admitted(d, 0.5, 2).orderBy("seq").collect()] == [0, 2, 4, 6]


def test_scene_round_trip(spark, tmp_path):
    c, _, b = frames()
    m = c.attach(Item("map", "cloud", frame=spark.range(4)), "maps/")
    c.bind(m, b)
    scene.save(c, spark, f"{tmp_path}/env")
    back = scene.load(spark, f"{tmp_path}/env")
    assert back.state() == c.state() and back.items[m].frame.count() == 4 and np.allclose(back.to_root(b).m, c.to_root(b).m)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in [n for n in s if n.startswith("q_")]:
        r, e = q[name](spark, d), c.sql(s[name])
        names = sorted(r.columns)
        assert names == sorted(e.columns), name
        a = sorted(tuple(x[k] for k in names) for x in r.collect())
        b = sorted(tuple(x[e.columns.index(k)] for k in names) for x in e.fetchall())
        assert len(a) == len(b) and all(x == pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(x, float) else x == y for p, o in zip(a, b, strict=True) for x, y in zip(p, o, strict=True)), name


@pytest.mark.parametrize("seed", range(3))
def test_compaction_equals_the_queue(spark, seed):
    import random

    r = random.Random(seed)
    rows = [(i, "item", str(r.randint(0, 40)), "", r.choice(["ADD", "UPDATE", "REMOVE"])) for i in range(500)]
    want = []
    for k in {x[2] for x in rows}:
        queue = []
        for seq, _, key, _, op in rows:
            if key == k:
                queue = changes.enqueue(queue, seq, op)
        want += [(k, s, o) for s, o in queue]
    got = changes.compact(spark.createDataFrame(rows, "seq long, type string, id_a string, id_b string, op string"))
    assert sorted((x.id_a, x.seq, x.op) for x in got.collect()) == sorted(want)


def test_replica_follows_moves_and_deep_detach():
    c, a, b = frames()
    state = set(c.state())

    def follow(kind, op, x, y):
        (state.add if op == "ADD" else state.discard)((kind, x, y)) if op != "UPDATE" else None

    c.listeners.append(follow)
    m, layers = c.attach(Item("map", "m")), [c.attach(Item("layer"), f"l{i}") for i in range(4)]
    op = c.attach(Item("operator", arity=(1, 2)), "op")
    c.set_parent(b, ROOT)
    c.set_parent(b, a)
    c.bind(m, a)
    c.bind(m, b)
    c.add_layer(layers[0], layers[1])
    c.connect(op, layers[:2], [layers[2]])
    c.connect(op, [layers[1]], [layers[3]])
    assert state == set(c.state())
    c.detach(layers[1])
    assert state == set(c.state()) and c.inputs[op] == []
    c.detach(a, deep=True)
    assert state == set(c.state()) and m not in c.items and b not in c.items
    c.unbind(m)


def test_admission_looks_at_what_was_admitted(spark):
    d = spark.createDataFrame([("s", i, 0.3 * i, 0.0, 0.5 if i > 8 else 0.0) for i in range(10)], "sensor string, seq long, x double, y double, yaw double")
    assert [r.seq for r in files.admitted(d.drop("yaw"), 1.0, 3).orderBy("seq").collect()] == [0, 4, 8]
    assert [r.seq for r in files.admitted(d, 1.0, 3, turn=0.4).orderBy("seq").collect()] == [0, 4, 8, 9]


def test_surface_map_files(spark, tmp_path):
    import struct

    import pandas as pd

    p = pd.DataFrame({"xi": [0, 0, 2], "yi": [0, 0, 1], "ord": [0, 1, 0], "mean": [2.0, 1.0, 3.0], "stdev": [0.5, 0.1, 1.0], "height": [1.0, 0.0, 0.0], "n": [3.0, 1.0, 1.0], "low": [1.0, 1.0, 3.0], "high": [2.0, 1.0, 3.0], "idx": [4, 5, 6], "type": [0, 1, 2]})
    (tmp_path / "a.mls").write_bytes(files.format_mls(p))
    # Records of the older versions, as a C compiler lays them out.
    old = {"1.0": struct.pack("<dddB7xQQQ", 2, 0.5, 1, 0, 4, 7, 8), "1.1": struct.pack("<dddB7xQdddQQ", 2, 0.5, 1, 1, 4, 0.1, 0.2, 0.3, 7, 8), "1.2": struct.pack("<fffB3xQ3B5xQQ", 2, 0.5, 1, 1, 4, 1, 2, 3, 7, 8)}
    for version, record in old.items():
        q = files.parse_mls(b"mls\n%s\n%d\nbin\n" % (version.encode(), len(record)) + record * 2)
        assert q[["xi", "yi", "ord", "mean", "stdev", "height", "idx", "type"]].values.tolist() == [[7, 8, k, 2.0, 0.5, 1.0, 4, int(version > "1.0")] for k in (0, 1)]
    with pytest.raises(ValueError):
        files.parse_mls(b"mls\n1.0\n57\nbin\n")
    back = files.read_mls(spark, f"{tmp_path}/a.mls").drop("file").orderBy("xi", "ord").toPandas()
    assert back[list(p.columns)].astype(float).round(6).values.tolist() == p.astype(float).values.tolist()


@pytest.mark.parametrize("kind", ["u1", "f4", "f8"])
def test_tiff_round_trip(spark, tmp_path, kind):
    v = np.arange(2 * 3 * 5).reshape(2, 3, 5).astype(kind)
    grid = GridSpec(5, 3, 0.5, 2.0, 10.0, -4.0)
    data = files.format_tiff(v, grid, nodata=7)
    bands, spec, nodata = files.parse_tiff(data)
    assert (bands == v).all() and bands.dtype == v.dtype and spec == grid and nodata == 7
    (tmp_path / "a.tif").write_bytes(data)
    rows = files.read_tiff(spark, f"{tmp_path}/a.tif").collect()
    assert len(rows) == 29 and {(r.band, r.xi, r.yi, r.x, r.y): r.value for r in rows}[(1, 2, 1, 11.25, -1.0)] == v[1, 1, 2]
    with pytest.raises(ValueError):
        files.parse_tiff(b"PNG" + data[3:])
