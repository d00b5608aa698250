import numpy as np
import pytest

from stratamap.geometry import GridSpec, Uncertain, affine
from stratamap.plans.catalog import Catalog, Item, MultiGrid, item_kind
from stratamap.sources import files
from stratamap.streaming.sync import Dispatcher, Sender, apply_to


def frames(c):
    f = c.attach(Item("frame", "f", pose=Uncertain(affine((1.0, 0.0, 0.0)), np.eye(6))), "f")
    g = c.attach(Item("frame", "g", pose=Uncertain(affine((0.0, 2.0, 0.0)))), "g")
    c.set_parent(g, f)
    return f, g


def test_a_replica_follows(spark, tmp_path):
    a, b = Catalog(), Catalog()
    send = Sender(a, str(tmp_path))
    f, g = frames(a)
    m = a.attach(Item("map", "m", frame=spark.createDataFrame([(1, 2)], "xi long, yi long"), metadata={"k": [1]}), "m")
    a.bind(m, g)
    op, out = a.attach(Item("operator", arity=(1, 1)), "op"), a.attach(Item("layer"), "out")
    a.connect(op, [m], [out])
    apply_to(b, send.take(spark))
    assert b.state() == a.state() and b.items[m].frame.collect() == a.items[m].frame.collect() and b.items[m].metadata == {"k": [1]}
    assert np.allclose(b.between(m and g, "/0").m, a.between(g, "/0").m) and np.allclose(b.items[f].pose.cov, np.eye(6))
    a.set_parent(g, "/0")
    a.disconnect("op_input", op, m)
    a.detach(f)
    events = send.take(spark)
    apply_to(b, events)
    apply_to(b, events)
    assert b.state() == a.state() and f not in b.items


def test_context_places_a_map_alone(spark, tmp_path):
    a = Catalog()
    f, g = frames(a)
    m = a.attach(Item("map", "m"), "m")
    a.bind(m, g)
    send = Sender(a, str(tmp_path), context=True)
    send.take(spark)
    a._tell("item", "UPDATE", m)
    late = Catalog()
    apply_to(late, send.take(spark))
    assert late.chain(late.at[m]) == [g, f, "/0"] and np.allclose(late.to_root(g).m, a.to_root(g).m)


def test_calls_by_type():
    seen, c = [], Catalog()
    d = Dispatcher().on("item", "ADD", lambda a, b: seen.append(a)).on("frame_tree", "ADD", lambda a, b: seen.append((a, b)))
    d.only_if(lambda kind, op, a, b: a != "/secret")
    c.subscribe(d)
    c.attach(Item("frame", pose=Uncertain(affine())), "f")
    c.attach(Item("layer"), "/secret")
    assert seen == ["/0", "/f", ("/f", "/0")]
    with pytest.raises(ValueError):
        Dispatcher(strict=True).replay([("item", "REMOVE", "x", "")])


def test_kinds_of_ones_own(spark, tmp_path):
    item_kind("beacon", lambda x: {"label": x.label.upper()}, lambda p: Item("beacon", p["label"]))
    a, b = Catalog(), Catalog()
    send = Sender(a, str(tmp_path))
    a.attach(Item("beacon", "lamp"), "x")
    apply_to(b, send.take(spark))
    assert (b.items["/x"].kind, b.items["/x"].label) == ("beacon", "LAMP")


def test_links_and_metadata():
    c = Catalog()
    op, x, y = c.attach(Item("operator", arity=(1, 1)), "op"), c.attach(Item("layer"), "x"), c.attach(Item("map"), "y")
    c.add_link("op_input", op, x)
    c.add_link("op_output", op, y)
    assert c.only("op_input", op) == x and c.only("op_output", op, "map") == y
    for call in (lambda: c.add_link("op_input", op, y), lambda: c.only("op_output", op, "layer"), lambda: c.add_link("op_output", c.attach(Item("operator")), y)):
        with pytest.raises(ValueError):
            call()
    i = Item("map")
    i.meta("a")["k"] = 1
    assert i.meta("a") == {"k": 1} and i.has_meta("a") and not i.has_meta("b")
    i.meta("b", list)
    i.remove_meta("a")
    assert list(i.metadata) == ["b"]
    i.remove_meta()
    assert not i.metadata


def test_maps_of_several_grids(spark):
    c = Catalog()
    m = MultiGrid(c, "all")
    f = c.attach(Item("frame", pose=Uncertain(affine((10.0, 0.0, 0.0)))))
    first = c.attach(Item("map", "g", frame=spark.range(3).toDF("xi"), metadata={"grid": {"sx": 0.5, "sy": 0.5}}))
    m.add(first)
    assert m.select(f, 11.0) == first
    second = m.select(c.attach(Item("frame", pose=Uncertain(affine((20.3, -0.2, 1.0))))), 5.0)
    assert second == m.active != first and c.items[second].frame.count() == 0
    assert np.allclose(c.to_root(c.at[second]).m[:3, 3], [20.0, -0.5, 1.0])
    other = m.clone()
    assert len(other.grids) == 2 and other.grids[0] == first and other.active != second and c.at[other.active] == c.at[second]
    assert sorted(a for a, b in c.layers if b == other.id) == sorted(other.grids)


def test_sensor_samples(spark):
    empty = spark.createDataFrame([], "line int, phi double, ranges array<int>, remissions array<int>")
    head, scan = files.append_line({}, empty, 0.1, -0.5, 0.01, [100, 200], [])
    with pytest.warns(UserWarning, match="points_per_line"):
        head, scan = files.append_line(head, scan, 0.2, -0.5, 0.01, [100], [])
    assert [(r.line, r.phi, r.ranges) for r in scan.orderBy("line").collect()] == [(0, 0.1, [100, 200]), (1, 0.2, [100])]
    p = files.cloud_from_samples(spark, np.eye(3), np.eye(3) / 2)
    assert p.filter("red = 0.5").first().x == 1 and "red" not in files.cloud_from_samples(spark, np.eye(3), np.eye(2)).columns
    d = files.cells_from_image(spark, np.array([[1.0, np.nan, 3.0], [np.inf, 5.0, 6.0]]))
    assert {(r.xi, r.yi): r.distance for r in d.collect()} == {(0, 0): 1.0, (1, 0): None, (2, 0): 3.0, (0, 1): None, (1, 1): 5.0, (2, 1): 6.0}
    assert files.grey_frame(d, GridSpec(3, 2, 1.0, 1.0), "distance").tolist() == [[1, 0, 3], [0, 5, 6]]
