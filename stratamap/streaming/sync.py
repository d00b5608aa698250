"""Keeping catalogs in step by events that carry items: encoding, context, applying, and callbacks by type.

An event is a row (seq, type, op, id_a, id_b, class, properties, names, tables). An item's properties are JSON; its data is a
table of the shared folder, of which the event carries the path, so that it never passes through the driver."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import KINDS, ROOT, Catalog, file_name
from .changes import ADD, REMOVE, UPDATE

EVENT = "seq long, type string, op string, id_a string, id_b string, class string, properties string, names array<string>, tables array<string>"


class Sender:
    """Listens to a catalog and keeps its events, encoded, until they are taken. context: an item that is bound to a frame
    comes with the frames above it, so that a receiver which knows none of them can place it."""

    def __init__(self, catalog: Catalog, folder: str, context: bool = False) -> None:
        self.catalog, self.folder, self.context = catalog, folder, context
        self.rows: list[tuple] = []
        self.seq = 0
        catalog.subscribe(self._hear)

    def _put(self, kind: str, op: str, a: str, b: str = "") -> None:
        self.seq += 1
        class_, properties, names, tables = "", "", [], []
        x = self.catalog.items.get(a)
        if kind == "item" and op != REMOVE and x is not None:
            class_, properties = x.kind, json.dumps(KINDS[x.kind].properties(x), sort_keys=True)
            if x.frame is not None:
                names, tables = ["data"], [f"{self.folder}/{file_name(a)}-{self.seq}"]
                x.frame.write.parquet(tables[0])
        self.rows.append((self.seq, kind, op, a, b, class_, properties, names, tables))

    def _hear(self, kind: str, op: str, a: str, b: str) -> None:
        self._put(kind, op, a, b)
        if self.context and kind == "item" and op != REMOVE and a in self.catalog.at:
            child = ""
            for f in self.catalog.chain(self.catalog.at[a]):
                self._put("item", UPDATE, f)
                if child:
                    self._put("frame_tree", ADD, child, f)
                child = f
            self._put("map_frame", ADD, a, self.catalog.at[a])

    def take(self, spark: SparkSession) -> DataFrame:
        """The events since the last time."""
        rows, self.rows = self.rows, []
        return spark.createDataFrame(rows, EVENT)


def apply_to(catalog: Catalog, events: DataFrame) -> None:
    """Brings a catalog up to date. It is lenient: what is there is not added again, what is not there is not removed, and
    an update of an unknown item adds it."""
    spark = events.sparkSession
    for e in events.orderBy("seq").toLocalIterator():
        a, b = e.id_a, e.id_b
        if e.type == "item" and e.op == REMOVE:
            if a in catalog.items and a != ROOT:
                catalog.detach(a)
        elif e.type == "item":
            item = KINDS[e["class"]].build(json.loads(e.properties))
            if e.tables:
                item.frame = spark.read.parquet(e.tables[0])
            if a in catalog.items:
                item.id, item.run = a, catalog.items[a].run
                catalog.items[a] = item
            else:
                catalog.attach(item, a)
        elif a in catalog.items and b in catalog.items:
            _link(catalog, e.type, e.op, a, b)


def _link(c: Catalog, kind: str, op: str, a: str, b: str) -> None:
    add = op == ADD
    match kind:
        case "frame_tree":
            if add and c.parent.get(a) != b:
                c.set_parent(a, b)
            elif not add and c.parent.get(a) == b:
                c.remove_parent(a)
        case "layer_tree":
            if add != ((a, b) in c.layers):
                (c.add_layer if add else c.remove_layer)(a, b)
        case "map_frame":
            if add and c.at.get(a) != b:
                c.bind(a, b)
            elif not add and c.at.get(a) == b:
                c.unbind(a)
        case "op_input" | "op_output":
            if add != (b in c._links(kind).get(a, [])):
                (c.add_link if add else c.disconnect)(kind, a, b)


class Dispatcher:
    """Calls what is registered for a type and operation; an event that nothing is registered for is an error if strict."""

    def __init__(self, strict: bool = False) -> None:
        self.strict = strict
        self.calls: dict[tuple[str, str], list[Callable[[str, str], None]]] = {}
        self.filters: list[Callable[[str, str, str, str], bool]] = []

    def on(self, kind: str, op: str, call: Callable[[str, str], None]) -> Dispatcher:
        self.calls.setdefault((kind, op), []).append(call)
        return self

    def only_if(self, keep: Callable[[str, str, str, str], bool]) -> Dispatcher:
        """Events that any such filter refuses are not told."""
        self.filters.append(keep)
        return self

    def __call__(self, kind: str, op: str, a: str, b: str = "") -> None:
        if not all(keep(kind, op, a, b) for keep in self.filters):
            return
        calls = self.calls.get((kind, op), [])
        if not calls and self.strict:
            raise ValueError(f"nothing handles {op} of {kind}")
        for call in calls:
            call(a, b)

    def replay(self, events: Iterable[tuple[str, str, str, str]]) -> None:
        for e in events:
            self(*e)
