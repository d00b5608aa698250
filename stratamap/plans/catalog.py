"""The catalog of an environment: items, the frame tree, layers, operators and what links them.

It is metadata of a few rows and lives on the driver; layers are lazy frames, and running the operator graph only composes
plans, in topological order."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..geometry import Uncertain, affine

ROOT = "/0"


@dataclass
class Item:
    kind: str
    label: str = ""
    id: str = ""
    frame: DataFrame | None = None
    pose: Uncertain | None = None
    run: Callable[..., DataFrame] | None = None
    arity: tuple[int, int] = (1, 1)
    metadata: dict = field(default_factory=dict)

    def meta(self, key: str, make: Callable[[], object] = dict) -> object:
        """The metadata of a key, made if there is none."""
        if key not in self.metadata:
            self.metadata[key] = make()
        return self.metadata[key]

    def has_meta(self, key: str) -> bool:
        return key in self.metadata

    def remove_meta(self, key: str | None = None) -> None:
        """Of one key, or of all."""
        self.metadata = {} if key is None else {k: v for k, v in self.metadata.items() if k != key}


class Catalog:
    def __init__(self, prefix: str = "/") -> None:
        self.prefix = f"/{prefix.strip('/')}/".replace("//", "/")
        self.items: dict[str, Item] = {}
        self.parent: dict[str, str] = {}
        self.layers: set[tuple[str, str]] = set()
        self.inputs: dict[str, list[str]] = {}
        self.outputs: dict[str, list[str]] = {}
        self.at: dict[str, str] = {}
        self.listeners: list[Callable[[str, str, str, str], None]] = []
        self.items[ROOT] = Item("frame", "root", ROOT, pose=Uncertain(affine()))

    def _tell(self, kind: str, op: str, a: str, b: str = "") -> None:
        for f in self.listeners:
            f(kind, op, a, b)

    def subscribe(self, listener: Callable[[str, str, str, str], None]) -> None:
        """A new listener is told all there is first."""
        for kind, a, b in self.state():
            listener(kind, "ADD", a, b)
        self.listeners.append(listener)

    def state(self) -> list[tuple[str, str, str]]:
        out = [("item", i, "") for i in sorted(self.items)]
        out += [("frame_tree", c, p) for c, p in sorted(self.parent.items())] + [("layer_tree", a, b) for a, b in sorted(self.layers)]
        out += [("op_input", o, x) for o, xs in sorted(self.inputs.items()) for x in xs] + [("op_output", o, x) for o, xs in sorted(self.outputs.items()) for x in xs]
        return out + [("map_frame", m, f) for m, f in sorted(self.at.items())]

    def attach(self, item: Item, id: str = "") -> str:
        """Ids get the prefix; one that is empty or ends with a slash gets the next free number."""
        id = id if id.startswith("/") else self.prefix + id
        if id.endswith("/"):
            n = 1
            while f"{id}{n}" in self.items:
                n += 1
            id = f"{id}{n}"
        if id in self.items:
            raise ValueError(f"{id} is taken")
        item.id = id
        self.items[id] = item
        self._tell("item", "ADD", id)
        if item.kind == "frame":
            self.set_parent(id, ROOT)
        elif item.kind == "map":
            self.bind(id, ROOT)
        return id

    def detach(self, id: str, deep: bool = False) -> None:
        if deep:
            for child in [c for c, p in self.parent.items() if p == id]:
                self.detach(child, True)
            for m in [m for m, f in self.at.items() if f == id]:
                self.detach(m)
        for c in [c for c, p in self.parent.items() if id in (c, p)]:
            self.remove_parent(c)
        for child, parent in sorted(x for x in self.layers if id in x):
            self.remove_layer(child, parent)
        for m in [m for m, f in self.at.items() if id in (m, f)]:
            self.unbind(m)
        for o in sorted({*self.inputs, *self.outputs}):
            for kind in ("op_input", "op_output"):
                for x in [x for x in self._links(kind).get(o, []) if id in (o, x)]:
                    self.disconnect(kind, o, x)
        self.inputs.pop(id, None)
        self.outputs.pop(id, None)
        del self.items[id]
        self._tell("item", "REMOVE", id)

    def set_parent(self, child: str, parent: str) -> None:
        up = parent
        while up:
            if up == child:
                raise ValueError("a frame can't be under itself")
            up = self.parent.get(up)
        self.remove_parent(child)
        self.parent[child] = parent
        self._tell("frame_tree", "ADD", child, parent)

    def remove_parent(self, child: str) -> None:
        if child in self.parent:
            self._tell("frame_tree", "REMOVE", child, self.parent.pop(child))

    def add_layer(self, child: str, parent: str) -> None:
        self.layers.add((child, parent))
        self._tell("layer_tree", "ADD", child, parent)

    def remove_layer(self, child: str, parent: str) -> None:
        self.layers.discard((child, parent))
        self._tell("layer_tree", "REMOVE", child, parent)

    def unbind(self, map_: str) -> None:
        if map_ in self.at:
            self._tell("map_frame", "REMOVE", map_, self.at.pop(map_))

    def bind(self, map_: str, frame: str) -> None:
        self.unbind(map_)
        self.at[map_] = frame
        self._tell("map_frame", "ADD", map_, frame)

    def connect(self, op: str, inputs: list[str], outputs: list[str]) -> None:
        least, most = self.items[op].arity
        if not least <= len(inputs) <= most:
            raise ValueError(f"{op} takes {least} to {most} inputs")
        for x in outputs:
            if self.generator(x) not in (None, op):
                raise ValueError(f"{x} has a generator")
        for kind in ("op_input", "op_output"):
            for x in list(self._links(kind).get(op, [])):
                self.disconnect(kind, op, x)
        self.inputs[op], self.outputs[op] = list(inputs), list(outputs)
        for kind, xs in (("op_input", inputs), ("op_output", outputs)):
            for x in xs:
                self._tell(kind, "ADD", op, x)

    def _links(self, kind: str) -> dict[str, list[str]]:
        return self.inputs if kind == "op_input" else self.outputs

    def disconnect(self, kind: str, op: str, layer: str) -> None:
        """Takes one input or output (kind op_input or op_output) from an operator."""
        self._links(kind)[op].remove(layer)
        self._tell(kind, "REMOVE", op, layer)

    def add_link(self, kind: str, op: str, layer: str) -> None:
        """One more input or output (kind op_input or op_output), as far as the operator takes them."""
        if kind == "op_input" and len(self.inputs.get(op, [])) >= self.items[op].arity[1]:
            raise ValueError(f"{op} takes no more inputs")
        if kind == "op_output" and self.generator(layer) not in (None, op):
            raise ValueError(f"{layer} has a generator")
        self._links(kind).setdefault(op, []).append(layer)
        self._tell(kind, "ADD", op, layer)

    def only(self, kind: str, op: str, of: str | None = None) -> str:
        """The one input or output of an operator, of a kind of item if one is named."""
        found = [x for x in self._links(kind).get(op, []) if of in (None, self.items[x].kind)]
        if len(found) != 1:
            raise ValueError(f"{op} has {len(found)} such, not one")
        return found[0]

    def generator(self, layer: str) -> str | None:
        return next((o for o, xs in self.outputs.items() if layer in xs), None)

    def generated_from(self, layer: str) -> list[str]:
        return sorted({y for o, xs in self.inputs.items() if layer in xs for y in self.outputs.get(o, [])})

    def of_kind(self, kind: str) -> list[str]:
        return sorted(i for i, x in self.items.items() if x.kind == kind)

    def chain(self, frame: str) -> list[str]:
        out = [frame]
        while out[-1] in self.parent:
            out.append(self.parent[out[-1]])
        return out

    def to_root(self, frame: str) -> Uncertain:
        total = Uncertain(affine())
        for f in self.chain(frame):
            total = self.items[f].pose @ total
        return total

    def between(self, a: str, b: str) -> Uncertain:
        """The transform that leads from frame a into frame b."""
        if self.chain(a)[-1] != self.chain(b)[-1]:
            raise ValueError("frames of different trees")
        return self.to_root(b).inverse() @ self.to_root(a)

    def run(self) -> None:
        """Composes all operators' plans, each after those that its inputs come from."""
        before = {o: {g for x in xs if (g := self.generator(x)) and g != o} for o, xs in self.inputs.items()}
        for op in TopologicalSorter({o: sorted(b) for o, b in sorted(before.items())}).static_order():
            made = self.items[op].run(*[self.items[x].frame for x in self.inputs[op]])
            for x in self.outputs[op]:
                self.items[x].frame = made
                self._tell("item", "UPDATE", x)

    def clone_map(self, map_: str, to: Catalog) -> str:
        """A map with its frames up to the root, in another catalog."""
        under = ROOT
        for f in reversed(self.chain(self.at[map_])[:-1]):
            if f not in to.items:
                to.attach(Item("frame", self.items[f].label, pose=self.items[f].pose), f)
                to.set_parent(f, under)
            under = f
        m = self.items[map_]
        to.attach(Item("map", m.label, frame=m.frame, metadata=copy.deepcopy(m.metadata)), map_)
        to.bind(map_, under)
        return map_

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        links = self.state()
        pick = lambda k: spark.createDataFrame([(a, b) for kind, a, b in links if kind == k], "a string, b string")
        items = spark.createDataFrame([(i, x.label, x.kind) for i, x in sorted(self.items.items())], "id string, label string, class string")
        return {"items": items, **{k: pick(k) for k in ("frame_tree", "layer_tree", "op_input", "op_output", "map_frame")}}

    def graphviz(self) -> str:
        lines = [f'  "{i}" [label="{x.label or i}\\n{x.kind}"];' for i, x in sorted(self.items.items())]
        lines += [f'  "{b}" -> "{a}" [label="{k}"];' for k, a, b in self.state() if k != "item"]
        return "digraph environment {\n" + "\n".join(lines) + "\n}\n"


def file_name(id: str) -> str:
    return id.replace("/", "_")


def id_parts(id: str) -> tuple[str, str, int | None]:
    """Prefix, suffix, and the suffix's number, if it is one."""
    prefix, _, suffix = id.rpartition("/")
    return f"{prefix}/", suffix, int(suffix) if re.fullmatch(r"\d+", suffix) else None


class MultiGrid:
    """A map of several grids, of which one is active. Each grid is a map under a frame of its own and a child layer of this
    map; a new one is made after the active one's measures."""

    def __init__(self, catalog: Catalog, label: str = "", frame: str = ROOT) -> None:
        self.catalog, self.grids, self.active = catalog, [], ""
        self.id = catalog.attach(Item("map", label))
        catalog.bind(self.id, frame)

    def add(self, grid: str) -> str:
        self.catalog.add_layer(grid, self.id)
        self.grids.append(grid)
        self.active = grid
        return grid

    def _shift(self, frame: str, grid: str) -> tuple[float, float]:
        m = self.catalog.between(frame, self.catalog.at[grid]).m
        return float(m[0, 3]), float(m[1, 3])

    def create(self, shift: tuple[float, float, float], aligned: bool = True) -> str:
        """A grid without cells beside the active one; aligned: not turned, and shifted by whole cells."""
        c, like = self.catalog, self.catalog.items[self.active]
        spec = like.metadata["grid"]
        x, y, z = shift
        if aligned:
            x, y = x // spec["sx"] * spec["sx"], y // spec["sy"] * spec["sy"]
        under = c.at[self.active]
        frame = c.attach(Item("frame", pose=Uncertain(affine((x, y, z)))))
        c.set_parent(frame, under)
        empty = None if like.frame is None else like.frame.limit(0)
        grid = c.attach(Item("map", like.label, frame=empty, metadata=copy.deepcopy(like.metadata)))
        c.bind(grid, frame)
        return self.add(grid)

    def select(self, frame: str, threshold: float) -> str:
        """Makes active the grid whose frame is nearest to another by the larger of both distances, if one is nearer than the
        threshold, else a new one at that frame."""
        near = sorted((max(map(abs, self._shift(frame, g))), i) for i, g in enumerate(self.grids))
        if near and near[0][0] < threshold:
            self.active = self.grids[near[0][1]]
        else:
            m = self.catalog.between(frame, self.catalog.at[self.active]).m
            self.create(tuple(float(v) for v in m[:3, 3]))
        return self.active

    def clone(self) -> MultiGrid:
        """A map of the same grids, of which only the active one is a copy."""
        out = MultiGrid(self.catalog, self.catalog.items[self.id].label, self.catalog.at[self.id])
        like = self.catalog.items[self.active]
        own = self.catalog.attach(Item("map", like.label, frame=like.frame, metadata=copy.deepcopy(like.metadata)))
        self.catalog.bind(own, self.catalog.at[self.active])
        for g in self.grids:
            out.add(own if g == self.active else g)
        out.active = own
        return out


@dataclass(frozen=True)
class Kind:
    """How a kind of item is told in words: its properties as plain values, and an item from them."""

    properties: Callable[[Item], dict]
    build: Callable[[dict], Item]


def _pose_of(item: Item) -> dict | None:
    if item.pose is None:
        return None
    return {"m": item.pose.m.ravel().tolist(), "cov": None if item.pose.cov is None else item.pose.cov.ravel().tolist()}


def _with_pose(p: dict | None) -> Uncertain | None:
    return p and Uncertain(np.array(p["m"]).reshape(4, 4), None if p["cov"] is None else np.array(p["cov"]).reshape(6, 6))


def _plain(kind: str) -> Kind:
    return Kind(
        lambda x: {"label": x.label, "pose": _pose_of(x), "arity": list(x.arity), "metadata": x.metadata},
        lambda p: Item(kind, p["label"], pose=_with_pose(p["pose"]), arity=tuple(p["arity"]), metadata=p["metadata"]),
    )


KINDS: dict[str, Kind] = {k: _plain(k) for k in ("frame", "map", "layer", "operator")}


def item_kind(name: str, properties: Callable[[Item], dict] | None = None, build: Callable[[dict], Item] | None = None) -> None:
    """Registers a kind of item of one's own; what isn't given is as for all others."""
    plain = _plain(name)
    KINDS[name] = Kind(properties or plain.properties, build or plain.build)


OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str) -> Callable:
    """Registers an operator of one's own by name."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATORS[name] = f
        return f

    return put
