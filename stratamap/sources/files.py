"""Files of point clouds, scans, surface maps and raster bands, by Spark's readers (any store), and their writers."""

from __future__ import annotations

import math
import re
import struct
import warnings
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..geometry import GridSpec


def read_text_cloud(spark: SparkSession, path: str, remission: bool = False, share: float | None = None, seed: int = 1) -> DataFrame:
    """Lines of x y z [remission]; share: a random part of the lines. A remission becomes grey."""
    d = spark.read.text(path)
    if share is not None:
        d = d.sample(share, seed)
    v = F.split(F.trim("value"), r"\s+")
    d = d.withColumn("v", v).filter(F.size("v") >= (4 if remission else 3))
    out = d.select(*[F.element_at("v", i + 1).cast("double").alias(n) for i, n in enumerate("xyz")], *([(F.element_at("v", 4).cast("double") / 255).alias("grey")] if remission else []))
    return out.filter("x is not null and y is not null and z is not null")


def write_text_cloud(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(" ", *[F.col(n).cast("string") for n in "xyz"]).alias("value")).write.text(path)


def read_scan(spark: SparkSession, path: str) -> tuple[dict[str, list[float]], DataFrame]:
    """A scan file's header and its lines (line, phi, ranges, remissions). A remission row belongs to the line row before
    it, whose phi it repeats. Each file is decoded in one task; a scan is a sensor's sweep, a few megabytes at most."""
    raw = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for text in d["value"]:
                for row in (r.split() for r in text.splitlines() if r.strip()):
                    if row[0] == "line":
                        out.append([len(out), float(row[1]), [int(float(v)) for v in row[2:]], []])
                    elif row[0] == "remission":
                        if not out or out[-1][1] != float(row[1]):
                            raise ValueError("a remission without its line")
                        out[-1][3] = [int(float(v)) for v in row[2:]]
                yield pd.DataFrame(out, columns=["line", "phi", "ranges", "remissions"])
                out = []

    head = raw.select(F.explode(F.split("value", "\n")).alias("r")).filter(~F.col("r").rlike("^(line|remission)|^\\s*$")).select(F.split(F.trim("r"), r"\s+").alias("v"))
    header = {r.v[0]: [float(x) for x in r.v[1:]] for r in head.limit(64).collect()}
    return header, raw.mapInPandas(run, "line int, phi double, ranges array<int>, remissions array<int>")


def write_scan(header: dict[str, list[float]], lines: DataFrame, path: str) -> None:
    num = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    rows = F.array(F.struct(F.lit(0).alias("k"), F.concat_ws(" ", F.lit("line"), F.col("phi").cast("string"), num("ranges")).alias("value")), F.struct(F.lit(1).alias("k"), F.concat_ws(" ", F.lit("remission"), F.col("phi").cast("string"), num("remissions")).alias("value")))
    body = lines.select("line", F.explode(F.when(F.size("remissions") > 0, rows).otherwise(F.slice(rows, 1, 1))).alias("r")).select("line", "r.*")
    top = lines.sparkSession.createDataFrame([(-1, i, " ".join([k, *map(str, v)])) for i, (k, v) in enumerate(header.items())], "line int, k int, value string")
    # One file, in order: the format is a sequence.
    top.unionByName(body).coalesce(1).sortWithinPartitions("line", "k").select("value").write.text(path)


PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "float32": "f4", "float64": "f8", "uint8": "u1", "int32": "i4"}


def parse_ply(data: bytes) -> dict[str, pd.DataFrame]:
    """Elements of a PLY file (text or either binary form); faces that are no triangles are left out."""
    head, _, body = data.partition(b"end_header\n")
    form, elements = "ascii", []
    for row in (r.split() for r in head.decode().splitlines()):
        if row[:1] == ["format"]:
            form = row[1]
        elif row[:1] == ["element"]:
            elements.append((row[1], int(row[2]), []))
        elif row[:1] == ["property"]:
            elements[-1][2].append(row[1:])
    order, at, out = ">" if "big" in form else "<", 0, {}
    words = body.split() if form == "ascii" else []
    for name, n, props in elements:
        if props and props[0][0] == "list":
            faces = []
            for _ in range(n):
                if form == "ascii":
                    k = int(words[at])
                    f, at = [int(v) for v in words[at + 1 : at + 1 + k]], at + 1 + k
                else:
                    a, b = np.dtype(order + PLY_TYPES[props[0][1]]), np.dtype(order + PLY_TYPES[props[0][2]])
                    k = int(np.frombuffer(body, a, 1, at)[0])
                    f, at = np.frombuffer(body, b, k, at + a.itemsize).tolist(), at + a.itemsize + k * b.itemsize
                if k == 3:
                    faces.append(f)
            out[name] = pd.DataFrame(faces, columns=["a", "b", "c"])
        elif form == "ascii":
            v = np.array(words[at : at + n * len(props)], float).reshape(n, len(props))
            at += n * len(props)
            out[name] = pd.DataFrame(v, columns=[p[1] for p in props])
        else:
            kind = np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in props])
            out[name] = pd.DataFrame(np.frombuffer(body, kind, n, at).astype([(p[1], "f8") for p in props]))
            at += n * kind.itemsize
    return out


def format_ply(points: pd.DataFrame, faces: pd.DataFrame | None = None) -> bytes:
    """A binary PLY file of x, y, z [nx, ny, nz] [r, g, b in 0..1] [and triangles]."""
    groups = {"vertex": ["x", "y", "z"], "normal": ["nx", "ny", "nz"], "color": ["r", "g", "b"]}
    head, body = ["ply", "format binary_little_endian 1.0"], []
    for name, columns in groups.items():
        if set(columns) <= set(points.columns):
            kind, v = ("uchar", np.clip(np.rint(points[columns].to_numpy(float) * 255), 0, 255).astype("u1")) if name == "color" else ("double", points[columns].to_numpy("<f8"))
            head += [f"element {name} {len(v)}", *(f"property {kind} {c}" for c in columns)]
            body.append(v.tobytes())
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
        rows = np.empty(len(faces), [("n", "u1"), ("v", "<i4", 3)])
        rows["n"], rows["v"] = 3, faces[["a", "b", "c"]].to_numpy()
        body.append(rows.tobytes())
    return "\n".join([*head, "end_header\n"]).encode() + b"".join(body)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(file, vid, x, y, z, nx, ny, nz, r, g, b) of PLY files; what a file lacks is null."""
    names = ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for file, data in zip(d["path"], d["content"], strict=True):
                e = parse_ply(bytes(data))
                p = pd.concat([x.reset_index(drop=True) for k, x in e.items() if k in ("vertex", "normal", "color")], axis=1).reindex(columns=names)
                p[["r", "g", "b"]] /= 255
                yield p.assign(file=file, vid=range(len(p)))[["file", "vid", *names]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, vid long, " + ", ".join(f"{n} double" for n in names))


PATCH_FILE = np.dtype([("xi", "<u4"), ("yi", "<u4"), ("mean", "<f4"), ("stdev", "<f4"), ("height", "<f4"), ("n", "<f4"), ("low", "<f4"), ("high", "<f4"), ("idx", "<u4"), ("type", "<u4")])
PATCH_HEAD = b"patches\n1.0\n%d\nbin\n"


def format_patches(patches: pd.DataFrame) -> bytes:
    """A header (magic, version, record size) and packed records, x outermost, in list order."""
    p = patches.sort_values(["xi", "yi", "ord"])
    out = np.empty(len(p), PATCH_FILE)
    for name in PATCH_FILE.names:
        out[name] = p[name].to_numpy()
    return PATCH_HEAD % PATCH_FILE.itemsize + out.tobytes()


def parse_patches(data: bytes) -> pd.DataFrame:
    head = PATCH_HEAD % PATCH_FILE.itemsize
    if data[: len(head)] != head:
        raise ValueError("not a patch file of this version")
    p = pd.DataFrame(np.frombuffer(data, PATCH_FILE, offset=len(head)).astype([(n, "f8" if PATCH_FILE[n].kind == "f" else "i8") for n in PATCH_FILE.names]))
    return p.assign(ord=p.groupby(["xi", "yi"]).cumcount())


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for data in d["content"]:
                yield parse_patches(bytes(data))[["xi", "yi", "ord", *PATCH_FILE.names[2:]]]

    kinds = ", ".join(f"{n} {'double' if PATCH_FILE[n].kind == 'f' else 'long'}" for n in PATCH_FILE.names[2:])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"xi long, yi long, ord int, {kinds}")


def read_band(spark: SparkSession, path: str, spec: GridSpec, kind: str = "<f8", nodata: float | None = None, band: str = "value") -> DataFrame:
    """A raw band (row by row) as cells; nodata becomes null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for data in d["content"]:
                v = np.frombuffer(bytes(data), kind)
                if len(v) != spec.nx * spec.ny:
                    raise ValueError("the band has another size than the grid")
                k = np.arange(len(v))
                value = pd.Series(v.astype(float))
                yield pd.DataFrame({"xi": k % spec.nx, "yi": k // spec.nx, band: value if nodata is None else value.mask(value == nodata)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"xi long, yi long, `{band}` double")


def band_bytes(cells: DataFrame, spec: GridSpec, band: str, kind: str = "<f8", nodata: float = float("nan")) -> bytes:
    """A band as raw bytes, for a grid that fits on the driver (its size is checked)."""
    if spec.nx * spec.ny > 50_000_000:
        raise ValueError("too large for one file; write the cells as Parquet")
    out = np.full((spec.ny, spec.nx), nodata)
    for r in cells.select("xi", "yi", band).filter(F.col(band).isNotNull()).toLocalIterator():
        out[r[1], r[0]] = r[2]
    return out.astype(kind).tobytes()


def write_tiles(cells: DataFrame, spec: GridSpec, path: str, tile: int = 256) -> None:
    """Cells as Parquet by tile, so that a later area of interest reads its tiles only."""
    t = cells.withColumns({"tile_x": F.floor(F.col("xi") / tile), "tile_y": F.floor(F.col("yi") / tile)})
    t.repartition("tile_x", "tile_y").sortWithinPartitions("yi", "xi").write.partitionBy("tile_x", "tile_y").parquet(path)


def read_tiles(spark: SparkSession, path: str, x: tuple[int, int], y: tuple[int, int], tile: int = 256) -> DataFrame:
    """Cells of an area (inclusive), from its tiles."""
    d = spark.read.parquet(path)
    d = d.filter(F.col("tile_x").between(x[0] // tile, x[1] // tile) & F.col("tile_y").between(y[0] // tile, y[1] // tile))
    return d.filter(F.col("xi").between(*x) & F.col("yi").between(*y)).drop("tile_x", "tile_y")


def admitted(scans: DataFrame, least: float, keep: int, turn: float = math.inf) -> DataFrame:
    """Scan poses (sensor, seq, x, y, and yaw if there is one) that are at least a distance (or, in yaw, a turn) from each of
    the last ``keep`` admitted ones. What is admitted depends on what was, so a sensor's scans stream by in order after one
    sort; only the poses kept are held."""
    has_yaw = "yaw" in scans.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, deque(maxlen=keep)
        for d in batches:
            take = []
            yaws = d["yaw"] if has_yaw else [0.0] * len(d)
            for sensor, x, y, yaw in zip(d["sensor"], d["x"], d["y"], yaws, strict=True):
                if sensor != at:
                    at, kept = sensor, deque(maxlen=keep)
                new = all(math.hypot(a - x, b - y) >= least or abs(math.remainder(c - yaw, 2 * math.pi)) >= turn for a, b, c in kept)
                take.append(new)
                if new:
                    kept.append((x, y, yaw))
            yield d[np.array(take, bool)]

    return scans.repartition("sensor").sortWithinPartitions("sensor", "seq").mapInPandas(run, scans.schema)


MLS_HEAD = re.compile(rb"mls\n(1\.[0-3])\n(\d+)\nbin\n")
#: Moments of a weighted plane that a 1.3 record holds behind its height.
MOMENTS = ("x", "y", "z", "xx", "yy", "xy", "xz", "yz", "zz", "w")


def _mls_record(version: str) -> np.dtype:
    """A record of a surface map file: a C structure, aligned as on 64-bit machines."""
    number = "<f4" if version >= "1.2" else "<f8"
    fields = [("mean", number), ("stdev", number), ("height", number)]
    if version == "1.3":
        fields += [*((f"m_{m}", "<f4") for m in MOMENTS), ("low", "<f4"), ("high", "<f4"), ("n", "<f4"), ("normsq", "<f4"), ("idx", "<u8"), ("color", "u1", (3,)), ("type", "<i4")]
    else:
        fields += [("horizontal", "u1"), ("idx", "<u8")]
        fields += {"1.0": [], "1.1": [("color", "<f8", (3,))], "1.2": [("color", "u1", (3,))]}[version]
    return np.dtype([*fields, ("xi", "<u8"), ("yi", "<u8")], align=True)


def parse_mls(data: bytes) -> pd.DataFrame:
    """Patches of a surface map file of version 1.0 to 1.3, in list order (a patch of before 1.3 is one measurement)."""
    head = MLS_HEAD.match(data)
    if not head:
        raise ValueError("not a surface map file of a known version")
    version = head[1].decode()
    record = _mls_record(version)
    if int(head[2]) != record.itemsize:
        raise ValueError("records of another size")
    r = np.frombuffer(data, record, (len(data) - head.end()) // record.itemsize, head.end())
    p = pd.DataFrame({n: r[n].astype("f8") for n in ("mean", "stdev", "height")} | {n: r[n].astype("i8") for n in ("xi", "yi", "idx")})
    if version == "1.3":
        p = p.assign(n=r["n"].astype("f8"), low=r["low"].astype("f8"), high=r["high"].astype("f8"), type=r["type"].astype("i8"))
    else:
        p = p.assign(n=1.0, low=p["mean"], high=p["mean"], type=np.where(r["horizontal"] > 0, 1, 0))
    return p.assign(ord=p.groupby(["xi", "yi"]).cumcount())


def format_mls(patches: pd.DataFrame) -> bytes:
    """A surface map file of version 1.3, x outermost, in list order; the plane of a patch lies flat at its mean."""
    p = patches.sort_values(["xi", "yi", "ord"])
    out = np.zeros(len(p), _mls_record("1.3"))
    for n in ("mean", "stdev", "height", "low", "high", "n", "idx", "type", "xi", "yi"):
        out[n] = p[n].to_numpy()
    w = 1 / np.maximum(p["stdev"].to_numpy(float), 1e-12) ** 2
    out["normsq"], out["m_w"], out["m_z"], out["m_zz"] = w * w, w, w * p["mean"], w * p["mean"] ** 2
    return b"mls\n1.3\n%d\nbin\n" % out.dtype.itemsize + out.tobytes()


def read_mls(spark: SparkSession, path: str) -> DataFrame:
    """(file, xi, yi, ord, mean, stdev, height, n, low, high, idx, type) of surface map files."""
    names = ["xi", "yi", "ord", "mean", "stdev", "height", "n", "low", "high", "idx", "type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for file, data in zip(d["path"], d["content"], strict=True):
                yield parse_mls(bytes(data)).assign(file=file)[["file", *names]]

    kinds = "xi long, yi long, ord int, mean double, stdev double, height double, n double, low double, high double, idx long, type long"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {kinds}")


# TIFF tags and the sizes of its value types.
TIFF = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "offsets": 273, "samples": 277, "rows": 278, "counts": 279, "planar": 284, "format": 339, "scale": 33550, "tie": 33922, "nodata": 42113}
TIFF_TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 11: "f4", 12: "f8"}


def format_tiff(bands: np.ndarray, spec: GridSpec, nodata: float | None = None) -> bytes:
    """Uncompressed bands (band, row, column; row 0 is the lowest of the grid) as a GeoTIFF, whose first row is the highest."""
    n, h, w = bands.shape
    data = bands[:, ::-1].astype(bands.dtype.newbyteorder("<")).tobytes()
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    size = len(data) // n
    tags = [("width", 4, [w]), ("height", 4, [h]), ("bits", 3, [bands.dtype.itemsize * 8] * n), ("compression", 3, [1]), ("photometric", 3, [1]), ("offsets", 4, [8 + i * size for i in range(n)]), ("samples", 3, [n]), ("rows", 4, [h]), ("counts", 4, [size] * n), ("planar", 3, [2]), ("format", 3, [kind] * n), ("scale", 12, [spec.sx, spec.sy, 0.0]), ("tie", 12, [0.0, 0.0, 0.0, spec.ox, spec.oy + h * spec.sy, 0.0])]
    if nodata is not None:
        tags.append(("nodata", 2, list(f"{nodata:g}\0".encode())))
    at = 8 + len(data) + len(data) % 2
    more, entries, after = b"", [], at + 2 + 12 * len(tags) + 4
    for name, type_, values in tags:
        raw = np.array(values, "<u1" if type_ == 2 else f"<{TIFF_TYPES[type_]}").tobytes()
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", TIFF[name], type_, len(values), after + len(more)))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            entries.append(struct.pack("<HHI", TIFF[name], type_, len(values)) + raw.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags)) + b"".join(entries) + b"\0\0\0\0" + more


def parse_tiff(data: bytes) -> tuple[np.ndarray, GridSpec, float | None]:
    """Bands, grid and nodata of an uncompressed GeoTIFF in strips, of either byte order; rotated or tiled ones are refused."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    tags = {}
    for i in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, type_, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if type_ in TIFF_TYPES:
            kind = np.dtype(TIFF_TYPES[type_]).newbyteorder(order)
            from_ = at + 10 + 12 * i
            if n * kind.itemsize > 4:
                (from_,) = struct.unpack_from(f"{order}I", data, from_)
            tags[tag] = np.frombuffer(data, kind, n, from_)
    get = lambda name, other: tags.get(TIFF[name], np.array([other]))
    if get("compression", 1)[0] != 1 or TIFF["offsets"] not in tags or 34264 in tags:
        raise ValueError("compressed, tiled or rotated TIFF")
    w, h, n = int(get("width", 0)[0]), int(get("height", 0)[0]), int(get("samples", 1)[0])
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[int(get('format', 1)[0])] }{int(get('bits', 8)[0]) // 8}")
    raw = b"".join(data[int(o) : int(o) + int(c)] for o, c in zip(tags[TIFF["offsets"]], tags[TIFF["counts"]], strict=True))
    if len(raw) != w * h * n * kind.itemsize:
        raise ValueError("the bands have another size than the grid")
    v = np.frombuffer(raw, kind)
    v = v.reshape(n, h, w) if get("planar", 1)[0] == 2 else v.reshape(h, w, n).transpose(2, 0, 1)
    scale, tie = get("scale", 1.0), tags.get(TIFF["tie"], np.zeros(6))
    sx, sy = (float(scale[0]), float(scale[1])) if len(scale) > 1 else (1.0, 1.0)
    spec = GridSpec(w, h, sx, sy, float(tie[3] - tie[0] * sx), float(tie[4] + tie[1] * sy - h * sy))
    none = bytes(tags[TIFF["nodata"]]).rstrip(b"\0").decode() if TIFF["nodata"] in tags else ""
    return v[:, ::-1].astype(kind.newbyteorder("=")), spec, float(none) if none.strip() else None


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(file, band, xi, yi, x, y, value) of GeoTIFF files, a row per cell with a value; x and y are the cell's centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for file, data in zip(d["path"], d["content"], strict=True):
                bands, spec, nodata = parse_tiff(bytes(data))
                for b, v in enumerate(bands):
                    for y, row in enumerate(v.astype(float)):
                        x = np.flatnonzero(~np.isnan(row) & (row != (np.nan if nodata is None else nodata)))
                        yield pd.DataFrame({"file": file, "band": b, "xi": x, "yi": y, "x": spec.ox + (x + 0.5) * spec.sx, "y": spec.oy + (y + 0.5) * spec.sy, "value": row[x]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, band int, xi long, yi long, x double, y double, value double")


def append_line(header: dict[str, list[float]], lines: DataFrame, tilt: float, start: float, step: float, ranges: list[int], remissions: list[int]) -> tuple[dict[str, list[float]], DataFrame]:
    """A scan with one more line from a sensor's sample. The first line sets the header; a later one that differs from it is
    warned of and taken all the same."""
    spark = lines.sparkSession
    if not header:
        header = {"origin_psi": [start], "delta_psi": [step], "points_per_line": [float(len(ranges))]}
    for name, value in (("origin_psi", start), ("delta_psi", step), ("points_per_line", float(len(ranges)))):
        if header.get(name, [value])[0] != value:
            warnings.warn(f"{name} of the line differs from the scan's", stacklevel=2)
    last = lines.agg(F.max("line")).first()[0]
    line = [(0 if last is None else last + 1, tilt, list(ranges), list(remissions))]
    return header, lines.unionByName(spark.createDataFrame(line, lines.select("line", "phi", "ranges", "remissions").schema))


def cloud_from_samples(spark: SparkSession, points: np.ndarray, colours: np.ndarray | None = None) -> DataFrame:
    """A sensor's points (n by 3), with colours (n by 3, 0 to 1) if there are as many."""
    cols = {"vid": np.arange(len(points)), **{a: points[:, i].astype(float) for i, a in enumerate("xyz")}}
    if colours is not None and len(colours) == len(points):
        cols |= {c: colours[:, i].astype(float) for i, c in enumerate(("red", "green", "blue"))}
    return spark.createDataFrame(pd.DataFrame(cols))


def cells_from_image(spark: SparkSession, image: np.ndarray, bands: tuple[str, ...] = ("distance",)) -> DataFrame:
    """A distance image or a frame (rows by columns, or that by channels) as cells; what is not finite becomes null."""
    v = image.reshape(image.shape[0], image.shape[1], -1).astype(float)
    if v.shape[2] != len(bands):
        raise ValueError("the image has another number of channels")
    yi, xi = np.divmod(np.arange(v.shape[0] * v.shape[1]), v.shape[1])
    d = spark.createDataFrame(pd.DataFrame({"xi": xi, "yi": yi, **{b: v[:, :, i].ravel() for i, b in enumerate(bands)}}))
    finite = lambda b: F.when(~F.isnan(b) & (F.abs(b) != float("inf")), F.col(b))
    return d.withColumns({b: finite(b) for b in bands})


def grey_frame(cells: DataFrame, spec: GridSpec, band: str, kind: str = "u1") -> np.ndarray:
    """A band as a grey image of as many bits a pixel as its kind of number has (cells without a value are 0)."""
    return np.frombuffer(band_bytes(cells, spec, band, kind, 0), kind).reshape(spec.ny, spec.nx)
