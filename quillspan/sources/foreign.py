"""Foreign formats as entity and connection rows: VOC XML, GraphML, YOLO, label-tool JSON, QA CSV, DXF, IFC, images.

Files are read whole, one at a time, inside the tasks; everything after the parsing is a plan over rows.
"""

from __future__ import annotations

import json
import math
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import geometry
from quillspan.operators.tiling import tile_count

ENTITY = f"doc string, ord int, entity_id string, entity_type string, label string, geometry {geometry.GEOMETRY}, ifc_class string, text string, sheet string, confidence double, attributes string"
_NAMES = [f.split()[0] for f in ENTITY.split(", ")]
CONNECTION = "doc string, ord int, source_id string, target_id string, connection_type string, directed boolean, confidence double"


def _shape(kind: str, points: list[tuple[float, float]], radius: float | None = None) -> dict:
    return {"type": kind, "points": [{"x": float(x), "y": float(y)} for x, y in points], "radius": radius, "start_angle": None, "end_angle": None}


def _entity(doc: str, k: int, kind: str, label: str | None, shape: dict | None, *, id: str | None = None, ifc: str | None = None, text: str | None = None, sheet: str | None = None, **attributes) -> tuple:
    return (doc, k, id or f"{doc}-{k}", kind, label, shape, ifc, text, sheet, 1.0, json.dumps(attributes) if attributes else None)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _files(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = re.findall(r"(?:^|, )(\w+) ", schema) if schema is not ENTITY else _NAMES

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"]):
                yield _frame(list(parse(p, bytes(content))), names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _stem(path: str) -> str:
    return PurePosixPath(path).stem


def parse_voc(path: str, data: bytes) -> Iterator[tuple]:
    """Annotated boxes as fractions of the image; without a size the geometry is null."""
    root, doc = ET.fromstring(data), _stem(path)
    number = lambda node, name: float((node.findtext(name) if node is not None else None) or 0)
    w, h = number(root.find("size"), "width"), number(root.find("size"), "height")
    for k, obj in enumerate(root.findall("object")):
        b = obj.find("bndbox")
        if b is None:
            continue
        x0, y0, x1, y1 = (number(b, n) for n in ("xmin", "ymin", "xmax", "ymax"))
        shape = _shape("bbox", [(x0 / w, y0 / h), (x1 / w, y1 / h)]) if w > 0 and h > 0 else None
        yield _entity(doc, k, "symbol", (obj.findtext("name") or "symbol").strip(), shape, source_px=[x0, y0, x1, y1])


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, parse_voc, ENTITY)


# Node labels of graphs that are dropped, and those that are junctions rather than symbols.
_DROPPED = ("background",)
_JUNCTIONS = ("connector", "crossing", "arrow")
_TAG = re.compile(r"^\{[^}]*\}")


def _plain(node: ET.Element) -> str:
    return _TAG.sub("", node.tag)


def _graph(data: bytes) -> tuple[list[tuple[str, dict]], list[tuple[str, str, dict]]]:
    nodes, edges = [], []
    for node in ET.fromstring(data).iter():
        values = {d.get("key"): d.text for d in node if _plain(d) == "data"}
        if _plain(node) == "node" and node.get("id") is not None:
            nodes.append((node.get("id"), values))
        elif _plain(node) == "edge":
            edges.append((node.get("source"), node.get("target"), values))
    return nodes, edges


def _graph_box(v: dict) -> tuple[float, float, float, float] | None:
    """Keys d1 to d4 are x, x, y, y; where they are missing, d5 to d8 are x, y, x, y."""
    keys = ("d1", "d3", "d2", "d4") if v.get("d1") is not None else ("d5", "d6", "d7", "d8")
    got = [v.get(k) for k in keys]
    return None if any(x is None for x in got) else tuple(map(float, got))  # type: ignore[return-value]


def parse_graphml(path: str, data: bytes) -> Iterator[tuple]:
    """Nodes with their box in pixels."""
    for k, (name, v) in enumerate(_graph(data)[0]):
        label, b = v.get("d0") or "node", _graph_box(v)
        if label in _DROPPED or b is None:
            continue
        junction = label in _JUNCTIONS
        extra = {"node_role": label} if junction else {}
        yield _entity(_stem(path), k, "graph_node" if junction else "symbol", label, _shape("bbox", [b[:2], b[2:]]), id=name, **extra)


def parse_graphml_edges(path: str, data: bytes) -> Iterator[tuple]:
    for k, (a, b, v) in enumerate(_graph(data)[1]):
        yield _stem(path), k, a, b, v.get("d9"), False, 1.0


def read_graphml(spark: SparkSession, path: str, *, size: tuple[int, int] | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected edges of graphs; edges with a dropped end are dropped.

    Images have their own ``sizes`` (doc, full_width, full_height), as ``read_images`` gives them, and graphs without
    an image of their name are left out; or all have one ``size``.
    """
    nodes = _files(spark, path, parse_graphml, ENTITY)
    if sizes is not None:
        known = sizes.where("full_width > 0 AND full_height > 0").groupBy("doc").agg(F.min(F.struct("full_width", "full_height")).alias("image"))
        nodes = nodes.join(known, "doc")
        w, h = F.col("image.full_width"), F.col("image.full_height")
    else:
        w, h = F.lit(size[0]), F.lit(size[1])
    scaled = F.transform("geometry.points", lambda p: geometry.point(p["x"] / w, p["y"] / h))
    nodes = nodes.withColumn("geometry", F.col("geometry").withField("points", scaled)).select(*_NAMES)
    kept = nodes.select("doc", "entity_id")
    edges = _files(spark, path, parse_graphml_edges, CONNECTION)
    for end in ("source_id", "target_id"):
        edges = edges.join(kept.withColumnRenamed("entity_id", end), ["doc", end], "left_semi")
    return nodes, edges


def capped(docs: DataFrame, *, subset: str = "subset", cap: int | None = None) -> DataFrame:
    """The first ``cap`` documents of each subset, by name; without a cap all of them."""
    if cap is None:
        return docs
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(subset).orderBy("doc"))).where(F.col("_n") <= cap).drop("_n")


def read_yolo(spark: SparkSession, path: str, names: list[str] | dict[int, str]) -> DataFrame:
    """Label lines (class cx cy w h) as boxes within the image; a class without a name is its number."""
    table = dict(enumerate(names)) if isinstance(names, list) else dict(names)
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("doc"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p")).where(F.size("p") >= 5)
    v = [F.col("p")[k].try_cast("double") for k in range(5)]
    kind = F.floor(v[0]).cast("int")
    known = F.create_map(*[x for k, n in table.items() for x in (F.lit(int(k)), F.lit(n))]) if table else F.create_map().cast("map<int,string>")
    low, high = lambda c, s: F.greatest(F.lit(0.0), c - s / 2), lambda c, s: F.least(F.lit(1.0), c + s / 2)
    shape = geometry.box_shape(low(v[1], v[3]), low(v[2], v[4]), high(v[1], v[3]), high(v[2], v[4]))
    return lines.select("doc", F.lit("symbol").alias("entity_type"), F.coalesce(F.try_element_at(known, kind), kind.cast("string")).alias("label"), shape.alias("geometry"), F.lit(1.0).alias("confidence"))


_LABEL_TOOL = "array<struct<type:string,value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>>>"


def from_label_tool(tasks: DataFrame) -> DataFrame:
    """Entities of the first annotation of each task (doc, results JSON): rectangles in per cent with a label."""
    first = F.coalesce(F.get_json_object("results", "$.annotations[0].result"), F.col("results"))
    rows = tasks.select("doc", F.posexplode(F.from_json(first, _LABEL_TOOL)).alias("ord", "r")).where("r.type = 'rectanglelabels' AND size(r.value.rectanglelabels) > 0")
    v = F.col("r.value")
    shape = geometry.box_shape(v["x"] / 100, v["y"] / 100, (v["x"] + v["width"]) / 100, (v["y"] + v["height"]) / 100)
    return rows.select("doc", "ord", F.lit("symbol").alias("entity_type"), v["rectanglelabels"][0].alias("label"), shape.alias("geometry"), F.lit(1.0).alias("confidence"))


def to_label_tool(entities: DataFrame) -> DataFrame:
    """The inverse: one result per entity with a box and a label, in per cent, as JSON text."""
    b = geometry.bounds(F.col("geometry"))
    value = F.struct((b["x_min"] * 100).alias("x"), (b["y_min"] * 100).alias("y"), (F.greatest(F.lit(0.0), geometry.width(b)) * 100).alias("width"), (F.greatest(F.lit(0.0), geometry.height(b)) * 100).alias("height"), F.array("label").alias("rectanglelabels"))
    result = F.struct(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("id"), F.lit("rectanglelabels").alias("type"), F.lit("label").alias("from_name"), F.lit("image").alias("to_name"), value.alias("value"))
    return entities.where(b.isNotNull() & F.col("label").isNotNull()).select("doc", "ord", F.to_json(result).alias("result"))


def read_questions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Questions of several CSV files (category: path), as (doc, category, q_id, type, question, answer, query, symbols).

    Rows without a drawing number are left out; filled columns that begin with Symbol are gathered; white space of the
    query is collapsed. Documents come in the order of (length, number).
    """
    out = None
    for category, path in paths.items():
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        has = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")  # noqa: E731, B023
        symbols = F.filter(F.array(*[F.col(f"`{c}`") for c in rows.columns if c.startswith("Symbol")]) if any(c.startswith("Symbol") for c in rows.columns) else F.array().cast("array<string>"), lambda x: F.coalesce(x, F.lit("")) != "")
        one = rows.select(F.trim(has("P&ID_number")).alias("doc"), F.lit(category).alias("category"), has("Q_id").alias("q_id"), has("Type").alias("type"), has("Question").alias("question"), has("GT").alias("answer"), F.trim(F.regexp_replace(F.coalesce(has("Cypher"), F.lit("")), r"\s+", " ")).alias("query"), symbols.alias("symbols"))
        out = one if out is None else out.unionByName(one)
    return out.where("coalesce(doc, '') <> ''").orderBy(F.length("doc"), "doc")


RAW = "doc string, ord int, kind string, layer string, name string, closed boolean, points array<struct<x:double,y:double>>, radius double, a0 double, a1 double"


def parse_dxf(path: str, data: bytes) -> Iterator[tuple]:
    """Primitives of the ENTITIES section of an ASCII drawing exchange file, in order."""
    lines = data.decode("utf-8", errors="replace").splitlines()
    pairs = ((a.strip(), b.strip()) for a, b in zip(lines[::2], lines[1::2]))
    doc, section, k = _stem(path), None, 0
    kind: str | None = None
    values: list[tuple[str, str]] = []
    open_line: list | None = None

    def numbers(code: str) -> list[float]:
        return [float(v) for c, v in values if c == code]

    def first(code: str, default: str | None = None) -> str | None:
        return next((v for c, v in values if c == code), default)

    def made() -> Iterator[tuple]:
        nonlocal k, open_line
        xy = list(zip(numbers("10"), numbers("20")))
        row = None
        layer = first("8", "0")
        if kind == "LINE" and xy and numbers("11"):
            row = [None, False, [xy[0], (numbers("11")[0], numbers("21")[0])], None, None, None]
        elif kind == "LWPOLYLINE" and xy:
            row = [None, bool(int(first("70", "0")) & 1), xy, None, None, None]
        elif kind == "POLYLINE":
            open_line = [layer, bool(int(first("70", "0")) & 1), []]
        elif kind == "VERTEX" and open_line is not None and xy:
            open_line[2].append(xy[0])
        elif kind == "SEQEND" and open_line is not None:
            if open_line[2]:
                yield doc, k, "POLYLINE", open_line[0], None, open_line[1], [{"x": x, "y": y} for x, y in open_line[2]], None, None, None
                k += 1
            open_line = None
        elif kind in ("ARC", "CIRCLE") and xy and numbers("40"):
            row = [None, kind == "CIRCLE", xy[:1], numbers("40")[0], *([numbers("50")[0], numbers("51")[0]] if kind == "ARC" else [None, None])]
        elif kind in ("TEXT", "MTEXT") and xy:
            row = ["".join(v for c, v in values if c in ("3", "1")), False, xy[:1], None, None, None]
        elif kind == "INSERT" and xy:
            row = [first("2"), False, xy[:1], None, None, None]
        if row:
            yield doc, k, kind, layer, row[0], row[1], [{"x": x, "y": y} for x, y in row[2]], *row[3:]
            k += 1

    for code, value in pairs:
        if code == "0":
            if section == "ENTITIES" and kind:
                yield from made()
            kind, values = value, []
            if value == "ENDSEC":
                section, kind = None, None
        elif code == "2" and kind == "SECTION":
            section, kind = value, None
        else:
            values.append((code, value))


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """Entities of drawings in fractions of their extent, y turned downwards; arcs have 24 points, circles 32."""
    raw = _files(spark, path, parse_dxf, RAW)
    c = F.element_at("points", 1)
    points = F.when(F.col("kind") == "ARC", geometry.arc_points(c["x"], c["y"], F.col("radius"), F.col("a0"), F.col("a1"))).when(F.col("kind") == "CIRCLE", geometry.circle_points(c["x"], c["y"], F.col("radius"))).otherwise(F.col("points"))
    raw = raw.withColumn("points", points)
    side = lambda f, a: f(F.transform("points", lambda p: p[a]))
    sizes = raw.groupBy("doc").agg(F.struct(F.min(side(F.array_min, "x")).alias("x_min"), F.min(side(F.array_min, "y")).alias("y_min"), F.max(side(F.array_max, "x")).alias("x_max"), F.max(side(F.array_max, "y")).alias("y_max")).alias("extent"))
    closed = F.col("closed")
    entity = F.when(F.col("kind").isin("LINE", "ARC"), "line").when(F.col("kind").isin("LWPOLYLINE", "POLYLINE"), F.when(closed, "polygon").otherwise("polyline")).when(F.col("kind").isin("CIRCLE", "INSERT"), "symbol").otherwise("text")
    shape_type = F.when(F.col("kind").isin("TEXT", "MTEXT", "INSERT"), "point").when(closed, "polygon").otherwise("polyline")
    norm = F.transform("points", lambda p: geometry.normalized(p["x"], p["y"], F.col("extent"), flip_y=True))
    return raw.join(sizes, "doc").select(
        "doc", "ord", entity.alias("entity_type"), F.when(F.col("kind") == "INSERT", F.col("name")).alias("label"), geometry.shape("", norm).withField("type", shape_type).alias("geometry"),
        F.when(F.col("kind").isin("TEXT", "MTEXT"), F.col("name")).alias("text"), "layer", F.lower(F.when(F.col("kind").isin("ARC", "CIRCLE"), F.col("kind"))).alias("shape"), F.lit(1.0).alias("confidence"),
    )


# Beginnings of IFC classes and the entity type they stand for, the first that fits holds; the spelling
# of common element classes, which files write in capitals; and classes that are placed like elements and are none.
IFC_TYPES = {
    "IfcWall": "wall", "IfcCurtainWall": "wall", "IfcDoor": "opening", "IfcWindow": "opening", "IfcSpace": "room", "IfcColumn": "equipment",
    "IfcBeam": "equipment", "IfcSlab": "polygon", "IfcFlowController": "equipment", "IfcFlowTerminal": "fixture", "IfcFlowSegment": "segment",
}
IFC_ELEMENTS = (
    "IfcWall", "IfcWallStandardCase", "IfcCurtainWall", "IfcDoor", "IfcWindow", "IfcColumn", "IfcBeam", "IfcSlab", "IfcRoof", "IfcStair", "IfcStairFlight", "IfcRamp", "IfcRailing", "IfcCovering", "IfcPlate",
    "IfcMember", "IfcFooting", "IfcPile", "IfcBuildingElementProxy", "IfcFurnishingElement", "IfcFurniture", "IfcFlowController", "IfcFlowTerminal", "IfcFlowSegment", "IfcFlowFitting", "IfcFlowMovingDevice",
    "IfcFlowStorageDevice", "IfcFlowTreatmentDevice", "IfcEnergyConversionDevice", "IfcDistributionElement", "IfcDistributionControlElement", "IfcElectricDistributionBoard", "IfcElectricAppliance", "IfcOutlet",
    "IfcSwitchingDevice", "IfcLightFixture", "IfcJunctionBox", "IfcSanitaryTerminal", "IfcPipeSegment", "IfcDuctSegment", "IfcValve", "IfcPump", "IfcTank", "IfcFan", "IfcSensor", "IfcAlarm", "IfcTransportElement",
)
IFC_OTHERS = (
    "IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY", "IFCSPACE", "IFCSPATIALZONE", "IFCEXTERNALSPATIALELEMENT", "IFCFACILITY", "IFCFACILITYPART", "IFCANNOTATION", "IFCGRID", "IFCPROXY",
    "IFCPORT", "IFCDISTRIBUTIONPORT", "IFCPOSITIONINGELEMENT", "IFCALIGNMENT", "IFCREFERENT", "IFCLINEARPOSITIONINGELEMENT",
)


def ifc_type(name: str) -> str:
    return next((t for prefix, t in IFC_TYPES.items() if name.upper().startswith(prefix.upper())), "other")


def _is_element(kind: str, args: list[str], records: dict) -> bool:
    """An element has an id, a name and a place: whatever has these and is no space, port, grid, type or relation."""
    if kind in IFC_OTHERS or kind.startswith(("IFCREL", "IFCSTRUCTURAL")) or kind.endswith(("TYPE", "STYLE")) or len(args) < 8 or args[0][:1] != "'":
        return False
    return args[5] == "$" or records.get(args[5], ("",))[0].endswith("PLACEMENT")


def _arguments(text: str) -> list[str]:
    """Arguments of a STEP record, split at the commas outside strings and lists."""
    out, depth, start, quoted = [], 0, 0, False
    for k, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
        elif not quoted and ch == "," and depth == 0:
            out.append(text[start:k].strip())
            start = k + 1
    return [*out, text[start:].strip()]


def _string(arg: str) -> str | None:
    return arg[1:-1].replace("''", "'") if arg[:1] == "'" else None


def _cross(a: list[float], b: list[float]) -> list[float]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def parse_ifc(path: str, data: bytes) -> Iterator[tuple]:
    """Elements of a model with the storey that contains them and where their placements put them."""
    records: dict[str, tuple[str, list[str]]] = {}
    for m in re.finditer(r"(#\d+)\s*=\s*([A-Za-z0-9_]+)\s*\(((?:'(?:[^']|'')*'|[^';])*)\)\s*;", data.decode("utf-8", errors="replace")):
        records[m[1]] = (m[2].upper(), _arguments(m[3]))
    refs = lambda arg: re.findall(r"#\d+", arg)
    triple = lambda r: ([float(x) for x in re.findall(r"[-+0-9.eE]+", records[r][1][0])] + [0.0] * 3)[:3] if r in records else None
    storey_of: dict[str, str] = {}
    for kind, args in records.values():
        if kind == "IFCRELCONTAINEDINSPATIALSTRUCTURE" and len(args) > 5 and records.get(args[5], ("",))[0] == "IFCBUILDINGSTOREY":
            name = _string(records[args[5]][1][2]) or f"Storey {args[5][1:]}"
            storey_of.update(dict.fromkeys(refs(args[4]), name))

    def axes(ref: str) -> tuple[list[float], list[list[float]]]:
        args = records[ref][1]
        z = _unit(triple(args[1])) if len(args) > 1 and args[1] in records else [0.0, 0.0, 1.0]
        x = triple(args[2]) if len(args) > 2 and args[2] in records else [1.0, 0.0, 0.0]
        x = _unit([a - sum(p * q for p, q in zip(x, z)) * b for a, b in zip(x, z)])
        return triple(args[0]) or [0.0] * 3, [x, _cross(z, x), z]

    def location(ref: str) -> list[float] | None:
        at, seen = [0.0, 0.0, 0.0], set()
        while ref in records and records[ref][0] == "IFCLOCALPLACEMENT" and ref not in seen:
            seen.add(ref)
            parent, own = records[ref][1][:2]
            if own not in records:
                return None
            origin, base = axes(own)
            at = [origin[k] + sum(at[j] * base[j][k] for j in range(3)) for k in range(3)]
            ref = parent
        return at if seen else None

    spelled = {n.upper(): n for n in IFC_ELEMENTS}
    # Classes whose spelling isn't known keep the file's.
    elements = [(r, spelled.get(kind, kind), args) for r, (kind, args) in records.items() if _is_element(kind, args, records)]
    spots = {r: at for r, _, args in elements if len(args) > 5 and (at := location(args[5]))}
    xs, ys = [p[0] for p in spots.values()], [p[1] for p in spots.values()]
    valid = bool(spots) and (max(xs) > min(xs) or max(ys) > min(ys))
    side = lambda a: a if a > 1e-9 else 1.0
    for k, (r, name, args) in enumerate(elements):
        shape = None
        if valid and r in spots:
            x, y = spots[r][:2]
            shape = _shape("point", [((x - min(xs)) / side(max(xs) - min(xs)), (max(ys) - y) / side(max(ys) - min(ys)))])
        yield _entity(_stem(path), k, ifc_type(name), _string(args[2]) or name, shape, id=_string(args[0]), ifc=name, sheet=storey_of.get(r, "Model"), ifc_type=name)


def read_ifc(spark: SparkSession, path: str) -> DataFrame:
    """Elements of models; ``sheet`` is the storey, or Model where there is none."""
    return _files(spark, path, parse_ifc, ENTITY)


def parse_image(path: str, data: bytes) -> Iterator[tuple]:
    """Width and height out of the header of a PNG, GIF, BMP, TIFF or JPEG file; null for anything else."""
    w = h = None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack(">II", data[16:24])
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        w, h = struct.unpack("<HH", data[6:10])
    elif data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
    elif data[:4] in (b"II*\0", b"MM\0*"):
        end = "<" if data[:2] == b"II" else ">"
        (at,) = struct.unpack(end + "I", data[4:8])
        (n,) = struct.unpack(end + "H", data[at : at + 2])
        for k in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind = struct.unpack(end + "HH", data[k : k + 4])
            (value,) = struct.unpack(end + ("H" if kind == 3 else "I"), data[k + 8 : k + (10 if kind == 3 else 12)])
            w, h = (value if tag == 256 else w), (value if tag == 257 else h)
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                break
            code, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                break
            at += 2 + size
    yield _stem(path), w, abs(h) if h is not None else None, True


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(doc, full_width, full_height, needs_perception, n_tiles): an image has no entities yet, but tiles to look at."""
    rows = _files(spark, path, parse_image, "doc string, full_width int, full_height int, needs_perception boolean")
    n = lambda c: tile_count(F.col(c), F.lit(1536), F.lit(1536 - 192))
    return rows.withColumn("n_tiles", F.when((F.col("full_width") > 0) & (F.col("full_height") > 0), n("full_width") * n("full_height")))


READERS: dict[str, Callable[..., object]] = {"dxf": read_dxf, "ifc": read_ifc, "xml": read_voc, "graphml": read_graphml, "png": read_images, "jpg": read_images, "jpeg": read_images, "gif": read_images, "bmp": read_images, "tif": read_images, "tiff": read_images}


def ingest(spark: SparkSession, path: str, **options):
    """Read by the ending of the name, in any case; an unknown one is an error."""
    ending = PurePosixPath(path).suffix.lower().lstrip(".")
    if ending not in READERS:
        raise NotImplementedError(f"no reader for {ending!r}; known are {', '.join(sorted(READERS))}")
    return READERS[ending](spark, path, **options)


def pages_of_words(pages: DataFrame) -> DataFrame:
    """Whether an extracted page is vector: 16 characters of text, or three drawings, or no images.

    ``pages`` has text, n_drawings and n_images, as a PDF library extracts them.
    """
    return pages.withColumn("is_vector", (F.length(F.trim(F.coalesce("text", F.lit("")))) >= 16) | (F.coalesce("n_drawings", F.lit(0)) >= 3) | (F.coalesce("n_images", F.lit(0)) == 0))


def calibrated_plans(rooms: DataFrame, plans: DataFrame) -> DataFrame:
    """Metres per unit of each plan (plan_id, net_area), such that its interior rooms have the stated area.

    ``rooms`` has plan_id, points and is_interior. Null where either area is missing or not positive.
    """
    interior = rooms.where("is_interior").groupBy("plan_id").agg(F.sum(geometry.shoelace(F.col("points"))).alias("units"))
    ok = (F.col("units") > 0) & (F.col("net_area") > 0)
    return plans.join(interior, "plan_id", "left").select("plan_id", F.when(ok, F.sqrt(F.col("net_area") / F.col("units"))).alias("m_per_unit"))
