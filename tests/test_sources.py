import gzip
import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.sources import documents, foreign, msgpack
from quillspan.streaming import arrivals
from tests.conftest import rows

json_values = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=30)


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_msgpack_round_trip(value):
    assert msgpack.unpackb(msgpack.packb(value)) == value


@pytest.mark.parametrize("n", [15, 16, 31, 32, 255, 256, 65535, 65536])
def test_msgpack_sizes(n):
    for value in ("x" * n, b"x" * n, [1] * n, {str(k): k for k in range(n)}):
        assert msgpack.unpackb(msgpack.packb(value)) == value
    with pytest.raises(ValueError):
        msgpack.unpackb(msgpack.packb("x" * n)[:-1])
    with pytest.raises(ValueError):
        msgpack.unpackb(msgpack.packb(n) + b"\0")


DOC = {"schema_version": "0.2.0", "id": "a", "sheets": [{"views": [{"entities": [{"id": "e", "label": "Panelboard", "entity_type": "symbol", "confidence": 0.4}]}]}]}


def test_codecs(spark, tmp_path):
    df = spark.createDataFrame([("a.json", json.dumps(DOC)), ("b.json.gz", json.dumps(DOC)), ("c.cir", json.dumps(DOC))], "name string, payload string")
    assert documents.write_each(df, str(tmp_path)).count() == 3
    assert gzip.decompress((tmp_path / "b.json.gz").read_bytes()).decode() == json.dumps(DOC)
    for name in ("a.json", "b.json.gz", "c.cir"):
        got = documents.checked(documents.load(spark, str(tmp_path / name))).collect()
        assert [json.loads(r.payload) for r in got] == [DOC]
    with pytest.raises(ValueError):
        documents.load(spark, str(tmp_path / "a.txt"))
    for bad in ('{"schema_version": "99.0.0"}', "[1]", "broken"):
        with pytest.raises(Exception, match="not a drawing set"):
            documents.checked(spark.createDataFrame([("p", bad)], "path string, payload string")).collect()
    documents.save(df, str(tmp_path / "out"), codec="json.gz")
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    documents.save(df, str(tmp_path / "packed"), codec="packed")
    assert spark.read.parquet(str(tmp_path / "packed")).select(documents.from_msgpack("content")).count() == 3


def write(tmp_path, name, data):
    (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(tmp_path / name)


def test_voc(spark, tmp_path):
    xml = "<annotation><size><width>100</width><height>200</height></size><object><name> box </name><bndbox><xmin>10</xmin><ymin>20</ymin><xmax>30</xmax><ymax>60</ymax></bndbox></object><object><name>none</name></object></annotation>"
    got = foreign.ingest(spark, write(tmp_path, "v.XML", xml)).collect()
    assert [(r.label, r.geometry.points[0].x, r.geometry.points[1].y) for r in got] == [("box", 0.1, 0.3)]
    none = foreign.read_voc(spark, write(tmp_path, "n.xml", xml.replace("100", "0"))).first()
    assert none.geometry is None


def test_graphml(spark, tmp_path):
    node = lambda i, label, keys, v: f'<node id="{i}"><data key="d0">{label}</data>' + "".join(f'<data key="{k}">{x}</data>' for k, x in zip(keys, v)) + "</node>"
    xml = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">' + node("v", "valve", ("d1", "d2", "d3", "d4"), (10, 30, 20, 40)) + node("c", "connector", ("d5", "d6", "d7", "d8"), (50, 60, 54, 64)) + node("b", "background", ("d5", "d6", "d7", "d8"), (0, 0, 1, 1)) + '<edge source="v" target="c"><data key="d9">solid</data></edge><edge source="v" target="b"/></graph></graphml>'
    path = write(tmp_path, "g.graphml", xml)
    sizes = spark.createDataFrame([("g", 200, 100), ("h", 1, 1)], "doc string, full_width int, full_height int")
    own, _ = foreign.read_graphml(spark, path, sizes=sizes)
    assert {r.label: r.geometry.points[0].x for r in own.collect()} == {"valve": 0.05, "connector": 0.25}
    assert foreign.read_graphml(spark, path, sizes=sizes.where("doc = 'h'"))[0].count() == 0
    assert foreign.capped(spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "subset string, doc string"), cap=1).count() == 2
    nodes, edges = foreign.read_graphml(spark, path, size=(100, 100))
    centre = {r.entity_id: tuple(sum(p[k] for p in r.geometry.points) / 2 for k in ("x", "y")) for r in nodes.collect()}
    assert centre == {"v": pytest.approx((0.2, 0.3)), "c": pytest.approx((0.52, 0.62))}
    assert rows(nodes, "entity_id", "entity_type") == [("c", "graph_node"), ("v", "symbol")]
    assert rows(edges, "source_id", "target_id", "connection_type", "directed") == [("v", "c", "solid", False)]


def test_yolo_and_label_tool(spark, tmp_path):
    path = write(tmp_path, "x.txt", "0 0.5 0.5 0.2 0.1\n1 0.0 1.0 0.2 0.2\n7 0.5 0.5 0.1 0.1\n0 0.5\n\n")
    got = {r.label: r.geometry.points for r in foreign.read_yolo(spark, path, ["duplex", "switch"]).collect()}
    assert set(got) == {"duplex", "switch", "7"} and got["switch"][0].x == 0 and got["switch"][1].y == 1
    assert sum(p.x for p in got["duplex"]) / 2 == pytest.approx(0.5)
    task = json.dumps({"annotations": [{"result": [{"type": "rectanglelabels", "value": {"x": 10, "y": 20, "width": 20, "height": 30, "rectanglelabels": ["a"]}}, {"type": "choices", "value": {}}]}]})
    rows_ = foreign.from_label_tool(spark.createDataFrame([("d", task)], "doc string, results string"))
    r = rows_.first()
    assert [(p.x, p.y) for p in r.geometry.points] == [(0.1, 0.2), (pytest.approx(0.3), 0.5)]
    back = json.loads(foreign.to_label_tool(rows_).first().result)["value"]
    assert back == {"x": 10, "y": 20, "width": pytest.approx(20), "height": pytest.approx(30), "rectanglelabels": ["a"]}


def test_questions(spark, tmp_path):
    csv = "P&ID_number,Type,Symbol_Class,Q_id,Question,GT,Cypher\n10,t,valve,1,How?,2,\"MATCH\n  (n)\"\n2,t,,0,What?,x,\n,t,,9,lost,x,\n"
    got = foreign.read_questions(spark, {"counting": write(tmp_path, "q.csv", csv)}).collect()
    assert [(r.doc, r.q_id, r.query, r.symbols) for r in got] == [("2", "0", "", []), ("10", "1", "MATCH (n)", ["valve"])]


def test_dxf(spark, tmp_path):
    def record(kind, *pairs):
        return f"0\n{kind}\n8\nL\n" + "".join(f"{c}\n{v}\n" for c, v in pairs)

    body = (
        record("LINE", (10, 0), (20, 0), (11, 10), (21, 20)) + record("LWPOLYLINE", (70, 1), (10, 0), (20, 0), (10, 5), (20, 0), (10, 5), (20, 5)) + record("CIRCLE", (10, 5), (20, 5), (40, 2))
        + record("ARC", (10, 5), (20, 5), (40, 1), (50, 0), (51, 90)) + record("TEXT", (10, 1), (20, 1), (1, "NOTE")) + record("INSERT", (2, "DOOR"), (10, 3), (20, 3))
        + record("POLYLINE", (70, 0)) + record("VERTEX", (10, 1), (20, 2)) + record("VERTEX", (10, 2), (20, 2)) + record("SEQEND") + record("HATCH", (10, 1), (20, 1))
    )
    data = "0\nSECTION\n2\nHEADER\n9\n$X\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n" + body + "0\nENDSEC\n0\nEOF\n"
    got = foreign.ingest(spark, write(tmp_path, "d.dxf", data)).orderBy("ord").collect()
    assert [(r.entity_type, r.geometry.type, len(r.geometry.points)) for r in got] == [("line", "polyline", 2), ("polygon", "polygon", 3), ("symbol", "polygon", 32), ("line", "polyline", 24), ("text", "point", 1), ("symbol", "point", 1), ("polyline", "polyline", 2)]
    assert (got[0].geometry.points[0].x, got[0].geometry.points[0].y) == (0, 1) and (got[0].geometry.points[1].x, got[0].geometry.points[1].y) == (1, 0)
    assert got[4].text == "NOTE" and got[5].label == "DOOR" and got[2].shape == "circle"


def test_ifc(spark, tmp_path):
    step = """ISO-10303-21;
#1=IFCCARTESIANPOINT((10.,20.,0.));
#2=IFCAXIS2PLACEMENT3D(#1,$,$);
#3=IFCLOCALPLACEMENT($,#2);
#4=IFCCARTESIANPOINT((5.,0.,0.));
#5=IFCDIRECTION((0.,0.,1.)); #6=IFCDIRECTION((0.,1.,0.));
#7=IFCAXIS2PLACEMENT3D(#4,#5,#6);
#8=IFCLOCALPLACEMENT(#3,#7);
#9=IFCLOCALPLACEMENT(#8,#2);
#10=IFCWALLSTANDARDCASE('g1',$,'It''s; a wall',$,$,#3,$,$);
#11=IFCDOOR('g2',$,$,$,$,#9,$,$,$,$);
#12=IFCOUTLET('g3',$,'O',$,$,$,$,$,$);
#13=IFCBUILDINGSTOREY('s',$,'Level 1',$,$,#3,$,$,.ELEMENT.,0.);
#14=IFCRELCONTAINEDINSPATIALSTRUCTURE('r',$,$,$,(#10,#11),#13);
#15=IFCPROTECTIVEDEVICE('g4',$,'P',$,$,#3,$,$,$);
#16=IFCFLOWTERMINALSPECIAL('g5',$,$,$,$,#3,$,$);
#17=IFCSPACE('n1',$,'room',$,$,#3,$,$,.ELEMENT.,$,$);
#18=IFCOUTLETTYPE('n2',$,'t',$,$,$,$,$,$,.POWEROUTLET.);
#19=IFCPROPERTYSET('n3',$,'p',$,());
"""
    got = {r.entity_id: r for r in foreign.ingest(spark, write(tmp_path, "m.ifc", step)).collect()}
    # Every element counts, also of a class that isn't known; spaces, types and property sets are none.
    assert set(got) == {"g1", "g2", "g3", "g4", "g5"} and (got["g4"].ifc_class, got["g4"].label, got["g5"].entity_type) == ("IFCPROTECTIVEDEVICE", "P", "fixture")
    assert (got["g1"].label, got["g1"].ifc_class, got["g1"].entity_type, got["g1"].sheet) == ("It's; a wall", "IfcWallStandardCase", "wall", "Level 1")
    assert (got["g2"].label, got["g2"].entity_type, got["g3"].sheet, got["g3"].geometry) == ("IfcDoor", "opening", "Model", None)
    # The door is turned a quarter: (10, 20) becomes (-20, 10) and is moved by (5, 0), then by (10, 20).
    assert [(p.x, p.y) for p in got["g2"].geometry.points] == [(0, 0)] and [(p.x, p.y) for p in got["g1"].geometry.points] == [(1, 1)]


def test_images_and_unknown_endings(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + b"\0" * 9
    assert rows(foreign.ingest(spark, write(tmp_path, "a.png", png)), "full_width", "full_height") == [(640, 480)]
    assert rows(foreign.ingest(spark, write(tmp_path, "a.JPG", jpg)), "full_width", "full_height") == [(40, 30)]
    tif = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 4000, 0) + struct.pack("<HHII", 257, 4, 1, 3000)
    assert rows(foreign.ingest(spark, write(tmp_path, "a.TIFF", tif)), "full_width", "full_height", "n_tiles") == [(4000, 3000, 9)]
    with pytest.raises(NotImplementedError):
        foreign.ingest(spark, "x.rvt")


def test_pages_and_calibration(spark):
    pages = spark.createDataFrame([("x" * 16, 0, 1), ("", 3, 1), (None, None, None), ("", 0, 1)], "text string, n_drawings int, n_images int")
    assert [r.is_vector for r in foreign.pages_of_words(pages).collect()] == [True, True, True, False]
    room = spark.createDataFrame([("p", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], True)], "plan_id string, points array<struct<x:double,y:double>>, is_interior boolean")
    plans = spark.createDataFrame([("p", 400.0), ("q", 1.0)], "plan_id string, net_area double")
    assert rows(foreign.calibrated_plans(room, plans)) == [("p", 2.0), ("q", None)]


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(DOC))
    run = lambda: arrivals.start(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert run()
    (folder / "b.json").write_text(json.dumps(DOC))
    assert run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "label", "n", "needs_review", "batch") == [("Panelboard", 1, 1, 0), ("Panelboard", 1, 1, 1)]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(arrivals.event_windows(events), "n", "total") == [(2, 3.0)]
