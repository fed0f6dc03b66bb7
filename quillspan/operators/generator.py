"""Electrical models: generated scenes, circuits, what they must render to, and questions about them.

Models are frames: devices (model_id, device_id, label, x, y, room), circuits and their edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.geometry import centred_grid
from quillspan.operators.grounding import DETECTOR_CLASSES

# What a circuit may carry, and how many devices may be on it; the labels of each pool.
BUDGET_VA, MOST_DEVICES = 1920, 12
RECEPTACLES = ("Duplex Receptacle", "Quad Receptacle", "GFCI Receptacle")
LIGHTS = ("Light Fixture", "Recessed Downlight", "Wall Light")
_LOAD = {c[0]: c[4] for c in DETECTOR_CLASSES if c[4] is not None}


def load_va(label: Column) -> Column:
    out = F.lit(0)
    for name, va in _LOAD.items():
        out = F.when(label == name, va).otherwise(out)
    return out


def scenes(spark: SparkSession, n: int, *, seed: int = 0, rooms: int = 4, lights: int = 6, receptacles: int = 5) -> DataFrame:
    """Devices of ``n`` generated models: rooms side by side, each with a grid of lights and receptacles on its walls.

    Every choice is a hash of the seed and the ids, so a model is the same wherever and whenever it is made.
    """
    draw = lambda what: (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *[F.col(c) for c in ("model", "room")]), F.lit(1 << 20)) / float(1 << 20))
    base = spark.range(n).select(F.col("id").alias("model"), F.explode(F.sequence(F.lit(0), F.lit(rooms - 1))).alias("room"))
    x0, x1 = F.col("room") / rooms + 0.01, (F.col("room") + 1) / rooms - 0.01
    kind = F.when(draw("light") < 0.5, "Light Fixture").otherwise("Recessed Downlight")
    grid = F.transform(centred_grid(x0, F.lit(0.1), x1, F.lit(0.9), (1 + F.floor(draw("n") * lights)).cast("int")), lambda p: F.struct(kind.alias("label"), p["x"].alias("x"), p["y"].alias("y")))
    outlet = F.when(draw("outlet") < 0.2, "GFCI Receptacle").when(draw("outlet") < 0.4, "Quad Receptacle").otherwise("Duplex Receptacle")
    count = (1 + F.floor(draw("m") * receptacles)).cast("int")
    wall = F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(outlet.alias("label"), (x0 + (x1 - x0) * k / (count + 1)).alias("x"), F.when(k % 2 == 0, 0.1).otherwise(0.9).alias("y")))
    each = base.select("model", "room", F.posexplode(F.concat(grid, wall)).alias("k", "d"))
    model = F.format_string("m%06d", F.col("model"))
    return each.select(model.alias("model_id"), F.concat(model, F.lit("-d"), F.col("room").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("device_id"), "d.label", "d.x", "d.y", "room")


_PLACED = "model_id string, device_id string, number int, position int"


def circuits(devices: DataFrame, *, phases: int = 2, budget_va: int = BUDGET_VA, most: int = MOST_DEVICES) -> DataFrame:
    """(model_id, device_id, number, position, phase): receptacles, then lights, from left to right, onto circuits.

    A new circuit begins where the budget or the number of devices would be exceeded, and with the first light. Where
    one begins depends on where the last one did, so a model's devices pass one task in order; they are sorted before
    that and none is kept, however many there are.
    """
    pool = F.when(F.col("label").isin(*RECEPTACLES), 0).when(F.col("label").isin(*LIGHTS), 1)
    rows = devices.select("model_id", pool.alias("pool"), "x", "y", "device_id", load_va(F.col("label")).alias("va")).where("pool IS NOT NULL")
    ordered = rows.repartition("model_id").sortWithinPartitions("model_id", "pool", "x", "y", "device_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pool = number = load = n = None
        for batch in batches:
            numbers, positions = [], []
            for m, p, va in zip(*(batch.column(c).to_pylist() for c in ("model_id", "pool", "va"))):
                if m != model:
                    model, pool, number = m, None, 0
                if p != pool or load + va > budget_va or n >= most:
                    pool, number, load, n = p, number + 1, 0, 0
                numbers.append(number)
                positions.append(n)
                load, n = load + va, n + 1
            yield pa.RecordBatch.from_arrays([batch.column("model_id"), batch.column("device_id"), pa.array(numbers, pa.int32()), pa.array(positions, pa.int32())], names=["model_id", "device_id", "number", "position"])

    letters = F.array(*[F.lit(x) for x in "ABC"[:phases]])
    placed = ordered.mapInArrow(fold, _PLACED)
    return placed.withColumn("phase", F.element_at(letters, ((F.col("number") - 1) % phases + 1).cast("int")))


def edges(placed: DataFrame) -> DataFrame:
    """Conductors between neighbours on a circuit, and a home run from its last device to the panel (a null target)."""
    order = Window.partitionBy("model_id", "number").orderBy("position")
    after = F.lead("device_id").over(order)
    return placed.select("model_id", "number", F.when(after.isNull(), "home_run").otherwise("conductor").alias("connection_type"), F.col("device_id").alias("source_id"), after.alias("target_id"))


def circuit_loads(devices: DataFrame, placed: DataFrame) -> DataFrame:
    rows = placed.join(devices.select("model_id", "device_id", load_va(F.col("label")).alias("va")), ["model_id", "device_id"])
    return rows.groupBy("model_id", "number", "phase").agg(F.sum("va").alias("load_va"), F.count("*").alias("n_devices"))


def expected(devices: DataFrame, placed: DataFrame) -> DataFrame:
    """(model_id, sheet, kind, label, n): exactly what the plan, the schedule and the single line of a model show."""
    row = lambda sheet, kind, label, n: ["model_id", F.lit(sheet).alias("sheet"), F.lit(kind).alias("kind"), label.alias("label"), n.cast("long").alias("n")]
    models = devices.select("model_id").distinct()
    symbols = devices.groupBy("model_id", "label").agg(F.count("*").alias("c")).select(*row("plan", "entity", F.col("label"), F.col("c")))
    panels = [models.select(*row(s, "entity", F.lit("Panelboard"), F.lit(1))) for s in ("plan", "single_line")]
    runs = edges(placed).groupBy("model_id", "connection_type").agg(F.count("*").alias("c")).select(*row("plan", "edge", F.col("connection_type"), F.col("c")))
    m = placed.groupBy("model_id").agg(F.countDistinct("number").alias("c"))
    rest = [m.select(*row(s, k, F.lit(name), F.col("c"))) for s, k, name in (("schedule", "entity", "circuit_row"), ("single_line", "entity", "circuit"), ("single_line", "edge", "feeder"))]
    out = symbols
    for part in (*panels, runs, *rest):
        out = out.unionByName(part)
    return out


def template_questions(devices: DataFrame, placed: DataFrame) -> DataFrame:
    """(model_id, q_id, question, answer): counts that are true by construction."""
    m = placed.groupBy("model_id").agg(F.countDistinct("number").alias("n"))
    counts = devices.groupBy("model_id", "label").agg(F.count("*").alias("n"))
    sockets = devices.groupBy("model_id").agg(F.count_if(F.col("label").isin(*RECEPTACLES)).alias("n"))
    ask = lambda df, name, question: df.select("model_id", F.concat_ws("-", F.col("model_id"), F.lit("q"), name).alias("q_id"), question.alias("question"), F.col("n").cast("string").alias("answer"))
    out = ask(m, F.lit("circuits"), F.lit("How many branch circuits does the panel have?"))
    out = out.unionByName(ask(sockets, F.lit("receptacles"), F.lit("How many receptacles are on the plan?")))
    return out.unionByName(ask(counts, F.concat(F.lit("count-"), F.lower(F.replace(F.col("label"), F.lit(" "), F.lit("_")))), F.concat(F.lit("How many symbols of "), F.col("label"), F.lit(" are on the plan?"))))


def inconsistencies(devices: DataFrame, placed: DataFrame) -> DataFrame:
    """(model_id, device_id, problem): devices twice, on several circuits, or on a circuit without being there."""
    issue = lambda df, text: df.select("model_id", "device_id", F.lit(text).alias("problem"))
    key = ["model_id", "device_id"]
    twice = issue(devices.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "duplicate device")
    several = issue(placed.groupBy(*key).agg(F.countDistinct("number").alias("n")).where("n > 1"), "on several circuits")
    unknown = issue(placed.join(devices.select(*key).distinct(), key, "left_anti"), "unknown device")
    return twice.unionByName(several).unionByName(unknown)
