"""The evaluation matrix: models on tasks, by metric and slice, with dispersion over seeds; boards and their tables.

A task has samples (doc, drawing_type, origin, condition, dataset) and the true entities of their documents. A model
gives predicted entities for a seed, or has numbers that were reported for it, or both; reported numbers come first.
Results have the columns of ``RESULT``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import format_value
from quillspan.operators.boards import over_seeds, ranked
from quillspan.operators.metrics import LOWER_IS_BETTER, METRICS

SLICE = ("drawing_type", "origin", "condition", "dataset")
RESULT = "model string, metric string, value double, std double, ci95 double, n_seeds bigint, drawing_type string, origin string, condition string, dataset string, kind string, citation string"
_COLUMNS = [f.split()[0] for f in RESULT.split(", ")]
SEEDS = (0, 1, 2)

# Numbers reported in papers, by who reports them and on what: metric, drawing type, value, source.
REPORTED = {
    "published, real drawings": (
        ("detection_map", "mep", 0.825, "arXiv 2508.10449"),
        ("graph_node_ap", "mep", 0.8363, "arXiv 2411.13929"),
        ("graph_edge_ap", "mep", 0.7546, "arXiv 2411.13929"),
        ("panoptic_quality", "mep", 0.889, "FloorPlanCAD, CADSpotting"),
        ("panoptic_quality", "architectural", 0.862, "arXiv 2503.22346"),
        ("external_wall_iou", "architectural", 0.9252, "arXiv 2602.06507"),
    ),
    "published, synthetic drawings": (("graph_edge_ap", "mep", 0.8895, "arXiv 2411.13929"),),
    "published, trained on synthetic only": (("graph_edge_ap", "mep", 0.638, "arXiv 2604.16513"),),
    "published, general models": (
        ("counting_exact_match", "mep", 0.51, "arXiv 2601.04819"),
        ("counting_exact_match", "architectural", 0.51, "arXiv 2601.04819"),
        ("counting_mape", "mep", 20.5, "arXiv 2601.04819"),
        ("counting_mape", "architectural", 20.5, "arXiv 2601.04819"),
        ("detection_map", "architectural", 0.24, "arXiv 2601.04819"),
        ("rfi_reward", "mep", 0.88, "arXiv 2603.29199"),
    ),
}
REAL_REFERENCES = ("published, real drawings", "published, general models", "published, trained on synthetic only")
SYNTHETIC_REFERENCES = ("published, synthetic drawings",)


@dataclass(frozen=True)
class Model:
    """``predict`` takes a task's true entities (for the documents to predict, not to be looked at) and a seed."""

    name: str
    predict: Callable[[DataFrame, int], DataFrame] | None = None
    stochastic: bool = False
    reported: Mapping[tuple[str, str], tuple[float, str]] = field(default_factory=dict)


def reported(name: str) -> Model:
    return Model(name, reported={(metric, kind): (value, source) for metric, kind, value, source in REPORTED[name]})


@dataclass(frozen=True)
class Task:
    name: str
    metrics: Sequence[str]
    samples: DataFrame
    truth: DataFrame


def slices(samples: DataFrame) -> DataFrame:
    """Samples of each slice; missing parts are unknown, a missing condition is clean."""
    return _sliced(samples).groupBy(*SLICE).agg(F.count("*").alias("n_samples"))


def _sliced(samples: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c), F.lit("clean" if c == "condition" else "unknown")).alias(c)
    return samples.select("doc", *[part(c) for c in SLICE])


def run_task(task: Task, model: Model, *, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """One row of ``RESULT`` per metric and slice. A model that isn't stochastic is run with the first seed only; one
    that neither reports a metric nor predicts has no row for it. Each prediction is made once for all metrics."""
    spark = task.truth.sparkSession
    samples = _sliced(task.samples)
    keys = sorted(tuple(r) for r in samples.select(*SLICE).distinct().collect())  # a row per slice
    rows, measured = [], []
    chosen = list(seeds) if model.stochastic else list(seeds)[:1]
    predictions = {seed: model.predict(task.truth, seed) for seed in chosen} if model.predict else {}
    for metric in task.metrics:
        for key in keys:
            known = model.reported.get((metric, key[0]))
            if known:
                rows.append((model.name, metric, float(known[0]), 0.0, 0.0, 1, *key, "reported", known[1]))
                continue
            docs = samples.where(reduce(Column.__and__, [F.col(c) == v for c, v in zip(SLICE, key)])).select("doc")
            for seed, predicted in predictions.items():
                value = METRICS[metric](predicted.join(docs, "doc", "left_semi"), task.truth.join(docs, "doc", "left_semi"))
                measured.append(value.select(F.lit(metric).alias("metric"), *[F.lit(v).alias(c) for c, v in zip(SLICE, key)], F.lit(seed).alias("seed"), "value"))
    out = spark.createDataFrame(rows, RESULT)
    if measured:
        each = over_seeds(reduce(DataFrame.unionByName, measured), ["metric", *SLICE])
        none = {"model": F.lit(model.name), "value": F.col("mean"), "n_seeds": F.col("n"), "kind": F.lit("measured"), "citation": F.lit("")}
        out = out.unionByName(each.select(*[none.get(c, F.col(c)).alias(c) for c in _COLUMNS]))
    return out


def run_matrix(tasks: Sequence[Task], models: Sequence[Model], *, seeds: Sequence[int] = SEEDS) -> DataFrame:
    return reduce(DataFrame.unionByName, [run_task(t, m, seeds=seeds) for t in tasks for m in models])


def append(results: DataFrame, path: str) -> None:
    """Results are added to those of earlier runs, never replaced."""
    results.select(*_COLUMNS).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).parquet(path)


def listings(results: DataFrame) -> DataFrame:
    """(metric, drawing_type) pairs there are results for, in order."""
    return results.select("metric", "drawing_type").distinct().orderBy("metric", "drawing_type")


def compared(results: DataFrame) -> DataFrame:
    """Results with their rank within metric and drawing type and their value as text; earlier names first of equals."""
    rows = results.withColumn("ord", F.struct("model", "condition", "origin", "dataset"))
    return ranked(rows).drop("ord").withColumn("score", format_value(F.col("metric"), F.col("value"), F.col("ci95")))


def render(results: DataFrame) -> str:
    """All comparisons as text, a table each; as many rows as a board has results."""
    out, last = ["# Results", ""], None
    for r in compared(results).orderBy("metric", "drawing_type", "rank").collect():
        if (r.metric, r.drawing_type) != last:
            last = (r.metric, r.drawing_type)
            better = "lower" if r.metric in LOWER_IS_BETTER else "higher"
            out += ["", f"## {r.drawing_type}: {r.metric} ({better} is better)", "", "| rank | model | condition | score | seeds | kind | source |", "|---|---|---|---|---|---|---|"]
        source = r.citation if r.kind == "reported" else "measured"
        out.append(f"| {r.rank} | {r.model}{' (best)' if r.rank == 1 else ''} | {r.condition} | {r.score} | {r.n_seeds} | {r.kind} | {source} |")
    return "\n".join(out)


def two_boards(model: Model, synthetic: Task, real: Task | None, *, seeds: Sequence[int] = SEEDS) -> tuple[DataFrame, DataFrame]:
    """Results on synthetic and on real drawings, never on one board. The truth itself is the upper bound of either.

    Without real samples the second board has the reported numbers alone, on a slice of no samples.
    """
    perfect = Model("truth", predict=lambda truth, seed: truth)
    first = run_matrix([synthetic], [model, perfect, *map(reported, SYNTHETIC_REFERENCES)], seeds=seeds)
    references = list(map(reported, REAL_REFERENCES))
    if real is not None and not real.samples.isEmpty():
        return first, run_matrix([real], [model, perfect, *references], seeds=seeds)
    spark = synthetic.truth.sparkSession
    waiting = spark.createDataFrame([("", "mep", "raster", "clean", "none yet")], "doc string, drawing_type string, origin string, condition string, dataset string")
    return first, run_matrix([Task("real", synthetic.metrics, waiting, synthetic.truth.where("false"))], references, seeds=seeds)


def demo_tasks(samples: DataFrame, truth: DataFrame) -> list[Task]:
    """The same samples as three tasks: symbols and runs, walls and rooms, and what is read and counted."""
    return [
        Task("mep", ("detection_map", "counting_mape", "counting_exact_match", "graph_node_ap"), samples, truth),
        Task("architectural", ("panoptic_quality", "external_wall_iou", "chamfer_distance", "loop_closure_validity"), samples, truth),
        Task("reading", ("ocr_exact_match", "dimension_accuracy"), samples, truth),
    ]
