"""Drawing sets as files: JSON, gzipped JSON and MessagePack, by the ending of their names."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from quillspan.functions.text import readable_version
from quillspan.sources import msgpack

JSON, PACKED = (".json", ".json.gz"), (".cir", ".msgpack", ".mpk")


def codec_of(path: str) -> str:
    name = PurePosixPath(path).name.lower()
    if name.endswith(JSON):
        return "json"
    if name.endswith(PACKED):
        return "packed"
    raise ValueError(f"no codec for {name!r}; known endings are {', '.join(JSON + PACKED)}")


def _json_text(value: object) -> str:
    if not isinstance(value, dict):
        raise ValueError("a drawing set is an object")
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def from_msgpack(data: pd.Series) -> pd.Series:
    """MessagePack bytes as JSON text; anything but an object is an error."""
    return data.map(lambda b: None if b is None else _json_text(msgpack.unpackb(bytes(b))))


@F.pandas_udf(BinaryType())
def to_msgpack(text: pd.Series) -> pd.Series:
    """JSON text as MessagePack bytes; anything but an object is an error."""
    return text.map(lambda t: None if t is None else msgpack.packb(json.loads(_json_text(json.loads(t)))))


def load(spark: SparkSession, path: str, *, codec: str | None = None) -> DataFrame:
    """(path, payload) of the files of a path; the codec follows from its ending unless it is given."""
    if (codec or codec_of(path)) == "json":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    return spark.read.format("binaryFile").load(path).select("path", from_msgpack("content").alias("payload"))


def checked(docs: DataFrame) -> DataFrame:
    """Documents whose payload is an object of a readable version; the first other one is an error."""
    version = F.get_json_object("payload", "$.schema_version")
    is_object = F.coalesce(F.typeof(F.try_parse_json("payload")) == "variant", F.lit(False)) & F.col("payload").rlike(r"^\s*\{")
    ok = is_object & (version.isNull() | readable_version(version))
    message = F.concat(F.lit("not a drawing set of a readable version: "), F.coalesce("path", F.lit("?")))
    return docs.withColumn("payload", F.when(ok, F.col("payload")).otherwise(F.raise_error(message).cast("string")))


def save(docs: DataFrame, path: str, *, codec: str = "json", payload: Column | None = None) -> None:
    """Write payloads, one to a line as JSON (gzipped for ``json.gz``), or as a table of MessagePack bytes."""
    text = F.col("payload") if payload is None else payload
    if codec in ("json", "json.gz"):
        docs.select(text.alias("value")).write.mode("overwrite").option("compression", "gzip" if codec.endswith("gz") else "none").text(path)
    elif codec == "packed":
        docs.select(to_msgpack(text).alias("content")).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no codec {codec!r}")


def write_each(docs: DataFrame, folder: str) -> DataFrame:
    """One file per document (name, payload) in a folder that all executors share; gives the names written."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import os

        os.makedirs(folder, exist_ok=True)
        for part in parts:
            for name, payload in zip(part["name"], part["payload"]):
                data = msgpack.packb(json.loads(payload)) if codec_of(name) == "packed" else payload.encode()
                data = gzip.compress(data, 9) if name.lower().endswith(".gz") else data
                # Written aside and renamed: a task that runs again leaves a whole file in any case.
                with open(aside := f"{folder}/.{name}.{os.getpid()}", "wb") as file:
                    file.write(data)
                os.replace(aside, f"{folder}/{name}")
            yield part[["name"]]

    return docs.select("name", "payload").mapInPandas(write, "name string")
