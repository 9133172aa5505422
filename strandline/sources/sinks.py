"""Writers: partitioned tables, quoted CSV and feature collections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_cells(cells: DataFrame, path: str) -> None:
    """Layers as Parquet by area of interest and condition, clustered by level so that level filters skip row groups."""
    cells.repartition("aoi", "cond").sortWithinPartitions("aoi", "cond", "h").write.mode("overwrite").partitionBy("aoi", "cond").parquet(path)


def csv_field(x: Column) -> Column:
    """RFC 4180: quoted if a separator, quote or line break is inside."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*columns: str) -> Column:
    return F.concat_ws(",", *(csv_field(F.col(c)) for c in columns))


def feature_json(x: str, y: str, properties: list[str]) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


def content_versions(lines: DataFrame, width: int = 256, most_levels: int | None = None) -> DataFrame:
    """asset, version: a hash of the lines (asset, id, line) of each asset in the order of their ids (0 and up, each once).

    Lines of ``width`` consecutive ids are hashed together, then ``width`` consecutive hashes, until one is left, so no task holds
    more than that of an asset of any size. The last of ``most_levels`` levels takes all hashes of an asset that are left, one
    after another.
    """
    nodes = lines.select("asset", F.col("id").alias("at"), F.col("line").alias("text"))
    most, level = lines.agg(F.max("id")).first()[0] or 0, 1
    while True:
        if level == most_levels:
            return _hashed_in_order(nodes)
        nodes = nodes.groupBy("asset", F.floor(F.col("at") / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("rows"))
        nodes = nodes.select("asset", F.col("block").alias("at"), F.sha2(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), 256).alias("text"))
        most, level = most // width, level + 1
        if not most:
            return nodes.select("asset", F.col("text").alias("version"))


def _hashed_in_order(nodes: DataFrame) -> DataFrame:
    """asset, version: a hash of each asset's texts (asset, at, text) in order; a task holds a batch of them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asset, digest = None, None
        for batch in batches:
            assets, texts = batch.column("asset"), batch.column("text").to_pylist()
            done: list[tuple] = []
            for a, text in zip(assets.to_pylist(), texts, strict=True):
                if digest is None or a != asset:
                    if digest is not None:
                        done.append((asset, digest.hexdigest()))
                    asset, digest = a, hashlib.sha256(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
            yield _versions(done, kind := assets.type)
        if digest is not None:
            yield _versions([(asset, digest.hexdigest())], kind)

    in_order = nodes.repartition("asset").sortWithinPartitions("asset", "at").select("asset", "text")
    return in_order.mapInArrow(hashed, f"asset {dict(nodes.dtypes)['asset']}, version string")


def _versions(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch({"asset": pa.array([a for a, _ in rows], kind), "version": pa.array([v for _, v in rows], pa.string())})
