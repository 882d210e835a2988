"""Trajectory files as a Spark data source: a task a file, frames by place in it, files pruned by video.

    read_files(spark, "store/clips").filter("video_id = 'a'")   # opens one file
"""

from __future__ import annotations

from collections.abc import Iterator
from csv import reader
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from trackloom.sources.trajectories import FRAMES

SUFFIX = "_ball.csv"


@dataclass
class TrajectoryFile(InputPartition):
    """One video's file."""

    uri: str
    video: str


class TrajectoryReader(DataSourceReader):
    """Lists the folder, takes what filters say of video_id, and reads each file in a task of its own."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.wanted = path, suffix, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of video_id prune files; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("video_id",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self) -> list[TrajectoryFile]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        listed = [info] if info.is_file else system.get_file_info(fs.FileSelector(root))
        found = []
        for f in sorted(listed, key=lambda f: f.path):
            video = unquote(f.base_name.removesuffix(self.suffix))
            if f.is_file and f.base_name.endswith(".csv") and (self.wanted is None or video in self.wanted):
                scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
                found.append(TrajectoryFile(scheme + f.path, video))
        return found or [TrajectoryFile("", "")]  # Spark asks for one partition at least

    def read(self, partition: TrajectoryFile) -> Iterator[pa.RecordBatch]:
        """Header names are trimmed and lower-cased, only x and y count; what is no finite number becomes 0."""
        if not partition.uri:
            return
        from pyarrow import csv, fs

        system, path = fs.FileSystem.from_uri(partition.uri) if "://" in partition.uri else (fs.LocalFileSystem(), partition.uri)
        with system.open_input_stream(path) as stream:
            head = stream.read(1 << 16).decode("utf-8-sig", "replace").splitlines()
        as_text = {c: pa.string() for c in next(reader(head), [])}
        at = 0
        with system.open_input_stream(path) as stream, csv.open_csv(stream, convert_options=csv.ConvertOptions(column_types=as_text)) as table:
            names = {c.strip().lower(): i for i, c in enumerate(table.schema.names)}
            if not {"x", "y"} <= names.keys():
                raise ValueError(f"{partition.uri}: a trajectory file needs the columns x and y")
            for batch in table:
                n = batch.num_rows
                x, y = (pa.array(_numbers(batch.column(names[c]))) for c in ("x", "y"))
                frames = pa.array(np.arange(at, at + n), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([partition.video] * n, pa.string()), frames, x, y], ["video_id", "frame", "x", "y"])
                at += n


def _numbers(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for i, v in enumerate(column.to_pylist()):
        try:
            out[i] = float(v)
        except (TypeError, ValueError):
            continue
    return np.where(np.isnan(out), 0.0, out)


class TrajectorySource(DataSource):
    """Options: path (a folder or a file), suffix (what follows the video's name in a file's name)."""

    @classmethod
    def name(cls) -> str:
        return "trajectories"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> TrajectoryReader:
        return TrajectoryReader(self.options["path"], self.options.get("suffix", SUFFIX))


def register(spark: SparkSession) -> None:
    """Makes format("trajectories") known to the session and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrajectorySource)


def read_files(spark: SparkSession, path: str, suffix: str = SUFFIX) -> DataFrame:
    """(video_id, frame, x, y) of a folder's files. Equality and membership of video_id choose the
    files.

    Spark keeps a table's last pushed filters until others are pushed, also for a later query on the same table
    that has none. No file is without a name, so the filter below drops nothing and has every query push its own.
    """
    register(spark)
    return spark.read.format("trajectories").option("suffix", suffix).load(path).filter("video_id IS NOT NULL")
