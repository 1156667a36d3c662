"""Where things lie: existence checks and the shared working folder."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def discard(spark: SparkSession, path: str) -> None:
    """Removes an intermediate result."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def files_below(spark: SparkSession, path: str) -> dict[str, int]:
    """The files of a folder, or the file itself, with their sizes; hidden ones left out."""
    system, target = _file_system(spark, path)
    own = system.getFileStatus(target)
    found = [own] if own.isFile() else [s for s in system.listStatus(target) if s.isFile()]
    sizes = {s.getPath().toString(): s.getLen() for s in found if s.getPath().getName()[0] not in "._"}
    return dict(sorted(sizes.items()))


def folders_below(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, if there is one."""
    system, target = _file_system(spark, path)
    if not system.exists(target):
        return []
    return sorted(s.getPath().toString() for s in system.listStatus(target) if s.isDirectory())


def mark(spark: SparkSession, path: str) -> None:
    """Leaves an empty folder."""
    system, target = _file_system(spark, path)
    system.mkdirs(target)


def names_below(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, if there is one."""
    return [name_of(f) for f in folders_below(spark, path)]


def first_lines(spark: SparkSession, path: str) -> dict[str, str]:
    """The first line of each file that has one."""
    lines: dict[str, str] = {}
    for file in files_below(spark, path):
        system, target = _file_system(spark, file)
        stream = system.open(target)
        try:
            text = spark._jvm.java.io.InputStreamReader(stream, "UTF-8")
            line = spark._jvm.java.io.BufferedReader(text).readLine()
        finally:
            stream.close()
        if line is not None:
            lines[file] = line.removeprefix("\ufeff")
    return lines


def working_folder(spark: SparkSession, fallback: str) -> str:
    """The shared folder the cluster names, or ``fallback`` where it names none."""
    return spark.conf.get(CHECKPOINT_DIR, None) or fallback


def name_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def as_name(path: str) -> str:
    """A path as one folder name."""
    return re.sub(r"[^A-Za-z0-9.-]+", "_", path).strip("_")
