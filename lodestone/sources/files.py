"""File-system work on the driver, through Spark's own Hadoop client, so that every scheme that Spark reads works."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

from pyspark.sql import SparkSession

#: Threads that do file-system work of many paths at a time, and paths that one of them takes at once.
_THREADS, _AT_ONCE = 8, 500
_SEGMENT = re.compile(r"^([a-zA-Z0-9._]+)=(.*)$")


def fs_path(spark: SparkSession, path: str):
    """(file system, Hadoop path)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_path(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = fs_path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = fs_path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = fs_path(spark, old)
    _, q = fs_path(spark, new)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"cannot rename {old} to {new}")


def _each(work: Callable, things: Iterable, at_once: int = _AT_ONCE) -> list:
    """``work`` on each thing, by threads; the first error is raised."""
    with ThreadPoolExecutor(_THREADS) as pool:
        return [x for some in pool.map(lambda some: [work(x) for x in some], batched(things, at_once)) for x in some]


def rename_all(spark: SparkSession, root: str, moves: Mapping[str, str]) -> None:
    """Renames many files of the file system of ``root``. A file takes three calls of the JVM, as folders and classes are looked up once."""
    fs, _ = fs_path(spark, root)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {new.rpartition("/")[0] for new in moves.values()}:
        fs.mkdirs(hadoop(folder))

    def move(item: tuple[str, str]) -> None:
        if not fs.rename(hadoop(item[0]), hadoop(item[1])):
            raise OSError(f"cannot rename {item[0]} to {item[1]}")

    _each(move, moves.items())


def delete_all(spark: SparkSession, root: str, paths: Collection[str]) -> None:
    """Deletes many files of the file system of ``root``; those that are gone are passed over."""
    fs, _ = fs_path(spark, root)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    _each(lambda path: fs.delete(hadoop(path), True), paths)


def leaves(spark: SparkSession, path: str, depth: int) -> list[str]:
    """What isn't hidden ``depth`` folders below a path, by name. A folder takes a few calls, however many files it holds."""
    jvm = spark.sparkContext._jvm
    fs, _ = fs_path(spark, path)
    hadoop, paths_of, wrapped = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileUtil.stat2Paths, jvm.scala.Predef.genericWrapArray

    def inside(folder: str) -> list[str]:
        found = wrapped(paths_of(fs.listStatus(hadoop(folder)))).mkString("\n").split("\n")
        return [x for x in found if x and not x.rsplit("/", 1)[-1].startswith(("_", "."))]

    found = [path]
    for _ in range(depth + 1):
        found = [x for some in _each(inside, found, 1) for x in some]
    return sorted(found)


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(path, is a directory) of what isn't hidden in a directory, by name."""
    fs, p = fs_path(spark, path)
    found = [(s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p)]
    return sorted(x for x in found if not x[0].rsplit("/", 1)[-1].startswith(("_", ".")))


def files_at_path(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right in a directory, or of the file."""
    if is_file(spark, path):
        return [path.rsplit("/", 1)[-1]]
    return [p.rsplit("/", 1)[-1] for p, is_dir in listing(spark, path) if not is_dir]


def data_files(spark: SparkSession, path: str) -> list[str]:
    """All files under a path, hidden ones left out, in the order of their names."""
    if is_file(spark, path):
        return [fs_path(spark, path)[1].toString()]
    out = []
    for p, is_dir in listing(spark, path):
        out += data_files(spark, p) if is_dir else [p]
    return out


def partition_leaves(spark: SparkSession, path: str) -> list[tuple[str, tuple[str, ...]]]:
    """Directories of a Hive tree that hold files, with the names of their partition columns.

    Directories that aren't ``name=value`` are passed over. A directory with both files and partitions, and trees whose leaves
    differ in their columns, are errors. This lists one directory at a time and is used only where Spark's own listing refuses a tree.
    """
    out: list[tuple[str, tuple[str, ...]]] = []

    def walk(at: str, names: tuple[str, ...]) -> None:
        found = listing(spark, at)
        files = [p for p, is_dir in found if not is_dir]
        dirs = [(p, m.group(1)) for p, is_dir in found if is_dir and (m := _SEGMENT.match(p.rsplit("/", 1)[-1]))]
        if files and dirs:
            raise ValueError(f"{at} holds both files and partitions")
        if files:
            out.append((at, names))
        for p, name in dirs:
            walk(p, (*names, name))

    walk(path, ())
    if len({names for _, names in out}) > 1:
        raise ValueError(f"partitions under {path} differ in their columns: {sorted({n for _, n in out})}")
    return out


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path that executors share: under ``spark.checkpoint.dir``; where that is unset and all runs on this machine, a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, local, True)
        root = "file://" + local
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
