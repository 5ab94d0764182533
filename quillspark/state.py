"""Tables written to cut a plan's lineage: computed once, safe from lost executors, deleted when nothing reads them any more."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


class Scope:
    """The tables written while it is open."""

    def __init__(self, around: Scope | None = None) -> None:
        self.paths: list[str] = []
        self.around = around
        self._kept: set[str] = set()

    def adopt(self, *frames: DataFrame) -> None:
        """The tables of the scope around that these frames read end with this scope."""
        for df in frames:
            for path in reads(df, self.around.paths if self.around else []):
                self.around.paths.remove(path)
                self.paths.append(path)

    def keep(self, *frames: DataFrame) -> None:
        """The tables that these frames read pass to the scope around when this one ends."""
        for df in frames:
            self._kept.update(reads(df, self.paths))

    def end(self, spark: SparkSession) -> None:
        self.around.paths.extend(p for p in self.paths if p in self._kept)
        for path in [p for p in self.paths if p not in self._kept]:
            _delete(spark, path)


_outermost = Scope()
#: What no open scope holds, in the order of writing.
written = _outermost.paths
_now: ContextVar[Scope] = ContextVar("scope", default=_outermost)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quillspark-"))
        found = _own["dir"]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which belongs to the scope that is open."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _now.get().paths.append(path)
    return path


def reads(df: DataFrame, paths: list[str]) -> list[str]:
    """Those of the paths whose files df reads."""
    folders = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
    return [p for p in paths if p.rsplit("/", 1)[-1] in folders]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """What is written inside is deleted at the end, but for what the frames given to keep() read. Threads have scopes of their own."""
    own = Scope(_now.get())
    token = _now.set(own)
    try:
        yield own
    finally:
        _now.reset(token)
        own.end(spark)


def scoped(operator: Callable[..., Any]) -> Callable[..., Any]:
    """An operator on a frame (its first argument) that keeps only the tables that the frames it returns read."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args: Any, **kwargs: Any) -> Any:
        with scope(df.sparkSession) as own:
            out = operator(df, *args, **kwargs)
            own.keep(*(x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)))
            return out

    return run


def discard(spark: SparkSession, paths: Sequence[str] | None = None) -> None:
    """Delete tables that no open scope holds, all of them if paths is None. Nothing that reads them may still have to run."""
    for path in list(written if paths is None else paths):
        _delete(spark, path)
        written.remove(path)


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back. The tables of this scope that instead_of reads are deleted then."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if instead_of is not None:
        mine = _now.get().paths
        for old in reads(instead_of, [p for p in mine if p != path]):
            mine.remove(old)
            _delete(spark, old)
    return out
