"""Session-level helpers shared by the operators: shared storage, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 8 << 20
#: Partitions over which the rows of one heavy join key are spread beyond that.
SALTS = 16


def _checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder named by spark.checkpoint.dir. Where none is named, a session on one machine gets a private one;
    one on a cluster is refused, as executors couldn't read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mnemora-"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to the executors, once per application, where PYTHONPATH doesn't already name it. Spark's
    own file server distributes the archive; executors need no copy of it beforehand."""
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="mnemora-")) / "mnemora-package"), "zip", root, "mnemora")
    spark.sparkContext.addPyFile(archive)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder, so that later steps survive lost executors
    without running the earlier ones again. Spark's cleaner removes the files with the last reference."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", row_bytes: int = 64) -> DataFrame:
    """Joins with a ``right`` side that is unique in ``keys`` and already materialised (see ``cut``).

    The rows of ``right`` are counted: below BROADCAST_BYTES they are broadcast. Otherwise both sides are
    shuffled, the left one salted so that a key with a large part of all rows is spread over SALTS tasks."""
    if right.count() * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    salt = "__salt"
    spread = left.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)))
    copies = right.withColumn(salt, F.explode(F.array([F.lit(i).cast("long") for i in range(SALTS)])))
    return spread.join(copies.hint("merge"), [*keys, salt], how).drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

