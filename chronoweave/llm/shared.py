"""What the operators of this subpackage share: written tables, checked broadcasts, and sessions for Arrow operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.plans.storage import clear, fresh_path, recording, remove, shared_dir, written

__all__ = ["broadcast_if_small", "clear", "fresh_path", "recording", "remove", "shared_dir", "ship", "without", "written"]


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has no more than so many (short) rows; counts it, so it should be a written table."""
    return F.broadcast(df) if df.count() <= rows else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns by exact name."""
    return df.select(*[df[f"`{c}`"] for c in df.columns if c not in names])


_shipped: set[str] = set()


#: Rows of an Arrow batch, where Spark's default of 10 000 stands: texts may be long, and a task holds several batches.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Prepares a session for Arrow operators on texts: bounds batches, and sends this package to the executors,
    once per application, for workers that lack it."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="chronoweave-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
