"""Session plumbing."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run; does nothing the second time."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodestone-code-")) / "lodestone_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*")):
            if p.is_file() and p.suffix in (".py", ".json"):
                z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._lodestone_shipped = True


#: Tables of so many bytes are dealt to all cores when they are in fewer files than there are cores.
SMALL_TABLE = (1 << 20, 64 << 20)


def spread(rows: DataFrame) -> DataFrame:
    """A small table in a few files is mostly one row group, which one task reads: its rows are dealt to all cores.

    Tables of more bytes or files stay as they are, so nothing is shuffled where it would cost.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    small = SMALL_TABLE[0] <= size <= SMALL_TABLE[1] and len(rows.inputFiles()) < cores
    return rows.repartition(cores) if small else rows
