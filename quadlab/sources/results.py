"""Results kept by what they were made from, so that the same work is not done twice."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadlab.sources.versions import Folder
from quadlab.sources.writers import dataset_fingerprint


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def files_fingerprint(df: DataFrame) -> str | None:
    """Digest of path, length and time of the files that ``df`` reads, and of its plan; None if it reads no files. Runs no job."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    if not files:
        return None
    jvm, seen = spark._jvm, []
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        s = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append((f, s.getLen(), s.getModificationTime()))
    return _digest(seen, df.semanticHash(), df.columns)


def names_key(names: DataFrame, store: str) -> tuple[str, int]:
    """Order-free key of the names in column ``name``, and their number.

    The key of a set of files is remembered in the store: as long as the files are the same, no job reads their names again.
    """
    spark, files = names.sparkSession, files_fingerprint(names.select("name"))
    folder = Folder(spark, store)
    memo = f"names-{files}"
    if files and folder.exists(memo):
        key, n = json.loads(folder.read(memo))
        return key, n
    row = dataset_fingerprint(names).first()
    key = _digest(row["n"], row["h1"], row["h2"])
    if files:
        folder.create(memo, json.dumps([key, row["n"]]))
    return key, row["n"]


def reused(names: DataFrame, store: str, params: dict, compute: Callable[[], DataFrame], one_row_per_name: bool = False) -> DataFrame:
    """The stored result for these names and parameters; else that of ``compute``, which is stored for the next call.

    The look-up comes before the work. A result is written to a folder of its own and named by a pointer at once when it is complete, so a failed attempt is never found; of two
    writers the first counts. ``one_row_per_name`` computes again when the stored rows are not as many as the names. Any changed name or parameter is another key.
    """
    spark: SparkSession = names.sparkSession
    folder = Folder(spark, store)
    key, n = names_key(names, store)
    done = f"done-{_digest(key, params)}"
    if folder.exists(done):
        data, rows = json.loads(folder.read(done))
        if not one_row_per_name or rows == n:
            return spark.read.parquet(f"{store}/{data}")
        folder.remove(done)
    data = f"data-{uuid.uuid4().hex}"
    compute().write.parquet(f"{store}/{data}")
    rows = spark.read.parquet(f"{store}/{data}").count()
    if not folder.create(done, json.dumps([data, rows])):
        folder.remove(data)
        data = json.loads(folder.read(done))[0]
    return spark.read.parquet(f"{store}/{data}")
