"""The folder that driver and executors share, and files written there by tasks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """As spark.checkpoint.dir or setCheckpointDir name it. Only a session in one JVM gets one of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="clausewright-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def store_of(path: str):
    """(file system, path in it) of a folder or file, on any store that pyarrow knows; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if ":" in path else f"file://{path}"))


def write_files(files: DataFrame, folder: str) -> int:
    """files (path, content): each content under its relative path below `folder`; the number of files. Tasks write by
    themselves, and a task that runs again writes the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with store.open_output_stream(f"{root}/{path}") as file:
                    file.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small results that are read several times."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
