"""Files that tasks write one by one, in any file system that the cluster mounts or that Arrow reaches."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as the session's file system sees it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Output:
    """A file that appears under its name only when it is whole; a repeated task replaces it."""

    def __init__(self, uri: str):
        self.uri = uri
        context = TaskContext.get()
        self.temporary = f"{uri}.{context.taskAttemptId() if context else 0}"
        if urlparse(uri).scheme in ("", "file"):
            path = urlparse(self.temporary).path
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.fs, self.file = None, open(path, "wb")  # noqa: SIM115
        else:
            self.fs, path = pyarrow.fs.FileSystem.from_uri(self.temporary)
            self.file = self.fs.open_output_stream(path)

    def commit(self) -> None:
        self.file.close()
        if self.fs is None:
            os.replace(urlparse(self.temporary).path, urlparse(self.uri).path)
        else:
            self.fs.move(urlparse(self.temporary).path, urlparse(self.uri).path)
