"""Writing archive files from tasks so that lost or repeated tasks leave no trace.

A task writes files under names of its own (partition and attempt) and returns one manifest
row a file. Spark commits the manifest with its own writer, so it names the files of exactly
one successful attempt of each task; a file that it doesn't name is never read.
"""

from __future__ import annotations

import uuid

from ..storage import open_fs


def task_file(folder: str, suffix: str) -> str:
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{folder}/part-{c.partitionId():05d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"


def create(uri: str):
    """A binary output stream at ``uri``; folders are made as needed."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)  # the bytes as they are, whatever the name says
