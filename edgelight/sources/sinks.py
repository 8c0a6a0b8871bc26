"""Data source `xasfiles`: rows (name, content) become files, all of a job or none; batch and stream.

Tasks write to a hidden staging folder of the job. Only when every task has ended well does the commit move the files to
their names; a job that fails shows no file of its own, and neither does an attempt that did not count. What a commit needs of a
task is its file names. Staging folders (.staging-*) go with the commit or the abort; only a task that outlives the abort of its job can leave one.

    rows.write.format("xasfiles").mode("append").save(folder)        # a file that exists is an error, before any file is moved
    rows.write.format("xasfiles").mode("overwrite").save(folder)     # files of these names are replaced, others stay
    rows.writeStream.format("xasfiles").option("checkpointLocation", c).start(folder)

folder is a path or URI that driver and executors can write. A stream's batch that is run again writes the same names anew, so its files
are there once. Null names or contents are an error.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

SCHEMA = "name string, content string"


@dataclass
class Staged(WriterCommitMessage):
    """A task's staging folder, and (staged name, name) of its files."""

    staging: str
    files: list


def store_of(folder: str):
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class Files:
    """Staging and moving, for both writers."""

    def __init__(self, folder: str, replace: bool):
        self.folder, self.replace = folder, replace
        self.staging = f".staging-{uuid.uuid4().hex}"

    def stage(self, rows) -> Staged:
        store, base = store_of(self.folder)
        made, done = False, []
        for row in rows:
            if row.name is None or row.content is None:
                raise ValueError("a file needs a name and content")
            name = os.path.basename(row.name)
            if not name or name.startswith("."):
                raise ValueError(f"no file name: {row.name!r}")
            if not made:
                store.create_dir(f"{base}/{self.staging}", recursive=True)
                made = True
            own = uuid.uuid4().hex
            with store.open_output_stream(f"{base}/{self.staging}/{own}", compression=None) as f:
                f.write(row.content.encode())
            done.append((own, name))
        return Staged(self.staging, done)

    def move(self, messages, replace: bool) -> None:
        store, base = store_of(self.folder)
        files = [(f"{m.staging}/{own}", name) for m in messages if m is not None for own, name in m.files]
        try:
            names, seen = [n for _, n in files], set()
            twice = sorted({n for n in names if n in seen or seen.add(n)})
            if twice:
                raise ValueError(f"{len(twice)} names stand twice, {twice[0]} for one")
            store.create_dir(base, recursive=True)
            there = {os.path.basename(f.path) for f in store.get_file_info(pafs.FileSelector(base)) if f.type != pafs.FileType.Directory}
            if not replace and (old := sorted(seen & there)):
                raise FileExistsError(f"{len(old)} files exist, {old[0]} for one")
            for own, name in files:
                store.move(f"{base}/{own}", f"{base}/{name}")
        finally:
            self.clear(messages)

    def clear(self, messages) -> None:
        # a stream's driver side is another object than its tasks'
        store, base = store_of(self.folder)
        for staging in {self.staging, *(m.staging for m in messages if m is not None)}:
            if store.get_file_info(f"{base}/{staging}").type == pafs.FileType.Directory:
                store.delete_dir(f"{base}/{staging}")


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.files = Files(folder, overwrite)

    def write(self, iterator):
        return self.files.stage(iterator)

    def commit(self, messages):
        self.files.move(messages, self.files.replace)

    def abort(self, messages):
        self.files.clear(messages)


class FilesStreamWriter(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.files = Files(folder, True)

    def write(self, iterator):
        return self.files.stage(iterator)

    def commit(self, messages, batchId):
        self.files.move(messages, True)

    def abort(self, messages, batchId):
        self.files.clear(messages)


class FilesSink(DataSource):
    @classmethod
    def name(cls):
        return "xasfiles"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return FilesWriter(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite):
        return FilesStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSink)
