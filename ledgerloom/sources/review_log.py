"""The write path of review commands: a folder of one file per applied revision, which two writers cannot share."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commands import COMMAND, replay_commands


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file with this text at path, whole or not at all; False if there is one already."""
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    files = target.getFileSystem(conf)
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getUri().getScheme() == "file":  # a local rename looks first and moves then; a link does both in one
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            none = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(draft, target, none)
    except FileExistsError:
        return False
    except Exception as error:
        if "FileAlreadyExistsException" not in str(error):
            raise
        return False
    finally:
        if files.exists(draft):
            files.delete(draft, False)
    return True


class ReviewLog:
    """Commands of the workspaces of a batch. records, tasks and files are those of replay_commands()."""

    def __init__(self, spark: SparkSession, root: str, records: DataFrame, tasks: DataFrame, files: DataFrame) -> None:
        self.spark, self.root, self.batch = spark, root.rstrip("/"), (records, tasks, files)

    def commands(self, workspace_id: str | None = None) -> DataFrame:
        """COMMAND rows of what was applied, in the order of revisions."""
        folder = f"{self.root}/w-{workspace_id}" if workspace_id else f"{self.root}/w-*"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        empty = self.spark.createDataFrame([], COMMAND)
        return self.spark.read.schema(COMMAND).json(folder) if found else empty

    def replayed(self, workspace_id: str | None = None) -> DataFrame:
        return replay_commands(self.commands(workspace_id), *self.batch)

    def apply(self, command: dict) -> tuple[str, int | None]:
        """(outcome, revision) of a command; it is written only if it is applied, and then once.

        What was read may have been overtaken: the writer that makes the file of the next revision has won, and
        the other's command is judged again over the log as it then is.
        """
        while True:
            workspace = command["workspace_id"]
            log = self.commands(workspace)
            newest = log.agg(F.max("seq")).first()[0] or 0
            row = {**command, "seq": newest + 1}
            added = self.spark.createDataFrame([row], COMMAND)
            judged = replay_commands(log.unionByName(added), *self.batch).where(F.col("seq") == newest + 1).first()
            if judged.outcome != "applied":
                return judged.outcome, judged.revision
            folder = f"{self.root}/w-{workspace}"
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
            if create_once(self.spark, f"{folder}/{judged.revision:012d}.json", json.dumps(row, ensure_ascii=False) + "\n"):
                return judged.outcome, judged.revision
