"""A sink for rendered documents: a file each, all of a version at once.

``publish`` writes ``name, document`` rows by the data source ``documents``.  Tasks write their files
into folders of their own; when all are done these are gathered, with a list of names, sizes and
digests, and one rename makes them the next version under the path.  A task or job that fails leaves
no document, and a reader never sees half a version.  The rename must be atomic, as on HDFS and
local file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomspark.sources.workbooks import _opened as opened

#: The list of a version's documents: a JSON object ``name, bytes, sha256`` a line.
LIST = "documents.jsonl"
_FIELDS = "name string, bytes bigint, sha256 string"


def versions(path: str) -> list[int]:
    files, root = opened(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(f.base_name[1:]) for f in found if f.type == fs.FileType.Directory and f.base_name[:1] == "v" and f.base_name[1:].isdigit())


def _listed(path: str) -> list[dict]:
    have = versions(path)
    if not have:
        return []
    files, root = opened(path)
    with files.open_input_stream(f"{root}/v{have[-1]}/{LIST}") as stream:
        return [json.loads(line) for line in stream.read().decode().splitlines()]


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    documents: list[dict] = field(default_factory=list)


class _DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, whole: bool):
        self.path, self.whole, self.job = path.rstrip("/"), whole, f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> _Written:
        # a task that runs again, or twice, has another folder
        files, root = opened(f"{self.path}/{self.job}/{uuid.uuid4().hex}")
        files.create_dir(root, recursive=True)
        out = _Written(root)
        for row in rows:
            name, body = row["name"], (row["document"] or "").encode()
            if not name or "/" in name or name.startswith((".", "_")) or name == LIST:
                raise ValueError(f"no name for a document: {name!r}")
            with files.open_output_stream(f"{root}/{name}") as stream:
                stream.write(body)
            out.documents.append({"name": name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()})
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = opened(self.path)
        done = [m for m in messages if m is not None]
        listed = {d["name"]: d for m in done for d in m.documents}
        if len(listed) < sum(len(m.documents) for m in done):
            self.abort(messages)
            raise ValueError("documents share a name")
        have, old = versions(self.path), [] if self.whole else _listed(self.path)
        ready = f"{root}/{self.job}/ready"
        files.create_dir(ready, recursive=True)
        for m in done:
            for d in m.documents:
                files.move(f"{m.folder}/{d['name']}", f"{ready}/{d['name']}")
        for d in old:
            if d["name"] not in listed:
                files.copy_file(f"{root}/v{have[-1]}/{d['name']}", f"{ready}/{d['name']}")
                listed[d["name"]] = d
        with files.open_output_stream(f"{ready}/{LIST}") as stream:
            stream.write("".join(json.dumps(listed[n]) + "\n" for n in sorted(listed)).encode())
        # fails if another job has made this version
        files.move(ready, f"{root}/v{(have[-1] if have else 0) + 1}")
        files.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = opened(f"{self.path}/{self.job}")
        if files.get_file_info(root).type == fs.FileType.Directory:
            files.delete_dir(root)


class DocumentSink(DataSource):
    """``name, document`` rows as files; ``overwrite`` makes a version of these alone, ``append`` keeps
    the other documents of the last."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options["path"], overwrite)


def known_documents(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes, sha256`` of the newest version's documents."""
    have = versions(path)
    return spark.read.schema(_FIELDS).json(f"{path.rstrip('/')}/v{have[-1]}/{LIST}") if have else spark.createDataFrame([], _FIELDS)


def planned(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``name, action`` of what a version of ``documents`` changes: ``new``, ``changed``, ``unchanged``, ``removed``."""
    fresh = documents.select("name", F.sha2(F.coalesce("document", F.lit("")), 256).alias("_new"))
    both = fresh.join(known.select("name", F.col("sha256").alias("_old")), "name", "full")
    same = F.when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return both.select("name", F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "new").otherwise(same).alias("action"))


def publish(documents: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Make ``documents`` the next version under a path; what that changes, as ``planned`` says.  A dry
    run writes nothing.  A version that would change nothing isn't made."""
    spark = documents.sparkSession
    rows = documents.select("name", "document")
    plan = spark.createDataFrame(planned(rows, known_documents(spark, path)).collect(), "name string, action string")  # a name a file
    if not dry_run and plan.where("action <> 'unchanged'").limit(1).count():
        spark.dataSource.register(DocumentSink)
        rows.write.format("documents").mode("overwrite").option("path", path).save()
    return plan
