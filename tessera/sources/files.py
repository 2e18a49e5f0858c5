"""Files of cases, written by a job that leaves all of them or none.

A data source for rows (case_id, name, body). Cases are dealt over folders by a
checksum of their id; each folder's rows lie in one task, which writes them
beside the target, in a folder of its attempt. When all tasks are done each
folder is renamed into its place; when one fails they are removed. Attempts that
were repeated never show. The job's folder is made once, before the tasks begin:
one that is still at work when the job has failed finds it gone, and fails too.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "folder string, case_id string, name string, body binary"
#: Folders that cases are dealt over; so many renames end a job.
FOLDERS = 256


def folder_of(case: str | Column) -> Column:
    """Two hexadecimal digits, by the CRC-32 of the case's id."""
    text = (F.col(case) if isinstance(case, str) else case).cast("string")
    return F.lower(F.lpad(F.hex(F.crc32(text.cast("binary")) % FOLDERS), 2, "0"))


def _at(path: str):
    """(file system, path there) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _remove(job: str) -> None:
    """The folder of a job goes by one renaming, so that a task at work finds none, and is then deleted."""
    from pyarrow.fs import FileType

    fs, base = _at(job)
    if fs.get_file_info(base).type != FileType.NotFound:
        gone = f"{base}-gone"
        fs.move(base, gone)
        fs.delete_dir(gone)


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    folders: list[str]


class CaseFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "case_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CaseWriter(self.options["path"].rstrip("/"), overwrite, self.options["job"])


class CaseWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, job: str):
        self.path, self.overwrite, self.job = path, overwrite, job

    def write(self, iterator) -> Written:
        fs, base = _at(self.job)
        attempt, made, folders = uuid.uuid4().hex, set(), set()
        fs.create_dir(f"{base}/{attempt}", recursive=False)
        for b in iterator:
            for folder, case, name, body in zip(*(b.column(c).to_pylist() for c in ("folder", "case_id", "name", "body"))):
                if "/" in case or "/" in name or case.startswith(".") or not name:
                    raise ValueError(f"no file name: {case}/{name}")
                where = f"{base}/{attempt}/{folder}/{case}"
                if folder not in folders:
                    fs.create_dir(f"{base}/{attempt}/{folder}", recursive=False)
                    folders.add(folder)
                if where not in made:
                    fs.create_dir(where, recursive=False)
                    made.add(where)
                with fs.open_output_stream(f"{where}/{name}") as out:
                    out.write(body or b"")
        return Written(attempt, sorted(folders))

    def commit(self, messages) -> None:
        from pyarrow.fs import FileType

        fs, path = _at(self.path)
        _, base = _at(self.job)
        for m in messages:
            for folder in m.folders if m else ():
                target = f"{path}/{folder}"
                if fs.get_file_info(target).type != FileType.NotFound:
                    if not self.overwrite:
                        raise FileExistsError(target)
                    fs.delete_dir(target)
                fs.move(f"{base}/{m.attempt}/{folder}", target)
        self.abort(messages)

    def abort(self, messages) -> None:
        _remove(self.job)


def write_cases(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """Writes rows (case_id, name, body) as files ``path``/folder/case/name. A null body is an empty file; of rows with one
    name the last one written holds. ``path`` lies where all executors see it. Without ``overwrite`` a folder that exists is an error."""
    rows.sparkSession.dataSource.register(CaseFiles)
    job = f"{path.rstrip('/')}/.job-{uuid.uuid4().hex}"
    dealt = rows.select(folder_of("case_id").alias("folder"), F.col("case_id").cast("string").alias("case_id"), "name", "body")
    dealt = dealt.repartition(min(FOLDERS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "folder")
    fs, base = _at(job)
    fs.create_dir(base)
    try:
        dealt.write.format("case_files").mode("overwrite" if overwrite else "append").option("path", path).option("job", job).save()
    finally:
        _remove(job)
