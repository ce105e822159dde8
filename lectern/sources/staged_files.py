"""Files written by tasks that may fail, be repeated or run twice: staged, then moved in one commit.

A task writes to the job's staging folder under its partition and attempt. The
commit moves the files of the attempts that won, writes the job's manifest, and
removes the folder; an abort only removes it. A job has an id: a commit that
finds the manifest of its id does nothing, so a repeated job, or a streaming batch
that is run again, adds nothing twice. Readers see what manifests name, so they
see a job as a whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from lectern.sources.data_sources import BYTES, FILES, ROWS, FileGroup, dealt, opened

_MANIFEST = "_manifest-"


@dataclass
class Staged(WriterCommitMessage):
    """(name in the staging folder, name in the end) of the files of one task."""

    files: list[tuple[str, str]]


class _Staged:
    """Staging, commit and abort of the files below a path; ``job`` is the job's id.

    The driver makes the staging folder, so that a task that outlives an abort finds
    none and leaves nothing.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = options.get("jobId") or uuid.uuid4().hex
        system, root = opened(self.path)
        system.create_dir(self._folder(root, self.job), recursive=True)

    def _folder(self, root: str, job: str) -> str:
        return f"{root}/_staging-{job}"

    def _attempt(self) -> str:
        context = TaskContext.get()
        return f"{context.partitionId():06d}-{context.attemptNumber()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex

    def _commit(self, messages: list[Staged | None], job: str) -> None:
        system, root = opened(self.path)
        staging, manifest = self._folder(root, job), f"{root}/{_MANIFEST}{job}.json"
        if system.get_file_info(manifest).type == fs.FileType.NotFound:
            names = []
            for message in messages:
                for staged, name in message.files if message else ():
                    system.move(f"{staging}/{staged}", f"{root}/{name}")
                    names.append(name)
            # of a commit of this job that broke off: no manifest names them
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.base_name.startswith(f"results-{job}-") and f.base_name not in names:
                    system.delete_file(f.path)
            older = manifests(system, root)
            with system.open_output_stream(f"{staging}.json") as f:
                f.write(json.dumps(sorted(names)).encode())
            system.move(f"{staging}.json", manifest)
            if self.overwrite:
                self._remove(system, root, older, set(names))
        self._drop(system, staging)

    @staticmethod
    def _remove(system: fs.FileSystem, root: str, older: dict[str, list[str]], kept: set[str]) -> None:
        """Earlier jobs, manifests first; files of a name that the new job has too are its own."""
        for manifest in older:
            system.delete_file(f"{root}/{manifest}")
        for name in {n for names in older.values() for n in names} - kept:
            system.delete_file(f"{root}/{name}")

    @staticmethod
    def _drop(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def _abort(self, job: str) -> None:
        system, root = opened(self.path)
        self._drop(system, self._folder(root, job))


def manifests(system: fs.FileSystem, root: str) -> dict[str, list[str]]:
    """The files that each committed job names, by manifest."""
    out = {}
    for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.is_file and f.base_name.startswith(_MANIFEST):
            with system.open_input_stream(f.path) as s:
                out[f.base_name] = json.loads(s.read())
    return out


def _write_files(self, iterator: Iterator[pa.RecordBatch], job: str) -> Staged:
    """Each row (filename, content) as a file."""
    system, root = opened(self.path)
    folder, attempt, files = self._folder(root, job), self._attempt(), []
    for batch in iterator:
        for name, content in zip(batch.column("filename").to_pylist(), batch.column("content"), strict=True):  # one file's bytes at a time
            with system.open_output_stream(f"{folder}/{attempt}-{len(files)}") as f:
                f.write(content.as_py() or b"")
            files.append((f"{attempt}-{len(files)}", name))
    return Staged(files)


class FileWriter(_Staged, DataSourceArrowWriter):
    """Rows (filename, content) as files; filenames tell the files of a path apart."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return _write_files(self, iterator, self.job)

    def commit(self, messages) -> None:
        self._commit(messages, self.job)

    def abort(self, messages) -> None:
        self._abort(self.job)


def _write_lines(self, iterator: Iterator[pa.RecordBatch], job: str) -> Staged:
    """A task's rows as one file of JSON lines; none without rows."""
    system, root = opened(self.path)
    folder, attempt, n = self._folder(root, job), self._attempt(), 0
    with system.open_output_stream(f"{folder}/{attempt}") as f:
        for batch in iterator:
            for row in batch.select(["doc_id", "status", "body"]).to_pylist():
                f.write(json.dumps(row, ensure_ascii=False).encode() + b"\n")
                n += 1
    return Staged([(attempt, f"results-{job}-{attempt.split('-')[0]}.jsonl")] if n else [])


class ResultWriter(_Staged, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return _write_lines(self, iterator, self.job)

    def commit(self, messages) -> None:
        self._commit(messages, self.job)

    def abort(self, messages) -> None:
        self._abort(self.job)


class ResultStreamWriter(_Staged, DataSourceStreamArrowWriter):
    """A batch is a job: its id is ``jobId`` and the batch's number, so a batch that runs again is written once.

    Tasks do not know the number, so they stage under the query's own id, which has
    to be given: a query that is started again would have another one.
    """

    def __init__(self, options: dict, overwrite: bool):
        if not options.get("jobId"):
            raise ValueError("a stream of results needs the option jobId")
        super().__init__(options, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return _write_lines(self, iterator, self.job)

    def commit(self, messages, batchId: int) -> None:
        system, root = opened(self.path)
        job = f"{self.job}-{batchId:09d}"
        moved = [m and Staged([(staged, name.replace(f"results-{self.job}-", f"results-{job}-")) for staged, name in m.files]) for m in messages]
        if any(moved):
            self._drop(system, self._folder(root, job))
            system.move(self._folder(root, self.job), self._folder(root, job))
        self._commit(moved, job)
        self._drop(system, self._folder(root, self.job))

    def abort(self, messages, batchId: int) -> None:
        self._abort(self.job)


class ResultReader(DataSourceReader):
    """The results that committed jobs have written."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most_bytes, self.most_files = int(options.get("bytesPerPartition", BYTES)), int(options.get("filesPerPartition", FILES))

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        names = sorted({f"{root}/{n}" for names in manifests(system, root).values() for n in names})
        return dealt(system.get_file_info(names), self.most_bytes, self.most_files) or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        kind = pa.schema([("doc_id", pa.int64()), ("status", pa.int32()), ("body", pa.string())])
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                held = []
                for line in pa.BufferReader(f.read()).read().split(b"\n"):
                    if line:
                        held.append(json.loads(line))
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)


class Results(DataSource):
    """Results (doc_id, status, body) of documents, as JSON lines: ``lectern-results``."""

    @classmethod
    def name(cls) -> str:
        return "lectern-results"

    def schema(self) -> str:
        return "doc_id bigint, status int, body string"

    def reader(self, schema) -> ResultReader:
        return ResultReader(self.options)

    def writer(self, schema, overwrite: bool) -> ResultWriter:
        return ResultWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> ResultStreamWriter:
        return ResultStreamWriter(self.options, overwrite)
