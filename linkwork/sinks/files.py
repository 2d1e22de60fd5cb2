"""One file per document (K2, C2): a Spark data source whose writer commits whole jobs.

Tasks write their documents into a folder of their own below ``_temporary``; only when all tasks are done does
the commit move the files to their names, so a lost or repeated task adds nothing, and an aborted job
leaves the target's files as they were (a task that ends after the abort may leave its own below ``_temporary``).  Paths may be local or any store that Arrow's file systems know (``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "linkwork_documents"
LONGEST_NAME = 200


def file_name(collection_id: str, suffix: str) -> str:
    """The document's file name: its id percent-encoded, cut and told apart by a hash where it is too long."""
    name = quote(collection_id, safe="") or "_"
    if name.startswith((".", "_")):  # hidden from readers otherwise
        name = f"-{name}"
    if len(name) + len(suffix) > LONGEST_NAME:
        name = f"{name[:LONGEST_NAME - len(suffix) - 41]}-{hashlib.sha1(collection_id.encode()).hexdigest()}"
    return name + suffix


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, root = _store(self.path)
        folder = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            name = file_name(row["collection_id"] or "", self.suffix)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write((row["html"] or "").encode())
            names.append(name)
        return _Written(folder, names)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        names = {n for m in messages if m for n in m.names}
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.is_file and info.base_name not in names:
                    store.delete_file(info.path)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/_temporary/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary/{self.job}")
        if not store.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True)):
            with contextlib.suppress(OSError):  # another job may be using it by now
                store.delete_dir(f"{root}/_temporary")


class DocumentFiles(DataSource):
    """``df.write.format("linkwork_documents")`` for rows of ``collection_id, html``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "collection_id string, html string"

    def writer(self, schema, overwrite: bool) -> _DocumentWriter:
        return _DocumentWriter(self.options["path"], self.options.get("suffix", "_cleaned.html"), overwrite)


def write_documents(docs: DataFrame, path: str, suffix: str = "_cleaned.html") -> None:
    """Write each document of ``(collection_id, html)`` as the file ``path/<id><suffix>``; earlier files of the folder go."""
    docs.sparkSession.dataSource.register(DocumentFiles)
    docs.select("collection_id", "html").write.format(FORMAT).mode("overwrite").option("suffix", suffix).save(path)
