"""Files of named texts written by tasks, all or none.

Tasks write below a folder of the run's own; nothing there is part of what is published. Once every task has succeeded the files are moved into
place, then the manifest is written, and files that it no longer lists go. If a task fails, only the run's folder goes, and what was
published stays as it was. A task that is run twice leaves files that no message names; they go with the folder. One run at a time writes to a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGED = "_staged"
MANIFEST = "manifest.json"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or of an absolute local path, and the path within it; an error where there is no such store."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(store: fs.FileSystem, path: str, text: str) -> int:
    data = text.encode()
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)
    return len(data)


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (path, kind, bytes, staged name) of each file."""

    files: list[tuple[str, str, int, str]]


class TextFilesWriter(DataSourceWriter):
    def __init__(self, out: str):
        self.out, self.run = out.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, base = store_of(self.out)
        done = []
        for path, kind, text in iterator:
            if not path or path.startswith("/") or ".." in path.split("/") or text is None:
                raise ValueError(f"no file can be written as {path!r}")
            staged = f"{STAGED}/{self.run}/{uuid.uuid4().hex}"
            done.append((path, kind, put(store, f"{base}/{staged}", text), staged))
        return Written(done)

    def commit(self, messages: list) -> None:
        store, base = store_of(self.out)
        files = sorted(f for m in messages if m is not None for f in m.files)
        names = [f[0] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"a file is there twice: {next(a for a, b in zip(names, names[1:], strict=False) if a == b)}")
        for path, _, _, staged in files:
            store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
            store.move(f"{base}/{staged}", f"{base}/{path}")
        manifest = {"total_bytes": sum(f[2] for f in files), "files": [{"path": p, "kind": k, "bytes": n} for p, k, n, _ in files]}
        put(store, f"{base}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False, separators=(",", ":")))
        kept = {f"{base}/{n}" for n in [*names, MANIFEST]}
        for found in store.get_file_info(fs.FileSelector(base, recursive=True)):
            if found.is_file and found.path.endswith(".json") and found.path not in kept:
                store.delete_file(found.path)
        self.drop(STAGED)  # what tasks of earlier, failed runs wrote after those had ended, too

    def abort(self, messages: list) -> None:
        """Only what this run has staged; a task that is still running may leave files, which the next run that succeeds deletes."""
        self.drop(f"{STAGED}/{self.run}")

    def drop(self, path: str) -> None:
        store, base = store_of(self.out)
        if store.get_file_info(f"{base}/{path}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{path}")


class TextFiles(DataSource):
    """df.write.format("text_files").mode("overwrite").save("out") of rows (path, kind, text): one file each, with a manifest."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        if schema.fieldNames()[1] != "kind" or len(schema) != 3:
            raise ValueError("rows are (path, kind, text)")
        return TextFilesWriter(self.options["path"])
