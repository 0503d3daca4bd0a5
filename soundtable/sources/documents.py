"""Text documents, one file for each name, that appear all together or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from soundtable.sources.files import resolve


@dataclass
class _Drafts(WriterCommitMessage):
    """What a task has written: (draft, name) of each document."""

    made: list[tuple[str, str]]


class _DocumentWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.drafts = f"{self.folder}/_drafts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Drafts:
        """Rows come sorted by name; a document is written as they come and never held."""
        system, path = resolve(self.drafts)
        system.create_dir(path, recursive=True)
        made, out, now = [], None, None
        for name, line in rows:
            if out is None or name != now:
                if out is not None:
                    out.close()
                now, draft = name, f"{path}/{uuid.uuid4().hex}"
                made.append((draft, name))
                out = system.open_output_stream(draft)
            if line is not None:
                out.write(line.encode() + b"\n")
        if out is not None:
            out.close()
        return _Drafts(made)

    def commit(self, messages: list) -> None:
        """Only drafts of tasks that count get their names; those of lost or repeated attempts go with the drafts' folder."""
        system, folder = resolve(self.folder)
        for message in messages:
            for draft, name in message.made if message else ():
                system.move(draft, f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, path = resolve(self.drafts)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)


class Documents(DataSource):
    """Writes (name, line) rows, sorted by name, as text files in a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options["path"])


def write_documents(lines: DataFrame, folder: str, name: str, order: list[str], line: str = "line") -> None:
    """Writes the lines of each name in `order` to the file of that name in `folder`, over one that is there.

    The rows of a document meet in one task, which streams them, so the same rows make the same bytes however they are
    partitioned; rows that tie in `order` must be equal. Tasks write drafts; when all have ended, these are moved to their
    names, so a failed job changes nothing and a task that is run again leaves no second file. Null lines are left out, a
    document of none but null lines is empty; rows without a name, or one with a slash, are an error. No row, no file."""
    spark = lines.sparkSession
    spark.dataSource.register(Documents)
    bad = lines.where(f"`{name}` IS NULL OR `{name}` = '' OR contains(`{name}`, '/')").limit(1).count()
    if bad:
        raise ValueError("a document needs a plain name")
    dealt = lines.repartition(name).sortWithinPartitions(name, *order).selectExpr(f"`{name}` AS name", f"`{line}` AS line")
    dealt.write.format("documents").mode("append").save(folder)
