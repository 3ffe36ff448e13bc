"""Page sets as archives: a Python data source that writes in two phases and reads back.

Each task writes its pages into one zip archive of Markdown files with a header, and an HTML list that
links them, below a folder of this export alone. Only when all tasks have ended does ``commit`` write the
manifest (the names of the archives, a row a task) beside it and move it to the next number, one rename;
readers take the newest manifest. A job that fails runs ``abort``, which removes its folder, so an earlier export
stays as it was; archives of attempts that did not count are removed at commit. The export before the
current one is kept for readers that have begun with it.

    pages.write.format("lithograph_pages").mode("append").save(path)    # replaces the export as a whole
    spark.read.format("lithograph_pages").load(path)

Paths may be in any store that pyarrow's file systems open. No page is ever sent to the driver.

Defined cases: a null slug is an error of its task; slugs may hold any characters; other nulls come back as
nulls; an empty set gives an empty export; a path without an export gives no rows.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "slug string, title string, parent_slug string, ord int, markdown string"
FIELDS = ["title", "parent_slug", "ord"]
MANIFEST = "_manifest-"


def opened(path: str):
    """pyarrow's file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def manifests(files, path: str) -> list[str]:
    """Names of an export's manifests, the newest last."""
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith(MANIFEST))


def read_json(files, path: str) -> dict:
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Archive(WriterCommitMessage):
    """What a task has written."""

    name: str
    pages: int


@dataclass
class Part(InputPartition):
    name: str


class PageWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.version = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Archive:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        files, base = opened(self.path)
        files.create_dir(f"{base}/{self.version}", recursive=True)
        n = 0
        with files.open_output_stream(f"{base}/{self.version}/{name}.zip") as out, files.open_output_stream(f"{base}/{self.version}/{name}.html") as links:
            links.write(b"<ul>\n")
            with zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_DEFLATED) as archive:
                for row in rows:
                    if row["slug"] is None:
                        raise ValueError("a page has no slug")
                    inside = f"{quote(row['slug'], safe='')}.md"
                    header = json.dumps({f: row[f] for f in FIELDS} | {"empty": row["markdown"] is None}, ensure_ascii=False)
                    archive.writestr(zipfile.ZipInfo(inside), f"{header}\n{row['markdown'] or ''}".encode("utf-8", "surrogatepass"))
                    links.write(f'<li><a href="{quote(inside)}">{escape(row["title"] or row["slug"])}</a></li>\n'.encode())
                    n += 1
            links.write(b"</ul>\n")
        return Archive(name, n)

    def commit(self, messages: list[Archive | None]) -> None:
        files, base = opened(self.path)
        done = [m for m in messages if m is not None and m.pages]
        files.create_dir(f"{base}/{self.version}", recursive=True)
        names = {f"{m.name}.{kind}" for m in done for kind in ("zip", "html")}
        self._clean(files, f"{base}/{self.version}", names)
        with files.open_output_stream(f"{base}/{self.version}/index.html") as out:
            out.write("".join(f'<p><a href="{m.name}.html">{m.pages} pages</a></p>\n' for m in done).encode())
        before = manifests(files, base)
        number = int(before[-1].removeprefix(MANIFEST)) + 1 if before else 1
        draft = f"{base}/{self.version}/manifest.json"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"version": self.version, "parts": [m.name for m in done], "pages": sum(m.pages for m in done)}).encode())
        files.move(draft, f"{base}/{MANIFEST}{number:012d}")  # from here on readers see it
        kept = manifests(files, base)[-2:]
        versions = {read_json(files, f"{base}/{k}")["version"] for k in kept}
        self._clean(files, base, {*kept, *versions})

    def abort(self, messages: list[Archive | None]) -> None:
        from pyarrow import fs

        files, base = opened(self.path)
        if files.get_file_info(f"{base}/{self.version}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.version}")

    @staticmethod
    def _clean(files, path: str, keep: set[str]) -> None:
        from pyarrow import fs

        for f in files.get_file_info(fs.FileSelector(path)):
            if f.base_name not in keep:
                files.delete_dir(f.path) if f.type == fs.FileType.Directory else files.delete_file(f.path)


class _Counted(io.RawIOBase):
    """A stream that only goes forward, as zip archives are written to."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        files, base = opened(path)
        newest = manifests(files, base)
        self.manifest = read_json(files, f"{base}/{newest[-1]}") if newest else {"version": "", "parts": []}

    def partitions(self) -> list[Part]:
        return [Part(name) for name in self.manifest["parts"]] or [Part("")]

    def read(self, part: Part) -> Iterator[tuple]:
        from urllib.parse import unquote

        if not part.name:
            return
        files, base = opened(self.path)
        with files.open_input_file(f"{base}/{self.manifest['version']}/{part.name}.zip") as source, zipfile.ZipFile(source) as archive:
            for info in archive.infolist():
                header, _, text = archive.read(info).decode("utf-8", "surrogatepass").partition("\n")
                own = json.loads(header)
                yield (unquote(info.filename.removesuffix(".md")), *(own[f] for f in FIELDS), None if own["empty"] else text)


class PageExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lithograph_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


def registered(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PageExport)
