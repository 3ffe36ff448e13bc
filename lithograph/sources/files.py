"""A repository's files as a DataFrame, through a Python data source.

Spark's own file sources skip names that begin with a dot or an underscore, so ``__init__.py`` would be
missing; this source lists the tree itself. The driver lists names and sizes only; contents are read,
hashed and tested by the tasks, in partitions of about ``PARTITION_BYTES``, and not at all when the
``content`` option is off. The folder must be one that all executors see.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES, PARTITION_BYTES = 2_000_000, 32_000_000
# Patterns that are never scanned, before any ignore file.
DEFAULT_IGNORED = [
    ".git/",
    ".hg/",
    ".svn/",
    ".idea/",
    ".vscode/",
    ".env",
    ".env.*",
    "__pycache__/",
    ".pytest_cache/",
    ".ruff_cache/",
    ".mypy_cache/",
    ".venv/",
    "venv/",
    "node_modules/",
    "dist/",
    "build/",
    "coverage/",
    ".next/",
    ".nuxt/",
    ".turbo/",
    "target/",
    "*.pyc",
    "*.pyo",
    "*.so",
    "*.dylib",
    "*.dll",
    "*.exe",
    "*.class",
    "*.jar",
    "*.zip",
    "*.tar",
    "*.gz",
    "*.png",
    "*.jpg",
    "*.jpeg",
    "*.gif",
    "*.webp",
    "*.ico",
    "*.pdf",
    "uv.lock",
    "package-lock.json",
    "pnpm-lock.yaml",
    "yarn.lock",
]


class Ignore:
    """Rules of ignore files: the last rule that fits decides, ``!`` takes a path back, ``/`` anchors."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(base, self._compile(r.lstrip("!")), r.startswith("!"), r.rstrip().endswith("/")) for base, r in rules if r.strip() and not r.startswith("#")]

    @staticmethod
    def _compile(rule: str) -> re.Pattern:
        rule = rule.strip()
        body = rule.strip("/")
        anchored = rule.startswith("/") or "/" in body
        text = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", body))
        text = text.replace(".*/", "(?:.*/)?")
        return re.compile(("" if anchored else "(?:.*/)?") + text + "$")

    def __call__(self, path: str, folder: bool) -> bool:
        out = False
        for base, pattern, keep, folders_only in self.rules:
            if folders_only and not folder:
                continue
            if base and not path.startswith(base + "/"):
                continue
            if pattern.match(path[len(base) + 1 :] if base else path):
                out = not keep
        return out


def listed(root: str) -> list[tuple[str, int, float]]:
    """(path, size, modified) of the files below a folder, sorted; links and large files are left out."""
    rules = [("", r) for r in DEFAULT_IGNORED]
    out = []

    def walk(folder: str) -> None:
        full = os.path.join(root, folder)
        ignore_file = os.path.join(full, ".gitignore")
        if os.path.isfile(ignore_file):
            with open(ignore_file, encoding="utf-8", errors="replace") as f:
                rules.extend((folder, line.rstrip("\n")) for line in f)
        ignored = Ignore(rules)
        for e in sorted(os.scandir(full), key=lambda e: e.name):
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() or ignored(path, e.is_dir(follow_symlinks=False)):
                continue
            if e.is_dir(follow_symlinks=False):
                walk(path)
            elif (s := e.stat()).st_size <= MAX_BYTES:
                out.append((path, s.st_size, s.st_mtime))

    walk("")
    return sorted(out)


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files


class FilesReader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content

    def partitions(self) -> list[Part]:
        parts, size = [[]], 0
        for f in listed(self.root):
            if parts[-1] and size + f[1] > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += f[1]
        return [Part(p) for p in parts]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, size, modified in partition.files:
            when = datetime.fromtimestamp(modified, UTC)
            if not self.content:
                yield path, size, when, None, None
                continue
            with open(os.path.join(self.root, path), "rb") as f:
                raw = f.read()
            if b"\0" not in raw[:4096]:
                yield path, size, when, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace")


class Files(DataSource):
    """spark.read.format("lithograph_files").option("path", folder)"""

    @classmethod
    def name(cls) -> str:
        return "lithograph_files"

    def schema(self) -> str:
        return "path string, size long, modified_at timestamp, sha256 string, content string"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"], self.options.get("content", "true") == "true")


def scan(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """path, size, modified_at, sha256, content of every text file below a folder."""
    spark.dataSource.register(Files)
    return spark.read.format("lithograph_files").option("path", folder).option("content", str(content).lower()).load()
