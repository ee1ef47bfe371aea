"""A folder of text files as documents.

The folder is walked on the driver, top down and sorted, so pruned directories are never entered; files are read on the executors by a
Python data source, which needs the folder at the same path everywhere. (Spark's own binaryFile source hides names that start with
"_" or ".", so it would lose __init__.py.) What makes a file a document is decided in expressions on its bytes.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakeseek.functions import fixed
from lakeseek.functions.text import content_hash, count_newlines, file_kind, file_name, language, strip

FILES = "doc_id string, size bigint, link boolean, ignored boolean, content binary"


# -- ignore files ------------------------------------------------------------------------------------------------------


def _segment(glob: str) -> str:
    """One path segment's pattern as a regex."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        close = glob.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            inner = glob[at + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            at = close
        elif c == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        else:
            out += re.escape(c)
        at += 1
    return out


def ignore_rules(text: str) -> list[tuple[bool, bool, re.Pattern]]:
    """(re-includes, directories only, pattern on the path below the ignore file) for each line, in order."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negate = line.startswith("!")
        line = line[1:] if negate else line
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        only_dirs = line.endswith("/")
        body = line.rstrip("/")
        anchored = "/" in body
        body = body.removeprefix("/")
        regex = "" if anchored else "(?:.*/)?"
        parts = body.split("/")
        for k, part in enumerate(parts):
            end = k == len(parts) - 1
            if part == "**":
                regex += ".+" if end else "(?:.*/)?"
            else:
                regex += _segment(part) + ("" if end else "/")
        out.append((negate, only_dirs, re.compile(regex + r"\Z", re.S)))
    return out


def is_ignored(rel: str, is_dir: bool, specs: list[tuple[str, list]]) -> bool:
    """specs: (directory relative to the root, "" for it; rules), root first. The last matching rule of the deepest file decides."""
    for base, rules in reversed(specs):
        below = rel[len(base) + 1 :] if base else rel
        for negate, only_dirs, pattern in reversed(rules):
            if (is_dir or not only_dirs) and pattern.match(below):
                return not negate
    return False


def walk(root: str, skip_dirs=fixed.SKIP_DIRS, respect_gitignore: bool = True, exclude: str | None = None) -> list[tuple[str, int, bool, bool]]:
    """(path below the root, size, is a link, is ignored) of all files, in order; pruned directories are not entered."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    out, skip = [], set(skip_dirs)
    exclude = os.path.abspath(exclude) if exclude else None

    def enter(folder: str, specs: list):
        full = os.path.join(root, folder) if folder else root
        if respect_gitignore and os.path.isfile(path := os.path.join(full, ".gitignore")):
            try:
                with open(path, encoding="utf-8-sig") as file:
                    specs = [*specs, (folder, ignore_rules(file.read()))]
            except (OSError, UnicodeDecodeError):
                pass
        entries = sorted(os.scandir(full), key=lambda e: e.name)
        for e in entries:
            rel = f"{folder}/{e.name}" if folder else e.name
            if not e.is_dir(follow_symlinks=False) and not (e.is_symlink() and os.path.isdir(e.path)):
                out.append((rel, e.stat(follow_symlinks=False).st_size, e.is_symlink(), is_ignored(rel, False, specs)))
        for e in entries:
            rel = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False) and e.name not in skip and not is_ignored(rel, True, specs) and os.path.abspath(e.path) != exclude:
                enter(rel, specs)

    enter("", [])
    return sorted(out)


class _Slice(InputPartition):
    def __init__(self, files):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.limit = int(options.get("maxFileBytes", fixed.MAX_FILE_BYTES))
        self.slice_bytes = int(options.get("sliceBytes", 8 << 20))
        self.gitignore = options.get("respectGitignore", "true").lower() == "true"
        self.exclude = options.get("exclude")
        self.only = options.get("only")

    def files(self):
        if self.only is not None:
            return self.named(json.loads(self.only))
        return walk(self.root, respect_gitignore=self.gitignore, exclude=self.exclude)

    def named(self, paths):
        """Those of ``paths`` that are files below the root; nothing else is looked at."""
        root, out = os.path.realpath(self.root), []
        for rel in sorted(set(paths)):
            full = os.path.join(self.root, rel)
            if os.path.isfile(full) and os.path.commonpath([root, os.path.realpath(full)]) == root:
                out.append((rel, os.lstat(full).st_size, os.path.islink(full), False))
        return out

    def partitions(self):
        slices, size = [[]], 0
        for f in self.files():
            if size > self.slice_bytes:
                slices.append([])
                size = 0
            slices[-1].append(f)
            size += min(f[1], self.limit)
        return [_Slice(s) for s in slices]

    def read(self, partition):
        for rel, size, link, ignored in partition.files:
            content = None
            if not (link or ignored or size > self.limit):
                try:
                    with open(os.path.join(self.root, rel), "rb") as file:
                        content = file.read()
                except OSError:
                    pass
            yield rel, size, link, ignored, content


class FolderSource(DataSource):
    """spark.read.format("lakeseek_folder").load(path)"""

    @classmethod
    def name(cls):
        return "lakeseek_folder"

    def schema(self):
        return FILES

    def reader(self, schema):
        return _Reader(self.options)


def read_files(spark: SparkSession, root: str, max_file_bytes: int = fixed.MAX_FILE_BYTES, respect_gitignore: bool = True, exclude: str | None = None) -> DataFrame:
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("lakeseek_folder").option("maxFileBytes", max_file_bytes).option("respectGitignore", str(respect_gitignore).lower())
    return (reader.option("exclude", exclude) if exclude else reader).load(root)


def with_reasons(files: DataFrame, max_file_bytes: int = fixed.MAX_FILE_BYTES, kinds: list[str] | None = None, blank_too: Column | None = None) -> DataFrame:
    """``files`` with kind, decoded text and skip_reason (null for documents); the first reason that holds, in a fixed order. Files of ``blank_too`` are not skipped for being empty."""
    head = F.substring("content", 1, fixed.SNIFF_BYTES)
    bom = F.substring("content", 1, 3) == F.lit(bytearray(b"\xef\xbb\xbf"))
    body = F.when(bom, F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string")
    kinded = files.withColumns({"kind": file_kind(F.col("doc_id")), "raw": body})
    chars = F.length("raw")
    name = F.lower(file_name(F.col("doc_id")))
    reason = F.when(F.col("ignored"), "gitignored")
    if kinds is not None:
        reason = reason.when(~F.col("kind").isin(*kinds), F.concat(F.lit("kind:"), F.col("kind")))
    reason = (
        reason.when(F.col("link"), "symlink").when(F.col("size") > max_file_bytes, "too_large").when(F.col("content").isNull(), "unreadable")
        .when(F.contains(head, F.lit(bytearray(b"\x00"))), "binary").when(~F.is_valid_utf8("raw"), "not_utf8").when((strip(F.col("raw")) == "") if blank_too is None else (strip(F.col("raw")) == "") & ~blank_too, "empty")
        .when(name.contains(".min."), "minified")
        .when((chars >= fixed.MINIFIED_CHARS) & (chars / (count_newlines(F.col("raw")) + 1) > fixed.MINIFIED_LINE_CHARS), "minified")
    )
    return kinded.withColumn("skip_reason", reason).withColumn("text", F.when(F.col("skip_reason").isNull(), F.col("raw"))).drop("raw", "content")


def load_folder(spark: SparkSession, root: str, max_file_bytes: int = fixed.MAX_FILE_BYTES, respect_gitignore: bool = True, kinds: list[str] | None = None, exclude: str | None = None) -> DataFrame:
    """Documents (doc_id, text, source_path, language, content_hash, kind) of a folder."""
    files = with_reasons(read_files(spark, root, max_file_bytes, respect_gitignore, exclude), max_file_bytes, kinds)
    return documents(files.filter("skip_reason IS NULL"))


def load_files(spark: SparkSession, root: str, paths: list[str], max_file_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """Documents of the named files alone, without walking the folder; one that is gone has no row."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(FolderSource)
    files = spark.read.format("lakeseek_folder").option("maxFileBytes", max_file_bytes).option("only", json.dumps(paths)).load(root)
    return documents(with_reasons(files, max_file_bytes).filter("skip_reason IS NULL"))


def documents(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "text", F.col("doc_id").alias("source_path"), language(F.col("doc_id")).alias("language"), content_hash(F.col("text")).alias("content_hash"), "kind")


def skipped(spark: SparkSession, root: str, **options) -> DataFrame:
    """(skip_reason, n) of a folder's files."""
    kinds, limit = options.pop("kinds", None), options.get("max_file_bytes", fixed.MAX_FILE_BYTES)
    return with_reasons(read_files(spark, root, **options), limit, kinds).filter("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))
