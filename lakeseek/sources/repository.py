"""Commits of a git repository as snapshot rows. The git binary runs on the driver; the working tree is never touched."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions.text import language
from lakeseek.sources.directory import with_reasons

COMMITS = "sha string, short string, date string, subject string, tags array<string>"


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def commit_info(repo: str, revision: str) -> tuple:
    sha, date, subject = git(repo, "log", "-1", "--format=%H%x00%cI%x00%s", revision, "--").decode().rstrip("\n").split("\0")
    tags = sorted(t for t in git(repo, "tag", "--points-at", sha).decode().split("\n") if t)
    return sha, sha[:7], date, subject, tags


def last_commits(repo: str, n: int) -> list[str]:
    """The last n commits of the first-parent history, oldest first."""
    return git(repo, "rev-list", "--first-parent", f"--max-count={n}", "HEAD").decode().split()[::-1]


def commits(spark: SparkSession, repo: str, revisions: list[str]) -> DataFrame:
    """``revisions``' commits, each once, ordered by date and sha (ordinal from 1)."""
    rows = sorted({r[0]: r for r in (commit_info(repo, x) for x in revisions)}.values(), key=lambda r: (r[2], r[0]))
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows, 1)], COMMITS + ", ordinal int")


def snapshots(spark: SparkSession, repo: str, shas: list[str], kinds: list[str] | None = None) -> DataFrame:
    """(sha, doc_id, path, text, language, content_hash, kind) of every document in every commit.

    Trees are listed on the driver; blobs, each once, are read by tasks of one git process each.
    """
    rows = []
    for sha in shas:
        for entry in git(repo, "ls-tree", "-r", "-z", "-l", "--full-tree", sha).split(b"\0"):
            if not entry:
                continue
            meta, _, path = entry.partition(b"\t")
            mode, kind, blob, size = meta.split()
            if kind == b"blob":
                rows.append((sha, path.decode(errors="replace"), blob.decode(), int(size), mode == b"120000"))
    from lakeseek.functions import fixed

    keep = [r for r in rows if not set(r[1].split("/")[:-1]) & set(fixed.SKIP_DIRS)]
    tree = spark.createDataFrame(keep, "sha string, doc_id string, blob string, size bigint, link boolean")
    wanted = tree.filter(~F.col("link") & (F.col("size") <= fixed.MAX_FILE_BYTES)).groupBy("blob").agg(F.min("sha").alias("sha"), F.min("doc_id").alias("doc_id"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            names, blobs = [], []
            for sha, path, blob in zip(*(batch.column(c).to_pylist() for c in ("sha", "doc_id", "blob"))):
                names.append(blob)
                done = subprocess.run(["git", "-C", repo, "cat-file", "--filters", f"{sha}:{path}"], capture_output=True)
                blobs.append(done.stdout if done.returncode == 0 else None)
            yield pa.record_batch({"blob": pa.array(names, pa.string()), "content": pa.array(blobs, pa.binary())})

    contents = wanted.mapInArrow(read, "blob string, content binary")
    files = tree.join(contents, "blob", "left").withColumn("ignored", F.lit(False))
    docs = with_reasons(files, kinds=kinds).filter("skip_reason IS NULL")
    return docs.select("sha", "doc_id", F.col("doc_id").alias("path"), "text", language(F.col("doc_id")).alias("language"), F.sha2("text", 256).alias("content_hash"), "kind")
