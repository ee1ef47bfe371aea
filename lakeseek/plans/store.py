"""An index on disk: Parquet tables of one generation, and a manifest that commits it.

A save writes gen=NNNNNN/<table> and then swaps the manifest in by one atomic rename; readers see the old generation or the new
one, whole. One writer at a time. Works on any store Spark writes to. Every table's row count and order-free hash stand in the manifest and are
verified on load.

A generation may be a delta: the rows of the documents that changed, and the ids of all that were touched. The manifest then lists its parts, the
base first; of a document only the rows in the last part that touched it count. Folders of the manifest before stay until the next commit, for readers that
opened it.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
MANIFEST = "manifest.json"
#: More deltas than these are merged: into one, or with the base if they hold this share of the documents or more.
MAX_DELTAS = 16
REBASE_SHARE = 0.25


class IndexMismatch(ValueError):
    """An index was made with another encoder or chunking."""


class IndexCorrupt(ValueError):
    """An index's files don't agree with its manifest."""


class _Files:
    """The few file operations the commit needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def fs(self):
        return self.path().getFileSystem(self.conf)

    def exists(self, *parts: str) -> bool:
        return self.fs().exists(self.path(*parts))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs().listStatus(self.path())] if self.exists() else []

    def read(self, name: str) -> str:
        """Raises ValueError if the file can't be read."""
        from py4j.protocol import Py4JJavaError

        stream = self.fs().open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        except Py4JJavaError as error:
            raise ValueError(f"{name} can't be read: {error.java_exception.getMessage()}") from error
        finally:
            stream.close()

    def swap_in(self, name: str, text: str) -> None:
        stream = self.fs().create(self.path(f".{name}.new"), True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf) if "://" in self.root else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        context.rename(self.path(f".{name}.new"), self.path(name), options)

    def delete(self, *parts: str) -> None:
        self.fs().delete(self.path(*parts), True)


def digest(df: DataFrame) -> dict:
    """Rows and an order-free hash of a table."""
    n, h = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
    return {"rows": n, "hash": str(h or 0)}


def manifest_of(spark: SparkSession, root: str) -> dict | None:
    files = _Files(spark, root)
    return json.loads(files.read(MANIFEST)) if files.exists(MANIFEST) else None


def next_generation(spark: SparkSession, root: str) -> int:
    """One more than the manifest's, or than any left over if the manifest can't be read."""
    try:
        known = manifest_of(spark, root)
        now = known["generation"] if known else 0
    except (ValueError, KeyError):
        now = 0
    left = [int(n.removeprefix("gen=")) for n in _Files(spark, root).names() if n.startswith("gen=") and n[4:].isdigit()]
    return max([now, *left]) + 1


def validate(documents: DataFrame, chunks: DataFrame, dim: int | None = None) -> None:
    """Raises IndexCorrupt for chunks without a document, documents whose chunk list differs, repeated ids, or vectors of another length."""
    orphans = chunks.join(documents.select("doc_id"), "doc_id", "left_anti")
    listed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("own"))
    unlike = documents.join(listed, "doc_id", "left").filter(~F.transform(F.coalesce("own", F.array().cast("array<struct<ordinal:int,chunk_id:string>>")), lambda x: x["chunk_id"]).eqNullSafe(F.col("chunk_ids")))
    repeated = documents.groupBy("doc_id").count().filter("count > 1")
    wrong = chunks.filter((F.size("embedding") != dim) | F.col("embedding").isNull()) if dim is not None else chunks.limit(0)
    found = [name for name, df in (("orphan chunks", orphans), ("chunk lists", unlike), ("repeated ids", repeated), ("vectors", wrong)) if not df.isEmpty()]
    if found:
        raise IndexCorrupt(f"the index is not sound: {', '.join(found)}")


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], fingerprint: dict, chunking: dict, source: dict, check: bool = True) -> dict:
    files = _Files(spark, root)
    generation = next_generation(spark, root)
    folder = f"gen={generation:06d}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{files.root}/{folder}/{name}")
    written = {name: spark.read.parquet(f"{files.root}/{folder}/{name}") for name in tables}
    if check:
        validate(written["documents"], written["chunks"], int(fingerprint["dim"]) if "dim" in fingerprint else None)
    manifest = {
        "format": FORMAT, "generation": generation, "saved_at": _now(), "fingerprint": fingerprint, "chunking": chunking, "source": source,
        "tables": {name: digest(df) for name, df in written.items()},
    }
    _commit(files, manifest)
    return manifest


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def _parts(manifest: dict) -> list[dict]:
    return manifest.get("parts") or [{"folder": f"gen={manifest['generation']:06d}", "tables": manifest["tables"]}]


def _commit(files: _Files, manifest: dict) -> None:
    """Swap the manifest in; then delete what neither it nor the one before names."""
    try:
        before = json.loads(files.read(MANIFEST)) if files.exists(MANIFEST) else None
        named = {p["folder"] for m in (manifest, before) if m for p in _parts(m)}
    except (ValueError, KeyError):
        named = {p["folder"] for p in _parts(manifest)}
    files.swap_in(MANIFEST, json.dumps(manifest, sort_keys=True, indent=1))
    for name in files.names():
        if name.startswith("gen=") and name not in named:
            files.delete(name)


def _merged(spark: SparkSession, root: str, parts: list[dict], name: str) -> DataFrame:
    """A table of all ``parts``: of each document the rows in the last part that touched it."""
    read = lambda part, table: spark.read.parquet(f"{root.rstrip('/')}/{part['folder']}/{table}")
    tables = [read(p, name) for p in parts]
    if name == "touched":
        return reduce(DataFrame.unionByName, tables).distinct()
    if len(parts) == 1:
        return tables[0]
    touched = [read(p, "touched").withColumn("__newest", F.lit(k)) for k, p in enumerate(parts) if "touched" in p["tables"]]
    newest = reduce(DataFrame.unionByName, touched).groupBy("doc_id").agg(F.max("__newest").alias("__newest"))
    rows = reduce(DataFrame.unionByName, [t.withColumn("__part", F.lit(k)) for k, t in enumerate(tables)])
    return rows.join(newest, "doc_id", "left").filter("__newest IS NULL OR __part = __newest").select(*tables[0].columns)


def save_delta(spark: SparkSession, root: str, manifest: dict, touched: DataFrame, chunks: DataFrame, documents, gone: dict[str, int]) -> dict:
    """Commit what changed since ``manifest`` as a generation of its own; only these rows are written, checked and hashed.

    touched (doc_id) are the documents added, changed and deleted, chunks and documents(written chunks) the rows of those added and changed, gone the rows of
    each table that no longer count.
    """
    files = _Files(spark, root)
    generation = next_generation(spark, root)
    folder = f"gen={generation:06d}"
    read = lambda name: spark.read.parquet(f"{files.root}/{folder}/{name}")
    touched.select("doc_id").write.mode("overwrite").parquet(f"{files.root}/{folder}/touched")
    chunks.write.mode("overwrite").parquet(f"{files.root}/{folder}/chunks")
    documents(read("chunks")).write.mode("overwrite").parquet(f"{files.root}/{folder}/documents")
    validate(read("documents"), read("chunks"), int(manifest["fingerprint"]["dim"]) if "dim" in manifest["fingerprint"] else None)
    own = {name: digest(read(name)) for name in ("touched", "documents", "chunks")}
    totals = {name: {"rows": t["rows"] + own[name]["rows"] - gone[name]} for name, t in manifest["tables"].items()}
    out = {**manifest, "generation": generation, "saved_at": _now(), "tables": totals, "parts": [*_parts(manifest), {"folder": folder, "tables": own}]}
    _commit(files, out)
    return compact(spark, root, out) if len(out["parts"]) > MAX_DELTAS + 1 else out


def compact(spark: SparkSession, root: str, manifest: dict) -> dict:
    """Merge the deltas into one, or with the base if they are no longer small beside it; the index holds the same rows."""
    base, *deltas = _parts(manifest)
    if sum(p["tables"]["touched"]["rows"] for p in deltas) >= REBASE_SHARE * manifest["tables"]["documents"]["rows"]:
        tables = {name: _merged(spark, root, [base, *deltas], name) for name in base["tables"]}
        return save(spark, root, tables, manifest["fingerprint"], manifest["chunking"], manifest["source"])
    files = _Files(spark, root)
    generation = next_generation(spark, root)
    folder, own = f"gen={generation:06d}", {}
    for name in ("touched", "documents", "chunks"):
        _merged(spark, root, deltas, name).write.mode("overwrite").parquet(f"{files.root}/{folder}/{name}")
        own[name] = digest(spark.read.parquet(f"{files.root}/{folder}/{name}"))
    out = {**manifest, "generation": generation, "saved_at": _now(), "parts": [base, {"folder": folder, "tables": own}]}
    _commit(files, out)
    return out


def check_compatible(manifest: dict, fingerprint: dict | None, chunking: dict | None) -> None:
    for what, want in (("fingerprint", fingerprint), ("chunking", chunking)):
        have = manifest[what]
        if want is not None and have != want:
            keys = sorted(k for k in {*have, *want} if have.get(k) != want.get(k))
            raise IndexMismatch(f"the index's {what} differs in: {', '.join(keys)}; rebuild it")


def load(spark: SparkSession, root: str, fingerprint: dict | None = None, chunking: dict | None = None, verify: bool = True) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables) of the committed generation."""
    manifest = manifest_of(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"no index in {root}")
    if manifest.get("format") != FORMAT:
        raise IndexCorrupt(f"format {manifest.get('format')} is not {FORMAT}")
    check_compatible(manifest, fingerprint, chunking)
    parts = _parts(manifest)
    if verify:
        for part in parts:
            for name, known in part["tables"].items():
                if digest(spark.read.parquet(f"{root.rstrip('/')}/{part['folder']}/{name}")) != known:
                    raise IndexCorrupt(f"table {name} is not what the manifest says")
    return manifest, {name: _merged(spark, root, parts, name) for name in manifest["tables"]}


def describe(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, kind, documents, chunks, chunking, header, dim, saved_at, generation, versions, reindexable) of every index in ``roots``."""
    rows = []
    for root in roots:
        m = manifest_of(spark, root)
        if m is None:
            continue
        rows.append((
            root, m["source"].get("kind"), m["tables"]["documents"]["rows"], m["tables"]["chunks"]["rows"], m["chunking"]["name"], bool(m["chunking"].get("header")), int(m["fingerprint"].get("dim", 0)),
            m["saved_at"], m["generation"], m["tables"].get("commits", {}).get("rows", 0), m["source"].get("kind") in ("directory", "git"),
        ))
    return spark.createDataFrame(
        rows, "root string, kind string, documents bigint, chunks bigint, chunking string, header boolean, dim int, saved_at string, generation int, versions bigint, reindexable boolean"
    )
