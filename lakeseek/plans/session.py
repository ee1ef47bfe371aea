"""What a user calls: index a folder or a repository's versions, query, evaluate, list. Also the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions import fixed
from lakeseek.functions.vectors import HashingEncoder
from lakeseek.plans import index as plans
from lakeseek.plans import search as find
from lakeseek.plans import store
from lakeseek.sources import directory, repository


def default_root(path: str, base: str = "indexes") -> str:
    import hashlib

    full = os.path.abspath(path)
    return os.path.join(os.path.abspath(base), f"{os.path.basename(full)}-{hashlib.sha256(full.encode()).hexdigest()[:8]}")


def index_folder(spark: SparkSession, path: str, root: str | None = None, chunking: plans.Chunking | None = None, encoder=None, source_only: bool = False, rebuild: bool = False) -> dict:
    """Index a folder, or bring its index up to date; {manifest, stats, skipped}."""
    root, chunking, encoder = root or default_root(path), chunking or plans.Chunking(), encoder or HashingEncoder()
    kinds = ["code"] if source_only else None
    files = directory.with_reasons(directory.read_files(spark, path, exclude=root), kinds=kinds).cache()
    try:
        docs = directory.documents(files.filter("skip_reason IS NULL"))
        skipped = {r[0]: r[1] for r in files.filter("skip_reason IS NOT NULL").groupBy("skip_reason").count().collect()}
        source = {"kind": "directory", "root": os.path.abspath(path)}
        if rebuild or store.manifest_of(spark, root) is None:
            tables = plans.build(docs, chunking, encoder)
            stats = None
        else:
            _, old = store.load(spark, root, encoder.fingerprint(), chunking.config)
            tables, counted = plans.update(docs, old, chunking, encoder)
            stats = counted.first().asDict()
        return {"manifest": store.save(spark, root, tables, encoder.fingerprint(), chunking.config, source), "stats": stats, "skipped": skipped, "root": root}
    finally:
        files.unpersist()


def index_versions(spark: SparkSession, repo: str, revisions: list[str] | None = None, last: int | None = None, root: str | None = None, chunking: plans.Chunking | None = None, encoder=None, source_only: bool = False) -> dict:
    """Index several commits; those already indexed are left alone."""
    root, chunking, encoder = root or default_root(repo), chunking or plans.Chunking(), encoder or HashingEncoder()
    revisions = revisions or repository.last_commits(repo, last or 1)
    commits = repository.commits(spark, repo, revisions)
    existing = None
    if store.manifest_of(spark, root) is not None:
        manifest, existing = store.load(spark, root, encoder.fingerprint(), chunking.config)
        if manifest["source"].get("kind") != "git":
            raise store.IndexMismatch("the index holds no versions")
        known = {r[0] for r in existing["commits"].select("sha").collect()}
        if all(r[0] in known for r in commits.select("sha").collect()):
            return {"manifest": manifest, "stats": [], "note": "all commits are indexed already", "root": root}
        commits = commits.filter(~F.col("sha").isin(*known)) if known else commits
    shas = [r[0] for r in commits.orderBy("ordinal").select("sha").collect()]
    snaps = repository.snapshots(spark, repo, shas, ["code"] if source_only else None)
    tables, stats = plans.build_versions(snaps, commits, chunking, encoder, existing)
    rows = [r.asDict() for r in stats.orderBy("ordinal").collect()]
    source = {"kind": "git", "root": os.path.abspath(repo)}
    return {"manifest": store.save(spark, root, tables, encoder.fingerprint(), chunking.config, source), "stats": rows, "root": root}


class Session:
    """An opened index with its encoder; tables are read once and kept."""

    def __init__(self, spark: SparkSession, root: str, encoder=None):
        self.spark, self.root, self.encoder = spark, root, encoder or HashingEncoder()
        self.open()

    def open(self) -> None:
        self.manifest, self.tables = store.load(self.spark, self.root, self.encoder.fingerprint())
        self.tables = {k: v.cache() for k, v in self.tables.items()}

    def refresh(self) -> bool:
        """Open the newest generation if there is a newer one; if it can't be opened, the old one stays."""
        before = self.manifest, self.tables
        try:
            seen = store.manifest_of(self.spark, self.root)
            if seen is None or seen["generation"] == self.manifest["generation"]:
                return False
            self.open()
            return True
        except Exception:  # noqa: BLE001
            self.manifest, self.tables = before
            return False

    def queries(self, texts: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")
        return find.embed_queries(rows, self.encoder)

    def current(self, paths: list[str]) -> DataFrame:
        """The texts of ``paths`` as they are now: the folder's files, read alone, or the stored ones."""
        source = self.manifest["source"]
        if source.get("kind") == "directory" and os.path.isdir(source["root"]):
            return directory.load_files(self.spark, source["root"], paths)
        return self.tables["documents"].filter(F.col("doc_id").isin(paths))

    def query(self, text: str, top_k: int = 10, version: str | None = None, code_only: bool = False, kind_penalty: float = fixed.KIND_PENALTY) -> DataFrame:
        if not text.strip():
            raise ValueError("the query is empty")
        asked = self.queries([text])
        if self.manifest["source"].get("kind") == "git":
            return find.search_versions(asked, self.tables, top_k, None if version in (None, "all") else version, kind_penalty, code_only).orderBy("rank", "position")
        if version not in (None, "all"):
            raise ValueError("the index holds no versions")
        ranked = find.search(asked, self.tables, top_k, kind_penalty=kind_penalty, code_only=code_only)
        rows = ranked.collect()  # of one query: top_k at most
        found, paths = self.spark.createDataFrame(rows, ranked.schema), [r["doc_id"] for r in rows]
        indexed = self.tables["documents"].filter(F.col("doc_id").isin(paths))
        focused = self.manifest["source"].get("kind") != "dataset"
        return find.cited(found, asked.select("query_id", "text"), indexed, self.current(paths), focused).orderBy("rank")


def render(rows: list, lines: int = fixed.SNIPPET_LINES) -> str:
    """Result rows as text: rank, place, score, and a window of the snippet."""
    out = []
    for r in rows:
        note = f" (similarity {r['score']:.4f})" if abs(r["rank_score"] - r["score"]) > 1e-12 else ""
        out.append(f"{r['rank']}. {r['doc_id']}:{r['start_line']}-{r['end_line']} {r['rank_score']:.4f}{note}")
        if r["snippet"]["status"] != "ok":
            out.append(f"   [{r['snippet']['status']}]")
            continue
        text = r["snippet"]["text"].split("\n")
        text = text[:-1] if text and not text[-1] else text
        first = (r["focus_line"] or r["start_line"]) - r["start_line"]
        if first:
            out.append(f"   ... {first} lines above")
        out += [f"   {line}" for line in text[first : first + lines]]
        if len(text) > first + lines:
            out.append(f"   ... {len(text) - first - lines} more")
    return "\n".join(out)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("lakeseek")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("path")
    many = commands.add_parser("index-versions")
    many.add_argument("path")
    pick = many.add_mutually_exclusive_group(required=True)
    pick.add_argument("--commits", nargs="+")
    pick.add_argument("--last", type=int)
    for p in (one, many):
        p.add_argument("--out")
        p.add_argument("--source-only", action="store_true")
        p.add_argument("--no-header", action="store_true")
        p.add_argument("--chunking", choices=["none", "windows", "ast"], default="windows")
    one.add_argument("--rebuild", action="store_true")
    ask = commands.add_parser("query")
    ask.add_argument("text", nargs="?")
    ask.add_argument("--index", required=True)
    ask.add_argument("--top-k", type=int, default=10)
    ask.add_argument("--json", action="store_true")
    ask.add_argument("--version")
    kind = ask.add_mutually_exclusive_group()
    kind.add_argument("--code-only", action="store_true")
    kind.add_argument("--kind-penalty", type=float, default=fixed.KIND_PENALTY)
    ask.add_argument("--interactive", action="store_true")
    score = commands.add_parser("eval")
    score.add_argument("--index", required=True)
    score.add_argument("--queries", required=True)
    score.add_argument("--qrels", required=True)
    score.add_argument("--limit", type=int)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("lakeseek").getOrCreate()
    try:
        if a.command == "index":
            done = index_folder(spark, a.path, a.out, plans.Chunking(a.chunking, header=not a.no_header), source_only=a.source_only, rebuild=a.rebuild)
            print(json.dumps({"index": done["root"], "stats": done["stats"], "skipped": done["skipped"], "tables": done["manifest"]["tables"]}))
        elif a.command == "index-versions":
            done = index_versions(spark, a.path, a.commits, a.last, a.out, plans.Chunking(a.chunking, header=not a.no_header), source_only=a.source_only)
            print(json.dumps({"index": done["root"], "stats": done["stats"], "note": done.get("note")}))
        elif a.command == "query":
            session = Session(spark, a.index)

            def show(text: str) -> None:
                rows = session.query(text, a.top_k, a.version, a.code_only, a.kind_penalty)
                if a.json or "snippet" not in rows.columns:
                    print("\n".join(r[0] for r in find.as_json(rows).collect()))
                else:
                    print(render(rows.collect()))

            if a.text:
                show(a.text)
            if a.interactive or not a.text:
                _interactive(session, show, a)
        else:
            from lakeseek.sources.datasets import first_queries

            session = Session(spark, a.index)
            queries = spark.read.parquet(a.queries)
            queries = first_queries(queries, a.limit) if a.limit is not None else queries
            means, _ = find.evaluate_index(find.embed_queries(queries, session.encoder), spark.read.parquet(a.qrels), session.tables)
            print(means.toJSON().first())
    except (ValueError, FileNotFoundError, NotADirectoryError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


USAGE = ":paste (lines up to a single . are one query)  :k N  :json  :reload  :help  :q"


def _interactive(session: Session, show, a) -> None:
    """Lines are queries; those that start with a colon are commands. What a line gets wrong is told, and the session goes on."""

    def answer(text: str) -> None:
        if not text.strip():
            print("nothing to search for")
            return
        session.refresh()
        try:
            show(text)
        except ValueError as error:
            print(f"error: {error}")

    def top_k(value: str) -> None:
        if value.isdecimal() and int(value) > 0:
            a.top_k = int(value)
            print(f"{a.top_k} results")
        else:
            print("usage: :k N, N a whole number from 1")

    def as_json(_: str) -> None:
        a.json = not a.json
        print(f"JSON {'on' if a.json else 'off'}")

    commands = {
        ":help": lambda _: print(USAGE), ":h": lambda _: print(USAGE), ":json": as_json, ":reload": lambda _: print("reloaded" if session.refresh() else "unchanged"), ":k": top_k,
        ":paste": lambda _: answer(_paste(sys.stdin)),
    }
    for line in sys.stdin:
        line = line.strip()
        name, _, rest = line.partition(" ")
        if name in (":q", ":quit", ":exit"):
            return
        if name in commands:
            commands[name](rest.strip())
        elif line.startswith(":"):
            print(f"unknown command {name}; {USAGE}")
        elif line:
            answer(line)


def _paste(lines) -> str:
    """What stands before a line of a single dot."""
    held = []
    for line in lines:
        if line.rstrip("\r\n") == ".":
            break
        held.append(line)
    return "".join(held)


if __name__ == "__main__":
    sys.exit(main())
