"""The engine on hand-made inputs: sources, chunks, index life cycle, search, versions, snippets, metrics."""

import json
import os
import random
import subprocess
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeseek.functions import text as tx
from lakeseek.functions.vectors import HashingEncoder
from lakeseek.operators import chunking, metrics, ranking, scoring, snippets
from lakeseek.plans import index as plans
from lakeseek.plans import session, store
from lakeseek.plans import search as find
from lakeseek.sources import datasets, directory, repository

TEN = [f"def f{i}(x):\n    return x + {i}\n" for i in range(60)]


def put(root, files):
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content.encode() if isinstance(content, str) else content)


# -- sources


def test_folder_reasons(spark, tmp_path):
    put(tmp_path, {
        "keep.py": "x = 1\n", "pkg/__init__.py": "y = 2\n", ".git/config": "a", "node_modules/a.js": "a", "sub/__pycache__/b.py": "b", "image.png": b"\x89PNG\x00\x00", "latin.txt": b"caf\xe9",
        "big.txt": "a b\n" * 3000, "blank.txt": " \n\t\n", "lib.min.js": "var a;", "bundle.js": "x" * 2400 + "\n" + "y" * 800, "bom.py": b"\xef\xbb\xbfz = 3\n",
    })
    files = directory.with_reasons(directory.read_files(spark, str(tmp_path), 10_000), 10_000)
    reasons = {r.doc_id: r.skip_reason for r in files.select("doc_id", "skip_reason").collect()}
    assert reasons == {
        "keep.py": None, "pkg/__init__.py": None, "image.png": "binary", "latin.txt": "not_utf8", "big.txt": "too_large", "blank.txt": "empty", "lib.min.js": "minified",
        "bundle.js": "minified", "bom.py": None,
    }
    docs = {r.doc_id: r for r in directory.load_folder(spark, str(tmp_path)).collect()}
    assert docs["bom.py"].text == "z = 3\n" and docs["bom.py"].language == "python"
    with pytest.raises(NotADirectoryError):
        directory.read_files(spark, str(tmp_path / "none"))


def test_ignore_files(spark, tmp_path):
    put(tmp_path, {
        ".gitignore": "*.log\nsecret/\ngenerated_*.py\n/top.txt\n# note\n", "a.log": "a", "secret/x.py": "x", "secret/.gitignore": "!x.py\n", "generated_a.py": "g", "top.txt": "t", "in/top.txt": "t",
        "in/.gitignore": "!keep.log\nlocal.py\n", "in/keep.log": "k", "in/other.log": "o", "in/local.py": "l", "deep/in/local.py": "l",
    })
    rows = {r.doc_id: r.skip_reason for r in directory.with_reasons(directory.read_files(spark, str(tmp_path))).collect()}
    assert {k for k, v in rows.items() if v is None} == {".gitignore", "in/.gitignore", "in/top.txt", "in/keep.log", "deep/in/local.py"}
    assert rows["a.log"] == rows["generated_a.py"] == rows["in/local.py"] == rows["in/other.log"] == "gitignored" and "secret/x.py" not in rows


def test_zip(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/a.py", "a")
        z.writestr("top/b/c.py", "c")
    datasets.unpack_zip(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.py", "b"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.py", "a")
    with pytest.raises(ValueError):
        datasets.unpack_zip(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_span_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"q": "how", "correct": [["a.py", 1, 9], ["b.py", 2, 3]], "related": ["c.py"]}]))
    rows = datasets.span_questions(spark, f"file://{tmp_path}/q.json").collect()
    assert [(r.path, r.first_line, r.last_line) for r in rows] == [("a.py", 1, 9), ("b.py", 2, 3)]


# -- text


@pytest.mark.parametrize("text, lines", [("", []), ("a", ["a"]), ("a\nb", ["a\n", "b"]), ("a\r\n\r\nb\n", ["a\r\n", "\r\n", "b\n"]), ("a\x0cb\u2028c\n\n", ["a\x0cb\u2028c\n", "\n"])])
def test_split_lines(spark, text, lines):
    assert spark.range(1).select(tx.split_lines(F.lit(text))).first()[0] == lines == chunking.lines_of(text)


def test_file_kinds(spark):
    want = {
        "src/a.py": "code", "tests/a.py": "test", "a/test_b.py": "test", "a/conftest.py": "test", "b_test.go": "test", "x.spec.ts": "test", "tests_e2e/x.py": "test", "docs/conf.py": "docs", "README": "docs",
        "a/b.md": "docs", "LICENSE.txt": "docs", "contest/a.py": "code", "testing/a": "test", "latest.py": "code", "doc.py": "code",
    }
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", tx.file_kind(F.col("p"))).collect()
    assert {r[0]: r[1] for r in got} == want


def test_terms(spark):
    text = "resolve_redirects maxRetries HTTPServer the implementation x1 2024 Über"
    got = spark.range(1).select(tx.terms(F.lit(text))).first()[0]
    assert got == list(dict.fromkeys(tx.python_terms(text))) == ["resol", "redir", "max", "retri", "http", "serve", "2024", "ber"]


# -- chunks


def windows_of(text, length=62, overlap=20, header=False, name="windows", path="a.py"):
    t = chunking.WordTokenizer()
    lines = chunking.lines_of(text)
    if name == "ast":
        return chunking.syntax_ranges(path, text, lines, t, length, header, overlap)
    return chunking.window_ranges(path, lines, t, length, overlap, header)


@pytest.mark.parametrize("text", ["".join(TEN), "".join(f"line {i}\r\n" for i in range(100)), "a\n" * 5 + "1 " * 400 + "\n" + "b\n" * 5, "x\ny", "class A:\n" + "".join("    " + x.replace("\n", "\n    ").rstrip(" ") for x in TEN)])
@pytest.mark.parametrize("name", ["windows", "ast"])
def test_ranges_cover(text, name):
    ranges, lines = windows_of(text, name=name), chunking.lines_of(text)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(lines)
    for (a, b), (c, d) in zip(ranges, ranges[1:]):
        assert a < c <= b < d
    t = chunking.WordTokenizer()
    assert all(b - a == 1 or len(t.offsets("".join(lines[a:b]))) <= 60 for a, b in ranges)


def test_long_line_alone():
    assert (5, 6) in windows_of("a\n" * 5 + "1 " * 400 + "\n" + "b\n" * 5)
    assert windows_of("") == []
    with pytest.raises(ValueError):
        windows_of("a", 62, 60)


def test_syntax_chunks():
    methods = "".join(f"    @deco\n    def m{i}(self):\n" + "        y = 1\n" * 15 for i in range(12))
    text = "import os\n# about A\nclass A:\n    size = 1\n" + methods + "def g():\n" + "    z = 2\n" * 300
    ranges = windows_of(text, 202, name="ast")
    lines = chunking.lines_of(text)
    starts = [lines[a].strip() for a, _ in ranges]
    assert "@deco" in starts and sum(s == "@deco" for s in starts) >= 3
    assert windows_of(text, 202, 128, path="a.md", name="ast") == windows_of(text, 202, 128)
    assert windows_of("def (:\n", 202, 128, name="ast") == [(0, 1)]


def function(name, steps, indent="", above=""):
    """A function of about ten tokens a step and two blank lines after it."""
    body = "".join(f"{indent}    x = x * {i} + {i + 1}  # step {i} of {name}\n" for i in range(steps))
    return f"{above}{indent}def {name}(x):\n{body}{indent}    return x\n\n\n"


def pieces(text, length=1024, **options):
    lines = chunking.lines_of(text)
    return ["".join(lines[a:b]) for a, b in windows_of(text, length, 128, name="ast", **options)]


def test_units_run_to_the_next_one():
    """Blank lines belong to the definition before them: no chunk is blank, and chunks put together are the text."""
    size = lambda s: len(chunking.WordTokenizer().offsets(s))
    text = '"""About."""\nimport os\n\n\n' + "".join(function(f"f{i}", 3) for i in range(30))
    got = pieces(text)
    assert "".join(got) == text and 1 < len(got) < 30
    assert all(p.startswith("def ") for p in got[1:]) and all(200 <= size(p) <= 500 for p in got[:-1])
    two = function("a", 15) + function("b", 29)
    assert pieces(two) == [function("a", 15), function("b", 29)]
    assert all(p.strip() for n in range(2, 80, 7) for p in pieces(function("a", n) + function("b", 80 - n)))


def test_methods_keep_comments_and_decorators():
    methods = "".join(function(f"m{i}", 11, "    ", f"    # about m{i}\n    @staticmethod\n") for i in range(12))
    got = pieces("import os\n\n\nclass Big:\n    'Doc.'\n    LIMIT = 3\n\n" + methods)
    assert len(got) > 2 and all(p.startswith("    # about m") for p in got[1:])
    assert got[0].startswith("import os\n") and "LIMIT = 3" in got[0] and "".join(got).endswith(methods)


def test_long_function_overlaps():
    text = "import os\n\n\n" + function("huge", 300)
    ranges = windows_of(text, 1024, 128, name="ast")
    assert len(ranges) > 3 and any(c < b for (_, b), (c, _) in zip(ranges, ranges[1:]))


def test_headers(spark):
    text = "class A:\n    def b(self):\n        pass\n\ndef c():\n    pass\n"
    assert chunking.definitions(text) == [(1, 3, "A"), (2, 3, "A.b"), (5, 6, "c")]
    head = chunking.context_header("pkg/a.py", chunking.definitions(text), 2, 5, chunking.WordTokenizer())
    assert head == "# pkg/a.py\n# A, A.b, c\n"
    long = chunking.context_header("/".join("abcdefghij") * 9 + "/z.py", [], 1, 1, chunking.WordTokenizer())
    assert long == "# .../z.py\n"
    docs = spark.createDataFrame([("pkg/a.py", text), ("e.py", "")], "doc_id string, text string")
    rows = chunking.chunk(docs, "windows", chunking.WordTokenizer(), 200, 20, True).collect()
    assert [(r.chunk_id, r.header) for r in rows] == [("pkg/a.py#L1-L6", "# pkg/a.py\n# A, A.b, c\n")] and rows[0].text == text
    for bad in (("nope", None), ("windows", None)):
        with pytest.raises(ValueError):
            chunking.chunk(docs, *bad)


# -- search


def grouping(spark):
    rows = [("a", "a1", 0, 0.9), ("b", "b1", 0, 0.5), ("a2", "x", 0, 0.0), ("b", "b2", 1, 0.7), ("c", "c1", 0, 0.3), ("b", "b3", 2, 0.6)]
    rows = [r for r in rows if r[0] != "a2"]
    data = [(d, c, o, [s, float(np.sqrt(1 - s * s)), 0.0, 0.0]) for d, c, o, s in rows]
    chunks = spark.createDataFrame(data, "doc_id string, chunk_id string, ordinal int, embedding array<double>")
    return spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0])], "query_id string, embedding array<double>"), chunks


@pytest.mark.parametrize("agg, want", [("max", [("a", 0.9), ("b", 0.7), ("c", 0.3)]), ("mean", [("a", 0.9), ("b", 0.6), ("c", 0.3)]), ("sum", [("b", 1.8), ("a", 0.9), ("c", 0.3)])])
def test_aggregates(spark, agg, want):
    q, chunks = grouping(spark)
    for run in (scoring.document_scores(scoring.score(q, chunks), agg), scoring.score_blocks(q, chunks, agg)):
        rows = ranking.top_k(run, 10).orderBy("rank").collect()
        assert [(r.doc_id, round(r.score, 9)) for r in rows] == want
    assert ranking.top_k(run, 0).count() == 0
    with pytest.raises(ValueError):
        scoring.check_aggregate("median")


def test_best_chunks_and_penalty(spark):
    q, chunks = grouping(spark)
    best = ranking.best_chunks(scoring.score(q, chunks), 3).filter("doc_id = 'b'").orderBy("chunk_rank").collect()
    assert [r.chunk_id for r in best] == ["b2", "b3", "b1"]
    with pytest.raises(ValueError):
        scoring.rank_score(F.col("s"), F.col("k"), -0.1)


def test_blocks_equal_expressions(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    chunks = spark.createDataFrame([(f"d{i % 40}", f"c{i}", i, v[i].tolist()) for i in range(300)], "doc_id string, chunk_id string, ordinal int, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", v[i].tolist()) for i in range(30)], "query_id string, embedding array<double>")
    for agg in ("max", "mean", "sum"):
        one = {(r.query_id, r.doc_id): (r.rank, round(r.score, 9)) for r in ranking.top_k(scoring.document_scores(scoring.score(q, chunks), agg), 7).collect()}
        two = {(r.query_id, r.doc_id): (r.rank, round(r.score, 9)) for r in ranking.top_k(scoring.score_blocks(q, chunks, agg, 7 if agg == "max" else None), 7).collect()}
        assert one == two


# -- metrics


def plain_metrics(run, labels, k):
    out = {}
    for q, docs in run.items():
        order = sorted(docs, key=lambda d: (docs[d], d), reverse=True)[:k]
        rel = labels.get(q, {})
        gains = [max(rel.get(d, 0), 0) for d in order]
        ideal = sorted((g for g in rel.values() if g > 0), reverse=True)[:k]
        dcg, idcg = (sum(g / np.log2(i + 2) for i, g in enumerate(x)) for x in (gains, ideal))
        first = next((i + 1 for i, g in enumerate(gains) if g > 0), None)
        out[q] = (dcg / idcg if idcg else 0.0, 1 / first if first else 0.0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_metrics_random(spark, seed):
    rng = random.Random(seed)
    docs = [f"d{i}" for i in range(40)]
    run = {f"q{i}": {d: rng.choice([0, 0.2, 0.4, 0.6, 0.8, 1.0]) for d in rng.sample(docs, 25)} for i in range(30)}
    labels = {q: {d: rng.randint(0, 3) for d in rng.sample(docs, 8)} for q in run}
    r = spark.createDataFrame([(q, d, float(s)) for q, x in run.items() for d, s in x.items()], "query_id string, doc_id string, score double")
    l = spark.createDataFrame([(q, d, g) for q, x in labels.items() for d, g in x.items()], "query_id string, doc_id string, relevance int")
    got = {x.query_id: (x.ndcg, x.mrr) for x in metrics.per_query(r, l, 10).collect()}
    want = plain_metrics(run, labels, 10)
    assert got.keys() == want.keys() and all(np.allclose(got[q], want[q]) for q in want)


def test_ties_and_unknown_query(spark):
    run = spark.createDataFrame([("q", d, s) for d, s in (("d1", 0.5), ("d9", 0.5), ("d5", 0.7), ("d10", 0.1), ("d9x", 0.1))], "query_id string, doc_id string, score double")
    assert [r.doc_id for r in ranking.ranked(run).orderBy("rank").collect()] == ["d5", "d9", "d1", "d9x", "d10"]
    with pytest.raises(Exception, match="no labels"):
        metrics.evaluate(run, spark.createDataFrame([("p", "d1", 1)], "query_id string, doc_id string, relevance int")).collect()


# -- snippets


def test_focus(spark):
    lines = [f"filler {i}" for i in range(44)]
    lines[20], lines[21], lines[25] = "@cached", "def resolve_redirects(self):", "    return redirects"
    other = [f"filler {i}" for i in range(44)]
    other[30] = "    maxRetries = 4"
    rows = [(1, "\n".join(lines), "where are redirects resolved"), (2, "\n".join(other), "retries"), (3, "\n".join(lines), "what is the"), (4, "\n".join(other[:32] + other[31:] + ["zebra end"]), "zebra"), (5, "a\nb", "a")]
    got = {r.id: r.focus for r in snippets.focus(spark.createDataFrame(rows, "id int, text string, query string"), "query", "id").collect()}
    assert got == {1: 20, 2: 30, 3: 0, 4: 46 - 12, 5: 0}


# -- index life cycle


def small_repo():
    files = {f"m{i}.py": "".join(x.replace("f", f"g{i}_") for x in TEN[:40]) for i in range(4)}
    return files | {"README.md": "# hello\nwords\n"}


def vectors_of(tables):
    return {r.chunk_id: tuple(round(x, 9) for x in r.embedding) for r in tables["chunks"].collect()}


def test_life_cycle(spark, tmp_path):
    repo, root = str(tmp_path / "repo"), str(tmp_path / "index")
    put(repo, small_repo())
    chunks, encoder = plans.Chunking(max_length=200, overlap=20), HashingEncoder(32)
    first = session.index_folder(spark, repo, root, chunks, encoder)
    assert first["manifest"]["generation"] == 1 and first["manifest"]["tables"]["documents"]["rows"] == 5
    put(repo, {"m1.py": "def changed():\n    pass\n", "new.py": "def fresh():\n    pass\n"})
    os.remove(os.path.join(repo, "m2.py"))
    s = session.Session(spark, root, encoder)
    stale = {r.doc_id: r.snippet.status for r in s.query("g1_ g2_", 10).collect()}
    assert stale["m1.py"] == "stale" and stale["m2.py"] == "missing" and stale["README.md"] == "ok"
    second = session.index_folder(spark, repo, root, chunks, encoder)
    assert second["stats"] == {"added": 1, "changed": 1, "deleted": 1, "unchanged": 3, "chunks_embedded": 2}
    assert s.refresh() and not s.refresh()
    updated = vectors_of(store.load(spark, root)[1])
    rebuilt = session.index_folder(spark, repo, str(tmp_path / "again"), chunks, encoder)
    assert updated == vectors_of(store.load(spark, rebuilt["root"])[1])
    top = s.query("changed", 3).collect()
    assert top[0].doc_id == "m1.py" and top[0].snippet.status == "ok" and "def changed" in session.render(top)
    assert json.loads(find.as_json(s.query("changed", 1)).first()[0])["doc_id"] == "m1.py"
    with pytest.raises(store.IndexMismatch):
        store.load(spark, root, HashingEncoder(16).fingerprint())
    with pytest.raises(store.IndexMismatch):
        session.index_folder(spark, repo, root, plans.Chunking("ast", 200), encoder)
    listed = store.describe(spark, [root, str(tmp_path / "none")]).collect()
    assert [(r.documents, r.generation, r.kind) for r in listed] == [(5, 2, "directory")]


def test_corruption_and_crash(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y", "h1"), ("b", "z", "h2")], "doc_id string, text string, content_hash string")
    chunks, encoder, root = plans.Chunking("none"), HashingEncoder(8), str(tmp_path / "i")
    tables = plans.build(docs, chunks, encoder)
    store.save(spark, root, tables, encoder.fingerprint(), chunks.config, {"kind": "directory"})
    os.makedirs(f"{root}/gen=000007")  # a writer that died
    assert store.load(spark, root)[0]["generation"] == 1 and store.next_generation(spark, root) == 8
    tables["chunks"].limit(1).write.mode("overwrite").parquet(f"{root}/gen=000001/chunks")
    with pytest.raises(store.IndexCorrupt):
        store.load(spark, root)
    with pytest.raises(store.IndexCorrupt):
        store.validate(tables["documents"], tables["chunks"].filter("doc_id = 'a'"))
    with pytest.raises(ValueError, match="unique"):
        plans.build(docs.unionByName(docs), chunks, encoder)
    with open(f"{root}/manifest.json", "w") as f:
        f.write("{")
    assert store.next_generation(spark, root) == 8


def git(repo, *args):
    subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


def test_versions(spark, tmp_path):
    repo, root = str(tmp_path / "repo"), str(tmp_path / "index")
    os.makedirs(repo)
    git(repo, "init", "-q")
    a, b = "def alpha():\n    return 1\n", "def beta():\n    return 2\n"
    for k, files in enumerate([{"a.py": a, "b.py": b, "tests/test_a.py": "import a\n"}, {"b.py": "def gamma():\n    return 3\n", "c.py": "def delta():\n    pass\n"}, {"a.py": a + "def omega():\n    pass\n"}], 1):
        put(repo, files)
        git(repo, "add", "-A")
        subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", f"c{k}"], check=True, env=os.environ | {"GIT_COMMITTER_DATE": f"2024-01-0{k}T00:00:00+00:00"})
        git(repo, "tag", f"v{k}")
    chunks, encoder = plans.Chunking(max_length=200, overlap=20), HashingEncoder(32)
    done = session.index_versions(spark, repo, ["v1", "v2", "v3"], root=root, chunking=chunks, encoder=encoder)
    assert [(s["new"], s["reused"]) for s in done["stats"]] == [(3, 0), (2, 2), (1, 3)] and done["manifest"]["tables"]["documents"]["rows"] == 6
    again = session.index_versions(spark, repo, last=2, root=root, chunking=chunks, encoder=encoder)
    assert again["stats"] == []
    stepwise = str(tmp_path / "two")
    session.index_versions(spark, repo, ["v1"], root=stepwise, chunking=chunks, encoder=encoder)
    more = session.index_versions(spark, repo, ["v1", "v2", "v3"], root=stepwise, chunking=chunks, encoder=encoder)
    assert [(s["new"], s["reused"]) for s in more["stats"]] == [(2, 2), (1, 3)]
    assert vectors_of(store.load(spark, root)[1]) == vectors_of(store.load(spark, stepwise)[1])
    s = session.Session(spark, root, encoder)
    rows = s.query("alpha return", 2).collect()
    top = [r for r in rows if r["rank"] == 1]
    assert {r.path for r in top} == {"a.py"} and len(top) == 2 and top[0].contains_match and top[0].match_line == 1
    only = s.query("gamma", 5, version="v1").collect()
    assert "c.py" not in {r.path for r in only}
    with pytest.raises(ValueError):
        s.query("x", 1, version="zz")
    assert repository.commit_info(repo, "v2")[4] == ["v2"]


def test_evaluate_index(spark):
    """With vectors that know the answer every metric is 1; the metric settles ties at the cut."""
    eye = np.eye(6)
    chunks = spark.createDataFrame([(f"d{i}", f"d{i}", 0, eye[i].tolist()) for i in range(6)], "doc_id string, chunk_id string, ordinal int, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", eye[i].tolist()) for i in range(4)], "query_id string, embedding array<double>")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1) for i in range(4)], "query_id string, doc_id string, relevance int")
    means, each = find.evaluate_index(queries, qrels, {"chunks": chunks}, 10, 2)
    row = means.first()
    assert (row.ndcg, row.mrr, row.recall, row.hit, row.queries) == (1, 1, 1, 1, 4) and each.count() == 4


def test_search_ways_agree(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8))
    kinds = ["code", "test", "docs"]
    chunks = spark.createDataFrame([(f"d{i % 12}", f"c{i}", i, 1, 2, v[i].tolist()) for i in range(60)], "doc_id string, chunk_id string, ordinal int, start_line int, end_line int, embedding array<double>")
    docs = spark.createDataFrame([(f"d{i}", kinds[i % 3], f"d{i}", None) for i in range(12)], "doc_id string, kind string, source_path string, language string")
    queries = spark.createDataFrame([(f"q{i}", v[i].tolist()) for i in range(5)], "query_id string, embedding array<double>")
    plain = lambda **o: [(r.query_id, r["rank"], r.doc_id, round(r.score, 9), [h.chunk_id for h in r.hits]) for r in find.search(queries, {"documents": docs, "chunks": chunks}, 4, **o).orderBy("query_id", "rank").collect()]
    for options in ({}, {"aggregate": "mean"}, {"kind_penalty": 0.5}, {"code_only": True}):
        assert plain(**options) == plain(blocks=True, **options)
    assert {r[2] for r in plain(code_only=True)} <= {"d0", "d3", "d6", "d9"}


def test_interactive_session_goes_on(monkeypatch, capsys):
    """Wrong input is told and doesn't end the session."""
    import io
    from types import SimpleNamespace

    shown = []

    def show(text):
        if text == "bad":
            raise ValueError("no such version")
        shown.append(text)

    a = SimpleNamespace(top_k=10, json=False)
    lines = [":help", ":k x", ":k 3", ":paste", ".", ":paste", "two", "lines", ".", ":what", "bad", "  ", "first", ":json", ":quit", "never"]
    monkeypatch.setattr("sys.stdin", io.StringIO("".join(x + "\n" for x in lines)))
    session._interactive(SimpleNamespace(refresh=lambda: False), show, a)
    out = capsys.readouterr().out
    assert shown == ["two\nlines\n", "first"] and (a.top_k, a.json) == (3, True)
    assert "usage: :k N" in out and "unknown command :what" in out and "nothing to search for" in out and "no such version" in out
