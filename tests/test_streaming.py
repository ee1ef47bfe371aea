"""A streamed index equals a batch index."""

from lakeseek.functions.vectors import HashingEncoder
from lakeseek.plans import index as plans
from lakeseek.plans import store
from lakeseek.streaming import feed


def test_stream_equals_batch(spark, tmp_path):
    steps = [
        [("a.py", "one two", "upsert", 1), ("b.py", "three", "upsert", 2), ("b.py", "three four", "upsert", 3)],
        [("a.py", None, "delete", 4), ("c.md", "five", "upsert", 5)],
        [("c.md", "five", "upsert", 6)],
    ]
    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    chunks, encoder = plans.Chunking("none"), HashingEncoder(16)
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, feed.CHANGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(feed.CHANGES).parquet(source)
        feed.follow(stream, root, str(tmp_path / "ck"), chunks, encoder, availableNow=True).awaitTermination()
        if not k:
            reader = feed.Reader(spark, root)
    manifest, tables = store.load(spark, root)
    assert manifest["generation"] == 2  # the last batch changed nothing
    assert reader.refresh() and not reader.refresh()
    want = plans.build(feed.as_documents(spark.createDataFrame([("b.py", "three four"), ("c.md", "five")], "doc_id string, text string")), chunks, encoder)
    key = lambda t: sorted((r.doc_id, r.content_hash) for r in t["documents"].collect())
    assert key(tables) == key(want)
    assert sorted((r.chunk_id, tuple(r.embedding)) for r in tables["chunks"].collect()) == sorted((r.chunk_id, tuple(r.embedding)) for r in want["chunks"].collect())


def test_deltas(spark, tmp_path, monkeypatch):
    """Many small batches: each writes only what it changed, deltas are merged, and the index stays that of a build."""
    monkeypatch.setattr(store, "MAX_DELTAS", 2)
    root, chunks, encoder = str(tmp_path / "index"), plans.Chunking("none"), HashingEncoder(8)
    texts = {f"d{k}": f"word{k}" for k in range(40)}
    batch = lambda rows: spark.createDataFrame(rows, feed.CHANGES)
    feed.apply_changes(spark, batch([(i, t, "upsert", 0) for i, t in texts.items()]), root, chunks, encoder)
    shapes, before = [], []
    for k in range(5):
        rows = [(f"d{k}", None, "delete", k), (f"d{k + 1}", f"changed {k}", "upsert", k), (f"n{k}", "new", "upsert", k), (f"d{k + 9}", f"word{k + 9}", "upsert", k)]
        texts.pop(f"d{k}", None)
        texts |= {f"d{k + 1}": f"changed {k}", f"n{k}": "new"}
        manifest = feed.apply_changes(spark, batch(rows), root, chunks, encoder)
        again = feed.apply_changes(spark, batch(rows), root, chunks, encoder)
        assert again["generation"] == manifest["generation"]
        now = [p["folder"] for p in store._parts(manifest)]
        assert all((tmp_path / "index" / f).is_dir() for f in now + before)  # readers of the manifest before go on
        before = now
        shapes.append(len(store._parts(manifest)))
        _, tables = store.load(spark, root)
        assert {r.doc_id: r.text for r in tables["documents"].collect()} == texts
        assert manifest["tables"]["documents"]["rows"] == len(texts) == tables["chunks"].count() == manifest["tables"]["chunks"]["rows"]
        store.validate(tables["documents"], tables["chunks"], 8)
        assert k == 4 or store._parts(manifest)[-1]["tables"]["touched"]["rows"] == (9 - 2 if k == 2 else 3)  # d1 and d2 were changed, then deleted
    assert shapes == [2, 3, 2, 3, 1]  # merged into one delta, then into the base
    want = plans.build(feed.as_documents(spark.createDataFrame(sorted(texts.items()), "doc_id string, text string")), chunks, encoder)
    key = lambda t: sorted((r.chunk_id, tuple(r.embedding)) for r in t["chunks"].collect())
    assert key(tables) == key(want)
