"""Toxicity: a counterfactually regularised classifier.

A logistic model over the presence of letter words (lower-cased). Learning takes at most ``max_labels`` labelled rows, those of the smallest
hash (a documented bound; equal rows count once), whole. Words that stand in ``least_docs`` of them and whose log-odds between toxic and other
documents are ``sure`` standard errors from even are features, however many, and all identity terms are; that is counted in the cluster.
For every sentence of a labelled document that mentions a group, the term is swapped for each other term of its kind, and the squared
change of the score's logit is a penalty: what a text says counts, not which group it names. Fitting is gradient descent on the log-loss, an L2
term and this penalty. The driver gets the features and, of each learning row, which of them it has.

Scoring looks up each text's words in the broadcast weights.

Defined cases: a null or wordless text has the score of the intercept. Repeated labels of a document count as toxic if any does; null
labels teach nothing. If only one class can be learned, every score is that class's smoothed share. Repeated rows are rows of their
own. Empty tables give empty results. Only the named columns are read; language, source and id are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import P, crc_mod, drop_table, materialise, named

# Identity terms by kind; terms of one kind and language can stand for one another.
IDENTITY = [
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh".split(),
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs".split(),
    "black white asian latino hispanic african european arab indian chinese mexican american".split(),
    "gay straight lesbian bisexual heterosexual homosexual transgender queer".split(),
    "woman man girl boy".split(),
    "women men girls boys".split(),
    "immigrant refugee foreigner native".split(),
    "immigrants refugees foreigners natives".split(),
    "blind deaf disabled elderly young old".split(),
    "muslime christen juden hindus buddhisten atheisten".split(),
    "frauen männer mädchen jungen".split(),
    "ausländer flüchtlinge einwanderer einheimische".split(),
    "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "femmes hommes filles garçons".split(),
    "musulmanes cristianos judíos hindúes budistas ateos".split(),
    "mujeres hombres chicas chicos".split(),
]
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _key(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode()) - (1 << 63)


def _least_hashes(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    """The ``limit`` rows of the smallest hash. Of many only about twice as many, by their hash, need to meet in one task."""
    at = F.shiftrightunsigned(F.xxhash64(*columns), 1)
    n = rows.count()
    if n > 2 * limit + 100:
        rows = rows.filter(at <= F.lit(int((2.0 * limit + 100) / n * float(1 << 63))))
    return rows.orderBy(at, *columns).limit(limit)


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: int, left_out: int, max_labels: int) -> DataFrame:
    """(toxic, seen: distinct word hashes, named: identity terms by sentence) of the learning rows."""
    learnable = labels.filter(F.coalesce(crc_mod(id_col, fold) != left_out, F.lit(False)) & named(label_col).isNotNull())
    marked = learnable.groupBy(named(id_col).alias("li")).agg(F.max((named(label_col) > 0).cast("int")).alias("toxic"))
    marked = _least_hashes(marked.select("li", "toxic"), max_labels, "li")
    texts = docs.select(named(id_col).alias("i"), F.xxhash64(named(text_col)).alias("h"), named(text_col).alias("t")).join(F.broadcast(marked), F.col("i") == F.col("li")).drop("li")
    chosen = materialise(_least_hashes(texts.select("i", "h").distinct(), max_labels, "i", "h").withColumnsRenamed({"i": "ci", "h": "ch"}), "labelled-rows")
    texts = texts.join(F.broadcast(chosen), (F.col("i") == F.col("ci")) & (F.col("h") == F.col("ch")), "left_semi").groupBy("i", "h").agg(F.first("t").alias("t"), F.first("toxic").alias("toxic"))
    terms = {t for kind in IDENTITY for t in kind}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seen, named_terms = [], []
            for text in batch.column("t").to_pylist():
                own = set(words(text or ""))
                seen.append([_key(w) for w in own])
                named_terms.append([t for s in _SENTENCE.split(text) for t in set(words(s)) & terms] if own & terms else [])
            yield pa.record_batch([batch.column("toxic"), pa.array(seen, pa.list_(pa.int64())), pa.array(named_terms, pa.list_(pa.string()))], ["toxic", "seen", "named"])

    return materialise(texts.select("t", "toxic").mapInArrow(run, "toxic int, seen array<bigint>, named array<string>"), "labelled-words")


def identity_keys() -> list[int]:
    return sorted({_key(t) for kind in IDENTITY for t in kind})


def sure_words(rows: DataFrame, n: int, toxic: int, least_docs: int, sure: float) -> DataFrame:
    """(w) whose log-odds are sure."""
    counted = rows.select("toxic", F.explode("seen").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).filter(F.col("n") >= least_docs)
    half = F.lit(0.5)
    cells = [F.col("bad") + half, F.lit(toxic) - F.col("bad") + half, F.col("n") - F.col("bad") + half, F.lit(n - toxic) - F.col("n") + F.col("bad") + half]
    odds = F.log(cells[0]) - F.log(cells[1]) - F.log(cells[2]) + F.log(cells[3])
    spread = F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))
    return counted.filter(F.abs(odds) >= F.lit(sure) * spread).select("w")


class Model:
    """keys: sorted word hashes; weights; intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, intercept: float):
        self.keys, self.weights, self.intercept = keys, weights, intercept


def fit(toxic: np.ndarray, docs: list[np.ndarray], named: list[str], keys: np.ndarray, l2: float = 1e-4, swap: float = 1.0, steps: int = 400) -> Model:
    """``docs``: each row's features, of ``keys``; ``named``: the identity terms of all sentences of labelled documents."""
    n, n1 = len(toxic), int(toxic.sum())
    keys = np.unique(np.concatenate([np.asarray(keys, np.int64), np.array(identity_keys(), np.int64)]))
    if n1 == 0 or n1 == n:
        p = (n1 + 1) / (n + 2)
        return Model(keys, np.zeros(len(keys)), float(np.log(p / (1 - p))))
    owner = np.repeat(np.arange(n), [len(d) for d in docs])
    flat = np.concatenate(docs)
    column = np.searchsorted(keys, flat)
    # swaps (from, to, how often)
    place = {t: int(np.searchsorted(keys, _key(t))) for kind in IDENTITY for t in kind}
    counted: Counter = Counter()
    for term, times in Counter(named).items():
        for other in {t for kind in IDENTITY if term in kind for t in kind} - {term}:
            counted[place[term], place[other]] += times
    swaps = sorted(counted)
    a, b = (np.array([p[i] for p in swaps], int) for i in (0, 1))
    often = np.array([counted[p] for p in swaps], float)
    often = often / often.sum() if len(often) else often
    w = np.zeros(len(keys) + 1)
    w[-1] = np.log(n1 / (n - n1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[column], n) + w[-1]
        left = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / n
        g = np.append(np.bincount(column, left[owner], len(keys)) + l2 * w[:-1], left.sum())
        if len(often):
            change = 2 * swap * often * (w[b] - w[a])
            np.add.at(g, b, change)
            np.add.at(g, a, -change)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(keys, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: int, left_out: int, max_labels: int, least_docs: int = 3, sure: float = 3.0) -> Model:
    rows = learning_rows(docs, labels, id_col, text_col, label_col, fold, left_out, max_labels)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, n):
        model = fit(np.full(n, float(bool(toxic))), [], [], [])
    else:
        keys = np.unique(np.concatenate([np.asarray(sure_words(rows, n, toxic, least_docs, sure).toArrow().column("w")), np.array(identity_keys(), np.int64)]))
        sc = docs.sparkSession.sparkContext
        known = sc.broadcast(keys)

        def held(batches):
            import pyarrow as pa

            for batch in batches:
                seen = batch.column("seen")
                flat = np.asarray(seen.flatten()).astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(seen.offsets)))
                at = np.minimum(np.searchsorted(known.value, flat), len(known.value) - 1)
                hit = known.value[at] == flat
                edges = np.searchsorted(row[hit], np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat[hit])), batch.column("named")], ["toxic", "seen", "named"])

        sample = rows.mapInArrow(held, "toxic int, seen array<bigint>, named array<string>").toArrow()
        terms = [t for row in sample.column("named").to_pylist() for t in row]
        model = fit(np.asarray(sample.column("toxic")).astype(float), [np.array(x, np.int64) for x in sample.column("seen").to_pylist()], terms, keys)
    drop_table(rows)
    return model


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 3, left_out: int = 1, threshold: float = 0.7, max_labels: int = 20_000,
) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = learn(docs, labels, id_col, text_col, label_col, fold, left_out, max_labels)
    weights = {int(k): float(w) for k, w in zip(model.keys, model.weights)}
    terms = docs.sparkSession.sparkContext.broadcast((weights, model.intercept))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import xxhash

        known, intercept = terms.value
        digest, half = xxhash.xxh64_intdigest, 1 << 63
        for batch in batches:
            scores = []
            for text in batch.column(P + "t").to_pylist():
                # sorted, so that equal texts have equal sums
                hit = sorted(k for k in (digest(w.encode()) - half for w in set(words(text or ""))) if k in known)
                z = intercept + sum(known[k] for k in hit)
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            yield pa.record_batch([batch.column(id_col), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(named(id_col), F.coalesce(crc_mod(id_col, fold) == left_out, F.lit(False)).alias("held_out"), named(text_col).alias(P + "t"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")
