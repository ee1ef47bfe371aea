"""Vectors as array columns, and the built-in hashing encoder."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.functions.text import python_terms


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    size = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v.cast("array<double>"), lambda x: x / size)


class HashingEncoder:
    """Term frequencies in md5 buckets, unit length. Deterministic, no model files; it stands where a neural encoder would.

    Any object with ``dim``, ``encode(list of texts) -> float array (n, dim)`` and ``fingerprint()`` can take its place.
    """

    def __init__(self, dim: int = 256):
        self.dim, self._known = dim, {}

    def bucket(self, term: str) -> int:
        if term not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dim
        return self._known[term]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            at = [self.bucket(t) for t in python_terms(text)]
            if at:
                row += np.bincount(at, minlength=self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def fingerprint(self) -> dict:
        return {"model_name": "term-hashing", "pooling": "tf", "normalized": "true", "dim": str(self.dim)}


def encode(df: DataFrame, text: str, encoder, out: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with the embedding of column ``text``. Within each batch the longest texts go first, so that padding is small; rows keep their order."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    at = df.columns.index(text)
    names = [*df.columns, out]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            vectors = np.zeros((len(texts), encoder.dim))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                vectors[part] = encoder.encode([texts[i] for i in part])
            offsets = pa.array(np.arange(0, vectors.size + 1, encoder.dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names)

    kinds = [StructField(f.name, f.dataType, True) for f in df.schema.fields]
    return df.mapInArrow(run, StructType([*kinds, StructField(out, ArrayType(DoubleType()))]))


class OnnxEncoder:
    """A sentence encoder from an ONNX file and its tokenizer: truncate, batch by length, first position, unit length.

    The session is made once per Python worker. Files are named by path; nothing is downloaded.
    """

    def __init__(self, model_path: str, tokenizer_path: str, dim: int, max_length: int = 1024, threads: int = 1):
        self.model_path, self.tokenizer_path, self.dim, self.max_length, self.threads = model_path, tokenizer_path, dim, max_length, threads
        self._session = None

    def __getstate__(self):
        return {**self.__dict__, "_session": None}

    def _open(self):
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_truncation(self.max_length)
            self._session = onnxruntime.InferenceSession(self.model_path, options), tokenizer
        return self._session

    def encode(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim))
        session, tokenizer = self._open()
        ids = [e.ids for e in tokenizer.encode_batch(texts)]
        width = max(map(len, ids))
        tokens = np.array([i + [0] * (width - len(i)) for i in ids], np.int64)
        mask = np.array([[1] * len(i) + [0] * (width - len(i)) for i in ids], np.int64)
        inputs = {x.name: {"input_ids": tokens, "attention_mask": mask}.get(x.name, np.zeros_like(tokens)) for x in session.get_inputs()}
        first = session.run(None, inputs)[0][:, 0].astype(float)
        return first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-12)

    def token_lengths(self, texts: list[str], truncate: bool = False) -> list[int]:
        _, tokenizer = self._open()
        lengths = [len(e.ids) for e in tokenizer.encode_batch(texts)]
        return [min(n, self.max_length) for n in lengths] if truncate else lengths

    def fingerprint(self) -> dict:
        return {
            "model_name": self.model_path.rsplit("/", 1)[-1], "onnx_sha256": file_sha256(self.model_path), "max_length": str(self.max_length), "pooling": "first",
            "normalized": "true", "dim": str(self.dim),
        }


_FILE_HASHES: dict = {}


def file_sha256(path: str) -> str:
    """SHA-256 of a local file, remembered while its size and time of change stay."""
    import os

    stat = os.stat(path)
    key = (os.path.abspath(path), stat.st_size, stat.st_mtime_ns)
    if key not in _FILE_HASHES:
        digest = hashlib.sha256()
        with open(path, "rb") as file:
            while block := file.read(1 << 20):
                digest.update(block)
        _FILE_HASHES[key] = digest.hexdigest()
    return _FILE_HASHES[key]
