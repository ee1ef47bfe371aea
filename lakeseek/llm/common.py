"""What the corpus operators share: reading, materialising, grouping, word splitting on Arrow buffers, hashing."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
#: Prefix of helper columns, so that a caller's extra columns never clash with them.
P = "__ls_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, whose executors are this process, may do without."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        path = f"file://{tempfile.gettempdir()}/lakeseek-shared"
    return path.rstrip("/")


def _on_files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet in the shared folder and read it again. The table goes with ``drop_table``, at the latest when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeseek-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    target, files = _on_files(spark, path)
    files.deleteOnExit(target)
    _TABLES[id(out)] = (out, path)
    return out


#: Tables written by this session, by the DataFrame that reads each.
_TABLES: dict[int, tuple[DataFrame, str]] = {}


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        _, path = _TABLES.pop(id(df))
        target, files = _on_files(df.sparkSession, path)
        files.delete(target, True)


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, **named_columns: Column) -> DataFrame:
    """``df`` as one struct column P + row and the given columns, each under P + its name: no name of ``df`` can clash with a helper's."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias(P + "row"), *[c.alias(P + n) for n, c in named_columns.items()])


def unpacked(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns of the packed row."""
    return [F.col(P + "row").getField(c).alias(c) for c in columns]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with "new_" before it as often as it takes not to be one of ``taken`` in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"new_{name}"
    return name


def size_bytes(df: DataFrame, column: str) -> int:
    """Rough bytes of ``df``: the files' size as the planner knows it, or the length of ``column`` summed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_count(df: DataFrame, column: str, group_bytes: int = 1 << 20) -> int:
    """Number of groups of about ``group_bytes`` (compressed) that ``df`` is dealt into; a few per shuffle partition at least."""
    return max(4 * shuffle_partitions(df.sparkSession), math.ceil(size_bytes(df, column) / group_bytes))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the held-out contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def native_words(text: Column) -> Column:
    """array<string> of words; null gives the empty array. Only one-character splits, which the JVM does without a regex."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


# -- words of a whole Arrow batch at once: no Python object per word ---------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and its n + 1 offsets from 0. A null is an empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 word offsets of the texts."""
    inside = ~_IS_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, offs: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the (kept) words of every text, joined by one space, and the texts' offsets in them."""
    if keep is None:
        keep = np.ones(len(starts), bool)
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[starts[keep]] += 1
    edge[ends[keep]] -= 1
    mask = np.cumsum(edge[: len(raw) + 1], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(offs, kept, side="right") - 1
    sep = kept[:-1][doc[1:] == doc[:-1]] if len(kept) else kept
    out = np.append(raw, np.uint8(32)).astype(np.uint8)
    out[ends[sep]] = 32
    mask[ends[sep]] = True
    size = np.zeros(len(offs), np.int64)
    per_word = (ends - starts) * keep
    per_word[sep] += 1
    total = np.concatenate([[0], np.cumsum(per_word)])
    size[:] = total[offs]
    return out[mask], size


_M1, _M2, _M3 = 0x9E3779B97F4A7C13, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB  # odd multipliers, 3 modulo 8


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept up to a few MB."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            step, m = b, 1
            while m < size:
                out[m : 2 * m] = out[:m] * np.uint64(step)
                step, m = step * step % (1 << 64), 2 * m
            have.append(out)
        if size <= 1 << 21:
            _POWERS[base] = have
    return have[0], have[1]


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i."""
    up, _ = _powers(base, max(1, len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int, salt: int) -> np.ndarray:
    """Hash of each span [lo, hi) of the values that ``sums`` added up; equal spans have equal hashes wherever they stand."""
    _, down = _powers(base, len(prefix))
    return mix((prefix[hi] - prefix[lo]) * down[lo] + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)) * ((hi - lo).astype(np.uint64) + np.uint64(1)))


_SALTS = [0x5851F42D4C957F2D, 0xA0761D6478BD642F]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every word. Words of up to 16 bytes are mixed as two whole numbers and their length, longer ones by XXH3.

    Hashes of two salts are independent, so two of them make 128 bits.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = np.ndarray(len(raw) + 9, "<u8", np.concatenate([raw, np.zeros(16, np.uint8)]).tobytes(), 0, (1,))
    whole = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    length = ends - starts
    out = mix((eights[starts] & whole[np.minimum(length, 8)]) ^ np.uint64(_SALTS[salt]))
    more = np.flatnonzero(length > 8)
    out[more] ^= eights[starts[more] + 8] & whole[np.minimum(length[more] - 8, 8)]
    out = mix(out + length.astype(np.uint64) * np.uint64(_M1))
    long = np.flatnonzero(length > 16)
    if len(long):
        import xxhash

        digest, seed = xxhash.xxh3_64_intdigest, _SALTS[salt]
        out[long] = [digest(raw[a:b].tobytes(), seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def window_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int, prefix: np.ndarray | None = None, base: int = _M2) -> np.ndarray:
    """Hashes of the windows [lo, hi) of words; another ``base`` over words of another salt gives independent ones."""
    if prefix is None:
        prefix = sums(words, base)
    return spans(prefix, lo, hi, base, salt)


def word_sums(words: np.ndarray, base: int = _M2) -> np.ndarray:
    return sums(words, base)
