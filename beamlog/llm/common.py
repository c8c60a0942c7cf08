"""Shared helpers of the corpus operators: shared-folder tables, byte classes, Arrow text access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space bytes that separate words and are dropped by the exact-duplicate key.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Text bytes handled at once by the numpy kernels; bounds a task's working memory. Their 64-bit temporaries stay in cache.
CHUNK_BYTES = 1 << 18
#: Spark's own setting that drops a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="beamlog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str = "table", file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind the table serve nothing from then on, so Spark drops them as the write ends. The Parquet
    writer and reader hold up to 100 and 4,096 rows at once, whatever their bytes; a file has ``file_rows`` at most, if not 0.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _written:
        atexit.register(_remove_tables)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a stored table that no plan will read again; what came of it has been stored itself."""
    _delete(table.sparkSession, table._stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_tables() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; the folder's owner cleans up then
            return


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once an application: a cluster's workers need not have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="beamlog-")) / "beamlog.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(str(bundle))  # the driver serves it to each executor
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with the package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def squeezed(text: Column) -> Column:
    """The text without any of the six white-space characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def n_words(text: Column) -> Column:
    """Number of maximal runs of other characters than the six white-space ones; null has none."""
    one = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * 6)
    return F.size(F.filter(F.split(one, " "), lambda w: w != "")).cast("long")


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Boolean table over the 256 bytes."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Words of the duplicate and mixing operators: anything but the six white-space bytes.
NON_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words of the benchmark comparison: digits, letters and every byte of a non-ASCII character.
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets, without a copy; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [i, j) of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows of ``data``, and each row's first word (one entry more than rows)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = False, False
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1]
    before[cut[cut < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
        if n > 4 * CHUNK_BYTES:
            _powers.pop(base)
    return have[:n]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2^64, for hashes that do not depend on place."""
    return _power_table(_BASE, n), _power_table(_INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value; in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes that does not depend on where the word stands."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power_table(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours; one value per window that fits."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


#: Bits of a membership filter, at most: 32 MB are broadcast, whatever the corpus. Beyond that more rows pass than need to.
FILTER_BITS = 1 << 28


def bit_filter(values: DataFrame) -> tuple[DataFrame, int]:
    """Bit maps of one column of longs, eight bits or more a value up to FILTER_BITS in all, and the number of bits."""
    (name,) = values.columns
    bits = min(FILTER_BITS, 1 << max(15, (8 * values.count()).bit_length()))
    at = F.pmod(F.col(name), F.lit(bits))
    maps = values.groupBy(F.bitmap_bucket_number(at).alias("_bit_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bit_map"))
    return stored(maps, "bit-maps"), bits


def may_hold(rows: DataFrame, value: Column, filter_bits: tuple[DataFrame, int], name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false where ``value`` is surely none of the filter's; no row is shuffled."""
    maps, bits = filter_bits
    at = F.pmod(value, F.lit(bits))
    both = rows.join(F.broadcast(maps), F.bitmap_bucket_number(at) == F.col("_bit_bucket"), "left")
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bit_map"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return both.withColumn(name, F.coalesce(F.bit_get(byte, place % 8) == 1, F.lit(False))).drop("_bit_bucket", "_bit_map")


def hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash a column of this type: no map and no variant anywhere in it."""
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of one row for each value of ``keys``: that of the least hash over all columns that can be hashed."""
    plain = [F.col(c) for c in columns if hashable(rows.schema[c].dataType)]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.xxhash64(*plain)).alias("_one")).select("_one.*")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, so extra input columns never clash with ours."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
