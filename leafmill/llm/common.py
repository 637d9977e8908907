"""What the operators share: shared folders, words of Arrow batches and vectorised hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    and Spark runs in one process (tests), a temporary folder that goes with it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.leafmill.shared", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        at = "file://" + local
        spark.conf.set("spark.leafmill.shared", at)
    return at.rstrip("/")


_FOLDERS: ContextVar[tuple[str, ...]] = ContextVar("leafmill_folders", default=())


def fresh_path(spark: SparkSession, label: str, outer: bool = False) -> str:
    """A new path of the shared store, in the innermost `scratch` folder (or, if outer, in the one around it)."""
    folders = _FOLDERS.get()[: -1 if outer else None]
    return f"{folders[-1] if folders else shared_folder(spark) + '/leafmill'}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label, outer)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables written inside are removed at the end; what is to stay is written with `outer`."""
    folders = _FOLDERS.get()
    path = fresh_path(spark, label)
    token = _FOLDERS.set((*folders, path))
    try:
        yield
    finally:
        _FOLDERS.reset(token)
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def apart(docs: DataFrame, **used: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with every column under a name that can't clash, and the given names of those columns.

    Column i becomes `__in<i>`, and each keyword gives a second name to a column: apart(docs, __text="text").
    The columns are found without regard to case, the first of several of one name.
    """
    given = {f"__in{i}": name for i, name in enumerate(docs.columns)}
    out = docs.toDF(*given)
    places: dict[str, str] = {}
    for inner, name in given.items():
        places.setdefault(name.lower(), inner)
    return out.withColumns({k: F.col(places[v.lower()]) for k, v in used.items()}) if used else out, given


def place(given: dict[str, str], name: str) -> str:
    """The column of `apart` that was called `name`."""
    return next(inner for inner, x in given.items() if x.lower() == name.lower())


def beside(given: dict[str, str], results: Sequence[str], leave: Sequence[str] = ()) -> list[Column]:
    """The input's columns of `apart` for a select, without those in `leave` (their new names).

    One that has the name of a result column, in any case, gets `_in` behind its name, as often as needed:
    results keep their names, and no input column is lost.
    """
    taken = {x.lower() for x in results}
    out = []
    for inner, name in given.items():
        if inner in leave:
            continue
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out.append(F.col(inner).alias(name))
    return out


def partitions(spark: SparkSession, total_bytes: int = 0, each: int = 32 << 20) -> int:
    """Enough partitions for total_bytes, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // each))


def words_of(text: str | Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    """Number of words, without building them: gaps between words plus one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_share(*cols: Column | str, seed: str = "") -> Column:
    """Seeded share in [0, 1) of a row: the first 32 bits of an MD5, as SQL engines give it too."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


# ---------------------------------------------------------------- words of Arrow columns

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_Q = np.uint64(0xD1342543DE82EF95)  # odd, so that it has an inverse modulo 2**64


def _inverse(x: int) -> int:
    return pow(int(x), -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.back = base, np.uint64(_inverse(base))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, x in (("up", self.base), ("down", self.back)):
                p = np.full(size, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_WORDS = _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 64


def _marks(code: np.ndarray) -> np.ndarray:
    """A value of 64 random-like bits for each code (place in the word, byte)."""
    return mix(mix((code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))


_TABLE = _marks(np.arange(_PLACES << 8))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 4 << 20, rows: int = 1 << 40) -> list[tuple[int, int]]:
    """Runs of at most `rows` rows of about `most` bytes together (one row at least), to bound working memory."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        out.append((i, j))
        i = j
    return out


class Words:
    """Word spans of some rows: starts and ends (byte offsets), and bounds[d]:bounds[d+1] of row d.

    `separators` says for each byte if it is one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP):
        self.data, self.offsets = data, offsets
        if not len(data):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.bounds = np.zeros(len(offsets), np.int64)
            return
        sep = separators[data]
        first, last = ~sep, ~sep
        first[1:] &= sep[:-1]
        last[:-1] &= sep[1:]
        filled = offsets[1:] > offsets[:-1]
        at = offsets[:-1][filled]
        first[at] = ~sep[at]
        at = offsets[1:][filled] - 1
        last[at] = ~sep[at]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z folded if asked. Worked off in blocks.

        Every (place, byte) has a value of its own, and a word is their sum: unlike a polynomial modulo 2**64,
        no family of words collides whatever the constants. Two different words are equal with a chance of 2**-64.
        """
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(out)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + (1 << 20), "right")))
            lo, hi = self.starts[i], self.ends[j - 1]
            raw = self.data[lo:hi]
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            place = np.arange(hi - lo, dtype=np.int64) - np.repeat(s, np.diff(s, append=hi - lo))
            code = (place << 8) | (_LOWER[raw] if lower else raw)
            value = np.zeros(hi - lo + 1, np.uint64)
            np.take(_TABLE, code, out=value[:-1], mode="clip")
            if (e - s).max() > _PLACES:
                far = np.flatnonzero(place >= _PLACES)
                value[far] = _marks(code[far])
            cut = np.empty(2 * (j - i), np.int64)
            cut[::2], cut[1::2] = s, e
            out[i:j] = mix(np.add.reduceat(value, cut)[::2] + (e - s).astype(np.uint64))
            i = j
        return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of the k consecutive items that start at each place (len(h)-k+1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def rolling_in_rows(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the windows of k items that lie within one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(bounds)
    end = np.repeat(bounds[1:], counts)  # of the row of each item
    at = np.flatnonzero(np.arange(n) + k <= end[:n])
    return rolling(h, k)[at], at


def whole(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each row's whole sequence of items."""
    up, down = _WORDS.get(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    s, e = bounds[:-1], bounds[1:]
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
