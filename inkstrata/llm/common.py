"""What the operators of this subpackage share: written intermediate tables, whole-batch
byte hashing, word spans and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- written intermediate tables ------------------------------------------------------

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none a temporary one is made, and only for a local master.
    """
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="inkstrata-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


#: Bytes of a batch that goes to a Python worker. Without a bound ten thousand texts are one
#: batch, which executor and worker each hold several times.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes; a smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key, None)
    kept = int(found) if found and str(found).isdigit() else None
    if kept is None or kept > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/inkstrata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    _paths.made = [*getattr(_paths, "made", []), path]
    return spark.read.schema(df.schema).parquet(path)


#: What this thread has written, in order.
_paths = threading.local()


def written_alone(make, name: str) -> DataFrame:
    """``written`` of the table that ``make()`` returns; what was written to make it is removed then."""
    before = len(getattr(_paths, "made", []))
    out = written(make(), name)
    *passed, last = _paths.made[before:]
    for path in passed:
        _remove(out.sparkSession, path)
    _paths.made = [*_paths.made[:before], last]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Items (a row of an id and a small value, or an element of an array) up to which a side is
#: broadcast: about 50 MB in an executor.
BROADCAST_ITEMS = 1_000_000


def with_checked_broadcast(big: DataFrame, small: DataFrame, on: str, how: str, items=None) -> DataFrame:
    """Join a table of texts with a narrow written one. If the narrow one's counted ``items``
    (default: its rows) are within the bound it is broadcast and no text is shuffled; beyond
    it, both are shuffled."""
    n = small.agg(F.sum(F.lit(1) if items is None else items)).first()[0] or 0
    if n <= BROADCAST_ITEMS:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("shuffle_hash"), on, how)


# --- hashing over whole batches -------------------------------------------------------

U64 = np.uint64
#: Odd multipliers and the seed of the byte tables.
BASE = 0x9E3779B97F4A7C15
SEED = 20240229
CHUNK_BYTES = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), so that all bits of a sum matter."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class SpanHasher:
    """Hashes of byte spans of one buffer in O(1) each: prefix sums of ``T[byte] * B**i``
    modulo 2**64, brought to a common origin with the inverse of B. Seeds differ in the byte
    table T. The powers for a chunk (16 MB) are kept in a worker, for a longer text they are
    made anew."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, buf: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(SEED + seed)
        self.byte = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | U64(1)
        n = len(buf)
        up, self.down = self._grown(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[buf] * up[:n], out=self.sums[1:])

    @classmethod
    def _grown(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers
        if have is None or len(have[0]) < n:
            size = max(n, CHUNK_BYTES + 1024)
            have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (BASE, pow(BASE, -1, 2**64)))
            if size == CHUNK_BYTES + 1024:
                cls._powers = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def give_back() -> None:
    """Return freed memory of a Python worker to the system: allocators keep it for the worker,
    while executor and other workers need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class HashTable:
    """Open addressing from mixed 64-bit keys to int32 values from 0 on, whole arrays at a time."""

    FREE = U64(0)

    def __init__(self, most: int):
        self.mask = U64(2 ** max(4, int(2 * most).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.full(int(self.mask) + 1, -1, np.int32)
        self.n = 0

    def put(self, keys: np.ndarray, values: np.ndarray) -> HashTable:
        """Different keys; one that is 0 is left out and so is never found."""
        left = np.flatnonzero(keys != self.FREE)
        self.n += len(left)
        slot = keys & self.mask
        while len(left):
            s = slot[left]
            free = self.keys[s] == self.FREE
            self.keys[s[free]] = keys[left[free]]
            mine = self.keys[s] == keys[left]
            self.values[s[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + U64(1)) & self.mask
        return self

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slot = keys & self.mask
        at = self.keys[slot]
        hit = at == keys
        out = np.full(len(keys), -1, np.int32)
        found = np.flatnonzero(hit)
        out[found] = self.values[slot[found]]
        open_ = np.flatnonzero(~hit & (at != self.FREE))
        while len(open_):
            slot[open_] = (slot[open_] + U64(1)) & self.mask
            s = slot[open_]
            at = self.keys[s]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[s[hit]]
            open_ = open_[~hit & (at != self.FREE)]
        return out


_CACHE: dict = {}


def worker_cache(key, make):
    """What an operator keeps in a Python worker between tasks. Workers are used again by
    later operators, so only the last one's is kept."""
    if key not in _CACHE:
        _CACHE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _CACHE[key] = make()
    return _CACHE[key]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first row, bytes, offsets) for runs of rows of about ``limit`` bytes of UTF-8;
    a longer text is a run of its own. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


#: The white space of `[^\x20\x09-\x0D]+`, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offs: np.ndarray, word: np.ndarray | None = None):
    """Starts, ends and document of the runs of ``word`` bytes (default: not white space);
    runs end where documents end."""
    word = ~SPACE[buf] if word is None else word
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate([word[1:], [False]])
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def long_list(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list<int64> array from flat uint64 or int64 values."""
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values.view(np.int64)))


# --- labels and folds -----------------------------------------------------------------


def fold(doc_id, n: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


# --- connected components -------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node on an edge (u, v).

    Alternating large-star and small-star steps on the edge table: each step is an
    aggregation with partial sums and a join on its unique key, so that a node with very many
    edges never meets in one task; O(log^2 n) rounds. Each round is written, and the loop
    ends when the edges are stars.
    """
    e = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # every larger neighbour to the smallest of the neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # every smaller neighbour, and the node itself, to the smallest
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = written(small.where("u <> v").distinct(), "edges")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _are_stars(e: DataFrame) -> bool:
    """Whether every node is either the smaller end of edges only or the larger end of one."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
    node = ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.count("*").alias("n"))
    return node.where("up > 1 or (up = 1 and n > 1)").isEmpty()
