"""Token ids as fixed-stride binary shards in a keyed training order.

Every document's ids plus the end token are cut into sequences of ``length``
ids, the last one padded with the end token. Sequences are numbered 0..N-1 in
the order of the stored id table (partition, then position), so a number needs
only the partition's offset and no global sort. A keyed Feistel network over
the next even power of two, walked along its cycle until it lands below N, maps
numbers one to one to global slots. Slots are dealt in ranges: shard k holds
slots k*S to k*S + S - 1, each at a fixed stride, so a reader can start at any
slot, read on sequentially and resume there.

A shard is written under a name of its own and then renamed, so a repeated task
leaves the same file. Records are little-endian unsigned integers of 16 bits, or
32 where the vocabulary is larger.

Defined results: null and empty texts give one sequence of end tokens; repeated
rows are separate sequences; an empty table writes no shard; other columns are
never read.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _vocabulary
from .common import scratch_dir, stored
from .textbytes import mix

LENGTH = 256         # ids of a sequence
SHARD = 1 << 14      # slots of a shard
ROWS, IDS = 2048, 1 << 22    # documents, and about how many ids, compressed together
LEVEL = 9            # of the compression between the steps
ROUNDS = 6
U = np.uint64


def permute(number: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed bijection of 0..n-1."""
    half = max(1, math.ceil(max(1, n - 1).bit_length() / 2))
    mask = U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(key & (1 << 64) - 1))
    order = keys[::-1] if inverse else keys
    x = number.astype(np.uint64)
    out = np.zeros_like(x)
    at = np.arange(len(x))
    while len(at):
        left, right = x >> U(half), x & mask
        for k in order:
            if inverse:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        x = left << U(half) | right
        done = x < n
        out[at[done]] = x[done]
        at, x = at[~done], x[~done]
    return out.astype(np.int64)


def id_table(docs: DataFrame, path: str, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(pid, start, n, sizes, ids)``: ids of up to ``ROWS`` documents, compressed
    together, with their first sequence's place in the partition."""
    def scan(batches):
        v = _vocabulary(path)
        end = max(v.special.values(), default=0)
        kind = "<u2" if max(v.token) < 1 << 16 else "<u4"
        pid, start = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=LEVEL)
        ids: list[np.ndarray] = []

        def row():
            nonlocal start
            n = sum(-(-len(x) // length) for x in ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                 pa.array([pack.compress(np.concatenate(ids).tobytes())], pa.binary())],
                ["pid", "start", "n", "sizes", "ids"])
            start += n
            ids.clear()
            return out

        for b in batches:
            held = 0
            for t in b.column(0):
                ids.append(np.append(v.encode(t.as_py() or ""), end).astype(kind))
                held += len(ids[-1])
                if len(ids) == ROWS or held >= IDS:
                    yield row()
                    held = 0
            if ids:
                yield row()

    return docs.select(text_col).mapInArrow(scan, "pid int, start long, n long, sizes array<long>, ids binary")


def write_shards(docs: DataFrame, path: str, root: str, key: int, text_col: str = "text",
                 length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Write ``root``/shard-NNNNN.bin and return ``(shard, file, first_slot,
    n_slots, n_bytes, sha256)``."""
    v = _vocabulary(path)
    end = max(v.special.values(), default=0)
    kind = "<u2" if max(v.token) < 1 << 16 else "<u4"
    width = length * int(kind[-1])
    table = stored(id_table(docs, path, text_col, length), "token-ids")
    size = {r["pid"]: r["n"] for r in table.groupBy("pid").agg(F.sum("n").alias("n")).collect()}   # one per partition
    base, total = {}, 0
    for p in sorted(size):
        base[p] = total
        total += size[p]

    def place(batches):
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for b in batches:
            for r in range(b.num_rows):
                sizes = b.column(3)[r].values.to_numpy()
                ids = np.frombuffer(unpack.decompress(b.column(4)[r].as_py()), kind)
                n = -(-sizes // length)
                flat = np.full((int(n.sum()), length), end, kind)
                first = np.repeat((np.cumsum(n) - n) * length - (np.cumsum(sizes) - sizes), sizes)
                flat.reshape(-1)[first + np.arange(len(ids))] = ids
                number = base[b.column(0)[r].as_py()] + b.column(1)[r].as_py() + np.arange(len(flat))
                slot = permute(number, total, key)
                order = np.argsort(slot)
                cut = np.flatnonzero(np.diff(slot[order] // shard)) + 1
                parts = np.split(order, cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(slot[x[0]]) // shard for x in parts], pa.int32()),
                     pa.array([slot[x] for x in parts], pa.list_(pa.int64())),
                     pa.array([pack.compress(flat[x].tobytes()) for x in parts], pa.binary())],
                    ["shard", "slots", "records"])

    def write(batches):
        """One partition per shard: its slots are filled in as they come."""
        where, folder = fs.FileSystem.from_uri(root)
        unpack = zstandard.ZstdDecompressor()
        now, data, filled = -1, None, None
        for b in batches:
            for r in range(b.num_rows):
                if data is None:
                    now = b.column(0)[r].as_py()
                    n = min(shard, total - now * shard)
                    data, filled = np.zeros((n, width), np.uint8), np.zeros(n, bool)
                at = b.column(1)[r].values.to_numpy() - now * shard
                data[at] = np.frombuffer(unpack.decompress(b.column(2)[r].as_py()), np.uint8).reshape(-1, width)
                filled[at] = True
        if data is None:
            return
        if not filled.all():
            raise RuntimeError(f"shard {now}: {int((~filled).sum())} slots are missing")
        raw, own, name = data.tobytes(), f"{folder}/.shard-{now:05d}-{uuid.uuid4().hex}", f"shard-{now:05d}.bin"
        with where.open_output_stream(own) as out:
            out.write(raw)
        where.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_pylist(
            [{"shard": now, "file": name, "first_slot": now * shard, "n_slots": len(data), "n_bytes": len(raw),
              "sha256": hashlib.sha256(raw).hexdigest()}], MANIFEST)

    where, folder = fs.FileSystem.from_uri(root)
    where.create_dir(folder, recursive=True)
    dealt = table.mapInArrow(place, "shard int, slots array<long>, records binary") \
        .repartitionById(max(1, -(-total // shard)), F.col("shard"))
    done = dealt.mapInArrow(write, "shard int, file string, first_slot long, n_slots long, n_bytes long, sha256 string")
    return stored(done, "token-manifest")


MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_slot", pa.int64()),
                      ("n_slots", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])


def new_root(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    d = scratch_dir(spark)
    return f"{d if ':' in d else 'file://' + d}/shards-{uuid.uuid4().hex}"


def read_slots(spark: SparkSession, root: str, first: int, last: int, length: int = LENGTH, shard: int = SHARD,
               kind: str = "<u2") -> DataFrame:
    """``(slot, ids)`` for slots first..last-1: opens the shards they lie in and
    seeks to the stride."""
    width = length * int(kind[-1])
    parts = spark.range(first // shard, -(-last // shard)).repartition(max(1, -(-last // shard) - first // shard), "id")

    def read(batches):
        where, folder = fs.FileSystem.from_uri(root)
        for b in batches:
            for s in b.column(0).to_pylist():
                with where.open_input_file(f"{folder}/shard-{s:05d}.bin") as f:
                    x, y = max(first, s * shard), min(last, s * shard + f.size() // width)
                    f.seek((x - s * shard) * width)
                    while x < y:
                        n = min(1024, y - x)
                        ids = np.frombuffer(f.read(n * width), kind).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.arange(x, x + n)), pa.ListArray.from_arrays(
                                pa.array(np.arange(n + 1, dtype=np.int32) * length), pa.array(ids))], ["slot", "ids"])
                        x += n

    return parts.mapInArrow(read, "slot long, ids array<int>")
