"""Token-id output in training order: a keyed Feistel permutation gives every sequence a global slot.

Documents are encoded once, each with a final end id, and the ids of a task's documents are cut into sequences of WIDTH ids
(16 bits each); only a task's last sequence is shorter. Sequences are numbered 0..N-1 by the input's task and their order in
it; only the number of sequences per task reaches the driver. A balanced
Feistel network keyed by SEED permutes the next power of four at or above N, and walks its cycle until it is back below N, so that
every slot is used exactly once and the slot of any number, or the number of any slot, is computed without a table.

A range partition holds the slots of one shard; its task orders them and writes one file of fixed-stride records: a reader
seeks to slot * stride, so any read is sequential and resumes from a slot number alone. A shard is written under a name of
its attempt and then renamed, so a task that runs again or twice leaves the same file.

Defined cases: a null text counts as empty and is its end id alone; the rest of a short sequence is padding (PAD);
repeated rows are written each; an empty table writes no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import byte_bpe, shared
from tracewright.llm.words import U64, mix

WIDTH, END, PAD, SEED, ROUNDS = 512, 50256, 65535, 20_240_601, 4
STRIDE = 2 * WIDTH
#: Records of a shard, at any size of the input; most tasks that write shards, each one shard after another.
SHARD_ROWS, WRITERS = 16_384, 20_000
#: Compression level of the blocks that are shuffled: ids compress by a quarter better than at the lowest.
BLOCK_LEVEL = 6


def half_bits(n: int) -> int:
    """Bits of each half of the network's block, whose size is the least power of four of n or more."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, n: int, seed: int, rounds: range) -> np.ndarray:
    bits = U64(half_bits(n))
    mask = (U64(1) << bits) - U64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + U64(seed) * U64(0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF))
    left, right = x >> bits, x & mask
    for r in rounds:
        if rounds.step > 0:
            left, right = right, left ^ (mix(right ^ keys[r]) & mask)
        else:
            left, right = right ^ (mix(left ^ keys[r]) & mask), left
    return left << bits | right


def _walk(x: np.ndarray, n: int, seed: int, rounds: range) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = _network(x.astype(np.uint64), n, seed, rounds)
        out_of = np.flatnonzero(out >= U64(n))
        while len(out_of):
            out[out_of] = _network(out[out_of], n, seed, rounds)
            out_of = out_of[out[out_of] >= U64(n)]
    return out.astype(np.int64)


def slots(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The slots of sequence numbers, a permutation of 0..n-1."""
    return _walk(numbers, n, seed, range(ROUNDS))


def numbers(slots_: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The inverse of slots."""
    return _walk(slots_, n, seed, range(ROUNDS - 1, -1, -1))


@lru_cache(maxsize=1)
def encoding(path: str):
    import tiktoken

    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(path))}
    return tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_SEQUENCE = "part long, at long, length long, ids binary, doc_ids array<long>, record_starts array<long>, doc_starts array<long>"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]


def sequences(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The at-th sequence of the part-th task, with the documents in it, where they start there and from which of their ids. No shuffle."""
    names = [x.split()[0] for x in _SEQUENCE.split(", ")]

    def rows(batches):
        from pyspark import TaskContext

        encode, part, at = encoding(path).encode_to_numpy, TaskContext.get().partitionId(), 0
        waiting, held = b"", ([], [], [])  # ids of the open sequence and its documents

        def cut() -> tuple:
            nonlocal waiting
            row = (part, at, len(waiting) // 2, waiting, *(list(x) for x in held))
            waiting = b""
            for x in held:
                x.clear()
            return row

        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                out = []
                for doc, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.append(encode(text_ or "", disallowed_special=()), END).astype("<u2").tobytes()
                    done = 0
                    while done < len(ids):
                        for x, v in zip(held, (doc, len(waiting) // 2, done // 2)):
                            x.append(v)
                        taken = ids[done : done + STRIDE - len(waiting)]
                        waiting, done = waiting + taken, done + len(taken)
                        if len(waiting) == STRIDE:
                            out.append(cut())
                            at += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=names)
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(cut()), _KINDS)], names=names)

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(rows, _SEQUENCE)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


_LISTS = ("doc_ids", "record_starts", "doc_starts")


def to_block(t: pa.Table) -> bytes:
    """Sequences of one shard, compressed, with four bytes of framing a column only: blocks may hold one sequence."""
    docs = t.column("doc_ids").combine_chunks()
    valid = docs.flatten().is_valid().to_numpy(zero_copy_only=False)
    parts = [t.column("slot").to_numpy().astype("<i8"), t.column("length").to_numpy().astype("<i4"), docs.value_lengths().to_numpy().astype("<i4"), valid.astype("<u1")]
    parts.append(docs.flatten().fill_null(0).to_numpy().astype("<i8"))
    parts += [t.column(c).combine_chunks().flatten().to_numpy().astype(k) for c, k in zip(_LISTS[1:], ("<i4", "<i8"))]
    raw = [x.tobytes() for x in parts] + [b"".join(t.column("ids").to_pylist())]
    head = np.array([len(t), len(valid)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=BLOCK_LEVEL).compress(head + b"".join(raw))


def from_block(data: bytes) -> pa.Table:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(raw, "<u4", 2)
    at, found = 8, []
    for kind, many in (("<i8", n), ("<i4", n), ("<i4", n), ("<u1", m), ("<i8", m), ("<i4", m), ("<i8", m)):
        found.append(np.frombuffer(raw, kind, many, at))
        at += found[-1].nbytes
    slot, length, count, valid, *lists = found
    ends = at + 2 * np.cumsum(length.astype(np.int64))
    bounds = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
    values = [pa.array(lists[0], pa.int64(), mask=valid == 0), *(pa.array(x.astype(np.int64)) for x in lists[1:])]
    columns = {"length": pa.array(length.astype(np.int64)), "ids": pa.array([raw[e - 2 * k : e] for e, k in zip(ends.tolist(), length.tolist())], pa.binary())}
    columns |= {c: pa.ListArray.from_arrays(bounds, v) for c, v in zip(_LISTS, values)}
    return pa.table({**columns, "slot": pa.array(slot.astype(np.int64))})


_MANIFEST = "slot long, shard long, byte_offset long, length long, record_crc32 long, doc_ids array<long>, record_starts array<long>, doc_starts array<long>"


def write_shards(docs: DataFrame, folder: str, path: str | None = None, seed: int = SEED, key: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes all shards below folder/shards and returns the manifest: a row per sequence.

    A task sends all its sequences of one shard as one compressed block, so that the shuffle carries about what the staged
    table does. A writer's blocks are sorted by shard, by a sort that may spill, and it holds those of one shard at a time.
    """
    spark = docs.sparkSession
    coded = shared.staged(sequences(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), key, text), folder, "sequences")
    counts = coded.groupBy("part").agg(F.count("*").alias("c")).orderBy("part").toArrow()  # one row of two numbers a task
    parts, each = (counts.column(c).to_numpy() for c in ("part", "c"))
    total, before = int(each.sum()), np.concatenate([[0], np.cumsum(each)])[:-1].astype(np.int64)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one task's input: a bounded part of a file
        if not held:
            return
        table = pa.Table.from_batches(held)
        slot = slots(before[np.searchsorted(parts, table.column("part").to_numpy())] + table.column("at").to_numpy(), total, seed)
        order = np.argsort(slot)
        table = table.drop_columns(["part", "at"]).append_column("slot", pa.array(slot)).take(pa.array(order))
        shard = slot[order] // shard_rows
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, e in zip(cuts[:-1], cuts[1:]):
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int64()), pa.array([to_block(table.slice(a, e - a))], pa.binary())], names=["shard", "block"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(f"{folder}/shards")
        store.create_dir(base, recursive=True)
        pairs = ((s, x) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for shard, some in groupby(pairs, key=lambda p: p[0]):
            t = pa.concat_tables([from_block(x) for _, x in some])  # at most shard_rows records
            t = t.take(pa.array(np.argsort(t.column("slot").to_numpy()))).combine_chunks()
            slot = t.column("slot").to_numpy()
            if not np.array_equal(slot, np.arange(shard * shard_rows, min(total, (shard + 1) * shard_rows))):
                raise ValueError(f"shard {shard} doesn't hold each of its slots once")
            name, crcs = f"{base}/.{shard_name(shard)}-{uuid.uuid4().hex}", []
            with store.open_output_stream(name) as out:
                for ids in t.column("ids").to_pylist():
                    record = ids.ljust(STRIDE, b"\xff")
                    out.write(record)
                    crcs.append(zlib.crc32(record))
            store.move(name, f"{base}/{shard_name(shard)}")
            cols = [pa.array(slot), pa.array(np.full(len(slot), shard)), pa.array(slot % shard_rows * STRIDE), t.column("length").combine_chunks(), pa.array(crcs, pa.int64())]
            cols += [t.column(c).combine_chunks() for c in ("doc_ids", "record_starts", "doc_starts")]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _MANIFEST.split(", ")])

    if not total:
        return shared.staged(spark.createDataFrame([], _MANIFEST), folder, "manifest")
    shards = -(-total // shard_rows)
    writers = min(shards, WRITERS)
    writer = F.expr(f"CAST(shard * {writers} div {shards} AS int)")  # consecutive shards
    ranged = coded.mapInArrow(block, "shard long, block binary").repartitionById(writers, writer).sortWithinPartitions("shard")
    return shared.staged(ranged.mapInArrow(write, _MANIFEST), folder, "manifest")


def read_slots(folder: str, first: int, count: int, shard_rows: int = SHARD_ROWS) -> list[np.ndarray]:
    """count sequences from slot first on, padding cut: what a training job that resumes there reads."""
    store, base = fs.FileSystem.from_uri(f"{folder}/shards")
    found: list[np.ndarray] = []
    while count > 0:
        shard, at = divmod(first, shard_rows)
        name = f"{base}/{shard_name(shard)}"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            break  # past the last shard
        with store.open_input_file(name) as f:
            f.seek(at * STRIDE)
            raw = f.read(min(count, shard_rows - at) * STRIDE)
        if not raw:
            break
        for i in range(0, len(raw), STRIDE):
            ids = np.frombuffer(raw[i : i + STRIDE], dtype="<u2")
            found.append(ids[ids != PAD])
        first, count = first + len(raw) // STRIDE, count - len(raw) // STRIDE
    return found


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(shared.table(spark, sf_dir, "documents"), shared.work_folder(spark))
