"""Best-fit packing by a grouping genetic algorithm over islands with elite migration.

Documents become pieces of at most CAPACITY tokens; a full piece is a sequence of its own. All other pieces are dealt to
cells of about CELL_ITEMS by a hash. In each cell several islands, each a task of its own, evolve packings from random ones: a crossover takes
whole well-filled bins of one parent into the other, drops the bins that hold any of the same pieces, and best-fits the
pieces so displaced. The islands' elites then migrate into one population per cell, which evolves on. Bins that keep
noticeable room are opened and their pieces go on to the next, smaller level, until one cell remains. Where short pieces
run out and few bins fill up, more room is allowed at that level, so that each level settles a good part of its pieces and
none is left over. A cell that reaches the bound ceil(sum / capacity) stops early.

Only lengths and keys are shuffled, never texts or ids. Cells are bounded by the hash of unique piece numbers, so no source
or group of copies can make one large.

Defined cases: a null text counts as empty and is one piece of the end id alone; equal lengths are ordered by piece number;
repeated rows are packed each.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import shared, word_bpe

CAPACITY, END_ID = 4096, 1
CELL_ITEMS, ISLANDS, POPULATION, GENERATIONS = 5000, 3, 4, 12
#: A bin with more free room than this share of the capacity is opened at the next level. Where under SETTLED of a level's
#: pieces are in bins that stay, the room is allowed fourfold, again until enough stay; all do where the room is the capacity.
ROOM, SETTLED = 1 / 128, 1 / 4


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray, free: list[int]) -> None:
    """Puts the ordered items into the fullest bin with room, opening bins as needed; changes bins and free in place."""
    room = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            f, b = room.pop(at)
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        free[b] = f - n
        if f > n:
            insort(room, (f - n, b))


def _compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def _fill(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins as unequal as can be: sum of squared fills. Larger is better."""
    fill = _fill(bins, lengths) / capacity
    return -len(fill), float((fill * fill).sum())


def crossover(mother: np.ndarray, father: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The mother's packing with a random part of the father's well-filled bins injected whole."""
    fill = _fill(father, lengths)
    good = np.flatnonzero(fill >= capacity - max(1, capacity // 200))
    if len(good) == 0:
        good = np.argsort(-fill)[: max(1, len(fill) // 4)]
    taken = np.zeros(len(fill), dtype=bool)
    taken[rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))), replace=False)] = True
    injected = taken[father]
    hit = np.zeros(mother.max() + 1, dtype=bool)
    hit[mother[injected]] = True
    displaced = hit[mother] & ~injected
    child = np.where(injected, father + len(hit), mother)
    settled = ~displaced
    child[settled] = _compact(child[settled])
    free = (capacity - _fill(child[settled], lengths[settled])).tolist() if settled.any() else []
    loose = np.flatnonzero(displaced)
    best_fit(lengths, loose[np.lexsort((loose, -lengths[loose]))], capacity, child, free)
    return child


def evolve(lengths: np.ndarray, capacity: int, population: list[np.ndarray], generations: int, rng: np.random.Generator) -> np.ndarray:
    """The best packing found from a population; stops where the number of bins can't be less."""
    bound = -(-int(lengths.sum()) // capacity)
    score = lambda p: fitness(p, lengths, capacity)
    population = sorted(population, key=score, reverse=True)
    size = len(population)
    for _ in range(generations):
        if -score(population[0])[0] <= bound or size < 2:
            break
        a, b = rng.choice(size, 2, replace=False)
        children = [crossover(population[a], population[b], lengths, capacity, rng), crossover(population[b], population[a], lengths, capacity, rng)]
        population = sorted(population + children, key=score, reverse=True)[:size]
    return population[0]


def first_population(lengths: np.ndarray, capacity: int, count: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best-fit packings of random orders: none is sorted by length, so what makes bins fewer is crossover."""
    found = []
    for _ in range(count):
        bins, free = np.zeros(len(lengths), dtype=np.int64), []
        best_fit(lengths, rng.permutation(len(lengths)), capacity, bins, free)
        found.append(bins)
    return found


def _island(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values("id", ignore_index=True)
    lengths = pdf["length"].to_numpy(np.int64)
    cell, island = int(pdf["cell"].iloc[0]), int(pdf["island"].iloc[0])
    rng = np.random.default_rng([cell & 0xFFFFFFFF, island])
    population = first_population(lengths, capacity, POPULATION, rng)
    began = min(int(p.max()) + 1 for p in population)
    return pdf.assign(bin=evolve(lengths, capacity, population, GENERATIONS, rng), began=began)


def _migrated(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["island", "id"], ignore_index=True)
    parts = [p for _, p in pdf.groupby("island", sort=True)]
    first = parts[0].reset_index(drop=True)
    lengths = first["length"].to_numpy(np.int64)
    rng = np.random.default_rng([int(first["cell"].iloc[0]) & 0xFFFFFFFF, 1 << 20])
    bins = evolve(lengths, capacity, [p["bin"].to_numpy(np.int64) for p in parts], GENERATIONS, rng)
    fill = _fill(bins, lengths)
    return first.assign(bin=bins, room=(capacity - fill)[bins], began=int(pdf["began"].min()))


_ITEM = "cell long, island int, id long, length long, bin long, began long"


def pack(items: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """A sequence number for every item (columns id, length; ids unique, 0 < length <= capacity): columns id, length, sequence_id.

    A level's cells hold about CELL_ITEMS; each level is written to the folder, with the bins of the best first packing of
    each cell (began) beside those reached. The last level has one cell, or leaves no bin to open; every level settles at least SETTLED of its pieces, so there is no bound on the levels.
    """
    full = items.where(F.col("length") == capacity).select("id", "length", (-F.col("id") - 1).alias("sequence_id"))
    done, left, base = [full], items.where(F.col("length") < capacity).select("id", "length"), 0
    allowed = [min(1.0, ROOM * 4**k) * capacity for k in range(math.ceil(math.log(1 / ROOM, 4)) + 1)]
    n = left.count()
    for level in count():
        if not n:
            break
        cells = max(1, round(n / CELL_ITEMS))
        dealt = left.withColumn("cell", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(cells)))
        islands = dealt.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS))))).withColumn("bin", F.lit(0).cast("long"))
        evolved = islands.groupBy("cell", "island").applyInPandas(lambda p: _island(p, capacity)[["cell", "island", "id", "length", "bin", "began"]], _ITEM)
        best = evolved.groupBy("cell").applyInPandas(lambda p: _migrated(p, capacity)[["cell", "island", "id", "length", "bin", "began", "room"]], _ITEM + ", room long")
        best = shared.staged(best, folder, f"level{level}")
        room, opened = capacity, 0
        if cells > 1:
            over = best.agg(*(F.count_if(F.col("room") > r) for r in allowed)).first()
            room, opened = next((r, o) for r, o in zip(allowed, over) if o <= (1 - SETTLED) * n)
        done.append(best.where(F.col("room") <= room).select("id", "length", ((F.col("cell") + base) * (1 << 24) + F.col("bin")).alias("sequence_id")))
        base += cells
        left, n = best.where(F.col("room") > room).select("id", "length"), opened
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def saved_by_crossover(folder: str, spark: SparkSession) -> list[tuple[int, int]]:
    """Bins of the best first packings and bins reached, by level, of a pack that wrote to the folder."""
    found, hadoop = [], spark._jvm.org.apache.hadoop.fs.Path
    for level in count():
        path = hadoop(f"{folder}/level{level}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return found
        cells = spark.read.parquet(f"{folder}/level{level}").groupBy("cell").agg(F.max("began").alias("began"), (F.max("bin") + 1).alias("bins"))
        found.append(tuple(cells.agg(F.sum("began"), F.sum("bins")).first()))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document's ids with the end id: doc_id, id (unique), piece, start, length, ids_crc32. No shuffle."""
    odd = word_bpe.unlisted_tokens(path)
    end = int(END_ID).to_bytes(4, "little")

    def rows(batches):
        bpe = word_bpe.tokenizer(path, odd)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out = []
                for doc, packed in zip(b.column(0).to_pylist(), bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])):
                    packed += end
                    for i, s in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[s : s + 4 * capacity]
                        out.append((doc, i, s // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    cut = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(shared.released(rows), "doc_id long, piece long, start long, length long, ids_crc32 long")
    return cut.withColumn("id", F.monotonically_increasing_id())


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces with the sequence they are in and their gapless offset there."""
    spark = docs.sparkSession
    folder = shared.work_folder(spark)
    cut = shared.staged(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), capacity, key, text), folder, "pieces")
    placed = pack(cut, folder, capacity).drop("length")
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # at most capacity pieces
    return (
        cut.join(placed, "id")
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(shared.table(spark, sf_dir, "documents"))
