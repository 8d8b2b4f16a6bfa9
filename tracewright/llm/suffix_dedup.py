"""Suffix-array dedup over sparse suffixes: repeated passages of MIN_WORDS or more words across documents.

Words are exact, white space between them doesn't count. Suffixes are retained where the GRAM words that start them have the
least hash of a window (content-selected minimiser positions): GRAM + WINDOW - 1 = MIN_WORDS, so that every passage of
MIN_WORDS contains a retained position, the same in all its copies. Then
1. suffixes whose first GRAM words begin no suffix of another document are dropped, by counts alone;
2. the rest carry the words (64-bit hashes) to their right and left, are sorted (a range partition of the sparse suffix
   array), and each is compared with its nearest neighbours of an earlier and of a later document on either side; a match is
   extended right and left and counts where it has MIN_WORDS or more words;
3. the neighbours give the longest match to the right, and a second order, by the words to the left, the longest one to the
   left. Only windows of MIN_WORDS that these two lengths allow and no neighbour covers may hide another match, as do those
   that may match beyond a partition's edge: just these are looked up by hash among the suffixes of their gram.
A passage's occurrence in the least doc_id is kept, all others are removed. Documents of the same words form a class that is
compared once; of a class of MIN_WORDS or more words all but the least doc_id are removed whole.

Runs of one gram may hold any share of all rows: they are sorted by range partitions and read in chunks of CHUNK suffixes.

Defined cases: null and empty texts and those under MIN_WORDS words have no spans; rows of the same id and words count as one
document; repeats within one document are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import shared
from tracewright.llm.words import U64, Words, mix, split_words, steps, text_bytes

MIN_WORDS, GRAM = 50, 24
WINDOW = MIN_WORDS - GRAM + 1
#: Words of context on each side: what a match of MIN_WORDS can need beyond the gram.
REACH = MIN_WORDS - GRAM
#: Suffixes compared at once.
CHUNK = 1 << 13


def document_code(hashes: np.ndarray) -> bytes:
    """128 bits that tell word sequences apart."""
    with np.errstate(over="ignore"):
        at = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64))
        return np.array([mix(hashes ^ at).sum(dtype=np.uint64), mix(hashes + at * U64(3)).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def grams(hashes: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words from each position on."""
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - GRAM + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(GRAM):
            out = out * U64(0xC2B2AE3D27D4EB4F) + hashes[j : j + n]  # n of them, or none
        return mix(out)


def retained(g: np.ndarray) -> np.ndarray:
    """Positions of the least gram hash of every window, the first on ties."""
    if len(g) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    # sliding minimum by doubling, then the leftmost position that has it
    low, span = g, 1
    while 2 * span <= WINDOW:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    n = len(g) - WINDOW + 1
    low = np.minimum(low[:n], low[WINDOW - span : WINDOW - span + n])
    first = np.full(n, -1)
    # the least of a window changes only where it leaves or a lower one enters
    change = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    for c, e in zip(change, np.r_[change[1:], n]):
        hits = np.flatnonzero(g[c : e + WINDOW - 1] == low[c]) + c
        first[c:e] = hits[np.searchsorted(hits, np.arange(c, e))]
    return np.unique(first)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    def rows(batches):
        for b in batches:
            for p in steps(b, "text"):
                w = split_words(*text_bytes(p.column(1)), fold=False)
                codes, many, where, found = [], [], [], []
                every = grams(w.hashes)  # those that run over a row's end aren't looked at
                for a, e in zip(w.bounds[:-1], w.bounds[1:]):
                    codes.append(document_code(w.hashes[a:e]))
                    many.append(e - a)
                    g = every[a : max(a, e - GRAM + 1)]
                    at = retained(g)
                    where.append(at.astype(np.int32))
                    found.append(g[at].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [p.column(0), pa.array(codes, pa.binary()), pa.array(many, pa.int64()), pa.array(where, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "code", "words", "at", "gram"],
                )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return chosen.mapInArrow(shared.released(rows), "doc_id long, code binary, words long, at array<int>, gram array<long>")


def _coded(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(-1, 8)


def _contexts(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, right, left, row, doc_id, at) for the positions of wanted (row, doc_id, code, at array)."""

    def build(batches):
        loosen = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for s in range(0, whole.num_rows, 200):
                b = whole.slice(s, 200)
                out = [[] for _ in range(6)]
                for row, doc, code, at, packed in zip(*(c.to_pylist() for c in b.columns)):
                    raw = np.frombuffer(loosen(packed), dtype=np.uint8)
                    h = split_words(raw, np.array([0, len(raw)]), fold=False).hashes
                    if document_code(h) != code:
                        continue  # another text under the same id
                    g, coded = grams(h), _coded(h)
                    for p in sorted(set(at)):
                        out[0].append(int(g[p].view(np.int64)))
                        out[1].append(coded[p + GRAM : p + GRAM + REACH].tobytes())
                        out[2].append(coded[max(0, p - REACH) : p][::-1].tobytes())
                        out[3].append(row)
                        out[4].append(doc)
                        out[5].append(p)
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["gram", "right", "left", "row", "doc_id", "at"])

    texts = shared.packed_texts(docs, wanted.select("doc_id"), key, text)
    joined = wanted.join(texts.hint("merge"), "doc_id")  # both sides shuffled: not two Python steps in a task
    joined = joined.select("row", "doc_id", "code", "at", "packed")
    return joined.mapInArrow(shared.released(build), "gram long, right binary, left binary, row long, doc_id long, at long").distinct()


def _unpacked(column: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in REACH columns, how many of them there are, and their bytes."""
    n = np.array([len(x) // 8 for x in column], dtype=np.int64)
    raw = np.frombuffer(b"".join(x.ljust(8 * REACH, b"\0") for x in column), dtype=np.uint8).reshape(len(column), 8 * REACH)
    return raw.view(">u8").astype(np.uint64), n, raw


def _common(codes: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that two contexts share from the gram on."""
    same = np.logical_and.accumulate(codes[i] == codes[j], axis=1).sum(axis=1)
    return np.minimum(same, np.minimum(n[i], n[j]))


def nearest_earlier(run: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest one before and after it, in its run, whose order is less; -1 where there is none."""
    before, after = np.full(len(run), -1), np.full(len(run), -1)
    stack: list[int] = []
    last = None
    runs, orders = run.tolist(), order.tolist()
    for i, (r, o) in enumerate(zip(runs, orders)):
        if r != last:
            stack, last = [], r
        while stack and orders[stack[-1]] > o:
            after[stack.pop()] = i
        k = len(stack) - 1
        while k >= 0 and orders[stack[k]] == o:
            k -= 1
        if k >= 0:
            before[i] = stack[k]
        stack.append(i)
    return before, after


def window_hashes(gram: np.ndarray, left: np.ndarray, right: np.ndarray, o: int) -> np.ndarray:
    """Hash of the MIN_WORDS words from o words before the gram on."""
    with np.errstate(over="ignore"):
        h = gram.view(np.uint64) + U64(o)
        for j in range(o):
            h = h * U64(0xC2B2AE3D27D4EB4F) + left[:, j]
        for j in range(REACH - o):
            h = h * U64(0x9E3779B97F4A7C15) + right[:, j]
        return mix(h)


_FOUND = "kind int, gram long, row long, doc_id long, first long, last long"
REMOVED, KEPT, OPEN = 0, 1, 2
_STARTS = np.arange(REACH + 1)  # how many words before its gram a window may begin


def compared(t: pa.Table, first_edge: bool, last_edge: bool) -> pa.RecordBatch:
    """Spans that neighbours of earlier (REMOVED) and later documents (KEPT) give, and windows left OPEN (last is their hash).

    The rows are sorted by gram, right, left; an edge tells that the first or last run may go on beyond them.
    """
    gram, row, doc, at = (t.column(c).to_numpy() for c in ("gram", "row", "doc_id", "at"))
    rank = np.lexsort((row, doc))
    order = np.empty(len(row), np.int64)
    order[rank] = np.cumsum(np.r_[0, row[rank][1:] != row[rank][:-1]])
    right, nr, right_raw = _unpacked(t.column("right").to_pylist())
    left, nl, left_raw = _unpacked(t.column("left").to_pylist())
    valid = (_STARTS <= nl[:, None]) & (REACH - _STARTS <= nr[:, None])
    open_, out = np.zeros(valid.shape, dtype=bool), []
    ways = ((order, REMOVED), (-order, KEPT))
    covered = [np.zeros(valid.shape, dtype=bool) for _ in ways]

    def extend(way: int, at_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches right and left with the nearest rows, in the order of at_rows; notes what they cover."""
        far, near = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for other in nearest_earlier(gram[at_rows], ways[way][0][at_rows]):
            has = np.flatnonzero(other >= 0)
            i, j = at_rows[has], at_rows[other[has]]
            r, s = _common(right, nr, i, j), _common(left, nl, i, j)
            far[i], near[i] = np.maximum(far[i], r), np.maximum(near[i], s)
            long = r + s >= REACH
            i, r, s = i[long], r[long], s[long]
            covered[way][i] |= (_STARTS >= REACH - r[:, None]) & (_STARTS <= s[:, None])
            out.append((np.full(len(i), ways[way][1]), gram[i], row[i], doc[i], at[i] - s, at[i] + GRAM + r))
        return far, near

    runs = np.cumsum(np.r_[0, gram[1:] != gram[:-1]])
    for way in range(2):
        far, _ = extend(way, np.arange(len(row)))
        maybe = valid & (_STARTS >= REACH - far[:, None]) & ~covered[way]
        again = np.flatnonzero(np.isin(runs, runs[maybe.any(axis=1)]))  # whole runs, ordered by the words to the left
        if len(again):
            keys = np.concatenate([_coded(gram[again].view(np.uint64)), left_raw[again], right_raw[again]], axis=1)
            by_left = again[np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")]
            _, near = extend(way, by_left)
            open_ |= maybe & (_STARTS <= near[:, None]) & ~covered[way]
    for edge, end in ((first_edge, 0), (last_edge, len(row) - 1)):
        if edge:  # what lies beyond shares no more words to the right than the outermost row does
            i = np.flatnonzero(runs == runs[end])
            beyond = _common(right, nr, i, np.full(len(i), end))
            open_[i] |= valid[i] & (_STARTS >= REACH - beyond[:, None]) & ~(covered[0][i] & covered[1][i])
    for o in _STARTS:
        i = np.flatnonzero(open_[:, o])
        h = window_hashes(gram[i], left[i], right[i], int(o)).view(np.int64)
        out.append((np.full(len(i), OPEN), gram[i], row[i], doc[i], at[i] - o, h))
    k, *rest = (np.concatenate(c) for c in zip(*out))
    some = pd.DataFrame({"kind": k.astype(np.int32), **dict(zip(("gram", "row", "doc_id", "first", "last"), rest))}).drop_duplicates()
    return pa.RecordBatch.from_pandas(some, preserve_index=False)


def _neighbours(sorted_suffixes: DataFrame) -> DataFrame:
    """Step 2 and what it leaves OPEN, by partitions of the sorted suffixes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, edge = 0, True
        for b in batches:
            held, rows = [*held, b] if b.num_rows else held, rows + b.num_rows
            if rows < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("gram").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[-1])  # the last run may go on in the next batch
            yield compared(t.slice(0, cut or rows), edge, not cut)
            held, edge = t.slice(cut).to_batches() if cut else [], not cut
            rows = rows - cut if cut else 0
        if rows:
            yield compared(pa.Table.from_batches(held), edge, True)

    return sorted_suffixes.mapInArrow(shared.released(scan), _FOUND)


def _looked_up(contexts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Spans of the windows in wanted (columns of _FOUND) that another document has: (kind, row, first, last)."""
    from tracewright.llm.url_filter import Level

    filters = [shared.wanted_bits(wanted.select(c).distinct(), c) for c in ("gram", "last")]
    names = [contexts.columns.index(c) for c in ("gram", "row", "doc_id", "right", "left")]

    def rows(batches):
        of_gram, of_window = (None if f is None else Level(*f.value) for f in filters)
        for whole in batches:
            if of_gram is not None:
                whole = whole.filter(pa.array(of_gram.has(whole.column(names[0]).to_numpy().view(np.uint64))))
            if not whole.num_rows:
                continue
            gram, row, doc = (whole.column(c).to_numpy() for c in names[:3])
            (right, nr, _), (left, nl, _) = (_unpacked(whole.column(c).to_pylist()) for c in names[3:])
            for o in _STARTS:
                i = np.flatnonzero((nl >= o) & (nr >= REACH - o))
                h = window_hashes(gram[i], left[i], right[i], int(o))
                if of_window is not None:
                    hit = of_window.has(h)
                    i, h = i[hit], h[hit]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(row[i]), pa.array(doc[i])], names=["h", "row", "doc_id"])

    holder = F.struct("doc_id", "row")
    ends = contexts.mapInArrow(shared.released(rows), "h long, row long, doc_id long").groupBy("h").agg(F.min(holder).alias("least"), F.max(holder).alias("most")).where("least <> most")
    asked = wanted.select(F.col("last").alias("h"), "row", "first").join(ends, "h")
    return asked.select(F.when(F.col("row") == F.col("least.row"), KEPT).otherwise(REMOVED).alias("kind"), "row", "first", (F.col("first") + MIN_WORDS).alias("last"))


def _merged(spans: DataFrame) -> DataFrame:
    """One row per document: removed and kept, arrays of (first, last) word numbers, merged where they touch; kept ones without removed words."""

    def join(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(pairs):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def without(spans: list[tuple[int, int]], cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for a, b in spans:
            for c, d in cut:
                if c < b and d > a:
                    if c > a:
                        out.append((a, c))
                    a = max(a, d)
            if a < b:
                out.append((a, b))
        return out

    def rows(batches):
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for b in batches:
            gone, first = ([join([(x["first"], x["last"]) for x in xs if x["kind"] == k]) for xs in b.column(1).to_pylist()] for k in (REMOVED, KEPT))
            sets = [gone, [without(f, g) for f, g in zip(first, gone)]]
            arrays = [pa.array([[{"first": a, "last": e} for a, e in s] for s in col], kind) for col in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["row", "removed", "kept"])

    each = spans.groupBy("row").agg(F.collect_set(F.struct("kind", "first", "last")).alias("xs"))  # as many as a document has suffixes
    return each.mapInArrow(shared.released(rows), "row long, removed array<struct<first: long, last: long>>, kept array<struct<first: long, last: long>>")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that share a passage of MIN_WORDS or more words with another one, and no others.

    Columns: doc_id, code (of its words), words, removed and kept: arrays of (first, last) word numbers, last exclusive.
    """
    spark = docs.sparkSession
    folder, n = shared.work_folder(spark), shared.shuffle_partitions(spark)
    all_docs = shared.staged(_documents(docs, key, text).where("doc_id IS NOT NULL AND size(at) > 0").withColumn("row", F.xxhash64("doc_id", "code")), folder, "documents")
    classes = all_docs.groupBy("code").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.max(F.struct("doc_id", "row")).alias("most"), F.max("words").alias("words"))
    classes = shared.staged(classes.select("code", F.col("least.row").alias("least"), (F.col("least") != F.col("most")).alias("several"), "words"), folder, "classes")

    own = all_docs.join(classes.select("code", "least"), "code").where("row = least")
    suffixes = own.select("row", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("row", "x.at", "x.gram")
    shared_grams = suffixes.groupBy("gram").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("gram")
    positions = suffixes.join(shared_grams, "gram").groupBy("row").agg(F.collect_set("at").alias("at"))
    wanted = positions.join(own.select("row", "doc_id", "code").distinct(), "row").select("row", "doc_id", "code", "at")
    wanted = shared.staged(wanted, folder, "wanted")
    contexts = shared.staged(_contexts(wanted, docs, key, text), folder, "contexts")

    ranged = contexts.repartitionByRange(n, "gram", "right", "left", "row").sortWithinPartitions("gram", "right", "left", "row")
    found = shared.staged(_neighbours(ranged), folder, "found")
    exact = _looked_up(contexts, found.where(F.col("kind") == OPEN))

    copies = all_docs.join(classes.where("several"), "code").select(F.when(F.col("row") == F.col("least"), KEPT).otherwise(REMOVED).alias("kind"), "row", F.lit(0).cast("long").alias("first"), classes["words"].alias("last"))
    spans = found.where(F.col("kind") != OPEN).select("kind", "row", "first", "last").union(exact).union(copies)
    by_row = all_docs.select("row", "doc_id", "code", "words").dropDuplicates(["row"])
    return shared.staged(_merged(spans).join(by_row, "row").select("doc_id", "code", "words", "removed", "kept"), folder, "spans")


def cut_words(data: bytes, spans: list[tuple[int, int]], words: Words) -> bytes:
    """The text without the words of the spans and the white space after them."""
    out, at = [], 0
    for a, e in spans:
        out.append(data[at : words.starts[a]])
        at = int(words.starts[e]) if e < len(words.starts) else len(data)
    return b"".join([*out, data[at:]])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, their texts without passages that an earlier document holds. Other rows keep their texts."""
    at, cut = shared.fresh(docs, "at", "cuts")
    spans = repeated_spans(docs, key, text).where("size(removed) > 0").groupBy(F.col("doc_id").alias(at)).agg(F.collect_list(F.struct("code", "removed")).alias(cut))  # one per text of an id
    maybe = shared.filter_of(spans.select(at), at)(F.col(key))  # only these rows are shuffled
    joined = docs.where(maybe).withColumn(at, F.col(key).cast("long")).join(spans.hint("merge"), at, "left").drop(at)

    def rows(batches):
        for b in batches:
            of, cuts = b.schema.get_field_index(text), b.column(b.schema.get_field_index(cut))
            texts = b.column(of)
            if cuts.null_count < len(cuts):
                changed = texts.to_pylist()
                for i, found in enumerate(cuts.to_pylist()):
                    if found and changed[i]:
                        data = changed[i].encode()
                        raw = np.frombuffer(data, dtype=np.uint8)
                        w = split_words(raw, np.array([0, len(raw)]), fold=False)
                        code = document_code(w.hashes)
                        for x in found:
                            if x["code"] == code:
                                changed[i] = cut_words(data, [(s["first"], s["last"]) for s in x["removed"]], w).decode()
                texts = pa.array(changed, texts.type)
            keep = [i for i in range(b.num_columns) if b.schema.names[i] != cut]
            yield pa.RecordBatch.from_arrays([texts if i == of else b.column(i) for i in keep], names=[b.schema.names[i] for i in keep])

    return docs.where(~maybe).unionByName(joined.mapInArrow(shared.released(rows), docs.schema))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage: of documents that share one of MIN_WORDS or more words, whether kept or removed there."""
    found = repeated_spans(shared.table(spark, sf_dir, "documents"))
    spans = "concat(transform(removed, x -> struct(false AS kept, x.first AS f, x.last AS l)), transform(kept, x -> struct(true AS kept, x.first AS f, x.last AS l)))"
    return found.select("doc_id", "words", F.explode(F.expr(spans)).alias("x")).selectExpr("doc_id", "x.f AS first_word", "x.l AS last_word", "x.l - x.f AS n_words", "x.kept AS kept", "words AS doc_words")
