"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; tokens under its zeros are ignored, so a
few substituted tokens still leave seeds that agree.  Seed hashes of the documents are
joined to those of the benchmark; around each hit the two token sequences are laid side
by side and the best-scoring run of agreeing tokens (a match counts 1, a substitution
-1.5) is measured.  A document is contaminated by an item if the matches of that run
reach `min_match` tokens, or four fifths of a shorter item.

Tokens are runs of letters, digits and bytes above ASCII, A-Z lower-cased, so that case
and punctuation do not hide a passage.

Hash joins run against sorted hashes inside Arrow batches, so documents are not shuffled
and a passage that many documents share costs each only its own hits.  Hits count by
alignment (document, item, place of the item's first token in the document): a run of equal
seeds in a document and one in an item give an interval of alignments, not all pairs of
their places, and hits are worked off in slices of bounded size, so a text that repeats a
token against an item that does costs no more than their lengths.

The benchmark's hashes are broadcast in blocks of at most `BLOCK_TOKENS` tokens.  A larger
benchmark is worked off block by block against all documents: each block's hits are written
to the shared folder, and its broadcast is gone, before the next block is made.

Nulls and edges: a null or empty text is clean; a null or empty benchmark text, or one
shorter than the shortest seed (5 tokens), marks nothing.  Items equal to each other are
all listed.  A null item id is dropped from the lists, yet its text marks documents.
Repeated rows are judged each.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwell.llm import kernels as K
from stepwell.llm import tables as S

#: The masks.  The first is contiguous; the others ignore positions.
MASKS = ("1111111", "110101100111", "1101100011011", "101100110100111")
#: Masks that items of fewer than `MIN_MATCH` tokens have besides, with a token ignored in the middle.
SHORT_MASKS = ("11111", "1110111", "1101011", "1011101")
#: Most benchmark tokens broadcast at once: 8 bytes a token, and 16 for each of its seeds.
BLOCK_TOKENS = 1 << 20
MIN_MATCH, MISS = 13, 1.5
_FILTER_BITS = 22
#: Pairs of runs of equal seeds worked off at a time.
SLICE = 1 << 20


def _seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the tokens under the mask's ones, from each place on."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ones = [i for i, c in enumerate(mask) if c == "1"]
    weights = K.stream(int(mask, 2), len(ones)) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for w, i in zip(weights, ones, strict=True):
            total += tokens[i : i + n] * w
    return K.mix(total)


class Benchmark:
    """Token hashes of a block of benchmark items and, for each mask, sorted seed hashes with their places."""

    def __init__(self, items: list[tuple[int | None, str | None]], masks: tuple[str, ...] = MASKS + SHORT_MASKS):
        body, offsets = K.column(pa.array([t or "" for _, t in items], pa.string()))
        w = K.words(body, offsets, K.PUNCTUATION, lower=True)
        self.tokens, self.first = w.hashes, w.first
        self.ids = [i for i, _ in items]
        self.masks, self.seeds = masks, []  # of each mask the hashes of runs of equal seeds, sorted, and a filter
        runs, n = [], 0
        for mask in masks:
            hashes = _seeds(self.tokens, mask)
            at = np.arange(len(hashes))
            item = np.searchsorted(self.first, at, side="right") - 1
            inside = at + len(mask) <= self.first[item + 1] if len(at) else at.astype(bool)
            if mask in SHORT_MASKS:
                inside &= np.diff(self.first)[item] < MIN_MATCH if len(at) else True
            start, size = _runs(at[inside], hashes[inside], item[inside])
            hashes = hashes[start]
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.seeds.append((hashes[order], n, bits))
            runs.append((start[order], size[order]))
            n += len(order)
        self.start, self.size = (np.concatenate([x[i] for x in runs]) for i in (0, 1))
        self.item = np.searchsorted(self.first, self.start, side="right") - 1

    def alignments(self, tokens: np.ndarray, first: np.ndarray):
        """Of some documents at a time the intervals of alignments with a seed hit: (document, item, least, most), sorted."""
        met = []
        for mask, (hashes, offset, bits) in zip(self.masks, self.seeds, strict=True):
            own = _seeds(tokens, mask) if len(hashes) else hashes
            at = np.flatnonzero(bits[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            document = np.searchsorted(first, at, side="right") - 1
            inside = at + len(mask) <= first[document + 1] if len(at) else at.astype(bool)
            start, size = _runs(at[inside], own[at[inside]], document[inside])
            low, high = np.searchsorted(hashes, own[start]), np.searchsorted(hashes, own[start], side="right")
            some = high > low
            met.append(np.stack([np.searchsorted(first, start[some], side="right") - 1, start[some], size[some], low[some] + offset, high[some] - low[some]]))
        met = np.concatenate(met, axis=1)
        met = met[:, np.argsort(met[0], kind="stable")]
        ends = np.cumsum(met[4])
        held, a = np.zeros((4, 0), np.int64), 0
        while a < met.shape[1]:
            b = max(int(np.searchsorted(ends, ends[a] - met[4, a] + SLICE, side="right")), a + 1)
            document, start, size, low, n = met[:, a:b]
            run = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, length = np.repeat(start, n), np.repeat(size, n)
            inner = self.start[run] - self.first[self.item[run]]
            held = _merged(np.concatenate([held, np.stack([np.repeat(document, n), self.item[run], at - inner - self.size[run] + 1, at + length - 1 - inner])], axis=1))
            a = b
            done = held[0] < met[0, a] if a < met.shape[1] else np.ones(held.shape[1], bool)  # all documents but the last
            yield held[:, done]
            held = held[:, ~done]

    def overlap(self, tokens: np.ndarray, start: int, stop: int, item: int, begin: int) -> int:
        """Matches of the best-scoring run when the item's first token is laid at `begin`."""
        a, b = int(self.first[item]), int(self.first[item + 1])
        left, right = max(start, begin), min(stop, begin + b - a)
        same = tokens[left:right] == self.tokens[a + left - begin : a + right - begin]
        score = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -MISS))])
        lowest = np.minimum.accumulate(score)
        end = int(np.argmax(score - lowest))
        return int(same[int(np.argmin(score[: end + 1])) : end].sum())


def _runs(places: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal hashes at consecutive places of one owner; places are sorted."""
    if not len(places):
        return places, places
    cut = np.concatenate([[True], (np.diff(places) != 1) | (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(cut)
    return places[begin], np.diff(np.append(begin, len(places)))


def _merged(rows: np.ndarray) -> np.ndarray:
    """Intervals (document, item, least, most), sorted and joined where they meet."""
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    if not rows.shape[1]:
        return rows
    other = np.concatenate([[False], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
    group = np.cumsum(other) << 40  # places are below 2^39
    most = np.maximum.accumulate(group + rows[3])
    begin = np.flatnonzero(np.concatenate([[True], group[1:] + rows[2, 1:] > most[:-1] + 1]))
    out = rows[:, begin]
    out[3] = (most - group)[np.append(begin[1:], rows.shape[1]) - 1]
    return out


def needed(length: int, min_match: int = MIN_MATCH) -> int:
    return min(min_match, -(-4 * length // 5))


def judge(bench: Benchmark, body: np.ndarray, offsets: np.ndarray, min_match: int = MIN_MATCH) -> dict[int, dict[int, int]]:
    """Of each contaminated document (by place in the batch) its items and their overlaps."""
    found: dict[int, dict[int, int]] = {}
    for a, b in K.pieces(offsets, 2 << 20):
        w = K.words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.PUNCTUATION, lower=True)
        for rows in bench.alignments(w.hashes, w.first):
            for document, item, least, most in rows.T.tolist():
                start, stop, size = int(w.first[document]), int(w.first[document + 1]), int(bench.first[item + 1] - bench.first[item])
                own = found.get(a + document, {})
                best = own.get(item, 0)
                for begin in range(least, most + 1):
                    if min(stop, begin + size) - max(start, begin) > best:  # else it cannot be longer
                        best = max(best, bench.overlap(w.hashes, start, stop, item, begin))
                if best >= needed(size, min_match):
                    found.setdefault(a + document, own)[item] = best
    return found


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_tokens: int = BLOCK_TOKENS):
    """The benchmark in broadcast blocks of bounded size, one after the other: each is gone when the next is asked for."""
    spark = benchmark.sparkSession
    two = S.two(benchmark, id_col, text_col).filter(F.length("text") > 0)
    size = two.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a token has a byte at least, and one between
    n = max(1, -(-int(size) // (2 * block_tokens)))
    for b in range(n):
        part = two if n == 1 else two.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        shared = spark.sparkContext.broadcast(Benchmark([(r.id, r.text) for r in part.toLocalIterator()]))
        yield shared, n
        if n > 1:
            shared.destroy()


class Found(NamedTuple):
    items: list[int]
    n: int
    most: int


_CLEAN = Found([], 0, 0)
_FOUND = T.StructType().add("id", "long").add("items", T.ArrayType(T.LongType())).add("n_items", "integer").add("overlap", "integer")


def _pass(shared, text_at: int, min_match: int):
    def search(batches):
        for batch in batches:
            body, offsets = K.column(batch.column(text_at))
            bench = shared.value
            found = judge(bench, body, offsets, min_match)
            yield batch, {p: Found(sorted({bench.ids[i] for i in own} - {None}), len(own), max(own.values())) for p, own in found.items()}

    return search


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row: id, contaminated, items (sorted ids), n_items, overlap (the largest, in tokens)."""
    S.tune(df.sparkSession)
    two = S.two(df, id_col, text_col)
    blocks = benchmark_blocks(benchmark, item_col, item_text, block_tokens)
    shared, n = next(blocks)
    if n == 1:
        return _shown(two.mapInArrow(_verdicts(_pass(shared, 1, min_match)), _FOUND))
    numbered = S.save(two.withColumn("row", F.monotonically_increasing_id()), "rows")
    every = _hits(numbered.select("row", "text"), shared, blocks, min_match)
    every = every.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_items").cast("int").alias("n_items"), F.max("overlap").alias("overlap"))
    out = numbered.select("row", F.col("id").alias("own")).join(every, F.col("row") == F.col("id"), "left")
    return _shown(out.select(F.col("own").alias("id"), "items", "n_items", "overlap"))


def _hits(rows: DataFrame, shared, blocks, min_match: int) -> DataFrame:
    """Verdicts on the contaminated of the rows (number, text), block by block: each block's are written before the next is made."""
    out = None
    while shared is not None:
        found = S.save(rows.mapInArrow(_verdicts(_pass(shared, 1, min_match), hits_only=True), _FOUND), "hits")
        out = found if out is None else out.unionByName(found)
        shared, _ = next(blocks, (None, 0))
    return out


def _shown(found: DataFrame) -> DataFrame:
    n = F.coalesce("n_items", F.lit(0))
    return found.select("id", (n > 0).alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), n.alias("n_items"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def _verdicts(search, hits_only: bool = False):
    def verdicts(batches):
        for batch, found in search(batches):
            ids, empty = K.ids_of(batch.column(0))
            at = np.array(sorted(found) if hits_only else range(batch.num_rows), np.int64)
            own = [found.get(p, _CLEAN) for p in at.tolist()]
            yield pa.RecordBatch.from_arrays([K.long_array(ids[at], empty[at]), pa.array([f.items for f in own], pa.list_(pa.int64())), pa.array([f.n for f in own], pa.int32()), pa.array([f.most for f in own], pa.int32())], names=["id", "items", "n_items", "overlap"])

    return verdicts


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows that no benchmark item contaminates, with all their columns."""
    S.tune(df.sparkSession)
    at, names = df.columns.index(text_col), df.columns
    blocks = benchmark_blocks(benchmark, item_col, item_text, block_tokens)
    shared, n = next(blocks)
    if n == 1:
        search = _pass(shared, at, min_match)

        def keep(batches):
            for batch, found in search(batches):
                stay = np.ones(batch.num_rows, bool)
                stay[list(found)] = False
                yield batch.filter(pa.array(stay))

        return df.mapInArrow(keep, df.schema)
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    numbered = S.save(inner.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = _hits(numbered.select("row", F.col(f"c{at}").cast("string")), shared, blocks, min_match)
    return numbered.join(found.select(F.col("id").alias("row")), "row", "left_anti").select(inner.columns).toDF(*names)
