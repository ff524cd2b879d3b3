"""Substring deduplication by super-k-mer partitioning.

A window is k consecutive words of one document; a window whose word sequence starts
anywhere else, in the same document or another, is a repeat, and every word that a repeat
covers is removed.  Repeats are judged on the input, not on what is left.

Consecutive windows that share a minimiser (the least hash among their m-word grams, at
one place) form a super-k-mer, a run of at most k - m + 1 windows that travels as one
packed string to the bucket of its minimiser.  Equal windows have equal minimisers, so
they meet in a bucket, where sorting the windows' bytes counts them exactly; hashes only
choose buckets.

Passes, each a table in the shared folder:

1. documents are packed into compressed blocks;
2. each block sends its minimisers' hashes, each once and marked if it has it more than
   once; a hash that no other super-k-mer has cannot hold a repeat, since no window is
   twice in a super-k-mer;
3. for hashes met twice or more, each block sends its super-k-mers as packed strings, each
   distinct string once with its number of occurrences, so that a passage in a third of
   all documents reaches its bucket once a block; documents with no such hash are done;
4. buckets sort the windows of the strings and answer with a bit for each window;
5. blocks map the bits to their words and give each document's result.

What a bucket gets for one passage is bounded by the number of blocks, not by its
occurrences; buckets are as many as the packed bytes need.

Nulls and edges: a null text has no words; a text of fewer than k words has no window and
keeps all.  Repeated rows are documents of their own, so their windows repeat.  A null
identifier stays null.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import kernels as K
from stepwell.llm import tables as S

WINDOW, GRAM = 35, 8


class Supers:
    """Super-k-mers of a block: first word, number of windows, and minimiser hash of each."""

    def __init__(self, w: K.Words, window: int, gram: int):
        grams = K.grams(w.hashes, gram)
        span = window - gram + 1  # grams of a window
        none = np.zeros(0, np.int64)
        self.first, self.windows, self.hashes = none, none, none.astype(np.uint64)
        if len(w.hashes) < window:
            return
        # leftmost place of the least gram of each window, by doubling
        best, reach = np.arange(len(grams)), 1
        while 2 * reach <= span:
            best = _less(grams, best[: len(best) - reach], best[reach:])
            reach *= 2
        if reach < span:
            best = _less(grams, best[: len(best) - (span - reach)], best[span - reach :])
        # windows that stay within a document
        starts, ends = w.first[:-1], w.first[1:] - window + 1
        n = np.maximum(ends - starts, 0)
        if not n.sum():
            return
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        place = best[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(cut)
        self.first, self.windows = at[begin], np.diff(np.append(begin, len(at)))
        self.hashes = K.mix(grams[place[begin]])


def _less(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(grams[a] <= grams[b], a, b)


def _spaced(body: np.ndarray, w: K.Words, kept: np.ndarray) -> list[bytes]:
    """Of each document the kept words, joined by one space."""
    out = []
    flags = kept.tolist() if not kept.all() else None
    data = body.tobytes()
    starts, ends = w.starts.tolist(), w.ends.tolist()
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if flags is None:
            out.append(b" ".join([data[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)]))
        else:
            out.append(b" ".join([data[s:e] for s, e, f in zip(starts[a:b], ends[a:b], flags[a:b], strict=True) if f]))
    return out


def joined(body: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each document's words joined by one space, for documents that keep all."""
    if not len(body):
        return [b""] * (len(offsets) - 1)
    gap = K.SPACE[body]
    begins = np.zeros(len(body), bool)
    at = offsets[:-1][offsets[:-1] < len(body)]
    begins[at] = True
    after = np.ones(len(body), bool)  # white space, or a document's first byte, comes before
    after[1:] = gap[:-1]
    after |= begins
    keep = ~(gap & after)
    total = np.concatenate([[0], np.cumsum(keep)])
    flat = body[keep].copy()
    flat[gap[keep]] = 0x20
    data, ends = flat.tobytes(), total[offsets]
    return [data[a:b].removesuffix(b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_HASHES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary())])
_REPEATED = pa.schema([("block", pa.int64()), ("hashes", pa.binary())])
_SPLIT_SQL = "kind int, block long, ids binary, n_words binary, sha binary, lens binary, text binary, first binary, windows binary, which binary, n int, bucket int, size long, keys binary, counts binary, ends binary, strings binary"
_SPLIT = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("n_words", pa.binary()), ("sha", pa.binary()), ("lens", pa.binary()), ("text", pa.binary()), ("first", pa.binary()), ("windows", pa.binary()), ("which", pa.binary()), ("n", pa.int32()), ("bucket", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("ends", pa.binary()), ("strings", pa.binary())])
_BITS = pa.schema([("block", pa.int64()), ("bits", pa.binary())])
_OUT_SQL = "id long, n_words long, n_removed long, kept_sha256 string"
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _minimisers(window: int, gram: int, buckets: int):
    def send(batches):
        for batch in batches:
            for row in S.rows(batch):
                _, _, body, offsets = S.unpack(row)
                hashes, counts = np.unique(Supers(K.words(body, offsets), window, gram).hashes, return_counts=True)
                where = (K.mix(hashes) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                met, begins = np.unique(where[order], return_index=True)  # only buckets that get something
                found = []
                for p, own in zip(met.tolist(), np.split(order, begins[1:]), strict=False):
                    found.append({"bucket": p, "block": row["block"], "n": len(own), "hashes": hashes[own].tobytes(), "more": (counts[own] > 1).astype(np.uint8).tobytes()})
                yield S.record(found, _HASHES)

    return send


def _met_twice(batches):
    """Of each bucket the hashes that two super-k-mers or more have, told to the blocks that have them."""
    for _, held in S.grouped(batches):
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in held])
        more = np.concatenate([np.frombuffer(r["more"], np.uint8) for r in held])
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        total = counts + np.bincount(inverse, weights=more).astype(np.int64)
        again = total[inverse] > 1
        edges = np.concatenate([[0], np.cumsum([r["n"] for r in held])])
        found = [{"block": r["block"], "hashes": hashes[a:b][again[a:b]].tobytes()} for r, a, b in zip(held, edges[:-1].tolist(), edges[1:].tolist(), strict=True) if again[a:b].any()]
        yield S.record(found, _REPEATED)


def _split(window: int, gram: int, buckets: int):
    """Documents that are done, documents that wait with their super-k-mers, and the packed strings."""

    def split(batches):
        for batch in batches:
            for row in S.rows(batch):
                yield from one(row)

    def one(row):
        ids, empty, body, offsets = S.unpack(row)
        w = K.words(body, offsets)
        supers = Supers(w, window, gram)
        again = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in row["repeated"] or []] + [np.zeros(0, np.uint64)]))
        hit = np.isin(supers.hashes, again)
        document = np.searchsorted(w.first, supers.first[hit], side="right") - 1
        waits = np.zeros(len(ids), bool)
        waits[document] = True
        done = ~waits
        if done.any():
            sha = [hashlib.sha256(t).digest() for t, d in zip(joined(body, offsets), done.tolist(), strict=True) if d]
            yield S.record([{"kind": 0, "block": row["block"], "n": int(done.sum()), "ids": S.squeeze(np.concatenate([ids[done], empty[done].astype(np.int64)])), "n_words": S.squeeze(w.counts[done]), "sha": b"".join(sha)}], _SPLIT)
        if not waits.any():
            return
        first, windows, hashes = supers.first[hit], supers.windows[hit], supers.hashes[hit]
        data = body.tobytes()
        which, known = np.zeros(len(first), np.int64), {}
        strings: list[bytes] = []
        keys: list[int] = []
        counts: list[int] = []
        starts, ends = w.starts.tolist(), w.ends.tolist()
        for i, (a, n, h) in enumerate(zip(first.tolist(), windows.tolist(), hashes.tolist(), strict=True)):
            text = b" ".join([data[s:e] for s, e in zip(starts[a : a + n + window - 1], ends[a : a + n + window - 1], strict=True)])
            j = known.setdefault((h, text), len(strings))
            if j == len(strings):
                strings.append(text)
                keys.append(h)
                counts.append(0)
            counts[j] += 1
            which[i] = j
        # words of waiting documents only, so that first words are counted from their own start
        skipped = np.concatenate([[0], np.cumsum(np.where(waits, 0, w.counts))])
        moved = first - skipped[document]
        lens = np.diff(offsets)
        kept = np.repeat(waits, lens)
        yield S.record([{"kind": 1, "block": row["block"], "n": int(waits.sum()), "ids": S.squeeze(np.concatenate([ids[waits], empty[waits].astype(np.int64)])), "lens": S.squeeze(lens[waits]), "text": S.squeeze(body[kept]), "first": S.squeeze(moved.astype(np.int32)), "windows": S.squeeze(windows.astype(np.uint8)), "which": S.squeeze(which.astype(np.int32))}], _SPLIT)
        key = np.array(keys, np.uint64)
        where = (K.mix(key) % np.uint64(buckets)).astype(np.int64)
        count = np.minimum(np.array(counts, np.int64), 2).astype(np.uint8)
        found = []
        order = np.argsort(where, kind="stable")
        met, begins = np.unique(where[order], return_index=True)
        for p, own in zip(met.tolist(), np.split(order, begins[1:]), strict=False):
            part = [strings[i] for i in own.tolist()]
            size = sum(map(len, part))
            found.append({"kind": 2, "block": row["block"], "bucket": p, "n": len(own), "size": size, "which": own.astype(np.int32).tobytes(), "keys": key[own].tobytes(), "counts": count[own].tobytes(), "ends": np.cumsum([len(x) for x in part]).astype(np.int32).tobytes(), "strings": S.squeeze(b"".join(part), 3)})
        for a in range(0, len(found), 64):
            yield S.record(found[a : a + 64], _SPLIT)

    return split


def _windows(text: bytes, window: int) -> list[bytes]:
    data = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(data == 0x20)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(text)]
    return [text[a:b] for a, b in zip(starts, ends[window - 1 :], strict=False)]


def _count(window: int):
    """Sort the windows of a bucket's strings; a bit for each window of each string that is a repeat."""

    def count(batches):
        for _, held in S.grouped(batches):
            yield from bucket(held)

    def bucket(held):
        strings: dict[tuple[int, bytes], int] = {}
        total: list[int] = []
        members = []
        for r in held:
            data, ends = S.expand(r["strings"]), np.frombuffer(r["ends"], np.int32).tolist()
            keys, counts = np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["counts"], np.uint8).tolist()
            own = []
            for a, b, key, n in zip([0, *ends[:-1]], ends, keys, counts, strict=True):
                j = strings.setdefault((key, data[a:b]), len(total))
                if j == len(total):
                    total.append(0)
                total[j] += n
                own.append(j)
            members.append((r["block"], r["which"], own))
        by_key: dict[int, list[tuple[bytes, int]]] = {}
        for (key, text), j in strings.items():
            by_key.setdefault(key, []).append((text, j))
        bits = [0] * len(total)
        for group in by_key.values():
            if len(group) == 1:  # no window is twice in one super-k-mer
                text, j = group[0]
                if total[j] > 1:
                    bits[j] = (1 << (text.count(b" ") + 2 - window)) - 1
                continue
            met = [(x, j, i) for text, j in group for i, x in enumerate(_windows(text, window))]
            met.sort()
            a = 0
            while a < len(met):
                b, n = a, 0
                while b < len(met) and met[b][0] == met[a][0]:
                    n += total[met[b][1]]
                    b += 1
                if n > 1:
                    for _, j, i in met[a:b]:
                        bits[j] |= 1 << i
                a = b
        found = []
        for block, which, own in members:
            mask = np.array([bits[j] for j in own], np.uint64)
            if mask.any():
                hit = np.flatnonzero(mask)
                found.append({"block": block, "bits": S.squeeze(np.concatenate([np.frombuffer(which, np.int32)[hit].astype(np.uint64), mask[hit]]))})
        yield S.record(found, _BITS)

    return count


def _finish(window: int):
    def finish(batches):
        for batch in batches:
            for row in S.rows(batch):
                ids, empty, body, offsets = S.unpack(row)
                w = K.words(body, offsets)
                first, windows, which = (S.numbers(row[k], t).astype(np.int64) for k, t in (("first", np.int32), ("windows", np.uint8), ("which", np.int32)))
                bits = np.zeros(int(which.max()) + 1, np.uint64)
                for part in row["bits"] or []:
                    both = S.numbers(part, np.uint64)
                    bits[both[: len(both) // 2].astype(np.int64)] = both[len(both) // 2 :]
                mask, cover = bits[which], np.zeros(len(w.starts) + 1, np.int64)
                for i in range(int(windows.max())):
                    at = first[((mask >> np.uint64(i)) & np.uint64(1)).astype(bool)] + i
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                kept = np.cumsum(cover)[:-1] == 0
                total = np.concatenate([[0], np.cumsum(~kept)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                sha = [hashlib.sha256(t).hexdigest() for t in _spaced(body, w, kept)]
                yield pa.RecordBatch.from_arrays([K.long_array(ids, empty), pa.array(w.counts), pa.array(removed), pa.array(sha, pa.string())], schema=_OUT)

    return finish


def _done(batches):
    for batch in batches:
        for row in S.rows(batch):
            both, counts = S.numbers(row["ids"], np.int64), S.numbers(row["n_words"], np.int64)
            n = len(counts)
            sha = [row["sha"][32 * i : 32 * i + 32].hex() for i in range(n)]
            yield pa.RecordBatch.from_arrays([K.long_array(both[:n], both[n:].astype(bool)), pa.array(counts), pa.array(np.zeros(n, np.int64)), pa.array(sha, pa.string())], schema=_OUT)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row: id, n_words, n_removed and the SHA-256 of the kept words joined by one space.

    At most 64 windows may share a minimiser: ``window - gram`` stays below 64.
    """
    if not 0 < gram <= window or window - gram >= 64:
        raise ValueError("gram is 1 to window words, and window - gram below 64")
    spark = df.sparkSession
    blocks = S.block_table(df, id_col, text_col)
    size = blocks.df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = S.partitions(spark, size // 2)
    buckets = 4 * tasks  # several a task, so that tasks are even
    sent = blocks.df.mapInArrow(_minimisers(window, gram, buckets), "bucket int, block long, n int, hashes binary, more binary")
    again = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_met_twice, "block long, hashes binary")
    again = again.groupBy("block").agg(F.collect_list("hashes").alias("repeated"))
    tasks = S.partitions(spark, size * 2, 8 << 20)
    buckets = 4 * tasks
    whole = blocks.df.join(again, "block", "left")
    parts = S.save(whole.mapInArrow(_split(window, gram, buckets), _SPLIT_SQL), "supers")
    blocks.drop()
    packed = parts.filter("kind = 2").select("bucket", "block", "which", "keys", "counts", "ends", "strings")
    bits = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(window), "block long, bits binary")
    bits = bits.groupBy("block").agg(F.collect_list("bits").alias("bits"))
    waiting = parts.filter("kind = 1").select("block", "ids", "lens", "text", "first", "windows", "which").join(bits, "block", "left")
    done = parts.filter("kind = 0").select("ids", "n_words", "sha").mapInArrow(_done, _OUT_SQL)
    return done.unionByName(waiting.mapInArrow(_finish(window), _OUT_SQL))
