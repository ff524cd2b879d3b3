"""N-gram Jaccard join by chosen paths.

A text is the set of its runs of five consecutive words (A-Z lower-cased); a text of one
to four words is the set of one run, all of it.  Two texts link if the Jaccard similarity
of their sets is at least the threshold.

Texts with the same set are one class of copies.  Each class has a vector of 128 min-hash
tokens, sampled shared tokens of its set.  A run starts a path with one coordinate's
token; texts with the same path so far form a bucket; a bucket of more than `leaf` members
is split by another coordinate, which the path itself chooses, and so on.  Small buckets
are brute-forced.  A pair of similarity s survives d splits of one run with probability
s^(d+1); the number of runs is the least that finds a pair at the threshold, after the
most splits, with the target recall.  Sizes of buckets are a table before paths are joined to
them, so a bucket that holds much of the corpus is one that Spark splits in the join.

Near copies fall into one large bucket in every run, and splits do not part them.  So one
member of each large bucket is held against all others before the first split; components
of the candidates found so, over all runs, need no pairs inside.  A bucket in which at most
`leaf` members are outside its largest component ends there: these are held against all
its members in tiles of blocks against blocks.  Others are split, and what still is large
after the last split ends likewise, so no bucket is capped and no task gets a whole large one.

A bucket gives, of the pairs that the vectors make candidates, only a spanning forest, not
the pairs.  Components of these forests are then verified: inside each, exact similarities
of all pairs are computed on whole sets (in tiles, for large components), which gives each
text's number of links and, from a spanning forest of the true links, its class.

A class stands for its texts by the row with the least identifier, which is found again by
identifier and a hash of its text: rows that share an identifier, or have none, do not meet.

Nulls and edges: a null or empty text has an empty set, links to nothing and is a class of
its own.  A null identifier is allowed and ranks last as a class's name.  Repeated rows
are copies.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwell.llm import kernels as K
from stepwell.llm import tables as S
from stepwell.llm.components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES, LEAF, SPLITS = 128, 512, 3
_ROW = 4 * COORDINATES + 24
_FACTORS = K.stream(41, COORDINATES) | np.uint64(1)


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, splits: int = SPLITS) -> int:
    """Runs after which a pair at the threshold is found with the target recall, even in the deepest buckets.

    All runs draw from the pair's one vector, so the miss is taken over the number of coordinates that agree.
    """
    agree = np.arange(COORDINATES + 1)
    share = np.array([math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in agree.tolist()])
    once, runs = 1 - (agree / COORDINATES) ** (splits + 1), 1
    while share @ once**runs > 1 - recall:
        runs += 1
    return runs


def candidate_share(threshold: float) -> float:
    """Least share of equal coordinates of a candidate: five standard deviations below the threshold."""
    return max(threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDINATES), 0.0)


def sets(body: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' shingle sets behind each other, each sorted, and their edges."""
    w = K.words(body, offsets, lower=True)
    counts = w.counts
    whole = K.grams(w.hashes, n)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, c) in enumerate(zip(w.first[:-1].tolist(), counts.tolist(), strict=True)):
        if c >= n:
            own = np.unique(whole[a : a + c - n + 1])
        elif c:
            own = K.grams(w.hashes[a : a + c], c, seed=100 + c)
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _names(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    first, second = np.zeros(len(edges) - 1, np.uint64), np.zeros(len(edges) - 1, np.uint64)
    some = np.diff(edges) > 0
    if some.any():
        with np.errstate(over="ignore"):
            first[some] = np.add.reduceat(K.mix(flat ^ np.uint64(0x5BD1E995)), edges[:-1][some])
            second[some] = np.add.reduceat(K.mix(flat + np.uint64(0x27D4EB2F)), edges[:-1][some])
    return K.mix(first).view(np.int64), K.mix(second).view(np.int64)


def _vectors(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(edges) - 1, COORDINATES), np.uint32)
    some = np.diff(edges) > 0
    if some.any():
        at = edges[:-1][some]
        for j, f in enumerate(_FACTORS):
            with np.errstate(over="ignore"):
                out[some, j] = np.minimum.reduceat((flat * f) >> np.uint64(32), at)
    return out


_SKETCH = T.StructType().add("id", "long").add("h", "long").add("s1", "long").add("s2", "long").add("n", "long").add("vector", "binary")


def _sketch(n: int):
    def sketch(batches):
        for batch in batches:
            ids, empty = K.ids_of(batch.column(0))
            body, offsets = K.column(batch.column(1))
            for a, b in K.pieces(offsets, 2 << 20):
                flat, edges = sets(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                s1, s2 = _names(flat, edges)
                vectors = _vectors(flat, edges)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COORDINATES), b - a, [None, pa.py_buffer(vectors.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([K.long_array(ids[a:b], empty[a:b]), batch.column(2).slice(a, b - a), pa.array(s1), pa.array(s2), pa.array(np.diff(edges)), packed], names=["id", "h", "s1", "s2", "n", "vector"])

    return sketch


def _matrix(column: pa.Array) -> np.ndarray:
    body, _ = K.column(column)
    return body.view(np.uint32).reshape(-1, COORDINATES) if len(body) % 4 == 0 and body.flags["C_CONTIGUOUS"] and body.ctypes.data % 4 == 0 else np.frombuffer(body.tobytes(), np.uint32).reshape(-1, COORDINATES)


def _key(seed: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(K.mix(seed.astype(np.uint64)) + token.astype(np.uint64)).view(np.int64)


def _roots(runs: int):
    """A path a run: its first token is that of one coordinate."""
    chosen = K.stream(7, COORDINATES).argsort()[np.arange(runs) % COORDINATES]

    def roots(batches):
        for batch in batches:
            vectors, n = _matrix(batch.column(1)), batch.num_rows
            keys = [_key(np.full(n, r + 1), vectors[:, c]) for r, c in enumerate(chosen.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(np.asarray(batch.column(0)), len(keys)))], names=["key", "sid"])

    return roots


def _deeper(batches):
    """The path chooses the coordinate whose token it is extended by."""
    for batch in batches:
        keys, vectors = np.asarray(batch.column(0)), _matrix(batch.column(2))
        chosen = (K.mix(keys.view(np.uint64) ^ np.uint64(0x9E37)) % np.uint64(COORDINATES)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(_key(keys.view(np.uint64), vectors[np.arange(len(keys)), chosen])), batch.column(1)], names=["key", "sid"])


def forest(links: np.ndarray) -> np.ndarray:
    """Of each node the least node of its component, for a symmetric matrix of links."""
    n = len(links)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            seen, front = np.zeros(n, bool), np.zeros(n, bool)
            seen[i] = front[i] = True
            while front.any():
                front = links[front].any(axis=0) & ~seen
                seen |= front
            root[seen] = i
    return root


def _same(vectors: np.ndarray) -> np.ndarray:
    """Numbers of equal coordinates of all pairs of a bucket."""
    n = len(vectors)
    out = np.zeros((n, n), np.uint8)
    for j in range(COORDINATES):
        column = vectors[:, j]
        out += column[:, None] == column[None, :]
    return out


def _bruteforce(share: float):
    """Spanning forests of the candidates in each bucket of a sorted partition."""
    least = math.ceil(share * COORDINATES)

    def groups(batches):
        held_key, held = None, []
        for batch in batches:
            keys, sids, vectors = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2))
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and keys[a] != held_key:
                    yield held
                    held = []
                held_key = keys[a]
                held.append((sids[a:b], vectors[a:b]))
        if held:
            yield held

    def search(batches):
        edges = []
        for held in groups(batches):
            if len(held) == 1 and len(held[0][0]) < 2:
                continue
            sids = np.concatenate([x[0] for x in held])
            vectors = np.concatenate([x[1] for x in held])
            if len(sids) < 2:
                continue
            if len(sids) == 2:
                if (vectors[0] == vectors[1]).sum() >= least:
                    edges.append(np.sort(sids)[None, :])
            else:
                order = np.argsort(sids, kind="stable")
                sids, vectors = sids[order], vectors[order]
                root = forest(_same(vectors) >= least)
                hung = root != np.arange(len(root))
                if hung.any():
                    edges.append(np.stack([sids[root[hung]], sids[hung]], axis=1))
            if len(edges) >= 2000:
                yield _edges(edges)
                edges = []
        yield _edges(edges)

    return search


def _edges(edges: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _met(paths: DataFrame, vectors: DataFrame) -> DataFrame:
    """Paths that two members or more share, with the bucket's size and the members' vectors."""
    sizes = S.save(paths.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    return paths.join(sizes, "key").join(vectors, "sid").select("key", "sid", "vector", "size")


def _stars(share: float):
    """Edges of a bucket's pivot to the members that are candidates with it."""
    least = math.ceil(share * COORDINATES)

    def stars(batches):
        for batch in batches:
            near = pa.array((_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return stars


def _starred(large: DataFrame, share: float) -> DataFrame:
    """Edges (a, b) of each large bucket's pivot, which its key chooses."""
    least = F.min(F.struct(F.xxhash64("key", "sid").alias("h"), "sid", "vector")).alias("least")
    pivots = S.save(large.groupBy("key").agg(least).select("key", F.col("least.sid").alias("pivot"), F.col("least.vector").alias("own")), "pivots")
    return large.join(pivots, "key").filter("sid != pivot").select("pivot", "sid", "vector", "own").mapInArrow(_stars(share), "a long, b long")


def _parted(large: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of large buckets with `outside`, whether they are not in the bucket's largest component, and how many are (`rest`); (size, rest) of each bucket."""
    named = S.save(large.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "named")
    parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("size"))
    largest = S.save(largest.select("key", F.col("main.root").alias("main"), "size", (F.col("size") - F.col("main.n")).alias("rest")), "largest")
    members = named.join(largest.select("key", "main", "rest"), "key").withColumn("outside", F.col("root") != F.col("main"))
    return members.select("key", "sid", "vector", "size", "rest", "outside"), largest


def _crossed(members: DataFrame, leaf: int) -> DataFrame:
    """Members of large buckets dealt to tiles of about `leaf` against `leaf`, that hold all pairs but those inside the largest component."""
    rest, main = F.ceil(F.col("rest") / leaf), F.ceil((F.col("size") - F.col("rest")) / leaf)
    deal = F.xxhash64("sid")
    out = members.withColumn("block", F.when(F.col("outside"), F.pmod(deal, rest)).otherwise(rest + F.pmod(deal, main)))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("outside"), rest + main).otherwise(rest) - 1)))
    return out.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "sid", "vector")


def _tiled(rows: DataFrame, key: str, sid: str, leaf: int, others: list[str]) -> DataFrame:
    """Members of large groups dealt to tiles, pairs of blocks of about `leaf` members; `side` is a member's block."""
    n = F.ceil(F.col("size") / leaf)
    block = F.pmod(F.xxhash64(sid), n)
    out = rows.withColumn("blocks", n).withColumn("block", block)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return out.select(F.xxhash64(key, low, high).alias("key"), sid, (F.col("block") == low).alias("is_low"), (low == high).alias("one"), *others)


def candidates(classes: DataFrame, threshold: float, recall: float, leaf: int, splits: int) -> DataFrame:
    """Edges (a, b) of spanning forests of the candidate pairs, by chosen paths; classes has sid and vector."""
    spark = classes.sparkSession
    share, runs = candidate_share(threshold), runs_needed(threshold, recall, splits)
    brute = lambda rows, n: rows.select("key", "sid", "vector").repartition(S.partitions(spark, n * _ROW), "key").sortWithinPartitions("key").mapInArrow(_bruteforce(share), "a long, b long")
    paths = classes.select("sid", "vector").mapInArrow(_roots(runs), "key long, sid long")
    out = roots = None
    for depth in range(splits + 1):
        level = S.save(_met(paths, classes.select("sid", "vector")), "paths")
        edges = brute(level.filter(F.col("size") <= leaf), level.count())
        out = edges if out is None else out.union(edges)
        large = level.filter(F.col("size") > leaf)
        if large.isEmpty():
            return out
        if roots is None:
            stars = S.save(_starred(large, share), "stars")
            out, roots = out.union(stars), components(stars).withColumnRenamed("node", "sid")
        members, buckets = _parted(large, roots)
        ends = (F.col("rest") > 0) & ((F.col("rest") <= leaf) | F.lit(depth == splits))
        tiles = F.col("rest") * F.ceil(F.col("size") / leaf + 1) + F.col("size") * F.ceil(F.col("rest") / leaf)
        out = out.union(brute(_crossed(members.filter(ends), leaf), buckets.filter(ends).agg(F.sum(tiles)).first()[0] or 0))
        if depth == splits or buckets.filter(F.col("rest") > leaf).isEmpty():
            return out
        paths = S.save(members.filter(F.col("rest") > leaf).select("key", "sid", "vector").mapInArrow(_deeper, "key long, sid long"), "keys")


_MEMBER = T.StructType().add("sid", "long").add("root", "long").add("size", "long").add("hashes", "binary")


def _whole(n: int):
    """Sets of the texts that stand for their classes; a text whose set is another's is dropped."""

    def whole(batches):
        for batch in batches:
            body, offsets = K.column(batch.column(5))
            for a, b in K.pieces(offsets, 2 << 20):
                flat, edges = sets(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                s1, s2 = _names(flat, edges)
                at = [i for i in range(b - a) if s1[i] == batch.column(3)[a + i].as_py() and s2[i] == batch.column(4)[a + i].as_py()]
                rows = pa.array([a + i for i in at], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array([flat[edges[i] : edges[i + 1]].tobytes() for i in at], pa.binary())], names=["sid", "root", "size", "hashes"])

    return whole


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets, by products of incidence matrices of bounded width."""
    both = left if right is None else left + right
    if not both:
        return np.zeros((0, 0))
    token, owner = np.concatenate(both), np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    number = np.concatenate([[0], np.cumsum(token[1:] != token[:-1])]) if len(token) else token.astype(np.int64)
    often = np.bincount(number)[number] > 1  # others are in no intersection
    number, owner = number[often], owner[often]
    a = len(left)
    out = np.zeros((a, a if right is None else len(right)), np.float32)
    if not len(number):
        return out
    number = np.concatenate([[0], np.cumsum(number[1:] != number[:-1])])
    width = max(256, (8 << 20) // (4 * len(both)))
    for low in range(0, int(number[-1]) + 1, width):
        x, y = np.searchsorted(number, [low, low + width])
        grid = np.zeros((len(both), min(width, int(number[-1]) + 1 - low)), np.float32)
        grid[owner[x:y], number[x:y] - low] = 1
        out += grid[:a] @ (grid[:a] if right is None else grid[a:]).T
    return out


_LINKS = pa.schema([("sid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _verify(threshold: float):
    """Exact links inside each group: numbers of links, and a spanning forest as rows with `other`."""

    def linked(inter, m, n):
        return inter >= threshold * (m[:, None] + n[None, :] - inter) - 1e-6

    def verify(batches):
        for _, held in S.grouped(batches):
            held = sorted(held, key=lambda r: r["sid"])
            found = [np.frombuffer(r["hashes"], np.uint64) for r in held]
            sids = np.array([r["sid"] for r in held])
            sizes = np.array([len(x) for x in found], np.float32)
            if held[0]["one"]:
                links = linked(shared_sizes(found), sizes, sizes)
                np.fill_diagonal(links, False)
            else:
                low = np.array([r["is_low"] for r in held])
                i, j = np.flatnonzero(low), np.flatnonzero(~low)
                links = np.zeros((len(held), len(held)), bool)
                links[np.ix_(i, j)] = linked(shared_sizes([found[x] for x in i], [found[x] for x in j]), sizes[i], sizes[j]) if len(i) and len(j) else False
                links |= links.T
            count, root = links.sum(axis=1), forest(links)
            some = np.flatnonzero(count)
            if len(some):
                other = [int(sids[root[x]]) if root[x] != x else None for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(sids[some]), pa.array(count[some].astype(np.int64)), pa.array(other, pa.int64())], schema=_LINKS)

    return verify


def join_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF, splits: int = SPLITS) -> tuple[DataFrame, DataFrame]:
    """Rows (id, s1, s2) of all texts, and of each set (s1, s2): rep_id, copies, n_links, class_id, stays."""
    spark = df.sparkSession
    S.tune(spark)
    two = S.two(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    sketched = S.save(two.mapInArrow(_sketch(n), _SKETCH), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "h")).alias("rep")
    grouped = sketched.groupBy("s1", "s2").agg(least, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("vector").alias("vector"))
    grouped = grouped.select("s1", "s2", F.col("rep.id").alias("rep_id"), F.col("rep.h").alias("rep_h"), "copies", "n", "vector")
    classes = S.save(grouped.withColumn("sid", F.monotonically_increasing_id()), "classes")
    edges = candidates(classes.filter("n > 0"), threshold, recall, leaf, splits)
    near = components(edges)
    near = near.union(near.select("root", "root").distinct())
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    near = near.join(sizes, "root").select(F.col("node").alias("sid"), "root", "size")
    wanted = near.join(classes.select("sid", "rep_id", "rep_h", "s1", "s2"), "sid")
    texts = wanted.join(two, (wanted.rep_h == two.h) & wanted.rep_id.eqNullSafe(two.id)).select("sid", "root", "size", "s1", "s2", "text")
    members = S.save(texts.mapInArrow(_whole(n), _MEMBER).dropDuplicates(["sid"]), "members")  # repeated rows bring a text again
    small = members.filter(F.col("size") <= leaf).select(F.xxhash64("root").alias("key"), "sid", F.lit(True).alias("is_low"), F.lit(True).alias("one"), "hashes")
    large = _tiled(members.filter(F.col("size") > leaf), "root", "sid", leaf, ["hashes"])
    size = members.agg(F.sum(F.octet_length("hashes") * F.when(F.col("size") > leaf, F.ceil(F.col("size") / leaf)).otherwise(1))).first()[0] or 0
    dealt = small.union(large).repartition(S.partitions(spark, size), "key").sortWithinPartitions("key")
    links = S.save(dealt.mapInArrow(_verify(threshold), "sid long, links long, other long"), "links")
    counts = links.groupBy("sid").agg(F.sum("links").alias("n_links"))
    classed = components(links.filter("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b")))
    out = classes.drop("vector", "n", "rep_h").join(counts, "sid", "left").join(classed.withColumnRenamed("node", "sid"), "sid", "left")
    out = out.select("sid", "s1", "s2", "rep_id", "copies", F.coalesce("root", "sid").alias("class_sid"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = S.save(out, "sets")
    least = F.min(F.struct(F.col("rep_id").isNull().alias("x"), "rep_id", "sid"))
    names = out.filter("sid != class_sid or n_links > 0").groupBy("class_sid").agg(least.alias("least"))
    out = out.join(names, "class_sid", "left")
    out = out.select("s1", "s2", "rep_id", "copies", "n_links", F.coalesce("least.rep_id", "rep_id").alias("class_id"), F.coalesce(F.col("least.sid") == F.col("sid"), F.lit(True)).alias("stays"))
    return sketched.select("id", "s1", "s2", "n"), out


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row: id, class_id (the least id of its near-duplicate class), rep_id (the least id with
    the same set), n_copies (rows with the same set), n_links (other sets at the threshold or above)."""
    rows, found = join_classes(df, id_col, text_col, **how)
    full = rows.filter("n > 0").join(found.select("s1", "s2", "rep_id", "copies", "class_id", "n_links"), ["s1", "s2"])
    full = full.select("id", "class_id", "rep_id", F.col("copies").alias("n_copies"), "n_links")
    one = F.lit(1).cast("long")
    return full.unionByName(rows.filter("n = 0").select("id", F.col("id").alias("class_id"), F.col("id").alias("rep_id"), one.alias("n_copies"), (one - 1).alias("n_links")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, **how) -> DataFrame:
    """One row of each class, the least id, with all its columns; texts without words all stay."""
    names = df.columns
    _, found = join_classes(df, id_col, text_col, n=n, **how)
    stay = found.filter("stays").select("s1", "s2", "rep_id")
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    id_at, text_at = names.index(id_col), names.index(text_col)
    schema = T.StructType([*inner.schema.fields]).add("s1", "long").add("s2", "long").add("n", "long")

    def name(batches):
        for batch in batches:
            body, offsets = K.column(batch.column(text_at))
            for a, b in K.pieces(offsets, 2 << 20):
                flat, edges = sets(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                s1, s2 = _names(flat, edges)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s1), pa.array(s2), pa.array(np.diff(edges))], names=[*batch.schema.names, "s1", "s2", "n"])

    rows = inner.mapInArrow(name, schema)
    own = stay.select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), "rep_id")
    match = (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")) & F.col(f"c{id_at}").cast("long").eqNullSafe(F.col("rep_id"))
    some = rows.filter("n > 0").join(own, match).dropDuplicates(["s1", "s2"])
    out = some.select(inner.columns).union(rows.filter("n = 0").select(inner.columns))
    return out.toDF(*names)
