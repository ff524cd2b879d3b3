"""Exact deduplication by Patricia-trie owners.

Texts are first merged where they are read: each task keeps a compressed radix trie of
its own texts, so a group of copies leaves a task as one representative whatever its
size (one for each `MERGE` bytes of different texts, where a task reads more).  Representatives are then dealt out by byte length and content hash, and the task
that gets them, the owner of their strings, inserts the full byte strings into a trie.
A terminal node holds the best identifier seen, the number of rows, and the
representatives that ended there; hashes only choose the task, the trie decides equality.

A trie that outgrows its budget spills by subtree: the heaviest subtree's strings, and
all that later descend into it, are written to the shared folder instead and go through
another round over more partitions.  A round keeps every string of some subtree, so the
rounds end.

Nulls and edges: a null text counts as an empty one and is a member of the group of
empty texts.  A null identifier ranks below every other, so it stays only if all of its
group are null.  Rows that repeat an identifier and text are one group; of rows that
tie for staying, exactly one stays.  An empty table gives an empty result.  Only the
named columns are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwell.llm import kernels as K
from stepwell.llm import tables as S

#: Bytes of labels and nodes that a trie may hold.
BUDGET = 96 << 20
#: Bytes of different texts that a reading task merges before it sends them on.
MERGE = 32 << 20
_NODE, _REF = 160, 160  # a node's own size, besides its label; a reference's


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by comparing slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    while step > 1:
        step //= 2
        if a[low : low + step] == b[low : low + step]:
            low += step
    return low


class Terminal:
    """What a string's node keeps: the owner's rank and row, the number of rows, and who ended here."""

    __slots__ = ("rank", "row", "count", "refs")

    def __init__(self, rank, row, count, ref):
        self.rank, self.row, self.count, self.refs = rank, row, count, [ref]

    def add(self, rank, row, count, ref) -> None:
        self.count += count
        self.refs.append(ref)
        if (rank, -row) > (self.rank, -self.row):
            self.rank, self.row = rank, row


class Node:
    __slots__ = ("label", "children", "terminal", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.terminal, self.spilled = label, {}, None, False


class PatriciaTrie:
    """A compressed radix trie over byte strings that spills whole subtrees when over its budget.

    ``spill(text, terminal)`` gets each string of a spilled subtree, and each later string
    that descends into one.
    """

    def __init__(self, budget: int = BUDGET, spill=None):
        self.root, self.budget, self.spill = Node(b""), budget, spill
        self.size, self.spills = 0, 0

    def insert(self, text: bytes, rank, row: int, count: int, ref) -> Terminal | None:
        """The string's terminal, None if spilled.  `rank` decides who owns it, the larger the better; ties go to the smaller row."""
        node, at = self.root, 0
        while True:
            if node.spilled:
                self.spill(text, Terminal(rank, row, count, ref))
                return None
            if at == len(text):
                break
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(child.label) + _NODE
                node, at = child, len(text)
                break
            size = len(child.label)
            if text[at : at + size] == child.label:
                node, at = child, at + size
                continue
            shared = common(child.label, text[at : at + size])
            upper = Node(child.label[:shared])
            child.label = child.label[shared:]
            upper.children[child.label[0]] = child
            upper.spilled = False
            node.children[text[at]] = upper
            self.size += _NODE
            node, at = upper, at + shared
        if node.terminal is None:
            node.terminal = Terminal(rank, row, count, ref)
        else:
            node.terminal.add(rank, row, count, ref)
            self.size += _REF if self.spill else 0
        if self.size > self.budget and self.spill:
            self._spill()
        return node.terminal

    def _weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + _NODE + (_REF * (len(x.terminal.refs) - 1) if x.terminal else 0)
            stack.extend(x.children.values())
        return total

    def _spill(self) -> None:
        """Give up the heaviest subtree below the first fork; a trie of one string is kept."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.terminal is None:
            node = next(iter(node.children.values()))
            prefix += node.label
        open_ = [c for c in node.children.values() if not c.spilled]
        if not open_ or (len(node.children) < 2 and node.terminal is None):
            return
        heavy = max(open_, key=self._weight)
        self.size -= self._weight(heavy)
        for text, terminal in self.walk(heavy, prefix):
            self.spill(text, terminal)
        heavy.children, heavy.terminal, heavy.spilled = {}, None, True
        self.spills += 1

    def walk(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Terminal]]:
        """Every string with its terminal, without recursion."""
        stack = [(node or self.root, prefix)]
        while stack:
            x, before = stack.pop()
            text = before + x.label
            if x.terminal is not None:
                yield text, x.terminal
            stack.extend((c, text) for c in x.children.values())

    def terminals(self) -> Iterator[Terminal]:
        stack = [self.root]
        while stack:
            x = stack.pop()
            if x.terminal is not None:
                yield x.terminal
            stack.extend(x.children.values())


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Whole texts with A-Z lower-cased, as UTF-8; null as empty."""
    body, offsets = K.column(batch.column(1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield body[a:b].tobytes().lower()


def _rank(value: int, empty: bool, keep: str) -> tuple:
    return (0, 0) if empty else (1, value if keep == "largest" else -value)


_LOCAL = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("rep", pa.int64()), ("sha", pa.string()), ("size", pa.int64()), ("key", pa.int64()), ("owner", pa.int64()), ("owner_row", pa.int64()), ("count", pa.int64()), ("text", pa.binary())])
_LOCAL_SQL = "row long, id long, rep long, sha string, size long, key long, owner long, owner_row long, count long, text binary"


def _merge_where_read(keep: str):
    """Each row with its representative, the first row of the task with its text; and the representatives, with texts."""

    def merge(batches):
        first = next(S.serial())
        trie = PatriciaTrie()
        for batch in batches:
            ids, empty = K.ids_of(batch.column(0))
            digests: list[str] = []
            reps = np.zeros(len(ids), np.int64)
            for i, text in enumerate(_texts(batch)):
                digests.append(hashlib.sha256(text).hexdigest())
                found = trie.insert(text, (*_rank(int(ids[i]), bool(empty[i]), keep), int(ids[i])), first + i, 1, first + i)
                del found.refs[1:]
                reps[i] = found.refs[0]
            n = len(digests)
            none = [pa.nulls(n, f.type) for f in list(_LOCAL)[4:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), K.long_array(ids, empty), pa.array(reps), pa.array(digests, pa.string()), *none], schema=_LOCAL)
            first += n
            if trie.size >= MERGE:
                yield from texts(trie)
                trie = PatriciaTrie()
        yield from texts(trie)

    def texts(trie):
        held, size = [], 0
        for text, t in trie.walk():
            held.append({"rep": t.refs[0], "size": len(text), "key": xxhash.xxh64_intdigest(text) - (1 << 63), "owner": t.rank[-1] if t.rank[0] else None, "owner_row": t.row, "count": t.count, "text": text})
            size += len(text) + 64
            if size >= S.BATCH_BYTES // 4:
                yield S.record(held, _LOCAL)
                held, size = [], 0
        yield S.record(held, _LOCAL)

    return merge


_OWNED_SQL = "rep long, keep_id long, owner_row long, group_size long, size long, key long, text binary, reps binary"
_OWNED = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("owner_row", pa.int64()), ("group_size", pa.int64()), ("size", pa.int64()), ("key", pa.int64()), ("text", pa.binary()), ("reps", pa.binary())])


def _own(keep: str, budget: int):
    """Insert a partition's strings; spilled ones come out with their text for the next round."""

    def own(batches):
        out: list[dict] = []

        def plain(rank) -> int | None:
            return None if not rank[0] else rank[1] if keep == "largest" else -rank[1]

        def spill(text, t):
            out.append({"keep_id": plain(t.rank), "owner_row": t.row, "group_size": t.count, "size": len(text), "key": xxhash.xxh64_intdigest(text) - (1 << 63), "text": text, "reps": np.concatenate(t.refs).tobytes()})

        trie = PatriciaTrie(budget, spill)
        for batch in batches:
            owner, empty = K.ids_of(batch.column(0))
            at, count = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for i in range(batch.num_rows):
                text = batch.column(3)[i].as_py()
                trie.insert(text, _rank(int(owner[i]), bool(empty[i]), keep), int(at[i]), int(count[i]), np.frombuffer(batch.column(4)[i].as_py(), np.int64))
            if out:
                yield S.record(out, _OWNED)
                out.clear()
        held: list[tuple] = []
        for t in trie.terminals():
            held += [(int(r), plain(t.rank), t.row, t.count) for part in t.refs for r in part]
            if len(held) >= 50_000:
                yield _resolved(held)
                held = []
        yield _resolved(held)

    return own


def _resolved(held: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*held, strict=True)) if held else [[], [], [], []]
    none = [None] * len(held)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array(none, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], schema=_OWNED)


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = BUDGET) -> DataFrame:
    """One row per row: id, keep_id (the identifier that stays for its text), group_size, kept, text_sha256.

    ``keep`` says whose row stays, the smallest or the largest identifier.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    spark = df.sparkSession
    S.tune(spark)
    local = S.save(S.two(df, id_col, text_col).mapInArrow(_merge_where_read(keep), _LOCAL_SQL), "texts")
    reps = local.filter(F.col("text").isNotNull())
    size = reps.agg(F.sum("size")).first()[0] or 0
    n = S.partitions(spark, size)
    todo = reps.select(F.col("owner").alias("keep_id"), "owner_row", F.col("count").alias("group_size"), "text", "rep", "size", "key")
    todo = todo.mapInArrow(_listed, "keep_id long, owner_row long, group_size long, text binary, reps binary, size long, key long")
    owned: DataFrame | None = None
    while True:
        dealt = todo.repartition(n, "size", "key").select("keep_id", "owner_row", "group_size", "text", "reps")
        found = S.save(dealt.mapInArrow(_own(keep, budget), _OWNED_SQL), "owners")
        done = found.filter(F.col("rep").isNotNull()).select("rep", "keep_id", "owner_row", "group_size")
        owned = done if owned is None else owned.unionByName(done)
        left = found.filter(F.col("text").isNotNull())
        if left.isEmpty():
            break
        todo, n = left.select("keep_id", "owner_row", "group_size", "text", "reps", "size", "key"), n * 4
    out = local.filter(F.col("row").isNotNull()).select("row", "id", "rep", "sha").join(owned, "rep")
    return out.select("id", "keep_id", "group_size", (F.col("row") == F.col("owner_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def _listed(batches):
    for b in batches:
        listed = pa.array([np.int64(r).tobytes() for r in b.column(4).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), listed, b.column(5), b.column(6)], names=["keep_id", "owner_row", "group_size", "text", "reps", "size", "key"])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = BUDGET) -> DataFrame:
    """The rows that stay, with all their columns: whole rows travel with their text, so nothing is joined back."""
    spark = df.sparkSession
    S.tune(spark)
    names, schema = df.columns, df.schema
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    id_at, text_at = names.index(id_col), names.index(text_col)
    merged = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)]).add("size_", "long").add("key_", "long")
    dealt = T.StructType([*merged.fields]).add("later_", "boolean")

    def split(batch):
        two = pa.RecordBatch.from_arrays([batch.column(id_at), batch.column(text_at)], names=["id", "text"])
        ids, empty = K.ids_of(two.column(0))
        return ids, empty, list(_texts(two))

    def best(held):
        """Of the batches' rows those that stay, one for each text."""
        batch = pa.concat_batches(held)
        ids, empty, texts = split(batch)
        trie = PatriciaTrie()
        for i, text in enumerate(texts):
            trie.insert(text, _rank(int(ids[i]), bool(empty[i]), keep), i, 1, 0)
        stay = sorted(t.row for t in trie.terminals())
        return batch.take(pa.array(stay, pa.int64())), [texts[i] for i in stay]

    def with_keys(batch, texts):
        key = pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], pa.int64())
        size = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, size, key], names=[*batch.schema.names, "size_", "key_"])

    def merge(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and size + batch.nbytes > 1 << 30:  # an Arrow column holds 2 GB
                yield with_keys(*best(held))
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
            if size >= MERGE:
                left, texts = best(held)
                held, size = [left], left.nbytes
                if size > MERGE // 2:
                    yield with_keys(left, texts)
                    held, size = [], 0
        if held:
            yield with_keys(*best(held))

    def own(batches):
        held: list[pa.RecordBatch] = []
        away: set[int] = set()

        def spill(_text, t):
            away.update([t.row])

        trie, row = PatriciaTrie(budget, spill), 0
        for batch in batches:
            ids, empty, texts = split(batch)
            for i, text in enumerate(texts):
                trie.insert(text, _rank(int(ids[i]), bool(empty[i]), keep), row + i, 1, 0)
            row += batch.num_rows
            held.append(batch)
        stay = np.zeros(row, bool)
        for t in trie.terminals():
            stay[t.row] = True
        later = np.zeros(row, bool)
        later[list(away)] = True
        at = 0
        for batch in held:
            here = stay[at : at + batch.num_rows] | later[at : at + batch.num_rows]
            part = batch.filter(pa.array(here))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(later[at : at + batch.num_rows][here])], names=[*batch.schema.names, "later_"])
            at += batch.num_rows

    todo = inner.mapInArrow(merge, merged)
    n = S.partitions(spark, inner.agg(F.sum(F.octet_length(f"c{text_at}"))).first()[0] or 0)
    parts = []
    while True:
        found = S.save(todo.repartition(n, "size_", "key_").mapInArrow(own, dealt), "owners")
        parts.append(found.filter(~F.col("later_")))
        todo = found.filter(F.col("later_")).drop("later_")
        if todo.isEmpty():
            break
        n *= 4
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
