"""Toxicity by a classifier chain.

Categories are the label columns, in the order given; each has a logistic regression, and
later ones see the probabilities of those before.  In training these are out of fold: the
probability that a model gives to a document it was not fitted on, so that a later model
does not trust an earlier one more than it will deserve.

Features are the words of a document (letters and digits, A-Z lower-cased) and their
beginnings of 5 to 8 bytes, hashed into 2^18 places; presence counts, not frequency.  The
places whose presence differs between the classes (by a signed chi-square root) by at least
`SIGNIFICANT` enter the models, and the best `keep_features` in any case, so scoring a
document is one table look-up a token.  Fits go on until the gradient vanishes.  The last
category's verdict is its probability against a threshold: of 25 between 0.35 and 0.65, the
one with the best F1 out of fold, so that few labels cannot move it far from a half.

Training reads at most `max_train` labelled documents, those with the least hash of their
identifier, through a broadcast of their labels; they are written once, and so are the places of
each that entered, which only tasks read.  The driver sees numbers: of at most `max_train` rows
the identifier, labels and probabilities, and weights.  The model of a category is fitted by a
task on all rows, then by a task each without a fold.  Scoring covers every document.

Nulls and edges: a null or empty text has no features and gets the models' constant.  A
null label is left out of its category; labels that repeat an identifier with different
values count as their largest.  Rows with a null identifier are scored, not trained on.  A
category with fewer than 10 labels of a class predicts its share.  No labels: probability
0, nothing rejected.  Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwell.llm import kernels as K
from stepwell.llm import tables as S

PLACES, BEGINNINGS = 1 << 18, (5, 6, 7, 8)
MAX_TRAIN, KEEP_FEATURES, FOLDS = 20_000, 768, 5
PIECE = 1 << 16
SIGNIFICANT = 3.5  # by chance, about 120 of the places at most


def _hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all tokens and their documents; a word and its beginnings are features of their own."""
    w = K.words(body, offsets, K.PUNCTUATION, lower=True)
    document = np.repeat(np.arange(len(offsets) - 1), w.counts)
    out, owners = [w.hashes], [document]
    table, size = K.letters(5, K.PUNCTUATION, True), w.ends - w.starts
    for n in BEGINNINGS:
        long = np.flatnonzero(size >= n)
        total = np.zeros(len(long), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                total += table[body[w.starts[long] + j]] * K._PLACE[j]
            out.append(K.mix(total + np.uint64(n)))
        owners.append(document[long])
    return (np.concatenate(out) >> np.uint64(64 - 18)).astype(np.int64), np.concatenate(owners)


def _present(places: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owners * PLACES + places)
    return both % PLACES, both // PLACES


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _sums(index: np.ndarray, sizes: np.ndarray):
    """Sums, over consecutive groups of `index` of the sizes given, of the values there; an empty group's is 0.

    Groups are worked off in pieces that stay in the processor's cache.
    """
    some = np.flatnonzero(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes[some])])
    pieces, a = [], 0
    while a < len(some):
        b = max(int(np.searchsorted(ends, ends[a] + PIECE, "right")) - 1, a + 1)
        pieces.append((some[a:b], index[ends[a] : ends[b]], ends[a:b] - ends[a]))
        a = b
    room = np.empty(max((len(at) for _, at, _ in pieces), default=0))

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes))
        for groups, at, starts in pieces:
            out[groups] = np.add.reduceat(values.take(at, out=room[: len(at)], mode="clip"), starts)
        return out

    return sums


def fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n: int, ridge: float = 1.0, tolerance: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on presence features and extra columns; weights, extra weights, constant.

    Newton steps until the gradient is `tolerance` of that at zero weights; each solves for its direction by
    conjugate gradients, scaled by the curvature of each weight, and is halved until the loss falls.  The loss
    has one least point: weights to `start` from, as those of nearly the same rows, only shorten the way.
    """
    at, sizes = np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(r) for r in rows], np.int64)
    k, m = extra.shape[1], len(y)
    owner = np.repeat(np.arange(m), sizes)[np.argsort(at, kind="stable")]  # by place
    by_row, by_place = _sums(at, sizes), _sums(owner, np.bincount(at, minlength=n))
    times = lambda x: by_row(x) + extra @ x[n : n + k] + x[-1]
    back = lambda z: np.concatenate([by_place(z), extra.T @ z, [z.sum()]])
    penalty = np.full(n + k + 1, ridge)
    penalty[-1] = 1e-9
    w = np.zeros(n + k + 1)
    w[-1] = np.log((y.sum() + 0.5) / (m - y.sum() + 0.5))
    loss = lambda x, z: np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * x) @ x
    first = float(np.linalg.norm(back(_logistic(times(w)) - y) + penalty * w))
    if start is not None:
        w = start.copy()
    z = times(w)
    now = loss(w, z)
    while True:
        p = _logistic(z)
        grad = back(p - y) + penalty * w
        size = float(np.sqrt(grad @ grad))
        if size <= tolerance * first:
            return w
        curve = p * (1 - p)
        scale = np.concatenate([by_place(curve), (extra**2).T @ curve, [curve.sum()]]) + penalty
        step, rest = np.zeros_like(w), -grad
        along = rest / scale
        inner = rest @ along
        aim = max(min(0.1, np.sqrt(size / first)) * size, 0.3 * tolerance * first)
        while np.sqrt(rest @ rest) > aim:
            bent = back(curve * times(along)) + penalty * along
            length = inner / (along @ bent)
            step += length * along
            rest = rest - length * bent
            before, inner = inner, rest @ (rest / scale)
            along = rest / scale + inner / before * along
        moved, part = times(step), 1.0
        while part > 1e-6 and loss(w + part * step, z + part * moved) > now + 1e-4 * part * (grad @ step):
            part /= 2
        if part <= 1e-6:  # as near as the numbers allow
            return w
        w, z = w + part * step, z + part * moved
        now = loss(w, z)


@dataclass
class Chain:
    """Places that count, in sorted order, and the models in chain order."""

    categories: tuple[str, ...]
    places: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    constants: list[float | None] = field(default_factory=list)  # a probability, where there is no model
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each document the probability of each category."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.categories)))
        index = np.full(PLACES, -1)
        index[self.places] = np.arange(len(self.places))
        for a, b in K.pieces(offsets, 2 << 20):
            places, owners = _hashes(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            chosen = index[places]
            some = chosen >= 0
            both = np.unique(owners[some] * len(self.places) + chosen[some]) if some.any() else np.zeros(0, np.int64)
            at, owner = both % max(len(self.places), 1), both // max(len(self.places), 1)
            for c, (w, constant) in enumerate(zip(self.weights, self.constants, strict=True)):
                if constant is not None:
                    out[a:b, c] = constant
                    continue
                k = len(self.places)
                z = np.bincount(owner, weights=w[at], minlength=b - a) + out[a:b, :c] @ w[k : k + c] + w[-1]
                out[a:b, c] = _logistic(z)
        return out


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability between 0.35 and 0.65 with the best F1 out of fold; the middle of equals."""
    tried = np.linspace(0.35, 0.65, 25)
    f1 = np.array([2 * (y * (p >= t)).sum() / max((p >= t).sum() + y.sum(), 1) for t in tried])
    return float(np.median(tried[f1 >= f1.max() - 1e-12]))


def _tally(text_at: int, label_at: list[int]):
    """Of each place the numbers of documents of each class that have it, over a task's documents."""

    def tally(batches):
        total, some = np.zeros((len(label_at) * 2, PLACES), np.int32), False
        for batch in batches:
            body, offsets = K.column(batch.column(text_at))
            labels = [np.asarray(batch.column(i).fill_null(-1)).astype(np.int64) for i in label_at]
            for a, b in K.pieces(offsets, 2 << 20):
                places, owners = _present(*_hashes(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                for c, y in enumerate(labels):
                    for value in (0, 1):
                        total[2 * c + value] += np.bincount(places[y[a:b][owners] == value], minlength=PLACES).astype(np.int32)
                some = True
        if some:
            seen = np.flatnonzero((total > 0).sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32))] + [pa.array(t[seen].astype(np.int64)) for t in total], names=["place", *[f"n{i}" for i in range(len(total))]])

    return tally


def train(documents: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, keep_features: int = KEEP_FEATURES, folds: int = FOLDS) -> Chain:
    """Fit the chain on at most `max_train` labelled documents."""
    S.tune(documents.sparkSession)
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`").cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).filter("id is not null")
    own = own.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_train)
    ys = [f"y{i}" for i in range(len(categories))]
    sample = S.save(S.two(documents, id_col, text_col).join(F.broadcast(own), "id").select("id", "text", *ys), "sample")  # max_train identifiers at most
    label_at = [2 + i for i in range(len(ys))]
    shape = T.StructType().add("place", "integer")
    for i in range(2 * len(ys)):
        shape = shape.add(f"n{i}", "long")
    sums = S.save(sample.mapInArrow(_tally(1, label_at), shape).groupBy("place").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(2 * len(ys))]), "tallies")
    sizes = sample.agg(*[F.count(F.when(F.col(y) == v, 1)).alias(f"s{2 * i + v}") for i, y in enumerate(ys) for v in (0, 1)]).first()
    chosen: list[pa.Table] = []
    for c in range(len(ys)):
        s0, s1 = sizes[f"s{2 * c}"], sizes[f"s{2 * c + 1}"]
        if min(s0, s1) < 10:
            continue
        n0, n1, both = F.col(f"n{2 * c}"), F.col(f"n{2 * c + 1}"), s0 + s1
        share = (n0 + n1 + 1) / (both + 2)
        root = F.abs(n1 / s1 - n0 / s0) / F.sqrt(share * (1 - share) * (1 / s0 + 1 / s1))
        ranked = sums.select("place", root.alias("z"))
        chosen.append(ranked.orderBy(F.desc("z"), "place").limit(keep_features // len(ys)).select("place").toArrow())
        chosen.append(ranked.filter(F.col("z") >= SIGNIFICANT).select("place").toArrow())  # PLACES rows at most
    places = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(t.column("place")) for t in chosen]]))
    found = (sample if len(places) else sample.limit(0)).mapInArrow(_selected(places, label_at), "id long, " + ", ".join(f"{y} int" for y in ys) + ", places binary")
    return _fit_chain(S.save(found, "features"), places, categories, folds)


def _selected(places: np.ndarray, label_at: list[int]):
    """Of each training document the places that count."""

    def select(batches):
        index = np.full(PLACES, -1)
        index[places] = np.arange(len(places))
        for batch in batches:
            body, offsets = K.column(batch.column(1))
            out = []
            for a, b in K.pieces(offsets, 2 << 20):
                at, owners = _hashes(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = index[at] >= 0
                both = np.unique(owners[some] * len(places) + index[at[some]])
                cut = np.searchsorted(both, np.arange(b - a + 1) * len(places))
                out += [(both[x:y] % len(places)).astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in label_at], pa.array(out, pa.binary())], names=["id", *[f"y{i}" for i in range(len(label_at))], "places"])

    return select


def _features(batches) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of each fold in a task the places of all rows, by identifier and places."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for f, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.setdefault(f, []).append(tuple(row))
    for f, rows in held.items():
        yield f, [np.frombuffer(places, np.int32) for _, places in sorted(rows)]


def _fit_folds(features: DataFrame, earlier: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int, n: int) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Weights of the model without each fold, and of that of all rows; and each row's probability by the model without its
    fold, NaN where there is none.  A task fits the model of all rows first, others the rest from there; each reads all rows."""
    spark = features.sparkSession
    shared = spark.sparkContext.broadcast((earlier, y, fold))  # max_train rows at most
    rows = features.select("id", "places").coalesce(1)

    def fitted(which: range, start: np.ndarray | None) -> dict:
        def run(batches):
            extra, labels, own = shared.value
            for f, at in _features(batches):
                inside = np.flatnonzero((labels >= 0) & (own != f))
                w = fit([at[i] for i in inside], extra[inside], labels[inside], n, start=start) if len(set(labels[inside].tolist())) == 2 else None
                p = [] if w is None else [_logistic(w[at[i]].sum() + extra[i] @ w[n:-1] + w[-1]) for i in np.flatnonzero(own == f)]
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([None if w is None else w.tobytes()], pa.binary()), pa.array([np.array(p).tobytes()], pa.binary())], names=["fold", "weights", "held"])

        every = reduce(DataFrame.union, [rows.select(F.lit(f).cast("long").alias("fold"), "id", "places") for f in which])
        return {r.fold: r for r in every.mapInArrow(run, "fold long, weights binary, held binary").collect()}

    named = "spark.sql.unionOutputPartitioning"  # else a union of parts of one partition is one task
    before = spark.conf.get(named, None)
    spark.conf.set(named, "false")
    try:
        found = fitted(range(folds, folds + 1), None)
        found |= fitted(range(folds), np.frombuffer(bytes(found[folds].weights)))
    finally:
        spark.conf.unset(named) if before is None else spark.conf.set(named, before)
    shared.unpersist()
    out = np.full(len(y), np.nan)
    for f in range(folds):
        if found[f].weights is not None:
            out[fold == f] = np.frombuffer(bytes(found[f].held))
    return [None if found[f].weights is None else np.frombuffer(bytes(found[f].weights)) for f in range(folds + 1)], out


def _fit_chain(features: DataFrame, places: np.ndarray, categories: tuple[str, ...], folds: int) -> Chain:
    chain = Chain(categories, places)
    rows = features.drop("places").toArrow().sort_by("id")  # max_train rows at most; what they are asked for is one for rows with one identifier
    ids = np.asarray(rows.column("id"))
    fold = (K.mix(ids.view(np.uint64)) % np.uint64(folds)).astype(int) if len(ids) else np.zeros(0, int)
    earlier = np.zeros((len(ids), 0))
    for c in range(len(categories)):
        y = np.asarray(rows.column(f"y{c}").fill_null(-1)).astype(int)
        known = y >= 0
        share = float(y[known].mean()) if known.any() else 0.0
        if min((y == 0).sum(), (y == 1).sum()) < 10:
            chain.weights.append(np.zeros(0))
            chain.constants.append(share)
            chain.thresholds.append(0.5)
            earlier = np.column_stack([earlier, np.full(len(ids), share)])
            continue
        weights, out = _fit_folds(features, earlier, y, fold, folds, len(places))
        out = np.where(np.isnan(out), share, out)
        chain.weights.append(weights[-1])
        chain.constants.append(None)
        chain.thresholds.append(_threshold(out[known], y[known]))
        earlier = np.column_stack([earlier, out])
    return chain


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, p_<category> for each, and toxic: the last category's verdict."""
    spark = df.sparkSession
    S.tune(spark)
    shared = spark.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    limit = chain.thresholds[-1]

    def run(batches):
        for batch in batches:
            ids, empty = K.ids_of(batch.column(0))
            p = shared.value.probabilities(*K.column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([K.long_array(ids, empty), *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(p[:, -1] >= limit)], names=["id", *names, "toxic"])

    return S.two(df, id_col, text_col).mapInArrow(run, "id long, " + ", ".join(f"`{n}` double" for n in names) + ", toxic boolean")


def accept(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows that the last category does not reject, with all their columns."""
    spark = df.sparkSession
    S.tune(spark)
    shared, at, limit = spark.sparkContext.broadcast(chain), df.columns.index(text_col), chain.thresholds[-1]

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.probabilities(*K.column(batch.column(at)))[:, -1] < limit))

    return df.mapInArrow(run, df.schema)
