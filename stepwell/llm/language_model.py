"""A hidden Markov language model over words, trained by Baum-Welch on the corpus itself.

Tokens are words (A-Z lower-cased) and one end token a text, the empty word.  Every word of
the training texts has an emission of its own in every latent state:

    emit[k](w) = (C[k](w) + t[k](w)) / Z[k],

with C[k](w) the expected number of its tokens in state k, and t[k](w), which add up to 1
over the states, the one count that add-one smoothing gives a word, divided as the tokens
of its symbol are.  All unseen words together are one event with one such count, divided as
the average known word's.  Z[k] is the sum of all that, so that emissions add up to 1.

Training goes from coarse to fine.  In all rounds but the last words are tied to symbols:
each with at least one in `frequent` of the training tokens is a symbol (so there are at
most `frequent` of them, whatever the corpus), the end token is one, and other words share
one of `CLASSES` by their last three bytes.  The table of states by symbols is bounded, so
its counts go to the driver.  Rounds go on until one gains less than `tolerance` of the log
likelihood.  The last round is untied: expected counts of each word are added up where the
word is dealt to, and go back to the blocks that have it.

1. Each task turns its documents into blocks of word numbers with a vocabulary of the
   block's own, written to the shared folder.
2. Blocks send their vocabularies with counts, packed, one row for each part that has any of
   its words; parts add them up, and tell frequent words and the sums of classes.
3. Baum-Welch on symbols: each task adds up expected counts over its blocks, tasks' sums are
   added by slices, the driver re-estimates.  All training documents take part in each round.
4. The last round: blocks send their words' expected counts to the parts, and parts answer
   each block with the totals.  Shares of states travel as numbers of 16 bits.
5. The scaled forward recursion gives each whole text's exact likelihood.

Recursions run over texts side by side.  Longer ones are cut into pieces of `PIECE` tokens,
whose transfer matrices (the products of their steps) give the states between, so texts of
any length are scored exactly.  Nothing of the size of the vocabulary is ever broadcast or
collected, and a task holds one part of it at a time.

Nulls and edges: a null text is empty and has the end token only.  A null identifier
counts as training.  Repeated rows are texts of their own.  With no training text all
counts are 0 and both scores of a text are 0 for each token.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import kernels as K
from stepwell.llm import tables as S

STATES, TOLERANCE = 6, 2e-3
FREQUENT, CLASSES, SUFFIX = 1 << 15, 4096, 3
END = CLASSES
PIECE, RESCALE = 1024, 4
#: Bytes of text in a block, and tokens that recursions hold at a time (a longer text is held alone).
BLOCK_BYTES, HELD = 16 << 20, 1 << 20
_SLICES, _FULL = 64, 65535


def held_out(ids: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """crc32 of the identifier as text, modulo 7, is 2."""
    return np.fromiter((not e and zlib.crc32(str(i).encode()) % 7 == 2 for i, e in zip(ids.tolist(), empty.tolist(), strict=True)), bool, len(ids))


@dataclass
class Vocabulary:
    """Words behind each other in one run of bytes; 128 bits of hashes tell them apart.  The end token is the empty word."""

    body: np.ndarray
    lens: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Vocabulary:
        return cls(np.frombuffer(S.expand(row["words"]), np.uint8), _from_planes(row["word_lens"]).astype(np.int64))

    def row(self) -> dict:
        return {"word_lens": _planes(self.lens), "words": S.squeeze(self.body)}

    def of(self, order: np.ndarray) -> Vocabulary:
        return Vocabulary(K.taken(self.body, (np.cumsum(self.lens) - self.lens)[order], self.lens[order]), self.lens[order])

    def words(self) -> list[bytes]:
        data, ends = self.body.tobytes(), np.cumsum(self.lens)
        return [data[a:b] for a, b in zip((ends - self.lens).tolist(), ends.tolist(), strict=True)]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(len(self.lens), np.uint64), np.zeros(len(self.lens), np.uint64)
        some, ends = self.lens > 0, np.cumsum(self.lens)
        if some.any():
            out[0][some], out[1][some] = K.hashes(self.body, (ends - self.lens)[some], ends[some], _NO_SPACE)
        return out

    def classes(self) -> np.ndarray:
        """By the last bytes; the end token has a class of its own."""
        ends, last = np.cumsum(self.lens), np.zeros(len(self.lens), np.uint64)
        for i in range(1, SUFFIX + 1):
            own = np.flatnonzero(self.lens >= i)
            last[own] = last[own] << np.uint64(8) | self.body[ends[own] - i]
        return np.where(self.lens > 0, (K.mix(last) % np.uint64(CLASSES)).astype(np.int64), END)

    def dealt(self, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The words' order by part, and for each part that has any the range of its own."""
        where = (K.mix(self.hashes()[0]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(where[order])) + 1, [len(order)]]).tolist()
        return order, [(int(where[order[a]]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def sent(self, parts: int, *columns: np.ndarray):
        """For each part a row with its own words, and their part of the columns."""
        order, ranges = self.dealt(parts)
        moved, columns = self.of(order), [c[order] for c in columns]
        edges = np.concatenate([[0], np.cumsum(moved.lens)])
        for part, a, b in ranges:
            yield {"part": part, **Vocabulary(moved.body[edges[a] : edges[b]], moved.lens[a:b]).row()}, [c[a:b] for c in columns]


_NO_SPACE = np.zeros(256, bool)


# ---------------------------------------------------------------- blocks

_BLOCK_SQL = "block long, ids binary, lengths binary, tokens binary, word_lens binary, words binary, counts binary, n_train long"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("word_lens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n_train", pa.int64())])


def _distinct(w: K.Words, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct word, and each token's word; two hashes of 64 bits tell words apart."""
    _, first, tokens = np.unique(w.hashes, return_index=True, return_inverse=True)
    if len(first) and (w.second[first][tokens] != w.second).any():  # one hash is not enough here
        known: dict[bytes, int] = {}
        data = K.LOWER[body].tobytes()
        tokens = np.array([known.setdefault(data[s:e], len(known)) for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)])
        first = np.full(len(known), len(tokens))
        np.minimum.at(first, tokens, np.arange(len(tokens)))
    return first, tokens


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^31 with equal bytes behind each other: small ones leave long runs of zeros."""
    return S.squeeze(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T))


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(S.expand(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _blocks(target: int):
    """Documents as numbers of words, the commonest first, with an end each; word 0 is the end."""

    def blocks(batches):
        numbering = S.serial()
        for ids, empty, lens, body in S.gathered(batches, target):
            offsets = np.concatenate([[0], np.cumsum(lens)])
            w = K.words(body, offsets, lower=True, second=True)
            first, tokens = _distinct(w, body)
            order = np.argsort(-np.bincount(tokens, minlength=len(first)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            tokens = np.insert(rank[tokens], w.first[1:], 0)
            lengths = w.counts + 1
            train = np.repeat(~held_out(ids, empty), lengths)
            counts = np.bincount(tokens[train], minlength=len(first) + 1)
            starts, lens = w.starts[first[order]], (w.ends - w.starts)[first[order]]
            words = Vocabulary(K.taken(K.LOWER[body], starts, lens), np.append(0, lens))
            yield S.record([{"block": next(numbering), "ids": S.squeeze(np.concatenate([ids, empty.astype(np.int64)])), "lengths": S.squeeze(lengths.astype(np.int64)), "tokens": _planes(tokens), **words.row(), "counts": _planes(counts), "n_train": int(train.sum())}], _BLOCK)

    return blocks


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers, their nulls, lengths and tokens of a block's texts."""
    lengths, both = S.numbers(row["lengths"], np.int64), S.numbers(row["ids"], np.int64)
    return both[: len(lengths)], both[len(lengths) :].astype(bool), lengths, _from_planes(row["tokens"])


# ---------------------------------------------------------------- counts and symbols

_VOCABULARY_SQL = "part int, block long, word_lens binary, words binary, counts binary"
_VOCABULARY = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("word_lens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_SUMS_SQL = "slice int, sums binary"
_SUMS = pa.schema([("slice", pa.int32()), ("sums", pa.binary())])
_COUNTED_SQL = _SUMS_SQL + ", word binary, n long"
_COUNTED = pa.schema([*_SUMS, ("word", pa.binary()), ("n", pa.int64())])


def _vocabularies(parts: int):
    def send(batches):
        for batch in batches:
            for row in S.rows(batch):
                words, counts = Vocabulary.read(row), _from_planes(row["counts"])
                known = np.flatnonzero(counts)
                for sent, (own,) in words.of(known).sent(parts, counts[known]):
                    yield S.record([{"block": row["block"], **sent, "counts": _planes(own)}], _VOCABULARY)

    return send


def _slices(flat: np.ndarray) -> list[dict]:
    return [{"slice": i, "sums": S.squeeze(x)} for i, x in enumerate(np.array_split(flat, _SLICES))]


def _count(tokens: int, frequent: int):
    """Of a task's parts the frequent words, and for each class the tokens and words that are not, in slices."""

    def count(batches):
        rest, some = np.zeros((CLASSES + 1, 2)), False
        for _, held in _streamed(batches, "part"):
            total: dict[bytes, int] = {}
            for row in held:
                for word, c in zip(Vocabulary.read(row).words(), _from_planes(row["counts"]).tolist(), strict=True):
                    total[word] = total.get(word, 0) + c
            often = sorted(x for x in total if x and total[x] * frequent >= tokens)
            for a in range(0, len(often), 4096):
                yield S.record([{"word": x, "n": total[x]} for x in often[a : a + 4096]], _COUNTED)
            rare = [x for x in total if not x or total[x] * frequent < tokens]
            classes = Vocabulary(np.frombuffer(b"".join(rare), np.uint8), np.array([len(x) for x in rare], np.int64)).classes()
            rest[:, 0] += np.bincount(classes, weights=[total[x] for x in rare], minlength=CLASSES + 1)
            rest[:, 1] += np.bincount(classes, minlength=CLASSES + 1)
            some = True
        if some:
            yield S.record(_slices(rest.ravel()), _COUNTED)

    return count


def _streamed(batches, key: str):
    """Rows of a partition sorted by `key`: each value with an iterator over its rows, read one at a time."""
    rows = (row for batch in batches for row in S.rows(batch))
    held = next(rows, None)

    def own(value):
        nonlocal held
        while held is not None and held[key] == value:
            row, held = held, None
            yield row
            held = next(rows, None)

    while held is not None:
        yield held[key], own(held[key])


def _add_slices(batches):
    for i, held in _streamed(batches, "slice"):
        total = 0
        for r in held:
            total = total + S.numbers(r["sums"], np.float64)
        yield S.record([{"slice": i, "sums": S.squeeze(total)}], _SUMS)


def _added(sums: DataFrame) -> np.ndarray | None:
    """The vector that tasks sent in slices, added up."""
    parts = sorted(sums.repartition(_SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_add_slices, _SUMS_SQL).collect())
    return np.concatenate([S.numbers(bytes(r.sums), np.float64) for r in parts]) if parts else None


@dataclass
class Symbols:
    """What blocks need to know of all: bounded by `frequent` and CLASSES."""

    tokens: int  # N
    distinct: int  # V
    hashes: tuple[np.ndarray, np.ndarray, np.ndarray]  # of frequent words, sorted by the first, with their symbols
    counts: np.ndarray  # c of frequent words and the end, by symbol; 0 for classes
    types: np.ndarray  # known words by symbol
    base: np.ndarray  # probability of each symbol

    def of(self, words: Vocabulary) -> np.ndarray:
        symbol, (first, second) = words.classes(), words.hashes()
        if len(self.hashes[0]):
            at = np.minimum(np.searchsorted(self.hashes[0], first), len(self.hashes[0]) - 1)
            own = (self.hashes[0][at] == first) & (self.hashes[1][at] == second) & (words.lens > 0)
            symbol[own] = self.hashes[2][at[own]]
        return symbol


def _symbols(counted: DataFrame, tokens: int) -> Symbols:
    often = sorted((bytes(r.word), r.n) for r in counted.filter("word is not null").select("word", "n").collect())  # `frequent` rows at most
    flat = _added(counted.filter("word is null").select("slice", "sums"))
    rest = np.zeros((CLASSES + 1, 2)) if flat is None else flat.reshape(-1, 2)
    words = Vocabulary(np.frombuffer(b"".join(word for word, _ in often), np.uint8), np.array([len(word) for word, _ in often], np.int64))
    first, second = words.hashes()
    order = np.argsort(first)
    own = np.array([n for _, n in often], float)
    counts = np.concatenate([np.zeros(CLASSES), rest[END:, 0], own])
    types = np.concatenate([rest[:, 1], np.ones(len(own))])
    base = np.concatenate([rest.sum(axis=1), own + 1]) + 1
    return Symbols(tokens, int(types.sum()), (first[order], second[order], END + 1 + order), counts, types, base / base.sum())


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


def first_model(base: np.ndarray, states: int = STATES) -> Model:
    """Sticky states whose emissions are the base, tilted by fixed pseudo-random factors."""
    tilt = K.stream(97, len(base) * states).reshape(len(base), states) / 2.0**64
    emit = base[:, None] * np.exp(tilt)
    move = np.full((states, states), 0.01 / max(states - 1, 1)) + np.eye(states) * (0.99 - 0.01 / max(states - 1, 1))
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Pieces:
    """Sequences cut into pieces of at most PIECE tokens, the longest first, to be worked off side by side.

    `tokens` are in the order of the work: first tokens of all pieces, then second ones, and so on; `edges` are
    the places where steps begin, so that step t of piece i is at edges[t] + i.
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        self.texts = len(lengths)
        n = -(-lengths // PIECE)
        self.text = np.repeat(np.arange(len(lengths)), n)
        self.nth = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(np.cumsum(lengths) - lengths, n) + PIECE * self.nth
        size = np.minimum(np.repeat(lengths, n) - PIECE * self.nth, PIECE)
        order = np.argsort(-size, kind="stable")
        self.text, self.nth, begin, self.size = self.text[order], self.nth[order], begin[order], size[order]
        self.steps = int(self.size[0]) if len(self.size) else 0
        active = np.searchsorted(-self.size, -np.arange(self.steps), side="left")  # pieces longer than t
        self.edges = np.concatenate([[0], np.cumsum(active)])
        step = np.repeat(np.arange(self.steps), active)
        piece = np.arange(self.edges[-1]) - self.edges[step]
        self.tokens = tokens[begin[piece] + step]
        self.opens = self.nth == 0
        self.cut = np.flatnonzero(n[self.text] > 1)  # pieces of texts with several
        by = self.cut[np.lexsort((self.text[self.cut], self.nth[self.cut]))]
        self.rounds = np.split(by, np.searchsorted(self.nth[by], np.arange(1, int(n.max()) if len(n) else 1))) if len(by) else []


def _transfers(p: Pieces, model: Model, emitted: np.ndarray) -> np.ndarray:
    """Product (from, to, piece) of the steps of each piece in `p.cut`, up to a factor; a text's first step has no move."""
    k, n = len(model.start), len(p.cut)
    product = np.repeat(np.eye(k, dtype=emitted.dtype)[:, :, None], n, axis=2)
    for t in range(int(p.size[p.cut[0]])):
        m = int(np.searchsorted(p.cut, p.edges[t + 1] - p.edges[t]))
        moved = np.matmul(model.move.T, product[:, :, :m])
        if t == 0:
            moved[:, :, p.opens[p.cut]] = np.eye(k)[:, :, None]
        product[:, :, :m] = moved * emitted[:, p.edges[t] + p.cut[:m]]
        if t % RESCALE == RESCALE - 1:
            product[:, :, :m] /= product[:, :, :m].max(axis=(0, 1))
    return product / product.max(axis=(0, 1))


def _between(p: Pieces, model: Model, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State weights before each piece (adding up to 1), and behind it (of any size); states by pieces."""
    k = len(model.start)
    before, after = np.repeat(model.start[:, None], len(p.size), axis=1), np.ones((k, len(p.size)), emitted.dtype)
    if not len(p.cut):
        return before, after
    product, place = _transfers(p, model, emitted), np.zeros(len(p.size), np.int64)
    place[p.cut] = np.arange(len(p.cut))
    state = np.repeat(model.start[:, None], p.texts, axis=1)
    for own in p.rounds:
        texts = p.text[own]
        before[:, own] = state[:, texts]
        moved = np.einsum("in,iln->ln", state[:, texts], product[:, :, place[own]])
        state[:, texts] = moved / moved.sum(axis=0)
    state = np.ones((k, p.texts), emitted.dtype)
    for own in reversed(p.rounds):
        texts = p.text[own]
        after[:, own] = state[:, texts]
        moved = np.einsum("iln,ln->in", product[:, :, place[own]], state[:, texts])
        state[:, texts] = moved / moved.max(axis=0)
    return before, after


def _forward(p: Pieces, model: Model, emitted: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward weights (adding up to 1) and scales of all tokens, in the order of the work."""
    out, scale, last, move = np.empty_like(emitted), np.empty(emitted.shape[1], emitted.dtype), before, model.move.T.copy()
    for t in range(p.steps):
        a, b = p.edges[t], p.edges[t + 1]
        now = out[:, a:b]
        np.matmul(move, last[:, : b - a], out=now)
        if t == 0:
            now[:, p.opens] = before[:, p.opens]
        now *= emitted[:, a:b]
        total = scale[a:b]
        np.add.reduce(now, axis=0, out=total)
        now /= total
        last = now
    return out, scale


def _parts_of(lengths: np.ndarray):
    """Ranges of texts of at most HELD tokens each; a longer text is a range of its own."""
    return K.pieces(np.concatenate([[0], np.cumsum(lengths)]), HELD)


def log_likelihood(tokens: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Natural logarithm of each sequence's probability."""
    edges, out, table = np.concatenate([[0], np.cumsum(lengths)]), np.zeros(len(lengths)), model.emit.T.copy()
    for a, b in _parts_of(lengths):
        p = Pieces(tokens[edges[a] : edges[b]], lengths[a:b])
        out[a:b] = _log(p, *_scaled(p, model, table)[2:])
    return out


def _scaled(p: Pieces, model: Model, table: np.ndarray) -> tuple:
    emitted = np.take(table, p.tokens, axis=1)
    before, after = _between(p, model, emitted)
    return emitted, (before, after), *_forward(p, model, emitted, before)


def _log(p: Pieces, _: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Each text's log likelihood."""
    piece = np.arange(len(scale)) - np.repeat(p.edges[:-1], np.diff(p.edges))
    return np.bincount(p.text[piece], weights=np.log(scale), minlength=p.texts)


def expected(tokens: np.ndarray, lengths: np.ndarray, model: Model, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the sequences, and their log likelihood, with numbers of the kind given."""
    k, s = len(model.start), len(model.emit)
    most = model.emit.max(axis=1, keepdims=True)  # a factor of a token's emissions changes no share
    model = Model(model.start.astype(kind), model.move.astype(kind), (model.emit / most).astype(kind))
    factor, table = np.log(most[:, 0]), model.emit.T.copy()
    starts, moves, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros((s, k)), 0.0
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for a, b in _parts_of(lengths):
        p = Pieces(tokens[edges[a] : edges[b]], lengths[a:b])
        emitted, between, weights, scale = _scaled(p, model, table)
        log += float(_log(p, weights, scale).sum()) + float(factor[p.tokens].sum())
        _backward(p, model, emitted, between, weights, scale, moves)
        if p.steps:
            starts += weights[:, : len(p.size)][:, p.opens].sum(axis=1)
        for i in range(k):
            emits[:, i] += np.bincount(p.tokens, weights=weights[i], minlength=s)
    return starts, moves * model.move, emits, log


def _backward(p: Pieces, model: Model, emitted: np.ndarray, between: tuple, weights: np.ndarray, scale: np.ndarray, moves: np.ndarray) -> None:
    """Turns forward weights into those of the states given the whole text, and adds up moves (without the factors of the model)."""
    before, beta = between
    done = 0
    for t in range(p.steps - 1, -1, -1):
        a, b = p.edges[t], p.edges[t + 1]
        now, m = weights[:, a:b], b - a
        if m > done:  # pieces that end here
            beta[:, done:m] /= np.einsum("in,in->n", now[:, done:], beta[:, done:m])
            done = m
        own = beta[:, :m]
        here = emitted[:, a:b] * own
        here /= scale[a:b]
        now *= own
        if t:
            c = p.edges[t - 1]
            moves += weights[:, c : c + m] @ here.T
        else:
            moves += before[:, ~p.opens] @ here[:, ~p.opens].T
        np.matmul(model.move, here, out=own)


def estimate(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, base: np.ndarray, weight: float = 100.0) -> Model:
    """The model that the expected counts give, smoothed towards the base."""
    start = starts + 1
    move = moves + 1
    emit = emits + weight * base[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _baum_welch(shared):
    """A task's expected counts, in slices: flat starts, moves, log likelihood and emissions."""

    def count(batches):
        symbols, model = shared.value
        total = None
        for batch in batches:
            for row in S.rows(batch):
                starts, moves, emits, log = _expected_of(row, symbols.of(Vocabulary.read(row)), model)
                flat = np.concatenate([starts, moves.ravel(), [log], emits.ravel()])
                total = flat if total is None else total + flat
        if total is not None:
            yield S.record(_slices(total), _SUMS)

    return count


def _expected_of(row: dict, symbol: np.ndarray, model: Model, by_word: bool = False) -> tuple:
    """Expected counts of a block's training texts, emissions by symbol or by word."""
    ids, empty, lengths, tokens = _texts(row)
    train = ~held_out(ids, empty)
    own = Model(model.start, model.move, model.emit[symbol])
    starts, moves, emits, log = expected(tokens[np.repeat(train, lengths)], lengths[train], own, np.float32)
    if not by_word:
        emits = np.stack([np.bincount(symbol, weights=e, minlength=len(model.emit)) for e in emits.T], axis=1)
    return starts, moves, emits, log


@dataclass
class Trained:
    model: Model  # of the last round's expected counts
    tied: Model  # emissions of symbols
    shares: np.ndarray  # of each symbol's expected counts, by state
    unseen: np.ndarray  # shares of the event that a word is unseen
    sums: np.ndarray  # expected counts by symbol and state
    z: np.ndarray  # what emissions of a state are divided by
    history: list[float]  # log likelihood before each round


def train(blocks: DataFrame, symbols: Symbols, states: int = STATES, tolerance: float = TOLERANCE) -> Trained | None:
    """Baum-Welch on symbols over all training texts, until a round gains less than `tolerance` of the log likelihood.

    Expected counts of the last round are those of `tied`, the model before it; None without training texts.
    """
    spark = blocks.sparkSession
    model, history, k = first_model(symbols.base, states), [], states
    while True:
        shared = spark.sparkContext.broadcast((symbols, model))
        flat = _added(blocks.select("ids", "lengths", "tokens", "word_lens", "words").mapInArrow(_baum_welch(shared), _SUMS_SQL))
        shared.unpersist()
        if flat is None or not symbols.tokens:
            return None
        history.append(float(flat[k + k * k]))
        sums = flat[k + k * k + 1 :].reshape(-1, k)
        after = estimate(flat[:k], flat[k : k + k * k].reshape(k, k), sums, symbols.base)
        if len(history) > 1 and history[-1] - history[-2] <= tolerance * abs(history[-2]):
            break
        model = after
    shares = model.emit * sums.sum(axis=0)  # smoothed: a class without tokens divides as the base does
    shares /= shares.sum(axis=1, keepdims=True)
    unseen = symbols.types @ shares / max(symbols.types.sum(), 1)
    z = sums.sum(axis=0) + symbols.types @ shares + unseen
    return Trained(after, model, shares, unseen, sums, z, history)


# ---------------------------------------------------------------- the last round, and scores

_OWN_SQL = _VOCABULARY_SQL + ", shares binary"
_OWN = pa.schema([*_VOCABULARY, ("shares", pa.binary())])
_TOTALS_SQL = "part int, block long, counts binary, shares binary"
_TOTALS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("shares", pa.binary())])


def _to_16_bits(sums: np.ndarray) -> np.ndarray:
    total = sums.sum(axis=1, keepdims=True)
    return np.rint(sums / np.where(total > 0, total, 1) * _FULL).astype(np.uint16)


def _from_16_bits(shares: np.ndarray) -> np.ndarray:
    total = shares.sum(axis=1, keepdims=True, dtype=np.int64)
    return shares / np.where(total > 0, total, 1)


def _own(shared, parts: int):
    """Expected counts of a block's own words, those in classes, for the parts that the words are dealt to."""

    def own(batches):
        symbols, trained = shared.value
        for batch in batches:
            for row in S.rows(batch):
                words, counts = Vocabulary.read(row), _from_planes(row["counts"])
                symbol = symbols.of(words)
                shares = _to_16_bits(_expected_of(row, symbol, trained.tied, by_word=True)[2])
                rare = np.flatnonzero(symbol < END)
                for sent, (n, own_shares) in words.of(rare).sent(parts, counts[rare], shares[rare]):
                    yield S.record([{"block": row["block"], **sent, "counts": _planes(n), "shares": S.squeeze(own_shares.T.copy())}], _OWN)

    return own


def _totals(states: int):
    """A part adds up its words' counts and answers each block."""

    def totals(batches):
        for part, held in _streamed(batches, "part"):
            index: dict[bytes, int] = {}
            blocks, counts, sums = [], np.zeros(0, np.int64), np.zeros((0, states))
            for row in held:
                at = np.array([index.setdefault(x, len(index)) for x in Vocabulary.read(row).words()])
                if len(index) > len(counts):  # twice the room each time
                    more = max(len(index), 2 * len(counts)) - len(counts)
                    counts, sums = np.append(counts, np.zeros(more, np.int64)), np.concatenate([sums, np.zeros((more, states))])
                c = _from_planes(row["counts"])
                counts[at] += c
                sums[at] += c[:, None] * _from_16_bits(S.numbers(row["shares"], np.uint16).reshape(states, -1).T)
                blocks.append((row["block"], at.astype(np.int32)))
            shares = _to_16_bits(sums)
            for block, at in blocks:
                yield S.record([{"part": part, "block": block, "counts": S.squeeze(counts[at]), "shares": S.squeeze(shares[at].T.copy())}], _TOTALS)

    return totals


_SCORE_SQL = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared, parts: int):
    """Blocks and the answers to them, sorted by block: the scores of the blocks' texts."""

    def score(batches):
        for _, held in _streamed(batches, "block"):
            yield one(next(held), held)

    def one(row, answers):
        symbols, trained = shared.value
        ids, empty, lengths, tokens = _texts(row)
        words = Vocabulary.read(row)
        symbol = symbols.of(words)
        rare = np.flatnonzero(symbol < END)
        order, ranges = words.of(rare).dealt(parts)
        counts = symbols.counts[symbol]
        n = len(ids)
        base, log = np.zeros(n), np.zeros(n)
        if trained is not None:
            k = len(trained.z)
            emit = trained.sums[symbol] + trained.shares[symbol]
            emit[rare] = trained.unseen
            where = {part: rare[order[a:b]] for part, a, b in ranges}
            for answer in answers:
                mine = where[answer["part"]]
                counts[mine] = S.numbers(answer["counts"], np.int64)
                known = counts[mine] > 0
                shares = _from_16_bits(S.numbers(answer["shares"], np.uint16).reshape(k, -1).T)[known]
                mine = mine[known]
                emit[mine] = counts[mine][:, None] * shares + trained.shares[symbol[mine]]
            log = log_likelihood(tokens, lengths, Model(trained.model.start, trained.model.move, emit / trained.z)) / np.log(10)
        edges = (np.cumsum(lengths) - lengths)[: n]
        if n:
            base = np.add.reduceat(np.log10((counts + 1) / (symbols.tokens + symbols.distinct + 1))[tokens], edges)
            known = np.add.reduceat((counts > 0).astype(np.int64)[tokens], edges)
        else:
            known = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([K.long_array(ids, empty), pa.array(held_out(ids, empty)), pa.array(lengths), pa.array(known), pa.array(np.full(n, symbols.tokens, np.int64)), pa.array(base), pa.array(log)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def _by_part(df: DataFrame, tasks: int, key: str = "part", *then: str) -> DataFrame:
    return df.repartition(tasks, key).sortWithinPartitions(key, *then)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, tolerance: float = TOLERANCE, frequent: int = FREQUENT) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = df.sparkSession
    S.tune(spark)
    two = S.two(df, id_col, text_col)
    blocks = S.save(two.mapInArrow(_blocks(BLOCK_BYTES), _BLOCK_SQL), "words")
    found = blocks.agg(F.sum("n_train").alias("n"), F.sum(F.octet_length("words") + F.octet_length("tokens")).alias("size")).first()
    tokens, tasks = int(found.n or 0), S.partitions(spark, found.size or 0, 8 << 20)
    parts = 4 * tasks
    sent = blocks.select("block", "word_lens", "words", "counts").mapInArrow(_vocabularies(parts), _VOCABULARY_SQL)
    counted = S.save(_by_part(sent, tasks).mapInArrow(_count(tokens, frequent), _COUNTED_SQL), "counts")
    symbols = _symbols(counted, tokens)
    trained = train(blocks, symbols, states, tolerance)
    shared = spark.sparkContext.broadcast((symbols, trained))
    texts = blocks.select("block", F.lit(0).alias("kind"), F.lit(-1).alias("part"), "ids", "lengths", "tokens", "word_lens", "words")
    if trained is not None:
        own = blocks.drop("n_train").mapInArrow(_own(shared, parts), _OWN_SQL)
        totals = _by_part(own, tasks).mapInArrow(_totals(states), _TOTALS_SQL)
        texts = texts.unionByName(totals.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return _by_part(texts, tasks, "block", "kind").mapInArrow(_score(shared, parts), _SCORE_SQL)
