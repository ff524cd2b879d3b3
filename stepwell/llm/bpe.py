"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding reads text in chunks and keeps a bounded tail.  Words (the byte-level
pre-tokeniser's pieces) are merged on their own; a word too long to hold is merged in a
window, and a token is emitted once no text to come can change it.  How far one must look
for that follows from the merge list: whether rule i joins u and v at a place depends on
the len(v) bytes behind it, and on whether a rule of smaller rank takes the last piece of
v away to the right, which again depends on a bounded number of bytes; ranks decrease
along such a chain, so

    need(i) = len(v_i) + max(need(j) : j < i, u_j a rightmost piece of v_i, or 0)

and the largest need is a sufficient lookahead.  A token that ends so far before the
window's end is final.  Memory is the window, whatever the text's or the word's length.

Decoding is a state machine from tokens to bytes to text: an incomplete character waits
for its bytes, an impossible one becomes U+FFFD.

The tokenizer file is read on the driver and sent to the executors as it is (its size is
checked); it is never copied elsewhere.  Nulls and edges: a null text is empty and has no
tokens.  A special token's text in the input becomes that token, as the tokenizers library
does by default.  Repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stepwell.llm import kernels as K
from stepwell.llm import tables as S

#: Letters and digits that came after Unicode 16, which the tokenizers library takes for other signs.
NEWER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479"""
_NEW = "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in NEWER.split()) + "]"
LETTER, DIGIT, OTHER = rf"[\p{{L}}--{_NEW}]", rf"[\p{{N}}--{_NEW}]", rf"[[^\s\p{{L}}\p{{N}}]||{_NEW}]"
#: The byte-level pre-tokeniser's pattern.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?{}+| ?{}+| ?{}+|\\s+(?!\\S)|\\s+"
CHUNK, LONG, REMEMBERED, SHORT = 1 << 16, 1 << 12, 300_000, 48
#: Places of the arrays in which new words are merged side by side; bounds their temporaries.
PLACES = 1 << 17
#: Bytes of text that are encoded at a time, where no text is longer.
PIECE = 1 << 20
MAX_FILE = 64 << 20
_NEVER = 1 << 60


def packed(tokens: Iterable[int]) -> bytes:
    """Tokens as 32-bit integers in the machine's order: a seventh of a list's memory."""
    return np.fromiter(tokens, np.int32).tobytes()


def unpacked(data: bytes | bytearray) -> list[int]:
    return np.frombuffer(data, np.int32).tolist()


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level BPE vocabulary with its merge list, and the lookahead that the list needs."""

    def __init__(self, data: bytes):
        found = json.loads(data)
        if found["model"]["type"] != "BPE" or (found.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or found.get("normalizer") or found["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        letter = byte_letters()
        plain = lambda token: bytes(letter[c] for c in token)
        vocabulary = found["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in found.get("added_tokens") or [] if t["content"]}
        self.bytes_of: dict[int, bytes] = {i: plain(t) for t, i in vocabulary.items() if all(c in letter for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [vocabulary[c] for c in sorted(letter, key=letter.__getitem__)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.sides: list[tuple[int, int]] = []
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault(vocabulary[a] << 24 | vocabulary[b], r)
            self.made.append(vocabulary[a + b])
            self.sides.append((vocabulary[a], vocabulary[b]))
        self.lookahead = self._lookahead()
        order = sorted(self.rank)
        self._keys, self._values = np.array(order or [-1], np.int64), np.array([self.rank[k] for k in order] or [_NEVER], np.int64)
        self._made, self._bytes = np.array(self.made or [0], np.int64), np.array(self.of_byte, np.int64)
        self._byte_at = np.full(max(self.bytes_of) + 1, 256)
        self._byte_at[self._bytes] = np.arange(256)
        self._first = np.full((257, 257), _NEVER)
        self._first[:256, :256] = self._ranks(self._bytes[:, None], self._bytes[None, :])
        self.known: dict[str, bytes] = {}  # packed tokens of a word

    def _lookahead(self) -> int:
        right: dict[int, int] = {}  # of a token its right part
        longest: dict[int, int] = {}  # of a left part, the largest need of the rules so far
        most = 1
        for (a, b), token in zip(self.sides, self.made, strict=True):
            taken, x = longest.get(b, 0), b
            while x in right:
                x = right[x]
                taken = max(taken, longest.get(x, 0))
            need = len(self.bytes_of[b]) + taken
            longest[a] = max(longest.get(a, 0), need)
            right.setdefault(token, b)
            most = max(most, need)
        return most

    def learn(self, words: Iterable[str]) -> None:
        """Merge all words not known yet side by side, in arrays: what `merge` does for one."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        new = [w for w in set(words).difference(self.known) if len(w) <= SHORT]
        data = [w.encode() for w in new]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        for low, high in ((0, 8), (8, 16), (16, 4 * SHORT)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            most = PLACES // high
            for a in range(0, len(own), most):
                part = own[a : a + most].tolist()
                for i, found in zip(part, self._merged([data[i] for i in part]), strict=True):
                    self.known[new[i]] = found

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._values[at], _NEVER)

    def _merged(self, data: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        n, width = len(data), int(sizes.max())
        ids = np.full((n, width + 1), -1)
        inside = np.arange(width + 1) < sizes[:, None]
        ids[inside] = self._bytes[np.frombuffer(b"".join(data), np.uint8)]
        ranks = self._pairs(ids)
        out: list = [None] * n
        rows, column = np.arange(n), np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            all_ = np.arange(len(rows))
            best = ranks[all_, at]
            done = best == _NEVER
            if done.any():
                ended = ids[done].astype(np.int32)
                whole, width4 = ended.tobytes(), 4 * ended.shape[1]
                for j, (i, n) in enumerate(zip(rows[done].tolist(), (ended >= 0).sum(axis=1).tolist(), strict=True)):
                    out[i] = whole[j * width4 : j * width4 + 4 * n]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                all_ = np.arange(len(rows))
                if not len(rows):
                    break
            later = column + (column > at[:, None])
            later[:, -1] = width
            ids = np.take_along_axis(ids, later, axis=1)
            ids[all_, at] = self._made[best]
            ranks = np.take_along_axis(ranks, np.minimum(later[:, :-1], width - 1), axis=1)
            ranks[:, -1] = _NEVER
            ranks[all_, at] = self._ranks(ids[all_, at], ids[all_, at + 1])
            before = at > 0
            ranks[all_[before], at[before] - 1] = self._ranks(ids[all_[before], at[before] - 1], ids[all_[before], at[before]])
        return out

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        """Ranks of all neighbours, at the start, when each is a byte."""
        table = self._first
        ranks = table[np.where(ids[:, :-1] >= 0, self._byte_at[ids[:, :-1]], 256), np.where(ids[:, 1:] >= 0, self._byte_at[ids[:, 1:]], 256)]
        return ranks

    def merge(self, word: bytes) -> list[int]:
        """Join the pair of least rank, the leftmost of equals, until no pair has a rank."""
        ids = [self.of_byte[b] for b in word]
        get, made = self.rank.get, self.made
        ranks = [get(a << 24 | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == _NEVER:
                break
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 24 | ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | ids[i], _NEVER)
        return ids


class Window:
    """Merges one word that arrives in parts, and emits tokens once they are final."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.full = max(4 * merges.lookahead, 256)

    def feed(self, part: bytes) -> Iterator[int]:
        for a in range(0, len(part), self.full):
            self.held += part[a : a + self.full]
            if len(self.held) >= self.full:
                yield from self._settled(len(self.held) - self.merges.lookahead)

    def _settled(self, until: int) -> Iterator[int]:
        at = 0
        for token in self.merges.merge(self.held):
            size = len(self.merges.bytes_of[token])
            if at + size > until:
                break
            at += size
            yield token
        self.held = self.held[at:]

    def end(self) -> Iterator[int]:
        yield from self.merges.merge(self.held)
        self.held = b""


_WORDS = regex.compile(PATTERN.format(LETTER, DIGIT, OTHER), regex.V1)
#: The same for texts that need less: without the newer letters, and in ASCII.
_OLDER = regex.compile(PATTERN.format(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"), regex.V1)
_ASCII = re.compile(PATTERN.format("[A-Za-z]", "[0-9]", r"[^\sA-Za-z0-9]"), re.ASCII)
_LATE, _NEWER = re.compile(f"[\\U{int(NEWER.split()[0], 16):08X}-\\U0010FFFF]"), re.compile(_NEW)
_RUNS = {"L": regex.compile(f"{LETTER}+", regex.V1), "N": regex.compile(f"{DIGIT}+", regex.V1), "O": regex.compile(f"{OTHER}+", regex.V1), "S": regex.compile(r"\s+", regex.V1)}


def words_of(text: str) -> list[str]:
    """The pre-tokeniser's pieces of a text."""
    if text.isascii():
        return _ASCII.findall(text)
    if _LATE.search(text) and _NEWER.search(text):
        return _WORDS.findall(text)
    return _OLDER.findall(text)


class Encoder:
    """Text in, tokens out, chunk by chunk; `tokens(text)` does a whole text in chunks."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.tail, self.window, self.kind = "", None, ""

    def word(self, word: str) -> bytes:
        m = self.merges
        found = m.known.get(word)
        if found is None:
            data = word.encode()
            if len(data) > 4 * m.lookahead and len(data) > 256:
                window = Window(m)
                return packed(window.feed(data)) + packed(window.end())
            found = packed(m.merge(data))
            if len(word) <= SHORT:
                if len(m.known) >= REMEMBERED:
                    m.known.clear()
                m.known[word] = found
        return found

    def feed(self, chunk: str, out: bytearray) -> None:
        if self.window:
            chunk = self._run(self.tail + chunk, out)
            if chunk is None:
                return
        text = self.tail + chunk
        words = words_of(text)
        self.merges.learn(words)
        # the last word may go on, and the one before may turn out to be the quote of a contraction
        get = self.merges.known.get
        for w in words[:-2]:
            out += get(w) or self.word(w)
        self.tail = "".join(words[-2:])
        if len(self.tail) > LONG:
            if len(words) > 1:
                out += self.word(words[-2])
            self.tail = words[-1]
            if len(self.tail) > LONG:
                self._begin(out)

    def _begin(self, out: bytearray) -> None:
        """The word held is long: from here its run goes through a window."""
        last = self.tail[-1]
        self.kind = next(k for k, p in _RUNS.items() if p.match(last))
        self.window = Window(self.merges)
        text, self.tail = self.tail, ""
        if self.kind == "S":
            text, self.tail = text[:-1], text[-1]  # the last white space may belong to the next word
        out += packed(self.window.feed(text.encode()))

    def _run(self, text: str, out: bytearray) -> str | None:
        """Feed the rest of the long run; what follows it, or None if it may go on."""
        self.tail = ""
        found = _RUNS[self.kind].match(text)
        end = found.end() if found else 0
        if end == len(text):
            keep = 1 if self.kind == "S" and end else 0
            out += packed(self.window.feed(text[: end - keep].encode()))
            self.tail = text[end - keep :]
            return None
        keep = 1 if self.kind == "S" else 0
        out += packed(self.window.feed(text[: end - keep].encode()))
        out += packed(self.window.end())
        self.window = None
        return text[end - keep :]

    def end(self, out: bytearray) -> None:
        if self.window:
            out += packed(self.window.feed(self.tail.encode()))
            out += packed(self.window.end())
        else:
            for w in words_of(self.tail):
                out += self.word(w)
        self.tail, self.window = "", None

    def plain(self, text: str, out: bytearray) -> None:
        if len(text) <= CHUNK:  # all of it is one chunk, so every word is final
            self._known(words_of(text), out)
            return
        for a in range(0, len(text), CHUNK):
            self.feed(text[a : a + CHUNK], out)
        self.end(out)

    def _known(self, words: list[str], out: bytearray) -> None:
        found = list(map(self.merges.known.get, words))
        if None in found:
            found = [x or self.word(w) for w, x in zip(words, found, strict=True)]
        out += b"".join(found)

    def packed(self, texts: list[str]) -> list[bytearray]:
        """Packed tokens of each text; the words of all short ones are looked up together."""
        special = self.merges.special
        words = [words_of(t) if len(t) <= CHUNK and not any(s in t for s in special) else None for t in texts]
        self.merges.learn(set().union(*filter(None, words)))
        out = []
        for text, own in zip(texts, words, strict=True):
            out.append(bytearray())
            if own is None:
                self._whole(text, out[-1])
            else:
                self._known(own, out[-1])
        return out

    def many(self, texts: list[str]) -> list[list[int]]:
        return [unpacked(x) for x in self.packed(texts)]

    def tokens(self, text: str) -> list[int]:
        out = bytearray()
        self._whole(text, out)
        return unpacked(out)

    def _whole(self, text: str, out: bytearray) -> None:
        special, at = self.merges.special, 0
        if any(s in text for s in special):
            for found in regex.finditer("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), text):
                self.plain(text[at : found.start()], out)
                out += packed([special[found[0]]])
                at = found.end()
        self.plain(text[at:], out)


class Decoder:
    """Tokens in, text out: bytes of an unfinished character wait."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, tokens)))

    def end(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[int, Merges] = {}


def loaded(data: bytes) -> Merges:
    """One vocabulary a process, and with it the words that it remembers."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Merges(data)
    return _LOADED[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    return data


def little_endian(tokens: bytes | bytearray) -> bytes:
    return np.frombuffer(tokens, np.int32).astype("<u4").tobytes()


def _encoded(array: pa.Array, encoder: Encoder) -> Iterator[tuple[int, int, list[bytearray]]]:
    """Packed tokens of a column's texts, a range of rows at a time."""
    body, offsets = K.column(array)
    for a, b in K.pieces(offsets, PIECE):
        yield a, b, encoder.packed([str(body[x:y], "utf-8") for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)])


def _arrays(found: list[bytearray]) -> pa.Array:
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))]))


def _text(tokens: np.ndarray, merges: Merges) -> Iterator[str]:
    """What tokens decode to, in parts; a token that the vocabulary lacks is left out."""
    decoder, known = Decoder(merges), merges.bytes_of
    for i in range(0, len(tokens), 1 << 14):
        part = tokens[i : i + (1 << 14)].tolist()
        yield decoder.feed(part if known.keys() >= set(part) else [t for t in part if t in known])
    yield decoder.end()


def encode(df: DataFrame, vocabulary: bytes, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """All columns of the rows, and the tokens of their text as `out_col` (array of int)."""
    return _transduce(df, vocabulary, text_col, out_col, None)


def round_trip(df: DataFrame, vocabulary: bytes, text_col: str = "text", out_col: str = "token_ids", same_col: str = "round_trip") -> DataFrame:
    """As `encode`, and in the same pass whether the tokens decode to the text, as `same_col`."""
    return _transduce(df, vocabulary, text_col, out_col, same_col)


def _transduce(df: DataFrame, vocabulary: bytes, text_col: str, out_col: str, same_col: str | None) -> DataFrame:
    spark = df.sparkSession
    S.tune(spark)
    shared, at = spark.sparkContext.broadcast(vocabulary), df.columns.index(text_col)

    def same(text: str, tokens: bytearray, merges: Merges) -> bool:
        i = 0
        for part in _text(np.frombuffer(tokens, np.int32), merges):
            if not text.startswith(part, i):
                return False
            i += len(part)
        return i == len(text)

    def run(batches):
        for batch in batches:
            merges = loaded(shared.value)
            for a, b, found in _encoded(batch.column(at), Encoder(merges)):
                part = batch.slice(a, b - a)
                columns, names = [*part.columns, _arrays(found)], [*batch.schema.names, out_col]
                if same_col:
                    texts = part.column(at)
                    columns.append(pa.array([same(texts[i].as_py() or "", x, merges) for i, x in enumerate(found)], pa.bool_()))
                    names.append(same_col)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    shape = T.StructType([*df.schema.fields]).add(out_col, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, shape.add(same_col, "boolean") if same_col else shape)


def digests(df: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_tokens, SHA-256 of the tokens as little-endian 32-bit integers, and of the text they decode to."""
    spark = df.sparkSession
    S.tune(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            merges, rows = loaded(shared.value), []
            for _, _, found in _encoded(batch.column(1), Encoder(merges)):
                for tokens in found:
                    text = hashlib.sha256()
                    for part in _text(np.frombuffer(tokens, np.int32), merges):
                        text.update(part.encode())
                    rows.append((len(tokens) >> 2, hashlib.sha256(little_endian(tokens)).hexdigest(), text.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return S.two(df, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(df: DataFrame, vocabulary: bytes, tokens_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """All columns of the rows, and the text that `tokens_col` decodes to; null for null."""
    spark = df.sparkSession
    S.tune(spark)
    shared, at = spark.sparkContext.broadcast(vocabulary), df.columns.index(tokens_col)

    def run(batches):
        for batch in batches:
            merges, column = loaded(shared.value), batch.column(at)
            texts = ["".join(_text(row.values.drop_null().to_numpy(), merges)) if row.is_valid else None for row in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields]).add(out_col, "string"))


def lookahead(vocabulary: bytes) -> int:
    return Merges(vocabulary).lookahead
