"""Personal data by a semi-Markov conditional random field over fixed base spans.

Base spans are what four patterns find, each left to right without overlaps in its kind:
e-mail addresses, IPv4 addresses (parts up to 255), card numbers (14 to 19 digits that
pass Luhn) and phone numbers (10 to 15 digits); a match that fails its test is dropped and
not retried.  They always stay.  The field adds spans beside them: e-mail addresses, IP
addresses, cards and phones written in ways the patterns do not know, and secrets (keys,
tokens, passwords).

A candidate is a run of at most `MAX_TOKENS` tokens, `MAX_BLANKS` of them blanks, and
`MAX_CHARS` characters (a single token may have any number), without a line break or two
blanks together, that holds a digit or an @ and begins and ends with a letter, a digit or
one of the marks in `OPEN` and `CLOSE`.  Its score for a type is a sum of weights of
features of the whole span: its shape, numbers of digits, letters and separators, Luhn and
IP tests, what stands before and behind.  The chain of segments with the largest sum (a
token outside all spans counts 0) is found by dynamic programming over starts and lengths,
which chooses boundaries and types together; base spans are blocked off.  Only stretches
that a candidate can reach from a digit or @ are searched; they never cut a token, and
memory is a few numbers a token.

Weights maximise the conditional likelihood (segments' sums by forward and backward
recursions, gradient steps) of texts whose spans are known: sentences made by a fixed
generator, and all stretches of at most `max_train` documents of the table, those with the
least hash of their identifier, with their base spans.  Of these, stretches in which a
field fitted on the made sentences alone adds a span are left out, as what stands there
isn't known.

Nulls and edges: a null text is empty and has no spans.  Offsets are code points, ends
exclusive.  Equal starts are ordered by kind.  Repeated rows are judged each.  An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import kernels as K
from stepwell.llm import tables as S

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_TOKENS, MAX_CHARS, MAX_BLANKS, MAX_TRAIN = 32, 512, 6, 1000
OPEN, CLOSE = "+($", "=)"
Span = tuple[int, int, str]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can only begin where a run of digits does, so long runs are read once
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _HEX = re.compile(r"[0-9]"), re.compile(r"[0-9a-fA-F]+")
_CORE, _CORES = re.compile(r"[0-9@]"), re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """The spans that always stay, by start, then kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return _ordered(out)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# ---------------------------------------------------------------- the field

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W_]+|\s|.", re.S)
_LINE = re.compile(r"[^\n\r]+")


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text that a candidate can reach from a digit or @: within a line, and without cutting a token."""
    for line in _LINE.finditer(text):
        start, end = line.span()
        low = high = -1
        for m in _CORES.finditer(text, start, end):
            a, b = max(m.start() - MAX_CHARS, start), min(m.end() + MAX_CHARS, end)
            if a > high:
                if high >= 0:
                    yield low, high
                while a > start and text[a - 1].isalnum() and text[a].isalnum():
                    a -= 1
                low, high = max(a, high), -1
            if b > high:
                while b < end and text[b - 1].isalnum() and text[b].isalnum():
                    b += 1
                high = b
        if high >= 0:
            yield low, high


class _Kinds(dict):
    """Of a character's number what stands for it in shapes."""

    def __missing__(self, n: int) -> str:
        c = chr(n)
        self[n] = found = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c
        return found


_KIND, _RUN, _WORDS = _Kinds(), re.compile(r"([9Aa])\1+"), re.compile("[9Aa]+")


def _shape(span: str) -> str:
    return _RUN.sub(r"\1", span.translate(_KIND))[:24]


_QUAD = re.compile(r"\d{1,3}(\D{1,3})\d{1,3}\1\d{1,3}\1\d{1,3}")
_GROUPS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_MIXED = re.compile(r"[Aa]9|9[Aa]")
_BEHIND = re.compile(r"([^\W\d_]+)\W{0,4}$")


def before(text: str, a: int) -> list[str]:
    """Features of what stands before place a."""
    word = _BEHIND.search(text, max(a - 16, 0), a)
    return ["left=" + (_shape(text[a - 1]) if a else "^")] + (["word=" + word[1].lower()[:10]] if word else [])


def features(text: str, a: int, b: int, known: list[str] | None = None) -> list[str]:
    """Features of text[a:b] as one segment; `known` are those of what stands before it."""
    span = text[a:b]
    kinds = span.translate(_KIND)
    n, letters, blanks, size = kinds.count("9"), kinds.count("a") + kinds.count("A"), kinds.count(" "), b - a
    shape, which = _RUN.sub(r"\1", kinds), "".join(sorted(set(kinds)))[:6]
    out = ["1", "shape=" + (shape if len(shape) <= 16 else "other"), "words=" + _WORDS.sub("w", kinds)[:24], f"which={which},{size.bit_length()}", f"turns={which},{8 * len(shape) // size}", f"digits={min(n, 20)}", f"letters={min(letters, 8)}", f"long={size // 6 if size < 48 else 4 + size.bit_length()}", "first=" + kinds[:1], "last=" + kinds[-1:]]
    out += before(text, a) if known is None else known
    out.append("right=" + (text[b].translate(_KIND) if b < len(text) else "$"))
    if 13 <= n <= 19 and not letters:
        out.append("luhn" if luhn("".join([c for c in span if "0" <= c <= "9"])) else "not luhn")
    if "@" in span:
        out.append(f"at={span.count('@')},{'.' in span.rpartition('@')[2]}")
    if 4 <= n <= 12 and size <= 21 and _QUAD.fullmatch(span):
        out.append("quad" if all(_small(p) for p in re.findall(r"\d+", span)) else "not quad")
    if ":" in span and size <= 39 and _GROUPS.fullmatch(span):
        out.append(f"groups={span.count(':')},{'::' in span}")
    if letters and n:
        out.append(f"mixed={min(len(_MIXED.findall(kinds)) // 3, 8)}")
    if size >= 16 and not blanks:
        if _HEX.fullmatch(span):
            out.append("hex")
        if letters and n:
            out.append(f"dense={8 * n // size},{'A' in kinds},{'a' in kinds}")
    if blanks:
        out.append(f"blanks={blanks}")
    return out


class Lattice:
    """Tokens of a stretch; its candidate segments are (first token, end token, start, stop)."""

    def __init__(self, text: str, low: int, high: int, blocked: list[Span] = ()):
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
        blocked, x = sorted(blocked), 0
        n = len(self.tokens)
        self.shut, self.space, self.core = bytearray(n), bytearray(n), [n] * (n + 1)  # core: the next token with a digit or @
        reach = 0
        for i, (s, e) in enumerate(self.tokens):
            while x < len(blocked) and blocked[x][0] < e:
                reach = max(reach, blocked[x][1])
                x += 1
            self.shut[i] = s < reach
            self.space[i] = text[s].isspace()
        for i in range(n - 1, -1, -1):
            self.core[i] = i if _CORE.search(text, *self.tokens[i]) else self.core[i + 1]

    def candidates(self, i: int) -> Iterator[tuple[int, int, int, int]]:
        """Segments that begin with token i."""
        text, tokens, space = self.text, self.tokens, self.space
        s, first = tokens[i][0], self.core[i]
        if self.shut[i] or first >= i + MAX_TOKENS or not (text[s].isalnum() or text[s] in OPEN or text[s] == "@"):
            return
        blanks = 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            a, e = tokens[j]
            if self.shut[j] or (e - s > MAX_CHARS and j > i):
                return
            if space[j]:
                blanks += 1
                if blanks > MAX_BLANKS or space[j - 1] or text[a] in "\n\r":
                    return
            elif j >= first and (text[e - 1].isalnum() or text[e - 1] in CLOSE):
                yield i, j + 1, s, e

    @property
    def segments(self) -> list[tuple[int, int, int, int]]:
        return [x for i in range(len(self.tokens)) for x in self.candidates(i)]

    def best(self, score) -> list[Span]:
        """The chain of segments with the largest sum; `score` gives a segment's best type and its score."""
        n = len(self.tokens)
        total, back = [0.0] * (n + 1), [None] * (n + 1)
        for i in range(n):
            if i and total[i - 1] > total[i]:
                total[i], back[i] = total[i - 1], None
            known = None
            for _, j, s, e in self.candidates(i):
                known = known or before(self.text, s)
                kind, value = score(self.text, s, e, known)
                if value > 0 and total[i] + value > total[j]:
                    total[j], back[j] = total[i] + value, (i, s, e, kind)
        out, j = [], n
        if n and total[n - 1] > total[n]:
            back[n] = None
        while j:
            x = back[j]
            if x is None:
                j -= 1
            else:
                out.append(x[1:])
                j = x[0]
        return out[::-1]


class Field:
    """Weights of features by type."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}

    def best(self, text: str, a: int, b: int, known: list[str] | None = None) -> tuple[str, float]:
        get = self.weights.get
        rows = [w for w in map(get, features(text, a, b, known)) if w]
        own = list(map(sum, zip(*rows, strict=True))) or [0.0] * len(KINDS)
        value = max(own)
        return KINDS[own.index(value)], value

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans beside the base ones."""
        if not _CORE.search(text):
            return []
        out = []
        for low, high in stretches(text):
            near = [s for s in base if s[0] < high and s[1] > low]
            if near and not _left_over(text, low, high, near):
                continue
            out += Lattice(text, low, high, near).best(self.best)
        return out


def _left_over(text: str, low: int, high: int, near: list[Span]) -> bool:
    """Whether a digit or @ stands outside the base spans."""
    return any(not any(a <= m.start() < b for a, b, _ in near) for m in _CORE.finditer(text, low, high))


def fit(examples: list[tuple[str, list[Span]]], rounds: int = 12, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of the known segmentations, by AdaGrad on the exact gradient."""
    names: dict[str, int] = {}
    lattices = []
    for text, spans in examples:
        for low, high in stretches(text):
            own = [s for s in spans if s[0] >= low and s[1] <= high]
            lattice = Lattice(text, low, high)
            gold = {(a, b): KINDS.index(k) for a, b, k in own}
            at = [np.array([names.setdefault(f, len(names)) for f in features(text, s, e)]) for _, _, s, e in lattice.segments]
            truth = np.array([gold.get((s, e), -1) for _, _, s, e in lattice.segments])
            if len(at) and (truth >= 0).sum() == len(own):
                flat, owner = np.concatenate(at), np.repeat(np.arange(len(at)), [len(x) for x in at])
                lattices.append((len(lattice.tokens), [(i, j) for i, j, _, _ in lattice.segments], flat, owner, *np.unique(flat, return_inverse=True), truth))
    k = len(KINDS)
    w, seen = np.zeros((len(names), k)), np.full((len(names), k), 1e-6)
    if "1" in names:
        w[names["1"]] = -2.0
    for _ in range(rounds):
        for n, segments, at, owner, part, local, truth in lattices:
            own = w[at]
            score = np.stack([np.bincount(owner, weights=own[:, c], minlength=len(segments)) for c in range(k)], axis=1)
            error = _marginals(n, segments, score)
            known = np.flatnonzero(truth >= 0)
            error[known, truth[known]] -= 1
            wrong = error[owner]
            total = np.stack([np.bincount(local, weights=wrong[:, c], minlength=len(part)) for c in range(k)], axis=1) + ridge * w[part]
            seen[part] += total**2
            w[part] -= rate * total / np.sqrt(seen[part])
    return Field({f: w[i].round(6).tolist() for f, i in names.items() if np.abs(w[i]).max() > 1e-4})


def _marginals(n: int, segments: list[tuple[int, int]], score: np.ndarray) -> np.ndarray:
    """Probability of each segment and type, by forward and backward sums."""
    whole = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0], backward[n], whole = 0.0, 0.0, whole.tolist()
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for x, (i, j) in enumerate(segments):
        ending.setdefault(j, []).append(x)
        starting.setdefault(i, []).append(x)
    for j in range(1, n + 1):
        forward[j] = _sum([forward[j - 1], *(forward[segments[x][0]] + whole[x] for x in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        backward[i] = _sum([backward[i + 1], *(backward[segments[x][1]] + whole[x] for x in starting.get(i, ()))])
    outer = np.array([forward[i] + backward[j] - forward[n] for i, j in segments])
    return np.exp(np.minimum(score + outer[:, None], 0))


def _sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


# ---------------------------------------------------------------- what the field learns from

_FILL = "the of and note send to for was order total page item with from at ref code version year room line see".split()


def made_examples(n: int = 1000) -> list[tuple[str, list[Span]]]:
    """Sentences with spans in known places, by a fixed pseudo-random generator."""
    draw = iter(K.stream(2024, n * 512).tolist())
    pick = lambda of: of[next(draw) % len(of)]
    number = lambda size: "".join(str(next(draw) % 10) for _ in range(size))
    name = lambda: "".join(pick("abcdeghilmnoprstu") for _ in range(3 + next(draw) % 6))
    digest = lambda size: "".join(pick("0123456789abcdef") for _ in range(size))

    def coded(size: int) -> str:
        at = next(draw) % size  # one digit at least, anywhere
        return "".join(number(1) if i == at else pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for i in range(size))

    def card() -> str:
        body = "4" + number(14)
        return body + next(str(d) for d in range(10) if luhn(body + str(d)))

    area = lambda: str(2 + next(draw) % 8) + number(2)
    part = lambda: str(next(draw) % 256)
    positive = [
        ("email", lambda: f"{name()}.{number(2)}@{name()}{number(1)}.example.com"), ("email", lambda: f"{name()}{number(next(draw) % 4)} @ {name()}.com"), ("email", lambda: f"{name()}[@]{name()}.org"),
        ("ip", lambda: ".".join(part() for _ in range(4))), ("ip", lambda: "[.]".join(part() for _ in range(4))),
        ("card", card), ("card", lambda: "-".join(re.findall("....", card()))), ("card", lambda: ".".join(re.findall("....", card()))),
        ("phone", lambda: f"+1 ({area()}) 555-{number(4)}"), ("phone", lambda: f"({area()}) 555-{number(4)}"), ("phone", lambda: f"{area()}-555-{number(4)}"), ("phone", lambda: f"00{1 + next(draw) % 9}{number(1)} {area()} {number(3)} {number(4)}"),
        ("ip", lambda: ":".join(digest(4) for _ in range(8))), ("ip", lambda: f"{digest(4)}:{digest(3)}::{digest(2)}:{number(1)}"),
        ("secret", lambda: digest(20 + next(draw) % 110)), ("secret", lambda: coded(20 + next(draw) % 110)), ("secret", lambda: f"{name()}{pick('_-')}{coded(24 + next(draw) % 40)}"), ("secret", lambda: coded(43) + "="), ("secret", lambda: f"{coded(20)}.{coded(60)}.{coded(43)}"),
        ("secret", lambda: "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + number(1)), ("secret", lambda: digest(40)), ("secret", lambda: digest(18)),
    ]
    lead = {"secret": ["password=", 'token = "', "key: ", "secret=", "", "api_key="]}
    negative = [lambda: number(4), lambda: f"{number(1)}.{number(1)}", lambda: f"{number(1)}.{number(1)}.{number(2)}", lambda: f"${number(3)}.{number(2)}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: number(7), lambda: number(10), lambda: f"{number(2)}%", lambda: f"v{number(1)}.{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(3)},{number(3)}", lambda: "4" + number(2) + name(), lambda: f"@{name()}", lambda: f"{number(3)}.{number(3)}.{300 + next(draw) % 600}.{number(3)}"]
    out = []
    for i in range(n):
        text, spans = " ".join(pick(_FILL) for _ in range(3)) + " ", []
        for _ in range(2):
            if next(draw) % 2:
                kind, make = positive[next(draw) % len(positive)]
                text += pick(lead.get(kind, [""]))
                value = make()
                spans.append((len(text), len(text) + len(value), kind))
                text += value
                if text[spans[-1][0] - 1] == '"':
                    text += '"'
            else:
                text += pick(negative)()
            text += pick([" ", ". ", ", ", "\n"]) + " ".join(pick(_FILL) for _ in range(4)) + " "
        out.append((text, spans))
    return out


@functools.cache
def _made_field() -> Field:
    return fit(made_examples())


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Field:
    """Fit the field on the made sentences and on the stretches of at most `max_train` documents of the table."""
    S.tune(df.sparkSession)
    two = S.two(df, id_col, text_col)
    chosen = two.select("id").filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(max_train).distinct()
    parts = two.join(F.broadcast(chosen), "id").select("id", "text").mapInArrow(_stretches, "id long, part string").distinct().collect()  # of max_train documents
    made, first, found = made_examples(), _made_field(), []
    for part in sorted({r.part for r in parts}):
        base = base_spans(part)
        if not first.added(part, base):
            found.append((part, base))
    return fit(made + found)


def _stretches(batches):
    for batch in batches:
        ids, out = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for low, high in stretches(text or ""):
                ids.append(i)
                out.append(text[low:high])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "part"])


def find(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, base (array of kind, start, end), spans (all, base and added, likewise)."""
    spark = df.sparkSession
    S.tune(spark)
    shared = spark.sparkContext.broadcast(field.weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        own = Field(shared.value)
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                base.append(found)
                spans.append(_ordered(found + own.added(text or "", found)))
            listed = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in xs], kind) for xs in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *listed], names=["id", "base", "spans"])

    return S.two(df, id_col, text_col).mapInArrow(run, "id long, base array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
