"""The language model, toxicity, personal data."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from stepwell.llm import language_model as L
from stepwell.llm import pii, queries, toxicity


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_base(rows):
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for k, (_, t) in enumerate(rows)}
    out_of = {k: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, ws in words.items() if not out_of[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out_of[k], len(words[k]), sum(c[w] > 0 for w in words[k]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[k])) for k, (i, _) in enumerate(rows)]


def test_base_scores(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (None, "The the THE"), (9003, "zzz " * 21000), (9003, "zzz " * 21000)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, block int, part string, n int")
    got = sorted(map(tuple, L.score(df.repartition(3)).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(brute_base(rows), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want))
    # the states must tell something that single words do not, in texts not learned from
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) > sum(g[5] for g in held)


def test_base_scores_empty(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def model(k, s, seed):
    r = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return L.Model(norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((s, k)), 0))


def brute_forward(x, m):
    a, log = m.start * m.emit[x[0]], 0.0
    for t in x[1:]:
        log += math.log(a.sum())
        a = (a / a.sum() @ m.move) * m.emit[t]
    return log + math.log(a.sum())


def test_likelihood_and_expected_counts():
    m, r = model(3, 7, 1), np.random.default_rng(2)
    lengths = np.array([1, 2, 63, 64, 65, 129, 200, 5])
    x = r.integers(0, 7, lengths.sum())
    edges = np.concatenate([[0], np.cumsum(lengths)])
    got = L.log_likelihood(x, lengths, m)
    assert np.allclose(got, [brute_forward(x[a:b], m) for a, b in zip(edges[:-1], edges[1:])])
    starts, moves, emits, total = L.expected(x, lengths, m)
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))]
    for a, b in zip(edges[:-1], edges[1:]):
        seq, n = x[a:b], b - a
        f, g = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            f[t] = (m.start if t == 0 else f[t - 1] @ m.move) * m.emit[seq[t]]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            g[t] = m.move @ (m.emit[seq[t + 1]] * g[t + 1])
            g[t] /= g[t].sum()
        post = f * g / (f * g).sum(axis=1, keepdims=True)
        want[0] += post[0]
        for t in range(n):
            want[2][seq[t]] += post[t]
            if t:
                pair = f[t - 1][:, None] * m.move * (m.emit[seq[t]] * g[t])[None, :]
                want[1] += pair / pair.sum()
    assert all(np.allclose(a, b) for a, b in zip((starts, moves, emits), want)) and math.isclose(total, got.sum())


def brute_counts(x, m):
    """Shares of states of each token, and moves, by plain recursions."""
    n, k = len(x), len(m.start)
    f, g = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        f[t] = (m.start if t == 0 else f[t - 1] @ m.move) * m.emit[x[t]]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        g[t] = m.move @ (m.emit[x[t + 1]] * g[t + 1])
        g[t] /= g[t].sum()
    post, moves = f * g / (f * g).sum(axis=1, keepdims=True), np.zeros((k, k))
    for t in range(1, n):
        pair = f[t - 1][:, None] * m.move * (m.emit[x[t]] * g[t])[None, :]
        moves += pair / pair.sum()
    return post, moves


def brute_scores(rows, states, tolerance, frequent):
    """The whole model word by word: tied rounds, the untied last one, and each text's likelihood."""
    texts = [[x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", lower(t))] + [b""] for _, t in rows]
    train = [t for (i, _), t in zip(rows, texts) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n = sum(c.values())
    own = sorted(w for w in c if w and c[w] * frequent >= n)
    word_class = lambda w: int(L.Vocabulary(np.frombuffer(w, np.uint8), np.array([len(w)])).classes()[0])
    symbol = {w: L.END + 1 + own.index(w) if w in own else word_class(w) for w in c}
    types = np.bincount(list(symbol.values()), minlength=L.END + 1 + len(own))
    base = types + np.bincount([symbol[w] for t in train for w in t], minlength=len(types)) + 1.0
    base /= base.sum()
    m, history = L.first_model(base, states), []
    while True:
        starts, moves, sums, words, total = np.zeros(states), np.zeros((states, states)), np.zeros((len(types), states)), {w: np.zeros(states) for w in c}, 0.0
        for t in train:
            x = [symbol[w] for w in t]
            post, moved = brute_counts(x, m)
            starts += post[0]
            moves += moved
            total += brute_forward(x, m)
            for w, s, p in zip(t, x, post):
                sums[s] += p
                words[w] += p
        history.append(total)
        after = L.estimate(starts, moves, sums, base)
        if len(history) > 1 and history[-1] - history[-2] <= tolerance * abs(history[-2]):
            break
        m = after
    shares = m.emit * sums.sum(axis=0)
    shares /= shares.sum(axis=1, keepdims=True)
    table = {w: words[w] + shares[symbol[w]] for w in c}
    table[None] = sum(shares[symbol[w]] for w in c) / len(c)  # all that is unseen
    z = sum(table.values())
    emit = {w: e / z for w, e in table.items()}
    assert np.allclose(sum(emit.values()), 1)
    keys = list(emit)
    final = L.Model(after.start, after.move, np.array([emit[w] for w in keys]))
    place = {w: i for i, w in enumerate(keys)}
    return [brute_forward([place.get(w, place[None]) for w in t], final) / math.log(10) for t in texts], len(own), history


def test_scores_equal_a_plain_model(spark):
    """Words in classes and words of their own, unseen ones, repeated and empty texts; many blocks and parts."""
    r = np.random.default_rng(11)
    topics = [[f"t{k}{x}" for x in range(30)] for k in range(3)]
    rows = []
    for i in range(150):
        topic = topics[i % 3]
        rows.append((i, " ".join([topic[x] if r.random() < 0.8 else f"Rare{x}{r.integers(0, 40)}" for x in r.integers(0, 30, r.integers(1, 30))])))
    rows += [(200, None), (200, ""), (None, "t01 t02 t03"), (201, "t01 t02 new words here"), (201, "t01 t02 new words here"), (202, " ".join(topics[1] * 50))]
    want, own, history = brute_scores(rows, 3, 2e-3, 60)
    assert own > 10 and len(history) >= 3
    df = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n int, doc_id long, text string")
    got = L.score(df.repartition(5), states=3, frequent=60).collect()
    key = lambda i, n, s: (i is None, i or 0, n, round(s, 3))
    got = sorted((key(x.id, x.n_tokens, x.score), x.score) for x in got)
    want = sorted((key(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1, s), s) for (i, t), s in zip(rows, want))
    assert [a[0][:3] for a in got] == [a[0][:3] for a in want]
    assert np.allclose([a[1] for a in got], [a[1] for a in want], rtol=1e-4)


def test_counts_do_not_grow_with_partitions(spark, sf_dir):
    """What parts tell: each frequent word once, and a fixed number of rows a task."""
    blocks = L.S.save(L.S.two(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").repartition(6).mapInArrow(L._blocks(1 << 20), L._BLOCK_SQL), "words")
    n = blocks.agg({"n_train": "sum"}).first()[0]
    found = []
    for tasks in (4, 32):
        rows = L._by_part(blocks.select("block", "word_lens", "words", "counts").mapInArrow(L._vocabularies(4 * tasks), L._VOCABULARY_SQL), tasks).mapInArrow(L._count(n, 1000), L._COUNTED_SQL).cache()
        found.append(sorted((x.word, x.n) for x in rows.filter("word is not null").collect()))
        assert rows.filter("word is null").count() <= 64 * tasks
    assert found[0] == found[1] and all(c * 1000 >= n for _, c in found[0])


def test_rounds_raise_the_likelihood():
    r = np.random.default_rng(5)
    lengths = np.full(40, 90)
    x = np.concatenate([r.integers(0, 5, 90) + 5 * (i % 2) for i in range(40)])
    base = np.full(10, 0.1)
    m, history = L.first_model(base, 3), []
    for _ in range(5):
        *sums, total = L.expected(x, lengths, m)
        history.append(total)
        m = L.estimate(*sums, base, weight=0.01)
    assert all(b > a - 1e-6 for a, b in zip(history, history[1:])) and history[-1] > history[0] + 500


def test_probabilities_add_up(spark):
    """Over one-word texts: known words, and all that is unseen, with the end token behind."""
    base = np.array([0.5, 0.2, 0.3])
    m = L.first_model(base, 2)
    assert math.isclose(sum(math.exp(L.log_likelihood(np.array([i, j]), np.array([2]), m)[0]) for i in range(3) for j in range(3)), 1.0)


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark):
    r = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        w = [f"w{r.integers(0, 300)}" for _ in range(r.integers(5, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                w.insert(r.integers(0, len(w)), ["idiotic", "Scumbag", "trashlike"][r.integers(0, 3)])
        rows.append((i, " ".join(w)))
        if i % 3 != 1:
            labels.append((i, int(r.random() < 0.5), int(bad)))
    labels += [(5000, 1, 1), (None, 0, 0), (2, None, None), (0, 1, 1)]
    docs = spark.createDataFrame([(i, t, 0.5, 7) for i, t in rows + [(900, None), (901, ""), (None, "some idiotic scumbag"), (902, "w1 " * 30000)]], "doc_id long, text string, p_toxic double, y0 int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, table, ("quality", "toxic"))
    got = toxicity.score(docs, chain).collect()
    assert len(got) == 904
    truth = {i: i % 6 == 0 for i in range(900)}
    unlabelled = [x for x in got if x.id is not None and x.id < 900 and x.id % 3 == 1]
    assert sum(x.toxic == truth[x.id] for x in unlabelled) >= 0.98 * len(unlabelled)
    assert next(x for x in got if x.id is None).toxic and not any(x.toxic for x in got if x.id in (900, 901))
    left = toxicity.accept(docs, chain)
    assert left.columns == docs.columns and left.count() == sum(not x.toxic for x in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), ("quality", "toxic"))
    assert [(x.p_toxic, x.toxic) for x in toxicity.score(docs, chain).collect()] == [(0.0, False)]


def test_toxicity_held_out(spark):
    """Train on two thirds of the labels, judge the rest; the table is the one with enough labels to learn from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs, labels.filter("doc_id % 3 != 0"), ("quality", "toxic"))
    got = {x.id: x.toxic for x in toxicity.score(docs, chain).collect()}
    rest = [(got[x.doc_id], bool(x.toxic)) for x in labels.filter("doc_id % 3 = 0").collect()]
    assert sum(a == b for a, b in rest) >= 0.97 * len(rest)
    assert sum(a and not b for a, b in rest) <= 0.005 * len(rest)


def test_toxicity_many_telling_words(spark):
    """500 words tell, each in few documents: none may be left out because others rank before it."""
    r = np.random.default_rng(8)
    telling = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    filler = lambda: [f"w{x}" for x in r.integers(0, 40, 6)]
    rows = [(i, " ".join([*filler(), *([telling[i // 3 % 500], telling[(i // 3 * 7 + i // 1500) % 500]] if i % 3 == 0 else [])])) for i in range(6000)]
    docs = spark.createDataFrame(rows + [(10_000 + i, " ".join([*filler(), w, telling[i - 1]])) for i, w in enumerate(telling)], "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(6000)], "doc_id long, quality int, toxic int"), ("quality", "toxic"))
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in telling])])
    places, _ = toxicity._hashes(np.frombuffer("".join(telling).encode(), np.uint8), offsets)
    assert np.isin(places, chain.places).mean() >= 0.95
    got = [x.toxic for x in toxicity.score(docs.filter("doc_id >= 10000"), chain).collect()]
    assert sum(got) >= 0.97 * len(got)


def test_toxicity_places_stay_off_the_driver(spark):
    """The driver's memory must not grow with the words of the documents that teach, only with their number."""
    r = np.random.default_rng(14)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 6000, 1200))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(i, i % 2, int(r.random() < 0.5)) for i in range(1500)], "doc_id long, quality int, toxic int")
    toxicity.train(docs.limit(20), table, ("quality", "toxic"))  # what is imported once
    tracemalloc.start()
    chain = toxicity.train(docs, table, ("quality", "toxic"), keep_features=20000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chain.places) > 5000 and chain.constants == [None, None]
    assert most < 4 << 20  # of places, 1500 documents have about 1.6 million


def test_toxicity_same_fit_for_rows_that_share_an_identifier(spark):
    """Rows of one identifier with different texts: probabilities go to the row they were made for, however rows are dealt."""
    r = np.random.default_rng(15)
    rows = [(i // 3, " ".join(f"w{x}" for x in r.integers(0, 40, 8))) for i in range(600)]
    table = spark.createDataFrame([(i, i % 2, int(r.random() < 0.5)) for i in range(200)], "doc_id long, quality int, toxic int")
    chains = [toxicity.train(spark.createDataFrame(own, "doc_id long, text string").repartition(n), table, ("quality", "toxic")) for own, n in ((rows, 1), (rows[::-1], 7))]
    assert all(np.array_equal(a, b) for a, b in zip(chains[0].weights, chains[1].weights, strict=True))
    assert chains[0].thresholds == chains[1].thresholds


def test_toxicity_fit_converges():
    r = np.random.default_rng(5)
    rows = [np.unique(np.concatenate([[0, 1], r.integers(2, 60, r.integers(1, 9))])) for _ in range(400)]  # two are in all: badly conditioned
    y, extra = r.integers(0, 2, 400), r.random((400, 1))
    w = toxicity.fit(rows, extra, y, 60, ridge=0.01)
    x = np.zeros((400, 62))
    for i, at in enumerate(rows):
        x[i, at] = 1
    x[:, 60], x[:, 61] = extra[:, 0], 1
    grad = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 0.01 * np.where(np.arange(62) < 61, w, 0)
    assert np.abs(grad).max() < 1e-3


def plain_logistic(x, y):
    """Newton's method on a dense matrix; the last column is the constant, which bears no ridge."""
    w, penalty = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-9)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def test_toxicity_equals_a_plain_chain(spark):
    """The whole chain, out-of-fold inputs and threshold included, against dense fits on words by name."""
    r = np.random.default_rng(12)
    vocabulary = [f"{a}{b}" for a in ("tra", "wonder", "stone", "qu") for b in ("", "sh", "shy", "fully", "x1", "É")]
    words = [[vocabulary[j] for j in r.integers(0, len(vocabulary), r.integers(1, 9))] for _ in range(500)]
    labels = []
    for i, own in enumerate(words[:400]):
        quality = int(("wonder" in own) != (r.random() < 0.1))
        labels.append((i, None if i % 9 == 0 else quality, None if i % 7 == 0 else int(("trash" in own or not quality) != (r.random() < 0.1))))
    docs = spark.createDataFrame([(i, ", ".join(w.upper() if i % 2 and w.isascii() else w for w in own)) for i, own in enumerate(words)], "doc_id long, text string")
    got = {x.id: x for x in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ("quality", "toxic"))).collect()}
    features = [{w.encode() for w in own} | {(w.encode()[:n], n) for w in own for n in (5, 6, 7, 8) if len(w.encode()) >= n} for own in words]
    known = sorted(set().union(*features[:400]), key=str)
    x = np.array([[float(f in own) for f in known] + [1.0] for own in features])
    fold = (toxicity.K.mix(np.arange(400).view(np.uint64)) % np.uint64(toxicity.FOLDS)).astype(int)
    train, final = x[:400], x
    for c, name in enumerate(("quality", "toxic")):
        y = np.array([-1 if row[1 + c] is None else row[1 + c] for row in labels])
        out = np.zeros(400)
        for f in range(toxicity.FOLDS):
            inside = (y >= 0) & (fold != f)
            out[fold == f] = 1 / (1 + np.exp(-train[fold == f] @ plain_logistic(train[inside], y[inside])))
        p = 1 / (1 + np.exp(-final @ plain_logistic(train[y >= 0], y[y >= 0])))
        assert np.abs([got[i][f"p_{name}"] - p[i] for i in range(500)]).max() < 1e-4
        tried = np.linspace(0.35, 0.65, 25)
        f1 = np.array([2 * ((out >= t) & (y == 1)).sum() / ((out[y >= 0] >= t).sum() + (y == 1).sum()) for t in tried])
        limit = np.median(tried[f1 >= f1.max() - 1e-12])
        train, final = np.insert(train, -1, out, axis=1), np.insert(final, -1, p, axis=1)
    assert all(got[i].toxic == (p[i] >= limit) for i in range(500) if abs(p[i] - limit) > 1e-4)


# ---------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_equal_the_patterns():
    r = np.random.default_rng(6)
    parts = ["a@b.c", "x.y+z@", "@", ".", "1", "12", "255", "256", "1.2.3.4", "007.1.1.1", "+1 (212) 555-0101", "+", " ", "-", "4111 1111 1111 1111", "4111111111111111", "é", "日", "(", ")", "\n", "a-b", "..", "999.1.2.3.4.5"]
    for _ in range(4000):
        text = "".join(parts[i] for i in r.integers(0, len(parts), r.integers(0, 14)))
        assert pii.base_spans(text) == brute_pii(text), text
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "@" * 100_000):
        pii.base_spans(text)


def test_field_adds_and_keeps(spark):
    rows = [(1, "call (212) 555-0142 now"), (2, "mail joe.12@mail3.example.com or +1 (212) 555-0101"), (3, None), (4, ""), (5, "nothing to see in version 2.0 of 1984"), (None, 'token = "' + "ab12cd34" * 5 + '" is it'), (6, "é 10.0.0.1 日"), (6, "é 10.0.0.1 日"), (7, "word " * 30000)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, base string, spans int")
    got = {x.id: x for x in pii.find(df, pii.train(df)).collect()}
    for i, t in rows:
        base = [(s.start, s.end, s.kind) for s in got[i].base]
        assert base == brute_pii(t or "")
        assert set(base) <= {(s.start, s.end, s.kind) for s in got[i].spans}
    assert [s.kind for s in got[1].spans] == ["phone"] and [s.kind for s in got[None].spans] == ["secret"] and not got[5].spans
    assert pii.find(df.limit(0), pii.train(df.limit(0))).count() == 0


def plain_candidates(text):
    """All candidates by their definition, by places, without stretches."""
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    out = set()
    for i in range(len(tokens)):
        for j in range(i, min(i + pii.MAX_TOKENS, len(tokens))):
            s, e = tokens[i][0], tokens[j][1]
            span = text[s:e]
            blanks = sum(text[a].isspace() for a, _ in tokens[i : j + 1])
            ends = (span[0].isalnum() or span[0] in pii.OPEN + "@") and (span[-1].isalnum() or span[-1] in pii.CLOSE)
            if ends and re.search("[0-9@]", span) and not re.search(r"[\n\r]|\s\s", span) and blanks <= pii.MAX_BLANKS and (j == i or e - s <= pii.MAX_CHARS):
                out.add((s, e))
    return out


def test_stretches_lose_no_candidate():
    r = np.random.default_rng(9)
    parts = ["a", "word ", "x" * 37, "7", "@", " ", "  ", "\n", "\r\n", "-", ".", "é1", "ab12" * 200, "a.b " * 90, "(", "=", "日本5"]
    for _ in range(150):
        text = "".join(parts[i] for i in r.integers(0, len(parts), r.integers(0, 25)))
        found = [(s, e) for low, high in pii.stretches(text) for _, _, s, e in pii.Lattice(text, low, high).segments]
        assert len(found) == len(set(found)) and set(found) == plain_candidates(text), text
    for digit in (0, 18, 37):  # wherever the digit stands
        secret = "k" * digit + "1" + "k" * (37 - digit)
        text = f'token = "{secret}" end'
        assert (text.index(secret), text.index(secret) + 38) in plain_candidates(text)


def test_field_finds_other_forms(spark):
    """Recall by kind, on forms and contexts that the made sentences do not have, and few plain numbers taken."""
    field = pii._made_field()
    r = np.random.default_rng(4)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    any_of = lambda letters, n: "".join(letters[i] for i in r.integers(0, len(letters), n))
    hexadecimal, wide = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    forms = {
        "secret": [lambda: "ghp_" + any_of(wide, 35) + digits(1), lambda: any_of(hexadecimal, 96), lambda: any_of(wide, 100) + digits(1), lambda: "sk" + digits(1) + any_of(wide, 45), lambda: any_of(hexadecimal, 32)],
        "phone": [lambda: f"(3{digits(2)}) 555-{digits(4)}", lambda: f"7{digits(2)}-555-{digits(4)}"],
        "ip": [lambda: "[.]".join(str(x) for x in r.integers(0, 256, 4)), lambda: ":".join(any_of(hexadecimal, 4) for _ in range(8))],
        "email": [lambda: f"{any_of('abcdeg', 6)}{digits(2)} @ {any_of('ilmno', 5)}.com", lambda: f"{any_of('abcdeg', 6)}[@]{any_of('ilmno', 5)}.net"],
    }
    for kind, makes in forms.items():
        hit = 0
        for n in range(60):
            value = makes[n % len(makes)]()
            text = f"they wrote it down as {value} last week"
            hit += (22, 22 + len(value), kind) in [*pii.base_spans(text), *field.added(text, pii.base_spans(text))]
        assert hit >= 48, (kind, hit)
    plain = [f"there were {digits(n)} of them in {1900 + i} at {i}:30" for i in range(30) for n in (1, 3, 5)]
    assert sum(bool(field.added(t, [])) for t in plain) <= 4


def test_dense_digits_take_linear_memory():
    import tracemalloc

    field, peaks = pii.Field({"1": [-1.0] * 5}), []
    for n in (2000, 4000):
        tracemalloc.start()
        field.added("12.5," * n, [])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2.5 * peaks[0] and peaks[1] < 16 << 20


def test_best_chain_is_the_best_of_all():
    """The dynamic programme against all chains of segments."""
    field = pii.fit(pii.made_examples(60), rounds=3)
    for text in ("ab 12.3.4.5 @x", "+1 (212) 555", "1 2 3 4"):
        lattice = pii.Lattice(text, 0, len(text))
        worth = {(s, e): field.best(text, s, e) for _, _, s, e in lattice.segments}

        def best(at):
            if at >= len(lattice.tokens):
                return 0.0
            return max([best(at + 1), *(worth[s, e][1] + best(j) for i, j, s, e in lattice.segments if i == at)])  # noqa: B023

        assert math.isclose(sum(worth[a, b][1] for a, b, _ in lattice.best(field.best)), best(0), abs_tol=1e-9)


def test_marginals_add_up():
    score = np.random.default_rng(0).normal(size=(4, 2))
    segments = [(0, 1), (0, 2), (1, 3), (2, 3)]
    chains = [[], [0], [1], [2], [3], [0, 2], [0, 3], [1, 3]]
    total, by = 0.0, np.zeros((4, 2))
    for c in chains:
        for kinds in np.ndindex(*[2] * len(c)):
            p = math.exp(sum(score[x, k] for x, k in zip(c, kinds)))
            total += p
            for x, k in zip(c, kinds):
                by[x, k] += p
    assert np.allclose(pii._marginals(3, segments, score), by / total)


def test_op9_columns(spark, sf_dir):
    got = queries.op9_pii(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in got:
        base = brute_pii(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, k in base) for x in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == pii.digest(",".join(f"{k}:{a}:{b}" for a, b, k in base))
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r.spans.split(",")) | {""}


if __name__ == "__main__":
    pytest.main([__file__])
