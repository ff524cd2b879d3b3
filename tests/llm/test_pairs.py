"""The Jaccard join and decontamination against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from stepwell.llm import decontamination, jaccard_join
from stepwell.llm.components import components

CLASH = "doc_id long, text string, sid int, key string, size int, id int, s1 int, root int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, 4, 5, "v") for i, t in rows], CLASH)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1 if w else 0)))


def brute(rows, threshold=0.8):
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    own = [s for s in sets if s]
    links, root = defaultdict(int), {s: s for s in own}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for x, a in enumerate(own):
        for b in own[x + 1 :]:
            n = len(a & b)
            if n >= threshold * (len(a) + len(b) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    names = defaultdict(list)
    for s in own:
        names[find(s)] += sets[s]
    out = []
    for i, t in rows:
        s = shingles(t)
        out.append((i, least(names[find(s)]), least(sets[s]), len(sets[s]), links[s]) if s else (i, i, i, 1, 0))
    return sorted(out, key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    make = lambda k: [f"w{r.randint(0, 3000)}" for _ in range(k)]
    rows, texts = [], []
    passage = make(40)
    for _ in range(n):
        if texts and r.random() < 0.5:
            t = list(r.choice(texts))
            for _ in range(r.randint(0, 6)):
                if t:
                    t[r.randrange(len(t))] = f"w{r.randint(0, 3000)}"
        else:
            t = make(r.choice([1, 3, 5, 20, 60, 200, 400])) + (passage if r.random() < 0.3 else [])
        texts.append(t)
    hot = make(300)
    for _ in range(70):
        t = list(hot)
        t[r.randrange(300)] = f"w{r.randint(0, 3000)}"
        texts.append(t)
    rows = [(i, " ".join(t).upper() if i % 9 == 0 else " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(900, None), (901, ""), (902, ""), (None, rows[5][1]), (3, rows[3][1]), (3, rows[3][1]), (None, "quite alone here"), (950, "v " * 30000)]


@pytest.mark.parametrize("leaf", [512, 16])
def test_links(spark, leaf):
    rows = corpus(leaf)
    got = jaccard_join.links(frame(spark, rows).repartition(5), leaf=leaf)
    assert got.columns == ["id", "class_id", "rep_id", "n_copies", "n_links"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_keep_one(spark):
    rows = corpus(3, 60)
    left = jaccard_join.keep_one(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in CLASH.split(", ")]
    got = sorted((r.doc_id for r in left.collect()), key=str)
    want = {x[1] for x in brute(rows) if x[0] is not None or x[1] is not None} | {None}
    assert sorted(set(got), key=str) == sorted(want, key=str) and len(got) == len(set(got))


def test_links_empty(spark):
    assert jaccard_join.links(frame(spark, [])).count() == 0
    assert jaccard_join.links(frame(spark, [(1, None), (2, "")])).count() == 2


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: y for x, y in root.items() if x != y}


def test_shared_sizes():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, n)).astype(np.uint64) for n in (0, 5, 30, 60)]
    want = [[len(set(a.tolist()) & set(b.tolist())) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = jaccard_join.shared_sizes(sets)
    assert all(want[i][j] is None or got[i, j] == want[i][j] for i in range(4) for j in range(4))


def test_runs_reach_recall():
    """All runs see one vector: the miss is that of pairs whose numbers of equal coordinates vary."""
    runs = jaccard_join.runs_needed(0.8, 0.999, 3)
    equal = np.random.default_rng(1).binomial(jaccard_join.COORDINATES, 0.8, 1_000_000) / jaccard_join.COORDINATES
    missed = lambda n: ((1 - equal**4) ** n).mean()
    assert missed(runs) <= 0.00102 and missed(runs - 1) > 0.00098


def test_rows_without_identifiers_do_not_meet(spark):
    """Near copies without an identifier, and ones that share one, send each text once."""
    base = [f"w{i}" for i in range(60)]
    rows = [(None if i % 2 else 7, " ".join([*base[:50], f"x{i}", *base[50:]])) for i in range(80)]
    rows += [(None, rows[1][1])] * 20
    sent, real = [], jaccard_join.S.save
    try:
        jaccard_join.S.save = lambda df, label: sent.append((label, out := real(df, label))) or out
        got = jaccard_join.links(frame(spark, rows)).collect()
    finally:
        jaccard_join.S.save = real
    assert sorted(map(tuple, got), key=str) == brute(rows)
    members = next(df for label, df in sent if label == "members")
    assert members.count() == members.select("sid").distinct().count() == 80


def test_near_copies_are_not_split_in_vain(spark):
    """A large group of near copies ends at the first level of each run, whatever links to a few of its members only."""
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 9000)}"
    base, band = [word() for _ in range(200)], [word() for _ in range(400)]
    made, rows = [], []
    for size in (60, 120):
        copies = [[*base[:at], word(), *base[at + 1 :]] for at in range(size)]
        far = [[*base[: 150 - 4 * i], *[word() for _ in range(60 + 4 * i)]] for i in range(6)]  # less and less like the others
        near = [[*t[:20], word(), *t[21:]] for t in far]
        slid = [band[2 * i : 2 * i + 100] for i in range(80)]  # linked to a few neighbours each
        rows = [(i, " ".join(t)) for i, t in enumerate([*copies, *far, *near, *slid])]
        sent, real = [], jaccard_join.S.save
        try:
            jaccard_join.S.save = lambda df, label: sent.append((label, out := real(df, label))) or out
            got = jaccard_join.links(frame(spark, rows), leaf=40).collect()
        finally:
            jaccard_join.S.save = real
        assert sorted(map(tuple, got), key=str) == brute(rows)
        made.append(sum(df.count() for label, df in sent if label == "paths"))
    runs = jaccard_join.runs_needed()
    assert made[0] <= 1.2 * runs * (60 + 12 + 80) and made[1] <= 1.2 * runs * (120 + 12 + 80)


# ---------------------------------------------------------------- decontamination


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_overlap(doc, item, miss=decontamination.MISS):
    """Matches of the best run over all alignments."""
    best = 0
    for begin in range(-len(item) + 1, len(doc)):
        run = score = matches = 0
        top = (0.0, 0)
        for j, w in enumerate(item):
            if not 0 <= begin + j < len(doc):
                continue
            same = doc[begin + j] == w
            score, matches = score + (1 if same else -miss), matches + same
            if score <= 0:
                score, matches = 0.0, 0
            top = max(top, (score, matches))
            run += same
        best = max(best, top[1])
    return best


def test_contamination(spark):
    r = random.Random(8)
    make = lambda k: [f"t{r.randint(0, 400)}" for _ in range(k)]
    items = [make(r.choice([8, 12, 20, 50])) for _ in range(12)]
    docs = []
    for i in range(40):
        d = make(r.randint(0, 80))
        if i % 2:
            own = list(r.choice(items))
            for _ in range(r.randint(0, len(own) // 8)):
                own[r.randrange(len(own))] = "changed"
            own = [w.upper() + r.choice(["", "!", ","]) for w in own]
            at = r.randint(0, len(d))
            d[at:at] = own
        docs.append(" ".join(d))
    rows = [(i, t) for i, t in enumerate(docs)] + [(200, None), (201, ""), (None, docs[1]), (1, docs[1]), (300, "x " * 30000)]
    bench = spark.createDataFrame([(i, " ".join(t), "z") for i, t in enumerate(items)] + [(90, None, "z"), (91, "too short", "z"), (92, " ".join(items[0]), "z")], "item_id long, text string, id string")
    wanted = {}
    for i, t in rows[:44]:
        hit = {j for j, item in enumerate([*items, items[0]]) if brute_overlap(tokens(t), item) >= decontamination.needed(len(item))}
        wanted[i, t] = tuple(sorted(92 if j == 12 else j for j in hit))
    for size in (decontamination.BLOCK_TOKENS, 40):
        found = decontamination.contamination(frame(spark, rows), bench, block_tokens=size).collect()
        got = {(x.id, tuple(x.items)) for x in found}
        for i, t in rows[:44]:
            want = wanted[i, t]
            assert (i, want) in got, (i, want, [x for x in found if x.id == i])
        assert len(found) == len(rows) and all(x.contaminated == bool(x.items) for x in found)
        left = decontamination.clean(frame(spark, rows), bench, block_tokens=size)
        assert sorted((x.doc_id for x in left.collect()), key=str) == sorted((x.id for x in found if not x.contaminated), key=str)


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(frame(spark, []), none).count() == 0
    assert [x.contaminated for x in decontamination.contamination(frame(spark, [(1, "a b c")]), none).collect()] == [False]


def seeded(doc, item, begin):
    """Whether a mask fits the alignment."""
    same = [0 <= begin + j < len(doc) and doc[begin + j] == w for j, w in enumerate(item)]
    masks = decontamination.MASKS + (decontamination.SHORT_MASKS if len(item) < decontamination.MIN_MATCH else ())
    return any(all(same[j + x] for x, c in enumerate(m) if c == "1") and 0 <= begin + j and begin + j + len(m) <= len(doc) for m in masks for j in range(len(item) - len(m) + 1))


def best_run(doc, item, begin):
    best = total = matches = low = 0.0
    for j, w in enumerate(item):
        if 0 <= begin + j < len(doc):
            total, matches = total + (1 if doc[begin + j] == w else -decontamination.MISS), matches + (doc[begin + j] == w)
            if total < 0:  # of runs with one score the longest counts
                total = matches = 0.0
            if total > low:
                best, low = matches, total
    return best


def test_repetitive_texts(monkeypatch):
    """Few different words: runs of equal seeds, periods, and slices of a few pairs."""
    monkeypatch.setattr(decontamination, "SLICE", 50)
    r = random.Random(6)
    word = lambda n, k: [f"w{r.randrange(k)}" for _ in range(n)]
    items = [word(n, k) for n in (5, 8, 12, 13, 30, 60) for k in (1, 2, 3, 9)] + [["a"] * 40, ["a", "b"] * 20]
    docs = [word(r.randrange(0, 200), k) for k in (1, 2, 3, 9) for _ in range(4)] + [["a"] * 300, ["b", "a"] * 100, []]
    bench = decontamination.Benchmark([(i, " ".join(t)) for i, t in enumerate(items)])
    data = [" ".join(d).encode() for d in docs]
    got = decontamination.judge(bench, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for x, doc in enumerate(docs):
        want = {}
        for i, item in enumerate(items):
            n = max([best_run(doc, item, b) for b in range(-len(item) + 1, len(doc)) if seeded(doc, item, b)], default=0)
            if n >= decontamination.needed(len(item)):
                want[i] = n
        assert got.get(x, {}) == want


def test_equal_words_take_no_product():
    import tracemalloc

    bench = decontamination.Benchmark([(1, "spam " * 2000)])
    body = np.frombuffer(("spam " * 20_000).encode(), np.uint8)
    tracemalloc.start()
    assert decontamination.judge(bench, body, np.array([0, len(body)])) == {0: {0: 2000}}
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_one_block_at_a_time(spark):
    """However many blocks there are, a plan holds one search, and the result is that of one block."""
    bench = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(30)], "item_id long, text string")
    rows = frame(spark, [(i, f"so it began {' '.join(f'q{i}x{j}' for j in range(20))} and ended") for i in range(0, 60, 3)])
    one, many = decontamination.contamination(rows, bench), decontamination.contamination(rows, bench, block_tokens=600)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert "MapInArrow" not in many._jdf.queryExecution().executedPlan().toString()
    left = decontamination.clean(rows, bench, block_tokens=600)
    assert left.columns == rows.columns and sorted(x[0] for x in left.collect()) == [i for i in range(0, 60, 3) if i >= 30]
