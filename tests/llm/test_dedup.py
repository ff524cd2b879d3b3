"""Exact and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from stepwell.llm import exact_dedup, substring_dedup

CLASH = "doc_id long, text string, row int, id int, key string, text_ string, size int, later_ int"


def frame(spark, rows):
    """Documents beside columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "k", "x", 3, 4) for i, t in rows], CLASH)


def lower(text):
    return (text or "").encode().lower()


def brute_exact(rows, largest=True):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        own = [x for x in groups[lower(t)] if x is not None]
        keep = (max(own) if largest else min(own)) if own else None
        out.append((i, keep, len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()))
    return Counter(out)


ROWS = [
    (1, "Same text"), (5, "same TEXT"), (3, "same text"), (4, None), (9, ""), (None, "alone"), (None, "Alone"), (7, "É"), (8, "é"),
    (11, "twice"), (11, "twice"), (12, "long " * 30000), (13, "long " * 30000 + "x"), (14, "LONG " * 30000), (15, "same textual"), (16, "sam"),
]


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 600])
def test_exact(spark, budget):
    rows = ROWS + [(100 + i, f"prefix {i % 37} and more") for i in range(300)]
    got = exact_dedup.annotate(frame(spark, rows).repartition(5), keep="largest", budget=budget).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({lower(t) for _, t in rows})
    assert all(r.id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 600])
def test_exact_smallest_and_keep_one(spark, budget):
    got = exact_dedup.annotate(frame(spark, ROWS), keep="smallest", budget=budget).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(ROWS, False)
    left = exact_dedup.keep_one(frame(spark, ROWS).repartition(3), keep="largest", budget=budget)
    assert left.columns == [c.split()[0] for c in CLASH.split(", ")]
    want = {k: max((x for x in v if x is not None), default=None) for k, v in _groups(ROWS).items()}
    assert {lower(r.text): r.doc_id for r in left.collect()} == want and left.count() == len(want)


def _groups(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[lower(t)].append(i)
    return out


def test_exact_empty(spark):
    assert exact_dedup.annotate(frame(spark, [])).count() == 0
    assert exact_dedup.keep_one(frame(spark, [])).count() == 0


def test_trie_spills_subtrees():
    spilled = []
    trie = exact_dedup.PatriciaTrie(800, lambda text, t: spilled.append(text))
    texts = [f"{'ab'[i % 2]}{'x' * (i % 50)}{i}".encode() for i in range(200)]
    for i, t in enumerate(texts * 2):
        trie.insert(t, (1, i), i, 1, i)
    held = [t for t, _ in trie.walk()]
    assert trie.spills and set(held) | set(spilled) == set(texts) and not set(held) & set(spilled)


def brute_substring(rows, k):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(d[i : i + k]) for d in docs for i in range(len(d) - k + 1))
    out = []
    for (i, _), d in zip(rows, docs):
        gone = set()
        for j in range(len(d) - k + 1):
            if seen[tuple(d[j : j + k])] > 1:
                gone.update(range(j, j + k))
        kept = " ".join(w for j, w in enumerate(d) if j not in gone)
        out.append((i, len(d), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def texts(n, seed):
    r = random.Random(seed)
    words = ["a", "b", "é", "word", "x\u00a0y", "z."]
    shared = " ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(60))
    rows = []
    for i in range(n):
        t = " ".join(r.choice(words) + str(r.randint(0, 50)) for _ in range(r.randint(0, 120)))
        if i % 3 == 0:
            a = r.randint(0, 20)
            t = t + "\n" + " ".join(shared.split()[a : a + r.randint(5, 50)]) + "\t " + t[: r.randint(0, 40)]
        if i % 7 == 0:
            t += " of of" * r.randint(1, 40)
        rows.append((i, t))
    return rows + [(500, None), (501, ""), (502, "  \n "), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1] + " "), (600, "q " * 20000)]


@pytest.mark.parametrize(("k", "m"), [(35, 8), (6, 3), (2, 2)])
def test_substring(spark, k, m):
    rows = texts(120, k)
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(4), window=k, gram=m).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(rows, k)


def test_substring_empty(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_substring_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(rows, 35)
