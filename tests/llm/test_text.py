"""URL filters, chat formatting, BPE, and the pipeline."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwell.llm import bpe, chat, kernels, queries, url_filter

tokenizers = pytest.importorskip("tokenizers")

# ---------------------------------------------------------------- URLs


def brute_url(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    r = random.Random(1)
    rules = [*queries.URL_RULES, ("block", "a.example.net", "/en/x"), ("allow", "www.example.org", "/"), ("block", "example.net", "/en/deep/"), ("block", "xample.net", "/"), ("allow", "net", "/en/deep/er/")]
    hosts = ["net", "example.net", "a.example.net", "EXAMPLE.net", "xexample.net", "www.example.org", "org", "b.example.com", "example.com:80", "", "a..net", "net.", ".net", "u@example.net", "É.net", "example.net-x", "example-net"]
    paths = ["", "/", "/en/", "/en/x", "/en/deep/er/y", "/de/", "/fr/a", "?q=/en/", "#x", "/en", "/en/a?b#c", "/ü/\n/z"]
    urls = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(600)] + [None, "", "no scheme/en/", "http:/x", "a://b://example.net/en/", "http://example.net/" + "p" * 50000]
    df = spark.createDataFrame([(i, u, "h", "k", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, key string, slice int")
    got = {x.page_id: tuple(x)[1:] for x in url_filter.judge(df.union(df.limit(5)), url_filter.rule_table(spark, rules), slices=7).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    none = url_filter.judge(df, url_filter.rule_table(spark, []), default="block")
    assert {(x.rule, x.verdict) for x in none.collect()} == {(None, "block")}


def test_urls_stay_native(spark, sf_dir):
    plan = queries.op4_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- chat


def test_violations():
    schema = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"enum": [1, "x"]}}, "required": ["a"], "additionalProperties": False}
    assert chat.violations({"a": 1, "b": ["x"], "c": "x"}, schema) == []
    assert chat.violations({"a": 0, "b": [1], "c": 2, "d": 0}, schema) == ["$.a: below 1", "$.b[0]: not of type string", "$.c: not one of the values allowed", "$.d: not allowed"]
    assert chat.violations({}, schema) == ["$.a: missing"] and chat.violations({"a": True}, schema) == ["$.a: not of type integer"]


def test_chat(spark):
    call = lambda *c: json.dumps({"content": "", "tool_calls": [dict(zip(("id", "name", "arguments", "after"), x)) for x in c]})
    result = lambda i, x: json.dumps({"tool_call_id": i, "content": x})
    rows = [
        (1, 0, "user", "hi é"), (1, 1, "tool", result("b", "early")), (1, 2, "assistant", call(("a", "search", {"query": "x"}))),
        (1, 3, "tool", result("a", {"z": 1, "a": [2]})), (1, 4, "assistant", call(("b", "search", '{"limit": 0}', ["a"]))), (1, 5, None, None),
        (2, 0, "tool", result("none", "x")), (2, 1, "assistant", call(("q", "unknown", "not json"), ("q", "search", {"query": "y"}))), (2, 2, "user", "{broken"),
        (3, 0, "assistant", call(("m", "search", {"query": "1"}, ["n"]))), (3, 1, "assistant", call(("n", "search", {"query": "2"}, ["m"]))), (3, 2, "tool", result("m", "r")), (3, 3, "tool", result("n", "r")),
        (None, None, "user", "x " * 30000), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    df = spark.createDataFrame([(*x, 1, "j") for x in rows], "conv_id long, turn long, role string, text string, seq int, json string")
    got = chat.link(df.repartition(3), queries.TOOL_SCHEMAS).collect()
    assert len(got) == len(rows)
    for x in got:
        found = json.loads(x.json)
        assert x.json == chat.canonical(found) and " " not in re.sub(r'"(?:[^"\\]|\\.)*"', "", x.json)
    first = sorted((x for x in got if x.conv == 1), key=lambda x: (x.turn_at, x.step, x.turn))
    assert [x.turn for x in first] == [0, 2, 3, 4, 1, 5]  # the early result follows its call
    at = {(x.conv, x.turn): x for x in got}
    assert at[1, 1].link == at[1, 4].seq and at[1, 3].link == at[1, 2].seq and at[1, 4].errors == ["b: $.query: missing", "b: $.limit: below 1"]
    assert json.loads(at[1, 3].json)["content"] == '{"a":[2],"z":1}' and at[1, 5].role == "user"
    assert at[2, 0].orphan and at[2, 1].repeated and at[2, 1].unanswered and len(at[2, 1].errors) == 1
    assert any(x.cyclic for x in got if x.conv == 3) and not any(x.cyclic for x in got if x.conv in (1, 2, 4))
    assert sum(x.conv == 4 for x in got) == 2
    assert chat.link(df.limit(0)).count() == 0


def test_chat_long_chains(spark):
    """Chains beyond 32 links, of one cause and of two a message, arriving in reverse, and a cycle with what follows it."""
    call = lambda i, *after: json.dumps({"content": "", "tool_calls": [{"id": i, "name": "search", "arguments": {"query": "x"}, "after": list(after)}]})
    result = lambda i: json.dumps({"tool_call_id": i, "content": "r"})
    n, rows = 25, []
    for i in range(n):  # all in one turn, with null turns, in reverse
        for conv, turn_of in ((1, lambda k: 7), (2, lambda k: None), (3, lambda k: 1000 - k)):
            rows += [(conv, turn_of(2 * i), "assistant", call(f"c{i}", *([f"c{i - 1}"] if i else []))), (conv, turn_of(2 * i + 1), "tool", result(f"c{i}"))]
    for i in range(4):  # two causes a call
        rows += [(4, 5, "assistant", call(f"{x}{i}", *([f"a{i - 1}", f"b{i - 1}"] if i else []))) for x in "ab"] + [(4, 5, "tool", result(f"{x}{i}")) for x in "ab"]
    rows += [(5, 9, "assistant", call("m", "n")), (5, 9, "tool", result("m")), (5, 9, "assistant", call("n", "m")), (5, 9, "tool", result("n"))]
    rows += [(5, 3, "assistant", call("z", "n")), (5, 2, "tool", result("z")), (5, 4, "assistant", call("y")), (5, 1, "tool", result("y"))]
    got = chat.link(spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string").repartition(3), queries.TOOL_SCHEMAS).collect()
    assert len(got) == len(rows)
    named = {}
    for x in got:
        found = json.loads(x.json)
        named[x.conv, x.role, found["tool_calls"][0]["id"] if "tool_calls" in found else found["tool_call_id"]] = x
    for conv, at in ((1, 7), (2, None), (3, 1000)):
        for i in range(n):
            assert [(x.turn_at, x.step, x.cyclic) for x in (named[conv, "assistant", f"c{i}"], named[conv, "tool", f"c{i}"])] == [(at, 2 * i, False), (at, 2 * i + 1, False)]
    for i in range(4):
        for x in "ab":
            assert [named[4, k, f"{x}{i}"].step for k in ("assistant", "tool")] == [2 * i, 2 * i + 1]
    assert {(k, i) for (conv, k, i), x in named.items() if x.cyclic} == {("assistant", "m"), ("tool", "m"), ("assistant", "n"), ("tool", "n")}
    last = [named[5, "tool", "n"], named[5, "assistant", "z"], named[5, "tool", "z"]]
    assert [x.turn_at for x in last] == [9, 9, 9] and last[0].step + 2 == last[1].step + 1 == last[2].step
    assert (named[5, "assistant", "y"].turn_at, named[5, "tool", "y"].turn_at, named[5, "tool", "y"].step) == (4, 4, 1)


def brute_link(messages):
    """Of each message (seq, turn, ids of calls with what they need, result's id) of a conversation what link tells."""
    low = lambda t: -(1 << 62) if t is None else t
    calls = sorted(((low(turn), seq, i) for seq, turn, own, _ in messages for i, _ in own), key=lambda x: x[:2])
    owner = {}
    for _, seq, i in calls:
        owner.setdefault(i, seq)
    answers = {i: [seq for seq, _, _, r in messages if r == i] for i in owner}
    causes = {seq: {owner[r]} if r in owner else {x for _, after in own for i in after for x in answers.get(i, ())} for seq, _, own, r in messages}
    causes = {seq: own - {seq} for seq, own in causes.items()}
    at, core = {seq: low(turn) for seq, turn, _, _ in messages}, set(causes)
    while gone := {x for x in core if not causes[x] & core or not any(x in causes[y] for y in core)}:
        core -= gone
    causes = {x: {c for c in own if not (x in core and c in core and (at[c], c) > (at[x], x))} for x, own in causes.items()}
    places = {}
    while len(places) < len(causes):
        for x, own in causes.items():
            if x not in places and own <= places.keys():
                places[x] = max([(at[x], 0), *((places[c][0], places[c][1] + 1) for c in own)])
    out = {}
    for seq, turn, own, r in messages:
        ids, (place, step) = [i for i, _ in own], places[seq]
        again = any(owner[i] != seq for i in ids) or len(ids) > len(set(ids))
        out[seq] = (None if place == low(None) else place, step, owner.get(r), r is not None and r not in owner, any(owner[i] == seq and not answers[i] for i in ids), again, seq in core)
    return out


def test_chat_equals_brute_force(spark):
    """Random conversations: repeated identifiers, null turns, ties, several causes, cycles, orphans."""
    r, rows, made = random.Random(4), [], {}
    for conv in [None, *range(60)]:
        ids = [f"k{i}" for i in range(r.randint(1, 7))]
        for n in range(r.randint(1, 14)):
            turn, name = r.choice([None, 0, 1, 2, 3, 3]), f"{conv}/{n}"
            kind = r.random()
            if kind < 0.45:
                own = [(i, r.sample([*ids, "absent"], r.randint(0, min(2, len(ids))))) for i in r.choices(ids, k=r.randint(1, 2))]
                made[name] = (turn, own, None)
                rows.append((conv, turn, "assistant", json.dumps({"content": name, "tool_calls": [{"id": i, "name": "search", "arguments": {"query": "x"}, "after": a} for i, a in own]})))
            elif kind < 0.9:
                made[name] = (turn, [], r.choice([*ids, "none"]))
                rows.append((conv, turn, "tool", json.dumps({"content": name, "tool_call_id": made[name][2]})))
            else:
                made[name] = (turn, [], None)
                rows.append((conv, turn, "user", name))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.link(df, queries.TOOL_SCHEMAS).collect()
    assert len(got) == len(rows)
    talks = {}
    for x in got:
        talks.setdefault(x.conv, []).append((x.seq, *made[json.loads(x.json)["content"]]))
    want = {seq: found for messages in talks.values() for seq, found in brute_link(messages).items()}
    assert {x.seq: (x.turn_at, x.step, x.link, x.orphan, x.unanswered, x.repeated, x.cyclic) for x in got} == want
    assert 20 < sum(x.cyclic for x in got) < len(got) - 100 and max(x.step for x in got) > 3


# ---------------------------------------------------------------- BPE

PATH = queries.VOCABULARY
ALPHABET = ["a", "ab", "the", " ", "  ", "\n", "'s", "'", "ll", "re", "é", "日本", "1", "12", ".", "--", "=", "_", "\u00a0", "<|endoftext|>", "<|endof", "A", "\x00", "\U0001f44d\U0001f3fd", "ﬃ", " t", "ing", "\x1c", "\x85", "\u3000", "²", "\u0301", "\ua7ce", "\U00010940"]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.mark.parametrize(("chunk", "long"), [(bpe.CHUNK, bpe.LONG), (7, 5)])
def test_encoding_equals_the_library(merges, library, monkeypatch, chunk, long):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "LONG", long)
    r, encoder = random.Random(chunk), bpe.Encoder(merges)
    for i in range(400):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 50)))
        if i % 5 == 0:
            text = r.choice(ALPHABET) * r.randint(1, 300) + text
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.tokens(text) == want and encoder.many([text]) == [want], repr(text)
        decoder = bpe.Decoder(merges)
        assert "".join(decoder.feed([t]) for t in want) + decoder.end() == library.decode(want, skip_special_tokens=False) == text


def test_decoding_of_any_tokens(merges, library):
    r = random.Random(9)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))] + [r.randrange(128, 256) for _ in range(3)]
        decoder = bpe.Decoder(merges)
        assert decoder.feed(ids) + decoder.end() == library.decode(ids, skip_special_tokens=False)


def test_lookahead_is_sufficient(merges):
    r = random.Random(3)
    for _ in range(30):
        word = "".join(r.choice(["a", "b", "the", "ing", "er", "re", "tion", "x", "ed", "é"]) for _ in range(r.randint(200, 900))).encode()
        window = bpe.Window(merges)
        window.full = merges.lookahead + 8  # emits as early as it may
        assert [*window.feed(word), *window.end()] == merges.merge(word)


def test_lookahead_of_small_lists():
    """Small merge lists over two letters, against all words: a prefix decides all tokens that far before its end."""
    r = random.Random(11)
    for _ in range(25):
        tokens, pairs = ["a", "b"], []
        for _ in range(r.randint(1, 6)):
            x, y = r.choice(tokens), r.choice(tokens)
            if x + y not in tokens:
                tokens.append(x + y)
                pairs.append([x, y])
        letters = bpe.byte_letters()
        vocabulary = {c: i for i, c in enumerate(letters)}
        for t in tokens[2:]:
            vocabulary[t] = len(vocabulary)
        m = bpe.Merges(json.dumps({"model": {"type": "BPE", "vocab": vocabulary, "merges": pairs}, "pre_tokenizer": {"type": "ByteLevel"}, "normalizer": None}).encode())
        for _ in range(60):
            word = "".join(r.choice("ab") for _ in range(40)).encode()
            whole = np.cumsum([len(m.bytes_of[t]) for t in m.merge(word)])
            for n in range(m.lookahead, 40):
                part = np.cumsum([len(m.bytes_of[t]) for t in m.merge(word[:n])])
                assert set(part[part <= n - m.lookahead]) == set(whole[whole <= n - m.lookahead])


def test_op10(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "a" * 100_000), (9003, " " * 70_000 + "x"), (None, "<|endoftext|> é")], "doc_id long, text string")
    df = docs.union(more).withColumn("ids_sha256", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    got = sorted(map(tuple, bpe.digests(df, bpe.read_vocabulary(PATH)).collect()), key=str)
    want = []
    for i, t in df.select("doc_id", "text").collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), bpe.read_vocabulary(PATH)).count() == 0


# ---------------------------------------------------------------- kernels and the pipeline


def test_words():
    r = random.Random(2)
    texts = ["".join(r.choice("ab é\t\n日A") for _ in range(r.randint(0, 30))) for _ in range(200)] + ["", "x" * 200_000, "y" * 200_000 + "z"]
    import pyarrow as pa

    body, offsets = kernels.column(pa.array(texts).slice(0))
    w = kernels.words(body, offsets, second=True)
    data = body.tobytes()
    found = [[data[w.starts[k] : w.ends[k]].decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    by_hash, flat = {}, [x for f in found for x in f]
    for word, h in zip(flat, w.hashes.tolist()):
        assert by_hash.setdefault(h, word) == word
    assert len(by_hash) == len(set(flat))
    single = kernels.words(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    assert single.hashes[0] == kernels.words(np.frombuffer(b"  ab ", np.uint8), np.array([0, 5])).hashes[0]


def test_pipeline(spark, sf_dir, library):
    """Each stage against what its operator's brute-force tests hold it to, on the stage's own input."""
    import corpus_pipeline

    from tests.llm.test_dedup import _groups
    from tests.llm.test_pairs import brute, brute_overlap, tokens

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        after[name] = stage(spark, docs, sf_dir).cache()
        if name != "BPE":
            assert sorted(after[name].columns) == sorted(docs.columns)
            before, docs = docs, after[name]
        rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
        if name == "exact dedup":
            assert sorted(i for i, _ in rows(docs)) == sorted(max(v) for v in _groups(rows(before)).values())
        if name == "n-gram Jaccard join":
            assert sorted(i for i, _ in rows(docs)) == sorted({x[1] for x in brute(rows(before))})
        if name == "benchmark decontamination":
            items = [tokens(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            gone = {i for i, _ in rows(before)} - {i for i, _ in rows(docs)}
            for i, t in rows(before)[:25] + [x for x in rows(before) if x[0] in gone][:10]:
                if len(tokens(t)) < 400:
                    assert (i in gone) == any(brute_overlap(tokens(t), x) >= min(13, -(-4 * len(x) // 5)) for x in items)
    last = after["BPE"].collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(last) == len(texts) and all(x.round_trip and x.token_ids == library.encode(texts[x.doc_id], add_special_tokens=False).ids for x in last)
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(texts)


def test_pipeline_edges(spark, tmp_path, library):
    """Nulls, empty and repeated rows, a long text and further columns; then empty tables."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(30000))
    passage = " ".join(f"q{i} r{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, "Same words here"), (4, "same WORDS here"), (4, "same words here"), (None, "no identifier at all"), (6, long), (7, long + " end"), (8, "before " + passage + " after"), (9, "kept as it is")]
    types = "doc_id long, text string, lang string, source string, n_chars long, key_ string, id int, toxic int"
    docs = spark.createDataFrame([(i, t, None, "s", None, "k", 1, 0) for i, t in rows], types)
    labels = spark.createDataFrame([(9, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()}
    assert set(got) == {2, 4, None, 6, 9}
    texts = {2: "", None: "no identifier at all", 6: long, 9: "kept as it is"}
    for i, t in texts.items():
        assert got[i].token_ids == library.encode(t, add_special_tokens=False).ids and got[i].round_trip
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
