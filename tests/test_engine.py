"""The engine's operators against scalar versions, goldens, round trips and DuckDB."""

import hashlib
import json
import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepwell import queries
from stepwell.functions import rabin
from stepwell.operators import bench, dedup, dense, stencil
from stepwell.plans import topology
from stepwell.sources import files
from stepwell.streaming import steps

EDGES = [b"", b"x", b"a" * 31, b"a" * 32, b"a" * 33, bytes(5000), "é日".encode() * 900, random.Random(1).randbytes(60_000)]


def scalar_ends(data, mask=rabin.MASK, winlen=0):
    """Bit by bit, without tables."""

    def shift(h, bits):
        for _ in range(bits):
            h = (h << 1 & 0xFFFFFFFF) ^ (rabin.POLYNOMIAL if h >> 31 else 0)
        return h

    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        if i - start >= 32:
            old = data[i - 32]
            h ^= shift(old, 8 * (winlen - 1)) if winlen else old
        h = shift(h, 8) ^ b
        if i + 1 - start >= 32 and h & mask == 0:
            out.append(i + 1)
            start, h = i + 1, 0
    if data and (not out or out[-1] < len(data)):
        out.append(len(data))
    return out


def test_rabin_tables():
    assert rabin.TABLE[1] == 0x45C2B6A1 and rabin.TABLE[2] == 0x8B856D42 and rabin.leave_table(0) == list(range(256))


@pytest.mark.parametrize("winlen", [0, 32])
def test_cuts(winlen):
    want = [scalar_ends(d, winlen=winlen) for d in EDGES]
    assert [rabin.ends(d, winlen=winlen) for d in EDGES] == want
    assert rabin.ends_side_by_side(EDGES, winlen=winlen) == want
    assert rabin.ends_side_by_side(EDGES, winlen=winlen, lanes=1) == want
    assert len(want[5]) == 157
    many = [random.Random(i).randbytes(i * 37 % 900) for i in range(80)]
    assert rabin.ends_side_by_side(many, 31, winlen) == [scalar_ends(d, 31, winlen) for d in many]


def test_windowed_cuts_resynchronise():
    data = random.Random(4).randbytes(200_000)
    parts = lambda d, w: {d[a:b] for a, b in zip([0, *rabin.ends(d, winlen=w)], rabin.ends(d, winlen=w))}
    assert not parts(data, 0) & parts(b"changed" + data, 0)
    assert len(parts(data, 32) & parts(b"changed" + data, 32)) >= len(parts(data, 32)) - 2


def test_chunks(spark):
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(EDGES)], "doc_id long, text binary")
    for jump in (1 << 21, 1000):
        got = dedup.chunks(df.repartition(3), jump=jump, with_data=True).collect()
        for i, d in enumerate(EDGES):
            own = sorted((r for r in got if r.src == i), key=lambda r: (r.l1, r.l2))
            assert b"".join(bytes(r.data) for r in own) == d
            for r in own:
                assert d[r.offset : r.offset + r.size] == bytes(r.data) and hashlib.sha1(r.data).hexdigest() == r.sha1
            coarse = rabin.coarse_ends(d, jump)
            assert sorted({r.offset + r.size for r in own if r.is_last}) == coarse
        assert dedup.incomplete(dedup.chunks(df, jump=jump)).count() == 0
    again = dedup.chunks(df.repartition(7), jump=1000)
    assert again.exceptAll(dedup.chunks(df.coalesce(1), jump=1000)).count() == 0


def test_chunks_of_a_large_batch(spark, monkeypatch):
    """A worker cuts and unpacks an Arrow batch piece by piece: what it holds and hands back does not follow the batch."""
    df = spark.createDataFrame([], "doc_id long, text binary")
    found = spark.createDataFrame([], dedup._CHUNK + ", data binary")
    rows = dedup.archive(found, "gzip")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    noise = random.Random(7).randbytes(1 << 16)
    texts = [noise[i : i + 4000] for i in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), pa.array(texts, pa.binary())], names=["src", "data"])

    def most(run, batch):
        """All rows, and the most bytes that Python held meanwhile."""
        out = []
        tracemalloc.start()
        for b in run(iter([batch])):
            assert b.num_rows <= dedup.ROWS and b.nbytes < dedup.BYTES + (2 << 20)
            out.append(b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return pa.Table.from_batches(out).to_pylist(), peak

    got, peak = most(dedup.chunks(df, jump=4096), batch.slice(1000))
    want = [(i, a, b - a, hashlib.sha1(t[a:b]).hexdigest()) for i, t in enumerate(texts) if i >= 1000 for own in [rabin.ends(t)] for a, b in zip([0, *own], own)]
    assert [(x["src"], x["offset"], x["size"], x["sha1"]) for x in got] == want
    assert peak < 5000 * 4000 / 2
    got, peak = most(dedup.chunks(df, jump=4096, with_data=True), batch)
    assert len(got) >= 6000 and all(x["data"] == texts[x["src"]][x["offset"] : x["offset"] + x["size"]] for x in got)
    assert peak < 6000 * 4000 / 2
    assert len(most(dedup.fragments(df, jump=4096), batch)[0]) == 6000
    same = pa.array(range(20), pa.int64())
    bodies = pa.array([zlib.compress(bytes(1 << 20))] * 20, pa.binary())
    got, peak = most(dedup.decode(rows, "gzip"), pa.RecordBatch.from_arrays([same, same, same, bodies], names=["src", "l1", "l2", "data"]))
    assert len(got) == 20 and all(x["data"] == bytes(1 << 20) for x in got) and peak < 10 << 20
    parts = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), batch.column(0), batch.column(1), pa.array([hashlib.sha1(t).hexdigest() for t in texts]), pa.array([i % 3 == 0 for i in range(6000)])], names=["src", "l1", "l2", "data", "sha1", "is_dup"])
    got, peak = most(dedup.archive(found, "none"), parts)
    assert [x["body"] for x in got] == [hashlib.sha1(t).digest() if i % 3 == 0 else t for i, t in enumerate(texts)] and peak < 8 << 20


def test_chunk_goldens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert dedup.chunks(docs).count() - docs.filter("length(text) > 0").count() == 112


@pytest.mark.parametrize("codec", list(dedup.CODECS))
def test_archive_file(spark, tmp_path, codec):
    df = spark.createDataFrame([(0, bytearray(EDGES[-1] + bytes(5000) + EDGES[-1]))], "doc_id long, text binary")
    rows = dedup.archive(dedup.chunks(df, jump=3000, with_data=True), codec)
    path = str(tmp_path / "a.dedup")
    n = dedup.write_archive(rows, path, codec)
    found, back = dedup.read_archive(spark, path)
    assert found == codec and back.count() == n == rows.count()
    assert bytes(dedup.joined(dedup.decode(back, codec)).first().data) == EDGES[-1] + bytes(5000) + EDGES[-1]
    data = open(path, "rb").read()
    assert data[:5] == dedup.header(codec)
    for bad in (b"", b"\0" * 20, data[:4] + b"\x09" + data[5:], data[:-1], data + b"\x07" + bytes(8)):
        with pytest.raises(ValueError, match="archive|codec|damaged"):
            dedup.read_records(bad)


def test_decode_out_of_order(spark):
    sha = hashlib.sha1(b"abc").hexdigest()
    rows = [(0, 0, 0, 0, 20, bytearray.fromhex(sha), sha), (0, 0, 1, 1, 3, bytearray(b"abc"), sha)]
    df = spark.createDataFrame(rows, "src long, l1 long, l2 long, type int, size long, body binary, sha1 string")
    with pytest.raises(Exception, match="out of order"):
        dedup.decode(df).collect()
    with pytest.raises(Exception, match="out of order"):
        dedup.decode(df.filter("l2 = 0")).collect()


def test_stencil(spark):
    small = stencil.heat(stencil.cube(spark, (4, 6, 6, 3)), (4, 6, 6, 3))
    assert tuple(small.agg(F.sum("v"), F.max("v"), F.count("v")).first()) == (44353, 340, 432)
    large = queries.heat_stencil(spark, "")
    assert tuple(large.agg(F.sum("v"), F.max("v"), F.min("v")).first()) == (38922975, 400, 1)
    assert stencil.differing(small, small).count() == 0 and stencil.differing(small, small.limit(430)).count() == 2


def test_dense(spark):
    r = np.random.default_rng(0)
    m = r.random((50, 50)) + np.eye(50) * 60
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(50) for j in range(50)], "i long, j long, v double")
    got = np.zeros((50, 50))
    for x in dense.lu(a, 50, 16).collect():
        got[x.i, x.j] = x.v
    assert np.allclose(got, dense.packed_lu(m)) and np.allclose((np.tril(got, -1) + np.eye(50)) @ np.triu(got), m)
    b = spark.createDataFrame([(k, i, float(i + k)) for k in range(20) for i in range(50)], "rhs long, i long, v double")
    for found in (dense.solve(dense.lu(a, 50, 16), b, 50, 20, 16), dense.factor_solve(a, b, 50, 20, 16)):
        x = np.zeros((50, 20))
        for y in found.collect():
            x[y.i, y.rhs] = y.v
        assert np.allclose(m @ x, np.arange(50)[:, None] + np.arange(20)[None, :])
    g = np.zeros((50, 50))
    for y in dense.gram(a, 50, 16).collect():
        g[y.i, y.j] = y.v
    assert np.allclose(g, m @ m.T)
    with pytest.raises(ValueError, match="zero"):
        dense.packed_lu(np.zeros((2, 2)))
    assert dense.zero_diagonal(dense.least_matrix(spark, 5)).count() == 0


def test_files(spark, tmp_path):
    cells = stencil.cube(spark, (4, 6, 6, 3))
    files.write_int_matrix(cells, str(tmp_path / "m"))
    one = tmp_path / "one.txt"
    one.write_text(" ".join(str(r.v) for r in cells.orderBy("w", "x", "y", "z").collect()))
    assert stencil.differing(files.int_matrix(spark, str(one), (4, 6, 6, 3)), cells).count() == 0
    assert files.from_bits(files.float_bits(1.5)) == 1.5 and files.float_bits(1.0) == 0x3F800000
    bits = lambda *v: " ".join(str(files.float_bits(x)) for x in v)
    (tmp_path / "f.txt").write_text(f"{bits(1, 2, 3, 4)}\n2\n{bits(5, 6)}\n{bits(7, 8)}\n")
    m, v = files.float_matrix(spark, str(tmp_path / "f.txt"))
    assert sorted(map(tuple, m.collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert sorted(map(tuple, v.collect())) == [(0, 0, 5.0), (0, 1, 6.0), (1, 0, 7.0), (1, 1, 8.0)]
    (tmp_path / "runs.json").write_text(json.dumps({"runs": [{"synchronizer": "a", "function": "f", "extras": {"step": "3"}, "times": [1.0, 2.0]}]}))
    logs = files.run_logs(spark, str(tmp_path / "runs.json"))
    assert [(r.synchronizer, r.extras["step"], r.time) for r in logs.collect()] == [("a", "3", 1.0), ("a", "3", 2.0)]
    files.write_runs(logs, str(tmp_path / "out"))
    assert files.run_logs(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "spec.json").write_text(json.dumps({"iterations": 10, "description": "x", "runs": [{"synchronizer": "dsp_never", "extras": {"step": 150}}, {"synchronizer": "sequential", "extras": {}}]}))
    spec = files.specification(spark, str(tmp_path / "spec.json"))
    assert [(r.iterations, r.synchronizer, r.step) for r in spec.collect()] == [(10, "dsp_never", 150), (10, "sequential", None)]
    assert topology.check_runs(spec, "lu").count() == 2
    with pytest.raises(Exception, match="unknown synchronizer"):
        topology.check_runs(spec, "heat_cpu").collect()
    (tmp_path / "bad.json").write_text('{"runs": [{"extras": {}}]}')
    with pytest.raises(Exception, match="no iterations|no synchronizer"):
        files.specification(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "b.json").write_text(json.dumps({"producers": [{"iterations": 4, "work": 2}], "consumers": [{"iterations": 2, "work": 1}, {"iterations": 2, "work": 1}]}))
    assert files.bench_specification(spark, str(tmp_path / "b.json")).groupBy("side").count().count() == 2
    assert {tuple(r) for r in files.ini(spark, "; c\n[A]\nx = 1\ny: two ; note\n").collect()} == {("a.x", "1"), ("a.y", "two")}
    assert files.streams(spark, str(one)).first().length == os.path.getsize(one)


def test_topology(spark):
    with pytest.raises(ValueError, match="outside"):
        topology.Fifo(n=5, max=4)
    with pytest.warns(UserWarning, match="raised"):
        assert topology.Fifo(n=1, min=0).min == 1
    with pytest.raises(ValueError, match="codec"):
        topology.Job(codec="zip")
    df = spark.createDataFrame([(1, "text " * 3000), (2, "text " * 3000)], "doc_id long, text string")
    job = queries.job()
    counts = job.run(df, "numbers").first()
    assert counts.refined == counts.uniques + counts.duplicates and counts.fragments == 2
    back = dedup.joined(dedup.decode(job.run(df)))
    assert {bytes(r.data) for r in back.collect()} == {("text " * 3000).encode()}


def test_frontiers():
    for s in range(1, 9):
        assert steps.dynamic_frontier([("set", i) for i in range(30)], s, 30) == [(i + 1) // s * s - 1 for i in range(30)]
    ops = [("set", 0), ("set", 1), ("set", 2), ("set_step", 2), ("set", 3), ("set_immediate", 4), ("set_step", 0), ("set", 5), ("set_step", 99)]
    assert steps.dynamic_frontier(ops, 10, 20) == [-1, -1, -1, 2, 2, 4, 4, 5, 5]
    assert steps.dynamic_frontier(ops[:4], 10, 20, unblock=False) == [-1] * 4


def test_controllers(spark):
    assert steps.timed_steps([0, 0.2, 1.0, 1.1, 2.5], 8, 1.0, 2) == [8, 8, 16, 16, 10]
    assert steps.next_n(10, "WORK", "COHERENT", 1.5, 0.5) == 15 and steps.next_n(1, "WORK", "COHERENT", 1.2, 0.5) == 2
    assert steps.next_n(10, "NO_WORK", "COHERENT", 1.5, 0.5) == 5 and steps.next_n(1, "NO_WORK", "COHERENT", 1.5, 0.5) == 1
    assert steps.next_n(10, "WORK", "INCOHERENT", 2.0, 0.5) == 12 and steps.next_n(10, "NO_WORK", "FLUCTUATING", 2.0, 0.5) == 17
    assert steps.next_n(1, "WORK", "INCOHERENT", 2.0, 0.5) == 2 and steps.next_n(1, "NO_WORK", "INCOHERENT", 1.2, 0.5) == 2
    index = lambda n: spark.range(n).withColumnRenamed("id", "i")
    ramp = lambda *how: [r.step for r in steps.step_ramp(index(how[0]), "i", *how[1:]).orderBy("i").collect()]
    assert ramp(12, 10, 1.25, 4) == [10] * 4 + [12] * 4 + [15] * 4 and ramp(400, 10, 1.75, 10)[-1] == 12500

    def folded(n, start, factor, every, most):
        out = []
        for i in range(n):
            start = most if start >= most else int(start * factor) if i and i % every == 0 else start
            out.append(start)
        return out

    for how in ((60, 1, 1.5, 3, 40), (60, 10, 1.75, 1, 400), (20, 50, 2.0, 4, 40), (300, 3, 1.1, 2, 90)):
        assert ramp(*how) == folded(*how)
    heating = [r.n for r in steps.phase_trajectory(index(11), "i", 10, 500, 1.5).orderBy("i").collect()]
    assert heating == [15, 22, 33, 50, 75, 113, 170, 256, 384, 500, 500] == steps.phases([""] * 11, 10, 1, 500, 1.5, 0.5)["n"]
    got = {(r.key, r.event): r.step for r in steps.step_controller(spark.createDataFrame([(1, float(t), i) for i, t in enumerate([0, 0.2, 1.0, 1.1, 2.5])], "k long, t double, o long"), "k", "t", "o", 8, 1.0, 2).collect()}
    assert [got[1, i] for i in range(5)] == [8, 8, 16, 16, 10]


def test_phases_and_steps(spark):
    turned = steps.phases(["", "", "COHERENT", "FLUCTUATING", "FLUCTUATING", "INCOHERENT", "INCOHERENT", "", "", ""], 3, 2, 8, 2.0, 0.7)
    assert turned["phase"] == ["HEATING", "RUNNING", "RUNNING", "MAYBE_COOLING", "MAYBE_COOLING", "RUNNING", "COOLING", "COOLING", "COOLING", "COOLING"]
    assert turned["n"] == [6, 8, 8, 8, 8, 8, 8, 6, 4, 3]
    assert steps.stepped(["CONTENT"] * 6, 10, 3, 3, 1.5, 0.5) == [10, 10, 15, 15, 15, 22]
    assert steps.stepped(["EMPTY"] * 4, 10, 3, 2, 2.0, 0.5) == [10, 17, 8, 8]  # fluctuating at first, so damped growth; then coherent
    rows = [(k, i, e) for k in (1, 2) for i, e in enumerate(["CONTENT", "LOW", "EMPTY", "IMMEDIATE", "CONTENT", "CONTENT", "CONTENT"][:: 1 if k == 1 else -1])]
    df = spark.createDataFrame(rows, "k long, o long, e string")
    got = {(r.key, r.event): r.n for r in steps.gradient_steps(df, "k", "o", "e", 4, 2, 1, 2.0, 0.5).collect()}
    for k in (1, 2):
        want = steps.stepped([e for key, _, e in rows if key == k], 4, 2, 1, 2.0, 0.5)
        assert [got[k, i] for i in range(7)] == want
    machine = steps.phase_machine(df, "k", "o", "e", 3, 2, 8, 2.0, 0.7).filter("key = 1").orderBy("event").collect()
    assert [(r.n, r.phase) for r in machine][:3] == [(6, "HEATING"), (8, "RUNNING"), (8, "RUNNING")]


def test_run_reports(spark, tmp_path):
    from stepwell.operators import analysis

    rows = [("naive", None, 4.0), ("naive", None, 6.0), ("static", 1, 10.0), ("static", 4, 2.0), ("static", 4, 3.0)]
    runs = spark.createDataFrame(rows, "sync string, step int, time double")
    assert tuple(analysis.best_synchronizer(runs, "sync", "step", "static").first()) == ("static", 4, 2.5)
    lines = [r.line for r in analysis.ratio_lines(runs, "sync", "step", "naive", "static").orderBy("n").collect()]
    assert lines == ["Naive / Promise+1: 0.5", "Promise+1 / Naive: 2.0", "Naive / Promise+4 (best): 2.0", "Promise+4 (best) / Naive: 0.5"]
    assert analysis.ratio_lines(runs.filter("sync = 'naive'"), "sync", "step", "naive", "static").count() == 0
    dims = {"w": 1, "x": 2, "y": 3, "z": 4, "threads": 5, "active": False, "iterations": 6}
    analysis.write_lines(analysis.summary_lines(runs, "sync", "step", "static", dims), str(tmp_path / "summary"))
    text = [r.value for r in spark.read.text(str(tmp_path / "summary")).collect()]
    assert text[0].startswith("1 * 2 * 3 * 4 with 5 threads") and text[-1] == "Best synchronization: static.4, with average time: 2.500000" and len(text) == 6
    analysis.write_numerics(runs, ["sync"], str(tmp_path / "numerics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "numerics")).columns == ["sync", "avg", "var", "std", "vc"]


def test_command_line(spark, tmp_path, capsys):
    from stepwell import cli

    data = EDGES[-1] + bytes(9000) + EDGES[-1]
    (tmp_path / "in.bin").write_bytes(data)
    job = {"input": str(tmp_path / "in.bin"), "codec": "bzip2", "jump": 3000, "layers": {"fragment": [{"outputs": {"0": {"n": 2}}}]}}
    (tmp_path / "job.json").write_text(json.dumps(job))
    out, back = str(tmp_path / "a.dedup"), str(tmp_path / "back.bin")
    args = cli.parser().parse_args(["dedup", "-f", str(tmp_path / "job.json"), "-a", "--output", out, "--observers", str(tmp_path / "obs.json")])
    report = cli.run_dedup(spark, args)
    assert report["total_input"] == len(data) and report["total_output"] == os.path.getsize(out) and report["n_duplicates"] > 0
    assert json.loads((tmp_path / "obs.json").read_text())[0]["fifo_id"] == 0
    assert cli.run_decode(spark, cli.parser().parse_args(["decode", out, back])) == {"bytes": len(data)} and open(back, "rb").read() == data
    numbers = cli.run_dedup(spark, cli.parser().parse_args(["dedup", "-f", str(tmp_path / "job.json"), "--numbers"]))
    assert numbers["refined"] == report["n_chunks"]
    with pytest.raises(FileNotFoundError):
        files.existing(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="regular"):
        files.preloaded(spark, str(tmp_path))
    dims = (3, 3, 3, 2)
    start = stencil.cube(spark, dims)
    flat = lambda df: " ".join(str(r.v) for r in df.orderBy("w", "x", "y", "z").collect())
    (tmp_path / "start.txt").write_text(flat(start))
    (tmp_path / "want.txt").write_text(flat(stencil.heat(start, dims)))
    (tmp_path / "spec.json").write_text(json.dumps({"iterations": 1, "description": "x", "runs": [{"synchronizer": "sequential", "extras": {}}]}))
    args = ["heat", "--simulations-file", str(tmp_path / "spec.json"), "--start-matrix-file", str(tmp_path / "start.txt"), "--input-matrix-file", str(tmp_path / "want.txt"), "--dims", "3", "3", "3", "2", "--general-log-file", str(tmp_path / "log.json"), "--runs-times-file", str(tmp_path / "times")]
    assert cli.run_kernel(spark, cli.parser().parse_args(args)) == {"runs": 1, "equal": True}
    assert json.loads((tmp_path / "log.json").read_text())["w"] == 3 and files.run_logs(spark, str(tmp_path / "times")).count() == 1


def test_more_files(spark, tmp_path):
    values = [0.0, -0.0, 1.0, -1.5, 3.4e38, 1e-40, 2.0**-126, 0.1, 123456.789, float("inf")]
    df = spark.createDataFrame([(i, float(np.float32(v))) for i, v in enumerate(values)], "n int, v float")
    for r in df.select("v", files.bits_of(F.col("v")).alias("b")).withColumn("w", files.value_of(F.col("b"))).collect():
        assert r.b == files.float_bits(r.v) and np.float32(r.w).view(np.uint32) == np.float32(r.v).view(np.uint32)
    a = spark.createDataFrame([(i, j, float(i * 2 + j + 1)) for i in range(2) for j in range(2)], "i long, j long, v double")
    b = spark.createDataFrame([(k, i, float(5 + 2 * k + i)) for k in range(2) for i in range(2)], "rhs long, i long, v double")
    files.write_float_matrix(a, b, str(tmp_path / "m"))
    m, v = files.float_matrix(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, a.collect())) and sorted(map(tuple, v.collect())) == sorted(map(tuple, b.collect()))
    (tmp_path / "data.json").write_text(json.dumps({"w": 1, "x": 2, "y": 3, "z": 4, "iterations": 5, "active": True, "threads": 6}))
    assert tuple(files.metadata(spark, str(tmp_path / "data.json")).first())[1:] == (1, 2, 3, 4, 5, "true", 6)
    times = spark.createDataFrame([("a", "f", i, k, t, float(100 * i + 10 * k + t)) for i in range(2) for k in range(2) for t in range(3)], "synchronizer string, function string, iteration int, local int, thread int, time double")
    files.write_iterations(times, str(tmp_path / "it"))
    one = spark.read.json(str(tmp_path / "it")).first()
    assert one.iterations[1].local_iterations[0].threads == [100.0, 101.0, 102.0]
    files.write_dump(spark, {"b": 1, "a": [2]}, str(tmp_path / "dump.json"))
    assert (tmp_path / "dump.json").read_text() == '{"a": [2], "b": 1}'
    seen = []
    calls = topology.Callbacks()
    calls.push.append(lambda d, n: seen.append(("push", n)))
    calls.pop.append(lambda d, n: seen.append(("pop", n)))
    calls.around(lambda d, n: seen.append(("handle", n)))(df, 3)
    assert seen == [("push", 3), ("handle", 3), ("pop", 3)]
    (tmp_path / "user.py").write_text("def produce():\n    return 1\n")
    assert topology.functions(str(tmp_path / "user.py"), "produce")[0]() == 1
    with pytest.raises(ValueError, match="consume"):
        topology.functions(str(tmp_path / "user.py"), "produce", "consume")


def test_decoded_file(spark, tmp_path):
    df = spark.createDataFrame([(0, bytearray(EDGES[-1]))], "doc_id long, text binary")
    path = str(tmp_path / "out.bin")
    assert dedup.write_stream(dedup.decode(dedup.archive(dedup.chunks(df, with_data=True), "gzip"), "gzip"), path) == len(EDGES[-1])
    assert open(path, "rb").read() == EDGES[-1]


def test_streams(spark, tmp_path):
    rows = [(1, t) for t in (0.0, 0.2, 1.0, 1.1, 2.5)] + [(2, 0.0), (2, 5.0)]
    spark.createDataFrame(rows, "key long, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("key long, t double").parquet(str(tmp_path / "in"))
    q = steps.stream_controller(live, 8, 1.0, 2).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.t, r.step) for r in spark.table("changes").collect()} == {(1, 1.0, 16), (1, 2.5, 10), (2, 5.0, 5)}
    chunks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "sha1 string, n long")
    chunks.coalesce(1).write.parquet(str(tmp_path / "chunks"))
    live = spark.readStream.schema("sha1 string, n long").parquet(str(tmp_path / "chunks"))
    q = steps.stream_first_occurrences(live).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.sha1 for r in spark.table("firsts").collect()) == ["a", "b"]


def test_bench(spark):
    a, b = bench.route(bench.fan_out(bench.emit(spark, 40), 5), 30)
    assert a.count() + b.count() == 200 and a.count() == 60
    p = bench.prefix(spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 1)], "g long, value long"), "g")
    assert {tuple(r) for r in p.collect()} == {(1, 2, 1), (2, 0, 1)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    names = sorted(got.columns)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[names].itertuples(index=False))
    assert rows(got) == rows(want)
