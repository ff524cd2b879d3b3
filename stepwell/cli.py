"""Command line: `python -m stepwell.cli dedup ...`, `... decode ...`, `... heat ...`, `... lu ...`.

A job file is JSON: ``{"input": path, "codec": "gzip", "jump": n, "winlen": n, "layers": {name: [{"inputs": {id: {...}},
"outputs": ..., "extras": ...}]}}``; `layers` is optional, as queues say how a job is scheduled, not what it gives.
Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.operators import dedup, dense, stencil
from stepwell.plans import topology
from stepwell.session import session, write_bytes, written
from stepwell.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stepwell")
    kinds = top.add_subparsers(dest="command", required=True)
    d = kinds.add_parser("dedup", help="deduplicate a file into an archive")
    d.add_argument("-f", "--file", required=True, help="job file")
    modes = d.add_mutually_exclusive_group()
    for flag in ("orig", "smart", "auto"):
        modes.add_argument(f"-{flag[0]}", f"--{flag}", dest="mode", action="store_const", const=flag, help=f"schedule as {flag}; all give the same archive")
    modes.add_argument("--numbers", dest="mode", action="store_const", const="numbers", help="only count chunks")
    d.add_argument("--output", help="the archive")
    d.add_argument("--observers", help="where the queues' uses are written, as JSON")
    d.add_argument("--redirect", help="where the report is written instead of standard output")
    u = kinds.add_parser("decode", help="restore the file of an archive")
    u.add_argument("archive")
    u.add_argument("output")
    for name in ("heat", "lu"):
        k = kinds.add_parser(name, help=f"run the {name} kernel once for each run and iteration of a specification")
        for option in ("runs-times-file", "iterations-times-file", "simulations-file", "general-log-file", "input-matrix-file", "start-matrix-file", "description"):
            k.add_argument(f"--{option}", required=option in ("simulations-file", "start-matrix-file"))
        k.add_argument("--dims", type=int, nargs="+", help="w x y z, or n", required=True)
    return top


def read_job(text: str) -> tuple[str, topology.Job]:
    """The input's path and the job, checked."""
    given = json.loads(text)
    job = topology.Job(given.get("codec", "none"), given.get("jump", dedup.JUMP), given.get("winlen", 0))
    uses = lambda t, role: {int(k): topology.Fifo(**v) for k, v in t.get(role, {}).items()}
    for layer, threads in given.get("layers", {}).items():
        job.push_layer(layer, [topology.Thread(uses(t, "inputs"), uses(t, "outputs"), uses(t, "extras")) for t in threads])
    return given["input"], job


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def run_dedup(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The report as a dictionary: counts, or the archive's totals."""
    path, job = read_job(_text(spark, args.file))
    source = files.existing(spark, path).select(F.xxhash64("path").alias("doc_id"), F.col("content").alias("text"))
    if args.observers:
        write_bytes(spark, args.observers, [json.dumps([r.asDict() for r in job.table(spark).collect()]).encode()])
    if args.mode == "numbers":
        return job.run(source, "numbers").first().asDict()
    found = written(dedup.chunks(source, "doc_id", "text", job.jump, winlen=job.winlen, with_data=True), "chunks")
    rows = written(dedup.archive(found, job.codec), "archive")
    if args.output:
        dedup.write_archive(rows, args.output, job.codec)
    return dedup.report(found, rows).first().asDict()


def run_decode(spark: SparkSession, args: argparse.Namespace) -> dict:
    codec, rows = dedup.read_archive(spark, args.archive)
    return {"bytes": dedup.write_stream(dedup.decode(written(rows, "archive"), codec), args.output)}


def run_kernel(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Each run of the specification is the same computation, timed; the result is held against the expected matrix."""
    kernel = {"heat": "heat_cpu", "lu": "lu"}[args.command]
    runs = topology.check_runs(files.specification(spark, args.simulations_file), kernel).collect()
    times, same = [], None
    for r in runs:
        for _ in range(r.iterations):
            began = time.time()
            if args.command == "heat":
                out = written(stencil.heat(files.int_matrix(spark, args.start_matrix_file, tuple(args.dims)), tuple(args.dims)), "heat")
            else:
                out = written(dense.lu(files.float_matrix(spark, args.start_matrix_file)[0], args.dims[0]), "lu")
            times.append((r.synchronizer, args.command, {"step": str(r.step)} if r.step is not None else {}, time.time() - began))
            if args.input_matrix_file and same is None:
                same = equal(spark, out, args)
    logs = spark.createDataFrame(times, "synchronizer string, function string, extras map<string,string>, time double")
    for path in (args.runs_times_file, args.iterations_times_file):
        if path:
            files.write_runs(logs, path)
    if args.general_log_file:
        names = dict(zip("wxyz", args.dims)) if args.command == "heat" else {"dim": args.dims[0]}
        files.write_parameters(spark, {**names, "file": args.simulations_file, "iterations": runs[0].iterations if runs else 0, "threads": spark.sparkContext.defaultParallelism, "description": args.description}, args.general_log_file)
    return {"runs": len(times), "equal": same}


def equal(spark: SparkSession, out: DataFrame, args: argparse.Namespace) -> bool:
    """Whether the result is the expected one: exactly for whole numbers, to single precision for others."""
    if args.command == "heat":
        return stencil.differing(out, files.int_matrix(spark, args.input_matrix_file, tuple(args.dims))).isEmpty()
    want = files.float_matrix(spark, args.input_matrix_file)[0].select("i", "j", F.col("v").alias("w"))
    return out.join(want, ["i", "j"], "full").filter("v is null or w is null or abs(v - w) > 1e-4 * (1 + abs(w))").isEmpty()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    report = {"dedup": run_dedup, "decode": run_decode}.get(args.command, run_kernel)(spark, args)
    text = json.dumps(report)
    if getattr(args, "redirect", None):
        write_bytes(spark, args.redirect, [text.encode()])
    else:
        print(text)
    return 1 if report.get("equal") is False else 0


if __name__ == "__main__":
    sys.exit(main())
