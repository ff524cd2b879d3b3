"""Publication frontiers, step controllers and the cost model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# ---------------------------------------------------------------- cost model


def compute_steps(grid: DataFrame) -> DataFrame:
    """Best (producer_step, consumer_step) for producers p, consumers c, mean works pw and cw, cost_p, cost_s, items: integers.

    The side whose partner is slower sets its step at the minimum of the run time, the other
    follows in the ratio of threads; a step of 0 becomes 1.
    """
    half = "sqrt(cast((items * cost_s) div nullif(({n} * {w} + {n} * cost_p) div {m} + 2 * (2 * {n} * cost_p - cost_p), 0) as double))"
    lead = F.col("c") * F.col("pw") > F.col("p") * F.col("cw")
    a = F.expr("cast(floor(" + half.format(n="p", w="cw", m="c") + ") as bigint)")
    b = F.expr("cast(floor(" + half.format(n="c", w="pw", m="p") + ") as bigint)")
    out = grid.withColumn("a", F.coalesce(a, F.lit(0))).withColumn("b", F.coalesce(b, F.lit(0)))
    one = lambda x: F.greatest(x, F.lit(1)).cast("long")
    return out.select(*grid.columns, one(F.when(lead, F.col("a")).otherwise(F.expr("b * c div p"))).alias("producer_step"), one(F.when(lead, F.expr("a * p div c")).otherwise(F.col("b"))).alias("consumer_step"))


def critical_cost(step: Column, alpha: float = 6.5, beta: float = 1.0) -> Column:
    return alpha * step / (F.log(step) + beta)


def best_step(items: Column, cost_s: Column, n: Column, cost_p: Column, work: Column) -> Column:
    return F.sqrt(items * cost_s / (n * cost_p + work))


def valid_step(step: Column, n: Column, cost_s: Column, cost_p: Column, work: Column, alpha: float = 6.5, beta: float = 1.0) -> Column:
    """Whether the work is large enough for the formula."""
    return work >= (n - 1) * (critical_cost(step, alpha, beta) + cost_s) / step - cost_p


def expected_chunks(size: Column) -> tuple[Column, Column]:
    """Coarse and fine chunks to expect of a stream."""
    coarse = F.floor(size / (2 << 20))
    return coarse, coarse * 512


# ---------------------------------------------------------------- frontiers


def static_frontier(index: Column, step: int) -> Column:
    """What is published after indices 0..index were set in order."""
    return (F.floor((index + 1) / step) * step - 1).cast("long")


def dynamic_frontier(operations: list[tuple[str, int]], step: int, n: int, unblock: bool = True) -> list[int]:
    """Published index after each of set(i), set_immediate(i), set_step(s)."""
    published, current, out = -1, -1, []
    for op, arg in operations:
        if op == "set_step":
            arg = min(max(arg, 1), n)
            if unblock and arg < step and current - published >= arg:
                published = current
            step = arg
        else:
            current = arg
            if op == "set_immediate" or arg - published >= step:
                published = arg
        out.append(published)
    return out


# ---------------------------------------------------------------- controllers


def timed_steps(times: list[float], step: int, width: float = 1.0, least: int = 100, most: int = 1 << 31) -> list[int]:
    """The step after each event: when `width` has passed since the window's first event, more than `least`
    events double it and fewer divide it by 1.5; a new window begins with the next event."""
    out, first, n = [], None, 0
    for t in times:
        first = t if first is None else first
        n += 1
        if t - first >= width:
            step = min(max(int(step * 2 if n > least else step / 1.5), 1), most)
            first, n = None, 0
        out.append(step)
    return out


def step_controller(events: DataFrame, key: str, time: str, order: str, step: int, width: float, least: int) -> DataFrame:
    """`timed_steps` of each key's events: (key, order, step)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "o"])
        return pd.DataFrame({"key": pdf.key, "event": pdf.o, "step": timed_steps(pdf.t.tolist(), step, width, least)})

    own = events.select(F.col(key).cast("long").alias("key"), F.col(time).cast("double").alias("t"), F.col(order).cast("long").alias("o"))
    return own.groupBy("key").applyInPandas(one, "key long, event long, step long")


def stream_controller(events: DataFrame, step: int, width: float, least: int) -> DataFrame:
    """The controller on a stream of (key long, t double): a row a change, state (step, first, n) a key."""

    def one(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, first, n = state.get if state.exists else (step, -1.0, 0)
        rows = []
        for t in sorted(t for pdf in frames for t in pdf.t):
            first = t if n == 0 else first
            n += 1
            if t - first >= width:
                now = max(int(now * 2 if n > least else now / 1.5), 1)
                n = 0
                rows.append((key[0], t, now))
        state.update((now, first, n))
        yield pd.DataFrame(rows, columns=["key", "t", "step"])

    return events.groupBy("key").applyInPandasWithState(one, "key long, t double, step long", "step long, first double, n long", "append", GroupStateTimeout.NoTimeout)


def stream_first_occurrences(chunks: DataFrame) -> DataFrame:
    """The first chunk of each digest on a stream."""
    return chunks.dropDuplicates(["sha1"])


def push_event(shared: Column, work_amount: int, immediate: Column | None = None) -> Column:
    """What a flush finds in the shared buffer; one that doesn't wait for a full buffer is IMMEDIATE."""
    found = F.when(shared == 0, "EMPTY").when(shared < work_amount, "LOW").otherwise("CONTENT")
    return found if immediate is None else F.when(immediate, "IMMEDIATE").otherwise(found)


def pop_event(own: Column, shared: Column, waits: Column) -> Column:
    """What a consumer whose own buffer has run out finds in the shared one; null while its own has elements."""
    return F.when(own > 0, F.lit(None).cast("string")).when(shared > 0, "CONTENT").when(waits, "EMPTY").otherwise("EMPTY_NW")


def counted(events: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """Events with n_with_work and n_no_work: how many of a kind came in a row; each kind resets the other, IMMEDIATE neither."""
    work, none = F.col(event).isin("LOW", "CONTENT").cast("long"), (F.col(event) == "EMPTY").cast("long")
    all_before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    e = events.select(key, order, event, work.alias("w"), none.alias("e")).withColumn("we", F.sum("e").over(all_before)).withColumn("ew", F.sum("w").over(all_before))
    run = lambda island: W.partitionBy(key, island).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return e.select(key, order, event, F.sum("w").over(run("we")).alias("n_with_work"), F.sum("e").over(run("ew")).alias("n_no_work"))


def gradient(events: DataFrame, key: str, order: str, event: str, look_back: int, reason: str, limit: int = 3) -> DataFrame:
    """Class of the last `look_back` events at each: empty ones less ones with content, plus half the low ones."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-look_back + 1, 0)
    worth = F.when(F.col(event) == "EMPTY", 1.0).when(F.col(event) == "CONTENT", -1.0).otherwise(0.5)
    diff = F.sum(worth).over(w)
    off = diff >= limit if reason == "WORK" else diff <= -limit
    return events.select(key, order, event, F.when((diff > -limit) & (diff < limit), "FLUCTUATING").when(off, "INCOHERENT").otherwise("COHERENT").alias("gradient"))


def next_n(n: int, reason: str, gradient: str, increase: float, decrease: float) -> int:
    """A queue's step after a reason to change it; when the events contradict the reason, the opposite change, damped.

    The damped shrink's factor is at least 1 for decreases of at most 1: it grows, as the published rule does.
    """
    damp = {"FLUCTUATING": (0.75, 0.25), "INCOHERENT": (0.5, 0.5)}
    grow = reason == "WORK" if gradient == "COHERENT" else reason != "WORK"
    if gradient == "COHERENT":
        n = int(n * (increase if grow else decrease))
    else:
        up, down = damp[gradient]
        n = int(n * (1 + increase * up - up)) if grow else int(n * (1 - decrease * down + down))
    n = n if grow else max(n, 1)
    return 2 if n == 1 and (grow or reason == "WORK") else n


def classified(events: list[str], reason: str, limit: int = 3) -> str:
    """The gradient of the last events, one by one (the column form is `gradient`)."""
    diff = sum({"EMPTY": 1.0, "CONTENT": -1.0, "LOW": 0.5}.get(e, 0.0) for e in events)
    if -limit < diff < limit:
        return "FLUCTUATING"
    return "INCOHERENT" if (diff >= limit if reason == "WORK" else diff <= -limit) else "COHERENT"


def stepped(events: list[str], n: int, with_work: int, no_work: int, increase: float, decrease: float) -> list[int]:
    """The step after each push event: so many in a row with work, or without, are a reason to change it."""
    out, seen, counts = [], [], {"WORK": 0, "NO_WORK": 0}
    for e in events:
        seen.append(e)
        if e != "IMMEDIATE":
            reason, other = ("NO_WORK", "WORK") if e == "EMPTY" else ("WORK", "NO_WORK")
            counts[reason], counts[other] = counts[reason] + 1, 0
            if counts[reason] >= (with_work if reason == "WORK" else no_work):
                found = classified(seen[-(no_work if reason == "WORK" else with_work) :], reason)
                n = next_n(n, reason, found, increase, decrease)
                if found == "COHERENT":
                    counts[reason] = 0
        out.append(n)
    return out


def _folded(rows: DataFrame, key: str, order: str, columns: list[str], fold, out: str, kind: str) -> DataFrame:
    """An ordered fold of each key's rows: (key, event, out...)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event")
        return pd.DataFrame({"key": pdf.key, "event": pdf.event} | fold(*[pdf[c].tolist() for c in columns]))

    own = rows.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("event"), *columns)
    return own.groupBy("key").applyInPandas(one, f"key long, event long, {out} {kind}" if kind else f"key long, event long, {out}")


def gradient_steps(events: DataFrame, key: str, order: str, event: str, n: int, with_work: int, no_work: int, increase: float, decrease: float) -> DataFrame:
    """`stepped` of each key's events: (key, event, n)."""
    return _folded(events.withColumn("_e", F.col(event)), key, order, ["_e"], lambda e: {"n": stepped(e, n, with_work, no_work, increase, decrease)}, "n", "long")


def frontiers(operations: DataFrame, key: str, order: str, step: int, n: int, unblock: bool = True) -> DataFrame:
    """`dynamic_frontier` of each key's operations (columns op and arg): (key, event, published)."""
    return _folded(operations, key, order, ["op", "arg"], lambda op, arg: {"published": dynamic_frontier(list(zip(op, arg, strict=True)), step, n, unblock)}, "published", "long")


def phases(gradients: list[str], n: float, least: float, most: float, increase: float, decrease: float) -> dict[str, list]:
    """Phase and step of a queue after each push: it heats until it would pass `most`, runs, and cools down to `least`.

    The step is a fraction that is kept; what a queue uses is its floor while heating and its ceiling while cooling.
    """
    phase, used, out = "HEATING", int(n), {"n": [], "phase": []}
    turns = {("RUNNING", "FLUCTUATING"): "MAYBE_COOLING", ("RUNNING", "INCOHERENT"): "COOLING", ("MAYBE_COOLING", "COHERENT"): "COOLING", ("MAYBE_COOLING", "INCOHERENT"): "RUNNING"}
    for g in gradients:
        if phase == "HEATING":
            hot = n * increase > most
            n, phase = (most, "RUNNING") if hot else (n * increase, phase)
            used = math.floor(n)
        elif phase == "COOLING":
            n = max(n * decrease, least)
            used = math.ceil(n)
        else:
            phase = turns.get((phase, g), phase)
        out["n"].append(used)
        out["phase"].append(phase)
    return out


def phase_machine(gradients: DataFrame, key: str, order: str, gradient: str, n: float, least: float, most: float, increase: float, decrease: float) -> DataFrame:
    """`phases` of each key's pushes: (key, event, n, phase)."""
    return _folded(gradients.withColumn("_g", F.col(gradient)), key, order, ["_g"], lambda g: phases(g, n, least, most, increase, decrease), "n long, phase string", "")


def _rounds(start: float, most: float, factor: float) -> int:
    """Multiplications after which a growing step has surely passed `most`, truncated to whole numbers or not."""
    return 2 + int(most) if factor <= 1 else 2 + math.ceil(math.log(max(most / start, 1)) / math.log(factor)) + math.ceil(2 / (factor - 1) / max(start, 1)) * 8


def phase_trajectory(pushes: DataFrame, index: str, n: float, most: float, increase: float) -> DataFrame:
    """(index, n, phase) after each push of a heating queue, by columns: push i has i + 1 factors, as many as matter."""
    i, first = F.col(index), F.struct(F.lit(float(n)).alias("x"), F.lit(False).alias("done"))

    def push(a: Column, _: Column) -> Column:
        hot = a["done"] | (a["x"] * increase > most)
        return F.struct(F.when(hot, F.lit(float(most))).otherwise(a["x"] * increase).alias("x"), hot.alias("done"))

    state = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(i, F.lit(_rounds(n, most, increase)))), first, push)
    return pushes.select(index, state.alias("s")).select(index, F.floor("s.x").alias("n"), F.when(F.col("s.done"), "RUNNING").otherwise("HEATING").alias("phase"))


def step_ramp(iterations: DataFrame, index: str, start: int, factor: float, every: int, most: int = 12500) -> DataFrame:
    """(index, step): a step that grows by `factor` each `every` iterations; once it has passed `most` it is that."""
    i = F.col(index)
    raises = F.least(F.floor(i / every), F.lit(_rounds(start, most, factor))).cast("long")
    grown = F.aggregate(F.sequence(F.lit(1).cast("long"), raises), F.lit(start).cast("long"), lambda a, _: F.when(a >= most, F.lit(most).cast("long")).otherwise(F.floor(a * factor)))
    grown = F.when(raises > 0, grown).otherwise(F.lit(start).cast("long"))
    fresh = (i % every == 0) & (F.floor(i / every) == raises) & (i > 0)
    return iterations.select(index, F.when(fresh, grown).otherwise(F.least(grown, F.lit(most).cast("long"))).alias("step"))
