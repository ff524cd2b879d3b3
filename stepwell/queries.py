"""Named queries over the test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.functions import columns as C
from stepwell.functions import rabin
from stepwell.operators import analysis, bench, dedup, dense, stencil
from stepwell.plans import topology
from stepwell.session import written
from stepwell.streaming import steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.whole(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- chunks and deduplication


@query()
def chunk_boundaries(spark, sf_dir):
    return dedup.chunks(table(spark, sf_dir, "documents"))


@query()
def chunk_numbers(spark, sf_dir):
    return dedup.numbers(dedup.chunks(table(spark, sf_dir, "documents")))


@query()
def chunk_dedup_stats(spark, sf_dir):
    return dedup.stats(dedup.chunks(table(spark, sf_dir, "documents")))


@query()
def chunk_order_check(spark, sf_dir):
    return dedup.incomplete(dedup.chunks(table(spark, sf_dir, "documents"), jump=4096))


@query()
def fragment_boundaries(spark, sf_dir):
    return dedup.fragments(table(spark, sf_dir, "documents"), jump=4096)


_TABLE = "[" + ",".join(map(str, rabin.TABLE)) + "]"
_JUMP, _MASK = 300, 31


def _scan(states: str, first: str, seen: str, after: str) -> str:
    """Recursive SQL of a byte-by-byte scan of `benchmark`: fingerprint h since place s; `hit` is a cut behind byte i."""
    return f"""t AS (SELECT item_id AS src, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n, {_TABLE}::BIGINT[] AS tab FROM benchmark),
    {states} AS (
        SELECT src, {first} FROM t
        UNION ALL
        SELECT src, {after}
        FROM (SELECT *, {seen} AND i + 1 - s >= 32 AND h2 & {_MASK} = 0 AS hit
              FROM (SELECT *, xor(((g << 8) & 4294967295) | ('0x' || substr(x, i * 2 + 1, 2))::BIGINT, tab[(g >> 24) + 1]) AS h2
                    FROM (SELECT r0.*, CASE WHEN i - s >= 32 THEN xor(h, ('0x' || substr(x, (i - 32) * 2 + 1, 2))::BIGINT) ELSE h END AS g, x, tab, n
                          FROM r r0 JOIN t USING (src) WHERE i < n) r)))"""


_REFINED = _scan("r(src, i, s, h, cut)", "0::BIGINT, 0::BIGINT, 0::BIGINT, false", "true", "i + 1, CASE WHEN hit THEN i + 1 ELSE s END, CASE WHEN hit THEN 0 ELSE h2 END, hit") + """,
    ends AS (SELECT src, i AS e FROM r WHERE cut UNION SELECT src, n FROM t WHERE n > 0),
    c AS (SELECT src, 0::BIGINT AS l1, row_number() OVER w - 1 AS l2, coalesce(lag(e) OVER w, 0)::BIGINT AS "offset", (e - coalesce(lag(e) OVER w, 0))::BIGINT AS size, lead(e) OVER w IS NULL AS is_last
          FROM ends WINDOW w AS (PARTITION BY src ORDER BY e))"""
#: A coarse chunk ends at the first cut of a scan that begins `_JUMP` bytes behind its start.
_COARSE = _scan("r(src, i, s, h, cut)", f"{_JUMP}::BIGINT, {_JUMP}::BIGINT, 0::BIGINT, false", "true", f"CASE WHEN hit THEN i + 1 + {_JUMP} ELSE i + 1 END, CASE WHEN hit THEN i + 1 + {_JUMP} ELSE s END, CASE WHEN hit THEN 0 ELSE h2 END, hit") + f""",
    ends AS (SELECT src, i - {_JUMP} AS e FROM r JOIN t USING (src) WHERE cut AND i - {_JUMP} < n UNION SELECT src, n FROM t WHERE n > 0)"""


@query(f"WITH RECURSIVE {_REFINED} SELECT * FROM c")
def chunk_boundaries_benchmark(spark, sf_dir):
    return dedup.chunks(table(spark, sf_dir, "benchmark"), "item_id", mask=_MASK).drop("sha1")


def _benchmark_chunks(spark, sf_dir):
    return dedup.chunks(table(spark, sf_dir, "benchmark"), "item_id", mask=_MASK)


@query(f"WITH RECURSIVE {_REFINED}, d AS (SELECT c.*, substr(x, c.offset * 2 + 1, size * 2) AS body FROM c JOIN t USING (src)) SELECT count(*) FILTER (l2 = 0) AS fragments, count(*) AS refined, count(DISTINCT body) AS uniques, count(*) - count(DISTINCT body) AS duplicates FROM d")
def chunk_numbers_benchmark(spark, sf_dir):
    return dedup.numbers(_benchmark_chunks(spark, sf_dir))


@query(f"""WITH RECURSIVE {_REFINED}, d AS (SELECT c.*, substr(x, c.offset * 2 + 1, size * 2) AS body FROM c JOIN t USING (src)), p AS (SELECT body, count(*) AS n, any_value(size) AS size FROM d GROUP BY 1)
    SELECT sum(n * size)::BIGINT AS total_input, sum(size)::BIGINT AS total_dedup, sum(n)::BIGINT AS n_chunks, sum(n - 1)::BIGINT AS n_duplicates, round(sum(n * size) / sum(size)::DOUBLE, 6) AS factor, round(sum(n - 1) * 100.0 / sum(n)::DOUBLE, 6) AS duplicate_percent FROM p""")
def chunk_stats_benchmark(spark, sf_dir):
    return dedup.stats(_benchmark_chunks(spark, sf_dir))


@query(f"""WITH RECURSIVE {_COARSE} SELECT src, row_number() OVER w - 1 AS l1, coalesce(lag(e) OVER w, 0)::BIGINT AS "offset", (e - coalesce(lag(e) OVER w, 0))::BIGINT AS size FROM ends WINDOW w AS (PARTITION BY src ORDER BY e)""")
def fragment_boundaries_benchmark(spark, sf_dir):
    return dedup.fragments(table(spark, sf_dir, "benchmark"), "item_id", jump=_JUMP, mask=_MASK)


@query("SELECT doc_id AS src, sha1(coalesce(text, '')) AS sha1, strlen(coalesce(text, ''))::BIGINT AS size FROM documents")
def doc_fingerprint(spark, sf_dir):
    return documents(spark, sf_dir).select("src", "sha1", "size")


_WHOLE = "d AS (SELECT doc_id AS src, sha1(coalesce(text, '')) AS sha1, strlen(coalesce(text, ''))::BIGINT AS size FROM documents), f AS (SELECT *, min(src) OVER (PARTITION BY sha1) AS orig FROM d)"


@query(f"WITH {_WHOLE} SELECT src, sha1, orig AS orig_src, src <> orig AS is_dup FROM f")
def dedup_first_occurrence(spark, sf_dir):
    return dedup.deduplicate(documents(spark, sf_dir)).select("src", "sha1", "orig_src", "is_dup")


@query(f"WITH {_WHOLE} SELECT src, sha1, size FROM f WHERE src = orig")
def dedup_unique_semi(spark, sf_dir):
    return dedup.unique(documents(spark, sf_dir)).select("src", "sha1", "size")


@query(f"WITH {_WHOLE} SELECT src, sha1, size FROM f WHERE src <> orig")
def dedup_duplicates_anti(spark, sf_dir):
    return dedup.duplicates(documents(spark, sf_dir)).select("src", "sha1", "size")


@query(f"""WITH {_WHOLE} SELECT sum(size)::BIGINT AS total_input, sum(size) FILTER (src = orig)::BIGINT AS total_dedup, count(*) AS n_chunks, count(*) FILTER (src <> orig) AS n_duplicates,
    round(sum(size) / sum(size) FILTER (src = orig)::DOUBLE, 6) AS factor, round(count(*) FILTER (src <> orig) * 100.0 / count(*)::DOUBLE, 6) AS duplicate_percent FROM f""")
def dedup_stats(spark, sf_dir):
    return dedup.stats(documents(spark, sf_dir))


@query(f"WITH {_WHOLE} SELECT least(size >> 7, 255)::INT AS slot, count(*) AS n FROM d GROUP BY 1")
def chunk_size_histogram(spark, sf_dir):
    return dedup.size_histogram(documents(spark, sf_dir))


@query(f"""WITH {_WHOLE}, m AS (SELECT least(size >> 7, 255) * 128 + 64 AS m FROM d), a AS (SELECT count(*) AS n, sum(m)::DOUBLE AS s, sum(m * m)::DOUBLE AS q FROM m)
    SELECT n, round(s / n, 4) AS mean, round(sqrt(q - s * s / n), 3) AS root_sum_sq_dev, round(sqrt((q - s * s / n) / n), 4) AS stddev FROM a""")
def chunk_size_moments(spark, sf_dir):
    return dedup.size_moments(documents(spark, sf_dir))


def _with_data(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return documents(spark, sf_dir).join(d.select(F.col("doc_id").alias("src"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")), "src")


@query(f"WITH {_WHOLE} SELECT src, (src = orig)::INT AS type, CASE WHEN src = orig THEN size ELSE 20 END AS size FROM f")
def archive_records(spark, sf_dir):
    return dedup.archive(_with_data(spark, sf_dir)).select("src", "type", "size")


@query(f"""WITH {_WHOLE}, a AS (SELECT sum(size)::BIGINT AS total_input, sum(size) FILTER (src = orig)::BIGINT AS total_dedup, (5 + sum(9 + CASE WHEN src = orig THEN size ELSE 20 END))::BIGINT AS total_output,
        count(*) AS n_chunks, count(*) FILTER (src <> orig) AS n_duplicates FROM f)
    SELECT total_input, total_dedup, total_dedup AS total_compressed, total_output, n_chunks, n_duplicates, round(total_input / total_output::DOUBLE, 6) AS effective_factor, round(total_input / total_dedup::DOUBLE, 6) AS dedup_factor,
        1.0::DOUBLE AS compression_factor, round(100.0 * (total_output - total_dedup)::DOUBLE / total_output, 6) AS overhead_percent,
        (['Bytes', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB'])[1 + floor(log2(least(total_input, total_dedup, total_output)) / 10)::INT] AS unit FROM a""")
def archive_report(spark, sf_dir):
    return dedup.report(documents(spark, sf_dir), dedup.archive(_with_data(spark, sf_dir)))


def _round_trip(codec):
    def run(spark, sf_dir):
        rows = written(dedup.archive(_with_data(spark, sf_dir), codec), "archive")
        return dedup.decode(rows, codec).select("src", F.sha1("data").alias("sha1"))

    run.__name__ = f"decode_roundtrip_{codec}"
    return query("SELECT doc_id AS src, sha1(coalesce(text, '')) AS sha1 FROM documents")(run)


for _codec in dedup.CODECS:
    _round_trip(_codec)


@query("SELECT doc_id AS src, sha1(text) AS sha1 FROM documents WHERE strlen(coalesce(text, '')) > 0")
def decode_chunked(spark, sf_dir):
    """Chunked, archived and decoded again: digests of the whole texts.  Chunks and archive are made once each."""
    found = written(dedup.chunks(table(spark, sf_dir, "documents"), jump=4096, with_data=True), "chunks")
    rows = written(dedup.archive(found, "gzip"), "archive")
    return dedup.joined(dedup.decode(rows, "gzip")).select("src", F.sha1("data").alias("sha1"))


@query("""SELECT conv_id AS src, 0::BIGINT AS l1, turn AS l2, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS out_offset,
    strlen(text)::BIGINT AS size FROM conversations""")
def decode_offsets(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return dedup.offsets(t.select(F.col("conv_id").alias("src"), F.lit(0).cast("long").alias("l1"), F.col("turn").alias("l2"), F.octet_length("text").cast("long").alias("size")))


@query("SELECT page_id AS src, sha1(coalesce(html, '')) AS sha1, least(strlen(coalesce(html, '')) >> 7, 255)::INT AS slot FROM pages")
def page_fingerprint(spark, sf_dir):
    return dedup.whole(table(spark, sf_dir, "pages"), "page_id", "html").select("src", "sha1", C.slot(F.col("size")).alias("slot"))


# ---------------------------------------------------------------- run statistics


def runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("synchronizer"), F.col("value").alias("time"))


@query("""SELECT event_type AS synchronizer, count(value) AS n, round(avg(value), 6) AS avg, round(var_samp(value), 6) AS var, round(stddev_samp(value), 6) AS std, round(stddev_samp(value) / avg(value), 6) AS vc
    FROM events GROUP BY 1""")
def run_numerics(spark, sf_dir):
    return analysis.numerics(runs(spark, sf_dir), ["synchronizer"])


@query("SELECT event_type AS best, round(avg(value), 6) AS avg FROM events GROUP BY 1 ORDER BY avg(value), event_type LIMIT 1")
def run_best(spark, sf_dir):
    return analysis.best(runs(spark, sf_dir), "synchronizer")


@query("""WITH m AS (SELECT event_type AS run, avg(value) AS m FROM events GROUP BY 1)
    SELECT a.run, b.run AS other, round(a.m / b.m, 6) AS ratio FROM m a JOIN m b ON a.run <> b.run""")
def run_ratios(spark, sf_dir):
    return analysis.ratios(runs(spark, sf_dir), "synchronizer")


@query("""SELECT event_type AS synchronizer, count(value) AS n, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high
    FROM events GROUP BY 1""")
def run_violin(spark, sf_dir):
    return analysis.violin(runs(spark, sf_dir), "synchronizer")


@query("""WITH m AS (SELECT event_type AS run, avg(value) AS m FROM events GROUP BY 1)
    SELECT printf('%s: %.3f%s', run, m, CASE WHEN row_number() OVER (ORDER BY m, run) = 1 THEN ' *' ELSE '' END) AS line FROM m""")
def run_summary(spark, sf_dir):
    return analysis.summary(runs(spark, sf_dir), "synchronizer")


@query("SELECT (user_id % 8)::INT AS step, round(avg(value), 6) AS avg FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1")
def run_step_evolution(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first"))
    return e.join(F.broadcast(first), F.col("event_type") == F.col("first")).groupBy((F.col("user_id") % 8).cast("int").alias("step")).agg(F.round(F.avg("value"), 6).alias("avg"))


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).alias("ns"))


_RANKED = "r AS (SELECT user_id, floor(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY floor(value * 100)) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"WITH {_RANKED} SELECT user_id, (sum(v)::BIGINT // floor(max(n) * 0.5)::BIGINT)::BIGINT AS mean FROM r WHERE rn > floor(n * 0.25) AND rn <= floor(n * 0.75) GROUP BY 1")
def observer_trimmed_mean(spark, sf_dir):
    return analysis.trimmed_mean(_samples(spark, sf_dir), "user_id", "ns", 0.25)


@query(f"""WITH {_RANKED}, h AS (SELECT *, n // 2 AS h FROM r)
    SELECT user_id, (sum(v)::BIGINT // count(*))::BIGINT AS quart FROM h WHERE rn <= h AND (rn = h // 2 + 1 OR (h % 2 = 0 AND rn = h // 2)) GROUP BY 1""")
def observer_quart(spark, sf_dir):
    return analysis.lower_half_median(_samples(spark, sf_dir), "user_id", "ns")


@query(f"WITH {_RANKED} SELECT user_id, (sum(v)::BIGINT // count(*))::BIGINT AS median FROM r WHERE rn = n // 2 + 1 OR (n % 2 = 0 AND rn = n // 2) GROUP BY 1")
def observer_median(spark, sf_dir):
    return analysis.median(_samples(spark, sf_dir), "user_id", "ns")


@query("SELECT min(m) AS cost FROM (SELECT (sum(floor(value * 100)::BIGINT)::BIGINT // count(*))::BIGINT AS m FROM events GROUP BY user_id) WHERE m <> 0")
def observer_least_average(spark, sf_dir):
    return analysis.least_average(_samples(spark, sf_dir), "user_id", "ns")


@query("""SELECT event_type AS thread, count(*) AS n, sum(floor(value * 100)::BIGINT)::BIGINT AS total, round(avg(floor(value * 100)::BIGINT), 6) AS avg FROM events GROUP BY 1""")
def timer_pair_totals(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("thread"), F.col("event_id").alias("begin"), (F.col("event_id") + F.floor(F.col("value") * 100)).alias("end"))
    return analysis.timer_pairs(t, "begin", "end", ["thread"])


_STATIC = "s AS (SELECT min(event_type) AS static FROM events), t AS (SELECT event_type AS sync, CASE WHEN event_type = static THEN (user_id % 8)::INT END AS step, avg(value) AS m FROM events, s GROUP BY 1, 2)"


def _stepped_runs(spark, sf_dir):
    """Run times with a step; the first event type stands for the static synchronizer."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("sync"), (F.col("user_id") % 8).cast("int").alias("step"), F.col("value").alias("time")), e.agg(F.min("event_type")).first()[0]


@query(f"WITH {_STATIC} SELECT sync AS best, step, round(m, 6) AS avg FROM t ORDER BY m, sync, step LIMIT 1")
def best_synchronizer(spark, sf_dir):
    runs, static = _stepped_runs(spark, sf_dir)
    return analysis.best_synchronizer(runs, "sync", "step", static)


@query(f"""WITH {_STATIC}, k AS (SELECT max(event_type) AS naive FROM events), v AS (
        SELECT (SELECT m FROM t, k WHERE sync = naive) AS naive, (SELECT m FROM t, s WHERE sync = static AND step = 1) AS one, (SELECT m FROM t, s WHERE sync = static ORDER BY m, step LIMIT 1) AS best, (SELECT step FROM t, s WHERE sync = static ORDER BY m, step LIMIT 1) AS step)
    SELECT 0::INT AS n, round(naive / one, 6) AS ratio, 'Naive / Promise+1' AS what FROM v UNION ALL SELECT 1, round(one / naive, 6), 'Promise+1 / Naive' FROM v
    UNION ALL SELECT 2, round(naive / best, 6), 'Naive / Promise+' || step || ' (best)' FROM v UNION ALL SELECT 3, round(best / naive, 6), 'Promise+' || step || ' (best) / Naive' FROM v""")
def ratio_lines(spark, sf_dir):
    runs, static = _stepped_runs(spark, sf_dir)
    naive = table(spark, sf_dir, "events").agg(F.max("event_type")).first()[0]
    lines = analysis.ratio_lines(runs, "sync", "step", naive, static)
    return lines.select("n", F.substring_index("line", ": ", -1).cast("double").alias("ratio"), F.substring_index("line", ": ", 1).alias("what"))


@query(f"""WITH {_STATIC}, b AS (SELECT * FROM t ORDER BY m, sync, step LIMIT 1), n AS (SELECT CASE WHEN step IS NULL THEN sync ELSE sync || '.' || step END AS run, m FROM t)
    SELECT 0::INT AS n, '8 * 25 * 30 * 27 with 4 threads (using active wait: False) and 10 iterations' AS line UNION ALL SELECT 1, 'Running with the following synchronization patterns: '
    UNION ALL SELECT 2, printf('%s%s: %.6f', chr(9), run, m) FROM n UNION ALL SELECT 3, printf('Best synchronization: %s, with average time: %.6f', CASE WHEN step IS NULL THEN sync ELSE sync || '.' || step END, round(m, 6)) FROM b""")
def run_summary_dims(spark, sf_dir):
    runs, static = _stepped_runs(spark, sf_dir)
    return analysis.summary_lines(runs, "sync", "step", static, {"w": 8, "x": 25, "y": 30, "z": 27, "threads": 4, "active": False, "iterations": 10})


@query("""SELECT user_id, count(v) AS n, round(avg(v), 6) AS avg FROM (SELECT user_id, floor(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 5 GROUP BY 1""")
def observer_quota(spark, sf_dir):
    return analysis.first_samples(_samples(spark, sf_dir), "user_id", ["event_id"], "ns", 5)


# ---------------------------------------------------------------- cost model, frontiers, controllers


def _grid(spark):
    return spark.range(2000).selectExpr("id", "id % 7 + 1 AS p", "id % 5 + 1 AS c", "id * 37 % 1000 AS pw", "id * 53 % 900 AS cw", "id % 40 + 1 AS cost_p", "id * 11 % 5000 AS cost_s", "100000 + id AS items")


_GRID = "g AS (SELECT id, id % 7 + 1 AS p, id % 5 + 1 AS c, id * 37 % 1000 AS pw, id * 53 % 900 AS cw, id % 40 + 1 AS cost_p, id * 11 % 5000 AS cost_s, 100000 + id AS items FROM range(2000) t(id))"


@query(f"""WITH {_GRID}, s AS (SELECT *, c * pw > p * cw AS lead,
        floor(sqrt((items * cost_s) // ((p * cw + p * cost_p) // c + 2 * (2 * p * cost_p - cost_p))))::BIGINT AS a,
        floor(sqrt((items * cost_s) // ((c * pw + c * cost_p) // p + 2 * (2 * c * cost_p - cost_p))))::BIGINT AS b FROM g)
    SELECT id, greatest(CASE WHEN lead THEN a ELSE b * c // p END, 1)::BIGINT AS producer_step, greatest(CASE WHEN lead THEN a * p // c ELSE b END, 1)::BIGINT AS consumer_step FROM s""")
def compute_steps(spark, sf_dir):
    return steps.compute_steps(_grid(spark)).select("id", "producer_step", "consumer_step")


@query(f"""WITH {_GRID}, s AS (SELECT *, id + 1 AS s FROM g)
    SELECT id, round(6.5 * s / (ln(s) + 1.0), 6) AS critical, round(sqrt(items * cost_s / (p * cost_p + pw)::DOUBLE), 6) AS best, pw >= (p - 1) * (6.5 * s / (ln(s) + 1.0) + cost_s) / s - cost_p AS valid FROM s""")
def costcc_model(spark, sf_dir):
    g, s = _grid(spark), F.col("id") + 1
    c = F.col
    return g.select("id", F.round(steps.critical_cost(s), 6).alias("critical"), F.round(steps.best_step(c("items"), c("cost_s"), c("p"), c("cost_p"), c("pw")), 6).alias("best"), steps.valid_step(s, c("p"), c("cost_s"), c("cost_p"), c("pw")).alias("valid"))


@query("SELECT doc_id AS src, (n // 2097152)::BIGINT AS coarse, (n // 2097152 * 512)::BIGINT AS fine FROM (SELECT doc_id, strlen(coalesce(text, '')) * 1000 AS n FROM documents)")
def expected_chunks(spark, sf_dir):
    coarse, fine = steps.expected_chunks(F.col("size") * 1000)
    return documents(spark, sf_dir).select("src", coarse.cast("long").alias("coarse"), fine.cast("long").alias("fine"))


@query("SELECT event_id, ((event_id + 1) // 7 * 7 - 1)::BIGINT AS published FROM events")
def publication_frontier(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", steps.static_frontier(F.col("event_id"), 7).alias("published"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS event, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r(key, rn, event, step, first, n) AS (
        SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, 64::BIGINT, NULL::DOUBLE, 0::BIGINT FROM e
        UNION ALL
        SELECT key, rn, event, CASE WHEN hit THEN least(greatest(CASE WHEN n > 3 THEN step * 2 ELSE floor(step / 1.5)::BIGINT END, 1), 2147483648) ELSE step END, CASE WHEN hit THEN NULL ELSE first END, CASE WHEN hit THEN 0 ELSE n END
        FROM (SELECT *, t - first >= 86400 AS hit FROM (SELECT e.key, e.rn, e.event, e.t, r.step, coalesce(r.first, e.t) AS first, r.n + 1 AS n FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)))
    SELECT key, event, step FROM r WHERE rn > 0""")
def timer_step_controller(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    return steps.step_controller(e, "user_id", "t", "event_id", 64, 86400.0, 3)


@query("SELECT event_id, CASE WHEN floor(value) = 0 THEN 'EMPTY' WHEN floor(value) < 20 THEN 'LOW' ELSE 'CONTENT' END AS event FROM events")
def push_event_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", steps.push_event(F.floor("value"), 20).alias("event"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN floor(value) = 0 THEN 'EMPTY' WHEN floor(value) < 20 THEN 'LOW' ELSE 'CONTENT' END AS event FROM events),
    d AS (SELECT *, sum(CASE event WHEN 'EMPTY' THEN 1.0 WHEN 'CONTENT' THEN -1.0 ELSE 0.5 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS d FROM e)
    SELECT user_id, event_id, event, CASE WHEN d > -3 AND d < 3 THEN 'FLUCTUATING' WHEN d >= 3 THEN 'INCOHERENT' ELSE 'COHERENT' END AS gradient FROM d""")
def gradient_class(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", steps.push_event(F.floor("value"), 20).alias("event"))
    return steps.gradient(e, "user_id", "event_id", "event", 6, "WORK")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 11 = 0 THEN 'IMMEDIATE' WHEN floor(value) = 0 THEN 'EMPTY' WHEN floor(value) < 20 THEN 'LOW' ELSE 'CONTENT' END AS event FROM events),
    c AS (SELECT *, event IN ('LOW', 'CONTENT') AS w, event = 'EMPTY' AS e FROM e), i AS (SELECT *, count(*) FILTER (e) OVER o AS we, count(*) FILTER (w) OVER o AS ew FROM c WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, event, count(*) FILTER (w) OVER (PARTITION BY user_id, we ORDER BY event_id) AS n_with_work, count(*) FILTER (e) OVER (PARTITION BY user_id, ew ORDER BY event_id) AS n_no_work FROM i""")
def push_event_runs(spark, sf_dir):
    return steps.counted(_pushes(spark, sf_dir), "user_id", "event_id", "event")


def _pushes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", steps.push_event(F.floor("value"), 20, F.col("event_id") % 11 == 0).alias("event"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN NULL WHEN floor(value) > 10 THEN 'CONTENT' WHEN event_id % 2 = 0 THEN 'EMPTY' ELSE 'EMPTY_NW' END AS event FROM events""")
def pop_event_class(spark, sf_dir):
    shared = F.greatest(F.floor("value") - 10, F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", steps.pop_event(F.col("event_id") % 3, shared, F.col("event_id") % 2 == 0).alias("event"))


@query()
def gradient_steps(spark, sf_dir):
    return steps.gradient_steps(_pushes(spark, sf_dir), "user_id", "event_id", "event", 10, 3, 2, 1.5, 0.5)


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) FILTER (event_id % 9 <> 0) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CASE WHEN event_id % 9 = 0 THEN 'set_step' WHEN event_id % 31 = 1 THEN 'set_immediate' ELSE 'set' END AS op, event_id % 7 + 1 AS s FROM events),
    r(key, rn, event, step, current, published) AS (
        SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, 5::BIGINT, -1::BIGINT, -1::BIGINT FROM e
        UNION ALL
        SELECT e.key, e.rn, e.event, CASE WHEN op = 'set_step' THEN s ELSE step END, CASE WHEN op = 'set_step' THEN current ELSE i END,
            CASE WHEN op = 'set_step' THEN CASE WHEN s < step AND current - published >= s THEN current ELSE published END WHEN op = 'set_immediate' OR i - published >= step THEN i ELSE published END
        FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)
    SELECT key, event, published FROM r WHERE rn > 0""")
def dynamic_frontier(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    own = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    step = F.col("event_id") % 9 == 0
    place = F.sum((~step).cast("long")).over(own) - 1
    ops = e.select("user_id", "event_id", F.when(step, "set_step").when(F.col("event_id") % 31 == 1, "set_immediate").otherwise("set").alias("op"), F.when(step, F.col("event_id") % 7 + 1).otherwise(place).alias("arg"))
    return steps.frontiers(ops, "user_id", "event_id", 5, 1 << 40)


@query("""WITH RECURSIVE r(i, step) AS (SELECT 0::BIGINT, 10::BIGINT UNION ALL
    SELECT i + 1, CASE WHEN step >= 12500 THEN 12500 WHEN (i + 1) % 10 = 0 THEN floor(step * 1.75)::BIGINT ELSE step END FROM r WHERE i < 199) SELECT * FROM r""")
def step_ramp(spark, sf_dir):
    return steps.step_ramp(spark.range(200).withColumnRenamed("id", "i"), "i", 10, 1.75, 10)


@query("""WITH RECURSIVE r(i, x, phase) AS (SELECT 0::BIGINT, 15::DOUBLE, 'HEATING' UNION ALL
    SELECT i + 1, CASE WHEN phase = 'RUNNING' OR x * 1.5::DOUBLE > 500 THEN 500 ELSE x * 1.5::DOUBLE END, CASE WHEN phase = 'RUNNING' OR x * 1.5::DOUBLE > 500 THEN 'RUNNING' ELSE 'HEATING' END FROM r WHERE i < 19) SELECT i, floor(x)::BIGINT AS n, phase FROM r""")
def phase_trajectory(spark, sf_dir):
    return steps.phase_trajectory(spark.range(20).withColumnRenamed("id", "i"), "i", 10, 500, 1.5)


# ---------------------------------------------------------------- dense kernels

_N = 64


@query(f"SELECT i, j, least(i, j) + 1.0::DOUBLE AS v FROM range({_N}) a(i), range({_N}) b(j)")
def matrix_min_gram(spark, sf_dir):
    return dense.gram(dense.ones_lower(spark, _N), _N, 24)


def _vectors(spark):
    return dense.right_sides(spark, _N, 3)


@query(f"SELECT id // {_N} AS rhs, id % {_N} AS i, (id * 7 % 11 + 1)::DOUBLE AS v FROM range({3 * _N}) t(id)")
def matrix_vectors(spark, sf_dir):
    return _vectors(spark)


_VECTORS = f"x AS (SELECT id // {_N} AS rhs, id % {_N} AS i, (id * 7 % 11 + 1)::DOUBLE AS v FROM range({3 * _N}) t(id))"


@query(f"WITH {_VECTORS} SELECT rhs, a.i, sum((least(a.i, x.i) + 1) * v) AS v FROM range({_N}) a(i), x GROUP BY 1, 2")
def matvec(spark, sf_dir):
    return dense.matvec(dense.least_matrix(spark, _N), _vectors(spark))


@query(f"SELECT i, j, 1.0::DOUBLE AS v FROM range({_N}) a(i), range({_N}) b(j)")
def lu_packed(spark, sf_dir):
    return dense.lu(dense.least_matrix(spark, _N), _N, 24)


@query(f"WITH {_VECTORS} SELECT rhs, i, v FROM x")
def lu_solve(spark, sf_dir):
    """The factors' two sweeps, on the right sides that the vectors give."""
    a = dense.least_matrix(spark, _N)
    return dense.solve(dense.lu(a, _N, 24), dense.matvec(a, _vectors(spark)), _N, 3, 24)


@query(f"WITH {_VECTORS} SELECT rhs, i, v FROM x")
def lu_combine(spark, sf_dir):
    """Factored and solved in one call."""
    a = dense.least_matrix(spark, _N)
    return dense.factor_solve(a, dense.matvec(a, _vectors(spark)), _N, 3, 24)


_HEAT = """WITH RECURSIVE g AS (SELECT (id // 108)::INT AS w, (id // 18 % 6)::INT AS x, (id // 3 % 6)::INT AS y, (id % 3)::INT AS z, (id % 10 + 1)::INT AS v FROM range(432) t(id)),
    r(d, w, x, y, z, v) AS (
        SELECT 0, w, x, y, z, v FROM g WHERE w + x + y = 0
        UNION ALL
        SELECT d, w, x, y, z, v + CASE WHEN w * x * y = 0 THEN 0 ELSE 15 * floor(sqrt(sum(p) FILTER (side = 1)) + ln(sum(p) FILTER (side = 2)) + sin(sum(p) FILTER (side = 3)))::INT END
        FROM (SELECT r.d + 1 AS d, g.w, g.x, g.y, g.z, g.v, r.v AS p, CASE WHEN g.w = r.w + 1 THEN 1 WHEN g.x = r.x + 1 THEN 2 ELSE 3 END AS side
              FROM r JOIN g ON g.w + g.x + g.y = r.d + 1 AND g.z = r.z AND g.w - r.w BETWEEN 0 AND 1 AND g.x - r.x BETWEEN 0 AND 1 AND g.y - r.y BETWEEN 0 AND 1)
        GROUP BY d, w, x, y, z, v)
    SELECT w, x, y, z, v FROM r"""


@query(_HEAT)
def heat_stencil_small(spark, sf_dir):
    return stencil.heat(stencil.cube(spark, (4, 6, 6, 3)), (4, 6, 6, 3))


@query()
def heat_stencil(spark, sf_dir):
    return stencil.heat(stencil.cube(spark, (8, 25, 30, 27)), (8, 25, 30, 27))


@query("SELECT (id // 108)::INT AS w, (id // 18 % 6)::INT AS x, (id // 3 % 6)::INT AS y, (id % 3)::INT AS z, (id % 10 + 1)::INT AS v FROM range(432) t(id)")
def stencil_start(spark, sf_dir):
    return stencil.cube(spark, (4, 6, 6, 3))


# ---------------------------------------------------------------- synthetic pipeline, topology, scalars


@query("SELECT v * 5 + j AS value FROM range(1000) a(v), range(5) b(j)")
def pipeline_fanout(spark, sf_dir):
    return bench.fan_out(bench.emit(spark, 1000), 5)


@query("SELECT value, value * 37 % 100 < 30 AS first FROM range(5000) t(value)")
def pipeline_route(spark, sf_dir):
    a, b = bench.route(bench.fan_out(bench.emit(spark, 1000), 5), 30)
    return a.withColumn("first", F.lit(True)).union(b.withColumn("first", F.lit(False)))


@query("""WITH r AS (SELECT g, value, row_number() OVER (PARTITION BY g ORDER BY value) - 1 AS rn FROM (SELECT DISTINCT user_id AS g, (event_id // 50) AS value FROM events))
    SELECT g, count(*) FILTER (value = rn) AS frontier, count(*) FILTER (value <> rn) AS held FROM r GROUP BY 1""")
def pipeline_frontier(spark, sf_dir):
    return bench.prefix(table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.expr("event_id div 50").alias("value")), "g")


def job() -> topology.Job:
    """A small topology: 1, 2, 2, 3 and 1 threads."""
    j, fifo, thread = topology.Job(), topology.Fifo, topology.Thread
    a, b, c, d = (j.new_fifo() for _ in range(4))
    j.push_layer("fragment", [thread(outputs={a: fifo()})])
    j.push_layer("refine", [thread({a: fifo()}, {b: fifo()}) for _ in range(2)])
    j.push_layer("deduplicate", [thread({b: fifo()}, {c: fifo()}, {d: fifo()}) for _ in range(2)])
    j.push_layer("compress", [thread({c: fifo()}, {d: fifo()}) for _ in range(3)])
    return j.push_layer("reorder", [thread({d: fifo()})])


@query("SELECT * FROM (VALUES (0, 1::BIGINT, 3::BIGINT), (1, 2, 4), (2, 2, 5), (3, 5, 6)) t(fifo_id, producers, interacting)")
def topology_counts(spark, sf_dir):
    return topology.fifo_counts(job().table(spark))


@query("SELECT 3 AS fifo_id")
def topology_reorder(spark, sf_dir):
    return topology.reorder_fifos(job().table(spark))


@query("""SELECT event_id, CASE WHEN strlen(n::VARCHAR) < 9 THEN lpad(n::VARCHAR, 9, '0') ELSE n::VARCHAR END AS padded, round(n / 1e9, 9) AS seconds,
    (((n & 255) << 24) | ((n >> 8 & 255) << 16) | ((n >> 16 & 255) << 8) | (n >> 24 & 255))::BIGINT AS swapped, (n % 98317)::BIGINT AS bucket, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
    FROM (SELECT event_id, ts, event_id * 1000003 % 4294967296 AS n FROM events)""")
def scalar_functions(spark, sf_dir):
    n = (F.col("event_id") * 1000003) % 4294967296
    e = table(spark, sf_dir, "events").select("event_id", "ts", n.alias("n"))
    return e.select("event_id", C.nine_digits(F.col("n")).alias("padded"), F.round(C.seconds(F.lit(0), F.col("n")), 9).alias("seconds"), C.swap_bytes(F.col("n")).alias("swapped"), C.bucket(F.col("n"), 98317).alias("bucket"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_aggregate(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
