"""Experiments: run matrices, run metrics, aggregates, decision traces.

``runs`` has (run_id, scenario_id, strategy_id, repetition, success, ...); evidence that is missing is null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions.tables import stored
from roadspark.operators.topology import numbered

# Metrics over successful runs only, and over all runs.
OF_SUCCESS = ("travel_time_s", "route_length_m", "congestion_exposure_s")
ALGORITHMS = ("dijkstra", "astar", "bidirectional_dijkstra", "bidirectional_astar", "alt", "ch", "time_dependent", "lpa_star", "d_star_lite")


def matrix(manifests: DataFrame) -> DataFrame:
    """(run_id, name, scenario_id, strategy_id, algorithm, repetition): scenarios x strategies x 1..repetitions.

    ``manifests`` has (name, repetitions, scenarios [id], strategies [(id, algorithm)]).  Ids that repeat and
    algorithms that aren't known raise.
    """
    ids = F.transform("strategies", lambda s: s["id"])
    unique = (F.size(F.array_distinct("scenarios")) == F.size("scenarios")) & (F.size(F.array_distinct(ids)) == F.size("strategies"))
    known = F.forall("strategies", lambda s: s["algorithm"].isin(*ALGORITHMS))
    checked = F.when(~unique, F.raise_error(F.lit("ids must be unique"))).when(~known, F.raise_error(F.lit("unknown algorithm"))).otherwise(F.col("scenarios"))
    rows = manifests.select("name", "repetitions", "strategies", F.explode(checked).alias("scenario_id"))
    rows = rows.select("name", "repetitions", "scenario_id", F.explode("strategies").alias("s"))
    rows = rows.select("name", "scenario_id", F.col("s.id").alias("strategy_id"), "s.algorithm", F.explode(F.sequence(F.lit(1), F.col("repetitions"))).alias("repetition"))
    return rows.select(F.concat_ws(":", "name", "scenario_id", "strategy_id", "repetition").alias("run_id"), "*")


def draw(*parts: Column) -> Column:
    """A number of 48 bits that hangs on all of ``parts`` alone: the head of the MD5 of their texts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


#: Rounds of the permutation; each half of a place is changed in every second.
ROUNDS = 8


def permuted(key: Column, place: Column, there: Column) -> Column:
    """``place`` (0 to ``there`` - 1) under the pseudorandom permutation of ``key``, as a column expression.

    A Feistel network over rows and columns of a grid of about sqrt(there) by sqrt(there) cells.  A cell behind the last place is walked on from,
    by the same permutation, until a place comes up.  There are fewer such cells than the grid has rows, and each is met once at most, which bounds the walk.
    """
    high = F.ceil(F.sqrt(there)).cast("long")
    wide = F.ceil(there / high).cast("long")

    def turn(cell: Column, k: Column) -> Column:
        first = (cell["l"] + draw(key, k, cell["r"])) % high
        second = (cell["r"] + draw(key, k, cell["l"])) % wide
        return F.struct(F.when(k % 2 == 0, first).otherwise(cell["l"]).alias("l"), F.when(k % 2 == 1, second).otherwise(cell["r"]).alias("r"))

    def walk(cell: Column, step: Column) -> Column:
        done = (step > 0) & (cell["l"] * wide + cell["r"] < there)
        return F.when(done, cell).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), cell, turn))

    start = F.struct(F.floor(place / wide).cast("long").alias("l"), (place % wide).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), high * wide - there), start, walk, lambda cell: cell["l"] * wide + cell["r"])


def random_events(spec: DataFrame, edges: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(scenario_id, repetition, edge, t, action, value): random disturbances, the same for all strategies of a repetition.

    ``spec`` has (scenario_id, repetition, seed, count, start_s, end_s, duration_s, step_s, factor).  Edges are drawn
    without replacement: they are numbered in order, and a row takes the first ``count`` numbers of a permutation that its seed + repetition - 1 keys
    (``permuted``), so every set of edges is as likely.  Ticks are drawn evenly from [ceil(start/step), floor(end/step)], one for each edge; the end event
    restores 1 after the duration, rounded up to ticks.  The stream of numbers is our own.  No edge is looked at that isn't drawn.

    A window without a tick raises, as do more events than there are edges (without any edge there are no events), and a row whose last event could
    end behind ``run_s``, the length of the run, where ``spec`` has it.
    ``manual`` (scenario_id, edge) names edges that events are set on by hand: one among ``edges`` raises.  ``spec`` may have ``action``
    (speed_factor if not): after ``close`` the edge opens again.
    """
    if manual is not None:
        both = manual.join(edges.select("edge").distinct(), "edge", "left_semi").limit(1).collect()
        if both:
            raise ValueError(f"edge {both[0]['edge']} of random events has events set by hand")
    low, high = F.ceil(F.col("start_s") / F.col("step_s")), F.floor(F.col("end_s") / F.col("step_s"))
    late = (high + F.ceil(F.col("duration_s") / F.col("step_s"))) * F.col("step_s") > F.col("run_s") if "run_s" in spec.columns else F.lit(False)
    sound = F.when(low > high, F.raise_error(F.lit("the window of random events has no tick"))).when(late, F.raise_error(F.lit("random events end behind the run")))
    sound = sound.when(F.col("count") > F.col("there"), F.raise_error(F.lit("more random events than edges"))).otherwise(F.col("count"))
    action = F.col("action") if "action" in spec.columns else F.lit("speed_factor")
    listed = numbered(edges.select("edge").distinct(), ["edge"], "number")
    there = listed.agg(F.count("*").alias("there"))
    rows = spec.join(F.broadcast(there), how="cross").where("there > 0").withColumn("count", sound).where("count > 0")
    rows = rows.withColumn("key", F.col("seed").cast("long") + F.col("repetition") - 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)))
    drawn = rows.withColumn("number", permuted(F.col("key"), F.col("k"), F.col("there"))).join(listed, "number")
    tick = low + draw(F.col("key"), F.lit("tick"), F.col("k")) % (high - low + 1)
    long = F.ceil(F.col("duration_s") / F.col("step_s"))
    begins = F.struct((tick * F.col("step_s")).alias("t"), action.alias("action"), F.col("factor").alias("value"))
    ends = F.struct(((tick + long) * F.col("step_s")).alias("t"), F.when(action == "close", "open").otherwise(action).alias("action"), F.lit(1.0).alias("value"))
    out = drawn.select("scenario_id", "repetition", "edge", F.explode(F.array(begins, ends)).alias("e"))
    return out.select("scenario_id", "repetition", "edge", "e.*")


def run_metrics(traces: DataFrame) -> DataFrame:
    """``traces`` with success, latency per decision, model cost and real-time factor.

    It has (run_id, arrived, finished, error, latency_ms, decisions, tokens_in, tokens_out, price_in, price_out, simulated_s, wall_s).
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return traces.withColumns(
        {
            "success": yes("arrived") & yes("finished") & F.col("error").isNull(),
            "latency_per_decision_ms": F.when(F.col("decisions") > 0, F.col("latency_ms") / F.col("decisions")),
            "model_cost": (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6,
            "real_time_factor": F.when(F.col("wall_s") > 0, F.col("simulated_s") / F.col("wall_s")).otherwise(0.0),
        }
    )


def congestion_exposure(kpis: DataFrame, threshold: float = 5.0, by: list[str] | None = None) -> DataFrame:
    """Vehicle seconds on edges slower than ``threshold`` m/s, by run."""
    slow = F.when(F.col("mean_speed") < threshold, F.col("vehicle_seconds")).otherwise(0.0)
    return kpis.groupBy(*(by or ["run_id"])).agg(F.sum(slow).alias("congestion_exposure_s"))


def native_route_metrics(reroutes: DataFrame) -> DataFrame:
    """Per run: applied and failed reroutes of its vehicle; changed, unchanged and overlap only with evidence on all applied rows.

    ``reroutes`` has (run_id, vehicle_id, own_vehicle, success, changed, overlap, reversal, reversal_version).
    """
    own = reroutes.where(F.col("vehicle_id") == F.col("own_vehicle"))
    ok = F.col("success")
    valid = F.bool_and(F.when(ok, F.col("changed").isNotNull() & F.coalesce(F.col("overlap").between(0, 1), F.lit(False))))
    sums = own.groupBy("run_id").agg(
        F.count_if(ok).alias("applied"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(valid, F.lit(True)).alias("valid"),
        F.count_if(ok & F.col("changed")).alias("n_changed"),
        F.count_if(ok & ~F.col("changed")).alias("n_unchanged"),
        F.avg(F.when(ok, F.col("overlap"))).alias("mean_overlap"),
        F.coalesce(F.bool_and(F.when(ok, F.coalesce(F.col("reversal_version") == 1, F.lit(False)) & F.col("reversal").isNotNull())), F.lit(True)).alias("consistent"),
        F.count_if(ok & F.col("reversal")).alias("n_reversals"),
    )
    when = lambda cond, c: F.when(F.col(cond), F.col(c))
    return sums.select(
        "run_id",
        "applied",
        "failed",
        when("valid", "n_changed").alias("changed"),
        when("valid", "n_unchanged").alias("unchanged"),
        F.when(F.col("applied") > 0, when("valid", "mean_overlap")).alias("overlap"),
        when("consistent", "n_reversals").alias("reversals"),
    )


def failed_runs(planned: DataFrame, done: DataFrame, counters: list[str], evidence: list[str]) -> DataFrame:
    """Every planned run: with its results, or as failed with 0 in ``counters`` and null in ``evidence``."""
    out = planned.join(done.withColumn("_ran", F.lit(True)), "run_id", "left")
    success = F.coalesce("success", F.lit(False))
    return out.select(*planned.columns, success.alias("success"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counters), *evidence, F.col("_ran").isNull().alias("failed"))


#: Values that one row may list when a percentile is read off, and the bins of a round before that.
MOST_LISTED, BINS = 100_000, 1024


def exact_percentiles(rows: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, share, result): exact percentiles of ``value``, between ranks in proportion; nulls are left out.

    A group of any size is never sorted or held.  The ranks asked for are closed in on: a round counts the values between the bounds of each rank in
    ``BINS`` bins and keeps the bin that holds the rank, with the least and greatest value in it, until these are equal or the bin has
    ``MOST_LISTED`` values at most, which are then listed.
    """
    rows = rows.where(F.col("value").isNotNull()).select(*by, F.col("value").cast("double").alias("value"))
    whole = stored(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "groups")
    asked = whole.select(*by, "n", F.explode(F.array(*(F.lit(p) for p in shares))).alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p * (F.col("n") - 1)), F.ceil(p * (F.col("n") - 1))) for p in shares))))
    bounds = stored(whole.select(*by, "low", "high", "n", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("rank")), "ranks")
    settled = (F.col("low") == F.col("high")) | (F.col("n") <= MOST_LISTED)
    while not bounds.where(~settled).isEmpty():
        met = rows.join(bounds.where(~settled), by).where(F.col("value").between(F.col("low"), F.col("high")))
        # halves first, so that the width of a range of doubles is finite
        share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        binned = met.groupBy(*by, "rank", "below", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        closer = binned.withColumn("below", F.col("below") + before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        columns = [*by, "low", "high", "n", "below", "rank"]
        bounds = stored(bounds.where(settled).select(columns).unionByName(closer.select(columns)), "ranks")
    few = rows.join(bounds.where("low < high"), by).where(F.col("value").between(F.col("low"), F.col("high")))
    read_off = few.groupBy(*by, "rank", "below").agg(F.sort_array(F.collect_list("value")).alias("v")).select(*by, "rank", F.get("v", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    values = stored(bounds.where("low = high").select(*by, "rank", F.col("low").alias("value")).unionByName(read_off), "values")
    lower, upper = (values.select(*by, F.col("rank").alias(f"{n}_rank"), F.col("value").alias(n)) for n in ("lower", "upper"))
    out = asked.withColumns({"lower_rank": F.floor("at"), "upper_rank": F.ceil("at")}).join(lower, [*by, "lower_rank"]).join(upper, [*by, "upper_rank"])
    return out.select(*by, "share", (F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("at") - F.col("lower_rank"))).alias("result"))


def aggregate(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per scenario and strategy: runs, successes, rate, and of each metric mean, p50, p95, min and max.

    Travel, length and exposure count successful runs only.  Nulls are left out; without a value all are null.  Percentiles are exact: those of
    groups of up to ``MOST_LISTED`` runs in one pass, else by ``exact_percentiles``.
    """
    by = ["scenario_id", "strategy_id"]
    counted = {m: (F.when(F.col("success"), F.col(m)) if m in OF_SUCCESS else F.col(m)).cast("double") for m in metrics}
    out = [F.count("*").alias("runs"), F.count_if(F.col("success")).alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate")]
    largest = runs.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shares = {"p50": 0.5, "p95": 0.95}
    for m, c in counted.items():
        listed = [F.percentile(c, p).alias(f"{m}_{n}") for n, p in shares.items()] if largest <= MOST_LISTED else []
        out += [F.avg(c).alias(f"{m}_mean"), *listed, F.min(c).alias(f"{m}_min"), F.max(c).alias(f"{m}_max")]
    found = runs.groupBy(*by).agg(*out)
    if largest <= MOST_LISTED:
        return found
    long = runs.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in counted.items()))).alias("x")).select(*by, "x.*")
    exact = exact_percentiles(long, [*by, "metric"], list(shares.values()))
    wide = exact.groupBy(*by).agg(*(F.max(F.when((F.col("metric") == m) & (F.col("share") == p), F.col("result"))).alias(f"{m}_{n}") for m in metrics for n, p in shares.items()))
    order = [*by, "runs", "successes", "success_rate", *(f"{m}_{n}" for m in metrics for n in ("mean", "p50", "p95", "min", "max"))]
    wide = wide.select(*(F.col(c).alias(f"_{c}") if c in by else c for c in wide.columns))
    return found.join(wide, [found[c].eqNullSafe(wide[f"_{c}"]) for c in by], "left").select(order)


def request_counters(requests: DataFrame) -> DataFrame:
    """Per run: attempts, rejections (status 4xx), other failures, fallbacks, and requests that change the route or don't.

    ``requests`` has (run_id, status, fallback, candidate_edges, remaining_edges); the change is known if both lists have edges.
    """
    status = F.col("status")
    both = (F.size("candidate_edges") > 0) & (F.size("remaining_edges") > 0)
    same = F.col("candidate_edges") == F.col("remaining_edges")
    return requests.groupBy("run_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(status.between(400, 499)).alias("rejections"),
        F.count_if((status >= 500) | status.isNull()).alias("failures"),
        F.count_if(F.col("fallback")).alias("fallbacks"),
        F.count_if(both & ~same).alias("change_requests"),
        F.count_if(both & same).alias("unchanged_requests"),
    )


def progress_matrix(jobs: DataFrame) -> DataFrame:
    """Progress by cell: ``jobs`` (job_id, scenario_id, strategy_id, cell, repetitions, completed) with done, percent.

    Runs of a job go cell by cell in the order of ``cell``.
    """
    before = F.coalesce(F.sum("repetitions").over(Window.partitionBy("job_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = F.least(F.greatest(F.col("completed") - before, F.lit(0)), F.col("repetitions"))
    return jobs.withColumn("done", done).withColumn("percent", F.col("done") * 100.0 / F.col("repetitions"))


def trace_events(traces: DataFrame, thread: Column | None = None, node: str | None = None) -> DataFrame:
    """The last write of each (thread_id, checkpoint_step, task_id), in order; ``written`` orders the writes."""
    if thread is not None:
        traces = traces.where(F.col("thread_id") == thread)
    if node is not None:
        traces = traces.where(F.col("node") == node)
    key = ["thread_id", "checkpoint_step", "task_id"]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("written")))
    return traces.withColumn("_k", last).where("_k = 1").drop("_k").orderBy(*key)


def decision_outcomes(decisions: DataFrame) -> DataFrame:
    """Per run and status: decisions, fallbacks, and latency percentiles; latency is resolved minus opened (ms)."""
    latency = (F.col("resolved_ms") - F.col("opened_ms")).cast("double")
    return decisions.groupBy("run_id", "status").agg(
        F.count("*").alias("decisions"), F.count_if(F.col("fallback")).alias("fallbacks"), F.percentile(latency, 0.5).alias("latency_p50_ms"), F.percentile(latency, 0.95).alias("latency_p95_ms")
    )


def revisions(source: Column, scenario: Column) -> list[Column]:
    """SHA-256 of the strategy source and of the scenario as JSON; null stays null."""
    return [F.sha2(source, 256).alias("strategy_revision"), F.sha2(scenario, 256).alias("scenario_revision")]
