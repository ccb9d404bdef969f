"""Baseline indicators of a frozen roster: counts and shares per source, funding states and
quantiles, deadlines, execution coverage, quality ratios, and resampled intervals.

Counts are exact and every denominator is named.  A ratio without a denominator is null, and
``unknown``, ``not_stated`` and a missing funding row stay three states.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callboard.operators.quantiles import quantiles
from callboard.schemas import MISSING, NUMERIC_KINDS

QUARTILES = (0.25, 0.5, 0.75)
RESAMPLES = 2000
LEAST_FOR_INTERVAL = 10
#: Numbers that one block of resamples draws, and the resamples that it has at least.
BLOCK_DRAWS = 1 << 30
LEAST_OF_BLOCK = 32
#: Outputs drawn at once, few enough to stay in a core's cache; standard deviations that a resample's quantile may lie off.
CHUNK = 1 << 15
DEVIATIONS = 6.0


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def source_shares(sources: DataFrame, programs: DataFrame) -> DataFrame:
    """Count of programs and share of all for every configured source, 0 included."""
    counts = programs.groupBy("source_key").agg(F.count_distinct("program_id").alias("n"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sources.select("source_key").join(counts, "source_key", "left").select("source_key", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("total", F.sum("n").over(whole)).withColumn("share", ratio(F.col("n"), F.col("total")))


def repeated_programs(programs: DataFrame) -> DataFrame:
    """(program_id, n) of ids that occur more than once; a roster must give none."""
    return programs.groupBy("program_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def source_summary(sources: DataFrame, programs: DataFrame, value: str = "funding", digits: int = 2) -> DataFrame:
    """``source_shares`` and the exact quartiles of a value, over a roster of distinct ids.  No task holds
    a source's amounts (``quantiles``)."""
    counts = programs.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    q = quantiles(programs, ["source_key"], value, QUARTILES).withColumnRenamed("n", "n_numeric")
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sources.select("source_key").join(counts, "source_key", "left").join(q, "source_key", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("total", F.sum("n").over(whole))
    measured = F.when(F.col("n") > 0, F.coalesce("n_numeric", F.lit(0)))
    return rows.select("source_key", "n", ratio(F.col("n"), F.col("total")).alias("share"), measured.alias("n_numeric"), *(_half_even(F.col("q")[k], digits).alias(name) for k, name in enumerate(("q25", "median", "q75"))))


def _half_even(x: Column, digits: int) -> Column:
    """Rounded half-even, after binary noise is rounded away, so that a tie in decimals is one."""
    return F.bround(F.round(x, 6).cast("decimal(24,6)"), digits).cast("double")


def funding_states(programs: DataFrame) -> DataFrame:
    """Programs in each funding state, its share, and whether the state has a number or a record."""
    state = F.coalesce("value_kind", F.lit(MISSING))
    counts = programs.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        "state", "n", ratio(F.col("n"), F.sum("n").over(whole)).alias("share"), F.col("state").isin(*NUMERIC_KINDS).alias("is_numeric"), (F.col("state") != MISSING).alias("has_record")
    )


def funding_measures(programs: DataFrame) -> DataFrame:
    """(currency_code, value_kind, measure, amount); a range gives two rows."""
    measures = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"{m}_amount").alias("amount")) for m in ("exact", "min", "max"))))
    return programs.where(F.col("value_kind").isin(*NUMERIC_KINDS)).select("program_id", "currency_code", "value_kind", measures.alias("x")).select("program_id", "currency_code", "value_kind", "x.*").where("amount is not null")


def quartiles(df: DataFrame, keys: list[str], value: str, digits: int = 2) -> DataFrame:
    """Linear-interpolation quartiles per group, rounded half-even."""
    got = quantiles(df, keys, value, QUARTILES)
    return got.select(*keys, "n", *(_half_even(F.col("q")[k], digits).alias(name) for k, name in enumerate(("q25", "median", "q75"))))


def deadline_metrics(programs: DataFrame, as_of: Column) -> DataFrame:
    """Presence, upcoming and overdue counts and the quartiles of days to deadlines that are not
    past; a deadline on the day itself is upcoming."""
    days = F.date_diff(F.col("deadline_on"), as_of)
    upcoming = F.col("deadline_on") >= as_of
    got = programs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("deadline_on").alias("present"),
        F.count_if(upcoming).alias("upcoming"),
        F.count_if(F.col("deadline_on") < as_of).alias("overdue"),
        F.percentile(F.when(upcoming, days).cast("double"), F.array(*map(F.lit, QUARTILES))).alias("q"),
    )
    return got.select(
        "total", "present", "upcoming", "overdue", ratio(F.col("present"), F.col("total")).alias("presence_share"), ratio(F.col("upcoming"), F.col("total")).alias("upcoming_share"),
        *(F.col("q")[k].alias(f"days_{name}") for k, name in enumerate(("q25", "median", "q75"))),
    )


def twister(seed: int):
    """The generator of ``random.Random(seed)``."""
    import numpy as np

    *key, place = random.Random(seed).getstate()[1]
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": place}}
    return out


def draws(generator, n: int, count: int):
    """``count`` numbers below n: the top bits of 32-bit outputs, those out of range skipped."""
    import numpy as np

    shift, rest, left = 32 - n.bit_length(), np.zeros(0, np.int64), count
    while left > 0:
        drawn = (generator.random_raw(max(1024, min(left, 1 << 22))) >> shift).astype(np.int64)
        rest = drawn[drawn < n][:left]
        left -= len(rest)
        yield rest


def mersenne_draws(seed: int, n: int, count: int):
    """``count`` numbers below n, in the order in which ``random.Random(seed).randrange(n)`` gives
    them."""
    return draws(twister(seed), n, count)


def generator_states(seed: int, n: int, step: int, blocks: int):
    """Where each block of ``step`` numbers below n begins in the order of ``mersenne_draws``:
    (key, place, outputs to skip).  Only counts the numbers, which is the cheap part of drawing."""
    import numpy as np

    generator, shift, seen, block = twister(seed), 32 - n.bit_length(), 0, 0
    while True:
        state = generator.state["state"]
        begin = (state["key"].astype("<u4").tobytes(), int(state["pos"]))
        if not block:
            yield (*begin, 0)
            block = 1
        if block >= blocks:
            return
        fits = generator.random_raw(1 << 18) < n << shift
        whole = int(np.count_nonzero(fits))
        if block * step < seen + whole:
            at = np.flatnonzero(fits)
            while block < blocks and block * step < seen + whole:
                yield (*begin, int(at[block * step - seen]))
                block += 1
        seen += whole


def resampled_quantiles(begin, values, p: float, times: int):
    """The quantile ``p`` of each of ``times`` resamples of ``values``, as ``np.quantile`` gives it, from the numbers of the
    generator that ``begin`` makes.

    A resample's quantile lies within a few deviations of that of all values.  So draws are counted that fall below
    these, and only those among them are kept and sorted; if one does lie farther off, all is drawn again for twice the
    deviations.
    """
    import numpy as np

    n = len(values)
    shift, low = 32 - n.bit_length(), int((n - 1) * p)
    order = np.argsort(values, kind="stable")
    ranks = np.empty(n, np.int32)
    ranks[order] = np.arange(n, dtype=np.int32)
    below, near, above, no_draw = range(4)
    deviations = DEVIATIONS
    while True:
        width = deviations * (n * p * (1 - p)) ** 0.5 + 2
        first, last = max(0, int(n * p - width)), min(n, int(n * p + width) + 1)
        kinds = np.full(1 << n.bit_length(), no_draw, np.uint8)
        kinds[order[:first]], kinds[order[first:last]], kinds[order[last:]] = below, near, above
        generator, done, lower = begin(), 0, np.zeros(times, np.int64)
        owners, found = [], []
        while done < n * times:
            drawn = (generator.random_raw(CHUNK) >> shift).view(np.int64)
            kind = kinds.take(drawn, mode="clip")
            fits, owner = int(np.count_nonzero(kind < no_draw)), done // n
            if n < CHUNK:  # of many resamples
                at = np.flatnonzero(kind < no_draw)[: n * times - done]
                kind, each = kind[at], ((done + np.arange(len(at))) // n).astype(np.int32)
                lower += np.bincount(each[kind == below], minlength=times)
                here = np.flatnonzero(kind == near)
                owners.append(each[here])
                found.append(ranks[drawn[at[here]]])
            else:  # of one or two
                rest = (owner + 1) * n - done
                end = CHUNK if fits < rest else int(np.flatnonzero(kind < no_draw)[rest - 1]) + 1
                for who, part in ((owner, slice(end)), (owner + 1, slice(end, CHUNK))):
                    if who < times:
                        lower[who] += np.count_nonzero(kind[part] == below)
                        kept = ranks[drawn[part][np.flatnonzero(kind[part] == near)]]
                        owners.append(np.full(len(kept), who, np.int32))
                        found.append(kept)
            done += fits
        owner, rank = np.concatenate(owners), np.concatenate(found)
        counts, place = np.bincount(owner, minlength=times), low - lower
        if ((place >= 0) & (place + 1 < counts)).all():
            break
        deviations *= 2
    rank = rank[np.lexsort((rank, owner))]
    place += np.cumsum(counts) - counts
    ends = values[order[np.stack([rank[place], rank[place + 1]])]]
    return np.quantile(ends, (n - 1) * p - low, axis=0)


def bootstrap_intervals(df: DataFrame, metric: str, value: str, order: str, seed: str, resamples: int = RESAMPLES) -> DataFrame:
    """A percentile-bootstrap interval (0.025, 0.975) of each quartile of every metric.

    ``metric`` names the column of metric keys.  Each quartile has its own generator, seeded by
    the SHA-256 of ``seed`` and its full key, over values in the order of ``order``; reruns agree.
    The resamples of a large metric are dealt out in blocks of about ``BLOCK_DRAWS`` numbers, each
    with the generator's state at its begin, so the numbers are those of one generator.  A task
    holds a metric's values as one array.  A metric under ten values gets ``too_few``.
    """
    sized = df.groupBy(metric).agg(F.count(value).alias("n"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("Q25", "median", "Q75")

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(["_order", "_value"])["_value"].to_numpy("<f8")
        return pd.DataFrame([(key[0], values.tobytes())], columns=["_metric", "_values"])

    def begun(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for key, n, quartile in pdf.itertuples(index=False):
                number = int(hashlib.sha256(f"{seed}|{key}.{names[quartile]}".encode()).hexdigest(), 16)
                each = min(resamples, max(LEAST_OF_BLOCK, BLOCK_DRAWS // n))
                states = generator_states(number, n, each * n, -(-resamples // each))
                rows = [(key, n, quartile, k, min(each, resamples - k * each), *state) for k, state in enumerate(states)]
                yield pd.DataFrame(rows, columns=["_metric", "n", "quartile", "block", "times", "key", "place", "skip"])

    def resample(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in parts:
            for r in pdf.itertuples(index=False):
                values, n, p = np.frombuffer(r.values_of, "<f8"), int(r.n), QUARTILES[r.quartile]

                def begin(r=r):
                    generator = np.random.MT19937()
                    generator.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(r.key, "<u4").astype(np.uint32), "pos": int(r.place)}}
                    generator.random_raw(int(r.skip), output=False)
                    return generator

                estimates = resampled_quantiles(begin, values, p, int(r.times))
                exact = float(np.quantile(values, p)) if r.block == 0 else None
                yield pd.DataFrame([(r.metric, n, r.quartile, exact, estimates)], columns=["metric", "n", "quartile", "estimate", "estimates"])

    def interval(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        low, high = np.quantile(np.concatenate(pdf["estimates"].tolist()), [0.025, 0.975])
        return pd.DataFrame([(f"{key[0]}.{names[key[1]]}", pdf["n"].iloc[0], pdf["estimate"].max(), low, high)], columns=["metric_key", "n", "estimate", "low", "high"])

    fit = sized.where(F.col("n") >= LEAST_FOR_INTERVAL)
    asked = fit.select(F.col(metric).alias("_metric"), "n", F.explode(F.array(*map(F.lit, range(len(QUARTILES))))).alias("quartile")).repartition(tasks, "_metric", "quartile")
    blocks = asked.mapInPandas(begun, "_metric string, n long, quartile int, block int, times int, key binary, place int, skip int")
    held = df.where(F.col(value).isNotNull()).select(F.col(metric).alias("_metric"), F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"))
    arrays = held.groupBy("_metric").applyInPandas(packed, "_metric string, _values binary")
    # Few bytes of blocks stand for much work, so their number of partitions is fixed, and they are many, to even out.
    dealt = blocks.join(arrays, "_metric").withColumnsRenamed({"_metric": "metric", "_values": "values_of"}).repartition(4 * tasks, "metric", "quartile", "block")
    parts = dealt.mapInPandas(resample, "metric string, n long, quartile int, estimate double, estimates array<double>")
    got = parts.groupBy("metric", "quartile").applyInPandas(interval, "metric_key string, n long, estimate double, low double, high double").withColumn("status", F.lit("computed"))
    none = F.lit(None).cast("double")
    rest = sized.where(F.col("n") < LEAST_FOR_INTERVAL).select(F.col(metric).alias("metric_key"), "n", none.alias("estimate"), none.alias("low"), none.alias("high"), F.lit("too_few").alias("status"))
    return got.unionByName(rest)


def execution_coverage(sources: DataFrame, executions: DataFrame) -> DataFrame:
    """For every source: its runs and whether one succeeded that was not a dry run."""
    done = executions.groupBy("source_key").agg(F.count(F.lit(1)).alias("executions"), F.max(F.when((F.col("status") == "succeeded") & ~F.col("dry_run"), 1).otherwise(0)).alias("covered"))
    return sources.select("source_key").join(done, "source_key", "left").select("source_key", F.coalesce("executions", F.lit(0)).alias("executions"), F.coalesce("covered", F.lit(0)).alias("covered"))


def exclusion_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first failing rule's name, or null; rules are (reason, fails)."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for reason, fails in rules:
        out = out.when(fails, F.lit(reason))
    return out


def quality_ratios(programs: DataFrame, cases: DataFrame, executions: DataFrame, sources: DataFrame, as_of: Column, window_days: int) -> DataFrame:
    """Five documented ratios: freshness, completeness, conflicts, source coverage, review status."""
    since = as_of.cast("timestamp") - F.make_dt_interval(F.lit(window_days))
    complete = F.col("title_present") & F.col("source_url_present") & F.col("observed_at").isNotNull() & F.col("deadline_on").isNotNull() & F.col("value_kind").isNotNull()
    p = programs.agg(F.count(F.lit(1)).alias("all"), F.count_if((F.col("observed_at") >= since) & (F.col("observed_at") <= as_of.cast("timestamp"))).alias("fresh"), F.count_if(complete).alias("complete"))
    pending = F.col("status").isin("open", "needs_clarification")
    c = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(pending).alias("pending"), F.count_if(pending & (F.col("case_type") == "canonical")).alias("pending_canonical"),
        F.count_if(pending & (F.col("case_type") == "canonical") & F.col("has_explicit_conflict")).alias("conflicts"),
    )
    ok = (F.col("status") == "succeeded") & ~F.col("dry_run") & (F.col("finished_at") >= since) & (F.col("finished_at") <= as_of.cast("timestamp"))
    e = executions.join(sources.select("source_key"), "source_key", "left_semi").agg(F.count_distinct(F.when(ok, F.col("source_key"))).alias("covered"))
    s = sources.agg(F.count_distinct("source_key").alias("sources"))
    one = p.crossJoin(c).crossJoin(e).crossJoin(s)  # one row each
    rows = (("freshness", "fresh", "all"), ("completeness", "complete", "all"), ("conflict", "conflicts", "pending_canonical"), ("source_coverage", "covered", "sources"), ("review_status", "pending", "cases"))
    metric = F.explode(F.array(*(F.struct(F.lit(k).alias("metric_key"), F.col(n).alias("numerator"), F.col(d).alias("denominator")) for k, n, d in rows)))
    return one.select(metric.alias("x")).select("x.*").withColumn("value", ratio(F.col("numerator"), F.col("denominator")))


COHORT = ("source_scope", "calculation_version", "freshness_window_days", "registry_fingerprint", "data_class")


def compare_counts(snapshots: DataFrame) -> DataFrame:
    """Each pair of neighbouring snapshots by time: the difference of counts, or why it is refused."""
    order = Window.partitionBy("series").orderBy("as_of", "snapshot_id")
    rows = snapshots.withColumn("previous", F.lag(F.struct(*COHORT, "as_of", "programs", "snapshot_id")).over(order)).where("previous is not null")
    reasons = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"previous.{c}")), F.lit(c)) for c in COHORT), F.when(F.col("as_of") <= F.col("previous.as_of"), F.lit("not_later"))))
    return rows.select("series", "snapshot_id", F.col("previous.snapshot_id").alias("previous_id"), reasons.alias("reasons"), F.when(F.size(reasons) == 0, F.col("programs") - F.col("previous.programs")).alias("difference"))
