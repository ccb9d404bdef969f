"""Entity resolution and url routing by equi joins.

Every match level is an equality, so candidates meet targets only under equal keys.  Null keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Match levels, the strongest first.
LEVELS = ("exact_external_id", "exact_url", "exact_origin_url", "normalized_fields")
FIELDS = ("title_key", "organizer_key", "deadline_on")
#: Candidates that meet under one key before its targets are dealt out to several tasks.
CANDIDATES_OF_PART = 128


def _digest(*parts: Column) -> Column:
    """128 bits that stand for the parts; null if one of them is."""
    return F.unhex(F.md5(F.concat(*(F.md5(p.cast("string")) for p in parts))))


def _side(df: DataFrame, n: str) -> DataFrame:
    """A row for each key a record can be met by, none for null keys: level_rank, k, and with the prefix ``n`` id,
    source_id and what else a pair is judged by, all of it digests, as titles may be long."""
    digests = {c: _digest(F.col(c)) for c in ("external_id", "url", *FIELDS)}
    rows = df.select("id", "source_id", *(d.alias(c) for c, d in digests.items()), F.array_distinct(F.array_compact(F.transform(F.coalesce("origin_urls", F.array().cast("array<string>")), lambda u: _digest(u)))).alias("origins"))
    urls = F.array_distinct(F.array_compact(F.array_append("origins", F.col("url"))))
    own = ((0, _digest(F.col("source_id"), F.hex("external_id"))), (1, _digest(F.col("source_id"), F.hex("url"))), (3, _digest(*(F.hex(f) for f in FIELDS))))
    keys = F.array(*(F.struct(F.lit(rank).alias("level_rank"), k.alias("k")) for rank, k in own))
    rows = rows.select("*", urls.alias("urls"), F.explode(F.concat(F.filter(keys, lambda x: x["k"].isNotNull()), F.transform(urls, lambda u: F.struct(F.lit(2).alias("level_rank"), u.alias("k"))))).alias("x"))
    told = (F.col(c).alias(f"{n}_{c}") for c in ("id", "source_id", "external_id", "url", "origins", "urls", *FIELDS))
    return rows.select("x.level_rank", "x.k", *told)


def matches(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(candidate_id, target_id, level_rank, level, conflicts): the strongest level of each pair.

    Both sides: id (distinct), source_id, external_id, url, origin_urls (array), title_key, organizer_key,
    deadline_on.  Ids and urls must be of one source; origin urls of two different ones, in either
    direction; the normalised fields must all be there, of any source.  All levels meet in one join, on the
    level and its key.  A pair that meets several times is told where it is met first: by its strongest level, and
    there by its least url; so pairs are neither gathered nor sorted.  Where many candidates meet under a key, its targets
    are dealt out, and each part meets all of them.
    """
    c, t = _side(candidates, "c"), _side(targets, "t")
    key = ["level_rank", "k"]
    parts = F.broadcast(c.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CANDIDATES_OF_PART).select(*key, F.ceil(F.col("n") / CANDIDATES_OF_PART).cast("int").alias("parts")))
    dealt = t.join(parts, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("t_id"), "parts"), F.lit(0)).cast("int")).drop("parts")
    every = c.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    both = lambda x: F.col(f"c_{x}") == F.col(f"t_{x}")
    holds = lambda x: F.coalesce(x, F.lit(False))
    shared = F.filter(F.array_intersect("c_urls", "t_urls"), lambda u: F.array_contains("c_origins", u) | F.array_contains("t_origins", u))
    by_id, by_url = holds(both("source_id") & both("external_id")), holds(both("source_id") & both("url"))
    across = holds(F.col("c_source_id") != F.col("t_source_id"))
    rank = F.col("level_rank")
    first = F.when(rank == 0, True).when(rank == 1, ~by_id).when(rank == 2, across & holds(F.col("k") == F.array_min(shared))).otherwise(~by_id & ~by_url & ~(across & (F.size(shared) > 0)))
    met = every.join(dealt, [*key, "part"]).where((F.col("c_id") != F.col("t_id")) & first)
    differ = F.array_compact(F.array(*(F.when(F.col(f"c_{f}") != F.col(f"t_{f}"), F.lit(f)) for f in FIELDS)))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1)
    return met.select(F.col("c_id").alias("candidate_id"), F.col("t_id").alias("target_id"), "level_rank", level.alias("level"), differ.alias("conflicts"))


def targets(staged: DataFrame, programs: DataFrame) -> DataFrame:
    """Both kinds of records that a candidate may match, with ``target_kind``; columns that one side
    lacks are null there."""
    return staged.withColumn("target_kind", F.lit("staged")).unionByName(programs.withColumn("target_kind", F.lit("program")), allowMissingColumns=True)


def match_classes(records: DataFrame) -> DataFrame:
    """(id, level_rank, level, links, representative): for every record that others match, the
    strongest level, how many records it meets there, and the smallest id among them and itself.

    Columns as in ``matches``; a record of another source is met by an origin url of this one that is
    its url or origin url.  Records are counted by key first, so a title or url that millions share
    costs one row a key and source, never a row a pair.
    """
    r = records.select("id", "source_id", "external_id", "url", "origin_urls", "title_key", "organizer_key", "deadline_on")

    def under(keys: list[str], rank: int) -> DataFrame:
        known = r.select("id", *keys).dropna(subset=keys)
        sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("n > 1")
        return known.join(sizes, keys).select("id", F.lit(rank).alias("level_rank"), (F.col("n") - 1).alias("links"), F.col("low").alias("representative"))

    origins = r.select("id", "source_id", F.explode(F.array_distinct("origin_urls")).alias("u"))
    held = r.select("id", "source_id", F.explode(F.array_distinct(F.array_append(F.coalesce("origin_urls", F.array().cast("array<string>")), F.col("url")))).alias("u")).where("u is not null")
    own = held.groupBy("u", "source_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    every = own.groupBy("u").agg(F.sum("n").alias("all"), F.min("low").alias("low"), F.count(F.lit(1)).alias("sources")).where("sources > 1")
    cross = origins.join(every, "u").join(own.select("u", "source_id", "n"), ["u", "source_id"], "left").withColumn("links", F.col("all") - F.coalesce("n", F.lit(0)))
    cross = cross.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"), F.min("low").alias("representative")).select("id", F.lit(2).alias("level_rank"), "links", "representative")
    found = under(["source_id", "external_id"], 0).unionByName(under(["source_id", "url"], 1)).unionByName(cross).unionByName(under(["title_key", "organizer_key", "deadline_on"], 3))
    best = found.groupBy("id").agg(F.min(F.struct("level_rank", "links", "representative")).alias("b"))
    return best.select("id", "b.level_rank", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("b.level_rank") + 1).alias("level"), "b.links", "b.representative")


def decisions(candidates: DataFrame, observed: DataFrame) -> DataFrame:
    """Per candidate: observations, whether it merges by itself, and its reason codes.

    observed: matches with target_kind, conflicts (array), target_clean, runs_completed.  A merge
    needs one observation only, of an exact level within a source, staged, without conflicts, and
    both sides clean with completed runs.  candidates: id, has_error, has_warning.
    """
    best = observed.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("observations"), F.min("level_rank").alias("best"), F.count_if(F.size("conflicts") > 0).alias("conflicting"), F.count_if(F.col("level_rank") == 2).alias("cross_source"),
        F.bool_and((F.col("level_rank") < 2) & (F.col("target_kind") == "staged") & (F.size("conflicts") == 0) & F.col("target_clean") & F.col("runs_completed")).alias("mergeable"),
    )
    rows = candidates.join(best, candidates["id"] == best["candidate_id"], "left")
    n = F.coalesce("observations", F.lit(0))
    merge = (n == 1) & F.coalesce("mergeable", F.lit(False)) & ~F.col("has_error") & ~F.col("has_warning")
    exact = F.col("best") < 2
    codes = F.array_compact(
        F.array(
            F.when(F.col("has_error"), "quality_error").when(F.col("has_warning"), "quality_warning"),
            F.when(merge, "duplicate").when(exact & (F.col("conflicting") > 0), "exact_identity_conflict").when(F.col("cross_source") > 0, "cross_source_match").when(F.col("best") == 3, "possible_duplicate").when(exact, "exact_review").otherwise("ready"),
            F.when(n > 1, "multiple_candidates"),
        )
    )
    return rows.select("id", n.alias("observations"), merge.alias("auto_merge"), codes.alias("reason_codes"))


def route(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, matched, route, target): one allowing source routes the url, several are ambiguous,
    none goes to a person.

    urls: normalised urls.  rules: source_key, origin (scheme and host), prefix (a path; the url's
    path must equal it or go on with a slash).  A url is expanded to its path's prefixes, which
    makes the lookup an equi join however many rules there are.
    """
    origin = F.regexp_extract("url", r"^(https?://[^/?]*)", 1)
    path = F.regexp_extract("url", r"^https?://[^/?]*([^?]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    asked = urls.select("url").distinct().select("url", origin.alias("origin"), F.explode(heads).alias("prefix"))
    found = asked.join(rules.select("source_key", "origin", F.when(F.col("prefix") == "/", "/").otherwise(F.rtrim("prefix", F.lit("/"))).alias("prefix")).distinct(), ["origin", "prefix"])
    hits = found.groupBy("url").agg(F.count_distinct("source_key").alias("matched"), F.min("source_key").alias("target"))
    n = F.coalesce("matched", F.lit(0))
    return urls.select("url").distinct().join(hits, "url", "left").select("url", n.alias("matched"), F.when(n == 1, "source").when(n > 1, "ambiguous").otherwise("manual").alias("route"), F.when(n == 1, F.col("target")).alias("target"))


def duplicate_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a package with ``is_duplicate``: every valid row with a key that an earlier valid
    row has; invalid rows and null keys are never duplicates.  ``order`` is distinct within a key.
    A key that many rows share is reduced to its first row before it meets them."""
    first = rows.where(F.col("is_valid") & F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    got = rows.join(first, key, "left")
    return got.withColumn("is_duplicate", F.coalesce(F.col("is_valid") & (F.col(order) > F.col("__first")), F.lit(False))).select(*rows.columns, "is_duplicate")


def import_outcomes(rows: DataFrame, history: DataFrame) -> DataFrame:
    """new, updated, unchanged, error or skipped_duplicate for each row of a package.

    rows: source_id, record_key, body_hash, is_valid, is_duplicate; history: the same keys with
    staged_at and body_hash, of which the latest counts.
    """
    latest = history.groupBy("source_id", "record_key").agg(F.max_by("body_hash", "staged_at").alias("known_hash"))
    got = rows.join(latest, ["source_id", "record_key"], "left")
    outcome = F.when(~F.col("is_valid"), "error").when(F.col("is_duplicate"), "skipped_duplicate").when(F.col("known_hash").isNull(), "new").when(F.col("known_hash") == F.col("body_hash"), "unchanged").otherwise("updated")
    return got.withColumn("outcome", outcome)
