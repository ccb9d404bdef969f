"""Folding publications into records: groups by links, merged fields, inventories, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callboard.functions.normalize import normalized_ascii
from callboard.operators.graph import connected_components


def groups(publications: DataFrame, links: DataFrame) -> DataFrame:
    """(publication_id, group_id): publications that explicit links join; the id is the smallest."""
    joined = connected_components(links).select(F.col("node").alias("publication_id"), "component")
    got = publications.select("publication_id").join(joined, "publication_id", "left")
    return got.select("publication_id", F.coalesce("component", "publication_id").alias("group_id"))


def identity_groups(publications: DataFrame, links: DataFrame) -> DataFrame:
    """(publication_id, group_id, warnings): publications grouped by what they are about.

    publications: publication_id, identity (null where none can be told), kind; links: publication_id, target_id, explicit
    links between publications.  A link to publications of one other identity says that both identities are one; a
    publication that links to several would join groups that are otherwise apart, so it joins none and says so.  A
    group's id is its least identity.  A publication without an identity goes with the one it links to; without that,
    or of kind ``ignore``, it has no group.
    """
    named = publications.select(F.col("publication_id").alias("target_id"), F.col("identity").alias("claimed")).where("claimed is not null")
    claims = links.join(named, "target_id").groupBy("publication_id").agg(F.count_distinct("claimed").alias("claims"), F.min("claimed").alias("claimed"))
    rows = publications.join(claims, "publication_id", "left").withColumn("one", F.when(F.col("claims") == 1, F.col("claimed")))
    joined = rows.where("identity is not null and one is not null and identity <> one").select(F.col("identity").alias("src"), F.col("one").alias("dst")).distinct()
    classes = connected_components(joined).select(F.col("node").alias("about"), "component")
    counted = F.col("kind") != "ignore"
    warnings = F.array_compact(F.array(
        F.when(F.col("claims") > 1, "related_publication_ambiguous"), F.when(F.col("one") != F.col("identity"), "related_publication_identity_override"),
        F.when(counted & F.coalesce("identity", "one").isNull(), "publication_identity_missing"),
    ))
    got = rows.withColumn("about", F.when(counted, F.coalesce("identity", "one"))).join(classes, "about", "left")
    return got.select("publication_id", F.coalesce("component", "about").alias("group_id"), warnings.alias("warnings"))


#: What a portal's short names leave out or shorten.
YEAR, QUEUE, SHORT_MEDICAL = r"(?U)\b20\d{2}\b", r"(?iuU)\bочеред(?:ь|и)\s*(?:№\s*)?(\d+)\b", r"(?U)\bмед (?=\d|$)"


def name_key(name: Column) -> Column:
    """A contest's name as both sides write it: no year, no queue, signs as blanks; null if nothing is left."""
    plain = normalized_ascii(F.regexp_replace(F.regexp_replace(name, QUEUE, " "), YEAR, " "))
    return F.regexp_replace(plain, SHORT_MEDICAL, "медизделия ")


def matched_names(portal: DataFrame, groups: DataFrame, least: float = 1.0) -> DataFrame:
    """(portal_id, group_id, similarity, outcome): portal rows and groups whose names are each other's best.

    portal: portal_id, name; groups: group_id, name (several rows for several names).  Names are compared by the words of
    their keys, shared ones over all; at least ``least`` of them, and queues, where both have one, must agree.  Only names
    that share one of their rarest words are compared, since names that share enough do.  ``matched`` pairs are the one
    best of both; a best that is tied on either side is ``ambiguous`` and lists all that tie, and others are left out.

    Equal names count as one name until the end, so a name that many rows share costs a row for each.  Names grow with
    both sides, and their files are much smaller than they, so no join may send one side to the driver.
    """
    sides = {}
    for side, rows, key in (("p", portal, "portal_id"), ("g", groups, "group_id")):
        held = rows.select(key, name_key(F.col("name")).alias("key"), F.regexp_extract("name", QUEUE, 1).alias("queue")).where("key is not null").distinct()
        sides[side] = held.checkpoint()
    names = {s: rows.select("key", "queue").distinct().withColumn("words", F.array_distinct(F.split("key", " "))) for s, rows in sides.items()}
    every = names["p"].select("words").unionByName(names["g"].select("words"))
    often = every.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("often"))

    def rare(rows: DataFrame, side: str) -> DataFrame:
        """(word, key, queue, words) for the words of a name that a similar name must share one of."""
        told = rows.select("key", "queue", "words", F.explode("words").alias("word")).join(often.hint("merge"), "word")
        order = Window.partitionBy("key", "queue").orderBy("often", "word")
        first = F.size("words") - F.ceil(F.size("words") * F.lit(least) - 1e-9) + 1
        return told.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first).select("word", *(F.col(c).alias(f"{side}_{c}") for c in ("key", "queue", "words")))

    pairs = rare(names["p"], "p").join(rare(names["g"], "g").hint("merge"), "word").select("p_key", "p_queue", "g_key", "g_queue", "p_words", "g_words").distinct()
    shared = F.size(F.array_intersect("p_words", "g_words"))
    near = pairs.withColumn("similarity", shared / (F.size("p_words") + F.size("g_words") - shared)).where(F.col("similarity") >= least)
    near = near.where((F.col("p_queue") == "") | (F.col("g_queue") == "") | (F.col("p_queue") == F.col("g_queue"))).select("p_key", "p_queue", "g_key", "g_queue", "similarity")
    ids = near
    for side, key in (("p", "portal_id"), ("g", "group_id")):
        named = sides[side].select(key, F.col("key").alias(f"{side}_key"), F.col("queue").alias(f"{side}_queue"))
        ids = ids.join(named.hint("merge"), [f"{side}_key", f"{side}_queue"])
    ids = ids.groupBy("portal_id", "group_id").agg(F.max("similarity").alias("similarity")).checkpoint()
    found = ids
    for key, best, ties in (("portal_id", "p_best", "p_ties"), ("group_id", "g_best", "g_ties")):
        counts = ids.groupBy(key, "similarity").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy(key).agg(F.max("similarity").alias(best), F.max_by("n", "similarity").alias(ties))
        found = found.join(top.hint("merge"), key)
    mutual = found.where((F.col("similarity") == F.col("p_best")) & (F.col("similarity") == F.col("g_best")))
    return mutual.select("portal_id", "group_id", "similarity", F.when((F.col("p_ties") == 1) & (F.col("g_ties") == 1), "matched").otherwise("ambiguous").alias("outcome"))


def folded(publications: DataFrame) -> DataFrame:
    """One record per group_id from its publications in order of time: first title, latest funding
    outside results, urls in order of first sight, status by the strongest evidence.

    publications: group_id, publication_id, published_at, kind, title, funding, urls (array),
    end_on.
    """
    order = F.struct("published_at", "publication_id")
    told = F.when((F.col("kind") != "result") & F.col("funding").isNotNull(), order)
    seen = publications.select("group_id", "published_at", "publication_id", F.posexplode("urls").alias("place", "url")).groupBy("group_id", "url").agg(F.min(F.struct("published_at", "publication_id", "place")).alias("first"))
    urls = seen.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "url"))), lambda x: x["url"]).alias("urls"))  # each url of a group once
    rows = publications.groupBy("group_id").agg(
        F.min_by("title", order).alias("title"), F.max_by("funding", told).alias("funding"), F.max("end_on").alias("end_on"),
        F.when(F.bool_or(F.col("kind") == "result"), "completed").when(F.bool_or(F.col("kind").isin("launch", "extension")), "open").otherwise("unknown").alias("evidence"), F.count(F.lit(1)).alias("publications"),
    )
    return rows.join(urls, "group_id", "left").select("group_id", "title", "funding", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"), "end_on", "evidence", "publications")


def lifecycle(evidence: Column, start_on: Column, end_on: Column, as_of: Column) -> Column:
    """completed by a result or a past end, upcoming before the start, open inside, else unknown."""
    return F.when(evidence == "completed", "completed").when(F.coalesce(end_on < as_of, F.lit(False)), "completed").when(F.coalesce(start_on > as_of, F.lit(False)), "upcoming").when((evidence == "open") | (start_on <= as_of), "open").otherwise("unknown")


def enriched(records: DataFrame, portal: DataFrame) -> DataFrame:
    """Records with the portal's deadline where it has one (a difference is a warning); portal rows
    that meet no record become records.  records: url_key, title, end_on; portal: the same."""
    p = portal.select("url_key", F.col("title").alias("p_title"), F.col("end_on").alias("p_end_on"), F.lit(True).alias("in_portal"))
    both = records.join(p, "url_key", "left")
    warning = F.when(F.col("p_end_on").isNotNull() & F.col("end_on").isNotNull() & (F.col("p_end_on") != F.col("end_on")), "deadline_differs")
    kept = both.select("url_key", "title", F.coalesce("p_end_on", "end_on").alias("end_on"), warning.alias("warning"), F.coalesce("in_portal", F.lit(False)).alias("in_portal"))
    alone = portal.join(records.select("url_key"), "url_key", "left_anti").select("url_key", "title", "end_on", F.lit("portal_only").alias("warning"), F.lit(True).alias("in_portal"))
    return kept.unionByName(alone)


def attached(records: DataFrame, artifacts: DataFrame, budget: int) -> DataFrame:
    """(record_id, url, status): each artifact url of each record is captured, deferred (within the
    first ``budget`` urls but not captured) or a reference only."""
    rows = records.select("record_id", F.posexplode("artifact_urls").alias("position", "url"))
    got = rows.join(artifacts.select("url", "sha256").dropDuplicates(["url"]), "url", "left")
    return got.select("record_id", "url", F.when(F.col("sha256").isNotNull(), "captured").when(F.col("position") < budget, "deferred").otherwise("reference_only").alias("status"), "sha256")


def link_inventory(links: DataFrame) -> DataFrame:
    """One row per semantic key: an https url before an http one, all contexts.  links: key, url,
    context."""
    rank = F.struct(F.col("url").startswith("https://"), -F.length("url"), "url")
    return links.groupBy("key").agg(F.max_by("url", rank).alias("url"), F.array_sort(F.collect_set("context")).alias("contexts"), F.count(F.lit(1)).alias("mentions"))


def application_window(events: DataFrame) -> DataFrame:
    """(record_id, start_on, end_on, outcome) from application events: one distinct range is the
    window, several that follow each other are cycles (the last counts), others conflict."""
    ranges = events.where("kind = 'application' and end_on is not null").select("record_id", "start_on", "end_on").distinct()
    before = F.lag("end_on").over(Window.partitionBy("record_id").orderBy("end_on", "start_on"))
    marked = ranges.withColumn("overlaps", F.coalesce(F.col("start_on") <= before, F.lit(False)) | (before.isNotNull() & F.col("start_on").isNull()))
    got = marked.groupBy("record_id").agg(F.max_by("start_on", "end_on").alias("start_on"), F.max("end_on").alias("end_on"), F.count(F.lit(1)).alias("n"), F.bool_or("overlaps").alias("overlaps"))
    clash = F.col("overlaps") & (F.col("n") > 1)
    return got.select("record_id", F.when(~clash, F.col("start_on")).alias("start_on"), F.when(~clash, F.col("end_on")).alias("end_on"), F.when(F.col("n") == 1, "single").when(clash, "conflict").otherwise("multiple_cycles").alias("outcome"))


def reconciled(top: Column, stages: Column) -> tuple[Column, Column]:
    """(date, warning) from two places of a page: the one that is there, or both if they agree."""
    return F.when(top.isNull() | stages.isNull() | (top == stages), F.coalesce(top, stages)), F.when(top != stages, F.lit("dates_differ"))


def propagated(resources: DataFrame) -> DataFrame:
    """Resources with ``is_result``: one that leads to winners makes its whole group results."""
    return resources.withColumn("is_result", F.max(F.col("leads_to_winners").cast("int")).over(Window.partitionBy("program_id", "group_key")) == 1)


def grouped_geographies(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """(program_id, kind, names): names by alias (slug -> name, kind), the last alias of a slug
    counting; a slug without an alias is ``other``.  aliases: slug, name, kind, position."""
    known = aliases.groupBy("slug").agg(F.max_by(F.struct("name", "kind"), "position").alias("a"))
    rows = links.join(known, "slug", "left").select("program_id", F.coalesce("a.kind", F.lit("other")).alias("kind"), F.coalesce("a.name", "slug").alias("name"))
    return rows.groupBy("program_id", "kind").agg(F.array_sort(F.collect_set("name")).alias("names"))
