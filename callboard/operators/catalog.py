"""Published-only catalogue queries: filters, facets, pages and source lists.

Every function adds to a lazy plan; Catalyst pushes the predicates to the scans.  Many-to-many
labels are reached by semi joins, so totals are never multiplied.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.functions import dictionary, textsearch

SORTS = ("published_at", "updated_at", "deadline_on", "title")
MAX_PAGE = 100


@dataclass(frozen=True)
class CatalogQuery:
    """One request: values in a group are alternatives, groups must all hold."""

    search: str | None = None
    sources: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    themes: tuple[str, ...] = ()
    geographies: tuple[str, ...] = ()
    value_kinds: tuple[str, ...] = ()
    deadline_from: date | None = None
    deadline_to: date | None = None
    districts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    sort: str = "published_at"
    descending: bool = True
    page: int = 1
    page_size: int = 20

    def __post_init__(self):
        if self.deadline_from and self.deadline_to and self.deadline_from > self.deadline_to:
            raise ValueError("deadline_from is after deadline_to")
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}")
        if self.page < 1 or not 1 <= self.page_size <= MAX_PAGE:
            raise ValueError(f"page starts at 1, page_size lies in 1..{MAX_PAGE}")


@dataclass(frozen=True)
class Catalog:
    """Tables of a catalogue; labels are link tables (program_id, slug)."""

    programs: DataFrame
    themes: DataFrame | None = None
    geographies: DataFrame | None = None
    published: Column = field(default_factory=lambda: F.col("publication_status") == "published")

    def filtered(self, q: CatalogQuery) -> DataFrame:
        """Published programs that meet every group of the request."""
        df = self.programs.where(self.published)
        tests = []
        for column, values in (("source_key", q.sources), ("value_kind", q.value_kinds)):
            if values:
                tests.append(F.col(column).isin(*values))
        if q.statuses:
            tests.append(F.coalesce("source_status", F.lit("unknown")).isin(*q.statuses))
        if q.deadline_from:
            tests.append(F.col("deadline_on") >= F.lit(q.deadline_from))
        if q.deadline_to:
            tests.append(F.col("deadline_on") <= F.lit(q.deadline_to))
        if q.search is not None:
            tests.append(F.lower("title").contains(normalized_query(q.search).lower()))
        df = reduce(lambda d, t: d.where(t), tests, df)
        if q.themes:
            df = df.join(self.themes.where(F.col("slug").isin(*q.themes)).select("program_id"), "program_id", "left_semi")
        if q.geographies:
            df = df.join(self.geographies.where(in_geographies(q.geographies, dict(q.districts))).select("program_id"), "program_id", "left_semi")
        return df

    def searched(self, query: str, q: CatalogQuery | None = None) -> DataFrame:
        """Programs whose titles meet a search, the closest first: those that meet it by stems, then by
        rank, by similarity, the latest, the id.  Adds by_stems, rank and fuzzy."""
        rows = textsearch.searched(self.filtered(q or CatalogQuery()), "title", normalized_query(query))
        return rows.orderBy(F.desc("by_stems"), F.desc("rank"), F.desc("fuzzy"), F.col("published_at").desc_nulls_last(), "program_id")

    def page(self, q: CatalogQuery) -> DataFrame:
        """One page in total order: the sort column, nulls last either way, then the id."""
        key = F.lower("title") if q.sort == "title" else F.col(q.sort)
        order = key.desc_nulls_last() if q.descending else key.asc_nulls_last()
        return self.filtered(q).orderBy(order, "program_id").offset((q.page - 1) * q.page_size).limit(q.page_size)

    def total(self, q: CatalogQuery) -> DataFrame:
        return self.filtered(q).agg(F.count(F.lit(1)).alias("total"))


def summary(programs: DataFrame, program_sources: DataFrame, sources: DataFrame, **satellites: DataFrame) -> DataFrame:
    """Programs with their primary source's page and name, and the columns of satellites that have a
    row a program at most, null without one.

    programs: program_id, primary_source_id; program_sources: program_id, source_id, source_url, by
    both ids; sources: source_id, name.  A program whose primary source is not listed has no row.
    """
    primary = program_sources.select("program_id", F.col("source_id").alias("primary_source_id"), "source_url")
    out = programs.join(primary, ["program_id", "primary_source_id"]).join(sources.select(F.col("source_id").alias("primary_source_id"), F.col("name").alias("source_name")), "primary_source_id")
    for table in satellites.values():
        out = out.join(table, "program_id", "left")
    return out


def canonical_geographies(links: DataFrame, districts: DataFrame, suffixes: tuple[str, ...] = ("-federal-district", "-federalny-okrug", "-federalnyi-okrug", "-federalnyy-okrug")) -> DataFrame:
    """Links (program_id, slug, name) under the canonical slug and name where either is an alias.

    districts: alias, slug, name; an alias is a name, or a slug with or without a suffix.  A name's case,
    ``ё`` and signs between words do not matter; a name counts before a slug; others stay as they are.
    Districts are a dictionary that a task can hold: they go to the links.
    """
    key = lambda c: F.trim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"[\s_\-–—]+", " "))
    bare = F.regexp_replace(F.lower(F.trim("slug")), "(" + "|".join(suffixes) + ")$", "")
    known = districts.select(key(F.col("alias")).alias("__key"), F.struct(F.col("slug"), F.col("name")).alias("__to")).dropDuplicates(["__key"])
    rows = links.withColumn("__name", key(F.col("name"))).withColumn("__slug", key(bare))
    # Names and slugs of links are few and uneven: shuffled by them, most links would meet in a few tasks.
    by_name, by_slug = (F.broadcast(known.select(F.col("__key").alias(k), F.col("__to").alias(to))) for k, to in (("__name", "__a"), ("__slug", "__b")))
    got = rows.join(by_name, "__name", "left").join(by_slug, "__slug", "left").withColumn("__to", F.coalesce("__a", "__b", F.struct("slug", "name")))
    return got.select("program_id", F.col("__to.slug").alias("slug"), F.col("__to.name").alias("name")).distinct()


def tagged_geographies(texts: DataFrame, districts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, slug, name) of the places that running texts name, by whole words and the longest names, in one pass over
    the texts however many places there are.  districts: alias, slug, name, as in ``canonical_geographies``."""
    known = districts.select(F.col("alias").alias("alias"), "slug", "name").unionByName(districts.select(F.col("name").alias("alias"), "slug", "name")).distinct()
    found = dictionary.tags(texts, known.select(F.col("alias").alias("name"), F.col("slug").alias("tag")), key, text)
    return found.join(known.groupBy(F.col("slug").alias("tag")).agg(F.min("name").alias("name")), "tag").select(key, F.col("tag").alias("slug"), "name")


def in_geographies(slugs: tuple[str, ...], districts: dict[str, tuple[str, ...]]) -> Column:
    """Whether a geography has one of the slugs, or a name that belongs to one of them as a district."""
    names = sorted({n.lower() for s in slugs for n in districts.get(s, ())})
    match = F.col("slug").isin(*slugs)
    return match | F.lower("name").isin(*names) if names else match


def sources_filtered(sources: DataFrame, kind: str | None = None, region: str | None = None, level: str | None = None, topic: str | None = None) -> DataFrame:
    """Sources of a type, region and coverage level that cover a topic; None means any."""
    tests = [F.col(c) == v for c, v in (("type", kind), ("region", region), ("coverage_level", level)) if v is not None]
    tests += [F.array_contains("topics", topic)] if topic is not None else []
    return reduce(lambda df, t: df.where(t), tests, sources)


def sources_named(sources: DataFrame, query: str, column: str = "name") -> DataFrame:
    """Sources whose name holds the query, whatever the case; its wildcards stand for themselves."""
    return sources.where(F.col(column).ilike(like_pattern(query)))


def without_deadline(programs: DataFrame) -> DataFrame:
    return programs.where("deadline_on is null").orderBy("program_id")


def with_scope(programs: DataFrame, links: DataFrame, country_wide: Column, country: str) -> DataFrame:
    """Programs with ``geographies``, sorted names; one without any that speaks of the whole country
    has the country."""
    named = links.groupBy("program_id").agg(F.array_sort(F.collect_set("slug")).alias("geographies"))
    none = F.array().cast("array<string>")
    return programs.join(named, "program_id", "left").withColumn("geographies", F.when(F.col("geographies").isNotNull(), F.col("geographies")).when(country_wide, F.array(F.lit(country))).otherwise(none))


def normalized_query(value: str) -> str:
    """Blanks collapsed; a blank query is an error."""
    text = " ".join(value.split())
    if not text:
        raise ValueError("the query is blank")
    return text


def like_pattern(value: str) -> str:
    """A literal substring for ``ilike``, with its wildcards escaped."""
    return "%" + normalized_query(value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def with_unknown_status(programs: DataFrame, details: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Programs whose details have one of the statuses; no details row means ``unknown``."""
    joined = programs.join(details.select("program_id", "source_status"), "program_id", "left")
    return joined.withColumn("source_status", F.coalesce("source_status", F.lit("unknown"))).where(F.col("source_status").isin(*statuses))


def facets(programs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(facet, value, programs) for each column, and the first and last deadline, in one pass."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    counted = programs.select(rows.alias("x")).where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("programs"))
    edges = programs.agg(F.min("deadline_on").alias("low"), F.max("deadline_on").alias("high"), F.count("deadline_on").alias("programs"))
    return counted.unionByName(edges.select(F.explode(F.array(*(F.struct(F.lit(f"deadline_{n}").alias("facet"), F.col(c).cast("string").alias("value"), "programs") for n, c in (("from", "low"), ("to", "high"))))).alias("x")).select("x.*"))


def source_counts(sources: DataFrame, programs: DataFrame) -> DataFrame:
    """Every source with its number of programs, 0 included."""
    counts = programs.groupBy("source_key").agg(F.count(F.lit(1)).alias("programs"))
    return sources.join(counts, "source_key", "left").withColumn("programs", F.coalesce("programs", F.lit(0)))


def in_given_order(ids: DataFrame, programs: DataFrame) -> DataFrame:
    """Programs of an id list (id, position) in its order; repeated and stale ids drop out."""
    first = ids.groupBy("program_id").agg(F.min("position").alias("position"))
    return first.join(programs, "program_id").orderBy("position")


def nearest_deadlines(programs: DataFrame, today: Column, count: int = 5) -> DataFrame:
    """The nearest deadlines from ``today`` on."""
    return programs.where(F.col("deadline_on") >= today).orderBy("deadline_on", "program_id").limit(count)


def canonical_taxonomy(terms: DataFrame) -> DataFrame:
    """(slug, canonical_slug): terms with equal trimmed lower-case names elect one, preferring
    slugs that no person made, then the slug's order."""
    from pyspark.sql import Window

    name = F.lower(F.trim("name"))
    chosen = F.first("slug").over(Window.partitionBy(name).orderBy(F.col("slug").startswith("manual-"), "slug").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return terms.select("slug", name.alias("name_key"), chosen.alias("canonical_slug"))


def relinked(links: DataFrame, canonical: DataFrame) -> DataFrame:
    """Links moved to the elected terms, once each."""
    return links.join(canonical.select("slug", "canonical_slug"), "slug").select("program_id", F.col("canonical_slug").alias("slug")).distinct()


def program_details(programs: DataFrame, **children: DataFrame) -> DataFrame:
    """One nested row per program: each child table (program_id, position, ...) becomes an array
    in the order of its positions."""
    out = programs
    for name, child in children.items():
        value = F.struct("position", *(c for c in child.columns if c not in ("program_id", "position")))
        nested = child.groupBy("program_id").agg(F.array_sort(F.collect_list(value)).alias(name))
        out = out.join(nested, "program_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def deadline_rank(deadline: Column, today: Column) -> Column:
    """Days to a deadline that is not past, 10,000 and its age if it is, infinity without one."""
    days = F.date_diff(deadline, today)
    return F.when(deadline.isNull(), F.lit(float("inf"))).when(days >= 0, days.cast("double")).otherwise(F.lit(10_000.0) - days)


def client_sorted(programs: DataFrame, sort: str, today: Column, relevance: Column | None = None) -> DataFrame:
    """Programs by deadline rank, funding, newest, source or relevance; ids break ties.  Equal relevance
    goes by the newest; without a relevance the deadline counts."""
    if sort == "relevance" and relevance is None:
        sort = "deadline"
    orders = {
        "deadline": [deadline_rank(F.col("deadline_on"), today).asc()], "funding": [F.col("funding").desc_nulls_last()], "newest": [F.col("published_at").desc_nulls_last()],
        "source": [F.col("source_key").asc()], "relevance": [(F.lit(0) if relevance is None else relevance).desc(), F.col("published_at").desc_nulls_last()],
    }
    return programs.orderBy(*orders[sort], "program_id")


def options(programs: DataFrame, column: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values of an array column for a choice list, without the hidden ones."""
    return programs.select(F.explode(column).alias("option")).where(~F.col("option").isin(*hidden)).distinct() if hidden else programs.select(F.explode(column).alias("option")).distinct()
