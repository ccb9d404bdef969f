"""Queries that search, stem and tag the driver's texts, each next to the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callboard.functions import dictionary, jsontree, snowball, textsearch
from callboard.operators import pager, publications, searchindex, temporal
from callboard.plans.bindings import Tables
from callboard.plans.queries import query
from callboard.plans.records import asked
from callboard.sources import folders, tables

TITLE_SQL = r"titled AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)"
QUERY = 'the was or "of the" -and'
SIMILAR = "eriner thanedbl"


def _titles(t: Tables) -> DataFrame:
    """Documents by their first line."""
    return t.documents.select("doc_id", F.substring_index("text", "\n", 1).alias("title"))


def _indexed(t: Tables, query: str) -> DataFrame:
    """Builds the index in the shared folder, then asks it."""
    rows = _titles(t)
    index = searchindex.build(rows, folders.fresh(t.spark, "titles"), "doc_id", "title")
    return index.search(rows, query, "doc_id", "title").select("doc_id", "by_stems", F.round("rank", 9).alias("rank"), F.round("fuzzy", 9).alias("fuzzy"))


@asked(f"""WITH {TITLE_SQL}, met AS (
  SELECT * FROM titled WHERE list_contains(w, 'the') AND list_contains(w, 'was') OR contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND NOT list_contains(w, 'and')
), placed AS (
  SELECT doc_id, pos, word, row_number() OVER o AS nth, max(CASE WHEN word = 'the' THEN pos END) OVER o AS a, max(CASE WHEN word = 'was' THEN pos END) OVER o AS b,
    lag(word) OVER o = 'of' AND lag(pos) OVER o = pos - 1 AND word = 'the' AS phrase
  FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM met) WHERE word IN ('the', 'was', 'of', 'and') WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), begun AS (
  SELECT *, greatest(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END, max(CASE WHEN phrase THEN pos - 1 END) OVER (PARTITION BY doc_id ORDER BY pos)) AS begins FROM placed
), covers AS (
  SELECT c.doc_id, c.ends - c.begins - (c.nth - p.nth) AS noise FROM (SELECT doc_id, begins, min(pos) AS ends, min(nth) AS nth FROM begun WHERE begins IS NOT NULL GROUP BY doc_id, begins) c
  JOIN placed p ON p.doc_id = c.doc_id AND p.pos = c.begins
)
SELECT doc_id, true AS by_stems, round(sum(0.1::DOUBLE / (1 + noise)) / (sum(0.1::DOUBLE / (1 + noise)) + 1), 9) AS rank, 0.0::DOUBLE AS fuzzy FROM covers GROUP BY doc_id""")
def title_search(t: Tables) -> DataFrame:
    return _indexed(t, QUERY)


def _grams(word: str) -> str:
    return f"list_distinct(list_transform(range(1, len({word}) + 2), lambda k: substr('  ' || {word} || ' ', k, 3)))"


@asked(f"""WITH {TITLE_SQL}, scored AS (
  SELECT doc_id, term, max(len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE)) AS s
  FROM (SELECT doc_id, term, {_grams('word')} AS a, {_grams('term')} AS b FROM (SELECT doc_id, unnest(w) AS word FROM titled), (SELECT unnest({SIMILAR.split()}) AS term)) GROUP BY doc_id, term
)
SELECT doc_id, false AS by_stems, 0.0::DOUBLE AS rank, round(min(s), 9) AS fuzzy FROM scored GROUP BY doc_id HAVING min(s) >= 0.55""")
def title_search_similar(t: Tables) -> DataFrame:
    return _indexed(t, SIMILAR)


#: A letter for each of a-z, so that the tables' words end like Russian ones.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "авсмейгыиюхлщнопярстувшоья"


def _ending_sql(x: str, plain: str, after_a: str = "") -> str:
    either = "|".join([*(["(?:" + "|".join(plain.split()) + ")"] if plain else []), *(["([ая])(?:" + "|".join(after_a.split()) + ")"] if after_a else [])])
    return f"regexp_replace({x}, '(?:{either})$', '{chr(92) + '1' if after_a else ''}')"


_S, _V = snowball, snowball.VOWELS
STEMS_SQL = rf"""WITH {TITLE_SQL}, words AS (
  SELECT DISTINCT translate(word, '{LATIN}', '{CYRILLIC}') AS word FROM (SELECT unnest(w) AS word FROM titled)
), parted AS (
  SELECT word, regexp_extract(word, '^[^{_V}]*[{_V}]?') AS head, regexp_extract(word, '^[^{_V}]*[{_V}](.*)$', 1) AS rv, length(regexp_extract(word, '^(?:[^{_V}]*[{_V}]+[^{_V}]){{2}}')) AS r2
  FROM (SELECT replace(word, 'ё', 'е') AS word FROM words)
), tried AS (
  SELECT *, {_ending_sql('rv', _S.GERUND, _S.GERUND_AFTER_A)} AS gerund, {_ending_sql('rv', _S.REFLEXIVE)} AS bare FROM parted
), chosen AS (
  SELECT *, CASE WHEN gerund <> rv THEN gerund WHEN {_ending_sql('bare', _S.ADJECTIVE)} <> bare THEN {_ending_sql(_ending_sql('bare', _S.ADJECTIVE), _S.PARTICIPLE, _S.PARTICIPLE_AFTER_A)}
    WHEN {_ending_sql('bare', _S.VERB, _S.VERB_AFTER_A)} <> bare THEN {_ending_sql('bare', _S.VERB, _S.VERB_AFTER_A)} ELSE {_ending_sql('bare', _S.NOUN)} END AS one FROM tried
), two AS (
  SELECT word, head, r2, regexp_replace(one, 'и$', '') AS x FROM chosen
), three AS (
  SELECT word, head, CASE WHEN r2 > 0 AND length(head) + length(regexp_replace(x, 'ость?$', '')) >= r2 THEN regexp_replace(x, 'ость?$', '') ELSE x END AS x FROM two
)
SELECT word, head || CASE WHEN regexp_replace(x, 'ейше?$', '') <> x THEN regexp_replace(regexp_replace(x, 'ейше?$', ''), 'нн$', 'н') WHEN x LIKE '%нн' THEN regexp_replace(x, 'нн$', 'н') ELSE regexp_replace(x, 'ь$', '') END AS stem FROM three"""


@asked(STEMS_SQL)
def title_stems(t: Tables) -> DataFrame:
    words = _titles(t).select(F.explode(textsearch.words("title")).alias("word")).select(F.translate("word", LATIN, CYRILLIC).alias("word")).distinct()
    return words.select("word", snowball.stem(F.col("word")).alias("stem"))


WORDS_SQL = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


@asked(f"""WITH names AS (
  SELECT DISTINCT item_id AS tag, w[k] || ' ' || w[k + 1] AS name FROM (SELECT item_id, w, unnest(range(1, len(w))) AS k FROM (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark))
), pairs AS (
  SELECT doc_id, w[k] || ' ' || w[k + 1] AS name FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents))
)
SELECT doc_id, tag, count(*) AS mentions FROM pairs JOIN names USING (name) GROUP BY doc_id, tag""")
def dictionary_mentions(t: Tables) -> DataFrame:
    """Word pairs of benchmark items as names, the items as tags, in whole documents."""
    words = t.benchmark.select("item_id", textsearch.words(F.col("text")).alias("w"))
    pairs = words.where(F.size("w") > 1).select(F.col("item_id").alias("tag"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.concat_ws(" ", F.col("w")[k - 1], F.col("w")[k]))).alias("name"))
    found = dictionary.mentions(t.documents, pairs, "doc_id", "text", only_longest=False)
    return found.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("mentions"))


def _paged(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages in lists of ten; every other list's last page leads back by two, a loop of three."""
    known = t.pages.select("page_id")
    place = F.col("page_id") % 10
    following = F.when(place < 9, F.col("page_id") + 1).when(F.floor(F.col("page_id") / 10) % 2 == 0, F.col("page_id") - 2)
    return known.withColumn("next_id", following), known.where((place == 0) & (F.floor(F.col("page_id") / 10) % 5 < 4)).select(F.col("page_id").alias("start"))


PAGED = """WITH RECURSIVE p AS (
  SELECT page_id, CASE WHEN page_id % 10 < 9 THEN page_id + 1 WHEN page_id // 10 % 2 = 0 THEN page_id - 2 END AS next_id FROM pages
), walk AS (
  SELECT page_id AS start, page_id AS page, 0 AS place FROM p WHERE page_id % 10 = 0 AND page_id // 10 % 5 < 4
  UNION ALL SELECT start, n.page_id, place + 1 FROM walk JOIN p ON p.page_id = page JOIN p n ON n.page_id = p.next_id WHERE place < 20
), walked AS (SELECT start, page, min(place) AS place FROM walk GROUP BY start, page)"""


@asked(PAGED + """ SELECT start, page, place FROM walked UNION ALL SELECT NULL, page_id, NULL FROM pages WHERE page_id NOT IN (SELECT page FROM walked)""")
def pager_order(t: Tables) -> DataFrame:
    pages, starts = _paged(t)
    reached = pager.walked(pages, starts, "page_id", "next_id")
    alone = pager.unreached(pages, reached, "page_id").select(F.lit(None).cast("long").alias("start"), F.col("page_id").alias("page"), F.lit(None).cast("int").alias("place"))
    return reached.unionByName(alone)


@asked(PAGED + """, ends AS (SELECT start, count(*) AS pages, max_by(page, place) AS last FROM walked GROUP BY start)
SELECT e.start, e.pages, e.last, coalesce(e.pages - w.place, 0) AS loop, CASE WHEN w.place IS NOT NULL THEN 'loop' WHEN p.next_id IS NOT NULL THEN 'next_page_missing' END AS problem
FROM ends e JOIN p ON p.page_id = e.last LEFT JOIN walked w ON w.start = e.start AND w.page = p.next_id""")
def pager_lists(t: Tables) -> DataFrame:
    pages, starts = _paged(t)
    return pager.lists(pages, pager.walked(pages, starts, "page_id", "next_id"), "page_id", "next_id")


@query
def page_sections(t: Tables) -> DataFrame:
    """Sections of whole pages by the depth of their headings; tests hold a plain version."""
    return tables.rows(t.pages.select("page_id", "html"), "sections")


@query
def page_cards(t: Tables) -> DataFrame:
    return tables.rows(t.pages.select("page_id", "html"), "cards")


@query
def site_entries(t: Tables) -> DataFrame:
    """A site's links in lists, each once, in the order of its pages."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    cards = tables.rows(t.pages.select("page_id", host.alias("list"), "html"), "cards")
    return tables.listed(cards.select("list", F.col("page_id").alias("page"), "position", "href"))


# Trees, identities, names and deadlines


def _trees(t: Tables) -> DataFrame:
    """Orders as nested JSON, the keys of each object in one order or another."""
    odd = F.col("o_orderkey") % 2 == 1
    inner = F.when(odd, F.to_json(F.struct(F.col("o_orderkey").alias("z"), F.col("o_orderstatus").alias("é")))).otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("é"), F.col("o_orderkey").alias("z"))))
    tree = F.when(odd, F.concat(F.lit('{"b": [1, '), inner, F.lit(', []], "a": {"y": null, "x": '), F.col("o_custkey"), F.lit("}}")))
    return t.orders.select("o_orderkey", tree.otherwise(F.concat(F.lit('{"a":{"x":'), F.col("o_custkey"), F.lit(',"y":null},  "b":[1,'), inner, F.lit(",[ ]]}"))).alias("tree"))


@asked("""SELECT o_orderkey, sha256('{"a":{"x":' || o_custkey || ',"y":null},"b":[1,{"z":' || o_orderkey || ',"é":"' || o_orderstatus || '"},[]]}') AS fingerprint FROM orders""")
def tree_fingerprints(t: Tables) -> DataFrame:
    return _trees(t).select("o_orderkey", jsontree.fingerprint(F.col("tree")).alias("fingerprint"))


@asked("""SELECT o_orderkey, unnest(['a.x', 'a.y', 'b.0', 'b.1.z', 'b.1.é', 'b.2']) AS path, unnest([CAST(o_custkey AS VARCHAR), NULL, '1', CAST(o_orderkey AS VARCHAR), o_orderstatus, '[]']) AS value FROM orders""")
def tree_leaves(t: Tables) -> DataFrame:
    return jsontree.leaves(_trees(t), "o_orderkey", "tree").select("o_orderkey", "path", "value")


@asked("""WITH RECURSIVE p AS (SELECT doc_id AS id, CASE WHEN doc_id % 20 <> 7 THEN 'i' || lpad(CAST(doc_id // 20 AS VARCHAR), 6, '0') END AS identity, CASE WHEN doc_id % 11 = 0 THEN 'ignore' ELSE 'launch' END AS kind FROM documents),
l AS (SELECT doc_id AS id, doc_id + 1 AS target FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, doc_id + 25 FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id, doc_id + 3 FROM documents WHERE doc_id % 20 = 7 AND doc_id % 3 > 0),
c AS (SELECT l.id, count(DISTINCT identity) AS claims, min(identity) AS claimed FROM l JOIN p ON p.id = l.target WHERE identity IS NOT NULL GROUP BY 1),
r AS (SELECT p.*, claims, CASE WHEN claims = 1 THEN claimed END AS one FROM p LEFT JOIN c USING (id)),
e AS (SELECT DISTINCT identity AS a, one AS b FROM r WHERE identity <> one), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least_of AS (SELECT a, least(a, min(b)) AS g FROM reach GROUP BY a)
SELECT id AS publication_id, coalesce(g, about) AS group_id, array_to_string(list_filter([CASE WHEN claims > 1 THEN 'related_publication_ambiguous' END, CASE WHEN one <> identity THEN 'related_publication_identity_override' END,
  CASE WHEN kind <> 'ignore' AND coalesce(identity, one) IS NULL THEN 'publication_identity_missing' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT *, CASE WHEN kind <> 'ignore' THEN coalesce(identity, one) END AS about FROM r) LEFT JOIN least_of ON a = about""")
def identity_groups(t: Tables) -> DataFrame:
    """Documents as publications, twenty of an identity; links to the next ones, and some to other identities."""
    k = F.col("doc_id")
    rows = t.documents.select(k.alias("publication_id"), F.when(k % 20 != 7, F.concat(F.lit("i"), F.lpad(F.floor(k / 20).cast("string"), 6, "0"))).alias("identity"), F.when(k % 11 == 0, "ignore").otherwise("launch").alias("kind"))
    steps = F.array_compact(F.array(F.when(k % 3 == 0, k + 1), F.when(k % 9 == 0, k + 25), F.when((k % 20 == 7) & (k % 3 > 0), k + 3)))
    links = t.documents.select(k.alias("publication_id"), F.explode(steps).alias("target_id"))
    return publications.identity_groups(rows, links).select("publication_id", "group_id", F.array_join("warnings", ",").alias("warnings"))


@asked("""WITH p AS (SELECT p_partkey AS portal_id, list_distinct(['start', 'n' || p_partkey // 2, 'k' || p_partkey % 5, 'b' || p_partkey // 40]) AS w, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 END AS q FROM part),
g AS (SELECT p_partkey AS group_id, list_distinct(['start', 'n' || p_partkey // 2, 'k' || p_partkey % 5, 'b' || (p_partkey + p_partkey % 2) // 40]) AS w, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 2 END AS q FROM part),
s AS (SELECT portal_id, group_id, len(list_intersect(p.w, g.w)) / CAST(len(p.w) + len(g.w) - len(list_intersect(p.w, g.w)) AS DOUBLE) AS s FROM p JOIN g ON p.portal_id // 40 BETWEEN g.group_id // 40 - 1 AND g.group_id // 40 + 1 AND (p.q IS NULL OR g.q IS NULL OR p.q = g.q)),
b AS (SELECT *, max(s) OVER (PARTITION BY portal_id) AS pb, max(s) OVER (PARTITION BY group_id) AS gb FROM s WHERE s >= 0.75),
c AS (SELECT *, count(*) FILTER (s = pb) OVER (PARTITION BY portal_id) AS pt, count(*) FILTER (s = gb) OVER (PARTITION BY group_id) AS gt FROM b)
SELECT portal_id, group_id, s AS similarity, CASE WHEN pt = 1 AND gt = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM c WHERE s = pb AND s = gb""")
def portal_names(t: Tables) -> DataFrame:
    """Parts as contests with names of four words, a portal's and the groups' own, in two queues."""
    k = F.col("p_partkey")

    def named(year: str, block, every: int):
        queue = F.when(k % every == 0, F.concat(F.lit(" (очередь № "), k % 2, F.lit(")"))).otherwise("")
        return F.concat(F.lit("Start «N"), F.floor(k / 2), F.lit("» K"), k % 5, F.lit(", b"), F.floor(block / 40), F.lit(year), queue)

    portal, groups = t.part.select(k.alias("portal_id"), named(" 2026", k, 3).alias("name")), t.part.select(k.alias("group_id"), named("", k + k % 2, 4).alias("name"))
    return publications.matched_names(portal, groups, 0.75)


DEADLINES = """t AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, user_id AS entity, max(ts) AS last FROM events GROUP BY 1, 2),
m AS (SELECT week_start, entity, CASE WHEN entity % 4 > 0 THEN CAST(last AS DATE) + CAST(entity % 7 - 3 AS INTEGER) END AS d FROM t),
s AS (SELECT week_start, entity, CASE WHEN d IS NULL THEN 'missing' WHEN d < week_start + 3 THEN 'overdue' ELSE 'upcoming_or_today' END AS state FROM m)"""


def _deadlines(t: Tables) -> DataFrame:
    week = temporal.week_start(F.col("ts"))
    rows = t.events.groupBy(week.alias("week_start"), F.col("user_id").alias("entity")).agg(F.max("ts").cast("date").alias("last"))
    deadline = F.when(F.col("entity") % 4 > 0, F.date_add("last", (F.col("entity") % 7 - 3).cast("int")))
    return rows.select("week_start", "entity", temporal.deadline_state(deadline, F.date_add("week_start", 3)).alias("deadline_state"))


@asked(f"WITH {DEADLINES} SELECT CAST(w.week_start AS VARCHAR) AS week_start, v.state, count(s.entity) AS n FROM (SELECT DISTINCT week_start FROM s) w CROSS JOIN (SELECT unnest(['missing', 'overdue', 'upcoming_or_today']) AS state) v LEFT JOIN s ON s.week_start = w.week_start AND s.state = v.state GROUP BY 1, 2")
def weekly_deadline_states(t: Tables) -> DataFrame:
    return temporal.deadline_states(_deadlines(t)).withColumn("week_start", F.col("week_start").cast("string"))


@asked(f"""WITH {DEADLINES}, l AS (SELECT week_start, lag(week_start) OVER (ORDER BY week_start) AS previous FROM (SELECT DISTINCT week_start FROM s))
SELECT CAST(l.week_start AS VARCHAR) AS week_start, b.state AS before, a.state AS now, count(*) AS n FROM l JOIN s a ON a.week_start = l.week_start JOIN s b ON b.week_start = l.previous AND b.entity = a.entity WHERE a.state <> b.state GROUP BY ALL""")
def weekly_deadline_transitions(t: Tables) -> DataFrame:
    members = _deadlines(t)
    weeks = members.select("week_start").distinct()
    links = weeks.withColumn("previous_week", F.lag("week_start").over(Window.orderBy("week_start")))  # one row a week
    moved = temporal.state_transitions(temporal.paired(members, links, ["deadline_state"]), "deadline_state")
    return moved.withColumn("week_start", F.col("week_start").cast("string"))
