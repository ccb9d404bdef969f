"""Money, dates and themes in running text, as Column expressions.

Dictionaries are data: a table of units, of months, of theme patterns.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of unit words and what they stand for.
UNITS = {"тыс": 1_000, "thousand": 1_000, "млн": 1_000_000, "миллион": 1_000_000, "million": 1_000_000, "млрд": 1_000_000_000, "миллиард": 1_000_000_000, "billion": 1_000_000_000}
#: Months in the genitive case.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
MONEY = r"(\d{1,3}(?:[   ]\d{3})+|\d+)(?:[.,](\d{1,2}))?[   ]*(тыс|млн|миллион|млрд|миллиард|thousand|million|billion)?\p{L}*\.?[   ]*(?:руб|₽|rub)"
WORD_DATE = r"(?i)(\d{1,2})\s+(" + "|".join(MONTHS) + r")(?:\s+(\d{4}))?"
#: The same in letters of either case, so that no text has to be put into lower case.
ANY_DATE = r"\d{1,2}\s+(?:" + "|".join("".join(f"[{c.upper()}{c}]" for c in m) for m in MONTHS) + r")(?:\s+\d{4})?"


def amounts(text: Column) -> Column:
    """Distinct positive amounts in roubles, in order of the text, as decimal(18,2)."""
    whole, cents, unit = (F.regexp_extract_all(F.lower(text), F.lit("(?i)" + MONEY), F.lit(k)) for k in (1, 2, 3))

    def amount(x: Column) -> Column:
        number = F.concat(F.regexp_replace(x["w"], "[^0-9]", ""), F.lit("."), F.when(x["c"] == "", "0").otherwise(x["c"])).try_cast("decimal(18,2)")
        factor = F.lit(1)
        for word, value in UNITS.items():
            factor = F.when(x["u"] == word, value).otherwise(factor)
        return (number * factor.cast("decimal(10,0)")).cast("decimal(18,2)")

    zipped = F.arrays_zip(whole.alias("w"), cents.alias("c"), unit.alias("u"))
    return F.array_distinct(F.filter(F.transform(zipped, amount), lambda a: a > 0))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def funding_kind(text: Column) -> Column:
    """The kind that a sentence gives: range before maximum before minimum before exact; several
    amounts without a range, or none, are unknown."""
    low, n = F.lower(text), F.size(amounts(text))
    return (
        F.when((n == 2) & low.rlike(r"\b(от|from)\b.+\b(до|to|up to)\b"), "range")
        .when((n == 1) & low.rlike(r"(\bдо\b|не более|не превыша|up to|at most|максим)"), "maximum")
        .when((n == 1) & low.rlike(r"(\bот\b|не менее|at least|from|миним)"), "minimum")
        .when(n == 1, "exact")
        .otherwise("unknown")
    )


def word_dates(text: Column, fallback_year: Column, blank: str = r"\s+") -> Column:
    """All dates written out in words, in order; a date without a year takes the fallback; dates
    that do not exist drop out."""
    return let(dates_told(text, blank), lambda told: days_of(told, fallback_year))


def dates_told(text: Column, blank: str) -> Column:
    """array<[day, month, year]> of the dates written out in words, as they are written, the year only where it is."""
    return F.transform(F.regexp_extract_all(text, F.lit(ANY_DATE), F.lit(0)), lambda d: F.split(d, blank))


def days_of(told: Column, fallback_year: Column) -> Column:
    """The days of ``dates_told`` that exist."""
    number = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, k)))

    def one(d: Column) -> Column:
        month = F.coalesce(F.try_element_at(number, d[1]), F.try_element_at(number, F.lower(d[1])))
        return F.try_make_timestamp_ntz(F.coalesce(F.get(d, F.lit(2)).cast("int"), fallback_year), month, d[0].cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")

    return F.filter(F.transform(told, one), lambda d: d.isNotNull())


def period(text: Column, fallback_year: Column, blank: str = r"\s+") -> Column:
    """(start, end) of a window in text: its first and last date; one date is the end.  A day that shares
    its month with the next one has it too, and a date without a year takes the last year named.

    ``blank`` is what parts words; a text known to have single blanks is read faster by one."""
    shared = r"(?iu)(\d{1,2})\s*(по|[-–—])\s*(\d{1,2}\s+(" + "|".join(MONTHS) + r")(\s+\d{4})?)"
    last = lambda told: F.try_element_at(F.filter(F.transform(told, lambda d: F.get(d, F.lit(2))), lambda y: y.isNotNull()), F.lit(-1))
    ends = lambda d: F.struct(F.when(F.size(d) > 1, F.array_min(d)).alias("start_on"), F.array_max(d).alias("end_on"))
    return let(dates_told(F.regexp_replace(text, shared, "$1 $4$5 $2 $3"), blank), lambda told: let(days_of(told, F.coalesce(last(told).cast("int"), fallback_year)), ends))


def timeline_kind(label: Column) -> Column:
    """The kind of a timeline event by stems of its label: what is said of evaluation, contracts,
    results and the work itself comes before what is said of applications."""
    return kind_of(F.lower(label))


def kind_of(low: Column) -> Column:
    """``timeline_kind`` of a label in lower case."""
    has = lambda *stems: F.coalesce(reduce(or_, (low.contains(s) for s in stems)), F.lit(False))
    begins, ends, takes = has("начал", "открыти"), has("окончани", "завершени"), has("прием", "приём", "подач") & has("заяв")
    return (
        F.when(has("экспертиз", "оценк", "рассмотрен"), "evaluation").when(has("договор", "контракт"), "contracting").when(has("результат", "победител", "итог"), "results")
        .when(has("реализац", "исполнен") | (has("начал") & has("проект", "выплат")), "implementation")
        .when(begins & takes, "application_open").when(ends & takes, "application_close").when(has("заяв", "прием", "приём"), "application").otherwise("other")
    )


#: Words that open an entry of a schedule, by their first letters, and a cycle's number that may stand before one.
STAGE = r"(?:начало|о(?:кончание|ткрытие|ценка|бъявление)|за(?:вершение|ключение)|п(?:ри[её]м|од(?:ача|ведение|писание)|убликация)|экспертиза|р(?:ассмотрение|еализация)|исполнение)(?!\p{L})"
CYCLE = r"(?:цикл|этап|очередь|волна)"
NUMBERED = rf"(?:[ivx]+|\d+(?:-й)?) {CYCLE}"
#: The character before an entry, its cycle, and what parts that from the entry; a cycle that five and more characters part from it
#: is none.  The character is read, not looked back at from every place of the text.
ENTRY = rf"([[^\p{{L}}\p{{N}}]\x{{10000}}-\x{{10FFFF}}])(?iu)(?:({NUMBERED})([:.—– -]{{0,4}})(?={STAGE})|{NUMBERED}[:.—– -]{{5,}}(?={STAGE})|(?={STAGE})(?<!{CYCLE}[:.—– -]{{0,4}}))"


def schedule_events(text: Column, fallback_year: Column) -> Column:
    """array<struct<label, kind, start_on, end_on, evidence, date_error>>: the entries of a schedule in
    running text, in order, each once by label and dates.

    An entry runs from a word that opens one, with its cycle's number, to the next.  Its label is what
    stands before a colon or its first date, after its cycle, which holds for the entries after it until
    another is named.  An entry without dates drops out; one whose dates cannot be read stays, and says so.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s(?:\s+|(?<! ))", " "))
    # Each entry becomes a line: cycle, what parts it from the entry, entry; a blank first, as an entry may open the text.  Lines and
    # their parts are split at single characters, since split() compiles any other pattern for each row.
    lines = F.split(F.regexp_replace(F.concat(F.lit(" "), flat), ENTRY, "$1\n$2\t$3\t"), "\n")
    closed = lambda e: F.when(reduce(or_, (e.endswith(x) for x in "\x85\u2028\u2029")), F.regexp_replace(e, r"[ ;]+$", "")).otherwise(F.rtrim(e, F.lit(" ;")))
    # One step at a time, so that no expression is worked out twice.
    found = F.filter(F.transform(lines, lambda e: F.split(closed(e), "\t")), lambda p: F.size(p) == 3)

    def carried(f: Column) -> Column:
        named = F.aggregate(f, F.array().cast("array<string>"), lambda s, p: F.array_append(s, F.when(p[0] != "", p[0]).otherwise(F.try_element_at(s, F.lit(-1)))))
        cycles = F.when(F.exists(f, lambda p: p[0] != ""), named)
        told = lambda c: F.transform(f, lambda p, k: F.struct(F.get(c, k).alias("cycle"), F.array_join(p, "").alias("evidence"), parts(p).alias("parts"), period(detail(parts(p)), fallback_year, " ").alias("dates")))
        return let(cycles, told)

    parts = lambda p: F.split(p[2], ":", 2)
    detail = lambda parts: F.element_at(parts, -1)
    # Only an entry without an end is asked whether it has a date that cannot be read.
    found = F.filter(let(found, carried), lambda e: e["dates"]["end_on"].isNotNull() | detail(e["parts"]).rlike(WORD_DATE))

    def label(e: Column) -> Column:
        before = F.trim(F.when(F.size(e["parts"]) > 1, e["parts"][0]).otherwise(F.regexp_replace(e["parts"][0], f"(?s){WORD_DATE}.*", "")))
        # The pattern is tried where the last character may end it.
        may = lambda b: reduce(or_, (b.endswith(x) for x in "сСоОеЕ\u1c82\u1c83\x85\u2028\u2029"))
        bare = lambda b: F.when(may(b), F.trim(F.regexp_replace(b, r"(?iu)(?<!\p{L})(?:с|по|до|не позднее)$", ""))).otherwise(b)
        return F.concat_ws(" — ", e["cycle"], let(before, bare))

    found = F.transform(found, lambda e: F.struct(label(e).alias("label"), e["dates"].alias("dates"), e["evidence"].alias("evidence")))
    same = lambda a, b: a["dates"]["end_on"].eqNullSafe(b["dates"]["end_on"]) & a["dates"]["start_on"].eqNullSafe(b["dates"]["start_on"]) & (F.lower(a["label"]) == F.lower(b["label"]))
    found = let(found, lambda f: F.filter(f, lambda e, k: ~F.exists(F.slice(f, 1, k), lambda x: same(x, e))))
    return F.transform(
        found,
        lambda e: F.struct(
            e["label"].alias("label"), let(F.lower(e["label"]), kind_of).alias("kind"), e["dates"]["start_on"].alias("start_on"), e["dates"]["end_on"].alias("end_on"), e["evidence"].alias("evidence"),
            e["dates"]["end_on"].isNull().alias("date_error"),
        ),
    )


#: Headings of a contest's whole fund, and how a sentence names it.
FUND_HEADINGS = r"грантовый фонд|общий фонд|фонд поддержки|бюджет конкурса"
FUND = r"(?iu)грантовый\s+фонд"


def total_fund(texts: Column) -> Column:
    """struct<kind, amount, outcome, evidence> of a contest's whole fund, from array<struct<heading,
    text>>.

    Amounts count in sentences that name the fund, or stand under its heading.  One amount is exact;
    several are a conflict where sentences name more than one, else a breakdown to be read; none
    is not stated.
    """
    listed = lambda t: F.transform(
        F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(t["text"], F.lit("")), r"\s+", " ")), r"(?<=[.!?;])\s+|\s+[—–-]\s+(?=[А-ЯЁ])"), lambda s: s != ""),
        lambda s: F.struct(s.alias("sentence"), s.rlike(FUND).alias("named"), (s.rlike(FUND) | F.coalesce(F.lower(t["heading"]).rlike(FUND_HEADINGS), F.lit(False))).alias("counts")),
    )
    # The amounts of each sentence that counts are read once.
    kept = F.filter(F.flatten(F.transform(texts, listed)), lambda s: s["counts"])
    read = F.transform(kept, lambda s: F.struct(s["sentence"].alias("sentence"), s["named"].alias("named"), amounts(s["sentence"]).alias("amounts")))

    def told(sentences: Column) -> Column:
        every = F.array_distinct(F.flatten(F.transform(sentences, lambda s: s["amounts"])))
        named = F.array_distinct(F.flatten(F.transform(F.filter(sentences, lambda s: s["named"]), lambda s: s["amounts"])))
        evidence = F.transform(F.filter(sentences, lambda s: F.size(s["amounts"]) > 0), lambda s: s["sentence"])
        return let(F.struct(every.alias("every"), F.size(named).alias("named"), evidence.alias("evidence")), outcome)

    def outcome(x: Column) -> Column:
        n = F.size(x["every"])
        kind = F.when(n == 0, "not_stated").when(n == 1, "exact").otherwise("unknown")
        clash = F.when(n <= 1, "ok").when(x["named"] > 1, "total_grant_fund_conflict").otherwise("total_grant_fund_breakdown_required")
        return F.struct(kind.alias("kind"), F.when(n == 1, x["every"][0]).alias("amount"), clash.alias("outcome"), x["evidence"].alias("evidence"))

    return let(read, told)


def tagged(texts: DataFrame, rules: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tag) for every rule (tag -> regular expression) that the lower-cased text matches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tags = F.array_compact(F.array(*(F.when(low.rlike(pattern), F.lit(tag)) for tag, pattern in rules.items())))
    return texts.select(key, F.explode(tags).alias("tag"))


# Publication classes in the order they are tried, with what the title must say and what title and text
# together must say.
PUBLICATIONS = (
    ("result", r"подведен\w*\s+итог|итог\w*\s+по\s+конкурс|результат\w*\s+конкурс|список\s+победител\w*\s+конкурс", ""),
    ("milestone", r"завершил\w*\s+формальн\w*\s+этап|этап\s+экспертиз|рассмотрени\w*\s+заяв", r"конкурс|заяв"),
    ("extension", r"продлен\w*|продлени\w*\s+при[её]м|продолжен\w*\s+при[её]м", ""),
    ("amendment", r"изменен\w*|изменени\w*|дополнен\w*|уточнен\w*", r"конкурс|положен|услов|лот"),
    ("launch", r"запуск\w*[^.!?]{0,80}конкурс|начал\w*\s+отбор|открыт\w*\s+при[её]м|объявля\w*\s+о\s+начал", ""),
    ("ignore", "", r"вебинар|конференц|форум|грантополучател\w*\s+фонда|создан\w*\s+при\s+поддержк|бесплатн\w*\s+оформ\w*\s+патент|льгот\w*\s+для\s+победител"),
)
#: An opportunity takes applications and has a subject.
APPLICATIONS = r"при[её]м\s+заяв|подать\s+заяв|заявк\w*\s+можно|открыт\w*\s+при[её]м|набор\w*\s+в\s+акселератор"
SUBJECTS = r"конкурс|преми|рейтинг|акселератор|программ\w*"


def publication_class(title: Column, body: Column) -> Column:
    """result, milestone, extension, amendment, launch, opportunity or ignore."""
    head = F.lower(F.coalesce(title, F.lit("")))
    both = F.concat_ws(" ", head, F.lower(F.coalesce(body, F.lit(""))))
    says = lambda text, pattern: text.rlike("(?U)" + pattern) if pattern else F.lit(True)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, by_title, by_both in PUBLICATIONS:
        out = out.when(says(head, by_title) & says(both, by_both), kind)
    return out.when(says(both, APPLICATIONS) & says(both, SUBJECTS), "opportunity").otherwise("ignore")
