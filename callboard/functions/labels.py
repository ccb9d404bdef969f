"""Titles, policies and labels for showing records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callboard.functions.parse import MONTHS

#: Pairs of quotes that a whole title may stand in.
QUOTES = (("«", "»"), ("“", "”"), ('"', '"'))
CONTACT = r"(?iu)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|(\+7|8)[\s(-]*\d{3}[\s)-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}"
CHROME = r"(?iu)^(главная|меню|поиск|войти|подробнее|читать далее|menu|search|log ?in|read more|share|cookie)\b"

# What marks a resource, a section or a text, in any case.
WORDS = "(?iuU)"
HIDDEN_SECTIONS = (
    "поделиться", "поделиться:", "социальные сети", "группы фонда в социальных сетях", "новости", "события", "истории", "похожие материалы", "читайте также",
)
HIDDEN_TITLES = ("назад", "вернуться", "поделиться", "поделиться:", "читать далее", "подробнее")
SERVICE = WORDS + r"политик\w*\s+(?:конфиденциальности|обработки персональных данных)|пользовательск\w*\s+соглашени\w*|настройк\w*\s+cookie"
WINNERS = WORDS + r"победител\w*|лауреат\w*|(?:итог|результат)\w*\s+(?:конкурс\w*|отбор\w*|программ\w*)"
WINNER_PATH = WORDS + r"победител\w*|лауреат\w*|pobeditel[a-z0-9_-]*|laureat[a-z0-9_-]*"
RESULT_PATH = WORDS + r"(?:итог|результат)\w*|(?:itog|rezultat)[a-z0-9_-]*"
CONTEST_PATH = WORDS + r"конкурс\w*|цикл\w*|konkurs[a-z0-9_-]*|(?:c|ts)ikl[a-z0-9_-]*"
WINNER_GROUP = WORDS + r"(?:[ivxlcdm]+|\d+)\s+цикл|20\d{2}\s*[/–-]\s*20\d{2}"
MILESTONE = (
    WORDS + r"объявлен\w*\s+(?:результат\w*|победител\w*|итог\w*)|подведен\w*\s+(?:итог\w*|результат\w*)|(?:вводн\w*\s+)?семинар\w*\s+(?:для\s+)?победител\w*|"
    r"заключен\w*\s+договор\w*\s+(?:с\s+)?победител\w*"
)
SOCIAL_HOSTS = ("t.me", "telegram.me", "vk.com", "vkontakte.ru")
RUSSIA = (
    WORDS + r"все\s+регионы\s+россии|всех\s+регионах\s+россии|по\s+всей\s+россии|на\s+всей\s+территории\s+россии|российск\w*\s+федерац|"
    r"российск\w*\s+(?:организац|нко|некоммерч|юридическ\w*\s+лиц|участник)"
)
INVITED = WORDS + r"по\s+приглашени\w*|приглашени\w*\s+(?:от\s+)?фонд\w*"
OPEN_TO_ALL = WORDS + r"открыт\w*\s+для|все\s+желающ|любой\s+организац"
SECTION_CATEGORIES = ("application", "criteria", "opportunities", "results")
CARD_KINDS = ("competition_document", "program_document", "reference")


def _flat(text: Column) -> Column:
    """Blanks collapsed; a blank text is null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(_flat(text).rlike(pattern), F.lit(False))


def _among(text: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(_flat(text)).isin(*values), F.lit(False))


def _verdict(cases: list[tuple[Column, Column | bool]]) -> Column:
    """The value of the first case that holds; false if none does."""
    out = F.when(F.lit(False), F.lit(False))
    for condition, value in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), value)
    return F.coalesce(out, F.lit(False))


def clean_title(title: Column) -> Column:
    """Without outer quotes, an edition label at the end and doubled blanks."""
    out = F.trim(F.regexp_replace(title, r"\s+", " "))
    for a, b in QUOTES:
        out = F.regexp_replace(out, f"^{a}([^{a}{b}]+){b}$", "$1")
    return F.trim(F.regexp_replace(out, r"(?iu)[\s(–-]+(\d{4}([/-]\d{2,4})?\s*(год|г\.?)?|\d+[- ]?(й|я)? (сезон|очередь|волна))\)?$", ""))


#: Phrases that lead in to what a publication is about; each goes in turn if it stands first.
LEAD = r"(?:запуск|продление|продолжается|открыт\w*|подведен\w*)\s+"
LEADS = (LEAD + r"(?:(?:конкурс\w*|преми\w*|рейтинг\w*|акселератор\w*|программ\w*)\s+)?", LEAD, r"при[её]м\s+заявок\s+", r"на\s+")


def bare_title(title: Column) -> Column:
    """A publication's title without the words that lead in to it and the signs around it."""
    out = F.trim(F.regexp_replace(title, r"(?U)\s+", " "))
    for phrase in LEADS:
        out = F.regexp_replace(out, f"{WORDS}^{phrase}", "")
    return F.regexp_replace(out, r"^[ \-–—:;,.]+|[ \-–—:;,.]+$", "")


def date_label(day: Column) -> Column:
    """``5 марта 2026``, or null."""
    return F.when(day.isNotNull(), F.concat_ws(" ", F.dayofmonth(day), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day)))


def has_contact(text: Column) -> Column:
    """Whether a text holds a mail address or a phone number, and so is never public."""
    return F.coalesce(text.rlike(CONTACT), F.lit(False))


def is_chrome(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(CHROME), F.lit(False))


def resource_kind(title: Column, url: Column) -> Column:
    """winners, document, application, or page."""
    return F.when(title.rlike(WINNERS), "winners").when(F.lower(url).rlike(r"\.(pdf|docx?|xlsx?|zip)(\?|$)"), "document").when(F.lower(title).rlike("заявк|apply|registration|регистрац"), "application").otherwise("page")


def is_social(url: Column) -> Column:
    """Whether a url leads to a social network."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.coalesce(bare.isin(*SOCIAL_HOSTS) | bare.rlike(r"\.(" + "|".join(h.replace(".", r"\.") for h in SOCIAL_HOSTS) + ")$"), F.lit(False))


def is_winners(title: Column, section: Column, url: Column) -> Column:
    """Whether a resource leads to winners or results: its title or section says so, or its path names
    winners, or results beside a contest."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    by_path = _says(decoded, WINNER_PATH) | (_says(decoded, RESULT_PATH) & _says(decoded, CONTEST_PATH))
    return _says(title, WINNERS) | _says(section, WINNERS) | by_path


def is_milestone(title: Column) -> Column:
    """Whether a title names a date of the schedule, such as the announcement of winners."""
    return _says(title, MILESTONE)


def is_result_heading(heading: Column) -> Column:
    return ~is_milestone(heading) & _says(heading, WINNERS)


def winner_group(title: Column) -> Column:
    """The label of a cycle or of years that result files are grouped by, or null."""
    return F.when(F.lower(_flat(title)).rlike("^(?:" + WINNER_GROUP.removeprefix(WORDS) + ")$") | _flat(title).rlike(f"{WORDS}^(?:{WINNER_GROUP.removeprefix(WORDS)})$"), F.lower(_flat(title)))


def public_kind(kind: Column, title: Column, section: Column, url: Column, in_result_group: Column) -> Column:
    """The kind to show: social links are references, and what leads to winners, or stands in a group
    that does, is a result, unless it is the application itself."""
    result = (kind != "application") & (F.coalesce(in_result_group, F.lit(False)) | is_winners(title, section, url))
    return F.when(is_social(url), "reference").when(result, "result").otherwise(kind)


def is_public_resource(kind: Column, title: Column, section: Column, category: Column, url: Column, in_result_group: Column) -> Column:
    """Whether a resource stands on a public card: named, not service or furniture, and of a kind and
    category that cards show.  Results need evidence of winners; links inside a text only show
    among documents; a record without categories shows what stands in a named section."""
    c = F.lower(_flat(category))
    return _verdict([
        (_flat(title).isNull() | _among(title, HIDDEN_TITLES) | _says(title, SERVICE), False),
        (is_social(url), c.isNull() | c.isin("results", "official_channels")),
        (kind == "detail", False),
        (kind == "application", c.isNull()),
        (kind == "result", F.coalesce(in_result_group, F.lit(False)) | is_winners(title, section, url)),
        (c.isNotNull(), (c == "documents") & kind.isin(*CARD_KINDS)),
        (_flat(section).isNotNull(), ~_among(section, HIDDEN_SECTIONS)),
    ])


def is_public_section(category: Column, heading: Column, content: Column) -> Column:
    """Whether a section's text is shown: of a category with content of its own, with heading and text,
    no sharing box and no file; a section of results must be headed by them."""
    return _verdict([
        (~F.coalesce(category.isin(*SECTION_CATEGORIES), F.lit(False)) | _flat(heading).isNull() | _flat(content).isNull(), False),
        (F.lower(_flat(heading)).startswith("поделиться") | F.lower(heading).contains(".pdf") | _says(content, WORDS + r"\bpdf\b"), False),
        (category == "results", is_result_heading(heading)),
        (F.lit(True), True),
    ])


def country_scope(*texts: Column) -> Column:
    """Whether the texts, read together, speak of the whole country."""
    return _says(F.concat_ws(" ", *texts), RUSSIA)


def access_mode(*texts: Column) -> Column:
    """invitation_only, open or unknown, as the texts say who may apply."""
    every = F.concat_ws(" ", *texts)
    return F.when(_says(every, INVITED), "invitation_only").when(_says(every, OPEN_TO_ALL), "open").otherwise("unknown")


def money_label(amount: Column, currency: Column) -> Column:
    """``1 234 567.50 RUB``, without zero cents."""
    text = F.regexp_replace(F.regexp_replace(F.format_number(amount, 2), r"\.00$", ""), ",", " ")
    return F.when(amount.isNotNull(), F.concat_ws(" ", text, currency))


def funding_label() -> Column:
    """The tagged union in words."""
    kind, code = F.col("value_kind"), F.col("currency_code")
    exact, low, high = (money_label(F.col(c), code) for c in ("exact_amount", "min_amount", "max_amount"))
    return (
        F.when(kind == "exact", exact).when(kind == "minimum", F.concat(F.lit("from "), low)).when(kind == "maximum", F.concat(F.lit("up to "), high))
        .when(kind == "range", F.concat(low, F.lit(" – "), high)).when(kind == "unknown", "unknown").when(kind == "not_stated", "not stated").otherwise("no record")
    )
