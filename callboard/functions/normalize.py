"""Normal forms of urls, texts, ids and numbers as Column expressions.

Only Unicode compatibility folding has no built-in; it runs as one Arrow-batched UDF.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|yclid|mc_cid|mc_eid)(=|$)"


def normalized_url(url: Column) -> Column:
    """http(s) urls with lower-case scheme and host, without default port and fragment, with a
    path; null for anything else, for credentials and for a bad port."""
    raw = F.trim(url)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    number = port.try_cast("int")
    good = scheme.isin("http", "https") & (host != "") & ~authority.contains("@") & ~raw.rlike(r"\s") & ((port == "") | (port.rlike("^[0-9]+$") & F.coalesce(number.between(0, 65535), F.lit(False))))
    path = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(good, F.concat(scheme, F.lit("://"), host, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)), path))


def dedup_url(url: Column) -> Column:
    """The normal form with single slashes, no trailing slash, no tracking parameters, and the
    other parameters sorted."""
    base = normalized_url(url)
    head = F.regexp_extract(base, r"^(https?://[^/?]*)", 1)
    path = F.regexp_replace(F.regexp_extract(base, r"^https?://[^/?]*([^?]*)", 1), "/+", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    query = F.regexp_extract(base, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.when(base.isNotNull(), F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC and full case folding."""
    import unicodedata

    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def folded(text: Column) -> Column:
    """``ё`` as ``е``, anything but letters, digits and ``_`` as single blanks; blank is null."""
    plain = F.trim(F.regexp_replace(F.translate(text, "ё", "е"), r"[^\p{L}\p{N}_]+", " "))
    return F.when(plain != "", plain)


def normalized_text(text: Column) -> Column:
    return folded(compatible(text))


def normalized_ascii(text: Column) -> Column:
    """As ``normalized_text`` for texts whose case folding is plain lower case; stays JVM-side."""
    return folded(F.lower(text))


def external_id(value: Column) -> Column:
    """Ids that look like urls go through ``dedup_url``; others are trimmed; blank is null."""
    trimmed = F.trim(value)
    return F.when(F.lower(trimmed).rlike("^https?://"), dedup_url(trimmed)).otherwise(F.when(trimmed != "", trimmed))


def plain_decimal(value: Column) -> Column:
    """A number without exponent and trailing zeros, or null."""
    number = value.try_cast("decimal(38,10)")
    text = number.cast("string")
    return F.when(number.isNotNull(), F.when(number == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")))


def funding_signature(*columns: str) -> Column:
    """The amounts and kind in one string; null where the kind says nothing."""
    return F.when(~F.col("value_kind").isin("unknown", "not_stated"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("value_kind", *columns))))


def conflicts(left: str, right: str, fields: list[str]) -> Column:
    """Fields that both sides fill in differently."""
    return F.array_compact(F.array(*(F.when(F.col(f"{left}.{f}") != F.col(f"{right}.{f}"), F.lit(f)) for f in fields)))


def fingerprint(*columns: str) -> Column:
    """SHA-256 over canonical JSON of the columns: names in order, no blanks, letters as they are,
    nulls as null."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID, version 5, of a text."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(name.isNotNull(), parts)


def manual_slug(namespace: str, name: Column) -> Column:
    """The slug of a term that a person made: from its namespace and its name, whatever the case."""
    return F.concat(F.lit("manual-"), F.substring(F.sha2(F.concat(F.lit(namespace), F.lit("\x00"), F.lower(name)).cast("binary"), 256), 1, 16))


def prefixed_fingerprint(*parts: Column) -> Column:
    """SHA-256 over all parts, each after its length in 8 big-endian bytes."""
    pieces = []
    for p in parts:
        body = p.cast("binary")
        pieces += [F.unhex(F.lpad(F.hex(F.octet_length(body)), 16, "0")), body]
    return F.sha2(F.concat(*pieces), 256)
