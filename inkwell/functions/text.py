"""Text columns: normal forms, extraction and matching, all built from JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import signals as S

# Letters with diacritics and their base letters, in one order.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"

# Patterns of contact values.
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+49|0049|0)\s*(?:\(?\d{2,5}\)?[\s./-]*)\d[\d\s./-]{4,}"
DOMAIN = r"(?:https?://)?(?:www\.)?[A-Za-z0-9-]+\.(?:de|com|org|net|eu|example)\b"


def normalize_name(c: Column) -> Column:
    """Lower-case ASCII words: diacritics dropped, other non-ASCII letters removed, the rest separated by single blanks."""
    plain = F.regexp_replace(F.translate(c, ACCENTED, BASE), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def contact_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts])


def form_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(F.replace(c, F.lit("ß"), F.lit("ss")), ACCENTED, BASE)), "[^a-z0-9]", "")


def clean_display(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t\r\n]+", " "), r"^[ ,;:|·•-]+|[ ,;:|·•-]+$", "")


def folded(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")))


def rounded_text(c: Column) -> Column:
    """A number to three places, halves up, without trailing zeros; empty for null."""
    scaled = F.floor(c * 1000 + 0.5).cast("bigint")
    whole, rest = (scaled / 1000).cast("bigint"), F.lpad((scaled % 1000).cast("string"), 3, "0")
    text = F.when(scaled % 1000 == 0, whole.cast("string")).otherwise(F.concat(whole.cast("string"), F.lit("."), F.regexp_replace(rest, "0+$", "")))
    return F.coalesce(text, F.lit(""))


def fingerprint(page: Column, company: Column, preview: Column, box: dict[str, Column]) -> Column:
    places = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), rounded_text(v)) for k, v in box.items()])
    parts = [F.coalesce(page.cast("string"), F.lit("")), F.coalesce(folded(company), F.lit("")), F.coalesce(folded(preview), F.lit("")), places]
    return F.left(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(24))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def phone_international(c: Column) -> Column:
    """+49 and the rest for German numbers with country code, else the digits."""
    d = digits(c)
    return F.when(F.trim(c).startswith("+49"), F.concat(F.lit("+49"), F.substring(d, 3, 2**31 - 1))).when(F.trim(c).startswith("0049"), F.concat(F.lit("+49"), F.substring(d, 5, 2**31 - 1))).otherwise(d)


def phone_national(c: Column) -> Column:
    """Digits with a leading 0 in place of the German or Austrian country code, where enough digits follow."""
    d, n = digits(c), F.length(digits(c))
    return (
        F.when((d.startswith("0049") | d.startswith("0043")) & (n > 10), F.concat(F.lit("0"), F.substring(d, 5, 2**31 - 1)))
        .when(F.ltrim(c).startswith("+43") & (n > 8), F.concat(F.lit("0"), F.substring(d, 3, 2**31 - 1)))
        .when(d.startswith("49") & (n > 8), F.concat(F.lit("0"), F.substring(d, 3, 2**31 - 1)))
        .otherwise(d)
    )


def domain(c: Column, drop_www: bool = False) -> Column:
    host = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "^(?i)https?://", ""), "/+$", ""))
    return F.regexp_replace(host, r"^www\.", "") if drop_www else host


def first_email(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, f"({EMAIL})", 1), F.lit(""))


def first_phone(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, f"({PHONE})", 1)), F.lit(""))


def last_domain(c: Column) -> Column:
    found = F.regexp_extract_all(F.regexp_replace(c, EMAIL, ""), F.lit(f"({DOMAIN})"), F.lit(1))
    return F.when(F.size(found) > 0, domain(F.element_at(found, -1)))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), F.trim), lambda x: x != "")


def contact_score(c: Column) -> Column:
    flag = lambda p: F.when(c.rlike(p), 1).otherwise(0)
    return F.length(digits(c)) + 3 * flag("@") + 2 * flag(r"(?i)(www\.|https?://|\.de(?![A-Za-z0-9_]))")


def communication_kind(c: Column) -> Column:
    contact = c.rlike(PHONE) | c.rlike(EMAIL) | c.rlike(r"(?i)(https?://|www\.)")
    return F.when(contact, "contact").when(c.rlike(r"\d{5}") | c.rlike(r"(?i)(straße|strasse|weg |platz|gasse|allee|ufer)"), "address")


def ladder(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, else null."""
    (name, first), *rest = rules
    return reduce(lambda acc, r: acc.when(r[1], r[0]), rest, F.when(first, name))


def forbidden_content(c: Column) -> Column:
    """The first kind of content to be reviewed that a line holds: a price, bank details, a term of validity, a campaign."""
    low = F.lower(F.trim(F.regexp_replace(c, "[ \t\r\n]+", " ")))
    has = low.rlike
    free = low.contains(S.FREE[0]) & low.contains(S.FREE[1])
    return ladder([("price_or_currency", has(S.PRICE)), ("bank_details", has(S.IBAN) & has(S.BANK)), ("validity_or_deadline", has(S.VALIDITY) & has(S.VALID_FOR)), ("campaign_or_offer", has(S.CAMPAIGN) | free)])


def count_of(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle``; 0 for an empty one."""
    return F.when(F.length(needle) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-zäöüß0-9]+(?:[.@+_-][a-zäöüß0-9]+)*)"), F.lit(1)), lambda t: F.length(t) > 2))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9äöüß]+)"), F.lit(1))


def safe_filename(c: Column) -> Column:
    base = F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    kept = F.regexp_replace(F.replace(F.regexp_replace(base, r"[\x00-\x1F\x7F]", ""), F.lit('"'), F.lit("")), r"^[ .]+|[ .]+$", "")
    return F.left(F.coalesce(F.nullif(kept, F.lit("")), F.lit("source.pdf")), F.lit(255))


def normalize_url(c: Column) -> Column:
    """Scheme and host in lower case, default ports and fragment dropped, an empty path as a slash."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    port = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+:([0-9]+)", 1)
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(c, r"(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query)


# Words that name publications.
PUBLICATION_TERMS = ("seniorenwegweiser", "seniorenratgeber", "bürgerinformation", "buergerinformation", "bürgerbroschüre", "buergerbroschuere", "gesundheitsführer", "gesundheitsfuehrer", "stadtmagazin", "gemeindemagazin", "branchenführer", "branchenfuehrer", "gastgeberverzeichnis", "vereinsmagazin", "festschrift", "messekatalog", "ausstellerverzeichnis")


def publication_score(c: Column) -> Column:
    low = F.lower(c)
    hits = reduce(lambda a, b: a + b, [F.when(low.contains(t), 1).otherwise(0) for t in PUBLICATION_TERMS])
    wanted = reduce(lambda a, b: a | b, [low.contains(t) for t in ("download", "publikation", "broschu", "magazin", "wegweiser")])
    year = F.when(low.rlike("20[0-9]{2}"), 10).otherwise(0)
    return F.least(F.lit(100), F.when(low.contains(".pdf"), 25).otherwise(0) + F.least(F.lit(50), 15 * hits) + year + F.when(wanted, 10).otherwise(0))


def title_case(c: Column) -> Column:
    """Words and hyphenated parts with a capital, connecting words inside a name in lower case."""
    # Connecting words of place names.
    small = ["am", "an", "auf", "bei", "der", "die", "das", "im", "in", "ob", "oder", "von", "zu", "zum", "zur"]
    part = lambda w, i: F.when((i > 0) & w.isin(small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1)))
    hyphened = lambda w, i: F.array_join(F.transform(F.split(w, "-"), lambda x, j: part(x, i + j)), "-")
    return F.array_join(F.transform(F.split(F.lower(c), " "), hyphened), " ")
