"""Reading contact values and survivor fields out of company JSON of changing shape."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The field names the data model uses for contact values, in any letter case.
KINDS = {
    **dict.fromkeys(("phone", "phones", "telephone", "tel", "mobile"), "phone"),
    **dict.fromkeys(("email", "emails", "mail"), "email"),
    **dict.fromkeys(("domain", "website", "website_domain", "url"), "domain"),
}
#: Fields whose whole subtree matches nothing.
SILENT = {"fax", "telefax", "social", "socials"}
#: Ways of saying that nothing is known, compared without case, blanks and full stops.
NOTHING = {"", "-", "--", "---", "–", "—", "?", "??", "???", "/", "n/a", "na", "none", "null", "nil", "nan", "unbekannt", "unknown", "keineangabe", "keineangaben", "ka", "k/a", "ohneangabe", "nichtbekannt", "nichtangegeben", "nichtvorhanden", "notknown", "notavailable", "notprovided", "tbd", "tba", "fehlt", "leer", "entfällt", "undefined", "siehewebsite", "*"}

_EMAIL = re.compile(r"[^\s@:<>,;\"']+@[^\s@<>,;\"'?]+\.[a-zäöüß]{2,}")
_HOST = re.compile(r"[\wäöüß-]+(\.[\wäöüß-]+)*\.[a-zäöüß]{2,}")


def load_object(text: str | None) -> dict | None:
    """The JSON object in ``text``; None where it can't be read as one."""
    if not text:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def phone(value: object) -> str | None:
    """National digits with a leading 0, or 00 and country code for foreign numbers; None under six digits."""
    text = re.sub(r"\(\s*0\s*\)", "", str(value))
    digits = re.sub(r"\D", "", text)
    if re.match(r"\D*\+", text):
        digits = "00" + digits
    if digits.startswith("0049"):
        digits = "0" + digits[4:].lstrip("0")
    return digits if len(digits.strip("0")) >= 6 else None


def email(value: object) -> str | None:
    found = _EMAIL.search(str(value).lower())
    return found[0] if found else None


def domain(value: object) -> str | None:
    """Host without scheme, user, port, path and ``www.``; None where no host stands."""
    text = re.sub(r"^[a-z][a-z0-9+.-]*:(//)?", "", str(value).strip().lower()) if "://" in str(value) else str(value).strip().lower().removeprefix("//")
    host = re.split(r"[/?#\s]", text)[0]
    if "@" in host:
        return None
    host = host.split(":")[0].rstrip(".").removeprefix("www.")
    return host if _HOST.fullmatch(host) else None


READ = {"phone": phone, "email": email, "domain": domain}


def contact_values(obj: dict) -> set[tuple[str, str]]:
    """(kind, normal form) of every contact value at any depth (walked with a stack, so depth has no limit)."""
    out, todo = set(), [(obj, None)]
    while todo:
        node, kind = todo.pop()
        if isinstance(node, dict):
            for key, child in node.items():
                low = key.strip().lower()
                if low not in SILENT:
                    todo.append((child, KINDS.get(low) or (kind if low in ("value", "values", "number", "address") and not isinstance(child, dict) else None)))
        elif isinstance(node, list):
            todo.extend((child, kind) for child in node)
        elif kind and node is not None and not isinstance(node, bool):
            if normal := READ[kind](node):
                out.add((kind, normal))
    return out


def company_features(companies: DataFrame) -> DataFrame:
    """(company_id, feature): one row per company and contact value. Rows without id and JSON that isn't an object give none;
    repeated rows give repeated features, which every later step absorbs."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cid, text in zip(batch["company_id"], batch["json"]):
                if (obj := load_object(text)) is not None:
                    out += [(cid, f"{kind}:{value}") for kind, value in sorted(contact_values(obj))]
            yield pd.DataFrame(out, columns=["company_id", "feature"])

    return companies.where("id is not null and canonical_fields_json is not null").select(F.col("id").alias("company_id"), F.col("canonical_fields_json").alias("json")).mapInPandas(read, "company_id bigint, feature string")


#: Positions an object's values may take: those of the canonical fields begin at 0, those of the findings at 1, 2, ... times this.
PLACES = 100
FIELDS = ("company", "contact_person", "street", "zip", "city", "industry", "opening_hours")


def known(value: object) -> str | None:
    """A field's text, trimmed of blanks; None where it is blank or merely says that nothing is known."""
    if isinstance(value, dict):
        value = value.get("value")
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return None
    text = str(value).strip()
    return None if re.sub(r"[\s.]", "", text).lower() in NOTHING else text


def field_values(obj: dict) -> Iterator[tuple[str, str]]:
    """Known values of FIELDS, at the top before those under ``address``."""
    for where in (obj, obj.get("address")):
        if isinstance(where, dict):
            for name in FIELDS:
                if name in where and (text := known(where[name])) is not None:
                    yield name, text


def instant(value: object) -> int | None:
    """Microseconds UTC of an ISO instant; without zone it counts as UTC; None where unreadable."""
    try:
        t = datetime.datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None
    t = t.replace(tzinfo=datetime.timezone.utc) if t.tzinfo is None else t
    return (t - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1)


def company_claims(companies: DataFrame) -> DataFrame:
    """(company_id, field_name, field_value, source, at, position): every known field value a company row or one of its
    findings claims; ``at`` in microseconds UTC or null, ``position`` from 0 for the canonical fields and from 1, 2, ... times
    PLACES for findings (top before address within each). Unreadable JSON claims nothing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cid, source, text, found, at in zip(batch["company_id"], batch["source"], batch["json"], batch["findings"], batch["at"]):
                if (obj := load_object(text)) is not None:
                    out += [(cid, n, v, source, None if pd.isna(at) else int(at), i) for i, (n, v) in enumerate(field_values(obj))]
                try:
                    findings = json.loads(found) if found else []
                except (ValueError, RecursionError):
                    findings = []
                for k, one in enumerate(findings if isinstance(findings, list) else []):
                    if isinstance(one, dict) and isinstance(one.get("fields"), dict):
                        said = one.get("source")
                        out += [(cid, n, v, said if isinstance(said, str) else None, instant(one.get("recorded_at")), (k + 1) * PLACES + i) for i, (n, v) in enumerate(field_values(one["fields"]))]
            frame = pd.DataFrame(out, columns=["company_id", "field_name", "field_value", "source", "at", "position"])
            frame["at"] = frame["at"].astype("Int64")
            yield frame

    # whatever the session's time zone: times without zone are UTC
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(canonical_updated_at as timestamp_ntz))")
    rows = companies.where("id is not null").select(F.col("id").alias("company_id"), F.col("data_source").alias("source"), F.col("canonical_fields_json").alias("json"), F.col("secondary_findings_json").alias("findings"), micros.alias("at"))
    return rows.mapInPandas(read, "company_id bigint, field_name string, field_value string, source string, at bigint, position int")
