"""Signals of adverts and of public senders in text, as patterns on lower-case text that Java and RE2 read alike."""

from __future__ import annotations

# What tells adverts, contact lines, advertisers, editorial parts, public senders and overviews; E is a word's edge.
_E0, _E1 = "(?:^|[^a-z0-9_äöüß])", "(?:[^a-z0-9_äöüß]|$)"
AD = r"(www\.|https?://|@|telefon|tel\.?|fax|€|eur|angebot|rabatt|aktion|gmbh|kg" + _E1 + r"|e\.v\.|\.de" + _E1 + ")"
CONTACT = r"([+]?[0-9][0-9 ()./-]{6,}[0-9]|www\.|https?://|[a-z0-9_.+-]+@[a-z0-9_.-]+\.[a-z]{2,}|telefon|tel\.?|fax)"
PHONE = "(" + _E0 + r"(?:tel|telefon|fon|ruf) *[:.]? *(?:[+]49|0)?[0-9 ()./-]{6,}[0-9]|(?:^|[^0-9])(?:[+]49|0) *(?:\(?[0-9]{2,5}\)?[ ./-]*)[0-9][0-9 ./-]{3,}[0-9](?:[^0-9]|$))"
ADVERTISER = "(" + _E0 + r"[a-z0-9_äöüß&.-]+ +(?:gmbh|ag|kg|e\.v\.)" + _E1 + ")"
EDITORIAL = "(" + _E0 + "(?:impressum|herausgeber|verantwortlich|redaktion|bekanntmachung|anlage|amtliche +mitteilung)" + _E1 + ")"
PUBLIC = "(" + _E0 + "(?:kreisverwaltung|ministerium|landesregierung|bezirksamt|landesbehörde|gefördert +(?:von|durch)|landes(?:mittel|verband|wappen))" + _E1 + ")"
DIRECTORY = "(" + _E0 + "(?:übersicht|verzeichnis|legende|stadtplan|karte)" + _E1 + ")"
UNCERTAIN = "(" + _E0 + r"(?:stadt|gemeinde|landkreis|kreisverwaltung|tourismus|tourist(?:ik)?|bürgermeister|gemeinnützig[a-zäöüß]*|ggmbh|e\.v\.|verein|stiftung|rotes +kreuz|caritas|diakonie|awo)" + _E1 + ")"

# Content that must be reviewed.
PRICE = r"([0-9]+([.,][0-9]{1,2})? ?(€|eur|euro|chf|tl)|(€|eur|euro|chf|tl) ?[0-9]+)"
IBAN = "(" + _E0 + "[a-z]{2}[0-9]{2}(?:[ -]?[a-z0-9]){11,30}" + _E1 + ")"
BANK = "(" + _E0 + "(?:iban|bic|konto|bank|bankverbindung)" + _E1 + ")"
VALIDITY = "(" + _E0 + "(?:gültig|gueltig|bis|deadline|frist|heute|vom|zeitraum)" + _E1 + ")"
VALID_FOR = "([0-9]|termin|beratung|aktion|angebot)"
CAMPAIGN = "(aktion|angebot|rabatt|sale|promotion|kampagne|indirim)"
FREE = ("kostenlos", "beratungstermin")

# What places are named after.
PLACE = "(?:Bezirksamt|Gemeinde|Stadt|Bezirk|[Ww]illkommen in) ([A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9_-]{2,}(?: [A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9_-]{2,}){0,2})"
#: Places named after a preposition too, for counting mentions.
MENTION = "(?:Bezirksamt|Gemeinde|Stadt|Bezirk|aus|in|nach|bei) ((?:Bad |Sankt )?[A-ZÄÖÜ][A-Za-zÄÖÜäöüß0-9_-]{2,})"
