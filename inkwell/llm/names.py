"""Variant spellings of one organisation or person, linked."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.contacts import field_values, load_object
from inkwell.plans.runtime import cut, discard, ship_package, skew_join, stored

# Legal forms, dropped from names.
LEGAL = re.compile(r"\bg\.? ?m\.? ?b\.? ?h\.?(?: ?(?:&|\+|und|u\.?) ?co\.?(?: ?k\.? ?g\.?)?)?(?!\w)|\bgesellschaft mbh\b|\bgesellschaft mit beschrankter haftung\b|\bug\b(?: ?\(?haftungsbeschr(?:ankt|\.)?\)?)?|\(?\bhaftungsbeschr(?:ankt|\.)?\)?|\bk\. ?g\.|\be\. ?k(?:fm|fr)?\.?(?!\w)|\bek\b|\bo\. ?h\. ?g\.|\b(?:ohg|kg|gbr|mbh|ag|ltd|inc|llc|e\.? ?v\.?)(?!\w)|(?:&|\+) ?co\b\.?(?: ?kg)?")
# Titles and what a practice is called.
TITLES = {"dr", "med", "dent", "prof", "dipl", "ing", "herr", "frau", "firma", "fa"}
PRACTICE = {"praxis", "gemeinschaftspraxis", "arztpraxis", "praxisgemeinschaft"}
FILLERS = {"u", "und", "kollegen", "koll", "kollege", "kollegin", "inh", "inhaber", "inhaberin", "co", "der", "die", "das", "am", "an", "im", "in", "zum", "zur", "von"}
# Lines of business, with abbreviations that aren't the beginning of the word.
TRADES = {
    "apotheke": "apo", "autohaus": "kfz", "baeckerei": "", "bestattungen": "bestatter bestattung", "buchhandlung": "buchhdlg buecher", "dachdeckerei": "dachdecker", "druckerei": "druck",
    "elektrotechnik": "elektro", "fahrschule": "", "gartenbau": "galabau", "hausverwaltung": "hv hausverw", "heizungsbau": "hzgbau heizung hzg", "hoerakustik": "hoergeraete", "hotel": "gasthof", "immobilien": "immo",
    "malerbetrieb": "maler", "metallbau": "", "metzgerei": "fleischerei", "optik": "optiker augenoptik", "pflegedienst": "pfldienst", "physiotherapie": "physio", "raumausstattung": "raumausstatter", "reisebuero": "",
    "sanitaetshaus": "sanhaus", "schreinerei": "tischlerei", "seniorenresidenz": "seniorenheim", "steinmetz": "", "steuerkanzlei": "stbkanzlei steuerberater stb kanzlei", "tagespflege": "", "taxi": "tx", "zimmerei": "",
    "augenarzt": "augenheilkunde augenaerztin", "zahnarzt": "zahnmedizin zahnaerztin", "internist": "innere medizin internistin", "orthopaede": "orthopaedie orthop orthopaedin",
}
MEDICAL = {"augenarzt", "zahnarzt", "internist", "orthopaede"}
# Short forms of first names.
NICKNAMES = {
    "alexander": "sascha sandro", "alexandra": "alex sandra", "andreas": "andi", "anna": "annie anni", "anton": "toni", "barbara": "babs baerbel", "benedikt": "bene", "benjamin": "ben benny", "brigitte": "gitte", "catherine": "cathy kate",
    "charles": "charlie chuck", "christian": "chris", "christine": "tine christl", "christopher": "kit", "daniel": "dan danny", "dorothea": "dorle doro thea", "edward": "ed eddie ted", "elisabeth": "lisbeth lisa sissi else", "elizabeth": "liz betty beth",
    "ferdinand": "ferdi", "franz": "franzl", "friedrich": "fritz", "gabriele": "gabi", "georg": "schorsch", "gerhard": "gerd", "guenter": "guenni", "heinrich": "heinz heiner", "hildegard": "hilde", "ignaz": "naz", "jakob": "jockel", "james": "jim jimmy",
    "johannes": "hannes hans", "john": "jack johnny", "josef": "sepp jupp", "josephine": "josi", "karl": "kalle", "katharina": "kathi kathrin", "konrad": "conny", "konstantin": "kosta", "leonhard": "hardy leo", "ludwig": "lutz", "manfred": "manni",
    "margaret": "maggie peggy", "margarete": "gretel meta grete", "martina": "tina", "matthias": "matze", "maximilian": "max", "michael": "michi mike", "nikolaus": "klaus niko", "patricia": "patty", "peter": "pit", "philippa": "pippa", "quirin": "quiri",
    "reinhard": "reiner", "richard": "dick rick", "robert": "bob bobby rob", "rudolf": "rudi", "sebastian": "basti", "siegfried": "siggi", "stefan": "steffen", "susanne": "susi sanne", "theodor": "theo", "thomas": "tom tommy", "ulrich": "uli",
    "ursula": "uschi ulla", "veronika": "vroni", "walter": "walt", "wilhelm": "willi willy", "william": "bill billy will", "wolfgang": "wolf",
}
_COMPOUNDS = re.compile(r"\b(san|hzg|stb|pfl)\.? ?-? ?(haus|bau|kanzlei|dienst)\b")
_OWNER = re.compile(r"\(\s*inh[^)]*\)?")
_OCR = str.maketrans({"1": "l", "0": "o", "5": "s", "6": "g", "8": "b", "|": "l", "!": "i", "@": "a"})


#: Words of one kind that are also looked for misspelt; bounds the index each task builds. Further ones are known as they stand.
NEAR_WORDS = 50_000
#: Letter triples are counted in as many cells, whatever the vocabulary.
CELLS = 1 << 18
#: Two edits in longer words are found over their halves instead of over all deletions of two letters.
LONG = 30
#: Two misspelt tokens of more than these are found over a fifth of them instead of over all pairs.
MANY = 16

_TOKEN = re.compile(r"[^\W_]+\.?")
_WORDS = re.compile(r"[^\W_]+")
_GARBLED = re.compile(r"(?<![^\s\-(\"„])[1!@|05][a-z]{2,}|[a-z]+[1!@|056][a-z]*[a-z1!@|056.]*")


def fold(name: str) -> str:
    low = " ".join(name.casefold().split())
    for a, b in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("é", "e"), ("è", "e"), ("ae", "a"), ("oe", "o"), ("ue", "u")):
        low = low.replace(a, b)
    return low


TRADE_OF = {fold(w): t for t, more in TRADES.items() for w in [t, *more.split()]}
FIRST_OF = {fold(w): n for n, more in NICKNAMES.items() for w in [n, *more.split()]}


def within(a: str, b: str, most: int = 2) -> int:
    """Edit distance with swaps of neighbours, most + 1 where it is larger than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        before = last
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletes(word: str, most: int) -> set[str]:
    """``word`` and what is left of it after deleting up to ``most`` letters, at least one staying."""
    out, last = {word}, {word}
    for _ in range(min(most, len(word) - 1)):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Vocabulary:
    """Roles of known words; words one edit away are found over a symmetric-delete index, two edits away (nine letters or more) among
    those that begin or end alike. Words in ``exact`` are known as they stand only."""

    def __init__(self, roles: dict[str, tuple[str, str]], exact: frozenset[str] = frozenset()) -> None:
        self.roles, self.index, self.ends = roles, {}, {}
        for w in roles:
            if w in exact:
                continue
            if len(w) >= 5:
                for d in deletes(w, 1):
                    self.index.setdefault(d, []).append(w)
            if len(w) >= 9:
                for end in (w[:3], "$" + w[-3:]):
                    self.ends.setdefault(end, []).append(w)
        self.cache: dict[str, tuple[str, str] | None] = {}

    def find(self, word: str) -> tuple[str, str] | None:
        if word in self.roles:
            return self.roles[word]
        if len(word) < 4:
            return None
        if word in self.cache:
            return self.cache[word]
        near = {w for i in range(len(word)) for w in self.index.get(word[:i] + word[i + 1 :], ())} | set(self.index.get(word, ()))
        best = min(((d, w) for w in near if (d := within(word, w, 1)) <= 1), default=None)
        if best is None and len(word) >= 8:
            ends = {*self.ends.get(word[:3], ()), *self.ends.get("$" + word[-3:], ())}
            close = sorted((d, w) for w in ends if (d := within(word, w, 2)) <= 2)
            # two edits tell towns apart only where no other is as near
            best = next((c for c in close if self.roles[c[1]][0] != "town" or (len(word) >= 12 and len(close) == 1)), None)
        found = self.roles[best[1]] if best else None
        if len(self.cache) < 300_000:
            self.cache[word] = found
        return found


class Parts(NamedTuple):
    """A name's parts. ``first``: the full first name, or its beginning and ``*``, or as it stands and ``?`` where the word isn't known as one;
    ``form``: the first name as it stands; ``tokens``: the name proper in order of the alphabet; ``short``: a token of it that is abbreviated."""

    kind: str
    trade: str
    first: str
    form: str
    town: str
    tokens: list[str]
    short: str = ""


class Parser:
    """Tells a name's parts apart: line of business or specialty, first name, town and what is left, the name proper.

    Known are the fixed words, the ``towns`` (the first NEAR_WORDS of them misspelt too) and the ``firsts`` (first names).
    """

    def __init__(self, towns: list[str], firsts: list[str] = ()) -> None:
        roles: dict[str, tuple[str, str]] = {}
        for words, role in ((TITLES | PRACTICE | {"kollegen"}, "title"), (FILLERS, "filler")):
            roles |= {w: (role, w) for w in words if w not in roles}
        roles |= {w: ("trade", t) for w, t in TRADE_OF.items()} | {w: ("first", f) for w, f in FIRST_OF.items()}
        single = [t for t in towns if " " not in t and t not in roles]
        roles |= {t: ("town", t) for t in single}
        two = [t.split(" ", 1) for t in towns if " " in t]
        roles |= {p: ("prefix", p) for p, _ in two if p not in roles}
        more = [f for f in firsts if f not in roles]
        roles |= {f: ("first", f) for f in more}
        self.words = Vocabulary(roles, frozenset(single[NEAR_WORDS:]) | frozenset(more))
        self.two = Vocabulary({p + r.replace(" ", ""): ("town", f"{p} {r}") for p, r in two}, frozenset(p + r.replace(" ", "") for p, r in two[NEAR_WORDS:]))

    def __call__(self, name: str) -> Parts | None:
        """The parts of ``name``; None where no name proper is left.

        Persons are names with a title or a medical specialty, and names of two or three words without a line of business of which one is a known
        first name, an initial that leads or follows a comma. Where none of a titled person's words is a known first name, the one that
        stands where first names do is taken: after the comma, else after the title, else the last.
        """
        low = _GARBLED.sub(lambda m: m[0].translate(_OCR), fold(name))
        low = _COMPOUNDS.sub(r"\1\2", LEGAL.sub(" ", _OWNER.sub(" ", low)))
        tokens = [(m[0].rstrip("."), m[0].endswith("."), m.start()) for m in _TOKEN.finditer(low)]
        comma = low.find(",")
        trade, first, form, town, person = "", "", "", "", False
        rest: list[tuple[str, bool, str, int]] = []
        skip, last_title = False, -1
        for i, (w, dotted, at) in enumerate(tokens):
            if skip:
                skip = False
                continue
            role, value = self.words.find(w) or ("", "")
            if role == "prefix" and not town and i + 1 < len(tokens) and (pair := self.two.find(value + tokens[i + 1][0])):
                town, skip = pair[1], True
            elif role == "title":
                person, last_title = True, at
            elif role == "town" and not town and len(w) >= 6:
                town = value
            elif role == "trade" or (not role and dotted and (value := _abbreviated(w))):
                trade = trade or value
            elif role != "filler" and not w.isdigit():
                rest.append((w, dotted, value if role == "first" else "", at))
        person = person or trade in MEDICAL
        if not person and not trade and 2 <= len(rest) <= 3:
            initial = [k for k, (w, dotted, _, at) in enumerate(rest) if dotted and len(w) <= 2 and (k == 0 or at > comma >= 0)]
            person = any(v for _, _, v, _ in rest) or bool(initial)
        short = ""
        if person:
            kept = []
            for w, dotted, name_of, at in rest:
                if not first and name_of and not (dotted and len(w) <= 3):
                    first, form = name_of, w
                elif not first and len(w) <= 3 and (dotted or len(rest) > 1):
                    first = w + "*"
                else:
                    kept.append((at, w))
            if not first and len(kept) == 2:
                (a, x), (b, y) = kept
                leads = not a < comma < b and last_title < a and 0 <= last_title
                first, form, kept = (f"{x}?", x, kept[1:]) if leads else (f"{y}?", y, kept[:1])
            words = [w for _, w in kept]
        else:
            cut_off = [w for w, dotted, _, _ in rest if dotted]
            words = [w for w, d, _, _ in rest if len(w) > 1 or not d]
            if len(cut_off) == 1 and len(rest) > 1:
                short = cut_off[0]
        if not words:
            return None
        return Parts("person" if person else "firm", trade, first, form, town, sorted(words), short)


@functools.cache
def _abbreviated(word: str) -> str | None:
    """The one line of business that a dotted word begins."""
    found = {t for w, t in TRADE_OF.items() if w.startswith(word) and w != word} if len(word) >= 3 else set()
    return found.pop() if len(found) == 1 else None


def token_cost(a: str, b: str) -> float:
    """0 for equal tokens, little for an initial or abbreviation of the other, the edit distance for near ones, 3 for different ones."""
    if a == b:
        return 0.0
    short, long = sorted((a.rstrip("*"), b.rstrip("*")), key=len)
    if ("*" in a or "*" in b) and long.startswith(short):
        return 0.1
    d = within(a, b, 2)
    return float(d) if d <= (1 if len(short) < 8 else 2) and len(short) >= 4 else 3.0


def assignment_cost(a: list[str], b: list[str]) -> float:
    """Least total cost of pairing the tokens of two names; a token left over costs 3. Equal tokens are paired first; where more than
    six are left on either side, all of those count as different."""
    left = Counter(b)
    left.subtract(a)
    a, b = sorted((-left).elements()), sorted((+left).elements())
    if len(a) > len(b):
        a, b = b, a
    if len(b) > 6:
        return 3.0 * len(b)

    @functools.cache
    def best(i: int, used: int) -> float:
        if i == len(a):
            return 3.0 * (len(b) - len(a))
        return min(token_cost(a[i], b[j]) + best(i + 1, used | 1 << j) for j in range(len(b)) if not used >> j & 1)

    return best(0, 0)


def _frequent(counted: DataFrame, least: int, known: set[str] = frozenset()) -> list[str]:
    """Words (word, n) with ``n`` of ``least`` or more, most frequent first, without those that are a misspelling of one five times as frequent
    or of a ``known`` one."""
    rows = counted.where((F.col("n") >= least) & (F.length("word") >= 3)).orderBy(F.desc("n"), "word").collect()
    kept: list[str] = []
    index: dict[str, list[tuple[str, float]]] = {}
    for w in known:
        for v in deletes(w, 1):
            index.setdefault(v, []).append((w, math.inf))
    for word, n in rows:
        ways = deletes(word, 1)
        if word in known or any(m >= 5 * n and within(word, t, 1) <= 1 for w in ways for t, m in index.get(w, ())):
            continue
        kept.append(word)
        for w in ways:
            index.setdefault(w, []).append((word, n))
    return kept


def learn_words(companies: DataFrame, least: int = 3) -> tuple[list[str], list[str]]:
    """(towns, first names) from the companies' own JSON: city values that at least ``least`` differently named companies have, and words
    that begin the names of at least ``least`` contact persons with different last names. Different names are counted, so
    repeated rows change nothing and no town is lost when others are added; both lists are as long as there are such places and first names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (obj := load_object(text)) is not None:
                    for field, value in field_values(obj):
                        if field == "city" and len(town := fold(value)) >= 4:
                            out.append(("town", town, fold(name or "")))
                        elif field == "contact_person" and len(words := _WORDS.findall(fold(value))) >= 2 and words[0] not in TITLES:
                            out.append(("first", words[0], words[-1]))
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "word", "of"])

    rows = companies.where("canonical_fields_json is not null").select("name", "canonical_fields_json").mapInArrow(read, "kind string, word string, of string")
    counted = cut(rows.distinct().groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")))
    towns = _frequent(counted.where("kind = 'town'").select("word", "n"), least)
    return towns, _frequent(counted.where("kind = 'first'").select("word", "n"), least, set(FIRST_OF))


PARSED = ("block", "first", "form", "town", "core", "tokens", "short")


def parse_spellings(spellings: DataFrame, towns: list[str], firsts: list[str] = ()) -> DataFrame:
    """``spellings``: name, n. Adds block (what two spellings must share to be compared: persons, or the firms of one line of business), first, form, town, core,
    tokens and short; names without a name proper have empty ones."""
    shared = spellings.sparkSession.sparkContext.broadcast((towns, firsts))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(*shared.value)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                p = parser(name)
                rows.append(("person|" if p.kind == "person" else f"firm|{p.trade}", p.first, p.form, p.town, "".join(p.tokens), " ".join(p.tokens), p.short) if p else ("",) * len(PARSED))
            columns = list(zip(*rows)) if rows else [[]] * len(PARSED)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in columns)], names=["name", "n", *PARSED])

    return spellings.mapInArrow(parse, "name string, n bigint, " + ", ".join(f"{c} string" for c in PARSED))


def expand_short(parsed: DataFrame) -> DataFrame:
    """``parsed`` with an abbreviated token of a firm's name written out where exactly one name of the same line of business holds the other
    tokens and one more that begins so; else it stays as it is (a single letter is dropped)."""
    other = F.array_join(F.filter(F.split("tokens", " "), lambda x: x != F.col("short")), "").alias("other")
    short = parsed.where("short <> ''").select("block", "core", "short", other, F.substring("short", 1, 1).alias("letter")).distinct()
    words = parsed.where("short = '' and startswith(block, 'firm') and contains(tokens, ' ')").select("block", F.col("core").alias("whole"), F.col("tokens").alias("all"), F.split("tokens", " ").alias("w")).distinct()
    one = words.select("block", "whole", "all", F.posexplode("w").alias("at", "token"), "w").select("block", "whole", "all", "token", F.array_join(F.filter("w", lambda x, i: i != F.col("at")), "").alias("other"), F.substring("token", 1, 1).alias("letter"))
    fits = short.join(one, ["block", "other", "letter"]).where(F.col("token").startswith(F.col("short")) & (F.col("token") != F.col("short")))
    only = cut(fits.groupBy("block", "core", "short").agg(F.min("whole").alias("whole"), F.max("whole").alias("last"), F.min("all").alias("all")).where("whole = last").drop("last"))
    if only.isEmpty():
        return parsed
    out = parsed.join(only, ["block", "core", "short"], "left")
    return out.select("name", "n", *[F.coalesce("whole", "core").alias("core") if c == "core" else F.coalesce("all", "tokens").alias("tokens") if c == "tokens" else c for c in PARSED])


def triple_cells(word: str) -> set[int]:
    w = f"^{word}$"
    return {zlib.crc32(w[i : i + 3].encode()) % CELLS for i in range(len(w) - 2)}


def oddness(cells: np.ndarray, core: str, parent: str) -> float:
    """How many times as frequent the rarest letter triple that only ``parent`` has is as the rarest that only ``core`` has, 1 at least. Both
    counts grow with the corpus, so a pair is judged alike at every size."""
    a, b = triple_cells(core), triple_cells(parent)
    own, usual = (min((max(1, int(cells[g])) for g in only), default=1) for only in (a - b, b - a))
    return max(1.0, usual / own)


def count_triples(cores: DataFrame) -> np.ndarray:
    """In how many names proper each letter triple stands; CELLS counts, whatever the corpus."""
    p = F.concat(F.lit("^"), "core", F.lit("$"))
    triples = cores.select(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))).alias("g"))
    out = np.zeros(CELLS, np.int64)
    for cell, n in triples.select(F.explode("g").alias("g")).groupBy((F.crc32(F.encode("g", "UTF-8")) % CELLS).alias("c")).count().collect():  # at most CELLS rows
        out[cell] = n
    return out


def ranked(cores: DataFrame, counts: np.ndarray) -> DataFrame:
    """``cores`` (block, core, n, tokens) with cid and rank: more frequent before rarer, of two as frequent the one whose letter triples are usual, which
    is the name that the others are misspellings of."""
    shared = cores.sparkSession.sparkContext.broadcast(counts)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            usual = [(n << 20) + min(min((int(cells[g]) for g in triple_cells(c)), default=0), (1 << 20) - 1) for c, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(usual, pa.int64())], names=[*batch.schema.names, "rank"])

    return cores.select("block", "core", "n", "tokens", F.xxhash64("block", "core").alias("cid")).mapInArrow(rank, "block string, core string, n bigint, tokens string, cid bigint, rank bigint")


_BASE = 0x9E3779B97F4A7C1B
_UNBASE, _UNBASE2 = np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64(pow(_BASE, -2, 1 << 64))


@functools.cache
def _letter(c: str) -> int:
    return xxhash.xxh3_64_intdigest(c)


def deletion_hashes(words: list[str], seeds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, hashes) of each word and of what is left of it after deleting one or (``most`` 2) two letters, seeded. Words of one length are
    done together: what is left is a sum of parts of the whole word's polynomial, so no string is built."""
    by_length: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by_length.setdefault(len(w), []).append(at)
    for n, at in by_length.items():
        x = np.array([[_letter(c) for c in words[k]] for k in at], np.uint64).reshape(len(at), n)
        powers = np.array([pow(_BASE, k, 1 << 64) for k in range(n)], np.uint64)
        sums = np.zeros((len(at), n + 1), np.uint64)
        np.cumsum(x * powers, axis=1, out=sums[:, 1:])
        whole = sums[:, n:]
        i = np.arange(n)
        parts = [(whole, n)]
        if most >= 1 and n > 1:
            parts.append((sums[:, i] + (whole - sums[:, i + 1]) * _UNBASE, n - 1))
        if most >= 2 and n > 2:
            i, j = np.triu_indices(n, 1)
            parts.append((sums[:, i] + (sums[:, j] - sums[:, i + 1]) * _UNBASE + (whole - sums[:, j + 1]) * _UNBASE2, n - 2))
        for h, left in parts:
            h = (h ^ (h >> np.uint64(31)) ^ np.uint64((left * 0xD6E8FEB86659FD93) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9) + seeds[at][:, None]
            yield np.repeat(np.array(at), h.shape[1]), (h ^ (h >> np.uint64(29))).ravel()


_WHOLE, _PREFIX, _SUFFIX, _ONE_TOKEN, _TWO_TOKENS, _MANY_TOKENS = (xxhash.xxh3_64_intdigest(k) for k in ("whole", "prefix", "suffix", "one token", "two tokens", "many tokens"))
_ALL = (1 << 64) - 1


def _whole_keys(word: str, edits: int, seed: int) -> Iterator[tuple[str, int, int]]:
    """(string, letters to delete, seed): two words up to ``edits`` apart share a string so shortened. Of two edits in a long word one half has one at most; where the halves
    meet depends on the edits, so four lengths of each are taken."""
    if edits < 2 or len(word) <= LONG:
        yield word, edits, (seed + _WHOLE) & _ALL
    if edits == 2 and len(word) > LONG - 2:
        half = len(word) // 2
        for k in range(-1, 3):
            yield word[: half + k], 1, (seed + _PREFIX) & _ALL
            yield word[half - k + 1 :], 1, (seed + _SUFFIX) & _ALL


def _halves(word: str) -> np.ndarray:
    """Hashes of beginnings and ends of half a word, of which one edit spares one."""
    n = len(word)
    return np.array([xxhash.xxh3_64_intdigest(x) for h in {(n + k) // 2 for k in (-1, 0, 1)} for x in (f"<{word[:h]}", f">{word[-h:]}")], np.uint64)


def index_keys(core: str, tokens: list[str], edits: int, seed: int) -> tuple[list[tuple[str, int, int]], list[np.ndarray]]:
    """What a name proper is found by: (strings with the letters to delete and a seed, hashes as they stand). Any two that are up to ``edits`` (1 or 2) apart as strings
    or by ``assignment_cost`` share one. Tokens in any order: all but one stand and that one is shortened; for two edits in two tokens, all but two stand and one half
    of either. Of many tokens two edits spare one fifth, dealt by their hashes. Tokens under four letters have no misspellings."""
    shorten, exact = list(_whole_keys(core, edits, seed)), []
    if len(tokens) < 2:
        return shorten, exact
    own = [xxhash.xxh3_64_intdigest(t) for t in tokens]
    whole = sum(own) + seed
    long = [k for k, t in enumerate(tokens) if len(t) >= 4]
    for k in long:
        shorten += _whole_keys(tokens[k], edits if len(tokens[k]) >= 8 else 1, (whole - own[k] + _ONE_TOKEN) & _ALL)
    if edits == 2 and len(tokens) > MANY:
        fifths = [0] * 5
        for h in own:
            fifths[h % 5] += h
        exact.append(np.array([(x * (k + 1) + seed + len(tokens) * _MANY_TOKENS) & _ALL for k, x in enumerate(fifths)], np.uint64))
    elif edits == 2:
        parts = {k: _halves(tokens[k]) - np.uint64(own[k]) for k in long}
        exact += [(parts[i][:, None] + parts[j][None, :]).ravel() + np.uint64((whole + _TWO_TOKENS) & _ALL) for i, j in combinations(long, 2)]
    return shorten, exact


def _hooks(cores: DataFrame, most: int, rule: Callable[[str, str, int, int, int, Callable[[str, str], float]], bool], counts: np.ndarray, children: F.Column | None = None, parents: F.Column | None = None) -> DataFrame:
    """(cid, parent_id): for each core of ``children`` the nearest, then highest, of those ``parents`` (conditions on columns of ``cores``; all, where not given) that share its block, are up to
    ``most`` edits away as strings or by their tokens, rank higher (of two that rank alike, the one of smaller hash) and that ``rule`` (core, parent, n, m, edits, how odd a core
    is against a parent) lets be its parent. Names proper under four letters have no misspellings.

    Keys are shuffled and sorted once as hashes; every pair that shares a key is verified. A key is what is left of a whole name or of a name but for one or two misspelt tokens, so
    pairs are about as many as names that lie twice ``most`` edits apart, however often each is repeated."""
    shared = cores.sparkSession.sparkContext.broadcast(counts)
    cores = cores.withColumns({"child": F.lit(True) if children is None else children, "parent": F.lit(True) if parents is None else parents}).where("(child or parent) and length(core) >= 4")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                at, keys, ways = [], [], {1: ([], [], []), 2: ([], [], [])}
                for row, (block, core, token_lists) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)))):
                    for tokens in token_lists.split("|"):
                        shorten, exact = index_keys(core, tokens.split(" "), most, xxhash.xxh3_64_intdigest(block))
                        for word, edits, seed in shorten:
                            rows, words, seeds = ways[edits]
                            rows.append(row)
                            words.append(word)
                            seeds.append(seed)
                        keys += exact
                        at += [np.full(len(h), row) for h in exact]
                for edits, (rows, words, seeds) in ways.items():
                    rows, seeds = np.array(rows, np.int64), np.array(seeds, np.uint64)
                    for where, h in deletion_hashes(words, seeds, edits):
                        at.append(rows[where])
                        keys.append(h)
                at, keys = np.concatenate(at), np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(keys)], names=["cid", "rest"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(pairs: list[np.ndarray]) -> pa.RecordBatch:
            both = np.sort(np.concatenate([np.empty((0, 2), np.int64), *pairs]), axis=1)
            both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["one", "other"])

        cid, rest = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            before = len(cid)  # of the run that the previous batch ended in; its pairs are told
            cid, rest = np.concatenate([cid, batch.column(0).to_numpy()]), np.concatenate([rest, batch.column(1).to_numpy()])
            pairs, at, j, n = [], np.arange(len(cid)), 1, 0
            while len(at := at[: np.searchsorted(at, len(cid) - j)]) and len(at := at[rest[at] == rest[at + j]]):
                fresh = at[at + j >= before]
                pairs.append(np.stack([cid[fresh], cid[fresh + j]], 1))
                j, n = j + 1, n + len(fresh)
                if n > 1 << 20:
                    yield told(pairs)
                    pairs, n = [], 0
            yield told(pairs)
            if len(rest):
                last = np.searchsorted(rest, rest[-1])
                cid, rest = cid[last:], rest[last:]

    ways = cores.select("cid", "block", "core", "tokens").mapInArrow(spread, "cid bigint, rest bigint")
    links = ways.repartition("rest").sortWithinPartitions("rest").mapInArrow(meet, "one bigint, other bigint").distinct()
    facts = cores.select("cid", F.struct("rank", F.bitwise_not("cid").alias("order"), "cid", "core", "n", "tokens", "child", "parent").alias("f"))
    named = links.join(facts.toDF("one", "f"), "one").join(facts.toDF("other", "g"), "other").select(F.least("f", "g").alias("low"), F.greatest("f", "g").alias("high")).where("low.child and high.parent")
    named = named.select("low.cid", F.col("high.cid").alias("parent_id"), "low.core", "low.n", F.col("high.core").alias("parent"), F.col("high.n").alias("m"), "low.tokens", F.col("high.tokens").alias("others"), F.col("high.rank").alias("above"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = functools.partial(oddness, shared.value)
        for batch in batches:
            keep, found = [], []
            for row, (c, n, p, m, a, b) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(2, 8)))):
                d = within(c, p, most)
                if d > most and (" " in a or " " in b):
                    d = min(math.ceil(assignment_cost(x.split(" "), y.split(" "))) for x in a.split("|") for y in b.split("|"))
                if d <= most and rule(c, p, n, m, d, odd):
                    keep.append(row)
                    found.append(d)
            out = batch.select(["cid", "parent_id", "above"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(found, pa.int32())], names=["cid", "parent_id", "above", "d"])

    checked = named.mapInArrow(verify, "cid bigint, parent_id bigint, above bigint, d int")
    return checked.groupBy("cid").agg(F.max(F.struct((-F.col("d")).alias("near"), "above", "parent_id")).alias("b")).select("cid", "b.parent_id")


def one_edit(core: str, parent: str, n: int, m: int, d: int, odd: Callable[[str, str], float]) -> bool:
    """Names proper of eight letters or more that are one edit apart are variants; shorter ones, of four at least, if their frequencies and letter triples differ by four together."""
    shorter = min(len(core), len(parent))
    return shorter >= 8 or shorter >= 4 and m * odd(core, parent) >= 4 * n


def two_edits(core: str, parent: str, n: int, m: int, d: int, odd: Callable[[str, str], float]) -> bool:
    return len(core) >= 8 and 2 * m >= 3 * n and m * odd(core, parent) >= 8 * n


def in_place(core: str, parent: str, n: int, m: int, d: int, odd: Callable[[str, str], float]) -> bool:
    return m >= 2 * n or m * odd(core, parent) >= 2 * n


def _roots(cores: DataFrame, hooks: DataFrame) -> DataFrame:
    """(cid, root): each core followed up its hooks; every hook leads to a core that ranks higher or, if alike, is of smaller hash."""
    tree = cut(cores.select("cid").join(hooks, "cid", "left").select("cid", F.coalesce("parent_id", "cid").alias("root")))
    while True:
        up = tree.select(F.col("cid").alias("root"), F.col("root").alias("above"))
        step = cut(tree.join(up, "root").select("cid", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        discard(tree)
        tree = step
        if step.where("moved").isEmpty():
            return tree.select("cid", "root")


def _places(placed: DataFrame, cores: DataFrame, counts: np.ndarray) -> DataFrame:
    """(root, town, better): roots of misspelt names of places with the right ones. A name that three towns or more have is misspelt often in all of them
    together, so its misspellings look like names of their own; within one town they are rare, and two edits tell little apart there."""
    firms = cut(placed.where("startswith(block, 'firm|') and block <> 'firm|' and town <> ''").groupBy("block", "town", "root").agg(F.sum("n").alias("n")))
    known = firms.groupBy("block", "root").agg(F.count(F.lit(1)).alias("towns")).where("towns >= 3").select("block", "root", F.lit(True).alias("known"))
    here = firms.join(known.select("block").distinct(), "block", "left_semi").join(known.drop("block"), "root", "left")
    strings = cores.select(F.col("cid").alias("root"), "core", "tokens")
    pool = cut(here.join(strings, "root").where("known or length(core) >= 6").select(F.concat_ws("|", "block", "town").alias("block"), "core", "n", "tokens", "root", "town", "known"))
    ids = pool.select(F.xxhash64("block", "core").alias("cid"), "root", "town", "known")
    rows = cut(ranked(pool, counts).join(ids.select("cid", "known"), "cid"))
    hooks = _hooks(rows, 2, in_place, counts, F.col("known").isNull(), F.col("known").isNotNull())
    wrong = hooks.join(ids.where("known is null"), "cid").join(ids.where("known").select(F.col("cid").alias("parent_id"), F.col("root").alias("better")), "parent_id")
    return wrong.select("root", "town", "better")


def _first_names(people: DataFrame) -> DataFrame:
    """(root, first, who) of ``people`` (root, first, form): for beginnings of first names the one full first name of the family name they fit (none: themselves,
    several: null), for words that aren't known as first names the one known name within two edits (short ones: one), else themselves."""
    letter = F.substring("first", 1, 1).alias("letter")
    full = people.where("not endswith(first, '*')").withColumn("sure", ~F.col("first").endswith("?")).withColumn("full", F.regexp_replace("first", r"\?$", ""))
    full = full.select("root", "full", "form", "sure", F.explode(F.array_distinct(F.array(F.substring("full", 1, 1), F.substring("form", 1, 1)))).alias("letter")).distinct()
    ask = people.where("endswith(first, '*') or endswith(first, '?')").select("root", "first", letter).distinct().withColumn("word", F.regexp_replace("first", r"[*?]$", ""))
    begins = F.col("first").endswith("*") & (F.col("full").startswith(F.col("word")) | F.col("form").startswith(F.col("word")))
    near = F.col("first").endswith("?") & F.col("sure") & (F.levenshtein("form", "word") <= F.when(F.length("word") >= 6, 2).otherwise(1))
    known = F.when(F.col("sure"), F.col("full"))
    pick = ask.join(full, ["root", "letter"], "left").withColumn("full", F.when(begins | near, F.col("full"))).groupBy("root", "first").agg(F.min("full").alias("lo"), F.max("full").alias("hi"), F.min(F.when(F.col("full").isNotNull(), known)).alias("k_lo"), F.max(F.when(F.col("full").isNotNull(), known)).alias("k_hi"))
    own = F.regexp_replace("first", r"\?$", "")
    who = F.when(F.col("lo").isNull(), own).when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("k_lo") == F.col("k_hi"), F.col("k_lo")).when(F.col("first").endswith("?"), own)
    return pick.select("root", "first", who.alias("who"))


def name_entities(companies: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(name, entity): every spelling with the entity it means, a 64-bit hash; spellings with the same entity mean the same organisation or person.

    A name's parts are told apart first: legal form and titles (dropped), line of business, first name, town and the name proper, each with
    its abbreviations, short forms and misspellings. Names proper are linked within one line of business (persons: all together) when one edit
    apart, those under eight letters only where the rarer is much rarer or of rarer letter triples; two edits, where it is rarer and its
    letter triples are, together eight times at least. No rule looks at a count by itself, so a table repeated any number of times has the same links.
    Persons then need the same first name, an initial counting where one first name fits; where a name proper occurs in several towns,
    the town must be the same. Names of firms without a known line of business are linked likewise among themselves, where their name proper isn't that of a firm
    with one. Spellings without such parts, or that fit several, are linked to those of the same words (firms in several towns: to equal ones, but for case and spacing) only.
    """
    towns, firsts = learn_words(companies)
    named = companies.where("id is not null").select(F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("normalized_name")).alias("name")).unionByName(occurrences.where("id is not null").select(F.col("company").alias("name")))
    spellings = named.where("trim(name) <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parsed = expand_short(stored(parse_spellings(spellings, towns, firsts), "names")).withColumn("cid", F.xxhash64("block", "core"))
    cores = cut(parsed.where("core <> ''").groupBy("block", "core").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("tokens")), "|").alias("tokens")))
    counts = count_triples(cores)
    cores = stored(ranked(cores, counts), "names")
    near = cut(_hooks(cores, 1, one_edit, counts))
    # what one edit didn't explain may be two edits away from a name that is more frequent, its letter triples too, together eight times at least
    # (also one that is itself a misspelling); no parent is rarer than the rule asks for the rarest child
    left = cut(cores.join(near.select("cid", F.lit(True).alias("hooked")), "cid", "left"))
    child = F.col("hooked").isNull() & (F.length("core") >= 8)
    rarest = left.where(child).agg(F.min("n")).first()[0] or 0
    roots = _roots(cores, near.unionByName(_hooks(left, 2, two_edits, counts, child, (F.length("core") >= 6) & (2 * F.col("n") >= 3 * rarest))))
    # one row for each combination of parts, without the spellings
    parts = parsed.where("core <> ''").groupBy("block", "cid", "first", "form", "town").agg(F.sum("n").alias("n"))
    placed = cut(parts.join(roots, "cid"))
    better = _places(placed, cores, counts)
    placed = cut(placed.join(better, ["root", "town"], "left").withColumn("root", F.coalesce("better", "root")).drop("better"))
    spread = placed.groupBy("root").agg(F.count_distinct(F.nullif("town", F.lit(""))).alias("towns"))
    people = placed.where("block = 'person|' and first <> ''").select("root", "first", "form").distinct()
    full = placed.select("block", "cid", "root", "first", "town").distinct().join(spread, "root").join(_first_names(people), ["root", "first"], "left")
    who = F.when(F.col("first").rlike(r"[*?]$"), F.col("who")).when(F.col("first") != "", F.col("first"))
    where = F.when(F.col("towns") <= 1, F.lit("")).when(F.col("town") != "", F.col("town"))
    entity = F.when(F.col("block") == "person|", F.when(who.isNotNull(), F.xxhash64("root", who))).when(where.isNotNull(), F.xxhash64("root", where))
    # names without a line of business: that of the only name proper like theirs, or like one linked to theirs; where there is none at all, they are firms by themselves
    words = cores.where("startswith(block, 'firm|')").select("block", "cid", F.xxhash64("core").alias("word"))
    listed = words.where("block <> 'firm|'").join(placed.select("cid", "root").distinct(), "cid").groupBy("word").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    bare = words.where("block = 'firm|'").join(listed, "word").select("cid", "lo", "hi").join(placed.where("block = 'firm|'").select("cid", "root").distinct(), "cid")
    family = bare.groupBy("root").agg(F.min("lo").alias("f_lo"), F.max("hi").alias("f_hi"))
    own = bare.where("lo = hi").select("cid", "lo").distinct()
    alone, one_place = F.col("block") == "firm|", F.col("towns") <= 1
    linked = F.when(F.col("lo").isNotNull() & one_place, F.xxhash64("lo", F.lit(""))).when(F.col("f_lo").isNull(), entity).when((F.col("f_lo") == F.col("f_hi")) & one_place, F.xxhash64("f_lo", F.lit("")))
    listed_firms = full.where(~alone).select("cid", "first", "town", entity.alias("entity"))
    resolved = listed_firms.unionByName(full.where(alone).join(own, "cid", "left").join(family, "root", "left").select("cid", "first", "town", linked.alias("entity")))
    bag = F.array_join(F.array_sort(F.regexp_extract_all(F.lower("name"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))), " ")
    same = F.when(F.col("block").startswith("firm") | (bag == ""), F.xxhash64(F.lit("same"), F.lower(F.regexp_replace(F.trim("name"), r"\s+", " ")))).otherwise(F.xxhash64(F.lit("words"), bag))
    return parsed.select("name", "block", "cid", "first", "town").join(resolved.where("entity is not null"), ["cid", "first", "town"], "left").select("name", F.coalesce("entity", same).alias("entity"))


def link_names(companies: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(kind, left_id, right_id), distinct: ``company-company`` with the smaller id left, ``occurrence-company`` with the occurrence left.

    Rows without id or name give nothing. An advertiser with any share of the occurrences or companies is spread over many tasks.
    """
    ship_package(companies.sparkSession)
    entities = stored(name_entities(companies, occurrences), "names")
    name = F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("normalized_name")).alias("name")
    ours = cut(skew_join(companies.where("id is not null").select(F.col("id").cast("bigint"), name).distinct(), entities, ["name"], "id").select("id", "entity").distinct())
    theirs = cut(skew_join(occurrences.where("id is not null and company is not null").select(F.col("id").cast("bigint"), F.col("company").alias("name")).distinct(), entities, ["name"], "id").select("id", "entity").distinct())
    right = ours.select(F.col("id").alias("right_id"), "entity")
    both = skew_join(ours.select(F.col("id").alias("left_id"), "entity"), right, ["entity"], "left_id").where("left_id < right_id").select(F.lit("company-company").alias("kind"), "left_id", "right_id")
    cross = skew_join(theirs.select(F.col("id").alias("left_id"), "entity"), right, ["entity"], "left_id").select(F.lit("occurrence-company").alias("kind"), "left_id", "right_id")
    return both.unionByName(cross).distinct()
