from __future__ import annotations

import json
import math
import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from inkwell.llm import names as N
from inkwell.llm.names import Parser, assignment_cost, deletes, deletion_hashes, link_names, token_cost, within

COMPANY = "id bigint, name string, normalized_name string, canonical_fields_json string, entity string"
OCC = "id bigint, company string, preview string, left_id int"


def slow(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance_and_deletion_index(a, b):
    assert within(a, b, 2) == min(slow(a, b), 3)
    for k in (1, 2):
        if a and b and slow(a, b) <= k and min(len(a), len(b)) > k:
            assert deletes(a, k) & deletes(b, k)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=8), max_size=6), st.integers(1, 2))
def test_hashes_of_deletions_are_those_of_the_strings(words, most):
    def hashes(some, edits):
        got = {}
        for at, h in deletion_hashes(some, np.full(len(some), 7, np.uint64), edits):
            for k, v in zip(at.tolist(), h.tolist()):
                got.setdefault(k, set()).add(v)
        return got

    got = hashes(words, most)
    for k, w in enumerate(words):
        left = sorted(deletes(w, most) if len(w) > most else deletes(w, len(w) - 1))
        own = hashes(left, 0)
        assert got[k] == {v for hs in own.values() for v in hs} and len(got[k]) == len(left)


def test_assignment():
    assert assignment_cost(["zimmerei", "bauer"], ["bauer", "zimmerei"]) == 0
    assert assignment_cost(["u*", "mustermann"], ["mustermann", "ursula"]) == 0.1
    assert assignment_cost(["mustermann"], ["musterman", "hotel"]) == 4
    assert token_cost("ab", "ac") == 3


def test_assignment_of_many_tokens():
    words = [f"wort{i}" for i in range(40)]
    assert assignment_cost(words, words[::-1]) == 0
    assert assignment_cost(words, [*words[:-1], "worte39"]) == 1
    assert assignment_cost(words[:8], words[20:28]) == 24


def test_parts():
    p = Parser(["altach", "bad altach", "neualtach"], ["alois"])
    brief = lambda name: (lambda x: (x.kind, x.trade, x.first, x.town, "".join(x.tokens)))(p(name))
    assert brief("  GALABAU Klaukitzell GmbH & Co. KG (Inh. C. Klaukitzell)")[:2] == ("firm", "gartenbau")
    assert brief("Gartenbau-Klaukitzell")[4] == brief("klaukitzell, gartenbau e.K., Altach")[4] == "klaukitzell"
    assert brief("Dr. med. Uschi Grokokeder, Zahnmedizin") == ("person", "zahnarzt", "ursula", "", "grokokeder")
    assert brief("Grokokeder, Ur., Dr.") == ("person", "", "ur*", "", "grokokeder")
    assert brief('Hotel "Alte Post" Bad Altach')[3:] == brief("Bad A1tach Hotel Alte Post")[3:] == ("bad altach", "altepost")
    assert p("") is None and p(" , . ") is None
    assert brief("Brettschneider, Hans") == brief("Hans Brettschneider") == ("person", "", "johannes", "", "brettschneider")
    assert brief("H. Brettschneider")[2:] == ("h*", "", "brettschneider")
    assert brief("Dr. Alois Zwirngiebl")[2:] == brief("Zwirngiebl Alois Dr.")[2:] == ("alois", "", "zwirngiebl")
    assert brief("Dr. Wendelin Zwirngiebl") == brief("Zwirngiebl Wendelin, Dr.") == brief("Zwirngiebl, Wendelin, Dr.") == ("person", "", "wendelin?", "", "zwirngiebl")
    assert p("Baeckerei K. Mueller").short == "k" and p("Schm. Bau").short == "schm"


NAMES = [
    ("gartenbau", ["Gartenbau Klaukitnaffzell GmbH", "GaLaBau Klaukitnaffzell", "Klaukitnaffzell, Gartenbau GmbH & Co. KG", "GARTENBAU-KLAUKITNAFFZELL", "Gartnbau Klaukitnafzell", "Gartenbau Klaukitnaffzell GmbH"]),
    ("druck", ["Druckerei Klaukitnaffzell", "Druck Klaukitnaffzell e.K."]),
    ("ursula", ["Dr. med. Ursula Grokokrarbeder, Zahnmedizin", "Praxis Dr. Uschi Grokokrarbeder", "Grokokrarbeder, Ur., Dr.", "Zahnarzt Dr. Ursula Grokokrabeder Altach"]),
    ("wilhelm", ["Dr. Wilhelm Grokokrarbeder", "Gemeinschaftspraxis Willi Grokokrarbeder u. Kollegen"]),
    ("post altach", ['Hotel "Alte Post" Altach', "Altach Hotel Alte Post", "Alte Post (Hotel) Altach"]),
    ("post bad altach", ["Hotel Alte Post Bad Altach", "hotel alte post, bad a1tach"]),
    ("none", ["Unbekannte Firma", "unbekannte  firma"]),
]


def test_links(spark):
    companies, occurrences, truth, n = [], [], set(), 0
    city = [json.dumps({"city": c}) for c in ("Altach", "Bad Altach")]
    for _, spellings in NAMES:
        ids, ads = [], []
        for k, s in enumerate(spellings):
            n += 1
            if k % 2 == 0 or k == 5:
                companies.append((n, s, "stale", city[n % 2], "x"))
                ids.append(n)
            else:
                occurrences.append((n, s, "p", 1))
                ads.append(n)
        truth |= {("company-company", a, b) for a, b in combinations(sorted(ids), 2)} | {("occurrence-company", a, c) for a in ads for c in ids}
    companies += [(500 + k, None, "", json.dumps({"city": c}), "") for k, c in enumerate(["Altach", "Bad Altach"] * 4)] + [companies[0], (None, "Gartenbau Klaukitnaffzell", "", None, "")]
    occurrences += [(600, None, "", 0), (601, "", "", 0), (None, "Druckerei Klaukitnaffzell", "", 0), occurrences[0], (602, "wort " * 3000, "", 0), (603, "x" * 20_000, "", 0), (604, " ".join(f"w{i}" for i in range(2000)), "", 0)]
    got = [tuple(r) for r in link_names(spark.createDataFrame(companies, COMPANY), spark.createDataFrame(occurrences, OCC)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == truth


def test_one_advertiser_with_most_adverts(spark):
    companies = spark.createDataFrame([(1, "Optik Spafomlikeder", "", None, ""), (2, "Spafomlikeder Opt.", "", None, ""), (3, "Taxi Jonorbgekper", "", None, "")], COMPANY)
    ads = spark.createDataFrame([(100 + i, "Optik Spafomlikeder" if i % 3 else "TAXI-JONORBGEKPER", "", 0) for i in range(30_000)], OCC)
    kinds = {r[0]: r[1] for r in link_names(companies, ads).groupBy("kind").count().collect()}
    assert kinds == {"company-company": 1, "occurrence-company": 50_000}


def test_nothing(spark):
    assert link_names(spark.createDataFrame([], COMPANY), spark.createDataFrame([], OCC)).count() == 0


def test_misspelling_that_changes_the_order_of_tokens(spark):
    names = ["Hotel Alte Post Altach", "Hotel Zlte Post Altach", "Hotel Alte Post, Altach", "Hotel Neue Post Altach", "Hotel Neue Post Altach"]
    companies = [(i, n, "", json.dumps({"city": "Altach"}), "") for i, n in enumerate(names)]
    got = {tuple(r)[1:] for r in link_names(spark.createDataFrame(companies, COMPANY), spark.createDataFrame([], OCC)).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4)}


def test_misspelling_two_edits_away_that_is_repeated(spark):
    ads = [(i, "Heizungsbau Breigasnunaumer" if i > 5 else "Heizungsbau Breigasnunauer", "", 0) for i in range(1, 60)]
    ads += [(i, "Heizungsbau Breigisnonaumer", "", 0) for i in range(60, 75)]  # a quarter as frequent, of usual letters: a name of its own
    companies = [(1, "Breigasnunaumer Heizung", "", None, ""), (2, "Heizung Breigasnunauer", "", None, ""), (3, "Heizungsbau Breigisnonaumer", "", None, "")]
    got = [tuple(r) for r in link_names(spark.createDataFrame(companies, COMPANY), spark.createDataFrame(ads, OCC)).collect()]
    assert set(got) == {("company-company", 1, 2)} | {("occurrence-company", a, c) for a in range(1, 60) for c in (1, 2)} | {("occurrence-company", a, 3) for a in range(60, 75)}


def test_firms_of_other_lines_of_business(spark):
    friseur = ["Friseur Klaukitnaffzell GmbH", "Klaukitnaffzell, Friseur e.K.", "FRISEUR-KLAUKITNAFZELL", "Friseur Klaukitnaffzell GmbH"]
    spedition = ["Spedition Grokokrarbeder Altach", "Grokokrarbeder Spedition KG, Altach", "Spedition Grokokrarbeder Bad Altach"]
    optik = ["Optik Spafomlikeder", "Spafomlikeder GmbH", "Spafomlikder GmbH", "Taxi Jonorbgekper", "Druckerei Jonorbgekper", "Jonorbgekper KG", "Jonorbgekper GmbH"]
    names = friseur + spedition + optik
    companies = [(i, n, "", json.dumps({"city": ("Altach", "Bad Altach")[i % 2]}), "") for i, n in enumerate(names)]
    got = {tuple(r)[1:] for r in link_names(spark.createDataFrame(companies, COMPANY), spark.createDataFrame([], OCC)).collect()}
    assert got == {*combinations(range(4), 2), (4, 5), *combinations(range(7, 10), 2)}


PAIRS = [
    ("Kowalski Logistik", "Logistik Kowalsky"), ("Nordwind Werke GmbH", "Nordwnd Werke"), ("Hans Brettschneider", "Brettschneider, Hans"), ("Hans Brettschneider", "H. Brettschneider"), ("Brettschneider, Hans", "H. Brettschneider"),
    ("William Featherstone", "Bill Featherstone"), ("Dr. Alois Zwirngiebl", "Zwirngiebl Alois Dr."), ("Dr. Wendelin Oberhuber", "Oberhuber, We., Dr."), ("Autohaus Brettschneider", "Autohaus Bretschneider"),
    ("Apotheke zum Heiligen Geist neben dem Alten Rathaus", "Apotheke zum Heiligen Geist neben dem Altem Rathaus"), ("Apotheke zum Heiligen Geist neben dem Alten Rathaus", "Zpotheke Rathaus Altem Geist Heiligen dem neben zum"),
    ("Bäckerei K. Grünwaldner", "Bäckerei Karl Grünwaldner"), ("Verein der Freunde und Foerderer der Musikschule Altach am Berg und Umgebung mit Sitz in Altach", "Verein der Freunde und Foerderer der Musikschule Altach am Berg und Umgebung mit Sizt in Altach"),
]
OTHERS = [("Hans Brettschneider", "Autohaus Brettschneider"), ("Kowalski Logistik", "Nordwind Werke GmbH"), ("William Featherstone", "Dr. Alois Zwirngiebl"), ("Hans Brettschneider", "Karl Brettschneider"), ("Optik Maier", "Optik Meier")]


def linked(spark, names, times=1):
    rows = [(k * 10_000 + i, n, "", json.dumps({"city": "Altach"}), "") for k in range(times) for i, n in enumerate(names)]
    got = link_names(spark.createDataFrame(rows, COMPANY), spark.createDataFrame([], OCC)).where("left_id < 10000 and right_id < 10000")
    return {frozenset((names[r[1]], names[r[2]])) for r in got.collect()}


def test_names_that_no_word_list_knows(spark):
    got = linked(spark, sorted({n for pair in PAIRS + OTHERS for n in pair}))
    assert not [p for p in PAIRS if frozenset(p) not in got]
    assert not [p for p in OTHERS if frozenset(p) in got]


def test_repeated_tables_have_the_same_links(spark):
    names = sorted({n for _, s in NAMES for n in s} | {n for pair in PAIRS for n in pair}) + [f"Optik Spafomlikeder{x}" for x in ("", "", " GmbH", " GmbH", " KG", "")] + ["Optik Spafomlikdeer", "Optik Spafomlikder", "Optik Spafmlikdeer", "Hotel Krone", "Hotel Krohne"]
    names = [f"{n} " if n in names[:i] else n for i, n in enumerate(names)]
    once = linked(spark, names)
    assert len(once) > 40
    for times in (4, 10):
        assert linked(spark, names, times) == once


def edited(rng, word, letters):
    """``word`` with one letter changed, dropped, added or swapped with the next."""
    i = rng.randrange(len(word))
    return rng.choice((word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]))


def test_names_near_each_other_share_a_key():
    def keys(tokens, edits):
        shorten, exact = N.index_keys("".join(sorted(tokens)), sorted(tokens), edits, 5)
        return {(seed, left) for word, most, seed in shorten for left in deletes(word, most)} | {int(x) for h in exact for x in h}

    rng = random.Random(1)
    for turn in range(400):
        edits, size = 1 + turn % 2, rng.choice((1, 1, 2, 3, 5, 18))
        before = ["".join(rng.choices("abc", k=rng.randrange(4, 45 if size == 1 else 14))) for _ in range(size)]
        after = list(before)
        for _ in range(rng.randrange(1, edits + 1)):
            k = rng.randrange(size)
            after[k] = edited(rng, after[k], "abc") or after[k]
        if size > 1 and min(map(len, before + after)) < 4:
            continue
        near = within("".join(sorted(before)), "".join(sorted(after)), edits) <= edits or assignment_cost(before, after) <= edits
        if near and min(len("".join(before)), len("".join(after))) >= 4:
            assert keys(before, edits) & keys(after, edits), (edits, before, after)


def test_links_are_those_of_all_pairs(spark):
    rng, names = random.Random(2), {"altepost"}
    for size in (1, 1, 1, 2, 3, 5):
        for _ in range(4):
            word = ["".join(rng.choices("abcdefgh", k=rng.randrange(4, 12))) for _ in range(size)]
            for _ in range(25):
                near = list(word)
                for _ in range(rng.randrange(4)):
                    k = rng.randrange(size)
                    near[k] = edited(rng, near[k], "abcdefgh") or near[k]
                names.add(" ".join(sorted(near)))
    rows = list({n.replace(" ", ""): (f"b{i % 2}", n.replace(" ", ""), rng.choice((1, 1, 2, 5, 30)), n) for i, n in enumerate(sorted(names)) if len(n) >= 4}.values())
    cores = spark.createDataFrame(rows, "block string, core string, n bigint, tokens string")
    counts = N.count_triples(cores)
    cores = N.cut(N.ranked(cores, counts))
    all_cores = cores.collect()
    for most, rule, asked in ((1, N.one_edit, lambda r: True), (2, N.two_edits, lambda r: len(r["core"]) % 2), (2, N.in_place, lambda r: len(r["core"]) % 2)):
        expected = {}
        for c in all_cores:
            for p in all_cores:
                if c["block"] == p["block"] and (p["rank"], -p["cid"]) > (c["rank"], -c["cid"]) and asked(c):
                    d = within(c["core"], p["core"], most)
                    d = d if d <= most else math.ceil(assignment_cost(c["tokens"].split(" "), p["tokens"].split(" ")))
                    if d <= most and rule(c["core"], p["core"], c["n"], p["n"], d, lambda a, b: N.oddness(counts, a, b)):
                        expected[c["cid"]] = max(expected.get(c["cid"], (-9,)), (-d, p["rank"], p["cid"]))
        got = {r[0]: r[1] for r in N._hooks(cores, most, rule, counts, F.lit(True) if most == 1 else F.length("core") % 2 == 1).collect()}
        assert len(expected) > 30
        assert got == {c: p for c, (_, _, p) in expected.items()}


def test_links_to_names_that_are_misspelt_themselves_or_short(spark):
    frequent, rarer, odd = "Optik Spafomlikeder", "Optik Spafomliketer", "Optik Spfomlikxeter"  # one edit, then two more
    spellings = [frequent] * 200 + [rarer] * 50 + [odd] + ["Taxi Krog"] * 40 + ["Taxi Kroxg"] + ["Zimmerei Tannhof am Brunnhof bei Wiesenau"] * 40 + ["Zimmerei Xannhof am Brunnxof bei Wiesenau"]
    companies = [(i, f"{n}", "", None, "") for i, n in enumerate(spellings)]
    found = {frozenset((spellings[r[1]], spellings[r[2]])) for r in link_names(spark.createDataFrame(companies, COMPANY), spark.createDataFrame([], OCC)).where("left_id % 40 in (0, 10, 11, 12, 13)").collect()}
    assert {frozenset((frequent, odd)), frozenset((rarer, odd)), frozenset(("Taxi Krog", "Taxi Kroxg")), frozenset(spellings[-2:])} <= found
