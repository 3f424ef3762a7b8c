from __future__ import annotations

import html
import random
import unicodedata

import numpy as np
import pytest

from inkwell.llm.folding import folded_words, repair
from inkwell.llm.leaks import SIEVE_BITS, Sieve, _item_rows, align, find_leaks, holds, least_overlap, prefixes, shingle_counts, shingle_hits, shingles, word_ids

WORDS = [f"{a}{b}" for a in ("grün", "haus", "straß", "müll", "weg", "licht", "stein", "blau", "rast", "fluß") for b in ("e", "en", "ung", "ler", "heit", "bau", "amt", "tag", "ort", "zug")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < share / 3 else [w, rng.choice(WORDS)] if r < 2 * share / 3 else [rng.choice(WORDS)] if r < share else [w]
    return out


def test_one_spelling_for_all_writings():
    plain = "Für Grüße – die Straße, 5 €"
    forms = [plain, plain.upper(), unicodedata.normalize("NFD", plain), plain.encode().decode("cp1252"), html.escape(plain).replace("ü", "&uuml;"), plain.replace(" ", "\xa0"), "<p>" + plain.replace(" ", "\n") + "</p>", plain.replace("ü", "ue").replace("ß", "ss"), plain.replace("Grü", "G­rü")]
    assert {tuple(folded_words(f)) for f in forms} == {("fuer", "gruesse", "die", "strasse", "5")}
    assert repair("a < b & c") == "a < b & c"


def test_alignment_counts():
    a = np.arange(10)
    assert align(a, a) == (10, 10, 10)
    covered, agree, there = align(a, np.array([0, 1, 2, 99, 3, 4, 5, 6, 7, 8, 9]))
    assert (covered, agree, there) == (10, 10, 11)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    items = [(i, text(rng, 60 + i % 40)) for i in range(30)]
    docs, truth = [], set()
    for d in range(400):
        words = text(rng, rng.randrange(20, 200)).split()
        kind = d % 8
        if kind < 4:
            item, passage = items[d % 30]
            p = passage.split()
            if kind == 1:
                start = rng.randrange(0, len(p) // 2)
                p = p[start : start + int(len(p) * 0.55)]
            elif kind == 2:
                p = changed(rng, p, 0.08)
            elif kind == 3:
                p = p[: len(p) // 5]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if d % 3 else w for w in p]
            if kind < 3:
                truth.add((d, item))
        docs.append((d, (",\n" if d % 2 else " ").join(words), "x", 1))
    return items, docs, truth


def test_found_are_the_planted(spark, case):
    items, docs, truth = case
    odd = [(None, items[0][1], "", 0), (9000, None, "", 0), (9001, "", "", 0), (9002, items[3][1], "", 0), (9002, items[3][1], "", 0), (9003, " ".join([items[4][1]] * 200), "", 0)]
    d = spark.createDataFrame(docs + odd, "doc_id bigint, text string, words string, item_id int")
    i = spark.createDataFrame([*items, (77, None), (78, ""), (79, "zu kurz"), items[0]], "item_id bigint, text string")
    got = [tuple(r) for r in find_leaks(d, i).collect()]
    assert len(got) == len(set(got))
    assert set(got) == truth | {(9002, 3), (9003, 4)}


def test_prefix_filter_prunes_and_loses_nothing(spark, case):
    items, docs, _ = case
    own = _item_rows(spark.createDataFrame(items, "item_id int, text string"))
    corpus = spark.createDataFrame([r[:2] for r in docs], "doc_id bigint, text string")
    counts = shingle_counts(shingle_hits(corpus, Sieve.of(own.selectExpr("explode(hs) as h")), 1))
    seen = {h: 0 for r in own.collect() for h in r["hs"]}
    for _, t, *_ in docs:
        for h in set(shingles(word_ids(t)).view(np.int64).tolist()) & seen.keys():
            seen[h] += 1
    assert {r["h"]: r["n"] for r in counts.collect() if r["h"] in seen} == {h: n for h, n in seen.items() if n}
    kept = {}
    for r in prefixes(own, counts).collect():
        kept.setdefault(r["item_id"], set()).add(r["h"])
    for r in own.collect():
        skipped = set(r["hs"]) - kept[r["item_id"]]
        assert len(skipped) == r["least"] - 1 and r["least"] == least_overlap(len(dict(items)[r["item_id"]].split())) > 1
        assert max(seen[h] for h in kept[r["item_id"]]) <= min(seen[h] for h in skipped)


def test_sieve_lets_its_own_through(spark):
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(2**63), 2**63 - 1, 3000), rng.integers(-(2**63), 2**63 - 1, 50_000)
    sieve = Sieve.of(spark.createDataFrame([(int(h),) for h in own], "h bigint"))
    assert len(sieve.passed(own.view(np.uint64))) == 3000 and len(sieve.passed(other.view(np.uint64))) < 50
    assert len(sieve.bits) * 8 == SIEVE_BITS[0]
    assert len(Sieve.of(spark.createDataFrame([], "h bigint")).passed(own.view(np.uint64))) == 0


@pytest.mark.parametrize("n", [5, 8, 12, 20, 30, 50, 80, 140, 400])
def test_items_of_every_length(n):
    rng = random.Random(n)
    found = halves = none = 0
    for _ in range(100):
        item, host = text(rng, n).split(), text(rng, 150).split()
        start, at = rng.randrange(n - n // 2 + 1), rng.randrange(150)
        half = item[start : start + n // 2]
        hurt = list(half)
        for k in rng.sample(range(len(half)), len(half) // 10):
            hurt[k] = rng.choice(WORDS)
        own, put = word_ids(" ".join(item)), lambda part: word_ids(" ".join(host[:at] + part + host[at:]))  # noqa: B023
        found += holds(own, put(item))
        halves += holds(own, put(hurt))
        none += holds(own, put(item[: n // 5]))
    assert found == 100 and none == 0 and (n < 20 or halves >= (80 if n < 50 else 95))


def test_nothing(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert find_leaks(d, i).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), i).count() == 0
