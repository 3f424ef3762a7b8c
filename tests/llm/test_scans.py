from __future__ import annotations

import random

from inkwell.llm.scans import alike, corrections, find_noise, head_key, join_lines, may_be_head, page_number, plausible, repairs, restore_text

PAGE = "id bigint, document_id bigint, page_number int, text string, image_key string, kind string"
OCC = "id bigint, company string, preview string, status string, restored string"
PUB = "id bigint, filename string"


def test_page_numbers():
    for line in ("7", " – 12 – ", "[iii]", "Seite 4", "S. ii", "· 4O ·", "38/46", "lZ", "- 9 -"):
        assert page_number(line), line
    for line in ("2022", "26,50 €", "Teil 4", "04989 8685", "• • •", "", "Haus"):
        assert not page_number(line), line


def test_joining_lines():
    tokens, broken = join_lines(["Die Wander-", "gruppe und die Eltern-Kind-", "Stunde der Haupt-", "und Nebenstellen in Unte\xad ", "raltach. Das", "Spiel-"])
    assert tokens == ["Die", "Wandergruppe", "und", "die", "Eltern-Kind-Stunde", "der", "Haupt-", "und", "Nebenstellen", "in", "Unteraltach.", "Das", "Spiel-"]
    assert broken == ["Wandergruppe", "Eltern-Kind-Stunde", "Unteraltach."]


def test_heads_and_repairs():
    assert may_be_head("Amtsblatt Altach 2023") and not may_be_head("er kam dann an.") and not may_be_head("12")
    assert alike(head_key("Seniorenweg.eiser für Altach | 5"), head_key("SENIORENWEGWEISER FÜR ALTACH"))
    assert "bleibt" in repairs("b1eibt") and "Vertretung" in repairs("Venretung") and "über" not in repairs("uber")


def test_two_confusions_in_one_word():
    assert "Verwaltung" in plausible("Verwa1tnng") and "Wohnung" in plausible("W0hnnng") and "Wohnung" not in plausible("Wohmmmg")


def test_heads_of_three_lines_and_of_rare_sections(spark):
    rng = random.Random(8)
    words = ["Rat", "Hilfe", "Sport", "Bad", "Wald", "Markt", "Fest", "Chor", "Turm", "Quelle", "Garten", "Bach"]
    rows, truth = [], set()
    for n in range(1, 241):
        body = [f"Der {rng.choice(words)} und das {rng.choice(words)} {rng.choice(words).lower()}en {rng.randrange(1000)} mal am {k}. Tag," for k in range(9)]
        top = ["Amtsblatt Altachdorf", "Gemeinde Oberaltach", "Nachrichten der Verwaltung"]
        section = ["Vereinsleben Spezial"] if n in (50, 170) else []
        rows.append((n, 1, n, "\n".join([*top, *section, "", *body]) if not section else "\n".join([top[0], *section, "", *body]), "", ""))
        truth |= {(n, t) for t in (top if not section else [top[0], *section]) if n > 1}
    got = find_noise(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], OCC), None)
    heads = {(r[1], r[3]) for r in got.where("kind = 'running_head' and record_id > 1").collect()}
    assert heads == truth


def pages():
    rng, out, n = random.Random(4), [], 0
    # twelve different places and verbs keep the words frequent enough to restore their misreadings
    nouns = ["Verwaltung", "Wandergruppe", "Bücherei", "Sammlung", "Redaktion", "Zeitung"]
    for doc in range(1, 31):
        title = f"Stadtblatt {'ABCDEFGHIJ'[doc % 10]}stadt 2023"
        for p in range(1, 7):
            n += 1
            body = []
            for s in range(4):
                body += [f"Die {rng.choice(nouns)} und die {rng.choice(nouns)} öffnen", f"am Montag ihre Türen für alle. Die {nouns[s]}", f"der {rng.choice(nouns)} bleibt dort bis zum Abend.", ""]
            if n == 20:
                body[0] = "Die Verwa1tung und die Sammlnng öffnen"
                body[4:6] = ["Die Wander-", "gruppe öffnet am Montag ihre Türen für alle."]
            top = [title] if p == 1 else [title] if p % 2 else ["Rat und Hilfe"]
            out.append((n, doc, p, "\n".join([*top, "", *body, f"– {p} –" if p > 1 else ""]), "k", "x"))
    return out


def test_noise_found_and_text_restored(spark):
    rows = pages()
    odd = [(900, 1, 7, None, "", ""), (901, 1, 8, "", "", ""), (902, None, None, "Die Verwaltung bleibt.", "", ""), (None, 1, 2, "x", "", ""), rows[3]]
    previews = [(1, "Optik Haus", "Optik Haus\nDie Verwaltung b1eibt\nbis zum Abend.\nHauptweg 3, 12345 Ort\nTel. 0211 b1eibt", "a", ""), (1, "Optik Haus", "Optik Haus\nDie Verwaltung b1eibt\nbis zum Abend.\nHauptweg 3, 12345 Ort\nTel. 0211 b1eibt", "b", ""), (2, None, None, "", ""), (None, "x", "y", "", "")]
    p, o, d = spark.createDataFrame(rows + odd, PAGE), spark.createDataFrame(previews, OCC), spark.createDataFrame([(1, "Stadtblatt-Bstadt-2023.pdf"), (2, None)], PUB)
    got = [tuple(r) for r in find_noise(p, o, d).collect()]
    assert len(got) == len(set(got))
    kinds = lambda k: {(a, b, t) for a, b, x, t in got if x == k}
    assert kinds("misread") == {("page", 20, "Verwaltung"), ("page", 20, "Sammlung"), ("occurrence", 1, "bleibt")}
    assert kinds("broken_word") == {("page", 20, "Wandergruppe")}
    assert kinds("page_number") == {("page", r[0], f"– {r[2]} –") for r in rows if r[2] > 1}
    heads = {("page", r[0], f"Stadtblatt {'ABCDEFGHIJ'[r[1] % 10]}stadt 2023" if r[2] % 2 else "Rat und Hilfe") for r in rows if r[2] > 1}
    assert kinds("running_head") == heads
    text = {(r[0], r[1]): r[2] for r in restore_text(p, o, d).collect()}
    assert text["page", 20].startswith("Die Verwaltung und die Sammlung öffnen am Montag") and "Die Wandergruppe öffnet" in text["page", 20] and "–" not in text["page", 20] and "Rat und Hilfe" not in text["page", 20]
    assert text["occurrence", 1] == "Die Verwaltung bleibt bis zum Abend." and text["page", 901] == ""


def test_without_publications_and_nothing(spark):
    empty = spark.createDataFrame([], PAGE), spark.createDataFrame([], OCC)
    assert find_noise(*empty).count() == 0 and restore_text(*empty).count() == 0
    assert find_noise(spark.createDataFrame(pages(), PAGE), empty[1]).where("kind = 'running_head'").count() >= 100


def test_corrections_need_a_frequent_word(spark):
    lexicon = spark.createDataFrame([("bleibt", 100), ("b1eibt", 2), ("Haus", 30), ("Hans", 20), ("blcibt", 6)], "word string, n bigint")
    assert {tuple(r) for r in corrections(lexicon).collect()} == {("b1eibt", "bleibt")}
