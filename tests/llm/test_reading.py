from __future__ import annotations

import random

from inkwell.llm.reading import features, fit_levels, reading_levels, sentences

EASY, HARD = ["Das Haus ist rot.", "Wir helfen Ihnen gern.", "Rufen Sie uns an!", "Das Rad ist da."], ["Die Anspruchskoordinierungssystematik präkludiert die Verpflichtung.", "Mithin entfällt die Zuständigkeitsvereinbarung gemäß Satzung."]
MID = ["Der Verein öffnet am Montag die Türen der Turnhalle.", "Nach Angaben der Stadt haben sich zwanzig Gäste angemeldet.", "Die Redaktion stellt die neue Gruppe aus dem Ort vor."]
DOC, LABEL = "doc_id bigint, text string, easy string, band int", "doc_id bigint, rater string, level string, labelled_at string"


def corpus(n=240):
    rng = random.Random(2)
    docs, levels = [], {}
    for i in range(n):
        level = ("easy", "standard", "demanding")[i % 3]
        main = {"easy": EASY, "standard": MID, "demanding": HARD}[level]
        parts = [rng.choice(main) for _ in range(rng.randrange(5, 12))] + [rng.choice(MID)]
        rng.shuffle(parts)
        docs.append((i, "Amtsblatt 2021\n\n" + " ".join(parts), "x", 1))
        levels[i] = level
    return docs, levels


def test_sentences():
    assert sentences("Titel ohne Ende\n\nDas ist ein Satz. Und noch einer hier!\nMüller\t0211 123\n- Punkt eins") == ["Das ist ein Satz.", "Und noch einer hier!"]
    assert sentences("Der Satz geht über\nzwei Zeilen weiter.") == ["Der Satz geht über zwei Zeilen weiter."]
    assert sentences(None) == sentences("") == sentences(" \n ") == sentences("Pos. 3; Karte; 2 Stk.\nA | 3,50 €") == []
    assert len(sentences("Wir kommen am 5. Mai um acht Uhr zu dir. Ja genau so ist es.")) == 2


def test_features_belong_to_their_sentence():
    index, starts = features(["Ein Satz hier.", "!", "Ein Satz hier."])
    parts = [index[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(index)])]
    assert parts[0] == parts[2] and len(parts[1]) < len(parts[0])


def test_levels_on_held_out_documents(spark):
    docs, levels = corpus()
    labels = [(i, "rk", levels[i], "") for i in range(0, 160)] + [(3, "lm", "standard", ""), (5, "rk", levels[5], ""), (None, "rk", "easy", ""), (7, "rk", None, ""), (8, "rk", "odd", "")]
    odd = [(900, None, "", 0), (901, "", "", 0), (902, "Müller 0211 1\nMeier 0211 2", "", 0), (903, "Das Haus ist rot. " * 3000, "", 0), (None, "Das Haus ist rot. Wir helfen Ihnen gern.", "", 0)]
    out = reading_levels(spark.createDataFrame(docs + odd, DOC), spark.createDataFrame(labels, LABEL))
    assert out.columns == ["doc_id", "sentences", "easy", "standard", "demanding", "band"]
    got = {r["doc_id"]: r["band"] for r in out.collect()}
    right = sum(got[i] == levels[i] for i in range(160, 240))
    assert right >= 78
    assert got[903] == "easy" and got[None] == "easy" and not {900, 901, 902} & set(got)


def test_bound_and_nothing(spark):
    docs, levels = corpus(60)
    d, labels = spark.createDataFrame(docs, DOC), spark.createDataFrame([(i, "a", v, "") for i, v in levels.items()], LABEL)
    assert reading_levels(d, labels, sample_docs=30).count() == 60
    assert fit_levels(d, labels.where("false")) is None
    assert reading_levels(d, labels.where("false")).count() == 0
    assert reading_levels(d.where("false"), labels.where("false")).count() == 0
