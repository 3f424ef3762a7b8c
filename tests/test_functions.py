from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import exact as X
from inkwell.functions import text as T
from inkwell.functions.geometry import box, iou, suppress
from inkwell.functions.python import read_answer, similarity, span_confidence


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(column.alias("r")).head()[0]


def test_names_and_keys(spark):
    assert one(spark, T.normalize_name(F.col("n")), n="ÄÖÜ GmbH & Co. KG") == "aou gmbh co kg"
    assert one(spark, T.contact_key(F.col("a"), F.col("b"), F.col("c")), a=None, b=" A@b.de ", c=None) == "|a@b.de|"
    assert one(spark, T.form_label(F.col("n")), n="Straße / Nr.") == "strassenr"
    assert one(spark, T.safe_filename(F.col("n")), n='a\\b/ "x".pdf. ') == "x.pdf"
    assert one(spark, T.safe_filename(F.col("n")), n="/ . ") == "source.pdf"


def test_phones_and_domains(spark):
    assert one(spark, T.phone_international(F.col("p")), p="+49 (0) 211 / 12 34") == "+4902111234"
    assert one(spark, T.phone_national(F.col("p")), p="0049 211 123456") == "0211123456"
    assert one(spark, T.phone_national(F.col("p")), p="+43 1 2345678") == "012345678"
    assert one(spark, T.domain(F.col("d"), drop_www=True), d="HTTPS://WWW.Haus.DE/") == "haus.de"


def test_fingerprint_rounds_half_up_and_knows_nulls(spark):
    boxes = {"x": F.lit(0.12349), "y": F.lit(None).cast("double")}
    a = one(spark, T.fingerprint(F.lit(1), F.lit(" A  B "), F.lit(None).cast("string"), boxes))
    assert a == one(spark, T.fingerprint(F.lit(1), F.lit("a b"), F.lit(""), {"x": F.lit(0.123), "y": F.lit(None).cast("double")}))
    assert len(a) == 24
    assert one(spark, T.rounded_text(F.lit(0.1))) == "0.1"


def test_urls_scores_titles(spark):
    assert one(spark, T.normalize_url(F.col("u")), u="HTTPS://Host.DE:443") == "https://host.de/"
    assert one(spark, T.normalize_url(F.col("u")), u="http://h.de:8080/a?q=1#f") == "http://h.de:8080/a?q=1"
    assert one(spark, T.publication_score(F.col("u")), u="https://x/seniorenwegweiser-2024.pdf") == 60
    assert one(spark, T.title_case(F.col("t")), t="NEUSTADT AN DER WEINSTRASSE") == "Neustadt an der Weinstrasse"


def test_line_rules(spark):
    rule = lambda s: one(spark, T.forbidden_content(F.col("l")), l=s)
    assert rule("nur 5,99 €") == "price_or_currency"
    assert rule("gültig bis 3.4.") == "validity_or_deadline"
    assert rule("Große Aktion") == "campaign_or_offer"
    assert rule("Guten Tag") is None
    assert one(spark, T.count_of(F.col("t"), F.col("n")), t="aaaa", n="aa") == 2


def test_exact_money(spark):
    cents = lambda t: one(spark, X.hundredths(F.col("t")), t=t)
    assert [cents(t) for t in ("1,50", "-1.00", "1.005", "x", "")] == [150, -100, None, None, None]
    d = lambda v: F.lit(v).cast("decimal(18,0)")
    assert one(spark, X.times(d(-100), d(51))) == -51
    assert one(spark, X.percent(d(139400), d(3500))) == 48790
    assert one(spark, X.percent(d(-100), d(5050))) == -51
    assert one(spark, X.backoff(F.lit(3))) == 4000


def test_boxes(spark):
    a = box(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    assert one(spark, iou(a, box(F.lit(5), F.lit(0), F.lit(15), F.lit(10)))) == 50 / 150
    assert one(spark, iou(box(F.lit(0), F.lit(0), F.lit(0), F.lit(0)), box(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))) == 0.0
    kept = one(spark, suppress(F.array(a, box(F.lit(0), F.lit(0), F.lit(10), F.lit(9)), box(F.lit(20), F.lit(0), F.lit(30), F.lit(10))), 0.85))
    assert [k["left"] for k in kept] == [0, 20]


def test_answers_of_any_shape(spark):
    assert read_answer('```json\n[{"a": 1}]\n```') == [{"a": 1}]
    assert read_answer("Hier: [{'a': 1}, {'b': 2}]") == [{"a": 1}, {"b": 2}]
    assert read_answer('[{"a": 1}, {"b": 2}, {"c":') == [{"a": 1}, {"b": 2}]
    assert read_answer("There are no ads.") == []
    assert read_answer(None) is None and read_answer("???") is None
    assert one(spark, similarity(F.lit("a b c"), F.lit("a x c"))) == 2 / 3
    assert one(spark, similarity(F.lit(None).cast("string"), F.lit("a"))) is None
    assert span_confidence("Haus am See", [("das", 10.0), ("Haus", 80.0), ("am", 90.0), ("See", 100.0)]) == 0.9
