"""Messages with known verdicts: levels, intents, links, masks, transliteration, explanations."""

import pytest
from pyspark.sql import functions as F

from wardlight.functions import hosts as H
from wardlight.functions import text as X
from wardlight.operators import crowd, explain, intent, links, verdict

# text, flagged?, intent (None: any)
MESSAGES = [
    ("Sizning kartangiz bloklandi, tasdiqlash uchun sms kodni yuboring", True, "request"),
    ("Картангиз блокланди, смс кодни юборинг", True, "request"),
    ("Служба безопасности банка, назовите код из смс", True, None),
    ("Your card is blocked, send the code from the sms", True, None),
    ("Rasmlarni ko'ring: albom_2025.apk", True, None),
    ("Buyurtma uchun 70 000 so'mni shu kartaga o'tkazing.", True, "request"),
    ("Bonusni olish uchun kiring: clickuzbonus.top", True, None),
    ("Eslatma: SMS kodni hech kimga aytmang, bank uni hech qachon so'ramaydi.", False, "warning"),
    ("Opamga 'hisobingiz bloklandi, kodni ayting' deb qo'ng'iroq qilishibdi, u go'shakni qo'yibdi.", False, "report"),
    ("Мне вчера написали, что надо назвать код из смс, я не поверил.", False, "report"),
    ("Menga \"kartangiz raqamini yuboring\" degan SMS keldi. Bu rostmi?", True, "quote"),
    ("Ertaga soat 11 da uchrashamiz.", False, "info"),
    ("To'lovni click.uz orqali qildim, rahmat", False, None),
    ("Never share your code. Our bank never asks for it.", False, "warning"),
    ("EL YURT hisobot.pdf", False, "info"),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MESSAGES)], "id int, text string").coalesce(4)
    told = explain.explain(verdict.score_messages(df), F.lit("en"))
    return {r["id"]: r for r in told.collect()}


@pytest.mark.parametrize("i", range(len(MESSAGES)))
def test_level_and_intent(scored, i):
    text, flagged, kind = MESSAGES[i]
    row = scored[i]
    assert (row["level"] != "safe") == flagged, (text, row["level"], row["score"], row["signals"])
    assert kind is None or row["intent"]["kind"] == kind
    assert flagged or not row["reasons"]
    assert 0 <= row["score"] <= 1 and row["score"] >= max(0, min(row["link_score"], 1)) - 1e-9


def test_request_is_quoted_and_question_is_asked(scored):
    assert scored[0]["reasons"][0].startswith("The message asks you to do this: «")
    assert scored[5]["signals"] == ["needs_context"] and scored[5]["score"] == pytest.approx(0.35)
    assert "doesn't ask you for anything" in scored[7]["trust"][0]


def test_model_alone_is_at_most_suspicious(spark):
    df = spark.createDataFrame([(1, "Salom, ishlar qalay?", 1.0), (2, "Salom, ishlar qalay?", 0.74), (3, "Salom, ishlar qalay?", None)],
                               "id int, text string, p double")
    rows = {r["id"]: r for r in verdict.score_messages(df, proba="p").collect()}
    assert rows[1]["level"] == "suspicious" and rows[1]["score"] == pytest.approx(0.5) and rows[1]["signals"] == ["ai_model"]
    assert rows[2]["score"] == 0 and rows[3]["score"] == 0 and rows[3]["model_score"] is None


HOSTS = {
    "c1ick.uz": "click", "paymе.uz": "payme", "0lx-uz.com": "olx", "kapita1bank.uz": "kapitalbank", "el-yurt-grant.xyz": "elyurt",
    "securepaymeuz.com": "payme", "olx.xyz": "olx", "mygovnafaqa.site": "mygov", "uzumbank.com": "uzum",
    "clickhouse.com": None, "paymentwall.com": None, "humor.com": None, "olx.kz": None, "google.ru": None, "doubleclick.net": None,
    "storage.googleapis.com": None, "clickup.com": None,
}


def test_brand_lookalikes(spark):
    df = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    assert {r[0]: r[1] for r in df.select("host", H.imitated_brand(F.col("host"))).collect()} == HOSTS


def test_urls(spark):
    df = spark.createDataFrame([("Kiring: bit.ly/abc, yoki https://example.com/x?y=1. Rahmat. BIT.LY/ABC v1.2 a.pdf http://8.8.8.8/q",)], "t string")
    urls = [u["url"] for u in df.select(links.urls_in(F.col("t"))).first()[0]]
    assert urls == ["bit.ly/abc", "https://example.com/x?y=1", "http://8.8.8.8/q"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Karta 8600 1234 5678 9012, +998 90 123 45 67, @some_user, t.me/some_page, a@b.uz x",)], "t string")
    out = df.select(X.mask_for_dataset(F.col("t")), X.to_latin(F.lit("совға ютиб олдингиз")),
                    X.strip_tags(F.lit("<b>a &amp;lt; &#1090;&#x27;</b> ")), X.defang_text(F.lit("see a-b.xyz now. ok"))).first()
    assert out[0] == "Karta <CARD>, <PHONE>, <USER>, t.me/some_page, <EMAIL> x"
    assert out[1] == "sovg'a yutib oldingiz" and out[2] == "a &lt; т'" and out[3] == "see a-b[.]xyz now. ok"


def test_same_message_in_two_scripts_has_one_fingerprint(spark):
    texts = ["Kartangiz  bloklandi! SMS kodni yuboring", "kartangiz bloklandi sms kodni yuboring.", "Картангиз блокланди! СМС кодни юборинг"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(X.content_fingerprint(F.col("t"))).distinct().count() == 1


def test_quoted_speech_keeps_its_length(spark):
    df = spark.createDataFrame([("u 'kodni ayting' deb aytdi, «a b» va \"c\n d\" o'g'il",)], "t string")
    raw, blank = df.select("t", intent.blank_quoted(F.col("t"))).first()
    assert len(raw) == len(blank) and "kodni" not in blank and "o'g'il" in blank


def test_indicators(spark):
    text = "https://sites.google.com/view/x?q=1 va www.fake.com.uz/a, @yomon_bot, t.me/share, +998 (91) 765-43-21, 8 12 345 67 89"
    df = spark.createDataFrame([(1, text, "id:5", "@Sender")], "id int, text string, f string, n string")
    rows = crowd.extract_indicators(df, "id", forward_id="f", forward_name="n").collect()
    assert {(r["kind"], r["value"], r["preview"]) for r in rows} == {
        ("site", "sites.google.com/view/x", "sites.google.com/view/x"), ("site", "fake.com.uz", "fake.com.uz"),
        ("tg", "@yomon_bot", "@yom***"), ("tg", "id:5", "@sen***"), ("phone", "+998917654321", "+99891***21")}


@pytest.mark.parametrize("text", ["1" * 4000, "99 " * 1333, "a." * 2000, "http://" + "a." * 1990, "'" + "a'b " * 1000, '"' * 3999])
def test_hostile_texts_end(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert verdict.score_messages(df).count() == 1


def test_filters_do_not_repeat_the_work(spark):
    """A filter on a verdict stays above the scoring, or every expression would be evaluated again inside it."""
    df = spark.createDataFrame([(1, "salom")], "id int, text string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    scored = verdict.score_messages(df)
    assert plan(scored.filter("level <> 'safe'")).count("RLIKE") == plan(scored).count("RLIKE") > 0
