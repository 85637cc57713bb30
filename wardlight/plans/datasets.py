"""The driver's tables read as messages, links, checks, reports, …

Every derived column is a function of the row it stands in, so a derived table has as many rows as its source and
grows with it. Each derivation has an SQL twin in `wardlight.plans.sql`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.sources.readers import read_message_table

# Phrases set after the text of document number d: phrase d mod n.
PHRASES = [
    "",
    "Karta raqamini va sms kodni shu botga yuboring: kapital-bonus.xyz",
    "Hisobingiz bloklandi! Tasdiqlash uchun http://c1ick-pay.top/login sahifasiga kiring.",
    "Ehtiyot bo'ling, firibgarlar kodni so'raydi. Kodni hech kimga aytmang.",
    "Kecha menga \"siz yutib oldingiz, kartangizni yuboring\" deyishdi, men ishonmadim.",
    "Бу ростми? Сизга 5 млн совға, картангиз рақамини юборинг: paymebonus.site",
    "Срочно нужны деньги, мама, это я, мой новый номер +998 90 123 45 67",
    "Please send the code from the sms to @safe_support_uz now. Act now!",
    "Your account has been suspended. Verify at https://secure-login-bank.xyz/verify?id=7#top",
    "Get passive income, invest now: bit.ly/3abc and https://sites.google.com/view/fake-bank/ today",
    "I got this message: pay the fine or you will be arrested. Is this real?",
    "Dokument my.gov.uz va https://click.uz/help saytida, rahmat.",
    "Ilovani yuklab oling: http://1.2.3.4/app.apk tezda!",
    "Никому не сообщайте код из смс, банк никогда не просит его.",
    "Buyurtma uchun 80 000 so'mni shu kartaga o'tkazing.",
    "Oxirgi imkoniyat, soliq qo'mitasi subsidiya beradi, t.me/soliq_yordam va t.me/share",
    "Мне вчера написали, коллега перешла по ссылке и ввела данные карты.",
    "Aksiya www.uzum-bonus.online/a, WWW.UZUM-BONUS.ONLINE/a va uzumbozor.com. Ҳисобингиз блокланди!",
    "\"Kodni ayting\" degan xabar keldi: user@xn--80ak6aa92e.com ga yozing, tel (91) 765-43-21.",
    "Do not click. Beware of scammers! To save your account, send your card details to me.",
]

# Hosts put in place of the host of page number p: host p mod n ('' keeps the page's own).
HOSTS = [
    "", "c1ick.uz", "click-bonus.xyz", "paymе.uz", "0lx-uz.com", "kapita1bank.uz", "clickhouse.com", "olx.kz",
    "storage.googleapis.com", "my.click.uz", "el-yurt-grant.xyz", "xn--80ak6aa92e.com", "1.2.3.4", "bit.ly",
    "a.b.c.d.example.top", "user@evil.site", "www.bank.co.uk", "lex.gov.uz", "securepaymeuz.com", "humor.com",
    "uzcardbonusuz.online", "doubleclick.net", "telegram.me", "login.verify.example.org",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_message_table(spark, f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of many: a stream takes a single file only from a glob."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def pick(values: list[str], index: Column) -> Column:
    """values[index mod n]; the list is a constant of the plan."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def messages_from(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("msg_id"), (F.col("doc_id") % 97).alias("sender_id"), (F.col("doc_id") % 13).alias("chat_id"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 37 % 43200) * 60).alias("ts"),
        F.concat(F.col("text"), F.lit(" "), pick(PHRASES, F.col("doc_id"))).alias("text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, sender_id, chat_id, ts, text: every document with one of the phrases after it."""
    return messages_from(spark, sf_dir, table(spark, sf_dir, "documents"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url: every page's address, most of them moved to another host."""
    pages = table(spark, sf_dir, "pages")
    host = pick(HOSTS, F.col("page_id"))
    scheme = F.regexp_extract("url", "^(https?://)", 1)
    moved = F.concat(scheme, host, F.regexp_replace("url", "^https?://[^/?#]*", ""),
                     F.when(F.col("page_id") % 5 == 0, ".apk").otherwise(""))
    return pages.select("page_id", F.when(host == "", F.col("url")).otherwise(moved).alias("url"))


def events_from(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with k taken from props and a time zone put on ts."""
    return events_from(spark, sf_dir, table(spark, sf_dir, "events"))


SIGNAL_SETS = ["prize,lookalike_site,brand:click", "secret_code", "apk_link", "needs_context", "easy_money,urgency",
               "advance_fee", "community", "brand:olx,lookalike_site", "ai_model", "threat_payment,risky_tld"]


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, person, level, signals, domains, confirmed, channel."""
    return checks_from(spark, sf_dir, table(spark, sf_dir, "events"))


def checks_from(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    e = events_from(spark, sf_dir, rows)
    level = (F.when(F.col("event_type") == "error", "dangerous").when(F.col("event_type") == "purchase", "suspicious")
             .otherwise("safe"))
    domain = F.when(F.col("k") % 7 == 0, F.concat(F.lit("shop"), F.col("k").cast("string"), F.lit(".click.uz"))).otherwise(
        F.concat(F.lit("site"), F.col("k").cast("string"), F.lit(".xyz")))
    none = F.array().cast("array<string>")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("person"), level.alias("level"),
        F.split(pick(SIGNAL_SETS, F.col("k")), ",").alias("signals"), F.array(domain).alias("domains"),
        F.when(F.col("value") > 60, F.array(domain)).otherwise(none).alias("confirmed"),
        F.when(F.col("event_id") % 11 == 0, "web").otherwise("bot").alias("channel"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind, kind, preview, reporter, ts: clicks and errors are reports of indicator k."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("click", "error"))
    kind = pick(["site", "phone", "tg"], F.col("k"))
    preview = F.when(F.col("k") % 2 == 0, F.concat(F.lit("site"), F.col("k").cast("string"), F.lit(".xyz"))).otherwise(
        F.concat(F.lit("sites.google.com/view/p"), F.col("k").cast("string")))
    return e.select(F.concat(F.lit("ind"), F.col("k").cast("string")).alias("ind"), kind.alias("kind"), preview.alias("preview"),
                    F.col("user_id").cast("string").alias("reporter"), "ts")
