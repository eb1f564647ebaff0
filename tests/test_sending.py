"""Passes end to end: details asked for and met, plans, the report and log, messages, and an outbox that holds each message once."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import messages, sending
from tidemark.plans import passes
from tidemark.plans.passes import Settings, full_pass
from tidemark.schemas import NOTICE, SOURCE
from tidemark.sources import landing
from tidemark.streaming.passes import Outbox, Snapshots, start, step

D = datetime.date
AS_OF = D(2026, 9, 1)


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>{link}</link><description>{d}</description></item>" for t, link, d in items) + "</channel></rss>"


def jobs(*names):
    return "".join(f'<h3 class="line-clamp-2"><a href="https://jobrelais.com/opportunities/call-for-tenders/{n}">Appel {n}</a></h3>' for n in names)


def job(until):
    said = {"@type": "JobPosting", "datePosted": "2026-08-02", "description": "<p>Forage</p>"} | ({"validThrough": until} if until else {})
    return f'<script type="application/ld+json">{json.dumps(said)}</script>'


def landed(spark, *rows):
    """rows: source, method, url, page, status, body."""
    return spark.createDataFrame([(s, m, u, p, st, "text/html; charset=utf-8", bytearray((b or "").encode())) for s, m, u, p, st, b in rows], landing.LANDED)


def sources(spark):
    rows = [
        ("s1", "S1", "Source un", "RSS", "https://s1.org", "Benin", None, "Appel d'offres", True), ("jr", "JR", "Relais", "HTML:jobrelais.com", "https://jobrelais.com", "Benin", None, "Appel d'offres", True),
        ("pl", "PL", "Mairie", "PLAN", "https://p.bj", None, None, None, True), ("s3", "S3", "Vide", "RSS", "https://s3.org", None, None, None, True), ("s4", "S4", "Page", "RSS", "https://s4.org", None, None, None, True), ("s5", "S5", "Panne", "RSS", "https://s5.org", None, None, None, True),
    ]
    return spark.createDataFrame(rows, SOURCE)


def url(n):
    return f"https://jobrelais.com/opportunities/call-for-tenders/{n}"


# Messages of many rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cut_is_a_plain_loop_under_the_limit(spark, seed):
    r = random.Random(seed)
    rows = [(c, i, "x" * r.choice((0, 1, 3, 10, 30, 49, 50, 51, 90)) if r.random() > 0.05 else None) for c in ("a", "b", "c") for i in range(r.choice((0, 1, 40, 400)))]
    want = {}
    for c in ("a", "b", "c"):
        held, part = [], 0
        for k, line in enumerate(x[2] for x in rows if x[0] == c):
            line = f"{k + 1}. {line or ''}"[:50]
            if held and len("\n".join([*held, line])) > 50:
                want[c, part] = "\n".join(held)
                held, part = [], part + 1
            held.append(line)
        if held:
            want[c, part] = "\n".join(held)
    df = spark.createDataFrame(rows, "channel string, place int, line string").repartition(5)
    got = messages.cut(df, ["channel"], ["place"], "line", 50, number=True).collect()
    assert {(x["channel"], x["part"]): x["body"] for x in got} == want
    assert all(len(x["body"]) <= 50 for x in got) and sum(x["n"] for x in got) == len(rows)


def notices(spark, rows):
    return spark.createDataFrame([tuple((dict.fromkeys(NOTICE.names) | r)[c] for c in NOTICE.names) for r in rows], NOTICE)


def told(spark, rows, **settings):
    held = notices(spark, rows).withColumn("outcome", F.when(F.col("sent_new").isNull(), "new").otherwise("tracked"))
    said, marks = passes.outgoing(held, Settings(sending=sending.Sending(**settings)))
    return said.collect(), marks.collect()


def test_digest_of_many_new_notices(spark, monkeypatch):
    monkeypatch.setattr(messages, "MAIL_LENGTH", 400)
    rows = [{"id": f"TP-{i:06d}", "title": f"t{i} <b>", "organisation": "Org" if i % 2 else None, "country": "Benin", "relevance": "3 - PRIORITAIRE" if i < 3 else "2 - A VOIR", "link": f"https://x.org/{i}", "days_left": 30 + i, "deadline": D(2026, 10, 1)} for i in range(14)]
    said, marks = told(spark, rows)
    mails, chats = [x for x in said if x["channel"] == "email"], [x for x in said if x["channel"] == "telegram"]
    assert {x["kind"] for x in said} == {"digest"} and len(chats) == 1 and len(mails) > 1
    mails.sort(key=lambda x: x["part"])
    assert mails[0]["subject"] == "[tidemark] 14 nouvelles opportunites detectees" and mails[0]["body"].startswith("Nouvelles opportunites detectees : 14\n\nt0 <b>  [3 - PRIORITAIRE]\n   Organisation : - | Pays : Benin | Deadline : 2026-10-01\n   https://x.org/0\n")
    whole = "\n".join(x["body"] for x in mails)
    assert all(f"https://x.org/{i}\n" in whole for i in range(14)) and whole.count("Organisation") == 14 and mails[-1]["body"].endswith("candidater.")
    assert chats[0]["body"].split("\n")[:3] == ["<b>14 nouvelles opportunites</b>", "", "- t0 &lt;b&gt;"] and chats[0]["body"].endswith("... et 4 autres.") and len(chats[0]["body"]) <= 4096
    assert len(marks) == 28


def test_recap_of_many_reminders(spark):
    rows = [{"id": f"TP-{i:06d}", "title": f"t{i}", "relevance": "2 - A VOIR", "days_left": d, "deadline": D(2026, 9, 1), "sent_new": "email,telegram"} for i, d in enumerate([0, 1, 2, 2, 3, 4, 5, 6, 7])]
    said, _ = told(spark, rows, caps=(("email", 0), ("telegram", 0)))
    recaps = {x["channel"]: x for x in said if x["kind"] == "recap"}
    assert sorted((x["channel"], x["kind"], x["id"]) for x in said if x["kind"] != "recap") == sorted((c, "j1", f"TP-{i:06d}") for c in ("email", "telegram") for i in (0, 1))
    assert recaps["email"]["subject"] == "[tidemark] 7 echeance(s) a surveiller" and "1. t2  [dans 2 jours]\n   Organisation : - | Pays : - | Deadline : 2026-09-01\n" in recaps["email"]["body"]
    assert recaps["telegram"]["body"].split("\n")[2] == "1. t2 - 2026-09-01"


# Details, plans, report and log


def test_details_are_asked_for_met_and_merged_over_passes(spark):
    empty, src = spark.createDataFrame([], NOTICE), sources(spark)
    first = full_pass(empty, landed(spark, ("jr", "HTML:jobrelais.com", "u", 1, 200, jobs("a", "b", "c", "d"))), src, AS_OF, Settings(details=3))
    assert first.notices.count() == 0
    asked = {r["address"]: r["asked"] for r in first.pending.collect()}
    assert asked == {url("a"): True, url("b"): True, url("c"): True, url("d"): False}
    pages = landed(spark, ("jr", "HTML:jobrelais.com", url("a"), 0, 200, job("2026-10-04T00:00")), ("jr", "HTML:jobrelais.com", url("b"), 0, 200, job(None)), ("jr", "HTML:jobrelais.com", url("c"), 0, 500, None))
    second = full_pass(empty, pages, src, AS_OF, Settings(details=3), pending=first.pending)
    assert [(r["title"], r["deadline"], r["published"], r["summary"], r["organisation"], r["outcome"]) for r in second.notices.collect()] == [("Appel a", D(2026, 10, 4), D(2026, 8, 2), "Forage", "Relais", "new")]
    assert {r["address"]: r["asked"] for r in second.pending.collect()} == {url("c"): True, url("d"): True}  # b was read and has no deadline: it goes
    again = full_pass(second.notices.drop("outcome"), landed(spark, ("jr", "HTML:jobrelais.com", "u", 1, 200, jobs("a", "d"))), src, AS_OF, Settings(details=3), pending=second.pending)
    assert [(r["title"], r["outcome"], r["deadline"]) for r in again.notices.collect()] == [("Appel a", "tracked", D(2026, 10, 4))]
    assert {r["address"] for r in again.pending.collect()} == {url("c"), url("d")}


def test_report_log_and_plans_of_a_pass(spark):
    line = {"utilisable": 1, "datelancement": "2026-10-01", "libelle": "Route", "reference": "P1", "modepassation_ID": {"code": "AO"}, "typeMarche": {"libelle": "Travaux"}, "plan": {"annee": "2026"}}
    body = lambda *lines: json.dumps({"content": list(lines)})
    rows = [
        ("s1", "RSS", "u", 1, 200, rss(("Forage", "https://s1.org/1", "Date limite : 15/10/2026"), ("Vieux", "https://s1.org/2", "Date limite : 15/08/2026"))), ("s3", "RSS", "u", 1, 200, "<rss><channel></channel></rss>"), ("s4", "RSS", "u", 1, 200, "<html>maintenance</html>"),
        ("s5", "RSS", "u", 1, 503, None), ("pl", "PLAN", "u", 1, 200, body(line, line | {"reference": "P2"})), ("pl", "PLAN", "u", 2, 200, body(line | {"libelle": "Route 2"})),
    ]
    done = full_pass(spark.createDataFrame([], NOTICE), landed(spark, *rows), sources(spark), AS_OF)
    assert {r["source_id"]: (r["read"], r["kept"], r["status"]) for r in done.report.collect() if r["source_id"] != "pl"} == {"s1": (2, 1, "OK"), "s3": (0, 0, "FLUX VIDE"), "s4": (0, 0, "RIEN LU"), "s5": (0, 0, "ERREUR")}
    log = done.log.collect()
    assert [r["message"] for r in log if r["action"] == "Passage"] == ["read 2, kept 1, new 1, updated 0"]
    assert [(r["source"], r["message"]) for r in log if r["action"] == "Page"] == [("s5", "HTTP 503 on page 1")]
    assert sorted((r["reference"], r["object"], r["authority"]) for r in done.plans.collect()) == [("P1", "Route 2", "Mairie"), ("P2", "Route", "Mairie")]
    later = full_pass(done.notices.drop("outcome"), landed(spark, ("pl", "PLAN", "u", 1, 200, body(line | {"datelancement": "2026-12-01"}))), sources(spark), D(2026, 10, 2), plans=done.plans)
    assert [(r["reference"], r["launch"]) for r in later.plans.collect()] == [("P1", D(2026, 12, 1))]  # P2 has begun


# The outbox


def test_a_lost_channel_and_a_replay_send_nothing_twice_and_lose_nothing(spark, tmp_path):
    path, src = lambda name: str(tmp_path / name), sources(spark)
    settings = Settings(sending=sending.Sending(caps=(("email", 20), ("telegram", 0))))
    handed = []

    def chat_is_down(rows):
        raise RuntimeError("no network")

    def mail(rows):
        handed.extend((r["version"], r["kind"], r["id"], r["part"]) for r in rows.collect())

    landed(spark, ("s1", "RSS", "u", 1, 200, rss(("Forage", "https://s1.org/1", "Date limite : 15/10/2026"), ("Pont", "https://s1.org/2", "Date limite : 03/09/2026")))).write.parquet(path("landing"))
    start(spark, path("landing"), path("store"), path("check"), src, lambda: AS_OF, settings, {"email": mail, "telegram": chat_is_down}).awaitTermination()
    store, outbox = Snapshots(spark, path("store")), Outbox(spark, path("store"))
    assert {(r["title"], r["sent_new"], r["sent_j3"]) for r in store.latest().collect()} == {("Forage", "email", None), ("Pont", "email", "email")}
    assert {r["channel"] for r in outbox.read().collect()} == {"email"} and len(handed) == 3

    # The same batch once more, as after a loss before its commit: its folder is whole, so nothing is handed on or written again.
    version = max(r["version"] for r in store.log())
    done = step(store, spark.read.schema(landing.LANDED).parquet(path("landing")), src, version, AS_OF, settings, {"email": mail, "telegram": chat_is_down})
    assert {(r["title"], r["sent_new"]) for r in done.notices.collect()} == {("Forage", "email"), ("Pont", "email")} and len(handed) == 3

    # The next pass: the channel is back, and gets what it missed, once.
    landed(spark, ("s1", "RSS", "u", 1, 200, rss(("Forage", "https://s1.org/1", "Date limite : 15/10/2026")))).write.mode("append").parquet(path("landing"))
    start(spark, path("landing"), path("store"), path("check"), src, lambda: AS_OF, settings, {"email": mail}).awaitTermination()
    sent = sorted((r["channel"], r["kind"], r["id"]) for r in outbox.read().collect())
    assert sent == sorted((c, k, i) for c in ("email", "telegram") for k, i in (("new", "TP-000001"), ("new", "TP-000002"), ("j3", "TP-000002")))
    assert {(r["title"], r["sent_new"], r["sent_j3"]) for r in store.latest().collect()} == {("Forage", "email,telegram", None), ("Pont", "email,telegram", "email,telegram")} and len(handed) == 3
