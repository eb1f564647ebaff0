"""The pass: landed bodies, the registry, the ordered upsert, sending, boards, and passes as a stream."""

import datetime
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify, dates, ids, text
from tidemark.operators import boards, notify, resolve, sending
from tidemark.plans import passes
from tidemark.schemas import NOTICE, SOURCE, conform, missing
from tidemark.sources import landing, registry
from tidemark.streaming.passes import Snapshots, start

D = datetime.date
AS_OF = D(2026, 9, 1)


def one(spark, column, **values):
    """The value of an expression over one row of texts."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def rss(*items):
    cells = "".join(f"<item><title>{t}</title><link>{link}</link><description>{d}</description></item>" for t, link, d in items)
    return f"<rss><channel>{cells}</channel></rss>"


def landed(spark, *rows):
    """rows: source, method, page, status, body."""
    full = [(s, m, f"https://{s}.org", p, st, "text/html; charset=utf-8", bytearray((b or "").encode())) for s, m, p, st, b in rows]
    return spark.createDataFrame(full, landing.LANDED)


def sources(spark):
    rows = [("s1", "S1", "Source un", "RSS", "https://s1.org", "Benin", None, "Appel d'offres", True), ("s2", "S2", "Source deux", "RSS", "https://s2.org", "Togo", "Sante", None, True), ("off", "S3", "Off", "RSS", "u", None, None, None, False)]
    return spark.createDataFrame(rows, SOURCE)


# Scalars without a query


def test_normalize_takes_marks_off_all_latin_letters(spark):
    import unicodedata

    held = ["Čeština Ștefan őś Łódź Việt ệ ǖ", "Ångström İstanbul", "Éàü-ÇÑ", "été", "straße"]
    for x in held:
        nfd = "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ").lower()
        want = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in nfd).split())
        assert one(spark, text.normalize(F.col("x")), x=x) == want
        assert text.listed(x) == [want]


def test_decoded_by_charset(spark):
    rows = [("text/html; charset=windows-1252", "l’été – 5 €".encode("windows-1252")), ("text/html; charset=ISO-8859-1", b"\x93a\x94"), ("text/html", "é".encode()), ("text/html; charset=utf-8", b"a\xff"), (None, b"x"), ('x; charset="UTF-16"', "é".encode("utf-16"))]
    got = spark.createDataFrame([(t, bytearray(b)) for t, b in rows], "t string, b binary").select(landing.decoded(F.col("b"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == ["l’été – 5 €", "“a”", "é", "a�", "x", "é"]


def test_small_scalars(spark):
    assert one(spark, text.decode_entities(F.col("x")), x="&#233;&#xE9; &amp;eacute; &rsquo;<![CDATA[a&b]]>") == "éé &eacute; ’a&b"
    assert one(spark, text.repair(F.col("x")), x="l�eau � marchÚ") == "l'eau  marché"
    assert one(spark, text.canonical(F.col("x"), ["Sante", "Eau"]), x=" sANTE ") == "Sante" and one(spark, text.canonical(F.col("x"), ["Sante"]), x="autre") is None
    assert one(spark, text.escape_html(F.col("x")), x="a<b>&c") == "a&lt;b&gt;&amp;c"
    assert one(spark, text.notice_label(F.col("r"), F.col("t")), r=" ", t="x" * 90) == "x" * 80 + "..."
    assert (text.choice_phrase([]), text.choice_phrase(["a"]), text.choice_phrase(["a", "b", "c"])) == ("", "a", "a, b ou c")
    assert [one(spark, text.page_changed(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("", "x"), ("x", "x"), ("x", "y"))] == [True, False, True]
    assert [one(spark, classify.is_plan_title(F.col("x")), x=x) for x in ("Plan de passation 2026", "Avis général de passation", "AGPM", "Plan de formation")] == [True, True, True, False]
    assert one(spark, dates.german_day(F.col("x")), x="5.9.2026") == "2026-09-05" and one(spark, dates.german_day(F.col("x")), x="32.9.2026") is None
    assert one(spark, dates.dashed_day(F.col("x")), x="15-Sep-2026 17:00") == "2026-09-15" and one(spark, dates.dashed_day(F.col("x")), x="15-Foo-2026") is None
    assert one(spark, dates.iso_day(F.col("x")), x="2026-9-5T10:00") == "2026-09-05" and one(spark, dates.iso_prefix(F.col("x")), x="2026-9-5") is None
    assert one(spark, classify.status_colour(F.col("x")), x="URGENT") == "#FFD6D6"
    assert [classify.reminder_days(x) for x in ("14;7,3;1", None, "x;2j")] == [[14, 7, 3, 1], [], [2]]
    assert [r[0] for r in spark.createDataFrame([(d, s) for d, s in ((1, ""), (5, ""), (10, ""), (20, ""), (-1, ""), (None, ""), (1, "Gagne"))], "d int, s string").select(classify.bucket(F.col("d"), F.col("s"), ("Gagne",))).collect()] == ["j1", "j3", "j7", "ok", "expired", "none", "closed"]
    assert one(spark, notify.recipients(F.col("x")), x="a@b.org; @c, d ;e@f") == ["a@b.org", "e@f"] and one(spark, notify.calendar_days(F.col("x")), x="7;x,29;0") == [7, 0]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Date limite : 15/10/2026", D(2026, 10, 15)), ("deadline 2026-10-15", D(2026, 10, 15)), ("Clôture le 3 août 2026", D(2026, 8, 3)), ("closing date: October 5th, 2026", D(2026, 10, 5)), ("avant le 1er janv. 27", None),
        ("Date limite 31/02/2026", None), ("due by 5 sept 26", D(2026, 9, 5)), ("publié le 15/10/2026", None), ("Date limite : 31/02/2026 ou 2026-03-01", D(2026, 3, 1)), (None, None),
    ],
)
def test_deadlines_in_all_their_forms(spark, said, want):
    assert one(spark, dates.extract_deadline(F.col("x")), x=said) == want


def test_feed_dates(spark):
    held = {"Mon, 31 Aug 2026 23:30:00 -0200": D(2026, 9, 1), "31 Aug 2026": D(2026, 8, 31), "2026-08-31T23:30:00-02:00": D(2026, 9, 1), "2026-08-31 23:30": D(2026, 8, 31), "2026/08/31": D(2026, 8, 31), "soon": None, "": None}
    assert {x: one(spark, dates.feed_date(F.col("x")), x=x) for x in held} == held


# Landing and registry


def test_pages_up_to_a_failure_and_page_dedup(spark):
    held = landed(spark, ("a", "RSS", 1, 200, ""), ("a", "RSS", 2, 200, ""), ("a", "RSS", 3, 500, ""), ("a", "RSS", 4, 200, ""), ("b", "RSS", 1, 404, ""), ("b", "RSS", 2, 200, ""), ("c", "RSS", 21, 200, ""))
    assert sorted((r["source_id"], r["page"]) for r in landing.pages_to_read(held).collect()) == [("a", 1), ("a", 2), ("b", 2)]
    assert sorted(tuple(r) for r in landing.errors(held).collect()) == [("a", "HTTP 500 on page 3"), ("b", "HTTP 404 on page 1")]
    rows = [("s", 1, "A", "l1"), ("s", 1, "A", "l1"), ("s", 2, "a ", "L1"), ("s", 2, "B", "l2"), ("t", 2, "A", "l1"), ("s", 3, None, None)]
    got = landing.page_dedup(spark.createDataFrame(rows, "source_id string, page int, title string, link string")).collect()
    assert sorted((r["source_id"], r["page"], r["title"] or "") for r in got) == [("s", 1, "A"), ("s", 1, "A"), ("s", 2, "B"), ("s", 3, ""), ("t", 2, "A")]


def test_pages_end_at_two_empty_ones_in_a_row(spark):
    pages = spark.createDataFrame([("a", p) for p in range(1, 7)] + [("b", 1), ("b", 2)], "source_id string, page int")
    entries = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 6, "z"), ("b", 2, "w")], "source_id string, page int, title string")
    assert sorted(r["title"] for r in landing.until_empty(entries, pages).collect()) == ["w", "x", "y"]


def test_registry_read_checks_counts(spark, tmp_path):
    (tmp_path / "r.csv").write_text("source_id,code,name,method,url,active\na1,A,N,RSS,https://x,oui\nb 1,B,N,RSS,u,oui\nc1,A,N,JSON:x,,non\nd1,D,N,FTP,u,1\ne1,E,N,MANUAL,,\n")
    held = registry.read_registry(spark, str(tmp_path / "r.csv"))
    assert sorted((r["source_id"], r["active"]) for r in held.collect()) == [("a1", True), ("c1", False), ("d1", True), ("e1", False)]
    assert sorted(tuple(r) for r in registry.problems(held).collect()) == [("A", "code repeats"), ("A", "no address"), ("D", "unknown method")]
    assert {r["kind"]: (r["n"], r["n_active"]) for r in registry.counts(held).collect()} == {"RSS": (1, 1), "JSON": (1, 0), "FTP": (1, 1), "MANUAL": (1, 0)}
    assert missing(held, SOURCE) == [] and missing(held.drop("code"), SOURCE) == ["code"] and conform(held.select("source_id"), SOURCE).columns == SOURCE.names


def test_ids_follow_without_gaps(spark):
    tracked = spark.createDataFrame([("TP-000007",), ("TP-999999",), ("x",), (None,)], "id string")
    new = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "ord string").repartition(7)
    got = sorted((r["ord"], r["id"]) for r in ids.assign_ids(new, tracked, "ord").collect())
    assert got == [(f"k{i:04d}", f"TP-{1_000_000 + i}") for i in range(500)]


# The upsert against a plain ordered fold


def folded(rows, fields):
    """rows: dicts with ord, tracked, keys and fields, tracked ones first."""
    owner, out = {}, []
    for r in rows:
        hit = None if r["tracked"] else next((owner[k] for k in r["keys"] if k in owner), None)
        if hit is None:
            out.append({f: r[f] for f in fields} | {"ord": r["ord"], "tracked": r["tracked"], "outcome": "tracked" if r["tracked"] else "new"})
            for k in r["keys"]:
                owner.setdefault(k, out[-1])
            continue
        for f in fields:
            value, held = r[f], hit[f]
            if value is None or not value.strip():
                continue
            if hit["tracked"] and held != value:
                hit[f], hit["outcome"] = value, "updated"
            elif not hit["tracked"] and (held is None or not held.strip()):
                hit[f] = value
    return out


def test_upsert_is_the_ordered_fold(spark):
    r, fields = random.Random(4), ["title", "budget"]
    keys = [f"k{i}" for i in range(60)]
    make = lambda i, t: {"ord": f"{i:05d}", "tracked": t, "keys": r.sample(keys, r.choice((1, 1, 2, 3))), "title": r.choice([None, " ", "a", "b", "c"]), "budget": r.choice([None, "1", "2"])}
    tracked, incoming = [make(i, True) for i in range(25)], [make(i, False) for i in range(120)]
    schema = "ord string, keys array<string>, title string, budget string"
    frame = lambda rows: spark.createDataFrame([(x["ord"], x["keys"], x["title"], x["budget"]) for x in rows], schema)
    got = resolve.upsert(frame(tracked), frame(incoming), fields=fields).collect()
    name = lambda x: (x["tracked"], x["ord"])
    want = {name(x): (x["title"], x["budget"], x["outcome"]) for x in folded([*tracked, *incoming], fields)}
    assert {name(x): (x["title"], x["budget"], x["outcome"]) for x in got} == want


def upserted(spark, tracked, incoming, fields):
    schema = "ord string, keys array<string>, title string, budget string"
    frame = lambda rows: spark.createDataFrame([(x["ord"], x["keys"], x["title"], x["budget"]) for x in rows], schema)
    return {(x["tracked"], x["ord"]): (x["title"], x["budget"], x["outcome"]) for x in resolve.upsert(frame(tracked), frame(incoming), fields=fields).collect()}


@pytest.mark.parametrize("rounds", [1, 3, 12])
@pytest.mark.parametrize("seed", [1, 2])
def test_owners_found_in_rounds_are_those_of_the_fold(spark, monkeypatch, seed, rounds):
    """Dense and sparse graphs, chains in which each row waits for the one before, and too few rounds for them."""
    monkeypatch.setattr(resolve.owners, "__defaults__", (rounds,))
    r, fields = random.Random(seed), ["title", "budget"]
    say = lambda: {"title": r.choice([None, " ", "a", "b"]), "budget": r.choice([None, "1", "2"])}
    make = lambda i, t, keys: {"ord": f"{i:05d}", "tracked": t, "keys": keys} | say()
    incoming = [make(i, False, r.sample([f"d{k}" for k in range(30)], r.choice((1, 2, 3)))) for i in range(60)]
    incoming += [make(100 + i, False, [f"c{i}", f"c{i + 1}"]) for i in range(40)]
    incoming += [make(200 + i, False, [f"s{r.randrange(200)}", f"s{r.randrange(200)}", f"d{r.randrange(30)}"][: r.choice((0, 1, 2, 3))]) for i in range(60)]
    tracked = [make(i, True, [f"d{r.randrange(30)}", f"c{r.randrange(41)}"]) for i in range(8)]
    want = {(x["tracked"], x["ord"]): (x["title"], x["budget"], x["outcome"]) for x in folded([*tracked, *incoming], fields)}
    assert upserted(spark, tracked, incoming, fields) == want


def test_a_notice_with_many_copies_is_in_no_single_task(spark):
    """200,000 copies of one tracked notice: what goes through the shuffles to its owner is a row for each task that has some."""
    n = 200_000
    tracked = spark.createDataFrame([("t", ["k", "q"], "held", "0")], "ord string, keys array<string>, title string, budget string")
    key = F.array(F.lit("k"), F.concat(F.lit("own"), F.col("id").cast("string")))
    incoming = spark.range(n, numPartitions=16).select(F.format_string("%09d", "id").alias("ord"), key.alias("keys"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("title"), F.lit(" ").alias("budget"))
    out = resolve.upsert(tracked, incoming, fields=["title", "budget"])
    assert [tuple(x) for x in out.select("title", "budget", "outcome").collect()] == [(f"v{n - 1}", "0", "updated")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Window" not in plan


def test_a_chain_of_keys_is_not_merged(spark):
    schema = "ord string, keys array<string>, title string, budget string"
    empty = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([("1", ["A"], "one", None), ("2", ["B", "C"], "two", None), ("3", ["A", "B"], "three", "9")], schema)
    got = {r["ord"]: (r["title"], r["budget"], r["outcome"]) for r in resolve.upsert(empty, rows, fields=["title", "budget"]).collect()}
    assert got == {"1": ("one", "9", "new"), "2": ("two", None, "new")}


def test_known_and_new_rows(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, [])], "n int, keys array<string>")
    b = spark.createDataFrame([(["y"],), (["q"],)], "keys array<string>")
    assert [r["n"] for r in resolve.known(a, b, "keys", is_known=True).collect()] == [1]
    assert sorted(r["n"] for r in resolve.known(a, b, "keys", is_known=False).collect()) == [2, 3]


# A pass and its stream


def bodies(spark):
    first = rss(("Travaux de forage", "https://s1.org/1", "Date limite : 15/10/2026"), ("Vieux", "https://s1.org/2", "Date limite : 15/08/2026"), ("Plan de passation", "https://s1.org/3", ""))
    return landed(spark, ("s1", "RSS", 1, 200, first), ("s1", "RSS", 2, 200, rss(("Travaux de forage", "https://s1.org/1", "x"))), ("s2", "RSS", 1, 200, rss(("Vaccins", "https://s2.org/1", "Deadline: 5 September 2026"))), ("off", "RSS", 1, 200, rss(("Hidden", "https://off.org/1", ""))), ("s2", "RSS", 3, 500, None))


def test_a_pass_reads_fills_filters_and_is_idempotent(spark):
    empty = spark.createDataFrame([], NOTICE)
    done = passes.run_pass(empty, bodies(spark), sources(spark), AS_OF)
    rows = {r["title"]: r for r in done.collect()}
    assert sorted(rows) == ["Travaux de forage", "Vaccins"]
    a, b = rows["Travaux de forage"], rows["Vaccins"]
    assert (a["country"], a["type"], a["organisation"], a["sector"], a["status"], a["days_left"], a["outcome"]) == ("Benin", "Appel d'offres", "Source un", "Eau et assainissement", "OUVERT", 44, "new")
    assert (b["sector"], b["status"], b["country"]) == ("Sante", "BIENTOT", "Togo") and sorted((a["id"], b["id"])) == ["TP-000001", "TP-000002"]
    again = passes.run_pass(done.drop("outcome"), bodies(spark), sources(spark), D(2026, 9, 3))
    assert sorted((r["id"], r["title"], r["outcome"], r["days_left"]) for r in again.collect()) == sorted((r["id"], r["title"], "tracked", r["days_left"] - 2) for r in rows.values())
    assert boards.run_summary(done, 3).first().asDict() == {"added": 2, "updated": 0, "followed": 0, "sent": 3}


def test_stream_of_passes_survives_a_lost_checkpoint_and_replay(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    bodies(spark).write.parquet(path("landing"))
    start(spark, path("landing"), path("store"), path("check1"), sources(spark), lambda: AS_OF).awaitTermination()
    first = Snapshots(spark, path("store")).latest()
    assert first.count() == 2
    landed(spark, ("s1", "RSS", 1, 200, rss(("Etude", "https://s1.org/9", "")))).write.mode("append").parquet(path("landing"))
    shutil.rmtree(path("check1"))  # the stream forgets what it has read and counts from 0 again
    start(spark, path("landing"), path("store"), path("check2"), sources(spark), lambda: AS_OF).awaitTermination()
    store = Snapshots(spark, path("store"))
    held = {r["title"]: r["id"] for r in store.latest().collect()}
    assert held == {"Travaux de forage": held["Travaux de forage"], "Vaccins": held["Vaccins"], "Etude": "TP-000003"}
    stream = json.loads((tmp_path / "check2" / "metadata").read_text())["id"]
    last = max(r["version"] for r in store.log())
    batch = next(r["batch"] for r in store.log() if r["version"] == last)
    assert store.begin(stream, batch, D(2030, 1, 1)) == (last, AS_OF)  # run again: its version and its day
    assert store.before(last).count() == 2


# Sending and boards


def notices(spark, rows):
    full = [dict.fromkeys(NOTICE.names) | r for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in NOTICE.names) for r in full], NOTICE)


def test_sending_by_relevance_under_caps(spark):
    r, rows = random.Random(2), []
    for i in range(40):
        rows.append({"id": f"TP-{i:06d}", "title": f"t{i}", "days_left": r.choice([None, 0, 1, 3, 7, 30, -1]), "relevance": r.choice(["3 - PRIORITAIRE", "2 - A VOIR", "0 - HORS PROFIL"]), "sent_new": r.choice([None, "email", "email,telegram"]), "sent_j7": r.choice([None, "telegram"])})
    settings = sending.Sending(caps=(("email", 9), ("telegram", 0)), relevance="3;2", digest_over=100)
    digest, planned = sending.plan(notices(spark, rows), F.lit(False), settings)
    got = {(x["channel"], x["id"]): (x["send"], x["passes"]) for x in planned.collect()}
    assert not digest
    order = sorted((x for x in rows if x["relevance"][0] in "32"), key=lambda x: (-int(x["relevance"][0]), 9999 if x["days_left"] is None else x["days_left"], x["id"]))
    want = {}
    for channel, cap in (("email", 9), ("telegram", 10**9)):
        sent = 0
        for x in order:
            done = {k: (x.get(f"sent_{k}") or "").split(",") for k in ("new", "j7", "j3", "j1")}
            d = x["days_left"]
            open_ones = [k for k, upto in (("j1", 1), ("j3", 3), ("j7", 7)) if d is not None and 0 <= d <= upto and channel not in done[k]]
            send = (["new"] if channel not in done["new"] else []) + open_ones[:1]
            if not send:
                continue
            fits = sent + len(send) <= cap
            sent += len(send) * fits
            want[channel, x["id"]] = (send, fits)
    assert got == want
    marked = {x["id"]: x["sent_new"] for x in passes.mark_sent(notices(spark, rows), planned.filter("passes"), "email").collect()}
    for x in rows:
        sent = want.get(("email", x["id"]))
        assert ("email" in (marked[x["id"]] or "")) == ("email" in (x["sent_new"] or "") or bool(sent and sent[1] and "new" in sent[0]))


def test_many_new_notices_make_a_digest_that_costs_one_message(spark):
    rows = [{"id": f"TP-{i:06d}", "title": f"t{i}", "days_left": 3 if i < 4 else 30, "relevance": "3 - PRIORITAIRE"} for i in range(12)]
    digest, planned = sending.plan(notices(spark, rows), F.lit(True), sending.Sending(caps=(("email", 3), ("telegram", 1))))
    got = {(x["channel"], x["id"]): x for x in planned.collect()}
    assert digest and all("new" not in x["send"] for x in got.values())
    assert sum(x["passes"] for k, x in got.items() if k[0] == "email" and x["needs"]) == 2 and not any(x["passes"] for k, x in got.items() if k[0] == "telegram" and x["needs"])
    assert all(x["passes"] for x in got.values() if not x["needs"])
    flagged = sending.recap(planned.join(notices(spark, rows).select("id", "days_left"), "id"), F.col("days_left"), over=3)
    assert {x["id"] for x in flagged.filter("in_recap").collect()} == {f"TP-{i:06d}" for i in range(4)}
    said = sending.chat_digest(notices(spark, rows), "id", most=10).first()["text"].split("\n")
    assert said[0] == "- t0" and len(said) == 11 and said[-1] == "... et 2 autre(s)"


def test_messages(spark):
    row = notices(spark, [{"id": "TP-000001", "title": "A < B", "organisation": "Org", "days_left": 2, "deadline": D(2026, 9, 3), "link": "https://x.org/?a=1&b=2"}])
    o = {c: F.col(c) for c in NOTICE.names}
    mail, chat = row.select(notify.mail(F.lit("j3"), o, "[t]").alias("m"), notify.chat(F.lit("j3"), o).alias("c")).first()
    assert mail["subject"] == "[t] URGENT - 2 jours restants - A < B" and "Deadline : 2026-09-03" in mail["body"] and "Resume" not in mail["body"]
    assert chat.split("\n") == ["<b>URGENT - echeance proche</b>", "A &lt; B", "Org", "Echeance : 2026-09-03 (dans 2 jours)", "https://x.org/?a=1&amp;b=2"]


def test_verdicts_only_say_what_they_may(spark):
    schema = "n int, title string, type string, sector string, summary string, deadline string, relevant boolean, opportunity boolean"
    held = spark.createDataFrame([(0, "a", "X", None, "own", "2026-01-01", None, None), (1, "b", "X", "S", "own", None, None, True), (2, "c", "Evenement", None, None, None, None, None)], schema)
    said = spark.createDataFrame([(0, "sante", "nonsense", "  ", False, None), (1, "zzz", "bourse", "better", None, False), (9, "Eau", None, None, None, None)], "n int, sector string, type string, summary string, relevant boolean, opportunity boolean")
    got = boards.with_verdicts(held, said, ["n"], ["Sante", "Eau"], ["Bourse"])
    assert got.columns == held.columns
    assert sorted(tuple(x) for x in got.collect()) == [(0, "a", "X", "Sante", "own", "2026-01-01", False, None), (1, "b", "Bourse", "S", "better", None, None, False), (2, "c", "Evenement", None, None, None, None, None)]
    count = lambda df: sorted(x["n"] for x in df.collect())
    assert (count(boards.opportunities(got)), count(boards.relevant_ones(got)), count(boards.by_preferences(got)), count(boards.by_preferences(got, events=True, by_zone=True))) == ([0, 2], [2], [0], [2])


def test_boards(spark):
    rows = spark.createDataFrame([("RSS", "Sante", "oui", D(2026, 9, 9), None, 3), ("RSS", " ", "non", None, None, None), ("JSON", "Eau", "true", D(2026, 9, 9), "e1", -2)], "method string, sector string, followed string, deadline date, event string, days_left int").withColumn("id", F.col("sector"))
    assert sorted(tuple(x) for x in boards.facets(rows, ["method", "sector"]).collect()) == [("method", "JSON", 1), ("method", "RSS", 2), ("sector", "Eau", 1), ("sector", "Sante", 1)]
    assert boards.by_facets(rows, method="RSS", sector=None).count() == 2 and sorted(x["value"] for x in boards.form_options(rows, "sector").collect()) == ["Eau", "Sante"]
    assert boards.tiles(rows.withColumn("sent_new", F.lit(None).cast("string")), sources(spark)).first().asDict() == {"total": 3, "within_week": 1, "sources": 2, "alerts": 3}
    assert [x["sector"] for x in boards.calendar_candidates(rows, "event").collect()] == ["Sante"]
    assert rows.select(boards.calendar_text(F.col("method"), F.col("event"), F.col("sector")).alias("t")).first()["t"] == "RSS\nSante"
    assert [x["sector"] for x in boards.deadline_list(rows, classify.bucket(F.col("days_left"), F.lit(""), ()), ["j3", "expired"]).collect()] == ["Eau", "Sante"]
    assert {x["method"]: (x["filled"], x["fields"], x["share"]) for x in boards.section_completeness(rows, "method", "sector").collect()} == {"RSS": (1, 2, 0.5), "JSON": (1, 1, 1.0)}
    assert boards.import_counters(rows, F.col("method") == "JSON", F.coalesce(F.col("days_left") > 0, F.lit(False)), F.lit(False)).first().asDict() == {"imported": 1, "skipped": 1, "excluded": 1, "failed": 0}
    listed = spark.createDataFrame([("a", "x ", "oui"), ("a", "y", "non"), ("a", "w", "1"), ("b", " ", "oui")], "block string, value string, checked string")
    assert [(x["block"], x["values"]) for x in boards.watch_lists(listed).collect()] == [("a", ["w", "x"])]
