"""Every reader on a small page or payload of its shape, with rows that it must drop."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import apis, feeds, pages
from tidemark.sources.entries import read_entries

D = datetime.date
AS_OF = D(2026, 9, 1)


@pytest.fixture(scope="module")
def readers(spark):
    return pages.readers(F.lit(AS_OF))


def read(spark, reader, body):
    """Entries as dicts without what is null or blank."""
    rows = spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body),)], "body string").select(reader(F.col("body")).alias("e")).first()["e"]
    return [{k: v for k, v in r.asDict().items() if v not in (None, "")} for r in rows]


def only(rows, *fields):
    return [tuple(r.get(f) for f in fields) for r in rows]


# Feeds


def test_rss_items_with_entities_cdata_and_deadline(spark):
    body = """<?xml version="1.0"?><rss><channel><title>T</title>
    <item><title><![CDATA[Appel d&#39;offres &amp; travaux]]></title><link>https://a.org/1?utm_source=x&amp;id=7</link><pubDate>Mon, 31 Aug 2026 23:30:00 -0200</pubDate>
      <description>&lt;p&gt;Date limite : 15/10/2026&lt;/p&gt;</description><author>info@a.org (Agence A)</author></item>
    <item><title> </title><link>https://a.org/2</link></item>
    <item><title>Sans date</title><link>https://a.org/3</link><description>Publié le 15/10/2026</description></item></channel></rss>"""
    rows = read(spark, feeds.read_feed, body)
    assert only(rows, "title", "link", "published", "deadline", "organisation") == [
        ("Appel d'offres & travaux", "https://a.org/1?id=7", D(2026, 9, 1), D(2026, 10, 15), "Agence A"),
        ("Sans date", "https://a.org/3", None, None, None),
    ]


def test_atom_takes_the_alternate_link(spark):
    body = """<feed><entry><title>Grant</title><link rel="self" href="https://b.org/self"/><link rel="alternate" href="https://b.org/page"/>
    <updated>2026-08-30T10:00:00Z</updated><summary>Deadline: 5 October 2026</summary></entry></feed>"""
    assert only(read(spark, feeds.read_feed, body), "title", "link", "published", "deadline") == [("Grant", "https://b.org/page", D(2026, 8, 30), D(2026, 10, 5))]


def test_feeds_empty_broken_and_null(spark):
    held = spark.createDataFrame([("<rss><channel></channel></rss>",), ("<html>no</html>",), ("",), (None,), ('<?xml?><rdf:RDF xmlns="x">',)], "b string")
    assert [r["f"] for r in held.select(feeds.is_feed(F.col("b")).alias("f")).collect()] == [True, False, False, False, True]
    for body in ("<rss><channel></channel></rss>", "<html>no</html>", ""):
        assert read(spark, feeds.read_feed, body) == []


# APIs


def test_world_bank_drops_awards(spark):
    row = {"id": "OP1", "notice_type": "Invitation for Bids", "bid_description": "Water works", "project_name": "Water", "contact_organization": "Ministry", "noticedate": "2026-08-01T00:00:00Z", "submission_deadline_date": "2026-10-01T12:00:00Z"}
    rows = read(spark, apis.world_bank, {"procnotices": [row, row | {"notice_type": "Contract Award"}, row | {"bid_description": None}]})
    assert only(rows, "title", "link", "published", "deadline", "organisation", "type") == [
        ("Water works", "https://projects.worldbank.org/en/projects-operations/procurement-detail/OP1", D(2026, 8, 1), D(2026, 10, 1), "Ministry", "Invitation for Bids")
    ]


def test_fundpilote_list_and_detail(spark):
    row = {"id": 5, "title": "Prix", "funding_type": "grant", "amount_min": "1000", "amount_max": "5000", "currency": "EUR", "deadline": "2026-10-02", "sponsor_name": "F", "eligible_countries": ["Benin", " ", "Togo"], "source_url": "https://s.org/x"}
    rows = read(spark, apis.fundpilote, {"results": [row, row | {"id": 0}, row | {"id": 6, "title": ""}]})
    assert only(rows, "title", "link", "type", "deadline", "detail_url", "organisation") == [("Prix", "https://s.org/x", "Subvention", D(2026, 10, 2), "https://fundpilote.com/api/v1/opportunities/5/", "F")]
    assert "Pays eligibles : Benin, Togo" in rows[0]["summary"] and "EUR" in rows[0]["budget"]
    body = json.dumps({"application_url": "https://www.apply.org/a?utm_source=m", "description": "D" * 400, "how_to_apply": "Online"})
    got = spark.createDataFrame([(body,), ("{}",), ("no json",)], "b string").select(apis.fundpilote_detail(F.col("b")).alias("d")).collect()
    assert (got[0]["d"]["link"], got[0]["d"]["source"]) == ("https://www.apply.org/a", "apply.org") and got[0]["d"]["summary"].endswith("Candidature : Online")
    assert all(tuple(r["d"]) == (None, None, None) for r in got[1:])


def test_europa_keeps_one_language(spark):
    def row(name, lang, title, **more):
        return {"url": more.pop("url", None), "metadata": {"identifier": [name], "language": [lang], "title": [title], "deadlineDate": ["2026-11-03T17:00"], "type": ["2"]} | more}

    rows = read(spark, apis.europa, {"results": [row("A-1", "en", "Call"), row("A-1", "fr", "Appel"), row("B-2", "de", "Ruf"), row("B-2", "en", "Other"), row("", "en", "Lost")]})
    assert only(rows, "title", "type", "deadline") == [("Appel", "Appel a projets", D(2026, 11, 3)), ("Ruf", "Appel a projets", D(2026, 11, 3))]
    assert rows[0]["link"].endswith("topic-details/A-1")


def test_grants_gov_days_are_month_first(spark):
    row = {"id": "9", "number": "N-1", "title": "Health &amp; more", "openDate": "08/05/2026", "closeDate": "10/31/2026", "agencyCode": "HHS"}
    rows = read(spark, apis.grants_gov, {"data": {"oppHits": [row, row | {"number": ""}, row | {"title": None}, row | {"agencyCode": None, "closeDate": "2026-12-01"}]}})
    assert only(rows, "title", "published", "deadline", "organisation") == [("Health & more", D(2026, 8, 5), D(2026, 10, 31), "HHS"), ("Health & more", D(2026, 8, 5), D(2026, 12, 1), "Gouvernement des Etats-Unis")]


def test_niger_marches_types_by_title(spark):
    make = lambda t, **m: {"link": "https://n.ne/1", "date": "2026-08-20T09:00:00", "title": {"rendered": t}, "acf": {"date_expiration": "2026-09-30", "nom_de_la_societe": "S&amp;Co"} | m}
    rows = read(spark, apis.niger_marches, [make("Avis &agrave; manifestation d&rsquo;inter&ecirc;t"), make("Recrutement d'un consultant"), make("")])
    assert only(rows, "type", "deadline", "organisation") == [("AMI", D(2026, 9, 30), "S&Co"), ("Recrutement", D(2026, 9, 30), "S&Co")]


def test_oracle_drops_cancelled_and_awarded(spark):
    row = {"NegotiationTitle": "Vehicles", "Negotiation": "N1", "NegotiationType": "RFQ", "NegotiationStatus": "Active", "CloseDate": "2026-09-20T10:00:00+00:00", "PostingDate": "2026-08-20", "ProcurementBUId": 77, "ProcurementBUName": "UNDP-Nairobi", "Synopsis": "S", "links": [{"href": "https://h.oraclecloud.com:443/x"}]}
    rows = read(spark, apis.oracle_negotiations, {"items": [row, row | {"NegotiationStatus": "CANCELED"}, row | {"NegotiationStatus": "Awarded"}, row | {"ProcurementBUName": "UNDP-Togo"}]})
    assert only(rows, "title", "country", "deadline", "summary") == [("Vehicles", "Kenya", D(2026, 9, 20), "N1 - S"), ("Vehicles", "Togo", D(2026, 9, 20), "N1 - S")]
    assert rows[0]["link"].startswith("https://h.oraclecloud.com/fscmUI/") and rows[0]["link"].endswith("prcBuId=77")


def test_dncmp_calls_and_plan_lines(spark):
    row = {"expired": False, "dosReference": "R1", "dosNombreLots": 3, "dosFichier": "https://m.bj/a b.pdf", "dosDateLimiteDepot": "2026-09-25", "autoriteContractante": {"denomination": "Mairie\n de X"}, "appelsoffres": {"apoObjet": "Pont", "typemarche": {"libelle": "Travaux"}}}
    rows = read(spark, apis.dncmp, {"content": [row, row | {"expired": True}, row | {"appelsoffres": {"apoObjet": ""}, "dosDescriptif": None}]})
    assert only(rows, "title", "pdf", "organisation", "type", "summary", "deadline") == [("Pont", "https://m.bj/a%20b.pdf", "Mairie de X", "Travaux", "R1 - 3 lots", D(2026, 9, 25))]
    line = {"utilisable": 1, "datelancement": "2026-10-01", "libelle": "Route", "reference": "P1", "montantEstime": "1500000", "modepassation_ID": {"code": "AO"}, "typeMarche": {"libelle": "Travaux"}, "plan": {"annee": "2026"}}
    body = json.dumps({"content": [line, line | {"utilisable": 0}, line | {"datelancement": "2026-08-31"}, line | {"datelancement": None}, line | {"reference": ""}]})
    got = spark.createDataFrame([(body,)], "b string").select(apis.plan_lines(F.col("b"), F.lit("Mairie"), F.lit(AS_OF)).alias("l")).first()["l"]
    assert [(x["reference"], x["object"], x["mode"], x["launch"]) for x in got] == [("P1", "Route", "AO", D(2026, 10, 1))]


@pytest.mark.parametrize("name", apis.READERS)
def test_apis_give_nothing_of_broken_bodies(spark, name):
    for body in ("", "not json", "{}", "[]", '{"results": 3}'):
        assert read(spark, apis.READERS[name], body) == []


# Pages: (page, fields, rows)
CASES = {
    "HTML:gouv.bj": (
        """<article class="x"><a href="https://www.gouv.bj/opportunite/1/"></a><p>Marchés publics Appel d'offres Construction d'un pont Clôture le : date limite 12/10/2026</p></article>
        <article><p>Sans lien</p></article>""",
        ("title", "link", "deadline"), [("Construction d'un pont", "https://www.gouv.bj/opportunite/1/", D(2026, 10, 12))],
    ),
    "HTML:afdb.org": (
        """<a class="t" href="/en/documents/eoi-benin-water-supply-project">EOI - Benin - Water supply</a><a href="/en/documents/eoi-benin-water-supply-project">EOI - Benin - Water supply</a>
        <a href="/en/documents/annual-report-2026-of-the-bank">Annual report 2026</a>""",
        ("title", "link"), [("EOI - Benin - Water supply", "https://www.afdb.org/en/documents/eoi-benin-water-supply-project")],
    ),
    "HTML:enabel.be": (
        """<div class="card card--tenders open"><p class="h5">Seeds</p><strong>Country:</strong> Benin<br><strong>Status:</strong> Open<br><strong>Closing date:</strong> 10/10/2026<a href="https://www.enabel.be/publication/seeds">x</a></div>
        <div class="card card--tenders"><p class="h5">Old</p><strong>Status:</strong> Closed</div><footer>""",
        ("title", "link", "deadline"), [("Seeds", "https://www.enabel.be/publication/seeds", D(2026, 10, 10))],
    ),
    "HTML:armp.bj": (
        """<div class="timer a"><i></i> 28 Aug 2026 </div><p><a class="title_cat" href="https://armp.bj/av/1"  title="Avis de manifestation d'int&eacute;r&ecirc;t">x</a></p>
        <div class="timer"><i></i> 29 Aug 2026 </div><a class="title_cat" href="https://armp.bj/av/1" title="Twice the link here">x</a>
        <div class="timer"><i></i> 29 Aug 2026 </div><a class="title_cat" href="https://armp.bj/av/2" title="short">x</a>""",
        ("title", "link", "published", "type"), [("Avis de manifestation d'intérêt", "https://armp.bj/av/1", D(2026, 8, 28), "AMI")],
    ),
    "HTML:sbee.bj": (
        """<div class="blog-item-wrapper"><h3>C&acirc;bles</h3><p class="job-details a">Lot 1</p><strong>Type de march&eacute;</strong><br>Fournitures<strong>Type de marché</strong><br/>Fournitures
        <span><strong>Date de publication</strong></span><br>01/09/2026 08:00<strong>Date limite de dépôt</strong><br/>30/09/2026<a href="https://m.bj/demande-dossier/appel-doffre/12">x</a></div><div class="blog-item-wrapper"><h3></h3></div><footer>""",
        ("title", "type", "published", "deadline", "link"), [("Câbles", "Fournitures", D(2026, 9, 1), D(2026, 9, 30), "https://m.bj/demande-dossier/appel-doffre/12")],
    ),
    "HTML:soneb.bj": (
        """<table><tr><td>h</td></tr><tr><td class="views-field-created"><time datetime="2026-08-15T10:00:00Z"></time></td><td><a href="/marche-public/pompes">Pompes</a></td><td class="views-field-field-date-de-cloture">20/09/2026</td></tr></table>""",
        ("title", "link", "published", "deadline"), [("Pompes", "https://web.soneb.bj/marche-public/pompes", D(2026, 8, 15), D(2026, 9, 20))],
    ),
    "HTML:araa.org": (
        """<div class="item-offre"><h2 class="title"><a href="/fr/offre-1">Etude</a></h2><time datetime="2026-10-08T12:00:00Z"></time></div><div class="item-offre"><h2 class="title">no link</h2></div>""",
        ("title", "link", "deadline"), [("Etude", "https://www.araa.org/fr/offre-1", D(2026, 10, 8))],
    ),
    "HTML:bceao.int": (
        """<div class="itemDoc views-row"><a href="https://www.bceao.int/fr/appels-offres/ao-1"><span class="ttr">Mobilier</span><span class="subTtr">Date limite : 09/10/2026</span></a><span class="infoFile"><time>01/08/2026</time></span></div>
        <div class="itemDoc views-row"><span class="ttr">Elsewhere</span></div>""",
        ("title", "link", "published", "deadline"), [("Mobilier", "https://www.bceao.int/fr/appels-offres/ao-1", D(2026, 8, 1), D(2026, 10, 9))],
    ),
    "HTML:abe.bj": (
        """<div class="col marche-item x"><div class="py-3 header"><p class="white">Demande de prix</p></div><p>OBJET</p><p>Achat de v&eacute;hicules</p><p>DATE DE SOUMISSION</p><p>11/10/2026</p><a class="b" href="https://www.abe.bj/d/1">CONSULTER</a></div>
        <div class="marche-item"></div><footer>""",
        ("title", "type", "deadline", "link"), [("Achat de véhicules", "Demande de prix", D(2026, 10, 11), "https://www.abe.bj/d/1")],
    ),
    "HTML:dedras.org": (
        """<!-- <div class="card"><div class="" style="font-weight:bold;">Hidden</div></div> --><div class="card"><div class="" style="font-weight:bold;">Kits</div>
        <div><span>Type de march&eacute;</span></div> <div class="row"><span class="a">DRP</span></div><div><span>Limite de d&eacute;pot</span></div><div class="row"><span>2026-09-18 10:00</span></div>
        <div><span>Limite de dépot</span></div><div class="row"><span>2026-09-18 10:00</span></div></div><footer>""",
        ("title", "type", "deadline"), [("Kits", "DRP", D(2026, 9, 18))],
    ),
    "HTML:afd.fr": (
        """<div class="views-row fr-col-12"><a href="/fr/appels-a-projets/eau">Eau</a><p class="fr-card__detail">01/09/2026 - 15/10/2026</p></div><div class="views-row fr-col-12"><p>rien</p></div><footer>""",
        ("title", "link", "published", "deadline", "type"), [("Eau", "https://www.afd.fr/fr/appels-a-projets/eau", D(2026, 9, 1), D(2026, 10, 15), "Appel a projets")],
    ),
    "HTML:wellcome.org": (
        '<script id="__NEXT_DATA__" type="application/json">'
        + json.dumps({"props": {"pageProps": {"initialListings": [{"title": "Early career", "url": "/grants/e", "scheme_status": "Open", "scheme_closes_for_applications": "6 October 2026", "location_ref": [{"name": "UK"}, {"name": " "}]}, {"title": "Shut", "url": "/grants/s", "scheme_status": "Closed"}]}}})
        + "</script>",
        ("title", "link", "deadline", "summary"), [("Early career", "https://wellcome.org/grants/e", D(2026, 10, 6), "Zones : UK")],
    ),
    "HTML:grandchallenges.org": (
        '<script id="__NEXT_DATA__">'
        + json.dumps({"props": {"pageProps": {"initialData": {"listing": {"data": [{"title": "Malaria", "url": "/c/1", "date_end": 1793404800}, {"title": "Past", "url": "/c/2", "date_end": 1700000000}, {"title": "Hidden", "url": "/c/3", "date_end": 1793404800, "hidden": True}, {"title": "No end", "url": "/c/4"}]}}}}})
        + "</script>",
        ("title", "link", "deadline"), [("Malaria", "https://gcgh.grandchallenges.org/c/1", D(2026, 10, 31))],
    ),
    "HTML:unicef.org/supply": (
        """<a href="/supply/documents/vaccines-tender-calendar">a</a><a href="/supply/documents/vaccines-tender-calendar">again</a><a href="/supply/media/123/file/UNICEF-nutrition.pdf">b</a><a href="/supply/contact">c</a>""",
        ("title", "link"), [("UNICEF Supply - Vaccines tender calendar", "https://www.unicef.org/supply/documents/vaccines-tender-calendar"), ("UNICEF Supply - nutrition", "https://www.unicef.org/supply/media/123/file/UNICEF-nutrition.pdf")],
    ),
    "HTML:giz.de": (
        """<table><tr class="a"><td>01.08.2026</td><td>15.09.2026</td><td>Beratung Benin</td><td>Verhandlungsverfahren mit Teilnahmewettbewerb</td><td>GIZ</td><td><a href="/x/projectForwarding.do?pid=55">x</a></td></tr>
        <tr><td>01.08.2026</td><td>15.09.2026</td><td>Ohne Verfahren</td><td> </td><td>GIZ</td><td><a href="/x/projectForwarding.do?pid=57">x</a></td></tr>
        <tr><td>01.08.2026</td><td>15.09.2026</td><td>Alt</td><td>Vergebener Auftrag</td><td>GIZ</td><td><a href="/x/projectForwarding.do?pid=56">x</a></td></tr>
        <tr><td>01.08.2026</td><td>15.09.2026</td><td>Ohne Link</td><td>Offen</td><td>GIZ</td></tr></table>""",
        ("title", "link", "published", "deadline", "type", "organisation"), [("Beratung Benin", "https://ausschreibungen.giz.de/x/projectForwarding.do?pid=55", D(2026, 8, 1), D(2026, 9, 15), "AMI", "GIZ"), ("Ohne Verfahren", "https://ausschreibungen.giz.de/x/projectForwarding.do?pid=57", D(2026, 8, 1), D(2026, 9, 15), "Appel d'offres", "GIZ")],
    ),
    "HTML:expertise-france.gestmax.fr": (
        """<div class="list-group-item"><a href="https://expertise-france.gestmax.fr/12/1/chef?x=1"><h2>Chef de projet (Nouvelle fen&ecirc;tre)</h2></a><span class="country"><i></i><strong>Afrique</strong></span><span class="country"><strong>Bénin</strong></span>
        <div class="text-blue-light listdiv-value">CDD</div><div class="text-grey listdiv-value">Date limite : 20/09/2026</div><div class="listdiv-vac_thematique"><span class="listdiv-value">Santé</span></div></div>
        <div class="list-group-item"><h2>Sans lien</h2></div><div class="pager">""",
        ("title", "link", "country", "type", "sector", "deadline"), [("Chef de projet", "https://expertise-france.gestmax.fr/12/1/chef", "Bénin", "Recrutement", "Santé", D(2026, 9, 20))],
    ),
    "HTML:plan-international.org": (
        """<h3 class="wp-block-heading">Audit services</h3><p>Deadline: 25 September 2026</p><a href="https://plan-international.org/uploads/2026/tor.pdf">ToR</a><h3 class="wp-block-heading"></h3><p>none</p>""",
        ("title", "deadline", "pdf"), [("Audit services", D(2026, 9, 25), "https://plan-international.org/uploads/2026/tor.pdf")],
    ),
    "HTML:ungm.org": (
        """<div role="row" class="tableRow" data-noticeid="901"><div role="cell" class="tableCell resultTitle"><span class="ungm-title ungm-title--small">Laptops</span></div><div role="cell" class="tableCell resultInfo1 deadline">30-Sep-2026 17:00</div>
        <div role="cell" class="tableCell">15-Aug-2026</div><div role="cell" class="tableCell resultAgency">UNDP</div><div role="cell" class="tableCell">Request for quotation</div><div role="cell" class="tableCell">REF1</div><div role="cell" class="tableCell">Benin</div></div>
        <div role="row" data-noticeid="902"><div role="cell" class="tableCell">no title</div></div>""",
        ("title", "link", "published", "deadline", "organisation", "type", "country"), [("Laptops", "https://www.ungm.org/Public/Notice/901", D(2026, 8, 15), D(2026, 9, 30), "UNDP", "Request for quotation", "Benin")],
    ),
    "HTML:jobrelais.com": (
        """<h3 class="text line-clamp-2"><a href="https://jobrelais.com/opportunities/call-for-tenders/a">Forage</a></h3><h3 class="line-clamp-2"><a href="https://jobrelais.com/opportunities/call-for-tenders/a">Forage bis</a></h3>
        <h3 class="line-clamp-2"><a href="https://jobrelais.com/jobs/b">Job</a></h3>""",
        ("title", "link"), [("Forage", "https://jobrelais.com/opportunities/call-for-tenders/a")],
    ),
    "HTML:coraf.org": (
        """<div class="card-opportinute"><p class="title">Recrutement d'un cabinet</p><p class="map-opportinute">Dakar</p><span class="date-ajout-opportinute"> 14/09/2026</span><a href="https://www.coraf.org/passation-marche/ami/1">x</a></div>
        <div class="card-opportinute"><p class="title">Plan de passation des marchés</p><a href="https://www.coraf.org/passation-marche/plan/2">x</a></div>""",
        ("title", "summary", "deadline", "type"), [("Recrutement d'un cabinet", "Dakar", D(2026, 9, 14), "AMI")],
    ),
}


def test_all_page_readers_have_a_case(readers):
    assert set(CASES) == set(readers)


@pytest.mark.parametrize("name", CASES)
def test_page_reader(spark, readers, name):
    body, fields, want = CASES[name]
    assert only(read(spark, readers[name], body), *fields) == want
    assert read(spark, readers[name], "") == [] and read(spark, readers[name], "<html><body>nothing here</body></html>") == []


def test_jobrelais_detail(spark):
    posting = json.dumps({"@type": "JobPosting", "validThrough": "2026-10-04T00:00", "datePosted": "2026-08-02", "description": "<p>Forage  de puits</p>"})
    body = f'<script type="application/ld+json">{{"@type": "Organization"}}</script><script type="application/ld+json">{posting}</script>'
    got = spark.createDataFrame([(body,), ("<html/>",)], "b string").select(pages.jobrelais_detail(F.col("b")).alias("d")).collect()
    assert tuple(got[0]["d"]) == (D(2026, 10, 4), D(2026, 8, 2), "Forage de puits") and tuple(got[1]["d"]) == (None, None, None)


def test_one_scan_reads_pages_of_several_methods(spark, readers):
    rows = [("s1", "rss", "<rss><item><title>A</title><link>https://a.org/1</link></item></rss>"), ("s2", " html:afd.fr ", CASES["HTML:afd.fr"][0]), ("s3", "MANUAL", "x"), ("s4", "RSS", None)]
    held = spark.createDataFrame(rows, "source_id string, method string, body string")
    got = read_entries(held, {"RSS": feeds.read_feed, "HTML:afd.fr": readers["HTML:afd.fr"]})
    assert sorted((r["source_id"], r["ord"], r["title"]) for r in got.collect()) == [("s1", 0, "A"), ("s2", 0, "Eau")]
