"""JSON APIs: a declared schema for each, so that only the fields that are used are parsed. Bad JSON gives no entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.classify import type_by_title
from tidemark.functions.dates import iso_prefix
from tidemark.functions.money import budget_range, budget_single, format_amount
from tidemark.functions.text import collapse, joined, labelled, or_null, repair, strip_tags, text, trimmed
from tidemark.functions.urls import clean_link, domain_of, encode_path
from tidemark.sources.entries import Reader, each, entry


def _rows(body: Column, schema: str, path: str) -> Column:
    """The array at a path of the body, empty if there is none."""
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    for part in filter(None, path.split(".")):
        parsed = parsed[part]
    return F.coalesce(parsed, F.from_json(F.lit("[]"), _inner(schema, path)))


def _inner(schema: str, path: str) -> str:
    for _ in filter(None, path.split(".")):
        schema = schema.split(":", 1)[1].rsplit(">", 1)[0] if schema.startswith("struct<") else schema
    return schema


def _plain(c: Column) -> Column:
    return trimmed(text(c))


def _clean(c: Column) -> Column:
    return strip_tags(repair(text(c)))


def world_bank(body: Column) -> Column:
    """Procurement notices; contract awards are no calls."""
    fields = "id,notice_type,bid_description,project_name,project_id,contact_organization,bid_reference_no,procurement_method_name,noticedate,submission_deadline_date"
    schema = f"struct<procnotices:array<struct<{','.join(f'{f}:string' for f in fields.split(','))}>>>"

    def one(a: Column) -> Column:
        kind = _plain(a["notice_type"])
        said = joined(labelled("Type : ", kind), labelled("Projet : ", _clean(a["project_name"])), labelled("Identifiant projet : ", _plain(a["project_id"])), labelled("Mode de passation : ", _plain(a["procurement_method_name"])), labelled("Reference : ", _plain(a["bid_reference_no"])))
        return entry(
            title=F.when(kind.rlike("(?i)contract award"), "").otherwise(_clean(a["bid_description"])), link=labelled("https://projects.worldbank.org/en/projects-operations/procurement-detail/", _plain(a["id"])), published=iso_prefix(a["noticedate"]),
            summary=said, deadline=iso_prefix(a["submission_deadline_date"]), organisation=or_null(_clean(a["contact_organization"])), type=or_null(kind),
        )

    return each(_rows(body, schema, "procnotices"), one)


# An aggregator's codes of funding types.
FUNDING = {"grant": "Subvention", "bourse": "Bourse", "aap": "Appel a projets", "ami": "AMI", "formation": "Formation", "fellowship": "Bourse", "investment": "Investissement"}


def fundpilote(body: Column) -> Column:
    """An aggregator's list; each entry's page says who publishes, so the source stays open."""
    fields = "id,title,application_url,source_url,amount_min,amount_max,currency,description,eligibility,funding_type,deadline,sponsor_name"
    schema = f"struct<results:array<struct<{','.join(f'{f}:string' for f in fields.split(','))},eligible_countries:array<string>>>>"
    types = F.create_map(*(F.lit(x) for pair in FUNDING.items() for x in pair))

    def one(a: Column) -> Column:
        places = F.array_join(F.slice(F.filter(F.transform(F.coalesce(a["eligible_countries"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda c: c != ""), 1, 12), ", ")
        said = joined(F.substring(_plain(a["description"]), 1, 200), labelled("Eligibilite : ", F.substring(_plain(a["eligibility"]), 1, 120)), labelled("Pays eligibles : ", places))
        kind = _plain(a["funding_type"])
        return entry(
            title=F.when(_plain(a["id"]).isin("", "0", "false"), "").otherwise(_plain(a["title"])), link=clean_link(F.coalesce(or_null(_plain(a["application_url"])), _plain(a["source_url"]))),
            detail_url=F.concat(F.lit("https://fundpilote.com/api/v1/opportunities/"), _plain(a["id"]), F.lit("/")), source="", summary=F.substring(said, 1, 500), deadline=iso_prefix(a["deadline"]),
            organisation=or_null(_plain(a["sponsor_name"])), type=or_null(F.coalesce(F.try_element_at(types, kind), kind)), budget=or_null(budget_range(a["amount_min"], a["amount_max"], a["currency"])),
        )

    return each(_rows(body, schema, "results"), one)


def fundpilote_detail(body: Column) -> Column:
    """struct<link, source, summary> of an aggregator's page, nulls where it says nothing."""
    d = F.from_json(body, "struct<application_url:string,source_url:string,description:string,how_to_apply:string>")
    link = clean_link(F.coalesce(or_null(_plain(d["application_url"])), _plain(d["source_url"])))
    said = joined(F.substring(_plain(d["description"]), 1, 300), labelled("Candidature : ", F.substring(_plain(d["how_to_apply"]), 1, 150)))
    return F.struct(or_null(link).alias("link"), or_null(domain_of(link)).alias("source"), or_null(F.substring(said, 1, 500)).alias("summary"))


_EUROPA = ("identifier", "language", "title", "frameworkProgramme", "programmePeriod", "description", "startDate", "deadlineDate", "closingDate", "type", "budget")


def one_per_language(rows: Column, name, language) -> Column:
    """One row for each identifier, where its first stood: the last French one, else the first. Rows without identifier stay."""
    names = F.transform(rows, name)

    def chosen(x: Column, i: Column) -> Column:
        mine = name(x)
        french = F.filter(rows, lambda y: (name(y) == mine) & (F.lower(language(y)) == "fr"))
        return F.when(mine == "", x).when(F.array_position(names, mine) != i + 1, F.lit(None)).otherwise(F.coalesce(F.get(french, F.size(french) - 1), x))

    return F.filter(F.transform(rows, chosen), lambda x: x.isNotNull())


def europa(body: Column) -> Column:
    """Calls of the European portal, in one language each; fields come as arrays of which the first counts."""
    inner = ",".join(f"{f}:array<string>" for f in _EUROPA)
    schema = f"struct<results:array<struct<metadata:struct<{inner}>,url:string>>>"
    at = lambda x, f: _plain(F.get(x["metadata"][f], F.lit(0)))
    rows = one_per_language(_rows(body, schema, "results"), lambda x: at(x, "identifier"), lambda x: at(x, "language"))

    def one(x: Column) -> Column:
        name = at(x, "identifier")
        page = F.concat(F.lit("https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/topic-details/"), F.url_encode(name))
        link = clean_link(F.coalesce(or_null(_plain(x["url"])), F.when(name != "", page), F.lit("")))
        said = joined(labelled("Reference : ", name), labelled("Programme : ", F.coalesce(or_null(at(x, "frameworkProgramme")), at(x, "programmePeriod"))), _clean(at(x, "description")))
        return entry(
            title=F.when(link == "", "").otherwise(_clean(at(x, "title"))), link=link, published=iso_prefix(at(x, "startDate")), summary=F.substring(said, 1, 500), organisation="Commission europeenne",
            deadline=iso_prefix(F.coalesce(or_null(at(x, "deadlineDate")), at(x, "closingDate"))), type=F.when(at(x, "type") == "2", "Appel a projets"), budget=or_null(budget_single(at(x, "budget"), F.lit("EUR"))),
        )

    return each(rows, one)


def grants_gov(body: Column) -> Column:
    """Federal grants; days are written month first."""
    schema = "struct<data:struct<oppHits:array<struct<id:string,number:string,title:string,openDate:string,closeDate:string,agencyCode:string>>>>"

    def day(c: Column) -> Column:
        found = r"^(\d{2})/(\d{2})/(\d{4})$"
        part = lambda n: F.regexp_extract(_plain(c), found, n)
        return F.when(_plain(c).rlike(found), F.concat_ws("-", part(3), part(1), part(2))).otherwise(iso_prefix(c))

    def one(o: Column) -> Column:
        number, agency = _plain(o["number"]), _plain(o["agencyCode"])
        return entry(
            title=F.when(number == "", "").otherwise(_clean(o["title"])), link=F.concat(F.lit("https://www.grants.gov/search-results-detail/"), F.url_encode(text(o["id"]))), published=day(o["openDate"]), deadline=day(o["closeDate"]), type="Subvention",
            summary=joined(labelled("Reference : ", number), labelled("Agence : ", agency), F.lit("Eligibilite a verifier sur l avis officiel")), organisation=F.coalesce(or_null(agency), F.lit("Gouvernement des Etats-Unis")),
        )

    return each(_rows(body, schema, "data.oppHits"), one)


def niger_marches(body: Column) -> Column:
    """A site's posts with fields of their own; the body is an array."""
    schema = "array<struct<link:string,date:string,title:struct<rendered:string>,acf:struct<date_expiration:string,nom_de_la_societe:string>>>"

    def one(a: Column) -> Column:
        title, buyer = _clean(a["title"]["rendered"]), _clean(a["acf"]["nom_de_la_societe"])
        return entry(title=title, link=clean_link(text(a["link"])), published=iso_prefix(a["date"]), summary=labelled("Acheteur : ", buyer), deadline=iso_prefix(a["acf"]["date_expiration"]), organisation=or_null(buyer), type=type_by_title(title))

    return each(_rows(body, schema, ""), one)


# Units that don't name their country.
UNIT_COUNTRIES = {"Nairobi": "Kenya", "USA": "International"}


def oracle_negotiations(body: Column) -> Column:
    """Negotiations that are neither cancelled nor awarded; the unit's suffix names the country."""
    schema = "struct<items:array<struct<NegotiationTitle:string,Negotiation:string,NegotiationType:string,NegotiationStatus:string,CloseDate:string,PostingDate:string,ProcurementBUId:string,ProcurementBUName:string,Synopsis:string,links:array<struct<href:string>>>>>"

    def one(a: Column) -> Column:
        unit = _plain(a["ProcurementBUName"])
        suffix = F.when(unit.contains("-"), F.trim(F.substring(unit, F.locate("-", unit) + 1, F.length(unit)))).otherwise("")
        country = F.create_map(*(F.lit(x) for pair in UNIT_COUNTRIES.items() for x in pair))
        host = F.regexp_extract(text(F.get(a["links"], F.lit(0))["href"]), r"^https?://[^/:]+", 0)
        over = F.lower(_plain(a["NegotiationStatus"])).isin("canceled", "cancelled", "awarded")
        return entry(
            title=F.when(over, "").otherwise(_plain(a["NegotiationTitle"])), link=F.concat(host, F.lit("/fscmUI/redwood/negotiation-abstracts/view/abstractlisting?prcBuId="), text(a["ProcurementBUId"])), organisation=or_null(unit),
            country=F.coalesce(F.try_element_at(country, suffix), or_null(suffix)), type=or_null(_plain(a["NegotiationType"])), deadline=iso_prefix(a["CloseDate"]), published=iso_prefix(a["PostingDate"]), summary=joined(_plain(a["Negotiation"]), _plain(a["Synopsis"])),
        )

    return each(_rows(body, schema, "items"), one)


def dncmp(body: Column) -> Column:
    """A national portal's calls that aren't over."""
    schema = "struct<content:array<struct<expired:boolean,dosDescriptif:string,dosReference:string,dosNombreLots:string,dosFichier:string,dosDateLimiteDepot:string,dosDatePublication:string,autoriteContractante:struct<denomination:string>,appelsoffres:struct<apoObjet:string,apoReference:string,typemarche:struct<libelle:string>>>>>"

    def one(e: Column) -> Column:
        ao, lots = e["appelsoffres"], e["dosNombreLots"].try_cast("double")
        buyer = F.trim(F.regexp_replace(repair(text(e["autoriteContractante"]["denomination"])), r"\s*\n\s*", " "))
        return entry(
            title=F.when(F.coalesce(e["expired"], F.lit(False)), "").otherwise(_clean(F.coalesce(ao["apoObjet"], e["dosDescriptif"]))), link="https://www.marches-publics.bj/appels-doffres", pdf=or_null(encode_path(e["dosFichier"])), organisation=or_null(buyer),
            type=or_null(_plain(ao["typemarche"]["libelle"])), deadline=iso_prefix(e["dosDateLimiteDepot"]), published=iso_prefix(e["dosDatePublication"]),
            summary=joined(_plain(F.coalesce(e["dosReference"], ao["apoReference"])), F.when(lots > 1, F.concat(lots.cast("long").cast("string"), F.lit(" lots")))),
        )

    return each(_rows(body, schema, "content"), one)


def plan_lines(body: Column, authority: Column, as_of: Column) -> Column:
    """Lines of an authority's procurement plan that are in use, still ahead, and have a reference and an object."""
    schema = "struct<content:array<struct<utilisable:int,datelancement:string,datedemarrage:string,libelle:string,reference:string,montantEstime:string,modepassation_ID:struct<description:string,code:string>,typeMarche:struct<libelle:string>,typesBailleurs:struct<libelle:string>,plan:struct<annee:string>>>>"

    def one(l: Column) -> Column:  # noqa: E741
        day = lambda c: F.call_function("try_to_date", iso_prefix(c), F.lit("yyyy-MM-dd"))
        return F.struct(
            _plain(l["reference"]).alias("reference"), F.trim(F.regexp_replace(repair(text(authority)), r"\s*\n\s*", " ")).alias("authority"), collapse(_clean(l["libelle"])).alias("object"), _plain(l["typeMarche"]["libelle"]).alias("type"),
            _plain(F.coalesce(l["modepassation_ID"]["description"], l["modepassation_ID"]["code"])).alias("mode"), format_amount(l["montantEstime"]).alias("amount"), day(l["datelancement"]).alias("launch"), day(l["datedemarrage"]).alias("start"),
            _plain(l["typesBailleurs"]["libelle"]).alias("funder"), text(l["plan"]["annee"]).alias("year"), F.coalesce(l["utilisable"] != 0, F.lit(True)).alias("used"),
        )

    made = F.transform(_rows(body, schema, "content"), one)
    return F.filter(made, lambda r: r["used"] & F.coalesce(r["launch"] >= as_of, F.lit(False)) & (r["object"] != "") & (r["reference"] != ""))


READERS: dict[str, Reader] = {
    "JSON:worldbank.org": world_bank,
    "JSON:fundpilote.com": fundpilote,
    "JSON:ec.europa.eu": europa,
    "JSON:grants.gov": grants_gov,
    "JSON:nigermarches.com": niger_marches,
    "JSON:oraclecloud.com": oracle_negotiations,
    "JSON:marches-publics.bj": dncmp,
}
