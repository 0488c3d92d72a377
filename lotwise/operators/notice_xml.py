"""Notice documents shredded into content and dossier, one row a notice; failures are rows too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.markup import MarkupError, Node, clean, events, tree

# Roles of links.
TENDER_DOCUMENTS, SUBMISSION, BUYER_PROFILE = "tender-documents", "submission-endpoint", "buyer-profile"
BUYER_WEBSITE, APPEAL_BODY, OTHER = "buyer-website", "appeal-body", "other"
LEAST_TEXT = 4

_CRITERION = "struct<type:string,name:string,description:string,weight:string,lang:string>"
CONTENT = f"criteria array<{_CRITERION}>, descriptions array<string>, strategic array<string>, document_urls array<string>, language string, texts array<struct<element:string,text:string,lang:string>>, failure string"
DOSSIER = (
    "internal_id string, procedure_type string, deadline_date string, deadline_time string, "
    "organizations array<struct<id:string,name:string,company_id:string,roles:array<string>,email:string,phone:string,website:string,city:string,country:string>>, "
    f"lots array<struct<id:string,title:string,value:string,currency:string,cpv:array<string>,deadline_date:string,deadline_time:string,documents_url:string,submission_url:string,criteria:array<{_CRITERION}>>>, "
    "links array<struct<url:string,role:string,note:string>>, failure string"
)


def _lang(text: str | None) -> str:
    return (text or "").strip().upper()


def _unique(rows: list[dict]) -> list[dict]:
    return list({tuple(r.values()): r for r in reversed(rows)}.values())[::-1]


def content(xml: str) -> dict:
    """Criteria, descriptions, strategic goals, addresses, language and all longer texts of a notice."""
    out: dict = {"criteria": [], "descriptions": [], "strategic": [], "document_urls": [], "language": "", "texts": []}
    depth = 0  # of criteria around the current place
    criterion: dict | None = None
    element: tuple[str, dict] | None = None
    listed = ""
    for kind, name, value in events(xml):
        if kind == "open":
            element = (name, value)
            if name == "SubordinateAwardingCriterion":
                depth += 1
                if depth == 1:
                    criterion, listed = {"type": "", "name": "", "description": "", "weight": "", "lang": ""}, ""
        elif kind == "close":
            element = None
            if name == "SubordinateAwardingCriterion":
                depth -= 1
                if depth == 0 and criterion is not None:
                    if f"{criterion['name']} {criterion['description']}".strip():
                        out["criteria"].append(criterion)
                    criterion = None
        elif element is not None and (text := clean(value)):
            tag, attributes = element
            lang = _lang(attributes.get("languageID"))
            if tag == "NoticeLanguageCode":
                out["language"] = _lang(text)
            elif tag in ("Name", "Description") and criterion is not None:
                part = tag.lower()
                criterion[part] = f"{criterion[part]} {text}".strip()
                criterion["lang"] = criterion["lang"] or lang
            elif tag == "Description":
                out["descriptions"].append(text)
            elif tag == "AwardingCriterionTypeCode" and criterion is not None:
                criterion["type"] = text
            elif tag == "ParameterCode":
                listed = attributes.get("listName", "")
            elif tag == "ParameterNumeric" and criterion is not None and listed == "number-weight":
                criterion["weight"] = text
            elif tag == "ProcurementTypeCode" and attributes.get("listName") == "strategic-procurement":
                out["strategic"].append(text)
            elif tag in ("URI", "EndpointID", "WebsiteURI") and text.startswith("http"):
                out["document_urls"].append(text)
            if len(text) >= LEAST_TEXT:
                out["texts"].append({"element": tag, "text": text, "lang": lang})
    for row in [*out["criteria"], *out["texts"]]:
        row["lang"] = row["lang"] or out["language"]
    out["criteria"] = _unique(out["criteria"])
    for name in ("descriptions", "strategic", "document_urls"):
        out[name] = list(dict.fromkeys(out[name]))
    return out


_EXTENSION = ("UBLExtensions", "UBLExtension", "ExtensionContent", "EformsExtension")


def _criteria(terms: list[Node]) -> list[dict]:
    rows = []
    for node in [n for t in terms for n in t.all("AwardingTerms", "AwardingCriterion", "SubordinateAwardingCriterion")]:
        weights = [p.last("ParameterNumeric") for p in node.all(*_EXTENSION, "AwardCriterionParameter") if any(c.attributes.get("listName") == "number-weight" for c in p.all("ParameterCode")[-1:])]
        row = {"type": node.last("AwardingCriterionTypeCode"), "name": node.last("Name"), "description": node.last("Description"), "weight": weights[0] if weights else "", "lang": ""}
        if row["name"] or row["description"]:
            rows.append(row)
    return _unique(rows)


def _human(reference: str) -> bool:
    """Whether a reference was made up by people: short, and no generated identifier."""
    return bool(reference) and len(reference.encode()) <= 40 and not (len(reference) == 36 and reference.count("-") == 4)


def human_reference(reference: Column) -> Column:
    """:func:`_human` of a column, natively."""
    generated = (F.length(reference) == 36) & (F.length(reference) - F.length(F.replace(reference, F.lit("-"), F.lit(""))) == 4)
    return F.coalesce((reference != "") & (F.octet_length(reference) <= 40) & ~generated, F.lit(False))


def _deadline(node: Node) -> tuple[str, str]:
    period = ("TenderingProcess", "TenderSubmissionDeadlinePeriod")
    return node.last(*period, "EndDate")[:10], node.last(*period, "EndTime")[:5]


def dossier(xml: str) -> dict:
    """Organisations with roles, lots with criteria, and links told apart by what they lead to."""
    root = tree(xml)
    lots_found = root.all("ProcurementProjectLot")
    terms = [root.all("TenderingTerms"), *[lot.all("TenderingTerms") for lot in lots_found]]
    roles: dict[str, list[str]] = {}

    def give(ref: str, role: str) -> None:
        if ref and role not in roles.setdefault(ref, []):
            roles[ref].append(role)

    give(root.last("ContractingParty", "Party", "PartyIdentification", "ID"), "buyer")
    for group in terms:
        for t in group:
            for party, role in (("AppealReceiverParty", "appeal-body"), ("AppealInformationParty", "appeal-information"), ("MediationParty", "mediation")):
                give(t.last("AppealTerms", party, "PartyIdentification", "ID"), role)
    organizations = []
    for node in root.all(*_EXTENSION, "Organizations", "Organization"):
        at = ("Company",)
        one = {
            "id": node.last(*at, "PartyIdentification", "ID"),
            "name": node.last(*at, "PartyName", "Name"),
            "company_id": node.last(*at, "PartyLegalEntity", "CompanyID"),
            "roles": [],
            "email": node.last(*at, "Contact", "ElectronicMail"),
            "phone": node.last(*at, "Contact", "Telephone"),
            "website": node.last(*at, "WebsiteURI"),
            "city": node.last(*at, "PostalAddress", "CityName"),
            "country": node.last(*at, "PostalAddress", "Country", "IdentificationCode"),
        }
        if one["id"] or one["name"]:
            organizations.append(one)
    for ref, one in {o["id"]: o for o in organizations}.items():  # of equal ids, the last
        one["roles"] = roles.get(ref, [])

    references, lots = [], []
    for node in lots_found:
        project = node.all("ProcurementProject")
        amount = [a for p in project for a in p.all("RequestedTenderTotal", "EstimatedOverallContractAmount")]
        one_terms = node.all("TenderingTerms")
        date, time = _deadline(node)
        document = [d for t in one_terms for d in t.all("CallForTendersDocumentReference")]
        references += [d.last("ID") for d in document[-1:]]
        codes = [c.last("ItemClassificationCode") for kind in ("MainCommodityClassification", "AdditionalCommodityClassification") for p in project for c in p.all(kind)]
        lots.append(
            {
                "id": node.last("ID"),
                "title": node.last("ProcurementProject", "Name"),
                "value": clean(amount[-1].text) if amount else "",
                "currency": amount[-1].attributes.get("currencyID", "") if amount else "",
                "cpv": list(dict.fromkeys(c for c in codes if c)),
                "deadline_date": date,
                "deadline_time": time,
                "documents_url": node.last("TenderingTerms", "CallForTendersDocumentReference", "Attachment", "ExternalReference", "URI"),
                "submission_url": node.last("TenderingTerms", "TenderRecipientParty", "EndpointID"),
                "criteria": _criteria(one_terms),
            }
        )
    date, time = _deadline(root)
    if not date:
        date, time = next(((x["deadline_date"], x["deadline_time"]) for x in lots if x["deadline_date"]), ("", ""))

    links: dict[str, dict] = {}

    def add(url: str, role: str, note: str) -> None:
        if url.startswith("http"):
            links.setdefault(url, {"url": url, "role": role, "note": note})

    for group in terms:
        for t in group:
            add(t.last("CallForTendersDocumentReference", "Attachment", "ExternalReference", "URI"), TENDER_DOCUMENTS, "where the notice says the documents are")
            add(t.last("TenderRecipientParty", "EndpointID"), SUBMISSION, "where offers go")
    add(root.last("ContractingParty", "BuyerProfileURI"), BUYER_PROFILE, "the buyer's portal")
    for o in organizations:
        role = BUYER_WEBSITE if "buyer" in o["roles"] else APPEAL_BODY if APPEAL_BODY in o["roles"] else OTHER
        add(o["website"], role, o["name"])
    named = [r for r in references if _human(r)]
    return {
        "internal_id": named[-1] if named else root.last("ContractFolderID"),
        "procedure_type": root.last("TenderingProcess", "ProcedureCode"),
        "deadline_date": date,
        "deadline_time": time,
        "organizations": organizations,
        "lots": lots,
        "links": list(links.values()),
    }


def best_documents_link(links: list[dict]) -> str | None:
    for role in (TENDER_DOCUMENTS, SUBMISSION, BUYER_PROFILE):
        for link in links:
            if link["role"] == role:
                return link["url"]
    return None


def shred(notices: DataFrame, key: str, xml: str, what: str = "content") -> DataFrame:
    """``key`` with the columns of ``CONTENT`` or ``DOSSIER``; unreadable documents have a ``failure``.

    Null and empty documents fail like unreadable ones. Extra columns are not carried.
    """
    parse, schema = (content, CONTENT) if what == "content" else (dossier, DOSSIER)
    names = [part.split()[0] for part in schema.replace(">>", ">").split(", ") if " " in part]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for k, text in zip(frame["key"], frame["xml"], strict=True):
                try:
                    body = text.decode("utf-8", "replace") if isinstance(text, bytes | bytearray) else text
                    if not body or not body.strip():
                        raise MarkupError("the document is empty")
                    rows.append({"key": k, **parse(body), "failure": None})
                except MarkupError as e:
                    rows.append({"key": k, "failure": str(e)})
            yield pd.DataFrame(rows, columns=["key", *names]).astype(object).where(lambda x: x.notna(), None)

    kind = dict(notices.dtypes)[key]
    out = notices.select(F.col(key).alias("key"), F.col(xml).alias("xml")).mapInPandas(run, f"key {kind}, {schema}")
    return out.withColumnRenamed("key", key)
