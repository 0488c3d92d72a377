"""Fields of a notice whose values are text, lists, or texts by language."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages in order of preference; a key that is there wins even if its value is empty.
PREFERRED = ("ENG", "eng", "en", "MUL", "mul", "MULTI")


def pick(value: dict):
    """The preferred language's value, else that of the first key by name."""
    key = next((k for k in PREFERRED if k in value), None)
    return value[key if key is not None else min(value)] if value else None


def flatten(value) -> list[str]:
    """Any value as texts: nothing and "" as none, numbers at their shortest, lists one after another."""
    if value is None or value == "":
        return []
    if isinstance(value, bool):
        return ["true" if value else "false"]
    if isinstance(value, int | float):
        return [str(int(value)) if float(value).is_integer() else repr(value)]
    if isinstance(value, list):
        return [t for v in value for t in flatten(v)]
    if isinstance(value, dict):
        return flatten(pick(value))
    return [str(value)]


def link(links: dict | None, form: str, lang: str) -> str:
    """The address of a form in a language, else in a preferred one, else in the first by name; no empty ones."""
    by = (links or {}).get(form) or {}
    if not isinstance(by, dict):
        return (flatten(by) or [""])[0]
    for key in (lang, *PREFERRED, *sorted(by)):
        found = flatten(by.get(key))
        if found and found[0].strip():
            return found[0]
    return ""


def pick_variant(texts: Column) -> Column:
    """:func:`pick` of a map column, natively."""
    out = F.get(F.map_values(F.map_filter(texts, lambda k, v: k == F.array_min(F.map_keys(texts)))), F.lit(0))
    for key in reversed(PREFERRED):
        out = F.when(F.map_contains_key(texts, key), F.element_at(texts, key)).otherwise(out)
    return out


_FIELDS = {
    "publication_number": "publication-number", "title": "notice-title", "notice_type": "notice-type", "buyer_name": "buyer-name",
    "buyer_country": "buyer-country", "publication_date": "publication-date", "deadline": "deadline-receipt-tender-date-lot",
    "total_value": "total-value", "winner_name": "winner-name",
}
_LISTS = {"cpv": "classification-cpv", "place_of_performance": "place-of-performance"}
SUMMARY = ", ".join(f"{c} string" for c in _FIELDS) + ", cpv array<string>, place_of_performance array<string>, xml_url string, pdf_url string, html_url string, failure string"
#: The part of an answer shown where it explains nothing, and the longest answer that is read, in characters.
SHOWN, LONGEST = 500, 32 << 20


def summary(notice: dict, base: str = "https://journal.example/en/notice/-/detail/") -> dict:
    out: dict = {c: ", ".join(flatten(notice.get(f))) or None for c, f in _FIELDS.items()}
    out["publication_date"] = (out["publication_date"] or "")[:10] or None
    out |= {c: list(dict.fromkeys(flatten(notice.get(f)))) for c, f in _LISTS.items()}
    links = notice.get("links")
    for column, form, lang in (("xml_url", "xml", "MUL"), ("pdf_url", "pdf", "ENG"), ("html_url", "html", "ENG")):
        out[column] = link(links, form, lang) or None
    if not out["html_url"] and out["publication_number"]:
        out["html_url"] = base + out["publication_number"]
    return out


def remote_error(text: str | None) -> str:
    """What an answer that is no result says: its message and detail, else its beginning."""
    try:
        found = json.loads(text or "")
    except ValueError:
        found = None
    if isinstance(found, dict):
        said = [str(found[k]).strip() for k in ("message", "detail") if str(found.get(k) or "").strip()]
        if said:
            return ": ".join(said)
    return (text or "").strip()[:SHOWN] or "the answer is empty"


def _read(text: str | None) -> tuple[list[dict], str | None]:
    """The notices of an answer, or why there are none to be had."""
    if text is not None and len(text) > LONGEST:
        return [], "the answer is too long"
    try:
        found = json.loads(text or "")
    except ValueError:
        return [], remote_error(text)
    if isinstance(found, dict) and "notices" not in found and ("message" in found or not found.keys() & {*_FIELDS.values(), *_LISTS.values()}):
        return [], remote_error(text)
    notices = found.get("notices", [found]) if isinstance(found, dict) else found
    return ([n for n in notices or [] if isinstance(n, dict)], None) if isinstance(notices, list | None) else ([], remote_error(text))


def summaries(responses: DataFrame, body: str = "body", code: str | None = None) -> DataFrame:
    """One row for each notice of captured search responses, and one with a ``failure`` for each that has none to give.

    A response fails if it is null, empty, too long or no JSON, if it says what went wrong in place of
    notices, or if its ``code``, where that column is named, isn't 200. An answer of no notices is no failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows: list[dict] = []
            for text, answer in zip(frame["body"], frame["code"], strict=True):
                notices, failure = _read(text) if answer == 200 else ([], remote_error(text))
                rows += [{**summary(n), "failure": None} for n in notices]
                rows += [{"failure": failure}] if failure else []
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")]).astype(object).where(lambda x: x.notna(), None)

    answered = F.coalesce(F.col(code).cast("int"), F.lit(0)) if code else F.lit(200)
    return responses.select(F.col(body).alias("body"), answered.alias("code")).mapInPandas(run, SUMMARY)
