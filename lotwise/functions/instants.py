"""All valid readings of a written date and time.

A reading is (format, wall-clock seconds, offset seconds, zone name): the wall clock is counted as
if it were UTC; offset or zone name are set where the text states them, and a number counted from
the epoch has offset 0.
"""

from __future__ import annotations

import calendar
import re
import time
import unicodedata
from zoneinfo import available_timezones

# Month names of the languages the sources use, in calendar order.
_MONTHS = [
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "january february march april may june july august september october november december",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "gen feb mar apr mag giu lug ago set ott nov dic",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "jän feb mär apr mai jun jul aug sept okt nov dez",
]
# Zone abbreviations, in hours from UTC.
_ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3}


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_MONTH_OF = {_plain(name): i + 1 for line in _MONTHS for i, name in enumerate(line.split())}
_MONTH = "|".join(sorted(_MONTH_OF, key=len, reverse=True))

_REGIONS = available_timezones()
_OFFSET = re.compile(r"(?<=[\d\s])(?:GMT|UTC)?\s*([+-])(\d{1,2})(?::?(\d{2}))?$")
_NAMED = re.compile(r"(?<![a-z])(" + "|".join(sorted(_ABBREVIATIONS, key=len, reverse=True)) + r")$", re.I)
_REGION = re.compile(r"\(?\b([A-Z][A-Za-z]+/[A-Z][A-Za-z_]+)\)?$")
_FILL = re.compile(r"\b(?:ore|alle|at|um|uhr|a|à|h|le|il|den)\b(?!\s*\.?m\.?\b)|,", re.I)
_TIME = re.compile(r"(?:^|(?<=[\sT]))(\d{1,2})[:.h](\d{2})(?:[:.](\d{2}))?(?:[.,]\d+)?\s*(am|pm|a\.m\.|p\.m\.)?$", re.I)
_HOUR = re.compile(r"(?:^|(?<=[\sT]))(\d{1,2})\s*(am|pm|a\.m\.|p\.m\.|h)$", re.I)
_COMPACT = re.compile(r"(?:^|(?<=T))(\d{2})(\d{2})(\d{2})?$")
_EPOCH = re.compile(r"^\d{10}(\d{3})?(\d{3})?$")
_DAY_NAMED = re.compile(rf"^(\d{{1,2}})[.\s-]*(?:de\s+)?({_MONTH})\.?[\s-]*(?:de\s+)?(\d{{4}}|\d{{2}})$")
_MONTH_NAMED = re.compile(rf"^({_MONTH})\.?\s*(\d{{1,2}})\s*(\d{{4}})$")
_YEAR_FIRST = re.compile(r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$")
_YEAR_LAST = re.compile(r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$")
_DIGITS = re.compile(r"^(\d{8})$")
_STAMP = re.compile(r"^(\d{8})[T\s]?(\d{4}|\d{6})$")


def _days(y: int, m: int, d: int) -> int | None:
    if not (1 <= m <= 12 and 1900 <= y <= 2199 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    return calendar.timegm((y, m, d, 0, 0, 0)) // 86400


def _clock(h: int, m: int, s: int, half: str | None) -> int | None:
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half[0] in "pP" else 0)
    if h == 24 and m == s == 0:
        return 86400
    return h * 3600 + m * 60 + s if h < 24 and m < 60 and s < 60 else None


def split_zone(text: str) -> tuple[str, int | None, str | None]:
    """The text without the zone at its end, the zone's offset in seconds, or its region's name."""
    text = text.strip()
    if (found := _REGION.search(text)) and found.group(1) in _REGIONS:
        return text[: found.start()].strip(), None, found.group(1)
    if found := _NAMED.search(text):
        return text[: found.start()].strip(), _ABBREVIATIONS[found.group(1).upper()] * 3600, None
    if found := _OFFSET.search(text):
        before = text[: found.start()].strip()
        # in 2025-01-23 and 16-09-26 the end is no offset
        if re.search(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|:\d{2}|T\d{2}|\d\s*(?:GMT|UTC)?$", before) and not re.fullmatch(r"\d{1,4}(-\d{1,2})?", before):
            hours, minutes = int(found.group(2)), int(found.group(3) or 0)
            if hours <= 14 and minutes < 60:
                return before, (1 if found.group(1) == "+" else -1) * (hours * 3600 + minutes * 60), None
    return text, None, None


def times(text: str) -> list[tuple[str, int]]:
    """The readings of a time of day, in seconds of the day."""
    text = text.strip()
    out = []
    if found := _TIME.fullmatch(text):
        s = _clock(int(found.group(1)), int(found.group(2)), int(found.group(3) or 0), found.group(4))
        out.append(("hms", s))
    elif found := _HOUR.fullmatch(text):
        half = found.group(2)
        out.append(("hour", _clock(int(found.group(1)), 0, 0, None if half in "hH" else half)))
    elif found := _COMPACT.fullmatch(text):
        out.append(("compact", _clock(int(found.group(1)), int(found.group(2)), int(found.group(3) or 0), None)))
    return [(f, s) for f, s in out if s is not None]


def dates(text: str, day_first: bool | None = True) -> list[tuple[str, int]]:
    """The readings of a date, in days since 1970-01-01; all numeric orders if ``day_first`` is None."""
    text = text.strip().rstrip(".")
    low = _plain(text.lower())
    out: list[tuple[str, int | None]] = []
    if found := _YEAR_FIRST.fullmatch(text):
        out.append(("ymd", _days(int(found.group(1)), int(found.group(3)), int(found.group(4)))))
    elif found := _YEAR_LAST.fullmatch(text):
        a, b, y = int(found.group(1)), int(found.group(3)), int(found.group(4))
        year = 2000 + y if y < 100 else y
        if day_first in (True, None):
            out.append(("dmy" + found.group(2), _days(year, b, a)))
        if day_first in (False, None):
            out.append(("mdy" + found.group(2), _days(year, a, b)))
        if day_first is None and y < 100:
            out.append(("y2md" + found.group(2), _days(2000 + a, b, y)))
    elif found := _DIGITS.fullmatch(text):
        v = found.group(1)
        out.append(("ymd8", _days(int(v[:4]), int(v[4:6]), int(v[6:]))))
        other = _days(int(v[4:]), int(v[2:4]), int(v[:2]))
        if out[-1][1] is None:
            out.append(("dmy8", other))
        elif day_first is None:
            out.append(("alt-dmy8", other))
    elif found := _DAY_NAMED.fullmatch(low):
        y = int(found.group(3))
        out.append(("d-name-y", _days(2000 + y if y < 100 else y, _MONTH_OF[found.group(2)], int(found.group(1)))))
    elif found := _MONTH_NAMED.fullmatch(low):
        out.append(("name-d-y", _days(int(found.group(3)), _MONTH_OF[found.group(1)], int(found.group(2)))))
    return list(dict.fromkeys((f, d) for f, d in out if d is not None))


def _cut_time(text: str) -> tuple[str, list[tuple[str, int]]]:
    """A text that ends with a time of day, as the rest and the time's readings."""
    for pattern in (_TIME, _HOUR):
        if found := pattern.search(text):
            rest = text[: found.start()].strip().rstrip("T").strip()
            # 12.10.2026 is no time behind a date
            if rest and (clock := times(found.group())) and re.search(r"\d", rest):
                return rest, clock
    return text, []


def _once(text: str) -> str:
    """A value repeated in one field is that value."""
    for sep in (", ", "; ", " / ", " | ", ",", ";"):
        parts = [p.strip() for p in text.split(sep)]
        if len(parts) > 1 and parts[0] and len(set(parts)) == 1:
            return parts[0]
    return text


def _tidy(text: str) -> str:
    text = _once(" ".join(text.split()))
    return " ".join(_FILL.sub(" ", text).split())


def readings(date: str, clock: str = "", day_first: bool | None = True) -> list[tuple[str, int, int | None, str | None]]:
    """All readings of a date field with, if given, a time field beside it.

    A zone stated in either field holds for both, one in the time before one in the date. Nothing
    for a date without a time of day, a time without a date, impossible dates and plain words.
    """
    text = _tidy(date or "")
    clock_text = _tidy(clock or "")
    if not text:
        return []
    if not clock_text and (found := _EPOCH.fullmatch(text)):
        n = int(text)
        scale = 1_000_000 if found.group(2) else 1_000 if found.group(1) else 1
        return [("epoch", n // scale, 0, None)] if n // scale < 7_258_118_400 else []
    text, offset, zone = split_zone(text)
    clock_text, clock_offset, clock_zone = split_zone(clock_text) if clock_text else ("", None, None)
    if clock_offset is not None or clock_zone:
        offset, zone = clock_offset, clock_zone
    clocks = times(clock_text) if clock_text else []
    if clock_text and not clocks:
        return []
    if found := _STAMP.fullmatch(text):
        days, own = dates(found.group(1), day_first), times(found.group(2))
    elif days := dates(text, day_first):
        own = []
    else:
        rest, own = _cut_time(text)
        days = dates(rest, day_first) if own else []
    clocks = clocks or own
    return [(f"{f} {g}", d * 86400 + s, offset, zone) for f, d in days for g, s in clocks]


def parts(text: str) -> list[str]:
    """The dates of a list of them, as of a notice with several lots; a date with a comma in it is one."""
    whole = _tidy(text or "")
    if not whole:
        return []
    return [whole] if day_of(whole) else [p.strip() for p in re.split(r"[;|]|,\s", text) if p.strip()]


def day_of(text: str) -> str | None:
    """The day yyyyMMdd that a written date names, with or without a time of day; None for junk."""
    found = readings(text, day_first=True)
    days = found[0][1] // 86400 if found else next((d for _, d in dates(split_zone(_tidy(text))[0])), None)
    if days is None:
        return None
    t = time.gmtime(days * 86400)
    return f"{t.tm_year:04d}{t.tm_mon:02d}{t.tm_mday:02d}"
