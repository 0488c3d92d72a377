"""Grammar for written quantities: numbers, magnitudes and unit expressions.

    quantity := [unit] number [unit] | number '/' number
    unit     := factor { ('/' | '*' | 'per') factor }
    factor   := [magnitude] name [exponent]

Every unit is a scale, an offset and a vector of integer exponents over the base dimensions, so
products and quotients add and subtract vectors and two quantities may be compared only if their
vectors are equal. A conversion is ``value * scale + offset`` into the base unit of the vector.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

#: Base dimensions, in the order of the exponent vectors. ``money`` is in the currency's own units.
DIMENSIONS = ("money", "length", "mass", "time", "temperature")
NONE = (0,) * len(DIMENSIONS)


def dim(**powers: int) -> tuple[int, ...]:
    return tuple(powers.get(d, 0) for d in DIMENSIONS)


@dataclass(frozen=True)
class Unit:
    scale: float = 1.0
    dims: tuple[int, ...] = NONE
    offset: float = 0.0
    currencies: tuple[str, ...] = ()  # more than one: a sign that several currencies share

    def times(self, other: Unit, sign: int = 1) -> Unit:
        if self == Unit() and sign == 1:
            return other  # alone, a unit keeps its zero
        return Unit(
            self.scale * other.scale**sign,
            tuple(a + sign * b for a, b in zip(self.dims, other.dims, strict=True)),
            0.0,  # within a product a degree is a difference, whatever its zero
            self.currencies or other.currencies,
        )

    def power(self, n: int) -> Unit:
        return replace(self, scale=self.scale**n, dims=tuple(n * d for d in self.dims), offset=self.offset if n == 1 else 0.0)


@dataclass(frozen=True)
class Quantity:
    value: float
    dims: tuple[int, ...]
    currencies: tuple[str, ...] = ()


def _currency(*codes: str) -> Unit:
    return Unit(dims=dim(money=1), currencies=codes)


# Currency names and signs as they are written, by ISO code.
_CURRENCY_NAMES = {
    ("EUR",): "eur euro euros €",
    ("PLN",): "pln zł zl złotych zloty złoty",
    ("SEK",): "sek",
    ("DKK",): "dkk",
    ("CZK",): "czk kč kc",
    ("HUF",): "huf ft",
    ("RON",): "ron lei leu",
    ("BGN",): "bgn лв",
    ("GBP",): "gbp £",
    ("ITL",): "itl lire lira",
    ("SEK", "DKK"): "kr kronor kroner krone krona",
}
# Magnitude words of the languages the sources use.
_MAGNITUDES = {
    1e3: "k t thousand tausend tsd migliaia mila milliers mille tys mii mie ezer tis tusen tusind хил",
    1e6: "m million millions mln mio mil milioni milione millió milioane miljoner miljon млн",
    1e9: "mrd mld miliardi billion milliards",
}
# Units of a share of a whole.
_SHARES = {
    1e-2: "% percent prozent pct p.c. per_cento per_cent pour_cent v.h.",
    1e-3: "‰ permille per_mille promille",
    1e-4: "bps bp basis_points basis_point",
}
# SI and common technical units.
_PHYSICAL = {
    "m": Unit(1.0, dim(length=1)),
    "ha": Unit(1e4, dim(length=2)),
    "l": Unit(1e-3, dim(length=3)),
    "g": Unit(1e-3, dim(mass=1)),
    "s": Unit(1.0, dim(time=1)),
    "min": Unit(60.0, dim(time=1)),
    "h": Unit(3600.0, dim(time=1)),
    "day": Unit(86400.0, dim(time=1)),
    "days": Unit(86400.0, dim(time=1)),
    "n": Unit(1.0, dim(mass=1, length=1, time=-2)),
    "j": Unit(1.0, dim(mass=1, length=2, time=-2)),
    "w": Unit(1.0, dim(mass=1, length=2, time=-3)),
    "wh": Unit(3600.0, dim(mass=1, length=2, time=-2)),
    "k": Unit(1.0, dim(temperature=1)),
    "°c": Unit(1.0, dim(temperature=1), 273.15),
    "°f": Unit(5 / 9, dim(temperature=1), 273.15 - 32 * 5 / 9),
}
# SI prefixes that mean one thing in lower case, and the units they go with.
_PREFIXES = {"k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "μ": 1e-6}
_PREFIXED = ("m", "g", "l", "s", "n", "j", "w", "wh")

_GROUP = "[., '’   ]"
_NUMBER = re.compile(rf"[+-]?\d+(?:{_GROUP}\d+)*(?:[eE][+-]?\d+)?(?![^\W\d_])|[+-]?\d+(?:{_GROUP}\d+)*")
_WORD = re.compile(r"[^\W\d_]+(?:['’.][^\W\d_]+)*\.?|[%‰€£$°/*·^]|²|³|\d+")


def parse_number(text: str, whole_groups: bool = True) -> float | None:
    """The number written in ``text``, whose decimal and grouping marks are not known beforehand.

    The last mark is decimal unless it recurs or, with ``whole_groups``, exactly three digits
    follow it; in exponent notation every single mark is decimal. Null if the groups are uneven.
    """
    mantissa, _, exponent = re.sub("[Ee]", "e", text.strip()).partition("e")
    parts = re.split(_GROUP, mantissa)
    marks = ["," if m == "," else "." if m == "." else "'" for m in re.findall(_GROUP, mantissa)]
    if not all(p.lstrip("+-").isdigit() for p in parts):
        return None
    decimal = ""
    if marks:
        last, tail = marks[-1], parts[-1]
        alone = marks.count(last) == 1
        grouped = whole_groups and len(tail) == 3 and not exponent
        if len(marks) == 1 and parts[0].lstrip("+-") == "0":
            grouped = False  # nothing groups thousands behind a zero
        if last != "'" and alone and not grouped:
            decimal = parts.pop()
            marks.pop()
        if any(len(p) != 3 for p in parts[1:]):
            return None
    try:
        return float("".join(parts) + (f".{decimal}" if decimal else "") + (f"e{exponent}" if exponent else ""))
    except ValueError:
        return None


@dataclass
class Grammar:
    """A parser over registered units. ``physical`` adds SI units to money and shares."""

    physical: bool = False
    units: dict[str, Unit] = field(default_factory=dict)
    magnitudes: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for codes, names in _CURRENCY_NAMES.items():
            self.units |= {n: _currency(*codes) for n in names.split()}
        for scale, names in _SHARES.items():
            self.units |= {n.replace("_", " "): Unit(scale) for n in names.split()}
        for scale, names in _MAGNITUDES.items():
            self.magnitudes |= {n: scale for n in names.split()}
        if self.physical:
            self.units |= _PHYSICAL

    def _name(self, word: str) -> Unit | None:
        """A unit, a magnitude, or a magnitude glued to a unit (kEUR, MSEK, T€)."""
        bare = word.strip().rstrip(".")
        for w in (word, bare):
            if w in self.units:
                return self.units[w]
        if bare in self.magnitudes:
            return Unit(self.magnitudes[bare])
        if len(bare) > 1 and bare[0] in "kmt" and bare[1:] in self.units:
            unit = self.units[bare[1:]]
            if unit.currencies:
                return replace(unit, scale=unit.scale * self.magnitudes[bare[0]])
        if self.physical and bare[:1] in _PREFIXES and bare[1:] in _PREFIXED:
            return replace(self.units[bare[1:]], scale=self.units[bare[1:]].scale * _PREFIXES[bare[0]])
        return None

    def unit(self, text: str) -> Unit | None:
        """The product of the factors in ``text``; None if a word is unknown."""
        text = unicodedata.normalize("NFC", text).lower().replace("d'", " ").replace("d’", " ")
        text = re.sub(r"\b(di|de|of|in|da)\b", " ", text)
        if whole := self._name(" ".join(text.split())):
            return whole
        total, sign, last = Unit(), 1, None
        words = _WORD.findall(text)
        i = 0
        while i < len(words):
            w = words[i]
            pair = f"{w} {words[i + 1]}" if i + 1 < len(words) else ""
            if pair in self.units:
                last = self.units[pair]
                total, sign, i = total.times(last, sign), 1, i + 2
                continue
            if w == "°" and i + 1 < len(words) and "°" + words[i + 1] in self.units:
                last = self.units["°" + words[i + 1]]
                total, i = total.times(last, sign), i + 2
                continue
            if w in ("/", "per"):
                sign = -1
            elif w in ("*", "·", "^"):
                pass
            elif (w in ("²", "³") or w.isdigit()) and last is not None:
                n = {"²": 2, "³": 3}.get(w) or int(w)
                total = total.times(last.power(n - 1), 1)
            else:
                last = self._name(w)
                if last is None:
                    return None
                total, sign = total.times(last, sign), 1
            i += 1
        return total

    def quantity(self, text: str, beside: str | None = None, whole_groups: bool = True) -> Quantity | None:
        """What ``text`` states, with a unit in it or in the field ``beside`` it.

        A magnitude written in both fields counts once; a currency in ``text`` goes before one in
        ``beside``, except that a sign several currencies share is settled by it.
        """
        text = text.strip()
        found = _NUMBER.search(text)
        if not found:
            return None
        value = parse_number(found.group(), whole_groups)
        if value is None:
            return None
        own = self.unit(text[: found.start()] + " " + text[found.end() :])
        other = self.unit(beside) if beside and beside.strip() else Unit()
        if own is None or other is None:
            return None
        unit = own
        if other != Unit():
            if own == Unit() or own.scale == 1.0:
                unit = replace(own, scale=other.scale, dims=other.dims if own.dims == NONE else own.dims)
            if not own.currencies:
                unit = replace(unit, currencies=other.currencies, dims=other.dims)
            elif len(own.currencies) > 1 and set(other.currencies) & set(own.currencies):
                unit = replace(unit, currencies=tuple(c for c in own.currencies if c in other.currencies))
        return Quantity(value * unit.scale + unit.offset, unit.dims, unit.currencies)


_MONEY = Grammar()
# Words that join a part to its whole, and words that only announce a number.
_OF = re.compile(r"/|\bsu\b|\bsur\b|\bvon\b|\bout of\b|\bof\b|\bdi\b")
_POINTS = re.compile(r"(?<!basis )\b(max|points?|punti|punkten?|punkte|pkt|pt)\b\.?")
_FACTOR = re.compile(r"\b(factor|faktor|facteur|coeff|coefficiente|coefficient|koeffizient)\b\.?")


def money(text: str) -> tuple:
    """(amount, currencies) of a value, or of a value and a currency field joined by U+001F.

    Currencies are those the writing allows: none where it states none, several for a shared sign.
    (None, None) where no amount is stated.
    """
    value, _, beside = text.partition("\x1f")
    q = _MONEY.quantity(value, beside)
    if q is None or q.dims not in (NONE, dim(money=1)) or (q.dims == NONE and "%" in value):
        return None, None
    return q.value, list(q.currencies)


def weight(text: str) -> tuple:
    """(basis points, bare number) of a criterion's weight: one of them is set, or none.

    A part of a whole, a percentage, a per mille, basis points and a factor stand alone; a number
    without any of these is bare. Ranks and words are neither.
    """
    low = unicodedata.normalize("NFC", text).lower().strip()
    low, factors = _FACTOR.subn(" ", low)
    low = " ".join(_POINTS.sub(" ", low).split())
    numbers = list(_NUMBER.finditer(low))
    values = [parse_number(m.group(), True) for m in numbers]
    if not values or any(v is None for v in values):
        return None, None
    if len(values) == 2:
        between = low[numbers[0].end() : numbers[1].start()].strip()
        rest = (low[: numbers[0].start()] + low[numbers[1].end() :]).strip()
        if not _OF.fullmatch(between) or rest or not values[1]:
            return None, None
        return float(round(values[0] / values[1] * 10_000)), None
    rest = (low[: numbers[0].start()] + " " + low[numbers[0].end() :]).strip()
    if len(values) > 2:
        return None, None
    if not rest:
        return (float(round(values[0] * 10_000)), None) if factors else (None, values[0])
    if factors:
        return None, None
    unit = _MONEY.unit(rest)
    if unit is None or unit.dims != NONE or unit.scale >= 1:
        return None, None
    return float(round(values[0] * unit.scale * 10_000)), None
