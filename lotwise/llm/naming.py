"""Canonical tokens of typed names, and how alike two tokens are."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

# Words that carry no meaning of their own in a name.
FILLERS = frozenset("di de del della dei degli des du la le il al of the der die das von d i f fo id il and e".split())

def distance(a: str, b: str, most: int = 3) -> int:
    """Edits between two words, a swap of neighbours counting one; ``most + 1`` beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def allowed(word: str) -> int:
    """Typing errors allowed in a word of this length."""
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


def plain(text: str) -> str:
    """Lower case without accents and punctuation; dotted abbreviations become one word."""
    if re.search("[Ãã][^A-Za-z ]", text):  # UTF-8 once read as another code page
        try:
            text = text.replace("ã", "Ã").encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"\.(?=[a-z])", "", text).replace("'", "").replace("’", "")
    return " ".join(re.sub(r"[^a-z0-9]+", " ", text).split())


def deletions(word: str, most: int) -> set[str]:
    """The word without up to ``most`` of its letters: near words share one of these."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


#: Deletions of a vocabulary's words, by the vocabulary.
_INDEX: dict[int, dict[str, list[str]]] = {}
#: Corrections already worked out in this process, by the vocabulary they depend on.
_MEMO: dict[int, dict[str, str]] = {}


@dataclass
class Canon:
    """Rewrites names: typing errors in known words, then what people write for a kind.

    ``kinds``: the official words of each known phrase (as tuples of words), ``units``: phrases that
    are left out, ``kept``: words, as of a register's own names, that no word near to them is taken
    for an error of.
    """

    kinds: dict[tuple[str, ...], tuple[str, ...]] = field(default_factory=dict)
    units: list[tuple[str, ...]] = field(default_factory=list)
    kept: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.rules = self.kinds | {u: () for u in self.units}
        self.longest = max((len(a) for a in self.rules), default=1)
        self.known = sorted({w for a in [*self.rules, FILLERS] for w in a if len(w) >= 5})
        self.words = {w for a in [*self.rules, FILLERS] for w in a}
        self.near = sorted({w for w in self.kept if len(w) >= 4} | set(self.known))
        self.mark = hash((tuple(self.near), tuple(sorted(self.words))))

    def _correct(self, word: str) -> str:
        if word in self.words or word in self.kept or len(word) < 4:
            return word
        memo = _MEMO.setdefault(self.mark, {})
        if word not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[word] = self._corrected(word)
        return memo[word]

    def _corrected(self, word: str) -> str:
        if self.mark not in _INDEX:
            index = _INDEX.setdefault(self.mark, {})
            for k in self.near:
                for d in deletions(k, 2):
                    index.setdefault(d, []).append(k)
        index = _INDEX[self.mark]
        found = {k for d in deletions(word, 2) for k in index.get(d, ())}
        best = min(((distance(word, k, 2), k) for k in found), default=(9, ""))
        return best[1] if best[1] in self.words and best[0] <= (1 if len(best[1]) < 7 else 2) else word

    def tokens(self, name: str) -> list[str]:
        """The sorted distinct tokens of a name; none for null and empty names."""
        words = [w for x in plain(name).split() if (w := self._correct(x)) not in FILLERS]
        out: list[str] = []
        i = 0
        while i < len(words):
            for n in range(min(self.longest, len(words) - i), 0, -1):
                rule = self.rules.get(tuple(words[i : i + n]))
                if rule is not None:
                    out += rule
                    i += n
                    break
            else:
                out.append(words[i])
                i += 1
        return sorted(set(out))


def alike(a: str, b: str) -> float:
    """From 0 to 1: equal, an initial standing for a word, or a word with typing errors."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] else 0.0
    longer = max(a, b, key=len)
    d = distance(a, b, allowed(longer))
    return 1.0 - 0.5 * d / len(longer) if d <= allowed(longer) else 0.0


def shortens(short: str, word: str) -> bool:
    """Whether a word of two letters or more is another with letters left out behind the first."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    letters = iter(word)
    return all(c in letters for c in short)


def soft_similarity(a: list[str], b: list[str], weight: dict[str, float], rare: float, common: frozenset[str] = frozenset()) -> float:
    """Weighted Dice over softly equal tokens, each paired once, best pairs first.

    ``weight``: of a token, ``rare`` for tokens it lacks (1 if of three letters or less, most often
    a particle with an error); a pair weighs as its second token. A token of ``common`` may be shortened.
    """
    of = lambda t: weight.get(t, rare if len(t) > 3 else 1.0)
    same = lambda x, y: alike(x, y) or (0.9 if y in common and len(x) <= 4 and shortens(x, y) else 0.0)
    pairs = sorted(((s, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := same(x, y)) > 0), key=lambda p: (-p[0], p[1], p[2]))
    left, right, both, own = set(range(len(a))), set(range(len(b))), 0.0, 0.0
    for s, i, j in pairs:
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            both += s * of(b[j])
            own += of(b[j])
    whole = 2 * own + sum(of(a[i]) for i in left) + sum(of(b[j]) for j in right)
    return 2 * both / whole if whole else 0.0


def idf(n: int, df: int) -> float:
    return math.log(1 + n / df)
