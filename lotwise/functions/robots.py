"""Rules of robots.txt files, parsed into rows and decided for a path."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[str, bool]] = field(default_factory=list)  # (pattern, allowed)


def parse(body: str) -> list[Group]:
    """Groups in order: agents in a row share one, blank lines end nothing, an empty Disallow says nothing."""
    groups: list[Group] = []
    naming = False
    for line in body.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not naming:
                groups.append(Group())
            groups[-1].agents.append(value.lower())
            naming = True
        elif key in ("allow", "disallow"):
            naming = False
            if groups and value:
                groups[-1].rules.append((value, key == "allow"))
        else:
            naming = False
    return groups


def matches(pattern: str, path: str) -> bool:
    """From the path's beginning; each * is taken at the leftmost place without going back, $ anchors."""
    anchored = pattern.endswith("$")
    first, *rest = pattern.removesuffix("$").split("*")
    if not path.startswith(first):
        return False
    at = len(first)
    for part in rest:
        found = path.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    if not anchored:
        return True
    return at == len(path) or (bool(rest) and rest[-1] == "")


def group_of(groups: list[Group], agent: str) -> list[tuple[str, bool]]:
    """The rules for an agent: of the first group whose name it contains, else of the one for all."""
    low = agent.lower()
    named = next((g for g in groups if any(a and a != "*" and a in low for a in g.agents)), None)
    group = named or next((g for g in groups if "*" in g.agents), None)
    return group.rules if group else []


def decide(rules: list[tuple[str, bool]], path: str) -> bool:
    """The longest rule wins, Allow in a tie."""
    hits = [(len(p), ok) for p, ok in rules if matches(p, path or "/")]
    return max(hits)[1] if hits else True


def allowed(groups: list[Group], agent: str, path: str) -> bool:
    return decide(group_of(groups, agent), path)
