"""Reading of names and addresses typed by people: parts of a name, teams, and what an address says about its owner."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

# Letters that don't decompose, titles, and addresses that stand for none.
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
TITLES = {"dr", "mr", "mrs", "ms", "mx", "prof", "ing", "dipl", "phd", "sir"}
# Words that commonly name what a team does; the table adds its own.
TEAM_WORDS = {"platform", "operations", "data", "services", "security", "response", "quality", "assurance", "documentation", "group"}
TEAM_WORDS |= {"build", "infrastructure", "release", "engineering", "developer", "experience", "support", "research", "analytics", "delivery"}
NO_ADDRESS = {"", "-", "unknown", "none", "none@none", "null", "n/a", "na", "noreply", "no-reply"}
# Labels of domains that stand for a single machine or a home network.
MACHINE_LABELS = {"lan", "local", "localdomain", "localhost", "internal", "home"}
_ASIDE = re.compile(r"\([^)]*\)|\[[^\]]*\]|\s[|/]\s.*$|\s[-–—]\s(?=\w+\s*$).*$")
_PREFIX = re.compile(r"^\s*(?:dev|git|ext|adm|svc)[-_]\s*(?=[^\W\d_]{2,})", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def fold(s: str) -> str:
    """Lower case without marks on letters."""
    s = unicodedata.normalize("NFKD", s.lower().translate(_PLAIN))
    return "".join(c for c in s if not unicodedata.combining(c)).translate(_PLAIN)


def address(email: str | None) -> tuple[str, str]:
    """(local, domain) in lower case without a tag; empty where there is none."""
    e = fold((email or "").strip())
    if e in NO_ADDRESS or "@" not in e:
        return "", ""
    local, _, domain = e.rpartition("@")
    if "noreply" in domain:
        return local, domain
    if "+" in local:
        a, _, b = local.partition("+")
        local = b if len(a) <= 3 and len(b) > len(a) else a
    return local, domain


def organisation(domain: str) -> str:
    """The name in a domain, without top level and hyphenated kind."""
    return domain.split(".")[0].split("-")[0] if domain else ""


def of_machine(domain: str) -> bool:
    """Whether a domain names a single machine, so that its local parts are names of accounts on it."""
    return not MACHINE_LABELS.isdisjoint(domain.split("."))


@dataclass
class Lexicon:
    """What the whole table says: given names, and words that name functions of teams."""

    given: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.ordered = sorted(self.functions)
        self.known: dict[str, str | None] = {}
        # a function run together in an address: both words, or three letters of each -> their initials
        self.joined: dict[str, str] = {}
        for a in reversed(self.ordered):
            for b in reversed(self.ordered):
                for local in (a[:3] + b[:3], a + b):
                    self.joined[local] = a[0] + b[0]

    def function(self, word: str) -> str | None:
        """The function word that `word` is or abbreviates: a prefix of three letters or more, or consonants in order."""
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = self._function(word)
        return self.known[word]

    def _function(self, word: str) -> str | None:
        if word in self.functions:
            return word
        if len(word) < 3:
            return None
        stem = word.rstrip("s") if len(word) > 3 else word
        for f in self.ordered:
            if f.startswith(stem) and len(stem) >= 3:
                return f
        for f in self.ordered:
            if f[0] == word[0] and len(word) <= 4 and re.search(".*".join(word), f):
                return f
        return None


def words_of(name: str) -> tuple[list[str], bool]:
    """(the words of a name without asides and titles, whether a comma puts the surname first)."""
    name = _PREFIX.sub("", _ASIDE.sub(" ", name.replace("\xa0", " "))).strip()
    if " " not in name and re.search(r"[a-zß-ÿ][A-ZÀ-Þ]", name):
        name = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", name)
    comma = "," in name
    head, _, tail = name.partition(",")
    parts = []
    for side in (head, tail):
        joined = re.sub(r"(?<=\w)[-'’](?=\w)", "", side) if " " in name or comma else side
        parts.append([w for w in _WORD.findall(fold(joined)) if w not in TITLES])
    return parts[0] + ([","] if comma and parts[1] else []) + parts[1], comma


def parse_name(name: str, lex: Lexicon) -> tuple[str, str, str]:
    """(given, middle initials, surname); a given name or surname may be one letter or empty."""
    words, _ = words_of(name)
    if "," in words:
        i = words.index(",")
        sur, rest = words[:i], words[i + 1 :]
        letters = [w for w in rest if len(w) == 1]
        full = [w for w in rest if len(w) > 1]
        if full:
            return full[0], "".join(letters) + "".join(w[0] for w in full[1:]), "".join(sur)
        return "".join(letters[:1]), "".join(letters[1:]), "".join(sur)
    full = [w for w in words if len(w) > 1]
    letters = [w for w in words if len(w) == 1]
    if len(full) >= 2:
        first, last = full[0], full[-1]
        if last in lex.given and first not in lex.given:
            first, last = last, first
        return first, "".join(letters), last
    if len(full) == 1 and letters:
        w = full[0]
        if w in lex.given:  # Petra T.
            return w, "", letters[-1] if words[-1] == letters[-1] else ""
        return letters[0], "".join(letters[1:]), w
    if len(full) == 1:
        return (full[0], "", "") if full[0] in lex.given else ("", "", full[0])
    return "", "", ""


def parse_local(local: str, domain: str, lex: Lexicon) -> tuple[str, str]:
    """(given name or its initial, surname) that a local part with a separator tells, else empty strings."""
    if "noreply" in domain:
        return "", ""
    if of_machine(domain):
        return local, ""
    parts = [re.sub(r"\d+$", "", p) for p in re.split(r"[._-]", local)]
    parts = [p for p in parts if p]
    if len(parts) != 2:
        return "", ""
    a, b = parts
    if len(b) == 1:
        return b, a
    if len(a) == 1:
        return a, b
    return (b, a) if b in lex.given and a not in lex.given else (a, b)


def resembles(name: str, given: str, surname: str, local: str, domain: str, lex: Lexicon) -> bool:
    """Whether an address is its owner's own by the look of it, and not one that several people use."""
    letters = re.sub(r"[^a-z]", "", local)
    if not letters:
        return False
    flat = re.sub(r"[^a-z]", "", fold(name))
    if len(surname) >= 4 and (surname[:4] in letters or surname[-5:] in letters):
        return True
    if len(given) >= 3 and given[:3] in letters and (of_machine(domain) or len(surname) < 4 or letters.startswith(given)):
        return True
    g, s = parse_local(local, domain, lex)
    if g and s and len(surname) <= 1 and len(given) > 1 and given[0] == g[0] and (not surname or surname == s[0]):
        return True
    if g and s and flat in (g[0] + s[0], s[0] + g[0], g[0] + s, s + g[0], g + s[0], g):
        return True
    if len(flat) >= 4 and (flat[:5] in letters or letters[:5] in flat):
        return True
    if flat[:-1] in lex.given and (letters.startswith(flat[0] + flat[-1]) or (g and s and flat[0] == g[0] and flat[-1] == s[0])):
        return True
    if len(given) > 1 and len(surname) == 1 and letters.startswith(given[0] + surname):
        return True
    if len(flat) == 2 and letters.startswith(flat):
        return True
    return len(flat) in (2, 3) and g != "" and s != "" and flat[0] == g[0] and flat[-1] == s[0]


def parse_team(name: str, local: str, domain: str, lex: Lexicon) -> tuple[str, str] | None:
    """(organisation, initials of the team's function) where a name or its address names a team, else None."""
    words = [w for w in _WORD.findall(fold(name)) if w not in ("the", "team", "ltd", "and")]
    found = [(w, f) for w in words if (f := lex.function(w))]
    exact = sum(w in lex.functions for w, _ in found)
    parts = [p for p in re.split(r"[._-]", local) if p]
    by_mail = ""
    if len(parts) == 2 and all(p in lex.functions for p in parts):
        by_mail = parts[0][0] + parts[1][0]
    else:
        by_mail = lex.joined.get(local, "")
    org = organisation(domain)
    if len(found) >= 2 and (exact or by_mail or len(words) <= 4):
        others = [w for w in words if not lex.function(w)]
        return org if by_mail else (others[0] if others else org), found[-2][1][0] + found[-1][1][0]
    if by_mail and (len(words) <= 1 or len(found) >= 1):
        return org, by_mail
    return None
