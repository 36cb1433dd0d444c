"""Project configuration from TOML: ignore globs, scan, scoring and clustering settings, and their fingerprints."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .functions.labels import ENTRY_STEMS
from .functions.paths import IGNORE_PRESETS, TEST_FRAGMENTS, globs_regex

WEIGHTS = {"cycle": 30.0, "layering": 25.0, "hub": 15.0, "coupling": 12.0, "cognitive": 10.0, "instability": 8.0}


@dataclass
class Ignore:
    paths: list[str] = field(default_factory=list)
    presets: list[str] = field(default_factory=list)
    use_defaults: bool = True
    custom_presets: dict[str, list[str]] = field(default_factory=dict)

    def globs(self) -> list[str]:
        """Globs in order: default presets, named presets (own ones win over built-in ones), own paths; each once."""
        out: list[str] = []
        for name in [*(IGNORE_PRESETS if self.use_defaults else ()), *self.presets]:
            found = self.custom_presets.get(name, IGNORE_PRESETS.get(name))
            if found is None:
                raise ValueError(f"unknown ignore preset {name!r}; known: {sorted(set(IGNORE_PRESETS) | set(self.custom_presets))}")
            out += found
        return list(dict.fromkeys([*out, *self.paths]))


@dataclass
class Scan:
    package_depth: int = 2
    external_min_importers: int = 3
    test_path_patterns: list[str] = field(default_factory=lambda: list(TEST_FRAGMENTS))


@dataclass
class Thresholds:
    hub_exemption_ratio: float = 0.3
    entry_point_max_fan_in: int = 2
    brittle_instability_ratio: float = 0.8
    blast_high_impact_threshold: float = 0.3
    blast_max_critical_paths: int = 5


@dataclass
class Exemptions:
    hub_exempt: list[str] = field(default_factory=list)
    instability_exempt: list[str] = field(default_factory=list)
    entry_point_stems: list[str] = field(default_factory=lambda: list(ENTRY_STEMS))


@dataclass
class Boundary:
    from_glob: str
    deny: list[str]

    def denies(self, from_module: str, to_module: str) -> bool:
        return bool(re.match(globs_regex([self.from_glob]), from_module) and re.match(globs_regex(self.deny), to_module))


@dataclass
class Scoring:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    thresholds: Thresholds = field(default_factory=Thresholds)
    exemptions: Exemptions = field(default_factory=Exemptions)
    boundaries: list[Boundary] = field(default_factory=list)

    def normalized(self) -> dict[str, float]:
        """Weights as shares of their sum; the defaults where the sum is not positive."""
        w = self.weights if sum(self.weights.values()) > 0 else WEIGHTS
        return {k: v / sum(w.values()) for k, v in w.items()}


@dataclass
class Family:
    name: str
    include: list[str]
    priority: int = 0
    kind: str | None = None
    split: str = "auto"
    merge_small_into_family: bool = True
    exclude: list[str] = field(default_factory=list)

    def matches(self, label: str) -> bool:
        return bool(re.match(globs_regex(self.include), label)) and not re.match(globs_regex(self.exclude), label)


@dataclass
class Constraint:
    type: str  # must_group or must_separate
    left: list[str]
    right: list[str] = field(default_factory=list)


@dataclass
class Clustering:
    strategy: str = "hybrid"
    collapse_external: bool = True
    root_token_min_repeats: int = 2
    fallback_family: str = "workspace"
    include_exact_roots: bool = True
    structural: bool = True
    min_cluster_size: int = 2
    split_threshold: int = 6
    max_cluster_share: float = 0.45
    purity: bool = True
    post_merge: bool = True
    disambiguate: bool = True
    families: list[Family] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    rules: list[Family] = field(default_factory=list)

    def ordered_families(self) -> list[Family]:
        """Families in the order in which they are tried: highest priority, then most patterns, then the earlier one; the plain
        rules come last, in their own order."""
        at = sorted(range(len(self.families)), key=lambda i: (-self.families[i].priority, -len(self.families[i].include), i))
        return [self.families[i] for i in at] + self.rules

    def family(self, label: str) -> Family | None:
        """The first family or rule that matches."""
        return next((f for f in self.ordered_families() if f.matches(label)), None)


@dataclass
class Config:
    ignore: Ignore = field(default_factory=Ignore)
    scan: Scan = field(default_factory=Scan)
    scoring: Scoring = field(default_factory=Scoring)
    clustering: Clustering = field(default_factory=Clustering)

    def fingerprint(self, with_scoring: bool = True) -> str:
        """Canonical JSON of what changes a scan; clustering is computed when asked and never does."""
        body = {"ignore": asdict(self.ignore), "scan": asdict(self.scan)} | ({"scoring": asdict(self.scoring)} if with_scoring else {})

        def canonical(x):
            if isinstance(x, dict):
                return {k: canonical(v) for k, v in x.items()}
            if isinstance(x, list):
                return sorted((canonical(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True))
            return x

        return json.dumps(canonical(body), sort_keys=True, separators=(",", ":"))


def _take(cls, table: dict):
    known = {k: v for k, v in table.items() if k in cls.__dataclass_fields__}
    return cls(**known)


# Settings of the sub-tables of [clustering], and older flat ones, by the names they have here.
_CLUSTERING = {
    "semantic": {"include_exact_roots_for_known_heads": "include_exact_roots"},
    "structural": {"enabled": "structural", "preserve_family_purity": "purity", "post_merge_small_clusters": "post_merge", "disambiguate_duplicate_names": "disambiguate"},
    "presentation": {},
}
_OLD = {"workspace_split_threshold": "split_threshold", "workspace_max_share": "max_cluster_share", "cluster_aliases": "aliases", "cluster_kinds": "kinds"}


def _clustering(c: dict) -> Clustering:
    flat = {_OLD.get(k, k): v for k, v in c.items() if k not in _CLUSTERING and k not in ("families", "rules", "constraints")}
    for part, names in _CLUSTERING.items():
        flat |= {names.get(k, k): v for k, v in c.get(part, {}).items()}
    out = _take(Clustering, flat)
    out.families = [_take(Family, f) for f in c.get("families", [])]
    out.rules = [Family(r["name"], list(r.get("match", [])), kind=r.get("kind")) for r in c.get("rules", [])]
    out.constraints = [Constraint(x["type"], list(x.get("members", x.get("left", []))), list(x.get("right", []))) for x in c.get("constraints", [])]
    return out


def parse_config(text: str) -> Config:
    """Settings from TOML text; missing ones have their defaults. ValueError for what isn't valid."""
    t = tomllib.loads(text)
    s, c = t.get("scoring", {}), t.get("clustering", {})
    scoring = Scoring(
        WEIGHTS | {k: float(v) for k, v in s.get("weights", {}).items()},
        _take(Thresholds, s.get("thresholds", {})),
        _take(Exemptions, s.get("exemptions", {})),
        [Boundary(r["from"], list(r["deny"])) for r in s.get("boundaries", [])],
    )
    clustering = _clustering(c)
    out = Config(_take(Ignore, t.get("ignore", {})), _take(Scan, t.get("scan", {})), scoring, clustering)
    out.ignore.globs()
    if out.scan.package_depth < 1:
        raise ValueError("scan.package_depth must be at least 1")
    if any(v < 0 for v in out.scoring.weights.values()):
        raise ValueError("scoring.weights must not be negative")
    if out.clustering.strategy not in ("hybrid", "namespace", "structural"):
        raise ValueError(f"unknown clustering strategy {out.clustering.strategy!r}")
    return out


def load_config(path: str | Path) -> Config:
    """Settings of a project folder's file; the defaults if there is none."""
    p = Path(path)
    return parse_config(p.read_text(encoding="utf-8")) if p.exists() else Config()
