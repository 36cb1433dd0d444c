"""Column expressions over module labels, texts and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
ENTRY_STEMS = ("main", "index", "app", "lib", "mod")
PREFIX_RULES = (
    ("packages::", "apps::"), ("lib::", "apps::"), ("core::", "apps::"), ("shared::", "apps::"), ("packages::", "cmd::"), ("lib::", "cmd::"),
    ("packages/", "apps/"), ("libs/", "apps/"), ("libs/", "cli/"), ("ext/", "cli/"), ("runtime/", "cli/"), ("libs/", "runtime/"),
)
FIXED_ROOTS = ("cli", "ext", "libs", "runtime")
FIXED_PREFIXES = {"cli_": "cli", "ext_": "ext", "libs_": "libs", "runtime_": "runtime", "deno_": "deno"}
ADVICE_WORDS = (
    "break ", "consider ", "simplify", "tighten", "review ", "split ", "introduce ", "stabilize ", "add abstractions", "reduce ",
)
KIND_BY_NAME = {
    "deps": ("deps",),
    "workspace": ("workspace",),
    "entry": ("app", "apps", "website", "web", "frontend", "cmd", "service"),
    "infra": ("runtime", "infra", "platform", "shared", "common"),
}
#: Upper bounds of the named bands: (bound, name) up to and with the bound; the last one has none.
BANDS = {
    "level": ((15, "excellent"), (30, "healthy"), (55, "warning"), (80, "degraded"), (None, "critical")),
    "node": ((30, "green"), (60, "yellow"), (80, "peach"), (None, "red")),
    "sub_score": ((10, "green"), (30, "light green"), (50, "yellow"), (70, "peach"), (None, "red")),
    "edge_weight": ((1, "trivial"), (3, "light"), (7, "normal"), (15, "heavy"), (None, "critical")),
    "blast": ((10, "low"), (25, "moderate"), (45, "noticeable"), (65, "significant"), (80, "high"), (None, "critical")),
    "cascade": ((1, "direct"), (2, "second"), (3, "third"), (5, "near"), (None, "distant")),
}


def band(value: Column, scale: str) -> Column:
    out = None
    for bound, name in BANDS[scale][:-1]:
        out = F.when(value <= bound, name) if out is None else out.when(value <= bound, name)
    return out.otherwise(BANDS[scale][-1][1])


def is_entry_stem(label: Column, stems: tuple[str, ...] = ENTRY_STEMS) -> Column:
    last = F.element_at(F.split(label, "/"), -1)
    return F.split_part(last, F.lit("."), F.lit(1)).isin(*stems)


def root_token(label: Column) -> Column:
    """Text before the first '_', else before the first '-', of three bytes or more; null if there is none."""
    out = F.lit(None).cast("string")
    for sep in ("-", "_"):
        head = F.split_part(label, F.lit(sep), F.lit(1))
        out = F.when(F.contains(label, F.lit(sep)) & (F.octet_length(head) >= 3), head).otherwise(out)
    return out


def truncate(text: Column, width: int) -> Column:
    """At most `width` characters; longer texts end in an ellipsis."""
    if width <= 0:
        return F.lit("")
    return F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def first_line(text: Column) -> Column:
    return F.coalesce(F.split_part(F.regexp_replace(text, "\r\n", "\n"), F.lit("\n"), F.lit(1)), F.lit(""))


def format_epoch(seconds: Column) -> Column:
    """Minutes in UTC, '?' for null."""
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm"), F.lit("?"))


def compact_label(text: Column, width: int = 16) -> Column:
    t = F.trim(text)
    return F.when(t != "", F.substring(t, 1, width))


def cluster_suffix(base: Column, anchor: Column) -> Column:
    """What tells an anchor from its cluster's name: the rest after name and separator, else the tail after the last separator."""
    a = F.trim(anchor)
    out = F.when((a == "") | (F.lower(a) == F.lower(base)), F.lit(None).cast("string"))
    for sep in ("/", "_", "-"):
        out = out.when(a.startswith(F.concat(base, F.lit(sep))), compact_label(F.substring(a, F.char_length(base) + 2, F.lit(100000))))
    for sep in ("/", "_", "-"):
        out = out.when(F.contains(a, F.lit(sep)), compact_label(F.element_at(F.split(a, sep), -1)))
    return out.otherwise(compact_label(a))


def advisory(line: Column) -> Column:
    return F.lower(line).rlike("|".join(ADVICE_WORDS))


def prefix_rule(from_module: Column, to_module: Column) -> Column:
    out = F.lit(False)
    for a, b in PREFIX_RULES:
        out = out | (from_module.startswith(a) & to_module.startswith(b))
    return out


def kind_by_name(name: Column) -> Column:
    out = None
    for kind, names in KIND_BY_NAME.items():
        out = F.when(F.lower(name).isin(*names), kind) if out is None else out.when(F.lower(name).isin(*names), kind)
    return out.otherwise("group")
