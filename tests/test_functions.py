import pytest
from pyspark.sql import functions as F

from graphdrift.config import Clustering, Constraint, Family, parse_config
from graphdrift.functions import labels as L
from graphdrift.functions import paths as P
from graphdrift.functions.imports import MAX_BYTES, extract, parse_imports
from graphdrift.operators.clustering import build_map


def apply(spark, f, rows):
    n = len(rows[0])
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(n)))
    return [r[0] for r in df.select(f(*[F.col(f"c{i}") for i in range(n)])).collect()]


PACKAGES = {
    "src/auth/strategies/jwt.rs": ("auth", "auth/strategies"), "packages/ui/src/a.ts": ("ui", "ui"), "apps/web/x/y.ts": ("web", "web"),
    "packages/foo.ts": ("packages", "packages"), "main.rs": ("main", "main"), "src/main.rs": ("main", "main"), "lib/x/y/z/w.go": ("x", "x/y"),
    "net/http": ("net", "net"), "@scope/pkg": ("@scope", "@scope"), "github.com/o/r/p": ("github.com", "github.com/o"), "a\\b\\c.py": ("a", "a/b"), "": ("", ""),
}


def test_packages(spark):
    rows = [(p,) for p in PACKAGES]
    assert apply(spark, lambda c: P.package_name(c, 1), rows) == [v[0] for v in PACKAGES.values()]
    assert apply(spark, lambda c: P.package_name(c, 2), rows) == [v[1] for v in PACKAGES.values()]
    assert apply(spark, P.package_name, [(None,)]) == [None]


def test_relative(spark):
    rows = [("apps/web/src", "../lib/x"), ("a/b", "./c"), ("a", "../../x"), ("a", ".."), ("", "./q")]
    assert apply(spark, P.resolve_relative, rows) == ["apps/web/lib/x", "a/b/c", None, None, "q"]
    rows = [("pkg/sub/module.py", ".config"), ("pkg/sub/module.py", "..shared"), ("m.py", "...x"), ("a/m.py", ".")]
    assert apply(spark, P.resolve_python_relative, rows) == ["pkg/sub/config", "pkg/shared", None, "a"]


def test_flags(spark):
    noise = ["a", "12", "1.2.3", "https://x", "node:fs", "npm:chalk@5", "./x.css", "", "react", "std"]
    assert apply(spark, P.noise_import, [(x,) for x in noise]) == [True] * 8 + [False] * 2
    assert apply(spark, P.normalize_import, [("npm:@a/b@1",), (" npm:c@5 ",), ("node:fs",), ("x",)]) == ["@a/b", "c", "fs", "x"]
    assert apply(spark, P.is_test_path, [("tests/unit/t.rs",), ("src/examples/t.rs",), ("a\\E2E\\x.ts",)]) == [True, False, True]
    assert apply(spark, P.ignored, [("a/dist/b.js",), ("dist/x",), ("distant/x",), ("a.d.ts",), ("x/a.d.ts",)]) == [True, True, False, True, True]
    stems = ["src/main.rs", "cli/index", "app", "packages/web/app.ts", "src/utils.rs", "core/server", "main_helper"]
    assert apply(spark, L.is_entry_stem, [(x,) for x in stems]) == [True] * 4 + [False] * 3
    assert apply(spark, lambda c: L.truncate(c, 3), [("äöü",), ("äöüß",), ("",)]) == ["äöü", "äö…", ""]
    assert apply(spark, L.cluster_suffix, [("cli", "cli/tools"), ("cli", "CLI"), ("x", "a_b"), ("x", "plain")]) == ["tools", None, "b", "plain"]


def test_imports():
    ts = 'import a from "./a"; // import x from "no"\nconst s = "import y from z"; import fs = require("fs"); import(`a${b}`); export * from "re"; require(\n "m"\n)'
    assert parse_imports("typescript", ts) == ["./a", "fs", "re", "m"]
    assert parse_imports("python", '"""import no"""\nimport a.b as c, d\nfrom . import (x, y)\nfrom ..p.q import z  # import w') == ["a", "d", ".x", ".y", "..p.q"]
    assert parse_imports("python", "import a.b, d\nfrom . import (x, y)\nnot valid here\n") == ["a", "d", ".x", ".y"]
    assert parse_imports("go", 'import (\n "fmt" // x\n al "net/http" /* "no" */\n)\nimport "os"') == ["fmt", "net/http", "os"]
    assert parse_imports("rust", 'use std::io; pub use foo::{a,b};\n// use no::x;\nlet s = "use a::b;"; use crate::x; extern crate serde;') == ["std", "foo", "serde"]
    assert parse_imports("rust", "use a;" + " " * MAX_BYTES) == [] and parse_imports(None, "import x") == [] and parse_imports("go", None) == []


def test_extract_parses_equal_blobs_once_and_keeps_rows(spark):
    rows = [(1, "go", 'import "a"', "b1"), (2, "go", 'import "a"', "b1"), (3, None, "x", "b2"), (4, "go", None, None), (4, "go", None, None)]
    df = extract(spark.createDataFrame(rows, "id int, l string, t string, b string"), ["id"], "l", "t", "b")
    assert sorted((r["id"], r["imports"]) for r in df.collect()) == [(1, ["a"]), (2, ["a"]), (3, []), (4, []), (4, [])]


def test_config():
    c = parse_config("")
    assert c.scan.package_depth == 2 and sum(c.scoring.normalized().values()) == pytest.approx(1)
    full = parse_config('[scan]\npackage_depth=1\n[scoring.weights]\ncycle=0\nlayering=0\nhub=0\ncoupling=0\ncognitive=0\ninstability=0\n[[scoring.boundaries]]\nfrom="packages/**"\ndeny=["apps/**"]')
    assert full.scoring.normalized()["cycle"] == pytest.approx(0.3)
    assert full.scoring.boundaries[0].denies("packages/core", "apps/web") and not full.scoring.boundaries[0].denies("apps/web", "packages/core")
    assert c.fingerprint() != full.fingerprint() and parse_config("[clustering]\nmin_cluster_size=9").fingerprint() == c.fingerprint()
    for bad in ("[scan]\npackage_depth=0", '[ignore]\npresets=["nope"]', "[scoring.weights]\ncycle=-1", '[clustering]\nstrategy="x"'):
        with pytest.raises(ValueError):
            parse_config(bad)


def test_namespaces_agree_with_the_map(spark):
    """The distributed namespaces and the map of one graph group and name modules alike, under families, rules and aliases."""
    from graphdrift.operators.cluster_ops import assign, clusters, links
    from graphdrift.plans.cluster_sql import CONFIGURED

    inside = {"store/a", "store/sub", "header/x", "core", "cycle/q", "api_one", "api_two", "lone", "libs_x", "cli", "web/a", "web", "deps/own", "a_backup"}
    outside = {"react", "serde", "corelib"}
    names_ = sorted(inside | outside)
    e = {(a, b): i + 1 for i, (a, b) in enumerate(zip(names_, names_[1:] + names_[:1]))}
    nodes = spark.createDataFrame([("s", x, x in inside, None) for x in names_] + [("odd", "a b", True, None), ("odd", "x/y", True, None)], "snapshot_id string, module_name string, is_internal boolean, importer_count bigint")
    edges = spark.createDataFrame([("s", a, b, w) for (a, b), w in e.items()], "snapshot_id string, from_module string, to_module string, weight bigint")
    members = assign(nodes, CONFIGURED)
    of = {(r["cluster"], r["name"], r["kind"], ("external_sink", "support", "primary")[r["role_rank"]], r["internal_weight"], r["outbound_weight"], r["inbound_weight"]) for r in clusters(members, links(edges, members), CONFIGURED).collect()}
    got = {}
    for r in members.collect():
        assert r["snapshot_id"] == "s"
        got.setdefault(r["cluster"], set()).add(r["module_name"])
    want = build_map(set(names_), e, inside, CONFIGURED)
    assert {frozenset(m) for m in got.values()} == {frozenset(c.members) for c in want}
    assert sorted((sorted(got[c]), *rest) for c, *rest in of) == sorted((sorted(c.members), c.name, c.kind, c.role, c.inside, c.outbound, c.inbound) for c in want)


def test_clustering_settings():
    c = parse_config("""
[clustering]
strategy = "namespace"
[clustering.semantic]
include_exact_roots_for_known_heads = false
[clustering.structural]
enabled = false
preserve_family_purity = false
min_cluster_size = 4
[clustering.presentation.aliases]
deps = "third-party"
[clustering.presentation.kinds]
third-party = "deps"
[[clustering.families]]
name = "runtime"
kind = "infra"
include = ["runtime", "runtime/**"]
exclude = ["runtime/test/**"]
split = "never"
[[clustering.rules]]
name = "node"
match = ["node*", "runtime/**"]
[[clustering.constraints]]
type = "must_group"
members = ["core", "core/**"]
""").clustering
    assert (c.strategy, c.include_exact_roots, c.structural, c.purity, c.min_cluster_size, c.aliases["deps"]) == ("namespace", False, False, False, 4, "third-party")
    assert [c.family(x) and c.family(x).name for x in ("runtime/a", "runtime/test/a", "node_x", "z")] == ["runtime", "node", "node", None]
    assert c.constraints[0].left == ["core", "core/**"] and parse_config("[clustering]\nworkspace_split_threshold = 9").clustering.split_threshold == 9


def names(cs):
    return {c.name: c.members for c in cs}


def test_clusters():
    labels = {"web/a", "web/b", "api/a", "api/b", "react", "serde"}
    edges = {("web/a", "web/b"): 2, ("api/a", "api/b"): 2, ("web/a", "react"): 1, ("api/a", "serde"): 1, ("web/a", "api/a"): 3}
    got = names(build_map(labels, edges, labels - {"react", "serde"}))
    assert got == {"web": {"web/a", "web/b"}, "api": {"api/a", "api/b"}, "deps": {"react", "serde"}}
    rule = Clustering(constraints=[Constraint("must_group", ["web/**", "api/**"])])
    assert {frozenset(c.members) for c in build_map(labels, edges, labels - {"react", "serde"}, rule)} == {frozenset({"web/a", "web/b", "api/a", "api/b"}), frozenset({"react", "serde"})}
    close = {(a, b): 1 for a in labels for b in labels if a < b and "/" in a and "/" in b}
    apart = Clustering(families=[Family("all", ["**"])], constraints=[Constraint("must_separate", ["web/**"], ["api/**"])])
    assert {frozenset(c.members) for c in build_map(labels - {"react", "serde"}, close, labels, apart)} == {frozenset({"web/a", "web/b"}), frozenset({"api/a", "api/b"})}
    assert build_map({"a", "b"}, {}, {"a"}) is None
