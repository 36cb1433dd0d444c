import random

from graphdrift.llm.source_kinds import composition, file_kinds, hand_written

WORDS = "parse edge graph node merge split cache token field label stock panel quote chart audit theme depot hub".split()


def hand(seed, n=30):
    rng = random.Random(seed)
    w = lambda: rng.choice(WORDS) + rng.choice(WORDS).title()
    forms = ["const {} = {}({});", "if ({} > {}) {{", "}}", "return {}.{};", "// {} before {} and {}", "for (const {} of {}) {{", "{}.push({} + {});", "let {} = {};", "switch ({}) {{", "throw new Error({} + {});"]
    return "\n".join(f.format(*[w() for _ in range(f.count("{}"))]) for f in (rng.choice(forms) for _ in range(n)))


GETTERS = "\n".join(f"  get{a.title()}{i}() {{\n    return this.f[{i}];\n  }}" for i, a in enumerate(WORDS * 2))


def test_composition():
    assert composition("// Code generated by foogen v1. DO NOT EDIT.\n" + hand(1)) == "generated"
    assert composition("# @generated by x\nx = 1") == composition("// <auto-generated>\nx = 1") == "generated"
    assert composition("// This is no longer generated by foogen: edit it\n" + hand(1)) is None
    assert composition(GETTERS) == "generated"
    assert composition("// Not generated: please edit freely (x was retired)\n" + hand(2)) is None
    assert composition("// Started as output of gen, kept by hand since 2020.\n" + hand(2)) is None
    assert composition("// do not edit the list while iterating\n" + hand(3)) is None
    assert composition(hand(4) + "\n// @generated by nobody, this is a remark far below\n" + hand(5)) is None
    assert composition("!function(a){b=a||c}(d);" * 60) == "minified"
    assert composition("X = [" + ", ".join(str(i * 37 % 251) for i in range(900)) + "]") == "data"
    assert composition("X = '''" + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0123456789abcd\n" * 30 + "'''") == "data"
    assert composition("/*!\n * tamlib v1.2.3\n * (c) tamlib contributors\n */\n" + hand(6)) == composition("// vendored from tamlib at 58b03e60\n" + hand(6)) == "third_party"
    assert composition("// inspired by tamlib\n" + hand(6)) is None
    assert composition("// Copyright 2024 the hub team. All rights reserved.\n" + hand(7)) is None
    assert composition("\n\n") is None and composition("x") is None


def test_leading_comment_is_read_to_its_end():
    licence = "\n".join(f" * line {i} of the licence text" for i in range(60))
    assert composition(f"/*\n{licence}\n */\n// @generated by foogen\n" + hand(8)) == "generated"
    assert composition("# copies src/* to the target\n" + hand(9) + "\n# @generated is what the old tool wrote\n") is None


FILE = "file_id bigint, repo_id string, file_path string, body string, h bigint, kind string"
UP = "upstream_id bigint, lib_name string, body string, file_id int"


def test_copies_are_found_when_edited(spark):
    lib = hand(100, 60)
    edited = lib.split("\n")
    edited[5:5] = ["const ownExtra = 1;"]
    edited[20] = "// local change here"
    crlf = "\r\n".join("  " + x for x in edited)
    shared = hand(101, 40)
    files = [(i, f"r{i % 7}", f"p{i}.js", hand(i, 40), 1, "x") for i in range(60)]
    files += [
        (100, "r1", "a.js", lib, 1, ""), (101, "r2", "b.js", crlf, 1, ""), (102, "r3", "c.js", lib[: len(lib) // 6] + "\n" + hand(7000, 60), 1, ""),
        (103, "r1", "d.js", shared, 1, ""), (104, "r2", "e.js", shared, 1, ""), (105, "r1", "n.js", None, 1, ""), (106, None, "o.js", "", 1, ""), (107, "r1", "long.js", hand(9009, 20000), 1, ""),
    ]
    up = [(1, "lib", lib, 1), (2, "lib2", hand(300, 50), 1), (3, "none", None, 1)]
    got = {r["file_id"]: r["kind"] for r in file_kinds(spark.createDataFrame(files, FILE), spark.createDataFrame(up, UP)).collect()}
    assert len(got) == len(files)
    assert {k for k, v in got.items() if v == "third_party"} == {100, 101, 103, 104}
    assert {got[k] for k in (102, 105, 106)} == {"hand_written"}


def test_copies_are_found_however_many(spark):
    """A third of all files are copies, unchanged or changed a little, of a published library or of one that isn't listed."""
    lib, other = hand(400, 40), hand(401, 40)
    remark = "// ties go to the smaller name"

    def changed(body, i):
        lines = body.split("\n")
        lines[i % 40] = f"const local{i} = own{i};"
        return "\n".join(lines)

    files = [(i, f"r{i % 9}", f"p{i}.js", remark + "\n" + hand(20_000 + i, 40), 1, "") for i in range(240)]
    for at, body in ((1000, lib), (2000, other)):
        files += [(at + i, f"r{i % 9}", f"c{at + i}.js", body if i < 30 else changed(body, i), 1, "") for i in range(60)]
    up = [(1, "lib", lib, 1), (2, "lib2", hand(300, 50), 1)]
    got = {r["file_id"] for r in file_kinds(spark.createDataFrame(files, FILE), spark.createDataFrame(up, UP)).where("kind = 'third_party'").collect()}
    assert got == {at + i for at in (1000, 2000) for i in range(60)}


def test_lines_from_many_files_make_no_copy(spark):
    """A file whose lines all occur elsewhere, but in no one file, is hand-written; one within a single file is a copy."""
    parts = [hand(600 + i, 40).split("\n") for i in range(8)]
    mixed = "\n".join(line for p in parts for line in p[:8])
    part_of = "\n".join(["const own = 1 + others;", *parts[3][:36]])
    files = [(i, f"r{i}", f"p{i}.js", "\n".join(p), 1, "x") for i, p in enumerate(parts)] + [(100, "s", "m.js", mixed, 1, ""), (101, "s", "n.js", part_of, 1, "")]
    got = {r["file_id"]: r["kind"] for r in file_kinds(spark.createDataFrame(files, FILE), spark.createDataFrame([], UP)).collect()}
    assert got[100] == "hand_written" and got[101] == "third_party"


def test_short_copies_in_other_repositories(spark):
    small = hand(500, 8)
    files = [(i, f"r{i % 7}", f"p{i}.js", hand(30_000 + i, 8), 1, "") for i in range(30)]
    files += [(100, "r1", "a.js", small, 1, ""), (101, "r2", "b.js", small.replace("\n", "\r\n  "), 1, ""), (102, "r3", "c.js", "x\n", 1, ""), (103, "r4", "d.js", "x\n", 1, "")]
    files += [(104, "r5", "e.js", hand(501, 8), 1, ""), (105, "r5", "f.js", hand(501, 8), 1, "")]
    got = {r["file_id"] for r in file_kinds(spark.createDataFrame(files, FILE), spark.createDataFrame([], UP)).where("kind = 'third_party'").collect()}
    assert got == {100, 101}


def test_empty_and_named(spark):
    files, up = spark.createDataFrame([], FILE), spark.createDataFrame([], UP)
    assert file_kinds(files, up).collect() == []
    edge = "repo_id string, file_path string, sample_origins array<struct<file_path string, line bigint>>"
    edges = spark.createDataFrame([("r", ".\\a.js".replace(".\\", "./"), None), ("r", None, [("src\\b.js", 1), (None, 2)])], edge)
    some = spark.createDataFrame([(1, "r", "a.js", hand(1), 1, ""), (2, "r", "src/b.js", hand(2), 1, ""), (3, "r", "c.js", hand(3), 1, "")], FILE)
    assert {r["file_id"] for r in hand_written(edges, some, up).collect()} == {1, 2}


def test_copies_whose_source_is_neither_first_nor_last_holder(spark):
    own = [f"let unique{i} = compute{i}(alpha, beta);" for i in range(20)]
    halves = {"a": own[:10], "b": own[10:], "y": own[:10], "z": own[10:]}
    rows = [(1, "m", "m.js", "\n".join(own), None), (2, "n", "n.js", "\n".join(own[:16] + [f"export const other{i} = {i};" for i in range(9)]), None)]
    rows += [(10 + i, repo, "x.js", "\n".join(part + [f"return {repo}{j} + {j} * scale;" for j in range(20)]), None) for i, (repo, part) in enumerate(halves.items())]
    files = spark.createDataFrame([(*r, None) for r in rows], FILE)
    got = {r.file_id for r in file_kinds(files, spark.createDataFrame([], UP)).where("kind = 'third_party'").collect()}
    assert got == {1}
