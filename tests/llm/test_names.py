import itertools
import random

from graphdrift.llm.name_links import author_pairs, components, index_entries, probe_entries, same_authors, segment_join, word_edits
from graphdrift.llm.name_parse import Lexicon, address, parse_name

COMMIT = "author_key bigint, author_name string, author_email string, label string, node string"
FORM = "short_form string, full_form string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_segment_join_equals_all_pairs(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 15))) for _ in range(160)}
    for w in list(words)[:80]:
        for _ in range(2):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcd") + w[i:], w[:i] + "e" + w[i + 1 :], w]) or "a")
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    got = {(r["a"], r["b"]): r["dist"] for r in segment_join(df, "w").collect()}
    want = {(a, b): d for a, b in itertools.permutations(words, 2) if (d := distance(a, b)) <= word_edits(max(len(a), len(b)))}
    assert got == want


def test_segments_cover_and_meet():
    assert [e[3] for e in index_entries("abcdefgh") if e[0] == 3] == ["ab", "cd", "ef", "gh"]
    assert set(probe_entries("abc")) == set()


def test_components_of_a_long_chain(spark):
    links = [(i, f"n{i // 2}") for i in range(60)] + [(i, f"m{(i + 1) // 2}") for i in range(60)] + [(100, "x"), (101, "y"), (101, "y")]
    got = {r["author_key"]: r["label"] for r in components(spark.createDataFrame(links, "author_key bigint, node string")).collect()}
    assert got == dict.fromkeys(range(60), 0) | {100: 100, 101: 101}


PEOPLE = [
    (1, "Theodore Bridairithorpe", "bridairithorpe.t@acme.example"), (2, "Thedoore Bridairithorpe", "bridairithorpe.t+oss@acme.example"), (3, "Bridairithorpe, Ted", None),
    (4, "TB", "Bridairithorpe.T@ACME.example"), (5, "Dr. Theodore Bridairithrope", "none@none"),
    (10, "Richard D. Brogovussart", "brogovussart.r@one.example"), (11, "Richard H. Brogovussart", "richard.brogovussart@two.example"), (12, "richard brogovussart", "richard.brogovussart@two.example"), (13, "Brogovussart, Richard D.", ""),
    (20, "Amina Tostegrorrow", "team@acme.example"), (21, "Edward Tostegrorrow", "team@acme.example"), (22, "Tostegrorrow Amina", "-"),
    (30, "Acme Software Data Services", "data.services@acme.example"), (31, "Data Services (Acme)", "data.services@acme.example"), (32, "acme-data-services", None), (33, "Acme Software Release Engineering", "release.engineering@acme.example"),
    (40, "unknown", "unknown"), (41, "dep[bot]", "x@bots.example"), (42, None, "q@acme.example"), (43, "", ""), (44, "x" * 5000, None),
    (50, "Zoë Maiwestughan", "zoe.maiwestughan@acme.example"), (51, "Zoe\xa0Maiwestughan", None), (52, "Vincent Sedinonko", "sedinonko.v@one.example"), (53, "Vera Sedinonko", "sedinonko.v2@one.example"),
]
GROUPS = [{1, 2, 3, 4, 5}, {10, 13}, {11, 12}, {20, 22}, {30, 31, 32}, {50, 51}]


def test_people_and_teams(spark):
    rows = [(*p, "l", "n") for p in PEOPLE] * 2 + [(None, "No Key", "nk@acme.example", "", "")]
    forms = spark.createDataFrame([("Ted", "Theodore"), ("Ted", "Edward"), (None, None)], FORM)
    pairs = {tuple(r) for r in author_pairs(same_authors(spark.createDataFrame(rows, COMMIT), forms)).collect()}
    assert pairs == {p for g in GROUPS for p in itertools.combinations(sorted(g), 2)}


def test_swapped_letters_in_short_names(spark):
    people = [
        (412, "Priay Kugrikacroft", "priya@dev-607.lan.example"), (152, "Priya Kugrikacroft", "a@one.example"), (158, "Priya Kugrikacroft", None),
        (20, "Amina Lien", None), (21, "Amina Lien", "x@two.example"), (22, "Amina Line", None), (30, "Aiko Tostegrorrow", None), (31, "Aiko Tostegrorrow", "y@two.example"), (32, "Akio Tostegrorrow", None), (33, "Kaoi Tostegrorrow", None),
    ]
    rows = [(*p, "l", "n") for p in people]
    pairs = {tuple(r) for r in author_pairs(same_authors(spark.createDataFrame(rows, COMMIT), spark.createDataFrame([], FORM))).collect()}
    assert pairs == {p for g in ({152, 158, 412}, {20, 21, 22}, {30, 31, 32}) for p in itertools.combinations(sorted(g), 2)}


def test_variants_of_variants_of_variants(spark):
    """Each spelling is near the next one only; the pointers lead all of them to the most frequent one."""
    chain = ["Kuvelsanderix", "Kuvelsamderax", "Kuvilsamdorax", "Koviltamdorax", "Koviltandorek", "Gofiltandorek"]
    people, key = [], 0
    for i, surname in enumerate(chain):
        for _ in range(i + 1):
            key += 1
            people.append((key, f"Amina {surname}", f"box{key}@shared.example", "l", "n"))
    got = {tuple(r) for r in author_pairs(same_authors(spark.createDataFrame(people, COMMIT), spark.createDataFrame([], FORM))).collect()}
    assert got == set(itertools.combinations(range(1, key + 1), 2))


def test_empty(spark):
    assert author_pairs(same_authors(spark.createDataFrame([], COMMIT), spark.createDataFrame([], FORM))).collect() == []


def test_parsing():
    lex = Lexicon({"aiko", "petra"}, set())
    assert parse_name("Kebrezaidahl Aiko", lex) == ("aiko", "", "kebrezaidahl")
    assert parse_name("A.B.\xa0Rewožamann", lex) == ("a", "b", "rewozamann")
    assert parse_name("Gaitipairsen-Kozuvington, O.", lex) == ("o", "", "gaitipairsenkozuvington")
    assert parse_name("Petra T.", lex) == ("petra", "", "t")
    assert address("Ann.Lee+x@Corp.example") == ("ann.lee", "corp.example") and address("none@none") == ("", "")
