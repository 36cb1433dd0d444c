"""Variant spellings of names typed by people: which pairs of name and address stand for the same person or team.

1. Distinct pairs are read into given name, middle initials and surname, or organisation and function of a team, with a
   lexicon of frequent words counted over the table.
2. Segment join: surnames (and organisations) within k edits share one of the k+1 segments of the shorter one at a
   shifted place (pigeonhole). Segments of every distinct word form an inverted index, substrings of every word at the
   shifts that k edits allow look them up, and a banded edit distance verifies. Short words, which are allowed one edit or
   none, are also joined with two neighbouring letters swapped. Given names are joined the same way within one surname, so that a surname which many people share makes no pairs of its own.
3. Each variant word points to the nearest, most frequent word with the same other part, so every pair comes to a canonical
   name. Canonical names that carry different middle initials are split by them.
4. Pairs that share a canonical name, or an address that is its owner's own by the look of it, are connected; connected
   components are found by spreading the smallest key over keys and shared nodes, checkpointed each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .name_parse import TEAM_WORDS, Lexicon, address, fold, of_machine, parse_local, parse_name, parse_team, resembles, words_of

#: Share of pairs, and least number, that hold a word of the lexicon; bounds it by the words a name has over the share.
LEXICON_SHARE, LEXICON_LEAST = 1e-4, 3
#: Least and greatest number of letters of words of which two neighbouring ones may be swapped, as one edit.
SWAPPED = (3, 5)
#: Least number, and share, of all domains under which a two-word local part must occur to name a team's function.
FUNCTION_DOMAINS, FUNCTION_SHARE = 3, 2e-3
_BOTS = r"(?i)\[bot\]|@bots\.|^unknown$"


def word_edits(length: int) -> int:
    """Edits allowed for a word of this length."""
    return 3 if length >= 11 else 2 if length >= 6 else 1 if length >= 4 else 0


def typed_pairs(commits: DataFrame) -> DataFrame:
    """(author_key, author_name, author_email) once each, without bots and unknown authors."""
    rows = commits.select("author_key", "author_name", "author_email").where("author_key IS NOT NULL AND author_name IS NOT NULL").distinct()
    return rows.where(~F.col("author_name").rlike(_BOTS) & ~F.coalesce(F.col("author_email"), F.lit("")).rlike(r"@bots\."))


def lexicon(pairs: DataFrame, forms: DataFrame) -> Lexicon:
    """Given names and function words: frequent first words of names, and two-word local parts used under many domains."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, e in zip(pdf["author_name"], pdf["author_email"], strict=True):
                ws, comma = words_of(n)
                full = [w for w in ws if len(w) > 1 and w != ","]
                if len(full) == 2:
                    out.append((full[1 if comma else 0], "first", ""))
                    out.append((full[0 if comma else 1], "last", ""))
                local, domain = address(e)
                parts = local.replace("-", ".").split(".")
                if len(parts) == 2 and all(len(p) >= 4 and p.isalpha() for p in parts) and not of_machine(domain):
                    out += [(parts[0] + " " + parts[1], "local", domain)]
            yield pd.DataFrame(out, columns=["word", "place", "domain"])

    least = max(LEXICON_LEAST, int(pairs.count() * LEXICON_SHARE))
    seen = cut(pairs.select("author_name", "author_email").mapInPandas(words, "word string, place string, domain string"))
    domains = seen.where("domain != ''").agg(F.countDistinct("domain")).first()[0]
    spread = max(FUNCTION_DOMAINS, int(domains * FUNCTION_SHARE))
    counts = (
        seen.groupBy("word")
        .agg(
            F.count_if(F.col("place") == "first").alias("first"),
            F.count_if(F.col("place") == "last").alias("last"),
            F.countDistinct(F.when(F.col("place") == "local", F.col("domain"))).alias("domains"),
        )
        .where((F.col("first") >= least) | (F.col("domains") >= spread))
        .collect()  # at most 2 / LEXICON_SHARE words, and the addresses of a domain / FUNCTION_SHARE local parts
    )
    known = {fold(x) for r in forms.collect() for x in r if x}  # name_forms is a list that doesn't grow
    given = {r["word"] for r in counts if r["first"] >= least and r["first"] > 2 * r["last"]} | known
    pairs_of = [r["word"].split(" ") for r in counts if r["domains"] >= spread]
    functions = TEAM_WORDS | {w for ws in pairs_of if not (set(ws) & given) for w in ws}
    return Lexicon(given - functions, functions)


def read_pairs(pairs: DataFrame, lex: Lexicon) -> DataFrame:
    """(author_key, kind, given, middle, surname, mail, mail_given, mail_surname): kind 'team' has its organisation as surname
    and its function as given; mail is an address that is its owner's own, else null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, n, e in zip(pdf["author_key"], pdf["author_name"], pdf["author_email"], strict=True):
                local, domain = address(e)
                if team := parse_team(n, local, domain, lex):
                    out.append((k, "team", team[1], "", team[0], None, "", ""))
                    continue
                given, middle, surname = parse_name(n, lex)
                own = bool(local) and resembles(n, given, surname, local, domain, lex)
                mg, ms = parse_local(local, domain, lex) if own else ("", "")
                out.append((k, "person", given, middle, surname, f"{local}@{domain}" if own else None, mg, ms))
            yield pd.DataFrame(out, columns=["author_key", "kind", "given", "middle", "surname", "mail", "mail_given", "mail_surname"])

    return pairs.mapInPandas(
        read, "author_key bigint, kind string, given string, middle string, surname string, mail string, mail_given string, mail_surname string"
    )


def _cuts(n: int, k: int) -> list[tuple[int, int]]:
    """(place, length) of the k+1 segments of a word of n letters, even in length, the longer ones last."""
    short, longer = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = short + (i >= k + 1 - longer)
        out.append((at, size))
        at += size
    return out


def index_entries(word: str) -> Iterator[tuple[int, int, int, str]]:
    """(k, n, i, segment): the segments by which words of other spellings find this one, for every number of edits."""
    for k in (1, 2, 3):
        for i, (at, size) in enumerate(_cuts(len(word), k)):
            if size:
                yield k, len(word), i, word[at : at + size]


def probe_entries(word: str) -> Iterator[tuple[int, int, int, str]]:
    """(k, n, i, substring): what a word within k edits and no longer than this one may have as segment i.

    Of a segment of a word shorter by d, only starts within i edits to the left and k - i after it can take part in an
    alignment that keeps the segment.
    """
    k, m = word_edits(len(word)), len(word)
    for d in range(min(k, m - 1) + 1) if k else ():
        for i, (place, size) in enumerate(_cuts(m - d, k)):
            for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                at = place + shift
                if size and at >= 0 and at + size <= m:
                    yield k, m - d, i, word[at : at + size]


def _entries(words: DataFrame, word: str, within: list[str], name: str, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*(r[c] for c in within), r[word], *e) for r in pdf.to_dict("records") for e in set(make(r[word]))]
            yield pd.DataFrame(rows, columns=[*within, name, "k", "n", "i", "seg"])

    kinds = "".join(f"{c} string, " for c in within)
    return words.select(*within, word).mapInPandas(run, f"{kinds}{name} string, k int, n int, i int, seg string")


def segment_join(words: DataFrame, word: str, within: list[str] | None = None) -> DataFrame:
    """(within..., a, b, dist): all pairs of distinct words, in either order, within the edits that the longer one allows.

    `words` has one row for each (within..., word); pairs are made only where the columns `within` agree.
    """
    within = within or []
    probe = _entries(words, word, within, "a", probe_entries)
    index = _entries(words, word, within, "b", index_entries)
    cand = probe.join(index, [*within, "k", "n", "i", "seg"]).where("a != b").select(*within, "a", "b", "k").distinct()
    dist = F.when(F.col("k") == 1, F.levenshtein("a", "b", 1)).when(F.col("k") == 2, F.levenshtein("a", "b", 2)).otherwise(F.levenshtein("a", "b", 3))
    found = cand.withColumn("dist", dist).where("dist >= 0")
    turn = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = found.select(*within, turn.alias("_p"), "dist").select(*within, "_p.a", "_p.b", "dist")
    return cut(both.groupBy(*within, "a", "b").agg(F.min("dist").alias("dist")))


def swap_join(words: DataFrame, word: str, within: list[str]) -> DataFrame:
    """(within..., a, b, dist): all pairs of distinct words of SWAPPED letters that differ by two neighbouring letters swapped,
    in either order; this counts as one edit. Longer words allow the two plain edits that it takes."""
    turned = "transform(sequence(1, length(a) - 1), i -> concat(substr(a, 1, i - 1), substr(a, i + 1, 1), substr(a, i, 1), substr(a, i + 2)))"
    short = words.where(F.length(word).between(*SWAPPED)).select(*within, F.col(word).alias("a"))
    forms = short.select(*within, "a", F.explode(F.array_distinct(F.expr(turned))).alias("b")).where("a != b")
    return forms.join(short.withColumnRenamed("a", "b"), [*within, "b"]).select(*within, "a", "b", F.lit(1).alias("dist"))


def near_words(words: DataFrame, word: str, within: list[str] | None = None) -> DataFrame:
    """(within..., a, b, dist): segment_join and swap_join of the same words, with the smaller distance."""
    within = within or []
    both = segment_join(words, word, within).unionByName(swap_join(words, word, within))
    return cut(both.groupBy(*within, "a", "b").agg(F.min("dist").alias("dist")))


def _nearest(cand: DataFrame, source: list[str], target: list[str]) -> DataFrame:
    """The row of the nearest, most frequent target for each source; `even` says that another one is as near."""
    w = Window.partitionBy(*source)
    ranked = cand.withColumn("_r", F.row_number().over(w.orderBy("dist", F.col("n_b").desc(), *target))).withColumn(
        "even", F.count_if(F.col("dist") == F.min("dist").over(w)).over(w) > 1
    )
    return ranked.where("_r = 1").drop("_r")


def canonical_names(people: DataFrame, forms: DataFrame, lex: Lexicon) -> DataFrame:
    """(kind, given, surname, to_given, to_surname): for each name with both parts, the name it is a variant of or itself."""
    names = cut(people.where("length(given) > 1 AND length(surname) > 1").groupBy("kind", "given", "surname").agg(F.count("*").alias("n")))
    # surname: the same given name with a surname within some edits that is more frequent
    near = near_words(names.select("surname").distinct(), "surname")
    n_b = names.select("kind", "given", F.col("surname").alias("b"), F.col("n").alias("n_b"))
    freq = names.groupBy("surname").agg(F.sum("n").alias("s"))
    alt = forms.select(F.col("a").alias("given"), F.col("b").alias("g_b")).unionByName(names.select("given", F.col("given").alias("g_b"))).distinct()
    s_cand = (
        names.join(near.withColumnRenamed("a", "surname"), "surname")
        .join(alt, "given")
        .join(n_b.withColumnRenamed("given", "g_b"), ["kind", "g_b", "b"])
        .join(freq, "surname")
        .join(freq.select(F.col("surname").alias("b"), F.col("s").alias("s_b")), "b")
        .where((F.col("n_b") > F.col("n")) | ((F.col("n_b") == F.col("n")) & ((F.col("s_b") > F.col("s")) | ((F.col("s_b") == F.col("s")) & (F.col("b") < F.col("surname"))))))
        .select("kind", "given", "surname", "g_b", "b", "dist", "n_b")
    )
    s_map = _nearest(cut(s_cand), ["kind", "given", "surname"], ["b", "g_b"]).select("kind", "given", "surname", F.col("g_b").alias("via"), F.col("b").alias("sur"))
    step = cut(names.join(s_map, ["kind", "given", "surname"], "left").withColumn("via", F.coalesce("via", "given")).withColumn("sur", F.coalesce("sur", "surname")))
    # a variant of a variant goes where that one goes, with the form of the given name that led there; every pointer leads to
    # a more frequent name, so they end, and each round doubles the steps
    moved = True
    while moved:
        then = step.select("kind", F.col("given").alias("via"), F.col("surname").alias("sur"), F.col("via").alias("via2"), F.col("sur").alias("sur2"))
        further = step.join(then, ["kind", "via", "sur"], "left").withColumn("moved", F.coalesce(F.col("sur2") != F.col("sur"), F.lit(False)))
        further = cut(further.select("kind", "given", "surname", "n", F.coalesce("via2", "via").alias("via"), F.coalesce("sur2", "sur").alias("sur"), "moved"))
        moved = further.where("moved").limit(1).count() > 0
        step = further.drop("moved")
    # given name: within one surname, forms of one name or within some edits
    g = cut(step.where("kind = 'person'").groupBy(F.col("sur").alias("surname"), "given").agg(F.sum("n").alias("n")))
    g_near = near_words(g.select("surname", "given"), "given", ["surname"])
    pair = forms.select("a", "b").distinct()
    g_b = g.select("surname", F.col("given").alias("b"), F.col("n").alias("n_b"))
    short = g.join(pair.withColumnRenamed("a", "given"), "given").join(g_b, ["surname", "b"]).select("surname", "given", "b", F.lit(0).alias("dist"), "n_b")
    real = people.sparkSession.createDataFrame([(g,) for g in sorted(lex.given)], "given string")
    real = real.unionByName(forms.select(F.col("a").alias("given"))).unionByName(forms.select(F.col("b").alias("given"))).distinct()
    typo = (
        g.join(g_near.withColumnRenamed("a", "given"), ["surname", "given"])
        .join(g_b, ["surname", "b"])
        .where((F.col("n_b") > F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("b") < F.col("given"))))
        .join(real, "given", "left_anti")
        .select("surname", "given", "b", F.col("dist").cast("int").alias("dist"), "n_b")
    )
    # a name cut short: every longer name of the surname looks it up by its own beginnings, so only true ones meet
    heads = g_b.where("length(b) > 3").select("surname", "b", "n_b", F.explode(F.sequence(F.lit(3), F.length("b") - 1)).alias("k"))
    prefix = (
        heads.select("surname", F.expr("substr(b, 1, k)").alias("given"), "b", "n_b")
        .join(g.select("surname", "given").join(real, "given", "left_anti"), ["surname", "given"])
        .select("surname", "given", "b", F.lit(0).alias("dist"), "n_b")
    )
    g_map = _nearest(cut(short.unionByName(typo).unionByName(prefix).distinct()), ["surname", "given"], ["b"])
    g_map = g_map.where("NOT even").select(F.col("surname").alias("sur"), "given", F.col("b").alias("to_given"))
    out = step.join(g_map, ["sur", "given"], "left")
    return out.select("kind", "given", "surname", F.when(F.col("kind") == "person", F.coalesce("to_given", "given")).otherwise(F.col("given")).alias("to_given"), F.col("sur").alias("to_surname"))


def nodes(pairs: DataFrame, forms: DataFrame, lex: Lexicon) -> DataFrame:
    """(author_key, node): what each pair may share with others: a canonical name, or an address of its own."""
    read = cut(read_pairs(pairs, lex))
    # a name without both parts takes them from its own address
    whole = (F.length("given") > 1) & (F.length("surname") > 1)
    from_mail = (F.length("mail_given") > 1) & (F.length("mail_surname") > 1)
    full = read.withColumn("g", F.when(whole | ~from_mail, F.col("given")).otherwise(F.col("mail_given"))).withColumn(
        "s", F.when(whole | ~from_mail, F.col("surname")).otherwise(F.col("mail_surname"))
    )
    full = full.withColumn("s", F.when((F.length("s") >= 4) & (F.length("mail_surname") > F.length("s")) & (F.col("mail_surname").startswith(F.col("s")) | F.col("mail_surname").endswith(F.col("s"))), F.col("mail_surname")).otherwise(F.col("s")))
    full = cut(full.select("author_key", "kind", F.col("g").alias("given"), "middle", F.col("s").alias("surname"), "mail", "mail_given", "mail_surname"))
    to = cut(canonical_names(full.unionByName(full.where(whole & from_mail).select("author_key", "kind", F.col("mail_given").alias("given"), "middle", F.col("mail_surname").alias("surname"), "mail", "mail_given", "mail_surname")).where("kind = 'person'").unionByName(_team_names(full)), forms, lex))
    named = cut(full.join(to, ["kind", "given", "surname"], "left"))
    person = named.where("kind = 'person'")
    name = ["to_given", "to_surname"]
    middles = (
        person.where("to_given IS NOT NULL AND middle != ''").groupBy(*name).agg(F.countDistinct(F.substring("middle", 1, 1)).alias("n_middles"))
    )
    split = cut(person.where("to_given IS NOT NULL").join(middles, name, "left"))
    by_name = split.where("coalesce(n_middles, 0) < 2 OR middle != ''").select(
        "author_key",
        F.concat_ws("|", F.lit("n"), "to_given", "to_surname", F.when(F.col("n_middles") > 1, F.substring("middle", 1, 1)).otherwise("")).alias("node"),
    )
    # an initial instead of a given name: the only canonical name with that initial and surname
    only = (
        to.where("kind = 'person'")
        .join(middles, name, "left")
        .where("coalesce(n_middles, 0) < 2")
        .groupBy("to_surname", F.substring("to_given", 1, 1).alias("g1"))
        .agg(F.countDistinct("to_given").alias("c"), F.min("to_given").alias("the"))
        .where("c = 1")
    )
    only = cut(only)
    sur = to.where("kind = 'person'").groupBy("surname").agg(F.countDistinct("to_surname").alias("c"), F.min("to_surname").alias("to_s")).where("c = 1").drop("c")
    lone = person.where("to_given IS NULL").select(
        "author_key",
        F.when(F.length("surname") > 1, F.col("surname")).otherwise(F.col("mail_surname")).alias("surname"),
        F.substring(F.when(F.length("given") >= 1, F.col("given")).otherwise(F.col("mail_given")), 1, 1).alias("g1"),
    )
    by_initial = (
        lone.where("length(surname) > 1 AND g1 != ''")
        .join(sur, "surname")
        .join(only, (F.col("to_s") == F.col("to_surname")) & (lone["g1"] == only["g1"]))
        .select("author_key", F.concat_ws("|", F.lit("n"), "the", "to_s", F.lit("")).alias("node"))
    )
    by_mail = person.where("mail IS NOT NULL").select("author_key", F.concat_ws("|", F.lit("m"), "mail").alias("node"))
    team = named.where("kind = 'team'").select(
        "author_key", F.concat_ws("|", F.lit("t"), F.coalesce("to_given", "given"), F.coalesce("to_surname", "surname")).alias("node")
    )
    # an address that runs the canonical name together
    run = split.where("coalesce(n_middles, 0) < 2").select("author_key", F.concat("to_given", "to_surname").alias("run"))
    joined = person.where("mail IS NOT NULL").select("author_key", F.regexp_replace(F.substring_index("mail", "@", 1), "[^a-z]", "").alias("run"))
    # and a name whose parts stand the other way round, where no lexicon tells
    turned = split.select("author_key", F.concat("to_surname", "to_given").alias("run"))
    joined = joined.unionByName(turned)
    by_run = joined.where("length(run) >= 9").join(run.select("run").distinct(), "run").unionByName(run.select("run", "author_key"))
    by_run = by_run.select("author_key", F.concat_ws("|", F.lit("r"), "run").alias("node"))
    return by_name.unionByName(by_run).unionByName(by_initial).unionByName(by_mail).unionByName(team).distinct()


def _team_names(full: DataFrame) -> DataFrame:
    return full.where("kind = 'team' AND length(surname) > 1")


def components(links: DataFrame, rounds: int = 30) -> DataFrame:
    """(author_key, label): the smallest key of the component of each key, spread over shared nodes."""
    links = cut(links)
    labels = links.select("author_key").distinct().withColumn("label", F.col("author_key"))
    for _ in range(rounds):
        at_node = links.join(labels, "author_key").groupBy("node").agg(F.min("label").alias("label"))
        at_key = links.join(at_node, "node").groupBy("author_key").agg(F.min("label").alias("new"))
        # the label of the label's own key, so that long chains shorten by half each round
        jump = at_key.select(F.col("author_key").alias("new"), F.col("new").alias("further"))
        nxt = cut(at_key.join(jump, "new").join(labels, "author_key").select("author_key", F.least("new", "further").alias("label"), (F.least("new", "further") < F.col("label")).alias("moved")))
        labels = nxt.select("author_key", "label")
        if not nxt.where("moved").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def learned_forms(pairs: DataFrame, forms: DataFrame, lex: Lexicon) -> DataFrame:
    """(a, b): a is a form of the given name b, from the list and from addresses that spell another given name.

    A form is learned where a person's name and own address have one surname and two given names, for two surnames or more.
    """
    listed = forms.select(F.lower("short_form").alias("a"), F.lower("full_form").alias("b"))
    listed = listed.select(*[plain_of(c).alias(c) for c in ("a", "b")]).where("a IS NOT NULL AND b IS NOT NULL")
    read = read_pairs(pairs, lex).where("kind = 'person' AND length(given) > 2 AND length(mail_given) > 2 AND given != mail_given AND surname = mail_surname")
    learned = (
        read.where(F.levenshtein("given", "mail_given") > 2)
        .groupBy(F.col("given").alias("a"), F.col("mail_given").alias("b"))
        .agg(F.countDistinct("surname").alias("c"))
        .where("c >= 2")
        .select("a", "b")
    )
    one = listed.unionByName(learned).distinct()
    return cut(one)


def plain_of(c: str) -> Column:
    return F.translate(F.col(c), "áàâäãåéèêëíìîïóòôöõúùûüñçłżźśćńøž", "aaaaaaeeeeiiiiooooouuuunclzzscnoz")


def same_authors(commits: DataFrame, forms: DataFrame) -> DataFrame:
    """(author_key, label): keys of the same person or team share the label, the smallest of them.

    Null names are no cases; null or placeholder addresses say nothing. Repeated rows count once. Empty tables give no rows.
    """
    pairs = cut(typed_pairs(commits))
    lex = lexicon(pairs, forms.select("short_form", "full_form"))
    return components(nodes(pairs, learned_forms(pairs, forms, lex), lex))


def author_pairs(labels: DataFrame) -> DataFrame:
    """(author_key_a, author_key_b) for all pairs of keys of one person or team."""
    a = labels.select("label", F.col("author_key").alias("author_key_a"))
    b = labels.select("label", F.col("author_key").alias("author_key_b"))
    return a.join(b, "label").where("author_key_a < author_key_b").select("author_key_a", "author_key_b")
