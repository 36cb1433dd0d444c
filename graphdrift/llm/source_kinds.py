"""Generated, minified, third-party and data files among source files.

1. Third-party copies: an inverted index of line hashes over distinct bodies. A published file is a file's source if half of
   the file's lines are in it, some of them lines that at most RARE_LIBS libraries have. Among repositories, each line that
   two bodies or more hold keeps its first and its last holder in the order of repositories. The holder in another repository
   that most of a file's lines name, weighed by rarity, is its candidate; containment in that file is counted exactly. This
   settles most copies without forming pairs. Of the other files, those with enough lines that other repositories hold at all
   meet all holders of so many of their rarest shared lines that a file which contains them must be among these.
2. All other files are judged by the composition of their own text: white space and identifier lengths, share of digits, and
   how far lines repeat one template; marks of tools and banners of published files in the leading comment count in the
   forms that are common usage.

Bodies are read once, by one Arrow pass that judges them and hashes their lines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import file_path
from ..plans.runtime import cut, lookup

#: Lines shorter than this are no evidence of copying.
MIN_LINE = 12
#: Least share of a file's lines found in one published file.
UPSTREAM_CONTAINED = 0.5
#: Least share found in one file of another repository, and lines a file needs for that; shorter ones must be equal as a whole.
CROSS_CONTAINED, CROSS_LINES = 0.8, 10
#: Share of lines that repeat one template from which a text is no hand-written one.
REPEATED = 0.75
#: Libraries that may share a line that still identifies one of them.
RARE_LIBS = 2

_LEAD = re.compile(r"\s*(//|#|/\*|\*|<!--|--|;|%|\"\"\"|''')")
# The public conventions by which tools mark their output, as a line of the leading comment.
_MARKED = re.compile(r"^\W*code generated .*\bdo not edit\b\W*$|^\W*@generated\b|<auto-?generated\b", re.I)
# The forms of the banner that a published file carries: whose authors' copyright, library and release, or where
# it was copied from and at which state. A copyright alone names no third party.
_BANNER = re.compile(
    r"(?:\(c\)|©|copyright)[\d\s,(c)-]*[\w.-]+ (?:project|authors|contributors|developers|foundation)\b|^\W*[\w.@/-]+ v?\d+(?:\.\d+)+ \W*\(c\)"
    r"|^\W*/\*! ?[\w.-]+ v?\d+\.\d+|\b(?:vendored|copied|taken)(?: verbatim)? from \S+ at [0-9a-f.v]+\b",
    re.I,
)
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_BLOB = re.compile(r"[A-Za-z0-9+/=]{40,}")


def leading_comment(lines: list[str]) -> str:
    """The comment lines before the first line of code; lines of a block comment count whatever they begin with."""
    out, block = [], False
    for line in lines:
        s = line.strip()
        if not s or block or _LEAD.match(s) or s.startswith("#!"):
            out.append(s)
            # a comment to the end of its line opens no block: "# see src/*"
            if block or s.startswith(("/*", "*")):
                block = s.rfind("/*") > s.rfind("*/") or (block and "*/" not in s)
        else:
            break
    return "\n".join(out)


def repetition(shapes: list[str], longest: int = 12) -> float:
    """Greatest share of lines whose shape recurs `p` lines later, over p up to `longest`."""
    n = len(shapes)
    if n < 12:
        return 0.0
    return max(sum(a == b for a, b in zip(shapes, shapes[p:], strict=False)) / (n - p) for p in range(1, min(longest, n // 3) + 1))


def composition(body: str) -> str | None:
    """'generated', 'minified', 'data' or 'third_party' by the text alone, or None for what looks hand-written."""
    lines = re.split(r"\r\n|\r|\n", body)
    lead = leading_comment(lines).split("\n")
    if any(_MARKED.search(x) for x in lead):
        return "generated"
    code = [s for x in lines if (s := x.strip()) and not _LEAD.match(s)]
    text = "\n".join(code)
    if len(text) >= 200:
        words = _WORD.findall(_STRING.sub('""', text))
        blank = sum(map(len, re.findall(r"\s+", "\n".join(x for x in lines if x.strip() and not _LEAD.match(x))))) / len(text)
        blob = sum(map(len, _BLOB.findall(text))) / len(text)
        digits = sum(map(len, _NUMBER.findall(_WORD.sub(lambda m: m.group(0) if m.group(0)[0] in "xX" else "", text)))) / len(text)
        mean = sum(map(len, words)) / max(1, len(words))
        if blob > 0.5:
            return "data"
        if digits > 0.28:
            return "data"
        if blank < 0.1 and mean < 4.5 and len(text) / len(code) > 80:
            return "minified"
    if any(_BANNER.search(x) for x in lead):
        return "third_party"
    shapes = [_WORD.sub("a", _NUMBER.sub("0", _STRING.sub('"', s))) for s in code]
    if repetition(shapes) >= REPEATED:
        literal = sum(1 for s in shapes if re.fullmatch(r"[\[\]{}()a:=,0\"\s.+-]*[,\]})]", s) and "a(" not in s and ("\"" in s or "0" in s))
        return "data" if literal > 0.6 * len(shapes) else "generated"
    return None


def line_hashes(body: str) -> list[int]:
    """The distinct hashes of the lines of MIN_LINE characters or more, white space evened out, in ascending order."""
    even = {" ".join(x.split()) for x in re.split(r"\r\n|\r|\n", body)}
    return sorted(xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in even if len(x) >= MIN_LINE)


def read_bodies(files: DataFrame, key: str, judged: bool = True) -> DataFrame:
    """(key, label, sha, own, lines) of rows (key, label, body): what the body's composition says, its line hashes, and the digest
    of these. A null body reads as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[str | None, list[int], bytes]] = {}
        for b in batches:
            if len(known) > 20_000:
                known.clear()
            shas, kinds, lines = [], [], []
            for t in b.column(2).to_pylist():
                body = hashlib.blake2b((t or "").encode("utf-8", "replace"), digest_size=16).digest()
                if body not in known:
                    hs = line_hashes(t or "")
                    known[body] = composition(t) if t and judged else None, hs, hashlib.blake2b(str(hs).encode(), digest_size=16).digest()
                for out, x in zip((kinds, lines, shas), known[body], strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(shas, pa.binary()), pa.array(kinds, pa.string()), pa.array(lines, pa.list_(pa.int64()))],
                ["key", "label", "sha", "own", "lines"],
            )

    rows = files.select(F.col(key).cast("bigint").alias("key"), F.col("label").cast("string"), F.col("body").cast("string"))
    return rows.mapInArrow(run, "key bigint, label string, sha binary, own string, lines array<bigint>")


def in_published(lines: DataFrame, n: DataFrame, upstream: DataFrame) -> DataFrame:
    """(sha, in_upstream): the greatest share of a body's lines in one published file with which it shares a line that at most
    RARE_LIBS libraries have."""
    read = cut(read_bodies(upstream.select("upstream_id", F.col("lib_name").alias("label"), "body"), "upstream_id", judged=False))
    libs = read.select("key", "label", F.explode("lines").alias("h"))
    few = libs.groupBy("h").agg((F.countDistinct("label") <= RARE_LIBS).cast("int").alias("tells"))
    index = cut(libs.select(F.col("key").alias("upstream_id"), "h").join(few, "h"))
    shared = lines.join(lookup(index), "h").groupBy("sha", "upstream_id").agg(F.count("*").alias("k"), F.sum("tells").alias("tells"))
    best = shared.where("tells > 0").groupBy("sha").agg(F.max("k").alias("k"))
    return best.join(n, "sha").select("sha", (F.col("k") / F.col("n")).alias("in_upstream"))


def in_other_repositories(bodies: DataFrame, lines: DataFrame) -> DataFrame:
    """(sha, in_others): of bodies with one repository and CROSS_LINES lines or more, the greatest share of their lines in one file
    of another repository. Where no file reaches CROSS_CONTAINED, the share may be that of any file, or be missing.

    A line that many bodies hold counts less for the choice of the first candidate, but fully for the share.
    """
    # numbers in the order of repositories, so that the least and the greatest holder of a line differ in theirs if any do
    ends = bodies.select("sha", F.explode(F.array_distinct(F.array("r0", "r1"))).alias("repo"))
    ordered = ends.repartitionByRange("repo").sortWithinPartitions("repo", "sha")
    holders = cut(ordered.withColumn("no", F.monotonically_increasing_id()))
    postings = (
        lines.join(holders.select("sha", "no"), "sha")
        .groupBy("h")
        .agg(F.min("no").alias("first"), F.max("no").alias("last"), F.count("*").alias("df"))
        .where("first != last")
    )
    postings = cut(postings)
    spans = holders.groupBy("repo").agg(F.min("no").alias("low"), F.max("no").alias("high"))
    asking = bodies.where((F.col("r0") == F.col("r1")) & (F.col("n") >= CROSS_LINES)).select("sha", F.col("r0").alias("repo"), "n")
    asking = cut(asking.join(spans, "repo"))
    # the lines of each asking body that another repository holds; numbers outside a repository's span are of others
    outside = (F.col("first") < F.col("low")) | (F.col("last") > F.col("high"))
    each = cut(lines.join(lookup(postings), "h").join(asking.select("sha", "n", "low", "high"), "sha").where(outside))
    named = (
        each.select("sha", F.explode(F.array("first", "last")).alias("other"), "low", "high", (1.0 / F.log2(F.col("df") + 1.0)).alias("weight"))
        .where("other < low OR other > high")
        .groupBy("sha", "other")
        .agg(F.sum("weight").alias("weight"))
    )
    names = holders.select(F.col("no").alias("other"), F.col("sha").alias("other_sha"))
    best = named.join(names, "other").groupBy("sha").agg(F.max_by("other_sha", F.struct("weight", "other")).alias("other_sha"))
    quick = cut(_contained(best, bodies))
    # A container shares `need` of the k lines that others hold, so any k - need + 1 of these have one of its own among them.
    need = F.ceil(F.col("n") * F.lit(CROSS_CONTAINED) - 1e-9)
    left = each.join(quick.where(F.col("in_others") >= CROSS_CONTAINED), "sha", "left_anti")
    k = left.groupBy("sha").agg(F.count("*").alias("k"), F.first("n").alias("n")).select("sha", (F.col("k") - need + 1).alias("probes")).where("probes > 0")
    rarest = Window.partitionBy("sha").orderBy("df", "h")
    probes = left.join(k, "sha").withColumn("r", F.row_number().over(rarest)).where("r <= probes").select("sha", "h", "low", "high")
    held = lines.join(holders, "sha").select("h", F.col("sha").alias("other_sha"), "no")
    pairs = probes.join(held, "h").where("no < low OR no > high").select("sha", "other_sha").distinct()
    return quick.unionByName(_contained(pairs, bodies)).groupBy("sha").agg(F.max("in_others").alias("in_others"))


def _contained(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(sha, in_others): the share of the lines of `sha` that are in `other_sha`, for each pair."""
    of = bodies.select(F.col("sha").alias("other_sha"), F.col("lines").alias("other_lines"))
    both = pairs.join(bodies.select("sha", "lines", "n"), "sha").join(of, "other_sha")
    return both.select("sha", (F.size(F.array_intersect("lines", "other_lines")) / F.col("n")).alias("in_others"))


def file_kinds(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, kind): 'third_party', 'generated', 'minified', 'data' or 'hand_written' for every row of files.

    A null or empty body is 'hand_written': a name alone proves nothing. A null repository is one of its own. Of candidates
    with equal weight the last one counts. Repeated rows stay; extra columns are ignored. Empty tables give no rows.
    """
    read = cut(read_bodies(files.select("file_id", F.coalesce("repo_id", F.lit("")).alias("label"), "body"), "file_id"))
    bodies = read.groupBy("sha").agg(F.first("lines").alias("lines"), F.min("label").alias("r0"), F.max("label").alias("r1"))
    bodies = cut(bodies.withColumn("n", F.size("lines")).where("n > 0"))
    lines = bodies.select("sha", F.explode("lines").alias("h"))
    published = in_published(lines, bodies.select("sha", "n"), upstream).where(F.col("in_upstream") >= UPSTREAM_CONTAINED)
    others = in_other_repositories(bodies, lines).where(F.col("in_others") >= CROSS_CONTAINED)
    copied = published.select("sha").unionByName(others.select("sha")).unionByName(bodies.where("r0 != r1").select("sha"))
    kind = F.when(F.col("copied"), "third_party").otherwise(F.coalesce("own", F.lit("hand_written")))
    marked = read.select("key", "own", "sha").join(copied.distinct().withColumn("copied", F.lit(True)), "sha", "left")
    return marked.select(F.col("key").alias("file_id"), kind.alias("kind"))


def named_files(edges: DataFrame) -> DataFrame:
    """(repo_id, file_path): the files that edges and their sample origins name, once each."""
    paths = F.array_union(F.array("file_path"), F.coalesce(F.col("sample_origins.file_path"), F.array().cast("array<string>")))
    each = edges.select("repo_id", F.explode(F.array_distinct(paths)).alias("p"))
    return each.select("repo_id", file_path(F.col("p")).alias("file_path")).where("file_path IS NOT NULL AND file_path != ''").distinct()


def hand_written(edges: DataFrame, files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, repo_id, file_path): the files named by edges or their origins that people write."""
    kept = file_kinds(files, upstream).where("kind = 'hand_written'").join(files.select("file_id", "repo_id", file_path(F.col("file_path")).alias("file_path")), "file_id")
    return kept.join(named_files(edges), ["repo_id", "file_path"], "left_semi").select("file_id", "repo_id", "file_path")
