import random
import time

import pytest
from tokenizers import Tokenizer

from graphdrift.llm import bpe
from graphdrift.llm.packing import items_of, pack_documents, pack_sizes, plan_patterns

DOC = "doc_id bigint, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


CASES = [
    "", " ", "a" * 3000, " " * 50 + "x", "\n\n  a   b\x1c\x1c !\x1c", "<|endoftext|>", "　　あ", "it's 'S ''' I'll", "a\r\n\r\nb", "१२३½²", "-" * 777,
    "\t\tfoo\t bar ", "abab" * 300, "\x85a\x85\xa0 b", "🎉🎉👩‍👩‍👧", "x" * 20 + "\x00\x7f" + "é" * 99, "漢字かな交じり文" * 40,
]


def test_ids_equal_the_public_tokenizer(spark, reference):
    rng = random.Random(7)
    letters = " \n\t\xa0 ab'sLl1½²!-\x1c\x1f\x85é中́‍　🎉"
    texts = CASES + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id", "", 1), (5, "again", "", 1), (5, "again", "", 1)]
    got = bpe.encode_texts(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((i is None, i or 0, reference(t or "")) for i, t, *_ in rows)


def test_very_long_words(reference):
    """Words of many letters without a blank, in rounds that contract many ranks at once, and in a second or so."""
    rng = random.Random(11)
    enc = bpe.Encoder(bpe.default_path())
    parts = "gene rate pars tion graph edge modul depend ing".split()
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(30_000)), "".join(rng.choice(parts) for _ in range(8_000)), "a" * 20_001, "aab" * 5_000, "ß" * 3_001]
    begun = time.time()
    assert enc.contract([w.encode() for w in words]) == [reference(w) for w in words]
    assert time.time() - begun < 20


def test_contraction_of_runs(reference):
    """Equal ranks side by side, cut by pairs of lower and higher rank."""
    rng = random.Random(12)
    enc = bpe.Encoder(bpe.default_path())
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for letters in ("aab", "ee", "lls", "oot", "ssst", "nne") for _ in range(400)]
    assert enc.contract([w.encode() for w in words]) == [reference(w) for w in words]


def test_empty_table(spark):
    assert bpe.encode_texts(spark.createDataFrame([], DOC)).collect() == []
    assert pack_documents(spark.createDataFrame([], DOC)).collect() == []


def test_memory_of_segments_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MAX_SEGMENTS", 5)
    enc = bpe.Encoder(bpe.default_path())
    for t in ["one two three four five six seven", "one two", "eight nine"]:
        off, ids = enc.encode([t, None])
        assert ids[off[0] : off[1]].tolist() == reference(t) and off[1] == off[2]


def test_plan_numbers_containers_without_gaps_and_fits():
    rng = random.Random(2)
    for cap in (1, 7, 64, 2048):
        counts = {s: rng.randrange(1, 50) for s in range(1, cap + 1) if rng.random() < 0.3 or s == cap}
        load, items = {}, 0
        rows = sorted(plan_patterns(counts, cap))
        for s, n in counts.items():
            own = [r for r in rows if r[0] == s]
            for rank in range(n):
                r = max((x for x in own if x[1] <= rank), key=lambda x: x[1])
                box = r[2] + (rank - r[1]) // r[3]
                load[box] = load.get(box, 0) + s
                items += 1
        assert max(load.values()) <= cap and set(load) == set(range(len(load))) and items == sum(counts.values())
        total = sum(s * n for s, n in counts.items())
        least = max(-(-total // cap), sum(n for s, n in counts.items() if 2 * s > cap))  # no packing needs fewer
        assert len(load) <= 1.12 * least + 1


def test_every_item_is_placed_once(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 1, 3, 40, 99, 100, 101, 250, 1000])) for i in range(500)] + [(7, 5)] * 200
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").repartition(5)
    out = pack_sizes(df, 100).collect()
    load, seen = {}, {}
    for r in out:
        assert (r["container_id"] is None) == (r["n_tokens"] == 0) and r["n_tokens"] <= 100
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["n_tokens"]
        if r["container_id"] is not None:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    want = {}
    for i, n in sizes:
        want[i] = want.get(i, 0) + n
    assert seen == want and max(load.values()) <= 100 and set(load) == set(range(len(load)))
    assert len(load) <= -(-sum(want.values()) // 100) * 1.03 + 1


def test_only_long_documents_are_cut(spark):
    df = spark.createDataFrame([(1, 0), (2, 100), (3, 101), (4, 250)], "doc_id bigint, n_tokens bigint")
    got = sorted(tuple(r) for r in items_of(df, 100).collect())
    assert got == [(1, 0, 0, 0), (2, 0, 0, 100), (3, 0, 0, 100), (3, 1, 100, 1), (4, 0, 0, 100), (4, 1, 100, 100), (4, 2, 200, 50)]
