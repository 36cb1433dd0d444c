"""Encoding of texts with a byte-level BPE vocabulary, by recursive DuckDB queries per partition.

A worker cuts the texts of its partition into segments that begin where white space follows a non-space, a place that no
token of the pre-tokenizer spans, and numbers distinct segments. Only words that occur in distinct segments and are no
token by themselves go to DuckDB: their bytes become token-position rows, and a recursive query joins neighbouring tokens
with the merge table and contracts pairs, leftmost first among equal ranks, until no pair can merge. The minimum-rank pair is
not the only one that a round contracts: if no merge up to rank t makes a token that takes part in another merge up to t, then
the order of these merges matters only where they overlap, so all pairs up to the greatest such t that rank below the pairs
they overlap are contracted at once. That gives the same ids in tens of rounds where single ranks take thousands. Rows are
keyed by word and position, so that only the present state is kept, and a round writes what it changed. An ordered aggregation reads the ids of a word. Texts are then put together from the ids of their segments by
array arithmetic. There is no shuffle; state per worker is bounded by MAX_SEGMENTS and MAX_CHARS.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White_Space of Unicode, as the body of a character class (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct segments that a worker remembers; beyond it, it starts anew.
MAX_SEGMENTS = 400_000
#: Characters after which a worker encodes what it has gathered.
MAX_CHARS = 24_000_000

_CONTRACT = """
WITH RECURSIVE step(w, pos, id) USING KEY (w, pos) AS (
  SELECT w, pos, id FROM start
  UNION
  (WITH tokens AS (
     SELECT w, pos, id, lead(id) OVER (PARTITION BY w ORDER BY pos) AS next FROM recurring.step WHERE id IS NOT NULL AND w IN (SELECT w FROM step)),
   pairs AS (
     SELECT w, pos, id, rank, merged, used FROM tokens LEFT JOIN merges ON l = id AND r = next),
   bounds AS (
     SELECT w, max(rank) AS top FROM (
       SELECT w, rank, min(used) OVER (PARTITION BY w ORDER BY rank) AS first_used FROM (SELECT DISTINCT w, rank, used FROM pairs WHERE rank IS NOT NULL))
     WHERE rank < first_used GROUP BY w),
   near AS (
     SELECT w, pos, id, merged, aim, lag(aim) OVER o AS before, lead(aim) OVER o AS after, row_number() OVER o AS nth
     FROM (SELECT p.*, CASE WHEN rank <= top THEN rank END AS aim FROM pairs p JOIN bounds b ON b.w = p.w)
     WINDOW o AS (PARTITION BY w ORDER BY pos)),
   runs AS (
     SELECT *, max(CASE WHEN aim IS NOT NULL AND before IS DISTINCT FROM aim THEN 2 * nth + CASE WHEN coalesce(before > aim, true) THEN 1 ELSE 0 END END)
       OVER (PARTITION BY w ORDER BY pos) AS run FROM near),
   hits AS (
     SELECT w, pos, id, merged, coalesce(run % 2 = 1 AND (nth - run // 2) % 2 = 0 AND coalesce(after >= aim, true) AND aim IS NOT NULL, false) AS hit FROM runs)
   SELECT w, pos, CASE WHEN hit THEN merged END FROM (SELECT *, lag(hit) OVER (PARTITION BY w ORDER BY pos) AS eaten FROM hits) WHERE hit OR eaten))
SELECT w, list(id ORDER BY pos) AS ids FROM step WHERE id IS NOT NULL GROUP BY w ORDER BY w
"""


def default_path() -> str:
    """Place of the vocabulary file byte_bpe_50k.json of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts by the vocabulary and merges of a byte-level BPE file. Special tokens are plain text."""

    def __init__(self, path: str):
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        special = {t for t in model["vocab"] if any(c not in alphabet for c in t)}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {a + b for a, b in pairs}
        # a word that is one token is looked up directly; only tokens that merges can make, or single bytes, count
        self.whole = {as_bytes(t): i for t, i in vocab.items() if t in made or len(t) == 1}
        self.byte_ids = np.array([self.whole[bytes([b])] for b in range(256)], dtype=np.int32)
        white = WHITE
        self.segments = re.compile(f"[{white}]*[^{white}]+|[{white}]+").findall
        self.words = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{white}\p{{L}}\p{{N}}]+|[{white}]+(?![^{white}])|[{white}]+"
        ).findall
        # nothing is spilled to a folder of the machine
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        used: dict[int, int] = {}  # the first merge that a token takes part in
        for rank, (a, b) in enumerate(pairs):
            used.setdefault(vocab[a], rank)
            used.setdefault(vocab[b], rank)
        merges = pa.table(
            {
                "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
                "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
                "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
                "used": pa.array([used.get(vocab[a + b], len(pairs)) for a, b in pairs], pa.int32()),
            }
        )
        self.db.register("merges_file", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_file")
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = _Numbering()
        self.seg_ids: list[np.ndarray] = []
        self.word_ids: dict[str, list[int]] = {}

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by contraction to a fixpoint in DuckDB. Words aren't empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        rows = int(sizes.sum())
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        table = pa.table(
            {
                "w": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
                "pos": (np.arange(rows) - start).astype(np.int32),
                "id": self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)],
            }
        )
        self.db.register("start", table)
        try:
            return self.db.sql(_CONTRACT).to_arrow_table().column("ids").to_pylist()
        finally:
            self.db.unregister("start")

    def learn(self) -> None:
        """Ids of all segments that were numbered since the last call."""
        new = list(self.codes)[len(self.seg_ids) :]
        if not new:
            return
        cut = [self.words(s) for s in new]
        unknown = []
        for w in {w for ws in cut for w in ws}.difference(self.word_ids):
            if (i := self.whole.get(b := w.encode())) is not None:
                self.word_ids[w] = [i]
            else:
                unknown.append((w, b))
        if unknown:
            for (w, _), ids in zip(unknown, self.contract([b for _, b in unknown]), strict=True):
                self.word_ids[w] = ids
        ids = self.word_ids
        self.seg_ids += [np.array([i for w in ws for i in ids[w]], dtype=np.int32) for ws in cut]

    def number(self, text: str) -> np.ndarray:
        """The numbers of the text's segments."""
        parts = self.segments(text)
        return np.fromiter(map(self.codes.__getitem__, parts), np.int32, len(parts))

    def encode(self, texts: list[str | None], lengths_only: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(offsets, ids) of the texts; a null or empty text has no ids. With lengths_only the ids are left out."""
        if len(self.codes) > MAX_SEGMENTS:
            self.forget()
        numbered = [self.number(t) if t else _NONE for t in texts]
        self.learn()
        seg_len = np.fromiter(map(len, self.seg_ids), np.int64, len(self.seg_ids))
        counts = np.fromiter(map(len, numbered), np.int64, len(numbered))
        codes = np.concatenate(numbered) if numbered else _NONE
        each = seg_len[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        if lengths_only:
            return offsets, None
        flat = np.concatenate([*self.seg_ids, _NONE])
        first = np.concatenate([[0], np.cumsum(seg_len)])[codes]
        at = np.repeat(first - ends[:-1], each) + np.arange(ends[-1])
        return offsets, flat[at]


class _Numbering(dict):
    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


_NONE = np.array([], dtype=np.int32)
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most MAX_CHARS bytes of text, but at least one row."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0), dtype=np.int64)
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > MAX_CHARS:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        if begin < len(sizes):
            yield batch.slice(begin)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every row's whole text.

    Null and empty texts have the empty list; a null id stays null; repeated rows stay repeated; other columns are ignored.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for chunk in _chunks(batches, 1):
            offsets, ids = enc.encode(chunk.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([chunk.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the number of ids that encode_texts gives."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for chunk in _chunks(batches, 1):
            offsets, _ = enc.encode(chunk.column(1).to_pylist(), lengths_only=True)
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(np.diff(offsets), pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint")
