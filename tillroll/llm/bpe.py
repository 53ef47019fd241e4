"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each task splits its texts with the public pattern and collects the pieces it has not
met yet.  A DuckDB database inside the task holds the merge table (left id, right id
-> merged id, which is also the rank).  A recursive query starts from one row per
piece, position and byte token, joins neighbouring rows with the merge table,
contracts the leftmost pair of minimum rank of every piece, and ends when no piece has
a pair left; an ordered aggregation lists the ids.  Decoding joins the ids with the
vocabulary and concatenates the bytes by an ordered aggregation.

Piece encodings are kept in a bounded cache of the Python worker; the decoded bytes of
a piece are kept only where they differ from it, so that a text's decoded bytes are
those of its pieces.

Edge cases: null and empty texts encode to no ids; special-token strings are ordinary
text; repeated rows each get their own (equal) result; an empty table gives an empty
result; input columns named like an output column are replaced; texts are encoded
whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm.arrowtools import append_columns, longs, worker_cache

# Pieces encoded by one recursive query, and the bytes of all of them.
CHUNK_PIECES = 40_000
CHUNK_BYTES = 800_000
# Pieces that a Python worker remembers; beyond it the cache starts anew.
CACHE_PIECES = 600_000
# Text bytes split at once: large enough that a query has many pieces to share its cost.
SLICE_BYTES = 4 << 20
# A piece of more bytes (12 bits hold its places) is contracted by a query of its own.
LONG_BYTES = 2_000

# A row is a token t at byte p of piece w, with the next token n at byte q.  A pair's key puts its rank
# first, then its place, so the least key of a piece is its leftmost pair of minimum rank.  Pieces that
# contract go on with step + 1; the rows of a piece's last step are its result.
ENCODE_SQL = """
WITH RECURSIVE state(w, p, t, q, n, step) AS (
    SELECT w, p, t, lead(p) OVER near, lead(t) OVER near, 0 FROM pieces WINDOW near AS (PARTITION BY w ORDER BY p)
  UNION ALL (
    WITH best AS (
        SELECT s.w, min((m.id::BIGINT << 24) | (s.p << 12) | s.q) AS k
        FROM state s JOIN merges m ON m.pair = (s.t::BIGINT << 20) | s.n GROUP BY s.w),
    placed AS (
        SELECT s.w, s.p, CASE WHEN s.p = ((k >> 12) & 4095) THEN (k >> 24)::INT ELSE s.t END AS t, s.step + 1 AS step
        FROM state s JOIN best USING (w) WHERE s.p <> (k & 4095))
    SELECT w, p, t, lead(p) OVER near, lead(t) OVER near, step FROM placed WINDOW near AS (PARTITION BY w ORDER BY p))
)
SELECT w, list(t ORDER BY p) AS ids FROM state
WHERE (w, step) IN (SELECT w, max(step) FROM state GROUP BY w) GROUP BY w ORDER BY w
"""
# The same contraction keeping one row per piece and position, for very long pieces.
ENCODE_LONG_SQL = """
WITH RECURSIVE state(p, t, n, alive) USING KEY (p) AS (
    SELECT p, t, lead(t) OVER (ORDER BY p), TRUE FROM pieces
  UNION (
    WITH live AS (SELECT p, t, n FROM recurring.state WHERE alive),
    best AS (
        SELECT min((m.id::BIGINT << 32) | l.p) AS k FROM live l JOIN merges m ON m.pair = (l.t::BIGINT << 20) | l.n),
    near AS (
        SELECT p, t, lead(p) OVER w1 AS p1, lead(t, 2) OVER w1 AS n2, lead(p) OVER w1 AS next_p, k
        FROM live, best WHERE k IS NOT NULL WINDOW w1 AS (ORDER BY p)),
    hit AS (SELECT * FROM near WHERE p = (k & 4294967295))
    SELECT p, (k >> 32)::INT, n2, TRUE FROM hit
    UNION ALL SELECT p1, -1, NULL, FALSE FROM hit
    UNION ALL SELECT near.p, near.t, (near.k >> 32)::INT, TRUE FROM near, hit WHERE near.next_p = hit.p)
)
SELECT 0 AS w, list(t ORDER BY p) AS ids FROM state WHERE alive
"""
# Bytes are held as text of the code points 0 to 255, which string_agg can join.
DECODE_SQL = """
SELECT w, string_agg(v.chars, '' ORDER BY i.p) AS chars
FROM ids i JOIN vocabulary v ON v.id = i.t GROUP BY w ORDER BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@dataclass
class Codec:
    """A rank file's merge table and vocabulary in DuckDB, with the pieces met so far."""

    path: str
    pattern: str
    known: dict[str, bytes] = field(default_factory=dict)           # piece -> little-endian 32-bit ids
    # piece -> bytes that its ids decode to, where they are not the piece itself (a faulty rank file)
    odd: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        import duckdb
        import regex

        self.split = regex.compile(self.pattern).findall
        self.ranks = load_ranks(self.path)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        rows = pa.table({"l": pa.array(left, pa.int64()), "r": pa.array(right, pa.int64()),
                         "id": pa.array(merged, pa.int32())})
        words = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()),
                          "chars": pa.array([b.decode("latin-1") for b in self.ranks], pa.string())})
        self.db.register("rows_in", rows)
        self.db.register("words_in", words)
        self.db.execute("CREATE TABLE merges AS SELECT (l << 20) | r AS pair, id FROM rows_in")
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, chars FROM words_in")

    def _table(self, name: str, flat: np.ndarray, lens: np.ndarray) -> None:
        """Registers rows (w, p, t) of sequences that lie one after the other in ``flat``."""
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.db.register(name, pa.table({"w": np.repeat(np.arange(len(lens), dtype=np.int32), lens),
                                         "p": at.astype(np.int32), "t": flat.astype(np.int32)}))

    def _encode(self, pieces: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of ids of each."""
        flat = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        self._table("pieces", flat, np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ids = self.db.sql(sql).to_arrow_table()["ids"].combine_chunks()
        return ids.values.to_numpy(), np.diff(ids.offsets.to_numpy())

    def _decode(self, flat: np.ndarray, lens: np.ndarray) -> list[bytes]:
        self._table("ids", flat, lens)
        return [c.encode("latin-1") for c in self.db.sql(DECODE_SQL).to_arrow_table()["chars"].to_pylist()]

    def learn(self, pieces: set[str]) -> None:
        """Encode and decode the pieces that are not known yet."""
        new = [(p, p.encode()) for p in pieces - self.known.keys()]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            self.odd.clear()
            new = [(p, p.encode()) for p in pieces]

        def keep(part, flat: np.ndarray, lens: np.ndarray) -> None:
            raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lens)).tolist()
            begin = 0
            for (p, b), end, back in zip(part, ends, self._decode(flat, lens)):
                self.known[p] = raw[begin:end]
                if back != b:
                    self.odd[p] = back
                begin = end

        rest, whole, size = [], [], 0
        for x in new:
            if x[1] in self.ranks:                                          # a token itself: no contraction
                whole.append(x)
            elif len(x[1]) > LONG_BYTES:
                keep([x], *self._encode([x[1]], ENCODE_LONG_SQL))
            else:
                rest.append(x)
                size += len(x[1])
                if len(rest) == CHUNK_PIECES or size > CHUNK_BYTES:
                    keep(rest, *self._encode([b for _, b in rest], ENCODE_SQL))
                    rest, size = [], 0
        if rest:
            keep(rest, *self._encode([b for _, b in rest], ENCODE_SQL))
        if whole:
            keep(whole, np.array([self.ranks[b] for _, b in whole], np.int32), np.ones(len(whole), np.int64))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Little-endian 32-bit ids and decoded bytes of every text."""
        split = [self.split(t) if t else [] for t in texts]
        met: set[str] = set()
        for pieces in split:
            met.update(pieces)
        self.learn(met)
        out = []
        for pieces in split:
            ids = b"".join(map(self.known.__getitem__, pieces))
            back = b"".join([self.odd.get(p) or p.encode() for p in pieces]) if self.odd else "".join(pieces).encode()
            out.append((ids, back))
        return out


def codec(path: str, pattern: str) -> Codec:
    made = worker_cache("bpe")
    if (path, pattern) not in made:
        made[path, pattern] = Codec(path, pattern)
    return made[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None,
                   text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_tokens``, ``ids`` (array of ids) and ``decoded`` (bytes of the decoded ids).

    ``path`` names a rank file that every executor can read.
    """
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(column: pa.Array) -> dict[str, pa.Array]:
        found = codec(path, pattern).encode(column.to_pylist())
        ids = [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in found]
        return {"n_tokens": longs([len(i) for i in ids]), "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array([b for _, b in found], pa.binary())}

    return append_columns(docs, text_col, "n_tokens long, ids array<int>, decoded binary", run, SLICE_BYTES, "bpe")


def bpe_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None,
               text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_tokens`` and SHA-256 digests of the ids and of the decoded bytes."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(column: pa.Array) -> dict[str, pa.Array]:
        found = codec(path, pattern).encode(column.to_pylist())
        digest = lambda i: pa.array([hashlib.sha256(f[i]).hexdigest() for f in found], pa.string())     # noqa: E731
        return {"n_tokens": longs([len(a) // 4 for a, _ in found]), "ids_sha256": digest(0), "decoded_sha256": digest(1)}

    return append_columns(docs, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", run,
                          SLICE_BYTES, "bpe")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digest(docs.select("doc_id", "text")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, source, token ids, their number and the decoded text's digest."""
    from pyspark.sql import functions as F

    out = bpe_round_trip(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                      (F.coalesce(F.encode("text", "utf-8"), F.lit(b"")) == F.col("decoded")).alias("round_trip"))
