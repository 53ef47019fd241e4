"""Quality rules by line sequence labelling.

Every line that has a word gets features (symbols, capitals, repeated words, length,
punctuation, ...); a linear-chain CRF labels the lines of a text content or
boilerplate by Viterbi decoding, and the share of words on content lines decides
whether the text is kept.  Base rules on length and repetition come first.

Edge cases: a null or empty text has no words, fails the base rules and is not kept;
repeated rows each get their own (equal) result; an empty table gives an empty
result; input columns named like an output column are replaced; texts of any length
are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.arrowtools import append_columns, longs, text_bytes
from tillroll.llm.crf import Crf, fit, viterbi

# Fixed values of the base rules.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
# A text is kept if at least this share of its words is on content lines.
MIN_CONTENT_SHARE = 0.5
# Bounds of the training sample: labelled texts, and lines of each used to train (a run of lines that
# lies anywhere in the text, told by the id's hash).
TRAIN_TEXTS = 2000
TRAIN_LINES = 48

FEATURES = ("bias", "symbols_per_word", "capital_share", "exclaims_per_word", "repeat_share",
            "digit_share", "short", "long", "ends_sentence", "seen_before")
# Centre of the weight prior, also the model when there is no labelled text.
PRIOR = Crf((1.5, -6.0, -4.0, -3.0, -5.0, -3.0, -0.3, 0.3, 0.3, -0.5), 0.5)

OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "n_lines long, content_words long, content_share double, base_failed boolean, kept boolean")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True                      # lead bytes of letters beyond ASCII
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32)             # a batch holds under 2 GiB of text
    np.cumsum(mask, out=out[1:])
    return out


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each text inside an 8-word window that the text holds twice or more.

    Window ids come from pairing ids of half-length windows (1, 2, 4, 8 words), so
    equality is exact.
    """
    n = len(ids)
    if n < WINDOW:
        return np.zeros(n_docs, np.int64)
    code, _ = pd.factorize(doc.astype(np.int64) * (int(ids.max()) + 1) + ids)   # words of one text only
    span = 1
    while span < WINDOW:
        code = pd.factorize(code[:-span].astype(np.int64) * (n + 1) + code[span:])[0]
        span *= 2
    whole = doc[:len(code)] == doc[WINDOW - 1:]
    counts = np.bincount(code[whole], minlength=int(code.max()) + 1)
    hit = whole & (counts[code] > 1)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:n]) > 0], minlength=n_docs)


def line_table(column: pa.Array) -> dict[str, np.ndarray]:
    """Base counts of each text and features of each line that has a word."""
    raw, off = text_bytes(column)
    n_docs = len(off) - 1
    sep = np.zeros(len(raw) + n_docs, np.uint8)         # every text is followed by one \n
    start = off[:-1] + np.arange(n_docs)
    end = off[1:] + np.arange(n_docs)
    keep = np.ones(len(sep), bool)
    keep[end] = False
    sep[keep] = raw
    sep[end] = 10
    space = _SPACE[sep]
    first = np.empty(len(sep), bool)
    if len(sep):
        first[0] = True
        first[1:] = space[:-1]
    begins = first & ~space
    word_at = _running(begins)
    words = np.array(sep.tobytes().split(), dtype=object)
    ids = pd.factorize(words)[0].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    n_words = word_at[end] - word_at[start]
    doc_of_word = np.repeat(np.arange(n_docs), n_words)
    chars = _running(~space & ((sep & 0xC0) != 0x80))
    symbols = _running(_SYMBOL[sep])

    # lines: from after a \n (or text start) up to the next \n
    stop = np.flatnonzero(sep == 10)
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    line_words = word_at[stop] - word_at[begin]
    used = line_words > 0
    begin, stop, line_words = begin[used], stop[used], line_words[used]
    line_doc = np.searchsorted(end, begin, side="right") if len(begin) else begin
    data = sep.tobytes()
    seen_before = np.zeros(len(begin))
    earlier: set = set()
    current = -1
    for k, (d, a, b) in enumerate(zip(line_doc.tolist(), begin.tolist(), stop.tolist())):
        if d != current:
            earlier, current = set(), d
        line = data[a:b]
        if line in earlier:
            seen_before[k] = 1.0
        else:
            earlier.add(line)

    same = np.zeros(len(ids) + 1, np.int64)
    if len(ids) > 1:
        same[2:] = np.cumsum((ids[1:] == ids[:-1]) & (doc_of_word[1:] == doc_of_word[:-1]))
    letters, uppers = _running(_LETTER[sep]), _running(_UPPER[sep])
    exclaims, digits = _running(sep == 33), _running(_DIGIT[sep])
    nw = np.maximum(line_words, 1).astype(float)
    between = lambda c: (c[stop] - c[begin]).astype(float)                      # noqa: E731
    n_letters = np.maximum(between(letters), 1.0)
    w0, w1 = word_at[begin], word_at[stop]
    last = stop - 1
    while len(last):                                                            # trailing white space
        blank = space[last] & (last > begin)
        if not blank.any():
            break
        last = np.where(blank, last - 1, last)
    ends = np.isin(sep[last], [33, 46, 58, 59, 63]) if len(last) else np.zeros(0, bool)
    feats = np.column_stack([
        np.ones(len(begin)), np.minimum(between(symbols) / nw, 1.0), between(uppers) / n_letters,
        np.minimum(between(exclaims) / nw, 1.0), (same[w1] - same[np.minimum(w0 + 1, len(ids))]) / nw,
        between(digits) / np.maximum(stop - begin, 1), (line_words < 4).astype(float),
        (line_words >= 12).astype(float), ends.astype(float), seen_before])
    return {"n_words": n_words, "word_chars": chars[end] - chars[start], "n_symbols": symbols[end] - symbols[start],
            "n_dup_lines": np.bincount(line_doc, weights=seen_before, minlength=n_docs).astype(np.int64),
            "n_repeat_words": _repeat_words(ids, doc_of_word, n_docs),
            "line_doc": line_doc, "line_words": line_words, "features": feats}


def judge(column: pa.Array, model: Crf, min_share: float) -> dict[str, pa.Array]:
    t = line_table(column)
    n_docs = len(t["n_words"])
    unary = t["features"] @ np.array(model.weights)
    counts = np.bincount(t["line_doc"], minlength=n_docs)
    states: list[int] = []
    at = 0
    scores = unary.tolist()
    for c in counts.tolist():
        states += viterbi(scores[at:at + c], model.stay)
        at += c
    content = np.bincount(t["line_doc"], weights=t["line_words"] * np.array(states, float), minlength=n_docs)
    share = content / np.maximum(t["n_words"], 1)
    failed = (t["n_words"] < MIN_WORDS) | (100 * t["n_repeat_words"] > MAX_REPEAT_PERCENT * t["n_words"])
    return {**{k: longs(t[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
            "n_lines": longs(counts), "content_words": longs(content), "content_share": pa.array(share),
            "base_failed": pa.array(failed), "kept": pa.array(~failed & (share >= min_share))}


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_TEXTS) -> DataFrame:
    """Features of the lines of at most ``limit`` labelled texts (smallest id hashes first)."""
    picked = (labels.where("doc_id is not null and quality is not null")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = (docs.select("doc_id", "text").where("text is not null")
            .join(F.broadcast(picked), "doc_id"))               # at most ``limit`` rows

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                t = line_table(batch.column("text"))
                q = batch.column("quality").to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.bincount(t["line_doc"], minlength=batch.num_rows))
                starts = np.concatenate([[0], ends[:-1]])
                # one run of lines from anywhere in the text, by the id's hash
                runs = np.maximum(1, -(-(ends - starts) // TRAIN_LINES))
                first = starts + TRAIN_LINES * ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % runs)
                feats = [t["features"][a:min(b, a + TRAIN_LINES)].ravel().tolist() for a, b in zip(first, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(feats, pa.list_(pa.float64())),
                                                  pa.array(q.astype(np.int64))], names=["doc_id", "features", "quality"])

    return rows.mapInArrow(run, "doc_id long, features array<double>, quality long")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_TEXTS) -> Crf:
    """CRF fitted on at most ``limit`` labelled texts, each line carrying its text's label.

    Copies of one id are used once.  Without labelled texts the prior is the model.
    """
    rows = (training_sample(docs, labels, limit).groupBy("doc_id")
            .agg(F.min(F.struct("features", "quality")).alias("r"))
            .select("doc_id", "r.*").orderBy("doc_id").collect())          # bounded by ``limit``
    width = len(FEATURES)
    seqs = [(np.array(r["features"], float).reshape(-1, width),
             np.full(len(r["features"]) // width, float(r["quality"]))) for r in rows]
    return fit(seqs, PRIOR)


def line_quality(docs: DataFrame, model: Crf = PRIOR, text_col: str = "text",
                 min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """``docs`` plus the base counts and the verdict ``kept`` (see the module docstring)."""
    return append_columns(docs, text_col, OUT, lambda column: judge(column, model, min_share))


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_quality(docs.select("doc_id", "text"), train(docs, labels)).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the quality rules keep, with the columns of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_quality(docs, train(docs, labels)).where("kept").select(docs.columns)
