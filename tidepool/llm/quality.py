"""Quality rules: fixed rules on a text's repetition, then boosted trees over document statistics.

One pass over the texts writes every document's statistics to the shared folder. A bounded sample of the labelled
rows (max_train_rows, by hash of doc_id) trains the trees on the driver; a second pass over the statistics, not
over the texts, scores all documents. The score can only fall as symbols, repeated lines, repeated words, capitals or
exclamation marks become more frequent.

Null text: no words, so it fails the base rules. Repeated rows are judged alike. Labels without a document, null labels and
documents without a label take no part in training; several labels of one document count as the worst of them, and of several documents with one doc_id
that with the least statistics is learnt from. Without any labels the
trees are a constant that keeps what passes the base rules. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import documents_of, materialize
from tidepool.llm.trees import Forest, train

WORD_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_distinct", "n_short", "n_upper", "n_digits", "n_shouts"]
STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + MORE)
#: Each feature, and how the score may move with it.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "short_words": 0, "upper": -1, "digits": 0, "shouts": -1, "line_words": 0}


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words inside windows that occur twice or more, each word once, the first occurrence too."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for k in range(window):
            key = (key ^ mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics_of(text: str) -> list[int]:
    raw = text.encode()
    words = raw.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip(WORD_BLANKS))
        else:
            seen.add(line)
    upper = digits = 0
    if raw:
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    short = sum(1 for w in words if len(w) <= 3)
    return [len(words), len(text) - sum(map(text.count, WORD_BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeated_words(ids), len(text), len(lines), len(known), short, upper, digits, text.count("!")]


def statistics(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATISTICS.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = np.array([statistics_of(t) for t in part.column(1).to_pylist()], np.int64).reshape(-1, len(names) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[:, k]) for k in range(found.shape[1])]], names)

    return documents_of(df).mapInArrow(run, STATISTICS)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_short"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_shouts"] / chars, c["n_words"] / np.maximum(c["n_lines"], 1)], 1)


def base_failed(least_words: int = 20, repeat_percent: int = 30) -> F.Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def labelled_sample(labels: DataFrame, max_train_rows: int) -> DataFrame:
    """doc_id, label of at most max_train_rows labelled documents, by hash of doc_id."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train_rows)
    )


def fit(stats: DataFrame, labels: DataFrame, max_train_rows: int = 20_000) -> Forest:
    """Trees from at most max_train_rows labelled rows."""
    sample = labelled_sample(labels, max_train_rows)
    rows = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", *BASE, *MORE)).alias("row")).orderBy("doc_id").select("row.*").toPandas()
    return train(features({c: rows[c].to_numpy() for c in BASE + MORE}), rows["label"].to_numpy().astype(float), list(FEATURES.values()))


def judge(df: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train_rows: int = 20_000) -> DataFrame:
    """doc_id, the statistics, base_failed, score, kept: one row a row of df."""
    stats = materialize(statistics(df), "quality")
    forest = fit(stats, labels, max_train_rows)
    names = [*BASE, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.probability(features({c: b.column(b.schema.names.index(c)).to_numpy() for c in names}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, "score"])

    scored = stats.mapInArrow(run, STATISTICS + ", score double")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep(df: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train_rows: int = 20_000) -> DataFrame:
    """The rows of df that judge() keeps, with all their columns. Texts don't move: the sample's statistics train the trees, then each
    row is judged where it is read."""
    sample = labelled_sample(labels, max_train_rows)
    texts = documents_of(df).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    forest = fit(statistics(texts), labels, max_train_rows)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                found = np.array([statistics_of(t or "") for t in part.column(at).to_pylist()], np.int64).reshape(-1, len(BASE + MORE))
                columns = {c: found[:, k] for k, c in enumerate(BASE + MORE)}
                failed = (columns["n_words"] < 20) | (100 * columns["n_repeat_words"] > 30 * columns["n_words"])
                yield part.filter(pa.array(~failed & (forest.probability(features(columns)) >= threshold)))

    return df.mapInArrow(run, df.schema)
