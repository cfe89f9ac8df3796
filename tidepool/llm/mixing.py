"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the source's factor (target / size) of copies: the whole part surely, the rest as a probability. Two
fractional documents are paired and words move from one to the other until one of them is integral, in the direction that keeps
each document's expectation; so the words of all documents of a source stay what they were, and only one document is
left undecided when all pairs are done. The pairs form a reduction tree: hashed buckets of a source are leaves, and what
each leaves undecided (its carry and its few smallest documents, kept back so that the last decisions are the finest) meets in the
level above, a bounded number of rows a node. At the root each undecided document is rounded, the largest first, and its error is handed
on to the smaller ones.

All draws are hashes of doc_id and seed, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
KEPT_BACK = 24
FAN_IN = 32
#: The root is rounded with so many draws; the one that comes nearest to the words wanted counts.
ROOT_TRIES = 32


def sized(df: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id, source, size (the words of each text), mark (a hash of it)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("mark"), *more)


def _draws(pdf: pd.DataFrame, level: int) -> np.ndarray:
    """A number in [0, 1) for each row: its own draw, shifted by the level."""
    return np.modf(pdf["draw"].to_numpy() + level * 0.6180339887498949)[0]


def resolve(size: np.ndarray, p: np.ndarray, draw: np.ndarray, last: bool) -> np.ndarray:
    """New probabilities after pairing, rows in order of size from the largest. Not at the root: all but the carry and the KEPT_BACK smallest
    become 0 or 1. At the root: all do."""
    n = len(p)
    p = p.copy()
    stop = 0 if last and n <= KEPT_BACK + FAN_IN else max(0, n - KEPT_BACK)
    carry = -1
    for k in range(stop):
        if not 0 < p[k] < 1:
            continue
        if carry < 0:
            carry = k
            continue
        i, j = carry, k
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # words that i can take from j
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if draw[k] < down / (up + down) else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for m in (i, j):
            if abs(p[m]) < 1e-9 or abs(p[m] - 1) < 1e-9:
                p[m] = round(p[m])
        # one of the two is integral now; a rounding error may have settled both
        carry = next((m for m in (i, j) if 0 < p[m] < 1), -1)
    if last and n:
        want = float((p * size).sum())
        tries = [settle(size, p, np.modf(draw + t * 0.7548776662466927)[0]) for t in range(ROOT_TRIES)]
        return min(tries, key=lambda q: abs(float((q * size).sum()) - want))
    return p


def settle(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Rounds all that is undecided, the largest first; the smaller ones make up for each one's error as far as they have room."""
    p = p.copy()
    open_ = [k for k in range(len(p)) if 0 < p[k] < 1]
    for a, k in enumerate(open_):
        value = float(draw[k] < p[k])
        error = (p[k] - value) * size[k]
        p[k] = value
        rest = np.array([m for m in open_[a + 1 :] if 0 < p[m] < 1], int)
        if not len(rest):
            continue
        room = (1 - p[rest]) * size[rest] if error > 0 else p[rest] * size[rest]
        moved = np.sign(error) * room * min(1.0, abs(error) / max(room.sum(), 1e-12))
        p[rest] = np.clip(p[rest] + moved / size[rest], 0, 1)
        near = np.round(p[rest])
        p[rest] = np.where(np.abs(p[rest] - near) < 1e-9, near, p[rest])
    return p


ROWS = "doc_id long, row long, source string, size long, base long, p double, draw double, node long"


def _node(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "draw", "row"], ascending=[False, True, True, True], kind="stable")
        pdf["p"] = resolve(pdf["size"].to_numpy(float), pdf["p"].to_numpy(float), _draws(pdf, level), last)
        return pdf

    return run


def weigh(df: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: one row a source; sources by code point, null last, and weights repeating. A target is its share of all
    words, by weight, but stops at most times its source's size; the excess goes to the others by weight until none is above.

    Sources in order of size for their weight stop first. With the first k of them stopped, each weight left is worth level(k) words,
    what is left to share over the weights left; the sources that stop are those before the first one with room for its level. Both
    are running sums over the sources, a row a source, which no other row needs."""
    found = df.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    numbered = found.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.lit(list(map(float, weights))), (F.col("_n") % len(weights) + 1).cast("int"))
    rows = numbered.withColumn("_w", weight).withColumn("_most", F.lit(float(most)) * F.col("source_size"))
    with_words = rows.where("source_size > 0")
    order = [F.col("_most") / F.col("_w"), F.col("_n")]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(earlier), zero)
    weights_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), zero)
    levels = with_words.withColumn("_level", F.greatest(left, zero) / weights_left).withColumn("_stops", F.col("_level") * F.col("_w") > F.col("_most"))
    level = F.min(F.when(~F.col("_stops"), F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)], F.col("_level")))).over(everything)["_level"]
    goals = levels.withColumn("_level", level).select("_n", F.least(F.coalesce(F.col("_level") * F.col("_w"), F.col("_most")), "_most").alias("target"))
    return rows.join(goals, "_n", "left").select("source", "source_size", F.coalesce("target", zero).alias("target"))


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, leaf_rows: int = 20_000, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row a row of df, in no order.

    Null text: size 0, and no copies. A null source is a source, the last one. Repeated rows are documents of their own. row is their
    place in the written table, or the column row of df, a different long in each row; draws follow doc_id, text and source, so reruns take as many
    copies of each text, wherever its rows lie. Sources without words: target 0. An empty table gives no rows. Other
    columns are ignored.
    """
    docs = materialize(sized(df, (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row")), "sizes")
    # written, so that Spark knows its size and sends it to the documents if it is small
    sources = materialize(weigh(docs, weights, share, most), "sources").withColumnRenamed("source", "_source")
    leaves = max(1, -(-docs.count() // leaf_rows))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = docs.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "mark", "_again", F.lit(seed)), 11) / F.lit(float(1 << 53))
    # equal rows would draw alike: their ordinal tells them apart, and it does not matter which of them has which
    copies = Window.partitionBy("doc_id", "mark", "source").orderBy("row")
    known = joined.withColumn("_again", F.row_number().over(copies)).withColumn("draw", draw)
    whole = F.when(F.col("size") > 0, F.floor(factor + 1e-12)).otherwise(0)
    rest = F.when(F.col("size") > 0, F.greatest(factor - whole, F.lit(0.0))).otherwise(0.0)
    start = known.select("doc_id", "row", "source", "size", whole.cast("long").alias("base"), F.when(rest < 1e-12, 0.0).otherwise(rest).alias("p"), "draw", F.pmod(F.xxhash64("doc_id", "mark", "_again", F.lit(seed + 1)), F.lit(leaves)).alias("node"))
    settled, level = [], 0
    while True:
        last = leaves == 1
        done = materialize(start.groupBy("source", "node").applyInPandas(_node(level, last), ROWS), f"mix-{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(done if last else done.where(~open_))
        if last:
            break
        leaves = -(-leaves // FAN_IN)
        start = done.where(open_).withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        level += 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    count = (F.col("base") + (F.col("p") >= 0.5).cast("long")).alias("copies")
    out = out.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "row", "source", "size", "source_size", "target", count, (count * F.col("size")).alias("taken"))
