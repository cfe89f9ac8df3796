"""Whitening, fill-in-the-middle and sum-of-squares packing: brute force, round trips, odd rows."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidepool.llm import best_fit, fill_middle, sequences, whitening
from tidepool.llm import queries as llm
from tidepool.llm.sequences import Piece
from tidepool.llm.tokenizing import vocabulary

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, n long, component string, x int, whitened string"


def brute_whitening(vectors, k):
    """Straight from the contract: (n, values, vectors by column, x, whitened, deviations) with the covariance as a matrix."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = (n * fit - sums) / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1], turn[:, ::-1]
    kept = min(k, int((values > 1e-9 * values[0]).sum()))
    deviations = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return n, values, (n * x - sums) / n @ turn[:, :kept] / np.sqrt(values[:kept]), deviations


def compare(spark, vectors, k=16, width=None):
    df = spark.createDataFrame([(i, v, 0, "a", 1, "b") for i, v in enumerate(vectors)], VECTORS).repartition(3)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df, k=k, width=width).collect()}
    n, values, want, deviations = brute_whitening(vectors, k)
    assert len(got) == want.size
    flips = [np.sign(sum(got[i, c + 1].whitened * want[i, c] for i in range(len(vectors)))) for c in range(want.shape[1])]
    for i in range(len(vectors)):
        for c in range(want.shape[1]):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, deviations[i])
            assert abs(r.whitened - flips[c] * want[i, c]) < 1e-8
            assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("d, width", [(5, None), (24, None), (40, 20)])
def test_whitening_by_brute_force(spark, d, width):
    """The last: a block narrower than d, so that the iteration has to go on until residuals are small."""
    rng = np.random.default_rng(d)
    data = rng.standard_normal((300, d)) * 0.8 ** np.arange(d) * 8
    vectors = data[[*range(300), 5, 5, 9]].tolist()  # repeated rows count once in the fit list
    compare(spark, vectors, width=width)


def test_slow_spectrum_widens_the_block(spark):
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(-40, 40, (400, 48)), axis=0)
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>")
    found = whitening.fit_whitening(fit, k=4)
    assert found.passes < 12 and found.vectors.shape == (48, 4)
    assert np.allclose(found.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4], rtol=1e-12)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -0.25, 1.0], [0.5, -0.25, 1.0], [3.0, 0.0, 0.0], [-1.0, 2.0, 0.5], [0.0, 1.0, -4.0]]
    odd = [(10, None), (11, []), (12, [1.0, None, 2.0]), (13, [nan, 1.0, 1.0]), (14, [1.0, -inf, 0.0]), (15, [1.0, 2.0]), (None, good[2])]
    rows = [(i, v) for i, v in enumerate(good)] + odd
    df = spark.createDataFrame([(i, v, 0, "a", 1, "b") for i, v in rows], VECTORS)
    out = whitening.whiten(df).collect()
    assert sorted({-1 if r.vec_id is None else r.vec_id for r in out}) == [-1, 0, 1, 2, 3, 4]
    assert {r.n for r in out} == {4} and {r.component for r in out} == {1, 2, 3} and len(out) == 18
    one = {(r.vec_id, r.component): r.whitened for r in out}
    assert all(one[0, c] == one[1, c] and one[None, c] == one[2, c] for c in (1, 2, 3))
    compare(spark, good)
    alike = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert whitening.whiten(alike).count() == 0
    assert whitening.whiten(alike.limit(0)).count() == 0


def test_large_deviations_are_exact_or_refused():
    model = whitening.Whitening(1, np.array([0, 0]), np.ones(1), np.ones((2, 1)), 1.0, 0.0, 1)
    big = (1 << 31) + 12345
    assert model.deviations(np.array([[big, 3]])).tolist() == [big * big + 9]
    with pytest.raises(OverflowError):
        model.deviations(np.array([[1 << 32, 0]]))


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(text, doc_id):
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "a", " a ", "\t\n\v\f\r x\x1cy\xa0z\x85 w", "< <P < S> <<M", "has <S> in it", "日本 é ́ 😀 end", "\n\nx" * 900, "y" * 30_000 + " z", "ends <", "<", "P> <", "w " * 5000, " " * 9000, " ".join(f"word{k}\n" for k in range(4000))]


def test_fill_middle(spark):
    rows = [(doc, t, "x", 1) for k, t in enumerate(TEXTS) for doc in range(12 * k, 12 * k + 12)] + [(None, "no id here", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    got = fill_middle.format_documents(df).collect()
    want = sorted(((doc, *plain_middle(t or "", doc)) for doc, t, _, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    back = fill_middle.read_back(fill_middle.format_documents(df)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(((r.doc_id, r.restored_sha256) for r in back), key=repr) == sorted(((doc, sha(t)) for doc, t, _, _ in rows), key=repr)
    assert fill_middle.format_documents(df.limit(0)).count() == 0


def test_ropes_split_and_join_anywhere():
    text = " ".join(f"word{k}" for k in range(3000)) + " \n"
    units, tree = UNIT.findall(text), fill_middle.rope(text)
    assert (tree.units, tree.points, fill_middle.written(tree)) == (len(units), len(text), text) and tree.depth < 6
    for rank in (-1, 0, 1, 7, 311, 2999, 3000, 3001, 9999):
        left, right = fill_middle.split(tree, rank)
        assert fill_middle.written(left) == "".join(units[: max(0, rank)]) and fill_middle.written(right) == "".join(units[max(0, rank) :])
        assert left.units + right.units == tree.units and max(left.depth, right.depth) < 9
    for rank in (0, 1, 5000, len(text)):
        left, right = fill_middle.split(tree, rank, "points")
        assert (fill_middle.written(left), fill_middle.written(right)) == (text[:rank], text[rank:])


def test_fill_middle_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(llm.ORACLE_SQL["op12_fill_middle"])
    columns = [d[0] for d in found.description]
    assert sorted(found.fetchall()) == sorted(tuple(r) for r in llm.op12_fill_middle(spark, SF).select(columns).collect())


def plain_gap(counts, size, window):
    """The gap that makes the sum of squares least, by trying all."""
    best = None
    for gap in range(size, window + 1):
        if gap < window and not counts.get(gap):
            continue
        after = dict(counts)
        if gap < window:
            after[gap] -= 1
        if gap > size:
            after[gap - size] = after.get(gap - size, 0) + 1
        total = sum(n * n for n in after.values())
        if best is None or total < best[0]:
            best = total, gap
    return best[1]


def test_sum_of_squares_by_trying_all_gaps():
    rng, window = np.random.default_rng(3), 32
    bins, counts = best_fit.Bins(window), {}
    for k, size in enumerate(rng.integers(1, window, 800).tolist()):
        gap = plain_gap(counts, size, window)
        assert bins.gaps.best(size) == gap
        if gap < window:
            counts[gap] -= 1
        if gap > size:
            counts[gap - size] = counts.get(gap - size, 0) + 1
        full = list(bins.put(Piece(k, 0, 0, size, size, b"")))
        assert len(full) == (gap == size) and all(sum(p.length for p in own) == window for own in full)
    assert {h: len(x) for h, x in enumerate(bins.bins) if x} == {h: n for h, n in counts.items() if n}
    assert bins.held == sum((window - h) * n for h, n in counts.items())


def check_packed(rows, documents, window, end_id=2):
    """All ids of all documents once, cut where they may be, and without gaps."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = []
    for doc, t in documents:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        cuts = [0, *range((len(ids) - 1) % window + 1, len(ids) + 1, window)]
        pieces += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(pieces, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert ends[-1] <= window and [at for at, _ in sorted(own)] == [0, *ends[:-1]]
    return len(sequences)


@pytest.mark.parametrize("most_ids", [1 << 24, 60])
def test_best_fit(spark, most_ids):
    """The second: open bins are set free again and again."""
    rng = np.random.default_rng(5)
    documents = [(k, " ".join("abcdefgh"[int(c)] for c in rng.integers(0, 8, n))) for k, n in enumerate(rng.integers(0, 70, 300).tolist())]
    documents += [(None, None), (1, ""), (1, "again"), (1, "again"), (900, "long text " * 2000), (901, "a b c d e f g h i j k l m n o " * 1)]
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in documents], "doc_id long, text string, length int, free string").repartition(3)
    rows = sequences.read(best_fit.write_sequences(df, window=64, most_ids=most_ids)).collect()
    n, total = check_packed(rows, documents, 64), sum(r.length for r in rows)
    assert n <= 1.03 * -(-total // 64)
    assert best_fit.pack(df.limit(0)).count() == 0


def test_best_fit_of_a_table(spark):
    con = duckdb.connect()
    documents = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = llm.op13_best_fit(spark, SF).collect()
    assert check_packed(rows, documents, 1024) <= 1.02 * -(-sum(r.length for r in rows) // 1024)


def test_queries_are_registered():
    assert {"op11_whitening", "op12_fill_middle", "op13_best_fit"} <= set(llm.QUERIES) and os.path.isdir(SF)
