"""The ten operators on small tables: brute force, exact round trips, and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import chat, dedup, fingerprints, html_text, mixing, packing, quality, token_counts, token_files, url_filter
from tidepool.llm.tokenizing import encoder, vocabulary
from tidepool.llm.trees import train


def library(vocab):
    """The library as it is, for plain calls on whole texts."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(vocab))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int, size string"
LONG = "word number " + " ".join(f"w{k % 700} x{k}" for k in range(6000))
BASE = " ".join(f"term{k}" for k in range(120))
ODD = [
    (1, None, None, None, None, "a", 1, "b"),
    (2, "", "en", "s1", 0, None, None, None),
    (3, LONG, "en", "s1", 1, "a", 1, "b"),
    (4, BASE, "en", "s2", 1, "a", 1, "b"),
    (4, BASE, "en", "s2", 1, "a", 1, "b"),
    (5, BASE.replace("term60", "other"), "en", None, 1, "a", 1, "b"),
    (6, " \t\n ", "en", "s2", 1, "a", 1, "b"),
    (7, "Two  words\n\n<|endoftext|> é ́x 日本", "en", "s3", 1, "a", 1, "b"),
    (None, "no id at all here", "en", "s3", 1, "a", 1, "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(row):
    return row[1] or ""


@pytest.mark.parametrize("vocab", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_encode_as_whole_texts(vocab):
    e, plain = encoder(vocab), library(vocab)
    texts = ["a <|endoftext|> b", "<|EndOfText|> x", "<|startoftext|>y<|ENDOFTEXT|>", "  a  b\n\n c\td", "it's they'll. 'S", " ", "\n", "<|endoftext|> x<|endoftext|>", "á ́b ŠÉ Ȩ́", "x" * 500 + " y", "日本語 テキスト 12 4a", "a\x00b", "a\xa0b  c", "hi... (foo) -bar- ΑΣ İx ﬁ", "a \nb\n c", "é. a.́", LONG]
    for t in texts:
        assert e.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    apart, size = encoder(vocab, literal=True), plain.get_vocab_size()
    ends = {plain.token_to_id("<|endoftext|>")}
    assert ends & set(e.encode("a<|endoftext|>")) and not ends & set(apart.encode("a<|endoftext|>")) and max(apart.encode(LONG)) < size


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    assert packing.pack(none).count() == 0
    plain = library("word_bpe_49k.json")
    want = sorted(len(plain.encode(text(r), add_special_tokens=False).ids) + 1 for r in ODD)
    by_start = [r for r in rows if r.start == 0]
    assert sorted(r.doc_tokens for r in by_start) == want
    ids = np.array(plain.encode(LONG, add_special_tokens=False).ids + [1], "<u4")
    own = sorted((r for r in rows if r.doc_id == 3), key=lambda r: r.start)
    assert sum(r.length for r in own) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_written_sequences(odd):
    plain = library("word_bpe_49k.json")
    of = {r[0]: plain.encode(text(r), add_special_tokens=False).ids + [1] for r in ODD}
    for r in packing.write_sequences(odd, window=300, pad_id=7).collect():
        ids = np.frombuffer(r.ids, f"<u{r.width}").tolist()
        assert ids[: r.n_ids] == [i for s in r.segments for i in of[s.doc_id][s.start : s.start + s.length]]
        assert set(ids[r.n_ids :]) <= {7} and len(ids) == (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 300)


def test_plan_takes_every_piece():
    rng = np.random.default_rng(1)
    h = np.bincount(rng.integers(1, 2049, 30_000), minlength=2049)
    p = packing.plan(h, 2048)
    used = np.zeros(2049, int)
    for lengths, n in p:
        assert sum(lengths) <= 2048 and n > 0
        for v in lengths:
            used[v] += n
    assert (used == h).all()
    total = sum(n for _, n in p) * 2048
    assert (total - (h * np.arange(2049)).sum()) / total < 0.02


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi <|end|> \\ <\\|end|>", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", "yes <|turn|>", "x"), (None, None, None, "lost", "x"), (-7, 0, "user", said, "x"), (-7, 1, "assistant", said, "x"), (2, 0, "assistant", LONG, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, frame string")
    out = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df, frame_ids=64)).collect()}
    assert set(out) == {1, None, -7, 2}
    assert out[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[-7].loss_chars == len(said)
    assert out[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert out[1].n_turns == 3 and out[1].loss_chars == len("yes <|turn|>")
    assert chat.format_conversations(df.limit(0)).count() == 0
    for t in [said, "<\\|end|>", "<|end|><|end|>", "a<\\\\|sep|>b", ""]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.MARKERS + chat.FOREIGN)


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [ids[find(k)] for k in range(len(ids))]


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = [f"v{k}" for k in range(150)]
    texts = []
    for _ in range(60):  # near copies at various distances, many across the threshold
        w = list(base)
        for k in rng.choice(150, rng.integers(0, 5), replace=False):
            w[k] = f"z{rng.integers(1000)}"
        texts.append(" ".join(w))
    texts += ["", " ", "one two", "ONE two", "a b c d e f g", "a b c d e f h", "unrelated text of nine words is here right now"]
    n, want = brute_components(texts, list(range(len(texts))))
    got = {r.doc_id: r for r in dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].n_shingles for k in range(len(texts))] == n
    assert [got[k].component_id for k in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_rows(odd, none):
    got = dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and dedup.near_duplicates(none).count() == 0
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_duplicates_of_repeated_ids(spark):
    """Different texts under one doc_id are one document, and no text is taken for another's."""
    rng = np.random.default_rng(11)
    words = [[f"t{t}w{k}" for k in range(60)] for t in range(5)]

    def near(t):
        w = list(words[t])
        w[rng.integers(60)] = f"z{rng.integers(1000)}"
        return " ".join(w)

    rows = [(3, near(0)), (5, near(0)), (5, near(1)), (5, near(1)), (9, near(1)), (9, near(2)), (9, near(3)), (11, near(4)), (11, near(4)), (12, ""), (12, near(4)), (2, near(3)), (-(1 << 63), "a b c"), ((1 << 63) - 1, "a b c"), (7, "only here"), (7, "and this")]
    rows += [(r[0], r[1]) for r in rows[:4]]
    ids = [r[0] for r in rows]
    label = {i: i for i in ids}
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for _, t in rows]
    for _ in rows:
        for (a, _), x in zip(rows, sets, strict=True):
            for (b, _), y in zip(rows, sets, strict=True):
                if x and y and (a == b or 100 * len(x & y) >= 85 * len(x | y)):
                    label[a] = label[b] = min(label[a], label[b])
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = [(i, len(s), label[i] if s else i, (label[i] if s else i) == i) for i, s in zip(ids, sets, strict=True)]
    assert got == sorted(want)


def test_url_rules(spark):
    rules = [url_filter.Rule(*r) for r in [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]]
    urls = {1: ("http://A.example.NET/en/x?q", "example.net/en/", "allow"), 2: ("http://b.net/", "net/", "block"), 3: ("http://b.net", None, "allow"), 4: ("x://y.org/fr/", "org/fr/", "allow"), 5: (None, None, "allow"), 6: ("no scheme", None, "allow"), 7: ("http://bad.com/a", None, "block"), 8: ("http://w.bad.com", None, "block"), 9: ("http://notbad.com", None, "allow"), 10: ("http://xnet/", None, "allow")}
    df = spark.createDataFrame([(k, v[0], "z") for k, v in urls.items()], "page_id long, url string, key string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, rules, ["bad.com"]).collect()}
    assert got == {k: v[1:] for k, v in urls.items()}
    assert url_filter.judge_urls(df.limit(0), rules, ["bad.com"]).count() == 0
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, "http://bad.com", "z")], df.schema))
    listed = spark.range(3000).selectExpr("concat('h', id, '.com') AS host").unionByName(spark.createDataFrame([("bad.com",), (None,), ("",)], "host string"))
    rows = url_filter.judge_urls(twice, rules, listed).collect()
    assert sorted((str(r.page_id), r.rule or "", r.verdict) for r in rows) == sorted(2 * [(str(k), v[1] or "", v[2]) for k, v in urls.items()] + [("None", "", "block")])


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "HASHES", 2)
    universe = spark.range(300).selectExpr("concat('k', id) AS key")
    listed = [f"k{k}" for k in range(0, 300, 3)]
    cascade = url_filter.Cascade.build(universe, spark.createDataFrame([(k,) for k in [*listed, "k0", "elsewhere", None]], "key string"))
    assert len(cascade.levels) > 1
    assert universe.where(cascade.holds(F.col("key"))).count() == len(listed)
    assert universe.where(cascade.holds(F.col("key")) & F.col("key").isin(listed)).count() == len(listed)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(odd, none, rule):
    rows = token_counts.count_tokens(odd, rule=rule).collect()
    assert token_counts.count_tokens(none).count() == 0
    plain = library("byte_bpe_50k.json")
    for doc, t in ((7, ODD[7][1]), (3, LONG), (2, ""), (6, ODD[6][1])):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.section)
        sections = re.findall(r"[^\n]*\n|[^\n]+", t) or [""]
        assert [r.length for r in own] == [len(x) for x in sections]
        ids = plain.encode(t, add_special_tokens=False).ids
        ends = np.cumsum([len(x.encode()) for x in sections])
        section_of = [int(np.searchsorted(ends, k, "right")) for k in range(len(t.encode()))]  # of each byte
        want, at = [0.0] * len(sections), 0
        for i in ids:  # byte by byte
            mine = section_of[at : at + len(plain.id_to_token(i))]
            at += len(mine)
            counts = {s: mine.count(s) for s in dict.fromkeys(mine)}
            if rule == "share":
                for s, n in counts.items():
                    want[s] += n / len(mine)
            else:
                want[{"first": mine[0], "last": mine[-1], "most": max(counts, key=counts.get)}[rule]] += 1
        assert [r.n_tokens for r in own] == pytest.approx(want) and all(r.doc_tokens == len(ids) for r in own)


def test_mixing(odd, none, spark):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and mixing.mix(none).count() == 0
    assert all(r.taken <= 2 * r.size for r in rows)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(id * 7919 % 300 as int) + 1) AS text", "concat('s', id % 4) AS source")
    a = mixing.mix(docs, leaf_rows=200).collect()
    b = mixing.mix(docs.repartition(5), leaf_rows=200).collect()
    assert {r.doc_id: r.taken for r in a} == {r.doc_id: r.taken for r in b}
    for s in {r.source for r in a}:
        own = [r for r in a if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.002 * own[0].target + 1
    assert sum({r.source: r.target for r in a}.values()) == pytest.approx(1.5 * sum(r.size for r in a))


def brute_targets(sizes, weights, share, most):
    """Round after round: share by weight, stop those above, share the rest again."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [k for k in range(len(sizes)) if sizes[k] > 0]
    while open_ and left > 0:
        total = sum(weights[k % len(weights)] for k in open_)
        over = [k for k in open_ if left * weights[k % len(weights)] / total > most * sizes[k]]
        for k in over or open_:
            out[k] = most * sizes[k] if over else left * weights[k % len(weights)] / total
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)] if over else []
    return out


@pytest.mark.parametrize("share", [0.4, 1.5, 1.9, 2.5])
def test_targets_by_brute_force(spark, share):
    rng = np.random.default_rng(7)
    for n in (1, 3, 40):
        sizes = [int(x) for x in rng.integers(0, 3, n) * rng.integers(1, 10 ** rng.integers(1, 7), n)]
        names = sorted(f"s{rng.integers(10**6)}-{k}" for k in range(n - 1)) + [None]
        df = spark.createDataFrame([(s, int(p)) for s, v in zip(names, sizes, strict=True) for p in (v // 3, v - v // 3)], "source string, size long").repartition(3)
        got = {r.source: r for r in mixing.weigh(df, (3, 1, 2), share, 2.0).collect()}
        assert [got[s].source_size for s in names] == sizes
        assert [got[s].target for s in names] == pytest.approx(brute_targets(sizes, [3, 1, 2], share, 2.0))


def test_mixing_does_not_follow_places(spark):
    """One doc_id for many texts of one size: as many copies of each text, however the rows are dealt out."""
    rows = [(k % 3, f"a{k} b c d", f"s{k % 2}") for k in range(300)] + [(1, "same words here", "s0")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def taken(d):
        rows_ = d.withColumn("key", F.monotonically_increasing_id()).cache()
        found = rows_.join(mixing.mix(rows_, leaf_rows=50, row="key").select(F.col("row").alias("key"), "copies"), "key")
        return sorted((r.text, r.n) for r in found.groupBy("text").agg(F.sum("copies").alias("n")).collect())

    assert taken(df.repartition(2)) == taken(df.orderBy(F.xxhash64("text")).repartition(5))


def parsed_plainly(text):
    """Phrases of both levels, place by place, by recursion over Python numbers."""
    mask = 2**64 - 1
    a, b = int(fingerprints._A), int(fingerprints._B)

    def mix(x):
        x = ((x ^ (x >> 32)) * b) & mask
        x = ((x ^ (x >> 29)) * a) & mask
        return x ^ (x >> 32)

    def toss(labels):
        out = []
        for k, x in enumerate(labels):
            differ = x ^ (labels[k - 1] if k else x ^ 1)
            bit = (differ & -differ).bit_length() - 1 if differ else 63
            out.append(2 * bit + (x >> bit & 1))
        return out

    def level(names):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [mix((x * a + n) & mask) if n > 1 else x for x, n in runs]
        labels = toss(toss(toss(names)))
        n = len(names)
        starts = [k for k in range(n) if k == 0 or k > 1 and k < n - 1 and labels[k] > labels[k - 1] and labels[k] >= labels[k + 1]]
        out = []
        for k, end in zip(starts, starts[1:] + [n], strict=True):
            own = sum(mix((names[k + i] + (i + 1) * a) & mask) for i in range(end - k))
            out.append(mix((own + (end - k) * b) & mask))
        return out

    def phrases(names, depth):
        if depth > max(fingerprints.LEVELS) or not names:
            return set()
        names = level(names)
        own = {mix((x + depth) & mask) >> 32 for x in names} if depth in fingerprints.LEVELS else set()
        return own | phrases(names, depth + 1)

    return sorted(phrases([mix(ord(c) + 1) for c in text], 1))[: fingerprints.WIDTH]


def test_phrases_by_plain_recursion():
    texts = ["", "a", "ab", "aaaa bbbb", LONG[:3000], "日本語 é́ " * 9, "abcabcabc" * 40, BASE, "x" * 500]
    assert [x.tolist() for x in fingerprints.sketches(texts)] == [parsed_plainly(t) for t in texts]


def test_html(spark):
    page = """<HTML><head><title>T</title></head><body><header>Top</header><nav><a href=x>Menu</a></nav><div class="ad">Buy</div><article><h1>Head &amp; more</h1>
<p>First   <b>bold</b> text, <a href="y">a link</a>.<p>Second &lt;b&gt;.<aside>Side</aside><form>Name <input></form><script>if (a<b) "</p>"</script><div class='x comments'>Reader says</div><p>Last</article><footer>End</footer>"""
    rows = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "plain words only", "t"), (5, "u", "<p>" + "long text " * 50 + "<div class=ad>x</div><p>" + "more text " * 50, "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(rows).collect()}
    assert got[1].text == "Head & more First bold text, a link. Second <b>. Last"
    assert got[2].text == got[3].text == "" and got[4].text == "plain words only"
    assert got[5].text == ("long text " * 50 + "more text " * 50).strip()
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_statistics():
    t = "a b c d e f g h i\nx\n\nx\n " + "a b c d e f g h"
    s = dict(zip(quality.BASE, quality.statistics_of(t), strict=False))
    words = t.split()
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    want = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 8)}
    assert s == {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": 0, "n_dup_lines": 1, "n_repeat_words": len(want)}


def test_quality(odd, none, spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (9, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == len(ODD) and quality.judge(none, labels).count() == 0
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 6))
    kept = quality.keep(odd, labels)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in got if r.kept)
    assert quality.judge(odd, labels.limit(0)).where("kept").count() == 4


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1])) < 0.6).astype(float)
    f = train(x[:3000], y[:3000], [-1, 0, 0])
    assert ((f.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4), np.full(200, 0.5)], 1)
    assert (np.diff(f.margin(grid)) <= 1e-12).all()


def test_fingerprints(odd, none):
    got = fingerprints.edit_study(odd).collect()
    assert len(got) == len(ODD) and fingerprints.edit_study(none).count() == 0
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0)))  # equal doc_ids have equal texts here
    want = []
    for k, r in enumerate(order):
        t, n = text(r), text(order[(k + 1) % len(order)])
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        want.append((str(r[0]), len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(e)))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got)


def test_likeness_follows_shared_text():
    a, b = LONG[:9000], LONG[9000:18000]
    f = fingerprints.fingerprint
    assert fingerprints.likeness_of(f(a), f(a)) == 1
    assert fingerprints.likeness_of(f(a), f("shift " + a)) > 0.9
    assert fingerprints.likeness_of(f(a), f(b)) < fingerprints.likeness_of(f(a), f(a[:6000] + b[:3000])) < 0.9


def test_token_files(odd, none):
    files = token_files.write_token_files(odd, block_docs=2)
    got = token_files.read_token_files(files).collect()
    assert token_files.read_token_files(token_files.write_token_files(none)).count() == 0
    plain = library("byte_bpe_50k.json")
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for r in order:
        ids = np.append(plain.encode(text(r), add_special_tokens=False).ids, 2).astype("<u4")
        want.append((str(r[0]), at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(want) == sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got)
    keys = odd.sparkSession.createDataFrame([(3, 0), (3, 1), (4, 1), (12345, 0), (-1, 0), (None, 0), (2, 0)], "doc_id long, ordinal int")
    found = {(r.doc_id, r.ordinal): r.ids for r in token_files.find(files, keys).collect()}
    assert set(found) == {(3, 0), (4, 1), (2, 0)} and found[2, 0] == [2]
    assert zlib.crc32(np.array(found[3, 0], "<u4").tobytes()) == [w for w in want if w[0] == "3"][0][3]
    assert token_files.find(token_files.write_token_files(none), keys).count() == 0


def test_hot_and_extreme_ids(spark):
    """A third of all rows under one doc_id, a third without one, and the least long: found, in order, and dealt out over several ranges."""
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k - 2**63, f"text {k} " * (k % 5)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = token_files.write_token_files(df, block_docs=16)
    got = token_files.read_token_files(files).collect()
    assert len(got) == 600 and {r.shard for r in files.where("n_null > 0").collect()} != {r.shard for r in files.collect()}
    in_order = [r.doc_id for r in sorted(got, key=lambda r: (r.start, r.n_tokens))]
    assert in_order == [None] * 200 + sorted(k for k, _ in rows if k is not None)
    asked = df.select("doc_id").distinct()
    assert {r.doc_id for r in token_files.find(files, asked).collect()} == {k for k, _ in rows if k is not None}
    ids = spark.createDataFrame([(7, k) for k in range(200)], "doc_id long, ordinal long")
    sizes = sorted(r.n_tokens for r in got if r.doc_id == 7)
    again = token_files.find(files, ids).collect()
    assert sorted(r.ordinal for r in again) == list(range(200)) and sorted(r.n_tokens for r in again) == sizes
    studied = fingerprints.edit_study(df).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in studied) == sorted((k or 0, len(t)) for k, t in rows)
    by_text = {r.edited_sha256 for r in studied}
    assert len(by_text) > 300


def test_perfect_hash_is_minimal():
    keys = token_files.hashed_keys(np.arange(5000, dtype="<i8"), np.zeros(5000, "<u4"))
    assert sorted(token_files.PerfectHash.build(keys).slots(keys).tolist()) == list(range(5000))
