"""The hidden Markov model, runs of words and the trie of conversations against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.llm import hmm, periods, queries, trie
from tests.conftest import DATA

# ---- op11


def plain_likelihood(model, codes):
    """The sum over all paths of states, in plain numbers."""
    now = [p for p in model.start]
    for k, c in enumerate(codes):
        if k:
            now = [sum(now[i] * model.move[i][j] for i in range(len(now))) for j in range(len(now))]
        now = [a * model.emit[c][j] for j, a in enumerate(now)]
    return sum(now)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 4)
    monkeypatch.setattr(hmm, "GROUP", 30)
    rng = np.random.default_rng(5)
    even = lambda *shape: (x := rng.random(shape) + 0.05) / x.sum(-1, keepdims=True)
    return hmm.Model(even(3), even(3, 3), even(3, 8).T), rng


def test_likelihood_equals_sum_over_paths(small):
    model, rng = small
    texts = [rng.integers(0, 8, n) for n in (1, 2, 4, 5, 8, 9, 23, 3)]
    got = hmm.log_likelihoods(model, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert got == pytest.approx([math.log(plain_likelihood(model, t)) for t in texts], rel=1e-9)


def test_expected_counts_equal_plain_forward_backward(small):
    model, rng = small
    texts = [rng.integers(0, 8, n) for n in (1, 4, 5, 8, 13, 2)]
    counts = np.zeros((8, 3))
    starts, moves = hmm.expected_counts(model, np.concatenate(texts), np.array([len(t) for t in texts]), counts)
    want, first, steps = np.zeros((8, 3)), np.zeros(3), np.zeros((3, 3))
    for t in texts:
        a = [model.start * model.emit[t[0]]]
        for c in t[1:]:
            a.append(a[-1] @ model.move * model.emit[c])
        b = [np.ones(3)]
        for c in t[:0:-1]:
            b.insert(0, model.move @ (model.emit[c] * b[0]))
        whole = a[-1].sum()
        for k, c in enumerate(t):
            want[c] += a[k] * b[k] / whole
            if k:
                steps += np.outer(a[k - 1], model.emit[c] * b[k]) * model.move / whole
        first += a[0] * b[0] / whole
    assert counts == pytest.approx(want) and starts == pytest.approx(first) and moves == pytest.approx(steps)


def base_scores(rows):
    """The base score and known tokens by a plain loop: rows are (id, text)."""
    words = {k: (t or "").encode().lower().split() for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, ws in words.items() if not held[k] for w in [*ws, None])
    total, distinct = sum(c.values()), len(c)
    found = []
    for k, (i, _) in enumerate(rows):
        tokens = [*words[k], None]
        found.append((i, held[k], len(tokens), sum(c[w] > 0 for w in tokens), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens)))
    return found


def test_scores_of_the_supplied_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op11_hmm(spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, held, tokens, known, total, base in base_scores(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, total)
        assert r.base_score == pytest.approx(base)


def test_model_helps_on_held_out_documents(spark):
    got = queries.op11_hmm(spark, DATA.replace("0.001", "0.01")).where("held_out")
    assert got.agg(F.avg((F.col("score") > F.col("base_score")).cast("int")), F.sum("score") - F.sum("base_score")).first()[0] > 0.9


def test_scores_follow_model_and_counts(spark):
    """Each score equals the plain sum over paths, with words' shares of their classes from plain counts."""
    rows = [(k, " ".join(random.Random(k).choices(["a", "B", "cc", "dd", "the", f"w{k}"], k=k % 9))) for k in range(40)]
    blocks = hmm.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = hmm.train(blocks, states=2, rounds=2)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in t.lower().encode().split())
    in_class = Counter()
    for w, n in c.items():
        in_class[zlib.crc32(w) % hmm.CLASSES] += n
    unseen = (sum(n == 1 for n in c.values()) + 1) / hmm.CLASSES
    assert got.unseen == unseen
    assert got.model.emit.sum(0) == pytest.approx(1) and got.model.move.sum(1) == pytest.approx(1)
    for r in hmm.score(blocks, got).collect():
        words = rows[int(r.id)][1].lower().encode().split()
        codes = [zlib.crc32(w) % hmm.CLASSES for w in words]
        p = plain_likelihood(got.model, [*codes, hmm.CLASSES])
        for w, k in zip(words, codes):
            p *= (c[w] or unseen) / (in_class[k] + unseen)
        assert r.score == pytest.approx(math.log10(p))


def test_scores_of_odd_rows(spark):
    odd = [(1, None, "x"), (2, "", "x"), (None, "A a", "y"), (3, "a b", None), (3, "a b", None), (4, "a " * 3000, "z")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, score string")
    got = hmm.score_texts(docs).orderBy("doc_id", "n_tokens").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3001)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    want = {(i, n): b for i, _, n, _, _, b in base_scores([(i, t) for i, t, _ in odd])}
    assert all(r.base_score == pytest.approx(want[r.doc_id, r.n_tokens]) for r in got)
    assert hmm.score_texts(docs.limit(0)).count() == 0
    none_learned = hmm.score_texts(docs, held=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none_learned)


# ---- op12


def plain_runs(w):
    found, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                found.add((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_the_supplied_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periods(spark, DATA).collect()}
    assert len(got) == len(rows)
    # plain periods cost n^2 / 8 a text
    assert all(got[r.doc_id] == plain_row(r.doc_id, r.text) for r in rows if r.text is None or len(r.text) < 20_000)
    assert sum(r[1] > 0 for r in got.values()) > 5


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            n, kinds = rnd.choice([0, 5, 6, 30, 150]), rnd.choice([1, 2, 3, 20])
            w = [rnd.randrange(kinds) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n else 0):
                a = rnd.randrange(n)
                p, e = rnd.randint(1, 1 + (n - a) // 3), rnd.randint(a, n)
                w[a:e] = [w[a + (i - a) % p] for i in range(a, e)]
            texts.append(w)
        got = periods.runs([np.array(w, np.int32) for w in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(w) for w in texts]


def test_grammar_extensions():
    rnd = np.random.default_rng(2)
    w = np.concatenate([[-1], rnd.integers(0, 2, 90), [-2], np.zeros(40, int), [-3]])
    grammar = periods.Grammar(w)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(1, 91), np.arange(1, 91)))
    x, y = x[x != y], y[x != y]
    for step in (1, -1):
        want = []
        for i, j in zip(x, y):
            k = 0
            while w[i + step * k] == w[j + step * k] and w[i + step * k] >= 0:
                k += 1
            want.append(k)
        assert grammar.extension(x, y, step).tolist() == want


def test_large_grid_in_parts(monkeypatch):
    monkeypatch.setattr(periods, "GRID", 50)
    monkeypatch.setattr(periods, "QUERIES", 7)
    w = [k % 5 for k in range(120)] + [1, 2] * 30
    assert [tuple(r) for r in periods.runs([np.array(w, np.int32)])[0].tolist()] == plain_runs(w)


def test_runs_of_odd_rows(spark):
    odd = [(1, None, 1), (2, "", 2), (None, "a b " * 9, 3), (3, "x y " * 8 + "\t\n z", 4), (3, "x y " * 8 + "\t\n z", 4), (4, "w " * 50_000, 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, n_runs int")
    got = periods.find(docs.withColumnRenamed("n_runs", "extra"), collapse_col="short").orderBy("extra").collect()
    assert [(r.doc_id, r.n_runs, r.period, r.exponent_milli, r.short) for r in got] == [
        (1, 0, None, None, ""), (2, 0, None, None, ""), (None, 1, 2, 9000, "a b"), (3, 1, 1, 8000, "x y z"), (3, 1, 1, 8000, "x y z"), (4, 1, 1, 50_000_000, "w"),
    ]
    assert periods.find(docs.limit(0)).count() == 0


# ---- op13


def plain_trie(turns):
    """turns: (conv, turn, role, text) with at most one row for each turn."""
    own = defaultdict(list)
    for c, t, role, text in sorted((r for r in turns if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        ends[whole[c]].append(c)
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return sorted(((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p], sha(p)) for p, cs in members.items()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


def many_turns():
    rnd = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(95, 130), *range(200, 203), 307, -5, -101, 1 << 40]:
        same = rnd.random() < 0.4
        for t in range(rnd.choice([1, 2, 5, 7, 9])):
            rows.append((c, t if t else None, rnd.choice(["user", None]) if not same else "user", f"t{t}" if same else rnd.choice(["x", "yy", None, ""])))
    return rows + [(400, t, "user", f"long {t}") for t in range(150)] + [(401, t, "user", f"long {t}" if t < 120 else "other") for t in range(140)]


@pytest.mark.parametrize("least, parts, messages", [(100_000, 4, 1 << 18), (60, 7, 3), (1, 4, 1), (7, 13, 2)])
def test_trie_against_plain_version(spark, monkeypatch, least, parts, messages):
    monkeypatch.setattr(trie, "MESSAGES", messages)
    monkeypatch.setattr(trie, "ENDS", 3)
    monkeypatch.setattr(trie.math, "isqrt", lambda _: least)
    turns = many_turns()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows_of(trie.prefix_trie(spark.createDataFrame(turns, TURNS).repartition(3), rebuild=True, least=least))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_trie(turns)


def test_queue_spills_in_order():
    rnd = random.Random(1)
    queue, kept = trie.Messages(limit=4), []
    for level in range(-9, 0):
        for _ in range(30):
            m = (rnd.randint(level, 0), bytes([rnd.randrange(3)]), rnd.randrange(9), 0)
            queue.push(m)
            kept.append(m)
        for key in range(3):
            place = (level, bytes([key]))
            assert sorted(queue.take(place)) == sorted(m for m in kept if m[:2] == place)
            kept = [m for m in kept if m[:2] != place]


def test_trie_of_odd_rows(spark):
    turns = [(1, None, None, None), (1, 0, "user", "hi"), (None, 3, "user", "hi"), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (3, 5, "user", "z" * 100_000)]
    rows = spark.createDataFrame([(*t, k, 7) for k, t in enumerate(turns)], TURNS + ", key int, level int")
    assert rows_of(trie.prefix_trie(rows, rebuild=True)) == plain_trie(turns)
    assert trie.prefix_trie(rows.limit(0), rebuild=True).count() == 0
    # without rebuilding: root, "", "" hi, hi, hi hi, z
    plain = trie.prefix_trie(rows)
    assert plain.count() == 6 and plain.where("depth = 0").first().n_convs == 3
