"""Line quality, hard negatives and ranked search against brute force, their SQL and on edge rows."""

import itertools
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import hard_negatives, line_quality, ranked_search
from cadastra.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "one two\nthree"), (4, "one two\nthree"), (None, "two Two é"), (5, "x " * 200_000), (6, "\n" * 3000), (7, "ÀB1-b\x002 İ ſ K"), (8, "two")]


def edge_rows(spark, n=None):
    rows = [(i, t, "clash", 1, 0.5, 2, "q") for i, t in EDGES[:n]]
    return spark.createDataFrame(rows, "doc_id long, text string, term string, rank int, score double, block int, in_text string")


def in_duckdb(name, *tables):
    with duckdb.connect() as con:
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        rel = con.sql(ORACLE_SQL[name])
        return sorted(rel.columns), sorted(map(tuple, rel.select(*sorted(rel.columns)).fetchall()))


def of_spark(df):
    return sorted(df.columns), sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


# line quality


def brute_marginals(odds, step):
    """Chances and expected steps by going through all label sequences."""
    weights = {}
    for y in itertools.product((0, 1), repeat=len(odds)):
        weights[y] = math.exp(sum(o for o, v in zip(odds, y) if v) + sum(step[a, b] for a, b in zip(y, y[1:])))
    total = sum(weights.values())
    steps = np.zeros((2, 2))
    for y, w in weights.items():
        for a, b in zip(y, y[1:]):
            steps[a, b] += w / total
    return [sum(w for y, w in weights.items() if y[i]) / total for i in range(len(odds))], steps, math.log(total)


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    counts = np.array([1, 5, 2, 7, 1])
    odds, step = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2))
    good, steps, total = line_quality.marginals(odds, step, counts)
    want = [brute_marginals(part, step) for part in np.split(odds, np.cumsum(counts)[:-1])]
    assert np.allclose(good, np.concatenate([w[0] for w in want]))
    assert np.allclose(steps, sum(w[1] for w in want))
    assert np.allclose(total, [w[2] for w in want])


def test_the_likelihood_s_gradient_is_its_slope():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 4])
    x, y = rng.normal(size=(8, 5)), rng.integers(0, 2, 8).astype(float)
    w, step = rng.normal(size=5), rng.normal(size=(2, 2))
    _, gw, gs = line_quality.likelihood(x, y, counts, w, step)
    near = lambda i, j: line_quality.likelihood(x, y, counts, w + i, step + j)[0]
    for k in range(5):
        move = np.eye(5)[k] * 1e-5
        assert abs((near(move, 0) - near(-move, 0)) / 2e-5 - gw[k]) < 1e-6
    for k in range(4):
        move = np.eye(4)[k].reshape(2, 2) * 1e-5
        assert abs((near(0, move) - near(0, -move)) / 2e-5 - gs.ravel()[k]) < 1e-6


def test_long_chains_stay_finite():
    good, _, total = line_quality.marginals(np.tile([800.0, -800.0], 5000), np.array([[9.0, -9], [-9, 9]]), np.array([10_000]))
    assert np.isfinite(good).all() and np.isfinite(total).all() and good[0] > 0.99 and good[1] < 0.01


def brute_repeats(words, window=8):
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    return [any(seen[tuple(words[i : i + window])] > 1 for i in range(max(0, j - window + 1), min(j, len(words) - window) + 1)) for j in range(len(words))]


def test_line_statistics():
    rng = np.random.default_rng(5)
    for _ in range(20):
        words = rng.integers(0, 3, rng.integers(0, 60))
        assert line_quality.in_repeats(words).tolist() == brute_repeats(words.tolist())
    stats, lengths = line_quality.line_statistics("A b b.\n\nA b b.\nX! ||")
    names = list(line_quality.BANDS)
    assert lengths.tolist() == [6, 0, 6, 5]
    at = lambda i, name: stats[i, names.index(name)]
    assert [at(i, "words") for i in range(4)] == [3, 0, 3, 2] and at(0, "stutter_share") == 0  # "b" isn't "b."
    assert (at(0, "seen_before"), at(2, "seen_before"), at(3, "exclamations_per_word"), at(3, "bars_per_word"), at(1, "lines"), at(1, "text_words")) == (0, 1, 0.5, 1, 4, 8)
    x = line_quality.features(stats, np.array([4]))
    one = line_quality.FEATURES // 3
    assert (x[0, :one] == 0).all() and (x[-1, one : 2 * one] == 0).all() and (x[1, :one] == x[0, 2 * one :]).all() and (x[1, one : 2 * one] == x[2, 2 * one :]).all()


def test_line_quality_finds_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op11_line_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    got = rows.join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) > 50 and good.predicted.mean() > 0.995 and bad.predicted.mean() < 0.05
    ranks = got.score.rank()
    area = (ranks[got.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert area > 0.99
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    # a field of its own scores each text as the batch does
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    field = line_quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for d, r in zip(docs.orderBy("doc_id").collect(), line_quality.score(docs, field).orderBy("doc_id").collect()):
        stats, lengths = line_quality.line_statistics(d.text)
        good, _, _ = brute_or_chain(line_quality.features(stats, np.array([len(stats)])) @ field.weights, field.step)
        share = np.clip((good * (lengths + 1)).sum() / (lengths + 1).sum(), 1e-4, 1 - 1e-4)
        z = field.curve[0] + field.curve[1] * np.log(share / (1 - share))
        assert abs(1 / (1 + np.exp(-z)) - r.score) < 1e-4 and (r.n_lines, r.n_good_lines) == (len(stats), (good > 0.5).sum())


def brute_or_chain(odds, step):
    if len(odds) <= 12:
        return (np.array(v) for v in brute_marginals(odds.tolist(), step))
    return line_quality.marginals(odds, step, np.array([len(odds)]))


def test_line_quality_of_edge_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (8, 1), (6, None), (None, 0)], "doc_id long, quality int")
    field = line_quality.fit(edge_rows(spark), labels)
    got = line_quality.score(edge_rows(spark), field).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGES)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score and by[1].n_lines == 1 and by[6].n_lines == 3001 and by[3].n_lines == 2
    assert line_quality.score(edge_rows(spark, 0), field).count() == 0
    nothing = line_quality.fit(edge_rows(spark, 0), labels.limit(0))
    assert {r.score for r in line_quality.score(edge_rows(spark), nothing).collect()} == {0.5}


def test_one_text_with_many_labels_is_one_example(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b\n" * 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    assert np.isfinite(line_quality.fit(docs, labels, longest=3).weights).all()


# hard negatives


def brute_negatives(rows, anchor, positives=5, negatives=5, low=80):
    """rows: (id, label, vector) that take part, each once."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for a, own, q in whole:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, label, v in whole if i != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == own][:positives]:
            allowed = [x for x in scored if x[2] != own and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, rank + 1, i, -s, -n) for rank, (n, i, _) in enumerate(allowed)]
    return sorted(out)


def of_mine(df, **how):
    out = hard_negatives.mine(df, "id % 3 = 0", **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("seed", [0, 1])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, seed):
    # several pivots, blocks and chunks
    for name, value in {"BLOCK": 16, "CHUNK": 8, "GROUP": 2}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 4))
    rows = [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 6)] * rng.uniform(0.2, 2) + rng.normal(size=4) * 0.2).round(1).tolist()) for i in range(150)]
    rows += [(200 + i, i % 2, rows[0][2]) for i in range(30)]  # copies, and ties of all
    df = spark.createDataFrame([(i, v, y) for i, y, v in rows], "vec_id long, embedding array<double>, label int")
    want = brute_negatives(rows, lambda i: i % 3 == 0)
    assert len(want) > 200
    assert of_mine(df) == want
    assert of_mine(df, positives=2, negatives=3, low=50) == brute_negatives(rows, lambda i: i % 3 == 0, 2, 3, 50)


def test_negatives_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.9]), (2, 2, [1.0, 1.8]), (3, 2, [-1.0, -2.0]), (6, 3, [1.0]), (7, 3, [1.0]), (8, 4, [1.0]), (9, 5, []), (10, 5, []), (11, 6, []), (12, 1, [0.0, 0.0])]
    rows = [*sound, sound[0], (13, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (14, 1, None), (15, 1, [1.0, None]), (15, 1, [nan, 1.0]), (18, 1, [inf, 1.0])]
    df = spark.createDataFrame([(i, v, y, "c", 3) for i, y, v in rows], "vec_id long, embedding array<double>, label int, id string, dim int")
    want = brute_negatives(sound, lambda i: i % 3 == 0)
    assert {w[:2] for w in want} >= {(0, 1), (6, 7), (9, 10)}
    assert of_mine(df) == want
    assert of_mine(df.limit(0)) == [] and of_mine(df.where("vec_id = 14")) == []
    named = df.withColumn("label", F.concat(F.lit("é"), F.col("label").cast("string")))
    assert of_mine(named) == want
    assert of_mine(df.where("vec_id = 0")) == []


def test_negatives_of_extreme_sizes(spark):
    rows = [(i, i % 2, [10.0 ** (i % 5), -(10.0 ** (i % 3))]) for i in range(12)]
    df = spark.createDataFrame([(i, v, y) for i, y, v in rows], "vec_id long, embedding array<double>, label int")
    assert of_mine(df) == brute_negatives(rows, lambda i: i % 3 == 0)


def test_negatives_query_is_its_sql(spark):
    want = in_duckdb("op12_hard_negatives", "embeddings")
    assert len(want[1]) > 50 and of_spark(QUERIES["op12_hard_negatives"](spark, SF)) == want


# ranked search


def brute_ranks(docs, items, k=50):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for i, b in bags:
            m = 50 + 50 * b.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * m)) for t in asked if b[t])
            if score > 0:
                scores.append((-score, i if i is not None else -1, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return Counter(out)


@pytest.mark.parametrize("broadcast", [0, 1000])
@pytest.mark.parametrize("block", [2, 1024])
def test_ranks_of_edge_rows(spark, broadcast, block):
    items = [(1, "TWO é one"), (1, "x two"), (2, None), (3, "?!"), (None, "b1 k 2"), (4, "nowhere"), (5, "àb1 i̇ ſ ÀB1 K")]
    asked = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id int, text string, doc_id string, score int")
    got = ranked_search.search(edge_rows(spark), asked, k=3, broadcast=broadcast, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_ranks(EDGES, items, 3)
    assert len(want) >= 5 and Counter(map(tuple, got.collect())) == want
    assert ranked_search.search(edge_rows(spark, 0), asked, broadcast=broadcast).count() == 0
    assert ranked_search.search(edge_rows(spark), asked.limit(0), broadcast=broadcast).count() == 0


def test_long_texts_count_the_same(monkeypatch):
    text = ("Ab é-" * 1000).encode()
    whole = ranked_search.counted(text)
    monkeypatch.setattr(ranked_search, "LONG", 10)
    assert ranked_search.counted(text) == whole == Counter({b"ab": 1000, "é".encode(): 1000})


def test_search_query_is_its_sql(spark):
    want = in_duckdb("op13_ranked_search", "documents", "benchmark")
    assert len(want[1]) > 1000 and of_spark(QUERIES["op13_ranked_search"](spark, SF)) == want


def test_matches_are_summed_where_they_arise(spark, monkeypatch):
    plans = []
    keep = ranked_search.durable
    monkeypatch.setattr(ranked_search, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    QUERIES["op13_ranked_search"](spark, SF)
    exchanges = [x for x in plans[-1].splitlines() if re.search(r"Exchange hashpartitioning", x)]
    # postings by block, the best of each block by item; items' terms are broadcast
    assert len([x for x in exchanges if "block" in x]) == 1 and len([x for x in exchanges if "item" in x]) == 1 and "WindowGroupLimit" in plans[-1]
