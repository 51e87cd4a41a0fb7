"""Token counts, quality, toxicity and licenses against brute force and on edge rows."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastra.llm import licenses, quality, token_counts, toxicity
from cadastra.llm.license_rules import RULES
from cadastra.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [(1, None), (2, ""), (3, " "), (4, "\n\t "), (5, "word"), (6, "a  b   c "), (7, "▁x▁▁y <s> é\x00"), (7, "word"), (None, "word"), (8, "x" * 200_000), (9, "one two three four five six seven eight nine " * 5000)]


def edge_rows(spark, n=None):
    # extra columns with the names of results
    rows = [(i, t, "clash", 1, 0.5, "q") for i, t in EDGES[:n]]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int, score double, in_text string")


def test_token_counts_are_the_library_s(spark, sf):
    sp = token_counts.model(MODEL)
    got = {r.doc_id: r for r in QUERIES["op1_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(sp.encode(d.text))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len(d.text.encode()), n > 4096)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ▁\n\té<s>🎉,"), max_size=40))
def test_cut_texts_count_as_whole_ones(text):
    frequent = token_counts.frequent_lengths(MODEL)
    assert token_counts.counted([text], frequent, MODEL) == [len(token_counts.model(MODEL).encode(text))]


def test_token_counts_of_edge_rows(spark):
    sp = token_counts.model(MODEL)
    got = token_counts.count_tokens(edge_rows(spark), MODEL).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(sp.encode(t or ""))) for i, t in EDGES)
    assert token_counts.count_tokens(edge_rows(spark, 0), MODEL).count() == 0


def test_the_sample_of_frequent_words_changes_no_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none, some = (sorted(map(tuple, token_counts.count_tokens(docs, MODEL, sample_rows=n).collect())) for n in (0, 50))
    assert none == some
    words = token_counts.frequent_words(docs, "text", 50)
    table, pieces = token_counts.frequent_lengths(MODEL, words), token_counts.frequent_lengths(MODEL)
    sp = token_counts.model(MODEL)
    assert set(words) | set(pieces) == set(table) and all(table[w] == len(sp.encode(w)) for w in words)
    assert any(table[w] > 1 for w in words) and "" not in table


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(repeated)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c ", "\n", " ", "x\n", "#|", "é"]), max_size=80).map(" ".join))
def test_base_counts_are_those_of_brute_force(text):
    assert quality.statistics(text)[0] == brute_statistics(text)


def test_quality_rules(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    registered = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, data).collect()}
    assert len(registered) == docs.count()
    for d in docs.collect():
        base, r = brute_statistics(d.text), registered[d.doc_id]
        assert [r[c] for c in quality.BASE] == base and r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not (r.base_failed and r.kept)
    forest = quality.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    out = quality.judge(docs, forest)
    for r in out.join(docs, "doc_id").collect():
        base = brute_statistics(r.text)
        assert [r[c] for c in quality.BASE] == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r.base_failed and r.kept)
    unseen = out.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")) & ~F.col("base_failed"))
    right, n = unseen.agg(F.sum((F.col("kept") == (labels["quality"] == 1)).cast("int")), F.count(F.lit(1))).first()
    assert right / n > 0.97


def test_quality_of_edge_rows(spark):
    forest = quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0), tuple(quality.FEATURES.values()))
    got = quality.judge(edge_rows(spark), forest).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.BASE)) for r in got) == Counter((i, *brute_statistics(t)) for i, t in EDGES)
    assert quality.judge(edge_rows(spark, 0), forest).count() == 0


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.6 * rng.random(600) > 0.8).astype(float)
    forest = quality.grow(x, y, (1, -1, 0))
    base = rng.random((50, 3))
    for column, sign in ((0, 1), (1, -1)):
        steps = [forest.margin(np.column_stack([np.full(50, v) if i == column else base[:, i] for i in range(3)])) for v in np.linspace(0, 1, 21)]
        assert (sign * np.diff(steps, axis=0) >= -1e-12).all()


def test_flat_scoring_is_a_walk_of_each_tree():
    rng = np.random.default_rng(8)
    x = np.round(rng.random((400, 4)), 1)  # ties at thresholds
    forest = quality.grow(x, (x[:, 0] > x[:, 1]).astype(float), (0, -1, 1, 0), trees=12)

    def walk(row, at):
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        return forest.value[at]

    want = [forest.base + sum(walk(row, at) for at in forest.roots) for row in x]
    assert np.allclose(forest.margin(x), want) and np.allclose(forest.score(x), 1 / (1 + np.exp(-np.array(want))))


def test_risk_and_gradient_are_those_of_a_direct_computation():
    rng = np.random.default_rng(2)
    p, u = rng.random((9, 3)) < 0.6, rng.random((14, 3)) < 0.4
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(float) for x in (p, u))
    signs = set()
    for w in (np.array([0.3, -0.2, 0.1, -0.5]), np.array([2.0, 2.0, 2.0, 1.0])):
        loss = lambda rows, w, sign: sum(np.log(1 + np.exp(-sign * sum(a * b for a, b in zip(r, w)))) for r in rows) / len(rows)
        parts = lambda w: (0.7 * loss(p, w, 1), loss(u, w, -1) - 0.7 * loss(p, w, -1))
        assert np.allclose(toxicity.risk_parts(p, u, w, 0.7), parts(w))
        signs.add(parts(w)[1] >= 0)
        aim = (lambda w: sum(parts(w))) if parts(w)[1] >= 0 else (lambda w: -parts(w)[1])
        want = [(aim(w + e) - aim(w - e)) / 2e-6 for e in np.eye(4) * 1e-6]
        assert np.allclose(toxicity.gradient(p, u, w, 0.7), want, atol=1e-6)
    assert signs == {True, False}


def test_a_repeated_id_is_bounded(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("vile text "), (F.col("id") % 7).cast("string")).alias("text"))
    other = spark.range(2, 400).select("id", F.concat(F.lit("fine text "), F.col("id").cast("string")))
    docs, labels = rows.union(other), spark.range(1, 400).select(F.col("id").alias("doc_id"), (F.col("id") == 1).cast("int").alias("toxic"), (F.col("id") % 2).cast("int").alias("quality"))
    model = toxicity.fit(docs, labels, least_z=0.5, least_purity=1e-9)
    assert toxicity.score(docs, model).count() == docs.count()
    assert len(toxicity.fit(docs, labels, positives=3, unlabelled=5).features) <= 512
    assert quality.judge(docs, quality.fit(docs, labels, sample=50)).count() == docs.count()


def test_toxicity_finds_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    out = QUERIES["op5_toxicity"](spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    hit, toxic, wrong, clean = (
        out.join(labels, "doc_id").where("held_out").agg(F.sum(F.expr("int(toxic = 1 and predicted = 1)")), F.sum("toxic"), F.sum(F.expr("int(toxic = 0 and predicted = 1)")), F.sum(1 - F.col("toxic"))).first()
    )
    assert hit / toxic > 0.85 and wrong / clean < 0.02
    assert out.where("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").count() == 0


def test_toxicity_of_edge_rows(spark):
    docs = edge_rows(spark)
    model = toxicity.fit(docs, spark.createDataFrame([(5, 1), (None, 1), (6, None), (9, 0)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGES)
    # a text without words scores by the bias alone; others by what they hold
    alone = float(toxicity.logistic(np.array(model.bias)))
    assert all(abs(r.score - alone) < 1e-9 for r in got if r.doc_id in (1, 2, 3, 4))
    text = dict(EDGES[4:6])
    for r in got:
        if r.doc_id in text and r.doc_id is not None:
            z = model.bias + sum(model.weights[k] for k in {i for w in toxicity.words_of(text[r.doc_id]) for i in model.found(w)})
            assert abs(r.score - float(toxicity.logistic(np.array(z)))) < 1e-9
    assert toxicity.score(edge_rows(spark, 0), model).count() == 0
    nothing = toxicity.fit(edge_rows(spark, 0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, nothing).count() == len(EDGES)


def test_nnpu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    x = (rng.random((4000, 6)) < np.where(truth[:, None], [0.8, 0.7, 0.3, 0.3, 0.3, 0.3], [0.02, 0.02, 0.3, 0.3, 0.3, 0.3])).astype(np.float32)
    w, b = toxicity.fit_nnpu(x[truth][:300], x, 0.2)
    right = ((x @ w + b > 0) == truth).mean()
    assert right > 0.93


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    norm, found = " " + " ".join(words) + " ", []
    for r in RULES:
        if f" {r.keyword} " in norm:
            for m in re.finditer(r.regex, norm):
                first = norm[: m.start()].count(" ") - 1
                found.append((first, first + m[0].count(" "), r.label, r.priority, r.order))
    kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[3], e[1] - e[0], -e[4]) > (d[3], d[1] - d[0], -d[4]) for e in found)]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[2] for d in kept})), sorted(kept)


def test_license_scan(spark):
    texts = [
        "Released under the MIT License. Cc by nc, CC-BY-NC 4.0, apache license version 2.0; gnu lesser general public license version 2.1",
        "cc by nc cc by nc", "MIT", "no license here", "x " * 100 + "under the mit license", "all rights reserved copyright 2020 é license", *(t for _, t in EDGES),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for rows in (df, docs):
        text_of = {r.doc_id: r.text for r in rows.collect()}
        for r in licenses.scan(rows).collect():
            got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, sorted(tuple(d) for d in r.detections))
            assert got == brute_licenses(text_of[r.doc_id]), r.doc_id
        if rows is docs:
            plain = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in QUERIES["op7_license_scan"](spark, "/root/testdata/sf0.01").collect()}
            assert plain == {i: brute_licenses(t)[:6] for i, t in text_of.items()}
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_scan_of_many_mentions(spark):
    rng = np.random.default_rng(6)
    some = ["mit license", "the mit license", "released under the mit license", "apache license version 2 0", "gpl", "gnu general public license", "word", "cc by nc", "license"]
    texts = [" ".join(rng.choice(some, 900)), "Mit License and more " * 20_000]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        if r.doc_id == 0:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, sorted(tuple(d) for d in r.detections)) == brute_licenses(texts[0])
        else:
            assert len(r.detections) == 20_000 and r.labels == "mit"


def expansions(tree):
    """All texts of a parsed pattern, repeats once or not at all, classes by one of their characters."""
    texts = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            step = [chr(arg)]
        elif name == "SUBPATTERN":
            step = expansions(arg[3])
        elif name == "BRANCH":
            step = [t for branch in arg[1] for t in expansions(branch)]
        elif name == "MAX_REPEAT":
            step = ([""] if arg[0] == 0 else []) + expansions(arg[2])
        elif name == "IN":
            step = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        else:
            assert name == "NOT_LITERAL", name
            step = ["x"]
        texts = [a + b for a in texts for b in step]
    return texts


def test_each_match_of_a_rule_holds_its_keyword():
    lost = [(r.label, r.keyword, t) for r in RULES for t in expansions(re._parser.parse(r.pattern)) if f" {r.keyword} " not in f" {t} "]
    assert lost == []


def ungated_licenses(text):
    """The detections of ``brute_licenses`` without its look at keywords."""
    norm, found = f" {text} ", []
    for r in RULES:
        for m in re.finditer(r.regex, norm):
            first = norm[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), r.label, r.priority, r.order))
    return sorted(d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[3], e[1] - e[0], -e[4]) > (d[3], d[1] - d[0], -d[4]) for e in found))


def test_license_scan_loses_nothing_by_the_keywords(spark):
    texts = [t for r in RULES for t in expansions(re._parser.parse(r.pattern))]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert sorted(tuple(d) for d in r.detections) == ungated_licenses(texts[r.doc_id]), texts[r.doc_id]
    lost = [("zero clause bsd license", "0bsd"), ("creative commons zero", "cc0"), ("you may not use this file except in compliance with the license", "apache-2"), ("licensed under the gnu library general public license", "lgpl")]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(lost, "text string, doc_id string")).collect()}
    assert all(label in labels for label, labels in got.items())
