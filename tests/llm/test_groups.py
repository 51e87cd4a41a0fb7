"""Packing, near-duplicates, mixing, url rules, shards and the pipeline against brute force and on edge rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadastra.llm import mixing, ngram_join, packing, sharding, url_filter, vector_dedup
from cadastra.llm.common import components, durable
from cadastra.llm.queries import QUERIES, packed

EDGES = [(1, None, None), (2, "", "s"), (3, " ", "s"), (4, "a b", "s"), (4, "a b", "s"), (5, "a b", None), (None, "a b", "t"), (None, None, "t"), (6, "w " * 30_000, "s")]


def edge_rows(spark, n=None):
    rows = [(i, t, "en", s, 1, 9, "clash") for i, t, s in EDGES[:n]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece int, component_id string")


def check_packing(rows, texts):
    """The contract: every token of every document once, in pieces, in gapless sequences."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for key, text in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        head = len(ids) % 2048 or 2048
        for i, (lo, hi) in enumerate(zip([0, *range(head, len(ids), 2048)], range(head, len(ids) + 1, 2048))):
            want[(key, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 2048) * 1.02 + 1


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_packing(QUERIES["op3_best_fit_packing"](spark, "/root/testdata/sf0.01").collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_packing_takes_special_strings_as_the_library_does(spark):
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3000), (3, "<|endoftext"), (4, " " * 30_000 + "<|endoftext|>")]
    check_packing(packed(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)


def test_packing_of_edge_rows(spark):
    check_packing(packed(edge_rows(spark)).collect(), [(i, t) for i, t, _ in EDGES])
    assert packed(edge_rows(spark, 0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1'\n\t\x1c é<|endoftext|>🎉,s"), max_size=60))
def test_both_libraries_give_one_encoding(text):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.encode(text, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert got.tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.sampled_from(["norm", "dot"]), st.integers(3, 64), st.integers(700, 4096))
def test_placement_respects_every_capacity(counts, score, documents, attention):
    counts = {n: k for n, k in counts.items() if n * n <= attention}
    steps = packing.place(counts, packing.Packing(64, documents, attention, score=score))
    bins = defaultdict(list)
    placed = Counter()
    for i, n in enumerate(steps.length):
        last = min([int(r) for r, m in zip(steps.rank, steps.length) if m == n and r > steps.rank[i]], default=counts[int(n)])
        for rank in range(int(steps.rank[i]), last):
            nth, inside = divmod(rank - int(steps.rank[i]), int(steps.each[i]))
            bins[int(steps.bin[i]) + nth].append((int(steps.offset[i]) + inside * int(n), int(n)))
            placed[int(n)] += 1
    assert placed == Counter(counts) and len(bins) == steps.bins
    for held in bins.values():
        assert sum(n for _, n in held) <= 64 and len(held) <= documents and sum(n * n for _, n in held) <= attention
        ends = sorted((o, o + n) for o, n in held)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def brute_links(rows):
    """(id, size of its set, component, links) of each row."""
    sets = []
    for key, text in rows:
        words = (text or "").encode().lower().split()
        sets.append((key, {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())))
    parent, near = list(range(len(sets))), [0] * len(sets)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
                near[i] += 1
                near[j] += 1
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((key, len(s), least.get(find(i), key), near[i]) for i, (key, s) in enumerate(sets))


def near_copies(seed, families=8, members=9):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    passage = " ".join(word() for _ in range(40))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 5, 12, 60, 120]))]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) + (" " + passage if rng.random() < 0.4 else ""))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("width", "block"), [(32, 1024), (2, 4), (3, 2)])
def test_ngram_join_is_brute_force(spark, monkeypatch, seed, width, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies(seed)
    rows += [(len(rows) + i, rows[i][1]) for i in range(20)] + [(i, t) for i, t, _ in EDGES]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert Counter(map(tuple, got)) == brute_links(rows)


def test_ngram_join_of_a_family_that_hardly_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join(rng.choice(["x", "y", "z"]) if rng.random() < rng.choice([0.005, 0.03]) else w for w in base) for _ in range(150)]
    rows = [(i, t + f" {i} end" * (i % 3)) for i, t in enumerate(texts)]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), width=8).collect()
    assert Counter(map(tuple, got)) == brute_links(rows)


def test_ngram_join_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op4_ngram_join"](spark, sf).collect()
    assert Counter(map(tuple, got)) == brute_links([(r.doc_id, r.text) for r in docs.collect()])


def test_ngram_join_of_edge_rows(spark):
    got = ngram_join.link(edge_rows(spark)).collect()
    assert Counter(map(tuple, got)) == brute_links([(i, t) for i, t, _ in EDGES])
    assert ngram_join.link(edge_rows(spark, 0)).count() == 0


@pytest.mark.parametrize("dense", [1, 50, 10**9])
def test_overlaps_are_intersections(monkeypatch, dense):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 1 + 40 * (i % 4), 30).astype(np.uint64)) for i in range(n)] for n in (23, 17))
    assert (ngram_join.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def test_mixing_draws_its_rates(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "rare", "x") for i in range(6000)], "doc_id long, source string, copies string")
    out = mixing.mix(df, {"rare": 0.5}, 0.5, size=1.0)
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(n["rare"] - 3000) < 250 and abs(n["hot"] - 3000) < 250
    per = {r[0]: r[1] for r in out.where("source = 'rare'").select("doc_id", "copies").distinct().groupBy("copies").count().collect()}
    assert abs(per[1] / 2000 - 1.5 * np.exp(-1.5)) < 0.04
    assert out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("c"), F.max("copy").alias("l")).where("n <> c or l <> c - 1").count() == 0
    assert Counter(out.collect()) == Counter(mixing.shuffled(out).collect())


def test_mixing_of_edge_rows(spark):
    df = edge_rows(spark)
    out = mixing.shuffled(mixing.mix(df, {"s": 0.9}, 0.1, size=40.0))
    rows = out.collect()
    assert {(r.doc_id, r.text) for r in rows} <= {(i, t) for i, t, _ in EDGES} and len(rows) > 100
    # each drawn row is there as often as it says, numbered from 0
    drawn = Counter((r.doc_id, r.text, r.source, r.copies, r.copy) for r in rows)
    for (i, t, s, copies, copy), times in drawn.items():
        assert copy < copies and times == drawn[i, t, s, copies, 0] <= EDGES.count((i, t, s))
    assert mixing.mix(edge_rows(spark, 0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.floats(0.01, 64))
def test_poisson_terms_reach_one(rate):
    cdf = mixing.poisson_cdf(rate)
    assert cdf[-1] > 1 - 1e-9 and all(a <= b for a, b in zip(cdf, cdf[1:]))


def test_url_classes(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.org/x", link.format("http://b.net/fr/y")),  # alias of a blocked url
        (2, "http://c.org/x", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'),  # and on
        (3, "http://d.org/x", link.format("http://e.com/") + link.format("http://b.net/fr/z")),  # allow before block
        (4, "HTTP://WWW.Example.COM/en/p?q#f", None), (5, "http://m.example.com/en/p", ""), (6, "http://example.com", ""), (7, "no scheme", link.format("http://b.net/fr/y")),
        (8, None, None), (9, "http://b.net/fr/y", link.format("/fr/other")), (9, "http://b.net/fr/y", None), (None, "http://a.org/x", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect())
    assert got == Counter([
        (1, "a.org", "/x", None, "block"), (2, "c.org", "/x", None, "block"), (3, "d.org", "/x", None, "allow"), (4, "www.example.com", "/en/p", "www.example.com/en/", "allow"), (5, "m.example.com", "/en/p", "example.com/en/", "block"),
        (6, "example.com", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "b.net", "/fr/y", "net/fr/", "block"), (9, "b.net", "/fr/y", "net/fr/", "block"), (None, "a.org", "/x", None, "block"),
    ])
    assert url_filter.judge(df.limit(0)).count() == 0


def check_shards(rows, texts, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    return [sum(r.size for r in rows if r.shard == s) for s in range(shards)]


def test_shards_are_even_and_keep_groups(spark):
    rows = QUERIES["op10_shards"](spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    sums = check_shards(rows, [(r.doc_id, r.text) for r in docs])
    assert max(sums) - min(sums) <= 0.002 * sum(sums)
    text = {r.doc_id: r.text for r in docs}
    where = defaultdict(set)
    for r in rows:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shards_of_edge_rows(spark):
    check_shards(sharding.shard(edge_rows(spark)).collect(), [(i, t) for i, t, _ in EDGES])
    assert sharding.shard(edge_rows(spark, 0)).count() == 0


def test_differencing_adds_up():
    rng = np.random.default_rng(0)
    sizes = rng.lognormal(6, 1.4, 500).astype(int) + 1
    at = sharding.differenced(sizes, 8)
    sums = np.bincount(at, weights=sizes, minlength=8)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= max(2, 0.001 * sizes.sum())


def brute_vectors(rows):
    ok = [(k, np.array(v, float)) for k, v in rows if v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in ok])
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    parent = list(range(len(ok)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in zip(*np.nonzero(hit)):
        parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(ok):
        least[find(i)] = min(k, least.get(find(i), k))
    out = {k: (int(hit[i].sum()), least[find(i)]) for i, (k, _) in enumerate(ok)}
    return {k: out.get(k, (0, k)) for k, _ in rows}


def test_vector_dedup(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((150, 6)))]
    for base in rng.standard_normal((3, 6)):
        rows += [(len(rows) + i, (base + s * rng.standard_normal(6)).tolist()) for i, s in enumerate(np.repeat([0.05, 0.2], 20))]
    rows += [(len(rows) + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(50)]
    rows += [(len(rows) + i, v) for i, v in enumerate([None, [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], []])]
    df = spark.createDataFrame([(k, v, "clash") for k, v in rows], "vec_id long, embedding array<double>, n_links string")
    want = brute_vectors(rows)
    got = {r.vec_id: r for r in vector_dedup.dedup(df, window=8).collect()}
    assert len(got) == len(rows) and all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert all(got[k].n_links <= n for k, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[k].component_id == c for k, (_, c) in want.items()]) > 0.97
    assert vector_dedup.dedup(df.limit(0)).count() == 0


def test_vectors_of_all_lengths_repeated_and_null_ids(spark):
    big, tiny = [1e200, 2e200, 0.0], [1e-200, 2e-200, -0.0]
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [0.0, 1.0, 0.0]), (6, big), (7, tiny), (7, tiny), (None, [1.0, 2.0]), (None, None), (8, [3.0]), (9, [2.0])]
    got = Counter(map(tuple, vector_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 2, 6, True), (7, 2, 6, False), (7, 2, 6, False), (None, 2, 1, None), (None, 0, None, True), (8, 1, 8, True), (9, 1, 8, False)]
    assert got == Counter((a, b, c, True if d is None else d) for a, b, c, d in want)


def test_vector_query_is_exact_on_its_table(spark):
    data = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    v = np.array([x / np.linalg.norm(x) for _, x in rows])
    near = (v @ v.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r for r in QUERIES["op8_vector_dedup"](spark, data).collect()}
    assert {i: int(n) for (i, _), n in zip(rows, near)} == {i: r.n_links for i, r in got.items()}


def test_vector_dedup_finds_pairs_in_a_crowd(spark):
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    wide, axis = unit(rng.standard_normal((3000, 64))), unit(rng.standard_normal(64))
    hot = unit(np.sqrt(0.8) * axis + np.sqrt(0.2) * unit(rng.standard_normal((6000, 64))))  # mutual cosine 0.8
    near = hot[:400] + 0.42 * unit(rng.standard_normal((400, 64)))  # cosine 0.92
    v = unit(np.concatenate([wide, hot, near]))
    hit = v @ v.T >= 0.9
    np.fill_diagonal(hit, False)
    got = {r.vec_id: r for r in vector_dedup.dedup(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(v) and all(got[i].n_links <= n for i, n in enumerate(hit.sum(axis=1)))
    assert sum(r.n_links for r in got.values()) >= 0.98 * hit.sum()
    planted = [i for i in range(400) if hit[3000 + i, 9000 + i]]
    assert len(planted) > 300 and np.mean([got[3000 + i].component_id == got[9000 + i].component_id for i in planted]) >= 0.98


def test_pipeline_decisions(spark, sf):
    from cadastra.llm import quality, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = durable(stage(spark, rows, sf))
        assert out.columns == docs.columns
        before, after = Counter(rows.collect()), Counter(out.collect())
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(rows, toxicity.fit(rows, labels)).where("predicted = 1").collect()}
            assert after == Counter(r for r in before.elements() if r.doc_id not in bad)
        elif name == "quality rules":
            good = {r.doc_id for r in quality.judge(rows, quality.fit(rows, labels)).where("kept").collect()}
            assert after == Counter(r for r in before.elements() if r.doc_id in good)
        elif name == "n-gram near-duplicates":
            stays = {c for _, _, c, _ in brute_links([(r.doc_id, r.text) for r in before])}
            assert after == Counter(r for r in before if r.doc_id in stays)
        else:
            assert set(after) <= set(before)
        rows = out
    last = corpus_pipeline.STAGES[4][1](spark, rows, sf).collect()
    check_packing(last, [(r.doc_id, r.text) for r in rows.collect()])


def test_pipeline_stages_take_edge_rows(spark, sf):
    wild = edge_rows(spark).withColumnRenamed("piece", "copy").withColumnRenamed("component_id", "score")
    for n in (wild, wild.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, n, sf).columns == wild.columns
            stage(spark, n, sf).collect()
    # packing takes null ids and a column of its own result's name
    check_packing(corpus_pipeline.packing_stage(spark, edge_rows(spark), sf).collect(), [(i, t) for i, t, _ in EDGES])
    assert corpus_pipeline.packing_stage(spark, edge_rows(spark, 0), sf).count() == 0
    repeated = corpus_pipeline.near_duplicate_stage(spark, wild, sf).collect()
    assert len([r for r in repeated if r.text == "a b"]) == 1


def test_the_whole_pipeline_takes_edge_rows(spark, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "full/labels.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none/labels.parquet"))
    long = " ".join(f"word{i % 977}" for i in range(3000))
    docs = edge_rows(spark).union(spark.createDataFrame([(i, long if i < 12 else f"{long} {i}", "en", "web", 1, 1, "q") for i in range(10, 16)], edge_rows(spark).schema))
    docs.write.parquet(str(tmp_path / "full/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    assert {r.doc_id for r in rows} <= {i for i, _, _ in EDGES} | set(range(10, 16))
    # near copies leave one document, however often the mix repeats it
    assert len({r.doc_id for r in rows if r.doc_id and r.doc_id >= 10}) <= 1
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_null_and_empty_texts_have_shards_of_their_own_group(spark):
    rows = [(i, None if i % 2 else "") for i in range(40)] + [(100 + i, f"text {i}") for i in range(40)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    check_shards(got, rows, 4)
    where = defaultdict(set)
    for r in got:
        where["null" if r.doc_id < 100 and r.doc_id % 2 else "empty" if r.doc_id < 100 else r.doc_id].add(r.shard)
    assert all(len(v) == 1 for v in where.values())


def test_a_hub_of_aliases_shares_one_verdict(spark):
    link = '<link rel="canonical" href="http://hub.net/fr/page">'
    rows = [(i, f"http://alias{i}.org/", link) for i in range(300)] + [(1000 + i, f"http://free{i}.org/", None) for i in range(5)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "block" for i in range(300)) and all(got[1000 + i] == "allow" for i in range(5))
