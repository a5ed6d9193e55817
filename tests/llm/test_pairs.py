import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import components, decontaminate, ngram_join

from .fixtures import documents, shingles, texts


def brute(rows):
    """id -> smallest id reachable; rows that share an id are one document."""
    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def check(spark, rows):
    got = ngram_join.join(documents(spark, rows)).collect()
    expected = brute(rows)
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((i, len(shingles(t)), expected[i]) for i, t, _ in rows if i is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_join_equals_brute_force(spark):
    check(spark, texts())


def test_join_of_families_with_a_frequent_passage(spark):
    """Loose copies around the threshold, and unrelated short texts that share a passage: large buckets of every kind."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    template, passage, rows = prose(300), prose(14), []
    for i in range(110):
        ws = list(template)
        for _ in range(rng.choice([2, 6, 9, 30, 60])):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        rows.append((i, " ".join(ws), "en"))
    rows += [(200 + i, " ".join(passage + prose(rng.choice([3, 6, 10, 30]))), "en") for i in range(60)]
    rows += [(300 + i, " ".join(prose(2) + passage), "en") for i in range(30)]
    check(spark, rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", 15)
    monkeypatch.setattr(ngram_join, "BUCKET", 3)
    test_join_of_families_with_a_frequent_passage(spark)


def test_each_pair_of_two_components_is_a_candidate(spark):
    """1 and 2 are of one component, 3 and 4 of another; under one signature 1 meets 3 and 2 meets 4, and neither pair stands for the other one."""
    sig = lambda k, place: k << ngram_join.PLACE_BITS + ngram_join.BAND_BITS | place
    common = sig(1, 0)
    sigs = {c: [common, *(sig(100 + c % 2, k) for k in range(1, 16)), *(sig(200 + c, k) for k in range(16, 24))] for c in (1, 2, 3, 4)}
    classes = spark.createDataFrame([(c, x) for c, x in sigs.items()], "class long, sigs array<long>")
    held = lambda s: sum(s in x for x in sigs.values())
    large = [(s, c, 0, 1 if c < 3 else 3, 0 if s == common else held(s), 24 if c < 3 else 32, 24) for c, x in sigs.items() for s in x]
    edges = ngram_join._large_edges(spark.createDataFrame(large, "sig long, class long, band long, comp long, held long, n long, f long"), classes, 75)
    clusters = {r.node: r.component for r in components.components(edges.toDF("u", "v")).collect()}
    assert clusters == {1: 1, 3: 1, 2: 2, 4: 2}


def test_join_of_empty_and_tiny_tables(spark):
    check(spark, [])
    check(spark, [(1, None, None)])
    check(spark, [(1, "a b c d e", None), (1, "f g h i j", None), (2, "f g h i j", None)])


def test_partitions_exceed_the_largest_difference():
    for band in range(3):
        n, k, zero = ngram_join.partitions(band)
        assert n > k and zero == 0
    for size in range(1, 3000, 7):  # a partner within the threshold has a band in common
        for other in (size, size * 4 // 3):
            assert set(ngram_join.bands(size)) & set(ngram_join.bands(other))


def test_bands_of_very_large_sets(spark):
    rng = np.random.default_rng(2)
    for size in (1 << 20, (1 << 20) + 1, 3 << 19, (1 << 21) + 7):
        features = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        other = np.sort(np.concatenate([features[rng.random(len(features)) > 0.02], rng.integers(0, 1 << 63, size // 50).astype(np.uint64)]))
        both = sorted(set(ngram_join.signatures(features).tolist()) & set(ngram_join.signatures(other).tolist()))
        rows = spark.createDataFrame([(s,) for s in both], "sig long").select(ngram_join.band_of(F.col("sig")).alias("band"))
        got = rows.groupBy("band").agg(F.count("*").alias("votes")).withColumn("needed", ngram_join.needed(F.col("band"), F.lit(len(features)), F.lit(len(other)), F.lit(0), F.lit(0))).collect()
        assert {r.band for r in got} == set(ngram_join.bands(len(features))) & set(ngram_join.bands(len(other)))
        assert got and all(r.band < ngram_join.SINGLES and r.votes >= r.needed for r in got)
    for size in (1 << 20, 1 << 25, 1 << 30):  # a partner within the threshold has a band in common, and each band has a number below SINGLES
        assert set(ngram_join.bands(size)) & set(ngram_join.bands(size * 4 // 3)) and max(ngram_join.bands(size * 4 // 3)) < ngram_join.SINGLES


def votes(a, b):
    """band -> (shared, signatures of a, of b) of two sets."""
    x, y = set(ngram_join.signatures(a).tolist()), set(ngram_join.signatures(b).tolist())
    by = lambda sigs: Counter(s >> ngram_join.PLACE_BITS & (1 << ngram_join.BAND_BITS) - 1 for s in sigs)
    return {k: (n, by(x)[k], by(y)[k]) for k, n in by(x & y).items()}


def test_no_pair_at_the_threshold_shares_too_few_signatures(spark):
    """Nested sets and equal-sized ones, just at the threshold: the rule that drops pairs in small and in large buckets keeps all."""
    rng = np.random.default_rng(4)
    sizes = [*range(3, 140), *rng.integers(140, 10_000, 500).tolist()]
    rows = []
    for pair, n in enumerate(sizes * 4):
        if pair % 2:  # nested
            other = -(-n * 75 // 100)
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = np.sort(rng.permutation(a)[:other])
        else:  # of 8 parts 7 in common
            part = max(1, n // 8)
            base = np.unique(rng.integers(0, 1 << 63, 8 * part).astype(np.uint64) * np.uint64(2))
            mixed = rng.permutation(base)
            a, b = np.sort(mixed[: 7 * part]), np.sort(np.concatenate([mixed[: 6 * part], mixed[7 * part :]]))
        if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
            continue
        got = votes(a, b)
        rows += [(pair, k, *v, len(a), len(b)) for k, v in got.items()] or [(pair, 0, 0, 0, 0, len(a), len(b))]
    df = spark.createDataFrame(rows, "pair long, band int, votes long, fa long, fb long, na long, nb long")
    enough = ngram_join.needed(F.col("band"), F.col("na"), F.col("nb"), F.col("fa"), F.col("fb"))
    alone = F.greatest(*(ngram_join.needed_at_least(F.col("band"), F.col(f"n{x}"), F.col(f"f{x}")) for x in "ab"))
    kept = df.groupBy("pair").agg(F.max((F.col("votes") >= enough).cast("int")).alias("kept"), F.max(F.when(F.col("votes") >= enough, F.col("votes") - alone)).alias("spare"))
    lost = kept.where("kept = 0 or spare < 0")
    assert kept.count() > 2000 and lost.count() == 0


def test_hubs_and_hot_digests_are_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.common, "LIGHT_ROWS", 5)
    monkeypatch.setattr(ngram_join.common, "HEAVY_KEYS", 20)
    monkeypatch.setattr(ngram_join, "PIVOT_ROWS", 3)
    test_join_of_families_with_a_frequent_passage(spark)
    test_components(spark)
    check(spark, texts() + [(1000 + k, "the same text of seven words here", "en") for k in range(40)])


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (20, 10), (20, 11), (20, 12), (4, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 10, 11: 10, 12: 10, 20: 10}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contained_equals_brute_force(spark):
    rows = [(i, t, g) for i, t, g in texts() if i != 4]
    cut = lambda i, a, b: " ".join(next(t for j, t, _ in rows if j == i).split()[a:b])
    bench = [(1, cut(10, 3, 40)), (2, cut(207, 3000, 3030).upper()), (3, "not in there at all really"), (4, cut(12, 0, 30) + " tail of other words that are new"), (5, None), (6, ""), (7, "one two"), (8, cut(9, 2, 4))]
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contained(documents(spark, rows), items(spark, bench)).collect() if r.doc_id is not None}
    expected = {}
    for i, t, _ in rows:
        for k, b in bench:
            s, d = shingles(b), shingles(t)
            if i is not None and s and 100 * len(s & d) >= 75 * len(s):
                expected[i, k] = (len(s), len(s & d))
    assert got == expected and len(got) >= 4
    kept = sorted((r.doc_id or -1) for r in decontaminate.clean(documents(spark, rows), items(spark, bench)).collect())
    assert kept == sorted((i or -1) for i, t, _ in rows if i not in {d for d, _ in expected})
    cleaned = decontaminate.clean(documents(spark, rows), items(spark, bench))
    assert cleaned.columns == documents(spark, rows).columns
    assert {tuple(r) for r in cleaned.drop("text", "doc_id", "lang", "n_chars").collect()} == {tuple(r) for r in documents(spark, rows).drop("text", "doc_id", "lang", "n_chars").collect()}


def test_candidates_hold_as_many_kept_values_as_a_container_does(spark):
    rng = random.Random(8)
    prose = lambda k: [rng.choice(["the", "er", "on"]) + str(rng.randrange(400)) for _ in range(k)]
    bench = [(i, " ".join(prose(rng.choice([5, 9, 20, 41, 100])))) for i in range(40)]
    rows = []
    for i, t in bench:
        ws = t.split()
        for k, share in enumerate((0.3, 0.6, 0.85, 1.0)):
            rows.append((10 * i + k, " ".join(prose(50) + ws[: int(len(ws) * share)] + prose(50)), "en"))
    docs, kept = documents(spark, rows).select(F.col("doc_id").cast("string").alias("doc"), "text"), decontaminate.sketches(items(spark, bench).withColumnRenamed("item_id", "item"))
    assert kept.where("need < 1").count() == 0
    met = {(int(r.doc), r.item) for r in decontaminate.candidates(docs, kept).collect()}
    any_value = {(int(r.doc), r.item) for r in decontaminate.candidates(docs, kept.withColumn("need", F.lit(1))).collect()}
    right = {(d, i) for d, t, _ in rows for i, b in bench if 100 * len(shingles(b) & shingles(t)) >= 75 * len(shingles(b))}
    assert right <= met <= any_value and len(met) < 0.8 * len(any_value)


def test_contained_with_bits_instead_of_values(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    test_contained_equals_brute_force(spark)


def test_contained_of_empty_tables(spark):
    assert decontaminate.contained(documents(spark, []), items(spark, [(1, "a b c d e f")])).count() == 0
    assert decontaminate.contained(documents(spark), items(spark, [])).count() == 0


def test_null_ids_are_cleaned_by_text(spark):
    rows = [(None, "a b c d e f g", None), (None, "q r s t u v", None), (1, "a b c d e f g", None)]
    assert [r.text for r in decontaminate.clean(documents(spark, rows), items(spark, [(1, "a b c d e f")])).collect()] == ["q r s t u v"]
