import os

import pytest

import corpus_pipeline as p
from ledgerloom.llm import byte_bpe, quality, queries

from .fixtures import documents, shingles, texts
from .test_pairs import brute
from .test_texts import brute_lines, line_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, g) for i, t, g in line_rows()]
    words = rows[10][1].split()[:30]
    spark.createDataFrame([(1, " ".join(words)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    documents(spark, rows).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path


def test_quality_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.keep_quality(spark, docs, sf)
    assert kept.columns == docs.columns
    expected = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in expected.collect())


def test_line_stage(spark, sf):
    rows = line_rows()
    docs = documents(spark, rows)
    got = p.drop_repeated_lines(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((i, t) for i, t, _, _ in brute_lines(rows, 10)), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_near_duplicate_stage(spark, sf):
    rows = texts()
    groups = brute(rows)
    got = p.drop_near_duplicates(spark, documents(spark, rows), sf)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted([str(i) for i in groups if groups[i] == i] + ["None"])


def test_decontamination_stage(spark, sf):
    rows = texts()
    item = shingles(" ".join(rows[10][1].split()[:30]))
    got = p.drop_contaminated(spark, documents(spark, rows), sf)
    bad = {i for i, t, _ in rows if 100 * len(item & shingles(t)) >= 75 * len(item)}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _, _ in rows if i not in bad) and 10 in bad


def test_whole_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    expected = sorted(map(repr, byte_bpe.round_trip(docs).collect()))
    assert sorted(map(repr, p.run(spark, sf).collect())) == expected


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_stages_take_an_empty_table(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert dict(p.STAGES)[name](spark, docs, sf).count() == 0


def test_rows_that_share_an_id(spark, sf):
    """One stays, the same whatever the order of rows and partitions."""
    rows = [(1, "b c d e f g h", "en"), (1, "a b c d e f g h i", "de"), (1, None, "fr"), (2, "x", "en"), (2, "x", "de"), (2, "w y", "en"), (None, "n", "en"), (None, "n", "en")]
    for turn in range(3):
        docs = documents(spark, rows[turn:] + rows[:turn]).repartition(turn + 1)
        got = p.drop_near_duplicates(spark, docs, sf)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=repr) == sorted([(1, None, "fr"), (2, "w y", "en"), (None, "n", "en"), (None, "n", "en")], key=repr)


def left(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:").replace("//", "/", 1)
    return set(os.listdir(shared)) if os.path.isdir(shared) else set()


@pytest.mark.parametrize("name", ["op7_line_dedup", "op8_token_files", "op11_source_audit", "pipeline"])
def test_a_run_leaves_its_rows_only(spark, sf, name):
    before = left(spark)
    query = p.run if name == "pipeline" else queries.queries()[name]
    query(spark, sf).count()
    assert len(left(spark) - before) == 1
