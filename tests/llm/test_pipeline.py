"""The pipeline's stages, each against a plain version of its decision."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import linededup, pii, queries
from gridloom.llm.common import materialize, read
from tests.llm.cases import odd_docs
from tests.llm.test_operators import brute_components, check_packing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test-stage")
        tables.append(docs)
    return tables


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_lengths(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert after.where(F.col("n_chars") != F.length("text")).count() == 0


def test_rejected_documents_go_and_clean_ones_stay(spark, sf_dir, stages):
    kept, scores = rows(stages[1]), rows(queries.op10_quality(spark, sf_dir))
    assert set(kept) == {i for i, r in scores.items() if r.score >= 0.3}
    good = read(spark, sf_dir, "labels").where("quality = 1").join(stages[0].select("doc_id"), "doc_id", "left_semi")
    lost = {r.doc_id for r in good.collect()} - set(kept)
    assert len(lost) <= 2


def test_lines(stages):
    after, want = rows(stages[2]), rows(linededup.dedup_lines(stages[1]))
    assert {i: r.text for i, r in after.items()} == {i: r.text for i, r in want.items() if not r.n_removed_lines or r.text.strip()}


def test_one_of_each_group_stays(stages):
    before = sorted((i, r.text) for i, r in rows(stages[2]).items())
    want = {c if n else i for i, n, c in brute_components(before)}
    assert set(rows(stages[3])) == want
    assert all(rows(stages[2])[i].text == r.text for i, r in rows(stages[3]).items())


def test_private_values_are_replaced(stages):
    names = pii.Pseudonymizer(queries.PUBLIC_KEY)
    after = rows(stages[4])
    assert all(after[i].text == names.replace(r.text)[0] for i, r in rows(stages[3]).items()) and len(after) == stages[3].count()


def test_packed(stages):
    import tokenizers

    from gridloom.llm.bpe import default_path

    check_packing(stages[5].collect(), {i: r.text for i, r in rows(stages[4]).items()}, tokenizers.Tokenizer.from_file(default_path()))


def test_run_is_the_stages_in_order(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length").collect())) == sorted(map(tuple, stages[5].select("doc_id", "start", "length").collect()))


def odd_stages(spark, sf_dir, docs):
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test-odd")
        tables.append(docs)
    return tables


def test_stages_of_odd_documents(spark, sf_dir):
    """Nulls, empty, long and repeated texts, null and repeated ids, clashing columns: each stage keeps columns and says what it drops."""
    docs = odd_docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    private = spark.createDataFrame([(70, "write to ann@example.com or call +1 555 123 4567 " + "today " * 60)], "doc_id long, text string")
    docs = docs.unionByName(private, allowMissingColumns=True)
    tables = odd_stages(spark, sf_dir, docs)
    for before, after in zip(tables, tables[1:-1]):
        assert after.columns == docs.columns and after.count() <= before.count()
    scores = {(r.doc_id, r.text): r.s for r in corpus_pipeline.quality.score_texts(docs, corpus_pipeline.quality.fit(corpus_pipeline.quality.featurize(docs), read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")), "s").collect()}
    assert len(scores) >= 11
    wordless = tables[2].where("NOT coalesce(text, '') RLIKE '[^ \\\\t\\\\n\\\\r]'").count()
    assert tables[3].where("NOT coalesce(text, '') RLIKE '[^ \\\\t\\\\n\\\\r]'").count() == wordless  # near copies need words
    assert tables[4].where("text LIKE '%ann@example.com%'").count() == 0 and tables[4].count() == tables[3].count()
    pieces = tables[5].collect()
    assert sum(r.length for r in pieces if r.start == 0) > 0 and {r.doc_id for r in pieces} == {r.doc_id for r in tables[4].collect()}


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").limit(0)
    assert [t.count() for t in odd_stages(spark, sf_dir, docs)] == [0] * 6
