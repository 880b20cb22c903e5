import sys
from pathlib import Path

import pytest
from oracle_check import compare, duck

from stratus.llm.queries import ORACLES, QUERIES

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck(SF_SMALL).execute(ORACLES[name]).df()
    assert compare(got, want).startswith("OK")


def test_pipeline_stages_keep_columns_and_do_their_work(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    from stratus.llm import decontam, neardup, toxicity
    from stratus.session import materialize
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert after.columns == columns
        if name == "near_duplicates":
            found = neardup.near_duplicates(docs).where("kept").count()
            assert after.count() == found
            assert neardup.near_duplicates(after).where("NOT kept").count() == 0
        if name == "decontamination":
            benchmark = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
            assert decontam.contamination(after, benchmark).where("contaminated").count() == 0
        if name == "personal_data":
            assert after.where("text RLIKE '[a-z]@[a-z0-9]+[.]'").count() == 0 and after.where("text LIKE '%<EMAIL>%'").count() > 0
            assert after.count() == docs.count() and after.where("n_chars != char_length(text)").count() == 0
        docs = after
    assert 0 < docs.count() < before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert pieces.count() == docs.count() and pieces.where("NOT round_trip").count() == 0
