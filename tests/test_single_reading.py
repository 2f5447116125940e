"""Queries read what they need: no feature table behind narrow results, one pass over the residents."""

import pytest

from originline.operators import habits as H
from originline.operators import splits as P
from originline.plans import jobs, review
from originline.plans.scoring import share_hits
from originline.plans.workspace import Workspace
from originline.sources import tables as T

FOLDER = "/root/testdata/sf0.001"


def refused(self):
    raise AssertionError("the stage is not needed here")


class NoFeatures(Workspace):
    features = model_rows = property(refused)


class NoCommunity(NoFeatures):
    community = property(refused)


@pytest.fixture(scope="module")
def narrow(spark):
    return NoCommunity(spark, FOLDER)


def test_share_hits_and_answers_need_no_feature_table(narrow):
    samples = narrow.samples.count()
    assert share_hits(narrow).count() == 2 * samples
    assert review.answers(narrow).filter("arm = 'rule'").count() == narrow.holdout.count()


def test_prompts_and_the_audit_need_no_community_columns(narrow):
    samples = narrow.samples.count()
    assert narrow.prompt_rows.filter("prompt is not null and target is not null").count() == samples
    assert narrow.prompts.count() == samples
    assert jobs.JOBS["as_of_audit"](narrow).first()["samples"] == samples


def test_candidates_are_expanded_without_a_staged_feature_table(spark):
    ws = NoFeatures(spark, FOLDER)
    assert jobs.JOBS["candidate_labels"](ws).count() == len(ws.params.names) * ws.samples.count()


def test_model_rows_are_staged_once_with_their_targets(spark):
    class NoJoin(Workspace):
        features = property(refused)

    ws = NoJoin(spark, FOLDER)
    assert ws.model_rows.filter("target_facility_id is not null and split is not null").count() == ws.samples.count()


def test_both_rules_come_out_of_one_reading(narrow):
    both = H.predict(narrow.samples, narrow.origin_rows(), narrow.fallbacks, narrow.transitions)
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert both.count() == 2 * narrow.samples.count()


def test_splits_are_told_inside_the_rows(narrow):
    rows = P.with_split(narrow.samples, narrow.cutoffs)
    # The cut is a subquery; the samples themselves are not shuffled.
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.columns == [*narrow.samples.columns, "split"]


def test_json_lines_can_be_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("S1", "a\nb"), ("S2", "ü")], "sample_id string, text string")
    T.write_jsonl(rows, str(tmp_path / "out"), "gzip")
    files = [f.name for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = T.read_jsonl(spark, rows.schema, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
