"""A task of a pipeline stage holds one Python worker, so that an executor has no more of them than cores."""

import corpus_pipeline
import pytest

ROWS = [(k, f"some words {k} about mail{k % 7}@example.org, 10.0.0.{k} and other things to read", "en") for k in range(60)]
ROWS += [(100 + k, f"only words of number {'x' * k} here", "en") for k in range(60)]
ROWS += [(None, "a row without an id: nobody@example.org", "en"), (None, None, None), (7, None, "en")]


def workers(plan):
    """``(now, most)``: Python evaluations that a task holds at ``plan``'s output, and the most of any task of the plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return workers(plan.initialPlan())
    kids = plan.children()
    got = [workers(kids.apply(k)) for k in range(kids.size())]
    now = [n for n, _ in got]
    own = (max if name == "Union" else sum)(now or [0]) + any(w in name for w in ("Python", "Arrow", "Pandas"))
    most = max([own, *(m for _, m in got)])
    return (0 if "Exchange" in name else own), most


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_a_task_holds_one_python_worker(spark, sf_dir, tmp_path, name, stage):
    """Over a table as small as this, whose joins need no shuffle."""
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), sf_dir)
    _, most = workers(out._jdf.queryExecution().executedPlan())
    assert most == 1


def test_sanitised_rows_are_whole(spark, sf_dir):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    out = corpus_pipeline.sanitise_personal_data(spark, docs, sf_dir).collect()
    assert len(out) == len(ROWS) and {r.doc_id for r in out} == {r[0] for r in ROWS}
    texts = {(r.doc_id, r.text) for r in out}
    assert (3, "some words 3 about [EMAIL], [IP] and other things to read") in texts
    assert (None, "a row without an id: [EMAIL]") in texts
    assert {(None, None), (7, None), (101, "only words of number x here")} <= texts
