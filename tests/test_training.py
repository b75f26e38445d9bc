"""The whole job on the smallest tables."""

from tallyrec.plans import training
from tallyrec.sources import adapters, io


def test_train_publish_and_retrain(spark, tmp_path):
    data = adapters.dataset(spark, "/root/testdata/sf0.001")
    als = {"factors": 4, "rounds": 2}
    folder = str(tmp_path / "runs")
    first = training.retrain(spark, data, folder, "run1", als=als)
    assert first in ("promote_first", "reject")
    if first == "reject":
        training.publish(spark, folder, "run1", "promote_first")
    assert training.current_run(spark, folder) == "run1"
    assert training.retrain(spark, data, folder, "run2", als=als) in ("skipped", "promote", "reject")
    assert training.retrain(spark, data, folder, "run3", als=als, force=True) in ("promote", "reject")
    assert {r.metric for r in spark.read.parquet(f"{folder}/run1/metrics").collect()} == {"ndcg", "recall", "coverage", "diversity", "novelty"}


def test_events_are_partitioned_and_pruned(spark, tmp_path):
    from datetime import datetime

    events = adapters.events(spark, "/root/testdata/sf0.001")
    io.write_events(events, str(tmp_path / "events"))
    got = io.read_events(spark, str(tmp_path / "events"), datetime(2024, 1, 10), datetime(2024, 1, 12))
    assert got.count() == events.filter("occurred_at >= '2024-01-10' and occurred_at < '2024-01-12'").count()
    assert "event_month" in got._jdf.queryExecution().executedPlan().toString()


def test_json_columns(spark):
    df = spark.createDataFrame([(1, '{"a": "b"}', "oops")], "id long, attributes string, tags string")
    row = io.decode_json(df, "products").first()
    assert row.attributes == {"a": "b"} and row.tags is None
    assert io.encode_json(io.decode_json(df, "products")).first().attributes == '{"a":"b"}'
