"""Stream jobs that are started again go on where they ended."""

import datetime as dt

from ranktide.streaming import jobs as S

SCHEMA = "user_id long, ts timestamp, event_type string"


def _put(spark, path, rows):
    spark.createDataFrame([(u, dt.datetime(2024, 1, d, h), e) for u, d, h, e in rows], SCHEMA).write.mode("append").parquet(path)


def test_counts_go_on_after_a_restart(spark, tmp_path):
    source, base = f"file://{tmp_path}/in", f"file://{tmp_path}/job"

    def run():
        counts = S.daily_counts_stream(S.file_stream(spark, source, SCHEMA))
        return {(r.user_id, r.day.day): r.n for r in S.run_counts_to_table(counts, "counts", base).collect()}

    _put(spark, source, [(1, 1, 1, "a"), (1, 1, 2, "a"), (2, 1, 3, "a")])
    assert run() == {(1, 1): 2, (2, 1): 1}
    _put(spark, source, [(1, 1, 5, "b"), (1, 2, 5, "b")])
    assert run() == {(1, 1): 3, (2, 1): 1, (1, 2): 1}


def test_cleaned_rows_are_appended_once(spark, tmp_path):
    source, base = f"file://{tmp_path}/in", f"file://{tmp_path}/job"

    def run():
        cleaned = S.clean_stream(S.file_stream(spark, source, SCHEMA), "ts", ["event_type"], ["event_type"], ["user_id", "event_type"])
        return spark.read.parquet(S.run_to_parquet(cleaned, "clean", base)).count()

    _put(spark, source, [(1, 1, 1, "a"), (1, 1, 2, "a"), (2, 1, 3, "None"), (2, 1, 4, "b")])
    assert run() == 2
    _put(spark, source, [(1, 1, 3, "a"), (3, 1, 5, "c")])
    assert run() == 3
