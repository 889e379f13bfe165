from __future__ import annotations

from strandline.llm.common import BATCHES, python_workers


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    rows, size = BATCHES
    before = {key: spark.conf.get(key, None) for key in BATCHES}
    try:
        for key in BATCHES:
            spark.conf.unset(key)
        python_workers(spark)
        assert {key: int(spark.conf.get(key)) for key in BATCHES} == BATCHES
        spark.conf.set(rows, "77")
        python_workers(spark)
        assert spark.conf.get(rows) == "77" and int(spark.conf.get(size)) == BATCHES[size]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
