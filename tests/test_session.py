"""Stored stages: read back as they were, and deleted when they are released."""

import glob

from casemill.session import durable, durable_dir, release


def test_release_deletes_the_stage_only(spark):
    folder = durable_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/stage-*"))
    kept, gone = durable(spark.range(3)), durable(spark.range(4))
    assert kept.count() == 3 and gone.count() == 4
    release(gone, gone, spark.range(1))
    assert len(set(glob.glob(f"{folder}/stage-*")) - before) == 1 and kept.count() == 3
