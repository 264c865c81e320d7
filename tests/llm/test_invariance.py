"""Every training-data query gives the same rows however its input is split and ordered."""

import os
import random
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = {
    "p1_found": ["posts", "sections"], "p2_found": ["preferences"], "p3_found": ["comparisons"], "p3_split": ["comparisons", "split_targets"], "p4_found": ["posts", "ginza_discourse_modesty"],
    "p5_found": ["posts"], "p5_forms": ["posts"], "p6_ids": ["documents"], "p7_mix": ["documents", "mix_targets"], "p8_found": ["documents", "subject_labels", "subject_areas"],
}


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """The tables as they are in one part, and shuffled in 13 parts."""
    root = tmp_path_factory.mktemp("shuffled")
    for parts in (1, 13):
        for name in sorted({t for ts in TABLES.values() for t in ts}):
            df = spark.read.parquet(f"{SF}/{name}.parquet")
            if parts == 1:
                df.coalesce(1).write.parquet(f"{root}/1/{name}.parquet")
            else:
                rows = df.collect()
                random.Random(7).shuffle(rows)
                spark.createDataFrame(rows, df.schema).repartition(parts).write.parquet(f"{root}/13/{name}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(TABLES))
def test_rows_do_not_depend_on_the_split(spark, copies, name):
    def run(parts, shuffle):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        return Counter(str(r) for r in entry.queries()[name](spark, f"{copies}/{parts}").collect())

    try:
        assert run(1, "1") == run(13, "7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
