"""Every query of the library runs over tables without rows."""

import glob
import os

import pytest

from arcweave.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for p in glob.glob(f"{DIR}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{at}/{os.path.basename(p)}")
    return str(at)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_rows(spark, empty, name):
    registry.queries()[name](spark, empty).collect()
