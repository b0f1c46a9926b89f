from types import SimpleNamespace

import pytest

from plenum import queries_cases
from plenum.sources import shared


class Elsewhere:
    """A session that says its master is no local one, and that its shared folder is `folder`."""

    def __init__(self, spark, folder):
        self._spark = spark
        real = spark.sparkContext
        self.conf = SimpleNamespace(get=lambda name, *default: folder if name == "spark.checkpoint.dir" else spark.conf.get(name, *default))
        self.sparkContext = SimpleNamespace(master="spark://elsewhere:7077", getConf=real.getConf, _jsc=real._jsc, _jvm=real._jvm)

    def __getattr__(self, name):
        return getattr(self._spark, name)


QUERIES = ["source_csv_windows", "source_reference_csv", "source_sheets", "gap_workbook", "source_json_records", "source_reference_json", "source_xlsx", "source_csv", "source_load_capped", "source_refusals", "source_zip"]


@pytest.mark.parametrize("name", QUERIES)
def test_shared_folder_without_scheme(spark, folder, tmp_path, name):
    query = queries_cases.queries()[name]
    found = query(Elsewhere(spark, str(tmp_path / "shared")), folder).collect()
    assert found and sorted(map(tuple, found)) == sorted(map(tuple, query(spark, folder).collect()))


@pytest.mark.parametrize("name", QUERIES)
def test_shared_folder_of_another_file_system(spark, folder, tmp_path, name):
    (tmp_path / "files").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.plenum.link./files", f"file://{tmp_path}/files")
    found = queries_cases.queries()[name](Elsewhere(spark, "viewfs://plenum/files"), folder).collect()
    assert found and sorted(map(tuple, found)) == sorted(map(tuple, queries_cases.queries()[name](spark, folder).collect()))


def test_folder_set_on_the_context(spark):
    elsewhere = Elsewhere(spark, None)
    elsewhere.sparkContext.getConf = lambda: SimpleNamespace(get=lambda name: None)
    set_ = SimpleNamespace(isDefined=lambda: True, get=lambda: "/somewhere/shared")
    elsewhere.sparkContext._jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: set_), hadoopConfiguration=spark.sparkContext._jsc.hadoopConfiguration)
    assert shared.shared_folder(elsewhere) == "file:/somewhere/shared"
