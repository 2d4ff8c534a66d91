"""Plans that must hold at any size, and where the jobs keep their files."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from shelfspark import session
from shelfspark.functions.html_scan import scan
from shelfspark.operators import merge as M


def test_a_small_batch_leaves_the_stored_table_in_place(spark, tmp_path):
    stored = "id string, guid_nom string, guid string, nomcode string, name string, updated_at long"
    spark.range(20000).selectExpr("CAST(id AS STRING) AS id", "concat('g', id) AS guid_nom", "'' AS guid", "'' AS nomcode", "'n' AS name", "1L AS updated_at").write.parquet(f"{tmp_path}/t")
    current = spark.read.schema(stored).parquet(f"{tmp_path}/t")
    batch = spark.createDataFrame([(1, "g5", "", "", "new", 2), (2, "fresh", "", "", "more", 2)], "seq int, guid_nom string, guid string, nomcode string, name string, updated_at long")
    merged = M.upsert_source(current, batch, ["seq"])
    assert {r._action: r.n for r in merged.groupBy("_action").count().withColumnRenamed("count", "n").collect()} == {"kept": 19999, "updated": 1, "inserted": 1}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "FullOuter" not in plan


def test_scan_time_follows_the_page(spark):
    def seconds(n):
        page = "<div class='product'><ul>" + "<li>Label: value" * n + "</ul>" + "<p>text" * n + "</div>"
        started = time.perf_counter()
        found = scan(page)
        assert len(found["lines"]) == n
        return time.perf_counter() - started

    seconds(500)
    assert seconds(16000) < 4 * 2 * seconds(8000)


def test_implied_ends_and_stray_tags():
    found = scan("<table class='spec'><tr><td>A<td>1<tr><th>B</th><td>2 </div></table><p>x<p>y<div>z")
    assert found["rows"] == [{"name": "A", "value": "1"}, {"name": "B", "value": "2"}]
    assert scan("<div class=a><span class=b>Нет  в наличии</span></div>")["stock"] == "out_of_stock"
    assert scan(None) == {"elements": [], "rows": [], "lines": [], "stock": ""}


class Cluster:
    """Stands for a session whose master is no local one."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master, applicationId = "spark://host:7077", "app-cluster"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_must_name_its_folder(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)
    assert session.shared_dir(spark)


def test_written_tables_can_be_cleared(spark):
    kept = session.written(spark.range(3), "kept")
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
    assert kept.count() == 3 and spark.sparkContext.applicationId in folder
    other = Path(session.shared_dir(spark)) / "not-ours"
    other.mkdir(exist_ok=True)
    session.clear_written(spark)
    assert not os.path.exists(folder) and other.exists()


def test_workers_get_the_package():
    """A page job started outside the repository, with the package on the driver's path alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from shelfspark.session import local_session\n"
        "from shelfspark.operators.pages import scan_pages\n"
        "spark = local_session('2')\n"
        "df = spark.createDataFrame([(1, 'u', '<h1>Hi</h1>')], 'page_id long, url string, html string')\n"
        "assert scan_pages(df).first()['elements'][0]['text'] == 'Hi'\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
