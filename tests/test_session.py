import os
import subprocess
import sys

from pyspark.sql import functions as F

from pricelens import session


def test_a_given_master_stays():
    code = "from pricelens.session import get_session; print('MASTER', get_session().sparkContext.master)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[3] --conf spark.ui.enabled=false pyspark-shell", "PYTHONPATH": root}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120).stdout
    assert "MASTER local[3]" in out


def test_text_work_is_spread_by_a_setting(spark):
    scan = spark.range(0, 1000, 1, 1)
    tasks = lambda frame: frame.select(F.spark_partition_id()).distinct().count()
    assert tasks(session.spread(scan)) == 8
    assert tasks(session.spread(scan, 5)) == 5
    assert tasks(session.spread(scan, 0)) == 1


def test_discarded_tables_are_gone(spark):
    kept, gone = session.materialize(spark.range(3), "kept"), session.materialize(spark.range(3), "gone")
    path = gone._stored_at
    assert os.path.isdir(path)
    session.discard(gone, spark.range(1))
    assert not os.path.exists(path) and kept.count() == 3


def test_splits_leave_one_table_with_texts(spark):
    from pricelens.plans import views

    base = f"{spark.conf.get('spark.checkpoint.dir')}/pricelens"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    frame = views.splits(spark, "/root/testdata/sf0.001")
    assert frame.count() > 0
    assert [n.split("-")[0] for n in set(os.listdir(base)) - before] == ["splits"]
