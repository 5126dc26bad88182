"""Scratch tables: one folder per application, deleted together."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = """
from tideline.session import clean, durable, get_session
spark = get_session("job", **{"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.checkpoint.dir": SHARED})
from tideline.operators.adjust import p_adjust
from tideline.functions.special import norm_p_udf
df = durable(spark.range(5).selectExpr("id", "cast(id AS double) AS z"))
rows = p_adjust(df.withColumn("p", norm_p_udf("z")), [], "p", "holm").collect()
assert len(rows) == 5 and rows[0]["p"] is not None
clean(spark)
import os
assert not [d for d in os.listdir(SHARED) if d.startswith("tideline")], os.listdir(SHARED)
print("done")
"""


def test_a_job_from_another_folder_leaves_nothing(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    env = os.environ | {"PYTHONPATH": HERE}
    ran = subprocess.run([sys.executable, "-c", JOB.replace("SHARED", repr(str(shared)))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and "done" in ran.stdout, ran.stderr[-2000:]
