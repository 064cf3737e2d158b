"""The trained operators where workers have no way to the package but ship()."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from spanforge.session import local_session
spark = local_session(2, 2)
spark.sparkContext.setLogLevel("ERROR")
docs = spark.createDataFrame([(i, f"some plain words {i} " + ("awful " if i % 2 else "fine ") * 9) for i in range(24)], "doc_id long, text string")
labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 2 as int) as toxic")
from spanforge.llm.quality_cnn import quality
from spanforge.llm.toxicity_gru import toxicity
print("rows", toxicity(docs, labels).count(), quality(docs, labels).count())
"""


def test_training_in_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    run = subprocess.run([sys.executable, "-c", CODE, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows 24 24" in run.stdout, run.stderr[-2000:]
