import tempfile

from conftest import SF001
from seqwise.__main__ import main


def test_cli_list_and_run(spark, capsys):
    assert main(["list"]) == 0
    assert "window_features" in capsys.readouterr().out.split()
    out = tempfile.mkdtemp(prefix="cli-", dir="/tmp") + "/agg4"
    assert main(["run", "AGG-4", "--data", SF001, "--out", out, "--master", "local[2]", "--files", "2"]) == 0
    assert spark.read.parquet(out).count() == 15
    assert main(["run", "NOPE", "--data", SF001, "--out", out]) == 2
