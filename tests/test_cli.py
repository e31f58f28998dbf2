import pytest

from flowmill import cli


@pytest.mark.parametrize("task", ["rows", "labels", "missing", "types", "variance", "dominance", "duplicates", "validity", "infinite"])
def test_reports(spark, tmp_path, capsys, task):
    (tmp_path / "a.csv").write_text(" Label ,rate\nx,1\ny,\nx,inf\nx,1\n")
    assert cli.main([task, str(tmp_path)]) == 0
    assert task in capsys.readouterr().out


@pytest.mark.parametrize(("task", "rows"), [("dedup", 3), ("drop-missing", 3), ("drop-invalid", 4), ("by-class", 4), ("split", 4)])
def test_cleaners(spark, tmp_path, capsys, task, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("label,rate\nx,1\ny,\nx,inf\nx,1\n")
    assert cli.main([task, str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 0
    folder = capsys.readouterr().out.strip().splitlines()[-1]
    assert spark.read.parquet(folder).count() == rows
