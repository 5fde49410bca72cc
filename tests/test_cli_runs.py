"""Runs of the command line use the replicates that are asked for."""

from subsetlab import cli


def test_replicates_are_not_cut(monkeypatch):
    asked = {}
    monkeypatch.setattr(cli.refresh, "loaded", lambda *a: type("Draws", (), {"cache": lambda self: self})())
    monkeypatch.setattr(cli.montecarlo, "family", lambda draws, reps: None)
    monkeypatch.setattr(cli.montecarlo, "follow_up", lambda draws, test, reps: asked.setdefault(test, reps))
    for place, name in ((cli.infer, "effects"), (cli.montecarlo, "exploratory"), (cli.montecarlo, "interpreted"), (cli.summaries, "inferred")):
        monkeypatch.setattr(place, name, lambda *a: None)
    monkeypatch.setattr(cli.publish, "to_csv", lambda df, order: "")
    monkeypatch.setattr(cli.publish, "publish", lambda out, files, about: files)
    files = cli.infer_run(None, "root", "out", None, 10_000)
    assert set(asked.values()) == {10_000} and {"C7", "C8"} <= set(asked) and "followup_C8.csv" in files


def test_summaries_and_ceilings(spark, tmp_path, capsys):
    import os

    from subsetlab.plans import refresh
    from tests.test_runs import lines, made_draws, official, once

    root, draws = str(tmp_path / "root"), made_draws(560)
    for source, content in (("official", official(draws)), ("mirror", lines(draws))):
        refresh.ingest(spark, root, source, once(content), "full")
    assert refresh.curate(spark, root)["status"] == "rebuilt"

    def run(*argv):
        return cli.main(["--root", root, *argv], spark)

    out = str(tmp_path / "out")
    assert run("eda", "--out-dir", f"{out}/eda", "--reps", "20", "--windows", "50", "--n-blocks", "2") == 0
    text = open(f"{out}/eda/summary.md").read()
    assert "special: " in text and "simultaneous bounds" in text and "Window of 50: " in text
    assert run("m4", "--out-dir", f"{out}/m4", "--reps", "20") == 0
    text = open(f"{out}/m4/summary.md").read()
    assert "| C13 |" in text and "special_rank" in text
    assert "parent" in open(f"{out}/m4/followup_C4.csv").read()
    assert run("m5-exp001", "--out-dir", f"{out}/m5", "--reps", "20") == 0
    assert "fold_02 (10 draws)" in open(f"{out}/m5/summary.md").read()
    assert run("m4", "--out-dir", f"{out}/no", "--reps", "20", "--through-draw", "00400", "--ceiling", "00300") == 2
    assert not os.path.exists(f"{out}/no")
    assert run("eda", "--out-dir", f"{out}/yes", "--reps", "10", "--windows", "50", "--n-blocks", "2", "--through-draw", "00400", "--ceiling", "00300", "--override-ceiling", "REVIEW-1") == 0
    assert "override: REVIEW-1" in open(f"{out}/yes/summary.md").read()
    assert run("eda", "--out-dir", f"{out}/no", "--reps", "10", "--through-draw", "00400", "--ceiling", "00300", "--override-ceiling", "because") == 2
    assert not os.path.exists(f"{out}/no")
    as_of = f"{draws[-1]['date']} 14:30:00"
    assert run("quality-report", "--as-of", as_of, "--out-dir", f"{out}/report") in (0, 10)
    assert os.path.exists(f"{out}/report/report.json") and not os.path.exists(f"{root}/reports")
