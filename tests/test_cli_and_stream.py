import json

import pytest

from sitefold import cli
from sitefold.streaming.fetches import evaluate_batches, other_families
from tests.test_sites import GOOD, PAGE, urlset


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return str(folder)


def test_scan_and_diff(spark, tmp_path, capsys):
    good = write(tmp_path / "good", GOOD)
    gap = write(tmp_path / "gap", GOOD | {"sitemap.xml": urlset("/")})
    lost = write(tmp_path / "lost", {k: v for k, v in GOOD.items() if "blog" not in k} | {"sitemap.xml": urlset("/")})
    a, b, c = (str(tmp_path / f"{x}.json") for x in "abc")
    assert cli.main(["scan", good, "--snapshot", a], spark) == 0
    assert "Nothing to report" in capsys.readouterr().out
    assert cli.main(["scan", gap, "--snapshot", b], spark) == 0
    assert cli.main(["scan", gap, "--baseline", b, "--format", "json", "--fail-on", "warning", "--fail-on-new"], spark) == 0
    out = capsys.readouterr().out
    report = json.loads(out[out.index("{\n") :])
    assert report["summary"]["total"] == 2 and report["summary"]["new"] == 0 and not report["findings"][0]["new"]
    assert cli.main(["scan", gap, "--fail-on", "warning"], spark) == 1
    assert cli.main(["scan", lost, "--snapshot", c], spark) == 1
    assert cli.main(["diff", a, c, "--format", "markdown", "--output", str(tmp_path / "r.md")], spark) == 1
    assert "Against the baseline" in (tmp_path / "r.md").read_text()
    assert cli.main(["diff", a, a, "--format", "sarif"], spark) == 0


@pytest.mark.parametrize("argv", [["scan", "/nowhere"], ["scan", "/", "--fail-on-new"], ["scan", "/", "--concurrency", "0"], ["scan", "/", "--header", "x"], ["diff", "/no.json", "/no.json"]])
def test_errors(spark, argv):
    assert cli.main(argv, spark) == 2


def test_stream(spark, tmp_path):
    schema = "url_key string, url string, http_status int, found_in_sitemap boolean, word_count long, seen_at timestamp"
    spark.sql("SELECT 'https://a.test/x' AS url_key, 'https://a.test/x' AS url, 404 AS http_status, true AS found_in_sitemap, 5L AS word_count, timestamp'2024-01-01' AS seen_at").write.parquet(str(tmp_path / "in"))
    got = []
    q = evaluate_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda found, epoch: got.extend(found.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [r.rule_id for r in got] == ["CC-SITEMAP-INDEXABILITY-004"] and len(other_families()) == 8
    assert PAGE
