"""Documents that tasks render: valid as a whole, equal to what lists give, and read again by tasks."""

import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from sitefold.operators import findings
from sitefold.operators.state import Site, derive, with_defaults
from sitefold.sinks import documents, reports
from sitefold.sources import snapshot
from tests.test_walk_and_rules import random_site


def loaded(document):
    return json.loads("\n".join(document.stream()))


def odd_site(spark):
    rows = [(f'https://a.test/"{k}\\ é😀\n\t', 200 if k % 2 else 404, k % 3 == 0, [f"https://a.test/{k + 1}"]) for k in range(30)]
    state = spark.createDataFrame([(u, *r) for u, *r in [(r[0], *r) for r in rows]], "url_key string, url string, http_status int, found_in_sitemap boolean, internal_links_out array<string>").repartition(5)
    return Site(derive(with_defaults(state)), "https://a.test/", None, "2024-01-01T00:00:00.000000Z").cached()


@pytest.mark.parametrize("of", ["odd", "random"])
def test_reports_by_tasks_equal_those_of_lists(spark, of, tmp_path):
    old, new = (odd_site(spark), odd_site(spark)) if of == "odd" else (random_site(spark, 7), random_site(spark, 7, (1, 5)))
    if of == "odd":
        new = Site(new.state.where("http_status = 200").withColumn("word_count", F.lit(5).cast("long")), new.base_url, new.public_origin, new.scanned_at)
    found = findings.against_baseline(new, old).cache()
    items = reports.rows_of(found)
    assert items and loaded(documents.findings_json("scan", found, new, old)) == json.loads(reports.to_json("scan", items, new, reports.diff_of(old, new)))
    plain = found.drop("is_new")
    assert loaded(documents.findings_json("scan", plain)) == json.loads(reports.findings_to_json(reports.rows_of(plain)))
    sarif, want = loaded(documents.findings_sarif(plain)), json.loads(reports.to_sarif(items))
    for run in (sarif["runs"][0], want["runs"][0]):
        for r in run["results"]:
            r["partialFingerprints"] = {k: json.loads(v) for k, v in r["partialFingerprints"].items()}
    assert sarif == want
    whole = lambda document: "\n".join(document.stream())
    compared = reports.diff_of(old, new)
    assert of == "random" or compared["lost"] and compared["changed"]
    assert whole(documents.findings_markdown(found, new, old)) == reports.to_markdown(items, new, compared)
    assert whole(documents.findings_text(found, new, old)) == reports.to_text(items, new, compared)
    assert whole(documents.findings_markdown(plain, new)) == reports.to_markdown(reports.rows_of(plain), new) and whole(documents.findings_text(plain)) == reports.to_text(reports.rows_of(plain))
    documents.findings_sarif(plain).write(str(tmp_path / "sarif"))
    parts = sorted(glob.glob(str(tmp_path / "sarif" / "part-*")))
    assert json.loads("".join(open(p, encoding="utf-8").read() for p in parts))["version"] == "2.1.0"


def test_documents_without_items_and_with_equal_ones(spark):
    none = findings.run_rules(random_site(spark, 8)).limit(0)
    assert loaded(documents.findings_json("scan", none))["findings"] == [] and loaded(documents.findings_sarif(none))["runs"][0]["results"] == []
    site = random_site(spark, 8)
    assert "\n".join(documents.findings_markdown(none, site).stream()) == reports.to_markdown([], site) and "\n".join(documents.findings_text(none).stream()) == reports.to_text([])
    # one rule with errors and warnings: one heading in Markdown; in the text one where they follow one another
    rows = findings.run_rules(site).limit(3).withColumn("rule_id", F.lit("OWN")).withColumn("severity", F.lit("error"))
    mixed = rows.unionByName(rows.withColumn("severity", F.lit("warning"))).cache()
    assert "\n".join(documents.findings_markdown(mixed, site).stream()) == reports.to_markdown(reports.rows_of(mixed), site)
    assert "\n".join(documents.findings_text(mixed).stream()) == reports.to_text(reports.rows_of(mixed))
    one = findings.run_rules(random_site(spark, 8)).limit(1)
    twice = loaded(documents.findings_json("scan", one.unionByName(one)))
    assert len(twice["findings"]) == 2 and twice["findings"][0] == twice["findings"][1] and twice["summary"]["total"] == 2


@pytest.mark.parametrize("make", [odd_site, lambda spark: random_site(spark, 9)])
def test_snapshots_by_lines(spark, make, tmp_path):
    """A file and a folder; the whole is JSON that the other reader takes too."""
    site = make(spark)
    document, text = documents.snapshot_json(site, "2024-01-01T00:00:00Z"), io.StringIO()
    document.copy_to(text)
    (tmp_path / "one.json").write_text(text.getvalue(), encoding="utf-8")
    document.write(str(tmp_path / "parts"))
    rows = sorted(map(str, site.state.select("url_key", "url", *snapshot.URL_STATE.names[1:]).collect()))
    for path in ("one.json", "parts"):
        back = snapshot.read_json(spark, str(tmp_path / path))
        assert sorted(map(str, back.state.select("url_key", "url", *snapshot.URL_STATE.names[1:]).collect())) == rows and back.base_url == site.base_url
    whole = json.loads(text.getvalue())
    assert list(whole["urls"]) == sorted(whole["urls"], key=str.encode) and len(whole["urls"]) == len(rows)
    (tmp_path / "pretty.json").write_text(json.dumps(whole, indent=2), encoding="utf-8")
    assert snapshot.read_json(spark, str(tmp_path / "pretty.json")).state.count() == len(rows)
    (tmp_path / "bad.json").write_text(text.getvalue().replace('"total_urls": ', '"total_urls": 9'), encoding="utf-8")
    with pytest.raises(ValueError):
        snapshot.read_json(spark, str(tmp_path / "bad.json"))


def test_snapshots_whose_first_part_is_not_the_largest(spark, tmp_path):
    """Parts of any sizes, empty ones too; a further header among them is an error."""
    site, text = odd_site(spark), io.StringIO()
    documents.snapshot_json(site, "2024-01-01T00:00:00Z").copy_to(text)
    lines, folder = text.getvalue().splitlines(keepends=True), tmp_path / "parts"
    folder.mkdir()
    for k, part in enumerate(([], lines[:2], lines[2:25], [], lines[25:])):
        (folder / f"part-{k}.txt").write_text("".join(part), encoding="utf-8", newline="")
    want = sorted(map(str, site.state.select(*snapshot.URL_STATE.names).collect()))
    for read in (snapshot.read_json, snapshot.read_lines):
        back = read(spark, str(folder))
        assert sorted(map(str, back.state.select(*snapshot.URL_STATE.names).collect())) == want and back.base_url == site.base_url
    (folder / "part-9.txt").write_text(lines[0], encoding="utf-8")
    with pytest.raises(ValueError, match="by lines"):
        snapshot.read_json(spark, str(folder))
