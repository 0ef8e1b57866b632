"""URL filters: parsing and rules against a plain version, reputation by known cases."""

import re

import pytest
from pyspark.sql import functions as F

from biblark.llm import url_reputation as urls

ODD = [
    None, "", "no scheme", "http://", "://x", "http://Org/", "https://ORG", "https://a.org?x://y/z", "https://example.org/es/", "https://EXAMPLE.org/es/1?q", "https://notexample.org/es/x", "https://a.example.org/en/12#f",
    "https://a.example.org/EN/12", "x://com/fr/", "x://w.com/de/#", "x://w.com/frde/", "x://w.com", "http://ÀB.org/ä?", "http://u:p@h.co.uk:80/p", "http://1.2.3.4/en/", "http://[::1]:8/", "http://xcom/fr/", "http://a.com./fr/", "http://a\nb.com/fr/\n2?", "http://h.net/" + "p" * 100_000,
]


def parsed(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def test_hosts_paths_rules(spark, tmp_path):
    rows = [(i, u, "x", "x", 1) for i, u in enumerate([*ODD, *ODD])] + [(None, "http://a.org/", "x", "x", 1)]
    spark.createDataFrame(rows, "page_id long, url string, host string, rule string, n int").write.parquet(f"{tmp_path}/pages.parquet")
    found = urls.op13_url_filters(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        url = "http://a.org/" if r["page_id"] is None else rows[r["page_id"]][1]
        host, path = parsed(url)
        assert (r["host"], r["path"]) == (host, path)
        rule, verdict = ruled(host, path)
        assert r["rule"] == rule and (verdict is None or r["verdict"] == verdict) and r["verdict"] in ("allow", "block")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert urls.op13_url_filters(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("host", "domain", "suffix"), [("a.b.org", "b.org", "org"), ("b.org", "b.org", "org"), ("org", "org", "org"), ("x.y.co.uk", "y.co.uk", "co.uk"), ("co.uk", "co.uk", "uk"), ("u@a.b.fr:80", "b.fr", "fr"), ("10.0.0.1:8", "10.0.0.1", ""), ("", "", ""), ("a.b.de.", "b.de", "de")])
def test_domains(spark, host, domain, suffix):
    row = spark.createDataFrame([(host,)], "h string").select(urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).first()
    assert tuple(row) == (domain, suffix)


def judged(spark, outcomes, hosts, rules=()):
    seen = spark.createDataFrame([(h, g) for h, good, n in outcomes for g in [1] * good + [0] * (n - good)], "host string, good int")
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    return {r["host"]: r["verdict"] for r in urls.judged_pages(spark, pages, list(rules), seen).collect()}


def test_own_evidence_decides(spark):
    said = judged(spark, [("bad.a.org", 2, 60), ("good.a.org", 60, 60), ("one.a.org", 0, 1)], ["bad.a.org", "good.a.org", "one.a.org", "unseen.net"])
    assert said == {"bad.a.org": "block", "good.a.org": "allow", "one.a.org": "allow", "unseen.net": "allow"}


def test_little_evidence_is_shrunk_towards_the_domain(spark):
    """One bad page condemns a host of a domain whose hosts are alike and bad, none of a good one; unseen hosts go by their domain."""
    outcomes = [*[(f"s{i}.spam.net", 1, 40) for i in range(8)], ("new.spam.net", 0, 1), *[(f"s{i}.fine.org", 39, 40) for i in range(8)], ("new.fine.org", 0, 1)]
    said = judged(spark, outcomes, ["new.spam.net", "new.fine.org", "unseen.spam.net", "unseen.fine.org", "unseen.info"])
    assert said == {"new.spam.net": "block", "new.fine.org": "allow", "unseen.spam.net": "block", "unseen.fine.org": "allow", "unseen.info": "allow"}


def test_rules_come_before_reputation(spark):
    said = judged(spark, [("x.org", 0, 50)], ["x.org", "y.org"], [("allow", "x.org", "/"), ("block", "y.org", "/p")])
    assert said == {"x.org": "allow", "y.org": "block"}


def test_no_outcomes(spark):
    assert judged(spark, [], ["x.org"]) == {"x.org": "allow"}
