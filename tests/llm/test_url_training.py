"""URL models are fitted on all URLs that rules decide."""

from millrace.llm import urls


def test_every_ruled_url_fits_or_calibrates(spark, monkeypatch):
    counted, scored, models, scores = [], [], urls._models, urls._scores
    monkeypatch.setattr(urls, "TRAIN_PER_CLASS", 10, raising=False)
    monkeypatch.setattr(urls, "_models", lambda t: counted.append(t.count()) or models(t))
    monkeypatch.setattr(urls, "_scores", lambda u, keep, m: scored.append(u.count()) or scores(u, keep, m))
    rows = [(i, f"http://a.org/{i}") for i in range(60)] + [(100 + i, f"http://b.com/de/{i}") for i in range(60)] + [(300, "http://c.net/")]
    assert urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).count() == 121
    assert counted[0] + scored[0] == 120
