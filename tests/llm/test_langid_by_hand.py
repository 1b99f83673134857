"""Language ID's likelihoods, priors and posterior in plain Python."""

import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm import langid

TEXTS = {
    "en": "the weather at the sea was good and the people went out to look at the ships and came home late in the evening of the day ",
    "de": "das wetter an der see war gut und die leute gingen hinaus um die schiffe zu sehen und kamen erst spaet am abend wieder heim ",
    "fr": "le temps au bord de la mer etait beau et les gens sont sortis pour voir les bateaux et ne sont rentres que tard dans la soiree ",
}


@pytest.fixture(scope="module")
def rows():
    out = []
    for k, (lang, text) in enumerate(TEXTS.items()):
        for i in range(60):
            words = text.split()
            body = " ".join(words[(i * 3 + j) % len(words)] for j in range(40 if i % 5 else 2)) + f" {i}"
            out.append((100 * k + i, body * (4 if i % 2 else 1), lang if i % 7 else [None, "en", "xx"][i // 7 % 3], [f"site{i % 4}.{lang}", f"shared{i % 2}.org", None][i % 3]))
    return [*out, (900, "", "en", "site1.en"), (901, None, None, None), (902, "123 456", "de", "shared0.org"), (903, "zzz qqq", None, "site1.de"), (904, "zzz qqq", "few", "site1.de")]


def test_posterior_by_hand(spark, rows, monkeypatch):
    monkeypatch.setattr(langid, "MIN_CHARS", 1500)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in langid.identify_languages(df).collect()}
    chars = Counter()
    for _, text, lang, _ in rows:
        if lang is not None:
            chars[lang] += len(text or "")
    names = sorted(x for x, n in chars.items() if n >= 1500)
    assert names == ["de", "en", "fr"]

    def grams(text):
        data = np.frombuffer(b" " + (text or "").encode() + b"  ", np.uint8)
        return data, langid._trigrams(np.concatenate([data, np.full(2, 32, np.uint8)]))[: len(data)]

    table = np.full((langid.BUCKETS, 3), 0.1, np.float32)  # few documents, so all that declare a language are fitted on
    for _, text, lang, _ in rows:
        if lang in names:
            data = np.frombuffer(b" " + (text or "").encode() + b"  ", np.uint8)
            np.add.at(table[:, names.index(lang)], langid._trigrams(data), 1)
    table = np.log(table / table.sum(axis=0, dtype=np.float64)).astype(np.float32)
    like, letters, best = {}, {}, {}
    for i, text, _, _ in rows:
        data, t = grams(text)
        useful = langid._FOLD[data] != 32
        letters[i] = int(useful.sum())
        like[i] = [float((table[t, k].astype(np.float64) * useful).sum()) / max(letters[i], 1) for k in range(3)]
        best[i] = int(np.argmax(like[i])) if letters[i] else None
    host = {i: h or "" for i, _, _, h in rows}
    suffix = {i: h.rpartition(".")[2] for i, h in host.items()}
    known = [i for i in best if best[i] is not None]
    everywhere = Counter(best[i] for i in known)
    overall = [(everywhere[k] + 1) / (len(known) + 3) for k in range(3)]

    def smoothed(ids, above, weight):
        n = Counter(best[i] for i in ids)
        return [(n[k] + weight * above[k]) / (len(ids) + weight) for k in range(3)]

    prior = {}
    for i in host:
        above = smoothed([j for j in known if suffix[j] == suffix[i]], overall, langid.SUFFIX_WEIGHT)
        prior[i] = smoothed([j for j in known if host[j] == host[i]], above, langid.HOST_WEIGHT)
    said = {i: None if lang is None else names.index(lang) if lang in names else 3 for i, _, lang, _ in rows}
    pairs = Counter((said[i], best[i]) for i in known if said[i] is not None)
    for i, _, lang, _ in rows:
        count = min(letters[i] / langid.OVERLAP, langid.EVIDENCE)
        logs = []
        for k in range(3):
            told = 0.0 if said[i] is None else math.log((pairs[said[i], k] + 1) / (sum(pairs[x, k] for x in range(4)) + 3 + 1))
            logs.append(count * like[i][k] + math.log(prior[i][k]) + told)
        r = got[i]
        if not letters[i]:
            assert r.language is None and not r.kept, i
        elif said[i] == 3:
            assert r.language == lang and r.kept and r.posterior is None, i
        else:
            top = max(logs)
            assert r.posterior == pytest.approx(1 / sum(math.exp(x - top) for x in logs), rel=1e-3), i
            order = sorted(logs)
            assert r.language == names[int(np.argmax(logs))] or order[-1] - order[-2] < 1e-3, i
            assert r.kept == (r.posterior >= langid.MIN_POSTERIOR) and r.text_language == names[best[i]]


def test_hosts_and_declarations_judge_short_texts_better_than_the_text(spark):
    """Texts of one or two words that the languages share: the text alone is often wrong, the fusion seldom."""
    import random

    draw, rows = random.Random(2), []
    shared = ["zabo", "zori", "zuma", "zeka", "zilo"]
    for k, (lang, text) in enumerate(TEXTS.items()):
        words = text.split()
        for i in range(150):
            rows.append((1000 * k + i, " ".join(draw.choice(words) for _ in range(30)), lang, f"host{i % 5}.{lang}"))
        for i in range(60):
            rows.append((10_000 + 1000 * k + i, draw.choice(shared), lang if i % 2 else None, f"host{i % 5}.{lang}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in langid.identify_languages(df).collect()}
    real = {i: h.rpartition(".")[2] for i, _, _, h in rows}
    short = [i for i in real if i >= 10_000]
    text_alone, fused = (sum(getattr(got[i], c) == real[i] for i in short) / len(short) for c in ("text_language", "language"))
    assert fused > 0.95 and fused > text_alone + 0.3
