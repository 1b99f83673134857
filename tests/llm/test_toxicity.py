"""Toxicity: features by hand, held-out quality, odd rows, labels of the held-out fold unused."""

import zlib

import duckdb
import pytest

from millrace.llm import queries, toxicity

SCHEMA = "doc_id long, text string, lang string, label string, x int, score string"
AT = {name: k for k, name in enumerate(toxicity.FEATURES)}


def value(text, name, lexicon=None, fold=0):
    return toxicity.Reader(lexicon or {}).features(text, fold)[AT[name]]


def test_learnt_words_count_for_their_folds():
    lexicon = {"lowe": 0b00011, "chlla": 0b00001}
    assert value("Loweischaft, ein LOWEI! chllamente chll", "learnt_kinds", lexicon) == 3
    assert value("Loweischaft, ein LOWEI! chllamente chll", "learnt_rate", lexicon, 1) == pytest.approx(2 / 5)
    assert value("Loweischaft", "learnt", lexicon, 2) == 0


def test_learnt_words_by_hand(spark):
    rows = [(1 + k % 4, k // 4 % 2, f"{'vequ' + 'abcd'[k % 4] if k // 4 % 2 else 'plain'} shared{k} {'copied words' if k // 4 % 2 else 'else'}") for k in range(160)]
    got = toxicity.learnt_words(spark.createDataFrame([(*r, "x") for r in rows], "fold int, label int, text string, part string"))
    assert got["vequ"] == 0b11111 and {x[:4] for x in got} == {"vequ"}  # "copied" is followed by the same word everywhere
    rows = [(f, y, t) for f, y, t in rows if f == 2 or y == 0]
    assert toxicity.learnt_words(spark.createDataFrame(rows, "fold int, label int, text string"))["vequ"] == 0b11011


def test_features_by_hand():
    text = "You are an IDIOT, truly!! what a l0ser\nand a m o r o n here"
    assert value(text, "insult_rate") == pytest.approx(3 / 16) and value(text, "kinds") == 3
    assert value(text, "hidden_rate") == pytest.approx(2 / 16)
    assert value(text, "second_rate") == pytest.approx(1 / 16) and value(text, "near_rate") == pytest.approx(1 / 16)
    assert value(text, "shout_rate") == pytest.approx(1 / 16) and value(text, "exclaim_rate") == pytest.approx(2 / len(text))
    assert value(text, "masked_rate") == pytest.approx(1 / 16) and value(text, "spaced_rate") == pytest.approx(7 / 16)
    assert value("Straße ÉTÉ été", "capital_rate") == pytest.approx(4 / 12)
    assert toxicity.Reader({}).features("") == [0.0] * len(AT) and value(" \n", "words") == 0


@pytest.mark.parametrize("word", ["id10t", "st.u.p.i.d", "looooser", "$cum", "p@thetic", "tr*sh", "mor0n!!", "«clown»"])
def test_disguised_words_are_found(word):
    assert value(f"he is {word} indeed", "kinds") == 1


@pytest.mark.parametrize("text", ["the strash of idiotope", "10 losing moronity", "*** ** ****", "a b c d e f g", "|||| 0000 1111", "class assess"])
def test_plain_words_are_not(text):
    assert value(text, "kinds") == 0


def test_long_texts_are_read_whole():
    text = "word " * (toxicity.PIECE // 2) + "x" * (3 * toxicity.PIECE) + " moron"
    assert value(text, "kinds") == 1 and value(text, "words") == pytest.approx(13.17, abs=0.01)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op13_toxicity(spark, sf).collect()}
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
    assert [(len(rows),)] == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(rows[i].score, t) for i, t in labels if rows[i].held_out]
    pairs = [(a > b) + (a == b) / 2 for a, t in held for b, u in held if t == 1 and u == 0]
    # six toxic documents, of which one has an insult that no other document has
    assert sum(pairs) / len(pairs) > 0.9 and sum((s >= 0.5) == t for s, t in held) / len(held) > 0.95


def test_odd_rows_and_held_out_labels(spark):
    texts = [f"you are a {w} and {w} {k}" if k % 2 else f"some plain words of text {k}" for k, w in enumerate(["idiot", "moron", "scum"] * 40)]
    rows = [(k, t, "en", "x", 1, "s") for k, t in enumerate(texts)] + [(500, None, None, None, None, None), (501, "", "", "", 1, ""), (None, "no id", "en", "", 1, ""), (1, texts[1], "en", "x", 1, "s"), (502, "loser " * 300_000, "", "", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = [(k, k % 2) for k in range(120)] + [(None, 1), (3, None), (4, 7), (900, 1), (5, 1)]
    fair = toxicity.judge(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert fair.columns == ["doc_id", "held_out", "score", "predicted"]
    got = fair.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 120)
    assert next(r.predicted for r in got if r.doc_id == 502) == 1 and len({r.score for r in got if r.doc_id == 1}) == 1
    lies = [(k, 1 - t if t is not None and k is not None and zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, t in marks]
    again = toxicity.judge(df, spark.createDataFrame(lies, "doc_id long, toxic int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


@pytest.mark.parametrize(("marks", "score"), [([], 0.0), ([(1, 1), (2, 1), (3, 1), (4, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_labels_of_one_kind(spark, marks, score):
    df = spark.createDataFrame([(k, "text", "", "", 1, "") for k in range(8)], SCHEMA)
    assert {r.score for r in toxicity.judge(df, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()} == {score}
    assert toxicity.judge(df.limit(0), spark.createDataFrame(marks, "doc_id long, toxic int")).collect() == []
