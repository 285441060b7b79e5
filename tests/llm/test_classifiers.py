import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, nbsvm, toxicity, training
from tessera.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def test_fold():
    assert toxicity.fold("1D10T, clоwn!") == " idiot ciown"  # the second o is Cyrillic
    assert toxicity.fold("Cl0wn\u200bs") == " ciowns"


def test_lexicon_weights_exceptions_and_length():
    lex = toxicity.Lexicon({"bad": 3.0, "awful": 1.0}, ["not bad"])
    a = lex.automaton()
    assert lex.strength("a bad day", a) > lex.strength("an awful day", a) > 0
    assert lex.strength("this is not bad", a) == 0
    assert lex.strength("not bad but bad", a) > 0
    assert lex.strength("bad " + "word " * 500, a) < lex.strength("bad word", a)
    assert lex.strength("bad bad", a) > lex.strength("bad", a)
    assert lex.strength("abad bads", a) == 0 and lex.strength("", a) == 0 and lex.strength(None, a) == 0
    assert lex.score("bad bad bad", a) > lex.score("fine", a)


def test_terms_are_all_telling_words():
    counts = {"stupid": (50, 0), "pneumonoultramicroscopic": (20, 1), "ox": (30, 0), "fine": (50, 500), "rare": (2, 0)}
    assert set(toxicity.choose_terms(counts, 60, 600)) == {"stupid", "pneumonoultramicroscopic", "ox"}
    many = {f"w{i}": (9, 0) for i in range(6000)}
    assert len(toxicity.choose_terms(many, 60, 600)) == 6000


def corpus(n=400):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [f"{'abcdefgh'[k % 8]}{'mnop'[k // 8 % 4]}{k}" for k in rng.integers(0, 200, 40)]
        if toxic:
            words[int(rng.integers(0, 40))] = ["vilename", "v1lename", "grotsack"][i % 3]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_held_out(docs, spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows], "doc_id long, quality int, toxic int")
    d = docs([(i, t) for i, t, _ in rows])
    lexicon = toxicity.train(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d, lexicon).collect()}
    assert len(got) == len(rows)
    held = [i for i, _, _ in rows if got[i].held_out]
    assert 0 < len(held) < len(rows)
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(d, lexicon).collect()}
    assert kept == {i for i in got if got[i].predicted == 0}


def test_training_never_sees_the_held_out_fold(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    d = docs([(i, f"t {i}") for i in range(300)])
    s = training.labelled_sample(d, labels, "quality", 5, 0, 1000)
    assert s.where(crc_mod(F.col("doc_id"), 5) == 0).count() == 0
    assert s.count() == d.where(crc_mod(F.col("doc_id"), 5) != 0).count()
    assert training.labelled_sample(d, labels, "quality", 5, 0, 17).count() == 17


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8) + (50 if i % 2 else 0)) for i in range(200)]
    y = [i % 2 for i in range(200)]
    model = nbsvm.fit(rows, y, bits=7)
    assert all((model.score(r) > 0.5) == bool(t) for r, t in zip(rows, y))


def test_one_class_or_no_rows():
    assert nbsvm.fit([], []).score(np.zeros(0, int)) == pytest.approx(0.5)
    assert nbsvm.fit([np.array([1])] * 9, [1] * 9).score(np.array([1])) > 0.8


def test_grams_mark_repeats():
    assert len(nbsvm.grams("a " * 40)) > len(nbsvm.grams("a b"))
    assert len(nbsvm.grams("")) == 0 and (np.diff(nbsvm.grams("x y z x y")) > 0).all()


def test_network_learns_and_averages_windows():
    rng = np.random.default_rng(0)
    texts = [("abab cdcd " if k else "xyxy zwzw ") * int(rng.integers(1, 60)) for k in rng.integers(0, 2, 200)]
    y = np.array([int(t[0] == "a") for t in texts])
    wins = np.concatenate([langid.windows(t.encode())[:1] for t in texts])
    net = langid.fit(wins, y, ["x", "a"], epochs=3)
    net.compile()
    lang, score = net.predict([t.encode() for t in texts] + [None, b"", b"123 !?", "漢字".encode()])
    assert lang[:200] == [t[0] for t in texts] and lang[200:203] == ["und"] * 3 and lang[203] != "und"
    assert all(0 <= s <= 1 for s in score)


def test_windows_hold_the_whole_text():
    t = bytes(range(1, 200)) * 5
    assert langid.windows(t).tobytes().rstrip(b"\0") == t and langid.windows(b"").shape == (1, langid.WINDOW)


@pytest.mark.parametrize("query", ["op2_toxicity", "op5_language_id", "op8_quality_classifier"])
def test_odd_input(odd, spark, query):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    d = odd.withColumn("lang", F.lit("xx")).withColumn("score", F.lit(1))
    for frame in (d, d.limit(0)):
        if query == "op2_toxicity":
            out = toxicity.score(frame, toxicity.train(frame, labels))
        elif query == "op5_language_id":
            out = langid.identify(frame, langid.train(frame))
        else:
            out = nbsvm.score(frame, nbsvm.train(frame, labels))
        rows = out.collect()
        assert len(rows) == frame.count()
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)


def test_held_out_accuracy_on_the_data(spark):
    from tessera.llm.queries import QUERIES

    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op5_language_id"](spark, SF).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op8_quality_classifier"](spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.quality == r.predicted for r in got]) > 0.9


def test_toxicity_recall_and_precision_on_the_data(spark):
    from tessera.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    got = QUERIES["op2_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    caught = sum(r.toxic and r.predicted for r in got)
    assert caught >= 0.9 * sum(r.toxic for r in got) and caught >= 0.98 * sum(r.predicted for r in got)
