"""Language, quality, toxicity, line rules and tokens against brute force, the library and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from fixtures import FOLDER, LABELLED, LONG, ODD, duck, none, odd
from hypothesis import given, settings
from hypothesis import strategies as st

from proofloom.llm import common, language, quality_classifier, quality_rules, queries, sentencepieces, toxicity


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = duck().execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted(plain(r) for r in df.select(columns).collect()) == sorted(plain(r) for r in cursor.fetchall())


def test_languages_of_held_out_texts(spark):
    truth = dict(duck().execute("SELECT doc_id, lang FROM documents").fetchall())
    found = [r for r in rows(queries.QUERIES["op1_language_id"](spark, FOLDER)) if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_words_back_off_to_shorter_grams(spark):
    docs = spark.createDataFrame([("abab abab cdcd", "x"), ("xyxy xyxy zwzw", "y"), ("abab", None), (None, "z")], "text string, lang string")
    model = language.fit_language_model(docs)
    assert model.languages == ["x", "y"]
    assert language.predict(model, "abab")[0] == "x" and language.predict(model, "ababab")[0] == "x"  # known word, known grams
    assert language.predict(model, "qxyq")[0] == "y" and language.predict(model, "ÄBA")[0] == "x"
    assert language.predict(model, "qqq") == ("x", 0.5)  # nothing known: all alike, the first language
    assert language.predict(model, "123 !") == language.predict(model, None) == ("und", 0.0)


def test_languages_of_odd_rows(spark):
    model = language.fit_language_model(odd(spark))
    found = rows(language.identify_languages(odd(spark), model, keep=("node",)))
    assert len(found) == len(ODD) and {r["lang_pred"] for r in found} <= {"en", "de", "fr", "und"}
    assert [r["lang_pred"] for r in found if r["doc_id"] in (2, 3, 4, 6)] == ["und"] * 4
    assert language.keep_identified(odd(spark), model).columns == odd(spark).columns
    blank = language.fit_language_model(none(spark))
    assert blank.languages == [] and {r["lang_pred"] for r in rows(language.identify_languages(odd(spark), blank))} == {"und"}
    assert rows(language.identify_languages(none(spark), model)) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_repeated_words_equal_brute_force(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    assert quality_rules.repeated_words(words) == len(inside)


def test_line_rules(spark):
    fails = lambda line: quality_rules.line_fails(line, line.split())
    assert not fails("A plain sentence ends here.") and fails("Read more")
    assert fails("Home | News | Sport.") and fails("a### b*** c%%%.") and fails("NO!! NOT!! NOW!! .")
    assert fails("We value the use of cookies, see our Privacy Policy.") and not fails("a | b c d e f g h i j k.")
    good, bad = "One good line of text that ends well. " * 8, "Home | News | Sport | About\n" * 3
    found = {r["doc_id"]: r for r in rows(quality_rules.clean_lines(odd(spark).union(spark.createDataFrame([(50, good.strip() + "\n" + bad, None, None, None, None)], odd(spark).schema))))}
    assert found[50]["cleaned"] == good.strip() + "\n" and found[50]["n_removed_words"] == 21 and found[50]["base_failed"]
    assert found[5]["n_words"] == len(LONG.split()) and found[5]["base_failed"] and found[2]["cleaned"] == "" and not found[2]["kept"]
    assert rows(quality_rules.clean_lines(none(spark))) == []


def test_tokens_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    given_texts = [t for (t,) in duck().execute("SELECT text FROM documents").fetchall()]
    rng = random.Random(7)
    made = ["".join(rng.choice("ab the▁ \n\t.,éñ日👍0<>|") for _ in range(rng.randint(0, 60))) for _ in range(2_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(given_texts + made + [r[1] for r in ODD])], "doc_id bigint, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    encoded = sentencepieces.encode_documents(docs, outputs=("ids", "decoded", "ids_sha256"), verify="texts").cache()
    for r in rows(encoded):
        ids = library.encode(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
    back = {r["doc_id"]: r["text"] for r in rows(sentencepieces.decode_documents(encoded))}
    assert back == {i: t.replace("▁", " ") for i, t in texts.items()}
    assert rows(sentencepieces.encode_documents(none(spark))) == []


def test_a_differing_segment_ends_the_job():
    held = sentencepieces.Encoder(sentencepieces.default_model())
    ids = held.vocabulary.encode_segment("▁hello")
    held.same_as_library(["▁hello"], [ids])
    with pytest.raises(sentencepieces.Differs):
        held.same_as_library(["▁hello"], [ids + ids])


def auc(scores, labels):
    scores, labels = np.asarray(scores), np.asarray(labels)
    ones, zeros = scores[labels == 1], scores[labels == 0]
    return (ones[:, None] > zeros[None]).mean() + 0.5 * (ones[:, None] == zeros[None]).mean()


@pytest.mark.parametrize("name, label, least", [("op6_quality_classifier", "quality", 0.99), ("op7_toxicity", "toxic", 0.9)])
def test_classifiers_on_held_out_labels(spark, name, label, least):
    truth = dict(duck(LABELLED).execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    found = [r for r in rows(queries.QUERIES[name](spark, LABELLED)) if r["held_out"] and r["doc_id"] in truth]
    labels = [truth[r["doc_id"]] for r in found]
    assert auc([r["score"] for r in found], labels) > least
    assert np.mean([r["predicted"] == y for r, y in zip(found, labels)]) > 0.95


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x, signs = rng.normal(size=(40, 4)), np.where(rng.random(40) < 0.5, 1, -1)
    cost = 0.7
    weights = quality_classifier.dual_coordinate_descent([(np.arange(4), v) for v in x], signs, 4, cost, passes=2_000)
    limit = np.where(signs == 1, 40 / (2 * (signs == 1).sum()), 40 / (2 * (signs == -1).sum())) * cost
    value = lambda w: w @ w / 2 + (limit * np.maximum(0, 1 - signs * (x @ w[:4] + w[4]))).sum()
    best = value(weights)
    assert all(best <= value(weights + rng.normal(scale=s, size=5)) + 1e-3 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


@pytest.mark.parametrize("fit, score", [(quality_classifier.fit_quality_model, quality_classifier.score_quality), (toxicity.fit_toxicity_model, toxicity.score_toxicity)])
def test_classifiers_on_odd_rows(spark, fit, score):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (6, 0), (8, None), (None, 1)], "doc_id bigint, quality int")
    labelled = quality_classifier.labelled_texts(odd(spark), labels, "quality")
    found = rows(score(odd(spark), fit(labelled)))
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    alone = rows(score(odd(spark), fit(labelled.where("label = 1"))))
    assert len({r["score"] for r in alone}) == 1 and alone[0]["predicted"] == 1  # one class only: its smoothed share
    unlabelled = rows(score(odd(spark), fit(labelled.where("label = 7"))))
    assert {r["score"] for r in unlabelled} == {0.5} and rows(score(none(spark), fit(labelled.where("label = 7")))) == []


def test_toxic_words_are_found_and_others_left(spark):
    rng = random.Random(0)
    plain = [f"word{i}" for i in range(300)]
    text = lambda bad: " ".join(rng.choice(plain) for _ in range(60)) + (" you nasty brute " if bad else " ") + " ".join(rng.choice(plain) for _ in range(60))
    labelled = spark.createDataFrame([(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)], "key bigint, text string, label int")
    tests = spark.createDataFrame([(i, text(i % 2 == 0)) for i in range(100)], "doc_id bigint, text string")
    found = rows(toxicity.score_toxicity(tests, toxicity.fit_toxicity_model(labelled)))
    assert all(r["predicted"] == int(r["doc_id"] % 2 == 0) for r in found)


def test_an_insult_of_few_texts_counts_in_a_large_class(spark):
    rng = np.random.default_rng(1)
    plain = np.array(["w" + "".join(chr(97 + int(d)) for d in f"{i:04}") for i in range(3_000)])
    text = lambda: " ".join(plain[rng.permutation(3_000)[:1_000]])
    labelled = [(i, ("you vilest brute " if i % 150 == 0 else "") + text(), 1) for i in range(1_200)] + [(i, text(), 0) for i in range(1_200, 1_300)]
    model = toxicity.fit_toxicity_model(spark.createDataFrame(labelled, "key bigint, text string, label int"))
    assert model.value("you vilest brute") > model.value("you unseen brute") > model.value("never before seen")


def test_words_are_split_alike():
    assert re.findall(queries.mixing.WORD, "a\x0bb\xa0c d") == ["a", "b\xa0c", "d"]


def test_a_worker_lets_go_of_what_a_task_did_not_ask_for():
    made = []
    ask = lambda: common.kept_by_worker(("test",), lambda: made.append(1) or object())
    task = lambda kernel: list(common.ending(lambda batches: map(kernel, batches))([1, 2]))
    assert len(task(lambda _: ask())) == 2 and len(task(lambda _: ask())) == 2 and made == [1]  # kept while tasks ask for it
    task(lambda batch: batch)
    assert not common._kept
