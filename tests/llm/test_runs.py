"""Periodic runs, line dedup and the filter audit against brute force."""

import hashlib
import random
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pytest
from fixtures import FOLDER, ODD, duck, none, odd
from pyspark.sql import functions as F

from proofloom.llm import filter_audit, language, line_runs, periodic_runs, queries, vector_search


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_runs(words):
    """(start, period, length) of every run, by comparing the words at every distance."""
    numbers = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    found = {}
    for q in range(1, len(codes) // 2 + 1):
        change = np.diff(np.concatenate([[0], (codes[:-q] == codes[q:]).astype(int), [0]]))
        for start, end in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            if end - start + q >= max(12, 2 * q):
                found.setdefault((start, end + q), q)  # the smallest period comes first
    return sorted((start, q, stop - start) for (start, stop), q in found.items())


def brute_collapsed(words):
    gone = {i for start, q, length in brute_runs(words) for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def word_lists(seed, count, longest=200):
    rng = random.Random(seed)
    for _ in range(count):
        kinds = rng.choice([1, 2, 3, 5, 50])
        words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, longest))]
        if words and rng.random() < 0.5:
            at = rng.randrange(len(words))
            period = 1 + (len(words) - at) // (3 + rng.randrange(8))
            words = words[:at] + [words[at + i % period] for i in range(len(words) - at)]
        yield words


def test_fragments_of_one_tile_are_its_runs():
    for words in word_lists(0, 300):
        numbers = {}
        codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int32)
        assert [(s, q, e - s) for s, e, q in periodic_runs.tile_fragments(codes, 1, len(words)).tolist()] == brute_runs(words)


def test_tiles_hold_every_two_periods():
    for n in [*range(0, 400), 4_095, 4_096, 4_097, 20_000]:
        tiles = periodic_runs.tiles_of(n, 32 if n < 400 else 4_096)
        for q in range(1, n // 2 + 1) if n < 400 else (1, 511, 512, 1_023, n // 2):
            spans = sorted((at, stop) for at, stop, least, below in tiles if least <= q < below)
            assert spans[0][0] == 0 and max(s[1] for s in spans) == n
            assert all(one[1] - other[0] >= max(12, 2 * q) for one, other in zip(spans, spans[1:]))


@pytest.mark.parametrize("tile_words, long_chars", [(4_096, 1_000_000), (32, 1_000_000), (32, 100)])
def test_runs_equal_brute_force(spark, tile_words, long_chars):
    texts = [" ".join(words) for words in word_lists(tile_words + long_chars, 150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id bigint, text string").repartition(3)
    found = rows(periodic_runs.periodic_runs(docs, tile_words=tile_words, long_chars=long_chars))
    assert len(found) == len(texts) + 1
    for r in found:
        words = texts[r["doc_id"]].split()
        assert r["n_words"] == len(words) and r["collapsed"] == brute_collapsed(words)
        assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == brute_runs(words)


def test_periodic_runs_of_given_documents(spark):
    found = {r["doc_id"]: r for r in rows(queries.QUERIES["op11_periodic_runs"](spark, FOLDER))}
    texts = duck().execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(found) == len(texts)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in texts:
        words = [w.decode() for w in queries.looped_words(doc_id, text.encode().split())]
        runs = brute_runs(words)
        best = min(((-length, start, q) for start, q, length in runs), default=None)
        assert found[doc_id] == {
            "doc_id": doc_id, "n_runs": len(runs), "start": best and best[1], "length": best and -best[0], "period": best and best[2],
            "exponent_milli": best and 1000 * -best[0] // best[2], "runs_sha256": digest("".join(f"{s},{n},{q}\n" for s, q, n in runs)),
            "collapsed_sha256": digest(brute_collapsed(words)),
        }
    assert sum(r["n_runs"] > 0 for r in found.values()) > 10


def test_periodic_runs_of_odd_rows(spark):
    clashing = odd(spark).withColumns({"_row": F.lit(1), "words": F.lit(2), "period": F.lit(3), "_text": F.lit(4)})
    found = rows(periodic_runs.periodic_runs(clashing, tile_words=64))
    assert len(found) == len(ODD)
    expected = [(t or "").encode().split() for _, t, *_ in ODD]
    assert sorted((r["n_words"], r["collapsed"]) for r in found if r["doc_id"] != 5) == sorted((len(w), brute_collapsed([x.decode() for x in w])) for w in expected if len(w) < 10_000)
    (long,) = [r for r in found if r["doc_id"] == 5]  # its fifth word counts on, so nothing repeats
    assert long["n_words"] == max(map(len, expected)) and not long["runs"]
    assert rows(periodic_runs.periodic_runs(none(spark))) == []
    same = "a b " * 50_000  # one long run
    (one,) = rows(periodic_runs.periodic_runs(spark.createDataFrame([(1, same)], "doc_id bigint, text string")))
    assert one["collapsed"] == "a b" and [tuple(x) for x in one["runs"]] == [(0, 2, 100_000)]


def brute_lines(texts, least, chars=1):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text in enumerate(texts):
        for k in {key(line) for line in (text or "").split("\n")}:
            held[k] = held.get(k, 0) + 1
    gone = {k for k, n in held.items() if n >= least and len(k) >= chars}
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches, fanout, least, hot", [(1, 3, 3, 5_000), (4, 3, 10, 5_000), (7, 2, 4, 3), (9, 3, 1, 10)])
def test_lines_equal_brute_force(spark, monkeypatch, batches, fanout, least, hot):
    monkeypatch.setattr(line_runs, "HOT_SHARE", hot)
    rng = random.Random(batches)
    lines = ["", " ", "Subscribe now", "subscribe NOW\r", " x ", "É", "é", *[f"line {i}" for i in range(60)]]
    texts = ["\n".join(rng.choice(lines[: rng.choice([4, 20, 67])]) for _ in range(rng.randint(1, 12))) for _ in range(200)] + [None, "", "\n", "\n\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    found = rows(line_runs.drop_frequent_lines(docs, min_docs=least, batches=batches, fanout=fanout))
    assert [(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in sorted(found, key=lambda r: r["doc_id"])] == brute_lines(texts, least)


def test_runs_are_few_and_each_line_is_settled_once(spark):
    runs = line_runs.LineRuns(spark, min_docs=5, fanout=2, buckets=3)
    rng, total = random.Random(4), {}
    for batch in range(7):
        counts = {(h, -h): rng.randint(1, 3) for h in rng.sample(range(40), 20)}
        for key, n in counts.items():
            total[key] = total.get(key, 0) + n
        runs.add(spark.createDataFrame([(*key, n) for key, n in counts.items()], "line_hash bigint, line_hash2 bigint, docs bigint"))
        assert len(runs.runs()) == bin(batch + 1).count("1")  # two runs of a level become one of the next
        settled = [tuple(r) for r in runs.settled().collect()]
        assert sorted(settled) == sorted(key for key, n in total.items() if n >= 5)
    plan = runs.runs()[0].join(runs.runs()[1].withColumnRenamed("docs", "more"), line_runs.HASHES)._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "BroadcastHashJoin" in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("proofloom_lines_")]


def test_lines_of_odd_rows(spark):
    clashing = odd(spark).withColumns({"_key": F.lit(1), "batch": F.lit(2), "docs": F.lit(3), "line_hash": F.lit(4), "_text": F.lit(5)})
    found = rows(line_runs.drop_frequent_lines(clashing, min_docs=3))
    expected = brute_lines([r[1] for r in ODD], 3)
    assert sorted((r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found) == sorted(expected)
    assert sum(dropped for _, dropped, _ in expected) == 3  # the sentence stands in three rows
    assert rows(line_runs.drop_frequent_lines(none(spark))) == []


def brute_audit(masks, n=5):
    """shapley and steps by walking every order over documents, each a set of failed filters."""
    names = "ABCDE"[:n]
    out, removed_by = {}, dict.fromkeys(names, 0)
    for order in permutations(names):
        left = list(masks)
        for step, name in enumerate(order, 1):
            gone = [m for m in left if name in m]
            left = [m for m in left if name not in m]
            out["".join(order), step] = (len(left), len(gone), sum(name in m for m in masks) - len(gone), sum(m == {name} for m in masks))
            removed_by[name] += len(gone)
    return {(order, step): (*held, removed_by[order[step - 1]]) for (order, step), held in out.items()}


@pytest.mark.parametrize("n", [1, 3, 5])
def test_potentials_give_what_all_orders_give(spark, n):
    rng = random.Random(n)
    names = "ABCDE"[:n]
    masks = [{x for x in names if rng.random() < 0.3} for _ in range(80)]
    counts = spark.createDataFrame([("p", sum(1 << names.index(x) for x in m), 1, 0, 0) for m in masks], "part string, failed int, documents bigint, good bigint, toxic bigint")
    found = rows(filter_audit.audit_orders(filter_audit.coalition_values(counts, names), names))
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in found} == brute_audit(masks, n)
    values = {s: sum(1 for m in masks if m & set(s)) for k in range(n + 1) for s in combinations(names, k)}
    for i, name in enumerate(names):  # and what the definition of the Shapley value gives
        rest = [s for s in values if name not in s]
        exact = sum(factorial(len(s)) * factorial(n - 1 - len(s)) * (values[tuple(sorted((*s, name)))] - values[s]) for s in rest)
        assert {r["shapley"] for r in found if r["filter_order"][r["step"] - 1] == name} == {exact}


def test_failures_of_odd_rows(spark):
    clashing = odd(spark).withColumns({"id": F.lit(1), "part": F.lit(2), "failed": F.lit(3), "_text": F.lit(4), "_mask": F.lit(5)})
    found = rows(filter_audit.filter_failures(clashing))
    assert len(found) == len(ODD)
    copies = sorted((r["id"] for r in found if r["failed"] & 16), key=str)
    assert copies == [3]  # empty like the null text of 2; the repeated row 1 and rows without an id are no copies
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    audit = rows(filter_audit.audit_filters(odd(spark), labels))
    assert {r["part"] for r in audit} == {"", "en", "fr", "de"} and len(audit) == 4 * 600
    first = [r for r in audit if r["part"] == "en" and r["filter_order"] == "ABCDE"]
    assert sum(r["good_lost"] for r in first) == sum(r["toxic_lost"] for r in first) == sum(r[0] == 1 for r in ODD)
    assert rows(filter_audit.audit_filters(none(spark), labels)) == []
    assert len(rows(filter_audit.audit_filters(odd(spark), labels.limit(0)))) == 4 * 600


def test_signs_for_numbers_are_no_letters(spark):
    model = language.fit_language_model(spark.createDataFrame([("abab abab", "x"), ("zwzw zwzw", "y")], "text string, lang string"))
    assert language.predict(model, "½ ② 12 ²") == ("und", 0.0)
    assert language.predict(model, "½abab²") == language.predict(model, "abab") and language.letter_words("aé½b ②C") == ["aé", "b", "c"]


def test_a_repeated_query_asks_once(spark):
    vectors = np.random.default_rng(0).normal(size=(60, 4))
    held = [(i, vectors[i].tolist()) for i in range(60)] + [(20, vectors[20].tolist())] * 3 + [(40, vectors[3].tolist())]
    frame = spark.createDataFrame(held, "vec_id bigint, embedding array<double>").repartition(4)
    found = rows(vector_search.nearest_vectors(frame, F.col("vec_id") % 20 == 0, k=5))
    asked = {i: min(v for j, v in held if j == i) for i in (0, 20, 40)}
    expected = {}
    for i, vector in asked.items():
        ranked = sorted((-float(np.dot(vector, v)), j) for j, v in held if j != i)[:5]
        expected |= {(i, rank): j for rank, (_, j) in enumerate(ranked, 1)}
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found} == expected and len(found) == 15
