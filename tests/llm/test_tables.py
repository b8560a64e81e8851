"""Sharding, mixing, pages, vectors, near duplicates and the pipeline against brute force and invariants."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from fixtures import FOLDER, ODD, SENTENCE, duck, none, odd
from pyspark.sql import functions as F

from proofloom.llm import html_extraction, mixing, ngram_join, queries, sharding, vector_search


def rows(df):
    return [r.asDict() for r in df.collect()]


def check_shards(found, shards):
    slots = {s: sorted(r["slot"] for r in found if r["shard"] == s) for s in range(shards)}
    assert all(held == list(range(len(held))) for held in slots.values())
    return np.array([[sum(r[m] for r in found if r["shard"] == s) for m in ("size", "tokens")] + [len(slots[s])] for s in range(shards)], dtype=float)


def test_shards_are_balanced_in_all_measures(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "word", "longer-word"]) for _ in range(rng.randint(1, 60))) for _ in range(700)]
    docs = spark.createDataFrame([(i, texts[i % 700] if i < 1_500 else "the same copy") for i in range(2_300)], "doc_id bigint, text string")
    found = rows(sharding.pack_shards(docs, shards=4, piece_rows=50, block_items=64))  # several levels, split copies
    totals = check_shards(found, 4)
    assert (np.ptp(totals, axis=0) / totals.mean(axis=0)).max() < 0.05
    assert sorted(r["doc_id"] for r in found) == list(range(2_300))
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["shard"] == by_id[i + 700]["shard"] for i in range(700))  # small groups stay together
    again = rows(sharding.pack_shards(docs.repartition(7), shards=4, piece_rows=50, block_items=64))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in again} == {r["doc_id"]: (r["shard"], r["slot"]) for r in found}


def test_large_texts_and_rows_without_an_id_are_dealt_evenly(spark):
    copies = [(i, "x" * 20_000) for i in range(200)] + [(1_000 + i, f"text {i}") for i in range(3_000)]
    sizes = check_shards(rows(sharding.pack_shards(spark.createDataFrame(copies, "doc_id bigint, text string"))), 16)[:, 0]
    assert np.ptp(sizes) < 1.5 * 20_001  # 12 or 13 of the large ones each
    nameless = [(None, "the same text")] * 2_000 + [(i, f"text {i}") for i in range(3_000)]
    totals = check_shards(rows(sharding.pack_shards(spark.createDataFrame(nameless, "doc_id bigint, text string"))), 16)
    assert (np.ptp(totals, axis=0) / totals.mean(axis=0)).max() < 0.05


def test_items_go_where_the_dot_product_is_highest():
    items = np.random.default_rng(0).integers(1, 50, size=(40, 3)).astype(float)
    shares = items / items.sum(axis=0)
    left = np.full((3, 3), 1 / 3)
    expected = np.zeros(40, dtype=int)
    for i in sorted(range(40), key=lambda i: (-shares[i].max(), i)):
        expected[i] = max(range(3), key=lambda s: (left[s] @ shares[i], -s))
        left[expected[i]] -= shares[i]
    assert (sharding.pack_block(items, 3) == expected).all()


def test_shards_of_odd_rows(spark, tmp_path):
    found = rows(sharding.pack_shards(odd(spark)))
    check_shards(found, 16)
    assert len(found) == len(ODD)
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ODD)
    assert rows(sharding.pack_shards(none(spark))) == []
    sharding.write_shards(odd(spark).where("doc_id > 1"), str(tmp_path / "shards"), shards=2)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == sum(1 for r in ODD if r[0] and r[0] > 1)


def reshared(sizes, weights, repeats=3):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    target, open_, rest = {}, set(sizes), float(sum(sizes.values()))
    while True:
        level = rest / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > repeats * sizes[s]}
        if not above:
            return target | {s: level * weights[s] for s in open_}
        for s in above:
            target[s] = float(repeats * sizes[s])
            rest -= target[s]
        open_ -= above


@pytest.mark.parametrize("seed", range(5))
def test_targets_equal_repeated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([0, 1, 5, 100, 10_000]) + rng.randint(0, 9) for i in range(12)}
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    frame = mixing.cyclic_weights(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint"), "source")
    found = {r["source"]: r["target"] for r in rows(mixing.source_targets(frame))}
    assert found == pytest.approx(reshared(sizes, weights))


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join("w" * rng.randint(5, 50)), "big" if i % 3 else f"s{i % 7}") for i in range(6_000)], "doc_id bigint, text string, source string")
    plan = rows(mixing.mixing_plan(docs))
    for source in {r["source"] for r in plan}:
        held = [r for r in plan if r["source"] == source]
        assert sum(r["size"] * r["copies"] for r in held) == pytest.approx(held[0]["target"], rel=0.1)
        assert max(r["copies"] for r in held) <= 3
    taken = Counter(r["doc_id"] for r in rows(mixing.mix(docs)))
    assert taken == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})


def test_mix_of_odd_rows(spark):
    clashing = odd(spark).withColumns({"rate": F.lit(1), "_source": F.lit(2), "doc": F.lit(3), "col": F.lit(4)})
    plan = rows(mixing.mixing_plan(clashing))
    assert len(plan) == len(ODD) and {r["size"] for r in plan if r["doc_id"] in (2, 3, 4)} == {0}
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert rows(mixing.mix(none(spark))) == rows(mixing.mixing_plan(none(spark))) == []


def test_rows_without_an_id_draw_apart(spark):
    texts = [(None, "one two", "a")] * 600 + [(None, f"one two {i}", "a") for i in range(400)] + [(i, "w " * 200, "b") for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, source string").repartition(5)
    plan = rows(mixing.mixing_plan(docs))
    target = {r["size"]: r["target"] for r in plan}
    assert sum(r["size"] * r["copies"] for r in plan if r["doc_id"] is None) == pytest.approx(target[2], rel=0.1)
    mixed = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in rows(mixing.mix(docs)))
    expected = Counter()
    for r in plan:
        expected[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert mixed == +expected


PAGES = [
    ("<article><header><h1>T</h1></header><p>a <b>b</b>c</p><footer>x</footer><section class='comments'><article class=comment><p>no</p></article></section></article>", "T\n\na bc"),
    ("<div class='page has-sidebar'><div id=sidebar>x<ul><li>y</ul></div><div class=content><p>one<p>two &amp; three<br>four</div></div>", "one\n\ntwo & three four"),
    ("<div class='widget-page'><article>hello<ul><li>a<li>b</ul></article></div>", "hello\n\na\n\nb"),
    ("<script>var a='<p>x</p>'", ""), ("<p>a<!-- c -->b</p><a href=\"x", "ab"), ("plain &lt; text", "plain < text"), (None, ""), ("", ""),
    ("<body><header>H</header><nav>n</nav><h1>t</h1><p>x <a href=#>l</a> y</p><form>f<input></form><div role=alert>warn</div><p hidden>h</p></body>", "t\n\nx l y"),
    ("<article><pre>a\n  b</pre><table><tr><td>1<td>2</table><blockquote>q</blockquote>tail</article>", "a b\n\n1\n\n2\n\nq\n\ntail"),
    ("<div><a href=1>m1</a> <a href=2>m2</a></div><p>text here</p>", "text here"), ("<p>x</p></div></p><p>y", "x\n\ny"), ("<div>" * 3_000 + "deep", "deep"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert html_extraction.main_text(html) == text


def test_style_tree_removes_what_all_pages_of_a_host_share(spark):
    page = lambda i: f"<body><div class=x1><p>Weather today</p></div><div class=x2><p>Story {i} is told at length.</p><div class=x3>Tell your friends</div></div></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(99, "http://lone.example/", page(0)), (100, None, None)], "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in rows(html_extraction.extract_main_text(pages))}
    assert all(found[i] == f"Story {i} is told at length." for i in range(12))
    assert found[99] == "Weather today\n\nStory 0 is told at length.\n\nTell your friends" and found[100] == ""
    assert rows(html_extraction.extract_main_text(pages.limit(0))) == []


def test_near_copies_and_copies_lose_nothing_of_the_article(spark):
    declared = lambda i: f"<body><nav>n</nav><article><h1>One title</h1><h2>Background</h2><p>Paragraph {i} of the story.</p><h2>Outlook</h2></article></body>"
    listed = "<article><h1>Another title</h1><ul><li>a point</ul><blockquote>a quote</blockquote></article>"
    plain = lambda i: f"<body><div class=t><h1>Title {i}</h1></div><div class=s><p>Story {i} ends.</p></div></body>"
    made = [("near", declared(i)) for i in range(8)] + [("near", listed)] * 6 + [("plain", plain(i)) for i in range(3)] + [("plain", plain(9).replace("div class=s", "section"))] * 9
    pages = spark.createDataFrame([(i, f"http://{host}.example/{i}", html) for i, (host, html) in enumerate(made)], "page_id bigint, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in rows(html_extraction.extract_main_text(pages))}
    assert [found[i] for i in range(8)] == [f"One title\n\nBackground\n\nParagraph {i} of the story.\n\nOutlook" for i in range(8)]
    assert {found[i] for i in range(8, 14)} == {"Another title\n\na point\n\na quote"}
    assert {found[i] for i in range(17, 26)} == {"Title 9\n\nStory 9 ends."}  # nine copies are one page


def test_style_tree_judges_declared_articles_too(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><p>Story {i} is told.</p><h2>Notes</h2><p>Note {i}.</p><div class=x7>Tell your friends</div></article>"
    copy = lambda i: f"<article><h1>Same</h1><h2>Notes</h2><div class=x7>Tell your friends</div><p>One.</p><p>Copy {i}.</p></article>"
    made = [("many", page(i).replace("<h2>Notes</h2>", "")) for i in range(9)] + [("copies", copy(i)) for i in range(9)] + [("few", page(i)) for i in range(3)]
    pages = spark.createDataFrame([(i, f"http://{host}.example/{i}", html) for i, (host, html) in enumerate(made)], "page_id bigint, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in rows(html_extraction.extract_main_text(pages))}
    assert [found[i] for i in range(9)] == [f"Title {i}\n\nStory {i} is told.\n\nNote {i}." for i in range(9)]
    assert [found[9 + i] for i in range(9)] == [f"Same\n\nNotes\n\nTell your friends\n\nOne.\n\nCopy {i}." for i in range(9)]
    assert [found[18 + i] for i in range(3)] == [f"Title {i}\n\nStory {i} is told.\n\nNotes\n\nNote {i}.\n\nTell your friends" for i in range(3)]


def test_given_pages_keep_their_articles(spark):
    pages = dict(duck().execute("SELECT page_id, html FROM pages").fetchall())
    found = rows(queries.QUERIES["op8_html_extraction"](spark, FOLDER))
    assert len(found) == len(pages) and all(r["n_chars"] == len(r["text"]) > 0 for r in found)
    for r in found:
        article = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert html_extraction.main_text(article) == r["text"]


def nearest_brute(data, asks, k):
    found = {}
    for q, v in data:
        if asks(q):
            near = sorted(((-float(np.dot(v, w)), i) for i, w in data if i != q), key=lambda s: (round(s[0], 12), s[1]))[:k]
            found[q] = [i for _, i in near]
    return found


def test_factor_one_is_exact_and_smaller_factors_find_most(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1_500, 12)) * rng.uniform(0.5, 2, size=(1_500, 1))
    vectors[300:700] = vectors[300]  # a hot vector
    data = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    expected = nearest_brute([(i, np.array(v)) for i, v in data], lambda q: q % 20 == 0, 20)

    def found(factor):
        near = rows(vector_search.nearest_vectors(frame, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=200, block_queries=30, leaf=16))
        return {q: [r["vec_id"] for r in sorted((r for r in near if r["query_id"] == q), key=lambda r: r["rank"])] for q in expected}

    assert found(1.0) == expected
    relaxed = found(0.8)
    assert np.mean([len(set(relaxed[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9


@pytest.mark.parametrize("kind", ["signs", "one_hot", "outlier"])
def test_ties_and_outliers_are_exact(spark, kind):
    rng = np.random.default_rng(6)
    if kind == "outlier":
        vectors = rng.normal(size=(400, 8))
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors[7] *= 1e8
    else:
        vectors = rng.choice([-1.0, 1.0], size=(400, 10)) if kind == "signs" else np.eye(400)[rng.permutation(400)]
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(20, v.tolist()) for v in vectors[200:240]]  # an id of many vectors
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(4)
    near = rows(vector_search.nearest_vectors(frame, F.col("vec_id") % 40 == 0, k=10, shard_rows=150, leaf=16))
    for q in (0, 40, 360):
        found = [r["vec_id"] for r in sorted((r for r in near if r["query_id"] == q), key=lambda r: r["rank"])]
        score = lambda v: float((np.array(v) * vectors[q]).sum())
        assert found == [i for i, _ in sorted(((i, v) for i, v in data if i != q), key=lambda r: (-score(r[1]), r[0]))[:10]]


def test_pruning_skips_points():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(500, 6)) + 40 * c for c in range(4)])
    order, nodes = vector_search.build_tree(points, 16)
    held = points[order]
    found, _, visited = vector_search.search_tree(nodes, held, points[:50], 5, 1.0)
    assert visited < 50 * len(points) / 3
    for q, places in zip(points[:50], found):
        assert set(places.tolist()) == set(np.argsort(((held - q) ** 2).sum(axis=1), kind="stable")[:5].tolist())


def test_vectors_that_take_no_part(spark):
    held = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, []), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (20, [1.0, 0.0])]
    frame = spark.createDataFrame(held, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(vector_search.nearest_vectors(frame, F.col("vec_id") % 20 == 0))]
    assert sorted(found) == [(0, 1, 20, 1.0), (0, 2, 7, 0.5), (0, 3, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 7, 0.5), (20, 3, 7, 0.5)]
    assert rows(vector_search.nearest_vectors(frame.limit(0), F.col("vec_id") % 20 == 0)) == []


def classes_brute(docs):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for i, text in docs:
        words = (text or "").translate(upper).split(" ") if text else []
        words = [w for w in words if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def chained(seed, n=220):
    """Texts in chains: each differs a little from the one before, so ends of a chain are not similar."""
    rng = random.Random(seed)
    docs, text = [], []
    shared = [f"p{k}" for k in range(30)]
    for i in range(n):
        if i % 20 == 0:
            text = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(3, 90))]
            if rng.random() < 0.5:
                text = text[:20] + shared + text[20:]
        else:
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"W{rng.randint(0, 500)}"
        docs.append((i, " ".join(text)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "GROUP_NODES", 4)
    monkeypatch.setattr(ngram_join, "ORDER_SAMPLE", 3)
    monkeypatch.setattr(ngram_join, "BUCKET_POSTINGS", 400)
    docs = chained(seed)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.similar_classes(frame))}
    assert found == classes_brute(docs)


def test_a_passage_of_many_documents_makes_few_groups(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(12 + i % 3))) for i in range(300)]  # similar to none, nearly
    docs += [(1_000 + i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(0, 300, 3)]
    groups, qualifying = [], ngram_join._qualifying

    def counted(lists, placed, percent):
        groups.append(300 - placed.count() + placed.select("group").distinct().count())  # a node that is not placed is a group
        return qualifying(lists, placed, percent)

    monkeypatch.setattr(ngram_join, "_qualifying", counted)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.similar_classes(frame))}
    assert found == classes_brute(docs) and len({c for _, c in found.values()}) == 300
    assert groups[0] <= 20


def test_any_order_of_tokens_keeps_a_shared_one():
    rng = np.random.default_rng(0)
    universe = np.unique(rng.integers(0, 2**63, size=400, dtype=np.uint64))
    for _ in range(300):
        one = np.unique(rng.choice(universe, rng.integers(1, 60)))
        other = np.unique(np.concatenate([one[rng.random(len(one)) < 0.9], rng.choice(universe, rng.integers(0, 8))]))
        often = np.unique(rng.choice(universe, 150))
        rank = rng.integers(0, 9, size=len(often))
        both = len(np.intersect1d(one, other))
        if 100 * both >= 75 * (len(one) + len(other) - both):
            assert len(np.intersect1d(ngram_join.first_tokens(one, often, rank), ngram_join.first_tokens(other, often, rank)))


def test_classes_of_given_documents(spark):
    documents = duck().execute("SELECT doc_id, text FROM documents").fetchall()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(queries.QUERIES["op10_ngram_jaccard_join"](spark, FOLDER))}
    assert found == classes_brute([(i, " ".join((t or "").split())) for i, t in documents])


def test_classes_of_odd_rows(spark):
    found = rows(ngram_join.similar_classes(odd(spark)))
    assert len(found) == len(ODD)
    same = [r for r in found if r["n_shingles"] == len(SENTENCE.split()) - 4]
    assert {r["component_id"] for r in same} == {1} and len(same) == 3
    assert all(r["component_id"] == r["doc_id"] for r in found if not r["n_shingles"])
    kept = ngram_join.keep_one_of_each(odd(spark))
    texts = [r["text"] for r in rows(kept)]
    assert kept.columns == odd(spark).columns and texts.count(SENTENCE) == 1 and texts.count(None) == 2 and len(texts) == len(ODD) - 3  # "Fin." is near
    assert rows(ngram_join.similar_classes(none(spark))) == rows(ngram_join.keep_one_of_each(none(spark))) == []


def test_classes_that_share_an_id_or_have_none_all_stay(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(30))
    docs = [(None, text("a")), (None, text("b")), (None, text("b") + " end"), (4, text("c")), (4, text("d")), (5, text("d")), (3, text("e")), (None, text("e"))]
    kept = rows(ngram_join.keep_one_of_each(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)))
    near = [r["text"] for r in kept if r["text"].startswith("b0 ")]
    assert len(near) == 1 and sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, text("a")), (0, near[0]), (4, text("c")), (4, text("d")), (3, text("e"))])
    texts = [r["text"] for r in rows(ngram_join.keep_one_of_each(odd(spark)))]
    assert sorted(texts, key=str) == sorted([SENTENCE] + [r[1] for r in ODD if not (r[1] or "").startswith(SENTENCE)], key=str)  # a repeated row, a copy, "Fin."


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    texts = dict(duck().execute("SELECT doc_id, text FROM documents").fetchall())
    good = {i for i, q in duck().execute("SELECT doc_id, quality FROM labels").fetchall() if q == 1}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        held[name] = [r["doc_id"] for r in rows(docs)]
        assert name == names[-1] or docs.columns == columns
    assert len(held["language_id"]) == before
    assert len(good - set(held["quality_classifier"])) <= 0.05 * len(good)
    classes = classes_brute([(i, " ".join(texts[i].split())) for i in held["quality_classifier"]])
    assert sorted(held["ngram_join"]) == sorted({c for _, c in classes.values()})
    assert set(held["mixing"]) <= set(held["ngram_join"]) and max(Counter(held["mixing"]).values()) <= 3
    assert sorted(held["sentencepiece"]) == sorted(held["mixing"])


def test_pipeline_of_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids"]
    none(spark).write.parquet(str(tmp_path / "empty/documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "empty/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
