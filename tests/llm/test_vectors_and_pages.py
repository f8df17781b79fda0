"""Nearest neighbours against brute force, and main text of pages of several shapes."""

import numpy as np

from pyspark.sql import functions as F

from sievewright.llm import extraction, neighbours
from sievewright.llm.common import Stages


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    x = centres[rng.integers(0, 30, 3000)] + 0.7 * rng.normal(size=(3000, 32))
    x[100:110] = x[50]
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(3000, None, ""), (3050, [0.0] * 32, ""), (3100, [float("nan")] * 32, ""), (3150, [None] * 32, ""), (3200, [], ""), (None, [1.0] * 32, ""), (3250, [1.0, 2.0], "")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), Stages(spark)).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(score, 12)))[:5]
        hits += len({r[1] for r in own} & set(best.tolist()))
        assert all(abs(r[2] - score[r[1]]) < 1e-9 for r in own)
        if q == 50:
            assert [r[1] for r in own] == [100, 101, 102, 103, 104]
    assert hits >= 0.9 * 5 * 60
    assert not {r["query_id"] for r in got} - set(range(0, 3000, 50))


def test_neighbours_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in sorted(neighbours.nearest(few, few.where("vec_id = 0"), Stages(spark)).collect(), key=lambda r: r["rank"])] == [1, 2]
    assert neighbours.nearest(few.limit(0), few.limit(0), Stages(spark)).count() == 0


def exact(x, ids, q, k=5):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    score = unit @ unit[q]
    score[q] = -2
    return set(ids[np.lexsort((ids, -np.round(score, 12)))[:k]].tolist())


def test_neighbours_of_clusters_come_from_few_candidates(spark):
    """Recall against brute force, and how much of the table a query is given, on clustered vectors and with a third of all rows near-equal."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 48))
    x = centres[rng.integers(0, 200, 6000)] + 0.15 * rng.normal(size=(6000, 48))
    x[::3] = centres[0] + 0.01 * rng.normal(size=(2000, 48))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    queries, stages = vectors.where("vec_id % 50 = 0"), Stages(spark)
    got = {}
    for r in neighbours.nearest(vectors, queries, stages).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & exact(x, np.arange(6000), q)) for q in range(0, 6000, 50))
    assert hits >= 0.9 * 5 * 120
    calm = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if i % 3], "vec_id long, embedding array<double>")
    points = calm.select("embedding", F.array("vec_id").alias("ids"), F.lit(48).alias("dim"))
    setting = neighbours.fit(points, calm.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit(48).alias("dim")), 4000, 5)[48]
    assert setting.recall >= 0.9 and setting.share < 0.1


def test_neighbours_on_both_sides_of_a_shelf(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[:300] = x[0] + 0.001 * rng.normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())], "vec_id long, embedding array<double>").cache()
    setting, told = {8: neighbours.Setting(6, 2.4, 8, 60)}, []
    for shelf, queries in ((1 << 20, 1 << 20), (64, 4)):
        monkeypatch.setattr(neighbours, "SHELF", shelf)
        monkeypatch.setattr(neighbours, "QUERIES", queries)
        rows = neighbours.nearest(vectors, vectors.where("vec_id % 30 = 0"), Stages(spark), settings=setting).collect()
        told.append(sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows))
    assert told[0] == told[1] and len(told[0]) == 5 * 30
    none = {8: neighbours.Setting(20, 0.01, 8, 1)}  # buckets outside the cluster hold nobody else: those queries are held against everything
    rows = neighbours.nearest(vectors, vectors.where("vec_id % 30 = 0"), Stages(spark), settings=none).collect()
    assert all({r["vec_id"] for r in rows if r["query_id"] == q} == exact(x, np.arange(900), q) for q in range(300, 900, 30))


def page(i, body):
    return f"<html><head><title>t{i}</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav>{body}<footer>&copy; {i}</footer></body></html>"


def test_main_text_shapes():
    text = extraction.main_text
    assert text(None) == text("") == ""
    assert text(page(1, "<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four &lt;5</article>")) == "A & B\n\none two three\n\nfour <5"
    assert text(page(1, '<div class="ad">Buy</div><main><p>Text</p><aside>More</aside><form>Name</form></main>')) == "Text"
    assert text(page(1, '<article><p>Text</p><section class="comments"><p>First!</p></section></article>')) == "Text"
    assert text(page(1, '<div class="content"><p>Just text</p></div><div class="sidebar">x</div><div id="cookie-notice">y</div>')) == "Just text"
    assert text("<article><p>cut off &am") == "cut off &am"
    assert text("<article><p>cut <b") == "cut"
    assert text("no tags & none") == "no tags & none"


def test_heads_without_an_end_and_names_that_only_speak_of_readers():
    text, long = extraction.main_text, " ".join(f"Sentence number {i} of ten that make a paragraph." for i in range(10))
    assert text("<html><head><title>t</title><body><p>Hello there</p>") == "Hello there"
    assert text("<html><head><title>t</title><script>x<p>y</script><p>Hello there</p>") == "Hello there"
    assert text("<head><meta charset=utf-8><title>a</title>Hello there") == "Hello there"
    assert text("<html><head><style>p{}</style></head><body><header>Top</header><p>Hello there</p></body>") == "Hello there"
    assert text(f'<body><div class="post has-comments"><p>{long}</p></div></body>') == long
    assert text(f'<article><p class="respond-time">They took long to respond.</p><p>{long}</p></article>').startswith("They took long to respond.")
    assert text(f'<article><p>{long}</p><p>See also <a href=/a>One</a>, <a href=/b>Two</a></p></article>').endswith("See also One, Two")
    for name in ("comments", "comment-list", "post-comments", "comments_area", "disqus_thread", "respond", "x comment-body y", "wp-comments-12"):
        assert text(f'<article><p>{long}</p><div class="{name}"><p>First! {long}</p></div></article>') == long, name


def test_wrappers_and_extraction(spark):
    rows = [(i, "https://a.example/x" if i % 4 else "https://b.example/y", page(i, f"<div class=box><p>Same words here</p></div><div>{''.join(f'<p>text {i} {j}</p>' for j in range(1 + i % 4))}</div>"), "extra") for i in range(60)]
    rows += [(60, None, page(60, "<article>alone</article>"), ""), (61, "not a url", None, ""), (None, "https://a.example/z", "", ""), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4)
    got = {r["page_id"]: r for r in extraction.extract(pages, Stages(spark)).collect()}
    assert extraction.extract(pages, Stages(spark)).count() == len(rows)
    assert got[5]["text"] == "\n\n".join(f"text 5 {j}" for j in range(2))
    assert got[60]["text"] == "alone"
    assert got[61]["text"] == got[None]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    shape = {r["host"]: r["expression"] for r in extraction.expressions(pages, Stages(spark)).collect()}["a.example"]
    assert "(p # /p)+" in shape and "nav a # /a /nav" in shape
    assert extraction.extract(pages.limit(0), Stages(spark)).count() == 0


def test_template_texts_in_articles(spark):
    tip = "".join(f"<p class=tip>Tip {j} of this site</p>" for j in range(3))
    rows = [(i, "https://a.example/x", page(i, f"<article><h1>Title {i}</h1><div class=box><span>Read in our app</span></div>{''.join(f'<p>text {i} {j}</p>' for j in range(1 + i % 4))}<ul>{tip}</ul></article>"), "") for i in range(40)]
    rows += [(300 + i, "https://copies.example/x", page(0, "<article>one text</article>"), "") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for parts in (1, 4):
        got = {r["page_id"]: r["text"] for r in extraction.extract(pages.repartition(parts), Stages(spark)).collect()}
        assert all(got[i] == "\n\n".join([f"Title {i}", *(f"text {i} {j}" for j in range(1 + i % 4))]) for i in range(40))
        assert all(got[300 + i] == "one text" for i in range(30))


def test_template_texts_by_their_share_of_a_host(spark):
    rows = [(i, f"https://{host}.example/x", page(i, f"<div class=box><p>Same words here</p></div><div><p>text {i}</p></div>"), "") for host, ids in (("few", range(6)), ("many", range(10, 50))) for i in ids]
    rows += [(100, "https://many.example/cut", "<html><head><title>t</title></head><body><div class=top><p>Cut", ""), (101, "https://few.example/odd", page(1, "<div><p>odd one</p></div>"), "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for parts in (1, 4):
        got = {r["page_id"]: r["text"] for r in extraction.extract(pages.repartition(parts), Stages(spark)).collect()}
        assert all(got[i] == f"text {i}" for i in (*range(6), *range(10, 50)))
        assert got[100] == "Cut"
        assert got[101] == "odd one"


def test_names_are_only_a_prior():
    text, long = extraction.main_text, "A long sentence of an article that goes on for some time. " * 6
    assert text(page(1, f'<article><div class="alert social widget"><p>{long}</p></div><div class="related search banner"><p>{long}!</p></div></article>')) == f"{long.strip()}\n\n{long.strip()} !"
    assert text(page(1, '<article><p>See <a href=x>this</a> now</p><div class="sponsored">Buy now</div></article>')) == "See this now"
    assert text(page(1, "<div><p>Words of a page that marks nothing.</p></div><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul>")) == "Words of a page that marks nothing."


def test_wrappers_change_what_is_read_and_order_does_not(spark):
    """Pages without any mark of an article: the host's pages tell the slots of its frame from those of its texts."""
    frame = "<div class=a><p>Read us every day, in print and on the web</p></div>"
    rows = [(i, "https://plain.example/x", f"<html><body>{frame}<div class=b><p>Text number {i} with words of its own {i * 7}</p><p>{'More of it. ' * (i % 5)}{i}</p></div><div class=c>{('Sun', 'Rain', 'Snow')[i % 3]} in the town today</div></body></html>", "") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    alone = {r[0]: extraction.main_text(r[2]) for r in rows}
    told = []
    for parts in (1, 5):
        dealt = pages.repartition(parts).orderBy(F.rand(parts))
        told.append({r["page_id"]: r["text"] for r in extraction.extract(dealt, Stages(spark)).collect()})
    assert told[0] == told[1]
    assert all("Read us" in alone[i] and "Read us" not in told[0][i] and "town today" not in told[0][i] and told[0][i].startswith(f"Text number {i} ") for i in range(60))


def test_near_copies_of_a_page_are_no_template(spark):
    body = [f"<p>{' '.join(f'word{i}x{j}' for j in range(40))}</p>" for i in range(8)]
    rows = [(i, "https://copies.example/x", page(i, f"<article>{''.join(body[:3])}<p>edit {i} {'z' * 30}</p>{''.join(body[4:])}</article>"), "") for i in range(30)]
    rows += [(100 + i, "https://copies.example/y", page(i, f"<article><p>{' '.join(f'other{i}y{j}' for j in range(60))}</p></article>"), "") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages, Stages(spark)).collect()}
    assert all(got[r[0]] == extraction.main_text(r[2]) for r in rows)


def test_very_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "deep text here" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>paragraph {i} of many</p>" for i in range(20000)) + "</article>"
    pages = spark.createDataFrame([(1, "https://x.example/", page(1, deep), ""), (2, "https://x.example/", page(2, long), "")], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages, Stages(spark)).collect()}
    assert got[1] == "deep text here"
    assert got[2].count("\n\n") == 19999
