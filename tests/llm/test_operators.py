"""Each operator against brute force, an exact round trip or held-out truth, on small tables with awkward rows."""

import datetime
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnweave.llm import boilerplate, combine, distinctive, labelled_pages, markup, mixing, reading, registry, sitelines, stuffed, tokens, topn
from tarnweave.llm.common import behind_host, grouped_prefix_sum, host_of
from tests.conftest import DATA
from tests.oracle import same, tables

T0 = datetime.datetime(2024, 1, 1)
LONG = "long line of words " * 3000


@pytest.fixture(scope="module")
def con():
    return tables(DATA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, con, name):
    same(registry.QUERIES[name](spark, DATA), con, registry.SQL[name])


COLUMNS = {"p1_found": ["fetch_id", "term"], "p2_found": ["word", "url"], "p3_found": ["fetch_id", "line_no"], "p4_found": ["fetch_id", "markup"], "p5_found": ["word", "url"], "p6_found": ["fetch_id", "line_no"], "p7_found": ["fetch_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["source"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]


def test_hosts(spark):
    urls = [("https://WWW.A.example:443/x", "a.example"), ("http://u:p@b.test/?q", "b.test"), ("https://www.m.c.test:443/", "m.c.test"), ("nothing", None), ("", None), (None, None)]
    df = spark.createDataFrame([(u,) for u, _ in urls], "u string")
    assert [r[0] for r in df.select(host_of("u")).collect()] == [h for _, h in urls]
    assert [r[0] for r in df.select(behind_host("u")).collect()] == ["/x", "/?q", "/", "nothing", "", None]


def test_prefix_sum_of_hot_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if k % 3 else f"g{k % 7}", k, rng.choice([None, 0, 1, 5])) for k in range(500)] + [(None, k, 1) for k in range(5)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r["g"], r["k"]): r["before"] for r in grouped_prefix_sum(df, "g", ["k"], "v", "before", 6).collect()}
    sums = defaultdict(int)
    for g, k, v in rows:
        assert got[g, k] == sums[g]
        sums[g] += v or 0
    assert grouped_prefix_sum(df.where("false"), "g", ["k"], "v", "before").count() == 0


# 1


def brute_weights(rows, wanted):
    import re

    bags = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t, _ in rows}
    units = defaultdict(set)
    for i, _, u in rows:
        for w in bags[i]:
            units[w].add(u)
    lengths = [sum(b.values()) for b in bags.values() if b]
    average, n = sum(lengths) / len(lengths), len(lengths)
    total = Counter()
    for b in bags.values():
        total.update(b)
    out = {}
    for i in wanted:
        for w, tf in bags.get(i, {}).items():
            if len(units[w]) > 1:
                tfn, mean = tf * math.log2(1 + distinctive.C * average / sum(bags[i].values())), total[w] / n
                out[i, w] = (math.log2(1 + mean) + tfn * math.log2((1 + mean) / mean)) / (1 + tfn)
    return out


def test_characteristic_terms(spark):
    words = ["the", "fox", "dog", "hen", "rare7", "É", "x"]
    rng = random.Random(2)
    rows = [(k, None if k == 3 else "" if k == 4 else LONG if k == 5 else " ".join(rng.choices(words, k=12)), f"u{k // 2}") for k in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id int, body string, u string, term string, tf int")
    asked = spark.createDataFrame([(1,), (3,), (5,), (7,), (7,), (99,)], "id int")
    got = {(r["id"], r["term"]): r["weight"] for r in distinctive.characteristic_terms(df, asked, "id", "body", "u").collect()}
    assert got == pytest.approx(brute_weights(rows, [1, 3, 5, 7, 99]))
    assert distinctive.characteristic_terms(df.where("false"), asked, "id", "body", "u").count() == 0
    assert distinctive.characteristic_terms(df, asked.where("false"), "id", "body", "u").count() == 0


def test_common_terms_count_little(spark):
    rows = [(k, "the the the of " + ("quokka quokka" if k < 2 else f"word{k % 5}"), f"u{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "id int, body string, u string")
    got = distinctive.characteristic_terms(df, df.where("id = 0"), "id", "body", "u").orderBy(F.col("weight").desc()).first()
    assert got["term"] == "quokka"


# 2


def test_combined_ranking(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), f"i{k}", float(rng.randint(1, 6)), 10.0 ** rng.randint(-3, 9), "x") for k in range(120)]
    rows += [("a", "n1", None, 1.0, "x"), ("a", "n2", float("nan"), 1.0, "x"), ("a", "n3", 1.0, float("inf"), "x"), ("a", None, 1.0, 1.0, "x"), ("solo", "s", 1.0, 2.0, "x")]
    df = spark.createDataFrame(rows, "g string, i string, s double, r double, projection string")
    got = {(r["g"], r["i"]): r["projection"] for r in combine.combined_ranking(df, "g", "i", {"s": 1, "r": 1}).collect()}
    good = [r for r in rows if r[1] and r[2] is not None and math.isfinite(r[2]) and math.isfinite(r[3])]

    def mid(value, values):
        return (sum(v < value for v in values) + sum(v == value for v in values) / 2) / len(values)

    want = {}
    for g, i, s, r, _ in good:
        peers = [x for x in good if x[0] == g]
        want[g, i] = (mid(s, [x[2] for x in peers]) + mid(r, [x[3] for x in peers]) - 1) / math.sqrt(2)
    assert got == pytest.approx(want, abs=1e-8)
    assert combine.combined_ranking(df.where("false"), "g", "i", {"s": 1, "r": 1}).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3)), max_size=25), st.integers(1, 6))
def test_positions_batch_by_batch(rows, size):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([float(r[1]) for r in rows], pa.float64())], ["_g", "_v"])
    batches = [whole.slice(k, size) for k in range(0, len(rows), size)]
    got = [r for b in combine._positions(iter(batches)) for r in b.to_pylist()]
    assert [(r["_g"], r["_v"]) for r in got] == rows
    for r in got:
        peers = [v for g, v in rows if g == r["_g"]]
        assert (r["_below"], r["_equal"]) == (sum(v < r["_v"] for v in peers), peers.count(r["_v"]))
        assert r["_edge"] == (r["_v"] in (min(peers), max(peers)))


def test_first_component():
    assert combine.first_component(np.array([[1, 0.4], [0.4, 1]])) == pytest.approx([math.sqrt(0.5)] * 2)
    assert combine.first_component(np.eye(2)) == pytest.approx([math.sqrt(0.5)] * 2)
    assert combine.first_component(np.array([[1, -0.4], [-0.4, 1]])) is None
    three = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert combine.first_component(three) == pytest.approx(np.abs(np.linalg.eigh(three)[1][:, -1]))


def test_scores_that_contradict_each_other_weigh_alike(spark):
    df = spark.createDataFrame([(float(k), -float(k), float(k)) for k in range(9)], "a double, b double, c double")
    assert combine.principal_loadings(df, {"a": 1, "b": 1}) == pytest.approx({"a": math.sqrt(0.5), "b": math.sqrt(0.5)})
    assert combine.principal_loadings(df, {"a": 1, "b": -1}) == pytest.approx({"a": math.sqrt(0.5), "b": -math.sqrt(0.5)})
    assert combine.principal_loadings(df, {"a": 1, "b": 1, "c": 1}) == pytest.approx(dict.fromkeys("abc", 1 / math.sqrt(3)))


def test_loadings(spark):
    rows = [(float(k), float(k) + (k % 3), -float(k), 1.0) for k in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = combine.principal_loadings(df, {"a": 1, "b": 1, "c": -1})
    matrix = np.corrcoef(np.array(rows)[:, :3].T)
    vector = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    assert [abs(got[k]) for k in "abc"] == pytest.approx(vector.tolist())
    assert got["c"] < 0 < got["a"]
    flat = combine.principal_loadings(df, {"a": 1, "d": 1})
    assert sum(v * v for v in flat.values()) == pytest.approx(1)


# 3


def brute_cut(scores, near, far):
    n = len(scores)
    best = None
    for mask in range(2**n):
        side = [mask >> i & 1 for i in range(n)]
        cost = sum(max(s, 0) * (1 - x) + max(-s, 0) * x for s, x in zip(scores, side, strict=True))
        cost += sum(near[i] * (side[i] != side[i - 1]) for i in range(1, n)) + sum(far[i] * (side[i] != side[i - 2]) for i in range(2, n))
        if best is None or cost < best - 1e-9:
            best = cost
    return best


def cut_cost(scores, near, far, side):
    cost = sum(max(s, 0) * (1 - x) + max(-s, 0) * x for s, x in zip(scores, side, strict=True))
    return cost + sum(near[i] * (side[i] != side[i - 1]) for i in range(1, len(side))) + sum(far[i] * (side[i] != side[i - 2]) for i in range(2, len(side)))


def max_flow(scores, near, far):
    """Edmonds-Karp on the same graph, for its value."""
    n = len(scores)
    s, t = n, n + 1
    cap = defaultdict(float)
    for i, v in enumerate(scores):
        cap[s, i] += max(v, 0)
        cap[i, t] += max(-v, 0)
        for j, w in ((i - 1, near[i]), (i - 2, far[i])):
            if j >= 0 and i:
                cap[j, i] += w
                cap[i, j] += w
    flow = 0.0
    while True:
        parent, queue = {s: None}, [s]
        for u in queue:
            for v in range(n + 2):
                if v not in parent and cap[u, v] > 1e-12:
                    parent[v] = u
                    queue.append(v)
        if t not in parent:
            return flow
        path, v = [], t
        while parent[v] is not None:
            path.append((parent[v], v))
            v = parent[v]
        push = min(cap[e] for e in path)
        for u, v in path:
            cap[u, v] -= push
            cap[v, u] += push
        flow += push


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=9))
def test_minimum_cut(rows):
    scores, near, far = ([float(r[k]) for r in rows] for k in range(3))
    near[0] = far[0] = 0.0
    if len(far) > 1:
        far[1] = 0.0
    side = boilerplate.minimum_cut(scores, near, far)
    best = brute_cut(scores, near, far)
    assert cut_cost(scores, near, far, side) == pytest.approx(best)
    assert max_flow(scores, near, far) == pytest.approx(best)


ARTICLE = """Example Post
Home | News | Sport | Contact

The long road to the coast

It was raining when the first walkers came to the inn, and nobody wanted to go on. They had been on the road for two weeks.
ADVERTISEMENT
Because the bridge was closed, the walkers took the old path along the river that the farmers had used for centuries.

What they carried

- two small tents
- a map of the coast

Related articles
A walk in the hills
The inn at the bridge

Copyright 2021 Example Post
Back to top"""


def test_frame_of_a_page(spark):
    rows = [(1, "https://www.example-post.test:443/the-long-road-to-the-coast", None, ARTICLE, "x"), (2, None, None, None, "x"), (3, "u", "t", "", "x"), (4, "u", "t", " \n ", "x"), (5, "u", None, "only one line", "x"), (6, "u", None, LONG + "\n" + LONG, "x")]
    df = spark.createDataFrame(rows, "fetch_id int, url string, title string, page string, body string")
    got = {r["fetch_id"]: (r["body"], r["frame"]) for r in boilerplate.label_lines(df).collect()}
    lines = ARTICLE.split("\n")
    assert [lines[n - 1] for n in got[1][1]] == ["Example Post", "Home | News | Sport | Contact", "ADVERTISEMENT", "Related articles", "A walk in the hills", "The inn at the bridge", "Copyright 2021 Example Post", "Back to top"]
    assert 2 not in got and got[3] == ([], []) and got[4] == ([], []) and got[5] == ([1], []) and got[6] == ([1, 2], [])
    bodies = {r["fetch_id"]: r["body"] for r in boilerplate.main_body(df).collect()}
    assert bodies[1].startswith("The long road to the coast\nIt was raining") and "Related" not in bodies[1]
    assert boilerplate.label_lines(df.where("false")).count() == 0


def figures(pages):
    """Precision and recall of the cut on labelled pages, with the shares of their site and without."""
    judge, right, found, wanted = boilerplate.Labeller(boilerplate.line_model()), 0, 0, 0
    for page in pages:
        text, labels, shares, title, url = boilerplate.labelled_lines(page)
        for some in (shares, []):
            frame = judge.cut([(text, some, title, url)])[0][1]
            right += sum(a and b for a, b in zip(frame, labels, strict=True))
            found, wanted = found + sum(frame), wanted + sum(labels)
    return right / found, right / wanted


def test_lines_of_held_out_pages():
    assert not {p[0] for p in labelled_pages.FIT} & {p[0] for p in labelled_pages.HELD_OUT}
    assert min(figures(labelled_pages.HELD_OUT)) > 0.97
    assert min(figures(labelled_pages.FIT)) > 0.97


def test_pages_cut_together_and_alone():
    judge = boilerplate.Labeller(boilerplate.line_model())
    pages = [(*boilerplate.labelled_lines(p)[:1], boilerplate.labelled_lines(p)[2], *boilerplate.labelled_lines(p)[3:]) for p in labelled_pages.HELD_OUT] + [("", [], None, None), ("one", [], None, None)]
    assert judge.cut(pages) == [c for p in pages for c in judge.cut([p])]
    assert judge.cut([]) == [] and judge.cut(pages[-2:]) == [([], [], []), ([1], [False], [0.0])]


def test_a_long_line_outweighs_the_menu_around_it():
    menu = ["Home", "News", "Forum", "Login", "Help"]
    page = "\n".join([*menu, "cheap lamp shop cheap lamps " * 80, *menu[::-1]])
    numbers, frame, _ = boilerplate.Labeller(boilerplate.line_model()).cut([(page, [0.6] * 5 + [0.0] + [0.6] * 5, None, "https://lamps.test:443/1")])[0]
    assert [n for n, f in zip(numbers, frame, strict=True) if not f] == [6]


def test_lines_of_one_element_hold_together():
    judge = boilerplate.Labeller(boilerplate.line_model())

    def near(page):
        return boilerplate.edges(judge.surroundings([(page, [], None, None)])[0][0])[0][1:]

    plain, tagged, parted = near("a b\nc d"), near("<li>a b</li>\n<li>c d</li>"), near("a b\n<nav>c d")
    assert tagged[0] > plain[0] > parted[0]


# 4


@pytest.mark.parametrize(("block", "kinds"), markup.LABELLED)
def test_trees_know_their_table(block, kinds):
    assert markup.kinds_of(block) == set(kinds)


@pytest.mark.parametrize(
    ("page", "kinds"),
    [
        ("Prices rose from $3 to $9, he said; R&D cost $5.", set()),
        ("if x < 3 and y > 4 then\n* star\n# 5 items\n#tag", set()),
        ("a <i>word</i> here\nand **bold** there", {"html", "markdown"}),
        ("<!-- a\nb -->", {"html"}),
        ("== Head ==\n\\section{Other}", {"wiki", "latex"}),
        ("set a_b_c in C:\\begin\\x", set()),
        ("", set()),
    ],
)
def test_kinds(page, kinds):
    assert markup.kinds_of(page) == kinds


@pytest.mark.parametrize("page", markup.LABELLED_PAGES)
def test_trees_know_their_pages(page):
    lines = [line for line, _ in page]
    for i, (line, kinds) in enumerate(page):
        row = markup.features(line, *markup.neighbours(lines, i))
        assert {k for k in markup.KINDS if markup.trees()[k].says(row)} == set(kinds)


@pytest.mark.parametrize(
    ("page", "kinds"),
    [
        ("They wrote a letter to the paper about the noise.\n> Old Town\nIt was never printed, as far as we know.", {"markdown"}),
        ("Home\n> Old Town\n> Castle", set()),
        ("She said:\n> We never saw the castle, nor the old town.", {"markdown"}),
        ("They wrote a letter to the paper about the noise.\n> What the town said\nIt was never printed, as far as we know.", {"markdown"}),
        ("See all letters to the paper: https://paper.example/letters/all-letters-to-the-paper-of-this-year\n> What the town said\nSee all: https://paper.example/towns/all-towns-of-the-north", set()),
        ("{|\n! street !! houses\n|-", {"wiki"}),
        ("The shop in the old street was full of people.\n! Sale !! Half price\nWe left without buying any of it, of course.", set()),
    ],
)
def test_neighbours_decide(page, kinds):
    assert markup.kinds_of(page) == kinds


@pytest.mark.parametrize("sign", sorted(markup.SIGNS))
@settings(max_examples=60, deadline=None)
@given(st.data())
def test_every_sign_passes_the_quick_test(sign, data):
    block = data.draw(st.from_regex(markup.SIGNS[sign]))
    page = data.draw(st.sampled_from(["", "x\n", "x\n   "])) + block
    assert markup._ANY.search(block) and markup._ANY.search(page)


@pytest.mark.parametrize(("page", "kinds"), [("size | price\n--- | ---\n4 | 12", {"markdown"}), ("for $(n+1)^2$ steps", {"latex"}), ("the norm $|x|_2$ of it", {"latex"})])
def test_signs_that_the_quick_test_missed(page, kinds):
    assert markup.kinds_of(page) == kinds


def test_clean_text():
    kinds = set(markup.KINDS)
    assert markup.clean("<h2>Top</h2><ul><li>a &amp; b</li></ul><p>c<br>d</p>", {"html"}) == "# Top\n\n- a & b\n\nc\nd"
    assert markup.clean("## Top\n* a\n**b** [c](/d) ![e](f.png) [^1]\n```\nx  *y*\n```\n|---|\n| 1 | 2 |", {"markdown"}) == "# Top\n- a\nb c e \n```\nx  *y*\n```\n1 | 2".replace("e \n", "e\n")
    assert markup.clean("== Top ==\n'''a''' [[b|c]] [[d]]{{e}}\n{|\n|-\n! x !! y\n|}", {"wiki"}) == "# Top\na c d\nx | y"
    assert markup.clean("\\section{Top}\n\\item a\n\\textbf{b \\emph{c}}~\\ref{d} $x^2$\n% no", {"latex"}) == "# Top\n- a\nb c $x^2$"
    assert markup.clean("plain * text _ with $ signs", set()) == "plain * text _ with $ signs"
    assert markup.clean("", kinds) == ""


@pytest.mark.parametrize(
    ("page", "kind", "want"),
    [
        ("It grew\\footnote{See \\emph{above}.} fast.\n\\caption{The mill}", "latex", "It grew (See above.) fast.\nThe mill"),
        ("a\n\\begin{verbatim}\n% x  *y*\n\\end{verbatim}\nb", "latex", "a\n\n```\n% x  *y*\n```\n\nb"),
        ("\\begin{equation}\n a_1 = b\n\\end{equation}", "latex", "$$ a_1 = b $$"),
        ("so \\[ x^2 \\] and \\(y\\)", "latex", "so\n$$ x^2 $$\n and $y$"),
        ("[[File:Mill.jpg|thumb|The old mill]] stands", "wiki", "The old mill stands"),
        ("[[File:Mill.jpg|thumb]] stands", "wiki", " stands"),
        ("<syntaxhighlight lang=c>\nint x;\n</syntaxhighlight>\n<math>e^x</math>", "wiki", "```\nint x;\n```\n\n$e^x$"),
        ("Run it:\n\n    make all\n    make *test*\n\nand wait", "markdown", "Run it:\n\n```\nmake all\nmake *test*\n\n```\nand wait"),
        ("- a\n\n    still a", "markdown", "- a\n\n    still a"),
    ],
)
def test_code_formulas_notes_and_captions_stay(page, kind, want):
    assert markup.clean(page, {kind}) == want


@pytest.mark.parametrize("page", ["a\nb <!-- x\ny -->\nc", "<!-- x\n\ny --> z <!-- t\nu -->", "a\n<!-- one -->\nb", "a <!-- open\nb", "", "<!--\n-->"])
def test_comments_of_several_lines_are_one_block(page):
    blocks = markup.blocks_of(page)
    assert "\n".join(blocks) == page
    assert markup.kinds_of(page) == ({"html"} if "-->" in page else set())


@pytest.mark.parametrize("text", ["<!--" * 20_000, "<script " * 20_000, "\\begin{verbatim}" * 5_000, "<pre>" * 20_000, "<!doctype " * 20_000])
def test_openings_without_end_take_little_time(text):
    began = time.perf_counter()
    markup.clean(text, markup.kinds_of(text) | set(markup.KINDS))
    assert time.perf_counter() - began < 10


def test_strip_markup_rows(spark):
    df = spark.createDataFrame([(1, "a <b>b</b>", "x"), (2, None, "x"), (3, "", "x"), (1, "a <b>b</b>", "x"), (4, LONG, "x")], "fetch_id int, page string, kinds string")
    got = sorted((r["fetch_id"], r["kinds"], r["text"]) for r in markup.strip_markup(df).where("fetch_id <> 2").collect())
    assert got == [(1, ["html"], "a b"), (1, ["html"], "a b"), (3, [], ""), (4, [], LONG.rstrip())] or got[3][1] == []
    none = markup.strip_markup(df).where("fetch_id = 2").first()
    assert none["kinds"] == [] and none["text"] is None
    assert markup.strip_markup(df.where("false")).count() == 0


# 5


@pytest.mark.parametrize("n", [0, 1, 3, 1000])
def test_top_n(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "a", "b", None]), f"id{rng.randint(0, 150):03d}", rng.choice([1.0, 1.0, 2.5, -3.0, 0.0, -0.0, 1e300, 5e-324, rng.random()]), "x") for _ in range(400)]
    rows += [("c", None, 1.0, "x"), ("c", "y", None, "x"), ("c", "y", float("nan"), "x"), ("c", "z", float("inf"), "x")]
    rows += [("ties", f"{k % 3}" * (k % 5 + 1), 7.0, "x") for k in range(40)] + [("ties", "", 7.0, "x"), ("ties", "é" * 500, 7.0, "x")]
    df = spark.createDataFrame(rows, "g string, i string, s double, need string")
    best = {}
    for g, i, s, _ in rows:
        if i is not None and s is not None and math.isfinite(s):
            best[g, i] = max(best.get((g, i), s), s)
    want = set()
    for g in {g for g, _ in best}:
        mine = sorted(((i, s) for (h, i), s in best.items() if h == g), key=lambda x: (-x[1], x[0].encode()))
        want |= {(g, i, s) for i, s in mine[:n]}
    assert {tuple(r) for r in topn.top_n_per_group(df, "g", "s", "i", n).collect()} == want


def test_top_n_of_a_huge_tie(spark):
    df = spark.range(30_000).select(F.lit("g").alias("g"), F.concat(F.lit("https://example.test/a/long/common/prefix/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("i"), F.lit(1.0).alias("s"))
    got = sorted(r["i"][-6:] for r in topn.top_n_per_group(df, "g", "s", "i", 3, unique=True).collect())
    assert got == ["000000", "000001", "000002"]
    assert topn.top_n_per_group(df.where("false"), "g", "s", "i", 3).count() == 0


def test_postings(spark):
    value = "http://a,b/,1.0; http://c/ , 2e-1;bad;http://d/,NaN;http://e/,;http://f/,5;"
    rows = [(1, "w", value, T0), (1, "w", value, T0), (2, "w", "http://f/,9", T0), (3, "w", "http://f/,8", None), (4, None, value, T0), (5, "w", None, T0), (6, "w", "", T0)]
    df = spark.createDataFrame(rows, "put_id long, word string, value string, saved_at timestamp_ntz")
    assert {tuple(r) for r in topn.postings(df).collect()} == {("w", "http://a,b/", 1.0), ("w", "http://c/", 0.2), ("w", "http://f/", 9.0)}


# 6


def test_repeated_lines(spark):
    rows = []
    for k in range(12):
        page = f"Title {k}\nAll rights!\n  ALL  rights 2024\nok\n\n" + ("seldom line\n" if k < 4 else "") + f"own words of {'abcdefghijkl'[k]}{k}"
        rows.append((k, f"https://www.A.test:443/{k}", page, T0, "x"))
    rows += [(20, "https://a.test:80/20", None, T0, "x"), (21, "https://a.test:80/0", rows[0][2], T0, "x"), (22, None, "all rights", T0, "x"), (23, "https://b.test/1", "all rights", T0, "x"), (24, "https://b.test/2", "", T0, "x"), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows, "fetch_id int, url string, page string, fetched_at timestamp_ntz, lines string").withColumn("g", F.lit(1)).withColumn("host", host_of("url"))
    found = sitelines.with_repeated(df, "host", "url", "page")
    got = {(r["fetch_id"], n) for r in found.collect() for n in r["_numbers"]}
    # "title", "allrights" and "ok" (too short) stand everywhere, "seldom line" on four urls and the copy of one.
    assert got == {(k, n) for k in [*range(12), 21] for n in (1, 2, 3)} | {(k, 6) for k in (0, 1, 2, 3, 21)}
    assert found.columns == [*df.columns, "_numbers"]
    assert sitelines.with_repeated(df.where("false"), "host", "url", "page").count() == 0


def test_copies_are_one_document(spark):
    same_text = "every copy has this line\nand this one"
    rows = [(k, f"https://a.test/{k}", same_text if k < 8 else f"common line here\nother {'xyzuvw'[k % 6]} words", T0 + datetime.timedelta(days=k)) for k in range(16)]
    df = spark.createDataFrame(rows, "fetch_id int, url string, page string, fetched_at timestamp_ntz").withColumn("host", host_of("url")).withColumn("cluster", F.xxhash64("page"))
    by_url = sitelines.with_repeated(df, "host", "url", "page")
    by_text = sitelines.with_repeated(df, "host", "cluster", "page", date="fetched_at", least_dates=5)
    assert by_url.where("fetch_id = 0").first()["_numbers"] == [1, 2]
    assert by_text.where("fetch_id = 0").first()["_numbers"] == [] and by_text.where("fetch_id = 9").first()["_numbers"] == [1]


# 7

PROSE = "The old mayor walked to the harbour, because the boats had come back from the islands. Nobody had seen so many of them since the spring. "


def test_stuffed_pages(spark):
    rng = random.Random(7)
    nouns = ["lamp", "chair", "table", "sofa", "shelf", "desk"]
    towns = ["".join(rng.choices("bcdfghklmnprstvwz", k=1)[0] + rng.choice("aeiou") for _ in range(4)).title() for _ in range(400)]
    prose = [(k, "\n\n".join(" ".join(rng.choices(PROSE.split(), k=30)).capitalize() + "." for _ in range(6))) for k in range(30)]
    pages = [
        (100, "buy cheap lamps now " * 60),
        (101, "\n".join(f"cheap {rng.choice(nouns)} {rng.choice(nouns)} sale" for _ in range(60))),
        (102, "\n".join(f"https://shop.test/{rng.choice(nouns)}/{rng.choice(nouns)}" for _ in range(60))),
        (103, "\n".join(f"{rng.choice(towns)} – {rng.choice(towns)} {rng.randint(0, 9)}:{rng.randint(0, 9)}, {rng.randint(1000, 9999)} fans" for _ in range(40))),
        (104, PROSE * 3 + "buy cheap lamps " * 5),
        (105, None),
        (106, ""),
        (107, "short"),
    ]
    verse = "I heard the train go over the hill\nlong after the lamps were low\nand someone whistled beyond the mill\na tune that I used to know\nThe river carried it out of sight\nthe stars went after it too\nand all the long and empty night\nI thought of the fields and you"
    glossary = "\n".join(f"{w} – A kind of {rng.choice(nouns)}, as {towns[i + 60]} has it in the {towns[i + 90]}." for i, w in enumerate(towns[:25]))
    pages += [(108, verse), (109, glossary)]
    df = spark.createDataFrame([(k, f"https://h{k}.test/", None, t, "x", ["u"] * (k % 7)) for k, t in prose + pages], "fetch_id int, url string, title string, page string, prose string, urls array<string>")
    rows = stuffed.stuffed_pages(df).collect()
    assert {r["fetch_id"] for r in rows if r["stuffed"]} == {100, 101, 102}
    assert {r["fetch_id"]: r["links"] for r in rows}[104] == pytest.approx(100 * (104 % 7) / len(stuffed._WORD.findall(pages[4][1])))
    assert stuffed.stuffed_pages(df.where("false")).count() == 0


def test_stuffed_pages_within_a_frame(spark):
    rng = random.Random(17)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(500)]
    menu = ["Home", "News", "Forum", "Photos", "Login", "Help"]
    foot = ["Follow us: Chatter | Snapbox", "Copyright 2020 Lamp Media. All rights reserved.", "Terms of use | Privacy"]
    things = ["lamp", "chair", "sofa", "desk", "bed"]

    def framed(k, body):
        path = f"Home > Blog > How {words[k]} went home"
        return "\n".join(["Lamp News", *menu, "", path, body, "", "Most read", *(f"How the {words[k + j]} was found" for j in range(3)), "", *foot])

    prose = ["\n\n".join("The " + " ".join(rng.choices(words, k=14)) + ", because it was so." for _ in range(7)) for _ in range(30)]
    lists = [
        "Best Lamp Shop\n\n" + "best lamp shop lamp shop deals best lamp " * 45,
        "Best Lamp Shop\n\n" + ", ".join(f"{rng.choice(['red', 'blue', 'old'])} {rng.choice(things)} {rng.choice(['xl', 'set', 'new'])}" for _ in range(90)),
        "Best Lamp Shop\n\n" + "\n".join(f"lamp shop - https://lamp-{rng.choice(things)}.test/{rng.choice(things)}/{rng.randint(1, 9)}" for _ in range(50)),
    ]
    bodies = [*prose, *lists]
    df = spark.createDataFrame([(k, f"https://lampnews.test/blog/{k}", f"How {words[k]} went home", framed(k, b), None) for k, b in enumerate(bodies)], "fetch_id int, url string, title string, page string, urls array<string>")
    assert {r["fetch_id"] for r in stuffed.stuffed_pages(df).where("stuffed").collect()} == {30, 31, 32}


DUTCH = "De oude man liep met zijn hond door het bos, omdat de weg naar het dorp niet open was."
ITALIAN = "Il vecchio era seduto con la sua barca al porto, perché non aveva una casa in paese."
GERMAN = "Der alte Mann war nicht in dem Haus, weil die Kinder mit dem Hund auf dem Weg zu ihm waren."


@pytest.mark.parametrize("sentence", [DUTCH, ITALIAN, GERMAN, PROSE.strip(), "Старый мост был закрыт после наводнения.", "老人和他的狗一起穿过森林。", "“Nobody knew of it,” she said.”"])
def test_sentences_of_all_languages(sentence):
    keywords = "\n".join(["garage door Utrecht", "buy cheap lamps in Jizowick and near you", "best lamp shop of them all!!!", "front door, van door, garage door Utrecht"])
    lines = sentence if sentence != PROSE.strip() else sentence.replace(". ", ".\n")
    assert stuffed.split_prose(sentence + "\n" + keywords) == (lines, keywords)


def test_language_of_each_block():
    russian = "Старый мост был закрыт после наводнения, и никто не знал почему. "
    text = DUTCH.ljust(stuffed.BLOCK, " ") + (russian * 40)[: stuffed.BLOCK] + "lamp stoel tafel " * 20
    assert [stuffed.language([b], "nl") for b in stuffed.blocks(text)] == ["nl", "script cyrillic", "nl"]
    assert [stuffed.language([b]) for b in stuffed.blocks("lamp stoel tafel " * 20)] == ["latin"]
    assert [stuffed.language(stuffed.blocks(x)) for x in (PROSE, GERMAN, ITALIAN, "buy lamps in Rome, buy lamps in Oslo", "")] == ["en", "de", "it", "en", "latin"]


def test_medians_by_language(spark):
    # Italian sentences here say the same again and again, English ones don't: a list in Italian is held against its own.
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    english = [(k, "\n\n".join("It was the " + " and the ".join(rng.choices(words, k=12)) + "." for _ in range(60))) for k in range(30)]
    italian = [(100 + k, "\n\n".join("Il " + " e la ".join(rng.choices(words[:6], k=12)) + "." for _ in range(60))) for k in range(8)]
    listed = "\n".join("per " + " ".join(rng.choices(words[:60], k=8)) for _ in range(90))
    pages = [*english, *italian, (200, "\n".join([listed, "e la per una"])), (201, "\n".join([listed.replace("per ", "for "), "and the for a"]))]
    df = spark.createDataFrame([(k, f"https://h{k}.test/", None, t, None) for k, t in pages], "fetch_id int, url string, title string, page string, urls array<string>")
    ratio = {r["fetch_id"]: r["ratio"] for r in stuffed.stuffed_pages(df).where("fetch_id >= 200").collect()}
    assert ratio[200] > 1.2 * ratio[201]


# 8


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.definition())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85\xa0'sab1.é😀<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_tokens_as_the_library_has_them(encoder, text):
    flat, starts = encoder.encode([text, None, "", text])
    want = encoder.tokenizer.encode(text, add_special_tokens=False)
    ids = flat[starts[0] : starts[1]].tolist()
    assert ids == want.ids and flat[starts[3] :].tolist() == want.ids and starts[1] == starts[2] == starts[3]
    assert encoder.decode(ids) == text
    assert encoder.offsets(text, ids) == [tuple(o) for o in want.offsets] if ids else True
    assert encoder.count([text, None]).tolist() == [len(want.ids), 0]


def test_special_strings_and_split_characters(encoder):
    assert 50256 not in encoder.encode(["<|endoftext|>"])[0]
    ids = encoder.encode(["😀 𓀀"])[0].tolist()
    assert "�" in encoder.decode(ids[:1]) or len(ids) == 1


def test_token_columns(spark, encoder):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "x"), (4, LONG, "x")], "doc_id int, text string, ids string")
    rows = tokens.encode(df, "text", ["doc_id"]).collect()
    want = {1: encoder.tokenizer.encode("a b").ids, 2: [], 3: [], 4: encoder.tokenizer.encode(LONG).ids}
    assert len(rows) == 5 and all(r["ids"] == want[r["doc_id"]] for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, "text", ["doc_id"]).collect()} == {k: len(v) for k, v in want.items()}
    spans = tokens.encode_with_offsets(df.where("doc_id = 1").limit(1), "text", ["doc_id"]).first()
    assert (spans["starts"], spans["ends"]) == ([0, 1], [1, 3])
    assert tokens.encode(df.where("false"), "text", ["doc_id"]).count() == 0


def test_memory_that_overflows(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    texts = [" ".join(f"w{k}{j}" for j in range(4)) for k in range(30)]
    for k in range(0, 30, 7):
        flat, starts = encoder.encode(texts[k : k + 7])
        for j, t in enumerate(texts[k : k + 7]):
            assert flat[starts[j] : starts[j + 1]].tolist() == encoder.tokenizer.encode(t).ids


# 9


def test_mix(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(["big", " BIG ", "small", None, "other"]), rng.choice([0, 1, 5, 30]), "x") for k in range(300)] + [(1000, "small", None, "x")]
    df = spark.createDataFrame(rows, "doc_id int, source string, n_tokens long, uses string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix_sources(df, targets)
    total = sum(r[2] or 0 for r in rows)
    used = uses.collect()
    assert len(used) == sum(bool(r[1]) and r[1].strip().lower() in ("big", "small") for r in rows)
    for r in report.collect():
        mine = [u for u in used if u["source"] == r["source"]]
        reached, supply = sum(u["n_tokens"] * u["uses"] for u in mine), sum(u["n_tokens"] for u in mine)
        assert r["reached"] == reached <= r["budget"] == pytest.approx(r["target_share"] * total)
        assert all(0 <= u["uses"] <= r["max_repeats"] for u in mine)
        assert r["short"] == (supply * r["max_repeats"] < r["budget"])
        assert max([u["uses"] for u in mine], default=0) - min([u["uses"] for u in mine], default=0) <= 1
        if not r["short"]:
            assert r["budget"] - reached < 30
    again = mixing.mix_sources(df, targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, used))
    empty, nothing = mixing.mix_sources(df.where("false"), targets)
    assert empty.count() == 0 and nothing.count() == 3


def test_a_long_document_leaves_the_rest_to_others(spark):
    # One document holds most of the source; wherever it stands in the order, the others still fill the budget.
    rows = [(k, "a", 900 if k == 0 else 10) for k in range(60)] + [(100, "b", 1000)]
    targets = spark.createDataFrame([("a", 0.2, 1)], "source string, target_share double, max_repeats int")
    for seed in range(4):
        uses, report = mixing.mix_sources(spark.createDataFrame(rows, "doc_id int, source string, n_tokens long"), targets, seed=seed)
        r = report.first()
        assert r["budget"] - r["reached"] < 10 and not r["short"]
        assert max(u["uses"] for u in uses.collect()) == 1


# 10


def test_ordinal_regression_held_out():
    rng = np.random.default_rng(10)
    y = rng.integers(1, 5, 400)
    x = np.column_stack([y + rng.normal(0, 0.25, 400), -y + rng.normal(0, 0.4, 400), rng.normal(0, 1, 400)])
    model = reading.OrdinalRegression(x[:200], y[:200])
    assert (model.grade(model.score(x[200:])) == y[200:]).mean() > 0.9
    assert np.all(np.diff(model.cuts) > 0)


def test_held_out_grades(spark):
    folder = DATA.replace("0.001", "0.1")
    docs, graded = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/graded_docs.parquet")
    half = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    some = docs.join(graded, "doc_id").drop("grade")
    levels = {r["doc_id"]: r["level"] for r in reading.reading_levels(some, half).collect()}
    held = [(r["grade"], levels[r["doc_id"]]) for r in graded.join(half, "doc_id", "left_anti").collect()]
    assert sum(a == b for a, b in held) / len(held) > 0.85
    assert sum((a == 4) == (b == 4) for a, b in held) / len(held) > 0.98


def test_reading_rows(spark):
    easy = "I see a dog. The dog is big. We run to the dog. It is a good dog. " * 4
    hard = "Whereas theoretical considerations presuppose institutional heterogeneity, the prevailing interpretation necessitates methodological qualification of the phenomenon. " * 4
    rows = [(1, easy, "x"), (2, hard, "x"), (3, None, "x"), (4, "", "x"), (5, "too short", "x"), (6, "Der Hund und die Katze sind nicht in dem Haus, weil sie auf der Straße sind. " * 5, "x"), (7, LONG, "x"), (1, easy, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, level string")
    graded = spark.createDataFrame([(1, 1), (2, 4), (3, 2), (None, 1), (99, 3)], "doc_id int, grade int")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(df, graded).collect()}
    assert got[1] == 1 and got[2] == 4 and all(got[k] is None for k in (3, 4, 5, 6))
    assert all(r["level"] is None for r in reading.reading_levels(df, graded.where("grade = 1")).collect())
    assert reading.reading_levels(df.where("false"), graded).count() == 0


def test_words_beyond_the_commonest_have_their_own_rarity(spark, monkeypatch):
    def name(k):
        return "".join("abcdefghij"[int(c)] for c in f"{k:05d}")

    def page(words):
        return " ".join(f"the {w} of" for w in words) + "."

    # The filler's 21,000 words fill the broadcast table; the other two texts differ in how often their rarer words occur.
    filler = " ".join(name(k) for k in range(21_000)) + " "
    once, twice = [f"q{name(k)}" for k in range(40)], [f"z{name(k)}" for k in range(40)]
    rows = [(1, filler * 3), (2, page(once)), (3, page(twice)), (4, " ".join(twice)), (3, page(twice))]
    easy, hard = page(["dog"] * 40), page(name(k) for k in range(40))
    rows += [(5, easy), (6, hard)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    graded = spark.createDataFrame([(5, 1), (6, 4)], "doc_id int, grade int")
    many = sorted((r["doc_id"], r["score"]) for r in reading.reading_levels(df, graded).collect() if r["score"] is not None)
    scores = dict(many)
    assert len(many) == 5 and scores[2] > scores[3] + 1e-3
    counts = Counter(w for _, t in rows for w in reading.words_of(t))
    for size in (5, 20_000, 100_000):
        monkeypatch.setattr(reading, "VOCABULARY", size)
        for r in reading.measured(df, "doc_id", "text").where("x is not null").collect():
            words = reading.words_of(dict(rows)[r["_id"]])
            want = sum(-math.log2(counts[w] / sum(counts.values())) for w in words) / len(words) / 2
            assert r["x"][reading.FEATURES.index("rarity")] == pytest.approx(want)
