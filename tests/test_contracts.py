"""Contracts with hand-worked values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnweave.functions import hashing, similarity, text, urls
from tarnweave.operators.flow import Dropped, Flow, Job, PairFlow
from tarnweave.plans import crawl, index, rank, search
from tarnweave.sources import packed, rowformat
from tarnweave.sources.tables import TableExists, TableMissing, TableStore


def pairs(spark, *rows):
    return PairFlow(spark.createDataFrame(list(rows), "key string, value string"))


def test_hash_values():
    assert hashing.hash_text("abc") == "mmwkkecetegayicidokelcjiqicgloeizkzohqam"
    assert hashing.hash_text("http://a/") == "pougnkjcqecommhkqotersuajsmazguiicdaxcnk"


def test_hash_column(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,), ("é😀",)], "s string")
    for r in df.select("s", hashing.hash_key("s").alias("h")).collect():
        assert r["h"] == (None if r["s"] is None else hashing.hash_text(r["s"]))


@given(st.text(st.characters(min_codepoint=0x10, max_codepoint=0xFF)))
def test_encoded_keys_come_back(key):
    assert hashing.decode_key(hashing.encode_key(key)) == key


@pytest.mark.parametrize(
    ("a", "b", "value"),
    [("chlorla", "chloral", 0.9761904761904763), ("chlorla", "induces", 0.0), ("martha", "marhta", 0.9611111111111111), ("ab", "ab", 1.0), ("a", "a", 0.0), ("", "x", 0.0)],
)
def test_jaro_winkler(a, b, value):
    assert similarity.jaro_winkler(a, b) == pytest.approx(value)


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("blah.html#test", "https://foo.com:8000/bar/blah.html"),
        ("../blubb/123.html", "https://foo.com:8000/blubb/123.html"),
        ("/one/two.html", "https://foo.com:8000/one/two.html"),
        ("http://elsewhere.com/some.html", "http://elsewhere.com:80/some.html"),
        ("#abc", "https://foo.com:8000/bar/xyz.html"),
        ("pic.JPG", None),
        ("mailto:x@y.z", None),
        ("http://[broken", None),
        (None, None),
    ],
)
def test_normalised_urls(href, want):
    assert urls.normalize_url(href, "https://foo.com:8000/bar/xyz.html") == want


def test_built_in_normalisation_agrees(spark):
    samples = ["HTTP://A.com", "https://a.com/x?y=1#z", "ftp://a/", "https://a.com:81/p.png", "nothing", "http://a.com/b c", "http://u:p@a.com/"]
    df = spark.createDataFrame([(s,) for s in samples], "u string")
    for r in df.select("u", urls.normalized_absolute("u").alias("n")).collect():
        assert r["n"] == urls.normalize_url(r["u"]), r["u"]


def test_url_parts(spark):
    df = spark.createDataFrame([("http://a.b:80/c?d",), ("https://a.b",), ("/only/path",), ("",)], "u string")
    got = [tuple(r[0]) for r in df.select(urls.url_parts("u")).collect()]
    assert got == [("http", "a.b", "80", "/c?d"), ("https", "a.b", None, "/"), (None, None, None, "/only/path"), (None, None, None, "/")]


def test_robots():
    body = "User-agent: *\nDisallow: /private\nAllow: /\nCrawl-delay: x\nCrawl-delay: 2\n\nUser-agent: special\nDisallow: /\n"
    assert urls.robots_decision(body, "/private/x", "bot", 0, None) == urls.DENIED
    assert urls.robots_decision(body, "/open", "bot", 5000, 4000) == urls.WAIT
    assert urls.robots_decision(body, "/open", "bot", 9000, 4000) == urls.ALLOWED
    assert urls.robots_decision(body, "/open", "my-special-bot", 0, None) == urls.DENIED
    assert urls.robots_decision("Disallow: /x", "/x", "bot", 0, None) == urls.DENIED
    assert urls.robots_decision(None, None, "bot", 0, None) == urls.ALLOWED


def test_longest_match():
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /c\nAllow: /c\n"
    assert urls.longest_match(body, "/a/b/c", "bot") == (True, 1.0)
    assert urls.longest_match(body, "/a/x", "bot") == (False, 1.0)
    assert urls.longest_match(body, "/c", "bot") == (True, 1.0)
    assert urls.longest_match("", "/", "bot") == (True, 1.0)


def test_command_line(spark, tmp_path, capsys):
    from tarnweave.__main__ import main

    root = f"file://{tmp_path}/cli"
    main(["--root", root, "put", "t", "k", "a", "1"], spark)
    main(["--root", root, "get", "t", "k", "a"], spark)
    main(["--root", root, "rename", "t", "u"], spark)
    main(["--root", root, "scan", "u"], spark)
    main(["--root", root, "delete", "u"], spark)
    main(["--root", root, "tables"], spark)
    assert capsys.readouterr().out.split("\n")[:2] == ["1", 'k {"a": "1"}']


def test_blacklist(spark):
    df = spark.createDataFrame([("http://a.com/x",), ("http://b.com/x",)], "u string")
    assert [r[0] for r in df.where(urls.is_blacklisted("u", ["*a.com*"])).collect()] == ["http://a.com/x"]
    assert df.where(urls.is_blacklisted("u", [])).count() == 0


def test_text(spark):
    html = '<html><title>My\npage</title><script type="x">var a</script><style>p {margin:0}</style><body>The contents &amp; domain <a href="/x">X</a><a data-x="1" href=\'y\'>Y</a><a href=z>Z</a></body>'
    df = spark.createDataFrame([(html,)], "h string")
    row = df.select(text.page_text("h", ()).alias("t"), text.page_title("h").alias("title"), text.page_links("h").alias("links"), text.page_text("h", strict=False).alias("loose")).first()
    assert row["t"] == "my page p margin 0 the s amp do x y z"
    assert "margin" not in row["loose"]
    assert row["title"] == "My\npage"
    assert row["links"] == ["/x", "z"]


def test_description(spark):
    cases = [('<meta name="description" content="Short.">x', "Short."), ("abc", "abc"), ("x wikipedia and more", "x wikipedia"), ("", "")]
    df = spark.createDataFrame([(h,) for h, _ in cases], "h string")
    assert [r[0] for r in df.select(text.page_description("h")).collect()] == [d for _, d in cases]


def test_flow_operators(spark):
    flow = Flow.parallelize(spark, ["b", "a", "a"])
    assert flow.count() == 3
    assert sorted(flow.distinct().collect()) == ["a", "b"]
    assert flow.intersection(Flow.parallelize(spark, ["a", "c"])).collect() == ["a"]
    assert len(flow.take(2)) == 2
    assert sorted(flow.flat_map_py(lambda v: [v, v + "!"] if v == "b" else None).collect()) == ["b", "b!"]
    assert sorted(flow.map_partitions(lambda it: (v * 2 for v in it)).collect()) == ["aa", "aa", "bb"]
    assert flow.map(F.upper).filter(lambda v: v == "A").count() == 2
    assert flow.sample(1.0).count() == 3 and flow.sample_by_hash(1.0).count() == 3
    assert len(flow.fold("", lambda a, b: a + b)) == 3
    assert Flow.parallelize(spark, []).fold("0", lambda a, b: a + b) == "0"
    assert sorted(Flow.parallelize(spark, ["ax", "ay", "bz"]).group_by(lambda v: F.left(v, F.lit(1))).collect()) == [("a", "ax,ay"), ("b", "bz")]
    flow.destroy()
    with pytest.raises(Dropped):
        flow.count()


def test_pair_operators(spark):
    joined = pairs(spark, ("k", "1"), ("k", "2")).join(pairs(spark, ("k", "a"), ("k", "b"), ("z", "q")))
    assert sorted(joined.collect()) == [("k", "1,a"), ("k", "1,b"), ("k", "2,a"), ("k", "2,b")]
    left = pairs(spark, ("fruit", "banana"), ("fruit", "apple"))
    right = pairs(spark, ("fruit", "cherry"), ("fruit", "fig"), ("fruit", "date"), ("z", "q"))
    assert sorted(left.cogroup(right).collect()) == [("fruit", "[apple,banana],[cherry,date,fig]"), ("z", "[],[q]")]
    assert left.fold_by_key_py("", lambda a, v: a + v).collect() == [("fruit", "applebanana")]
    assert left.fold_by_key(F.max).collect() == [("fruit", "banana")]
    assert sorted(left.map(lambda k, v: F.concat(k, v)).collect()) == ["fruitapple", "fruitbanana"]


def test_job(spark):
    assert Job(spark).run(lambda job, args: [job.output(a) for a in args], ["x", "y"]) == "xy"
    assert Job(spark).run(lambda job, args: None) == "The job did not invoke output()"


@given(st.dictionaries(st.from_regex(r"[a-z0-9:.-]{1,8}", fullmatch=True), st.binary(max_size=20), max_size=4))
def test_row_format_round_trip(columns):
    data = rowformat.encode_row("key-1", columns) + b"\n" + rowformat.encode_row("k2", {"a": b"x y\nz"})
    assert list(rowformat.decode_rows(data)) == [("key-1", columns), ("k2", {"a": b"x y\nz"})]


def test_row_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one").write_bytes(rowformat.encode_row("k", {"c": b"v"}))
    got = rowformat.read_rows(spark, str(tmp_path / "t")).collect()
    assert [(r["key"], {k: bytes(v) for k, v in r["columns"].items()}) for r in got] == [("k", {"c": b"v"})]


def test_table_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    store.put("t", "k1", "a", "1")
    store.put("t", "k1", "b", "2")
    store.put("t", "k1", "a", "3")
    assert store.get_row("t", "k1") == {"a": "3", "b": "2"}
    store.put_rows("t", spark.createDataFrame([("k1", "9", None), ("k2", None, None)], "key string, a string, c string"))
    assert store.get_row("t", "k1") == {"a": "9"} and store.get_row("t", "k2") == {} and store.get_row("t", "no") is None
    assert store.get("t", "k1", "a") == "9" and store.get("t", "k1", "z") is None
    assert store.count("t") == 2 and store.exists_row("t", "k2") and not store.exists_row("t", "k3")
    store.compact("t")
    assert store.get_row("t", "k1") == {"a": "9"}
    store.put("t", "k0", "a", "x")
    page, following = store.view("t", size=2)
    assert [r["key"] for r in page] == ["k0", "k1"] and following == "k2"
    assert [r["key"] for r in store.scan("t", "k1", "k2").collect()] == ["k1"]
    store.put("u", "k", "a", "1")
    with pytest.raises(TableExists):
        store.rename("t", "u")
    with pytest.raises(TableMissing):
        store.rename("nothing", "v")
    store.rename("t", "v")
    assert store.tables() == ["u", "v"] and dict(store.counts())["v"] == 3
    store.delete("v")
    assert store.tables() == ["u"]


def test_packed(spark):
    df = spark.createDataFrame([("w", "http://a,b/,1.5;http://c/,NaN;x;http://d/, 2e0;"), ("w", None), ("w", "")], "word string, value string")
    assert sorted((r["url"], r["score"]) for r in packed.unpack(df).collect()) == [("http://a,b/", 1.5), ("http://d/", 2.0)]


def pages(spark):
    return spark.createDataFrame([("u1", "u1", "red fox red", None), ("u2", "u2", "blue fox", None), ("u3", "u3", "green", None)], "key string, url string, page string, urls array<string>")


def test_tf_idf_and_combined(spark):
    weights = index.tf_idf(pages(spark))
    got = {(r["word"], r["key"]): round(r["weight"], 6) for r in weights.collect()}
    assert got == {("red", "u1"): 0.741276, ("fox", "u1"): 0.249844, ("blue", "u2"): 0.741276, ("fox", "u2"): 0.340368, ("green", "u3"): 0.741276}
    ranks = spark.createDataFrame([("u1", 1.0), ("u2", 0.15), ("u3", 0.575)], "key string, rank double")
    scores = index.combined_scores(pages(spark), weights, ranks)
    assert {(r["word"], r["url"]): round(r["score"], 6) for r in scores.collect()}[("red", "u1")] == 0.716404
    found = [(r["url"], round(r["score"], 6)) for r in search.search(scores, "red fox").collect()]
    assert found == [("u1", 1.083701), ("u2", 0.198157)]
    assert search.search(scores, "unknown").count() == 0 and search.search(scores, "red", 9).count() == 0
    assert not search.has_next(scores, "red fox", 1)
    hits, asked = search.search_or_suggest(scores, "gren")
    assert asked == "green" and hits.count() == 1


def test_packed_index_parts(spark):
    one = index.packed_index(index.postings(pages(spark)), part=1)
    assert {r["word"]: 0 for r in one.collect()}.keys() == {"red", "fox", "blue", "green"}
    keys = sorted(k for r in one.where("word = 'fox'").collect() for k in r["value"].split(","))
    assert keys == ["u1", "u2"]


def test_pagerank(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([tuple(e) for e in ("ab", "ac", "bc", "ca", "dc", "dx")], "src string, dst string")
    first = {r["id"]: r["rank"] for r in rank.pagerank(nodes, edges, rounds=1).collect()}
    assert first == pytest.approx({"a": 1.0, "b": 0.575, "c": 1.85, "d": 0.15, "e": 0.15})
    last = {r["id"]: r["rank"] for r in rank.pagerank(nodes, edges, threshold=0.01).collect()}
    assert last == pytest.approx({"a": 1.327464454985379, "b": 0.7122832450318213, "c": 1.3852522999827988, "d": 0.15, "e": 0.15})


def test_crawl_loop(spark):
    site = {
        "http://a.com:80/": '<title>A</title><a href="/b">b</a> <a href="/pic.png">p</a>',
        "http://a.com:80/b": '<a href="/">back</a> <a href="/c">c</a>',
        "http://a.com:80/c": '<a href="/d">d</a>',
        "http://a.com:80/d": "too deep",
    }
    table = spark.createDataFrame(list(site.items()), "url string, html string")
    seeds = spark.createDataFrame([("http://a.com",)], "url string")
    got = {r["url"]: r["title"] for r in crawl.crawl(seeds, lambda asked: table.join(asked, "url")).collect()}
    assert got == {"http://a.com:80/": "A", "http://a.com:80/b": "", "http://a.com:80/c": ""}


def test_suggest_and_complete(spark):
    words = spark.createDataFrame([("apple",), ("apply",), ("Banana",), (None,)], "word string")
    assert similarity.suggest(words, ["appel"]).first()["suggestion"] in {"apple", "apply"}
    assert [r[0] for r in similarity.complete(words, "b").collect()] == ["Banana"]


def test_stream_ingest(spark, tmp_path):
    from tarnweave.streaming.ingest import ingest, stream_rows

    folder = f"{tmp_path}/in"
    rows = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("j", "x", 1)], "key string, v string, at int")
    rows.write.parquet(folder)
    stream = stream_rows(spark, folder, rows.schema)
    run = ingest(stream, f"file://{tmp_path}/store", "t", f"{tmp_path}/state", order=("at",))
    run.awaitTermination()
    assert TableStore(spark, f"file://{tmp_path}/store").get("t", "k", "v") == "new"


@settings(max_examples=20)
@given(st.lists(st.sampled_from("abc"), max_size=6))
def test_hash_is_a_function(values):
    assert len({hashing.hash_text(v) for v in values}) == len(set(values))


def test_robots_blocks():
    text = "Disallow: /all\nUser-agent: tarn\nUser-agent: other\nDisallow: /other # not here\nCrawl-delay: x\nCrawl-delay: 2\nCrawl-delay: 9"
    assert urls.parse_robots(text)["tarn"].rules == [] and urls.parse_robots(text)["other"].rules == [(False, "/other # not here")]
    assert urls.parse_robots(text)["other"].delay == 2.0 and urls.parse_robots(text)["*"].rules == [(False, "/all")]
    assert urls.parse_robots(text, strict=False)["tarn"].rules == [(False, "/other")]
    assert urls.robots_decision(text, "/all/x", "tarnweave", 0, None) == urls.ALLOWED
    assert urls.robots_decision(text, "/all/x", "nobody", 0, None) == urls.DENIED
    assert [urls.robots_decision("", "/", "x", now, 5) for now in (4, 5)] == [urls.WAIT, urls.ALLOWED]


def test_users_of_urls_are_kept():
    assert urls.normalize_url("HTTPS://me:pw@Shop.test/a?b#c") == "https://me:pw@Shop.test:443/a?b"
    assert urls.normalize_url("//x@y.test", "http://a.test/") == "http://x@y.test:80/"
    assert urls.normalize_url(" /x", "http://a.test/") is None


def test_links_with_attributes_of_all_kinds(spark):
    page = "<a download href='/a'><a href=/b rel=x>< a\n href = \"/c\" HREF=/d><a data-x=1 href=/no><a href><a href=''><abbr href=/no>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "page string")
    assert [r[0] for r in df.select(text.page_links("page")).collect()] == [["/a", "/b", "/c", "/d"], None, []]


def test_outcomes(spark):
    base = "https://a.test:443/"
    front = [("deep", 3), ("ä", 0), ("seen", 0), ("bad", 1), ("no/x", 1), ("silent", 0), ("empty", 0), ("french", 0), ("moved", 0), ("pdf", 0), ("page", None), ("page", 2), ("gone", 0)]
    frontier = spark.createDataFrame([(base + u, d) for u, d in front] + [("nothing", 0), (None, 0), ("https://slow.test:443/", 0)], "url string, depth int")
    said = [("empty", 200, "text/html", 0, None, None), ("french", 200, "text/html", 9, "fr", None), ("moved", 301, "text/html", 9, None, "/new"), ("pdf", 200, "application/pdf", 9, "en", None), ("page", 200, "text/html; charset=x", 9, "de, en", None), ("gone", 404, "text/html", 9, None, None)]
    answers = spark.createDataFrame([(base + u, *r) for u, *r in said], "url string, responsecode int, contenttype string, length bigint, language string, location string")
    hosts = spark.createDataFrame([(hashing.hash_text("a.test"), "Disallow: /no", None), (hashing.hash_text("slow.test"), "Crawl-delay: 5", 1000)], "key string, robots string, lastaccessedms bigint")
    known = spark.createDataFrame([(base + "seen",)], "url string")
    got = {r["url"].removeprefix(base): (r["outcome"], r["location"]) for r in crawl.outcomes(frontier, known, hosts, answers, 5999, "tarnweave", ("*/bad",)).collect()}
    assert got.pop("moved") == ("redirect", base + "new") and all(v[1] is None for v in got.values())
    assert {k: v[0] for k, v in got.items()} == {"deep": "too deep", "ä": "not ascii", "seen": "known", "bad": "blacklisted", "no/x": "denied", "silent": "no answer", "empty": "no length", "french": "other language", "pdf": "no page", "page": "fetched", "gone": "no page", "nothing": "no host", "https://slow.test:443/": "wait"}
    assert crawl.outcomes(frontier.where("false"), known, hosts, answers, 0, "x").count() == 0


def test_writes_during_a_fold_stay(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    store.put("t", "k", "a", "1")
    log = store._cells

    def late(df):
        store._cells = log
        store.put("t", "k", "a", "2")
        return log(df)

    store._cells = late
    store.compact("t")
    assert store.get("t", "k", "a") == "2" and len(store._live("t")) == 2
    store.compact("t")
    assert store.get("t", "k", "a") == "2" and len(store._live("t")) == 1
    TableStore(spark, f"file://{tmp_path}/store").put("t", "k", "a", "3")
    assert store.get("t", "k", "a") == "3"


def test_answers_tell_their_time(spark):
    scores = spark.createDataFrame([("fox", f"u{k}", float(k)) for k in range(12)], "word string, url string, score double")
    shown = spark.createDataFrame([("u11", "Eleven", "[x]about foxes")], "url string, title string, description string")
    got = search.answer(scores, shown, "fux")
    assert got.query == "fox" and got.more and got.milliseconds > 0 and len(got.rows) == 10
    assert tuple(got.rows[0]) == ("u11", 11.0, "Eleven", "about foxes") and got.rows[1]["title"] == "u10"
    assert not search.answer(scores, shown, "fox", 2).more


def test_scratch_is_deleted(spark):
    from tarnweave.session import bucketed, materialise, release_all

    release_all(spark)
    df = spark.range(5)
    kept = [materialise(df, "one"), bucketed(df, "id", "two")]
    paths = [k._tarnweave_path for k in kept]
    assert [k.count() for k in kept] == [5, 5]
    fs = spark._jvm.org.apache.hadoop.fs.Path(paths[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    assert release_all(spark) == 2 and not any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in paths)


def test_ranks_need_an_end(spark):
    nodes = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([], "src string, dst string")
    with pytest.raises(ValueError):
        rank.pagerank(nodes, edges, threshold=0.0)
    assert rank.pagerank(nodes, edges).first()["rank"] == pytest.approx(0.15)
