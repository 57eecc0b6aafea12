"""Every query of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions import text as T
from tarnweave.functions import urls as U
from tarnweave.functions.hashing import encode_key_column, hash_key
from tarnweave.functions.similarity import complete, jaro_winkler_column, suggest
from tarnweave.operators.flow import Dropped, Flow, Job, PairFlow
from tarnweave.plans import crawl as C
from tarnweave.plans import index as I
from tarnweave.plans import rank as R
from tarnweave.plans import search as S
from tarnweave.session import scratch_root, spread
from tarnweave.sources.packed import latest_scores, unpack
from tarnweave.sources.tables import TableStore, latest_rows, page_of, read_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _pairs(df: DataFrame, key: str, value: str) -> PairFlow:
    return PairFlow(df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")))


# Tables


@query("SELECT o_orderkey || ':' || o_orderpriority AS value FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority IS NOT NULL")
def from_table(spark, folder):
    """IO-1: a string a row; rows that give null are left out."""
    orders = read(spark, folder, "orders").where("o_orderstatus <> 'O'")
    return Flow.from_table(orders, lambda c: F.concat(c("o_orderkey").cast("string"), F.lit(":"), c("o_orderpriority"))).df


@query("SELECT * FROM (VALUES ('a'), ('a'), ('b')) AS t(value)")
def parallelize(spark, folder):
    """IO-2."""
    return Flow.parallelize(spark, ["a", "a", "b"]).df


def _store(spark: SparkSession) -> TableStore:
    """An empty store in the shared folder."""
    return TableStore(spark, f"{scratch_root(spark).rstrip('/')}/tarnweave/store-{uuid.uuid4().hex}")


def _customers(spark: SparkSession, folder: str) -> TableStore:
    store = _store(spark)
    store.put_rows("customer", read(spark, folder, "customer").select(F.col("c_name").alias("key"), "c_custkey", "c_mktsegment", "c_nationkey"))
    return store


_CUSTOMER_42 = "Customer#000000042"


@query("SELECT c_name, c_custkey::VARCHAR AS c_custkey FROM customer WHERE c_name >= 'Customer#000000050' AND c_name < 'Customer#000000150'")
def scan_range(spark, folder):
    """IO-3, IO-9: rows of a store in a half-open range of keys."""
    rows = _customers(spark, folder).scan("customer", "Customer#000000050", "Customer#000000150")
    return rows.select(F.col("key").alias("c_name"), F.col("columns")["c_custkey"].alias("c_custkey"))


@query(f"SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer WHERE c_name = '{_CUSTOMER_42}'")
def get_row(spark, folder):
    """IO-4."""
    row = _customers(spark, folder).get_row("customer", _CUSTOMER_42) or {}
    return spark.createDataFrame([tuple(row.get(c) for c in ("c_custkey", "c_mktsegment", "c_nationkey"))], "c_custkey string, c_mktsegment string, c_nationkey string")


@query(f"SELECT c_mktsegment FROM customer WHERE c_name = '{_CUSTOMER_42}'")
def get_cell(spark, folder):
    """IO-5."""
    return spark.createDataFrame([(_customers(spark, folder).get("customer", _CUSTOMER_42, "c_mktsegment"),)], "c_mktsegment string")


@query(f"SELECT k AS key, k IN (SELECT c_name FROM customer) AS found FROM (VALUES ('{_CUSTOMER_42}'), ('nobody')) AS t(k)")
def exists_row(spark, folder):
    """IO-6."""
    store = _customers(spark, folder)
    return spark.createDataFrame([(k, store.exists_row("customer", k)) for k in (_CUSTOMER_42, "nobody")], "key string, found boolean")


@query("SELECT user_id::VARCHAR AS key, event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY ALL")
def put_merge(spark, folder):
    """IO-7, IO-10: cells are merged in two writes and folded; the last put of each (row, column) holds."""
    events = read(spark, folder, "events").where("event_type is not null and value is not null")
    last = latest_rows(events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("name"), "ts", "event_id", "value"), ["key", "name"], ["ts", "event_id"])
    first = latest_rows(events.where("event_type = 'click'").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("name"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("late"), "event_id", "value"), ["key", "name"], ["late", "event_id"])
    store = _store(spark)
    store.put_many("events", first.select("key", "name", F.col("value").cast("string").alias("value")))
    store.put_many("events", last.select("key", "name", F.col("value").cast("string").alias("value")))
    store.compact("events")
    return store.cells("events").select("key", "name", F.col("value").cast("double").alias("value"))


@query("SELECT 'people' AS name, count(*)::BIGINT AS rows FROM customer UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def store_tables(spark, folder):
    """IO-11 to IO-15: counts of a store's tables after one was renamed and one deleted."""
    store = _customers(spark, folder)
    for name in ("suppliers", "gone"):
        store.put_rows(name, read(spark, folder, "supplier").select(F.col("s_name").alias("key"), "s_suppkey"))
    store.rename("customer", "people")
    store.delete("gone")
    return spark.createDataFrame(store.counts(), "name string, rows bigint")


@query("SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def put_row(spark, folder):
    """IO-8: whole rows are replaced."""
    return latest_rows(read(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("SELECT count(DISTINCT key) AS rows FROM crawl")
def count_keys(spark, folder):
    """IO-11: rows of a keyed table."""
    return read(spark, folder, "crawl").select("key").distinct().agg(F.count("key").alias("rows"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey >= 100 ORDER BY p_partkey LIMIT 10")
def table_view_page(spark, folder):
    """IO-16: a page of a table by key."""
    return page_of(read(spark, folder, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", 100)


@query("SELECT c_name AS key, c_nationkey::VARCHAR AS c_nationkey, (SELECT c_name FROM customer ORDER BY 1 LIMIT 1 OFFSET 14) AS following FROM customer ORDER BY 1 LIMIT 10 OFFSET 4")
def store_view(spark, folder):
    """IO-16: a page of a store's table from a key on, and the key that the next page begins with."""
    store = _customers(spark, folder)
    first = sorted(r["key"] for r in store.scan("customer", None, "Customer#000000100").select("key").collect())[4]
    rows, following = store.view("customer", first)
    return spark.createDataFrame([(r["key"], r["c_nationkey"], following) for r in rows], "key string, c_nationkey string, following string")


@query("SELECT n_regionkey::VARCHAR AS key, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY 1")
def save_pairs(spark, folder):
    """IO-18, IO-19: a row for each key with all its values, read back from the table it was saved as."""
    name = f"pairs_{uuid.uuid4().hex}"
    _pairs(read(spark, folder, "nation"), "n_regionkey", "n_name").save_as_table(name, f"{scratch_root(spark).rstrip('/')}/tarnweave/{name}")
    return spark.table(name).select("key", F.array_join("values", "|").alias("names"))


@query("SELECT 'a|b' AS collected, 25::BIGINT AS n, 'The job did not invoke output()' AS silent, 'xy' AS said, true AS dropped")
def flow_lifetime(spark, folder):
    """IO-20 to IO-22, R-13, P-6: collect, destroy and output, and a flow by the name of its view."""
    names = Flow(read(spark, folder, "nation").select("n_name"))
    n = spark.table(names.table_name()).count()
    few = _pairs(spark.createDataFrame([("a", "b")], "k string, v string"), "k", "v")
    collected = "|".join(few.collect()[0])
    names.destroy()
    try:
        names.count()
        dropped = False
    except Dropped:
        dropped = True
    said = Job(spark).run(lambda job, args: [job.output(x) for x in args], ["x", "y"])
    return spark.createDataFrame([(collected, n, Job(spark).run(lambda job, args: None), said, dropped)], "collected string, n bigint, silent string, said string, dropped boolean")


@query("SELECT trim(c_mktsegment) AS value FROM customer WHERE trim(c_mktsegment) <> ''")
def line_files(spark, folder):
    """IO-23: the lines of text files."""
    path = f"{scratch_root(spark).rstrip('/')}/tarnweave/lines-{uuid.uuid4().hex}"
    read(spark, folder, "customer").select(F.concat(F.lit("  "), "c_mktsegment", F.lit("\n "))).write.text(path)
    return read_lines(spark, path)


_ENCODED = "url"
for _c in "_:/.?=&,%+~#@!;":
    _ENCODED = f"replace({_ENCODED}, '{_c}', '_{ord(_c):x}')"


@query(f"SELECT DISTINCT url, {_ENCODED} AS name FROM crawl WHERE url IS NOT NULL")
def encoded_keys(spark, folder):
    """IO-26: keys as file names."""
    urls = read(spark, folder, "crawl").where("url is not null").select("url").distinct()
    return urls.select("url", encode_key_column("url").alias("name"))


# Flows


@query("SELECT count(*) AS n FROM lineitem")
def count(spark, folder):
    """R-1."""
    return spark.createDataFrame([(Flow(read(spark, folder, "lineitem").select("l_orderkey")).count(),)], "n bigint")


@query("SELECT DISTINCT l_returnflag || l_linestatus AS value FROM lineitem")
def distinct(spark, folder):
    """R-2."""
    return Flow(read(spark, folder, "lineitem").select(F.concat("l_returnflag", "l_linestatus"))).distinct().df


@query("SELECT 7::BIGINT AS taken, 7::BIGINT AS of_parts, (SELECT count(*) FROM region) AS most")
def take(spark, folder):
    """R-3: so many values of a flow, or all it has."""
    parts = read(spark, folder, "part")
    some = Flow(parts.select("p_partkey")).take(7)
    known = parts.where(F.col("p_partkey").cast("string").isin(*some)).count()
    return spark.createDataFrame([(len(some), known, len(Flow(read(spark, folder, "region").select("r_name")).take(99)))], "taken bigint, of_parts bigint, most bigint")


@query("SELECT sum(l_linenumber)::BIGINT AS total, max(l_returnflag) AS last FROM lineitem")
def fold(spark, folder):
    """R-4: folds by plain functions."""
    lines = read(spark, folder, "lineitem")
    total = Flow(lines.select("l_linenumber")).fold("0", lambda a, b: str(int(a) + int(b)))
    return spark.createDataFrame([(int(total), Flow(lines.select("l_returnflag")).fold("", max))], "total bigint, last string")


@query("SELECT string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation")
def fold_concat(spark, folder):
    """R-4: a concatenation, in order whatever the order of the values."""
    value = Flow(read(spark, folder, "nation").select("n_name")).fold("", lambda a, b: ",".join(sorted(x for x in [*a.split(","), *b.split(",")] if x)))
    return spark.createDataFrame([(value,)], "value string")


@query("SELECT word AS value, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL) WHERE word <> '' GROUP BY 1")
def flat_map(spark, folder):
    """R-5: the words of all documents, counted."""
    words = Flow(read(spark, folder, "documents").select("text")).flat_map(lambda v: F.filter(F.split(v, " "), lambda w: w != ""))
    return words.df.groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT key, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS key FROM documents WHERE text IS NOT NULL) WHERE key <> '' GROUP BY 1")
def flat_map_to_pair(spark, folder):
    """R-6: pairs of word and document, counted by word."""
    docs = read(spark, folder, "documents").where("text is not null")
    packed = Flow(docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text")))

    def pairs(v):
        words = F.filter(F.split(F.regexp_replace(v, r"^[0-9]+\t", ""), " "), lambda w: w != "")
        return F.transform(words, lambda w: F.struct(w.alias("key"), F.substring_index(v, "\t", 1).alias("value")))

    return packed.flat_map_to_pair(pairs).df.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS key, c_custkey::VARCHAR AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def map_to_pair(spark, folder):
    """R-7."""
    packed = Flow(read(spark, folder, "customer").select(F.concat("c_mktsegment", F.lit("|"), F.col("c_custkey").cast("string"))))
    return packed.map_to_pair(lambda v: F.substring_index(v, "|", 1), lambda v: F.substring_index(v, "|", -1)).df


@query("SELECT c_nationkey::VARCHAR AS value FROM customer INTERSECT SELECT s_nationkey::VARCHAR FROM supplier")
def intersection(spark, folder):
    """R-8: each common element once."""
    customers, suppliers = Flow(read(spark, folder, "customer").select("c_nationkey")), Flow(read(spark, folder, "supplier").select("s_nationkey"))
    return customers.intersection(suppliers).df


@query("SELECT o_orderkey::VARCHAR AS value FROM orders WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT < floor(0.1 * 4294967296)")
def sample_by_hash(spark, folder):
    """R-9, the same on every run; Flow.sample is the random one."""
    return Flow(read(spark, folder, "orders").select("o_orderkey")).sample_by_hash(0.1).df


@query("SELECT left(n_name, 1) AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1")
def group_by(spark, folder):
    """R-10: members with commas between."""
    return Flow(read(spark, folder, "nation").select("n_name")).group_by(lambda v: F.left(v, F.lit(1))).df


@query("SELECT event_type || ' ' || event_id AS value FROM events WHERE event_type = 'click'")
def filter_rows(spark, folder):
    """R-11."""
    return Flow(read(spark, folder, "events").select(F.concat_ws(" ", "event_type", "event_id"))).filter(lambda v: v.startswith("click ")).df


@query("SELECT upper(p_brand) || '!' AS value FROM part")
def map_partitions(spark, folder):
    """R-12: a Python iterator over each partition."""
    return Flow(read(spark, folder, "part").select("p_brand")).map_partitions(lambda values: (v.upper() + "!" for v in values)).df


@query("SELECT l_suppkey::VARCHAR AS key, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1")
def fold_by_key_sum(spark, folder):
    """P-1."""
    sums = _pairs(read(spark, folder, "lineitem"), "l_suppkey", "l_quantity").fold_by_key(lambda v: F.sum(v.cast("double")))
    return sums.df.select("key", F.col("value").cast("double").alias("value"))


@query("SELECT s_nationkey::VARCHAR AS key, string_agg(s_name, ',' ORDER BY s_name) AS value FROM supplier GROUP BY 1")
def fold_by_key_concat(spark, folder):
    """P-1."""
    return _pairs(read(spark, folder, "supplier"), "s_nationkey", "s_name").join_values(",").df


@query("SELECT unnest([event_type, user_id::VARCHAR]) AS value FROM events WHERE event_type IS NOT NULL")
def pair_flat_map(spark, folder):
    """P-2."""
    return _pairs(read(spark, folder, "events"), "event_type", "user_id").flat_map(lambda k, v: F.array(k, v)).df


@query("SELECT user_id::VARCHAR AS key, event_type AS value FROM events WHERE event_type IS NOT NULL UNION ALL SELECT event_type, user_id::VARCHAR FROM events WHERE event_type IS NOT NULL")
def pair_flat_map_to_pair(spark, folder):
    """P-3."""
    both = lambda k, v: F.array(F.struct(v.alias("key"), k.alias("value")), F.struct(k.alias("key"), v.alias("value")))
    return _pairs(read(spark, folder, "events"), "event_type", "user_id").flat_map_to_pair(both).df


@query("SELECT n_nationkey::VARCHAR AS key, n_name || ',' || c_name AS value FROM nation JOIN customer ON n_nationkey = c_nationkey")
def pair_join(spark, folder):
    """P-4."""
    return _pairs(read(spark, folder, "nation"), "n_nationkey", "n_name").join(_pairs(read(spark, folder, "customer"), "c_nationkey", "c_name")).df


@query(
    "SELECT key, '[' || coalesce(string_agg(value, ',' ORDER BY value) FILTER (side = 0), '') || '],[' || coalesce(string_agg(value, ',' ORDER BY value) FILTER (side = 1), '') || ']' AS value FROM (SELECT s_nationkey::VARCHAR AS key, s_name AS value, 0 AS side FROM supplier UNION ALL SELECT c_nationkey::VARCHAR, c_name, 1 FROM customer) GROUP BY 1"
)
def cogroup(spark, folder):
    """P-5: keys of either side."""
    customers = read(spark, folder, "customer")
    return _pairs(read(spark, folder, "supplier"), "s_nationkey", "s_name").cogroup(_pairs(customers, "c_nationkey", "c_name")).df


# Text and urls

_HASH = "array_to_string(list_transform(list_transform(list_transform(range(20), lambda i: ('0x' || substr(sha1({0}), 2 * i + 1, 2))::INT), lambda x: CASE WHEN x = 0 THEN 255 WHEN x < 128 THEN x ELSE x - 1 END), lambda x: chr((97 + x % 26)::INT) || substr('acegikmoqs', (x // 26 + 1)::INT, 1)), '')"
_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<script\b.*?</script\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^a-zA-Z0-9\s]', ' ', 'g')"


def _page_sql(column: str) -> str:
    words = "|".join(sorted({w for w in T.STOP_WORDS if w.isalnum()}))
    layout = f"regexp_replace({_VISIBLE.format(column)}, '{T.LAYOUT_WORDS}', ' ', 'g')"
    return rf"trim(lower(regexp_replace(regexp_replace({layout}, '(?i)\b({words})\b', ' ', 'g'), '\s+', ' ', 'g')))"


@query(f"SELECT DISTINCT url, {_HASH.format('url')} AS key FROM crawl WHERE url IS NOT NULL")
def hash_url(spark, folder):
    """S-1."""
    return read(spark, folder, "crawl").where("url is not null").select("url").distinct().withColumn("key", hash_key("url"))


@query(f"SELECT fetch_id, {_page_sql('page')} AS text FROM crawl WHERE page IS NOT NULL")
def page_text(spark, folder):
    """T-1, T-6."""
    return spread(read(spark, folder, "crawl").select("fetch_id", "page")).where("page is not null").select("fetch_id", T.page_text("page").alias("text"))


@query("SELECT fetch_id, regexp_extract('<title>' || coalesce(title, '') || '</title>' || page, '(?s)<title>(.*?)</title>', 1) AS title FROM crawl WHERE page IS NOT NULL")
def page_title(spark, folder):
    """T-3, on pages with their stored titles put back."""
    html = F.concat(F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit("</title>"), "page")
    return read(spark, folder, "crawl").where("page is not null").select("fetch_id", T.page_title(html).alias("title"))


@query(
    rf"""SELECT fetch_id, CASE WHEN fetch_id % 2 = 0 AND coalesce(title, '') <> '' THEN replace(title, '"', '') WHEN contains(left(v, 50), 'wikipedia') THEN left(v, strpos(v, 'wikipedia') + 8) ELSE left(v, 50) END AS description
    FROM (SELECT fetch_id, title, CASE WHEN fetch_id % 2 = 0 AND coalesce(title, '') <> '' THEN NULL ELSE {_VISIBLE.format("page")} END AS v FROM crawl WHERE page IS NOT NULL)"""
)
def page_description(spark, folder):
    """T-4: half of the pages get a meta tag made of their title, the others fall back to their text."""
    meta = F.concat(F.lit('<meta name="description" content="'), F.regexp_replace("title", '"', ""), F.lit('">'), "page")
    html = F.when((F.col("fetch_id") % 2 == 0) & (F.coalesce("title", F.lit("")) != ""), meta).otherwise(F.col("page"))
    return read(spark, folder, "crawl").where("page is not null").select("fetch_id", T.page_description(html).alias("description"))


#: Links by the contract: opening tags of anchors with plain attributes, then each attribute by itself.
_LINKS = r"""(SELECT {keys}, regexp_replace(a[2], '^["'']|["'']$', '', 'g') AS link FROM (
    SELECT {keys}, unnest(list_zip(regexp_extract_all(tag, '\s+(\w+)(?:\s*=\s*("[^"\n]*"|''[^''\n]*''|[^''">\s]+))?', 1), regexp_extract_all(tag, '\s+(\w+)(?:\s*=\s*("[^"\n]*"|''[^''\n]*''|[^''">\s]+))?', 2)), recursive := false) AS a
    FROM (SELECT {keys}, unnest(regexp_extract_all(page, '(?i)<\s*a((?:\s+\w+(?:\s*=\s*(?:"[^"\n]*"|''[^''\n]*''|[^''">\s]+))?)*)\s*>', 1)) AS tag FROM {table}))
  WHERE lower(a[1]) = 'href' AND trim(regexp_replace(a[2], '^["'']|["'']$', '', 'g')) <> '')"""
#: Links that no page of the crawl has: attributes without value, blanks behind the bracket, several hrefs, odd names.
_ODD = "<a download href=/one>x</a> < A  HREF=''/two'' title=\"t\"> <a data-x=1 href=/no> <a href=/three href=\"/four\" > <a href=\"\"> <a href=/five/>"


@query(f"""SELECT fetch_id, link, count(*) AS n FROM {_LINKS.format(keys="fetch_id", table="(SELECT fetch_id, page || '" + _ODD + "' AS page FROM crawl WHERE page IS NOT NULL)")} GROUP BY ALL""")
def page_links(spark, folder):
    """T-2: links in the pages, to each of which some odd ones are added."""
    html = F.concat("page", F.lit(_ODD.replace("''", "'")))
    links = read(spark, folder, "crawl").where("page is not null").select("fetch_id", F.explode(T.page_links(html)).alias("link"))
    return links.groupBy("fetch_id", "link").agg(F.count("*").alias("n"))


@query(r"SELECT DISTINCT url, regexp_extract(url, '^([^:/]+)://', 1) AS protocol, regexp_extract(url, '^[^:/]+://([^:/]*)', 1) AS host, regexp_extract(url, '^[^:/]+://[^:/]*:([0-9]*)', 1) AS port, regexp_extract(url, '^[^:/]+://[^/]*(/.*)$', 1) AS path FROM crawl WHERE url IS NOT NULL")
def url_parse(spark, folder):
    """U-1."""
    urls = read(spark, folder, "crawl").where("url is not null").select("url").distinct()
    part = U.url_parts("url")
    return urls.select("url", *(part[k].alias(k) for k in ("protocol", "host", "port", "path")))


_NORMAL = r"""CASE WHEN lower(regexp_extract({0}, '^([a-zA-Z]+)://', 1)) IN ('http', 'https') AND NOT regexp_matches({0}, '\s') AND regexp_extract({0}, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:@]+)', 1) <> '' AND NOT regexp_matches(regexp_extract({0}, '://[^/?#]+([^?#]*)', 1), '(?i)\.(jpg|jpeg|gif|png|txt)$')
  THEN lower(regexp_extract({0}, '^([a-zA-Z]+)://', 1)) || '://' || regexp_extract({0}, '://([^/?#@]*@)', 1) || regexp_extract({0}, '://(?:[^/?#@]*@)?([^/?#:@]+)', 1) || ':' || coalesce(nullif(regexp_extract({0}, '://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)', 1), ''), CASE WHEN {0} ILIKE 'https%' THEN '443' ELSE '80' END) || coalesce(nullif(regexp_extract({0}, '://[^/?#]+([^?#]*)', 1), ''), '/') || regexp_extract({0}, '(\?[^#]+)', 1) END"""
#: The absolute form of a link that may be relative: by scheme, host, root, query, fragment, or folder, from which leading ../ go up.
_ROOT, _FOLDER = r"regexp_extract({1}, '^([a-zA-Z]+://[^/?#]+)', 1)", r"regexp_extract(regexp_extract({1}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '^(.*/)', 1)"
_ABSOLUTE = rf"""CASE WHEN regexp_matches({{0}}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {{0}} WHEN {{0}} LIKE '//%' THEN regexp_extract({{1}}, '^([a-zA-Z]+:)', 1) || {{0}} WHEN {{0}} LIKE '/%' THEN {_ROOT} || {{0}}
  WHEN {{0}} LIKE '?%' THEN regexp_extract({{1}}, '^([^?#]*)', 1) || {{0}} WHEN {{0}} LIKE '#%' THEN {{1}} WHEN {{0}} LIKE '../%' THEN {_ROOT} || coalesce(nullif(regexp_extract({_FOLDER}, '^(.*/)[^/]+/$', 1), ''), '/') || substr({{0}}, 4) ELSE {_ROOT} || {_FOLDER} || {{0}} END"""


def _resolved(link: str, base: str) -> str:
    return _NORMAL.format("(" + _ABSOLUTE.format(link, base) + ")")


@query(f"SELECT link, {_NORMAL.format('link')} AS url FROM (SELECT DISTINCT replace(link, '://', CASE WHEN length(link) % 3 = 0 THEN '://user@' ELSE '://' END) AS link FROM (SELECT unnest(urls) AS link FROM crawl)) WHERE link IS NOT NULL AND {_NORMAL.format('link')} IS NOT NULL")
def url_normalize(spark, folder):
    """U-2, U-3: absolute links in their normal form; to a third of them a user is added."""
    links = read(spark, folder, "crawl").select(F.explode("urls").alias("link")).where("link is not null")
    links = links.select(F.when(F.length("link") % 3 == 0, F.replace("link", F.lit("://"), F.lit("://user@"))).otherwise(F.col("link")).alias("link")).distinct()
    return links.select("link", U.normalized_absolute("link").alias("url")).where("url is not null")


_FORMS = ("next.html", "deep/er?q=1#f", "/abs?q=1", "//other.test/p", "../up/", "?a=b", "#top", "mailto:a@b.test", "pic.PNG", "ftp://f.test/", "HTTP://Shop.test", "http://u:p@h.test:8080#x", "two words")


@query(f"SELECT base, link, {_resolved('link', 'base')} AS url FROM (SELECT DISTINCT url AS base FROM crawl WHERE url IS NOT NULL), (VALUES {', '.join(f'($${f}$$)' for f in _FORMS)}) AS forms(link)")
def url_resolve(spark, folder):
    """U-2, U-4: relative links against the url of their page; a given list of forms for every url, no join of rows."""
    bases = read(spark, folder, "crawl").where("url is not null").select(F.col("url").alias("base")).distinct()
    forms = bases.select("base", F.explode(F.array(*(F.lit(f) for f in _FORMS))).alias("link"))
    return forms.select("base", "link", U.normalized("link", "base").alias("url"))


@query(r"SELECT DISTINCT url FROM frontier WHERE url IS NOT NULL AND regexp_matches(url, '^[\x00-\x7F]*$') AND NOT regexp_matches(url, '(?i)\.(jpg|jpeg|gif|png|txt)$')")
def url_filter(spark, folder):
    """U-3, U-6."""
    urls = read(spark, folder, "frontier").where("url is not null").where(U.is_ascii("url") & ~U.is_ignored("url"))
    return urls.select("url").distinct()


_BLACKLIST = ("*/index.php*", "http://*", "*.invalid:443/life/*")


@query(r"SELECT DISTINCT url FROM crawl WHERE url IS NOT NULL AND NOT regexp_full_match(url, '.*/index\.php.*|http://.*|.*\.invalid:443/life/.*')")
def blacklist(spark, folder):
    """U-5."""
    return read(spark, folder, "crawl").where("url is not null").where(~U.is_blacklisted("url", _BLACKLIST)).select("url").distinct()


_AGENT, _NOW = "tarnweave-crawler", 1_718_000_000_000
#: Rules of every host by the contract: a line's block is the last agent named before it, * at first; the block of the longest
#: agent that is * or part of one's own name holds, with its first delay, and * is there always.
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[^:/]+://([^:/]*)', 1)), '^www\.', '')"
_ROBOTS = rf"""hosts1 AS (SELECT key, arg_max(struct_pack(r := robots, l := lastaccessedms), (coalesce(lastaccessedms, -1), coalesce(robots, ''))) AS h FROM hosts WHERE key IS NOT NULL GROUP BY 1),
  texts1 AS (SELECT key, h.l AS last, h.r AS robots FROM hosts1),
  lines AS (SELECT key, i, lower(trim(split_part(line, ':', 1), chr(9) || ' ')) AS k, trim(substr(line, strpos(line, ':') + 1), chr(9) || ' ') AS v FROM (SELECT key, unnest(string_split_regex(robots, '[\r\n]')) AS line, generate_subscripts(string_split_regex(robots, '[\r\n]'), 1) AS i FROM texts1 WHERE robots IS NOT NULL) WHERE contains(line, ':')),
  said AS (SELECT key, i, k, v, coalesce(last_value(CASE WHEN k = 'user-agent' THEN lower(v) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY i), '*') AS agent FROM lines WHERE v <> ''),
  mine AS (SELECT key, arg_max(agent, (length(agent), agent <> '*', agent)) AS agent FROM (SELECT key, agent FROM said WHERE agent = '*' OR contains('{_AGENT}', agent) UNION ALL SELECT key, '*' FROM texts1) GROUP BY 1),
  delays AS (SELECT key, arg_min(TRY_CAST(v AS DOUBLE), i) AS delay FROM said JOIN mine USING (key, agent) WHERE k = 'crawl-delay' AND TRY_CAST(v AS DOUBLE) IS NOT NULL GROUP BY 1),
  rules AS (SELECT key, i, k, v FROM said JOIN mine USING (key, agent) WHERE k IN ('allow', 'disallow')),
  asked AS (SELECT DISTINCT url, {_HASH.format(_HOST)} AS key, coalesce(nullif(regexp_extract(url, '^[^:/]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM frontier WHERE url IS NOT NULL),
  judged AS (SELECT url, CASE WHEN arg_min(k, i) = 'disallow' THEN 0 WHEN any_value(last) IS NOT NULL AND {_NOW} < any_value(last) + 1000 * coalesce(any_value(delay), 0) THEN 2 ELSE 1 END::INT AS decision
    FROM asked LEFT JOIN texts1 USING (key) LEFT JOIN delays USING (key) LEFT JOIN rules ON rules.key = asked.key AND starts_with(path, v) GROUP BY url)"""


@query(f"WITH {_ROBOTS} SELECT url, decision FROM judged")
def robots_decision(spark, folder):
    """U-7, U-8, U-9: what the hosts' robots texts say of the frontier's urls."""
    urls = read(spark, folder, "frontier").where("url is not null").select("url").distinct()
    path = F.regexp_replace(U.url_parts("url")["path"], r"[?#].*$", "")
    keyed = urls.withColumn("key", hash_key(U.host_key_name("url"))).withColumn("path", path)
    hosts = read(spark, folder, "hosts").where("key is not null").groupBy("key").agg(F.max(F.struct("lastaccessedms", "robots")).alias("h"))
    known = keyed.join(hosts, "key", "left")
    decide = U.robots_decisions(_AGENT)
    return known.select("url", decide("h.robots", "path", F.lit(_NOW).cast("bigint"), "h.lastaccessedms").alias("decision"))


@query(
    rf"""WITH {_ROBOTS}, front AS (SELECT url, min(coalesce(depth, 0)) AS depth FROM frontier WHERE url IS NOT NULL GROUP BY 1),
    answers AS (SELECT url, max(struct_pack(c := coalesce(responsecode, 0), t := coalesce(contenttype, ''), n := coalesce(length, 0))) AS a FROM (SELECT url, responsecode, contenttype, CASE WHEN page IS NULL THEN length ELSE coalesce(length, length(page)) END AS length FROM crawl WHERE url IS NOT NULL) GROUP BY 1),
    known AS (SELECT DISTINCT url FROM crawl WHERE responsecode >= 500)
    SELECT url, depth::INT AS depth, CASE WHEN depth >= 3 THEN 'too deep' WHEN NOT regexp_matches(url, '^[\x00-\x7F]*$') THEN 'not ascii' WHEN url IN (SELECT url FROM known) THEN 'known' WHEN regexp_extract(url, '^[^:/]+://([^:/]*)', 1) = '' THEN 'no host'
      WHEN regexp_full_match(url, '.*/index\.php.*|http://.*|.*\.invalid:443/life/.*') THEN 'blacklisted' WHEN decision = 0 THEN 'denied' WHEN decision = 2 THEN 'wait' WHEN a IS NULL THEN 'no answer' WHEN coalesce(a.n, 0) <= 0 THEN 'no length'
      WHEN a.c IN (301, 302, 303, 307, 308) THEN 'redirect' WHEN coalesce(a.c, 0) <> 200 OR NOT contains(coalesce(a.t, ''), 'text/html') THEN 'no page' ELSE 'fetched' END AS outcome
    FROM front JOIN judged USING (url) LEFT JOIN answers USING (url)"""
)
def crawl_outcomes(spark, folder):
    """J-5, IO-24: what comes of each url of the frontier, by depth, robots, delay, status, type and length."""
    crawl = read(spark, folder, "crawl").where("url is not null")
    answers = crawl.select("url", "responsecode", "contenttype", F.when(F.col("page").isNull(), F.col("length")).otherwise(F.coalesce("length", F.length("page").cast("bigint"))).alias("length"))
    found = C.outcomes(read(spark, folder, "frontier"), crawl.where("responsecode >= 500"), read(spark, folder, "hosts"), answers, _NOW, _AGENT, _BLACKLIST)
    return found.select("url", "depth", "outcome")


# Jobs

_CURRENT = "current AS (SELECT key, url, page, urls FROM crawl WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY stored_at DESC NULLS LAST, fetched_at DESC NULLS LAST, fetch_id DESC NULLS LAST) = 1)"
_TEXTS = f"{_CURRENT}, texts AS (SELECT key, url, {_page_sql('page')} AS page FROM current WHERE url IS NOT NULL AND page IS NOT NULL)"
_INDEX = f"{_TEXTS}, idx AS (SELECT DISTINCT key, lower(w) AS word FROM (SELECT key, unnest(regexp_split_to_array(page, '[.,:;!?''\"()\\-]|\\s')) AS w FROM texts) WHERE trim(w) <> '')"


def _current(spark: SparkSession, folder: str) -> DataFrame:
    return I.current_pages(read(spark, folder, "crawl"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """key, url and the cleaned page of crawled keys that have both; raw pages are tested, so each is cleaned once."""
    return I.indexable(I.current_pages(read(spark, folder, "crawl"), ("url", "page"))).withColumn("page", T.page_text("page"))


def _crawled(spark: SparkSession, folder: str) -> int:
    return read(spark, folder, "crawl").where("key is not null").select("key").distinct().count()


@query(f"WITH {_INDEX} SELECT word, count(*) AS documents FROM idx GROUP BY 1")
def inverted_index(spark, folder):
    """J-1: words with the number of their pages."""
    return I.document_frequency(I.postings(_texts(spark, folder)))


@query(f"WITH {_INDEX} SELECT word, 0 AS part, string_agg(key, ',' ORDER BY key) AS value FROM idx GROUP BY 1")
def packed_index(spark, folder):
    """J-1: words with their packed keys, in parts of bounded size."""
    return I.packed_index(I.postings(_texts(spark, folder)))


_TFIDF = f"""{_INDEX},
    df AS (SELECT word, count(*) AS n FROM idx GROUP BY 1), total AS (SELECT count(*) AS n FROM current),
    counts AS (SELECT key, w AS word, count(*) AS n FROM (SELECT key, unnest(string_split(page, ' ')) AS w FROM texts) GROUP BY ALL),
    tf AS (SELECT key, word, 0.4 + 0.6 * n / max(n) OVER (PARTITION BY key) AS tf FROM counts),
    weights AS (SELECT tf.word, tf.key, ln(1 + tf * ln((SELECT n FROM total) / df.n)) AS weight FROM tf JOIN df ON tf.word = df.word)"""


@query(f"WITH {_TFIDF} SELECT word, key, round(weight, 6) + 0.0 AS weight FROM weights")
def tf_idf(spark, folder):
    """J-3."""
    return I.tf_idf(_texts(spark, folder), total=_crawled(spark, folder)).select("word", "key", (F.round("weight", 6) + 0.0).alias("weight"))


_RANKS = "latest AS (SELECT key, rank FROM pageranks WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY saved_at DESC NULLS LAST, rank DESC NULLS LAST) = 1)"


@query(
    f"WITH {_TFIDF}, {_RANKS} SELECT word, url, round(CASE WHEN weight + ln(1 + rank) = 0 THEN NULL ELSE 2 * weight * ln(1 + rank) / (weight + ln(1 + rank)) END, 6) + 0.0 AS score FROM weights JOIN texts USING (key) JOIN latest USING (key) WHERE rank IS NOT NULL AND NOT isnan(rank) AND NOT contains(url, '...')"
)
def combined_scores(spark, folder):
    """J-4."""
    # The second read is of keys and urls alone.
    urls = I.current_pages(read(spark, folder, "crawl"), ("url",))
    found = I.combined_scores(urls, I.tf_idf(_texts(spark, folder), total=_crawled(spark, folder)), I.latest_ranks(read(spark, folder, "pageranks")))
    return found.select("word", "url", (F.round("score", 6) + 0.0).alias("score"))


def _pagerank_sql(rounds: int) -> str:
    steps = [
        f"""r{k} AS MATERIALIZED (SELECT r.id, 0.15 + coalesce(s.v, 0) AS rank FROM r{k - 1} r LEFT JOIN (SELECT dst, sum(0.85 / degree * rank) AS v FROM edges JOIN r{k - 1} q ON q.id = src GROUP BY dst) s ON s.dst = r.id)"""
        for k in range(1, rounds + 1)
    ]
    return f"""{_CURRENT}, nodes AS (SELECT key AS id, urls FROM current WHERE url IS NOT NULL AND page IS NOT NULL),
    links AS (SELECT id AS src, unnest(list_distinct(urls)) AS url FROM nodes), hashed AS (SELECT src, {_HASH.format("url")} AS dst FROM links WHERE url IS NOT NULL),
    edges AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM hashed), r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM nodes), {", ".join(steps)}"""


@query(f"WITH {_pagerank_sql(5)} SELECT id, round(rank + 1e-9, 6) AS rank FROM r5")
def pagerank_fixed_k(spark, folder):
    """J-2: five rounds over the crawl's links."""
    return R.pagerank(*R.link_graph(_current(spark, folder)), rounds=5).select("id", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


_MOST = 40
_MOVES = " UNION ALL ".join(f"SELECT {k} AS k, max(abs(a.rank - b.rank)) AS moved FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, _MOST + 1))
_ALL = " UNION ALL ".join(f"SELECT {k} AS k, id, rank FROM r{k}" for k in range(1, _MOST + 1))


@query(f"WITH {_pagerank_sql(_MOST)}, moves AS ({_MOVES}), states AS ({_ALL}) SELECT id, round(rank + 1e-9, 6) AS rank FROM states WHERE k = (SELECT min(k) FROM moves WHERE moved < 0.01)")
def pagerank_converged(spark, folder):
    """J-2: until no rank moves by 0.01."""
    return R.pagerank(*R.link_graph(_current(spark, folder)), threshold=0.01).select("id", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


@query(
    r"""WITH deeper AS (SELECT to_ AS url, min(coalesce(f.depth, 0) + 1) AS depth FROM (SELECT url, unnest(urls) AS to_ FROM crawl) l JOIN frontier f USING (url) WHERE to_ IS NOT NULL AND coalesce(f.depth, 0) + 1 < 3 GROUP BY 1)
    SELECT url, depth::INT AS depth FROM deeper WHERE regexp_matches(url, '^[\x00-\x7F]*$') AND regexp_matches(url, '^[a-z]+://[^/?#:]+:[0-9]+/[^#]*$') AND NOT regexp_matches(url, '(?i)\.(jpg|jpeg|gif|png|txt)$') AND url NOT IN (SELECT url FROM crawl WHERE url IS NOT NULL)"""
)
def crawl_frontier_step(spark, folder):
    """J-5: the links of the frontier's urls that are new, at their least depth."""
    crawl = read(spark, folder, "crawl")
    links = crawl.select("url", F.explode("urls").alias("to"))
    return C.next_frontier(read(spark, folder, "frontier"), links, crawl.select("url").where("url is not null"))


_EXTRACTED = "(SELECT DISTINCT url, page FROM crawl WHERE page IS NOT NULL AND url IS NOT NULL)"


@query(
    rf"""WITH one AS (SELECT url, page, {_VISIBLE.format("page")} AS v FROM {_EXTRACTED}), links AS (SELECT url, {_resolved("link", "url")} AS target FROM {_LINKS.format(keys="url", table=_EXTRACTED)}),
    urls AS (SELECT url, string_agg(DISTINCT target, ' ' ORDER BY target) AS urls FROM links WHERE target IS NOT NULL GROUP BY 1)
    SELECT DISTINCT url, {_HASH.format("url")} AS key, regexp_extract(page, '(?s)<title>(.*?)</title>', 1) AS title, coalesce(nullif(regexp_extract(page, '(?s)<meta name="description" content="(.*?)"', 1), ''), CASE WHEN contains(left(v, 50), 'wikipedia') THEN left(v, strpos(v, 'wikipedia') + 8) ELSE left(v, 50) END) AS description,
      {_page_sql("page")} AS page, urls FROM one LEFT JOIN urls USING (url)"""
)
def page_extraction(spark, folder):
    """C-1: extraction from stored pages."""
    pages = read(spark, folder, "crawl").where("page is not null and url is not null").select("url", "page").distinct()
    return C.extract(pages, html="page").select("url", "key", "title", "description", "page", F.array_join("urls", " ").alias("urls")).distinct()


# Serving

_SCORES = r"""scores AS (SELECT word, url, score FROM (
    SELECT word, trim(regexp_extract(part, '^(.*),[^,]*$', 1, 's')) AS url, TRY_CAST(trim(regexp_extract(part, ',([^,]*)$', 1, 's')) AS DOUBLE) AS score, saved_at, put_id
    FROM (SELECT word, saved_at, put_id, unnest(string_split(value, ';')) AS part FROM combinedscores WHERE word IS NOT NULL AND value IS NOT NULL) WHERE contains(part, ','))
  WHERE score IS NOT NULL AND isfinite(score) AND url <> '' QUALIFY row_number() OVER (PARTITION BY word, url ORDER BY saved_at DESC NULLS LAST, put_id DESC NULLS LAST, score DESC) = 1)"""
_ASKED = "harbour lantern harbour"
_HITS = f"{_SCORES}, hits AS (SELECT url, sum(score * CASE word WHEN 'harbour' THEN 2 ELSE 1 END) AS score FROM scores WHERE word IN ('harbour', 'lantern') GROUP BY 1)"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return latest_scores(read(spark, folder, "combinedscores"))


@query(f"WITH {_SCORES} SELECT word, count(*) AS urls, round(max(score), 6) AS best FROM scores GROUP BY 1")
def unpacked_scores(spark, folder):
    """Packed postings as rows, counted by word."""
    return _scores(spark, folder).groupBy("word").agg(F.count("*").alias("urls"), F.round(F.max("score"), 6).alias("best"))


@query(f"WITH {_HITS} SELECT url, round(score, 6) AS score FROM hits ORDER BY round(score, 9) DESC, url LIMIT 10")
def search_page1(spark, folder):
    """Q-1, Q-2: a repeated word counts twice."""
    return S.search(_scores(spark, folder), _ASKED, 1).select("url", F.round("score", 6).alias("score"))


@query(f"WITH {_HITS} SELECT url, round(score, 6) AS score FROM hits ORDER BY round(score, 9) DESC, url LIMIT 10 OFFSET 10")
def search_page2(spark, folder):
    """Q-2."""
    return S.search(_scores(spark, folder), _ASKED, 2).select("url", F.round("score", 6).alias("score"))


@query(
    f"WITH {_HITS}, first AS (SELECT * FROM hits ORDER BY round(score, 9) DESC, url LIMIT 10), shown AS (SELECT url, arg_max(coalesce(title, ''), (stored_at, fetched_at, fetch_id)) AS title, arg_max(coalesce(description, ''), (stored_at, fetched_at, fetch_id)) AS description FROM crawl WHERE url IS NOT NULL GROUP BY 1) SELECT url, round(score, 6) AS score, coalesce(nullif(title, ''), url) AS title, coalesce(nullif(regexp_replace(description, '^[^\\]]*\\]', ''), ''), 'No description available') AS description FROM first LEFT JOIN shown USING (url)"
)
def search_hydrated(spark, folder):
    """Q-3: hits with title and description."""
    crawl = read(spark, folder, "crawl").where("url is not null").select("url", "title", "description", "stored_at", "fetched_at", "fetch_id")
    shown = latest_rows(crawl, ["url"], ["stored_at", "fetched_at", "fetch_id"])
    return S.hydrate(S.search(_scores(spark, folder), _ASKED, 1), shown).select("url", F.round("score", 6).alias("score"), "title", "description")


@query("SELECT DISTINCT word FROM combinedscores WHERE lower(word) LIKE 'ha%' ORDER BY word LIMIT 10")
def autocomplete(spark, folder):
    """Q-5."""
    return complete(read(spark, folder, "combinedscores"), "Ha")


#: Likeness of pairs (a, b): letters of a are matched one after the other with the first free like letter of b within reach;
#: crossed ones count half; the whole common prefix raises it, by 0.1 or 1 / len(a) a letter; nothing matches in words of one letter.
_LIKENESS = """matching AS (
    SELECT a, b, greatest(length(a), length(b)) // 2 - 1 AS reach, 1 AS i, []::BIGINT[] AS taken, '' AS hits FROM pairs
    UNION ALL SELECT a, b, reach, i + 1, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END, CASE WHEN j IS NULL THEN hits ELSE hits || a[i] END
    FROM (SELECT *, list_min(list_filter(range(greatest(1, i - reach), least(length(b), i + reach) + 1), lambda x: NOT list_contains(taken, x) AND b[x] = a[i])) AS j FROM matching WHERE i <= length(a))),
  jaro AS (SELECT a, b, CASE WHEN m = 0 THEN 0 ELSE (m / length(a) + m / length(b) + (m - len(list_filter(range(1, m + 1), lambda k: hits[k] <> b[places[k]])) / 2) / m) / 3 END AS s
    FROM (SELECT a, b, hits, len(taken) AS m, list_sort(taken) AS places FROM matching WHERE i = length(a) + 1)),
  likeness AS (SELECT a, b, s + CASE WHEN s = 0 THEN 0 ELSE least(0.1, 1 / length(a)) * len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) * (1 - s) END AS l FROM jaro)"""
_KNOWN = "known AS (SELECT DISTINCT word FROM combinedscores WHERE word IS NOT NULL)"
_MISSPELT = ("harbor", "lantren", "glacer")


@query(f"WITH RECURSIVE {_KNOWN}, pairs AS (SELECT a, word AS b FROM (SELECT unnest([{', '.join(repr(w) for w in _MISSPELT)}]) AS a), known), {_LIKENESS} SELECT a AS word, arg_min(b, (-round(l, 12), b)) AS suggestion, round(max(l), 9) AS likeness FROM likeness GROUP BY 1")
def suggestions(spark, folder):
    """Q-4, S-3: the likest known words of misspelt ones."""
    return suggest(read(spark, folder, "combinedscores"), list(_MISSPELT)).withColumn("likeness", F.round("likeness", 9))


@query(f"WITH RECURSIVE {_KNOWN}, pairs AS (SELECT word AS a, 'harbour' AS b FROM known), {_LIKENESS} SELECT a AS word, round(l, 9) AS likeness FROM likeness")
def jaro_winkler(spark, folder):
    """S-2: likeness of all known words to one."""
    words = read(spark, folder, "combinedscores").where("word is not null").select("word").distinct()
    return words.select("word", F.round(jaro_winkler_column("word", F.lit("harbour")), 9).alias("likeness"))


@query("SELECT fetch_id, count(*) AS n FROM (SELECT put_id AS fetch_id, unnest(string_split(value, ';')) AS part FROM combinedscores WHERE value IS NOT NULL) WHERE contains(part, ',') AND isfinite(TRY_CAST(trim(regexp_extract(part, ',([^,]*)$', 1, 's')) AS DOUBLE)) AND trim(regexp_extract(part, '^(.*),[^,]*$', 1, 's')) <> '' GROUP BY 1")
def posting_counts(spark, folder):
    """Postings with a finite score of each stored row."""
    return unpack(read(spark, folder, "combinedscores").select(F.col("put_id").alias("fetch_id"), "value")).groupBy("fetch_id").agg(F.count("*").alias("n"))
