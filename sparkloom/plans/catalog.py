"""Queries of the library's own operators over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates, graph, joins, lookups, quality, ranking, retrieve, state, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LICENSE, HREF = r"Released under the (\w+) License", 'href="([^"]*)"'
_GRAPH = """edges AS (
  SELECT DISTINCT 'c' || o_custkey AS caller, 's' || l_suppkey AS callee FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
)"""


def _edges(spark, sf) -> DataFrame:
    s = lambda a, b: F.concat(F.lit(a), F.col(b).cast("string"))
    bought = _t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(_t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = bought.select(s("c", "o_custkey").alias("caller"), s("s", "l_suppkey").alias("callee")).distinct()
    out = out.unionByName(_t(spark, sf, "supplier").select(s("s", "s_suppkey").alias("caller"), s("n", "s_nationkey").alias("callee")))
    return out.unionByName(_t(spark, sf, "nation").select(s("n", "n_nationkey").alias("caller"), s("r", "n_regionkey").alias("callee")))


def _match_sql(kind: str, table: str, id_col: str, text: str, rx: str) -> str:
    return f"""SELECT '{kind}' AS kind, {id_col} AS id, (1 + length(head) - length(replace(head, chr(10), '')))::BIGINT AS line, regexp_extract(part, '{rx}', 1) AS value
FROM (SELECT {id_col}, parts[i] AS part, array_to_string(parts[1:i - 1], '') AS head
      FROM (SELECT {id_col}, parts, unnest(range(2, len(parts) + 1)) AS i
            FROM (SELECT {id_col}, string_split(regexp_replace(replace({text}, chr(1), ''), '({rx})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM {table})))"""


@query(_match_sql("license", "documents", "doc_id", "text", LICENSE) + " UNION ALL " + _match_sql("link", "pages", "page_id", "html", HREF))
def ops_extract(spark, sf):
    docs = _t(spark, sf, "documents").select(F.lit("license").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = _t(spark, sf, "pages").select(F.lit("link").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    keep = ["kind", "id"]
    return X.anchored_matches(docs, "text", LICENSE, 1, keep).unionByName(X.anchored_matches(pages, "text", HREF, 1, keep))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def find_symbol_topk(spark, sf):
    return _t(spark, sf, "part").filter(F.lower("p_name").contains("ring")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name", "p_retailprice")


@query("""SELECT 'op' AS tool, p_partkey AS id, p_brand || ':' || p_size AS anchor FROM part WHERE contains(lower(p_type), 'promo')
UNION ALL SELECT 'tests', c_custkey, c_name FROM customer WHERE c_name IN ('Customer#000000007', '7') OR split_part('x::Customer#000000009', '::', -1) = c_name
UNION ALL SELECT 'changed', o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND starts_with(o_orderpriority, '1')
UNION ALL SELECT 'summary', c_custkey, c_mktsegment FROM customer WHERE c_custkey = 11""")
def name_lookup(spark, sf):
    part, customer, orders = (_t(spark, sf, t) for t in ("part", "customer", "orders"))
    ops = part.filter(F.lower("p_type").contains("promo")).select(F.lit("op").alias("tool"), F.col("p_partkey").alias("id"), F.concat_ws(":", "p_brand", "p_size").alias("anchor"))
    tests = customer.filter(F.col("c_name").isin("Customer#000000007", "7") | (F.col("c_name") == X.leaf(F.lit("x::Customer#000000009")))).select(F.lit("tests"), "c_custkey", "c_name")
    changed = orders.filter((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1")).select(F.lit("changed"), "o_orderkey", "o_orderpriority")
    summary = customer.filter("c_custkey = 11").select(F.lit("summary"), "c_custkey", "c_mktsegment")
    return ops.union(tests).union(changed).union(summary)


@query("""WITH first AS (SELECT source, arg_min(d.doc_id, d.doc_id) AS doc FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source),
own AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT d.doc_id AS id, d.source AS path, coalesce(o.quality, p.quality)::INTEGER AS fold
FROM documents d LEFT JOIN own o ON o.doc_id = d.doc_id LEFT JOIN first f ON f.source = d.source LEFT JOIN own p ON p.doc_id = f.doc""")
def summary_join_priority(spark, sf):
    docs, labels = _t(spark, sf, "documents").select("doc_id", "source"), _t(spark, sf, "labels")
    summaries = labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("quality").cast("int").alias("fold"), F.col("doc_id").alias("ordinal"))
    return joins.summary_join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("path")), summaries)


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages), d AS (SELECT DISTINCT split_part(path, '/', 1) AS host, split_part(path, '/', 2) AS lang, path FROM p),
s AS (SELECT path, 'host-' || host AS target, 1 AS rank FROM d WHERE lang <> 'de' UNION ALL SELECT path, 'lang-' || lang, 0 FROM d WHERE lang = 'en')
SELECT page_id, p.path, t.target FROM p LEFT JOIN (SELECT path, arg_min(target, rank) AS target FROM s GROUP BY path) t ON t.path = p.path""")
def target_join(spark, sf):
    """Hosts list their pages but German ones, which miss, and languages English ones again, first; a source with a variable is no path."""
    pages = _t(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path"))
    p = pages.select("path", F.split("path", "/")[0].alias("host"), F.get(F.split("path", "/"), F.lit(1)).alias("lang"), F.expr("substring(path, length(split(path, '/')[0]) + 2)").alias("rest"))
    made = lambda d, name, rank, folder, source: d.groupBy(F.col(name).alias("key"), F.lit(rank).alias("ordinal")).agg(F.concat(F.collect_set(source), F.array(F.lit("${SRCS}"), F.concat(F.lit("${DIR}/"), F.first(source)))).alias("sources")).select(F.concat(F.lit(f"{name}-"), "key").alias("name"), "ordinal", folder.alias("defined_in"), "sources")
    hosts = made(p.filter("coalesce(lang, '') <> 'de'"), "host", 1, F.concat("key", F.lit("/CMakeLists.txt")), "rest")
    langs = made(p.filter("lang = 'en'"), "lang", 0, F.lit("CMakeLists.txt"), "path")
    return joins.target_join(pages, hosts.unionByName(langs)).select("page_id", "path", "target")


@query("""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS name FROM benchmark),
tokens AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS token FROM documents)
SELECT 'd' || doc_id AS caller, name AS callee FROM tokens JOIN names ON token = name""")
def edges_by_token(spark, sf):
    names = _t(spark, sf, "benchmark").select(F.explode(X.identifiers(F.col("text"))).alias("name")).distinct()
    docs = _t(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit(None).cast("string").alias("name"), F.col("text").alias("body"))
    return joins.token_edges(docs, names.select(F.col("name").alias("id"), "name"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), n AS (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS e FROM k)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, greatest(coalesce(n.e, 99), l.l_linenumber)::INTEGER AS "end" FROM lineitem l JOIN n USING (l_orderkey, l_linenumber)""")
def span_lead_a(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return ranking.spans_distinct(rows, "l_orderkey", "l_linenumber", F.lit(99)).withColumn("end", F.col("end").cast("int"))


_LINES = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey {_LINES}) - 1, 99)::INTEGER AS "end", (l_linenumber + 1)::INTEGER AS body_start FROM lineitem""")
def span_lead_b(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = _t(spark, sf, "lineitem").select("l_orderkey", *order)
    out = ranking.spans_bodies(rows, "l_orderkey", "l_linenumber", order, F.lit(99))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("end").cast("int").alias("end"), F.col("body_start").cast("int").alias("body_start"))


@query("""SELECT conv_id, turn, greatest(turn, 1)::BIGINT AS start, greatest(coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, 99), turn)::BIGINT AS "end" FROM conversations""")
def span_lead_c(spark, sf):
    rows = _t(spark, sf, "conversations").select("conv_id", "turn")
    out = ranking.spans_blocks(rows, "conv_id", "turn", ["turn"], F.lit(99).cast("long"))
    return out.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS line, event_type FROM events),
defs AS (SELECT DISTINCT user_id, line // 86400000000 * 86400000000 AS lo, line // 86400000000 * 86400000000 + 86399999999 AS hi, 'day' AS def, 1 AS ordinal FROM e
         UNION ALL SELECT DISTINCT user_id, line // 3600000000 * 3600000000, line // 3600000000 * 3600000000 + 3599999999, 'hour', 0 FROM e WHERE event_type = 'click')
SELECT e.user_id AS path, e.event_id::VARCHAR AS ref, e.line, arg_min(d.def, (d.hi - d.lo, d.ordinal)) AS def FROM e JOIN defs d ON d.user_id = e.user_id AND e.line BETWEEN d.lo AND d.hi GROUP BY ALL""")
def innermost_interval(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").cast("string").alias("ref"), F.expr("unix_micros(cast(ts as timestamp))").alias("line"), "event_type")
    day, hour = 86400000000, 3600000000
    lo = lambda n: F.expr(f"line div {n} * {n}")
    days = e.select("path", lo(day).alias("lo")).distinct().withColumn("hi", F.col("lo") + day - 1).withColumn("def", F.lit("day")).withColumn("ordinal", F.lit(1))
    hours = e.filter("event_type = 'click'").select("path", lo(hour).alias("lo")).distinct().withColumn("hi", F.col("lo") + hour - 1).withColumn("def", F.lit("hour")).withColumn("ordinal", F.lit(0))
    return joins.innermost_enclosing(e.drop("event_type"), days.unionByName(hours))


@query("""WITH t AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS name FROM conversations WHERE role = 'user'),
b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS name FROM benchmark)
SELECT name, 'conv:' || conv_id AS anchor FROM t WHERE name IN (SELECT name FROM b)""")
def tests_index(spark, sf):
    tests = _t(spark, sf, "conversations").filter("role = 'user'").select(F.concat(F.lit("conv:"), "conv_id").alias("anchor"), "text")
    names = _t(spark, sf, "benchmark").select(F.explode(X.identifiers(F.col("text"))).alias("name"))
    return joins.tests_of(tests, names)


@query("""SELECT l_orderkey AS caller, l_partkey AS callee, CASE WHEN bool_or(l_returnflag = 'R') THEN 'precise' ELSE 'partial' END AS xref FROM lineitem GROUP BY 1, 2""")
def edge_precedence(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"), "l_returnflag")
    precise = rows.filter("l_returnflag = 'R'").select("caller", "callee", F.lit("precise").alias("xref"))
    return joins.precedence_union(precise, rows.filter("l_returnflag <> 'R'").select("caller", "callee", F.lit("partial").alias("xref")), ["caller", "callee"])


@query("""SELECT l_orderkey AS caller, l_partkey AS callee, 'precise' AS xref FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, l_partkey, 'partial' FROM lineitem l WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_returnflag = 'R' AND p.l_orderkey = l.l_orderkey AND p.l_partkey = l.l_partkey)""")
def edge_precedence_bag(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"), "l_returnflag")
    precise = rows.filter("l_returnflag = 'R'").select("caller", "callee", F.lit("precise").alias("xref"))
    return joins.precedence_union(precise, rows.filter("l_returnflag <> 'R'").select("caller", "callee", F.lit("partial").alias("xref")), ["caller", "callee"], distinct=False)


@query("SELECT o_orderkey, o_custkey::VARCHAR AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def link_integrity(spark, sf):
    symbols = _t(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.concat_ws(":", "c_name", "c_custkey").alias("id"), F.concat(F.lit("customer::"), "c_custkey").alias("name"))
    return joins.dangling(_t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("ref")), symbols).select("o_orderkey", "ref")


_DRIFT = """disk AS (SELECT 'doc/' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'new/' || doc_id, sha256(text) FROM documents WHERE doc_id % 97 = 0), base AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS hash FROM documents),
status AS (SELECT path, CASE WHEN b.hash IS NULL THEN 'new' WHEN d.hash IS NULL THEN 'missing' WHEN b.hash <> d.hash THEN 'stale' ELSE 'fresh' END AS status FROM base b FULL JOIN disk d USING (path))"""


def _drift(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    hashed = lambda d, prefix, text: d.select(F.concat(F.lit(prefix), "doc_id").alias("path"), F.sha2(text.cast("binary"), 256).alias("hash"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    disk = hashed(docs.filter("doc_id % 11 <> 0"), "doc/", changed).unionByName(hashed(docs.filter("doc_id % 97 = 0"), "new/", F.col("text")))
    return hashed(docs, "doc/", F.col("text")), disk


@query(f"WITH {_DRIFT} SELECT path, status FROM status")
def drift_classify(spark, sf):
    return joins.classify_files(*_drift(spark, sf))


@query(f"WITH {_DRIFT} SELECT count(*) FILTER (status <> 'new') AS sampled, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'new') AS new_uncached, round(count(*) FILTER (status = 'fresh') / count(*) FILTER (status <> 'new'), 3) AS fresh_rate FROM status")
def fresh_rate(spark, sf):
    c = joins.classify_files(*_drift(spark, sf))
    n = lambda s: F.count_if(F.col("status") == s)
    sampled = F.count_if(F.col("status") != "new")
    return c.agg(sampled.alias("sampled"), n("stale").alias("stale"), n("missing").alias("missing"), n("new").alias("new_uncached"), F.round(F.try_divide(n("fresh"), sampled), 3).alias("fresh_rate"))


@query("""SELECT DISTINCT l_suppkey AS note, l_orderkey AS path FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def doc_drift(spark, sf):
    return joins.cited_changes(_t(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path")), _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("note"), F.col("l_orderkey").alias("path")))


@query("""WITH names AS (SELECT p_partkey, replace(lower(p_name), '_', '') AS key FROM part), idx AS (SELECT string_agg(text, ' ' ORDER BY item_id) AS t FROM benchmark)
SELECT p_partkey, key FROM names, idx WHERE NOT contains(lower(t), split_part(key, ' ', 1))""")
def index_coverage(spark, sf):
    names = _t(spark, sf, "part").select("p_partkey", X.markdown_key(F.col("p_name")).alias("key")).withColumn("word", F.split("key", " ")[0])
    held = lookups.held(names.select("word"), _t(spark, sf, "benchmark").select(F.lower("text").alias("text")), " ")
    return names.join(held.filter("not held"), "word").select("p_partkey", "key")


_PATHS = "SELECT CASE WHEN doc_id % 50 = 0 THEN doc_id || '.c' ELSE source || '/' || lang || '/' || doc_id END AS path, n_chars AS score FROM documents"


def _paths(spark, sf):
    path = F.when(F.col("doc_id") % 50 == 0, F.concat("doc_id", F.lit(".c"))).otherwise(F.concat_ws("/", "source", "lang", "doc_id"))
    return _t(spark, sf, "documents").select(path.alias("path"), F.col("n_chars").alias("score"))


@query(f"SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS directory, count(*) AS n FROM ({_PATHS}) GROUP BY 1")
def dir_counts(spark, sf):
    return aggregates.directory_counts(_paths(spark, sf))


@query(f"""WITH f AS ({_PATHS}), k AS (SELECT path, score, d AS depth, CASE WHEN NOT contains(path, '/') THEN '(root)' ELSE array_to_string(string_split(path, '/')[1:d], '/') END AS key FROM f, (VALUES (1), (2)) v(d))
SELECT depth, key, count(*) AS n_files, arg_min(path, (-score, path)) AS best, max(score) AS best_score FROM k GROUP BY depth, key""")
def rollup_tree(spark, sf):
    return aggregates.rollup_tree(_paths(spark, sf), 2)


@query("SELECT user_id, count(*) AS churn, arg_max(event_type, (ts, event_type)) AS last_author, max(ts) AS last_modified FROM events GROUP BY user_id")
def churn(spark, sf):
    return aggregates.churn(_t(spark, sf, "events"), "user_id", "ts", "event_type")


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value < 10) AS empties, round(count(*) FILTER (value < 10) / count(*), 3) AS empty_rate FROM events GROUP BY ROLLUP (event_type)")
def access_report(spark, sf):
    return aggregates.access_report(_t(spark, sf, "events").select(F.col("event_type").alias("tool"), (F.col("value") < 10).alias("empty")))


@query("""WITH s AS (SELECT q.vec_id AS query, q.label AS want, e.label AS got, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS r
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0), h AS (SELECT query, want % 3 AS class, bool_or(want = got) AS hit FROM s WHERE r <= 5 GROUP BY ALL)
SELECT class, count(*) AS n, count(*) FILTER (hit) AS hits, coalesce(list(query ORDER BY query) FILTER (NOT hit), []) AS misses, round(count(*) FILTER (hit) / count(*), 3) AS rate FROM h GROUP BY ROLLUP (class)""")
def recall_at_k(spark, sf):
    """The queries are the vectors whose id is divisible by 50; each is compared with all others, in blocks."""
    e = _t(spark, sf, "embeddings")
    vectors_of = lambda d: d.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    near = vectors.nearest_all(vectors_of(e), 5, vectors_of(e.filter("vec_id % 50 = 0")))
    got = near.join(e.select(F.col("vec_id").alias("item"), F.col("label").alias("got")), "item").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("want")), "query")
    return aggregates.recall_report(got.groupBy((F.col("want") % 3).alias("class"), F.col("query").alias("id")).agg(F.bool_or(F.col("want") == F.col("got")).alias("hit")))


@query("""WITH c AS (SELECT list_sort(list(n_chars))[1 + floor(.75 * (count(*) - 1))::BIGINT] AS cut FROM documents)
SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS covered, count(*) AS total FROM documents, c WHERE n_chars >= cut""")
def coverage_quantile(spark, sf):
    return aggregates.coverage(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("importance")), _t(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("""SELECT user_id, event_type, round(n / total, 6) AS confidence FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def majority_vote(spark, sf):
    return aggregates.majority(_t(spark, sf, "events"), "user_id", "event_type")


_PAGE_PATH = "regexp_replace(url, '^[a-z]+://|[?].*$', '', 'g')"
_WORDS = r"list_filter(list_transform(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 2)"


@query(f"""WITH p AS (SELECT page_id AS id, array_to_string(list_filter(string_split({_PAGE_PATH}, '/'), lambda x: x <> '')[1:2], '/') AS theme, {_PAGE_PATH} AS file FROM pages)
SELECT theme, count(DISTINCT id) AS size, list_sort(list(DISTINCT id)) AS evidence, list_sort(list(DISTINCT file))[1:8] AS files FROM p GROUP BY theme HAVING count(DISTINCT id) >= 3""")
def commit_clusters(spark, sf):
    pages = _t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", r"^[a-z]+://|[?].*$", "").alias("file"))
    return aggregates.clusters(pages, X.path_prefix(F.col("file")))


@query(f"""WITH t AS (SELECT split_part({_PAGE_PATH}, '/', 1) AS host, page_id, unnest({_WORDS}) AS token FROM pages), d AS (SELECT host, token, count(DISTINCT page_id) AS df FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY df DESC, token) AS r FROM d) SELECT host, list(token ORDER BY r) AS keywords FROM r WHERE r <= 6 AND df >= 2 GROUP BY host""")
def recurring_keywords(spark, sf):
    words = X.search_tokens(F.regexp_extract("html", "<title>([^<]*)</title>", 1), stop=False)
    host = F.split(F.regexp_replace("url", r"^[a-z]+://|[?].*$", ""), "/")[0]
    return aggregates.recurring_keywords(_t(spark, sf, "pages").select(host.alias("host"), "page_id", F.explode(words).alias("token")), "host", "page_id", "token")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS token FROM documents) GROUP BY token")
def token_frequency(spark, sf):
    return aggregates.token_frequency(_t(spark, sf, "documents"), "text")


@query("SELECT l_orderkey, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber)::INTEGER AS rank FROM lineitem) WHERE rank <= 3")
def top_per_group(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return ranking.top_per_group(rows, ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"], 3).select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query("SELECT o_orderkey, o_totalprice, position, total FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS position, count(*) OVER () AS total FROM orders) WHERE position BETWEEN 26 AND 50")
def page_slice(spark, sf):
    return ranking.page_slice(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], X.decode_cursor(X.encode_cursor(25)), 25)


@query("""WITH l AS (SELECT 0 AS leg, 'part' AS kind, p_name AS name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
UNION ALL SELECT 1, 'supplier', s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) FROM supplier UNION ALL SELECT 2, 'customer', c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) FROM customer)
SELECT kind, name, rank::INTEGER AS rank, leg::INTEGER AS leg FROM l ORDER BY rank, leg LIMIT 25""")
def interleave(spark, sf):
    def leg(table, kind, name, score, key):
        return _t(spark, sf, table).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(score).alias("score"), F.col(key).alias("key"))

    order = [F.desc("score"), "key"]
    legs = [leg("part", "part", "p_name", "p_retailprice", "p_partkey"), leg("supplier", "supplier", "s_name", "s_acctbal", "s_suppkey"), leg("customer", "customer", "c_name", "c_acctbal", "c_custkey")]
    return ranking.interleave([(x, order) for x in legs], 25).select("kind", "name", "rank", "leg")


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_SEARCH = "list_filter(list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN (" + _STOP + "))"
_EMBED = f"""tok AS (SELECT doc_id, unnest({_SEARCH.format('text')}) AS token FROM documents), cnt AS (SELECT doc_id, ('0x' || substr(md5(token), 31, 2))::INTEGER AS bucket, count(*) AS n FROM tok GROUP BY 1, 2),
emb AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)::DOUBLE) AS weight FROM cnt)"""


@query(f"WITH {_EMBED} SELECT doc_id, bucket, round(weight, 6) AS weight FROM emb")
def hash_embed(spark, sf):
    return vectors.embed(_t(spark, sf, "documents"), "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


ASKED = "released under the Apache License version 2"


@query(f"""WITH {_EMBED}, q AS (SELECT ('0x' || substr(md5(w), 31, 2))::INTEGER AS bucket, count(*) AS n FROM (SELECT unnest({_SEARCH.format(f"'{ASKED}'")}) AS w) GROUP BY 1),
s AS (SELECT doc_id, round(sum(weight * q.n) / sqrt((SELECT sum(n * n) FROM q)::DOUBLE), 4) AS score FROM emb JOIN q USING (bucket) GROUP BY doc_id)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5""")
def vector_topk(spark, sf):
    return vectors.top_k(vectors.embed(_t(spark, sf, "documents"), "doc_id", "text"), "doc_id", vectors.query_vector(_t(spark, sf, "documents"), ASKED), 5)


@query(r"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 2))) AS toks FROM documents),
m AS (SELECT doc_id, toks, CASE WHEN len(toks) = 0 THEN '-' || doc_id ELSE array_to_string(toks, ' ') END AS mark FROM t), c AS (SELECT mark, min(doc_id) AS class_id, count(*) AS size, any_value(toks) AS toks FROM m GROUP BY mark),
u AS (SELECT class_id, unnest(toks) AS token FROM c), s AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS n FROM u a JOIN u b ON a.token = b.token AND a.class_id < b.class_id GROUP BY ALL),
p AS (SELECT s.a, s.b FROM s JOIN c x ON x.class_id = s.a JOIN c y ON y.class_id = s.b WHERE round(n / (len(x.toks) + len(y.toks) - n), 6) >= 0.6), l AS (SELECT id, count(*) AS links FROM (SELECT unnest([a, b]) AS id FROM p) GROUP BY id)
SELECT m.doc_id AS id, c.class_id, c.size, coalesce(l.links, 0) AS links FROM m JOIN c USING (mark) LEFT JOIN l ON l.id = c.class_id""")
def near_dup_jaccard(spark, sf):
    """Each document's class of equal token sets, and how many other classes are near duplicates of it."""
    sets = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(X.search_tokens(F.col("text"), stop=False)).alias("tokens"))
    return vectors.similar_classes(sets)


@query(f"""WITH RECURSIVE {_GRAPH}, nodes AS (SELECT caller AS id FROM edges UNION SELECT callee FROM edges), size AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT caller, count(*) AS degree FROM edges GROUP BY caller),
it AS (SELECT 0 AS k, id, 1.0::DOUBLE / (SELECT n FROM size) AS rank FROM nodes
  UNION ALL SELECT k + 1, id, 0.15 / n + 0.85 * (given + loose / n) FROM (
    SELECT it.k, nodes.id, (SELECT n FROM size) AS n, sum(CASE WHEN e.callee IS NOT NULL THEN it.rank / deg.degree ELSE 0 END) AS given, max(l.loose) AS loose
    FROM nodes CROSS JOIN (SELECT k, sum(CASE WHEN d.caller IS NULL THEN rank ELSE 0 END) AS loose FROM it LEFT JOIN deg d ON d.caller = it.id GROUP BY k) l
    JOIN it ON it.k = l.k LEFT JOIN edges e ON e.caller = it.id AND e.callee = nodes.id LEFT JOIN deg ON deg.caller = it.id
    WHERE it.k < 30 AND (e.callee IS NOT NULL OR it.id = nodes.id) GROUP BY it.k, nodes.id) )
SELECT id, round(rank, 6) AS rank FROM it WHERE k = 30""")
def pagerank(spark, sf):
    return graph.pagerank(None, _edges(spark, sf)).select("id", F.round("rank", 6).alias("rank"))


@query(f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT 'r0' AS id, 0 AS depth, NULL::VARCHAR AS via UNION ALL SELECT DISTINCT e.caller, depth + 1, e.callee FROM walk JOIN edges e ON e.callee = walk.id WHERE depth < 3),
m AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) SELECT w.id, w.depth::INTEGER AS depth, min(via) AS via FROM walk w JOIN m ON m.id = w.id AND m.depth = w.depth WHERE w.depth > 0 GROUP BY 1, 2""")
def trace_callers(spark, sf):
    return graph.callers(_edges(spark, sf), spark.createDataFrame([("r0",)], "id string"), 3)


@query(f"""WITH RECURSIVE {_GRAPH}, folded AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0),
walk AS (SELECT 'r' || r_regionkey AS id FROM region UNION SELECT e.caller FROM walk JOIN edges e ON e.callee = walk.id JOIN folded f ON f.id = walk.id) SELECT DISTINCT id FROM walk""")
def dirty_firewall(spark, sf):
    regions = _t(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    nations = _t(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return graph.dirty_set(_edges(spark, sf), regions, regions.unionByName(nations))


RELEVANT = "add small ring economy brand"


def _relevant_sql() -> str:
    raw, tokens = retrieve.query_tokens(RELEVANT)
    words = "list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 2)"
    score = [f"CASE WHEN lower(p_name) = '{t}' THEN 5.0 WHEN list_contains({words}, '{t}') THEN 3.0 ELSE 0 END" for t in raw]
    score += [f"CASE WHEN contains(lower(p_name), '{t}') AND lower(p_name) <> '{t}' AND NOT list_contains({words}, '{t}') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(p_type), '{t}') THEN 1.0 ELSE 0 END" for t in tokens]
    return f"""WITH base AS (SELECT 'p' || p_partkey AS id, ({' + '.join(score)})::DOUBLE AS base, p_retailprice / max(p_retailprice) OVER () AS share FROM part),
lex AS (SELECT id, base + 2 * share AS score, CASE WHEN base >= 5 THEN 'exact' ELSE 'partial' END AS precision FROM base WHERE base > 0),
best AS (SELECT id FROM lex ORDER BY score DESC, id LIMIT 3), near AS (SELECT DISTINCT b.id AS hit, 's' || l_suppkey AS id FROM lineitem JOIN best b ON b.id = 'p' || l_partkey),
five AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY id) AS r FROM near) WHERE r <= 5),
alls AS (SELECT * FROM lex UNION ALL SELECT DISTINCT id, 0.8, 'expanded' FROM five UNION ALL SELECT DISTINCT 'op:' || p_type || ':' || p_size, 4.0, 'op' FROM part WHERE {' OR '.join([f"lower(p_type) = '{t}'" for t in raw] + [f"contains(lower(p_type), '{t}')" for t in tokens])}),
top AS (SELECT id, round(max(score), 6) AS score, arg_max(precision, score) AS precision FROM alls GROUP BY id ORDER BY max(score) DESC, id LIMIT 25)
SELECT top.*, CASE WHEN starts_with(id, 'p') THEN p_brand END AS fold FROM top LEFT JOIN part ON id = 'p' || p_partkey"""


@query(_relevant_sql())
def relevant_parts(spark, sf):
    part = _t(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_retailprice").alias("importance"))
    edges = _t(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("caller"), F.concat(F.lit("s"), "l_suppkey").alias("callee"))
    words = F.filter(F.split(F.lower("name"), " "), lambda w: F.length(w) > 2)
    ops = _t(spark, sf, "part").select(F.col("p_type").alias("op_name"), F.col("p_size").cast("string").alias("version"))
    told = _t(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("fold"), F.col("p_partkey").alias("ordinal"))
    return retrieve.relevant_code(RELEVANT, part, edges, ops, k=25, words=words, summaries=told)


_NEAR = f"""tok AS (SELECT c_name AS id, unnest({_SEARCH.format("c_name || ' ' || c_mktsegment")}) AS token FROM customer), cnt AS (SELECT id, ('0x' || substr(md5(token), 31, 2))::INTEGER AS bucket, count(*) AS n FROM tok GROUP BY 1, 2),
emb AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)::DOUBLE) AS weight FROM cnt), q AS (SELECT ('0x' || substr(md5(w), 31, 2))::INTEGER AS bucket, count(*) AS n FROM (SELECT unnest({_SEARCH.format("'machinery customer 000000042'")}) AS w) GROUP BY 1),
near AS (SELECT id, round(sum(weight * q.n) / sqrt((SELECT sum(n * n) FROM q)::DOUBLE), 4) AS score FROM emb JOIN q USING (bucket) GROUP BY id)"""


@query(f"""WITH {_NEAR} SELECT 'exact' AS branch, c_name AS id, 1.0::DOUBLE AS score FROM customer WHERE lower(c_name) = 'customer#000000042'
UNION ALL SELECT 'ticket', c_name, 1.0 FROM customer WHERE c_custkey = 17 UNION ALL (SELECT 'near', id, score FROM near WHERE score > 0 ORDER BY score DESC, id LIMIT 5)""")
def exact_then_semantic(spark, sf):
    """By name, by ticket, and, as neither is the third query, by nearness."""
    records = _t(spark, sf, "customer").select(F.col("c_name").alias("id"), F.col("c_custkey").cast("string").alias("ticket"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    asked = (("exact", "Customer#000000042"), ("ticket", " 17 "), ("near", "machinery customer 000000042"))
    out = [retrieve.exact_then_semantic(records, q).select(F.lit(kind).alias("branch"), "id", "score") for kind, q in asked]
    return out[0].unionByName(out[1]).unionByName(out[2])


_COMPOSED = """s AS (SELECT doc_id AS id, substr(source, 1, 1 + doc_id % 25) || repeat('x', (doc_id % 25)::INTEGER) AS fold, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'p [L2-4]' END AS preview, 'Does it [L' || n_chars || ']. Plain sentence here. Range [L3-' || (doc_id % 9) || '] x.' AS "full",
  CASE WHEN doc_id % 13 = 0 THEN 'guess' ELSE 'code' END AS evidence_level, 500 AS source_lines FROM documents)"""


def _composed(spark, sf):
    i = F.col("doc_id")
    return _t(spark, sf, "documents").select(
        i.alias("id"), F.expr("concat(substr(source, 1, int(1 + doc_id % 25)), repeat('x', int(doc_id % 25)))").alias("fold"), F.when(i % 5 == 0, "").otherwise("p [L2-4]").alias("preview"),
        F.concat(F.lit("Does it [L"), "n_chars", F.lit("]. Plain sentence here. Range [L3-"), i % 9, F.lit("] x.")).alias("full"), F.when(i % 13 == 0, "guess").otherwise("code").alias("evidence_level"),
        F.array().cast("array<string>").alias("invariants"), F.array().cast("array<string>").alias("known_pitfalls"), F.lit(500).alias("source_lines"),
    )


@query(f"""WITH {_COMPOSED}, r AS (SELECT id, 'missing preview' AS error FROM s WHERE preview = '' UNION ALL SELECT id, 'fold too long' FROM s WHERE length(fold) > 20
UNION ALL SELECT id, 'unknown evidence level guess' FROM s WHERE evidence_level = 'guess'
UNION ALL SELECT id, 'bad line range ' || lo || '-' || hi FROM (SELECT id, unnest([{{'lo': (string_split("full", ']')[1][11:])::INTEGER, 'hi': (string_split("full", ']')[1][11:])::INTEGER}}, {{'lo': 3, 'hi': (id % 9)::INTEGER}}], recursive := true) FROM s) WHERE lo < 1 OR lo > hi OR hi > 500)
SELECT id, error FROM r""")
def lint_errors(spark, sf):
    return _composed(spark, sf).select("id", F.explode(quality.lint_errors()).alias("error"))


@query(f"""WITH {_COMPOSED} SELECT id, list_filter(list_transform(regexp_extract_all("full", '[^.!?]+[.!?]?'), lambda x: trim(x)), lambda x: regexp_matches(x, '\\[L[0-9]+(-[0-9]+)?\\]')) AS claims, len(regexp_extract_all("full" || preview, '\\[L[0-9]+(-[0-9]+)?\\]'))::INTEGER AS n_cites FROM s""")
def citations_claims(spark, sf):
    return _composed(spark, sf).select("id", X.claims(F.col("full")).alias("claims"), F.size(X.citations(F.concat("full", "preview"))).alias("n_cites"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS was, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS now FROM documents)
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'rejected' WHEN now IS NULL OR now <> was THEN 'stale' ELSE 'active' END AS status FROM h""")
def stale_findings(spark, sf):
    base, disk = _drift(spark, sf)
    key = F.substring("path", 5, 1 << 30).cast("long")
    findings = base.select(key.alias("id"), F.when(key % 3 == 0, "rejected").otherwise("active").alias("status"), F.create_map("path", "hash").alias("symbol_span_hashes"))
    return state.mark_stale(findings, disk.select(F.col("path").alias("symbol"), "hash")).select("id", "status")


@query("""WITH r AS (SELECT doc_id, ['draft', 'reviewed', 'battle-tested'][1 + quality] AS held, ['draft', 'reviewed', 'battle-tested', 'gold'][1 + (doc_id % 4)] AS want, CASE WHEN doc_id % 5 > 0 THEN 'me' ELSE ' ' END AS owner, CASE WHEN toxic = 0 AND doc_id % 2 = 0 THEN 'T-1' END AS ticket FROM labels),
p AS (SELECT *, list_position(['draft', 'reviewed', 'battle-tested'], held) AS a, coalesce(list_position(['draft', 'reviewed', 'battle-tested'], want), 0) AS w FROM r),
e AS (SELECT *, CASE WHEN w = 0 THEN 'unknown rung' WHEN w <> a + 1 THEN 'one rung at a time' WHEN trim(owner) = '' THEN 'owner required' WHEN w = 3 AND ticket IS NULL THEN 'ticket required' END AS error FROM p)
SELECT doc_id AS id, CASE WHEN error IS NULL THEN want ELSE held END AS confidence, error FROM e""")
def ladder(spark, sf):
    rungs = F.array(*map(F.lit, (*quality.LADDER, "gold")))
    i = F.col("doc_id")
    req = _t(spark, sf, "labels").select(i.alias("id"), F.element_at(rungs, (F.col("quality") + 1).cast("int")).alias("confidence"), F.element_at(rungs, (i % 4 + 1).cast("int")).alias("to"), F.when(i % 5 > 0, "me").otherwise(" ").alias("owner"), F.when((F.col("toxic") == 0) & (i % 2 == 0), "T-1").alias("ticket"))
    return quality.promote(req).select("id", "confidence", "error")


@query("""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS name FROM benchmark)
SELECT DISTINCT 'd' || doc_id AS caller, token AS callee FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS token FROM documents) WHERE token IN (SELECT name FROM names)""")
def incremental_equals_full(spark, sf):
    names = _t(spark, sf, "benchmark").select(F.explode(X.identifiers(F.col("text"))).alias("name")).distinct().select(F.col("name").alias("id"), "name")
    docs = _t(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat_ws("/", "source", "doc_id").alias("path"), F.lit(None).cast("string").alias("name"), F.col("text").alias("body"), "doc_id")
    before = docs.withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.lit("other Words")).otherwise(F.col("body")))
    symbols = docs.select("id", "path").unionByName(names.select("id", F.lit("names").alias("path")))
    changed = docs.filter("doc_id % 7 = 0").select("path")
    return state.incremental_edges(joins.token_edges(before, names), symbols, changed, lambda dirty: joins.token_edges(docs.join(dirty.select("id"), "id", "left_semi"), names))


@query("""SELECT source AS module, count(*) AS n, sha256(string_agg(chr(0) || text, '' ORDER BY text)) AS hash FROM documents GROUP BY source""")
def module_synthesis_hash(spark, sf):
    return state.synthesis_inputs(_t(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("preview")))


@query("""WITH n AS (SELECT conv_id, turn, text, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, turn) AS e FROM conversations),
h AS (SELECT conv_id, turn, substr(sha256(turn || '-' || e || '|' || text), 1, 12) AS was, CASE WHEN conv_id % 13 = 0 THEN NULL WHEN turn % 3 = 2 THEN substr(sha256(turn || '-' || e || '|' || text || '!'), 1, 12) ELSE substr(sha256(turn || '-' || e || '|' || text), 1, 12) END AS now FROM n)
SELECT conv_id || ':' || turn AS path, CASE WHEN now IS NULL THEN 'missing' ELSE 'stale' END AS status FROM h WHERE now IS NULL OR now <> was""")
def symbol_drift(spark, sf):
    rows = ranking.spans_distinct(_t(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", F.col("turn"))
    hashed = lambda text: F.substring(F.sha2(F.concat(F.concat_ws("-", "turn", "end"), F.lit("|"), text).cast("binary"), 256), 1, 12)
    path = F.concat_ws(":", "conv_id", "turn")
    now = F.when(F.col("turn") % 3 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return joins.classify_files(rows.select(path.alias("path"), hashed(F.col("text")).alias("hash")), rows.filter("conv_id % 13 <> 0").select(path.alias("path"), hashed(now).alias("hash"))).filter("status <> 'fresh'")


@query("SELECT 'doc' || doc_id AS id, round(count(*) FILTER (verdict = 'entailed') / nullif(count(*) FILTER (verdict <> 'no-source'), 0), 6) AS faithfulness, count(*) AS claims FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'no-source' WHEN length(text) % 2 = i % 2 THEN 'entailed' ELSE 'neutral' END AS verdict FROM documents, range(3) r(i)) GROUP BY doc_id")
def faithfulness(spark, sf):
    v = _t(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("id"), F.length("text").alias("n"), "lang", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    verdict = F.when(F.col("lang") == "en", "no-source").when(F.col("n") % 2 == F.col("i") % 2, "entailed").otherwise("neutral")
    return aggregates.faithfulness(v.select("id", verdict.alias("verdict"))).select("id", F.round("faithfulness", 6).alias("faithfulness"), "claims")


from . import lookups as _lookups  # noqa: E402, F401 - registers its queries
