"""Queries of lookups, text rules, findings and reports over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract, graph, joins, lookups, quality, reports, retrieve, state
from .catalog import _COMPOSED, _GRAPH, _composed, _edges, _t, query


def _symbols(spark, sf) -> DataFrame:
    """Parts as symbols: their type is the path, their size the line."""
    own = F.concat(F.lit("p"), "p_partkey")
    return _t(spark, sf, "part").select(own.alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "function").otherwise("field").alias("kind"), F.regexp_replace("p_type", " ", "/").alias("path"), F.col("p_size").alias("line"), F.col("p_brand").alias("signature"), F.col("p_retailprice").alias("importance"), F.col("p_partkey").alias("ordinal"))


_SYMBOLS = "symbols AS (SELECT 'p' || p_partkey AS id, p_name AS name, CASE WHEN p_size > 25 THEN 'function' ELSE 'field' END AS kind, replace(p_type, ' ', '/') AS path, p_size AS line, p_brand AS signature, p_retailprice AS importance, p_partkey AS ordinal FROM part)"


def _summaries(spark, sf) -> DataFrame:
    """Summaries of the larger parts by id, twice, and of brands' paths."""
    s = _symbols(spark, sf)
    told = lambda by, n: (F.lit(by).alias("fold"), F.concat(F.lit(f"{by} "), "name").alias("preview"), F.concat(F.lit("see [L1] and [L2-"), F.col("line").cast("string"), F.lit("].")).alias("full"), F.lit("code").alias("evidence_level"), F.when(F.col("line") > 40, "reviewed").alias("confidence"), F.when(F.col("line") > 30, "symbol").alias("scope"), (F.col("ordinal") * 3 + n).alias("ordinal"))
    none = F.lit(None).cast("string")
    own = s.filter("line > 30")
    return own.select("id", none.alias("path"), *told("old", 0)).unionByName(own.select("id", none.alias("path"), *told("new", 1))).unionByName(s.filter("line < 20").select(F.concat(F.lit("m"), "id").alias("id"), "path", *told("file", 2)))


_SUMMARIES = _SYMBOLS + """, summaries AS (
  SELECT id, NULL AS path, v.fold, v.fold || ' ' || name AS preview, 'see [L1] and [L2-' || line || '].' AS "full", 'code' AS evidence_level, CASE WHEN line > 40 THEN 'reviewed' END AS confidence, CASE WHEN line > 30 THEN 'symbol' END AS scope, ordinal * 3 + v.n AS ordinal
  FROM symbols, (VALUES ('old', 0), ('new', 1)) v(fold, n) WHERE line > 30
  UNION ALL SELECT 'm' || id, path, 'file', 'file ' || name, 'see [L1] and [L2-' || line || '].', 'code', CASE WHEN line > 40 THEN 'reviewed' END, CASE WHEN line > 30 THEN 'symbol' END, ordinal * 3 + 2 FROM symbols WHERE line < 20),
own AS (SELECT id, arg_max({'fold': fold, 'preview': preview, 'evidence_level': evidence_level, 'confidence': confidence, 'scope': scope}, ordinal) AS s FROM summaries GROUP BY id),
near AS (SELECT path, arg_min({'fold': fold, 'preview': preview, 'evidence_level': evidence_level, 'confidence': confidence, 'scope': scope}, ordinal) AS s FROM summaries WHERE path IS NOT NULL GROUP BY path),
described AS (SELECT y.*, coalesce(o.s, n.s) AS s FROM symbols y LEFT JOIN own o ON o.id = y.id LEFT JOIN near n ON n.path = y.path)"""


def _targets(spark, sf) -> DataFrame:
    paths = _symbols(spark, sf).groupBy("signature").agg(F.collect_set("path").alias("sources"), F.min("ordinal").alias("ordinal"))
    return paths.select(F.concat(F.lit("lib"), "signature").alias("name"), F.lit("CMakeLists.txt").alias("defined_in"), F.concat("sources", F.array(F.lit("${SRCS}"))).alias("sources"), "ordinal")


_TARGETS = "firsts AS (SELECT signature, min(ordinal) AS o FROM symbols GROUP BY signature), owner AS (SELECT y.path, arg_min('lib' || y.signature, f.o) AS target FROM symbols y JOIN firsts f USING (signature) GROUP BY y.path)"


@query(f"""WITH {_SUMMARIES}, {_TARGETS} SELECT d.path || ' → ' || d.name AS anchor, d.kind, d.signature, d.importance, d.s.preview AS summary, d.s.scope AS scope, d.s.evidence_level AS evidence_level, d.s.confidence AS confidence, w.target AS build_target
FROM described d LEFT JOIN owner w USING (path) WHERE contains(lower(d.name), 'ring')""")
def symbol_preview(spark, sf):
    return lookups.find_symbol(_symbols(spark, sf), "RING", "preview", _summaries(spark, sf), _targets(spark, sf))


@query(f"WITH {_SUMMARIES} SELECT path || ' → ' || name AS anchor, kind, s.fold AS fold FROM described WHERE contains(lower(name), 'small')")
def symbol_fold(spark, sf):
    return lookups.find_symbol(_symbols(spark, sf), "small", "fold", _summaries(spark, sf))


@query(f"WITH {_SYMBOLS} SELECT * FROM symbols WHERE kind = 'function' ORDER BY importance DESC, path, line, name LIMIT 20")
def top_symbols(spark, sf):
    return lookups.top_symbols(_symbols(spark, sf))


def _ops(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_name").alias("op_name"), F.col("p_size").cast("string").alias("version"), F.col("p_brand").alias("provider"), F.split("p_type", " ")[0].alias("framework"), F.concat(F.lit("k/"), "p_brand").alias("kernel_path"), F.col("p_partkey").alias("line"))


@query("SELECT p_name AS op, p_size::VARCHAR AS version, p_brand AS provider, split_part(p_type, ' ', 1) AS framework, 'k/' || p_brand || ':' || p_partkey AS anchor FROM part WHERE contains(lower(p_name), 'green')")
def op_lookup(spark, sf):
    return lookups.find_op(_ops(spark, sf), "Green")


@query("SELECT 'order' || o_orderkey AS test, c_name AS guards, 'regression' AS kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name = 'Customer#000000009'")
def test_lookup(spark, sf):
    held = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return lookups.find_tests(held.select(F.concat(F.lit("order"), "o_orderkey").alias("test"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("kind")), "crm::Customer#000000009")


_CHURN = "churn AS (SELECT user_id AS path, count(*) AS churn, arg_max(event_type, (ts, event_type)) AS last_author, max(ts)::DATE AS last_modified FROM events GROUP BY user_id)"


def _churned(spark, sf) -> DataFrame:
    from ..operators import aggregates

    log = aggregates.churn(_t(spark, sf, "events"), "user_id", "ts", "event_type").select(F.col("user_id").alias("path"), "churn", "last_author", F.to_date("last_modified").alias("last_modified"))
    people = _t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("path"))
    return lookups.with_churn(people, log)


@query(f"WITH {_CHURN} SELECT 'c' || c_custkey AS id, c_mktsegment AS name, c_custkey AS path, coalesce(churn, 0) AS churn, coalesce(last_author, '') AS last_author, coalesce(last_modified::VARCHAR, '') AS last_modified FROM customer LEFT JOIN churn ON path = c_custkey")
def symbol_churn(spark, sf):
    return _churned(spark, sf)


@query(f"WITH {_CHURN} SELECT c_custkey || ' → ' || c_mktsegment AS anchor, coalesce(churn, 0) AS churn, coalesce(last_author, '') AS last_author, coalesce(last_modified::VARCHAR, '') AS last_modified FROM customer LEFT JOIN churn ON path = c_custkey WHERE c_mktsegment = 'BUILDING'")
def change_lookup(spark, sf):
    return lookups.what_changed(_churned(spark, sf).withColumn("path", F.col("path").cast("string")), "BUILDING")


@query(f"""WITH {_SUMMARIES}, asked AS (SELECT path AS key FROM symbols WHERE ordinal = 1), hit AS (SELECT s.*, 0 AS "by" FROM summaries s, asked WHERE s.path = key UNION ALL SELECT s.*, 1 FROM summaries s, asked WHERE s.id = key)
SELECT arg_min(id, ("by", ordinal)) AS id, arg_min(fold, ("by", ordinal)) AS fold, NULL::VARCHAR AS error FROM hit""")
def summary_lookup(spark, sf):
    key = _symbols(spark, sf).filter("ordinal = 1").first()["path"]
    return lookups.get_summary(_summaries(spark, sf), key).select("id", "fold", "error")


_BUILD = "build AS (SELECT CASE WHEN c_acctbal < 0 THEN 'option' WHEN c_mktsegment = 'BUILDING' THEN 'package' ELSE 'target' END AS kind, c_name AS name, 'exact' AS fidelity, c_mktsegment AS method, c_custkey AS ordinal FROM customer)"


def _build(spark, sf) -> DataFrame:
    kind = F.when(F.col("c_acctbal") < 0, "option").when(F.col("c_mktsegment") == "BUILDING", "package").otherwise("target")
    return _t(spark, sf, "customer").select(kind.alias("kind"), F.col("c_name").alias("name"), F.lit("exact").alias("fidelity"), F.col("c_mktsegment").alias("method"), F.col("c_custkey").alias("ordinal"))


@query(f"WITH {_BUILD} SELECT count(*) FILTER (kind = 'target') AS targets, count(*) FILTER (kind = 'option') AS options, count(*) FILTER (kind = 'package') AS packages, arg_min(fidelity, ordinal) AS fidelity, arg_min(method, ordinal) AS method, list(name ORDER BY ordinal) FILTER (kind = 'target') AS target_names FROM build")
def build_overview(spark, sf):
    return lookups.build_overview(_build(spark, sf))


@query(f"WITH {_BUILD} SELECT * FROM build WHERE contains(lower(name), '00001')")
def build_lookup(spark, sf):
    return lookups.build_info(_build(spark, sf), "00001")


@query(f"""WITH {_SUMMARIES} SELECT id, fold, coalesce(scope, 'file') AS scope, [coalesce(path, '?') || ':L1', coalesce(path, '?') || ':L2' || CASE WHEN split_part(split_part("full", 'L2-', 2), ']', 1)::INTEGER > 2 THEN '-' || split_part(split_part("full", 'L2-', 2), ']', 1) ELSE '' END] AS evidence
FROM summaries WHERE coalesce(confidence, 'draft') = 'draft' AND starts_with(path, 'ECONOMY')""")
def draft_list(spark, sf):
    return lookups.list_drafts(_summaries(spark, sf), "ECONOMY")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS line FROM documents)
SELECT 'doc/' || doc_id AS path, line::INTEGER AS line, text FROM l WHERE regexp_matches(text, '\\bLicense\\b') ORDER BY 1, 2 LIMIT 40""")
def name_references(spark, sf):
    lines = lookups.source_lines(_t(spark, sf, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text"))
    return lookups.references(lines, "License")


@query("SELECT 'src/' || c_mktsegment || CASE WHEN c_acctbal > 5000 THEN '/tests/' ELSE '/' END || c_custkey AS path, 'main function' AS why FROM customer WHERE c_nationkey = 3 AND c_acctbal <= 5000 UNION ALL SELECT 'app/' || p_partkey || '/main.py', 'file name' FROM part WHERE p_size = 7")
def entry_candidates(spark, sf):
    c, p = _t(spark, sf, "customer"), _t(spark, sf, "part")
    path = F.concat(F.lit("src/"), "c_mktsegment", F.when(F.col("c_acctbal") > 5000, "/tests/").otherwise("/"), "c_custkey")
    named = p.select(F.concat(F.lit("app/"), "p_partkey", F.when(F.col("p_size") == 7, "/main.py").otherwise("/other.py")).alias("path"))
    return lookups.entry_points(c.select(path.alias("path"), F.when(F.col("c_nationkey") == 3, "main").otherwise("run").alias("name"), F.lit("function").alias("kind")), named)


@query(f"WITH {_SUMMARIES} SELECT path || ' → ' || name AS anchor, CASE WHEN s IS NULL THEN 'mechanical (L1)' ELSE 'L2 ' || coalesce(s.confidence, 'draft') || ' (' || s.evidence_level || ')' END AS status, importance FROM described WHERE name IN (SELECT name FROM symbols WHERE ordinal = 9) OR id = (SELECT name FROM symbols WHERE ordinal = 9)")
def review_state(spark, sf):
    s = _symbols(spark, sf)
    return lookups.review_status(s, _summaries(spark, sf), s.filter("ordinal = 9").first()["name"])


@query(f"""WITH {_SYMBOLS}, freq AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(name, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS token FROM symbols) GROUP BY 1),
defs AS (SELECT unnest(regexp_extract_all(name, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS name, kind, path, ordinal FROM symbols WHERE kind = 'function'), best AS (SELECT name, min(ordinal) AS ordinal, arg_min(path, ordinal) AS path FROM defs GROUP BY name)
SELECT b.name, n AS score, b.path FROM best b JOIN freq ON token = b.name""")
def best_definition(spark, sf):
    s = _symbols(spark, sf)
    words = s.select(F.explode(F.array_distinct(X.identifiers(F.col("name")))).alias("name"), "kind", "path", "ordinal", F.lit(None).cast("string").alias("scope"))
    frequency = s.select(F.explode(X.identifiers(F.col("name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return lookups.best_definitions(words, frequency, 1 << 30).select("name", "score", "path")


@query("SELECT (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM supplier) AS ops, (SELECT count(*) FROM labels WHERE quality = 1) AS findings")
def table_counts(spark, sf):
    state_of = _t(spark, sf, "labels").withColumn("status", F.when(F.col("quality") == 1, "active").otherwise("stale"))
    return reports.banner(symbols=_t(spark, sf, "part"), ops=_t(spark, sf, "supplier"), findings=state_of)


@query("SELECT source AS directory, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, directory LIMIT 12")
def file_census(spark, sf):
    return reports.file_census(_t(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path")))


@query(f"WITH {_GRAPH} SELECT CASE WHEN caller = 's3' THEN 'callee' ELSE 'caller' END AS direction, CASE WHEN caller = 's3' THEN callee ELSE caller END AS id FROM edges WHERE caller = 's3' OR callee = 's3'")
def adjacency(spark, sf):
    return graph.neighbours(_edges(spark, sf), "s3")


@query(f"WITH {_GRAPH} SELECT callee AS caller, caller AS callee FROM edges")
def reverse_adjacency(spark, sf):
    return graph.reverse_edges(_edges(spark, sf))


@query(f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey = 4 UNION SELECT e.caller FROM walk JOIN edges e ON e.callee = walk.id WHERE starts_with(walk.id, 's'))
SELECT DISTINCT id, CASE WHEN starts_with(id, 's') THEN 'changed' ELSE 'caller' END AS reason FROM walk""")
def rebuild_plan(spark, sf):
    supplier = _t(spark, sf, "supplier")
    symbols = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("nation/"), "s_nationkey").alias("path"))
    changed = supplier.select(F.lit("nation/4").alias("path")).distinct()
    return state.rebuild_plan(symbols, _edges(spark, sf), changed, symbols.select("id"))


@query(f"""WITH {_COMPOSED}, n AS (SELECT id, (string_split("full", ']')[1][11:])::INTEGER AS a, (id % 9)::INTEGER AS b, preview, fold, evidence_level FROM s)
SELECT round(avg((preview <> '' AND length(fold) <= 20 AND evidence_level <> 'guess' AND a BETWEEN 1 AND 500 AND b >= 3)::INTEGER), 6) AS lint_clean_rate FROM n""")
def lint_clean_rate(spark, sf):
    return quality.lint_clean_rate(_composed(spark, sf))


_WORDS4 = r"list_distinct(list_filter(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w)), lambda w: length(w) > 2))"


def _found(spark, sf) -> DataFrame:
    i = F.col("conv_id") * 1000 + F.col("turn")
    return _t(spark, sf, "conversations").select(i.alias("id"), "text", F.when(F.col("role") == "user", "active").otherwise("stale").alias("status"), F.array(F.concat(F.lit("c"), "conv_id")).alias("symbol_ids"), F.timestamp_seconds(i).alias("created_at"), i.alias("ordinal"))


@query(f"SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' AND len(list_intersect({_WORDS4.format('text')}, ['the', 'with', 'that'])) > 0 ORDER BY id LIMIT 25")
def finding_search(spark, sf):
    return state.find_findings(_found(spark, sf), "the WITH that", "active").select("id", "text")


@query("SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' ORDER BY id DESC LIMIT 10")
def finding_newest(spark, sf):
    return state.find_findings(_found(spark, sf), None, "active", limit=10).select("id", "text")


@query("""WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN '  ' WHEN o_orderstatus = 'F' THEN repeat('x', 2001) ELSE 'fine' END AS text, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rumour' ELSE 'gotcha' END AS kind, 'Customer#' || lpad((o_custkey + 100)::VARCHAR, 9, '0') AS ref FROM orders)
SELECT id, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 2000 THEN 'too long' WHEN kind = 'rumour' THEN 'bad kind' END AS error, CASE WHEN ref IN (SELECT c_name FROM customer) THEN [] ELSE [ref] END::VARCHAR[] AS dangling FROM f""")
def finding_checks(spark, sf):
    o = _t(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "  ").when(F.col("o_orderstatus") == "F", F.repeat(F.lit("x"), F.lit(2001))).otherwise("fine")
    ref = F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 100).cast("string"), 9, "0"))
    rows = o.select(F.col("o_orderkey").alias("id"), text.alias("text"), F.when(F.col("o_orderpriority") == "1-URGENT", "rumour").otherwise("gotcha").alias("kind"), F.array(ref).alias("symbol_ids"))
    return state.validate_findings(rows, _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("crm::"), "c_name").alias("name"))).select("id", "error", "dangling")


@query("""WITH f AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'active' ELSE 'stale' END AS status FROM labels)
SELECT id, CASE WHEN status = 'active' THEN 'promoted' ELSE status END AS status, CASE WHEN status = 'active' THEN 'case-from-' || id END AS promoted_case_id, CASE WHEN status <> 'active' THEN 'not active: ' || status END AS error,
'id: case-from-' || id || chr(10) || 'title: TODO' || chr(10) || 'status: draft' || chr(10) || 'summary: >' || chr(10) || '  toxic' || chr(10) || '  text' || chr(10) || 'affected_symbols: ["a\\"b"]' || chr(10) || 'confidence: speculation' AS draft FROM f""")
def finding_promotion(spark, sf):
    f = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "active").otherwise("stale").alias("status"), F.lit("toxic\ntext").alias("text"), F.lit("observation").alias("kind"), F.array(F.lit('a"b')).alias("symbol_ids"))
    out = state.transition(f, "promoted", F.concat(F.lit("case-from-"), "id"))
    return out.select(F.col("id").cast("long").alias("id"), "status", "promoted_case_id", "error", state.case_draft().alias("draft"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS status, max(event_id) AS ordinal FROM events GROUP BY user_id")
def finding_latest(spark, sf):
    return state.latest(_t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("ordinal")))


@query("""WITH i AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents), c AS (SELECT l.doc_id AS id, CASE WHEN toxic = 1 THEN 'other' ELSE sha256(text) END AS hash, lang AS summary, CASE WHEN quality = 1 THEN 'clean' ELSE 'quarantined' END AS status FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT id, summary, status, status IS NOT NULL AS cached FROM i LEFT JOIN c USING (id, hash)""")
def cached_generation(spark, sf):
    d = _t(spark, sf, "documents")
    inputs = d.select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    held = _t(spark, sf, "labels").join(d, "doc_id")
    cache = held.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "other").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"), F.col("lang").alias("summary"), F.when(F.col("quality") == 1, "clean").otherwise("quarantined").alias("status"))
    return state.reuse(inputs, cache).select("id", "summary", "status", "cached")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, contains(lower(c_custkey || ' ' || c_mktsegment || ' ' || c_name), 'build') AS hit FROM customer")
def evalset_hits(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("anchor"), F.lit(None).cast("string").alias("title"), F.col("c_name").alias("name"))
    return retrieve.hits(rows, F.lit("BUILD")).select("id", "name", "hit")


@query("""WITH c AS (SELECT doc_id AS id, CASE WHEN lang = 'en' THEN '' ELSE text END AS source FROM documents)
SELECT id, CASE WHEN source = '' THEN 'no-source' WHEN contains(string_split(source, chr(10))[1], 'la') THEN 'entailed' ELSE 'neutral' END AS verdict FROM c""")
def claim_verdicts(spark, sf):
    claims = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("It says so [L1].").alias("claim"), F.when(F.col("lang") == "en", "").otherwise(F.col("text")).alias("source"))
    judged = quality.unsupported(claims, lambda claim, cited: F.when(cited.contains("la"), "entailed").otherwise("what?"))
    return judged.select("id", "verdict")


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS ls FROM documents)
SELECT doc_id AS id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, ' ') || '| ' || ls[i]), chr(10)) AS numbered,
array_to_string(list_transform(range(2, least(3, len(ls)) + 1), lambda i: i || '| ' || ls[i]), chr(10)) AS cited FROM l""")
def numbered_source(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), X.numbered(F.col("text")).alias("numbered"), X.cited_lines(F.col("text"), X.citations(F.lit("[L2-3]"))).alias("cited"))


@query(r"""SELECT event_id AS id, '{"k"' || split_part(props, '{"k"', 2) AS json, 'src/user' || user_id || '/test_' || event_type || '.cc' AS path, event_type = 'click' OR true AS is_test FROM events""")
def noisy_json(spark, sf):
    e = _t(spark, sf, "events")
    path = F.concat(F.lit("src/user"), "user_id", F.lit("/test_"), "event_type", F.lit(".cc"))
    return e.select(F.col("event_id").alias("id"), X.json_object(F.concat(F.lit("Sure, here: "), "props")).alias("json"), path.alias("path"), X.is_test_file(path).alias("is_test"))


@query("""SELECT o_orderkey AS id, ['src/' || replace(o_orderpriority[3:], ' ', '_') || '/a' || o_custkey || '.c', 'docs/x.md'] AS paths FROM orders""")
def cited_files(spark, sf):
    text = F.concat(F.lit("see `src/"), F.expr("substring(o_orderpriority, 3)"), F.lit("/a"), "o_custkey", F.lit(".c:L3-9` or `docs/x.md#top`, not `word` or `a b/c`"))
    o = _t(spark, sf, "orders").withColumn("o_orderpriority", F.regexp_replace("o_orderpriority", " ", "_"))
    return o.select(F.col("o_orderkey").alias("id"), X.cited_paths(text).alias("paths"))


@query("""SELECT doc_id AS id, length(text) - length(replace(text, ' ', '')) AS n, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 2))) AS tokens FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')""")
def memory_words(spark, sf):
    d = _t(spark, sf, "documents").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return d.select(F.col("doc_id").alias("id"), (F.length("text") - F.length(F.translate("text", " ", ""))).cast("long").alias("n"), F.array_sort(X.memory_tokens(F.col("text"))).alias("tokens"))


def _sources(spark, sf) -> DataFrame:
    """Two test files an order: a text with registrations over two lines and a test."""
    o = _t(spark, sf, "orders")
    text = F.concat(F.lit("// order\nONNX_CPU_OPERATOR_KERNEL(\n  Add"), "o_custkey", F.lit(",\n  "), "o_orderkey", F.lit(")\nTEST_F(Suite"), "o_custkey", F.lit(", Works) { Add"), "o_custkey", F.lit("(); }\nTEST(Other, Case)\nEXECUTORCH_LIBRARY(ns, \"my_op.out\", f)\n"))
    return o.select(F.concat(F.lit("t/test_"), "o_orderkey", F.lit(".cc")).alias("path"), text.alias("text"))


@query("""SELECT 'Add' || o_custkey AS op_name, 'kCpuExecutionProvider' AS provider, 'kOnnxDomain' AS domain, o_orderkey::VARCHAR AS version, 'ONNX_CPU_OPERATOR_KERNEL' AS macro, 'onnxruntime' AS framework, 't/test_' || o_orderkey || '.cc' AS kernel_path, 2::BIGINT AS line FROM orders
UNION ALL SELECT 'my_op.out', 'executorch', 'ns', '', 'EXECUTORCH_LIBRARY', 'executorch', 't/test_' || o_orderkey || '.cc', 7 FROM orders""")
def registrations(spark, sf):
    return extract.extract_ops(_sources(spark, sf))


@query("SELECT 'Add' || o_custkey AS name, 't/test_' || o_orderkey || '.cc::Suite' || o_custkey || '.Works' AS test, 't/test_' || o_orderkey || '.cc' AS path, 'regression' AS kind FROM orders")
def test_macros(spark, sf):
    ops = _t(spark, sf, "customer").select(F.concat(F.lit("Add"), "c_custkey").alias("op_name"))
    none = _symbols(spark, sf).filter("false")
    return extract.extract_tests(_sources(spark, sf), none, ops)


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 3 END AS lo, CASE WHEN s_acctbal > 5000 THEN 1 ELSE s_nationkey END AS hi FROM supplier""")
def precise_spans(spark, sf):
    from ..sources import files

    r = F.when(F.col("s_acctbal") > 5000, F.array(F.lit(1), F.lit(2), F.lit(9))).otherwise(F.array(F.lit(3), F.lit(0), F.col("s_nationkey"), F.lit(4)))
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), files.span(r)[0].alias("lo"), files.span(r)[1].alias("hi"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS dep FROM lineitem), t AS (SELECT s_suppkey, 'lib' || s_nationkey AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
d AS (SELECT 'lib' || (s - 1) AS name, list_sort(list(dep)) AS deps FROM l WHERE s <= 40 GROUP BY s)
SELECT name, CASE WHEN t.name IS NULL THEN 'unknown' ELSE 'static' END AS type, CASE WHEN coalesce(n, 1) = 1 THEN coalesce(deps, []) ELSE [] END AS deps FROM t FULL JOIN d USING (name)""")
def dependency_merge(spark, sf):
    targets = _t(spark, sf, "supplier").select(F.concat(F.lit("lib"), "s_nationkey").alias("name"), F.lit("static").alias("type"), F.col("s_suppkey").alias("ordinal"))
    links = _t(spark, sf, "lineitem").filter("l_suppkey <= 40").select(F.concat(F.lit("lib"), F.col("l_suppkey") - 1).alias("name"), F.col("l_returnflag").alias("dep"))
    return joins.merge_dependencies(targets, links)


@query("""WITH k AS (SELECT c_custkey::VARCHAR AS id, (contains(t, 'building')::INTEGER + contains(t, 'fixtures')::INTEGER)::DOUBLE AS score FROM (SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS t FROM customer))
SELECT id, score FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 3""")
def keyword_fallback(spark, sf):
    records = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    return retrieve.keyword_overlap(records, "Building FIXTURES")


@query("""WITH l AS (SELECT 'part' AS kind, p_partkey::VARCHAR AS id, p_retailprice AS score, 0 AS leg, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey::VARCHAR) AS rank FROM part UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_nationkey, 1, row_number() OVER (ORDER BY n_nationkey DESC, n_nationkey::VARCHAR) FROM nation
UNION ALL SELECT 'region', r_regionkey::VARCHAR, r_regionkey, 2, row_number() OVER (ORDER BY r_regionkey DESC) FROM region) SELECT kind, id, score::DOUBLE AS score, rank::INTEGER AS rank, leg::INTEGER AS leg FROM l ORDER BY rank, leg LIMIT 20""")
def semantic_search(spark, sf):
    order = [F.desc("score"), "id"]
    leg = lambda table, key, score: (_t(spark, sf, table).select(F.col(key).cast("string").alias("id"), F.col(score).cast("double").alias("score")), order)
    return retrieve.search_semantic([("part", *leg("part", "p_partkey", "p_retailprice")), ("nation", *leg("nation", "n_nationkey", "n_nationkey")), ("region", *leg("region", "r_regionkey", "r_regionkey"))], 20)


@query("""WITH f AS (SELECT conv_id, list(text ORDER BY turn) AS ls FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations) GROUP BY conv_id),
s AS (SELECT conv_id, unnest(range(1, len(ls) + 1)) AS line, ls FROM f)
SELECT 'c' || conv_id || ':' || line AS id, CASE WHEN conv_id % 13 = 0 THEN 'file_missing' ELSE 'span_changed' END AS reason FROM s WHERE conv_id % 13 = 0 OR line = 2""")
def span_drift(spark, sf):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    lines = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", flat.alias("x")))), lambda t: t["x"]).alias("ls"))
    files = lines.select(F.concat(F.lit("c"), "conv_id").alias("path"), "conv_id", F.array_join("ls", "\n").alias("text"), F.size("ls").alias("n"))
    symbols = files.select("path", F.explode(F.sequence(F.lit(1), "n")).alias("line")).withColumn("id", F.concat_ws(":", "path", F.col("line").cast("string")))
    stored = symbols.join(state.span_hashes(symbols, files).select("id", F.col("hash").alias("span_hash")), "id")
    edited = F.regexp_replace("text", "^([^\n]*\n)([^\n]*)", "$1$2!")
    return state.symbol_drift(stored, files.filter("conv_id % 13 <> 0").select("path", edited.alias("text")))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT vec_id, list_transform(range(1, 65), lambda i: e[i] + e[65 - i]) AS s FROM v)
SELECT vec_id AS id, round(s[1] / sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) AS first, round(s[40] / sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) AS fortieth FROM m""")
def pooled_vectors(spark, sf):
    from ..operators import vectors

    e = _t(spark, sf, "embeddings")
    rows = F.array("embedding", F.reverse("embedding"), F.transform("embedding", lambda x: x * 100))
    pooled = e.select(F.col("vec_id").alias("id"), vectors.mean_pool(rows, F.array(F.lit(1), F.lit(1), F.lit(0))).alias("v"))
    return pooled.select("id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 40), 6).alias("fortieth"))


@query()
def camel_names(spark, sf):
    """Words of camel-case names; the pattern looks ahead, which the SQL engine's patterns can't."""
    name = F.concat(F.initcap(F.col("p_name")), F.lit("HTTPServer2go"))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.camel_words(F.regexp_replace(name, " ", "")).alias("words"))


@query()
def word_pieces(spark, sf):
    """Pieces of the documents' words, of a vocabulary of syllables."""
    vocabulary = {"the", "and", "##ing", "th", "er", "##er", "##th", "in", "##in", "re", "##re", "on", "##on", "##ed", "an", "##an", "a", "##a", "o", "##o", "h", "##h", "e", "##e", ".", ","}
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.wordpiece(vocabulary)("text").alias("pieces"))


@query()
def seeded_sample(spark, sf):
    """A sample of documents, the same each time; the hash is Spark's own."""
    return lookups.sample(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 50, 7)
