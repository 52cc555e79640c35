"""The operators on tables: one query for each, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import derive, evolve, graph, infer, propose, query, validate
from ..operators.query import effective
from ..operators.schema import Field, LinkRule, Links, Rule, Schema, diff
from ..sources.records import link, lift

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def key(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def orders(spark, d, fields=("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")) -> DataFrame:
    """Orders as index records O<key>/README.md."""
    return lift(t(spark, d, "orders"), F.concat(key("O", "o_orderkey"), F.lit("/README.md")), list(fields), order=F.col("o_orderkey"))


def lines(spark, d, fields=("l_quantity", "l_returnflag", "l_linestatus")) -> DataFrame:
    """Line items as records O<key>/L<number>.md. Line numbers repeat, so the part key tells lines apart."""
    path = F.concat(key("O", "l_orderkey"), key("/L", "l_linenumber"), key("-", "l_partkey"), key("-", "l_suppkey"), F.lit(".md"))
    return lift(t(spark, d, "lineitem"), path, list(fields))


def labelled(spark, d, body: bool = False) -> DataFrame:
    """Documents at <lang>/<source>/D<id>.md, with labels as metadata where there are any."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    path = F.concat("lang", F.lit("/"), "source", key("/D", "doc_id"), F.lit(".md"))
    return lift(docs, path, ["doc_id", "lang", "source", "n_chars", "quality", "toxic"], body=F.col("text") if body else None, order=F.col("doc_id"))


def num(name: str, kind: str = "bigint"):
    return effective(name)["num"].cast(kind).alias(name)


def text(name: str):
    return effective(name)["text"].alias(name)


# ---- filters


@registered("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def where_eq_and(spark, d):
    out = query.where(orders(spark, d), 'o_orderstatus == "F" && o_totalprice > 1000')
    return out.select(num("o_orderkey"), text("o_orderstatus"), num("o_totalprice", "double"))


@registered("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus IN ('O')")
def where_in(spark, d):
    out = query.where(orders(spark, d), 'o_orderpriority in ["1-URGENT", "2-HIGH"]', 'o_orderstatus not in ["O"]')
    return out.select(num("o_orderkey"), text("o_orderpriority"))


@registered("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND NOT contains(p_type, 'ECONOMY') AND p_size % 2 = 1")
def where_contains(spark, d):
    parts = lift(t(spark, d, "part"), key("P", "p_partkey"), ["p_partkey", "p_name", "p_type", "p_size"])
    return query.where(parts, 'p_name contains "a"', '!(p_type contains "ECONOMY")', "p_size % 2 == 1").select(num("p_partkey"), text("p_name"))


@registered("SELECT d.doc_id FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND lang <> 'en'")
def where_nil(spark, d):
    return query.where(labelled(spark, d), 'quality == nil and lang != "en"').select(num("doc_id"))


@registered("SELECT d.doc_id FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality > 0 OR n_chars < 500")
def where_or_order_nil(spark, d):
    return query.where(labelled(spark, d), "quality > 0 || n_chars < 500").select(num("doc_id"))


@registered("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderpriority NOT LIKE '1%'")
def where_type_mismatch(spark, d):
    return query.where(orders(spark, d), 'o_orderkey != "5"', "o_orderstatus != 1", "o_orderkey % 5 == 0", 'not (o_orderpriority startsWith "1")').select(num("o_orderkey"))


@registered("SELECT d.doc_id FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
def cond_ne_missing(spark, d):
    return labelled(spark, d).filter(query.condition({"op": "ne", "field": "quality", "value": 1})).select(num("doc_id"))


@registered("SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND source IN ('src1', 'src2')")
def cond_exists_in(spark, d):
    tree = {"op": "and", "conditions": [{"op": "exists", "field": "quality"}, {"op": "in", "field": "source", "values": ["src1", "src2"]}]}
    return labelled(spark, d).filter(query.condition(tree)).select(num("doc_id"))


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AND event_type <> 'view'")
def dynamic_field_where(spark, d):
    ev = t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return query.where(lift(ev, key("E", "event_id"), ["event_id", "event_type", "k"]), 'k >= 50 && event_type != "view"').select(num("event_id"), num("k"))


# ---- sort, limit, projection, counts


@registered("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 100")
def sort_enum_limit(spark, d):
    out = query.sort(orders(spark, d), "o_orderpriority:asc,o_totalprice:desc", enums={"o_orderpriority": ["5-LOW", "1-URGENT"]})
    return out.limit(100).select(num("o_orderkey"), text("o_orderpriority"))


@registered("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, n_chars ASC, d.doc_id LIMIT 250")
def sort_nulls_last_desc(spark, d):
    return query.sort(labelled(spark, d), "quality:desc, n_chars").limit(250).select(num("doc_id"), num("quality"))


@registered("SELECT 'O' || o_orderkey || '/README.md' AS path, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice < 50000")
def select_project(spark, d):
    return query.select(query.where(orders(spark, d), "o_totalprice < 50000"), ["path", "o_orderstatus", "o_orderpriority"])


@registered("SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS value FROM orders")
def select_jsonl(spark, d):
    return query.select_json(orders(spark, d), ["o_orderkey", "o_orderstatus", "nothing"])


@registered("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def count_matching(spark, d):
    return query.where(orders(spark, d), 'o_orderstatus == "P"').agg(F.count("*").alias("n"))


@registered("SELECT count(*) AS total FROM documents")
def stats_total(spark, d):
    return labelled(spark, d).agg(F.count("*").alias("total"))


# ---- derived values


@registered("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, p_brand || ':' || p_size AS tag, upper(p_type) AS loud FROM part")
def derive_text(spark, d):
    parts = lift(t(spark, d, "part"), key("P", "p_partkey"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    out = derive.derive(parts, {"slug": "slugify(p_name)", "tag": 'concat(p_brand, ":", p_size)', "loud": "upper(p_type)", "bad": "slugify(1)"})
    return out.select(num("p_partkey"), text("slug"), text("tag"), text("loud"))


@registered("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS size FROM documents")
def derive_bytes(spark, d):
    docs = lift(t(spark, d, "documents"), key("D", "doc_id"), ["doc_id", "text"])
    return derive.derive(docs, {"bytes": "strlen(text)", "size": 'len(text) > 2000 ? "long" : "short"'}).select(num("doc_id"), num("bytes"), text("size"))


@registered("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) - 1 AS siblings, bool_and(role <> 'system') OVER (PARTITION BY conv_id) AS no_system FROM conversations")
def derive_siblings(spark, d):
    recs = lift(t(spark, d, "conversations"), F.concat(key("C", "conv_id"), key("/", "turn"), F.lit(".md")), ["conv_id", "turn", "role"])
    out = derive.derive(recs, {"siblings": "len(children)", "no_system": 'all(children, {.role != "system"}) && role != "system"'})
    return out.select(num("conv_id"), num("turn"), num("siblings"), effective("no_system")["bool"].alias("no_system"))


def order_links(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    o = t(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    links = F.transform(F.coalesce("parts", F.array().cast("array<bigint>")), lambda p: link(F.concat(F.lit("P"), p.cast("string")), "uses"))
    left = lift(o, key("O", "o_orderkey"), ["o_orderkey"], links=links)
    return left.unionByName(lift(t(spark, d, "part"), key("P", "p_partkey"), ["p_size"]))


@registered("""SELECT o_orderkey, coalesce(bool_and(p_size > 5), true) AS all_large, coalesce(bool_or(p_size = 50), false) AS any_50, count(p_partkey) AS n
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def linked_values_all(spark, d):
    recs = derive.linked_values(order_links(spark, d), "sizes", "uses", "p_size").withColumn("linked_sizes", F.coalesce("linked_sizes", F.array().cast("array<string>")))
    out = derive.derive(recs, {"all_large": 'all(sizes, {int(#) > 5})', "any_50": 'any(sizes, {# == "50"})', "n": "len(sizes)"}, linked={"sizes"})
    return query.where(out, "o_orderkey != nil").select(num("o_orderkey"), effective("all_large")["bool"].alias("all_large"), effective("any_50")["bool"].alias("any_50"), num("n"))


# ---- roll-ups


@registered("""SELECT o_orderkey, count(l_orderkey) AS lines, count(l_orderkey) FILTER (l_linestatus = 'F') AS done, coalesce(bool_and(l_linestatus = 'F'), true) AS finished,
  coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def rollup_counts(spark, d):
    recs = orders(spark, d).unionByName(lines(spark, d))
    rules = {"lines": "len(descendants)", "done": 'len(filter(descendants, {.l_linestatus == "F"}))', "finished": 'all(descendants, {.l_linestatus == "F"})', "quantity": "sum(descendants, {.l_quantity})"}
    rules["quantity"] = "sum(map(descendants, {.l_quantity}))"
    out = derive.rollup(recs, rules).filter(F.col("base") == "README.md")
    return out.select(num("o_orderkey"), num("lines"), num("done"), effective("finished")["bool"].alias("finished"), num("quantity", "double"))


@registered("""SELECT o_orderkey, CASE WHEN bool_and(l_linestatus = 'F') OR count(l_orderkey) = 0 THEN 'done' WHEN bool_or(l_linestatus = 'F') THEN 'partial' ELSE 'open' END AS state
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def rollup_status(spark, d):
    rule = 'all(descendants, {.l_linestatus == "F"}) ? "done" : any(descendants, {.l_linestatus == "F"}) ? "partial" : "open"'
    return derive.rollup(orders(spark, d).unionByName(lines(spark, d)), {"state": rule}).filter(F.col("base") == "README.md").select(num("o_orderkey"), text("state"))


def geography(spark, d) -> DataFrame:
    """Customers below nations below regions, with an index record in each."""
    r, n, c = (t(spark, d, x) for x in ("region", "nation", "customer"))
    rn = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    recs = lift(r, F.concat("r_name", F.lit("/README.md")), ["r_name"])
    recs = recs.unionByName(lift(rn, F.concat("r_name", F.lit("/"), "n_name", F.lit("/README.md")), ["n_name"]))
    cust = c.join(F.broadcast(rn), c.c_nationkey == rn.n_nationkey)
    return recs.unionByName(lift(cust, F.concat("r_name", F.lit("/"), "n_name", key("/C", "c_custkey"), F.lit(".md")), ["c_custkey", "c_acctbal", "c_mktsegment"]))


GEO = "FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey"


@registered(f"""SELECT r_name || '/' || n_name AS dir, count(c_custkey) AS customers, count(c_custkey) FILTER (c_acctbal < 0) AS negative {GEO} GROUP BY ALL
UNION ALL SELECT r_name, count(c_custkey), count(c_custkey) FILTER (c_acctbal < 0) {GEO} GROUP BY ALL""")
def rollup_multilevel(spark, d):
    out = derive.rollup(geography(spark, d), {"customers": "len(descendants)", "negative": "count(descendants, {.c_acctbal < 0})"}).filter(F.col("base") == "README.md")
    return out.select("dir", num("customers"), num("negative"))


@registered("SELECT r_name AS dir, count(DISTINCT n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def rollup_over_children(spark, d):
    recs = geography(spark, d).filter(F.col("base") == "README.md")
    return derive.rollup_children(recs, {"nations": "len(children)"}).filter("depth = 2").select("dir", num("nations"))


@registered(f"""SELECT r_name || '/' || n_name AS dir, count(c_custkey) + 1 AS total {GEO} GROUP BY ALL
UNION ALL SELECT r_name, count(c_custkey) + count(DISTINCT n_nationkey) + 1 {GEO} GROUP BY r_name
UNION ALL SELECT '', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)""")
def tree_totals(spark, d):
    return derive.tree_totals(geography(spark, d))


# ---- graph


def nation_graph(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    nodes = lift(c, key("C", "c_custkey"), ["c_custkey", "c_mktsegment"], links=F.array(link(key("N", "c_nationkey"), "lives_in")))
    nodes = nodes.unionByName(lift(n, key("N", "n_nationkey"), ["n_nationkey", "n_name", "n_regionkey"]))
    return nodes, graph.edges(nodes)


@registered("SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING'")
def traverse_has_outbound(spark, d):
    nodes, e = nation_graph(spark, d)
    got = query.traverse(query.where(nodes, 'c_mktsegment == "BUILDING"'), nodes, e, outbound="n_regionkey == 1", edge_type="lives_in")
    return got.select(num("c_custkey"))


@registered("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY')")
def traverse_has_inbound(spark, d):
    nodes, e = nation_graph(spark, d)
    return query.traverse(query.where(nodes, "n_nationkey != nil"), nodes, e, inbound='c_mktsegment == "MACHINERY"').select(num("n_nationkey"))


@registered("SELECT 'C' || conv_id || '/' || turn AS source, 'C' || conv_id || '/' || (turn + 1) AS target FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn + 1)")
def graph_broken(spark, d):
    c = t(spark, d, "conversations").dropDuplicates(["conv_id", "turn"])
    recs = lift(c, F.concat(key("C", "conv_id"), key("/", "turn")), ["role"], links=F.array(link(F.concat(key("C", "conv_id"), F.lit("/"), (F.col("turn") + 1).cast("string")), "next")))
    return graph.broken(graph.edges(recs), recs).select("source", "target")


@registered("""SELECT word AS target, CAST(rank AS INTEGER) AS rank, n_name AS suggestion FROM (
  SELECT word, n_name, row_number() OVER (PARTITION BY word ORDER BY levenshtein(lower(word), lower(n_name)), n_name) AS rank FROM (
    SELECT DISTINCT reverse(substr(reverse(n_name), 2)) || 'X' AS word FROM nation) CROSS JOIN nation
  WHERE levenshtein(lower(word), lower(n_name)) <= greatest(2, length(word) // 3)) WHERE rank <= 3""")
def graph_suggest_top3(spark, d):
    n = t(spark, d, "nation")
    bad = n.select(F.lit("x").alias("source"), F.concat(F.expr("substr(n_name, 1, length(n_name) - 1)"), F.lit("X")).alias("target")).distinct()
    return graph.suggestions(bad, n.select(F.col("n_name").alias("name"))).select("target", "rank", "suggestion")


def ring(spark, d):
    n = t(spark, d, "nation")
    return n.select(key("N", "n_nationkey").alias("source"), F.concat(F.lit("N"), ((F.col("n_nationkey") * 7) % 25).cast("string")).alias("target"), F.lit("next").alias("type"))


@registered("SELECT 'N' || n_nationkey AS source, 'N' || (n_nationkey * 7) % 25 AS target FROM nation WHERE (((n_nationkey * 7) % 25) * 7) % 25 <> n_nationkey")
def graph_back_refs(spark, d):
    return graph.missing_back_references(ring(spark, d)).select("source", "target")


@registered("""WITH RECURSIVE r AS (SELECT 1 AS node, 0 AS depth UNION ALL SELECT (node * 7) % 25, depth + 1 FROM r WHERE depth < 3)
SELECT 'N' || node AS node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def graph_trace_depth(spark, d):
    starts = spark.createDataFrame([("N1",)], "node string")
    return graph.trace(ring(spark, d), starts, depth=3).select("node", "depth")


@registered("""WITH RECURSIVE r AS (SELECT n_nationkey AS s, (n_nationkey * 7) % 25 AS node, 1 AS depth FROM nation UNION ALL SELECT s, (node * 7) % 25, depth + 1 FROM r WHERE depth < 25)
SELECT DISTINCT 'N' || s AS node FROM r WHERE s = node""")
def graph_cycle_members(spark, d):
    return graph.cycle_members(ring(spark, d))


@registered("SELECT 'docs/N' || n_nationkey || '.md' AS source, CASE WHEN n_nationkey % 3 = 0 THEN 'docs/N' || n_regionkey || '.md' WHEN n_nationkey % 3 = 1 THEN 'docs/N' || n_regionkey || '.md' ELSE NULL END AS \"to\" FROM nation")
def graph_resolve(spark, d):
    n = t(spark, d, "nation")
    k = F.col("n_nationkey") % 3
    target = F.when(k == 0, key("N", "n_regionkey")).when(k == 1, F.concat(F.lit("/docs/x/../N"), F.col("n_regionkey").cast("string"))).otherwise(F.lit("../../out"))
    recs = lift(n, F.concat(F.lit("docs/"), key("N", "n_nationkey"), F.lit(".md")), ["n_name"], links=F.array(link(target, "in")))
    return graph.resolve(graph.edges(recs), recs).select("source", "to")


# ---- validation


@registered("""SELECT 'N' || n_nationkey AS source, CASE n_nationkey % 4 WHEN 0 THEN 'link_resolve' WHEN 1 THEN 'link_encoding' WHEN 2 THEN 'link_anchor' END AS rule
FROM nation WHERE n_nationkey % 4 < 3 UNION ALL SELECT 'N' || n_nationkey, 'link_resolve' FROM nation WHERE n_nationkey % 4 = 1""")
def validate_link_checks(spark, d):
    """A target that is missing, one with a space that is missing too, an anchor that no heading has, and a good link."""
    k = F.col("n_nationkey") % 4
    target = F.when(k == 0, F.lit("gone")).when(k == 1, F.lit("N 1")).otherwise(key("N", "n_nationkey"))
    recs = lift(t(spark, d, "nation"), key("N", "n_nationkey"), ["n_name"], links=F.array(link(target, "in").withField("anchor", F.when(k == 2, F.lit("no-heading")).otherwise(F.lit("")))))
    return validate.link_checks(recs, Links(checks={"anchors": True, "encoding": True}), recs.select("path")).select(F.col("path").alias("source"), "rule")


@registered("""SELECT p_partkey, 'p_type' AS field, 'enum' AS rule FROM part WHERE p_size > 25 AND p_type <> 'PROMO' UNION ALL
SELECT p_partkey, 'missing', 'required' FROM part WHERE p_size <= 25""")
def validate_match_filters(spark, d):
    """A field that holds below one directory only, and one that is required below the other only."""
    folder = F.when(F.col("p_size") > 25, F.lit("large/P")).otherwise(F.lit("small/P"))
    recs = lift(t(spark, d, "part"), F.concat(folder, F.col("p_partkey").cast("string")), ["p_partkey", "p_type"])
    s = Schema(fields={"p_type": Field("enum", values=("PROMO",), match=("large",)), "missing": Field("string", required=True, required_match=("small",))})
    return validate.violations(recs, s).select(F.regexp_extract("path", r"P(\d+)", 1).cast("bigint").alias("p_partkey"), "field", "rule")


DOC_SCHEMA = Schema(
    fields={
        "quality": Field("integer", required=True), "lang": Field("enum", values=("en", "fr", "de")), "source": Field("sequence", prefix="src", digits=2),
        "n_chars": Field("string", severity="warn"),
    },
    validate=(Rule("toxic", "requires", (("lang", "de"),), ("toxic",)), Rule("source", "non_empty"), Rule("quality", "exists", severity="warn")),
)
VIOLATIONS = """
SELECT doc_id, 'quality' AS field, 'required' AS rule, 'error' AS severity FROM d WHERE quality IS NULL
UNION ALL SELECT doc_id, 'quality', 'exists', 'warn' FROM d WHERE quality IS NULL
UNION ALL SELECT doc_id, 'lang', 'enum', 'error' FROM d WHERE lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT doc_id, 'source', 'sequence-format', 'error' FROM d WHERE NOT regexp_full_match(source, 'src[0-9]{2}')
UNION ALL SELECT doc_id, 'n_chars', 'type', 'warn' FROM d
UNION ALL SELECT doc_id, 'toxic', 'requires', 'error' FROM d WHERE lang = 'de' AND toxic IS NULL
UNION ALL SELECT doc_id, 'source', 'non_empty', 'error' FROM d WHERE source IS NULL OR source = ''"""
DOCS = "WITH d AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@registered(DOCS + VIOLATIONS)
def validate_rules(spark, d):
    got = validate.violations(labelled(spark, d), DOC_SCHEMA)
    return got.select(F.regexp_extract("path", r"D(\d+)\.md$", 1).cast("bigint").alias("doc_id"), "field", "rule", "severity")


@registered(DOCS + f""", v AS ({VIOLATIONS}), r AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w FROM v GROUP BY doc_id),
a AS (SELECT coalesce(e, 0) AS e, coalesce(w, 0) AS w FROM d LEFT JOIN r USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (e = 0) AS valid, count(*) FILTER (e > 0) AS invalid, count(*) FILTER (w > 0) AS with_warnings, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS warnings FROM a""")
def validate_summary(spark, d):
    recs = labelled(spark, d)
    return validate.summary(validate.results(recs, validate.violations(recs, DOC_SCHEMA)))


@registered("SELECT 'C' || c_custkey AS path, CASE WHEN c_nationkey > 20 THEN 'link_type' ELSE 'link_target' END AS rule FROM customer WHERE c_nationkey > 20 OR c_nationkey < 10")
def validate_links(spark, d):
    c = t(spark, d, "customer")
    target = key("N", "c_nationkey")
    links = F.array(F.when(F.col("c_nationkey") > 20, link(target, "odd")).otherwise(link(target, "lives_in")))
    s = Schema(links=Links(allowed=("lives_in",), rules={"lives_in": LinkRule(target="^N[0-9]{2}$")}))
    return validate.violations(lift(c, key("C", "c_custkey"), ["c_custkey"], links=links), s).select("path", "rule")


LINE_STATES = "SELECT l_orderkey, min(l_linestatus) AS low, max(l_linestatus) AS high FROM lineitem GROUP BY l_orderkey"


@registered(f"SELECT 'O' || o_orderkey AS dir, o_orderstatus AS parent, low AS children FROM orders JOIN ({LINE_STATES}) ON l_orderkey = o_orderkey WHERE low = high AND low <> o_orderstatus")
def drift_unanimous(spark, d):
    o = lift(t(spark, d, "orders"), F.concat(key("O", "o_orderkey"), F.lit("/README.md")), {"status": "o_orderstatus"})
    li = t(spark, d, "lineitem").withColumnRenamed("l_linestatus", "status")
    path = F.concat(key("O", "l_orderkey"), key("/L", "l_linenumber"), key("-", "l_partkey"), key("-", "l_suppkey"), F.lit(".md"))
    return validate.drift(o.unionByName(lift(li, path, ["status"])), ["status"]).select("dir", "parent", "children")


@registered("SELECT o_orderkey, o_orderstatus AS stored, CASE WHEN f THEN 'F' ELSE 'O' END AS computed FROM orders JOIN (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS f FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderstatus <> CASE WHEN f THEN 'F' ELSE 'O' END UNION ALL SELECT o_orderkey, o_orderstatus, 'F' FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def aggregate_stale(spark, d):
    rule = 'all(descendants, {.l_linestatus == "F"}) ? "F" : "O"'
    recs = derive.rollup(orders(spark, d).unionByName(lines(spark, d)), {"o_orderstatus": rule})
    bad = propose.propagate_aggregate(validate.violations(recs, Schema(aggregate={"o_orderstatus": rule})))
    return bad.select(F.regexp_extract("path", r"^O(\d+)/", 1).cast("bigint").alias("o_orderkey"), F.col("from").alias("stored"), F.col("to").alias("computed"))


@registered("SELECT r_name AS dir, 'max_children' AS rule, count(*) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) > 4")
def structural_children(spark, d):
    r, n = t(spark, d, "region"), t(spark, d, "nation")
    inv = r.select(F.col("r_name").alias("path"), F.lit(True).alias("is_dir")).unionByName(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat("r_name", F.lit("/"), "n_name").alias("path"), F.lit(False).alias("is_dir")))
    return validate.structural(inv, max_children=4)


# ---- inference


@registered("""WITH d AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
u AS (UNPIVOT (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM d) ON COLUMNS(*) INTO NAME field VALUE v),
s AS (SELECT field, count(*) AS present, count(DISTINCT v) AS distinct_values, (SELECT count(*) FROM d) AS total FROM u GROUP BY field)
SELECT field, present, distinct_values, CASE WHEN distinct_values <= 20 AND present > 0.5 * total THEN 'enum' ELSE 'string' END AS inferred_type, present > 0.8 * total AS required FROM s""")
def infer_fields(spark, d):
    return infer.field_stats(labelled(spark, d)).select("field", "present", "distinct_values", "inferred_type", "required")


@registered("SELECT 'kind' AS field, 'doc' AS value")
def infer_constant(spark, d):
    docs = t(spark, d, "documents").withColumn("kind", F.lit("doc"))
    return infer.constants(lift(docs, key("D", "doc_id"), ["doc_id", "lang", "kind"]))


@registered("SELECT role AS type, count(*) AS n, (SELECT count(*) FROM conversations) AS total, count(*) >= 0.4 * (SELECT count(*) FROM conversations) AS suggested FROM conversations GROUP BY role")
def infer_link_types(spark, d):
    c = t(spark, d, "conversations")
    recs = lift(c, F.concat(key("C", "conv_id"), key("/", "turn")), ["turn"], links=F.array(F.struct(F.lit("x").alias("target"), F.col("role").alias("type"), F.lit(0).alias("line"), F.lit("body").alias("source"), F.lit("wikilink").alias("style"), F.lit("").alias("anchor"))))
    return infer.link_types(recs, share=0.4)


@registered("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[EFST][0-9]{2,4}(?:/[EFST][0-9]{2,4})*\\b'))) AS reference FROM documents")
def infer_cross_refs(spark, d):
    got = infer.cross_references(labelled(spark, d, body=True))
    return got.select(F.regexp_extract("path", r"D(\d+)\.md$", 1).cast("bigint").alias("doc_id"), "reference")


@registered("SELECT CAST(0 AS INTEGER) AS depth, 'directory' AS kind, 'C' AS prefix, CAST(length(CAST(conv_id AS VARCHAR)) AS INTEGER) AS digits, count(DISTINCT conv_id) AS n FROM conversations GROUP BY ALL HAVING count(DISTINCT conv_id) >= 2")
def infer_levels(spark, d):
    c = t(spark, d, "conversations")
    return infer.levels(lift(c, F.concat(key("C", "conv_id"), key("/", "turn")), ["turn"])).filter("kind = 'directory'")


MAJORITY = """SELECT lang, source, value, n, total FROM (
  SELECT *, sum(n) OVER w AS total, max(n) OVER w AS best, count(*) FILTER (n = m) OVER w AS ties FROM (
    SELECT lang, source, CAST(quality AS VARCHAR) AS value, count(*) AS n, max(count(*)) OVER (PARTITION BY lang, source) AS m FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang, source, quality)
  WINDOW w AS (PARTITION BY lang, source)) WHERE n = best AND ties = 1 AND n >= 2 AND n >= 0.6 * total"""


@registered(MAJORITY.replace("total FROM (", "CAST(total AS BIGINT) AS total FROM (", 1))
def sibling_majority(spark, d):
    vals = infer.field_values(labelled(spark, d)).filter("field = 'quality'").select(F.split("dir", "/")[0].alias("lang"), F.split("dir", "/")[1].alias("source"), F.col("value.text").alias("value"))
    return infer.majority(vals, ["lang", "source"], share=0.6, least=2)


@registered("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total, max(n) OVER (PARTITION BY c_nationkey) AS best FROM c),
top AS (SELECT c_nationkey, any_value(c_mktsegment) AS most, any_value(total) AS total, any_value(n) AS n FROM m WHERE n = best GROUP BY c_nationkey HAVING count(*) = 1)
SELECT c_custkey, c_mktsegment AS value, most FROM customer JOIN top USING (c_nationkey) WHERE c_mktsegment <> most AND n >= 3 AND n >= 0.2 * total""")
def sibling_outlier(spark, d):
    c = t(spark, d, "customer")
    recs = lift(c, F.concat(key("N", "c_nationkey"), key("/C", "c_custkey"), F.lit(".md")), ["c_mktsegment"])
    none = spark.createDataFrame([], "path string, field string")
    got = propose.correct_outlier(recs, none, share=0.2)
    return got.select(F.regexp_extract("path", r"/C(\d+)\.md$", 1).cast("bigint").alias("c_custkey"), F.col("from").alias("value"), F.col("to").alias("most"))


# ---- proposals and evolution


@registered("SELECT o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1 HAVING count(*) >= 2")
def extend_enum(spark, d):
    s = Schema(fields={"o_orderpriority": Field("enum", values=("1-URGENT", "2-HIGH"))})
    return propose.extend_enum(validate.violations(orders(spark, d), s)).select(F.col("to").alias("value"))


@registered("SELECT c_custkey, c_mktsegment AS wrong, c_mktsegment || 'X' AS fixed FROM customer")
def correct_value(spark, d):
    c = t(spark, d, "customer")
    segments = ("AUTOMOBILEX", "BUILDINGX", "FURNITUREX", "HOUSEHOLDX", "MACHINERYX")
    s = Schema(fields={"c_mktsegment": Field("enum", values=segments)})
    got = propose.correct_value(validate.violations(lift(c, key("C", "c_custkey"), ["c_mktsegment"]), s), s)
    return got.select(F.regexp_extract("path", r"C(\d+)", 1).cast("bigint").alias("c_custkey"), F.col("from").alias("wrong"), F.col("to").alias("fixed"))


@registered("""SELECT 'enum_value_removed' AS kind, 'o_orderstatus' AS field, count(*) AS affected FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'field_removed', 'o_orderpriority', count(*) FROM orders WHERE o_orderpriority IS NOT NULL
UNION ALL SELECT 'field_added', 'note', 0 UNION ALL SELECT 'required_added', 'note', count(*) FROM orders""")
def schema_diff_impact(spark, d):
    before = Schema(fields={"o_orderstatus": Field("enum", values=("F", "O", "P")), "o_orderpriority": Field("string")})
    after = Schema(fields={"o_orderstatus": Field("enum", values=("F", "O")), "note": Field("string", required=True)})
    return evolve.impact(orders(spark, d), diff(before, after)).select("kind", "field", "affected")


@registered("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def rename_field(spark, d):
    return evolve.rename_field(orders(spark, d), "o_orderstatus", "status").select(num("o_orderkey"), text("status"))


@registered("SELECT s_suppkey, regexp_replace(regexp_replace(lower(trim(s_name)), '[ -]', '-', 'g'), '[^a-z0-9_-]', '', 'g') AS slug, regexp_matches(s_name, '^Supplier.*[0-4]$') AS even FROM supplier")
def scalar_functions(spark, d):
    s = t(spark, d, "supplier")
    return s.select("s_suppkey", scalars.heading_slug(F.col("s_name")).alias("slug"), scalars.glob_match(F.col("s_name"), "Supplier*[0-4]").alias("even"))


@registered("SELECT 'S' || lpad(CAST(max(s_suppkey) + 1 AS VARCHAR), 6, '0') AS next FROM supplier")
def next_sequence(spark, d):
    return t(spark, d, "supplier").select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("n")).agg(scalars.next_in_sequence(F.col("n"), "S", 6).alias("next"))


@registered()
def body_sections(spark, d):
    from ..sources.records import from_contents

    docs = t(spark, d, "documents").select(key("D", "doc_id").alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("scan_ord"))
    return from_contents(docs).select("path", F.explode("body_sections").alias("s")).select("path", "s.heading", "s.level", F.length("s.content").alias("n_chars"))
