"""The generic operators bound to the driver's tables, each with the SQL that gives the same rows.

Pages stand for source files: a page declares the first word of its heading and refers to the names
in its links; the last page that declares a name owns it. Events of a user stand for calls.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import patterns
from tidemark.operators import changes, extraction, filters, formatters, graph, selection
from tidemark.plans import analyze
from tidemark.session import shared_dir
from tidemark.sources import git
from tidemark.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the page graph ----

_DECLARED = r"SELECT page_id AS path, regexp_extract(html, '<article><h1>([^ <]+)', 1) AS name FROM pages WHERE regexp_extract(html, '<article><h1>([^ <]+)', 1) <> ''"
_REFERENCES = r"""SELECT DISTINCT path, dep_name FROM (SELECT page_id AS path, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS dep_name FROM pages)"""
_GRAPH = rf"""declared AS ({_DECLARED}), refs AS ({_REFERENCES}),
idx AS (SELECT name AS class_name, max(path) AS path FROM declared GROUP BY name),
edges AS (SELECT DISTINCT i.path AS dependency, r.path AS dependent FROM refs r JOIN idx i ON r.dep_name = i.class_name WHERE i.path <> r.path)"""


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract("html", r"<article><h1>([^ <]+)", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("page_id").alias("ord"), name.alias("name")).filter("name <> ''")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.explode(names).alias("dep_name")).distinct()


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.reverse_edges(references(spark, sf_dir), graph.class_index(declared(spark, sf_dir)))
    return edges.filter("dependency <> dependent").distinct()


@query(_DECLARED)
def extract_declared(spark, sf_dir):
    return declared(spark, sf_dir).select("path", "name")


@query(_REFERENCES)
def extract_references(spark, sf_dir):
    return references(spark, sf_dir)


@query(f"WITH {_GRAPH} SELECT class_name, path FROM idx")
def class_index_last_wins(spark, sf_dir):
    return graph.class_index(declared(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT path, string_agg(DISTINCT name, ' ' ORDER BY name) AS classes FROM declared GROUP BY path")
def file_to_classes(spark, sf_dir):
    return graph.file_classes(declared(spark, sf_dir)).select("path", F.array_join("classes", " ").alias("classes"))


@query(f"WITH {_GRAPH} SELECT dependency, dependent FROM edges")
def reverse_edges(spark, sf_dir):
    return page_edges(spark, sf_dir)


@query(f"WITH RECURSIVE {_GRAPH}, reach(node) AS (SELECT page_id FROM pages WHERE page_id % 10 = 0 UNION SELECT e.dependent FROM reach r JOIN edges e ON r.node = e.dependency) SELECT node FROM reach")
def affected_closure(spark, sf_dir):
    seeds = table(spark, sf_dir, "pages").filter("page_id % 10 = 0").select(F.col("page_id").alias("node"))
    return graph.affected(seeds, page_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_GRAPH}, reach(root, node) AS (SELECT page_id, page_id FROM pages WHERE page_id % 10 = 0 UNION SELECT r.root, e.dependent FROM reach r JOIN edges e ON r.node = e.dependency) SELECT root, node FROM reach")
def affected_closure_multi_root(spark, sf_dir):
    seeds = table(spark, sf_dir, "pages").filter("page_id % 10 = 0").select(F.col("page_id").alias("root"), F.col("page_id").alias("node"))
    return graph.closure(seeds, page_edges(spark, sf_dir))


@query(QUERIES["affected_closure_multi_root"][1])
def affected_closure_by_frontier(spark, sf_dir):
    seeds = table(spark, sf_dir, "pages").filter("page_id % 10 = 0").select(F.col("page_id").alias("root"), F.col("page_id").alias("node"))
    return graph.closure(seeds, page_edges(spark, sf_dir), small=0)


@query(f"WITH {_GRAPH}, changed AS (SELECT page_id AS path FROM pages WHERE page_id % 7 = 0) SELECT DISTINCT r.path FROM refs r JOIN idx i ON r.dep_name = i.class_name JOIN changed c ON i.path = c.path")
def indirect_one_hop(spark, sf_dir):
    changed = table(spark, sf_dir, "pages").filter("page_id % 7 = 0").select(F.col("page_id").alias("path"))
    return graph.one_hop(changed, graph.class_index(declared(spark, sf_dir)), references(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT path, dep_name FROM refs")
def incremental_merge(spark, sf_dir):
    """A partial run over a change set equals a full one; what was kept of changed pages is stale."""
    changed = table(spark, sf_dir, "pages").filter("page_id % 7 = 0").select(F.col("page_id").alias("path"))
    refs = references(spark, sf_dir)
    stale = F.when(F.col("path") % 7 == 0, F.concat(F.lit("old/"), "dep_name")).otherwise(F.col("dep_name"))
    return changes.merge_incremental(refs.withColumn("dep_name", stale), refs.join(changed, "path", "left_semi"), changed)


@query(f"""WITH {_GRAPH}, old AS (SELECT name FROM declared WHERE path % 7 = 0), fresh AS (SELECT CASE WHEN path % 2 = 0 THEN 'New' || name ELSE name END AS class_name, max(path) AS path FROM declared WHERE path % 7 = 0 GROUP BY ALL)
SELECT class_name, path FROM idx WHERE class_name NOT IN (SELECT name FROM old) AND class_name NOT IN (SELECT class_name FROM fresh) UNION ALL SELECT class_name, path FROM fresh""")
def class_index_incremental(spark, sf_dir):
    """Changed pages give up their old names, some take new ones; the rest of the index stays."""
    was = declared(spark, sf_dir)
    before = was.filter("path % 7 = 0")
    fresh = before.withColumn("name", F.when(F.col("path") % 2 == 0, F.concat(F.lit("New"), "name")).otherwise(F.col("name")))
    return changes.merge_class_index(graph.class_index(was), before.select("name"), graph.class_index(fresh))


@query(f"WITH {_GRAPH} SELECT CAST(count(*) AS BIGINT) AS n, string_agg(path || '::' || class_name, ' ' ORDER BY path, class_name) AS out FROM idx")
def method_to_file_output(spark, sf_dir):
    index = graph.class_index(declared(spark, sf_dir))
    methods = index.select(F.col("path").alias("ord"), F.concat("class_name", F.lit("::"), "class_name").alias("method"))
    items = graph.methods_to_files(methods, index.withColumn("path", F.col("path").cast("string")))
    return items.agg(F.count(F.lit(1)).alias("n")).crossJoin(formatters.format_plain(items))  # single rows


# ---- extraction from source text: one class for each order, one import and one method for each line item ----


def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, ord, code: generated source files. An order has few lines, so a file is small."""
    line = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.min("l_suppkey").alias("supplier"))
    uses = F.transform("lines", lambda x: F.format_string("use Parts\\P%d as L%d;\n", x["part"], x["l_linenumber"]))
    methods = F.transform("lines", lambda x: F.format_string("    function m%d()\n    {\n        return L%d::make();\n    }\n", x["l_linenumber"], x["l_linenumber"]))
    code = F.concat(F.lit("<?php\nnamespace Shop;\n"), F.array_join(uses, ""), F.format_string("class O%d extends \\S%d\n{\n", "l_orderkey", "supplier"), F.array_join(methods, ""), F.lit("}\n"))
    return orders.select(F.format_string("O%d.php", "l_orderkey").alias("path"), F.col("l_orderkey").alias("ord"), code.alias("code"))


@query(r"""SELECT 'O' || l_orderkey || '.php' AS path, 'declared' AS kind, 'Shop\O' || l_orderkey AS name FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'O' || l_orderkey || '.php', 'extends', 'S' || min(l_suppkey) FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT DISTINCT 'O' || l_orderkey || '.php', 'use', 'Parts\P' || l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'O' || l_orderkey || '.php', 'static', 'L' || l_linenumber FROM lineitem""")
def source_facts(spark, sf_dir):
    return extraction.extract_facts(order_sources(spark, sf_dir)).select("path", "kind", "name")


@query(r"""SELECT 'Shop\O' || l_orderkey || '::m' || l_linenumber AS caller, 'Parts\P' || max(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) || 'L' || l_linenumber || '::make' AS callee FROM lineitem""")
def source_calls(spark, sf_dir):
    """An alias is also taken as part of the name it stands for; of equal aliases the last import holds."""
    return extraction.extract_calls(order_sources(spark, sf_dir)).select("caller", "callee")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS k FROM lineitem)
SELECT 'O' || l_orderkey || '.php' AS path, CAST(n + 5 + 4 * k + d AS INTEGER) AS line, 'O' || l_orderkey || '::m' || l_linenumber AS method FROM l, (VALUES (0), (1), (2)) AS v(d)""")
def source_method_lines(spark, sf_dir):
    return extraction.extract_method_lines(order_sources(spark, sf_dir)).select("path", "line", "method")


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, ord, code: a file for each part, with group imports, traits, interfaces, new, includes, comments and quoted code."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    code = F.format_string(
        "<?php\nnamespace Part;\n// class No {} use No;\nuse Lib\\{A%1$d, In\\B as C%1$d};\n/* new No; */\ninterface I%1$d extends J {}\ntrait T%1$d {}\n"
        "class P%1$d extends \\Base implements I%1$d, \\K\n{\n    use T%1$d, Far\\U;\n    function f()\n    {\n        include 'inc/../z%2$d.php';\n        $s = \"new No {$this->x}\";\n"
        "        return new \\Made\\M%2$d(self::X, No::class ? 'use No;' : Other::make());\n    }\n}\n",
        "k", "z",
    )
    return part.select(F.format_string("src/P%d.php", "k").alias("path"), F.col("k").alias("ord"), code.alias("code"), "z")


@query(r"""WITH f AS (SELECT 'src/P' || p_partkey || '.php' AS path, p_partkey AS k, p_size AS z FROM part)
SELECT path, kind, name FROM (SELECT path, unnest([
  {'kind': 'use', 'name': 'Lib\A' || k}, {'kind': 'use', 'name': 'Lib\In\B'}, {'kind': 'declared', 'name': 'Part\I' || k}, {'kind': 'declared', 'name': 'Part\T' || k}, {'kind': 'declared', 'name': 'Part\P' || k},
  {'kind': 'extends', 'name': 'J'}, {'kind': 'extends', 'name': 'Base'}, {'kind': 'implements', 'name': 'I' || k}, {'kind': 'implements', 'name': 'K'}, {'kind': 'trait', 'name': 'T' || k}, {'kind': 'trait', 'name': 'Part\Far\U'},
  {'kind': 'include', 'name': 'inc/../z' || z || '.php'}, {'kind': 'var', 'name': '$s'}, {'kind': 'var', 'name': '$this'}, {'kind': 'new', 'name': 'Made\M' || z}, {'kind': 'static', 'name': 'No'}, {'kind': 'static', 'name': 'Other'}]) AS x FROM f) AS t, LATERAL (SELECT x.kind AS kind, x.name AS name)""")
def source_facts_of_parts(spark, sf_dir):
    """Facts of every kind; comments and quoted code give none."""
    return extraction.extract_facts(part_sources(spark, sf_dir)).select("path", "kind", "name")


@query(r"""WITH f AS (SELECT 'src/P' || p_partkey || '.php' AS path, p_partkey AS k, p_size AS z FROM part)
SELECT path, kind, name FROM (SELECT path, unnest([
  {'kind': 'use', 'name': 'Lib\A' || k}, {'kind': 'use', 'name': 'Lib\In\B'}, {'kind': 'declared', 'name': 'Part\I' || k}, {'kind': 'declared', 'name': 'Part\T' || k}, {'kind': 'declared', 'name': 'Part\P' || k},
  {'kind': 'extends', 'name': 'J'}, {'kind': 'extends', 'name': 'Base'}, {'kind': 'implements', 'name': 'I' || k}, {'kind': 'implements', 'name': 'K'}, {'kind': 'trait', 'name': 'T' || k}, {'kind': 'trait', 'name': 'Part\Far\U'},
  {'kind': 'include', 'name': 'inc/../z' || z || '.php'}, {'kind': 'new', 'name': 'Made\M' || z}, {'kind': 'static', 'name': 'Other'}]) AS x FROM f) AS t, LATERAL (SELECT x.kind AS kind, x.name AS name)""")
def syntax_facts_of_parts(spark, sf_dir):
    """As a syntax tree has it, constants are no static calls and variables count only where a method is called on them."""
    return extraction.extract_facts(part_sources(spark, sf_dir), "ast").select("path", "kind", "name")


@query("SELECT 'src/P' || p_partkey || '.php' AS path, 'inc/../z' || p_size || '.php' AS name FROM part")
def raw_includes(spark, sf_dir):
    return extraction.includes(extraction.extract_facts(part_sources(spark, sf_dir)))


@query("SELECT 'src/P' || p_partkey || '.php' AS path, 'src/z' || p_size || '.php' AS dep_name FROM part WHERE p_size < 20")
def include_paths(spark, sf_dir):
    """Included files by their path in the project; those that are not there drop out."""
    sources = part_sources(spark, sf_dir)
    there = sources.select(F.format_string("src/z%d.php", "z").alias("path"), "z").filter("z < 20").distinct()
    return extraction.resolved_includes(extraction.extract_facts(sources), there, "/project")


@query("SELECT 'src/P' || p_partkey || '.php' AS path, CAST(p_size AS INTEGER) AS start, CAST(p_partkey % 3 AS INTEGER) AS cnt FROM part UNION ALL SELECT 'src/P' || p_partkey || '.php', CAST(p_size + 100 AS INTEGER), 1 FROM part")
def diff_hunks(spark, sf_dir):
    """Hunks of a diff that changes every part's file in two places."""
    part = table(spark, sf_dir, "part")
    text = F.format_string("diff --git a/src/P%1$d.php b/src/P%1$d.php\n--- a/src/P%1$d.php\n+++ b/src/P%1$d.php\n@@ -1,2 +%2$d,%3$d @@ function f()\n-x\n+@@ y\n@@ -9 +%4$d @@\n+z", "p_partkey", "p_size", F.col("p_partkey") % 3, F.col("p_size") + 100)
    return git.hunks_of_diffs(part.select(text.alias("diff")))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) + 1 + 4 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS line FROM lineitem)
SELECT DISTINCT 'O' || l_orderkey || '.php' AS path, 'O' || l_orderkey || '::m' || l_linenumber AS method FROM l JOIN orders ON l_orderkey = o_orderkey WHERE line <= o_custkey % 30 + 3 AND line + 2 >= o_custkey % 30""")
def changed_methods_of_diff(spark, sf_dir):
    """Each order's file is changed in four lines; changes of other files, and of files that are not there, give nothing."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), (F.col("o_custkey") % 30).alias("start"))
    names = F.explode(F.array(F.concat(F.lit("O"), "k", F.lit(".php")), F.concat(F.lit("O"), "k", F.lit(".txt")), F.concat(F.lit("Gone"), "k", F.lit(".php"))))
    return analyze.changed_methods(order_sources(spark, sf_dir), orders.select(names.alias("path"), "start", F.lit(4).alias("cnt")))


@query("WITH m AS (SELECT DISTINCT l_suppkey AS path, l_partkey AS method FROM lineitem) SELECT count(DISTINCT path) AS files, count(*) AS methods FROM m")
def changed_method_counts(spark, sf_dir):
    return changes.method_counts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("method")))


@query("SELECT DISTINCT 'C' || o_custkey || '.php' AS dependency, 'O' || o_orderkey || '.php' AS dependent FROM orders UNION ALL SELECT 'C' || c_custkey || '.php', 'C' || (c_custkey + 1) || '.php' FROM customer WHERE c_custkey < (SELECT max(c_custkey) FROM customer)")
def project_edges(spark, sf_dir):
    """From source text to reverse edges: an order's class imports and extends its customer's, and each customer's is made by the next."""
    one = table(spark, sf_dir, "customer").select(F.format_string("C%d.php", "c_custkey").alias("path"), F.col("c_custkey").alias("ord"), F.format_string("<?php namespace Shop; class C%d { function f() { return new \\Shop\\C%d(); } }", "c_custkey", F.col("c_custkey") - 1).alias("code"))
    two = table(spark, sf_dir, "orders").select(F.format_string("O%d.php", "o_orderkey").alias("path"), F.col("o_orderkey").alias("ord"), F.format_string("<?php use Shop\\C%1$d; class O%2$d extends \\Shop\\C%1$d {}", "o_custkey", "o_orderkey").alias("code"))
    sources = one.unionByName(two)
    found, deps = analyze.relations(extraction.extract_facts(sources), sources, "/project", "conservative")
    return graph.reverse_edges(deps, graph.class_index(found))


# ---- filters and patterns ----


_ODD = "CASE p_partkey % 6 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'src/vendor/' WHEN 2 THEN 'src/x/cache/' WHEN 3 THEN 'var' WHEN 4 THEN '/lib/' ELSE 'src/' END || 'P' || p_partkey || CASE WHEN p_size < 10 THEN '.inc' ELSE '.php' END"


@query(f"SELECT path, regexp_matches(path, '[.]php$') AND NOT regexp_matches(path, '(^|/)(vendor|cache)/') AS walked, regexp_matches(path, '[.]php$') AND NOT regexp_matches(path, '^vendor/') AS scanned FROM (SELECT {_ODD} AS path FROM part)")
def scan_predicates(spark, sf_dir):
    """A walk of folders leaves out skipped ones at any depth, the test of a single file only those at the top."""
    path = F.col("path")
    rows = table(spark, sf_dir, "part").select(F.expr(_ODD).alias("path"))
    return rows.select("path", (filters.has_suffix(path) & ~filters.in_skipped_folder(path)).alias("walked"), filters.should_scan(path).alias("scanned"))


@query(f"SELECT path, CASE WHEN path LIKE '/%' THEN path ELSE '/project/' || path END AS full_path FROM (SELECT {_ODD} AS path FROM part)")
def absolute_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.expr(_ODD).alias("path"))
    return rows.select("path", filters.absolute(F.col("path"), "/project/").alias("full_path"))


@query("SELECT page_id, url FROM pages WHERE url LIKE '%.html'")
def scan_suffix_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(filters.has_suffix(F.col("url"), ".html")).select("page_id", "url")


_PATH = r"regexp_replace(url, '^[a-z]+://', '')"
IGNORE_LINES = ["# generated", "!blog.*", "blog.*", "m.*/fr/", "*.html", "en"]


@query(rf"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), q AS (SELECT *, list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[:i], '/')) AS ups FROM p)
SELECT page_id, CASE
  WHEN regexp_matches(path, '(?:^|/)blog\.[^/]*(?:/|$)?') OR len(list_filter(ups, lambda u: regexp_matches(u, '(?:^|/)blog\.[^/]*(?:/|$)?'))) > 0 THEN false
  WHEN regexp_matches(path, '(?:^|/)m\.[^/]*/fr(?:/|$)') OR len(list_filter(ups, lambda u: regexp_matches(u, '(?:^|/)m\.[^/]*/fr(?:/|$)'))) > 0 THEN true
  WHEN regexp_matches(path, '(?:^|/)[^/]*\.html(?:/|$)?') OR len(list_filter(ups, lambda u: regexp_matches(u, '(?:^|/)[^/]*\.html(?:/|$)?'))) > 0 THEN true
  WHEN regexp_matches(path, '(?:^|/)en(?:/|$)?') OR len(list_filter(ups, lambda u: regexp_matches(u, '(?:^|/)en(?:/|$)?'))) > 0 THEN true
  ELSE false END AS ignored FROM q""")
def ignore_rules_first_match(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", filters.ignored(F.col("path"), patterns.ignore_rules(IGNORE_LINES)).alias("ignored"))


@query(rf"""SELECT page_id AS ord, path, pattern_ord, CASE pattern_ord WHEN 0 THEN '/de\/9.*\.html$/' ELSE '*.html' END AS pattern FROM (
  SELECT page_id, {_PATH} AS path, CASE WHEN regexp_matches({_PATH}, 'de/9.*\.html$') THEN 0 WHEN regexp_matches({_PATH}, '(?:^|/)[^/]*\.html$') THEN 1 END AS pattern_ord FROM pages)
WHERE pattern_ord IS NOT NULL ORDER BY page_id LIMIT 1""")
def full_scan_trigger(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return filters.full_scan_match(files, (r"/de\/9.*\.html$/", "*.html"))


# ---- facts, calls, tests ----


def _strategy(kinds: dict[str, str], name: str) -> Query:
    def run(spark, sf_dir):
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("event_type"))
        facts = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), kind.alias("kind"), F.col("event_type").alias("name"))
        return graph.dependency_set(facts, name)

    run.__name__ = f"strategy_{name}"
    return run


#: Event types as kinds of facts.
KINDS = {"click": "use", "view": "extends", "purchase": "trait", "search": "new", "signup": "static", "error": "var"}
for _name, _of in graph.STRATEGIES.items():
    _in = ", ".join(f"'{t}'" for t, k in KINDS.items() if k in _of)
    query(f"SELECT DISTINCT user_id AS path, event_type AS dep_name FROM events WHERE event_type IN ({_in})")(_strategy(KINDS, _name))

_CALLS = "calls AS (SELECT event_type AS caller, CASE nxt WHEN 'error' THEN '$it->' || nxt ELSE nxt END AS callee FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events))"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive event types of a user as caller and callee; errors are called on a variable."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    pairs = events.select(F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee")).filter("callee is not null")
    return pairs.withColumn("callee", F.when(F.col("callee") == "error", F.concat(F.lit("$it->"), "callee")).otherwise(F.col("callee")))


@query(f"WITH {_CALLS} SELECT callee AS dependency, caller AS dependent, count(*) AS n FROM calls WHERE callee IS NOT NULL AND NOT contains(callee, '$') GROUP BY ALL")
def call_graph_reverse(spark, sf_dir):
    return graph.reverse_calls(calls(spark, sf_dir)).groupBy("dependency", "dependent").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_CALLS}, reach(node) AS (SELECT 'purchase' UNION SELECT c.caller FROM reach r JOIN calls c ON r.node = c.callee AND NOT contains(c.callee, '$')) SELECT node FROM reach")
def cyclic_closure(spark, sf_dir):
    seeds = spark.range(1).select(F.lit("purchase").alias("node"))
    return graph.affected(seeds, graph.reverse_calls(calls(spark, sf_dir)))


_TESTS = "tests AS (SELECT 'O' || l_orderkey || '::test' AS test, 'P' || l_partkey || '::m' || l_linenumber AS callee, CAST(l_suppkey AS VARCHAR) AS path FROM lineitem WHERE l_returnflag <> 'R')"


def order_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tests that call methods of parts; lines that came back are calls of other methods, which are no tests."""
    rows = table(spark, sf_dir, "lineitem")
    test = F.concat(F.lit("O"), rows.l_orderkey.cast("string"), F.when(rows.l_returnflag == "R", "::run").otherwise("::test"))
    callee = F.concat(F.lit("P"), rows.l_partkey.cast("string"), F.lit("::m"), rows.l_linenumber.cast("string"))
    return selection.test_calls(rows.select(test.alias("caller"), callee.alias("callee"), rows.l_suppkey.cast("string").alias("path")))


def part_methods(spark: SparkSession, sf_dir: str, where: str, line: str = "1") -> DataFrame:
    return table(spark, sf_dir, "part").filter(where).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(f"::m{line}")).alias("method"))


@query(f"WITH {_TESTS} SELECT DISTINCT test FROM tests WHERE callee IN (SELECT 'P' || p_partkey || '::m1' FROM part WHERE p_size < 3)")
def direct_test_match(spark, sf_dir):
    return selection.direct(order_tests(spark, sf_dir), part_methods(spark, sf_dir, "p_size < 3"))


@query(f"WITH {_TESTS} SELECT DISTINCT test FROM tests WHERE split_part(callee, '::', 1) IN (SELECT 'P' || p_partkey FROM part WHERE p_size < 3)")
def class_level_match(spark, sf_dir):
    return selection.by_class(order_tests(spark, sf_dir), part_methods(spark, sf_dir, "p_size < 3"))


@query(f"WITH {_TESTS} SELECT DISTINCT test FROM tests WHERE split_part(callee, '::', 1) IN (SELECT 'P' || p_partkey FROM part WHERE p_size = 7)")
def cascade_fallback(spark, sf_dir):
    """The first level finds nothing, so the second one answers; the third is not asked."""
    tests = order_tests(spark, sf_dir)
    return selection.cascade(
        selection.direct(tests, part_methods(spark, sf_dir, "p_size = 7", "none")),
        selection.by_class(tests, part_methods(spark, sf_dir, "p_size = 7")),
        selection.by_namespace(tests, spark.createDataFrame([("src/O/T.php",)], "path string")),
    )


@query(f"WITH {_TESTS} SELECT DISTINCT path FROM tests WHERE callee IN (SELECT 'P' || p_partkey || '::m1' FROM part WHERE p_size < 3) OR test IN (SELECT test FROM tests WHERE callee IN (SELECT 'P' || p_partkey || '::m1' FROM part WHERE p_size < 3))")
def test_to_file(spark, sf_dir):
    """Files of the tests that were found."""
    tests = order_tests(spark, sf_dir)
    return selection.test_files(selection.direct(tests, part_methods(spark, sf_dir, "p_size < 3")), tests)


def _service_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, caller, callee: tests of orders call their suppliers and other methods of parts; suppliers call the parts of seventh lines."""
    line = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("string").alias(n) for c, n in (("l_orderkey", "o"), ("l_suppkey", "s"), ("l_partkey", "p"))], "l_linenumber")
    test, service = F.concat(F.lit("O"), "o", F.lit("Test::testIt")), F.concat(F.lit("S"), "s", F.lit("::run"))
    file = F.concat(F.lit("tests/O"), "o", F.lit("Test.php"))
    one = line.select(file.alias("path"), test.alias("caller"), F.explode(F.array(service, F.concat(F.lit("P"), "p", F.lit("::other")))).alias("callee"))
    two = line.filter("l_linenumber = 7").select(F.concat(F.lit("src/S"), "s", F.lit(".php")).alias("path"), service.alias("caller"), F.concat(F.lit("P"), "p", F.lit("::m1")).alias("callee"))
    return one.unionByName(two)


def _changed_parts(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").filter("p_size = 1").select(F.concat(F.lit("src/P"), key, F.lit(".php")).alias("path"), F.concat(F.lit("P"), key, F.lit("::" + method)).alias("method"))


def _part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_name, path: parts and suppliers have a class with a file, but for parts of size 1 with an even key."""
    key, supplier = F.col("p_partkey").cast("string"), F.col("s_suppkey").cast("string")
    parts = table(spark, sf_dir, "part").filter("p_size <> 1 or p_partkey % 2 = 1").select(F.concat(F.lit("P"), key).alias("class_name"), F.concat(F.lit("src/P"), key, F.lit(".php")).alias("path"))
    return parts.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), supplier).alias("class_name"), F.concat(F.lit("src/S"), supplier, F.lit(".php")).alias("path")))


_SUPPLIERS = "SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)"


@query(f"SELECT DISTINCT 'O' || l_orderkey || 'Test::testIt' AS test FROM lineitem WHERE l_suppkey IN ({_SUPPLIERS})")
def tests_of_reached_methods(spark, sf_dir):
    """The first level asks for all that the changed methods reach, so tests of services of the parts are found."""
    calls_, changed = _service_calls(spark, sf_dir), _changed_parts(spark, sf_dir, "m1")
    return analyze.relevant_tests(changed, analyze.affected_methods(changed, calls_), calls_, _part_index(spark, sf_dir))[0]


@query("SELECT DISTINCT 'O' || l_orderkey || 'Test::testIt' AS test FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1 AND p_partkey % 2 = 1")
def tests_of_changed_classes(spark, sf_dir):
    """Nobody calls the changed methods, so tests of the classes of these are found; classes that the index lacks drop out."""
    calls_, changed = _service_calls(spark, sf_dir), _changed_parts(spark, sf_dir, "unused")
    return analyze.relevant_tests(changed, analyze.affected_methods(changed, calls_), calls_, _part_index(spark, sf_dir))[0]


@query(f"SELECT 'src/P' || p_partkey || '.php' AS path FROM part WHERE p_size = 1 UNION SELECT 'src/S' || l_suppkey || '.php' FROM ({_SUPPLIERS})")
def affected_files_of_methods(spark, sf_dir):
    """Files that changed and files of the classes that are reached; tests have none here."""
    calls_, changed = _service_calls(spark, sf_dir), _changed_parts(spark, sf_dir, "m1")
    return graph.affected_files(changed, analyze.affected_methods(changed, calls_), _part_index(spark, sf_dir))


NAMESPACES = ["src/Red/Widget.php", "lib/small/ring/economy.php", "app/blue/bolt/promo.php"]
_HAS = lambda *ws: "(" + " + ".join(f"contains(lower(name), '{w}')::INT" for w in ws) + ") >= 2"


@query(f"SELECT DISTINCT p_partkey || '/' || p_name || ' ' || p_type || '::test' AS test FROM (SELECT *, p_partkey || '/' || p_name || ' ' || p_type AS name FROM part) WHERE {_HAS('red', 'widget')} OR {_HAS('small', 'ring', 'economy')} OR {_HAS('blue', 'bolt', 'promo')}")
def namespace_match_two_components(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tests = part.select(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "p_name", F.lit(" "), "p_type", F.lit("::test")).alias("test"))
    return selection.by_namespace(tests, spark.createDataFrame([(p,) for p in NAMESPACES], "path string"))


@query(f"SELECT DISTINCT p_partkey || '/' || p_name || ' ' || p_type || '::test' AS test FROM (SELECT *, p_partkey || '/' || p_name || ' ' || p_type AS name FROM part) WHERE {_HAS('red', 'widget')} OR {_HAS('small', 'ring', 'economy')} OR {_HAS('blue', 'bolt', 'promo')}")
def cascade_to_namespace(spark, sf_dir):
    """Neither of the first two levels finds a test, so the namespaces answer."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "p_name", F.lit(" "), "p_type", F.lit("::test"))
    tests = part.select(name.alias("test"), F.lit("Other::m").alias("callee"))
    none = part.select(F.lit("None::m").alias("method"))
    return selection.cascade(selection.direct(tests, none), selection.by_class(tests, none), selection.by_namespace(tests, spark.createDataFrame([(p,) for p in NAMESPACES], "path string")))


@query("SELECT DISTINCT p_brand || chr(92) || replace(p_type, ' ', chr(92)) AS name FROM part WHERE split_part(p_type, ' ', -1) IN ('PROMO', 'SMALL') UNION SELECT 'A' || chr(92) || 'B'")
def short_to_full_names(spark, sf_dir):
    name = F.concat("p_brand", F.lit("\\"), F.translate("p_type", " ", "\\"))
    index = table(spark, sf_dir, "part").select(name.alias("class_name")).distinct()
    return graph.full_names(spark.createDataFrame([("A\\B",), ("PROMO",), ("SMALL",)], "name string"), index)


# ---- changes ----


@query("""WITH hunks AS (SELECT conv_id AS path, min(turn) + 1 AS start, count(*) // 2 AS cnt FROM conversations GROUP BY conv_id)
SELECT DISTINCT c.conv_id AS path, c.role AS method FROM conversations c JOIN hunks h ON c.conv_id = h.path AND c.turn BETWEEN h.start AND h.start + h.cnt - 1""")
def hunk_to_method(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    hunks = rows.groupBy(F.col("conv_id").alias("path")).agg((F.min("turn") + 1).alias("start"), F.floor(F.count(F.lit(1)) / 2).alias("cnt"))
    return changes.hunk_methods(hunks, rows.select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), F.col("role").alias("method")))


_NOW = "SELECT doc_id AS path, doc_id * 10 AS mtime, n_chars AS size FROM documents WHERE doc_id % 17 <> 0"
_OLD = "SELECT doc_id AS path, doc_id * 10 - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 13 <> 0"


def _registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files as they are and as they were: some are new, some gone, some of another time, some of another size."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), (F.col("doc_id") * 10).alias("mtime"), F.col("n_chars").alias("size"))
    old = docs.filter("path % 13 <> 0").withColumn("size", F.col("size") + F.when(F.col("path") % 11 == 0, 1).otherwise(0))
    return docs.filter("path % 17 <> 0"), old.withColumn("mtime", F.col("mtime") - F.when(F.col("path") % 5 == 0, 1).otherwise(0))


@query(f"""WITH cur AS ({_NOW}), old AS ({_OLD})
SELECT coalesce(c.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
FROM cur c FULL JOIN old o ON c.path = o.path WHERE c.path IS NULL OR o.path IS NULL OR c.size IS DISTINCT FROM o.size OR c.mtime IS DISTINCT FROM o.mtime""")
def registry_diff(spark, sf_dir):
    return changes.registry_diff(*_registries(spark, sf_dir))


@query(f"WITH cur AS ({_NOW}), old AS ({_OLD}) SELECT * FROM cur UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM cur)")
def registry_update(spark, sf_dir):
    return changes.update_registry(*_registries(spark, sf_dir))


@query(f"WITH cur AS ({_NOW}), old AS ({_OLD}) SELECT CAST(count(*) AS BIGINT) AS files, CAST(max(mtime) AS BIGINT) AS newest, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT * FROM cur UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM cur))")
def registry_totals(spark, sf_dir):
    return changes.registry_totals(changes.update_registry(*_registries(spark, sf_dir)))


@query(f"WITH cur AS ({_NOW}) SELECT doc_id AS path, cur.path IS NOT NULL AS known, mtime, size FROM labels LEFT JOIN cur ON doc_id = cur.path")
def registry_lookup(spark, sf_dir):
    """What is known of the labelled documents."""
    return changes.registry_lookup(_registries(spark, sf_dir)[0], table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")))


@query(f"WITH cur AS ({_NOW}), old AS ({_OLD}) SELECT * FROM cur UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM cur)")
def registry_kept_between_runs(spark, sf_dir):
    """A run saves the registry as it was, the next one loads it, brings it up to date, saves and loads it again."""
    now, old = _registries(spark, sf_dir)
    store = Store(spark, f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}", temporary=True)
    store.save(registry=old)
    store.save(registry=changes.update_registry(now, store.load()["registry"]))
    return store.load()["registry"]


@query(f"WITH cur AS ({_NOW}), changed AS (SELECT path FROM cur WHERE path % 3 = 0), reached AS (SELECT path FROM cur WHERE path % 2 = 0) SELECT path, CASE WHEN path % 3 = 0 THEN 'changed' ELSE 'dependent' END AS why FROM reached")
def changed_or_dependent(spark, sf_dir):
    """Which files of a report changed themselves."""
    now, _ = _registries(spark, sf_dir)
    return changes.split_report(now.filter("path % 2 = 0").select("path"), now.filter("path % 3 = 0").select("path"))


@query("SELECT doc_id AS path, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def prune_deleted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "n_chars")
    return changes.prune(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")))


@query("SELECT doc_id AS ord, CAST(doc_id // ((SELECT count(*) FROM documents) // 8 + CASE WHEN (SELECT count(*) FROM documents) % 8 > 0 THEN 1 ELSE 0 END) AS INT) AS chunk FROM documents")
def chunk_assignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"))
    return changes.chunk_of(docs, 8, docs.count())


@query("SELECT parsed, total - parsed AS cached, round((total - parsed) * 100.0 / total, 2) AS hit_rate, 2.0 / parsed * (total - parsed) AS seconds_saved FROM (SELECT count(*) AS total, (SELECT count(DISTINCT doc_id) FROM labels) AS parsed FROM documents)")
def cache_statistics(spark, sf_dir):
    """Labelled documents stand for parsed files, which took two seconds in all."""
    parsed = table(spark, sf_dir, "labels").select("doc_id").distinct().count()
    said = changes.cache_stats(parsed, table(spark, sf_dir, "documents").count(), 2.0)
    return spark.createDataFrame([tuple(said.values())], "parsed long, cached long, hit_rate double, seconds_saved double")


# ---- sets ----


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return c, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))


_C, _S = "SELECT c_nationkey AS nation FROM customer", "SELECT s_nationkey AS nation FROM supplier"


@query(f"{_C} UNION ALL {_S}")
def union_bag(spark, sf_dir):
    return changes.union_all(*_nations(spark, sf_dir))


@query(f"{_C} UNION {_S}")
def union_set(spark, sf_dir):
    return changes.union_set(*_nations(spark, sf_dir))


@query(f"SELECT nation FROM ({_C}) WHERE nation IN ({_S})")
def intersect_keys(spark, sf_dir):
    return changes.intersect_keys(*_nations(spark, sf_dir), "nation")


@query("SELECT c_custkey AS customer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def except_keys(spark, sf_dir):
    """Customers without an order: nations would leave none."""
    return changes.except_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer")), "customer")


# ---- formatting ----


@query("""WITH p AS (SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'src/P' ELSE 'tests/P' END || page_id || CASE WHEN html LIKE '%<table%' THEN 'TestCase.php' ELSE 'Test.php' END AS path FROM pages)
SELECT string_agg(path, ' ' ORDER BY page_id) || ' --filter ''/' || string_agg('test\\-' || page_id, '|' ORDER BY page_id) || '/''' AS out FROM p WHERE path NOT LIKE '%TestCase.php'""")
def filter_string_aggregate(spark, sf_dir):
    """Base classes of tests are no tests, wherever they lie; other files are by name."""
    page = F.col("page_id").cast("string")
    path = F.concat(F.when(F.col("url").endswith(".html"), "src/P").otherwise("tests/P"), page, F.when(F.contains("html", F.lit("<table")), "TestCase.php").otherwise("Test.php"))
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.concat(path, F.lit("::test-"), page).alias("item"))
    return formatters.format_phpunit(items)


@query("SELECT '--filter ''/' || string_agg('P' || page_id || 'Test', '|' ORDER BY page_id) || '/''' AS out FROM pages WHERE url NOT LIKE '%.html'")
def filter_method_aggregate(spark, sf_dir):
    """Methods of classes that are no tests, and what is no method, drop out."""
    page = F.col("page_id").cast("string")
    method = F.when(F.col("url").endswith(".html"), F.concat(F.lit("App\\P"), page, F.lit("Service::testIt"))).otherwise(F.concat(F.lit("App\\P"), page, F.lit("Test::testIt")))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.explode(F.array(method, F.concat(F.lit("P"), page, F.lit("Test")))).alias("method"))
    return formatters.format_phpunit_methods(rows)


@query(f"WITH {_GRAPH} SELECT string_agg(path || '::run', ' ' ORDER BY path, class_name) AS out FROM idx")
def file_method_aggregate(spark, sf_dir):
    """Methods of classes without a file drop out."""
    index = graph.class_index(declared(spark, sf_dir))
    methods = index.select(F.struct("path", "class_name").alias("ord"), F.explode(F.array(F.concat("class_name", F.lit("::run")), F.concat(F.lit("no-"), "class_name", F.lit("::run")))).alias("method"))
    return formatters.format_file_methods(methods, index.withColumn("path", F.col("path").cast("string")))


@query("SELECT string_agg(CAST(page_id AS VARCHAR), ' ' ORDER BY page_id) AS out FROM pages")
def plain_string_aggregate(spark, sf_dir):
    return formatters.format_plain(table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("item")))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
