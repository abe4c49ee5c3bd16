"""Every registered query of the graph engine: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import architecture, bridges, catalog, context, evaluate, history, hubs, impact, importers, liveness, onehop, resolve, search
from ..sources import text
from ..streaming import debounce
from . import projections as t
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}
ONE_HOP = ("CALLS", "REFERENCES")
DEGREE = ("CALLS", "CALLS_HEURISTIC", "REFERENCES", "EXTENDS", "IMPLEMENTS")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def hubs_topn(spark: SparkSession, d: str) -> DataFrame:
    return hubs.top(t.commerce(spark, d, *DEGREE))


@query
def degree_default_minus_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return hubs.degrees(t.commerce(spark, d, *DEGREE))


@query
def hubs_rank_of_target(spark: SparkSession, d: str) -> DataFrame:
    return hubs.rank_of(t.commerce(spark, d, *DEGREE), "small ring")


@query
def callers(spark: SparkSession, d: str) -> DataFrame:
    return onehop.callers(t.commerce(spark, d, *ONE_HOP))


@query
def callers_polymorphic(spark: SparkSession, d: str) -> DataFrame:
    return onehop.callers(_by_name(t.commerce(spark, d, *ONE_HOP), "small ring"), None, "brand/Brand2.py")


def _by_name(g, name: str):
    """The graph with edges into one name only; for names that aren't identifiers."""
    ids = g.symbols.where(F.col("name") == name).select(F.col("id").alias("dst"))
    return type(g)(g.files, g.symbols, g.edges.join(ids, "dst", "left_semi"))


@query
def callees(spark: SparkSession, d: str) -> DataFrame:
    return onehop.callees(t.commerce(spark, d, *ONE_HOP))


@query
def callers_compact(spark: SparkSession, d: str) -> DataFrame:
    return onehop.callers_compact(t.commerce(spark, d, *ONE_HOP))


@query
def ambiguity_candidates(spark: SparkSession, d: str) -> DataFrame:
    return onehop.ambiguous(t.commerce(spark, d))


@query
def suggest_similar(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("usr_7",), ("user_999",), ("usre_42",)], "wanted string")
    return onehop.suggest(t.events(spark, d), wanted)


@query
def symbols_exact(spark: SparkSession, d: str) -> DataFrame:
    return search.search(t.commerce(spark, d, "CALLS"), "small ring", "exact")


@query
def symbols_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return search.search(t.commerce(spark, d), "small rin", "fuzzy")


@query
def symbols_contains(spark: SparkSession, d: str) -> DataFrame:
    return search.search(t.commerce(spark, d), "ring", "contains")


@query
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    return onehop.file_summary(t.commerce(spark, d, "IMPORTS"))


@query
def large_functions(spark: SparkSession, d: str) -> DataFrame:
    return search.large_functions(t.commerce(spark, d))


@query
def paginate(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = search.page(t.commerce(spark, d).symbols, ["file", "line", "name", "id"], 100, 50)
    return rows.select("name", "file", "line")


@query
def dup_suffix(spark: SparkSession, d: str) -> DataFrame:
    s = t.commerce(spark, d).symbols.withColumn("qualified_name", F.concat_ws("::", "file", "name"))
    return search.dup_suffix(s, order=["line", "id"]).select("id", "unique_name")


@query
def break_points(spark: SparkSession, d: str) -> DataFrame:
    return onehop.break_points(t.commerce(spark, d, *ONE_HOP))


@query
def importers_depth3(spark: SparkSession, d: str) -> DataFrame:
    return importers.importers(t.links(spark, d))


@query
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return liveness.dead_code(t.commerce(spark, d, *ONE_HOP, "OVERRIDES"))


@query
def dead_code_override_closure(spark: SparkSession, d: str) -> DataFrame:
    g = t.commerce(spark, d, *ONE_HOP, "EXTENDS")
    g = g.plus("OVERRIDES", g.kind("EXTENDS"))
    return liveness.override_live(g, liveness.unused(g))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Each turn overrides the one before it."""
    c = t.table(spark, d, "conversations").select("conv_id", "turn")
    key = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + n).cast("string"))
    ids = c.select(key(0).alias("dst"))
    return c.select(key(0).alias("src"), key(-1).alias("dst")).join(ids, "dst", "left_semi")


@query
def dead_code_override_chains(spark: SparkSession, d: str) -> DataFrame:
    """Conversations joined to chains of many turns, each turn overriding the one before it; the first turn of every tenth is used."""
    c = t.table(spark, d, "conversations").select("conv_id", "turn")
    place = F.row_number().over(Window.partitionBy(F.floor(F.col("conv_id") / 10)).orderBy("conv_id", "turn"))
    c = c.select(F.floor(F.col("conv_id") / 10).cast("long").alias("chain"), place.alias("k"))
    key = lambda n: F.concat_ws(":", F.col("chain").cast("string"), (F.col("k") + n).cast("string"))
    symbols = c.select(key(0).alias("id"), key(0).alias("name"), F.lit("a.py").alias("file"), F.lit("method").alias("kind"))
    edges = c.where("k > 1").select(F.lit("OVERRIDES").alias("kind"), key(0).alias("src"), key(-1).alias("dst"))
    calls = c.where("k = 1 and chain % 2 = 0").select(F.lit("CALLS").alias("kind"), key(0).alias("src"), key(0).alias("dst"))
    g = type(t.events(spark, d)).of(spark.createDataFrame([("a.py", "python")], "path string, lang string"), symbols, edges.union(calls))
    return liveness.override_live(g, liveness.unused(g))


@query
def override_chain_depth(spark: SparkSession, d: str) -> DataFrame:
    return liveness.chain_depth(turns(spark, d))


def _reached(spark: SparkSession, d: str, depth: int):
    g = t.events(spark, d)
    return g, impact.reach(g, g.symbols.select(F.col("name").alias("seed")), depth, None)


@query
def bfs_impact(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d, 2)[1]


@query
def impacted_files(spark: SparkSession, d: str) -> DataFrame:
    return impact.impacted_files(*_reached(spark, d, 1))


@query
def impact_merged(spark: SparkSession, d: str) -> DataFrame:
    return impact.merge_seeds(impact.impacted_files(*_reached(spark, d, 1)))


def _seeds(g, name: str = "name"):
    return g.symbols.select(F.col(name).alias("seed"))


@query
def explain_confidence(spark: SparkSession, d: str) -> DataFrame:
    g, reached = _reached(spark, d, 2)
    return impact.explain(g, impact.impacted_files(g, reached)).select("seed", "path", "depth", "reason", "relation", "confidence")


@query
def impact_text_filter(spark: SparkSession, d: str) -> DataFrame:
    """Impacted teams whose rosters, as files, name a reached user."""
    g, reached = _reached(spark, d, 1)
    rosters = g.symbols.groupBy(F.col("file").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("text"))
    return impact.text_filter(impact.impacted_files(g, reached), reached, rosters).select("seed", "path", "depth", "reason")


@query
def impact_capped(spark: SparkSession, d: str) -> DataFrame:
    g, reached = _reached(spark, d, 1)
    return impact.capped(impact.impacted_files(g, reached), ["depth", "path"], 5).select("seed", "path", "depth", "total_available", "truncated")


@query
def bfs_impact_capped(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest names of each user."""
    g = t.events(spark, d)
    return impact.reach(g, g.symbols.select(F.col("name").alias("seed")), 2, 20)


@query
def affected_tests(spark: SparkSession, d: str) -> DataFrame:
    """Users' error chains as calls; three of ten users are tests, whose files have other users' stems in their names."""
    g = t.events(spark, d)
    k = F.col("line").cast("string")
    file = F.when(F.col("line") % 10 < 3, F.concat(F.lit("tests/test_"), F.expr("line % 10").cast("string"), F.lit("_t"), (3 + F.col("line") % 7).cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("team/t"), F.substring(k, -1, 1), F.lit(".py")))
    symbols = g.symbols.withColumn("file", file)
    tested = resolve.tested_by(g.kind("CALLS"), symbols).select(F.lit("TESTED_BY").alias("kind"), "src", "dst")
    files = symbols.select(F.col("file").alias("path"), F.lit("python").alias("lang")).distinct()
    g = type(g).of(files, symbols, g.edges.select("kind", "src", "dst").union(tested))
    return impact.affected_tests(g, symbols.select(F.col("name").alias("seed")), 3).select("seed", "path", "reason")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Section sizes of every supplier: tests, break points, files, commits and bug fixes of its order lines."""
    g = t.commerce(spark, d)
    c = F.col
    named = g.symbols.select(c("id").alias("dst"), c("name").alias("seed"), (c("kind") == "method").alias("method"))
    homes = g.symbols.select(c("id").alias("src"), c("file").alias("src_file"), F.lit(True).alias("known"))
    rows = g.kind("CALLS", "CALLS_HEURISTIC", by="src").join(homes, "src", "left")
    rows = rows.select("dst", "src_file", "line", ((c("kind") == "CALLS") & F.coalesce("known", F.lit(False))).alias("call"), (c("kind") != "CALLS").cast("long").alias("guess"))
    # All of a supplier's lines lie together once, and are counted there: by place, then by file, then by name.
    places = rows.repartition("dst").groupBy("dst", "src_file", "line").agg(F.max("call").alias("call"), F.sum("guess").alias("guess"))
    homes = places.groupBy("dst", "src_file").agg(F.collect_list(F.when(c("call"), c("line"))).alias("lines"), F.max("call").alias("call"), F.sum("guess").alias("guess")).join(named, "dst")
    call = c("method") & c("call")
    homes = homes.groupBy("seed", "src_file").agg(F.array_distinct(F.flatten(F.collect_list(F.when(call, c("lines"))))).alias("lines"), F.max(call).alias("call"), F.sum("guess").alias("guess"))
    breaks = homes.groupBy("seed").agg(F.sum(F.size("lines")).alias("breaks"), F.count_if("call").alias("files"), F.max(F.array_max("lines")).alias("deepest"), F.sum("guess").alias("guessed"))
    tests = g.kind("TESTED_BY").select(c("src").alias("dst"), "line").distinct().join(named, "dst").groupBy("seed").agg(F.countDistinct("line").alias("tests"))
    every = g.symbols.where("kind = 'method'").select(c("name").alias("seed"))
    return every.join(breaks, "seed", "left").join(tests, "seed", "left").fillna(0)


@query
def impact_risk(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    score = impact.impact_risk(c("tests"), c("breaks"), c("files"), c("deepest"), F.lit(7), c("guessed") % 2, c("guessed") % 3)
    rows = _sections(spark, d).withColumn("score", F.round(score, 6))
    return rows.select("seed", "score", impact.risk_level(c("score")).alias("level"))


@query
def risk_composite(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    score = impact.risk_score(c("tests"), c("breaks"), c("files"), c("guessed"), F.floor(c("guessed") / 2))
    rows = _sections(spark, d).withColumn("score", F.round(score, 6))
    return rows.select("seed", "score", impact.risk_level(c("score")).alias("level"))


@query
def rename_sites(spark: SparkSession, d: str) -> DataFrame:
    return catalog.rename_sites(t.commerce(spark, d, *ONE_HOP), "small ring", "brand/Brand2.py")


@query
def rename_blockers(spark: SparkSession, d: str) -> DataFrame:
    pages = t.table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("text"))
    return catalog.rename_blockers(text.file_lines(pages), "the")


def _nations(spark: SparkSession, d: str):
    g = t.commerce(spark, d, *ONE_HOP, "EXTENDS")
    return g, g.files.select(F.col("path").alias("root"))


@query
def architecture_modules(spark: SparkSession, d: str) -> DataFrame:
    return architecture.modules(*_nations(spark, d))


@query
def architecture_modules_capped(spark: SparkSession, d: str) -> DataFrame:
    return architecture.modules(*_nations(spark, d), 7)


@query
def architecture_edges(spark: SparkSession, d: str) -> DataFrame:
    return architecture.edges(*_nations(spark, d))


def _page_roots(spark: SparkSession, d: str):
    pages = t.page_paths(spark, d)
    host = F.substring_index("path", "/", 1)
    domain = F.regexp_replace(host, r"^.*\.(example\.[a-z]+)$", "$1")
    return pages, pages.select(F.explode(F.array(host, F.concat_ws("/", host, F.lit("en")), domain)).alias("root")).distinct()


@query
def module_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return architecture.owners(*_page_roots(spark, d))


@query
def co_change(spark: SparkSession, d: str) -> DataFrame:
    return history.co_change(t.commits(spark, d))


@query
def co_change_ranked(spark: SparkSession, d: str) -> DataFrame:
    return history.ranked(history.co_change(t.commits(spark, d)))


@query
def co_change_importers(spark: SparkSession, d: str) -> DataFrame:
    """Companions that also import the target: a part imports its brand's parts of the same type."""
    part = t.table(spark, d, "part").select("p_brand", "p_type", F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    first = part.groupBy("p_brand", "p_type").agg(F.min("path").alias("dst"))
    imports = part.join(first, ["p_brand", "p_type"]).select(F.col("path").alias("src"), "dst").where("src != dst")
    return history.with_importers(history.co_change(t.commits(spark, d)), imports)


@query
def commit_frequency_median(spark: SparkSession, d: str) -> DataFrame:
    return history.upper_median(history.frequencies(t.commits(spark, d)))


@query
def hub_penalty(spark: SparkSession, d: str) -> DataFrame:
    return history.hub_penalty(history.frequencies(t.commits(spark, d)))


@query
def churn_bug(spark: SparkSession, d: str) -> DataFrame:
    return history.churn(t.commits(spark, d))


@query
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return bridges.betweenness(t.events(spark, d), digits=6)


@query
def bridges_topn(spark: SparkSession, d: str) -> DataFrame:
    return bridges.top(t.events(spark, d), digits=6)


def _part_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "part")
    file = F.concat(F.lit("brand/"), F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.lower("p_type"), F.lit(".py"))
    return p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), file.alias("file"), F.when(F.col("p_size") > 25, "interface").otherwise("class").alias("kind"), F.col("p_partkey").alias("seq"), "p_partkey", (F.col("p_size") % 2 == 0).alias("is_override"))


def _pending_calls(spark: SparkSession, d: str) -> DataFrame:
    """Each line's part calls the name of the part that has the supplier's key, or of the supplier on seventh lines."""
    s = _part_symbols(spark, d)
    lines = t.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    rows = lines.join(s.select(F.col("p_partkey").alias("l_partkey"), "file", F.col("name").alias("caller")), "l_partkey").join(s.select(F.col("p_partkey").alias("l_suppkey"), F.col("name").alias("other")), "l_suppkey")
    callee = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))).otherwise(F.col("other"))
    return rows.select("file", "caller", callee.alias("callee"), F.col("l_linenumber").cast("long").alias("line"))


def _part_imports(spark: SparkSession, d: str) -> DataFrame:
    """Each file imports, under its own names, the first names of the other types' files of its brand."""
    s = _part_symbols(spark, d)
    files = s.select("file", F.substring_index("file", "/", 2).alias("brand")).distinct()
    pairs = files.join(files.select(F.col("file").alias("target_file"), "brand"), "brand").where("file != target_file")
    names = s.groupBy(F.col("file").alias("target_file")).agg(F.min("name").alias("original"))
    pair = F.struct(F.col("original").alias("local"), F.col("original"))
    return pairs.join(names, "target_file").select("file", "target_file", F.lit(1).cast("long").alias("line"), F.array(pair).alias("names"))


@query
def import_map(spark: SparkSession, d: str) -> DataFrame:
    return resolve.import_map(_part_imports(spark, d))


@query
def resolve_calls_tiers(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_calls(_pending_calls(spark, d), _part_symbols(spark, d), resolve.import_map(_part_imports(spark, d)))


@query
def scope_proximal_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolve.proximal(_pending_calls(spark, d).select("file", F.col("callee").alias("name")), _part_symbols(spark, d))


@query
def implements_subset(spark: SparkSession, d: str) -> DataFrame:
    """Every part extends the next key's name; bases that are interfaces are implemented too."""
    s = _part_symbols(spark, d)
    bases = s.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("name").alias("base"))
    return resolve.extends(s.join(bases, "p_partkey").select("file", "name", "base"), s)


def _members(spark: SparkSession, d: str) -> DataFrame:
    s = _part_symbols(spark, d)
    first = s.groupBy("file").agg(F.min_by("name", "seq").alias("enclosing"))
    return s.join(first, "file")


@query
def contains_members(spark: SparkSession, d: str) -> DataFrame:
    return resolve.contains(_members(spark, d))


@query
def overrides(spark: SparkSession, d: str) -> DataFrame:
    """A file's first part is a class that extends the first ones of two files of its brand, the later file first."""
    m = _members(spark, d)
    heads = m.groupBy("file", F.substring_index("file", "/", 2).alias("brand")).agg(F.min_by("id", "seq").alias("src"))
    bases = heads.groupBy("brand").agg(F.sort_array(F.collect_list(F.struct("file", "src"))).alias("x"))
    bases = bases.select("brand", F.posexplode(F.reverse(F.slice("x", 1, 2))).alias("place", "base")).select("brand", "place", F.col("base.src").alias("dst"))
    parents = heads.join(bases, "brand").where("src != dst").select("src", "dst", "place")
    return resolve.overrides(m, resolve.contains(m), parents)[0]


@query
def decorates_resolution(spark: SparkSession, d: str) -> DataFrame:
    s = _part_symbols(spark, d)
    pending = s.select("file", F.col("id").alias("symbol"), F.concat(F.lit("lib."), F.element_at(F.split("name", " "), -1), F.lit("."), F.col("name")).alias("decorator"), F.lit("").alias("args"))
    return resolve.decorates(pending, s)


@query
def tested_by(spark: SparkSession, d: str) -> DataFrame:
    """A turn calls the next one; user turns are tests, assistant turns are sources."""
    c = t.table(spark, d, "conversations")
    file = F.when(F.col("role") == "user", F.concat(F.lit("tests/test_c"), F.col("conv_id").cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("src/c"), F.col("conv_id").cast("string"), F.lit(".py")))
    key = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + n).cast("string"))
    symbols = c.select(key(0).alias("id"), file.alias("file"), F.lit("function").alias("kind"))
    return resolve.tested_by(c.select(key(0).alias("src"), key(1).alias("dst")), symbols)


@query
def change_set(spark: SparkSession, d: str) -> DataFrame:
    """Documents against themselves after the toxic ones went, the short ones changed, and the benchmark came."""
    docs = t.documents(spark, d)
    old = docs.select("path", F.sha2("text", 256).alias("hash"))
    toxic = t.table(spark, d, "labels").where("toxic = 1").select("doc_id")
    text_ = F.when(F.length("text") < 500, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    new = docs.join(toxic, "doc_id", "left_anti").select("path", F.sha2(text_, 256).alias("hash"))
    bench = t.table(spark, d, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))
    return catalog.change_set(old, new.union(bench))


@query
def health_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.health(t.commerce(spark, d))


@query
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.counts(t.commerce(spark, d))


@query
def ego_graph(spark: SparkSession, d: str) -> DataFrame:
    return catalog.ego(t.commerce(spark, d), "s7")[0].select("id", "name", "file", "kind")


@query
def file_facts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.file_facts(t.documents(spark, d)).select("path", "size", "loc", "hash")


@query
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Test, vendored and routed paths among ones made from the pages' urls."""
    from ..functions import predicates as p

    names = F.array(*map(F.lit, ["test_a.py", "a_test.go", "a.spec.ts", "ATest.java", "vendor/a.rb", "app/page.tsx", "pages/api/a.ts", "a.pb.go"]))
    path = F.concat_ws("/", F.regexp_replace("path", r"^[^/]*/", ""), F.get(names, F.expr("cast(page_id % 8 as int)")))
    rows = t.page_paths(spark, d).select("page_id", path.alias("path"))
    return rows.select("page_id", p.is_test_path(F.col("path")).alias("is_test"), p.is_vendored(F.col("path")).alias("is_vendored"), p.is_framework_routed(F.col("path")).alias("is_routed"), p.is_generated(F.col("path")).alias("is_generated"))


@query
def diff_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a diff over its lines' parts."""
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    head = F.concat(F.lit("--- a/part/"), F.col("l_partkey").cast("string"), F.lit(".py\n+++ b/part/"), F.col("l_partkey").cast("string"), F.lit(".py\t2024\n@@ -1 +1 @@\n"))
    diffs = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", head.alias("h")))), lambda x: x["h"]), "").alias("diff"))
    return text.diff_paths(diffs)


@query
def route_extract(spark: SparkSession, d: str) -> DataFrame:
    """Pages' urls as routes of a urls.py for each page."""
    rows = t.page_paths(spark, d).select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit("/urls.py")).alias("path"), F.concat(F.lit('path("'), F.col("path"), F.lit('", views.show_'), (F.col("page_id") % 7).cast("string"), F.lit(")")).alias("text"))
    return text.routes(rows, "show_3")


@query
def config_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as yaml files: lines that have a word."""
    docs = t.documents(spark, d).select(F.regexp_replace("path", r"\.txt$", ".yaml").alias("path"), "text")
    return text.config_mentions(docs, "token")


@query
def string_literals(spark: SparkSession, d: str) -> DataFrame:
    pages = t.table(spark, d, "pages")
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))), ",").alias("targets"))


@query
def line_snippet(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    return context.snippet(docs, docs.select("path", (F.col("doc_id") % 5 + 1).alias("line")), 3)


@query
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import predicates as p

    return t.documents(spark, d).select("doc_id", p.token_estimate(F.col("text")).alias("snippet_tokens"), p.file_token_estimate(F.col("text")).alias("file_tokens"))


@query
def budget_fold(spark: SparkSession, d: str) -> DataFrame:
    """Conversations packed to 300 tokens: roles are sections, turns are items."""
    c = t.table(spark, d, "conversations")
    section = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return context.pack_sections(c.select(F.col("conv_id").alias("key"), section.alias("section"), F.col("turn").alias("place"), F.col("turn").cast("string").alias("id"), F.floor(F.length("text") / 4).alias("tokens")), 300)


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bm25(t.documents(spark, d), "token password the_secret")


def _judged(spark: SparkSession, d: str):
    """Tasks are sources; expected are documents of quality 1, actual are labelled ones under 3000 characters."""
    rows = t.documents(spark, d).join(t.table(spark, d, "labels"), "doc_id").select(F.col("source").alias("task"), F.col("doc_id").alias("item"), "quality", F.length("text").alias("len"))
    return rows, rows.where("quality = 1"), rows.where("len < 3000")


@query
def prf_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, expected, actual = _judged(spark, d)
    return evaluate.prf(expected, actual, rows)


def _by_length(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("task").orderBy(F.desc("len"), "item")
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("tokens", F.floor(F.col("len") / 4))


@query
def mrr(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = _judged(spark, d)
    return evaluate.mrr(_by_length(rows), rows.where("quality = 0"), rows)


@query
def token_cost_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = _judged(spark, d)
    return evaluate.token_cost(_by_length(rows), rows.where("quality = 0"))


@query
def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_size", F.round(F.col("p_retailprice") % 97, 2).alias("v"))
    return evaluate.spearman(rows, "p_size", "v")


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = _judged(spark, d)
    return evaluate.sweep(rows.select(F.least(F.col("len") / 4000, F.lit(1.0)).alias("score"), (F.col("quality") == 0).alias("positive")), [0.1, 0.25, 0.5, 0.75, 1.0])


@query
def impact_composite(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _sections(spark, d)
    score = evaluate.impact_composite(c("tests") / 7, F.least(c("files") / 25, F.lit(1.0)), c("deepest"), F.lit(7), c("files") / F.greatest(c("breaks"), F.lit(1)), c("breaks") > 0)
    return rows.select("seed", F.round(score, 6).alias("score"))


@query
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select("event_type", (F.col("value") / 100).alias("v"))
    return evaluate.summary(rows, "v", "event_type")


@query
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each event type with 15 minutes of quiet as their end."""
    e = t.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return debounce.sessions(e, "15 minutes", ("event_type",), 10)


@query
def lang_stats_threshold(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d).join(t.table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("ok"))
    return catalog.language_stats(docs, 0.15)
