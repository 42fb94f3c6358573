"""Driver queries of manifests, routes, summaries, validation and trees, registered beside those of pagelens.registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import geometry, paths, style
from pagelens.operators import manifest, matching, pixels, summary, trees, validate
from pagelens.registry import long, oracle_sql, queries, query, read
from pagelens.sources.sinks import rounded

__all__ = ["oracle_sql", "queries"]

# --- routes, selectors, frameworks -------------------------------------------------------------------------

_PATH = "case when regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) end"


@query(f"""with p as (select page_id, {_PATH} path from pages), f as (select page_id, path, string_split(rtrim(path, '/'), '/')[-1] file from p)
 select page_id, path, case when regexp_replace(file, '(.)[.][^.]*$', '\\1') in ('', 'index') then 'home' else regexp_replace(file, '(.)[.][^.]*$', '\\1') end page from f""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", paths.discovered_path(F.col("url"), F.regexp_replace("url", "[?#].*$", "")).alias("path"))
    return rows.select("page_id", "path", paths.page_name(F.col("path")).alias("page"))


_HREFS = """case page_id % 8 when 0 then '/root/p' || page_id || '?q=1#top' when 1 then 'near/p' || page_id || '.html' when 2 then '../up' || page_id when 3 then 'mailto:a@b.c'
 when 4 then 'https://other.example.com/x' when 5 then '?page=2' when 6 then url else '#part' end"""


@query(f"""with p as (select page_id, {_HREFS} href, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, {_PATH} own, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) q from pages),
 f as (select *, regexp_replace(own, '[^/]*$', '') folder from p)
 select page_id, case page_id % 8 when 0 then '/root/p' || page_id || '?q=1' when 1 then folder || 'near/p' || page_id || '.html' when 2 then regexp_replace(folder, '[^/]*/$', '') || 'up' || page_id
  when 3 then null when 4 then case when host = 'other.example.com' then '/x' end when 5 then own || '?page=2' when 6 then own || q else own || q end path,
  case page_id % 8 when 0 then '/root/p' || page_id || '?q=1#top' when 1 then folder || 'near/p' || page_id || '.html' when 2 then regexp_replace(folder, '[^/]*/$', '') || 'up' || page_id
  when 3 then null when 4 then case when host = 'other.example.com' then '/x' end when 5 then own || '?page=2' when 6 then own || q || case when href like '%#_%' then regexp_extract(href, '#.*$') else '' end else own || q || '#part' end with_fragment from f""")
def discovered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_HREFS} href")
    url, href = F.col("url"), F.col("href")
    return rows.select("page_id", paths.discovered_path(url, href).alias("path"), paths.discovered_path(url, href, True).alias("with_fragment"))


@query(f"""with i as (select page_id % 20 site, page_id pos, {_PATH} path from pages), spa as (select site, pos, path, case when path in ('/', '/index.html') then '/' else regexp_replace(path, '[.]html$', '') end s from i),
 e as (select distinct site, -1 pos, 0 k, '/' probe from i union all select distinct site, -1, 1, '/index.html' from i union all select site, pos, 0, path from spa union all select site, pos, 1, s from spa),
 f as (select site, probe, min(row(pos, k)) a from e group by 1, 2)
 select site, probe, row_number() over (partition by site order by a)::int place from f""")
def route_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    items = read(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("site"), F.col("page_id").alias("pos"), paths.discovered_path(url, F.regexp_replace(url, "[?#].*$", "")).alias("path"))
    return manifest.route_probes(items)


_FRAMEWORK = "case c_custkey % 4 when 0 then 'react' when 1 then 'solid' when 2 then 'html' else 'vue' end"


@query(f"""with c as (select c_custkey, {_FRAMEWORK} f, c_custkey % 3 = 0 built, 1 + c_custkey % 2 n from customer)
 select c_custkey, case when f in ('react', 'solid') then 'spa' else 'static' end "mode", '/sites/' || c_custkey || case when f in ('react', 'solid') and built then '/dist' else '' end root,
  case when n = 1 then 's' || c_custkey else 's' || c_custkey || '-' || f end slug, 'http://localhost:80/' || case when built then 'about.html' else 'index.html' end url from c""")
def serve_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_FRAMEWORK} f", "c_custkey % 3 = 0 built", "1 + c_custkey % 2 n")
    key = F.col("c_custkey").cast("string")
    f, built = F.col("f"), F.col("built")
    return rows.select("c_custkey", paths.serve_mode(paths.framework_mode(f)).alias("mode"), paths.framework_root(F.concat(F.lit("/sites/"), key), f, built).alias("root"), paths.variant_slug(F.concat(F.lit("s"), key), f, F.col("n")).alias("slug"), paths.route_url(F.lit("http://localhost:80/"), F.when(built, "/about.html")).alias("url"))


@query("""with r as (select event_id, case event_id % 6 when 0 then '/about' when 1 then '/a/b.html?x=1' when 2 then '/assets/app.html' when 3 then '/logo.png' when 4 then '/' else '/Docs/intro.HTML' end t,
  case when event_id % 5 = 0 then 'POST' else 'GET' end m, case when event_id % 7 = 0 then '*/*' else 'text/html,*/*' end a from events)
 select event_id, m = 'GET' and a like '%text/html%' and event_id % 6 not in (2, 3) falls_back from r""")
def spa_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_id", "case event_id % 6 when 0 then '/about' when 1 then '/a/b.html?x=1' when 2 then '/assets/app.html' when 3 then '/logo.png' when 4 then '/' else '/Docs/intro.HTML' end t", "case when event_id % 5 = 0 then 'POST' else 'GET' end m", "case when event_id % 7 = 0 then '*/*' else 'text/html,*/*' end a")
    return rows.select("event_id", paths.falls_back(F.col("m"), F.col("t"), F.col("a")).alias("falls_back"))


@query("""select p_partkey, case p_partkey % 4 when 0 then ['html'] when 1 then ['react', 'html'] when 2 then ['solid'] else ['html'] end names from part""")
def candidate_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case p_partkey % 4 when 0 then null when 1 then ' React,html, REACT ,' when 2 then 'solid' else '  ' end")
    return read(spark, sf_dir, "part").select("p_partkey", paths.frameworks(raw, "html").alias("names"))


@query("""select p_partkey, case p_partkey % 4 when 0 then '#e' || p_partkey when 1 then 'input[name="' || p_size || '"]' when 2 then '.' || replace(array_to_string(list_slice(string_split(p_type, ' '), 1, 3), '.'), ' ', '') end selector from part""")
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_partkey % 4 = 0 then concat('e', p_partkey) end i", "case when p_partkey % 4 = 1 then string(p_size) end n", "case when p_partkey % 4 = 2 then split(p_type, ' ') else array() end c")
    return rows.select("p_partkey", paths.selector(F.lit("input"), F.col("i"), F.col("n"), F.col("c")).alias("selector"))


@query("""with d as (select doc_id, text, string_split(text, chr(10)) l, greatest(strpos(text, '.') - 1, 0) o from documents where text is not null),
 n as (select doc_id, l, (1 + length(left(text, o)) - length(replace(left(text, o), chr(10), '')))::bigint line from d)
 select doc_id, line, array_to_string([i::varchar || ': ' || l[i] for i in range(greatest(1, line - 2), least(len(l), line + 2) + 1)], chr(10)) snippet from n""")
def source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", (F.instr("text", ".") - 1).alias("o"))
    rows = rows.withColumn("line", paths.line_number(F.col("text"), F.col("o")))
    return rows.select("doc_id", "line", paths.snippet(F.col("text"), F.col("line")).alias("snippet"))


@query("""select p_partkey, list_slice(list_sort(list_distinct(list_concat(regexp_extract_all('.' || replace(p_type, ' ', '.') || ', div[data-x]', '[#.][A-Za-z_][A-Za-z0-9_-]*|\\[[^\\]]+\\]|[A-Za-z][A-Za-z0-9_-]*'), ['color', 'margin-top']))), 1, 32) tokens from part""")
def style_rule_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.concat(F.lit("."), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit(", div[data-x]"))
    return read(spark, sf_dir, "part").select("p_partkey", paths.rule_tokens(rule, F.lit("color: red; margin-top : 2px")).alias("tokens"))


@query("select doc_id, case when length(text) > 200 then left(text, 200) || '…(+' || (length(text) - 200) || ' chars)' else text end bounded from documents")
def bounded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", paths.bounded(F.col("text")).alias("bounded"))


@query("""select event_id, event_id % 3 <> 2 transient from events""")
def transient_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_id", "case event_id % 3 when 0 then 'API Error 529' when 1 then 'Rate limit reached' else 'bad request' end m")
    return rows.select("event_id", paths.is_transient(F.col("m")).alias("transient"))


_CONTROL = "case p_partkey % 6 when 0 then 'input' when 1 then 'button' when 2 then 'div' when 3 then 'select' when 4 then 'span' else 'input' end"
_KIND = "case when p_partkey % 12 = 0 then 'hidden' when p_partkey % 12 = 6 then 'submit' when p_partkey % 6 = 5 then 'text' end"
_ROLE = "case when p_partkey % 6 = 2 then 'switch' when p_partkey % 6 = 4 then 'note' end"


@query(f"""with c as (select p_partkey, {_CONTROL} t, {_KIND} k, {_ROLE} r from part)
 select p_partkey, not (t = 'input' and coalesce(k, '') = 'hidden') and (t in ('a', 'button', 'select', 'textarea', 'input') or coalesce(r, '') = 'switch') needs_name,
  t in ('input', 'select') and not (t = 'input' and coalesce(k, '') in ('hidden', 'submit')) form_field from c""")
def control_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey", f"{_CONTROL} t", f"{_KIND} k", f"{_ROLE} r")
    return rows.select("p_partkey", paths.needs_name(F.col("t"), F.col("k"), F.col("r")).alias("needs_name"), paths.is_form_field(F.col("t"), F.col("k")).alias("form_field"))


@query("select item_id, 'data:' || case when item_id % 2 = 0 then 'image/jpeg' else 'image/png' end || ';base64,' || to_base64(encode(text)) url from benchmark")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("item_id") % 2 == 0, "a/b.JPG").otherwise("c.png")
    return read(spark, sf_dir, "benchmark").select("item_id", paths.data_url(name, F.encode("text", "utf-8")).alias("url"))


@query()
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Here it is: "), F.to_json(F.struct("role", "text", F.struct("turn").alias("at"))), F.lit(" {and more}"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct("turn")), F.lit("\n```"))).otherwise(said).alias("said"))
    return rows.select("conv_id", "turn", paths.sorted_json(paths.json_payload(F.col("said"))).alias("answer"))


# --- manifests ----------------------------------------------------------------------------------------------

_CAPTURES = "select o_orderkey % 50 site, o_orderkey pos, case when o_orderkey % 9 = 0 then '' when o_orderkey % 5 = 0 then 'same id!' else 'c' || o_orderkey end id, 'p' || o_custkey || '.html' path, o_orderkey from orders"
_ACTIONS = """select l_orderkey % 50 site, l_orderkey pos, l_linenumber step, case l_partkey % 10 when 0 then 'wait' when 1 then 'press' when 2 then 'scrollBy' when 3 then 'focus' when 4 then 'drag' when 5 then 'fill' when 6 then 'waitForSelector' else 'click' end type,
 case when l_partkey % 10 in (0, 1, 2) or l_suppkey % 11 = 0 then null else '#s' || (l_suppkey % 7) end selector from lineitem"""
_KNOWN_PATHS = "select distinct '/p' || c_custkey || '.html' path from customer where c_custkey % 8 <> 0"
_SELECTORS = "select '/p' || c_custkey || '.html' path, '#s' || s selector, case when (c_custkey + s) % 13 = 0 then 2 else 1 end::bigint count from customer, (select unnest(range(0, 6)) s)"


@query(f"""with c as (select site, pos, id, '/' || path path, o_orderkey from ({_CAPTURES})), a as ({_ACTIONS}), p as ({_KNOWN_PATHS}), s as ({_SELECTORS}),
 j as (select a.*, c.path, coalesce(selector, '') <> '' named, s.count n from a join c using (site, pos) left join s using (path, selector)),
 m as (select *, type in ('hover','click','focus','fill','press','wait','waitForSelector','scroll','scrollBy') and (named or type not in ('hover','click','focus','scroll','waitForSelector')) meant from j),
 k as (select *, meant and (not named or coalesce(n = 1, false)) stays, type not in ('wait','press','scrollBy') state, type in ('hover','click','focus','fill','scroll','scrollBy','press') effect from m),
 g as (select site, pos, count(*) filter (stays) kept, count(*) filter (meant and state) s1, count(*) filter (stays and state) s2, count(*) filter (meant and effect) e1, count(*) filter (stays and effect) e2 from k group by 1, 2),
 r as (select c.*, case when p.path is null then 'path_not_found' when g.pos is null then null when kept = 0 then 'no_actions_left' when s1 > 0 and s2 = 0 then 'no_state_left' when e1 <> e2 then 'effect_lost' end reason
   from c left join p using (path) left join g using (site, pos))
 select pos, reason from r where reason is not null""")
def manifest_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sanitized(spark, sf_dir)[1].select("pos", "reason")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = read(spark, sf_dir, "customer").where("c_custkey % 8 != 0").select(F.concat(F.lit("/p"), F.col("c_custkey").cast("string"), F.lit(".html")).alias("path")).distinct()
    s = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s"))
    s = s.select(F.concat(F.lit("/p"), F.col("c_custkey").cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit("#s"), F.col("s").cast("string")).alias("selector"), F.when((F.col("c_custkey") + F.col("s")) % 13 == 0, 2).otherwise(1).cast("long").alias("count"))
    return known, s


def _sanitized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    captures = read(spark, sf_dir, "orders").selectExpr("o_orderkey % 50 site", "o_orderkey pos", "case when o_orderkey % 9 = 0 then '' when o_orderkey % 5 = 0 then 'same id!' else concat('c', o_orderkey) end id", "concat('p', o_custkey, '.html') path")
    kind = "case l_partkey % 10 when 0 then 'wait' when 1 then 'press' when 2 then 'scrollBy' when 3 then 'focus' when 4 then 'drag' when 5 then 'fill' when 6 then 'waitForSelector' else 'click' end type"
    actions = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 50 site", "l_orderkey pos", "l_linenumber step", kind, "case when l_partkey % 10 in (0, 1, 2) or l_suppkey % 11 = 0 then null else concat('#s', l_suppkey % 7) end selector")
    return manifest.sanitize_captures(captures, actions, *_tables(spark, sf_dir))


@query()
def manifest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sanitized(spark, sf_dir)[0].select("site", "pos", "id", "path", F.coalesce(F.size("actions"), F.lit(0)).alias("n_actions"))


@query(f"""with a as (select o_orderkey pos, '/p' || o_custkey || '.html' path, case o_orderkey % 5 when 0 then 'wait' when 1 then 'drag' when 2 then 'hover' else 'click' end t, case when o_orderkey % 11 = 0 then null else '#s' || (o_orderkey % 7) end ts from orders),
 p as ({_KNOWN_PATHS}), s as ({_SELECTORS}),
 t as (select l_orderkey pos, '#s' || (l_suppkey % 7) selector, l_linenumber % 3 <> 0 colour, l_linenumber % 4 <> 0 valid from lineitem),
 good as (select distinct t.pos from t join a using (pos) join s on s.path = a.path and s.selector = t.selector and s.count = 1 where valid)
 select a.pos, case when p.path is null then 'path_not_found' when t <> 'wait' and ts is null then 'trigger_selector_missing' when t <> 'wait' and coalesce(s.count, 0) <> 1 then 'trigger_selector_invalid' when good.pos is null then 'no_valid_targets' end reason
 from a left join p using (path) left join s on s.path = a.path and s.selector = ts left join good on good.pos = a.pos""")
def animation_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _animations(spark, sf_dir)[1].select("pos", "reason")


def _animations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey % 50 site", "o_orderkey pos", "concat('a', o_orderkey) id", "concat('p', o_custkey, '.html') path", "case o_orderkey % 5 when 0 then 'wait' when 1 then 'drag' when 2 then 'hover' else 'click' end trigger",
        "case when o_orderkey % 11 = 0 then null else concat('#s', o_orderkey % 7) end trigger_selector", "case when o_orderkey % 3 = 0 then null else o_orderkey % 900 end duration",
        "case when o_orderkey % 2 = 0 then array(300L, 0L, 150L, -5L) else array(7L) end samples",
    )
    channels = F.when(F.col("l_linenumber") % 4 == 0, F.array(F.lit("sound"))).when(F.col("l_linenumber") % 3 != 0, F.array(F.lit("motion"), F.lit("color"))).otherwise(F.array(F.lit("motion"), F.lit("sound")))
    targets = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("site"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("place"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("#s"), (F.col("l_suppkey") % 7).cast("string")).alias("selector"), channels.alias("channels"), F.lit(None).cast("array<string>").alias("track"))
    return manifest.sanitize_animations(rows, targets, *_tables(spark, sf_dir))


@query("""with t as (select o_orderkey, case when o_orderkey % 2 = 0 then [0, 150, 300] end g, case when o_orderkey % 3 = 0 then 0 else o_orderkey % 900 end d from orders),
 s as (select o_orderkey, g, d, case when d = 0 then 600 else d end span from t)
 select o_orderkey, coalesce(g, [0, floor(span / 3), floor(span * 2 / 3), span])::bigint[] samples, case when g is null then span when d <= 0 then 300 else d end::bigint duration from s""")
def animation_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_orderkey % 3 = 0 then null else o_orderkey % 900 end duration", "case when o_orderkey % 2 = 0 then array(300L, 0L, 150L, -5L) else array(7L) end samples")
    times, length = manifest.sanitized_times(F.col("duration"), F.col("samples"))
    return rows.select("o_orderkey", times.alias("samples"), length.alias("duration"))


@query("""select o_orderkey, coalesce(case when o_orderkey % 4 = 0 then 2.0 end, 1.0)::double weight, 'c' || o_custkey candidate_path, 'r' || o_custkey oracle_path, l.n items from orders
 join (select l_orderkey, count(*) n from lineitem group by 1) l on l_orderkey = o_orderkey where o_orderkey % 3 <> 0""")
def aligned_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    reference = orders.where("o_orderkey % 3 != 0").selectExpr("o_orderkey", "case when o_orderkey % 4 = 0 then 2.0D end weight", "concat('r', o_custkey) path")
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    candidate = orders.selectExpr("o_orderkey", "1.0D weight", "concat('c', o_custkey) path").join(items, "o_orderkey")
    return manifest.aligned(reference, candidate, ["o_orderkey"], ["weight"]).select("o_orderkey", "weight", "candidate_path", "oracle_path", "items")


@query("select l_orderkey, l_linenumber, case when l_linenumber <= 2 then 'r' || min(l_suppkey) else 'c' || min(l_partkey) end name from lineitem group by 1, 2")
def aligned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    reference = lines.where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("name"))
    candidate = lines.select("l_orderkey", "l_linenumber", F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("name"))
    return manifest.aligned_targets(reference, candidate, ["l_orderkey", "l_linenumber"], ["name"])


@query(f"""with f as (select distinct page_id % 20 site, regexp_extract({_PATH}, '(/[^/]*)/?$', 1) path from pages)
 select site, regexp_extract(path, '^/([^/]+)[.]html$', 1) || '.desktop.full' id, path from f where regexp_matches(path, '^/[^/]+[.]html$') and path <> '/index.html'
 union all select site, 'home.desktop.full', path from f where path = '/index.html'""")
def fallback_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.fallback_captures(_top_files(spark, sf_dir)).select("site", "id", "path")


def _top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    path = paths.discovered_path(url, F.regexp_replace(url, "[?#].*$", ""))
    return read(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("site"), F.regexp_extract(path, "(/[^/]*)/?$", 1).alias("path"))


@query(f"""with f as (select distinct page_id % 20 site, regexp_extract({_PATH}, '(/[^/]*)/?$', 1) path from pages), h as (select * from f where regexp_matches(path, '^/[^/]+[.]html$'))
 select s.site, coalesce(h.path, '/') path from (select distinct site from f) s left join h using (site)""")
def static_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _top_files(spark, sf_dir)
    return manifest.static_routes(files, files)


@query("""with p as (select c_nationkey site, 'p' || c_custkey page, case when c_nationkey % 2 = 0 then 'Mobile first' else 'desktop' end m from customer), k as (select * from (values ('desktop.full', 1.0, 1440), ('mobile.viewport', 0.5, 390)) t(kind, weight, width))
 select site, page || '.' || kind id, '/' || page path, weight::double weight, width from p join k on kind = 'desktop.full' or m like 'Mobile%'""")
def concept_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("p"), F.col("c_custkey").cast("string"))
    pages = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), page.alias("page"), page.alias("path"), F.when(F.col("c_nationkey") % 2 == 0, "Mobile first").otherwise("desktop").alias("mobile_behavior"))
    return manifest.concept_captures(pages).select("site", "id", "path", "weight", "width")


_RUN_CAPTURES = "select l_orderkey run, l_partkey * 10 + l_linenumber pos, 'c' || l_linenumber || case when l_partkey % 3 = 0 then '.desktop.full' else '' end id, case when l_suppkey % 5 = 0 then null else 'page' || (l_suppkey % 3) end page, l_quantity weight, l_tax > 0.01 enabled from lineitem"


def _run_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey run", "l_partkey * 10 + l_linenumber pos", "concat('c', l_linenumber, case when l_partkey % 3 = 0 then '.desktop.full' else '' end) id", "case when l_suppkey % 5 = 0 then null else concat('page', l_suppkey % 3) end page", "l_quantity weight", "l_tax > 0.01 enabled")


@query(f"""with c as (select *, coalesce(page, id) p, id like '%.desktop.full' f from ({_RUN_CAPTURES}))
 select run, p page, coalesce(max(pos) filter (f), min(pos)) pos from c group by 1, 2""")
def preferred_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.preferred_captures(_run_captures(spark, sf_dir), ["run"]).select("run", "page", "pos")


@query(f"""with c as (select *, coalesce(page, id) p, row_number() over (partition by run, coalesce(page, id) order by weight desc, pos) n from ({_RUN_CAPTURES}) where enabled and pos % 10 <> 2) select run, p page, id from c where n = 1""")
def verifier_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run_captures(spark, sf_dir)
    return manifest.verifier_captures(rows, rows.where("pos % 10 != 2"), ["run"])


@query(f"""with c as ({_RUN_CAPTURES}), d as (select run, coalesce(list(id order by id) filter (pos % 10 = 2), []) missing from c where enabled group by 1) select run, missing from d where len(missing) > 0""")
def missing_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.wanted(_run_captures(spark, sf_dir))
    lost = rows.join(_run_captures(spark, sf_dir).where("pos % 10 != 2").select("run", "id"), ["run", "id"], "left_anti")
    return lost.groupBy("run").agg(F.array_sort(F.collect_list("id")).alias("missing"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey % 1000 when o_orderkey % 3 = 1 then 800 else 1440 end::int width, case when o_orderkey % 3 = 0 then 900 when o_orderkey % 3 = 1 then 600 else 900 end::int height,
 case when o_orderkey % 4 = 0 then o_orderkey % 2 * 100 when o_orderkey % 5 = 0 then 120 else 250 end::int wait_ms, o_orderkey % 2 = 0 or o_orderkey % 3 = 0 full_page from orders""")
def capture_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 3 = 0 then int(o_orderkey % 1000) end w", "int(null) h", "case when o_orderkey % 3 = 1 then 800 end dw", "case when o_orderkey % 3 = 1 then 600 end dh",
        "o_orderkey % 4 = 0 given", "case when o_orderkey % 8 = 0 then null else int(o_orderkey % 2 * 100) end own_ms", "case when o_orderkey % 5 = 0 then 0 else 250 end default_ms",
        "struct(case when o_orderkey % 2 = 0 then true end as fullPage, string(null) as animations, string(null) as caret) own", "struct(case when o_orderkey % 3 = 0 then true end as fullPage, string(null) as animations, string(null) as caret) def",
    )
    view, options = manifest.viewport(*(F.col(c) for c in ("w", "h", "dw", "dh"))), manifest.screenshot_options("own", "def")
    return rows.select("o_orderkey", view["width"].alias("width"), view["height"].alias("height"), manifest.stability_wait(F.col("given"), F.col("own_ms"), F.col("default_ms")).cast("int").alias("wait_ms"), options["fullPage"].alias("full_page"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 500 when o_orderkey % 3 = 1 then o_orderkey else 1440 end::int width, case when o_orderkey % 3 = 0 then 400 when o_orderkey % 3 = 1 then least(900, o_custkey) else 900 end::int height, 'node-' || o_custkey node, o_custkey::bigint node_index from orders")
def style_viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_orderkey % 3 = 0 then 500 end w", "case when o_orderkey % 3 = 0 then 400 end h", "case when o_orderkey % 3 = 1 then o_orderkey end iw", "case when o_orderkey % 3 = 1 then o_custkey end ih", "concat('node-', o_custkey) node")
    view = manifest.style_viewport(*(F.col(c) for c in ("w", "h", "iw", "ih")))
    return rows.select("o_orderkey", view["width"].alias("width"), view["height"].alias("height"), "node", paths.node_index(F.col("node")).alias("node_index"))


@query("""select l_orderkey, l_linenumber, l_partkey % 4 = 0 stamp, (l_suppkey % 3) = 1 and (l_linenumber % 2 = 0 or l_tax > 0.03) actionable, l_partkey % 6 = 0 required, case when l_partkey % 5 = 0 then 'hover' else 'click' end "trigger", case when l_partkey % 7 = 0 then 0 else l_linenumber end settle from lineitem""")
def action_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "case when l_partkey % 4 = 0 then '[data-wde-manifest-id=x]' when l_partkey % 4 = 1 then null else '#a' end s", "case when l_linenumber % 2 = 0 then 'fill' else 'click' end t", "l_suppkey % 3 n", "l_tax > 0.03 v",
        "case when l_partkey % 6 = 0 then array() else array(1) end a", "case when l_partkey % 5 = 0 then 'hover' when l_partkey % 5 = 1 then '' end tt", "case when l_partkey % 7 = 0 then null else l_linenumber end ms",
    )
    start = manifest.trigger_action(F.col("tt"), F.col("s"), F.col("ms"))
    return rows.select("l_orderkey", "l_linenumber", manifest.is_stamp(F.col("s")).alias("stamp"), manifest.is_actionable(F.col("t"), F.col("n"), F.col("v")).alias("actionable"), manifest.is_required(F.col("a")).alias("required"), start["type"].alias("trigger"), start["settleMs"].alias("settle"))


# --- elements and blocks --------------------------------------------------------------------------------------


_ELEMENTS = "select p_partkey, p_brand, p_partkey % 5 text, p_partkey % 3 tag, p_partkey % 4 role, p_size % 6 kind, p_size % 7 name from part"


_WANTED = """select o_orderkey, o_orderkey % 5 text, o_orderkey % 3 tag, o_orderkey % 4 role, o_custkey % 6 kind, o_custkey % 7 name, case when o_orderkey % 3 = 0 then 'scroll' when o_orderkey % 3 = 1 then 'hover' else 'click' end action,
 o_orderkey % 2 = 0 known, o_orderkey % 10 = 0 actionable, case when o_custkey % 5 = 0 then null when o_custkey % 5 = 1 then '' when o_custkey % 5 = 2 then '[data-wde-manifest-id="a"]' else concat('#x', o_orderkey) end selector,
 case when o_custkey % 3 = 0 then 'main' end ancestor, cast(o_orderkey % 4 as int) matches from orders"""
_RESOLVED_SQL = f"""e as ({_ELEMENTS}), o as ({_WANTED}),
 s as (select o_orderkey, p_partkey, round(least(1.0, 0.48 * (e.text = o.text)::int + 0.12 * (e.tag = o.tag)::int + 0.12 * (e.role = o.role)::int + 0.18 * (0.45 * (e.kind = o.kind)::int + 0.35 * (e.name = o.name)::int) + 0.10 * 0.5)::double, 9) score, p_partkey % 11 <> 0 visible, action
   from lineitem join o on o_orderkey = l_orderkey join e on p_partkey = l_partkey)"""


def _resolution(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    struct = lambda t, r, k, n: F.struct(F.col(t).cast("string").alias("tag"), F.col(r).cast("string").alias("role"), F.col(k).cast("string").alias("type"), F.col(n).cast("string").alias("name"), F.lit(None).cast("string").alias("id"))
    e = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 5 et", "p_partkey % 3 a", "p_partkey % 4 b", "p_size % 6 c", "p_size % 7 d").select("p_partkey", "et", struct("a", "b", "c", "d").alias("cand"))
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    wanted = spark.sql(_WANTED)
    o = wanted.select("o_orderkey", F.col("text").alias("ot"), "action", struct("tag", "role", "kind", "name").alias("ref"))
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(o, "o_orderkey").join(e, "p_partkey")
    score = matching.element_score((F.col("et") == F.col("ot")).cast("double"), F.lit(0.5), "ref", "cand", F.col("action"))
    return wanted, pairs.select("o_orderkey", F.col("p_partkey").alias("element"), F.round(score, 9).alias("score"), (F.col("p_partkey") % 11 != 0).alias("visible"))


@query(f"""with {_RESOLVED_SQL}, b as (select o_orderkey, max(score) score, arg_min(p_partkey, (-score, p_partkey)) best from s where visible or action = 'scroll' group by 1),
 j as (select *, coalesce(selector, '') <> '' given, coalesce(selector, '') <> '' and selector not like '[data-wde-manifest-%' own from o left join b using (o_orderkey)),
 k as (select *, own and actionable exact, case when own and not actionable and action = 'hover' then ancestor end up, given and known usable from j),
 f as (select *, case when exact or up is not null then null when not usable then 'selector_missing_or_reference_signature_unavailable' when score is null then 'no_candidate_elements' when score < case action when 'scroll' then 0.25 when 'hover' then 0.3 else 0.45 end then 'no_candidate_element_above_threshold' end failure from k)
 select o_orderkey, case when failure is null then 'resolved' else 'unsupported' end status, case when exact then 'exact_selector' when up is not null then 'visible_ancestor_of_exact_selector' when usable then 'element_match' end "method", case when exact then selector else up end resolved_selector,
  case when not exact and up is null and usable then best end matched, case when exact or up is not null then 1.0 when usable then coalesce(score, 0) else 0 end::double confidence, failure from f""")
def element_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, scored = _resolution(spark, sf_dir)
    return matching.resolve_actions(wanted, scored, ["o_orderkey"]).drop("element")


@query(f"""with {_RESOLVED_SQL}, b as (select o_orderkey, max(score) score, arg_min(p_partkey, (-score, p_partkey)) best from s where visible group by 1),
 k as (select *, coalesce(selector, '') <> '' and matches = 1 exact from o left join b using (o_orderkey)),
 f as (select *, case when exact then null when not known then 'target_selector_missing_or_reference_signature_unavailable' when score is null then 'no_candidate_elements' when score < 0.35 then 'no_candidate_target_above_threshold' end failure from k)
 select o_orderkey, case when failure is null then 'resolved' else 'unsupported' end status, case when exact then 'exact_selector' when known then 'element_match' end "method", case when exact then selector end resolved_selector,
  case when failure is null and not exact then best end element, case when exact then 1.0 when known then coalesce(score, 0) else 0 end::double confidence, failure from f""")
def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, scored = _resolution(spark, sf_dir)
    return matching.resolve_targets(wanted, scored, ["o_orderkey"]).drop("matched")


@query()
def merged_block_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", F.when(F.col("turn") % 2 == 0, "reference").otherwise("candidate").alias("side"), F.col("turn").cast("int").alias("pos"), "text")
    return matching.match_merged_blocks(rows, group="conv_id", minimum=0.1)


@query("select l_orderkey, l_linenumber, o_custkey from lineitem join (select o_orderkey, o_custkey, o_custkey % 4 + 1 n from orders) on o_orderkey = l_orderkey and l_linenumber <= n")
def zipped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.explode(F.sequence(F.lit(1), (F.col("o_custkey") % 4 + 1).cast("int"))).alias("l_linenumber"))
    return matching.zip_frames(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), frames, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "o_custkey")


@query("select c_custkey, model, repeat from customer, (select unnest(['m1', 'm2', 'm3']) model), (select unnest(range(1, 4))::int repeat)")
def judge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.judge_jobs(read(spark, sf_dir, "customer").select("c_custkey"), ["m1", "m2", "m3"], 3)


@query("select c_custkey, best from (select c_custkey, case when c_custkey % 3 = 0 then null else c_custkey * 7 end best from customer) where best is not null and best not in (select o_custkey from orders)")
def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", "case when c_custkey % 3 = 0 then null else c_custkey * 7 end best")
    return matching.unresolved(rows, "best", read(spark, sf_dir, "orders"), "o_custkey").select("c_custkey", "best")


@query("select l_partkey % 100 x, l_suppkey % 50 y from lineitem where l_returnflag = 'R' intersect select l_partkey % 100, l_suppkey % 50 from lineitem where l_returnflag = 'A'")
def shared_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda flag: read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select((F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 50).alias("y"))
    return matching.shared_points(at("R"), at("A"), ["x", "y"])


@query("""with p as (select p_partkey, list_extract(['background-color', 'border-color', 'border-top-color', 'border-left-color', 'color'], (p_partkey % 5 + 1)::int) prop, (p_size * 2)::double w, (p_size + 3)::double h, (p_partkey % 4)::double t, (p_partkey % 3)::double l from part),
 b as (select *, least(greatest(1, w * h), w * least(h, 2 * t) + greatest(0, h - least(h, 2 * t)) * least(w, 2 * l)) border from p)
 select p_partkey, greatest(1, case p_partkey % 5 when 0 then greatest(1, w * h) - border when 1 then border when 2 then w * least(t, h) when 3 then h * least(l, w) else 1 end)::double area from b""")
def colour_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey", "element_at(array('background-color', 'border-color', 'border-top-color', 'border-left-color', 'color'), int(p_partkey % 5) + 1) prop", "double(p_size * 2) w", "double(p_size + 3) h", "double(p_partkey % 4) t", "double(p_partkey % 3) l")
    c = F.col
    return rows.select("p_partkey", geometry.colour_area(c("prop"), c("w"), c("h"), c("t"), c("l"), c("t"), c("l")).alias("area"))


@query("""select p_partkey, case p_partkey % 4 when 0 then round(greatest(0, 1 - abs(p_size - 20) / greatest(p_size, 20, 1)), 6) when 1 then case when p_size % 2 = 0 then 1.0 else round(12.0::double / (12 + length(p_size::varchar)), 6) end when 2 then 1.0 else 0.95 end::double similarity from part""")
def property_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "element_at(array('width', 'text-align', 'border-top-color', 'background-color'), int(p_partkey % 4) + 1) name", "case p_partkey % 4 when 0 then concat(p_size, 'px') when 1 then ' Center' when 2 then 'rgb(1, 2, 3)' else 'rgba(9, 9, 9, 0.5)' end a",
        "case p_partkey % 4 when 0 then '20px' when 1 then case when p_size % 2 = 0 then 'center' else concat('center', p_size) end when 2 then 'rgb(1,2,3)' else 'rgb(9, 9, 9)' end b",
    )
    return rows.select("p_partkey", rounded(style.property_similarity(F.col("name"), F.col("a"), F.col("b"))).alias("similarity"))


# --- summaries --------------------------------------------------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, n, keep: F.when(F.col("l_linenumber") % keep != 0, F.pmod(F.col(c), F.lit(n)) / n)
    names = [*summary.CAPTURE_MEANS.values()]
    values = [part("l_partkey", 7 + i, 2 + i).alias(m) for i, m in enumerate(names)]
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_suppkey") % 4 == 0, 0.0).otherwise(1 - F.col("l_discount")).alias("coverage"), *values)


_METRIC_SQL = ", ".join(f"round(avg(case when l_linenumber % {2 + i} <> 0 then (l_partkey % {7 + i}) / {7 + i}.0::double end), 6) {name}" for i, name in enumerate(summary.CAPTURE_MEANS))


@query(f"""with c as (select l_orderkey run, count(*) capture_count, count(*) filter (l_suppkey % 4 <> 0 and l_discount < 1) covered_capture_count, count(*) filter (l_suppkey % 4 = 0 or l_discount >= 1) missing_capture_count,
  round(avg(case when l_suppkey % 4 = 0 then 0.0 else 1 - l_discount end), 6) manifest_coverage_score, {_METRIC_SQL} from lineitem group by 1),
 a as (select o_orderkey run, 1::bigint animation_count, case when o_orderstatus = 'F' then 1 else 0 end::bigint scored_animation_count from orders),
 t as (select l_orderkey run, round(avg(l_discount), 6) mean_animation_bbox_iou, round(avg(l_tax), 6) mean_animation_motion_delta from lineitem where l_returnflag = 'R' group by 1)
 select c.*, coalesce(animation_count, 0) animation_count, coalesce(scored_animation_count, 0) scored_animation_count, mean_animation_bbox_iou, mean_animation_motion_delta from c left join a using (run) left join t using (run)""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey run", "l_discount bbox_iou", "l_tax motion_delta", "double(null) target_box_pixelmatch", "double(null) color_delta")
    animations = read(spark, sf_dir, "orders").selectExpr("o_orderkey run", "case when o_orderstatus = 'F' then 'scored' end status")
    out = summary.run_summary(_metrics(spark, sf_dir), targets, animations, ["run"])
    means = ["manifest_coverage_score", *summary.CAPTURE_MEANS, "mean_animation_bbox_iou", "mean_animation_motion_delta"]
    return out.select("run", "capture_count", "covered_capture_count", "missing_capture_count", "animation_count", "scored_animation_count", *(rounded(F.col(c)).alias(c) for c in means))


@query("""select o_orderkey, '{"status":"functional","captures":' || o_custkey || ',"mean":' || case when o_orderkey % 2 = 0 then '1' else 'null' end || '}' status from orders""")
def functional_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey captures", "case when o_orderkey % 2 = 0 then 1 end mean")
    return summary.status_line(rows, ["captures", "mean"]).select("o_orderkey", "status")


@query("""with l as (select l_orderkey run, (l_partkey % 7) / 7.0::double pixelmatch, case when l_linenumber > 2 then (l_suppkey % 5) / 5.0::double end vlm, (l_partkey % 9) / 9.0::double bbox from lineitem),
 m as (select run, count(*) matched, avg(pixelmatch) screenshot, avg(vlm) vlm, avg(bbox) block from l group by 1),
 h as (select o_orderkey run, (o_custkey % 4) / 4.0::double dom from orders where o_orderkey % 3 <> 0),
 e as (select o_orderkey run, 7 expected from orders),
 j as (select run, expected, coalesce(matched, 0) matched, screenshot, dom html, block, vlm from e left join m using (run) left join h using (run)),
 w as (select *, (screenshot is not null)::int * 0.35 + (html is not null)::int * 0.15 + (block is not null)::int * 0.30 + (vlm is not null)::int * 0.20 d, coalesce(screenshot, 0) * 0.35 + coalesce(html, 0) * 0.15 + coalesce(block, 0) * 0.30 + coalesce(vlm, 0) * 0.20 v from j)
 select run, matched, round(matched / 7.0::double, 6) coverage, round(case when d > 0 then v / d else 0 end * matched / 7.0::double, 6)::double score from w""")
def final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    part = lambda c, n: F.pmod(F.col(c), F.lit(n)) / n
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), part("l_partkey", 7).alias("pixelmatch"), *(none.alias(m) for m in ("ssim", "clip", "dreamsim", "visual_block", "element_block_pixelmatch", "cssom_block_style")), part("l_partkey", 9).alias("bbox_geometry"), F.when(F.col("l_linenumber") > 2, part("l_suppkey", 5)).alias("vlm"))
    orders = read(spark, sf_dir, "orders")
    pages = orders.where("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("run"), none.alias("bleu_1"), none.alias("rouge_1_recall"), part("o_custkey", 4).alias("f1"))
    out = summary.final_summary(pairs, pages, orders.select(F.col("o_orderkey").alias("run"), F.lit(7).alias("expected")), ["run"])
    return out.select("run", "matched", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("score")).alias("score"))


@query("select l_orderkey, round(avg(case when l_linenumber % 2 = 0 then l_discount end), 6) discount, round(avg(l_tax), 6) tax from lineitem group by 1")
def target_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "case when l_linenumber % 2 = 0 then l_discount end discount", "l_tax tax")
    return summary.target_means(rows, ["l_orderkey"], ["discount", "tax"]).select("l_orderkey", rounded(F.col("discount")).alias("discount"), rounded(F.col("tax")).alias("tax"))


@query("select event_type agent, count(*) calls, round(sum(coalesce(value, 0))::decimal(38, 6), 2)::double cost from events group by rollup (event_type)")
def agent_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("agent"), F.col("value").alias("cost"))
    return summary.costs(rows).select("agent", "calls", F.round(F.col("cost").cast("decimal(38,6)"), 2).cast("double").alias("cost"))


@query("select o_custkey, round(s, 6) std from (select o_custkey, stddev_pop(o_totalprice % 1000) s from orders group by 1) order by s desc, o_custkey limit 12")
def worst_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.stddev_pop(F.col("o_totalprice") % 1000).alias("std"))
    return summary.worst(rows, "std", ["o_custkey"]).select("o_custkey", rounded(F.col("std")).alias("std"))


@query("""with m as (select l_orderkey, l_linenumber, l_discount > 0.02 and l_returnflag <> 'N' due, case when l_partkey % 4 <> 0 then 1.0 end v from lineitem)
 select l_orderkey, coalesce(list(l_linenumber order by l_linenumber) filter (due and v is null), []) missing, count(*) filter (due and v is not null) present,
  case when count(*) filter (due and v is null) > 0 then 'missing_values' when count(*) filter (due and v is not null) = 0 then 'no_values' end problem from m group by 1""")
def metric_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber capture_id", "case when l_discount > 0.02 then 1.0 else 0.0 end coverage", "case when l_returnflag = 'N' then 'unsupported' end status", "false unsupported", "case when l_partkey % 4 <> 0 then 1.0 end value")
    return summary.metric_problems(rows, ["l_orderkey"])


@query("""with e as (select user_id, event_id, ts, case event_type when 'click' then 'start' when 'view' then 'end' else 'error' end ev from events), n as (select *, lead(ev) over w nx, lead(ts) over w later from e window w as (partition by user_id order by ts, event_id))
 select event_id, round(case when nx in ('end', 'error') then epoch_us(later) / 1e6 - epoch_us(ts) / 1e6 end, 3)::double as "seconds", case when nx in ('end', 'error') then nx end ended from n where ev = 'start'""")
def progress_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "ts", "case event_type when 'click' then 'start' when 'view' then 'end' else 'error' end event")
    return summary.timed(rows, ["user_id"]).select("event_id", F.round("seconds", 3).alias("seconds"), "ended")


@query("select c_custkey, n, case when n is null then 'route_missing' end missing_reason from customer left join (select o_custkey c_custkey, count(*) n from orders group by 1) using (c_custkey)")
def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return summary.with_missing(read(spark, sf_dir, "customer").select("c_custkey"), found, "c_custkey", "route_missing")


@query("""select p_partkey page, round(p_retailprice / 3, 3)::double sanity, list_filter([case when p_partkey % 3 = 0 then 'sanity_error' end, case when p_partkey % 5 = 0 then 'access_error' end], lambda x: x is not null) errors from part""")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey page", "p_retailprice / 3 sanity", "case when p_partkey % 3 = 0 then 'x' else '' end sanity_error", "case when p_partkey % 5 = 0 then 'y' end access_error")
    return summary.page_rows(rows, ["sanity"], ["sanity_error", "access_error"])


@query("""with r as (select o_custkey % 20 run, o_orderkey k from orders), c as (select o_custkey % 20 run, o_orderkey k, (o_orderkey % 10) / 10.0::double m from orders where o_orderkey % 4 <> 0)
 select r.run, count(c.k) pairs, coalesce(list(r.k order by r.k) filter (c.k is null), []) missing, round(avg(m), 6) m from r left join c using (run, k) group by 1""")
def capture_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey % 20 run", "o_orderkey k", "(o_orderkey % 10) / 10 m")
    out = summary.capture_set(rows.select("run", "k"), rows.where("k % 4 != 0"), "k", ["m"], ["run"])
    return out.select("run", "pairs", "missing", rounded(F.col("m")).alias("m"))


@query("select c_custkey, case c_custkey % 3 when 0 then 0.25 when 1 then 0.50 else 1.0 end::double weight from customer")
def suggested_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("case c_custkey % 3 when 0 then 'home.desktop.work-dropdown' when 1 then 'contact.desktop.email-focused' else 'home.desktop.full' end")
    return read(spark, sf_dir, "customer").select("c_custkey", summary.suggested_weight(name).alias("weight"))


# --- validation ---------------------------------------------------------------------------------------------------


@query("""with o as (select o_orderkey k, o_orderkey % 600 c, o_orderkey % 12 r, case when o_orderkey % 7 = 0 then ' ' else 'out' end f, case when o_orderkey % 5 = 0 then '' else 'p' end p from orders)
 select k, 'count' rule from o where c not between 1 and 500 union all select k, 'max_concept_rounds' from o where r not between 1 and 10 union all select k, 'max_builder_repair_rounds' from o where r not between 0 and 10
 union all select k, 'output_root' from o where trim(f) = '' union all select k, 'prompt' from o where p = ''""")
def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_orderkey % 600 count", "o_orderkey % 12 max_concept_rounds", "o_orderkey % 12 max_builder_repair_rounds", "int(null) max_parallel_sites", "case when o_orderkey % 7 = 0 then ' ' else 'out' end output_root", "case when o_orderkey % 5 = 0 then '' else 'p' end prompt")
    return validate.broken(rows, "k", validate.request_rules())


@query("""with s as (select l_orderkey k, list(l_linenumber) seeds, list(l_partkey % 8 - 1) samples, count(*) n, min(l_discount) lo, max(l_suppkey) best, list(l_suppkey) ids from lineitem group by 1)
 select k, 'size_matches_seeds' rule from s where k % 8 <> n union all select k, 'dataset_size' from s where k % 8 < 1
 union all select k, 'samples' from s where n < 2 union all select k, 'samples_not_negative' from s where list_min(samples) < 0
 union all select k, 'scores' from s where k % 9 = 0 union all select k, 'best_candidate' from s where k % 4 = 0
 union all select k, 'pages' from s where n < 5 union all select k, 'difficulty' from s where k % 6 = 0
 union all select k, 'issue_context' from s where k % 3 <> 0 and k % 5 = 0""")
def plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_linenumber").alias("site_seeds"), F.collect_list(F.col("l_partkey") % 8 - 1).alias("samples"), F.max("l_suppkey").alias("top"), F.collect_list(F.struct(F.col("l_suppkey").alias("id"), F.lit(0.5).alias("score"))).alias("c"))
    rows = s.selectExpr(
        "k", "site_seeds", "site_seeds pages", "samples", "k % 8 dataset_size", "0 duration", "case when k % 4 = 0 then -1 when k % 4 = 1 then null else top end best_candidate_id", "case when k % 6 = 0 then 'wild' end difficulty",
        "transform(c, x -> named_struct('id', x.id, 'score', case when k % 9 = 0 then 1.5 else x.score end)) candidates", "case when k % 3 = 0 then 'approved' else 'rejected' end status", "array() issues", "case when k % 5 = 0 then array() else array('do') end repair_instructions",
    )
    rules = {**validate.plan_rules(), **validate.timeline_rules(), **validate.critique_rules(), **validate.concept_rules(), **validate.report_rules()}
    return validate.broken(rows, "k", rules)


@query("""select l_orderkey site, case when count(*) = 0 or min(l_tax) > 0.01 then 'approved' else 'rejected' end status, case when min(l_tax) > 0.01 then 1.0 else 0.0 end::double contract, list('m' || l_linenumber order by l_linenumber) repair_instructions from lineitem group by 1""")
def check_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: F.struct(F.concat(F.lit("m"), x.cast("string")).alias("message")))
    return validate.report_of_checks(read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("site")).agg((F.min("l_tax") > 0.01).alias("passed"), issues.alias("issues")))


# --- trees ----------------------------------------------------------------------------------------------------------

_NODES = """select c_nationkey tree, row_number() over (partition by c_nationkey order by c_custkey) - 1 node, c_mktsegment tag from customer"""
_TREE_SQL = f"""with recursive n as ({_NODES}), nodes as (select tree, node, case when node > 0 then (node - 1) // 3 end parent, (node - 1) % 3 place, tag from n),
 found as (select tree, node, parent, tag, 0 depth, '' index from nodes where parent is null union all select c.tree, c.node, c.parent, c.tag, f.depth + 1, f.index || case when f.index = '' then '' else '-' end || c.place from nodes c join found f on f.tree = c.tree and f.node = c.parent)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    node = long(F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tree"), node.alias("node"), F.col("c_mktsegment").alias("tag"))
    return rows.select("tree", "node", F.when(F.col("node") > 0, F.expr("(node - 1) div 3")).alias("parent"), F.pmod(F.col("node") - 1, F.lit(3)).alias("place"), "tag", *(F.lit(v).alias(c) for c, v in (("x", 1.0), ("y", 2.0), ("w", 3.0), ("h", 4.0))))


@query(f"""{_TREE_SQL}, t as (select tree, tag, count(*) n from found group by 1, 2)
 select tree, count(*) node_count, count(*) filter (not exists (select 1 from nodes c where c.tree = found.tree and c.parent = found.node)) leaf_count, max(depth) max_depth,
  (select list(tag || ':' || n order by n desc, tag) from t where t.tree = found.tree) tags from found group by tree""")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return trees.tree_summary(trees.levels(nodes), nodes)


@query(f"""{_TREE_SQL}, kids as (select tree, parent node, list(tag order by place) children from nodes where parent is not null group by 1, 2)
 select tree, node, index, tag, children from found join kids using (tree, node)""")
def tree_style_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.style_rows(trees.levels(_nodes(spark, sf_dir))).select("tree", "node", "index", "tag", "children")


@query()
def tree_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.pseudo_markup(trees.levels(_nodes(spark, sf_dir)), 10.0, 10.0)


# --- pixels -----------------------------------------------------------------------------------------------------------

_PIXELS = "select l_suppkey % 30 image, l_orderkey x, l_linenumber * 100 + l_partkey % 100 y, min(l_partkey % 256) r, min(l_suppkey * 7 % 256) g, min(l_quantity::int * 5 % 256) b, min(l_partkey % 300) k from lineitem group by 1, 2, 3"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 30 image", "l_orderkey x", "l_linenumber * 100 + l_partkey % 100 y", "l_partkey % 256 r", "l_suppkey * 7 % 256 g", "int(l_quantity) * 5 % 256 b", "l_partkey % 300 k")
    return rows.groupBy("image", "x", "y").agg(*(F.min(c).alias(c) for c in ("r", "g", "b", "k")))


@query(f"""with p as ({_PIXELS}), g as (select *, r * 0.2126::double + g * 0.7152::double + b * 0.0722::double grey from p),
 h as (select image, floor(grey) v, count(*) n from g group by 1, 2), t as (select image, sum(n) n from h group by 1),
 e as (select image, -sum(h.n / t.n * log2(h.n / t.n)) entropy from h join t using (image) group by 1),
 s as (select image, stddev_pop(grey) sd, avg((r < 250 or g < 250 or b < 250)::int) nw, avg((r > 8 or g > 8 or b > 8)::int) nb, count(distinct (r, g, b)) / count(*) uniq, max(x) + 1 w, max(y) + 1 h from g group by 1)
 select image, round(entropy, 4)::double entropy, round(sd, 4) grey_std, round(nw, 6) non_white, round(nb, 6) non_black, round(uniq, 6) unique_colours,
  round(0.20 * (w >= 16 and h >= 16)::int + 0.25 * least(sd / 36, 1) + 0.25 * least(nw / 0.08, 1) + 0.20 * least(entropy / 4, 1) + 0.10 * least(nb / 0.95, 1), 4)::double score from s join e using (image)""")
def render_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pixels.render_sanity(_pixels(spark, sf_dir), ["image"])
    places = {"entropy": 4, "grey_std": 4, "non_white": 6, "non_black": 6, "unique_colours": 6, "score": 4}
    return out.select("image", *(F.round(c, n).alias(c) for c, n in places.items()))


@query(f"""with p as ({_PIXELS}), q as (select image, x, y, (r + 50) % 256 r2, case when k < 150 then g else (g + 50) % 256 end g2, (b + k % 60) % 256 b2 from p)
 select image, round(avg((abs(r - r2) + abs(g - g2) + abs(b - b2)) / 3.0::double), 6) mae, round(avg(((r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2) / 3.0::double), 4)::double mse,
  count(*) filter (abs((r + 50) % 256 - r2) <= 8 and abs((g + 50) % 256 - g2) <= 8 and abs((b + 50) % 256 - b2) <= 8) shifted from p join q using (image, x, y) group by 1""")
def pixel_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    q = p.selectExpr("image", "x", "y", "(r + 50) % 256 r", "case when k < 150 then g else (g + 50) % 256 end g", "(b + k % 60) % 256 b")
    errors = pixels.errors(p, q, ["image"]).select("image", rounded(F.col("mae")).alias("mae"), F.round("mse", 4).alias("mse"))
    return errors.join(pixels.recoloured(p, q, ["image"]).groupBy("image").agg(F.count("*").alias("shifted")), "image", "left").fillna(0, ["shifted"])
