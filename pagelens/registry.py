"""Driver queries of the library's own operators, each with DuckDB SQL where SQL can say it.

The driver's tables stand in for captures, elements and metrics by their shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions import geometry, means, paths, style, text
from pagelens.functions.geometry import Box
from pagelens.operators import coverage as cov
from pagelens.operators import blocks, diagnostics, dom, embedding, judge, localize, manifest, matching, motion, replay, reward, sites, text_similarity
from pagelens.sources.sinks import long_metrics, rounded
from pagelens.sources.tables import json_number
from pagelens.streaming import events as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- rewards: a line item is a capture, its order the run -------------------------------------------------


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, n: (F.pmod(F.col(c), F.lit(n)) / n).cast("double")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("capture"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("kind"),
        (1 - F.col("l_discount")).alias("coverage"),
        part("l_partkey", 10).alias("size"), part("l_suppkey", 7).alias("html"),
        F.when(F.col("l_linenumber") % 3 != 0, part("l_partkey", 13)).alias("vlm"),
        F.when(F.col("l_linenumber") % 4 != 0, part("l_partkey", 17)).alias("pixel"),
        F.lit(None).cast("double").alias("block"),
        F.when(F.col("l_linenumber") % 5 != 0, part("l_suppkey", 11)).alias("bbox"),
        part("l_partkey", 19).alias("cssom"), F.when(F.col("l_tax") > 0.02, part("l_partkey", 23)).alias("dreamsim"),
    )


_CAPTURES_SQL = """
captures as (select l_orderkey run, l_linenumber capture, l_quantity weight, l_returnflag kind, 1 - l_discount coverage,
  (l_partkey % 10) / 10.0::double size, (l_suppkey % 7) / 7.0::double html,
  case when l_linenumber % 3 <> 0 then (l_partkey % 13) / 13.0::double end vlm,
  case when l_linenumber % 4 <> 0 then (l_partkey % 17) / 17.0::double end pixel,
  case when l_linenumber % 5 <> 0 then (l_suppkey % 11) / 11.0::double end bbox,
  (l_partkey % 19) / 19.0::double cssom, case when l_tax > 0.02 then (l_partkey % 23) / 23.0::double end dreamsim
  from lineitem),
gated as (select *, not (coalesce(size < 0.4, false) or coalesce(html < 0.4, false) or coalesce(vlm < 0.4, false)) gate_passed from captures),
parts as (select *,
  case when gate_passed then (size is not null)::int * 0.05 + (html is not null)::int * 0.10 + (vlm is not null)::int * 0.20
    + (pixel is not null)::int * 0.05 + (bbox is not null)::int * 0.10 + (cssom is not null)::int * 0.10 + (dreamsim is not null)::int * 0.10
    else 0.70 end::double denominator,
  (coalesce(size, 0) * 0.05 + coalesce(html, 0) * 0.10 + coalesce(vlm, 0) * 0.20 + case when gate_passed then
    coalesce(pixel, 0) * 0.05 + coalesce(bbox, 0) * 0.10 + coalesce(cssom, 0) * 0.10 + coalesce(dreamsim, 0) * 0.10 else 0 end)::double val
  from gated),
scored as (select *, case when denominator > 0 then val / denominator else 0 end before_coverage,
  case when denominator > 0 then val / denominator else 0 end * coverage score from parts)"""


@query(f"with {_CAPTURES_SQL} select run, capture, gate_passed, round(denominator, 6) denominator, round(before_coverage, 6) before_coverage, round(score, 6) score from scored")
def reward_capture_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reward.capture_reward(_captures(spark, sf_dir))
    return rows.select("run", "capture", "gate_passed", *[rounded(F.col(c)).alias(c) for c in ("denominator", "before_coverage", "score")])


@query(f"""with {_CAPTURES_SQL} select kind, round(sum(score * weight) / sum(weight), 6) score, round(sum(score * weight) / sum(weight), 6) score_available,
  count(*) "rows", count(*) filter (gate_passed) gate_passed, round(sum(weight), 6) weight from scored group by kind""")
def reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reward.reward_summary(reward.capture_reward(_captures(spark, sf_dir)), ["kind"])
    return rows.select("kind", rounded(F.col("score")).alias("score"), rounded(F.col("score_available")).alias("score_available"), "rows", "gate_passed", rounded(F.col("weight")).alias("weight"))


@query(f"""with {_CAPTURES_SQL}, modes as (select * from (values ('manifest'), ('equal'), ('suggested')) t(mode)),
 weighted as (select kind, mode, score, case mode when 'manifest' then greatest(0, weight) when 'equal' then 1.0
   else greatest(0, coalesce(case when capture % 2 = 0 then 2.0 end, weight)) end w from scored cross join modes)
 select kind, mode, round(sum(score * w) / sum(w), 6) score from weighted group by kind, mode""")
def reward_weight_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reward.capture_reward(_captures(spark, sf_dir))
    suggested = F.when(F.col("capture") % 2 == 0, 2.0)
    each = rows.withColumn("m", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), reward.capture_weight(m, F.col("weight"), suggested).cast("double").alias("w")) for m in reward.WEIGHT_MODES))))
    return each.groupBy("kind", F.col("m.mode").alias("mode")).agg(rounded(means.weighted_mean(F.col("score"), F.col("m.w"))).alias("score"))


@query("""with a as (select l_orderkey run, l_linenumber capture, (l_partkey % 10) / 10.0::double bbox_iou,
  case when l_linenumber % 2 = 0 then (l_suppkey % 7) / 7.0::double end motion_delta,
  case when l_linenumber % 3 = 0 then (l_partkey % 13) / 13.0::double end delta_pixelmatch, (l_partkey % 11) / 11.0::double pixelmatch,
  case when l_linenumber % 4 <> 0 then (l_suppkey % 9) / 9.0::double end color_delta from lineitem),
 b as (select run, capture, case when motion_delta is null then bbox_iou else (bbox_iou + motion_delta) / 2 end bbox, coalesce(delta_pixelmatch, pixelmatch) pixel, color_delta cssom from a)
 select run, capture, round(bbox, 6) bbox, round(pixel, 6) pixel, round((bbox * 0.10 + pixel * 0.05 + coalesce(cssom, 0) * 0.10) / (0.15 + case when cssom is null then 0 else 0.10 end), 6)::double score from b""")
def reward_animation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, n: (F.pmod(F.col(c), F.lit(n)) / n).cast("double")
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), n.alias("capture"), part("l_partkey", 10).alias("bbox_iou"), F.when(n % 2 == 0, part("l_suppkey", 7)).alias("motion_delta"),
        F.when(n % 3 == 0, part("l_partkey", 13)).alias("delta_pixelmatch"), part("l_partkey", 11).alias("pixelmatch"),
        F.when(n % 4 != 0, part("l_suppkey", 9)).alias("color_delta"), F.lit(None).cast("double").alias("cssom_color"),
    )
    return reward.animation_reward(rows).select("run", "capture", *[rounded(F.col(c)).alias(c) for c in ("bbox", "pixel", "score")])


@query("""select o_orderkey, round(route, 6) route_score, round(action_score, 6) action_score, round(case when resolved then route * coalesce(action_score, 1) else 0 end, 6) coverage from
 (select o_orderkey, case o_orderstatus when 'F' then 1.0 when 'O' then 0.75 else 0.6 end::double route, o_orderpriority not like '1%' resolved from orders) o
 left join (select l_orderkey, avg(1 - l_discount) action_score from lineitem where l_returnflag <> 'N' group by 1) a on a.l_orderkey = o.o_orderkey""")
def coverage_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    routes = read(spark, sf_dir, "orders").select("o_orderkey", F.when(status == "F", 1.0).when(status == "O", 0.75).otherwise(0.6).alias("confidence"), (~F.startswith("o_orderpriority", F.lit("1"))).alias("resolved"))
    actions = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (1 - F.col("l_discount")).alias("contribution"), (F.col("l_returnflag") != "N").alias("scored"))
    return cov.coverage(routes, actions, "o_orderkey").select("o_orderkey", *[rounded(F.col(c)).alias(c) for c in ("route_score", "action_score", "coverage")])


# --- joins and matching ---------------------------------------------------------------------------------


@query("""select c_custkey, case when n is null then c_mktsegment else o_orderstatus end c_mktsegment, n is not null matched from customer
 left join (select o_custkey, max(o_orderstatus) o_orderstatus, count(*) n from orders group by 1) o on o_custkey = c_custkey""")
def capture_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("c_mktsegment"))
    return matching.left_or_default(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), right, "c_custkey", ["c_mktsegment"])


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def capture_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.missing(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")


_PAGE_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


@query(f"""with p as (select page_id, page_id % 7 site, case when {_PAGE_SQL} = '' then '/' else {_PAGE_SQL} end path from pages),
 files as (select distinct site, path from p where page_id % 3 = 0 union select distinct site, '/index.html' from p where site < 5),
 wanted as (select page_id, site, path, '/' || case when ltrim(path, '/') = '' then 'index.html' else ltrim(path, '/') end exact from p)
 select page_id, case when e.path is not null then exact when i.path is not null then '/index.html' end resolved_path,
  case when e.path is not null then 1.0 when i.path is not null then 0.6 else 0.0 end::double confidence,
  case when e.path is not null then 'exact_path' when i.path is not null then 'fallback_page_file' end "method",
  case when e.path is not null then null when i.path is not null then 'exact_path_missing' else 'no_matching_route_file' end failure
 from wanted w left join files e on e.site = w.site and e.path = w.exact left join files i on i.site = w.site and i.path = '/index.html'""")
def route_priority_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    pages = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 7).alias("site"), F.when(path == "", "/").otherwise(path).alias("path"), F.lit(None).cast("string").alias("page"))
    files = pages.where("page_id % 3 = 0").select("site", "path").union(pages.where("site < 5").select("site", F.lit("/index.html")))
    return cov.route_chain(pages, files).select("page_id", "resolved_path", "confidence", "method", "failure")


@query("""with pairs as (select p_partkey, s_suppkey, 1 - abs(p_retailprice - s_acctbal) / greatest(abs(p_retailprice), abs(s_acctbal), 1.0) score
  from part join supplier on p_partkey % 10 = s_suppkey % 10)
 select p_partkey, s_suppkey, round(score, 6) score from (select *, row_number() over (partition by p_partkey order by score desc, s_suppkey) n from pairs) where n = 1 and score >= 0.45""")
def best_match_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_partkey") % 10).alias("g"))
    supplier = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("g"), "s_suppkey", "s_acctbal")
    # the score falls with the distance on either side down to 0, far below the threshold: beyond the nearest none can be better
    pairs = matching.nearest_pairs(part, supplier, "g", "p_retailprice", "s_acctbal", "s_suppkey")
    a, b = F.col("p_retailprice"), F.col("s_acctbal")
    score = 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return matching.best_match(pairs, ["p_partkey"], score, F.col("s_suppkey"), 0.45, ["s_suppkey"]).select("p_partkey", "s_suppkey", rounded(F.col("score")).alias("score"))


@query("select l_orderkey, l_linenumber, l_extendedprice, n::bigint as rank from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) n from lineitem) where n <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.top_k(read(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 3)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", long("rank").alias("rank"))


@query("select user_id, event_type, min(event_id) first_event from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) n from events) where n = 1 group by 1, 2")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ordered_distinct(read(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_event"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id"), F.when(F.col("turn") % 2 == 0, "reference").otherwise("candidate").alias("side"), F.col("turn").cast("int").alias("pos"), "text")


@query()
def block_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_blocks(_blocks(spark, sf_dir), group="conv_id", minimum=0.1)


@query()
def ordered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [(F.pmod(F.col("pos") * k, F.lit(100)) / 100).alias(c) for k, c in ((7, "x"), (13, "y"))] + [F.lit(0.2).alias("w"), F.lit(0.1).alias("h")]
    blocks = _blocks(spark, sf_dir)
    items = blocks.where("side = 'reference'").select("conv_id", "pos", text.normalize_text(F.col("text")).alias("text"), *box)
    elements = blocks.where("side = 'candidate'").select("conv_id", F.col("pos").alias("node"), text.normalize_text(F.col("text")).alias("text"), *box)
    return matching.resolve_in_order(items, elements, group="conv_id", minimum=0.3)


# --- text -------------------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
#: Tokens are counted once a text and once an item; only tokens of both meet, and totals come from the lists' lengths.
_PAIRS_SQL = f"""docs as (select doc_id, doc_id % (select count(*) from benchmark) item_id, coalesce({_TOKENS}, []) c from documents),
 items as (select item_id, {_TOKENS} r from benchmark),
 dn as (select doc_id, item_id, x, count(*) n from (select doc_id, item_id, unnest(c) x from docs) group by 1, 2, 3),
 rn as (select item_id, x, count(*) n from (select item_id, unnest(r) x from items) group by 1, 2),
 met as (select doc_id, item_id, sum(least(dn.n, rn.n)) m, count(*) shared from dn join rn using (item_id, x) group by 1, 2),
 sizes as (select item_id, len(r) rt, (select count(*) from rn where rn.item_id = items.item_id) dr from items),
 s as (select doc_id, item_id, coalesce(m, 0) m, coalesce(shared, 0) shared, len(c) ct, rt, dr from docs join sizes using (item_id) left join met using (doc_id, item_id))"""


def _text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark item whose number its own comes round to."""
    items = read(spark, sf_dir, "benchmark")
    n = items.agg(F.count("*").alias("n"))
    docs = read(spark, sf_dir, "documents").join(F.broadcast(n)).select("doc_id", F.pmod("doc_id", "n").alias("item_id"), F.coalesce(text.words(F.col("text")), F.array()).alias("words"))
    return text_similarity.unigram_scores_of(docs, items.select("item_id", text.words(F.col("text")).alias("words")), "doc_id", "item_id")


@query(f"""with {_PAIRS_SQL} select doc_id, item_id, round(coalesce(case when m = 0 or ct = 0 then 0 else case when ct >= rt then 1 else exp(1 - rt / ct) end * m / ct end, 0), 6)::double bleu_1 from s""")
def text_bleu1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_pairs(spark, sf_dir).select("doc_id", "item_id", rounded(F.col("bleu_1")).alias("bleu_1"))


@query(f"""with {_PAIRS_SQL} select doc_id, item_id, round(coalesce(case when dr = 0 then 0 else shared / dr end, 0), 6)::double rouge_1_recall from s""")
def text_rouge1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_pairs(spark, sf_dir).select("doc_id", "item_id", rounded(F.col("rouge_1_recall")).alias("rouge_1_recall"))


@query(f"select doc_id, array_to_string({_TOKENS}, ' ') normalized, len({_TOKENS})::bigint n_tokens from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize_text(t).alias("normalized"), long(F.size(text.words(t))).alias("n_tokens"))


_STOP = ", ".join(f"'{w}'" for w in text.ROUTE_STOPWORDS)


@query(f"""select page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(url, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'),
 lambda w: length(w) > 1 and not list_contains([{_STOP}], w)))), ' ') tokens from pages""")
def route_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(text.route_tokens(F.col("url")), " ").alias("tokens"))


@query(r"""select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, case when regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) end path,
 regexp_extract(url, '\?([^#]*)', 1) query, regexp_extract(url, '#(.*)$', 1) fragment from pages""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", paths.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query()
def repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_similarity.repeated_chunks(read(spark, sf_dir, "pages"), "page_id", "html")


# --- pages as trees -----------------------------------------------------------------------------------------


@query()
def html_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.inventory(read(spark, sf_dir, "pages"), "page_id", "html", {"heading": 16, "link": 40, "control": 24})


@query()
def dom_subtree_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    last = pages.agg(F.max("page_id").alias("n"))
    pairs = pages.select(F.col("page_id").alias("reference")).join(F.broadcast(last)).select("reference", F.pmod(F.col("reference") + 1, F.col("n") + 1).alias("candidate"))
    return dom.subtree_scores(pairs, dom.subtrees(pages, "page_id", "html"), "page_id")


# --- boxes and styles ------------------------------------------------------------------------------------


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frac = lambda c, n: (F.pmod(F.col(c), F.lit(n)) / n).cast("double")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", frac("l_partkey", 10).alias("ax"), frac("l_suppkey", 10).alias("ay"), frac("l_partkey", 7).alias("aw"), frac("l_suppkey", 7).alias("ah"),
        frac("l_partkey", 9).alias("bx"), frac("l_suppkey", 9).alias("by"), frac("l_partkey", 8).alias("bw"), frac("l_suppkey", 8).alias("bh"),
    )


_BOXES_SQL = """boxes as (select l_orderkey, l_linenumber, (l_partkey % 10) / 10.0::double ax, (l_suppkey % 10) / 10.0::double ay, (l_partkey % 7) / 7.0::double aw, (l_suppkey % 7) / 7.0::double ah,
  (l_partkey % 9) / 9.0::double bx, (l_suppkey % 9) / 9.0::double "by", (l_partkey % 8) / 8.0::double bw, (l_suppkey % 8) / 8.0::double bh from lineitem),
 i as (select *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, "by" + bh) - greatest(ay, "by")) shared from boxes),
 m as (select *, case when aw * ah + bw * bh - shared <= 0 then 0 else shared / (aw * ah + bw * bh - shared) end iou,
  case when aw * ah <= 0 or bw * bh <= 0 then 0 else least(aw * ah, bw * bh) / greatest(aw * ah, bw * bh) end area,
  greatest(0, 1 - greatest(abs(ax + aw / 2 - bx - bw / 2), abs(ay + ah / 2 - "by" - bh / 2))) centre from i)"""


@query(f"with {_BOXES_SQL} select l_orderkey, l_linenumber, round(iou, 6)::double iou, round(case when aw * ah <= 0 then 0 else shared / (aw * ah) end, 6)::double covered from m")
def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = Box.of("a"), Box.of("b")
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", rounded(geometry.iou(a, b)).alias("iou"), rounded(geometry.coverage(a, b)).alias("covered"))


@query(f"with {_BOXES_SQL} select l_orderkey, l_linenumber, round(area, 6)::double area, round(centre, 6)::double centre, round((iou + area + centre) / 3, 6)::double score from m")
def bbox_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = Box.of("a"), Box.of("b")
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", rounded(geometry.area_similarity(a, b)).alias("area"), rounded(geometry.centre_similarity(a, b)).alias("centre"), rounded(geometry.box_similarity(a, b)).alias("score"))


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = lambda k: F.format_string("rgb(%d, %d, %d)", *(F.pmod(F.col("p_partkey") * m + k, F.lit(256)) for m in (3, 7, 11)))
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", rgb(0).alias("a"), rgb(40).alias("b"))


@query("""with c as (select p_partkey, [(p_partkey * m) % 256 for m in [3, 7, 11]] a, [(p_partkey * m + 40) % 256 for m in [3, 7, 11]] b from part)
 select p_partkey, round(0.9 * greatest(0, 1 - sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) / sqrt(195075.0)) + 0.1, 6)::double similarity from c""")
def css_color_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir).select("p_partkey", rounded(style.colour_similarity(style.parse_rgb(F.col("a")), style.parse_rgb(F.col("b")))).alias("similarity"))


@query("""with c as (select p_partkey, 1.0 * p_size a, round(p_retailprice / 50, 2) b from part)
 select p_partkey, round(greatest(0, 1 - abs(a - b) / greatest(abs(a), abs(b), 1.0)), 6)::double similarity from c""")
def css_numeric_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lambda c: F.concat(c.cast("string"), F.lit("px"))
    rows = read(spark, sf_dir, "part").select("p_partkey", px(F.col("p_size")).alias("a"), px(F.round(F.col("p_retailprice") / 50, 2)).alias("b"))
    return rows.select("p_partkey", rounded(style.numeric_similarity(style.parse_number(F.col("a")), style.parse_number(F.col("b")))).alias("similarity"))


@query()
def css_ciede2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir).select("p_partkey", rounded(style.ciede2000_similarity(style.parse_rgb(F.col("a")), style.parse_rgb(F.col("b")))).alias("similarity"))


# --- timelines ----------------------------------------------------------------------------------------------


@query("""with f as (select user_id, ts, event_id, value x, event_id % 50 y, value * 0.9 + 3 cx, event_id % 47 cy from events),
 d as (select *, x - lag(x) over w dx, y - lag(y) over w dy, cx - lag(cx) over w dcx, cy - lag(cy) over w dcy from f window w as (partition by user_id order by ts, event_id)),
 m as (select *, sqrt(dx * dx + dy * dy) r, sqrt(dcx * dcx + dcy * dcy) c, sqrt((dcx - dx) ** 2 + (dcy - dy) ** 2) e from d),
 s as (select *, case when r <= 1 and c <= 1 then 1 when r <= 1 then 0 else greatest(0, 1 - e / r) end s, case when r <= 1 and c <= 1 then 0 when r <= 1 then c else r end w from m where r is not null)
 select u.user_id, round(case when coalesce(sum(w), 0) > 0 then sum(s * w) / sum(w) else 1 end, 6)::double motion_delta, round(coalesce(sum(w), 0), 4)::double movement_weight
 from (select distinct user_id from events) u left join s using (user_id) group by 1""")
def motion_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    size = [F.lit(10.0).alias(c) for c in ("rw", "rh", "cw", "ch")]
    frames = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", v.alias("rx"), (e % 50).cast("double").alias("ry"), (v * 0.9 + 3).alias("cx"), (e % 47).cast("double").alias("cy"), *size)
    out = motion.motion_scores(frames, ["user_id"], ["ts", "event_id"])
    return out.select("user_id", rounded(F.col("motion_delta")).alias("motion_delta"), rounded(F.col("movement_weight"), 4).alias("movement_weight"))


@query("""with f as (select user_id, ts, event_id, event_id % 256 r, event_id * 3 % 256 g, event_id * 7 % 256 b, event_id * 2 % 256 cr, event_id * 3 % 251 cg, event_id * 5 % 256 cb, 1 + event_id % 9 area from events),
 d as (select *, r - first(r) over w dr, g - first(g) over w dg, b - first(b) over w db, cr - first(cr) over w dcr, cg - first(cg) over w dcg, cb - first(cb) over w dcb from f
   window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)),
 m as (select *, sqrt((dr * dr + dg * dg + db * db)::double) size, sqrt(((dcr - dr) ** 2 + (dcg - dg) ** 2 + (dcb - db) ** 2)::double) e from d)
 select user_id, round(sum(greatest(0, 1 - e / size) * size * area) / sum(size * area), 6)::double color_delta, count(*) changed_frames from m where size > 1 group by 1""")
def color_delta_first_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    colour = lambda *c: F.array(*(x.cast("double") for x in c))
    frames = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", colour(e % 256, e * 3 % 256, e * 7 % 256).alias("ref"), colour(e * 2 % 256, e * 3 % 251, e * 5 % 256).alias("cand"), (1 + e % 9).cast("double").alias("area"))
    out = motion.colour_delta(frames, ["user_id"], ["ts", "event_id"])
    return out.select("user_id", rounded(F.col("color_delta")).alias("color_delta"), "changed_frames")


@query("""select date_trunc('hour', ts) start, event_type stage, count(*) runs, round(sum(value), 4)::double total, round(avg(value), 6)::double mean from events group by 1, 2""")
def stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.stage_windows(read(spark, sf_dir, "events"), stage="event_type", seconds="value", window="1 hour")
    return out.select("start", "stage", "runs", rounded(F.col("total"), 4).alias("total"), rounded(F.col("mean")).alias("mean"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end new from events),
 s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) n from g)
 select user_id, min(ts) "begin", max(ts) "last", count(*) events from s group by user_id, n""")
def quiet_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.quiet_periods(read(spark, sf_dir, "events"), "user_id")


# --- groups -------------------------------------------------------------------------------------------------


@query("""with c as (select p_brand, p_type, count(*) n, min(p_partkey) f from part group by 1, 2),
 r as (select *, row_number() over (partition by p_brand order by n desc, f) k, sum(n) over (partition by p_brand) total from c)
 select p_brand, p_type majority, n majority_count, total::bigint total, (total - n)::bigint inconsistent, round(greatest(0, least(100, (1 - log2(1 + (total - n) / (total + 1.0))) * 100)), 6)::double score from r where k = 1 and total > 1""")
def majority_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.consistency(read(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_partkey")
    return out.select("p_brand", "majority", "majority_count", "total", "inconsistent", rounded(F.col("score")).alias("score"))


@query("""with g as (select p_brand, p_size % 20 g, count(*) members, count(distinct p_type) > 1 a, max(p_retailprice) - min(p_retailprice) > 500 b from part group by 1, 2 having count(*) > 1)
 select p_brand, g::bigint g, members, (a::int + b::int)::bigint failed, greatest(0.0, 100.0 - 25.0 * (a::int + b::int))::double score from g""")
def uniformity_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").withColumn("g", long(F.col("p_size") % 20))
    out = diagnostics.uniformity(rows, ["p_brand", "g"], ["p_type"], ["p_retailprice"], 500.0)
    return out.select("p_brand", "g", "members", long("failed").alias("failed"), F.col("score").cast("double").alias("score"))


@query("""select p_brand, array_to_string(list_sort(list_distinct(list(t) filter (t is not null))), ',') tags from
 (select p_brand, unnest([case when p_size > 45 then 'large' end, case when p_retailprice < 950 then 'cheap' end, case when p_name like '%zz%' then 'odd' end]) t from part) group by 1""")
def group_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {"large": F.col("p_size") > 45, "cheap": F.col("p_retailprice") < 950, "odd": F.contains("p_name", F.lit("zz"))}
    return diagnostics.tags(read(spark, sf_dir, "part"), ["p_brand"], conditions).select("p_brand", F.array_join("tags", ",").alias("tags"))


@query()
def alignment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.alignment_errors(read(spark, sf_dir, "part").withColumn("x", F.col("p_retailprice").cast("double")), group="p_brand", value="x", tolerance=6.0)


@query("""with r as (select l_returnflag model, l_linestatus candidate, l_linenumber rep, avg(case when l_tax > 0 then l_discount end) m, count(*) filter (l_tax <= 0) e from lineitem group by 1, 2, 3)
 select model, candidate, round(avg(m), 6)::double mean, round(stddev_pop(m), 6)::double std, round(min(m), 6)::double min, round(max(m), 6)::double max, count(*) repeats, sum(e)::bigint errors from r group by 1, 2""")
def judge_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("candidate"), F.col("l_linenumber").alias("rep"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("s"))
    out = judge.variability(runs, ["model", "candidate"], "rep", "s")
    return out.select("model", "candidate", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")], "repeats", "errors")


@query("""with s as (select doc_id, [((doc_id * k) % 101) / 10.0::double for k in [3, 5, 7, 11, 13, 17, 19, 23, 29, 31]] x from documents),
 c as (select doc_id, [greatest(0, least(10, v)) for v in x] x from s),
 g as (select doc_id, (x[1] + x[2] + x[3] + x[4]) / 40 visual, (x[5] + x[6]) / 20 content, (x[7] + x[8]) / 20 layout, (x[9] + x[10]) / 20 overall from c)
 select doc_id, round(visual, 6)::double visual, round(content, 6)::double content, round(layout, 6)::double layout, round(overall, 6)::double overall, round((visual + content + layout + overall) / 4, 6)::double overall_mean from g""")
def judge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat_ws(", ", *((F.pmod(F.col("doc_id") * k, F.lit(101)) / 10).cast("string") for k in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)))
    rows = read(spark, sf_dir, "documents").select("doc_id", judge.ten_scores(answer).alias("s"))
    return rows.select("doc_id", *[rounded(c).alias(name) for name, c in judge.group_scores(F.col("s")).items()])


@query("select event_type, count(*) runs, round(sum(value), 4)::double total, round(avg(value), 6)::double mean, count(*) filter (value is null) errors from events group by 1")
def stage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge.stage_profile(read(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "runs", rounded(F.col("total"), 4).alias("total"), rounded(F.col("mean")).alias("mean"), "errors")


@query("select event_id, case when coalesce(json_extract_string(props, '$.error'), '') in ('', 'false', '0', 'null') then try_cast(json_extract_string(props, '$.k') as double) end k from events")
def json_path_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", json_number(F.col("props"), "k").alias("k"))


@query("select l_orderkey::varchar || '-' || l_linenumber::varchar as key, unnest(['l_discount', 'l_tax']) as name, unnest([l_discount, l_tax])::double as value from lineitem")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return long_metrics(rows, "key", ["l_discount", "l_tax"])


@query("""with e as (select vec_id, label, [x::double for x in embedding] v from embeddings),
 first as (select label, min(vec_id) vec_id from embeddings group by 1), q as (select e.label, v from e join first using (label, vec_id))
 select e.vec_id, round(1 - list_sum([e.v[i] * q.v[i] for i in range(1, len(q.v) + 1)]) / sqrt(list_sum([x * x for x in e.v])) / sqrt(list_sum([x * x for x in q.v])), 6)::double + 0.0 distance from e join q using (label)""")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(first, "label").select("vec_id", (rounded(1 - embedding.cosine(F.col("embedding"), F.col("q"))) + 0.0).alias("distance"))


# --- manifests ----------------------------------------------------------------------------------------------


@query("select o_orderkey, case when list_contains(t, 0) then t else list_prepend(0, t) end times from (select o_orderkey, list_sort(list_distinct([o_custkey % 5 * 100, o_orderkey % 7 * 50, 300]))::bigint[] t from orders)")
def animation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.array(long(F.col("o_custkey") % 5 * 100), long(F.col("o_orderkey") % 7 * 50), F.lit(300).cast("long")).alias("samples"), F.lit(None).cast("long").alias("duration"))
    return rows.select("o_orderkey", manifest.sample_times("duration", "samples").alias("times"))


@query("select c_custkey, nation, lpad(row_number() over (partition by nation order by c_custkey)::varchar, 4, '0') number from (select c_custkey, n_name nation from customer join nation on c_nationkey = n_nationkey)")
def numbered_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return manifest.numbered(rows.select("c_custkey", F.col("n_name").alias("nation")), ["nation"], "c_custkey", 4)


@query("""with a as (select event_id, user_id, event_type, value - 50 ref_scroll, value * 0.2 cand_scroll, case when event_id % 3 = 0 then 't' || (event_id % 4)::varchar end ref_active, case when event_id % 5 <> 0 then 't' || (event_id % 2)::varchar end cand_active from events),
 p as (select *, case when event_type = 'view' then case when abs(ref_scroll) <= 8 or abs(cand_scroll) > 8 then 1.0 else 0.0 end
  when event_type = 'click' then case when ref_active is not null then (ref_active is not distinct from cand_active)::int else (cand_active is not null)::int end else 1.0 end::double post_state from a)
 select event_id, post_state, round(post_state * (event_id % 4) / 4.0, 6)::double contribution from p""")
def action_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.col("event_type")
    none = F.lit(None).cast("array<string>")
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "view", "scroll").when(kind == "click", "click").otherwise("wait").alias("type"), (F.col("value") - 50).alias("ref_scroll"), (F.col("value") * 0.2).alias("cand_scroll"),
        F.when(e % 3 == 0, F.concat(F.lit("t"), e % 4)).alias("ref_active"), F.when(e % 5 != 0, F.concat(F.lit("t"), e % 2)).alias("cand_active"),
        none.alias("ref_texts_before"), none.alias("ref_texts_after"), F.lit("").alias("cand_text"), ((e % 4) / 4).alias("confidence"), F.lit("completed").alias("status"),
    )
    return replay.contributions(replay.post_state(rows)).select("event_id", "post_state", rounded(F.col("contribution")).alias("contribution"))


@query("""with l as (select l_orderkey k, l_linenumber n, (l_partkey % 900)::double x, (l_suppkey % 700)::double y, 20.0 + l_partkey % 300 w, 20.0 + l_suppkey % 200 h, case when l_linenumber = 1 then 'html' else 'div' end tag
  from (select l_orderkey, l_linenumber, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey from lineitem group by 1, 2)),
 m as (select a.k, a.n cluster, b.n node, b.tag, greatest(0, least(a.x + a.w / 2, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h / 2, b.y + b.h) - greatest(a.y, b.y)) s, a.w * a.h / 4 ca, b.w * b.h ea from l a join l b on a.k = b.k where a.n % 3 = 0),
 r as (select *, 0.55 * s / ca + 0.30 * s / (ca + ea - s) + 0.15 * s / ea score, min((tag = 'html')::int) over (partition by k, cluster) roots from m where s > 0),
 k as (select *, row_number() over (partition by k, cluster order by score desc, node) as rn from r where tag <> 'html' or roots = 1)
 select k, cluster, node, round(score, 6)::double score from k where rn <= 5""")
def dom_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    w, h = (20.0 + F.col("l_partkey") % 300), (20.0 + F.col("l_suppkey") % 200)
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    lines = rows.select(F.col("l_orderkey").alias("k"), n.alias("n"), (F.col("l_partkey") % 900).cast("double").alias("x"), (F.col("l_suppkey") % 700).cast("double").alias("y"), w.alias("w"), h.alias("h"), F.when(n == 1, "html").otherwise("div").alias("tag"))
    clusters = lines.where("n % 3 = 0").select("k", F.col("n").alias("cluster"), F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("w") / 2).alias("cw"), (F.col("h") / 2).alias("ch"))
    elements = lines.select("k", F.col("n").alias("node"), "tag", *[F.col(c).alias(f"e{c}") for c in "xywh"])
    return localize.localize(clusters, elements, "k").select("k", "cluster", "node", rounded(F.col("score")).alias("score"))


@query("""with g as (select l_orderkey % 50 g, l_linenumber x, l_suppkey % 3 y, list(l_returnflag || l_linestatus order by l_orderkey, l_partkey, l_shipdate) t, min(l_orderkey) pos from lineitem group by 1, 2, 3)
 select g, x, y::bigint y, pos, len(t)::bigint parts, array_to_string(t, ' ') "text" from g""")
def blocks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("g"), F.col("l_linenumber").alias("x"), (F.col("l_suppkey") % 3).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"), F.struct("l_orderkey", "l_partkey", "l_shipdate").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.array(F.lit(0.0)).alias("colour"))
    out = blocks.merge_by_box(lines, ["g"])
    return out.select("g", "x", "y", F.col("pos.l_orderkey").alias("pos"), long(F.size(F.split("text", " "))).alias("parts"), "text")


@query(f"""with {_BOXES_SQL} select l_orderkey, round(case when sum(aw * ah) > 0 then sum(iou * aw * ah) / sum(aw * ah) else 0 end + 1e-9, 6)::double iou,
 round(case when sum(aw * ah) > 0 then sum((iou + area + centre) / 3 * aw * ah) / sum(aw * ah) else 0 end + 1e-9, 6)::double score from m group by 1""")
def block_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _boxes(spark, sf_dir).select("l_orderkey", *[F.col(f"a{c}").alias(f"r{c}") for c in "xywh"], *[F.col(f"b{c}").alias(f"c{c}") for c in "xywh"], F.lit(1.0).alias("covered"))
    return blocks.box_geometry(pairs, ["l_orderkey"]).select("l_orderkey", rounded(F.col("iou") + 1e-9).alias("iou"), rounded(F.col("score") + 1e-9).alias("score"))  # off the halves


@query("""with recursive links as (select n_regionkey site, n_nationkey src, (n_nationkey * 7 + 3) % 25 dst from nation),
 r as (select n_regionkey site, n_nationkey path, 0 steps from nation where n_nationkey % 5 = 0 union select r.site, l.dst, r.steps + 1 from r join links l on l.site = r.site and l.src = r.path where r.steps < 24)
 select site, path, min(steps) steps from r group by 1, 2""")
def reachable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    links = nation.select(F.col("n_regionkey").alias("site"), F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return sites.reachable(nation.where("n_nationkey % 5 = 0").select(F.col("n_regionkey").alias("site"), F.col("n_nationkey").alias("path")), links)


@query(r"""select page_id, case when p like '/%' then 'absolute' when list_contains(string_split(p, '/'), '..') then 'parent_part' when regexp_extract(p, '\.([^./]+)$', 1) not in ('html', 'css', 'js', 'json', 'svg', 'txt', 'md') then 'unsupported_type' end problem
 from (select page_id, case page_id % 5 when 0 then regexp_replace(url, '^[a-z]+://[^/]*', '') when 1 then '../' || page_id::varchar || '.html' when 2 then page_id::varchar || '.exe' else 'p/' || page_id::varchar || '.html' end p from pages)""")
def path_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    path = F.when(i % 5 == 0, F.regexp_replace("url", "^[a-z]+://[^/]*", "")).when(i % 5 == 1, F.concat(F.lit("../"), i, F.lit(".html"))).when(i % 5 == 2, F.concat(i, F.lit(".exe"))).otherwise(F.concat(F.lit("p/"), i, F.lit(".html")))
    return read(spark, sf_dir, "pages").select("page_id", sites.path_problem(path).alias("problem"))


@query()
def semantic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("site", F.col("page_id") % 5)
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    captures = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("capture"), "site", path.alias("path"), F.lit(None).cast("string").alias("page"), title.alias("intent"))
    headings = F.filter("page.items", lambda x: x["name"].isin("h1", "h2", "h3") & (x["kind"] == "heading"))
    parsed = pages.where("page_id % 2 = 1").select("site", path.alias("path"), title.alias("title"), dom.parse_page(F.col("html")).alias("page"))
    routes = parsed.select("site", "path", "title", F.array_join(headings["detail"], " ").alias("headings"), F.col("page.text").alias("body"))
    return sites.semantic_routes(captures, routes)
