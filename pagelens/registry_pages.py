"""Driver queries of pictures, metric payloads, animations and markup, registered beside those of pagelens.registry."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions.paths import json_payload
from pagelens.operators import animation, crops, cssom, judge, layout, markup, payload, repeats, source_scan, tiles, trees
from pagelens.plans import evaluate
from pagelens.registry import oracle_sql, queries, query, read
from pagelens.registry_planning import _TREE_SQL, tree_markup
from pagelens.sources.sinks import rounded

__all__ = ["oracle_sql", "queries"]

# --- pictures: each supplier is a page drawn twice, a disc with a smooth rim that the second drawing moves a little --------

_WIDTH, _HEIGHT = "24 + s_suppkey % 17", "20 + s_suppkey % 13"
_DISTANCE = f"sqrt((x + 5e-1 - (({_WIDTH}) * 5e-1 + (s_suppkey % 7) * 1e-1 + side * 4e-1)) * (x + 5e-1 - (({_WIDTH}) * 5e-1 + (s_suppkey % 7) * 1e-1 + side * 4e-1)) + (y + 5e-1 - ({_HEIGHT}) * 5e-1) * (y + 5e-1 - ({_HEIGHT}) * 5e-1))"
_COVER = f"greatest(0e0, least(1e0, 5 + s_suppkey % 6 - {_DISTANCE} + 5e-1))"
_SHADES = (
    "cast(case when side = 1 and s_suppkey % 3 = 0 and x between 2 and 11 and y between 2 and 10 then 0 else floor(230 + (s_suppkey % 60 - 230) * cover + 5e-1) end as int) r",
    "cast(case when side = 1 and (x * 31 + y * 17 + s_suppkey) % 97 = 0 then 0 else floor(240 + (s_suppkey * 7 % 90 - 240) * cover + 5e-1) end as int) g",
    "cast(floor(250 + (s_suppkey * 3 % 50 - 250) * cover + 5e-1) as int) b",
)
_DRAWN = f"""cells as (select s_suppkey, side, x, unnest(range({_HEIGHT})) y from (select s_suppkey, side, unnest(range({_WIDTH})) x from supplier, (values (0), (1)) s(side))),
 px as (select side, s_suppkey image, x, y, {', '.join(_SHADES)} from (select *, {_COVER} cover from cells)),
 dims as (select image, max(x) + 1 w, max(y) + 1 h from px group by 1)"""


def _drawn(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    pages = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{side} side", f"explode(sequence(0L, {_WIDTH} - 1)) x")
    cells = pages.selectExpr("*", f"explode(sequence(0L, {_HEIGHT} - 1)) y").selectExpr("*", f"{_COVER} cover")
    return cells.selectExpr("s_suppkey image", "x", "y", *_SHADES)


_YIQ_SQL = "{0} * 0.29889531::double + {1} * 0.58662247::double + {2} * 0.11448223::double"
_DIFFERENCE_SQL = f"""pairs as (select a.image, a.x, a.y, (a.r - b.r)::double dr, (a.g - b.g)::double dg, (a.b - b.b)::double db from px a join px b on a.image = b.image and a.x = b.x and a.y = b.y where a.side = 0 and b.side = 1),
 parts as (select image, x, y, {_YIQ_SQL.format("dr", "dg", "db")} p, dr * 0.59597799::double - dg * 0.27417610::double - db * 0.32180189::double q, dr * 0.21147017::double - dg * 0.52261711::double + db * 0.31114694::double s from pairs),
 differ as (select image, x, y from parts where 0.5053::double * p * p + 0.299::double * q * q + 0.1957::double * s * s > 352.15)"""


#: Differing pixels of px (side, image, x, y, r, g, b) in pictures of the sizes dims, and whether they lie on a smoothed edge.
_MARKED_SQL = f"""{_DIFFERENCE_SQL},
 steps as (select dx, dy from (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy) where dx <> 0 or dy <> 0),
 near as (select p.side, p.image, p.x, p.y, n.x nx, n.y ny, {_YIQ_SQL.format("(p.r - n.r)", "(p.g - n.g)", "(p.b - n.b)")} delta, p.r = n.r and p.g = n.g and p.b = n.b same
  from px p, steps join px n on n.side = p.side and n.image = p.image and n.x = p.x + dx and n.y = p.y + dy),
 sums as (select side, image, x, y, (x in (0, any_value(w) - 1) or y in (0, any_value(h) - 1))::int rim, count(*) filter (same) equal, count(*) filter (delta = 0) zero, min(delta) lo, max(delta) hi,
   arg_min({{'x': nx, 'y': ny}}, (delta, nx, ny)) lo_at, arg_min({{'x': nx, 'y': ny}}, (-delta, nx, ny)) hi_at from near join dims using (image) group by 1, 2, 3, 4),
 calm as (select image, x, y, bool_and(rim + equal > 2) calm from sums group by 1, 2, 3),
 marked as (select d.image, d.x, d.y, bool_or(s.rim + s.zero <= 2 and s.lo < 0 and s.hi > 0 and (l.calm or u.calm)) aa from differ d join sums s using (image, x, y)
   join calm l on l.image = d.image and l.x = s.lo_at.x and l.y = s.lo_at.y join calm u on u.image = d.image and u.x = s.hi_at.x and u.y = s.hi_at.y group by 1, 2, 3)"""


@query(f"""with {_DRAWN}, {_MARKED_SQL}
 select image, w * h total_pixels, count(aa) filter (not aa) diff_pixels, count(aa) filter (aa) aa_pixels, round(count(aa) filter (not aa) / (w * h), 6) diff_ratio, round(1 - count(aa) filter (not aa) / (w * h), 6) score
  from dims left join marked using (image) group by image, w, h""")
def pixelmatch_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.pixelmatch(_drawn(spark, sf_dir, 0), _drawn(spark, sf_dir, 1), ["image"])
    return out.select("image", "total_pixels", "diff_pixels", "aa_pixels", rounded(F.col("diff_ratio")).alias("diff_ratio"), rounded(F.col("score")).alias("score"))


_NEW_WIDTH, _NEW_HEIGHT = "10 + image % 23", "12 + image % 19"
_KINDS = ("lanczos", "box", "bilinear")
_SINC = "(case when {0} = 0 then 1e0 else sin(pi() * {0}) / (pi() * {0}) end)"


def _resize_sql(source: str, along: str, other: str, size_in: str, size_out: str) -> str:
    """SQL for one axis: source has image, kind, the two axes, w, h, nw, nh, r, g, b."""
    sums = ", ".join(f"case when any_value({size_in}) = any_value({size_out}) then max({c}) else greatest(0, least(255, (sum({c} * k)::bigint + 2097152) >> 22)) end::int {c}" for c in "rgb")
    return f"""(select image, s.kind, o {along}, {other}, any_value(w) w, any_value(h) h, any_value(nw) nw, any_value(nh) nh, {sums} from {source} s join taps t
   on t.kind = s.kind and t.si = s.{size_in} and t.so = s.{size_out} and t.a = s.{along} and (s.{size_in} <> s.{size_out} or t.o = s.{along}) group by image, s.kind, o, {other})"""


@query(f"""with {_DRAWN}, first as (select px.*, case image % 3 when 0 then 'lanczos' when 1 then 'box' else 'bilinear' end kind, w, h, {_NEW_WIDTH} nw, {_NEW_HEIGHT} nh from px join dims using (image) where side = 0),
 pairs as (select distinct kind, w si, nw so from first union select distinct kind, h, nh from first),
 outs as (select *, greatest(si * 1e0 / so, 1e0) scale, (o + 5e-1) * (si * 1e0 / so) center from (select *, unnest(range(so)) o from pairs)),
 spans as (select *, scale * case kind when 'lanczos' then 3e0 when 'box' then 5e-1 else 1e0 end reach from outs),
 taken as (select *, unnest(range(greatest(0, trunc(center - reach + 5e-1))::int, least(si, trunc(center + reach + 5e-1))::int)) a from spans),
 placed as (select *, (a - center + 5e-1) * (1 / scale) v from taken),
 raw as (select *, case kind when 'box' then (v > -5e-1 and v <= 5e-1)::int::double when 'bilinear' then greatest(0e0, 1 - abs(v)) when 'lanczos' then case when v >= -3 and v < 3 then {_SINC.format("v")} * {_SINC.format("(v / 3)")} else 0e0 end end f from placed),
 taps as (select kind, si, so, o, a, case when f < 0 then ceil(f / total * 4194304 - 5e-1) else floor(f / total * 4194304 + 5e-1) end::bigint k from (select *, sum(f) over (partition by kind, si, so, o) total from raw)),
 across as {_resize_sql("first", "x", "y", "w", "nw")}, down as {_resize_sql("across", "y", "x", "h", "nh")}
 select image, x, y, r, g, b from down""")
def resized_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = _drawn(spark, sf_dir, 0)
    sizes = pictures.select("image").distinct().selectExpr("image", f"{_NEW_WIDTH} width", f"{_NEW_HEIGHT} height")
    out = None
    for i, kind in enumerate(_KINDS):
        part = F.pmod("image", F.lit(3)) == i
        now = tiles.resize(pictures.where(part), ["image"], sizes.where(part), kind)
        out = now if out is None else out.unionByName(now)
    return out


_CLUSTER_SQL = f"""{_DRAWN}, {_DIFFERENCE_SQL}, marks as (select image, x, y, y * 4294967296 + x code from differ),
 steps as (select dx, dy from (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy) where dx <> 0 or dy <> 0),
 links as (select m.image, m.code a, n.code b from marks m, steps join marks n on n.image = m.image and n.x = m.x + dx and n.y = m.y + dy),
 flow(image, code, root) using key (image, code) as (select image, code, code from marks
   union (select l.image, l.b, min(f.root) from flow f join links l on l.image = f.image and l.a = f.code join recurring.flow r on r.image = l.image and r.code = l.b where f.root < r.root group by 1, 2)),
 areas as (select image, root, min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, count(*) area from marks join flow using (image, code) group by 1, 2 having count(*) >= 64),
 found as (select image, row_number() over (partition by image order by area desc, root) rank, x, y, areas.w, areas.h, area, round(area / (dims.w * dims.h), 6) area_ratio from areas join dims using (image))"""


@query(f"with recursive {_CLUSTER_SQL} select * from found")
def difference_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.difference_clusters(_drawn(spark, sf_dir, 0), _drawn(spark, sf_dir, 1), ["image"])
    return out.select("image", "rank", "x", "y", "w", "h", "area", rounded(F.col("area_ratio")).alias("area_ratio"))


@query(f"""with recursive {_CLUSTER_SQL}, counts as (select image, count(*) diff_pixels from differ group by 1), clusters as (select image, count(*) cluster_count from found group by 1),
 rows as (select image, coalesce(diff_pixels, 0) diff_pixels, coalesce(diff_pixels, 0) / (w * h) ratio, coalesce(cluster_count, 0) cluster_count from dims left join counts using (image) left join clusters using (image))
 select image, diff_pixels, round(ratio, 6) diff_ratio, cluster_count, list_filter([case when diff_pixels > 0 then 'visual_diff' end, case when cluster_count > 0 then 'visual_diff_cluster' end, case when ratio >= 0.05 then 'large_visual_diff' end], lambda t: t is not null) tags from rows""")
def difference_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.tagged_differences(_drawn(spark, sf_dir, 0), _drawn(spark, sf_dir, 1), ["image"])
    return out.withColumn("diff_ratio", rounded(F.col("diff_ratio")))

# --- metric payloads: an order is a run, its first four lines captures, the others animations ------------------------------

#: A line's item as JSON text; numbers, texts, flags and missing parts change with the line.
_CAPTURE_JSON = """case when l_partkey % 22 = 0 then concat('{"coverage":{"score":', 1 - l_discount, '},"metrics":{"status":"unsupported","reason":"no_page"}}')
 when l_partkey % 11 = 0 then concat('{"coverage":{"score":', 1 - l_discount, '},"metrics":"broken","missing_reason":"lost"}')
 else concat('{"capture":{', case when l_linenumber = 3 then '' else concat('"weight":', l_quantity - 10) end, '},"coverage":{"score":', 1 - l_discount, '},"metrics":{"status":"scored",',
  '"screenshot_size_match":{"score":', l_partkey % 10 / 10D, '},"html_text":{"bleu_1":', l_suppkey % 7 / 7D, ',"rouge_1_recall":', l_partkey % 9 / 9D, '},',
  '"vlm_judge":{"overall":', l_partkey % 8 / 8D, case when l_suppkey % 5 = 0 then ',"skipped":true' else '' end, '},',
  '"pixelmatch":{"score":', l_suppkey % 9 / 9D, case l_partkey % 6 when 0 then ',"error":"timeout"' when 1 then ',"error":""' else '' end, '},',
  '"visual_block":{"score":', l_partkey % 4 / 4D, ',"block_pixelmatch":{"score":', l_suppkey % 11 / 11D, '}', case when l_suppkey % 8 = 0 then ',"unsupported":1' else '' end, '},',
  case when l_partkey % 7 = 0 then '' else concat('"bbox_geometry":{"score":', l_suppkey % 6 / 6D, '},') end,
  '"cssom_block_style":{"score":', case when l_suppkey % 4 = 0 then concat('"', l_partkey % 5 / 5D, '"') else string(l_partkey % 5 / 5D) end, '},',
  '"dreamsim":{"score":', l_suppkey % 3 / 3D, ',"unsupported":', l_partkey % 9 = 0, '}}}') end"""
_ANIMATION_JSON = """concat('{"animation":{"weight":', l_quantity / 10, '},"metrics":{"status":"', case when l_partkey % 6 = 0 then 'unsupported","reason":"no_timeline' else 'scored' end,
 '","targets":[{"scores":{"motion":{"bbox_iou":', l_partkey % 10 / 10D, ',"motion_delta":', case when l_suppkey % 3 = 0 then 'null' else string(l_suppkey % 7 / 7D) end, '},"color":{"target_box_pixelmatch":', l_partkey % 11 / 11D, '}}},',
 '{"scores":{"color":{"color_delta":', l_suppkey % 9 / 9D, case when l_suppkey % 2 = 0 then '' else concat(',"target_box_delta_pixelmatch":', l_partkey % 13 / 13D) end, '}}}]}}')"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, payload): the metrics of each order as the JSON text a run writes."""
    lines = read(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount")))
    items = lines.selectExpr("l_orderkey run", "l_linenumber > 4 moves", "concat('\"', l_linenumber, '.', n, '\":') id", f"case when l_linenumber > 4 then {_ANIMATION_JSON} else {_CAPTURE_JSON} end item")
    listed = lambda moves: F.array_join(F.sort_array(F.collect_list(F.when(F.col("moves") == moves, F.concat("id", "item")))), ",")
    return items.groupBy("run").agg(F.concat(F.lit('{"captures":{'), listed(False), F.lit('},"animations":{'), listed(True), F.lit("}}")).alias("payload"))


_W = {"size": 0.05, "html": 0.1, "vlm": 0.2, "pixel": 0.05, "block": 0.0, "bbox": 0.1, "cssom": 0.1, "dreamsim": 0.1}
_PARTS_SQL = ", ".join(f"case when scored and d > 0 and {c} is not null and {'true' if c in ('size', 'html', 'vlm') else 'passed'} then {c} * {w}::double / d else 0 end {c}_part" for c, w in _W.items())
_PAYLOAD_SQL = f"""l as (select *, l_orderkey run, l_linenumber || '.' || row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_discount) item_id, l_linenumber > 4 moves from lineitem),
 o as (select run, item_id, moves, case when moves then l_partkey % 6 <> 0 else l_partkey % 11 <> 0 end scored, greatest(0, case when moves then l_quantity / 10 when l_linenumber = 3 or l_partkey % 11 = 0 then 1 else l_quantity - 10 end)::double weight,
   case when moves then null when l_partkey % 22 = 0 then 'no_page' when l_partkey % 11 = 0 then 'lost' end lost,
   case when moves then (l_partkey % 6 <> 0)::int::double else (1 - l_discount)::double end coverage,
   case when not moves then l_partkey % 10 / 10.0::double end size, case when not moves then (l_suppkey % 7 / 7.0::double + l_partkey % 9 / 9.0::double) / 2 end html, case when not moves and l_suppkey % 5 <> 0 then l_partkey % 8 / 8.0::double end vlm,
   case when moves and l_suppkey % 2 = 0 then l_partkey % 11 / 11.0::double when moves then l_partkey % 13 / 13.0::double when l_partkey % 6 <> 0 then l_suppkey % 9 / 9.0::double end pixel,
   case when not moves and l_suppkey % 8 <> 0 then l_partkey % 4 / 4.0::double end block, case when not moves and l_suppkey % 8 <> 0 then l_suppkey % 11 / 11.0::double end block_pixel,
   case when moves and l_suppkey % 3 = 0 then l_partkey % 10 / 10.0::double when moves then (l_partkey % 10 / 10.0::double + l_suppkey % 7 / 7.0::double) / 2 when l_partkey % 7 <> 0 then l_suppkey % 6 / 6.0::double end bbox,
   case when moves then l_suppkey % 9 / 9.0::double when l_suppkey % 4 <> 0 then l_partkey % 5 / 5.0::double end cssom, case when not moves and l_partkey % 9 <> 0 then l_suppkey % 3 / 3.0::double end dreamsim from l),
 c as (select run, item_id, moves, scored, weight, coverage, case when moves and not scored then 'no_timeline' when not scored then lost end reason, {", ".join(f"case when scored then {c} when not moves then 0.0 end {c}" for c in _W)},
   case when scored and not moves then pixel end global_pixel, case when scored then block_pixel end block_pixel from o),
 g as (select *, scored and coalesce(size, 1) >= 0.4 and coalesce(html, 1) >= 0.4 and coalesce(vlm, 1) >= 0.4 passed from c),
 h as (select *, case when not scored then 0 when passed then {" + ".join(f"({c} is not null)::int * {w}::double" for c, w in _W.items())} else 0.7 end d from g),
 items as (select *, {_PARTS_SQL} from h),
 rows as (select *, {" + ".join(f"{c}_part" for c in _W)} before_coverage from items), scores as (select *, before_coverage * coverage score from rows)"""


@query(f"""with {_PAYLOAD_SQL} select run, item_id, case when moves then 'animation' else 'capture' end item_type, weight, case when scored then 'scored' else 'unsupported' end status, reason, passed gate_passed,
 case when not scored and moves then 0 else coalesce((size < 0.4)::int, 0) + coalesce((html < 0.4)::int, 0) + coalesce((vlm < 0.4)::int, 0) end gate_fails, {", ".join(f"round({c}, 9)::double {c}" for c in (*_W, "global_pixel", "block_pixel", "coverage", "before_coverage", "score"))}
 from scores""")
def payload_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payload.item_rewards(_payloads(spark, sf_dir), ["run"])
    return rows.select("run", "item_id", "item_type", "weight", "status", "reason", "gate_passed", F.size("gate_failures").alias("gate_fails"), *(rounded(F.col(c), 9).alias(c) for c in (*payload.COMPONENTS, "coverage", "before_coverage", "score")))


_ALL_MEANS = ("score", "before_coverage", "coverage", *(f"{c}_part" for c in _W))


@query(f"""with {_PAYLOAD_SQL} select run, {", ".join(f"round(coalesce(case when sum(weight) > 0 then sum({c} * weight) / sum(weight) else 0 end, 0), 9)::double {c}" for c in _ALL_MEANS)},
 {", ".join(f"round(case when sum(weight) filter ({c} is not null) > 0 then sum({c} * weight) / sum(weight) filter ({c} is not null) end, 9)::double {c}" for c in (*_W, "global_pixel", "block_pixel"))},
 count(*) items, count(*) filter (scored) scored_items, count(*) filter (not moves) captures, count(*) filter (moves) animations, count(*) filter (moves and scored) scored_animations, count(*) filter (passed) gate_passed,
 {", ".join(f"count(*) filter ({c} is null and (scored or moves)) {c}_unavailable" for c in _W)} from scores group by run""")
def payload_run_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = payload.run_reward(payload.item_rewards(_payloads(spark, sf_dir), ["run"]), ["run"])
    return out.withColumns({c: rounded(F.col(c), 9) for c in (*_ALL_MEANS, *payload.COMPONENTS)})

# --- animations: a user is an animation, each event a frame of one of its targets on one side ------------------------------

_CHANNELS = "case when {0} % 5 = 0 then array() when {0} % 5 = 1 then array('motion') when {0} % 5 = 2 then array('color') else array('motion', 'color') end"
_RGB_TEXT = "concat('rgb(', {0} % 256, ', ', {0} * 3 % 256, ', ', {0} * 7 % 256, ')')"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = "event_id"
    return read(spark, sf_dir, "events").selectExpr(
        "user_id animation", f"case when {e} div 3 % 2 = 0 then 'reference' else 'candidate' end side", f"cast({e} % 3 as int) target", "struct(ts, event_id) frame", f"concat('target ', {e} % 3) name",
        f"array_distinct({_CHANNELS.format('user_id')}) channels", "value x", f"double({e} % 50) y", f"double(20 + {e} % 30) w", f"double(10 + {e} % 20) h",
        f"map_filter(map('color', {_RGB_TEXT.format(e)}, 'background-color', {_RGB_TEXT.format(f'({e} * 5)')}, 'Transform', concat('scale( ', {e} % 2, ')'), 'border-top-color', if({e} % 5 = 0, null, {_RGB_TEXT.format(f'({e} * 11)')})), (k, v) -> v is not null) style",
        f"double({e} % 4) top", "1D right", f"double({e} % 3) bottom", "double(null) left",
    )


_FRAME_SQL = """e as (select user_id animation, event_id // 3 % 2 side, (event_id % 3)::int target, ts, event_id, user_id % 5 kind, value x, event_id % 50 y, 20 + event_id % 30 w, 10 + event_id % 20 h from events),
 f as (select *, row_number() over (partition by animation, side, target order by ts, event_id) n from e),
 sides as (select animation, count(distinct side) = 2 both_ from f group by 1),
 t as (select animation, target, max('target ' || target) filter (side = 0) as name, count(distinct side) = 2 both_, any_value(kind) kind from f where n = 1 group by 1, 2),
 targets as (select animation, target, name, both_ and kind in (1, 3, 4) moves, both_ and kind in (2, 3, 4) paints, case when not both_ or kind = 0 then []::varchar[] when kind = 1 then ['motion'] when kind = 2 then ['color'] else ['color', 'motion'] end channels from t),
 z as (select r.animation, r.target, r.n, r.event_id re, c.event_id ce, r.x, r.y, r.w, r.h, c.x cx, c.y cy, c.w cw, c.h ch from f r join f c on c.animation = r.animation and c.target = r.target and c.n = r.n and c.side = 1 where r.side = 0),
 i as (select *, greatest(0, least(x + w, cx + cw) - greatest(x, cx)) * greatest(0, least(y + h, cy + ch) - greatest(y, cy)) common, x + w / 2.0::double mx, y + h / 2.0::double my, cx + cw / 2.0::double nx, cy + ch / 2.0::double ny from z),
 s as (select *, mx - lag(mx) over v dx, my - lag(my) over v dy, nx - lag(nx) over v ex, ny - lag(ny) over v ey from i window v as (partition by animation, target order by n)),
 q as (select *, sqrt(dx * dx + dy * dy) rm, sqrt(ex * ex + ey * ey) cm, sqrt((ex - dx) ** 2 + (ey - dy) ** 2) err from s),
 m as (select animation, target, avg(common / (w * h + cw * ch - common)) bbox_iou, coalesce(sum(case when rm <= 1 then 0 else greatest(0, 1 - err / rm) * rm end) / nullif(sum(case when rm <= 1 and cm <= 1 then 0 when rm <= 1 then cm else rm end), 0), 1) motion_delta from q group by 1, 2),
 p as (select z.*, prop, case prop when 'color' then re when 'background-color' then re * 5 else re * 11 end rv, case prop when 'color' then ce when 'background-color' then ce * 5 else ce * 11 end cv,
   prop <> 'border-top-color' or re % 5 <> 0 rt, prop <> 'border-top-color' or ce % 5 <> 0 ct from z, (values ('color'), ('background-color'), ('border-top-color'), ('transform')) o(prop)),
 b as (select *, first(rv) over v r0, first(cv) over v c0, first(rt) over v r0t, first(ct) over v c0t from p window v as (partition by animation, target, prop order by n rows between unbounded preceding and current row)),
 d as (select *, rt and ct and r0t and c0t known, rv % 256 - r0 % 256 a1, rv * 3 % 256 - r0 * 3 % 256 a2, rv * 7 % 256 - r0 * 7 % 256 a3, cv % 256 - c0 % 256 b1, cv * 3 % 256 - c0 * 3 % 256 b2, cv * 7 % 256 - c0 * 7 % 256 b3 from b where rt or ct),
 g as (select *, sqrt((a1 * a1 + a2 * a2 + a3 * a3)::double) size, sqrt(((b1 - a1) ** 2 + (b2 - a2) ** 2 + (b3 - a3) ** 2)::double) off,
   least(re % 4 + re % 3, h) rows_, case when prop = 'background-color' then greatest(1, w * h - least(w * h, w * least(re % 4 + re % 3, h) + greatest(0, h - least(re % 4 + re % 3, h)) * least(w, 2))) when prop = 'border-top-color' then greatest(1, w * least(re % 4, h)) else 1 end area from d),
 k as (select *, case when prop = 'transform' then (re % 2 = ce % 2)::int::double when known and size > 1 then greatest(0, 1 - off / size) end score, case when prop <> 'transform' and known and size > 1 then size * area end weight from g),
 c as (select animation, target, n, avg(score) mean, sum(score * weight) total, sum(weight) weight from k group by 1, 2, 3),
 colours as (select animation, target, case when sum(weight) > 0 then sum(total) / sum(weight) else avg(mean) end color_delta from c group by 1, 2),
 found as (select animation, target, name, channels, case when moves then bbox_iou end bbox_iou, case when moves then motion_delta end motion_delta, case when paints then color_delta end color_delta from targets left join m using (animation, target) left join colours using (animation, target))"""


@query(f"""with {_FRAME_SQL} select animation, target, name, channels, round(bbox_iou, 9) bbox_iou, round(motion_delta, 9)::double motion_delta, round(color_delta, 9)::double color_delta from found""")
def animation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = animation.animation_targets(_frames(spark, sf_dir), ["animation"])
    return out.select("animation", "target", "name", "channels", *(rounded(F.col(c), 9).alias(c) for c in ("bbox_iou", "motion_delta", "color_delta")))


@query(f"""with {_FRAME_SQL}, a as (select animation, any_value(both_) both_, avg(bbox_iou) bbox_iou, avg(motion_delta) motion_delta, avg(color_delta) color_delta from sides left join found using (animation) group by 1),
 h as (select animation, both_, case when both_ then (bbox_iou + motion_delta) / 2 end bbox, case when both_ then color_delta end cssom from a)
 select animation, case when both_ then 'scored' else 'unsupported' end status, case when not both_ then 'animation_timeline_missing' end reason, round(bbox, 9)::double bbox, round(cssom, 9)::double cssom,
  (both_ and (bbox is not null or cssom is not null))::int::double coverage,
  round(coalesce((coalesce(bbox, 0) * 0.1 + coalesce(cssom, 0) * 0.1) / nullif((bbox is not null)::int * 0.1 + (cssom is not null)::int * 0.1, 0), 0), 9)::double score from h""")
def animation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = animation.animation_pairs(_frames(spark, sf_dir), ["animation"])
    return out.select("animation", "status", "reason", "coverage", *(rounded(F.col(c), 9).alias(c) for c in ("bbox", "cssom", "score")))

# --- markup back to tables ----------------------------------------------------------------------------------------------------


@query(f"{_TREE_SQL} select tree, index, depth, tag, 1 x, 2 y, 3 w, 4 h from found")
def markup_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = markup.markup_nodes(tree_markup(spark, sf_dir), ["tree"], width=10, height=10)
    return trees.levels(nodes).select("tree", "index", "depth", "tag", "x", "y", "w", "h")


@query("""select p_partkey, case when p_partkey < 4096 then printf('%02X%02X%02X', (15 - p_partkey // 256) * 16 + 10, (15 - p_partkey // 16 % 16) * 16 + 10, (15 - p_partkey % 16) * 16 + 10) end colour,
 case when p_partkey < 4096 then printf('%02X%02X%02X', ((15 - p_partkey // 256) * 16 + 60) % 256, ((15 - p_partkey // 16 % 16) * 16 + 60) % 256, ((15 - p_partkey % 16) * 16 + 60) % 256) end shifted from part""")
def pool_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", markup.pool_colour(place).alias("colour"), markup.pool_colour(place, 50).alias("shifted"))


@query()
def text_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.text_colours(read(spark, sf_dir, "pages"), ["page_id"])

# --- blank areas ----------------------------------------------------------------------------------------------------------------


@query(f"""with {_DRAWN}, s as (select image, x, y, floor(((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16)) v from px where side = 1), c as (select image, x, y, floor((v + 40) / 80.0::double)::int band from s),
 f as (select *, case when lag(band) over k is distinct from band then y end start from c window k as (partition by image, x order by y)),
 h as (select *, y - max(start) over (partition by image, x order by y) + 1 run from f),
 e as (select a.image, a.x, a.y, any_value(a.band) band, any_value(a.run) run, max(o.x) filter (o.x < a.x and (o.band <> a.band or o.run < a.run)) lo, min(o.x) filter (o.x > a.x and (o.band <> a.band or o.run < a.run)) hi from h a join h o on o.image = a.image and o.y = a.y group by 1, 2, 3),
 r as (select image, y, band, run, coalesce(lo, -1) + 1 l, coalesce(hi, w) u, w, dims.h height from e join dims using (image)),
 t as (select *, run * (u - l) area, row_number() over (partition by image order by run * (u - l) desc, band, y, u, run desc) p from r)
 select image, l x, y - run + 1 y, u - l w, run h, area, round(area / (w * height) * 100, 6) sparsity_rate, round(least(100, sqrt(greatest(0, 100 - area / (w * height) * 100)) * 10), 6) score,
  case when area / (w * height) * 100 >= 25 then ['large_blank_region'] else [] end tags from t where p = 1""")
def layout_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.layout_sparsity(_drawn(spark, sf_dir, 1), ["image"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("sparsity_rate", "score")})


# --- crops: each page has three pairs of blocks, the last of some without area --------------------------------------------------

_BLOCK_WIDTH = f"case when block = 2 and s_suppkey % 5 = 0 then 0e0 else 7e0 / ({_WIDTH}) end"
_PAIRS = (
    "s_suppkey image", "block", f"(2 + 5 * block) * 1e0 / ({_WIDTH}) rx", f"3e0 / ({_HEIGHT}) ry", f"{_BLOCK_WIDTH} rw", f"8e0 / ({_HEIGHT}) rh",
    f"(2 + 5 * block + s_suppkey % 2) * 1e0 / ({_WIDTH}) cx", f"3e0 / ({_HEIGHT}) cy", f"{_BLOCK_WIDTH} cw", f"8e0 / ({_HEIGHT}) ch", "5e-1 + (s_suppkey % 4) * 1e-1 covered",
)


@query(f"""with {_DRAWN.replace("px as", "whole as").replace("from px", "from whole").replace("dims as", "sizes as")}, matched as (select {', '.join(_PAIRS)} from supplier, (values (0), (1), (2)) b(block)),
 boxes as (select image, block, side, case when side = 0 then 2 + 5 * block else 2 + 5 * block + image % 2 end l, not (block = 2 and image % 5 = 0) ok from matched, (values (0), (1)) s(side)),
 px as (select w.side, w.image * 3 + block image, x - l x, y - 3 y, r, g, b from whole w join boxes o on o.image = w.image and o.side = w.side where ok and x >= l and x < l + 7 and y >= 3 and y < 11),
 dims as (select image, 7 w, 8 h from (select distinct image from px)), {_MARKED_SQL},
 scores as (select image // 3 image, image % 3 block, 1 - count(aa) filter (not aa) / 56 score from dims left join marked using (image) group by dims.image),
 common as (select *, greatest(0, least(rx + rw, cx + cw) - greatest(rx, cx)) * greatest(0, least(ry + rh, cy + ch) - greatest(ry, cy)) i, rw * rh ra, cw * ch ca from matched),
 j as (select common.*, score, case when ra + ca - i > 0 then i / (ra + ca - i) else 0 end iou, case when ra <= 0 or ca <= 0 then 0 else least(ra, ca) / greatest(ra, ca) end likeness, greatest(0, 1 - greatest(abs(rx + rw / 2 - cx - cw / 2), abs(ry + rh / 2 - cy - ch / 2))) centre from common left join scores using (image, block)),
 g as (select image, coalesce(sum(score * ra) / nullif(sum(ra) filter (score is not null), 0), 0) m, count(*) pair_count, count(score) scored_pair_count, coalesce(sum(ra) filter (score is not null), 0) a, any_value(covered) covered,
   coalesce(sum(iou * ra) / nullif(sum(ra), 0), 0) iou, coalesce(sum(likeness * ra) / nullif(sum(ra), 0), 0) area, coalesce(sum(centre * ra) / nullif(sum(ra), 0), 0) centre from j group by 1)
 select image, round(m, 9)::double matched_pixelmatch, round(m * covered, 9)::double pixelmatch_score, pair_count, scored_pair_count, round(a, 9)::double weighted_area, round(iou, 9)::double iou, round(area, 9)::double area, round(centre, 9)::double centre,
  round((iou + area + centre) / 3 * covered, 9)::double geometry_score from g""")
def block_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "explode(sequence(0, 2)) block").selectExpr(*_PAIRS)
    out = crops.block_scores(pairs, _drawn(spark, sf_dir, 0), _drawn(spark, sf_dir, 1), ["image"], "block")
    return out.withColumns({c: rounded(F.col(c), 9) for c in ("matched_pixelmatch", "pixelmatch_score", "weighted_area", "iou", "area", "centre", "geometry_score")})

# --- the whole evaluation: an order is a capture of its customer's run ------------------------------------------------------------

_VALUES = {"size": "o_custkey % 10 / 10", "vlm": "o_orderkey % 7 / 7", "pixel": "o_orderkey % 9 / 9", "block": "o_custkey % 4 / 4", "bbox": "o_orderkey % 11 / 11", "cssom": "o_custkey % 5 / 5", "dreamsim": "o_orderkey % 3 / 3", "bleu_1": "o_custkey % 7 / 7", "rouge_1": "o_orderkey % 13 / 13", "tree_bleu": "o_custkey % 3 / 3", "f1": "o_orderkey % 6 / 6"}
_SKIPPED = {"vlm": "o_orderkey % 5 = 0", "pixel": "o_custkey % 6 = 0", "tree_bleu": "o_orderkey % 4 = 0", "dreamsim": "o_custkey % 9 = 0"}
_EVALUATED_SQL = f"""routes as (select o_orderkey, o_custkey, case o_orderstatus when 'F' then 1.0 when 'O' then 0.75 else 0.6 end::double confidence, o_orderpriority not like '1%' resolved, (o_custkey % 3)::double weight,
   {", ".join(f"case when {_SKIPPED.get(c, 'false')} then null else ({e.split(' / ')[0]}) / {e.split(' / ')[1]}.0::double end {c}" for c, e in _VALUES.items())} from orders),
 acts as (select l_orderkey o_orderkey, avg((1 - l_discount)::double) a from lineitem where l_returnflag <> 'N' group by 1),
 cov as (select routes.*, case when resolved then confidence * coalesce(a, 1) else 0 end coverage, list_avg(list_filter([bleu_1, rouge_1, tree_bleu, f1], lambda x: x is not null)) html from routes left join acts using (o_orderkey)),
 seen as (select * replace ({", ".join(f"case when coverage > 0 then {c} end as {c}" for c in ("size", "html", "vlm", "pixel", "block", "bbox", "cssom", "dreamsim"))}) from cov),
 gate as (select *, coalesce(size, 1) >= 0.4 and coalesce(html, 1) >= 0.4 and coalesce(vlm, 1) >= 0.4 passed from seen),
 sums as (select *, case when passed then {" + ".join(f"coalesce({c}, 0) * {w}::double" for c, w in _W.items())} else {" + ".join(f"coalesce({c}, 0) * {_W[c]}::double" for c in ("size", "html", "vlm"))} end v,
   case when passed then {" + ".join(f"({c} is not null)::int * {w}::double" for c, w in _W.items())} else 0.7 end d from gate),
 done as (select *, case when d > 0 then v / d else 0 end before_coverage, case when d > 0 then v / d else 0 end * coverage score from sums)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    routes = orders.select("o_orderkey", F.when(status == "F", 1.0).when(status == "O", 0.75).otherwise(0.6).alias("confidence"), (~F.startswith("o_orderpriority", F.lit("1"))).alias("resolved"))
    actions = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (1 - F.col("l_discount")).cast("double").alias("contribution"), (F.col("l_returnflag") != "N").alias("scored"))
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.expr(f"double({e})").alias("value"), F.expr(f"if({_SKIPPED.get(c, 'false')}, 'skipped', 'ok')").alias("status")) for c, e in _VALUES.items()))
    metrics = orders.select("o_orderkey", F.explode(each).alias("m")).select("o_orderkey", "m.*")
    captures = orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 3).cast("double").alias("weight"))
    return evaluate.evaluate(captures, routes, actions, metrics, key="o_orderkey")


@query(f"""with {_EVALUATED_SQL} select o_orderkey, round(coverage, 9)::double coverage, round(html, 9) html, passed gate_passed, round(before_coverage, 9)::double before_coverage, round(score, 9)::double score from done""")
def evaluate_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("o_orderkey", "gate_passed", *(rounded(F.col(c), 9).alias(c) for c in ("coverage", "html", "before_coverage", "score")))


@query(f"""with {_EVALUATED_SQL} select o_custkey, round(case when sum(weight) > 0 then sum(score * weight) / sum(weight) else 0 end, 9)::double score, round(case when sum(weight) > 0 then sum(score * weight) / sum(weight) end, 9)::double score_available,
 count(*) "rows", count(*) filter (passed) gate_passed, sum(weight) weight from done group by 1""")
def evaluate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.summarize(_evaluated(spark, sf_dir), None, ["o_custkey"])
    return out.withColumns({c: rounded(F.col(c), 9) for c in ("score", "score_available")})


# --- source files: each page is a file of its host's site, with a style rule and scripts put where the page has its own -----------

_RULE_TEXT = "concat('.a', cast(page_id as string), ',', chr(10), '#b[x=y] { color: red;', chr(10), ' transition: all 1s }', chr(10), '@media (x) {', chr(10), ' p { transform: none } }', chr(10), '@keyframes f { opacity: 0 } p{margin:', cast(page_id % 9 as string), '}')"
_SCRIPT_TEXT = "concat(chr(10), 'menu', cast(page_id % 5 as string), '.classList.', case page_id % 3 when 0 then 'add' when 1 then 'remove' else 'toggle' end, '(', chr(10), chr(39), 'on', chr(39), ', ', chr(34), 'k', cast(page_id % 7 as string), chr(34), ');', chr(10), 'x.addEventListener(', chr(10), chr(39), 'click', chr(39), ', f); y.onfocus = g; track(')"
_SOURCE_COLUMNS = (
    "regexp_extract(url, '://([^/?#]*)', 1) site",
    "case page_id % 5 when 0 then concat(cast(page_id as string), '/index.html') when 1 then concat('p', cast(page_id as string), '.CSS') when 2 then concat('p', cast(page_id as string), '.tsx') when 3 then concat('p', cast(page_id as string), '.md') else concat('p', cast(page_id as string), '.js') end path",
    f"replace(replace(html, 'p{{margin:0}}', {_RULE_TEXT}), 'track(', {_SCRIPT_TEXT}) text",
)
_SCAN = source_scan
_HANDLER_SQL, _MUTATION_SQL = (x.replace("'", "''") for x in (_SCAN.HANDLER, _SCAN.MUTATION))
_SPACE_SQL = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_BREAKS_SQL = "length({0}) - length(replace({0}, chr(10), ''))"
_AROUND_SQL = f"left(array_to_string(list_transform(range(greatest(1, line - {_SCAN.RADIUS}), least(len(lines), line + {_SCAN.RADIUS}) + 1), lambda n: n::varchar || ': ' || lines[n]), chr(10)), {_SCAN.SNIPPET})"


def _matches_sql(name: str, pattern: str) -> str:
    """Rows of a pattern's matches, with the lines before each."""
    before = _BREAKS_SQL.format("array_to_string(list_concat(pieces[1:place], found[1:place - 1]), '')")
    return f"""{name}_all as (select site, path, string_split(text, chr(10)) lines, regexp_extract_all(text, '{pattern}') found, regexp_split_to_array(text, '{pattern}') pieces from scripts),
 {name}_at as (select *, unnest(range(1, least(len(found), 80) + 1)) place from {name}_all), {name} as (select site, path, lines, place, found[place] match, 1 + {before} line from {name}_at)"""


_SOURCES_SQL = f"sources as (select {', '.join(_SOURCE_COLUMNS).replace('as string', 'as varchar')} from pages)"
#: Signs in the table looked_at (site, path, text).
_EVIDENCE_SQL = rf"""typed as (select *, lower(regexp_extract(path, '\.([^./]+)$', 1)) kind_of from looked_at),
 scripts as (select * from typed where kind_of in ('js', 'jsx', 'ts', 'tsx', 'html')),
 pieces as (select site, path, string_split(text, '}}') pieces from typed where kind_of in ('css', 'html', 'jsx', 'tsx')),
 piece as (select *, unnest(range(1, len(pieces))) place_of from pieces), parted as (select *, string_split(pieces[place_of], '{{') parts from piece),
 ruled as (select *, {_SPACE_SQL.format("parts[-2]")} selector, {_SPACE_SQL.format("parts[-1]")} body, 1 + {_BREAKS_SQL.format("array_to_string(pieces[1:place_of - 1], '')")} + {_BREAKS_SQL.format("array_to_string(parts[1:len(parts) - 2], '')")} line
  from parted where len(parts) > 1 and regexp_matches(parts[-1], '{_SCAN.MOVING}')),
 rules as (select *, row_number() over (partition by site, path order by place_of) place from ruled where selector <> '' and not starts_with(selector, '@')),
 {_matches_sql("handlers", _HANDLER_SQL)}, {_matches_sql("mutations", _MUTATION_SQL)},
 evidence as (select site, path, 'rule' kind, place, line, left(selector, {_SCAN.SELECTOR}) "name", null::varchar operation,
   list_sort(list_distinct(list_concat(regexp_extract_all(selector, '[#.][A-Za-z_][\w-]*|\[[^\]]+\]|[A-Za-z][\w-]*'), regexp_extract_all(body, '([A-Za-z-]+)\s*:', 1))))[1:32] details, left(selector || ' {{ ' || body || ' }}', {_SCAN.RULE}) evidence from rules where place <= 80
  union all select site, path, 'handler', place, line, regexp_extract(match, '({_SCAN.EVENTS})', 1), null, [], {_AROUND_SQL} from handlers
  union all select site, path, 'mutation', place, line, regexp_extract(match, '{_MUTATION_SQL}', 1), regexp_extract(match, '{_MUTATION_SQL}', 2), regexp_extract_all(regexp_extract(match, '{_MUTATION_SQL}', 3), '[''"]([^''"]+)[''"]', 1)[1:{_SCAN.CLASSES}], {_AROUND_SQL} from mutations)"""


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").selectExpr("page_id", *_SOURCE_COLUMNS)


@query(f"""with {_SOURCES_SQL}, looked_at as (select * from sources), {_EVIDENCE_SQL} select site, path, kind, place::int place, line::int line, "name", operation, array_to_string(details, ' ') details, evidence from evidence""")
def animation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_scan.animation_evidence(_source_files(spark, sf_dir), ["site"], "path", "text")
    return out.withColumn("details", F.array_join("details", " "))


@query(f"""with {_SOURCES_SQL}, looked_at as (select * from sources qualify row_number() over (partition by site order by case when regexp_extract(path, '[^/]*$') in ('index.html', 'styles.css', 'script.js') then 0 else 1 end, path) <= 24), {_EVIDENCE_SQL}
 select site, count(distinct path) file_count, count(*) filter (kind = 'rule') css_rules, count(*) filter (kind = 'mutation') js_mutations, count(*) filter (kind = 'handler') event_handlers from evidence group by 1""")
def animation_source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_scan.first_files(_source_files(spark, sf_dir), "site", "path")
    return source_scan.evidence_totals(source_scan.animation_evidence(files, ["site"], "path", "text"), "site", "path")


@query("""with p as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) site, case when page_id % 11 = 0 then 'ok' when page_id % 3 = 0 then 'failed' end status from pages),
 seen as (select distinct site from p where status = 'ok')
 select page_id, site, status, 'browser' source, null::varchar browser_error from p where status is not null and site in (from seen)
 union all select page_id, site, null, 'static_html_fallback', 'no browser-rendered pages discovered' from p where site not in (from seen)""")
def prompt_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _source_files(spark, sf_dir).selectExpr("page_id", "site", "case when page_id % 11 = 0 then 'ok' when page_id % 3 = 0 then 'failed' end status")
    return source_scan.prompt_inventory(files.where("status is not null"), files.drop("status"), "site").select("page_id", "site", "status", "source", "browser_error")


@query()
def pages_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", repeats.cut_repeats(F.col("html")).alias("c"), repeats.cut_repeats(F.col("html"), 1)["removed"].alias("copies")).select("page_id", "c.html", "c.removed", "copies")


@query("select page_id, md5(case when regexp_matches(html, '^(?i)<html[^>]*>') then html else '<html><body><p>' || html || '</p></body></html>' end) page_md5 from pages")
def texts_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(repeats.as_page(F.col("html")).cast("binary")).alias("page_md5"))


# --- styles: an order is a page, its lines are pairs of elements ------------------------------------------------------------------

_STYLES = (
    ("font-size", "concat(q, 'px')", "concat(q + n, 'px')"), ("text-align", "'left'", "case when l_returnflag = 'N' then ' Left' else 'right' end"),
    ("color", "concat('rgb(', p, ', ', s, ', 0)')", "concat('rgba(', s, ', ', p, ', ', n, ', 0.5)')"), ("opacity", "'0.5'", "case when n % 3 <> 0 then '1' end"),
    ("margin-top", "'auto'", "case when n % 2 = 0 then 'auto' else '5px' end"), ("filter", "case when n = 1 then 'none' end", "'none'"), ("made-up", "'1'", "'2'"),
)
#: Rows of one order and number are one pair.
_LINES = {"l_returnflag": "min(l_returnflag)", "q": "cast(min(l_quantity) as int)", "p": "min(l_partkey) % 256", "s": "min(l_suppkey) % 256"}
_BOXES = {"rx": "n * 1e-1", "ry": "1e-1", "rw": "2e-1", "rh": "1e-1", "cx": "n * 1e-1 + (p % 3) * 5e-2", "cy": "1e-1", "cw": "2e-1", "ch": "1e-1 + (s % 2) * 5e-2"}
_LIKE = {pair: SequenceMatcher(None, *pair).ratio() for pair in (("left", "right"), ("auto", "5px"))}
_CSSOM_SQL = f"""lines as (select l_orderkey, l_linenumber n, {", ".join(f"{e} {c}" for c, e in _LINES.items())} from lineitem group by 1, 2),
 l as (select *, 2e-1 * (1e-1 + (s % 2) * 5e-2) c_area, (2e-1 - (p % 3) * 5e-2) * 1e-1 i from lines),
 g as (select *, l_returnflag <> 'A' or n = 1 resolved, (1 - n / (q + n)::double + case when l_returnflag = 'N' then 1 else {_LIKE["left", "right"]}::double end) / 2 typography,
   9e-1 * greatest(0, 1 - sqrt(2 * (p - s) ** 2 + n ** 2) / sqrt(195075)) + 5e-2 color, case when n % 2 = 0 then 1 else {_LIKE["auto", "5px"]}::double end spacing, null::double shape,
   list_avg(list_filter([case when n % 3 <> 0 then 5e-1 end, case when n = 1 then 1e0 end], lambda x: x is not null)) effects,
   (i / (2e-2 + c_area - i) + 2e-2 / c_area + 1 - greatest((p % 3) * 5e-2, (s % 2) * 25e-3)) / 3 layout from l),
 pairs as (select l_orderkey, n, q, resolved, {", ".join(f"case when resolved then {x} end {x}" for x in cssom.GROUPS)} from g),
 scored as (select *, case when resolved then list_avg(list_filter([{", ".join(cssom.GROUPS)}], lambda x: x is not null)) end score from pairs)"""


def _style_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(*(F.expr(e).alias(c) for c, e in _LINES.items()))
    pairs = lines.selectExpr("l_orderkey", "n pair", "double(q) weight", "l_returnflag <> 'A' or n = 1 resolved", *(f"{e} {c}" for c, e in _BOXES.items()))
    each = ", ".join(f"struct('{name}' as property, {a} as reference, {b} as candidate)" for name, a, b in _STYLES)
    styles = lines.selectExpr("l_orderkey", "n pair", f"inline(array({each}))")
    return cssom.pair_scores(pairs, styles, ["l_orderkey"])


@query(f"""with {_CSSOM_SQL} select l_orderkey, n pair, {", ".join(f"round({g}, 9) {g}" for g in (*cssom.GROUPS, "score"))} from scored""")
def style_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style_pairs(spark, sf_dir).select("l_orderkey", "pair", *(rounded(F.col(g), 9).alias(g) for g in (*cssom.GROUPS, "score")))


@query(f"""with {_CSSOM_SQL}, k as (select l_orderkey, {", ".join(f"coalesce(sum({g} * q) / nullif(sum(q) filter ({g} is not null), 0), 0) {g}" for g in (*cssom.GROUPS, "score"))}, coalesce(sum(q) filter (resolved), 0)::double area, sum(q) q, count(*) pair_count, count(*) filter (resolved) resolved_pair_count from scored group by 1)
 select l_orderkey, round(score, 9)::double matched_score, round(area / q, 9)::double resolution_score, {", ".join(f"round({g}, 9)::double {g}" for g in cssom.GROUPS)}, pair_count, resolved_pair_count, area weighted_area, (o_custkey % 4)::double / 4 coverage, round(score * (area / q) * ((o_custkey % 4)::double / 4), 9)::double score
 from k join orders on o_orderkey = l_orderkey""")
def style_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "orders").selectExpr("o_orderkey l_orderkey", "double(o_custkey % 4) / 4 coverage", "1e0 block_score")
    out = cssom.page_scores(_style_pairs(spark, sf_dir), pages, ["l_orderkey"])
    return out.withColumns({c: rounded(F.col(c), 9) for c in ("matched_score", "resolution_score", *cssom.GROUPS, "score")})


# --- judge answers: each document is answered with ten scores in one of five shapes, some of nine scores ----------------------------

_JUDGED = (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)


@query(f"""with s as (select doc_id, [{", ".join(f"(doc_id * {k} % 101) / 10.0::double" for k in _JUDGED)}] x from documents)
 select doc_id, case when doc_id % 7 > 0 or doc_id % 5 = 3 then round(list_sum(x), 6)::double end total, case when doc_id % 7 > 0 or doc_id % 5 = 3 then x[10] end last from s""")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [(F.pmod(F.col("doc_id") * k, F.lit(101)) / 10).cast("string") for k in _JUDGED]
    listed = F.concat(F.lit("["), F.concat_ws(", ", *shown[:9]), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit(", "), shown[9])).otherwise(""), F.lit("]"))
    named = [F.concat(F.lit(f'"{name}": '), x) for name, x in zip(judge.DIMENSIONS, shown, strict=True)]
    members = F.concat_ws(", ", *named[:9], F.when((F.col("doc_id") % 7 > 0) | (F.col("doc_id") % 5 == 3), named[9]))
    shape = F.col("doc_id") % 5
    answer = (
        F.when(shape == 0, listed).when(shape == 1, F.concat(F.lit('{"why": "2 of 3", "scores": '), listed, F.lit("}"))).when(shape == 2, F.concat(F.lit('Well: ```json {"dimensions": {'), members, F.lit("}}```")))
        .when(shape == 3, F.concat(F.lit("{"), members, F.lit("}"))).otherwise(F.concat(F.lit("Scores "), listed))
    )
    rows = read(spark, sf_dir, "documents").select("doc_id", answer.alias("a"))
    payload = F.when(F.startswith("a", F.lit("[")), F.col("a")).otherwise(json_payload(F.col("a")))
    scores = rows.select("doc_id", judge.answer_scores(F.col("a"), payload).alias("s"))
    return scores.select("doc_id", rounded(F.aggregate("s", F.lit(0.0), lambda t, x: t + x)).alias("total"), F.get("s", F.lit(9)).alias("last"))
