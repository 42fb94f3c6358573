"""Manifests: made from listings, cleaned with a row for everything dropped, and aligned with one another."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.paths import page_name, rooted, spa_route

# What a manifest's actions may be, and which of them change the page, need a selector, or set no state.
ACTIONS = ("hover", "click", "focus", "fill", "press", "wait", "waitForSelector", "scroll", "scrollBy")
EFFECT_ACTIONS = ("hover", "click", "focus", "fill", "scroll", "scrollBy", "press")
SELECTOR_ACTIONS = ("hover", "click", "focus", "scroll", "waitForSelector")
STATELESS_ACTIONS = ("wait", "press", "scrollBy")
TRIGGERS = ("hover", "click", "focus", "scroll", "wait")
CHANNELS = ("motion", "color")
COLOUR_TRACK = ("background-color", "color", "border-top-color", "border-right-color", "border-bottom-color", "border-left-color")
# What holds where neither a capture nor its manifest says anything.
WIDTH, HEIGHT, STABILITY_MS, FIRST_HEIGHT = 1440, 900, 120, 900


def enabled(rows: DataFrame) -> DataFrame:
    """Only a literal false turns a row off."""
    return rows.where(F.coalesce("enabled", F.lit(True)))


def wanted(rows: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Enabled rows; of these, those with the ids if any are given."""
    on = enabled(rows)
    return on.where(F.col("id").isin(*ids)) if ids else on


def is_stamp(selector: Column) -> Column:
    return F.coalesce(F.contains(selector, F.lit("data-wde-manifest-id")), F.lit(False))


def is_coverage_scored(kind: Column) -> Column:
    return kind.isin(*EFFECT_ACTIONS)


def is_required(actions: Column) -> Column:
    """A capture without actions must succeed."""
    return F.coalesce(F.size(actions), F.lit(0)) == 0


def is_actionable(kind: Column, count: Column, visible: Column) -> Column:
    """Whether a probed selector can take the action: one match, which must be seen for a pointer or focus."""
    return (count == 1) & (~kind.isin("hover", "click", "focus") | F.coalesce(visible, F.lit(False)))


def trigger_action(kind: Column, selector: Column, settle: Column) -> Column:
    """An animation's trigger as an action."""
    named = F.when(kind.isNull() | (kind == ""), "click").otherwise(kind)
    return F.struct(named.alias("type"), selector.alias("selector"), F.coalesce(settle, F.lit(0)).alias("settleMs"))


def viewport(own_width: Column, own_height: Column, default_width: Column, default_height: Column) -> Column:
    """A capture's viewport, else the manifest's, else the fixed one: whole, not side by side."""
    own, default = own_width.isNotNull() | own_height.isNotNull(), default_width.isNotNull() | default_height.isNotNull()
    side = lambda a, b, c: F.when(own, F.coalesce(a, F.lit(c))).when(default, F.coalesce(b, F.lit(c))).otherwise(c).cast("int")
    return F.struct(side(own_width, default_width, WIDTH).alias("width"), side(own_height, default_height, HEIGHT).alias("height"))


def stability_wait(given: Column, own: Column, default: Column) -> Column:
    """Milliseconds; a capture that gives the key without a value waits for none."""
    return F.when(given, F.coalesce(own, F.lit(0))).otherwise(F.when(F.coalesce(default, F.lit(0)) == 0, STABILITY_MS).otherwise(default))


def screenshot_options(own: str, default: str) -> Column:
    """fullPage, animations, caret: each the capture's, else the manifest's, else fixed. own, default: struct columns."""
    pick = lambda key, last: F.coalesce(F.col(f"{own}.{key}"), F.col(f"{default}.{key}"), F.lit(last)).alias(key)
    return F.struct(pick("fullPage", False), pick("animations", "disabled"), pick("caret", "hide"))


def style_viewport(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """A given viewport, else the picture's width by at most a first screen, else the fixed one."""
    given = width.isNotNull() & height.isNotNull()
    return F.struct(
        F.when(given, width).otherwise(F.coalesce(image_width, F.lit(WIDTH))).cast("int").alias("width"),
        F.when(given, height).otherwise(F.coalesce(F.least(image_height, F.lit(FIRST_HEIGHT)), F.lit(HEIGHT))).cast("int").alias("height"),
    )


def selector_status(rows: DataFrame, selectors: DataFrame) -> DataFrame:
    """Adds reason to rows (path, selector): null where the selector matches exactly one element of the path.

    selectors: path, selector, count.
    """
    known = selectors.groupBy("path", "selector").agg(F.max("count").alias("__n"))
    missing = F.col("selector").isNull() | (F.col("selector") == "")
    reason = F.when(missing, "missing_selector").when(F.col("__n").isNull(), "selector_not_found").when(F.col("__n") != 1, "selector_not_unique")
    return rows.join(known, ["path", "selector"], "left").withColumn("reason", reason).drop("__n")


def clean_id(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "[^a-zA-Z0-9_.-]+", "-"), F.lit("-"))


def _numbered(ids: list[str]) -> list[str]:
    """Each id that is in use already gets the first number from 2 on that makes a new one."""
    used: set[str] = set()
    following: dict[str, int] = {}
    out = []
    for x in ids:
        new = x
        if x in used:
            n = following.get(x, 2)
            while f"{x}-{n}" in used:
                n += 1
            new, following[x] = f"{x}-{n}", n + 1
        used.add(new)
        out.append(new)
    return out


def _unique(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Ids made unique in a group, in order. Only ids alike but for numbers at their end can get in each other's way.

    So each such family is numbered by itself, and only those with a repeated id leave the JVM.
    """
    family = rows.withColumn("__family", F.regexp_replace("id", r"(-[0-9]+)+$", ""))
    times = family.withColumn("__times", F.count("*").over(Window.partitionBy(*group, "__family", "id")))
    most = times.withColumn("__most", F.max("__times").over(Window.partitionBy(*group, "__family")))
    names = rows.columns

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).select(names)
        return table.set_column(names.index("id"), "id", pa.array(_numbered(table.column("id").to_pylist()), pa.string()))

    repeated = most.where("__most > 1").groupBy(*group, "__family").applyInArrow(number, rows.schema)
    return most.where("__most = 1").select(*names).unionByName(repeated)


def sanitize_captures(captures: DataFrame, actions: DataFrame, paths: DataFrame, selectors: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped). captures: site, pos, id, path; actions: site, pos, step, type, selector; paths, selectors: by path.

    Actions of no known type, without the selector that they need, or with one that does
    not match one element go. With them goes a capture of an unknown path, one that keeps no
    action, that loses all that set a state, or any that has an effect. kept has the actions left.
    """
    known = paths.select("path").distinct().withColumn("__there", F.lit(True))
    on = captures.withColumn("path", rooted(F.coalesce("path", F.lit("")))).join(known, "path", "left")
    kind, named = F.col("type"), F.coalesce("selector", F.lit("")) != ""
    checked = selector_status(actions.join(on.select("site", "pos", "path"), ["site", "pos"]), selectors)
    meant = kind.isin(*ACTIONS) & (named | ~kind.isin(*SELECTOR_ACTIONS))
    stays = meant & (~named | F.col("reason").isNull())
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    state, effect = ~kind.isin(*STATELESS_ACTIONS), kind.isin(*EFFECT_ACTIONS)
    judged = checked.groupBy("site", "pos").agg(
        F.array_sort(F.collect_list(F.when(stays, F.struct("step", "type", "selector")))).alias("actions"),
        (count(stays) == 0).alias("__none"), ((count(meant & state) > 0) & (count(stays & state) == 0)).alias("__state"), (count(meant & effect) != count(stays & effect)).alias("__effect"),
    )
    rows = on.join(judged, ["site", "pos"], "left")
    reason = F.when(F.col("__there").isNull(), "path_not_found").when(F.col("__none"), "no_actions_left").when(F.col("__state"), "no_state_left").when(F.col("__effect"), "effect_lost")
    rows = rows.withColumn("reason", reason).drop("__there", "__none", "__state", "__effect")
    kept = rows.where("reason is null").drop("reason")
    place = F.row_number().over(Window.partitionBy("site").orderBy("pos"))
    cleaned = clean_id(F.col("id"))
    kept = kept.withColumn("__place", place).withColumn("id", F.when(cleaned == "", F.concat(page_name(F.col("path")), F.lit(".desktop."), F.col("__place").cast("string"))).otherwise(cleaned))
    if limit is not None:
        kept = kept.where(F.col("__place") <= limit)
    return _unique(kept.drop("__place"), ["site"], "pos"), rows.where("reason is not null").select("site", "pos", "id", "path", "reason")


def sanitized_times(duration: Column, samples: Column) -> tuple[Column, Column]:
    """(samples, duration): sorted distinct offsets from 0 on; with fewer than two, four over the duration, 600 ms if there is none."""
    given = F.array_sort(F.array_distinct(F.filter(F.coalesce(samples, F.array().cast("array<bigint>")), lambda x: x >= 0)))
    length = F.coalesce(duration, F.lit(0)).cast("bigint")
    span = F.when(length == 0, F.lit(600).cast("bigint")).otherwise(length)
    spread = F.array(F.lit(0).cast("bigint"), F.floor(span / 3), F.floor(span * 2 / 3), span)
    few = F.size(given) < 2
    times = F.when(few, spread).otherwise(given)
    long_ = F.when(few, span).otherwise(length)
    return times, F.when(long_ <= 0, F.array_max(times)).otherwise(long_)


def sanitize_animations(animations: DataFrame, targets: DataFrame, paths: DataFrame, selectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, diagnostics). animations: site, pos, id, path, trigger, trigger_selector, duration, samples; targets: site, pos, place, name, selector, channels, track.

    diagnostics has a row for each animation: kept, or dropped with the first reason that holds.
    """
    known = paths.select("path").distinct().withColumn("__there", F.lit(True))
    rows = animations.withColumn("path", rooted(F.coalesce("path", F.lit("")))).join(known, "path", "left")
    rows = rows.withColumn("trigger", F.when(F.col("trigger").isin(*TRIGGERS), F.col("trigger")).otherwise("click"))
    probed = selector_status(rows.select("site", "pos", "path", F.col("trigger_selector").alias("selector")), selectors).select("site", "pos", F.col("reason").alias("__trigger"))
    rows = rows.join(probed, ["site", "pos"])
    each = selector_status(targets.join(rows.select("site", "pos", "path"), ["site", "pos"]), selectors)
    channels = F.filter(F.coalesce("channels", F.array().cast("array<string>")), lambda x: x.isin(*CHANNELS))
    track = F.coalesce("track", F.array().cast("array<string>"))
    track = F.when(F.array_contains(channels, "color") & (F.size(track) == 0), F.array(*map(F.lit, COLOUR_TRACK))).otherwise(track)
    named = F.when(F.coalesce("name", F.lit("")) == "", "animated target").otherwise(F.col("name"))
    fine = each.where("reason is null").where(F.size(channels) > 0).select("site", "pos", F.struct("place", named.alias("name"), "selector", channels.alias("channels"), track.alias("track")).alias("t"))
    rows = rows.join(fine.groupBy("site", "pos").agg(F.array_sort(F.collect_list("t")).alias("targets")), ["site", "pos"], "left")
    needs = F.col("trigger") != "wait"
    none = F.coalesce("trigger_selector", F.lit("")) == ""
    reason = (
        F.when(F.col("__there").isNull(), "path_not_found").when(needs & none, "trigger_selector_missing")
        .when(needs & F.col("__trigger").isNotNull(), "trigger_selector_invalid").when(F.col("targets").isNull(), "no_valid_targets")
    )
    rows = rows.withColumn("reason", reason)
    times, length = sanitized_times(F.col("duration"), F.col("samples"))
    kept = rows.where("reason is null").withColumns({"samples": times, "duration": length}).drop("reason", "__there", "__trigger")
    place = F.row_number().over(Window.partitionBy("site").orderBy("pos"))
    cleaned = clean_id(F.col("id"))
    kept = kept.withColumn("__place", place).withColumn("id", F.when(cleaned == "", F.concat(page_name(F.col("path")), F.lit(".animation."), F.col("__place").cast("string"))).otherwise(cleaned)).drop("__place")
    return _unique(kept, ["site"], "pos"), rows.select("site", "pos", "id", "path", F.when(F.col("reason").isNull(), "kept").otherwise("dropped").alias("status"), "reason")


def aligned(reference: DataFrame, candidate: DataFrame, keys: list[str], taken: list[str]) -> DataFrame:
    """Candidate rows whose keys the reference has too, with the reference's values of taken where it has one, and both paths."""
    given = reference.select(*keys, *[F.col(c).alias(f"__{c}") for c in taken], F.col("path").alias("oracle_path"))
    both = candidate.join(given, keys).withColumns({c: F.coalesce(f"__{c}", c) for c in taken})
    return both.withColumn("candidate_path", F.col("path")).drop(*(f"__{c}" for c in taken))


def aligned_targets(reference: DataFrame, candidate: DataFrame, keys: list[str], taken: list[str]) -> DataFrame:
    """Candidate targets with the reference's values at the same place; targets beyond the reference's keep their own."""
    given = reference.select(*keys, *[F.col(c).alias(f"__{c}") for c in taken])
    return candidate.join(given, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in taken}).drop(*(f"__{c}" for c in taken))


def fallback_captures(files: DataFrame, most: int | None = None) -> DataFrame:
    """A full capture of every html file of the top folder, in order. files: site, path from the root."""
    top = files.where(F.rlike("path", F.lit(r"^/[^/]+\.html$"))).select("site", "path").distinct()
    name = page_name(F.col("path"))
    rows = top.select("site", F.concat(name, F.lit(".desktop.full")).alias("id"), F.lit(1.0).alias("weight"), name.alias("page"), F.lit("full page").alias("state"), "path", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(True).alias("full_page"))
    if most is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("site").orderBy("path"))).where(F.col("__n") <= most).drop("__n")


def concept_captures(pages: DataFrame) -> DataFrame:
    """A desktop capture of every page, and a mobile one where the concept speaks of mobile. pages: site, page, path, mobile_behavior."""
    sizes = [("desktop.full", 1.0, "full page", 1440, 900, True), ("mobile.viewport", 0.5, "mobile viewport", 390, 844, False)]
    kinds = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("kind", "weight", "state", "width", "height", "full_page"), s, strict=True))) for s in sizes))
    mobile = F.contains(F.lower(F.coalesce("mobile_behavior", F.lit(""))), F.lit("mobile"))
    rows = pages.select("site", "page", rooted(F.col("path")).alias("path"), F.explode(F.when(mobile, kinds).otherwise(F.slice(kinds, 1, 1))).alias("k"))
    return rows.select("site", F.concat_ws(".", "page", "k.kind").alias("id"), "page", "path", "k.weight", "k.state", "k.width", "k.height", "k.full_page")


def static_routes(files: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, path): html files of the top folder; the root for a site without any."""
    found = files.where(F.rlike("path", F.lit(r"^/[^/]+\.html$"))).select("site", "path").distinct()
    return sites.select("site").distinct().join(found, "site", "left").select("site", F.coalesce("path", F.lit("/")).alias("path"))


def route_probes(items: DataFrame) -> DataFrame:
    """(site, probe, place): paths to try, each once in the order met: the root, the index, and paths with their client routes.

    items: site, pos, path.
    """
    start = items.select("site").distinct().select("site", F.lit(-1).cast("long").alias("pos"), F.array(F.lit("/"), F.lit("/index.html")).alias("p"))
    given = items.where(F.coalesce("path", F.lit("")) != "").select("site", F.col("pos").cast("long").alias("pos"), F.array(rooted(F.col("path")), spa_route(F.col("path"))).alias("p"))
    each = start.unionByName(given).select("site", "pos", F.posexplode("p").alias("k", "probe"))
    first = each.groupBy("site", "probe").agg(F.min(F.struct("pos", "k")).alias("at"))
    return first.select("site", "probe", F.row_number().over(Window.partitionBy("site").orderBy("at")).alias("place"))


def sample_times(duration: str, samples: str) -> Column:
    """Sorted distinct sample offsets from 0 on; without any, the begin and the duration or 600 ms."""
    given = F.array_sort(F.array_distinct(F.filter(F.coalesce(samples, F.array().cast("array<bigint>")), lambda x: x >= 0)))
    start = F.when(F.array_contains(given, 0), given).otherwise(F.concat(F.array(F.lit(0).cast("bigint")), given))
    return F.when(F.size(given) > 0, start).otherwise(F.array(F.lit(0).cast("bigint"), F.coalesce(duration, F.lit(600)).cast("bigint")))


def numbered(rows: DataFrame, group: list[str], order: str, width: int = 3) -> DataFrame:
    """Adds number: 001, 002 and so on, in order within each group."""
    return rows.withColumn("number", F.lpad(F.row_number().over(Window.partitionBy(*group).orderBy(order)).cast("string"), width, "0"))


def preferred_captures(captures: DataFrame, group: list[str]) -> DataFrame:
    """One capture a page: the last whose id ends in .desktop.full, else the first. captures: pos, id, page."""
    full = F.endswith("id", F.lit(".desktop.full"))
    rank = F.struct(full, F.when(full, F.col("pos")).otherwise(-F.col("pos")))
    rows = captures.withColumn("page", F.coalesce("page", "id"))
    return rows.groupBy(*group, "page").agg(F.max_by(F.struct("pos", "id"), rank).alias("c")).select(*group, "page", "c.pos", "c.id")


def verifier_captures(captures: DataFrame, present: DataFrame, group: list[str]) -> DataFrame:
    """Of each page the enabled capture of the largest weight that has a picture. captures: pos, id, page, weight, enabled."""
    there = enabled(captures).join(present.select(*group, "id").distinct(), [*group, "id"], "left_semi").withColumn("page", F.coalesce("page", "id"))
    return there.groupBy(*group, "page").agg(F.max_by("id", F.struct(F.coalesce("weight", F.lit(0.0)), -F.col("pos"))).alias("id"))
