"""Routes of captures and how much of a capture was reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route_chain(captures: DataFrame, files: DataFrame, *, serve_mode: str = "static", mapped: bool = False) -> DataFrame:
    """Adds resolved_path, confidence, method and failure to captures (site, path, page).

    files: (site, path) of the html files. The first that exists counts: the path itself;
    in spa mode the index; else the page's file or the index, at lower confidence.
    """
    known = files.select("site", F.col("path").alias("file")).distinct()
    wanted = F.concat(F.lit("/"), F.when(F.ltrim(F.col("path"), F.lit("/")) == "", "index.html").otherwise(F.ltrim(F.coalesce("path", F.lit("index.html")), F.lit("/"))))
    page = F.lower(F.trim(F.coalesce("page", F.lit(""))))
    out = captures.withColumns({"__exact": wanted, "__page": F.when(page == "home", "/index.html").when(page != "", F.concat(F.lit("/"), page, F.lit(".html")))})
    for name, key in (("exact", F.col("__exact")), ("page", F.col("__page")), ("index", F.lit("/index.html"))):
        side = known.select(F.col("site").alias("__s"), F.col("file").alias(f"__{name}_file"))
        out = out.join(side, (out["site"] == side["__s"]) & (key == side[f"__{name}_file"]), "left").drop("__s")
    exact, index = F.col("__exact_file").isNotNull(), F.col("__index_file").isNotNull()
    fallback = F.coalesce("__page_file", "__index_file")
    if serve_mode == "spa":
        choice = F.when(exact, F.struct(F.col("__exact").alias("p"), F.lit(1.0).alias("c"), F.lit("exact_path").alias("m"), F.lit(None).cast("string").alias("f"))).when(
            index, F.struct(F.col("__exact").alias("p"), F.lit(1.0 if mapped else 0.75).alias("c"), F.lit("spa_manifest_path" if mapped else "spa_fallback").alias("m"), F.lit(None if mapped else "exact_path_missing_spa_fallback").cast("string").alias("f"))
        ).otherwise(F.struct(F.lit(None).cast("string").alias("p"), F.lit(0.0).alias("c"), F.lit("spa_fallback").alias("m"), F.lit("spa_index_missing").alias("f")))
    else:
        choice = F.when(exact, F.struct(F.col("__exact").alias("p"), F.lit(1.0).alias("c"), F.lit("exact_path").alias("m"), F.lit(None).cast("string").alias("f"))).when(
            fallback.isNotNull(), F.struct(fallback.alias("p"), F.lit(0.6).alias("c"), F.lit("fallback_page_file").alias("m"), F.lit("exact_path_missing").alias("f"))
        ).otherwise(F.struct(F.lit(None).cast("string").alias("p"), F.lit(0.0).alias("c"), F.lit(None).cast("string").alias("m"), F.lit("no_matching_route_file").alias("f")))
    return out.withColumn("__r", choice).select(*captures.columns, F.col("__r.p").alias("resolved_path"), F.col("__r.c").alias("confidence"), F.col("__r.m").alias("method"), F.col("__r.f").alias("failure"))


def coverage(routes: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """key, route_score, action_score and coverage: route confidence times the mean contribution of the scored actions.

    actions: key, contribution, scored. A route that is not resolved covers nothing.
    """
    scored = actions.where(F.coalesce("scored", F.lit(True)) & F.col("contribution").isNotNull()).groupBy(key).agg(F.avg("contribution").alias("action_score"))
    out = routes.join(scored, key, "left")
    reached = F.col("confidence") * F.coalesce("action_score", F.lit(1.0))
    return out.select(key, F.col("confidence").alias("route_score"), "action_score", F.when(F.col("resolved"), reached).otherwise(0.0).alias("coverage"))


def action_contribution(confidence: Column, post_state: Column) -> Column:
    return confidence * post_state
