"""Signs of animation in source files: style rules that move or fade, event handlers, changes of classes.

Files are rows of site, path and text. Places are found by splitting a text at the matches,
so that the pieces and the matches together give the line of each; all of it in built-in
functions, on whole texts.

Defined cases
  null or empty text  no signs
  other file types    no signs
  repeated rows       their signs repeat
  ties of paths       any order
  empty table         an empty result
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.paths import rule_tokens

# File types, files of most interest, and what the scan looks for.
STYLE_TYPES = ("css", "html", "jsx", "tsx")
SCRIPT_TYPES = ("js", "jsx", "ts", "tsx", "html")
FIRST_NAMES = ("index.html", "styles.css", "script.js")
MOVING = "transition|animation|transform|opacity"
EVENTS = "click|mouseenter|mouseover|pointerenter|input|change|focus|keydown"
HANDLER = rf"addEventListener\s*\(\s*['\"](?:{EVENTS})['\"]|on(?:{EVENTS})\s*="
MUTATION = r"([A-Za-z_$][\w$.\[\]'\"]{0,80})\.classList\.(add|remove|toggle)\s*\(([^)]{0,200})\)"

#: Longest selector, rule and snippet, most classes and lines around a sign.
SELECTOR, RULE, SNIPPET, CLASSES, RADIUS = 240, 900, 1000, 8, 3


def first_files(files: DataFrame, site: str, path: str, most: int = 24) -> DataFrame:
    """The files of each site that are looked at: those of the usual names first, then by path.

    A site's files are ranked in parts first, so that a large site is not sorted in one task.
    """
    order = [F.when(F.element_at(F.split(path, "/"), -1).isin(*FIRST_NAMES), 0).otherwise(1), F.col(path)]
    part = Window.partitionBy(site, F.pmod(F.xxhash64(path), F.lit(64))).orderBy(*order)
    ranked = files.withColumn("__rank", F.row_number().over(part)).where(F.col("__rank") <= most)
    return ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(site).orderBy(*order))).where(F.col("__rank") <= most).drop("__rank")


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def _one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _around(lines: Column, line: Column) -> Column:
    """The lines around a line with their numbers."""
    start = F.greatest(F.lit(1), line - RADIUS)
    near = F.slice(lines, start, line + RADIUS - start + 1)
    return F.left(F.array_join(F.transform(near, lambda x, i: F.concat((start + i).cast("string"), F.lit(": "), x)), "\n"), F.lit(SNIPPET))


def _line(breaks: Column, pieces: Column) -> Column:
    """The line, from 1, behind a number of pieces with these line breaks."""
    return F.aggregate(F.slice(breaks, 1, pieces), F.lit(1), lambda s, x: s + x)


def animation_evidence(files: DataFrame, keys: list[str], path: str, text: str, per_file: int = 80) -> DataFrame:
    """The first per_file signs of each kind in each file: keys, path, kind, place, line, name, operation, details, evidence.

    rule      a style rule with a moving property: selector, names in it, the rule
    handler   an event that code listens to: its name, the lines around
    mutation  classes added, removed or toggled: receiver, operation, classes, the lines around
    """
    kind = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    rows = files.select(*keys, path, kind.alias("__type"), F.coalesce(text, F.lit("")).alias("__text"))
    own = [*keys, path]

    # rules: each closing brace ends a piece; the last two parts of it between opening braces are selector and body
    pieces = rows.where(F.col("__type").isin(*STYLE_TYPES) & F.col("__text").rlike(MOVING)).select(*own, F.split("__text", r"\}", -1).alias("__pieces"))
    pieces = pieces.withColumn("__breaks", F.transform("__pieces", _breaks))
    parts = F.transform(F.slice("__pieces", 1, F.size("__pieces") - 1), lambda p, i: F.struct(i.alias("at"), F.split(p, r"\{", -1).alias("parts")))
    parts = F.filter(parts, lambda p: (F.size(p["parts"]) > 1) & F.element_at(p["parts"], -1).rlike(MOVING))
    rules = F.transform(parts, lambda p: F.struct(
        p["at"].alias("at"), _one_space(F.element_at(p["parts"], -2)).alias("selector"), _one_space(F.element_at(p["parts"], -1)).alias("body"),
        F.aggregate(F.slice(p["parts"], 1, F.size(p["parts"]) - 2), F.lit(0), lambda s, x: s + _breaks(x)).alias("before"),
    ))
    rules = F.slice(F.filter(rules, lambda r: (r["selector"] != "") & ~F.startswith(r["selector"], F.lit("@"))), 1, per_file)
    rules = pieces.select(*own, "__breaks", rules.alias("__rules")).select(*own, "__breaks", F.posexplode("__rules").alias("place", "r"))
    selector, body, none = F.col("r.selector"), F.col("r.body"), F.lit(None).cast("string")
    rules = rules.select(
        *own, F.lit("rule").alias("kind"), (F.col("place") + 1).alias("place"), (_line(F.col("__breaks"), F.col("r.at")) + F.col("r.before")).cast("int").alias("line"),
        F.left(selector, F.lit(SELECTOR)).alias("name"), none.alias("operation"), rule_tokens(selector, body).alias("details"), F.left(F.concat(selector, F.lit(" { "), body, F.lit(" }")), F.lit(RULE)).alias("evidence"),
    )

    scripts = rows.where(F.col("__type").isin(*SCRIPT_TYPES))

    def matches(pattern: str, name: str) -> DataFrame:
        """Rows of the matches: place, match, line and lines of the text."""
        found = F.slice(F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)), 1, per_file)
        held = scripts.where(F.col("__text").rlike(pattern)).select(*own, found.alias("__found"), F.transform(F.slice(F.split("__text", pattern, -1), 1, per_file), _breaks).alias("__between"), F.split("__text", "\n", -1).alias("__lines"))
        held = held.withColumn("__within", F.transform("__found", _breaks))
        held = held.select(*own, "__between", "__within", "__lines", F.posexplode("__found").alias("place", "match"))
        line = (_line(F.col("__between"), F.col("place") + 1) + _line(F.col("__within"), F.col("place")) - 1).cast("int")
        return held.select(*own, F.lit(name).alias("kind"), (F.col("place") + 1).alias("place"), line.alias("line"), "match", "__lines")

    handlers = matches(HANDLER, "handler").select(*own, "kind", "place", "line", F.regexp_extract("match", f"({EVENTS})", 1).alias("name"), none.alias("operation"), F.array().cast("array<string>").alias("details"), _around(F.col("__lines"), F.col("line")).alias("evidence"))
    names = F.slice(F.regexp_extract_all(F.regexp_extract("match", MUTATION, 3), F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1)), 1, CLASSES)
    mutations = matches(MUTATION, "mutation").select(*own, "kind", "place", "line", F.regexp_extract("match", MUTATION, 1).alias("name"), F.regexp_extract("match", MUTATION, 2).alias("operation"), names.alias("details"), _around(F.col("__lines"), F.col("line")).alias("evidence"))
    return rules.unionByName(handlers).unionByName(mutations)


def evidence_totals(found: DataFrame, site: str, path: str) -> DataFrame:
    """Per site: files with signs, and signs by kind. Files are counted by path before sites are, so that a large site is no large group."""
    by_file = found.groupBy(site, path).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("rule", "handler", "mutation")))
    return by_file.groupBy(site).agg(F.count("*").alias("file_count"), F.sum("rule").alias("css_rules"), F.sum("mutation").alias("js_mutations"), F.sum("handler").alias("event_handlers"))


def prompt_inventory(rendered: DataFrame, static: DataFrame, site: str, status: str = "status") -> DataFrame:
    """Pages of each site with their source: the browser's where it rendered one at least, else those of the static scan.

    rendered: site, status and other columns; static: site and other columns. What one side lacks is null.
    """
    seen = rendered.groupBy(site).agg(F.max((F.col(status) == "ok").cast("int")).alias("__ok")).where("__ok = 1").select(site)
    taken = rendered.join(seen, site, "left_semi").withColumns({"source": F.lit("browser"), "browser_error": F.lit(None).cast("string")})
    instead = static.join(seen, site, "left_anti").withColumns({"source": F.lit("static_html_fallback"), "browser_error": F.lit("no browser-rendered pages discovered")})
    return taken.unionByName(instead, allowMissingColumns=True)
