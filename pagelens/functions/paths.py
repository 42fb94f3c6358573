"""Routes, selectors, frameworks and model answers as columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Path segments that hold assets, schemes that lead off a site, frameworks with client routing.
ASSET_SEGMENTS = ("assets", "css", "fonts", "font", "images", "img", "js", "media", "static")
OTHER_SCHEMES = ("mailto:", "tel:", "javascript:")
SPA_FRAMEWORKS = ("react", "solid")
# Parts of messages after which a call may be tried again.
TRANSIENT = ("529", "overloaded", "api is at capacity", "temporarily unavailable", "rate limit", "rate_limit")
# Controls that need a name, and input types that do not.
NAMED_TAGS = ("a", "button", "select", "textarea", "input")
FIELD_TAGS = ("input", "select", "textarea")
NAMED_ROLES = ("button", "checkbox", "combobox", "link", "listbox", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "searchbox", "slider", "spinbutton", "switch", "tab", "textbox")


def _nothing(x: Column) -> Column:
    return x.isNull() | (x == "")


def rooted(path: Column) -> Column:
    """The path from the root."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def url_parts(url: Column) -> Column:
    """host, path (the root for none), query and fragment of an address."""
    part = lambda p: F.regexp_extract(url, p, 1)
    path = part(r"^[a-z]+://[^/?#]*([^?#]*)")
    return F.struct(part(r"^[a-z]+://([^/?#]*)").alias("host"), F.when(path == "", "/").otherwise(path).alias("path"), part(r"\?([^#]*)").alias("query"), part(r"#(.*)$").alias("fragment"))


def page_name(path: Column) -> Column:
    """The file's name without suffix; home for none and for index."""
    file = F.element_at(F.split(F.rtrim(F.regexp_replace(path, "[?#].*$", ""), F.lit("/")), "/"), -1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    return F.when(_nothing(stem) | (stem == "index"), "home").otherwise(stem)


def spa_route(path: Column) -> Column:
    """The client-side route of an html path; null without a path."""
    p = rooted(path)
    bare = F.regexp_replace(p, r"\.html$", "")
    return F.when(_nothing(path), None).when(p.isin("/", "/index.html"), "/").when(bare == "", "/").otherwise(bare)


def without_dots(path: Column) -> Column:
    """The path after its parts . and .. took effect; a last part that is one of them leaves a folder."""
    parts = F.split(path, "/")
    step = lambda done, p: F.when(p == ".", done).when(p == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(p)))
    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    return F.concat(F.array_join(done, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def discovered_path(current: Column, href: Column, keep_fragment: bool = False) -> Column:
    """Path and query of a link on the page current that stays on its host; null for any other."""
    scheme = F.regexp_extract(current, "^([a-z]+)://", 1)
    host = F.regexp_extract(current, "^[a-z]+://([^/?#]*)", 1)
    own = F.regexp_extract(current, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    own_query = F.regexp_extract(current, r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(href, "(#.+)$", 1) if keep_fragment else F.lit("")
    bare = F.regexp_replace(href, "#.*$", "")
    query = F.regexp_extract(bare, r"(\?.+)$", 1)
    path = F.regexp_replace(bare, r"\?.*$", "")
    absolute, beside = F.rlike(href, F.lit("^[a-z][a-z0-9+.-]*:")), F.startswith(href, F.lit("//"))
    other = F.when(absolute, F.regexp_extract(href, "^[a-z]+://([^/?#]*)", 1)).when(beside, F.regexp_extract(href, "^//([^/?#]*)", 1)).otherwise(host)
    folder = F.when(own == "", "/").otherwise(F.regexp_replace(own, "[^/]*$", ""))
    found = (
        F.when(absolute, F.regexp_extract(path, "^[a-z]+://[^/]*(.*)$", 1)).when(beside, F.regexp_extract(path, "^//[^/]*(.*)$", 1))
        .when(F.startswith(path, F.lit("/")), without_dots(path)).when(path == "", own).otherwise(without_dots(F.concat(folder, path)))
    )
    query = F.when((path == "") & (query == "") & ~absolute, own_query).otherwise(query)
    fine = (other == host) & (scheme.isin("http", "https")) & (~absolute | F.rlike(href, F.lit("^https?://"))) & ~_nothing(href)
    for start in OTHER_SCHEMES:
        fine = fine & ~F.startswith(href, F.lit(start))
    return F.when(fine, F.concat(F.when(found == "", "/").otherwise(found), query, fragment))


def route_url(base: Column, path: Column) -> Column:
    """The address of a route; the index page without one."""
    route = F.when(_nothing(path), "/index.html").otherwise(path)
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(route, F.lit("/")))


def serve_mode(value: Column) -> Column:
    """static or spa; null for a mode that is not known."""
    return F.when(_nothing(value) | (value == "static"), "static").when(value == "spa", "spa")


def framework_mode(framework: Column) -> Column:
    return F.when(framework.isin(*SPA_FRAMEWORKS), "spa").otherwise("static")


def framework_root(root: Column, framework: Column, built: Column) -> Column:
    """The folder of the built site where a framework's build is there."""
    return F.when(framework.isin(*SPA_FRAMEWORKS) & built, F.concat(root, F.lit("/dist"))).otherwise(root)


def variant_slug(slug: Column, framework: Column, frameworks: Column) -> Column:
    """The slug with the framework behind it, where there are several."""
    return F.when(frameworks == 1, slug).otherwise(F.concat_ws("-", slug, framework))


def frameworks(raw: Column, fallback: str) -> Column:
    """Names of a comma-separated list in order, each once; the fallback for an empty one."""
    names = F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.array(F.lit(fallback))).otherwise(names)


def falls_back(method: Column, target: Column, accept: Column) -> Column:
    """Whether a request is a page of a client-routed site and so gets the index page."""
    path = F.regexp_replace(target, "[?#].*$", "")
    first = F.lower(F.split(F.trim(path, F.lit("/")), "/")[0])
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    return method.isin("GET", "HEAD") & ~first.isin(*ASSET_SEGMENTS) & suffix.isin("", ".html") & F.contains(F.coalesce(accept, F.lit("")), F.lit("text/html"))


def selector(tag: Column, element_id: Column, name: Column, classes: Column) -> Column:
    """By id, else by name, else by the first three classes; null without any."""
    return (
        F.when(~_nothing(element_id), F.concat(F.lit("#"), element_id)).when(~_nothing(name), F.concat(tag, F.lit('[name="'), name, F.lit('"]')))
        .when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(F.slice(classes, 1, 3), ".")))
    )


def line_number(text: Column, offset: Column) -> Column:
    """The line, from 1, of a place counted from 0."""
    before = F.substring(text, F.lit(1), F.greatest(offset, F.lit(0)).cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).cast("long")


def snippet(text: Column, line: Column, radius: int = 2) -> Column:
    """The lines around a line, each with its number."""
    lines = F.split(text, "\n")
    start, end = F.greatest(F.lit(1), line - radius), F.least(F.size(lines), line + radius)
    return F.array_join(F.transform(F.sequence(start.cast("int"), end.cast("int")), lambda i: F.concat(i.cast("string"), F.lit(": "), F.element_at(lines, i))), "\n")


def rule_tokens(rule_selector: Column, body: Column, most: int = 32) -> Column:
    """Sorted names in a style rule's selector and of its properties."""
    names = F.regexp_extract_all(rule_selector, F.lit(r"[#.][A-Za-z_][\w-]*|\[[^\]]+\]|[A-Za-z][\w-]*"), F.lit(0))
    properties = F.regexp_extract_all(body, F.lit(r"([A-Za-z-]+)\s*:"), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(F.concat(names, properties))), 1, most)


def bounded(text: Column, limit: int = 200) -> Column:
    """A payload's text with a note of what was cut off."""
    more = F.length(text) - limit
    return F.when(more > 0, F.concat(F.left(text, F.lit(limit)), F.lit("…(+"), more.cast("string"), F.lit(" chars)"))).otherwise(text)


def is_transient(message: Column) -> Column:
    """Whether an error is of the kind that passes."""
    return F.rlike(F.lower(message), F.lit("|".join(TRANSIENT)))


def needs_name(tag: Column, kind: Column, role: Column) -> Column:
    """Whether an accessible name is wanted of a control."""
    ignored = (tag == "input") & F.coalesce(kind, F.lit("")).isin("hidden")
    return F.when(ignored, False).otherwise(tag.isin(*NAMED_TAGS) | F.coalesce(role, F.lit("")).isin(*NAMED_ROLES))


def is_form_field(tag: Column, kind: Column) -> Column:
    """Whether a control takes a value and so needs a label."""
    return tag.isin(*FIELD_TAGS) & ~((tag == "input") & F.coalesce(kind, F.lit("")).isin("hidden", "button", "submit", "reset", "image"))


def data_url(path: Column, content: Column) -> Column:
    """A picture's bytes as an address; PNG where the suffix is not JPEG's."""
    kind = F.when(F.rlike(F.lower(path), F.lit(r"\.jpe?g$")), "image/jpeg").otherwise("image/png")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def node_index(node_id: Column) -> Column:
    return F.replace(node_id, F.lit("node-")).try_cast("long")


def style_value(value: Column) -> Column:
    """In lower case, one space between words."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"\s+", " ")


def is_colour_property(name: Column) -> Column:
    return F.endswith(name, F.lit("color"))


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def _payload(text: str | None) -> str | None:
    fenced = _FENCE.search(text or "")
    body = (fenced[1] if fenced else text or "").strip()
    at = body.find("{")
    if at < 0:
        return None
    if at == 0 and body.endswith("}"):
        return body
    # a string is one token, so the braces inside it do not count
    depth = 0
    for token in re.finditer(r'"(?:\\.|[^"\\])*"?|[{}]', body[at:], re.DOTALL):
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if depth == 0 and token[0] == "}":
            return body[at : at + token.end()]
    return None


@F.pandas_udf(StringType())
def json_payload(text: pd.Series) -> pd.Series:
    """The JSON object in a model's answer: in a fence, the whole, or the first with balanced braces; null without one."""
    return text.map(_payload)


@F.pandas_udf(StringType())
def sorted_json(text: pd.Series) -> pd.Series:
    """A JSON object with its keys in order; null if it is none."""

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(json.loads(x or ""), sort_keys=True)
        except ValueError:
            return None

    return text.map(one)
