"""The scan of source files against a scan by Python's regular expressions, match by match."""

import re

from pagelens.operators import source_scan as scan

TEXTS = {
    "a/styles.css": "\n.a:hover ,\n #b[x=y] { color: red;\n transition : all 1s }\n@media (x) {\n  p { transform:none }\n}\n{ opacity: 1 }\n@keyframes z { opacity: 0 } .c{}\n.d { animation: z",
    "a/index.html": "<html>\n<style>p{margin:0} .k\n{opacity:.5}</style>\n<b onclick = \"f()\"></b>\n<script>\ndoc.q['x'].classList.toggle(\n 'on', \"two\");\nn.addEventListener(\n\n 'input', g); s.classList.add()</script>",
    "a/app.tsx": "onchange=x\nonfocus=y\n" * 50 + ".m{transform:x}",
    "a/z.md": "onclick= .a{opacity:1}",
    "b/empty.js": "",
    "b/last.js": "x\n\ny.classList.remove('q')",
}


def plain(path, text, per_file):
    kind = path.rsplit(".", 1)[-1]
    line = lambda m: text.count("\n", 0, m.start()) + 1
    rules, handlers, mutations = [], [], []
    if kind in scan.STYLE_TYPES:
        for m in re.finditer(rf"([^{{}}]+)\{{([^{{}}]*(?:{scan.MOVING})[^{{}}]*)\}}", text):
            selector = " ".join(m[1].split())
            if selector and not selector.startswith("@"):
                rules.append((path, "rule", line(m), selector[: scan.SELECTOR], None))
    if kind in scan.SCRIPT_TYPES:
        handlers = [(path, "handler", line(m), re.search(scan.EVENTS, m[0])[0], None) for m in re.finditer(scan.HANDLER, text)]
        mutations = [(path, "mutation", line(m), m[1], m[2]) for m in re.finditer(scan.MUTATION, text)]
    return [x for found in (rules, handlers, mutations) for x in found[:per_file]]


def test_animation_evidence(spark):
    rows = [(p.split("/")[0], p, t) for p, t in TEXTS.items()] + [("b", "b/null.css", None)]
    files = spark.createDataFrame(rows, "site string, path string, text string")
    for per_file in (80, 3):
        found = scan.animation_evidence(files, ["site"], "path", "text", per_file).collect()
        assert sorted(map(str, ((r["path"], r["kind"], r["line"], r["name"], r["operation"]) for r in found))) == sorted(str(x) for p, t in TEXTS.items() for x in plain(p, t, per_file))
    found = {(r["path"], r["kind"], r["place"]): r for r in scan.animation_evidence(files, ["site"], "path", "text").collect()}
    rule, toggle = found["a/styles.css", "rule", 1], found["a/index.html", "mutation", 1]
    assert rule["evidence"] == ".a:hover , #b[x=y] { color: red; transition : all 1s }" and rule["details"] == sorted({".a", "hover", "#b", "[x=y]", "color", "transition"})
    assert toggle["details"] == ["on", "two"] and toggle["evidence"].split("\n")[0] == "3: {opacity:.5}</style>" and found["a/index.html", "mutation", 2]["details"] == []
    totals = {r["site"]: tuple(r)[1:] for r in scan.evidence_totals(scan.animation_evidence(files, ["site"], "path", "text"), "site", "path").collect()}
    assert totals == {"a": (3, 4, 2, 82), "b": (1, 0, 1, 0)}
    assert scan.animation_evidence(files.limit(0), ["site"], "path", "text").count() == 0


def test_first_files(spark):
    paths = [f"{i:03d}.css" for i in range(300)] + ["z/index.html", "script.js", "y.styles.css"]
    files = spark.createDataFrame([("s", p) for p in paths] + [("t", "one.js")], "site string, path string")
    got = [(r["site"], r["path"]) for r in scan.first_files(files, "site", "path", 5).collect()]
    assert sorted(got) == [("s", "000.css"), ("s", "001.css"), ("s", "002.css"), ("s", "script.js"), ("s", "z/index.html"), ("t", "one.js")]


def test_prompt_inventory(spark):
    rendered = spark.createDataFrame([("a", "ok", 1), ("a", "failed", 2), ("b", "failed", 3), ("d", None, 4)], "site string, status string, page int")
    static = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")], "site string, title string")
    got = sorted((r["site"], r["page"], r["title"], r["source"]) for r in scan.prompt_inventory(rendered, static, "site").collect())
    assert got == [("a", 1, None, "browser"), ("a", 2, None, "browser"), ("b", None, "y", "static_html_fallback"), ("c", None, "z", "static_html_fallback"), ("d", None, "w", "static_html_fallback")]
