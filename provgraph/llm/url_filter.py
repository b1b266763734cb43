"""URL filters: longest-prefix rules, and block decisions carried to a page's aliases.

A page's aliases are the pages in its redirect equivalence class: the connected component over
redirects (``meta http-equiv=refresh``), canonical links (``link rel=canonical``) and edges of a given
table, between canonical forms of URLs. A canonical form leaves out what servers redirect away: the
scheme, a leading ``www.``, the fragment, tracking parameters, and one slash at the end of the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.llm.components import connected_components
from provgraph.llm.shared import Stage

# The rules of the contract, host and path, with their verdicts.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Query parameters that only track.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="


def _low(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: then up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _low(host), path


def canonical(url: Column) -> Column:
    """The form by which aliases of a URL are known; null for a null URL or one without ``://``."""
    host, path = host_and_path(url)
    host = F.regexp_replace(host, r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    path = F.regexp_replace(path, "/$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path written together) and its verdict, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _absolute(link: Column, url: Column) -> Column:
    """A link of a page as a URL, relative ones resolved against the page's."""
    origin = F.regexp_extract(url, r"(?s)^([^:]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([^:]*):", 1)
    path, query = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path, r"(?s)[^/]*$", "")
    steps = F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_extract(link, r"(?s)^[^?#]*", 0)), "/")
    last = F.element_at(steps, -1)
    up = lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x.isin("", "."), out).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(steps, F.expr("cast(array() as array<string>)"), up)
    tail = F.when(last.isin("", ".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise("")
    beside = F.concat(origin, F.lit("/"), F.array_join(kept, "/"), tail, query)
    return F.when(F.instr(link, "://") > 0, link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)).when(F.startswith(link, F.lit("/")), F.concat(origin, link)).when(link.rlike(r"^[?#]"), F.concat(origin, path, link)).otherwise(beside)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): canonical forms joined by a page's canonical links and refreshes, all of them."""
    html, url = F.col(html_col), F.col(url_col)
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    links = F.transform(tags(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    moves = F.transform(tags(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    each = pages.select(url.alias("url"), F.explode_outer(F.concat(links, moves)).alias("link")).where("link <> ''")
    return each.select(canonical(F.col("url")).alias("source"), canonical(_absolute(F.col("link"), F.col("url"))).alias("target")).where("source is not null and target is not null and source <> target")


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, component) for every row of ``pages``.

    A page that a rule fits has the rule's verdict. Any other is blocked if a page of its equivalence
    class is blocked by a rule and none is explicitly allowed by one: an allow takes precedence over
    blocks that reach a class through aliases. All else is allowed. ``redirects``: (source, target)
    URLs, besides those in the pages. ``component``: the smallest canonical form of the class.

    Null URLs and those without ``://`` have empty host and path, no rule and no aliases, and are
    allowed. Null html has no links; repeated rows are judged each, html of any length is read whole and an
    empty table gives no rows; of rules that fit equally long the first by name counts; other columns are
    left out. A class is reduced to two flags before it is joined back, so its size does not matter.
    """
    stage = Stage(pages.sparkSession, "url-filter")
    url = F.col(url_col)
    host, path = host_and_path(url)
    base = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), canonical(url).alias("form"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), said.alias("said"))
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(canonical(F.col("source")).alias("source"), canonical(F.col("target")).alias("target")))
    classes = connected_components(links, "source", "target", stage).select(F.col("node").alias("form"), "label")
    forms = base.where("form is not null").groupBy("form").agg(F.bool_or(F.coalesce(F.col("said") == "block", F.lit(False))).alias("blocked"), F.bool_or(F.coalesce(F.col("said") == "allow", F.lit(False))).alias("allowed"))
    forms = forms.join(classes, "form", "left").select("form", F.coalesce("label", "form").alias("component"), "blocked", "allowed")
    flags = forms.groupBy("component").agg(F.bool_or("blocked").alias("blocked"), F.bool_or("allowed").alias("allowed"))
    known = forms.select("form", "component").join(flags.select("component", (F.col("blocked") & ~F.col("allowed")).alias("bad")), "component")
    with_form = base.where("form is not null").join(known, "form")
    bare = base.where("form is null").select("*", F.lit(None).cast("string").alias("component"), F.lit(False).alias("bad"))
    every = with_form.unionByName(bare)
    return every.select(id_col, "host", "path", "rule", F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), "component")


def op5(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, url, html,
    translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)=')) AS kept
  FROM parts),
forms AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS form
  FROM split),
rules(rule_host, rule_path, said) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT page_id, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule,
    first(said ORDER BY length(rule_host || rule_path) DESC) AS said
  FROM forms JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
judged AS (SELECT forms.*, rule, said FROM forms LEFT JOIN fitting USING (page_id)),
links AS (
  SELECT form AS a, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
    '(?is)\bhref\s*=\s*["'']?https?://(?:www\.)?([^"''\s>?#]+?)/?["''\s>?#]', 1) AS b FROM judged),
edges AS (SELECT a, b FROM links WHERE b <> '' AND a IS NOT NULL UNION SELECT b, a FROM links WHERE b <> '' AND a IS NOT NULL),
reach(a, b) AS (SELECT form, form FROM judged WHERE form IS NOT NULL UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
class AS (SELECT a AS form, min(b) AS component FROM reach GROUP BY a),
flags AS (SELECT component, bool_or(coalesce(said = 'block', false)) AND NOT bool_or(coalesce(said = 'allow', false)) AS bad
  FROM judged JOIN class USING (form) GROUP BY component)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, component
FROM judged LEFT JOIN class USING (form) LEFT JOIN flags USING (component)
"""
