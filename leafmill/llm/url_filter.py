"""URL filters with redirect equivalence: block decisions reach the aliases of a URL.

A URL's own rule decides first: rules are host and path prefix, a rule fits its host and all
subdomains, the longest rule wins. Redirect and canonical-link edges make URLs aliases of each
other; connected components of these edges are found in Spark (`components`), and a component in
which a rule blocks a URL blocks all members without a rule of their own. A URL that a rule
allows stays allowed and doesn't unblock its aliases.

Edges come from a table (redirect logs) and from pages: canonical links and meta refreshes.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule, no edges, and is
allowed; fragments don't make another node; repeated rows get equal results; a table without edges skips the
components; of rules of one length the later in code point order wins; extra columns pass through, and one that is called
like a result column gets `_in` behind its name; an empty table gives an empty table. The rule list is code of bounded
length (up to a few hundred rules), not data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, beside, place, written
from .components import components

RESULTS = ["host", "path", "rule", "verdict", "component"]
#: The production rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"'][^\"'>]*?\burl\s*=\s*([^\"'\s>]+)"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"  # scheme, host, path, query


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, group), F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a URL; both empty for a null or one without `://`."""
    return _lower(_part(url, 2)), _part(url, 3)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_key(url: Column) -> Column:
    """What makes a node: the URL without its fragment, scheme and host folded; null without a host."""
    return F.when(_part(url, 2) != "", F.concat(_lower(_part(url, 1)), F.lit("://"), _lower(_part(url, 2)), _part(url, 3), _part(url, 4)))


def _resolved(base: Column, target: Column) -> Column:
    """A target of a page's link as an absolute URL."""
    root = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(_part(base, 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, _part(base, 3), target))
        .otherwise(F.concat(root, F.regexp_replace(_part(base, 3), "[^/]*$", ""), target))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): keys of pages and of the targets of their canonical links and meta refreshes."""
    html, url = F.col(html_col), F.col(url_col)
    some = pages.filter(F.lower(html).contains("canonical") | F.lower(html).contains("refresh"))
    found = some.select(url.alias("__url"), F.explode(F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), 1), F.regexp_extract_all(html, F.lit(_REFRESH), 1))).alias("__to")).filter(F.col("__to") != "")
    found = written(found.withColumn("__to", _resolved(F.col("__url"), F.regexp_replace("__to", "&amp;", "&"))), "url-links")
    return found.select(url_key(F.col("__url")).alias("u"), url_key(F.col("__to")).alias("v")).filter("u is not null and v is not null and u <> v")


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without the html, with host, path, rule, verdict and component (null without an alias).

    `redirects` may have further edges as columns `u` and `v` with URLs.
    """
    rows, given = apart(pages, __url=url_col, __html=html_col)
    edges = page_edges(rows, "__url", "__html")
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("u")).alias("u"), url_key(F.col("v")).alias("v")))
    edges = written(edges.filter("u is not null and v is not null"), "url-edges")
    host, path = host_and_path(F.col("__url"))
    out = rows.withColumns({"host": host, "path": path})
    rule, says = best_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "__says": says})
    if edges.isEmpty():
        out = out.withColumns({"verdict": F.coalesce("__says", F.lit("allow")), "component": F.lit(None).cast("string")})
        return out.select(*beside(given, RESULTS, [place(given, html_col)]), *RESULTS)
    # Nodes that are only edge targets count too: a blocked target blocks the page that points to it.
    members = components(edges, label="url-components")
    members = members.select(F.col("node").alias("__node"), "component")
    node_host, node_path = host_and_path(F.col("__node"))
    blocked = members.filter(best_rule(node_host, node_path, rules)[1] == "block").select("component").distinct().withColumn("__blocked", F.lit(True))
    aliases = members.join(blocked, "component", "left")
    out = out.withColumn("__key", url_key(F.col("__url")))
    out = out.join(aliases, out["__key"] == aliases["__node"], "left")
    verdict = F.coalesce(F.col("__says"), F.when(F.col("__blocked"), F.lit("block")), F.lit("allow"))
    return out.withColumn("verdict", verdict).select(*beside(given, RESULTS, [place(given, html_col)]), *RESULTS)


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
s AS (SELECT *, regexp_extract(r, '^[^/?#]*') AS h FROM p),
q AS (
  SELECT page_id, url, html, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path,
    regexp_replace(url, '#.*', '') AS k
  FROM s),
rules AS (SELECT * FROM (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) AS t (says, rule)),
split AS (SELECT says, rule, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM rules),
fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says
  FROM q JOIN split ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
e AS (
  SELECT k AS u, regexp_replace(regexp_extract(html, '(?i)<link rel="canonical" href="([^"]+)"', 1), '#.*', '') AS v FROM q WHERE regexp_extract(html, '(?i)<link rel="canonical" href="([^"]+)"', 1) <> ''),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (
  SELECT DISTINCT k AS node FROM q JOIN fit USING (page_id) WHERE says = 'block' AND k IN (SELECT u FROM b)
  UNION
  SELECT b.v FROM reach JOIN b ON b.u = reach.node)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN k IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN fit USING (page_id)
"""


def planted_links(pages: DataFrame) -> DataFrame:
    """pages with a canonical link to the page before in each run of five ids: chains for queries and tests of the components."""
    before = pages.select((F.col("page_id") + 1).alias("__next"), F.col("url").alias("__before"))
    linked = pages.join(before, F.col("page_id") == F.col("__next"), "left")
    link = F.when((F.floor(F.col("page_id") / 5) == F.floor((F.col("page_id") - 1) / 5)) & F.col("__before").isNotNull(), F.concat(F.lit('<link rel="canonical" href="'), "__before", F.lit('">')))
    return linked.withColumn("html", F.concat(F.coalesce(link, F.lit("")), F.coalesce("html", F.lit("")))).drop("__next", "__before")


PLANTED_ORACLE = r"""
WITH RECURSIVE p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT *, regexp_extract(r, '^[^/?#]*') AS h FROM p),
q AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path,
    CASE WHEN h <> '' THEN translate(regexp_extract(url, '^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(substr(r, length(h) + 1), '#.*', '') END AS k
  FROM s),
rules AS (SELECT * FROM (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) AS t (says, rule)),
split AS (SELECT says, rule, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM rules),
fit AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says FROM q JOIN split ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
e AS (SELECT a.k AS u, b.k AS v FROM q a JOIN q b ON b.page_id = a.page_id - 1 AND a.page_id // 5 = b.page_id // 5 WHERE a.k IS NOT NULL AND b.k IS NOT NULL),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT DISTINCT k AS node FROM q JOIN fit USING (page_id) WHERE says = 'block' AND k IN (SELECT u FROM b) UNION SELECT b.v FROM reach JOIN b ON b.u = reach.node)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN k IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END) AS verdict FROM q LEFT JOIN fit USING (page_id)
"""
