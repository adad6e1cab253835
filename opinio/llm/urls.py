"""Filter pages by url: fixed rules first, then a tree of path templates per host.

Paths become shapes (numbers and long codes are variable at once) and are counted per host
and shape, so a host with a third of all pages is a few rows from there on. Level by level
a segment stays as it is where enough pages below its branch have it, whatever the size of
its host, and becomes a wildcard where not; there is no deepest level. Then, from the
deepest level up, templates that differ in one segment and whose labelled pages are bad at
about the rate of them all are merged, and merged ones again with their siblings a level
above. A template is rejected where its share of
bad pages, smoothed towards that of its host and of all pages, reaches the limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import query, table, work_table

#: (verdict, host, path): a rule holds for its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Tree:
    #: A segment stays literal with so many pages below its branch.
    least_pages: int = 20
    #: Templates within so many standard errors of the group's rate are merged.
    deviations: float = 2.0
    #: Labelled pages the smoothing counts for, and the share of bad ones that rejects.
    smoothing: float = 10.0
    limit: float = 0.5
    #: Levels that the SQL twin tells apart; here all are.
    depth: int = 7


HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"
NUMBER = r"^[0-9]+(\.[A-Za-z0-9]+)?$"
CODE = r"^[0-9a-fA-F-]{16,}$"
DOCUMENT = r"/([0-9]{1,18})[^/]*/?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, pattern: str) -> Column:
    # (?s): a line break in a url is a character like any other.
    return F.coalesce(F.regexp_extract(url, "(?s)" + pattern, 1), F.lit(""))


def host(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(_part(F.col(url) if isinstance(url, str) else url, HOST), UPPER, LOWER)


def path(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _part(F.col(url) if isinstance(url, str) else url, PATH)


def matching_rule(rules=RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct, or null."""
    out = F.lit(None)
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape() -> Column:
    """``path`` with its numbers and long codes made variable."""
    parts = F.transform(
        F.split("path", "/", -1),
        lambda s: F.when(s.rlike(NUMBER), F.regexp_replace(s, "^[0-9]+", "{n}"))
        .when(s.rlike(CODE), F.lit("{x}"))
        .otherwise(s),
    )
    return F.array_join(parts, "/")


def templates(shapes: DataFrame, tree: Tree) -> DataFrame:
    """``shapes`` (``host, shape, pages, ...``) with their ``template``."""
    parts = F.split("shape", "/", -1)
    grown = work_table(shapes.withColumn("template", F.lit("")), "url-level")
    deepest = grown.agg(F.max(F.size(parts))).first()[0] or 0
    variable = lambda s: s.rlike(r"^\{[nx]\}") | (s == "")
    for level in range(1, deepest):  # the part before the first slash is empty
        here = grown.withColumn("part", F.get(parts, F.lit(level)))
        counts = here.filter("part is not null").groupBy("host", "template", "part").agg(F.sum("pages").alias("n"))
        common = work_table(
            counts.filter(F.col("n") >= tree.least_pages).select("host", "template", "part", F.lit(True).alias("common")), "url-common"
        )
        open_ = counts.groupBy("host", "template").agg(F.sum("n").alias("n")).filter(F.col("n") >= tree.least_pages)
        if common.isEmpty() and open_.isEmpty():
            # No branch has pages enough for a literal segment, here or deeper.
            below = F.transform(F.slice(parts, level + 1, F.greatest(F.size(parts) - level, F.lit(0))), lambda s: F.when(variable(s), s).otherwise("*"))
            tail = F.concat("template", F.lit("/"), F.array_join(below, "/"))
            return grown.withColumn("template", F.when(F.size(parts) > level, tail).otherwise(F.col("template")))
        stays = variable(F.col("part")) | F.col("common").isNotNull()
        longer = F.concat("template", F.lit("/"), F.when(stays, F.col("part")).otherwise("*"))
        grown = here.join(common, ["host", "template", "part"], "left").withColumn(
            "template", F.when(F.col("part").isNull(), F.col("template")).otherwise(longer)
        )
        grown = work_table(grown.drop("part", "common"), "url-level")
    return grown


def merged(counted: DataFrame, tree: Tree) -> DataFrame:
    """``(host, template, n, b, name)``: templates of one ``name`` are judged together.

    ``counted``: ``(host, template, n, b)``. Bottom-up, a level at a time: siblings agree in
    all segments but the literal one of that level, and those whose share of bad pages is
    within ``deviations`` standard errors of the siblings' share take a wildcard there.
    """
    named = work_table(counted.withColumn("name", F.col("template")), "url-named")
    parts = F.split("name", "/", -1)
    deepest = named.agg(F.max(F.size(parts))).first()[0] or 0
    for level in range(deepest - 1, 0, -1):  # the part before the first slash is empty
        nodes = named.groupBy("host", "name").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        part = F.get(parts, F.lit(level))
        wild = F.concat(F.slice(parts, 1, level), F.array(F.lit("*")), F.slice(parts, level + 2, deepest))
        family = F.when(part.rlike(r"^[^{]"), F.array_join(wild, "/")).otherwise(F.col("name"))
        nodes = nodes.withColumn("family", family)
        families = nodes.groupBy("host", "family").agg(F.sum("n").alias("family_n"), F.sum("b").alias("family_b"))
        rate = F.col("family_b") / F.nullif(F.col("family_n"), F.lit(0.0))
        gap = F.col("b") - F.col("n") * rate
        alike = F.coalesce(gap * gap <= tree.deviations**2 * F.col("n") * rate * (1 - rate), F.lit(True))
        renamed = nodes.join(families, ["host", "family"]).select(
            "host", "name", F.when(alike, F.col("family")).otherwise(F.col("name")).alias("next")
        )
        named = named.join(renamed, ["host", "name"]).withColumn("name", F.col("next")).drop("next")
        named = work_table(named, "url-named")
    return named


def judged(shapes: DataFrame, tree: Tree) -> DataFrame:
    """Templates ``(host, template, purity)``; purity is the smoothed share of bad pages.

    ``shapes`` has ``host, template, labelled, bad`` counts.
    """
    counted = shapes.groupBy("host", "template").agg(
        F.sum("labelled").cast("double").alias("n"), F.sum("bad").cast("double").alias("b")
    )
    named = merged(counted, tree)
    n_all, b_all = named.agg(F.sum("n"), F.sum("b")).first()
    hosts = named.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("b").alias("host_b"))
    whole = named.groupBy("host", "name").agg(F.sum("n").alias("name_n"), F.sum("b").alias("name_b")).join(hosts, "host")
    m = F.lit(tree.smoothing)
    base = b_all / n_all if n_all else 0.0
    prior = (F.col("host_b") + m * F.lit(base)) / (F.col("host_n") + m)
    purity = ((F.col("name_b") + m * prior) / (F.col("name_n") + m)).alias("purity")
    return named.join(whole, ["host", "name"]).select("host", "template", purity)


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, tree: Tree = Tree()) -> DataFrame:
    """A row per row of ``pages`` (``page_id``, ``url``): host, path, rule and verdict.

    ``labels``: ``(doc_id, bad boolean)`` of documents; the number that ends a path names
    its document. Nulls in it are left out; a document is bad if one of its rows says so.
    A null url, or one without ``://``, has an empty host and path and no rule; it is
    judged by its template like any other. Repeated rows are judged alike. Without labels
    nothing is rejected but by rule. An empty table gives no rows.
    """
    parsed = pages.select("page_id", host("url").alias("host"), path("url").alias("path"))
    parsed = work_table(parsed.withColumn("shape", shape()), "url-pages")
    known = labels.filter("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    named = parsed.select("host", "shape", F.regexp_extract("path", DOCUMENT, 1).try_cast("long").alias("doc_id"))
    # Counted per document first: then a page asked for again and again is one row.
    asked = named.groupBy("host", "shape", "doc_id").agg(F.count(F.lit(1)).alias("pages"))
    marked = asked.join(known, "doc_id", "left")
    shapes = marked.groupBy("host", "shape").agg(
        F.sum("pages").alias("pages"),
        F.sum(F.when(F.col("bad").isNull(), 0).otherwise(F.col("pages"))).alias("labelled"),
        F.sum(F.coalesce(F.col("bad") * F.col("pages"), F.lit(0))).alias("bad"),
    )
    grown = work_table(templates(shapes, tree), "url-shapes")
    verdicts = grown.select("host", "shape", "template").join(judged(grown, tree), ["host", "template"])
    ruled = parsed.withColumn("_rule", matching_rule(rules))
    found = ruled.join(verdicts, ["host", "shape"], "left")
    own = F.when(F.col("purity") >= tree.limit, "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"),
        "template",
        "purity",
    )


def _sql(tree: Tree = Tree()) -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))" for _, h, p in rules]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, rules))
    verdict = " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, rules))
    ctes = [
        f"""parsed as materialized (select page_id,
          translate(coalesce(regexp_extract(url, '{HOST}', 1, 's'), ''), '{UPPER}', '{LOWER}') as host,
          coalesce(regexp_extract(url, '{PATH}', 1, 's'), '') as path from pages)""",
        f"""shaped as materialized (select *, array_to_string(list_transform(string_split(path, '/'), lambda s:
          case when regexp_full_match(s, '{NUMBER}') then regexp_replace(s, '^[0-9]+', '{{n}}')
               when regexp_full_match(s, '{CODE}') then '{{x}}' else s end), '/') as shape,
          try_cast(nullif(regexp_extract(path, '{DOCUMENT}', 1), '') as bigint) as doc_id from parsed)""",
        """known as (select doc_id, max(cast(quality = 0 or toxic = 1 as bigint)) as bad from labels group by doc_id)""",
        """level0 as materialized (select host, shape, count(*)::bigint as pages, count(bad)::bigint as labelled,
          coalesce(sum(bad), 0)::bigint as bad, '' as template, string_split(shape, '/') as parts
          from shaped left join known using (doc_id) group by host, shape)""",
    ]
    for level in range(1, tree.depth):
        before = f"level{level - 1}"
        ctes.append(
            f"""level{level} as materialized (with here as (select *, parts[{level + 1}] as part from {before}),
            counts as (select host, template, part, sum(pages) as n from here where part is not null group by host, template, part)
            select h.host, h.shape, h.pages, h.labelled, h.bad,
              case when h.part is null then h.template
                when h.part = '' or regexp_matches(h.part, '^\\{{[nx]\\}}')
                  or n >= {tree.least_pages}
                then h.template || '/' || h.part else h.template || '/*' end as template, h.parts
            from here h left join counts c on c.host = h.host and c.template = h.template and c.part = h.part)"""
        )
    last = f"level{tree.depth - 1}"
    m = f"{tree.smoothing}::double"
    ctes += [
        f"""grown as materialized (select host, shape, labelled, bad,
          case when len(parts) > {tree.depth} then template || '/**' else template end as template from {last})""",
        f"""named{tree.depth} as materialized (select host, template, template as name, sum(labelled)::double as n,
          sum(bad)::double as b from grown group by host, template)""",
    ]
    for level in range(tree.depth - 1, 0, -1):
        rate = "(fb / nullif(fn, 0))"
        ctes.append(
            f"""named{level} as materialized (with nodes as (
              select host, name, sum(n) as n, sum(b) as b, string_split(name, '/') as parts from named{level + 1} group by host, name),
            sided as (select *, case when regexp_matches(coalesce(parts[{level + 1}], ''), '^[^{{]')
              then array_to_string(list_concat(parts[1:{level}], ['*'], parts[{level + 2}:]), '/') else name end as family from nodes),
            rated as (select *, sum(n) over (partition by host, family) as fn, sum(b) over (partition by host, family) as fb from sided),
            renamed as (select host, name, case when coalesce((b - n * {rate}) * (b - n * {rate})
              <= {tree.deviations**2} * n * {rate} * (1 - {rate}), true) then family else name end as next from rated)
            select t.host, t.template, r.next as name, t.n, t.b from named{level + 1} t join renamed r
              on r.host = t.host and r.name = t.name)"""
        )
    ctes += [
        f"""judged as (select host, template,
          (sum(b) over (partition by host, name) + {m} * ((hb + {m} * coalesce(ab / nullif(an, 0), 0)) / (hn + {m})))
          / (sum(n) over (partition by host, name) + {m}) as purity
          from (select *, sum(n) over (partition by host) as hn, sum(b) over (partition by host) as hb,
            sum(n) over () as an, sum(b) over () as ab from named1))""",
    ]
    return f"""with {', '.join(ctes)}
      select page_id, s.host, s.path, case {rule} end as rule,
        coalesce(case {verdict} end, case when purity >= {tree.limit} then 'block' else 'allow' end) as verdict,
        template, purity
      from shaped s left join grown using (host, shape) left join judged using (host, template)"""


@query("op10_url_templates", _sql())
def op10_url_templates(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels)
