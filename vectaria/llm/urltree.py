"""URL filter by a path-template tree, in DataFrame operations alone.

Per host the segments of paths form a tree. Level by level, lexically variable segments (those
with digits) are written as ``{n}`` patterns, and where a node has many children with few urls
each all of them become the wildcard ``*``. Children with labelled urls whose share of blocked
ones is statistically like that of their siblings together (a two-sided z-test) are merged into
``*`` too. What is left below ``depth`` segments is ``**``. Labels are the verdicts of the given
rules; a template's purity is its share of blocked labelled urls, smoothed by one of each
kind, and templates of purity ``REJECT`` or more are rejected.

Verdicts: the longest fitting rule decides; without one the template's purity does. A url that
is null or has no ``://`` has an empty host and path, fits no rule, and is judged as the other
urls of the empty host, so it is allowed. Repeated rows are judged alike. Every count is a
groupBy with partial sums, so a host with a third of all urls is no hot task; the joins back
are equi-joins that adaptive execution may split. The tree, a row for each different lexical path,
is written after each level, so no level is computed twice. A segment that reads ``*``, ``**``
or ``{n}`` itself counts as that wildcard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectaria.functions.state import Scratch
from vectaria.llm.textbatch import col

#: The rules of the query, as (verdict, host and path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEPTH = 3
#: A node is variable if it has so many children, of on average fewer than so many urls.
MANY_CHILDREN = 16
FEW_URLS = 4
#: Squared z below which a branch is like its siblings.
SIMILAR = 4.0
#: Smoothed purity, in parts of a thousand, from which a template is rejected.
REJECT = 800

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(df: DataFrame) -> DataFrame:
    """Rows with a ``url``, with __host and __path."""
    url = F.col("url")
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    df = df.withColumn("__after", F.coalesce(after, F.lit("")))
    df = df.withColumn("__raw_host", F.regexp_extract("__after", r"^[^/?#]*", 0))
    df = df.withColumn("__path", F.regexp_extract(F.expr("substring(__after, length(__raw_host) + 1)"), r"^[^?#]*", 0))
    return df.withColumn("__host", F.translate("__raw_host", _UPPER, _LOWER)).drop("__after", "__raw_host")


def _rule(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    host, path = F.col("__host"), F.col("__path")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def template_tree(df: DataFrame, url_col: str = "url", *, rules=RULES, depth: int = DEPTH, reject: int = REJECT) -> DataFrame:
    """``df`` with columns host, path, rule, template, purity and verdict (columns of these names are replaced)."""
    mine = ("host", "path", "rule", "template", "purity", "verdict")
    keep = [c for c in df.columns if c not in mine or c == url_col]
    # columns are named by position here, so that none clashes with those made below
    rows = _split(df.select(*[col(c).alias(f"c{k}") for k, c in enumerate(keep)], col(url_col).alias("url")))
    tables = Scratch(df.sparkSession, "url-tree")
    name, verdict = _rule(rules)
    rows = rows.withColumn("__rule", name).withColumn("__said", verdict)
    segments = F.filter(F.split("__path", "/"), lambda s: s != "")
    rows = rows.withColumn("__seg", F.transform(segments, lambda s: F.regexp_replace(s, "[0-9]+", "{n}")))
    for k in range(1, depth + 1):
        rows = rows.withColumn(f"__s{k}", F.coalesce(F.get("__seg", F.lit(k - 1)), F.lit("")))
    rows = rows.withColumn(f"__s{depth + 1}", F.when(F.size("__seg") > depth, "**").otherwise(""))

    # urls by their lexical path: a table of templates in the making, with counts
    levels = [f"__s{k}" for k in range(1, depth + 2)]
    labelled, blocked = F.count("__said").alias("__m"), F.count_if(F.col("__said") == "block").alias("__b")
    paths = rows.groupBy("__host", *levels).agg(F.count(F.lit(1)).alias("__n"), labelled, blocked)
    tree = tables.write("paths", paths)
    for k in range(1, depth + 1):
        before, own, made = [f"__t{j}" for j in range(1, k)], f"__s{k}", f"__t{k}"
        node = ["__host", *before]
        child = tree.groupBy(*node, own).agg(*[F.sum(c).alias(c) for c in ("__n", "__m", "__b")])
        parent = child.groupBy(*node).agg(F.count(F.lit(1)).alias("__k"), F.sum("__n").alias("__pn"), F.sum("__m").alias("__pm"), F.sum("__b").alias("__pb"))
        child = child.join(parent, node)
        many = (F.col("__k") >= MANY_CHILDREN) & (F.col("__pn") < FEW_URLS * F.col("__k"))
        # siblings' counts: rest = parent - child; (b/m - rb/rm)^2 <= z^2 p (1 - p) (1/m + 1/rm), multiplied out
        m, b, pm, pb = (F.col(c).cast("double") for c in ("__m", "__b", "__pm", "__pb"))
        rm, rb = pm - m, pb - b
        like = (m > 0) & (rm > 0) & ((b * rm - rb * m) * (b * rm - rb * m) * pm <= F.lit(SIMILAR) * pb * (pm - pb) * m * rm)
        child = child.withColumn(made, F.when((F.col(own) != "") & (many | like), "*").otherwise(F.col(own)))
        tree = tables.write("paths", tree.join(child.select(*node, own, made), [*node, own]))
    tree = tree.withColumn("__template", F.concat_ws("/", "__host", *[F.when(F.col(c) != "", F.col(c)) for c in (*[f"__t{k}" for k in range(1, depth + 1)], levels[-1])]))
    total = tree.groupBy("__template").agg(F.sum("__m").alias("__m"), F.sum("__b").alias("__b"))
    bad = 1000 * (F.col("__b") + 1) >= reject * (F.col("__m") + 2)
    total = total.select("__template", F.round((F.col("__b") + 1) / (F.col("__m") + 2), 6).alias("__purity"), bad.alias("__bad"))
    tree = tables.write("templates", tree.select("__host", *levels, "__template").join(total, "__template"))
    tables.drop("paths")
    out = rows.join(tree, ["__host", *levels], "left")
    decided = F.coalesce("__said", F.when(F.col("__bad"), "block").otherwise("allow"))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__template").alias("template"), F.col("__purity").alias("purity"), decided.alias("verdict"))


def op6(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return template_tree(pages).drop("url")


def _sql() -> str:
    """The same tree for the fixed depth, in DuckDB's dialect."""
    fits = lambda r: f"((host = '{r[: r.index('/')]}' OR host LIKE '%.{r[: r.index('/')]}') AND starts_with(path, '{r[r.index('/') :]}'))"
    longest = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    said = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest)
    segs = ", ".join(f"coalesce(seg[{k}], '') AS s{k}" for k in range(1, DEPTH + 1))
    names = [f"s{k}" for k in range(1, DEPTH + 2)]
    parts = [
        "a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host FROM a)",
        "p AS (SELECT page_id, host, regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM h)",
        f"r AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '{{n}}', 'g')) AS seg FROM p)",
        f"w AS (SELECT *, {segs}, CASE WHEN len(seg) > {DEPTH} THEN '**' ELSE '' END AS s{DEPTH + 1} FROM r)",
        f"g0 AS (SELECT host, {', '.join(names)}, count(*) AS n, count(said) AS m, count(*) FILTER (said = 'block') AS b FROM w GROUP BY ALL)",
    ]
    for k in range(1, DEPTH + 1):
        node = ", ".join(["host", *[f"t{j}" for j in range(1, k)]])
        parts += [
            f"c{k} AS (SELECT {node}, s{k}, sum(n) AS n, sum(m)::DOUBLE AS m, sum(b)::DOUBLE AS b FROM g{k - 1} GROUP BY ALL)",
            f"q{k} AS (SELECT *, count(*) OVER v AS k, sum(n) OVER v AS pn, sum(m) OVER v AS pm, sum(b) OVER v AS pb FROM c{k} WINDOW v AS (PARTITION BY {node}))",
            f"z{k} AS (SELECT {node}, s{k}, CASE WHEN s{k} <> '' AND ((k >= {MANY_CHILDREN} AND pn < {FEW_URLS} * k) OR (m > 0 AND pm - m > 0 AND (b * (pm - m) - (pb - b) * m) * (b * (pm - m) - (pb - b) * m) * pm <= {SIMILAR}::DOUBLE * pb * (pm - pb) * m * (pm - m))) THEN '*' ELSE s{k} END AS t{k} FROM q{k})",
            f"g{k} AS (SELECT g{k - 1}.*, t{k} FROM g{k - 1} JOIN z{k} USING ({node}, s{k}))",
        ]
    tail = ", ".join(f"nullif({c}, '')" for c in (*[f"t{k}" for k in range(1, DEPTH + 1)], names[-1]))
    parts += [
        f"tree AS (SELECT *, concat_ws('/', host, {tail}) AS template FROM g{DEPTH})",
        f"total AS (SELECT template, round((sum(b) + 1) / (sum(m) + 2), 6)::DOUBLE AS purity, 1000 * (sum(b) + 1) >= {REJECT} * (sum(m) + 2) AS bad FROM tree GROUP BY template)",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, w.host, path, rule, template, purity, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM w JOIN tree USING (host, {', '.join(names)}) JOIN total USING (template)"


OP6_SQL = _sql()
