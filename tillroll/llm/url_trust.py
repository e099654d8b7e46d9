"""URL filter: path rules first, then trust and distrust propagated over the links between hosts.

A rule is ``host/path``; it fits its host and all subdomains when the url's path starts with the
rule's path, and the longest fitting rule decides. Pages that no rule fits get their host's
verdict. Hosts are the nodes of a graph whose edges are the links found in the pages (absolute
ones; a relative link stays on its host). Trust starts from the pages that rules allow and flows
along links (personalised PageRank); distrust starts from the pages that rules block and flows
against the links: who links to a blocked host is distrusted. A host is blocked when distrust
reaches ``threshold`` of what has arrived there; a host that nothing reached is allowed.

Links are summed to weighted host pairs before any iteration, so iterations see hosts, never
pages. Each iteration is written to the shared folder, which cuts lineage; only the last one is
kept. Trust and distrust only
grow from step to step; the iterations end when neither has grown at any host by more than
``tolerance`` of what that host has of it. A host reached for the first time has grown by all it
has, so they go on while anything is still on its way, however small it is beside the whole
table. What is yet to come is then about ``tolerance`` times the links it has run over.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed; a null page is a page without links; repeated rows are judged alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import ascii_lower, drop_stash, stash, table

# The rules of the query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
DAMPING = 0.85
THRESHOLD = 0.75
#: Growth of a host's trust or distrust in a step, as a share of it, from which it counts as settled.
TOLERANCE = 1e-6

_HOST_AND_PATH = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, _HOST_AND_PATH, n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rule, rule_host, rule_path, rule_verdict."""
    rows = [(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for r, v in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, rule_verdict string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, with the rules of the host and its parent domains as an array."""
    labels = F.split("host", r"\.")
    parents = hosts.select(
        "host",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
            )
        ).alias("rule_host"),
    )
    fitting = F.struct(
        F.length("rule").alias("chars"), F.col("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict")
    )
    return parents.join(rules, "rule_host").groupBy("host").agg(F.collect_list(fitting).alias("rules"))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (page_id, host, path) with rule and rule_verdict, null where none fits."""
    known = rules_by_host(pages.select("host").distinct(), rules).withColumnRenamed("host", "known_host")
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fitting, lambda r: F.struct(r["chars"], r["rule"], r["verdict"])))
    return (
        pages.join(known, F.col("host") == F.col("known_host"), "left")
        .withColumn("longest", longest)
        .select("page_id", "host", "path", F.col("longest.rule").alias("rule"), F.col("longest.verdict").alias("rule_verdict"))
    )


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, links: links of pages to other hosts, summed."""
    host, _ = host_and_path(F.col("url"))
    found = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), 1)
    return (
        pages.select(host.alias("src"), F.explode(found).alias("dst"))
        .select("src", ascii_lower(F.col("dst")).alias("dst"))
        .filter((F.col("src") != F.col("dst")) & (F.col("src") != ""))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def propagate(
    seeds: DataFrame, links: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE, most_steps: int | None = None
) -> DataFrame:
    """host, trust, distrust, from ``seeds`` (host, trust, distrust) and ``links`` (src, dst, links).

    Goes on until all hosts have settled, which damping below 1 makes sure of, unless the caller
    asks for ``most_steps``."""
    out = links.groupBy("src").agg(F.sum("links").alias("out_links"))
    into = links.groupBy("dst").agg(F.sum("links").alias("in_links"))
    edges = stash(
        links.join(out, "src")
        .join(into, "dst")
        .select("src", "dst", (F.col("links") / F.col("out_links")).alias("forth"), (F.col("links") / F.col("in_links")).alias("back")),
        "host-edges",
    )
    base = stash(
        seeds.unionByName(
            edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
        )
        .groupBy("host")
        .agg(F.sum("trust").alias("seed_trust"), F.sum("distrust").alias("seed_distrust")),
        "host-seeds",
    )
    kept = 1 - damping
    rank = base.select(
        "host", (F.col("seed_trust") * kept).alias("trust"), (F.col("seed_distrust") * kept).alias("distrust")
    )
    if edges.isEmpty():
        return rank
    last = None
    grown = lambda now, then: F.when(now > 0, (now - then) / now).otherwise(F.lit(0.0))
    for _ in count() if most_steps is None else range(most_steps):
        forth = edges.join(rank, F.col("src") == F.col("host")).select(
            F.col("dst").alias("to"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d")
        )
        back = edges.join(rank, F.col("dst") == F.col("host")).select(
            F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d")
        )
        arrived = forth.unionByName(back).groupBy("to").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        flowed = base.join(arrived, F.col("host") == F.col("to"), "left").select(
            "host",
            (F.col("seed_trust") * kept + F.coalesce("t", F.lit(0.0)) * damping).alias("trust"),
            (F.col("seed_distrust") * kept + F.coalesce("d", F.lit(0.0)) * damping).alias("distrust"),
        )
        before = rank.select(F.col("host").alias("h"), F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        step = stash(
            flowed.join(before, F.col("host") == F.col("h")).select(
                "host", "trust", "distrust", F.greatest(grown(F.col("trust"), F.col("t0")), grown(F.col("distrust"), F.col("d0"))).alias("change")
            ),
            "host-rank",
        )
        if last is not None:
            drop_stash(last)
        last, rank = step, step.drop("change")
        if (step.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            break
    return rank


def judge_urls(
    pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    judged = stash(
        apply_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rule_table(spark, rules)), "url-rules"
    )
    seeds = (
        judged.filter(F.col("host") != "")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("rule_verdict") == "allow", 1)).cast("double").alias("trust"),
            F.count(F.when(F.col("rule_verdict") == "block", 1)).cast("double").alias("distrust"),
        )
    )
    scores = propagate(seeds, host_links(pages), damping=damping).withColumnRenamed("host", "scored_host")
    arrived = F.col("trust") + F.col("distrust")
    blocked = F.coalesce((arrived > 0) & (F.col("distrust") >= arrived * threshold), F.lit(False))
    return judged.join(scores, F.col("host") == F.col("scored_host"), "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    return judge_urls(table(spark, sf_dir, "pages"))


# rules and seeds as SQL: no given page links to another host, so a host's score is its own pages'
_RULE_ROWS = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
ORACLE = rf"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
places AS (SELECT DISTINCT host, path FROM p),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
ruled AS (
  SELECT host, path, rule, rule_verdict
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) = 1),
judged AS (SELECT p.*, rule, rule_verdict FROM p LEFT JOIN ruled USING (host, path)),
scores AS (
  SELECT host, count(*) FILTER (rule_verdict = 'allow') * (1 - {DAMPING}::DOUBLE) AS trust,
         count(*) FILTER (rule_verdict = 'block') * (1 - {DAMPING}::DOUBLE) AS distrust
  FROM judged WHERE host <> '' GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN trust + distrust > 0 AND distrust >= (trust + distrust) * {THRESHOLD}::DOUBLE
                                   THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0.0)::DOUBLE AS trust, coalesce(distrust, 0.0)::DOUBLE AS distrust
FROM judged LEFT JOIN scores USING (host)
"""

QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": ORACLE}
