"""URL filter: rules first, then trust that spreads over the graph of hosts.

A rule (host and path prefix) decides the urls it fits; the longest fitting rule wins.
Other urls follow their host: hosts that allow rules mostly cover are trusted seeds,
hosts that block rules mostly cover are blocked seeds.  Trust is a personalised
PageRank from the trusted seeds along links between hosts, distrust one from the
blocked seeds against them.  A host is blocked whose distrust exceeds its trust by a ratio
and reaches a threshold of its own: a least share of a seed's mass times what the host takes
in of its targets' masses in one step, at most 1.  So a host that links to blocked hosts
alone is blocked however many others do the same.  All of it is DataFrame expressions.

Links are the hosts of absolute ``href`` targets, counted once a page.  They are
pre-aggregated to weighted host pairs before the first shuffle, and both directions
run in one loop over (host, kind) masses, which holds reached hosts only.  Sums are written to
the shared folder before they are joined, so that the edges of a hub host split.  A few
rules are one expression on every row; more are joined, by equal host and path prefix.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no
rule and is allowed unless the empty host is (it never is) blocked; null pages have no
links; links of a host to itself do not count; the mass of hosts without further links
is dropped; rules of equal length: the one that sorts first; repeated rows and ids are
judged one by one; an empty table gives an empty result; extra columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link's target.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/"'\s>?#]+)"""
#: Up to so many rules are an expression on every row; more are joined.
EXPRESSION_RULES = 50
#: Up to so many rules are broadcast (a few dozen bytes each).
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str  # allow or block

    @classmethod
    def parse(cls, rule: str, action: str) -> Rule:
        host, slash, path = rule.partition("/")
        if action not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {action} {rule}")
        return cls(host.translate(str.maketrans(UPPER, LOWER)), slash + path, action)

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest fitting rule; null where none fits."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.action)).otherwise(action)
    return text, action


def with_rules(urls: DataFrame, rules: list[Rule], *, expression_rules: int = EXPRESSION_RULES) -> DataFrame:
    """``urls`` (with host and path) and the text and action of their longest fitting rule.

    Beyond ``expression_rules`` every distinct (host, path) meets the rules of its domain
    suffixes, and of these only those that equal the beginning of its path.
    """
    if len(rules) <= expression_rules:
        rule, action = matching_rule(F.col("host"), F.col("path"), rules)
        return urls.withColumns({"rule": rule, "action": action})
    spark = urls.sparkSession
    # Of rules of the same text the last one given holds, as in the expression.
    table = spark.createDataFrame([(r.host, r.path, r.text, r.action) for r in {r.text: r for r in rules}.values()], "zone string, prefix string, rule string, action string")
    lengths = table.groupBy("zone").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    if len(rules) <= BROADCAST_RULES:
        table, lengths = F.broadcast(table), F.broadcast(lengths)
    labels = F.split("host", "[.]")
    zones = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = urls.where("host <> ''").select("host", "path").distinct()
    met = pairs.select("host", "path", F.explode(zones).alias("zone")).join(lengths, "zone")
    met = met.select("host", "path", "zone", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    met = met.select("host", "path", "zone", F.substr("path", F.lit(1), F.col("n")).alias("prefix")).join(table, ["zone", "prefix"])
    # The longest, of equal length the one that sorts first.
    longest = met.groupBy("host", "path").agg(F.max(F.length("rule")).alias("n"))
    best = met.join(longest, ["host", "path"]).where(F.length("rule") == F.col("n"))
    best = cut(best.groupBy("host", "path").agg(F.min(F.struct("rule", "action")).alias("best")).select("host", "path", "best.rule", "best.action"))
    return urls.join(best, ["host", "path"], "left")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, w): pages of host src that link to host dst, src and dst apart."""
    host, _ = url_parts(F.col(url_col))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))
    linked = pages.select(host.alias("src"), F.explode(targets).alias("dst"))
    return linked.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def host_steps(links: DataFrame) -> DataFrame:
    """(kind, a, b, share): the share of a's mass that goes to b, along links for kind
    ``trust`` and against them for ``distrust``."""
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "w")
    )
    both = cut(both)
    total = cut(both.groupBy("kind", "a").agg(F.sum("w").alias("total")))
    return cut(both.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("w") / F.col("total")).alias("share")))


def spread(steps: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(host, kind, mass) after ``rounds`` rounds from ``seeds`` (host, kind, mass)."""
    fresh = seeds.select("host", "kind", (F.col("mass") * (1 - damping)).alias("mass"))
    state = fresh
    if not steps.take(1):
        return state
    for _ in range(rounds):
        moved = steps.join(state.withColumnRenamed("host", "a"), ["kind", "a"]).select(
            F.col("b").alias("host"), "kind", (F.col("share") * F.col("mass") * damping).alias("mass")
        )
        state = cut(moved.unionByName(fresh).groupBy("host", "kind").agg(F.sum("mass").alias("mass")))
    return state


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    *,
    damping: float = 0.85,
    rounds: int = 10,
    least: float = 0.01,
    ratio: float = 1.0,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust.

    ``least`` is measured against the mass of one blocked seed, see above.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = with_rules(urls, rules)
    per_host = (
        urls.where("host <> ''").groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "allow").alias("allow"), F.count_if(F.col("action") == "block").alias("block"))
    )
    chosen = cut(
        per_host.select("host", F.when(F.col("block") * 2 >= F.col("n"), F.lit("distrust")).when(F.col("allow") * 2 >= F.col("n"), F.lit("trust")).alias("kind"))
        .where("kind is not null")
    )
    numbers = {r["kind"]: r["n"] for r in chosen.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if numbers:
        mass = F.when(F.col("kind") == "trust", F.lit(1.0 / max(numbers.get("trust", 0), 1))).otherwise(F.lit(1.0 / max(numbers.get("distrust", 0), 1)))
        steps = host_steps(host_links(pages, url_col, html_col))
        state = spread(steps, chosen.withColumn("mass", mass), damping=damping, rounds=rounds)
        taken = steps.where("kind = 'distrust'").select(F.col("b").alias("host"), F.lit("taken").alias("kind"), F.col("share").alias("mass"))
        state = state.unionByName(taken)
    else:
        state = chosen.withColumn("mass", F.lit(0.0))
    one_seed = 1.0 / max(numbers.get("distrust", 0), 1)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))
    judged = cut(state.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"), of("taken").alias("taken")))
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= least * one_seed * F.least(F.lit(1.0), F.col("taken"))) & (F.col("distrust") > ratio * F.col("trust"))
    found = urls.join(judged.withColumn("bad", blocked), "host", "left")
    verdict = F.coalesce(F.col("action"), F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def oracle(rules: list[Rule], *, damping: float = 0.85, rounds: int = 10, least: float = 0.01, ratio: float = 1.0) -> str:
    """DuckDB SQL for page_id, host, path, rule, verdict of ``judge_urls`` over ``pages``."""
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered) + " END"
    link = LINK.replace("'", "''")
    parts = [
        "WITH a AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "b AS (SELECT page_id, html, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM a)",
        f"c AS (SELECT page_id, html, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM b)",
        f"u AS MATERIALIZED (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.action)} AS act FROM c)",
        "h AS (SELECT host, count(*) AS n, count(*) FILTER (act = 'allow') AS al, count(*) FILTER (act = 'block') AS bl FROM u WHERE host <> '' GROUP BY host)",
        "s0 AS (SELECT host, CASE WHEN bl * 2 >= n THEN 'distrust' WHEN al * 2 >= n THEN 'trust' END AS kind FROM h)",
        "s1 AS (SELECT host, kind, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS mass FROM s0 WHERE kind IS NOT NULL)",
        f"l0 AS (SELECT page_id, host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM u)",
        "l AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM l0 WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst)",
        "e0 AS (SELECT 'trust' AS kind, src AS a, dst AS b, w FROM l UNION ALL SELECT 'distrust', dst, src, w FROM l)",
        "e AS MATERIALIZED (SELECT kind, a, b, w::DOUBLE / sum(w) OVER (PARTITION BY kind, a) AS share FROM e0)",
        f"f AS MATERIALIZED (SELECT host, kind, mass * {1 - damping!r} AS mass FROM s1)",
        "r0 AS MATERIALIZED (SELECT * FROM f)",
    ]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT host, kind, sum(mass) AS mass FROM (SELECT e.b AS host, e.kind, e.share * r.mass * {damping!r} AS mass "
            f"FROM e JOIN r{i} r ON e.a = r.host AND e.kind = r.kind UNION ALL SELECT host, kind, mass FROM f) GROUP BY host, kind)"
        )
    parts.append("q AS (SELECT b AS host, sum(share) AS taken FROM e WHERE kind = 'distrust' GROUP BY b)")
    parts.append(f"j AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS d FROM r{rounds} GROUP BY host)")
    parts.append("o AS (SELECT 1.0::DOUBLE / greatest(count(*), 1) AS one FROM s0 WHERE kind = 'distrust')")
    return ",\n".join(parts) + (
        f"\nSELECT page_id, u.host, path, rule, coalesce(act, CASE WHEN j.d > 0 AND j.d >= {least!r} * o.one * least(1, coalesce(q.taken, 0)) AND j.d > {ratio!r} * j.t THEN 'block' ELSE 'allow' END) AS verdict "
        "FROM u CROSS JOIN o LEFT JOIN j ON u.host = j.host LEFT JOIN q ON u.host = q.host"
    )
