"""URL rules, and trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm.shared import forget, prepared, settle, table

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Share of a host's score that comes over links, error at which rounds end, and the distrust from which a host is
#: blocked if it has less trust. The error is in units of one seed.
DAMPING, SETTLED, THRESHOLD = 0.85, 1e-4, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url: str) -> DataFrame:
    """df with host and path; both empty for a null url and for one without ://."""
    u = f"`{url}`"
    rest = f"substring({u}, instr({u}, '://') + 3)"
    host = f"coalesce(case when instr({u}, '://') > 0 then translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') end, '')"
    path = f"coalesce(case when instr({u}, '://') > 0 then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) end, '')"
    return df.withColumns({"host": F.expr(host), "path": F.expr(path)})


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); null where none fits."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, one) if found is None else found.when(fits, one)
    return found


def edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """src, dst and links between different hosts, from absolute and protocol-relative addresses in pages with a host."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    each = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    return each.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(hosts: DataFrame, links: DataFrame, damping: float = DAMPING) -> DataFrame:
    """host, trust and distrust from hosts (host, trusted, blocked: shares of seeds) and links (src, dst, links).

    trust is personalised PageRank along links from trusted seeds, distrust the same against them from blocked
    seeds, each in units of what one seed's own mass is. The mass of hosts without links goes back to the seeds in
    proportion, which multiplies all scores and that unit alike, so that in these units it need not be carried: a far
    host that loses its links changes no other score. Both spread in one pass: an edge for trust and a turned one for distrust.
    Without links the seeds are the scores. A round adds the paths that are one link longer, so scores grow and all
    that later rounds can add, to any host, is damping / (1 - damping) of what this one added to all; rounds end once
    that is below SETTLED. Their number follows the logarithm of the number of seeds.
    """
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("trusted").alias("seed")), F.struct(F.lit(1).alias("way"), F.col("blocked").alias("seed")))).alias("s")).select("host", "s.way", "s.seed")
    if not links.isEmpty():
        ways = settle(links.select(F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("src").alias("from"), F.col("dst").alias("to"), "links"), F.struct(F.lit(1).alias("way"), F.col("dst").alias("from"), F.col("src").alias("to"), "links"))).alias("e")).select("e.*"), "ways")
        out = ways.groupBy("way", "from").agg(F.sum("links").alias("total"))
        counted, ways = ways, settle(ways.join(out, ["way", "from"]).select("way", "from", "to", (F.col("links") / F.col("total")).alias("part")), "ways")
        forget(counted)
        ends = ways.select(F.col("to").alias("host"), "way", F.lit(0.0).alias("seed"))
        seeds = settle(seeds.union(ends).groupBy("host", "way").agg(F.sum("seed").alias("seed")), "seeds")
        scores = settle(seeds.select("host", "way", ((1 - damping) * F.col("seed")).alias("score")), "scores")
        while True:
            sent = ways.join(scores, (ways["from"] == scores["host"]) & (ways["way"] == scores["way"])).groupBy(F.col("to").alias("host"), ways["way"]).agg(F.sum(F.col("part") * F.col("score")).alias("got"))
            again = settle(seeds.join(sent, ["host", "way"], "left").select("host", "way", ((1 - damping) * F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("score")), "scores")
            moved = again.join(scores.withColumnRenamed("score", "old"), ["host", "way"]).agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("all")).first()["all"]
            forget(scores)
            scores = again
            if damping * (moved or 0.0) < SETTLED * (1 - damping) ** 2:
                break
        seeds = scores.select("host", "way", (F.col("score") / (1 - damping)).alias("seed"))
    return seeds.groupBy("host").agg(F.sum(F.when(F.col("way") == 0, F.col("seed"))).alias("trust"), F.sum(F.when(F.col("way") == 1, F.col("seed"))).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    A page without a fitting rule gets its host's verdict: block if the host's distrust reaches the threshold and
    exceeds its trust, else allow; a page without a host is allowed. A host's seeds are the shares of its pages
    that rules allow or block. Null urls and html, repeated rows and an empty table are allowed; other columns are
    not read. The list of rules is part of the plan, so it should have at most some hundreds.
    """
    prepared(pages.sparkSession)
    chosen = split_url(pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), "url")
    ruled = chosen.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0))
    hosts = ruled.where("host != ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    links = settle(edges(chosen), "links")
    verdicts = settle(propagate(hosts, links).where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host"), "blocked")
    open_ = ruled.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    joined = open_.join(verdicts.withColumn("bad", F.lit(True)), "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(table(spark, sf_dir, "pages"))
