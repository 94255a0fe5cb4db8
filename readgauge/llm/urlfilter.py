"""URL filters by rules and by propagation of trust over the graph of hosts.

Rules name a host (with its subdomains) and the begin of a path; the longest that fits decides. Hosts without such a rule are
judged by the graph: pages link hosts (links within a page's host count as an edge to itself), and a subdomain and its
parent domain vouch for each other. Trust is the personalised PageRank from hosts whose pages an allow rule covers; distrust
is the PageRank over the reversed edges from hosts whose pages a block rule covers. A host is blocked when its distrust
exceeds its trust by the factor THRESHOLD. Walks are followed until what still moves, summed over all hosts, is below TOLERANCE and
no host is met for the first time; so every host that links tie to a seed has a rank. A host that neither reaches is allowed.

Null urls and those without ``://`` have an empty host and path, which belong to no host: allowed. Repeated rows each get
a row. Only SQL functions are used; ranks are tables with a row per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

# Verdict and rule; the host ends at the first slash.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
DAMPING = 0.85
TOLERANCE = 1e-6
CUT_EVERY = 4
JUMP_ROWS = 1_000_000
JUMP_GROWTH = 4
THRESHOLD = 1.0
SUBDOMAIN_WEIGHT = 1.0


def url_rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))


def rule_table(spark, rules=RULES) -> DataFrame:
    rows = [(v, r, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, rule_host string, rule_path string")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``: the longest rule that fits, else null.

    Rules are gathered per distinct host, so a page carries only those of its own host; a host with a third of all pages
    is an ordinary skewed join, which adaptive execution splits.
    """
    hosts = pages.select("host").where("host != ''").distinct()
    suffixes = hosts.select("host", F.explode(domains(F.col("host"))).alias("rule_host"))
    lists = suffixes.join(rules, "rule_host").groupBy("host").agg(F.collect_list(
        F.struct(F.length("rule").alias("length"), "rule", "rule_path", "verdict")).alias("host_rules"))
    fits = F.filter("host_rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    longest = F.array_max(fits)
    return pages.join(lists, "host", "left").withColumn("best", longest).withColumns(
        {"rule": F.col("best.rule"), "rule_verdict": F.col("best.verdict")}).drop("host_rules", "best")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` from ``host, html``: links of the pages, and each host with its parent domain."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?([^"'\s>]*)"""), F.lit(1))
    targets = F.transform(links, lambda x: F.when(F.instr(x, "://") > 0, host_of(x)).when(
        F.startswith(x, F.lit("//")), host_of(F.concat(F.lit("http:"), x))).otherwise(F.col("host")))
    linked = pages.where("host != '' and html is not null").select("host", F.explode(targets).alias("dst"))
    linked = linked.where("dst != ''").groupBy(F.col("host").alias("src"), "dst").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select("host").unionByName(linked.select(F.col("dst").alias("host"))).where("host != ''").distinct()
    family = hosts.select(F.explode(neighbours(F.col("host"))).alias("pair")).select("pair.*").distinct()
    both = family.select(F.col("child").alias("src"), F.col("parent").alias("dst")).unionByName(
        family.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    return linked.unionByName(both.withColumn("weight", F.lit(SUBDOMAIN_WEIGHT))).groupBy("src", "dst").agg(
        F.sum("weight").alias("weight"))


def neighbours(host: Column) -> Column:
    """Pairs of neighbouring domains above ``host``; a top-level domain is nobody's parent."""
    names = domains(host)
    return F.filter(F.zip_with(names, F.slice(names, F.lit(2), F.size(names)), lambda a, b: F.struct(
        a.alias("child"), b.alias("parent"))), lambda p: p["parent"].isNotNull() & p["parent"].contains("."))


def jumps(ways: DataFrame, steps: int, parts: int) -> tuple[DataFrame, int]:
    """``kind, a, z, p, q`` of ``kind, a, z, p``, and how many steps they go at once: 1, 2, 4, up to ``steps``.

    ``p`` is the weight of all walks of just so many steps from a to z, ``q`` that of all walks of so many or fewer. Each doubling joins
    the ways with themselves, if the rows of that join, which are counted before, are JUMP_ROWS or JUMP_GROWTH for each way at most.
    """
    most, length, ways = None, 1, ways.withColumn("q", F.col("p"))
    while 2 * length <= steps:
        ends = F.explode(F.array(F.struct(F.col("z").alias("host"), (F.col("p") > 0).cast("bigint").alias("i"), F.lit(0).alias("o")),
                                 F.struct(F.col("a").alias("host"), F.lit(0).cast("bigint").alias("i"), F.lit(1).alias("o"))))
        met = ways.select("kind", ends.alias("e")).groupBy("kind", "e.host").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
        most = most or max(JUMP_ROWS, JUMP_GROWTH * ways.count())
        if (met.agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0) > most:
            break
        on = ways.select("kind", F.col("a").alias("m"), "z", F.col("p").alias("p2"), F.col("q").alias("q2"))
        far = ways.where("p > 0").select("kind", "a", F.col("z").alias("m"), "p").join(on.hint("merge"), ["kind", "m"]).select(
            "kind", "a", "z", (F.col("p") * F.col("p2")).alias("p"), (F.col("p") * F.col("q2")).alias("q"))
        both = ways.select("kind", "a", "z", F.lit(0.0).alias("p"), "q").unionByName(far).groupBy("kind", "a", "z").agg(
            F.sum("p").alias("p"), F.sum("q").alias("q"))
        ways, length = written(both.coalesce(parts), "host-jumps"), 2 * length
    return ways, length


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, parts: int = 200) -> DataFrame:
    """``host, trust, distrust`` from ``src, dst, weight`` and ``host, allowed, blocked`` (weights of the seeds).

    Both ranks are one table with a ``kind``: ``r``, what has come to a host so far, and ``walk``, what came with the last step and moves
    on with the next. Each host has a way to itself, marked ``own``, on which ``r`` stays; so a step reads the table once, as one join and
    one sum, and plans grow by as much with each step. Rank that reaches a host without edges ends there. The sum of ``walk`` shrinks
    by the damping with each step, which bounds the steps unless there are longer chains of hosts. Every CUT_EVERY
    steps the table is written, which cuts lineage, and looked at. A step's sums lie where its join needs them, and the ways are
    shuffled once for all steps of a plan; a broadcast would instead stay in the driver's memory, one for each step.

    Where the ways of several steps are few (``jumps``), one join takes those steps at once. Tables of hosts are written by ``parts``
    tasks at most: an empty partition of a shuffle costs a task as a full one does, and there are hundreds of shuffles.
    """
    ways = edges.select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("z"), "weight").unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("z"), "weight"))
    totals = ways.groupBy("kind", "a").agg(F.sum("weight").alias("total"))
    ways = written(ways.join(totals, ["kind", "a"]).select(
        "kind", "a", "z", (F.col("weight") / F.col("total") * damping).alias("p")).coalesce(parts), "host-edges")
    hosts = ways.select("kind", F.explode(F.array("a", "z")).alias("a")).unionByName(
        seeds.select(F.explode(F.array(F.lit("t"), F.lit("d"))).alias("kind"), F.col("host").alias("a"))).distinct()
    own = hosts.select("kind", "a", F.col("a").alias("z"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(True).alias("own"))
    ways, length = jumps(ways, CUT_EVERY, parts)
    steps = written(ways.withColumn("own", F.lit(False)).unionByName(own).coalesce(parts), "host-steps")
    start = seeds.select(F.lit("t").alias("kind"), F.col("host").alias("a"), F.col("allowed").alias("w")).unionByName(
        seeds.select(F.lit("d").alias("kind"), F.col("host").alias("a"), F.col("blocked").alias("w"))).where("w > 0")
    sums = start.groupBy("kind").agg(F.sum("w").alias("all"))
    first = F.col("w") / F.col("all") * (1 - damping)
    rank = written(start.join(sums, "kind").select("kind", "a", first.alias("r"), first.alias("walk")).coalesce(parts), "host-rank")
    known = rank.count()
    while True:
        for _ in range(CUT_EVERY // length):
            moved = rank.join(steps.hint("merge"), ["kind", "a"]).where("own or walk > 0").select(
                "kind", F.col("z").alias("a"), F.when(F.col("own"), F.col("r")).otherwise(F.col("walk") * F.col("q")).alias("r"),
                F.when(F.col("own"), 0.0).otherwise(F.col("walk") * F.col("p")).alias("walk"))
            rank = moved.groupBy("kind", "a").agg(F.sum("r").alias("r"), F.sum("walk").alias("walk"))
        rank = written(rank.coalesce(parts), "host-rank")
        moving, met = rank.agg(F.coalesce(F.sum("walk"), F.lit(0.0)), F.count(F.lit(1))).first()
        if moving < tolerance and met == known:
            break
        known = met
    return rank.groupBy(F.col("a").alias("host")).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "t", F.col("r"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "d", F.col("r"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``page_id, url, html``."""
    rule_rows = rule_table(pages.sparkSession, rules)
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    named = with_rules(split.select("page_id", "host", "path"), rule_rows)
    seeds = named.where("rule is not null").groupBy("host").agg(
        F.sum((F.col("rule_verdict") == "allow").cast("double")).alias("allowed"),
        F.sum((F.col("rule_verdict") == "block").cast("double")).alias("blocked"))
    parts = max(1, pages.rdd.getNumPartitions())
    edges = written(host_edges(split.select("host", "html")).coalesce(parts), "host-links")  # read for both directions
    rank = ranks(edges, seeds, tolerance=tolerance, parts=parts)
    out = named.join(rank, "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    graph = F.when(distrust > trust * threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", graph).alias("verdict"),
                      trust.alias("trust"), distrust.alias("distrust"))
