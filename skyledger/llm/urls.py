"""URL rules and link-graph propagation of trust and distrust over hosts.

A url is judged by the longest rule that fits it; where none does, by its host.  Hosts are nodes; links
from pages of one host to another are an edge, weighted by their number, and a host and its parent domain
are joined by an edge of weight 1 in both directions, so that trust also reaches hosts that nobody links to.
Personalised PageRank spreads trust forward from the hosts of allowed pages, and distrust backward, to
those who link there, from the hosts of blocked pages; seeds weigh by their pages.  All pages spread both
ways too, so that a host's distrust over what has reached it backward is a share of blocked pages, and its
trust over what has reached it forward a share of allowed ones.  A host is blocked where the first share
is over `threshold` and over the second.  All four spread in one join a round; after ROUNDS rounds what is
left to move is below DAMPING^ROUNDS of the whole.

Cases: a null url, or one without `://`, has the empty host and path, no rule, and is no node; its verdict
is `allow`, as is that of a host that nothing has reached.  A page without html has no links; a link
without a host stays on its page's host and is no edge.  Of rules of one length the first by text wins.
Repeated rows weigh again as seeds and links, and give repeated results.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import checkpoint, small

#: verdict, host, path: a rule fits its host and all subdomains where the path begins with its path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.6
ROUNDS = 12
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+|//[^"'\s>]+)"""


def host_and_path(df: DataFrame, url_col: str) -> DataFrame:
    """The rows with host and path: what follows the first `://` up to `/`, `?`, `#` or the end, and on up to `?`, `#` or the end."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    return df.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def by_rule(rules) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits host and path, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight: links between hosts, and hosts with their parent domains, from (host, html)."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    found = found.withColumn("link", F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    linked = host_and_path(found, "link").where("host <> '' and host <> src").groupBy("src", F.col("host").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.where("host <> ''").select("host").distinct().unionByName(linked.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    names = hosts.select("host", labels.alias("l")).where(F.size("l") > 2)
    up = names.select(F.explode(F.expr("transform(sequence(1, size(l) - 2), i -> struct(array_join(slice(l, i, size(l)), '.') as a, array_join(slice(l, i + 1, size(l)), '.') as b))")).alias("e")).select("e.a", "e.b").distinct()
    return linked.unionByName(up.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))).unionByName(up.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(1.0).alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trusted and distrusted (shares), from edges (src, dst, weight) and seeds (host, allowed, blocked, pages)."""
    edges = checkpoint(edges)
    out = edges.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("out"))
    into = edges.groupBy(F.col("dst").alias("d")).agg(F.sum("weight").alias("into"))
    forward = edges.join(out, F.col("src") == F.col("s")).select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("out")).alias("f"), F.lit(0.0).alias("b"))
    back = edges.join(into, F.col("dst") == F.col("d")).select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("f"), (F.col("weight") / F.col("into")).alias("b"))
    flow = checkpoint(forward.unionByName(back).groupBy("from", "to").agg(F.sum("f").alias("f"), F.sum("b").alias("b")))
    nodes = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    kinds = {"trust": ("allowed", "f"), "distrust": ("blocked", "b"), "ahead": ("pages", "f"), "behind": ("pages", "b")}
    start = checkpoint(nodes.join(seeds, "host", "left").select("host", *[F.coalesce(F.col(seed), F.lit(0)).cast("double").alias(f"{k}0") for k, (seed, _) in kinds.items()]))
    state = start.select("host", *[F.col(f"{k}0").alias(k) for k in kinds])
    for i in range(rounds):
        moved = flow.join(state, F.col("from") == F.col("host")).groupBy("to").agg(*[F.sum(F.col(k) * F.col(way)).alias(f"{k}1") for k, (_, way) in kinds.items()])
        state = start.join(moved, F.col("host") == F.col("to"), "left").select("host", *[((1 - damping) * F.col(f"{k}0") + damping * F.coalesce(f"{k}1", F.lit(0.0))).alias(k) for k in kinds])
        if i % 3 == 2:
            state = checkpoint(state)
    return state.select("host", F.when(F.col("ahead") > 0, F.col("trust") / F.col("ahead")).otherwise(0.0).alias("trusted"), F.when(F.col("behind") > 0, F.col("distrust") / F.col("behind")).otherwise(0.0).alias("distrusted"))


def judged(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and the host's shares of every row."""
    text, verdict = by_rule(rules)
    own = host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "url").withColumns({"rule": text, "said": verdict})
    seeds = own.where("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"), F.count("*").alias("pages"))
    shares = spread(host_edges(own.select("host", "html")), seeds).withColumnRenamed("host", "of")
    by_host = F.when((F.col("distrusted") > threshold) & (F.col("distrusted") > F.col("trusted")), "block").otherwise("allow")
    return own.join(small(checkpoint(shares)), F.col("host") == F.col("of"), "left").select("page_id", "host", "path", "rule", F.coalesce("said", by_host).alias("verdict"), F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("distrusted", F.lit(0.0)).alias("distrusted"))
