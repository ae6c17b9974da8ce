"""Which pages may be crawled, from robots.txt responses fetched before (A1).

Each host's text is parsed once to rows: groups of lines by windows over the line numbers, then the rules of the one group that is for our
agent. A page's first matching rule is found by a join: of its path the prefixes that are as long as some rule of its host are
compared for equality with the rules, so neither the number of rules nor a host with most of the pages makes a task long. All in
Column expressions; answers are those of the standard library's reader, for rules that are paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebasket.settings import DEFAULTS, Settings

# Where lines end, what is blank, the lines that are rules.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
BLANKS = " \t\xa0\u3000"
RULES = ("disallow", "allow", "crawl-delay", "request-rate")


def unquoted(text: Column) -> Column:
    """Percent escapes decoded; what is no escape stays."""
    return F.try_url_decode(F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def quoted(text: Column) -> Column:
    """All but letters, digits and _ . - ~ / as percent escapes of UTF-8."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def tidy(path: Column) -> Column:
    """A path without separators that nothing follows: of parameters, of the query, of the fragment."""
    path = F.regexp_replace(F.regexp_replace(path, "[\t\r\n]", ""), "^[\\x00-\\x20]+", "")
    path = F.regexp_replace(path, "#$", "")
    path = F.regexp_replace(path, "^([^?#]*)\\?(?=#|$)", "$1")
    return F.regexp_replace(path, "^((?:[^?#]*/)?[^/;?#]*);(?=[?#]|$)", "$1")


def rule_path(value: Column) -> Column:
    """A rule's path as the reader has it: an empty host before it goes."""
    path = tidy(value)
    rest = F.substr(path, F.lit(3))
    return quoted(F.when(path.rlike("^//($|[/?#])") & ~F.startswith(rest, F.lit("//")), rest).otherwise(path))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """host, number, path, allow and delay: what a host's text (host, body) says of our agent, in the order of its lines; path null: says of its pages nothing."""
    lines = robots.select("host", F.posexplode(F.split("body", LINE_END)).alias("n", "raw"))
    plain = F.btrim(F.substring_index("raw", "#", 1), F.lit(BLANKS))
    lines = lines.select("host", "n", "raw", F.lower(F.btrim(F.substring_index(plain, ":", 1), F.lit(BLANKS))).alias("word"), plain.alias("plain"))
    value = unquoted(F.btrim(F.substr("plain", F.instr("plain", ":") + 1), F.lit(BLANKS)))
    kind = F.when(F.col("raw") == "", "blank").when(F.instr("plain", ":") == 0, None).when(F.col("word") == "user-agent", "agent").when(F.col("word").isin(*RULES), "rule")
    lines = lines.select("host", "n", "word", kind.alias("kind"), value.alias("value")).filter("kind is not null")
    down = Window.partitionBy("host").orderBy("n")
    starts = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(down), F.lit("")) != "agent")
    lines = lines.withColumn("starts", starts).withColumn("group", F.sum(F.col("starts").cast("int")).over(down)).withColumn(
        "blanks", F.sum((F.col("kind") == "blank").cast("int")).over(down)
    )
    own = Window.partitionBy("host", "group")
    # a blank line ends a group; rules before any agent, or after a blank line, are nobody's
    lines = lines.withColumn("first", F.min(F.when(F.col("starts"), F.col("blanks"))).over(own)).filter("group > 0 and kind != 'blank' and blanks = first")
    name = F.lower(F.col("value"))
    is_any = F.max((F.col("kind") == "agent") & (F.col("value") == "*")).over(own)
    is_ours = F.max((F.col("kind") == "agent") & F.contains(F.lit(agent.split("/")[0].lower()), name)).over(own)
    ruled = F.max(F.col("kind") == "rule").over(own)
    lines = lines.withColumn("any", is_any).withColumn("ours", is_ours & ~is_any).withColumn("ruled", ruled).filter("ruled and (any or ours)")
    # the first group that names us, else the first for any agent
    chosen = F.min(F.struct((~F.col("ours")).alias("any"), F.col("group"))).over(Window.partitionBy("host"))
    lines = lines.withColumn("chosen", chosen).filter("group = chosen.group and kind = 'rule'")
    digits = F.when((F.col("word") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"), F.col("value"))
    lines = lines.withColumn("delay", F.max_by(digits, F.when(digits.isNotNull(), F.col("n"))).over(Window.partitionBy("host")))
    is_path = F.col("word").isin("allow", "disallow")
    return lines.select(
        "host", F.col("n").alias("number"), F.when(is_path, rule_path(F.col("value"))).alias("path"),
        ((F.col("word") == "allow") | (F.col("value") == "")).alias("allow"), "delay"
    )


def host_of(url: Column) -> Column:
    """A URL's host in lower case, also of one that is no strict URI, such as with a blank in it; null without one."""
    loose = F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit(""))
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), loose))


def asked_path(url: Column) -> Column:
    """What rules are compared with: path, parameters, query and fragment, at least a slash."""
    rest = F.regexp_replace(unquoted(url), "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*", "")
    rest = tidy(rest)
    rest = quoted(F.when(F.startswith(rest, F.lit("//")), F.concat(F.lit("//"), rest)).otherwise(rest))
    return F.when(rest == "", "/").otherwise(rest)


def first_rules(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """url and allow of the first rule that each (url, host, path) begins with, if there is one."""
    once = rules.filter("path is not null").groupBy("host", "path").agg(F.min_by("allow", "number").alias("allow"), F.min("number").alias("number"))
    lengths = once.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))  # as many as the longest rule has letters, at most
    prefixes = asked.join(lengths, "host").select(
        "url", "host", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("path")
    )
    return prefixes.join(once, ["host", "path"]).groupBy("url").agg(F.min_by("allow", "number").alias("allow"))


def permission_audit(urls: DataFrame, robots: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """url, host, status, allowed and reason of each different url.

    robots: host, status, body. 200: its rules decide; 401, 403 or no response: refused; any other status: allowed.
    """
    one = robots.groupBy(F.lower("host").alias("host")).agg(F.max_by(F.struct("status", "body"), F.struct("status", "body")).alias("r")).select("host", "r.status", "r.body")
    asked = urls.select("url").distinct().withColumn("host", host_of(F.col("url")))
    rules = robots_rules(one.filter("status = 200 and body is not null").select("host", "body"), settings.user_agent)
    delays = rules.select("host", F.col("delay").try_cast("decimal(38,0)").alias("delay")).distinct()
    found = first_rules(asked.join(one.filter("status = 200").select("host"), "host", "left_semi").withColumn("path", asked_path(F.col("url"))), rules)
    joined = asked.join(one.select("host", F.col("status").cast("int").alias("status")), "host", "left").join(delays, "host", "left").join(found, "url", "left")
    status, ruled, slow = F.col("status"), F.col("status") == 200, F.col("delay") > settings.crawl_delay
    closed = status.isNull() | status.isin(401, 403)
    refused = ruled & ~F.coalesce("allow", F.lit(True))
    reason = F.when(closed, "robots.txt could not be read; refusing").when(refused, "disallowed by robots.txt").when(
        ruled & slow, F.concat(F.lit("allowed; crawl delay of "), F.col("delay").cast("string"), F.lit(" s"))
    ).otherwise("allowed by robots.txt")
    return joined.select("url", "host", "status", (~closed & ~refused).alias("allowed"), reason.alias("reason"))


def totals(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("total"))
