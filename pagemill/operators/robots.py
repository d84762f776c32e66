"""Robots files as a rule table, and the gate that applies it to URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import host_of, path_of, percent_decoded, strip
from pagemill.session import cut

AGENT = "user-agent"
RULES = ("allow", "disallow")
# Fields that, like a rule, end the list of agents a group is for.
OTHER_FIELDS = ("crawl-delay", "request-rate")


def robots_lines(files: DataFrame) -> DataFrame:
    """(host, line_no, field, value) of the lines that mean something; field '' ends a group."""
    lines = files.select(
        "host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "line")
    )
    bare = strip(F.regexp_replace("line", "#.*$", ""))
    field = F.lower(strip(F.substring_index(bare, ":", 1)))
    value = percent_decoded(strip(F.regexp_replace(bare, "^[^:]*:", "")))
    read = lines.select(
        "host",
        "line_no",
        F.when(F.col("line") == "", F.lit(""))
        .when(F.contains(bare, F.lit(":")), field)
        .alias("field"),
        value.alias("value"),
    )
    return read.filter(F.col("field").isin("", AGENT, *RULES, *OTHER_FIELDS))


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, group_id, agent, rule_no, allow, prefix) of every group that has a rule.

    Consecutive agent lines share a group. An empty line ends the group; rules without agents
    are ignored. Windows run over the lines of one host's file, that is, of one input row.
    """
    by_line = Window.partitionBy("host").orderBy("line_no")
    until_now = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_agent = F.col("field") == AGENT
    lines = (
        robots_lines(files)
        .withColumn("is_agent", is_agent)
        .withColumn("opens", F.col("is_agent") & ~F.lag("is_agent", 1, False).over(by_line))
        .withColumn("group_id", F.sum(F.col("opens").cast("int")).over(until_now))
        .withColumn(
            "closed_at", F.max(F.when(F.col("field") == "", F.col("line_no"))).over(until_now)
        )
        .withColumn("opened_at", F.max(F.when(F.col("is_agent"), F.col("line_no"))).over(until_now))
    )
    in_group = F.col("opened_at").isNotNull() & (
        F.col("closed_at").isNull() | (F.col("closed_at") < F.col("opened_at"))
    )
    # Still partitioned by host, so the agents of a group need no further shuffle.
    agent = F.when(F.col("is_agent"), F.col("value"))
    members = lines.filter(in_group).withColumn(
        "agents", F.collect_set(agent).over(Window.partitionBy("host", "group_id"))
    )
    is_rule = F.col("field").isin(*RULES)
    return members.filter(~F.col("is_agent")).select(
        "host",
        "group_id",
        F.explode("agents").alias("agent"),
        F.col("line_no").alias("rule_no"),
        # An empty prefix after `Disallow` allows everything.
        F.when(is_rule, (F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        F.when(is_rule, F.col("value")).alias("prefix"),
    )


def default_rules(files: DataFrame) -> DataFrame:
    """(host, verdict, rules): what applies to every agent on a host.

    `verdict` is true or false where the file's status decides alone: 401, 403 and files that
    could not be loaded deny everything, other 4xx allow everything. Else the ordered rules of
    the first group for agent `*` apply. One row per host, with the rules of one file; the table
    is written, as it is looked up by many rows of few hosts (see `session.look_up`).
    """
    status = F.col("status")
    verdict = (
        F.when(status.isin(401, 403), F.lit(False))
        .when(status.between(400, 499), F.lit(True))
        .when(status.isNull() | (status >= 500), F.lit(False))
    )
    hosts = files.select("host", verdict.alias("verdict"))
    star = robots_rules(files.filter(status.between(200, 399))).filter(F.col("agent") == "*")
    rule = F.struct("group_id", "rule_no", "allow", "prefix")
    per_host = star.groupBy("host").agg(F.array_sort(F.collect_set(rule)).alias("rules"))
    return cut(hosts.join(per_host, "host", "left"))


def robots_allowed(
    df: DataFrame, rules: DataFrame, default: bool = True, url: str = "url", out: str = "allowed"
) -> DataFrame:
    """Add whether the host's rules allow the URL: the first rule that is a prefix decides.

    An equi-join on the host with one row per host on the rule side; AQE splits the rows of a
    host that holds a large share. A host without a row gets `default`.
    """
    table = rules.select(F.col("host").alias("_host"), "verdict", "rules", F.lit(True).alias("_has"))
    # The path is worked out once per row, ahead of the join, not once per rule.
    joined = (
        df.withColumn("_own", host_of(url))
        .withColumn("_path", path_of(url))
        .join(table, F.col("_own") == F.col("_host"), "left")
    )

    def applies(rule: Column) -> Column:
        first_group = rule["group_id"] == F.col("rules")[0]["group_id"]
        fits = F.startswith(F.col("_path"), rule["prefix"])
        return first_group & rule["allow"].isNotNull() & fits

    ruled = F.get(F.filter("rules", applies), F.lit(0))["allow"]
    answer = F.coalesce(
        F.col("verdict"), ruled, F.when(F.col("_has"), F.lit(True)), F.lit(default)
    )
    return joined.withColumn(out, answer).drop("_own", "_path", "_host", "verdict", "rules", "_has")
