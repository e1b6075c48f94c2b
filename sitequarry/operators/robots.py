"""robots.txt: groups, rules and verdicts by longest match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.common import let
from sitequarry.operators.shared import small_enough

# Crawlers of answer engines, by what they fetch for.
AI_ROLES = {
    "ai-search": "OAI-SearchBot PerplexityBot Claude-SearchBot DuckAssistBot Amazonbot YouBot".split(),
    "ai-training": "GPTBot ClaudeBot CCBot Bytespider".split(),
    "user-fetcher": "ChatGPT-User Claude-User Perplexity-User MistralAI-User".split(),
    "robots-token": "Google-Extended Applebot-Extended".split(),
}
AI_BOTS = [b for bots in AI_ROLES.values() for b in bots]


def rules(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, agent, allow, pattern, line, regex): a row for each rule and each agent of its group.

    A group is a run of user-agent lines and the rules up to the next such run; an empty rule allows all and counts as none.
    * stands for anything, a final $ for the end.
    """
    line = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", "")))
    field = F.lower(F.trim(F.substring_index("raw", ":", 1)))
    value = F.trim(F.regexp_extract("raw", "^[^:]*:(.*)$", 1))
    each = line.where(F.col("raw").contains(":")).select(key, "line", field.alias("f"), value.alias("v")).where(F.col("f").isin("user-agent", "allow", "disallow"))
    # Lines of one file in order: short, so they are numbered within one row and no window is needed.
    packed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "f", "v"))).alias("ls"))

    def grouped(ls):
        def step(s, x):
            fresh = (x["f"] == "user-agent") & (s["last"] != "user-agent")
            agents = F.when(fresh, F.array(F.lower(x["v"]))).when(x["f"] == "user-agent", F.concat(s["agents"], F.array(F.lower(x["v"])))).otherwise(s["agents"])
            made = F.when((x["f"] != "user-agent") & (x["v"] != ""), F.array(F.struct(s["agents"].alias("agents"), (x["f"] == "allow").alias("allow"), x["v"].alias("pattern"), x["line"].alias("line")))).otherwise(F.array().cast("array<struct<agents:array<string>,allow:boolean,pattern:string,line:int>>"))
            return F.struct(agents.alias("agents"), x["f"].alias("last"), F.concat(s["rules"], made).alias("rules"))

        start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit("").alias("last"), F.array().cast("array<struct<agents:array<string>,allow:boolean,pattern:string,line:int>>").alias("rules"))
        return F.aggregate(ls, start, step)["rules"]

    out = packed.select(key, F.explode(let(F.col("ls"), grouped)).alias("r")).select(key, F.explode("r.agents").alias("agent"), "r.allow", "r.pattern", "r.line")
    body = F.regexp_replace("pattern", r"\$$", "")
    quoted = F.regexp_replace(F.regexp_replace(body, r"([.+?^(){}\[\]|\\$])", r"\\$1"), r"\*", ".*")
    return out.withColumn("regex", F.concat(F.lit("^"), quoted, F.when(F.col("pattern").endswith("$"), "$").otherwise("")))


def verdicts(found: DataFrame, key: str, paths: DataFrame, agent: str) -> DataFrame:
    """(key, path, allowed, pattern): the longest matching rule of the agent's group (that of * if it has none) decides; allow wins ties."""
    own = found.where(F.col("agent") == agent.lower()).select(key).distinct()
    used = found.where(F.col("agent") == agent.lower()).unionByName(found.where("agent = '*'").join(own, key, "left_anti"))
    hit = paths.join(F.broadcast(used) if small_enough(used, 100_000) else used, key).where(F.expr("path rlike regex"))
    best = hit.groupBy(key, "path").agg(F.max_by(F.struct("allow", "pattern"), F.struct(F.length("pattern").alias("n"), "allow", (-F.col("line")).alias("l"))).alias("r"))
    return paths.join(best, [key, "path"], "left").select(key, "path", F.coalesce("r.allow", F.lit(True)).alias("allowed"), F.coalesce("r.pattern", F.lit("")).alias("pattern"))


def posture(found: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """(key, bot, role, blocked, issue_id): whether a file's rules shut each AI crawler out of the whole site.

    A bot's own group decides if it says anything of the root, else that of *.  A group shuts out by `/` or `/*` disallowed, unless it allows `/`;
    issue_id names the finding for search crawlers and fetchers that are shut out.
    """
    root = found.where(F.col("pattern").isin("/", "/*")).groupBy(key, "agent").agg(F.bool_or(F.col("allow") & (F.col("pattern") == "/")).alias("open"), F.bool_or(~F.col("allow")).alias("shut"))
    bots = F.array(*[F.struct(F.lit(b).alias("bot"), F.lit(r).alias("role")) for r, bs in AI_ROLES.items() for b in bs])
    each = files.select(key, F.explode(bots).alias("b")).select(key, "b.bot", "b.role", F.lower("b.bot").alias("agent"))
    own = each.join(root, [key, "agent"], "left").join(root.where("agent = '*'").select(key, F.col("open").alias("all_open"), F.col("shut").alias("all_shut")), key, "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    shut = (no(F.col("shut")) & ~no(F.col("open"))) | (~no(F.col("open")) & no(F.col("all_shut")) & ~no(F.col("all_open")))
    issue = F.when(shut & (F.col("role") == "ai-search"), "ai_search_bot_blocked").when(shut & (F.col("role") == "user-fetcher"), "ai_fetcher_blocked")
    return own.select(key, "bot", "role", shut.alias("blocked"), issue.alias("issue_id"))
