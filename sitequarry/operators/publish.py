"""Publishing: profiles, the catalogue of sites, outlines of what to write there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import url as u
from sitequarry.functions.common import any_of

PROFILE = "website string, business string, audience string, topics array<string>, markets array<string>, assets array<string>, pages array<struct<url:string,topic:string,status:string>>, posts_per_week int, start_date string"


def problems(profile: Column) -> Column:
    """What is wrong with a posting profile (a struct as PROFILE has it), as an array of names; empty if nothing is."""
    p = lambda name: profile[name]
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    tests = [
        ("website", blank(p("website")) | ~u.is_valid_http(p("website"))),
        ("business", blank(p("business"))),
        ("audience", blank(p("audience"))),
        ("topics", (F.coalesce(F.size(p("topics")), F.lit(0)) <= 0) | F.exists(F.coalesce(p("topics"), F.array().cast("array<string>")), blank)),
        ("markets", F.exists(F.coalesce(p("markets"), F.array().cast("array<string>")), lambda x: x.isNull())),
        ("assets", F.exists(F.coalesce(p("assets"), F.array().cast("array<string>")), lambda x: x.isNull())),
        ("pages", F.coalesce(F.size(p("pages")), F.lit(0)) <= 0),
        ("page topics", F.exists(p("pages"), lambda x: blank(x["topic"]))),
        ("page addresses", F.exists(p("pages"), lambda x: ~u.is_valid_http(x["url"]))),
        ("page status", F.exists(p("pages"), lambda x: ~F.coalesce(x["status"], F.lit("provided")).isin("existing", "planned", "provided"))),
        ("posts_per_week", ~F.coalesce(p("posts_per_week"), F.lit(2)).between(1, 7)),
        ("start_date", p("start_date").isNotNull() & ~p("start_date").rlike(r"^\d{4}-\d{2}-\d{2}$")),
    ]
    return F.when(profile.isNull(), F.array(F.lit("profile"))).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests])))


def catalogue(sites: DataFrame, name: str = "", topic: str = "", kind: str = "", status: str = "") -> DataFrame:
    """sites (id, name, topics, kind, status) whose name or id has a text, a topic has another, of a kind and a status; empty filters pass all."""
    low = lambda c: F.lower(c)
    if name:
        sites = sites.where(any_of(lambda c: F.contains(low(F.col(c).cast("string")), F.lit(name.lower())), ["name", "id"]))
    if topic:
        sites = sites.where(F.exists("topics", lambda t: F.contains(low(t), F.lit(topic.lower()))))
    if kind:
        sites = sites.where(F.col("kind") == kind)
    return sites.where(F.col("status") == status) if status else sites


#: What to write for each kind of site: {topic} and {audience} are filled in.
OUTLINES = {
    ("answer",): ["Answer a question about {topic} that was asked there.", "Show {audience} how to decide, by an example.", "Say only what can be checked.", "Name your part in it; link where rules and answer call for it."],
    ("community", "professional_community", "community_submission"): ["Find the discussion where {topic} belongs, and read its rules.", "Tell in a few lines what was learnt or made.", "Say only what can be checked.", "Name your part in it, ask one question, and stay for the replies."],
    ("curation",): ["Collect what is worth reading about {topic} for {audience}.", "Put the work of others beside your own.", "Say what each item is good for, with its source.", "Keep the list short and current."],
    ("code_resource", "owned_resource"): ["Publish the resource about {topic} first.", "Say what it is for, what it needs, and how to run an example.", "Say only what can be checked.", "Tell its limits and who keeps it up."],
    ("social_article",): ["Show one part of {topic} by a picture of your own.", "Add a short text that {audience} can follow.", "Say only what can be checked.", "Name sources, and offer further reading where that is allowed."],
}
OTHERWISE = ["Answer the main question about {topic}.", "Tell {audience} what to decide by.", "Say only what can be checked.", "Say where another way is better.", "Offer the resource where the site allows it."]


def outline(kind: Column, topic: Column, audience: Column) -> Column:
    """What to write for a site of that kind, as an array of sentences."""
    filled = lambda lines: F.array(*[F.replace(F.replace(F.lit(x), F.lit("{topic}"), topic), F.lit("{audience}"), audience) for x in lines])
    out = filled(OTHERWISE)
    for kinds, lines in OUTLINES.items():
        out = F.when(kind.isin(*kinds), filled(lines)).otherwise(out)
    return out


def role(kind: Column) -> Column:
    """What a placement there can show: editorial, moderated or own."""
    return F.when(kind == "editorial_article", "editorial").when(kind.isin("article_directory", "community", "answer", "professional_community", "community_submission"), "moderated").otherwise("own")
