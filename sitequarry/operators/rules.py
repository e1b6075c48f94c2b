"""Page rules: each names a finding and says, as a Column, which pages have it.

A rule is a row of the registry; an audit makes one row for each page and rule that holds, in one projection
and one explode, so any number of rules costs one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import text as t
from sitequarry.functions import url as u


@dataclass(frozen=True)
class Rule:
    """severity is a name, or gives a Column where it depends on the page; needs names the column that a page must have for the rule to be asked."""

    id: str
    name: str
    severity: str | Callable[[], Column]
    category: str
    test: Callable[[], Column]
    needs: str = ""


REGISTRY: dict[str, Rule] = {}


def register(id_: str, name: str, severity: str | Callable[[], Column], category: str, test: Callable[[], Column], needs: str = "") -> None:
    """Adds a rule, or replaces that of the same id."""
    REGISTRY[id_] = Rule(id_, name, severity, category, test, needs)


def listed() -> list[str]:
    return sorted(REGISTRY)


c = F.col
SERVED = lambda: c("status") < 300
# Rule ids, names, severities, categories and thresholds.
register("broken_link_404", "Page not found (404)", "Error", "Status", lambda: c("status") == 404)
register("client_error_4xx", "Client error (4xx)", "Error", "Status", lambda: (c("status") >= 400) & (c("status") < 500) & (c("status") != 404))
register("page_unreachable", "Page unreachable", "Error", "Status", lambda: c("status") == 0)
register("server_error_5xx", "Server error (5xx)", "Error", "Status", lambda: c("status") >= 500)
register("redirect_301_permanent", "Permanent redirect", "Notice", "Status", lambda: c("status").isin(301, 308))
register("redirect_302_temporary", "Temporary redirect", "Warning", "Status", lambda: c("status").isin(302, 303, 307))
register("insecure_http_page", "Page served over HTTP", "Warning", "Security", lambda: c("url").startswith("http://"))
register("title_missing", "Title tag missing or empty", "Error", "Meta", lambda: F.trim("title") == "")
register("title_too_long", "Title too long", "Warning", "Meta", lambda: F.length("title") > 60)
register("title_too_short", "Title too short", "Notice", "Meta", lambda: (F.trim("title") != "") & (F.length("title") < 30))
register("title_same_as_h1", "Title same as H1", "Notice", "Meta", lambda: (F.trim("title") != "") & (F.lower(F.trim("title")) == F.lower(F.trim("h1"))))
register("h1_missing", "H1 tag missing or empty", "Error", "Headings", lambda: F.trim("h1") == "")
register("h1_too_long_chars", "H1 too long", "Notice", "Headings", lambda: F.length("h1") > 70)
register("low_word_count", "Low word count", lambda: F.when(c("n_words") < 100, "Warning").otherwise("Notice"), "Content", lambda: SERVED() & (c("n_words") < 250))
register("slow_ttfb", "Slow first byte", "Warning", "Performance", lambda: c("ttfb_ms") > 800)
register("high_latency", "High latency", "Warning", "Performance", lambda: c("response_ms") > 2000)
register("page_too_large", "Page too large", "Warning", "Performance", lambda: c("html_chars") > 2 * 1024 * 1024)
register("html_lang_missing", "Language missing", "Warning", "Document", lambda: c("lang") == "")
register("url_over_length", "URL too long", "Warning", "URL", lambda: F.length("url") > u.MAX_LENGTH)
register("url_non_ascii", "URL with non-ASCII characters", "Warning", "URL", lambda: c("url").rlike(r"[^\x00-\x7F]"))
register("url_has_parameters", "URL with parameters", "Notice", "URL", lambda: c("url").rlike(r"\?[^#]"))
register("url_session_id", "URL with session or advertising id", "Warning", "URL", lambda: c("url").rlike(u.SESSION) | c("url").rlike(u.AD_CLICK))
register("url_uppercase", "Uppercase in path", "Notice", "URL", lambda: u.path(c("url")).rlike("[A-Z]"))
register("url_underscores", "Underscore in path", "Notice", "URL", lambda: u.path(c("url")).contains("_"))
register("url_duplicate_path", "Repeated path segment", "Warning", "URL", lambda: u.hygiene(c("url"))["duplicate_path"])
register("url_double_slash", "Double slash in path", "Notice", "URL", lambda: u.hygiene(c("url"))["double_slash"])
register("low_aeo_score", "Low answer-engine score", "Warning", "AEO", lambda: c("aeo") < 70)


def issues(pages: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(page_id, url, issue_id, name, severity, category), a row for each page and rule that holds, of the rules whose columns the pages have.  A test that is null doesn't hold."""
    from sitequarry.operators import audit  # noqa: F401  its rules register themselves

    chosen = [r for r in (REGISTRY[x] for x in (rules or REGISTRY)) if not r.needs or r.needs in pages.columns]
    row = lambda r: F.struct(F.lit(r.id).alias("issue_id"), F.lit(r.name).alias("name"), (F.lit(r.severity) if isinstance(r.severity, str) else r.severity()).alias("severity"), F.lit(r.category).alias("category"))
    found = F.array_compact(F.array(*[F.when(r.test(), row(r)) for r in chosen]))
    return pages.select("page_id", "url", F.explode(found).alias("i")).select("page_id", "url", "i.*")


def summary(found: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Per issue name the pages affected, the change against previous (name, pages), and the issues that are gone; ranked by severity and pages."""
    now = found.groupBy("name").agg(F.min("issue_id").alias("issue_id"), t.worst_severity(F.col("severity")).alias("severity"), F.min("category").alias("category"), F.count_distinct("url").alias("affected_pages"))
    if previous is not None:
        before = previous.select("name", F.col("pages").alias("before"))
        now = now.join(before, "name", "full_outer").withColumns({"affected_pages": F.coalesce("affected_pages", F.lit(0)), "change": F.coalesce("affected_pages", F.lit(0)) - F.coalesce("before", F.lit(0))})
    return now.withColumn("weight", t.severity_weight(F.col("severity")))
