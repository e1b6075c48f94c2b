"""Rules over what html.extract reads, and over headers, redirects, vitals, robots and expected entities, each where the pages have that column.

Columns: headers (map), chain (array of the URLs that a request went through, first to last) with redirect_code, lcp, cls and inp (milliseconds
and score), robots_blocked, body (text), expected (array of entity types).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import text as t
from sitequarry.functions import url as u
from sitequarry.functions.common import any_of, let
from sitequarry.operators.content import security_findings
from sitequarry.operators.rules import register
from sitequarry.operators.shared import cut

c = F.col
n = lambda name: c("counts")[name]
served = lambda: c("status") < 300
blank = lambda name: F.trim(F.coalesce(c(name), F.lit(""))) == ""


def _skips() -> Column:
    """A heading more than one level below the one before it."""
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size("levels") - 1, F.lit(1))), lambda i: (i < F.size("levels")) & (F.get("levels", i) > F.get("levels", i - 1) + 1))


def _finds(kind: str) -> Column:
    return F.exists("schema_findings", lambda x: x["kind"] == kind)


def missing_expected(types: Column, expected: Column) -> Column:
    """Expected entity types that a page hasn't; a web application is a software application."""
    known = F.when(F.array_contains(types, "WebApplication"), F.concat(types, F.array(F.lit("SoftwareApplication")))).otherwise(types)
    return F.array_except(expected, known)


def _stuffed() -> Column:
    """A phrase of one to three words makes up over 3.5 % of the words, five times at least."""
    tokens = t.keyword_tokens(c("clean"))

    def often(grams: Column) -> Column:
        """How often the most frequent one occurs: the longest run once they are sorted."""
        start = F.struct(F.lit("").alias("x"), F.lit(0).alias("run"), F.lit(0).alias("most"))

        def step(s: Column, x: Column) -> Column:
            run = F.when(s["x"] == x, s["run"] + 1).otherwise(1)
            return F.struct(x.alias("x"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

        return F.aggregate(F.array_sort(grams), start, step)["most"]

    def over(w: Column) -> Column:
        return any_of(lambda k: let(often(t.ngrams(w, k)), lambda m: (m >= 5) & (m * k / F.size(w) * 100 > 3.5)), (1, 2, 3))

    return (c("n_words") >= 150) & let(tokens, over)


def _grade(name: str, poor: float) -> Column:
    return F.when(c(name) > poor, "Warning").otherwise("Notice")


# Ids, severities, categories and thresholds of the rules.
register("title_multiple", "Several title tags", "Error", "Meta", lambda: n("title") > 1, needs="counts")
register("title_too_wide", "Title too wide", "Notice", "Meta", lambda: t.pixel_width(c("title"), 20) > 561, needs="counts")
register("title_too_narrow", "Title too narrow", "Notice", "Meta", lambda: (t.pixel_width(c("title"), 20) < 200) & (F.length("title") >= 30), needs="counts")
register("meta_desc_missing", "Description missing", "Warning", "Meta", lambda: blank("description"), needs="counts")
register("meta_desc_too_long", "Description too long", "Warning", "Meta", lambda: F.length("description") > 155, needs="counts")
register("meta_desc_too_short", "Description too short", "Notice", "Meta", lambda: ~blank("description") & (F.length("description") < 70), needs="counts")
register("meta_desc_too_wide", "Description too wide", "Warning", "Meta", lambda: t.pixel_width(c("description"), 14) > 985, needs="counts")
register("canonical_missing", "Canonical missing", "Warning", "Meta", lambda: blank("canonical"), needs="counts")
register("canonical_mismatch", "Canonical is another page", "Warning", "Meta", lambda: ~blank("canonical") & (u.normalize(u.resolve(c("url"), c("canonical"))) != u.normalize(c("url"))), needs="counts")
register("canonical_cross_domain", "Canonical on another host", "Warning", "Indexability", lambda: u.readable(c("canonical")) & (u.host(c("canonical")) != u.host(c("url"))), needs="counts")
register("og_tags_incomplete", "Open Graph incomplete", "Warning", "Meta", lambda: c("og") < 4, needs="counts")
register("twitter_card_incomplete", "Twitter card incomplete", "Notice", "Meta", lambda: n("twitter") < 1, needs="counts")
register("hreflang_missing", "No language alternatives", "Notice", "Meta", lambda: c("hreflang") == 0, needs="counts")
register("noindex_meta_tag", "Page forbids indexing", "Notice", "Indexability", lambda: c("robots").contains("noindex"), needs="counts")
register("h1_multiple", "Several H1 tags", "Warning", "Headings", lambda: n("h1") > 1, needs="counts")
register("h1_too_long", "H1 of many words", "Notice", "Headings", lambda: t.count_words(c("h1")) > 12, needs="counts")
register("h2_missing", "No H2", "Warning", "Headings", lambda: (n("h2") == 0) & (c("n_words") > 250), needs="counts")
register("heading_hierarchy_skip", "Heading level skipped", "Notice", "Headings", _skips, needs="counts")
register("generic_anchor_text", "Generic link text", "Notice", "Links", lambda: n("generic_anchor") > 0, needs="counts")
register("empty_anchor_text", "Link without text", "Warning", "Links", lambda: n("empty_anchor") > 0, needs="counts")
register("internal_nofollow", "Link with nofollow", "Warning", "Links", lambda: n("nofollow") > 0, needs="counts")
register("too_many_links", "Too many links", "Warning", "Links", lambda: n("link") > 100, needs="counts")
register("image_missing_alt", "Image missing alt text", "Warning", "Images", lambda: n("img_no_alt") > 0, needs="counts")
register("image_missing_dimensions", "Image without size", "Notice", "Images", lambda: n("img_no_size") > 0, needs="counts")
register("image_alt_too_long", "Alt text too long", "Notice", "Images", lambda: n("long_alt") > 0, needs="counts")
register("image_legacy_format", "Image in an old format", "Notice", "Images", lambda: n("legacy_img") > 0, needs="counts")
register("image_link_no_anchor", "Linked image without text", "Notice", "Images", lambda: n("link_img_no_text") > 0, needs="counts")
register("mixed_content_active", "Active mixed content (blocked)", "Error", "Technical", lambda: c("url").startswith("https://") & (n("active_http") > 0), needs="counts")
register("mixed_content_passive", "Passive mixed content", "Warning", "Technical", lambda: c("url").startswith("https://") & (n("passive_http") > 0), needs="counts")
register("insecure_form_action", "Form submits over insecure HTTP", "Error", "Technical", lambda: c("url").startswith("https://") & (n("form_http") > 0), needs="counts")
register("favicon_missing", "Favicon missing", "Notice", "Document", lambda: n("favicon") == 0, needs="counts")
register("doctype_missing", "Doctype missing", "Notice", "Document", lambda: n("doctype") == 0, needs="counts")
register("charset_missing", "Charset missing", "Warning", "Document", lambda: n("charset") == 0, needs="counts")
register("deprecated_html", "Deprecated HTML", "Notice", "Document", lambda: n("deprecated") > 0, needs="counts")
register("inline_event_handlers", "Inline event handlers", "Notice", "Document", lambda: n("inline_event") > 10, needs="counts")
register("meta_refresh", "Meta refresh", "Warning", "Document", lambda: n("refresh") > 0, needs="counts")
register("a11y_image_alt", "Image without alternative", "Error", "Accessibility", lambda: n("img_no_alt") > 0, needs="counts")
register("a11y_html_lang_missing", "No page language", "Error", "Accessibility", lambda: blank("lang"), needs="counts")
register("a11y_html_lang_invalid", "Page language invalid", "Warning", "Accessibility", lambda: ~blank("lang") & ~c("lang").rlike("^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$"), needs="counts")
register("a11y_heading_order", "Heading order", "Warning", "Accessibility", _skips, needs="counts")
register("a11y_link_name", "Link without a name", "Error", "Accessibility", lambda: n("empty_anchor") > 0, needs="counts")
register("a11y_duplicate_id", "Repeated id", "Warning", "Accessibility", lambda: c("duplicate_ids") > 0, needs="counts")
register("a11y_skip_link", "No skip link", "Notice", "Accessibility", lambda: (n("skip_link") == 0) & (n("link") > 10), needs="counts")
register("a11y_frame_title", "Frame without title", "Warning", "Accessibility", lambda: n("iframe_no_title") > 0, needs="counts")
register("mobile_viewport_missing", "Viewport missing", "Error", "Accessibility", lambda: c("viewport") == 0, needs="counts")
register("a11y_viewport_zoom", "Zoom blocked", "Error", "Accessibility", lambda: n("zoom_blocked") > 0, needs="counts")
register("a11y_tabindex_positive", "Positive tabindex", "Warning", "Accessibility", lambda: n("tabindex") > 0, needs="counts")
register("schema_missing", "No structured data", "Notice", "Schema", lambda: F.size("schema_types") == 0, needs="counts")
register("schema_google_rich_results_error", "Structured data not fit for rich results", "Notice", "Schema", lambda: _finds("rich"), needs="counts")
register("schema_org_validation_error", "Structured data against schema.org", "Notice", "Schema", lambda: _finds("schema"), needs="counts")
register("schema_malformed_jsonld", "Structured data cannot be read", "Warning", "Schema", lambda: _finds("malformed"), needs="counts")
register("schema_missing_expected", "Expected entities missing", "Notice", "Schema", lambda: F.size(missing_expected(c("schema_types"), c("expected"))) > 0, needs="expected")
register("aeo_no_definition_snippet", "No paragraph that answers", "Notice", "AEO", lambda: served() & (c("answer") == ""), needs="counts")
register("no_compression", "No compression", "Notice", "Technical", lambda: (c("html_chars") > 5120) & F.try_element_at("headers", F.lit("content-encoding")).isNull(), needs="headers")
register("compression_not_brotli", "Compression other than Brotli", "Notice", "Technical", lambda: (c("html_chars") > 100 * 1024) & (F.try_element_at("headers", F.lit("content-encoding")) == "gzip"), needs="headers")
register("no_cache_validators", "No cache validators", "Notice", "Performance", lambda: F.try_element_at("headers", F.lit("etag")).isNull() & F.try_element_at("headers", F.lit("last-modified")).isNull(), needs="headers")
register("no_cache_max_age", "No cache lifetime", "Notice", "Performance", lambda: ~F.coalesce(F.try_element_at("headers", F.lit("cache-control")), F.lit("")).contains("max-age"), needs="headers")
register("noindex_x_robots_tag", "Header forbids indexing", "Notice", "Indexability", lambda: F.coalesce(F.try_element_at("headers", F.lit("x-robots-tag")), F.lit("")).contains("noindex"), needs="headers")
register("title_outside_head", "Title outside the head", "Error", "Meta", lambda: n("title_outside") > 0, needs="counts")
register("meta_desc_multiple", "Several descriptions", "Warning", "Meta", lambda: n("description") > 1, needs="counts")
register("meta_desc_outside_head", "Description outside the head", "Error", "Meta", lambda: n("description_outside") > 0, needs="counts")
register("hreflang_invalid", "Language code invalid", "Warning", "Meta", lambda: F.exists("languages", lambda x: ~x.rlike(r"(?i)^(?:[a-z]{2,3}(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|[0-9]{3}))?|x-default)$")), needs="counts")
register("canonical_invalid_url", "Canonical is no URL", "Error", "Indexability", lambda: ~blank("canonical") & u.resolve(c("url"), c("canonical")).isNull(), needs="counts")
register("a11y_button_name", "Button without a name", "Error", "Accessibility", lambda: n("button_no_name") > 0, needs="counts")
register("a11y_input_label", "Field without a label", "Error", "Accessibility", lambda: n("input_no_label") > 0, needs="counts")
register("keyword_stuffing", "Keyword stuffing", "Warning", "Content", lambda: served() & _stuffed(), needs="clean")
register("difficult_readability", "Hard to read", "Notice", "Content", lambda: served() & (c("n_words") >= 150) & (c("ease") < 30), needs="ease")
register("soft_404", "Missing page served as found", "Error", "Status", lambda: (c("status") == 200) & (t.soft404_score(c("status"), c("url"), c("title"), c("h1"), F.lit(""), c("n_words"), c("canonical")) >= 45), needs="canonical")
register("redirect_3xx", "Redirect", "Warning", "Status", lambda: (F.size("chain") > 1) & c("status").between(1, 399), needs="chain")
register("redirect_chain_long", "Long chain of redirects", "Warning", "Status", lambda: (F.size("chain") > 2) & c("status").between(1, 399), needs="chain")
register("redirect_loop", "Redirects in a circle", "Error", "Status", lambda: (F.size("chain") > 1) & (F.get("chain", F.lit(0)) == F.get("chain", F.size("chain") - 1)), needs="chain")
register("http_to_https_redirect", "Redirect from HTTP to HTTPS", "Notice", "Status", lambda: F.get("chain", F.lit(0)).startswith("http://") & F.get("chain", F.size("chain") - 1).startswith("https://"), needs="chain")
register("cwv_lcp_poor", "Largest paint late", lambda: _grade("lcp", 4000), "Performance", lambda: c("lcp") > 2500, needs="lcp")
register("cwv_cls_poor", "Layout shifts", lambda: _grade("cls", 0.25), "Performance", lambda: c("cls") > 0.1, needs="cls")
register("cwv_inp_poor", "Slow reaction to input", lambda: _grade("inp", 500), "Performance", lambda: c("inp") > 200, needs="inp")
register("blocked_by_robots", "Blocked by robots.txt", "Notice", "Indexability", lambda: c("robots_blocked"), needs="robots_blocked")
for _id, _name, _severity in [
    ("hsts_weak", "HSTS too short", "Warning"), ("hsts_no_subdomains", "HSTS without subdomains", "Notice"), ("xcto_invalid", "Content type options invalid", "Warning"),
    ("missing_security_headers", "Security headers missing", "Notice"), ("cookie_flags_missing", "Cookie without flags", "Warning"), ("server_version_exposed", "Server version shown", "Notice"),
]:
    register(_id, _name, _severity, "Technical", lambda i=_id: F.array_contains(security_findings(c("headers"), c("url")), i), needs="headers")


# What valid codes of language alternatives are, site-wide.
CODE = "^[a-z]{2,3}(?:-[A-Za-z]{2,8})?$|^x-default$"


def hreflang_issues(alternates: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, issue_id, severity, lang, target): site-wide findings about language alternatives.

    alternates (url, lang, href, target) of crawled pages, pages (url, status, indexable).  Pages meet by their normal form, by equality.
    """
    alternates = cut(alternates)  # read three times, and dear to make: pages are parsed for it
    e = alternates.select("url", "lang", "href", "target", _key(c("url")).alias("page"), _key(c("target")).alias("to")).distinct()
    counted = alternates.groupBy("url", "lang").agg(F.count("*").alias("times"))
    known = pages.groupBy(_key(c("url")).alias("to")).agg(F.min("status").alias("status"), F.bool_and("indexable").alias("indexable"))
    whole = e.groupBy("url").agg(F.bool_or(c("to") == c("page")).alias("self"), F.bool_or(c("lang") == "x-default").alias("default")).join(counted.groupBy("url").agg(F.max("times").alias("times")), "url")
    page = F.array_compact(F.array(F.when(~c("self"), _found("hreflang_missing_self", "Warning")), F.when(~c("default"), _found("hreflang_missing_x_default", "Notice")), F.when(c("times") > 1, _found("hreflang_duplicate_lang", "Warning"))))
    back = e.select(c("page").alias("to"), c("to").alias("page")).distinct().withColumn("returned", F.lit(True))
    link = e.join(known, "to", "left").join(back, ["page", "to"], "left")
    crawled = c("status").isNotNull()
    tests = [
        ("hreflang_invalid_code", "Warning", ~c("lang").rlike(CODE)), ("hreflang_relative_url", "Warning", ~c("href").rlike("(?i)^https?://")), ("hreflang_unlinked_target", "Warning", ~crawled),
        ("hreflang_missing_return", "Error", crawled & c("returned").isNull()), ("hreflang_target_non_200", "Error", crawled & (c("status") != 200)), ("hreflang_target_noindex", "Error", crawled & (c("status") == 200) & ~c("indexable")),
    ]
    each = F.array_compact(F.array(*[F.when(test, _found(i, severity)) for i, severity, test in tests]))
    none = F.lit(None).cast("string")
    return whole.select("url", F.explode(page).alias("i"), none.alias("lang"), none.alias("target")).unionByName(link.select("url", F.explode(each).alias("i"), "lang", "target")).select("url", "i.issue_id", "i.severity", "lang", "target")


def _key(url: Column) -> Column:
    return let(url, u.normalize_hreflang)


def _found(issue: str, severity: str) -> Column:
    return F.struct(F.lit(issue).alias("issue_id"), F.lit(severity).alias("severity"))
