"""Text measures and classifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequarry.functions.common import any_of, bounded, half_up, half_up_int, let

# Words that say nothing about a page's subject.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could couldn't did didn't do does "
    "doesn't doing don't down during each few for from further get had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i "
    "i'd i'll i'm i've if in into is isn't it it's its itself just let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same "
    "shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those "
    "through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's will with won't would "
    "wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()
# Words that say nothing about an intent.
TARGET_STOP_WORDS = (
    "about after again against all and any are because been before being between both but can could did does doing down during each few for from further had has have having here how into itself "
    "just more most must not off once only other our ours out over own same should some such than that the their theirs them then there these they this those through too under until very was were "
    "what when where which while who whom why with would your home page contact privacy terms policy login signup"
).split()
INTENT_STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not of off on once only or other "
    "ought our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up "
    "very was we were what when where which while who whom why with would you your yours yourself"
).split()
# What hints at an intent.
INFORMATIONAL = ["how", "what", "why", "who", "when", "where", "guide", "tutorial", "tips", "steps", "ideas", "learn", "example", "definition", "overview", "explained", "meaning", "difference between", "diy", "history"]
COMMERCIAL = ["best", "top", "review", "reviews", "vs", "versus", "comparison", "alternative", "alternatives", "pros and cons", "worth it", "benchmark", "cheapest", "ratings", "ranking"]
TRANSACTIONAL = ["buy", "order", "price", "pricing", "cost", "discount", "coupon", "cheap", "hire", "service", "services", "download", "purchase", "quote", "estimate", "deal", "shop", "sale", "subscription"]
NAVIGATIONAL = ["login", "signin", "sign in", "log in", "portal", "account", "dashboard", "official", "app", "website", "support", "contact us"]
# Anchors that name nothing.
GENERIC_ANCHORS = [
    "click here", "read more", "learn more", "visit here", "visit website", "link", "here", "source", "website", "more", "this page", "continue reading", "check it out", "view more",
    "details", "download here", "go here", "find out more",
]
# Signs of a page that is missing although it was served.
TITLE_404 = [r"^\s*404\b", r"\b404\b\s*[-:|–—]?\s*(error|not found|page)", r"\b(error|page)\s*[-:]?\s*404\b", r"\bpage not found\b", r"\bnot found\b", r"\barticle not found\b", r"\bproduct not found\b", r"\bitem unavailable\b", r"\boops!?\s*page", r"\bdoesn['’]t exist\b", r"\bpage has been removed\b"]
H1_404 = [r"^\s*404\b", r"\b404\b\s*[-:|–—]?\s*(error|not found|page)", r"\b(error|page)\s*[-:]?\s*404\b", r"\bnot found\b", r"\bpage cannot be found\b", r"\blooking for doesn['’]t exist\b", r"\bwe couldn['’]t find\b", r"\bpage missing\b"]
# What the body, the address and the canonical of such a page hold.
THIN_404 = ["not found", "removed", "error", "expired"]
SEARCHES = ["search", "query", "q="]
NO_RESULTS = ["0 results", "no results found", "did not match any"]
CANONICAL_404 = ["/404", "/not-found", "/error"]
# The least reading ease of each level, and its name.
READING_LEVELS = [
    (90, "5th grade (Very Easy)"), (80, "6th grade (Easy)"), (70, "7th grade (Fairly Easy)"), (60, "8th & 9th grade (Plain English - Recommended)"), (50, "10th to 12th grade (Fairly Difficult)"),
    (30, "College level (Difficult)"),
]
HARDEST_LEVEL = "College Graduate (Very Confusing)"
# Endings that are no syllable.
SILENT = "(?:[^laeiouy]|ed|es|e)$"
# Longer keywords made of a short one.
VARIATIONS = {
    "question": ["How to use %s effectively", "What is %s and how does it work", "Why is %s important for SEO", "When should you implement %s", "Is %s worth the investment"],
    "commercial": ["Best %s tools and software", "%s vs alternatives comparison", "Top rated %s platforms", "Free vs paid %s options"],
    "long_tail": ["%s complete guide for beginners", "%s best practices and checklist", "Automated %s workflow", "%s step by step tutorial"],
}


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def normalise_duplicate(text: Column) -> Column:
    """Lower case, all but letters, digits and white space to blanks, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(normalise_duplicate(text), 256)


def shingles(word_list: Column, size: int = 5) -> Column:
    """Distinct runs of `size` words; a list of no more words makes one."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        return F.array_distinct(F.when(n <= size, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))))

    return let(word_list, runs)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    cut = F.regexp_replace(w, SILENT, "")
    base = F.when(cut == "", w).otherwise(cut)
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(base, F.lit("[aeiouy]+"))))


def readability(text: Column) -> dict[str, Column]:
    """Flesch reading ease, Flesch-Kincaid grade and what they are made of; an empty text has zeros."""
    t = F.trim(text)
    empty = t == ""
    n_sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(t, "[.!?]+"), lambda s: F.regexp_replace(s, r"\s+", "") != "")))
    kept = F.filter(F.transform(F.split(t, r"\s+"), lambda w: F.regexp_replace(w, "[^a-zA-Z0-9'-]", "")), lambda w: w != "")
    n_words = F.greatest(F.lit(1), F.size(kept))
    n_syllables = F.aggregate(kept, F.lit(0), lambda s, w: s + syllables(w))
    return {"n_words": F.when(empty, 0).otherwise(n_words).cast("long"), "n_sentences": F.when(empty, 0).otherwise(n_sentences).cast("long"), "n_syllables": F.when(empty, 0).otherwise(n_syllables).cast("long")}


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return F.when(n_words == 0, 0.0).otherwise(half_up(bounded(206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words), 0.0, 100.0), 1))


def grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return F.when(n_words == 0, 0.0).otherwise(half_up(F.greatest(F.lit(0.0), 0.39 * (n_words / n_sentences) + 11.8 * (n_syllables / n_words) - 15.59), 1))


def reading_level(ease: Column, n_words: Column) -> Column:
    out = F.lit(HARDEST_LEVEL)
    for least, name in reversed(READING_LEVELS):
        out = F.when(ease >= least, name).otherwise(out)
    return F.when(n_words == 0, "No content").otherwise(out)


def keyword_tokens(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text), r"[^\w\s-]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens that are not all stop words and, if n > 1, neither begin nor end with one."""

    def found(ts: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ts) - n + 1, F.lit(1))), lambda i: F.slice(ts, i, n))
        runs = F.filter(runs, lambda r: (F.size(r) == n) & ~F.element_at(r, 1).isin(STOP_WORDS) & ~F.element_at(r, -1).isin(STOP_WORDS))
        return F.transform(runs, lambda r: F.array_join(r, " "))

    return let(tokens, found)


def intent_scores(query: Column) -> dict[str, Column]:
    q = F.lower(F.trim(query))

    def hits(triggers: list[str], worth: int) -> Column:
        out = F.lit(0)
        for t in triggers:
            out = out + F.when(F.contains(q, F.lit(t)), worth).otherwise(0)
        return out

    info, comm, trans, nav = hits(INFORMATIONAL, 30), hits(COMMERCIAL, 35), hits(TRANSACTIONAL, 35), hits(NAVIGATIONAL, 40)
    long_ = F.size(F.split(q, r"\s+")) >= 5
    none = (info == 0) & (comm == 0) & (trans == 0) & (nav == 0)
    info = F.when(none, 40).when(long_ & (info > 0), info + 25).otherwise(info)
    return {"informational": info, "commercial": comm, "transactional": trans, "navigational": nav}


def intent(query: Column) -> Column:
    """struct(primary, secondary, confidence); ties in the order informational, commercial, transactional, navigational."""
    ranked = F.array_sort(F.array(*[F.struct((-score).alias("minus"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, score) in enumerate(intent_scores(query).items())]))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    has_second = -second["minus"] > 20
    total = -first["minus"] + F.when(has_second, -second["minus"]).otherwise(0)
    confidence = F.least(F.lit(98), half_up_int(-first["minus"] / F.greatest(total, F.lit(1)) * 100))
    return F.struct(first["name"].alias("primary"), F.when(has_second, second["name"]).alias("secondary"), confidence.alias("confidence"))


def difficulty(keyword: Column, primary: Column) -> Column:
    """Keyword difficulty, 5 to 98, from the number of words and the intent."""
    n = F.size(words(F.lower(F.trim(keyword))))
    base = F.when(n == 1, 85).when(n == 2, 65).when(n == 3, 42).when(n >= 4, 22).otherwise(50)
    more = F.when(primary == "transactional", 14).when(primary == "commercial", 8).when((primary == "informational") & (n >= 4), -10).otherwise(0)
    return F.greatest(F.lit(5), F.least(F.lit(98), base + more)).cast("long")


def difficulty_tier(score: Column) -> Column:
    return F.when(score <= 20, "Very Easy").when(score <= 40, "Easy").when(score <= 60, "Medium").when(score <= 80, "Hard").otherwise("Super Hard")


def referring_domains(score: Column) -> Column:
    rate = F.when(score <= 15, 0.0).when(score <= 30, 0.2).when(score <= 50, 0.5).when(score <= 75, 1.2).otherwise(2.5)
    return half_up_int(score * rate)


def variations(seed: Column) -> Column:
    """array of struct(kind, keyword)."""
    clean = F.regexp_replace(F.trim(seed), r"^[#0-9.:\s]+", "")
    return F.array(*[F.struct(F.lit(kind).alias("kind"), F.format_string(t, clean).alias("keyword")) for kind, ts in VARIATIONS.items() for t in ts])


def target_keywords(explicit: Column, h1: Column, title: Column, phrases: Column) -> Column:
    """What a page seems to be written for, without repeats: a keyword that is given, a short H1, the head of a short title, and its first three phrases.

    But for the given one, a word of `TARGET_STOP_WORDS` alone is none.
    """
    plain = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9\s]", " "), r"\s+", " ")))
    n = lambda x: F.size(F.split(x, " "))
    given = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    head = plain(F.regexp_replace(F.coalesce(h1, F.lit("")), r"^[#0-9.:\s]+", ""))
    chunk = plain(F.get(F.split(F.coalesce(title, F.lit("")), r"[|\-–:]"), F.lit(0)))
    usual = lambda x: ~x.isin(TARGET_STOP_WORDS)
    found = F.concat(
        F.when(F.length(given) >= 3, F.array(given)).otherwise(F.array()),
        F.when((F.length(head) >= 4) & (n(head) <= 5) & usual(head), F.array(head)).otherwise(F.array()),
        F.when((F.length(chunk) >= 4) & (n(chunk) <= 4) & usual(chunk), F.array(chunk)).otherwise(F.array()),
        F.transform(F.filter(F.slice(F.coalesce(phrases, F.array().cast("array<string>")), 1, 3), lambda x: (F.length(x) >= 4) & usual(x)), lambda x: F.lower(x)),
    )
    return F.array_distinct(found)


def anchor_class(anchor: Column, brand: str = "", keywords: list[str] = ()) -> Column:
    a = F.lower(F.trim(anchor))
    partial = [w for k in keywords for w in k.lower().split() if len(w) >= 4]
    out = F.lit("branded")
    out = F.when(any_of(lambda w: F.contains(a, F.lit(w)), partial), "partial_match").otherwise(out)
    out = F.when(any_of(lambda k: a == k.lower(), keywords), "exact_match").otherwise(out)
    if brand.strip():
        out = F.when(F.contains(a, F.lit(brand.strip().lower())), "branded").otherwise(out)
    out = F.when(a.isin(GENERIC_ANCHORS) | a.rlike(r"^click\s*here|^read\s*more|^learn\s*more"), "generic").otherwise(out)
    out = F.when(a.rlike(r"^(https?://|www\.|/)"), "naked_url").otherwise(out)
    return F.when(a.isin("", "(empty)", "[image]"), "empty_image").otherwise(out)


def soft404_score(status: Column, url: Column, title: Column, h1: Column, body: Column, n_words: Column, canonical: Column) -> Column:
    """0 to 100; 45 and more is a soft 404.  Only pages served with 200 score."""
    t, h, b, c = (F.coalesce(x, F.lit("")) for x in (F.trim(title), F.trim(h1), F.lower(body), F.lower(canonical)))
    thin = (n_words < 60) & any_of(lambda w: F.contains(b, F.lit(w)), THIN_404)
    empty_search = any_of(lambda w: F.contains(url, F.lit(w)), SEARCHES) & any_of(lambda w: F.contains(b, F.lit(w)), NO_RESULTS)
    score = (
        F.when(any_of(lambda p: t.rlike(f"(?i){p}"), TITLE_404), 45).otherwise(0)
        + F.when(any_of(lambda p: h.rlike(f"(?i){p}"), H1_404), 40).otherwise(0)
        + F.when(any_of(lambda w: F.contains(c, F.lit(w)), CANONICAL_404), 50).otherwise(0)
        + F.when(thin, 30).when((n_words < 20) & (n_words < 60) & (t == "") & (h == ""), 25).otherwise(0)
        + F.when(empty_search, 35).otherwise(0)
    )
    guarded = F.when((n_words >= 300) & ~thin & ~empty_search, score * 0.5).otherwise(score.cast("double"))
    return F.when(status == 200, F.least(F.lit(100.0), guarded)).otherwise(0.0)


def intent_tokens(title: Column, h1: Column, url: Column) -> Column:
    """Distinct words of title, heading and last path piece that say what a page is about."""
    joined = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(h1, F.lit("")), F.coalesce(F.substring_index(url, "/", -1), F.lit("")))
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(joined), r"[^a-z0-9\s-]", " "), "[-_]", " ")
    return F.array_distinct(F.filter(F.split(cleaned, r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(INTENT_STOP_WORDS)))


def pixel_width(text: Column, font_px: int) -> Column:
    """Approximate width: units per sign times the font size."""
    # Widths of signs in units of the font size.
    narrow, wide = "ijlI.,:;!|' \"", "mwMW@#%&"
    cjk = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
    unit = lambda c: F.when(c.rlike(r"[\x{0900}-\x{097F}]"), 0.62).when(c.rlike(cjk), 1.0).when(c.isin(*narrow), 0.32).when(c.isin(*wide), 0.85).otherwise(0.55)
    return half_up_int(F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0.0), lambda s, c: s + unit(c)) * font_px)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the code units of texts within the basic plane."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def equity_retention(hops: Column, loop: Column) -> Column:
    """Share of link equity that a redirect chain leaves, in percent."""
    return F.when(loop, 0).otherwise(half_up_int(95 * F.pow(F.lit(0.85), hops - 1)))


def priority(severity: Column, pages: Column) -> Column:
    return F.when(severity == "Error", F.when(pages >= 10, "Critical").otherwise("High")).when(severity == "Warning", F.when(pages >= 10, "High").otherwise("Medium")).otherwise("Low")


def severity_weight(severity: Column) -> Column:
    return F.when(severity == "Error", 3).when(severity == "Warning", 2).otherwise(1)


def worst_severity(severity: Column) -> Column:
    """The worst severity of a group."""
    return F.max_by(severity, severity_weight(severity))


def priority_rank(value: Column) -> Column:
    return F.when(value == "Critical", 4).when(value == "High", 3).when(value == "Medium", 2).otherwise(1)


def visibility(position: Column) -> Column:
    return F.when(position <= 3, 1.0).when(position <= 5, 0.95).when(position <= 10, 0.85).when(position <= 20, 0.25).otherwise(0.05)


def monthly_from_console(impressions: Column, position: Column, days: Column) -> Column:
    """Monthly searches from impressions; null beyond position 10 or without days."""
    return F.when((position > 10) | (days <= 0), None).otherwise(impressions / visibility(position) * 30 / days)
