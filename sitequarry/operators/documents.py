"""What is written for people and programs: recommendations, reports, tables, structured data, patches, notices."""

from __future__ import annotations

import html as markup
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions import text as t
from sitequarry.functions import url as u
from sitequarry.operators.store import recommendations as ranked

#: Per finding its effort (S, M or L), why it matters, and what to do.
LIBRARY = {
    "broken_link_404": ("M", "Readers and crawlers that follow a link to this page reach nothing.", ["List the links that lead here.", "Restore the page, or redirect it to the nearest one that lives.", "Point the links at the final address."]),
    "broken_internal_link": ("M", "A link of the site leads nowhere.", ["Check the status of the target.", "Restore it or redirect it.", "Rewrite the link."]),
    "broken_external_link": ("S", "A link to another site is dead.", ["Check the target.", "Link to a page that lives, or take the link out."]),
    "server_error_5xx": ("L", "The server fails, so the page cannot be read at all.", ["Read the server's log at the time of the crawl.", "Mend the cause and fetch the page again."]),
    "orphan_page": ("S", "No page links here, so it is found by the sitemap at best.", ["Link to it from a page on the same subject.", "Add it to a list or the navigation."]),
    "redirect_3xx": ("S", "Each redirect costs a request.", ["Find the final address.", "Point links and sitemap at it, and keep the redirect."]),
    "redirect_chain_long": ("M", "Several redirects in a row cost time, and crawlers may give up.", ["Trace the chain.", "Send the first address to the last."]),
    "redirect_loop": ("M", "The page cannot be reached.", ["Find the rules that send the request back.", "Point one of them at the final address.", "Empty the caches."]),
    "soft_404": ("M", "A missing page that says it was found stays in indexes.", ["Answer with 404 or 410.", "Or give the page content of its own."]),
    "title_missing": ("S", "The title is the headline in results.", ["Write a title of its own, 15 to 60 characters.", "Begin with what the page is about."]),
    "title_too_long": ("S", "Results cut long titles.", ["Shorten it to 60 characters."]),
    "title_too_short": ("S", "A short title says little.", ["Say what the page is about, in 30 characters or more."]),
    "meta_desc_missing": ("S", "Results show a text of their own choice.", ["Write a summary of 70 to 155 characters."]),
    "canonical_missing": ("S", "Variants of the address may count as copies.", ["Add a canonical link to the head."]),
    "canonical_mismatch": ("S", "The page names another as the original.", ["Check which is meant.", "Correct the link, or redirect."]),
    "og_tags_incomplete": ("S", "Previews stay empty.", ["Add title, description, address and image."]),
    "h1_missing": ("S", "The page has no headline.", ["Add one H1 that says what it is about."]),
    "h1_multiple": ("S", "Several headlines compete.", ["Keep one, make the others H2."]),
    "low_word_count": ("L", "There is little to read.", ["Find out what readers come for.", "Write it, with examples."]),
    "thin_content": ("L", "There is little to read.", ["Extend the page or join it with another."]),
    "image_missing_alt": ("S", "Who cannot see the image learns nothing of it.", ["Describe it in a few words; leave the text empty for ornaments."]),
    "image_missing_dimensions": ("S", "The page moves while it loads.", ["Give width and height."]),
    "slow_ttfb": ("M", "The first byte comes late, and all else after it.", ["Cache pages near the readers.", "Find the slow queries."]),
    "high_latency": ("M", "The page is slow.", ["Cache it, and send less."]),
    "schema_missing": ("M", "Programs have to guess what the page is.", ["Choose the type.", "Describe it in JSON-LD."]),
    "schema_malformed_jsonld": ("S", "Structured data cannot be read.", ["Mend the syntax."]),
    "low_aeo_score": ("M", "Answer engines find no answer to quote.", ["Answer below the headline in 25 to 75 words.", "Add a table and questions."]),
    "hreflang_missing_return": ("M", "Alternatives count only if both pages name each other.", ["Add the link back."]),
    "insecure_http_page": ("M", "The page is sent in the clear.", ["Serve it over HTTPS and redirect."]),
    "missing_security_headers": ("S", "Browsers protect readers only if they are told to.", ["Send the headers that are missing."]),
}
#: For findings that the library doesn't know, by severity.
GENERAL = {"Error": "It keeps readers or crawlers out.", "Warning": "It weakens the page.", "Notice": "It could be better."}
PLAN = ["Look at the pages below.", "Mend the cause once, where they share it."]


def library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, effort, why, steps) for i, (effort, why, steps) in LIBRARY.items()], "issue_id string, effort string, why string, steps array<string>")


def advised(found: DataFrame) -> DataFrame:
    """found (issue_id, severity, ...) with effort, why and steps of the library, or general ones."""
    out = found.join(F.broadcast(library(found.sparkSession)), "issue_id", "left")
    general = F.when(F.col("severity") == "Error", GENERAL["Error"]).when(F.col("severity") == "Warning", GENERAL["Warning"]).otherwise(GENERAL["Notice"])
    plan = F.array(*[F.lit(x) for x in PLAN])
    return out.withColumns({"effort": F.coalesce("effort", F.lit("M")), "why": F.coalesce("why", general), "steps": F.coalesce("steps", plan)})


def fix_docs(issues: DataFrame, most_urls: int = 20) -> DataFrame:
    """(issue_id, name, severity, priority, affected_pages, effort, doc): a Markdown text for each finding, with at most most_urls of its pages.

    Only so many URLs of a finding are gathered: the first in order, by a window that keeps no more.
    """
    from pyspark.sql import Window as W

    pages = issues.select("issue_id", "url").distinct()
    place = F.row_number().over(W.partitionBy("issue_id").orderBy("url"))
    shown = pages.withColumn("place", place).where(F.col("place") <= most_urls).groupBy("issue_id").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    g = ranked(issues).join(issues.groupBy("issue_id").agg(F.min("name").alias("name"), t.worst_severity(F.col("severity")).alias("severity")), "issue_id").join(shown, "issue_id")
    g = advised(g)
    n = F.col("affected_pages")
    steps = F.array_join(F.transform("steps", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    urls = F.array_join(F.transform("urls", lambda x: F.concat(F.lit("- "), x)), "\n")
    more = F.when(n > most_urls, F.concat(F.lit("\nand "), (n - most_urls).cast("string"), F.lit(" more"))).otherwise("")
    doc = F.concat(F.lit("## "), "name", F.lit("\n\n"), "why", F.lit("\n\n### What to do\n"), steps, F.lit("\n\n### Pages ("), n.cast("string"), F.lit(")\n"), urls, more)
    return g.select("issue_id", "name", "severity", "priority", "affected_pages", "effort", doc.alias("doc"))


def md_cell(value: Column) -> Column:
    """A text as a cell of a Markdown table."""
    return F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\R\s*", " ")


def html_escape(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _bounded(df: DataFrame, most: int) -> list:
    """The first rows of df, which a report shows; never more than `most` reach the driver."""
    return df.limit(most).collect()


def _cell(value) -> str:
    return "" if value is None else re.sub(r"\s+", " ", str(value)).replace("|", "\\|")


def markdown_table(df: DataFrame, most: int = 200) -> str:
    rows = _bounded(df, most)
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(map(_cell, r)) + " |" for r in rows])


def markdown_report(title: str, facts: dict, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report of facts and tables: of crawls, diffs, gaps, robots, forecasts, comparisons, plans, sources, discoveries, catalogues."""
    out = [f"# {title}", "", *[f"- **{k}**: {v}" for k, v in facts.items()]]
    for name, df in sections.items():
        table = markdown_table(df, most)
        out += ["", f"## {name}", "", table if table.count("\n") > 1 else "Nothing found."]
    return "\n".join(out) + "\n"


def html_report(title: str, facts: dict, sections: dict[str, DataFrame], most: int = 200) -> str:
    """The same as one HTML page without scripts; every text is escaped."""
    e = lambda x: markup.escape("" if x is None else str(x))
    out = [f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1><dl>']
    out += [f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in facts.items()]
    out.append("</dl>")
    for name, df in sections.items():
        out.append(f"<h2>{e(name)}</h2><table><tr>" + "".join(f"<th>{e(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in _bounded(df, most)]
        out.append("</table>")
    return "".join(out) + "</body></html>"


def terminal_report(title: str, facts: dict, sections: dict[str, DataFrame], most: int = 20, width: int = 100) -> str:
    """The same for a terminal: columns side by side, lines cut to its width."""
    out = [title, "=" * len(title), *[f"{k}: {v}" for k, v in facts.items()]]
    for name, df in sections.items():
        rows = [[re.sub(r"\s+", " ", "" if v is None else str(v)) for v in r] for r in _bounded(df, most)]
        sizes = [max(map(len, [c, *[r[i] for r in rows]])) for i, c in enumerate(df.columns)]
        line = lambda cells, sizes=sizes: "  ".join(x.ljust(n) for x, n in zip(cells, sizes, strict=True)).rstrip()[:width]
        out += ["", name, "-" * len(name), line(df.columns), *[line(r) for r in rows]]
    return "\n".join(out) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text as one file in any file system that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def json_ld(kind: str, fields: dict[str, Column]) -> Column:
    """JSON-LD of a schema.org type; null fields are left out."""
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[v.alias(k) for k, v in fields.items()]))


def article(headline: Column, author: Column, published: Column, url: Column, description: Column | None = None) -> Column:
    fields = {"headline": F.substring(headline, 1, 110), "author": F.struct(F.lit("Person").alias("@type"), author.alias("name")), "datePublished": published, "mainEntityOfPage": url}
    return json_ld("Article", fields | ({"description": description} if description is not None else {}))


def faq(questions: Column) -> Column:
    """Of an array of (question, answer)."""
    one = lambda q: F.struct(F.lit("Question").alias("@type"), q["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), q["answer"].alias("text")).alias("acceptedAnswer"))
    return json_ld("FAQPage", {"mainEntity": F.transform(questions, one)})


def local_business(name: Column, street: Column, city: Column, country: Column, phone: Column, url: Column) -> Column:
    address = F.struct(F.lit("PostalAddress").alias("@type"), street.alias("streetAddress"), city.alias("addressLocality"), country.alias("addressCountry"))
    return json_ld("LocalBusiness", {"name": name, "address": address, "telephone": phone, "url": url})


def script_tag(data: Column) -> Column:
    """JSON-LD within a script element; what could end the element is escaped."""
    return F.concat(F.lit('<script type="application/ld+json">'), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))


def snippet(topic: Column, keyword: Column, category: Column, details: Column) -> dict[str, Column]:
    """A paragraph that answers, its number of words and whether that is 40 to 55, a table, and questions as JSON-LD."""
    topic, keyword = F.trim(topic), F.trim(keyword)
    category = F.lower(F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("source")))
    details = F.coalesce(F.nullif(F.trim(details), F.lit("")), F.lit("checked records"))
    paragraph = F.concat(topic, F.lit(" is a "), category, F.lit(' for readers who look for "'), keyword, F.lit('". It rests on '), details, F.lit(", names where each figure comes from, says when it was last checked, and shows the steps between the record and what is stated, so that every answer here can be followed back to its source by anyone who asks."))
    table = F.concat(F.lit("| Field | Value |\n| --- | --- |\n| Topic | "), md_cell(topic), F.lit(" |\n| Query | "), md_cell(keyword), F.lit(" |\n| Basis | "), md_cell(details), F.lit(" |"))
    asked = F.array(F.struct(F.concat(F.lit("What is "), topic, F.lit("?")).alias("question"), paragraph.alias("answer")), F.struct(F.concat(F.lit("What does it say about "), keyword, F.lit("?")).alias("question"), F.concat(topic, F.lit(" draws on "), details, F.lit(".")).alias("answer")))
    n = t.count_words(paragraph)
    return {"paragraph": paragraph, "n_words": n, "well_sized": n.between(40, 55), "table": table, "ld": faq(asked)}


def framework(source: str, path: str = "") -> str:
    if path.endswith(".astro") or source.startswith("---"):
        return "astro"
    if re.search(r"\.(?:tsx?|jsx?)$", path) or "export const metadata" in source or "generateMetadata" in source or re.search(r"from ['\"]next", source):
        return "next"
    return "html" if path.endswith(".html") or re.search(r"<!doctype html|<head\b", source, re.I) else "unknown"


def patched(source: str, fix: dict, path: str = "") -> tuple[str, str, list[str]]:
    """(framework, new source, what was done): title, description, canonical, data (JSON-LD) and alt (texts by src) put where they belong."""
    kind, done, out = framework(source, path), [], source
    if kind == "next":
        keys = {k: v for k, v in (("title", fix.get("title")), ("description", fix.get("description"))) if v}
        lines = {k: f"  {k}: {json.dumps(v, ensure_ascii=False)}," for k, v in keys.items()}
        if fix.get("canonical"):
            lines["alternates"] = f"  alternates: {{ canonical: {json.dumps(fix['canonical'])} }},"
        block = re.search(r"export\s+const\s+metadata(?:\s*:\s*\w+)?\s*=\s*\{", out)
        if block:
            inside = out[block.end() : out.find("};", block.end())]
            new = [(k, x) for k, x in lines.items() if not re.search(rf"\b{k}\s*:", inside)]
            out = out[: block.end()] + "".join("\n" + x for _, x in new) + out[block.end() :]
            done += [k for k, _ in new]
        elif lines:
            out = "export const metadata = {\n" + "\n".join(lines.values()) + "\n};\n\n" + out
            done += list(lines)
    elif kind in ("html", "astro"):
        e = lambda x: markup.escape(x, quote=True)
        parts = {
            "title": (r"<title\b[^>]*>.*?</title>", lambda v: f"<title>{e(v)}</title>"),
            "description": (r"<meta\s[^>]*name=[\"']description[\"'][^>]*>", lambda v: f'<meta name="description" content="{e(v)}">'),
            "canonical": (r"<link\s[^>]*rel=[\"']canonical[\"'][^>]*>", lambda v: f'<link rel="canonical" href="{e(v)}">'),
            "data": (r"(?!)", lambda v: '<script type="application/ld+json">' + json.dumps(v).replace("</", "<\\/") + "</script>"),
        }
        for name, (pattern, written) in parts.items():
            if not fix.get(name):
                continue
            text = written(fix[name])
            out, n = re.subn(pattern, lambda _, text=text: text, out, count=1, flags=re.I | re.S)
            if not n:
                out, n = re.subn(r"<head\b[^>]*>", lambda m, text=text: m[0] + "\n  " + text, out, count=1, flags=re.I)
            if n:
                done.append(name)
    for src, alt in (fix.get("alt") or {}).items():
        image = re.search(rf"<(?:img|Image)\s[^>]*src=[\"']{re.escape(src)}[\"'][^>]*>", out)
        if image and not re.search(r"\balt=", image[0]):
            out = out[: image.start()] + re.sub(r"^<(img|Image)", lambda m, alt=alt: f'<{m[1]} alt="{markup.escape(alt)}"', image[0]) + out[image.end() :]
            done.append(f"alt of {src}")
    return kind, out, done


def patches(files: DataFrame) -> DataFrame:
    """(path, framework, source, done) of files (path, source, title, description, canonical): each patched; nulls patch nothing."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = []
                for path, source, *fix in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    rows.append((path, *patched(source or "", dict(zip(("title", "description", "canonical"), fix, strict=True)), path or "")))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], ["path", "framework", "source", "done"])

    return files.select("path", "source", "title", "description", "canonical").mapInArrow(run, "path string, framework string, source string, done array<string>")


def index_notices(urls: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """(host, part, n, body): what is sent to tell search engines of new URLs, by host, at most so many to a message."""
    from pyspark.sql import Window as W

    e = urls.select(u.hostname(F.col("url")).alias("host"), "url").where("host <> ''").distinct()
    # Dealt by a hash first, so that a host with very many URLs is numbered in slices, not in one task.
    sizes = e.groupBy("host").agg(F.ceil(F.count("*") / most).alias("slices"))
    e = e.join(sizes, "host").withColumn("slice", F.pmod(F.xxhash64("url"), F.col("slices"))).drop("slices")
    e = e.withColumn("part", F.floor((F.row_number().over(W.partitionBy("host", "slice").orderBy("url")) - 1) / most))
    g = e.groupBy("host", "slice", "part").agg(F.array_sort(F.collect_list("url")).alias("list"))
    body = F.to_json(F.struct("host", F.lit(key).alias("key"), F.concat(F.lit("https://"), "host", F.lit(f"/{key}.txt")).alias("keyLocation"), F.col("list").alias("urlList")))
    return g.select("host", "slice", "part", F.size("list").cast("long").alias("n"), body.alias("body"))


def stream_lines(events: DataFrame, kind: str) -> DataFrame:
    """Events as lines of a server-sent stream: the name of the column `kind`, then the row as JSON."""
    return events.select(F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("line"))


def sheet_line(df: DataFrame) -> Column:
    """A row of df for a spreadsheet as one text: CRLF between the lines of a list, quotes where needed, formulas disarmed."""

    def cell(name: str, kind: str) -> Column:
        c = F.array_join(F.col(name), "\r\n") if kind.startswith("array") else F.coalesce(F.col(name).cast("string"), F.lit(""))
        c = F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.concat_ws(",", *[cell(n, k) for n, k in df.dtypes])


def save_document(rows: DataFrame, key: str, columns: list[str], folder: str) -> None:
    """Rows as (key, columns, body): the columns that are asked for, and the whole row as JSON.  Saving a key again replaces it."""
    body = F.to_json(F.struct(*rows.columns))
    rows.select(*columns, body.alias("body"), key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)
