"""Site-relative line frequency: lines that stand on more than a given share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded
from .neardup import NearDup

RATIO_PERCENT, MIN_PAGES = 30, 5
#: In documents: a line of so many words that is in so many texts is a repeated passage, whatever their sources.
LONG_WORDS, LONG_TEXTS = 50, 10


def host_of(url: str) -> Column:
    """The host of a URL, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def lines_of_html(html: str) -> Column:
    """The text lines of a page: blocks end lines, scripts, styles, comments and other tags go."""
    x = F.coalesce(F.col(html), F.lit(""))
    for pattern, to in (("(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " "),
                        ("(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|blockquote|pre)(?:[ /][^>]*)?>", "\n"),
                        ("<[^>]*>", "")):
        x = F.regexp_replace(x, pattern, to)
    return tidy(x)


def tidy(text: Column) -> Column:
    """Non-empty lines without surrounding spaces."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def drop_boilerplate(spark: SparkSession, pages: DataFrame, host: str, lines: str, percent: int = RATIO_PERCENT,
                     min_pages: int = MIN_PAGES, group: str | None = None, long_words: int | None = None,
                     long_texts: int = LONG_TEXTS, scratch: Scratch | None = None) -> DataFrame:
    """pages without the lines that stand on over percent % of the host's pages, for hosts of min_pages or more.

    `lines` is an array column; it comes back filtered, with `host_pages` and `n_dropped` added (columns of these names
    are replaced). A line counts once a page, compared exactly up to 128-bit hashes; a null host is the empty host, null
    lines are none. Repeated pages count each time, or with `group` all rows alike in that column count as one page: then
    a group of near copies doesn't make its lines boilerplate. Blank lines are never counted or dropped. With long_words,
    (which needs `group`) a line of so many words goes also if it is on long_texts pages or more of any hosts.
    The first shuffle sends counts summed in each task, so a host with a third of all pages, or a line on all of
    them, is no burden. Lists of lines to drop are broadcast only if counted to be few.
    """
    scratch = scratch or Scratch(spark, "lines")
    rest = [n for n in pages.columns if n not in (host, lines, "host_pages", "n_dropped")]
    p = pages.select(
        F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("_host"), F.coalesce(F.col(f"`{lines}`"), F.array().cast("array<string>")).alias("_lines"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{n}`") for n in rest]).alias("_row"))
    blank = lambda s: F.coalesce(F.trim(s) == "", F.lit(True))
    long = F.size(F.split(F.trim(F.col("l")), r"[\x20\x09-\x0D]+")) >= long_words if long_words else F.lit(False)
    said = F.array_distinct(F.filter("_lines", lambda s: ~blank(s)))
    page = [F.col(f"_row.`{group}`").alias("_page")] if group else []
    each = p.select("_host", *page, F.explode(said).alias("l")).select("_host", *(["_page"] if group else []), _key(F.col("l")).alias("k"), long.alias("long"))
    hosts = p.select("_host", *page)
    if group:
        each, hosts = scratch.save(each.distinct()), hosts.distinct()
    totals = scratch.save(hosts.groupBy("_host").agg(F.count("*").alias("host_pages")))
    n_hosts = totals.count()
    least = min_pages * percent // 100 + 1  # of a line that is dropped at any host
    counts = each.groupBy("_host", "k").agg(F.count("*").alias("n")).where(f"n >= {least}")
    bad = counts.join(bounded(totals.where(f"host_pages >= {min_pages}"), n_hosts), "_host").where(f"n * 100 > host_pages * {percent}")
    bad = scratch.save(bad.groupBy("_host").agg(F.collect_list("k").alias("_bad")))
    n_bad = bad.select(F.coalesce(F.sum(F.size("_bad")), F.lit(0))).first()[0]
    out = p.join(bounded(totals, n_hosts), "_host", "left").join(bounded(bad, n_bad), "_host", "left")
    if long_words:
        found = each.where("long").select("_page", "k").distinct()
        often = scratch.save(found.groupBy("k").agg(F.count("*").alias("n")).where(f"n >= {long_texts}").select("k"))
        on = scratch.save(found.join(bounded(often), "k").groupBy("_page").agg(F.collect_list("k").alias("_passages")))
        scratch.drop(often)
        out = out.withColumn("_page", F.col(f"_row.`{group}`")).join(bounded(on, limit=20_000), "_page", "left")
    else:
        out = out.withColumn("_passages", F.lit(None).cast(out.schema["_bad"].dataType))
    if group:
        scratch.drop(each)
    drop = lambda s: ~blank(s) & (F.coalesce(F.array_contains(F.col("_bad"), _key(s)), F.lit(False)) | F.coalesce(F.array_contains(F.col("_passages"), _key(s)), F.lit(False)))
    clean = F.col("_bad").isNull() & F.col("_passages").isNull()
    kept = F.when(clean, F.col("_lines")).otherwise(F.filter("_lines", lambda s: ~drop(s)))
    out = out.withColumn("_kept", kept)
    return out.select(*[F.col(f"_row.`{n}`") for n in rest], F.col("_host").alias(host), F.col("_kept").alias(lines), "host_pages", (F.size("_lines") - F.size("_kept")).alias("n_dropped"))


#: Runs on DuckDB; the same patterns in its dialect.
ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')) AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'),
        '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|blockquote|pre)(?:[ /][^>]*)?>', chr(10), 'g'),
        '<[^>]*>', '', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS lines FROM pages),
totals AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
seen AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p),
bad AS (
  SELECT s.host, s.line FROM seen s JOIN totals t ON s.host = t.host WHERE t.host_pages >= {MIN_PAGES}
  GROUP BY s.host, s.line, t.host_pages HAVING count(*) * 100 > t.host_pages * {RATIO_PERCENT}),
lists AS (SELECT host, list(line) AS bad FROM bad GROUP BY host),
cut AS (
  SELECT p.page_id, p.host, t.host_pages, p.lines,
    list_filter(p.lines, lambda s: NOT list_contains(coalesce(l.bad, []), s)) AS kept
  FROM p JOIN totals t ON p.host = t.host LEFT JOIN lists l ON p.host = l.host)
SELECT page_id, host, host_pages, len(lines)::INTEGER AS n_lines, (len(lines) - len(kept))::INTEGER AS n_dropped, array_to_string(kept, chr(10)) AS text FROM cut
"""


def pages_without_boilerplate(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, host, host_pages, n_lines, n_dropped and the remaining text of each page.

    A null page has no lines, a null or odd URL the empty host; null and repeated page_ids are pages like others.
    Without pages there are no rows. Other columns are left out. Pages' lines are taken out of the HTML once.
    """
    scratch = Scratch(spark, "lines")
    p = scratch.save(pages.select("page_id", host_of("url").alias("host"), lines_of_html("html").alias("lines")))
    out = drop_boilerplate(spark, p, "host", "lines", scratch=scratch)
    return out.select("page_id", "host", "host_pages", (F.size("lines") + F.col("n_dropped")).alias("n_lines"), "n_dropped", F.array_join("lines", "\n").alias("text"))


def documents_without_boilerplate(spark: SparkSession, docs: DataFrame, percent: int, min_pages: int, words: int = 5, similar: int = 80) -> DataFrame:
    """documents with such lines cut from the texts, the source taken for the host; all other columns and rows stay.

    Near copies (by shingles of `words` words and a similarity of `similar` %) count as one text. Long lines that are in
    LONG_TEXTS texts go whatever the sources. Lines that stay keep their spaces, and blank lines stay; a null text
    stays null. n_chars, if there, follows the new text.
    """
    scratch, names = Scratch(spark, "lines"), docs.columns
    d = NearDup(spark, words, similar).tagged(docs, scratch, rows=True)
    d = scratch.save(d.select("row", F.coalesce("lead.rid", "rid").alias("page")))
    scratch.drop_from(0, d)
    d = d.select("row", "page", F.coalesce("row.source", F.lit("")).alias("host"), F.split("row.text", "\n").alias("lines"))
    out = drop_boilerplate(spark, d, "host", "lines", percent, min_pages, group="page", long_words=LONG_WORDS, scratch=scratch)
    text = F.when(F.col("row.text").isNotNull(), F.when(F.col("n_dropped") > 0, F.array_join("lines", "\n")).otherwise(F.col("row.text")))
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new.get(n, F.col(f"row.`{n}`")).alias(n) for n in names])
