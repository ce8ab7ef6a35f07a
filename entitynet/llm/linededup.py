"""Boilerplate lines by their frequency within a site.

For each host, the share of its pages that contain a line decides: a line on more than
``ratio`` of the host's pages is dropped wherever the host shows it; a line on a single
page is not repeated (``least`` is two). Pages of a host with equal text count as one page, so that copies of a page
do not turn its text into boilerplate; near-duplicate removal deals with them.

Lines are compared trimmed of spaces, tabs and line ends, by a 64-bit hash within their
host. A host has at most (lines per page / ratio) such lines, which bounds the row that
carries them. Texts are never grouped; a hot host or line is counted in parts first.

Defined cases: blank lines are neither counted nor dropped; a null text stays null and
counts as no page; a null host is a host of its own; repeated rows count once and are all
cleaned; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitynet.session import cut

RATIO, LEAST = 0.1, 2
#: For documents: of a source, with a bound that is higher for small sources.
DOCS_RATIO = 0.01
BLANK = " \t\r\f"

# What stands outside the text of an HTML page, and the tags that end a line.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKING = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def html_lines(html: Column) -> Column:
    """The visible lines of a page, joined by line ends."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BREAKING, "\n"), "<[^>]*>", "")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != ""), "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST, smooth: bool = False) -> DataFrame:
    """(_host, _bad): the hashes of the lines that each host of (_host, _text) repeats.

    ``smooth`` adds the binary logarithm of the host's pages to the number that must be exceeded.
    """
    lines = F.transform(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    each = pages.where("_text is not null").select("_host", F.xxhash64("_text").alias("page"), F.array_distinct(F.transform(
        F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))).alias("lines"))
    totals = each.select("_host", "page").distinct().groupBy("_host").agg(F.count("*").alias("pages"))
    counts = each.select("_host", "page", F.explode("lines").alias("line")).distinct().groupBy("_host", "line").agg(F.count("*").alias("on"))
    many = cut(counts.where(F.col("on") >= least))
    return many.join(totals.withColumnRenamed("_host", "_of"), F.col("_host").eqNullSafe(F.col("_of"))).where(
        F.col("on") > F.col("pages") * ratio + (F.log2("pages") if smooth else F.lit(0.0))).groupBy("_host").agg(F.collect_list("line").alias("_bad"))


def clean(pages: DataFrame, host_of: Column, text: Column, ratio: float = RATIO, least: int = LEAST, smooth: bool = False) -> DataFrame:
    """The columns of ``pages`` with _host, _text (what is left), _lines and _dropped (numbers of lines that are not blank)."""
    marked = pages.withColumns({"_host": host_of, "_text": text})
    bad = cut(boilerplate(marked.select("_host", "_text"), ratio, least, smooth)).withColumnRenamed("_host", "_of")
    trimmed = lambda x: F.btrim(x, F.lit(BLANK))
    lines, filled = F.split("_text", "\n"), lambda c: F.size(F.filter(c, lambda x: trimmed(x) != ""))
    joined = marked.join(bad, F.col("_host").eqNullSafe(F.col("_of")), "left")
    kept = F.when(F.col("_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: (trimmed(x) == "") | ~F.array_contains("_bad", F.xxhash64(trimmed(x)))))
    return joined.withColumn("_kept", kept).withColumns({
        "_lines": F.coalesce(filled(lines), F.lit(0)), "_dropped": F.coalesce(filled(lines) - filled(F.col("_kept")), F.lit(0)),
        "_text": F.array_join("_kept", "\n")}).drop("_kept", "_bad", "_of")


def site_lines(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, n_lines, n_dropped and kept_sha256 of the HTML pages."""
    read = cut(pages.select("page_id", host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")))
    return clean(read, F.col("host"), F.col("lines"), ratio, least).select(
        "page_id", "host", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"),
        F.sha2("_text", 256).alias("kept_sha256"))


def clean_documents(docs: DataFrame, ratio: float = DOCS_RATIO, least: int = LEAST) -> DataFrame:
    """The documents, source by source, without boilerplate lines; those of which nothing is left go.

    A line goes if it stands on more than ``ratio`` of the source's n documents and log2(n) more: on
    2 of 2 or 3, on 3 of 4, 4 of 10, 14 of 500. Two near copies in a small source keep their text.
    """
    # Inside, columns have names that no result of ``clean`` has.
    inner = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    text = F.col(inner["text"])
    done = clean(docs.toDF(*inner.values()), F.col(inner["source"]), text, ratio, least, smooth=True).where(
        (F.col("_dropped") == 0) | (F.col("_dropped") < F.col("_lines")))
    text = F.when(F.col("_dropped") > 0, F.col("_text")).otherwise(text)
    new = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
    return done.select(*[new.get(c, F.col(name)).alias(c) for c, name in inner.items()])
