"""The article of a web page: blocks by their tags, weighed by text and links, and the run of blocks that weighs most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x

#: Parts of a page that are never its text; tags that end a block.
SKIPPED = ("script", "style", "head", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg", "button")
BLOCKS = ("p", "div", "li", "ul", "ol", "td", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "blockquote", "pre", "figcaption", "figure", "dd", "dt", "body", "br")
#: Characters that a block must have beyond those of its links to be worth more than nothing.
COST = 40
_CUT = "\ue000"


def blocks(html: Column) -> Column:
    """Blocks in order as (text, weight): a block weighs its characters outside links less those inside and less COST; blocks without text are out."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in SKIPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", _CUT)
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?/?>", _CUT)

    def block(part: Column) -> Column:
        plain = lambda t: F.trim(F.regexp_replace(x.unescape(F.regexp_replace(t, "<[^>]*>", "")), r"\s+", " "))
        text, alone = plain(part), plain(F.regexp_replace(part, r"(?is)<a(?:\s[^>]*)?>.*?</a\s*>", ""))
        return F.struct(text.alias("text"), (2 * F.length(alone) - F.length(text) - COST).alias("weight"))

    return F.filter(F.transform(F.split(out, _CUT), block), lambda b: b.text != "")


def best_run(weighed: Column) -> Column:
    """The blocks of the run with the largest sum of weights: of equal ones the one that ends first, and then the longest; none if no block weighs anything."""
    none = lambda: F.struct(F.lit(0).alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("i"), F.lit(0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(a: Column, b: Column) -> Column:
        i = a.i + 1
        start = F.when(a.sum >= 0, a.start).otherwise(a.i)
        total = F.when(a.sum >= 0, a.sum).otherwise(0) + b.weight
        better = total > a.best
        return F.struct(total.alias("sum"), start.alias("start"), i.alias("i"), F.when(better, total).otherwise(a.best).alias("best"), F.when(better, start).otherwise(a["first"]).alias("first"), F.when(better, i).otherwise(a["last"]).alias("last"))

    return x.let(weighed, lambda w: x.let(F.aggregate(w, none(), step), lambda a: F.slice(w, a["first"] + 1, a["last"] - a["first"])))


def page_body(html: Column) -> Column:
    """The text of the article: the blocks of the best run that weigh something or stand between such, a line each."""
    return F.array_join(F.transform(best_run(blocks(html)), lambda b: b.text), "\n")


def page_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, n_blocks, body) of pages(page_id, html)."""
    rows = pages.select("page_id", blocks(F.col("html")).alias("blocks"))
    run = rows.select("page_id", F.size("blocks").alias("n_blocks"), best_run(F.col("blocks")).alias("run"))
    return run.select("page_id", "n_blocks", F.size("run").alias("n_run"), F.array_join(F.transform("run", lambda b: b.text), "\n").alias("body"))
