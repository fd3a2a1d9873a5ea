"""Images of pages: extraction, validity with reasons, keys, watermarks, relevance and placement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules import formats
from ..rules import news as rules


@dataclass(frozen=True)
class ImageRules:
    words: tuple[str, ...] = rules.IMAGE_WORDS
    width: int = 150
    height: int = 100
    query_size: bool = False
    variables: bool = False
    need_extension: bool = False


QA = ImageRules()
ASSEMBLER = ImageRules(query_size=True, variables=True)
SCRAPER = ImageRules(width=100, need_extension=True)


def image_url(url: Column, base: Column) -> Column:
    """Absolute form of a source: `//host`, `/path` and relative ones take what they lack from base."""
    scheme, host = F.regexp_extract(base, r"^(https?:)", 1), F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/")
    return F.when(url.rlike("^https?:"), url).when(url.startswith("//"), F.concat(scheme, url)).when(url.startswith("/"), F.concat(host, url)).when(url.startswith("data:"), None).otherwise(F.concat(folder, url))


def image_key(url: Column) -> Column:
    """Lower-cased path without host and query; the whole url if there is no path."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.lower(F.when((path == "") | (path == "/"), url).otherwise(path))


def verdict(url: Column, r: ImageRules = QA) -> Column:
    """`valid`, or the first reason against an image."""
    low = F.lower(url)
    word = F.regexp_extract(low, "(" + "|".join(sorted((w.replace(".", r"\.") for w in r.words), key=len, reverse=True)) + ")", 1)
    w, h = (F.regexp_extract(low, r"[_-](\d+)x(\d+)", k).try_cast("int") for k in (1, 2))
    out = F.when(url.isNull() | (url == ""), "empty_url").when(~url.startswith("http"), "invalid_protocol").when(url.contains("{{") | url.contains("}}"), "placeholder")
    if r.variables:
        out = out.when(url.rlike(r"\{%|\$\{|%%|\{[a-zA-Z_]+\}"), "placeholder")
    out = out.when(word != "", F.concat(F.lit("pattern:"), word)).when((w < r.width) | (h < r.height), F.concat(F.lit("too_small:"), w.cast("string"), F.lit("x"), h.cast("string")))
    if r.query_size:
        qw, qh = (F.regexp_extract(low, rf"[?&]{c}=(\d+)", 1).try_cast("int") for c in "wh")
        out = out.when(qw.isNotNull() & qh.isNotNull() & ((qw < r.width) | (qh < r.height)), "too_small")
    if r.need_extension:
        out = out.when(~low.rlike(r"\.(jpg|jpeg|png|webp)|image|img|photo"), "no_image_name")
    return out.otherwise("valid")


def fits_page(url: Column) -> Column:
    """Whether an address may be an image of an article by the rules of the web page: no excluded word, ending or size, and an ending or host of images."""
    low = F.lower(url)
    path = F.substring_index(low, "?", 1)
    w, h = (F.regexp_extract(low, r"[_-](\d+)x(\d+)", k).try_cast("int") for k in (1, 2))
    out = ~url.startswith("http") | url.contains("{{") | url.contains("}}") | path.rlike(r"\.(svg|ico|cur|gif)$") | x.contains_any(low, formats.WEB_IMAGE_WORDS) | F.coalesce((w < 150) | (h < 100), F.lit(False))
    return F.coalesce(~out & (path.rlike(r"\.(jpg|jpeg|png|webp)$") | x.contains_any(low, formats.WEB_IMAGE_HOSTS)), F.lit(False))


def in_order(images: DataFrame, by: str, most: int = 5) -> DataFrame:
    """images(by, position, url) with place: the metadata's image (position -2), og:image (-1), then by position; each address once, the first `most`."""
    once = images.groupBy(by, "url").agg(F.min("position").alias("position"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("position", "url"))
    return once.withColumn("place", place).where(F.col("place") <= most)


def watermark(url: Column) -> Column:
    low = F.lower(url)
    marked = low.rlike("/watermark/|/wm/|_wm\\.|-wm\\.")
    return F.when(marked & low.rlike("center|full"), "center").when(marked, "corner").otherwise("none")


def page_images(pages: DataFrame, r: ImageRules = SCRAPER) -> DataFrame:
    """(page_id, position, url, alt, title, css_class, verdict): og:image at position -1, then img tags in order; the first of equal keys."""
    attr = lambda tag, name: F.regexp_extract(tag, rf"""(?i)\b{name}=["']([^"']*)["']""", 1)
    html, base = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    og = F.regexp_extract_all(html, F.lit(r"""(?i)<meta[^>]+og:image["'][^>]*>"""), F.lit(0))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img[^>]+>"), F.lit(0))
    one = F.transform(F.slice(og, 1, 1), lambda t: F.struct(F.lit(-1).alias("position"), t.alias("tag"), attr(t, "content").alias("src")))
    rest = F.transform(tags, lambda t, i: F.struct(i.alias("position"), t.alias("tag"), attr(t, "src").alias("src")))
    rows = pages.select("page_id", base.alias("base"), F.explode(F.concat(one, rest)).alias("i")).select("page_id", "base", "i.*").where("src <> ''")
    rows = rows.withColumn("url", image_url(F.col("src"), F.col("base")))
    rows = rows.select("page_id", "position", "url", attr(F.col("tag"), "alt").alias("alt"), attr(F.col("tag"), "title").alias("title"), attr(F.col("tag"), "class").alias("css_class"), verdict(F.col("url"), r).alias("verdict"))
    first = F.row_number().over(Window.partitionBy("page_id", image_key(F.col("url"))).orderBy("position"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


#: A tag with its attributes, which may hold `>` inside quotes.
TAG = r"""(?i)<{0}\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: name = value, in double, single or no quotes.
ATTRIBUTE = r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def attributes(tag: Column) -> Column:
    """The attributes of a tag as (name, value) in order, names in lower case."""
    pairs = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    value = lambda p: F.regexp_replace(F.regexp_extract(p, ATTRIBUTE, 2), r"""^["']|["']$""", "")
    return F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_extract(p, ATTRIBUTE, 1)).alias("name"), value(p).alias("value")))


def attribute(parsed: Column, name: str) -> Column:
    """The first value of a name, empty without one."""
    return F.coalesce(F.get(F.filter(parsed, lambda a: a["name"] == name), F.lit(0))["value"], F.lit(""))


def image_records(pages: DataFrame, r: ImageRules = SCRAPER) -> DataFrame:
    """(page_id, place, position, url, alt, title, css_class, in_article): records of the images of pages(page_id, url, html) that may belong to the article.

    og:image first, at position -1 (of several the last one first), then img tags in order; each address once; those that the rules refuse are out.
    Attributes may stand in any order and quoting."""
    html, base = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    parsed = lambda tag: F.transform(F.regexp_extract_all(html, F.lit(TAG.format(tag)), F.lit(0)), attributes)
    og = F.filter(parsed("meta"), lambda a: F.lower(attribute(a, "property")) == "og:image")
    metas = F.transform(og, lambda a, i: F.struct(F.lit(-1).alias("position"), (-i).alias("n"), attribute(a, "content").alias("src"), F.lit("").alias("alt"), F.lit("Open Graph Image").alias("title"), F.lit("og-image").alias("css_class")))
    tags = F.transform(parsed("img"), lambda a, i: F.struct(F.lit(0).alias("position"), i.alias("n"), *(attribute(a, n).alias(m) for n, m in (("src", "src"), ("alt", "alt"), ("title", "title"), ("class", "css_class")))))
    rows = pages.select("page_id", base.alias("base"), F.explode(F.concat(metas, tags)).alias("i")).select("page_id", "base", "i.*").where("src <> ''")
    rows = rows.withColumn("url", image_url(F.col("src"), F.col("base"))).where(verdict(F.col("url"), r) == "valid")
    # an address that an img tag has stays there, with what the tag says of it
    once = F.row_number().over(Window.partitionBy("page_id", "url").orderBy(F.desc("position"), "n"))
    rows = rows.withColumn("_n", once).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("position", "n"))
    rows = rows.withColumn("place", place)
    metas_of = F.count_if(F.col("position") < 0).over(Window.partitionBy("page_id"))
    position = F.when(F.col("position") < 0, -1).otherwise(F.col("place") - metas_of - 1).cast("int")
    return rows.select("page_id", "place", position.alias("position"), "url", "alt", "title", "css_class", F.lit(True).alias("in_article"))


def relevance(keywords: Column) -> Column:
    """3 inside the article, 3 for a keyword in alt or title, 1 for an early place (2 without any metadata), 2 for a keyword in the file name."""
    said = F.lower(F.concat_ws(" ", "alt", "title"))
    name = F.lower(F.element_at(F.split(F.col("url"), "/"), -1))
    bare = (F.trim(said) == "") & ~F.coalesce(F.col("in_article"), F.lit(False))
    hit = lambda text: F.exists(keywords, lambda k: text.contains(F.lower(k)))
    early = F.when(bare, 2).otherwise(1)
    return F.when(F.col("in_article"), 3).otherwise(0) + F.when(hit(said), 3).otherwise(0) + F.when(F.col("position") < 3, early).otherwise(0) + F.when(hit(name), 2).otherwise(0)


def audit(images: DataFrame, by: list[str]) -> DataFrame:
    return images.groupBy(*by).agg(F.count("*").alias("total_count"), F.count_if(F.col("verdict") == "valid").alias("valid_count"), F.array_sort(F.collect_set(F.when(F.col("verdict") != "valid", F.col("verdict")))).alias("invalid_reasons"))


def quality_ok(kind: Column, size: Column, width: Column, height: Column) -> Column:
    """image/*, 10 to 5000 KB, at least 400 x 300; what is unknown passes."""
    return F.coalesce(kind.startswith("image/"), F.lit(True)) & F.coalesce(size.between(10 * 1024, 5000 * 1024), F.lit(True)) & F.coalesce((width >= 400) & (height >= 300), F.lit(True))


def disposition(mark: Column, has_original: Column) -> Column:
    return F.when((mark == "center") & ~has_original, "drop").when(mark == "center", "original").otherwise("keep")


def placement(rank: Column, count: Column) -> Column:
    """inline or gallery: all of up to three inline; of four, three; of more, four; at most six in the gallery."""
    inline = F.when(count >= 5, 4).when(count == 4, 3).otherwise(count)
    return F.when(rank <= inline, "inline").when(rank <= inline + 6, "gallery")
