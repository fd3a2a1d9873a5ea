"""Text functions: each takes and returns columns of built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import news as rules

NO_STRINGS = "array<string>"


def strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast(NO_STRINGS)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    """Empty text counts as missing."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    return F.coalesce(*map(filled, cs))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where it stands inside lambdas or several times."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_contained(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sketch(tokens: Column, longs: int) -> list[Column]:
    """The tokens as bits of that many longs: a bit that two sets do not share stands for a token that they do not share."""
    at = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * longs)).cast("int"))
    bit = lambda i, k: F.when(F.floor(i / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long"))
    word = lambda k: F.aggregate(at, F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(bit(i, k)))
    return [word(k) for k in range(longs)]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / all_).otherwise(0.0)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")).otherwise(0)


def url_key(url: Column) -> Column:
    """Scheme, host and path in lower case, without query, fragment, parameters and trailing slashes; null for an empty url."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r";[^/]*$", "")
    return filled(F.rtrim(F.lower(bare), F.lit("/")))


def title_hash(title: Column) -> Column:
    return F.md5(F.lower(F.trim(F.coalesce(title, F.lit("")))))


def record_id(source_id: Column, url: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(source_id, F.lit("")), F.coalesce(url, F.lit(""))))


def safe_id(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9가-힣_]", "_"))


#: Entities as the cleaners decode them; `&amp;` comes last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def trimmed_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda x: x != ""), "\n")


def clean_html(html: Column) -> Column:
    """Without script and style blocks and tags, entities decoded after that, lines trimmed, blank lines dropped."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", ""), r"<[^>]+>", "")
    return trimmed_lines(unescape(text))


def clean_snippet(html: Column) -> Column:
    """Entities decoded first, then without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(F.coalesce(html, F.lit(""))), r"<[^>]+>", ""), r"\s+", " "))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", ""))


def parse_time(text: Column) -> Column:
    """ISO, RFC 2822 and common forms as UTC; null if none fits."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\bGMT$", "+0000"), r"Z$", "+0000")
    bare = F.regexp_replace(bare, r"([+-]\d{2}):(\d{2})$", "$1$2")
    forms = (
        "yyyy-MM-dd'T'HH:mm:ssxx", "yyyy-MM-dd'T'HH:mm:ss.SSSxx", "yyyy-MM-dd HH:mm:ssxx", "d MMM yyyy HH:mm:ss xx", "yyyy-MM-dd'T'HH:mm:ss",
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd",
    )
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in forms))


def split_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s)), lambda x: x != "")


def infer_category(hint: Column, title: Column, categories: dict[str, tuple[str, ...]] = rules.CATEGORIES) -> Column:
    """The first category with a keyword inside the lower-cased hint and title."""
    text = F.lower(F.concat_ws(" ", F.coalesce(hint, F.lit("")), F.coalesce(title, F.lit(""))))
    out = F.lit(None).cast("string")
    for name, keys in reversed(categories.items()):
        out = F.when(contains_any(text, keys), name).otherwise(out)
    return out


def by_tier(tier: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(tier == name, value).otherwise(out)
    return out


def is_video(title: Column) -> Column:
    return F.coalesce(title.rlike("(?i)" + "|".join(f"(?:{p})" for p in rules.VIDEO_TITLES)), F.lit(False))


def sentences(text: Column) -> Column:
    """Lines, cut after . ! ? and white space; a full stop is added where none of them ends the sentence."""
    parts = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(F.trim(line), r"(?<=[.!?])\s+")))
    parts = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
    # most end with one, which is seen without a search of the whole sentence
    return F.transform(parts, lambda s: F.when(s.endswith(".") | s.endswith("!") | s.endswith("?") | s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))


def for_dedup(text: Column) -> Column:
    """Lower case, white space collapsed, only word characters kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"(?U)[^\w\s]", ""))


def mixed_tokens(text: Column) -> Column:
    """Runs of Hangul, of Latin letters or of digits, of at least two characters, lower-cased."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[가-힣]+|[a-z]+|[0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def title_tokens(text: Column) -> Column:
    """Runs of at least two Hangul or Latin letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[가-힣a-z]{2,}"), F.lit(0))


def entities(text: Column, patterns: tuple[str, ...] = rules.KOREAN.entities) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns)))


def keywords(text: Column, stop_words: tuple[str, ...] = rules.STOP_WORDS) -> Column:
    return F.filter(words(F.lower(text)), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def cut_title(title: Column, most: int = 60, least: int = 40) -> Column:
    """Titles over `most` characters end at the last space, comma or full stop after `least`."""
    head = F.substring(title, 1, most)
    back = F.reverse(head)
    at = F.greatest(*(F.when(F.instr(back, c) > 0, most - F.instr(back, c)).otherwise(-1) for c in (" ", ",", ".")))
    return F.when(F.length(title) <= most, title).when(at > least, F.substring(title, F.lit(1), at)).otherwise(head)


def digits_before(text: Column, patterns: Iterable[str]) -> Column:
    """Any of the patterns, each `\\d+` and a plain sign: a sign is looked for first, and one digit before it is enough."""
    signs = [p.removeprefix(r"\d+") for p in patterns]
    return contains_any(text, signs) & text.rlike(r"\d(?:" + "|".join(signs) + ")")


def has_number(text: Column) -> Column:
    return digits_before(text, "%억만조원달러명개건")


def has_quote(text: Column) -> Column:
    return text.contains('"') | text.contains("'") | text.contains("라고 ")


def keyword_in(text: Column, word: str) -> Column:
    """A keyword that a particle, an ending, a space or punctuation follows."""
    import re

    return text.rlike(re.escape(word) + rules.WORD_END)


def clean_title(title: Column) -> Column:
    """Without a trailing outlet or domain, bracketed tags and teaser phrases."""
    import re

    names = "|".join(sorted(map(re.escape, rules.OUTLETS), key=len, reverse=True))
    bare = F.regexp_replace(title, rf"\s*[-–—|]\s*(?:{names}|[a-zA-Z0-9\-]+\.(?:com|co\.kr|net|org))\s*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s*\[[^\]]{2,30}\]\s*", " "), r"'이\s*(?:제품|기업|종목|것)'", "")
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def split_title_body(text: Column, default: Column) -> Column:
    """Struct of title and body: the first line and the rest; a first line over 100 characters is no title."""
    head = F.trim(F.regexp_replace(F.element_at(F.split(text, "\n"), 1), r"^#+\s*", ""))
    rest = F.trim(F.regexp_replace(text, r"^[^\n]*\n?", ""))
    return F.when((F.length(head) > 100) | (head == ""), F.struct(default.alias("title"), text.alias("body"))).otherwise(F.struct(head.alias("title"), rest.alias("body")))


def section_parts(body: Column) -> Column:
    """Struct of lead, body and closing: the first, the middle and the last of the blocks between blank lines."""

    def parts(p: Column) -> Column:
        n = F.size(p)
        middle = F.array_join(F.slice(p, F.lit(2), F.greatest(F.when(n > 2, n - 2).otherwise(n - 1), F.lit(0))), "\n\n")
        return F.struct(F.element_at(p, 1).alias("lead"), middle.alias("body"), F.when(n > 2, F.element_at(p, -1)).otherwise("").alias("closing"))

    return let(F.split(body, "\n\n"), parts)


def mentioned(text: Column, names: Iterable[str]) -> Column:
    """The names of a dictionary that a text holds, in order of the dictionary."""
    return F.filter(strings(names), lambda n: text.contains(n))


#: A line of a list of articles, and the lines after it up to a blank one.
PRESS_LIST = r"(?:^|\n)[^\S\n]*[-·•][^\S\n]*[^\n]+[-–][^\S\n]*(?:" + "|".join(rules.LIST_OUTLETS) + r")[^\n]*(?:\n[^\S\n]*[^\s][^\n]*)*"
#: An element of a list: a line that begins with a hyphen, after any blank lines.
LISTED = r"\n\s*-\s*[^\n]+"


def clean_body(text: Column) -> Column:
    """A scraped body without bylines and addresses, lists of articles, sentences of services and tails about rights.

    Two listed lines or more in a row are dropped; from a line that names an outlet at its end on, everything up to a blank line is."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n"), " {2,}", " ")
    for pattern in (r"[가-힣]{2,4}\s*기자\s*[\p{L}\p{N}_.]*@[\p{L}\p{N}_.]+", r"[\p{L}\p{N}_.]+@[\p{L}\p{N}_.]+\.[\p{L}\p{N}_.]+", r"(?md)\n[가-힣]{2,4}\s*기자\s*$"):
        out = F.regexp_replace(out, pattern, "")
    # first all of a run but its last, then the last: no loop over groups, which long lists would nest too deep
    out = F.regexp_replace(F.regexp_replace(out, f"{LISTED}(?={LISTED})", "\uffff"), f"\uffff+{LISTED}", "")
    for flags, patterns in (("(?id)", rules.BODY_SERVICE), ("(?imd)", rules.BODY_TAILS)):
        for pattern in patterns:
            out = F.regexp_replace(out, flags + pattern, "")
    out = F.regexp_replace(out, PRESS_LIST, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s*\n", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")
