"""Scraped pages: cleaned bodies, image records and page bodies against plain versions."""

import random
import re

from pyspark.sql import functions as F


def cleaned(text):
    """The rule line by line."""
    from newsloom.rules import news as rules

    text = re.sub(" {2,}", " ", re.sub(r"\n{3,}", "\n\n", text))
    for p in (r"[가-힣]{2,4}\s*기자\s*[\w.]*@[\w.]+", r"[\w.]+@[\w.]+\.[\w.]+"):
        text = re.sub(p, "", text)
    text = re.sub(r"\n[가-힣]{2,4}\s*기자\s*$", "", text, flags=re.M)
    text = re.sub(r"(?:\n\s*-\s*[^\n]+){2,}", "", text)
    for p in rules.BODY_SERVICE:
        text = re.sub(p, "", text, flags=re.I)
    for p in rules.BODY_TAILS:
        text = re.sub(p, "", text, flags=re.I | re.M)
    kept, skip = [], False
    for line in text.split("\n"):
        if re.match(r"^[-·•]\s*.+[-–]\s*(?:" + "|".join(rules.LIST_OUTLETS) + ")", line.strip()):
            skip = True
            continue
        skip = skip and bool(line.strip())
        if not skip:
            kept.append(line)
    return re.sub(r"^\s*\n", "", re.sub(r"\n{3,}", "\n\n", "\n".join(kept))).strip()


def test_bodies_are_cleaned_like_the_rule(spark):
    from newsloom.functions.text import clean_body

    lines = [
        "본문이다.", "삼성전자는 1일 발표했다.", "", "", "  ", "홍길동 기자", "홍길동 기자 hong@news.kr", "문의 a.b@c.co.kr 까지", "- 첫째 제목", "- 둘째 제목 - 다른곳", " - 셋째", "· 기사 제목 - 연합뉴스", "• 다른 기사 – YTN 단독",
        "- 제목 하나 - 한겨레", "[관련기사] 더 보기", "[ⓒ 한국신문]", "[출처: 어디]", "Copyright © 2026 X", "무단 전재 및 재배포 금지 x", "ⓒ 2026 신문", "all rights reserved.", "저작권자 (c) 신문", "<저작권자 신문> 뒤", "저작권 © y", "기사 끝 (끝)", "▶ 더 보기", "☞ 링크",
        "AI가 요약한 내용입니다.", "자세한 내용은 홈페이지에서 확인하세요.", "본문 내용은 원문을 참조하세요", "더 자세한 내용은 원문에서 확인 바란다", "é@x.fr ß", "a  b   c", "-", "끝줄",
    ]
    r = random.Random(9)
    texts = ["", "\n\n", "- a\n- b", "x\n- a\n\n- b\n- c\ny", *("\n".join(r.choice(lines) for _ in range(r.randrange(1, 14))) for _ in range(400))]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, t string")
    got = {x.id: x.c for x in df.select("id", clean_body(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == cleaned(t), t
    assert got[-1] == ""
    long = spark.createDataFrame([("본문\n" + "\n- 항목 하나" * 20_000,)], "t string")
    assert long.select(clean_body(F.col("t")).alias("c")).first().c == "본문"


def test_image_records_of_any_quoting(spark):
    from newsloom.operators import images

    html = (
        """<meta name=x content=y><META content='/og1.jpg' property="og:image"><meta property=og:image content=http://h/og2.jpg><meta property="og:image" content="http://h/seen.jpg">"""
        """<img src=one.jpg alt=A><IMG SRC='/two.png' title="a > b" class='c "d"'><img alt="no source"><img src="http://h/seen.jpg" alt='first' alt='second'><img data-src="http://h/lazy.jpg" src="//cdn/x.webp">"""
        """<img src="one.jpg" alt=again><img src="http://h/photo-40x40.jpg"><img src="data:image/png;base64,AAAA"><image src="http://h/no.jpg"><img src="http://h/broken.jpg" alt="never closed"""
    )
    rows = [(1, "http://h/n/1.html", html), (2, "http://h/", None), (3, None, "<img src='http://h/a.jpg'>"), (4, "http://h/", "<img " + "x" * 200_000 + ' "unclosed' * 3)]
    got = images.image_records(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id", "place").collect()
    assert [(x.page_id, x.place, x.position, x.url, x.alt, x.title, x.css_class) for x in got] == [
        (1, 1, -1, "http://h/og2.jpg", "", "Open Graph Image", "og-image"), (1, 2, -1, "http://h/og1.jpg", "", "Open Graph Image", "og-image"), (1, 3, 0, "http://h/n/one.jpg", "A", "", ""),
        (1, 4, 1, "http://h/two.png", "", "a > b", 'c "d"'), (1, 5, 2, "http://h/seen.jpg", "first", "", ""), (1, 6, 3, "http://cdn/x.webp", "", "", ""), (3, 1, 0, "http://h/a.jpg", "", "", ""),
    ]


def test_page_bodies_leave_navigation_out(spark):
    from newsloom.operators import pages

    para = lambda n: f"Sentence number {n} of the article says something of some length about its subject."
    nav = "<ul>" + "".join(f'<li><a href="/{i}">A link to another page number {i}</a></li>' for i in range(12)) + "</ul>"
    html = f"""<html><head><title>{para(0)}</title></head><body><!-- <p>{para(9)}</p> --><nav><p>{para(8)}</p></nav>{nav}<div class="ad">Buy</div>
<article><h1>Short</h1><p>{para(1)}</p><P>{para(2)} <a href="x">with a link</a> &amp; more</P><blockquote>quote</blockquote><p>{para(3)}<br/>{para(4)}</p></article>{nav}<p>{para(5)}</p><footer>{para(6)}</footer><script>var p="<p>{para(7)}</p>"</script></body></html>"""
    rows = [(1, html), (2, None), (3, ""), (4, nav), (5, "plain text without any tag, long enough to be worth something"), (6, "<p>" + "word " * 40_000)]
    got = {x.page_id: x for x in pages.page_bodies(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got[1].body == "\n".join([para(1), para(2) + " with a link & more", "quote", para(3), para(4)])
    assert [got[i].body for i in (2, 3, 4)] == ["", "", ""] and got[4].n_blocks == 12 and got[5].body.startswith("plain") and len(got[6].body) == 199_999


def test_the_best_run_like_all_runs(spark):
    from newsloom.operators import pages

    r = random.Random(2)
    rows = [(i, [(str(k), r.randrange(-6, 7)) for k in range(r.randrange(0, 12))]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, w array<struct<text:string,weight:int>>")
    for x in df.select("id", pages.best_run(F.col("w")).alias("run")).collect():
        w = [v for _, v in rows[x.id][1]]
        runs = [(-sum(w[a:b]), b, a) for b in range(1, len(w) + 1) for a in range(b) if sum(w[a:b]) > 0]
        _, b, a = min(runs, default=(0, 0, 0))
        assert [y.text for y in x.run] == [str(k) for k in range(a, b)], w
