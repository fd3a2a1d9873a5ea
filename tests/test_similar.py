"""Weighted similarity without pairs of equal titles, and winnowed substrings, against brute force and on hot titles."""

import random

from pyspark.sql import functions as F


def news_of(spark, rows):
    return spark.createDataFrame([(i, i, t, b) for i, (t, b) in enumerate(rows)], "id long, ord long, title string, body string")


def tokens(s):
    import re

    return {t for t in re.findall("[a-z]+|[0-9]+", s.lower()) if len(t) >= 2}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def score(p, q):
    return round(0.6 * jaccard(tokens(p[0]), tokens(q[0])) + 0.4 * jaccard(tokens(p[1]), tokens(q[1])), 6)


def some_news(seed, n):
    r = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(14)]
    bodies = [" ".join(r.sample([f"b{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(30)], r.randrange(3, 9))) for _ in range(12)]
    rows = []
    for _ in range(n):
        title = " ".join(words[:7]) if r.random() < 0.3 else " ".join([*words[:6], r.choice(words[6:])]) if r.random() < 0.4 else " ".join(r.sample(words, r.randrange(1, 5)))
        body = r.choice(bodies).split()
        rows.append(("" if r.random() < 0.05 else title, "" if r.random() < 0.05 else " ".join(body[: r.randrange(1, len(body) + 1)])))
    return rows


def test_weighted_similarity_like_brute_force(spark, monkeypatch):
    from newsloom.operators import dedup

    rows = some_news(3, 160)
    links = [sum(score(p, q) >= 0.55 for j, q in enumerate(rows) if i != j) for i, p in enumerate(rows)]
    order = sorted(range(len(rows)), key=lambda i: (-len(rows[i][1]), i))
    leader, heads = {}, []
    for i in order:
        near = [h for h in heads if score(rows[h], rows[i]) >= 0.55]
        leader[i] = near[0] if near else i
        heads += [] if near else [i]
    assert 0 < min(map(len, (heads, set(links)))) and max(links) > 60
    for few in (64, 1):  # title by title, and by prefixes of bodies
        monkeypatch.setattr(dedup, "FEW", few)
        got = {x.id: x.links for x in dedup.weighted_counts(news_of(spark, rows)).collect()}
        assert [got[i] for i in range(len(rows))] == links
        groups = {(x.leader, x.id, x.score) for x in dedup.similar_groups(news_of(spark, rows)).collect()}
        assert groups == {(h, i, score(rows[h], rows[i])) for i, h in leader.items() if h != i}


def test_fifty_thousand_articles_of_one_title(spark):
    """Different bodies: every article is linked with all others, and neither counts nor groups make pairs of them."""
    from newsloom.operators import dedup

    n = 50_000
    body = F.concat_ws(" ", *(F.concat(F.lit("t"), F.pmod(F.col("id") * (2 * k + 3), F.lit(9_973 + k)).cast("string")) for k in range(6)))
    news = spark.range(n).select("id", F.col("id").alias("ord"), F.lit("one title of many articles").alias("title"), body.alias("body"))
    links = dedup.weighted_counts(news).groupBy("links").count().collect()
    assert [(x.links, x["count"]) for x in links] == [(n - 1, n)]
    groups = dedup.similar_groups(news).agg(F.countDistinct("leader").alias("leaders"), F.count("*").alias("n"), F.min("score").alias("least")).first()
    assert (groups.leaders, groups.n) == (1, n - 1) and groups.least >= 0.6


def test_shared_substrings_like_brute_force(spark):
    from newsloom.operators.similarity import shared_substrings

    r = random.Random(6)
    base = ["".join(r.choice("abc de한국😀é") for _ in range(60)) for _ in range(6)]
    texts = [(k % 2, k, "".join(r.choice("abcdefgh ") for _ in range(r.randrange(0, 30))) + base[k % 6][(a := r.randrange(0, 45)) : a + r.randrange(10, 30)] + "z" * r.randrange(0, 40)) for k in range(80)]
    texts += [(0, 100, "short"), (0, 101, "a" * 14), (0, 102, "a" * 15), (1, 103, "a" * 200), (1, 104, "b" + "a" * 15), (0, 105, "")]
    df = spark.createDataFrame([*texts, (0, 106, None)], "grp int, id int, text string")
    want = {}
    for g, i, t in texts:
        for k in range(len(t) - 14):
            want.setdefault((g, t[k : k + 15]), set()).add(i)
    want = {(g, k, i) for (g, k), ids in want.items() if len(ids) > 1 for i in ids}
    got = [(x.grp, x.key, x.id) for x in shared_substrings(df).collect()]
    assert len(want) > 300 and set(got) == want and len(got) == len(want)


def test_winnowing_writes_less_than_a_quarter(spark):
    from newsloom.operators.similarity import winnowed

    r = random.Random(1)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(800)) for _ in range(40)]
    rows = winnowed(spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "grp int, id int, text string")).agg(F.count("*").alias("n"), F.sum(F.length("piece")).alias("chars")).first()
    grams = sum(len(t) - 14 for t in texts)
    assert rows.n < grams / 4 and rows.chars < 15 * grams / 2.5


def greedy(rows, num, den):
    """The sequential rule over (ord, id, tokens)."""
    heads, leader = [], {}
    for _, i, t in sorted(rows, key=lambda r: r[:2]):
        near = [h for h, s in heads if s and t and len(s & t) * den >= len(s | t) * num]
        leader[i] = near[0] if near else i
        heads += [] if near else [(i, t)]
    return leader


def test_leaders_in_rounds_like_the_sequential_rule(spark, monkeypatch):
    from newsloom.operators import similarity

    r = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    for case, (rounds, pairs) in enumerate([(8, 0), (2, 0), (8, 20), (8, 3)]):
        monkeypatch.setattr(similarity, "ROUNDS", rounds)
        monkeypatch.setattr(similarity, "PAIRS", pairs)
        sets = [r.sample(words, r.randrange(0, 7)) for _ in range(150)] + [words[:8] + [f"x{i}"] for i in range(40)]
        sets += [[f"c{i + k}" for k in range(6)] for i in range(50)]  # a chain: each is similar to the next
        rows = [(g, i, (i * 37) % 100, t) for g in (0, 1) for i, t in enumerate(sets[g * 20 :])]
        df = spark.createDataFrame(rows, "grp int, id long, ord long, tokens array<string>")
        got = {(x.grp, x.id): x.leader for x in similarity.leaders_by_tokens(df, 6, 10).collect()}
        want = {(g, i): h for g in (0, 1) for i, h in greedy([(o, k, set(t)) for gg, k, o, t in rows if gg == g], 6, 10).items()}
        assert got == want, case


def test_fifty_thousand_titles_that_differ_in_one_word(spark):
    from newsloom.operators import similarity

    n = 50_000
    common = [F.lit(w) for w in ("all", "of", "these", "titles", "are", "nearly", "equal")]
    items = spark.range(n).select(F.lit(0).alias("grp"), "id", F.col("id").alias("ord"), F.array(*common, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("tokens"))
    made = []
    whole = similarity.similarity_edges

    def edges(*a):
        made.append(whole(*a).count())
        return whole(*a)

    similarity.similarity_edges = edges
    try:
        got = similarity.leaders_by_tokens(items, 6, 10).groupBy("leader").count().collect()
    finally:
        similarity.similarity_edges = whole
    assert [(x.leader, x["count"]) for x in got] == [(0, n)] and made == [0]


def test_coverage_of_small_and_large_topics(spark, monkeypatch):
    from newsloom.operators import sentences

    r = random.Random(12)
    rows = [(i, i % 4 if i % 7 else 9, i, " ".join(r.choice("ABCDEFGHIJKLM") for _ in range(r.randrange(0, 7)))) for i in range(120)] + [(200, None, 1, "A B"), (201, 3, 1, None)]
    df = spark.createDataFrame(rows, "id long, topic long, ord long, title string")
    want = {}
    for i, g, _, t in rows:
        own = set((t or "").split())
        near = [set((u or "").split()) for j, h, _, u in rows if j != i and h == g and g is not None]
        want[i] = 1 + sum(bool(own & o) and 5 * len(own & o) >= len(own | o) for o in near)
    for few in (200, 20, 0):
        monkeypatch.setattr(sentences, "FEW", few)
        assert {x.id: x.coverage for x in sentences.coverage(df, "topic").collect()} == want


def test_edges_meet_by_numbers_and_come_once(spark):
    """Tokens are longs, those that no other set holds post nothing, and what is held of places and sketches loses no pair; no distinct is needed."""
    import random

    from newsloom.operators.similarity import prefixes, similarity_edges

    r = random.Random(5)
    sets = [[r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 9))] + [f"lone{i}"] * (i % 3 == 0) for i in range(90)]
    base = [f"w{k}" for k in range(300)]
    sets += [base[: 300 - 20 * k] + [f"x{k}"] for k in range(8)]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sets)], "grp int, id long, tokens array<string>")
    posts = prefixes(df, 5, 10)
    assert dict(posts.dtypes)["tokens"] == "array<bigint>" and dict(posts.dtypes)["token"] == "bigint"
    lone = [i for i, s in enumerate(sets) if set(s) and all(sum(t in o for o in sets) == 1 for t in set(s))]
    assert not posts.where(F.col("id").isin(lone)).count()
    for num, den in ((1, 4), (4, 10), (6, 10), (9, 10)):
        edges = similarity_edges(df, num, den)
        got = sorted((e.a, e.b, e.both, e.either) for e in edges.collect())
        u = [set(s) for s in sets]
        want = [(a, b, len(u[a] & u[b]), len(u[a] | u[b])) for a in range(len(u)) for b in range(a + 1, len(u)) if u[a] and u[b] and len(u[a] & u[b]) * den >= len(u[a] | u[b]) * num]
        assert got == want and got
        assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()
    many = [str(k) for k in range(3000)]  # a size times a threshold in millionths is no int
    df = spark.createDataFrame([(0, 1, many), (0, 2, many[100:])], "grp int, id long, tokens array<string>")
    assert [(e.both, e.either) for e in similarity_edges(df, 900_000, 1_000_000).collect()] == [(2900, 3000)]


def test_posts_are_written_without_their_sets_and_frequent_tokens_are_dealt(spark, monkeypatch):
    """A set of n tokens posts n rows of one size; parts of a token's posts make the same pairs, each once."""
    from newsloom.operators import similarity

    schemas, write = {}, similarity.materialized
    monkeypatch.setattr(similarity, "materialized", lambda df, name: schemas.setdefault(name, dict(df.dtypes)) and write(df, name))
    monkeypatch.setattr(similarity, "CHUNK", 3)
    r = random.Random(21)
    sets = [["all", *(r.choice("abcdefghij") for _ in range(r.randint(0, 5)))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>").select(F.lit(0).alias("grp"), "id", F.col("id").alias("ord"), "tokens")
    got = sorted((e.a, e.b, e.both, e.either) for e in similarity.similarity_edges(df, 1, 4).collect())
    u = [set(s) for s in sets]
    assert got == [(a, b, len(u[a] & u[b]), len(u[a] | u[b])) for a in range(40) for b in range(a + 1, 40) if len(u[a] & u[b]) * 4 >= len(u[a] | u[b])]
    similarity.leaders_by_tokens(df, 6, 10).collect()
    posted = [s for s in schemas.values() if "token" in s and "id" in s]
    assert posted and not any(t.startswith("array") for s in posted for t in s.values())
