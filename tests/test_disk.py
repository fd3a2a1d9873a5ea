"""What is written and shuffled on the way: groups that tasks hold whole, and shuffle files of what is already written."""

import random

from pyspark.sql import functions as F


def some_sentences(seed, groups, n):
    r = random.Random(seed)
    words = ["alpha", "be", "gamma", "delta", "epsilons", "ze", "eta", "thetas", "iota", "incomprehensibilities", "mu", "nu", "xi"]
    rows = []
    for g in range(groups):
        old = []
        for i in range(n):
            s = r.choice(old) if old and r.random() < 0.3 else " ".join(r.choice(words) + (str(r.randrange(300)) if r.random() < 0.7 else "") for _ in range(r.randrange(1, 12)))
            if r.random() < 0.3:
                s = s[r.randrange(len(s)) :] + " " + str(r.randrange(10**6))
            if r.random() < 0.02:
                s = " ".join(f"{r.randrange(10**5)}" for _ in range(60)) + s
            old.append(s)
            rows.append((g, f"{g}:{i}", r.randrange(5), s))
    return rows


def kept(rows, num, den, shared):
    """The sequential rule over all earlier kept sentences."""
    out = set()
    for g in {x[0] for x in rows}:
        firsts = {}
        for _, i, o, s in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1])):
            firsts.setdefault(" ".join(s.split()), (i, set(s.split())))
        led = []
        for key, (i, t) in firsts.items():
            grams = {key[p : p + shared] for p in range(len(key) - shared + 1)} if shared else set()
            if not any((len(t & u) * den >= len(t | u) * num and t & u) or grams & h for u, h in led):
                led.append((t, grams))
                out.add((g, i))
    return out


def test_sentences_within_tasks_like_the_sequential_rule(spark, monkeypatch):
    from newsloom.operators import sentences, similarity

    rows = some_sentences(5, 6, 60)
    df = spark.createDataFrame(rows, "grp int, id string, ord int, sentence string")
    for cut, num, den, shared in ((128, 1, 2, 15), (20, 1, 2, 15), (128, 7, 10, 0)):
        monkeypatch.setattr(similarity, "CUT", cut)
        want = kept(rows, num, den, shared)
        assert 30 < len(want) < 330
        assert {(x.grp, x.id) for x in sentences.distinct_sentences(df, num, den, shared).collect()} == want
    monkeypatch.setattr(sentences, "GROUP", sorted(sum(len(x[3]) for x in rows if x[0] == g) for g in range(6))[2])  # half of the groups are large
    assert {(x.grp, x.id) for x in sentences.distinct_sentences(df).collect()} == kept(rows, 1, 2, 15)


def test_marked_pieces_hold_every_shared_substring(spark):
    from newsloom.operators.similarity import marked_pieces

    r = random.Random(2)
    texts = ["".join(r.choice("ab ") if r.random() < 0.9 else "\u00e9" for _ in range(r.randrange(10, 400))) for _ in range(30)] + ["x" * 200, " " * 40, "x" * 15, "x" * 14, ""]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "grp int, id int, text string")
    found = {}
    for x in marked_pieces(df).collect():
        assert x.piece in texts[x.id]
        for p in range(len(x.piece) - 14):
            found.setdefault((x.id, x.piece[p : p + 15]), set()).add(x.print)
    prints = {}
    for i, t in enumerate(texts):
        for s in {t[p : p + 15] for p in range(len(t) - 14)}:
            assert prints.setdefault(s, found[i, s]) & found[i, s]


def test_sentences_write_neither_words_nor_pieces_nor_keep_shuffles(spark, tmp_path, monkeypatch):
    from newsloom import storage
    from newsloom.operators import sentences

    rows = [(g, f"{g}:{i}", i, f"sentence {i * 7919 % 100003} of group {g} and words {i} {i + 1} {i * i}") for g in range(40) for i in range(50)]
    df = storage.materialized(spark.createDataFrame(rows, "grp int, id string, ord int, sentence string"), "rows")
    names, since = [], storage.mark()
    whole = storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda s, name: names.append(name) or whole(s, name))
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()))
    before = blocks()
    out = sentences.distinct_sentences(df)
    assert not {"pieces", "token-sets", "numbered-sets", "prefixes", "sentences"} & set(names)
    assert storage.mark() == since + 2  # sizes of groups, and who is left out
    assert blocks() <= before + 30  # those of counts and first rows only
    assert 0 < out.count() < len(rows) and spark.conf.get(storage.CLEANUP, None) != "true"


def test_shared_substrings_are_shuffled_once_and_not_written(spark, monkeypatch):
    from newsloom import storage
    from newsloom.operators import similarity

    texts = [(i % 2, i, t) for i, (_, _, _, t) in enumerate(some_sentences(9, 1, 80))]
    df = spark.createDataFrame(texts, "grp int, id int, text string")
    monkeypatch.setattr(storage, "new_path", lambda *a: 1 / 0)  # nothing is written
    found = similarity.shared_substrings(df)
    held = {}
    for g, i, t in texts:
        for p in range(len(t) - 14):
            held.setdefault((g, t[p : p + 15]), set()).add(i)
    assert {(x.grp, x.key, x.id) for x in found.collect()} == {(g, k, i) for (g, k), ids in held.items() if len(ids) > 1 for i in ids}
    texts_of = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")
    assert texts_of(found) == 3  # cuts, places and substrings, each made once


def test_many_pairs_are_met_in_rounds(spark, monkeypatch):
    """Each round's candidates are deleted before the next; edges, links and leaders are those of one round."""
    from newsloom import storage
    from newsloom.operators import similarity

    r = random.Random(4)
    sets = [["all", *(r.choice("abcdefghij") for _ in range(r.randint(0, 5)))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>").select(F.lit(0).alias("grp"), "id", F.col("id").alias("ord"), "tokens")
    u = [set(s) for s in sets]
    want = [(a, b, len(u[a] & u[b]), len(u[a] | u[b])) for a in range(40) for b in range(a + 1, 40) if len(u[a] & u[b]) * 4 >= len(u[a] | u[b])]
    lead = {x.id: x.leader for x in similarity.leaders_by_tokens(df, 6, 10).collect()}
    for name, value in (("ALL", 0), ("EACH", 1), ("CHUNK", 3)):
        monkeypatch.setattr(similarity, name, value)
    since, names, write = storage.mark(), [], similarity.materialized
    monkeypatch.setattr(similarity, "materialized", lambda d, name: names.append(name) or write(d, name))
    got = similarity.similarity_edges(df, 1, 4)
    left = storage._own.paths[since:]
    assert names.count("met") > 2 and not any("/met-" in p for p in left) and sum("/reached-" in p for p in left) == names.count("met")
    assert sorted((e.a, e.b, e.both, e.either) for e in got.collect()) == want
    assert {x.id: x.leader for x in similarity.leaders_by_tokens(df, 6, 10).collect()} == lead


def test_sets_of_texts_are_written_once_and_not_shuffled(spark, monkeypatch):
    from newsloom.operators import dedup

    names, write = [], dedup.materialized
    monkeypatch.setattr(dedup, "materialized", lambda d, name: names.append(name) or write(d, name))
    rows = [(i, i, f"title {i % 3}", " ".join(f"w{(i % 20) * 3 + k}" for k in range(30))) for i in range(60)]
    classes, members = dedup.text_classes(spark.createDataFrame(rows, "id long, ord long, title string, body string"))
    assert names == ["token-sets", "text-members"]
    plan = classes._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    want = {i: i % 20 for i in range(60)}  # single digits are no tokens
    assert {x.id: x.first for x in members.collect()} == want and {x.id for x in classes.collect()} == set(want.values())


def test_groups_move_neither_bodies_nor_copies_of_the_leader(spark, tmp_path, monkeypatch):
    """Members come to the tokens of their leader, which are not copied to them, and bodies are not shuffled."""
    from newsloom.operators import dedup

    long = [f"b{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    rows = [(i, i, "one title of all", " ".join(long if i == 0 else [f"m{chr(97 + i)}{chr(97 + k)}" for k in range(3)])) for i in range(20)]
    spark.createDataFrame(rows, "id long, ord long, title string, body string").write.parquet(f"{tmp_path}/news")
    news = spark.read.parquet(f"{tmp_path}/news")
    nodes = []
    monkeypatch.setattr(dedup, "greedy_leaders_by_keys", lambda n, keys, whole=dedup.greedy_leaders_by_keys: nodes.append(n) or whole(n, keys))
    got = dedup.similar_groups(news)
    assert {(x.leader, x.id) for x in got.collect()} == {(0, i) for i in range(1, 20)}
    plan = nodes[0]._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftSemi") :]
    assert "length(body" in join  # lengths are taken before the join
    ids = spark.createDataFrame([(0, i) for i in range(1, 20)], "a long, b long")
    classes, _ = dedup.text_classes(news)
    plan = dedup.scored(ids, classes, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    outer, inner = plan.index("Join Inner"), plan.index("Join Inner", plan.index("Join Inner") + 5)
    assert "(a#" in plan[outer : plan.index("\n", outer)] and "(b#" in plan[inner : plan.index("\n", inner)]


def shuffled(spark):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_quotes_are_shuffled_without_their_words(spark):
    from newsloom.operators import citations

    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n))
    said = [(t, i, [text(30) for _ in range(40)]) for t in range(5) for i in range(4)]
    made = [(t, [q[0].upper(), q[1].rsplit(" ", 9)[0]]) for t, i, q in said if i == 0]
    chars = sum(len(s) for _, _, q in said for s in q)
    a, b = spark.createDataFrame(made, "topic int, quotes array<string>"), spark.createDataFrame(said, "topic int, id int, quotes array<string>")
    before = shuffled(spark)
    got = {tuple(x) for x in citations.quote_matches(a, b, "topic").collect()}
    assert got == {(t, q, 0) for t, qs in made for q in qs}
    assert shuffled(spark) - before < 1.3 * chars


def test_generated_texts_leave_one_table(spark):
    from newsloom import storage
    from newsloom.plans import stage5

    since = storage.mark()
    out = stage5.m15_generated(spark, "/root/testdata/sf0.001")
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._own.paths[since:]] == ["generated"]
    assert out.count() == 40


def test_rounds_of_leaders_stop_when_they_take_little(spark, monkeypatch):
    """A ring of titles of which one can lead at a time, and a common word: a round decides next to nothing, so the rest is compared at once."""
    from newsloom.operators import dedup, similarity

    n = 60
    title = lambda i: " ".join(f"c{chr(97 + (i + k) % n // 26)}{chr(97 + (i + k) % n % 26)}" for k in range(9)) + " the of and"
    news = spark.createDataFrame([(i, i, title(i), "") for i in range(n)], "id long, ord long, title string, body string")
    calls, whole = [], similarity.gathered
    monkeypatch.setattr(similarity, "gathered", lambda *a: calls.append(1) or whole(*a))
    monkeypatch.setattr(similarity, "PAIRS", 0)
    got = dedup.web_groups(news, F.length("body") * 0.0, 6, 10)
    sets = [set(title(i).split()) for i in range(n)]
    heads, want = [], {}
    for i in range(n):
        near = [h for h in heads if len(sets[h] & sets[i]) * 10 >= len(sets[h] | sets[i]) * 6]
        want[i] = near[0] if near else i
        heads += [] if near else [i]
    assert {x.id: x.leader for x in got.collect()} == want and len(heads) > 5
    assert len(calls) < 8
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()  # texts are read once
