"""Exact set-similarity join by prefix filtering, shared substrings, and the greedy leader kernel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..storage import mark, materialized, settled, small


#: Longs of 64 bits in the sketch of a set, and posts of a token that meet in one task.
SKETCH, CHUNK = 8, 2000
#: Pairs of posts for each post that are met before what they leave is compared and deleted, and pairs that are few whatever the posts.
EACH, ALL = 100, 200_000_000


def numbered(items: DataFrame, num: int | None) -> DataFrame:
    """(grp, id, num, n, tokens, sketch) of items(grp, id, tokens), written: n counts all tokens, and those that others hold too stand rarest first, as numbers.

    A token of a group is numbered by its place among all of them in that order, so that sets are met and intersected as longs; one that no other set of the group
    holds meets nothing and only counts in n. A set of such tokens alone has no row."""
    own = F.col("num") if num is None else F.lit(num)
    items = items.select("grp", "id", own.alias("num"), F.array_distinct("tokens").alias("tokens")).where(F.size("tokens") > 0)
    items = materialized(items, "token-sets")
    each = items.select("grp", "id", "num", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    often = each.groupBy("grp", "token").agg(F.count("*").alias("often")).where("often > 1")
    numbers = materialized(often.orderBy("often", "grp", "token").select("grp", "token", F.monotonically_increasing_id().alias("number")), "token-numbers")
    # the row's own number of tokens bounds this group
    ordered = each.join(numbers, ["grp", "token"]).groupBy("grp", "id", "num", "n").agg(F.sort_array(F.collect_list("number")).alias("tokens"))
    sketch = F.struct(*(w.alias(f"s{k}") for k, w in enumerate(x.sketch(F.col("tokens"), SKETCH))))
    return materialized(ordered.withColumn("sketch", sketch), "numbered-sets")


def posts_of(sets: DataFrame, den: int) -> DataFrame:
    """sets of `numbered` with held, the number of their tokens, and a row for each token of the prefix with its place pos among all n.

    Two sets with |A & B| / |A | B| >= num / den share one of their first n - ceil(n num / den) + 1 tokens in their order."""
    # places count the tokens that no other set holds, which come first
    held = F.size("tokens").cast("long")
    alone = F.col("n") - held
    keep = (F.col("n") - F.ceil(F.col("n") * F.col("num") / den) + 1 - alone).cast("int")  # sizes are longs, as they are multiplied by fine thresholds
    prefix = F.when(keep > 0, F.slice("tokens", F.lit(1), F.greatest(keep, F.lit(1)))).otherwise(F.array().cast(sets.schema["tokens"].dataType))
    posts = sets.select("grp", "id", "num", "n", "tokens", "sketch", held.alias("held"), F.posexplode(prefix).alias("at", "token"))
    return posts.select("grp", "id", "num", "n", "tokens", "sketch", "held", "token", (F.col("n") - F.col("held") + F.col("at") + 1).alias("pos"))


def prefixes(items: DataFrame, num: int | None, den: int) -> DataFrame:
    """The posts of items(grp, id, tokens)."""
    return posts_of(numbered(items, num), den)


def narrow(sets: DataFrame, den: int) -> tuple[DataFrame, int, int]:
    """The posts without their sets, written, with the number of parts in which a token's posts are met; in how many tasks all are, as few bytes make many pairs; and in how many rounds.

    A post is of one size whatever its set: with the tokens in each, a set of n would cost n rows of n tokens, which are small as a file and large once they are read."""
    posts = materialized(posts_of(sets, den).drop("tokens"), "prefixes")
    each = posts.groupBy("grp", "token").agg(F.count("*").alias("often"))
    many = each.select("grp", "token", F.ceil(F.col("often") / CHUNK).alias("parts")).where("parts > 1")
    most = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.col("often").cast("double")
    size, pairs = each.agg(F.coalesce(F.sum("often"), F.lit(0)), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()
    posts = posts.join(small(materialized(many, "long-posts")), ["grp", "token"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return posts, min(most, 1 + size // CHUNK), rounds_of(pairs, size)


def rounds_of(pairs: float, size: int) -> int:
    return int(pairs // max(ALL, EACH * size)) + 1


def can_reach(a, b, num: Column, den: int, longs: int = SKETCH) -> Column:
    """Whether two posts of a token, as a(name) and b(name) give their fields, can be of sets that reach the similarity, by sizes, places and sketches."""
    na, nb = a("n"), b("n")
    length = (na * den >= nb * num) & (nb * den >= na * num)
    place = (F.least(na - a("pos"), nb - b("pos")) + 1) * (num + den) >= (na + nb) * num
    apart = F.lit(0)
    for k in range(longs):
        apart = apart + F.bit_count(a("sketch").getField(f"s{k}").bitwiseXOR(b("sketch").getField(f"s{k}")))
    alike = (a("held") + b("held") - apart) * (num + den) >= (na + nb) * num * 2
    return length & place & alike


def met(a: DataFrame, b: DataFrame, order: Column, num: Column, den: int, tasks: int) -> DataFrame:
    """(grp, a, b) of pairs of posts a and b (aliases) of one token in that order that can reach the similarity, each pair once, written.

    What is held of the sizes, of the places and of the sketches (a bit that differs is a token that differs) costs a few operations on longs. The posts of a
    frequent token are dealt: each of a is in one part, and each of b in all, so that no task has all pairs of a token."""
    col = lambda side, name: F.col(f"{side}.{name}")
    deal = lambda df: df.repartition(tasks, "grp", "token", "part")
    a = deal(a.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))).alias("a")
    b = deal(b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))).alias("b")
    same = (col("a", "grp") == col("b", "grp")) & (col("a", "token") == col("b", "token")) & (col("a", "part") == col("b", "part"))
    # all stands in the condition of the join, as Spark would ask a later filter first
    found = a.join(b, same & order & can_reach(lambda name: col("a", name), lambda name: col("b", name), num, den)).select(col("a", "grp").alias("grp"), col("a", "id").alias("a"), col("b", "id").alias("b"))
    return materialized(found.distinct(), "met")


def reached(pairs: DataFrame, sets: DataFrame, den: int) -> DataFrame:
    """(grp, a, b, both, sizes) of pairs(grp, a, b) that reach the similarity, by their whole sets.

    Sets are joined by a shuffle whatever their file's size, as they are much larger in memory."""
    side = lambda k: sets.select("grp", F.col("id").alias(k), F.col("num").cast("long").alias(f"num_{k}"), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}")).hint("merge")
    both, sizes = F.size(F.array_intersect("t_a", "t_b")), F.col("n_a") + F.col("n_b")
    whole = pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"]).where(both * (F.col("num_a") + den) >= sizes * F.col("num_a"))
    return whole.select("grp", "a", "b", both.alias("both"), sizes.alias("sizes"))


def compared(a: DataFrame, b: DataFrame, order: Column, num: Column, den: int, tasks: int, rounds: int, sets: DataFrame) -> DataFrame:
    """`reached` of what `met` leaves of the posts a and b.

    Pairs grow with the square of the items, so where there are many a share of the items of a is met in each round, and what only may be similar is deleted after it:
    on disk are posts, the candidates of a round and what reaches the similarity."""
    if rounds > 1 and a is not b:
        n = lambda df, name: df.groupBy("grp", "token").agg(F.count("*").alias(name))
        pairs = n(a, "na").join(n(b, "nb"), ["grp", "token"]).agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0
        rounds = rounds_of(pairs, a.count() + b.count())
    if rounds == 1:
        return reached(met(a, b, order, num, den, tasks), sets, den)
    a, b = (df.withColumn("parts", F.ceil(F.col("parts") / rounds)) for df in (a, b))
    out = None
    for r in range(rounds):
        since = mark()
        found = settled(reached(met(a.where(F.pmod(F.xxhash64("id", F.lit(rounds)), F.lit(rounds)) == r), b, order, num, den, tasks), sets, den), "reached", since)
        out = found if out is None else out.union(found)
    return out


def similarity_edges(items: DataFrame, num: int | None, den: int) -> DataFrame:
    """(grp, a, b, both, either) of pairs of items(grp, id, tokens) in one group with |A & B| / |A | B| >= num / den, a < b.

    Only sets that share a token of their prefixes are met, and what their sizes, places and sketches leave is compared by whole sets. Items without tokens have no
    edge. Equal ids must not repeat in a group. Without num each group has its own, in a column `num` of the items.
    """
    sets = numbered(items, num)
    posts, tasks, rounds = narrow(sets, den)
    pairs = compared(posts, posts, F.col("a.id") < F.col("b.id"), F.col("a.num").cast("long"), den, tasks, rounds, sets)
    return pairs.select("grp", "a", "b", "both", (F.col("sizes") - F.col("both")).cast("int").alias("either"))


#: Characters of the grams whose hashes pick the places of a text.
GRAM = 8


def winnowed(items: DataFrame, length: int = 15, gram: int = GRAM) -> DataFrame:
    """(grp, id, print, piece) of items(grp, id, text): each substring of `length` characters lies in a piece whose print its own grams determine.

    A substring's print is the smallest hash of its grams; neighbours mostly have the same one, and come as one piece. So two
    texts that share the substring share the print (winnowing), and a text is written as about 2 / (length - gram + 2) rows a character."""
    m = length - gram + 1
    rows = items.where(F.char_length("text") >= length).select("grp", "id", F.split("text", "").alias("c"))
    n = F.size("c")
    hashes = F.transform(F.sequence(F.lit(1), n - gram + 1), lambda i: F.xxhash64(F.slice("c", i, F.lit(gram))))
    least = x.let(hashes, lambda h: F.transform(F.sequence(F.lit(1), n - length + 1), lambda s: F.array_min(F.slice(h, s, F.lit(m)))))
    rows = rows.select("grp", "id", "c", least.alias("least"))
    first = F.filter(F.sequence(F.lit(1), F.size("least")), lambda s: (s == 1) | (F.get("least", s - 1) != F.get("least", s - 2)))
    runs = x.let(first, lambda f: F.transform(f, lambda s, i: F.struct(F.get("least", s - 1).alias("print"), s.alias("s"), F.coalesce(F.get(f, i + 1) - 1, F.size("least")).alias("e"))))
    rows = rows.select("grp", "id", "c", F.explode(runs).alias("r"))
    return rows.select("grp", "id", "r.print", F.array_join(F.slice("c", F.col("r.s"), F.col("r.e") - F.col("r.s") + length), "").alias("piece"))


#: Characters that a task takes of groups that it holds whole, longs in the sketches there, characters of a cut text, and the first ones of a substring of which a blank marks a place in it.
TASK, FEW, CUT, MARK = 1_500_000, 2, 128, 6


def pairs_within(items: DataFrame, num: int, den: int) -> DataFrame:
    """(grp, a, b), a < b, of pairs that can reach the similarity, of items(grp, id, tokens) that are dealt by grp: all is found inside the tasks, and nothing more is shuffled.

    As in `similarity_edges` the tokens that others of the group hold too stand rarest first, and posts of the prefixes are met by sizes, places and sketches."""
    each = items.select("grp", "id", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    each = each.withColumn("often", F.count("*").over(Window.partitionBy("token", "grp"))).where("often > 1")
    sets = each.groupBy("grp", "id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("l")).select("grp", "id", F.lit(num).cast("long").alias("num"), "n", F.col("l.token").alias("tokens"))
    sketch = F.struct(*(w.alias(f"s{k}") for k, w in enumerate(x.sketch(F.col("tokens"), FEW))))
    posts = posts_of(sets.withColumn("sketch", sketch), den)
    lists = posts.groupBy("token", "grp").agg(F.collect_list(F.struct("id", "n", "held", "pos", "sketch")).alias("l")).where(F.size("l") > 1)
    one = F.col("one")
    near = F.filter("l", lambda b: (b.getField("id") > one.getField("id")) & can_reach(one.getField, b.getField, F.lit(num).cast("long"), den, FEW))
    met = lists.select("grp", "l", F.explode("l").alias("one")).select("grp", "one.id", F.explode(near).alias("other"))
    return met.select("grp", F.col("id").alias("a"), F.col("other.id").alias("b")).distinct()


def marked_pieces(items: DataFrame, length: int = 15) -> DataFrame:
    """(grp, id, print, piece) of items(grp, id, text): each substring of `length` characters lies in a piece whose print is a hash of what all copies of it hold too.

    Either a blank is among its first MARK characters, then one of its pieces is that of the blank, with the print of what surely follows inside the substring; or
    there is none, then it is a piece and its print is its own. Long texts are cut, with overlaps, as places are counted from the start."""
    k = min(MARK, length)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - length) / CUT).cast("int")), lambda c: F.substring(F.col("text"), c * CUT + 1, F.lit(CUT + length - 1)))
    rows = items.where(F.char_length("text") >= length).select("grp", "id", F.explode(cuts).alias("cut"))
    rows = rows.select("grp", "id", "cut", F.explode(F.sequence(F.lit(1), F.char_length("cut"))).alias("p"))
    cut, p = F.col("cut"), F.col("p")
    blank = F.substring(cut, p, F.lit(1)) == " "
    own = ~blank & (F.instr(F.substring(cut, p, F.lit(k)), " ") == 0)
    rows = rows.where(blank | own)
    surely = F.xxhash64(F.substring(cut, p, F.when(blank, length + 1 - k).otherwise(length)))
    piece = F.substring(cut, F.when(blank, F.greatest(p - k + 1, F.lit(1))).otherwise(p), F.when(blank, F.least(p, F.lit(k)) + length - 1).otherwise(length))
    return rows.select("grp", "id", surely.alias("print"), piece.alias("piece")).where(F.char_length("piece") >= length)


def shared_substrings(items: DataFrame, length: int = 15) -> DataFrame:
    """(grp, key, id): for items(grp, id, text) the substrings of that length that others of their group hold too; who shares a key is a neighbour.

    Only pieces whose print several items of the group have are cut into their substrings. Pieces and substrings are each shuffled once, to their prints and
    keys, and by nothing more if items are dealt by grp: then all is found inside the tasks."""
    near = several(marked_pieces(items, length), "print")
    places = F.sequence(F.lit(1), F.char_length("piece") - length + 1)
    keys = near.select("grp", "id", "piece", F.explode(places).alias("p")).select("grp", F.substring(F.col("piece"), F.col("p"), F.lit(length)).alias("key"), "id")
    return several(keys, "key").distinct().select("grp", "key", "id")


def several(rows: DataFrame, key: str) -> DataFrame:
    """The rows(grp, id, ..) of a key that several items of a group have."""
    same = Window.partitionBy(key, "grp")
    return rows.withColumns({"_a": F.min("id").over(same), "_b": F.max("id").over(same)}).where("_a <> _b").drop("_a", "_b")


def edge_keys(edges: DataFrame) -> DataFrame:
    """edges(grp, a, b) as keys that their two ends share."""
    key = F.concat_ws("\u0001", F.least(F.col("a").cast("string"), F.col("b").cast("string")), F.greatest(F.col("a").cast("string"), F.col("b").cast("string")))
    return edges.where("a <> b").select("grp", key.alias("key"), F.explode(F.array("a", "b")).alias("id"))


def greedy_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`greedy_leaders_by_keys` with edges(grp, a, b), which have no direction."""
    return greedy_leaders_by_keys(nodes, edge_keys(edges))


def greedy_leaders_by_keys(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(grp, id, leader) of nodes(grp, id, ord) under the sequential rule: in order, a node is a leader unless it is a
    neighbour of an earlier leader; then it belongs to the earliest of them. Nodes that share one of keys(grp, key, id) are neighbours.

    Rounds: a node that is first in all its keys leads; who shares a key with it is a member; both are closed. A key of n nodes
    costs n rows and not its pairs, and only minima are aggregated, so a hot key is no hot task. Few rounds are enough for orders
    that are not adversarial. Ties of ord are broken by id.
    """
    place = nodes.select("grp", "id", F.struct("ord", "id").alias("place"))
    every = materialized(keys.select("grp", "key", "id").distinct().join(place, ["grp", "id"]), "keys")
    left, members = every, None
    while True:
        first = left.groupBy("grp", "key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
        left = materialized(left.join(first, ["grp", "key"]).select("grp", "key", "id", "place", "first"), "open")
        leads = left.groupBy("grp", "id").agg(F.bool_and(F.col("place") == F.col("first")).alias("leads")).where("leads").select("grp", "id")
        led = left.where("place = first").join(leads, ["grp", "id"], "left_semi").select("grp", "key").distinct()
        closed = materialized(left.where("place <> first").join(led, ["grp", "key"], "left_semi").select("grp", "id").distinct(), "members")
        if closed.isEmpty():
            break
        members = closed if members is None else members.union(closed)
        left = left.join(closed.union(leads), ["grp", "id"], "left_anti").select("grp", "key", "id", "place")
    if members is None:
        return nodes.select("grp", "id", F.col("id").alias("leader"))
    heads = every.join(members, ["grp", "id"], "left_anti").groupBy("grp", "key").agg(F.min("place").alias("head"))
    earliest = every.join(members, ["grp", "id"], "left_semi").join(heads, ["grp", "key"]).groupBy("grp", "id").agg(F.min("head").alias("head"))
    return nodes.select("grp", "id").join(earliest, ["grp", "id"], "left").select("grp", "id", F.coalesce("head.id", "id").alias("leader"))


def by_class(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items(grp, id, ord, tokens) with equal token sets as one: the earliest of each set, and (grp, id, first) of all.

    The later ones have the neighbours of the first, so they share its leader; large groups of copies make no pairs."""
    keyed = items.withColumn("key", F.array_sort(F.array_distinct("tokens")))
    first = keyed.where(F.size("key") > 0).groupBy("grp", "key").agg(F.min(F.struct("ord", "id")).alias("f"))
    classes = first.select("grp", F.col("f.id").alias("id"), F.col("f.ord").alias("ord"), F.col("key").alias("tokens"))
    members = keyed.join(first, ["grp", "key"], "left").select("grp", "id", F.coalesce("f.id", "id").alias("first"))
    return classes, members


#: Rounds in which leaders gather their members before what is left is compared, and pairs for each post that make no further round worth it.
ROUNDS, PAIRS = 8, 20


def gathered(posts: DataFrame, sets: DataFrame, leads: DataFrame, open_: DataFrame, den: int, tasks: int, rounds: int) -> DataFrame:
    """(grp, id, head) of open items that are similar to one of the leads, from sets of `numbered` and their posts with a place."""
    heads = posts.join(leads, ["grp", "id"], "left_semi")
    own = posts.join(open_, ["grp", "id"], "left_semi")
    found = compared(own, heads, F.col("a.place") > F.col("b.place"), F.col("a.num").cast("long"), den, tasks, rounds, sets)
    return found.select("grp", F.col("a").alias("id"), F.col("b").alias("head"))


def leaders_by_tokens(items: DataFrame, num: int, den: int) -> DataFrame:
    """(grp, id, leader) of items(grp, id, ord, tokens): greedy leaders at that Jaccard similarity, by the sequential rule of `greedy_leaders_by_keys`.

    Only leaders post their prefixes. In a round an open item leads if it is first among the open ones for every token of
    its prefix, as no earlier one can be similar to it; the items that are similar to it are closed as members. So a leader of n items that
    differ in a word costs n rows and not their pairs. After ROUNDS rounds, or once the open items would make few pairs or a round took less than a tenth of them, these are made of the rest only;
    there a round decides at least every second item of a chain, and `greedy_leaders` works on shared keys. At last each member finds the earliest
    of its leaders among the posts of leaders."""
    classes, members = by_class(items)
    classes = materialized(classes, "classes")
    place = classes.select("grp", "id", F.struct("ord", "id").alias("place"))
    sets = numbered(classes, num)
    posts, tasks, rounds = narrow(sets, den)
    posts = materialized(posts.join(place, ["grp", "id"]), "posts")
    open_, leaders, before = materialized(place.select("grp", "id"), "open"), None, None
    for _ in range(ROUNDS):
        own = posts.select("grp", "id", "token", "place").join(open_, ["grp", "id"], "left_semi")
        n = F.col("count").cast("double")
        size, pairs = own.groupBy("grp", "token").count().agg(F.coalesce(F.sum(n), F.lit(0.0)), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()
        if pairs <= PAIRS * size or (before is not None and pairs > 0.9 * before):
            break
        before = pairs
        first = own.groupBy("grp", "token").agg(F.min("place").alias("first"))
        leads = own.join(first, ["grp", "token"]).groupBy("grp", "id").agg(F.bool_and(F.col("place") == F.col("first")).alias("leads")).where("leads").select("grp", "id")
        leads = materialized(leads, "leads")
        closed = gathered(posts, sets, leads, open_, den, tasks, rounds).select("grp", "id").distinct()
        leaders = leads if leaders is None else leaders.union(leads)
        open_ = materialized(open_.join(leads.union(closed), ["grp", "id"], "left_anti"), "open")
    rest = classes.join(open_, ["grp", "id"], "left_semi")
    led = greedy_leaders(rest.select("grp", "id", "ord"), similarity_edges(rest, num, den))
    last = led.where("id = leader").select("grp", "id")
    leaders = materialized(last if leaders is None else leaders.union(last), "leaders")
    follow = classes.select("grp", "id").join(leaders, ["grp", "id"], "left_anti")
    lead = place.select("grp", F.col("id").alias("head"), F.col("place").alias("lead"))
    earliest = gathered(posts, sets, leaders, follow, den, tasks, rounds).join(lead, ["grp", "head"]).groupBy("grp", "id").agg(F.min("lead").alias("lead")).select("grp", F.col("id").alias("first"), F.col("lead.id").alias("leader"))
    return members.join(earliest, ["grp", "first"], "left").select("grp", "id", F.coalesce("leader", "first").alias("leader"))


def link_counts(items: DataFrame, num: int, den: int) -> DataFrame:
    """(grp, id, first, links) of items(grp, id, ord, tokens): the first item with the same tokens, and how many other items reach that similarity.

    Pairs are made of classes only, so n equal items cost n rows."""
    classes, members = by_class(items)
    classes, members = materialized(classes, "classes"), materialized(members, "class-members")
    size = members.groupBy("grp", "first").agg(F.count("*").alias("size"))
    pairs = similarity_edges(classes, num, den).select("grp", "a", "b")
    both = pairs.union(pairs.select("grp", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size.withColumnRenamed("first", "b"), ["grp", "b"]).groupBy("grp", F.col("a").alias("first")).agg(F.sum("size").alias("near"))
    links = F.coalesce("near", F.lit(0)) + F.col("size") - 1
    return members.join(size, ["grp", "first"]).join(near, ["grp", "first"], "left").select("grp", "id", "first", links.alias("links"))
