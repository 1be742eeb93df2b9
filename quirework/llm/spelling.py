"""Spelling variants: words one edit apart, and the frequent form that a rare one points to.

All words stand in a trie that is a Spark table of edges. Words of one length have a subtree
of their own (the length is the first step from the root), so a search for words of the same
length looks for one replaced character and a search for words one shorter for one deleted
character; insertions are the deletions seen from the longer word. Edges are path-compressed:
an edge (node, label, child) leads to the next place where words part or end, or where a search
starts, so the number of rounds follows the branchings of the trie, not the length of words.

A frontier of states (word, position, node, edits) walks down level by level, one join with
the edge table a round. The one edit lies in the front or in the back half of a word. Words are
searched in a trie of words, starting behind their exact front half, and in a trie of reversed
words, starting behind their exact back half; so no search begins at the root, where nearly
every edit survives. A state without an edit takes an edge whose label follows exactly, or with
one edit inside the label, which gives the target word; a state with its edit takes exact
edges only. States that reach the end of their target with one edit are pairs of neighbours.

Edges are distinct rows: a node has at most as many as there are characters, whatever the
number of words below it. Nodes are hashes of (length, prefix). Should two hashes meet, edges
are added, none is lost, and the last join with the table of words is on the words themselves.

Defined results: null and empty texts have no words; a word table that repeats a word is
summed; words without a near word have ``n_near`` 0, no form and themselves as root; of near
words of equal count the smallest in code-point order is the form; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import FEW, dealt, discard, settle

#: The letters one by one: a class of single characters is looked up in a table.
LETTER = "[" + "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)])) + "]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(documents: DataFrame, *more: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows (more columns, run), one for every maximal run of letters of enough length of every
    text, with A to Z in lower case."""
    # A search from the left meets a run at its first letter and takes it to its end.
    pattern = LETTER * least_length + f"{LETTER}*+"
    found = documents.select(*more, F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("run"))
    plain = F.length("run") == F.octet_length("run")
    return found.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", CAPITALS, SMALL)))


def vocabulary(found: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n) of a column ``word``: the distinct words of enough length and count."""
    # The length is looked at in the count: a filter would be moved below it and make every word twice.
    n = F.count_if(F.length("word") >= least_length).alias("n")
    return found.groupBy("word").agg(n).where(F.col("n") >= max(least_count, 1))


def node(length: Column, prefix: Column) -> Column:
    return F.xxhash64(length, prefix)


def edges(words: DataFrame, half: Column, least_half: int) -> DataFrame:
    """The trie of a column ``word`` as distinct rows (node, label, child, heads): ``heads`` are the
    characters with which words go on behind the child.

    A prefix is a node where a word ends, where a search starts (``half`` code points of some
    word that looks for this length), or where fewer words go on than came here."""
    size = F.length("word")
    prefixes = words.select("word", size.alias("size"), F.posexplode(
        F.transform(F.sequence(F.lit(least_half), size), lambda i: node(size, F.substring(F.col("word"), F.lit(1), i)))
    ).alias("step", "node")).withColumn("pos", F.col("step") + least_half).drop("step")
    # A word is looked for by words of its own length and by those one longer.
    starts = words.select(node(size - 1, F.substring(F.col("word"), F.lit(1), half)).alias("node"), F.lit(0).alias("n"), F.lit(1).alias("start"))
    own = F.when(F.col("pos") == half, 1).otherwise(0)
    counted = prefixes.select("node", F.lit(1).alias("n"), own.alias("start")).unionByName(starts)
    counted = counted.groupBy("node").agg(F.sum("n").alias("n"), F.max("start").alias("start")).where("n > 0")
    path = prefixes.join(dealt(counted), "node").groupBy("word", "size").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "n", "start"))).alias("path"))
    stops = F.filter("path", lambda p, i: (p["start"] == 1) | (p["pos"] == F.col("size")) | (F.get(F.col("path"), i + 1)["n"] != p["n"]))
    kept = path.select("word", stops.alias("stops"))
    steps = F.transform(F.slice("stops", 2, F.size("stops")), lambda p, i: F.struct(
        F.get(F.col("stops"), i)["node"].alias("node"),
        F.substring(F.col("word"), F.get(F.col("stops"), i)["pos"] + 1, p["pos"] - F.get(F.col("stops"), i)["pos"]).alias("label"),
        p["node"].alias("child"),
    ))
    found = settle(kept.where(F.size("stops") > 1).select(F.explode(steps).alias("e")).select("e.*").distinct())
    heads = found.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("heads"))
    return found.join(dealt(heads), "child", "left").select("node", "label", "child", F.coalesce("heads", F.lit("")).alias("heads"))


def step(states: DataFrame, trie: DataFrame) -> DataFrame:
    """The states one edge further. ``shorter`` is the number of characters that the target has
    less than the word; ``target`` is null before the edit."""
    at = states.join(trie, "node")
    k, rest = F.length("label"), F.substring(F.col("word"), F.col("pos") + 1, F.length("word"))
    exact = rest.startswith(F.col("label"))
    part = k + F.col("shorter")
    # As many characters of the word as the label has, or one more, are one edit away from it.
    near = F.levenshtein(F.substring(F.col("word"), F.col("pos") + 1, part), F.col("label"), 1) == 1
    moved = F.concat(F.substring(F.col("word"), F.lit(1), F.col("pos")), F.col("label"), F.substring(F.col("word"), F.col("pos") + part + 1, F.length("word")))
    # Words of one length find each other; the smaller one does it for both.
    edited = F.col("target").isNull() & (F.length(rest) >= part) & near & ((F.col("shorter") == 1) | (moved > F.col("word")))
    ahead = lambda n, target: F.struct((F.col("pos") + n).alias("pos"), target.alias("target"))
    moves = F.array(F.when(exact, ahead(k, F.col("target"))), F.when(edited, ahead(part, moved)))
    # Most edges lead nowhere; they go before anything is made of them.
    out = at.where(exact | edited).select("word", "shorter", "child", "heads", F.explode(F.array_compact(moves)).alias("m"))
    out = out.select("word", "shorter", F.col("child").alias("node"), "heads", "m.pos", "m.target")
    # A state goes on if its next character does here; before the edit any will do.
    size, ahead_of = F.length("word"), F.contains(F.col("heads"), F.substring(F.col("word"), F.col("pos") + 1, F.lit(1)))
    unedited = (F.col("heads") != "") | ((F.col("shorter") == 1) & (F.col("pos") == size - 1))
    return out.where(F.when(F.col("target").isNull(), unedited).otherwise((F.col("pos") == size) | ahead_of)).drop("heads")


def halves(words: DataFrame, half: Column, least_half: int) -> DataFrame:
    """Pairs (word, target) whose edit stands behind the first ``half`` characters."""
    trie = settle(edges(words, half, least_half))
    wanted = F.explode(F.array(F.lit(0), F.lit(1))).alias("shorter")
    size = F.length("word")
    states = words.select("word", wanted).select(
        "word", "shorter", node(size - F.col("shorter"), F.substring(F.col("word"), F.lit(1), half)).alias("node"),
        half.alias("pos"), F.lit(None).cast("string").alias("target"),
    )
    found, used, few = [], [], False
    ended = F.col("target").isNotNull() & (F.col("pos") == size)
    # The last character of a word may be the deleted one: no edge follows it.
    last = F.col("target").isNull() & (F.col("shorter") == 1) & (F.col("pos") == size - 1)
    while True:
        now = settle(step(states if few else dealt(states), trie))
        used.append(now)
        found.append(now.where(ended).select("word", "target"))
        found.append(now.where(last).select("word", F.substring(F.col("word"), F.lit(1), F.col("pos")).alias("target")))
        states = now.where(~ended & (F.col("pos") < size))
        left = states.limit(FEW + 1).count()
        if not left:
            break
        few = left <= FEW
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = settle(pairs.distinct())
    discard(trie, *used)
    return pairs


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Distinct pairs (word, near), both ways, of words with exactly one edit between them."""
    size = F.length("word")
    front = F.floor(size / 2).cast("int")
    back = (size - front).cast("int")
    forward = halves(words.select("word"), front, least_length // 2)
    backward = halves(words.select(F.reverse("word").alias("word")), back, least_length - least_length // 2)
    targets = forward.unionByName(backward.select(F.reverse("word").alias("word"), F.reverse("target").alias("target"))).distinct()
    pairs = targets.join(dealt(words.select(F.col("word").alias("target"))), "target").select("word", F.col("target").alias("near"))
    both = settle(pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct())
    discard(forward, backward)
    return both


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms are followed to the last one by doubling the steps."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = settle(now.join(dealt(far), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        discard(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group(words: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) to (word, form, root, n, n_near, form_n). A word's form is its most frequent near
    word, if that is at least ``ratio`` times as frequent. All words have ``least_length`` or more."""
    words = settle(words.groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = neighbours(words, least_length)
    counted = near.join(dealt(words.select(F.col("word").alias("near"), "n")), "near").groupBy("word").agg(
        F.min(F.struct((-F.col("n")).alias("rarity"), "near")).alias("best"), F.count("*").alias("n_near")
    )
    rows = settle(words.join(dealt(counted), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.rarity") >= ratio * F.col("n"), F.col("best")).alias("best"),
    ))
    last = roots(rows.where("best IS NOT NULL").select("word", F.col("best.near").alias("form")))
    discard(near, words)
    return rows.join(dealt(last), "word", "left").select(
        "word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.rarity")).alias("form_n"),
    )
