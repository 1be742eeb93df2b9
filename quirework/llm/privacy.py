r"""Information-theoretic sanitisation of personal data.

Four kinds of personal data are found by pattern and check: email, ip, card, phone. Each distinct
value is an entity to protect. Removing the value alone may not hide it: a term that the
corpus ties closely to an entity still tells who is meant. How strongly it does is
measured on all documents,

    information  IC(e) = -log2 p(e)             p: share of the documents that hold it
    disclosure   PMI(t; e) / IC(e)              PMI = log2 p(t | contexts of e) / p(t)

which is 1 when the term names the entity outright. The contexts of an entity are the whole
documents that hold it. Documents of the same words (copies), and versions of one document (four fifths
of their words shared, :func:`versions`), are one context, so what they share by descent counts once.

A term is believed only against chance. A document holds rare words anyway: M(n) of them on
average are in no more than n documents, counted over the corpus. Of the c M(n) such words in the
contexts of an entity, this many would be in k of the c by chance

    E = c M(n) exp(-(c - 1) KL((k - 1) / (c - 1) || n / N))

(all of them, if k = 1), and a term counts only where E is at most ``DOUBT``. So a word that
one shared document happens to hold tells nothing in a corpus of ordinary prose, however
large it grows, and a name that keeps turning up beside an entity does from the second or third context on.

A term whose disclosure reaches ``GENERALISE`` is sanitised in the documents that hold the
entity: replaced by its class (name, number or word), or removed where disclosure reaches
``REMOVE``. Its places are spans of the further kind ``term``; spans of the four kinds always stay.

Terms are words of ``SHORTEST`` characters or more with a letter, and words joined by hyphens or apostrophes,
which count as a whole and by their parts. Entities of the same documents have the same
terms and are counted as one, so a list of many entities costs no more than its words; counts
are aggregated by entity and term before any join. The only joins are on equal entities, terms
and documents. Texts move only for documents that may hold a term to sanitise.

Defined results: a null or empty text has no spans; offsets count code points, ends are
exclusive; repeated rows are treated alike and count as documents; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.settle import discard, settle
from . import bitmap

# The patterns. Possessive forms and the bound at a run's start only keep the
# search linear; card is the same as matching whole runs and dropping those of another size.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_PART = r"[\p{L}\p{M}\p{N}]++"
_JOINED = rf"{_PART}(?:[-']{_PART})++"
DOUBT, GENERALISE, REMOVE, SHORTEST = 0.05, 0.6, 0.9, 2
ALIKE, BANDS, BAND_ROWS = 0.8, 8, 3
RARITY = 1.1  # counts of documents are told apart by this factor
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def worth(c: Column, i: Column) -> Column:
        d = F.when(c == "", 0).otherwise(c.cast("int")) * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    worths = F.transform(F.split(digits, ""), worth)
    return F.aggregate(worths, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def located(kind: str, text: Column, pattern: Column, found: Column) -> Column:
    """Spans of the matches ``found`` of a pattern: lengths of the text between them, and of
    the matches themselves, add up to their places."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))

    def take(done: Column, x: Column) -> Column:
        start = done["end"] + F.length(x["gap"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))
        return F.struct((start + F.coalesce(F.length(x["value"]), F.lit(0))).alias("end"), F.concat(done["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN).alias("spans"))
    spans = F.aggregate(both, start, take, lambda done: F.filter(done["spans"], lambda s: s["value"].isNotNull()))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with a text that is not null) plus ``base``, spans by kind and then start."""
    may = {"email": F.contains(F.col("text"), F.lit("@")), "phone": F.contains(F.col("text"), F.lit("+"))}
    none = F.array().cast("array<string>")
    matches = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    found = docs.select("*", *[(F.when(may[k], m).otherwise(none) if k in may else m).alias(f"found_{k}") for k, m in matches.items()])
    checked = lambda kind: lambda s: valid(kind, s["value"])
    spans = [F.filter(located(k, F.col("text"), F.lit(p), F.col(f"found_{k}")), checked(k)) for k, p in PATTERNS.items()]
    return found.select(*docs.columns, F.concat(*spans).alias("base"))


def _source(documents: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), *more, F.xxhash64("doc_id", text).alias("row_key"))


def plain(text: Column) -> Column:
    """In lower case, with typographic apostrophes and hyphens as plain ones."""
    return F.translate(F.lower(text), "\u2019\u02bc\u2010\u2011", "''--")


def words(text: Column) -> Column:
    """Distinct words with a letter, and words joined by hyphens or apostrophes, in lower case."""
    found = F.concat(*[F.regexp_extract_all(plain(text), F.lit(p), F.lit(0)) for p in (_PART, _JOINED)])
    return F.filter(F.array_distinct(found), lambda w: (F.length(w) >= SHORTEST) & F.regexp_like(w, F.lit(r"\p{L}")))


def entities(docs: DataFrame) -> DataFrame:
    """Rows (row_key, base, held, terms, context) of the documents with spans: their entities, the
    words outside of the spans, and a key of these words."""
    spans = base_spans(docs).where(F.size("base") > 0)
    held = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    terms = words(masked(F.col("text"), F.col("base"), lambda s: F.lit(" ")))
    return spans.select("row_key", "base", held.alias("held"), terms.alias("terms")).withColumn("context", F.xxhash64(F.array_sort("terms")))


def versions(contexts: DataFrame) -> DataFrame:
    """(context, version) of (context, terms): contexts of which ``ALIKE`` of the words, or more,
    are those of an earlier one with the same least hashes in some band count as that one."""
    def band(b: int) -> Column:
        least = [F.array_min(F.transform("terms", lambda t, i=b * BAND_ROWS + j: F.xxhash64(t, F.lit(i)))) for j in range(BAND_ROWS)]
        return F.xxhash64(F.lit(b), *least)

    banded = settle(contexts.where(F.size("terms") > 0).select("context", "terms", F.explode(F.array(*[band(b) for b in range(BANDS)])).alias("band")))
    first = banded.groupBy("band").agg(F.min("context").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.join(banded.select("band", F.col("context").alias("first"), F.col("terms").alias("own")), ["band", "first"])
    both = F.size(F.array_intersect("terms", "own"))
    near = banded.join(first, "band").where((F.col("context") != F.col("first")) & (both >= ALIKE * (F.size("terms") + F.size("own") - both)))
    to = settle(near.groupBy("context").agg(F.min("first").alias("version")))
    again = to.select(F.col("context").alias("version"), F.col("version").alias("further"))
    out = settle(contexts.select("context").join(to, "context", "left").join(again, "version", "left").select(
        "context", F.coalesce("further", "version", "context").alias("version")))
    discard(banded, to)
    return out


def alike(found: DataFrame) -> DataFrame:
    """Rows (entity, row_key, context): of the entities that the same documents hold, the least."""
    each = found.select("row_key", "context", F.explode("held").alias("entity")).distinct()
    sets = each.groupBy("entity").agg(
        F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row_key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("row_key", F.lit(2))).alias("y"),
    ).groupBy("n_e", "x", "y").agg(F.min("entity").alias("entity"))
    return each.join(sets.select("entity"), "entity", "left_semi")


def rarity(n: Column) -> Column:
    return F.ceil(F.log(n) / F.log(F.lit(RARITY)))


def by_chance(k: Column, c: Column, n: Column, total: Column, rare: Column) -> Column:
    """How many words as rare as one of ``n`` documents would be in ``k`` of ``c`` contexts by chance,
    where a document holds ``rare`` of them on average."""
    share, p = (k - 1) / (c - 1), n / total
    some = F.when(share > 0, share * F.log(share / p)).otherwise(0.0)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    return c * rare * F.when((k > 1) & (share > p), F.exp(-(c - 1) * (some + rest))).otherwise(1.0)


def disclosures(docs: DataFrame, found: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (entity, term, disclosure) of the terms to sanitise; ``found`` and ``held`` are settled and
    have their versions as contexts."""
    per_entity = held.groupBy("entity").agg(F.count("*").alias("n_e"), F.count_distinct("context").alias("contexts"))
    terms = found.groupBy("context").agg(F.min("terms").alias("terms"))
    pairs = (
        held.select("entity", "context").distinct().join(terms, "context")
        .select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    )
    # Counted per task first, so what is shuffled is one row per task and term.
    spread = settle(docs.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")))
    whole = docs.agg(F.count("*").alias("n")).first()["n"]
    total = F.lit(float(max(1, whole)))
    # A few hundred rows: how many words of at most this many documents a document holds.
    counts = spread.groupBy(rarity(F.col("n_t")).alias("rarity")).agg(F.sum("n_t").alias("uses"))
    rare = counts.select("rarity", (F.sum("uses").over(Window.orderBy("rarity")) / total).alias("rare"))
    told = F.log2(F.col("n_te") / F.col("contexts") * total / F.col("n_t")) / F.log2(total / F.col("n_e"))
    likely = pairs.join(per_entity.where(F.col("n_e") < whole), "entity").join(spread, "term").withColumn("disclosure", told)
    likely = likely.where(F.col("disclosure") >= GENERALISE).withColumn("rarity", rarity(F.col("n_t"))).join(rare, "rarity")
    chance = by_chance(F.col("n_te"), F.col("contexts"), F.col("n_t"), total, F.col("rare"))
    return likely.where(chance <= DOUBT).select("entity", "term", "disclosure")


def find(documents: DataFrame, *more: str) -> DataFrame:
    """Rows (doc_id, text, more columns, base, terms): spans of the four kinds, and of terms
    with the measure that chose them (``disclosure`` by term in ``told``)."""
    docs = _source(documents, *more)
    read = settle(entities(docs))
    same = versions(read.groupBy("context").agg(F.min("terms").alias("terms")))
    found = settle(read.join(same, "context").select("row_key", "held", "terms", F.col("version").alias("context")))
    held = settle(alike(found))
    telling = settle(disclosures(docs, found, held))
    by_row = held.select("row_key", "entity").join(telling, "entity").groupBy("row_key", "term").agg(F.max("disclosure").alias("d")).groupBy(
        "row_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("told"))
    # Only these documents meet anything; the spans of all others are known to be none.
    spans = settle(read.select("row_key", "base").dropDuplicates(["row_key"]).join(by_row, "row_key", "left"))
    discard(read, same, found, held, telling)
    split = bitmap.marked(docs, "row_key", spans, "row_key")
    none = F.array().cast(SPAN)
    touched = split.where("maybe").drop("maybe").join(spans, "row_key", "left").withColumn("base", F.coalesce("base", none))
    longest = F.array_sort(F.map_keys("told"), lambda a, b: F.length(b) - F.length(a))
    either = F.replace(F.replace(F.array_join(longest, "|"), F.lit("'"), F.lit("['\u2019\u02bc]")), F.lit("-"), F.lit("[\\x{2d}\u2010\u2011]"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    hits = F.regexp_extract_all("text", pattern, F.lit(0))
    terms = F.when(F.col("told").isNull(), none).otherwise(located("term", F.col("text"), pattern, hits))
    columns = ["doc_id", "text", *more, "base"]
    nothing = F.map_from_entries(F.array().cast("array<struct<term:string,d:double>>"))
    untouched = split.where("not maybe").select("doc_id", "text", *more, none.alias("base"), none.alias("terms"), nothing.alias("told"))
    return touched.select(*columns, terms.alias("terms"), F.coalesce("told", nothing).alias("told")).unionByName(untouched)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, label) -> Column:
    """The text with ``label`` of a span for it; overlapping spans are one, with the label of the
    first (then the longest)."""
    spans = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
    )

    def joined(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["value"].alias("value"))
        overlaps = (F.size(done) > 0) & (s["start"] < last["end"])
        return F.when(overlaps, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    kept = F.aggregate(spans, F.array().cast(SPAN), joined)
    ends = F.concat(F.array(F.lit(0)), F.transform(kept, lambda s: s["end"]))
    parts = F.transform(kept, lambda s, i: F.concat(F.substring(text, F.get(ends, i) + 1, s["start"] - F.get(ends, i)), label(s)))
    tail = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), tail))


def kind(value: Column) -> Column:
    """The class that a term is generalised to, told by its form."""
    return F.when(F.regexp_like(value, F.lit(r"\p{N}")), "[NUMBER]").when(F.regexp_like(value, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[WORD]")


def sanitised(text: Column, base: Column, terms: Column, told: Column) -> Column:
    """The text with labels for spans."""

    def label(s: Column) -> Column:
        removed = F.element_at(told, plain(s["value"])) >= REMOVE
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(removed, "").otherwise(kind(s["value"]))

    return masked(text, F.concat(base, terms), label)
