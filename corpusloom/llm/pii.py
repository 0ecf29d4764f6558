"""Information-theoretic sanitisation, in DataFrame expressions only.

Fixed patterns find the protected entities: e-mail addresses, IP addresses, card and
phone numbers.  Then the corpus tells which words give such an entity away even when
it is removed (Sanchez and Batet's disclosure measure): with probabilities estimated
from counts of texts, a word t discloses an entity e to the degree PMI(e; t) / IC(e),
which is 1 if t is found nowhere but with e.  Words above one threshold are replaced
by their shape, above a higher one they are removed.

All counts have one unit, the document, and a word occurs with an entity if it stands
anywhere in the same document.  Thresholds: at 0.75 an intruder who reads the word has
learnt three quarters of the entity's information, so that N ** 0.25 candidates are left of
N; at 0.9 N ** 0.1, a handful.  Two tests keep chance and copies out.  A word must be seen
with the entity so often that this would happen by chance once in a hundred corpora, over all
pairs tested (p(e) ** n against 0.01 / pairs), n being different texts and three at least.  And at least half
of the texts that speak for a pair, and three of them, must differ in a min-hash of their
three-word shingles, which near copies mostly share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, whole_row

# The patterns of the four kinds.  A look-behind keeps a run of characters from
# being tried at each of its places, and possessive loops keep Java from recursing; neither
# changes what the plain pattern finds.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
GENERALISE, REMOVE, SUPPORT, CHANCE, BROADCAST_ROWS = 0.75, 0.9, 3, 0.01, 50_000
WORD = r"[\p{L}\p{N}]++"
SPAN = "struct<kind:string,start:int,stop:int,value:string>"


def prefix_sums(numbers: Column, run: int = 256) -> Column:
    """Running totals of an array<int>, in two levels so that long arrays don't cost their square."""

    def running(a: Column) -> Column:
        return F.aggregate(a, F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("all")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["all"], F.array(acc["s"] + x)).alias("all")), lambda acc: acc["all"])

    def joined(runs: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), running(F.transform(runs, lambda r: F.element_at(r, -1))))
        return let(before, lambda b: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.get(b, i)))))

    cut = lambda a: F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / run).cast("int")), lambda i: running(F.slice(a, i * run + 1, run)))
    return let(numbers, lambda a: F.when(F.size(a) > 0, let(cut(a), joined)).otherwise(F.array().cast("array<int>")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(text: Column, pattern: str, kind: str, wanted: Callable[[Column], Column], may: Column | None = None) -> Column:
    """array<SPAN> of a pattern's leftmost matches whose value is ``wanted``; texts that ``may`` not match aren't searched.

    The pieces between matches and the matches themselves are cut by the same search, so
    their lengths alternate and add up to the positions (code points, ``stop`` exclusive).
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        lengths = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.array(F.length(gap), F.coalesce(F.length(m), F.lit(0)))))
        span = lambda sums: F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), F.get(sums, 2 * i).alias("start"), F.get(sums, 2 * i + 1).alias("stop"), m.alias("value")))
        return F.when(F.size(found) > 0, let(prefix_sums(lengths), lambda sums: F.filter(span(sums), lambda s: wanted(s["value"])))).otherwise(none)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return found if may is None else F.when(may, found).otherwise(none)


def _luhn(digits: Column) -> Column:
    def term(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(value, "[.]"), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds the column _base: the spans of all kinds in the order of the kinds, then by start."""
    column = F.col(text)
    may = {k: column.contains(h) if h == "@" else column.rlike(h) for k, h in HINTS.items()}
    return docs.withColumn("_base", F.concat(*(matches(column, p, k, lambda v, k=k: _valid(k, v), may[k]) for k, p in KINDS.items())))


def words_of(text: Column) -> Column:
    """The words of a text, in order and lower case: three letters or more, none from an e-mail address."""
    plain = F.when(text.contains("@"), F.regexp_replace(text, KINDS["email"], " ")).otherwise(text)
    return F.filter(F.transform(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)), F.lower), lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9]"))


def sketch(words: Column) -> Column:
    """The least hash of a text's three-word shingles."""
    shingle = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), shingle))


def texts_with_entities(based: DataFrame) -> DataFrame:
    """(_hash, copies, entities, words, sketch), one row per distinct text that has an entity."""
    told = let(words_of(F.col("_text")), lambda w: F.struct(F.array_distinct(w).alias("words"), sketch(w).alias("sketch")))
    entities = F.array_distinct(F.transform("_base", lambda s: F.lower(s["value"])))
    one = F.when(F.size("_base") > 0, F.array(F.struct(entities.alias("entities"), told.alias("told"))))
    # Not a filter on _base: Spark would compute the spans a second time for it.
    found = based.select("_hash", F.explode_outer(one).alias("one")).filter(F.col("one").isNotNull())
    found = found.groupBy("_hash").agg(F.first("one").alias("one"), F.count(F.lit(1)).alias("copies"))
    return found.select("_hash", "copies", "one.entities", "one.told.words", "one.told.sketch")


def entity_classes(texts: DataFrame, support: int) -> DataFrame:
    """(_hash, class, of_entity): the texts of each entity that ``support`` texts have, and how many documents those are.

    Entities that stand in the very same texts have the same counts with every word; they are
    one class, so a directory of thousands of addresses costs a row per text, not one per address.
    """
    each = texts.select("_hash", "copies", F.explode("entities").alias("entity"))
    sets = each.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("of_entity"), F.bit_xor("_hash").alias("x"), F.bit_xor(F.xxhash64("_hash")).alias("y"))
    sets = sets.filter(F.col("texts") >= support).select("entity", F.xxhash64("texts", "x", "y").alias("class"), "of_entity")
    return each.join(sets, "entity").select("_hash", "class", "of_entity").distinct()


def disclosure(n: Column, both: Column, of_entity: Column, of_term: Column) -> Column:
    """PMI(e; t) / IC(e) from counts of documents: all, with both, with the entity, with the word."""
    information = F.log(n / of_entity)
    return F.when(information > 0, F.log(n * both / (of_entity * of_term)) / information).otherwise(0.0)


def disclosing_terms(docs: DataFrame, texts: DataFrame, *, support: int = SUPPORT, threshold: float = GENERALISE, chance: float = CHANCE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(_hash, term, class, disclosure): the words of each text that disclose an entity of it to at least ``threshold``.

    Counts cover every document.  How many have a word at all only matters for words that may
    disclose something, by a bound: a word is in no fewer documents than have it beside some
    entity.  The list of those words is broadcast if it has at most ``broadcast_rows`` rows and
    joined by shuffle otherwise, in either case with words that are counted already.
    """
    n = F.lit(float(max(docs.count(), 2)))
    classes = checkpointed(entity_classes(texts, support))
    beside = texts.join(classes.select("_hash").distinct(), "_hash", "left_semi").select("copies", F.explode("words").alias("term")).groupBy("term").agg(F.sum("copies").alias("beside"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support).drop("texts")
    said = classes.join(texts, "_hash").select("_hash", "class", "of_entity", "copies", "sketch", F.explode("words").alias("term"))
    both = said.groupBy("class", "of_entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("both"))
    both = checkpointed(both.filter(F.col("texts") >= support))
    tested = F.lit(float(max(both.count(), 1)))
    certain = F.col("texts") * F.log(n / F.col("of_entity")) >= F.log(tested / F.lit(chance))
    possible = checkpointed(both.filter(certain).join(beside, "term").filter(disclosure(n, F.col("both"), F.col("of_entity"), F.col("beside")) >= threshold).drop("beside"))
    candidates = possible.select("term").distinct()
    known = candidates.limit(broadcast_rows + 1).count()
    none = texts.select("_hash", F.lit("").alias("term"), F.lit(0).cast("long").alias("class"), F.lit(0.0).alias("disclosure")).limit(0)
    if not known:
        return none
    # Counted before the join: of a common word a task sends one row, however many documents have it.
    # The join is an inner one, since Catalyst would move a semi join below the count, to the words' occurrences.
    of_term = docs.select(F.explode(F.array_distinct(words_of(F.col("_text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    degrees = possible.join(of_term.join(F.broadcast(candidates) if known <= broadcast_rows else candidates, "term"), "term")
    degrees = degrees.select("class", "term", "texts", disclosure(n, F.col("both"), F.col("of_entity"), F.col("of_term")).alias("disclosure"))
    degrees = checkpointed(degrees.filter(F.col("disclosure") >= threshold))
    if not degrees.limit(1).count():
        return none
    rows = checkpointed(said.select("_hash", "class", "term", "sketch").join(degrees, ["class", "term"]))
    # Near copies share most of their shingles, so also their sketch: they are no evidence.
    sketches = rows.groupBy("class", "term", "texts", "sketch").agg(F.count(F.lit(1)).alias("_")).groupBy("class", "term", "texts").agg(F.count(F.lit(1)).alias("sketches"))
    proven = sketches.filter((F.col("sketches") >= support) & (2 * F.col("sketches") >= F.col("texts"))).select("class", "term")
    return rows.join(proven, ["class", "term"]).select("_hash", "term", "class", "disclosure")


def _digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its label; overlapping spans give the first one's label."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        added = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["value"]))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, added).otherwise(acc["out"]).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["label"].alias("value"))))
    return F.aggregate(ordered, start, put, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    support: int = SUPPORT,
    chance: float = CHANCE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, stop, label), sanitised text.

    With ``carry`` the whole input row follows as the struct ``row``, whatever its names.

    Kinds are email, ip, card, phone and term, in this order and then by start; positions
    are code points, the stop exclusive.  A null text is empty: it has no span and stays
    null in ``sanitised``.  Repeated rows are treated alike, each on its own; null ids are
    kept.  An empty table gives an empty result.  A very long text is read whole; its spans are
    cut out one after the other.  Disclosing words go from the texts that have the entity which
    they disclose.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").isNull().alias("_null"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *[whole_row(docs)] * carry).withColumn("_hash", F.xxhash64("_text"))
    based = base_spans(source)
    texts = checkpointed(texts_with_entities(based))
    told = disclosing_terms(source, texts, support=support, threshold=generalise, chance=chance, broadcast_rows=broadcast_rows).groupBy("_hash", "term").agg(F.max("disclosure").alias("d"))
    told = checkpointed(told.groupBy("_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("_told")).withColumnRenamed("_hash", "_hash2"))
    few = told.limit(broadcast_rows + 1).count()
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,label:string>>")
    base = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    if few:
        based = based.join(F.broadcast(told) if few <= broadcast_rows else told, F.col("_hash") == F.col("_hash2"), "left")
        degree = lambda v: F.col("_told")[F.lower(v)]
        shape = lambda v: F.when(v.rlike(r"^\p{Lu}"), "[NAME]").when(v.rlike(r"^\p{N}"), "[NUMBER]").otherwise("[WORD]")
        risky = matches(F.col("_text"), WORD, "term", lambda v: degree(v).isNotNull(), F.col("_told").isNotNull())
        terms = F.transform(risky, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.when(degree(s["value"]) >= remove, F.lit("")).otherwise(shape(s["value"])).alias("label")))
        spans = F.concat(base, F.coalesce(terms, none))
    else:
        spans = base
    out = based.withColumn("_spans", spans)
    text = F.when(F.col("_null"), F.lit(None)).when(F.size("_spans") == 0, F.col("_text")).otherwise(_sanitised(F.col("_text"), F.col("_spans")))
    return out.select(F.col("_id").alias("doc_id"), F.col("_spans").alias("spans"), text.alias("sanitised"), *[F.col("_row").alias("row")] * carry)


def span_digests(sanitised: DataFrame) -> DataFrame:
    """Counts and digests of the spans of :func:`sanitise`."""
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return sanitised.select("doc_id", *(kind(k).alias(f"n_{k}") for k in KINDS), F.sha2(_digest_text(base), 256).alias("base_sha256"), _digest_text(F.col("spans")).alias("spans"), kind("term").alias("n_term"))
