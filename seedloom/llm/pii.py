"""Personal data: patterns, and terms that give protected entities away.

Only DataFrame and SQL functions. Spans come from the pieces between matches: a match starts where
the lengths of all pieces and matches before it end, so positions cost one running sum per text.
Entities are the matched values. For every term that stands in texts with an entity, the corpus
says how many documents hold the term, the entity and both; the share of the entity's
information that the term discloses, pmi(term, entity) / -log p(entity), decides whether the
term is a span, too, in every text that has it. Such a term is generalised to the words that share
its beginning, if these surely disclose less, else removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedloom.llm.common import keep, table, text_or_empty
from seedloom.llm.linededup import NO_ID
from seedloom.operators.base import let, small_side

# The contract's patterns, in its order. Possessive repeats and the first
# condition (not inside a run, unless the match before ended there) change no match; they keep the
# search linear in texts with long runs.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = "term"
# A term counts as one that discloses an entity if at least this share of the entity's information
# follows from it, seen in at least so many different texts.
DISCLOSED, SUPPORT = 0.9, 3
# Letters that the general form of a term keeps at least.
SHORTEST = 3
# Keys over which a word's texts are dealt where they meet the terms.
SALTS = 64
_WORD = r"\p{L}{3,}"


def _luhn(digits: Column) -> Column:
    def total(back):
        d = lambda i: F.substring(back, i, F.lit(1)).try_cast("int")
        worth = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.when(i % 2 == 1, d(i)).when(d(i) > 4, d(i) * 2 - 9).otherwise(d(i) * 2))
        return F.aggregate(worth, F.lit(0), lambda a, v: a + v) % 10 == 0

    return let(F.reverse(digits), total)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: Column) -> Column:
    """For each match: its text and the length of what stands between it and the match before.

    Text and pieces are evaluated once, not once per match.
    """
    gaps = lambda found, between: F.transform(found, lambda m, i: F.struct(m.alias("match"), F.length(F.get(between, i)).alias("gap")))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(found, lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda b: gaps(f, b))))


def _positions(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Start and end of every match from the gaps; ``nth`` orders the matches of ``by``."""
    w = Window.partitionBy(*by).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    return pieces.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).drop("gap", "nth")


def texts_with_matches(docs: DataFrame) -> DataFrame:
    """(doc, text) -> doc, text_hash, text, found: the rows with any match, valid or not."""
    def of(kind: str) -> Column:
        row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), x["match"].alias("match"), x["gap"].alias("gap"))
        return F.transform(_pieces(F.col("text"), F.lit(KINDS[kind])), row)

    some = F.flatten(F.array_compact(F.array(*[of(k) for k in KINDS])))
    return docs.select("doc", F.xxhash64("text").alias("text_hash"), "text", some.alias("found")).filter(F.size("found") > 0)


def base_spans(matches: DataFrame) -> DataFrame:
    """doc, text_hash, kind, start, end, match of the valid matches; repeated rows count once."""
    rows = matches.select("doc", "text_hash", F.inline("found")).repartition("doc", "text_hash").distinct()
    spans = _positions(rows, ["doc", "text_hash", "kind"])
    valid = None
    for kind in KINDS:
        test = _valid(kind, F.col("match"))
        valid = F.when(F.col("kind") == kind, test) if valid is None else valid.when(F.col("kind") == kind, test)
    return spans.filter(valid)


def _words(text: Column) -> Column:
    blank = text
    for p in KINDS.values():
        blank = F.regexp_replace(blank, p, " ")
    # Every pattern needs an @ or a digit; other texts are read as they are.
    bare = F.when(text.rlike("[@0-9]"), blank).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(_WORD), F.lit(0)))


def _disclosure(n_et, n_e, n_t, total: int) -> Column:
    """Share of the entity's information that follows from the term: pmi(term, entity) / -log p(entity)."""
    return 1 + F.log(F.least(n_et / n_t, F.lit(1.0))) / -F.log(n_e / F.lit(float(max(total, 1))))


def disclosing_terms(docs: DataFrame, matches: DataFrame, spans: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT) -> DataFrame:
    """entity, term, general: terms over the threshold, with their general form or null if there is none.

    All counts are of documents of the whole corpus, copies included; the support alone counts
    different texts, as copies are no evidence of their own. Entities that stand in the same
    texts are disclosed by the same terms, so the smallest hash stands for them all.
    """
    total = docs.count()
    # Copies of a text are one row with their number from here on.
    held = spans.select("doc", "text_hash", F.xxhash64("kind", "match").alias("entity")).distinct()
    held = held.groupBy("entity", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    # The texts of an entity as two sums of hashes.
    where = [F.bit_xor(F.xxhash64("text_hash", F.lit(i))).alias(f"where{i}") for i in (1, 2)]
    of_entity = held.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts"), *where)
    # A term over the threshold needs an entity in as many texts as the support.
    alike = of_entity.filter(F.col("texts") >= support).groupBy("n_e", "texts", "where1", "where2").agg(F.min("entity").alias("entity"))
    held = keep(held.join(alike.select("entity", "n_e"), "entity"), "entities")
    texts = matches.join(held.select("text_hash").distinct(), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    both = held.join(texts, "text_hash").select("entity", "n_e", "n", "text_hash", F.explode(_words(F.col("text"))).alias("term"))
    pairs = both.groupBy("entity", "n_e", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    of_term = keep(docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "words")
    share = _disclosure(F.col("n_et"), F.col("n_e"), F.col("n_t"), total)
    found = keep(pairs.filter(F.col("n_e") < total).join(of_term, "term").filter(share >= disclosed).select("entity", "n_e", "term"), "disclosing")
    return found.join(general_forms(found, of_term, total, disclosed), "term", "left").select("entity", "term", "general")


def general_forms(found: DataFrame, of_term: DataFrame, total: int, disclosed: float = DISCLOSED) -> DataFrame:
    """(entity, n_e, term) -> term, general: the longest beginning whose words disclose none of the term's entities.

    The words with a beginning stand in as many texts as the most frequent of them at least, and with an
    entity in as many as the entity has at most; if even these two counts stay below the threshold, the
    beginning is general enough. Terms without such a beginning have no row.
    """
    starts = lambda word, most: F.transform(F.sequence(F.lit(SHORTEST), most), lambda n: F.substring(word, F.lit(1), n))
    # (log N - log n_t) / (log N - log n_e) grows with n_e, so a term's most frequent entity decides.
    by_term = found.groupBy("term").agg(F.max("n_e").alias("n_e")).filter(F.length("term") > SHORTEST)
    asked = by_term.select("term", "n_e", F.explode(starts(F.col("term"), F.length("term") - 1)).alias("start"))
    # No longer beginning is asked for: those of a word of 200,000 letters are 20 GB.
    reach = (by_term.agg(F.max(F.length("term"))).first()[0] or SHORTEST + 1) - 1
    most = of_term.select("n_t", F.explode(starts(F.col("term"), F.least(F.length("term"), F.lit(reach)))).alias("start"))
    most = most.groupBy("start").agg(F.max("n_t").alias("n_t"))
    fits = asked.join(most, "start").filter(_disclosure(F.col("n_e"), F.col("n_e"), F.col("n_t"), total) < disclosed)
    longest = fits.groupBy("term").agg(F.max(F.struct(F.length("start").alias("n"), "start")).alias("best"))
    return longest.select("term", F.col("best.start").alias("general"))


def term_spans(docs: DataFrame, terms: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of the disclosing terms in all texts that have them, with the entity or without, but not
    those that touch a base span."""
    own = docs.select("doc", F.xxhash64("text").alias("text_hash"), "text")
    # A word of every text is dealt over SALTS keys, each with its copy of the terms.
    salted = small_side(terms.select("term", "general").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    words = own.select("text_hash", F.pmod("text_hash", F.lit(SALTS)).cast("int").alias("salt"), F.explode(_words(F.col("text"))).alias("term"))
    listed = words.join(salted, ["term", "salt"]).groupBy("text_hash").agg(F.sort_array(F.collect_set(F.struct("term", "general"))).alias("listed"))
    own = own.join(listed, "text_hash")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("listed.term", "|"), F.lit(r")(?!\p{L})"))
    general = F.map_from_entries("listed")
    rows = own.select("doc", "text_hash", general.alias("of"), F.posexplode(_pieces(F.col("text"), pattern)).alias("nth", "x"))
    rows = rows.select("doc", "text_hash", "nth", F.col("x.match").alias("match"), F.col("x.gap").alias("gap"), F.try_element_at("of", F.lower("x.match")).alias("general"))
    placed = _positions(rows.repartition("doc", "text_hash").distinct(), ["doc", "text_hash"]).withColumn("kind", F.lit(TERM))
    cols = ["doc", "text_hash", "kind", "start", "end", "match", "general"]
    every = placed.select(cols).union(spans.withColumn("general", F.lit(None).cast("string")).select(cols))
    w = Window.partitionBy("doc", "text_hash").orderBy("start")
    base = F.col("kind") != TERM
    before = F.max(F.when(base, F.col("end"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (after.isNull() | (after >= F.col("end")))
    return every.withColumn("clear", clear).filter((F.col("kind") == TERM) & F.col("clear")).select(cols)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", disclosed: float = DISCLOSED, support: int = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, spans: array of (start, rank, end, kind, match, general) by
    start, then kind in the order of KINDS with terms last; code points, end exclusive. ``general`` is the
    general form of a term, null for terms that have none and for base spans.

    Null and empty texts have no spans. Rows that share id and text share their spans; a null
    id stays null. An empty table gives an empty result. Other columns are ignored.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    named = docs.select(key.alias("doc"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    d = named.select("doc", "text")
    matches = keep(texts_with_matches(d), "matches")
    spans = keep(base_spans(matches), "spans")
    terms = keep(disclosing_terms(d, matches, spans, disclosed, support), "terms")
    cols = ["doc", "text_hash", "kind", "start", "end", "match", "general"]
    every = spans.withColumn("general", F.lit(None).cast("string")).select(cols).union(term_spans(d, terms, spans))
    rank = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, TERM]]), F.col("kind")).cast("int")
    one = F.struct(F.col("start").cast("long").alias("start"), rank.alias("rank"), F.col("end").cast("long").alias("end"), "kind", "match", "general")
    listed = every.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    ids = named.select("doc", "doc_id", F.xxhash64("text").alias("text_hash"))
    return ids.join(listed, ["doc", "text_hash"], "left").drop("doc")


def sanitise(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` replaced: matches by their kind in brackets, terms by
    their general form, as in ``[zan*]``, and by ``[term]`` if they have none. A span that starts inside the one before is part of it."""
    first = found.groupBy(doc_id, "text_hash").agg(F.first("spans").alias("_spans"))
    own = docs.withColumn("text_hash", F.xxhash64(text_or_empty(text)))
    joined = own.join(first, [doc_id, "text_hash"], "left")
    inside = lambda x, y: (y["start"] < x["start"]) & (y["end"] > x["start"]) | (y["start"] == x["start"]) & (y["rank"] < x["rank"])
    outer = F.filter("_spans", lambda x: ~F.exists("_spans", lambda y: inside(x, y)))

    def rewritten(s, body):
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"]).cast("int")
        stop = lambda i: F.when(i == F.size(s), F.length(body)).otherwise(F.get(s, i)["start"]).cast("int")
        put = lambda i: F.when(i == F.size(s), F.lit("")).otherwise(F.concat(F.lit("["), F.coalesce(F.concat(F.get(s, i)["general"], F.lit("*")), F.get(s, i)["kind"]), F.lit("]")))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.concat(F.substring(body, begin(i) + 1, stop(i) - begin(i)), put(i))), "")

    new = let(outer, lambda s: let(text_or_empty(text), lambda body: rewritten(s, body)))
    return joined.withColumn(text, F.when(F.coalesce(F.size("_spans"), F.lit(0)) > 0, new).otherwise(F.col(text))).select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.array())
    base = F.filter(spans, lambda x: x["kind"] != TERM)
    show = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(show(base), 256).alias("base_sha256"), show(spans).alias("spans"),
        F.size(F.filter(spans, lambda x: x["general"].isNotNull())).cast("long").alias("n_generalised"),
        F.size(F.filter(spans, lambda x: (x["kind"] == TERM) & x["general"].isNull())).cast("long").alias("n_removed"),
    )
