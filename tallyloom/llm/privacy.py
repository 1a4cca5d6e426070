"""Personal data and the terms that reveal it: information-theoretic sanitisation, in DataFrame operations only.

Patterns find e-mail and IP addresses, card and phone numbers; each distinct value is a protected
entity e. How strongly a term t that stands in a document with e reveals it is, of N documents,

    disclosure = log2(P(e | t) / P(e)) / log2(1 / P(e))  (1: whoever reads t knows e; 0: t tells nothing)

which reaches a threshold g where P(e | t) reaches P(e)^(1 - g). P(e | t) is not taken as counted: a word that was
seen once, in one document with e, would tell all. Instead g counts as reached if documents so many would show e so
often beside t only with a probability under CHANCE / R if P(e | t) was lower, where R is the number of terms of the
corpus rare enough to be tested (Chernoff's bound; so one false term an entity in 1 / CHANCE entities at most).
Texts of one entity that share most of their words are no independent evidence: equal texts count once, and counts
are divided by the design effect of the entity, the mean number of its texts that hold a term. Entities of a
single text tell nothing. In a document with e, a term that reaches REMOVE goes; one that reaches GENERALISE is
replaced by the rarest term that subsumes it, does not tell e, and is at least TWICE as common, or by its kind of word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .tables import discard, free_names, quoted, stored

#: Disclosures that are generalised or removed, and the chance of a false one among all terms tested for an entity.
GENERALISE, REMOVE = 0.5, 0.8
CHANCE = 0.05
#: The share of a term's texts that hold a term that subsumes it, and how much commoner that is.
SUBSUMED, TWICE = 0.8, 2

#: kind: pattern. Each finds what the plain pattern in the comment finds, leftmost and without overlaps, in linear time:
#: possessive repeats need no stack, and starts inside a run that already failed are skipped.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "card": r"[0-9](?:[\x20-]?[0-9])++",  # [0-9]([\x20-]?[0-9])+
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: A word of three letters or more, apart from closing punctuation.
TERM = r"(?<![^\x20\x09-\x0D])\p{L}{3,}+(?=[.,;:!?]*+(?:[\x20\x09-\x0D]|\z))"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Matches whose places are summed at a time, so that arrays that grow by one stay short.
RUN = 128


def spans(text: Column, pattern: str) -> Column:
    """array of struct(start, end, value) of the matches: code points, end exclusive."""

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def run(a: Column, matches: Column) -> Column:
        one = F.aggregate(matches, F.struct(a["at"].alias("at"), F.array().cast(SPAN).alias("out")), step)
        return let(one, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def of(gaps: Column, found: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        matches = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
        runs = let(matches, lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / RUN).cast("int")), lambda i: F.slice(m, i * RUN + 1, RUN)))
        return F.flatten(F.aggregate(runs, zero, run, lambda a: a["out"]))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: of(g, m))).otherwise(F.array().cast(SPAN)))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def step(a: Column, i: Column) -> Column:
        d = F.substring(digits, -1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return a + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def personal(text: Column) -> Column:
    """array of struct(start, kind number, end, entity) of the personal data of a text, by start, then kind."""
    hint = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast("array<struct<start:int,kind:int,end:int,entity:string>>")

    def of(i: int, kind: str) -> Column:
        good = F.filter(spans(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))
        name = (lambda v: F.lower(v)) if kind == "email" else (lambda v: F.concat(F.lit(f"{kind} "), F.regexp_replace(v, "[^0-9.]" if kind == "ip" else "[^0-9]", "")))
        return F.when(hint[kind], F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), name(x["value"]).alias("entity")))).otherwise(none)

    return F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(PATTERNS)]))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.crc32(text.cast("binary")).alias("t2"))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, base, terms) of every row: personal data, and the terms of texts that hold any."""
    none = F.array().cast("array<struct<term:string,start:int,end:int>>")
    terms = F.transform(spans(F.col("text"), TERM), lambda x: F.struct(F.lower(x["value"]).alias("term"), x["start"].alias("start"), x["end"].alias("end")))
    return _keyed(docs).withColumn("base", personal(F.col("text"))).withColumn("terms", F.when(F.size("base") > 0, terms).otherwise(none)).drop("text")


def holders(found: DataFrame) -> DataFrame:
    """(t1, t2, w, e, t): each distinct text with personal data, its rows, and its distinct entities and terms."""
    entities, terms = F.array_distinct(F.transform("base", lambda x: x["entity"])), F.array_distinct(F.transform("terms", lambda x: x["term"]))
    return found.where(F.size("base") > 0).select("t1", "t2", entities.alias("e"), terms.alias("t")).groupBy("t1", "t2").agg(F.count("*").alias("w"), F.first("e").alias("e"), F.first("t").alias("t"))


def reaches(n: Column, n_e: Column, n_t: Column, n_et: Column, k: Column, tested: Column, g: float) -> Column:
    """Whether the disclosure of e by t reaches g: k independent texts hold both, n_t - n_et rows hold t alone."""
    q, alone = F.pow(n_e / n, F.lit(1 - g)), n_t - n_et
    x = k / (k + alone)
    bits = k * F.log2(x / q) + F.when(alone > 0, alone * F.log2(F.when(alone > 0, 1 - x).otherwise(1.0) / (1 - q))).otherwise(0.0)
    return (x > q) & (bits >= F.log2(tested / CHANCE))


def most_rows(n: Column, n_e: Column) -> Column:
    """The most rows that can hold a term with which an entity of n_e rows reaches GENERALISE: as n(e, t) <= n(e), a little rounded up."""
    return F.pow(n_e.cast("double"), F.lit(GENERALISE)) * F.pow(n, F.lit(1 - GENERALISE)) * (1 + 1e-9)


def word_counts(docs: DataFrame) -> DataFrame:
    """(term, n_t): the rows that hold a term."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def candidates(texts: DataFrame, words: DataFrame, rows: int) -> tuple[DataFrame, Column]:
    """(t1, t2, w, entity, n_e, term, n_t) of each entity and term of a text, less those whose term stands in too many rows; and the number of terms tested.

    Counts are over all rows. What every row holds is no secret, and nothing discloses it. Terms are
    told from others by their counts before they meet entities, so common words make no pairs.
    """
    n = F.lit(float(rows))
    entities = texts.select("w", F.explode("e").alias("entity")).groupBy("entity").agg(F.sum("w").alias("n_e"), F.count("*").alias("texts"))
    entities = stored(entities.where((F.col("n_e") < n) & (F.col("texts") > 1)).select("entity", "n_e"), "entities")
    top = F.lit(float(entities.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]))
    rare = words.where(F.col("n_t") <= most_rows(n, top))
    tested = F.lit(float(max(1, rare.count())))
    own = texts.select("t1", "t2", "w", F.explode("e").alias("entity")).join(entities, "entity").groupBy("t1", "t2").agg(F.first("w").alias("w"), F.max("n_e").alias("most"), F.collect_set(F.struct("entity", "n_e")).alias("x"))
    terms = texts.join(own.drop("w"), ["t1", "t2"]).select("t1", "t2", "w", "most", "x", F.explode("t").alias("term")).join(rare, "term").where(F.col("n_t") <= most_rows(n, F.col("most")))
    both = terms.select("t1", "t2", "w", "term", "n_t", F.explode("x").alias("x")).select("t1", "t2", "w", "x.entity", "x.n_e", "term", "n_t")
    return stored(both.where(F.col("n_t") <= most_rows(n, F.col("n_e"))), "candidate-terms"), tested


def disclosures(pairs: DataFrame, rows: int, tested: Column) -> DataFrame:
    """(entity, term, remove) of the candidates that reach GENERALISE; remove: REMOVE too."""
    joint = pairs.groupBy("entity", "term").agg(F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"), F.sum("w").alias("n_et"), F.count("*").alias("k"))
    effect = joint.groupBy("entity").agg((F.sum(F.col("k") * F.col("k")) / F.sum("k")).alias("effect"))
    args = (F.lit(float(rows)), F.col("n_e"), F.col("n_t"), F.col("n_et"), F.col("k") / F.col("effect"), tested)
    return joint.join(effect, "entity").where(reaches(*args, GENERALISE)).select("entity", "term", reaches(*args, REMOVE).alias("remove"))


def subsumers(texts: DataFrame, told: DataFrame, words: DataFrame) -> DataFrame:
    """(term, general): for a term of told (t1, t2, term) the rarest that stands in SUBSUMED of its texts, is TWICE as common, and is told of no text."""
    mine = told.select("t1", "t2", "term").distinct()
    k = mine.groupBy("term").agg(F.count("*").alias("k"))
    beside = mine.join(texts.select("t1", "t2", F.explode("t").alias("general")), ["t1", "t2"]).groupBy("term", "general").agg(F.count("*").alias("both"))
    beside = beside.join(k, "term").where(F.col("both") >= SUBSUMED * F.col("k")).join(k.select(F.col("term").alias("general")), "general", "left_anti")
    counted = beside.join(words.select(F.col("term").alias("general"), F.col("n_t").alias("n_u")), "general").join(words, "term").where(F.col("n_u") >= TWICE * F.col("n_t"))
    return counted.groupBy("term").agg(F.min_by("general", F.struct("n_u", "general")).alias("general"))


def sanitisable(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, base, terms) of every row; terms: array of struct(start, kind number, end, general) to remove (general is empty) or replace (by a term, or null: by its kind)."""
    found = stored(scanned(docs), "personal-data")
    rows = found.count()
    texts = stored(holders(found), "personal-texts")
    words = stored(word_counts(docs), "word-counts")
    pairs, tested = candidates(texts, words, rows)
    told = pairs.join(disclosures(pairs, rows, tested), ["entity", "term"]).groupBy("t1", "t2", "term").agg(F.max("remove").alias("remove"))
    told = stored(told, "disclosures")
    general = told.join(subsumers(texts, told, words), "term", "left").select("t1", "t2", "term", F.when(F.col("remove"), "").otherwise(F.col("general")).alias("general"))
    each = stored(general.groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct("term", "general"))).alias("told")), "told")
    discard(texts, words, pairs, told)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,general:string>>")
    marked = F.filter("terms", lambda x: F.map_contains_key(F.col("told"), x["term"]))
    placed = F.transform(marked, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), x["end"].alias("end"), F.try_element_at(F.col("told"), x["term"]).alias("general")))
    with_data = found.where(F.size("base") > 0).join(each, ["t1", "t2"], "left").withColumn("terms", F.when(F.col("told").isNull(), none).otherwise(placed)).drop("told")
    return with_data.unionByName(found.where(F.size("base") == 0).withColumn("terms", none).select(with_data.columns))


def listing(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of every row.

    A null text is empty and has no spans. Every row of docs gives one, repeated ones too. Terms are
    marked only in documents with the personal data they tell, so documents without any have no spans.
    """
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    both = F.sort_array(F.concat(plain("base"), plain("terms")))
    return sanitisable(docs).select("doc_id", *counts, F.size("terms").cast("long").alias("n_term"), F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(both).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """All columns of docs, with the personal data in text masked, and terms in the same text that disclose it generalised or removed.

    A null text stays null. Overlapping spans are masked once, by the one that starts first. Columns
    of docs may have any names.
    """
    text = F.coalesce("text", F.lit(""))
    found = sanitisable(docs.select("doc_id", "text")).where(F.size("base") > 0).dropDuplicates(["t1", "t2"])
    a, b, base, terms = free_names(docs.columns, 4)
    found = stored(found.select(F.col("t1").alias(a), F.col("t2").alias(b), F.col("base").alias(base), F.col("terms").alias(terms)), "masks")
    masks = F.array(*[F.lit(MASKS[k]) for k in PATTERNS])

    def replaced(t: Column) -> Column:
        hits = F.sort_array(
            F.concat(
                F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.get(masks, x["kind"]).alias("mask"))),
                F.transform(terms, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), _generalised(F.substring(t, x["start"] + 1, x["end"] - x["start"]), x["general"]).alias("mask"))),
            )
        )
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, x: Column) -> Column:
            more = F.when(x["start"] >= a["at"], F.concat(F.substring(t, a["at"] + 1, x["start"] - a["at"]), x["mask"])).otherwise("")
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], more).alias("out"))

        return F.aggregate(hits, zero, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))

    keyed = docs.withColumns({a: F.xxhash64(text), b: F.crc32(text.cast("binary"))}).join(found, [a, b], "left")
    new = F.when(F.col(base).isNull(), F.col("text")).otherwise(replaced(F.col("text"))).alias("text")
    return keyed.select(*[new if c == "text" else quoted(c) for c in docs.columns])


def _generalised(word: Column, general: Column) -> Column:
    """Nothing, the more general term in the word's case, or the kind of word."""
    upper = word.rlike(r"^\p{Lu}")
    return F.when(general.isNull(), F.when(upper, "[NAME]").otherwise("[WORD]")).when(general == "", "").when(upper, F.concat(F.upper(F.substring(general, 1, 1)), F.substring(general, F.lit(2), F.length(general)))).otherwise(general)


def op8_privacy(spark, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms of every document."""
    return spans_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
