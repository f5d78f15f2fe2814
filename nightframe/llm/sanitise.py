r"""Personal data by patterns and by information-theoretic disclosure (operator 8, native).

Patterns find emails, IP addresses, cards and phone numbers; matches are leftmost and do not
overlap within a kind, and those that fail their test are dropped. Each value found is a
protected entity, and so are the parts that values share: an email's name and domain, an IP
address's network, a card's issuer, a phone number without its last four digits. The kind is
none, as the label in a value's place tells it. The corpus tells how strongly other terms reveal
an entity: with document counts, PMI(e, t) = log(P(e | t) / P(e)) against IC(e) = -log P(e),
what there is to know about it, where P(e) = n(e) / n and P(e | t) is smoothed,
(n(e, t) + DOUBT * P(e)) / (n(t) + DOUBT). So entities of a single document are judged as well,
and a word that is met once is weaker evidence than one that is met with the entity each time.
A term that discloses more than GENERALISE of IC is replaced by a class in all documents, with
or without the entity; one above REMOVE is taken out.
Terms are runs of letters and digits, lower-cased, outside the pattern matches.

The patterns are those asked for, written so that Java's matcher neither recurses nor starts
again inside a run that it has already refused: possessive loops, and starts only at the front
of a run or where the last match ended.

Cases: a null text is empty; equal texts share one key (MD5) and are searched once for terms;
ids may be null or repeated; extra columns are carried in `row`; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed, ensure_checkpoint_dir, small

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"
GENERALISE, REMOVE = 0.9, 0.98
#: Documents of doubt: how many without a say each term is counted with.
DOUBT = 1.0
SPAN = "array<struct<start:int,end:int,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, 1).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*+(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])|(?<=0))(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    return F.length(_digits(match)).between(8, 15) if kind == "phone" else F.lit(True)


def spans_where(text: Column, pattern: str, keep) -> Column:
    """SPAN of the matches that keep() accepts, in code points. The text between matches gives
    their places; only accepted ones are added to the list."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        out = F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("value"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def base_spans(text: Column, kind: str) -> Column:
    possible = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
    return F.when(possible, spans_where(text, PATTERNS[kind], lambda m: valid(kind, m))).otherwise(F.array().cast(SPAN))


def _entities() -> Column:
    """What the spans name: emails in lower case, digits of the rest, and the parts of each."""
    named = lambda k, of, part="": F.transform(k, lambda x: F.concat(F.lit(f"{k}{part}:"), of(x["value"])))
    but_four = lambda v: F.regexp_replace(_digits(v), "[0-9]{4}$", "")
    return F.array_distinct(F.concat(
        named("email", F.lower), named("email", lambda v: F.substring_index(F.lower(v), "@", 1), " name"), named("email", lambda v: F.substring_index(F.lower(v), "@", -1), " domain"),
        named("ip", lambda v: v), named("ip", lambda v: F.substring_index(v, ".", 3), " network"),
        named("card", _digits), named("card", lambda v: F.substring(_digits(v), 1, 6), " issuer"),
        named("phone", _digits), named("phone", but_four, " exchange"),
    ))


def blank(text: Column, spans: Column) -> Column:
    """text with spaces in place of sorted spans."""
    acc = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["end"] <= a["at"], a["out"]).otherwise(F.concat(a["out"], text.substr(a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.repeat(F.lit(" "), s["end"] - F.greatest(a["at"], s["start"])))).alias("out"))

    done = F.aggregate(spans, acc, step)
    return F.concat(done["out"], text.substr(done["at"] + 1, F.length(text)))


def sorted_base() -> Column:
    return F.array_sort(F.concat(*[F.col(k) for k in KINDS]))


def _terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def sanitise(docs: DataFrame, text: str = "text", keep: list[str] | None = None, doubt: float = DOUBT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """row (the columns of docs, or those named), email, ip, card, phone and term: the spans of each document,
    those of terms with the class that stands for them, empty for removal, as `value`."""
    ensure_checkpoint_dir(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), t.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    bases = keyed.where(F.col("text").contains("@") | F.col("text").rlike("[0-9]"))
    bases = bases.select("key", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    bases = bases.where(F.greatest(*[F.size(k) for k in KINDS]) > 0)
    bases = bases.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.first(k).alias(k) for k in KINDS])
    bases = checkpointed(bases.withColumn("entities", _entities()))
    total = keyed.count()

    met = bases.select("key", "n", F.explode("entities").alias("entity"))
    known = met.groupBy("entity").agg(F.sum("n").alias("n_e")).where(F.col("n_e") < total)
    met = checkpointed(met.join(known, "entity"))
    held = small(bases.select("key"))
    near = keyed.join(held, "key", "left_semi").select("key", "text").dropDuplicates(["key"])
    near = near.join(bases.select("key", "n", sorted_base().alias("base")), "key").join(met.groupBy("key").agg(F.max("n_e").alias("most")), "key", "left")
    near = checkpointed(near.select("key", "n", F.coalesce("most", F.lit(1)).alias("most"), blank(F.col("text"), F.col("base")).alias("rest")))

    def share(n_et: Column, n_e: Column, n_t: Column) -> Column:
        p = n_e / float(max(total, 2))  # of fewer documents no entity is known
        return F.log((n_et + doubt * p) / (n_t + doubt) / p) / -F.log(p)

    n_e, n_t = F.col("n_e"), F.col("n_t")
    # as n(e, t), n(t) is counted outside the matches
    far = keyed.join(held, "key", "left_anti").select("key", F.explode(_terms(F.col("text"))).alias("term"))
    words = far.select("term", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_far"))
    words = words.unionByName(near.select(F.explode(_terms(F.col("rest"))).alias("term"), "n", F.lit(0).cast("long").alias("n_far")))
    counts = words.groupBy("term").agg(F.sum("n").alias("n_t"), F.sum("n_far").alias("n_far"))
    by_near = near.select("key", "most", F.explode(_terms(F.col("rest"))).alias("term"))
    # of a text's entities less frequent than a term, the most frequent is the one it can tell most of
    pairs = by_near.join(counts, "term").where((n_t <= F.col("most")) | (share(F.col("most"), F.col("most"), n_t) >= generalise)).drop("most").join(met, "key")
    pairs = pairs.where(share(F.least(n_e, n_t), n_e, n_t) >= generalise).groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"), F.first("n_far").alias("n_far"))
    told = pairs.withColumn("share", share(F.col("n_et"), n_e, n_t)).where(F.col("share") >= generalise)
    instead = F.when(F.col("share") >= remove, "").when(F.col("term").rlike("[0-9]"), "[NUMBER]").otherwise("[TERM]")
    told = checkpointed(told.groupBy("term").agg(F.min(instead).alias("instead"), F.first("n_far").alias("n_far")))
    # only terms that stand in documents without an entity are sought there
    at = by_near.drop("most").join(small(told), "term").unionByName(far.join(small(told.where("n_far > 0")), "term"))
    terms = checkpointed(at.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("term", "instead"))).alias("terms")))
    others = keyed.join(small(terms.select("key")), "key", "left_semi").join(held, "key", "left_anti").select("key", F.col("text").alias("rest")).dropDuplicates(["key"])
    hidden = near.select("key", "rest").unionByName(others).join(terms, "key")
    hidden = hidden.withColumn("names", F.transform("terms", lambda x: x["term"])).select("key", "terms", spans_where(F.col("rest"), TERM, lambda m: F.array_contains(F.col("names"), F.lower(m))).alias("found"))
    instead = lambda x: F.element_at(F.filter("terms", lambda y: y["term"] == F.lower(x["value"])), 1)["instead"]
    hidden = hidden.select("key", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), instead(x).alias("value"))).alias("term"))

    out = keyed.select("row", "key").join(bases.select("key", *KINDS).join(hidden, "key", "full"), "key", "left")
    return out.select("row", *[F.coalesce(k, F.array().cast(SPAN)).alias(k) for k in (*KINDS, "term")])


def spell(kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, by kind and start."""
    each = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    return F.concat_ws(",", *map(each, kinds))


def redacted(text: Column) -> Column:
    """text with [EMAIL] and so on in place of its spans; of overlapping spans the first counts
    and reaches to the end of the last."""
    label = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["value"] if k == "term" else F.lit(f"[{k.upper()}]")).alias("value")))
    spans = F.array_sort(F.concat(*[label(k) for k in (*KINDS, "term")]))
    acc = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        out = F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), s["value"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, acc, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], text.substr(done["at"] + 1, F.length(text)))).otherwise(text)
