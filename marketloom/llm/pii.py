"""Personal data: patterns, and terms whose co-occurrence in the corpus discloses a protected entity.

Base kinds are found by patterns. Every value found is a protected entity c, and so is the part it shares
with others (an address's host, a network, an issuer, a number without its last four digits), with
information IC(c) = -log p(c). A term t discloses PMI(t; c) = log(p(t, c) / (p(t) p(c))) of that, so
PMI / IC = 1 + log p(c | t) / IC; all counts are of distinct texts of the whole corpus, and a text and a
term or an entity meet wherever they stand in it. What a document shows about itself is no evidence:
p(c | t) is the share among the other texts with t, smoothed by `prior` texts that hold c as often as the
corpus does, so a pair seen in one text discloses nothing, and one seen in two does where c is rare.
A term whose share reaches `generalise` becomes a span at every occurrence in every document, and is
generalised to its class; if its own counts (without smoothing) reach `remove` it is removed.

Cases: a null text is empty and has no spans; a value that fails its check is dropped and not tried
again shorter; spans of different kinds may overlap, and sanitising replaces their union once,
under the earliest one's tag; rows with null or repeated ids are rows of their own; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import let, text_or_empty, written
from marketloom.llm.exact_dedup import digest

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Texts that count beside the observed ones of a term, with the corpus share of the entity.
PRIOR = 1.0
GENERALISE = 0.9
REMOVE = 1.0
TERMS = "array<struct<start:int,end:int,removed:boolean>>"
TERM_PATTERN = r"\p{L}[\p{L}\p{N}]{2,}"

#: Stand-ins for a separator inside a number and a dot inside a host name; both keep a text's length.
_JOINT, _DOT, _OTHER = "\ue000", "\ue001", "\ue002"

# A run of characters is matched at once and never given back (++), from its first character or from
# the end of the match before, so no pattern is tried again inside a run that has failed.
_LOCAL = f"A-Za-z0-9._%+{_DOT}-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": f"[0-9][0-9{_JOINT}]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _prepared(kind: str, text: Column) -> Column:
    """The text with the joints of its runs marked, so that a run is a plain row of characters."""
    if kind == "email":
        return F.regexp_replace(F.translate(text, _DOT, _OTHER), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    if kind == "card":
        return F.regexp_replace(F.translate(text, _JOINT, _OTHER), r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)
    return text


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that a text without it cannot hold the kind."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]


def located(text: Column, pattern: str, wanted: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """Wanted matches as an array of (start, end, value); places count characters, the end is exclusive."""
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
    )
    item = "array<struct<start:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(item).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["value"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))).cast(item)
        out = F.when(wanted(x["value"]), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), out.alias("out")))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        def digit(i: Column) -> Column:
            plain = F.substring(d, i + 1, F.lit(1)).try_cast("int")
            twice = plain * 2
            return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(plain)

        return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda acc, i: acc + digit(i))

    size = F.char_length(_digits(value))
    return F.when(size.between(16, 19), total(F.reverse(_digits(value))) % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        small = lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value), by kind as in KINDS and then by start."""
    item = "array<struct<kind:string,start:int,end:int,value:string>>"
    none = F.array().cast(item)

    def of(kind: str) -> Column:
        named = lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.translate(s["value"], _JOINT + _DOT, "-.").alias("value")
        )
        good = F.filter(F.transform(located(_prepared(kind, text), PATTERNS[kind]), named), lambda s: _valid(kind, s["value"]))
        return F.when(_possible(kind, text), good).otherwise(none)

    return F.concat(*[of(kind).cast(item) for kind in KINDS])


def entities_of(spans: Column) -> Column:
    """Distinct protected entities of the spans: each value and the part it shares with others."""

    def both(s: Column) -> Column:
        kind, value, digits = s["kind"], F.lower(s["value"]), _digits(s["value"])
        number = kind.isin("card", "phone")
        part = (
            F.when(kind == "email", F.concat(F.lit("host:"), F.substring_index(value, "@", -1)))
            .when(kind == "ip", F.concat(F.lit("network:"), F.substring_index(value, ".", 3)))
            .when(kind == "card", F.concat(F.lit("issuer:"), F.substring(digits, 1, 6)))
            .otherwise(F.concat(F.lit("prefix:"), F.substring(digits, F.lit(1), F.char_length(digits) - 4)))
        )
        return F.array(F.concat(kind, F.lit(":"), F.when(number, digits).otherwise(value)), part)

    return F.array_distinct(F.flatten(F.transform(spans, both)))


#: Characters of a part of a long text with many spans: places are sought from a part's start, not from the text's.
PART = 2048
FEW = 32


def _replaced(text: Column, pieces: Column) -> Column:
    """The text with the places of `pieces` (start, end, tag; sorted) replaced by their tags; of what overlaps the first tag stands."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, s["tag"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.aggregate(pieces, start, step, rest)


def _rebuilt(text: Column, pieces: Column, fill: str | None = None) -> Column:
    """The text with its `pieces` (start, end, tag; sorted) replaced, by `fill` for every character if given.

    A text with many pieces is rebuilt part by part, each with the pieces in it, so time grows with the
    text and not with its product with the pieces. A piece that goes on in the next part leaves its tag in the first."""

    def within(p: Column, i: Column) -> Column:
        low, high = i * PART, (i + 1) * PART
        here = F.filter(p, lambda s: (s["start"] < high) & (s["end"] > low))
        begin = lambda s: F.greatest(s["start"] - low, F.lit(0))
        end = lambda s: F.least(s["end"] - low, F.lit(PART))
        tag = lambda s: F.repeat(F.lit(fill), end(s) - begin(s)) if fill else F.when(s["start"] < low, "").otherwise(s["tag"])
        return F.transform(here, lambda s: F.struct(begin(s).alias("start"), end(s).alias("end"), tag(s).alias("tag")))

    def body(p: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
        many = F.array_join(F.transform(parts, lambda part, i: let(within(p, i), lambda here: _replaced(part, here))), "")
        return F.when(F.size(p) <= FEW, _replaced(text, p)).otherwise(many)

    return F.when(F.size(pieces) == 0, text).otherwise(let(pieces, body))


def _merged(spans: Column) -> Column:
    """Sorted spans (start, end) with overlapping and touching ones made one."""
    item = "array<struct<start:int,end:int>>"
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(item).alias("out"))
    closed = lambda acc: F.when(acc["start"] < 0, acc["out"]).otherwise(
        F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))
    )

    def step(acc: Column, s: Column) -> Column:
        joined = F.struct(acc["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"), acc["out"].alias("out"))
        return F.when((acc["start"] >= 0) & (s["start"] <= acc["end"]), joined).otherwise(F.struct(s["start"], s["end"], closed(acc).alias("out")))

    return F.aggregate(order, none, step, closed)


def outside(text: Column, spans: Column) -> Column:
    """The text with its spans blanked; places stay the same."""
    blank = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), s["end"] - s["start"]).alias("tag"))
    return F.when(F.size(spans) == 0, text).otherwise(_rebuilt(text, F.transform(_merged(spans), blank), " "))


def found_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row` (a number), `doc` (the columns of `docs`), `base` (spans), `entities` and `digest` of the text."""
    text = F.col(f"doc.{text_col}")
    based = docs.select(F.struct(*docs.columns).alias("doc")).withColumn("base", base_spans(text_or_empty(text)))
    named = based.withColumn("entities", entities_of(F.col("base"))).withColumn("digest", digest(text))
    return named.withColumn("row", F.monotonically_increasing_id())


def _words(text_col: str) -> Column:
    """The text of a found row outside of its base spans."""
    return outside(text_or_empty(F.col(f"doc.{text_col}")), F.col("base"))


def distinct_terms(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)))
    return F.array_distinct(F.transform(found, F.lower))


#: Bits of the map of repeated digests: eight a digest, within these bounds (4 KB and 16 MB are broadcast).
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27


def _bit(bits: int) -> Column:
    """The place of a digest in a map of so many bits, from 1."""
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def distinct_texts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `found` without the copies of a text, and the `row` of every distinct text.

    A bitmap of the digests that occur more than once, of bounded size, tells where the rows are scanned which texts may have
    copies: only those are shuffled, with whole texts, to leave all but the first out. All others stay where they are."""
    groups = written(found.groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "pii-digests")
    repeated = groups.filter("n > 1")
    bits = min(max(LEAST_BITS, 1 << (8 * repeated.count()).bit_length()), MOST_BITS)
    place = _bit(bits)
    maps = repeated.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = found.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket", "left")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    known = known.withColumn("_maybe", maybe).drop("_bucket", "_map")
    firsts = groups.select("row")
    first_copies = known.filter("_maybe").join(firsts, "row", "left_semi")
    return known.filter(~F.col("_maybe")).unionByName(first_copies).drop("_maybe"), firsts


def disclosing_terms(
    found: DataFrame, text_col: str = "text", prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """`term`, `removed` of the terms that disclose an entity, by the counts of all distinct texts."""
    one = F.count(F.lit(1))
    texts, first = distinct_texts(found)
    total = first.agg(one.alias("_n"))
    holders = found.filter(F.size("entities") > 0).select("row", "entities").join(first, "row", "left_semi")
    held = written(holders.select("row", F.explode("entities").alias("entity")), "pii-held")
    # entities of the same texts are judged alike: a list of addresses in two texts is one class, told by sums over its texts
    mark = (F.sum(F.xxhash64("row").cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64("row", F.lit(1))).cast("string"))
    of = held.groupBy("entity").agg(one.alias("_c"), F.concat_ws("/", one.cast("string"), *mark).alias("class"))
    # an entity or a pair of one text has nothing to be judged by: its smoothed share is p(c), its PMI zero or less
    of = written(of.filter(F.col("_c") > 1), "pii-entities")
    shared = of.select("class", "_c").distinct()
    of_row = held.join(of.select("entity", "class"), "entity").groupBy("row").agg(F.collect_set("class").alias("classes"))
    # terms are found before classes are listed, so once a text
    pairs = texts.filter(F.size("entities") > 0).join(of_row, "row").select("classes", distinct_terms(_words(text_col)).alias("terms"))
    pairs = pairs.select(F.explode("classes").alias("class"), "terms")
    seen = pairs.select("class", F.explode("terms").alias("term")).groupBy("class", "term").agg(one.alias("_tc")).filter(F.col("_tc") > 1)
    counts = texts.select(F.explode(distinct_terms(_words(text_col))).alias("term")).groupBy("term").agg(one.alias("_t"))
    joined = seen.join(shared, "class").join(counts, "term").join(F.broadcast(total))
    p = F.col("_c") / F.col("_n")
    ic = -F.log(p)
    share = (F.col("_tc") - 1 + prior * p) / (F.col("_t") - 1 + prior)
    judged = joined.filter(F.col("_c") < F.col("_n")).select(
        "term", (1 + F.log(share) / ic).alias("disclosure"), (1 + F.log(F.col("_tc") / F.col("_t")) / ic).alias("plain")
    )
    return judged.filter(F.col("disclosure") >= generalise).groupBy("term").agg((F.max("plain") >= remove).alias("removed"))


def with_spans(found: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """`found` with `terms`: spans (start, end, removed) of every occurrence of a disclosing term, in order."""
    # both tables are stored, so that the planner knows their size: texts are shuffled only where many documents are concerned
    terms = written(terms, "pii-terms")
    hits = found.select("row", F.explode(distinct_terms(_words(text_col))).alias("term")).join(terms, "term")
    concerned = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("_terms"))
    marked = found.join(written(concerned, "pii-concerned"), "row", "left")
    told = lambda value: F.element_at("_terms", F.lower(value))
    spans = F.transform(
        located(_words(text_col), TERM_PATTERN, lambda value: told(value).isNotNull()),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), told(t["value"]).alias("removed")),
    )
    return marked.withColumn("terms", F.when(F.col("_terms").isNull(), F.array().cast(TERMS)).otherwise(spans.cast(TERMS))).drop("_terms")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`doc_id`, `base`, `terms` of every row: spans without texts."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(found_spans(plain), "pii")
    return with_spans(found, disclosing_terms(found, **options)).select("doc.doc_id", "base", "terms")


def sanitised_text(text: Column, base: Column, terms: Column) -> Column:
    """The text with every span replaced: [EMAIL], [IP], [CARD], [PHONE], and [WORD] or nothing for terms."""
    tags = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("tag"))),
        F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], "").otherwise("[WORD]").alias("tag"))),
    )
    return _rebuilt(text, F.sort_array(tags))


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """`docs` with the personal data of `text_col` replaced; a null text stays null, all else stays as it is.

    length_col: a column, if there is one of that name, that holds the number of characters of the text."""
    found = written(found_spans(docs, text_col), "pii")
    text = F.col(f"doc.{text_col}")
    marked = with_spans(found, disclosing_terms(found, text_col, **options), text_col)
    clean = F.when(text.isNotNull(), sanitised_text(text, F.col("base"), F.col("terms")))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {text_col: clean}
    if length_col in columns:
        changed = F.size("base") + F.size("terms") > 0
        columns[length_col] = F.when(changed, F.char_length(clean).cast(docs.schema[length_col].dataType)).otherwise(columns[length_col])
    return marked.select(*[value.alias(name) for name, value in columns.items()])


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row the number of spans by base kind, a digest of the base spans and the list of all spans."""
    spans = pii_spans(docs, id_col, text_col, **options)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    named = F.transform("terms", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return spans.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat(base, named)).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
