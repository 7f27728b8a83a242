"""Personal data: base kinds by pattern, and bootstrapped contextual extraction of further ones.

Base spans are leftmost matches of four patterns with a check each. They seed a graph of lexical
patterns (the one or two words before an identifier, or the word after it) and instances
(identifiers): a pattern's score is the share of its instances that are believed to be of a kind,
an instance is believed as much as its best pattern, and a few rounds spread belief. Instances
beyond a threshold, in the place of a pattern beyond it too, are reported as found. Further seeds
are identifiers of a telling shape (``Settings.shapes``): alone they are not reported, but where
a pattern of high score stands beside them they are, and so is what else stands there.

Only DataFrame functions. The patterns below match what the plain ones match; possessive
quantifiers and looks behind keep them linear on long texts.

Defined cases: a null text counts as empty and has no spans; repeated rows get equal results; an
empty table gives an empty table; input columns other than id and text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

# The kinds in the order that breaks ties, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text may hold the kind at all.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
SPACE = r"\x20\x09-\x0D"
#: A run of non-blank characters that holds a digit or an at sign.
MENTION = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
CORE = r"^([^A-Za-z0-9]*+)([A-Za-z0-9](?:.*[A-Za-z0-9])?)"


#: Two hashes name a row's id and text, whether null or not.
KEY = ["row_key", "text_key"]


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    min_digits: int = 4  # an identifier has so many digits at least, or an at sign
    shapes: tuple[tuple[str, str], ...] = (("secret", "^[0-9a-f]{32,}$"),)  # kind and pattern of further seeds
    min_support: int = 3  # different seeds that a pattern needs
    smoothing: float = 1.0
    threshold: float = 0.8


def let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once; plain reuse in a lambda computes it each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column, chunk: int = 128) -> Column:
    """For each element the sum of those before it, by chunks so that long arrays stay cheap."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    before = lambda x: F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i)))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int")), lambda c: F.slice(x, c * chunk + 1, F.lit(chunk)))
    add = lambda offsets, x: F.transform(before(x), lambda v: v + offsets)
    made = let(lengths, lambda x: let(cut(x), lambda parts: let(before(F.transform(parts, total)), lambda sums: F.transform(parts, lambda c, k: let(c, lambda y: add(F.get(sums, k), y))))))
    return F.when(F.size(lengths) > 0, F.flatten(made)).otherwise(F.array().cast("array<bigint>"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Digits pass the check sum: every second one from the right counts double, less 9 above 9."""
    places = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int"))
    worth = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}$")
    if kind == "card":
        return F.when(F.length(digits(found)).between(12, 19), luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def bare(word: Column) -> Column:
    return F.regexp_replace(word, r"^[.,;!?()]+|[.,;!?()]+$", "")


def context(gap: Column, after: Column) -> Column:
    """The last two words of the text before and the first of the text after, in lower case,
    without marks at their ends; the word after follows at once or behind one blank."""
    words = F.filter(F.split(F.lower(F.substring(gap, -60, 60)), rf"[{SPACE}]+"), lambda w: w != "")
    last = F.transform(F.slice(F.concat(F.array(F.lit(""), F.lit("")), words), -2, 2), bare)
    return F.concat(last, F.array(bare(F.regexp_extract(F.lower(F.substring(after, 1, 60)), rf"^[{SPACE}]*+([^{SPACE}]*+)", 1))))


def located(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """Adds the column ``name``: text, start, end and context of every match of ``pattern`` in __text."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__found", F.when(gate, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("__gaps", F.when(F.size("__found") > 0, F.split("__text", pattern, -1)).otherwise(none))
    pairs = F.transform("__found", lambda m, i: (F.length(F.get("__gaps", i)) + F.length(m)).cast("long"))
    df = df.withColumn("__lengths", pairs).withColumn("__before", running(F.col("__lengths")))
    made = F.transform(
        "__found",
        lambda m, i: F.struct(
            m.alias("text"),
            (F.get("__before", i) + F.length(F.get("__gaps", i))).alias("start"),
            (F.get("__before", i) + F.get("__lengths", i)).alias("end"),
            context(F.get("__gaps", i), F.get("__gaps", i + 1)).alias("context"),
        ),
    )
    return df.withColumn(name, made).drop("__found", "__gaps", "__lengths", "__before")


def mention_gate(min_digits: int) -> str:
    """So many digits in one run of non-blank characters, next to each other or not."""
    return rf"[0-9](?:[^{SPACE}0-9]*+[0-9]){{{max(min_digits - 1, 0)}}}"


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, KEY, base spans and identifier-like mentions; the text itself is left behind."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    df = df.withColumn("row_key", F.xxhash64("doc_id", "__text")).withColumn("text_key", F.xxhash64("__text"))
    for kind in KINDS:
        df = located(df, f"__{kind}", PATTERNS[kind], GATES[kind](F.col("__text")))
    df = located(df, "__mention", MENTION, F.col("__text").contains("@") | F.col("__text").rlike(mention_gate(settings.min_digits)))

    def base_spans(rank: int, kind: str) -> Column:
        good = F.filter(f"__{kind}", lambda s: passes(kind, s["text"]))
        return F.transform(
            good,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"),
                s["text"].alias("text"), s["context"].alias("context"),
            ),
        )

    def trimmed(s: Column) -> Column:
        start = s["start"] + F.length(F.regexp_extract(s["text"], CORE, 1))
        core = F.regexp_extract(s["text"], CORE, 2)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("text"), s["context"].alias("context"))

    mentions = F.filter(F.transform("__mention", trimmed), lambda s: s["text"].contains("@") | (F.length(digits(s["text"])) >= settings.min_digits))
    return df.select("doc_id", *KEY, F.array_sort(F.concat(*(base_spans(i, k) for i, k in enumerate(KINDS)))).alias("base"), mentions.alias("mentions"))


def patterns_of(words: Column) -> Column:
    """The patterns of a context: one word before, two words before, the word after."""
    word = lambda i: F.get(words, F.lit(i))
    made = F.array(F.concat(word(1), F.lit(" _")), F.concat(word(0), F.lit(" "), word(1), F.lit(" _")), F.concat(F.lit("_ "), word(2)))
    # A pattern has a letter or digit, or a mark such as = or : that is no mere end of a sentence.
    return F.filter(F.array_distinct(F.transform(made, F.trim)), lambda p: F.length(F.regexp_replace(p, "[_ |]", "")) > 0)


def discover(scanned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """KEY, kind, start, end of identifiers that bootstrapping adds to the base spans."""
    base = scanned.select(*KEY, F.explode("base").alias("s")).select(
        *KEY, "s.start", "s.end", "s.kind", "s.text", "s.context"
    )
    shape = F.coalesce(*(F.when(F.col("s.text").rlike(p), k) for k, p in settings.shapes), F.lit(None).cast("string"))
    seen = scanned.select(*KEY, F.explode("mentions").alias("s")).select(
        *KEY, "s.start", "s.end", shape.alias("kind"), "s.text", "s.context"
    )
    # Mentions that overlap a base span are that span, not news; repeated rows count once.
    near = scanned.select(*KEY, F.size("base").alias("n")).filter("n > 0").select(*KEY).distinct()
    covered = (
        seen.join(near, KEY, "left_semi").distinct().alias("m")
        .join(base.distinct().alias("b"), KEY)
        .filter("m.start < b.end AND b.start < m.end")
        .select(*KEY, "m.start")
    ).distinct()
    fresh = seen.distinct().join(covered, [*KEY, "start"], "left_anti").withColumn("new", F.lit(True))
    both = fresh.unionByName(base.distinct().withColumn("new", F.lit(False)))
    occurrences = stored(both.withColumn("pattern", F.explode(patterns_of(F.col("context")))).drop("context"), "pii-occurrences")
    edges = stored(occurrences.groupBy("pattern", "text").agg(F.max("kind").alias("kind")), "pii-edges")
    support = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    belief = edges.filter("kind IS NOT NULL").select("text", "kind", F.lit(1.0).alias("belief")).distinct()
    seeds = belief
    for _ in range(settings.rounds):
        scores = score_patterns(edges, support, belief, settings)
        spread = (
            edges.filter("kind IS NULL").select("pattern", "text").join(scores, "pattern")
            .groupBy("text", "kind").agg(F.max("score").alias("belief"))
        )
        belief = stored(seeds.unionByName(spread), "pii-belief")
    scores = score_patterns(edges, support, belief, settings)
    sure = belief.filter(F.col("belief") >= settings.threshold).select("text", "kind").distinct()
    return (
        occurrences.filter("new").drop("kind")
        .join(scores.filter(F.col("score") >= settings.threshold), "pattern")
        .join(sure, ["text", "kind"], "left_semi")
        .groupBy(*KEY, "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    )


def score_patterns(edges: DataFrame, support: DataFrame, belief: DataFrame, settings: Settings) -> DataFrame:
    """pattern, kind, score: believed instances of the kind over all instances of the pattern."""
    held = (
        edges.select("pattern", "text").join(belief, "text")
        .groupBy("pattern", "kind")
        .agg(F.sum("belief").alias("held"), F.sum(F.when(F.col("belief") == 1.0, 1).otherwise(0)).alias("seeds"))
        .filter(F.col("seeds") >= settings.min_support)
    )
    return held.join(support, "pattern").select("pattern", "kind", (F.col("held") / (F.col("instances") + settings.smoothing)).alias("score"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, KEY, ``base`` and ``spans`` (base and found) of each document.

    Spans are structs start, rank, kind, end in code points, sorted; ``end`` is exclusive.
    """
    scanned = stored(scan(docs, settings), "pii-scan")
    ranks = F.create_map(*(F.lit(x) for i, k in enumerate(dict.fromkeys([*KINDS, *(k for k, _ in settings.shapes)])) for x in (k, i)))
    span = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    found = discover(scanned, settings).groupBy(*KEY).agg(
        F.collect_list(F.struct("start", ranks[F.col("kind")].alias("rank"), "kind", "end")).alias("found")
    )
    base = scanned.select("doc_id", *KEY, F.transform("base", span).alias("base"))
    spans = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast(base.schema["base"].dataType))))
    return base.join(found, KEY, "left").select("doc_id", *KEY, "base", spans.alias("spans"))


def counts(found: DataFrame) -> DataFrame:
    """The digest columns of ``find``'s rows: base spans by kind, and both lists of spans as text."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; rows and columns stay."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", text)).withColumn("__key", F.xxhash64(text))
    spans = find(docs, settings).filter(F.size("spans") > 0).groupBy(*KEY).agg(F.first("spans").alias("__spans"))
    spans = spans.toDF("__row", "__key", "__spans")
    # Overlapping spans become one, named after the first.
    at = lambda s, text: F.struct(
        F.concat(s["out"], F.substring(F.col("text"), (s["to"] + 1).cast("int"), (text["start"] - s["to"]).cast("int")), F.lit("["), text["kind"], F.lit("]")).alias("out"),
        text["end"].alias("to"),
    )
    merged = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.when(x["start"] >= s["to"], at(s, x)).otherwise(F.struct(s["out"].alias("out"), F.greatest(s["to"], x["end"]).alias("to"))),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["to"] + 1).cast("int"), F.lit(2147483647))),
    )
    both = keyed.join(spans, ["__row", "__key"], "left")
    return both.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(merged)).select(*docs.columns)
