"""PII by bootstrapped contextual extraction [native: DataFrame functions only].

Base kinds (email, ip, card, phone) are found by their fixed patterns. Secrets are found by bootstrapping:
 * candidates are identifier-like tokens (at least ``MIN_TOKEN`` letters, digits, - or _, with a digit in them);
 * a candidate occurrence has lexical patterns: the text just before it at three grains (its last three pieces, the
   piece it is glued to, the assignment sign alone) and the two pieces after it, if there is more to them than a space. A piece
   is a run without white space and is never cut: pieces that do not fit in ``CONTEXT`` characters give no pattern. An item of a list
   (nothing but white space, commas and the like since the token before) has the text before its list;
 * seed entities are the base entities that pass their checks, and tokens of well-known secret formats (``SEEDS``);
 * every round scores the pattern-instance graph: a pattern is trusted if at least ``MIN_SUPPORT`` distinct known instances
   occur in it and they are at least ``MIN_CONFIDENCE`` of all its distinct instances; the unknown tokens of trusted patterns become
   known if they have ``MIN_DIGITS`` digits (letters are not asked for: account and tax numbers have none). Rounds end when
   nothing new is learned, so the trusted patterns follow from all known instances.
Occurrences of known tokens in trusted patterns, and all seeds of known formats, are added as spans of kind ``secret``
unless they overlap a base span. A base span that fails its check is dropped, never retried.

Scale: one pass over the texts keeps only matches, gap lengths and ``CONTEXT`` characters around candidates and base entities;
everything after works on these narrow rows. A pattern holding a third of all occurrences is a partial aggregate of its distinct
instances. Learned patterns and instances are joined, never collected; each round is cut by a checkpoint.

Defined results: a null or empty text has no spans; positions are code points, end exclusive; repeated rows get
their spans each; a null id is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymetrics.llm.common import cut

# Fixed patterns of the base kinds. Possessive quantifiers and look-behinds only keep matching linear on long runs:
# they change no match, because no later part can give back what a class has taken.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = ("email", "ip", "card", "phone", "secret")  # in the order of the result
SEEDS = r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40})$"  # well-known formats: access key ids, 160-bit hexadecimal keys
MIN_TOKEN = 8
TOKEN = rf"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{{{MIN_TOKEN},}}+"
MIN_DIGITS = 2  # of a token that becomes known
CONTEXT = 200
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.4
MIN_CARD = 13


def _found(text: Column, pattern: str, hint: Column) -> Column:
    """Matches of a pattern; the hint is a cheap test that is true wherever there is a match."""
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _gaps(text: Column, pattern: str, matches: Column) -> Column:
    """The texts before, between and after the matches."""
    return F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def _pair_of(kind: str):
    """Joins a match with the gaps around it; of these, as much is kept as a context can hold."""
    def pair(match: Column, gaps: Column) -> Column:
        head, tail = F.left(gaps["after"], F.lit(CONTEXT)), F.right(gaps["gap"], F.lit(CONTEXT))
        if kind == "card":  # any number matches
            head, tail = (F.when(F.length(match) >= MIN_CARD, x).otherwise("") for x in (head, tail))
        return F.struct(F.length(gaps["gap"]).alias("gap"), match.alias("match"), tail.alias("tail"), head.alias("head"))

    return pair


def matched(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, and per kind an array of (gap, match, tail, head) in order of position.

    ``gap`` is the length of the text since the match before, ``tail`` its end, ``head`` the beginning of the text up to the match after."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = text.rlike("[0-9]")
    hints = {"email": F.contains(text, F.lit("@")), "ip": digits & text.rlike(r"[0-9]\.[0-9]"), "card": digits,
             "phone": F.contains(text, F.lit("+"))}
    found = docs.select("doc_id", text.alias("text"),
                        *[_found(text, p, hints[k]).alias(k) for k, p in PATTERNS.items()], _found(text, TOKEN, digits).alias("token"))
    # a match that starts a text has an empty gap before it, one that ends it an empty gap after it
    arrays = []
    for k, p in {**PATTERNS, "token": TOKEN}.items():
        gaps = _gaps(F.col("text"), p, F.col(k))
        around = F.zip_with(F.slice(gaps, F.lit(1), F.size(k)), F.slice(gaps, F.lit(2), F.size(k)), lambda x, y: F.struct(x.alias("gap"), y.alias("after")))
        arrays.append(F.zip_with(F.col(k), around, _pair_of(k)).alias(k))
    return found.select("doc_id", *arrays)


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """The check of each base kind; tokens have none."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    n = F.length(digits)
    return (F.when(kind == "ip", match.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$"))
            .when(kind == "card", n.between(MIN_CARD, 19) & F.when(n.between(MIN_CARD, 19), luhn(digits)))
            .when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True)))


def occurrences(rows: DataFrame) -> DataFrame:
    """(rid, kind, start, end, match, before, after) of every match that passes its check.

    ``before`` and ``after`` are the text around the match by position, with the matches next to it in their places; ``before`` starts
    with a newline where it reaches the start of the text, ``after`` ends with one at its end."""
    tagged = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in (*PATTERNS, "token")])
    each = rows.select("rid", F.explode(tagged).alias("t")).select("rid", "t.kind", F.posexplode("t.found").alias("i", "f"))
    order = W.partitionBy("rid", "kind").orderBy("i")
    each = each.select("rid", "kind", "i", "f.match", "f.tail", "f.head", "f.gap", F.length("f.match").alias("n"))
    end = F.sum(F.col("gap") + F.col("n")).over(order)

    def beside(name: str, by: int) -> Column:
        cut_off = F.right(name, F.lit(CONTEXT)) if by > 0 else F.left(name, F.lit(CONTEXT))
        edge = F.lit("\n") if name != "match" else F.lit("")
        return F.coalesce((F.lag if by > 0 else F.lead)(cut_off, abs(by)).over(order), edge)

    # three matches back and two ahead hold any three pieces before and two after, but for pieces of several tokens each
    before = F.concat(beside("tail", 3), beside("match", 3), beside("tail", 2), beside("match", 2), beside("tail", 1), beside("match", 1), "tail")
    before = F.concat(F.when(F.col("i") <= 3, F.lit("\n")).otherwise(F.lit("")), before)
    after = F.concat("head", beside("match", -1), beside("head", -1), beside("match", -2), beside("head", -2))
    listed = (F.col("kind") == "token") & (F.col("i") > 0) & F.col("tail").rlike(r"^[\s,;|]+$") & (F.length("tail") == F.col("gap"))
    each = (each.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
            .withColumn("own", F.when(~listed, F.right(before, F.lit(CONTEXT)))).withColumn("after", F.left(after, F.lit(CONTEXT)))
            .withColumn("before", F.last("own", ignorenulls=True).over(order)))
    return (each.filter(valid(F.col("kind"), F.col("match")))
            .select("rid", "kind", F.col("start").cast("long"), F.col("end").cast("long"), "match", "before", "after"))


def free_tokens(found: DataFrame) -> DataFrame:
    """Tokens that overlap no base span: a sweep over each document's spans by position."""
    base = F.col("kind") != "token"
    order = W.partitionBy("rid").orderBy("start", "end")
    left = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    right = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    return (found.withColumn("left", left).withColumn("right", right)
            .filter(~base & (F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.col("right").isNull() | (F.col("right") >= F.col("end"))))
            .select("rid", "start", "end", F.col("match").alias("instance"), "before", "after"))


def lexical_patterns(before: Column, after: Column) -> Column:
    """The distinct patterns of the text around a token, digits as 0; none of them is mere white space.

    A piece counts only if it is whole: there is white space (or the newline that stands for the text's edge) at its outer end."""
    before, after = (F.regexp_replace(F.lower(x), "[0-9]", "0") for x in (before, after))
    pieces = F.regexp_extract(before, r"\s(\S+\s+\S+\s+\S*)$", 1)
    glued = F.regexp_extract(before, r"\s(\S+)$", 1)
    sign = F.regexp_extract(before, r"([=:])\s*[\"'`(\[<]*\s*$", 1)
    following = F.regexp_extract(after, r"^([^\s\p{L}]*\s+\S+\s+\S+)\s", 1)
    named = F.array(*[F.when(x != "", F.concat(F.lit(f"{name} "), x)) for name, x in
                      (("pieces", pieces), ("glued", glued), ("sign", sign), ("following", following))])
    return F.filter(named, lambda x: x.isNotNull())


def trusted_patterns(graph: DataFrame, known: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """Patterns whose seeds and known instances are enough, and a large enough share of all their instances."""
    marked = graph.join(known.withColumn("known", F.lit(True)), "instance", "left")
    support = F.count(F.when(F.col("seed") | F.col("known"), 1))
    return (marked.groupBy("pattern").agg(support.alias("support"), F.count(F.lit(1)).alias("all"))
            .filter((F.col("support") >= min_support) & (F.col("support") >= min_confidence * F.col("all"))).select("pattern"))


def bootstrap(entities: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns and known tokens besides the seeds, learned from entities (instance, before, after, base)."""
    seed = F.col("base") | F.col("instance").rlike(SEEDS)
    graph = cut(entities.select("instance", seed.alias("seed"), F.explode(lexical_patterns(F.col("before"), F.col("after"))).alias("pattern"))
                .groupBy("instance", "pattern").agg(F.max("seed").alias("seed")))
    known, size = graph.select("instance").limit(0), 0
    learnable = graph.filter(~F.col("seed") & (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= MIN_DIGITS)).select("instance", "pattern")
    while True:  # the known instances only grow, so this ends
        trusted = cut(trusted_patterns(graph, known, min_support, min_confidence))
        known = cut(learnable.join(trusted, "pattern").select("instance").unionByName(known).distinct())
        before, size = size, known.count()
        if size == before:
            return trusted, known


def secrets(tokens: DataFrame, base: DataFrame, **settings) -> DataFrame:
    """(rid, start, end) of seeds among the tokens, and of known instances where a trusted pattern stands before them."""
    entities = tokens.select("instance", "before", "after", F.lit(False).alias("base")).unionByName(
        base.select(F.col("match").alias("instance"), "before", "after", F.lit(True).alias("base")))
    trusted, known = bootstrap(entities, **settings)
    seeds = tokens.filter(F.col("instance").rlike(SEEDS)).select("rid", "start", "end")
    learned = (tokens.join(known, "instance").select("rid", "start", "end", F.explode(lexical_patterns(F.col("before"), F.col("after"))).alias("pattern"))
               .join(trusted, "pattern").select("rid", "start", "end"))
    return seeds.unionByName(learned).distinct()


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_secret, base (listed base spans), spans (all, listed)."""
    rows = cut(matched(docs)).withColumn("rid", F.monotonically_increasing_id())
    found = cut(occurrences(rows))
    added = secrets(cut(free_tokens(found)), found.filter("kind <> 'token'"), **settings).select("rid", F.lit("secret").alias("kind"), "start", "end")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    every = found.filter("kind <> 'token'").select("rid", "kind", "start", "end").unionByName(added)
    per_doc = every.groupBy("rid").agg(
        F.collect_list(F.struct(number.alias("k"), "start", "end")).alias("spans"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS])
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")
    joined = rows.select("rid", "doc_id").join(per_doc, "rid", "left").withColumn("spans", F.coalesce("spans", none))
    base = F.filter("spans", lambda s: s["k"] < len(PATTERNS))
    return joined.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                         _listed(base).alias("base"), _listed(F.col("spans")).alias("spans"))
