"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers they do not know.

All of it is DataFrame operations. Base spans come from the regular expressions' matches and the gaps between
them. Then every token with a digit, or with =, : or @ before its end, is an instance, with lexical patterns: the word before it, the two
words before it, its own prefix up to = or :, and its leading letters with its length. Seeds are instances that look
like keys (long hexadecimal or upper-case runs) and, at a lower weight, those that are base spans or their beginning:
what stands where emails, addresses and phone numbers stand is probably one too. Pattern and instance scores are updated
in turn over the graph of distinct (pattern, instance) edges; instances that confident patterns vouch for become spans of
kind secret.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.shared import cut

KINDS = ("email", "ip", "card", "phone")
# Each matches what its plain form in the docstring of find_pii() does; the anchors (start of a run, or the end of
# the last match) and possessive quantifiers keep long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "phone": "+"}
TOKEN = r"(?<!\S)[^\s0-9=:@]*+(?:[0-9]|[=:@](?=\S))\S*+"
#: Tokens that are base spans or begin one.
KNOWN = rf"{PATTERNS['email']}|{PATTERNS['ip']}|^\+[0-9][0-9().-]*$"
BLOCK = 64
#: What a base span says of its context; below 1, as base spans also stand in contexts of all kinds.
BASE_WEIGHT = 0.8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(lengths: Column) -> Column:
    """Sum of all earlier elements, for each. By blocks, so a text with very many matches stays near linear."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: add(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def finish(sums: Column) -> Column:
        bases = F.transform(sums, lambda s, i: add(F.slice(sums, F.lit(1), i)))
        return let(bases, lambda base: F.transform(lengths, lambda x, i: F.get(base, F.floor(i / BLOCK).cast("int")) + add(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return let(blocks, finish)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, gap>>: start and end in code points, the match and the text between it and the one before."""
    nothing = F.array().cast("array<struct<s:bigint,e:bigint,m:string,gap:string>>")

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def with_gaps(gap: Column) -> Column:
            lengths = F.zip_with(hits, F.slice(gap, F.lit(1), F.size(hits)), lambda h, g: (F.length(h) + F.length(g)).cast("long"))
            starts = let(lengths, before)
            return F.zip_with(F.zip_with(hits, F.slice(gap, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g"))), starts, lambda x, b: F.struct((b + F.length(x["g"])).alias("s"), (b + F.length(x["g"]) + F.length(x["h"])).alias("e"), x["h"].alias("m"), x["g"].alias("gap")))

        return F.when(F.size(hits) == 0, nothing).otherwise(let(gaps, with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def accepted(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: (F.length(x) <= 3) & (x.cast("int") <= 255))
        return F.forall(F.split(m, r"\."), part)
    if kind in ("card", "phone"):
        low, high = (16, 19) if kind == "card" else (8, 15)
        return let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.length(d).between(low, high) & (luhn(d) if kind == "card" else F.lit(True)))
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, e>> of one kind, in order."""
    found = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda x: accepted(kind, x["m"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    gate = F.contains(text, F.lit(GATES[kind])) if kind in GATES else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]")
    return F.when(gate, found).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def instances(text: Column) -> Column:
    """array<struct<s, e, value, patterns, seed, base>>: tokens, without the quotes and marks around them. seed: weight of what is known of the form alone."""
    bare = r"^[\"'(\[{<]*+((?:[^=:\s]{1,40}[=:])?)[\"'(\[{<]*+(.*?)[\"')\]}>.,;:!?]*$"

    def one(x: Column) -> Column:
        own, value = F.regexp_extract(x["m"], bare, 1), F.regexp_extract(x["m"], bare, 2)
        words = F.filter(F.split(F.right(x["gap"], F.lit(64)), r"\s+"), lambda w: w != "")
        start = x["s"] + F.instr(x["m"], value) - 1
        return F.struct(start.alias("s"), (start + F.length(value)).alias("e"), value.alias("value"), own.alias("own"), words.alias("words"))

    def described(x: Column) -> Column:
        v, w = x["value"], x["words"]
        last, two = F.get(w, F.size(w) - 1), F.concat_ws(" ", F.get(w, F.size(w) - 2), F.get(w, F.size(w) - 1))
        lead = F.regexp_extract(v, "^[A-Za-z]{2,4}", 0)
        patterns = F.array(F.when(F.size(w) > 0, F.concat(F.lit("1 "), last)), F.when(F.size(w) > 1, F.concat(F.lit("2 "), two)), F.when(x["own"] != "", F.concat(F.lit("= "), x["own"])), F.when(F.length(lead) == 4, F.concat(F.lit("a "), lead, F.lit(" "), F.length(v).cast("string"))))
        mixed = v.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")
        key = mixed & (v.rlike("^[0-9a-f]{16,64}$") | v.rlike("^[0-9A-Z]{20,40}$"))
        base = v.rlike(KNOWN)
        seed = F.when(base, BASE_WEIGHT).when(key, 1.0).otherwise(0.0)
        return F.struct(x["s"], x["e"], v.alias("value"), F.array_compact(patterns).alias("patterns"), seed.alias("seed"), base.alias("base"))

    told = lambda x: x["value"].rlike("[0-9@]") | (x["own"] != "")
    found = F.filter(F.transform(matches(text, TOKEN), one), lambda x: F.length(x["value"]).between(6, 256) & told(x))
    kind = "array<struct<s:bigint,e:bigint,value:string,patterns:array<string>,seed:double,base:boolean>>"
    return F.when(text.rlike("[0-9=:@]"), F.transform(found, described).cast(kind)).otherwise(F.array().cast(kind))


def trusted_values(occurrences: DataFrame, rounds: int, least_instances: int, threshold: float) -> DataFrame:
    """Values that the graph vouches for. occurrences: value, patterns, seed.

    A pattern's score is the sum of its instances' scores over their number plus one half; an instance's is what
    its patterns leave of doubt: 1 - product of (1 - score). Seeds keep their weight. Edges are distinct, so a value or
    context that fills a third of the rows counts once; joins are left to Spark, which splits hot patterns.
    """
    values = occurrences.groupBy("value").agg(F.max("seed").alias("seed"))
    edges = cut(occurrences.select("value", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    scores = cut(values.select("value", F.col("seed").alias("score"), "seed"), "pii-values")
    for _ in range(rounds):
        patterns = edges.join(scores, "value").groupBy("pattern").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n"))
        patterns = patterns.filter(F.col("n") >= least_instances).select("pattern", (F.col("sum") / (F.col("n") + 0.5)).alias("trust"))
        doubt = edges.join(patterns, "pattern").groupBy("value").agg(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))).alias("doubt"))
        scores = cut(scores.drop("score").join(doubt, "value", "left").select("value", F.when(F.col("seed") > 0, F.col("seed")).otherwise(F.coalesce(1 - F.exp("doubt"), F.lit(0.0))).alias("score"), "seed"), "pii-values")
    return scores.filter(F.col("score") >= threshold).select("value", "score")


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, least_instances: int = 3, threshold: float = 0.75) -> DataFrame:
    """Spans of personal data in every whole text.

    Base kinds, leftmost non-overlapping each, in code points: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+;
    ip of four dotted numbers up to 255; card of 16 to 19 digits with single blanks or hyphens that pass Luhn; phone
    + and 8 to 15 digits. Returns doc_id, email, ip, card, phone, secret (arrays of struct s, e). A null or empty
    text has no spans; a null doc_id stays; rows alike in id and text get the same spans; an empty table gives no
    rows; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    found = cut(base.select("doc_id", F.xxhash64("doc_id", "body").alias("key"), *[base_spans(F.col("body"), k).alias(k) for k in KINDS], instances(F.col("body")).alias("found")), "pii-spans")
    seen = found.filter(F.size("found") > 0).select("key", F.explode("found").alias("x")).select("key", "x.*")
    trusted = trusted_values(seen, rounds, least_instances, threshold)
    extra = seen.filter(~F.col("base")).join(trusted, "value").select("key", F.struct("s", "e").alias("span")).distinct().groupBy(F.col("key").alias("of_key")).agg(F.array_sort(F.collect_list("span")).alias("secret"))
    joined = found.join(extra, F.col("key") == F.col("of_key"), "left")
    return joined.select("doc_id", *KINDS, F.coalesce("secret", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("secret"))


def span_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, kinds in the given order."""

    def named(kind: str) -> Column:  # a second parameter of the lambda, even one with a default, would be the index
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    return F.concat_ws(",", *map(named, kinds))
