"""Personal data: pattern spans, and terms that give protected values away.

Base spans are matches of four patterns.  On top of them comes information-theoretic
sanitisation: a value that is masked may still be revealed by the words that keep its
company.  With n(.) texts of N, a term t in the texts of a value e has

    PMI(e; t) = log2(N (n(e, t) - d) / (n(e) n(t))),     IC(e) = -log2(n(e) / N),

and discloses e when PMI >= alpha * IC.  All counts are of whole, different texts, so
copies of one text prove nothing.  The discount d = 1/2 smooths small counts: what is
seen in one text weighs half, and discloses once N is large enough for that to matter
less than the value's rarity (N >= 1024 for alpha = 0.9), so no value is too rare to
have terms.  In every document that holds e, all mentions of its disclosing terms
become spans of kind ``term``; documents without personal data are left alone.

Values that occur in the same texts have the same counts and are looked at once.  As
n(e, t) <= n(e), a term can disclose only if n(t) < N^(1 - alpha) n(e)^alpha, so the
more frequent words of a text are never paired with its values.

All is done with Spark's own functions.  Matches and what lies between them are taken
with the same pattern, and running sums of their lengths give positions.  Patterns
start at the first character of a run only (or where the last match ended) and are
possessive where that changes nothing, so long runs of one character cost linear time.

Cases: null texts count as empty; repeated rows are reported each; ties don't occur,
as spans of one kind never overlap; very long texts are searched whole; columns besides
id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .columns import running_sums
from .scratch import Scratch

#: Kinds in the order in which they are reported, with their patterns and what a match has to hold.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "true", "instr(t, '@') > 0"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"forall(split(m, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false))", "instr(t, '.') > 0"),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9])++", r"length(regexp_replace(m, '[ -]', '')) between 13 and 19 and luhn_check(regexp_replace(m, '[ -]', ''))", "true"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"length(regexp_replace(m, '[^0-9]', '')) between 9 and 15", "instr(t, '+') > 0"),
}
#: Runs of digits, ASCII letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPAN = "struct<start:int,stop:int,value:string>"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str) -> str:
    """SQL over ``t``: array of (start, stop, value) of all matches, valid or not."""
    q = _quote(pattern)
    lens = "transform(ms, (m, i) -> length(segs[i]) + if(i > 0, length(ms[i - 1]), 0))"
    built = f"transform({running_sums(lens)}, (s, i) -> named_struct('start', s, 'stop', s + length(ms[i]), 'value', ms[i]))"
    return f"transform(array(regexp_extract_all(t, {q}, 0)), ms -> if(size(ms) = 0, cast(array() as array<{_SPAN}>), transform(array(split(t, {q}, -1)), segs -> {built})[0]))[0]"


def _base(text: str) -> F.Column:
    """A struct with the valid spans of each kind."""
    parts = []
    for kind, (pattern, valid, hint) in KINDS.items():
        kept = f"filter({_matches(pattern)}, x -> transform(array(x.value), m -> {valid})[0])" if valid != "true" else _matches(pattern)
        parts.append(f"'{kind}', if({hint}, {kept}, cast(array() as array<{_SPAN}>))")
    return F.expr(f"transform(array(coalesce({text}, '')), t -> named_struct({', '.join(parts)}))[0]")


def _words(text: str) -> str:
    """SQL: the different words of a text that can be terms."""
    return f"array_distinct(filter(transform(regexp_extract_all({text}, {_quote(WORD)}, 0), w -> lower(w)), w -> length(w) >= 3 and not w rlike '^[0-9]+$'))"


def _texts(kind: str, spans: str) -> str:
    return f"transform({spans}, x -> concat('{kind}:', x.start, ':', x.stop))"


def find(
    docs: DataFrame,
    alpha: float = 0.9,
    discount: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text where it has spans, base (struct of span arrays), terms (spans)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    based = source.withColumn("base", _base("text"))
    some = F.expr(" + ".join(f"size(base.{k})" for k in KINDS)) > 0
    # Text is kept only for documents with spans; the rest needs none any more.
    seen = scratch.save(based.select("rid", "doc_id", F.when(some, F.col("text")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "base"))
    held = seen.where(F.col("text").isNotNull())
    disclosing = _disclosing(scratch, docs, seen, alpha, discount, text_col)
    hits = held.join(disclosing, "key").select("rid", _term_spans().alias("terms"))
    return seen.join(hits, "rid", "left").select("doc_id", "text", "base", F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int>>")).alias("terms"))


def _disclosing(scratch: Scratch, docs: DataFrame, seen: DataFrame, alpha: float, discount: float, text_col: str) -> DataFrame:
    """(key, ts): for each text, its terms whose PMI with one of its values reaches alpha times that value's information content."""
    held = seen.where(F.col("text").isNotNull())
    every = "concat(" + ", ".join(f"transform(base.{k}, x -> concat('{k}:', lower(x.value)))" for k in KINDS) + ")"
    values = scratch.save(held.select("key", F.explode(F.expr(f"array_distinct({every})")).alias("e")).distinct())
    if values.isEmpty():
        return values.select("key", F.array("e").alias("ts"))
    total = float(seen.select("key").distinct().count())
    # Values with equal ``c`` occur in the same texts.
    same = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    n_e = values.groupBy("e").agg(F.count(F.lit(1)).alias("n_e"), *same).select("e", F.struct("n_e", "h1", "h2").alias("c"))
    classes = scratch.save(values.join(n_e, "e").select("key", "c").distinct())
    different = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text")).groupBy("key").agg(F.first("text").alias("text"))
    # Counted before the join: the counts of all words are far fewer rows than their mentions.
    n_t = different.select(F.explode(F.expr(_words("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    bound = lambda n: F.pow(F.lit(total), F.lit(1 - alpha)) * F.pow(n.cast("double"), F.lit(alpha)) * (1 + 1e-9)
    most = classes.agg(F.max("c.n_e").alias("n")).first()["n"]
    terms = held.select("key", F.explode(F.expr(_words("text"))).alias("t")).distinct().join(n_t.where(F.col("n_t") <= bound(F.lit(most))), "t")
    pairs = scratch.save(classes.join(terms, "key").where(F.col("n_t") <= bound(F.col("c.n_e"))).select("key", "c", "t", "n_t"))
    ic = F.log2(F.lit(total) / F.col("c.n_e"))
    pmi = F.log2(F.lit(total) * (F.col("n_et") - F.lit(discount)) / (F.col("c.n_e").cast("double") * F.col("n_t")))
    given = pairs.groupBy("c", "t", "n_t").agg(F.count(F.lit(1)).alias("n_et")).where((ic > 0) & (pmi >= F.lit(alpha) * ic)).select("c", "t")
    return scratch.save(pairs.join(given, ["c", "t"]).groupBy("key").agg(F.collect_set("t").alias("ts")))


def _term_spans() -> F.Column:
    """Mentions of the terms ``ts`` in ``text`` that no base span touches."""
    spans = "filter(" + _matches(WORD) + ", x -> array_contains(ts, lower(x.value)))"
    free = " and ".join(f"not exists(base.{k}, y -> y.start < x.stop and x.start < y.stop)" for k in KINDS)
    return F.expr(f"transform(filter(transform(array(text), t -> {spans})[0], x -> {free}), x -> named_struct('start', x.start, 'stop', x.stop))")


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans, by document."""
    base = "concat(" + ", ".join(_texts(k, f"base.{k}") for k in KINDS) + ")"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(base.{k}) as bigint)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(f"array_join({base}, ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(concat({base}, {_texts('term', 'terms')}), ',')").alias("spans"),
        F.expr("cast(size(terms) as bigint)").alias("n_term"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and text with base spans generalised to their kind, and disclosing terms removed.

    Rows without spans have a null ``clean_text``: their text stays as it is.  Where
    spans of different kinds overlap, the first in the order of ``KINDS`` stands.
    """
    found = find(docs, id_col=id_col, text_col=text_col, **options)
    marks = "concat(" + ", ".join(f"transform(base.{k}, x -> named_struct('start', x.start, 'stop', x.stop, 'mark', '[{k.upper()}]'))" for k in KINDS) + ", transform(terms, x -> named_struct('start', x.start, 'stop', x.stop, 'mark', '')))"
    ordered = (
        f"aggregate(array_sort({marks}), named_struct('at', 0, 'out', ''), "
        "(a, x) -> if(x.start < a.at, a, named_struct('at', x.stop, 'out', concat(a.out, substr(text, a.at + 1, x.start - a.at), x.mark))), "
        "a -> concat(a.out, substr(text, a.at + 1)))"
    )
    return found.select(F.col("doc_id").alias(id_col), F.when(F.col("text").isNotNull(), F.expr(ordered)).alias("clean_text"))
