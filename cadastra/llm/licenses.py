"""License scans by ordered signature rules, inside each row.

A keyword prefilter decides which rules are tried on a text at all. Their matches are intervals of
words; an interval inside another is suppressed unless its rule has the larger priority, equal
intervals go to the larger priority, then the earlier rule. DataFrame functions only, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed
from .license_rules import RULES, SignatureRule

#: Phrases whose places are all counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after
CONFIDENCE = {1: 0.4, 2: 0.8, 3: 0.95}


def spaced(text: Column) -> Column:
    """Lower-case words with one space before, between and after them."""
    words = F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_regex(phrase: str) -> str:
    return f"(?<= ){phrase}(?= )"


#: Put before and after each match; no word holds them.
OPEN, CLOSE = "\x01", "\x02"


def marked(norm: str, rule: SignatureRule) -> str:
    """SQL of the text with the rule's matches between marks, beside the rule's properties; null without a match."""
    regex = f"r'{rule.regex}'"
    properties = f"'label', '{rule.label}', 'priority', {rule.priority}, 'order', {rule.order}"
    return f"CASE WHEN rlike({norm}, {regex}) THEN named_struct('text', regexp_replace({norm}, {regex}, '{OPEN}$0{CLOSE}'), {properties}) END"


def places(match: Column) -> Column:
    """Intervals of words, from first to last, between the marks of ``marked``, in the order in which ``surviving`` takes them."""
    words = F.split(F.trim(match["text"]), " ")
    ends = lambda test: F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    return F.transform(
        F.arrays_zip(ends(lambda w: F.startswith(w, F.lit(OPEN))).alias("first"), ends(lambda w: F.endswith(w, F.lit(CLOSE))).alias("last")),
        lambda x: F.struct(x["first"].alias("first"), (-x["last"]).alias("minus_last"), (-match["priority"]).alias("minus_priority"), match["order"].alias("order"), match["label"].alias("label")),
    )


STRIDE = 128  # detections of a stretch; a long list is put together from stretches, so that appending copies little


def surviving(found: Column) -> Column:
    """The intervals of the sorted ``found``, a column of its own, that no other one suppresses.

    One by one in the order of their first words, the longer, the more important and the earlier rule
    first: whatever can suppress an interval stands before it, and does so if its priority is no less
    and it ends no earlier. So the furthest end of each priority so far is all that has to be kept.
    """
    kind = "array<struct<first:int,last:int,label:string,priority:int,order:int>>"
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STRIDE).cast("int")), lambda i: F.slice(found, i * STRIDE + 1, F.lit(STRIDE)))
    none = F.array().cast(kind)

    def step(s: Column, d: Column) -> Column:
        last, priority = -d["minus_last"], -d["minus_priority"]
        # e_p: the furthest end of priorities p and above
        reach = F.when(priority == 3, s["e3"]).when(priority == 2, s["e2"]).otherwise(s["e1"])
        kept = F.struct(d["first"].alias("first"), last.alias("last"), d["label"].alias("label"), priority.alias("priority"), d["order"].alias("order"))
        ends = [F.when(priority >= p, F.greatest(s[f"e{p}"], last)).otherwise(s[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3)]
        return F.struct(*ends, F.when(reach < last, F.concat(s["now"], F.array(kept))).otherwise(s["now"]).alias("now"))

    # a step copies its state, so what is done stays out of it
    begun = lambda s: F.struct(*(s[f"e{p}"].alias(f"e{p}") for p in (1, 2, 3)), none.alias("now"))
    start = F.struct(F.struct(*(F.lit(-1).alias(f"e{p}") for p in (1, 2, 3)), none.alias("now")).alias("s"), F.array().cast(f"array<{kind}>").alias("done"))
    both = lambda x: F.concat(x["done"], F.array(x["s"]["now"]))
    walked = F.aggregate(stretches, start, lambda x, stretch: F.struct(F.aggregate(stretch, begun(x["s"]), step).alias("s"), both(x).alias("done")), lambda x: F.flatten(both(x)))
    return F.when(F.size(found) > 0, walked).otherwise(none)


def scan(df: DataFrame, rules: tuple[SignatureRule, ...] = RULES, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """``id_columns``, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    ``detections`` lists what is left after suppression: first and last word, label, priority, order.
    Base phrases count at all their places, and their labels stay, suppressed or not. The score is
    1 with a base phrase, else the confidence of the best detection, else 0. Whole texts, at a cost in
    proportion to their length for each rule that matches; null has no words and no detections. Rows with null or repeated ids are scanned each; an empty table gives an
    empty table; other columns are ignored.
    """
    rows = renamed(df, [*dict.fromkeys([*id_columns, text_column])])
    text = F.coalesce(F.col(f"in_{text_column}"), F.lit(""))
    keywords = sorted({r.keyword for r in rules} | {"license", "cc"})
    gate = "(?i)(?<![0-9a-z])(?:" + "|".join(keywords) + ")(?![0-9a-z])"
    rows = rows.select(*(F.col(f"in_{c}").alias(c) for c in id_columns), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(text.rlike(gate), spaced(text)).alias("_norm"))
    norm = F.col("_norm")
    # patterns are constants, so that each is compiled once a task
    tried = {k: ", ".join(marked("_norm", r) for r in rules if r.keyword == k) for k in keywords}
    by_keyword = ", ".join(f"CASE WHEN contains(_norm, ' {k} ') THEN array_compact(array({rules_of})) END" for k, rules_of in tried.items() if rules_of)
    found = F.when(norm.isNotNull(), F.flatten(F.transform(F.expr(f"flatten(array_compact(array({by_keyword})))"), places)))
    base = []
    for phrase, label in BASE:
        parts = F.split(norm, phrase_regex(phrase), -1)
        size = phrase.count(" ") + 1
        hit = F.contains(norm, F.lit(f" {phrase} "))
        n = F.size(parts) - 1
        first = spaces(F.element_at(parts, 1)) - 1
        last = F.col("n_words").cast("int") - size - (spaces(F.element_at(parts, -1)) - 1)
        base.append(F.when(hit, F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"), F.lit(label).alias("label"))))
    rows = rows.select("*", F.array_compact(F.array(*base)).alias("_base"), found.alias("_found"))
    rows = rows.withColumn("_found", F.array_sort(F.coalesce(F.col("_found"), F.array().cast(rows.schema["_found"].dataType))))
    rows = rows.withColumn("detections", surviving(F.col("_found")))
    base_labels = F.array_sort(F.transform("_base", lambda b: b["label"]))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))))
    best = F.array_max(F.transform("detections", lambda d: d["priority"]))
    score = F.when(F.size("_base") > 0, F.lit(1.0)).when(best == 3, F.lit(CONFIDENCE[3])).when(best == 2, F.lit(CONFIDENCE[2])).when(best == 1, F.lit(CONFIDENCE[1])).otherwise(F.lit(0.0))
    return rows.select(
        *id_columns, "n_words",
        F.aggregate("_base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda b: b["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections",
    )
