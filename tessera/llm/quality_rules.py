"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A bounded sample gives each rule's cost and the joint rejections; rules then run in order of rejection per cost, each measured on what the
earlier ones let through. The order changes the speed and which of several rejecting rules is named, never the verdict."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Rows that the order of rules is measured on; steps of a pattern for one of a plain function.
SAMPLE_ROWS, PATTERN_STEPS = 2048, 4
SPLIT = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """rejects is an SQL expression over text, words and the counts of word_counts()."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("few_letters", r"5 * size(filter(words, w -> NOT w rlike '\\p{L}')) > n_words"),
    Rule("shouting", r"2 * length(regexp_replace(text, '\\P{Lu}+', '')) > word_chars"),
    Rule("exclaiming", r"5 * size(filter(words, w -> endswith(w, '!!'))) > n_words"),
    Rule("bullets", r"10 * size(filter(split(text, '\n'), x -> x rlike '^[\\x20\\x09]*[-*•]')) > 9 * n_lines"),
    Rule("cut_lines", r"10 * size(filter(split(text, '\n'), x -> x rlike '(\\.\\.\\.|…)[\\x20\\x09\\x0D]*$')) > 3 * n_lines"),
)
BASE_FAILS = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where the optimizer moves the expression into a filter or a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window found twice or more in the array.

    The windows' 64-bit hashes are sorted within the row, only where some hash repeats, so a row costs n log n of its own words and nothing is
    exploded or shuffled."""

    def windows(w: Column) -> Column:
        return F.when(F.size(w) > 3, F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))

    def again(s: Column) -> Column:
        """Positions of repeated windows in ascending order."""
        same = lambda x, j: x["h"].eqNullSafe(F.get(s, j)["h"])
        found = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    def covered(positions: Column) -> Column:
        step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(positions, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), step, lambda s: s["n"])

    numbered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(_let(numbered(h), again)))
    return F.coalesce(_let(words, lambda w: _let(windows(w), count)), F.lit(0)).cast("long")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with text (null: empty), words, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    made = {"text", "words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"}
    kept = [c for c in docs.columns if c not in made]
    step = docs.select(*kept, F.coalesce(docs[text_col], F.lit("")).alias("text"))
    step = step.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return step.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size(F.split("text", "\n")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("words")),
    })


def hashed_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """`rows` rows with the least hashes of their id (of their text where docs has no id), so they come from all files alike.

    The hashes are cut first, on the id alone; of rows that tie at the cut (a repeated id) some are left out, so the sample stays bounded."""
    h = F.xxhash64(docs[id_col] if id_col in docs.columns else docs["text"])
    last = docs.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return docs.where(h <= F.lit(last)).limit(rows)


def touched(sample: DataFrame, rules: tuple[Rule, ...]) -> list[float]:
    """What each rule costs a row of the sample: the characters and elements that its expression goes over, each time it names text or words, and one
    for each count that it names. A pattern's steps count PATTERN_STEPS times. Counted, not timed, so one sample gives one order."""
    chars, in_words = sample.agg(F.avg(F.length("text")), F.avg(F.col("word_chars") + F.col("n_words"))).first()
    sizes = {"text": chars, "words": in_words}
    costs = []
    for rule in rules:
        bare = re.sub(r"'(?:[^'\\]|\\.)*'", "", rule.rejects)
        names = re.findall(r"\b[a-z_]+\b(?!\s*\()", bare)
        steps = PATTERN_STEPS if re.search(r"\b(rlike|regexp_\w+)\b", bare) else 1
        costs.append(sum(steps * sizes[n] if n in sizes else 1.0 for n in names))
    return costs


def cascade_order(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per cost on the sample, a bounded table of word_counts(); of a row only a boolean a rule reaches the driver."""
    seen = sample.select(*[F.expr(f"coalesce({r.rejects}, false)").alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    if not seen:
        return list(rules)
    costs = touched(sample, rules)
    left, order = list(range(len(rules))), []
    while left:
        best = max(left, key=lambda i: ((sum(x[i] for x in seen) + 1e-3) / costs[i], -i))
        order.append(rules[best])
        left.remove(best)
        seen = [x for x in seen if not x[best]]
    return order


def verdict(order: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    said = F.when(F.expr(BASE_FAILS), F.lit("base"))
    for rule in order:
        said = said.when(F.expr(rule.rejects), F.lit(rule.name))
    return said


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """docs with the counts, base_failed, kept and rejected_by (base, the rule that rejected first, or null).

    Null and empty texts have no words, so they fail the base test; an empty table gives an empty table; repeated rows are judged alike.
    Columns of docs that bear the names of the counts or verdicts are replaced, and words is dropped. A long text is one row's array of words."""
    sample = word_counts(hashed_sample(docs, id_col=id_col)).select("text", "words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").where(f"NOT ({BASE_FAILS})")
    order = cascade_order(written(sample, "rule-sample"), rules)
    judged = word_counts(docs).withColumn("base_failed", F.expr(BASE_FAILS)).withColumn("rejected_by", verdict(order))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("words")
