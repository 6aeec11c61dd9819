"""Secret scans in DataFrame functions alone: pattern spans, and spans that a battery of randomness tests takes for keys.

A candidate is a key if the battery doesn't reject that it is random (which bounds the share of keys among what is let go), and a likelihood ratio
rejects that it is made like words and names (which bounds the share of names among what is flagged)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Kind, pattern, group that is measured, its least length. Letters of the assignment's words may be in either case.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs of [0-9a-f]+ are taken whole, so this finds those of 24 or more
)
#: Runs that the battery tests; = only pads their end, so a name and its value are two runs. A key has a letter and a digit; shorter runs leave the tests without power.
CANDIDATE, LEAST = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?", 20
_DIGITS, _UP, _LOW = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order they are inferred: name, what the run looks like, alphabet.
ENCODINGS = (
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"), ("HEX", "[0-9A-F]+", _DIGITS + "ABCDEF"), ("base32", "[A-Z2-7]+", _UP + "234567"), ("base36", "[a-z0-9]+", _DIGITS + _LOW), ("BASE36", "[A-Z0-9]+", _DIGITS + _UP),
    ("base62", "[A-Za-z0-9]+", _DIGITS + _UP + _LOW), ("base64", "[A-Za-z0-9+/]+", _UP + _LOW + _DIGITS + "+/"), ("base64url", "[A-Za-z0-9_-]+", _UP + _LOW + _DIGITS + "-_"),
)
# Letters of English text, a to z, in per mille.
LETTER_SHARE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7)
#: In words and names the next character is of the same class (lower, upper, digit, other) with this probability, else of any other class alike.
STAY = 0.7
#: Share of false rejections that Benjamini-Hochberg allows per class of length; upper ends of those classes; steps of -log10 p that are counted.
ALPHA, LENGTH_CLASSES, STEPS, STEP = 0.05, (24, 32, 48, 64), 400, 0.05


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank, end, kind) of the leftmost non-overlapping matches whose group is long enough; code points, end exclusive.

    The text between the matches gives their positions: split() and regexp_extract_all() walk the same matches."""
    rank = next((i for i, p in enumerate(PATTERNS) if p[0] == kind), len(PATTERNS))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def place(found: Column) -> Column:
        measured = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("hit"), F.transform(measured, lambda m: F.length(m)).alias("size"))

        def step(state: Column, part: Column) -> Column:
            start = state["at"] + part["gap"]
            span = F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), (start + part["hit"]).cast("int").alias("end"), F.lit(kind).alias("kind"))
            return F.struct((start + part["hit"]).cast("int").alias("at"), F.when(part["size"] >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        matched = F.filter(parts, lambda p: p["hit"].isNotNull())
        return F.aggregate(matched, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(empty))


def _upper_tail(z: Column) -> Column:
    """P(normal > z), by the logistic form that is right to 2e-4."""
    return 1 / (1 + F.exp(F.least(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z, F.lit(600.0))))


def battery(run: Column) -> Column:
    """p that a string of its inferred encoding is as uneven as this one if its characters are independent and uniform; null if it has no encoding.

    Three times the least p of: chi-squared of the characters' counts over the alphabet, runs above and below the alphabet's middle, and serial
    correlation of neighbours."""
    bare = F.regexp_replace(run, "=+$", "")

    def tests(s: Column, alphabet: Column) -> Column:
        n, k = F.length(s).cast("double"), F.length(alphabet).cast("double")
        values = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: (F.instr(alphabet, F.substring(s, i, F.lit(1))) - 1).cast("double"))
        squares = F.aggregate(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s, c)), F.lit(2.0)))
        uneven = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1))

        def sequential(v: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.struct(F.element_at(v, i).alias("x"), F.element_at(v, i + 1).alias("y")))
            mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
            spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
            changes = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when((p["x"] < k / 2) != (p["y"] < k / 2), 1.0).otherwise(0.0))
            product = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["x"] - mean) * (p["y"] - mean))
            runs = F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
            serial = F.when(spread > 0, F.abs(product / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
            return F.least(2 * _upper_tail(runs), 2 * _upper_tail(serial))

        return F.least(F.lit(1.0), 3 * F.least(_upper_tail(uneven), _let(values, sequential)))

    alphabet = F.lit(None).cast("string")
    for _, look, letters in reversed(ENCODINGS):
        alphabet = F.when(bare.rlike(f"^{look}$"), letters).otherwise(alphabet)
    fit = F.length(bare).__ge__(LEAST) & bare.rlike("[A-Za-z]") & bare.rlike("[0-9]")
    return F.when(fit, _let(alphabet, lambda a: F.when(a.isNotNull(), tests(bare, a))))


def word_likeness(run: Column) -> Column:
    """A bound on p that a string made like words and names is as much likelier as this one under its inferred encoding; null if it has no encoding.

    The null draws the class of each character by STAY, letters by LETTER_SHARE and all else evenly. By Markov's inequality a likelihood ratio of r
    has p of 1 / r at most under it, and 1 / 8 of that ratio with eight encodings to choose from."""
    bare = F.regexp_replace(run, "=+$", "")
    known = _LOW + _DIGITS + "+/-_"
    costs = F.array(*[F.lit(-math.log(x / sum(LETTER_SHARE))) for x in LETTER_SHARE], *[F.lit(math.log(10.0))] * 10, *[F.lit(math.log(4.0))] * 4)

    def bound(size: Column) -> Column:
        n = F.length(bare)
        classes = F.translate(bare, _LOW + _UP + _DIGITS + "+/-_", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4)
        changes = F.length(F.regexp_replace(classes, "a+|A+|0+|-+", "x")) - 1
        letters = _let(F.lower(bare), lambda s: F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(costs, F.instr(F.lit(known), F.substring(s, i, F.lit(1)))), F.lit(0.0))))
        ratio = letters + math.log(4.0) - (n - 1 - changes) * math.log(STAY) - changes * math.log((1 - STAY) / 3) - n * F.log(size)
        return F.least(F.lit(1.0), len(ENCODINGS) * F.exp(-F.least(ratio, F.lit(600.0))))

    size = F.lit(None).cast("double")
    for _, look, alphabet in reversed(ENCODINGS):
        size = F.when(bare.rlike(f"^{look}$"), float(len(alphabet))).otherwise(size)
    return F.when(size.isNotNull(), bound(size))


def length_class(n: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for i, most in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(n < most, i).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """docs' columns without text, with base (spans of PATTERNS) and tested (start, end, length class and steps of -log10 p, of the battery and of word_likeness(), of the
    candidates). Columns of docs that bear these names are dropped; a long text costs its own length."""
    text = F.coalesce(docs["text"], F.lit(""))
    kept = [c for c in docs.columns if c not in ("text", "base", "tested")]
    empty = F.array().cast("array<struct<start:int,end:int,class:int,step:int,word:int>>")
    steps_of = lambda p: F.least(F.lit(STEPS), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) / STEP)).cast("int")

    def score(span: Column, t: Column) -> Column:
        run = F.substring(t, span["start"] + 1, span["end"] - span["start"])
        return _let(run, lambda r: F.struct(span["start"].alias("start"), span["end"].alias("end"), length_class(span["end"] - span["start"]).alias("class"), steps_of(battery(r)).alias("step"), steps_of(word_likeness(r)).alias("word")))

    base = F.sort_array(F.concat(*[found_spans(text, *p) for p in PATTERNS]))
    tested = _let(found_spans(text, "random", CANDIDATE, 0, LEAST), lambda spans: F.when(F.size(spans) > 0, F.filter(F.transform(spans, lambda s: score(s, text)), lambda c: c["step"].isNotNull())).otherwise(empty))
    return docs.select(*kept, base.alias("base"), tested.alias("tested"))


def rejection_steps(scanned: DataFrame, alpha: float = ALPHA) -> dict[str, list[int]]:
    """For the nulls `step` (random) and `word` (like words) the step of -log10 p, by class of length, from which they are rejected: Benjamini-Hochberg over
    all candidates of the class; STEPS + 1 rejects none.

    All p values are counted by null, class and step, so the driver gets ten times STEPS numbers at most, whatever the input."""
    both = F.flatten(F.transform("tested", lambda t: F.array(*[F.struct(F.lit(null).alias("null"), t["class"].alias("class"), t[null].alias("step")) for null in ("step", "word")])))
    counts = scanned.select(F.explode(both).alias("t")).groupBy("t.null", "t.class", "t.step").count().collect()
    limits = {null: [STEPS + 1] * (len(LENGTH_CLASSES) + 1) for null in ("step", "word")}
    for null, c in {(r["null"], r["class"]) for r in counts}:
        steps = sorted(((r["step"], r["count"]) for r in counts if (r["null"], r["class"]) == (null, c)), reverse=True)
        total, seen = sum(n for _, n in steps), 0
        for step, n in steps:
            seen += n
            if 10 ** (-step * STEP) <= alpha * seen / total:
                limits[null][c] = step
    return limits


def secrets(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """docs' columns without text, with base and spans (base ones and those of kind random), sorted by start and kind.

    Candidates of the battery that lie in a base span aren't repeated. Null and empty texts have no spans; repeated rows have equal ones."""
    scanned = written(scan(docs), "scanned")
    limits = rejection_steps(scanned, alpha)
    limit = lambda null, t: F.get(F.array(*[F.lit(x) for x in limits[null]]), t["class"])
    is_key = lambda t: (t["step"] < limit("step", t)) & (t["word"] >= limit("word", t))
    apart = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    more = F.transform(F.filter("tested", lambda t: is_key(t) & apart(t)), lambda t: F.struct(t["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return scanned.withColumn("spans", F.sort_array(F.concat("base", more))).drop("tested")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", alpha: float = ALPHA) -> DataFrame:
    """docs with every span of secrets() replaced in text by the mark, overlapping spans by one; the columns stay as they are."""
    with_text = docs.withColumn("__text", F.col("text"))
    found = secrets(with_text.withColumnsRenamed({c: f"__own_{c}" for c in ("base", "tested", "spans") if c in docs.columns}), alpha)
    text = F.coalesce("__text", F.lit(""))

    def step(state: Column, span: Column) -> Column:
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))
    out = found.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("__text"))).drop("__text", "base", "spans")
    return out.withColumnsRenamed({f"__own_{c}": c for c in ("base", "tested", "spans") if c in docs.columns}).select(*docs.columns)
