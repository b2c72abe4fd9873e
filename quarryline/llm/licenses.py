"""License scans by ordered signature rules, in DataFrame functions only.

The rules (``license_rules``) are regexes over a text's words (A-Z lower-cased, one space
between words), each with a keyword that all its matches contain, a label and a priority.  Two
gates come first: a text that holds no word of a small set is passed over, and a rule is tried only
where its keyword occurs; the set has a word of each rule's keyword.  Detections are
intervals of words.  A detection inside another one of higher priority, or of equal priority
and greater length, is suppressed; rule order settles what is left.  Base phrases are never
suppressed.

Defined results: a null text is empty; an empty text has no words, no labels and score 0; rows
are independent, so repeated rows get equal results; an empty table gives an empty result; only
the two named columns are read, so others may have any name; very long texts are scanned whole,
in time that grows with n * sqrt(n) for n matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, let, running
from .common import id_and_text
from .license_rules import BASE, RULES, Rule

__all__ = ["BASE", "RULES", "scanned"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators between words once A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = "\x01"  # not part of any word

_DETECTION = "array<struct<start: int, end: int, rank: int, label: string, priority: int, confidence: double, base: boolean>>"


def gate_words(rules: list[Rule] = RULES) -> list[str]:
    """Words of which a text with any rule's match has one: of the keywords' longest words, greedily those that most keywords left have."""
    left = {tuple(r.keyword.replace("&", " ").split()) for r in rules}
    words = sorted({max(k, key=len) for k in left})
    out = []
    while left:
        out.append(max(words, key=lambda w: (sum(w in k for k in left), len(w), w)))
        left = {k for k in left if out[-1] not in k}
    return out


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _tried(words: Column, rank: int, rule: Rule, gate: Column) -> Column:
    """What one rule matches, and the text around that; null where it matches nothing or the gate is shut."""
    pattern = f"(?<= )(?:{rule.regex})(?= )"
    around = F.split(F.regexp_replace(words, pattern, _MARK), _MARK, -1)
    made = F.struct(F.lit(rank).alias("rank"), F.regexp_extract_all(words, F.lit(pattern), F.lit(0)).alias("found"), around.alias("around"))
    tried = words.rlike(pattern)
    for run in reversed(rule.keyword.split("&")):
        tried = F.contains(words, F.lit(f" {run} " if run else "")) & tried
    return F.when(gate & tried, made)


def _intervals(hit: Column, rules: list[Rule]) -> Column:
    """The detections of one rule; word 0 follows the text's first space."""
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), hit["rank"] + 1)
    inner = F.transform(hit["found"], _spaces)
    gap = F.transform(F.slice(hit["around"], F.lit(1), F.size(hit["found"])), _spaces)
    kind = F.struct(of([r.label for r in rules]).alias("label"), of([r.priority for r in rules]).alias("priority"), of([r.confidence for r in rules]).alias("confidence"), of([r.base for r in rules]).alias("base"))

    def placed(x: Column) -> Column:
        return F.transform(
            F.arrays_zip(x["ends"].alias("end"), x["inner"].alias("inner")),
            lambda s: F.struct((s["end"] - s["inner"] - 1).alias("start"), s["end"].alias("end"), hit["rank"].alias("rank"), *[x["kind"][c].alias(c) for c in ("label", "priority", "confidence", "base")]),
        )

    ends = lambda i: running(F.zip_with(gap, i, lambda g, n: g + n))
    return let(inner, lambda i: let(F.struct(ends(i).alias("ends"), i.alias("inner"), kind.alias("kind")), placed))


def _unsuppressed(detections: Column, rules: list[Rule]) -> Column:
    """Detections that give way to no other one.

    In order of start, then of end downwards, priority downwards and rank, a detection gives way
    just where an earlier one ends no sooner and has no lower priority.  The furthest end by
    priority is kept for each chunk of that order, so that only chunks are looked through.
    """
    levels = sorted({r.priority for r in rules})
    ordered = F.array_sort(detections, lambda a, b: F.coalesce(*[F.when(x != y, F.when(x < y, -1).otherwise(1)) for x, y in ((a["start"], b["start"]), (b["end"], a["end"]), (b["priority"], a["priority"]), (a["rank"], b["rank"]))], F.lit(0)))
    ends = lambda part, p: F.coalesce(F.array_max(F.transform(F.filter(part, lambda o: o["priority"] >= p), lambda o: o["end"])), F.lit(0))
    level = F.array(*map(F.lit, levels))

    def kept(x: Column) -> Column:
        def of_chunk(part: Column, c: Column) -> Column:
            before = F.transform(level, lambda p, i: F.coalesce(F.array_max(F.transform(F.slice(x["furthest"], F.lit(1), c), lambda f: F.element_at(f, i + 1))), F.lit(0)))
            return let(before, lambda b: F.filter(part, lambda d, i: d["base"] | ~((F.element_at(b, F.array_position(level, d["priority"]).cast("int")) >= d["end"]) | F.exists(F.slice(part, F.lit(1), i), lambda o: (o["end"] >= d["end"]) & (o["priority"] >= d["priority"])))))

        return F.transform(x["parts"], of_chunk)

    with_ends = lambda parts: F.struct(parts.alias("parts"), F.transform(parts, lambda part: F.transform(level, lambda p: ends(part, p))).alias("furthest"))
    return F.flatten(let(chunks(ordered), lambda parts: let(with_ends(parts), kept)))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, gated: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``gated`` = False tries every rule on every text, for tests of the gates.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _BETWEEN, " ")), F.lit(" ")).alias("words"))
    few = gate_words(rules)
    held = F.array_intersect(F.array(*map(F.lit, few)), F.split("words", " "))
    opens = lambda r: F.array_contains("held", next(w for w in few if w in r.keyword.replace("&", " ").split())) if gated else F.lit(True)
    n_words = F.when(F.col("words") == "  ", 0).otherwise(_spaces(F.col("words")) - 1).cast("long")
    free = rules if gated else [Rule(r.label, "", r.priority, r.confidence, r.regex, r.base) for r in rules]
    hits = F.filter(F.array(*[_tried(F.col("words"), i, free[i], opens(r)) for i, r in enumerate(rules)]), lambda h: h.isNotNull())
    rows = rows.select("doc_id", n_words.alias("n_words"), "words", held.alias("held"))
    rows = rows.withColumn("hits", F.when((F.size("held") > 0) if gated else F.lit(True), hits)).drop("words", "held")
    none = F.expr(f"cast(array() as {_DETECTION})")
    rows = rows.withColumn("all", F.when(F.size("hits") > 0, F.flatten(F.transform("hits", lambda h: _intervals(h, rules)))).otherwise(none))
    rows = rows.withColumn("detections", F.when(F.size("all") > 1, _unsuppressed(F.col("all"), rules)).otherwise(F.col("all"))).withColumn("base", F.filter("all", lambda d: d["base"])).drop("all", "hits")
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("detections").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"), "detections",
    )
