"""PII by candidate gradient boosting, in DataFrame functions only.

Base kinds (email, ip, card, phone) are exact patterns and always reported.  Further kinds
come from high-recall generators whose candidates may overlap; each candidate gets format
and context features, boosted trees give a calibrated probability, and those above the
threshold of their kind are reported unless they overlap a base span or a more probable
candidate.  Names of persons have no generator.

The trees are trained on the driver on ``training_texts``, written by rules from a fixed
seed, with look-alikes that aren't private (slugs, paths, UUIDs, commit hashes, ISBNs, section
numbers, plain dates); their features come from the same columns, so training and use agree.  A
quarter of these texts is held out for the calibration and the thresholds.

Every pattern that repeats runs over single characters or a bounded number of times, because
the JVM's engine recurses on other repeated groups and would fail on long texts.  Separators
that join digits, and dots that join labels, are first marked, which keeps all positions.

Defined results: a null text is empty (and stays null where texts are returned); an empty text
has no spans (the hash of the empty string); rows are independent, so repeated rows get equal
results; an empty table gives an empty result; other columns may have any name; very long texts
are searched whole, in time that grows with n * sqrt(n) for n spans.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import any_overlap, by_reach, let, running
from .boosting import Boosted
from .common import fresh, id_and_text

BASE_KINDS = ["email", "ip", "card", "phone"]
_MARK, _OTHER = "\x01", "\x02"
_LOCAL = r"A-Za-z0-9._%+\x01-"

#: Generators: kind, regex on the text, regex of words that belong before it.
GENERATORS = [
    ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,200}[0-9])(?=[0-9_-]{0,200}[A-Za-z])[A-Za-z0-9_-]{16,}", r"token|secret|api|key|auth|passw|bearer|credential"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"ssn|social|security|sin\b|tax"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"iban|account|bank|konto|compte|cuenta"),
    ("local_phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])", r"phone|tel|call|fax|mobile|cell|contact"),
    ("account", r"(?<![0-9-])[0-9]{4}(?:[ -]?[0-9]{3,6}){2,4}(?![0-9-])", r"card|visa|amex|master|credit|debit|account"),
    ("ipv6", r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])", r"ip|host|addr|server|from"),
    ("birth_date", r"(?<![0-9/.-])(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})(?![0-9/.-])", r"born|birth|dob|geboren|naissance|nacid"),
    ("street", r"(?<![A-Za-z0-9])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Court|Square)(?![A-Za-z])", r"live|address|home|reside|mail|ship|deliver|at\b"),
    ("user", r"(?<![A-Za-z0-9_.@])@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_.@])", r"user|follow|contact|handle|twitter|instagram|telegram|account|dm\b"),
]
#: Words that speak against private data.
OTHER_WORDS = r"commit|sha|hash|checksum|digest|md5|version|release|file|path|uuid|guid|isbn|order|serial|section|chapter|part|page|model|ref|item|build|id\b|sizes|rows|scores|on\b|until|dated"
KINDS = BASE_KINDS + [g[0] for g in GENERATORS]
CONTEXT = 32

FEATURES = ["kind", "length", "digits", "upper", "lower", "separators", "distinct", "hexadecimal", "luhn", "own_words", "any_words", "other_words", "assigned", "quoted", "in_path", "uuid", "word_parts", "changes", "private_area"]


def matches(text: Column, pattern: str) -> Column:
    """Start, end (code points, end exclusive) and value of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        ends = running(F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v)))
        return F.zip_with(ends, values, lambda end, v: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))

    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    return let(found, lambda values: F.when(F.size(values) > 0, placed(values)).otherwise(none))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    r = F.reverse(digits)
    value = lambda i: F.substr(r, i, F.lit(1)).cast("int")
    twice = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(i)).otherwise(value(i)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: str) -> dict[str, Column]:
    """The spans of each base kind, over a column that is null where the text has neither digit nor @."""
    clean = F.translate(text, _MARK, _OTHER)
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", _MARK)
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    # a match starts where its run of characters starts, or where the match before it ended
    email = matches(dotted, rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]+\x01[A-Za-z0-9\x01-]+")
    ip = matches(clean, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    card = matches(joined, r"[0-9][0-9\x01]{15,}")
    phone = matches(clean, r"\+[0-9][\x20().0-9-]+[0-9]")
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    size = lambda s: F.length(_digits(s["value"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), email).otherwise(none),
        "ip": F.filter(ip, lambda s: s["value"].rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")),
        "card": F.filter(card, lambda s: F.when(size(s).between(16, 19), luhn(_digits(s["value"]))).otherwise(False)),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(phone, lambda s: size(s).between(8, 15))).otherwise(none),
    }


def candidates(text: Column) -> Column:
    """All candidates of all generators with their features."""
    every = "|".join(g[2] for g in GENERATORS)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)

    def described(k: int, own: str, s: Column) -> Column:
        left = F.lower(F.substring(text, F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))))
        v = s["value"]
        count = lambda p: F.length(F.regexp_replace(v, p, ""))
        made = lambda left: {
            "kind": F.lit(float(k)), "length": F.length(v), "digits": count("[^0-9]"), "upper": count("[^A-Z]"), "lower": count("[^a-z]"),
            "separators": count("[A-Za-z0-9]"), "distinct": F.size(F.array_distinct(F.split(v, ""))), "hexadecimal": yes(v.rlike("^[0-9a-fA-F]+$")),
            "luhn": yes(F.when(F.length(_digits(v)).between(12, 19), luhn(_digits(v))).otherwise(False)),
            "own_words": yes(left.rlike(own)), "any_words": yes(left.rlike(every)), "other_words": yes(left.rlike(OTHER_WORDS)),
            "assigned": yes(left.rlike("[=:]\\s*[\"']?$")), "quoted": yes(left.rlike("[\"']$")), "in_path": yes(left.rlike("[/\\\\.]$")),
            "uuid": yes(v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
            "word_parts": F.regexp_count(v, F.lit("(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])")), "changes": F.regexp_count(v, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")),
            "private_area": yes(~v.rlike("^(?:000|666|9[0-9][0-9])-")),
        }
        return let(left, lambda x: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("order"), *[made(x)[f].cast("double").alias(f"f_{f}") for f in FEATURES]))

    parts = [F.transform(matches(text, pattern), functools.partial(described, len(BASE_KINDS) + i, own)) for i, (_, pattern, own) in enumerate(GENERATORS)]
    return F.concat(*parts)


def training_texts(n: int = 160, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Texts and the private values in them, ``n`` of each pattern; also look-alikes that are not private."""
    r = random.Random(seed)
    words = lambda k: " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 5))) for _ in range(k))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    date = lambda a, b: r.choice([f"{r.randint(a, b)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(a, b)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(a, b)}"])
    made: list[tuple[str, list[str]]] = []

    def add(before: list[str], value: str, private: bool, after: str = " ") -> None:
        made.append((f"{words(r.randint(2, 8))} {r.choice(before)}{value}{after}{words(r.randint(2, 8))}", [value] if private else []))

    for _ in range(n):
        add(['token = "', "api_key: ", "secret=", "password: '", "Bearer ", "auth key ", "token ", "credentials: "], r.choice([hexa(40), hexa(32), hexa(64), mixed(24), mixed(32), "sk-" + mixed(40), "ghp_" + mixed(36)]), True)
        add(["", "see ", "item ", "commit ", "sha256 of ", "checksum ", "at commit ", "digest: ", "md5 = "], r.choice([hexa(40), hexa(64), hexa(32)]), False)
        add(["", "the ", "version ", "file ", "named ", "https://example.org/", "see docs/", "key-value "], r.choice([f"{words(1)}-{words(1)}-{words(1)}-{r.randint(1, 2030)}-{words(1)}", f"release_{r.randint(10, 99)}_{words(1)}{words(1)}", f"{words(1)}{r.randint(1, 99)}-{words(1)}-{words(1)}{words(1)}-edition"]), False)
        add(["", "uuid ", "id ", "request id: ", "guid=", "object "], f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", False)
        add(["/usr/lib/", "https://example.org/a/", "./build/"], f"{words(1)}{r.randint(1, 99)}_{words(1)}{words(1)}_{r.randint(1, 999)}", False, "/")
        add(["ssn ", "social security number ", "SSN: ", "social security: ", "tax id "], f"{r.randint(100, 665)}-{digits(2)}-{digits(4)}", True)
        add(["section ", "part ", "", "ref ", "page ", "model ", "order "], f"{digits(3)}-{digits(2)}-{digits(4)}", False)
        add(["IBAN ", "bank account ", "", "pay to ", "iban: "], f"{upper(2)}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", True)
        add(["model ", "part ", "ref ", "serial "], f"{upper(2)}{digits(2)}{upper(4)}{upper(4)}", False)
        add(["call ", "phone: ", "tel ", "fax ", "mobile ", "contact "], r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}"]), True)
        add(["", "at "], f"({digits(3)}) {digits(3)}-{digits(4)}", True)
        add(["sizes ", "rows ", "years ", "scores ", "", "part ", "section "], r.choice([f"{r.randint(10, 9999)} {r.randint(100, 999)} {r.randint(100, 9999)}", f"{digits(2)}.{digits(3)}.{digits(3)}"]), False)
        add(["order ", "serial ", "", "number ", "isbn ", "ISBN ", "ean "], r.choice([digits(10), digits(12), digits(14), f"978{digits(10)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"]), False)
        number = r.choice(["34", "37"]) + digits(12)
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(number)))
        card = number + str(-total % 10)
        add(["card ", "amex ", "credit card: ", "debit card "], r.choice([card, f"{card[:4]} {card[4:10]} {card[10:]}"]), True)
        add(["host ", "from ", "ip ", "", "server "], ":".join(hexa(4) for _ in range(8)), True)
        add(["", "took ", "at ", "ratio ", "mac "], ":".join(digits(2) for _ in range(r.randint(5, 6))), False)
        add(["born ", "date of birth: ", "DOB ", "birth date ", "birthday: "], date(1930, 2010), True)
        add(["on ", "released ", "until ", "", "dated ", "version ", "since "], date(1930, 2030), False)
        place = f"{r.randint(1, 9999)} {words(1).capitalize()} {r.choice(['Street', 'St', 'Avenue', 'Ave', 'Road', 'Lane', 'Drive', 'Court'])}"
        add(["lives at ", "address: ", "home address ", "mail to ", "ship to ", "resides at "], place, True)
        add(["", "the shop on ", "part ", "chapter "], place, False)
        add(["user ", "follow ", "contact ", "handle: ", "telegram ", "account "], f"@{words(1).replace(' ', '')}{r.choice(['', '_'])}{r.randint(1, 99)}", True)
        add(["", "use ", "the ", "a decorator "], r.choice(["@override", "@media", "@property", f"@{words(1)}"]), False)
    return made


def training_rows(spark: SparkSession, made: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all candidates in these texts, whether each is private, its kind, and its text's number."""
    texts = F.from_json(F.lit(json.dumps([{"i": i, "text": t} for i, (t, _) in enumerate(made)])), "array<struct<i: int, text: string>>")
    rows = spark.range(1, numPartitions=1).select(F.explode(texts).alias("r")).select("r.*").select("i", "text", F.explode(candidates(F.col("text"))).alias("c"))
    got = rows.select("i", F.expr("substring(text, c.start + 1, c.end - c.start)").alias("value"), "c.*").collect()  # bounded by training_texts
    got.sort(key=lambda r: (r["i"], r["start"], r["order"]))
    x = np.array([[r[f"f_{f}"] for f in FEATURES] for r in got])
    y = np.array([any(r["value"] == v or (len(r["value"]) > 0.8 * len(v) and r["value"] in v) for v in made[r["i"]][1]) for r in got])
    return x, y, np.array([r["order"] for r in got]), np.array([r["i"] for r in got])


@functools.cache
def _trained(app: str) -> Boosted:
    made = training_texts()
    x, y, kind, text = training_rows(SparkSession.getActiveSession(), made)
    held = np.random.default_rng(0).random(len(made)) < 0.25
    return Boosted(x, y, kind, held[text])


def trained(spark: SparkSession) -> Boosted:
    """The classifier; trained once an application."""
    return _trained(spark.sparkContext.applicationId)


def _named(kind: Column | str, s: Column) -> Column:
    return F.concat_ws(":", kind if isinstance(kind, Column) else F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _with_spans(rows: DataFrame, text_col: str, model: Boosted) -> tuple[DataFrame, str, str]:
    """``rows`` with two columns more, and their names: the base spans, and all spans (order of kind, start, end, p)."""
    given = rows.columns
    name = {k: fresh(rows, f"pii_{k}") for k in ("text", "candidates", "base", "scored", "spans", *BASE_KINDS)}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = rows.withColumn(name["text"], F.when(text.rlike("[0-9@]"), text))
    rows = rows.withColumns({name[k]: c for k, c in base_spans(name["text"]).items()})
    rows = rows.withColumn(name["candidates"], candidates(F.col(name["text"])))
    empty = F.expr("cast(array() as array<struct<order: int, start: int, end: int, p: double>>)")
    certain = lambda i: lambda s: F.struct(F.lit(i).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("p"))
    base = F.concat(*[F.transform(name[k], certain(i)) for i, k in enumerate(BASE_KINDS)])
    scored = F.transform(name["candidates"], lambda c: F.struct(c["order"].alias("order"), c["start"].alias("start"), c["end"].alias("end"), model.column(lambda j: c[f"f_{FEATURES[j]}"]).alias("p")))
    least = F.array(*[F.lit(model.thresholds.get(k, 0.99)) for k in range(len(KINDS))])
    rows = rows.withColumn(name["base"], F.coalesce(base, empty)).withColumn(name["scored"], F.filter(F.coalesce(scored, empty), lambda c: c["p"] >= F.element_at(least, c["order"] + 1)))
    better = lambda a: lambda b: (b["p"] > a["p"]) | ((b["p"] == a["p"]) & ((b["order"] < a["order"]) | ((b["order"] == a["order"]) & (b["start"] < a["start"]))))
    chosen = lambda r: F.filter(name["scored"], lambda a: ~any_overlap(r["base"], a) & ~any_overlap(r["scored"], a, better(a)))
    extra = let(F.struct(by_reach(F.col(name["base"])).alias("base"), by_reach(F.col(name["scored"])).alias("scored")), chosen)
    spans = F.array_sort(F.concat(name["base"], F.when(F.size(name["scored"]) > 0, extra).otherwise(empty)))
    return rows.withColumn(name["spans"], spans).select(*[F.col(f"`{c}`") for c in given], name["base"], name["spans"]), name["base"], name["spans"]


def reported(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, number of base spans by kind, SHA-256 of the base spans, and all spans as text."""
    rows, base, spans = _with_spans(id_and_text(docs, id_col, text_col), "text", trained(docs.sparkSession))
    kinds = F.array(*map(F.lit, KINDS))
    named = lambda c: F.array_join(F.transform(c, lambda s: _named(F.element_at(kinds, s["order"] + 1), s)), ",")
    count = lambda i: F.size(F.filter(base, lambda s: s["order"] == i)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)], F.sha2(named(base), 256).alias("base_sha256"), named(spans).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by [KIND] of the span that starts it."""
    rows, _, spans = _with_spans(docs, text_col, trained(docs.sparkSession))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col(f"`{text_col}`")
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["order"].alias("order"))))

    def replaced(x: Column) -> Column:
        """``x``: spans by start, and the furthest end up to each; a span within it belongs to the run before."""
        past = F.concat(F.array(F.lit(0)), x["furthest"])
        each = F.zip_with(x["spans"], F.slice(past, F.lit(1), F.size(x["spans"])), lambda s, end: F.struct(s.alias("s"), end.alias("end")))
        first = F.filter(each, lambda e: e["s"]["start"] >= e["end"])
        pieces = F.transform(first, lambda e: F.concat(F.substring(text, e["end"] + 1, e["s"]["start"] - e["end"]), F.element_at(kinds, e["s"]["order"] + 1)))
        end = F.element_at(x["furthest"], -1)
        return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text) - end))

    furthest = lambda s: running(F.transform(s, lambda v: v["end"]), 0, lambda a, b: F.greatest(a, b))
    clean = let(by_start, lambda s: let(F.struct(s.alias("spans"), furthest(s).alias("furthest")), replaced))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
