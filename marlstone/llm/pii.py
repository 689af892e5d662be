"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

Base spans come from regular expressions with checks (parts of addresses, checksums, digit counts); their places
follow from the lengths of what lies between matches. They and bank accounts, which a checksum proves, are the seeds of
a bootstrap over the whole corpus. Long hexadecimal keys and social security numbers are forms that hashes of commits
and part numbers share; one is a seed only where a label of its kind ("token", "password", "ssn") is among the two
words before it, else a candidate like any other.

Every seed, and outside of seeds every run of digits with spaces and brackets and every other token that looks like an
identifier, is an instance. The word before it, the two words before it and the word after it are its lexical
patterns. Patterns are scored on the graph of patterns and instances: the share of the pattern's occurrences in ALL
texts that stand at a known identifier, times the logarithm of how many different ones. So a common word scores
little, however many identifiers it precedes, and "token =" or "ssn:" much. A pattern carries over from the form of
its seeds to others: what stands in the slot of a high-confidence pattern becomes known, as its pattern's kind where it
can be of that kind, else as "id"; then the graph is scored again, until nothing is added. No pattern confirms itself: what
became known only by a pattern is no known identifier when that pattern is scored.

Added are, outside of base spans: the further seeds, and what became known, where it stands in the slot of a
high-confidence pattern or is long enough to be known by itself. What has the form of its pattern's kind and fails its check is never
added. All steps are DataFrame operations; patterns and instances are summed before the shuffle.

Cases: null and empty texts have no spans; repeated rows get equal results; rows of a null doc_id are treated as any
other, by their text; empty tables give no rows; runs of digits of any length are matched without recursion; other
columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import written

#: Base patterns by kind, in the order of results. Each starts where a match can start and never takes back a
#: character, which leaves the matches of the plain pattern and keeps time and stack small on long runs.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further forms. A bank account's checksum is proof enough; the others need a label before them, or a pattern.
FORMS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Labels of the forms without a checksum, as parts of the two words before: fixed values.
LABELS = {
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "passphrase", "credential", "credentials", "bearer"),
    "ssn": ("ssn", "social"),
}
#: Kinds in the order of results; "id" is an identifier of no other kind.
ORDER = (*KINDS, *FORMS, "id")
#: The least precision and the least number of different known identifiers of a pattern.
PRECISION = 0.5
SUPPORT = 5
#: Least score of a pattern: precision times the base-2 logarithm of its known identifiers.
SCORE = 2.0
#: Letters and digits of a word that is known by itself, wherever it stands.
OWN = 8
#: Rows of a table of patterns that is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Whole words in the form of a kind that has a check.
_FORMED = {
    "ip": r"^[0-9]++(?:\.[0-9]++){3}$",
    "card": r"^(?=(?:[^0-9]*[0-9]){13,19}[^0-9]*$)[0-9](?:[\x20-]?[0-9])++$",
    "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{8,}$",
}
#: A run of digits with spaces and brackets, what stands glued before it included; else a whole token.
_RUN = r"\+?+(?:\((?=[0-9]++\)))?+[0-9][0-9\x20\x{A0}\x{202F}()./-]*[0-9](?=[^\p{L}\p{N}+@\s]*+(?!\S))"
_GLUED = r"(?:[^\s0-9@+(]*+(?<=[:=]))?+(?:(?!\([0-9]++\))[^\p{L}\p{N}+@\s])*+"
_LABEL = r"^(?:[^\s=:@0-9]++[=:]++(?!/))?+(?:(?!\([0-9]++\))[^A-Za-z0-9+@])*+"
_TOKEN = rf"(?<!\S)(?:{_GLUED}{_RUN}|\S*?[0-9@]\S*+)"
_SPACED = r"[\x20\x{A0}\x{202F}]"
_SPANS = "array<struct<start:int,end:int,word:string>>"
#: Code points in which the words around an instance are sought; where they are longer, ten times as many, then all.
REACH = 60


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Checksum of a string of digits modulo 10 is 0."""
    each = F.split(F.reverse(digits), "")

    def worth(x, i):
        n = x.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    own = F.transform(F.filter(each, lambda x: x != ""), worth)
    return F.aggregate(own, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(account: Column) -> Column:
    """A bank account, its first four characters moved to the end and letters as numbers from 10, modulo 97."""
    moved = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def add(acc, x):
        return F.when(x.rlike("[0-9]"), (acc * 10 + x.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), add)


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(F.regexp_replace(match, " ", "")) == 1
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Fa-f]")
    if kind == "ssn":
        return match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _checks(kind: str):
    return lambda x: _valid(kind, x["word"])


def matches(text: str, pattern: str) -> Column:
    """Array of (start, end, word) in code points of all matches of a pattern, leftmost and non-overlapping."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)
    # starts are gathered in a string, which a text of many matches extends at little cost
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("starts"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["word"])).alias("at"), F.concat(acc["starts"], F.lit(","), start.cast("string")).alias("starts"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("word"))
    starts = F.split(F.aggregate(pairs, zero, step, lambda acc: F.substring(acc["starts"], 2, (1 << 31) - 1)), ",")

    def span(x):
        start = x["start"].cast("int")
        return F.struct(start.alias("start"), (start + F.length(x["word"])).alias("end"), x["word"].alias("word"))

    spans = F.transform(F.arrays_zip(starts.alias("start"), found.alias("word")), span)
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPANS))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, and an array of spans (start, end, word) for each kind."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("digit", F.col("text").rlike("[0-9]"))
    none = F.array().cast(_SPANS)
    may = {"email": F.contains("text", F.lit("@")), "phone": F.col("digit") & F.contains("text", F.lit("+"))}
    for kind, pattern in KINDS.items():
        spans = F.filter(matches("text", pattern), _checks(kind))
        own = own.withColumn(kind, F.when(may.get(kind, F.col("digit")), spans).otherwise(none))
    return own.drop("digit")


def _listed(kind: str) -> Column:
    """The spans of a kind's column as (order of the kind, kind, start, end)."""
    order = ORDER.index(kind)
    return F.transform(kind, lambda x: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _words_before(text: str, start: str) -> Column:
    """The two words before a place (one if there is one only, else ''), in lower case with a space between.

    Marks that open the instance are no word.
    """
    at = F.col(start)

    def within(reach: int) -> Column:
        head = F.substring(F.col(text), F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)))
        head = F.regexp_replace(head, r"(?<!\S)[^\p{L}\p{N}+@\s]++\z", "")
        whole = F.regexp_extract(head, r"(?<!\S)(\S++\s++\S++|\S++)\s*+\z", 1)
        return F.when(at <= reach, whole).otherwise(F.nullif(F.regexp_extract(head, r"\s(\S++\s++\S++)\s*+\z", 1), F.lit("")))

    found = F.coalesce(*(within(reach) for reach in (REACH, REACH * 10, (1 << 31) - 1)))
    return F.regexp_replace(F.lower(found), r"\s++", " ")


def _word_after(text: str, end: str) -> Column:
    """The word after the token that ends with an instance, in lower case; '' if there is none."""

    def within(reach: int) -> Column:
        tail = F.substring(F.col(text), F.col(end) + 1, F.lit(reach))
        whole = F.regexp_extract(tail, r"^\S*+\s++(\S++)", 1)
        return F.when(F.length(tail) < reach, whole).otherwise(F.nullif(F.regexp_extract(tail, r"^\S*+\s++(\S++)\s", 1), F.lit("")))

    return F.lower(F.coalesce(*(within(reach) for reach in (REACH, REACH * 10, (1 << 31) - 1))))


def kind_of(word: Column, said: Column) -> Column:
    """What an instance in the slot of a pattern of kind `said` is: that kind, "id", or null if it may be neither."""
    n, spaced, letters = F.length(_digits(word)), word.rlike(_SPACED), word.rlike(r"\p{L}")
    mixed = letters & (n > 0)
    fits = (
        F.when(said == "email", F.contains(word, F.lit("@")))
        .when(said == "ip", word.rlike("^[0-9A-Fa-f]++(?:[.:]++[0-9A-Fa-f]++){2,}$"))
        .when(said == "card", ~letters & n.between(13, 19) & _luhn(_digits(word)))
        .when(said == "phone", ~letters & n.between(7, 15))
        .when(said == "iban", word.rlike("^[A-Z]{2}[0-9]{2}") & n.between(8, 34))
        .when(said == "secret", ~spaced & (mixed & (F.length(word) >= 8) | (F.length(word) >= 16)))
        .when(said == "ssn", ~letters & (n == 9))
        .otherwise(False)
    )
    failed = F.coalesce(*(F.when(said == k, word.rlike(form)) for k, form in _FORMED.items()), F.lit(False))
    plain = ~spaced & ((n >= 6) | mixed & (F.length(word) >= 8))
    return F.when(failed, None).when(fits, said).when(plain, F.lit("id"))


def _instances(based: DataFrame) -> DataFrame:
    """doc_id, h, start, end, word, kind, slots of seeds (with their kind) and of candidates (kind NULL).

    A form of LABELS without a label before it is a candidate. Other candidates are runs and tokens that meet no seed and look like identifiers: at least five digits, or eight
    characters with letters and digits, or an @. slots: the patterns, each a side ("<", "<<" or ">") and words.
    """

    def seeds(kind):
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["word"].alias("word"), F.lit(kind).alias("kind")))

    def candidate(t):
        run = t["word"].rlike(rf"^{_GLUED}{_RUN}$")
        lead = F.when(run, F.regexp_extract(t["word"], rf"^{_GLUED}", 0)).otherwise(F.regexp_extract(t["word"], _LABEL, 0))
        word = F.regexp_replace(F.substring(t["word"], F.length(lead) + 1, F.length(t["word"])), r"[^A-Za-z0-9]++$", "")
        return F.struct((t["start"] + F.length(lead)).alias("start"), word.alias("word"), F.lit(None).cast("string").alias("kind"))

    def apart(start, end, spans):
        return ~F.exists(spans, lambda x: (x["start"] < end) & (x["start"] + F.length(x["word"]) > start))

    def likely(c):
        word = c["word"]
        mixed = (F.length(word) >= 8) & word.rlike("[0-9]") & word.rlike(r"\p{L}")
        return ((F.length(_digits(word)) >= 5) | mixed | word.rlike(r"[^@]@[^@]")) & apart(c["start"], c["start"] + F.length(word), "seeds")

    own = based.where(F.col("text").rlike("[0-9@]"))
    own = own.select("doc_id", F.xxhash64("text").alias("h"), "text", F.concat(*map(seeds, KINDS)).alias("seeds"))
    for kind, form in FORMS.items():
        found = F.filter(F.filter(matches("text", form), _checks(kind)), lambda x: apart(x["start"], x["end"], "seeds"))
        own = own.withColumn(kind, F.when(F.col("text").rlike(form), found).otherwise(F.array().cast(_SPANS)))
        own = own.withColumn("seeds", F.concat("seeds", seeds(kind)))  # told apart from candidates below
    own = own.withColumn("candidates", F.filter(F.transform(matches("text", _TOKEN), candidate), likely))
    own = own.select("doc_id", "h", "text", F.explode(F.concat("seeds", "candidates")).alias("i")).select("doc_id", "h", "text", "i.start", "i.word", "i.kind")
    own = own.withColumn("end", F.col("start") + F.length("word"))
    own = own.withColumns({"before": _words_before("text", "start"), "after": _word_after("text", "end")})
    parts = F.split("before", r"[^\p{L}]+")
    labelled = {k: F.arrays_overlap(parts, F.array(*map(F.lit, names))) for k, names in LABELS.items()}
    bare = F.coalesce(*(F.when(F.col("kind") == k, ~said) for k, said in labelled.items()), F.lit(False))
    own = own.withColumn("kind", F.when(~bare, F.col("kind")))
    last = F.substring_index("before", " ", -1)
    slots = F.array(F.when(last != "", F.concat(F.lit("< "), last)), F.when(F.col("before").contains(" "), F.concat(F.lit("<< "), "before")), F.when(F.col("after") != "", F.concat(F.lit("> "), "after")))
    return own.select("doc_id", "h", "start", "end", "word", "kind", F.array_compact(slots).alias("slots"))


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows, which are counted, are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _occurrences(based: DataFrame, patterns: DataFrame) -> DataFrame:
    """slot, total: how often the words of each pattern (column slot) occur in all texts."""
    sought = written(patterns.select(F.substring_index("slot", " ", 1).alias("side"), F.expr("substring(slot, instr(slot, ' ') + 1)").alias("words"), "slot"), "sought")
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    own = based.select(tokens.alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    own = own.select(F.explode(F.array(F.col("p.a"), F.concat("p.a", F.lit(" "), "p.b"))).alias("words"))  # NULL after the last word
    counted = own.join(_small(written(sought.select("words").distinct(), "words")), "words", "left_semi").groupBy("words").agg(F.count(F.lit(1)).alias("total"))
    return sought.join(counted, "words", "left").select("slot", F.coalesce("total", F.lit(0)).alias("total"))


def scored_patterns(pairs: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """slot, said, score of the patterns that score high.

    pairs: slot, word, n; totals: slot, total; known: word, known, only. `only` is the pattern by which alone a word
    became known, NULL for seeds and where several say so: for that pattern the word does not count as known.
    """
    graph = pairs.join(known, "word", "left")
    hit = F.col("known").isNotNull() & ~F.coalesce(F.col("only") == F.col("slot"), F.lit(False))
    pattern = graph.groupBy("slot").agg(F.count_if(hit).alias("hits"), F.sum(F.when(hit, F.col("n"))).alias("right"), F.sum("n").alias("held"), F.mode(F.when(hit, F.col("known")), True).alias("said"))
    precise = F.col("right") / F.greatest("held", "total")
    scored = pattern.where(F.col("hits") >= SUPPORT).join(totals, "slot").withColumn("precision", precise).where(F.col("precision") >= PRECISION)
    return scored.select("slot", "said", (F.col("precision") * F.log2("hits")).alias("score")).where(F.col("score") >= SCORE)


def bootstrap(based: DataFrame) -> DataFrame:
    """doc_id, h, kind, start, end: spans outside the base spans that contexts show to be identifiers."""
    every = written(_instances(based), "instances")
    pairs = written(every.select(F.explode("slots").alias("slot"), "word").groupBy("slot", "word").agg(F.count(F.lit(1)).alias("n")), "graph")
    frequent = pairs.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    totals = written(_occurrences(based, frequent), "totals")
    seeds = written(every.where("kind IS NOT NULL").groupBy("word").agg(F.max("kind").alias("kind")), "seeds")
    known, strong, state = seeds.select("word", F.col("kind").alias("known"), F.lit(None).cast("string").alias("only")), None, None
    while True:
        strong = _small(written(scored_patterns(pairs, known, totals), "patterns"))
        best = F.max(F.struct("score", "said")).alias("best")
        named = pairs.join(strong, "slot").groupBy("word").agg(best, F.count(F.lit(1)).alias("patterns"), F.min("slot").alias("slot"))
        found = kind_of(F.col("word"), F.col("best.said")).alias("found")
        named = named.select("word", found, F.when(F.col("patterns") == 1, F.col("slot")).alias("only")).where("found IS NOT NULL")
        grown = named.join(seeds, "word", "full").select("word", F.coalesce("kind", "found").alias("known"), F.when(F.col("kind").isNull(), F.col("only")).alias("only"))
        known = written(grown, "known")
        # words only grow in number, and so do those known by several patterns
        seen = known.agg(F.count(F.lit(1)).alias("n"), F.count("only").alias("by_one")).first()
        if seen == state:
            break
        state = seen
    open_ = every.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))
    place = ["doc_id", "h", "word", "kind", "start", "end"]
    held = open_.select(*place, F.explode_outer("slots").alias("slot")).join(strong, "slot", "left")
    held = held.groupBy(*place).agg(F.max("score").isNotNull().alias("held")).join(known, "word")
    by_itself = F.length(F.regexp_replace("word", r"[^\p{L}\p{N}]", "")) >= OWN
    added = held.where(F.col("kind").isNotNull() | F.col("held") | by_itself)
    return added.select("doc_id", "h", F.coalesce("kind", "known").alias("kind"), "start", "end")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, base and spans: arrays of (order of the kind, kind, start, end), sorted."""
    based = base_spans(docs)
    added = bootstrap(based)
    kind_order = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(ORDER)))
    extra = added.groupBy("doc_id", "h").agg(F.collect_set(F.struct(kind_order.alias("order"), "kind", "start", "end")).alias("extra"))

    own = based.select("doc_id", F.xxhash64("text").alias("h"), F.concat(*(_listed(k) for k in KINDS)).alias("base"))
    joined = own.alias("o").join(extra.alias("e"), F.col("o.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("o.h") == F.col("e.h")), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    return joined.select("o.doc_id", "base", spans.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(kind: str) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
