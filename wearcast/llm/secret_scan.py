"""Secret scans: character Markov models of random strings and ordinary
identifiers, compared by log-likelihood ratio; DataFrame operations only.

Base spans come from three fixed patterns.  Positions are code points: the
pieces between the matches (split) and the matches (regexp_extract_all)
alternate, so running sums of their lengths give the starts.

Both models give the chance of a character behind another one: of the character
without its case, times that of its case.  They are trained on labelled samples:
* random strings: the values of base spans, over a uniform prior of letters and
  digits (RANDOM_PRIOR characters' worth), so that few values do not matter much;
* ordinary identifiers: the distinct tokens of FOUR or more characters outside base
  spans that stand in two different texts or more, each counted once.  Pairs that are
  rare there back off to the chances of classes (letter, digit, other, end) and of
  single characters within a class, so every one of the SYMBOLS^2 pairs has a ratio.
Half of each sample (by hash) trains, the other half sets the thresholds.

A token outside the base spans is a markov span if its log-likelihood ratio is above
the threshold of its length: PRIOR_ODDS (random strings are rare), or more where
ordinary identifiers of the held-out half come higher (all but RARE of them stay
below).  A token is a longest stretch of letters, digits and +/_=- of SHORTEST or more
characters that does not touch a character beyond ASCII; letters alone that could be a
word (at most the first one a capital) are judged from WORD_LIKE characters on, as
below that no threshold tells rare words and misspellings from random letters.  Tokens
in one case are judged in lower case, as words may be shouted; for random strings the
choice of one case counts once.  Digits are alike to both models, and numbers of any
length are ordinary (NUMBERS of the sample).

The samples are counted over all documents; what reaches the driver are at most
2 * SYMBOLS^2 counts and one row a length class.  Null texts are empty and have no
spans.  Without ordinary identifiers there is no model, and base spans are all that
is found.  Repeated rows are scanned each for itself; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# fixed patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"       # maximal runs, so the same as filtering [0-9a-f]+ by length
KINDS = ("assign", "access", "hex", "markov")
SHORTEST, WORD_LIKE, FOUR = 8, 16, 4   # characters of a token that is judged, of one like a word, of a sample
CHARACTERS = "A-Za-z0-9+/_=-"
TOKEN = rf"(?<![{CHARACTERS}]|[^\x00-\x7F])[{CHARACTERS}]{{%d,}}+(?![^\x00-\x7F])"
PARTS = rf"[\x00-\x7F&&[^{CHARACTERS}]]+"
SHAPE = rf"^(?=.*(?:[0-9+/_=-]|.[A-Z]|.{{{WORD_LIKE}}}))[{CHARACTERS}]{{{SHORTEST},}}$"
SYMBOLS = 128                # ASCII; start and end of a string are symbols 2 and 3
START, END = 2, 3
LENGTHS = (8, 12, 16, 24)    # least lengths of the length classes
PRIOR_ODDS = 10.0            # log odds against a random string
RARE = 1e-4                  # share of ordinary identifiers that may come above a threshold
RANDOM_PRIOR, ORDINARY_PRIOR, NUMBERS = 2000.0, 20.0, 0.05
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _zip_spans(text: Column, pattern: str, kind: int, value: Column, keep) -> Column:
    """Spans of those matches of `pattern` (structs gap, match, value) that `keep` accepts."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    spans = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), whole.alias("match"), value.alias("value")),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
            F.when(x["match"].isNotNull() & keep(x), F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("end"), x["value"].alias("value")))))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.size(whole) > 0, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    value = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    none = F.expr(f"cast(array() as {SPAN})")
    lower = F.lower(text)
    # cheap tests first: a match of a pattern holds one of these strings
    named = F.contains(lower, F.lit("pass")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("key"))
    assign = F.when(named, _zip_spans(text, ASSIGN, 0, value(ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _zip_spans(text, ACCESS, 1, value(ACCESS, 0), lambda x: F.length(x["match"]) >= 20)).otherwise(none)
    hexes = F.when(F.rlike(text, F.lit(HEX)), _zip_spans(text, HEX, 2, value(HEX, 0), lambda x: F.length(x["match"]) >= 24)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio (random against ordinary) of each pair of characters, and
    the threshold of each class of LENGTHS; `recall` is the share of held-out base
    values above theirs, by class."""
    ratios: tuple[float, ...]
    thresholds: tuple[float, ...]
    recall: tuple[float | None, ...] = ()


def pairs(value: Column) -> Column:
    """Codes 128 * previous + next of the characters of a string, start and end included."""
    framed = F.concat(F.lit(chr(START)), value, F.lit(chr(END)))
    code = lambda i: F.ascii(F.substring(framed, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(framed) - 1), lambda i: F.least(code(i), F.lit(127)) * SYMBOLS + F.least(code(i + 1), F.lit(127)))


ONE_CASE = "^(?:[^a-z]*|[^A-Z]*)$"


def score(value: Column, ratios: tuple[float, ...]) -> Column:
    """Log-likelihood ratio of a token."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")   # one literal
    one_case = F.rlike(value, F.lit(ONE_CASE))
    chars = F.split(F.concat(F.when(one_case, F.lower(value)).otherwise(value), F.lit(chr(END))), "")
    walk = F.aggregate(chars, F.struct(F.lit(START * SYMBOLS).alias("at"), F.lit(0.0).alias("sum")), lambda held, c: F.struct(
        (F.ascii(c) * SYMBOLS).alias("at"), (held["sum"] + F.element_at(table, held["at"] + F.ascii(c) + 1)).alias("sum")), lambda held: held["sum"])
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return walk + F.when(one_case, F.greatest(letters * math.log(2) - math.log(3), F.lit(0.0))).otherwise(F.lit(0.0))


def judged(value: Column) -> Column:
    """Whether a stretch without separators is a token that the models judge."""
    return (F.length(value) >= SHORTEST) & F.rlike(value, F.lit(SHAPE))


def _by_length(length: Column, values: tuple[float, ...]) -> Column:
    out = F.lit(float(values[0]))
    for least, v in zip(LENGTHS[1:], values[1:], strict=True):
        out = F.when(length >= least, F.lit(float(v))).otherwise(out)
    return out


def samples(docs: DataFrame) -> DataFrame:
    """The labelled strings: label 1 and value of each base span, label 0 and each
    distinct ordinary identifier; `held` marks the half that sets thresholds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(text.alias("text")).select("text", base_spans(F.col("text")).alias("base"))
    random = scanned.select(F.explode("base.value").alias("value")).distinct()
    # base spans are cut out before the rest is taken apart
    rest = F.when(F.size("base") > 0, F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")).otherwise(F.col("text"))
    # the hash first: behind the explode it would be taken anew for every word
    words = scanned.select(F.xxhash64("text").alias("in"), F.split(rest, PARTS).alias("parts")) \
        .select("in", F.explode("parts").alias("value")).where(F.length("value") >= FOUR)
    ordinary = words.groupBy("value").agg(F.min("in").alias("a"), F.max("in").alias("b")).where((F.col("a") < F.col("b")) & F.rlike("value", F.lit(f"^[{CHARACTERS}]+$")))
    return random.select(F.lit(1).alias("label"), "value").unionByName(ordinary.select(F.lit(0).alias("label"), "value")) \
        .withColumn("held", F.xxhash64("value").bitwiseAND(F.lit(1)) == 1)


def _class(c: int) -> int:
    ch = chr(c)
    return 0 if ch.isalpha() else 1 if ch.isdigit() else 3 if c == END else 2


DIGIT = ord("0")


def _fold(c: int) -> int:
    return DIGIT if chr(c).isdigit() else ord(chr(c).lower())


def ratios_from(random: dict[int, int], ordinary: dict[int, int]) -> tuple[float, ...]:
    """The ratios of all pairs from the counts of pairs in both samples."""
    others = [ord(c) for c in "+/_=-"]
    share = 1 - 1 / 24                     # strings of 24 characters
    uniform = {**{c: 0.97 * share / 36 for c in range(ord("a"), ord("z") + 1)}, DIGIT: 0.97 * share * 10 / 36,
               **{c: 0.03 * share / len(others) for c in others}, END: 1 - share}

    def folded(counts):
        pair, case = {}, {}
        for code, n in counts.items():
            p, q = divmod(code, SYMBOLS)
            pair[_fold(p), _fold(q)] = pair.get((_fold(p), _fold(q)), 0) + n
            if chr(q).isalpha():
                key = (_state(p), chr(q).isupper())
                case[key] = case.get(key, 0) + n
        return pair, case

    def _state(p):
        return "u" if chr(p).isupper() else "l" if chr(p).islower() else p if p == START else "x"

    def totals(pair):
        out = {}
        for (p, _), n in pair.items():
            out[p] = out.get(p, 0) + n
        return out

    r_pair, r_case = folded(random)
    o_pair, o_case = folded(ordinary)
    every = NUMBERS * sum(o_pair.values())
    for key, part in {(START, DIGIT): 0.07, (DIGIT, DIGIT): 0.8, (DIGIT, END): 0.07, (DIGIT, ord("-")): 0.03, (ord("-"), DIGIT): 0.03}.items():
        o_pair[key] = o_pair.get(key, 0) + part * every
    r_all, o_all = totals(r_pair), totals(o_pair)
    single, move = {}, {}
    for (p, q), n in o_pair.items():
        single[q] = single.get(q, 0) + n
        move[_class(p), _class(q)] = move.get((_class(p), _class(q)), 0) + n
    size = {0: 26, 1: 1, 2: len(others), 3: 1}
    in_class = {k: sum(n for q, n in single.items() if _class(q) == k) for k in size}
    from_class = {k: sum(n for (a, _), n in move.items() if a == k) for k in size}

    def ordinary_chance(p, q):
        a, b = _class(p), _class(q)
        back = (move.get((a, b), 0) + 1) / (from_class[a] + len(size)) * (single.get(q, 0) + 1) / (in_class[b] + size[b])
        return (o_pair.get((p, q), 0) + ORDINARY_PRIOR * back) / (o_all.get(p, 0) + ORDINARY_PRIOR)

    def random_chance(p, q):
        return (r_pair.get((p, q), 0) + RANDOM_PRIOR * uniform.get(q, 1e-4)) / (r_all.get(p, 0) + RANDOM_PRIOR)

    def case_chance(case, p, q, prior):
        if not chr(q).isalpha():
            return 1.0
        up, low = case.get((_state(p), True), 0) + prior, case.get((_state(p), False), 0) + prior
        return (up if chr(q).isupper() else low) / (up + low)
    return tuple(math.log(random_chance(_fold(p), _fold(q)) / ordinary_chance(_fold(p), _fold(q)))
                 + math.log(case_chance(r_case, p, q, RANDOM_PRIOR) / case_chance(o_case, p, q, 1.0))
                 for p in range(SYMBOLS) for q in range(SYMBOLS))


def train(docs: DataFrame) -> Model | None:
    """The model from all documents; None without ordinary identifiers."""
    scratch = Scratch(docs.sparkSession, "secrets")
    known = scratch.save(samples(docs), "samples")
    rows = known.where("not held").select("label", F.explode(pairs(F.col("value"))).alias("pair")) \
        .groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()   # at most 2 * SYMBOLS^2 rows
    random, ordinary = ({r.pair: r.n for r in rows if r.label == k} for k in (1, 0))
    if not ordinary:
        return None
    ratios = ratios_from(random, ordinary)
    tried = known.where(F.col("held") & judged(F.col("value"))).select(
        "label", score(F.col("value"), ratios).alias("score"), _by_length(F.length("value"), tuple(map(float, range(len(LENGTHS))))).cast("int").alias("class"))
    top = {r["class"]: r.top for r in tried.where("label = 0").groupBy("class").agg(F.percentile_approx("score", F.lit(1 - RARE), F.lit(100_000)).alias("top")).collect()}
    thresholds = tuple(max(PRIOR_ODDS, top.get(k, PRIOR_ODDS)) for k in range(len(LENGTHS)))
    above = F.col("score") > F.element_at(F.lit(list(thresholds)), F.col("class") + 1)
    recall = {r["class"]: r.recall for r in tried.where("label = 1").groupBy("class").agg(F.avg(above.cast("double")).alias("recall")).collect()}
    scratch.drop("samples")
    return Model(ratios, thresholds, tuple(recall.get(k) for k in range(len(LENGTHS))))


BASE, SPANS = "_secret_base", "_secret_spans"   # columns that `scan` adds


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the columns BASE and SPANS (start, kind, end, value): base spans,
    and base with markov spans, by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn(BASE, base_spans(text))
    if model is None:
        return found.withColumn(SPANS, F.col(BASE))
    random = lambda v: judged(v) & (score(v, model.ratios) > _by_length(F.length(v), model.thresholds))
    # places are looked for in the few texts that hold such a token
    some = F.exists(F.split(text, PARTS), random)
    token = TOKEN % SHORTEST
    whole = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    apart = lambda s: ~F.exists(BASE, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(_zip_spans(text, token, 3, whole, lambda x: random(x["match"])), apart)
    return found.withColumn(SPANS, F.when(some, F.array_sort(F.concat(BASE, more))).otherwise(F.col(BASE)))


def _joined(spans: Column) -> Column:
    kinds = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, model: Model | None) -> DataFrame:
    """The contract's columns for every row of docs(doc_id, text)."""
    n = lambda k: F.size(F.filter(BASE, lambda s: s["kind"] == k)).cast("long")
    found = scan(docs.select("doc_id", "text"), model)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(_joined(F.col(BASE)).cast("binary"), 256).alias("base_sha256"), _joined(F.col(SPANS)).alias("spans"))


def redact(docs: DataFrame, model: Model | None, mark: str = "[secret]") -> DataFrame:
    """docs with every span of `text` replaced by `mark` (overlapping spans by one);
    the other columns stay."""
    cols = docs.columns
    found = scan(docs, model)
    cut = F.aggregate(
        SPANS, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    clean = F.when(F.size(SPANS) > 0, cut).otherwise(F.col("text"))
    return found.select(*[clean.alias("text") if c == "text" else F.col(c) for c in cols])
