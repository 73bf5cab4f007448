"""Personal data: candidates from regular expressions, selected by boosted trees.

Strict patterns give the base spans, which always count.  High-recall generators run on what
the base spans leave and propose loose forms (spelt-out signs, other separators, mistyped
numbers), which may overlap; trees boosted on format and context features score them, and
calibrated thresholds select those that are added.

No spans are labelled, so the label is evidence that owes nothing to a candidate's own form:
the company that it keeps, a strict span of another kind in the same text.  Strict spans
rewritten into loose forms, in the place where they stand, are training candidates beside
the corpus' own.  Only some personal data has company; how much, strict spans of the kind tell,
and a rate of company divided by theirs estimates precision (Elkan and Noto, 2008).  Texts and
forms that the trees haven't seen calibrate the thresholds.

Everything runs as DataFrame expressions.  Each text is read once; the boosted trees are
fitted by Spark ML on all candidates, as counts of equal features, and then applied as a SQL
expression, so no row is shuffled to be scored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._shared import written

KINDS = ("email", "ip", "card", "phone")

#: The base patterns.  Possessive repeats and starts at the first character of a run only
#: make them linear on any text and change no match: nothing that follows a run is in it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a base pattern to be tried.
GUARDS = {
    "email": "contains(t, '@')",
    "ip": "t RLIKE r'[0-9]\\.[0-9]'",
    "card": "t RLIKE r'[0-9][\\x20-]?[0-9][\\x20-]?[0-9]'",
    "phone": "t RLIKE r'\\+[0-9]'",
}
#: Candidates besides those of the base patterns.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+"
    r"(?:(?:\x20?@\x20?|\x20?[(\[{<]at[)\]}>]\x20?)[A-Za-z0-9-]{1,63}+"
    r"(?:(?:\.|\x20\.\x20|\x20?[(\[{<]dot[)\]}>]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}+){1,4}+"
    r"|\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{2,63}+){1,4}+)",
    "ip": r"(?<![0-9A-Za-z.,])[0-9]{1,3}+(?:(?:\x20?[.,:_-]\x20?|[(\[][.][)\]]|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
    r"[0-9]{1,3}+){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}+|[0-9]{4}[\x20./_|,:-]{1,3}+[0-9]{6}[\x20./_|,:-]{1,3}+[0-9]{5}"
    r"|[0-9]{4}(?:[\x20./_|,:-]{1,3}+[0-9]{4}){2}[\x20./_|,:-]{1,3}+[0-9]{2,7}+)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?(?:[0-9]{7,12}+|\(?[0-9]{1,5}+\)?(?:[()\x20./-]{1,3}+[0-9]{2,8}+){1,5}+)(?![0-9A-Za-z])",
}
#: What a text must have for a generator to be tried.
MORE_GUARDS = {
    "email": "(contains(t, '@') OR t RLIKE r'[(\\[{<]at[)\\]}>]' OR contains(t, ' dot '))",
    "ip": "t RLIKE r'[0-9][\\x20.,:_(\\[-]'",
    "card": "t RLIKE r'[0-9]{4}'",
    "phone": "t RLIKE r'[0-9]{2}'",
}
VALID = {
    "email": "true",
    "ip": r"x.m RLIKE r'\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|\z)){4}\z'",
    "card": "length(translate(x.m, ' -', '')) BETWEEN 14 AND 19 AND {luhn}",
    "phone": "length(translate(x.m, '+ ().-', '')) BETWEEN 10 AND 15",
}
#: Strict matches ``m`` rewritten into loose forms, in SQL; ``d`` are the match's digits.  The
#: forms of HELD_OUT are kept from the trees and calibrate the thresholds.
FORMS = {
    "email": {
        "round": "concat(substring_index(m, '@', 1), ' (at) ', replace(substring_index(m, '@', -1), '.', ' (dot) '))",
        "square": "concat(substring_index(m, '@', 1), '[at]', replace(substring_index(m, '@', -1), '.', '[dot]'))",
        "apart": "concat(substring_index(m, '@', 1), ' @ ', substring_index(m, '@', -1))",
        "half": "replace(m, '@', '(at)')",
        "words": "concat(substring_index(m, '@', 1), ' at ', replace(substring_index(m, '@', -1), '.', ' dot '))",
    },
    "ip": {
        "square": "replace(m, '.', '[.]')",
        "commas": "replace(m, '.', ',')",
        "apart": "replace(m, '.', ' . ')",
        "words": "replace(m, '.', ' dot ')",
        "dashes": "replace(m, '.', '-')",
    },
    "card": {
        "dots": "regexp_replace(d, '([0-9]{4})(?=[0-9])', '$1.')",
        "slashes": "regexp_replace(d, '([0-9]{4})(?=[0-9])', '$1/')",
        "mistyped": "concat(left(d, length(d) - 1), string((int(right(d, 1)) + 3) % 10))",
        "wide": "regexp_replace(d, '([0-9]{4})(?=[0-9])', '$1  ')",
        "swapped": "concat(left(d, 6), substr(d, 8, 1), substr(d, 7, 1), substr(d, 9))",
    },
    "phone": {
        "zeros": "concat('00', translate(m, '+', ''))",
        "bare": "translate(m, '+', '')",
        "slashes": "regexp_replace(translate(m, '+()', ''), '[ .-]+', '/')",
        "brackets": "regexp_replace(translate(m, '+()', ''), '^([0-9]+)[ .-]*', '($1) ')",
    },
}
HELD_OUT = {"email": ("half", "words"), "ip": ("words", "dashes"), "card": ("wide", "swapped"), "phone": ("brackets",)}
#: Words before a candidate that speak for its kind.
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": "ip|host|server|addr",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|fax|mobil|ruf|llam|appel",
}
FEATURES = (
    "kind", "chars", "digits", "groups", "letters", "dots", "spaces", "dashes", "brackets", "at", "plus",
    "zeros", "spelt", "luhn", "octets", "cue", "joined_before", "joined_after",
)
#: Estimated precision on candidates not fitted on that a kind's threshold must reach.
PRECISION = 0.8

_CHUNK = 256
_SPAN = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def _luhn(digits: str) -> str:
    at = f"int(substr({digits}, length({digits}) - i + 1, 1))"
    return (
        f"aggregate(sequence(1, length({digits})), 0, (n, i) -> n + "
        f"if(i % 2 = 1, {at}, {at} * 2 - if({at} > 4, 9, 0))) % 10 = 0"
    )


def _spans(pattern: str, guard: str, t: str = "t") -> str:
    """SQL for the matches of a pattern in ``t``: start and end in code points, the match,
    up to 24 characters before it and one after it (back to, or up to, the next match).

    Starts are running sums over the pieces between the matches, taken in chunks so that a
    text with very many matches doesn't cost the square of their number.
    """
    hits = (
        f"transform(array(split({t}, r'{pattern}', -1)), p -> transform(filter("
        f"arrays_zip(p, regexp_extract_all({t}, r'{pattern}', 0), slice(p, 2, size(p))), x -> x.`1` IS NOT NULL), "
        "x -> named_struct('gap', length(x.p), 'm', x.`1`, 'b', right(x.p, 24), 'a', left(x.`2`, 1))))[0]"
    )
    step = (
        "named_struct('at', a.at + x.gap + length(x.m), 'out', array_append(a.out, named_struct("
        "'s', a.at + x.gap, 'e', a.at + x.gap + length(x.m), 'm', x.m, 'b', x.b, 'a', x.a)))"
    )
    chunk = f"aggregate(c, named_struct('at', 0, 'out', cast(array() AS {_SPAN})), (a, x) -> {step})"
    chunks = (
        f"transform(sequence(0, int((size(h) - 1) / {_CHUNK})), "
        f"i -> transform(array(slice(h, i * {_CHUNK} + 1, {_CHUNK})), c -> {chunk})[0])"
    )
    joined = (
        "aggregate(k, named_struct('at', 0, 'out', cast(array() AS array<" + _SPAN + ">)), (a, c) -> named_struct("
        "'at', a.at + c.at, 'out', array_append(a.out, "
        "transform(c.out, y -> named_struct('s', y.s + a.at, 'e', y.e + a.at, 'm', y.m, 'b', y.b, 'a', y.a)))), "
        "a -> flatten(a.out))"
    )
    # names for what is used twice, by way of one-element arrays
    over = f"transform(array({hits}), h -> if(size(h) = 0, cast(array() AS {_SPAN}), transform(array({chunks}), k -> {joined})[0]))[0]"
    return f"if({guard}, {over}, cast(array() AS {_SPAN}))"


def _valid(kind: str) -> str:
    return VALID[kind].replace("{luhn}", _luhn("translate(x.m, ' -', '')"))


def _masked(kind: str, text: str) -> str:
    """SQL for a text whose valid matches of a base pattern are as many control characters."""
    pieces = f"split({text}, r'{BASE[kind]}', -1)"
    match = f"if({_valid(kind).replace('x.m', 'x')}, repeat('\\u0001', length(x)), x)"
    found = f"regexp_extract_all({text}, r'{BASE[kind]}', 0)"
    return f"if(size(base_{kind}) = 0, {text}, array_join(zip_with({pieces}, {found}, (p, x) -> concat(p, if(x IS NULL, '', {match}))), ''))"


def _features(kind: str) -> str:
    """SQL for the features of a candidate ``x`` (match ``m``, what is before and after it)."""

    def number(of: str) -> str:
        return f"double({of})"

    def without(chars: str) -> str:
        return number(f"length(x.m) - length(translate(x.m, '{chars}', ''))")

    digits = "regexp_replace(x.m, '[^0-9]', '')"
    parts = "regexp_extract_all(x.m, '[0-9]+', 0)"
    values = {
        "kind": number(KINDS.index(kind)),
        "chars": number("length(x.m)"),
        "digits": without("0123456789"),
        "groups": number(f"size({parts})"),
        "letters": number("length(regexp_replace(x.m, '[^A-Za-z]', ''))"),
        "dots": without("."),
        "spaces": without(" "),
        "dashes": without("-/"),
        "brackets": without("()[]{}<>"),
        "at": without("@"),
        "plus": without("+"),
        "zeros": number("startswith(x.m, '00')"),
        "spelt": number("x.m RLIKE '[^A-Za-z](at|dot)[^A-Za-z]'"),
        "luhn": number(f"length({digits}) BETWEEN 12 AND 19 AND {_luhn(digits)}"),
        "octets": number(f"size({parts}) = 4 AND forall({parts}, g -> coalesce(try_cast(g AS int), 999) <= 255)"),
        "cue": number(f"lower(x.b) RLIKE '{CUES[kind]}'"),
        "joined_before": number("right(x.b, 1) RLIKE '[A-Za-z0-9]'"),
        "joined_after": number("x.a RLIKE '[A-Za-z0-9]'"),
    }
    return "named_struct(" + ", ".join(f"'{k}', {values[k]}" for k in FEATURES) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """What one reading of the texts gives.

    ``doc_id``; the base spans by kind, with their match and what is around it; all candidates
    with their features; and whether each kind would have company.  A candidate meets no base
    span of any kind.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    out = out.withColumns({f"raw_{k}": F.expr(_spans(BASE[k], GUARDS[k])) for k in KINDS})
    out = out.withColumns({f"base_{k}": F.expr(f"filter(raw_{k}, x -> {_valid(k)})") for k in KINDS})
    # a kind's own spans go first: another kind's mask must not cut them
    for n in range(len(KINDS)):
        out = out.withColumns(
            {f"rest_{k}": F.expr(_masked(KINDS[(i + n) % 4], f"rest_{k}" if n else "t")) for i, k in enumerate(KINDS)}
        )
    out = out.withColumns(
        {f"more_{k}": F.expr(_spans(GENERATORS[k], MORE_GUARDS[k].replace("(t,", f"(rest_{k},").replace("t RLIKE", f"rest_{k} RLIKE"), f"rest_{k}")) for k in KINDS}
    )
    candidates = (
        f"transform(more_{k}, x -> named_struct('s', x.s, 'e', x.e, 'f', {_features(k)}))" for k in KINDS
    )
    company = (" OR ".join(f"size(base_{j}) > 0" for j in KINDS if j != k) for k in KINDS)
    return out.select(
        "doc_id",
        *(f"base_{k}" for k in KINDS),
        F.expr(f"concat({', '.join(candidates)})").alias("candidates"),
        F.expr(f"array({', '.join(company)})").alias("company"),
    )


# ---- boosted trees ---------------------------------------------------------------------
@dataclass
class Selector:
    """SQL for the margin of a candidate's features ``f``, and each kind's threshold."""

    margin: str
    thresholds: dict[str, float]


def _tree_sql(node) -> str:
    if node.subtreeDepth() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    return (
        f"if(f.{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D, "
        f"{_tree_sql(node.leftChild())}, {_tree_sql(node.rightChild())})"
    )


def training_candidates(scanned: DataFrame, seed: int = 11) -> DataFrame:
    """``form, company, doc, f`` of all of the corpus' candidates (form null), of all strict spans
    (form ``strict``) and of those rewritten into loose forms.

    ``doc`` is a hash of the document, by which texts are held out.
    """
    doc = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)).alias("doc")
    own = scanned.select("doc_id", doc, "company", F.explode("candidates").alias("c"))
    own = own.select(
        F.lit(None).cast("string").alias("form"), F.expr("company[int(c.f.kind)]").alias("company"), "doc", F.col("c.f").alias("f")
    )
    out = [own]
    for n, kind in enumerate(KINDS):
        strict = scanned.select("doc_id", doc, F.expr(f"company[{n}]").alias("company"), F.explode(f"base_{kind}").alias("x"))
        strict = strict.select("company", "doc", "x", F.col("x.m").alias("m"), F.expr("regexp_replace(x.m, '[^0-9]', '')").alias("d"))
        forms = ", ".join(f"'{name}', {sql}" for name, sql in FORMS[kind].items())
        loose = strict.select("company", "doc", "x", F.explode(F.expr(f"map('strict', m, {forms})")).alias("form", "loose"))
        # what the generator wouldn't find whole is no candidate
        there = F.expr(f"form = 'strict' OR regexp_extract(concat(' ', loose, ' '), r'{GENERATORS[kind]}', 0) = loose")
        loose = loose.where(there).select("form", "company", "doc", F.expr("named_struct('m', loose, 'b', x.b, 'a', x.a)").alias("x"))
        out.append(loose.select("form", "company", "doc", F.expr(_features(kind)).alias("f")))
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_


def fit_selector(scanned: DataFrame, precision: float = PRECISION, seed: int = 11) -> Selector | None:
    """Boost trees on all candidates of two thirds of the texts; None if all or none of those have
    company.

    Equal features are one row with a weight.  Spark ML takes the values to split at from
    ``maxBins ** 2`` rows or 10,000, so there are as many bins as let it take all of them.  A kind's
    threshold is the lowest at which candidates that weren't fitted on, all of the other texts,
    reach the precision, both all of them and the corpus' own (give or take two standard errors).
    A kind whose strict spans have no company gets none.
    """
    counted = training_candidates(scanned, seed).groupBy("form", "company", "doc", "f").agg(F.count("*").alias("n"))
    counted = written(counted, "pii-counts")
    held_form = F.expr(" OR ".join(f"(f.kind = {n} AND form IN {HELD_OUT[k] + ('',)})" for n, k in enumerate(KINDS)))
    held_form = F.coalesce(held_form, F.lit(False))
    strict = F.coalesce(F.col("form") == "strict", F.lit(False))
    label = F.col("company").cast("double").alias("label")
    good = F.sum(F.col("company").cast("bigint") * F.col("n")).alias("good")
    for_fit = counted.where(~strict & ~held_form & (F.col("doc") != 0)).groupBy("f", "company").agg(F.sum("n").cast("double").alias("n"))
    there = for_fit.agg(F.count("*").alias("rows"), F.count_distinct("company").alias("labels")).first()
    if there["labels"] < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(for_fit.select("f.*", label, "n"))
    boosted = GBTClassifier(
        maxIter=12, maxDepth=3, stepSize=0.3, seed=seed, checkpointInterval=-1, weightCol="n",
        maxBins=max(32, math.isqrt(there["rows"]) + 1),
    )
    model = boosted.fit(vectors.select("features", "label", "n"))
    trees = (f"{w!r}D * {_tree_sql(t._java_obj.rootNode())}" for w, t in zip(model.treeWeights, model.trees))
    margin = " + ".join(trees)
    score = F.round(F.least(F.greatest(F.expr(margin), F.lit(-5.0)), F.lit(5.0)), 2)
    kind = F.col("f.kind").cast("int").alias("kind")
    rates = counted.where(strict).groupBy(kind).agg((good / F.sum("n")).alias("rate")).collect()  # four rows at most
    rate = {r["kind"]: r["rate"] for r in rates}
    own = F.col("form").isNull().alias("own")
    tried = counted.where(~strict & (F.col("doc") == 0) & (F.col("form").isNull() | held_form))
    # at most 1001 scores a kind
    bins = tried.groupBy(kind, score.alias("score"), own).agg(F.sum("n").alias("n"), good).collect()
    thresholds = {}
    for number, name in enumerate(KINDS):
        if not rate.get(number):
            continue
        count = {True: [0.0, 0.0], False: [0.0, 0.0]}
        want = precision * rate[number]
        mine = sorted((r for r in bins if r["kind"] == number), key=lambda r: -r["score"])
        for place, row in enumerate(mine):
            count[row["own"]][0] += row["n"]
            count[row["own"]][1] += row["good"]
            if place + 1 < len(mine) and mine[place + 1]["score"] == row["score"]:
                continue
            parts = [count[True], [a + b for a, b in zip(*count.values())]]
            if all(good >= want * n - 2 * (n * want * (1 - want)) ** 0.5 for n, good in parts) and parts[1][1]:
                thresholds[name] = row["score"]
    return Selector(margin, thresholds)


def find_personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Spans of personal data in every text.

    Returns ``doc_id``, ``base`` and ``added``, arrays of ``(s, k, e)``: start, number of
    the kind in KINDS, and end (code points, end exclusive), in that order.  ``base`` has the
    leftmost non-overlapping valid matches of each base pattern; ``added`` the selected
    candidates, which meet no base span and may meet each other.  A null text is an empty one,
    without spans; rows keep their number and repeats; other columns are ignored.  Where texts
    never hold strict spans of two kinds there is nothing to learn from, and none are added.
    """
    scanned = written(scan(docs), "pii-scan")
    selector = fit_selector(scanned, precision)
    base = ", ".join(f"transform(base_{k}, x -> named_struct('s', x.s, 'k', {n}, 'e', x.e))" for n, k in enumerate(KINDS))
    added = F.expr("cast(array() AS array<struct<s:int,k:int,e:int>>)")
    if selector and selector.thresholds:
        enough = " OR ".join(
            f"(c.f.kind = {KINDS.index(k)} AND c.margin >= {t - 0.005!r}D)" for k, t in selector.thresholds.items()
        )
        margin = selector.margin.replace("f.", "c.f.")
        chosen = f"filter(transform(candidates, c -> named_struct('s', c.s, 'e', c.e, 'f', c.f, 'margin', {margin})), c -> {enough})"
        added = F.expr(f"array_sort(transform({chosen}, c -> named_struct('s', c.s, 'k', int(c.f.kind), 'e', c.e)))")
    return scanned.select("doc_id", F.expr(f"array_sort(concat({base}))").alias("base"), added.alias("added"))


def span_text(spans: str) -> str:
    """SQL for ``kind:start:end`` of each span, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)), ',')"


def redact(text: str = "text", spans: str = "spans") -> str:
    """SQL for a text whose spans (sorted, may overlap) are replaced by ``[kind]``."""
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    step = (
        f"named_struct('at', greatest(a.at, x.e), 'out', if(x.s < a.at, a.out, concat(a.out, "
        f"substr({text}, a.at + 1, x.s - a.at), element_at(array({names}), x.k + 1))))"
    )
    return f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substr({text}, a.at + 1)))"
