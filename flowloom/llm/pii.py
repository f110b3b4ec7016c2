"""Operator 10, personal data: weak labelers vote, EM weighs them, a span classifier decides.

DataFrame functions only; no Python runs on the executors.

Candidates: four base kinds (email, ip, card, phone) with fixed patterns, whose spans always
stay, and wider patterns for further kinds. Positions come from the pair of
``regexp_extract_all`` and ``split`` over the same pattern: the lengths of the gaps and
matches add up to code-point offsets. The patterns use possessive groups and look-behind
so that long runs cost linear time and no stack; they match what the plain ones match.

Labelers: a strict pattern, a gazetteer, the words to the left, and the shape of the match
each vote for (1), against (-1) or not at all (0). Votes are counted over all candidates
of the corpus: at most ``kinds * 3 ** labelers`` rows whatever the input, and only these
counts reach the driver. There expectation-maximisation estimates each labeler's
reliability and each pattern's posterior, and a logistic regression over kind and votes is
trained on the posteriors. Its weights go back into the plan as a map of literals.

The regexes run once: the candidates are written to the shared folder, then counted and
filtered from there. There is no shuffle of documents, so no key can be hot.

Defined cases: a null text has no span; a null doc_id keeps its row; repeated rows are
searched one by one; other columns are ignored; an empty table gives no row. Where spans of
further kinds would overlap a base span they are dropped.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import cut, table, text_or_empty

BASE = ("email", "ip", "card", "phone")
FURTHER = ("email_obfuscated", "phone_local", "national_id", "iban", "secret", "name", "address")
KINDS = BASE + FURTHER
LABELERS = 4
MIN_PROBABILITY = 0.5

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FURTHER_PATTERNS = {
    "email_obfuscated": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({](?i:at)[\])}] ?[A-Za-z0-9-]++(?: ?[\[({](?i:dot)[\])}] ?[A-Za-z0-9-]{2,}+|\.[A-Za-z0-9-]{2,}+)++",
    "phone_local": r"(?<![0-9+.()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[^\s]{6,}+",
    "name": r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][a-zà-ÿ]++(?: [A-Z][a-zà-ÿ]++){0,2}",
    "address": r"(?<![0-9A-Za-z])[0-9]{1,6}+ (?:[A-Z][a-z]++ ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?![a-z])",
}
#: One pass finds every further kind: leftmost, then in the listed order.
PATTERNS["further"] = "|".join(f"(?:{p})" for p in _FURTHER_PATTERNS.values())

#: A strict form for each kind.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}$",
    "ip": r"^(?:[1-9][0-9]{0,2})(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{3,6}){2,4})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}$",
    "email_obfuscated": r"(?i)[a-z0-9] ?[\[({]at[\])}] ?[a-z0-9-]{2,}.*[a-z]{2,}$",
    "phone_local": r"^(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$",
    "secret": r"(?=.*[0-9])(?=.*[a-zA-Z]).{12,}",
    "name": r"^(?:Mrs?|Ms|Dr|Prof)\.? [A-Z][a-z]+ [A-Z][a-z]+",
    "address": r"^[1-9][0-9]{0,4} ",
}
#: Small gazetteers as patterns: public suffixes, card ranges, country codes, given names.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|co|de|fr|es|uk|eu|us|ca|au|ch|at|it|nl|mx|br)$",
    "ip": r"^(?!0|127\.|22[4-9]|2[3-5][0-9])",
    "card": r"^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7]|35|30|36|38)",
    "phone": r"^\+(?:1|7|2[07]|3[0-4679]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "email_obfuscated": r"(?i)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$",
    "iban": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "name": r"(?i) (?:john|mary|james|anna|maria|peter|paul|david|michael|thomas|sarah|laura|jean|marie|hans|juan|jose)(?: |$)",
    "address": r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square)$",
}
#: Words to the left that speak for a kind; the last pattern speaks against any.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|mail|write|reach)\W{0,12}(?:\w{1,12}\W{1,3}){0,2}$",
    "ip": r"(?i)(?:ip|host|server|address|from|login)\W{0,12}(?:\w{1,12}\W{1,3}){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment)\W{0,12}(?:\w{1,12}\W{1,3}){0,2}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|cell|fax|whatsapp|number)\W{0,12}(?:\w{1,12}\W{1,3}){0,2}$",
    "email_obfuscated": r"(?i)(?:e-?mail|contact|mail|write|reach)\W{0,12}(?:\w{1,12}\W{1,3}){0,2}$",
    "phone_local": r"(?i)(?:phone|call|tel|mobile|cell|fax|number)\W{0,12}(?:\w{1,12}\W{1,3}){0,2}$",
    "national_id": r"(?i)(?:ssn|social|security|id)\W{0,12}(?:\w{1,12}\W{1,3}){0,2}$",
    "iban": r"(?i)(?:iban|account|bank|konto|compte|cuenta)\W{0,12}(?:\w{1,12}\W{1,3}){0,2}$",
    "name": r"(?i)(?:name|signed|by|dear|contact|sincerely)\W{0,12}$",
    "address": r"(?i)(?:address|lives?|street|located|at|home)\W{0,12}$",
}
AGAINST = r"(?i)(?:version|ver|build|isbn|order|invoice|figure|section|chapter|rfc|example)\W{0,4}$"
#: Code points to the left that the context labeler sees.
WINDOW = 40


def _positions(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, left>> of the leftmost non-overlapping matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("gap"))
    empty = F.from_json(F.lit("[]"), "array<struct<s:int,e:int,m:string,left:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), F.right(x["gap"], F.lit(WINDOW)).alias("left"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], found)).alias("out"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0).otherwise(False)


def _ip_ok(m: Column) -> Column:
    def part(x: Column) -> Column:
        y = F.regexp_replace(x, "^0+(?=[0-9])", "")
        return (F.length(y) <= 3) & (F.substring(y, 1, 3).cast("int") <= 255)

    return F.forall(F.split(m, r"\."), part)


def _passes(kind: str, m: Column) -> Column:
    """The checks of the base kinds after the pattern."""
    if kind == "card":
        return _luhn(m)
    if kind == "ip":
        return _ip_ok(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _further_kind(m: Column) -> Column:
    """Which further pattern a match came from, in the order of the alternation."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(_FURTHER_PATTERNS.items()):
        kind = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return F.coalesce(kind, F.lit("secret"))


def _vote(kind: Column, value: Column, table_: dict[str, str], miss: int) -> Column:
    """1 where the kind's pattern is found, ``miss`` where it isn't, 0 for a kind without a pattern."""
    vote = F.lit(0)
    for name, pattern in table_.items():
        vote = F.when(kind == name, F.when(value.rlike(pattern), 1).otherwise(miss)).otherwise(vote)
    return vote


def _voted(x: Column, kind: Column) -> Column:
    """The span with its kind and the labelers' votes."""
    m = x["m"]
    distinct = F.size(F.array_distinct(F.split(m, "")))
    shape = F.when(distinct <= 3, -1).when(distinct >= 6, 1).otherwise(0)
    context = F.when(x["left"].rlike(AGAINST), -1).otherwise(_vote(kind, x["left"], CONTEXT, 0))
    votes = [_vote(kind, m, STRICT, -1), _vote(kind, m, GAZETTEER, -1), context, shape]
    return F.struct(
        kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), m.alias("value"),
        F.concat_ws(",", kind, *[v.cast("string") for v in votes]).alias("pattern"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of spans that stay), further (array of spans to be decided)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    found = rows.select("doc_id", *[_positions(F.col("_text"), PATTERNS[k]).alias(f"_{k}") for k in (*BASE, "further")])

    def of(kind: str) -> Column:
        return F.transform(F.filter(f"_{kind}", lambda x: _passes(kind, x["m"])), lambda x: _voted(x, F.lit(kind)))

    kept = found.select("doc_id", F.concat(*map(of, BASE)).alias("base"), "_further")

    def free(x: Column) -> Column:
        return ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    further = F.transform(F.filter(F.col("_further"), free), lambda x: _voted(x, _further_kind(x["m"])))
    return kept.select("doc_id", "base", further.alias("further"))


def aggregate_votes(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior of each ``kind,vote,vote,...`` pattern by EM over its counts.

    A two-class model: each labeler has its own rates of 1, 0 and -1 given the truth. It
    starts from the belief that votes are right more often than wrong.
    """
    rows = [(p.split(",")[0], [int(v) for v in p.split(",")[1:]], n) for p, n in sorted(counts.items())]
    prior: dict[str, float] = defaultdict(lambda: 0.6)
    rate = [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.2, 0: 0.4, -1: 0.4}} for _ in range(LABELERS)]
    post = [0.5] * len(rows)
    for _ in range(rounds):
        for i, (kind, votes, _n) in enumerate(rows):
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, v in enumerate(votes):
                a, b = a + math.log(rate[j][1][v]), b + math.log(rate[j][0][v])
            post[i] = 1 / (1 + math.exp(max(-50, min(50, b - a))))
        mass: dict = defaultdict(lambda: [6.0, 10.0])  # a weak prior of 0.6
        for (kind, _v, n), p in zip(rows, post):
            mass[kind][0] += n * p
            mass[kind][1] += n
        prior = defaultdict(lambda: 0.6, {k: min(0.99, max(0.01, a / b)) for k, (a, b) in mass.items()})
        for j in range(LABELERS):
            for y, start in ((1, (6.0, 3.0, 1.0)), (0, (2.0, 4.0, 4.0))):
                c = dict(zip((1, 0, -1), start))
                for (_k, votes, n), p in zip(rows, post):
                    c[votes[j]] += n * (p if y else 1 - p)
                total = sum(c.values())
                rate[j][y] = {v: x / total for v, x in c.items()}
    return {p: q for (p, _), q in zip(sorted(counts.items()), post)}


def fit_spans(counts: dict[str, int], posterior: dict[str, float], steps: int = 400) -> dict[str, float]:
    """Logistic regression over kind and votes, trained on the posteriors; a probability for each pattern."""
    names = [f"kind={k}" for k in KINDS] + [f"{j}={v}" for j in range(LABELERS) for v in (1, -1)]
    at = {n: i for i, n in enumerate(names)}
    rows = []
    for p, n in sorted(counts.items()):
        kind, *votes = p.split(",")
        rows.append(([at[f"kind={kind}"]] + [at[f"{j}={v}"] for j, v in enumerate(votes) if v != "0"], math.sqrt(n), posterior[p], p))
    w, b = [0.0] * len(names), 0.0
    total = sum(r[1] for r in rows) or 1.0
    chance = {}
    for _ in range(steps):
        gw, gb = [0.0] * len(names), 0.0
        for feats, n, target, p in rows:
            q = 1 / (1 + math.exp(-max(-30, min(30, b + sum(w[i] for i in feats)))))
            chance[p] = q
            g = n * (target - q) / total
            gb += g
            for i in feats:
                gw[i] += g
        b += 2.0 * gb
        w = [x + 2.0 * (g - 1e-4 * x) for x, g in zip(w, gw)]
    return chance


def find_pii(docs: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, s, e, value), spans with the further ones that the classifier takes."""
    found = cut(candidates(docs), "pii")
    patterns = found.select(F.explode(F.concat("base", "further")).alias("x")).groupBy(F.col("x.pattern").alias("pattern")).agg(F.count("*").alias("n"))
    counts = {r["pattern"]: r["n"] for r in patterns.collect()}  # at most len(KINDS) * 3 ** LABELERS rows
    chance = fit_spans(counts, aggregate_votes(counts)) if counts else {}
    taken = [p for p, q in sorted(chance.items()) if q >= min_probability and p.split(",")[0] in FURTHER]
    more = F.filter("further", lambda x: x["pattern"].isin(taken)) if taken else F.filter("further", lambda x: F.lit(False))
    return found.select("doc_id", "base", F.concat("base", more).alias("spans"))


def _joined(spans: str) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""

    def of(kind: str) -> Column:
        return F.array_sort(F.transform(F.filter(spans, lambda x: x["kind"] == kind), lambda x: F.struct(x["s"], x["e"], x["kind"])))

    return F.array_join(F.transform(F.concat(*map(of, KINDS)), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, BASE)
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
