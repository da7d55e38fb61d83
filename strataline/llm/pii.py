"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and stay.  Beside
them, looser patterns propose candidates: national phone numbers, social
security numbers, account numbers and written-out mail addresses.  Three
labelers vote on every candidate and every base span, or abstain:

    pattern    a strict form of the kind
    gazetteer  known prefixes, country codes and domain ends
    context    cue words in the 40 code points before

Spark counts how often each (kind, votes, features) occurs; that table is
bounded by construction, whatever the corpus holds.  Expectation-maximisation
on it estimates each labeler's reliability and each cell's chance to be
personal data; a logistic classifier on the span's features is fitted to those
chances, cells weighted by their counts, and scores the candidates.  Those at
0.5 or more that do not overlap a base span are added.

Defined cases: null texts count as empty; a null doc_id stays; repeated rows
each get the same result; an empty table gives an empty result; with no
candidates at all nothing is added; only doc_id and text are read.  Native
expressions only; the driver does arithmetic on the bounded table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import need, spans_of, without_overlap
from strataline.session import Scratch

#: No match starts inside a run that was tried already, so long runs cost their length; \G lets one start where the last match ended.
#: Nothing follows the repeated groups, so they may be possessive, which Java runs through in a loop and not by recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: kind, loose pattern, strict pattern, gazetteer pattern, cue words.
CANDIDATES = {
    "local_phone": (r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", r"\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", r"\(?(?:0[1-9]|[2-9][0-9]{2}).*", r"phone|tel|call|fax|mobile|cell|contact"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"(?!000)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", r"(?!000|666)[0-8][0-9]{2}-.*", r"ssn|social|security|taxpayer"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{12,30}", r"(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE).*", r"iban|account|bank|konto"),
    "spelt_email": (r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,10}", r"[A-Za-z0-9._%+-]+\x20?\[at\]\x20?[A-Za-z0-9-]+\x20?\[dot\]\x20?[A-Za-z]+|[A-Za-z0-9._%+-]+\x20?\(at\)\x20?[A-Za-z0-9-]+\x20?\(dot\)\x20?[A-Za-z]+", r".*(?:com|org|net|edu|de|fr|es|uk)", r"mail|contact|write|reach"),
}
BASE_RULES = {
    "email": (r"[^@]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r".*\.(?:com|org|net|edu|de|fr|es|uk)", r"mail|contact|write|reach"),
    "ip": (r"(?!0\.|127\.|255\.)[0-9.]+", r"(?:10|172|192)\..*", r"ip|host|server|address|client"),
    "card": (r"[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3}", r"[3-6].*", r"card|visa|master|payment|credit"),
    "phone": (r"\+[0-9]{1,3}[\x20(.-].*", r"\+(?:1|33|34|44|49)[^0-9].*", r"phone|tel|call|fax|mobile|cell|contact"),
}
ADVERSE = r"order|invoice|version|isbn|serial|ref|page|id\b"
ALL_KINDS = (*KINDS, *CANDIDATES)
CUE_WINDOW = 40
LABELERS = ("pattern", "gazetteer", "context")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _small_parts(hit: Column) -> Column:
    def fits(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 2) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(hit, r"\."), fits)


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _card(hit: Column) -> Column:
    return F.when(F.length(_digits(hit)).between(16, 19), luhn(_digits(hit))).otherwise(F.lit(False))


def _rules(kind: str) -> tuple[str, str, str]:
    return BASE_RULES[kind] if kind in BASE_RULES else CANDIDATES[kind][1:]


def _judged(spans: Column, kind: str) -> Column:
    """Adds the votes (1 for, 0 against, 2 none) and features of each span."""
    strict, known, cues = _rules(kind)

    def judge(s: Column) -> Column:
        hit = s["hit"]
        before = F.lower(s["before"])
        cue = F.when(before.rlike(cues), F.lit(1)).when(before.rlike(ADVERSE), F.lit(0)).otherwise(F.lit(2))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.when(hit.rlike(f"^(?:{strict})$"), F.lit(1)).otherwise(F.lit(0)).alias("pattern"),
            F.when(hit.rlike(f"^(?:{known})$"), F.lit(1)).otherwise(F.lit(2)).alias("gazetteer"),
            cue.alias("context"),
            F.when(hit.rlike(r"[(\[]"), F.lit(1)).otherwise(F.lit(0)).alias("bracket"),
            F.when(hit.rlike(r"[.\x20-]"), F.lit(1)).otherwise(F.lit(0)).alias("parted"),
            F.when(F.length(_digits(hit)) >= 9, F.lit(1)).otherwise(F.lit(0)).alias("many_digits"),
        )

    return F.transform(spans, judge)


FEATURES = ("bracket", "parted", "many_digits")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, base and loose: arrays of judged spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    yes = lambda hit: F.lit(True)
    rules = {"email": (EMAIL, yes), "ip": (IP, _small_parts), "card": (CARD, _card), "phone": (PHONE, lambda hit: F.length(_digits(hit)).between(8, 15))}
    spans = need(docs, "doc_id", "text").select("doc_id", text.alias("text"), *[spans_of(text, p, keep, CUE_WINDOW).alias(k) for k, (p, keep) in rules.items()], *[spans_of(text, p[0], yes, CUE_WINDOW).alias(k) for k, p in CANDIDATES.items()])
    base = F.concat(*KINDS)
    apart = lambda c: without_overlap(c, F.col("base"))
    held = spans.select("*", base.alias("base"))
    return held.select("doc_id", F.concat(*[_judged(F.col(k), k) for k in KINDS]).alias("base"), F.concat(*[_judged(apart(F.col(k)), k) for k in CANDIDATES]).alias("loose"))


def estimate(cells: list[dict], rounds: int = 60) -> tuple[dict, list[float]]:
    """Reliabilities of the labelers by expectation-maximisation, and the chance of each cell.

    Cells hold kind, votes and n.  Every kind has its own prior; a labeler has
    a rate of positive votes on each class, over the rows it does not abstain
    on, kept off 0 and 1 by one imagined row on each side.
    """
    prior = {k: 0.5 for k in ALL_KINDS}
    rate = {lab: [0.2, 0.8] for lab in LABELERS}
    chance = [0.5] * len(cells)
    for _ in range(rounds):
        for i, c in enumerate(cells):
            odds = math.log(prior[c["kind"]] / (1 - prior[c["kind"]]))
            for lab in LABELERS:
                if c[lab] == 2:
                    continue
                no, yes = rate[lab] if c[lab] else (1 - rate[lab][0], 1 - rate[lab][1])
                odds += math.log(yes / no)
            chance[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in prior:
            own = [(p, c["n"]) for p, c in zip(chance, cells, strict=True) if c["kind"] == k]
            prior[k] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for lab in LABELERS:
            for y in (0, 1):
                own = [(p if y else 1 - p, c["n"], c[lab]) for p, c in zip(chance, cells, strict=True) if c[lab] != 2]
                rate[lab][y] = (0.2 + 0.6 * y + sum(p * n for p, n, v in own if v)) / (1 + sum(p * n for p, n, _ in own))
            if rate[lab][0] > rate[lab][1]:  # a labeler is better than chance
                rate[lab] = [sum(rate[lab]) / 2] * 2
    return rate, chance


def terms() -> list[tuple[str, str, int]]:
    """The classifier's inputs: (column, name, value that makes it 1)."""
    return [*(("kind", k, 0) for k in ALL_KINDS), *((lab, lab, v) for lab in LABELERS for v in (0, 1)), *((f, f, 1) for f in FEATURES)]


def _inputs(cell: dict) -> list[int]:
    return [j for j, (col, name, v) in enumerate(terms()) if (cell["kind"] == name if col == "kind" else cell[col] == v)]


def fit(cells: list[dict], chance: list[float], rounds: int = 300, ridge: float = 1e-3) -> list[float]:
    """Weights of the logistic classifier, by gradient steps on the cells' chances."""
    total = sum(c["n"] for c in cells) or 1
    share = [math.sqrt(c["n"] / total) for c in cells]  # rare kinds still count
    norm = sum(share) or 1
    rows = [(_inputs(c), p, s / norm) for c, p, s in zip(cells, chance, share, strict=True)]
    w = [0.0] * len(terms())
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for on, p, s in rows:
            z = max(-30.0, min(30.0, sum(w[j] for j in on)))
            miss = s * (1 / (1 + math.exp(-z)) - p)
            for j in on:
                grad[j] += miss
        w = [x - 2.0 * g for x, g in zip(w, grad, strict=True)]
    return w


def _score(s: Column, w: list[float]) -> Column:
    z = F.lit(0.0)
    for (col, name, v), x in zip(terms(), w, strict=True):
        z = z + F.when((s["kind"] == name) if col == "kind" else (s[col] == v), F.lit(float(x))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def _said(spans: Column) -> Column:
    order = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("nth"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans for every row."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.save(judged(docs), "judged")
    votes = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.*")
    cells = [r.asDict() for r in votes.groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS, *FEATURES).collect()]  # at most 8 kinds x 27 votes x 8 features
    _, chance = estimate(cells)
    w = fit(cells, chance)
    added = F.filter("loose", lambda s: _score(s, w) >= threshold)
    return found.select("doc_id", "base", added.alias("added")).select(
        "doc_id",
        *[_number_of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
