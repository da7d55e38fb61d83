"""Skills, match scores, message intents and résumés.  Native columns; rules are parameters.  The gate is in `eligibility`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of scoring.
RELATED_CREDIT, LEAST_SKILLS = 0.5, 3


def extract_skills(text: Column, patterns: dict[str, str]) -> Column:
    """Sorted names of the skills whose pattern is found; a plain substring test keeps most regular expressions from running."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when((low.contains(needle) if (needle := _needle(p)) else F.lit(True)) & low.rlike(rf"(?<![a-z0-9+#.])(?:{p})(?![a-z0-9+#])"), F.lit(name)) for name, p in patterns.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def _once(value: Column, then) -> Column:
    """then(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _needle(pattern: str) -> str:
    """A text that every match of the pattern holds, empty if none is plain."""
    return pattern if re.fullmatch(r"[a-z0-9 ]+", pattern) else ""


def related_map(pairs: list[tuple[str, str]]) -> Column:
    """Symmetric neighbours, one step: map from a skill to an array."""
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return F.create_map(*[x for k, v in sorted(near.items()) for x in (F.lit(k), F.array(*[F.lit(s) for s in sorted(v)]))])


def match(job: Column, resume: Column, related: Column, verified: Column) -> Column:
    """struct(score, matched, related, evidence, missing).

    Score: 100 * (matched + half the related) / required, half to even; null
    when the job is unverified (then all lists are empty) or asks for fewer
    than three skills (lists stay).
    """
    none = F.array().cast("array<string>")
    near = lambda s: F.array_intersect(F.coalesce(related[s], none), resume)
    matched = F.array_intersect(job, resume)
    other = F.array_except(job, resume)
    linked = F.filter(other, lambda s: F.size(near(s)) > 0)
    missing = F.filter(other, lambda s: F.size(near(s)) == 0)
    score = F.bround(100 * (F.size(matched) + RELATED_CREDIT * F.size(linked)) / F.size(job)).cast("int")
    return F.struct(
        F.when(verified & (F.size(job) >= LEAST_SKILLS), score).alias("score"),
        F.when(verified, matched).otherwise(none).alias("matched"),
        F.when(verified, linked).otherwise(none).alias("related"),
        F.when(verified, F.transform(linked, lambda s: F.array_min(near(s)))).otherwise(none).alias("evidence"),
        F.when(verified, missing).otherwise(none).alias("missing"),
    )


def match_state(score: Column, scored: Column, has_resume: Column, verified: Column) -> Column:
    return F.when(~has_resume, "no_resume").when(~verified, "no_description").when(~scored, "pending").when(score.isNull(), "insufficient").otherwise("scored")


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose pattern is found."""
    return F.coalesce(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(name)) for name, p in rules], F.lit(other))


#: Message intents, in order of precedence.
INTENTS = [
    ("digest", r"(?i)\b(?:job alert|recommended jobs|newsletter|unsubscribe)\b"),
    ("rejection", r"(?i)\b(?:not (?:be )?moving forward|regret to inform|decided (?:not )?to (?:pursue|proceed with) other|no longer under consideration)\b"),
    ("offer", r"(?i)\b(?:pleased to offer|offer letter|extend (?:you )?an offer)\b"),
    ("assessment", r"(?i)\b(?:online assessment|coding challenge|hackerrank|codesignal)\b"),
    ("interview", r"(?i)\b(?:invite you to (?:an )?interview|schedule (?:an?|your) (?:interview|call)|phone screen)\b"),
    ("action_required", r"(?i)\baction required\b"),
    ("confirmation", r"(?i)\b(?:thank you for (?:applying|your application)|application (?:was )?received)\b"),
    ("status_update", r"(?i)\b(?:status of your application|application update)\b"),
]


def message_intent(body: Column) -> Column:
    """The first intent found in a sentence that is neither conditional nor quoted."""
    sentences = F.split(F.coalesce(body, F.lit("")), r"(?<=[.!?])\s+|\n+")
    plain = F.array_join(F.filter(sentences, lambda s: ~s.rlike(r"(?i)^\s*(?:>|if\b|should you|in the event|when you\b)")), "\n")
    return first_rule(plain, INTENTS, "unknown")


def resume_structure(text: Column) -> Column:
    """struct(headings, bullets, contacts, date_ranges, lines) of a résumé's text."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")

    def of(lines: Column) -> Column:
        hits = lambda test: F.size(F.filter(lines, test))
        # an address is tried only where its sign is, as each of its letters may be where it begins
        contact = lambda x: (F.contains(x, F.lit("@")) & x.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z]{2,}")) | F.contains(x, F.lit("linkedin.com")) | F.contains(x, F.lit("github.com")) | x.rlike(r"\d{3}\)?[ .-]\d{3}[ .-]\d{4}")
        return F.struct(
            hits(lambda x: x.rlike(r"(?i)^\s*(?:education|experience|work experience|employment|projects|skills|technical skills|summary|certifications|publications|awards)\s*:?\s*$")).alias("headings"),
            hits(lambda x: x.rlike(r"^\s*(?:[-*•·–]|\d+\.)\s+")).alias("bullets"),
            hits(contact).alias("contacts"),
            hits(lambda x: x.rlike(r"(?i)\b(?:19|20)\d{2}\b\s*(?:-|–|to)\s*(?:(?:19|20)\d{2}|present|current)")).alias("date_ranges"),
            F.size(lines).alias("lines"),
        )

    return _once(split, of)


#: Weights of the assessment's components.
WEIGHTS = (0.20, 0.45, 0.15, 0.20)


def assessment(resume_text: Column, resume_skills: Column, job_text: Column, job_skills: Column, related: Column, evidenced: Column) -> Column:
    """struct(state, score, confidence): structure, requirements, title words and evidence, weighted.

    A résumé of under 200 characters is unreadable; a job text of under 400 or
    with fewer than three skills is insufficient.  A skill counts 1 with
    evidence, 0.75 if only listed, 0.5 if a related one is there.
    """
    told = F.struct(resume_structure(resume_text).alias("s"), resume_skills.alias("own"), job_skills.alias("job"), evidenced.alias("shown"))
    return _once(told, lambda t: _assessed(t["s"], resume_text, t["own"], job_text, t["job"], related, t["shown"]))


def _assessed(s: Column, resume_text: Column, resume_skills: Column, job_text: Column, job_skills: Column, related: Column, evidenced: Column) -> Column:
    size = F.size(job_skills)
    none = F.array().cast("array<string>")
    credit = F.aggregate(job_skills, F.lit(0.0), lambda a, k: a + F.when(F.array_contains(evidenced, k), 1.0).when(F.array_contains(resume_skills, k), 0.75).when(F.size(F.array_intersect(F.coalesce(related[k], none), resume_skills)) > 0, 0.5).otherwise(0.0))
    structure = 100.0 * (F.least(s["headings"], F.lit(4)) / 4 * 0.4 + F.least(s["bullets"], F.lit(8)) / 8 * 0.3 + F.least(s["contacts"], F.lit(1)) * 0.15 + F.least(s["date_ranges"], F.lit(2)) / 2 * 0.15)
    req = 100.0 * credit / F.greatest(size, F.lit(1))
    listed = 100.0 * F.size(F.array_intersect(job_skills, resume_skills)) / F.greatest(size, F.lit(1))
    shown = 100.0 * F.size(F.array_intersect(job_skills, evidenced)) / F.greatest(size, F.lit(1))
    total = F.bround(WEIGHTS[0] * structure + WEIGHTS[1] * req + WEIGHTS[2] * listed + WEIGHTS[3] * shown).cast("int")
    state = F.when(F.length(F.trim(F.coalesce(resume_text, F.lit("")))) < 200, "unreadable").when((F.length(F.trim(F.coalesce(job_text, F.lit("")))) < 400) | (size < LEAST_SKILLS), "insufficient").otherwise("assessed")
    sure = F.when((size >= 8) & (s["headings"] > 0) & (F.length(resume_text) >= 1500), "high").when(size >= 4, "medium").otherwise("low")
    return F.struct(state.alias("state"), F.when(state == "assessed", total).alias("score"), F.when(state == "assessed", sure).alias("confidence"))
