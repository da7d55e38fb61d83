"""The eligibility gate, role families and citizenship demands over analogue postings.

A posting is a document's text with a line after it, under a title, at a place:
titles, lines and places take turns, so every rule is met by some row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.positions import Text
from strataline.operators import eligibility, vocabulary
from strataline.plans.registry import query
from strataline.sources.tables import table

TITLES = (
    "Software Engineer", "Senior Software Engineer", "Software Engineer Intern", "Nurse", "New Grad Machine Learning Engineer", "SWE, PhD", "Software Engineer III", "Site Reliability Engineer",
    "Android Engineer", "Platform Engineer", "Compiler Engineer", "QA Engineer", "Data Scientist", "Data Engineers", "Forward Deployed Engineer", "Software Engineer - Contractor",
    "Software Engineer (Part-Time)", "Security Software Engineer", "Embedded Software Engineer", "Product Engineer", "Software Engineer - Cleared", "Backend Developer, University Graduate",
    "Member of Technical Staff, Inference Infra", "Vice President, Full-Stack Engineer", "Factory Software Engineer", "Smart Contract Software Engineer", "Runtime Engineer", "DevOps Software Engineer", "Software Engineers, Infrastructure",
)
LINES = (
    "", "Minimum qualifications\n5+ years of software experience.", "Requirements: 2-5 years of experience.", "Preferred qualifications\n8+ years of industry experience.", "At least three years of programming.",
    "You must be a U.S. citizen.", "You must be a U.S. citizen or eligible for export licensing.", "An active Top Secret clearance is needed.", "We will not sponsor visas.", "You write C++ every day.",
    "You write C++ and Python.", "Join us as a participant in paid tasks.", "Work with FPGA, firmware and UART.", "A PhD is required.", "Export control rules apply.", "No more than 3 years of professional experience.",
    "Two or more years of experience.",
)
PLACES = ("Seattle, WA", "Remote", "London, England", "Bengaluru", "New York", "Ottawa, ON, CA", "")
KINDS = ("Full-time", "Contract", None, "part_time", None)


def _pick(words: tuple, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))


def _list(words: tuple) -> str:
    return "[" + ", ".join("NULL" if w is None else "'" + w.replace("\n", "' || chr(10) || '") + "'" for w in words) + "]"


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", _pick(TITLES, k).alias("title"), F.concat_ws("\n", "text", _pick(LINES, k)).alias("description"), _pick(PLACES, k).alias("location"), _pick(KINDS, k).alias("kind"))


_POSTINGS = f"""p AS (SELECT doc_id, {_list(TITLES)}[doc_id % {len(TITLES)} + 1] AS title, concat_ws(chr(10), text, {_list(LINES)}[doc_id % {len(LINES)} + 1]) AS description,
{_list(PLACES)}[doc_id % {len(PLACES)} + 1] AS location, coalesce(lower({_list(KINDS)}[doc_id % {len(KINDS)} + 1]), '') AS kind FROM documents)"""
#: Titles by family, least rule first.
_FAMILY = r"""CASE WHEN regexp_matches(t, '\bfactory\b') THEN 'OTHER' WHEN regexp_matches(t, '\bcompilers?\b') THEN 'COMPILER_ENGINEERING' WHEN regexp_matches(t, '\bruntimes?\b') THEN 'RUNTIME_ENGINEERING'
WHEN regexp_matches(t, '\b(qa|sdet)\b') THEN 'QUALITY_ASSURANCE' WHEN regexp_matches(t, '\bforward deployed (software )?engineer\b') THEN 'FORWARD_DEPLOYED_ENGINEERING' WHEN regexp_matches(t, '\bsite[- ]reliability\b') THEN 'SITE_RELIABILITY_ENGINEERING'
WHEN regexp_matches(t, '\bmachine learning engineer\b') OR (regexp_matches(t, 'member of technical staff') AND regexp_matches(t, '\binference\b.*\binfra')) THEN 'AI_ML_ENGINEERING' WHEN regexp_matches(t, '\bandroid\b') THEN 'MOBILE_ENGINEERING'
WHEN regexp_matches(t, '\bdev[ -]?ops\b') OR (regexp_matches(t, '\b(platform|infrastructure) engineer\b') AND NOT regexp_matches(t, '\bsoftware engineer\b')) THEN 'INFRASTRUCTURE_ENGINEERING'
WHEN regexp_matches(t, '\bsoftware engineers?\b|\bswe\b|\bbackend developer\b|\bfull[- ]?stack\b') THEN 'SOFTWARE_ENGINEERING' WHEN regexp_matches(t, '\bdata engineers?\b') THEN 'DATA_ENGINEERING' WHEN regexp_matches(t, '\bdata scientist\b') THEN 'DATA_SCIENCE' ELSE 'OTHER' END"""


@query(f"""WITH {_POSTINGS}, f AS (SELECT doc_id, {_FAMILY} AS family FROM (SELECT doc_id, lower(title) AS t FROM p))
SELECT doc_id, family, CASE WHEN family IN ('SOFTWARE_ENGINEERING', 'AI_ML_ENGINEERING') THEN 'PRIMARY' WHEN family IN ('FORWARD_DEPLOYED_ENGINEERING', 'DATA_ENGINEERING', 'DATA_SCIENCE') THEN 'SECONDARY' ELSE 'NONE' END AS priority FROM f""")
def role_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _postings(spark, sf_dir).select("doc_id", eligibility.role_family(F.col("title")).alias("family"))
    return rows.select("doc_id", "family", eligibility.role_priority(F.col("family")).alias("priority"))


#: A demand, some words, and a way to a licence: the words tell whether it is near.
_DEMAND, _ROUTE, _SHUT = "You must be a U.S. citizen.", "eligible for export licensing", "without obtaining an export license"
_AT = "strpos(d, 'must be a U.S. citizen')"


@query(f"""WITH t AS (SELECT doc_id, concat_ws(chr(10), text, '{_DEMAND}') || repeat(' word', (doc_id % 60)::INTEGER) || CASE WHEN doc_id % 3 = 0 THEN ' {_SHUT}' WHEN doc_id % 3 = 1 THEN ' {_ROUTE}' ELSE '' END AS d FROM documents)
SELECT doc_id, NOT contains(replace(substr(d, greatest({_AT} - 200, 1), {_AT} + 22 + 200 - greatest({_AT} - 200, 1)), '{_SHUT}', ' '), 'eligible for export licens') AS demanded FROM t""")
def citizenship_demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demands with a way to a licence at 0 to 300 code points from them, with one that is shut, and with none."""
    k = F.col("doc_id")
    way = F.when(k % 3 == 0, f" {_SHUT}").when(k % 3 == 1, f" {_ROUTE}").otherwise("")
    said = F.concat(F.concat_ws("\n", "text", F.lit(_DEMAND)), F.repeat(F.lit(" word"), (k % 60).cast("int")), way)
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("d")).select("doc_id", eligibility.demands_citizenship(Text.of(F.col("d"))).alias("demanded"))


_CODES = r"""list_filter([
CASE WHEN family = 'OTHER' THEN 'NON_TARGET_ROLE' END,
CASE WHEN family IN ('SITE_RELIABILITY_ENGINEERING', 'MOBILE_ENGINEERING', 'INFRASTRUCTURE_ENGINEERING', 'COMPILER_ENGINEERING', 'RUNTIME_ENGINEERING', 'QUALITY_ASSURANCE') THEN 'NON_TARGET_ROLE' END,
CASE WHEN NOT regexp_matches(location, ', WA$|^New York$|^Remote$') THEN 'OUTSIDE_US' END,
CASE WHEN regexp_matches(t, '\bsenior\b|\bvice president\b') THEN 'SENIOR_TITLE' END,
CASE WHEN regexp_matches(t, '\bphd\b') OR contains(d, 'a phd is required') THEN 'PHD_TARGETED_ROLE' END,
CASE WHEN regexp_matches(t, '\bengineer iii\b') AND coalesce(years > 3, true) THEN 'SENIOR_TITLE' END,
CASE WHEN floor_ >= 3 OR years >= 4 THEN 'EXPERIENCE_TOO_HIGH' END,
CASE WHEN regexp_matches(t, '\bintern\b') THEN 'INTERNSHIP_ROLE' END,
CASE WHEN contains(kind, 'contract') OR (regexp_matches(t, '\bcontract(or)?\b') AND NOT contains(t, 'smart contract')) THEN 'CONTRACT_ROLE' END,
CASE WHEN regexp_matches(t, 'part[-_ ]?time') OR regexp_matches(kind, 'part[-_ ]?time') THEN 'PART_TIME_ROLE' END,
CASE WHEN regexp_matches(d, 'join us as a participant') AND contains(d, 'paid tasks') THEN 'NON_TARGET_ROLE' END,
CASE WHEN regexp_matches(t, '\bsecurity\b') THEN 'SECURITY_ROLE' END,
CASE WHEN regexp_matches(t, '\bembedded\b') OR (contains(d, 'fpga') AND contains(d, 'firmware') AND contains(d, 'uart')) THEN 'HARDWARE_EMBEDDED_ROLE' END,
CASE WHEN contains(d, 'you write c++') AND NOT contains(d, 'python') THEN 'SYSTEMS_LANGUAGE_ONLY' END,
CASE WHEN contains(d, 'must be a u.s. citizen') AND NOT contains(d, 'eligible for export licensing') THEN 'CITIZENSHIP_BLOCKER' END,
CASE WHEN contains(d, 'top secret') OR regexp_matches(t, '\bcleared\b') THEN 'CLEARANCE_BLOCKER' END,
CASE WHEN contains(d, 'will not sponsor') THEN 'SPONSORSHIP_BLOCKER' END], lambda x: x IS NOT NULL)"""
_NOTES = r"""list_filter(['NO_HARD_BLOCKER', CASE WHEN location = 'Remote' THEN 'LOCATION_UNCERTAIN' END, CASE WHEN length(trim(description)) < 400 THEN 'REQUIREMENTS_NOT_VERIFIED' END,
CASE WHEN coalesce(years <= 2, true) AND coalesce(top <= 4, true) AND (regexp_matches(t, '\bnew grad\b|\buniversity graduate\b') OR years IS NOT NULL) THEN 'EARLY_CAREER_SIGNAL' END, CASE WHEN regexp_matches(t, '\bnew grad\b|\buniversity graduate\b') THEN 'NEW_GRAD_TITLE' END,
CASE WHEN contains(d, 'export control rules') THEN 'EXPORT_CONTROL_CAVEAT' END], lambda x: x IS NOT NULL)"""


@query(rf"""WITH {_POSTINGS}, y AS (SELECT *, lower(title) AS t, lower(description) AS d, replace(replace(lower(description), 'at least three', 'at least 3'), 'two or more', '2+') AS n FROM p),
z AS (SELECT *, {_FAMILY} AS family, regexp_extract(n, '(\d{{1,2}})-\d{{1,2}} years of experience', 1) AS low, regexp_extract(n, '\d{{1,2}}-(\d{{1,2}}) years of experience', 1) AS high, regexp_extract(n, '(\d{{1,2}})\+? years of', 1) AS one,
regexp_matches(n, 'preferred qualifications' || chr(10)) AS soft, regexp_matches(n, '\d\+ years of|at least \d years of') AS open_ FROM y),
x AS (SELECT *, nullif(CASE WHEN low <> '' THEN low ELSE one END, '')::INTEGER AS years, nullif(high, '')::INTEGER AS top, CASE WHEN open_ AND low = '' AND NOT soft THEN nullif(one, '')::INTEGER END AS floor_ FROM z),
c AS (SELECT doc_id, family, years, {_CODES} AS codes, {_NOTES} AS notes FROM x)
SELECT doc_id, CASE WHEN len(codes) > 0 THEN 'REJECT' ELSE 'PASS' END AS status, family, years, array_to_string(CASE WHEN len(codes) > 0 THEN codes ELSE notes END, ',') AS codes FROM c""")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = eligibility.gate(F.col("title"), F.col("description"), F.col("location"), F.col("kind"))
    rows = _postings(spark, sf_dir).select("doc_id", g.alias("g"))
    return rows.select("doc_id", "g.status", "g.family", "g.years", F.array_join("g.codes", ",").alias("codes"))


#: A sentence with one spelling of a skill for each document in turn, and with what is none.
_SPELLINGS = tuple(t + ("xyz" if more == "+" else "") for _, aliases in vocabulary.SKILLS.items() for a in aliases for t, more in vocabulary.spellings(a)) + ("goland", "rustic", "sqlite", "c", "scalabl", "resilien", "data-model")
_SAID = f"concat_ws(chr(10), text, 'We use (' || {_list(_SPELLINGS)}[doc_id % {len(_SPELLINGS)} + 1] || ').')"
_PATTERNS = ", ".join(
    "('" + name + "', '" + ("\\b" if t[0].isalnum() else "") + "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in t) + ("\\w" if more == "+" else "\\b" if not more and t[-1].isalnum() else "") + "')"
    for name, aliases in vocabulary.SKILLS.items() for a in aliases for t, more in vocabulary.spellings(a)
)
_SKILLS = f"d AS (SELECT doc_id, lower({_SAID}) AS said FROM documents), v(name, pattern) AS (VALUES {_PATTERNS}), m AS (SELECT DISTINCT doc_id, name FROM d JOIN v ON regexp_matches(said, pattern))"


def _skilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat_ws("\n", "text", F.concat(F.lit("We use ("), _pick(_SPELLINGS, F.col("doc_id")), F.lit(").")))
    docs = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"))
    return vocabulary.names_by_key(docs, "doc_id", "said", vocabulary.dictionary(spark, vocabulary.SKILLS))


@query(f"WITH {_SKILLS} SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS skills FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id")
def skills_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills of the whole vocabulary in each document."""
    return _skilled(spark, sf_dir).select(F.col("key").alias("doc_id"), F.array_join("names", ",").alias("skills"))


@query(f"WITH {_SKILLS} SELECT name AS skill, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 1) AS share FROM m WHERE name NOT IN ('python', 'sql') GROUP BY 1")
def vocabulary_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents ask for each skill that a résumé of two lacks."""
    every = _skilled(spark, sf_dir).select("names")
    lacking = F.array_except("names", F.array(F.lit("python"), F.lit("sql")))
    told = every.select(F.explode(F.array_append(lacking, F.lit(None).cast("string"))).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    # the row without a skill counts the documents
    total = told.where("skill is null").select(F.col("n").alias("total"))
    return told.where("skill is not null").crossJoin(total).select("skill", "n", F.bround(100.0 * F.col("n") / F.col("total"), 1).alias("share"))
