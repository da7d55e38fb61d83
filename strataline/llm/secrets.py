"""Secret scan with linking of credentials that come in several parts.

Certain finds (the base) are spans of three kinds: assign, access, hex.  Weak
candidates (tokens, logins, endpoints) mean nothing alone.  They are
reported only if their complement lies in the same scope, within `scope` code
points: a token needs an access identifier or a login, a login needs a secret,
an endpoint needs both.

The linking is an interval join in Spark: parts are rows, complements are
summed up first as the least and greatest start for each scope-wide bucket,
and every candidate meets its own and the two neighbouring buckets.  That is
exact and makes three rows a candidate at most, whatever a document holds.
Texts are read once; afterwards only spans move.  Documents with equal parts
have equal links, so the join runs once for each different list of parts.

Defined cases: null texts count as empty; a null doc_id stays; repeated rows
each get the same result; empty tables stay empty; only doc_id and text are
read.  Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import need, spans_of, without_overlap
from strataline.session import Scratch


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = r"(?:" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

#: Weak candidates: kind, role, pattern.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/=_-])"
LOGIN = r"(?:" + "|".join(_any_case(w) for w in ("user(?:_?name)?", "login", "account", "client_id", "access_key(?:_id)?")) + r""")["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = "(?:" + _any_case("https?://") + r"[A-Za-z0-9.-]+(?::[0-9]+)?|(?:" + "|".join(map(_any_case, ("host", "endpoint"))) + r""")["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,})"""
#: A token of so many characters may be of any letters; a shorter one has a digit or mixes cases, as a word does not, and is not itself a login or host.
LONG = 32
WEAK_KINDS = ("key", "login", "endpoint")
ROLES = {"assign": "secret", "access": "ident", "hex": "secret", "key": "secret", "login": "ident", "endpoint": "endpoint"}
NEEDS = {"key": ("ident",), "login": ("secret",), "endpoint": ("ident", "secret")}


def _of_kind(spans: Column, kind: str) -> Column:
    order = (*KINDS, *WEAK_KINDS).index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex, weak: arrays of (start, nth, end, kind)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    yes = lambda hit: F.lit(True)
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= 6
    likely = lambda hit: (F.length(hit) >= LONG) | hit.rlike("[0-9]|[a-z].*[A-Z]")
    base = need(docs, "doc_id", "text").select(
        "doc_id",
        "text",
        _of_kind(spans_of(text, ASSIGN, value), "assign").alias("assign"),
        _of_kind(spans_of(text, ACCESS, yes), "access").alias("access"),
        _of_kind(spans_of(text, HEX, yes), "hex").alias("hex"),
    )
    named = base.select("*", _of_kind(spans_of(text, TOKEN, likely), "key").alias("keys"), F.concat(_of_kind(spans_of(text, LOGIN, yes), "login"), _of_kind(spans_of(text, ENDPOINT, yes), "endpoint")).alias("named"))
    inside = lambda w, s: (w["end"] - w["start"] < LONG) & (s["start"] <= w["start"]) & (w["end"] <= s["end"])
    weak = F.concat(without_overlap(F.col("keys"), F.col("named"), inside), F.col("named"))
    return named.select("*", F.concat("assign", "access", "hex").alias("strong"), weak.alias("loose")).select("doc_id", "assign", "access", "hex", without_overlap(F.col("loose"), F.col("strong")).alias("weak"))


def links(found: DataFrame, scope: int) -> DataFrame:
    """key, added (array of spans): the weak candidates of `found` (key, all_parts) whose complements are near."""
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    rows = found.select("key", F.explode("all_parts").alias("p")).select("key", "p.*").withColumn("role", role[F.col("kind")])
    anchors = rows.where(F.col("role") != "endpoint").groupBy("key", "role", F.expr(f"start div {scope}").alias("bucket")).agg(F.min("start").alias("least"), F.max("start").alias("most"))
    wants = F.coalesce(*[F.when(F.col("kind") == k, F.array(*[F.lit(x) for x in need_])) for k, need_ in NEEDS.items()])
    asks = rows.where(F.col("kind").isin(*WEAK_KINDS)).select("key", "start", "nth", "end", "kind", F.explode(wants).alias("role"), F.size(wants).alias("wanted"))
    asks = asks.withColumn("bucket", F.explode(F.expr(f"array(start div {scope} - 1, start div {scope}, start div {scope} + 1)")))
    near = asks.join(anchors, ["key", "role", "bucket"]).where((F.col("most") >= F.col("start") - scope) & (F.col("least") <= F.col("start") + scope))
    met = near.groupBy("key", "start", "nth", "end", "kind", "wanted").agg(F.count_distinct("role").alias("met")).where("met = wanted")
    return met.groupBy("key").agg(F.collect_list(F.struct("start", "nth", "end", "kind")).alias("added"))  # spans of one text


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row."""
    scratch = Scratch(docs.sparkSession, "secrets")
    strong = F.concat("assign", "access", "hex")
    sized = parts(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        strong.alias("strong"),
        "weak",
    )
    ident = F.exists(F.concat("strong", "weak"), lambda p: p["kind"].isin("access", "login"))
    secret = F.exists(F.concat("strong", "weak"), lambda p: p["kind"].isin("assign", "hex", "key"))
    all_parts = F.array_sort(F.concat("strong", "weak"))
    found = scratch.save(sized.select("*", F.when((F.size("weak") > 0) & ident & secret, F.md5(_said(F.concat("strong", "weak")))).alias("key"), all_parts.alias("all_parts")), "parts")
    linked = links(found.where("key is not null").select("key", "all_parts").dropDuplicates(["key"]), scope)
    none = F.array().cast("array<struct<start:int,nth:int,end:int,kind:string>>")
    plain = found.where("key is null").withColumn("added", none)
    met = found.where("key is not null").join(linked, "key", "left").withColumn("added", F.coalesce("added", none))
    both = plain.unionByName(met)
    return both.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_said(F.col("strong")), 256).alias("base_sha256"), _said(F.concat("strong", "added")).alias("spans"), F.size("added").cast("long").alias("n_linked"))
