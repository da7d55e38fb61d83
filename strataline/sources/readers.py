"""Landed payloads to canonical posting rows.

Nothing is fetched here: a reader takes a DataFrame of payloads (text columns
read by Spark from wherever they landed) and projects them onto CANONICAL.
Every JSON reader is a schema, a path to the list and a mapping of fields, so
a new source is a new entry.  Null, empty and malformed payloads give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions import dates, text, urls

CANONICAL = (
    "source string, company string, external_id string, requisition_id string, title string, location string, description string, official_url string, "
    "posted_at timestamp, updated_at timestamp, employment_type string, hiring_organizations array<string>"
)
FIELDS = [f.split()[0] for f in CANONICAL.split(", ")]


@dataclass(frozen=True)
class JsonSource:
    """How a board's JSON is read: schema of one posting, where the list stands, and each canonical field as SQL over `j`."""

    schema: str
    items: str
    fields: dict[str, str]


_ISO = "try_to_timestamp(j.{0})"
_MS = "timestamp_millis(j.{0})"

JSON_SOURCES: dict[str, JsonSource] = {
    "greenhouse": JsonSource(
        "id long, internal_job_id long, requisition_id string, title string, absolute_url string, updated_at string, first_published string, content string, location struct<name:string>, offices array<struct<name:string>>",
        "jobs",
        {"external_id": "cast(j.id as string)", "requisition_id": "j.requisition_id", "title": "j.title", "location": "j.location.name", "description": "j.content", "official_url": "j.absolute_url", "posted_at": _ISO.format("first_published"), "updated_at": _ISO.format("updated_at")},
    ),
    "ashby": JsonSource(
        "id string, title string, location string, secondaryLocations array<struct<location:string>>, descriptionHtml string, descriptionPlain string, jobUrl string, publishedAt string, employmentType string, isListed boolean",
        "jobs",
        {"external_id": "if(coalesce(j.isListed, true), j.id, null)", "title": "j.title", "location": "array_join(array_compact(concat(array(j.location), coalesce(transform(j.secondaryLocations, x -> x.location), array()))), '; ')", "description": "coalesce(j.descriptionPlain, j.descriptionHtml)", "official_url": "j.jobUrl", "posted_at": _ISO.format("publishedAt"), "employment_type": "j.employmentType"},
    ),
    "lever": JsonSource(
        "id string, text string, hostedUrl string, createdAt long, descriptionPlain string, additionalPlain string, lists array<struct<text:string, content:string>>, categories struct<location:string, commitment:string, allLocations:array<string>>",
        "",
        {"external_id": "j.id", "title": "j.text", "location": "coalesce(array_join(j.categories.allLocations, '; '), j.categories.location)", "description": "concat_ws('\\n', j.descriptionPlain, array_join(transform(j.lists, x -> concat_ws('\\n', x.text, x.content)), '\\n'), j.additionalPlain)", "official_url": "j.hostedUrl", "posted_at": _MS.format("createdAt"), "employment_type": "j.categories.commitment"},
    ),
    "smartrecruiters": JsonSource(
        "id string, name string, refNumber string, releasedDate string, location struct<city:string, region:string, country:string>, typeOfEmployment struct<label:string>, company struct<name:string>",
        "content",
        {"external_id": "j.id", "requisition_id": "j.refNumber", "title": "j.name", "location": "concat_ws(', ', j.location.city, j.location.region, upper(j.location.country))", "posted_at": _ISO.format("releasedDate"), "employment_type": "j.typeOfEmployment.label"},
    ),
    "workday": JsonSource(
        "title string, externalPath string, locationsText string, postedOn string, bulletFields array<string>",
        "jobPostings",
        {"external_id": "coalesce(get(j.bulletFields, 0), j.externalPath)", "requisition_id": "get(j.bulletFields, 0)", "title": "j.title", "location": "j.locationsText", "official_url": "j.externalPath"},
    ),
    "amazon": JsonSource(
        "id_icims string, title string, location string, description string, basic_qualifications string, preferred_qualifications string, job_path string, posted_date string, updated_time string",
        "jobs",
        {"external_id": "j.id_icims", "title": "j.title", "location": "j.location", "description": "concat_ws('\\n', j.description, j.basic_qualifications, j.preferred_qualifications)", "official_url": "concat('https://www.amazon.jobs', j.job_path)", "posted_at": "try_to_timestamp(j.posted_date, 'MMMM d, yyyy')"},
    ),
    "eightfold": JsonSource(
        "id long, display_job_id string, name string, location string, locations array<string>, job_description string, canonicalPositionUrl string, t_create long, t_update long",
        "positions",
        {"external_id": "cast(j.id as string)", "requisition_id": "j.display_job_id", "title": "j.name", "location": "coalesce(array_join(j.locations, '; '), j.location)", "description": "j.job_description", "official_url": "j.canonicalPositionUrl", "posted_at": "timestamp_seconds(j.t_create)", "updated_at": "timestamp_seconds(j.t_update)"},
    ),
    "oracle_recruiting": JsonSource(
        "Id string, Title string, PrimaryLocation string, PostedDate string, ShortDescriptionStr string, ExternalURL string",
        "items[0].requisitionList",
        {"external_id": "j.Id", "title": "j.Title", "location": "j.PrimaryLocation", "description": "j.ShortDescriptionStr", "official_url": "j.ExternalURL", "posted_at": _ISO.format("PostedDate")},
    ),
    "workable": JsonSource(
        "shortcode string, title string, city string, state string, country string, description string, url string, published_on string, employment_type string",
        "jobs",
        {"external_id": "j.shortcode", "title": "j.title", "location": "concat_ws(', ', nullif(j.city, ''), nullif(j.state, ''), nullif(j.country, ''))", "description": "j.description", "official_url": "j.url", "posted_at": _ISO.format("published_on"), "employment_type": "j.employment_type"},
    ),
    "ibm": JsonSource(
        "_id string, _source struct<title:string, description:string, url:string, field_keyword_19:string, dcdate:string>",
        "hits.hits",
        {"external_id": "j._id", "title": "j._source.title", "location": "j._source.field_keyword_19", "description": "j._source.description", "official_url": "j._source.url", "posted_at": _ISO.format("_source.dcdate")},
    ),
    "bytedance": JsonSource(
        "id string, code string, title string, description string, requirement string, city_info struct<en_name:string>, publish_time long",
        "data.job_post_list",
        {"external_id": "j.id", "requisition_id": "j.code", "title": "j.title", "location": "j.city_info.en_name", "description": "concat_ws('\\n', j.description, j.requirement)", "posted_at": _MS.format("publish_time")},
    ),
    "atlassian": JsonSource(
        "id string, title string, locations array<string>, overview string, responsibilities string, qualifications string, portalJobPost struct<portalUrl:string, updatedDate:string>",
        "",
        {"external_id": "j.id", "title": "j.title", "location": "array_join(j.locations, '; ')", "description": "concat_ws('\\n', j.overview, j.responsibilities, j.qualifications)", "official_url": "j.portalJobPost.portalUrl", "updated_at": _ISO.format("portalJobPost.updatedDate")},
    ),
    "jibe": JsonSource(
        "data struct<req_id:string, slug:string, title:string, full_location:string, description:string, apply_url:string, posted_date:string, employment_type:string>",
        "jobs",
        {"external_id": "coalesce(j.data.slug, j.data.req_id)", "requisition_id": "j.data.req_id", "title": "j.data.title", "location": "j.data.full_location", "description": "j.data.description", "official_url": "j.data.apply_url", "posted_at": _ISO.format("data.posted_date"), "employment_type": "j.data.employment_type"},
    ),
    "gem": JsonSource(
        "id string, title string, location struct<name:string>, content_plain string, absolute_url string, first_published_at string, employment_type string",
        "",
        {"external_id": "j.id", "title": "j.title", "location": "j.location.name", "description": "j.content_plain", "official_url": "j.absolute_url", "posted_at": _ISO.format("first_published_at"), "employment_type": "j.employment_type"},
    ),
    "simplify": JsonSource(
        "id string, company_name string, title string, locations array<string>, url string, date_posted long, date_updated long, active boolean, is_visible boolean, category string",
        "",
        {"company": "j.company_name", "external_id": "if(coalesce(j.is_visible, true) and coalesce(j.active, true), j.id, null)", "title": "j.title", "location": "array_join(j.locations, '; ')", "official_url": "j.url", "posted_at": "timestamp_seconds(j.date_posted)", "updated_at": "timestamp_seconds(j.date_updated)"},
    ),
}


def canonical(rows: DataFrame) -> DataFrame:
    """The canonical columns, in order; those that are absent are null, HTML in descriptions is made text."""
    types = dict(f.split(" ", 1) for f in CANONICAL.split(", "))
    out = rows.select(*[(F.col(f) if f in rows.columns else F.lit(None)).cast(types[f]).alias(f) for f in FIELDS])
    html = F.col("description").rlike(r"<[a-zA-Z/][^>]*>|&[a-z#0-9]+;")
    return out.withColumn("description", F.when(html, text.html_to_text(text.unescape(F.col("description")))).otherwise(F.col("description")))


def read_json(payloads: DataFrame, kind: str, payload: str = "payload", company: str = "company") -> DataFrame:
    """Canonical rows of landed JSON documents of one kind of board; an unknown kind is an error."""
    if kind not in JSON_SOURCES:
        raise ValueError(f"no reader for {kind}")
    source = JSON_SOURCES[kind]
    text_ = F.get_json_object(F.col(payload), f"$.{source.items}") if source.items else F.col(payload)
    rows = payloads.select(F.col(company).alias("__company"), F.explode(F.from_json(text_, f"array<struct<{_struct(source.schema)}>>")).alias("j"))
    rows = rows.select(F.lit(kind).alias("source"), F.expr(source.fields.get("company", "__company")).alias("company"), *[F.expr(v).alias(k) for k, v in source.fields.items() if k != "company"])
    return canonical(rows.where("external_id is not null"))


def _struct(schema: str) -> str:
    """The fields of a DDL schema as those of a struct type."""
    depth, out, name_done = 0, [], False
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if depth == 0 and ch == " " and not name_done and out and out[-1] not in (" ", ","):
            out.append(":")
            name_done = True
            continue
        if depth == 0 and ch == ",":
            name_done = False
        out.append(ch)
    return "".join(out).replace(", ", ",")


def with_details(listed: DataFrame, details: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Listed rows completed by stored or fresh details of the same external_id, for titles that are wanted."""
    d = details.select("external_id", *[F.col(c).alias(f"__{c}") for c in details.columns if c != "external_id"])
    rows = (listed if wanted is None else listed.where(wanted)).join(d, "external_id", "left")
    return rows.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in details.columns and c != "external_id" else F.col(c) for c in listed.columns])


def union_slices(slices: list[DataFrame]) -> DataFrame:
    """Pages or facets of one board as one snapshot: each external_id once."""
    out = slices[0]
    for s in slices[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["external_id"])


def without_direct(feed: DataFrame, boards: DataFrame) -> DataFrame:
    """Feed rows whose link does not belong to a board that is read directly (boards: type, account)."""
    found = urls.hiring_system(F.col("official_url"))
    keyed = feed.withColumn("__b", urls.board_key(found["type"], found["account"]))
    return keyed.join(boards.select(urls.board_key(F.col("type"), F.col("account")).alias("__b")).distinct(), "__b", "left_anti").select(*feed.columns)


def _json_nodes(blocks: DataFrame, depth: int = 3) -> DataFrame:
    """page, node (JSON text): the objects of `blocks` (page, node), of their lists and of their @graph, down to `depth` lists or graphs within one another."""
    listed = lambda n: F.when(n.startswith("["), F.from_json(n, "array<string>")).otherwise(F.array(n))
    found, rows = None, blocks
    for _ in range(depth):
        rows = rows.select("page", F.explode(listed(F.trim("node"))).alias("node"))
        objects = rows.where(F.col("node").startswith("{"))
        found = objects if found is None else found.unionByName(objects)
        graph = F.from_json("node", "`@graph` string")["@graph"]
        rows = rows.select("page", F.when(F.col("node").startswith("["), F.col("node")).otherwise(graph).alias("node")).where("node is not null")
    return found


def read_job_posting_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Canonical rows of every schema.org JobPosting that pages carry as ld+json, in any block, list or @graph."""
    block = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>\s*(.*?)\s*</script>"), F.lit(1))
    nodes = _json_nodes(pages.select(F.col(url).alias("page"), F.explode(block).alias("node")))
    kind = F.from_json("node", "`@type` string")["@type"]
    kinds = F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
    nodes = nodes.where(F.array_contains(kinds, "JobPosting"))
    schema = "title string, description string, datePosted string, employmentType string, url string, identifier struct<value:string>, hiringOrganization struct<name:string>, jobLocation struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>"
    j = nodes.select("page", F.from_json("node", schema).alias("j")).where("j.title is not null")
    address = F.col("j.jobLocation.address")
    return canonical(j.select(F.lit("sitemap").alias("source"), F.col("j.hiringOrganization.name").alias("company"), F.coalesce("j.identifier.value", "page").alias("external_id"), F.col("j.title").alias("title"), F.concat_ws(", ", address["addressLocality"], address["addressRegion"], address["addressCountry"]).alias("location"), F.col("j.description").alias("description"), F.coalesce("j.url", "page").alias("official_url"), F.try_to_timestamp("j.datePosted").alias("posted_at"), F.col("j.employmentType").alias("employment_type"), F.array("j.hiringOrganization.name").alias("hiring_organizations")))


def sitemap_links(xml: DataFrame, column: str = "value") -> DataFrame:
    """The addresses of sitemaps and sitemap indexes, each once."""
    return xml.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).distinct()


def page_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, row int, cells array<string> of every HTML table row."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "__tr"))
    cells = F.transform(F.regexp_extract_all("__tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), text.html_to_text)
    return rows.select("page_id", "row", cells.alias("cells"))


def markdown_roles(lists: DataFrame, today, key: str = "list_key", body: str = "markdown") -> DataFrame:
    """list_key, line, company, title, location, link, listed_on of job tables in markdown.

    A row that begins with an arrow belongs to the company above; rows with a
    lock are closed and left out; "3d" is an age, "Nov 12" a date.
    """
    lines = lists.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("line", "raw")).where(F.col("raw").rlike(r"^\s*\|.*\|\s*$") & ~F.col("raw").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select(key, "line", "raw", cells.alias("c")).where((F.size("c") >= 4) & ~F.lower(F.get("c", 0)).isin("company", "name", "company name", "role", "position", "location"))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(text.html_to_text(x), r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]+", ""))
    link = F.nullif(F.regexp_extract("raw", r"(https?://[^\s)\"'>|]+)", 1), F.lit(""))
    # each cell is a column of its own, so that it is read once
    read = rows.select(key, "line", plain(F.get("c", 0)).alias("own"), plain(F.get("c", 1)).alias("title"), plain(F.get("c", 2)).alias("location"), link.alias("link"), plain(F.element_at("c", -1)).alias("last"), F.col("raw").contains("🔒").alias("locked"))
    own, last = F.col("own"), F.col("last")
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(F.when(~own.startswith("↳") & (own != ""), own), ignorenulls=True).over(w)
    age = F.regexp_extract(last, r"^(\d+)d$", 1).try_cast("int")
    named = read.select(key, "line", carried.alias("company"), "title", "location", "link", F.coalesce(F.date_sub(F.lit(today), age), dates.parse_date(last, today)).alias("listed_on"), "locked")
    return named.where("not locked").drop("locked")


#: Headers of imported sheets, longest first within a field.
HEADERS = {
    "company": ("company name", "organization", "employer", "company"),
    "title": ("position title", "job title", "position", "title", "role"),
    "applied_at": ("application date", "date applied", "applied on", "applied", "date"),
    "url": ("job link", "posting", "link", "url"),
    "status": ("application status", "status", "stage"),
    "location": ("location", "city"),
}


def map_columns(headers: list[str]) -> dict[str, str]:
    """Field to header: longest synonym first, exact before contained, each header once."""
    free = {h: " ".join(h.lower().replace("_", " ").split()) for h in headers}
    out: dict[str, str] = {}
    for exact in (True, False):
        for field, names in HEADERS.items():
            if field in out:
                continue
            for name in sorted(names, key=len, reverse=True):
                hit = next((h for h, low in free.items() if (low == name if exact else name in low)), None)
                if hit is not None:
                    out[field] = hit
                    free.pop(hit)
                    break
    return out


#: Written statuses and what they stand for.
STATUSES = {
    "applied": "applied", "submitted": "applied", "screening": "screening", "phone screen": "screening", "interview": "interviewing", "interviewing": "interviewing",
    "onsite": "interviewing", "offer": "offer", "accepted": "accepted", "rejected": "rejected", "declined": "rejected", "withdrawn": "withdrawn", "ghosted": "no_response",
}


def parse_status(value: Column) -> Column:
    """An exact synonym, else the longest one the value begins with, else null."""
    low = text.folded(value)
    exact = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])[low]
    return F.coalesce(exact, *[F.when(low.startswith(k), F.lit(v)) for k, v in sorted(STATUSES.items(), key=lambda kv: -len(kv[0]))])


def read_sheet(spark: SparkSession, path: str, today, sep: str = ",") -> DataFrame:
    """row_number, company, title, url, location, applied_at, status of an imported CSV or TSV; blank rows are left out."""
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', mode="PERMISSIVE")
    names = map_columns(raw.columns)
    cell = lambda f: F.nullif(F.trim(F.col(f"`{names[f]}`")), F.lit("")) if f in names else F.lit(None).cast("string")
    rows = raw.select(*[cell(f).alias(f) for f in HEADERS], F.monotonically_increasing_id().alias("row_number"))
    rows = rows.where(F.coalesce("company", "title", "url").isNotNull())
    return rows.select("row_number", "company", "title", "url", "location", dates.parse_date(F.col("applied_at"), today).alias("applied_at"), parse_status(F.col("status")).alias("status"))


def unchanged(payloads: DataFrame, seen: DataFrame, key: list[str], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Payloads whose digest was not seen for their key, and the keys of the others: only new content is read again."""
    hashed = payloads.withColumn("__digest", F.sha2(F.col(payload), 256))
    known = seen.select(*key, F.col("digest").alias("__digest")).distinct()
    return hashed.join(known, [*key, "__digest"], "left_anti").drop("__digest"), hashed.join(known, [*key, "__digest"], "left_semi").select(*key)


def source_candidates(pages: DataFrame, html: str = "html") -> DataFrame:
    """type, account, n of the hiring systems that pages link to, each once."""
    links = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)href=["']?(https?://[^"'\s>]+)"""), F.lit(1))).alias("url"))
    found = links.select(urls.hiring_system(F.col("url")).alias("s")).where("s is not null")
    return found.groupBy(F.col("s.type").alias("type"), F.col("s.account").alias("account")).agg(F.count("*").alias("n"))
