"""Names of a vocabulary in texts, by a dictionary of their first words.

Every word of a text is looked up once, together with what follows it, in a
table of aliases that is keyed by their first words; what meets is compared
letter by letter.  The cost of a text is that of its words, however many
aliases there are.

An alias is plain text.  In it, `x?` is a letter that may be left out, `[- ]`
is either of two, and a last `*` or `+` is any, or some, further letters of
the word.  Case doesn't count; an alias starts where a word starts, and ends
where a word ends if its last character is of a word.

Defined cases: null and empty texts have no names; texts of one key are taken
together, null being a key too; an empty vocabulary finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.positions import folded

#: Largest vocabulary that is broadcast, in aliases (some 200 bytes each).
MOST_ALIASES = 500_000
#: Code points of a first word that stand for it where the word may go on.
STEM = 4

#: Skills, with the ways in which each is written.
SKILLS: dict[str, tuple[str, ...]] = {
    "python": ("python",), "java": ("java",), "javascript": ("javascript", "es6"), "typescript": ("typescript",), "go": ("golang", "go lang"), "rust": ("rust",), "c++": ("c++", "cpp"), "c#": ("c#", "csharp", "c sharp"),
    "scala": ("scala",), "kotlin": ("kotlin",), "swift": ("swift",), "ruby": ("ruby",), "php": ("php",), "matlab": ("matlab",), "sql": ("sql",), "bash": ("bash", "shell scripting", "shell script"), "r": ("r language",),
    "fastapi": ("fastapi",), "flask": ("flask",), "django": ("django",), "spring": ("spring boot", "spring framework"), "node.js": ("node.js", "nodejs", "node js"), "express": ("express.js", "expressjs"),
    "react": ("react", "react.js", "reactjs"), "next.js": ("next.js", "nextjs"), "vue": ("vue", "vue.js"), "angular": ("angular",), "graphql": ("graphql",), "grpc": ("grpc",), "rest api": ("rest api", "restful", "rest apis"),
    "websockets": ("websocket", "websockets"), "microservices": ("microservices",), "postgresql": ("postgresql", "postgres"), "mysql": ("mysql",), "mongodb": ("mongodb", "mongo"), "redis": ("redis",),
    "elasticsearch": ("elasticsearch", "opensearch"), "cassandra": ("cassandra",), "dynamodb": ("dynamodb",), "snowflake": ("snowflake",), "firebase": ("firebase",), "spark": ("spark", "pyspark"), "kafka": ("kafka",),
    "airflow": ("airflow", "apache airflow"), "hadoop": ("hadoop",), "dbt": ("dbt",), "etl": ("etl", "elt", "data pipeline", "data pipelines", "batch processing"), "celery": ("celery",), "delta lake": ("delta lake",),
    "aws": ("aws", "amazon web services"), "azure": ("azure",), "gcp": ("gcp", "google cloud"), "docker": ("docker", "containerization"), "kubernetes": ("kubernetes", "k8s"), "terraform": ("terraform",),
    "ci/cd": ("ci/cd", "cicd", "continuous integration", "github actions", "jenkins"), "linux": ("linux", "unix"), "git": ("git", "github", "gitlab"), "serverless": ("serverless", "lambda"), "pytorch": ("pytorch",),
    "tensorflow": ("tensorflow",), "scikit-learn": ("scikit-learn", "sklearn"), "pandas": ("pandas",), "numpy": ("numpy",), "transformers": ("transformers", "hugging ?face"), "llm": ("llm", "large language model"),
    "rag": ("rag", "retrieval augmented generation"), "embeddings": ("embedding", "embeddings"), "nlp": ("nlp", "natural language processing"), "computer vision": ("computer vision", "opencv"),
    "speech recognition": ("speech recognition", "whisper", "asr"), "vector database": ("vector database", "qdrant", "pinecone", "weaviate", "faiss"), "mlops": ("mlops",), "model training": ("model training", "fine-tuning", "fine tuning"),
    "distributed systems": ("distributed systems", "sharding", "replication", "consensus protocol", "raft"), "system design": ("system design",), "concurrency": ("concurrency", "multithreading", "async"),
    "testing": ("unit test", "pytest", "integration test"), "agile": ("agile", "scrum"), "observability": ("observability", "prometheus", "grafana", "datadog", "monitoring", "logging", "distributed tracing", "alerting", "on-?call"),
    "authentication": ("oauth", "jwt", "rbac", "authentication", "authorization", "authn", "authz", "single sign-?on", "saml"), "scalability": ("scalability", "scalable", "large[- ]scale", "at scale", "high[- ]throughput", "horizontal scal+", "horizontally scal+"),
    "high availability": ("high[- ]availability", "highly available", "fault[- ]toleran+", "resilien+", "disaster recovery"), "low latency": ("low[- ]latency", "real[- ]time", "realtime", "latency[- ]sensitive"),
    "caching": ("caching", "cache", "memcached", "cdn"), "event-driven": ("event[- ]driven", "pub/?sub", "publish[- ]subscribe", "message queue", "message broker", "rabbitmq", "sqs"), "stream processing": ("stream processing", "streaming data", "data streaming"),
    "flink": ("flink",), "databricks": ("databricks",), "bigquery": ("bigquery", "redshift"), "data modeling": ("data model", "data models", "data modell?ing", "schema design"), "api design": ("api design", "api development", "designing apis"),
    "infrastructure as code": ("infrastructure as code", "iac", "helm charts?", "cloudformation", "pulumi", "ansible"), "experimentation": ("a/b test*", "ab testing", "experimentation"),
    "recommendation systems": ("recommendation system", "recommendation engine", "recommender"), "information retrieval": ("information retrieval", "search relevance", "search ranking", "ranking system"),
}

#: Pairs of skills that speak for one another.
RELATED: tuple[tuple[str, str], ...] = (
    ("distributed systems", "scalability"), ("distributed systems", "high availability"), ("distributed systems", "microservices"), ("distributed systems", "system design"), ("distributed systems", "concurrency"),
    ("scalability", "high availability"), ("scalability", "low latency"), ("scalability", "caching"), ("high availability", "observability"), ("low latency", "caching"), ("caching", "redis"), ("system design", "microservices"),
    ("system design", "api design"), ("microservices", "event-driven"), ("microservices", "api design"), ("event-driven", "kafka"), ("stream processing", "kafka"), ("stream processing", "flink"), ("stream processing", "spark"),
    ("stream processing", "low latency"), ("etl", "airflow"), ("etl", "spark"), ("etl", "data modeling"), ("data modeling", "sql"), ("data modeling", "postgresql"), ("spark", "databricks"), ("databricks", "delta lake"),
    ("snowflake", "bigquery"), ("bigquery", "sql"), ("postgresql", "mysql"), ("postgresql", "sql"), ("mysql", "sql"), ("mongodb", "dynamodb"), ("cassandra", "dynamodb"), ("kubernetes", "docker"), ("infrastructure as code", "terraform"),
    ("infrastructure as code", "kubernetes"), ("ci/cd", "docker"), ("ci/cd", "testing"), ("ci/cd", "git"), ("aws", "serverless"), ("linux", "bash"), ("go", "concurrency"), ("rest api", "api design"), ("rest api", "graphql"),
    ("api design", "graphql"), ("react", "javascript"), ("react", "next.js"), ("vue", "javascript"), ("angular", "typescript"), ("typescript", "javascript"), ("node.js", "javascript"), ("node.js", "express"), ("fastapi", "python"),
    ("flask", "python"), ("django", "python"), ("spring", "java"), ("java", "kotlin"), ("java", "scala"), ("c++", "rust"), ("llm", "rag"), ("llm", "transformers"), ("llm", "nlp"), ("rag", "vector database"), ("rag", "embeddings"),
    ("embeddings", "vector database"), ("nlp", "transformers"), ("pytorch", "tensorflow"), ("pytorch", "model training"), ("tensorflow", "model training"), ("model training", "mlops"), ("mlops", "ci/cd"), ("scikit-learn", "pandas"),
    ("pandas", "numpy"), ("pandas", "python"), ("recommendation systems", "information retrieval"), ("recommendation systems", "embeddings"), ("recommendation systems", "experimentation"), ("information retrieval", "elasticsearch"),
)


def spellings(alias: str) -> list[tuple[str, str]]:
    """(text, what may follow) of each way to write an alias: "" for its end, "*" for any letters, "+" for some."""
    more = alias[-1] if alias[-1] in "*+" and len(alias) > 2 and alias[-2].isalnum() else ""
    parts = re.findall(r"\[(.)(.)\]|(.)(\?)?", alias[: len(alias) - len(more)])
    choices = [(a, b) if a else (c, "") if maybe else (c,) for a, b, c, maybe in parts]
    return [("".join(x), more) for x in product(*choices)]


def dictionary(spark: SparkSession, words: Mapping[str, Iterable[str]]) -> DataFrame:
    """name, first (the key), alias, more: one row for each way to write a name."""
    rows = set()
    for name, aliases in words.items():
        for text, more in (s for a in aliases for s in spellings(a.lower())):
            first = re.match(r"\w+", text)[0]
            open_ = more and first == text
            if open_ and len(text) < STEM:
                raise ValueError(f"the open alias {text!r} needs {STEM} letters")
            rows.add((name, f"{text[:STEM]}~" if open_ else first, text, more))
    return spark.createDataFrame(sorted(rows), "name string, first string, alias string, more string")


def word_tails(text: Column, most: int) -> Column:
    """What starts at each word of a text, up to `most` code points, in folded letters and without repeats."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(rf"(?sU)(?<!\w)(?=(\w.{{0,{most - 1}}}))"), F.lit(1)))


def names_by_key(rows: DataFrame, key: str, text: str, told: DataFrame) -> DataFrame:
    """key, names: for each key the sorted names of the dictionary `told` that its texts hold, an empty array if they hold none.

    Keys and names are all that is shuffled, one row for each key, name and
    task at most.
    """
    longest = told.agg(F.max(F.length("alias"))).first()[0] or 1
    told = F.broadcast(told) if told.count() <= MOST_ALIASES else told
    own = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    tails = own.select("key", F.explode(word_tails(F.col("text"), longest + 1)).alias("tail"))
    word = F.regexp_extract("tail", r"(?U)\A\w+", 0)
    keyed = tails.select("key", "tail", F.explode(F.array(word, F.concat(F.substring(word, 1, STEM), F.lit("~")))).alias("first"))
    met = keyed.join(told, "first").where(F.startswith("tail", F.col("alias")))
    after = F.substring(F.col("tail"), F.length("alias") + 1, F.lit(1))
    is_word = after.rlike(r"(?U)\A\w")
    ends = F.when(F.col("more") == "+", is_word).when((F.col("more") == "") & F.col("alias").rlike(r"\w\z"), ~is_word).otherwise(True)
    found = met.where(ends).select("key", "name").distinct()
    every = found.union(own.select("key", F.lit(None).cast("string").alias("name")))
    return every.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("names"))
