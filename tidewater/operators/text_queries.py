"""Registered text and enrichment queries with their SQL, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import web
from tidewater.operators import enrichment as E
from tidewater.operators import text as X
from tidewater.session import importable

Q: dict = {}
S: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))
_WORDS = rf"""d AS (SELECT doc_id, lower(text) AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+(?:[''’.:][\p{{L}}\p{{N}}_]+)*'),
      lambda x: strlen(x) BETWEEN 2 AND 100 AND regexp_matches(x, '[\p{{L}}\p{{N}}]') AND x NOT IN ({_STOP})) AS words FROM d),
i AS (SELECT doc_id, t, list_distinct(words || list_transform(list_zip(words[:-2], words[2:]), lambda p: p[1] || ' ' || p[2])) AS terms FROM w),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM i) GROUP BY 1 HAVING count(*) >= 2)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return X.index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", ["text"])


Q["text_doc_freq"] = lambda spark, sf_dir: X.doc_freq(_index(spark, sf_dir))
S["text_doc_freq"] = f"WITH {_WORDS} SELECT term, df FROM f"
Q["text_ngrams"] = lambda spark, sf_dir: _index(spark, sf_dir).select("doc_id", F.size("terms").alias("n_terms"))
S["text_ngrams"] = f"WITH {_WORDS} SELECT doc_id, CAST(len(terms) AS INTEGER) AS n_terms FROM i"
Q["text_search"] = lambda spark, sf_dir: X.search(_index(spark, sf_dir), ["license", "version"], ["apache"]).select("doc_id")
S["text_search"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version') AND NOT contains(lower(text), 'apache')"
Q["text_search_whole"] = lambda spark, sf_dir: X.search(_index(spark, sf_dir), ["mit"], whole=True).select("doc_id")
S["text_search_whole"] = r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])mit($|[^\p{L}\p{N}_])')"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.term_counts(_index(spark, sf_dir), X.chosen(["license"]))


def _common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.common_terms(_counts(spark, sf_dir), X.search(_index(spark, sf_dir), ["license"]).count())


_SUB = "s AS (SELECT * FROM i WHERE contains(t, 'license')), o AS (SELECT term, count(*) AS y FROM (SELECT unnest(terms) AS term FROM s) GROUP BY 1)"
Q["text_common_terms"] = _common
S["text_common_terms"] = f"WITH {_WORDS}, {_SUB} SELECT term, y AS count, y / (SELECT count(*) FROM s) AS score FROM o JOIN f USING (term) ORDER BY y DESC, term LIMIT 30"
Q["text_log_odds"] = lambda spark, sf_dir: X.log_odds(_counts(spark, sf_dir), ["license"]).withColumn("z", F.round("z", 6)).where("count > 0")
S["text_log_odds"] = f"""WITH {_WORDS}, {_SUB},
b AS (SELECT term, df, coalesce(y, 0) AS y FROM f LEFT JOIN o USING (term) WHERE term <> 'license'),
n AS (SELECT *, sum(y) OVER () AS n, sum(df) OVER () AS a, 500.0::DOUBLE * df / sum(df) OVER () AS p FROM b)
SELECT term, y AS count, round((ln((y + p) / (n + 500 - y - p)) - ln((df - y + p) / (a - n + 500 - (df - y) - p))) / sqrt(1 / (y + p) + 1 / (df - y + p)), 6) AS z FROM n WHERE y > 0"""
Q["text_distinctive_terms"] = lambda spark, sf_dir: X.distinctive_terms(_counts(spark, sf_dir), ["license"]).select("term", "count")
S["text_distinctive_terms"] = S["text_log_odds"].replace("SELECT term, y AS count, round(", "SELECT term, count FROM (SELECT term, y AS count, (").replace(", 6) AS z FROM n WHERE y > 0", ") AS z FROM n WHERE y >= 3) WHERE z > 1.96 ORDER BY z DESC, term LIMIT 30")
Q["text_extremes"] = lambda spark, sf_dir: X.within_extremes(X.doc_freq(_index(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/documents.parquet").count(), 0.05, 0.5).select("term", "df")
S["text_extremes"] = f"WITH {_WORDS} SELECT term, df FROM f WHERE df >= ceil(0.05 * (SELECT count(*) FROM documents)) AND df <= floor(0.5 * (SELECT count(*) FROM documents))"
Q["text_language"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.language(F.col("text")).alias("language"))
_HITS = " UNION ALL ".join(f"SELECT doc_id, n, '{c}' AS code, len(list_filter(words, lambda x: x IN ({', '.join(repr(w) for w in ws)}))) AS hits FROM t" for c, ws in X.FUNCTION_WORDS.items())
S["text_language"] = rf"""WITH t AS (SELECT doc_id, length(text) AS n, regexp_extract_all(lower(text), '\p{{L}}+') AS words FROM documents), h AS ({_HITS}),
r AS (SELECT *, row_number() OVER w AS place, lead(hits) OVER w AS second FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY hits DESC, code DESC))
SELECT doc_id, CASE WHEN n >= 20 AND hits >= 2 AND hits >= 1.5 * second THEN code END AS language FROM r WHERE place = 1"""


def _code(spark, sf_dir):
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.size(X.code_tokens(F.col("text"))).alias("tokens"))


Q["text_code_tokens"] = _code


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tickets, with mentions made from their rows."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    mention = F.struct(
        F.when(F.col("turn") % 2 == 0, "feature").otherwise("competitor").alias("type"), F.lit(None).cast("string").alias("subject_id"),
        F.when(F.col("turn") % 3 == 0, F.col("role")).alias("subject"), F.concat(F.col("role"), F.lit("!")).alias("surface"),
        F.when(F.length("text") % 3 == 0, "negative").when(F.length("text") % 3 == 1, "positive").otherwise("neutral").alias("sentiment"),
        (F.length("text") % 2 == 0).alias("incidental"), (F.col("turn") % 3 == 0).alias("resolved"),
    )
    return t.groupBy(F.col("conv_id").alias("ticket")).agg(F.sort_array(F.collect_list(F.struct("turn", mention.alias("m")))).alias("x")).select("ticket", F.col("x.m").alias("mentions"))


_M = """m AS (SELECT conv_id AS ticket_id, CASE WHEN turn % 2 = 0 THEN 'feature' ELSE 'competitor' END AS type, CASE WHEN turn % 3 = 0 THEN role END AS subject, role || '!' AS surface,
  CASE length(text) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END AS sentiment, length(text) % 2 = 0 AS incidental, turn % 3 = 0 AS resolved FROM conversations)"""
Q["mention_summary"] = lambda spark, sf_dir: E.mention_summary(E.mentions(_tickets(spark, sf_dir), "ticket"))
S["mention_summary"] = f"""WITH {_M} SELECT type, coalesce(subject, surface) AS subject, resolved, count(*) AS mentions, count(DISTINCT ticket_id) AS tickets,
avg((sentiment = 'negative')::INT) AS negative_share, avg((sentiment = 'positive')::INT) AS positive_share, avg(incidental::INT) AS incidental_share FROM m GROUP BY 1, 2, 3"""
Q["unresolved_surfaces"] = lambda spark, sf_dir: E.unresolved_surfaces(E.mentions(_tickets(spark, sf_dir), "ticket"))
S["unresolved_surfaces"] = f"WITH {_M} SELECT type, surface, count(*) AS count FROM m WHERE NOT resolved GROUP BY 1, 2"
Q["ticket_flags"] = lambda spark, sf_dir: _tickets(spark, sf_dir).withColumns(E.flags()).drop("mentions")
S["ticket_flags"] = f"""WITH {_M} SELECT ticket_id AS ticket, bool_or(type = 'feedback') AS has_feedback, bool_or(incidental) AS has_incidental, bool_or(type = 'competitor') AS has_competitor,
CAST(count(*) AS INTEGER) AS mention_count FROM m GROUP BY 1"""
Q["ticket_summary"] = lambda spark, sf_dir: E.ticket_summary(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang", "source"])
S["ticket_summary"] = """SELECT 'lang' AS "column", lang AS value, count(*) AS count FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2"""
Q["vocabulary_health"] = lambda spark, sf_dir: E.vocabulary_health(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", spark.createDataFrame([("en",), ("de",), ("sv",), ("other",)], "name string"))
S["vocabulary_health"] = """WITH c AS (SELECT lang AS name, count(*) AS count FROM documents GROUP BY 1),
h AS (SELECT name, coalesce(count, 0) AS count, coalesce(count, 0) / (SELECT count(lang) FROM documents) AS share FROM (VALUES ('en'), ('de'), ('sv'), ('other')) e(name) LEFT JOIN c USING (name))
SELECT name, count, share, CASE WHEN count = 0 THEN 'unused' WHEN count < 5 THEN 'few' WHEN share < 0.02 THEN 'small' WHEN share > 0.4 THEN 'large' ELSE 'fine' END AS verdict, name = 'other' AS is_other FROM h"""


def _classified(text: dict) -> dict:
    body = text["text"]
    return {"category": "long" if len(body) > 1000 else "short", "tokens": len(body.split(" "))}


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    cells = E.computed_cells(docs, ["text"], None, _classified, "category string, tokens long")
    return E.materialised(docs, ["text"], cells).select("doc_id", "lang", "category", "tokens")


Q["enrichment_cells"] = _enriched
S["enrichment_cells"] = "SELECT doc_id, lang, CASE WHEN length(text) > 1000 THEN 'long' ELSE 'short' END AS category, CAST(len(string_split(text, ' ')) AS BIGINT) AS tokens FROM documents"


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of which those of English texts are cached already, marked so that they can be told apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    known = E.with_hash(docs.where("lang = 'en'"), ["text"]).select("input_hash", F.lit("cached").alias("category"), F.lit(-1).cast("long").alias("tokens")).distinct()
    cells = E.computed_cells(docs, ["text"], known, _classified, "category string, tokens long")
    return E.materialised(docs, ["text"], cells).select("doc_id", "category", "tokens")


Q["enrichment_cached_cells"] = _cached
S["enrichment_cached_cells"] = """WITH k AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents WHERE lang = 'en'), d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, CASE WHEN k.body IS NOT NULL THEN 'cached' WHEN length(d.body) > 1000 THEN 'long' ELSE 'short' END AS category,
       CASE WHEN k.body IS NOT NULL THEN -1 ELSE CAST(len(string_split(d.body, ' ')) AS BIGINT) END AS tokens FROM d LEFT JOIN k ON d.body = k.body"""
Q["input_hashes"] = lambda spark, sf_dir: E.with_hash(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["text", "lang"]).select("doc_id", "input_hash")
S["input_hashes"] = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l FROM documents)
SELECT doc_id, sha256('4:lang' || strlen(l) || ':' || l || '4:text' || strlen(t) || ':' || t) AS input_hash FROM d"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and turns as the pairs that were expected and found; the found ones repeat themselves and miss the long texts."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pair, odd = F.concat_ws(":", "role", "turn"), F.concat_ws(":", "role", F.col("turn") + 100)
    found = F.array_union(F.collect_list(F.when(F.length("text") < 200, pair)), F.collect_list(F.when(F.length("text") % 5 == 0, odd)))
    rows = c.groupBy("conv_id").agg(F.collect_list(pair).alias("expected"), F.concat(found, found).alias("found"))
    return E.evaluated(rows, "expected", "found")


Q["enrichment_eval"] = _evaluated
S["enrichment_eval"] = """WITH e AS (SELECT DISTINCT conv_id, role || ':' || turn AS p FROM conversations),
f AS (SELECT conv_id, role || ':' || turn AS p FROM conversations WHERE length(text) < 200 UNION SELECT conv_id, role || ':' || (turn + 100) FROM conversations WHERE length(text) % 5 = 0),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM f)) AS hits, (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM e) AS e)
SELECT hits, coalesce(hits / nullif(f, 0), 1.0) AS precision, coalesce(hits / nullif(e, 0), 1.0) AS recall FROM n"""


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages written in several ways, with a link made from each row and its segment's name."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = F.element_at(F.array(F.col("lang"), F.concat(F.upper("lang"), F.lit("-XX")), F.concat(F.lit(" "), "lang", F.lit("_Latn_XX "))), (F.col("doc_id") % 3 + 1).cast("int"))
    link = web.filled("https://x.example/{source}/{doc_id}?of={nothing}", {"source": F.col("source"), "doc_id": F.col("doc_id")})
    segment = web.blank(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")))
    return d.select("doc_id", web.language_tag(written).alias("tag"), link.alias("link"), segment.alias("segment"))


Q["tags_links_segments"] = _tags
S["tags_links_segments"] = """SELECT doc_id, lower(lang) AS tag, 'https://x.example/' || coalesce(source, '') || '/' || doc_id || '?of={nothing}' AS link,
CASE WHEN doc_id % 4 = 0 THEN '(blank)' ELSE source END AS segment FROM documents"""


def _visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ip = F.concat(F.lit("10.0.0."), F.col("user_id") % 200)
    return e.select("event_id", web.visitor_id(F.date_format("ts", "yyyy-MM-dd"), F.lit("site"), ip, F.col("event_type")).alias("visitor_id"))


Q["visitor_ids"] = _visitors
S["visitor_ids"] = "SELECT event_id, substr(sha256(concat_ws('|', strftime(ts, '%Y-%m-%d'), 'site', '10.0.0.' || (user_id % 200), event_type)), 1, 16) AS visitor_id FROM events"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = E.with_hash(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language")), ["text"])
    return E.usage_by_language(docs, docs.select("input_hash", F.length("text").cast("long").alias("tokens")).dropDuplicates(["input_hash"]))


Q["enrichment_usage"] = _usage
S["enrichment_usage"] = """WITH d AS (SELECT doc_id, lang, length(text) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS first FROM documents)
SELECT lang AS language, count(*) AS rows, count(*) FILTER (first) AS cells, CAST(coalesce(sum(n) FILTER (first), 0) AS BIGINT) AS tokens FROM d GROUP BY 1"""


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    os = F.element_at(F.array(*map(F.lit, ["Android", "iOS", "Windows", "Mac OS X"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    width = F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") * 37) % 1500)
    return c.select("c_custkey", web.device(os, width).alias("device"), web.screen(width).alias("screen"))


Q["device_classes"] = _devices
S["device_classes"] = """WITH x AS (SELECT c_custkey, ['Android', 'iOS', 'Windows', 'Mac OS X'][c_custkey % 4 + 1] AS os, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 37) % 1500 END AS w FROM customer)
SELECT c_custkey, CASE WHEN w <= 575 THEN 'Mobile' WHEN os IN ('Android', 'iOS') AND w IS NULL THEN 'Mobile' WHEN os IN ('Android', 'iOS') THEN 'Tablet' ELSE 'Desktop' END AS device,
CASE WHEN w IS NULL THEN '' WHEN w <= 575 THEN 'Small' WHEN w <= 991 THEN 'Medium' ELSE 'Large' END AS screen FROM x"""
