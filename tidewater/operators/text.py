"""Text search with document frequencies and distinctive terms, tokenisers, n-grams, highlights, languages.

Frequencies and searches are DataFrame plans; the tokenisers whose rules need more than a pattern
run in Arrow batches.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import stored

SHORTEST, LONGEST = 2, 100
TOP_TERMS, PRIOR, LEAST_Z, LEAST_ROWS, LEAST_DF = 30, 500.0, 1.96, 3, 2
SNIPPET = 120

#: English words that carry no content, and what contractions leave behind.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are aren as at be because been before being below between both but by can cannot could
    couldn d did didn do does doesn doing don dont down during each few for from further had hadn has hasn have haven having he her here hers herself
    him himself his how i if ill im in into is isn it its itself ive just ll m me more most my myself no nor not now of off on once only or other our
    ours ourselves out over own re s same she should shouldn so some such t than that thats the their theirs them themselves then there these they
    this those through to too under until up ve very was wasn we were weren what when where which while who whom why will with won wont wouldn would
    you your yours yourself yourselves cant n""".split()
)


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """The non-empty texts of a row, joined by a space, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`").cast("string")) for c in columns]))


def words(text: Column, stop: bool = True) -> Column:
    """Lower-case words of letters, digits and inner apostrophes, 2 to 100 bytes long, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+(?:['’.:][\p{L}\p{N}_]+)*"), F.lit(0))
    kept = F.filter(found, lambda w: F.octet_length(w).between(SHORTEST, LONGEST) & w.rlike(r"[\p{L}\p{N}]"))
    return F.filter(kept, lambda w: ~w.isin(*sorted(STOP_WORDS))) if stop else kept


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """Runs of low to high neighbouring tokens, joined by spaces. tokens should be a column of its own, it is used often."""
    grams, out = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            long = F.greatest(F.lit(0), F.size(tokens) - n + 1)
            grams = F.zip_with(F.slice(grams, 1, long), F.slice(tokens, n, long), lambda a, b: F.concat_ws(" ", a, b))
        if n >= low:
            out.append(grams)
    return F.concat(*out)


_CODE = re.compile(r"[\w./\\-]+\.\w{1,5}|\w+::[\w:]+|[Ee]\d{3,5}|[Vv]\d+(?:\.\d+)*|[A-Z][A-Z0-9_]{3,}")
_PLAIN = re.compile(r"[^\W_]+(?:['’.:_][^\W_]+)*")


def camel_parts(word: str) -> list[str]:
    """The parts of a compound written in camel case; the word alone where it has one part."""
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[^A-Za-z0-9]+", word) if re.search(r"[a-z][A-Z]|[A-Z][A-Z][a-z]", word) else [word]


def code_words(text: str | None) -> list[str]:
    """Words of prose mixed with code: paths, namespaces, error codes, versions and constants stay whole, camel case is also split."""
    out, at = [], 0
    text = text or ""

    def plain(part: str) -> None:
        for m in _PLAIN.finditer(part):
            pieces = camel_parts(m[0])
            out.append(m[0].lower())
            if len(pieces) > 1:
                out.extend(p.lower() for p in pieces)

    for m in _CODE.finditer(text):
        if (m.start() and text[m.start() - 1].isalnum()) or (m.end() < len(text) and text[m.end()].isalnum()):
            continue
        plain(text[at : m.start()])
        out.append(m[0].lower())
        at = m.end()
    plain(text[at:])
    return [w for w in out if SHORTEST <= len(w.encode()) <= LONGEST]


def code_tokens(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(code_words)

    return run(text)


def index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, text, terms): lower-case text and its distinct words and pairs of neighbouring words."""
    rows = df.select(F.col(key), row_text(df, columns).alias("text")).withColumn("_words", words(F.col("text")))
    return rows.withColumn("terms", F.array_distinct(ngrams(F.col("_words"), 1, 2))).drop("_words")


def _terms(indexed: DataFrame, *also: str) -> DataFrame:
    """A row for each term of each row. The outer form keeps Catalyst from working the terms out once more to test their size."""
    return indexed.select(*also, F.explode_outer("terms").alias("term")).where("term is not null")


def doc_freq(indexed: DataFrame, least: int = LEAST_DF) -> DataFrame:
    """Rows (term, df): rows that hold a term, from `least` on."""
    return _terms(indexed).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def term_counts(indexed: DataFrame, chosen: Column, least: int = LEAST_DF) -> DataFrame:
    """Rows (term, df, y): rows that hold a term, from `least` on, and those of them that a search chose; one pass over the index."""
    marked = indexed.withColumn("_hit", F.coalesce(chosen, F.lit(False)).cast("long"))  # once a row, before terms are taken apart
    return _terms(marked, "_hit").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("_hit").alias("y")).where(F.col("df") >= least)


def within_extremes(freq: DataFrame, rows: int, min_df: float = 1, max_df: float = 1.0) -> DataFrame:
    """Terms with neither too few nor too many rows; a minimum below 1 and a maximum up to 1 are shares of all rows."""
    low = -(-min_df * rows // 1) if min_df < 1 else min_df
    high = max_df * rows // 1 if max_df <= 1 else max_df
    return freq.where((F.col("df") >= low) & (F.col("df") <= high))


def occurs(text: Column, term: str, whole: bool = False) -> Column:
    term = term.lower()
    if not whole:
        return F.contains(text, F.lit(term))
    return text.rlike(r"(?<![\p{L}\p{N}_])" + re.sub(r"([^\w\s])", r"\\\1", term) + r"(?![\p{L}\p{N}_])")


def chosen(include: list[str] = (), exclude: list[str] = (), whole: bool = False) -> Column:
    """Whether a row's text holds all of some terms and none of others."""
    tests = [occurs(F.col("text"), t, whole) for t in include] + [~occurs(F.col("text"), t, whole) for t in exclude]
    return reduce(Column.__and__, tests, F.lit(True))


def search(indexed: DataFrame, include: list[str] = (), exclude: list[str] = (), whole: bool = False) -> DataFrame:
    """Rows that hold all of some terms and none of others."""
    return indexed.where(chosen(include, exclude, whole))


def common_terms(counts: DataFrame, rows: int, top: int = TOP_TERMS) -> DataFrame:
    """A search result's most frequent terms, with the share of its rows that hold them; counts as from `term_counts`."""
    own = counts.where("y > 0").select("term", F.col("y").alias("count"), (F.col("y") / F.lit(max(1, rows))).alias("score"))
    return own.orderBy(F.desc("count"), "term").limit(top)


def log_odds(counts: DataFrame, zeroed: list[str] = ()) -> DataFrame:
    """Rows (term, count, z): weighted log-odds of a term in a search result against the other rows, with an informative prior.

    Terms of the search itself are zeroed in both before totals are formed. The counts, as from
    `term_counts`, are needed twice, so they are written first.
    """
    hidden = [t.lower() for t in zeroed]
    counts = stored(counts, "terms")
    both = counts.where(~F.col("term").isin(hidden)) if hidden else counts
    totals = both.agg(F.sum("y").alias("n"), F.sum("df").alias("all"))
    both = both.join(F.broadcast(totals), F.lit(True))  # one row
    other, rest, prior = F.col("df") - F.col("y"), F.col("all") - F.col("n"), PRIOR * F.col("df") / F.col("all")
    odds = lambda y, n: F.ln((y + prior) / (n + PRIOR - y - prior))
    z = (odds(F.col("y"), F.col("n")) - odds(other, rest)) / F.sqrt(1 / (F.col("y") + prior) + 1 / (other + prior))
    return both.select("term", F.col("y").alias("count"), F.when((F.col("y") > 0) & (F.col("n") > 0) & (rest > 0), z).otherwise(0.0).alias("z"))


def distinctive_terms(counts: DataFrame, zeroed: list[str] = (), top: int = TOP_TERMS) -> DataFrame:
    """Terms far more frequent in a search result than elsewhere: z over 1.96, three rows at least."""
    rows = log_odds(counts, zeroed).where((F.col("z") > LEAST_Z) & (F.col("count") >= LEAST_ROWS))
    return rows.orderBy(F.desc("z"), "term").limit(top)


def match_ranges(text: str, terms: list[str], whole: bool = False) -> list[tuple[int, int]]:
    """Merged ranges of a text's matches, for a page of results."""
    found = []
    for t in terms:
        pattern = re.escape(t.lower())
        pattern = rf"(?<!\w){pattern}(?!\w)" if whole else pattern
        found += [m.span() for m in re.finditer(pattern, text.lower())]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def snippet(text: str, terms: list[str], whole: bool = False, around: int = SNIPPET) -> str:
    """The first match with its surroundings, cut at spaces."""
    ranges = match_ranges(text, terms, whole)
    if not ranges:
        return text[: 2 * around].strip()
    a, b = max(0, ranges[0][0] - around), min(len(text), ranges[0][1] + around)
    a = text.find(" ", a) + 1 if a and text.find(" ", a) != -1 and text.find(" ", a) < ranges[0][0] else a
    b = text.rfind(" ", ranges[0][1], b) if b < len(text) and text.rfind(" ", ranges[0][1], b) > 0 else b
    return ("…" if a else "") + text[a:b].strip() + ("…" if b < len(text) else "")


#: Frequent short words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with be this by have from not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "sv": "och att det i en jag hon som han på den med var sig för så till är men ett".split(),
    "fi": "ja on ei se että hän oli ovat mutta kun niin joka mitä tai jos vain sen myös".split(),
}


def language(text: Column, least: int = 20, margin: float = 1.5) -> Column:
    """ISO 639-1 code by shares of function words; null for under 20 characters or where two languages are close."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    hits = lambda ws: F.size(F.filter(tokens, lambda t: t.isin(ws)))
    ranked = F.sort_array(F.array(*[F.struct(hits(ws).alias("n"), F.lit(code).alias("code")) for code, ws in FUNCTION_WORDS.items()]), asc=False)
    first, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    sure = (first["n"] >= 2) & (first["n"] >= margin * second["n"])
    return F.when((F.length(text) >= least) & sure, first["code"])
