"""Text search: exact substring relevance, and tokens of a light stemmer, which ``textindex`` stores.

Token search is like a full-text search; its scores are not those of any database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning for a search (fixed values).
STOP_WORDS = "a as com da das de do dos e em na nas no nos o os ou para por que se um uma the of and in to is".split()
#: Endings that are cut from words of five letters and more, after an s at the end (fixed values).
ENDINGS = "mente acoe coe acao cao ando endo indo ado ada ido ida ar er ir".split()
ACCENTS = ("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")


def relevance(text: Column, query: str) -> Column:
    """3 for the whole text, 2 with blanks around, 1 for any other place, null if it does not occur. Case does not matter."""
    t, q = F.upper(text), query.upper()
    return F.when(t == q, 3).when(F.contains(t, F.lit(f" {q} ")), 2).when(F.contains(t, F.lit(q)), 1)


def substring_search(rows: DataFrame, text: str, query: str, when: str, key: str, limit: int = 50) -> DataFrame:
    """The best ``limit`` rows by relevance, then the newest, then the largest key. A blank query finds nothing."""
    if not query.strip():
        return rows.withColumn("relevance", F.lit(None).cast("int")).limit(0)
    found = rows.withColumn("relevance", relevance(F.col(text), query)).filter("relevance IS NOT NULL")
    return found.orderBy(F.desc("relevance"), F.desc(when), F.desc(key)).limit(limit)


def tokens(text: Column) -> Column:
    """Words in lower case without accents, stop words and common endings."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *ACCENTS)
    words = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.transform(words, lambda w: F.when(F.length(w) >= 5, F.regexp_replace(F.regexp_replace(w, "s$", ""), f"({'|'.join(ENDINGS)})$", "")).otherwise(w))


def any_term(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Rows with any of the terms between commas, and how many of them."""
    terms = [t.strip() for t in query.split(",") if t.strip()]
    if not terms:
        return rows.withColumn("hits", F.lit(0)).limit(0)
    hits = sum((F.coalesce((relevance(F.col(text), t) > 0).cast("int"), F.lit(0)) for t in terms), F.lit(0))
    return rows.withColumn("hits", hits).filter("hits > 0")
