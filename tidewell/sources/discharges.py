"""Discharge pages: words with their places become one row for each patient.

Pages are turned, so a patient is a band of words of about one x, read from the bottom up: record, prefixes, name, a doctor's number, the
doctor's name, the date. Bed and specialty stand in a second column, one unit to the right. A page is one row, so no word is shuffled by
itself; tasks cut the bands of many pages at a time out of Arrow arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What words look like.
RECORD, PREFIX, DOCTOR, DATE = r"^\d{2,7}/\d$", r"^[A-Z]{1,2}$", r"^(\d{4,6}|[Cc][Rr][Mm]([A-Za-z]{2})?)$", r"^\d{2}/\d{2}/(\d{2}|\d{4})$"
#: The least and most bytes of words that look like it, as most words have others.
_BYTES = {RECORD: (4, 9), PREFIX: (1, 2), DOCTOR: (3, 6), DATE: (8, 10)}
#: Bands begin where x is so far from the band's first; a word belongs to a column less than REACH away.
TOLERANCE, REACH, SECOND = 1.5, 1.0, 1.0
#: Pages are taken together up to so many words; a batch has so many bytes, if the session was given no limit.
WORDS, BATCH_BYTES = 1 << 18, 8 << 20


def _like(text: pa.Array, pattern: str) -> np.ndarray:
    """Whether the whole word looks like the pattern, for each word."""
    size = np.asarray(pc.binary_length(text))
    some = np.flatnonzero((size >= _BYTES[pattern][0]) & (size <= _BYTES[pattern][1]))
    out = np.zeros(len(text), bool)
    out[some] = np.asarray(pc.match_substring_regex(text.take(pa.array(some)), pattern))
    return out


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before; the first does. NaN is like NaN."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([(k[1:] != k[:-1]) & ((k[1:] == k[1:]) | (k[:-1] == k[:-1])) for k in keys], axis=0)
    return out


def _begins(page: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """page and x of the bands: a page's first place begins one, and each more than TOLERANCE past the last begin."""
    order = np.lexsort((x, page))
    page, x = page[order], x[order]
    once = _changes(page, x)
    page, x = page[once], x[once]
    begins = _changes(page)
    begins[1:] |= x[1:] - x[:-1] > TOLERANCE
    first = np.flatnonzero(begins)[np.cumsum(begins) - 1]  # of the run of places that are near their neighbours
    last = run = -1
    for k in np.flatnonzero(x - x[first] > TOLERANCE):  # where a run goes on past its first band
        last, run = (first[k] if run != first[k] else last), first[k]
        if x[k] - x[last] > TOLERANCE:
            begins[k], last = True, k
    return page[begins], x[begins]


def _within(page: np.ndarray, x: np.ndarray, band_page: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bands and words that may be in their columns: words are sorted by x with two marks for each band, and what lies between them is taken."""
    n, bands = len(x), len(begin)
    at = np.concatenate((x, begin - REACH - 0.1, begin + SECOND + REACH + 0.1))
    order = np.lexsort((at, np.concatenate((page, band_page, band_page))))
    word = order < n
    before = np.empty(len(at), np.int64)
    before[order] = np.cumsum(word)
    first, after = before[n : n + bands], before[n + bands :]
    held = after - first
    band = np.repeat(np.arange(bands), held)
    return band, order[word][np.repeat(first - np.cumsum(held) + held, held) + np.arange(len(band))]


def _upwards(band: np.ndarray, column: np.ndarray, down: np.ndarray, text: pa.Array) -> np.ndarray:
    """The order of words by band, column, place from the bottom up and, where places are equal, text."""
    order = np.lexsort((down, column, band))
    if _changes(band[order], column[order], down[order]).all():
        return order
    coded = text.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(rank))
    return np.lexsort((rank[np.asarray(coded.indices)], down, column, band))


def _some(text: pa.Array, at: np.ndarray, there: np.ndarray) -> pa.Array:
    return text.take(pa.array(at, mask=~there))


def _patients(pages: pa.RecordBatch) -> pa.RecordBatch:
    """page, band, record, name, day, beside, last: of each band with a record or a name.

    ``beside`` and ``last`` are the first and, if there are several, the last word of the second column, where each counts once.
    """
    text, x, y = (pages.column(c).flatten() for c in ("text", "x", "y"))
    page = np.repeat(np.arange(len(pages)), np.asarray(pc.list_value_length(pages.column("text")).fill_null(0)))
    x, down = x.fill_null(np.nan).to_numpy(zero_copy_only=False), -y.fill_null(-np.inf).to_numpy(zero_copy_only=False)
    there = np.asarray(text.is_valid()) & ~np.isnan(x)
    text, x, down, page = text.filter(pa.array(there)), x[there], down[there], page[there]
    record = _like(text, RECORD)
    band_page, begin = _begins(page[record], x[record])

    band, word = _within(page, x, band_page, begin)
    away = x[word] - begin[band]
    column = np.where(np.abs(away) < REACH, 0, np.where(np.abs(away - SECOND) < REACH, 1, 2))
    band, word, column = band[column < 2], word[column < 2], column[column < 2]
    order = _upwards(band, column, down[word], text.take(pa.array(word)))
    band, word, column = band[order], word[order], column[order]

    bands, main = band[column == 0], word[column == 0]
    starts = np.flatnonzero(_changes(bands))
    ends, place, none = np.append(starts[1:], len(main)), np.arange(len(main)), len(main)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    first = lambda is_it: np.minimum.reduceat(np.where(is_it, place, none), starts) if none else starts
    has = record[main[starts]]
    named = np.minimum(first(~_like(text, PREFIX)[main] & (place >= (starts + has)[group])), ends)
    doctor = first(_like(text, DOCTOR)[main] & (place >= named[group]))
    date = _like(text, DATE)
    day = first(date[main] & (place > doctor[group]))
    length = np.minimum(doctor, ends) - named
    offsets = np.append(0, np.cumsum(length))
    words = main[np.repeat(named - offsets[:-1], length) + np.arange(offsets[-1])]
    name = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.take(pa.array(words))), " ")

    other, beside = band[(column == 1) & ~date[word]], word[(column == 1) & ~date[word]]
    code = np.asarray(text.take(pa.array(beside)).dictionary_encode().indices).astype(np.int64)
    once = np.sort(np.unique(other * (len(code) + 1) + code, return_index=True)[1])
    other, beside = other[once], beside[once]
    low, high = np.searchsorted(other, bands[starts]), np.searchsorted(other, bands[starts], "right")
    beside = np.append(beside, 0)

    number = np.arange(len(begin)) - np.searchsorted(band_page, band_page)
    found = pa.array(has | (length > 0))
    pick = lambda at, there: _some(text, np.where(there, at, 0), there)
    columns = {
        "page": pages.column("page").take(pa.array(band_page[bands[starts]])), "band": pa.array(number[bands[starts]], pa.int32()), "record": pick(main[starts], has), "name": name,
        "day": pick(np.append(main, 0)[day], day < none), "beside": pick(beside[low], high > low), "last": pick(beside[high - 1], high > low + 1),
    }
    return pa.RecordBatch.from_pydict({k: v.filter(found) for k, v in columns.items()})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(invalid="ignore"):  # places may be infinite
        for batch in batches:
            held = np.cumsum(np.asarray(pc.list_value_length(batch.column("text")).fill_null(0)))
            at = 0
            while at < len(batch):
                until = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + WORDS, "right")))
                yield _patients(batch.slice(at, until - at))
                at = until


def patients_of_pages(pages: DataFrame) -> DataFrame:
    """page, band, prontuario, nome, leito, especialidade, data_internacao: a row for each band of a page that has a record.

    ``pages`` has a row for each page, with its words as three arrays of one length: x double, y double, text string. Bands are found by words
    that look like records. Records keep their digits, dates are DD/MM/YYYY, fields that aren't there are empty. Pages without a record have
    no row; words that are null or have no x are left out.
    """
    limit, spark = "spark.sql.execution.arrow.maxBytesPerBatch", pages.sparkSession
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))
    placed = pages.filter("page IS NOT NULL").select("page", F.transform("x", lambda x: F.round(x, 1)).alias("x"), "y", "text")
    kind = pages.schema["page"].dataType.simpleString()
    held = placed.mapInArrow(_cut, f"page {kind}, band int, record string, name string, day string, beside string, last string")
    one, several = F.col("beside"), F.col("last").isNotNull()
    special = F.length(one).between(2, 4) & one.rlike(r"^\p{L}+\z") & (F.upper(one) == one) & (F.lower(one) != one)
    bed, specialty = F.when(several | ~special, one), F.when(several, F.col("last")).when(special, one)
    day = F.when(F.length("day") == 8, F.concat(F.substring("day", 1, 6), F.lit("20"), F.substring("day", 7, 2))).otherwise(F.col("day"))
    text = lambda field: F.coalesce(field, F.lit(""))
    return held.select(
        "page", "band", text(F.regexp_replace("record", r"\D", "")).alias("prontuario"), F.trim("name").alias("nome"),
        text(bed).alias("leito"), text(specialty).alias("especialidade"), text(day).alias("data_internacao"),
    )


def discharged_patients(words: DataFrame) -> DataFrame:
    """``patients_of_pages`` for words (page, x, y, text) that are rows of their own: they are brought together by page."""
    word = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("text").cast("string").alias("text"))
    pages = words.filter("text IS NOT NULL").groupBy("page").agg(F.collect_list(word).alias("w"))
    return patients_of_pages(pages.select("page", "w.x", "w.y", "w.text"))
