"""A stored inverted index: postings by ranges of tokens, which new files are added to and which a search reads a few ranges of.

Below the index's folder, ``postings/segment=<id>/range=<n>`` has a row (token, key, n, length) for each token of each row, sorted by token,
and ``manifest`` names the files that a segment was made of. A segment counts once the manifest has it, so an addition that failed half-way leaves
nothing that is read. A range is given by the token alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.search import tokens

#: Ranges of tokens, and parts that a range's rows are dealt to while they are written, so that a frequent token is several tasks'.
RANGES, WRITERS = 64, 8


_ENTRY = "segment string, file string, size long, modified timestamp, gone boolean"


def _range(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(RANGES)).cast("int")


def _counts(rows: DataFrame, words: str) -> DataFrame:
    """``rows`` with ``_c``, the token and n of each row's tokens: they are sorted, and where runs of equal ones begin is known in the row, without a shuffle."""
    rows = rows.withColumn("_w", F.array_sort(words))
    runs = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("token"), i.alias("at"))), lambda s: (s["at"] == 0) | (F.get("_w", s["at"] - 1) != s["token"]))
    rows = rows.withColumn("_s", runs)
    until = lambda i: F.coalesce(F.get(F.col("_s"), i + 1)["at"], F.size("_w"))
    return rows.withColumn("_c", F.explode(F.transform("_s", lambda s, i: F.struct(s["token"].alias("token"), (until(i) - s["at"]).cast("long").alias("n")))))


class TextIndex:
    """The index of column ``text`` of a table of files, whose rows ``key`` names; in ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str, key_type: str, text: str):
        self.spark, self.folder, self.key, self.text = spark, folder.rstrip("/"), key, text
        self.segments: list[str] | None = None
        self.schema = f"token string, {key} {key_type}, n long, length long, segment string, range int"

    def manifest(self) -> list[Row]:
        """segment, file, size, modified of the files that the index holds: a row for each file."""
        folder = f"{self.folder}/manifest"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema(_ENTRY).parquet(folder).collect()
        gone = {r["segment"] for r in rows if r["gone"]}
        return [r for r in rows if r["segment"] not in gone]

    def _live(self) -> list[str]:
        if self.segments is None:
            self.segments = sorted({r["segment"] for r in self.manifest()})
        return self.segments

    def _written(self, postings: DataFrame, repeated: bool = False) -> str:
        """One shuffle and one sort; postings of one token, key and length, which rows that repeat a key have, are added up in that order too."""
        segment = uuid.uuid4().hex
        dealt = postings.withColumns({"range": _range(F.col("token")), "_part": F.pmod(F.xxhash64(self.key), F.lit(WRITERS))}).repartition("range", "_part")
        if repeated:
            alike = Window.partitionBy("range", "token", self.key, "length", "_part").orderBy("n")
            every = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            dealt = dealt.select("range", "token", self.key, "length", F.sum("n").over(every).alias("n"), F.row_number().over(alike).alias("_nth")).filter("_nth = 1")
        else:
            dealt = dealt.sortWithinPartitions("range", "token", self.key)
        dealt.select("token", self.key, "n", "length", "range").write.partitionBy("range").parquet(f"{self.folder}/postings/segment={segment}")
        return segment

    def refresh(self, source: DataFrame) -> int:
        """Takes in the files of ``source`` that the index doesn't have, and says how many. A file that changed or went takes its segment along; the segment's other files are read again."""
        file = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
        rows = source.select(self.key, self.text, file.alias("_file"))
        of = lambda r: (r["file"], r["size"], r["modified"])
        now, held = {of(r) for r in rows.select("_file.*").distinct().collect()}, self.manifest()  # a row for each file
        gone = {r["segment"] for r in held if of(r) not in now}
        missing = sorted(now - {of(r) for r in held if r["segment"] not in gone})
        entries = [(s, None, None, None, True) for s in sorted(gone)]
        if missing:
            new = rows.filter(F.col("_file.file").isin([m[0] for m in missing])).select(self.key, tokens(F.col(self.text)).alias("_t"))
            counted = _counts(new.withColumn("length", F.size("_t").cast("long")), "_t").select("_c.token", self.key, "_c.n", "length")
            segment = self._written(counted, repeated=True)
            entries += [(segment, *m, False) for m in missing]
        self.segments = sorted({r["segment"] for r in held} - gone)
        if entries:
            self._enter(entries)
        return len(missing)

    def _enter(self, entries: list[tuple]) -> None:
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.segments = None

    def compact(self) -> None:
        """One segment of all: a search then opens one set of files for each range."""
        held = self.manifest()
        old = sorted({r["segment"] for r in held})
        if len(old) > 1:
            segment = self._written(self._postings(old).select("token", self.key, "n", "length"))
            self._enter([(segment, r["file"], r["size"], r["modified"], False) for r in held] + [(s, None, None, None, True) for s in old])

    def _postings(self, segments: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/postings").filter(F.col("segment").isin(segments))

    def frequent(self, limit: int) -> list:
        """token, documents: the tokens that most rows have, ties by the token."""
        return self._postings(self._live()).groupBy("token").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "token").limit(limit).collect()

    def search(self, query: str) -> DataFrame:
        """As ``search_tokens``, with the tokens of a text."""
        return self.search_tokens(self.spark.createDataFrame([(query,)], "q string").select(tokens(F.col("q")).alias("t")).first()["t"])

    def search_tokens(self, wanted: list[str]) -> DataFrame:
        """key, score of the rows with all tokens: the sum of 1 + ln(n), over 1 + ln(length). No token: no row."""
        wanted = sorted(set(wanted))
        segments = self._live() if wanted else []
        if not segments:
            return self.spark.createDataFrame([], self.schema).select(self.key, F.lit(0.0).alias("score"))
        ranges = self.spark.createDataFrame([(t,) for t in wanted], "token string").select(_range(F.col("token")).alias("r")).collect()
        found = self._postings(segments).filter(F.col("range").isin(sorted({r["r"] for r in ranges})) & F.col("token").isin(wanted))
        found = found.groupBy(self.key).agg(F.count("*").alias("_n"), (F.sum(1 + F.log("n")) / F.max(1 + F.log("length"))).alias("score"))
        return found.filter(F.col("_n") == len(wanted)).select(self.key, "score")
