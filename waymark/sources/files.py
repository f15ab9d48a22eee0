"""Text tables in and out: every column a string, encodings found, headers checked, outputs split by area or size."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import rank
from waymark.functions.text import file_stem, text
from waymark.operators.tables import union_by_name


def encoding_of(spark: SparkSession, path: str) -> str:
    """``UTF-8``, or ``windows-1252`` if a file's bytes aren't that, or ``ISO-8859-1`` if they aren't that either (A2).

    Bytes are looked at by Spark, in pieces, so files may be large and in any store.
    """
    lines = spark.read.text(path)  # a line's bytes as they are
    # Bytes 0x81, 0x8d, 0x8f, 0x90, 0x9d have no sign in windows-1252.
    seen = lines.agg(
        F.max((~F.is_valid_utf8("value")).cast("int")).alias("not_utf8"),
        F.max(F.hex(F.col("value").cast("binary")).rlike("^(?:..)*?(?:81|8D|8F|90|9D)").cast("int")).alias("undefined"),
    ).first()
    return "UTF-8" if not seen.not_utf8 else "ISO-8859-1" if seen.undefined else "windows-1252"


def read_csv(spark: SparkSession, path: str, encoding: str | None = "UTF-8", quote: str = '"') -> DataFrame:
    """A file with a header, all columns strings, blanks as blanks, a byte order mark dropped (A1). Null ``encoding``: find it."""
    encoding = encoding or encoding_of(spark, path)
    western = encoding.lower() in ("windows-1252", "cp1252")  # Spark reads it as Latin-1; the signs that differ are put right
    reader = spark.read.options(header=True, inferSchema=False, encoding="ISO-8859-1" if western else encoding, quote=quote, escape=quote, multiLine=False, nullValue="\0", emptyValue="", enforceSchema=False)
    df = reader.csv(path)
    clean = {c: c.translate(_WESTERN if western else {}).lstrip("\ufeff").strip() for c in df.columns}
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    if western:
        signs = ["".join(x) for x in zip(*((chr(k), v) for k, v in _WESTERN.items()), strict=True)]
        return df.select(*[F.translate(value(c), *signs).alias(clean[c]) for c in df.columns])
    return df.select(*[value(c).alias(clean[c]) for c in df.columns])


def _western() -> dict[int, str]:
    signs = {k: bytes([k]).decode("cp1252", "ignore") for k in range(0x80, 0xA0)}
    return {k: v for k, v in signs.items() if v}


_WESTERN = _western()


def canonical_header(columns: Sequence[str]) -> set[str]:
    return {c.strip().lower() for c in columns}


def has_header(df: DataFrame, required: Sequence[str]) -> bool:
    """A3."""
    return canonical_header(required) <= canonical_header(df.columns)


def resolve_column(columns: Sequence[str], wanted: str, aliases: Mapping[str, Sequence[str]] | None = None) -> str | None:
    """The column that a name means (A18): exact, else one that starts with it, else one that it starts with, else an alias."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    w = wanted.strip().lower()
    if w in low:
        return low[w]
    for test in (lambda c: c.startswith(w), lambda c: bool(c) and w.startswith(c)):
        if hit := [low[c] for c in map(str.lower, map(str.strip, columns)) if test(c)]:
            return hit[0]
    return next((low[a.lower()] for a in (aliases or {}).get(wanted, ()) if a.lower() in low), None)


def conformed(df: DataFrame, columns: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``df`` under a fixed header; columns that it has nothing for are blank, what the header lacks goes."""
    found = {c: resolve_column(df.columns, c, aliases) for c in columns}
    return df.select(*[(text(F.col(f"`{src}`")) if src else F.lit("")).alias(c) for c, src in found.items()])


def newest(spark: SparkSession, folder: str, pattern: str = "*.csv", skip: Sequence[str] = ()) -> str | None:
    """The file of a folder that was written last, run artefacts aside (A4); ties to the last name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    for s in skip:
        files = files.where(~name.startswith(s.lower()))
    row = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()
    return row.m.path if row.m else None


def read_folder(spark: SparkSession, paths: Sequence[str], required: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """All files with the required columns under one lower-case header, and those that lack some."""
    kept, left = [], []
    for path in paths:
        df = read_csv(spark, path)
        df = df.toDF(*[c.lower() for c in df.columns])
        (kept if has_header(df, required) else left).append((path, df))
    frames = [df.withColumn("_file", F.lit(p)) for p, df in kept]
    return (union_by_name([f.drop("_file") for f in frames]) if frames else None), [p for p, _ in left]


def indexed(df: DataFrame, target: str, folds: Mapping[str, Column], key: str, buckets: int = 64) -> DataFrame:
    """A table with derived key columns, written for lookups by one of them (A5, A6): rows of a key lie together."""
    spark = df.sparkSession
    d = df.withColumns(dict(folds))
    d.repartitionByRange(buckets, key).sortWithinPartitions(key).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def split_point(c: Column) -> Column:
    """``lat`` and ``lon`` of one text, split at its first comma."""
    return F.struct(F.trim(F.split_part(c, F.lit(","), F.lit(1))).try_cast("double").alias("lat"), F.trim(F.split_part(c, F.lit(","), F.lit(2))).try_cast("double").alias("lon"))


HIT = T.StructType([T.StructField("label", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("postcode", T.StringType())])


def hit_of(parts: Column) -> Column:
    """A lookup's answer of two to four parts as one shape (L4): [lat, lon], [label, lat, lon] or [label, lat, lon, postcode]."""
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    two = n == 2
    return F.struct(
        F.when(two, "").otherwise(F.coalesce(at(0), F.lit(""))).alias("label"),
        F.when(two, at(0)).otherwise(at(1)).try_cast("double").alias("lat"),
        F.when(two, at(1)).otherwise(at(2)).try_cast("double").alias("lon"),
        F.when(n >= 4, F.coalesce(at(3), F.lit(""))).otherwise("").alias("postcode"),
    )


def is_hit(hit: Column) -> Column:
    """Whether an answer holds coordinates; four blanks don't."""
    return F.coalesce(hit["lat"].isNotNull() & hit["lon"].isNotNull(), F.lit(False))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``address`` and its hit, of JSON objects {address: [label, lat, lon, postcode]} (A8): one over a whole file, or one to a line."""
    lines = spark.read.text(path, wholetext=not _by_lines(spark, path))
    pairs = lines.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("address", "parts"))
    return pairs.select("address", hit_of(F.col("parts")).alias("h")).select("address", "h.*")


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether every line is an object of its own."""
    return spark.read.text(path).where("trim(value) <> '' and not (trim(value) like '{%}')").isEmpty()


def write_cache(df: DataFrame, path: str, entries: int = 1000) -> DataFrame:
    """The cache as JSON objects in the order of their keys, one to a line with ``entries`` of them, which :func:`read_cache` reads.

    The same entries give the same lines, whatever their order and partitions. Returns the manifest: ``chunk``, ``n``, its ``first`` and
    ``last`` key and the SHA-256 of its line. Of an address's rows the first counts.
    """
    one = rank.first_by(df.select("address", "label", "lat", "lon", "postcode"), ["address"], ["label", "lat", "lon", "postcode"])
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entry = F.concat(F.regexp_extract(F.to_json(F.struct("address")), r'^\{"address":(.*)\}$', 1), F.lit(":"), F.to_json(F.array(*map(plain, ("label", "lat", "lon", "postcode")))))
    numbered = rank.with_row_id(one.withColumn("entry", entry).select("address", "entry"), ["address"])
    chunk = F.floor((F.col("_row_id") - 1) / entries).cast("long").alias("chunk")
    lines = numbered.groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct("_row_id", "address", "entry"))).alias("e"))
    lines = lines.withColumn("line", F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit("}")))
    lines.select("chunk", F.col("line").alias("value")).repartitionByRange("chunk").sortWithinPartitions("chunk").select("value").write.mode("overwrite").text(path)
    at = lambda i: F.element_at("e", i)["address"]
    return lines.select("chunk", F.size("e").cast("long").alias("n"), at(1).alias("first"), at(-1).alias("last"), F.sha2("line", 256).alias("sha256"))


def kept_fresh(spark: SparkSession, target: str, seconds: float, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built again once it is older than ``seconds`` (N11). A new one is written beside the old one and then takes
    its place, so that readers find a whole one; what they are reading of the old one goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(conf)
    if not fs.exists(path) or time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > seconds:
        new = jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}")
        build().write.parquet(new.toString())
        fs.delete(path, True)
        fs.rename(new, path)
    return spark.read.parquet(target)


def without_keys(cache: DataFrame, streets: DataFrame, street: Column, suburb: Column | None = None) -> DataFrame:
    """A cache less the entries of some streets (``street``, optionally ``suburb``)."""
    d = cache.withColumn("_street", F.lower(F.trim(street)))
    keys = ["_street"]
    gone = streets.withColumn("_street", F.lower(F.trim("street")))
    if suburb is not None:
        d, gone, keys = d.withColumn("_suburb", F.lower(F.trim(suburb))), gone.withColumn("_suburb", F.lower(F.trim("suburb"))), ["_street", "_suburb"]
    return d.join(gone.select(*keys).distinct(), keys, "left_anti").select(*cache.columns)


def write_routes(df: DataFrame, target: str, route: str = "route") -> None:
    """One folder for each side, the same header in both, technical columns out."""
    d = df.select(*[c for c in df.columns if not c.startswith("_")])
    d.write.mode("overwrite").partitionBy(route).option("header", True).csv(target)


def write_areas(df: DataFrame, target: str, area: str, failed: Column) -> None:
    """One folder for each area and outcome, under names that any file system takes."""
    d = df.withColumns({"area_stem": file_stem(area), "outcome": F.when(failed, "failed").otherwise("clean")})
    d.select(*[c for c in d.columns if not c.startswith("_")]).write.mode("overwrite").partitionBy("area_stem", "outcome").option("header", True).csv(target)


def write_chunks(df: DataFrame, target: str, chunk: str = "chunk") -> None:
    """A16."""
    df.write.mode("overwrite").partitionBy(chunk).option("header", True).csv(target)


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one state of a folder has more often than the other."""
    cols = sorted(set(before.columns) & set(after.columns))
    a, b = before.select(*cols), after.select(*cols)
    return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))


def is_stale(spark: SparkSession, source: str, target: str) -> bool:
    """Whether a source file was written after a derived table, or that isn't there (A5, M3)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def written(path: str) -> int | None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None

    made = written(target)
    return made is None or (written(source) or 0) > made
