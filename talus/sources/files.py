"""CSV and GeoJSON readers with header aliases. Every raw value stays text.

Reads are Spark jobs over any number of files. `_order` sorts rows as the files do: (file, position).
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus import vocab
from talus.runtime import spread


class DatasetError(ValueError):
    """A dataset that cannot be read; the message is fit for a user."""


def file_type(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return "csv"
    if suffix in (".geojson", ".json"):
        return "geojson"
    raise DatasetError(f"Unsupported file type '{suffix or '(none)'}': expected .csv or .geojson")


def merge_aliases(extra: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Caller aliases extend the built-in lists and never replace them."""
    merged = {field: list(names) for field, names in vocab.COLUMN_ALIASES.items()}
    for field, names in (extra or {}).items():
        known = merged.setdefault(field, [])
        known += [n for n in names if n not in known]
    return merged


def column_map(headers: list[str], extra: dict[str, list[str]] | None = None) -> dict[str, str | None]:
    """Logical field -> header. Case-insensitive; the first alias that occurs wins."""
    by_lower = {h.lower(): h for h in headers}
    return {
        field: next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)
        for field, names in merge_aliases(extra).items()
    }


ORDER_FIELDS = ["file", "block", "at"]


def _order():
    meta = F.col("_metadata")
    return F.struct(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at")
    ).alias("_order")


def _exists(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target):
        raise DatasetError(f"File not found: {PurePosixPath(path).name}")


def read_csv(spark: SparkSession, path: str, quoted_newlines: bool = False) -> DataFrame:
    """All columns as text; a byte-order mark in front of the first header is dropped.

    Every file is read under its own header: files with equal headers are one scan, and the scans are put together by
    name, where names of one logical field (see column_map) count as the same. Files with line breaks inside quotes cannot
    be split between tasks, so that reading is opt-in.
    """
    groups = _files_by_header(spark, path)
    names: dict[str, str] = {}
    parts = []
    for paths in groups:
        df = spark.read.csv(paths, header=True, inferSchema=False, multiLine=quoted_newlines, escape='"', encoding="UTF-8")
        plain = {c: c.lstrip("\ufeff") for c in df.columns}
        if len(groups) > 1:
            logical = {header: field for field, header in column_map(list(plain.values())).items() if header}
            plain = {c: names.setdefault(logical[h], h) if h in logical else h for c, h in plain.items()}
        parts.append(df.select(*[F.col(f"`{c}`").alias(n) for c, n in plain.items()], _order()))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return spread(rows) if quoted_newlines else rows


def _files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a path, grouped by their first line. Only those lines are read here, as CSV inference would."""
    _exists(spark, path)
    files = sorted(spark.read.text(path).inputFiles())
    if len(files) < 2:
        return [[path]]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    groups: dict[str, list[str]] = {}
    for name in files:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = target.getFileSystem(conf).open(target)
        try:
            header = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()
        if header is not None:  # an empty file has no rows
            groups.setdefault(header.lstrip("\ufeff"), []).append(name)
    return list(groups.values()) or [[path]]


_FEATURE = T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ])),
])
_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features of all files, one row each: properties map, geometry type, raw coordinates."""
    _exists(spark, path)
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", _COLLECTION).alias("doc")
    )
    return whole.select("file", F.posexplode("doc.features").alias("at", "f")).select(
        "file", "at",
        F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature, columns = sorted union of property names.

    A Point fills longitude and latitude only when the property itself is absent; a property that is
    present but null wins.
    """
    rows = read_features(spark, path)
    point = F.from_json("coordinates", "array<double>")
    given = F.col("properties")
    is_point = F.col("geometry_type") == "Point"
    add = [
        F.when(is_point & ~F.map_contains_key(given, name), F.create_map(F.lit(name), F.get(point, F.lit(i)).cast("string")))
        .otherwise(F.create_map().cast("map<string,string>"))
        for i, name in enumerate(("longitude", "latitude"))
    ]
    full = rows.withColumn("properties", F.map_concat(given, *add))
    # The header of the table: a bounded list of distinct property names, needed to name the columns.
    names = [r[0] for r in full.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").collect()]
    return full.select(
        *[F.try_element_at("properties", F.lit(n)).alias(n) for n in names],
        F.struct("file", F.col("at").cast("long")).alias("_order"),
    )


def read_dataset(spark: SparkSession, path: str, quoted_newlines: bool = False) -> DataFrame:
    return read_csv(spark, path, quoted_newlines) if file_type(path) == "csv" else read_geojson(spark, path)


def tagged(df: DataFrame, kind: str, source_name: str) -> DataFrame:
    return df.withColumn("dataset_kind", F.lit(kind)).withColumn("source_name", F.lit(source_name))


def read_inventory(spark: SparkSession, path: str, source_name: str = "external_landslide_inventory") -> DataFrame:
    return tagged(read_dataset(spark, path, quoted_newlines=True), "landslide_inventory", source_name)


def read_rainfall(spark: SparkSession, path: str, source_name: str = "external_rainfall_data") -> DataFrame:
    return tagged(read_dataset(spark, path), "rainfall", source_name)


def logical_view(df: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows under their logical field names; a field the file lacks is NULL."""
    mapping = column_map(df.columns, extra)
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(f) for f, c in mapping.items()])


# Files up to this many bytes are rows of Spark's binary-file source, whole; longer ones are read piece by piece.
WHOLE_FILE_BYTES = 32 << 20
PIECE_BYTES = 4 << 20


def checksums(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """SHA-256, size and bare name of every file of a folder or glob; `more` are columns of the binary-file source's rows, whose content is NULL
    for files that are read piece by piece."""
    listed = spark.read.format("binaryFile").load(path)
    whole = F.col("length") <= min(WHOLE_FILE_BYTES, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    named = [F.regexp_extract("path", r"[^/]+$", 0).alias("file_name")]
    small = listed.where(whole).select(*named, F.sha2("content", 256).alias("checksum_sha256"), F.col("length").alias("file_size_bytes"), *more)
    # Without its content a row is what the listing says.
    long = listed.where(~whole).select("path", "modificationTime", "length")
    if long.isEmpty():
        return small
    piece = PIECE_BYTES

    def read(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            sums = []
            for name in batch.column("path").to_pylist():
                total = hashlib.sha256()
                with open("/" + name.removeprefix("file:").lstrip("/"), "rb") as stream:
                    while held := stream.read(piece):
                        total.update(held)
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "checksum_sha256"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.schema.fields) + ", checksum_sha256 string"
    local = F.col("path").startswith("file:/")
    # One long file is one task.
    found = long.where(local).repartitionByRange(long.count(), "path").mapInArrow(read, types)
    # Only Spark's own file systems open the others: read by the driver's JVM, one after the other.
    far = [(*r, _streamed_sum(spark, r["path"])) for r in long.where(~local).collect()]
    streamed = (found.unionByName(spark.createDataFrame(far, types)) if far else found).withColumn("content", F.lit(None).cast("binary"))
    return small.unionByName(streamed.select(*named, "checksum_sha256", F.col("length").alias("file_size_bytes"), *more))


def _streamed_sum(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
