"""Reading and writing tables, documents, nodes and models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# What a reader takes for missing, and size limits.
MISSING = ["", "NA", "N/A", "NaN", "nan", "null", "None"]
MAX_BYTES, STORED = 50 << 20, 2000
# End of the fixed values.


#: Forms that a text must have beside casting to a type, from the narrowest type to the widest.
LADDER = (
    ("boolean", r"(?i)^(true|false)$"),
    ("bigint", r"^[+-]?\d+$"),
    ("decimal(38,0)", r"^[+-]?\d+$"),
    ("double", r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"),
    ("date", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("timestamp", r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?)?$"),
)
CORRUPT = "_corrupt"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A headed CSV (types inferred unless given) or Parquet; missing marks and NaN become null.

    Records with another number of fields than the header are left out; read_checked gives them as well.
    """
    return read_checked(spark, path, schema)[0]


def read_checked(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(table, rejected: record, reason) of a headed CSV, or of Parquet, which has no rejected records.

    A record is rejected if its number of fields isn't the header's or, with a schema, if a value doesn't fit. Quotes are
    doubled inside quoted fields, which may hold line ends (multi_line; without, large files are split among tasks).
    Without a schema each column gets the narrowest type of LADDER that all its values fit. Blank fields are missing, so
    that an empty text comes back as null.
    """
    none = spark.createDataFrame([], "record string, reason string")
    if path.rstrip("/").endswith(".parquet"):
        return without_nan(spark.read.parquet(path)), none
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"', columnPruning=False, enforceSchema=True, maxCharsPerColumn=-1)
    names = reader.csv(path).columns
    if not names:
        return spark.createDataFrame([], T.StructType()), none
    given = None if schema is None else T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names] if given is None else given.fields)
    marked = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    reader = reader.option("nullValue", "" if given is None else "NA")
    raw = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(marked).csv(path)
    # Spark won't read the corrupt record alone, so that a field is looked at as well, to no effect.
    bad = raw.where(F.col(CORRUPT).isNotNull() & (F.pmod(F.xxhash64(quoted(fields.names[0])), F.lit(2)) >= 0))
    text = F.col(CORRUPT)
    fewer = F.lit(False) if given is not None else F.col(quoted(fields.names[-1])).isNull()
    reason = F.when(F.lit(given is not None), "a value or the number of fields doesn't fit the schema").when(fewer, "fewer fields than the header, or an empty last one").otherwise("more fields than the header")
    good = reader.option("mode", "DROPMALFORMED").schema(fields).csv(path)
    if given is None:
        missing = lambda c: F.trim(F.col(quoted(c))).isin(MISSING)
        good = typed(good.select([F.when(~missing(c), F.col(quoted(c))).alias(c) for c in good.columns]))
    return without_nan(good), bad.select(text.alias("record"), reason.alias("reason"))


def without_nan(df: DataFrame) -> DataFrame:
    floats = (T.DoubleType, T.FloatType)
    return df.select([(F.when(~F.isnan(F.col(quoted(f.name))), F.col(quoted(f.name))).alias(f.name) if isinstance(f.dataType, floats) else F.col(quoted(f.name))) for f in df.schema.fields])


def typed(text: DataFrame) -> DataFrame:
    """Each text column as the narrowest type of LADDER that every value fits, found in one pass; text if there is none, or no value.

    A column of dates and times is one of times.
    """
    if not text.columns:
        return text
    cols = {c: F.col(quoted(c)) for c in text.columns}
    fits = text.agg(*[F.coalesce(F.bool_and(F.when(col.isNotNull(), F.trim(col).rlike(form) & F.trim(col).try_cast(kind).isNotNull())), F.lit(False)).alias(f"{i}_{k}") for i, col in enumerate(cols.values()) for k, (kind, form) in enumerate(LADDER)]).first()
    pick = {c: next((kind for k, (kind, _) in enumerate(LADDER) if fits[f"{i}_{k}"]), None) for i, c in enumerate(cols)}
    return text.select([(F.trim(cols[c]).cast(kind) if kind else cols[c]).alias(c) for c, kind in pick.items()])


def write_table(df: DataFrame, base: str, table_id: str, label: str, stamp: str) -> str:
    """Write with a header to <base>/<id>_<label>_<stamp>, as read_table reads it; the folder must not be there."""
    path = f"{base}/{table_id}_{label}_{stamp}"
    df.write.mode("error").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return path


def path_id(path):
    """The first ten hexadecimal digits of a path's md5."""
    return F.substring(F.md5(path), 1, 10)


def read_binary_docs(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, path, length, content; rejected: doc_id, path, length) of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(path_id(F.col("path")).alias("doc_id"), "path", "length", "content")
    return named.where(F.col("length") <= max_bytes), named.where(F.col("length") > max_bytes).drop("content")


PAGES = "doc_id string, page int, text string, method string"


def extract_pages(docs: DataFrame, extractor: Callable, schema: str = PAGES) -> DataFrame:
    """Pages by a function from batches of documents (pandas) to batches of pages."""
    return docs.mapInPandas(extractor, schema)


def upsert_nodes(existing: DataFrame, incoming: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Insert or replace by key; incoming rows win, blank texts are skipped, texts are stored up to a length."""
    fresh = incoming.where(F.trim(F.col(text)) != "").withColumn(text, F.substring(text, 1, STORED))
    both = existing.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.desc("_v"), text)
    return both.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "_v")


def new_documents(incoming: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Documents without nodes and metadata yet; all of them if forced."""
    return incoming if force else incoming.join(indexed.select("doc_id").distinct(), "doc_id", "left_anti")


def delete_keys(tables: dict[str, DataFrame], keys: DataFrame, on: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Each table without the rows of the keys; on: the key columns of each table."""
    return {name: df.join(keys.select(*on[name]).distinct(), on[name], "left_anti") for name, df in tables.items()}


def scalar_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata columns as one map of text."""
    pairs = reduce(lambda a, b: [*a, *b], [[F.lit(c), F.col(c).cast("string")] for c in columns], [])
    return df.withColumn("meta", F.create_map(*pairs)).drop(*columns)


def model_path(folder: str, name: str) -> str:
    return f"{folder}/{name.lower().replace(' ', '_')}_best"


def save_model(model, folder: str, name: str) -> str:
    path = model_path(folder, name)
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
