"""Forum dump export: JSON lines -> flat post / reply records -> CSV, and the
typed CSV scan the thread builder reads.

Reading: ``spark.read.text`` over a folder of (optionally zstd-compressed)
files; each file is split by the text source. Parsing is native
(``from_json`` + ``json_object_keys``), so key *presence* can be told apart
from a JSON null where the export depends on it (``permalink``, ``selftext``,
``name``, ``distinguished``). Unparseable lines and lines missing a key the
export needs go to a quarantine table with a reason instead of ending the
job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schemas
from skein.functions.text import null_if_token
from skein.session import materialize, stage_run

SITE = "https://www.reddit.com"
NUMBER = r"^-?[0-9]{1,18}([.][0-9]*)?([eE][+-]?[0-9]{1,2})?$"
MAX_SECONDS = 253402300800.0  # the year 10000: what a timestamp text can show
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# fixed values: columns and keys of the interchange format, in its order
POST_FIELDS = ["author", "title", "score", "created", "text", "id", "link_flair_text", "distinguished",
               "subreddit", "link"]
REPLY_FIELDS = ["author", "score", "created", "body", "name", "parent_id", "distinguished", "subreddit", "link"]

# keys read unconditionally by the export of each kind
POST_REQUIRED = ["author", "title", "score", "created_utc", "id", "link_flair_text", "subreddit"]
REPLY_REQUIRED = ["author", "score", "created_utc", "body", "parent_id", "subreddit"]


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Raw lines (column ``value``) of a file or folder, compressed as their
    suffix says. A last line without a newline is kept. A compressed file is
    read by one task; ``partitions`` deals its lines out before they are parsed."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def _has(keys: Column, k: str) -> Column:
    return F.array_contains(keys, F.lit(k))


def _str(c: Column) -> Column:
    """Text of a scalar value as the export writes it (JSON null -> 'None')."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def parse_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Adds ``status`` ('ok' | 'bad_json' | 'missing_key' | 'bad_value'),
    ``reason`` and the export fields (strings, as written to the CSV) to a
    ``value`` column. A line must be one JSON object and nothing else; a
    creation time must be a number."""
    if kind not in ("posts", "replies"):
        raise ValueError("kind must be 'posts' or 'replies'")
    schema = schemas.RAW_POST if kind == "posts" else schemas.RAW_REPLY
    keys = F.json_object_keys(F.col("value"))
    x = lines.withColumn("_keys", keys).withColumn("_o", F.from_json(F.col("value"), schema))
    k, o = F.col("_keys"), F.col("_o")
    required = POST_REQUIRED if kind == "posts" else REPLY_REQUIRED
    # first missing key, in the order the export reads them (one array
    # expression instead of a CASE per key keeps the generated code small)
    alts = [F.get(F.array_except(F.array(*[F.lit(r) for r in required]), k), 0),
            F.when(~_has(k, "permalink"), F.get(F.array_except(F.array(F.lit("link_id"), F.lit("id")), k), 0))]
    if kind == "replies":
        alts.append(F.when(~_has(k, "name") & ~_has(k, "id"), F.lit("id")))
    missing = F.coalesce(*alts)
    raw_created = F.get_json_object(F.col("value"), "$.created_utc")
    number = F.when(raw_created.rlike(NUMBER), raw_created.cast("double"))
    created_sec = F.when(F.abs(number) < MAX_SECONDS, number.cast("long"))
    # text behind the closing brace makes the line no element of a one-element list
    bad = k.isNull() | F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit("]"))) != 1, F.lit(True))
    status = (F.when(bad, F.lit("bad_json"))
              .when(missing.isNotNull(), F.lit("missing_key"))
              .when(created_sec.isNull(), F.lit("bad_value")).otherwise(F.lit("ok")))
    reason = (F.when(bad, F.lit("undecodable JSON")).when(missing.isNotNull(), F.concat(F.lit("no key "), missing))
              .when(created_sec.isNull(), F.lit("created_utc is no number")))
    link = F.when(_has(k, "permalink"), F.concat(F.lit(SITE), _str(o["permalink"]))).otherwise(
        F.concat(F.lit(SITE + "/r/"), _str(o["subreddit"]), F.lit("/comments/"),
                 F.substr(o["link_id"], F.lit(4)), F.lit("/_/"), _str(o["id"]), F.lit("/")))
    common = {
        "author": F.concat(F.lit("u/"), _str(o["author"])),
        "score": _str(F.get_json_object(F.col("value"), "$.score")),
        "created": F.date_format(F.timestamp_seconds(created_sec), TS_FORMAT),
        "distinguished": F.when(_has(k, "distinguished"), _str(o["distinguished"])),
        "subreddit": _str(o["subreddit"]),
        "link": link,
    }
    if kind == "posts":
        fields = dict(common, **{
            "title": _str(o["title"]),
            "text": F.when(_has(k, "selftext"), _str(o["selftext"])).otherwise(F.lit("")),
            "id": F.concat(F.lit("t3_"), _str(o["id"])),
            "link_flair_text": _str(o["link_flair_text"]),
        })
        order = POST_FIELDS
    else:
        fields = dict(common, **{
            "body": _str(o["body"]),
            "name": F.when(_has(k, "name"), _str(o["name"])).otherwise(F.concat(F.lit("t1_"), _str(o["id"]))),
            "parent_id": _str(o["parent_id"]),
        })
        order = REPLY_FIELDS
    extra = [c for c in lines.columns if c != "value"]
    return x.select(*extra, "value", status.alias("status"), reason.alias("reason"),
                    created_sec.alias("created_utc"), *[fields[c].alias(c) for c in order])


def export_records(parsed: DataFrame, kind: str, line_no: str | None = None) -> DataFrame:
    """Rows that export cleanly, in CSV column order (and input order, given the column that tells it)."""
    order = POST_FIELDS if kind == "posts" else REPLY_FIELDS
    good = parsed.where(F.col("status") == "ok")
    if line_no:
        good = good.repartitionByRange(line_no).sortWithinPartitions(line_no)
    return good.select(*order)


def staged(parsed: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """Parsed lines as a stage table, and their metrics, counted while it is
    written: the dump is read and parsed once, whatever is made of it."""
    seen = Observation()
    table = materialize(parsed.observe(seen, *metrics_columns()), name)
    return table, seen.get


def export(spark: SparkSession, dump_path: str, kind: str, out_path: str, partitions: int | None = None) -> dict:
    """A dump file or folder -> ``out_path``/records (CSV) and ``out_path``/quarantine
    (JSON lines). Returns the metrics (``metrics_columns``) of the lines read."""
    with stage_run(spark):
        parsed, metrics = staged(parse_lines(read_lines(spark, dump_path, partitions), kind), f"parsed_{kind}")
        write_csv(export_records(parsed, kind), f"{out_path}/records")
        quarantine(parsed).write.mode("overwrite").json(f"{out_path}/quarantine")
    return metrics


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") != "ok").select(
        *[c for c in parsed.columns if c not in POST_FIELDS + REPLY_FIELDS + ["status", "created_utc"]], "status")


def metrics_columns() -> list[Column]:
    """lines, bad lines (undecodable), quarantined lines, latest created."""
    return [F.count(F.lit(1)).alias("n_lines"),
            F.count_if(F.col("status") == "bad_json").alias("n_bad"),
            F.count_if(F.col("status") == "missing_key").alias("n_missing"),
            F.count_if(F.col("status") == "bad_value").alias("n_bad_value"),
            F.date_format(F.timestamp_seconds(F.max(F.when(F.col("status") == "ok", F.col("created_utc")))),
                          TS_FORMAT).alias("last_created")]


# --- CSV interchange ---------------------------------------------------------

def write_csv(df: DataFrame, path: str) -> None:
    """Flat CSV with a header; quotes doubled inside quoted fields; values
    written as they are (Spark's writer trims whitespace unless told not to)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


POST_STRINGS = ["author", "title", "body", "id", "link_flair_text", "distinguished"]
REPLY_STRINGS = ["author", "body", "id", "parent_id", "distinguished"]
_ROW = "_row"  # the text of a row that has too few or too many fields


def _scan_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of an exported CSV with score and created as they are written, and
    ``reason``: why a row is no record (null for good ones)."""
    schema = schemas.POST_CSV if kind == "posts" else schemas.REPLY_CSV
    written = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(_ROW, T.StringType())])
    raw = (spark.read.schema(written).option("header", True).option("multiLine", True).option("escape", '"')
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _ROW).csv(path))
    given = null_if_token(F.col("score"))
    reason = (F.when(F.col(_ROW).isNotNull(), F.lit("wrong number of fields"))
              .when(given.isNotNull() & given.try_cast(schema["score"].dataType).isNull(), F.lit("score is no number"))
              .when(F.try_to_timestamp(F.col("created"), F.lit(TS_FORMAT)).isNull(), F.lit("created is no timestamp")))
    return raw.withColumn("reason", reason)


def bad_csv_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The quarantine of a CSV scan: the columns as written, and the reason."""
    return _scan_csv(spark, path, kind).where("reason is not null").drop(_ROW)


def read_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed posts: text renamed to body, subreddit/link dropped, strict
    timestamp, missing-value strings nulled, ``ord`` = input order. Rows that
    are no records are left out (``bad_csv_rows`` has them)."""
    return _typed(_scan_csv(spark, path, "posts").withColumnRenamed("text", "body"), POST_STRINGS, schemas.POST_CSV)


def read_replies_csv(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_scan_csv(spark, path, "replies").withColumnRenamed("name", "id"), REPLY_STRINGS, schemas.REPLY_CSV)


def _typed(df: DataFrame, string_cols: list[str], schema: T.StructType) -> DataFrame:
    out = df.where("reason is null").drop("subreddit", "link", "reason", _ROW)
    out = out.withColumn("score", F.col("score").try_cast(schema["score"].dataType))
    for c in string_cols:
        out = out.withColumn(c, null_if_token(F.col(c)))
    # part files are read in no order of their own: the part number, then the row in its file
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
    row = F.monotonically_increasing_id()
    ordered = F.when(part != "", F.shiftleft(part.cast("long"), 33) + row.bitwiseAND(F.lit((1 << 33) - 1))).otherwise(row)
    return out.withColumn("created", F.try_to_timestamp(F.col("created"), F.lit(TS_FORMAT))).withColumn("ord", ordered)
