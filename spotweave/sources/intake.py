"""Lead rows and uploads: validation, landing, signature checks."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.runtime import numbered, shared_folder

# What an address must look like, the first bytes of an HDF5 file, and (below) the bounds of a lead's fields.
EMAIL = r"(?i)^[^@\s]+@[^@\s]+\.[^@\s]+$"
HDF5_MAGIC = "894844460D0A1A0A"
# What a browser's trim() takes from both ends.
WHITE = " \t\n\x0b\x0c\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LEAD = "full_name string, email string, company string, role string, company_size string, looking_for string, source string, hp string"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end. Trimming the right end walks through the whole text, so it is done only where that end is white."""
    ends = reduce(lambda x, w: x | F.endswith(c, F.lit(w)), WHITE[1:], F.endswith(c, F.lit(WHITE[0])))
    return F.ltrim(F.when(ends, F.rtrim(c, F.lit(WHITE))).otherwise(c), F.lit(WHITE))


def empty_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def drop_bots(leads: DataFrame) -> DataFrame:
    """Rows whose honeypot is empty."""
    return leads.where(F.col("hp").isNull() | (F.col("hp") == ""))


def _rules() -> list[tuple[str, Column]]:
    """What can be wrong with a lead, in a fixed order; a test may be null, which is not wrong."""
    # from the left alone, which stops at the first sign
    blank = lambda c: F.ltrim(F.coalesce(F.col(c), F.lit("")), F.lit(WHITE)) == ""
    longer = lambda c, n: (F.octet_length(c) > n) & (F.length(c) > n)
    return [
        ("full_name required", blank("full_name")), ("full_name length", longer("full_name", 200)), ("email required", blank("email")), ("email shape", ~blank("email") & ~trimmed(F.col("email")).rlike(EMAIL)), ("email length", longer("email", 320)),
        ("company required", blank("company")), ("company length", longer("company", 200)), ("role length", longer("role", 200)), ("company_size required", blank("company_size")), ("company_size length", longer("company_size", 40)),
        ("looking_for required", blank("looking_for")), ("looking_for length", longer("looking_for", 5000)), ("source length", longer("source", 300)),
    ]


def validate_lead(leads: DataFrame) -> DataFrame:
    """Adds `reasons`, an array of what is wrong in a fixed order, empty for a valid row."""
    return leads.withColumn("reasons", F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in _rules()]), lambda x: x.isNotNull()))


def _wrong() -> Column:
    """Whether validate_lead has any reason, without making them."""
    return reduce(lambda x, y: x | y, [F.coalesce(test, F.lit(False)) for _, test in _rules()])


def valid(leads: DataFrame) -> DataFrame:
    """Rows that are valid, trimmed; role and source are null where nothing is left."""
    good = drop_bots(leads).where(~_wrong()).drop("hp")
    bare = {c: trimmed(F.col(c)) for c in ("full_name", "email", "company", "looking_for")}
    return good.withColumns(bare | {c: empty_to_null(F.col(c)) for c in ("role", "source")})


def rejected(leads: DataFrame) -> DataFrame:
    return validate_lead(drop_bots(leads).where(_wrong()))


#: Contents that repeat within a batch and whose hashes are sent to all tasks; with more of them all rows are numbered.
AGAIN = 200_000


def landed(leads: DataFrame, batch: str | int) -> DataFrame:
    """Valid rows with an id and a time. The id follows from the batch, the row's content and its place among the batch's equal rows, so a batch that is
    landed again gives the same ids. Only rows whose content comes again are numbered, by an exchange; the others, the only ones of their content, stay where they are."""
    good = valid(leads)
    good = good.withColumn("_content", F.sha2(F.to_json(F.struct(*good.columns)), 256))
    shared_folder(leads.sparkSession)
    again = good.groupBy("_content").agg(F.count("*").alias("_n")).where("_n > 1").select("_content").checkpoint()
    few = again.limit(AGAIN + 1).count()
    numbers = lambda rows: numbered(rows.withColumn("_tie", F.monotonically_increasing_id()), ["_content"], ["_tie"], "_k").drop("_tie")
    if few > AGAIN:
        placed = numbers(good)
    else:
        placed = good.join(F.broadcast(again), "_content", "left_anti").withColumn("_k", F.lit(0).cast("long"))
        if few:
            placed = placed.unionByName(numbers(good.join(F.broadcast(again), "_content", "left_semi")))
    said = F.md5(F.concat_ws("/", F.lit(str(batch)), "_content", F.col("_k").cast("string")))
    identity = F.regexp_replace(said, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return placed.withColumn("id", identity).withColumn("created_at", F.current_timestamp()).drop("_content", "_k")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch): what the ledger of a landing place lists."""
    try:
        return spark.read.schema("batch string").parquet(f"{root}/ledger")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "batch string")


def append_leads(leads: DataFrame, root: str, batch: str | int) -> bool:
    """Lands a batch: valid and rejected rows are staged, each under the batch's own folder, and then the batch is entered into the ledger.

    Readers (`read_leads`) see batches of the ledger alone. A batch that failed anywhere before its entry is landed again as a whole and replaces what it staged;
    one that is entered already is left alone, and False says so.
    """
    spark, name = leads.sparkSession, str(batch)
    if committed(spark, root).where(F.col("batch") == name).take(1):
        return False
    landed(leads, batch).write.mode("overwrite").parquet(f"{root}/valid/batch={name}")
    rejected(leads).write.mode("overwrite").parquet(f"{root}/rejected/batch={name}")
    spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return True


def read_leads(spark: SparkSession, root: str, kind: str = "valid") -> DataFrame:
    """The rows (kind: valid or rejected) of all batches of the ledger."""
    rows = spark.read.option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}").withColumn("batch", F.col("batch").cast("string"))
    return rows.join(committed(spark, root).distinct(), "batch", "left_semi").drop("batch")


#: Bytes of a file that tell its kind, and files that one task looks at.
HEAD, FILES_EACH = 8, 512


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class FileHeads(DataSource):
    """(path, size, head) of each file under a path, empty ones too: a listing, and of each file its first bytes. Nothing else is read.
    Paths are those that Arrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, size long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options["path"], int(self.options.get("bytes", HEAD)))


class _HeadReader(DataSourceReader):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not posixpath.basename(f.path).startswith(("_", "."))]
        found.sort()
        return [_Files(found[i : i + FILES_EACH]) for i in range(0, len(found), FILES_EACH)] or [_Files([])]

    def read(self, partition: _Files):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for path, size in partition.files:
            head = b""
            if size:
                with system.open_input_file(path) as f:
                    head = f.read(self.n)
            yield path, size, head


def scan_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as rows (path, size, head)."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").load(path)


def upload_signature_check(files: DataFrame) -> DataFrame:
    """Status and reason for rows (path, size, head): name, then emptiness, then the first eight bytes."""
    named, empty = F.col("path").rlike(r"(?i)\.h5ad$"), F.coalesce(F.col("size"), F.lit(0)) == 0
    ok = F.coalesce(F.hex(F.substring("head", 1, HEAD)) == HDF5_MAGIC, F.lit(False))
    code = F.when(~named | empty, 400).when(~ok, 415).otherwise(200)
    why = F.when(~named, "name").when(empty, "empty").when(~ok, "signature").otherwise("ok")
    return files.select("path", code.alias("status"), why.alias("reason"))


def upload_receipt(uploads: DataFrame) -> DataFrame:
    """received, declared size or else the received one, truncated, positive spot count or null: a row for each upload, names that repeat included,
    with whatever other columns it has."""
    declared = F.coalesce("declared_size", F.lit(0))
    others = [c for c in uploads.columns if c not in ("filename", "received", "declared_size", "file_size", "truncated", "spots")]
    return uploads.select(*others, "filename", "received", F.when(declared > 0, declared).otherwise(F.col("received")).alias("file_size"), (declared > F.col("received")).alias("truncated"), F.when(F.col("spots") > 0, F.col("spots")).alias("spots"))


def spot_count_resolve(meta: DataFrame) -> DataFrame:
    """n_obs from the index, else dense rows, else index pointers less one; zero is absent."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return meta.select("file", F.coalesce(some("idx_len"), some("dense_rows"), F.when(F.col("indptr_len") > 1, F.col("indptr_len") - 1)).alias("n_obs"))
