"""Tables loaded by key: a load reads the buckets of its own keys, and loads at the same
time do not get in each other's way."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import written_once
from .storage import first_per_key

#: Columns of the layout; a table can't have columns of these names.
LOAD, BUCKET = "load_id", "key_bucket"


def load_keyed(records: DataFrame, path: str, keys: Sequence[str], order_by: Sequence[str] = (),
               buckets: int = 256) -> int:
    """Adds the records whose key is not in the table at ``path``; returns its new version.

    Existing keys win and repeated keys in the batch give one row, the smallest by
    ``order_by``, so running a load twice changes nothing. Null is a key. The first load
    fixes keys, columns, types and the number of buckets; later batches are cast to them.

    Rows lie in folders by load and bucket of their key. Only the buckets that the batch has
    keys in are read, and a load's files are seen once the table's next version names them.
    Versions are files renamed into place, which fails where there is one already: of two
    loads that began with the same version one has to look again at what the other added.
    That needs a file system whose rename is atomic, as Spark's streaming checkpoints do.
    A load that dies leaves files that no version names.
    """
    spark = records.sparkSession
    batch = None
    while True:
        version, table = _latest(spark, path)
        if batch is None:
            table = table or {"keys": list(keys), "buckets": buckets, "schema": _described(records), "loads": []}
            if table["keys"] != list(keys):
                raise ValueError(f"the table's keys are {table['keys']}, not {list(keys)}")
            schema = T.StructType.fromJson(table["schema"])
            typed = records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            bucket = F.pmod(F.xxhash64(*keys), F.lit(table["buckets"])).cast("int")
            batch = written_once(first_per_key(typed, keys, order_by).withColumn(BUCKET, bucket), "batch")
            touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())
            first = table
        elif table and (table["buckets"], table["schema"], table["keys"]) != (first["buckets"], first["schema"], first["keys"]):
            raise ValueError("another load has just begun this table with other columns, keys or buckets")
        table = table or first
        known = _rows(spark, path, table, touched).select(*[F.col(k).alias(f"known_{i}") for i, k in enumerate(keys)])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"known_{i}")) for i, k in enumerate(keys)])
        load = uuid.uuid4().hex
        added = f"{path}/data/{LOAD}={load}"
        batch.join(known, same, "left_anti").hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(added)
        if _committed(spark, path, version + 1, {**table, "loads": [*table["loads"], [load, touched]]}):
            return version + 1
        _hadoop(spark, added)[1].delete(_hadoop(spark, added)[0], True)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows in its latest version."""
    version, table = _latest(spark, path)
    if table is None:
        raise ValueError(f"no table at {path}")
    return _rows(spark, path, table, range(table["buckets"]))


def _described(records: DataFrame) -> dict:
    clash = {LOAD, BUCKET} & {c.lower() for c in records.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the layout's")
    return T.StructType([T.StructField(f.name, f.dataType) for f in records.schema]).jsonValue()


def _rows(spark: SparkSession, path: str, table: dict, buckets: Sequence[int]) -> DataFrame:
    """Rows of some buckets: folders of other buckets, and of loads without them, are not read."""
    schema, wanted = T.StructType.fromJson(table["schema"]), set(buckets)
    loads = [f"{path}/data/{LOAD}={load}" for load, touched in table["loads"] if wanted.intersection(touched)]
    if not loads:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField(LOAD, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
    found = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*loads)
    if len(wanted) < table["buckets"]:
        found = found.where(F.col(BUCKET).isin(sorted(wanted)))
    return found.select(*schema.names)


def _hadoop(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    folder, files = _hadoop(spark, f"{path}/versions")
    if not files.exists(folder):
        return 0, None
    found = [s.getPath().getName() for s in files.listStatus(folder)]
    version = max((int(n) for n in found if n.isdigit()), default=0)
    if not version:
        return 0, None
    return version, json.loads(spark.read.text(f"{path}/versions/{version:012d}", wholetext=True).first()[0])


def _committed(spark: SparkSession, path: str, version: int, table: dict) -> bool:
    """Whether this became the table's version of that number: nobody else's is."""
    name = f"{path}/versions/{version:012d}"
    draft, files = _hadoop(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(json.dumps(table).encode())
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, _hadoop(spark, name)[0], options)
        return True
    except Py4JJavaError as error:
        files.delete(draft, False)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
