"""What the corpus operators share: word rules, the shared folder, stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 patterns of a word and of the white space between words.
WORD = r"[^ \t-\r]+"
GAP = r"[ \t-\r]+"
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests) is a temporary folder made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='callejero-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/callejero/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread, not a recomputation. The folder belongs to the
    application and may be emptied once its results have been read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_text(name: str = "doc_id") -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_residue(divisor: int, name: str = "doc_id") -> Column:
    """crc32 of the id's text modulo ``divisor``: the fold a document falls in."""
    return (F.crc32(F.encode(id_text(name), "UTF-8")) % divisor).cast("int")
